"""Queries of the numbered operators over their whole tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.bpe import bpe_digest
from lintlake.llm.chat import rotate_perspectives
from lintlake.llm.common import read
from lintlake.llm.fingerprints import fingerprints
from lintlake.llm.infill import infill_digest
from lintlake.llm.jaccard import ngram_join
from lintlake.llm.mixing import mix
from lintlake.llm.packing import pack_documents
from lintlake.llm.quality import quality_rules
from lintlake.llm.runs import runs_digest
from lintlake.llm.sharding import shard_documents
from lintlake.llm.suffix_dedup import suffix_dedup
from lintlake.llm.tokens import token_counts
from lintlake.llm.warc import archive_pages


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup(read(spark, folder, "documents"), keep_text=False)


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(read(spark, folder, "documents"), keep_ids=False)


def op3_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join(read(spark, folder, "documents"))


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard_documents(read(spark, folder, "documents"))


def op5_perspectives(spark: SparkSession, folder: str) -> DataFrame:
    """The masks as text, start-end and so on, so that both engines compare them alike."""
    spans = F.array_join(F.transform("masks", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return rotate_perspectives(read(spark, folder, "conversations")).withColumn("masks", spans)


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(read(spark, folder, "documents"))


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(read(spark, folder, "documents"))


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    return archive_pages(read(spark, folder, "pages"))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(read(spark, folder, "documents")).drop("parts")


def op10_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints(read(spark, folder, "documents"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs_digest(read(spark, folder, "documents"))


def op12_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_digest(read(spark, folder, "documents"))


def op13_infill(spark: SparkSession, folder: str) -> DataFrame:
    return infill_digest(read(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_packing": op2_packing,
    "op3_ngram_join": op3_ngram_join,
    "op4_sharding": op4_sharding,
    "op5_perspectives": op5_perspectives,
    "op6_token_counts": op6_token_counts,
    "op7_quality_rules": op7_quality_rules,
    "op8_warc": op8_warc,
    "op9_mixing": op9_mixing,
    "op10_fingerprints": op10_fingerprints,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_bpe": op12_bpe,
    "op13_infill": op13_infill,
}

ORACLES: dict[str, str] = {
    "op1_suffix_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
        blocks AS (
            SELECT doc_id, 1000 * k AS base, substr(h, 2000 * k + 1, 2098) AS p
            FROM (SELECT doc_id, h, unnest(range(0, (len(h) // 2 - 50) // 1000 + 1)) AS k FROM d WHERE len(h) >= 100)),
        w AS (SELECT doc_id, base + i AS i, substr(p, 2 * i + 1, 100) AS s FROM (SELECT *, unnest(range(0, least(1000, len(p) // 2 - 49))) AS i FROM blocks)),
        f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
        c AS (SELECT DISTINCT doc_id, i FROM w JOIN f USING (s) WHERE first < doc_id),
        n AS (SELECT doc_id, i, (i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, -1))::INT AS new FROM c),
        g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n),
        r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, run),
        k AS (
            SELECT doc_id, b AS x, lead(a) OVER (PARTITION BY doc_id ORDER BY b) AS y FROM (SELECT doc_id, a, b FROM r UNION ALL SELECT doc_id, -1, 0 FROM d)),
        e AS (
            SELECT doc_id, string_agg(substr(h, 2 * x + 1, 2 * (coalesce(y, len(h) // 2) - x)), '' ORDER BY x) AS kept
            FROM k JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
            sha256(unhex(kept)) AS kept_sha256, md5(text) AS text_md5
        FROM d JOIN e USING (doc_id) LEFT JOIN (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id) s USING (doc_id)""",
    "op3_ngram_join": r"""
        WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 10 * c >= 8 * (x.n + y.n - c)),
        reach AS (SELECT doc_id AS node, doc_id AS root FROM words UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
        degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT node AS doc_id, min(root) AS class_id, coalesce(any_value(n), 0)::BIGINT AS n_links
        FROM reach LEFT JOIN degrees ON a = node GROUP BY node""",
    "op4_sharding": """
        WITH RECURSIVE jump AS (
            SELECT d.doc_id, s.shards, -1::BIGINT AS shard, 0::BIGINT AS ahead,
                CASE WHEN d.doc_id < 0 THEN d.doc_id::HUGEINT + 18446744073709551616 ELSE d.doc_id END::UHUGEINT AS state
            FROM (SELECT DISTINCT coalesce(doc_id, -1) AS doc_id FROM documents) d, (VALUES (8), (9)) s(shards)
            UNION ALL
            SELECT doc_id, shards, ahead, floor((ahead + 1) * (2147483648.0::DOUBLE / (turned // 8589934592 + 1)::DOUBLE))::BIGINT, turned
            FROM (SELECT *, (state * 2862933555777941757 + 1) % 18446744073709551616 AS turned FROM jump WHERE ahead < shards)),
        dealt AS (
            SELECT doc_id, max(shard) FILTER (shards = 8) AS shard, max(shard) FILTER (shards = 9) AS grown
            FROM jump WHERE ahead >= shards GROUP BY doc_id),
        step AS (
            SELECT n AS i, n AS c, 0 AS k FROM range(256) t(n)
            UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
        tab AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
        bytes AS (SELECT *, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents)
        SELECT d.doc_id, strlen(coalesce(text, '')) + 1 AS size, 'key' AS law, shard::INT AS shard, grown::INT AS grown_shard,
            row_number() OVER (PARTITION BY shard ORDER BY d.doc_id NULLS FIRST) - 1 AS slot,
            xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32
        FROM bytes d JOIN dealt x ON x.doc_id = coalesce(d.doc_id, -1), tab""",
    "op5_perspectives": r"""
        WITH m AS (SELECT conv_id, turn, role, replace(coalesce(text, ''), '<|', '< |') AS text,
            (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1) // 256 AS part FROM conversations),
        p AS (SELECT DISTINCT conv_id, role AS perspective FROM m WHERE role IS NOT NULL AND role <> 'system'),
        h AS (
            SELECT m.*, perspective, role IS NOT DISTINCT FROM perspective AS mine,
                CASE WHEN role IS NULL THEN '<|user|>' WHEN role = 'system' THEN '<|system|>' WHEN role = perspective THEN '<|assistant|>'
                    ELSE '<|user name=' || translate(replace(replace(role, '<|', '< |'), '|>', '| >'), chr(13) || chr(10), '  ') || '|>' END || chr(10) AS head
            FROM m JOIN p ON m.conv_id IS NOT DISTINCT FROM p.conv_id),
        t AS (SELECT *, head || text || '<|end|>' || chr(10) AS shown FROM h),
        w AS (SELECT *, (sum(length(shown)) OVER (PARTITION BY conv_id, perspective, part ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))::BIGINT AS stop FROM t),
        g AS (
            SELECT conv_id, perspective, part, count(*) AS n_messages, string_agg(shown, '' ORDER BY turn, role, text) AS text,
                coalesce(string_agg((stop - length(shown) + length(head))::VARCHAR || '-' || stop::VARCHAR, ',' ORDER BY stop) FILTER (mine), '') AS masks
            FROM w GROUP BY ALL)
        SELECT *, (coalesce(sum(length(text)) OVER (PARTITION BY conv_id, perspective ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset" FROM g""",
    "op8_warc": """
        WITH own AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html) AS payload_bytes, upper(sha1(html)) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM own)
        SELECT page_id, payload_bytes,
            translate(list_aggregate(list_transform(range(0, 8), lambda k: to_base(('0x' || hex[k * 5 + 1 : k * 5 + 5])::BIGINT, 32, 4)), 'string_agg', ''),
                '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
            CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
        FROM d""",
    "op11_periodic_runs": r"""
        WITH RECURSIVE step AS (
            SELECT n AS i, n AS c, 0 AS k FROM range(256) t(n)
            UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
        tab AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
        d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(coalesce(doc_id::VARCHAR, ''), '.'), lambda x: ascii(x)::BIGINT)),
                    lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS h
            FROM documents, tab),
        cut AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
        v AS MATERIALIZED (
            SELECT doc_id, n, CASE WHEN a IS NULL THEN w
                ELSE list_transform(range(0, n), lambda i: w[(CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END) + 1]) END AS v
            FROM cut),
        q AS (SELECT doc_id, n, v, unnest(range(1, n // 4 + 1)) AS q FROM v),
        c AS MATERIALIZED (
            SELECT DISTINCT doc_id, q
            FROM (SELECT *, unnest(range(0, n - 3 * q, q)) AS x FROM q) WHERE v[x + 1] = v[x + q + 1] AND v[x + 1] = v[x + 2 * q + 1] AND v[x + 1] = v[x + 3 * q + 1]),
        m AS (SELECT doc_id, q, i FROM (SELECT c.doc_id, q, v, unnest(range(0, n - q)) AS i FROM c JOIN v USING (doc_id)) WHERE v[i + 1] = v[i + q + 1]),
        s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m),
        r AS MATERIALIZED (
            SELECT doc_id, start, length, min(q) AS period
            FROM (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY doc_id, q, island) WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
        gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
        own AS (SELECT doc_id, unnest(v) AS word, unnest(range(0, n)) AS i FROM v),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM own ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
        best AS (SELECT doc_id, arg_max(struct_pack(start, length, period), (length, -start, -period)) AS b, count(*) AS n_runs,
            string_agg(start::VARCHAR || ',' || length::VARCHAR || ',' || period::VARCHAR || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id)
        SELECT v.doc_id, coalesce(n_runs, 0) AS n_runs, b.start AS start, b.length AS length, b.period AS period, 1000 * b.length // b.period AS exponent_milli,
            sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
        FROM v LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op13_infill": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
                sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        k AS (
            SELECT doc_id, t, u, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS y,
                CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 THEN 'plain'
                    WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
        p AS (
            SELECT doc_id, t, n, form, array_to_string(u[1 : least(x, y)], '') AS pre, array_to_string(u[least(x, y) + 1 : greatest(x, y)], '') AS mid,
                array_to_string(u[greatest(x, y) + 1 : n], '') AS suf FROM k)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
            sha256(t) AS restored_sha256
        FROM p""",
}
