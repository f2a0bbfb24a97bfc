"""Operator 3: join of near copies by the Jaccard likeness of their word n-grams, through a MinHash LSH forest."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import WordHashes, classes, in_chunks, lean, parts
from lintlake.session import materialize

#: Shingle hashes that one comparison task holds at once, and per part of a large candidate set.
TASK_SHINGLES = 1 << 20
BLOCK_SHINGLES = 1 << 18
#: Bytes of a label for each MinHash value.
STEP = 2
#: Sets up to this size have a depth of their own.
SMALL_SET = 64


class Forest(NamedTuple):
    """Prefix tries of MinHash labels.

    A set has in each of ``trees`` a label of ``max_depth`` values. Two sets of
    likeness s share the first d values of some label with probability
    1 - (1 - s^d)^trees, so a prefix is long enough as long as this is
    ``recall`` or more for all partners that a set may have.
    """

    trees: int = 20
    max_depth: int = 8
    recall: float = 0.999

    def depth(self, likeness: float) -> int:
        """The longest prefix by which partners of this likeness are found."""
        for d in range(self.max_depth, 0, -1):
            if 1 - (1 - likeness**d) ** self.trees >= self.recall:
                return d
        raise ValueError("too few trees for this recall")

    def depths(self, threshold: float) -> list[int]:
        """The same by the size of a set, from 1 to ``SMALL_SET``: a small set has few likenesses at or above the threshold.

        The depth of a set that can have no partner but equal ones is above all others.
        """
        least = Fraction(threshold).limit_denominator(1_000_000)
        out = []
        for n in range(1, SMALL_SET + 1):
            shared = [Fraction(c, n + m - c) for m in range(1, 2 * n + 2) for c in range(1, min(n, m) + 1) if not c == n == m]
            near = [x for x in shared if x >= least]
            out.append(self.depth(float(min(near))) if near and n < SMALL_SET else self.depth(threshold) if n == SMALL_SET else self.max_depth + 1)
        return out


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(rows: DataFrame, width: int, forest: Forest) -> DataFrame:
    """(row, doc_id, set_key, n, labels) of every row(row, doc_id, text) that has a word.

    ``set_key`` names the set of shingles, ``n`` is its size, ``labels`` are its
    labels in all trees, one behind the other. One pass, no shuffle.
    """
    count = forest.trees * forest.max_depth

    @lean
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, factors = WordHashes(), _multipliers(count)
        for frame in frames:
            texts = [bytes(t) for t in frame["text"]]
            for lo, hi in in_chunks(texts, 1 << 18):
                shingles, n = hasher.shingles(texts[lo:hi], width)
                worded = frame.iloc[lo:hi][n > 0]
                n = n[n > 0]
                if not len(n):
                    continue
                starts = np.cumsum(n) - n
                low = np.empty((count, len(n)), np.uint64)
                for k in range(count):
                    low[k] = np.minimum.reduceat((shingles * factors[k]) ^ (shingles >> np.uint64(32)), starts)
                low = (low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
                labels = low.T.astype(">u2")
                sets = [np.unique(shingles[s : s + m]) for s, m in zip(starts.tolist(), n.tolist())]
                yield pd.DataFrame({
                    "row": worded["row"], "doc_id": worded["doc_id"], "set_key": [_set_key(s) for s in sets], "n": [len(s) for s in sets],
                    "labels": [row.tobytes() for row in labels],
                })

    return rows.mapInPandas(run, "row string, doc_id long, set_key string, n long, labels binary")


def _set_key(values: np.ndarray) -> str:
    """128 bits of a set of hashes."""
    a = (values * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (values >> np.uint64(29))
    b = (values ^ (values >> np.uint64(31))) * np.uint64(0x165667B19E3779F9)
    return f"{int((a * a ^ a).sum(dtype=np.uint64)):016x}{int((b ^ (b >> np.uint64(27))).sum(dtype=np.uint64)):016x}"


def _shingle_sets(width: int):
    @lean
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHashes()
        for frame in frames:
            texts = [bytes(t) for t in frame["text"]]
            for lo, hi in in_chunks(texts, 1 << 18):
                shingles, n = hasher.shingles(texts[lo:hi], width)
                sets = [np.unique(x) for x in np.split(shingles, np.cumsum(n)[:-1])]
                yield frame.iloc[lo:hi].drop(columns="text").assign(shingles=[x.tobytes() for x in sets])

    return run


def _links(a: list[np.ndarray], both: np.ndarray, threshold: float, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each row, the sets that are at least ``threshold`` alike, among the candidates ``both[row]``."""
    size = np.array([len(x) for x in a])
    words, ids = np.unique(np.concatenate(a), return_inverse=True)
    start = np.cumsum(size) - size
    mark = np.zeros(len(words), np.int32)
    for i in rows.tolist():
        near = both[i] & (np.minimum(size, size[i]) >= threshold * np.maximum(size, size[i]) - 1e-9)
        others = np.flatnonzero(near)
        if not len(others):
            continue
        own = ids[start[i] : start[i] + size[i]]
        mark[own] = 1
        if len(others) * 4 > len(a):
            common = np.add.reduceat(mark[ids], start)[others]
        else:
            common = np.array([mark[ids[start[j] : start[j] + size[j]]].sum() for j in others.tolist()])
        mark[own] = 0
        # common / union >= threshold, in whole numbers of millionths
        union = size[i] + size[others] - common
        yield i, others[common * 1_000_000 >= round(threshold * 1_000_000) * union]


def _compare(threshold: float, trees: int, size: int, floor: int):
    """Verified links inside each pair of blocks: (a, b) edges of a forest, and links of each set.

    A pair is a candidate if its labels share ``floor`` values in some tree and
    its sides have not been in one part before.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        nodes, links, roots = [], [], []
        for (_, one, two), part in frame.groupby(["part", "one", "two"], sort=False):
            if len(part) < 2:
                continue
            sets = [np.frombuffer(x, "<u8") for x in part["shingles"]]
            node, copies, block, label = (part[c].to_numpy() for c in ("node", "copies", "block", "label"))
            values = np.frombuffer(b"".join(part["labels"]), ">u2").reshape(len(part), trees, size)[:, :, :floor]
            both = np.zeros((len(part), len(part)), bool)
            for tree in range(trees):
                _, prefix = np.unique(values[:, tree], axis=0, return_inverse=True)
                both |= prefix.reshape(-1, 1) == prefix.reshape(1, -1)
            both &= label[:, None] != label[None, :]
            if one != two:  # pairs inside a block are compared where the block meets itself
                both &= block[:, None] != block[None, :]
            total, root = np.zeros(len(part), np.int64), np.arange(len(part))
            for i, others in _links(sets, both, threshold, np.arange(len(part))):
                if len(others):
                    total[i] = copies[others].sum()
                    low = min(root[i], root[others].min())
                    joined = np.unique(np.append(root[others], root[i]))
                    root[np.isin(root, joined)] = low
            found = total > 0
            nodes.append(node[found])
            links.append(total[found])
            roots.append(node[root[found]])
        if not nodes:
            return pd.DataFrame({"node": [], "links": [], "root": []})
        return pd.DataFrame({"node": np.concatenate(nodes), "links": np.concatenate(links), "root": np.concatenate(roots)})

    return run


def _under(nodes: DataFrame, forest: Forest, depth: int) -> DataFrame:
    """(node, label, tree, prefix) of every node: the hash of the first ``depth`` values in each trie."""
    size = STEP * forest.max_depth
    tries = [F.struct(F.lit(t).cast("byte").alias("tree"), F.xxhash64(F.substring("labels", size * t + 1, STEP * depth)).alias("prefix")) for t in range(forest.trees)]
    return nodes.select("node", "label", F.explode(F.array(*tries)).alias("at")).select("node", "label", "at.tree", "at.prefix")


def _verified(members: DataFrame, sets: DataFrame, threshold: float, forest: Forest, floor: int) -> DataFrame:
    """(node, links, root): links between the labels that have met in a part, as counts and a forest."""
    blocks = members.groupBy("part").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / 2000)).cast("int").alias("blocks"))
    members = materialize(members.join(blocks, "part").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "members")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    units = members.withColumn("other", other).select("*", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    tasks = parts(members, F.col("n") * F.col("blocks"), TASK_SHINGLES)
    units = units.withColumn("task", F.pmod(F.xxhash64("part", "one", "two"), F.lit(tasks))).drop("other", "blocks", "n")
    compared = units.join(sets, "node").groupBy("task").applyInPandas(
        _compare(threshold, forest.trees, forest.max_depth, floor), "node long, links long, root long"
    )
    return materialize(compared, "links")


def near_rows(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 5, threshold: float = 0.8, forest: Forest = Forest()) -> DataFrame:
    """One row for each different row of the documents: row, doc_id, class, class_id, n_links.

    ``row`` names the id and the text (see ``row_name``). Two texts are linked if the Jaccard
    likeness of their sets of runs of ``width`` words is ``threshold`` or more;
    a text with fewer words has one run of all of them. ``class`` is a name of
    all that links connect, null for a text without words; ``class_id`` its
    smallest id. ``n_links`` counts the linked rows, copies too.

    Rows with equal sets are one node from the start. A node has a label in
    each trie of the forest; nodes under one prefix have met. Prefixes are
    matched at full length first, and shortened a value at a time for the
    nodes whose prefixes are still too long for the recall; nodes that stay
    alone under the shortest prefix they may need are left out at once. What has
    met at one length is a part, and only parts that a shorter prefix joins are
    compared again, across what it has joined. Candidates are verified on whole
    sets of 64-bit shingle hashes. A large part is dealt in blocks, each pair
    of blocks one unit of work that gives a count for each node and a forest
    of links, never the pairs themselves.
    """
    picked = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = picked.select(row_name("doc_id", "text").alias("row"), "doc_id", F.col("text").cast("binary").alias("text"))
    signed = signatures(rows, width, forest).dropDuplicates(["row"])
    signed = materialize(signed, "signatures")
    nodes = signed.groupBy("set_key").agg(F.min("row").alias("row"), F.count("*").alias("copies"), F.min("n").alias("n"), F.min("labels").alias("labels"))
    need = F.element_at(F.array(*map(F.lit, forest.depths(threshold))), F.least("n", F.lit(SMALL_SET)).cast("int"))
    nodes = nodes.withColumns({"node": F.monotonically_increasing_id(), "need": need})
    nodes = materialize(nodes.withColumn("label", F.col("node")), "nodes")

    floor = min(forest.depths(threshold))
    wanted = nodes.where(F.col("need") <= forest.max_depth)
    under = _under(wanted, forest, floor)
    shared = under.groupBy("tree", "prefix").agg(F.count("*").alias("k")).where("k > 1").drop("k")
    partnered = under.join(shared, ["tree", "prefix"]).select("node").distinct()
    active = materialize(wanted.join(partnered, "node", "left_semi").select("node", "row", "copies", "n", "labels", "need", "label"), "active")
    sets = rows.join(active.select("row", "node"), "row").select("node", "text").mapInPandas(_shingle_sets(width), "node long, shingles binary")
    sets = materialize(sets.dropDuplicates(["node"]), "sets")

    links = []
    for depth in range(forest.max_depth, floor - 1, -1):
        under = _under(active.where(F.col("need") <= depth), forest, depth)
        meets = under.groupBy("tree", "prefix").agg(F.min("label").alias("head"), F.max("label").alias("last")).where("head <> last").drop("last")
        ties = under.join(meets, ["tree", "prefix"]).where("label <> head").select(F.col("label").alias("a"), F.col("head").alias("b")).distinct()
        ties = materialize(ties, "ties")
        if ties.isEmpty():
            continue
        joined = classes(ties).withColumnsRenamed({"node": "label", "class_id": "part"})
        members = active.join(joined, "label").select("node", "label", "part", "copies", "n", "labels")
        links.append(_verified(members, sets, threshold, forest, floor))
        active = active.join(joined, "label", "left").withColumn("label", F.coalesce("part", "label")).drop("part")
        active = materialize(active, "active")

    empty = nodes.where("false").select("node", F.lit(0).cast("long").alias("links"), F.col("node").alias("root"))
    found = reduce(DataFrame.unionByName, links, empty)
    joined = classes(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("set_key", "node", "copies").join(joined, "node", "left").join(linked, "node", "left")
    named = named.select("set_key", F.coalesce("class_id", "node").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    known = materialize(signed.select("row", "doc_id", "set_key").join(named, "set_key").drop("set_key"), "classes")
    first = known.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    known = known.join(first, "class").drop("doc_id")
    every = rows.select("row", "doc_id").dropDuplicates(["row"]).join(known, "row", "left")
    return every.select("row", "doc_id", "class", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def row_name(doc_id: str, text: str) -> Column:
    """One name for rows that are equal in id and text; null texts count as empty."""
    return F.concat_ws("/", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def ngram_join(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 5, threshold: float = 0.8, forest: Forest = Forest()) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, from ``near_rows``.

    ``n_links`` counts the linked documents, copies too; ``class_id`` is the
    smallest doc_id that links lead to. Candidates come from the forest, so a
    pair at the threshold itself is missed once in a thousand (by default).
    Null, empty and blank texts have no links and are classes of their own.
    Repeated rows count once. Of an id with different texts the links add up and
    the smallest class counts. Null ids are left out here, as they name no
    document; ``near_rows`` compares them as well. An empty table gives an
    empty result. Only the two named columns are read.
    """
    found = near_rows(docs.where(F.col(id_column).isNotNull()), id_column, text, width, threshold, forest)
    return found.groupBy("doc_id").agg(F.min(F.coalesce("class_id", "doc_id")).alias("class_id"), F.sum("n_links").cast("long").alias("n_links"))
