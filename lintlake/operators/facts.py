"""Fact tables: one parse per file, then projections of its nested row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lintlake import schemas
from lintlake.functions import values as V
from lintlake.functions.syntax import Watch, file_facts
from lintlake.session import materialize

DEFAULT_WATCH = Watch(
    modules=frozenset({"pickle", "_pickle", "yaml"}),
    builtins=frozenset({"eval", "exec"}),
    assigned=V.CREDENTIAL_NAME,
    complexity=V.COMPLEXITY_MEDIUM,
    positional=V.POSITIONAL_LIMIT,
)

#: Facts of another version are not taken from a store.
PARSER_VERSION = 1
KNOWN_FACTS = schemas.FILE_FACTS.removeprefix("snapshot_id BIGINT, path STRING, ")
FACT_COLUMNS = ("binds", "calls", "strings", "functions", "open_definitions", "exits", "tests", "uses")


def _shaped(kind: pa.DataType, value: object) -> object:
    """Tuples as the structs that a type asks for, at any depth."""
    if value is None:
        return None
    if pa.types.is_list(kind):
        inner = kind.value_type
        return value if not pa.types.is_nested(inner) else [_shaped(inner, v) for v in value]
    return {f.name: _shaped(f.type, v) if pa.types.is_nested(f.type) else v for f, v in zip(kind, value)} if pa.types.is_struct(kind) else value


def extract_facts(files: DataFrame, watch: Watch = DEFAULT_WATCH, wanted: tuple[str, ...] = FACT_COLUMNS) -> DataFrame:
    """Parse ``files(snapshot_id, path, source[, problem])`` once; one nested row per file.

    Map-only: the source text is read by the task that parses it and is never
    shuffled. A file that cannot be parsed, or comes with a ``problem`` instead
    of a source, becomes a row with ``ok = false``. Facts that are not
    ``wanted`` stay empty.
    """
    schema = StructType.fromDDL(schemas.FILE_FACTS)
    arrow = to_arrow_schema(schema, prefers_large_types=False)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for snapshot, path, source, problem in zip(*(batch.column(i).to_pylist() for i in range(4))):
                facts, error = {}, problem
                if problem is None:
                    try:
                        facts = file_facts(source, watch)
                    except Exception as exc:  # one bad file must not fail its task
                        error = type(exc).__name__
                nested = (_shaped(arrow.field(c).type, facts.get(c, []) if c in wanted else []) for c in FACT_COLUMNS)
                rows.append((snapshot, path, error is None, error, *nested))
            columns = zip(*rows) if rows else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, arrow)], schema=arrow)

    problem = F.col("problem") if "problem" in files.columns else F.lit(None).cast("string")
    missing = F.coalesce(problem, F.when(F.col("source").isNull(), "unreadable"))
    return files.select("snapshot_id", "path", "source", missing.alias("problem")).mapInArrow(parse, schema)


def content_facts(files: DataFrame, folder: str, watch: Watch = DEFAULT_WATCH) -> tuple[DataFrame, DataFrame]:
    """(facts, parsed): the facts of ``files(snapshot_id, path, source[, problem])`` by their content, and what had to be parsed.

    Facts depend on nothing but the source and the watch list, so those of
    earlier scans lie in ``folder`` by a digest of both. Of contents that are
    not there yet one file each is parsed and its facts are added; all others,
    copies in one snapshot too, take them by a join of digests. Sources are
    hashed where they are read, and only those to be parsed travel further.
    A repeated batch adds the same facts again, which changes nothing.
    """
    problem = F.col("problem") if "problem" in files.columns else F.lit(None).cast("string")
    made = hashlib.sha256(repr((PARSER_VERSION, [sorted(v) if isinstance(v, frozenset) else v for v in watch])).encode()).hexdigest()
    digest = F.sha2(F.concat_ws("|", F.lit(made), F.coalesce(problem, F.lit("")), F.coalesce("source", F.lit("-"))), 256)
    hashed = files.withColumn("digest", digest)
    places = materialize(hashed.select("snapshot_id", "path", "digest"), "places")
    try:
        known = files.sparkSession.read.schema(f"digest string, {KNOWN_FACTS}").parquet(f"{folder}/facts").dropDuplicates(["digest"])
        missing = places.join(known.select("digest"), "digest", "left_anti")
    except AnalysisException:  # the first scan
        known, missing = None, places
    todo = missing.groupBy("digest").agg(F.min(F.struct("snapshot_id", "path")).alias("at")).select("digest", "at.*")
    todo = materialize(todo, "unknown")
    picked = files.join(todo.drop("digest"), ["snapshot_id", "path"], "left_semi")
    fresh = materialize(extract_facts(picked, watch).join(todo, ["snapshot_id", "path"]).drop("snapshot_id", "path"), "fresh")
    if not todo.isEmpty():
        fresh.write.mode("append").parquet(f"{folder}/facts")
    every = fresh if known is None else known.unionByName(fresh)
    columns = [f.name for f in StructType.fromDDL(schemas.FILE_FACTS).fields]
    return places.join(every, "digest").select(*columns), todo.select("snapshot_id", "path")


def parse_status(facts: DataFrame) -> DataFrame:
    """which files could be parsed, and why not."""
    return facts.select("snapshot_id", "path", "ok", "error")


def _resolve(name: Column, visible: Column) -> Column:
    """Full name a dotted reference stands for, given the file's bindings.

    The innermost visible scope that binds the first part decides. A name
    bound twice there, or bound to anything but an import, is unknown. An
    unbound ``eval`` or ``exec`` is the builtin.
    """
    root = F.substring_index(name, ".", 1)
    tail = F.substr(name, F.length(root) + 1)
    named = F.filter("binds", lambda b: b["name"] == root)
    owner = F.get(F.filter(visible, lambda scope: F.exists(named, lambda b: b["scope_id"] == scope)), F.lit(0))
    hits = F.filter(named, lambda b: b["scope_id"] == owner)
    bound = F.when(F.size(hits) == 1, F.get(hits, F.lit(0))["target"])
    builtin = F.when(root.isin("eval", "exec"), F.concat(F.lit("builtins."), root))
    return F.when(owner.isNotNull(), F.concat(bound, tail)).otherwise(F.concat(builtin, tail))


def calls(facts: DataFrame) -> DataFrame:
    """watched calls with the full names they resolve to.

    Bindings and calls of a file sit in the same row, so resolution is a
    higher-order expression and needs no join. It happens before the calls are
    exploded, so that filters on a name do not resolve it again.
    """
    def argument(call: Column, position: int) -> Column:
        return F.get(F.filter(call["given"], lambda a: a["position"] == position), F.lit(0))

    def loader(call: Column) -> Column:
        named = F.filter(call["given"], lambda a: a["keyword"] == "Loader")
        return F.when(F.size(named) > 0, F.get(named, F.lit(0))["name"]).otherwise(argument(call, 1)["name"])

    resolved = F.transform(
        "calls",
        lambda call: F.struct(
            call["line"].alias("line"), call["col"].alias("col"),
            _resolve(call["func"], call["visible"]).alias("qualified_name"),
            F.coalesce(argument(call, 0)["kind"], F.lit("none")).alias("arg0_kind"),
            _resolve(argument(call, 0)["call"], call["visible"]).alias("arg0_call_name"),
            _resolve(loader(call), call["visible"]).alias("loader_name"),
            call["n_args"].alias("n_args"), call["scope"].alias("scope"),
            call["anchor"].alias("anchor"), call["snippet"].alias("snippet"),
        ),
    )
    return facts.select("snapshot_id", "path", F.explode(resolved).alias("f")).select("snapshot_id", "path", "f.*")


def _exploded(facts: DataFrame, column: str) -> DataFrame:
    return facts.select("snapshot_id", "path", F.explode(column).alias("f")).select("snapshot_id", "path", "f.*")


def string_assigns(facts: DataFrame) -> DataFrame:
    """string constants assigned to watched names or attributes."""
    return _exploded(facts, "strings")


def functions(facts: DataFrame) -> DataFrame:
    """every function with its parameter count and complexity.

    A receiver of a method does not count as a parameter. Complexity is one and
    a step for each branch, but none for the case that catches all.
    """
    receiver = F.col("is_method") & ~F.col("is_static") & (F.col("declared") > 0)
    steps = F.aggregate("branches", F.lit(1), lambda n, b: n + F.when(b["kind"] == "wildcard", -b["n"]).otherwise(b["n"]))
    return _exploded(facts, "functions").withColumns({
        "positional": F.col("declared") - F.when(receiver, 1).otherwise(0), "complexity": steps,
    }).drop("declared", "branches")


def open_definitions(facts: DataFrame) -> DataFrame:
    """imports and arguments that their own file never uses.

    A definition used in its own file cannot be unused in the snapshot, so it
    is dropped before anything is shuffled.
    """
    return _exploded(facts, "open_definitions")


def name_uses(facts: DataFrame) -> DataFrame:
    """names used per snapshot, once for each file that uses them."""
    return facts.select("snapshot_id", F.explode("uses").alias("name"))


def unreachable(facts: DataFrame) -> DataFrame:
    """code that no path reaches.

    What follows a statement is dead if each way out of the statement leaves
    the block for good. A condition that never holds is dead itself, one that
    always holds leaves its alternative dead, or is an ``if`` for nothing.
    """
    leaves = ("return", "raise", "break", "continue", "endless")
    after = F.filter("exits", lambda e: F.forall(e["ways"], lambda w: w.isin(*leaves)))
    after = F.transform(after, lambda e: F.struct(F.get(e["spots"], F.lit(0)).alias("spot"), e["kind"].alias("kind"), F.concat(F.lit("that nothing runs after this '"), e["kind"], F.lit("'")).alias("reason")))
    decided = F.filter("tests", lambda t: ~t["truth"] | (F.size(t["spots"]) > 1) | (t["form"] == "if"))

    def dead(t: Column) -> Column:
        other = t["truth"] & (F.size(t["spots"]) > 1)
        kind = F.when(other & (t["form"] != "ternary"), "else").otherwise(t["form"])
        told = F.when(~t["truth"], "that the condition of this '").when(other, "that the alternative of this '").otherwise("that the condition of this '")
        ends = F.when(~t["truth"], "' never holds").when(other, "' is never taken").otherwise("' always holds")
        return F.struct(F.get(t["spots"], F.when(other, 1).otherwise(0)).alias("spot"), kind.alias("kind"), F.concat(told, t["form"], ends).alias("reason"))

    every = F.concat(after, F.transform(decided, dead))
    return facts.select("snapshot_id", "path", F.explode(every).alias("f")).select("snapshot_id", "path", "f.spot.*", "f.kind", "f.reason")


def node_anchors(facts: DataFrame) -> DataFrame:
    """structural context of every fact that a finding may point at."""
    def places(column: str, kind: str, has_col: bool, has_anchor: bool) -> Column:
        return F.transform(
            column,
            lambda f: F.struct(
                F.lit(kind).alias("node_kind"),
                f["line"].alias("line"),
                (f["col"] if has_col else F.lit(None).cast("int")).alias("col"),
                f["scope"].alias("scope"),
                (f["anchor"] if has_anchor else F.lit("")).alias("anchor"),
            ),
        )

    every = F.concat(
        places("calls", "call", True, True),
        places("strings", "assignment", True, True),
        places("functions", "function", True, False),
        places("open_definitions", "definition", False, True),
    )
    listed = facts.select("snapshot_id", "path", F.explode(every).alias("f")).select("snapshot_id", "path", "f.*")
    dead = unreachable(facts).select("snapshot_id", "path", F.lit("unreachable").alias("node_kind"), "line", F.lit(None).cast("int").alias("col"), "scope", "anchor")
    return listed.unionByName(dead)
