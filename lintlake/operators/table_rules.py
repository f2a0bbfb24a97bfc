"""Own rules as table functions that SQL can call over fact rows (section 2.13)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import StructType

from lintlake import schemas

COLUMNS = [part.split(" ")[0] for part in schemas.FINDINGS.split(", ")]


class TableRule:
    """A rule that sees the fact rows of a partition one after the other.

    A subclass names the columns it ``needs`` and its ``category``, ``severity``
    and ``rule_id``, and overrides ``see``, which returns the texts of a finding
    at the row or None. A rule keeps what it has to remember in itself; there
    is one instance for each partition. SQL calls it as ``SELECT * FROM
    name(TABLE(facts) PARTITION BY ... ORDER BY ..., setting => value)`` and
    gets rows of the findings schema.
    """

    needs: tuple[str, ...] = ("snapshot_id", "path", "line")
    category, severity, rule_id = "style", "info", "custom.rule"
    settings: dict[str, int] = {}

    def see(self, row: Row, **settings) -> dict | None:
        raise NotImplementedError


def table_function(rule: type[TableRule]):
    """The table function of a rule; its schema is that of findings, and missing columns are told when the query is planned."""

    schema = StructType.fromDDL(schemas.FINDINGS)

    class Function:
        @staticmethod
        def analyze(facts: AnalyzeArgument, **settings: AnalyzeArgument) -> AnalyzeResult:
            if not facts.isTable:
                raise ValueError(f"{rule.rule_id} reads a table: TABLE(facts) PARTITION BY ... ORDER BY ...")
            given = {f.name for f in facts.dataType.fields}
            if missing := [c for c in (*TableRule.needs, *rule.needs) if c not in given]:
                raise ValueError(f"{rule.rule_id} needs the columns {', '.join(missing)}")
            if unknown := [s for s in settings if s not in rule.settings]:
                raise ValueError(f"{rule.rule_id} has no setting {', '.join(unknown)}")
            return AnalyzeResult(schema=schema)

        def __init__(self) -> None:
            self.rule = rule()

        def eval(self, facts: Row, **settings) -> Iterator[tuple]:
            found = self.rule.see(facts, **{**rule.settings, **settings})
            if found is None:
                return
            known = facts.asDict()
            shown = {
                **{c: known[c] for c in ("line", "col", "scope", "anchor", "snippet") if c in known}, "scan_id": known["snapshot_id"], "file_path": known["path"],
                "category": rule.category, "severity": rule.severity, "rule_id": rule.rule_id, **found,
            }
            yield tuple(shown.get(c) for c in COLUMNS)

    return udtf(Function)


def register(spark: SparkSession, name: str, rule: type[TableRule]) -> None:
    """Makes ``name`` known to SQL in this session."""
    spark.udtf.register(name, table_function(rule))


class RepeatedCalls(TableRule):
    """Calls of one function after the first ``allowed`` ones of a partition."""

    needs = ("qualified_name",)
    rule_id = "custom.repeated-call"
    settings = {"allowed": 1}

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def see(self, row: Row, allowed: int) -> dict | None:
        name = row["qualified_name"]
        if name is None:
            return None
        self.seen[name] = self.seen.get(name, 0) + 1
        if self.seen[name] <= allowed:
            return None
        return {"title": f"Repeated call of {name}", "message": f"Call number {self.seen[name]}.", "fix_suggestion": "Call it in one place."}
