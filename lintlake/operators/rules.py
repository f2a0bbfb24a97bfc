"""Rules as relational queries over the fact tables."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions import values as V
from lintlake.functions.text import file_name, path_parts
from lintlake.operators import facts as facts_
from lintlake.session import materialize

logger = logging.getLogger(__name__)

FINDING_COLUMNS = (
    "scan_id", "category", "severity", "title", "message", "file_path", "line", "col", "snippet", "fix_suggestion",
    "rule_id", "cyclomatic_complexity", "confidence", "scope", "anchor", "literal",
)
OPTIONAL = {"col": "int", "cyclomatic_complexity": "int", "confidence": "int", "literal": "string", "anchor": "string"}


def as_findings(df: DataFrame, **columns: Column) -> DataFrame:
    """Project fact rows to the findings schema; what a rule does not set is null."""
    columns = {"scan_id": F.col("snapshot_id"), "file_path": F.col("path"), **columns}
    for name in FINDING_COLUMNS:
        if name not in columns:
            columns[name] = F.lit(None).cast(OPTIONAL[name]) if name in OPTIONAL and name not in df.columns else F.col(name)
    return df.select(*(columns[name].alias(name) for name in FINDING_COLUMNS))


def _choose(column: Column, options: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, text in options.items():
        out = F.when(column == key, text).otherwise(out)
    return out


def unsafe_calls(calls: DataFrame) -> DataFrame:
    """Dynamic execution, pickle and YAML loading, in one pass over the calls."""
    name, loader = F.col("qualified_name"), F.col("loader_name")
    dynamic = name.isin("builtins.eval", "builtins.exec") & ~F.col("arg0_kind").isin("none", "constant")
    round_trip = (
        name.endswith(".loads")
        & (F.col("arg0_kind") == "call")
        & F.coalesce(F.col("arg0_call_name").isin("pickle.dumps", "_pickle.dumps"), F.lit(False))
    )
    pickled = name.isin("pickle.load", "pickle.loads", "_pickle.load", "_pickle.loads") & ~round_trip
    unsafe = name.contains("unsafe_load") | F.coalesce(
        loader.isin("yaml.Loader", "yaml.CLoader", "yaml.UnsafeLoader", "yaml.CUnsafeLoader"), F.lit(False)
    )
    safe = F.coalesce(loader.isin("yaml.SafeLoader", "yaml.CSafeLoader"), F.lit(False))
    yaml = name.isin("yaml.load", "yaml.load_all", "yaml.unsafe_load", "yaml.unsafe_load_all") & (unsafe | ~safe)
    rule = (
        F.when(dynamic, F.concat(F.lit("security."), F.element_at(F.split(name, r"\."), -1)))
        .when(pickled, "security.pickle")
        .when(yaml, "security.yaml")
    )
    hits = calls.withColumn("rule_id", rule).withColumn("unsafe", unsafe).filter(F.col("rule_id").isNotNull())
    rule = F.col("rule_id")
    return as_findings(
        hits,
        category=F.lit("security"),
        severity=F.when((rule == "security.yaml") & ~F.col("unsafe"), "medium").otherwise("high"),
        title=_choose(rule, {
            "security.eval": "Use of eval()",
            "security.exec": "Use of exec()",
            "security.pickle": "Potentially unsafe deserialization",
            "security.yaml": "Review YAML deserialization loader",
        }),
        message=F.concat(F.lit("The call resolves to "), name, _choose(rule, {
            "security.eval": " and its input is not a literal, so text from outside could run as code.",
            "security.exec": " and its input is not a literal, so text from outside could run as code.",
            "security.pickle": ", which can run code while loading. Whether the input is trusted is not known.",
            "security.yaml": " without a loader known to be restricted, so the input may build arbitrary objects.",
        })),
        fix_suggestion=_choose(rule, {
            "security.eval": "Use a dispatch table, or ast.literal_eval with a size limit for plain data.",
            "security.exec": "Use a dispatch table, or ast.literal_eval with a size limit for plain data.",
            "security.pickle": "Use JSON with a schema, or load only authenticated data from a trusted producer.",
            "security.yaml": "Use yaml.safe_load or pass SafeLoader, and validate what was read.",
        }),
    )


def credentials(strings: DataFrame) -> DataFrame:
    """Credential-like literals, lower severity in test and example code."""
    literal = F.col("literal")
    distinct = F.size(F.array_distinct(F.split(literal, "")))
    hits = strings.filter(
        (F.length(literal) >= V.CREDENTIAL_MIN_CHARS)
        & (distinct >= V.CREDENTIAL_MIN_DISTINCT)
        & ~literal.rlike(V.PLACEHOLDER)
        & ~literal.startswith("http://")
        & ~literal.startswith("https://")
        & F.exists("target_names", lambda n: n.rlike(V.CREDENTIAL_NAME))
    )
    fixture = F.exists(path_parts("path"), lambda p: F.lower(p).isin(*V.FIXTURE_DIRECTORIES)) | file_name(
        "path"
    ).startswith("test_")
    return as_findings(
        hits,
        category=F.lit("security"),
        severity=F.when(fixture, "low").otherwise("high"),
        title=F.lit("Potential hardcoded credential"),
        message=F.concat(
            F.lit("A string literal is assigned to a name that usually holds a credential; it was not verified."),
            F.when(fixture, " The file looks like test or example code.").otherwise(" Readers of the source can see it."),
        ),
        fix_suggestion=F.lit("If it is real, revoke it and load the new value from a secret store or the environment."),
        rule_id=F.lit("security.hardcoded-credential"),
    )


def complexity(functions: DataFrame) -> DataFrame:
    """Callables with many independent paths; methods of classes inside functions are not listed."""
    value, name = F.col("complexity"), F.col("qualified")
    return as_findings(
        functions.filter((value >= V.COMPLEXITY_MEDIUM) & ~F.col("in_local_class")),
        category=F.lit("complexity"),
        severity=F.when(value >= V.COMPLEXITY_HIGH, "high").otherwise("medium"),
        title=F.concat(F.lit("High cyclomatic complexity in "), name),
        message=F.concat(
            F.lit("Cyclomatic complexity is "), value.cast("string"), F.lit(" in "), name,
            F.lit(f" (review from {V.COMPLEXITY_MEDIUM})."),
        ),
        fix_suggestion=F.lit("Cover the branches with tests, then split decisions into small named functions."),
        rule_id=F.lit("complexity.cyclomatic"),
        cyclomatic_complexity=value,
        anchor=F.lit(""),
    )


def long_parameter_lists(functions: DataFrame) -> DataFrame:
    """More positional parameters than a reader can follow."""
    return as_findings(
        functions.filter(F.col("positional") > V.POSITIONAL_LIMIT),
        category=F.lit("style"),
        severity=F.lit("low"),
        title=F.concat(F.lit("Long parameter list in "), F.col("name")),
        message=F.concat(
            F.col("positional").cast("string"), F.lit(" positional parameters in "), F.col("name"),
            F.lit(f" (limit {V.POSITIONAL_LIMIT}, receivers not counted)."),
        ),
        fix_suggestion=F.lit("Make options keyword-only or group related values in one object."),
        rule_id=F.lit("style.positional-parameters"),
        anchor=F.lit(""),
    )


def _silenced(*codes: str) -> Column:
    """A ``noqa`` comment without codes silences everything, with codes only those."""
    noqa = F.col("noqa")
    listed = F.split(F.upper(noqa), r"[,\s]+")
    return F.coalesce((noqa == "") | F.arrays_overlap(listed, F.array(*map(F.lit, codes))), F.lit(False))


UNUSED = {"import": ("import", 90), "argument": ("variable", 100)}  # kind: label, confidence


def unused_definitions(definitions: DataFrame, uses: DataFrame) -> DataFrame:
    """Imports and arguments whose name nothing in the snapshot uses.

    Only names among the open definitions matter, so these are written first
    and the uses are reduced to them before they are shuffled. The unused ones
    are written too, so that a name defined very often is neither gathered in
    one task nor keeps Spark from splitting or broadcasting the last join.
    """
    codes = F.when(F.col("kind") == "import", _silenced("F401", "V104")).otherwise(_silenced("F841", "V107"))
    package = (F.col("kind") == "import") & ((file_name("path") == "__init__.py") | F.col("explicit_reexport"))
    kept = definitions.filter(~codes & ~package & ~((F.col("kind") == "argument") & F.col("name").rlike(V.UNCHECKED_ARGUMENT)))
    key = ["snapshot_id", "name"]
    open_names = materialize(kept.select(*key).distinct(), "open_names")
    used = uses.join(open_names, key, "left_semi").distinct()
    names = materialize(open_names.join(used, key, "left_anti"), "unused")
    kind, name = F.col("kind"), F.col("name")
    label = _choose(kind, {k: text for k, (text, _) in UNUSED.items()})
    confidence = F.when(kind == "import", UNUSED["import"][1]).otherwise(UNUSED["argument"][1])
    return as_findings(
        kept.join(names, key, "left_semi"),
        category=F.lit("dead_code"),
        severity=F.lit("low"),
        title=F.concat(F.lit("Potentially unused "), label, F.lit(": "), name),
        message=F.concat(
            F.lit("The "), label, F.lit(" '"), name, F.lit("' is not used anywhere in the snapshot ("),
            confidence.cast("string"), F.lit("% confidence). Dynamic use is not visible."),
        ),
        fix_suggestion=F.lit("Check dynamic consumers and public exports, then remove it or mark it as intended."),
        rule_id=F.concat(F.lit("dead-code."), label, F.lit("."), name),
        confidence=confidence,
    )


def unused_imports(definitions: DataFrame, uses: DataFrame) -> DataFrame:
    """Imported names that nothing in the snapshot uses."""
    return unused_definitions(definitions.filter(F.col("kind") == "import"), uses)


def unused_arguments(definitions: DataFrame, uses: DataFrame) -> DataFrame:
    """Argument names that nothing in the snapshot uses."""
    return unused_definitions(definitions.filter(F.col("kind") == "argument"), uses)


def unreachable_code(unreachable: DataFrame) -> DataFrame:
    """Statements and branches that cannot run."""
    return as_findings(
        unreachable.filter(~_silenced("V201")),
        category=F.lit("dead_code"),
        severity=F.lit("medium"),
        title=F.lit("Unreachable branch or statement"),
        message=F.concat(
            F.lit("The flow of the source shows "), F.col("reason"), F.lit(" (100% confidence). Statements around it may run."),
        ),
        fix_suggestion=F.lit("Check whether the exit or condition before it is intended, then remove it or fix the flow."),
        rule_id=F.concat(F.lit("dead-code.unreachable_code."), F.col("kind")),
        confidence=F.lit(100),
    )


Rule = Callable[[DataFrame], DataFrame]

RULES: dict[str, Rule] = {
    "unsafe_calls": lambda f: unsafe_calls(facts_.calls(f)),
    "credentials": lambda f: credentials(facts_.string_assigns(f)),
    "complexity": lambda f: complexity(facts_.functions(f)),
    "long_parameter_lists": lambda f: long_parameter_lists(facts_.functions(f)),
    "unused_definitions": lambda f: unused_definitions(facts_.open_definitions(f), facts_.name_uses(f)),
    "unreachable_code": lambda f: unreachable_code(facts_.unreachable(f)),
}


def plan_rules(facts: DataFrame, rules: dict[str, Rule] = RULES) -> tuple[DataFrame, list[str]]:
    """Findings of all rules, and the names of those that do not fit the facts.

    Only a rule that Spark cannot plan is left out; a failing job is an error
    of the whole run and is not hidden. ``facts`` is read once per rule, so
    pass a materialised fact table; each rule reads only its own column of it.
    """
    found, failed = None, []
    for name, rule in rules.items():
        try:
            part = rule(facts).select(*FINDING_COLUMNS)
        except AnalysisException:
            logger.warning("rule %s cannot be planned", name)
            failed.append(name)
            continue
        found = part if found is None else found.unionByName(part)
    if found is None:
        raise ValueError("no rule could be planned")
    return found, failed


def run_rules(facts: DataFrame, rules: dict[str, Rule] = RULES) -> DataFrame:
    """Findings of all rules that can be planned."""
    return plan_rules(facts, rules)[0]


def finding_guard(findings: DataFrame, limit: int = V.MAX_FINDINGS) -> DataFrame:
    """Findings per scan and whether the scan has to fail for having too many."""
    counted = findings.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n_findings"))
    return counted.withColumn("over_limit", F.col("n_findings") > limit)


def within_guard(findings: DataFrame, limit: int = V.MAX_FINDINGS) -> DataFrame:
    """Findings of scans that do not fail; a failing scan keeps none rather than some.

    The failing scans are written first, so that the join is planned knowing how few they are
    and does not gather the scan that is too large.
    """
    failed = finding_guard(findings, limit).filter("over_limit").select("scan_id")
    return findings.join(materialize(failed, "failed"), "scan_id", "left_anti")
