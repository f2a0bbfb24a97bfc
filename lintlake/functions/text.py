"""Text expressions: masking, bounds, lines, paths and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintlake.functions import values as V

LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mask_steps(text: Column | str) -> list[tuple[str, Column, Column]]:
    """(rule, text the rule sees, text after it) for the three masks in order."""
    raw = col(text)
    after_assignment = F.regexp_replace(raw, V.MASK_ASSIGNMENT, f"$1$2{V.CREDENTIAL_MASK}$2")
    after_token = F.regexp_replace(after_assignment, V.MASK_TOKEN, V.CREDENTIAL_MASK)
    after_key = F.regexp_replace(after_token, V.MASK_PRIVATE_KEY, V.PRIVATE_KEY_MASK)
    return [
        ("assignment", raw, after_assignment),
        ("token", after_assignment, after_token),
        ("private_key", after_token, after_key),
    ]


def may_need_mask(text: Column) -> Column:
    """A cheap necessary condition for any of the masks."""
    maybe = text.contains("=") & (text.contains('"') | text.contains("'"))
    for part in (*V.TOKEN_PARTS, V.PRIVATE_KEY_PART):
        maybe = maybe | text.contains(part)
    return maybe


def redact(text: Column | str) -> Column:
    """Mask credentials; null stays null. Most texts are settled by plain searches."""
    return F.when(may_need_mask(col(text)), mask_steps(text)[-1][2]).otherwise(col(text))


def bound(text: Column | str, chars: int) -> Column:
    """Cut to ``chars`` code points, then mask; an empty result becomes null."""
    return F.nullif(redact(F.substring(col(text), 1, chars)), F.lit(""))


def source_text(content: Column | str) -> Column:
    """Bytes to text with U+FFFD for what is not UTF-8."""
    return F.make_valid_utf8(col(content).cast("string"))


def lines(text: Column | str) -> Column:
    """Lines of a text; a final line break does not open another line."""
    text = col(text)
    whole = F.regexp_replace(text, f"(?:{LINE_BREAK})\\z", "")
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(whole, LINE_BREAK, -1))


def snippet(all_lines: Column | str, line: Column | str, radius: int = V.SNIPPET_RADIUS) -> Column:
    """Numbered lines around ``line``, masked; null line gives null."""
    all_lines, line = col(all_lines), col(line)
    start = F.greatest(F.lit(1), line - radius)
    count = F.greatest(F.lit(0), F.least(F.size(all_lines), line + radius) - start + 1)
    part = F.slice(all_lines, start, count)
    shown = F.transform(
        part,
        lambda text, i: F.format_string("%4d | %s", start + i, F.substring(text, 1, V.SNIPPET_LINE_CHARS)),
    )
    return F.when(line.isNotNull(), redact(F.array_join(shown, "\n")))


def path_parts(path: Column | str) -> Column:
    return F.split(col(path), "/")


def walk_key(path: Column | str) -> Column:
    """Sort key of a file in a depth-first walk: a directory's files, then its subdirectories."""
    parts = path_parts(path)
    last = F.size(parts) - 1
    return F.transform(parts, lambda x, i: F.concat(F.when(i == last, "0").otherwise("1"), x))


def directory_keys(path: Column | str) -> Column:
    """Walk keys of every directory above a file, the root first."""
    parts = path_parts(path)
    named = F.transform(parts, lambda x: F.concat(F.lit("1"), x))
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.slice(named, F.lit(1), n))


def ignored(path: Column | str) -> Column:
    """True when a directory of the path is one that is never entered."""
    parts = path_parts(path)
    return F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: x.isin(*V.IGNORED_DIRECTORIES))


def file_name(path: Column | str) -> Column:
    return F.element_at(path_parts(path), -1)


def casefold(text: Column | str) -> Column:
    """Full case folding, from the mappings to upper and lower case.

    Lower, upper and lower again brings together what any of them does; the
    final sigma is no letter of its own, the dotless i is. The steps between
    them keep the optimiser from taking a lower of an upper for a lower.
    """
    low = F.translate(F.lower(col(text)), "\u0131", "\ue000")
    high = F.translate(F.upper(low), "\ue000", "\ue000")
    return F.translate(F.lower(high), "\u03c2\ue000", "\u03c3\u0131")


def hashed(*parts: Column) -> Column:
    """SHA-256 of the parts written as a JSON array."""
    return F.sha2(F.to_json(F.array(*parts), {"ignoreNullFields": "false"}), 256)


def severity_rank(severity: Column | str, unknown: int = 9) -> Column:
    """0 for critical to 4 for info."""
    severity = col(severity)
    rank = F.lit(unknown)
    for i, name in reversed(list(enumerate(V.SEVERITIES))):
        rank = F.when(severity == name, i).otherwise(rank)
    return rank
