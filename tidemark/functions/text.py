"""Text expressions: classifiers, extraction, markup removal, normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Change types by message prefix, in order of precedence.  The
# word boundary after the bracket or colon is deliberate: "feat:x" is a feature,
# "feat: x" is not.  Pass other rules to classify() to read messages differently.
CHANGE_TYPES = [
    (r"^feat(\(|:)\b", "feature"),
    (r"^fix(\(|:)\b", "fix"),
    (r"^docs(\(|:)\b", "docs"),
    (r"^refactor(\(|:)\b", "refactor"),
    (r"^test(\(|:)\b", "test"),
    (r"^chore(\(|:)\b", "chore"),
    (r"^perf(\(|:)\b", "performance"),
    (r"^style(\(|:)\b", "style"),
    (r"^ci(\(|:)\b", "ci"),
    (r"^build(\(|:)\b", "build"),
]
REQUEST_NUMBER = r"#([0-9]+)"

# What counts as white space when text is collapsed.
WHITE_SPACE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

# Units of human-readable sizes, in steps of 1024.
BYTE_UNITS = ("Bytes", "KB", "MB", "GB", "TB")


def ascii_boundaries(pattern: str) -> str:
    r"""``\b`` as a boundary of ASCII word characters (Java's own is Unicode-aware)."""
    word = "[A-Za-z0-9_]"
    return pattern.replace(r"\b", f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))")


def classify(text: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Label of the first pattern found in the lower-cased text, which is lowered once for all patterns."""

    def label(lowered: Column) -> Column:
        result = F
        for pattern, name in rules:
            result = result.when(lowered.rlike(ascii_boundaries(pattern)), F.lit(name))
        return result.otherwise(F.lit(default))

    return F.element_at(F.transform(F.array(F.lower(text)), label), 1)


def change_type(message: Column) -> Column:
    return classify(message, CHANGE_TYPES, "other")


def first_int(text: Column, pattern: str = REQUEST_NUMBER) -> Column:
    """First group of the first match as a number; NULL when there is no match."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("bigint")


def excerpt(text: Column, size: int, marker: str = "...") -> Column:
    """The text itself up to ``size`` characters, else its head plus a marker."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit(marker))).otherwise(text)


def html_to_text(html: Column, cap: int | None = None) -> Column:
    """Readable text of a page: no script, style or tags, single spaces.

    ``cap`` turns the result into an excerpt; by default the text stays whole.
    """
    text = html
    for element in ("script", "style"):
        block = rf"(?is)<{element}(?![A-Za-z0-9_]).*?</{element}>"
        text = F.regexp_replace(text, F.lit(block), F.lit(""))
    text = F.regexp_replace(text, F.lit("<[^>]+>"), F.lit(" "))
    text = F.trim(F.regexp_replace(text, F.lit(WHITE_SPACE + "+"), F.lit(" ")))
    return excerpt(text, cap) if cap else text


def first_of(items: Column, n: int) -> Column:
    """The first ``n`` items of a list, in its order."""
    return F.slice(items, 1, n)


# Comment forms of SQL text.
IN_LINE = r"[^\n\r\x{2028}\x{2029}]"
LINE_COMMENT = rf"--{IN_LINE}*"
BLOCK_COMMENT = r"(?s)/\*.*?\*/"


def normalise_sql(text: Column) -> Column:
    """Lower-case text without comments and with single spaces, for comparison."""
    text = F.regexp_replace(text, F.lit(LINE_COMMENT), F.lit(""))
    text = F.regexp_replace(text, F.lit(BLOCK_COMMENT), F.lit(""))
    text = F.regexp_replace(text, F.lit(WHITE_SPACE + "+"), F.lit(" "))
    return F.lower(F.trim(text))


def comments(text: Column) -> Column:
    """Array of comment bodies: all line comments, then all block comments."""
    line = rf"--{WHITE_SPACE}*({IN_LINE}+)"
    block = rf"(?s)/\*{WHITE_SPACE}*(.*?){WHITE_SPACE}*\*/"
    return F.concat(
        F.regexp_extract_all(text, F.lit(line), F.lit(1)),
        F.regexp_extract_all(text, F.lit(block), F.lit(1)),
    )


def human_bytes(size: Column) -> Column:
    """``215.34 KB``: at most two decimals, no trailing zeros, largest unit last."""
    size = size.cast("double")
    result = F.when(size == 0, F.lit("0 Bytes"))
    for power, unit in enumerate(BYTE_UNITS):
        scaled = F.round(size / float(1024**power), 2)
        digits = F.regexp_replace(scaled.cast("decimal(38,2)").cast("string"), F.lit(r"\.?0+$"), F.lit(""))
        text = F.concat(digits, F.lit(f" {unit}"))
        if unit == BYTE_UNITS[-1]:
            result = result.when(size.isNotNull(), text)
        else:
            result = result.when(size < float(1024 ** (power + 1)), text)
    return result


def options_map(text: Column) -> Column:
    """``k=v, k2='w'`` as a map; splits at every comma, strips quotes and blanks.

    A key given twice keeps its last value.
    """
    pair = r"(?s)(\w+)\s*=\s*(.+)"

    def parsed(segment: Column) -> Column:
        value = F.regexp_replace(F.regexp_extract(segment, pair, 2), rf"{WHITE_SPACE}+$", "")
        return F.struct(
            F.regexp_extract(segment, pair, 1).alias("key"),
            F.regexp_replace(value, F.lit(r"(?s)^['\"](.*).$"), F.lit("$1")).alias("value"),
        )

    return F.aggregate(
        F.filter(F.transform(F.split(text, ","), parsed), lambda p: p["key"] != ""),
        F.create_map().cast("map<string,string>"),
        lambda found, p: F.map_concat(
            F.map_filter(found, lambda k, _: k != p["key"]), F.create_map(p["key"], p["value"])
        ),
    )


def name_parts(full_name: Column, default_schema: str = "public") -> Column:
    """(schema, table) of ``db.schema.table``, ``schema.table`` or ``table``.

    With any other number of dots the whole text is the table's name.
    """
    parts = F.split(full_name, r"\.")
    count = F.size(parts)
    qualified = count.isin(2, 3)
    return F.struct(
        F.when(qualified, F.try_element_at(parts, F.lit(-2))).otherwise(F.lit(default_schema)).alias("schema_name"),
        F.when(qualified, F.element_at(parts, -1)).otherwise(full_name).alias("table_name"),
    )
