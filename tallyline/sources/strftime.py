"""SQL's ``strftime`` with the codes of the C library, as Spark expressions.

A format is taken apart into codes and literal text. Codes that Spark's date patterns have are put together as one pattern,
which is folded to a constant where the format is one; literal text is quoted in it. Formats with other codes (weeks,
weekdays, seconds since 1970, Julian days) are made code by code. A code that doesn't exist gives NULL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

# Codes, and the date patterns with the same text.
PATTERNS = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%j": "DDD",
    "%p": "a", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%f": "ss.SSS", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss",
    "%R": "HH:mm", "%D": "MM/dd/yy", "%%": "%",
}
_ISO_YEAR = "CAST(extract(YEAROFWEEK FROM moment) AS INT)"
_SUNDAY = "(dayofweek(moment) - 1)"
#: Codes that no pattern has, as SQL over ``moment``.
COMPUTED = {
    "%w": f"CAST({_SUNDAY} AS STRING)",
    "%u": "CAST(weekday(moment) + 1 AS STRING)",
    # Days of the year before the week that begins on a Sunday, or on a Monday.
    "%U": f"lpad(CAST((dayofyear(moment) + 6 - {_SUNDAY}) DIV 7 AS STRING), 2, '0')",
    "%W": "lpad(CAST((dayofyear(moment) + 6 - weekday(moment)) DIV 7 AS STRING), 2, '0')",
    "%V": "lpad(CAST(weekofyear(moment) AS STRING), 2, '0')",
    "%G": f"lpad(CAST({_ISO_YEAR} AS STRING), 4, '0')",
    "%g": f"lpad(CAST({_ISO_YEAR} % 100 AS STRING), 2, '0')",
    "%e": "lpad(CAST(day(moment) AS STRING), 2, ' ')",
    "%k": "lpad(CAST(hour(moment) AS STRING), 2, ' ')",
    "%l": "lpad(CAST((hour(moment) + 11) % 12 + 1 AS STRING), 2, ' ')",
    "%P": "lower(date_format(moment, 'a'))",
    "%s": "CAST(timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', moment) AS STRING)",
    # Days since noon, 24 November of 4714 BC.
    "%J": "format_number(2440587.5D + timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', moment) / 86400000000D, '0.0########')",
}


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _case(token: str, choices: dict[str, str], otherwise: str, value: Callable[[str], str]) -> str:
    whens = " ".join(f"WHEN {_quoted(code)} THEN {value(made)}" for code, made in choices.items())
    return f"CASE {token} {whens} ELSE {otherwise} END"


def definition(name: str = "strftime") -> str:
    """The SQL that makes the function in a session."""
    tokens = "regexp_extract_all(codes, '(?s)%.|[^%]+|%', 0)"
    # Literal text between quotes; runs of it never touch, because a doubled percent sign stands in a pattern by itself.
    literal = "concat('\\'', replace(t, '\\'', '\\'\\''), '\\'')"
    pattern = _case("t", PATTERNS, f"CASE WHEN t NOT LIKE '\\\\%%' THEN {literal} END", _quoted)
    # The same for a whole format without lambdas, so that a constant format becomes a constant pattern: marks stand
    # around the text between codes, two marks with nothing between them go, and the rest become quotes.
    known = "(?s)%[" + "".join(code[1] for code in PATTERNS) + "]"
    marked = r"concat('\u0001', regexp_replace(codes, '(?s)(%.)', '\u0001$1\u0001'), '\u0001')"
    whole = rf"replace({marked}, '\u0001\u0001', '')"
    whole = rf"replace(replace(replace({whole}, '\'', '\'\''), '\u0001', '\''), '%%', '\u0002')"
    for code, made in PATTERNS.items():
        if code != "%%":
            whole = f"replace({whole}, '{code}', '{made}')"
    whole = rf"replace({whole}, '\u0002', '%')"
    simple = f"instr(regexp_replace(codes, '{known}', ''), '%') = 0"
    one = _case("t", COMPUTED, f"date_format(moment, {pattern})", str)
    each = f"transform({tokens}, t -> {one})"
    return f"""
CREATE OR REPLACE TEMPORARY FUNCTION {name}(codes STRING, moment TIMESTAMP_NTZ) RETURNS STRING
RETURN CASE
    WHEN codes = '' THEN IF(moment IS NULL, NULL, '')
    WHEN {simple} THEN date_format(moment, {whole})
    WHEN forall({each}, x -> x IS NOT NULL) THEN array_join({each}, '')
END"""


def register(spark: SparkSession, name: str = "strftime") -> None:
    spark.sql(definition(name))
