"""Cell parsing: numbers, timestamps and delimited lines as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterspark.functions.clock import to_utc
from meterspark.schemas import MISSING_TOKENS

# Accepted spellings.
WHITESPACE = " \t\r\n\f\x0b"
DIGITS = "[0-9](_?[0-9])*"
NUMBER_PATTERN = rf"^[+-]?({DIGITS}(\.({DIGITS})?)?|\.{DIGITS})([eE][+-]?{DIGITS})?$"
NON_FINITE_PATTERN = "^(?i)[+-]?(inf|infinity|nan)$"
ISO_PATTERN = (
    r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,6})?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
)
OFFSET_PATTERN = r"[T ].*(Z|[+-]\d{2}(:?\d{2})?)$"
STRFTIME_TO_SPARK = {
    "Y": "yyyy",
    "y": "yy",
    "m": "M",
    "d": "d",
    "H": "H",
    "I": "h",
    "M": "m",
    "S": "s",
    "f": "SSSSSS",
    "p": "a",
    "b": "MMM",
    "B": "MMMM",
    "a": "E",
    "A": "EEEE",
    "j": "D",
    "z": "XX",
    "%": "%",
}
# End of fixed values.


def is_finite(value: Column) -> Column:
    """False for null, NaN and the infinities."""
    return F.coalesce(F.abs(value) < F.lit(float("inf")), F.lit(False))


def with_numbers(
    df: DataFrame, raws: Mapping[str, Column], decimal: str = "."
) -> DataFrame:
    """Add ``<name>_value`` and ``<name>_problem`` for each raw text.

    The problem is null, ``missing``, ``invalid`` or ``non_finite``. A cell the JVM parses
    directly to a finite value and that ends in a digit or a dot is a plain number; only the
    others are looked at closely. Two projections, so that no trimmed text is carried along.
    """

    def normal(name: str) -> Column:
        raw = raws[name]
        return F.replace(raw, F.lit(","), F.lit(".")) if decimal == "," else raw

    def text(name: str) -> Column:
        return F.btrim(F.coalesce(normal(name), F.lit("")), F.lit(WHITESPACE))

    def plain(name: str) -> Column:
        return (
            is_finite(F.col(f"{name}_direct"))
            & F.right(text(name), F.lit(1)).isin(*"0123456789.")
            & ~F.lower(raws[name]).contains("x")
        )

    def spelled(name: str) -> Column:
        """Numbers with digit separators and the like."""
        bare = F.replace(text(name), F.lit("_"), F.lit("")).try_cast("double")
        return F.when(text(name).rlike(NUMBER_PATTERN), bare)

    def value(name: str) -> Column:
        return F.when(plain(name), F.col(f"{name}_direct")).when(
            ~text(name).isin(*MISSING_TOKENS) & is_finite(spelled(name)), spelled(name)
        )

    def problem(name: str) -> Column:
        return (
            F.when(plain(name), F.lit(None).cast("string"))
            .when(text(name).isin(*MISSING_TOKENS), "missing")
            .when(is_finite(spelled(name)), F.lit(None).cast("string"))
            .when(spelled(name).isNotNull() | text(name).rlike(NON_FINITE_PATTERN), "non_finite")
            .otherwise("invalid")
        )

    direct = df.select("*", *(normal(n).try_cast("double").alias(f"{n}_direct") for n in raws))
    return direct.select(
        *df.columns,
        *(value(n).alias(f"{n}_value") for n in raws),
        *(problem(n).alias(f"{n}_problem") for n in raws),
    )


def spark_pattern(pattern: str) -> str:
    """A Spark datetime pattern from a ``%``-style one; other text is returned as it is."""
    if "%" not in pattern:
        return pattern
    out: list[str] = []
    position = 0
    while position < len(pattern):
        char = pattern[position]
        if char == "%":
            position += 1
            directive = pattern[position : position + 1]
            if directive not in STRFTIME_TO_SPARK:
                raise ValueError(f"unsupported timestamp directive %{directive}")
            out.append(STRFTIME_TO_SPARK[directive])
        elif char.isalpha():
            out.append(f"'{char}'")
        else:
            out.append(char)
        position += 1
    return "".join(out)


def parse_timestamp(raw: Column, pattern: str | None, timezone: str | None) -> Column:
    """UTC instant, or null when the text is not a timestamp or is naive without a zone."""

    def zoned(naive: Column) -> Column:
        return to_utc(naive, timezone) if timezone else F.lit(None).cast("timestamp_ntz")

    if pattern:
        spark_text = spark_pattern(pattern)
        parsed = F.try_to_timestamp(raw, F.lit(spark_text)).cast("timestamp_ntz")
        return parsed if "X" in spark_text else zoned(parsed)
    shaped = F.when(raw.rlike(ISO_PATTERN), F.replace(raw, F.lit(","), F.lit(".")))
    full = F.regexp_replace(shaped, r"([T ]\d{2})(Z|[+-].*)?$", "$1:00$2")
    return F.when(
        shaped.rlike(OFFSET_PATTERN), full.try_cast("timestamp").cast("timestamp_ntz")
    ).otherwise(zoned(full.try_cast("timestamp_ntz")))


def parse_uci_timestamp(date: Column, time: Column, timezone: str) -> Column:
    """``d/m/yyyy`` and ``H:M:S`` civil time in ``timezone`` as a UTC instant."""
    text = F.concat_ws(
        " ", F.rtrim(date, F.lit(WHITESPACE)), F.ltrim(time, F.lit(WHITESPACE))
    )
    shaped = F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$"), text)
    return to_utc(F.try_to_timestamp(shaped, F.lit("d/M/yyyy H:m:s")), timezone)


def split_line(line: Column, delimiter: str) -> Column:
    """Cells of one delimited line; quotes are honoured, a blank line has no cells."""
    quoted = f"{_regex(delimiter)}(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"
    unquoted = F.transform(
        F.split(line, quoted, -1),
        lambda cell: F.when(
            cell.rlike('^"(?s).*"$'),
            F.replace(F.substring(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"')),
        ).otherwise(cell),
    )
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    return (
        F.when(line == "", F.array().cast("array<string>"))
        .when(~line.contains('"'), F.split(line, _regex(delimiter), -1))
        .when(quotes % 2 == 1, F.raise_error(F.concat(F.lit("malformed quoting: "), line)))
        .otherwise(unquoted)
    )


def _regex(delimiter: str) -> str:
    return "\\t" if delimiter == "\t" else delimiter
