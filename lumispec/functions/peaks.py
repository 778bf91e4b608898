"""Parsing of peak lines as Spark columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, for patterns of Java and of RE2 alike; and numbers as the peak grammar has them. Fixed values.
SPACE = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
NUMBER = r"^[+-]?((?i:inf|infinity|nan)|([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)$"


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value worked out once, however often `then` names it."""
    return F.get(F.transform(F.array(value), then), 0)


def _number(x: Column) -> Column:
    """A field as DOUBLE, or null if it isn't a number of the grammar."""
    low = F.lower(F.regexp_replace(x, r"^[+-]", ""))
    sign = F.when(F.startswith(x, F.lit("-")), -1.0).otherwise(1.0)
    special = F.when(low.isin("inf", "infinity"), sign * float("inf")).when(low == "nan", float("nan"))
    return F.when(F.regexp_like(x, F.lit(NUMBER)), F.coalesce(special, x.try_cast("double")))


def peak_fields(line: Column | str) -> Column:
    """struct<text, first, second> of a line: without white space before it, and its first two fields. Both patterns end at the second field, however
    long the line: white space behind it makes an empty field, which counts as none."""
    line = F.col(line) if isinstance(line, str) else line
    text = F.regexp_replace(line, f"^[{SPACE}]+", "")
    parts = F.split(F.regexp_replace(line, f"^[{SPACE},]+", ""), f"[{SPACE},]+", 3)
    return F.struct(text.alias("text"), F.get(parts, 0).alias("first"), F.nullif(F.get(parts, 1), F.lit("")).alias("second"))


#: What a line may be.
PEAK, BLANK, COMMENT, TITLE, NO_MZ, NO_INTENSITY = "peak", "blank", "comment", "title", "no_mz", "no_intensity"


def classify_peak_line(fields: Column) -> Column:
    """struct<kind, mz, intensity> of peak_fields(): a peak, or why the line is none. Blank lines, # comments and COM= titles are skipped by intent;
    in no_mz the first field is no number, in no_intensity the second. One field alone has intensity 1; a third and more are ignored."""

    def found(x: Column) -> Column:
        kind = (
            F.when(x["text"] == "", BLANK).when(F.startswith(x["text"], F.lit("#")), COMMENT).when(F.startswith(x["text"], F.lit("COM=")), TITLE)
            .when(x["mz"].isNull(), NO_MZ).when(x["intensity"].isNull(), NO_INTENSITY).otherwise(PEAK)
        )
        return F.struct(kind.alias("kind"), x["mz"].alias("mz"), x["intensity"].alias("intensity"))

    def read(x: Column) -> Column:
        intensity = F.when(x["second"].isNotNull(), _number(x["second"])).otherwise(1.0)
        return F.struct(x["text"].alias("text"), _number(x["first"]).alias("mz"), intensity.alias("intensity"))

    peak = lambda x: F.struct(x["kind"].alias("kind"), F.when(x["kind"] == PEAK, x["mz"]).alias("mz"), F.when(x["kind"] == PEAK, x["intensity"]).alias("intensity"))
    return once(once(once(fields, read), found), peak)


def parse_peak_line(line: Column | str) -> Column:
    """struct<mz, intensity> of a line, or null where there is no peak: blank lines, # comments, COM= lines, and lines whose first field, or
    second if there is one, is no number."""
    return once(classify_peak_line(peak_fields(line)), lambda x: F.when(x["kind"] == PEAK, F.struct(x["mz"].alias("mz"), x["intensity"].alias("intensity"))))
