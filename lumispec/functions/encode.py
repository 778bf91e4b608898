"""Scalar functions as Spark columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import MAX_U32


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def encode_mz(mz: Column | str, strict: bool = True) -> Column:
    """m/z in thousandths, rounded half up: floor(mz * 1000 + 0.5). Not finite, negative or too large: an error, or null if not strict."""
    mz = _c(mz).cast("double")
    value = F.floor(mz * 1000.0 + 0.5).cast("long")
    bad = F.isnan(mz) | (F.abs(mz) == float("inf")) | (mz < 0) | (mz * 1000.0 + 0.5 >= float(MAX_U32 + 1))
    fault = F.raise_error(F.concat(F.lit("m/z out of range: "), mz.cast("string"))).cast("long") if strict else F.lit(None).cast("long")
    return F.when(bad, fault).otherwise(value)


def encode_intensity(intensity: Column | str, strict: bool = True) -> Column:
    """A finite intensity from 0 to the largest float, as FLOAT; else an error, or null if not strict."""
    x = _c(intensity).cast("double")
    bad = F.isnan(x) | (x < 0) | (x > 3.4028234663852886e38)
    fault = F.raise_error(F.concat(F.lit("intensity out of range: "), x.cast("string"))).cast("float") if strict else F.lit(None).cast("float")
    return F.when(bad, fault).otherwise(x.cast("float"))


def bin_id(milli_mz: str, width: int) -> Column:
    """The bin of an encoded m/z column, by whole division."""
    if width <= 0:
        raise ValueError("bin width must be positive")
    return F.expr(f"`{milli_mz}` div {width}L")


def ppm_bounds(q: str, ppm: int) -> tuple[Column, Column]:
    """The least and greatest library peak that match a query peak. The window isn't symmetric: below, the distance is cut to whole thousandths;
    above, the largest delta counts with floor(delta * 1e6 / q) <= ppm."""
    return F.expr(f"greatest(0L, `{q}` - (`{q}` * {ppm}L) div 1000000L)"), F.expr(f"`{q}` + (`{q}` * {ppm + 1}L - 1L) div 1000000L")


def ppm_distance(q: str, p: str) -> Column:
    """Whole ppm between a query peak and a library peak; null for a query peak of 0."""
    return F.expr(f"abs({q} - {p}) * 1000000 div nullif({q}, 0)")


def closeness(distance: Column, ppm: Column) -> Column:
    """1 - distance / ppm, each step rounded to FLOAT."""
    return (F.lit(1.0).cast("float") - (distance.cast("float") / ppm.cast("float")).cast("float")).cast("float")


def clamp_gene_count(count: Column | str) -> Column:
    return F.greatest(_c(count).cast("long"), F.lit(0).cast("long"))


def normalise_taxonomy(id_: Column, text: Column) -> Column:
    """A taxonomy record with its defaults: id 0 where unknown or negative, empty text."""
    return F.struct(F.greatest(F.coalesce(id_.cast("long"), F.lit(0)), F.lit(0)).alias("id"), F.coalesce(text, F.lit("")).alias("text"))


def basename(path: Column | str) -> Column:
    """The last component of a path, or the path if it has none."""
    last = F.element_at(F.filter(F.split(_c(path), "/"), lambda x: x != ""), -1)
    return F.when(F.regexp_like(_c(path), F.lit("^/*$")), _c(path)).otherwise(last)


def sanitize_filename(name: Column | str) -> Column:
    return F.regexp_replace(_c(name), r"[^A-Za-z0-9._-]", "_")


def csv_escape(value: Column | str) -> Column:
    """Quoted only if it holds a comma, a quote or a line feed; quotes doubled."""
    v = _c(value)
    return F.when(F.regexp_like(v, F.lit('[,"\n]')), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


#: Kinds of errors by what their messages say; fixed patterns, tried in order.
DATABASE_ERRORS = [
    ("format", r"(?i)magic|schema|invariant|layout|checksum|crc|too small|overflow"),
    ("unreadable", r"(?i)no such file|failed to open|failed to mmap|permission denied"),
]
BUILD_ERRORS = [
    ("missing source", r"(?i)missing required all\.db"),
    ("decode", r"(?i)decode metadata|decode.*pickle|stream all\.db"),
]


def classify_error(message: Column | str, kinds: list[tuple[str, str]]) -> Column:
    out = F.lit("other")
    for name, pattern in reversed(kinds):
        out = F.when(F.regexp_like(_c(message), F.lit(pattern)), name).otherwise(out)
    return out


def score_text(score: Column | str) -> Column:
    """A score as shown: two decimals."""
    return F.format_string("%.2f", _c(score).cast("double"))


def count_text(count: Column | str) -> Column:
    """A count with separators of thousands."""
    return F.format_number(_c(count), 0)


def seconds_text(us: Column | str) -> Column:
    """Microseconds as seconds with two decimals."""
    return F.concat(F.format_string("%.2f", _c(us) / 1_000_000), F.lit(" s"))
