"""Money: integer minor units end to end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_minor(text: Column | str, scale: int = 2) -> Column:
    """Decimal text to minor units, half away from zero; commas are dropped, blank is 0, unreadable is null."""
    t = F.regexp_replace(F.trim(_c(text)), ",", "")
    ok = F.regexp_like(t, F.lit(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"))
    value = F.when(ok, F.regexp_replace(t, r"^\+", "").try_cast("decimal(30,10)"))
    return F.when(t == "", F.lit(0)).otherwise(F.round(value * F.lit(10**scale).cast("decimal(10,0)"), 0)).cast("bigint")


def already_minor(text: Column | str) -> Column:
    """Text that is in minor units already: must be integral, else null; blank is 0."""
    t = F.regexp_replace(F.trim(_c(text)), ",", "")
    return F.when(t == "", F.lit(0)).when(F.regexp_like(t, F.lit(r"^[+-]?\d+$")), t.try_cast("bigint")).cast("bigint")


def fx_convert(minor: Column | str, rate: Column | str) -> Column:
    """Minor units times a rate in binary floating point, half to even."""
    return F.rint(_c(minor).cast("double") * _c(rate)).cast("bigint")


def format_minor(minor: Column | str, sign: str = "₹") -> Column:
    """Two decimals with Indian digit groups (12,34,567.89); a minus goes before the currency sign."""
    m = _c(minor)
    whole = F.floor(F.abs(m) / 100).cast("string")
    head = F.regexp_replace(F.substring(whole, 1, 100).substr(F.lit(1), F.length(whole) - 3), r"(?<=\d)(?=(\d\d)+$)", ",")
    grouped = F.when(F.length(whole) <= 3, whole).otherwise(F.concat(head, F.lit(","), F.right(whole, F.lit(3))))
    cents = F.lpad(F.pmod(F.abs(m), F.lit(100)).cast("string"), 2, "0")
    return F.concat(F.when(m < 0, "-").otherwise(""), F.lit(sign), grouped, F.lit("."), cents)


def amount_level(a: Column | str, b: Column | str, rounding: int = 100, tolerance: int = 200) -> Column:
    """exact, within_rounding, within_tol, within_1pct (of the larger) or none; null when either is null."""
    gap = F.abs(_c(a) - _c(b))
    big = F.greatest(F.abs(_c(a)), F.abs(_c(b)))
    return F.when(gap == 0, "exact").when(gap <= rounding, "within_rounding").when(gap <= tolerance, "within_tol").when(gap <= big * 0.01, "within_1pct").when(gap.isNotNull(), "none")


#: Upper ends (exclusive, minor units) and names of impact bands.
BANDS = [(100_000, "<₹1k"), (1_000_000, "₹1k–₹10k"), (10_000_000, "₹10k–₹1L"), (100_000_000, "₹1L–₹10L")]
TOP_BAND = "₹10L+"
#: Edges (inclusive) of residual and record-count bands.
RESIDUAL_EDGES = [100, 500, 2000, 10000, 100000]
COUNT_EDGES = [1, 3, 8, 20]


def impact_band(minor: Column | str) -> Column:
    a, out = F.abs(_c(minor)), F.lit(TOP_BAND)
    for top, name in reversed(BANDS):
        out = F.when(a < top, name).otherwise(out)
    return out


def direction(minor: Column | str) -> Column:
    m = _c(minor)
    return F.when(m < 0, "short").when(m > 0, "over").otherwise("flat")


def edge_band(value: Column | str, edges: list[int]) -> Column:
    """``<=e`` for the first edge that is not exceeded, else ``>last``."""
    a, out = F.abs(_c(value)), F.lit(f">{edges[-1]}")
    for e in reversed(edges):
        out = F.when(a <= e, f"<={e}").otherwise(out)
    return out
