"""Fellegi-Sunter weights: agreement levels to bits, posterior, calibration, estimation from labelled pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prior probabilities of each level among matches (m) and non-matches (u).
PRIOR = {
    "amount": {"exact": (0.82, 0.02), "within_rounding": (0.10, 0.03), "within_tol": (0.05, 0.05), "within_1pct": (0.02, 0.10), "none": (0.01, 0.80)},
    "date": {"same_day": (0.55, 0.05), "within_1": (0.30, 0.08), "within_window": (0.13, 0.17), "none": (0.02, 0.70)},
    "reference": {"exact": (0.90, 0.001), "jaro_hi": (0.06, 0.02), "jaro_mid": (0.03, 0.10), "none": (0.01, 0.879)},
    "idlink": {"shared": (0.95, 0.01), "none": (0.05, 0.99)},
}
Table = dict[str, dict[str, tuple[float, float]]]


def bits(m: float, u: float) -> float:
    clamp = lambda p: min(max(p, 1e-6), 1 - 1e-6)
    return math.log2(clamp(m) / clamp(u))


def level_weight(field: str, level: Column, model: Table = PRIOR) -> Column:
    """Bits of a level; an unknown level has none (0)."""
    out = F.lit(0.0)
    for name, (m, u) in model[field].items():
        out = F.when(level == name, F.lit(bits(m, u))).otherwise(out)
    return out


def weight(levels: dict[str, Column], model: Table = PRIOR) -> Column:
    out = F.lit(0.0)
    for field, level in levels.items():
        out = out + level_weight(field, level, model)
    return out


def posterior(weight_bits: Column, prior: Column | float) -> Column:
    p = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), prior if isinstance(prior, Column) else F.lit(prior)))
    odds = p / (1 - p) * F.pow(F.lit(2.0), weight_bits)
    return odds / (1 + odds)


def calibrated(p: Column, points: list[tuple[float, float]]) -> Column:
    """Piecewise linear through the sorted points with flat ends; no points leave p alone."""
    if not points:
        return p
    pts = sorted(points)
    out = F.lit(pts[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(pts, pts[1:]))):
        line = F.lit(y1) if x1 == x0 else F.lit(y0) + F.lit(y1 - y0) * (p - x0) / F.lit(x1 - x0)
        out = F.when(p <= x1, line).otherwise(out)
    return F.when(p <= pts[0][0], F.lit(pts[0][1])).when(p >= pts[-1][0], F.lit(pts[-1][1])).otherwise(out)


def estimate(pairs: DataFrame, fields: dict[str, list[str]], smoothing: float = 1.0) -> DataFrame:
    """(field, level, m, u) from labelled pairs: boolean ``is_match`` and one column of levels per field.

    Laplace-smoothed shares of each level among matches and non-matches; levels never seen get the smoothing alone.
    """
    long = pairs.select("is_match", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("level")) for f in fields))).alias("x")).select("is_match", "x.*")
    per = long.groupBy("field", "level").agg(F.sum(F.col("is_match").cast("bigint")).alias("pos"), F.sum((~F.col("is_match")).cast("bigint")).alias("neg"))
    grid = pairs.sparkSession.createDataFrame([(f, v, len(vs)) for f, vs in fields.items() for v in vs], "field string, level string, k int")
    x = F.broadcast(grid).join(per, ["field", "level"], "left").na.fill(0, ["pos", "neg"])
    totals = x.groupBy("field").agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    share = lambda n, t: F.round((F.col(n) + smoothing) / (F.col(t) + F.col("k") * smoothing), 9)
    return x.join(F.broadcast(totals), "field").select("field", "level", share("pos", "all_pos").alias("m"), share("neg", "all_neg").alias("u"))
