"""Pairing rows of two tables by nearest time for the same entity, within a tolerance and with a fitting amount.

Right-hand moments become disjoint nearest-neighbour intervals, bounded by the midpoints to their neighbours and by the
tolerance; left-hand moments are then looked up in a partitioned interval index. No pair of rows that is not nearest is
ever compared for distance.

* Time is cut into chunks twice the tolerance wide. A neighbour in a chunk that is not adjacent is further away than
  twice the tolerance and cannot bound an interval, so every window is confined to one chunk of one entity and amount:
  an entity that holds a third of all rows is spread over as many tasks as it has chunks.
* Intervals are indexed by their own length: level k has buckets ``BASE * 4**k`` seconds wide and holds the intervals
  longer than a quarter of that. They are disjoint, so above level 0 a bucket meets six at most, whatever the density.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the statement of the problem.
TOLERANCE_S = 36 * 3600
AMOUNT_TOLERANCE = 200
#: Width of the finest index buckets, in seconds, and the ratio of one level to the next.
BASE_S, RATIO = 64, 4


def _micros(seconds: int) -> int:
    return seconds * 1_000_000


def _chunk(t: Column, tolerance_s: int) -> Column:
    return F.floor(t / F.lit(_micros(2 * tolerance_s)))


def _levels(tolerance_s: int) -> list[int]:
    """Bucket widths in microseconds, up to the longest possible interval."""
    widths = [_micros(BASE_S)]
    while widths[-1] < _micros(2 * tolerance_s):
        widths.append(widths[-1] * RATIO)
    return widths


def index_intervals(fits: DataFrame, by: list[str], tolerance_s: int) -> DataFrame:
    """Nearest-neighbour intervals of ``fits`` (``by``.., chunk, t, rid), in half microseconds so midpoints are whole.

    Returns ``by``.., rid, t, lo2, hi2 with both ends inclusive: on a tie the midpoint belongs to the smaller rid.
    """
    one = fits.groupBy(*by, "chunk", "t").agg(F.min("rid").alias("rid"))
    edge = one.groupBy(*by, "chunk").agg(F.min(F.struct("t", "rid")).alias("first"), F.max(F.struct("t", "rid")).alias("last"))
    before = edge.select(*by, (F.col("chunk") + 1).alias("chunk"), F.col("last").alias("_before"))
    after = edge.select(*by, (F.col("chunk") - 1).alias("chunk"), F.col("first").alias("_after"))
    w = Window.partitionBy(*by, "chunk").orderBy("t")
    me = F.struct("t", "rid")
    near = one.withColumn("prev", F.lag(me).over(w)).withColumn("next", F.lead(me).over(w))
    near = near.join(before, [*by, "chunk"], "left").join(after, [*by, "chunk"], "left")
    prev, nxt = F.coalesce("prev", "_before"), F.coalesce("next", "_after")
    tol = F.lit(_micros(2 * tolerance_s))
    lo = prev["t"] + F.col("t") + F.when(F.col("rid") < prev["rid"], 0).otherwise(1)
    hi = nxt["t"] + F.col("t") - F.when(F.col("rid") < nxt["rid"], 0).otherwise(1)
    return near.select(*by, "rid", "t", F.greatest(lo, 2 * F.col("t") - tol).alias("lo2"), F.least(hi, 2 * F.col("t") + tol).alias("hi2")).where("lo2 <= hi2")


def nearest(
    left: DataFrame,
    right: DataFrame,
    entity: list[str],
    tolerance_s: int = TOLERANCE_S,
    amount_tolerance: int = AMOUNT_TOLERANCE,
) -> DataFrame:
    """For each left row its nearest fitting right row: (lid, rid, distance_us); left rows without one do not come out.

    ``left`` has ``entity``.., lid, t (timestamp), amount; ``right`` has ``entity``.., rid, t, amount. A pair fits if
    entities are equal, amounts differ by at most ``amount_tolerance`` and moments by at most ``tolerance_s``. Among
    equally near ones the smaller rid wins. One right row may serve several left rows.

    Nulls: rows with a null in entity, moment, amount or id match nothing. Repeated left rows give one row per lid (its
    smallest moment); repeated right rows count once. Empty tables give an empty result. Other columns are ignored.
    """
    need = [*entity, "t", "amount"]
    lt = left.select(*entity, "lid", F.unix_micros("t").alias("t"), F.col("amount").cast("bigint").alias("amount")).dropna()
    lt = lt.groupBy("lid").agg(F.min(F.struct(*need)).alias("r")).select("lid", "r.*")
    rt = right.select(*entity, "rid", F.unix_micros("t").alias("t"), F.col("amount").cast("bigint").alias("amount")).dropna()
    rt = rt.groupBy("rid").agg(F.min(F.struct(*need)).alias("r")).select("rid", "r.*")

    step = amount_tolerance + 1
    slot = lambda c: F.floor(c / F.lit(step))
    # The amounts looked for around each chunk; a right row meets at most 2 * amount_tolerance + 1 of them.
    wanted = lt.select(*entity, "amount", F.explode(F.sequence(_chunk(F.col("t"), tolerance_s) - 1, _chunk(F.col("t"), tolerance_s) + 1)).alias("chunk")).distinct()
    wanted = wanted.withColumn("slot", slot(F.col("amount")))
    offered = rt.select(*entity, "rid", "t", F.col("amount").alias("r_amount"), _chunk(F.col("t"), tolerance_s).alias("chunk"), F.explode(F.sequence(slot(F.col("amount")) - 1, slot(F.col("amount")) + 1)).alias("slot"))
    fits = offered.join(wanted, [*entity, "chunk", "slot"]).where(F.abs(F.col("r_amount") - F.col("amount")) <= amount_tolerance)

    by = [*entity, "amount"]
    spans = index_intervals(fits.select(*by, "chunk", "t", "rid"), by, tolerance_s)
    widths = _levels(tolerance_s)
    length = F.col("hi2") - F.col("lo2")
    level = F.lit(len(widths) - 1)
    for k in range(len(widths) - 2, -1, -1):
        level = F.when(length <= 2 * widths[k], k).otherwise(level)
    width2 = F.element_at(F.array(*(F.lit(2 * w) for w in widths)), F.col("level") + 1)
    index = spans.withColumn("level", level).withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo2") / width2), F.floor(F.col("hi2") / width2))))
    index = index.select(*by, "level", "bucket", "lo2", "hi2", "rid", F.col("t").alias("r_t"))

    probes = F.array(*(F.struct(F.lit(k).alias("level"), F.floor(F.col("t") / F.lit(w)).alias("bucket")) for k, w in enumerate(widths)))
    look = lt.select("lid", *by, "t", F.explode(probes).alias("p")).select("lid", *by, "t", "p.level", "p.bucket")
    hit = look.join(index, [*by, "level", "bucket"]).where((2 * F.col("t") >= F.col("lo2")) & (2 * F.col("t") <= F.col("hi2")))
    # Chunks overlap in what they were asked for, not in what they answer: intervals of one entity and amount are disjoint.
    return hit.select("lid", "rid", F.abs(F.col("t") - F.col("r_t")).alias("distance_us"))


def payouts(records: DataFrame) -> DataFrame:
    """Payout Records: kind transfer, moment in raw['settled_at'] as unix seconds, account in external_ids."""
    seconds = F.element_at("raw", "settled_at").try_cast("bigint")
    return records.where("kind = 'transfer'").select(
        F.col("id").alias("lid"), "org_id", F.element_at("external_ids", "account_no").alias("account_no"), F.timestamp_seconds(seconds).alias("t"), F.col("amount_minor").alias("amount")
    )


def advices(credit_advice: DataFrame) -> DataFrame:
    return credit_advice.select(F.col("advice_id").alias("rid"), "org_id", "account_no", F.col("advised_at").alias("t"), F.col("amount_minor").alias("amount"))
