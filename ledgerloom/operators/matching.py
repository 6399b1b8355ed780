"""The matching cascade: exact, tolerant, blocked, aggregate, subset and fuzzy. Each pass consumes a remainder only."""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator
from itertools import combinations, islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import date_level
from ..functions.money import amount_level
from ..tables import cut, ship
from . import fs

#: Tolerances in minor units and days, thresholds of confidence.
TOLERANCE, ROUNDING, WINDOW, AUTO, REVIEW = 200, 100, 4, 0.90, 0.70
#: Pools of the aggregate and subset passes and the size up to which subsets are searched exactly.
BLOCK_POOL, CREDIT_POOL, PAYMENT_POOL, EXACT_ITEMS = 14, 10, 40, 22
#: Fixed value: steps after which no further swap is looked for.
SWAP_STEPS = 200_000


def by_reference(batches: DataFrame, credits: DataFrame) -> DataFrame:
    """Each batch with its nearest credit under its own reference (ties: smaller credit id).

    The nearest is a map-side combined minimum, so a reference with very many credits is no hot group.
    """
    x = batches.join(credits.where("utr is not null"), batches["batch_key"] == credits["utr"])
    best = F.min(F.struct(F.abs(F.col("amount") - F.col("net")).alias("gap"), "credit_id", "amount", "value_date"))
    keep = [c for c in batches.columns if c != "batch_key"]
    return x.groupBy("batch_key").agg(best.alias("b"), *(F.first(c).alias(c) for c in keep)).select("batch_key", *keep, "b.gap", "b.credit_id", "b.amount", "b.value_date")


def outcome(batches: DataFrame, credits: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per batch: exact, tolerant, out_of_tolerance or no_credit, with residual and ledger cross-check."""
    tied = by_reference(batches, credits).select("batch_key", "credit_id", "amount", "value_date")
    x = batches.join(tied, "batch_key", "left").join(ledger, "batch_key", "left")
    x = x.withColumn("residual", F.col("amount") - F.col("net")).withColumn("ledger_ok", F.coalesce(F.col("gross") == F.nullif("ledger_total", F.lit(0)), F.lit(True)))
    kind = (
        F.when(F.col("credit_id").isNull(), "no_credit")
        .when((F.col("residual") == 0) & F.col("ledger_ok"), "exact")
        .when(F.abs("residual") <= TOLERANCE, "tolerant")
        .otherwise("out_of_tolerance")
    )
    return x.withColumn("outcome", kind)


def tolerant_confidence(tied: DataFrame, prior: Column | float) -> DataFrame:
    """Weight in bits and posterior of tied batches: amount and date levels, reference and id link agree."""
    levels = {"amount": amount_level("amount", "net", ROUNDING, TOLERANCE), "date": date_level("value_date", "settled_at", WINDOW), "reference": F.lit("exact"), "idlink": F.lit("shared")}
    w = fs.weight(levels)
    p = fs.posterior(w, prior)
    capped = F.when(F.col("ledger_ok"), p).otherwise(F.least(p, F.lit(REVIEW)))
    return tied.withColumns({"amount_level": levels["amount"], "date_level": levels["date"], "weight_bits": F.round(w, 3), "confidence": F.round(capped, 6)})


def amount_band_pairs(batches: DataFrame, credits: DataFrame, tolerance: int = TOLERANCE, window: int = WINDOW, rounding: int = ROUNDING) -> DataFrame:
    """Batches and credits within tolerance and in the date window (or within rounding): a bucketed range join.

    Buckets are one tolerance wide; the smaller row of each pair looks into its own bucket and both neighbours, so no
    pair is lost and the join stays an equi-join.
    """
    near = batches.select(*batches.columns, F.explode(F.sequence(F.floor(F.col("net") / tolerance) - 1, F.floor(F.col("net") / tolerance) + 1)).alias("slot"))
    cand = credits.select("credit_id", "amount", "value_date", F.floor(F.col("amount") / tolerance).alias("slot"))
    x = near.join(cand, "slot").drop("slot").withColumn("gap", F.abs(F.col("amount") - F.col("net"))).where(F.col("gap") <= tolerance)
    days = F.abs(F.datediff("value_date", "settled_at"))
    return x.withColumn("days", days).where((F.col("days") <= window) | (F.col("gap") <= rounding))


def blocked_confidence(pairs: DataFrame, rounding: int = ROUNDING) -> DataFrame:
    """Confidence of a pair from its date level and gap; capped when the two best gaps of the batch are too close.

    Where the pairs tell that the ledger contradicts the batch (``ledger_ok``), it is capped at the review threshold.
    """
    w = Window.partitionBy("batch_key").orderBy("gap", "credit_id")
    x = pairs.withColumn("rank", F.row_number().over(w)).withColumn("next_gap", F.lead("gap").over(w))
    unclear = F.max(F.when((F.col("rank") == 1) & (F.col("next_gap") - F.col("gap") <= rounding), 1).otherwise(0)).over(Window.partitionBy("batch_key")) == 1
    base = F.when(F.col("days") == 0, 0.94).when(F.col("days") <= 1, 0.90).when(F.col("days") <= WINDOW, 0.85).otherwise(0.80)
    conf = base - F.when(F.col("gap") > rounding, 0.1).otherwise(0.0)
    conf = F.when(unclear, F.least(conf, F.lit(REVIEW - 0.01))).otherwise(conf)
    if "ledger_ok" in pairs.columns:
        conf = F.when(F.col("ledger_ok"), conf).otherwise(F.least(conf, F.lit(REVIEW)))
    level = F.when(F.col("days") == 0, 0).when(F.col("days") <= 1, 1).when(F.col("days") <= WINDOW, 2).otherwise(3)
    return x.withColumns({"confidence": F.round(conf, 4), "level": level}).drop("rank", "next_gap")


def greedy(pairs: DataFrame, order: list[str], left: str, right: str, keep: list[str] = ()) -> DataFrame:
    """Greedy one-to-one assignment in the total order (``order``, right, left as text), in rounds of mutual minima.

    A pair that is the first choice of both its ends is what the sequential greedy would take; both ends then leave.
    Rounds end when no pair is left; each round is written out, so a lost executor costs one round at most.
    """
    key = F.struct(*order, right, F.col(left).cast("string").alias("_text"), left)
    rest = cut(pairs.select(left, right, *order, *keep, key.alias("_key")))
    taken: DataFrame | None = None
    while True:
        lmin = rest.groupBy(left).agg(F.min("_key").alias("_l"))
        rmin = rest.groupBy(right).agg(F.min("_key").alias("_r"))
        now = cut(rest.join(lmin, left).join(rmin, right).where("_key = _l and _key = _r").select(left, right, *order, *keep))
        if now.isEmpty():
            break
        taken = now if taken is None else taken.unionByName(now)
        rest = cut(rest.join(now.select(left), left, "left_anti").join(now.select(right), right, "left_anti"))
    return taken if taken is not None else rest.select(left, right, *order, *keep).limit(0)


def unique_sum(values: list[tuple[str, int]], target: int, tolerance: int, sizes: tuple[int, ...]) -> list[str] | None:
    """The one combination of these sizes that adds up to ``target`` within tolerance; None without one or with more.

    The search stops after the first size at which more than one combination has been found so far.
    """
    hits: list[list[str]] = []
    for n in sizes:
        hits += [[k for k, _ in c] for c in combinations(values, n) if abs(sum(v for _, v in c) - target) <= tolerance]
        if len(hits) > 1:
            return None
    return hits[0] if hits else None


def _greedy_sum(values: list[tuple[str, int]], target: int, tolerance: int) -> list[str] | None:
    order, total, steps = sorted(range(len(values)), key=lambda i: -abs(values[i][1])), 0, len(values)
    chosen: list[int] = []
    for i in order:
        if abs(total + values[i][1] - target) <= abs(total - target):
            chosen.append(i)
            total += values[i][1]
    improved = True
    while improved and steps < SWAP_STEPS:
        improved = False
        for i in chosen:
            base, gap = total - values[i][1] - target, abs(total - target)
            j = next((j for j, (_, v) in enumerate(values) if abs(base + v) < gap and j not in chosen), None)
            steps += len(values) if j is None else j + 1
            if j is not None:
                chosen.remove(i)
                chosen.append(j)
                total = base + target + values[j][1]
                improved = True
                break
    return [values[i][0] for i in sorted(chosen)] if chosen and abs(total - target) <= tolerance else None


def subset_sum(values: list[tuple[str, int]], target: int, tolerance: int) -> list[str] | None:
    """The one subset that adds up to ``target`` within tolerance, by meeting in the middle; None if none or several.

    Beyond EXACT_ITEMS values a greedy fill is tried instead, then single swaps as long as one closes the gap further.
    """
    n = len(values)
    if n > EXACT_ITEMS:
        return _greedy_sum(values, target, tolerance)
    half = n // 2
    sums = lambda part: [(sum(v for i, (_, v) in enumerate(part) if m >> i & 1), m) for m in range(1 << len(part))]
    right = sorted(sums(values[half:]))
    keys = [s for s, _ in right]
    hits: set[tuple[int, int]] = set()
    for s, m in sums(values[:half]):
        i = bisect.bisect_left(keys, target - tolerance - s)
        while i < len(right) and keys[i] <= target + tolerance - s:
            if m or right[i][1]:
                hits.add((m, right[i][1]))
            if len(hits) > 1:
                return None
            i += 1
    if not hits:
        return None
    m, r = hits.pop()
    return [values[i][0] for i in range(half) if m >> i & 1] + [values[half + i][0] for i in range(n - half) if r >> i & 1]


class _Pool:
    """The first ``size`` items that are left, refilled as some are taken; the sums of its combinations are kept."""

    def __init__(self, items: Iterable[tuple], size: int, sizes: tuple[int, ...] = ()):
        self.rest, self.size, self.sizes, self.items = iter(items), size, sizes, []
        self.take([])

    def take(self, keys: list) -> None:
        self.items = [x for x in self.items if x[0] not in keys]
        self.items += islice(self.rest, self.size - len(self.items))
        self.sums = sorted((sum(v for _, v in c), [k for k, _ in c]) for n in self.sizes for c in combinations(self.items, n))

    def unique_sum(self, target: int, tolerance: int) -> tuple[list[str], int] | None:
        """The one combination within tolerance, with its sum: what ``unique_sum`` finds in the pool."""
        at = bisect.bisect_left(self.sums, (target - tolerance,))
        near = [(k, s) for s, k in self.sums[at : at + 2] if s <= target + tolerance]
        return near[0] if len(near) == 1 else None


def pool_pass(batches: DataFrame, credits: DataFrame, payments: DataFrame, partition: list[str], tolerance: int = TOLERANCE) -> DataFrame:
    """Aggregate (several batches in one credit; one batch in several credits) and subset passes, per partition.

    Inputs are what the earlier passes left, with the ``partition`` columns: batches (batch_key, net), credits
    (credit_id, amount), payments (payment_id, amount and, if known, batch_key: payments of a batch taken here leave).
    Every credit and batch is tried in id order against the pools, which are part of the passes' definition and refilled
    as ids are consumed; a partition (a tenant's account or run) is therefore one sequence and one task.
    """
    ship(batches.sparkSession)
    batch = F.col("batch_key").cast("string") if "batch_key" in payments.columns else F.lit(None).cast("string")
    tag = lambda df, kind, key, value, of: df.select(*partition, F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), F.col(value).cast("bigint").alias("value"), of.alias("of"))
    none = F.lit(None).cast("string")
    items = tag(batches, "b", "batch_key", "net", none).unionByName(tag(credits, "c", "credit_id", "amount", none)).unionByName(tag(payments, "p", "payment_id", "amount", batch))
    schema = ", ".join([*(f"{c} {dict(batches.dtypes)[c]}" for c in partition), "pass string, credits array<string>, members array<string>, residual bigint, confidence double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pick = lambda k: sorted(zip(pdf.loc[pdf.kind == k, "key"], pdf.loc[pdf.kind == k, "value"].astype(int), pdf.loc[pdf.kind == k, "of"]), key=lambda x: x[:2])
        b, c = ([x[:2] for x in pick(k)] for k in "bc")
        head = [pdf[x].iloc[0] for x in partition]
        out, gone = [], {"b": set(), "c": set()}
        conf = lambda r: 0.85 if abs(r) <= ROUNDING else 0.78
        pool = _Pool(b, BLOCK_POOL, (2, 3, 4))
        for cid, amount in c:
            if hit := pool.unique_sum(amount, tolerance):
                keys, r = hit[0], amount - hit[1]
                out.append([*head, "aggregate", [cid], keys, r, conf(r)])
                pool.take(keys)
                gone["b"].update(keys)
                gone["c"].add(cid)
        pool = _Pool([x for x in c if x[0] not in gone["c"]], CREDIT_POOL, (2, 3))
        for bid, net in [x for x in b if x[0] not in gone["b"]]:
            if hit := pool.unique_sum(net, tolerance):
                keys, r = hit[0], hit[1] - net
                out.append([*head, "split", keys, [bid], r, conf(r)])
                pool.take(keys)
                gone["c"].update(keys)
                gone["b"].add(bid)
        # A payment id can stand on several lines: each counts with its own amount, and all leave with their id.
        p = [x for x in pick("p") if x[2] not in gone["b"]]
        used: set[str] = set()
        pool = _Pool(((i, x[1]) for i, x in enumerate(p) if x[0] not in used), PAYMENT_POOL)
        for cid, amount in [x for x in c if x[0] not in gone["c"]]:
            hit = subset_sum(pool.items, amount, tolerance)
            if hit:
                keys, r = [p[i][0] for i in hit], amount - sum(p[i][1] for i in hit)
                out.append([*head, "subset", [cid], keys, r, max(AUTO, 0.9) if len(pool.items) <= EXACT_ITEMS else REVIEW])
                used.update(keys)
                pool.take([i for i, _ in pool.items if p[i][0] in used])
        return pd.DataFrame(out, columns=[*partition, "pass", "credits", "members", "residual", "confidence"])

    return items.groupBy(*partition).applyInPandas(run, schema)


def _amount_ranges(amount: Column) -> list[tuple[Column, Column]]:
    """Smallest and largest net of each amount level or a better one: exact, rounding, tolerance, one percent."""
    size, sign = F.abs(amount), F.when(amount < 0, -1).otherwise(1)
    inner = size - F.floor(size * 0.01)
    guess = F.floor(size / 0.99)
    fits = lambda n: n - size <= n * 0.01
    outer = F.greatest(size, *(F.when(fits(guess + i), guess + i) for i in (-2, -1, 0, 1, 2)))
    near, far = sign * inner, sign * outer
    wide = F.least(near, far, amount - TOLERANCE), F.greatest(near, far, amount + TOLERANCE)
    return [(amount, amount), (amount - ROUNDING, amount + ROUNDING), (amount - TOLERANCE, amount + TOLERANCE), wide]


def _smallest(df: DataFrame, k: int, *by: str) -> DataFrame:
    """The ``k`` smallest batch keys of each group; Spark cuts the groups before the shuffle as well."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("batch_key").cast("string")))).where(F.col("_n") <= k).drop("_n")


def fuzzy_top(batches: DataFrame, credits: DataFrame, k: int = 3, scale: float = 0.01) -> DataFrame:
    """The best candidates of each unmatched credit, at most ``k``, scored in bits; proposals, never matches.

    The credits have no reference that names a batch, so reference and id link count as ``none``; with a ``party`` on
    both sides, one bit more goes to batches of the credit's party. Every batch is ranked without crossing both sides.
    Pairs near in amount (1 % or tolerance) and days are met by slot and day. Of the others only the ``k`` smallest keys
    can enter, since any ``k`` batches of smaller key that agree as well or better go first: those of each day for
    batches far in amount, those of the level's range of amounts (put together from ranges of powers of two) for
    batches far in days, and those of all for batches far in both; the same once more within the credit's party.
    """
    by_party = "party" in batches.columns and "party" in credits.columns
    who = ["party"] if by_party else []
    c = credits.select("credit_id", "amount", "value_date", *who)
    b = batches.select("batch_key", "net", "settled_at", *who)
    slot = lambda v: F.signum(v) * F.floor(F.log(F.greatest(F.abs(v) / F.lit(100.0 * TOLERANCE), F.lit(1.0))) / scale)
    ranges = _amount_ranges(F.col("amount"))
    low, high = ranges[-1]
    days = c.withColumn("settled_at", F.explode(F.transform(F.sequence(F.lit(-WINDOW), F.lit(WINDOW)), lambda i: F.date_add("value_date", i))))
    slots = days.withColumn("slot", F.explode(F.sequence(slot(low).cast("bigint"), slot(high).cast("bigint"))))
    theirs = b.withColumnRenamed("party", "b_party") if by_party else b
    near = slots.join(theirs.withColumn("slot", slot(F.col("net")).cast("bigint")), ["settled_at", "slot"])

    # A range is cut into the largest aligned stretches inside it: at most two of each power of two.
    longest = c.select(F.max(F.greatest(*(h - w for w, h in ranges)))).first()[0] or 0
    powers = F.sequence(F.lit(0), F.lit(int(longest + 1).bit_length() - 1))
    place = lambda v, p: F.floor(v / F.pow(F.lit(2.0), p)).cast("bigint")
    inside = lambda p: (-place(-F.col("low"), p), place(F.col("high") + 1, p))
    cuts = c.withColumn("range", F.explode(F.array(*(F.struct(w.cast("bigint").alias("low"), h.cast("bigint").alias("high")) for w, h in ranges))))
    cuts = cuts.select(*c.columns, "range.*", F.explode(powers).alias("power"))
    (first, end), (first_up, end_up) = inside(F.col("power")), inside(F.col("power") + 1)
    cuts = cuts.where(first < end).withColumn("part", F.explode(F.array_distinct(F.array(first, end - 1))))
    up = place(F.col("part"), F.lit(1))
    cuts = cuts.where((up < first_up) | (up >= end_up)).select(*c.columns, "power", "part").distinct()
    placed = b.withColumn("power", F.explode(powers)).withColumn("part", place(F.col("net"), F.col("power")))

    bits = fs.weight({"amount": amount_level("amount", "net", ROUNDING, TOLERANCE), "date": date_level("value_date", "settled_at", WINDOW), "reference": F.lit("none"), "idlink": F.lit("none")})
    same = F.when(F.col("party") == F.col("b_party"), 1.0).otherwise(0.0) if by_party else F.lit(0.0)
    score = F.round(bits + same, 3).alias("score_bits")
    other = lambda df: df.withColumnRenamed("party", "b_party") if by_party else df
    own = lambda df: df.withColumn("b_party", F.col("party"))
    found = [near, days.join(other(_smallest(b, k, "settled_at")), "settled_at"), cuts.join(other(_smallest(placed, k, "power", "part")), ["power", "part"])]
    found.append(c.crossJoin(F.broadcast(other(b.orderBy(F.col("batch_key").cast("string")).limit(k)))))
    if by_party:
        found += [own(days.join(_smallest(b, k, "settled_at", "party"), ["settled_at", "party"]))]
        found += [own(cuts.join(_smallest(placed, k, "power", "part", "party"), ["power", "part", "party"])), own(c.join(_smallest(b, k, "party"), "party"))]
    scored = [x.select("credit_id", "batch_key", score) for x in found]
    best = scored[0]
    for x in scored[1:]:
        best = best.unionByName(x)
    best = best.groupBy("credit_id", "batch_key").agg(F.max("score_bits").alias("score_bits"))
    w = Window.partitionBy("credit_id").orderBy(F.desc("score_bits"), F.col("batch_key").cast("string"))
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def jaro_winkler(a: str | None, b: str | None) -> float:
    """Jaro-Winkler similarity with a prefix of at most four and weight 0.1; no threshold for the prefix bonus."""
    if a is None or b is None:
        return 0.0
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    left = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                left.append(x)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [y for y, t in zip(b, taken) if t]
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def _jaro_winkler_batches(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


def jaro_winkler_column(a: Column, b: Column) -> Column:
    """Arrow-batched; there is no built-in."""
    if spark := SparkSession.getActiveSession():
        ship(spark)
    return F.pandas_udf(_jaro_winkler_batches, "double")(a, b)


def reference_level(a: str, b: str) -> Column:
    """exact, jaro_hi (0.9), jaro_mid (0.7) or none on trimmed upper-case references; equality decides first."""
    x, y = F.upper(F.trim(F.col(a))), F.upper(F.trim(F.col(b)))
    s = jaro_winkler_column(x, y)
    return F.when(x == y, "exact").when(x.isNull() | y.isNull(), "none").when(s >= 0.9, "jaro_hi").when(s >= 0.7, "jaro_mid").otherwise("none")
