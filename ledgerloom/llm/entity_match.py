"""Matching rows of two tables without a shared key: scored candidate pairs, then loopy belief propagation.

Candidates come from blocking keys that each join a piece of the reference or of the name with the tenant and a narrow
band of the amount (a piece of the name also with a long stretch of days), so blocks stay small whoever the tenant or
counterparty is. Each pair gets a log-odds score; unlikely pairs stay in as rivals. One-to-one factors over lines and
records exchange messages until they settle, component by component of the pairs, and the marginal of a pair is its
confidence.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, opening_similarity, similarity, words
from ..tables import Latest, cut, ship, written

#: Channels and remarks in narrations, fees that banks take off (minor units and shares).
CHANNELS = r"^\s*(NEFT CR|RTGS CR|IMPS|UPI|NACH|ECS CR|CHQ DEP|BY TRF)\b[ /-]*"
REMARKS = r"\b(AGAINST BILL|PART|FINAL|ADV|THANKS|BILL NO|INVOICE|BILL|INV|REF|PO|SO|M/S|MESSRS|MS|DR|SMT|SHRI|MR|MRS)\b"
FIXED_FEES = [295, 590, 1180, 1770]
SHARE_FEES = [0.005, 0.01]

#: Width of an amount band (natural log). What may be missing from the amount at most: a share and a fixed part.
BAND, MOST_SHARE, MOST_FIXED = 0.02, 0.06, 3000
#: A pair that shares pieces of the name only lies within this many days; one that shares the reference in any.
NAME_DAYS = 120
#: Days after which a delay begins to count against a pair, and how much a day costs (up to a most).
USUAL_DAYS, LATE_DAY, LATE_MOST = 26, 0.15, 5.0

#: Log-odds of agreement and disagreement.
BIAS = -4.3
REF = {"equal": 7.5, "swapped": 4.0, "tail": 3.5, "other": -3.0, "none": 0.0}
AMOUNT = {"equal": 2.5, "fee": 1.0, "rounded": 1.0, "short": -4.0}
NAME_NEAR, NAME_CLOSE, NAME_OTHER = 4.0, 3.0, -5.0
#: Beside an equal reference (or its end) a name that looks different weighs less: it may be cut off or badly typed.
NAME_OTHER_REF = -1.5
OTHER_COMMON = -1.0

#: A word counts as common (a trade, a given name) in this share of distinct names, and in this many at least.
COMMON_SHARE, COMMON_LEAST = 0.008, 12

#: A connected component of at most this many contested pairs is settled in one task; how many pairs of small ones go together.
IN_TASK, TASK_PAIRS = 200_000, 20_000


def _days(c: Column) -> Column:
    return F.unix_date(c)


def parse_lines(bank_line: DataFrame) -> DataFrame:
    """Lines with amount in minor units, day, digits and words of the narration. Repeated lines count once.

    Lines without id, tenant, readable amount above zero or day cannot pay anything and are left out.
    """
    amount = F.try_to_number(F.regexp_replace(F.trim("amount"), r"^[+]|,", ""), F.lit("S9999999999999.99"))
    amount = F.coalesce(amount.cast("decimal(20,2)"), F.regexp_replace(F.trim("amount"), r"^[+]|,", "").try_cast("decimal(20,2)"))
    day = lambda c: F.coalesce(F.try_to_date(F.trim(c), "yyyy-MM-dd"), F.try_to_date(F.trim(c), "dd/MM/yyyy"))
    text = F.regexp_replace(fold(F.col("narration")), CHANNELS, "")
    lines = bank_line.select("bank_line_id", "org_id", (amount * 100).cast("bigint").alias("amount"), F.coalesce(day("value_date"), day("posted_date")).alias("day"), text.alias("text"))
    lines = lines.where("bank_line_id is not null and org_id is not null and amount > 0 and day is not null")
    lines = lines.groupBy("bank_line_id").agg(F.min(F.struct("org_id", "amount", "day", "text")).alias("r")).select("bank_line_id", "r.*")
    # The fiscal-year part of an invoice number is no part of its running number.
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"INV/?2\d{3}/?(?=\d)", "INV ")
    core = F.nullif(F.regexp_extract(plain, r"(?:INV|PO|SO|BILL NO|BILL|INVOICE|REF)[ /-]*(\d{6})(?!\d{2})", 1), F.lit(""))
    tail = F.regexp_replace(F.regexp_extract(plain, r"-\s*(\d[\d ]{2,7}\d)(?: [A-Z ]+)?$", 1), " ", "")
    tail = F.when(core.isNull() & (F.length(tail) >= 4), tail)
    core = F.coalesce(core, F.when(F.length(tail) == 6, tail))
    named = words(F.regexp_replace(F.regexp_replace(plain, r"[^\s/-]*\d[^\s/-]*", " "), REMARKS, " "), 1)
    return lines.withColumns({"core": core, "tail": tail, "name": named}).drop("text")


def parse_records(records: DataFrame) -> DataFrame:
    """Ledger Records as first arrived, with the running number of the reference and the words of the counterparty."""
    rows = records.where("source = 'ledger' and id is not null and org_id is not null and amount_minor > 0")
    row = F.struct("ingested_at", "org_id", "amount_minor", F.coalesce("value_date", "posted_date").alias("day"), "reference", "counterparty")
    rows = rows.groupBy("id").agg(F.min(row).alias("r")).select("id", "r.org_id", F.col("r.amount_minor").alias("amount"), "r.day", "r.reference", "r.counterparty")
    plain = F.regexp_replace(fold(F.coalesce("reference", F.lit(""))), r"INV/?2\d{3}/?(?=\d)", "INV ")
    core = F.nullif(F.regexp_extract(plain, r"(\d{6})", 1), F.lit(""))
    named = words(F.regexp_replace(F.regexp_replace(fold(F.col("counterparty")), r"[.'-]", ""), REMARKS, " "), 1)
    return rows.withColumns({"core": core, "name": F.coalesce(named, F.array().cast("array<string>"))}).drop("reference", "counterparty")


def common_words(records: DataFrame) -> list[str]:
    """Words in at least COMMON_SHARE of the distinct names: at most words-per-name / COMMON_SHARE of them, a few hundred."""
    names = records.select("name").distinct()
    n = names.count()
    per = names.select(F.explode(F.array_distinct("name")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return [r.w for r in per.where((F.col("n") >= max(COMMON_LEAST, n * COMMON_SHARE)) & (F.length("w") >= 3)).select("w").orderBy("w").collect()]


def _split(name: Column, common: list[str]) -> tuple[Column, Column]:
    """(rare words, common words): a cut-off or slightly misspelt common word counts as common too."""
    known = F.array(*(F.lit(w) for w in common)).cast("array<string>")
    is_common = lambda w: (
        (F.length(w) < 4) | F.array_contains(known, w) | F.exists(known, lambda k: F.startswith(k, w) | ((F.length(k) >= 5) & (F.abs(F.length(k) - F.length(w)) <= 2) & (F.levenshtein(k, w, 2) >= 0)))
    )
    return F.filter(name, lambda w: ~is_common(w)), F.filter(name, lambda w: is_common(w))


def _keys(df: DataFrame) -> tuple[Column, Column]:
    """Pieces of the reference and pieces of the name, of which a true pair shares at least one."""
    digits = F.array_join(F.array_sort(F.split("core", "")), "")
    last4 = F.right(F.coalesce("core", "tail") if "tail" in df.columns else F.col("core"), F.lit(4))
    ref = F.array(F.concat(F.lit("t"), digits), F.concat(F.lit("s"), last4))
    heads = F.transform("rare", lambda w: F.concat(F.lit("h"), F.left(w, F.lit(3))))
    tails = F.transform("rare", lambda w: F.concat(F.lit("e"), F.right(w, F.lit(3))))
    return F.array_compact(ref), F.array_distinct(F.concat(heads, tails))


def candidates(lines: DataFrame, records: DataFrame) -> DataFrame:
    """Distinct (bank_line_id, id) pairs that share tenant, a key and a band of the amount, and, sharing pieces of the
    name only, a stretch of days. A record without a day is met in every stretch."""
    band = lambda c: F.floor(F.log(c) / BAND)
    most = F.col("amount") / (1 - MOST_SHARE) + MOST_FIXED
    span = F.floor(_days(F.col("day")) / NAME_DAYS)
    both = lambda keys, spans: F.concat(F.transform(keys[0], lambda k: F.struct(k.alias("key"), F.lit(-2).cast("bigint").alias("span"))), F.flatten(F.transform(keys[1], lambda k: F.transform(spans, lambda s: F.struct(k.alias("key"), s.cast("bigint").alias("span"))))))
    block = F.xxhash64("org_id", "k.key", "k.span", "band").alias("block")
    left = lines.select("bank_line_id", "org_id", F.col("amount").alias("paid"), F.explode(both(_keys(lines), F.array(span, span - 1, F.lit(-1)))).alias("k"), F.sequence(band(F.col("amount")), band(most)).alias("bands"))
    left = left.withColumn("band", F.explode("bands")).select("bank_line_id", "paid", block)
    right = records.select("id", "org_id", F.col("amount").alias("due"), band(F.col("amount")).alias("band"), F.explode(both(_keys(records), F.array(F.coalesce(span, F.lit(-1))))).alias("k")).select("id", "due", block)
    return left.join(right, "block").where(amount_level(F.col("paid"), F.col("due")).isNotNull()).select("bank_line_id", "id").distinct()


def amount_level(paid: Column, due: Column) -> Column:
    """equal, fee (a usual fee is missing), rounded (less than one major unit is missing), short (anything up to the
    most that may be missing), else null."""
    gap = due - paid
    shares = [F.abs(gap - F.rint(due * s)) <= 1 for s in SHARE_FEES]
    share = shares[0]
    for s in shares[1:]:
        share = share | s
    usual = F.when(gap == 0, "equal").when(gap.isin(FIXED_FEES) | share, "fee").when((gap > 0) & (gap < 100), "rounded")
    return F.coalesce(usual, F.when((gap > 0) & (gap <= due * MOST_SHARE + MOST_FIXED), "short"))


def scored(pairs: DataFrame, lines: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs with their log-odds; pairs that break a hard rule (line before the order, other amount) are gone."""
    left = lines.select("bank_line_id", "org_id", F.col("amount").alias("paid"), F.col("day").alias("l_day"), F.col("core").alias("l_core"), "tail", F.col("rare").alias("l_rare"), F.col("usual").alias("l_usual"))
    right = records.select("id", F.col("org_id").alias("r_org"), F.col("amount").alias("due"), F.col("day").alias("r_day"), F.col("core").alias("r_core"), F.col("usual").alias("r_usual"), "glued", "pieces")
    x = pairs.join(left, "bank_line_id").join(right, "id").where(F.col("org_id") == F.col("r_org"))
    x = x.withColumn("level", amount_level(F.col("paid"), F.col("due"))).where("level is not null")
    x = x.withColumn("gap", F.datediff("l_day", "r_day")).where("gap is null or gap >= 0")
    sorted_ = lambda c: F.array_sort(F.split(c, ""))
    ref = (
        F.when(F.col("l_core") == F.col("r_core"), REF["equal"])
        .when((F.levenshtein("l_core", "r_core") <= 2) & ((F.levenshtein("l_core", "r_core") == 1) | (sorted_("l_core") == sorted_("r_core"))), REF["swapped"])
        .when(F.col("l_core").isNull() & F.endswith("r_core", F.col("tail")), REF["tail"])
        .when((F.col("l_core").isNotNull() | F.col("tail").isNotNull()) & F.col("r_core").isNotNull(), REF["other"])
        .otherwise(REF["none"])
    )
    near = lambda w, v: F.greatest(similarity(w, v), opening_similarity(w, v))
    best = lambda a, b: F.aggregate(a, F.lit(0.0), lambda m, w: F.greatest(m, F.aggregate(b, F.lit(0.0), lambda n, v: F.greatest(n, near(w, v)))))
    x = x.withColumn("near", F.when(F.exists("l_rare", lambda w: F.contains("glued", w)), F.lit(0.95)).otherwise(best(F.col("l_rare"), F.col("pieces"))))
    name = F.when(F.size("l_rare") == 0, 0.0).when(F.size("pieces") == 0, 0.0).when(F.col("near") >= 0.75, NAME_NEAR).when(F.col("near") >= 0.52, NAME_CLOSE).when(ref.isin(REF["equal"], REF["tail"]), NAME_OTHER_REF).otherwise(NAME_OTHER)
    initial = lambda a, b: F.exists(a, lambda w: F.exists(b, lambda v: (F.left(w, F.lit(1)) == F.left(v, F.lit(1)))))
    clash = (F.size("l_usual") > 0) & (F.size("r_usual") > 0) & ~initial(F.col("l_usual"), F.col("r_usual"))
    amount = F.lit(AMOUNT["short"])
    for level in ("equal", "fee", "rounded"):
        amount = F.when(F.col("level") == level, AMOUNT[level]).otherwise(amount)
    when = F.when(F.col("gap").isNull(), -0.5).otherwise(-F.least(F.lit(LATE_MOST), F.greatest(F.lit(0.0), (F.col("gap") - USUAL_DAYS) * F.lit(LATE_DAY))))
    x = x.withColumn("score", ref + name + amount + when + F.when(clash, OTHER_COMMON).otherwise(0.0) + F.lit(BIAS))
    return x.select("bank_line_id", "id", "score", "level", "gap", "near", ref.alias("ref_score"))


class NotSettledError(RuntimeError):
    """Messages still move after the last round."""


def propagate(pairs: DataFrame, left: str, right: str, score: str = "score", rounds: int = 300, tolerance: float = 1e-3, in_task: int = IN_TASK) -> DataFrame:
    """Marginals of one-to-one matching by sum-product belief propagation over ``pairs`` (left, right, score).

    Each row of either side takes part in one match at most. A pair without any rival has a closed form and sends no
    messages; the others exchange them until no message moves by ``tolerance``; if they still do after ``rounds``, that
    is a ``NotSettledError``, not a result. Messages stay within what pairs connect, so a component of up to ``in_task``
    pairs exchanges all of them in one task, until its own are settled: the driver plans nothing for a round, and slow
    components cost the others nothing. Larger components exchange messages by grouped sums and joins, round by round.
    Adds ``confidence`` in (0, 1) and ``rivals``, the other pairs of either end. Repeated pairs count once with their
    best score; pairs with a null id or score are left out.
    """
    ship(pairs.sparkSession)
    psi = F.exp(F.least(F.lit(30.0), F.greatest(F.lit(-30.0), F.col(score))))
    x = pairs.select(left, right, psi.alias("psi")).dropna().groupBy(left, right).agg(F.max("psi").alias("psi"))
    n_left = x.groupBy(left).agg(F.count(F.lit(1)).alias("n_left"))
    n_right = x.groupBy(right).agg(F.count(F.lit(1)).alias("n_right"))
    x = cut(x.join(n_left, left).join(n_right, right).withColumn("rivals", F.col("n_left") + F.col("n_right") - 2).drop("n_left", "n_right"))
    alone = x.where("rivals = 0").select(left, right, (F.col("psi") / (1 + F.col("psi"))).alias("confidence"), "rivals")
    live = x.where("rivals > 0").select(left, right, "psi", "rivals")
    if live.isEmpty():
        return alone
    live = written(_with_root(live, left, right), "p2-live")
    sizes = live.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    n, most = sizes.agg(F.sum("n"), F.max("n")).first()
    if most <= in_task:
        return alone.unionByName(_in_tasks(live, n, left, right, rounds, tolerance))
    large = cut(sizes.where(F.col("n") > in_task).select("root"))
    found = _in_tasks(live.join(large, "root", "left_anti"), n, left, right, rounds, tolerance)
    return alone.unionByName(found).unionByName(_by_rounds(live.join(large, "root", "left_semi"), left, right, rounds, tolerance))


def _with_root(live: DataFrame, left: str, right: str) -> DataFrame:
    """``live`` with ``root``, the same for all pairs of a connected component.

    Large-star and small-star steps over hashes of the ends, until every node points at the least one it reaches; their
    number goes with the logarithm of a component's width. Ends whose hashes coincide only make one component of two.
    """
    end = lambda side: F.xxhash64(F.lit(side == left), F.col(side))
    latest = Latest("p2-links")
    links = latest.keep(live.select(F.greatest(end(left), end(right)).alias("u"), F.least(end(left), end(right)).alias("v")).where("u > v").distinct())
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e")
    # A node that points at two others, or at one and is pointed at, is not done.
    while not links.select(ends).groupBy("e.node").agg(F.sum("e.up").alias("up"), F.count(F.lit(1)).alias("n")).where("up > 0 and n > 1").isEmpty():
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("least"))
        links = latest.keep(both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct())
        least = links.groupBy("u").agg(F.min("v").alias("least"))
        star = links.join(least.hint("merge"), "u").where("v > least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        links = latest.keep(star.unionByName(least.select("u", F.col("least").alias("v"))).distinct())
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root")).hint("merge")
    return live.withColumn("node", end(left)).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node")


def _in_tasks(live: DataFrame, n: int, left: str, right: str, rounds: int, tolerance: float) -> DataFrame:
    """Marginals of whole components, some TASK_PAIRS pairs of them at a time."""
    types = {f.name: f.dataType.simpleString() for f in live.schema}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("root", kind="stable")
        codes = (pd.factorize(rows[c])[0] for c in (left, right, "root"))
        confidence, moved = settle(*codes, rows["psi"].to_numpy(), rounds, tolerance)
        return rows[[left, right, "rivals"]].assign(confidence=confidence, moved=moved)

    bucket = F.pmod(F.xxhash64("root"), F.lit(math.ceil(n / TASK_PAIRS))).alias("bucket")
    found = live.groupBy(bucket).applyInPandas(run, f"`{left}` {types[left]}, `{right}` {types[right]}, rivals bigint, confidence double, moved double")
    found = written(found, "p2-found")
    if (found.agg(F.max("moved")).first()[0] or 0.0) >= tolerance:
        raise NotSettledError(f"messages still move after {rounds} rounds")
    return found.select(left, right, "confidence", "rivals")


def settle(l: np.ndarray, r: np.ndarray, component: np.ndarray, psi: np.ndarray, rounds: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """(marginal, last move) of each pair between ends ``l`` and ``r``, numbered from 0 and sorted by ``component``;
    a component stops once none of its messages moves by ``tolerance``."""
    nu, moved, at = np.ones(len(psi)), np.zeros(len(psi)), np.arange(len(psi))
    for _ in range(rounds):
        a, b, p, v = l[at], r[at], psi[at], nu[at]
        mu = p / (1 + np.maximum(0.0, np.bincount(a, p * v)[a] - p * v))
        new = 1 / (1 + np.maximum(0.0, np.bincount(b, mu)[b] - mu))
        nu[at], moved[at] = new, np.abs(new - v)
        starts = np.flatnonzero(np.diff(component[at], prepend=-1))
        most = np.repeat(np.maximum.reduceat(moved[at], starts), np.diff(starts, append=len(at)))
        at = at[most >= tolerance]
        if not len(at):
            break
    return psi * nu / (1 + np.bincount(l, psi * nu)[l]), moved


def _by_rounds(live: DataFrame, left: str, right: str, rounds: int, tolerance: float) -> DataFrame:
    """Marginals of components too large for one task, each exchange of messages written out."""
    latest = Latest("p2-rounds")
    live = live.select(left, right, "psi", "rivals", F.lit(1.0).alias("nu"))
    for _ in range(rounds):
        sums = live.groupBy(left).agg(F.sum(F.col("psi") * F.col("nu")).alias("s"))
        out = live.join(sums.hint("merge"), left).withColumn("mu", F.col("psi") / (1 + F.greatest(F.lit(0.0), F.col("s") - F.col("psi") * F.col("nu"))))
        back = out.groupBy(right).agg(F.sum("mu").alias("t"))
        new = 1 / (1 + F.greatest(F.lit(0.0), F.col("t") - F.col("mu")))
        live = latest.keep(out.join(back.hint("merge"), right).select(left, right, "psi", "rivals", new.alias("nu"), F.abs(new - F.col("nu")).alias("moved")))
        if (live.agg(F.max("moved")).first()[0] or 0.0) < tolerance:
            break
    else:
        raise NotSettledError(f"messages still move after {rounds} rounds")
    sums = live.groupBy(left).agg(F.sum(F.col("psi") * F.col("nu")).alias("s"))
    return live.join(sums.hint("merge"), left).select(left, right, (F.col("psi") * F.col("nu") / (1 + F.col("s"))).alias("confidence"), "rivals")


def match(bank_line: DataFrame, records: DataFrame) -> DataFrame:
    """(bank_line_id, record_id, confidence, rivals) of every candidate pair, by belief propagation.

    Nulls: a line without amount or day, a record without amount, and names or references that are null give no
    evidence, not an error. Repeated lines or records (same id) count once. Empty tables give an empty result.
    """
    lines, rows = parse_lines(bank_line), cut(parse_records(records))
    common = common_words(rows)
    rare, usual = _split(F.col("name"), common)
    lines = cut(lines.withColumns({"rare": rare, "usual": usual}).drop("name"))
    # A name may be split or run together, so words also count joined with their successor.
    n = F.size("name")
    pairs = F.when(n > 1, F.zip_with(F.slice("name", 1, n - 1), F.slice("name", 2, n - 1), lambda a, b: F.concat(a, b))).otherwise(F.array().cast("array<string>"))
    pieces = F.array_distinct(F.concat("name", pairs))
    rows = cut(rows.withColumns({"rare": rare, "usual": usual, "glued": F.array_join("name", ""), "pieces": pieces}).drop("name"))
    pairs = scored(candidates(lines, rows), lines, rows)
    # Below this score even an uncontested pair stays under a confidence of one in ten thousand, and as a rival it takes
    # as little from the others.
    kept = pairs.where(F.col("score") > -math.log(9999))
    return propagate(kept, "bank_line_id", "id").select("bank_line_id", F.col("id").alias("record_id"), "confidence", "rivals")
