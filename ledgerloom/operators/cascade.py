"""The whole matching cascade over one run: every pass reads what the passes before it left, and matches come out.

Keyed passes (exact, tolerant), then blocked, aggregate (both ways) and subset; what is left goes to the exceptions and
to the fuzzy proposals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import cut, written
from . import matching as M

MATCH = ["match_id", "match_pass", "batches", "payments", "credits", "residual", "confidence", "weight_bits"]


@dataclass
class Cascade:
    """What a run came to.

    ``matches``: one row per match with the ids of each side and ``status``. ``batches``: every batch with its keyed
    outcome, ``match_pass`` (null while open) and ``tied``, the residual of what it is matched with. ``credits``: every
    credit with ``match_pass``. ``payments``: ids that the subset pass took. ``blocked``: what the blocked pass paired.
    """

    matches: DataFrame
    batches: DataFrame
    credits: DataFrame
    payments: DataFrame
    blocked: DataFrame

    def open_batches(self) -> DataFrame:
        return self.batches.where("match_pass is null")

    def open_credits(self) -> DataFrame:
        """Unmatched credits without a reference that names a batch."""
        return self.credits.where("match_pass is null and not keyed")


def _text(*columns) -> F.Column:
    return F.array(*(F.col(c).cast("string") for c in columns)) if columns else F.array().cast("array<string>")


def status(matches: DataFrame) -> DataFrame:
    """``auto`` from the automatic threshold on, else ``low_confidence``; stored figures are rounded."""
    x = matches.withColumns({"confidence": F.round("confidence", 4), "weight_bits": F.round("weight_bits", 3)})
    return x.withColumn("status", F.when(F.col("confidence") >= M.AUTO, "auto").otherwise("low_confidence"))


def run(batches: DataFrame, credits: DataFrame, lines: DataFrame, ledger: DataFrame, pools: bool = True) -> Cascade:
    """The cascade over batches (see ``views.batch``), credits, processor lines and ledger totals.

    ``pools`` false stops after the blocked pass. The prior of a match is one over the number of batches. Nulls: a
    batch or credit without a day has no date level; a credit without amount ties nothing. Empty inputs give no match.
    """
    credits = written(credits.join(batches.select(F.col("batch_key").alias("utr")).distinct().withColumn("keyed", F.lit(True)), "utr", "left").na.fill(False, ["keyed"]), "credits")
    named = written(M.outcome(batches, credits, ledger), "outcomes")
    prior = 1.0 / max(1, named.count())
    one = lambda df, label, name: df.select(
        F.concat(F.lit("m_"), F.col("batch_key").cast("string")).alias("match_id"), F.lit(name).alias("match_pass"), _text("batch_key").alias("batches"), _text().alias("payments"), _text("credit_id").alias("credits"), "residual", "confidence", label.alias("weight_bits")
    )
    none = F.lit(None).cast("double")
    exact = one(named.where("outcome = 'exact'").withColumn("confidence", F.lit(1.0)), none, "exact")
    tolerant = one(M.tolerant_confidence(named.where("outcome = 'tolerant'"), prior), F.col("weight_bits"), "tolerant")

    free = named.where("outcome = 'no_credit'").select("batch_key", "net", "settled_at", "ledger_ok")
    orphan = credits.where("not keyed").select("credit_id", "amount", "value_date")
    pairs = M.blocked_confidence(M.amount_band_pairs(free, orphan)).where(F.col("confidence") >= M.REVIEW).withColumn("residual", F.col("amount") - F.col("net"))
    blocked = M.greedy(pairs, ["gap", "level"], "batch_key", "credit_id", ["residual", "confidence"])
    matches = exact.unionByName(tolerant).unionByName(one(blocked, none, "blocked"))

    if pools:
        part = F.lit("run").alias("part")
        done = named.where("outcome in ('exact', 'tolerant')").select("batch_key").unionByName(blocked.select("batch_key"))
        left = free.join(blocked, "batch_key", "left_anti").select(part, "batch_key", "net")
        lone = orphan.join(blocked, "credit_id", "left_anti").select(part, "credit_id", "amount")
        net = (F.col("amount") - F.col("fee") - F.col("tax")).alias("amount")
        pays = lines.where("kind = 'payment'").join(done, "batch_key", "left_anti").select(part, "payment_id", "batch_key", net).distinct()
        found = cut(M.pool_pass(left, lone, pays, ["part"]))
        subset = F.col("pass") == "subset"
        sides = {
            "match_id": F.concat(F.lit("m_"), F.when(F.col("pass") == "split", F.col("members")[0]).otherwise(F.concat(F.when(subset, "subset_").otherwise("agg_"), F.col("credits")[0]))),
            "match_pass": F.when(subset, "subset").otherwise("aggregate"),
            "batches": F.when(subset, _text()).otherwise(F.col("members")),
            "payments": F.when(subset, F.col("members")).otherwise(_text()),
            "weight_bits": none,
        }
        matches = matches.unionByName(found.withColumns(sides).select(*MATCH))

    matches = written(status(matches), "matches")
    took = matches.select(F.explode("batches").alias("batch"), "match_pass", F.when((F.col("match_pass") == "aggregate") & (F.size("batches") > 1), 0).otherwise(F.col("residual")).cast("bigint").alias("tied"))
    paid = matches.select(F.explode("payments").alias("payment_id")).distinct()
    # A batch of which the subset pass took a payment is matched in part: it is no open batch.
    parts = lines.join(paid, "payment_id", "left_semi").select(F.col("batch_key").alias("p_key")).distinct().withColumn("in_part", F.lit(True))
    out = named.join(took, named["batch_key"].cast("string") == took["batch"], "left").drop("batch").join(parts, F.col("batch_key") == F.col("p_key"), "left").drop("p_key")
    out = out.withColumn("match_pass", F.when(F.col("match_pass").isNull() & F.col("in_part"), "subset").otherwise(F.col("match_pass"))).drop("in_part")
    used = matches.select(F.explode("credits").alias("credit_id"), "match_pass")
    return Cascade(matches, written(out, "batches"), written(credits.join(used, "credit_id", "left"), "credits"), paid, blocked)
