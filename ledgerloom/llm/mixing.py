"""Mixing sources to target shares: Sainte-Laguë apportionment of equal-token blocks, then seeded selection.

The budget is the token count of all documents. It is cut into blocks of BLOCK tokens, which go one after the other to
the source with the highest quotient weight / (2 * blocks + 1). What a source may give is bounded by its tokens times
its cap of repeats; blocks it cannot give go on to the next quotient. Within a source the quota is spread over shards
by the same rule, in whole blocks. A shard's documents, in a seeded order, form blocks of equal tokens, and a seeded
permutation of the block numbers says which of them the quota takes.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of a block, shards per source, file of the public tokenizer in its folder.
BLOCK, SHARDS, TOKENIZER, TOKENIZERS = 256, 16, "byte_bpe_50k.json", "/opt/tokenizers"


def sainte_lague(weights: dict[str, float], seats: int, caps: dict[str, int] | None = None) -> dict[str, int]:
    """Integer seats by highest quotients; no party gets more than its cap. Ties go to the smaller name.

    Parties with weight zero or less, or null, get nothing. If all caps are reached, seats stay unassigned.
    """
    caps = caps or {}
    won = {k: 0 for k in weights}
    total = sum(w for w in weights.values() if w and w > 0)
    if not total or seats <= 0:
        return won
    # Start just below each party's exact share, where it is entitled to be, and deal the rest out one by one.
    for k, w in weights.items():
        if w and w > 0:
            won[k] = min(max(0, int(seats * w / total) - 1), caps.get(k, seats))
    left = seats - sum(won.values())
    heap = [(-w / (2 * won[k] + 1), k) for k, w in weights.items() if w and w > 0 and won[k] < caps.get(k, seats)]
    heapq.heapify(heap)
    while left > 0 and heap:
        _, k = heapq.heappop(heap)
        won[k] += 1
        left -= 1
        if won[k] < caps.get(k, seats):
            heapq.heappush(heap, (-weights[k] / (2 * won[k] + 1), k))
    return won


def with_tokens(documents: DataFrame, tokenizer: str = TOKENIZER, folder: str = TOKENIZERS) -> DataFrame:
    """``documents`` with ``tokens``, counted by a public tokenizer over the whole text; null texts have none.

    Very long texts are encoded in pieces at line or word ends, so no piece makes the tokenizer slow.
    """

    @F.pandas_udf("bigint")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(f"{folder.rstrip('/')}/{tokenizer}")
        t.encode_special_tokens = True
        for s in texts:
            pieces, owner = [], []
            for i, x in enumerate(s):
                while x:
                    end = len(x) if len(x) <= 100_000 else max(x.rfind(" ", 1, 100_000), 1)
                    end = 100_000 if end == 1 < len(x) and len(x) > 100_000 else end
                    pieces.append(x[:end])
                    owner.append(i)
                    x = x[end:]
            n = [0] * len(s)
            for i, e in zip(owner, t.encode_batch(pieces, add_special_tokens=False)):
                n[i] += len(e.ids)
            yield pd.Series(n, dtype="int64")

    return documents.withColumn("tokens", count("text"))


PLAN = "source string, shard int, full bigint, some bigint, size bigint, width double, step bigint, start bigint"


def permutation(n: int, seed: str) -> tuple[int, int]:
    """(step, start) such that k -> (k * step + start) % n is a seeded permutation of 0..n-1."""
    draw = int.from_bytes(hashlib.sha256(seed.encode()).digest()[:8], "big")
    step = draw % n or 1
    while math.gcd(step, n) != 1:
        step += 1
    return step, (draw >> 20) % n


def mix(documents: DataFrame, targets: DataFrame, seed: int = 17, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """(doc_id, source, tokens, times): how often each document is used to reach the target shares.

    ``documents`` has doc_id, source and tokens; ``targets`` source, target_share, max_repeats (one row per source, a
    table the size of the list of sources). A shard whose quota is n times its blocks uses each floor(n) times and a
    seeded choice of blocks once more; a document is not split, so a block may miss its tokens by one document at either
    end. Documents without tokens, id or source, and sources without a target, are not used. Repeated rows of a
    document count once. A null or non-positive max_repeats means the source gives nothing.
    """
    docs = documents.select("doc_id", "source", "tokens").where("doc_id is not null and source is not null and tokens > 0").groupBy("doc_id").agg(F.min(F.struct("source", "tokens")).alias("r")).select("doc_id", "r.*")
    docs = docs.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(shards)).cast("int"))
    # One row per source and shard comes to the driver: sources times SHARDS, however many documents there are.
    sizes = docs.groupBy("source", "shard").agg(F.sum("tokens").alias("tokens")).collect()
    want = {r["source"]: (float(r["target_share"] or 0), max(0, int(r["max_repeats"] or 0))) for r in targets.select("source", "target_share", "max_repeats").where("source is not null").collect()}
    have: dict[str, dict[int, int]] = {}
    for r in sizes:
        have.setdefault(r["source"], {})[r["shard"]] = r["tokens"]
    total = sum(t for s in have.values() for t in s.values())
    # A shard's tokens form as many equal blocks as come nearest to the block size.
    sizes = {s: {k: max(1, round(v / block)) for k, v in own.items()} for s, own in have.items()}
    caps = {s: sum(sizes.get(s, {}).values()) * m for s, (_, m) in want.items()}
    quota = sainte_lague({s: w for s, (w, _) in want.items()}, max(1, round(total / block)), caps)
    rows = []
    for s, blocks in sorted(quota.items()):
        own, size = have.get(s, {}), sizes.get(s, {})
        # Shard quotas in proportion to what the shards hold, by the same rule; a shard gives its blocks in whole.
        parts = sainte_lague({str(k): float(v) for k, v in own.items()}, blocks, {str(k): n * want[s][1] for k, n in size.items()})
        for k, n in size.items():
            full, some = divmod(parts[str(k)], n)
            step, start = permutation(n, f"{seed}/{s}/{k}")
            rows.append((s, k, full, some, n, own[k] / n, step, start))
    plan = documents.sparkSession.createDataFrame(rows, PLAN) if rows else documents.sparkSession.createDataFrame([], PLAN)
    # The place of a document in its shard's seeded order, in tokens. Shards are split further by a coarse range of the
    # order, whose sums come first, so no task sorts a whole shard.
    order = F.xxhash64(F.lit(seed + 1), "doc_id")
    placed = docs.join(F.broadcast(plan), ["source", "shard"]).withColumn("at", order).withColumn("slice", F.shiftright("at", 56))
    ahead = placed.groupBy("source", "shard", "slice").agg(F.sum("tokens").alias("slice_tokens"))
    ahead = ahead.withColumn("before", F.coalesce(F.sum("slice_tokens").over(Window.partitionBy("source", "shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy("source", "shard", "slice").orderBy("at", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = placed.join(ahead.select("source", "shard", "slice", "before"), ["source", "shard", "slice"]).withColumn("middle", F.col("before") + F.sum("tokens").over(w) - F.col("tokens") / 2)
    # A document belongs to the block that its middle lies in.
    number = F.least(F.floor(F.col("middle") / F.col("width")), F.col("size") - 1)
    chosen = (number * F.col("step") + F.col("start")) % F.col("size") < F.col("some")
    used = ranked.withColumn("times", (F.col("full") + F.when(chosen, 1).otherwise(0)).cast("int"))
    return used.where("times > 0").select("doc_id", "source", "tokens", "times")


def shares(mixed: DataFrame, documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: target and reached share, tokens held and used, documents used and the most repeats of one."""
    held = documents.where("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("tokens_held"))
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("times")).alias("tokens_used"), F.count(F.lit(1)).alias("documents_used"), F.max("times").alias("most_repeats"))
    both = targets.select("source", "target_share", "max_repeats").join(held, "source", "left").join(used, "source", "left").na.fill(0, ["tokens_held", "tokens_used", "documents_used", "most_repeats"])
    all_used = mixed.agg(F.sum(F.col("tokens") * F.col("times")).alias("_all"))
    # One row beside every source: a scalar, not a product of two tables.
    return both.join(F.broadcast(all_used), F.lit(True)).withColumn("reached_share", F.round(F.col("tokens_used") / F.col("_all"), 6)).drop("_all")
