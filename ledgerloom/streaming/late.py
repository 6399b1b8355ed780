"""Late and out-of-order events: per-period aggregates by event time, corrected until each period's cut-off.

``run_event_windows`` is the Structured Streaming operator. The windows are the periods; the clock is the arrival time
with a watermark; what a period still takes after its end is its allowed lateness (up to ``cutoff_at``). State keyed by
tenant, source and period emits updated aggregates as upserts and is evicted when the watermark passes the cut-off;
records after the cut-off are diverted into a table of their own. ``with_lateness`` gives the same in one batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scope of a period.
KEYS = ["org_id", "source", "period"]
#: How far out of order rows arrive at most: the delay of the watermark behind the arrival clock.
DISORDER = "30 days"


def period_of() -> Column:
    """yyyy-MM of the day a record is about: value_date, or settled_at where that is null."""
    return F.date_format(F.coalesce("value_date", "settled_at"), "yyyy-MM")


def first_arrivals(records: DataFrame, period: Column | None = None) -> DataFrame:
    """One row per id: the one that arrived first (ties: smaller load, then content), with its period.

    The reduction is an associative min over a struct, so it combines before the shuffle. Rows without an id or
    without any arrival time are no events and are left out; a record without both dates has a null period.
    """
    month = period_of() if period is None else period
    row = F.struct("ingested_at", "ingest_batch", "org_id", "source", month.alias("period"), "amount_minor", "fee_minor", "tax_minor")
    return records.where("id is not null and ingested_at is not null").groupBy("id").agg(F.min(row).alias("r")).select("id", "r.*")


def closes(period_close: DataFrame) -> DataFrame:
    """One closing row per (tenant, source, period): latest end and latest cut-off where repeated."""
    return period_close.groupBy(*KEYS).agg(F.max("ends_at").alias("ends_at"), F.max("cutoff_at").alias("cutoff_at"))


def with_lateness(records: DataFrame, period_close: DataFrame, period: Column | None = None) -> DataFrame:
    """Each id's first arrival with ``timing``: on_time (before the period's end), correction (until the cut-off),
    too_late (after it), open (no close is known for its period) or undated (neither date)."""
    timing = (
        F.when(F.col("period").isNull(), "undated")
        .when(F.col("cutoff_at").isNull(), "open")
        .when(F.col("ingested_at") > F.col("cutoff_at"), "too_late")
        .when(F.col("ingested_at") > F.col("ends_at"), "correction")
        .otherwise("on_time")
    )
    return first_arrivals(records, period).join(closes(period_close), KEYS, "left").withColumn("timing", timing)


def too_late(timed: DataFrame) -> DataFrame:
    """The diverted records: first arrival after the cut-off of the tenant, source and period."""
    return timed.where(F.col("timing") == "too_late")


def period_sums(timed: DataFrame) -> DataFrame:
    """Per tenant, source and period: the sums as first closed, as corrected by the cut-off, and what was too late.

    Sums are of amount_minor in signed minor units; null amounts count as 0 in sums and as rows in counts.
    """
    a = F.coalesce("amount_minor", F.lit(0))
    pick = lambda c, v: F.sum(F.when(c, v).otherwise(F.lit(0))).cast("bigint")
    first, kept, late = F.col("timing").isin("on_time", "open"), F.col("timing").isin("on_time", "open", "correction"), F.col("timing") == "too_late"
    one = F.lit(1)
    return (
        timed.where("period is not null")
        .groupBy(*KEYS)
        .agg(
            pick(first, one).alias("n_first_closed"),
            pick(first, a).alias("sum_first_closed"),
            pick(kept, one).alias("n_corrected"),
            pick(kept, a).alias("sum_corrected"),
            pick(late, one).alias("n_too_late"),
            pick(late, a).alias("sum_too_late"),
        )
    )


def open_batches(prior_batch: DataFrame, records: DataFrame) -> DataFrame:
    """What earlier periods left open, and whether a bank credit with its reference has arrived since.

    Repeated rows of ``prior_batch`` count once. Only references that are open go through the join: the credits are
    reduced to one row per reference first.
    """
    key = F.upper(F.trim("settlement_utr"))
    prior = prior_batch.groupBy(key.alias("settlement_utr"), "from_run_id", "period").agg(F.max("net_minor").alias("net_minor"))
    utr = F.upper(F.trim(F.element_at("external_ids", "utr")))
    credits = records.where("source = 'bank'").select(utr.alias("settlement_utr"), "ingested_at", "amount_minor", "id").where("settlement_utr is not null")
    credits = credits.groupBy("settlement_utr").agg(F.min(F.struct("ingested_at", "id", "amount_minor")).alias("c"))
    joined = prior.join(credits, "settlement_utr", "left")
    return joined.select("period", "settlement_utr", "from_run_id", "net_minor", F.col("c.ingested_at").alias("credited_at"), F.col("c.amount_minor").alias("credit_minor"), F.col("c").isNull().alias("still_open"))


class OutOfOrderError(ValueError):
    """Rows arrived further out of order than allowed, after the state of their period was gone."""


def _cutoff_key(closes_at: Column, disorder: str) -> Column:
    """``closes_at`` as the event time of a grouping key: its state goes when the arrival clock's watermark passes it."""
    amount, unit = disorder.split()
    millis = int(amount) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1000
    return closes_at.alias("closes_at", metadata={"spark.watermarkDelayMs": millis})


def dated(records: DataFrame, period_close: DataFrame) -> DataFrame:
    """Rows with id, arrival and period, and the end and cut-off of their tenant, source and period (null: open)."""
    rows = records.where("id is not null and ingested_at is not null").withColumn("period", period_of()).where("period is not null")
    rows = rows.select("id", *KEYS, "ingested_at", "ingest_batch", "amount_minor")
    return rows.join(closes(period_close), KEYS, "left")


def arrivals(rows: DataFrame, disorder: str) -> DataFrame:
    """Stage 1, native keyed state per id within its window: the earliest arrival, as of each micro-batch.

    ``first_seen`` is the micro-batch that saw the id first, ``r.seen_at`` the one that brought its earliest arrival and
    ``now`` the present one. A tenant with a third of all rows is spread over its ids.
    """
    row = F.struct("ingested_at", "ingest_batch", F.current_timestamp().alias("seen_at"), "amount_minor", "ends_at")
    x = rows.withWatermark("ingested_at", disorder).select("id", *KEYS, _cutoff_key(F.col("cutoff_at"), disorder), row.alias("row"))
    x = x.groupBy("id", *KEYS, "closes_at").agg(F.min("row").alias("r"), F.min("row.seen_at").alias("first_seen"))
    return x.withColumn("now", F.current_timestamp())


CHANGE = f"id string, {', '.join(k + ' string' for k in KEYS)}, closes_at timestamp, ingested_at timestamp, amount_minor bigint, corrected boolean, sign int"
SUMS = ["n_first_closed", "sum_first_closed", "n_corrected", "sum_corrected"]


def window_sums(changes: DataFrame, disorder: str) -> DataFrame:
    """Stage 2, keyed state per tenant, source and period: the sums as first closed and as corrected so far.

    Partial sums are made before the shuffle, so a hot period costs one row per task.
    """
    x = changes.withWatermark("ingested_at", disorder).select(*KEYS, _cutoff_key(F.col("closes_at"), disorder), "sign", F.coalesce("amount_minor", F.lit(0)).alias("a"), "corrected")
    pick = lambda c, v: F.sum(F.when(c, v * F.col("sign")).otherwise(0)).cast("bigint")
    first, all_ = ~F.col("corrected"), F.lit(True)
    sums = [pick(first, F.lit(1)), pick(first, F.col("a")), pick(all_, F.lit(1)), pick(all_, F.col("a"))]
    return x.groupBy(*KEYS, "closes_at").agg(*(s.alias(n) for s, n in zip(sums, SUMS)))


#: Settings for a checkpoint in a folder of the file system "file". Without native code, which Spark does not bring,
#: Hadoop launches a process there (readlink, chmod) for each link it looks for and each mode it sets: 20 a micro-batch
#: for every partition of the state, and until such a process starts its program it shares all memory of the executor
#: and is counted with it. FileSystem renames as atomically there and looks for no links; Hadoop's checksums are beside
#: the files already, so those that Spark adds are left out. That leaves 2.
LOCAL_FILES = {
    "spark.sql.streaming.checkpointFileManagerClass": "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager",
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
}


def _settings(spark: SparkSession, checkpoint: str) -> dict[str, str]:
    """Settings for the time of a stream with this checkpoint."""
    at = spark._jvm.org.apache.hadoop.fs.Path(checkpoint)
    local = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getUri().getScheme() == "file"
    return {"spark.sql.streaming.numRecentProgressUpdates": "1000000"} | (LOCAL_FILES if local else {})


def _drain(df: DataFrame, mode: str, checkpoint: str, sink) -> list[dict]:
    """Runs a stream to the end of its present input; returns what its state did, micro-batch by micro-batch."""
    spark = df.sparkSession
    settings = _settings(spark, checkpoint)
    kept = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
        query.awaitTermination()
        return [{"batch": p.batchId, "rows": p.numInputRows, "evicted": sum(o.numRowsRemoved for o in p.stateOperators), "dropped": sum(o.numRowsDroppedByWatermark for o in p.stateOperators)} for p in query.recentProgress]
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_event_windows(records: DataFrame, period_close: DataFrame, base: str, disorder: str = DISORDER) -> list[dict]:
    """Runs the stream over what ``records`` (a stream) has; ``period_close`` is static. Returns the state's progress.

    ``base`` is a folder that all executors share; a second run over the same folder goes on where the last ended, and a
    micro-batch that is replayed after a failure replaces its own output. Read the results with ``aggregates`` and
    ``diverted``. Arrival is out of order by at most ``disorder``: a row in time for a period whose state is gone
    raises ``OutOfOrderError`` rather than being lost. An id counts once per tenant, source and period.
    """
    spark = records.sparkSession
    rows = dated(records, period_close)
    in_time = F.col("cutoff_at").isNull() | (F.col("ingested_at") <= F.col("cutoff_at"))

    def keep(table: str):
        return lambda df, n: df.write.mode("overwrite").parquet(f"{base}/{table}/batch={n}")

    def changes(df: DataFrame, n: int) -> None:
        keep("arrivals")(df.where("first_seen = now or r.seen_at = now"), n)
        seen = spark.read.parquet(f"{base}/arrivals/batch={n}")
        row = lambda x, sign: x.select("id", *KEYS, "closes_at", "r.ingested_at", "r.amount_minor", F.coalesce(F.col("r.ingested_at") > F.col("r.ends_at"), F.lit(False)).alias("corrected"), F.lit(sign).alias("sign"))
        out = row(seen, 1)
        moved = seen.where("first_seen < now").select("id", *(F.col(k).alias(f"m_{k}") for k in KEYS)).withColumnRenamed("id", "m_id")
        if not moved.isEmpty():
            # An earlier arrival came in later: what the id counted for so far is taken back.
            before = spark.read.schema(CHANGE + ", batch int").parquet(f"{base}/changes").where(F.col("batch") < n)
            same = F.col("id") == F.col("m_id")
            for k in KEYS:
                same &= F.col(k).eqNullSafe(F.col(f"m_{k}"))
            before = before.join(moved, same, "left_semi")
            last = before.groupBy("id", *KEYS).agg(F.max(F.struct("batch", "sign", "closes_at", "ingested_at", "amount_minor", "corrected")).alias("b"))
            out = out.unionByName(last.select("id", *KEYS, "b.closes_at", "b.ingested_at", "b.amount_minor", "b.corrected", F.lit(-1).alias("sign")))
        out.write.mode("overwrite").parquet(f"{base}/changes/batch={n}")

    late = rows.where(~in_time).select("id", *KEYS, "ingested_at", "ingest_batch", "amount_minor", "cutoff_at")
    _drain(late, "append", f"{base}/state-late", keep("late"))
    progress = _drain(arrivals(rows.where(in_time), disorder), "update", f"{base}/state-arrivals", changes)
    feed = spark.readStream.schema(CHANGE + ", batch int").option("maxFilesPerTrigger", 10_000).parquet(f"{base}/changes")
    progress += _drain(window_sums(feed, disorder), "update", f"{base}/state-sums", keep("sums"))
    if lost := sum(p["dropped"] for p in progress):
        raise OutOfOrderError(f"{lost} rows arrived more than {disorder} out of order")
    return progress


def diverted(spark: SparkSession, base: str) -> DataFrame:
    """The records that came after the cut-off, by first arrival; a late repeat of a record that came in time is none."""
    late = spark.read.schema(f"id string, {', '.join(k + ' string' for k in KEYS)}, ingested_at timestamp, ingest_batch int, amount_minor bigint, cutoff_at timestamp").parquet(f"{base}/late")
    first = late.groupBy("id", *KEYS).agg(F.min(F.struct("ingested_at", "ingest_batch", "amount_minor", "cutoff_at")).alias("r")).select("id", *KEYS, "r.*")
    return first.join(spark.read.schema(CHANGE).parquet(f"{base}/changes").select("id", *KEYS), ["id", *KEYS], "left_anti")


def aggregates(spark: SparkSession, base: str) -> DataFrame:
    """The present aggregates: the last upsert of each tenant, source and period, beside what was diverted."""
    schema = f"{', '.join(k + ' string' for k in KEYS)}, closes_at timestamp, {', '.join(n + ' bigint' for n in SUMS)}, batch int"
    last = spark.read.schema(schema).parquet(f"{base}/sums").groupBy(*KEYS).agg(F.max(F.struct("batch", *SUMS)).alias("s")).select(*KEYS, *(f"s.{n}" for n in SUMS))
    late = diverted(spark, base).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_too_late"), F.sum(F.coalesce("amount_minor", F.lit(0))).alias("sum_too_late"))
    same = last["org_id"].eqNullSafe(late["org_id"]) & last["source"].eqNullSafe(late["source"]) & (last["period"] == late["period"])
    both = last.join(late, same, "full").select(*(F.coalesce(last[k], late[k]).alias(k) for k in KEYS), *SUMS, "n_too_late", "sum_too_late")
    return both.na.fill(0, [*SUMS, "n_too_late", "sum_too_late"])
