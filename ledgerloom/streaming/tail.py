"""Following the event log as a stream: new events of the log's files, folded to the latest state per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def follow(spark: SparkSession, path: str, schema: StructType, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The running fold: per key its event count and the values of its last event (by ``order``). Update mode.

    Offsets are kept in the query's checkpoint, so a restarted query goes on after the last event it has seen.
    """
    events = spark.readStream.schema(schema).parquet(path)
    last = F.max(F.struct(*order, *[F.col(v).alias(f"_{v}") for v in values]))
    return events.groupBy(key).agg(last.alias("x"), F.count(F.lit(1)).alias("events")).select(key, "events", *(F.col(f"x.{c}").alias(f"at_{c}") for c in order), *(F.col(f"x._{v}").alias(v) for v in values))


def run_follow(stream: DataFrame, key: str, order: list[str], base: str) -> DataFrame:
    """Runs ``follow`` to the end of its present input; the current state per key from all upserts so far."""

    def sink(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/upserts/batch={batch_id}")

    q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    all_ = stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/upserts").drop("batch")
    at = [f"at_{c}" for c in order]
    rest = [c for c in stream.columns if c not in (key, *at, "events")]
    return all_.groupBy(key).agg(F.max(F.struct(*at, "events", *rest)).alias("x")).select(key, "x.events", *(f"x.{c}" for c in rest))
