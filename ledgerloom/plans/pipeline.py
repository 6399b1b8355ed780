"""The stages of a run, each written out and read again: load, normalise, decompose, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.normalize import normalize
from ..sources import quarantine as Q
from ..tables import table, written


@dataclass
class Run:
    """What a run leaves behind."""

    records: DataFrame
    quarantined: DataFrame
    per_file: DataFrame
    batches: DataFrame


def staged(df: DataFrame, base: str | None, name: str) -> DataFrame:
    """The result of a stage: written once below ``base`` and read from there by any later run; without it, for now."""
    if base is None:
        return written(df, name)
    spark, path = df.sparkSession, f"{base.rstrip('/')}/{name}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def run(spark: SparkSession, sf_dir: str, run_id: str = "run-1", base: str | None = None) -> Run:
    """Raw rows to records and settlement batches. Stage results are durable, so a lost executor repeats one stage; with
    ``base``, a folder of this run in shared storage, a run that broke off goes on after its last whole stage."""
    files = table(spark, sf_dir, "source_file").where("header is not null")
    rates = table(spark, sf_dir, "fx_rate")
    rows = staged(Q.classify_rows(table(spark, sf_dir, "raw_line"), files, rates), base, "rows")
    made = staged(normalize(Q.loaded(rows), files, rates, run_id), base, "records")
    bad = made.where("error is not null").select("line_id", F.col("ingest_file_hash").alias("file_hash"), F.lit(None).cast("int").alias("line_no"), F.col("error").alias("reason"), F.to_json("raw").alias("raw"))
    # A repeat is a row equal in tenant, source and content; its copies differ in file and row number only.
    records = made.where("error is null").dropDuplicates(["org_id", "source", "content"]).drop("error", "line_id", "content")
    utr = F.element_at("external_ids", "settlement_utr")
    batches = (
        records.where("source = 'processor_recon'")
        .groupBy("org_id", utr.alias("settlement_utr"))
        .agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("amount_minor") - F.col("fee_minor") - F.col("tax_minor")).alias("expected_minor"), F.max("settled_at").alias("settled_at"))
        .where("settlement_utr is not null")
    )
    return Run(records, Q.quarantined(rows).unionByName(bad), Q.per_file(rows), batches)
