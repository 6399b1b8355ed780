"""Checking each new load against everything accepted before, by content and paragraph hashes in bucketed tables.

A record becomes a content hash over its normalised fields and one hash per field ("paragraph"). Two tables hold what
was accepted: ``keys``, bucketed by key, with the content hash and the rare paragraphs (order, payment, moment) of each
record, and ``paragraphs``, bucketed by id, with all its hashes. A load is joined with the keys bucket by bucket: equal
content hashes are full copies, equal rare paragraphs propose changed copies, and the share of all paragraphs that two
records agree in decides. Then the load's hashes are appended.

Both tables are also laid out by the month of the movement: another moment is another movement, so a load reads the
months it touches, and its cost follows its own size, not that of the history.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold
from ..tables import scratch, written

#: Amounts of copies differ by at most this (minor units); rare paragraphs are told apart by amount slots this wide.
AMOUNT_SLACK, SLOT = 5, 64
#: Share of the paragraphs present on both sides that copies share.
COVERAGE = 0.5
#: Buckets of each table; more for larger loads.
BUCKETS = 16
#: Month of records without a readable moment: they are checked against all months.
NO_MONTH = "none"
#: Weekly loads that a catch-up over a whole history checks at a time.
LOADS_PER_STEP = 8

FIELDS = ["moment", "order", "payment", "utr", "party", "day", "fee", "account"]
MOMENT, ORDER, PAYMENT = 0, 1, 2
HASHES = "id string, load int, amount bigint, month string, scope bigint, content bigint, paragraphs array<bigint>"
KEYS = "key bigint, id string, load int, amount bigint, month string"
FOUND = "new_id string, old_id string, full boolean, coverage double, new_load int, old_load int"


def _core(c: Column) -> Column:
    """The running number in an external id, without leading zeros, whatever prefix or suffix the export gave it."""
    return F.nullif(F.ltrim(F.regexp_extract(c, r"(\d{3,})", 1), F.lit("0")), F.lit(""))


def movement_hashes(records: DataFrame) -> DataFrame:
    """One row per id, as first arrived: amount, month, content hash, paragraph hashes (null where a field is empty).

    Records without id, tenant, load or amount are left out.
    """
    ext = lambda k: F.element_at("external_ids", k)
    first = F.struct(
        "ingested_at",
        F.col("ingest_batch").cast("int").alias("load"),
        "org_id",
        "kind",
        F.col("amount_minor").alias("amount"),
        F.nullif(F.trim(F.element_at("raw", "settled_at")), F.lit("")).alias("moment"),
        _core(ext("order_id")).alias("order"),
        _core(ext("payment_id")).alias("payment"),
        F.nullif(F.upper(F.trim(ext("settlement_utr"))), F.lit("")).alias("utr"),
        F.nullif(F.regexp_replace(fold(F.coalesce("counterparty", F.lit(""))), "[^A-Z]", ""), F.lit("")).alias("party"),
        F.col("value_date").cast("string").alias("day"),
        F.abs("fee_minor").cast("string").alias("fee"),
        F.nullif(F.trim(ext("account_no")), F.lit("")).alias("account"),
    )
    rows = records.where("source = 'processor_recon' and id is not null").groupBy("id").agg(F.min(first).alias("r")).select("id", "r.*")
    rows = rows.where("org_id is not null and load is not null and amount is not null")
    paragraphs = F.array(*(F.when(F.col(f).isNotNull(), F.xxhash64(F.lit(f), f)) for f in FIELDS))
    day = F.to_date(F.timestamp_seconds(F.when(F.regexp_like("moment", F.lit(r"^\d{9,10}$")), F.col("moment").cast("bigint"))))
    out = rows.withColumns({"month": F.coalesce(F.date_format(day, "yyyyMM"), F.lit(NO_MONTH)), "scope": F.xxhash64("org_id", "kind")})
    return out.withColumns({"content": F.xxhash64("scope", "amount", *FIELDS), "paragraphs": paragraphs}).select(*(c.split()[0] for c in HASHES.split(", ")))


def _keys(hashes: DataFrame, probe: bool) -> DataFrame:
    """The keys of each record: its content hash, and its order, payment and moment with the slot of the amount.

    A moment alone may be that of very many movements. Two records can only be one movement if they agree in the order
    or the payment, or if each of the two is missing on a side; so a moment meets such counterparts only: it is tagged
    with what else the record has, and probed with the tags that can do without.
    """
    place = lambda v: F.floor(v / SLOT)
    slots = F.array_distinct(F.array(place(F.col("amount") - AMOUNT_SLACK), place(F.col("amount") + AMOUNT_SLACK))) if probe else F.array(place(F.col("amount")))
    x = hashes.withColumns({"slots": slots, "m": F.col("paragraphs")[MOMENT], "o": F.col("paragraphs")[ORDER], "p": F.col("paragraphs")[PAYMENT]})
    has = F.when(F.col("o").isNotNull(), 1).otherwise(0) + F.when(F.col("p").isNotNull(), 2).otherwise(0)
    tags = F.array(has) if not probe else F.when(has == 0, F.array(*map(F.lit, (0, 1, 2, 3)))).when(has == 1, F.array(F.lit(0), F.lit(2))).when(has == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    marks = F.array_compact(F.concat(F.array(F.xxhash64(F.lit("o"), "o"), F.xxhash64(F.lit("p"), "p")), F.transform(tags, lambda t: F.xxhash64(F.lit("m"), t, "m"))))
    marks = F.filter(marks, lambda k: ~((k == F.xxhash64(F.lit("o"), "o")) & F.col("o").isNull()) & ~((k == F.xxhash64(F.lit("p"), "p")) & F.col("p").isNull()))
    marks = F.when(F.col("m").isNotNull(), marks).otherwise(F.slice(marks, 1, F.greatest(F.lit(0), F.size(marks) - F.size(tags))))
    rare = F.flatten(F.transform(marks, lambda k: F.transform("slots", lambda s: F.xxhash64("scope", k, s))))
    return x.select(F.explode(F.concat(F.array("content"), rare)).alias("key"), "id", "load", "amount", "month")


def repeats(met: DataFrame, new: DataFrame, old: DataFrame) -> DataFrame:
    """Of the pairs ``met`` (new_id, old_id), those that are one movement, with whether in full and their coverage."""
    x = met.join(new.select(F.col("id").alias("new_id"), F.col("load").alias("new_load"), F.col("paragraphs").alias("n"), F.col("content").alias("n_content")), "new_id")
    x = x.join(old.select(F.col("id").alias("old_id"), F.col("load").alias("old_load"), F.col("paragraphs").alias("o"), F.col("content").alias("o_content")), "old_id")
    count = lambda test: F.aggregate(F.zip_with("n", "o", test), F.lit(0), lambda m, t: m + F.coalesce(t.cast("int"), F.lit(0)))
    both, shared = count(lambda p, q: p.isNotNull() & q.isNotNull()), count(lambda p, q: p == q)
    differ = lambda k: F.coalesce(F.col("n")[k] != F.col("o")[k], F.lit(False))
    alike = lambda k: F.coalesce(F.col("n")[k] == F.col("o")[k], F.lit(False))
    # Another moment is another movement; so is another order or payment, unless the other of the two agrees.
    x = x.where(~differ(MOMENT) & (alike(ORDER) | alike(PAYMENT) | ~(differ(ORDER) | differ(PAYMENT))))
    x = x.withColumn("coverage", shared / F.greatest(both, F.lit(1))).withColumn("full", F.col("n_content") == F.col("o_content"))
    return x.where(F.col("full") | (F.col("coverage") >= COVERAGE)).select(*(c.split()[0] for c in FOUND.split(", ")))


class AcceptedHashes:
    """The bucketed hash tables of everything accepted, below a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        name = uuid.uuid4().hex
        self.keys, self.paragraphs = (self._table(f"accepted_{t}_{name}", t, columns, by) for t, columns, by in (("keys", KEYS, "key"), ("paragraphs", HASHES, "id")))

    def _table(self, name: str, folder: str, columns: str, by: str) -> str:
        place = f"{self.path}/{folder}".replace("'", "\\'")
        self.spark.sql(f"create table {name} ({columns}) using parquet partitioned by (month) clustered by ({by}) into {self.buckets} buckets location '{place}'")
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        if at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            # What an earlier session wrote there.
            self.spark.sql(f"alter table {name} recover partitions")
        return name

    def close(self) -> None:
        """Forgets the tables in this session; their files stay."""
        for name in (self.keys, self.paragraphs):
            self.spark.sql(f"drop table if exists {name}")

    def _append(self, df: DataFrame, name: str, by: str) -> None:
        order = self.spark.table(name).columns
        df.select(*order).repartition(self.buckets, by).write.mode("append").insertInto(name)

    def check(self, new: DataFrame, months: list[str]) -> DataFrame:
        """Pairs of ``new`` (hashes of one or several loads) with what is accepted, and within it across its loads."""
        probe = _keys(new, True).select("key", F.col("id").alias("new_id"), F.col("load").alias("n_load"), F.col("amount").alias("n_amount"))
        whole = NO_MONTH in months
        pick = lambda name: self.spark.table(name) if whole else self.spark.table(name).where(F.col("month").isin([*months, NO_MONTH]))
        seen = pick(self.keys).select("key", F.col("id").alias("old_id"), F.col("load").alias("o_load"), F.col("amount").alias("o_amount"))
        met = probe.join(seen, "key").where(F.abs(F.col("n_amount") - F.col("o_amount")) <= AMOUNT_SLACK).where("n_load <> o_load").select("new_id", "old_id").distinct()
        return repeats(met, new, pick(self.paragraphs))

    def check_and_append(self, new: DataFrame, months: list[str] | None = None) -> DataFrame:
        """Repeats in ``new`` (see ``movement_hashes``) of what was accepted before; then its hashes are appended.

        An id that is accepted already, delivered again, is neither reported nor appended again: it meets itself by its
        content. Several loads may come at once; they are appended first and then also meet each other.
        """
        months = [r[0] for r in new.select("month").distinct().collect()] if months is None else months
        known = self.spark.table(self.keys).where(F.col("month").isin(months)).select("key", "id")
        again = new.select(F.col("content").alias("key"), "id").join(known, ["key", "id"], "left_semi").select("id")
        fresh = written(new.join(again, "id", "left_anti"), "fresh")
        several = fresh.select("load").distinct().limit(2).count() > 1
        found = None if several else written(self.check(fresh, months), "repeats")
        self._append(_keys(fresh, False), self.keys, "key")
        self._append(fresh, self.paragraphs, "id")
        return written(self.check(fresh, months).where("new_load > old_load"), "repeats") if found is None else found


def all_repeats(records: DataFrame, per_step: int = LOADS_PER_STEP) -> DataFrame:
    """Every pair of ids that is one movement in two different loads, found load after load in the order of loads.

    (record_a, record_b, full, coverage, load, later) with record_a < record_b; ``later`` is the id that came with the
    later load ``load``.
    ``per_step`` loads are checked at a time, which changes the cost and not the result. Nulls: a null field is no
    paragraph and neither agrees nor disagrees. Repeated deliveries of an id count as its first arrival. An empty table
    gives no pairs. The loads and their months come to the driver: numbers of weeks and of months.
    """
    spark = records.sparkSession
    base = scratch(spark, "history")
    # A load may be very large, so it is spread over a few tasks.
    movement_hashes(records).repartition("load", F.pmod(F.xxhash64("id"), F.lit(4))).write.partitionBy("load").parquet(f"{base}/loads")
    hashes = spark.read.schema(HASHES).parquet(f"{base}/loads")
    months: dict[int, list[str]] = {}
    for r in hashes.select("load", "month").distinct().collect():
        months.setdefault(r["load"], []).append(r["month"])
    loads = sorted(months)
    store = AcceptedHashes(spark, f"{base}/accepted")
    found = None
    try:
        for k in range(0, len(loads), per_step):
            step = loads[k : k + per_step]
            new = hashes.where(F.col("load").isin(step))
            part = store.check_and_append(new, sorted({m for n in step for m in months[n]}))
            found = part if found is None else found.unionByName(part)
    finally:
        store.close()
    found = spark.createDataFrame([], FOUND) if found is None else found
    a, b = F.least("new_id", "old_id"), F.greatest("new_id", "old_id")
    return found.select(a.alias("record_a"), b.alias("record_b"), "full", "coverage", F.col("new_load").alias("load"), F.col("new_id").alias("later"))
