"""Append-only event log: ordered hash chain, verification, fold to the latest state, purge, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical(*columns: str) -> Column:
    """Canonical JSON of the columns: keys sorted, nulls kept, no blanks."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"})


def sequenced(events: DataFrame, run: str, order: list[str]) -> DataFrame:
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(run).orderBy(*order)))


def chain(events: DataFrame, run: str, order: list[str], kind: str, payload: str) -> DataFrame:
    """(run, seq, kind, payload, prev_hash, hash): each hash covers its predecessor's.

    The fold is sequential within a run by definition, so a run is one row's array while it is chained: about 200
    bytes per event. Runs are independent and spread over tasks.
    """
    items = events.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(kind).alias("k"), F.col(payload).alias("p")))).alias("e"))
    step = lambda acc, x: F.concat(acc, F.array(F.sha2(F.concat_ws("|", F.element_at(acc, -1), x["k"], x["p"]), 256)))
    hashed = items.withColumn("h", F.aggregate("e", F.array(F.lit("")), step))
    rows = hashed.select(run, F.posexplode(F.zip_with("e", F.slice("h", 2, F.size("e")), lambda e, h: F.struct(e["k"].alias("kind"), e["p"].alias("payload"), h.alias("hash")))).alias("i", "x"))
    rows = rows.select(run, (F.col("i") + 1).alias("seq"), "x.*")
    return rows.withColumn("prev_hash", F.coalesce(F.lag("hash").over(Window.partitionBy(run).orderBy("seq")), F.lit("")))


def verify(chained: DataFrame, run: str) -> DataFrame:
    """Per run: number of events, whether the chain holds and the first seq at which it breaks."""
    w = Window.partitionBy(run).orderBy("seq")
    expected = F.sha2(F.concat_ws("|", "prev_hash", "kind", "payload"), 256)
    bad = (F.col("prev_hash") != F.coalesce(F.lag("hash").over(w), F.lit(""))) | (F.col("hash") != expected)
    x = chained.withColumn("bad", bad)
    return x.groupBy(run).agg(F.count(F.lit(1)).alias("events"), (~F.max("bad")).alias("ok"), F.min(F.when(F.col("bad"), F.col("seq"))).alias("first_break"))


def latest(events: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Fold by last write: per key the values of its last event, and how many events it had."""
    return events.groupBy(key).agg(F.max(F.struct(*order, *[F.col(v).alias(f"_{v}") for v in values])).alias("x"), F.count(F.lit(1)).alias("events")).select(key, "events", *(F.col(f"x._{v}").alias(v) for v in values))


def counts_by(records: DataFrame, by: str) -> DataFrame:
    return records.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("id").alias("ids"))


def without_run(events: DataFrame, run: str, purged: DataFrame) -> DataFrame:
    """The log without the purged runs."""
    return events.join(purged.select(run).distinct(), run, "left_anti")


def append(events: DataFrame, path: str, partitions: list[str]) -> None:
    """Appends to a partitioned columnar log; readers prune by the partition columns."""
    events.write.mode("append").partitionBy(*partitions).parquet(path)


def scan(events: DataFrame, *runs: Column, by: str, order: list[str]) -> DataFrame:
    """The events that fall under any of the conditions ``runs``, numbered from 1 within ``by`` in ``order``.

    The conditions reach the scan; a run is one sequence, so it is one window.
    """
    wanted = runs[0]
    for c in runs[1:]:
        wanted = wanted | c
    return events.where(wanted).withColumn("seq", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def validated(events: DataFrame, kind: str, payload: str, schemas: dict[str, str]) -> DataFrame:
    """``events`` with ``refused``: why an append would not take one, or null.

    ``schemas`` names the known types and the fields of their payloads as "name type, ..."; a field that is missing or
    of another type is named. A null or unreadable payload has no object.
    """
    why = F.when(~F.coalesce(F.col(kind).isin(list(schemas)), F.lit(False)), "unknown type").when(F.get_json_object(payload, "$").isNull(), "no object")
    for name, fields in schemas.items():
        for f in fields.split(","):
            field, type_ = f.split()
            fits = F.get_json_object(payload, f"$.{field}").try_cast(type_).isNotNull()
            why = why.when((F.col(kind) == name) & ~fits, f"field {field}")
    return events.withColumn("refused", why)
