"""Table access, durable cut points and small plan helpers shared by every operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Temporary folders of local sessions without a shared one, by application.
_LOCAL: dict[str, str] = {}


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application: their Python need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="ledgerloom-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(archive)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``name`` below ``sf_dir`` (a file or a directory of part files)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; on a local session without it, a temporary one.

    On a cluster without the setting there is no safe choice, so that is an error rather than a machine-local folder.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="ledgerloom-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return _LOCAL[app]


#: Files of results made on the way, removed when the process ends.
_MADE: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration() if spark._jsc is None else spark._jsc.hadoopConfiguration()).delete(at, True)


def _sweep() -> None:
    for spark, path in _MADE:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone already; what is left is the folder owner's to clear
            return


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared folder; what is written there is removed when this process ends."""
    if not _MADE:
        atexit.register(_sweep)
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from there; lost executors then cost no recomputation.

    A checkpoint still carries the size estimate and the constraints of the plan that made it. In a loop each round's
    estimates and constraints build on the last one's, so the driver's time and memory would multiply by the round; the
    result here starts afresh from the written rows.
    """
    spark = df.sparkSession
    where = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    done = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), spark)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as columnar files in the shared folder and read it back.

    Unlike ``cut`` the copy is compressed and column-pruned on read, which suits wide or repeatedly read results.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Latest:
    """Keeps the result of a loop's latest round as columnar files; those of the round before are removed.

    Each round must read the one before only. Its shuffle files go as well: they are held until the driver collects its
    garbage, which a small heap does not ask for while the disk fills.
    """

    def __init__(self, label: str) -> None:
        self.label, self.path = label, ""

    def keep(self, df: DataFrame) -> DataFrame:
        spark, before = df.sparkSession, self.path
        self.path = scratch(spark, self.label)
        df.write.option("compression", "zstd").parquet(self.path)
        if before:
            _delete(spark, before)
            _MADE.remove((spark, before))
            spark._jvm.System.gc()
        return spark.read.schema(df.schema).parquet(self.path)


def norm_key(col: Column | str) -> Column:
    """Reference keys compare trimmed and in upper case; blank becomes null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.upper(F.trim(c)), F.lit(""))


def blocks(count: Column | str, size: int) -> Column:
    """Number of blocks of at most ``size`` rows that ``count`` rows need (at least one)."""
    c = F.col(count) if isinstance(count, str) else count
    return F.greatest(F.lit(1), F.ceil(c / F.lit(size))).cast("int")


def running_sums(df: DataFrame, by: list[str], order: str, values: list[str]) -> DataFrame:
    """``df`` with ``<value>_before``: the sum of ``value`` over the rows of the same ``by`` with a smaller ``order``.

    ``order`` is distinct within ``by``. Rows are cut into ranges of (by, order); a range's rows are summed up where they
    lie, and only the sums of whole ranges go through one window, so no group of any size is a single task.
    """
    ranges = cut(df.repartitionByRange(*by, order).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    whole = ranges.groupBy("_range", *by).agg(*(F.sum(v).alias(f"_{v}") for v in values))
    ahead = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    whole = whole.select(F.col("_range").alias("_r"), *(F.col(b).alias(f"_by_{b}") for b in by), *(zero(F.sum(f"_{v}").over(ahead)).alias(f"_{v}") for v in values))
    same = F.col("_range") == F.col("_r")
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    summed = ranges.withColumns({f"{v}_before": zero(F.sum(v).over(inside)) for v in values}).join(whole, same)
    return summed.withColumns({f"{v}_before": F.col(f"{v}_before") + F.col(f"_{v}") for v in values}).select(*df.columns, *(f"{v}_before" for v in values))
