"""CSV files: encoding, delimiter and header found per file, guards on size, rows and repeated files, then the rows of
every file judged like raw rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import ship
from .quarantine import SEPARATORS, classify_rows, names_of

#: Lines of a file among which the header is looked for.
SCAN = 25
#: Bytes that a file of each format may have, and rows of a file.
MOST_BYTES = {"csv": 50 << 20, "xlsx": 50 << 20, "mt940": 25 << 20, "xml": 25 << 20, "pdf": 30 << 20}
MOST_ROWS = 100_000


def sniff_header(lines: list[str], expected: list[str], scan: int = SCAN) -> tuple[int, str]:
    """(line index, separator) of the header: first line with two expected names (or all), else the best, else the
    first with two cells. Separators are tried in their fixed order by how often they occur in the first line that has one.
    """
    first = next((x for x in lines if any(s in x for s in SEPARATORS)), "")
    sep = max(SEPARATORS, key=first.count)
    want = {n.lower() for n in expected}
    hits = [len(want & set(names_of(x, sep))) for x in lines[:scan]]
    for i, h in enumerate(hits):
        if h >= min(2, len(want)) and h:
            return i, sep
    if any(hits):
        return hits.index(max(hits)), sep
    return next((i for i, x in enumerate(lines[:scan]) if len(x.split(sep)) >= 2), 0), sep


def _western() -> tuple[str, str, str]:
    """Latin-1 characters that Windows-1252 has letters and signs for, those, and the ones it has none for."""
    known, none = [], []
    for b in range(0x80, 0xA0):
        try:
            known.append((chr(b), bytes([b]).decode("cp1252")))
        except UnicodeDecodeError:
            none.append(chr(b))
    return "".join(k for k, _ in known), "".join(v for _, v in known), "".join(none)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, n, value): the lines below ``path`` as text, numbered within each split of a file.

    A file that is not UTF-8 throughout is read as Windows-1252, and as Latin-1 where that has no such character; a
    byte-order mark is dropped. Whole files decide, not single lines.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("bytes"), F.monotonically_increasing_id().alias("at"))
    latin, (high, letters, undefined) = F.decode("bytes", "iso-8859-1"), _western()
    whole = F.call_function("is_valid_utf8", F.col("bytes").cast("string"))
    kind = raw.groupBy("file").agg(F.bool_and(whole).alias("utf8"), F.bool_and(F.translate(latin, undefined, "") == latin).alias("western"))
    text = F.when(F.col("utf8"), F.col("bytes").cast("string")).when(F.col("western"), F.translate(latin, high, letters)).otherwise(latin)
    lines = raw.join(kind, "file").select("file", "block", "at", F.regexp_replace(text, "^\ufeff", "").alias("value"))
    return lines.withColumn("n", F.row_number().over(Window.partitionBy("file", "block").orderBy("at")))


def read_csv_rows(spark: SparkSession, path: str, source: str, expected: list[str], fx_rate: DataFrame) -> DataFrame:
    """Every row of the CSV files below ``path``, with status, reason, cells and typed values (see ``classify_rows``).

    The header is found among the first lines of each file, on the workers. Lines are parted by line feeds; a cell with
    a line break needs the raw-row form instead.
    """
    ship(spark)
    lines = read_lines(spark, path)

    def sniff(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for file, head in zip(b["file"], b["head"]):
                text = [x["value"] for x in sorted(head, key=lambda x: x["n"])]
                i, _ = sniff_header(text, expected)
                out.append((file, i + 1, text[i]))
            yield pd.DataFrame(out, columns=["file", "header_at", "header"])

    first = lines.where(f"block = 0 and n <= {SCAN}").groupBy("file").agg(F.collect_list(F.struct("n", "value")).alias("head"))
    heads = first.mapInPandas(sniff, "file string, header_at int, header string")
    rows = lines.join(heads, "file").where("block > 0 or n > header_at")
    raw = rows.select(F.col("at").alias("line_id"), F.sha2("file", 256).alias("file_hash"), F.col("n").alias("line_no"), F.col("value").alias("line"), F.col("block").alias("part"))
    return classify_rows(raw, heads.select(F.sha2("file", 256).alias("file_hash"), "header", F.lit(source).alias("source")), fx_rate)


def guard_files(spark: SparkSession, path: str, accepted: DataFrame | None = None, most_bytes: dict[str, int] = MOST_BYTES, most_rows: int | None = MOST_ROWS) -> DataFrame:
    """(file, content_hash, bytes, refused): why a file below ``path`` is not taken, or null.

    ``too_large`` by its format, ``too_many_rows``, ``duplicate`` of a file in ``accepted`` (column content_hash) or of
    one that comes before it by name. ``most_rows`` None puts no bound on rows, as large loads want it. Contents are
    hashed on the workers and do not travel.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("content_hash"), F.regexp_count(F.decode("content", "iso-8859-1"), F.lit("\n")).alias("rows"))
    ending = F.lower(F.regexp_extract("file", r"\.([A-Za-z0-9]+)$", 1))
    bound = F.lit(None).cast("bigint")
    for name, n in most_bytes.items():
        bound = F.when(ending == name, n).otherwise(bound)
    before = F.row_number().over(Window.partitionBy("content_hash").orderBy("file")) > 1
    seen = accepted.select("content_hash").distinct().withColumn("seen", F.lit(True)) if accepted is not None else spark.createDataFrame([], "content_hash string, seen boolean")
    x = files.withColumn("again", before).join(seen, "content_hash", "left")
    why = F.when(F.col("bytes") > bound, "too_large")
    if most_rows is not None:
        why = why.when(F.col("rows") > most_rows, "too_many_rows")
    return x.select("file", "content_hash", "bytes", why.when(F.col("seen") | F.col("again"), "duplicate").alias("refused"))
