"""Bank statement readers: MT940 text, CAMT.053 XML, lines of text extracted from PDF. Each gives string columns.

Columns: path, row_no, amount (signed decimal text, null when unreadable), value_date and posted_date (yyyy-MM-dd),
narration, account_no, utr. Unreadable entries stay as rows without an amount, so that they end up in quarantine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import short_date
from ..functions.refs import extract_utr

#: The shape of a :61: field, and of dates, amounts and markers in printed statements.
ENTRY = r"^(\d{6})(\d{4})?(RC|RD|C|D|CR|DR)[A-Z]?([\d.]*,?\d*)"
PRINTED_DATE = r"(\d{4}-\d{2}-\d{2}|\d{2}[/.-]\d{2}[/.-]\d{4}|\d{1,2}[ -][A-Za-z]{3}[ -]\d{4})"
PRINTED_AMOUNT = r"(?<![\d.])([+-]?\d{1,3}(?:,\d{2,3})*\.\d{2}|[+-]?\d+\.\d{2})(?![\d.])"
COLUMNS = ["path", "row_no", "amount", "value_date", "posted_date", "narration", "account_no", "utr"]


def _texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def _finish(df: DataFrame) -> DataFrame:
    return df.withColumn("utr", extract_utr("narration")).select(*COLUMNS)


def read_mt940(spark: SparkSession, path: str) -> DataFrame:
    """``:61:`` entries with the ``:86:`` that follows, under the account of the last ``:25:``.

    Lines that do not begin with a tag belong to the tag before them. Debits and reversed credits are negative. The
    entry date takes the value date's year, rolled over at a year's end.
    """
    return parse_mt940(_texts(spark, path))


def parse_mt940(texts: DataFrame) -> DataFrame:
    # One element per tagged field, continuation lines folded in: the split is before each tag at a line's start.
    fields = texts.select("path", F.posexplode(F.split(F.regexp_replace("value", "\r\n?", "\n"), r"\n(?=:\d{2}[A-Z]?:)")).alias("no", "f"))
    fields = fields.select("path", "no", F.regexp_extract("f", r"^:(\d{2}[A-Z]?):", 1).alias("tag"), F.trim(F.regexp_replace(F.regexp_replace("f", r"^:\d{2}[A-Z]?:", ""), r"\s*\n-?\s*", " ")).alias("v"))
    # Windows are per file: a statement file, not a table.
    w = Window.partitionBy("path").orderBy("no")
    x = fields.withColumn("account_no", F.last(F.when(F.col("tag") == "25", F.col("v")), True).over(w)).withColumn("next_tag", F.lead("tag").over(w)).withColumn("next_v", F.lead("v").over(w))
    x = x.where("tag = '61'")
    part = lambda k: F.nullif(F.regexp_extract("v", ENTRY, k), F.lit(""))
    number = F.replace(F.replace(part(4), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    number = F.when(F.regexp_like(number, F.lit(r"^\d+(\.\d*)?$")), F.regexp_replace(number, r"\.$", ""))
    sign = F.when(part(3).isin("D", "DR", "RC"), "-").otherwise("")
    value = short_date(part(1))
    entry = F.try_to_date(F.concat(F.year(value).cast("string"), part(2)), "yyyyMMdd")
    turned = F.when(F.datediff(entry, value) > 180, F.add_months(entry, -12)).when(F.datediff(entry, value) < -180, F.add_months(entry, 12)).otherwise(entry)
    rest = F.trim(F.regexp_replace("v", ENTRY, ""))
    narration = F.trim(F.concat_ws(" ", rest, F.when(F.col("next_tag") == "86", F.col("next_v"))))
    out = x.select("path", F.row_number().over(w).alias("row_no"), F.when(value.isNotNull(), F.concat(sign, number)).alias("amount"), value.cast("string").alias("value_date"), F.coalesce(turned, value).cast("string").alias("posted_date"), narration.alias("narration"), "account_no")
    return _finish(out)


def read_camt053(spark: SparkSession, path: str) -> DataFrame:
    """Entries of CAMT.053 statements, whatever the name space, with string amounts; debits are negative.

    A statement's file is split at its statements and entries with the engine's own expressions; no inference.
    """
    return parse_camt053(_texts(spark, path))


def _inner(xml: Column, tag: str) -> Column:
    return F.nullif(F.regexp_extract(xml, rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1), F.lit(""))


def _all(xml: Column, tag: str) -> Column:
    return F.regexp_extract_all(xml, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), 1)


def parse_camt053(texts: DataFrame) -> DataFrame:
    plain = texts.select("path", F.regexp_replace("value", r"<(/?)\w+:", "<$1").alias("xml"))
    stmts = plain.select("path", F.posexplode(_all(F.col("xml"), "Stmt")).alias("s", "stmt"))
    acct = _inner(F.col("stmt"), "Acct")
    entries = stmts.select("path", "s", F.coalesce(_inner(acct, "IBAN"), _inner(_inner(acct, "Othr"), "Id")).alias("account_no"), F.posexplode(_all(F.col("stmt"), "Ntry")).alias("n", "e"))
    e = F.col("e")
    amount = F.trim(_inner(e, "Amt"))
    amount = F.when(F.regexp_like(amount, F.lit(r"^\d+(\.\d+)?$")), F.concat(F.when(_inner(e, "CdtDbtInd") == "DBIT", "-").otherwise(""), amount))
    day = lambda tag: F.coalesce(_inner(_inner(e, tag), "Dt"), F.left(_inner(_inner(e, tag), "DtTm"), F.lit(10)))
    refs = F.concat(*(_all(e, t) for t in ("EndToEndId", "TxId", "Ustrd", "AddtlNtryInf")))
    narration = F.coalesce(F.nullif(F.array_join(refs, " "), F.lit("")), _inner(e, "AcctSvcrRef"))
    out = entries.select("path", (F.col("s") * 1_000_000 + F.col("n") + 1).alias("row_no"), amount.alias("amount"), day("ValDt").alias("value_date"), day("BookgDt").alias("posted_date"), narration.alias("narration"), "account_no")
    return _finish(out)


def read_pdf_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of extracted text: a line with a date and an amount is a row, the first amount counts (a later one is the
    balance), a DR marker or a minus makes it negative, what is left is the narration."""
    return parse_pdf_lines(_texts(spark, path))


def parse_pdf_lines(texts: DataFrame) -> DataFrame:
    lines = texts.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("no", "line"))
    date, money = F.regexp_extract("line", PRINTED_DATE, 1), F.regexp_extract("line", PRINTED_AMOUNT, 1)
    x = lines.withColumn("date", date).withColumn("money", money).where("date <> '' and money <> ''")
    debit = F.regexp_like("line", F.lit(r"(?i)\b(DR|DEBIT)\b"))
    bare = F.regexp_replace(F.regexp_replace("money", ",", ""), r"^\+", "")
    amount = F.when(debit & ~F.startswith(bare, F.lit("-")), F.concat(F.lit("-"), bare)).otherwise(bare)
    day = F.coalesce(*(F.try_to_date("date", f) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "d MMM yyyy", "d-MMM-yyyy")))
    rest = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("line", PRINTED_DATE, " "), PRINTED_AMOUNT, " "), r"(?i)\b(CR|DR|DEBIT|CREDIT)\b", " "), r"\s+", " "))
    out = x.select("path", (F.col("no") + 1).alias("row_no"), amount.alias("amount"), day.cast("string").alias("value_date"), day.cast("string").alias("posted_date"), rest.alias("narration"), F.lit(None).cast("string").alias("account_no"))
    return _finish(out)


#: Readers by file suffix; the caller's format decides only for others.
READERS = {".sta": read_mt940, ".mt940": read_mt940, ".xml": read_camt053, ".txt": read_pdf_lines}


def read_statement(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Dispatch: the suffix wins, the format (mt940, camt053, pdf) serves where the suffix does not tell."""
    by_format = {"mt940": read_mt940, "camt053": read_camt053, "pdf": read_pdf_lines}
    suffix = "." + path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    reader = READERS.get(suffix) or by_format.get(fmt or "")
    if reader is None:
        raise ValueError(f"no reader for {path!r} with format {fmt!r}")
    return reader(spark, path)
