"""Tamper transforms: each changes a table of records in one way, so that a run can be compared before and after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _victim(key: str, value: str) -> Column:
    return F.col(key) == value


def repeat_row(df: DataFrame, key: str, value: str, suffix: str = "_dup") -> DataFrame:
    """The row comes in again under another key."""
    return df.unionByName(df.where(_victim(key, value)).withColumn(key, F.concat(key, F.lit(suffix))))


def change(df: DataFrame, key: str, value: str, column: str, to: Column) -> DataFrame:
    """One cell changes: an amount, a currency, a reference, a day, a text."""
    return df.withColumn(column, F.when(_victim(key, value), to).otherwise(F.col(column)))


def drop_row(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.where(~_victim(key, value) | F.col(key).isNull())


def verdict(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Multiset difference of the outcomes: what appeared and what went, with counts per row of ``columns``."""
    count = lambda df, n: df.groupBy(*columns).agg(F.count(F.lit(1)).alias(n))
    both = count(before, "n_before").join(count(after, "n_after"), columns, "full").na.fill(0, ["n_before", "n_after"])
    return both.where("n_before <> n_after")
