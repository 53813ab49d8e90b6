"""Ordered computations over event, run and conversation logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate_window(events: DataFrame, key: str, ts: str, seconds: int = 60) -> DataFrame:
    """events with n_recent: rows of the same key in the last `seconds`, this one included."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("n_recent", F.count(F.lit(1)).over(w))


def failure_streaks(runs: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """runs with streak: consecutive failures up to and including each row (0 at a success)."""
    w = Window.partitionBy(key).orderBy(*order)
    spell = runs.withColumn("__f", failed.cast("int")).withColumn("__s", F.sum(1 - F.col("__f")).over(w))
    return spell.withColumn("streak", F.sum("__f").over(Window.partitionBy(key, "__s").orderBy(*order))).drop("__f", "__s")


def latest(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key in the given order, numbered."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rn") <= n)


def recent_distinct(df: DataFrame, by: str, what: str, ts: str, n: int = 8) -> DataFrame:
    """Move-to-front list: the n values used last, each once."""
    last = df.groupBy(by, what).agg(F.max(ts).alias("last_used"))
    return latest(last, by, [F.desc("last_used"), F.col(what)], n)


def page(df: DataFrame, order: list[Column], number: int, size: int = 100) -> DataFrame:
    """Rows of one page: a bounded top-k up to its end, numbered, then cut."""
    top = df.orderBy(*order).limit(number * size)
    return top.withColumn("rn", F.row_number().over(Window.orderBy(*order))).where(F.col("rn") > (number - 1) * size)


def stale(releases: DataFrame, order: list[Column], keep: int, by: str = "status") -> DataFrame:
    """Releases beyond the newest `keep` of each status."""
    return releases.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rn") > keep)
