"""Stateful streams (availableNow: final state equals the batch result)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorewell.operators import incremental
from lorewell.plans.tables import shared_dir


def read(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A table as a file stream (one file, or a folder of files)."""
    static = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    r = spark.readStream.schema(static.schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(f"{sf_dir}/{name}.parquet*")


def run(stream: DataFrame, mode: str, sink: Callable[[DataFrame, int], None] | None = None, where: str | None = None) -> DataFrame | None:
    """Drains a stream; without a sink, appends to a table in the shared folder and returns it.

    where: the folder of an earlier run of the same stream, which goes on with what is new since.
    """
    spark = stream.sparkSession
    where = where or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/state").trigger(availableNow=True)
    if sink is not None:
        w.foreachBatch(sink).start().awaitTermination()
        return None
    w.format("parquet").option("path", f"{where}/out").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/out")


def _latest(stream: DataFrame) -> DataFrame:
    """Final table of a complete-mode stream: every batch replaces the table before it."""
    spark = stream.sparkSession
    where = f"{shared_dir(spark)}/latest-{uuid.uuid4().hex}"
    done: list[str] = []

    def sink(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/{n}")
        done.append(f"{where}/{n}")

    run(stream, "complete", sink)
    return spark.read.schema(stream.schema).parquet(done[-1]) if done else spark.createDataFrame([], stream.schema)


def windowed_counts(events: DataFrame, ts: str, by: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Event-time tumbling counts with a watermark."""
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    out = timed.groupBy(F.window("__ts", width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return _latest(out).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), by, "n")


def dedup(rows: DataFrame, key: str) -> DataFrame:
    """The first row of each key across all batches: the state holds keys only."""
    return run(rows.dropDuplicates([key]), "append")


class ChangeTable:
    """Keyed state (key -> hash) merged batch by batch; the change log is append-only.

    Rows of a batch have no order, so of several hashes of a key within one batch the greatest stands; none counts as "".

    Every batch writes a new version of the state, named by its place and by what wrote it, in the shared folder; the newest one is
    found there, so a restart goes on from it.  A batch that is tried again after a failure starts from the version before its own.
    """

    def __init__(self, spark: SparkSession, key: str, hash_col: str, where: str | None = None) -> None:
        self.spark, self.key, self.hash_col = spark, key, hash_col
        self.where = where or f"{shared_dir(spark)}/changes-{uuid.uuid4().hex}"
        self.schema = T.StructType([T.StructField(key, T.StringType()), T.StructField(hash_col, T.StringType())])

    def versions(self) -> list[str]:
        """Finished versions, oldest first."""
        base = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.where}/state")
        fs = base.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(base):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(base)]
        return sorted(n for n in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.where}/state/{n}/_SUCCESS")))

    def _read(self, version: str | None) -> DataFrame:
        if version is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.where}/state/{version}")

    def state(self) -> DataFrame:
        known = self.versions()
        return self._read(known[-1] if known else None)

    def apply(self, batch: DataFrame, tag: str) -> None:
        """Merge a batch; tag: what names it again when it is tried again."""
        before = [v for v in self.versions() if not v.endswith(f"-{tag}")]
        old = self._read(before[-1] if before else None)
        seen = batch.groupBy(F.col(self.key).cast("string").alias(self.key)).agg(F.coalesce(F.max(self.hash_col), F.lit("")).alias(self.hash_col))
        change = incremental.classify(old, seen, self.key, self.hash_col).where("change in ('new', 'modified')")
        change.write.mode("overwrite").parquet(f"{self.where}/log/batch={len(before):08d}-{tag}")
        merged = incremental.merge(old, seen, self.spark.createDataFrame([], self.schema), self.key)
        merged.write.mode("overwrite").parquet(f"{self.where}/state/{len(before):08d}-{tag}")

    def run(self, rows: DataFrame, name: str | None = None) -> None:
        """Drain a stream of (key, hash) rows into the table; a stream that is named again goes on where it ended."""
        tag = name or uuid.uuid4().hex
        run(rows, "append", lambda batch, n: self.apply(batch, f"{tag}.{n}"), f"{self.where}/streams/{tag}")

    def log(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.where}/log")


def detect_changes(rows: DataFrame, key: str, hash_col: str, name: str | None = None) -> ChangeTable:
    table = ChangeTable(rows.sparkSession, key, hash_col)
    table.run(rows, name)
    return table


def sliding_limit(events: DataFrame, key: str, event: str, ts: str, limit: int, seconds: int = 60, late: str = "1 day") -> DataFrame:
    """event, key, allowed: a request passes if fewer than `limit` of its key passed in the `seconds` before it.

    The state of a key is the times of its last `limit` passed requests; a key that stays silent for two windows beyond the watermark
    is forgotten, so the state is bounded by the keys of that time.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    width = seconds * 1_000_000

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        passed = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["__t", event])
        ok = []
        for t in rows["__t"]:
            passed = [x for x in passed if x > t - width]
            ok.append(len(passed) < limit)
            if ok[-1]:
                passed.append(int(t))
        state.update((passed,))
        state.setTimeoutTimestamp(max(passed[-1] // 1000 + 2000 * seconds, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({event: rows[event], key: k[0], "allowed": ok})

    timed = events.select(event, key, F.col(ts).cast("timestamp").alias("__ts")).withWatermark("__ts", late).withColumn("__t", F.unix_micros("__ts"))
    out = timed.groupBy(key).applyInPandasWithState(step, f"{event} {kinds[event]}, {key} {kinds[key]}, allowed boolean", "passed array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return run(out, "append")


def limited(events: DataFrame, key: str, ts: str, limit: int, seconds: int = 60) -> DataFrame:
    """Per key the requests and those refused by a fixed-window limit, as a complete-mode aggregate."""
    slot = F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / seconds)
    counts = _latest(events.groupBy(key, slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")))
    return counts.groupBy(key).agg(F.sum("n").alias("requests"), F.sum(F.greatest(F.col("n") - limit, F.lit(0))).alias("refused"))
