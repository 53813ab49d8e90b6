"""Sinks, and versioned releases with an atomic pointer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewell.operators import bm25
from lorewell.sources.readers import exists


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def flat(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns in a fixed order with nested values as JSON, ready for CSV."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[F.to_json(c).alias(c) if isinstance(kinds[c], T.ArrayType | T.MapType | T.StructType) else F.col(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    flat(df, columns).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def append_feedback(votes: DataFrame, path: str, limit: int = 500) -> None:
    """Appends (question, vote, ...) rows with a question, trimmed and cut to `limit` characters."""
    q = F.trim(F.coalesce("question", F.lit("")))
    votes.withColumn("question", F.substring(q, 1, limit)).where("question <> ''").write.mode("append").json(path)


def write_manifest(summary: DataFrame, version: str, path: str) -> None:
    """One JSON row: the counts of a release and its version."""
    summary.withColumn("version", F.lit(version)).coalesce(1).write.mode("overwrite").json(path)


def write_run_report(report: DataFrame, run_id: str, root: str) -> None:
    """A run's report under its own name, and the same as the rolling status."""
    report.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").json(f"{root}/runs/run_id={run_id}")
    report.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").json(f"{root}/status")


def public_status(status: DataFrame, keys: tuple[str, ...] = ("version", "documents", "chunks", "run_id", "finished_at")) -> DataFrame:
    """The columns of a status that anyone may see."""
    return status.select(*[c for c in keys if c in status.columns])


def write_state(index: bm25.Index, chunks: DataFrame, vectors: DataFrame, path: str) -> None:
    """All that retrieval reads: index tables, chunk rows (id, ...) and vectors (id, embedding)."""
    bm25.save(index, path)
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")


class Releases:
    """root/releases/<version>/<table> and a one-line pointer root/CURRENT, switched by a rename.

    All file work goes through Hadoop's FileSystem, so root can be in any store that Spark reads.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str) -> object:
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def current(self) -> str | None:
        if not exists(self.spark, f"{self.root}/CURRENT"):
            return None
        return self.spark.read.text(f"{self.root}/CURRENT").first()[0].strip()

    def read(self, table: str, version: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/releases/{version or self.current()}/{table}")

    def stage(self, version: str, tables: dict[str, DataFrame]) -> None:
        """Writes a version; nobody reads it until promote()."""
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{self.root}/releases/{version}/{name}")

    def promote(self, version: str) -> None:
        out = self._fs.create(self._path("CURRENT.tmp"), True)
        out.write(bytearray(version.encode()))
        out.close()
        ctx = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        over = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        ctx.rename(self._path("CURRENT.tmp"), self._path("CURRENT"), over)

    def fail(self, version: str) -> None:
        self._fs.rename(self._path(f"releases/{version}"), self._path(f"releases/failed-{version}"))

    def versions(self) -> list[str]:
        base = self._path("releases")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(base)) if self._fs.exists(base) else []

    def prune(self, keep: int = 3, keep_failed: int = 2) -> list[str]:
        """Deletes all but the newest good and failed versions; never the current one."""
        now = self.current()
        good = [v for v in self.versions() if not v.startswith("failed-")]
        bad = [v for v in self.versions() if v.startswith("failed-")]
        old = [v for v in good[: max(0, len(good) - keep)] if v != now] + bad[: max(0, len(bad) - keep_failed)]
        for v in old:
            self._fs.delete(self._path(f"releases/{v}"), True)
        return old
