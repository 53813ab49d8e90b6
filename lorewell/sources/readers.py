"""Scans."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lorewell.functions.text import first_text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank and malformed lines are skipped, a missing path is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def jsonl_rejects(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The malformed lines themselves, for a reject count."""
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", wide, {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where("r._bad is not null").select("value")


def json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One big JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def crawl_log(spark: SparkSession, path: str, record: T.StructType) -> DataFrame:
    """A JSON object url -> record as rows."""
    raw = spark.read.option("wholetext", True).text(path)
    inner = T.StructType([f for f in record.fields if f.name != "url"])
    return raw.select(F.explode(F.from_json("value", T.MapType(T.StringType(), inner))).alias("url", "r")).select("url", "r.*").select(*record.names)


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """loc and lastmod of a sitemap."""
    schema = T.StructType([T.StructField("loc", T.StringType()), T.StructField("lastmod", T.StringType())])
    return spark.read.format("xml").option("rowTag", "url").schema(schema).load(path)


def sitemap_tree(spark: SparkSession, path: str, depth: int = 5) -> DataFrame:
    """All URLs below a sitemap index, to a bounded depth; the driver holds the index files' names only."""
    schema = T.StructType([T.StructField("loc", T.StringType())])
    level, out = [path], None
    for _ in range(depth):
        for p in level:
            got = sitemap(spark, p)
            out = got if out is None else out.unionByName(got)
        level = [r["loc"] for p in level for r in spark.read.format("xml").option("rowTag", "sitemap").schema(schema).load(p).collect()]
        if not level:
            break
    return out.where("loc is not null").distinct()


def supplementary(spark: SparkSession, paths: list[str], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows with an id and text, rejected rows) of the curated files that exist."""
    out = spark.createDataFrame([], schema)
    for p in paths:
        out = out.unionByName(jsonl(spark, p, schema))
    names = schema.names
    body = first_text(*[c for c in ("text", "content") if c in names])
    ok = (first_text("id") != "") & (body != "")
    return out.where(ok), out.where(~ok)


def with_supplement(docs: DataFrame, extra: DataFrame, key: str = "document_id") -> DataFrame:
    """docs and those extra rows whose id is new."""
    return docs.unionByName(extra.join(docs.select(key), key, "left_anti"), allowMissingColumns=True)


def robots_allowed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages(url, host, path) with allowed: the longest matching rule of the host decides, none allows.

    rules(host, prefix, allow) are cut to their prefixes' lengths, so the join is an equi-join.
    """
    n = rules.select(F.col("host").alias("rh"), F.col("prefix"), F.col("allow"), F.length("prefix").alias("len"))
    lens = n.groupBy("rh").agg(F.collect_set("len").alias("lens"))
    cut = pages.join(lens, F.col("host") == F.col("rh"), "left").withColumn("len", F.explode_outer("lens")).withColumn("cut", F.expr("substring(path, 1, len)")).drop("rh")
    hit = cut.join(n.withColumnRenamed("prefix", "cut"), ["cut", "len"], "left").where("rh is null or rh = host")
    return hit.groupBy("url").agg(F.coalesce(F.max_by("allow", F.when(F.col("allow").isNotNull(), F.col("len"))), F.lit(True)).alias("allowed"))


class PagePart(InputPartition):
    def __init__(self, lo: int, hi: int) -> None:
        self.lo, self.hi = lo, hi


class PageSource(DataSource):
    """Fetched pages as a data source ("pages_by_url"): partitions of URLs, one fetch each.

    Option `fetch` names a function "module:name" that takes a URL and returns
    (status, final_url, body, error); options `urls` (newline separated) and `partitions`.
    """

    @classmethod
    def name(cls) -> str:
        return "pages_by_url"

    def schema(self) -> str:
        return "url string, status int, final_url string, html string, error_type string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PageReader(dict(self.options))


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.parts = max(1, int(options.get("partitions", "4")))
        self.fetch = options["fetch"]

    def partitions(self) -> list[InputPartition]:
        size = -(-len(self.urls) // self.parts) or 1
        return [PagePart(k, min(len(self.urls), k + size)) for k in range(0, len(self.urls), size)] or [PagePart(0, 0)]

    def read(self, partition: Any) -> Iterator[tuple]:
        import importlib

        module, name = self.fetch.split(":")
        fetch = getattr(importlib.import_module(module), name)
        for u in self.urls[partition.lo : partition.hi]:
            status, final, body, error = fetch(u)
            yield u, status, final, body, error


def open_state(spark: SparkSession, path: str) -> tuple[object, DataFrame, DataFrame]:
    """(index, chunks, vectors) that write_state() left; they must have the same number of rows."""
    from lorewell.operators import bm25

    index = bm25.load(spark, path)
    chunks, vectors = (spark.read.parquet(f"{path}/{t}") for t in ("chunks", "vectors"))
    sizes = [index.lengths.count(), chunks.count(), vectors.count()]
    if len(set(sizes)) != 1:
        raise ValueError(f"index, chunks and vectors differ in rows: {sizes}")
    return index, chunks, vectors


def newest_runs(spark: SparkSession, root: str, n: int = 10) -> DataFrame:
    """Reports of the last n runs, newest first by run name."""
    runs = spark.read.json(f"{root}/runs")
    last = runs.select("run_id").distinct().orderBy(F.desc("run_id")).limit(n)
    return runs.join(F.broadcast(last), "run_id").orderBy(F.desc("run_id"))  # n names
