"""BM25 (Okapi) as three tables and a join."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.functions.text import bm25_tokens
from lorewell.plans.tables import stored

K1, B, EPSILON = 1.5, 0.75, 0.25


class Index(NamedTuple):
    """postings(id, term, tf[, dl]), lengths(id, dl), idf(term, df, idf), stats(n, avgdl): stored tables."""

    postings: DataFrame
    lengths: DataFrame
    idf: DataFrame
    stats: DataFrame


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, terms -> id, term, tf, dl, each row's terms counted where it is."""
    for b in batches:
        for k in range(0, b.num_rows, 512):
            c = b.slice(k, 512)
            lists = c.column(1)
            terms = lists.flatten().dictionary_encode()
            size = max(1, len(terms.dictionary))
            lens = np.diff(lists.offsets.to_numpy())
            key, tf = np.unique(np.repeat(np.arange(len(lens)), lens) * size + terms.indices.to_numpy(), return_counts=True)
            row = key // size
            yield pa.RecordBatch.from_arrays([c.column(0).take(pa.array(row)), terms.dictionary.take(pa.array(key % size)), pa.array(tf, pa.int64()), pa.array(lens[row], pa.int64())], names=["id", "term", "tf", "dl"])


def build(docs: DataFrame, id_col: str, text_col: str) -> Index:
    """A text without tokens has the one token "_".

    Texts are tokenised once: postings are written to the shared folder, lengths, counts and idf are
    aggregations of them and written too, so that every query reads what it needs of them.  Where ids are unique a row's terms are
    counted in place, nothing is shuffled, and postings have their row's length; else (id, term) is grouped.
    Negative idf becomes EPSILON x the mean of the raw idf over the vocabulary.
    """
    spark = docs.sparkSession
    tokens = bm25_tokens(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.when(F.size(tokens) == 0, F.array(F.lit("_"))).otherwise(tokens).alias("terms"))
    kind = rows.schema["id"].dataType.simpleString()
    if docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        postings = stored(rows.mapInArrow(_counted, f"id {kind}, term string, tf long, dl long"))
    else:
        postings = stored(rows.select("id", F.explode("terms").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf")))
    lengths = stored(postings.groupBy("id").agg(F.sum("tf").alias("dl")))
    n, avgdl = lengths.agg(F.count(F.lit(1)), F.avg("dl")).first()
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = stored(df.select("term", "df", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")))
    floor = (raw.agg(F.avg("raw")).first()[0] or 0.0) * EPSILON
    idf = raw.select("term", "df", F.when(F.col("raw") < 0, F.lit(floor)).otherwise(F.col("raw")).alias("idf"))
    return Index(postings, lengths, idf, spark.createDataFrame([(n, avgdl)], "n long, avgdl double"))


def save(index: Index, path: str) -> None:
    """Index tables under path, sorted by their lookup key so that row groups are skipped."""
    index.postings.repartitionByRange("term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
    index.idf.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/term_idf")
    index.lengths.write.mode("overwrite").parquet(f"{path}/doc_len")
    index.stats.write.mode("overwrite").parquet(f"{path}/stats")


def load(spark: SparkSession, path: str) -> Index:
    return Index(*[spark.read.parquet(f"{path}/{t}") for t in ("postings", "doc_len", "term_idf", "stats")])


def shared(docs: DataFrame, id_col: str, text_col: str) -> Index:
    """build() for a table of files, kept for the session: built again only when one of the files is another one."""
    spark = docs.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    stamps = []
    for f in sorted(docs.inputFiles()):
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        s = p.getFileSystem(conf).getFileStatus(p)
        stamps.append((f, s.getLen(), s.getModificationTime()))
    known = spark.sparkContext.__dict__.setdefault("_lorewell_bm25", {})
    key = (*stamps, id_col, text_col)
    if key not in known:
        known[key] = build(docs, id_col, text_col)
    return known[key]


def query_terms(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """query_id, term and how often the query has it (repeats count again)."""
    return queries.select(F.col(query_id).alias("query_id"), F.explode(bm25_tokens(text)).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))


#: Query terms that are broadcast; more are joined by shuffles.
FEW = 200_000


def score(index: Index, terms: DataFrame) -> DataFrame:
    """query_id, id, score > 0.  Only postings of query terms survive the first join; up to FEW counted terms they stay where they are."""
    few = terms.limit(FEW + 1).count() <= FEW
    near = F.broadcast if few else lambda x: x
    hit = index.postings.join(near(index.idf.join(near(terms), "term")), "term")
    if "dl" not in hit.columns:
        hit = hit.join(index.lengths, "id")
    hit = hit.crossJoin(F.broadcast(index.stats))  # one row
    part = F.col("qf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hit.groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")
