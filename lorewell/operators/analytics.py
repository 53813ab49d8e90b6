"""Composition, coverage, validation and regression guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell import schema as C
from lorewell.functions import fields, mojibake, text


def counts(df: DataFrame, *by: str | Column) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def top_n(df: DataFrame, value: Column, n: int, name: str = "value") -> DataFrame:
    """Most frequent values; ties by value.  A heap per task, not a global sort."""
    return df.select(value.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name).limit(n)


def coverage(df: DataFrame, fields: list[str]) -> DataFrame:
    """field and the percentage of rows where it is neither null nor empty, in one pass."""
    filled = {c: F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in fields}
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(e).alias(c) for c, e in filled.items()])
    return one.select("n", F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in fields]), F.array(*[F.col(c) for c in fields]))).alias("field", "filled")).select("field", F.round(F.try_divide(F.col("filled") * 100.0, F.col("n")), 6).alias("pct"))


def chunk_summary(chunks: DataFrame, internal: Column) -> DataFrame:
    n = F.length(text.text_or_empty("text"))
    return chunks.agg(F.count(F.lit(1)).alias("total"), F.count_if(internal).alias("internal"), F.round(F.avg(n), 6).alias("avg_chars"), F.max(n).alias("max_chars"))


def validate(docs: DataFrame, chunks: DataFrame, doc_id: str, undersize: int = 40, oversize: int = 4000) -> DataFrame:
    """One row of counters over documents and chunks; each table is read once, plus one anti join."""
    d = docs.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.trim(text.text_or_empty("text")) == "").alias("empty_text"), (F.count(doc_id) - F.count_distinct(doc_id)).alias("extra_doc_ids"))
    size = F.length(text.text_or_empty("text"))
    c = chunks.agg(
        F.count(F.lit(1)).alias("chunks"), (F.count("chunk_id") - F.count_distinct("chunk_id")).alias("extra_chunk_ids"), F.count_if(size < undersize).alias("undersized"), F.count_if(size > oversize).alias("oversized"),
        F.count_if(mojibake.has_mojibake("text")).alias("mojibake"), F.count_if(text.quality_score("text") < 0.5).alias("garbage"),
    )
    o = chunks.select(doc_id).join(docs.select(F.col(doc_id).cast("string").alias(doc_id)), doc_id, "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
    return d.crossJoin(c).crossJoin(o)  # one row each


def regression_guard(now: DataFrame, before: DataFrame, by: str = "source", drop: float = 0.10, least: int = 5) -> DataFrame:
    """Errors against a baseline: a source of `least` documents that vanished, or a total that fell by over `drop`."""
    a, b = counts(now, by).withColumnRenamed("n", "now"), counts(before, by).withColumnRenamed("n", "was")
    m = a.join(b, by, "full").select(by, F.coalesce("now", F.lit(0)).alias("now"), F.coalesce("was", F.lit(0)).alias("was"))
    gone = m.where((F.col("was") >= least) & (F.col("now") == 0)).select(F.lit("source_vanished").alias("error"), F.col(by).alias("what"), "was", "now")
    total = m.agg(F.sum("was").alias("was"), F.sum("now").alias("now")).where(F.col("now") < F.col("was") * (1 - drop))
    return gone.unionByName(total.select(F.lit("count_dropped").alias("error"), F.lit("all").alias("what"), "was", "now"))


def index_stats(chunks: DataFrame, doc: str = "document_id") -> DataFrame:
    """chunks and distinct documents by source and content type, by source, and in all (nulls mark the totals)."""
    return chunks.rollup("source", "content_type").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct(doc).alias("documents"))


def by_priority(sources: DataFrame, priority: Column, name: str = "source") -> DataFrame:
    """sources with priority and place: by falling priority, then by name (a table of one row per source)."""
    ranked = sources.withColumn("priority", priority)
    return ranked.withColumn("place", F.row_number().over(Window.orderBy(F.desc("priority"), name)))


def session_quality(answers: DataFrame, by: str, value: str, score: str) -> DataFrame:
    """Per session: mean of a value (nulls aside), grounded and ungrounded answers, and answers by confidence."""
    c = fields.confidence(score)
    names = [n for n, _ in C.CONFIDENCE]
    return answers.groupBy(by).agg(
        F.round(F.avg(value), 6).alias(f"mean_{value}"), F.count_if(F.col(score) >= C.MIN_SCORE).alias("grounded"), F.count_if(F.coalesce(F.col(score), F.lit(0.0)) < C.MIN_SCORE).alias("no_evidence"),
        *[F.count_if(c == n).alias(n) for n in [*names, "none"]],
    )


def totals(report: DataFrame, counters: list[str]) -> DataFrame:
    """One row: every counter of the sources of a run added up (an absent one counts 0)."""
    return report.agg(*[F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).alias(c) for c in counters])


def unique_sorted(df: DataFrame, value: str, dropped: tuple[str, ...] = ("", "unknown", "n/a", "none")) -> DataFrame:
    """Distinct values for a filter list, without placeholders, in order."""
    v = F.trim(F.col(value).cast("string"))
    return df.select(v.alias(value)).where(F.col(value).isNotNull() & ~F.lower(value).isin(*dropped)).distinct().orderBy(value)


def explorer_frame(docs: DataFrame) -> DataFrame:
    """What a table of documents shows: joined lists, length and year."""
    names = docs.columns

    def own(c: str) -> Column:
        return text.text_or_empty(c) if c in names else F.lit("")

    def listed(c: str) -> Column:
        return text.joined(c) if c in names else F.lit("")

    date = text.first_text(own("publication_date"), own("date"))
    return docs.select(
        own("document_id").alias("document_id"), own("title").alias("title"), own("source").alias("source"), listed("authors").alias("authors"), own("category").alias("category"), listed("tags").alias("tags"),
        date.alias("date"), fields.year(date).alias("year"), own("content_type").alias("content_type"), own("url").alias("url"), F.length(own("text")).alias("chars"), F.substring(own("text"), 1, 300).alias("preview"),
    )


def valid_people(docs: DataFrame, least: int = 3) -> DataFrame:
    """name and n of authors that read like people: no category, tag or content type of the corpus, letters, two words or more."""
    other = docs.select(F.explode(F.concat(F.array("category", "content_type"), F.coalesce("tags", F.array().cast("array<string>")))).alias("other")).select(F.lower(F.trim("other")).alias("key")).where("key <> ''").distinct()
    names = docs.select(F.explode("authors").alias("name")).groupBy(F.trim("name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    sound = (F.length("name") >= least) & F.col("name").rlike("\\p{L}") & ~F.col("name").rlike("\\d|@|https?:") & F.contains("name", F.lit(" "))
    return names.where(sound).withColumn("key", F.lower("name")).join(other, "key", "left_anti").select("name", "n")


def _any_has(array: str, value: str) -> Column:
    return F.exists(array, lambda x: F.contains(F.lower(x), F.lit(value.lower())))


def explorer(docs: DataFrame, **f: str) -> DataFrame:
    """Conjunctive optional filters: q (regular expression over title or text), and equality or containment on fields."""
    out = docs
    if f.get("q"):
        rx = f"(?i){f['q']}"
        out = out.where(text.text_or_empty("title").rlike(rx) | text.text_or_empty("text").rlike(rx))
    for name in ("source", "category", "year", "content_type"):
        if f.get(name):
            out = out.where(F.col(name) == f[name])
    for name in ("author", "tag"):
        if f.get(name):
            out = out.where(_any_has(f"{name}s", f[name]))
    return out
