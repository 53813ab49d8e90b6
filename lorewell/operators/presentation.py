"""What an answer shows: its source list, search results, suggestions; and the reports of a refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions import citations as K
from lorewell.functions import text


def merged_sources(sources: DataFrame, by: str = "answer_id") -> DataFrame:
    """sources (by, n, title, url) with shown: equal titles and URLs (case aside) share one number, by first appearance."""
    same = [F.lower(text.text_or_empty(c)) for c in ("title", "url")]
    first = sources.withColumn("__first", F.min("n").over(Window.partitionBy(by, *same)))
    return first.withColumn("shown", F.dense_rank().over(Window.partitionBy(by).orderBy("__first"))).drop("__first")


def displayed_sources(answers: DataFrame, sources: DataFrame, by: str = "answer_id", answer: str = "answer") -> DataFrame:
    """(by, place, n, title, url): merged sources in the order in which the answer cites them; the first one if it cites none.

    n is the least number of the merged source.  An answer without sources has no row.
    """
    merged = merged_sources(sources, by)
    marks = answers.select(by, F.posexplode(K.cited(answer)).alias("pos", "n"))
    cited = merged.join(marks, [by, "n"]).groupBy(by, "shown").agg(F.min("pos").alias("pos"))
    silent = answers.select(by).join(cited.select(by), by, "left_anti").select(by, F.lit(1).alias("shown"), F.lit(0).alias("pos"))
    heads = merged.groupBy(by, "shown").agg(F.min(F.struct("n", "title", "url")).alias("head"))
    place = F.row_number().over(Window.partitionBy(by).orderBy("pos"))
    return heads.join(cited.unionByName(silent), [by, "shown"]).select(by, place.alias("place"), "head.n", "head.title", "head.url")


def search_results(hits: DataFrame, order: list[Column], by: str = "query_id", n: int = 8) -> DataFrame:
    """The first n hits of each query with different titles or URLs (case aside), as place."""
    same = [F.lower(text.text_or_empty(c)) for c in ("title", "url")]
    once = hits.withColumn("__r", F.row_number().over(Window.partitionBy(by, *same).orderBy(*order))).where("__r = 1").drop("__r")
    return once.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= n)


def followups(author: Column, category: Column, n: int = 3) -> Column:
    """Suggested questions after an answer, from its first source's author and category."""
    first = F.trim(F.element_at(F.split(author, ","), 1))
    ideas = [
        F.when(first != "", F.concat(F.lit("What else has "), first, F.lit(" written?"))),
        F.when(category != "", F.concat(F.lit("What other "), category, F.lit(" content is there?"))),
        F.lit("Summarise the key points."),
        F.lit("What are the main recommendations?"),
    ]
    return F.slice(F.array_distinct(F.array_compact(F.array(*ideas))), 1, n)


def preview(snippet: Column | str, limit: int = 320) -> Column:
    return F.rtrim(F.substring(text.text_or_empty(snippet), 1, limit))


def change_matrix(changes: DataFrame, by: str = "source", change: str = "change", kind: str = "content_type") -> DataFrame:
    """Number of changes of each sort for each content type of a source."""
    return changes.groupBy(by, change, F.coalesce(F.nullif(kind, F.lit("")), F.lit("unknown")).alias(kind)).agg(F.count(F.lit(1)).alias("n"))


def rebuild_summary(old: DataFrame, new: DataFrame, key: str = "chunk_hash", doc: str = "document_id") -> DataFrame:
    """One row: chunks and documents after a rebuild, and chunk hashes that came, went and stayed."""
    sides = old.select(key, F.lit(1).alias("o"), F.lit(0).alias("w")).unionByName(new.select(key, F.lit(0).alias("o"), F.lit(1).alias("w")))
    each = sides.groupBy(key).agg(F.max("o").alias("o"), F.max("w").alias("w"))
    moved = each.agg(F.count_if(F.col("w") > F.col("o")).alias("new_hashes"), F.count_if(F.col("o") > F.col("w")).alias("removed_hashes"), F.count_if(F.col("o") == F.col("w")).alias("kept_hashes"))
    size = new.agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct(doc).alias("documents"))
    names = [*size.columns, *moved.columns]
    return size.unionByName(moved, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in names])  # two rows into one


def two_level_changes(state: DataFrame, seen: DataFrame, key: str = "url") -> DataFrame:
    """seen (key, raw_hash, text_hash) with change: new, unchanged (same bytes), touched (other bytes, same text) or changed."""
    was = state.select(key, F.col("raw_hash").alias("__raw"), F.col("text_hash").alias("__text"))
    change = F.when(F.col("__raw").isNull(), "new").when(F.col("raw_hash") == F.col("__raw"), "unchanged").when(F.col("text_hash") == F.col("__text"), "touched").otherwise("changed")
    return seen.join(was, key, "left").withColumn("change", change).drop("__raw", "__text")


def listing_changes(state: DataFrame, entries: DataFrame, parent: str = "listing", url: str = "url", body: str = "text") -> DataFrame:
    """(parent, url, change): entries of listings against the last run by the hash of text and target URL.

    An entry that is no longer listed is `missing`; listings with any entry now are alive whatever was removed.
    """
    def hashed(df: DataFrame, name: str) -> DataFrame:
        return df.select(parent, url, text.content_hash(F.concat_ws("|", text.text_or_empty(body), F.col(url).cast("string"))).alias(name))

    both = hashed(state, "was").join(hashed(entries, "now"), [parent, url], "full")
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "missing").when(F.col("was") == F.col("now"), "unchanged").otherwise("changed")
    alive = F.max(F.col("now").isNotNull()).over(Window.partitionBy(parent))
    return both.select(parent, url, change.alias("change"), alive.alias("parent_alive"))


def least_recently_used(uses: DataFrame, key: str, at: str, keep: int = 300) -> DataFrame:
    """The `keep` keys used last: what a cache of that size holds."""
    return uses.groupBy(key).agg(F.max(at).alias("last_used")).orderBy(F.desc("last_used"), key).limit(keep)


def source_summary(log: DataFrame, by: str = "source", max_failed: float = 0.2) -> DataFrame:
    """by, urls, failed, failure_ratio and healthy: what a run reports of each of its sources."""
    out = log.groupBy(by).agg(F.count(F.lit(1)).alias("urls"), F.count_if(F.col("outcome").isin("failed", "error")).alias("failed"))
    ratio = F.col("failed") / F.col("urls")
    return out.select(by, "urls", "failed", F.round(ratio, 6).alias("failure_ratio"), (ratio <= max_failed).alias("healthy"))
