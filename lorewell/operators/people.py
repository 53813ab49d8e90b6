"""People graph: profiles, bylines, works, and names in queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions.text import first_text, norm_line, slugify, text_or_empty


def profiles(docs: DataFrame) -> DataFrame:
    """key, name, slug, profile_url, role of each person page; a later page of one name replaces an earlier one."""
    own = docs.where((F.col("content_type") == "person") & (text_or_empty("title") != ""))
    last = F.max_by(F.struct(F.trim("title").alias("name"), slugify("title").alias("slug"), F.col("url").alias("profile_url"), text_or_empty("role").alias("role")), F.col("doc_ord")).alias("p")
    return own.groupBy(norm_line("title").alias("key")).agg(last).select("key", "p.*")


def works(docs: DataFrame) -> DataFrame:
    """key, name, profile_url, work...: bylines, each work once per person (first document first).

    A byline's link counts only if it is a live profile page.
    """
    live = docs.where("content_type = 'person'").select(F.col("url").alias("__live")).distinct()
    own = docs.where("content_type <> 'person'").select("doc_ord", "document_id", "title", "url", "content_type", first_text("publication_date", "date").alias("date"), "author_urls", F.posexplode("authors").alias("pos", "name"))
    own = own.withColumn("byline_url", F.get("author_urls", F.col("pos"))).join(live, F.col("byline_url") == F.col("__live"), "left")
    own = own.withColumn("key", norm_line("name")).withColumn("work_key", first_text("url", "document_id", "title")).where("work_key <> ''")
    one = F.row_number().over(Window.partitionBy("key", "work_key").orderBy("doc_ord", "pos"))
    return own.withColumn("__n", one).where("__n = 1").select("key", F.trim("name").alias("name"), F.col("__live").alias("profile_url"), "document_id", "title", "url", "content_type", "date", "doc_ord", F.lit("byline").alias("via"))


def graph(docs: DataFrame) -> DataFrame:
    """One row per person: name, slug, profile, works (newest first) and their count."""
    w = works(docs)
    item = F.struct(F.col("date").alias("date"), F.negative("doc_ord").alias("o"), "title", "url", "content_type", "via")
    grouped = w.groupBy("key").agg(F.min_by("name", "doc_ord").alias("byline_name"), F.max("profile_url").alias("byline_profile"), F.sort_array(F.collect_list(item), asc=False).alias("works"))
    out = profiles(docs).join(grouped, "key", "full")
    return out.select(
        "key", first_text("name", "byline_name").alias("name"), F.coalesce("slug", slugify("byline_name")).alias("slug"), first_text("profile_url", "byline_profile").alias("profile_url"),
        text_or_empty("role").alias("role"), F.coalesce("works", F.array().cast("array<struct<date:string,o:int,title:string,url:string,content_type:string,via:string>>")).alias("works"), F.greatest(F.size("works"), F.lit(0)).alias("work_count"),
    )


def phrases(people: DataFrame) -> DataFrame:
    """phrase -> key: full names, and surnames that only one person has."""
    last = F.element_at(F.split("key", " "), -1)
    short = people.groupBy(last.alias("phrase")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key")).where("n = 1").select("phrase", "key")
    return people.select(F.col("key").alias("phrase"), "key").unionByName(short).where(F.length("phrase") >= 4).distinct()


def mentions(queries: DataFrame, people: DataFrame, query_id: str, text: str) -> DataFrame:
    """query_id, key of people whose full name, or unambiguous surname, the query has.

    A padded-substring join as an equi-join: every run of 1 to 5 words of the query is looked up, so
    no pair of query and name is ever compared.
    """
    words = F.filter(F.split(F.regexp_replace(F.lower(text_or_empty(text)), r"(?U)[^\w\s]", " "), r"(?U)\s+"), lambda w: w != "")
    q = queries.select(F.col(query_id).alias("query_id"), words.alias("w"))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda n: F.transform(F.filter(F.sequence(F.lit(0), F.size("w")), lambda i: i + n <= F.size("w")), lambda i: F.array_join(F.slice("w", i + 1, n), " "))))
    return q.select("query_id", F.explode(F.array_distinct(runs)).alias("phrase")).join(phrases(people), "phrase").select("query_id", "key").distinct()


def visible(persons: DataFrame, shown: DataFrame, key: str = "key", works: str = "works", doc: str = "document_id") -> DataFrame:
    """persons with only the works whose document is in `shown`; a person without any keeps an empty list."""
    each = persons.select(key, F.posexplode(works).alias("__pos", "__w"))
    kept = each.join(shown.select(F.col(doc).alias("__doc")).distinct(), F.col("__w")[doc] == F.col("__doc"), "left_semi")
    listed = kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__w"))), lambda x: x["__w"]).alias("__own"))
    return persons.join(listed, key, "left").withColumn(works, F.coalesce("__own", F.slice(works, 1, 0))).drop("__own")
