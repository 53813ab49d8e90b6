"""Crawl log audit: broken links, redirects, orphans, depth, duplicate groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions import urls

BROKEN_ERRORS = ("timeout", "dns", "connection", "redirect_loop", "malformed")


def is_broken() -> Column:
    s = F.col("status")
    return F.coalesce(s.isin(403, 404, 410) | (s >= 500), F.lit(False)) | F.coalesce(F.col("error_type").isin(*BROKEN_ERRORS), F.lit(False))


def rows(log: DataFrame) -> DataFrame:
    n = lambda c: F.greatest(F.size(c), F.lit(0))
    kind = F.coalesce(F.nullif("kind", F.lit("")), F.when(F.lower("url").endswith(".pdf"), "pdf").otherwise("page"))
    return log.select(
        "url", kind.alias("kind"), urls.content_type("url").alias("content_type"), "status", "outcome", "final_url", n("redirect_chain").alias("redirect_hops"),
        "error_type", "discovery", F.coalesce(F.array_contains("discovery", "sitemap"), F.lit(False)).alias("in_sitemap"), F.coalesce(F.array_contains("discovery", "links"), F.lit(False)).alias("via_links"),
        n("inlinks").alias("inlink_count"), n("outlinks").alias("outlink_count"), "depth", "title", "text_len", "text_hash", "has_author", "has_date", "inlinks", "discovered_from", "malformed_links", "external_links",
    )


def broken_links(log: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """source_page, link_url, status, error_type, scope: one row per page that links to a broken target."""
    r = rows(log)
    src = F.when(F.col("inlink_count") > 0, F.col("inlinks")).otherwise(F.array(F.coalesce(F.nullif("discovered_from", F.lit("")), F.lit("(sitemap/seed)"))))
    inner = r.where(is_broken()).select(F.explode(src).alias("source_page"), F.col("url").alias("link_url"), "status", "error_type", F.lit("internal").alias("scope"))
    bad = r.select(F.col("url").alias("source_page"), F.explode("malformed_links").alias("link_url"), F.lit(None).cast("int").alias("status"), F.lit("malformed").alias("error_type"), F.lit("internal").alias("scope"))
    out = inner.unionByName(bad)
    if external is not None:
        links = r.select(F.col("url").alias("__src"), F.explode("external_links").alias("url")).distinct()
        failed = external.where((F.coalesce("error", F.lit("")) != "") | (F.col("status") >= 400))
        far = failed.join(links, "url", "left").select(F.coalesce("__src", F.lit("(document metadata)")).alias("source_page"), F.col("url").alias("link_url"), "status", F.lit("external").alias("error_type"), F.lit("external").alias("scope"))
        out = out.unionByName(far)
    return out


def redirects(log: DataFrame) -> DataFrame:
    loop = F.coalesce(F.col("error_type") == "redirect_loop", F.lit(False))
    return rows(log).where((F.col("redirect_hops") > 0) | loop).select("url", "final_url", F.col("redirect_hops").alias("hops"), loop.alias("loop"))


def orphans(log: DataFrame) -> DataFrame:
    return rows(log).where(F.col("in_sitemap") & (F.col("inlink_count") == 0) & (F.col("kind") == "page") & ~urls.path("url").isin("", "/"))


def duplicate_groups(df: DataFrame, key: Column, member: str, where: Column | None = None) -> DataFrame:
    """key, n and the sorted members of keys that more than one row has.

    Sizes are counted first, so that only members of real groups are gathered.
    """
    some = (df if where is None else df.where(where)).select(key.alias("key"), F.col(member).alias("member")).where("key is not null")
    big = some.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return some.join(big.select("key"), "key").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("member")).alias("members"))


def summary(log: DataFrame) -> DataFrame:
    """All counters of the audit in one pass."""
    r = rows(log)
    page, ok = F.col("kind") == "page", (F.col("kind") == "page") & (F.col("status") == 200)
    article = ok & F.col("content_type").isin("publication", "blog")
    loop = F.col("error_type") == "redirect_loop"
    n = {
        "urls_total": F.lit(True), "pages": page, "pdfs": F.col("kind") == "pdf", "broken_internal": is_broken(), "timeouts": F.col("error_type") == "timeout",
        "dns_failures": F.col("error_type") == "dns", "redirects": (F.col("redirect_hops") > 0) | loop, "redirect_loops": loop, "multi_hop_redirects": F.col("redirect_hops") > 1,
        "orphan_pages": F.col("in_sitemap") & (F.col("inlink_count") == 0) & page & ~urls.path("url").isin("", "/"),
        "sitemap_only_pages": F.col("in_sitemap") & ~F.col("via_links") & page, "links_only_pages": F.col("via_links") & ~F.col("in_sitemap") & page,
        "no_text_pages": ok & (F.coalesce("text_len", F.lit(0)) == 0), "short_text_pages": ok & F.col("text_len").between(1, 299), "missing_title": ok & (F.coalesce("title", F.lit("")) == ""),
        "articles_missing_author": article & ~F.coalesce("has_author", F.lit(False)), "articles_missing_date": article & ~F.coalesce("has_date", F.lit(False)), "failed_fetches": F.col("outcome").isin("failed", "error"),
    }
    return r.agg(*[F.count_if(c).alias(k) for k, c in n.items()])


def outcomes(log: DataFrame) -> DataFrame:
    """kind, outcome, n and how many of them are broken."""
    return rows(log).groupBy("kind", "outcome").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_broken()).alias("broken"))


def bfs_depth(edges: DataFrame, seeds: DataFrame, depth: int = 8) -> DataFrame:
    """url and its least number of hops from a seed, up to `depth`: one join a level, written between levels."""
    from lorewell.plans.tables import stored

    seen = stored(seeds.select(F.col("url"), F.lit(0).alias("depth")).distinct())
    front = seen
    for d in range(1, depth + 1):
        nxt = edges.join(front.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).distinct().join(seen.select("url"), "url", "left_anti")
        front = stored(nxt.withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = stored(seen.unionByName(front))
    return seen
