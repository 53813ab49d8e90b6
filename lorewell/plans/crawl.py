"""Crawl rules: which links to follow, which pages become documents, and documents made of listing entries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell import schema as C
from lorewell.functions import text, urls


@dataclass(frozen=True)
class Site:
    """What a site's owner sets: substrings of URLs, listing paths, and the least text of a page."""

    domain: str
    source: str = "website"
    never_follow: tuple[str, ...] = ()
    never_keep: tuple[str, ...] = ()
    only_keep: tuple[str, ...] = ()
    oped_listings: tuple[str, ...] = ()
    min_text: int = 200
    noise_lines: tuple[str, ...] = ("download document",)


def _has_any(url: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(F.lower(url), F.lit(p.lower()))
    return out


def follow(url: Column, site: Site) -> Column:
    """Pages of the site that are no files and match none of the excluded parts."""
    return urls.same_site(url, site.domain) & ~urls.is_asset(url) & ~urls.is_pdf(url) & ~_has_any(url, site.never_follow)


def keep(url: Column, title: Column, site: Site) -> Column:
    """Pages that become documents: not excluded, no listing (of an outside site), and among the included parts if there are any."""
    listing = F.lit(False) if site.source == C.INTERNAL_SOURCE else urls.is_listing(url, title)
    included = _has_any(url, site.only_keep) if site.only_keep else F.lit(True)
    return ~_has_any(url, site.never_keep) & ~listing & included


def is_oped_listing(url: Column, site: Site) -> Column:
    return F.regexp_replace(urls.path(url), "/+$", "").isin(*[p.rstrip("/") for p in site.oped_listings]) if site.oped_listings else F.lit(False)


def page_outcomes(pages: DataFrame, site: Site) -> DataFrame:
    """pages(url, title, body, content_type, ...) with the body less its noise lines, and outcome: document, navigation_page or too_short."""
    lines = F.filter(F.split(text.text_or_empty("body"), "\n", -1), lambda x: ~F.lower(F.trim(x)).isin(*site.noise_lines))
    body = pages.withColumn("body", F.array_join(lines, "\n"))
    short = (F.length("body") < site.min_text) & (text.text_or_empty("content_type") != "person")
    return body.withColumn("outcome", F.when(~keep(F.col("url"), F.col("title"), site), "navigation_page").when(short, "too_short").otherwise("document"))


def oped_documents(entries: DataFrame, site: Site, lead: str = "Op-ed / media article", listed: str = "Listed on") -> DataFrame:
    """Entries (title, url, authors, outlet, date, categories, listing) of opinion listings as documents with a text of their metadata.

    An entry without a URL or title makes no document; a changed link is a change of the content hash.
    """

    def line(label: str, v: Column) -> Column:
        return F.when(v != "", F.concat(F.lit(f"{label}: "), v))

    body = F.concat_ws(
        "\n", F.concat(F.lit(f"{lead}: "), "title"), line("Authors", text.joined("authors")), line("Published in", text.text_or_empty("outlet")), line("Date", text.text_or_empty("date")), line("Topics", text.joined("categories")), line(listed, text.text_or_empty("listing"))
    )
    sound = entries.where((text.text_or_empty("title") != "") & (text.text_or_empty("url") != ""))
    return sound.select(
        F.concat(F.lit(f"{site.source}_oped_"), text.url_hash("url")).alias("document_id"), "url", F.col("url").alias("canonical_url"), "title", "authors", "date", "categories", text.text_or_empty("outlet").alias("publisher"), F.lit(site.source).alias("source"),
        F.lit("op-ed").alias("content_type"), body.alias("text"), F.col("listing").alias("parent_url"), F.lit(True).alias("is_external_reference"), text.content_hash(F.concat_ws("\n", body, "url")).alias("content_hash"),
    )
