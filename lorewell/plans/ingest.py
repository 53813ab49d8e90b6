"""From extracted records to a released corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions import fields, text, urls
from lorewell.operators import analytics, bm25, chunking, incremental
from lorewell.sources.sinks import Releases


def _pick(names: list[str], *wanted: str) -> Column:
    own = [F.col(c).cast("string") for c in wanted if c in names]
    return text.first_text(*own) if own else F.lit("")


def _list(df: DataFrame, name: str) -> Column:
    kinds = dict(df.dtypes)
    if name not in kinds:
        return F.array().cast("array<string>")
    if kinds[name].startswith("array"):
        return F.filter(F.transform(F.coalesce(F.col(name), F.array().cast("array<string>")), text.strip), lambda x: x != "")
    return text.as_list(name)


def normalize_documents(df: DataFrame, known: Column | None = None) -> DataFrame:
    """The canonical document projection: one select over whatever columns the input has.

    Missing strings become ""; types, dates, authors and access derive from what the row carries.
    `known`: a map of lower-case names to canonical names.
    """
    n = df.columns
    raw = df.select(
        "*",
        F.lower(F.coalesce(F.nullif(_pick(n, "source", "source_type"), F.lit("")), F.lit("local"))).alias("__source"),
        _pick(n, "url", "original_url").alias("__raw_url"),
        F.when(F.size(_list(df, "categories")) > 0, _list(df, "categories")).otherwise(_list(df, "category")).alias("__cats"),
    )
    canon = F.when(urls.is_http("__raw_url"), F.coalesce(urls.canonicalize("__raw_url"), F.col("__raw_url"))).otherwise(F.trim("__raw_url"))
    d = raw.withColumn("__url", canon)
    body = _pick(n, "text", "content")
    outside = F.coalesce(F.col("is_external_reference"), F.lit(False)) if "is_external_reference" in n else F.lit(False)
    kind = F.when(F.col("__source").isin("website", "commit_kb") & (F.col("__url") != "") & ~outside, urls.content_type("__url", "__source", F.col("__cats"))).otherwise(F.coalesce(F.nullif(_pick(n, "content_type"), F.lit("")), F.lit("document")))
    pdf = F.lower("__url").endswith(".pdf") | (_pick(n, "source_type") == "pdf")
    if "pdf_pages" in n:
        pdf = pdf | (F.size("pdf_pages") > 0)
    raw_authors = F.array_join(_list(df, "authors"), ";") if "authors" in n else F.lit("")
    authors = fields.clean_authors(text.first_text(raw_authors, _pick(n, "author")), known)
    links = F.when(F.size(_list(df, "author_urls")) > 0, _list(df, "author_urls")).otherwise(_list(df, "author_url"))
    title = F.coalesce(F.nullif(text.strip(_pick(n, "title")), F.lit("")), F.lit("Untitled"))
    pub, mod = fields.normalize_date(_pick(n, "publication_date", "date")), fields.normalize_date(_pick(n, "modified_date", "updated_date"))
    keep = [c for c in ("is_external_reference", "pdf_pages", "role", "research_areas", "works") if c in n]
    return d.select(
        _pick(n, "document_id", "id", "doc_id").alias("document_id"), F.col("__source").alias("source"), fields.source_priority("__source").alias("source_priority"), F.col("__url").alias("url"),
        F.coalesce(urls.canonicalize(text.first_text(_pick(n, "canonical_url"), F.col("__url"))), F.col("__url")).alias("canonical_url"), title.alias("title"), text.strip(_pick(n, "description", "subtitle")).alias("description"),
        body.alias("text"), kind.alias("content_type"), _pick(n, "section").alias("section"), text.first_text(_pick(n, "category") if dict(df.dtypes).get("category") == "string" else F.lit(""), F.coalesce(F.get("__cats", F.lit(0)), F.lit(""))).alias("category"),
        F.col("__cats").alias("categories"), _pick(n, "subcategory").alias("subcategory"), F.when(F.size(_list(df, "tags")) > 0, _list(df, "tags")).otherwise(F.col("__cats")).alias("tags"),
        authors.alias("authors"), F.coalesce(F.get(authors, F.lit(0)), F.lit("")).alias("author"), links.alias("author_urls"), F.coalesce(F.get(links, F.lit(0)), F.lit("")).alias("author_url"),
        pub.alias("publication_date"), pub.alias("date"), mod.alias("modified_date"), mod.alias("updated_date"), _pick(n, "crawl_date", "scraped_at", "ingested_at").alias("crawl_date"), _pick(n, "parent_url").alias("parent_url"),
        _pick(n, "discovered_from").alias("discovered_from"), _pick(n, "language").alias("language"), F.coalesce(F.nullif(_pick(n, "mime_type"), F.lit("")), F.when(pdf, "application/pdf").when(F.col("__url").startswith("http"), "text/html").otherwise("")).alias("mime_type"),
        F.coalesce(F.nullif(_pick(n, "content_hash"), F.lit("")), text.content_hash(body)).alias("content_hash"), text.word_count(body).alias("word_count"), _pick(n, "document_version").alias("document_version"), pdf.alias("is_pdf"),
        text.first_text(_pick(n, "pdf_url"), F.when(pdf, F.col("__url"))).alias("pdf_url"), _list(df, "internal_links").alias("internal_links"), _list(df, "external_links").alias("external_links"), _list(df, "breadcrumbs").alias("breadcrumbs"),
        fields.access("__source").alias("access"), *keep,
    )


def document_hash() -> Column:
    """Change detection hash of a document's six content fields."""
    return F.sha2(F.to_json(F.struct("title", "text", "authors", "publication_date", "categories", "description")), 256)


def refresh(releases: Releases, version: str, delta: DataFrame, removed: DataFrame, least_ratio: float = 0.9) -> list[str]:
    """Merge a delta into the current release, rebuild chunks and index, validate, promote or fail.

    Returns the errors (none: promoted).  Nothing changes for readers until the pointer moves.
    """
    now = releases.current()
    base = releases.read("documents", now) if now else None
    docs = incremental.merge(base, delta, removed, "document_id") if base is not None else delta
    docs = incremental.collapse(docs.withColumn("__ord", F.xxhash64("document_id")), F.coalesce(F.nullif("canonical_url", F.lit("")), "document_id"), "__ord").drop("__ord")
    releases.stage(version, {"documents": docs})
    docs = releases.read("documents", version)
    releases.stage(version, {"chunks": chunking.chunk_documents(docs)})
    chunks = releases.read("chunks", version)
    index = bm25.build(chunks.withColumn("__s", text.search_text("meta_header", "text")), "chunk_id", "__s")
    releases.stage(version, {"postings": index.postings, "term_idf": index.idf, "doc_len": index.lengths})
    facts = analytics.validate(docs, chunks, "document_id").first()
    errors = [f"{k}: {facts[k]}" for k in ("extra_doc_ids", "extra_chunk_ids", "orphans", "empty_text") if facts[k]]
    if not facts["chunks"]:
        errors.append("no chunks")
    if base is not None:
        errors += [f"{r['error']}: {r['what']} {r['was']} -> {r['now']}" for r in analytics.regression_guard(docs, base).limit(100).collect()]
    if errors:
        releases.fail(version)
    else:
        releases.promote(version)
        releases.prune()
    return errors


