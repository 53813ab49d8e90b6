"""Schemas and the fixed enumerations of the corpus model."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, B = T.StringType(), T.IntegerType(), T.BooleanType()
LIST = T.ArrayType(S)
PDF_PAGE = T.StructType([T.StructField("page_number", I), T.StructField("text", S)])
WORK = T.StructType([T.StructField(n, S) for n in ("document_id", "title", "url", "content_type", "date", "via")])

#: Canonical document; a missing string is "".
DOCUMENT = T.StructType(
    [T.StructField(n, S) for n in ("document_id", "source", "url", "canonical_url", "title", "description", "text", "content_type", "section", "category", "subcategory")]
    + [T.StructField("tags", LIST), T.StructField("author", S), T.StructField("author_url", S), T.StructField("authors", LIST), T.StructField("author_urls", LIST), T.StructField("categories", LIST)]
    + [T.StructField(n, S) for n in ("publication_date", "modified_date", "crawl_date", "parent_url", "discovered_from", "language", "mime_type")]
    + [T.StructField("http_status", I), T.StructField("content_hash", S), T.StructField("word_count", I), T.StructField("document_version", S), T.StructField("is_pdf", B), T.StructField("pdf_url", S)]
    + [T.StructField("internal_links", LIST), T.StructField("external_links", LIST), T.StructField("breadcrumbs", LIST), T.StructField("pdf_pages", T.ArrayType(PDF_PAGE)), T.StructField("is_external_reference", B)]
)
#: One record of a crawl log.
CRAWL = T.StructType(
    [T.StructField(n, S) for n in ("url", "kind", "final_url", "error_type", "error", "discovered_from", "title", "text_hash", "fetched_at", "outcome")]
    + [T.StructField("status", I), T.StructField("retries", I), T.StructField("depth", I), T.StructField("text_len", I)]
    + [T.StructField(n, LIST) for n in ("redirect_chain", "discovery", "inlinks", "outlinks", "malformed_links", "external_links")]
    + [T.StructField("has_author", B), T.StructField("has_date", B)]
)

# Priorities, thresholds and limits that results depend on.
SOURCE_PRIORITY = {"commit_kb": 3, "staff_handbook": 2, "website": 2, "local": 2}
DEFAULT_PRIORITY = 1
PRIORITY_BOOST = 0.12
INTERNAL_SOURCE = "commit_kb"
CONFIDENCE = (("high", 0.62), ("medium", 0.48), ("low", 0.35))
MIN_SCORE = 0.35
RRF_K = 60
MAX_CHUNKS_PER_DOC = 2
TITLE_BOOST, URL_BOOST, INTENT_BOOST, PERSON_BOOST = 1.6, 2.0, 1.3, 1.35
CHUNK_SIZE, CHUNK_OVERLAP, CHUNK_MIN = 1000, 200, 60
CONTEXT_CHARS, MERGED_CHARS = 12_000, 4000
SHORT_TYPES = ("op-ed", "holiday", "event", "person")
BOILERPLATE_DOCS, BOILERPLATE_CHARS = 12, 40
BOILERPLATE_EXEMPT = ("about", "people_index", "person", "holiday", "op-ed")
