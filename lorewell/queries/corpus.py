"""Documents and chunks: hashing, de-duplication, chunking, quality, analytics, validation, maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.functions import fields, text
from lorewell.operators import analytics, chunking, incremental
from lorewell.queries.registry import query
from lorewell.sources.readers import table


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


_HASH = "substr(sha256(text), 1, 24)"
_LINE = "lower(trim(regexp_replace(x, '[ \\t\\r]+', ' ', 'g')))"


@query("content_hash", f"select doc_id, {_HASH} as content_hash, substr(sha256(trim(source)), 1, 16) as source_hash from documents")
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", text.content_hash("text").alias("content_hash"), text.url_hash("source").alias("source_hash"))


@query("first_seen_dedup", "select min(doc_id) as doc_id, text as body from documents group by text")
def first_seen(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).select(text.content_hash("text").alias("h"), "doc_id", F.col("text").alias("body"))
    return chunking.first_seen(d, "h", "doc_id").select("doc_id", "body")


@query("content_hash_dedup", f"select {_HASH} as content_hash, min(doc_id) as doc_id, count(*) as copies from documents group by 1")
def hash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).groupBy(text.content_hash("text").alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("exact_duplicate_groups", f"select {_HASH} as key, count(*) as n, string_agg(doc_id::varchar, ',' order by doc_id) as members from documents group by 1 having count(*) > 1")
def duplicate_groups(spark: SparkSession, sf: str) -> DataFrame:
    from lorewell.operators import linkgraph

    g = linkgraph.duplicate_groups(_docs(spark, sf), text.content_hash("text"), "doc_id")
    return g.select("key", "n", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query("boilerplate_lines", f"select line, count(distinct doc_id) as n_docs from (select doc_id, {_LINE} as line from (select doc_id, unnest(string_split(text, chr(10))) as x from documents)) where length(line) >= 40 group by line having count(distinct doc_id) >= 12")
def boilerplate(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.boilerplate_lines(_docs(spark, sf), "doc_id")


@query(
    "strip_boilerplate_docs",
    f"""with l as (select doc_id, x, {_LINE} as line, pos from (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents)),
b as (select line from l where length(line) >= 40 group by line having count(distinct doc_id) >= 12)
select doc_id, md5(coalesce(string_agg(x, chr(10) order by pos) filter (line not in (select line from b)), '')) as text_md5 from l group by doc_id""",
)
def strip(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).select("doc_id", "text")
    return chunking.strip_boilerplate(d, chunking.boilerplate_lines(d, "doc_id"), "doc_id").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("normalized_line_dedup", f"select doc_id, count(*) as n_lines, count(distinct line) as n_distinct from (select doc_id, {_LINE} as line from (select doc_id, unnest(string_split(text, chr(10))) as x from documents)) group by doc_id")
def line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.transform(F.split("text", "\n", -1), text.norm_line)
    return _docs(spark, sf).select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.size(F.array_distinct(lines)).cast("long").alias("n_distinct"))


_SENT = "list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '([.!?]) +', '\\1' || chr(10), 'g'), chr(10)), lambda s: trim(s)), lambda s: s <> '')"


@query("sentence_split_stats", f"select doc_id, len(s) as n_sentences, list_max(list_transform(s, lambda x: length(x)))::int as longest from (select doc_id, {_SENT} as s from documents)")
def sentence_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = text.sentences("text")
    return _docs(spark, sf).select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.array_max(F.transform(s, F.length)).alias("longest"))


@query(
    "chunk_pack_simple",
    f"""with recursive s as (select doc_id, {_SENT} as s from documents where length(text) > 0),
f(doc_id, s, k, buf, done) as (select doc_id, s, 0, '', null::varchar from s
 union all select doc_id, s, k + 1, case when buf = '' or length(buf) + length(s[k + 1]) + 1 > 1000 then s[k + 1] else buf || ' ' || s[k + 1] end, case when buf <> '' and length(buf) + length(s[k + 1]) + 1 > 1000 then buf end from f where k < len(s)),
c as (select doc_id, done as t, k from f where done is not null union all select doc_id, buf, k + 1 from f where k = len(s) and buf <> '')
select doc_id, (row_number() over (partition by doc_id order by k) - 1)::int as chunk_index, length(t)::int as n_chars, md5(t) as chunk_md5 from c""",
)
def pack_simple(spark: SparkSession, sf: str) -> DataFrame:
    c = _docs(spark, sf).select("doc_id", F.posexplode(chunking.pack_simple(text.sentences("text"))).alias("chunk_index", "t"))
    return c.select("doc_id", "chunk_index", F.length("t").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("chunk_md5"))


@query("chunk_pack_overlap")
def pack_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Sections, overlap tails, hard cuts, quality filter; tests compare it with a plain fold."""
    return chunking.chunk(_docs(spark, sf).select("doc_id", "text"), "doc_id").select("doc_id", "chunk_id", "chunk_index", "heading_path", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("chunk_md5"))


@query("chunk_ids_hashes")
def chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The whole of chunk_documents(): boilerplate, chunks, headers, hashes, first copies."""
    d = _docs(spark, sf).select(F.col("doc_id").cast("string").alias("document_id"), "text", "source", F.col("lang").alias("category"), F.initcap("source").alias("title"))
    return chunking.chunk_documents(d).select("document_id", "chunk_id", "chunk_index", "chunk_hash", F.length("meta_header").alias("header_chars"))


@query(
    "near_dup_token_overlap",
    """with d as (select doc_id, source, list_distinct(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) as t from documents)
select q.doc_id as query_id, d.doc_id, round(len(list_intersect(q.t, d.t)) / len(q.t)::double, 6) as overlap from d join d q on q.source = d.source and q.doc_id <> d.doc_id
where len(q.t) > 0 and round(len(list_intersect(q.t, d.t)) / len(q.t)::double, 6) >= 0.8""",
)
def token_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Token-set overlap of every document with all documents of its source; tokens are compared by their 64-bit hashes."""
    from lorewell.operators import overlap

    tok = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1)))
    got = overlap.contained(_docs(spark, sf), "doc_id", "source", F.transform(tok, lambda x: F.xxhash64(x)), 0.8 - 5e-7)
    return got.select("query_id", F.col("id").alias("doc_id"), F.round(F.col("hits") / F.col("n"), 6).alias("overlap")).where("overlap >= 0.8")


@query("quality_ascii_ratio", "select doc_id, round(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / nullif(length(text), 0)::double, 6) as letters from documents")
def ascii_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.round(F.length(F.regexp_replace("text", "[^A-Za-z]", "")) / F.nullif(F.length("text"), F.lit(0)), 6).alias("letters"))


@query("quality_vs_labels", "select quality, count(*) as n, round(avg(round(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / nullif(length(text), 0)::double, 6)), 6) as letters from documents join labels using (doc_id) group by quality")
def quality_labels(spark: SparkSession, sf: str) -> DataFrame:
    return ascii_ratio(spark, sf).join(table(spark, sf, "labels"), "doc_id").groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("letters"), 6).alias("letters"))


_NOISE = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{80}-\\x{9F}\\x{250}-\\x{2AF}\\x{300}-\\x{36F}\\x{370}-\\x{3FF}\\x{400}-\\x{4FF}\\x{530}-\\x{5FF}\\x{600}-\\x{6FF}\\x{2500}-\\x{259F}\\x{E000}-\\x{F8FF}\\x{FFFD}]"


@query(
    "quality_score_docs",
    f"""with u as (select doc_id, 0 as line, coalesce(text, '') as t from documents union all select doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1), unnest(string_split(coalesce(text, ''), chr(10))) from documents),
k as (select doc_id, line, unnest(regexp_split_to_array(t, '\\s+')) as w from u),
f as (select *, length(w) as n, length(regexp_replace(w, '[\\x00-\\x7F]', '', 'g')) as far from k),
g as (select doc_id, line, sum(n) as bad from f where regexp_matches(w, '{_NOISE}') or (regexp_matches(w, '\\pL') and (regexp_matches(regexp_replace(w, '[\\x00-\\x7F]', ' ', 'g'), '\\pL{{4}}')
  or (n >= 5 and far / n >= 0.4::double and not regexp_matches(w, '[aeiouAEIOU]')) or (n >= 6 and far / n >= 0.5::double))) group by all),
q as (select u.*, length(regexp_replace(t, '\\s+', '', 'g')) as total, coalesce(bad, 0) as bad, length(t) - length(regexp_replace(t, '{_NOISE}', '', 'g')) as noise from u left join g using (doc_id, line)),
s as (select doc_id, line, t, case when total = 0 then 1.0::double else greatest(0.0::double, least(1 - bad / total::double, 1 - least(1.0::double, noise / greatest(1, length(t))::double * 4))) end as quality from q)
select doc_id, round(max(quality) filter (line = 0), 6) as quality, (count(*) filter (line > 0 and quality < 0.5 and trim(t) <> ''))::int as dropped_lines from s group by doc_id""",
)
def quality_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.round(text.quality_score("text"), 6).alias("quality"), F.size(text.dropped_lines("text")).alias("dropped_lines"))


#: Every fifth text as it looks after one wrong decoding of its accents and apostrophes; DuckDB sees the sound text.
_TIDY = "trim(regexp_replace(regexp_replace(regexp_replace({t}, '[ \\t\u00a0]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10) || ' ')"


def _broken(c: Column) -> Column:
    for sound, bad in (("é", "Ã©"), ("ñ", "Ã±"), ("ä", "Ã¤"), ("’", "â€™")):
        c = F.replace(c, F.lit(sound), F.lit(bad))
    return c


@query("mojibake_flag_counts", "select lang, count(*) as n, count(*) filter (doc_id % 5 = 0 and regexp_matches(text, '[éñä’]')) as broken from documents group by lang")
def mojibake_counts(spark: SparkSession, sf: str) -> DataFrame:
    from lorewell.functions import mojibake

    d = _docs(spark, sf).withColumn("text", F.when(F.col("doc_id") % 5 == 0, _broken(F.col("text"))).otherwise(F.col("text")))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(mojibake.has_mojibake("text")).alias("broken"))


@query("mojibake_repair", f"select doc_id, md5({_TIDY.format(t='text')}) as fixed_md5 from documents where text is not null")
def mojibake_repair(spark: SparkSession, sf: str) -> DataFrame:
    from lorewell.functions import mojibake

    d = _docs(spark, sf).where("text is not null").select("doc_id", F.when(F.col("doc_id") % 5 == 0, _broken(F.col("text"))).otherwise(F.col("text")).alias("text"))
    return mojibake.clean_column(d, "text", "doc_id").select("doc_id", F.md5(F.col("text").cast("binary")).alias("fixed_md5"))


@query(
    "clean_records",
    """select doc_id, md5(coalesce(text, '')) as text_md5, lang || ' café' as note, 'https://x.example/é' || doc_id as url, lang || '|é|' || source as tags from (select * replace (trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), chr(10) || ' ') as text) from documents)""",
)
def clean_records(spark: SparkSession, sf: str) -> DataFrame:
    """Broken text, URLs and list items; a third of the texts is sound."""
    from lorewell.functions import mojibake

    d = _docs(spark, sf).select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(_broken(F.col("text"))).alias("text"), F.concat("lang", F.lit(" cafÃ©")).alias("note"),
        F.concat(F.lit(" https://x.example/Ã©"), "doc_id", F.lit(" ")).alias("url"), F.array("lang", F.lit("Ã©"), "source").alias("tags"),
    )
    return mojibake.clean_records(d).select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), "note", "url", F.array_join("tags", "|").alias("tags"))


@query(
    "chunk_base_metadata",
    """select doc_id::varchar as document_id, case when doc_id % 2 = 0 then 'Untitled' else upper(source) end as title, case when doc_id % 5 = 0 then 'local' else source end as source, substr(coalesce(text, ''), 1, 400) as description, lang || '|' || source as authors, lang as author, 'Website' as source_name,
'2024-01-02' as date, 'blog' as document_type, 'public' as access, 'editor' as role, case when doc_id % 2 = 0 then '' else 'Title: ' || upper(source) || chr(10) end || 'Author: ' || lang || ', ' || source || chr(10) || 'Published: 2024-01-02' || chr(10) || 'Type: blog' || chr(10) || 'Source: Website' as meta_header from documents""",
)
def base_metadata(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    d = _docs(spark, sf).select(
        k.cast("string").alias("id"), F.when(k % 2 == 1, F.upper("source")).alias("title"), F.when(k % 5 != 0, F.col("source")).otherwise("").alias("source"), F.col("text").alias("description"), F.array("lang", "source").alias("authors"),
        F.lit("Website").alias("source_name"), F.lit("2024-01-02").alias("publication_date"), F.lit("blog").alias("content_type"), F.lit("editor").alias("role"),
    )
    out = chunking.base_metadata(d)
    return out.select("document_id", "title", "source", "description", F.array_join("authors", "|").alias("authors"), "author", "source_name", "date", "document_type", "access", "role", "meta_header")


@query("doc_counts_by_source", "select source, count(*) as n from documents group by source")
def by_source(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.counts(_docs(spark, sf), "source")


@query("counts_source_lang_rollup", "select source, lang, count(*) as n from documents group by rollup (source, lang)")
def rollup(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).rollup("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("top_tokens", "select value, count(*) as n from (select unnest(regexp_extract_all(lower(text), '([a-z]+)', 1)) as value from documents) group by value order by n desc, value limit 20")
def top_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.top_n(_docs(spark, sf), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))), 20)


@query("length_stats", "select count(*) as total, count(*) filter (source = 'src1') as internal, round(avg(length(text)), 6) as avg_chars, max(length(text))::int as max_chars from documents")
def length_stats(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.chunk_summary(_docs(spark, sf), F.col("source") == "src1")


@query("coverage_pct", " union all ".join(f"select '{c}' as field, round(count(*) filter ({c} is not null and {c}::varchar <> '') * 100.0::double / count(*), 6) as pct from documents" for c in ("text", "lang", "source", "n_chars")))
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.coverage(_docs(spark, sf), ["text", "lang", "source", "n_chars"])


@query("label_coverage", "select d.source, count(*) as n, count(l.doc_id) as labelled, round(count(l.doc_id) / count(*)::double, 6) as share from documents d left join labels l using (doc_id) group by d.source")
def label_coverage(spark: SparkSession, sf: str) -> DataFrame:
    lab = table(spark, sf, "labels").select("doc_id", F.lit(1).alias("l"))
    return _docs(spark, sf).select("doc_id", "source").join(lab, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("l").alias("labelled"), F.round(F.count("l") / F.count(F.lit(1)), 6).alias("share"))


@query("kb_composition", "select source, case when n_chars < 500 then 'short' when n_chars < 5000 then 'medium' else 'long' end as kind, count(*) as n from documents group by all")
def composition(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 5000, "medium").otherwise("long")
    return analytics.counts(_docs(spark, sf), "source", kind.alias("kind"))


@query("word_and_token_counts", "select doc_id, len(w)::int as words, floor(len(w) * 1.33::double)::int as approx_tokens from (select doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda x: x <> '') as w from documents)")
def words(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", text.word_count("text").alias("words"), text.approx_tokens("text").alias("approx_tokens"))


@query("slug_and_truncate", "select doc_id, trim(regexp_replace(regexp_replace(lower(source || ' ' || lang), '[^a-z0-9 _-]', '', 'g'), '[ _-]+', '-', 'g'), '-') as slug, case when length(text) <= 300 then text else regexp_replace(substr(text, 1, 300), ' [^ ]*$', '') || '…' end as short from documents")
def slugs(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", text.slugify(F.concat_ws(" ", "source", "lang")).alias("slug"), text.truncate("text").alias("short"))


@query("meta_header", "select doc_id, 'Title: ' || upper(source) || chr(10) || 'Category: ' || lang || chr(10) || 'Tags: ' || lang || ', ' || source as header from documents")
def header(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).select("doc_id", F.upper("source").alias("title"), F.col("lang").alias("category"), F.array("lang", "source").alias("tags"), F.lit("").alias("author"), F.lit(" ").alias("date"))
    return d.select("doc_id", text.meta_header(d.columns).alias("header"))


@query(
    "explorer_filter",
    "select doc_id from documents where regexp_matches(text, '(?i)th[aeiou]') and source = 'src3'",
)
def explorer(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.explorer(_docs(spark, sf).withColumn("title", F.lit("")), q="th[aeiou]", source="src3").select("doc_id")


# ------------------------------------------------------------- validation
@query("validate_dup_ids", "select vec_id % 400 as id, count(*) as n from embeddings group by 1 having count(*) > 1")
def dup_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").groupBy((F.col("vec_id") % 400).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("validate_orphans", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def orphans(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query(
    "validate_regression_guard",
    """with a as (select source, count(*) as was from documents group by source), b as (select source, count(*) as now from documents where lang = 'en' and source <> 'src7' group by source),
m as (select a.source, coalesce(now, 0) as now, was from a left join b using (source))
select 'source_vanished' as error, source as what, was, now from m where was >= 5 and now = 0 union all select 'count_dropped', 'all', sum(was)::bigint, sum(now)::bigint from m having sum(now) < sum(was) * 0.9""",
)
def guard(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf)
    return analytics.regression_guard(d.where("lang = 'en' and source <> 'src7'"), d)


@query("validate_summary", "select count(*) as documents, count(*) filter (trim(text) = '') as empty_text, count(*) - count(distinct doc_id) as extra_doc_ids from documents")
def summary(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf)
    chunks = d.select("doc_id", F.col("doc_id").cast("string").alias("chunk_id"), "text").withColumn("doc_id", F.col("doc_id").cast("string"))
    return analytics.validate(d, chunks, "doc_id").select("documents", "empty_text", "extra_doc_ids")


# ------------------------------------------------------------- maintenance
_OLD = "(select doc_id, substr(sha256(text), 1, 24) as content_hash from documents where lang <> 'es')"
_NEW = "(select doc_id, substr(sha256(case when lang = 'fr' then text || '.' else text end), 1, 24) as content_hash from documents where source <> 'src3')"


def _old_new(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = _docs(spark, sf)
    new = F.when(F.col("lang") == "fr", F.concat("text", F.lit("."))).otherwise(F.col("text"))
    return d.where("lang <> 'es'").select("doc_id", text.content_hash("text").alias("content_hash")), d.where("source <> 'src3'").select("doc_id", text.content_hash(new).alias("content_hash"))


@query("change_classification", f"select coalesce(n.doc_id, o.doc_id) as doc_id, case when o.doc_id is null then 'new' when n.doc_id is null then 'missing' when o.content_hash = n.content_hash then 'unchanged' else 'modified' end as change from {_NEW} n full join {_OLD} o using (doc_id)")
def change(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _old_new(spark, sf)
    return incremental.classify(old, new, "doc_id")


@query("merge_upsert", f"select coalesce(n.doc_id, o.doc_id) as doc_id, coalesce(n.content_hash, o.content_hash) as content_hash from {_NEW} n full join {_OLD} o using (doc_id)")
def upsert(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _old_new(spark, sf)
    return incremental.merge(old, new, old.limit(0), "doc_id")


@query("merge_delete", f"select coalesce(n.doc_id, o.doc_id) as doc_id, coalesce(n.content_hash, o.content_hash) as content_hash from {_NEW} n full join {_OLD} o using (doc_id) where coalesce(n.doc_id, o.doc_id) not in (select doc_id from labels where toxic = 1)")
def delete(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _old_new(spark, sf)
    return incremental.merge(old, new, table(spark, sf, "labels").where("toxic = 1").select("doc_id"), "doc_id")


@query("hash_set_delta", f"select count(*) filter (o.h is null) as added, count(*) filter (n.h is null) as removed, count(*) filter (o.h is not null and n.h is not null) as kept from (select distinct content_hash as h from {_NEW}) n full join (select distinct content_hash as h from {_OLD}) o on n.h = o.h")
def delta(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _old_new(spark, sf)
    return incremental.hash_delta(old, new, "content_hash")


@query("embedding_cache_misses", "select doc_id from documents where doc_id not in (select vec_id from embeddings)")
def cache_misses(spark: SparkSession, sf: str) -> DataFrame:
    chunks = _docs(spark, sf).select("doc_id", F.col("doc_id").alias("chunk_hash"))
    return chunking.embed_missing(chunks, table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_hash"), "embedding"))[1].select("doc_id")


@query("collapse_by_url_richest", "select doc_id, source from (select *, row_number() over (partition by source, n_chars % 10 order by (lang <> '')::int desc, length(text) desc, doc_id) as r from documents) where r = 1")
def collapse(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).select("doc_id", "source", "text", F.col("lang").alias("author"), (F.col("n_chars") % 10).alias("k"))
    return incremental.collapse(d, F.struct("source", "k"), "doc_id").select("doc_id", "source")


#: Runs are the days of January; a user is seen on the days of their events.
_RUNS = """d as (select distinct user_id, ts::date as day from events), u as (select distinct user_id from events), c as (select distinct ts::date as day from events),
g as (select u.user_id, c.day, d.day is not null as seen from u cross join c left join d using (user_id, day)),
m as (select *, coalesce(max(case when seen then rn end) over (partition by user_id order by day), 0) as last_seen from (select *, row_number() over (partition by user_id order by day) as rn from g)),
k as (select user_id, day, (rn - last_seen)::int as missing_count from m)"""


def _misses(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    days = d.select("day").distinct()
    grid = d.select("user_id").distinct().crossJoin(F.broadcast(days))  # 30 days
    runs = grid.join(d.withColumn("seen", F.lit(True)), ["user_id", "day"], "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    return incremental.misses(runs, "user_id", "day", "seen")


@query("miss_confirmations", f"with {_RUNS} select user_id, day, missing_count, missing_count >= 2 as confirmed from k")
def misses(spark: SparkSession, sf: str) -> DataFrame:
    return _misses(spark, sf)


@query(
    "removal_decisions",
    f"""with {_RUNS}, z as (select user_id, missing_count > 1 as confirmed from k where day = (select max(day) from k) and missing_count > 0)
select user_id, case when not confirmed then 'pending' when user_id % 4 = 0 then 'removed' when user_id % 4 = 1 then 'unlinked_but_live' else 'deferred' end as outcome from z""",
)
def removal(spark: SparkSession, sf: str) -> DataFrame:
    """Users missing on the last day, rechecked with a status that follows from their number."""
    m = _misses(spark, sf)
    last = m.where("missing_count > 0").join(F.broadcast(table(spark, sf, "events").agg(F.to_date(F.max("ts")).alias("day"))), "day")
    k = F.col("user_id") % 4
    again = last.select("user_id", F.when(k == 0, 404).when(k == 1, 200).when(k == 2, 503).alias("status"))
    return incremental.removals(last, again, True, 1, 10, "user_id")


_MOVED = "case when doc_id % 4 = 1 then doc_id + 1 end"


@query("redirect_replaced", f"select a.doc_id as url, a.source as document_id from (select *, {_MOVED} as moved from documents) a join documents b on a.moved = b.doc_id where b.lang = 'en' and a.source <> b.source")
def redirected(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).select(F.col("doc_id").alias("url"), F.col("source").alias("document_id"), F.when(F.col("doc_id") % 4 == 1, F.col("doc_id") + 1).alias("redirected_to"), (F.col("lang") == "en").alias("seen"))
    return incremental.redirected(d)


_WHY = "case when lang <> 'es' then 'kept' when doc_id % 4 = 1 then 'redirected → ' || (doc_id + 1) when doc_id % 4 = 2 then 'removed' else 'not crawled' end"


def _reconciled(spark: SparkSession, sf: str) -> DataFrame:
    d, k = _docs(spark, sf), F.col("doc_id") % 4
    old = d.select(F.col("doc_id").alias("url"), F.when(k == 1, (F.col("doc_id") + 1).cast("string")).alias("redirected_to"), F.when(k == 2, 404).when(k == 3, 200).alias("status"))
    return incremental.reconcile(old, d.where("lang <> 'es'").select(F.col("doc_id").alias("url")))


@query("reconcile_legacy", f"select doc_id as url, {_WHY} as reason from documents")
def reconcile(spark: SparkSession, sf: str) -> DataFrame:
    return _reconciled(spark, sf)


@query("reconciliation_reasons", f"select trim(split_part({_WHY}, ' →', 1)) as reason, count(*) as n from documents group by 1")
def reasons(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.reasons(_reconciled(spark, sf))


@query("removed_or_replaced", f"select doc_id from documents where doc_id % 7 = 3 union select a.doc_id from (select *, {_MOVED} as moved from documents) a join documents b on a.moved = b.doc_id where b.lang = 'en' and a.source <> b.source")
def gone(spark: SparkSession, sf: str) -> DataFrame:
    removed = _docs(spark, sf).where("doc_id % 7 = 3").select("doc_id")
    return incremental.to_delete(removed, redirected(spark, sf).select(F.col("url").alias("doc_id")))


@query("lost_sources", "select distinct source as value, 'source' as kind from documents where source not in (select source from documents where doc_id % 40 > 3) union all select doc_id::varchar, 'document' from documents where doc_id % 40 <= 3")
def lost(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf)
    return incremental.lost(d, d.where("doc_id % 40 > 3"), {"source": "source", "document": "doc_id"})


@query("cache_pruned", "select vec_id as chunk_hash, label from embeddings where vec_id in (select doc_id from documents where lang <> 'fr')")
def pruned(spark: SparkSession, sf: str) -> DataFrame:
    cache = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_hash"), "label")
    return chunking.prune_cache(cache, _docs(spark, sf).where("lang <> 'fr'").select(F.col("doc_id").alias("chunk_hash")))


# ------------------------------------------------------------- fields
_FORMS = ["%Y-%m-%dT%H:%M:%SZ", "%B %-d, %Y", "%-d %b %Y", "%B %Y", " %Y ", "on %A", "%d/%m/%Y", "%Y/%-m/%-d"]
_JAVA = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "MMMM d, yyyy", "d MMM yyyy", "MMMM yyyy", "' 'yyyy' '", "'on 'EEEE", "dd/MM/yyyy", "yyyy/M/d"]


def _written(ts: Column, form: Column) -> Column:
    out = None
    for k, f in enumerate(_JAVA):
        v = F.date_format(ts, f)
        out = F.when(form == k, v) if out is None else out.when(form == k, v)
    return out


@query("date_normalize", "select event_id, case event_id % 8 when 3 then strftime(ts, '%Y-%m') when 4 then strftime(ts, '%Y') when 5 then '' else strftime(ts, '%Y-%m-%d') end as d from events")
def dates(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select("event_id", fields.normalize_date(_written(F.col("ts"), F.col("event_id") % 8)).alias("d"))


@query("date_parse_legacy", "select event_id, case event_id % 8 when 3 then strftime(ts, '%Y-%m') when 4 then strftime(ts, '%Y') when 5 then strftime(ts, 'on %A') else strftime(ts, '%Y-%m-%d') end as d from events")
def legacy_dates(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select("event_id", fields.parse_date(_written(F.col("ts"), F.col("event_id") % 8)).alias("d"))


#: People: a first name for each nation, with its region's name as family name.
_PEOPLE = "p as (select n_nationkey as k, chr(65 + n_nationkey) || 'ena ' || upper(r_name[1]) || lower(regexp_replace(r_name[2:], ' .*', '')) as name from nation join region on n_regionkey = r_regionkey)"


def _people(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(F.col("n_nationkey").alias("k"), F.concat(F.char(65 + F.col("n_nationkey")), F.lit("ena "), F.initcap(F.regexp_replace("r_name", " .*", ""))).alias("name"))


def _bylines(spark: SparkSession, sf: str) -> DataFrame:
    """documents with the two people (a, b) that their number names."""
    p = _people(spark, sf)
    a, b = p.select(F.col("k").alias("ka"), F.col("name").alias("a")), p.select(F.col("k").alias("kb"), F.col("name").alias("b"))
    d = _docs(spark, sf).join(F.broadcast(a), F.col("doc_id") % 25 == F.col("ka"))  # 25 nations
    return d.join(F.broadcast(b), F.col("doc_id") * 7 % 25 == F.col("kb"))


_BYLINES = f"{_PEOPLE}, y as (select d.doc_id, d.source, a.name as a, b.name as b from documents d join p a on doc_id % 25 = a.k join p b on doc_id * 7 % 25 = b.k)"


@query(
    "author_split_clean",
    f"with {_BYLINES} select doc_id, case when doc_id % 4 = 2 then a when a = b then a else a || '|' || case when doc_id % 4 = 3 then upper(b) else b end end as authors from y",
)
def authors(spark: SparkSession, sf: str) -> DataFrame:
    """Bylines in four spellings; in the fourth a known person's canonical name replaces a small one."""
    k = F.col("doc_id") % 4
    raw = F.when(k == 0, F.concat_ws(" and ", "a", "b")).when(k == 1, F.concat_ws("; ", "a", F.lit("Executive Summary"), "b")).when(k == 2, F.concat_ws(", ", "a", F.lit("2024 Report"))).otherwise(F.concat_ws(" & ", "a", F.lower("b")))
    known = F.when((k == 3) & (F.col("a") != F.col("b")), F.create_map(F.lower("b"), F.upper("b"))).when(k == 3, F.create_map(F.lower("b"), F.col("b"))).otherwise(F.create_map(F.lit(""), F.lit("")))
    return _bylines(spark, sf).select("doc_id", F.array_join(fields.clean_authors(raw, known), "|").alias("authors"))


@query(
    "people_graph",
    f"""with {_BYLINES}, w as (select distinct doc_id // 3 as work, unnest([a, b]) as name from y where doc_id % 5 <> 0), n as (select name, count(*) as n from w group by name), o as (select distinct a as name from y where doc_id % 5 = 0)
select lower(name) as key, name, coalesce(n, 0)::int as work_count, case when o.name is null then '' else 'https://x.example/content/team/' || replace(lower(name), ' ', '-') end as profile_url from n full join o using (name)""",
)
def people_graph(spark: SparkSession, sf: str) -> DataFrame:
    from lorewell.operators import people

    own = F.col("doc_id") % 5 == 0
    page = F.concat(F.lit("https://x.example/content/team/"), F.replace(F.lower("a"), F.lit(" "), F.lit("-")))
    d = _bylines(spark, sf).select(
        F.col("doc_id").cast("int").alias("doc_ord"), F.col("doc_id").cast("string").alias("document_id"), F.when(own, "person").otherwise("blog").alias("content_type"), F.when(own, F.col("a")).otherwise("A post").alias("title"),
        F.when(own, page).otherwise(F.concat(F.lit("https://x.example/b"), F.floor(F.col("doc_id") / 3))).alias("url"), F.when(own, F.array().cast("array<string>")).otherwise(F.array("a", "b")).alias("authors"),
        F.array().cast("array<string>").alias("author_urls"), F.lit("2024-01-01").alias("date"), F.lit("").alias("publication_date"), F.lit("").alias("role"),
    )
    return people.graph(d).select("key", "name", "work_count", "profile_url")


@query(
    "normalize_documents",
    f"""with {_BYLINES} select doc_id::varchar as document_id, 'website' as source, 3 - 1 as source_priority, 'https://x.example/content/blogs/' || doc_id as url, case when doc_id % 2 = 0 then 'op-ed' else 'blog' end as content_type,
strftime(date '2024-01-01' + (doc_id % 300)::int, '%Y-%m-%d') as date, a as author, case when a = b then 1 else 2 end as n_authors, 'public' as access, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\r\\n]+'), lambda x: x <> ''))::int as word_count,
substr(sha256(coalesce(text, '')), 1, 24) as content_hash, case when doc_id % 3 = 0 then 'Untitled' else source end as title, 'text/html' as mime_type, false as is_pdf, case when doc_id % 2 = 0 then 'Op-Ed,Trade' else 'Trade' end as categories
from y join documents using (doc_id, source)""",
)
def normalize(spark: SparkSession, sf: str) -> DataFrame:
    from lorewell.plans import ingest

    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")), "d MMMM yyyy")
    raw = _bylines(spark, sf).select(
        F.col("doc_id").cast("string").alias("id"), F.lit("Website").alias("source"), F.concat(F.lit("https://X.example//content/blogs/"), "doc_id", F.lit("?utm_source=q#top")).alias("url"),
        F.when(F.col("doc_id") % 2 == 0, "Op-Ed; Trade").otherwise("Trade").alias("category"), F.col("text").alias("content"), day.alias("date"), F.concat_ws(", ", "a", "b", F.lit("Staff")).alias("author"),
        F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.col("source")).alias("title"),
    )
    out = ingest.normalize_documents(raw)
    return out.select("document_id", "source", "source_priority", "url", "content_type", "date", "author", F.size("authors").alias("n_authors"), "access", "word_count", "content_hash", "title", "mime_type", "is_pdf", F.array_join("categories", ",").alias("categories"))
