"""Source lists, search results, suggestions and refresh reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.functions import fields
from lorewell.operators import analytics, bm25, people, presentation
from lorewell.plans.tables import shared_dir
from lorewell.queries.registry import query
from lorewell.queries.retrieval import STOP
from lorewell.sources import readers, sinks
from lorewell.sources.readers import table

#: All turns of a conversation as its sources, assistant turns as its answers, each citing two of them or none.
_SOURCES = "s as (select conv_id, row_number() over (partition by conv_id order by turn) as n, role as title, substring(text, 1, 4) as url from conversations), m as (select *, min(n) over (partition by conv_id, lower(title), lower(url)) as f from s), k as (select *, dense_rank() over (partition by conv_id order by f)::int as shown from m)"


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf, "conversations").select("conv_id", n.alias("n"), F.col("role").alias("title"), F.substring("text", 1, 4).alias("url"))


@query("source_dedupe_remap", f"with {_SOURCES} select conv_id, n, shown from k")
def remap(spark: SparkSession, sf: str) -> DataFrame:
    return presentation.merged_sources(_sources(spark, sf), "conv_id").select("conv_id", "n", "shown")


@query(
    "displayed_sources",
    f"""with {_SOURCES}, c as (select conv_id, max(turn) as t from conversations group by conv_id),
marks as (select conv_id, unnest([2 + t % 3, 1]) as n, unnest([0, 1]) as pos from c where t % 4 <> 0),
cited as (select conv_id, shown, min(pos) as pos from k join marks using (conv_id, n) group by conv_id, shown),
u as (select * from cited union all select conv_id, 1, 0 from c where conv_id not in (select conv_id from cited)),
h as (select conv_id, shown, min(n) as n, arg_min(title, n) as title, arg_min(url, n) as url from k group by conv_id, shown)
select conv_id, row_number() over (partition by conv_id order by pos) as place, n, title, url from h join u using (conv_id, shown)""",
)
def displayed(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("t"))
    marks = F.concat(F.lit("A [Source "), (2 + F.col("t") % 3).cast("string"), F.lit("] and [Source 1]."))
    answers = c.select("conv_id", F.when(F.col("t") % 4 != 0, marks).otherwise("Nothing cited.").alias("answer"))
    return presentation.displayed_sources(answers, _sources(spark, sf), "conv_id")


@query(
    "search_results_distinct",
    """with o as (select lang, doc_id, source as title, coalesce(substring(text, 1, 1), '') as url from documents),
d as (select *, row_number() over (partition by lang, lower(title), lower(url) order by doc_id) as r from o),
p as (select *, row_number() over (partition by lang order by doc_id) as place from d where r = 1)
select lang, place, doc_id, title, url from p where place <= 8""",
)
def results(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "documents").select("lang", "doc_id", F.col("source").alias("title"), F.coalesce(F.substring("text", 1, 1), F.lit("")).alias("url"))
    return presentation.search_results(hits, [F.col("doc_id")], "lang").select("lang", "place", "doc_id", "title", "url")


@query(
    "followup_suggestions",
    """select doc_id, case when n_chars % 3 = 0 then 'What else has ' || source || ' written?|What other ' || lang || ' content is there?|Summarise the key points.'
when n_chars % 3 = 1 then 'What other ' || lang || ' content is there?|Summarise the key points.|What are the main recommendations?' else 'Summarise the key points.|What are the main recommendations?' end as ideas from documents""",
)
def suggestions(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("n_chars") % 3
    author, category = F.when(kind == 0, F.concat("source", F.lit(", Second Author"))).otherwise(""), F.when(kind < 2, F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(presentation.followups(author, category), "|").alias("ideas"))


@query("source_previews", "select doc_id, rtrim(substring(coalesce(text, ''), 1, 320), ' ') as preview from documents")
def previews(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", presentation.preview("text").alias("preview"))


@query("change_type_matrix", "select user_id, event_type, case when value > 50 then 'large' else 'unknown' end as content_type, count(*) as n from events group by all")
def matrix(spark: SparkSession, sf: str) -> DataFrame:
    changes = table(spark, sf, "events").withColumn("content_type", F.when(F.col("value") > 50, "large").otherwise(""))
    return presentation.change_matrix(changes, "user_id", "event_type")


@query(
    "rebuild_summary",
    """with o as (select distinct md5(text) as h from documents where text is not null and lang <> 'fr'), w as (select doc_id, md5(text) as h from documents where text is not null and lang <> 'de')
select (select count(*) from w) as chunks, (select count(distinct doc_id) from w) as documents, (select count(distinct h) from w where h not in (select h from o)) as new_hashes,
(select count(*) from o where h not in (select h from w)) as removed_hashes, (select count(*) from o where h in (select h from w)) as kept_hashes""",
)
def rebuild(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("document_id"), "lang", F.md5(F.col("text").cast("binary")).alias("chunk_hash"))
    return presentation.rebuild_summary(d.where("lang <> 'fr'"), d.where("lang <> 'de'"))


@query(
    "two_level_changes",
    """select lang, case when lang = 'es' then 'new' when lang = 'fr' then 'touched' when lang = 'de' then 'changed' else 'unchanged' end as change, count(*) as n from documents where text is not null group by all""",
)
def two_level(spark: SparkSession, sf: str) -> DataFrame:
    """French texts come back with other blanks, German ones with another word, Spanish ones for the first time."""
    d = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("url"), "lang", "text")
    now = F.when(F.col("lang") == "fr", F.concat(F.lit("  "), "text")).when(F.col("lang") == "de", F.concat("text", F.lit(" neu"))).otherwise(F.col("text"))

    def hashes(df: DataFrame) -> DataFrame:
        return df.select("url", "lang", F.sha2("text", 256).alias("raw_hash"), F.sha2(F.ltrim("text"), 256).alias("text_hash"))

    seen = presentation.two_level_changes(hashes(d.where("lang <> 'es'")), hashes(d.withColumn("text", now)))
    return seen.groupBy("lang", "change").agg(F.count(F.lit(1)).alias("n"))


@query(
    "listing_entry_changes",
    """with l as (select conv_id, max(turn) as top, min(turn) as low from conversations group by conv_id),
x as (select conv_id as listing, turn as url, role, turn = low as fresh, turn = top as gone from conversations join l using (conv_id))
select listing, url, case when fresh then 'new' when gone then 'missing' when role = 'assistant' then 'changed' else 'unchanged' end as change, bool_or(fresh or not gone) over (partition by listing) as parent_alive from x""",
)
def listing(spark: SparkSession, sf: str) -> DataFrame:
    """First turns are new, last turns have gone, assistant turns have another text."""
    c = table(spark, sf, "conversations")
    ends = c.groupBy(F.col("conv_id").alias("c")).agg(F.max("turn").alias("top"), F.min("turn").alias("low"))
    x = c.join(ends, F.col("conv_id") == F.col("c")).select(F.col("conv_id").alias("listing"), F.col("turn").alias("url"), "text", "role", "top", "low")
    now = x.where("url <> top or url = low").withColumn("text", F.when(F.col("role") == "assistant", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return presentation.listing_changes(x.where("url <> low"), now)


@query("lru_answers", "select user_id, max(ts) as last_used from events group by user_id order by last_used desc, user_id limit 300")
def lru(spark: SparkSession, sf: str) -> DataFrame:
    return presentation.least_recently_used(table(spark, sf, "events"), "user_id", "ts")


_FRAME = "doc_id::varchar as document_id, upper(source) as title, source, lang || ', ' || source as authors, lang as category, source as tags, '20' || (10 + doc_id % 15) || '-01-02' as date, '20' || (10 + doc_id % 15) as year, 'blog' as content_type, 'https://x.example/' || doc_id as url, length(coalesce(text, ''))::int as chars, substr(coalesce(text, ''), 1, 300) as preview"


def _frame(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").cast("string").alias("document_id"), F.upper("source").alias("title"), "source", F.array("lang", "source").alias("authors"), F.col("lang").alias("category"), F.array("source").alias("tags"), F.concat(F.lit("20"), 10 + F.col("doc_id") % 15, F.lit("-01-02")).alias("date"), F.lit("blog").alias("content_type"), F.concat(F.lit("https://x.example/"), "doc_id").alias("url"), "text")


@query("explorer_frame", f"select {_FRAME} from documents")
def explorer_frame(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.explorer_frame(_frame(spark, sf))


@query("explorer_all_filters", "select doc_id::varchar as document_id from documents where lang = 'en' and contains(source, 'rc1') and doc_id % 15 in (3, 4, 5, 6, 7, 8) and regexp_matches(text, '(?i)th[aeiou]') and '20' || (10 + doc_id % 15) = '2015'")
def explorer_all(spark: SparkSession, sf: str) -> DataFrame:
    d = _frame(spark, sf).withColumn("year", F.substring("date", 1, 4))
    return analytics.explorer(d, q="th[aeiou]", category="en", author="RC1", tag="rc1", year="2015", content_type="blog").select("document_id")


@query("valid_people", "select name, count(*) as n from (select case doc_id % 6 when 0 then 'Anna ' || source when 1 then lang when 2 then source || ' 2024' when 3 then 'Li Wei' when 4 then 'Meera' else upper(lang) || ' Blog' end as name from documents) where not regexp_matches(name, '[0-9]') and contains(name, ' ') and lower(name) not in (select lower(lang) || ' blog' from documents where doc_id % 2 = 0) group by name")
def valid_people(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id") % 6
    name = F.when(k == 0, F.concat(F.lit("Anna "), "source")).when(k == 1, F.col("lang")).when(k == 2, F.concat("source", F.lit(" 2024"))).when(k == 3, "Li Wei").when(k == 4, "Meera").otherwise(F.concat(F.upper("lang"), F.lit(" Blog")))
    d = table(spark, sf, "documents").select(F.array(name).alias("authors"), F.lit("x").alias("category"), F.lit("").alias("content_type"), F.when(F.col("doc_id") % 2 == 0, F.array(F.concat("lang", F.lit(" blog")))).alias("tags"))
    return analytics.valid_people(d)


@query("unique_values", "select distinct trim(source) as source from documents where source is not null and lower(source) not in ('src3', '') order by source")
def unique_values(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.when(F.col("source") == "src3", " Unknown ").otherwise(F.concat("source", F.lit(" "))).alias("source"))
    return analytics.unique_sorted(d, "source")


@query("run_totals", "select count(*) filter (event_type = 'click') as new, count(*) filter (event_type = 'view') as changed, coalesce(sum(value::int) filter (user_id % 2 = 0), 0)::bigint as chunks from events")
def run_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of each user's events, added up over the users."""
    e = table(spark, sf, "events")
    per = e.groupBy("user_id").agg(F.nullif(F.count_if(F.col("event_type") == "click"), F.lit(0)).alias("new"), F.count_if(F.col("event_type") == "view").alias("changed"), F.sum(F.when(F.col("user_id") % 2 == 0, F.rint("value").cast("long"))).alias("chunks"))
    return analytics.totals(per, ["new", "changed", "chunks"])


@query("run_summary", "select event_type as source, count(*) as urls, count(*) filter (value < 20) as failed, round(count(*) filter (value < 20) / count(*)::double, 6) as failure_ratio, count(*) filter (value < 20) / count(*)::double <= 0.2 as healthy from events group by event_type")
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_type").alias("source"), F.when(F.col("value") < 20, "failed").otherwise("new").alias("outcome"))
    return presentation.source_summary(e)


@query("index_summary", "select source, lang as content_type, count(*) as chunks, count(distinct n_chars) as documents from documents group by rollup (source, lang)")
def index_summary(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("source", F.col("lang").alias("content_type"), F.col("n_chars").alias("document_id"))
    return analytics.index_stats(d)


@query("sources_by_priority", "select source, count(*) as n, case when source in ('src1', 'src2') then 3 else 1 end as priority, row_number() over (order by case when source in ('src1', 'src2') then 3 else 1 end desc, source)::int as place from documents group by source")
def by_priority(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return analytics.by_priority(d, F.when(F.col("source").isin("src1", "src2"), 3).otherwise(1))


@query("display_names", "select source, case when source = 'src1' then 'First' else upper(source[1]) || source[2:] || ' Desk' end as name from (select distinct source from documents where source is not null)")
def display_names(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("source is not null").select("source").distinct()
    key = F.when(F.col("source") == "src1", "src1").otherwise(F.concat("source", F.lit("_desk")))
    return d.select("source", fields.display_name(key, {"src1": "First"}).alias("name"))


@query("visible_works", "select doc_id, n_works::int as n_works from (select d.doc_id, count(l.doc_id) as n_works from documents d left join labels l on l.doc_id between d.doc_id and d.doc_id + 3 and l.toxic = 0 where d.doc_id % 4 = 0 group by d.doc_id)")
def visible_works(spark: SparkSession, sf: str) -> DataFrame:
    """A document and the next three as the works of a person; only labelled clean ones may be shown."""
    d = table(spark, sf, "documents").where("doc_id % 4 = 0").select("doc_id", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct((F.col("doc_id") + i).alias("document_id"))).alias("works"))
    shown = table(spark, sf, "labels").where("toxic = 0").select(F.col("doc_id").alias("document_id"))
    return people.visible(d, shown, "doc_id").select("doc_id", F.size("works").alias("n_works"))


@query("state_round_trip", "select count(*) as n, (select count(*) from (select distinct doc_id, unnest(case when len(k) = 0 then ['_'] else k end) as term from (select doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9À-ɏऀ-ॿ]+)', 1), lambda t: not list_contains([" + STOP + "], t)) as k from documents join embeddings on doc_id = vec_id))) as postings from documents join embeddings on doc_id = vec_id")
def state(spark: SparkSession, sf: str) -> DataFrame:
    """Index, chunks and vectors written, and opened again with their sizes compared."""
    d = table(spark, sf, "documents").join(table(spark, sf, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    path = f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"
    sinks.write_state(bm25.build(d, "doc_id", "text"), d.select(F.col("doc_id").alias("id"), "text"), d.select(F.col("doc_id").alias("id"), "embedding"), path)
    index, chunks, _ = readers.open_state(spark, path)
    return chunks.agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(index.postings.agg(F.count(F.lit(1)).alias("postings"))))  # one row each
