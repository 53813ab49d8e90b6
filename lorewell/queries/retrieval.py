"""Keyword, vector and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewell.functions import embed, fields, text, urls
from lorewell.operators import bm25, hybrid, vector
from lorewell.plans.tables import stored
from lorewell.queries.registry import query
from lorewell.sources.readers import table

#: The question of the single-query checks: the first benchmark item, whose words the corpus has at every scale.
ASKED = "(select text from benchmark order by item_id limit 1)"
STOP = ", ".join(f"'{w}'" for w in text.BM25_STOP)
#: Tokens of an SQL text expression.
TOK = "list_filter(regexp_extract_all(lower({t}), '([a-z0-9À-ɏऀ-ॿ]+)', 1), lambda t: not list_contains([" + STOP + "], t))"
_INDEX = f"""
tok as (select doc_id as id, case when len(k) = 0 then ['_'] else k end as k from (select doc_id, {TOK.format(t="coalesce(text, '')")} as k from documents)),
dl as (select id, len(k) as dl from tok),
post as (select id, term, count(*) as tf from (select id, unnest(k) as term from tok) group by all),
st as (select count(*) as n, avg(dl) as avgdl from dl),
fr as (select term, count(*) as df from post group by term),
raw as (select term, df, ln(n - df + 0.5) - ln(df + 0.5) as raw from fr cross join st),
low as (select 0.25 * avg(raw) as f from raw),
idf as (select term, df, case when raw < 0 then f else raw end as idf from raw cross join low)"""
_SCORE = """
sc as (select query_id, post.id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score
  from qt join idf using (term) join post using (term) join dl using (id) cross join st group by query_id, post.id having round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) > 0)"""


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _index(spark: SparkSession, sf: str) -> bm25.Index:
    return bm25.shared(_docs(spark, sf), "doc_id", "text")


def _one(spark: SparkSession, q: str) -> DataFrame:
    return bm25.query_terms(spark.createDataFrame([(0, q)], "qid int, q string"), "qid", "q")


def asked(spark: SparkSession, sf: str) -> str:
    return table(spark, sf, "benchmark").orderBy("item_id").select("text").first()[0]


_QT = f"qt as (select 0 as query_id, term, count(*) as qf from (select unnest({TOK.format(t=ASKED)}) as term) group by term)"


@query("bm25_topk", f"with {_INDEX}, {_QT}, {_SCORE} select id as doc_id, score from sc order by score desc, id limit 10")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.score(_index(spark, sf), _one(spark, asked(spark, sf))).orderBy(F.desc("score"), "id").limit(10).select(F.col("id").alias("doc_id"), "score")


@query(
    "bm25_batch_benchmark",
    f"""with {_INDEX}, qt as (select query_id, term, count(*) as qf from (select item_id as query_id, unnest({TOK.format(t="text")}) as term from benchmark) group by all), {_SCORE},
r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from sc)
select query_id, id as doc_id, score, rank::int as rank from r where rank <= 5""",
)
def bm25_batch(spark: SparkSession, sf: str) -> DataFrame:
    got = bm25.score(_index(spark, sf), bm25.query_terms(table(spark, sf, "benchmark"), "item_id", "text"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return got.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("query_id", F.col("id").alias("doc_id"), "score", "rank")


@query("bm25_term_idf", f"with {_INDEX} select term, df, round(idf, 6) as idf from idf")
def bm25_idf(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).idf.withColumn("idf", F.round("idf", 6))


@query("bm25_postings_stats", f"with {_INDEX} select (select n from st) as n_docs, round((select avgdl from st), 6) as avgdl, (select count(*) from post) as n_postings, (select count(*) from idf) as n_terms")
def bm25_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Always builds the index anew: its time is the index's."""
    idx = bm25.build(_docs(spark, sf), "doc_id", "text")
    p = idx.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).agg(F.sum("df").alias("n_postings"), F.count(F.lit(1)).alias("n_terms"))
    return idx.stats.crossJoin(p).select(F.col("n").alias("n_docs"), F.round("avgdl", 6).alias("avgdl"), "n_postings", "n_terms")


_Q = "(select embedding from embeddings where vec_id = 0)"
_COS = "round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: p[1]::double * p[2]::double)), 6)"


def _vec(spark: SparkSession, sf: str) -> tuple[DataFrame, list[float]]:
    v = table(spark, sf, "embeddings")
    return v, [float(x) for x in v.where("vec_id = 0").select("embedding").first()[0]]


@query("vector_topk", f"select vec_id, {_COS} as score from embeddings e, {_Q} q order by score desc, vec_id limit 10")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    v, q = _vec(spark, sf)
    return vector.top_k(v, q, 10).select("vec_id", "score")


@query("vector_topk_filtered_label", f"select vec_id, label, {_COS} as score from embeddings e, {_Q} q where label in (1, 3) order by score desc, vec_id limit 10")
def vector_filtered(spark: SparkSession, sf: str) -> DataFrame:
    v, q = _vec(spark, sf)
    return vector.top_k(v, q, 10, where=F.col("label").isin(1, 3)).select("vec_id", "label", "score")


@query(
    "vector_batch_knn",
    f"""with s as (select q.vec_id as query_id, e.vec_id as id, {_COS} as score from embeddings q join embeddings e on q.vec_id % 50 = 0 and q.vec_id <> e.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s) select query_id, id, score, rank::int as rank from r where rank <= 5""",
)
def vector_knn(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    return vector.batch_knn(v, v.where("vec_id % 50 = 0"), 5)


@query(
    "vector_pair_cosine_ge",
    f"""select q.vec_id as query_id, e.vec_id as id, {_COS} as score from embeddings q join embeddings e on q.vec_id % 50 = 0 and q.vec_id <> e.vec_id where {_COS} >= 0.35""",
)
def vector_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Links from every fiftieth vector to all vectors within the threshold."""
    v = table(spark, sf, "embeddings")
    return vector.pairs_within(v, v.where("vec_id % 50 = 0"), 0.35)


@query(
    "hash_embed_dims",
    """with t as (select doc_id, unnest(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) as tok from documents)
select doc_id, (('0x' || substr(md5(tok), 1, 8))::bigint % 384)::int as dim, count(*) as n from t group by all""",
)
def hash_dims(spark: SparkSession, sf: str) -> DataFrame:
    t = _docs(spark, sf).select("doc_id", F.explode(embed.words("text")).alias("tok"))
    return t.groupBy("doc_id", embed.token_dim(F.col("tok"), 384).alias("dim")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "hash_embed_cosine_topk",
    """with t as (select doc_id, unnest(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) as tok from documents),
c as (select doc_id, (('0x' || substr(md5(tok), 1, 8))::bigint % 384)::int as dim, count(*)::double as n from t group by all),
l as (select doc_id, sqrt(sum(n * n)) as norm from c group by doc_id), q as (select dim, n from c where doc_id = 0)
select c.doc_id, round(sum(c.n * q.n) / (any_value(l.norm) * (select norm from l where doc_id = 0)), 6) as score from c join q using (dim) join l using (doc_id) where c.doc_id <> 0 group by c.doc_id order by score desc, doc_id limit 10""",
)
def hash_topk(spark: SparkSession, sf: str) -> DataFrame:
    c = hash_dims(spark, sf).withColumn("n", F.col("n").cast("double"))
    norm = c.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    q = c.where("doc_id = 0").select("dim", F.col("n").alias("qn")).crossJoin(F.broadcast(norm.where("doc_id = 0").select(F.col("norm").alias("qnorm"))))
    dots = c.where("doc_id <> 0").join(F.broadcast(q), "dim").groupBy("doc_id").agg(F.sum(F.col("n") * F.col("qn")).alias("d"), F.max("qnorm").alias("qnorm"))  # 384 rows at most
    return dots.join(norm, "doc_id").select("doc_id", F.round(F.col("d") / (F.col("norm") * F.col("qnorm")), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


# ------------------------------------------------------------- hybrid: documents with vectors (vec_id = doc_id)
_KIND = "case lang when 'en' then 'publication' when 'fr' then 'blog' when 'de' then 'event' else 'page' end"
_CHUNKS = f"""ch as (select d.doc_id as id, source as document_id, source, {_KIND} as content_type, text, embedding from documents d join embeddings v on d.doc_id = v.vec_id)"""
_LISTS = f"""
cos as (select e.id, e.document_id, e.source, e.content_type, e.text, {_COS} as cosine from ch e, {_Q} q),
vl as (select id, row_number() over (order by cosine desc, id) as rank from cos qualify rank <= 180),
ll as (select id, row_number() over (order by score desc, id) as rank from sc join cos using (id) qualify rank <= 15),
fu as (select id, sum(1.0::double / (60 + rank)) as rrf from (select * from vl union all select * from ll) group by id)"""
_HYBRID = f"with {_INDEX}, {_QT}, {_SCORE}, {_CHUNKS}, {_LISTS}"
_BOOSTED = f"""{_HYBRID},
cand as (select cos.*, round(rrf * (case when content_type in ('publication', 'pdf') then 1.3::double else 1.0::double end), 9) as fused, length(trim(text)) < 40 and content_type <> 'event' as low_value from fu join cos using (id)),
cap as (select *, row_number() over (partition by low_value, document_id order by fused desc, id) as d from cand),
good as (select coalesce(bool_or(not low_value), false) as g from cand),
fin as (select *, row_number() over (order by fused desc, id) as position from cap where d <= 2 and low_value <> (select g from good) qualify position <= 5)"""


def _chunks(spark: SparkSession, sf: str, among: DataFrame | None = None) -> DataFrame:
    """Documents with vectors; among: the few ids that are wanted, so that other texts do not move."""
    kind = F.when(F.col("lang") == "en", "publication").when(F.col("lang") == "fr", "blog").when(F.col("lang") == "de", "event").otherwise("page")
    d = _docs(spark, sf).withColumn("content_type", kind)
    v = table(spark, sf, "embeddings")
    if among is not None:
        few = F.broadcast(among.select(F.col("id").alias("__id")))  # as deep as the lists at most
        d, v = d.join(few, F.col("doc_id") == F.col("__id"), "left_semi"), v.join(few, F.col("vec_id") == F.col("__id"), "left_semi")
    j = d.join(v, F.col("doc_id") == F.col("vec_id"))
    return j.select(F.col("doc_id").alias("id"), F.col("source").alias("document_id"), "source", "content_type", "text", "embedding", F.lit("").alias("title"), F.lit("https://x.example/a").alias("url"), F.lit("").alias("category"), F.lit("").alias("date"), F.array().cast("array<string>").alias("authors"))


def _lists(spark: SparkSession, sf: str) -> tuple[DataFrame, list[float]]:
    """The fused lists, ranked by ids and scores alone, and the query's vector."""
    _, q = _vec(spark, sf)
    cos = vector.score(_chunks(spark, sf), q).select("id", F.col("score").alias("cosine"))
    lex = bm25.score(_index(spark, sf), _one(spark, asked(spark, sf))).select("id", F.col("score").alias("lex"))
    lists = [hybrid.ranked(cos, 180, "cosine"), hybrid.ranked(cos.join(lex, "id"), 15, "lex")]
    return hybrid.fuse(lists), q


@query("hybrid_rrf", f"{_HYBRID} select id, round(rrf, 9) as rrf from fu")
def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return _lists(spark, sf)[0].select("id", F.round("rrf", 9).alias("rrf"))


MEANT = " reports"  # means the types publication and pdf; it is no token of the corpus


@query("hybrid_per_source_cap", f"{_BOOSTED} select id, source, fused, cosine, position::int as position from fin")
def hybrid_cap(spark: SparkSession, sf: str) -> DataFrame:
    fused, q = _lists(spark, sf)
    fused = stored(fused)  # as deep as the lists at most
    cos = vector.score(_chunks(spark, sf, fused), q).withColumnRenamed("score", "cosine")
    low = urls.is_low_value("url", "title", "text", "content_type")
    ask = asked(spark, sf) + MEANT
    cand = cos.join(F.broadcast(fused), "id").withColumn("low_value", low).withColumn("fused", F.round(F.col("rrf") * hybrid.boost(ask, (), hybrid.wanted_types(ask)), 9)).drop("embedding", "rrf")
    return hybrid.select(cand, 5).select("id", "source", "fused", "cosine", "position")


#: retrieve(): the main lists, and those of the meant types.
_RETRIEVED = _BOOSTED.replace("fu as (", """vt as (select id, row_number() over (order by cosine desc, id) as rank from cos where content_type in ('publication', 'pdf') qualify rank <= 120),
lt as (select id, row_number() over (order by score desc, id) as rank from sc join cos using (id) where content_type in ('publication', 'pdf') qualify rank <= 10),
fu as (""").replace("select * from ll)", "select * from ll union all select * from vt union all select * from lt)")


@query("hybrid_rrf_boosted", f"""{_RETRIEVED} select id, source, content_type, cosine, fused, position::int as position,
case when cosine >= 0.62 then 'high' when cosine >= 0.48 then 'medium' when cosine >= 0.35 then 'low' else 'none' end as confidence from fin""")
def hybrid_boosted(spark: SparkSession, sf: str) -> DataFrame:
    """The whole of retrieve(): scope, three kinds of lists, boosts, cap, diversity."""
    _, q = _vec(spark, sf)
    out = hybrid.retrieve(_chunks(spark, sf), _index(spark, sf), asked(spark, sf) + MEANT, q, hybrid.Filters(allowed=None))
    return out.select("id", "source", "content_type", "cosine", "fused", "position", fields.confidence("cosine").alias("confidence"))


@query(
    "hybrid_confidence_tier",
    f"""{_BOOSTED} select round(max(cosine), 6) as best, case when max(cosine) >= 0.62 then 'high' when max(cosine) >= 0.48 then 'medium' when max(cosine) >= 0.35 then 'low' else 'none' end as confidence, coalesce(max(cosine), 0) >= 0.35 as sufficient from fin""",
)
def hybrid_tier(spark: SparkSession, sf: str) -> DataFrame:
    best = F.max("cosine")
    return hybrid_cap(spark, sf).agg(F.round(best, 6).alias("best"), fields.confidence(best).alias("confidence"), (F.coalesce(best, F.lit(0.0)) >= 0.35).alias("sufficient"))


_POOL = "c as (select doc_id as id, doc_id // 2 as document_id, case when doc_id % 40 = 7 then 's2' else 's1' end as source, doc_id % 11 = 5 as low_value, (n_chars % 100) / 100.0::double as cosine, case when doc_id % 40 = 7 then 0.001 * doc_id else 1.0 + n_chars % 997 end::double as fused from documents)"


@query(
    "hybrid_diversity_slot",
    f"""with {_POOL}, p as (select * from (select *, row_number() over (partition by low_value, document_id order by fused desc, id) as d from c) where d <= 2 and not low_value),
f as (select id, source, cosine, row_number() over (order by fused desc, id) as position from p qualify position <= 6),
o as (select id, source, cosine, 6 as position from c where not low_value and source <> (select min(source) from f) order by fused desc, id limit 1)
select id, source, position::int as position from f where position < 6 or not (select count(distinct source) = 1 from f) or (select cosine from o) < 0.35
union all select id, source, position from o where cosine >= 0.35 and (select count(distinct source) = 1 from f)""",
)
def hybrid_diversity(spark: SparkSession, sf: str) -> DataFrame:
    """Nearly all candidates are of one source; the best of the other may take the last place."""
    k = F.col("doc_id") % 40 == 7
    c = _docs(spark, sf).select(
        F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 2).alias("document_id"), F.when(k, "s2").otherwise("s1").alias("source"), (F.col("doc_id") % 11 == 5).alias("low_value"), (F.col("n_chars") % 100 / 100).alias("cosine"),
        F.when(k, 0.001 * F.col("doc_id")).otherwise(1.0 + F.col("n_chars") % 997).cast("double").alias("fused"),
    )
    return hybrid.select(c, 6).select("id", "source", "position")


@query("scope_filter_retrieval", f"with {_CHUNKS} select e.id, e.source, {_COS} as score from ch e, {_Q} q where source in ('src1', 'src2', 'src3') and source = 'src2' order by score desc, id limit 10")
def scope_filter(spark: SparkSession, sf: str) -> DataFrame:
    _, q = _vec(spark, sf)
    c = _chunks(spark, sf)
    ok = hybrid.Filters(allowed=("src1", "src2", "src3"), source="src2").condition(c.columns)
    return vector.top_k(c, q, 10, "id", ok).select("id", "source", "score")


@query("category_substring_filter", f"with {_CHUNKS} select id, content_type from ch where contains(lower(content_type), 'bl') and content_type in ('blog', 'publication')")
def category_filter(spark: SparkSession, sf: str) -> DataFrame:
    c = _chunks(spark, sf).withColumn("category", F.col("content_type"))
    return c.where(hybrid.Filters(allowed=None, category="BL", content_type="blog, publication").condition(c.columns)).select("id", "content_type")


#: Questions and the types they mean, one of them put before each benchmark text.
_QUESTIONS = [
    ("latest blog posts:", ["blog"]), ("Op-eds on", ["op-ed"]), ("papers about", ["pdf", "publication"]), ("are you hiring", ["career"]), ("the certificate", ["course"]), ("subpapers and teamwork", []),
    ("our policies on", ["decision", "idea", "insight", "kb", "note", "playbook"]), ("focus areas, bulletins", ["newsletter", "programme", "research_area", "tracker"]), ("who works here", ["people_index", "person"]),
]


@query("query_intent_types", "select item_id, unnest(case item_id % 9 " + " ".join(f"when {k} then {t}::varchar[]" for k, (_, t) in enumerate(_QUESTIONS)) + " end) as intent from benchmark")
def intents(spark: SparkSession, sf: str) -> DataFrame:
    lead = F.element_at(F.array(*[F.lit(q) for q, _ in _QUESTIONS]), (F.col("item_id") % len(_QUESTIONS) + 1).cast("int"))
    return table(spark, sf, "benchmark").select("item_id", F.explode(hybrid.intent_types(F.concat_ws(" ", lead, "text"))).alias("intent"))


@query(
    "name_mention_theta_join",
    """with n(key) as (values ('meera rao'), ('arun rao'), ('li wei'), ('jose maria silva')), q(id, t) as (values (1, 'what has Meera Rao written?'), (2, 'reports by silva, please'), (3, 'rao on trade'), (4, 'wei'), (5, 'Jose Maria Silva and Li Wei'))
select q.id as query_id, n.key from q join n on contains(' ' || regexp_replace(lower(t), '[^a-z ]', ' ', 'g') || ' ', ' ' || n.key || ' ')
union select q.id, 'jose maria silva' from q where contains(' ' || regexp_replace(lower(t), '[^a-z ]', ' ', 'g') || ' ', ' silva ')""",
)
def mentions(spark: SparkSession, sf: str) -> DataFrame:
    from lorewell.operators import people

    p = spark.createDataFrame([("meera rao",), ("arun rao",), ("li wei",), ("jose maria silva",)], "key string")
    q = spark.createDataFrame([(1, "what has Meera Rao written?"), (2, "reports by silva, please"), (3, "rao on trade"), (4, "wei"), (5, "Jose Maria Silva and Li Wei")], "id int, t string")
    return people.mentions(q, p, "id", "t")


_LEAD = "array_to_string(list_slice(string_split(trim(regexp_replace(regexp_replace(lower({t}), '[ \\t\\r\\n]+', ' ', 'g'), '[^a-z0-9 ]', '', 'g')), ' '), {a}, {z}), ' ')"


@query(
    "title_containment_boost",
    f"""with q as (select item_id, {_LEAD.format(t="text", a=1, z=1000)} as q from benchmark), t as (select item_id as title_of, {_LEAD.format(t="text", a=3, z=5)} as title from benchmark)
select item_id, title_of from q join t on length(title) >= 12 and contains(q, title)""",
)
def title_boost(spark: SparkSession, sf: str) -> DataFrame:
    """Titles (words 3 to 5 of each item) contained in queries (all items)."""
    b = table(spark, sf, "benchmark")
    words = F.split(text.norm_title("text"), " ")
    titles = b.select(F.col("item_id").alias("title_of"), F.array_join(F.slice(words, 3, 3), " ").alias("title"))
    return hybrid.contained_titles(b.select("item_id", text.norm_title("text").alias("q")), titles)
