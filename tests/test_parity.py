"""Queries against their SQL over small tables of odd rows."""

import random

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

import compare
from lorewell import catalog
from lorewell.functions import html, mojibake
from lorewell.operators import bm25, chunking, overlap, vector
from lorewell.streaming import streams


def tables(path, *names):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in names:
        con.sql(f"create view {t} as select * from '{path}/{t}.parquet/*.parquet'")
    return con


def check(spark, tmp_path, name, **own):
    """The query's rows, after comparing them with its SQL's."""
    for t, df in own.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
    got = catalog.QUERIES[name](spark, str(tmp_path))
    names, want = compare.sql_rows(tables(tmp_path, *own), catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == names
    assert compare.rows(got) == want
    return got


def pages(spark, *bodies, url="https://x.example/a"):
    return spark.createDataFrame([(k, url, h) for k, h in enumerate(bodies)], "page_id long, url string, html string")


TITLES = [
    "<html lang=\"en\"><title> A &amp; B&amp</title></html>", "<html lang=\"en\"><title>a &amp; b&AMP</title><p>x", "<html lang=\"en\"><title>a &amp;  b&amp</title></html>", "<title>token = &quot;7&quot</title>", "<title>token = &quot;7&quot</title>",
    "<title>no title &lt;b&gt; &copy; &amp;lt;</title>", "<h1>A heading alone</h1>", "<title>a\u00a0b\n\tc</title>", "", None, "<title></title><h1>t</h1>",
]


def test_titles_with_cut_references(spark, tmp_path):
    assert check(spark, tmp_path, "duplicate_title_groups", pages=pages(spark, *TITLES)).count() == 2


def test_page_titles_and_languages(spark, tmp_path):
    check(spark, tmp_path, "page_title", pages=pages(spark, *TITLES))


def test_same_site_needs_a_url_that_can_be_fetched(spark, tmp_path):
    got = check(spark, tmp_path, "url_predicates", pages=pages(spark, *["<p>"] * 12, url="https://www.x.example/a"))
    assert sorted(r["page_id"] for r in got.where("malformed").collect()) == [1, 7] and got.where("malformed and same_site").count() == 0


def test_body_with_cut_references(spark, tmp_path):
    cut = "<html><article><h1>Token = &quot</h1><p>One &quo &a &am two &amp three &ampfour &amp;quot; &quot;five&quot; &quotsix; <br>AT&T; R&D</p></article><footer>&copy; x</footer></html>"
    check(spark, tmp_path, "page_body_text", pages=pages(spark, cut))


def test_pages_keep_all_links_and_figures(spark, tmp_path):
    many = "<article><p>x</p>" + "".join(f'<a href="/l{k}">l</a><img src="f{k}.png">' for k in range(500)) + "</article>"
    p = pages(spark, many)
    assert check(spark, tmp_path, "page_body_text", pages=p).first()["n_links"] == 500
    assert len(html.extract_pages(p).first()["figures"]) == 500


def documents(spark, rows):
    return spark.createDataFrame([(k, *r, len(r[0] or "")) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")


def test_changes_of_documents_without_text(spark, tmp_path):
    rows = [(f"text {k}", ("fr", "en", "es", None)[k % 4], "s") for k in range(40)] + [(None, lang, "s") for lang in ("fr", "en", "es")]
    d = documents(spark, rows)
    check(spark, tmp_path, "stream_change_detect", documents=d)
    check(spark, tmp_path, "change_classification", documents=d)


def test_a_named_stream_goes_on_where_it_ended(spark, tmp_path):
    path, kind = str(tmp_path / "in"), "k string, h string"
    spark.createDataFrame([(f"k{i}", f"a{i}") for i in range(500)], kind).coalesce(1).write.parquet(path)
    t = streams.detect_changes(spark.readStream.schema(kind).parquet(path), "k", "h", "s")
    spark.createDataFrame([("k1", "Z")], kind).coalesce(1).write.mode("append").parquet(path)
    t.run(spark.readStream.schema(kind).parquet(path), "s")
    assert [tuple(r) for r in t.log().where("change = 'modified'").select("k", "change").collect()] == [("k1", "modified")]
    assert t.state().where("k = 'k1'").first()["h"] == "Z" and t.state().count() == 500


def test_token_overlap_of_every_document(spark, tmp_path):
    rows = [(" ".join(f"w{(k * j) % 23}" for j in range(1 + k % 9)) + f" W{k % 3}!", "en", f"s{k % 2}") for k in range(60)] + [(None, "en", "s1"), ("", "en", "s1"), ("w0", "en", None)]
    got = check(spark, tmp_path, "near_dup_token_overlap", documents=documents(spark, rows))
    assert got.where("query_id % 50 <> 0").count() > 0


def test_overlap_in_blocks_equals_all_pairs(spark):
    rng = random.Random(3)
    sets = {k: sorted(rng.sample(range(40), rng.randint(1, 12))) for k in range(150)}
    sets |= {k: sets[k % 7] for k in range(150, 170)}
    d = spark.createDataFrame([(k, "ab"[k % 2], t) for k, t in sets.items()], "id long, key string, t array<long>")
    want = {(q, k, len(set(a) & set(b)), len(a)) for q, a in sets.items() for k, b in sets.items() if q != k and q % 2 == k % 2 and len(set(a) & set(b)) >= 0.7 * len(a)}
    for block in (60, 100_000):
        got = [tuple(r) for r in overlap.contained(d, "id", "key", F.col("t"), 0.7, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def vectors(spark, n, dims=8):
    rng = random.Random(5)
    return spark.createDataFrame([(k, [rng.choice((-0.5, 0.0, 0.25, 0.5)) for _ in range(dims)], k % 3) for k in range(n)], "vec_id long, embedding array<float>, label int")


def test_nearest_in_small_pieces(spark, tmp_path):
    v = vectors(spark, 700)
    check(spark, tmp_path, "vector_batch_knn", embeddings=v)
    check(spark, tmp_path, "vector_pair_cosine_ge", embeddings=v)
    want = [tuple(r) for r in vector.batch_knn(v, v, 3).orderBy("query_id", "rank").collect()]
    assert want == [tuple(r) for r in vector.batch_knn(v, v, 3, block=50).orderBy("query_id", "rank").collect()]


def test_scores_of_a_piece_are_bounded():
    b = pa.RecordBatch.from_pydict({"id": pa.array(range(9000), pa.int64()), "e": pa.array([[1.0, 2.0]] * 9000)})
    got = list(vector._pieces(iter([b]), 4096))
    assert max(len(v) for v, _ in got) * 4096 <= 1 << 20 and [i for v, _ in got for i in v] == list(range(9000)) and got[-1][1].shape[1] == 2


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_citations_move_no_texts(spark, tmp_path):
    d = documents(spark, [(f"Text number {k} is here. " * 30, "en", "s1") for k in range(150)])
    c = spark.createDataFrame([(k, 1, "user", "q") for k in range(300)], "conv_id long, turn long, role string, text string")
    got = check(spark, tmp_path, "citations_full", documents=d, conversations=c)
    assert "Window [row_number" not in plan(got).split("BroadcastExchange")[0]
    assert not [x for x in plan(got).splitlines() if "Exchange hashpartitioning(answer_id" in x and "text" in x]


def test_postings_are_counted_in_place(spark, tmp_path):
    rows = [("the river, River rose!", "en", "s"), ("", "en", "s"), (None, "en", "s"), ("the of", "en", "s"), *[("water " * k + "land", "en", "s") for k in range(30)]]
    d = documents(spark, rows)
    check(spark, tmp_path, "bm25_term_idf", documents=d)
    once = bm25.build(d, "doc_id", "text")
    twice = bm25.build(d.unionByName(d), "doc_id", "text")
    assert "dl" in once.postings.columns and "dl" not in twice.postings.columns
    assert sorted((r["id"], r["term"], 2 * r["tf"]) for r in once.postings.collect()) == sorted(tuple(r) for r in twice.postings.collect())


def test_few_terms_leave_postings_in_place(spark, tmp_path):
    d = documents(spark, [(f"water land w{k % 7}", "en", "s") for k in range(60)])
    b = spark.createDataFrame([(k, f"w{k} water") for k in range(9)], "item_id long, text string")
    assert "SortMergeJoin" not in plan(check(spark, tmp_path, "bm25_batch_benchmark", documents=d, benchmark=b))


def test_hybrid_lists_rank_without_texts(spark, tmp_path):
    d = documents(spark, [(f"water land w{k % 7} " * 9, "en", f"s{k % 4}") for k in range(90)])
    b = spark.createDataFrame([(k, f"w{k} water") for k in range(9)], "item_id long, text string")
    got = check(spark, tmp_path, "hybrid_per_source_cap", documents=d, benchmark=b, embeddings=vectors(spark, 90))
    assert got.count() == 5


def test_mojibake_is_looked_for_at_leading_characters_once(spark, tmp_path):
    assert all(k[0] in mojibake.LEADS for k in mojibake.REPAIRS) and len(mojibake.LEADS) < 12
    rows = [(t, "fr", "s") for t in ("été  chaud", "l’été", "", None, "ñandú\n\n\n\n x", "ä ö ü ß")] * 3
    d = documents(spark, rows)
    got = check(spark, tmp_path, "mojibake_repair", documents=d)
    assert plan(got).count("FileScan parquet") == 1
    odd = ["â a", "pâté â", "Ã", "Ã©", "un â", "pâté", "aâs", "Â b", "x\ufffd", "ðŸ", "plain"]
    seen = [r[0] for r in spark.createDataFrame([(t,) for t in odd], "t string").coalesce(1).select(mojibake.has_mojibake("t")).collect()]
    assert seen == [bool(mojibake._broken.search(t) or mojibake._lone.search(t)) for t in odd]


def test_chunks_are_handed_on_in_bounded_pieces(spark, monkeypatch):
    d = documents(spark, [(" ".join(f"Sentence {k} {j} is here." for j in range(400)), "en", "s") for k in range(40)]).coalesce(1)
    sizes = []
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, *a, run=DataFrame.mapInArrow, **b: sizes.extend(x.num_rows for x in f(iter(self.toArrow().to_batches()))) or run(self, f, *a, **b))
    monkeypatch.setattr(chunking, "OUT_CHARS", 20_000)
    assert chunking.chunk(d, "doc_id").count() == sum(sizes) and max(sizes) < 40 and len(sizes) > 10
