import math
import random

from pyspark.sql import functions as F

from lorewell.operators import bm25, hybrid, vector


def plain_bm25(corpus, query, k1=1.5, b=0.75, eps=0.25):
    n, avg = len(corpus), sum(map(len, corpus)) / len(corpus)
    df = {}
    for d in corpus:
        for w in set(d):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else eps * mean for w, v in idf.items()}
    return [sum(idf.get(q, 0) * d.count(q) * (k1 + 1) / (d.count(q) + k1 * (1 - b + b * len(d) / avg)) for q in query) for d in corpus]


def test_bm25_against_plain_python(spark):
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(40)]
    corpus = [[rng.choice(vocab[: rng.choice([5, 20, 40])]) for _ in range(rng.randint(1, 60))] for _ in range(120)]
    queries = [[rng.choice([*vocab, "zz"]) for _ in range(rng.randint(1, 5))] for _ in range(12)]
    d = spark.createDataFrame([(k, " ".join(c)) for k, c in enumerate(corpus)], "id int, t string")
    q = spark.createDataFrame([(k, " ".join(c)) for k, c in enumerate(queries)], "id int, t string")
    got = {(r["query_id"], r["id"]): r["score"] for r in bm25.score(bm25.build(d, "id", "t"), bm25.query_terms(q, "id", "t")).collect()}
    for k, query in enumerate(queries):
        for i, s in enumerate(plain_bm25(corpus, query)):
            assert abs(got.get((k, i), 0.0) - max(s, 0.0)) < 2e-6


def chunks(spark):
    rows = []
    for k in range(40):
        v = [math.cos(k / 9), math.sin(k / 9)]
        rows.append((k, f"d{k // 4}", "commit_kb" if k % 3 == 0 else "website", f"Long enough title {k}", f"https://x.example/content/blogs/{k}", "blog" if k % 2 else "publication", f"rivers and roads chunk {k} " * 4, v, ["Meera Rao"] if k == 33 else [], "", "2024-01-01"))
    return spark.createDataFrame(rows, "id int, document_id string, source string, title string, url string, content_type string, text string, embedding array<double>, authors array<string>, category string, date string")


def ask(spark, filters, query="rivers", **kw):
    c = chunks(spark)
    return hybrid.retrieve(c, bm25.build(c, "id", "text"), query, [1.0, 0.0], filters, **kw).collect()


def test_scope_never_leaks(spark):
    got = ask(spark, hybrid.Filters(allowed=("website",)))
    assert got and {r["source"] for r in got} == {"website"}
    assert ask(spark, hybrid.Filters(allowed=("website",), source="commit_kb")) == []


def test_two_chunks_a_document_at_most(spark):
    got = ask(spark, hybrid.Filters(allowed=None), top_k=8)
    per = {}
    for r in got:
        per[r["document_id"]] = per.get(r["document_id"], 0) + 1
    assert len(got) == 8 and max(per.values()) <= 2


def test_same_result_however_the_rows_are_dealt(spark):
    c = chunks(spark)
    a = [tuple(r) for r in hybrid.retrieve(c.repartition(7), bm25.build(c, "id", "text"), "rivers", [1.0, 0.0], hybrid.Filters(None)).collect()]
    b = [tuple(r) for r in hybrid.retrieve(c.coalesce(1), bm25.build(c, "id", "text"), "rivers", [1.0, 0.0], hybrid.Filters(None)).collect()]
    assert a == b


def test_boosts_move_results(spark):
    by_title = ask(spark, hybrid.Filters(None), "about long enough title 30 please")
    assert 30 in {r["id"] for r in by_title}
    by_person = ask(spark, hybrid.Filters(None), "rivers by Meera Rao", people=("Meera Rao",))
    assert 33 in {r["id"] for r in by_person}


def test_filters(spark):
    c = chunks(spark)
    for f, n in ((hybrid.Filters(None, year="2024"), 40), (hybrid.Filters(None, year="2023"), 0), (hybrid.Filters(None, author="rao"), 1), (hybrid.Filters(None, content_type="blog"), 20)):
        assert c.where(f.condition(c.columns)).count() == n


def test_low_value_only_when_nothing_else(spark):
    schema = "id int, document_id string, source string, low_value boolean, cosine double, fused double"
    low = spark.createDataFrame([(1, "a", "s", True, 0.9, 2.0), (2, "b", "s", True, 0.9, 1.0)], schema)
    assert [r["id"] for r in hybrid.select(low, 5).orderBy("position").collect()] == [1, 2]
    both = low.unionByName(spark.createDataFrame([(3, "c", "s", False, 0.1, 0.5)], schema))
    assert [r["id"] for r in hybrid.select(both, 5).collect()] == [3]


def test_batch_knn_equals_brute_force_with_blocks(spark):
    rng = random.Random(1)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(6)]) for k in range(80)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in vector.batch_knn(v.repartition(3), v.where("vec_id % 10 = 0"), 4, block=3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    for q, e in rows:
        if q % 10 == 0:
            want = sorted((-round(sum(a * b for a, b in zip(e, x)), 6), k) for k, x in rows if k != q)[:4]
            assert [i for _, i in sorted(got[q])] == [k for _, k in want]


def test_filters_reach_the_scan(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    plan = vector.top_k(v, [0.0] * 64, 3, where=F.col("label") == 1)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(label,1)" in plan and "TakeOrderedAndProject" in plan


def test_intents_and_questions_about_works():
    for q, types in {"latest blog posts": {"blog"}, "papers, please": {"publication", "pdf"}, "subpapers": set(), "Op-Eds on trade": {"op-ed"}, "our policies": {"playbook", "decision", "insight", "idea", "note", "kb"}, "staffing": set(), "": set()}.items():
        assert hybrid.wanted_types(q) == types
    assert hybrid.wanted_types("the harbour desk", {"note": ("harbour desk",)}) >= {"note", "kb"}
    for q in ("what has Meera written", "papers by Meera", "op-eds on trade by her", "authored by him", "Works on rivers and roads by X"):
        assert hybrid.asks_for_works(q)
    for q in ("by papers", "published by", "rivers", "has Meera spoken"):
        assert not hybrid.asks_for_works(q)


def test_intent_column_equals_the_driver_rule(spark):
    qs = ["latest blog posts", "Op-eds on trade", "papers about rivers", "are you hiring", "the certificate", "monsoon", None, "research areas; newsletters"]
    d = spark.createDataFrame([(k, q) for k, q in enumerate(qs)], "k int, q string").select("k", hybrid.intent_types("q").alias("t")).collect()
    assert all(set(r["t"]) == hybrid.wanted_types(qs[r["k"]]) for r in d)


def test_works_slot_is_an_extra_row(spark):
    c = chunks(spark).withColumn("heading_path", F.lit(""))
    own = spark.createDataFrame([(900, "p1", "website", "Meera Rao", "https://x.example/content/team/m", "person", "A list of works " * 9, [0.0, -1.0], [], "", "", "Meera Rao > Publications")], c.schema)
    got = hybrid.retrieve(c.unionByName(own), bm25.build(c, "id", "text"), "papers by Meera Rao", [1.0, 0.0], hybrid.Filters(None), people=("meera rao",)).collect()
    assert len(got) == 6 and got[-1]["id"] == 900 and got[-1]["fused"] == 0.0 and got[-1]["position"] == 6
    closed = hybrid.retrieve(c.unionByName(own), bm25.build(c, "id", "text"), "papers by Meera Rao", [1.0, 0.0], hybrid.Filters(("commit_kb",)), people=("meera rao",)).collect()
    assert all(r["source"] == "commit_kb" for r in closed)


def test_lists_are_not_empty(spark, sf):
    from lorewell.queries import retrieval

    q = retrieval.asked(spark, sf)
    lex = bm25.score(retrieval._index(spark, sf), retrieval._one(spark, q))
    assert lex.count() > 15 and lex.join(retrieval._chunks(spark, sf), "id").count() > 15


def test_index_is_kept_and_opened_again(spark, sf, tmp_path):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    first = bm25.shared(d, "doc_id", "text")
    assert bm25.shared(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text") is first
    bm25.save(first, str(tmp_path / "i"))
    terms = bm25.query_terms(spark.createDataFrame([(1, "the that and of")], "q int, t string"), "q", "t")
    again = bm25.load(spark, str(tmp_path / "i"))
    assert sorted(map(tuple, bm25.score(first, terms).collect())) == sorted(map(tuple, bm25.score(again, terms).collect()))
