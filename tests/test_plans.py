import json

from pyspark.sql import types as T

from lorewell import schema as C
from lorewell.operators import incremental, linkgraph
from lorewell.plans import ingest
from lorewell.sources import readers, sinks
from lorewell.streaming import streams

S = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType())])


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "a", "n": 1}\n\nnot json\n{"id": "b", "n": 2}\n')
    assert sorted(r["id"] for r in readers.jsonl(spark, str(p), S).collect()) == ["a", "b"]
    assert readers.jsonl_rejects(spark, str(p), S).count() == 1
    assert readers.jsonl(spark, str(tmp_path / "none"), S).count() == 0
    sinks.write_jsonl(readers.jsonl(spark, str(p), S), str(tmp_path / "out"))
    sinks.write_jsonl(readers.jsonl(spark, str(p), S), str(tmp_path / "out"), append=True)
    assert readers.jsonl(spark, str(tmp_path / "out"), S).count() == 4


def test_json_array_and_crawl_log(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 'q"[', "n": 1}, {"id": "b", "n": 2}]))
    assert readers.json_array(spark, str(tmp_path / "a.json"), S).count() == 2
    (tmp_path / "log.json").write_text(json.dumps({"https://x/": {"status": 404, "inlinks": ["https://y/"]}}))
    log = readers.crawl_log(spark, str(tmp_path / "log.json"), C.CRAWL)
    assert [tuple(r) for r in linkgraph.broken_links(log).select("source_page", "link_url").collect()] == [("https://y/", "https://x/")]


def test_sitemap(spark, tmp_path):
    (tmp_path / "b.xml").write_text("<urlset><url><loc>https://x/1</loc><lastmod>2024-01-01</lastmod></url><url><loc>https://x/2</loc></url></urlset>")
    (tmp_path / "a.xml").write_text(f"<sitemapindex><sitemap><loc>{tmp_path}/b.xml</loc></sitemap></sitemapindex>")
    assert sorted(r["loc"] for r in readers.sitemap_tree(spark, str(tmp_path / "a.xml")).collect()) == ["https://x/1", "https://x/2"]


def test_supplement_and_robots(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"id": "h1", "text": "t"}\n{"id": "", "text": "t"}\n')
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType())])
    good, bad = readers.supplementary(spark, [str(tmp_path / "s.jsonl"), str(tmp_path / "none")], schema)
    assert (good.count(), bad.count()) == (1, 1)
    docs = spark.createDataFrame([("h1", "x")], "document_id string, text string")
    assert readers.with_supplement(docs, good.withColumnRenamed("id", "document_id")).count() == 1
    pages = spark.createDataFrame([("u1", "x", "/private/a"), ("u2", "x", "/private/open/b"), ("u3", "x", "/c"), ("u4", "y", "/private")], "url string, host string, path string")
    rules = spark.createDataFrame([("x", "/private", False), ("x", "/private/open", True)], "host string, prefix string, allow boolean")
    assert {r["url"]: r["allowed"] for r in readers.robots_allowed(pages, rules).collect()} == {"u1": False, "u2": True, "u3": True, "u4": True}



def test_page_source(spark):
    spark.dataSource.register(readers.PageSource)
    df = spark.read.format("pages_by_url").option("urls", "https://x/1\nhttps://x/2\nhttps://x/3").option("partitions", "2").option("fetch", "os.path:splitext_missing").load()
    assert df.columns == ["url", "status", "final_url", "html", "error_type"] and df.rdd.getNumPartitions() == 2


def test_csv_sink_encodes_nested_values(spark, tmp_path):
    d = spark.createDataFrame([(1, ["a", "b"], "x,y")], "id int, l array<string>, s string")
    sinks.write_csv(d, str(tmp_path / "c"), ["s", "l", "id"])
    r = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first()
    assert r.asDict() == {"s": "x,y", "l": '["a","b"]', "id": "1"}


def docs(spark, n, mark=""):
    body = "Rivers rose in the north this year and roads were closed for weeks. " * 4
    rows = [(f"d{k}", "website", f"https://x.example/content/blogs/{k}", f"Title {k}", f"{k}{mark} {body}") for k in range(n)]
    return ingest.normalize_documents(spark.createDataFrame(rows, "document_id string, source string, url string, title string, text string"))


def test_refresh_promotes_and_refuses(spark, tmp_path):
    rel = sinks.Releases(spark, str(tmp_path))
    none = spark.createDataFrame([], "document_id string")
    assert ingest.refresh(rel, "v1", docs(spark, 6), none) == [] and rel.current() == "v1"
    assert ingest.refresh(rel, "v2", docs(spark, 1, "new"), spark.createDataFrame([("d5",)], "document_id string")) != []
    assert rel.current() == "v1" and "failed-v2" in rel.versions()
    assert ingest.refresh(rel, "v3", docs(spark, 2, "new"), none) == [] and rel.current() == "v3"
    assert rel.read("documents").count() == 6 and rel.read("chunks").count() == 6
    assert ingest.refresh(rel, "v4", docs(spark, 1), none) == [] and ingest.refresh(rel, "v5", docs(spark, 1), none) == []
    assert [v for v in rel.versions() if not v.startswith("failed")] == ["v3", "v4", "v5"]


def test_normalize_keeps_declared_values(spark):
    raw = spark.createDataFrame([("1", "commit_kb", "https://kb.example/decisions/a.pdf", None, "Staff; Meera Rao")], "doc_id string, source string, url string, title string, authors string")
    r = ingest.normalize_documents(raw).first()
    assert (r["document_id"], r["access"], r["title"], r["is_pdf"], r["content_type"], r["authors"]) == ("1", "internal", "Untitled", True, "pdf", ["Meera Rao"])


def test_merge_deletes_after_upserting(spark):
    base = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    delta = spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int")
    gone = spark.createDataFrame([("c",)], "k string")
    assert sorted(tuple(r) for r in incremental.merge(base, delta, gone, "k").collect()) == [("a", 1), ("b", 2)]


def test_streams_over_several_batches(spark, tmp_path):
    for rows in ([("a", "1"), ("b", "1")], [("a", "2"), ("b", "1"), ("c", "1")], [("a", "2")]):
        spark.createDataFrame(rows, "url string, h string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in.parquet"))
    s = streams.read(spark, str(tmp_path), "in", files_per_batch=1)
    t = streams.detect_changes(s, "url", "h")
    assert {r["url"] for r in t.state().collect()} == {"a", "b", "c"}
    log = [(r["url"], r["change"]) for r in t.log().collect()]
    assert log.count(("b", "new")) == 1 and log.count(("c", "new")) == 1
    again = streams.dedup(streams.read(spark, str(tmp_path), "in", files_per_batch=1), "h")
    assert sorted(r["h"] for r in again.collect()) == ["1", "2"]


def test_pdf_parents_prefer_a_title(spark):
    p = spark.createDataFrame([("p1",), ("p2",)], "pdf_url string")
    links = spark.createDataFrame([("p1", "u1", ""), ("p1", "u2", "T")], "pdf_url string, parent_url string, parent_title string")
    assert sorted(tuple(r) for r in incremental.pdf_parents(p, links).collect()) == [("p1", "u2", "T"), ("p2", None, None)]
