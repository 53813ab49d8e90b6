"""The pipeline on a small corpus: each stage's decisions, and its parts against brute force."""

import random

import corpus_pipeline
from lorewell.llm import mixing
from test_operators import SCHEMA, prose


def test_stages_keep_clean_documents_and_drop_the_rest(spark, tmp_path):
    rng, rows = random.Random(1), []
    items = [(k, prose(7000 + k, 40)) for k in range(3)]
    for k in range(60):
        rows.append((k, prose(100 + k, 120), "en", f"s{k % 3}", 1))
    rows += [(100, rows[5][1], "en", "s1", 1), (101, rows[5][1], "en", "s2", 1)]
    near = rows[9][1].split()
    near[60] = "changed"
    rows += [(102, " ".join(near), "en", "s0", 1), (103, prose(1, 30) + " " + items[1][1], "en", "s0", 1), (104, "", "en", "s0", 1), (105, None, "en", "s0", 1), (106, "12 34 --", "en", "s0", 1), (107, "的" * 80, None, "s0", 1)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        seen[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    clean = set(range(60))
    assert set(seen["language_id"]) == clean | {100, 101, 102, 103}
    assert sorted(seen["near_duplicates"]) == [*range(60), 103]
    assert sorted(seen["decontamination"]) == [*range(60)]
    kept = spark.read.parquet(str(tmp_path / "stage2"))
    want = [r["doc_id"] for r in mixing.replicate(kept).select("doc_id").collect()]
    assert sorted(seen["mixing"]) == sorted(want) == sorted(seen["sharding"])
    sizes = [r["count"] for r in docs.groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(want)


def test_pipeline_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
