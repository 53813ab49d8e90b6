"""Operators on small tables: brute force, edge rows, empty tables, clashing columns."""

import itertools
import math
import random
import re
import time
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import compare
from lorewell.llm import bitslice, catalog, components, cotraining, decontaminate, gbt, langid, learning, licenses, linedup, mixing, quality_rules, sharding, simhash, toxicity
from lorewell.llm.base import held_out

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(n))


def edge_rows():
    long = prose(1, 30_000)
    return [
        (1, None, None, None, None), (2, "", "en", "s1", 0), (3, " \n\t ", "en", "s1", 4), (4, "one", "en", "s1", 3), (5, "one two", "de", None, 7), (6, prose(2, 80), "en", "s2", 1),
        (7, prose(2, 80), "en", "s3", 1), (7, prose(2, 80), "en", "s3", 1), (None, "no id here", "fr", "s1", 10), (8, long, "fr", "s1", len(long)), (9, long, "fr", "s4", len(long)), (10, "é" * 50 + " ß\x00x", "de", "s5", 54), (11, "!!! ### $$$", "en", "s1", 11),
    ]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, None if k == 3 else k % 2) for k in range(1, 9)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, prose(9, 40)), (2, "tiny item"), (3, None), (4, "")], "item_id long, text string")


def ops(docs, labels, benchmark):
    return {
        1: lambda d: toxicity.op1_toxicity(d, labels), 2: sharding.op2_hilbert_shards, 3: simhash.op3_simhash, 4: licenses.op4_license_scan, 5: lambda d: quality_rules.op5_quality_rules(d, labels),
        6: mixing.op6_poisson_mix, 7: lambda d: decontaminate.op7_decontamination(d, benchmark), 8: lambda d: cotraining.op8_cotraining(d, labels), 9: linedup.op9_line_spread, 10: langid.op10_langid,
    }


@pytest.mark.parametrize("n", range(1, 11))
def test_edge_rows_and_extra_columns(spark, edges, labels, benchmark, n):
    op = ops(edges, labels, benchmark)[n]
    wide = edges.withColumn("score", F.lit("clash")).withColumn("shard", F.lit(1)).withColumn("kept", F.lit("x")).withColumn("fp", F.lit(0)).withColumn("extra", F.array(F.lit(1)))
    got = op(wide).collect()
    if n not in (6, 7):
        assert len(got) == len(edge_rows())
    assert sorted(map(str, got)) == sorted(map(str, op(edges.repartition(5)).collect()))


@pytest.mark.parametrize("n", range(1, 11))
def test_empty_tables(spark, edges, labels, benchmark, n):
    assert ops(edges, labels.limit(0), benchmark)[n](edges.limit(0)).count() == 0
    if n in (1, 5, 8):
        assert ops(edges, labels.limit(0), benchmark)[n](edges).count() == len(edge_rows())
    if n == 7:
        assert ops(edges, labels, benchmark.limit(0))[n](edges).count() == 0


def test_sql_operators_equal_duckdb(spark, sf):
    con = compare.duck(sf)
    for name, sql in catalog.ORACLE_SQL.items():
        df = catalog.QUERIES[name](spark, sf)
        names, want = compare.sql_rows(con, sql)
        assert sorted(df.columns) == names and compare.rows(df) == want


# ---------------------------------------------------------------- 3
def brute_groups(keys, link):
    boss = list(range(len(keys)))

    def find(x):
        while boss[x] != x:
            x = boss[x]
        return x

    for i, j in itertools.combinations(range(len(keys)), 2):
        if link(keys[i], keys[j]):
            a, b = sorted((find(i), find(j)))
            boss[b] = a
    return [find(i) for i in range(len(keys))]


def far(a, b):
    return bin(int(a) ^ int(b)).count("1")


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 7])
def test_bitslices_against_all_pairs(radius):
    rng = np.random.default_rng(radius)
    fps = []
    for b in rng.integers(0, 2**63, 30, dtype=np.uint64):
        for _ in range(int(rng.integers(1, 14))):
            x = int(b)
            for _ in range(int(rng.integers(0, radius + 3))):
                x ^= 1 << int(rng.integers(0, 64))
            fps.append(x)
    fps = np.array(fps, np.uint64)
    for runs in (1, 3, 40):
        run = np.sort(rng.integers(0, runs, len(fps)))
        pairs = list(zip(fps, run, strict=True))
        assert bitslice.connect(fps[:, None], run, radius).tolist() == brute_groups(pairs, lambda p, q: p[1] == q[1] and far(p[0], q[0]) <= radius)


def fingerprint(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize(("hot", "tile"), [(simhash.HOT, simhash.TILE), (2, simhash.TILE), (1, 1)])
def test_simhash_against_brute_force(spark, hot, tile):
    rng, rows = random.Random(4), []
    for k in range(40):
        base = prose(k, 60).split()
        for _ in range(rng.randint(1, 5)):
            w = list(base)
            if rng.random() < 0.7:
                w[rng.randrange(60)] = "Edited"
            rows.append((len(rows) * 3 % 400, " ".join(w)))
    rows += [(900, None), (901, " "), (902, "A b"), (903, "a B")]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), hot, tile).collect()}
    ids = sorted(i for i, _ in rows)
    fp = {i: fingerprint(t) for i, t in rows}
    want = [ids[k] for k in brute_groups([fp[i] for i in ids], lambda a, b: far(a, b) <= 2)]
    assert all(got[i]["fp"] % 2**64 == fp[i] for i in ids)
    assert [got[i]["component_id"] for i in ids] == want
    assert len(set(want)) < len({fp[i] for i in ids})


def test_refined_blocks_lose_no_link():
    """Every pair within two bits shares a key on each level."""
    keys = {0: [], 1: [], 2: []}
    rng = random.Random(2)

    def cut(fp, lo, hi):
        return fp >> lo & (1 << hi - lo) - 1

    for i, j in itertools.combinations(range(4), 2):
        rest = [b for k, b in enumerate(simhash.BANDS) if k not in (i, j)]
        pieces = [[(rest[0][0], rest[0][0] + 11)], [(rest[0][0] + 11, rest[0][1]), (rest[1][0], rest[1][0] + 5)], [(rest[1][0] + 5, rest[1][1])]]
        base = [simhash.BANDS[i], simhash.BANDS[j]]
        keys[0].append(base)
        for k, p in enumerate(pieces):
            keys[1].append(base + p)
            left = [x for m, y in enumerate(pieces) if m != k for x in y]
            if len(left) == 2:
                a, z = left[1]
                left = [left[0], (a, (a + z) // 2), ((a + z) // 2, z)]
            keys[2] += [base + p + [x] for x in left]
    assert [len(keys[k]) for k in range(3)] == [6, 18, 54]
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        for level in keys.values():
            assert any(all(cut(a, *p) == cut(b, *p) for p in key) for key in level)


def test_similar_documents_at_08(spark):
    rng, rows = random.Random(8), []
    for k in range(30):
        base = prose(100 + k, 300).split()
        rows.append((10 * k, " ".join(base)))
        near = list(base)
        for p in rng.sample(range(300), 3):
            near[p] = f"changed{p}"
        rows.append((10 * k + 1, " ".join(near)))  # similarity about 0.9
        rows.append((10 * k + 2, " ".join(base[:150] + prose(500 + k, 150).split())))  # about a third
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[10 * k + 1] == 10 * k for k in range(30)) >= 29
    assert all(got[10 * k + 2] == 10 * k + 2 for k in range(30))
    again = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), hot=1).collect()}
    assert sum(again[i] == got[i] for i in got) >= len(got) - 2


def test_links_are_exactly_the_pairs_of_jaccard_08(spark):
    def shingles(t):
        w = t.split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    rng, rows, want = random.Random(3), [], {}
    for k in range(60):  # pairs of similarity 0.72 to 0.88
        base = prose(6000 + k, 300).split()
        near = list(base)
        for p in rng.sample(range(300), 4 + k % 9):
            near[p] = f"changed{p}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        want[2 * k], want[2 * k + 1] = 2 * k, 2 * k if len(a & b) >= 0.8 * len(a | b) else 2 * k + 1
    assert 10 < sum(want[2 * k + 1] == 2 * k for k in range(60)) < 50
    line = "\n" + prose(1, 10)
    for k in range(2):  # only one repeated line in common
        rows.append((200 + k, prose(7000 + k, 750) + line * 25))
        want[200 + k] = 200 + k
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for held in (simhash.HELD, 200):
        assert {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(d, held=held).collect()} == want


def test_exact_links_of_a_block_against_all_pairs():
    rng = np.random.default_rng(4)
    sets = [np.unique(np.r_[rng.integers(0, 40, 36), 100 * (k % 3) + np.arange(60)]).astype(np.uint64) for k in range(60)]
    fps = simhash.wide_fingerprint_rows(sets)[0]
    same = brute_groups(range(60), lambda a, b: len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])))
    assert simhash.link_exactly(fps, sets, 256).tolist() == list(same)


def test_tiles_compare_all_members_of_a_block(spark):
    members = spark.range(200).selectExpr("id as node", "if(id < 190, 7L, 8L) as key", "if(id < 190, 190, 10) as n")
    tiles = members.select("node", "n", F.explode(simhash._tiles(32)).alias("tile"))
    met = tiles.alias("a").join(tiles.alias("b"), "tile").where("a.node < b.node").select("a.node", "b.node").distinct().count()
    assert met == 190 * 189 // 2 + 10 * 9 // 2
    assert tiles.groupBy("tile").count().agg(F.max("count")).first()[0] < 2 * 2 * 32


def test_hot_blocks_of_one_minimum_compare_every_pair(spark):
    nodes = spark.createDataFrame([(k, bytes(32), [7, *range(10 * k + 100, 10 * k + 105)]) for k in range(12)], "node long, fp binary, anchors array<long>")
    b = simhash._blocks(nodes, simhash._anchor_keys(), 4, 4).select("node", "key")
    met = b.alias("x").join(b.alias("y"), "key").where("x.node < y.node").select("x.node", "y.node").distinct().count()
    assert met == 12 * 11 // 2


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(k, k + 1) for k in range(100, 130)]
    want = {}
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    for n, r in zip(nodes, brute_groups(nodes, lambda a, b: False), strict=True):
        want[n] = n
        del r
    for _ in nodes:
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


# ---------------------------------------------------------------- 2
def test_hilbert_curve_is_one_walk_through_all_cells():
    for dims, bits in ((2, 4), (3, 3)):
        cells = sorted(itertools.product(range(1 << bits), repeat=dims), key=lambda c: sharding.hilbert(c, bits))
        assert sorted(sharding.hilbert(c, bits) for c in cells) == list(range(1 << bits * dims))
        assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in itertools.pairwise(cells))


def test_shards_are_even_and_gapless(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    got = sharding.op2_hilbert_shards(d).collect()
    text = {r["doc_id"]: r["text"] for r in d.collect()}
    by = {}
    for r in got:
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        by.setdefault(r["shard"], []).append((r["slot"], r["curve"]))
    assert set(by) == set(range(16)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    order = [c for k in range(16) for _, c in sorted(by[k])]
    assert order == sorted(order)
    assert all([s for s, _ in sorted(v)] == list(range(len(v))) for v in by.values())


def test_positions_against_a_plain_sort(spark):
    """Cells by plain quantisation and curve; rows of a cell in the order of its runs; ids null and rows repeated."""
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(40)]), "x" * rng.randint(0, 60), rng.choice([None, "de", "en", "fr"]), rng.choice([None, "s1", "s2", "s3"]), 1) for _ in range(400)]
    d = spark.createDataFrame(rows, SCHEMA)
    got = sharding.shard_documents(d, shards=7).collect()
    assert sorted(map(str, [tuple(r)[:5] for r in got])) == sorted(map(str, rows))
    cut = {"lang": ["de", "en", "fr"], "source": ["s1", "s2", "s3"]}
    sizes = sorted(len(t) + 1 for _, t, *_ in rows)
    assert len(set(sizes)) > 15
    size_cuts = sorted({sizes[len(sizes) * k // 16] for k in range(1, 16)})
    for r in got:
        at = [sum(r[c] is not None and r[c] >= v for v in cut[c]) * 16 // 4 for c in ("lang", "source")]
        at = (*at, sum(len(r["text"]) + 1 >= v for v in size_cuts) * 16 // (len(size_cuts) + 1))
        assert r["curve"] == sharding.hilbert(at, 4)
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in order] == sorted(r["curve"] for r in got)
    counts = [sum(r["shard"] == k for r in got) for k in range(7)]
    assert max(counts) - min(counts) <= 1


def test_shards_prune_every_dimension(spark, sf):
    """Min/max boxes of the shards: a filter on either dimension skips most of them, unlike shards by hash."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    boxes = sharding.shard_documents(d).groupBy("shard").agg(*[f(c).alias(f"{n}_{c}") for c in ("source", "lang") for n, f in (("lo", F.min), ("hi", F.max))]).collect()
    for c in ("source", "lang"):
        values = [r[0] for r in d.select(c).distinct().collect()]
        read = sum(b[f"lo_{c}"] <= v <= b[f"hi_{c}"] for v in values for b in boxes) / (len(values) * len(boxes))
        assert read < {"source": 0.5, "lang": 0.7}[c]


# ---------------------------------------------------------------- 5
def counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup, at = set(), 0, {}
    for x in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    for k in range(len(w) - 2):
        at.setdefault(tuple(w[k : k + 3]), []).append(k)
    cover = {p + k for v in at.values() if len(v) > 1 for p in v for k in range(3)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)]


def test_statistics_against_plain_python(spark, sf):
    texts = [r[1] for r in edge_rows()] + ["a b c a b c\na b c\n a b c\n\n a b c", "x\x0by\x0cz\r\nx|<é>"] + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got, _ = quality_rules.statistics(pa.array(texts))
    assert got.tolist() == [counts(t) for t in texts]


def test_forest_is_monotone():
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, (600, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + rng.normal(0, 0.2, 600) > 0.6).astype(float)
    f = gbt.fit_forest(x, y, np.ones(600), np.array([1, 0, -1]))
    assert ((f.score(x) > 0.5) == y).mean() > 0.85
    for k, sign in ((0, 1), (2, -1)):
        z = np.repeat(x[:50], 21, axis=0)
        z[:, k] = np.tile(np.linspace(0, 1, 21), 50)
        assert (np.diff(f.score(z).reshape(50, 21), axis=1) * sign >= -1e-12).all()


# ---------------------------------------------------------------- 1, 8, 10: held-out accuracy
def test_language_on_held_out_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = langid.op10_langid(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert r[0] >= 0.97 and 0 <= r[1] <= r[2] <= 1


def normal(t):
    """Letters and marks in lower case, everything else one blank, none at the start."""
    out = ""
    for c in t:
        c = (c.lower() if len(c.lower()) == 1 else c) if unicodedata.category(c)[0] in "LM" else " "
        out += "" if c == " " and out[-1:] in ("", " ") else c
    return out.encode()


def plain_phrases(ref, t):
    """Greedy longest phrases of the whole text; a byte that does not occur is one."""
    n = i = 0
    while i < len(t):
        j = i + 1
        while j <= len(t) and t[i:j] in ref:
            j += 1
        i, n = max(i + 1, j - 1), n + 1
    return n


@pytest.mark.parametrize("segment", [7, 64, langid.SEGMENT])
def test_cross_parsing_is_the_greedy_parse_of_the_whole_text(monkeypatch, segment):
    monkeypatch.setattr(langid, "SEGMENT", segment)
    rng = random.Random(segment)
    ref = normal("".join(rng.choice("abcd é的") for _ in range(500)))
    model = langid.LanguageModel(["x"], [ref])
    texts = ["".join(rng.choice("abcd é的xZ1 ") for _ in range(rng.choice([0, 1, 6, 7, 8, 64, 300, 2500]))) for _ in range(60)]
    texts += [ref.decode() * 4, "x" * 200, "İΣ \u0915\u093e 1 2  ab", None]
    got, size, letters = langid.phrase_counts(model, *langid.buffers(pa.array(texts)))
    own = [normal(t or "") for t in texts]
    assert got[:, 0].tolist() == [plain_phrases(ref, t) for t in own]
    assert size.tolist() == list(map(len, own))
    assert letters.tolist() == [sum(unicodedata.category(c)[0] == "L" for c in t or "") for t in texts]


def test_many_scripts_and_many_languages(spark):
    """Languages of one script each, some only in long texts, and more names than are learned."""
    rng, scripts = random.Random(5), {"zh": (0x4E00, 900), "el": (0x3B1, 24), "hi": (0x915, 37), "th": (0xE01, 46), "ru": (0x430, 32), "en": (0x61, 26)}

    def text(name, n):
        lo, wide = scripts[name]
        return " ".join("".join(chr(lo + rng.randrange(wide)) for _ in range(rng.randint(2, 7))) for _ in range(n))

    rows = [(k, text(name, 9000 if name == "el" else 60), name, "s", 1) for k, name in enumerate(sorted(scripts) * 12)]
    rows += [(1000 + k, text("en", 5), f"typo{k}", "s", 1) for k in range(20)]
    r = langid.op10_langid(spark.createDataFrame(rows, SCHEMA))
    got = {x["doc_id"]: x["lang_pred"] for x in r.collect()}
    assert all(got[i] == name for i, _, name, _, _ in rows if i < 1000 and name != "en")
    few = langid.fit(spark.createDataFrame(rows, SCHEMA), max_languages=6)
    assert few.names == sorted(scripts)


def test_toxic_words_are_learned_and_clean_texts_left_alone(spark):
    rng, rows, lab = random.Random(3), [], []
    for k in range(900):
        w = ["the"] * 3 + prose(1000 + k, 40).split()
        if k % 3 == 0:
            w[rng.randrange(len(w))] = rng.choice(["vile", "viler", "vilest"])
        rows.append((k, " ".join(w), "en", "s", 1))
        lab.append((k, 1, int(k % 3 == 0)))
    d, l = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(lab, "doc_id long, quality int, toxic int")
    r = toxicity.op1_toxicity(d, l).join(l, "doc_id").where("held_out").collect()
    assert sum(x["predicted"] == x["toxic"] for x in r) / len(r) > 0.95
    other = toxicity.op1_toxicity(d.withColumn("lang", F.lit("fr")).withColumn("source", F.lit("z")), l).collect()
    assert {x["doc_id"]: x["score"] for x in r}.items() <= {x["doc_id"]: x["score"] for x in other}.items()


def test_convolution_and_pooling_against_plain_loops(monkeypatch):
    rng = np.random.default_rng(2)
    emb = rng.normal(0, 1, (toxicity.V + 1, toxicity.DIM))
    emb[toxicity.PAD] = 0
    filt = [rng.normal(0, 1, (w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS]
    bias = rng.normal(0, 1, toxicity.FILTERS * len(toxicity.WIDTHS)).astype(np.float32)
    model = toxicity.ToxicModel(toxicity._project(emb, filt), bias, rng.normal(0, 1, len(bias)), 0.5)
    sizes = [0, 1, 2, 5, 40, 3]
    at = np.r_[0, np.cumsum(sizes)]
    bucket = rng.integers(0, toxicity.V, (at[-1], 2)).astype(np.int32)
    want = []
    for a, z in itertools.pairwise(at):
        e = np.concatenate([emb[bucket[a:z, 0]] + emb[bucket[a:z, 1]], np.zeros((2, toxicity.DIM))])
        own = max(1, z - a)
        top = []
        for w, f in zip(toxicity.WIDTHS, filt, strict=True):
            e2 = np.concatenate([e, np.zeros((w, toxicity.DIM))])
            top += [max(sum(e2[p + k] @ f[k, :, c] for k in range(w)) for p in range(own)) for c in range(toxicity.FILTERS)]
        want.append(top + bias)
    assert np.allclose(toxicity.pooled(model, bucket, at), want, atol=1e-3)
    monkeypatch.setattr(toxicity, "BLOCK", 8)  # long texts in blocks, short ones together
    assert np.allclose(toxicity.pooled(model, bucket, at)[4], want[4], atol=1e-3)


def test_gradient_against_finite_differences(monkeypatch):
    monkeypatch.setattr(toxicity, "V", 50)
    monkeypatch.setattr(toxicity, "PAD", 50)
    rng = np.random.default_rng(4)
    nf = toxicity.FILTERS * len(toxicity.WIDTHS)
    params = [rng.normal(0, 1, (51, toxicity.DIM)), *[rng.normal(0, 1, (w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS], rng.normal(0, 1, nf), rng.normal(0, 1, nf), np.zeros(1)]
    params[0][50] = 0
    size = np.array([7, 9, 3])
    start = np.cumsum(size) - size
    idx = rng.integers(0, 50, (size.sum() + 2, 2))
    for s, n in zip(start, size, strict=True):
        idx[s + n - 3 : s + n] = 50
    idx[-2:] = 50
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    monkeypatch.setattr(toxicity, "_project", lambda emb, filt: np.concatenate([emb @ f[k] for f in filt for k in range(len(f))], axis=1))  # in doubles
    _, grads = toxicity.gradients(params, idx, start, size, y, weight)
    for p, g in zip(params, grads, strict=True):
        for _ in range(12):
            at = tuple(rng.integers(0, n) for n in p.shape)
            if p is params[0] and at[0] == 50:
                continue
            old, eps, loss = p[at], 1e-6, []
            for d in (eps, -eps):
                p[at] = old + d
                loss.append(toxicity.gradients(params, idx, start, size, y, weight)[0])
            p[at] = old
            assert abs((loss[0] - loss[1]) / (2 * eps) - g[at]) < 1e-5


def test_toxicity_on_few_labelled_rows(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    r = toxicity.op1_toxicity(d, l).join(l, "doc_id").where("held_out").groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("predicted").alias("hit")).collect()
    got = {x["toxic"]: (x["hit"], x["n"]) for x in r}
    assert got[1][0] / got[1][1] > 0.6 and got[0][0] / got[0][1] < 0.1


def test_toxicity_cuts_come_from_all_rows_at_every_size(spark, monkeypatch):
    seen, rounds = {}, []
    train, cuts = toxicity.train, toxicity.cuts_of
    monkeypatch.setattr(toxicity, "train", lambda bucket, at, y, epochs: rounds.append(len(y)) or train(bucket, at, y, epochs, steps=1))
    monkeypatch.setattr(toxicity, "cuts_of", lambda score, group, y: seen.update({len(score): len(y)}) or cuts(score, group, y))
    for n in (60, 3000):  # about a quarter is held out
        rows = [(k, "the vile one" if k % 2 else "the kind one", "en", "s", 1) for k in range(n)]
        d, l = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(k, 1, k % 2) for k in range(n)], "doc_id long, quality int, toxic int")
        learned = n - d.where(held_out()).count()
        rounds.clear()
        toxicity.fit(d, l, epochs=0)
        assert learned in seen and rounds == [learned - len(range(k, learned, 5)) for k in range(5)] + [learned]


def test_cotraining_on_held_out_rows(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    m = cotraining.fit(d, l)
    assert sum(a for a, _ in m.taught) > 0
    r = cotraining.score_quality(d, m, ["doc_id"]).withColumnRenamed("quality", "q").join(l, "doc_id").where(held_out())
    r = r.agg(F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("int"))), F.avg(F.when(F.col("quality") == 0, F.col("kept").cast("int")))).first()
    assert r[0] > 0.95 and r[1] < 0.3


def test_rounds_take_the_surest_of_all_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(7)
    table = cotraining.materialise(cotraining.facts(d, ["doc_id"]))
    rows = table.collect()
    a, b = cotraining._rows(rows)
    rng = np.random.default_rng(0)
    m = cotraining.CoTrained(rng.normal(0, 1, a.shape[1] + 1), rng.normal(0, 1, b.shape[1] + 1), a.mean(0), a.std(0) + 1e-3)
    known = {0: np.array([rows[3]["same"]]), 1: np.array([rows[5]["same"]])}
    got = {}
    for r in cotraining._taught(table, m, 9, known):
        got.setdefault((r["teacher"], r["label"]), set()).add(r["same"])
    for v, z in enumerate(m.logits(a, b)):
        for label in (0, 1):
            sure = {}
            for r, x in zip(rows, z if label else -z, strict=True):
                if x >= cotraining.logit(cotraining.SURE) and r["same"] not in known[v]:
                    sure[r["same"]] = x
            want = sorted(sure, key=lambda k: (-sure[k], k))[:9]
            assert got.get((v, label), set()) == set(want)


def test_views_share_no_length(spark):
    """View A of a text does not tell how often it is repeated line by line, nor view B what it says."""
    t = prose(1, 400)
    a = cotraining.text_view(cotraining.text_facts(pa.array([t, "other " * 9, None])))
    assert a.shape == (3, cotraining.WORD_SLOTS + cotraining.PAIR_SLOTS + 8) and not a[2].any()
    w = [x.lower() for x in t.split()]
    h = {x: int(cotraining.words(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x.encode())]), cotraining.PUNCT)[0][0]) for x in set(w)}
    plain = np.zeros(cotraining.WORD_SLOTS)
    for x in w:
        plain[h[x] % cotraining.WORD_SLOTS] += 1
    assert np.allclose(a[0, : cotraining.WORD_SLOTS], np.sqrt(plain / len(w)), atol=1 / 255)


def test_quality_verdict_against_plain_python(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    rules = quality_rules.fit(d, l)
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(d, rules).collect()}

    def tree(root, x):
        k = root
        while rules.forest.left[k] != k:
            k = rules.forest.left[k] if x[rules.forest.feature[k]] <= rules.forest.cut[k] else rules.forest.right[k]
        return rules.forest.value[k]

    for r in d.collect():
        n, _, _, _, repeats = counts(r["text"])
        failed = n < 50 or 100 * repeats > 50 * n
        x = quality_rules.statistics(pa.array([r["text"]], pa.string()))[1][0]
        p = 1 / (1 + np.exp(-(rules.forest.base + sum(tree(k, x) for k in rules.forest.roots))))
        assert got[r["doc_id"]]["base_failed"] == failed and abs(got[r["doc_id"]]["quality_score"] - p) < 1e-9
        assert got[r["doc_id"]]["kept"] == (not failed and got[r["doc_id"]]["quality_score"] >= rules.cut)


def test_quality_rules_learn_from_all_labelled_rows(spark, monkeypatch):
    """More rows of a class than any sample held, an id with two texts, a very long text: forest and cut of plain numpy over all of them."""
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice(WORDS) + rng.choice(["", "", "!", "7"]) for _ in range(rng.randint(1, 90))), "en", "s", 1) for k in range(6500)]
    rows += [(0, "another text of the same id", "en", "s", 1), (0, "another text of the same id", "en", "s", 1), (1, None, "en", "s", 1), (6500, "long " * 210_000, "en", "s", 1)]
    lab = [(k, 0 if k % 9 == 0 or rng.random() < 0.02 else 1, 0) for k in range(6501)]
    d, l = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(lab, "doc_id long, quality int, toxic int")
    monkeypatch.setattr(quality_rules, "boost", lambda *a: gbt.boost(*a, trees=4), raising=False)
    rules = quality_rules.fit(d.repartition(5), l)

    ids = {r["doc_id"]: r["test"] for r in l.where(~held_out()).select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 4).alias("test")).collect()}
    own = sorted({(r[0], r[1] or "") for r in rows if r[0] in ids})
    x = quality_rules.statistics(pa.array([t for _, t in own]))[1]
    y, test = np.array([lab[k][1] for k, _ in own], float), np.array([ids[k] for k, _ in own])
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y)
    plain = gbt.fit_forest(x[~test], y[~test], weight[~test], quality_rules.MONOTONE, trees=4)
    assert (y == 1).sum() > 4200 and np.array_equal(rules.forest.feature, plain.feature) and np.array_equal(rules.forest.left, plain.left)
    assert np.allclose(rules.forest.cut, plain.cut, rtol=1e-12) and np.allclose(rules.forest.value, plain.value, rtol=1e-9, atol=1e-12)
    good = np.sort(plain.score(x[test & (y == 1)]))
    assert abs(rules.cut - min(0.2, good[int(len(good) * 0.002)])) < 1e-9


def test_quality_rules_learn_from_very_long_texts(spark, monkeypatch):
    """All bad texts have more than a million characters."""
    monkeypatch.setattr(quality_rules, "boost", lambda *a: gbt.boost(*a, trees=4), raising=False)
    d = spark.range(100).select(F.col("id").alias("doc_id"), F.expr("if(id % 2 = 0, repeat('bad! word ', 100001), 'a good text of seven words here')").alias("text"))
    rules = quality_rules.fit(d, spark.range(100).selectExpr("id as doc_id", "cast(id % 2 as int) as quality"))
    bad, good = rules.forest.score(quality_rules.statistics(pa.array(["bad! word " * 100_001, "a good text of seven words here"]))[1])
    assert bad < 0.5 < good


def test_order_statistics_against_sorting(spark):
    rng = np.random.default_rng(4)
    x = np.stack([rng.normal(0, 1, 700).round(2), 10.0 ** rng.integers(-300, 300, 700) * rng.choice([-1, 1], 700), np.where(rng.random(700) < 0.9, 0.0, -0.0)], axis=1)
    df = spark.createDataFrame([(r.tobytes(),) for r in x], "x binary").repartition(3)
    ranks, q = np.array([0, 1, 350, 698, 699]), np.linspace(0, 1, 13)
    assert np.array_equal(learning.order_statistics(df, quality_rules._x, 3, ranks), np.sort(x, axis=0)[ranks].T)
    assert np.allclose(learning.quantiles(df, quality_rules._x, 3, 700, q), np.quantile(x, q, axis=0).T, rtol=1e-12)


# ---------------------------------------------------------------- 4, 6, 7, 9
def test_licenses(spark):
    t = [
        (1, "text\nReleased under the MIT License.\nmore"), (2, "Licensed under the Apache License, Version 2.0."), (3, "under the license of the sea"), (4, "x " * 40 + "this work is licensed under CC BY-NC 4.0 " + "y " * 40),
        (5, "Copyright me\n" + licenses.TEXTS["MIT"].replace("Software", "Program", 2) + "\nend"), (6, "This work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License."),
    ]
    r = {x["doc_id"]: x for x in licenses.op4_license_scan(spark.createDataFrame(t, "doc_id long, text string")).collect()}
    assert [r[k]["license"] for k in range(1, 7)] == ["MIT", "Apache-2.0", None, "CC-BY-NC-4.0", "MIT", "GPL-3.0"]
    assert r[1]["dice"] == 1.0 and 0.8 <= r[5]["dice"] < 1 and r[6]["n_matches"] == 2 and r[3]["n_matches"] == 0


def test_every_template_finds_itself():
    t = licenses.Templates(0.8)
    known = licenses.known_templates()
    name, dice, many = licenses.scan(t, pa.array(["intro words here " + x + " and the end" for _, x in known]))
    assert name == [n for n, _ in known] and np.allclose(dice, 1) and set(many.tolist()) == {1}
    assert {n for n, x in known if len(x) > 150} == set(licenses.NAMES) | {"0BSD", "BSL-1.0"}


def test_licence_scan_against_every_run_of_words():
    rng = random.Random(3)
    small = [("A", "a b c d e f"), ("B", "a b c x y"), ("C", "d e f g a b c d e f g h")]
    for threshold in (0.6, 0.8):
        t = licenses.Templates(threshold, small)
        for _ in range(150):
            w = " ".join(rng.choice("abcdefghxy") if rng.random() < 0.5 else rng.choice(small)[1] for _ in range(rng.randint(0, 12))).split()
            found = []
            for k, (_, x) in enumerate(small):
                b = Counter(itertools.pairwise(x.split()))
                for i in range(len(w) - 1):
                    best = (0, 0)
                    for j in range(i + 1, len(w)):
                        d = 2 * sum((Counter(itertools.pairwise(w[i : j + 1])) & b).values()) / (j - i + sum(b.values()))
                        best = max(best, (d, -j))
                    if best[0] >= threshold - 1e-12:
                        found.append((best[0], k, i, -best[1]))
            d, k, n = licenses.apart(found)
            name, dice, many = licenses.scan(t, pa.array([" ".join(w)]))
            assert (name[0], many[0]) == (None if k < 0 else small[k][0], n) and abs(dice[0] - d) < 1e-12


def test_long_licence_lists_are_scanned_in_linear_time():
    rng = random.Random(1)
    text = "\n".join(f"{rng.choice(licenses.PHRASES)} {rng.choice(list(licenses.NAMES.values()))}." for _ in range(4000))
    began = time.perf_counter()
    assert licenses.scan(licenses.Templates(0.8), pa.array([text]))[2][0] == 4000
    assert time.perf_counter() - began < 10


def test_poisson_counts_follow_the_rates(spark):
    rows = [(k, "x" * 100, "en", "a" if k % 4 else "b", 100) for k in range(4000)]
    d = spark.createDataFrame(rows, SCHEMA)
    out = mixing.replicate(d, weights={"a": 1.0, "b": 3.0}).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("rate").alias("rate")).collect()
    got = {r["source"]: r for r in out}
    assert abs(got["b"]["rate"] - 3.0) < 1e-9 and abs(got["a"]["rate"] - 1 / 3) < 1e-9
    assert abs(got["b"]["n"] - 3000) < 250 and abs(got["a"]["n"] - 1000) < 150
    more = mixing.replicate(d, weights={"a": 1.0, "b": 3.0}, budget=1.5).groupBy("doc_id").count()
    fewer = mixing.replicate(d, weights={"a": 1.0, "b": 3.0}).groupBy("doc_id").agg(F.count(F.lit(1)).alias("m"))
    assert fewer.join(more, "doc_id", "left").where("count is null or count < m").count() == 0


def test_salted_rates_give_the_same_copies(spark, monkeypatch):
    d = spark.createDataFrame([(k, "x" * (k % 50), "en", f"s{k % 3}", 1) for k in range(300)], SCHEMA)
    a = sorted(map(tuple, mixing.replicate(d).select("doc_id", "copy_no").collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert a == sorted(map(tuple, mixing.replicate(d).select("doc_id", "copy_no").collect()))


def test_poisson_quantiles_against_plain_sums():
    for rate in (1e-9, 0.01, 1.0, 7.5, 300.0):
        first, cdf = mixing.quantiles(rate)
        for u in (0.001, 0.3, 0.5, 0.99, 0.999999, 1 - 2.0**-48):
            k, p = 0, math.exp(-rate)
            total = p
            while total <= u and k < 2000:
                k += 1
                p *= rate / k
                total += p
            assert first + int((cdf <= u).sum()) == k or abs(total - u) < 1e-13
    began = time.perf_counter()
    first, cdf = mixing.quantiles(1e6)
    assert len(cdf) < 25_000 and abs(first + (cdf <= 0.5).sum() - 1e6) < 2 and time.perf_counter() - began < 2


def test_high_rates_and_clashing_columns(spark):
    own = [(k, "z" * 500, "big", 2.5, "q", 1, 2, "id", "row") for k in range(200)] + [(900, "ab", "small", 1.5, "k", 3, 4, "x", "y")]
    d = spark.createDataFrame(own, "doc_id long, text string, source string, rate double, cdf string, copy_no int, n_copies int, id string, row string")
    got = mixing.mix_sources(d, alpha=0.0)
    assert got.columns == d.columns
    n = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(n["small"] - 25_000) < 1000 and got.distinct().count() == len({x[0] for x in own if x[2] == "small"}) + got.where("source = 'big'").distinct().count()
    assert set(map(tuple, got.distinct().collect())) <= set(own)
    copies = mixing.replicate(d, alpha=0.0).where("source = 'small'")
    assert copies.agg(F.max("copy_no"), F.count_distinct("copy_no"), F.max("n_copies")).first()[:] == (n["small"],) * 3


def test_shuffle_is_a_global_order(spark):
    d = spark.createDataFrame([(k, "x", "en", "s", 1) for k in range(200)], SCHEMA)
    keys = [r["shuffle_key"] for r in mixing.shuffled(mixing.replicate(d)).collect()]
    assert keys == sorted(keys)


def plain_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_against_the_plain_table():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = rng.integers(0, 6, rng.integers(1, 20)).astype(np.uint64), rng.integers(0, 6, rng.integers(1, 30)).astype(np.uint64)
        s, lo, hi = decontaminate.align(a, b)
        assert s == plain_align(a.tolist(), b.tolist())
        assert s == 0 or plain_align(a.tolist(), b[lo:hi].tolist()) == s
    for _ in range(20):  # passages much longer than the item
        a, b = rng.integers(0, 30, 12).astype(np.uint64), rng.integers(0, 30, 400).astype(np.uint64)
        s, lo, hi = decontaminate.align(a, b)
        assert s == plain_align(a.tolist(), b.tolist()) == plain_align(a.tolist(), b[lo:hi].tolist())
        assert 0 < hi - lo <= 36


def test_decontamination_finds_copies_and_edits(spark):
    items = [(k, prose(2000 + k, 40)) for k in range(8)]
    rng, docs, want = random.Random(5), [], set()
    for k in range(120):
        w = prose(3000 + k, 200).split()
        if k % 3 == 0:
            item = items[k % 8][1].split()
            if k % 2:
                for p in rng.sample(range(40), 6):
                    item[p] = "edited"
            at = rng.randrange(len(w))
            w[at:at] = [x.upper() + "," for x in item]
            want.add((k, k % 8))
        docs.append((k, " ".join(w)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (20_000, 3):
        got = decontaminate.contaminated(d, b, block=block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want
    words = {k: t.split() for k, t in docs}
    for r in got:
        span = [x.strip(",").lower() for x in words[r["doc_id"]][r["first_word"] : r["last_word"] + 1]]
        assert len(set(span) & set(items[r["item_id"]][1].split())) >= 25


def test_stock_phrases_are_no_seeds_but_popular_copies_stay(spark):
    stock = "all of the usual terms apply"
    items = [(1, stock + " " + prose(1, 30)), (2, prose(2, 30))]
    docs = [(k, prose(50 + k, 30) + " " + stock) for k in range(200)] + [(1000 + k, prose(900 + k, 20) + " " + items[1][1]) for k in range(300)] + [(5000, prose(7, 20) + " " + items[0][1])]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(5000, 1)} | {(1000 + k, 2) for k in range(300)}


def test_frequent_edited_copies_are_found_beside_a_rare_exact_one(spark):
    """Seeds in far more documents than the item's other seeds are no reason to report a copy clean."""
    item = prose(4, 40).split()
    docs = [(k, prose(4000 + k, 20) + " " + " ".join(item[:27])) for k in range(300)] + [(9000, prose(8, 20) + " " + " ".join(item))]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == {*range(300), 9000}


def test_words_in_common_bound_the_alignment():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.integers(0, 9, rng.integers(1, 20)), rng.integers(0, 9, rng.integers(1, 30))
        seeds = decontaminate.Seeds([(1, " ".join(f"w{x}" for x in a))], 4)
        raw = np.frombuffer(" ".join(f"w{x}" for x in b).encode(), np.uint8)
        passage = decontaminate.words(raw, np.array([0, len(raw)]), decontaminate.PUNCT)[0]
        s = decontaminate.align(seeds.words[1], passage)[0]
        assert s <= 2 * seeds.in_common(1, passage)
        assert decontaminate.Aligner(seeds, 0.5).score(1, passage)[0] == (s / (2 * len(a)) if 2 * seeds.in_common(1, passage) >= len(a) else 0)


def split_words(t):
    return re.findall("[a-z0-9]+", t.lower())


def test_decontamination_against_every_document_and_item(spark):
    """Plain Smith-Waterman of every document and item; copies with random edits, cuts and stock phrases."""
    rng, rows = random.Random(11), []
    items = [(k, prose(2500 + k, rng.choice([12, 25, 40]))) for k in range(6)] + [(6, "of the usual terms that apply " + prose(2600, 20)), (7, "one two")]
    for k in range(90):
        w = prose(3500 + k, rng.randint(5, 60)).split() + "of the usual terms that apply".split() * (k % 3 == 0)
        if k % 2:
            copy = items[rng.randrange(8)][1].split()[rng.randint(0, 3) :]
            w[5:5] = [x if rng.random() > rng.choice([0, 0.1, 0.25]) else f"new{k}" for x in copy]
        rows.append((k, " ".join(w)))
    rows.append((None, items[0][1]))
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): round(r["score"], 9) for r in decontaminate.contaminated(d, b).collect()}
    for i, t in rows[:-1]:
        for j, x in items:
            a, z = split_words(x), split_words(t)
            score = round(plain_align(a, z) / (2 * len(a)), 9)
            seeds = {tuple(a[k : k + 4]) for k in range(len(a) - 3)} or {tuple(a)}
            n = min(4, len(a))
            seeded = any(tuple(z[k : k + n]) in seeds for k in range(len(z)))
            assert got.get((i, j)) == (score if score >= 0.5 and seeded else None), (i, j)
    kept = decontaminate.drop_contaminated(d, b).collect()
    assert {r["doc_id"] for r in kept} == {i for i, _ in rows[:-1]} - {i for i, _ in got}


def test_seed_recall_by_edit_rate():
    """Share of edited copies of score 0.5 or more that keep a seed: nearly all but of short items."""
    rng, seen = random.Random(1), {}
    for size in (12, 40):
        for rate in (0.1, 0.2):
            hit = n = 0
            for _ in range(400):
                keep = [rng.random() > rate for _ in range(size)]
                if plain_align(list(range(size)), [k if x else -1 - k for k, x in enumerate(keep)]) >= size:
                    n += 1
                    hit += any(all(keep[k : k + 4]) for k in range(size - 3))
            seen[size, rate] = hit / n
    assert seen[12, 0.1] > 0.97 and seen[40, 0.2] > 0.99 and seen[12, 0.2] > 0.85


def test_line_spread_near_the_threshold(spark):
    rows = []
    for n in range(1, 12):
        rows += [(100 * n + k, f"own {n} {k}\n line on {n} sites \n\nline on {n} sites", "en", f"site{k}", 1) for k in range(n)]
    rows += [(5000 + k, "often but on one site", "en", "site0", 1) for k in range(50)]
    r = {x["doc_id"]: x for x in linedup.remove_boilerplate(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, t, *_ in rows:
        n = i // 100
        gone = 2 if 5 <= n < 12 else 0
        assert r[i]["n_removed"] == gone and (r[i]["clean_text"] == t) == (gone == 0)


def test_all_ways_of_line_removal_agree(spark, edges):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*edges.columns).unionByName(edges)
    d = d.unionByName(spark.createDataFrame([(None, f"shared\nmine {k}", "en", f"s{k}", 1) for k in range(6)], SCHEMA)).withColumn("id", F.lit("own")).withColumn("kept", F.lit(1)).withColumn("gone", F.lit(2))
    want = sorted(map(str, linedup.remove_boilerplate(d).collect()))
    assert linedup.remove_boilerplate(d).where("doc_id is null and clean_text like 'mine %'").count() == 6
    for way in ({"in_place": 0}, {"in_place": 0, "small": 0}, {"small": 0}):
        assert sorted(map(str, linedup.remove_boilerplate(d, **way).collect())) == want


def test_native_plan_of_operator_9(spark, sf):
    plan = catalog.QUERIES["op9_line_spread"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
