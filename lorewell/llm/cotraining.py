r"""Operator 8, a quality classifier by co-training two views.

View A is text content: the shares of hashed words and word pairs, and the shares of operator 5's
statistics (none of them the length).  View B is page metadata: source and language (hashed one-hot)
and the length class.  Each view has its own logistic classifier.  Over `rounds` rounds each classifier
labels the documents that it is most sure of (SURE at least, at most `step` of each class a round, different
texts or metadata) and hands them to the *other* view's training set.  A fifth of the labelled sample, seen by neither,
calibrates both views (Platt) and fits the combination of the calibrated logits, which scores all documents.

Texts are read once: facts() writes some 230 bytes a document, from which the rounds and the scores
are made.  The labelled sample is bounded (`per_class` x 2 documents by least hash of doc_id, of at most `max_row_chars`
characters by n_chars); each round scores *all* documents, every task keeps its `step` surest of each kind, and
their first `step` over all tasks, a distributed top-k, travel to the driver.

Results: null and empty texts have no words and zero shares; null metadata is a value of its own; very long
texts are read whole; equal documents count once in a round and get equal scores; ties of certainty go by a hash; without
labels of both classes every score is 0.5 and all are kept.  `kept`: the score reaches the cut that keeps
`keep` of the good documents of the calibration fifth.  Columns named like a result are replaced; an empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewell.llm.base import PUNCT, add_columns, buffers, grams, materialise, row_blocks, ship, words
from lorewell.llm.learning import keep_threshold, labelled_sample, logistic, logit, sigmoid
from lorewell.llm.quality_rules import FEATURES, statistics

SURE = 0.95
WORD_SLOTS, PAIR_SLOTS = 128, 64
SHARES = [k for k, name in enumerate(FEATURES) if name != "log_words"]
SOURCES, LANGS, SIZES = 64, 16, 20
META = ("source", "lang", "n_chars")


def _slots(h: np.ndarray, row: np.ndarray, n: int, slots: int) -> np.ndarray:
    """Square roots of the shares of `slots` hash slots in each row, in steps of 1/255."""
    at = row * slots + (h % np.uint64(slots)).astype(np.int64)
    count = np.bincount(at, minlength=n * slots).reshape(n, slots)
    return np.rint(255 * np.sqrt(count / np.maximum(1, count.sum(1, keepdims=True)))).astype(np.uint8)


def text_facts(text: pa.Array) -> pa.Array:
    """View A of each text, packed: slots as bytes, then statistics as floats."""
    data, off = buffers(text)
    shares = statistics(text)[1][:, SHARES].astype(np.float32)
    out: list[bytes] = []
    for lo, hi in row_blocks(off):
        h, row, _, _ = words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], PUNCT)
        pair = grams(h, 2)
        real = row[: len(pair)] == row[1 : len(pair) + 1]
        slots = np.concatenate([_slots(h, row, hi - lo, WORD_SLOTS), _slots(pair[real], row[: len(pair)][real], hi - lo, PAIR_SLOTS)], axis=1)
        out += [s.tobytes() + x.tobytes() for s, x in zip(slots, shares[lo:hi], strict=True)]
    return pa.array(out, pa.binary())


def text_view(facts: pa.Array) -> np.ndarray:
    n, wide = len(facts), WORD_SLOTS + PAIR_SLOTS + 4 * len(SHARES)
    raw = np.frombuffer(b"".join(facts.to_pylist()), np.uint8).reshape(n, wide) if n else np.zeros((0, wide), np.uint8)
    cut = WORD_SLOTS + PAIR_SLOTS
    return np.concatenate([raw[:, :cut] / 255, np.ascontiguousarray(raw[:, cut:]).view(np.float32).astype(float)], axis=1)


def metadata_view(source: pa.Array, lang: pa.Array, n_chars: pa.Array) -> np.ndarray:
    n = len(source)
    x = np.zeros((n, SOURCES + LANGS + SIZES))
    for k, (col, first, size) in enumerate(((source, 0, SOURCES), (lang, SOURCES, LANGS))):
        d = col.cast(pa.string()).dictionary_encode()
        slot = np.array([zlib.crc32(f"{k}:{v}".encode()) % size for v in d.dictionary.to_pylist()] + [zlib.crc32(f"{k}:".encode()) % size])
        x[np.arange(n), first + slot[d.indices.fill_null(len(slot) - 1).to_numpy(zero_copy_only=False).astype(int)]] = 1
    size = n_chars.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)
    x[np.arange(n), SOURCES + LANGS + np.clip(np.log2(np.maximum(1, size)), 0, SIZES - 2).astype(int)] = 1
    x[:, -1] = np.log1p(np.maximum(0, size)) / 10
    return x


def facts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """docs[keep] with view A packed in `content`, the metadata, and `same`, a hash of both."""
    names = [c for c in keep if c not in ("content", "same", *META)]
    made = add_columns(docs, lambda b: [text_facts(b.column(b.schema.get_field_index("text")))], [("content", T.BinaryType())], [*names, *META])
    return made.withColumn("same", F.xxhash64("content", *META))


def _views(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    def col(n: str) -> pa.Array:
        return b.column(b.schema.get_field_index(n))

    return text_view(col("content")), metadata_view(*[col(n) for n in META])


@dataclass
class CoTrained:
    text: np.ndarray | None = None
    meta: np.ndarray | None = None
    center: np.ndarray | None = None
    spread: np.ndarray | None = None
    platt: list[np.ndarray] = field(default_factory=list)
    join: np.ndarray | None = None
    cut: float = 0.0
    taught: list[tuple[int, int]] = field(default_factory=list)  # pseudo-labels given by each view, by round

    def logits(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        za = np.c_[(a - self.center) / self.spread, np.ones(len(a))] @ self.text
        zb = np.c_[b, np.ones(len(b))] @ self.meta
        return np.clip(za, -30, 30), np.clip(zb, -30, 30)

    def score(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined, text-view and metadata-view probabilities."""
        if self.text is None:
            half = np.full(len(a), 0.5)
            return half, half, half
        z = [w[0] * v + w[1] for w, v in zip(self.platt, self.logits(a, b), strict=True)]
        return sigmoid(z[0] * self.join[0] + z[1] * self.join[1] + self.join[2]), sigmoid(z[0]), sigmoid(z[1])


def surest(z: np.ndarray, same: np.ndarray, step: int, known: np.ndarray) -> np.ndarray:
    """Rows of the `step` greatest z of SURE or more, one of each `same`, none of `known`; ties by `same`."""
    rows = np.flatnonzero((z >= logit(SURE)) & ~np.isin(same, known))
    rows = rows[np.lexsort((same[rows], -z[rows]))]
    first = np.sort(np.unique(same[rows], return_index=True)[1])
    return rows[first[:step]]


def _taught(table: DataFrame, m: CoTrained, step: int, known: dict[int, np.ndarray]) -> list:
    """Rows (teacher, label, z, same, content, metadata) that each view is surest of: 4 x step at most.

    known[v]: what view v has taught already, or carries a label.
    """
    ship(table.sparkSession)
    names = ["content", *META]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, pa.Table]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            same = b.column(b.schema.get_field_index("same")).to_numpy()
            rows = pa.Table.from_batches([b.select(names)])
            for v, z in enumerate(m.logits(*_views(b))):
                for label, sure in ((1, z), (0, -z)):
                    k = surest(sure, same, step, known[v])
                    if len(k):
                        s, i, t = sure[k], same[k], rows.take(pa.array(k))
                        if (v, label) in held:
                            s0, i0, t0 = held[v, label]
                            s, i, t = np.r_[s0, s], np.r_[i0, i], pa.concat_tables([t0, t])
                        best = surest(s, i, step, known[v])
                        held[v, label] = s[best], i[best], t.take(pa.array(best))
        for (v, label), (s, i, t) in held.items():
            n = len(s)
            head = [pa.array(np.full(n, v, np.int32)), pa.array(np.full(n, label, np.int32)), pa.array(s), pa.array(i)]
            yield pa.RecordBatch.from_arrays([*head, *[t.column(c).combine_chunks() for c in names]], names=["teacher", "label", "z", "same", *names])

    kinds = {f.name: f.dataType.simpleString() for f in table.schema.fields}
    got = table.select("same", *names).mapInArrow(run, "teacher int, label int, z double, same long, " + ", ".join(f"{c} {kinds[c]}" for c in names))
    w = Window.partitionBy("teacher", "label")
    one = got.groupBy("teacher", "label", "same").agg(F.max("z").alias("z"), *[F.first(c).alias(c) for c in names])  # equal within one `same`
    return one.withColumn("rank", F.row_number().over(w.orderBy(F.desc("z"), "same"))).where(F.col("rank") <= step).collect()


def _rows(rows: list) -> tuple[np.ndarray, np.ndarray]:
    return text_view(pa.array([bytes(r["content"]) for r in rows], pa.binary())), metadata_view(*[pa.array([r[c] for r in rows]) for c in META])


def cotrain(table: DataFrame, labels: DataFrame, per_class: int = 3000, max_row_chars: int = 1_000_000, rounds: int = 4, step: int = 200, keep: float = 0.995) -> CoTrained:
    """table: a stored facts() with doc_id."""
    short = table.where(F.coalesce(F.col("n_chars"), F.lit(0)) <= max_row_chars).withColumn("text", F.lit(""))
    rows = labelled_sample(short, labels, "quality", per_class, extra=("content", "same", *META))
    y = np.array([r["y"] for r in rows], float)
    if len(rows) < 20 or y.min() == y.max():
        return CoTrained()
    a, b = _rows(rows)
    m = CoTrained(center=a.mean(0), spread=a.std(0) + 1e-3)
    test = np.arange(len(y)) % 5 == 4
    held = np.array([r["same"] for r in rows], np.int64)
    own = [[(a[~test] - m.center) / m.spread], [b[~test]]]  # what each view learns from
    labelled = [[y[~test]], [y[~test]]]
    known = {0: held, 1: held}

    def learn(v: int) -> np.ndarray:
        x, t = np.concatenate(own[v]), np.concatenate(labelled[v])
        w = np.where(t == 1, 0.5 / max(1, (t == 1).sum()), 0.5 / max(1, (t == 0).sum())) * len(t)
        return logistic(x, t, w, 1e-2)

    for _ in range(rounds):
        m.text, m.meta = learn(0), learn(1)
        got = sorted(_taught(table, m, step, known), key=lambda r: (r["teacher"], r["label"], -r["z"], r["same"]))
        given = [0, 0]
        for v in (0, 1):
            mine = [r for r in got if r["teacher"] == v]
            given[v] = len(mine)
            if mine:
                xa, xb = _rows(mine)
                own[1 - v].append(xb if v == 0 else (xa - m.center) / m.spread)
                labelled[1 - v].append(np.array([r["label"] for r in mine], float))
                known[v] = np.r_[known[v], [r["same"] for r in mine]]
        m.taught.append((given[0], given[1]))
        if not any(given):
            break
    m.text, m.meta = learn(0), learn(1)
    z = m.logits(a[test], b[test])
    yt = y[test]
    m.platt = [logistic(v[:, None], yt, None, 1e-3) for v in z]
    both = np.stack([w[0] * v + w[1] for w, v in zip(m.platt, z, strict=True)], axis=1)
    m.join = logistic(both, yt, None, 1e-3)
    m.cut = min(0.5, keep_threshold(sigmoid(np.c_[both, np.ones(len(both))] @ m.join), yt, keep))
    return m


def score_facts(table: DataFrame, model: CoTrained, keep: list[str]) -> DataFrame:
    """table[keep] (a facts() table) with quality (combined), text_score, meta_score and kept."""

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        q, t, m = model.score(*_views(b))
        return [pa.array(q), pa.array(t), pa.array(m), pa.array(q >= model.cut)]

    new = [("quality", T.DoubleType()), ("text_score", T.DoubleType()), ("meta_score", T.DoubleType()), ("kept", T.BooleanType())]
    return add_columns(table, make, new, keep)


def score_quality(docs: DataFrame, model: CoTrained, keep: list[str]) -> DataFrame:
    """docs[keep] with quality (combined), text_score, meta_score and kept; no shuffle, nothing stored."""
    return score_facts(facts(docs, keep), model, keep)


def fit(docs: DataFrame, labels: DataFrame, **how: object) -> CoTrained:
    return cotrain(materialise(facts(docs, ["doc_id"])), labels, **how)  # type: ignore[arg-type]


def op8_cotraining(docs: DataFrame, labels: DataFrame) -> DataFrame:
    table = materialise(facts(docs.select("doc_id", "text", *META), ["doc_id"]))
    return score_facts(table, cotrain(table, labels), ["doc_id"])
