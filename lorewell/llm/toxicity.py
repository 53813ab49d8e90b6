r"""Operator 1, toxicity by a convolutional text classifier.

Words (ASCII punctuation stripped, lower case) are hashed to embeddings, each the sum of one for the
word and one for its stem (first STEM bytes), so that inflected forms share what is learned; filters of widths 1, 2 and 3
slide over them; the maximum of each filter over the whole text feeds a logistic output.  Trained in
numpy by Adam on a bounded labelled sample (`per_class` documents of each class, see
learning.labelled_sample); the gradient runs through the maxima only.

Thresholds are calibrated by language on rows that the fit does not see (see fit()): for each
language group the cut with the best F1, falling back to the cut over all groups where a group has
fewer than `MIN_POSITIVE` positives.  The reported score is shifted on the logit scale so that each
group's cut lands on CUT = 0.3.  The group comes from the text's own function words (WORDS), never
from the lang column; labels, lang, source and doc_id are no inputs of a score.

Scoring multiplies embeddings and filters once, so a word costs one table lookup; no shuffle.  Whole
texts are scored in blocks of bounded memory, overlapping by the filter width.

Results: null or empty text -> the score of a text without words; no labelled rows, or one class
only -> the class share as the score of all.  Repeated rows get equal scores, ties of scores are
predicted alike; very long texts are scored whole; an empty table gives no rows; a column named like a result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewell.llm.base import PUNCT, add_columns, buffers, held_out, lowered, mix, row_blocks, row_bounds, span_hashes, words
from lorewell.llm.learning import labelled_sample, logit, sigmoid

STEM = 5  # bytes of a word that make up its stem
BITS, DIM, FILTERS, WIDTHS = 15, 8, 8, (1, 2, 3)
V = 1 << BITS
PAD = V
CUT = 0.3
MIN_POSITIVE = 15
BLOCK = 1 << 17

# Frequent function words of four languages.
WORDS = {
    "en": "the of and to in is that it for was on are as with be at this",
    "de": "der die und den das von zu mit sich des auf für ist im dem nicht ein eine",
    "fr": "de la le et les des en un du une que est pour qui dans par plus sur",
    "es": "de la que el en y los del se las por un para con no una su al",
}


@dataclass
class ToxicModel:
    table: np.ndarray = field(default_factory=lambda: np.zeros((V + 1, FILTERS * sum(WIDTHS)), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(FILTERS * len(WIDTHS), np.float32))
    out: np.ndarray = field(default_factory=lambda: np.zeros(FILTERS * len(WIDTHS)))
    base: float = 0.0
    cuts: dict[str, float] = field(default_factory=dict)


def _group_table() -> tuple[np.ndarray, list[str]]:
    names = sorted(WORDS)
    lut = np.zeros((1 << 18, len(names)), np.float32)
    for k, name in enumerate(names):
        raw = np.frombuffer(WORDS[name].encode(), np.uint8)
        h = words(raw, np.array([0, len(raw)]), PUNCT)[0]
        lut[(h >> np.uint64(46)).astype(np.int64), k] = 1
    return lut / np.maximum(1, lut.sum(1, keepdims=True)), names


_groups: list = []


def tokens(text: pa.Array, data: np.ndarray | None = None, off: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words and their stems, row starts, and the language group of each row (-1: none)."""
    if data is None or off is None:
        data, off = buffers(text)
    h, row, start, end = words(data, off, PUNCT)
    n = len(off) - 1
    if not _groups:
        _groups.extend(_group_table())
    lut = _groups[0]
    at = row_bounds(row, n)
    hit = lut[(h >> np.uint64(46)).astype(np.int64)]
    total = np.zeros((len(h) + 1, lut.shape[1]))
    np.cumsum(hit, axis=0, out=total[1:])
    votes = total[at[1:]] - total[at[:-1]]
    group = np.where(votes.max(1) > 0, votes.argmax(1), -1)
    stem = span_hashes(lowered(data), start, np.minimum(end, start + STEM))
    return (np.stack([h, mix(stem)], axis=1) >> np.uint64(64 - BITS)).astype(np.int32), at, group


def _project(emb: np.ndarray, filt: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([emb @ f[k] for f in filt for k in range(len(f))], axis=1).astype(np.float32)


def _look(table: np.ndarray, idx: np.ndarray) -> np.ndarray:
    return table[idx[:, 0]] + table[idx[:, 1]]


def _windows(g: np.ndarray) -> np.ndarray:
    """Filter outputs at each position from projected words; g has len(WIDTHS)-1 trailing pad rows."""
    n, parts, c = len(g) - (max(WIDTHS) - 1), [], 0
    for w in WIDTHS:
        z = g[:n, c : c + FILTERS].copy()
        for k in range(1, w):
            z += g[k : n + k, c + k * FILTERS : c + (k + 1) * FILTERS]
        parts.append(z)
        c += w * FILTERS
    return np.concatenate(parts, axis=1)


def pooled(model: ToxicModel, bucket: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Maximum of every filter over the windows that start in each row (rows, filters); pads follow each row."""
    n, pads, tail = len(at) - 1, max(WIDTHS), max(WIDTHS) - 1
    out = np.full((n, len(model.bias)), -np.inf, np.float32)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + BLOCK, "right")) - 1)
        hi = min(hi, n)
        if at[hi] - at[lo] <= 2 * BLOCK:
            size = np.diff(at[lo : hi + 1]) + pads
            start = np.cumsum(size) - size
            idx = np.full((int(size.sum()) + tail, 2), PAD)
            where = np.arange(at[lo], at[hi]) - at[lo] + np.repeat(np.arange(hi - lo) * pads, np.diff(at[lo : hi + 1]))
            idx[where] = bucket[at[lo] : at[hi]]
            ends = start + np.maximum(1, np.diff(at[lo : hi + 1]))
            out[lo:hi] = np.maximum.reduceat(_windows(_look(model.table, idx)), np.stack([start, ends], axis=1).ravel(), axis=0)[::2]
        else:  # one long text
            for a in range(int(at[lo]), int(at[hi]), BLOCK):
                idx = np.concatenate([bucket[a : min(a + BLOCK + tail, int(at[hi]))], np.full((tail, 2), PAD)])
                out[lo] = np.maximum(out[lo], _windows(_look(model.table, idx))[:BLOCK].max(0))
        lo = hi
    return out + model.bias


def raw_score(model: ToxicModel, bucket: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.maximum(pooled(model, bucket, at), 0) @ model.out + model.base


def gradients(params: list[np.ndarray], idx: np.ndarray, start: np.ndarray, size: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Weighted log loss of a batch and its gradient in each of params (embeddings, filters, bias, output, base).

    idx: (words, 2) buckets of all texts in a row, max(WIDTHS) pads after each; text i with its pads is `size[i]` from `start[i]`.
    """
    emb, *filt, bias, out, base = params
    used, local = np.unique(idx, return_inverse=True)
    z = _windows(_look(_project(emb[used], filt), local.reshape(idx.shape)))
    best = np.stack([s + z[s : s + max(1, n - max(WIDTHS))].argmax(0) for s, n in zip(start, size, strict=True)])
    top = z[best, np.arange(len(bias))] + bias
    hid = np.maximum(top, 0)
    p = sigmoid(hid @ out + base[0])
    d = weight * (p - y) / len(y)
    dtop = d[:, None] * out * (top > 0)
    grads = [np.zeros_like(p) for p in params]
    grads[-1][0], grads[-2][:], grads[-3][:] = d.sum(), hid.T @ d, dtop.sum(0)
    for f, w in enumerate(WIDTHS):
        cols = slice(f * FILTERS, (f + 1) * FILTERS)
        for k in range(w):
            word = idx[best[:, cols] + k]
            e = emb[word[..., 0]] + emb[word[..., 1]]
            grads[1 + f][k] = np.einsum("bfd,bf->df", e, dtop[:, cols])
            for part in (0, 1):
                np.add.at(grads[0], word[..., part], dtop[:, cols, None] * filt[f][k].T[None])
    grads[0][PAD] = 0
    loss = -(weight * np.where(y == 1, np.log(np.maximum(p, 1e-12)), np.log(np.maximum(1 - p, 1e-12)))).mean()
    return float(loss), grads


def train(bucket: np.ndarray, at: np.ndarray, y: np.ndarray, epochs: int = 8, steps: int = 240, batch: int = 64, rate: float = 0.01, drop: float = 0.2, decay: float = 1e-3, seed: int = 1) -> ToxicModel:
    """Adam on the convolutional classifier, for `epochs` rounds and `steps` batches at least; both classes weigh the same."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (V + 1, DIM))
    emb[PAD] = 0
    filt = [rng.normal(0, 0.5 / w**0.5, (w, DIM, FILTERS)) for w in WIDTHS]
    nf, pads = FILTERS * len(WIDTHS), max(WIDTHS)
    bias, out, base = np.zeros(nf), rng.normal(0, 0.3, nf), np.zeros(1)
    params = [emb, *filt, bias, out, base]
    mean, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    step = 0
    for _ in range(max(epochs, -(-steps * batch // len(y)))):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            size = (at[rows + 1] - at[rows]) + pads
            start = np.cumsum(size) - size
            idx = np.full((int(size.sum()) + pads, 2), PAD)
            for r, s in zip(rows, start, strict=True):
                idx[s : s + at[r + 1] - at[r]] = bucket[at[r] : at[r + 1]]
            idx[rng.random(len(idx)) < drop] = PAD
            grads = gradients(params, idx, start, size, y[rows], weight[rows])[1]
            step += 1
            for p, g, m, v in zip(params, grads, mean, var, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            emb *= 1 - decay
    return ToxicModel(_project(emb, filt), bias.astype(np.float32), out, float(base[0]))


def _best_cut(score: np.ndarray, y: np.ndarray) -> float:
    """Score with the best F1, midway to the next lower one, so that unseen texts have room on both sides."""
    order = np.argsort(-score, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    k = int(f1.argmax())
    s = score[order]
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k])


def cuts_of(score: np.ndarray, group: np.ndarray, y: np.ndarray) -> dict[str, float]:
    """Cuts by language group, and over all ("")."""
    cuts = {"": _best_cut(score, y)}
    for k, name in enumerate(sorted(WORDS)):
        own = group == k
        if (y[own] == 1).sum() >= MIN_POSITIVE and (y[own] == 0).any():
            cuts[name] = _best_cut(score[own], y[own])
    return cuts


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4000, epochs: int = 8) -> ToxicModel:
    """The classifier, fitted on a bounded labelled sample, and its cuts.

    At every size the cuts come from all rows of the sample, each scored by one of five models that leave its fifth
    out; the classifier itself is fitted on all.
    """
    rows = labelled_sample(docs, labels, "toxic", per_class)
    y = np.array([r["y"] for r in rows], float)
    if len(rows) < 2 or y.min() == y.max():
        share = float(y.mean()) if len(rows) else 0.0
        return ToxicModel(base=float(logit(share)), cuts={"": float(logit(CUT))})
    parts = [tokens(pa.array([r["text"] for r in rows[k : k + 200]], pa.string())) for k in range(0, len(rows), 200)]
    bucket, group = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts])
    at = np.r_[0, np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))]
    rows.clear()

    def part(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = np.concatenate([bucket[at[i] : at[i + 1]] for i in which]) if len(which) else bucket[:0]
        return own, np.r_[0, np.cumsum([at[i + 1] - at[i] for i in which])].astype(np.int64)

    fold, score = np.arange(len(y)) % 5, np.full(len(y), np.nan)
    for k in range(5):
        mine, rest = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        if len(mine) and len(rest):
            score[mine] = raw_score(train(*part(rest), y[rest], epochs), *part(mine))
    model, seen = train(bucket, at, y, epochs), ~np.isnan(score)
    model.cuts = cuts_of(score[seen], group[seen], y[seen])
    return model


def score_texts(model: ToxicModel, text: pa.Array) -> np.ndarray:
    data, off = buffers(text)
    out = np.zeros(len(off) - 1)
    names = sorted(WORDS)
    shift = np.array([model.cuts.get(n, model.cuts.get("", 0.0)) for n in names] + [model.cuts.get("", 0.0)])
    for lo, hi in row_blocks(off):
        bucket, at, group = tokens(text, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        out[lo:hi] = sigmoid(raw_score(model, bucket, at) - shift[group] + logit(CUT))
    return out


def score_toxicity(docs: DataFrame, model: ToxicModel, keep: list[str] | None = None) -> DataFrame:
    """docs with score (0 to 1; the calibrated cut of every language is 0.3) and predicted (0 or 1)."""
    model_b = docs.sparkSession.sparkContext.broadcast(model)  # 6 MB whatever the input

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        s = score_texts(model_b.value, b.column(b.schema.get_field_index("text")))
        return [pa.array(s), pa.array((s >= CUT).astype(np.int32))]

    return add_columns(docs, make, [("score", T.DoubleType()), ("predicted", T.IntegerType())], keep)


def op1_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    out = score_toxicity(docs.select("doc_id", "text", held_out().alias("held_out")), model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "score", "predicted")
