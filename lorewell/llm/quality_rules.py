r"""Operator 5, quality rules learned as gradient-boosted trees over document statistics.

Statistics of a whole text (words are runs outside ASCII blanks): counts of words, of their code
points, of symbols `#*$%&|<>`, of lines equal to an earlier one, of words in repeated 3-word windows,
and further shares (capitals, digits, exclamation marks, log of distinct words over log of words).  All are computed with
numpy on Arrow's buffers; equality of words, lines and windows is equality of 64-bit hashes.

A forest (gbt.boost) is fitted on the statistics of all labelled rows (labels.quality): the texts are read once, their statistics
stored, and the workers send sums over these; the shares of symbols, repeats, repeated lines, capitals and exclamation marks are constrained never to raise the
score, length and distinct words never to lower it.  Scoring walks flat node arrays for all rows at once.  The verdict keeps a document whose
score reaches the cut that keeps `keep` of the good documents of a fifth that the fit does not see
(`max_cut` at most, so that a sharp forest does not drop borderline documents).
`base_failed` (fewer than 50 words, or over half of the words repeated) overrides it.

Results: null and empty texts have zero counts and fail the base rule; without labels of both
classes the verdict keeps all.  Repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewell.llm.base import SPACE, add_columns, buffers, forget, grams, materialise, mix, row_blocks, row_bounds, span_hashes, word_spans
from lorewell.llm.gbt import Forest, boost, codes_of, constant, level_sums
from lorewell.llm.learning import fixed_rows, learnable, logit, order_statistics, quantiles, summed

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "word_length", "symbols", "dup_lines", "repeats", "capitals", "digits", "shouts", "distinct"]
MONOTONE = np.array([1, 0, -1, -1, -1, -1, 0, -1, 1])
SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = 1
NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True


def _per_row(hit: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(hit) + 1, np.int64)
    np.cumsum(hit, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def _seen_before(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is equal to an earlier one of its row, occurs more than once in its row)."""
    key = h ^ mix(row.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = np.zeros(len(s), bool)
    same[1:] = s[1:] == s[:-1]
    twice = same.copy()
    twice[:-1] |= same[1:]
    later, more = np.zeros(len(s), bool), np.zeros(len(s), bool)
    later[order], more[order] = same, twice
    return later, more


def block_statistics(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts (rows, 5) and features (rows, 9)."""
    n = len(off) - 1
    start, end, row = word_spans(data, off, SPACE)
    h = span_hashes(data, start, end)
    at = row_bounds(row, n)
    n_words = np.diff(at)
    inside = ~SPACE[data]
    chars = _per_row(inside & ((data & 0xC0) != 0x80), off)
    symbols = _per_row(SYMBOLS[data], off)
    la, lz, lrow = word_spans(data, off, NEWLINE)
    ink = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=ink[1:])
    real = ink[lz] > ink[la]
    la, lz, lrow = la[real], lz[real], lrow[real]
    dup_lines = np.bincount(lrow[_seen_before(span_hashes(data, la, lz), lrow)[0]], minlength=n)
    g = grams(h, 3)
    whole = row[: len(g)] == row[2:] if len(g) else np.zeros(0, bool)
    covered = np.zeros(len(h), bool)
    pos = np.flatnonzero(whole)
    pos = pos[_seen_before(g[pos], row[pos])[1]]
    for k in range(3):
        covered[pos + k] = True
    repeats = np.bincount(row[covered], minlength=n)
    again = np.bincount(row[_seen_before(h, row)[0]], minlength=n)
    lines = np.bincount(lrow, minlength=n)
    size = np.maximum(1, _per_row(inside, off))
    w = np.maximum(1, n_words)
    counts = np.stack([n_words, chars, symbols, dup_lines, repeats], axis=1)
    shares = [
        np.log1p(n_words), chars / w, symbols / w, dup_lines / np.maximum(1, lines), repeats / w,
        _per_row((data >= 65) & (data <= 90), off) / size, _per_row((data >= 48) & (data <= 57), off) / size,
        _per_row(data == 33, off) / w, np.log1p(n_words - again) / np.log1p(w),  # the share of distinct words itself falls with length
    ]
    return counts, np.stack(shares, axis=1)


def statistics(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, off = buffers(text)
    n = len(off) - 1
    counts, shares = np.zeros((n, 5), np.int64), np.zeros((n, len(FEATURES)))
    for lo, hi in row_blocks(off):
        counts[lo:hi], shares[lo:hi] = block_statistics(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
    return counts, shares


def base_rule(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])


@dataclass
class QualityRules:
    forest: Forest
    cut: float


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """docs[keep] with the counts and x, the features in binary; no shuffle."""

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        counts, x = statistics(b.column(b.schema.get_field_index("text")))
        return [*[pa.array(counts[:, k]) for k in range(5)], pa.array([v.tobytes() for v in x], pa.binary())]

    return add_columns(docs, make, [*[(c, T.LongType()) for c in COUNTS], ("x", T.BinaryType())], keep)


def _x(b: pa.RecordBatch) -> np.ndarray:
    return fixed_rows(b.column(b.schema.get_field_index("x")), np.float64)


def learn(measured: DataFrame, labels: DataFrame, keep: float = 0.998, max_cut: float = 0.2, bins: int = 48) -> QualityRules:
    """Forest and cut from all labelled rows of a stored measure() with doc_id; of an id with several texts, every text.

    The rows stay on the workers: the driver sees class counts, exact quantiles and, for each level of each tree, the sums of
    boost().  The rows are stored as codes for that.  The cut comes from a fifth by the hash of the id.
    """
    lab = learnable(labels, "quality").select("doc_id", (F.col("y") == 1).alias("good"))
    fifth = (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 4).alias("test")
    rows = materialise(measured.select("doc_id", "x").join(lab, "doc_id").distinct().select("good", fifth, "x"))
    n = {(r["good"], r["test"]): r["n"] for r in rows.groupBy("good", "test").agg(F.count(F.lit(1)).alias("n")).collect()}  # four rows
    own, all_rows = [n.get((c, False), 0) for c in (False, True)], sum(n.values())
    if all_rows < 10 or not all(own):
        return QualityRules(constant(1.0), 0.0)
    weight = np.array([0.5 / (own[c] + n.get((bool(c), True), 0)) * all_rows for c in (0, 1)])
    train = rows.where(~F.col("test"))
    edges = [np.unique(e) for e in quantiles(train, _x, len(FEATURES), sum(own), np.linspace(0, 1, bins + 1)[1:-1])]
    codes = materialise(add_columns(train, lambda b: [pa.array([c.tobytes() for c in codes_of(_x(b), edges)], pa.binary())], [("code", T.BinaryType())], ["good"]))

    def sums(forest: Forest, nodes: list[int], size: int) -> np.ndarray:
        def make(b: pa.RecordBatch) -> np.ndarray:
            good = b.column(b.schema.get_field_index("good")).to_numpy(zero_copy_only=False)
            return level_sums(forest, nodes, fixed_rows(b.column(b.schema.get_field_index("code")), np.uint8), good.astype(float), weight[good.astype(int)], size)

        return summed(codes, make, (len(nodes), len(FEATURES), size, 3))

    share = weight[1] * own[1] / (weight * own).sum()
    forest = boost(sums, edges, float(logit(share)), MONOTONE)
    tested = n.get((True, True), 0)
    cut = 0.0
    if tested:
        cut = float(order_statistics(rows.where("good and test"), lambda b: forest.score(_x(b))[:, None], 1, np.array([int(tested * (1 - keep))]))[0, 0])
    forget(rows)
    forget(codes)
    return QualityRules(forest, min(max_cut, cut))


def fit(docs: DataFrame, labels: DataFrame, keep: float = 0.998, max_cut: float = 0.2) -> QualityRules:
    measured = materialise(measure(docs, ["doc_id"]))
    rules = learn(measured, labels, keep, max_cut)
    forget(measured)
    return rules


def judge(measured: DataFrame, rules: QualityRules, keep: list[str]) -> DataFrame:
    """measured[keep] (a measure() table) with base_failed, kept and quality_score; no shuffle."""

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        counts = np.stack([b.column(b.schema.get_field_index(c)).to_numpy() for c in COUNTS], axis=1)
        failed, score = base_rule(counts), rules.forest.score(_x(b))
        return [pa.array(failed), pa.array(~failed & (score >= rules.cut)), pa.array(score)]

    return add_columns(measured, make, [("base_failed", T.BooleanType()), ("kept", T.BooleanType()), ("quality_score", T.DoubleType())], keep)


def apply_rules(docs: DataFrame, rules: QualityRules, keep: list[str] | None = None) -> DataFrame:
    """docs with the counts, base_failed, kept and quality_score; no shuffle."""

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        counts, x = statistics(b.column(b.schema.get_field_index("text")))
        failed, score = base_rule(counts), rules.forest.score(x)
        return [*[pa.array(counts[:, k]) for k in range(5)], pa.array(failed), pa.array(~failed & (score >= rules.cut)), pa.array(score)]

    new = [(c, T.LongType()) for c in COUNTS] + [("base_failed", T.BooleanType()), ("kept", T.BooleanType()), ("quality_score", T.DoubleType())]
    return add_columns(docs, make, new, keep)


def op5_quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    measured = materialise(measure(docs.select("doc_id", "text"), ["doc_id"]))
    out = judge(measured, learn(measured, labels), ["doc_id", *COUNTS])
    return out.select("doc_id", *COUNTS, "base_failed", "kept", F.round("quality_score", 9).alias("quality_score"))
