r"""Operator 7, benchmark decontamination by n-gram seeds and Smith-Waterman alignment.

1. Seeds are the word n-grams of the test items (n = `n`; an item of fewer words is one seed of its
   own length).  Words are runs of letters and digits, lower case.
2. One pass over the corpus finds every seed in every whole text (a bitmap, then binary search, on
   vectorised window hashes).  For each item that a text touches it takes the passage around the
   seeds: the diagonal of a seed says where the item would lie; windows that overlap merge.
3. Each passage is aligned to its item word by word (Smith-Waterman: match 2, mismatch and gap -1);
   score = alignment / (2 x item words), so an exact copy has 1 and a paraphrase loses by its edits.
   No passage is left out for how often its seeds or its text occur.  An alignment has at most as many
   matches as item and passage have words in common (with repeats): passages that cannot reach
   `threshold` by that bound, such as those around a stock phrase, are not aligned.  Equal passages of
   an item are aligned once by a worker.  Documents with a score of `threshold` or more against some
   item are contaminated.

The items are the query set: they are taken in blocks of `block` items (a pass each), so what a
worker holds is bounded whatever the benchmark's size; all of the corpus is read.  Passages are
aligned where they are found; only contaminated pairs are shuffled.

Results: null and empty texts and items touch nothing; equal items are reported each; repeated rows
(equal doc_id) give one row per item with the best score (ties: the first passage); a null doc_id is not reported
(drop_contaminated() judges such rows by their text); very long texts are read whole, and passages of any
length aligned in bounded memory; columns of any other name are not read; empty tables give no rows.  n_seeds is the
number of distinct seeds in the passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm.base import PUNCT, buffers, grams, matched, materialise, row_blocks, row_bounds, ship, words

BITMAP = 22
#: Passages of at most this many bytes of word hashes in all are remembered with their alignments.
REMEMBERED = 8 << 20


class Seeds:
    """Sorted seed hashes of a block of items, with the item and position of each occurrence."""

    def __init__(self, items: list[tuple[int, str]], n: int) -> None:
        hashes, owner, at, sizes = [], [], [], {}
        self.words: dict[int, np.ndarray] = {}
        self.bags: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        data, off = buffers(pa.array([t for _, t in items], pa.string()))
        h, row, _, _ = words(data, off, PUNCT)
        edge = row_bounds(row, len(items))
        lengths = set()
        for k, (item, _) in enumerate(items):
            own = h[edge[k] : edge[k + 1]]
            if not len(own):
                continue
            size = min(n, len(own))
            lengths.add(size)
            g = grams(own, size) + np.uint64(size)
            hashes.append(g)
            owner.append(np.full(len(g), item, np.int64))
            at.append(np.arange(len(g)))
            sizes[item] = len(own)
            self.words[item] = own
            self.bags[item] = np.unique(own, return_counts=True)
        cat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(cat, kind="stable")
        self.hash = cat[order]
        self.owner = np.concatenate(owner)[order] if hashes else np.zeros(0, np.int64)
        self.at = np.concatenate(at)[order] if hashes else np.zeros(0, np.int64)
        self.sizes, self.lengths = sizes, sorted(lengths)
        self.bitmap = np.zeros(1 << BITMAP, bool)
        self.bitmap[(self.hash >> np.uint64(64 - BITMAP)).astype(np.int64)] = True

    def in_common(self, item: int, passage: np.ndarray) -> int:
        """Words that item and passage share, with repeats: no alignment has more matches."""
        own, many = self.bags[item]
        k = np.minimum(np.searchsorted(own, passage), len(own) - 1)
        there = np.bincount(k[own[k] == passage], minlength=len(own))
        return int(np.minimum(there, many).sum())

    def find(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of words and of seed occurrences (index into owner/at) that match there."""
        pos_all, hit_all = [], []
        for n in self.lengths:
            g = grams(h, n) + np.uint64(n)
            maybe = np.flatnonzero(self.bitmap[(g >> np.uint64(64 - BITMAP)).astype(np.int64)])
            maybe = maybe[row[maybe] == row[maybe + n - 1]]
            lo = np.searchsorted(self.hash, g[maybe], "left")
            hi = np.searchsorted(self.hash, g[maybe], "right")
            many = hi - lo
            pos_all.append(np.repeat(maybe, many))
            first = np.cumsum(many) - many
            hit_all.append(np.repeat(lo, many) + np.arange(int(many.sum())) - np.repeat(first, many))
        return np.concatenate(pos_all), np.concatenate(hit_all)


class Aligner:
    """Alignments of passages to the items of a block; equal passages of an item are aligned once."""

    def __init__(self, seeds: Seeds, threshold: float) -> None:
        self.seeds, self.threshold = seeds, threshold
        self.known: dict[tuple[int, bytes], tuple[float, int, int]] = {}
        self.held = 0

    def score(self, item: int, passage: np.ndarray) -> tuple[float, int, int]:
        """Score, first and last word within the passage; score 0 where the threshold is out of reach."""
        own = self.seeds.words[item]
        if self.seeds.in_common(item, passage) / len(own) < self.threshold:
            return 0.0, 0, 0
        key = (item, passage.tobytes())
        if key not in self.known:
            s, a, z = align(own, passage)
            if self.held + passage.nbytes > REMEMBERED:
                self.known.clear()
                self.held = 0
            self.known[key] = s / (2 * len(own)), a, z
            self.held += passage.nbytes
        return self.known[key]


def _found(aligner: Aligner, doc_id: list, text: pa.Array, pad: int) -> dict[str, list]:
    """The passages of a batch with a score of the threshold or more."""
    out: dict[str, list] = {"doc_id": [], "item_id": [], "score": [], "first_word": [], "last_word": [], "n_seeds": []}
    seeds = aligner.seeds
    data, off = buffers(text)
    for a, z in row_blocks(off):
        own, edge = data[off[a] : off[z]], off[a : z + 1] - off[a]
        h, row, _, _ = words(own, edge, PUNCT)
        if not len(h) or not seeds.lengths:
            continue
        pos, hit = seeds.find(h, row)
        if not len(pos):
            continue
        at = row_bounds(row, z - a)
        item, r = seeds.owner[hit], row[pos]
        low = np.maximum(pos - seeds.at[hit] - pad, at[r])
        order = np.lexsort((low, item, r))
        pos, hit, item, r, low = pos[order], hit[order], item[order], r[order], low[order]
        size = np.array([seeds.sizes[i] for i in item.tolist()])
        high = np.minimum(pos - seeds.at[hit] + size + pad, at[r + 1])
        high = np.maximum(high, pos + 1)
        i = 0
        while i < len(pos):
            j, top = i + 1, high[i]
            while j < len(pos) and r[j] == r[i] and item[j] == item[i] and low[j] <= top:
                top = max(top, high[j])
                j += 1
            score, first, end = aligner.score(int(item[i]), h[low[i] : top])
            if score >= aligner.threshold:
                start = int(low[i] - at[r[i]])
                out["doc_id"].append(doc_id[a + int(r[i])])
                out["item_id"].append(int(item[i]))
                out["score"].append(score)
                out["first_word"].append(start + first)
                out["last_word"].append(start + end - 1)
                out["n_seeds"].append(len(np.unique(seeds.hash[hit[i:j]])))
            i = j
    return out


def leaks(docs: DataFrame, items: list[tuple[int, str]], n: int, threshold: float, pad: int) -> DataFrame:
    """One row per passage with a score of `threshold` or more against one of the items."""
    ship(docs.sparkSession)
    seeds = docs.sparkSession.sparkContext.broadcast(Seeds(items, n))  # `block` items at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(seeds.value, threshold)
        for b in batches:
            got = _found(aligner, b.column(0).to_pylist(), b.column(1), pad)
            if got["doc_id"]:
                types = [b.column(0).type, pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(got.values(), types, strict=True)], names=list(got))

    named = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    return named.mapInArrow(run, f"doc_id {named.schema['doc_id'].dataType.simpleString()}, item_id long, score double, first_word long, last_word long, n_seeds int")


def _row(item_word: np.uint64, passage: np.ndarray, prev: np.ndarray, ramp: np.ndarray) -> np.ndarray:
    """Next row of the alignment table: match 2, mismatch and gap -1, never below 0."""
    cur = np.zeros(len(prev), np.int32)
    cur[1:] = np.maximum(prev[:-1] + np.where(passage == item_word, 2, -1), prev[1:] - 1)
    np.maximum(cur, 0, out=cur)
    return np.maximum.accumulate(cur + ramp) - ramp  # gaps within the passage


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of word hashes: score, first and last word of the passage in it.

    All rows of the table are kept to trace the alignment back where the passage has at most
    4 x item words.  For a longer one the first pass holds one row and finds where the best alignment
    ends.  With a score above 0 it has fewer gaps than twice its matches, so it lies within the 3 x
    item words before that end: rows are kept for these only, whatever the passage's length.
    """
    short = len(passage) <= 4 * len(item)
    ramp = np.arange(len(passage) + 1, dtype=np.int32)
    rows = [np.zeros(len(passage) + 1, np.int32)]
    best, end, at = 0, 0, 0
    for i, w in enumerate(item, 1):
        row = _row(w, passage, rows[-1], ramp)
        if not short:
            rows.clear()
        rows.append(row)
        k = int(row.argmax())
        if row[k] > best:
            best, end, at = int(row[k]), k, i
    if not best:
        return 0, 0, 0
    low = 0 if short else max(0, end - 3 * len(item))
    near = passage[low:end]
    if not short:
        rows = [np.zeros(len(near) + 1, np.int32)]
        for w in item[:at]:
            rows.append(_row(w, near, rows[-1], ramp[: len(near) + 1]))
    i, j = at, len(near)
    while i > 0 and j > 0 and rows[i][j] > 0:
        v = rows[i][j]
        if v == rows[i - 1][j - 1] + (2 if near[j - 1] == item[i - 1] else -1):
            i, j = i - 1, j - 1
        elif v == rows[i - 1][j] - 1:
            i -= 1
        else:
            j -= 1
    return best, low + j, end


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 4, threshold: float = 0.5, pad: int = 8, block: int = 20_000) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word, n_seeds: one row per contaminated pair."""
    items = benchmark.where("item_id is not null and text is not null").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.max("text").alias("item"))
    scored = None
    total = items.count()
    for k in range(max(1, -(-total // block))):
        parts = -(-total // block) or 1
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).collect()
        got = leaks(docs, [(r["item_id"], r["item"]) for r in own], n, threshold, pad)
        scored = got if scored is None else scored.unionByName(got)
    best = F.max(F.struct("score", F.negative("first_word").alias("f"), "last_word", "n_seeds")).alias("r")
    return scored.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "r.score", F.negative("r.f").alias("first_word"), "r.last_word", "r.n_seeds")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones; a row with a null doc_id goes by its text."""
    key = F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.concat(F.lit("t"), F.md5(F.col("text").cast("binary"))))
    gone = materialise(contaminated(docs.select(key.alias("doc_id"), "text"), benchmark).select("doc_id").distinct())
    return matched(docs, F.coalesce(key, F.lit("")), gone, "left_anti")


def op7_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(docs.select("doc_id", "text"), benchmark).withColumn("score", F.round("score", 9))
