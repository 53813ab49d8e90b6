r"""Operator 10, language identification by cross-parsing entropy.

Texts are normalised (letters and marks in lower case, everything between them one blank) and taken
as UTF-8 bytes, so no script is folded into another.  For each language a suffix automaton is built
over labelled text.  A document is parsed greedily into the longest phrases that occur in that text
(a byte that does not occur is a phrase of its own); a language's cost is the number of phrases times
log2 of its reference length, in bits.  The language with the least cost wins (ties: the first in
code-point order).

Model: at most `max_bytes` of reference per language, cut from a window of at most `piece` characters
of each of up to `max_rows` labelled rows per language (by hash order; a window starts at a hashed
place of its text, so long texts teach as short ones do); rows that held_out() marks are never read.  The
`max_languages` languages with the most labelled rows are learned; with many, the reference shrinks so
that all tables stay within TABLE_BYTES.  Reference texts travel to the workers; each worker builds its automata
once, as dense tables over the bytes that a language has, and runs many texts through them in lockstep, so that no
Python code runs per character.

Whole texts are parsed.  A text longer than SEGMENT bytes is parsed in segments side by side: greedy
parses that start at different places soon end a phrase at the same one, so a parse that starts WARM bytes before
a segment mostly tells where its first phrase begins.  Segments that do not begin where the one before
really ended are parsed again from there, until none is left, so the result is always the
parse of the whole text (tested against a plain loop).

`score` is the winner's share of 2^(-cost / SPREAD): phrases of one text are not independent draws, so bits are
divided by SPREAD before they count as evidence; ranks do not depend on it.

Results: null text or no letter -> `und`, score 0.  No labelled rows at all -> `und` everywhere.
Repeated rows get equal results; very long texts are parsed whole; an empty table gives no rows; a
column of the input that is named like a result is replaced.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewell.llm.base import add_columns, buffers, held_out, row_blocks

SEGMENT = 1024
#: Bytes before a segment at which a parse starts that finds out where the segment's first phrase begins.
WARM = 64
LANES = 4096
SPREAD = 8
TABLE_BYTES = 256 << 20
UND = "und"


@dataclass
class LanguageModel:
    """Normalised reference text per language, in UTF-8."""

    names: list[str] = field(default_factory=list)
    reference: list[bytes] = field(default_factory=list)


_points: list[np.ndarray] = []


def _point_tables() -> list[np.ndarray]:
    """By code point: what it becomes (its lower case, or a blank) and whether it is a letter."""
    if not _points:
        low, letter = np.full(0x110000, 32, np.uint32), np.zeros(0x110000, bool)
        for i in range(0x110000):
            kind = unicodedata.category(chr(i))[0]
            if kind in "LM":
                small = chr(i).lower()
                low[i], letter[i] = ord(small) if len(small) == 1 else i, kind == "L"
        _points.extend([low, letter])
    return _points


def normalised(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts in normal form, row offsets into them, and letters by row."""
    low, letter = _point_tables()
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=at[1:])
    edge = at[off]
    letters = np.zeros(len(points) + 1, np.int64)
    np.cumsum(letter[points], out=letters[1:])
    new = low[points]
    gap = new == 32
    before = np.ones(len(new), bool)
    before[1:] = gap[:-1]
    before[edge[:-1][edge[:-1] < len(new)]] = True  # no blank at the start of a text
    keep = ~(gap & before)
    size = np.where(new < 0x80, 1, np.where(new < 0x800, 2, np.where(new < 0x10000, 3, 4))) * keep
    where = np.zeros(len(new) + 1, np.int64)
    np.cumsum(size, out=where[1:])
    out = np.frombuffer(new[keep].tobytes().decode("utf-32-le").encode("utf-8"), np.uint8)
    return out, where[edge], np.diff(letters[edge])


def fit(docs: DataFrame, max_bytes: int = 24_000, max_rows: int = 480, piece: int = 1000, max_languages: int = 256, seed: int = 7) -> LanguageModel:
    """Reference texts from a bounded sample of labelled rows (see the module's docstring)."""
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    most = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()
    if not most:
        return LanguageModel()
    span = 1 << 31
    share = F.lit(None).cast("double")
    for r in most:
        share = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, 1.3 * max_rows / r["n"]))).otherwise(share)
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(span)) / F.lit(float(span))
    start = F.pmod(F.xxhash64("text", F.lit(seed)), F.greatest(F.lit(1), F.length("text") - piece + 1)) + 1
    window = F.substring("text", start.cast("int"), F.lit(piece))
    picked = rows.withColumn("__u", u).where(F.col("__u") <= share).select("lang", window.alias("text"), "__u", F.xxhash64("text").alias("__t")).collect()
    by: dict[str, list] = {}
    for r in sorted(picked, key=lambda r: (r["lang"], r["__u"], r["__t"])):
        by.setdefault(r["lang"], []).append(r["text"])
    model = LanguageModel()
    for name in sorted(by):
        raw = np.frombuffer(" ".join(by[name][:max_rows]).encode("utf-8"), np.uint8)
        ref, _, letters = normalised(raw, np.array([0, len(raw)]))
        if letters[0]:
            model.names.append(name)
            model.reference.append(ref.tobytes())
    room = TABLE_BYTES // max(1, len(model.names)) // 8  # two states a byte at most, four bytes an arc
    model.reference = [r[: max(256, min(max_bytes, room // (len(set(r)) + 1)))] for r in model.reference]
    return model


@dataclass
class Automaton:
    """code: class of each byte (0: does not occur); flat: (state x classes + class) -> next state x classes << 1 | a phrase ended."""

    code: np.ndarray
    flat: np.ndarray


def automaton(ref: bytes) -> Automaton:
    """Suffix automaton of `ref` as a dense table.

    Where the automaton has no arc, a phrase ends and the next begins with this byte: at the root's
    arc, or in the last state (after a byte that does not occur), which has the root's arcs and ends
    its phrase at each.
    """
    own = sorted(set(ref))
    code = np.zeros(256, np.int32)
    code[own] = np.arange(1, len(own) + 1)
    width = len(own) + 1
    arcs: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in code[np.frombuffer(ref, np.uint8)].tolist():
        cur = len(arcs)
        arcs.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in arcs[p]:
            arcs[p][c] = cur
            p = link[p]
        if p != -1:
            q = arcs[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(arcs)
                arcs.append(dict(arcs[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and arcs[p].get(c) == q:
                    arcs[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    lost = len(arcs)
    root = np.full(width, lost, np.int64)
    for c, to in arcs[0].items():
        root[c] = to
    flat = np.tile((root * width << 1) | 1, (lost + 1, 1)).astype(np.int32)
    state = np.repeat(np.arange(lost), [len(a) for a in arcs])
    char = np.fromiter((c for a in arcs for c in a), np.int64, len(state))
    goal = np.fromiter((t for a in arcs for t in a.values()), np.int64, len(state))
    flat[state, char] = goal * width << 1
    flat[0] &= -2  # a first phrase ends none
    return Automaton(code, flat.ravel())


_built: dict[tuple, list[Automaton]] = {}


def _tables(model: LanguageModel) -> list[Automaton]:
    key = (*model.names, hash(tuple(model.reference)))
    if key not in _built:
        _built.clear()
        _built[key] = [automaton(r) for r in model.reference]
    return _built[key]


def _run(flat: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases that begin in [start, end), and the first place from `end` on where one begins (`stop`: the text's end).

    text: classes; a phrase begins at `start`.  Lanes run in lockstep, longest first.
    """
    out, leave = np.zeros(len(start), np.int64), np.maximum(start, end)
    order = np.argsort(start - end, kind="stable")
    order = order[(end - start)[order] > 0]
    for lo in range(0, len(order), LANES):
        own = order[lo : lo + LANES]
        s, z = start[own], (end - start)[own]
        at = np.minimum(s[None, :] + np.arange(int(z[0]))[:, None], len(text) - 1)
        lanes = text[at]
        active = np.searchsorted(-z, -np.arange(int(z[0])), "left")  # lanes longer than t
        state, count = np.zeros(len(own), np.int32), np.ones(len(own), np.int32)
        for t in range(int(z[0])):
            n = active[t]
            v = flat.take(state[:n] + lanes[t, :n])
            count[:n] += v & 1
            np.right_shift(v, 1, out=state[:n])
        out[own] = count
        pos = end[own].copy()
        open_ = np.flatnonzero(pos < stop[own])  # phrases that go on beyond the segment
        while len(open_):
            v = flat.take(state[open_] + text[pos[open_]])
            state[open_] = v >> 1
            on = (v & 1) == 0
            open_ = open_[on]
            pos[open_] += 1
            open_ = open_[pos[open_] < stop[own][open_]]
        leave[own] = pos
    return out, leave


def phrase_counts(model: LanguageModel, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row: phrases by language, bytes in normal form, and letters."""
    text, edge, letters = normalised(data, off)
    rows, size = len(off) - 1, np.diff(edge)
    pieces = -(-size // SEGMENT)
    owner = np.repeat(np.arange(rows), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = edge[owner] + nth * SEGMENT
    stop = edge[owner + 1]
    end = np.minimum(first + SEGMENT, stop)
    follows = np.flatnonzero(nth > 0)
    out = np.zeros((rows, len(model.names)))
    for k, a in enumerate(_tables(model)):
        coded = a.code[text]
        start = first.copy()
        early = np.maximum(edge[owner[follows]], first[follows] - WARM)
        start[follows] = _run(a.flat, coded, early, first[follows], stop[follows])[1]
        count, leave = _run(a.flat, coded, start, end, stop)
        while True:
            moved = follows[start[follows] != leave[follows - 1]]
            if not len(moved):
                break
            start[moved] = leave[moved - 1]
            count[moved], leave[moved] = _run(a.flat, coded, start[moved], end[moved], stop[moved])
        out[:, k] = np.bincount(owner, count, rows)
    return out, size, letters


def predict(model: LanguageModel, text: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and phrases per byte of the winner."""
    data, off = buffers(text)
    n = len(off) - 1
    best, score, rate = np.full(n, -1), np.zeros(n), np.ones(n)
    if model.names:
        bits = np.log2(np.array([max(2, len(r)) for r in model.reference]))
        for lo, hi in row_blocks(off):
            phrases, size, letters = phrase_counts(model, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            cost = phrases * bits
            win = cost.argmin(1)
            least = cost[np.arange(hi - lo), win]
            score[lo:hi] = np.where(letters > 0, 1 / np.exp2(-np.minimum(cost - least[:, None], 60 * SPREAD) / SPREAD).sum(1), 0.0)
            rate[lo:hi] = phrases[np.arange(hi - lo), win] / np.maximum(1, size)
            best[lo:hi] = np.where(letters > 0, win, -1)
    return [model.names[k] if k >= 0 else UND for k in best], score, rate


def identify(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and phrase_rate; no shuffle."""

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        names, score, rate = predict(model, b.column(b.schema.get_field_index("text")))
        return [pa.array(names, pa.string()), pa.array(score), pa.array(rate)]

    return add_columns(docs, make, [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("phrase_rate", T.DoubleType())], keep)


def op10_langid(docs: DataFrame) -> DataFrame:
    """The contract's columns, plus phrase_rate."""
    out = identify(docs.select("doc_id", "text", held_out().alias("held_out")), fit(docs), keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score", "phrase_rate")
