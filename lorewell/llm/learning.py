"""Labelled rows, sums over all rows, and small numpy models that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm.base import held_out, ship

SPAN = 1 << 40


def learnable(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and y of every labelled id that held_out() does not mark, once each."""
    return labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    per_class: int = 2000,
    max_row_chars: int = 20_000,
    seed: int = 5,
    extra: tuple[str, ...] = (),
) -> list:
    """Rows (doc_id, text, y, *extra) for fitting: at most per_class documents of each class.

    The bound is per_class x 2 documents of at most max_row_chars characters: the rows with the least
    hash of doc_id, of those that held_out() does not mark (a fifth more are drawn by a hash threshold
    that follows from the class counts, so that no task sends more than its share); of repeated ids,
    one row.
    """
    lab = learnable(labels, label)
    n = {bool(r["c"]): r["n"] for r in lab.groupBy((F.col("y") == 1).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(SPAN))
    share = [int(SPAN * min(1.0, 1.2 * per_class / max(1, n.get(c, 0)))) for c in (False, True)]
    ids = lab.withColumn("__u", u).where(F.col("__u") < F.when(F.col("y") == 1, F.lit(share[1])).otherwise(F.lit(share[0])))
    some = docs.where(F.length("text") <= max_row_chars).select("doc_id", "text", *extra).join(F.broadcast(ids), "doc_id")  # about 2.4 x per_class rows
    one = some.groupBy("doc_id").agg(F.max(F.struct("text", *extra)).alias("r"), F.max("y").alias("y"), F.max("__u").alias("__u")).select("doc_id", "r.*", "y", "__u")
    rows = sorted(one.collect(), key=lambda r: (r["__u"], r["doc_id"]))
    own = [[r for r in rows if (r["y"] == 1) == c][:per_class] for c in (False, True)]
    return sorted(own[0] + own[1], key=lambda r: (r["doc_id"] * 2654435761 % 2**32, r["doc_id"]))


def fixed_rows(column: pa.Array, kind: type) -> np.ndarray:
    """A binary column whose values are all of one length, as (rows, numbers)."""
    size = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    off = np.frombuffer(column.buffers()[1], size)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]].view(kind).reshape(len(column), -1)


def summed(df: DataFrame, make: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """Sum of the whole numbers that make() gives for each Arrow batch; every task sends one array of this shape."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64)
        for b in batches:
            if b.num_rows:
                total += make(b)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    out = np.zeros(shape, np.int64)
    for r in df.mapInArrow(run, "total binary").collect():
        out += np.frombuffer(r["total"], np.int64).reshape(shape)
    return out


_SIGN = np.uint64(1 << 63)
_DIGIT = 4  # bits that one pass of order_statistics() settles


def _ordered(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles x."""
    b = (x + 0.0).view(np.uint64)
    return np.where(b >= _SIGN, ~b, b | _SIGN)


def digit_counts(x: np.ndarray, heads: list[np.ndarray], shift: int, most: int) -> np.ndarray:
    """Rows by column, head (the bits before the digit at `shift`) and digit."""
    out = np.zeros((len(heads), most, 1 << _DIGIT), np.int64)
    for f, head in enumerate(heads):
        key = _ordered(x[:, f]) >> np.uint64(shift)
        at = np.searchsorted(head, key >> np.uint64(_DIGIT)).clip(0, len(head) - 1)
        on = head[at] == key >> np.uint64(_DIGIT)
        out[f] = np.bincount(at[on] << _DIGIT | (key[on] & np.uint64((1 << _DIGIT) - 1)).astype(np.int64), minlength=most << _DIGIT).reshape(most, -1)
    return out


def order_statistics(df: DataFrame, make: Callable[[pa.RecordBatch], np.ndarray], columns: int, ranks: np.ndarray) -> np.ndarray:
    """The exact doubles (columns, ranks) at these ranks (from 0, below the number of rows) of every column that make() computes.

    Digit by digit from the highest, counted over all rows; no task holds or sends more than 2^_DIGIT counts for each rank and column.
    """
    head = np.zeros((columns, len(ranks)), np.uint64)
    left = np.repeat(ranks[None].astype(np.int64), columns, axis=0)
    for shift in range(64 - _DIGIT, -1, -_DIGIT):
        heads = [np.unique(h) for h in head]
        n = summed(df, lambda b, heads=heads, shift=shift: digit_counts(make(b), heads, shift, len(ranks)), (columns, len(ranks), 1 << _DIGIT))
        for f in range(columns):
            upto = np.cumsum(n[f][np.searchsorted(heads[f], head[f])], axis=1)
            digit = (upto <= left[f][:, None]).sum(1)
            left[f] -= np.where(digit > 0, upto[np.arange(len(ranks)), digit - 1], 0)
            head[f] = head[f] << np.uint64(_DIGIT) | digit.astype(np.uint64)
    return np.where(head >= _SIGN, head & ~_SIGN, ~head).view(np.float64)


def quantiles(df: DataFrame, make: Callable[[pa.RecordBatch], np.ndarray], columns: int, rows: int, q: np.ndarray) -> np.ndarray:
    """numpy's quantiles (columns, q) over all rows."""
    place = q * (rows - 1)
    below = np.floor(place).astype(np.int64)
    ranks, at = np.unique(np.r_[below, np.minimum(below + 1, rows - 1)], return_inverse=True)
    low, high = np.split(order_statistics(df, make, columns, ranks)[:, at], 2, axis=1)
    return low + (high - low) * (place - below)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logit(p: np.ndarray | float) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic regression (last one: intercept) by Newton steps with a ridge."""
    x1 = np.c_[x, np.ones(len(x))]
    w = np.zeros(x1.shape[1])
    s = np.ones(len(x)) if weight is None else weight
    ridge = np.full(x1.shape[1], l2 * len(x))
    ridge[-1] = 1e-9
    for _ in range(rounds):
        p = sigmoid(x1 @ w)
        g = x1.T @ (s * (p - y)) + ridge * w
        h = (x1 * (s * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x1 + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-5:
            break
    return w


def keep_threshold(score: np.ndarray, y: np.ndarray, keep: float) -> float:
    """Largest threshold that keeps the share `keep` of the rows of class 1."""
    good = np.sort(score[y == 1])
    return float(good[int(len(good) * (1 - keep))]) if len(good) else 0.0
