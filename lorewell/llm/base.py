"""Shared pieces: scratch tables, Arrow column maps, and vectorised word hashing.

The word hashing works on Arrow's own UTF-8 buffers, so no Python string is made for a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewell.plans import tables
from lorewell.plans.tables import forget  # noqa: F401  (used by the operators)

#: Largest Arrow batch in bytes, where the session names none: workers and the JVM's buffers then stay small however long the texts.
BATCH_BYTES = {"spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20, "spark.sql.execution.arrow.maxBytesPerOutputBatch": 8 << 20}


def ship(spark: SparkSession) -> None:
    """Give Python workers this package; bound their batches by bytes (for the session, where it names no bound itself)."""
    named = spark.conf.getAll
    for key, most in BATCH_BYTES.items():
        if key not in named:
            spark.conf.set(key, most)
    tables.ship(spark)


_open: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Lists the tables that materialise() makes inside the block."""
    made: list[DataFrame] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open.remove(made)


def materialise(df: DataFrame) -> DataFrame:
    """Write df once as a table in the shared folder and read it back: lineage ends here.

    A lost executor loses none of it, and later plans see true sizes.
    """
    out = tables.stored(df)
    for made in _open:
        made.append(out)
    return out


#: Ids (a long or a short string each) that are broadcast; beyond, both sides are dealt by id.
FEW_IDS = 4 << 20


def matched(rows: DataFrame, column: Column, ids: DataFrame, how: str, few: int = FEW_IDS) -> DataFrame:
    """rows whose column is (left_semi) or is not (left_anti) in ids, a stored table of one column that is counted first."""
    name = ids.columns[0]
    side = ids.withColumnRenamed(name, "__wanted")
    return rows.join(F.broadcast(side) if side.count() <= few else side.hint("shuffle_merge"), column == F.col("__wanted"), how)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the quarter of ids that no model learns from; null ids count as false."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def add_columns(
    df: DataFrame,
    make: Callable[[pa.RecordBatch], list[pa.Array]],
    new: list[tuple[str, T.DataType]],
    keep: list[str] | None = None,
) -> DataFrame:
    """df with the columns that make() computes for each Arrow batch; no shuffle, no join.

    A column of df that has the name of a new one (in any case) is replaced by the new one.
    keep: the columns of df to pass on (default: all).
    """
    ship(df.sparkSession)
    names = {n.lower() for n, _ in new}
    stay = [f for f in df.schema.fields if (keep is None or f.name in keep) and f.name.lower() not in names]
    kept = [f.name for f in stay]
    types = [_arrow(t) for _, t in new]
    labels = kept + [n for n, _ in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            fresh = [a if a.type == t else a.cast(t) for a, t in zip(make(b), types, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in kept] + fresh, names=labels)
            del b, fresh
            pa.default_memory_pool().release_unused()

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in stay] + [T.StructField(n, t, True) for n, t in new])
    return df.mapInArrow(run, schema)


def _arrow(t: T.DataType) -> pa.DataType:
    simple = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    if isinstance(t, T.ArrayType):
        return pa.list_(_arrow(t.elementType))
    return simple[t.simpleString()]


# ---------------------------------------------------------------- text buffers

def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string array; a null counts as an empty text."""
    if text.null_count:
        text = text.fill_null("")
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    off = np.frombuffer(text.buffers()[1], kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def row_blocks(off: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes each; a longer text is a range of its own."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + size, "right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


#: ASCII whitespace as in `[\x20\x09-\x0D]`.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Everything but ASCII letters, digits and bytes of other scripts.
PUNCT = np.zeros(256, bool)
PUNCT[:128] = True
for _c in range(128):
    if chr(_c).isalnum():
        PUNCT[_c] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the Latin-1 capitals (two-byte UTF-8, C3 80 to C3 9E) in lower case."""
    low = LOWER[data]
    if len(data) > 1:
        up = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][up] += 32
    return low


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(1 << 20, n)
        for key, base in (("up", _BASE), ("down", _INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[key] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def word_spans(data: np.ndarray, off: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes) and row of every maximal run of bytes outside `gap`, within rows."""
    inside = ~gap[data]
    if not inside.any():
        z = np.zeros(0, np.int64)
        return z, z, z
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    per_row = np.diff(np.searchsorted(start, off))
    return start, end, np.repeat(np.arange(len(off) - 1), per_row)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """64-bit hash of each span of bytes (spans in order, not overlapping), in pieces of bounded memory."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + piece, "right")))
        lo, hi = int(start[i]), int(end[j - 1])
        up, down = _power(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[data[lo:hi]] * up[: hi - lo], out=total[1:])
        a, b = start[i:j] - lo, end[i:j] - lo
        out[i:j] = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
        i = j
    return out


def words(data: np.ndarray, off: np.ndarray, gap: np.ndarray = SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, start and end of each word."""
    start, end, row = word_spans(data, off, gap)
    return span_hashes(lowered(data) if lower else data, start, end), row, start, end


_STEP = mix(np.arange(101, 165, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of n consecutive word hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    size = len(h) - n + 1
    total = np.zeros(size, np.uint64)
    for k in range(n):
        total += h[k : k + size] * _STEP[k]
    return mix(total)


def row_bounds(row: np.ndarray, n: int) -> np.ndarray:
    """For sorted row numbers: where each of n rows starts, and the end."""
    return np.searchsorted(row, np.arange(n + 1))
