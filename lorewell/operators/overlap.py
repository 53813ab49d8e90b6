"""Containment of token sets within groups: every set against all sets of its group, exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.plans.tables import stored

#: Tokens of a block of sets: what a task holds in memory, some 50 bytes each while it is indexed.
BLOCK = 12_000_000
#: Tokens of candidates that are looked up at once.
PIECE = 2_000_000
PAIR = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("hits", pa.int32()), ("n", pa.int32())])


def _runs(first: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions of runs of some lengths that begin at `first`, one run after the other."""
    end = np.cumsum(lens)
    return np.repeat(first - end + lens, lens) + np.arange(end[-1])


class Index:
    """The sets of a block by token and by set."""

    def __init__(self, ids: np.ndarray, lens: np.ndarray, tokens: np.ndarray) -> None:
        self.ids, self.lens, self.first = ids, lens, np.r_[0, np.cumsum(lens)]
        order = np.argsort(tokens, kind="stable")
        tokens = tokens[order]
        at = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        self.vocabulary, self.start = tokens[at], np.r_[at, len(tokens)]
        self.postings = np.repeat(np.arange(len(ids), dtype=np.int32), lens)[order]
        self.own = np.empty(len(tokens), np.int32)  # the place in the vocabulary of each token of each set
        self.own[order] = np.repeat(np.arange(len(at), dtype=np.int32), np.diff(self.start))
        self.flag = np.zeros(len(at), bool)

    def _hits(self, some: np.ndarray) -> np.ndarray:
        """How many flagged tokens each of some sets has."""
        lens = self.lens[some]
        return np.add.reduceat(self.flag[self.own[_runs(self.first[some], lens)]].view(np.int8), np.cumsum(lens) - lens, dtype=np.int32)

    def search(self, queries: np.ndarray, first: np.ndarray, tokens: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
        """Sets that hold at least the share `least` of a query's tokens.

        A query of n tokens that must share m of them misses n - m at most, those that the block does not know included: of any
        n - m + k of its tokens, a match has k.  The rarest of the block are taken, so only their postings are read; who
        has k of them is compared in full.
        """
        place = np.minimum(np.searchsorted(self.vocabulary, tokens), len(self.vocabulary) - 1)
        known = self.vocabulary[place] == tokens
        frequency = np.diff(self.start)
        out: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for q, a, z in zip(queries, first[:-1], first[1:], strict=True):
            mine = place[a:z][known[a:z]]
            n, m = z - a, max(1, math.ceil(least * (z - a) - 1e-9))
            if len(mine) < m:
                continue
            k = min(m, 1 + len(mine) // 6)
            rare = mine[np.argsort(frequency[mine])[: len(mine) - m + k]]
            seen = np.bincount(self.postings[_runs(self.start[rare], frequency[rare])])
            some = np.flatnonzero(seen >= k)
            some = some[(self.lens[some] >= m) & (self.ids[some] != q)]
            if not len(some):
                continue
            self.flag[mine] = True
            cuts = np.flatnonzero(np.diff(np.cumsum(self.lens[some]) // PIECE)) + 1
            hits = np.concatenate([self._hits(s) for s in np.split(some, cuts)])
            self.flag[mine] = False
            ok = hits >= m
            if ok.any():
                out.append((np.full(ok.sum(), q), self.ids[some[ok]], hits[ok], np.full(ok.sum(), n, np.int32)))
                rows += ok.sum()
            if rows > 50_000:
                yield _pairs(out)
                out, rows = [], 0
        if out:
            yield _pairs(out)


def _pairs(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*found, strict=True), PAIR.types, strict=True)], schema=PAIR)


def _lists(c: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and values of a list column."""
    at = c.offsets.to_numpy()
    return at - at[0], c.values.slice(at[0], at[-1] - at[0]).to_numpy()


def contained(docs: DataFrame, id_col: str, key: str, tokens: Column, least: float, block: int = BLOCK) -> DataFrame:
    """query_id, id, hits, n: pairs of rows of one key where the second has at least the share `least` of the n tokens of the first.

    tokens: array<long> of distinct token hashes.  The sets of a key are cut in counted blocks of about `block` tokens. A task holds one block
    and its index, all sets of the key pass by, so its memory is bounded; each set moves once and once for each block of its key.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(key).alias("key"), tokens.alias("t"))
    own = stored(own.where("id is not null and key is not null and size(t) > 0"))
    sizes = own.groupBy("key").agg(F.ceil(F.sum(F.size("t")) / block).cast("int").alias("parts"))
    tiles = sizes.agg(F.sum("parts")).first()[0] or 1
    cut = sizes.where("parts > 1")  # as many rows at most as there are blocks
    own = own.join(F.broadcast(cut), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    held = own.select("key", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("side"), "id", "t")
    asked = own.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("side"), "id", "t")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(4 * int(tiles), 4096))
    dealt = held.unionByName(asked).repartition(n, "key", "part").sortWithinPartitions("key", "part", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, kept, index = None, [], None
        for b in batches:
            keys, parts, sides, ids = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            at, values = _lists(b.column(4))
            new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1]) | (sides[1:] != sides[:-1])])
            for a, z in zip(new, [*new[1:], b.num_rows], strict=True):
                if (keys[a], parts[a]) != tile:
                    tile, kept, index = (keys[a], parts[a]), [], None
                some = values[at[a] : at[z]]
                if sides[a] == 0:
                    kept.append((ids[a:z].copy(), np.diff(at[a : z + 1]), some.copy()))
                    continue
                if index is None and kept:
                    index = Index(*[np.concatenate(x) for x in zip(*kept, strict=True)])
                    kept = []
                if index is not None:
                    yield from index.search(ids[a:z], at[a : z + 1] - at[a], some, least)

    return dealt.mapInArrow(run, "query_id long, id long, hits int, n int")
