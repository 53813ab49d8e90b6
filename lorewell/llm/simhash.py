r"""Operator 3, SimHash near-duplicate detection with bit-sliced comparison.

Two settings of one operator:

* `contract_fingerprints` + `bands` blocking: 64 bits over 3-word shingles hashed by XXH64, radius 2.
  Two fingerprints within 2 bits agree on at least two of four 16-bit bands, so blocks are keyed by
  the six band pairs and no link can be missed.  A block above `hot` members is dealt out again by
  thirds of its other bits (within 2 differing bits one third agrees), twice if need be; a block then
  holds at most 2^14 distinct fingerprints by construction.
* `wide_fingerprints` + `anchors` blocking, for the pipeline: 256 bits over the set of 5-word
  shingles.  Blocks are keyed by each of `ANCHORS` independent minimum shingle hashes; texts of
  similarity 0.8 miss all of them with probability 0.2^6.  Blocks are compared whole whatever their
  size.  The fingerprints, within a radius of over five standard errors beyond the mean distance at 0.8, only
  say which texts are candidates: their shingle sets are then made again, and two texts are linked
  if and only if the sets' Jaccard similarity is 0.8 or more.  A chain of candidates is compared in
  one task, or beyond `HELD` shingles in pieces that meet two by two.

Blocks of the last level above `tile` members are cut in pieces that meet two by two, so that no task
holds more than two pieces and all members are still compared.

Equal fingerprints (pipeline: equal shingle sets) are one node from the start (map-side minimum), so
copies cost nothing.  In each
block bitslice.connect() compares all members and returns one link per member (its chain's least
member), never all pairs; components() joins the links.  Only (id, fingerprint) rows are shuffled.

Results: a null text counts as an empty one; a text without words has fingerprint zero and is linked
like any other.  Rows with a null doc_id get a fingerprint and a null component.  Repeated rows get
equal results.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewell.llm.base import FEW_IDS, LOWER, SPACE, add_columns, buffers, grams, matched, materialise, mix, row_blocks, row_bounds, ship, words
from lorewell.llm.bitslice import connect
from lorewell.llm.components import components

ANCHORS = 6
#: Differing bits of candidates.  Sets of similarity 0.8 differ in 39 bits on average (48 for 4 of 5
#: shingles), standard deviation 6; sets of similarity 0.4 in 78, unrelated ones in 128.
RADIUS_NEAR = 72
HOT = 4096
#: Members of a last-level block that one task compares at a time (twice as many: two pieces).
TILE = 1 << 14
#: Shingles of the candidates that one task compares exactly at a time (twice as many: two pieces).
HELD = 1 << 20
PIECE = 1 << 16


# ---------------------------------------------------------------- fingerprints

def _majority(count: np.ndarray, n: int) -> np.ndarray:
    return np.packbits(count * 2 > n, bitorder="little").view(np.uint64)


def contract_fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of lower-cased (A-Z) whitespace words, shingles hashed by XXH64 with seed 42."""
    data = np.frombuffer(text, np.uint8)
    space = SPACE[data]
    low = LOWER[data]
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]  # one gap between words
    low[space] = 32
    line = low[keep].tobytes().strip(b" ")
    if not line:
        return 0
    gap = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    start, end = np.r_[0, gap + 1], np.r_[gap, len(line)]
    if len(start) > shingle:
        start, end = start[: len(start) - shingle + 1], end[shingle - 1 :]
    else:
        start, end = start[:1], end[-1:]
    h, count = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for lo in range(0, len(start), PIECE):
        got = np.array([h(line[a:b], 42) for a, b in zip(start[lo : lo + PIECE].tolist(), end[lo : lo + PIECE].tolist())], np.uint64)
        count += np.unpackbits(got.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(_majority(count, len(start))[0])


def contract_fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """docs[keep] with fp, the 64-bit fingerprint as a signed long."""

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        data, off = buffers(b.column(b.schema.get_field_index("text")))
        fp = [contract_fingerprint(data[off[i] : off[i + 1]].tobytes()) for i in range(len(off) - 1)]
        return [pa.array(np.array(fp, np.uint64).view(np.int64))]

    return add_columns(docs, make, [("fp", T.LongType())], keep)


_SEEDS = mix(np.arange(1, 33, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))


def shingle_sets(data: np.ndarray, off: np.ndarray, shingle: int = 5) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text; a shorter text is one shingle, one without words has none."""
    n = len(off) - 1
    h, row, _, _ = words(data, off)
    at = row_bounds(row, n)
    whole = grams(h, shingle)
    out = [np.zeros(0, np.uint64)] * n
    for i in np.flatnonzero(np.diff(at)):
        a, z = at[i], at[i + 1]
        out[i] = np.unique(whole[a : z - shingle + 1] if z - a >= shingle else grams(h[a:z], int(z - a)))
    return out


def wide_fingerprint_rows(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, 4) uint64 fingerprints, (rows, ANCHORS) minimum shingle hashes and (rows, 2) digests of the sets; empty: all zero."""
    n = len(sets)
    fps, least, same = np.zeros((n, 4), np.uint64), np.zeros((n, ANCHORS), np.uint64), np.zeros((n, 2), np.uint64)
    for i, g in enumerate(sets):
        if not len(g):
            continue
        count = np.zeros((4, 64), np.int64)
        low = np.full(ANCHORS, np.uint64(0xFFFFFFFFFFFFFFFF))
        for lo in range(0, len(g), PIECE):
            s = g[lo : lo + PIECE]
            for k in range(4):
                count[k] += np.unpackbits(mix(s ^ _SEEDS[k]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            for k in range(ANCHORS):
                low[k] = min(low[k], mix(s ^ _SEEDS[4 + k]).min())
            for k in range(2):
                same[i, k] += mix(s ^ _SEEDS[30 + k]).sum(dtype=np.uint64)
        fps[i] = _majority(count.ravel(), len(g))
        least[i] = low
    return fps, least, same


def wide_fingerprints(docs: DataFrame, keep: list[str], sets: bool = False) -> DataFrame:
    """docs[keep] with fp (256 bits, binary), same (digest of the shingle set), many (its size), and anchors or the set itself (longs)."""

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        data, off = buffers(b.column(b.schema.get_field_index("text")))
        fp: list[bytes] = []
        same: list[bytes] = []
        many: list[int] = []
        longs: list[np.ndarray] = []
        for lo, hi in row_blocks(off):
            own = shingle_sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            f, a, d = wide_fingerprint_rows(own)
            fp += [x.tobytes() for x in f]
            same += [x.tobytes() for x in d]
            many += [len(x) for x in own]
            longs += own if sets else list(a)
        edge = np.cumsum([0, *map(len, longs)], dtype=np.int32)
        flat = np.concatenate(longs).view(np.int64) if longs else np.zeros(0, np.int64)
        return [pa.array(fp, pa.binary()), pa.array(same, pa.binary()), pa.array(many, pa.int32()), pa.ListArray.from_arrays(edge, pa.array(flat))]

    new = [("fp", T.BinaryType()), ("same", T.BinaryType()), ("many", T.IntegerType()), ("shingles" if sets else "anchors", T.ArrayType(T.LongType()))]
    return add_columns(docs, make, new, keep)


# ---------------------------------------------------------------- blocks

def _bits(fp: Column, low: int, high: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND((1 << (high - low)) - 1)


def _part(level: int, key: list[Column]) -> Column:
    return F.xxhash64(F.lit(level), *key)


BANDS = [(0, 16), (16, 32), (32, 48), (48, 64)]


def _thirds(low: int, high: int) -> list[tuple[int, int]]:
    cut = [low + (high - low) * k // 3 for k in range(4)]
    return list(zip(cut[:-1], cut[1:], strict=True))


def _band_keys() -> list[list[Column]]:
    """Keys by level: six band pairs; three refinements of each; three of each of those."""
    fp, levels = F.col("fp"), [[], [], []]
    for i in range(4):
        for j in range(i + 1, 4):
            base = [F.lit(i * 4 + j), _bits(fp, *BANDS[i]), _bits(fp, *BANDS[j])]
            levels[0].append(_part(0, base))
            rest = [b for k, b in enumerate(BANDS) if k not in (i, j)]
            # thirds of the 32 other bits, as pieces of the two bands that hold them
            pieces = [[(rest[0][0], rest[0][0] + 11)], [(rest[0][0] + 11, rest[0][1]), (rest[1][0], rest[1][0] + 5)], [(rest[1][0] + 5, rest[1][1])]]
            for k, piece in enumerate(pieces):
                one = [*base, F.lit(k), *[_bits(fp, *p) for p in piece]]
                levels[1].append(_part(1, one))
                left = [p for m, x in enumerate(pieces) if m != k for p in x]
                if len(left) == 2:
                    a, z = left[1]
                    left = [left[0], (a, (a + z) // 2), ((a + z) // 2, z)]
                levels[2] += [_part(2, [*one, F.lit(m), _bits(fp, *x)]) for m, x in enumerate(left)]
    return levels


def _anchor_keys() -> list[list[Column]]:
    """One level of keys, each minimum: a finer key would lose pairs that share one minimum only."""
    return [[_part(0, [F.lit(i), F.col("anchors")[i]]) for i in range(ANCHORS)]]


def _tiles(tile: int) -> Column:
    """Keys of a member of a block of n: the block's, or beyond `tile` those of its piece with every piece."""
    pieces = F.ceil(F.col("n") / tile).cast("int")
    own = F.pmod(F.xxhash64("node"), pieces).cast("int")
    met = F.transform(F.sequence(F.lit(0), pieces - 1), lambda j: F.xxhash64(F.lit(3), F.col("key"), F.least(own, j), F.greatest(own, j)))
    return F.when(F.col("n") > tile, met).otherwise(F.array("key"))


def _blocks(nodes: DataFrame, levels: list[list[Column]], hot: int, tile: int = TILE) -> DataFrame:
    """(node, fp, key) rows of all blocks of two or more nodes.

    Block sizes come from an aggregation with map-side partial counts; single-member blocks, nearly
    all of them, go at once.  Blocks above `hot` are replaced by their refinements, whose keys are
    made for the rows of such blocks only; key number p of a level refines key p // fan of the one
    above.  Blocks of the last level are cut in tiles.
    """
    carry = ["node", "fp"]
    level = nodes.select(*carry, F.posexplode(F.array(*levels[0])).alias("pos", "key"))
    out = None
    for step in range(len(levels)):
        sizes = level.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        met = level.join(sizes, "key")
        ready = met.select("node", "fp", F.explode(_tiles(tile)).alias("key")) if step == len(levels) - 1 else met.where(F.col("n") <= hot).select("node", "fp", "key")
        out = ready if out is None else out.unionByName(ready)
        if step == len(levels) - 1:
            break
        over = met.where(F.col("n") > hot)
        if over.limit(1).isEmpty():
            break
        fan = len(levels[step + 1]) // len(levels[step])
        made = F.slice(F.array(*levels[step + 1]), F.col("pos") * fan + 1, fan)
        finer = over.select(*carry, F.col("pos").alias("was"), F.posexplode(made).alias("p", "key")).select(*carry, (F.col("was") * fan + F.col("p")).cast("int").alias("pos"), "key")
        level = materialise(finer.groupBy("node", "key").agg(*[F.first(c).alias(c) for c in [*carry[1:], "pos"]]).select(*carry, "pos", "key"))
    return out


def _links(blocks: DataFrame, joined: Callable[[list[pa.RecordBatch]], pa.RecordBatch]) -> DataFrame:
    """One link (a, b) per member and block: to the least member that it reaches there, by joined() of whole blocks."""
    ship(blocks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(2).to_numpy()
            if held and key[0] == key[-1]:
                last = held[-1].column(2)
                if last[len(last) - 1].as_py() == key[0]:
                    held.append(b)
                    continue
            cut = int(np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[-1])  # the last key may go on
            if cut:
                yield joined([*held, b.slice(0, cut)])
                held = [b.slice(cut)]
            else:
                if held:
                    yield joined(held)
                held = [b]
        if held:
            yield joined(held)

    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.repartition(n, "key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(run, "a long, b long")


def _connected(parts: list[pa.RecordBatch], width: int, radius: int) -> pa.RecordBatch:
    t = pa.Table.from_batches(parts)
    node, key = t.column(0).to_numpy(), t.column(2).to_numpy()
    if width == 1:
        fps = t.column(1).to_numpy().view(np.uint64).reshape(-1, 1)
    else:
        fps = np.frombuffer(b"".join(t.column(1).to_pylist()), np.uint64).reshape(-1, width)
    label = connect(fps, key, radius)
    far = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(node[label[far]])], names=["a", "b"])


#: Sets that link_exactly() meets with one set at a time, after the nearest.
MET = 1 << 14


def link_exactly(fps: np.ndarray, sets: list[np.ndarray], radius: int) -> np.ndarray:
    """Label of each text: the least index that chains of pairs of similarity 0.8 reach.

    Every two texts within the radius are compared unless a chain joins them already.  A set is marked in a table over all
    shingles of the block, so that its common shingles with any others are counted at a few nanoseconds each; the
    nearest text comes first, as a link to it mostly settles the others.
    """
    label = np.arange(len(sets))
    size = np.array([len(x) for x in sets], np.int64)
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    edge = np.r_[0, np.cumsum(size)]
    mark = np.zeros(int(flat.max()) + 1 if len(flat) else 1, np.uint8)

    def in_common(others: np.ndarray) -> np.ndarray:
        n, top = size[others], int(others.max()) + 1
        if 4 * int(n.sum()) > edge[top]:  # most of them: count in all sets up to there
            hit = np.zeros(edge[top] + 1, np.uint8)
            mark.take(flat[: edge[top]], mode="clip", out=hit[:-1])
            return np.where(n > 0, np.add.reduceat(hit, edge[:top], dtype=np.int32)[others], 0)
        first = np.cumsum(n) - n
        at = np.repeat(edge[others] - first, n) + np.arange(int(n.sum()))
        total = np.r_[0, np.cumsum(mark[flat[at]], dtype=np.int64)]
        return total[first + n] - total[first]

    for i in range(1, len(sets)):
        gap = np.bitwise_count(fps[:i] ^ fps[i]).sum(1, dtype=np.int64)
        near = np.flatnonzero((gap <= radius) & (label[:i] != label[i]) & (5 * np.minimum(size[:i], size[i]) >= 4 * np.maximum(size[:i], size[i])))
        if not len(near):
            continue
        k = int(gap[near].argmin())
        near[[0, k]] = near[[k, 0]]
        mark[flat[edge[i] : edge[i + 1]]] = 1
        step = 1
        while len(near):
            met, near = near[:step], near[step:]
            linked = met[9 * in_common(met) >= 4 * (size[met] + size[i])]  # a Jaccard similarity of 0.8 in whole numbers
            if len(linked):
                own = np.unique(np.r_[label[linked], label[i]])
                label[np.isin(label, own)] = own[0]
                near = near[label[near] != label[i]]
            step = MET
        mark[flat[edge[i] : edge[i + 1]]] = 0
    return label


def _exactly(parts: list[pa.RecordBatch], radius: int) -> pa.RecordBatch:
    t = pa.Table.from_batches(parts)
    node, key = t.column(0).to_numpy(), t.column(2).to_numpy()
    fps = np.frombuffer(b"".join(t.column(1).to_pylist()), np.uint64).reshape(-1, 4)
    sets = [x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in t.column(3)]
    label = np.arange(len(node))
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    for a, z in zip(edge[:-1], edge[1:], strict=True):
        label[a:z] = a + link_exactly(fps[a:z], sets[a:z], radius)
    far = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(node[label[far]])], names=["a", "b"])


def groups(prints: DataFrame, radius: int, hot: int = HOT, tile: int = TILE) -> DataFrame:
    """(fp, node, component): prints has (doc_id, fp); node is the least doc_id of the fingerprint."""
    nodes = materialise(prints.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("node")))
    linked = components(_links(_blocks(nodes, _band_keys(), hot, tile), lambda parts: _connected(parts, 1, radius)))
    return nodes.join(linked, "node", "left").select("fp", "node", F.coalesce("component", "node").alias("component"))


def near_duplicates(docs: DataFrame, hot: int = HOT, tile: int = TILE) -> DataFrame:
    """doc_id, fp and component_id of every row: the contract's setting."""
    prints = materialise(contract_fingerprints(docs.select("doc_id", "text"), ["doc_id"]))
    found = groups(prints, 2, hot, tile)
    return prints.join(found, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def similar_documents(docs: DataFrame, radius: int = RADIUS_NEAR, hot: int = TILE, held: int = HELD, few: int = FEW_IDS) -> DataFrame:
    """doc_id and component_id over 5-word shingle sets of a Jaccard similarity of 0.8 or more; blocks above `hot` are cut in tiles."""
    texts = docs.select("doc_id", "text")
    prints = materialise(wide_fingerprints(texts, ["doc_id"]))
    first = [F.first(c).alias(c) for c in ("fp", "many", "anchors")]  # equal within a digest
    nodes = materialise(prints.where(F.col("doc_id").isNotNull()).groupBy("same").agg(F.min("doc_id").alias("node"), *first))
    near = components(_links(_blocks(nodes, _anchor_keys(), hot, hot), lambda parts: _connected(parts, 4, radius)))
    chains = near.join(nodes.select("node", "same", "many"), "node").withColumnRenamed("component", "key")
    sizes = chains.groupBy("key").agg(F.sum("many").alias("n"))
    wanted = materialise(chains.join(sizes, "key").select("node", F.col("same").alias("wanted"), _tiles(held).alias("keys")))
    own = matched(texts, F.col("doc_id"), wanted.select("node"), "left_semi", few)  # so that no other text moves
    again = wide_fingerprints(own.join(wanted, F.col("doc_id") == F.col("node")), ["node", "wanted", "keys"], sets=True)
    sets = materialise(again.where("same = wanted").dropDuplicates(["node", "same"]))
    pairs = sets.select("node", "fp", F.explode("keys").alias("key"), "shingles")
    linked = components(_links(pairs, lambda parts: _exactly(parts, radius)))
    found = nodes.join(linked, "node", "left").select("same", F.coalesce("component", "node").alias("component"))
    return prints.select("doc_id", "fp", "same").join(found, "same", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS_NEAR, few: int = FEW_IDS) -> DataFrame:
    """docs with one document of each group: the least doc_id; rows without a doc_id stay.

    Of several rows with the doc_id that stays, the first in the order of their JSON form stays; only
    those rows are shuffled for it.
    """
    found = materialise(similar_documents(docs, radius, few=few))
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count(F.lit(1)).alias("n"))
    ids = materialise(ids.where("doc_id <> c or n > 1"))
    gone, twice = ids.where("doc_id <> c").select("doc_id"), ids.where("doc_id = c").select("doc_id")
    kept = matched(docs, F.col("doc_id"), gone, "left_anti", few)
    if twice.limit(1).isEmpty():
        return kept
    several = matched(kept, F.col("doc_id"), twice, "left_semi", few)
    packed = several.select("doc_id", F.struct(*docs.columns).alias("row"))
    one = packed.groupBy("doc_id").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return matched(kept, F.col("doc_id"), twice, "left_anti", few).unionByName(one)


def op3_simhash(docs: DataFrame) -> DataFrame:
    fp = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return near_duplicates(docs).select("doc_id", fp.alias("fingerprint"), "component_id")
