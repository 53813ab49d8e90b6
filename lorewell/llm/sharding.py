"""Operator 2, sharding along a Hilbert curve.

Several metadata dimensions are quantised to `bits` bits each, a row's cell is placed on the Hilbert
curve through that grid, rows are put in curve order, and the order is cut into `shards` runs.  Files
written by (shard, slot) then hold small boxes of the metadata space, so a filter on any of the
dimensions skips most of them by their min/max statistics.

Cut points of a dimension are its distinct values or the quantiles of all rows.  The law is `rows`: shard sizes differ by one row at most.  Positions are exact without a
global sort: curve cells are split by a hash of doc_id into runs of about `run` rows, so a cell that
holds a third of all rows is many runs; row numbers within runs, plus running totals of the run
sizes (cells are bounded by 2^(bits x dimensions)), give each row's place.  Only ids, sizes and
dimensions are shuffled, never texts.

Results: null dimensions and null ids sort first; equal rows get neighbouring slots in either order;
an empty table gives no rows; a column of the input that is named like a result is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.llm.base import materialise


def hilbert(coords: tuple[int, ...], bits: int) -> int:
    """Index of a grid cell on the Hilbert curve (Skilling's transform)."""
    x, n = list(coords), len(coords)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    out = 0
    for b in reversed(range(bits)):
        for v in x:
            out = out << 1 | (v >> b & 1)
    return out


def _cuts(facts: DataFrame, dim: str, bins: int) -> list:
    """At most bins - 1 ascending cut points of all rows: every distinct value if they are few, else quantiles.

    Values are counted first (map-side), then summed up in ranges of values, so that no task sees more than its range;
    `bins` values at most are collected.
    """
    counts = facts.where(F.col(dim).isNotNull()).groupBy(F.col(dim).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts)
    few = counts.limit(bins).collect()
    if len(few) < bins:
        return sorted(r["v"] for r in few)
    ranged = materialise(counts.repartitionByRange("v").withColumn("p", F.spark_partition_id()))
    start, below = {}, 0
    for r in ranged.groupBy("p").agg(F.sum("n").alias("n")).orderBy("p").collect():  # a row for each range
        start[r["p"]], below = below, below + r["n"]
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in start.items() for x in kv]), F.col("p"))
    upto = ranged.withColumn("c", offset + F.sum("n").over(Window.partitionBy("p").orderBy("v")))
    # the k-th cut is the value at place (rows x k) div bins
    last, first = F.ceil(F.col("c") * bins / F.lit(below)) - 1, F.ceil((F.col("c") - F.col("n")) * bins / F.lit(below))
    return sorted(r["v"] for r in upto.where(last >= F.greatest(F.lit(1), first)).select("v").collect())


def _bin(c: Column, cuts: list, bits: int) -> Column:
    """The cell of a value, 0 for null: the cells in use are spread over the whole grid, so that dimensions weigh alike."""
    out = F.lit(0)
    for v in cuts:
        out = out + F.coalesce((c >= F.lit(v)).cast("int"), F.lit(0))
    return F.floor(out * (1 << bits) / F.lit(len(cuts) + 1)).cast("int")


def _on_curve(rows: DataFrame, cuts: list[list], dims: list[str], order: list[str], bits: int, parts: int) -> DataFrame:
    spark = rows.sparkSession
    cells = []
    for code in range(1 << bits * len(dims)):
        at = tuple(code >> bits * k & (1 << bits) - 1 for k in range(len(dims)))
        cells.append((code, hilbert(at, bits)))
    curve = spark.createDataFrame(cells, "__code int, __cell int")
    code = F.lit(0)
    for k, d in enumerate(dims):
        code = code + F.shiftleft(_bin(F.col(d), cuts[k], bits), bits * k)
    placed = rows.withColumn("__code", code).join(F.broadcast(curve), "__code").drop("__code")  # 2^16 rows at most
    return placed.withColumn("__sub", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))


def curve_shards(rows: DataFrame, facts: DataFrame, dims: list[str], order: list[str], shards: int, bits: int = 4, run: int = 50_000) -> DataFrame:
    """rows with curve (Hilbert index), shard and slot.

    facts: the columns dims and order of the same rows, as a stored table; the cuts, the total and
    the run sizes are taken from it, so that rows itself is read and moved once.
    """
    if bits * len(dims) > 16:
        raise ValueError("the grid is bounded to 2^16 cells")
    total = max(1, facts.count())
    cuts = [_cuts(facts, d, 1 << bits) for d in dims]
    parts = -(-total // run)
    w = Window.partitionBy("__cell", "__sub").orderBy(*order)
    numbered = _on_curve(rows, cuts, dims, order, bits, parts).withColumn("__rn", F.row_number().over(w) - 1)
    sizes = _on_curve(facts, cuts, dims, order, bits, parts).groupBy("__cell", "__sub").agg(F.count(F.lit(1)).alias("__n"))
    by_cell = sizes.groupBy("__cell").agg(F.sum("__n").alias("__m"))  # 2^16 rows at most, so one task may total them
    cell_start = by_cell.select("__cell", (F.sum("__m").over(Window.orderBy("__cell")) - F.col("__m")).alias("__c0"))
    sub_start = sizes.select("__cell", "__sub", (F.sum("__n").over(Window.partitionBy("__cell").orderBy("__sub")) - F.col("__n")).alias("__s0"))
    starts = sub_start.join(cell_start, "__cell").select("__cell", "__sub", (F.col("__c0") + F.col("__s0")).alias("__p0"))
    out = numbered.join(starts, ["__cell", "__sub"]).withColumn("__pos", F.col("__p0") + F.col("__rn"))
    out = out.withColumn("shard", F.expr(f"cast(__pos * {shards}L div {total}L as int)"))
    out = out.withColumn("slot", F.expr(f"__pos - (shard * {total}L + {shards - 1}L) div {shards}L"))
    return out.withColumnRenamed("__cell", "curve").drop("__sub", "__rn", "__p0", "__pos")


def _facts(docs: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "*",
        *[F.col(c).alias(f"__d_{c}") for c in dims],
        (F.octet_length(text).cast("long") + 1).alias("__size"),
        F.crc32(text.cast("binary")).alias("__crc"),
    )


ORDER = ["doc_id", "__crc", "__size"]


def assign_shards(docs: DataFrame, shards: int = 16, dims: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, size, text_crc32, curve, shard and slot of every row; the size is the last dimension."""
    rows = materialise(_facts(docs.select("doc_id", "text", *dims), dims).drop("text", *dims))
    out = curve_shards(rows, rows, [f"__d_{c}" for c in dims] + ["__size"], ORDER, shards)
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), "curve", "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = 16, dims: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """docs with curve, shard and slot; every text is moved once, to the task of its run of the curve."""
    names = [c for c in docs.columns if c.lower() not in ("curve", "shard", "slot")]
    full = _facts(docs.select(*names), dims)
    keys = [f"__d_{c}" for c in dims] + ["__size"]
    facts = materialise(full.select(*keys, *[c for c in ORDER if c not in keys]))
    return curve_shards(full, facts, keys, ORDER, shards).select(*names, "curve", "shard", "slot")


def op2_hilbert_shards(docs: DataFrame) -> DataFrame:
    out = assign_shards(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
