"""Operator 6, mixing sources to target weights by Poisson replication.

A source with a share t of the target mixture and C characters gets the mean repetition rate
t x total / C.  Each document's count is the Poisson quantile of its own seeded uniform number (48
bits of an MD5 of seed and doc_id), so counts depend on nothing but the document, the seed and the
rate: recomputed tasks agree, and a rate that rises never removes a copy.  Documents are then
exploded by their counts and sorted globally by a seeded hash of (doc_id, copy).

Each source's quantile table holds the cumulative probabilities that a 48-bit number can tell apart:
some 24 standard deviations of the count, made in one pass, so a rate of a million is a table of
24,000 numbers.  The rates table has one row per source; while its tables are TABLE_BYTES and its rows
BROADCAST_SOURCES at most (both counted) it is broadcast, so that documents are not dealt by source
at all; beyond, it is repeated SALTS times and documents join it by (source, hash of doc_id), so that
a hot source is SALTS tasks.  No task writes more than PIECE copies of one document at a time: where
some source can reach that count, its copies are dealt out in pieces first.  The global order needs no
sampling pass: its key is uniform by construction, so key x partitions is the partition.

Targets: `weights` (source -> weight; a source that is not named gets weight 0 and is left out), or
`alpha`: weights in proportion to characters ^ alpha (1 keeps the mixture, 0 makes sources equal).

Results: a null text has 0 characters but is replicated like any other row of its source; a null
source is a source of its own; a source without any character gets rate 1; a null doc_id counts as
the id "" ; repeated rows get equal counts; columns of any name pass through mix_sources(), while
replicate() replaces those named rate, n_copies and copy_no; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewell.llm.base import add_columns, materialise

NULL_SOURCE = "\x00null"
BROADCAST_SOURCES = 20_000
TABLE_BYTES = 32 << 20
SALTS = 64
PIECE = 4096


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 48 bits from the MD5 of the parts."""
    key = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def quantiles(rate: float) -> tuple[int, np.ndarray]:
    """(k, P(X <= k), P(X <= k + 1), ...) of a Poisson variable: all values that lie strictly between 0 and 1 in 48 bits.

    The count at a uniform number u is k plus how many of the values are u or less.
    """
    first = max(0, int(rate - 12 * rate**0.5 - 40))
    k = np.arange(first, int(np.ceil(rate + 12 * rate**0.5 + 40)) + 1)
    log_factorial = math.lgamma(first + 1) + np.r_[0, np.cumsum(np.log(k[1:]))]
    cum = np.cumsum(np.exp(k * np.log(rate) - rate - log_factorial))
    keep = cum <= 1 - 2.0**-48
    return first, cum[keep]


def rates(docs: DataFrame, size: Column | None = None, alpha: float = 0.5, weights: dict[str, float] | None = None, budget: float = 1.0) -> DataFrame:
    """source_key, rate, first and cdf: one row per source.  size: what targets measure (default: characters); budget: size
    of the mixture, times the input."""
    chars = docs.groupBy(F.coalesce("source", F.lit(NULL_SOURCE)).alias("source_key")).agg(F.sum(F.coalesce(F.length("text") if size is None else size, F.lit(0))).cast("double").alias("chars"))
    if weights is None:
        w = F.when(F.col("chars") > 0, F.pow("chars", F.lit(alpha))).otherwise(0.0)
    else:
        w = F.lit(0.0)
        for k, v in sorted(weights.items()):
            w = F.when(F.col("source_key") == k, F.lit(float(v))).otherwise(w)
    weighed = chars.withColumn("w", w)
    sums = weighed.agg(F.sum("w").alias("sw"), F.sum("chars").alias("sc"))  # one row
    rate = F.when(F.col("chars") > 0, F.lit(budget) * F.col("w") / F.col("sw") * F.col("sc") / F.col("chars")).otherwise(1.0)
    out = weighed.crossJoin(F.broadcast(sums)).select("source_key", F.coalesce(rate, F.lit(0.0)).alias("rate"))

    def tables(b: pa.RecordBatch) -> list[pa.Array]:
        got = [quantiles(r) if r > 0 else (0, None) for r in b.column(1).to_pylist()]
        return [pa.array([f for f, _ in got], pa.int64()), pa.array([None if c is None else c.tolist() for _, c in got], pa.list_(pa.float64()))]

    return add_columns(out, tables, [("first", T.LongType()), ("cdf", T.ArrayType(T.DoubleType()))])


def _exploded(packed: DataFrame, r: DataFrame, seed: int) -> DataFrame:
    """packed (row, id, source_key) with rate, n_copies and copy_no: one row per copy."""
    facts = r.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("cdf")), F.lit(0)).alias("cells"), F.max(F.col("first") + F.size("cdf")).alias("most")).first()
    if facts["n"] <= BROADCAST_SOURCES and facts["cells"] * 8 <= TABLE_BYTES:
        joined = packed.join(F.broadcast(r), "source_key")
    else:
        salted = packed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        joined = salted.join(r.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["source_key", "salt"])
    counted = joined.where("cdf is not null").withColumn("u", uniform(F.lit(seed), F.col("id")))
    some = counted.withColumn("n_copies", F.expr("cast(first + size(filter(cdf, c -> c <= u)) as int)")).where("n_copies > 0").select("row", "id", "rate", "n_copies")
    if (facts["most"] or 0) <= PIECE:
        return some.select("*", F.explode(F.expr("sequence(1, n_copies)")).alias("copy_no"))
    pieces = some.withColumn("piece", F.explode(F.expr(f"sequence(0, (n_copies - 1) div {PIECE})"))).repartition("id", "piece")
    return pieces.select("row", "id", "rate", "n_copies", F.explode(F.expr(f"sequence(cast(piece * {PIECE} + 1 as int), cast(least(n_copies, (piece + 1) * {PIECE}) as int))")).alias("copy_no"))


def _copies(docs: DataFrame, names: list[str], seed: int, target: dict) -> DataFrame:
    packed = docs.select(F.struct(*names).alias("row"), F.col("doc_id").alias("id"), F.coalesce("source", F.lit(NULL_SOURCE)).alias("source_key"))
    return _exploded(packed, materialise(rates(docs, **target)), seed)


def replicate(docs: DataFrame, seed: int = 13, **target: object) -> DataFrame:
    """docs with rate, n_copies and copy_no: one row per copy; documents of count 0 are gone."""
    names = [c for c in docs.columns if c.lower() not in ("rate", "n_copies", "copy_no")]
    return _copies(docs, names, seed, target).select("row.*", "rate", "n_copies", "copy_no")


def _in_order(copies: DataFrame, seed: int, doc_id: str) -> DataFrame:
    """Rows with a column doc_id and copy_no, by shuffle_key: partition k of n has the keys from k / n to (k + 1) / n."""
    n = int(copies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = copies.withColumn("shuffle_key", uniform(F.lit(seed + 1), F.col(doc_id), F.col("copy_no")))
    return keyed.repartitionById(n, F.floor(F.col("shuffle_key") * n).cast("int")).sortWithinPartitions("shuffle_key", doc_id, "copy_no")


def shuffled(copies: DataFrame, seed: int = 13) -> DataFrame:
    """All copies in the order of a seeded hash of (doc_id, copy_no), with shuffle_key."""
    return _in_order(copies, seed, "doc_id")


def mix_sources(docs: DataFrame, seed: int = 13, **target: object) -> DataFrame:
    """docs replicated to the target mixture, in global random order, with the columns of docs."""
    return _in_order(_copies(docs, docs.columns, seed, target), seed, "id").select("row.*")


def op6_poisson_mix(docs: DataFrame) -> DataFrame:
    sized = docs.select("doc_id", "source", F.length("text").alias("chars"))
    out = shuffled(replicate(sized, size=F.col("chars")))
    return out.select("doc_id", "source", "chars", F.round("rate", 9).alias("rate"), "n_copies", "copy_no", F.round("shuffle_key", 9).alias("shuffle_key"))


_MIX = """
with d as (select doc_id, source, text, coalesce(source, chr(0) || 'null') as source_key from {docs}),
s as (select source_key, sum(coalesce(length(text), 0))::double as chars from d group by 1),
w as (select *, case when chars > 0 then pow(chars, 0.5) else 0 end as w from s),
r as (select source_key, case when chars > 0 then w / (select sum(w) from w) * (select sum(chars) from w) / chars else 1 end as rate from w),
k as (select source_key, rate, unnest(range(0, cast(ceil(rate + 12 * sqrt(rate) + 40) as bigint) + 1)) as k from r),
p as (select source_key, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) over (partition by source_key order by k) as cum from k),
u as (select d.*, ('0x' || substr(md5('13:' || coalesce(doc_id::varchar, '')), 1, 12))::bigint / 281474976710656.0 as u from d),
b as (select source_key, rate, list(cum order by k) as cdf from p group by 1, 2),
c as (select u.*, b.rate, len(list_filter(b.cdf, lambda x: x <= u.u)) as n_copies from u join b using (source_key)),
e as (select *, unnest(range(1, n_copies + 1)) as copy_no from c)
"""
OP6_SQL = _MIX.format(docs="documents") + """
select doc_id, source, length(text)::int as chars, round(rate, 9) as rate, n_copies::int as n_copies, copy_no::int as copy_no,
  round(('0x' || substr(md5('14:' || coalesce(doc_id::varchar, '') || ':' || copy_no), 1, 12))::bigint / 281474976710656.0, 9) as shuffle_key
from e"""
