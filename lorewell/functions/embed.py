"""Vectors: a hashing embedder and exact similarity, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorewell.functions.text import col, text_or_empty


def token_dim(token: Column, dim: int) -> Column:
    """Bucket of a token: the first 32 bits of its MD5, modulo dim."""
    return F.pmod(F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")


def words(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit("([a-z0-9]+)"), F.lit(1))


def hash_embed(c: Column | str, dim: int = 384) -> Column:
    """L2-normalised token counts by bucket; an empty text gives zeros."""
    dims = F.transform(words(c), lambda t: token_dim(t, dim))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.size(F.filter(dims, lambda d: d == k)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(counts, lambda x: F.when(norm > 0, x / norm).otherwise(0.0).cast("float"))


def dot(a: Column | str, b: Column | str) -> Column:
    pairs = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
