"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; between
stages the rows are written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm import decontaminate, langid, mixing, sharding, simhash
from lorewell.llm.base import forget, materialise, scratch, table

#: Texts of at least this many characters whose best language explains hardly two characters at a time are in no known language.
UNKNOWN_CHARS, UNKNOWN_RATE = 40, 0.85


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter (`und`) and longer texts that no learned language explains.

    Null and empty texts are dropped; repeated rows meet the same fate; without any labelled row every
    row is `und`, so nothing stays; an empty table stays empty; columns of any name pass through.
    """
    names = docs.columns
    clash = {"lang_pred", "score", "phrase_rate"}
    own = [F.col(c).alias(f"__c{k}") if c.lower() in clash else F.col(c) for k, c in enumerate(names)]
    back = [F.col(f"__c{k}").alias(c) if c.lower() in clash else F.col(c) for k, c in enumerate(names)]
    seen = langid.identify(docs.select(*own), langid.fit(docs))
    unknown = (F.length("text") >= UNKNOWN_CHARS) & (F.col("phrase_rate") > UNKNOWN_RATE)
    return seen.where((F.col("lang_pred") != langid.UND) & ~unknown).select(*back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (5-word shingles, Jaccard similarity 0.8): the least doc_id.

    Null and empty texts are alike, so one of them stays; of several rows with the doc_id that stays, the first in the
    order of their columns stays; rows with a null doc_id all stay; an empty table stays empty; columns of any name pass through.
    """
    return simhash.drop_near_duplicates(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark.

    Null and empty texts and items touch nothing; repeated rows meet the same fate, rows with a null doc_id
    by their text; without items everything stays; an empty table stays empty; columns of any name pass through.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicates documents to the target weights of their sources, in global random order.

    A null text has no characters, a null source is a source of its own, a null doc_id counts as ""; repeated rows
    get equal counts; equal shuffle keys are ordered by doc_id and copy; an empty table stays empty; columns of any name pass through.
    """
    return mixing.mix_sources(docs)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds curve, shard and slot (columns of the input with these names are replaced).

    Nulls of any dimension sort first; equal rows get neighbouring slots; an empty table stays empty.
    """
    return sharding.shard_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
    ("sharding", cut_shards),
]

#: No SQL form: stages 1 to 3 are a trained model, SimHash and an alignment.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; what a stage stored for itself, and its input, are deleted once its output is stored."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch() as made:
            out = materialise(stage(spark, docs, sf_dir))
        for t in [*made, docs]:
            if t is not out:
                forget(t)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
