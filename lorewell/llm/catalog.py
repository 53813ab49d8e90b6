"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorewell.llm.base import table
from lorewell.llm.cotraining import op8_cotraining
from lorewell.llm.decontaminate import op7_decontamination
from lorewell.llm.langid import op10_langid
from lorewell.llm.licenses import op4_license_scan
from lorewell.llm.linedup import OP9_SQL, op9_line_spread
from lorewell.llm.mixing import OP6_SQL, op6_poisson_mix
from lorewell.llm.quality_rules import op5_quality_rules
from lorewell.llm.sharding import op2_hilbert_shards
from lorewell.llm.simhash import op3_simhash
from lorewell.llm.toxicity import op1_toxicity


def _over(op: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(*[table(spark, sf_dir, t) for t in tables])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": _over(op1_toxicity, "documents", "labels"),
    "op2_hilbert_shards": _over(op2_hilbert_shards, "documents"),
    "op3_simhash": _over(op3_simhash, "documents"),
    "op4_license_scan": _over(op4_license_scan, "documents"),
    "op5_quality_rules": _over(op5_quality_rules, "documents", "labels"),
    "op6_poisson_mix": _over(op6_poisson_mix, "documents"),
    "op7_decontamination": _over(op7_decontamination, "documents", "benchmark"),
    "op8_cotraining": _over(op8_cotraining, "documents", "labels"),
    "op9_line_spread": _over(op9_line_spread, "documents"),
    "op10_langid": _over(op10_langid, "documents"),
}

#: The other operators have no SQL form (XXH64, CRC-32, trained models, alignment); tests compare them with brute force.
ORACLE_SQL: dict[str, str] = {"op6_poisson_mix": OP6_SQL, "op9_line_spread": OP9_SQL}
