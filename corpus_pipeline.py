"""From raw documents to packed sequences: quality, copies, near copies, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import stages
from factloom.llm.common import read
from factloom.session import materialise

STAGES = [
    ("quality classifier", stages.keep_good),
    ("exact dedup", stages.drop_copies),
    ("MinHash near-dedup", stages.drop_near_copies),
    ("suffix-array dedup", stages.cut_repeats),
    ("packing", stages.pack),
]

# A trained network, hashing and packing have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
