"""Inputs that every operator has to cope with."""

from __future__ import annotations

from pyspark.sql import functions as F

# Extra columns whose names operators use for themselves, or that differ from real ones by case only.
CLASHING = ["TEXT", "sha", "n", "node", "fp", "key", "bucket", "copy", "page", "host", "id", "spans", "print", "part", "copies"]


def clashing(df):
    """The same rows with extra columns in front of and behind the real ones."""
    extra = [F.lit("x").alias(name) for name in CLASHING]
    return df.select(*extra[:7], "*", *extra[7:])


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names or df.columns) for r in df.collect()), key=repr)
