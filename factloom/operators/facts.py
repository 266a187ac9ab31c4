"""Fact listings: projection, module lookup, recent facts, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import json_list
from factloom.operators.search import attach_facts
from factloom.operators.skew import BROADCAST_ROWS, key_lookup
from factloom.sources.schemas import CATEGORIES, FACT_SOURCES


def project(facts: DataFrame) -> DataFrame:
    """Facts with list columns as arrays, whether stored as JSON text or as arrays."""
    kinds = dict(facts.dtypes)
    decoded = {
        name: json_list(F.col(name)) if kinds[name] == "string" else F.coalesce(F.col(name), json_list(F.lit(None)))
        for name in ("source_files", "symbols")
        if name in kinds
    }
    return facts.withColumns(decoded)


def module_facts(facts: DataFrame, module_id: str) -> DataFrame:
    """All facts of one module, also those without an analysis and in any repo."""
    found = facts.where(F.col("pr_id") == module_id)
    return found.orderBy("category", F.desc("confidence"), "fact_id")


def linked_facts(facts: DataFrame, analyses: DataFrame) -> DataFrame:
    """Facts joined to their analysis on (pr_id, repo); orphans drop out."""
    times = analyses.select("pr_id", "repo", "ts", "triggered_by")
    return key_lookup(facts, times, ["pr_id", "repo"], "inner", spread="fact_id")


def recent_facts(
    facts: DataFrame, analyses: DataFrame, category: str | None = None, limit: int = 20
) -> DataFrame:
    """Newest facts by analysis time, ties by fact_id.

    Every analysis that has a matching fact contributes at least one row, so the
    first ``limit`` rows lie in the first ``limit`` such analyses, ordered by
    (time, smallest fact_id). Only those keys are looked up in the facts: a
    bounded list, and the facts themselves are never shuffled for the join.
    """
    wanted = facts if category is None else facts.where(F.col("category") == category)
    per_key = wanted.groupBy("pr_id", "repo").agg(F.min("fact_id").alias("first_id"))
    newest = (
        per_key.join(analyses.select("pr_id", "repo", "ts"), ["pr_id", "repo"])
        .orderBy(F.desc("ts"), "first_id")
        .limit(limit)
        .drop("first_id")
    )
    if limit <= BROADCAST_ROWS:
        newest = F.broadcast(newest)
    best = (
        wanted.select("fact_id", "pr_id", "repo")
        .join(newest, ["pr_id", "repo"])
        .orderBy(F.desc("ts"), "fact_id")
        .limit(limit)
        .select("fact_id")
    )
    return attach_facts(best, facts, analyses).orderBy(F.desc("ts"), "fact_id")


def validate(facts: DataFrame) -> DataFrame:
    """Facts with a ``reason`` column: null for valid rows, else the first rule broken."""
    required = ["pr_id", "repo", "category", "summary", "detail", "confidence", "source"]
    reason = F.when(F.lit(False), F.lit(""))
    for name in required:
        reason = reason.when(F.col(name).isNull(), F.lit(f"missing {name}"))
    reason = (
        reason.when(~F.col("category").isin(*CATEGORIES), F.lit("unknown category"))
        .when(~F.col("source").isin(*FACT_SOURCES), F.lit("unknown source"))
        .when(~F.col("confidence").between(0.0, 1.0) | F.isnan("confidence"), F.lit("confidence out of range"))
    )
    return facts.withColumn("reason", reason)


def split_valid(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their reason)."""
    checked = validate(facts)
    return checked.where(F.col("reason").isNull()).drop("reason"), checked.where(F.col("reason").isNotNull())
