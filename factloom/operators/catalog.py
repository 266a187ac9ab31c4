"""Grouped overviews of modules and repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def modules_in_repo(facts: DataFrame, repo_name: str) -> DataFrame:
    return (
        facts.where(F.col("repo") == repo_name)
        .groupBy(F.col("pr_id").alias("module_id"), "repo")
        .agg(F.count(F.lit(1)).alias("fact_count"))
        .orderBy("module_id")
    )


def repo_overview(facts: DataFrame, summaries: DataFrame) -> DataFrame:
    """Modules and facts per repository with its summary, null if there is none.

    Counting per module first keeps the distinct count exact while a large
    repository is shuffled as one row per module and task.
    """
    per_module = facts.groupBy("repo", "pr_id").agg(F.count(F.lit(1)).alias("n"))
    per_repo = per_module.groupBy("repo").agg(F.count("pr_id").alias("modules"), F.sum("n").alias("facts"))
    return per_repo.join(summaries.select("repo", "summary"), "repo", "left").orderBy("repo")


def repo_catalog(facts: DataFrame, summaries: DataFrame) -> DataFrame:
    """Every summary with the fact count of its repository, zero if it has none."""
    counts = facts.groupBy("repo").agg(F.count(F.lit(1)).alias("facts"))
    return (
        summaries.join(counts, "repo", "left").withColumn("facts", F.coalesce("facts", F.lit(0))).orderBy("repo")
    )
