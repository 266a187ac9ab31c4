"""Merging many source snapshots into one store.

A source's position (``src_ord``) is its priority. The rules below give the
result of folding the sources left to right, written as one set-based job per
table instead of a loop.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators.skew import ROWS_PER_SPLIT, broadcast_if_small, key_lookup
from factloom.session import materialise
from factloom.sources.schemas import TABLES, align

KEY = ["pr_id", "repo"]
REPO_EDGE_KEY = ["from_repo", "to_repo", "manifest", "raw_import"]


def union_sources(
    frames: Sequence[DataFrame | None], table: str, spark: SparkSession | None = None
) -> DataFrame:
    """All sources of one table, aligned to the current schema, with their ordinal; a source may lack it."""
    spark = spark or next(frame for frame in frames if frame is not None).sparkSession
    parts = [align(frame, table, spark).withColumn("src_ord", F.lit(i)) for i, frame in enumerate(frames)]
    return reduce(DataFrame.unionByName, parts)


def merge_analyses(analyses: DataFrame) -> DataFrame:
    """Last source wins per (pr_id, repo)."""
    values = F.struct(*[name for name in analyses.columns if name not in KEY])
    merged = analyses.groupBy(*KEY).agg(F.max_by(values, "src_ord").alias("last"))
    return merged.select(*KEY, "last.*")


def last_owner(analyses: DataFrame) -> DataFrame:
    """The last source holding each (pr_id, repo)."""
    return analyses.groupBy(*KEY).agg(F.max("src_ord").alias("max_ord"))


def merge_children(
    rows: DataFrame, analyses: DataFrame, id_column: str, rows_per_split: int = ROWS_PER_SPLIT
) -> DataFrame:
    """Facts or dependencies after replace-by-key.

    An analysis in a later source removes the rows of its key from all earlier
    ones, so a row stays iff no source after its own holds the key. Rows without
    any analysis stay from every source.
    """
    owned = key_lookup(rows, last_owner(analyses), KEY, "left", id_column, rows_per_split)
    return owned.where(F.col("max_ord").isNull() | (F.col("src_ord") >= F.col("max_ord"))).drop("max_ord")


def replaced_rows(rows: DataFrame, incoming: DataFrame, id_column: str) -> DataFrame:
    """Rows that an incoming set of analyses removes."""
    return key_lookup(rows, incoming.select(*KEY).distinct(), KEY, "left_semi", id_column)


def merge_summaries(summaries: DataFrame) -> DataFrame:
    """Last source wins per repository, whatever ``updated_at`` says."""
    return summaries.groupBy("repo").agg(
        F.max_by(F.struct("summary", "updated_at", "src_ord"), "src_ord").alias("last")
    ).select("repo", "last.*")


def merge_repo_dependencies(edges: DataFrame, key: Sequence[str] = tuple(REPO_EDGE_KEY)) -> DataFrame:
    """First source wins per edge key; rows with a null in the key never collide.

    An ordered aggregate, not a window, so that repeats are combined map-side.
    """
    values = [name for name in edges.columns if name not in key]
    null_key = reduce(lambda a, b: a | b, [F.col(name).isNull() for name in key])
    first = F.min_by(F.struct(*values), F.struct("src_ord", "dep_id", "relation"))
    distinct = edges.where(~null_key).groupBy(*key).agg(first.alias("first")).select(*key, "first.*")
    return distinct.unionByName(edges.where(null_key))


def merge_counts(facts: DataFrame) -> DataFrame:
    """Facts brought in by each source."""
    return facts.groupBy("src_ord").agg(F.count(F.lit(1)).alias("facts"))


def renumber(rows: DataFrame, id_column: str) -> DataFrame:
    """Store-wide row ids from 0 that follow (source, id), without a sort of the rows.

    Every source takes as many ids as lie between its smallest and its largest, after
    those of the sources before it. Any number of sources fits, as long as their
    ranges together do.
    """
    spans = rows.groupBy("src_ord").agg(F.min(id_column).alias("low"), F.max(id_column).alias("high"))
    before = Window.orderBy("src_ord").rowsBetween(Window.unboundedPreceding, -1)
    # One row per source.
    shift = F.coalesce(F.sum(F.col("high") - F.col("low") + 1).over(before), F.lit(0)) - F.col("low")
    shifts = materialise(spans.select("src_ord", shift.alias("__shift")), "id-shifts")
    moved = rows.join(broadcast_if_small(shifts), "src_ord", "left")
    return moved.withColumn(id_column, F.col(id_column) + F.col("__shift")).select(*rows.columns)


def merge_united(united: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The merged tables of sources that are already united, each row with its ``src_ord``."""
    analyses = united["pr_analyses"]
    out = {"pr_analyses": merge_analyses(analyses)}
    for name, id_column in (("facts", "fact_id"), ("dependencies", "dep_id")):
        out[name] = renumber(merge_children(united[name], analyses, id_column), id_column)
    out["repo_summaries"] = merge_summaries(united["repo_summaries"])
    out["repo_dependencies"] = renumber(merge_repo_dependencies(united["repo_dependencies"]), "dep_id")
    return {name: rows.drop("src_ord") for name, rows in out.items()}


def merge_store(sources: Sequence[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The merged tables of several sources; one source is used unchanged, none gives nothing."""
    if not sources:
        return {}
    spark = next(iter(sources[0].values())).sparkSession
    if len(sources) == 1:
        return {name: align(sources[0].get(name), name, spark) for name in TABLES}
    return merge_united({name: union_sources([s.get(name) for s in sources], name, spark) for name in TABLES})
