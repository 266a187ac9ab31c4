"""Lookups over the two dependency edge lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import component_stem, component_stem_col, folded_contains
from factloom.operators.grams import ascii_lower, containing
from factloom.operators.skew import broadcast_if_small, key_lookup
from factloom.session import materialise

# Standard-library and framework names left out of impact results.
NOISE_NAMES = (
    "json", "re", "os", "sys", "typing", "pathlib", "logging", "time",
    "datetime", "collections", "functools", "itertools", "enum", "abc",
    "dataclasses", "copy", "math", "hashlib", "base64", "traceback",
    "urllib", "http", "io", "contextlib", "asyncio", "threading",
    "fastapi", "pydantic", "express", "react", "vue", "next",
    "axios", "lodash", "mongoose", "sequelize",
)

DIRECTIONS = ("outgoing", "incoming", "both")
EDGE_COLUMNS = ["pr_id", "repo", "from_component", "to_component", "relation"]
REPO_EDGE_COLUMNS = ["from_repo", "to_repo", "manifest", "raw_import", "relation"]


def _touches(component: str) -> Column:
    stem = component_stem(component)
    return folded_contains(F.col("from_component"), stem) | folded_contains(F.col("to_component"), stem)


def _without_noise(edges: DataFrame, noise: Sequence[str]) -> DataFrame:
    if not noise:
        return edges
    return edges.where(~F.col("from_component").isin(*noise) & ~F.col("to_component").isin(*noise))


def component_impact(dependencies: DataFrame, component: str, noise: Sequence[str] = NOISE_NAMES) -> DataFrame:
    """Distinct edges with the component's stem in either endpoint."""
    found = dependencies.where(_touches(component)).select(*EDGE_COLUMNS)
    return _without_noise(found, noise).distinct()


def component_impact_batch(
    dependencies: DataFrame, components: DataFrame | Sequence[str], noise: Sequence[str] = NOISE_NAMES
) -> DataFrame:
    """The same for a table of components (column ``component``) of any size, or a short list of them.

    An edge appears once per component it touches. Distinct stems meet distinct endpoints
    by their rarest gram, and edges come back by endpoint; where both endpoints hold a stem,
    the first one counts, so nothing has to be made distinct after the join. An empty stem
    (as that of ``.env``) touches every edge. Null components touch none.
    """
    if not isinstance(components, DataFrame):
        spark = dependencies.sparkSession
        components = spark.createDataFrame([(name,) for name in components], "component string")
    stems = components.select("component", ascii_lower(component_stem_col(F.col("component"))).alias("needle"))
    stems = materialise(stems.where(F.col("component").isNotNull()).distinct(), "components")
    edges = materialise(_without_noise(dependencies, noise).select(*EDGE_COLUMNS).distinct(), "edges")
    first, second = ascii_lower(F.col("from_component")), ascii_lower(F.col("to_component"))
    ends = F.array(
        F.struct(first.alias("value"), F.lit(None).cast("string").alias("other")),
        F.struct(second.alias("value"), first.alias("other")),
    )
    touched = edges.select(*EDGE_COLUMNS, F.inline(ends)).where(F.col("value").isNotNull())
    pairs = containing(stems.select("needle"), touched.select("value").distinct())
    by_end = materialise(stems.join(pairs, "needle").select("component", "needle", "value"), "touched")
    found = key_lookup(touched, by_end, ["value"], "inner", "pr_id")
    hits = found.where(F.col("other").isNull() | ~F.col("other").contains(F.col("needle"))).select("component", *EDGE_COLUMNS)
    every = stems.where("needle = ''").select("component", F.lit(True).alias("any"))
    if not every.take(1):
        return hits
    alike = edges.withColumn("any", F.col("from_component").isNotNull() | F.col("to_component").isNotNull())
    return hits.unionByName(alike.join(broadcast_if_small(every), "any").select("component", *EDGE_COLUMNS))


def repo_dependencies(edges: DataFrame, repo_name: str | None = None, direction: str = "both") -> DataFrame:
    """Cross-repository edges; the full graph comes ordered."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {', '.join(DIRECTIONS)}")
    edges = edges.select(*REPO_EDGE_COLUMNS)
    if repo_name is None:
        return edges.orderBy("from_repo", "to_repo")
    outgoing, incoming = F.col("from_repo") == repo_name, F.col("to_repo") == repo_name
    return edges.where({"outgoing": outgoing, "incoming": incoming, "both": outgoing | incoming}[direction])
