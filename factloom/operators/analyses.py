"""Nested analyses: exploding incoming ones, replacing stored ones, reading them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.merge import KEY
from factloom.operators.skew import broadcast_if_small, key_lookup
from factloom.session import materialise

# Children per returned part of a nested analysis.
PART_ROWS = 10_000


def last_arrivals(nested: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Key and number of the last arrival of every analysis."""
    return nested.groupBy(*KEY).agg(F.max(arrival).alias(arrival))


def latest_arrivals(nested: DataFrame, arrival: str = "arrival", last: DataFrame | None = None) -> DataFrame:
    """Last arrival per (pr_id, repo), as if the batch had been saved row by row.

    The winning arrival numbers are found on key columns alone (``last``, if they are
    stored already); the nested rows are then filtered by them, where they are if the list
    is small, and never gathered per key. With the arrival in the join key every key is a
    single row, so the join cannot be skewed.
    """
    last = materialise(last_arrivals(nested, arrival), "last-arrivals") if last is None else last
    return nested.join(broadcast_if_small(last), [*KEY, arrival], "left_semi")


def validate_analyses(nested: DataFrame) -> DataFrame:
    """Adds ``reason``: why an incoming analysis cannot be saved, or null.

    It needs a key, a time that can be read, and complete facts and edges. A bad one
    is told apart here, so that it never stops the batch that brings it.
    """

    def any_of(column, bad):
        return F.coalesce(F.exists(column, bad), F.lit(False))

    incomplete_fact = any_of("facts", lambda f: f["category"].isNull() | f["summary"].isNull() | f["detail"].isNull())
    unsure = any_of("facts", lambda f: ~F.coalesce(f["confidence"].between(0, 1), F.lit(False)))
    incomplete_edge = any_of(
        "dependencies", lambda d: d["from_component"].isNull() | d["to_component"].isNull() | d["relation"].isNull()
    )
    return nested.withColumn(
        "reason",
        F.when(F.col("pr_id").isNull(), "missing pr_id")
        .when(F.col("repo").isNull(), "missing repo")
        .when(F.try_to_timestamp("timestamp").isNull(), "unreadable timestamp")
        .when(incomplete_fact, "incomplete fact")
        .when(unsure, "confidence out of range")
        .when(incomplete_edge, "incomplete dependency"),
    )


# Of the numbers that Spark gives to rows, these are the row's; those above are its partition's.
ROW_BITS = 33
# Column of stored children that holds such a number until ids are known.
ROW = "row_number"


def children(nested: DataFrame) -> dict[str, DataFrame]:
    """Table rows of nested analyses without ids. Saving drops ``triggered_by``."""
    analyses = nested.select(
        *KEY,
        F.try_to_timestamp("timestamp").alias("ts"),
        "timestamp",
        F.col("change.files").alias("files"),
        F.col("change.kind").alias("kinds"),
        F.lit(None).cast("string").alias("triggered_by"),
    )
    facts = nested.select(*KEY, F.explode("facts").alias("f")).select(
        *KEY,
        "f.category", "f.summary", "f.detail", "f.confidence",
        F.coalesce("f.source", F.lit("ai")).alias("source"),
        F.coalesce("f.files", F.array().cast("array<string>")).alias("source_files"),
        F.coalesce("f.symbols", F.array().cast("array<string>")).alias("symbols"),
        F.coalesce(F.to_json("f.symbols"), F.lit("[]")).alias("symbols_text"),
    )
    edges = nested.select(*KEY, F.explode("dependencies").alias("d")).select(
        *KEY, "d.from_component", "d.to_component", "d.relation"
    )
    return {"pr_analyses": analyses, "facts": facts, "dependencies": edges}


def id_starts(stored: DataFrame, first: int) -> tuple[list[tuple[int, int]], int]:
    """Where the ids of every partition start, counted on from ``first``, and the next free one.

    ``stored`` rows have their number in ROW. Ids are a sum over the partitions that wrote
    the rows, one small row each; the rows themselves are neither sorted nor joined.
    """
    part = F.shiftright(ROW, ROW_BITS).alias("part")
    starts = []
    for row in stored.groupBy(part).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        starts.append((row["part"], first))
        first += row["n"]
    return starts, first


def row_ids(start: Column) -> Column:
    """The id of a stored row from its partition's start."""
    return start + F.col(ROW).bitwiseAND(F.lit((1 << ROW_BITS) - 1))


def flatten(nested: DataFrame, first: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """Table rows of nested analyses, child ids counted on from ``first``."""
    first = first or {}
    out = children(nested)
    for name, id_ in (("facts", "fact_id"), ("dependencies", "dep_id")):
        stored = materialise(out[name].withColumn(ROW, F.monotonically_increasing_id()), "children")
        starts, _ = id_starts(stored, first.get(id_, 0))
        listed = F.broadcast(nested.sparkSession.createDataFrame(starts, "part long, start long"))
        placed = stored.join(listed, F.shiftright(ROW, ROW_BITS) == F.col("part"))
        columns = [column for column in stored.columns if column != ROW]
        out[name] = placed.select(row_ids(F.col("start")).alias(id_), *columns)
    return out


def replace_analyses(store: dict[str, DataFrame], nested: DataFrame, arrival: str = "arrival") -> dict[str, DataFrame]:
    """Stored tables after saving a batch of nested analyses.

    Everything stored under an incoming key goes, the batch's rows come in. Ids of
    new children go on from the largest stored ones. Arrival numbers must be unique.
    """
    first = {}
    for name, id_ in (("facts", "fact_id"), ("dependencies", "dep_id")):
        last = store[name].agg(F.max(id_)).first()[0]
        first[id_] = 0 if last is None else last + 1
    last = materialise(last_arrivals(nested, arrival), "last-arrivals")
    fresh = flatten(latest_arrivals(nested, arrival, last), first)
    keys = last.select(*KEY)
    out = dict(store)
    for name, spread in (("pr_analyses", "pr_id"), ("facts", "fact_id"), ("dependencies", "dep_id")):
        kept = key_lookup(store[name], keys, KEY, "left_anti", spread)
        out[name] = kept.unionByName(fresh[name], allowMissingColumns=True)
    return out


def nested_analyses(
    analyses: DataFrame, facts: DataFrame, dependencies: DataFrame, part_rows: int = PART_ROWS
) -> DataFrame:
    """Analyses as nested objects, in bounded parts.

    Each analysis comes as parts 0..n-1; its facts and dependencies are spread
    over the parts by id, about ``part_rows`` each, so that no key, however
    large, is gathered into one row. Part 0 always exists: an analysis without
    children has empty lists.
    """
    fact_fields = [name for name in
                   ("fact_id", "category", "summary", "detail", "confidence", "source", "source_files", "symbols")
                   if name in facts.columns]
    sides = (
        (facts, "facts", "fact_id", fact_fields),
        (dependencies, "dependencies", "dep_id", ["dep_id", "from_component", "to_component", "relation"]),
    )
    counts = None
    for rows, name, _, _ in sides:
        n = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias(f"n_{name}"))
        counts = analyses.join(n, KEY, "left") if counts is None else counts.join(n, KEY, "left")
    most = F.greatest(F.coalesce("n_facts", F.lit(0)), F.coalesce("n_dependencies", F.lit(0)))
    sized = counts.withColumn("parts", F.greatest(F.lit(1), F.ceil(most / part_rows)).cast("int"))
    parent = sized.drop("n_facts", "n_dependencies").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    )
    for rows, name, id_column, fields in sides:
        placed = key_lookup(rows, sized.select(*KEY, "parts"), KEY, "inner", id_column).withColumn(
            "part", F.pmod(F.xxhash64(id_column), F.col("parts")).cast("int")
        )
        lists = placed.groupBy(*KEY, "part").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
        parent = parent.join(lists, [*KEY, "part"], "left").withColumn(
            name, F.coalesce(F.col(name), F.array().cast(lists.schema[name].dataType))
        )
    return parent


def get_analysis(
    analyses: DataFrame,
    facts: DataFrame,
    dependencies: DataFrame,
    pr_id: str,
    repo: str | None = None,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """One analysis as a nested object; without a repo the smallest one that has it."""
    mine = analyses.where(F.col("pr_id") == pr_id)
    if repo:
        mine = mine.where(F.col("repo") == repo)
    mine = mine.orderBy("repo").limit(1)
    found = F.col("pr_id") == pr_id
    return nested_analyses(mine, facts.where(found), dependencies.where(found), part_rows)
