"""Join helpers for keys that may hold a large share of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import materialise

# Rows of one key that a single task may receive before the key is split.
ROWS_PER_SPLIT = 1_000_000
# Parts that rows with a null key are spread over; they match nothing, so the other side needs no copies.
NULL_PARTS = 1 << 16
# Upper bounds of a side that is broadcast after its size was checked.
BROADCAST_ROWS = 200_000
BROADCAST_CHARS = 16_000_000


def split_plan(
    big: DataFrame, on: list[str], rows_per_split: int = ROWS_PER_SPLIT, counts: DataFrame | None = None
) -> DataFrame:
    """Keys with too many rows for one task, and into how many parts to split each.

    The counts (``__n`` per key, given or taken here) are combined map-side, so a
    hot key is shuffled as one row per task. There is at most one row for every
    ``rows_per_split`` rows of ``big``.
    """
    if counts is None:
        counts = big.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    parts = F.ceil(F.col("__n") / rows_per_split).cast("int").alias("__parts")
    return counts.where(F.col("__n") > rows_per_split).select(*on, parts)


def salted_lookup(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str,
    spread: str,
    rows_per_split: int = ROWS_PER_SPLIT,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Equi-join where single keys of ``big`` may hold a third of its rows.

    Rows of a hot key are spread over as many parts as its count asks for, and
    only the ``small`` rows of those keys are repeated, once per part. The work
    grows with the data and no row is left out. ``spread`` names a column of
    ``big`` with many values. Supports inner, left, left_semi and left_anti. The
    stored list of split keys is the same for both sides; it is broadcast if its
    size allows, else joined by shuffle. Rows with a null key are spread too.
    """
    plan = broadcast_if_small(materialise(split_plan(big, on, rows_per_split, counts), "split-keys"))
    no_key = reduce(lambda a, b: a | b, [F.col(name).isNull() for name in on])
    salted_big = (
        big.join(plan, on, "left")
        .withColumn(
            "__salt",
            F.when(no_key, F.pmod(F.xxhash64(F.col(spread)), F.lit(NULL_PARTS)).cast("int"))
            .when(F.col("__parts").isNull(), F.lit(0))
            .otherwise(
                F.pmod(F.xxhash64(F.col(spread)), F.col("__parts")).cast("int")
            ),
        )
        .drop("__parts")
    )
    salted_small = (
        small.join(plan, on, "left")
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__parts"), F.lit(1)) - 1)))
        .drop("__parts")
    )
    return salted_big.join(salted_small, [*on, "__salt"], how).drop("__salt")


def key_lookup(
    big: DataFrame, small: DataFrame, on: list[str], how: str, spread: str, rows_per_split: int = ROWS_PER_SPLIT
) -> DataFrame:
    """Join wide rows to a narrow table of keys.

    The key table is counted first. If it is small, it is broadcast and the wide
    rows stay where they are; else both are shuffled with hot keys split.
    """
    hinted = broadcast_if_small(small)
    if hinted is not small:
        return big.join(hinted, on, how)
    return salted_lookup(big, small, on, how, spread, rows_per_split)


def broadcast_if_small(df: DataFrame, max_rows: int | None = None, max_chars: int | None = None) -> DataFrame:
    """Mark a side for broadcast only after counting it; a larger side is joined by shuffle.

    Sides with nested columns have no simple size bound and are left as they are.
    """
    max_rows = BROADCAST_ROWS if max_rows is None else max_rows
    max_chars = BROADCAST_CHARS if max_chars is None else max_chars
    if any(kind.startswith(("array", "map", "struct", "binary")) for _, kind in df.dtypes):
        return df
    text = [F.length(F.coalesce(F.col(name), F.lit(""))) for name, kind in df.dtypes if kind == "string"]
    chars = sum(text[1:], text[0]) if text else F.lit(0)
    counted = df.select(chars.alias("c")).limit(max_rows + 1)
    rows, size = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and size <= max_chars else df
