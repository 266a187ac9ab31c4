"""Substring joins: which values contain which needles, found by character grams.

Every value is cut into its grams of three characters. A needle is looked up by the one
of its grams that the fewest values hold, and the values found are confirmed with
``contains``. Needles of one or two characters use grams of their own length. So the
work follows the values that share the needle's rarest gram, not needles x values.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.skew import broadcast_if_small, key_lookup
from factloom.session import materialise

GRAM = 3


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone, as LIKE compares."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def grams(text: Column, size: int = GRAM) -> Column:
    """Distinct pieces of ``size`` characters; none of a shorter text."""
    characters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    count = F.greatest(F.length(text) - (size - 1), F.lit(0))
    if size == 1:
        return F.array_distinct(characters)
    pieces = F.arrays_zip(*[F.slice(characters, i + 1, count) for i in range(size)])
    return F.array_distinct(F.transform(pieces, lambda p: F.concat(*[p[str(i)] for i in range(size)])))


def gram_rows(values: DataFrame, size: int = GRAM) -> DataFrame:
    """(gram, value) of a column ``value``."""
    return values.select(F.explode(grams(F.col("value"), size)).alias("gram"), "value")


def containing(needles: DataFrame, values: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(needle, value): every distinct value with every distinct needle in it, compared as they are.

    ``needles`` has a column ``needle`` and ``values`` a column ``value`` without repeats.
    Null and empty needles are found nowhere. ``stored`` are the gram rows of ``values``,
    if they are kept as a table; needles shorter than a gram read the values themselves.
    """
    needles = needles.select("needle").where(F.length("needle") > 0).distinct()
    needles = materialise(needles, "needles")
    lengths = [row["size"] for row in needles.select(F.least(F.length("needle"), F.lit(GRAM)).alias("size")).distinct().collect()]
    found = None
    for size in sorted(lengths):
        own = needles.where(F.length("needle") == size if size < GRAM else F.length("needle") >= size)
        rows = stored if size == GRAM and stored is not None else gram_rows(values, size)
        pairs = _containing(own, rows, size)
        found = pairs if found is None else found.unionByName(pairs)
    if found is None:
        return needles.select("needle", F.col("needle").alias("value"))
    return found


def _containing(needles: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    wanted = needles.select("needle", F.explode(grams(F.col("needle"), size)).alias("gram"))
    known = materialise(key_lookup(rows, wanted.select("gram").distinct(), ["gram"], "left_semi", "value"), "grams")
    counts = known.groupBy("gram").agg(F.count(F.lit(1)).alias("held"))
    # A gram that no value has is the rarest one: its needle is found nowhere.
    held = wanted.join(broadcast_if_small(counts), "gram", "left").select("needle", "gram", F.coalesce("held", F.lit(0)).alias("held"))
    rarest = held.groupBy("needle").agg(F.min_by("gram", F.struct("held", "gram")).alias("gram"))
    met = key_lookup(known, materialise(rarest, "rarest"), ["gram"], "inner", "value")
    return met.where(F.col("value").contains(F.col("needle"))).select("needle", "value")
