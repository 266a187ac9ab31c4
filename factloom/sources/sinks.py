"""Result sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns that results for readers leave out.
LEFT_OUT = ("source", "relevance", "score", "pr_id")
_INTERNAL = ("fact_id", "query_id", "rank", "place", "symbols_text")


def clean_json(facts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One JSON object per row in ``value``, after the columns in ``keep``.

    Ranking and origin columns are dropped, and so are empty symbol lists and
    null fields.
    """
    names = [name for name in facts.columns if name not in (*LEFT_OUT, *_INTERNAL)]
    if "ts" in names and "timestamp" in names:
        names.remove("timestamp")
    fields = []
    for name in names:
        column = F.col(name)
        if name == "symbols":
            column = F.when(F.size("symbols") > 0, F.col("symbols"))
        elif name == "ts":
            column, name = time_text(facts), "timestamp"
        fields.append(column.alias(name))
    return facts.select(*keep, F.to_json(F.struct(*fields)).alias("value"))


def time_text(facts: DataFrame) -> Column:
    """The time as it was stored; where only the instant is known, ISO text with microseconds if there are any."""
    whole, exact = (F.date_format("ts", f"yyyy-MM-dd'T'HH:mm:ss{part}'Z'") for part in ("", ".SSSSSS"))
    text = F.when(F.date_trunc("second", "ts") == F.col("ts"), whole).otherwise(exact)
    return F.coalesce("timestamp", text) if "timestamp" in facts.columns else text


def write_json(facts: DataFrame, path: str) -> None:
    clean_json(facts).write.text(path)
