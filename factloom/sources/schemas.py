"""Declared schemas of the knowledge-base tables and alignment of older ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()
_LIST = T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


ANALYSES = _struct(
    pr_id=_S, repo=_S, ts=T.TimestampType(), timestamp=_S, files=_LIST, kinds=_LIST, triggered_by=_S
)
FACTS = _struct(
    fact_id=_L, pr_id=_S, repo=_S, category=_S, summary=_S, detail=_S, confidence=_D, source=_S,
    source_files=_LIST, symbols=_LIST, symbols_text=_S,
)
DEPENDENCIES = _struct(dep_id=_L, pr_id=_S, repo=_S, from_component=_S, to_component=_S, relation=_S)
REPO_SUMMARIES = _struct(repo=_S, summary=_S, updated_at=_S)
REPO_DEPENDENCIES = _struct(
    dep_id=_L, from_repo=_S, to_repo=_S, manifest=_S, raw_import=_S, relation=_S
)

TABLES = {
    "pr_analyses": ANALYSES,
    "facts": FACTS,
    "dependencies": DEPENDENCIES,
    "repo_summaries": REPO_SUMMARIES,
    "repo_dependencies": REPO_DEPENDENCIES,
}

# One incoming analysis as a nested object.
NESTED_ANALYSIS = T.StructType(
    [
        T.StructField("pr_id", _S),
        T.StructField("repo", _S),
        T.StructField("timestamp", _S),
        T.StructField("change", _struct(id=_S, files=_LIST, kind=_LIST)),
        T.StructField(
            "dependencies", T.ArrayType(_struct(from_component=_S, to_component=_S, relation=_S))
        ),
        T.StructField(
            "facts",
            T.ArrayType(
                _struct(
                    category=_S, summary=_S, detail=_S, confidence=_D, source=_S, files=_LIST, symbols=_LIST
                )
            ),
        ),
    ]
)

CATEGORIES = ("behavior", "design", "assumption")
FACT_SOURCES = ("ai", "human", "scan")

_DEFAULTS = {
    "symbols": lambda: F.array().cast("array<string>"),
    "source_files": lambda: F.array().cast("array<string>"),
    "symbols_text": lambda: F.lit("[]"),
}


def align(df: DataFrame | None, table: str, spark=None) -> DataFrame:
    """Bring a snapshot table of any age to the declared columns.

    Missing columns appear as null, list columns and the indexed symbol text
    get their empty default where missing or null, and a missing table becomes
    an empty one. Extra columns (such as a source ordinal) are kept.
    """
    schema = TABLES[table]
    if df is None:
        return spark.createDataFrame([], schema)
    present = set(df.columns)
    columns: list[Column] = []
    for field in schema:
        column = F.col(field.name) if field.name in present else F.lit(None)
        if table == "facts" and field.name in _DEFAULTS:
            column = F.coalesce(column, _DEFAULTS[field.name]())
        columns.append(column.cast(field.dataType).alias(field.name))
    extra = [F.col(name) for name in df.columns if name not in schema.names]
    return df.select(*columns, *extra)
