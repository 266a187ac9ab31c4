"""Reading per-repository snapshot files (SQLite databases) and table folders.

Files are listed and read by Spark's binary file source, so any file system
Spark can reach works: a local or mounted folder, a landing folder of release
assets, an object-store container. Each file is opened by the task that read it,
so a SQLite file has to fit a task. Snapshot folders of Parquet or JSON tables are
read by Spark's own readers and may have any size.
"""

from __future__ import annotations

import logging
import sqlite3
import sys
import time
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.text import json_list, split_clean
from factloom.operators.skew import key_lookup
from factloom.session import materialise, scratch_path
from factloom.sources.schemas import TABLES, align

cloudpickle.register_pickle_by_value(sys.modules[__name__])

logger = logging.getLogger(__name__)

# Largest SQLite file: what Spark's reader of whole files can give to a task. Larger ones fail it, so they are rejects.
MAX_FILE_BYTES = (1 << 31) - 1
ROWS_PER_BATCH = 5_000

# Columns of each table in a snapshot file, with their types there.
FILE_COLUMNS = {
    "pr_analyses": {
        "pr_id": "string", "repo": "string", "timestamp": "string", "files": "string", "kinds": "string",
        "triggered_by": "string",
    },
    "facts": {
        "id": "long", "pr_id": "string", "repo": "string", "category": "string", "summary": "string",
        "detail": "string", "confidence": "double", "source": "string", "source_files": "string",
        "symbols": "string",
    },
    "dependencies": {
        "id": "long", "pr_id": "string", "repo": "string", "from_component": "string",
        "to_component": "string", "relation": "string",
    },
    "repo_summaries": {"repo": "string", "summary": "string", "updated_at": "string"},
    "repo_dependencies": {
        "id": "long", "from_repo": "string", "to_repo": "string", "manifest": "string",
        "raw_import": "string", "relation": "string",
    },
}
_ALL_COLUMNS = {name: kind for columns in FILE_COLUMNS.values() for name, kind in columns.items()}
REJECTS = "rejects"
OLDER_COPY, NO_COPY = "nothing could be read, its last good copy is used", "nothing could be read and there is no copy"
_ROW_SCHEMA = ", ".join(
    ["source_no int", "path string", "table_name string", "error string"]
    + [f"`{name}` {kind}" for name, kind in _ALL_COLUMNS.items()]
)


def read_source(spark: SparkSession, path: str, last_good: str | None = None) -> DataFrame | None:
    """Snapshot files under a path: one named file, or every ``*.db`` of a folder.

    A path that does not exist is skipped. If nothing is found, the last good
    copy of the source is used, if it has one.
    """
    for place in filter(None, (path, last_good)):
        try:
            reader = spark.read.format("binaryFile")
            if not place.endswith(".db"):
                reader = reader.option("pathGlobFilter", "*.db").option("recursiveFileLookup", "true")
            files = reader.load(place).select("path", "length", "content")
            if not files.select("path").isEmpty():
                return files
        except AnalysisException:
            pass
        logger.warning("no snapshot found in %s", place)
    return None


def collect_sources(
    spark: SparkSession,
    local: str = "",
    releases: str = "",
    object_store: str = "",
    last_good: dict[str, str] | None = None,
) -> DataFrame | None:
    """Files of all sources, comma-separated lists taken in this fixed order.

    ``source_no`` is the position of the listed path; later sources win when
    the tables are merged.
    """
    paths = [p for text in (local, releases, object_store) for p in split_clean(text, ",")]
    frames = [read_source(spark, p, (last_good or {}).get(p)) for p in paths]
    found = [frame.withColumn("source_no", F.lit(i)) for i, frame in enumerate(frames) if frame is not None]
    return reduce(DataFrame.unionByName, found) if found else None


def _open_snapshot(content: bytes) -> sqlite3.Connection:
    # A file left in write-ahead mode cannot be opened in memory; its header
    # says so in two bytes (fixed positions 18 and 19).
    if content[18:20] == b"\x02\x02":
        content = content[:18] + b"\x01\x01" + content[20:]
    connection = sqlite3.connect(":memory:")
    connection.deserialize(content)
    state = connection.execute("PRAGMA quick_check(1)").fetchone()[0]
    if state != "ok":
        raise sqlite3.DatabaseError(state)
    return connection


def _snapshot_rows(source_no: int, path: str, content: bytes) -> Iterator[pa.RecordBatch]:
    try:
        connection = _open_snapshot(content)
    except sqlite3.Error as error:
        yield _batch(source_no, path, REJECTS, {"error": [str(error)]}, 1)
        return
    for table, columns in FILE_COLUMNS.items():
        present = {row[1] for row in connection.execute(f"PRAGMA table_info({table})")}
        names = [name for name in columns if name in present]
        if not names:
            continue
        cursor = connection.execute(f"SELECT {', '.join(names)} FROM {table}")
        while rows := cursor.fetchmany(ROWS_PER_BATCH):
            yield _batch(source_no, path, table, dict(zip(names, zip(*rows))), len(rows))
    connection.close()


def _batch(source_no: int, path: str, table: str, columns: dict[str, Sequence], count: int) -> pa.RecordBatch:
    """One Arrow batch in the union layout; columns a table lacks are null."""
    fixed = {"source_no": [source_no] * count, "path": [path] * count, "table_name": [table] * count}
    values = {**fixed, **columns}
    types = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32()}
    layout = {"source_no": "int", "path": "string", "table_name": "string", "error": "string", **_ALL_COLUMNS}
    arrays = [pa.array(values.get(name, [None] * count), types[kind]) for name, kind in layout.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(layout))


def _parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            source_no, path, content = (batch.column(name)[row].as_py() for name in ("source_no", "path", "content"))
            yield from _snapshot_rows(source_no, path, content)


def land_snapshots(files: DataFrame, out: str | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables of all snapshot files, and the files that could not be read.

    One pass over the files writes every table to Parquet. Rows carry
    ``src_ord``, the position of their file in (source, path) order, as
    ``merge_united`` expects.
    """
    spark = files.sparkSession
    out = out or scratch_path(spark, "landed")
    files = files.select("source_no", "path", "length", "content")
    small = files.where(F.col("length") <= MAX_FILE_BYTES).select("source_no", "path", "content")
    parsed = small.mapInArrow(_parse_files, _ROW_SCHEMA)
    large = files.where(F.col("length") > MAX_FILE_BYTES).select(
        "source_no", "path", F.lit(REJECTS).alias("table_name"),
        F.lit("too large for one task; provide the tables as Parquet").alias("error"),
    )
    parsed.unionByName(large, allowMissingColumns=True).write.partitionBy("table_name").parquet(out)

    ordinals = _ordinals(files)
    landed = spark.read.schema(_ROW_SCHEMA).parquet(out)
    rejects = landed.where(F.col("table_name") == REJECTS).select("path", "error")
    tables = {}
    for name, columns in FILE_COLUMNS.items():
        rows = landed.where(F.col("table_name") == name).select("source_no", "path", *columns)
        numbered = key_lookup(rows, ordinals, ["source_no", "path"], "inner", next(iter(columns)))
        tables[name] = decode_table(numbered, name)
    return tables, rejects


def _ordinals(files: DataFrame) -> DataFrame:
    """source_no, path, src_ord: the position of every file in (source, path) order, from 0."""
    row_bits = 33  # of the ids that Spark numbers rows with; the others are the partition
    listed = files.select("source_no", "path").distinct().orderBy("source_no", "path")
    listed = materialise(listed.withColumn("row", F.monotonically_increasing_id()), "files")
    part = F.shiftright("row", row_bits).alias("part")
    # One row per partition of the sort, whatever the number of files.
    sizes = listed.groupBy(part).agg(F.count(F.lit(1)).alias("size"))
    before = F.sum("size").over(Window.orderBy("part")) - F.col("size")
    starts = F.broadcast(sizes.select("part", before.alias("start")))
    place = F.col("row").bitwiseAND(F.lit((1 << row_bits) - 1))
    numbered = listed.withColumn("part", part).join(starts, "part")
    return materialise(numbered.select("source_no", "path", (F.col("start") + place).alias("src_ord")), "ordinals")


def write_folder(tables: dict[str, DataFrame], path: str, kind: str = "parquet") -> None:
    """Tables as a snapshot folder: ``path``/<table> with the columns of snapshot files, in Parquet or JSON."""
    for name, rows in tables.items():
        own = {"id": "fact_id" if name == "facts" else "dep_id"}
        columns = []
        for column in FILE_COLUMNS[name]:
            column_from = own.get(column, column)
            if column_from in rows.columns:
                is_list = rows.schema[column_from].dataType.typeName() == "array"
                columns.append((F.to_json(column_from) if is_list else F.col(column_from)).alias(column))
        rows.select(*columns).write.format(kind).save(f"{path}/{name}")


def read_folders(spark: SparkSession, paths: Sequence[str], kind: str = "parquet") -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables of snapshot folders, and what could not be read: path, error.

    Spark's readers split the files, so neither a file nor a folder has a size bound.
    ``src_ord`` is the position of the listed path. A table that a folder lacks is
    empty. A table that cannot be opened, a line that is no JSON and a row with an
    unreadable list are rejects.
    """
    tables, rejects = {}, [spark.createDataFrame([], "path string, error string")]
    for name, columns in FILE_COLUMNS.items():
        found = []
        for i, path in enumerate(paths):
            place = f"{path}/{name}"
            schema = ", ".join([f"`{column}` {kind_of}" for column, kind_of in columns.items()])
            try:
                if kind == "json":
                    reader = spark.read.schema(f"{schema}, `_unread` string").option("columnNameOfCorruptRecord", "_unread")
                    rows = reader.json(place)
                else:
                    rows = spark.read.format(kind).load(place)
                    missing = [column for column in columns if column not in rows.columns]
                    rows = rows.withColumns({column: F.lit(None) for column in missing})
                    rows = rows.select(*[F.col(column).cast(kind_of) for column, kind_of in columns.items()])
                    rows = rows.withColumn("_unread", F.lit(None).cast("string"))
            except (AnalysisException, Py4JJavaError) as error:
                if not isinstance(error, AnalysisException) or error.getCondition() != "PATH_NOT_FOUND":
                    why = str(error).partition("\n\tat ")[0]
                    rejects.append(spark.createDataFrame([(place, why)], "path string, error string"))
                continue
            found.append(rows.withColumns({"source_no": F.lit(i), "src_ord": F.lit(i), "path": F.lit(place)}))
        if not found:
            tables[name] = align(None, name, spark)
            continue
        rows = reduce(DataFrame.unionByName, found)
        lists = [c for c in ("files", "kinds", "source_files", "symbols") if c in columns]
        reason = F.when(F.col("_unread").isNotNull(), "not JSON")
        for column in lists:
            unread = F.col(column).isNotNull() & F.from_json(column, "array<string>").isNull()
            reason = reason.when(unread, f"{column} is not a list")
        rows = rows.withColumn("error", reason)
        rejects.append(rows.where(F.col("error").isNotNull()).select("path", "error"))
        tables[name] = decode_table(rows.where(F.col("error").isNull()).drop("error", "_unread"), name)
    return tables, reduce(DataFrame.unionByName, rejects)


def _copied(spark: SparkSession, path: str, copy: str, kind: str) -> tuple[bool, list[tuple[str, str]]]:
    """Copy the tables of a snapshot folder as they are; whether any row came, and the tables that could not be read."""
    found, lost = False, []
    for name in FILE_COLUMNS:
        place = f"{path}/{name}"
        try:
            # Lines of JSON are copied as lines, so that unreadable ones are reported wherever they are read.
            rows = spark.read.format("text" if kind == "json" else kind).load(place)
            rows.write.format("text" if kind == "json" else kind).save(f"{copy}/{name}")
            found = found or not rows.isEmpty()
        except (AnalysisException, Py4JJavaError) as error:
            if not isinstance(error, AnalysisException) or error.getCondition() != "PATH_NOT_FOUND":
                lost.append((place, str(error).partition("\n\tat ")[0]))
    return found, lost


def _last_good(spark: SparkSession, store: str) -> dict[str, str]:
    """The folder of the last good copy of every source; one row per source reaches the driver."""
    try:
        noted = spark.read.schema("source string, folder string, number long").parquet(f"{store}/manifest")
    except AnalysisException:
        return {}
    return {row["source"]: row["folder"] for row in noted.groupBy("source").agg(F.max_by("folder", "number").alias("folder")).collect()}


def collect_folders(
    spark: SparkSession, store: str, local: str = "", releases: str = "", object_store: str = "", kind: str = "parquet"
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables of snapshot folders of all sources, comma-separated lists taken in this fixed order, and rejects.

    ``src_ord`` is the position among the folders that are read: all local ones, and remote
    ones that gave something now or before. Release and object-store folders are copied
    below ``store`` before they are read, and a manifest there names the last good copy of
    each; a source that gives nothing is read from it. A local folder is read where it is
    and has no copy. Sources fail one by one: whatever could not be read is a reject (path,
    error), as is the use of an older copy.
    """
    known = _last_good(spark, store)
    used, lost, noted = [], [], []
    for text, is_remote in ((local, False), (releases, True), (object_store, True)):
        for path in split_clean(text, ","):
            if not is_remote:
                used.append(path)
                continue
            copy = f"{store}/copies/{uuid.uuid4().hex}"
            good, unread = _copied(spark, path, copy, kind)
            lost += unread
            if good:
                noted.append((path, copy))
                used.append(copy)
            elif path in known:
                lost.append((path, OLDER_COPY))
                used.append(known[path])
            else:
                lost.append((path, NO_COPY))
    if noted:
        # Written once all copies are whole; later rows of a source win.
        rows = [(source, folder, time.time_ns()) for source, folder in noted]
        spark.createDataFrame(rows, "source string, folder string, number long").coalesce(1).write.mode("append").parquet(f"{store}/manifest")
    tables, rejects = read_folders(spark, used, kind)
    return tables, rejects.unionByName(spark.createDataFrame(lost, "path string, error string"))


def decode_table(rows: DataFrame, name: str) -> DataFrame:
    """File columns to the declared ones: lists decoded, times parsed, ids named."""
    if name == "pr_analyses":
        rows = rows.withColumns(
            {
                "ts": F.try_to_timestamp("timestamp"),
                "files": json_list(F.col("files")),
                "kinds": json_list(F.col("kinds")),
            }
        )
    elif name == "facts":
        rows = rows.withColumnRenamed("id", "fact_id").withColumns(
            {
                "symbols_text": F.col("symbols"),
                "symbols": json_list(F.col("symbols")),
                "source_files": json_list(F.col("source_files")),
            }
        )
    elif "id" in rows.columns:
        rows = rows.withColumnRenamed("id", "dep_id")
    return align(rows.drop("source_no", "path"), name)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Store merged tables as Parquet, facts sorted by id so that id lookups skip row groups."""
    for name, df in tables.items():
        if name == "facts":
            df = df.repartitionByRange("fact_id").sortWithinPartitions("fact_id")
        df.write.mode("errorifexists").parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The five tables of a stored knowledge base; a missing table is empty."""
    tables = {}
    for name in TABLES:
        try:
            stored = spark.read.parquet(f"{path}/{name}")
        except AnalysisException:
            stored = None
        tables[name] = align(stored, name, spark)
    return tables


def read_sources(spark: SparkSession, paths: Sequence[str]) -> list[dict[str, DataFrame]]:
    """Table folders of several sources, in merge order."""
    return [read_tables(spark, path) for path in paths]
