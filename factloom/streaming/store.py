"""Continuous replace-by-key store and index upkeep.

Saving an analysis replaces everything stored under its key. Rewriting stored
rows per micro-batch would cost as much as the store is large, so each batch is
only appended under its own folder, and readers apply the merge rule with the
batch number as the source position: a row stays iff no later batch holds its
key. Running a batch again overwrites its own folder, so replays change nothing,
and a batch counts only once its commit row is written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from factloom.operators.analyses import ROW, ROW_BITS, children, id_starts, latest_arrivals, row_ids, validate_analyses
from factloom.operators.index import (
    TextIndex,
    document_rows,
    hashed,
    link_attributes,
    posting_rows,
    shard_of,
    statistics_row,
    vocabulary_rows,
)
from factloom.operators.merge import KEY, last_owner, merge_analyses, merge_children
from factloom.operators.skew import broadcast_if_small, key_lookup
from factloom.session import materialise
from factloom.sources.schemas import NESTED_ANALYSIS

# Arrival numbers must be unique over the life of a stream (a source offset, say).
ARRIVAL_SCHEMA = T.StructType([*NESTED_ANALYSIS.fields, T.StructField("arrival", T.LongType())])
INDEX_SHARDS = 16
# Tables of children and their ids, which are counted on from batch to batch.
CHILDREN = {"facts": "fact_id", "dependencies": "dep_id"}


@dataclass(frozen=True)
class StreamStore:
    spark: SparkSession
    path: str
    indexed: bool = False
    # Parts of the index; a store keeps the number it was begun with.
    shards: int = INDEX_SHARDS

    def write_batch(self, nested: DataFrame, batch_id: int) -> None:
        """Append one micro-batch of nested analyses; unusable ones go to ``rejects`` with a reason."""
        checked = materialise(validate_analyses(nested), "arrivals")
        self._write(checked.where(F.col("reason").isNotNull()).select(*KEY, "timestamp", "reason"), "rejects", batch_id)
        first = self._next_ids(batch_id)
        fresh = children(latest_arrivals(checked.where(F.col("reason").isNull()).drop("reason")))
        starts = []
        for name, rows in fresh.items():
            id_ = CHILDREN.get(name)
            if id_ is None:
                self._write(rows, name, batch_id)
                continue
            self._write(_unnumbered(rows, id_), name, batch_id)
            found, first[id_] = id_starts(self._stored(name, batch_id), first[id_])
            starts += [(name, part, start) for part, start in found]
        # One row per task that wrote children.
        listed = self.spark.createDataFrame(starts, "name string, part long, start long")
        self._write(listed.coalesce(1), "starts", batch_id)
        if self.indexed:
            facts, analyses = self._batch("facts", batch_id), self._stored("pr_analyses", batch_id)
            self._write(document_rows(facts), "docs", batch_id)
            postings = posting_rows(link_attributes(facts, analyses))
            postings = postings.withColumn("shard", shard_of(F.col("token"), self.shards))
            self._write_postings(postings, batch_id)
        self._commit(batch_id, first)

    def _commit(self, batch_id: int, next_ids: dict[str, int]) -> None:
        row = self.spark.range(1).select(
            F.lit(batch_id).alias("done"), *[F.lit(n).cast("long").alias(id_) for id_, n in next_ids.items()]
        )
        self._write(row, "commits", batch_id)

    def _next_ids(self, batch_id: int) -> dict[str, int]:
        """First free child ids behind the batches before this one, so that a replay gives the same ids again."""
        schema = "done int, fact_id long, dep_id long, batch int"
        try:
            before = self.spark.read.schema(schema).parquet(f"{self.path}/commits").where(F.col("batch") < batch_id)
            last = before.orderBy(F.desc("batch")).first()
        except AnalysisException:
            last = None
        found = {}
        for name, id_ in CHILDREN.items():
            found[id_] = 0 if last is None else last[id_]
            if found[id_] is None:
                # Committed before commit rows held the ids.
                rows = self.spark.read.parquet(f"{self.path}/{name}").where(F.col("batch") < batch_id)
                top = rows.agg(F.max(id_)).first()[0]
                found[id_] = 0 if top is None else top + 1
        return found

    def _write(self, rows: DataFrame, name: str, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch_id}")

    def _write_postings(self, postings: DataFrame, batch_id: int) -> None:
        """Postings in shard folders, sorted by token, as in a stored index: a search opens its shards only."""
        laid = postings.hint("rebalance", "shard").sortWithinPartitions("shard", "token", "fact_id")
        laid.write.mode("overwrite").partitionBy("shard").parquet(f"{self.path}/postings/batch={batch_id}")

    def _stored(self, name: str, batch_id: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}/batch={batch_id}")

    def _batch(self, name: str, batch_id: int) -> DataFrame:
        """One batch of a table of children with their ids."""
        return self._numbered(self._stored(name, batch_id).withColumn("batch", F.lit(batch_id)), name).drop("batch")

    def _numbered(self, rows: DataFrame, name: str) -> DataFrame:
        """Ids of children from where those of their batch and partition start; a compact store holds ids as they are."""
        id_ = CHILDREN.get(name)
        if ROW not in rows.columns:
            return rows
        starts = self.spark.read.schema("name string, part long, start long, batch int").parquet(f"{self.path}/starts")
        starts = broadcast_if_small(starts.where(F.col("name") == name).drop("name"))
        placed = rows.withColumn("part", F.shiftright(ROW, ROW_BITS)).join(starts, ["batch", "part"], "left")
        return placed.withColumn(id_, F.coalesce(id_, row_ids(F.col("start")))).drop(ROW, "part", "start")

    def last_batch(self) -> int:
        try:
            done = self.spark.read.parquet(f"{self.path}/commits").agg(F.max("done")).first()[0]
        except AnalysisException:
            done = None
        return -1 if done is None else done

    def _log(self, name: str) -> DataFrame:
        """All committed rows of a table with their batch as ``src_ord``."""
        log = self._numbered(self.spark.read.parquet(f"{self.path}/{name}"), name).where(F.col("batch") <= self.last_batch())
        return log.withColumn("src_ord", F.col("batch").cast("int")).drop("batch")

    def tables(self) -> dict[str, DataFrame]:
        """The store as it stands after the last committed batch."""
        analyses = self._log("pr_analyses")
        return {
            "pr_analyses": merge_analyses(analyses).drop("src_ord"),
            "facts": merge_children(self._log("facts"), analyses, "fact_id").drop("src_ord"),
            "dependencies": merge_children(self._log("dependencies"), analyses, "dep_id").drop("src_ord"),
        }

    def index(self) -> TextIndex:
        """The index as it stands: postings of replaced facts are filtered out on read.

        Only replaced facts are listed, and only their ids; postings stay where they are as
        long as that list is small.
        """
        docs = self._log("docs")
        owned = key_lookup(docs, last_owner(self._log("pr_analyses")), KEY, "left", "fact_id")
        marked = materialise(owned.withColumn("gone", F.coalesce(F.col("src_ord") < F.col("max_ord"), F.lit(False))), "docs")
        listed = marked.where("gone").select("fact_id")
        gone = hashed(broadcast_if_small(listed), listed)
        live = marked.where("NOT gone").select("fact_id", "pr_id", "repo", "doc_len")
        postings = self._log("postings").drop("src_ord").join(gone, "fact_id", "left_anti")
        return TextIndex(live, postings, vocabulary_rows(postings), statistics_row(live), self.shards)

    def _live_docs(self) -> DataFrame:
        return merge_children(self._log("docs"), self._log("pr_analyses"), "fact_id").drop("src_ord")

    def compact(self, path: str) -> StreamStore:
        """A store under ``path`` that holds the live rows as one batch.

        It carries the last batch number, so the stream can go on from there.
        """
        last, other = self.last_batch(), StreamStore(self.spark, path, self.indexed, self.shards)
        live = self.tables()
        if self.indexed:
            live["docs"] = self._live_docs()
            other._write_postings(self.index().postings, last)
        for name, rows in live.items():
            if name in CHILDREN:
                rows = rows.withColumn(ROW, F.lit(None).cast("long"))
            other._write(rows, name, last)
        other._write(self.spark.createDataFrame([], "name string, part long, start long"), "starts", last)
        other._commit(last, self._next_ids(last + 1))
        return other


def _unnumbered(rows: DataFrame, id_: str) -> DataFrame:
    """Children as they are written: ids follow from the number of each row."""
    return rows.select(F.lit(None).cast("long").alias(id_), *rows.columns, F.monotonically_increasing_id().alias(ROW))


def run_stream(
    arrivals: DataFrame, store: StreamStore, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Start saving a stream of nested analyses (``ARRIVAL_SCHEMA``) into the store."""
    return (
        arrivals.writeStream.foreachBatch(lambda batch, batch_id: store.write_batch(batch, batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
