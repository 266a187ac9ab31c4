"""Inverted index over the text columns of facts, stored as Parquet tables.

Five tables, all derived from per-document rows so that they can be kept up to
date without storing scores:

``postings``  one row per (token, fact): occurrences per column, positions, and
              the few attributes that filters and ranking need, so that a search
              reads only the postings of its own words and joins nothing big.
``docs``      one row per fact: key and length in tokens.
``vocab``     one row per token, with its stem.
``frequency`` one row per token and segment: in how many facts it stands. Segments add
              up; what an update removes comes as negative numbers.
``stats``     one row: number of facts and their total length.

``postings`` is partitioned by a hash of the token and sorted by (token, fact)
inside each file, so a token is found by partition pruning and Parquet
statistics. Files are cut by size at run time: a shard with a very frequent
token is spread over as many files, and written by as many tasks, as it needs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.porter import stem_udf
from factloom.functions.text import token_count, tokens
from factloom.operators.grams import gram_rows
from factloom.operators.skew import broadcast_if_small, key_lookup
from factloom.session import materialise, scratch_path

# Indexed columns in order, with their ranking weights.
COLUMN_WEIGHTS = {"summary": 10.0, "detail": 5.0, "symbols_text": 15.0}

# Positions of column i are shifted by i * COLUMN_SPAN, so that one list per
# posting holds all columns and neighbours never cross a column border.
COLUMN_SPAN = 1 << 28

ATTRIBUTES = ["repo", "category", "confidence", "source", "ts", "linked"]
POSTING_SCHEMA = (
    "token string, fact_id long, doc_len long, repo string, category string, confidence double, source string,"
    " ts timestamp, linked boolean, tf0 int, tf1 int, tf2 int, positions array<int>, shard int"
)
FREQUENCY_SCHEMA = "token string, df long, shard int"
FACTS_PER_SHARD = 100_000
# Words of whole facts that are grouped into postings at one time, about.
WORDS_AT_ONCE = 200_000


def shard_of(token: Column, shards: int) -> Column:
    return F.pmod(F.crc32(token.cast("binary")), F.lit(shards)).cast("int")


def shard_number(token: str, shards: int) -> int:
    """The same on the driver, for pruning by literal."""
    return zlib.crc32(token.encode("utf-8")) % shards


def tokenise(facts: DataFrame) -> DataFrame:
    """One row per token occurrence: (fact_id, col, pos, token)."""
    columns = F.array(
        *[F.struct(F.lit(i).alias("col"), tokens(F.col(name)).alias("words")) for i, name in enumerate(COLUMN_WEIGHTS)]
    )
    return (
        facts.select("fact_id", F.explode(columns).alias("c"))
        .select("fact_id", F.col("c.col").alias("col"), F.posexplode("c.words").alias("pos", "token"))
    )


def link_attributes(facts: DataFrame, analyses: DataFrame) -> DataFrame:
    """Facts with the analysis time ranking needs; orphans keep ``linked = false``."""
    keys = analyses.select("pr_id", "repo", "ts", F.lit(True).alias("linked"))
    joined = key_lookup(facts, keys, ["pr_id", "repo"], "left", spread="fact_id")
    return joined.withColumn("linked", F.coalesce("linked", F.lit(False)))


def document_rows(facts: DataFrame) -> DataFrame:
    """Key and token count of every fact, also of empty ones."""
    length = sum(token_count(F.col(name)) for name in COLUMN_WEIGHTS)
    return facts.select("fact_id", "pr_id", "repo", length.cast("long").alias("doc_len"))


def posting_rows(linked_facts: DataFrame) -> DataFrame:
    """Postings of facts that already carry the ranking attributes.

    All occurrences of a fact come from one input row, so they are grouped by
    token inside the Arrow batch that holds it: words become numbers, (fact, word)
    pairs are sorted and cut where they change. Nothing is shuffled or aggregated.
    Rows of about ``WORDS_AT_ONCE`` words are grouped at one time.
    """
    width, at_once = range(len(COLUMN_WEIGHTS)), WORDS_AT_ONCE
    span, names = COLUMN_SPAN, ["fact_id", *ATTRIBUTES]
    split = linked_facts.select(*names, *[tokens(F.col(name)).alias(f"t{i}") for i, name in enumerate(COLUMN_WEIGHTS)])

    def grouped(rows: pa.RecordBatch, counts: list[np.ndarray]) -> pa.RecordBatch:
        words = pa.concat_arrays([rows.column(f"t{i}").flatten() for i in width]).dictionary_encode()
        row = np.concatenate([np.repeat(np.arange(rows.num_rows), n) for n in counts])
        column = np.repeat(np.arange(len(counts)), [n.sum() for n in counts])
        place = np.concatenate(
            [np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + i * span for i, n in enumerate(counts)]
        )
        pair = row * len(words.dictionary) + words.indices.to_numpy(zero_copy_only=False)
        # Stable, so that the places of a word stay in order.
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        owner = row[order[starts]]
        found = {name: rows.column(name).take(pa.array(owner)) for name in names}
        found["token"] = words.dictionary.take(pa.array(pair[starts] - owner * len(words.dictionary)))
        found["doc_len"] = pa.array(sum(counts)[owner].astype(np.int64))
        for i in width:
            found[f"tf{i}"] = pa.array(np.add.reduceat(column[order] == i, starts, dtype=np.int32))
        ends = pa.array(np.append(starts, len(pair)).astype(np.int32))
        found["positions"] = pa.ListArray.from_arrays(ends, pa.array(place[order].astype(np.int32)))
        return pa.RecordBatch.from_pydict({name: found[name] for name in out})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [np.diff(batch.column(f"t{i}").offsets.to_numpy()).astype(np.int64) for i in width]
            before = np.concatenate([[0], np.cumsum(sum(counts))])
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(before, before[low] + at_once, side="right")) - 1)
                if before[high] > before[low]:
                    yield grouped(batch.slice(low, high - low), [n[low:high] for n in counts])
                low = high

    out = ["token", "fact_id", "doc_len", *ATTRIBUTES, *[f"tf{i}" for i in width], "positions"]
    kinds = {"token": "string", "doc_len": "long", "positions": "array<int>", **{f"tf{i}": "int" for i in width}}
    kinds |= {name: split.schema[name].dataType.simpleString() for name in names}
    return split.mapInArrow(run, ", ".join(f"{name} {kinds[name]}" for name in out))


def frequency_rows(postings: DataFrame) -> DataFrame:
    """(token, df, shard) of stored postings; a token's postings lie in one shard."""
    return postings.groupBy("token", "shard").agg(F.count(F.lit(1)).alias("df")).select("token", "df", "shard")


def vocabulary_rows(postings: DataFrame) -> DataFrame:
    """Distinct tokens with their stem; the UDF sees each token once."""
    return postings.select("token").distinct().withColumn("stem", stem_udf("token"))


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def statistics_row(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total_len"))


@dataclass(frozen=True)
class TextIndex:
    docs: DataFrame
    postings: DataFrame
    vocab: DataFrame
    stats: DataFrame
    shards: int
    # Not kept by every index: frequencies (else counted from matches), grams of the vocabulary (else made when needed).
    frequency: DataFrame | None = None
    grams: DataFrame | None = None

    @cached_property
    def size(self) -> tuple[int, float]:
        """Number of facts and average length in tokens (one stored row)."""
        row = self.stats.first()
        return row["n"], (row["total_len"] / row["n"] if row["n"] else 0.0)


def write_index(docs: DataFrame, postings: DataFrame, path: str, shards: int | None = None) -> TextIndex:
    """Store index tables derived from ``docs`` and ``postings`` under ``path``."""
    spark = docs.sparkSession
    docs.write.parquet(f"{path}/docs")
    docs = spark.read.parquet(f"{path}/docs")
    totals = statistics_row(docs).first()
    if shards is None:
        shards = max(8, -(-totals["n"] // FACTS_PER_SHARD))
    row = (totals["n"], totals["total_len"], shards)
    spark.createDataFrame([row], "n long, total_len long, shards int").coalesce(1).write.parquet(f"{path}/stats")
    (
        postings.withColumn("shard", shard_of(F.col("token"), shards))
        .hint("rebalance", "shard")
        .sortWithinPartitions("shard", "token", "fact_id")
        .write.partitionBy("shard")
        .parquet(f"{path}/postings")
    )
    stored = spark.read.schema(POSTING_SCHEMA).parquet(f"{path}/postings")
    (
        frequency_rows(stored).hint("rebalance", "shard").sortWithinPartitions("shard", "token")
        .write.partitionBy("shard").parquet(f"{path}/frequency")
    )
    counted = spark.read.schema(FREQUENCY_SCHEMA).parquet(f"{path}/frequency")
    # Every token is there once, so nothing has to be made distinct again.
    vocab = counted.select("token").withColumn("stem", stem_udf("token"))
    vocab.hint("rebalance").sortWithinPartitions("stem").write.parquet(f"{path}/vocab")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> TextIndex:
    """An index written before."""
    stats = spark.read.parquet(f"{path}/stats")
    parts = {name: spark.read.parquet(f"{path}/{name}") for name in ("docs", "vocab")}
    postings = spark.read.schema(POSTING_SCHEMA).parquet(f"{path}/postings")
    return TextIndex(
        postings=postings, stats=stats.select("n", "total_len"), shards=stats.first()["shards"],
        frequency=_stored(spark, f"{path}/frequency", FREQUENCY_SCHEMA),
        grams=_stored(spark, f"{path}/grams", "gram string, value string"), **parts,
    )


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A table that not every index has."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return None


def with_grams(index: TextIndex, path: str | None = None) -> TextIndex:
    """The index with the three-character grams of its vocabulary as a table sorted by gram, for substring searches."""
    path = f"{path or scratch_path(index.vocab.sparkSession, 'index')}/grams"
    rows = gram_rows(index.vocab.select(F.col("token").alias("value")).distinct())
    rows.hint("rebalance", "gram").sortWithinPartitions("gram", "value").write.parquet(path)
    return replace(index, grams=index.vocab.sparkSession.read.parquet(path))


def build_index(facts: DataFrame, analyses: DataFrame, path: str | None = None) -> TextIndex:
    """Index all facts (orphans too: they count in the statistics but are never returned)."""
    path = path or scratch_path(facts.sparkSession, "index")
    return write_index(document_rows(facts), posting_rows(link_attributes(facts, analyses)), path)


def update_index(
    index: TextIndex, removed: DataFrame, added: DataFrame, analyses: DataFrame, path: str | None = None
) -> TextIndex:
    """Index after ``removed`` (fact_id) left and ``added`` facts arrived.

    Only the added facts are indexed, into a segment of their own; stored
    postings are not rewritten but filtered by the removed ids when read. The
    statistics follow from the per-document rows that came and went, frequencies from
    the words of the removed facts (their texts if ``removed`` has them, else their
    postings). Words that no fact holds any more stay in the vocabulary, where they
    match nothing.
    """
    spark = index.docs.sparkSession
    path = path or scratch_path(spark, "segment")
    gone = materialise(removed.select("fact_id").distinct(), "removed")
    segment = write_index(
        document_rows(added), posting_rows(link_attributes(added, analyses)), path, shards=index.shards
    )
    out = broadcast_if_small(gone)
    went = index.docs.join(out, "fact_id", "left_semi")
    left = statistics_row(went)
    change = left.select((-F.col("n")).alias("n"), (-F.col("total_len")).alias("total_len"))
    stats = index.stats.unionByName(change).unionByName(segment.stats).agg(
        F.sum("n").alias("n"), F.sum("total_len").alias("total_len")
    )
    frequency = grams = None
    if index.frequency is not None:
        lost = materialise(_lost_frequency(index, removed, went.select("fact_id")), "lost-frequency")
        frequency = index.frequency.unionByName(lost).unionByName(segment.frequency)
    if index.grams is not None:
        added_words = segment.vocab.select(F.col("token").alias("value"))
        grams = index.grams.unionByName(materialise(gram_rows(added_words), "added-grams")).distinct()
    return TextIndex(
        index.docs.join(out, "fact_id", "left_anti").unionByName(segment.docs),
        index.postings.join(hashed(out, gone), "fact_id", "left_anti").unionByName(segment.postings),
        index.vocab.unionByName(segment.vocab).distinct(),
        materialise(stats, "stats"),
        index.shards,
        frequency,
        grams,
    )


def hashed(out: DataFrame, gone: DataFrame) -> DataFrame:
    """A list of ids that is not broadcast becomes a hash table per task, so that the rows that meet it are not sorted."""
    return out if out is not gone else gone.hint("shuffle_hash")


def _lost_frequency(index: TextIndex, removed: DataFrame, went: DataFrame) -> DataFrame:
    """(token, df, shard) with negative numbers: the words of facts that leave the index."""
    if {*COLUMN_WEIGHTS, "fact_id"} <= set(removed.columns):
        # Only ids that come several times have rows to choose from; other texts stay where they are, or move once.
        ids = removed.groupBy("fact_id").agg(F.count(F.lit(1)).alias("rows")).join(went, "fact_id", "left_semi")
        ids = materialise(ids, "removed-ids")
        once, repeated = ids.where(F.col("rows") == 1).select("fact_id"), ids.where(F.col("rows") > 1).select("fact_id")
        texts = removed.select("fact_id", *COLUMN_WEIGHTS).join(hashed(broadcast_if_small(once), once), "fact_id", "left_semi")
        if repeated.take(1):
            several = key_lookup(removed.select("fact_id", *COLUMN_WEIGHTS), repeated, ["fact_id"], "left_semi", "fact_id")
            texts = texts.unionByName(several.dropDuplicates(["fact_id"]))
        words = F.array_distinct(F.concat(*[tokens(F.col(name)) for name in COLUMN_WEIGHTS]))
        held = texts.select(F.explode(words).alias("token"))
    else:
        held = index.postings.join(broadcast_if_small(went), "fact_id", "left_semi").select("token")
    counts = held.groupBy("token").agg((-F.count(F.lit(1))).alias("df"))
    return counts.withColumn("shard", shard_of(F.col("token"), index.shards))


def frequency_of(index: TextIndex, tokens_: DataFrame) -> DataFrame:
    """(token, df) of a table of distinct tokens (token, shard), from the frequencies of all segments."""
    met = index.frequency.join(broadcast_if_small(tokens_), ["token", "shard"])
    return met.groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")


def compact_index(index: TextIndex, path: str | None = None) -> TextIndex:
    """The same index written as one, after many updates."""
    path = path or scratch_path(index.docs.sparkSession, "index")
    return write_index(index.docs, index.postings.drop("shard"), path)
