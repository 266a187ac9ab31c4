"""The operators as steps of a document pipeline: documents in, documents out."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm import exact_dedup, minhash, packing, quality, suffix_dedup
from factloom.llm.common import bounded_batches, read
from factloom.operators.skew import broadcast_if_small, key_lookup
from factloom.session import materialise

QUALITY_THRESHOLD = 0.3
# Words that packing remembers here: fewer than alone, as executors still hold what the stages before it took.
REMEMBERED_WORDS = 150_000


def positional(docs: DataFrame) -> DataFrame:
    """The same rows under the names c0, c1 ...: columns that differ by case only, and helper columns, never meet."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def place(docs: DataFrame, name: str) -> str:
    """The name that ``positional`` gives to the column of exactly this name."""
    return f"c{docs.columns.index(name)}"


def named(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of the documents, under their own names."""
    return changed.select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def text_sha(column: str) -> Column:
    return F.sha2(F.coalesce(F.col(column), F.lit("")).cast("binary"), 256)


def survivors(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """The rows that a verdict (doc_id, text_sha256, kept; one row per document) keeps, one row per id and text.

    So rows that repeat both id and text are thinned out to one, too. Only ids with a
    decision to carry out are joined: broadcast if small, else shuffled.
    """
    pairs = (
        verdict.groupBy("doc_id", "text_sha256")
        .agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept"))
        .where(~F.col("kept") | (F.col("n") > 1))
    )
    pairs = materialise(pairs.select("doc_id", "text_sha256", "kept").toDF("decided_id", "decided_sha", "mark"), "decided")
    listed = broadcast_if_small(pairs)
    own_id = place(docs, "doc_id")
    tagged = positional(docs).withColumn("sha", text_sha(place(docs, "text")))
    same = F.col(own_id).eqNullSafe(F.col("decided_id")) & (F.col("sha") == F.col("decided_sha"))
    if not pairs.where("mark").take(1):
        return named(tagged.join(listed, same, "left_anti"), docs)
    joined = tagged.join(listed, same, "left")
    plain = joined.where(F.col("mark").isNull())
    # Of repeated rows one stays; each task first keeps one of its own.
    first = Window.partitionBy(own_id, "sha").orderBy(F.lit(0))
    one_each = joined.where("mark").withColumn("number", F.row_number().over(first)).where("number = 1")
    return named(plain.unionByName(one_each.drop("number")), docs)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches QUALITY_THRESHOLD; the network learns from the labels beside them.

    A null text is scored as an empty one; null ids and repeated rows are judged like
    others; an empty table stays empty.
    """
    bounded_batches(spark)
    net = quality.train(docs, read(spark, sf_dir, "labels"))
    scored = positional(docs).withColumn("score", quality.scorer(net)(place(docs, "text")))
    return named(scored.where(F.col("score") >= QUALITY_THRESHOLD), docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the largest doc_id.

    A null text equals an empty one; null ids are below all others; of rows that repeat
    id and text one stays; an empty table stays empty.
    """
    return survivors(docs, exact_dedup.exact_duplicates(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity of 0.8 or more): that with the smallest doc_id.

    Several texts under that id, or null ids only: that of them with the smallest hash.
    Texts without words stay, also null ones; of rows that repeat id and text one stays;
    an empty table stays empty.
    """
    return survivors(docs, minhash.first_of_components(docs))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 200 bytes or more that occur elsewhere; ``n_chars`` follows the text.

    A document stays even if nothing of its text does, as does one with a null text or
    id. Repeated rows all lose what they share. An empty table stays empty.
    """
    marks = materialise(suffix_dedup.repeated_spans(docs), "spans").toDF("sha", "spans")
    text = place(docs, "text")
    marked = key_lookup(positional(docs).withColumn("sha", text_sha(text)), marks, ["sha"], "left", place(docs, "doc_id"))
    changed = marked.withColumn(text, suffix_dedup.kept_text(F.col(text), F.col("spans")))
    if "n_chars" in docs.columns:
        size = place(docs, "n_chars")
        kind = docs.schema["n_chars"].dataType
        own = F.when(F.col("spans").isNull(), F.col(size)).otherwise(F.length(text).cast(kind))
        changed = changed.withColumn(size, own)
    return named(changed, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences; nulls, repeated rows and empty tables as in ``pack_documents``."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=REMEMBERED_WORDS)
