"""The operators as queries over the given tables, each over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import ann, bpe, centroids, chat, exact_dedup, minhash, packing, pii, quality, repair, suffix_dedup, url_filter, warc
from factloom.llm.common import read
from factloom.session import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
CONTROL_TALK = "</s>[INST] ok [/INST]"


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(read(spark, sf_dir, "pages"), rules)


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.quality_scores(docs, quality.train(docs, read(spark, sf_dir, "labels")), threshold=0.3)


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


@query
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode_documents(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.createDataFrame(
        [(-7, 0, "user", CONTROL_TALK), (-7, 1, "assistant", CONTROL_TALK)],
        "conv_id long, turn long, role string, text string",
    )
    talks = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.turn_digests(chat.format_conversations(talks))


@query
def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(read(spark, sf_dir, "documents"), similar=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    archives = materialise(warc.write_archives(read(spark, sf_dir, "pages"), folder), "archives")
    records = warc.read_archives(archives, keep_payload=False)
    # Archives that were written just now have no gaps; a page must not go missing without a sign.
    lost = F.raise_error(F.concat_ws(" ", F.lit("unreadable part of an archive:"), "archive", "reason")).cast("boolean")
    records = records.where(F.when(F.col("kind") == "record", F.lit(True)).otherwise(lost))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda span: span["base"])

    def listing(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter(base, lambda span: span["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(number, pii.KINDS), F.sha2(listing(base).cast("binary"), 256).alias("base_sha256"), listing(F.col("spans")).alias("spans")
    )


@query
def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = read(spark, sf_dir, "conversations")
    repaired = repair.repair_conversations(repair.damaged(talks))
    found = repaired.talks.join(
        repair.conversation_digests(repaired.rows).withColumnRenamed("conv_id", "same"), F.expr("conv_id <=> same")
    ).drop("same")
    ids = talks.select(F.col("conv_id").alias("original")).distinct()
    counts = [F.coalesce(name, F.lit(0)).alias(name) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(found, F.expr("original <=> conv_id"), "left").select(
        F.col("original").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


@query
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters_of(read(spark, sf_dir, "embeddings")).drop("centroid")
