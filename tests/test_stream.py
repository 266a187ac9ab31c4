from __future__ import annotations

from pyspark.sql import functions as F
from test_merge import nested_row

from factloom.operators import index, search
from factloom.streaming.store import ARRIVAL_SCHEMA, StreamStore, run_stream


def rows(store):
    return sorted((r.pr_id, r.summary) for r in store.tables()["facts"].collect())


def test_stream_replaces_by_key_and_survives_replay(spark, tmp_path):
    landing, store = str(tmp_path / "landing"), StreamStore(spark, str(tmp_path / "store"), indexed=True)
    assert store.last_batch() == -1
    (tmp_path / "landing").mkdir()
    incoming = spark.readStream.schema(ARRIVAL_SCHEMA).json(landing)
    batches = [
        [nested_row("PR-1", 1, ["alpha one", "alpha two"]), nested_row("PR-2", 2, ["beta"])],
        [nested_row("PR-1", 3, ["gamma early"]), nested_row("PR-1", 4, ["gamma"]), nested_row("PR-3", 5, [])],
    ]
    for batch in batches:
        spark.createDataFrame(batch, ARRIVAL_SCHEMA).coalesce(1).write.mode("append").json(landing)
        run_stream(incoming, store, str(tmp_path / "offsets")).awaitTermination()
    expected = [("PR-1", "gamma"), ("PR-2", "beta")]
    assert rows(store) == expected
    assert store.tables()["pr_analyses"].count() == 3

    store.write_batch(spark.createDataFrame(batches[1], ARRIVAL_SCHEMA), 1)
    assert rows(store) == expected

    live = store.index()
    tables = store.tables()
    rebuilt = index.build_index(tables["facts"], tables["pr_analyses"])
    assert live.size == rebuilt.size
    columns = ["token", "fact_id", "doc_len", "positions"]
    assert live.postings.select(columns).exceptAll(rebuilt.postings.select(columns)).isEmpty()
    compact = store.compact(str(tmp_path / "compact"))
    assert rows(compact) == expected and compact.last_batch() == store.last_batch()
    compact.write_batch(spark.createDataFrame([nested_row("PR-2", 9, ["delta"])], ARRIVAL_SCHEMA), 2)
    assert rows(compact) == [("PR-1", "gamma"), ("PR-2", "delta")]
    for found in (live, index.compact_index(live), rebuilt):
        scores = search.score(found, ["gamma alpha beta"]).select("fact_id", F.round("score", 9)).collect()
        assert len(scores) == 2 and len({s[1] for s in scores}) >= 1


def test_uncommitted_batch_is_invisible(spark, tmp_path):
    store = StreamStore(spark, str(tmp_path / "store"))
    store.write_batch(spark.createDataFrame([nested_row("PR-1", 1, ["kept"])], ARRIVAL_SCHEMA), 0)
    half = store.tables()["pr_analyses"].drop("src_ord")
    half.write.parquet(str(tmp_path / "store" / "pr_analyses" / "batch=1"))
    assert rows(store) == [("PR-1", "kept")]


def test_bad_arrivals_are_put_aside(spark, tmp_path):
    """An unreadable time neither stops the batch nor reaches the tables; the rest of the batch is saved."""
    store = StreamStore(spark, str(tmp_path / "store"), indexed=True)
    rows = spark.createDataFrame([nested_row("PR-1", 1, ["kept"]), nested_row("PR-2", 2, ["late"])], ARRIVAL_SCHEMA)
    rows = rows.withColumn("timestamp", F.when(F.col("pr_id") == "PR-2", "soon").otherwise(F.col("timestamp")))
    store.write_batch(rows, 0)
    assert [pr_id for pr_id, _ in sorted((r.pr_id, r.summary) for r in store.tables()["facts"].collect())] == ["PR-1"]
    rejects = spark.read.parquet(str(tmp_path / "store" / "rejects")).collect()
    assert [(r.pr_id, r.reason) for r in rejects] == [("PR-2", "unreadable timestamp")]
    plan = store.index().postings.where("shard = 3")._jdf.queryExecution().executedPlan().toString()
    assert "shard" in plan.split("PartitionFilters")[1].split("]")[0]


def test_child_ids_are_unique_whatever_the_size_and_clock(spark, tmp_path):
    """More than 2^20 children, microsecond arrival numbers; replays and compact stores count on alike."""
    store, clock = StreamStore(spark, str(tmp_path / "store")), 1_700_000_000_000_000
    many = spark.createDataFrame([nested_row("PR-1", clock, ["x"]), nested_row("PR-2", clock + 1, ["y"])], ARRIVAL_SCHEMA)
    many = many.withColumn("facts", F.when(F.col("pr_id") == "PR-1", F.array_repeat(F.col("facts")[0], (1 << 20) + 5)).otherwise(F.col("facts")))
    store.write_batch(many, 0)
    more = spark.createDataFrame([nested_row("PR-3", clock + 2, ["a", "b"]), nested_row("PR-4", clock + 3, ["c"])], ARRIVAL_SCHEMA)
    for _ in range(2):
        store.write_batch(more, 1)
        ids = store.tables()["facts"].agg(F.count("fact_id"), F.countDistinct("fact_id"), F.min("fact_id"), F.max("fact_id")).first()
        assert tuple(ids) == ((1 << 20) + 9, (1 << 20) + 9, 0, (1 << 20) + 8)
    compact = store.compact(str(tmp_path / "compact"))
    compact.write_batch(spark.createDataFrame([nested_row("PR-4", clock + 9, ["d"])], ARRIVAL_SCHEMA), 2)
    assert compact.tables()["facts"].agg(F.max("fact_id")).first()[0] == (1 << 20) + 9
