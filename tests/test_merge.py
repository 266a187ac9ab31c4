from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import analyses as nested_ops
from factloom.operators import merge, skew
from factloom.sources.schemas import align
from factloom.streaming.store import ARRIVAL_SCHEMA

CASES = 60


def random_sources(seed):
    """Many independent cases in one table: the case number is part of the repository name."""
    rnd = random.Random(seed)
    analyses, facts = [], []
    for case in range(CASES):
        for src in range(rnd.randint(1, 4)):
            for key in range(4):
                if rnd.random() < 0.4:
                    analyses.append((src, f"p{key}", f"r{case}", f"a{src}"))
                for n in range(rnd.randint(0, 2)):
                    facts.append((src, len(facts), f"p{key}", f"r{case}"))
    return analyses, facts


def fold(analyses, facts):
    """Left-to-right merge, one source at a time."""
    kept_facts, kept_analyses = [], {}
    for src in sorted({row[0] for row in analyses} | {row[0] for row in facts}):
        incoming = {(a[1], a[2]): a for a in analyses if a[0] == src}
        kept_analyses.update(incoming)
        kept_facts = [f for f in kept_facts if (f[2], f[3]) not in incoming]
        kept_facts += [f for f in facts if f[0] == src]
    return sorted(kept_analyses.values()), sorted(kept_facts)


@pytest.mark.parametrize("broadcast_rows", [0, 200_000])
def test_closed_form_equals_fold(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", broadcast_rows)
    analyses, facts = random_sources(7)
    a = spark.createDataFrame(analyses, "src_ord int, pr_id string, repo string, mark string")
    f = spark.createDataFrame(facts, "src_ord int, fact_id long, pr_id string, repo string")
    expected_analyses, expected_facts = fold(analyses, facts)
    for split in (1, 1_000_000):
        merged = merge.merge_children(f, a, "fact_id", rows_per_split=split)
        assert sorted((r.src_ord, r.fact_id, r.pr_id, r.repo) for r in merged.collect()) == expected_facts
    found = merge.merge_analyses(a).collect()
    assert sorted((r.src_ord, r.pr_id, r.repo, r.mark) for r in found) == expected_analyses


def test_first_edge_wins_and_null_keys_never_collide(spark):
    rows = [
        (0, 1, "a", "b", "m", "i", "x"), (1, 1, "a", "b", "m", "i", "y"), (1, 2, "a", "c", "m", "i", "z"),
        (0, 3, "a", None, "m", "i", "x"), (1, 3, "a", None, "m", "i", "x"),
    ]
    edges = spark.createDataFrame(
        rows, "src_ord int, dep_id long, from_repo string, to_repo string, manifest string, raw_import string, relation string"
    )
    found = sorted((r.to_repo or "", r.relation, r.src_ord) for r in merge.merge_repo_dependencies(edges).collect())
    assert found == [("", "x", 0), ("", "x", 1), ("b", "x", 0), ("c", "z", 1)]


def test_later_summary_wins_whatever_its_date(spark):
    rows = spark.createDataFrame(
        [("r", "new", "2025", 0), ("r", "old", "2020", 1)], "repo string, summary string, updated_at string, src_ord int"
    )
    assert merge.merge_summaries(rows).first()["summary"] == "old"


def snapshot(spark, key, summary, ts="2025-01-01 00:00:00"):
    analyses = spark.createDataFrame([(key, "r", ts)], "pr_id string, repo string, ts string")
    facts = spark.createDataFrame(
        [(1, key, "r", "behavior", summary, "d", 0.9, "scan")],
        "fact_id long, pr_id string, repo string, category string, summary string, detail string, confidence double, source string",
    )
    return {"pr_analyses": analyses.withColumn("ts", F.to_timestamp("ts")), "facts": facts}


def test_merge_store(spark):
    assert merge.merge_store([]) == {}
    one = merge.merge_store([snapshot(spark, "SCAN:a", "only")])
    assert one["facts"].first()["summary"] == "only"
    assert one["dependencies"].count() == 0 and one["repo_dependencies"].columns[1] == "from_repo"
    three = merge.merge_store(
        [snapshot(spark, "SCAN:a", "first"), snapshot(spark, "SCAN:b", "other"), snapshot(spark, "SCAN:a", "second")]
    )
    rows = three["facts"].orderBy("fact_id").collect()
    assert [(r.pr_id, r.summary) for r in rows] == [("SCAN:b", "other"), ("SCAN:a", "second")]
    assert len({r.fact_id for r in rows}) == 2
    assert three["pr_analyses"].count() == 2


def test_align_fills_old_layouts(spark):
    old = spark.createDataFrame([("p", "r", None)], "pr_id string, repo string, symbols array<string>")
    row = align(old, "facts").first()
    assert (row.symbols, row.source_files, row.symbols_text, row.summary) == ([], [], "[]", None)
    assert align(None, "repo_summaries", spark).count() == 0
    assert align(old.drop("symbols"), "pr_analyses").first().triggered_by is None


def nested_row(pr_id, arrival, summaries, repo="r"):
    facts = [("behavior", s, "detail", 0.5, None, ["f.py"], ["Class.method"]) for s in summaries]
    edges = [("a", "b", "calls")]
    return (pr_id, repo, "2025-03-01T00:00:00Z", (pr_id, ["f.py"], ["fix"]), edges, facts, arrival)


def empty_store(spark):
    return {name: align(None, name, spark) for name in ("pr_analyses", "facts", "dependencies")}


@pytest.mark.parametrize("broadcast_rows", [0, 200_000])
def test_replace_analyses(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", broadcast_rows)
    batch = [nested_row("PR-1", 1, ["old"]), nested_row("PR-2", 2, ["x", "y"]), nested_row("PR-1", 3, ["new", "newer"])]
    store = nested_ops.replace_analyses(empty_store(spark), spark.createDataFrame(batch, ARRIVAL_SCHEMA))
    assert sorted(r.summary for r in store["facts"].collect()) == ["new", "newer", "x", "y"]
    assert store["dependencies"].count() == 2
    row = store["facts"].first()
    assert (row.source, row.symbols_text) == ("ai", '["Class.method"]')

    again = nested_ops.replace_analyses(store, spark.createDataFrame([nested_row("PR-2", 4, [])], ARRIVAL_SCHEMA))
    assert sorted(r.summary for r in again["facts"].collect()) == ["new", "newer"]
    assert again["pr_analyses"].count() == 2
    assert again["pr_analyses"].where("triggered_by IS NOT NULL").count() == 0


@pytest.mark.parametrize("broadcast_rows", [0, 200_000])
def test_nested_parts_hold_everything_once(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", broadcast_rows)
    batch = [nested_row("PR-1", 1, [f"s{i}" for i in range(25)]), nested_row("PR-2", 2, [])]
    store = nested_ops.replace_analyses(empty_store(spark), spark.createDataFrame(batch, ARRIVAL_SCHEMA))
    parts = nested_ops.nested_analyses(store["pr_analyses"], store["facts"], store["dependencies"], part_rows=4).collect()
    first = [p for p in parts if p.pr_id == "PR-1"]
    assert len(first) == 7
    assert sorted(f.summary for p in first for f in p.facts) == sorted(f"s{i}" for i in range(25))
    assert sum(len(p.dependencies) for p in first) == 1
    (second,) = [p for p in parts if p.pr_id == "PR-2"]
    assert second.facts == [] and len(second.dependencies) == 1
    one = nested_ops.get_analysis(store["pr_analyses"], store["facts"], store["dependencies"], "PR-1").collect()
    assert len(one) == 1 and len(one[0].facts) == 25
    assert nested_ops.get_analysis(store["pr_analyses"], store["facts"], store["dependencies"], "none").count() == 0


def test_ids_of_very_many_sources(spark):
    """Ids stay unique and in source order, however many sources there are and wherever their ids lie."""
    rows = spark.range(120_000).select(
        (F.col("id") % 40_000).cast("int").alias("src_ord"),
        F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") + (1 << 60)).alias("fact_id"),
    ).where("src_ord < 39000 or fact_id < 1000000")
    few = rows.where("fact_id < 1000000")
    numbered = merge.renumber(few, "fact_id")
    assert numbered.select("fact_id").distinct().count() == few.count()
    spans = numbered.groupBy("src_ord").agg(F.min("fact_id").alias("low"), F.max("fact_id").alias("high"))
    ordered = spans.orderBy("src_ord").collect()
    assert all(a.high < b.low for a, b in zip(ordered, ordered[1:]))
