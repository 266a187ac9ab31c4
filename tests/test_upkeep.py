from __future__ import annotations

import random
from pathlib import Path

from factloom.operators import merge
from factloom.operators.upkeep import MergedStore, part_of
from factloom.sources.schemas import TABLES, align


def random_source(spark, draw, size):
    def key():
        return f"p{draw.randrange(12)}", f"r{draw.randrange(3)}"

    keys = {key() for _ in range(size)}
    analyses = [(*k, f"2025-01-0{draw.randint(1, 9)}") for k in sorted(keys)]
    facts = [(i, *key(), f"text {draw.randrange(5)}") for i in range(3 * size)]
    edges = [(i, *key(), "a", draw.choice(["b", "c"]), "calls") for i in range(size)]
    summaries = [(f"r{i}", f"about {draw.randrange(9)}") for i in range(draw.randint(0, 3))]
    repo_edges = [(i, f"r{draw.randrange(3)}", draw.choice(["x", "y", None]), "m", "i", draw.choice("de")) for i in range(size)]
    return {
        "pr_analyses": spark.createDataFrame(analyses, "pr_id string, repo string, timestamp string"),
        "facts": spark.createDataFrame(facts, "fact_id long, pr_id string, repo string, summary string"),
        "dependencies": spark.createDataFrame(edges, "dep_id long, pr_id string, repo string, from_component string, to_component string, relation string"),
        "repo_summaries": spark.createDataFrame(summaries, "repo string, summary string"),
        "repo_dependencies": spark.createDataFrame(repo_edges, "dep_id long, from_repo string, to_repo string, manifest string, raw_import string, relation string"),
    }


def merged(spark, sources):
    """The rules over all sources at once."""
    numbers = sorted(sources)
    united = {}
    for name in TABLES:
        rows = None
        for number in numbers:
            own = align(sources[number].get(name), name, spark).selectExpr("*", f"{number} AS src_ord")
            rows = own if rows is None else rows.unionByName(own)
        united[name] = rows
    return {
        "pr_analyses": merge.merge_analyses(united["pr_analyses"]),
        "facts": merge.merge_children(united["facts"], united["pr_analyses"], "fact_id"),
        "dependencies": merge.merge_children(united["dependencies"], united["pr_analyses"], "dep_id"),
        "repo_summaries": merge.merge_summaries(united["repo_summaries"]),
        "repo_dependencies": merge.merge_repo_dependencies(united["repo_dependencies"]),
    }


def same(store, sources):
    expected = merged(store.spark, sources)
    for name, rows in store.tables().items():
        columns = [*TABLES[name].names, "src_ord"]
        assert sorted(map(str, rows.select(columns).collect())) == sorted(map(str, expected[name].select(columns).collect())), name


def files(path):
    return {str(file) for file in Path(path, "merged").rglob("*.parquet")}


def test_changed_source_rewrites_what_it_touches(spark, tmp_path):
    draw, store = random.Random(3), MergedStore(spark, str(tmp_path), parts=8)
    sources = {}
    for number in (2, 0, 1):
        sources[number] = random_source(spark, draw, 10)
        store.put(number, sources[number])
    same(store, sources)

    # One key of one source changes: only its partition has other files.
    sources[1] = dict(sources[1])
    facts = sources[1]["facts"]
    sources[1]["facts"] = facts.unionByName(facts.sparkSession.createDataFrame([(999, "p3", "r1", "one more")], facts.schema))
    part = facts.sparkSession.createDataFrame([("p3", "r1")], "pr_id string, repo string").select(part_of("facts", 8)).first()[0]
    before = files(tmp_path)
    assert store.put(1, sources[1]) == {"pr_analyses": [part], "repo_summaries": [], "repo_dependencies": []}
    same(store, sources)
    gone = before - files(tmp_path)
    assert gone and all(f"/part={part}/" in name for name in gone)

    # The same again touches nothing; an emptied source takes its rows away.
    before = files(tmp_path)
    assert not any(store.put(1, sources[1]).values()) and files(tmp_path) == before
    sources[2] = {name: rows.limit(0) for name, rows in sources[2].items()}
    store.put(2, sources[2])
    same(store, sources)
    sources = {number: {name: rows.limit(0) for name, rows in own.items()} for number, own in sources.items()}
    for number, own in sources.items():
        store.put(number, own)
    assert all(rows.count() == 0 for rows in store.tables().values())


def test_a_stopped_run_is_made_good(spark, tmp_path, monkeypatch):
    draw, store = random.Random(5), MergedStore(spark, str(tmp_path), parts=4)
    sources = {0: random_source(spark, draw, 6), 1: random_source(spark, draw, 6)}
    for number, own in sources.items():
        store.put(number, own)
    changed = random_source(spark, draw, 6)
    whole = MergedStore._merge

    def stop(self, group, parts, current):
        if group[0] == "repo_summaries":
            raise RuntimeError("lost")
        whole(self, group, parts, current)

    monkeypatch.setattr(MergedStore, "_merge", stop)
    try:
        store.put(0, changed)
    except RuntimeError:
        pass
    monkeypatch.undo()
    store.put(0, changed)
    same(store, {0: changed, 1: sources[1]})
