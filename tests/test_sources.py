from __future__ import annotations

import sqlite3

import pytest
from pyspark.sql import functions as F

from factloom.operators.merge import merge_counts, merge_united
from factloom.operators.search import search
from factloom.plans.tools import KnowledgeBase
from factloom.sources import sinks, snapshots

TABLES = {
    "pr_analyses": "pr_id TEXT, repo TEXT, timestamp TEXT, files TEXT, kinds TEXT, triggered_by TEXT",
    "facts": "id INTEGER PRIMARY KEY, pr_id TEXT, repo TEXT, category TEXT, summary TEXT, detail TEXT, confidence REAL,"
             " source TEXT, source_files TEXT, symbols TEXT",
    "dependencies": "id INTEGER PRIMARY KEY, pr_id TEXT, repo TEXT, from_component TEXT, to_component TEXT, relation TEXT",
}


def make_file(path, pr_id, repo, summary, old=False, wal=False):
    db = sqlite3.connect(path)
    if wal:
        db.execute("PRAGMA journal_mode=WAL")
    for name, columns in TABLES.items():
        if old:
            columns = columns.replace(", triggered_by TEXT", "").replace(", symbols TEXT", "")
        db.execute(f"CREATE TABLE {name} ({columns})")
    analysis = [pr_id, repo, "2025-01-01T00:00:00Z", '["a.py"]', "[]", "PR-5"]
    fact = [None, pr_id, repo, "behavior", summary, "some detail", 0.95, "scan", '["a.py"]', '["Cls.run"]']
    for name, row in (("pr_analyses", analysis), ("facts", fact)):
        if old:
            row = row[:-1]
        db.execute(f"INSERT INTO {name} VALUES ({', '.join('?' * len(row))})", row)
    db.commit()
    db.close()


@pytest.fixture
def folder(tmp_path):
    make_file(tmp_path / "a.db", "SCAN:test", "test-repo", "test fact summary")
    make_file(tmp_path / "b.db", "SCAN:other", "other-repo", "other fact", old=True, wal=True)
    (tmp_path / "broken.db").write_bytes(b"not a database at all" * 100)
    (tmp_path / "notes.txt").write_text("ignored")
    return tmp_path


def test_folder_of_snapshots(spark, folder):
    files = snapshots.collect_sources(spark, local=str(folder))
    tables, rejects = snapshots.land_snapshots(files)
    assert [r.path.rsplit("/", 1)[1] for r in rejects.collect()] == ["broken.db"]
    facts = {r.repo: r for r in tables["facts"].collect()}
    assert facts["test-repo"].symbols == ["Cls.run"] and facts["test-repo"].source_files == ["a.py"]
    assert facts["other-repo"].symbols == [] and facts["other-repo"].symbols_text == "[]"
    analyses = {r.repo: r for r in tables["pr_analyses"].collect()}
    assert analyses["other-repo"].triggered_by is None and analyses["test-repo"].triggered_by == "PR-5"
    assert analyses["test-repo"].ts.year == 2025 and analyses["test-repo"].files == ["a.py"]
    assert tables["repo_dependencies"].count() == 0


def test_source_list_rules(spark, folder, tmp_path_factory):
    empty = tmp_path_factory.mktemp("empty")
    assert snapshots.collect_sources(spark) is None
    assert snapshots.collect_sources(spark, local=f" ,{folder}/missing.db") is None
    files = snapshots.collect_sources(
        spark, local=f"{folder}/a.db, ,{folder}/missing.db", releases=str(empty), object_store=str(folder),
        last_good={str(empty): f"{folder}/b.db"},
    )
    found = sorted((r.source_no, r.path.rsplit("/", 1)[1]) for r in files.select("source_no", "path").collect())
    assert found == [(0, "a.db"), (2, "b.db"), (3, "a.db"), (3, "b.db"), (3, "broken.db")]


def test_merged_snapshots_are_searchable(spark, folder, tmp_path_factory):
    make_file(folder / "c.db", "SCAN:test", "test-repo", "test fact again")
    tables, _ = snapshots.land_snapshots(snapshots.collect_sources(spark, local=str(folder)))
    merged = merge_united(tables)
    assert sorted(r.summary for r in merged["facts"].collect()) == ["other fact", "test fact again"]
    assert {r.src_ord: r.facts for r in merge_counts(tables["facts"]).collect()} == {0: 1, 1: 1, 3: 1}
    out = str(tmp_path_factory.mktemp("store") / "kb")
    snapshots.write_tables(merged, out)
    kb = KnowledgeBase.build(snapshots.read_tables(spark, out))
    for text in ("test fact", "other fact"):
        found = search(kb.text_index, kb.tables["facts"], kb.tables["pr_analyses"], text, limit=1).collect()
        assert found[0].summary.startswith(text)
    sinks.write_json(kb.search_facts("fact"), f"{out}/json")
    assert spark.read.json(f"{out}/json").count() == 2


@pytest.mark.parametrize("kind", ["parquet", "json"])
def test_folders_of_any_size(spark, tmp_path, monkeypatch, kind):
    """Spark's readers take snapshot folders whole, in order of the list; what they cannot read is reported."""
    monkeypatch.setattr(snapshots, "MAX_FILE_BYTES", 10)
    schema = "fact_id long, pr_id string, repo string, summary string, symbols array<string>, source_files array<string>"
    for i in range(2):
        rows = spark.createDataFrame([(i, f"P{i}", "r", "long " * 5_000, ["a", "b"], [])], schema)
        snapshots.write_folder({"facts": rows}, f"{tmp_path}/{i}", kind)
    bad = spark.createDataFrame([(5, "P5", "r", "[broken")], "id long, pr_id string, repo string, symbols string")
    bad.write.format(kind).save(f"{tmp_path}/2/facts")
    (tmp_path / "3" / "facts").mkdir(parents=True)
    (tmp_path / "3" / "facts" / f"x.{kind}").write_text("not a table")
    tables, rejects = snapshots.read_folders(spark, [f"{tmp_path}/{i}" for i in range(5)], kind)
    found = tables["facts"].orderBy("src_ord").collect()
    assert [(r.fact_id, r.src_ord, len(r.summary), r.symbols) for r in found] == [(i, i, 25_000, ["a", "b"]) for i in range(2)]
    assert sorted(r.path.split("/")[-2] for r in rejects.collect()) == ["2", "3"]
    assert tables["dependencies"].count() == 0


def test_files_are_numbered_over_many_partitions(spark):
    names = [(i % 3, f"f{i:03d}.db") for i in range(200)]
    files = spark.createDataFrame(names, "source_no int, path string").repartition(7)
    got = snapshots._ordinals(files).orderBy("src_ord").collect()
    assert [(r.source_no, r.path, r.src_ord) for r in got] == [(*name, i) for i, name in enumerate(sorted(names))]


def test_query_reports_what_it_cannot_read(spark, sf_dir, monkeypatch):
    from factloom.plans import queries

    read = snapshots.read_folders
    monkeypatch.setattr(
        queries.snapshots, "read_folders",
        lambda s, paths: (read(s, paths)[0], s.createDataFrame([("p", "why")], "path string, error string")),
    )
    lost = queries.scan_snapshots(spark, sf_dir).where("category = 'reject'").collect()
    assert [(r.pr_id, r.detail) for r in lost] == [("p", "why")]


def test_too_large_files_are_reported(spark, folder, monkeypatch):
    monkeypatch.setattr(snapshots, "MAX_FILE_BYTES", 10)
    _, rejects = snapshots.land_snapshots(snapshots.collect_sources(spark, local=f"{folder}/a.db"))
    assert "too large" in rejects.first().error


@pytest.mark.parametrize("kind", ["parquet", "json"])
def test_sources_in_order_with_last_good_copies(spark, tmp_path, kind):
    """Local folders, then releases, then object stores; a remote source that gives nothing is read from its last copy."""
    schema = "fact_id long, pr_id string, repo string, summary string, symbols array<string>, source_files array<string>"

    def put(name, summary, mode="append"):
        rows = spark.createDataFrame([(1, name, "r", summary, ["a"], [])], schema)
        raw = snapshots.align(rows, "facts").select("pr_id", "repo", "summary")
        raw.write.format(kind).mode(mode).save(f"{tmp_path}/{name}/facts")

    def read():
        tables, rejects = snapshots.collect_folders(spark, f"{tmp_path}/store", **listed, kind=kind)
        found = sorted((r.src_ord, r.pr_id, r.summary) for r in tables["facts"].collect())
        return found, sorted((r.path.removeprefix(f"{tmp_path}/"), r.error) for r in rejects.collect())

    listed = {"local": f"{tmp_path}/here, {tmp_path}/gone", "releases": f"{tmp_path}/one", "object_store": f"{tmp_path}/two,,{tmp_path}/never"}
    for name in ("here", "one", "two"):
        put(name, "first")
    gone = [("never", snapshots.NO_COPY)]
    # A local folder that is not there takes its place in the order, but gives no rows.
    assert read() == ([(0, "here", "first"), (2, "one", "first"), (3, "two", "first")], gone)
    put("two", "second", "overwrite")
    spark.range(0).select(F.lit("x").alias("value")).write.mode("overwrite").text(f"{tmp_path}/one/facts")
    found, lost = read()
    assert found == [(0, "here", "first"), (2, "one", "first"), (3, "two", "second")]
    assert ("one", snapshots.OLDER_COPY) in lost and gone[0] in lost
    put("one", "third", "overwrite")
    assert read() == ([(0, "here", "first"), (2, "one", "third"), (3, "two", "second")], gone)


def test_one_broken_table_leaves_the_others(spark, tmp_path):
    spark.createDataFrame([("P", "r", "fine")], "pr_id string, repo string, summary string").write.parquet(f"{tmp_path}/s/facts")
    spark.range(1).select(F.lit("no table").alias("value")).write.text(f"{tmp_path}/s/dependencies")
    tables, rejects = snapshots.collect_folders(spark, f"{tmp_path}/store", releases=f"{tmp_path}/s")
    assert tables["facts"].first().summary == "fine" and tables["dependencies"].count() == 0
    assert [r.path for r in rejects.collect()] == [f"{tmp_path}/s/dependencies"]
