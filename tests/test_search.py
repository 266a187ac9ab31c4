from __future__ import annotations

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from factloom.operators import index, search
from factloom.operators.facts import recent_facts, split_valid
from factloom.plans.tools import KnowledgeBase
from factloom.session import materialise

SCHEMA = (
    "fact_id long, pr_id string, repo string, category string, summary string, detail string, confidence double,"
    " source string, symbols_text string, symbols array<string>"
)
VOCABULARY = (
    "login logins user retry retries payment payments café the gateway checkout flow session token tokens cache caching "
    "middleware stripe webhook handler handles ésprit relational relation running runs a of"
).split()
QUERIES = [
    "login", "logins user", "the the retry", "login_user", "payment -- gateway", "cafe", "caching_handler tokens",
    "of_the a", "relations", "unknown", "run_a_session the",
]


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    rows = []
    for i in range(300):
        text = [" ".join(rnd.choices(VOCABULARY, k=rnd.randint(0, n))) for n in (6, 30)]
        symbols = [f"{rnd.choice(VOCABULARY)}_{rnd.choice(VOCABULARY)}" for _ in range(rnd.randint(0, 3))]
        rows.append((
            i, f"SCAN:m{i % 9}", f"r{i % 4}", ("behavior", "design", "assumption")[i % 3], text[0],
            text[1].replace(" a ", " a. "), (i % 11) / 10, ("scan", "ai", "human")[i % 3], str(symbols), symbols,
        ))
    return rows


@pytest.fixture(scope="module")
def base(spark, corpus):
    facts = spark.createDataFrame(corpus, SCHEMA)
    keys = sorted({(row[1], row[2]) for row in corpus})
    analyses = [(p, r, f"2025-01-{1 + n % 5:02d}", "PR-9" if n % 2 else None) for n, (p, r) in enumerate(keys) if n % 7]
    table = spark.createDataFrame(analyses, "pr_id string, repo string, ts string, triggered_by string")
    table = table.withColumn("ts", F.to_timestamp("ts"))
    return {"facts": facts, "pr_analyses": table, "index": index.build_index(facts, table)}


@pytest.fixture(scope="module")
def fts(corpus):
    db = sqlite3.connect(":memory:")
    for name, tokenizer in (("plain", "unicode61"), ("stemmed", "porter unicode61")):
        db.execute(f"CREATE VIRTUAL TABLE {name} USING fts5(summary, detail, symbols, tokenize='{tokenizer}')")
        db.executemany(
            f"INSERT INTO {name}(rowid, summary, detail, symbols) VALUES (?, ?, ?, ?)",
            [(r[0], r[4], r[5], r[8]) for r in corpus],
        )
    return db


@pytest.mark.parametrize("stemmed", [False, True])
def test_scores_equal_full_text_index(spark, base, fts, stemmed):
    table = "stemmed" if stemmed else "plain"
    queries = QUERIES
    found = {i: {} for i in range(len(QUERIES))}
    for row in search.score(base["index"], queries, stemmed=stemmed, linked_only=False).collect():
        found[row.query_id][row.fact_id] = row.score
    for i, text in enumerate(QUERIES):
        match = " OR ".join(f'"{word}"' for word in text.split())
        sql = f"SELECT rowid, bm25({table}, 10.0, 5.0, 15.0) FROM {table} WHERE {table} MATCH ?"
        expected = dict(fts.execute(sql, (match,)).fetchall())
        assert found[i].keys() == expected.keys(), text
        assert all(abs(found[i][k] - v) < 1e-9 for k, v in expected.items()), text
    assert any(found[i] for i in found)


def test_distributed_query_table_gives_the_same(spark, base, monkeypatch):
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string")
    for stemmed in (False, True):
        small = search.score(base["index"], queries, stemmed=stemmed).select("query_id", "fact_id", F.round("score", 9))
        expected = sorted(map(tuple, small.collect()))
        listed = search.score(base["index"], QUERIES, stemmed=stemmed).select("query_id", "fact_id", F.round("score", 9))
        assert sorted(map(tuple, listed.collect())) == expected
        monkeypatch.setattr(search, "BROADCAST_ROWS", 3)
        monkeypatch.setattr(search, "PUSHED_VALUES", 2)
        large = search.score(base["index"], queries, stemmed=stemmed).select("query_id", "fact_id", F.round("score", 9))
        assert sorted(map(tuple, large.collect())) == expected
        monkeypatch.undo()


def test_ranking_filters_and_orphans(base):
    linked = {(r.pr_id, r.repo): r.ts for r in base["pr_analyses"].collect()}
    full = search.search(base["index"], base["facts"], base["pr_analyses"], "login retry", limit=100).collect()
    assert all((r.pr_id, r.repo) in linked for r in full)
    ordered = sorted(full, key=lambda r: r["rank"])
    keys = [(round(r.score, 12), r.source != "scan", -r.ts.timestamp(), r.fact_id) for r in ordered]
    assert keys == sorted(keys) and [r["rank"] for r in ordered] == list(range(1, len(full) + 1))
    picked = search.search(
        base["index"], base["facts"], base["pr_analyses"], "login retry",
        category="design", min_confidence=0.5, repo_name="r1", limit=100,
    ).collect()
    expected = {r.fact_id: r.score for r in full if r.category == "design" and r.confidence >= 0.5 and r.repo == "r1"}
    assert expected.keys() <= {r.fact_id for r in picked}
    assert all(abs(r.score - expected[r.fact_id]) < 1e-12 for r in picked if r.fact_id in expected)


def test_empty_and_malformed_queries(base):
    args = base["index"], base["facts"], base["pr_analyses"]
    assert search.search(*args, "   ").count() == 0
    assert search.search(*args, "-- ...").count() == 0
    assert search.search(*args, 'no"thing').count() == 0
    quoted = base["facts"].withColumn("detail", F.when(F.col("fact_id") == 1, F.lit('say "hi" now')).otherwise("detail"))
    found = search.search(base["index"], quoted, base["pr_analyses"], 'Y "HI').collect()
    assert [r.fact_id for r in found] == [1] and found[0].score is None


def test_very_many_quoted_queries(spark, base):
    """More quoted queries than one scan takes: each is answered as if it were alone."""
    queries = spark.createDataFrame([(i, f'"{"login" if i % 2 else "nothing"} {i}') for i in range(250)], "query_id long, query string")
    facts = base["facts"].withColumn("detail", F.when(F.col("fact_id") == 1, F.lit('say "login 7 "login 249')).otherwise("detail"))
    found = search.search_batch(base["index"], facts, base["pr_analyses"], queries)
    assert sorted((r.query_id, r.fact_id, r.rank) for r in found.collect()) == [(7, 1, 1), (249, 1, 1)]


def test_like_search_order(base):
    found = search.like_search(base["facts"], base["pr_analyses"], "GATEWAY", limit=7).collect()
    linked = {(r.pr_id, r.repo) for r in base["pr_analyses"].collect()}
    expected = sorted(
        (-r.confidence, r.fact_id) for r in base["facts"].collect()
        if (r.pr_id, r.repo) in linked and "gateway" in (r.summary + r.detail).lower()
    )[:7]
    assert sorted((-r.confidence, r.fact_id) for r in found) == expected


def test_multi_query_cap_and_first_place(base):
    args = base["index"], base["facts"], base["pr_analyses"]
    found = search.search_many(*args, "login; payment ;; the", limit=50).collect()
    assert len(found) == 70
    assert len({(r.pr_id, r.category, r.summary) for r in found}) == 70
    single = search.search_many(*args, "the", limit=500).collect()
    assert len(single) == 100
    assert search.search_many(*args, " ; ", limit=5).count() == 0


def test_recent_facts_equal_plain_join(base):
    joined = base["facts"].join(base["pr_analyses"], ["pr_id", "repo"])
    for category in (None, "design"):
        rows = joined if category is None else joined.where(F.col("category") == category)
        expected = [r.fact_id for r in rows.orderBy(F.desc("ts"), "fact_id").limit(15).collect()]
        found = recent_facts(base["facts"], base["pr_analyses"], category, 15).collect()
        assert [r.fact_id for r in found] == expected


def test_incremental_index_equals_rebuild(spark, base):
    removed = base["facts"].where("fact_id < 40")
    added = base["facts"].where("fact_id BETWEEN 10 AND 20").withColumn("fact_id", F.col("fact_id") + 1000)
    updated = index.update_index(base["index"], removed, added, base["pr_analyses"])
    now = base["facts"].where("fact_id >= 40").unionByName(added)
    rebuilt = index.build_index(now, base["pr_analyses"])
    columns = ["token", "fact_id", "doc_len", "tf0", "tf1", "tf2", "positions", "repo", "linked", "ts"]
    assert updated.postings.select(columns).exceptAll(rebuilt.postings.select(columns)).isEmpty()
    assert updated.postings.count() == rebuilt.postings.count()
    assert updated.size == rebuilt.size
    assert rebuilt.vocab.exceptAll(updated.vocab).isEmpty()
    compacted = index.compact_index(updated)
    assert compacted.size == rebuilt.size
    assert compacted.postings.select(columns).exceptAll(rebuilt.postings.select(columns)).isEmpty()
    assert sorted(map(tuple, compacted.vocab.collect())) == sorted(map(tuple, rebuilt.vocab.collect()))


def test_validation(spark):
    rows = [
        ("p", "r", "design", "s", "d", 1.0, "ai"), ("p", "r", "idea", "s", "d", 1.0, "ai"),
        ("p", "r", "design", "s", "d", 1.5, "ai"), ("p", "r", "design", "s", "d", 0.0, "bot"),
        (None, "r", "design", "s", "d", 0.0, "ai"), ("p", "r", "design", "s", "d", float("nan"), "ai"),
    ]
    table = spark.createDataFrame(
        rows, "pr_id string, repo string, category string, summary string, detail string, confidence double, source string"
    )
    valid, rejected = split_valid(table)
    assert valid.count() == 1
    assert sorted(r.reason for r in rejected.collect()) == [
        "confidence out of range", "confidence out of range", "missing pr_id", "unknown category", "unknown source"
    ]


def test_tool_arguments(base):
    kb = KnowledgeBase({**base, "dependencies": None, "repo_dependencies": base["facts"]}, base["index"])
    with pytest.raises(ValueError):
        kb.recent_changes("idea")
    with pytest.raises(ValueError):
        kb.component_impact("  ")
    with pytest.raises(ValueError):
        kb.repo_dependencies(direction="sideways")
    assert kb.recent_changes(limit=0).count() == 1
    rows = [r.value for r in kb.search_json("login; payment", limit=5).collect()]
    assert rows and all('"pr_id"' not in r and '"source":' not in r and '"symbols":[]' not in r for r in rows)
    assert kb.module_facts("SCAN:m1").count() > 0


def test_postings_tokenise_each_text_once(base):
    linked = base["facts"].withColumn("ts", F.current_timestamp()).withColumn("linked", F.lit(True))
    plan = index.posting_rows(linked)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 3


def test_search_reads_only_its_words(base):
    scored = search.rank(search.score(base["index"], ["login retry"]), 5)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [shard" in plan and "In(token" in plan
    assert "WindowGroupLimit" in plan
    assert "positions" not in plan.split("ReadSchema", 1)[1].split("\n", 1)[0]


@pytest.mark.parametrize("stemmed", [False, True])
def test_quotes_are_read_as_by_the_full_text_index(spark, base, fts, stemmed):
    """What can be read as words is ranked, alone, in a list and in a table; only the rest is left to substring search."""
    table = "stemmed" if stemmed else "plain"
    queries = [
        '"login"', 'user "login"', '"login user"', '"retry payment gateway"', 'cafe"token', 'login"user"', '"the" "the"', '""', '"',
        '"a""b"', 'x"login_user"y', '"login-user"', 'log"', '"login" user" retry', 'NOT "AND"', 'user"NOT"login', '"of the" a',
    ]
    listed = search.score(base["index"], queries, stemmed=stemmed, linked_only=False).collect()
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    tabled = search.score(base["index"], asked, stemmed=stemmed, linked_only=False).collect()
    lost = {row.query_id for row in asked.where(search.unreadable(F.col("query"))).collect()}
    for i, text in enumerate(queries):
        match = " OR ".join(f'"{word}"' for word in text.split())
        try:
            sql = f"SELECT rowid, bm25({table}, 10.0, 5.0, 15.0) FROM {table} WHERE {table} MATCH ?"
            expected = dict(fts.execute(sql, (match,)).fetchall())
        except sqlite3.OperationalError:
            expected = None
        if expected is None or i in lost:
            assert search.match_groups(text) is None and i in lost, text
            assert expected is None or "NOT" in text, text
            continue
        assert search.match_groups(text) is not None, text
        for rows in (listed, tabled):
            found = {row.fact_id: row.score for row in rows if row.query_id == i}
            assert found.keys() == expected.keys(), text
            assert all(abs(found[k] - v) < 1e-9 for k, v in expected.items()), text


def test_nineteen_hundred_words_and_hits(spark, base, fts):
    """Long queries and long results become joins: no list in the plan, no deep filter in the scan."""
    words = [f"word{i}" for i in range(1900)] + ["login", "retry"]
    for stemmed in (False, True):
        scored = search.score(base["index"], [" ".join(words)], stemmed=stemmed, linked_only=False)
        plan = scored._jdf.queryExecution().optimizedPlan().toString()
        assert "word1234" not in plan
        expected = fts.execute(f"SELECT count(*) FROM {'stemmed' if stemmed else 'plain'} WHERE "
                               f"{'stemmed' if stemmed else 'plain'} MATCH 'login OR retry'").fetchone()[0]  # fmt: skip
        assert scored.count() == expected
    facts = spark.range(5000).select(F.col("id").alias("fact_id"), F.lit("SCAN:m1").alias("pr_id"), F.lit("r1").alias("repo"))
    analyses = spark.createDataFrame([("SCAN:m1", "r1")], "pr_id string, repo string")
    hits = spark.range(1900).select((F.col("id") * 2).alias("fact_id"), F.col("id").alias("rank"))
    found = search.attach_facts(hits, facts, analyses)
    assert found.count() == 1900
    assert spark.conf.get("spark.sql.parquet.pushdown.inFilterThreshold") == "10"


def test_many_words_prune_shards_at_run_time(spark, base, monkeypatch):
    monkeypatch.setattr(search, "PUSHED_VALUES", 1)
    scored = search.score(base["index"], ["login retry"])
    assert "dynamicpruning" in scored._jdf.queryExecution().executedPlan().toString().lower()
    assert scored.count() > 0


def test_idf_of_words_reads_no_postings_twice(base):
    plan = search.score(base["index"], ["login retry"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("tf0#") and plan.count("doc_len") and plan.count("Relation") - plan.count("df#") <= 2
    scored = search.score(base["index"], ["login"]).collect()
    without = index.TextIndex(base["index"].docs, base["index"].postings, base["index"].vocab, base["index"].stats, base["index"].shards)
    assert sorted(map(tuple, scored)) == sorted(map(tuple, search.score(without, ["login"]).collect()))


def test_frequencies_after_updates(base):
    removed = base["facts"].where("fact_id < 60")
    added = base["facts"].where("fact_id BETWEEN 100 AND 140").withColumn("fact_id", F.col("fact_id") + 1000)
    for gone in (removed, removed.select("fact_id")):
        updated = index.update_index(base["index"], gone, added, base["pr_analyses"])
        words = updated.vocab.select("token", index.shard_of(F.col("token"), updated.shards).alias("shard")).distinct()
        found = {r.token: r.df for r in index.frequency_of(updated, words).collect()}
        assert found == {r.token: r.df for r in index.document_frequency(updated.postings).collect()}


def test_substrings_through_the_vocabulary(spark, base, monkeypatch):
    """Many patterns at once, of all sorts, equal a plain comparison; with grams only their shards are read."""
    terms = ["gateway", "ATEW", "log", "in", "o", "user login", "_", "%", "caf", "é", "r%y", "e_s", "zz", "", "  ", "payment gateway", "a. "]
    asked = spark.createDataFrame(list(enumerate(terms)), "query_id long, query string")
    rows = [(r.fact_id, r.summary, r.detail, r.confidence) for r in base["facts"].collect() if (r.pr_id, r.repo) in {
        (a.pr_id, a.repo) for a in base["pr_analyses"].collect()}]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE f (id, summary, detail, confidence)")
    db.executemany("INSERT INTO f VALUES (?, ?, ?, ?)", rows)
    for built in (base["index"], index.with_grams(base["index"])):
        for pushed in (500, 1):
            monkeypatch.setattr(search, "PUSHED_VALUES", pushed)
            hits = search.substring_hits(built, base["facts"], base["pr_analyses"], asked, 25).collect()
            for i, term in enumerate(terms):
                sql = "SELECT id FROM f WHERE summary LIKE ? OR detail LIKE ? ORDER BY confidence DESC, id LIMIT 25"
                expected = [row[0] for row in db.execute(sql, (f"%{term}%",) * 2).fetchall()]
                assert [h.fact_id for h in sorted(hits, key=lambda h: h["rank"]) if h.query_id == i] == expected, term
    needles = spark.createDataFrame([("gatewa",)], "needle string")
    monkeypatch.setattr(search, "PUSHED_VALUES", 500)
    seen = []
    monkeypatch.setattr(search, "materialise", lambda df, label: seen.append((label, df)) or materialise(df, label))
    search._facts_with(index.with_grams(base["index"]), needles)
    plan = dict(seen)["facts-with-substrings"]._jdf.queryExecution().executedPlan().toString()
    assert any("shard" in part.split("]")[0] for part in plan.split("PartitionFilters")[1:])


def test_scores_are_added_up_without_a_shuffle_per_query(base):
    many = [word for word in VOCABULARY for _ in range(3)]
    found = search.score(base["index"], many, stemmed=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(fact_id" in plan
    assert "hashpartitioning(query_id" not in plan
    assert found.select("query_id").distinct().count() > len(VOCABULARY)


def test_lost_words_need_no_sorted_texts(spark, base, monkeypatch):
    """texts of removed facts are neither sorted nor made into a row per fact and word; ids may come again."""
    removed = base["facts"].where("fact_id < 60")
    held = {}

    def kept(df, label):
        held[label] = df
        return materialise(df, label)

    monkeypatch.setattr(index, "materialise", kept)
    gone = index.update_index(base["index"], removed, base["facts"].limit(0), base["pr_analyses"])
    plan = held["lost-frequency"]._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "keys=[fact_id" not in plan
    twice = removed.unionByName(removed.where("fact_id < 20"))
    again = index.update_index(base["index"], twice, base["facts"].limit(0), base["pr_analyses"])
    counts = [{r.token: r.df for r in x.frequency.groupBy("token").agg(F.sum("df").alias("df")).where("df > 0").collect()} for x in (gone, again)]
    assert counts[0] == counts[1] == {r.token: r.df for r in index.document_frequency(gone.postings).collect()}


def test_long_lists_of_removed_facts_meet_unsorted_postings(spark, base, monkeypatch):
    removed = base["facts"].where("fact_id < 60")
    expected = {tuple(r) for r in base["index"].postings.where("fact_id >= 60").select("token", "fact_id", "tf0").collect()}
    monkeypatch.setattr(index, "broadcast_if_small", lambda df: df)
    monkeypatch.setattr(index, "key_lookup", lambda big, small, on, how, spread: big.join(small, on, how))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        updated = index.update_index(base["index"], removed, base["facts"].limit(0), base["pr_analyses"])
        found = updated.postings.select("token", "fact_id", "tf0")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
        assert {tuple(r) for r in found.collect()} == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
