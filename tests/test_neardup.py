from __future__ import annotations

import random
import re

import pytest

from factloom.functions.text import IGNORED_WORDS
from factloom.operators import neardup
from factloom.session import materialise


def greedy(rows):
    """The rule as stated: (group, id, text) in id order -> kept ids and {dropped id: first match}."""
    kept, matches, seen = [], {}, {}
    for group, row_id, text in sorted(rows, key=lambda r: r[1]):
        words = set(re.findall("[a-z0-9_]+", text.lower())) - set(IGNORED_WORDS)
        twin = next((k for k, w in seen.get(group, []) if 4 * len(w & words) > 3 * len(w | words)), None)
        if words and twin is not None:
            matches[row_id] = twin
            continue
        kept.append(row_id)
        if words:
            seen.setdefault(group, []).append((row_id, words))
    return sorted(kept), matches


def random_rows(seed, groups=40, per_group=30):
    rnd = random.Random(seed)
    rows = []
    for g in range(groups):
        vocabulary = [f"w{i}" for i in range(rnd.choice([6, 10, 40]))]
        base = rnd.sample(vocabulary, min(len(vocabulary), 8))
        for _ in range(per_group):
            words = list(base) if rnd.random() < 0.6 else rnd.sample(vocabulary, rnd.randint(0, 6))
            for _ in range(rnd.randint(0, 2)):
                if words:
                    words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            rows.append((f"g{g}", len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("front, split", [(32, 1_000_000), (2, 5)])
def test_table_collapse_equals_greedy(spark, front, split):
    rows = random_rows(11 + front)
    kept, matches = greedy(rows)
    table = spark.createDataFrame(rows, "g string, id long, t string")
    result = neardup.collapse_table(table, "g", "id", "t", rows_per_split=split, first_front=front)
    assert sorted(r.id for r in result.survivors().collect()) == kept
    found = {r.id: r.kept_id for r in neardup.first_matches(result, split).collect()}
    assert found == matches


def test_hot_group_of_copies_and_near_copies(spark):
    body = " ".join(f"word{i}" for i in range(20))
    rows = [("hot", i, body) for i in range(300)]
    rows += [("hot", 300 + i, f"{body} own{i}") for i in range(300)]
    rows += [("hot", 600 + i, " ".join(f"d{i}_{j}" for j in range(5)) + " word0 word1") for i in range(100)]
    rows += [("hot", 700, ""), ("hot", 701, "cz sk"), ("cold", 702, body)]
    table = spark.createDataFrame(rows, "g string, id long, t string")
    result = neardup.collapse_table(table, "g", "id", "t", rows_per_split=20, first_front=4)
    assert sorted(r.id for r in result.survivors().collect()) == greedy(rows)[0]


def test_exactly_three_quarters_is_kept(spark):
    rows = [("g", 0, "a b c"), ("g", 1, "a b c d"), ("g", 2, "a b c d e f g h"), ("g", 3, "a b c d e f g h i")]
    result = neardup.collapse_table(spark.createDataFrame(rows, "g string, id long, t string"), "g", "id", "t")
    assert sorted(r.id for r in result.survivors().collect()) == [0, 1, 2]


def test_empty_table(spark):
    table = spark.createDataFrame([], "g string, id long, t string")
    assert neardup.collapse_table(table, "g", "id", "t").survivors().count() == 0


def test_ranked_collapse_equals_greedy_per_query(spark):
    rows = [(q, *row) for q in range(3) for row in random_rows(q, groups=5, per_group=15)]
    table = spark.createDataFrame(rows, "query_id int, repo string, place long, summary string")
    found = neardup.collapse_ranked(table).collect()
    for q in range(3):
        expected = greedy([row[1:] for row in rows if row[0] == q])[0]
        assert sorted(r.place for r in found if r.query_id == q) == expected


@pytest.mark.parametrize("cuts", [(700,), (100, 101, 900)])
def test_arriving_rows_equal_the_whole_table(spark, cuts):
    """Rows that come later, in one lot or several, meet kept rows only; the result is that of all rows at once."""
    rows = random_rows(5)
    kept, matches = greedy(rows)
    lots = [rows[a:b] for a, b in zip((0, *cuts), (*cuts, len(rows)), strict=True)]
    frames = [spark.createDataFrame(lot, "g string, id long, t string") for lot in lots]
    result = neardup.collapse_table(frames[0], "g", "id", "t", first_front=4)
    for frame in frames[1:]:
        result = neardup.extend_collapse(result, frame, "g", "id", "t", rows_per_split=50, first_front=4)
    assert sorted(r.id for r in result.survivors().collect()) == kept
    assert {r.id: r.kept_id for r in neardup.first_matches(result).collect()} == matches


def test_arriving_rows_on_an_empty_table(spark):
    rows = random_rows(9, groups=4)
    empty = spark.createDataFrame([], "g string, id long, t string")
    result = neardup.extend_collapse(neardup.collapse_table(empty, "g", "id", "t"), spark.createDataFrame(rows, empty.schema), "g", "id", "t")
    assert sorted(r.id for r in result.survivors().collect()) == greedy(rows)[0]


def test_parities_leave_out_far_pairs_and_keep_similar_ones(spark):
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(4000)]
    texts = []
    for size in (9, 60, 70, 250, 260, 1000, 1100):
        words = rnd.sample(base, size)
        changed = words[: -(size // 8)] + [f"x{size}"]
        texts += [words, changed, rnd.sample(base, size)]
    rows = spark.createDataFrame([("g", i, " ".join(words)) for i, words in enumerate(texts)], "repo string, fact_id long, summary string")
    _, sets = neardup._word_sets(rows, "repo", "fact_id", "summary", ())
    pairs = [(i, j) for j in range(len(texts)) for i in range(j)]
    near = {tuple(row) for row in neardup._near(spark.createDataFrame(pairs, "a long, b long"), sets).collect()}
    similar = {(i, j) for i, j in pairs if 4 * len({*texts[i]} & {*texts[j]}) > 3 * len({*texts[i]} | {*texts[j]})}
    assert len(similar) >= 6
    assert similar <= near
    assert len(near) <= len(similar) + 3


def test_sets_of_all_sizes_equal_greedy(spark):
    """Sets of 4 to 2,000 words with copies that differ about as much as is allowed, more or less; cells are cut."""
    rnd = random.Random(3)
    rows = []
    for size in [4, 5, 7, 9, 20, 33, 60, 65, 130, 260, 500, 700, 1030, 2000] * 3:
        words = [f"w{rnd.randrange(6000)}" for _ in range(size)]
        for share in (0, 0.05, 0.12, 0.14, 0.16, 0.3):
            other = [word if rnd.random() >= share else f"n{rnd.randrange(10**6)}" for word in words]
            rows.append((f"g{len(rows) % 2}", len(rows), " ".join(other[: len(other) - int(size * rnd.choice([0, 0.1, 0.2]))])))
    rnd.shuffle(rows)
    rows = [(group, i, text) for i, (group, _, text) in enumerate(rows)]
    kept, matches = greedy(rows)
    assert len(matches) > 30
    table = spark.createDataFrame(rows, "g string, id long, t string")
    for per_tile in (20, 1 << 16):
        result = neardup.collapse_table(table, "g", "id", "t", rows_per_split=per_tile)
        assert sorted(r.id for r in result.survivors().collect()) == kept
    assert {r.id: r.kept_id for r in neardup.first_matches(result).collect()} == matches


@pytest.fixture
def stored(monkeypatch):
    """Rows written by the collapse, by label."""
    counts = {}

    def counted(df, label):
        out = materialise(df, label)
        counts[label] = counts.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(neardup, "materialise", counted)
    return counts


def test_pairs_that_only_share_rare_words_are_not_stored(spark, stored):
    """Rows that share words, also their rarest, but no two of which are similar: what is stored grows with the rows alone."""
    rnd = random.Random(7)
    rows = [("g", i, " ".join(f"w{word}" for word in rnd.sample(range(200), 40))) for i in range(400)]
    rows.append(("g", 400, rows[0][2] + " more"))
    result = neardup.collapse_table(spark.createDataFrame(rows, "g string, id long, t string"), "g", "id", "t")
    assert sorted(r.id for r in result.survivors().collect()) == list(range(400))
    assert max(stored.values()) <= 2 * len(rows)


def test_near_copies_meet_few_leaders_only(spark, stored):
    body = [f"word{i}" for i in range(60)]
    rows = [("g", i, " ".join([*body[: i % 59], *body[i % 59 + 1 :], f"own{i}"])) for i in range(300)]
    result = neardup.collapse_table(spark.createDataFrame(rows, "g string, id long, t string"), "g", "id", "t")
    assert [r.id for r in result.survivors().collect()] == [0]
    assert stored["edges"] <= 10 * len(rows)


def test_words_of_rows_are_found_once_for_their_matches(spark, stored):
    rows = [("g", i, " ".join(f"w{i % 20}_{j}" for j in range(8))) for i in range(100)]
    result = neardup.collapse_table(spark.createDataFrame(rows, "g string, id long, t string"), "g", "id", "t")
    assert {r.id: r.kept_id for r in neardup.first_matches(result).collect()} == {i: i % 20 for i in range(20, 100)}
    assert stored["digests"] == len(rows)
