from __future__ import annotations

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import exact_dedup, minhash, packing, quality, stages, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with junk, copies, near copies, a shared passage, nulls and repeated rows, and labels."""
    draw = random.Random(6)
    words = [f"{a}{b}" for a in ("lo", "ip", "do", "am", "te", "el") for b in ("rem", "sum", "lor", "et", "por", "it")]

    def prose(n):
        return " ".join(draw.choice(words) for _ in range(n)) + "."

    passage = prose(60)
    rows = [(i, prose(draw.randint(30, 120))) for i in range(300)]
    rows += [(300 + i, " ".join(w.upper() + "!!" for w in prose(60).split())) for i in range(60)]
    rows += [(400 + i, rows[i][1]) for i in range(20)]
    rows += [(450 + i, rows[30 + i][1] + " changed end") for i in range(20)]
    rows += [(500 + i, f"{prose(40)} {passage} {prose(40)}") for i in range(10)]
    rows += [(600, None), (601, ""), (5, rows[5][1]), (6, "same id but another text, long enough to be told apart"), (None, prose(50))]
    path = str(tmp_path_factory.mktemp("corpus"))
    table(spark, rows).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i < 300)) for i, _ in rows if i is not None and i < 360]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_follow_their_operators(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs]
    for place, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], folder).write.parquet(f"{tmp_path}/{place}")
        seen.append(spark.read.parquet(f"{tmp_path}/{place}"))
    assert all(d.columns == docs.columns for d in seen[:-1])
    raw, good, single, apart, cut, packed = seen

    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scores = quality.quality_scores(raw, quality.train(raw, labels)).where("predicted = 1")
    assert sorted(str(r.doc_id) for r in good.collect()) == sorted(str(r.doc_id) for r in scores.collect())
    kept = {r.doc_id for r in good.collect()}
    assert sum(i in kept for i in range(300)) >= 295 and sum(i in kept for i in range(300, 360)) <= 3

    want = exact_dedup.exact_duplicates(good).where("kept").select("doc_id", F.col("text_sha256").alias("sha"))
    have = single.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"))
    assert sorted(want.collect(), key=repr) == sorted(have.collect(), key=repr)
    texts = [r.text or "" for r in single.collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {r.text or "" for r in good.collect()}

    near = minhash.near_duplicates(single).where("kept").count()
    assert apart.count() == near
    ids = {r.doc_id for r in apart.collect()}
    assert all(30 + i in ids and 450 + i not in ids for i in range(20))

    spans = suffix_dedup.remove_repeats(apart).where("n_removed > 0").collect()
    before, after = {r.doc_id: r for r in apart.collect()}, {r.doc_id: r for r in cut.collect()}
    assert before.keys() == after.keys() and {r.doc_id for r in spans} >= {500 + i for i in range(10)}
    for r in spans:
        assert after[r.doc_id].text == bytes(r.kept).decode() and after[r.doc_id].n_chars == len(after[r.doc_id].text)
    assert all(after[i] == before[i] for i in before if i not in {r.doc_id for r in spans})

    direct = packing.pack_documents(cut, public_tokenizers.path("word_bpe_49k.json"))
    assert sorted(packed.collect(), key=repr) == sorted(direct.collect(), key=repr)


def test_run_gives_the_last_stage(spark, folder):
    found = corpus_pipeline.run(spark, folder)
    assert found.count() > 0 and "sequence_id" in found.columns


def test_empty_documents(spark, folder):
    docs = table(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0
        docs = out if out.columns == docs.columns else docs


def test_one_of_each_near_copy_group_stays(spark, folder):
    """Also of groups that have only null ids, or several texts under their smallest id."""
    draw = random.Random(8)
    groups = [[f"w{draw.randrange(10**6)}" for _ in range(200)] for _ in range(4)]
    ids = [[None] * 6, [1, 1, 1, 2], [None, None, 1, 3], [None, 4]]
    rows = [(i, " ".join([*g, f"end{n}"])) for g, own in zip(groups, ids, strict=True) for n, i in enumerate(own)]
    rows += [rows[0], rows[0], rows[7], (None, "lonely"), (None, "alone")]
    out = stages.drop_near_copies(spark, table(spark, rows), folder).collect()
    found = sorted((r.text.split()[0], r.doc_id) for r in out if " " in r.text)
    assert found == sorted((g[0], i) for g, i in zip(groups, [None, 1, 1, 4], strict=True))
    assert len(out) == len(groups) + 2


def test_extra_columns_stay(spark, folder):
    """Columns that are named as helpers are come through unchanged."""
    names = ("score", "sha", "mark", "spans", "number", "decided_id", "TEXT", "Doc_Id", "sha_of_text", "decision", "c0")
    docs = table(spark, [(1, "one"), (1, "one"), (2, "one two"), (3, None)])
    docs = docs.select(*[F.lit("x").alias(name) for name in names[:5]], "*", *[F.lit("x").alias(name) for name in names[5:]])
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.where("decision = 'x' and sha_of_text = 'x'").count() == 3
        docs = out
    good = stages.keep_good(spark, docs, folder)
    assert good.columns == docs.columns and good.count() <= 3
