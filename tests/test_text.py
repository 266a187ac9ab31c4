from __future__ import annotations

import sqlite3

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.functions.porter import STEP2, STEP3, STEP4, stem, stem_udf

SAMPLES = [
    "login_user retries; café ÉLÈVE straße", "", "-- ...", "x́y ó", "a1b2 3.14 foo-bar",
    "Ærø ŁÓDŹ İstanbul ſharp ς Σ", "naïve\ncoöperate\tĀ", "日本語 текст Ёлка", "e͇x e̅x",
]


def fts_terms(values, tokenizer):
    db = sqlite3.connect(":memory:")
    db.execute(f"CREATE VIRTUAL TABLE f USING fts5(x, tokenize='{tokenizer}')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab('f', 'instance')")
    db.executemany("INSERT INTO f(rowid, x) VALUES (?, ?)", list(enumerate(values)))
    found = {i: [] for i in range(len(values))}
    for term, doc, offset in db.execute("SELECT term, doc, offset FROM v ORDER BY doc, offset"):
        found[doc].append(term)
    return [found[i] for i in range(len(values))]


def column(spark, values, expression):
    rows = spark.createDataFrame(list(enumerate(values)), "i long, t string").select("i", expression.alias("x"))
    return [row["x"] for row in rows.orderBy("i").collect()]


def test_tokens_equal_full_text_index(spark):
    expected = fts_terms(SAMPLES, "unicode61")
    assert column(spark, SAMPLES, text.tokens(F.col("t"))) == expected
    assert [text.query_tokens(s) for s in SAMPLES] == expected


def test_tokens_of_documents_equal_full_text_index(spark, sf_dir):
    values = [r[0] for r in duckdb.sql(f"SELECT text FROM '{sf_dir}/documents.parquet'").fetchall()]
    assert column(spark, values, text.tokens(F.col("t"))) == fts_terms(values, "unicode61")


def test_stems_equal_full_text_index(sf_dir):
    endings = [*STEP2, *STEP3, *STEP4, "s", "sses", "ies", "ed", "ing", "eed", "y", "e", "ll", "ated", ""]
    starts = ["rel", "hop", "fall", "happ", "sky", "tr", "controll", "xay", "yy", "ö", "éa", "feed", "a", "s"]
    words = {a + b for a in starts for b in endings} | {a + b + c for a in starts[:5] for b in endings for c in endings}
    words |= {"a" * 62 + "ing", "a" * 61 + "ing", "b" * 70 + "ing", "as", "is", "ies", "logins", "retry", "payment"}
    found = duckdb.sql(f"SELECT DISTINCT unnest(regexp_extract_all(text, '\\w+')) FROM '{sf_dir}/documents.parquet'")
    words |= {row[0] for row in found.fetchall()}
    words = sorted(w for w in words if w)
    assert [[stem(t) for t in text.query_tokens(w)] for w in words] == fts_terms(words, "porter unicode61")


def test_stem_udf(spark):
    assert column(spark, ["logins", None, "retry"], stem_udf("t")) == ["login", None, "retri"]


@pytest.mark.parametrize("term", ["ana", "A_c", "100%", "a%c", "É", "é", "a\\b", "x.y", "(", "%"])
def test_like_equals_sqlite(spark, term):
    values = ["Banana", "abc", "aXXc", "100% sure", "1000", "É", "é", "a\\b", "x.y", "xzy", "f(x)", "a\nc", "İ"]
    db = sqlite3.connect(":memory:")
    expected = [bool(db.execute("SELECT ? LIKE ?", (v, f"%{term}%")).fetchone()[0]) for v in values]
    assert column(spark, values, text.like_contains(F.col("t"), term)) == expected
    literal = [bool(db.execute("SELECT instr(lower(?), lower(?))", (v, term)).fetchone()[0]) for v in values]
    assert column(spark, values, text.folded_contains(F.col("t"), term)) == literal


def test_component_stem(spark):
    cases = {"a/v1.2/x": "a/v1", ".env": "", "x": "x", "api_service.py": "api_service", "100%_x": "100%_x", "a.\nb": "a"}
    assert [text.component_stem(c) for c in cases] == list(cases.values())
    assert column(spark, list(cases), text.component_stem_col(F.col("t"))) == list(cases.values())


def test_word_sets(spark):
    values = ["The CZ-drmax shop; it sells IT_gear", "", None, "cz sk", "a a B"]
    expected = [["drmax", "it_gear", "sells", "shop", "the"], [], [], [], ["a", "b"]]
    assert column(spark, values, text.word_set(F.col("t"))) == expected


def test_small_helpers(spark):
    assert text.split_clean(" a ;; b;", ";") == ["a", "b"]
    assert (text.clamp(0, 1, 100), text.clamp(500, 1, 100)) == (1, 100)
    assert column(spark, ['["a"]', "", None], text.json_list(F.col("t"))) == [["a"], [], []]


def test_tokens_are_counted_without_folding(spark):
    signs = [chr(c) for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000]
    rows = [(f"a{c}b {c} {c}c d{c}",) for c in signs] + [("",), (None,), ("a\u0301\u0308b \u0301 c",)]
    df = spark.createDataFrame(rows, "text string")
    assert df.where(text.token_count(F.col("text")) != F.size(text.tokens(F.col("text")))).collect() == []
