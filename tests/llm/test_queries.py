"""The registered queries over the given tables, against DuckDB where SQL can express them."""

from __future__ import annotations

import pytest
from compare import connect, difference

from factloom.llm.oracles import ORACLES
from factloom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(name, spark, sf_dir, duck):
    assert difference(QUERIES[name](spark, sf_dir), duck, ORACLES[name]) is None


def test_one_row_per_document(spark, sf_dir):
    count = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op3_quality", "op6_byte_bpe", "op8_minhash", "op9_suffix_dedup"):
        assert QUERIES[name](spark, sf_dir).count() == count, name


def test_contract():
    import __spark_entry__ as contract

    registered = contract.queries()
    assert all(sum(name.startswith(f"op{n}_") for name in registered) == 1 for n in range(1, 14))
    assert "pipeline" in registered and set(contract.oracle_sql()) <= set(registered)
