from __future__ import annotations

import random

from factloom.functions.text import component_stem
from factloom.operators.deps import NOISE_NAMES, component_impact, component_impact_batch
from factloom.operators.grams import containing

SCHEMA = "pr_id string, repo string, from_component string, to_component string, relation string"


def edges(count, draw):
    parts = ["auth", "Auth.py", "api_service", "API", "é", "%", "_x", "json", "a.b.c", "", "re", "lib/auth/x"]
    names = [draw.choice(parts) + draw.choice(["", "/", "."]) + draw.choice(parts) for _ in range(30)] + ["json", None, "ab"]
    return [(f"P{i % 7}", f"r{i % 3}", draw.choice(names), draw.choice(names), "calls") for i in range(count)]


def touches(edge, component):
    stem = component_stem(component)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    ends = [end for end in edge[2:4] if end is not None]
    return any(stem.translate(low) in end.translate(low) for end in ends)


def expected(rows, components):
    quiet = [r for r in set(rows) if r[2] is not None and r[3] is not None and not {r[2], r[3]} & set(NOISE_NAMES)]
    return sorted((c, *r) for c in set(components) if c is not None for r in quiet if touches(r, c))


def test_table_of_components(spark):
    draw = random.Random(2)
    rows = edges(600, draw)
    components = ["auth.py", "Auth", "a", "é", "%", "api_service.go", ".env", "nothing", "b.c.d", None, "auth", "x", "AB", "", "_"]
    table = spark.createDataFrame([(c,) for c in components], "component string")
    dependencies = spark.createDataFrame(rows, SCHEMA)
    found = component_impact_batch(dependencies, table)
    assert sorted(map(tuple, found.collect())) == expected(rows, components)
    for component in ("auth.py", "a", "é"):
        single = sorted(map(tuple, component_impact(dependencies, component).collect()))
        assert single == [row[1:] for row in expected(rows, [component])]


def test_many_components_and_a_hot_endpoint(spark):
    """Thousands of components; one endpoint holds a third of all edges. Plans hold no list of the components."""
    rows = [(f"P{i}", "r", "core/hot_service.py" if i % 3 == 0 else f"part{i:05d}.py", f"lib{i % 50}", "calls") for i in range(3000)]
    components = [f"part{i:05d}.py" for i in range(0, 3000, 2)] + ["hot_service.go"]
    table = spark.createDataFrame([(c,) for c in components], "component string")
    found = component_impact_batch(spark.createDataFrame(rows, SCHEMA), table)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "part00100" not in plan
    assert sorted(map(tuple, found.collect())) == expected(rows, components)


def test_hits_are_not_made_distinct_again(spark):
    """an edge whose endpoints both hold a stem comes once, without an aggregate over all hits."""
    rows = [("P", "r", "auth/a.py", "auth/b.py", "calls"), ("P", "r", "x.py", "auth/b.py", "calls"), ("P", "r", "auth", "auth", "calls")] * 3
    components = ["auth.py", "auth/b.py", "nothing"]
    found = component_impact_batch(spark.createDataFrame(rows, SCHEMA), components)
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == expected(rows, components)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert component_impact_batch(none, ["a", ""]).count() == 0
    some = spark.createDataFrame(edges(5, random.Random(1)), SCHEMA)
    assert component_impact_batch(some, spark.createDataFrame([], "component string")).count() == 0


def test_containing_equals_all_pairs(spark):
    draw = random.Random(4)
    values = {"".join(draw.choices("abc😀é", k=draw.randint(0, 9))) for _ in range(200)}
    needles = {"".join(draw.choices("abc😀é", k=draw.randint(0, 5))) for _ in range(60)}
    found = containing(
        spark.createDataFrame([(n,) for n in [*needles, None]], "needle string"),
        spark.createDataFrame([(v,) for v in values], "value string"),
    )
    assert sorted(map(tuple, found.collect())) == sorted((n, v) for n in needles for v in values if n and n in v)
