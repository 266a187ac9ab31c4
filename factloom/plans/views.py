"""Knowledge-base tables as views over the star-schema and text tables.

The same SQL text runs in Spark and in DuckDB. Every view reads whole tables
and whole texts: a document's first line is the fact summary and the remaining
lines are the detail, so the two columns together hold the complete text.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import DataFrame, SparkSession

from factloom.session import widen

# Capitalised words of five letters or more stand in for code symbols.
_SYMBOLS = "regexp_extract_all({text}, '[A-Z][a-z][a-z][a-z][a-z]+'{group})"


def _fact_sql(key: str, text: str, pr_id: str, repo: str, summary: str, detail: str, source: str) -> str:
    return f"""
        SELECT {key} AS fact_id, {pr_id} AS pr_id, {repo} AS repo,
               CASE {key} % 3 WHEN 0 THEN 'behavior' WHEN 1 THEN 'design' ELSE 'assumption' END AS category,
               {summary} AS summary, {detail} AS detail,
               CAST({key} % 101 AS DOUBLE) / 100 AS confidence,
               CASE {key} % 5 WHEN 0 THEN 'scan' WHEN 1 THEN 'human' ELSE 'ai' END AS source,
               {text} AS full_text
        FROM {{{source}}}"""


_FIRST_LINE = "split_part({0}, chr(10), 1)"
_OTHER_LINES = "substr({0}, length(split_part({0}, chr(10), 1)) + 2)"

_RAW_FACTS = {
    "kb_facts": _fact_sql(
        "doc_id",
        "text",
        "concat('SCAN:', lang, '/', CAST(doc_id % 10 AS STRING))",
        "source",
        _FIRST_LINE.format("text"),
        _OTHER_LINES.format("text"),
        "documents",
    ),
    "kb_facts_talk": _fact_sql(
        "(conv_id * 1000 + turn)",
        "text",
        "concat('SCAN:', CASE turn % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END,"
        " '/', CAST(conv_id % 10 AS STRING))",
        "concat('src', CAST(conv_id % 20 AS STRING))",
        _FIRST_LINE.format("text"),
        _OTHER_LINES.format("text"),
        "conversations",
    ),
    # The oldest layout: it never had symbols.
    "kb_facts_page": _fact_sql(
        "page_id",
        "NULL",
        "concat('SCAN:', split_part(url, '/', 4), '/', CAST(page_id % 10 AS STRING))",
        "concat('src', CAST(page_id % 20 AS STRING))",
        "url",
        "html",
        "pages",
    ),
}

_ANALYSES = """
    SELECT pr_id, CASE WHEN repo = '{unanalysed}' THEN 'archive' ELSE repo END AS repo,
           TIMESTAMP '2024-01-01 00:00:00' + CAST(min(fact_id) % 400 AS INT) * INTERVAL '1' HOUR AS ts,
           CASE WHEN min(fact_id) % 4 = 0 THEN concat('PR-', CAST(min(fact_id) AS STRING)) END AS triggered_by
    FROM {facts} GROUP BY pr_id, CASE WHEN repo = '{unanalysed}' THEN 'archive' ELSE repo END"""

_PLAIN = {
    "kb_dependencies": """
        SELECT l_orderkey * 10 + l_linenumber AS dep_id,
               concat('SCAN:', CASE l_returnflag WHEN 'A' THEN 'en' WHEN 'N' THEN 'fr' ELSE 'de' END,
                      '/', CAST(l_partkey % 10 AS STRING)) AS pr_id,
               concat('src', CAST(l_suppkey % 20 AS STRING)) AS repo,
               CASE WHEN l_partkey % 50 = 0 THEN 'json' ELSE concat(replace(p_name, ' ', '_'), '.py') END
                   AS from_component,
               CASE WHEN l_suppkey % 25 = 0 THEN 'react' ELSE s_name END AS to_component,
               CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'N' THEN 'imports' ELSE 'renders' END AS relation
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey""",
    "kb_dependencies_orders": """
        SELECT o_orderkey AS dep_id,
               concat('SCAN:', CASE o_orderstatus WHEN 'F' THEN 'en' WHEN 'O' THEN 'fr' ELSE 'es' END,
                      '/', CAST(o_custkey % 10 AS STRING)) AS pr_id,
               concat('src', CAST(o_custkey % 20 AS STRING)) AS repo,
               c_name AS from_component, concat(lower(c_mktsegment), '.go') AS to_component,
               'calls' AS relation
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "kb_repo_deps": """
        SELECT l_orderkey * 10 + l_linenumber AS dep_id, cn.n_name AS from_repo, sn.n_name AS to_repo,
               p_brand AS manifest, p_type AS raw_import, 'depends_on' AS relation
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
        JOIN {nation} cn ON c_nationkey = cn.n_nationkey JOIN {supplier} ON l_suppkey = s_suppkey
        JOIN {nation} sn ON s_nationkey = sn.n_nationkey JOIN {part} ON l_partkey = p_partkey""",
    # A second opinion on the same graph: edges seen from the supplying side.
    "kb_repo_deps_back": """
        SELECT l_orderkey * 10 + l_linenumber AS dep_id, sn.n_name AS from_repo, cn.n_name AS to_repo,
               p_brand AS manifest, p_type AS raw_import, 'required_by' AS relation
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
        JOIN {nation} cn ON c_nationkey = cn.n_nationkey JOIN {supplier} ON l_suppkey = s_suppkey
        JOIN {nation} sn ON s_nationkey = sn.n_nationkey JOIN {part} ON l_partkey = p_partkey""",
    "kb_repo_summaries": """
        SELECT concat('src', CAST(n_nationkey + 3 AS STRING)) AS repo, n_name AS summary,
               concat('2024-01-', lpad(CAST(n_nationkey + 1 AS STRING), 2, '0'), 'T00:00:00Z') AS updated_at
        FROM {nation}""",
    "kb_repo_summaries_region": """
        SELECT concat('src', CAST(r_regionkey * 3 AS STRING)) AS repo, r_name AS summary,
               '2023-06-01T00:00:00Z' AS updated_at
        FROM {region}""",
}


# Tables whose rows cost much work each, and a column of many values to spread them by.
SPREAD_TABLES = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id", "lineitem": "l_orderkey"}

_ANALYSED = {
    "kb_analyses": ("kb_facts", "src7"),
    "kb_analyses_talk": ("kb_facts_talk", "src3"),
    "kb_analyses_page": ("kb_facts_page", "src11"),
}

_FACT_COLUMNS = "fact_id, pr_id, repo, category, summary, detail, confidence, source"


def _template(name: str, spark: bool) -> str:
    """SQL text of a view with its inputs in braces. The engines differ in list calls only."""
    if name in _PLAIN:
        return _PLAIN[name]
    if name in _ANALYSED:
        facts, unanalysed = _ANALYSED[name]
        return _ANALYSES.format(facts=f"{{{facts}}} f", unanalysed=unanalysed)
    raw = _RAW_FACTS[name]
    if name == "kb_facts_page":
        return f"SELECT {_FACT_COLUMNS} FROM ({raw}) raw"
    found = _SYMBOLS.format(text="full_text", group=", 0" if spark else "")
    symbols = f"array_sort(array_distinct({found}))" if spark else f"list_sort(list_distinct({found}))"
    joined = f"array_join({symbols}, ' ')" if spark else f"array_to_string({symbols}, ' ')"
    return f"SELECT {_FACT_COLUMNS}, {symbols} AS symbols, {joined} AS symbols_text FROM ({raw}) raw"


def _inputs(template: str) -> list[str]:
    return sorted({field for _, field, _, _ in Formatter().parse(template) if field})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One base table or knowledge-base view as a DataFrame."""
    if not name.startswith("kb_"):
        stored = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return widen(stored, SPREAD_TABLES[name]) if name in SPREAD_TABLES else stored
    template = _template(name, spark=True)
    return spark.sql(template, **{n: table(spark, sf_dir, n) for n in _inputs(template)})


def views(*names: str) -> str:
    """The DuckDB form of the named views, as the comma-separated start of a WITH clause."""
    parts: dict[str, str] = {}

    def add(name: str) -> None:
        if name.startswith("kb_") and name not in parts:
            template = _template(name, spark=False)
            needed = _inputs(template)
            for n in needed:
                add(n)
            parts[name] = template.format(**{n: n for n in needed})

    for name in names:
        add(name)
    return ", ".join(f"{name} AS ({sql})" for name, sql in parts.items())
