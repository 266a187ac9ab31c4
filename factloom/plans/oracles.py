"""DuckDB equivalents of the queries, over the same tables and views."""

from __future__ import annotations

from factloom.functions.text import FOLD_FROM, FOLD_TO, IGNORED_WORDS, component_stem, split_clean
from factloom.operators.deps import NOISE_NAMES
from factloom.plans import queries as q
from factloom.plans.views import views
from factloom.sources.snapshots import NO_COPY, OLDER_COPY

ORACLES: dict[str, str] = {}


def _list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def _tokens(column: str) -> str:
    folded = f"translate(lower(coalesce({column}, '')), '{FOLD_FROM}', '{FOLD_TO}')"
    return rf"regexp_extract_all({folded}, '[\p{{L}}\p{{N}}\p{{Co}}]+')"


_COLUMNS = ("summary", "detail", "symbols_text")


def tok_cte(facts: str = "kb_facts") -> str:
    """tok(fact_id, col, pos, token) and dl(fact_id, doc_len) of a fact view."""
    parts = " UNION ALL ".join(
        f"SELECT fact_id, {i} AS col, unnest(l) AS token, unnest(range(len(l))) AS pos "
        f"FROM (SELECT fact_id, {_tokens(c)} AS l FROM {facts})"
        for i, c in enumerate(_COLUMNS)
    )
    length = " + ".join(f"len({_tokens(c)})" for c in _COLUMNS)
    return f"tok AS ({parts}), dl AS (SELECT fact_id, {length} AS doc_len FROM {facts})"


_FACTS = views("kb_facts")
_BOTH = views("kb_facts", "kb_analyses")

ORACLES["tokenize"] = f"""
    WITH {_FACTS}, {tok_cte()} SELECT fact_id, CAST(col AS INT) AS col, CAST(pos AS INT) AS pos, token FROM tok"""

_TOKEN_DF = "SELECT token, count(DISTINCT fact_id) AS df{cf} FROM tok GROUP BY token"
ORACLES["token_df"] = f"WITH {_FACTS}, {tok_cte()} {_TOKEN_DF.format(cf=', count(*) AS cf')}"
ORACLES["index_build"] = f"WITH {_FACTS}, {tok_cte()} {_TOKEN_DF.format(cf='')}"
ORACLES["corpus_stats"] = f"""
    WITH {_FACTS}, {tok_cte()}
    SELECT count(*) AS n, CAST(sum(doc_len) AS BIGINT) AS total_len, round(sum(doc_len) / count(*), 6) AS avgdl FROM dl"""
ORACLES["postings"] = f"""
    WITH {_BOTH}, {tok_cte()}
    SELECT token, fact_id, CAST(count(*) FILTER (col = 0) AS INT) AS tf0, CAST(count(*) FILTER (col = 1) AS INT) AS tf1,
           CAST(count(*) FILTER (col = 2) AS INT) AS tf2, any_value(doc_len) AS doc_len, any_value(a.pr_id IS NOT NULL) AS linked,
           string_agg(CAST(col * {1 << 28} + pos AS STRING), ' ' ORDER BY col, pos) AS positions
    FROM tok JOIN dl USING (fact_id) JOIN kb_facts USING (fact_id)
    LEFT JOIN kb_analyses a ON a.pr_id = kb_facts.pr_id AND a.repo = kb_facts.repo
    GROUP BY token, fact_id"""
ORACLES["index_incremental"] = f"""
    WITH {views('kb_facts', 'kb_facts_talk', 'kb_analyses_talk')},
    now AS (
      SELECT fact_id, summary, detail, symbols_text FROM kb_facts f
      WHERE NOT EXISTS (SELECT 1 FROM kb_analyses_talk a WHERE a.pr_id = f.pr_id AND a.repo = f.repo)
      UNION ALL SELECT fact_id + {q.SECOND_IDS}, summary, detail, symbols_text FROM kb_facts_talk),
    {tok_cte('now')} {_TOKEN_DF.format(cf='')}"""


def _phrases_cte(queries: list[str]) -> str:
    """words(query_id, phrase, mult): the same splitting rule, written in SQL."""
    rows = " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS query_id, '{text}' AS query" for i, text in enumerate(queries))
    return _phrases_from(f"({rows})")


def _phrases_from(source: str) -> str:
    words = r"regexp_split_to_array(query, '\s+')"
    return f"""
    split AS (SELECT query_id, unnest({words}) AS word FROM {source}),
    listed AS (SELECT query_id, {_tokens('word')} AS l FROM split),
    words AS (SELECT query_id, array_to_string(l, ' ') AS phrase, any_value(l) AS l, count(*) AS mult
              FROM listed WHERE len(l) > 0 GROUP BY query_id, array_to_string(l, ' '))"""


_SCORES = """
    places AS (SELECT DISTINCT phrase, len(l) AS size, unnest(l) AS token, unnest(range(len(l))) AS off FROM words),
    starts AS (SELECT phrase, fact_id, col, pos - off AS start FROM places JOIN tok USING (token)
               GROUP BY phrase, size, fact_id, col, pos - off HAVING count(*) = size),
    hits AS (SELECT phrase, fact_id, sum(CASE col WHEN 0 THEN 10.0 WHEN 1 THEN 5.0 ELSE 15.0 END) AS f
             FROM starts GROUP BY phrase, fact_id),
    total AS (SELECT count(*) AS n, CAST(sum(doc_len) AS DOUBLE) / count(*) AS avgdl FROM dl),
    freq AS (SELECT phrase, count(*) AS df FROM hits GROUP BY phrase),
    idf AS (SELECT phrase, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0
                           THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM freq, total),
    scored AS (SELECT query_id, fact_id,
                 -list_reduce(list_sort(list(mult * idf * CAST(f AS DOUBLE) * 2.2 / (f + 1.2 * (0.25 + 0.75 * doc_len / avgdl)))),
                              lambda a, b: a + b) AS score
               FROM words JOIN hits USING (phrase) JOIN idf USING (phrase) JOIN dl USING (fact_id), total
               GROUP BY query_id, fact_id)"""


def _ranked_cte(limit: int, where: str = "true") -> str:
    return f"""
    joined AS (SELECT query_id, fact_id, score, f.pr_id, f.repo, category, summary, detail, confidence, source, ts, triggered_by
               FROM scored JOIN kb_facts f USING (fact_id) JOIN kb_analyses a ON a.pr_id = f.pr_id AND a.repo = f.repo
               WHERE {where}),
    ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score,
                 CASE WHEN source = 'scan' THEN 0 ELSE 1 END, ts DESC, fact_id) AS rank FROM joined) WHERE rank <= {limit})"""


def _scored(queries: list[str]) -> str:
    return f"{tok_cte()}, {_phrases_cte(queries)}, {_SCORES}"


for _name, _text in (("bm25_scores", q.WORDS), ("phrase_scores", q.PHRASES)):
    ORACLES[_name] = f"WITH {_FACTS}, {_scored([_text])} SELECT fact_id, round(score, 6) AS score FROM scored"
ORACLES["phrase_match"] = f"""
    WITH {_FACTS}, {_scored([q.PHRASES])} SELECT phrase, fact_id, CAST(f AS DOUBLE) AS f FROM hits WHERE contains(phrase, ' ')"""

_RESULT = """SELECT CAST(rank AS INT) AS rank, round(score, 6) AS score, fact_id, pr_id, repo, category, md5(summary) AS summary,
    md5(detail) AS detail, confidence, source, CAST(ts AS STRING) AS ts, triggered_by FROM ranked"""
for _name, _text, _limit, _where in (
    ("bm25_search", q.WORDS, 50, "true"),
    ("search_filtered", q.WORDS, 20, "category = 'design' AND confidence >= 0.3"),
    ("search_in_repo", q.PHRASES, 100, f"f.repo = '{q.REPO}'"),
):
    ORACLES[_name] = f"WITH {_BOTH}, {_scored([_text])}, {_ranked_cte(_limit, _where)} {_RESULT}"

ORACLES["batch_search"] = f"""
    WITH {_BOTH}, {tok_cte()}, {_phrases_from('(SELECT item_id AS query_id, text AS query FROM benchmark)')}, {_SCORES},
    {_ranked_cte(20)}
    SELECT query_id, CAST(rank AS INT) AS rank, fact_id, round(score, 6) AS score FROM ranked"""

_MULTI = split_clean(q.MULTI, ";")
_MULTI_CTE = f"""{_BOTH}, {_scored(_MULTI)}, {_ranked_cte(30)},
    firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pr_id, category, summary ORDER BY query_id, rank) AS n
               FROM ranked) WHERE n = 1),
    capped AS (SELECT * FROM firsts ORDER BY query_id, rank LIMIT {min(30 * len(_MULTI), 70)})"""
ORACLES["multi_search"] = f"""
    WITH {_MULTI_CTE}
    SELECT query_id, CAST(rank AS INT) AS rank, fact_id, pr_id, repo, category, round(score, 6) AS score FROM capped"""

_LINKED = "kb_facts f JOIN kb_analyses a ON a.pr_id = f.pr_id AND a.repo = f.repo"
_fold = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["like_search"] = f"""
    WITH {_BOTH}
    SELECT fact_id, f.pr_id, f.repo, category, md5(summary) AS summary, md5(detail) AS detail, confidence, source,
           CAST(ts AS STRING) AS ts, triggered_by
    FROM {_LINKED}
    WHERE ({_fold.format('summary')} LIKE '%{q.SUBSTRING.lower()}%' OR {_fold.format('detail')} LIKE '%{q.SUBSTRING.lower()}%')
      AND confidence >= 0.2
    ORDER BY confidence DESC, fact_id LIMIT 50"""

_HIT = "({0} LIKE '%' || {1} || '%' OR {2} LIKE '%' || {1} || '%')".format(
    _fold.format("summary"), "pattern", _fold.format("detail")
)
ORACLES["batch_like_search"] = f"""
    WITH {_BOTH}, asked AS (
        SELECT item_id AS query_id, substr(text, 1, 24) AS query FROM benchmark
        UNION ALL SELECT item_id + {q.SECOND_IDS}, regexp_extract(text, '[^a-zA-Z0-9%_ ]') FROM benchmark
        WHERE regexp_extract(text, '[^a-zA-Z0-9%_ ]') <> ''),
    folded AS (SELECT query_id, {_fold.format('query')} AS pattern FROM asked),
    found AS (SELECT query_id, fact_id, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, fact_id) AS rank
              FROM folded JOIN (SELECT * FROM {_LINKED} WHERE confidence >= 0.2) ON {_HIT})
    SELECT query_id, CAST(rank AS INT) AS rank, fact_id FROM found WHERE rank <= 20"""

# Two of three passages can be read as words: alternatives, or words that have to stand together with "or".
ORACLES["batch_quoted"] = f"""
    WITH {_BOTH}, {tok_cte()},
    asked AS (SELECT item_id AS query_id, l[1] AS a, l[2] AS b
              FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z]+') AS l FROM benchmark)),
    listed AS (SELECT query_id, unnest(CASE query_id % 3 WHEN 0 THEN [a, b] ELSE [a, 'or', b] END) AS word
               FROM asked WHERE query_id % 3 < 2),
    folded AS (SELECT query_id, {_tokens('word')} AS l FROM listed),
    words AS (SELECT query_id, array_to_string(l, ' ') AS phrase, any_value(l) AS l, count(*) AS mult
              FROM folded WHERE len(l) > 0 GROUP BY query_id, array_to_string(l, ' ')),
    {_SCORES.replace('GROUP BY query_id, fact_id)', 'GROUP BY query_id, fact_id HAVING query_id % 3 = 0 OR count(*) = (SELECT count(*) FROM words w WHERE w.query_id = words.query_id))')},
    {_ranked_cte(20)},
    lost AS (SELECT query_id, fact_id, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, fact_id) AS rank
             FROM (SELECT query_id, {_fold.format("(a || chr(34))")} AS pattern FROM asked WHERE query_id % 3 = 2)
             JOIN (SELECT * FROM {_LINKED}) ON {_HIT})
    SELECT query_id, CAST(rank AS INT) AS rank, fact_id, round(score, 6) AS score FROM ranked
    UNION ALL SELECT query_id, CAST(rank AS INT), fact_id, NULL FROM lost WHERE rank <= 20"""

# --- listings ---------------------------------------------------------------

ORACLES["fact_projection"] = f"""
    WITH {_FACTS}
    SELECT fact_id, pr_id, repo, category, md5(summary) AS summary, md5(detail) AS detail, confidence, source,
           CAST(len(symbols) AS INT) AS n_files, array_to_string(symbols, ',') AS symbols FROM kb_facts"""
ORACLES["module_facts"] = f"""
    WITH {_FACTS}
    SELECT fact_id, pr_id, repo, category, md5(summary) AS summary, md5(detail) AS detail, confidence, source
    FROM kb_facts WHERE pr_id = '{q.MODULE}' ORDER BY category, confidence DESC, fact_id"""
for _name, _where, _limit in (("recent_facts", "true", 20), ("recent_by_category", "category = 'design'", 10)):
    ORACLES[_name] = f"""
    WITH {_BOTH}
    SELECT fact_id, f.pr_id, f.repo, category, md5(summary) AS summary, confidence, source, CAST(ts AS STRING) AS ts,
           triggered_by
    FROM {_LINKED} WHERE {_where} ORDER BY a.ts DESC, fact_id LIMIT {_limit}"""
_JSON = "repo := f.repo, category := category, summary := summary, detail := detail, confidence := confidence"
_SYMBOLS_JSON = "symbols := CASE WHEN len(symbols) > 0 THEN symbols END"
ORACLES["module_facts_json"] = f"""
    WITH {_FACTS}
    SELECT fact_id, CAST(json_merge_patch('{{}}', to_json(struct_pack({_JSON}, {_SYMBOLS_JSON}))) AS VARCHAR) AS value
    FROM kb_facts f WHERE pr_id = '{q.MODULE}'"""
ORACLES["recent_json"] = f"""
    WITH {_BOTH}
    SELECT fact_id, CAST(json_merge_patch('{{}}', to_json(struct_pack({_JSON}, {_SYMBOLS_JSON},
           timestamp := strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), triggered_by := triggered_by))) AS VARCHAR) AS value
    FROM {_LINKED} ORDER BY a.ts DESC, fact_id LIMIT 20"""
ORACLES["validate_analyses"] = f"""
    WITH {views('kb_facts_talk')}
    SELECT pr_id, repo, max(fact_id) AS arrival, CASE max(fact_id) % 5 WHEN 0 THEN 'unreadable timestamp'
           WHEN 1 THEN 'confidence out of range' WHEN 2 THEN 'incomplete dependency' END AS reason
    FROM kb_facts_talk GROUP BY pr_id, repo, fact_id % 7"""
ORACLES["linked_facts"] = f"""
    WITH {_BOTH} SELECT fact_id, f.pr_id, f.repo, CAST(ts AS STRING) AS ts, triggered_by FROM {_LINKED}"""
ORACLES["validate_facts"] = f"""
    WITH {_FACTS}
    SELECT fact_id, CASE WHEN detail = '' THEN 'missing detail' WHEN repo = 'src1' THEN 'unknown category'
      WHEN repo = 'src2' THEN 'unknown source' WHEN confidence * CAST(1.1 AS DOUBLE) > 1 THEN 'confidence out of range' END AS reason
    FROM kb_facts"""
ORACLES["modules_in_repo"] = f"""
    WITH {_FACTS} SELECT pr_id AS module_id, repo, count(*) AS fact_count FROM kb_facts
    WHERE repo = '{q.REPO}' GROUP BY pr_id, repo"""
_SUMMARIES = views("kb_facts", "kb_repo_summaries")
ORACLES["repo_overview"] = f"""
    WITH {_SUMMARIES}
    SELECT f.repo, count(DISTINCT pr_id) AS modules, count(*) AS facts, any_value(s.summary) AS summary
    FROM kb_facts f LEFT JOIN kb_repo_summaries s ON s.repo = f.repo GROUP BY f.repo"""
ORACLES["repo_catalog"] = f"""
    WITH {_SUMMARIES}
    SELECT s.repo, s.summary, updated_at, count(f.fact_id) AS facts,
           concat('- ', s.repo, ' (', count(f.fact_id), ' facts): ', s.summary) AS line
    FROM kb_repo_summaries s LEFT JOIN kb_facts f ON f.repo = s.repo GROUP BY s.repo, s.summary, updated_at"""


def _touch(component: str) -> str:
    part = component_stem(component).lower()
    return " OR ".join(f"contains({_fold.format(c)}, '{part}')" for c in ("from_component", "to_component"))


_QUIET = f"from_component NOT IN ({_list(NOISE_NAMES)}) AND to_component NOT IN ({_list(NOISE_NAMES)})"
_EDGE = "pr_id, repo, from_component, to_component, relation"
_DEPS = views("kb_dependencies")
ORACLES["component_impact"] = f"""
    WITH {_DEPS} SELECT DISTINCT {_EDGE} FROM kb_dependencies WHERE ({_touch(q.COMPONENT)}) AND {_QUIET}"""
ORACLES["component_impact_batch"] = f"WITH {_DEPS} " + " UNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS component, {_EDGE} FROM kb_dependencies WHERE ({_touch(c)}) AND {_QUIET}"
    for c in q.COMPONENTS
)

ORACLES["component_impact_join"] = f"""
    WITH {_DEPS}, named AS (SELECT s_name AS component FROM supplier UNION SELECT replace(p_name, ' ', '_') || '.go' FROM part),
    stems AS (SELECT component, {_fold.format("regexp_replace(component, '[.][^.]*$', '')")} AS stem FROM named)
    SELECT DISTINCT component, {_EDGE} FROM stems JOIN (SELECT * FROM kb_dependencies WHERE {_QUIET})
      ON contains({_fold.format('from_component')}, stem) OR contains({_fold.format('to_component')}, stem)"""

# --- merging ------------------------------------------------------------------

_REPO_EDGES = f"""{views('kb_repo_deps', 'kb_repo_deps_back')},
    edges AS (SELECT 0 AS src_ord, * FROM kb_repo_deps UNION ALL SELECT 1 AS src_ord, * FROM kb_repo_deps_back)"""


def _first_edges(key: str) -> str:
    return f"""firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key}
        ORDER BY src_ord, dep_id, relation) AS n FROM edges) WHERE n = 1)"""


_KEY4 = "from_repo, to_repo, manifest, raw_import"
_GRAPH = f"WITH {_REPO_EDGES}, {_first_edges(_KEY4)} SELECT {_KEY4}, relation FROM firsts"
ORACLES["repo_deps_all"] = _GRAPH
ORACLES["repo_deps_out"] = f"{_GRAPH} WHERE from_repo = '{q.NATION}'"
ORACLES["repo_deps_in"] = f"{_GRAPH} WHERE to_repo = '{q.NATION}'"
ORACLES["repo_deps_both"] = f"{_GRAPH} WHERE from_repo = '{q.NATION}' OR to_repo = '{q.NATION}'"
ORACLES["merge_repo_dependencies"] = (
    f"WITH {_REPO_EDGES}, {_first_edges(_KEY4)} SELECT {_KEY4}, relation, CAST(src_ord AS INT) AS src_ord FROM firsts"
)
_KEY3 = "from_repo, to_repo, raw_import"
ORACLES["merge_repo_dependencies_by_import"] = (
    f"WITH {_REPO_EDGES}, {_first_edges(_KEY3)} SELECT {_KEY3}, relation, CAST(src_ord AS INT) AS src_ord FROM firsts"
)

_FACT_COLUMNS = "fact_id, pr_id, repo, category, summary, detail, confidence, source"
_FACTS_CTE = f"""facts AS (
      SELECT 0 AS src_ord, {_FACT_COLUMNS}, symbols_text FROM kb_facts
      UNION ALL SELECT 1, {_FACT_COLUMNS}, symbols_text FROM kb_facts_talk
      UNION ALL SELECT 2, {_FACT_COLUMNS}, '[]' FROM kb_facts_page)"""
_UNION_FACTS = f"{views(*q.FACT_SOURCES)}, {_FACTS_CTE}"
_UNION_ANALYSES = """analyses AS (
      SELECT 0 AS src_ord, pr_id, repo, ts, triggered_by FROM kb_analyses
      UNION ALL SELECT 1, pr_id, repo, ts, triggered_by FROM kb_analyses_talk
      UNION ALL SELECT 2, pr_id, repo, ts, NULL FROM kb_analyses_page)"""
_SLIM = "pr_id, repo, category, md5(summary) AS summary, md5(detail) AS detail, confidence, source"

ORACLES["union_sources"] = (
    f"WITH {_UNION_FACTS} SELECT CAST(src_ord AS INT) AS src_ord, fact_id, {_SLIM}, symbols_text FROM facts"
)
ORACLES["align_schema"] = f"""
    WITH {views('kb_facts_page')}
    SELECT fact_id, pr_id, repo, '[]' AS symbols_text, CAST(0 AS INT) AS n_symbols, CAST(0 AS INT) AS n_files FROM kb_facts_page"""
_WITH_ALL = f"{views(*q.FACT_SOURCES, *q.ANALYSIS_SOURCES)}, {_FACTS_CTE}, {_UNION_ANALYSES}"
ORACLES["merge_analyses"] = f"""
    WITH {_WITH_ALL}
    SELECT pr_id, repo, CAST(ts AS STRING) AS ts, triggered_by, CAST(src_ord AS INT) AS src_ord
    FROM (SELECT *, row_number() OVER (PARTITION BY pr_id, repo ORDER BY src_ord DESC) AS n FROM analyses) WHERE n = 1"""
ORACLES["merge_facts"] = f"""
    WITH {_WITH_ALL}, owner AS (SELECT pr_id, repo, max(src_ord) AS m FROM analyses GROUP BY pr_id, repo),
    kept AS (SELECT * FROM facts LEFT JOIN owner USING (pr_id, repo) WHERE m IS NULL OR src_ord >= m),
    spans AS (SELECT src_ord, min(fact_id) AS low, max(fact_id) AS high FROM kept GROUP BY src_ord),
    shifts AS (SELECT src_ord, coalesce(sum(high - low + 1) OVER (ORDER BY src_ord ROWS BETWEEN UNBOUNDED PRECEDING
               AND 1 PRECEDING), 0) - low AS shift FROM spans)
    SELECT CAST(fact_id + shift AS BIGINT) AS fact_id, CAST(src_ord AS INT) AS src_ord, {_SLIM}
    FROM kept JOIN shifts USING (src_ord)"""
_RENEWED = _SLIM.replace("md5(summary)", "md5(CASE src_ord WHEN 1 THEN concat('renewed ', summary) ELSE summary END)")
ORACLES["merge_changed_source"] = f"""
    WITH {_WITH_ALL}, owner AS (SELECT pr_id, repo, max(src_ord) AS m FROM analyses GROUP BY pr_id, repo)
    SELECT CAST(src_ord AS INT) AS src_ord, fact_id, {_RENEWED}
    FROM facts LEFT JOIN owner USING (pr_id, repo) WHERE m IS NULL OR src_ord >= m"""
ORACLES["replaced_facts_semi"] = f"""
    WITH {views('kb_facts', 'kb_analyses_talk')}
    SELECT fact_id, pr_id, repo FROM kb_facts f
    WHERE EXISTS (SELECT 1 FROM kb_analyses_talk a WHERE a.pr_id = f.pr_id AND a.repo = f.repo)"""
ORACLES["merge_dependencies"] = f"""
    WITH {views('kb_dependencies', 'kb_dependencies_orders', 'kb_analyses', 'kb_analyses_talk')},
    owner AS (SELECT pr_id, repo, max(o) AS m FROM (SELECT pr_id, repo, 0 AS o FROM kb_analyses
              UNION ALL SELECT pr_id, repo, 1 FROM kb_analyses_talk) GROUP BY pr_id, repo),
    rows_ AS (SELECT 0 AS src_ord, * FROM kb_dependencies UNION ALL SELECT 1, * FROM kb_dependencies_orders)
    SELECT CAST(src_ord AS INT) AS src_ord, dep_id, {_EDGE} FROM rows_ LEFT JOIN owner USING (pr_id, repo)
    WHERE m IS NULL OR src_ord >= m"""
ORACLES["merge_summaries"] = f"""
    WITH {views('kb_repo_summaries', 'kb_repo_summaries_region')},
    rows_ AS (SELECT 0 AS src_ord, * FROM kb_repo_summaries UNION ALL SELECT 1, * FROM kb_repo_summaries_region)
    SELECT repo, summary, updated_at, CAST(src_ord AS INT) AS src_ord
    FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY src_ord DESC) AS n FROM rows_) WHERE n = 1"""
ORACLES["merge_counts"] = (
    f"WITH {_UNION_FACTS} SELECT CAST(src_ord AS INT) AS src_ord, count(*) AS facts FROM facts GROUP BY src_ord"
)
ORACLES["replace_analysis"] = f"""
    WITH {views('kb_facts', 'kb_facts_talk')},
    last AS (SELECT pr_id, repo, max(fact_id) % 7 AS turn FROM kb_facts_talk GROUP BY pr_id, repo)
    SELECT {_SLIM} FROM kb_facts f
    WHERE NOT EXISTS (SELECT 1 FROM kb_facts_talk t WHERE t.pr_id = f.pr_id AND t.repo = f.repo)
    UNION ALL SELECT {_SLIM} FROM kb_facts_talk JOIN last USING (pr_id, repo) WHERE fact_id % 7 = turn"""
ORACLES["nested_analysis"] = f"""
    WITH {views('kb_facts', 'kb_analyses', 'kb_dependencies')},
    nf AS (SELECT pr_id, repo, count(*) AS n, sum(confidence) AS c FROM kb_facts GROUP BY pr_id, repo),
    nd AS (SELECT pr_id, repo, count(*) AS n FROM kb_dependencies GROUP BY pr_id, repo)
    SELECT pr_id, repo, coalesce(nf.n, 0) AS n_facts, coalesce(nd.n, 0) AS n_dependencies, round(coalesce(c, 0), 6) AS confidence
    FROM kb_analyses LEFT JOIN nf USING (pr_id, repo) LEFT JOIN nd USING (pr_id, repo)"""
ORACLES["get_analysis"] = f"""
    WITH {_BOTH}
    SELECT pr_id, repo, fact_id, category, md5(summary) AS summary, confidence FROM kb_facts
    WHERE pr_id = '{q.MODULE}' AND repo = (SELECT min(repo) FROM kb_analyses WHERE pr_id = '{q.MODULE}')"""

# --- near-duplicates ----------------------------------------------------------


def _word_list(column: str) -> str:
    found = f"list_distinct(regexp_extract_all(lower({column}), '[a-z0-9_]+'))"
    return f"list_sort(list_filter({found}, lambda w: NOT list_contains([{_list(IGNORED_WORDS)}], w)))"


ORACLES["word_sets"] = f"SELECT doc_id, array_to_string({_word_list('text')}, ' ') AS words FROM documents"


def greedy_ctes(source: str) -> str:
    """dropped(grp, id) of ``source`` (grp, id, words), walked in id order.

    All similar pairs are found first; the walk then visits only rows that have
    a similar earlier row, and drops those with one that is still kept.
    """
    return f"""
    src AS ({source}),
    shared AS (SELECT a.grp, a.id AS a, b.id AS b, len(list_intersect(a.words, b.words)) AS o,
                      len(a.words) + len(b.words) AS total
               FROM src a JOIN src b ON a.grp = b.grp AND a.id < b.id AND len(a.words) > 0 AND len(b.words) > 0
                AND 4 * least(len(a.words), len(b.words)) > 3 * greatest(len(a.words), len(b.words))),
    pairs AS (SELECT grp, a, b, CAST(o AS DOUBLE) / (total - o) AS jaccard FROM shared WHERE 4 * o > 3 * (total - o)),
    early AS (SELECT grp, b AS id, list(a) AS earlier FROM pairs GROUP BY grp, b),
    visit AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY id) AS rn FROM early),
    walk AS (SELECT DISTINCT grp, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS gone FROM visit
      UNION ALL SELECT w.grp, v.rn,
        CASE WHEN len(list_filter(v.earlier, lambda e: NOT list_contains(w.gone, e))) > 0
             THEN list_append(w.gone, v.id) ELSE w.gone END
      FROM walk w JOIN visit v ON v.grp = w.grp AND v.rn = w.rn + 1),
    dropped AS (SELECT grp, unnest(gone) AS id FROM walk
                WHERE (grp, rn) IN (SELECT (grp, max(rn)) FROM walk GROUP BY grp))"""


def _documents(group: str) -> str:
    return greedy_ctes(f"SELECT {group} AS grp, doc_id AS id, {_word_list('text')} AS words FROM documents")


for _name, _group in (("neardup_table", "lang"), ("neardup_by_repo", "source")):
    ORACLES[_name] = f"""
    WITH RECURSIVE {_documents(_group)}
    SELECT grp AS {_group}, id AS doc_id FROM src WHERE id NOT IN (SELECT id FROM dropped)"""
_ARRIVING = f"""SELECT lang AS grp, doc_id AS id, {_word_list('text')} AS words FROM documents UNION ALL
    SELECT CASE turn % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END,
           conv_id * 1000 + turn + {q.SECOND_IDS}, {_word_list('text')} FROM conversations"""
ORACLES["neardup_arriving"] = f"""
    WITH RECURSIVE {greedy_ctes(_ARRIVING)}
    SELECT grp AS lang, id AS doc_id FROM src WHERE id NOT IN (SELECT id FROM dropped)"""
ORACLES["jaccard_pairs"] = f"""
    WITH RECURSIVE {_documents('lang')}
    SELECT grp AS lang, b AS doc_id, min(a) AS kept_id, round(arg_min(jaccard, a), 6) AS jaccard
    FROM pairs WHERE b IN (SELECT id FROM dropped) AND a NOT IN (SELECT id FROM dropped) GROUP BY grp, b"""
ORACLES["neardup_ranked"] = f"""
    WITH RECURSIVE {_MULTI_CTE},
    {greedy_ctes(f"SELECT repo AS grp, query_id * 101 + rank AS id, {_word_list('summary')} AS words FROM capped")}
    SELECT query_id, CAST(rank AS INT) AS rank, fact_id, repo FROM capped
    WHERE (repo, query_id * 101 + rank) NOT IN (SELECT (grp, id) FROM dropped)"""

# --- sources and streams --------------------------------------------------------

ORACLES["scan_snapshots"] = f"WITH {_FACTS} SELECT fact_id, {_SLIM}, array_to_string(symbols, ',') AS symbols FROM kb_facts"
_LOST = [("release/facts", "unreadable"), ("release", OLDER_COPY), ("none", NO_COPY)]
ORACLES["scan_sources"] = f"""
    WITH {views('kb_facts', 'kb_facts_talk', 'kb_facts_page')}
    SELECT 0 AS src_ord, fact_id, {_SLIM}, array_to_string(symbols, ',') AS symbols FROM kb_facts
    UNION ALL SELECT 1, fact_id, {_SLIM}, array_to_string(symbols, ',') FROM kb_facts_talk
    UNION ALL SELECT 2, fact_id, {_SLIM}, '' FROM kb_facts_page
    """ + " ".join(f"UNION ALL SELECT NULL, NULL, '{path}', NULL, 'reject', NULL, '{why}', NULL, NULL, NULL" for path, why in _LOST)
_STREAMED = f"""{_UNION_FACTS},
    last AS (SELECT pr_id, repo, arg_max(fact_id % 7, src_ord * 1099511627776 + fact_id) AS turn, max(src_ord) AS src_ord
             FROM facts GROUP BY pr_id, repo),
    now AS (SELECT * FROM facts JOIN last USING (pr_id, repo, src_ord) WHERE fact_id % 7 = turn)"""
ORACLES["stream_replace"] = f"WITH {_STREAMED} SELECT {_SLIM} FROM now"
_STREAM_TEXT = "bare AS (SELECT src_ord * 1099511627776 + fact_id AS fact_id, summary, detail, symbols_text FROM now)"
ORACLES["stream_index"] = f"WITH {_STREAMED}, {_STREAM_TEXT}, {tok_cte('bare')} {_TOKEN_DF.format(cf='')}"
