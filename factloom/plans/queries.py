"""Every operator as a query over the driver's tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import word_set
from factloom.operators import analyses as nested_ops
from factloom.operators import catalog, deps, facts, index, merge, neardup, search
from factloom.operators.upkeep import MergedStore
from factloom.plans.tools import KnowledgeBase
from factloom.plans.views import table
from factloom.session import scratch_path
from factloom.sources import snapshots
from factloom.sources.schemas import NESTED_ANALYSIS, align
from factloom.streaming.store import ARRIVAL_SCHEMA, StreamStore, run_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Search texts. A word with an underscore is a phrase of adjacent tokens.
WORDS = "anat the nterti ththre the --"
PHRASES = "of_the it_is in_der de_la_que anat"
MULTI = "anat nterti; ththre the ; ;of_the; anat"
SUBSTRING = "Anat"
COMPONENT = "small_ring.py"
COMPONENTS = ["small_ring.py", "Supplier#000000007", "large", "json"]
REPO, MODULE, NATION = "src5", "SCAN:en/1", "NATION_3"

# Ids of facts that are added to an index start here.
SECOND_IDS = 1 << 48
FACT_SOURCES = ("kb_facts", "kb_facts_talk", "kb_facts_page")
ANALYSIS_SOURCES = ("kb_analyses", "kb_analyses_talk", "kb_analyses_page")

_indexes: dict[tuple[str, str], index.TextIndex] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def stored_index(spark: SparkSession, sf: str) -> index.TextIndex:
    """The index of ``kb_facts``, built once per application and data folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _indexes:
        _indexes[key] = index.build_index(table(spark, sf, "kb_facts"), table(spark, sf, "kb_analyses"))
    return _indexes[key]


def gram_index(spark: SparkSession, sf: str) -> index.TextIndex:
    """The same index with the grams of its vocabulary."""
    found = stored_index(spark, sf)
    if found.grams is None:
        found = _indexes[spark.sparkContext.applicationId, sf] = index.with_grams(found)
    return found


def knowledge_base(spark: SparkSession, sf: str) -> KnowledgeBase:
    tables = {
        "facts": table(spark, sf, "kb_facts"),
        "pr_analyses": table(spark, sf, "kb_analyses"),
        "dependencies": table(spark, sf, "kb_dependencies"),
        "repo_summaries": table(spark, sf, "kb_repo_summaries"),
        "repo_dependencies": table(spark, sf, "kb_repo_deps"),
    }
    return KnowledgeBase(tables, stored_index(spark, sf))


def _ts(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("string"))


def _score(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def _text(df: DataFrame, *names: str) -> DataFrame:
    """Long texts as digests, so that results stay comparable in full."""
    return df.withColumns({name: F.md5(name) for name in names})


# --- text and index -------------------------------------------------------


@query
def tokenize(spark, sf):
    return index.tokenise(table(spark, sf, "kb_facts"))


@query
def token_df(spark, sf):
    """Document frequency and total occurrences of every token."""
    found = index.tokenise(table(spark, sf, "kb_facts")).groupBy("token", "fact_id").agg(F.count(F.lit(1)).alias("n"))
    return found.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("cf"))


@query
def corpus_stats(spark, sf):
    stats = index.statistics_row(index.document_rows(table(spark, sf, "kb_facts")))
    return stats.withColumn("avgdl", F.round(F.col("total_len") / F.col("n"), 6))


@query
def postings(spark, sf):
    rows = index.posting_rows(
        index.link_attributes(table(spark, sf, "kb_facts"), table(spark, sf, "kb_analyses"))
    )
    return rows.select(
        "token", "fact_id", "tf0", "tf1", "tf2", "doc_len", "linked",
        F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"),
    )


@query
def index_build(spark, sf):
    """Build and store the whole index, then read document frequencies from it."""
    built = index.build_index(table(spark, sf, "kb_facts"), table(spark, sf, "kb_analyses"))
    return index.document_frequency(built.postings)


@query
def stem_vocab(spark, sf):
    return index.vocabulary_rows(index.tokenise(table(spark, sf, "kb_facts")))


@query
def index_incremental(spark, sf):
    """Replace the facts whose modules come again in the conversations; document frequencies after it."""
    gone = merge.replaced_rows(table(spark, sf, "kb_facts"), table(spark, sf, "kb_analyses_talk"), "fact_id")
    added = table(spark, sf, "kb_facts_talk").withColumn("fact_id", F.col("fact_id") + SECOND_IDS)
    analyses = merge.merge_analyses(_united(spark, sf, ("kb_analyses", "kb_analyses_talk"), "pr_analyses"))
    updated = index.update_index(stored_index(spark, sf), gone, added, analyses)
    return index.document_frequency(updated.postings)


# --- search -----------------------------------------------------------------


def _all_scores(spark, sf, text):
    scored = search.score(stored_index(spark, sf), [text], linked_only=False)
    return _score(scored.select("fact_id", "score"))


@query
def bm25_scores(spark, sf):
    return _all_scores(spark, sf, WORDS)


@query
def phrase_scores(spark, sf):
    return _all_scores(spark, sf, PHRASES)


@query
def phrase_match(spark, sf):
    phrases = search.parse_list(spark, [PHRASES])
    found = search.match_phrases(stored_index(spark, sf), phrases).where(F.size("phrase") > 1)
    return found.select(F.array_join("phrase", " ").alias("phrase"), "fact_id", "f")


def _found(df: DataFrame) -> DataFrame:
    return _text(_ts(_score(df)), "summary", "detail").select(
        "rank", "score", "fact_id", "pr_id", "repo", "category", "summary", "detail", "confidence", "source", "ts",
        "triggered_by",
    )


def _search(spark, sf, text, **options):
    facts_, analyses_ = table(spark, sf, "kb_facts"), table(spark, sf, "kb_analyses")
    return search.search(stored_index(spark, sf), facts_, analyses_, text, **options)


@query
def bm25_search(spark, sf):
    return _found(_search(spark, sf, WORDS, limit=50, stemmed=False))


@query
def search_filtered(spark, sf):
    return _found(_search(spark, sf, WORDS, category="design", min_confidence=0.3, limit=20, stemmed=False))


@query
def search_in_repo(spark, sf):
    return _found(_search(spark, sf, PHRASES, repo_name=REPO, limit=100, stemmed=False))


@query
def search_stemmed(spark, sf):
    return _found(_search(spark, sf, WORDS, limit=100))


@query
def batch_search(spark, sf):
    """Every benchmark passage as one query."""
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    scored = search.score(stored_index(spark, sf), queries)
    return _score(search.rank(scored, 20)).select("query_id", "rank", "fact_id", "score")


@query
def batch_search_stemmed(spark, sf):
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    scored = search.score(stored_index(spark, sf), queries, stemmed=True)
    return _score(search.rank(scored, 20)).select("query_id", "rank", "fact_id", "score")


@query
def multi_search(spark, sf):
    kb = knowledge_base(spark, sf)
    found = kb.search_facts(MULTI, collapse=False, limit=30, stemmed=False)
    return _score(found).select("query_id", "rank", "fact_id", "pr_id", "repo", "category", "score")


@query
def neardup_ranked(spark, sf):
    kb = knowledge_base(spark, sf)
    found = kb.search_facts(MULTI, limit=30, stemmed=False)
    return found.select("query_id", "rank", "fact_id", "repo")


@query
def clean_json(spark, sf):
    return knowledge_base(spark, sf).search_json(MULTI, limit=30)


@query
def module_facts_json(spark, sf):
    return knowledge_base(spark, sf).module_facts_json(MODULE)


@query
def recent_json(spark, sf):
    return knowledge_base(spark, sf).recent_json(limit=20)


@query
def validate_analyses(spark, sf):
    """Arrivals of the conversations, some of them with an unreadable time, an unsure fact or an edge without end."""
    rows = _arrivals(table(spark, sf, "kb_facts_talk"))
    number = F.col("arrival")
    unsure = F.transform("facts", lambda f: f.withField("confidence", F.lit(1.5)))
    open_edge = F.transform("dependencies", lambda d: d.withField("to_component", F.lit(None).cast("string")))
    bad = rows.withColumns(
        {
            "timestamp": F.when(number % 5 == 0, "yesterday").otherwise(F.col("timestamp")),
            "facts": F.when(number % 5 == 1, unsure).otherwise(F.col("facts")),
            "dependencies": F.when(number % 5 == 2, open_edge).otherwise(F.col("dependencies")),
        }
    )
    return nested_ops.validate_analyses(bad).select("pr_id", "repo", "arrival", "reason")


@query
def like_search(spark, sf):
    found = search.like_search(
        table(spark, sf, "kb_facts"), table(spark, sf, "kb_analyses"), SUBSTRING, min_confidence=0.2, limit=50,
        index=gram_index(spark, sf),
    )
    return _text(_ts(found), "summary", "detail").select(
        "fact_id", "pr_id", "repo", "category", "summary", "detail", "confidence", "source", "ts", "triggered_by"
    )


@query
def batch_like_search(spark, sf):
    """The first words of every benchmark passage as a substring, and the sign behind them."""
    part = F.substring("text", 1, 24)
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), part.alias("query"))
    signs = table(spark, sf, "benchmark").select(
        (F.col("item_id") + SECOND_IDS).alias("query_id"), F.regexp_extract("text", "[^a-zA-Z0-9%_ ]", 0).alias("query")
    )
    facts_, analyses_ = table(spark, sf, "kb_facts"), table(spark, sf, "kb_analyses")
    queries = asked.unionByName(signs.where("query <> ''"))
    return search.substring_hits(gram_index(spark, sf), facts_, analyses_, queries, 20, min_confidence=0.2)


@query
def batch_quoted(spark, sf):
    """Benchmark passages in quotes: ranked where the quotes can be read as words, else found as substrings."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    text = (
        F.when(F.col("item_id") % 3 == 0, F.concat(F.lit('"'), first, F.lit('" '), second))
        .when(F.col("item_id") % 3 == 1, F.concat(F.lit('"'), first, F.lit(" "), second, F.lit('"')))
        .otherwise(F.concat(first, F.lit('"')))
    )
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), text.alias("query"))
    found = search.search_batch(
        gram_index(spark, sf), table(spark, sf, "kb_facts"), table(spark, sf, "kb_analyses"), queries, 20, stemmed=False
    )
    return _score(found).select("query_id", "rank", "fact_id", "score")


# --- listings ---------------------------------------------------------------


@query
def fact_projection(spark, sf):
    stored = table(spark, sf, "kb_facts").withColumns(
        {"symbols": F.to_json("symbols"), "source_files": F.to_json("symbols")}
    )
    return _text(facts.project(stored), "summary", "detail").select(
        "fact_id", "pr_id", "repo", "category", "summary", "detail", "confidence", "source",
        F.size("source_files").alias("n_files"), F.array_join("symbols", ",").alias("symbols"),
    )


@query
def module_facts(spark, sf):
    found = facts.module_facts(table(spark, sf, "kb_facts"), MODULE)
    return _text(found, "summary", "detail").select(
        "fact_id", "pr_id", "repo", "category", "summary", "detail", "confidence", "source"
    )


def _recent(spark, sf, **options):
    found = facts.recent_facts(table(spark, sf, "kb_facts"), table(spark, sf, "kb_analyses"), **options)
    return _text(_ts(found), "summary").select(
        "fact_id", "pr_id", "repo", "category", "summary", "confidence", "source", "ts", "triggered_by"
    )


@query
def recent_facts(spark, sf):
    return _recent(spark, sf, limit=20)


@query
def recent_by_category(spark, sf):
    return _recent(spark, sf, category="design", limit=10)


@query
def linked_facts(spark, sf):
    found = facts.linked_facts(table(spark, sf, "kb_facts"), table(spark, sf, "kb_analyses"))
    return _ts(found).select("fact_id", "pr_id", "repo", "ts", "triggered_by")


@query
def validate_facts(spark, sf):
    """Rules over facts with some values bent out of range."""
    bent = table(spark, sf, "kb_facts").withColumns(
        {
            "confidence": F.col("confidence") * 1.1,
            "category": F.when(F.col("repo") == "src1", "guess").otherwise(F.col("category")),
            "source": F.when(F.col("repo") == "src2", "bot").otherwise(F.col("source")),
            "detail": F.when(F.col("detail") != "", F.col("detail")),
        }
    )
    return facts.validate(bent).select("fact_id", "reason")


@query
def modules_in_repo(spark, sf):
    return catalog.modules_in_repo(table(spark, sf, "kb_facts"), REPO)


@query
def repo_overview(spark, sf):
    return catalog.repo_overview(table(spark, sf, "kb_facts"), table(spark, sf, "kb_repo_summaries"))


@query
def repo_catalog(spark, sf):
    return knowledge_base(spark, sf).repo_catalog()


@query
def component_impact(spark, sf):
    return deps.component_impact(table(spark, sf, "kb_dependencies"), COMPONENT)


@query
def component_impact_batch(spark, sf):
    return deps.component_impact_batch(table(spark, sf, "kb_dependencies"), COMPONENTS)


@query
def component_impact_join(spark, sf):
    """The blast radius of every supplier and part, as a table of components."""
    suppliers = table(spark, sf, "supplier").select(F.col("s_name").alias("component"))
    parts = table(spark, sf, "part").select(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".go")).alias("component"))
    return deps.component_impact_batch(table(spark, sf, "kb_dependencies"), suppliers.unionByName(parts))


def _edges(spark, sf):
    """The merged graph: keys seen from both sides, each held once."""
    return merge.merge_repo_dependencies(_united(spark, sf, ("kb_repo_deps", "kb_repo_deps_back"), "repo_dependencies"))


@query
def repo_deps_all(spark, sf):
    return deps.repo_dependencies(_edges(spark, sf))


@query
def repo_deps_out(spark, sf):
    return deps.repo_dependencies(_edges(spark, sf), NATION, "outgoing")


@query
def repo_deps_in(spark, sf):
    return deps.repo_dependencies(_edges(spark, sf), NATION, "incoming")


@query
def repo_deps_both(spark, sf):
    return deps.repo_dependencies(_edges(spark, sf), NATION, "both")


# --- merging ------------------------------------------------------------------


def _united(spark, sf, names, kind):
    return merge.union_sources([table(spark, sf, name) for name in names], kind)


def _facts(spark, sf):
    return _united(spark, sf, FACT_SOURCES, "facts")


def _analyses(spark, sf):
    frames = [table(spark, sf, name) for name in ANALYSIS_SOURCES]
    frames[2] = frames[2].drop("triggered_by")  # the oldest layout lacks it
    return merge.union_sources(frames, "pr_analyses")


@query
def union_sources(spark, sf):
    return _text(_facts(spark, sf), "summary", "detail").select(
        "src_ord", "fact_id", "pr_id", "repo", "category", "summary", "detail", "confidence", "source", "symbols_text"
    )


@query
def align_schema(spark, sf):
    aligned = align(table(spark, sf, "kb_facts_page"), "facts")
    return aligned.select(
        "fact_id", "pr_id", "repo", "symbols_text",
        F.size("symbols").alias("n_symbols"), F.size("source_files").alias("n_files"),
    )


@query
def merge_analyses(spark, sf):
    return _ts(merge.merge_analyses(_analyses(spark, sf))).select("pr_id", "repo", "ts", "triggered_by", "src_ord")


@query
def merge_facts(spark, sf):
    merged = merge.merge_children(_facts(spark, sf), _analyses(spark, sf), "fact_id")
    numbered = merge.renumber(merged, "fact_id")
    return _text(numbered, "summary", "detail").select(
        "fact_id", "src_ord", "pr_id", "repo", "category", "summary", "detail", "confidence", "source"
    )


@query
def replaced_facts_semi(spark, sf):
    gone = merge.replaced_rows(table(spark, sf, "kb_facts"), table(spark, sf, "kb_analyses_talk"), "fact_id")
    return gone.select("fact_id", "pr_id", "repo")


@query
def merge_dependencies(spark, sf):
    rows = _united(spark, sf, ("kb_dependencies", "kb_dependencies_orders"), "dependencies")
    owners = _united(spark, sf, ("kb_analyses", "kb_analyses_talk"), "pr_analyses")
    return merge.merge_children(rows, owners, "dep_id").select(
        "src_ord", "dep_id", "pr_id", "repo", "from_component", "to_component", "relation"
    )


@query
def merge_summaries(spark, sf):
    return merge.merge_summaries(
        _united(spark, sf, ("kb_repo_summaries", "kb_repo_summaries_region"), "repo_summaries")
    )


@query
def merge_repo_dependencies(spark, sf):
    return _edges(spark, sf).select("from_repo", "to_repo", "manifest", "raw_import", "relation", "src_ord")


@query
def merge_repo_dependencies_by_import(spark, sf):
    """The older, three-column key."""
    rows = _united(spark, sf, ("kb_repo_deps", "kb_repo_deps_back"), "repo_dependencies")
    merged = merge.merge_repo_dependencies(rows, ("from_repo", "to_repo", "raw_import"))
    return merged.select("from_repo", "to_repo", "raw_import", "relation", "src_ord")


@query
def merge_changed_source(spark, sf):
    """Three sources in a merged store, of which the second comes again with other summaries."""
    store = MergedStore(spark, scratch_path(spark, "merged"), parts=16)
    for i, (facts_name, analyses_name) in enumerate(zip(FACT_SOURCES, ANALYSIS_SOURCES, strict=True)):
        store.put(i, {"facts": table(spark, sf, facts_name), "pr_analyses": table(spark, sf, analyses_name)})
    renewed = table(spark, sf, FACT_SOURCES[1]).withColumn("summary", F.concat(F.lit("renewed "), "summary"))
    store.put(1, {"facts": renewed, "pr_analyses": table(spark, sf, ANALYSIS_SOURCES[1])})
    return _text(store.tables()["facts"], "summary", "detail").select(
        "src_ord", "fact_id", "pr_id", "repo", "category", "summary", "detail", "confidence", "source"
    )


@query
def merge_counts(spark, sf):
    return merge.merge_counts(_facts(spark, sf))


def _arrivals(fact_rows: DataFrame, ord_: int = 0) -> DataFrame:
    """Nested analyses, each with a seventh of the facts of its key, arriving in the order of their last fact."""
    symbols = F.col("symbols") if "symbols" in fact_rows.columns else F.array().cast("array<string>")
    fact = F.struct(
        "fact_id", "category", "summary", "detail", "confidence", "source",
        F.array("repo").alias("files"), symbols.alias("symbols"),
    )
    edge = F.struct(
        F.col("category").alias("from_component"), F.col("repo").alias("to_component"), F.lit("calls").alias("relation")
    )
    grouped = fact_rows.groupBy("pr_id", "repo", F.pmod("fact_id", F.lit(7)).alias("turn")).agg(
        F.sort_array(F.collect_list(fact)).alias("facts"), F.collect_list(edge).alias("dependencies"),
        F.collect_set("category").alias("kinds"), F.max("fact_id").alias("last"),
    )
    change = F.struct(F.col("pr_id").alias("id"), F.array("repo").alias("files"), F.col("kinds").alias("kind"))
    rows = grouped.select(
        "pr_id", "repo", F.lit("2024-05-01T00:00:00Z").alias("timestamp"), change.alias("change"),
        "dependencies", F.transform("facts", lambda f: f.dropFields("fact_id")).alias("facts"),
        (F.col("last") + ord_ * (1 << 40)).alias("arrival"),
    )
    return rows.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in NESTED_ANALYSIS], "arrival"
    )


@query
def replace_analysis(spark, sf):
    """Documents' facts after every conversation turn was saved as an analysis of its module."""
    store = {
        "pr_analyses": align(table(spark, sf, "kb_analyses"), "pr_analyses"),
        "facts": align(table(spark, sf, "kb_facts"), "facts"),
        "dependencies": align(table(spark, sf, "kb_dependencies"), "dependencies"),
    }
    after = nested_ops.replace_analyses(store, _arrivals(table(spark, sf, "kb_facts_talk"), 1))
    return _text(after["facts"], "summary", "detail").select(
        "pr_id", "repo", "category", "summary", "detail", "confidence", "source"
    )


@query
def nested_analysis(spark, sf):
    """Nested objects, flattened back to counts per analysis."""
    nested = nested_ops.nested_analyses(
        table(spark, sf, "kb_analyses"), table(spark, sf, "kb_facts"), table(spark, sf, "kb_dependencies")
    )
    total = F.aggregate("facts.confidence", F.lit(0.0), lambda a, x: a + x)
    return nested.groupBy("pr_id", "repo").agg(
        F.sum(F.size("facts")).alias("n_facts"),
        F.sum(F.size("dependencies")).alias("n_dependencies"),
        F.round(F.sum(total), 6).alias("confidence"),
    )


@query
def get_analysis(spark, sf):
    nested = nested_ops.get_analysis(
        table(spark, sf, "kb_analyses"), table(spark, sf, "kb_facts"), table(spark, sf, "kb_dependencies"), MODULE
    )
    return _text(nested.select("pr_id", "repo", F.inline("facts")), "summary").select(
        "pr_id", "repo", "fact_id", "category", "summary", "confidence"
    )


# --- near-duplicates ----------------------------------------------------------


@query
def word_sets(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(word_set(F.col("text")), " ").alias("words"))


def _collapse(spark, sf, group):
    return neardup.collapse_table(table(spark, sf, "documents"), group, "doc_id", "text")


@query
def neardup_table(spark, sf):
    """Documents left after collapsing whole texts per language."""
    return _collapse(spark, sf, "lang").survivors().select(F.col("group").alias("lang"), F.col("id").alias("doc_id"))


@query
def neardup_by_repo(spark, sf):
    """The same per source."""
    return _collapse(spark, sf, "source").survivors().select(F.col("group").alias("source"), F.col("id").alias("doc_id"))


@query
def neardup_arriving(spark, sf):
    """Documents collapsed per language, then conversation turns as further rows of these languages."""
    lang = F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "es"))), (F.pmod("turn", F.lit(4)) + 1).cast("int"))
    turns = table(spark, sf, "conversations").select(
        lang.alias("lang"), (F.col("conv_id") * 1000 + F.col("turn") + SECOND_IDS).alias("doc_id"), "text"
    )
    after = neardup.extend_collapse(_collapse(spark, sf, "lang"), turns, "lang", "doc_id", "text")
    return after.survivors().select(F.col("group").alias("lang"), F.col("id").alias("doc_id"))


@query
def jaccard_pairs(spark, sf):
    """Every dropped document with the first kept one it repeats, and their overlap."""
    pairs = neardup.first_matches(_collapse(spark, sf, "lang"))
    return pairs.select(
        F.col("group").alias("lang"), F.col("id").alias("doc_id"), F.col("kept_id"),
        F.round("jaccard", 6).alias("jaccard"),
    )


# --- sources, sinks, streams ----------------------------------------------------


def _listed_facts(tables: dict[str, DataFrame]) -> DataFrame:
    return _text(tables["facts"], "summary", "detail").select(
        "src_ord", "fact_id", "pr_id", "repo", "category", "summary", "detail", "confidence", "source",
        F.array_join("symbols", ",").alias("symbols"),
    )


@query
def scan_snapshots(spark, sf):
    """Facts written as a snapshot folder and read back from it, with a row for whatever could not be read."""
    folder = scratch_path(spark, "snapshots")
    snapshots.write_folder({"facts": table(spark, sf, "kb_facts")}, folder)
    tables, rejects = snapshots.read_folders(spark, [folder])
    lost = rejects.select(F.col("path").alias("pr_id"), F.lit("reject").alias("category"), F.col("error").alias("detail"))
    return _listed_facts(tables).drop("src_ord").unionByName(lost, allowMissingColumns=True)


@query
def scan_sources(spark, sf):
    """A local, a release and an object-store folder; the release breaks after a first good reading, one more is not there."""
    folder, store = scratch_path(spark, "sources"), scratch_path(spark, "copies")
    for name, place in zip(FACT_SOURCES, ("local", "release", "bucket"), strict=True):
        snapshots.write_folder({"facts": table(spark, sf, name)}, f"{folder}/{place}")
    listed = {"local": f"{folder}/local", "releases": f"{folder}/none, {folder}/release", "object_store": f"{folder}/bucket"}
    snapshots.collect_folders(spark, store, **listed)
    spark.range(1).select(F.lit("not a table").alias("value")).write.mode("overwrite").text(f"{folder}/release/facts")
    tables, rejects = snapshots.collect_folders(spark, store, **listed)
    known = F.col("error").isin(snapshots.OLDER_COPY, snapshots.NO_COPY)
    lost = rejects.select(
        F.regexp_extract("path", "sources-[^/]*/(.*)", 1).alias("pr_id"), F.lit("reject").alias("category"),
        F.when(known, F.col("error")).otherwise("unreadable").alias("detail"),
    )
    return _listed_facts(tables).unionByName(lost, allowMissingColumns=True)


def _stream(spark, sf, indexed):
    """Documents, conversations and pages arrive one after the other as nested analyses."""
    root = scratch_path(spark, "stream")
    store = StreamStore(spark, f"{root}/store", indexed)
    incoming = spark.readStream.schema(ARRIVAL_SCHEMA).parquet(f"{root}/landing/*")
    for i, name in enumerate(FACT_SOURCES):
        _arrivals(table(spark, sf, name), i).write.parquet(f"{root}/landing/{i}")
        run_stream(incoming, store, f"{root}/offsets").awaitTermination()
    return store


@query
def stream_replace(spark, sf):
    stored = _stream(spark, sf, indexed=False).tables()["facts"]
    return _text(stored, "summary", "detail").select(
        "pr_id", "repo", "category", "summary", "detail", "confidence", "source"
    )


@query
def stream_index(spark, sf):
    """Document frequencies of the live index after the stream."""
    return index.document_frequency(_stream(spark, sf, indexed=True).index().postings)
