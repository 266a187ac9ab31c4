"""Keyword and phrase search ranked by column-weighted BM25."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.porter import stem, stem_udf
from factloom.functions.text import clamp, like_contains, like_pattern, query_tokens, split_clean, tokens
from factloom.operators.grams import ascii_lower, containing
from factloom.operators.index import COLUMN_SPAN, COLUMN_WEIGHTS, TextIndex, frequency_of, shard_number, shard_of
from factloom.operators.skew import BROADCAST_CHARS, BROADCAST_ROWS, broadcast_if_small, key_lookup
from factloom.session import materialise

# BM25 parameters, and the floor for words held by half of all facts or more.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6

MAX_LIMIT = 100
MULTI_QUERY_ROWS = 70
# A lookup list up to this length becomes literals of the plan; a longer one is a table that is joined.
PUSHED_VALUES = 500

# Scores that a task adds up, at most, if every query has words in every fact.
SUMS_PER_TASK = 1_000_000

# Gains and scores as exact numbers.
GAIN = "decimal(28, 15)"

_WEIGHTS = list(COLUMN_WEIGHTS.values())


# How the reading of a query with quotes cuts it into strings, bare words, blanks and other signs.
_BARE = r"[^\x00-\x19\x1b-\x2f\x3a-\x40\x5b-\x5e\x60\x7b-\x7f]+"
_STRING = r'"(?:[^"]|"")*+"'
MATCH_PARTS = rf"(?s){_STRING}|{_BARE}|\s+|."
OPERATORS = ("AND", "NOT", "NEAR")


@dataclass(frozen=True)
class Phrases:
    """Parsed queries: (query_id, phrase, mult, grp, need), and the same as a list if they are few.

    Phrases of one ``grp`` count only in facts that hold all ``need`` of them; a phrase
    that counts by itself has group 0 and needs 1. A short list is planned on the driver:
    its tokens become literals that prune the postings, and its rows are proven small
    enough to broadcast. A longer one stays a distributed table and is joined.
    """

    table: DataFrame
    rows: list[dict] | None

    def side(self, df: DataFrame) -> DataFrame:
        """A table with at most one row per query and phrase, ready to join."""
        return df if self.rows is None else F.broadcast(df)

    def _most(self, listed, column) -> int:
        if self.rows is not None:
            return max(map(listed, self.rows), default=0)
        return self.table.agg(F.max(column)).first()[0] or 0

    @property
    def longest(self) -> int:
        return self._most(lambda row: len(row["phrase"]), F.size("phrase"))

    @property
    def neediest(self) -> int:
        return self._most(lambda row: row["need"], "need")


PHRASE_SCHEMA = pa.schema(
    [("query_id", pa.int64()), ("phrase", pa.list_(pa.string())), ("mult", pa.int64()), ("grp", pa.int32()), ("need", pa.int64())]
)
TERM_SCHEMA = pa.schema(
    [("phrase", pa.list_(pa.string())), ("size", pa.int32()), ("offset", pa.int32()), ("token", pa.string())]
)


def match_groups(text: str) -> list[list[str]] | None:
    """The words of a query in groups that are alternatives; None if the query cannot be read as words.

    Every word is put in quotes and the words are alternatives. Quotes of the query itself
    open and close these: what then stands side by side has to be found together, and a
    doubled quote inside is a sign of the word.
    """
    words = text.split()
    if '"' not in text:
        return [[word] for word in words]
    groups: list[list[str]] = [[]]
    for part in re.findall(MATCH_PARTS, " OR ".join(f'"{word}"' for word in words)):
        if part == "OR":
            groups.append([])
        elif re.fullmatch(_STRING, part) or (re.fullmatch(_BARE, part) and part not in OPERATORS):
            groups[-1].append(part)
        elif not part.isspace():
            return None
    return groups if all(groups) else None


def parse_list(spark: SparkSession, queries: Sequence[str], stemmed: bool = False) -> Phrases:
    """``parse_queries`` for a few texts, numbered from 0, on the driver."""
    count = Counter()
    for query_id, text in enumerate(queries):
        for number, words in enumerate(match_groups(text) or [], 1):
            phrases = [tuple(map(stem, phrase) if stemmed else phrase) for phrase in map(query_tokens, words) if phrase]
            need = len(set(phrases))
            for phrase in phrases:
                count[query_id, phrase, number if need > 1 else 0, need] += 1
    rows = [
        {"query_id": i, "phrase": list(phrase), "mult": n, "grp": grp, "need": need}
        for (i, phrase, grp, need), n in count.items()
    ]
    return Phrases(spark.createDataFrame(pa.Table.from_pylist(rows, PHRASE_SCHEMA)), rows)


def _match_parts(query: Column) -> Column:
    """Strings, bare words and other signs of a query with quotes (see ``match_groups``)."""
    words = F.filter(F.split(query, r"(?U)\s+"), lambda word: word != "")
    whole = F.concat(F.lit('"'), F.array_join(words, '" OR "'), F.lit('"'))
    return F.filter(F.regexp_extract_all(whole, F.lit(MATCH_PARTS), F.lit(0)), lambda part: F.trim(part) != "")


def unreadable(query: Column) -> Column:
    """Whether a query cannot be read as words; substring search answers those."""
    parts = _match_parts(query)

    def sign(part: Column) -> Column:
        word = part.rlike(f"^(?:{_BARE})$") & ~part.isin(*OPERATORS)
        return ~(word | part.rlike(f"(?s)^(?:{_STRING})$"))

    def alone(part: Column, i: Column) -> Column:
        ends = (i == 0) | (i == F.size(parts) - 1)
        return (part == "OR") & (ends | (F.get(parts, i - 1) == "OR"))

    lost = F.exists(parts, sign) | F.exists(F.transform(parts, alone), lambda x: x)
    return F.coalesce(query.contains('"') & lost, F.lit(False))


def parse_queries(queries: DataFrame, stemmed: bool = False) -> Phrases:
    """Every whitespace-separated word of a query table (query_id, query) is one phrase.

    A repeated word counts as often as it is written; a word without letters or
    digits yields no phrase. With ``stemmed``, phrases consist of stems. Quotes are read
    as in ``match_groups``.
    """
    quoted = F.col("query").contains('"')
    words = queries.where(~quoted).select("query_id", F.explode(F.split("query", r"(?U)\s+")).alias("word"))
    phrases = words.select("query_id", F.lit(0).alias("grp"), tokens(F.col("word")).alias("phrase"))
    parts = queries.where(quoted & ~unreadable(F.col("query"))).select("query_id", _match_parts(F.col("query")).alias("parts"))
    placed = parts.select("query_id", "parts", F.posexplode("parts").alias("i", "part")).where("part <> 'OR'")
    ors = F.size(F.filter(F.slice("parts", 1, F.col("i") + 1), lambda part: part == "OR"))
    phrases = phrases.unionByName(
        placed.select("query_id", (ors + 1).alias("grp"), tokens(F.col("part")).alias("phrase"))
    ).where(F.size("phrase") > 0)
    if stemmed:
        phrases = _stem_phrases(phrases)
    counted = phrases.groupBy("query_id", "grp", "phrase").agg(F.count(F.lit(1)).alias("mult"))
    grouped = counted.where("grp > 0")
    needs = grouped.groupBy("query_id", "grp").agg(F.count(F.lit(1)).alias("need"))
    grouped = grouped.join(needs, ["query_id", "grp"]).withColumn("grp", F.when(F.col("need") > 1, F.col("grp")).otherwise(0))
    phrases = (
        counted.where("grp = 0").withColumn("need", F.lit(1).cast("long")).unionByName(grouped)
        .groupBy("query_id", "phrase", "grp", "need").agg(F.sum("mult").alias("mult"))
        .select("query_id", "phrase", "mult", "grp", "need")
    )
    listed = phrases.limit(BROADCAST_ROWS + 1).toArrow()
    if listed.num_rows > BROADCAST_ROWS or listed.nbytes > BROADCAST_CHARS:
        return Phrases(materialise(phrases, "phrases"), None)
    return Phrases(queries.sparkSession.createDataFrame(listed), listed.to_pylist())


def _stem_phrases(phrases: DataFrame) -> DataFrame:
    """Phrases over stems; each distinct token passes the UDF once."""
    distinct = phrases.select("phrase").distinct()
    places = distinct.select("phrase", F.posexplode("phrase").alias("offset", "token"))
    stems = places.select("token").distinct().withColumn("stem", stem_udf("token"))
    stemmed = places.join(stems, "token").groupBy("phrase").agg(
        F.sort_array(F.collect_list(F.struct("offset", "stem"))).alias("places")
    )
    return phrases.join(stemmed, "phrase").select("query_id", "grp", F.col("places.stem").alias("phrase"))


def _terms(index: TextIndex, phrases: Phrases, stemmed: bool) -> tuple[DataFrame, list[str] | None]:
    """(phrase, size, offset, token): the index tokens that fill each place of each phrase.

    Also the distinct tokens, if they are few enough to be literals.
    """
    vocab = index.vocab.select("stem", "token")
    if phrases.rows is not None:
        known = sorted({token for row in phrases.rows for token in row["phrase"]})
        forms = _forms(vocab, known) if stemmed else {token: [token] for token in known}
        distinct = {tuple(row["phrase"]) for row in phrases.rows}
        if forms is not None and sum(len(forms.get(t, ())) for p in distinct for t in p) <= BROADCAST_ROWS:
            rows = [
                {"phrase": list(phrase), "size": len(phrase), "offset": offset, "token": token}
                for phrase in distinct
                for offset, place in enumerate(phrase)
                for token in forms.get(place, ())
            ]
            table = vocab.sparkSession.createDataFrame(pa.Table.from_pylist(rows, TERM_SCHEMA))
            found = sorted({row["token"] for row in rows})
            if len(found) <= PUSHED_VALUES:
                return F.broadcast(table), found
            return F.broadcast(materialise(table, "terms")), None
    terms = (
        phrases.table.select("phrase").distinct()
        .select("phrase", F.size("phrase").alias("size"), F.posexplode("phrase").alias("offset", "token"))
    )
    if stemmed:
        terms = terms.withColumnRenamed("token", "stem").join(vocab, "stem").drop("stem")
    return broadcast_flat(materialise(terms, "terms")), None


def broadcast_flat(terms: DataFrame) -> DataFrame:
    """Terms marked for broadcast if they are few and short; their phrases are as long as their tokens together."""
    rows, chars = terms.agg(F.count(F.lit(1)), F.sum(F.length(F.array_join("phrase", " ")) + F.length("token"))).first()
    return F.broadcast(terms) if rows <= BROADCAST_ROWS and (chars or 0) <= BROADCAST_CHARS else terms


def _forms(vocab: DataFrame, stems: list[str]) -> dict[str, list[str]] | None:
    """The index tokens behind each stem, unless there are too many for the driver."""
    if len(stems) > PUSHED_VALUES:
        wanted = vocab.sparkSession.createDataFrame(pa.table({"stem": stems}))
        vocab = vocab.join(F.broadcast(wanted), "stem")
    else:
        vocab = vocab.where(F.col("stem").isin(stems))
    rows = vocab.limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        return None
    forms: dict[str, list[str]] = {}
    for row in rows:
        forms.setdefault(row["stem"], []).append(row["token"])
    return forms


_CARRIED = ["phrase", "fact_id", "doc_len", "repo", "category", "confidence", "source", "ts", "linked"]


def _hits(index: TextIndex, terms: DataFrame, known: list[str] | None) -> DataFrame:
    """Postings of the terms. Few tokens are literals; else the stored terms prune shards while the query runs."""
    if known is not None:
        shards = sorted({shard_number(t, index.shards) for t in known})
        postings = index.postings.where(F.col("shard").isin(shards) & F.col("token").isin(known))
        return postings.join(terms, "token")
    placed = terms.withColumn("shard", shard_of(F.col("token"), index.shards)).where(F.length("token") > 0)
    return index.postings.join(placed, ["shard", "token"])


def _matches(hits: DataFrame, single: bool, longer: bool, stemmed: bool) -> DataFrame:
    """Weighted occurrences ``f`` of phrases of one token, of several tokens, or of both."""
    found = None
    if single:
        found = hits.where("size = 1").select(
            *_CARRIED, sum(F.col(f"tf{i}") * weight for i, weight in enumerate(_WEIGHTS)).alias("f")
        )
        if stemmed:  # several index tokens may share the stem
            found = found.groupBy(*_CARRIED).agg(F.sum("f").alias("f"))
    if not longer:
        return found

    # A phrase of several tokens occurs where all its tokens agree on the start.
    column = F.shiftright("start", COLUMN_SPAN.bit_length() - 1)
    weight = F.element_at(F.array(*map(F.lit, _WEIGHTS)), column + 1)
    several = (
        hits.where("size > 1")
        .select(*_CARRIED, "size", "offset", F.explode("positions").alias("pos"))
        .withColumn("start", F.col("pos") - F.col("offset"))
        .where("start >= 0")
        .groupBy(*_CARRIED, "size", "start")
        .agg(F.count(F.lit(1)).alias("held"))
        .where("held = size")
        .groupBy(*_CARRIED)
        .agg(F.sum(weight).alias("f"))
    )
    return several if found is None else found.unionByName(several)


def match_phrases(index: TextIndex, phrases: Phrases, stemmed: bool = False) -> DataFrame:
    """Weighted occurrences ``f`` of each distinct phrase in each fact, over the whole store."""
    return _matches(_hits(index, *_terms(index, phrases, stemmed)), True, phrases.longest > 1, stemmed)


def _idf(index: TextIndex, frequency: DataFrame) -> DataFrame:
    n, _ = index.size
    idf = F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return frequency.select("phrase", "df", F.when(idf > 0, idf).otherwise(F.lit(IDF_FLOOR)).alias("idf"))


def phrase_idf(index: TextIndex, matches: DataFrame) -> DataFrame:
    """Inverse document frequency per phrase; filters never change it."""
    return _idf(index, matches.groupBy("phrase").agg(F.count(F.lit(1)).alias("df")))


def _phrase_idf(index: TextIndex, phrases: Phrases, terms: DataFrame, hits: DataFrame, stemmed: bool) -> DataFrame:
    """The same for all phrases of a search: single words from the stored frequencies, only others from their matches."""
    longer = phrases.longest > 1
    if stemmed or index.frequency is None:
        return phrase_idf(index, _matches(hits, True, longer, stemmed))
    words = terms.where("size = 1").select("token", shard_of(F.col("token"), index.shards).alias("shard"))
    known = frequency_of(index, words).select(F.array("token").alias("phrase"), "df")
    found = _idf(index, known)
    return found.unionByName(phrase_idf(index, _matches(hits, False, True, stemmed))) if longer else found


def score(
    index: TextIndex,
    queries: DataFrame | Sequence[str],
    stemmed: bool = False,
    category: str | None = None,
    min_confidence: float = 0.0,
    repo_name: str | None = None,
    linked_only: bool = True,
) -> DataFrame:
    """BM25 score (negative, smaller is better) of every matching fact for every query.

    Queries come as a table (query_id, query) or as a short list of texts.
    """
    if isinstance(queries, DataFrame):
        phrases = parse_queries(queries, stemmed)
    else:
        phrases = parse_list(index.docs.sparkSession, queries, stemmed)
    terms, known = _terms(index, phrases, stemmed)
    hits = _hits(index, terms, known)
    idf = _phrase_idf(index, phrases, terms, hits, stemmed)
    weights = phrases.side(phrases.table.join(idf, "phrase").select("query_id", "phrase", "mult", "grp", "need", "idf"))

    wanted = _matches(hits, True, phrases.longest > 1, stemmed)
    if linked_only:
        wanted = wanted.where("linked")
    if repo_name:
        wanted = wanted.where(F.col("repo") == repo_name)
    if category:
        wanted = wanted.where(F.col("category") == category)
    if min_confidence > 0:
        wanted = wanted.where(F.col("confidence") >= min_confidence)

    _, average = index.size
    norm = K1 * (F.lit(1 - B) + F.lit(B) * F.col("doc_len") / F.lit(average or 1.0))
    gain = F.col("mult") * F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + norm)
    fact = ["query_id", "fact_id", "repo", "category", "confidence", "source", "ts"]
    if phrases.rows is not None:
        # The weights are broadcast, so rows dealt by fact here are added up where they are: a
        # shuffle after this join would carry a row for every query that holds the word.
        sums = index.size[0] * len({row["query_id"] for row in phrases.rows})
        parts = max(wanted.sparkSession.sparkContext.defaultParallelism, -(-sums // SUMS_PER_TASK))
        wanted = wanted.repartition(parts, "fact_id")
    # Exact numbers: their sum is the same in any order, so gains of long lists are combined before the shuffle.
    gains = wanted.join(weights, "phrase").select(*fact, "grp", "need", gain.cast(GAIN).alias("gain"))
    if phrases.neediest > 1:
        together = (
            gains.where("need > 1").groupBy(*fact, "grp", "need").agg(F.count(F.lit(1)).alias("held"), F.sum("gain").cast(GAIN).alias("gain"))
            .where("held = need").select(*fact, "grp", "need", "gain")
        )
        gains = gains.where("need = 1").unionByName(together)
    return gains.groupBy(*fact).agg((-F.sum("gain")).cast("double").alias("score"))


def rank(scored: DataFrame, limit: int) -> DataFrame:
    """Best ``limit`` facts per query; Spark cuts each task to ``limit`` rows per query before the shuffle."""
    order = [
        F.col("score"),
        F.when(F.col("source") == "scan", 0).otherwise(1),
        F.desc("ts"),
        F.col("fact_id"),
    ]
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return scored.withColumn("rank", place).where(F.col("rank") <= limit)


FACT_COLUMNS = [
    "pr_id", "repo", "category", "summary", "detail", "confidence", "source", "source_files", "symbols",
]


def attach_facts(hits: DataFrame, facts: DataFrame, analyses: DataFrame) -> DataFrame:
    """Full rows for ranked hits (``fact_id`` plus result columns).

    Hits are a top-k result; they are stored, so that the search runs once. While they are
    few, their ids are pushed into the facts scan, so that only the row groups holding
    them are read; else they are joined, by broadcast as long as their size allows it.
    """
    columns = [name for name in FACT_COLUMNS if name in facts.columns]
    facts = facts.select("fact_id", *columns)
    times = analyses.select("pr_id", "repo", *[c for c in ("ts", "timestamp", "triggered_by") if c in analyses.columns])
    hits = materialise(hits, "hits")
    ids = [row["fact_id"] for row in hits.select("fact_id").distinct().limit(PUSHED_VALUES + 1).collect()]
    if len(ids) <= PUSHED_VALUES:
        facts = facts.where(F.col("fact_id").isin(ids))
    return broadcast_if_small(hits).join(facts, "fact_id").join(times, ["pr_id", "repo"])


def like_search(
    facts: DataFrame,
    analyses: DataFrame,
    term: str,
    category: str | None = None,
    min_confidence: float = 0.0,
    limit: int = 50,
    repo_name: str | None = None,
    index: TextIndex | None = None,
) -> DataFrame:
    """Substring search over summary and detail, best confidence first; with an index, only facts with its words are read."""
    filters = {"category": category, "min_confidence": min_confidence, "repo_name": repo_name}
    if index is not None:
        terms = facts.sparkSession.createDataFrame([(0, term)], "query_id long, query string")
        hits = substring_hits(index, facts, analyses, terms, limit, **filters)
    else:
        rows = _filtered(facts, **filters)
        found = rows.where(like_contains(F.col("summary"), term) | like_contains(F.col("detail"), term))
        candidates = found.select(F.lit(0).cast("long").alias("query_id"), "fact_id", "pr_id", "repo", "confidence")
        hits = _ranked_by_confidence(candidates, analyses, limit)
    return attach_facts(hits.select("fact_id"), facts, analyses)


def _filtered(rows: DataFrame, category: str | None = None, min_confidence: float = 0.0, repo_name: str | None = None) -> DataFrame:
    if repo_name:
        rows = rows.where(F.col("repo") == repo_name)
    if category:
        rows = rows.where(F.col("category") == category)
    if min_confidence > 0:
        rows = rows.where(F.col("confidence") >= min_confidence)
    return rows


def _ranked_by_confidence(found: DataFrame, analyses: DataFrame, limit: int) -> DataFrame:
    """(query_id, rank, fact_id) of found facts.

    Only ids are ranked. Cutting each key to ``limit`` rows before the join with
    the analyses keeps a key with very many facts from gathering in one task.
    """
    order = [F.desc("confidence"), F.col("fact_id")]
    per_key = Window.partitionBy("query_id", "pr_id", "repo").orderBy(*order)
    candidates = found.withColumn("__place", F.row_number().over(per_key)).where(F.col("__place") <= limit)
    linked = candidates.join(analyses.select("pr_id", "repo"), ["pr_id", "repo"])
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return linked.withColumn("rank", place).where(F.col("rank") <= limit).select("query_id", "rank", "fact_id")


def substring_hits(
    index: TextIndex,
    facts: DataFrame,
    analyses: DataFrame,
    queries: DataFrame,
    limit: int,
    **filters,
) -> DataFrame:
    """(query_id, rank, fact_id) of substring searches, for a table of queries of any size.

    The longest run of letters and digits of a query is part of one token of every fact it
    is found in. If the index has the grams of its vocabulary (``with_grams``), such tokens
    come from these, facts from their postings, and the whole pattern is confirmed on these
    facts alone. Without them, and for patterns without such a run, all facts are read once
    and meet the patterns by a sign that both hold.
    """
    term = F.trim(F.col("query"), F.lit("%"))
    runs = F.regexp_extract_all(ascii_lower(F.col("query")), F.lit("[a-z0-9]+"), F.lit(0))
    longest = F.array_max(F.transform(runs, lambda run: F.struct(F.length(run).alias("n"), run.alias("run"))))["run"]
    asked = materialise(
        queries.where(F.col("query").isNotNull()).select(
            "query_id", like_pattern(term).alias("pattern"), _rarest_sign(term).alias("sign"),
            (longest if index.grams is not None else F.lit(None).cast("string")).alias("needle"),
        ),
        "substrings",
    )
    facts = _filtered(facts, **filters).select("fact_id", "pr_id", "repo", "confidence", "summary", "detail")
    parts = []
    by_word = asked.where("needle IS NOT NULL").select("query_id", "pattern", "needle")
    if by_word.take(1):
        held = _facts_with(index, by_word.select("needle"))
        ids = [row["fact_id"] for row in held.select("fact_id").distinct().limit(PUSHED_VALUES + 1).collect()]
        read = facts.where(F.col("fact_id").isin(ids)) if len(ids) <= PUSHED_VALUES else facts
        # A fact with several needles comes once for each; queries that share a needle share it.
        candidates = held.join(read, "fact_id") if len(ids) <= PUSHED_VALUES else key_lookup(held, read, ["fact_id"], "inner", "needle")
        parts.append(key_lookup(candidates, by_word, ["needle"], "inner", "fact_id"))
    by_sign = asked.where("needle IS NULL").select("query_id", "pattern", "sign")
    if by_sign.take(1):
        signs = F.array_distinct(F.regexp_extract_all(F.concat_ws("", "summary", "detail"), F.lit(_SIGN), F.lit(0)))
        every = facts.withColumn("sign", F.explode(F.array_append(signs, F.lit(""))))
        parts.append(key_lookup(every, by_sign, ["sign"], "inner", "fact_id"))
    if not parts:
        return _ranked_by_confidence(facts.select(F.lit(0).cast("long").alias("query_id"), *_CANDIDATE).limit(0), analyses, limit)
    confirmed = [
        part.where(F.rlike("summary", F.col("pattern")) | F.rlike("detail", F.col("pattern"))).select("query_id", *_CANDIDATE)
        for part in parts
    ]
    return _ranked_by_confidence(reduce(DataFrame.unionByName, confirmed), analyses, limit)


_CANDIDATE = ["fact_id", "pr_id", "repo", "confidence"]


def _facts_with(index: TextIndex, needles: DataFrame) -> DataFrame:
    """(needle, fact_id): facts with a token in summary or detail that holds the needle; stored."""
    words = index.vocab.select(F.col("token").alias("value")).distinct()
    found = containing(needles, words, index.grams).select("needle", F.col("value").alias("token"))
    placed = materialise(found.withColumn("shard", shard_of(F.col("token"), index.shards)), "tokens-with-substrings")
    known = [row["token"] for row in placed.select("token").distinct().limit(PUSHED_VALUES + 1).collect()]
    postings = index.postings.where("tf0 + tf1 > 0")
    if len(known) <= PUSHED_VALUES:
        shards = sorted({shard_number(token, index.shards) for token in known})
        postings = postings.where(F.col("shard").isin(shards) & F.col("token").isin(known))
    # Else the broadcast shards prune the postings while the query runs.
    hits = postings.join(broadcast_if_small(placed.where(F.length("token") > 0)), ["shard", "token"])
    return materialise(hits.select("needle", "fact_id").distinct(), "facts-with-substrings")


# Characters other than ASCII letters, digits and the wildcards of LIKE, one by one; ASCII folding leaves them as they are.
_SIGN = "(?s)[^a-zA-Z0-9%_]"


def _rarest_sign(term: Column) -> Column:
    """A character other than a blank that a pattern asks for, else a blank, else the empty text."""
    signs = F.regexp_extract_all(term, F.lit(_SIGN), F.lit(0))
    visible = F.filter(signs, lambda sign: F.trim(sign) != "")
    return F.coalesce(F.get(visible, F.lit(0)), F.get(signs, F.lit(0)), F.lit(""))


def search_batch(
    index: TextIndex,
    facts: DataFrame,
    analyses: DataFrame,
    queries: DataFrame | Sequence[str],
    limit: int = 50,
    stemmed: bool = True,
    **filters,
) -> DataFrame:
    """Ranked results for a table of queries (query_id, query) or a short list of texts.

    Queries whose quotes cannot be read as words are answered by substring search.
    """
    if isinstance(queries, DataFrame):
        plain, lost = queries, queries.where(unreadable(F.col("query")))
    else:
        unread = [(i, text) for i, text in enumerate(queries) if match_groups(text) is None]
        plain = queries
        lost = facts.sparkSession.createDataFrame(unread, "query_id long, query string") if unread else None
    hits = rank(score(index, plain, stemmed=stemmed, **filters), limit)
    out = attach_facts(hits.select("query_id", "rank", "fact_id", "score"), facts, analyses)
    if lost is not None and (not isinstance(queries, DataFrame) or lost.take(1)):
        hits = substring_hits(index, facts, analyses, lost, limit, **filters).withColumn("score", F.lit(None).cast("double"))
        out = out.unionByName(attach_facts(hits, facts, analyses))
    return out


def search(
    index: TextIndex,
    facts: DataFrame,
    analyses: DataFrame,
    term: str,
    category: str | None = None,
    min_confidence: float = 0.0,
    limit: int = 50,
    repo_name: str | None = None,
    stemmed: bool = True,
) -> DataFrame:
    """One ranked search; an empty query gives no rows."""
    filters = {"category": category, "min_confidence": min_confidence, "repo_name": repo_name}
    return search_batch(index, facts, analyses, [term], limit, stemmed, **filters).drop("query_id")


def search_many(
    index: TextIndex,
    facts: DataFrame,
    analyses: DataFrame,
    query: str,
    category: str | None = None,
    min_confidence: float = 0.0,
    limit: int = 20,
    repo_name: str | None = None,
    stemmed: bool = True,
) -> DataFrame:
    """Semicolon-separated searches joined into one ranked list.

    Rows equal in (pr_id, category, summary) are returned once, at their first
    place; more than one query is cut to min(limit * queries, 70) rows.
    """
    limit = int(clamp(limit, 1, MAX_LIMIT))
    min_confidence = clamp(min_confidence, 0.0, 1.0)
    queries = split_clean(query, ";")
    filters = {"category": category, "min_confidence": min_confidence, "repo_name": repo_name}
    found = search_batch(index, facts, analyses, queries, limit, stemmed, **filters)
    if len(queries) < 2:
        return found.withColumn("place", F.col("rank").cast("long"))
    # At most MAX_LIMIT rows per query reach this point.
    first = Window.partitionBy("pr_id", "category", "summary").orderBy("query_id", "rank")
    distinct = found.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    capped = distinct.orderBy("query_id", "rank").limit(min(limit * len(queries), MULTI_QUERY_ROWS))
    return capped.withColumn("place", F.col("query_id") * (MAX_LIMIT + 1) + F.col("rank"))
