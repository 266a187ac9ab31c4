"""URL rules by host suffix and path prefix, decided by hashed expressions.

Every URL is expanded into expressions (host suffix + path prefix). Expressions
and rules meet in an equi-join on the first four bytes of their SHA-256; the full
digest of what the rule names is confirmed afterwards and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import pick
from factloom.operators.skew import key_lookup

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Hex digits of the digest that take part in the join.
PREFIX_DIGITS = 8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _folder(path: Column) -> Column:
    """A path up to and with its last slash: the part that expressions are cut at."""
    return F.regexp_extract(path, r"(?s)^(.*/)", 1)


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, PREFIX_DIGITS), 16, 10).cast("long")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id",
               url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule (host and path of the rule that decides, or null) and verdict.

    ``rules`` has ``host``, ``path`` and ``verdict``. A rule fits its host and all
    subdomains when the URL's path starts with the rule's path, which need not
    end at a slash. Of the rules that fit, the longest (host and path together)
    wins, then the one with the longer host; if the same rule is given twice
    with different verdicts, ``block`` wins. Without a fitting rule the verdict is
    ``default``.

    Null and empty URLs and those without ``://`` have empty host and path and
    fit no rule. Rules with a null field, an empty host, or a path that does not
    start with a slash fit nothing. Repeated rows give as many equal rows. Empty
    tables give empty results or the default verdict. Other columns are ignored.

    Only as many suffixes and prefixes are made as the deepest rule can use, so a
    URL with thousands of slashes costs no more than its length.
    """
    known = pick(rules, "host", "path", "verdict").where(
        (F.length("host") > 0) & ((F.col("path") == "") | F.col("path").startswith("/")) & F.col("verdict").isNotNull()
    )
    rule_side = known.select(
        F.concat("host", "path").alias("rule"),
        F.col("verdict").alias("rule_verdict"),
        F.length("host").alias("rule_host_length"),
        F.length("path").alias("rule_path_length"),
        _digest(F.concat("host", "path")).alias("rule_digest"),
        _short(_digest(F.concat(F.col("host"), _folder(F.col("path"))))).alias("prefix"),
    ).distinct()
    labels, depth = known.agg(
        F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(0)),
        F.coalesce(F.max(F.length("path") - F.length(F.translate("path", "/", ""))), F.lit(0)),
    ).first()

    urls = (
        pick(pages, id_col, url_col)
        .toDF("page", "url")
        .groupBy("page", "url")
        .agg(F.count(F.lit(1)).cast("int").alias("copies"))
        .select("page", "url", "copies", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    )
    parts, folders = F.split("host", r"\."), F.split("path", "/", depth + 1)
    first = F.greatest(F.lit(1), F.size(parts) - F.lit(labels - 1))
    suffixes = F.transform(
        F.sequence(first, F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")
    )
    prefixes = F.transform(
        F.sequence(F.lit(0), F.size(folders) - 1),
        lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(folders, 1, k), "/"), F.lit("/"))),
    )
    named = (F.length("host") > 0) & F.lit(labels > 0)
    expressions = (
        urls.withColumn("suffix", F.explode_outer(F.when(named, suffixes)))
        .withColumn("folder", F.explode_outer(F.when(F.col("suffix").isNotNull(), prefixes)))
        .withColumn("prefix", _short(_digest(F.concat("suffix", "folder"))))
        .drop("folder")
    )
    met = key_lookup(expressions, rule_side, ["prefix"], "left", "url")
    confirmed = F.col("rule_digest") == _digest(
        F.concat(F.col("suffix"), F.col("path").substr(F.lit(1), F.col("rule_path_length")))
    )
    order = F.struct(
        F.length("rule"), "rule_host_length", (F.col("rule_verdict") == "block").alias("blocks"), "rule", "rule_verdict"
    )
    best = met.groupBy("page", "url", "copies", "host", "path").agg(F.max(F.when(confirmed, order)).alias("best"))
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        F.col("page").alias(id_col),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
    )
