"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Base patterns find the spans that always count. Looser patterns propose more
candidates (numbers without a plus sign, spelt-out addresses, other separators).
Labelers of three sorts vote on every candidate, yes, no or not at all: patterns with
their checksums, gazetteers of endings, issuers and calling codes, and the words and
characters around it. How often each combination of votes occurs is counted over all
documents; expectation-maximisation estimates from these counts how reliable each
labeler is and how likely each combination is personal data. A logistic classifier of
what a span looks like learns from these probabilities, over all candidates, and
decides on the proposed ones.

What reaches the driver are counts by kind and votes (4 * 3^6 rows at most) and by kind
and features (4 * 2^14 rows at most), whatever the number of documents.
"""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bounded_batches, pick
from factloom.session import materialise

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
# A proposed span counts if the classifier is at least so sure.
SURE = 0.8
# Characters in front of a span whose words are its context, and between spans that stand together.
CONTEXT = 40
TOGETHER = 80
# Rounds of expectation-maximisation, and of Newton's method.
EM_ROUNDS, NEWTON_ROUNDS = 60, 25

# Base patterns, where they differ from a plain search only in being linear in the text.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
QUAD = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGIT_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])++")
PLUS_NUMBER = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Looser patterns.
NAME, LABEL = "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}", "[A-Za-z0-9-]{1,63}"
SPELT_EMAIL = re.compile(
    rf"{NAME} ?[\[(]at[\])] ?{LABEL}(?:(?: ?[\[(]dot[\])] ?| dot |\.){LABEL}){{1,8}}|{NAME} at {LABEL}(?: dot {LABEL}){{1,8}}",
    re.IGNORECASE,
)
SPELT_SIGN = re.compile(r"[\[(]at[\])]| at [^ ]{1,63} dot ", re.IGNORECASE)
HEX_GROUPS = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
LONG_NUMBER = re.compile(r"(?<![0-9A-Za-z_.])[0-9](?:[ ./ -]?[0-9]){11,20}(?![0-9A-Za-z_])")
NATIONAL = re.compile(r"(?<![0-9A-Za-z_+.])\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}\(?[0-9]{2,5}\)?){1,5}(?![0-9A-Za-z_])")
DIGIT = re.compile(r"[0-9]")
WORDS = re.compile(r"[^\W\d_]+")

# Words in front of each kind of personal data, and in front of other numbers.
CUES = (
    frozenset(("email", "mail", "contact", "write", "correo", "courriel", "kontakt")),
    frozenset(("ip", "host", "server", "address", "addr", "client", "login", "adresse")),
    frozenset(("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "tarjeta", "carte")),
    frozenset(("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "whatsapp", "sms", "telefon", "teléfono", "téléphone")),
)
OTHER_CUES = frozenset(
    ("version", "isbn", "issn", "order", "invoice", "serial", "sku", "section", "page", "chapter", "ref", "figure", "release",
     "build", "doi", "article", "commit", "date")
)
# Endings of host names, and country calling codes by their first digits.
ENDINGS = frozenset(
    ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "dev", "app", "co", "me", "us", "uk", "ca", "au", "nz",
     "ie", "in", "de", "at", "ch", "fr", "be", "nl", "lu", "es", "pt", "it", "gr", "se", "no", "dk", "fi", "pl", "cz", "sk", "hu",
     "ro", "bg", "ru", "ua", "tr", "il", "za", "br", "ar", "mx", "cl", "jp", "cn", "kr", "sg", "eu", "example", "test")
)
CALLING = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "5",
           "6", "7", "8", "9")

LABELERS = ("pattern", "checksum", "gazetteer", "cue", "edges", "company")
ABSTAIN, YES, NO = range(3)
FEATURES = ("sign", "parenthesis", "space", "hyphen", "dot", "letters", "ten digits", "thirteen digits", "line start", "after mark",
            "checksum", "gazetteer", "cue", "other cue")


class Span(NamedTuple):
    start: int
    kind: int
    end: int


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(DIGIT.findall(text))


def small_parts(quad: str) -> bool:
    """Whether all four numbers are at most 255, whatever their length."""
    parts = [part.lstrip("0") for part in quad.split(".")]
    return all(len(part) <= 3 and int(part or 0) <= 255 for part in parts)


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches: from each sign as far left as characters of a local part go, then the host behind it."""
    end = free = 0
    at = text.find("@")
    while at >= 0:
        left = max(end, free)
        start = left + len(text[left:at].rstrip(LOCAL))
        host = DOMAIN.match(text, at) if start < at else None
        if host:
            end = host.end()
            yield Span(start, EMAIL, end)
        free = at + 1
        at = text.find("@", max(free, end))


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and matches of base patterns that fail their check; both in no order."""
    found, failed = list(emails(text)) if "@" in text else [], []
    if DIGIT.search(text):
        for m in QUAD.finditer(text):
            (found if small_parts(m.group()) else failed).append(Span(m.start(), IP, m.end()))
        for m in DIGIT_CHAIN.finditer(text):
            digits = digits_of(m.group())
            if 14 <= len(digits) <= 19:
                (found if luhn(digits) else failed).append(Span(m.start(), CARD, m.end()))
        if "+" in text:
            for m in PLUS_NUMBER.finditer(text):
                right = 10 <= len(digits_of(m.group())) <= 15
                (found if right else failed).append(Span(m.start(), PHONE, m.end()))
    return found, failed


def proposals(text: str) -> Iterator[Span]:
    """Spans of looser patterns."""
    if SPELT_SIGN.search(text):
        for m in SPELT_EMAIL.finditer(text):
            yield Span(m.start(), EMAIL, m.end())
    if not DIGIT.search(text):
        return
    for m in HEX_GROUPS.finditer(text):
        if len(m.group()) > 5:
            yield Span(m.start(), IP, m.end())
    for m in LONG_NUMBER.finditer(text):
        yield Span(m.start(), CARD, m.end())
    for m in NATIONAL.finditer(text):
        if 7 <= len(digits_of(m.group())) <= 15:
            yield Span(m.start(), PHONE, m.end())


def without_overlaps(spans: list[Span], taken: list[Span]) -> list[Span]:
    """The spans that meet none of ``taken``, and of those that meet each other the one that starts first (longer, then kind)."""
    fixed = sorted(taken)
    starts = [span.start for span in fixed]
    # The farthest end of the first of these spans.
    reach = list(accumulate((span.end for span in fixed), max))
    out, end = [], 0
    for span in sorted(spans, key=lambda s: (s.start, -s.end, s.kind)):
        before = bisect_left(starts, span.end)
        if span.start >= end and not (before and reach[before - 1] > span.start):
            out.append(span)
            end = span.end
    return out


def checksum_holds(kind: int, text: str, digits: str) -> bool:
    if kind == EMAIL:
        host = re.split(r"@|[\[(]at[\])]| at ", text, flags=re.IGNORECASE)[-1]
        labels = [label.strip() for label in re.split(r"\.|[\[(]dot[\])]| dot ", host, flags=re.IGNORECASE)]
        return len(labels) > 1 and all(a and not a.startswith("-") and not a.endswith("-") for a in labels) and labels[-1].isalpha()
    if kind == IP:
        if ":" not in text:
            return small_parts(text)
        try:
            return bool(ipaddress.IPv6Address(text))
        except ValueError:
            return False
    if kind == CARD:
        return 13 <= len(digits) <= 19 and luhn(digits) and len(set(digits)) > 1
    return 10 <= len(digits) <= 15 and len(set(digits)) > 2


def listed(kind: int, text: str, digits: str) -> bool:
    """Whether the gazetteer knows the ending, network, issuer or calling code."""
    if kind == EMAIL:
        return not ENDINGS.isdisjoint(WORDS.findall(text.lower())[-1:])
    if kind == IP:
        first = text.split(".")[0].lstrip("0")
        return ":" in text or (len(first) <= 3 and first != "127" and 0 < int(first or 0) < 224 and len(text) > 7)
    if kind == CARD:
        size, head = len(digits), int(digits[:4] or 0)
        return (
            (digits[:1] == "4" and size in (13, 16, 19)) or (size == 16 and (5100 <= head < 5600 or 2221 <= head < 2721))
            or (size == 15 and digits[:2] in ("34", "37")) or (size >= 16 and (head == 6011 or digits[:2] == "65"))
            or (size == 14 and digits[:2] in ("30", "36", "38"))
        )
    if text.startswith("+"):
        return digits.startswith(CALLING)
    return digits.startswith("0") or (len(digits) == 10 and digits[0] in "23456789" and digits[1:3] != "11")


def seen(text: str, span: Span, near: bool, found: bool, failed: bool) -> tuple[int, int]:
    """Votes of all labelers (base 3) and features (bits) of a candidate."""
    own = text[span.start : span.end]
    digits = digits_of(own)
    context = text[max(0, span.start - CONTEXT) : span.start]
    words = set(WORDS.findall(context.lower()))
    before, after = text[span.start - 1 : span.start], text[span.end : span.end + 1]
    check, known = checksum_holds(span.kind, own, digits), listed(span.kind, own, digits)
    cue, other = bool(words & CUES[span.kind]), bool(words & OTHER_CUES)
    apart = not (before.isalnum() or after.isalnum() or before in ("_", "/", "-", "="))
    votes = (
        YES if found else NO if failed else ABSTAIN,
        YES if check else NO,
        YES if known else NO,
        YES if cue and not other else NO if other and not cue else ABSTAIN,
        YES if apart else NO,
        YES if near else ABSTAIN,
    )
    features = (
        "+" in own or "@" in own, "(" in own, " " in own, "-" in own, "." in own, any(c.isalpha() for c in own),
        len(digits) >= 10, len(digits) >= 13, before in ("", "\n"), context.rstrip()[-1:] in (":", "=", "#"),
        check, known, cue, other,
    )
    return sum(v * 3**i for i, v in enumerate(votes)), sum(bool(f) << i for i, f in enumerate(features))


def candidates(text: str) -> list[tuple[int, int, int, bool, int, int]]:
    """(start, kind, end, base, votes, features) of all base spans and proposals of a text, by start and kind."""
    found, failed = base_spans(text)
    more = without_overlaps([*failed, *proposals(text)], found)
    refused, spans = set(failed), sorted([*found, *more])
    base = set(found)
    out = []
    for i, span in enumerate(spans):
        around = spans[max(0, i - 1) : i] + spans[i + 1 : i + 2]
        near = any(s.kind != span.kind and max(s.start - span.end, span.start - s.end) <= TOGETHER for s in around)
        votes, features = seen(text, span, near, span in base, span in refused)
        out.append((*span, span in base, votes, features))
    return out


class Model(NamedTuple):
    """``reliability``: per kind, class (no, yes), labeler and vote its probability; ``weights``: per kind, bias last."""

    reliability: np.ndarray
    weights: np.ndarray

    def sure(self, kind: Column, features: Column, least: float) -> Column:
        """Whether the classifier gives a candidate a probability of at least ``least``."""

        def of_kind(values: np.ndarray) -> Column:
            return F.element_at(F.array(*[F.lit(float(v)) for v in values]), kind + 1)

        total = of_kind(self.weights[:, -1])
        for i in range(len(FEATURES)):
            total = total + of_kind(self.weights[:, i]) * F.shiftright(features, i).bitwiseAND(F.lit(1))
        return total >= F.lit(float(np.log(least) - np.log1p(-least)))


# What labelers are taken for before any vote is seen, as counts of votes (abstain, yes, no) on false and on true candidates.
PRIOR = np.array([[6.0, 3.0, 11.0], [6.0, 12.0, 2.0]])


def estimate(votes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Reliabilities (class, labeler, vote) and the probability of each row of votes, by expectation-maximisation.

    Labelers are independent given the truth. The priors keep apart which class is
    which, and keep estimates from few candidates near them.
    """
    hot = np.eye(3)[votes]
    table = np.repeat(PRIOR[:, None, :] / PRIOR.sum(axis=1)[:, None, None], len(LABELERS), axis=1)
    share = np.array([0.5, 0.5])
    posterior = np.zeros(len(votes))
    for _ in range(EM_ROUNDS):
        logs = np.einsum("rlv,clv->rc", hot, np.log(table)) + np.log(share)
        posterior = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))
        weights = np.stack([1 - posterior, posterior]) * counts
        table = np.einsum("cr,rlv->clv", weights, hot) + PRIOR[:, None, :]
        table /= table.sum(axis=2, keepdims=True)
        share = weights.sum(axis=1) + 5
        share /= share.sum()
    return table, posterior


def fit(features: np.ndarray, counts: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """Logistic weights (bias last) for rows of features seen ``counts`` times, true with probability ``truth``."""
    x = np.hstack([features, np.ones((len(features), 1))]).astype(np.float64)
    weights = np.zeros(x.shape[1])
    ridge = np.append(np.full(x.shape[1] - 1, 1.0), 0.01)
    for _ in range(NEWTON_ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (counts * (p - truth)) + ridge * weights
        bend = (x * (counts * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(bend, slope)
        weights -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
    return weights


def learn(found: DataFrame) -> Model:
    """Reliabilities and classifier from the candidates of all documents (see ``candidates_of``)."""
    spark = found.sparkSession
    one = found.select(F.explode("spans").alias("s")).select("s.kind", "s.votes", "s.features")
    patterns = materialise(one.groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).alias("n")), "vote-patterns")
    by_votes = patterns.groupBy("kind", "votes").agg(F.sum("n").alias("n")).orderBy("kind", "votes").collect()
    reliability, labels = np.zeros((len(KINDS), 2, len(LABELERS), 3)), []
    weights = np.zeros((len(KINDS), len(FEATURES) + 1))
    for kind in range(len(KINDS)):
        rows = [row for row in by_votes if row["kind"] == kind]
        codes = np.array([row["votes"] for row in rows], dtype=np.int64)
        votes = codes[:, None] // 3 ** np.arange(len(LABELERS)) % 3
        reliability[kind], truth = estimate(votes, np.array([row["n"] for row in rows], dtype=np.float64))
        # Probabilities as whole millionths, so that sums do not depend on their order.
        labels += [(kind, int(code), round(p * 1e6)) for code, p in zip(codes, truth.tolist(), strict=True)]
    likely = F.broadcast(spark.createDataFrame(labels, "kind int, votes int, millionths long"))
    by_features = (
        patterns.join(likely, ["kind", "votes"]).groupBy("kind", "features")
        .agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("decimal(20, 0)") * F.col("millionths")).alias("true"))
        .orderBy("kind", "features").collect()
    )
    for kind in range(len(KINDS)):
        rows = [row for row in by_features if row["kind"] == kind]
        if rows:
            codes = np.array([row["features"] for row in rows], dtype=np.int64)
            counts = np.array([row["n"] for row in rows], dtype=np.float64)
            truth = np.array([float(row["true"]) for row in rows]) / 1e6 / counts
            weights[kind] = fit(codes[:, None] >> np.arange(len(FEATURES)) & 1, counts, truth)
    return Model(reliability, weights)


def candidates_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): every document with all its candidates, their votes and features. Texts are read once, here."""
    bounded_batches(docs.sparkSession)
    fields = [("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.int32()),
              ("features", pa.int32())]
    names = [name for name, _ in fields]
    spans = pa.list_(pa.struct(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                [dict(zip(names, row, strict=True)) for row in candidates(text.as_py() or "")] for text in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, spans)], names=["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    struct = "struct<start: long, kind: int, end: long, base: boolean, votes: int, features: int>"
    return pick(docs, id_col, text_col).toDF("id", "text").mapInArrow(run, f"id {kind}, spans array<{struct}>")


def personal_data(docs: DataFrame, sure: float = SURE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans, an array of (kind, start, end, base), of every whole text; in code points, by start and kind.

    Base spans are always there. Proposed spans, which overlap no base span and no other
    proposed one, are there if the classifier gives them a probability of ``sure`` or
    more. A null or empty text has no spans. Null ids and repeated rows are documents of
    their own, and count as often as they occur when votes are counted. Without
    candidates nothing is learnt and there are no spans; an empty table gives an empty
    result. Other columns are ignored. Time is linear in the length of a text.
    """
    found = materialise(candidates_of(docs, id_col, text_col), "personal-candidates")
    model = learn(found)
    names = F.array(*map(F.lit, KINDS))

    def counts(span: Column) -> Column:
        return span["base"] | model.sure(span["kind"], span["features"], sure)

    def named(span: Column) -> Column:
        return F.struct(F.element_at(names, span["kind"] + 1).alias("kind"), span["start"].alias("start"),
                        span["end"].alias("end"), span["base"].alias("base"))

    return found.select(F.col("id").alias(id_col), F.transform(F.filter("spans", counts), named).alias("spans"))
