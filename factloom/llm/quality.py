"""Quality classifier: a byte-level convolutional network in numpy.

A document is cut into overlapping chunks of CHUNK bytes, one every STRIDE bytes, so
that every byte is covered. Each chunk is described by a learned embedding of its
bytes and by how many of its bytes recur at each distance before them. Learned
filters run over all chunks, the largest response of each filter stays, and a
small layer combines these into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bounded_batches, lean, pick, text_bytes

STRIDE = 16
CHUNK = 2 * STRIDE
EMBED = 8
FILTERS = 32
HIDDEN = 16
# Distances at which bytes are compared with earlier ones.
LAGS = 24
# The code of padding: a byte that UTF-8 never holds.
PAD = 255
# Rows of padding between texts that are scored together: no lag reaches over them.
GAP = -(-LAGS // STRIDE)
# Bounds of the sample the network is fitted on: rows of each class, and bytes of a row.
TRAIN_ROWS = 1500
TRAIN_BYTES = 32768
EPOCHS = 10
# Steps at least: a small sample is gone through more often.
LEAST_STEPS = 450
BATCH = 64
RATE = 0.01
# Bytes that are scored at once. Longer texts go through in parts that overlap.
SCORE_BYTES = 1 << 17
OVERLAP = (GAP + 2) * STRIDE


@dataclass
class Network:
    """Weights. ``embed`` row PAD is the padding after the end of a text and stays zero."""

    embed: np.ndarray
    filters: np.ndarray
    lags: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.lags, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]


def new_network(seed: int = 7) -> Network:
    draw = np.random.default_rng(seed)

    def normal(*shape, scale):
        return (draw.standard_normal(shape) * scale).astype(np.float32)

    embed = normal(256, EMBED, scale=0.5)
    embed[PAD] = 0
    return Network(
        embed,
        normal(CHUNK * EMBED, FILTERS, scale=(CHUNK * EMBED) ** -0.5),
        normal(LAGS, FILTERS, scale=LAGS**-0.5),
        np.zeros(FILTERS, np.float32),
        normal(FILTERS, HIDDEN, scale=FILTERS**-0.5),
        np.zeros(HIDDEN, np.float32),
        normal(HIDDEN, 1, scale=HIDDEN**-0.5),
        np.zeros(1, np.float32),
    )


def blocks(raw: bytes) -> np.ndarray:
    """Bytes as rows of STRIDE codes; at least two rows, filled up with PAD."""
    rows = max(2, -(-len(raw) // STRIDE))
    codes = np.full(rows * STRIDE, PAD, dtype=np.uint8)
    codes[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    return codes.reshape(rows, STRIDE)


def recurrence(codes: np.ndarray) -> np.ndarray:
    """For each chunk and distance, the share of its bytes that equal the byte so far before them."""
    flat = codes.ravel()
    real = flat != PAD
    same = np.zeros(len(flat), dtype=bool)
    eights = same.view(np.uint64)
    out = np.empty((len(codes), LAGS), dtype=np.float32)
    ones = np.uint64(0x0101010101010101)
    for lag in range(1, LAGS + 1):
        same[:lag] = False
        np.equal(flat[lag:], flat[:-lag], out=same[lag:])
        same &= real
        counts = (eights * ones) >> np.uint64(56)
        out[:, lag - 1] = counts[0::2] + counts[1::2]
    return (out[:-1] + out[1:]) * np.float32(1 / CHUNK)


def responses(net: Network, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Responses of all filters (chunk x filter) and the recurrence shares they use."""
    half = STRIDE * EMBED
    embedded = net.embed[codes.ravel()].reshape(len(codes), half)
    shares = recurrence(codes)
    both = embedded @ np.hstack([net.filters[:half], net.filters[half:]])
    out = both[:-1, :FILTERS] + both[1:, FILTERS:]
    out += shares @ net.lags
    out += net.bias
    return out, shares


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """Largest response of every filter over each whole text.

    Texts, and parts of long ones, are laid end to end with padding between and scored
    together. Parts overlap by a chunk and the longest distance, and the responses of
    a part's first GAP rows, which lack what stands before them, are left to the part before.
    """
    best = np.full((len(texts), FILTERS), -np.inf, dtype=np.float32)
    gap = np.full((GAP, STRIDE), PAD, dtype=np.uint8)
    held: list[tuple[int, np.ndarray, int]] = []

    def flush() -> None:
        if not held:
            return
        pieces, edges, at = [], [], 0
        for _, codes, skip in held:
            pieces += [codes, gap]
            edges += [at + skip, at + len(codes) - 1]
            at += len(codes) + GAP
        top = np.maximum.reduceat(responses(net, np.vstack(pieces))[0], edges)[::2]
        np.maximum.at(best, [owner for owner, _, _ in held], top)
        held.clear()

    size = 0
    for i, raw in enumerate(texts):
        for start in range(0, max(1, len(raw) - OVERLAP), SCORE_BYTES - OVERLAP):
            part = raw[start : start + SCORE_BYTES]
            held.append((i, blocks(part), GAP if start else 0))
            size += len(part)
            if size >= SCORE_BYTES:
                flush()
                size = 0
    flush()
    return best


def combine(net: Network, best: np.ndarray) -> np.ndarray:
    hidden = np.maximum(np.tanh(best) @ net.hidden + net.hidden_bias, 0)
    return 1 / (1 + np.exp(-np.clip(hidden @ net.out + net.out_bias, -30, 30)[:, 0].astype(np.float64)))


def score_texts(net: Network, texts: list[bytes]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    return combine(net, pooled(net, texts))


def fit(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Fit by Adam on weighted cross-entropy. Gradients pass through the winning chunk of each filter."""
    net = new_network(seed)
    if not texts:
        return net
    draw = np.random.default_rng(seed)
    first, second, step = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()], 0
    cut = [blocks(raw) for raw in texts]
    batches = -(-len(texts) // BATCH)
    epochs = max(epochs, -(-LEAST_STEPS // batches))
    total = epochs * batches
    for _ in range(epochs):
        order = draw.permutation(len(texts))
        for low in range(0, len(texts), BATCH):
            chosen = order[low : low + BATCH]
            best = np.empty((len(chosen), FILTERS), np.float32)
            windows = np.empty((len(chosen), FILTERS, CHUNK), np.uint8)
            shares = np.empty((len(chosen), FILTERS, LAGS), np.float32)
            for row, i in enumerate(chosen):
                value, share = responses(net, cut[i])
                at = value.argmax(axis=0)
                best[row] = value[at, np.arange(FILTERS)]
                windows[row] = np.hstack([cut[i][at], cut[i][at + 1]])
                shares[row] = share[at]
            squashed = np.tanh(best)
            raw_hidden = squashed @ net.hidden + net.hidden_bias
            hidden = np.maximum(raw_hidden, 0)
            chance = 1 / (1 + np.exp(-np.clip(hidden @ net.out + net.out_bias, -30, 30)))
            weight = weights[chosen][:, None]
            d_out = ((chance - labels[chosen][:, None]) * weight / weight.sum()).astype(np.float32)
            d_hidden = (d_out @ net.out.T) * (raw_hidden > 0)
            d_best = (d_hidden @ net.hidden.T) * (1 - squashed**2)
            embedded = net.embed[windows].reshape(len(chosen), FILTERS, CHUNK * EMBED)
            d_windows = (d_best[:, :, None] * net.filters.T[None]).reshape(-1, EMBED)
            d_embed = np.stack(
                [np.bincount(windows.ravel(), weights=d_windows[:, e], minlength=256) for e in range(EMBED)], axis=1
            ).astype(np.float32)
            d_embed[PAD] = 0
            gradients = [
                d_embed,
                np.einsum("bf,bfk->kf", d_best, embedded),
                np.einsum("bf,bfl->lf", d_best, shares),
                d_best.sum(axis=0),
                squashed.T @ d_hidden,
                d_hidden.sum(axis=0),
                hidden.T @ d_out,
                d_out.sum(axis=0),
            ]
            step += 1
            rate = RATE * (1 - step / (total + 1))
            for value, gradient, m, v in zip(net.parts(), gradients, first, second, strict=True):
                m += 0.1 * (gradient - m)
                v += 0.001 * (gradient * gradient - v)
                value -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def held_out(doc_id) -> F.Column:
    """Whether a document is kept out of the fit: CRC-32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, max_bytes: int = TRAIN_BYTES,
                  id_col: str = "doc_id", text_col: str = "text") -> pd.DataFrame:
    """A bounded sample of labelled, not held-out documents: text, label and weight.

    Of each class, the ``rows`` documents lowest in a hash of their id are taken, of
    those not longer than ``max_bytes``. Weights restore the classes' shares among
    all labelled rows. Rows with a null id or label are left out; a document with several
    labels counts as good only if all say so.
    """
    known = (
        pick(labels, "doc_id", "quality")
        .where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("id"))
        .agg((F.min("quality") > 0).cast("int").alias("label"))
    )
    shares = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(F.lit("train"), "id")
    # A few more ids than wanted, for those whose text is missing or too long.
    chosen = [known.where(F.col("label") == c).orderBy(order, "id").limit(2 * rows) for c in (0, 1)]
    texts = (
        pick(docs, id_col, text_col)
        .toDF("id", "text")
        .where(F.octet_length("text") <= max_bytes)
        .join(F.broadcast(chosen[0].unionByName(chosen[1])), "id")
    )
    parts = [
        texts.where(F.col("label") == c).orderBy(order, "id", "text").limit(rows).toPandas() for c in (0, 1)
    ]
    for c, part in enumerate(parts):
        part["weight"] = shares.get(c, 0) / max(1, len(part))
    return pd.concat(parts, ignore_index=True)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id",
          text_col: str = "text") -> Network:
    sample = training_rows(docs, labels, rows, TRAIN_BYTES, id_col, text_col)
    return fit(
        text_bytes(sample["text"]), sample["label"].to_numpy(np.float32), sample["weight"].to_numpy(np.float32)
    )


def scorer(net: Network):
    """The network as a column function of a text column."""

    @F.pandas_udf("double")
    @lean
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(score_texts(net, text_bytes(texts)))

    return score


def quality_scores(docs: DataFrame, net: Network, threshold: float = 0.3, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score (0 to 1, higher is better), predicted (1 from ``threshold`` on).

    Whole texts are scored, whatever their length. A null text counts as empty; an
    empty text is scored like one that is all padding. A null id is not held out.
    Repeated rows are scored alike. An empty table gives an empty result; other
    columns are ignored, and nothing but the text enters a score.
    """
    bounded_batches(docs.sparkSession)
    score = scorer(net)
    rows = pick(docs, id_col, text_col).toDF("id", "text")
    scored = rows.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
