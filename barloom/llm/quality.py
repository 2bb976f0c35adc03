"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Words are runs of letters and digits, or runs of other visible signs. Unigrams and
bigrams are hashed into a fixed number of weights; a document's features are the
n-gram counts divided by its number of words, so a score is a sparse dot product.
Bigrams of one word twice share one hash, and so do 4-grams seen before in the text:
what counts there is the repeat, not the word.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import WordHashes, freeing_groups, map_batches, map_texts, mix, share_bound, share_hash, text_bytes

#: Weights, as a power of two.
BITS = 18
#: Labelled rows (at most) the classifier is fitted on, and shards that learn side by side.
SAMPLE_ROWS = 12_000
SHARDS = 6
#: Follow-the-regularised-leader: step, smoothing, L1, L2, passes; features are scaled by SCALE.
ALPHA, BETA, L1, L2, PASSES, SCALE = 0.5, 1.0, 0.02, 0.02, 3, 20.0
#: A document is predicted good from this probability on.
THRESHOLD = 0.3

_WORDS = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+")
_HASHES = WordHashes()
_TWICE, _AGAIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_K = np.uint64(0x9E3779B97F4A7C15)


def features(text: bytes) -> tuple[np.ndarray, int]:
    """Hashed unigrams, bigrams and repeat marks of a text, with repeats, and its number of words."""
    h = mix(_HASHES.of(_WORDS.findall(text)))
    pairs = mix(h[:-1] * _K + h[1:])
    fours = np.sort(mix(pairs[:-2] * _K + pairs[2:]))
    again = np.full(np.count_nonzero(fours[1:] == fours[:-1]), _AGAIN)
    pairs[h[1:] == h[:-1]] = _TWICE
    return (np.concatenate([h, pairs, again]) >> np.uint64(64 - BITS)).astype(np.int64), len(h)


def ftrl(examples: list[tuple[np.ndarray, int, int]], size: int) -> np.ndarray:
    """Weights (the last one is the bias) after ``PASSES`` passes over the examples."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    rows = []
    for h, words, label in examples:
        at, counts = np.unique(h, return_counts=True)
        rows.append((np.append(at, size), np.append(counts * (SCALE / max(1, words)), 1.0), label))
    for _ in range(PASSES):
        for at, x, label in rows:
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at] = zi + g - step * w
            n[at] = ni + g * g
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> np.ndarray | None:
    """Weights learnt from at most about ``sample_rows`` labelled documents; None without any.

    The rows are those with the smallest hashes of their id. Each of ``SHARDS`` shards is
    learnt in a task of its own and the weights are averaged, so the driver receives
    a fixed number of fixed-size vectors. Null labels, ids or texts teach nothing.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("label")).distinct()
    part = share_hash("doc_id")
    facts = known.agg(F.count(F.lit(1)).alias("n"), F.min(part).alias("least")).first()
    if not facts["n"]:
        return None
    chosen = known.where(part < max(share_bound(sample_rows / facts["n"]), facts["least"] + 1))
    # About sample_rows pairs of numbers, so the broadcast is bounded.
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    examples = plain.where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")

    def encode(batch):
        found = [features(t) for t in text_bytes(batch.column(1))]
        return {"shard": [(i // 7) % SHARDS for i in batch.column(0).to_pylist()], "label": batch.column(2), "doc_id": batch.column(0),
                "words": [words for _, words in found], "h": [h.astype(np.int32).tobytes() for h, _ in found]}

    encoded = map_batches(examples.select("doc_id", "text", "label"), encode, "shard int, label int, doc_id bigint, words int, h binary")

    def learn(rows: pa.Table) -> pa.Table:
        order = rows.sort_by([("doc_id", "ascending"), ("label", "ascending")])
        rng = np.random.default_rng(7)
        picks = rng.permutation(order.num_rows)
        hs, ws, ls = (order.column(c).to_pylist() for c in ("h", "words", "label"))
        w = ftrl([(np.frombuffer(hs[i], np.int32).astype(np.int64), ws[i], ls[i]) for i in picks], 1 << BITS)
        return pa.table({"n": pa.array([order.num_rows], pa.int64()), "w": pa.array([w.astype(np.float32).tobytes()], pa.binary())})

    learnt = encoded.groupBy("shard").applyInArrow(freeing_groups(learn), "n bigint, w binary").collect()
    if not learnt:
        return None
    return np.average([np.frombuffer(r["w"], np.float32) for r in learnt], axis=0, weights=[r["n"] for r in learnt]).astype(np.float32)


def score_quality(docs: DataFrame, weights: np.ndarray | None, id_col: str = "doc_id", text_col: str = "text",
                  carry: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """doc_id and score (0 to 1, higher is better) of every row's whole text.

    The text and other columns are passed on where asked for.

    An empty or null text scores by the bias alone; without weights every score is 0.5.
    Repeated rows each keep a row, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights if weights is not None else np.zeros((1 << BITS) + 1, np.float32))

    def score(batch):
        w = shared.value
        raw = np.empty(batch.num_rows)
        for i, text in enumerate(text_bytes(batch.column(1))):
            h, words = features(text)
            raw[i] = w[-1] + w[h].sum(dtype=np.float64) * SCALE / max(1, words)
        return {"score": 1.0 / (1.0 + np.exp(-np.clip(raw, -35, 35)))}

    return map_texts(docs, score, "score double", id_col, text_col, carry, with_text)
