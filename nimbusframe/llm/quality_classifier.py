"""Operator 10: supervised subword embeddings for document quality.

Vectors of hashed words and character n-grams are averaged over a document, with one for every pair of
one word twice in succession (hashed by its words such a pair would be unknown in most texts), and go
through a softmax layer; both are learned with stochastic gradient descent in numpy
from a bounded sample of labelled rows outside the held-out fold. At scoring time each
distinct word's share of the two logits is summed once and reused, which gives the same
average as looking up every feature.

Defined cases: null, empty and blank texts have no features and get the score of the
bias alone. Nulls and repeats in the labels: null rows are left out, of repeated ids
the largest label counts. Without any usable label, or with one class only, the score is 0.5
or the share of that class smoothed by one. Each row is scored, repeats and null ids too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbusframe.llm.common import TokenTable, is_fold, map_arrow, merged, sampled_labels, segment, table
from nimbusframe.llm.subwords import feature_rows, tokens_of

#: Parameters. SAMPLE bounds the training rows of each label value; SAME is how often a pair of one word twice counts; PULL is the vectors' share of the rate, as each sees a small part of a document.
SAMPLE, BUCKETS, DIM, LOW, HIGH, EPOCHS, BATCH, RATE, PULL, SAME, CUT = 1500, 1 << 17, 8, 3, 4, 8, 32, 0.5, 600, 8, 0.7


def train(texts: list[str], y: np.ndarray, buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, seed: int = 1) -> tuple[np.ndarray, float]:
    """(log-odds share of each bucket and of the pair of one word twice, bias) of the trained two-class softmax."""
    rng = np.random.default_rng(seed)
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return np.zeros(buckets + 1, dtype=np.float32), float(np.log(share / (1 - share)))
    words: dict[bytes, int] = {}
    docs = [[words.setdefault(t, len(words)) for t in tokens_of(x)] for x in texts]
    flat, counts = feature_rows(list(words), buckets, LOW, HIGH, strip=False)
    starts = np.cumsum(counts) - counts
    rows = []
    for d in docs:  # distinct features and their shares, document by document
        w, c = np.unique(np.array(d, dtype=np.int64), return_counts=True)
        if not len(w):
            rows.append((np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32)))
            continue
        n = counts[w]
        at = np.repeat(starts[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        f, back = np.unique(np.append(flat[at], buckets), return_inverse=True)
        v = np.bincount(back, weights=np.append(np.repeat(c, n), SAME * sum(a == b for a, b in zip(d, d[1:]))))  # noqa: B905
        rows.append((f, (v / v.sum()).astype(np.float32)))
    emb = (rng.random((buckets + 1, dim), dtype=np.float32) - 0.5) / dim
    out, bias = np.zeros((dim, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))).astype(np.float32)
    target = np.eye(2, dtype=np.float32)[y]
    epochs += 6000 // len(y)  # few rows still get enough steps
    steps, done = epochs * len(y), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(order), BATCH):
            pick = order[k : k + BATCH]
            f = np.concatenate([rows[i][0] for i in pick])
            v = np.concatenate([rows[i][1] for i in pick])
            lengths = np.array([len(rows[i][0]) for i in pick])
            h = segment(np.add, emb[f] * v[:, None], lengths)
            z = h @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - target[pick]) * weight[pick, None] / len(pick)
            rate = RATE * (1 - done / steps)
            gh = g @ out.T
            out -= rate * h.T @ g
            bias -= rate * 0.1 * g.sum(0)
            step = np.repeat(gh, lengths, axis=0) * v[:, None]
            for j in range(dim):
                emb[:, j] -= PULL * rate * np.bincount(f, weights=step[:, j], minlength=buckets + 1).astype(np.float32)
            done += len(pick)
    return (emb @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def score_quality(docs: DataFrame, share: np.ndarray, bias: float) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = docs.sparkSession.sparkContext.broadcast((share, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, bias = model.value

        def rows(tokens: list[bytes]) -> np.ndarray:
            flat, counts = feature_rows(tokens, len(share) - 1, LOW, HIGH, strip=False)
            return np.stack([segment(np.add, share[flat].astype(np.float64), counts), counts], axis=1)

        known = TokenTable(rows)
        for ids, texts in merged(batches):
            at, lengths = known.lookup([tokens_of(t) for t in texts])
            total = segment(np.add, known.matrix[at], lengths) if len(at) else np.zeros((len(ids), 2))
            owner = np.repeat(np.arange(len(ids)), lengths)
            same = SAME * np.bincount(owner[1:][(at[1:] == at[:-1]) & (owner[1:] == owner[:-1])], minlength=len(ids))
            total += np.stack([same * float(share[-1]), same], axis=1)
            z = total[:, 0] / np.maximum(total[:, 1], 1) + bias
            score = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.float64())})

    scored = map_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double")
    return scored.select("doc_id", is_fold(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    share, bias = train(*sampled_labels(spark, sf_dir, "quality", SAMPLE))
    return score_quality(table(spark, sf_dir, "documents"), share, bias)
