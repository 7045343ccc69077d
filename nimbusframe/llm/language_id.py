"""Operator 8: language identification by words first, then ever shorter character n-grams.

A known word gives each language the logarithm of its relative frequency there. An
unseen word falls back to its character n-grams: those of the greatest length for which
the model knows any count, in the mean; if none is known the next shorter length is
tried, down to single letters. A document's languages are compared by the sum over words.

The model is learned from a bounded sample of the documents outside the held-out fold
(about ``SAMPLE`` rows of each language by a hash of id and text, all where there are fewer; texts over ``MAX_CHARS``
characters are predicted whole but not learned from) and keeps every word and n-gram of it, by 64-bit hashes, so its size has a bound whatever the corpus.

Defined cases: a null text, or one without any letter, is ``und`` with score 0. Letters but no
evidence: the language of the most training rows, at the uniform score. Ties go to the
language first in alphabetical order. No training rows at all: every text is ``und``.
Repeated rows are each predicted; a null id is never held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from nimbusframe.llm.common import TokenTable, is_fold, map_arrow, merged, segment, table
from nimbusframe.llm.subwords import tokens_of

#: Parameters; TOKENS numbered at a time and CHARS judged at a time bound the memory of a worker.
SAMPLE, MAX_CHARS, LONGEST, SMOOTH, LEAST_SCORE = 3000, 100_000, 4, 0.5, 0.3
TOKENS, CHARS = 100_000, 1_000_000
LETTERS = regex.compile(r"\p{L}+(?:['’]\p{L}+)*").findall


def letter_words(token: str) -> list[str]:
    return LETTERS(token.lower())


def grams(word: str, n: int) -> list[str]:
    w = f"<{word}>" if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def key(gram: str, n: int) -> int:
    """64-bit hash of a word (n = 0) or n-gram as a signed long; entries are told apart by it."""
    h = xxh64_intdigest(gram, n)
    return h - (1 << 64) if h >> 63 else h


class Model:
    """Log frequencies by language; columns in the order of ``langs``. Table 0 has the words, table n the n-grams, as sorted hashes beside rows."""

    def __init__(self, langs: list[str], tables: list[tuple[np.ndarray, np.ndarray]], prior: np.ndarray) -> None:
        self.langs, self.prior, self.tables = langs, prior, tables

    def rows(self, n: int, hashes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The row of each hash in table n, and whether it has one."""
        known, _ = self.tables[n]
        h = np.array(hashes, dtype=np.int64)
        at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
        return at, known[at] == h if len(known) else np.zeros(len(h), dtype=bool)

    def word_rows(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.langs)))
        at, ok = self.rows(0, [key(w, 0) for w in words])
        out[ok] = self.tables[0][1][at[ok]]
        left = np.flatnonzero(~ok)
        for n in range(LONGEST, 0, -1):
            lists = [[key(g, n) for g in grams(words[i], n)] for i in left]
            at, ok = self.rows(n, [h for own in lists for h in own])
            word = np.repeat(np.arange(len(left)), [len(own) for own in lists])[ok]
            found = np.bincount(word, minlength=len(left))
            some = found > 0
            if some.any():
                out[left[some]] = segment(np.add, self.tables[n][1][at[ok]], found)[some] / found[some, None]
            left = left[~some]
        return out

    def token_rows(self, tokens: list[bytes]) -> np.ndarray:
        """Per token: the sum over its words, their number, and whether it has a letter."""
        out = np.zeros((len(tokens), len(self.langs) + 2))
        for start in range(0, len(tokens), 20_000):  # bounds the lists of n-grams
            strings = [t.decode("utf-8", "replace") for t in tokens[start : start + 20_000]]
            words = [letter_words(s) for s in strings]
            part, counts = out[start : start + len(strings)], np.array([len(w) for w in words])
            part[:, : len(self.langs)] = segment(np.add, self.word_rows([w for own in words for w in own]), counts)
            part[:, -2] = counts
            part[:, -1] = [any(map(str.isalpha, s)) for s in strings]
        return out


#: The model of an empty sample.
NOTHING = Model([], [(np.zeros(0, dtype=np.int64), np.zeros((0, 0)))] * (LONGEST + 1), np.zeros(0))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from ``docs`` (text, lang and id) outside fold 2 of 4."""
    fold_in = docs.where(F.col("lang").isNotNull() & (F.length("text") <= MAX_CHARS) & ~is_fold(F.col("doc_id"), 4, 2))
    counts = {r["lang"]: r["n"] for r in fold_in.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return NOTHING
    bounds = docs.sparkSession.createDataFrame([(lang, int((1 << 30) * min(1.0, sample / n)) + 1) for lang, n in counts.items()], "lang string, bound long")
    placed = fold_in.withColumn("place", F.pmod(F.xxhash64("doc_id", "text", F.lit("language-sample")), F.lit(1 << 30))).select("lang", "text", "place")
    picked = placed.join(F.broadcast(bounds), "lang").where("place < bound").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, int, str], int] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in letter_words(text):
                    seen[lang, 0, w] = seen.get((lang, 0, w), 0) + 1
            for (lang, _, w), c in list(seen.items()):
                for n in range(1, LONGEST + 1):
                    for g in grams(w, n):
                        seen[lang, n, g] = seen.get((lang, n, g), 0) + c
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([k[0] for k in seen], pa.string()), "n": pa.array([k[1] for k in seen], pa.int32()),
                "h": pa.array([key(k[2], k[1]) for k in seen], pa.int64()), "c": pa.array(list(seen.values()), pa.int64()),
            })

    counted = map_arrow(picked, count, "lang string, n int, h long, c long").groupBy("lang", "n", "h").agg(F.sum("c").alias("c"))
    rows = counted.select("lang", "n", "h", "c").toArrow()  # what the sample holds
    langs = sorted(rows["lang"].unique().to_pylist())
    if not langs:
        return NOTHING
    lang = pc.index_in(rows["lang"], pa.array(langs)).to_numpy()
    n, h, c = (rows[k].to_numpy() for k in ("n", "h", "c"))
    tables = []
    for k in range(LONGEST + 1):
        own = n == k
        known, at = np.unique(h[own], return_inverse=True)
        seen = np.zeros((len(known), len(langs)))
        seen[at, lang[own]] = c[own]
        tables.append((known, np.log((seen + SMOOTH) / (seen.sum(0) + SMOOTH * (len(known) + 1)))))
    return Model(langs, tables, np.array([counts[k] for k in langs], dtype=np.float64))


def judge(m: Model, known: TokenTable, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; the score is the posterior share, tempered by length."""
    k = len(m.langs)
    at, lengths = known.lookup([tokens_of(t) for t in texts])
    total = segment(np.add, known.matrix[at], lengths) if len(at) else np.zeros((len(texts), k + 2))
    letters = total[:, -1] > 0
    if not k:
        return ["und"] * len(texts), np.zeros(len(texts))
    logs = total[:, :k] / np.sqrt(np.maximum(1, total[:, -2:-1]))
    p = np.exp(logs - logs.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = np.where(np.ptp(logs, axis=1) > 0, logs.argmax(1), int(m.prior.argmax()))
    return [m.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], np.where(letters, p[np.arange(len(texts)), best], 0.0)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = TokenTable(shared.value.token_rows, TOKENS)
        for ids, texts in merged(batches, CHARS):
            lang, score = judge(shared.value, known, texts)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())})

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double")


def in_known_language(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """The rows whose text has a language, with a score of at least ``least``; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = TokenTable(shared.value.token_rows, TOKENS)
        for batch in batches:
            texts = batch.column(schema.fieldNames().index("text")).to_pylist()
            lang, score = judge(shared.value, known, texts)
            yield batch.filter(pa.array([k != "und" and s >= least for k, s in zip(lang, score, strict=True)]))

    return map_arrow(docs, run, schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", is_fold(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
