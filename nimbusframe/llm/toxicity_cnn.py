"""Operator 7: a convolutional text classifier for toxicity.

Each word's vector is the mean of hashed vectors of its form and character n-grams.
Filters of several widths run over the words, each keeps its maximum over the whole
document, and a logistic layer gives the score. Training is numpy, on every
labelled row outside the held-out fold; the gradient of a maximum goes to the one
window that won. As a filter is linear, its share for each distinct word and position is
computed once, so that scoring adds rows of a table.

Up to SAMPLE rows of each label value the driver trains on all of them. Where there are more, what it learns
from so many is only the start: every row is dealt by a hash of its id to a group of about GROUP, each group
goes on from the start through all its rows, and a parameter then moves by the mean of the groups that
changed it. So a task's work is bounded, and the result doesn't depend on how files are split.

Thresholds are calibrated by language: a fifth of all the rows is kept out of training, and for
each language the cut with the best F1 there is mapped onto the contract's 0.3 by shifting
the log-odds (of more rows than the driver trains on, log-odds are told apart by 1/256). The language is guessed from the text's own words, by how many of the training texts of each
language have them; a text's own lang is never read to score it.

Defined cases: null, empty and blank texts have no words, every filter gives 0. Words at
the border are padded with zeros, so one-word texts work for every width. Repeated rows
are scored each, a repeated id trains once; null ids are never held out. Without usable labels the score is 0.5 shifted
to below the cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbusframe.llm.common import TokenTable, forget, from_planes, is_fold, map_arrow, merged, planes, sampled_labels, saved, segment, table, usable_labels
from nimbusframe.llm.subwords import feature_rows, tokens_of

#: Parameters. SAMPLE bounds the rows of each label value that the driver trains on; VOTERS words of each language guess a text's.
SAMPLE, BUCKETS, DIM, WIDTHS, FILTERS, LOW, HIGH, EPOCHS, RATE, CUT, VOTERS = 1500, 1 << 16, 8, (1, 2, 3), 6, 4, 6, 5, 0.1, 0.3, 100

PAD = max(WIDTHS)
#: About so many rows in a group; parts of the vectors that are averaged apart; most labels that are broadcast; longest text on the driver; steps of log-odds.
GROUP, SLICES, KEYS, LONG, STEP = 2000, 16, 1_000_000, 100_000, 256
#: The contract's cut as log-odds.
NATURAL = float(np.log(CUT / (1 - CUT)))


def padded_tokens(text: str | None) -> list[bytes]:
    return tokens_of(text) + [b""] * PAD


def bare(token: bytes) -> bytes:
    return token.lower().strip(b".,;:!?")


def voters(texts: list[str], langs: list[str | None]) -> tuple[list[str], dict[bytes, np.ndarray]]:
    """The languages of the training texts, and the words by which a text's language is guessed: of each language the VOTERS that are in
    most of its texts, with the logarithm of the share of each language's texts that have them, less the mean of those."""
    names = sorted({k for k in langs if k is not None})
    size = np.zeros(len(names))
    seen: dict[bytes, np.ndarray] = {}
    for t, lang in zip(texts, langs, strict=True):
        if lang is not None:
            k = names.index(lang)
            size[k] += 1
            for w in {bare(x) for x in tokens_of(t)}:
                seen.setdefault(w, np.zeros(len(names)))[k] += 1
    seen.pop(b"", None)
    chosen = {w for k in range(len(names)) for w in sorted((w for w in seen if seen[w][k] > 0), key=lambda w: (-seen[w][k], w))[:VOTERS]}
    return names, weights({w: seen[w] for w in chosen}, size)


def weights(seen: dict[bytes, np.ndarray], size: np.ndarray) -> dict[bytes, np.ndarray]:
    logs = {w: np.log((seen[w] + 0.5) / (size + 1)) for w in sorted(seen)}
    return {w: (x - x.mean()).astype(np.float32) for w, x in logs.items()}


class Network:
    def __init__(self, seed: int = 3, langs: list[str] | None = None, votes: dict[bytes, np.ndarray] | None = None) -> None:
        self.langs, self.votes = langs or [], votes or {}
        rng = np.random.default_rng(seed)
        self.emb = ((rng.random((BUCKETS, DIM)) - 0.5) * 0.5).astype(np.float32)
        self.filters = [((rng.random((w, DIM, FILTERS)) - 0.5) * 0.7).astype(np.float32) for w in WIDTHS]
        self.filter_bias = np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32)
        self.out = ((rng.random(len(WIDTHS) * FILTERS)) * 0.5).astype(np.float32)
        self.bias = np.float32(-1.0)
        self.shift = np.zeros(len(self.langs) + 1, dtype=np.float32)
        self.trained = False

    # A word's row: its share at each position of each filter.
    def word_rows(self, tokens: list[bytes]) -> np.ndarray:
        flat, counts = feature_rows(tokens, BUCKETS, LOW, HIGH, strip=True)
        mean = segment(np.add, self.emb[flat], counts) / np.maximum(counts, 1)[:, None]
        mean[[not t for t in tokens]] = 0  # the empty token stands for the padding
        parts = [mean @ f[k] for f in self.filters for k in range(len(f))]
        number = {w: k for k, w in enumerate(self.votes, 1)}
        votes = np.stack([np.zeros(len(self.langs), dtype=np.float32), *self.votes.values()])
        return np.concatenate([*parts, votes[[number.get(bare(t), 0) for t in tokens]]], axis=1).astype(np.float32)

    def pooled(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Maximum of each filter over each document; 0 for documents without words. PAD rows of padding follow each document."""
        outs, col = [], 0
        starts = np.cumsum(lengths + PAD) - lengths - PAD
        some = lengths > 0
        bounds = np.stack([starts[some], starts[some] + lengths[some]], axis=1).ravel()
        for w in WIDTHS:
            total = rows[:, col : col + FILTERS].copy()
            for k in range(1, w):
                total[:-k] += rows[k:, col + k * FILTERS : col + (k + 1) * FILTERS]
            out = np.zeros((len(lengths), FILTERS), dtype=np.float32)
            if len(bounds):
                out[some] = np.maximum.reduceat(total, bounds, axis=0)[::2]
            outs.append(out)
            col += w * FILTERS
        return np.concatenate(outs, axis=1)

    def raw(self, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds and the guessed language of each document; the last number stands for none. Rows are padded."""
        h = np.maximum(self.pooled(rows, lengths) + self.filter_bias, 0)
        n = len(self.langs)
        if not n:
            return h @ self.out + self.bias, np.zeros(len(lengths), dtype=np.int64)
        votes = segment(np.add, rows[:, -n:], lengths + PAD)
        lang = np.where(np.ptp(votes, axis=1) > 0, votes.argmax(1), n)
        return h @ self.out + self.bias, lang

    def rest(self) -> np.ndarray:
        """All parameters but the vectors, in one row."""
        return np.concatenate([*[f.ravel() for f in self.filters], self.filter_bias, self.out, [self.bias]]).astype(np.float32)

    def set_rest(self, values: np.ndarray) -> None:
        *parts, bias = np.split(values, np.cumsum([*[f.size for f in self.filters], self.filter_bias.size, self.out.size]))
        self.filters = [p.reshape(f.shape) for p, f in zip(parts, self.filters)]  # noqa: B905
        self.filter_bias, self.out, self.bias = parts[-2], parts[-1], bias[0]

    def score(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        z, lang = self.raw(rows, lengths)
        return 1 / (1 + np.exp(-np.clip(z + self.shift[lang], -40, 40)))


class Descent:
    """What the steps over rows need besides the network: sums of squared gradients."""

    def __init__(self, net: Network) -> None:
        self.square = [np.full_like(a, 1e-2) for a in (net.emb[:, :1], *net.filters)]
        self.side = [np.full(a.shape, 1e-2, dtype=np.float32) for a in (net.filter_bias, net.out)]
        self.side_bias = 1e-2

    def steps(self, net: Network, docs: list[np.ndarray], y: np.ndarray, order: np.ndarray, flat: np.ndarray, counts: np.ndarray, lift: float, mean: np.ndarray | None = None) -> None:
        """One step for each row in ``order``. With ``mean``, the words' vectors, only those of words that a step changes are made anew."""
        ends = np.cumsum(counts)
        width_of = np.repeat(np.arange(len(WIDTHS)), FILTERS)
        for i in order:
            d = docs[i]
            n = len(d)
            if not n:
                continue
            if mean is None:
                distinct, back = np.unique(d, return_inverse=True)
                cnt = counts[distinct]
                at = np.repeat(ends[distinct] - np.cumsum(cnt), cnt) + np.arange(cnt.sum())
                x = (np.add.reduceat(net.emb[flat[at]], np.cumsum(cnt) - cnt, axis=0) / cnt[:, None])[back]
            else:
                x = mean[d]
            x = np.concatenate([x, np.zeros((max(WIDTHS), DIM), dtype=np.float32)])
            best = []
            pool = np.empty(len(width_of), dtype=np.float32)
            for b, (w, f) in enumerate(zip(WIDTHS, net.filters, strict=True)):
                total = sum(x[k : k + n] @ f[k] for k in range(w))
                win = total.argmax(0)
                best.append(win)
                pool[b * FILTERS : (b + 1) * FILTERS] = total[win, np.arange(FILTERS)]
            pool += net.filter_bias
            h = np.maximum(pool, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ net.out + net.bias, -30, 30)))
            g = np.float32((p - y[i]) * (lift if y[i] else 1) / max(1, lift))
            if abs(g) < 1e-3:
                continue
            gh = g * net.out * (pool > 0)
            go = g * h
            gx: dict[int, np.ndarray] = {}
            for j in np.flatnonzero(gh):
                b, f = width_of[j], j % FILTERS
                s = best[b][f]
                for k in range(WIDTHS[b]):
                    gf = gh[j] * x[s + k]
                    self.square[1 + b][k, :, f] += gf * gf
                    if s + k < n:
                        gx[s + k] = gx.get(s + k, 0) + gh[j] * net.filters[b][k, :, f]
                    net.filters[b][k, :, f] -= RATE * gf / np.sqrt(self.square[1 + b][k, :, f])
            self.side[0] += gh * gh
            self.side[1] += go * go
            self.side_bias += g * g
            net.filter_bias -= RATE * gh / np.sqrt(self.side[0])
            net.out -= RATE * go / np.sqrt(self.side[1])
            net.bias -= np.float32(RATE * g / np.sqrt(self.side_bias))
            for s, grad in gx.items():
                t = d[s]
                f = flat[ends[t] - counts[t] : ends[t]]
                self.square[0][f, 0] += (grad * grad).mean() / len(f)
                net.emb[f] -= RATE * grad / len(f) ** 0.5 / np.sqrt(self.square[0][f])
                if mean is not None:
                    mean[t] = net.emb[f].mean(0)


def numbered(texts: list[str]) -> tuple[list[np.ndarray], list[bytes], np.ndarray, np.ndarray]:
    """Word numbers of each text, the words (the first is the padding), their features and how many each has."""
    words: dict[bytes, int] = {b"": 0}
    docs = [np.array([words.setdefault(t, len(words)) for t in tokens_of(x)], dtype=np.int64) for x in texts]
    return docs, list(words), *feature_rows(list(words), BUCKETS, LOW, HIGH, strip=True)


def best_cut(z: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> float:
    """The middle of the gap with the best F1; z are different log-odds, with how many rows of each label have them."""
    order = np.argsort(z)
    s, ones, zeros = z[order], ones[order], zeros[order]
    above = lambda c, n: np.append(np.cumsum(n[::-1])[::-1], 0)[np.searchsorted(s, c)]
    tries = np.concatenate([(s[1:] + s[:-1]) / 2, [NATURAL]])
    f1 = 2 * above(tries, ones) / np.maximum(1, above(tries, ones) + above(tries, zeros) + ones.sum())
    return float(np.median(tries[f1 >= f1.max() - 1e-12]))


def calibrate(net: Network, z: np.ndarray, lang: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> None:
    """Shifts by guessed language, from rows that were not trained on."""

    def cut(own: np.ndarray) -> float:
        at, back = np.unique(z[own], return_inverse=True)
        return best_cut(at, np.bincount(back, ones[own]), np.bincount(back, zeros[own]))

    every = cut(np.ones(len(z), dtype=bool)) if ones.sum() and zeros.sum() else NATURAL
    for k in range(len(net.langs) + 1):
        own = lang == k
        net.shift[k] = NATURAL - (cut(own) if ones[own].sum() >= 8 and zeros[own].sum() >= 8 else every)


def train(texts: list[str], y: np.ndarray, langs: list[str | None], seed: int = 3, descent: list[Descent] | None = None) -> Network:
    """The network of rows that the driver holds; ``descent`` gets what further steps need."""
    net = Network(seed, *voters(texts, langs))
    if len(y) < 8 or y.min() == y.max():
        net.out[:], net.bias = 0, np.float32(-2)
        return net
    rng = np.random.default_rng(seed)
    docs, words, flat, counts = numbered(texts)
    order = rng.permutation(len(y))
    later, now = order[: len(y) // 5], order[len(y) // 5 :]
    state = Descent(net)
    for _ in range(EPOCHS + 8000 // len(y)):
        state.steps(net, docs, y, rng.permutation(now), flat, counts, (len(y) - y.sum()) / y.sum())
    if descent is not None:
        descent.append(state)
    net.trained = True
    # Calibration on the part that was not trained on, by guessed language.
    rows = net.word_rows(words)
    z, lang = net.raw(rows[np.concatenate([np.append(docs[i], [0] * PAD) for i in later]).astype(np.int64)], np.array([len(docs[i]) for i in later]))
    calibrate(net, z, lang, (y[later] == 1).astype(np.int64), (y[later] == 0).astype(np.int64))
    return net


def fit(spark: SparkSession, sf_dir: str) -> Network:
    """The network of all usable labelled rows."""
    later = F.pmod(F.xxhash64("doc_id", F.lit("later")), F.lit(5)) == 0
    lab = saved(usable_labels(spark, sf_dir, "toxic").select("doc_id", "y", later.alias("later")))
    size = {r["y"]: r for r in lab.groupBy("y").agg(F.count("*").alias("n"), F.count(F.when(~F.col("later"), 1)).alias("now")).collect()}
    side = F.broadcast(lab) if sum(r["n"] for r in size.values()) <= KEYS else lab  # narrow rows; beyond that the texts travel
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").where("text is not null").join(side, "doc_id")
    if all(r["n"] <= SAMPLE for r in size.values()) and rows.where(F.length("text") > LONG).isEmpty():
        return train(*sampled_labels(spark, sf_dir, "toxic", SAMPLE, max_chars=LONG, beside="lang"))
    state: list[Descent] = []
    start = train(*sampled_labels(spark, sf_dir, "toxic", SAMPLE, max_chars=LONG, beside="lang", among=lab.where("not later")), descent=state)
    if not state:
        return start  # hardly any row, or one label only
    repeated = saved(rows.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not repeated.isEmpty():
        once = rows.join(repeated, "doc_id", "left_semi").groupBy("doc_id", "y", "later").agg(F.min(F.struct("text", "lang")).alias("row")).select("doc_id", "row.*", "y", "later")
        rows = rows.join(repeated, "doc_id", "left_anti").unionByName(once)
    net = went_on(rows, start, state[0], -(-sum(r["n"] for r in size.values()) // GROUP), size[0]["now"] / size[1]["now"])
    told = log_odds(rows.where("later"), net).groupBy("z", "lang").agg(F.sum("y").alias("ones"), F.sum(1 - F.col("y")).alias("zeros")).toArrow()  # no more rows than steps of log-odds
    z, lang, ones, zeros = (np.array(told[c].to_pylist(), dtype=np.int64) for c in ("z", "lang", "ones", "zeros"))
    if len(z):
        calibrate(net, z / STEP, lang, ones, zeros)
    return net


def went_on(rows: DataFrame, start: Network, state: Descent, groups: int, lift: float) -> Network:
    """``start`` after the steps of every group, with the languages' words of all rows."""
    model = rows.sparkSession.sparkContext.broadcast((start, state))
    group = F.pmod(F.xxhash64("doc_id", F.lit("group")), F.lit(groups)).cast("int")
    dealt = rows.withColumn("g", group).repartitionById(groups, F.col("g")).sortWithinPartitions("g", F.xxhash64("doc_id", F.lit("order")), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, dict[bytes, int]] = {}
        first, began = model.value
        net, own, g = deepcopy(first), deepcopy(began), None
        for about, texts in merged(batches):
            g = about[0]["g"]
            docs, _, flat, counts = numbered([t for t, a in zip(texts, about, strict=True) if not a["later"]])
            mean = segment(np.add, net.emb[flat], counts) / np.maximum(counts, 1)[:, None]
            own.steps(net, docs, np.array([a["y"] for a in about if not a["later"]]), np.arange(len(docs)), flat, counts, lift, mean)
            for a, t in zip(about, texts, strict=True):
                if a["lang"] is not None:
                    count = seen.setdefault(a["lang"], {b"": 0})
                    count[b""] += 1
                    for w in {bare(w) for w in set(tokens_of(t))} - {b""}:
                        count[w] = count.get(w, 0) + 1
        if g is None:
            return
        parts = [*np.array_split((net.emb - first.emb).ravel(), SLICES), net.rest() - first.rest()]
        blank = [None] * len(parts)
        yield batch([g] * len(parts), list(range(len(parts))), [planes(p) for p in parts], blank, blank, blank)
        for lang, count in seen.items():
            items = list(count.items())
            for k in range(0, len(items), 10_000):
                some = items[k : k + 10_000]
                blank = [None] * len(some)
                yield batch(blank, blank, blank, [lang] * len(some), [w for w, _ in some], [n for _, n in some])

    def batch(*columns: list) -> pa.RecordBatch:
        kinds = {"g": pa.int32(), "part": pa.int32(), "blob": pa.binary(), "lang": pa.string(), "word": pa.binary(), "n": pa.int64()}
        return pa.RecordBatch.from_pydict({c: pa.array(v, t) for (c, t), v in zip(kinds.items(), columns, strict=True)})

    dealt = dealt.select(F.struct("g", "y", "later", "lang").alias("row"), "text")
    done = saved(map_arrow(dealt, run, "g int, part int, blob binary, lang string, word binary, n long"))
    net = Network(0, *whole_voters(done.where("word is not null").select("lang", "word", "n")))
    moved = averaged(done.where("part is not null").select("g", "part", "blob"))
    net.emb = start.emb + np.concatenate(moved[:SLICES]).reshape(BUCKETS, DIM)
    net.set_rest(start.rest() + moved[SLICES])
    net.trained = True
    forget(done)
    return net


def averaged(moves: DataFrame) -> list[np.ndarray]:
    """The mean move of each part's numbers, over the groups that changed them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, times = None, None, None

        def mean() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": pa.array([now], pa.int32()), "blob": pa.array([(total / np.maximum(times, 1)).astype(np.float32).tobytes()], pa.binary())})

        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != now:
                    if now is not None:
                        yield mean()
                    now, total, times = part, 0.0, 0
                move = from_planes(blob, np.float32)[0].astype(np.float64)
                total, times = total + move, times + (move != 0)
        if now is not None:
            yield mean()

    found = map_arrow(moves.repartitionById(SLICES + 1, F.col("part")).sortWithinPartitions("part", "g").select("part", "blob"), run, "part int, blob binary").collect()
    return [np.frombuffer(r["blob"], dtype=np.float32) for r in sorted(found, key=lambda r: r["part"])]


def whole_voters(counts: DataFrame) -> tuple[list[str], dict[bytes, np.ndarray]]:
    """What ``voters`` gives, from how many texts (n, in any number of rows) of each language have a word; the empty word counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[str, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                most.setdefault(lang, []).append((-n, word))
                if len(most[lang]) >= 50 * VOTERS:
                    most[lang] = sorted(most[lang])[:VOTERS]
        rows = [(lang, word, -n) for lang, own in most.items() for n, word in sorted(own)[:VOTERS]]
        yield pa.RecordBatch.from_pydict({"lang": pa.array([r[0] for r in rows], pa.string()), "word": pa.array([r[1] for r in rows], pa.binary()), "n": pa.array([r[2] for r in rows], pa.int64())})

    each = counts.where("word <> X''").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    tops = map_arrow(each, run, "lang string, word binary, n long").collect()  # each task's first VOTERS of each language, among which those of all are
    names = sorted({r["lang"] for r in tops} | {r["lang"] for r in counts.where("word = X''").select("lang").distinct().collect()})
    chosen = {bytes(r["word"]) for lang in names for r in sorted((r for r in tops if r["lang"] == lang), key=lambda r: (-r["n"], bytes(r["word"])))[:VOTERS]}
    picked = counts.sparkSession.createDataFrame([(w,) for w in [b"", *sorted(chosen)]], "word binary")
    seen, size = {w: np.zeros(len(names)) for w in chosen}, np.zeros(len(names))
    for r in counts.join(F.broadcast(picked), "word").groupBy("lang", "word").agg(F.sum("n").alias("n")).collect():
        (seen[bytes(r["word"])] if r["word"] else size)[names.index(r["lang"])] = r["n"]
    return names, weights(seen, size)


def log_odds(rows: DataFrame, net: Network) -> DataFrame:
    """y, z (the log-odds without shift, in steps) and lang (the guessed one's number) of labelled rows."""
    model = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        known = TokenTable(net.word_rows)
        for y, texts in merged(batches, 1_000_000):
            at, lengths = known.lookup([padded_tokens(t) for t in texts])
            z, lang = net.raw(known.matrix[at], lengths - PAD)
            z = np.rint(np.clip(z, -40, 40) * STEP).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"y": pa.array(y, pa.int32()), "z": pa.array(z), "lang": pa.array(lang.astype(np.int64))})

    return map_arrow(rows.select("y", "text"), run, "y int, z long, lang long")


def score_toxicity(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        known = TokenTable(net.word_rows)
        for ids, texts in merged(batches, 1_000_000):
            at, lengths = known.lookup([padded_tokens(t) for t in texts])
            score = net.score(known.matrix[at], lengths - PAD).astype(np.float64)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.float64())})

    scored = map_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double")
    return scored.select("doc_id", is_fold(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op7_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), fit(spark, sf_dir))
