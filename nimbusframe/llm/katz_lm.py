"""Operator 3: a Katz backoff language model of word pairs.

Good-Turing discounts counts up to five; what they free goes to pairs not seen, in proportion
to the lower order, through weights that make every context's distribution sum to one exactly.
The lower order is the add-half estimate of single words, in which all words never seen share one
place. Every word there is has contexts and counts of its own, however rare and whatever the corpus.

How it runs: one pass counts words, into a table by hash. Words of at least one in ``VOCABULARY``
training tokens (so at most a million) are numbered and broadcast; the others go by their hash, which
changes how they travel and not what the model is. A second pass turns documents
into packed blocks of (pair, row, times), written as a partitioned table; it is
counted once for the contexts' sums, and read again to score.
Pairs of numbered words are dealt by pair; their contexts' weights are summed over all blocks, one row a numbered word.
Pairs of two very common words (each one in ``HOT`` tokens or more) would crowd one block: they are dealt by row as well,
and their counts, no more than HOT * HOT, travel as a small table. A pair with a rare word is dealt by its first word
if that is rare, else by its second: so a block has all that follows a rare word, hence the word's count and its context's sums, and
what follows a numbered word meets its lower-order probability there. What remains is a pair of two rare words backed off, or a rare context
that has rare followers: those meet the words' counts in joins.
A row's parts are added up by a row number that is fixed when the blocks are written, so
repeated and null ids stay apart.

Defined cases: a null text is empty and has the end token alone. With no training rows every
count is zero. Where a discount formula is not defined (a missing count of counts) the share is
(r - 0.5) / r; a context without freed mass gives up 0.5 of a count. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from nimbusframe.llm.common import TokenTable, from_planes, is_fold, map_arrow, merged, planes, release, runs, saved, table

#: Parameters: words of one in so many tokens are numbered; pairs of words of one in HOT tokens are dealt by row;
#: discounts up to count CUT; entries in a block of documents; training tokens to a bucket of pairs; held-out fold.
VOCABULARY, HOT, CUT, BLOCK, BUCKET, FOLD = 1_000_000, 1000, 5, 1_500_000, 1_500_000, (5, 1)
END = b"\n"  # no word has white space


def hashes(tokens: list[bytes]) -> np.ndarray:
    """63 bits of each token's hash, as a negative number: numbers of words are not negative."""
    return np.array([xxh64_intdigest(t, 42) | 1 << 63 for t in tokens], dtype=np.uint64).view(np.int64)


def words(text: str | None) -> list[bytes]:
    return [*text.encode().lower().split(), END] if text else [END]


def count_words(docs: DataFrame) -> DataFrame:
    """h and c: how often each word stands in the training rows."""
    train = docs.where(~is_fold(F.col("doc_id"), *FOLD)).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = TokenTable(lambda t: hashes(t)[:, None])
        h, c = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"h": pa.array(h), "c": pa.array(c)})

        for _, texts in merged(batches):
            at, _ = known.lookup([words(t) for t in texts])
            times = np.bincount(at, minlength=len(known))
            some = np.flatnonzero(times)
            every, n = np.concatenate([h, known.matrix[some, 0]]), np.concatenate([c, times[some]])
            order = np.argsort(every, kind="stable")
            every, n = every[order], n[order]
            start = runs(every)
            h, c = every[start], np.add.reduceat(n, start)
            if len(h) > 1_000_000:
                yield out()
                h, c = h[:0], c[:0]
        if len(h):
            yield out()

    return saved(map_arrow(train, run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))


class Lower:
    """The numbered words, by hash, and the lower order. The number after the last stands for a text's start."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray, n: int, v: int) -> None:
        order = np.argsort(frequent)
        self.h, self.c, self.n, self.v = frequent[order], counts[order], n, v
        self.start, self.size = len(frequent), len(frequent) + 1
        self.d = n + 0.5 * (v + 1)
        self.p = np.append((self.c + 0.5) / self.d, 0.0)
        self.hot = np.append(self.c * HOT >= n, True) if n else np.zeros(self.size, dtype=bool)

    def ids(self, h: np.ndarray) -> np.ndarray:
        """A word's number or, of a rare word, its hash."""
        if not len(self.h):
            return h
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, at, h)

    def chance(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / self.d


def fit_lower(counts: DataFrame) -> Lower:
    n, v = counts.agg(F.sum("c"), F.count("*")).first()
    n = n or 0
    end = int(hashes([END])[0])  # has a number even if it is rare: it never stands first
    found = counts.where((F.col("c") * VOCABULARY >= n) | (F.col("h") == end)).toArrow()  # VOCABULARY rows at most, and one
    return Lower(found["h"].to_numpy(), found["c"].to_numpy(), n, v)


def mixed(key: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ salt) >> np.uint64(32)


def packed_by(bucket: np.ndarray, kind: int, first: int, low_row: int, keys: list[np.ndarray], at: np.ndarray, times: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """(kind, bucket, first, blob) of entries, for each bucket in the order of their keys, the first of which is stored in steps."""
    order = np.lexsort((*keys[::-1], bucket))
    bucket, at, times = bucket[order], at[order], times[order]
    keys = [k[order] for k in keys]
    edges = np.append(runs(bucket), len(bucket))
    return [
        (kind, int(bucket[s]), first + low_row, planes(np.diff(keys[0][s:e], prepend=0), *[k[s:e] for k in keys[1:]], (at[s:e] - low_row).astype(np.int32), times[s:e].astype(np.int32)))
        for s, e in zip(edges[:-1], edges[1:], strict=True)
    ]


def entries_of(owner: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct (owner, keys), and how often each is there."""
    order = np.lexsort((*keys[::-1], owner))
    sorted_ = [c[order] for c in (owner, *keys)]
    change = np.zeros(len(owner), dtype=bool)
    change[:1] = True
    for c in sorted_:
        change[1:] |= c[1:] != c[:-1]
    start = np.flatnonzero(change)
    return (*[c[start] for c in sorted_], np.diff(np.append(start, len(owner))))


def blocks(docs: DataFrame, lower: Lower, buckets: int) -> DataFrame:
    """One row for each document (kind 0), block of pairs (kinds 1 and 3, those with a rare word) and table of hot pairs' counts (kind 2)."""
    shared = docs.sparkSession.sparkContext.broadcast(lower)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = shared.value
        base_of = np.log10(low.chance(low.c))
        n_buckets = np.uint64(buckets)

        def rows(tokens: list[bytes]) -> np.ndarray:
            return low.ids(hashes(tokens))[:, None]

        known = TokenTable(rows)
        first = TaskContext.get().partitionId() << 40
        row = 0
        common: list[tuple[np.ndarray, ...]] = []
        rare: list[tuple[np.ndarray, ...]] = []

        def block_rows() -> pa.RecordBatch:
            nonlocal common, rare
            out: list[tuple[int, int, int, bytes]] = []
            at, pair, times = (np.concatenate(c) for c in zip(*common, strict=True))
            r_at, r_v, r_w, r_times = (np.concatenate(c) for c in zip(*rare, strict=True))
            common, rare = [], []
            if len(at):
                hot = low.hot[pair // low.size] & low.hot[pair % low.size]
                salt = np.where(hot, at.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0))
                out += packed_by((mixed(pair, salt) % n_buckets).astype(np.int64), 1, first, int(at.min()), [pair], at, times)
                some = hot & (times > 0)
                if some.any():
                    p, back = np.unique(pair[some], return_inverse=True)
                    out.append((2, 0, 0, zlib.compress(p.tobytes() + np.bincount(back, weights=times[some]).astype(np.int64).tobytes(), 1)))
            if len(r_at):
                out += packed_by((mixed(np.where(r_v < 0, r_v, r_w)) % n_buckets).astype(np.int64), 3, first, int(r_at.min()), [r_v, r_w], r_at, r_times)
            return frame(dict(zip(("kind", "bucket", "first", "blob"), map(list, zip(*out, strict=True)), strict=True)))

        def frame(columns: dict[str, list]) -> pa.RecordBatch:
            n = len(columns["kind"])
            types = {"kind": pa.int32(), "bucket": pa.int32(), "first": pa.int64(), "blob": pa.binary(), "doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64()}
            return pa.RecordBatch.from_pydict({k: pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in types.items()})

        size = 0
        for ids, texts in merged(batches, 4_000_000):
            at, lengths = known.lookup([words(t) for t in texts])
            owner = np.repeat(np.arange(len(ids)), lengths)
            word = known.matrix[at, 0]
            held = np.array([i is not None and zlib.crc32(str(i).encode()) % FOLD[0] == FOLD[1] for i in ids])
            numbered = word >= 0
            base = np.bincount(owner[numbered], weights=base_of[word[numbered]], minlength=len(ids))
            ones = np.ones(len(ids), dtype=np.int64)
            yield frame({
                "kind": (0 * ones).tolist(), "bucket": ((row + np.arange(len(ids))) % buckets).tolist(), "first": (first + row + np.arange(len(ids))).tolist(), "doc_id": ids, "held_out": held.tolist(),
                "n_tokens": lengths.tolist(), "n_known": np.bincount(owner[numbered], minlength=len(ids)).tolist(), "base": base.tolist(),
            })
            before = np.concatenate([[0], word[:-1]])
            before[np.cumsum(lengths) - lengths] = low.start
            both = numbered & (before >= 0)
            who, pair, times = entries_of(owner[both], before[both] * low.size + word[both])
            common.append((row + who, pair, np.where(held[who], -times, times)))
            r_who, v, w, r_times = entries_of(owner[~both], before[~both], word[~both])
            rare.append((row + r_who, v, w, np.where(held[r_who], -r_times, r_times)))
            row += len(ids)
            size += len(who) + len(r_who)
            if size >= BLOCK:
                yield block_rows()
                size = 0
        if size:
            yield block_rows()

    schema = "kind int, bucket int, first long, blob binary, doc_id long, held_out boolean, n_tokens long, n_known long, base double"
    made = map_arrow(docs.select("doc_id", "text"), run, schema)
    return saved(made.repartitionById(buckets, "bucket").sortWithinPartitions("kind", "bucket"))


class Entries:
    """Everything in a bucket of one kind: the types (their first key and, of pairs with a rare word, their second) with their training counts,
    each entry's type, row in its block and times, blob after blob, and where each blob ends."""

    def __init__(self, blobs: list[tuple[int, bytes]], rare: bool) -> None:
        kinds = (np.int64, np.int64, np.int32, np.int32) if rare else (np.int64, np.int32, np.int32)
        parts = [from_planes(b, *kinds) for _, b in blobs]
        columns = [np.concatenate(c) for c in zip(*([np.cumsum(x[0]), *x[1:]] for x in parts), strict=True)] or [np.zeros(0, dtype=k) for k in kinds]
        *keys, self.row, times = columns
        order = np.lexsort(keys[::-1])
        change = np.zeros(len(order), dtype=bool)
        change[:1] = True
        for k in keys:
            change[1:] |= k[order[1:]] != k[order[:-1]]
        self.type_of = np.empty(len(order), dtype=np.int64)
        self.type_of[order] = np.cumsum(change) - 1
        self.keys = [k[order[change]] for k in keys]
        self.counts = np.bincount(self.type_of, weights=np.maximum(times, 0), minlength=int(change.sum())).astype(np.int64)
        self.times, self.held = np.abs(times), times < 0
        self.first = np.array([f for f, _ in blobs], dtype=np.int64)
        self.edges = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])]).astype(np.int64)

    def sums(self, *values: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
        """For each blob its number and, packed, the rows and the values' sums over each row."""
        for k, first in enumerate(self.first.tolist()):
            own = slice(self.edges[k], self.edges[k + 1])
            totals = [np.bincount(self.row[own], weights=x[own]) for x in values]
            some = np.unique(self.row[own])
            yield first, [some.astype(np.int32), *[t[some] for t in totals]]


class RareWords:
    """Of the pairs with a rare word in a bucket: the rare words that stand first there, all their followers and so their counts."""

    def __init__(self, e: Entries) -> None:
        self.v, self.w = e.keys
        self.inner = self.v < 0
        self.words, self.at = np.unique(self.v[self.inner], return_inverse=True)
        self.counts = np.bincount(self.at, weights=e.counts[self.inner], minlength=len(self.words)).astype(np.int64)

    def count(self, w: np.ndarray) -> np.ndarray:
        """Training count of rare words that are dealt to this bucket."""
        if not len(self.words):
            return np.zeros(len(w), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.words, w), len(self.words) - 1)
        return np.where(self.words[at] == w, self.counts[at], 0)


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """The kind and the blobs of each bucket and kind; the rows come sorted by kind and bucket."""
    now, blobs = None, []
    for batch in batches:
        for bucket, first, blob, kind in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if (kind, bucket) != now and blobs:
                yield now[0], blobs
                blobs = []
            now = kind, bucket
            blobs.append((first, blob))
    if blobs:
        yield now[0], blobs


def context_parts(v: np.ndarray, counts: np.ndarray, chance: np.ndarray) -> pa.RecordBatch:
    """Per context: types of count 1 to CUT + 1, mass above CUT, and the seen words' lower-order mass."""
    seen = counts > 0
    v, c, p = v[seen], counts[seen], chance[seen]
    ctx, back = np.unique(v, return_inverse=True)
    columns = {"v": pa.array(ctx, pa.int64())}
    for r in range(1, CUT + 2):
        columns[f"n{r}"] = pa.array(np.bincount(back[c == r], minlength=len(ctx)), pa.int64())
    columns["above"] = pa.array(np.bincount(back, weights=np.where(c > CUT, c, 0), minlength=len(ctx)).astype(np.int64), pa.int64())
    columns["lower"] = pa.array(np.bincount(back, weights=p, minlength=len(ctx)), pa.float64())
    return pa.RecordBatch.from_pydict(columns)


def discounts(n: np.ndarray) -> np.ndarray:
    """Katz's factor for counts 0 to CUT (index 0 unused) from the counts of counts n[1..CUT + 1]."""
    d = np.array([1.0] + [(r - 0.5) / r for r in range(1, CUT + 1)])
    if n[1] > 0:
        tail = (CUT + 1) * n[CUT + 1] / n[1]
        for r in range(1, CUT + 1):
            if n[r] > 0 and tail < 1:
                x = ((r + 1) * n[r + 1] / n[r] / r - tail) / (1 - tail)
                if 0 < x <= 1:
                    d[r] = x
    return d


class Contexts:
    """Total, factor on seen pairs and backoff weight of each numbered context; row -1 of the sums is that of all rare contexts."""

    def __init__(self, rows: dict[str, np.ndarray], low: Lower) -> None:
        self.d = discounts(np.array([0] + [int(rows[f"n{r}"].sum()) for r in range(1, CUT + 2)], dtype=np.float64))
        self.total, self.scale, self.alpha = np.zeros(low.size), np.ones(low.size), np.ones(low.size)
        rows = {k: x[rows["v"] >= 0] for k, x in rows.items()}
        v = rows["v"]
        small = sum(r * rows[f"n{r}"] for r in range(1, CUT + 1))
        total = (small + rows["above"]).astype(np.float64)
        mass = (sum(self.d[r] * r * rows[f"n{r}"] for r in range(1, CUT + 1)) + rows["above"]) / total
        open_ = 1 - rows["lower"]
        full, tight = open_ < 1e-9, 1 - mass < 1e-9
        scale = np.where(full, 1 / mass, np.where(tight, total / (total + 0.5), 1.0))
        self.total[v], self.scale[v] = total, scale
        self.alpha[v] = np.where(full, 0.0, (1 - mass * scale) / np.where(full, 1.0, open_))

    def factor(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts <= CUT, self.d[np.minimum(counts, CUT)], 1.0)

    def log10(self, v: np.ndarray, counts: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """Of pairs with the numbered contexts ``v``; ``chance`` is the second word's in the lower order."""
        with np.errstate(divide="ignore"):
            return np.log10(np.where(counts > 0, self.factor(counts) * counts / np.maximum(self.total[v], 1) * self.scale[v], self.alpha[v] * chance))


def score_rare(e: Entries, low: Lower, ctx: Contexts) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Score, base score and number of known words of each entry with a rare word, and what has to meet other buckets' counts.

    Those requests have a kind: 10, a rare context v with its freed mass x and 1 less its numbered followers' lower-order mass, y; 11, one of its rare
    followers w; 12, an entry to score (row, times): from context v (null: one never seen) to the rare word w, or to a numbered one with the logarithm x."""
    rare = RareWords(e)
    v, w, c, inner = rare.v, rare.w, e.counts, rare.inner
    logs = np.zeros(len(v))
    outer = ~inner
    logs[outer] = ctx.log10(v[outer], c[outer], low.chance(rare.count(w[outer])))
    # Contexts that are rare words.
    at, own_c, follower = rare.at, c[inner], w[inner]
    total = rare.counts.astype(np.float64)
    k = len(total)
    mass = np.bincount(at, weights=ctx.factor(own_c) * own_c, minlength=k) / np.maximum(total, 1)
    scale = np.where((total > 0) & (1 - mass < 1e-9), total / (total + 0.5), 1.0)
    numbered = follower >= 0
    chance = np.where(numbered, low.p[np.maximum(follower, 0)], 0.0)
    seen = own_c > 0
    open_ = 1 - np.bincount(at, weights=np.where(seen, chance, 0.0), minlength=k)
    free = np.where(total > 0, 1 - mass * scale, 1.0)
    waits = np.bincount(at, weights=seen & ~numbered, minlength=k) > 0  # has rare followers, whose chances are elsewhere
    here = seen | (numbered & ~waits[at])
    with np.errstate(divide="ignore"):
        p = np.where(seen, ctx.factor(own_c) * own_c / np.maximum(total[at], 1) * scale[at], free[at] / open_[at] * chance)
        logs[inner] = np.where(here, np.log10(np.where(here, p, 1.0)), 0.0)
    # Requests.
    pending = np.zeros(len(v), dtype=bool)
    pending[inner] = ~here
    asks = np.flatnonzero(pending[e.type_of])
    kinds = e.type_of[asks]
    place = np.zeros(len(v), dtype=np.int64)
    place[inner] = at
    asked = np.zeros(k, dtype=bool)
    asked[place[kinds]] = True
    asked &= total > 0
    with np.errstate(divide="ignore"):
        log_chance = np.log10(np.where(w[kinds] >= 0, low.p[np.maximum(w[kinds], 0)], 1.0))
    first = np.repeat(e.first, np.diff(e.edges))
    lists = np.flatnonzero(asked[at] & seen & ~numbered)
    some = np.flatnonzero(asked)
    n = len(some), len(lists), len(asks)
    null = np.zeros
    requests = {
        "kind": np.repeat([10, 11, 12], n), "v": np.concatenate([rare.words[some], rare.words[at[lists]], np.where(total[place[kinds]] > 0, v[kinds], 0)]).astype(np.int64),
        "w": np.concatenate([null(n[0], dtype=np.int64), follower[lists], np.where(w[kinds] < 0, w[kinds], 0)]).astype(np.int64),
        "x": np.concatenate([free[some], null(n[1]), log_chance]), "y": np.concatenate([open_[some], null(n[1]), null(n[2])]),
        "first": np.concatenate([null(n[0] + n[1], dtype=np.int64), first[asks] + e.row[asks]]).astype(np.int64), "times": np.concatenate([null(n[0] + n[1], dtype=np.int64), e.times[asks]]),
    }
    # Each occurrence of a rare word stands first in one pair.
    own = np.zeros(len(v), dtype=np.int64)
    own[inner] = rare.counts[at]
    base = np.where(inner, np.log10(low.chance(own)), 0.0)
    return logs[e.type_of] * e.times, base[e.type_of] * e.times, (inner & (own > 0))[e.type_of] * e.times, requests


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = docs.sparkSession
    counts = count_words(docs)
    low = fit_lower(counts)
    n_buckets = max(8, low.n // BUCKET)
    made = blocks(docs, low, n_buckets)
    release(spark)
    pairs = made.where("kind = 1 or kind = 3").select("bucket", "first", "blob", "kind")

    # Hot pairs' training counts: at most HOT * HOT numbers.
    def open_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                x = np.frombuffer(zlib.decompress(blob), dtype=np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_pydict({"pair": pa.array(x[0]), "c": pa.array(x[1])})

    hot = map_arrow(made.where("kind = 2").select("blob"), open_hot, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).orderBy("pair").toArrow()
    shared = spark.sparkContext.broadcast((low, hot["pair"].to_numpy(), hot["c"].to_numpy()))

    def hot_at(types: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low, pair, c = shared.value
        is_hot = low.hot[types // low.size] & low.hot[types % low.size]
        at = np.minimum(np.searchsorted(pair, types), max(len(pair) - 1, 0))
        known = is_hot & (pair[at] == types) if len(pair) else np.zeros(len(types), dtype=bool)
        return is_hot, known, (c[at] if len(pair) else np.zeros(len(types), dtype=np.int64))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = shared.value[0]
        for kind, blobs in by_bucket(batches):
            e = Entries(blobs, kind == 3)
            if kind == 1:
                types = e.keys[0]
                cold = ~hot_at(types)[0]
                yield context_parts(types[cold] // low.size, e.counts[cold], low.p[types[cold] % low.size])
            else:
                rare = RareWords(e)
                chance = np.where(rare.inner, 0.0, low.chance(rare.count(rare.w)))
                yield context_parts(np.where(rare.inner, -1, rare.v), e.counts, chance)

    fields = [f"n{r}" for r in range(1, CUT + 2)] + ["above", "lower"]
    schema = "v long, " + ", ".join(f"{f} {'double' if f == 'lower' else 'long'}" for f in fields)
    part = map_arrow(pairs, contexts, schema)
    own = context_parts(hot["pair"].to_numpy() // low.size, hot["c"].to_numpy(), low.p[hot["pair"].to_numpy() % low.size])
    part = part.unionByName(spark.createDataFrame(pa.Table.from_batches([own]))) if own.num_rows else part
    found = part.groupBy("v").agg(*[F.sum(f).alias(f) for f in fields]).toArrow()  # at most VOCABULARY rows and two
    ctx = spark.sparkContext.broadcast(Contexts({f: found[f].to_numpy() for f in ["v", *fields]}, low))
    types = {"kind": pa.int32(), "first": pa.int64(), "blob": pa.binary(), "v": pa.int64(), "w": pa.int64(), "x": pa.float64(), "y": pa.float64(), "times": pa.int32()}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def frame(columns: dict, n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({k: pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in types.items()})

        low = shared.value[0]
        for kind, blobs in by_bucket(batches):
            e = Entries(blobs, kind == 3)
            if kind == 1:
                pair, c = e.keys[0], e.counts
                is_hot, known, hot_c = hot_at(pair)
                c = np.where(is_hot, np.where(known, hot_c, 0), c)
                values = [ctx.value.log10(pair // low.size, c, low.p[pair % low.size])[e.type_of] * e.times]
            else:
                *values, requests = score_rare(e, low, ctx.value)
                yield frame(requests, len(requests["kind"]))
            sums = list(e.sums(*values))
            yield frame({"kind": [kind] * len(sums), "first": [f for f, _ in sums], "blob": [planes(*c) for _, c in sums]}, len(sums))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(block: int, total: np.ndarray) -> pa.RecordBatch:
            some = np.flatnonzero(total.any(axis=1))
            return pa.RecordBatch.from_pydict({"first": pa.array(block + some), "part": pa.array(total[some, 0]), "more": pa.array(total[some, 1]), "known": pa.array(total[some, 2].astype(np.int64))})

        block, total = None, np.zeros((0, 3))
        for batch in batches:
            for first, kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if first != block:
                    if block is not None:
                        yield rows(block, total)
                    block, total = first, np.zeros((0, 3))
                at, *parts = from_planes(blob, np.int32, *[np.float64] * kind)
                if at[-1] >= len(total):
                    total = np.concatenate([total, np.zeros((at[-1] + 1 - len(total), 3))])
                for k, part in enumerate(parts):
                    total[at, k] += part
        if block is not None:
            yield rows(block, total)

    scored = saved(map_arrow(pairs, score, "kind int, first long, blob binary, v long, w long, x double, y double, times int"))
    packed = scored.where("kind <= 3").select("first", "kind", "blob").repartition("first").sortWithinPartitions("first")
    parts = map_arrow(packed, add_up, "first long, part double, more double, known long")
    sums = parts.unionByName(backed_off(scored, counts, low.d)).groupBy("first").agg(F.sum("part").alias("score"), F.sum("more").alias("more"), F.sum("known").alias("known"))
    each = made.where("kind = 0").select("first", "doc_id", "held_out", "n_tokens", "n_known", "base")
    out = each.join(sums, "first", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(low.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def backed_off(scored: DataFrame, counts: DataFrame, d: float) -> DataFrame:
    """first, part, more and known of the entries that ``score_rare`` could not score in their bucket."""
    chance = (F.coalesce("c", F.lit(0)) + 0.5) / d
    lists = scored.where("kind = 11").select("v", F.col("w").alias("h")).join(counts, "h", "left").groupBy("v").agg(F.sum(chance).alias("elsewhere"))
    weights = scored.where("kind = 10").select("v", "x", "y").join(lists, "v", "left")
    weights = weights.select("v", F.log10(F.col("x") / (F.col("y") - F.coalesce("elsewhere", F.lit(0.0)))).alias("weight"))
    asks = scored.where("kind = 12").select("first", "times", "x", "v", F.col("w").alias("h"))
    zero = F.lit(0.0).alias("weight")  # a context never seen; such rows have no key to join on and would meet in one task
    asks = asks.where("v <> 0").join(weights, "v").drop("v").unionByName(asks.where("v = 0").select("first", "times", "x", "h", zero))
    with_word = asks.where("h <> 0").join(counts, "h", "left").withColumn("x", F.log10(chance)).select("first", "times", "x", "weight")
    asks = with_word.unionByName(asks.where("h = 0").select("first", "times", "x", "weight"))
    logs = F.col("x") + F.col("weight")
    return asks.select("first", (logs * F.col("times")).alias("part"), F.lit(0.0).alias("more"), F.lit(0).cast("long").alias("known"))


def op3_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
