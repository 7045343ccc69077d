"""Operator 1: SimHash near-duplicates through sharded BK-trees.

Fingerprints of at most three differing bits are linked. Distinct fingerprints are the
nodes, so any number of exact copies costs one node. By the pigeonhole principle two
linked fingerprints agree in at least two of five blocks of bits, hence in one of ten
pairs of blocks: each pair's value names a shard. The tree of a shard has its children
keyed by Hamming distance to the parent; a search follows only edges whose key is
within the radius of the query's own distance. Queries go down in arrays, and leaves
hold a few fingerprints each. A shard gives back a spanning set of links (no more than
its nodes), never all pairs.

A shard with more than ``PART`` nodes is split: its nodes are dealt to parts by a hash, and
the tree of each part is copied to the tasks of every pair of parts it is searched from. So no task
holds more than two parts, and every pair of nodes is still tested.

Components come from repeated min-label hooking and pointer jumping on the links between
distinct fingerprints, in DataFrame joins cut by checkpoints.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like any
other; fewer than three words are one shingle. Repeated rows are all returned. A null id
takes part in linking but never names a component; if a component has null ids only, its id is
null. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from nimbusframe.llm.common import forget, map_arrow, merged, saved, segment, table

#: Parameters: links differ in at most RADIUS bits; words in a shingle; blocks of bits; most nodes in one tree; leaf size.
RADIUS, SHINGLE, WIDTHS, PART, LEAF = 3, 3, (13, 13, 13, 13, 12), 4000, 48
#: Most keys of kept documents that are broadcast.
KEYS = 1_000_000


def shingle_hashes(text: str | None, size: int = SHINGLE) -> list[int]:
    """XXH64 (seed 42) of every shingle of the ASCII-lower-cased text; none without words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxh64_intdigest(joined, 42)]
    gaps = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    starts = [0, *(gaps[: len(words) - size] + 1).tolist()]
    ends = [*gaps[size - 1 :].tolist(), len(joined)]
    return [xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)]


def simhashes(texts: list[str | None], size: int = SHINGLE) -> np.ndarray:
    """Unsigned 64-bit fingerprints; a bit is set if it is set in over half of the shingle hashes."""
    out = np.zeros(len(texts), dtype=np.uint64)
    step, pending, lengths, first = 1 << 17, [], [], 0

    def flush(last: int) -> None:
        nonlocal pending, lengths, first
        if last > first:
            n = np.array(lengths, dtype=np.int64)
            hashes = np.array(pending, dtype=np.uint64)
            bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.uint32)
            ones = segment(np.add, bits, n)
            out[first:last] = np.packbits(ones * 2 > n[:, None], axis=1).view(">u8")[:, 0] if last > first else 0
        pending, lengths, first = [], [], last

    for i, t in enumerate(texts):
        h = shingle_hashes(t, size)
        if len(h) > step:  # a very long text is counted piece by piece
            flush(i)
            ones = sum(np.unpackbits(np.array(h[k : k + step], dtype=np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64) for k in range(0, len(h), step))
            out[i] = np.packbits(ones * 2 > len(h)).view(">u8")[0]
            first = i + 1
            continue
        if len(pending) + len(h) > step:
            flush(i)
        pending.extend(h)
        lengths.append(len(h))
    flush(len(texts))
    return out


def text_hashes(texts: list[str | None]) -> np.ndarray:
    """What xxhash64 gives for each text."""
    return np.array([42 if t is None else xxh64_intdigest(t.encode(), 42) for t in texts], dtype=np.uint64).view(np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and th (the text's hash) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in merged(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "fp": pa.array(simhashes(texts).view(np.int64), pa.int64()), "th": pa.array(text_hashes(texts))})

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, fp long, th long")


class BKTree:
    """A BK-tree over distinct 64-bit values; children are keyed by distance to the pivot."""

    def __init__(self, values: np.ndarray, at: np.ndarray | None = None, leaf: int = LEAF) -> None:
        at = np.arange(len(values)) if at is None else at
        self.at, self.values = at, values
        self.children: dict[int, BKTree] | None = None
        if len(at) > leaf:
            self.pivot = at[0]
            d = np.bitwise_count(values[at[1:]] ^ values[self.pivot])
            order = np.argsort(d, kind="stable")
            keys, starts = np.unique(d[order], return_index=True)
            groups = np.split(at[1:][order], starts[1:])
            if len(groups) > 1 or len(at) > 2 * leaf:
                self.children = {int(k): BKTree(values, g, leaf) for k, g in zip(keys, groups, strict=True)}

    def search(self, queries: np.ndarray, radius: int, which: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query numbers, value numbers) within the radius, in arrays."""
        stack = [(self, np.arange(len(queries)) if which is None else which)]
        while stack:
            node, q = stack.pop()
            if node.children is None:
                for k in range(0, len(q), 4096):
                    part = q[k : k + 4096]
                    hit_q, hit_v = np.nonzero(np.bitwise_count(queries[part][:, None] ^ node.values[node.at][None, :]) <= radius)
                    if len(hit_q):
                        yield part[hit_q], node.at[hit_v]
                continue
            d = np.bitwise_count(queries[q] ^ node.values[node.pivot]).astype(np.int64)
            near = q[d <= radius]
            if len(near):
                yield near, np.full(len(near), node.pivot)
            for key, child in node.children.items():
                follow = q[np.abs(d - key) <= radius]
                if len(follow):
                    stack.append((child, follow))


def spanning(values: np.ndarray, other: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever links within the radius connect.

    Among ``values`` alone, or from ``values`` to ``other``; at most one link for each node, to
    the root of its group.
    """
    every = values if other is None else np.concatenate([values, other])
    parent = np.arange(len(every))

    def hook(a: np.ndarray, b: np.ndarray) -> None:
        while True:
            while (np.take(parent, parent) != parent).any():
                parent[:] = np.take(parent, parent)
            x, y = parent[a], parent[b]
            diff = x != y
            if not diff.any():
                return
            a, b, x, y = a[diff], b[diff], x[diff], y[diff]
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))

    if other is None:
        for q, v in BKTree(values).search(values, radius):
            hook(q, v)
    else:
        for q, v in BKTree(values).search(other, radius):
            hook(q + len(values), v)
    child = np.flatnonzero(parent != np.arange(len(every)))
    return every[child], every[parent[child]]


def shard_links(nodes: DataFrame, radius: int = RADIUS, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """Links (a, b) between distinct fingerprints; ``nodes`` has the column fp. There are two more blocks than ``radius`` at least."""
    starts = [sum(widths[:k]) for k in range(len(widths))]
    block = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in zip(starts, widths, strict=True)]
    keys = [F.lit(n << 26).cast("long").bitwiseOR(F.shiftleft(block[i], 13)).bitwiseOR(block[j]) for n, (i, j) in enumerate(combinations(range(len(widths)), 2))]
    sharded = nodes.select("fp", F.explode(F.array(*keys)).alias("shard"))
    hot = sharded.groupBy("shard").count().where(F.col("count") > PART).select("shard", F.ceil(F.col("count") / PART).cast("int").alias("parts"))
    hot = saved(hot)  # at most nodes * 10 / PART rows
    cold = sharded.join(hot, "shard", "left_anti").select("shard", F.lit(0).alias("pa"), F.lit(0).alias("pb"), F.lit(False).alias("query"), "fp")
    mine = F.pmod(F.xxhash64("fp", "shard"), F.col("parts")).cast("int")
    split = sharded.join(hot, "shard").withColumn("mine", mine)
    pairs = split.select("shard", "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("its"))
    pairs = pairs.select("shard", F.least("mine", "its").alias("pa"), F.greatest("mine", "its").alias("pb"), (F.col("mine") > F.col("its")).alias("query"), "fp")
    dealt = cold.unionByName(pairs).repartition("shard", "pa", "pb").sortWithinPartitions("shard", "pa", "pb", "query")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(columns: list[np.ndarray]) -> pa.RecordBatch:
            shard, a, b, query, fp = columns
            change = np.flatnonzero((shard[1:] != shard[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            starts = np.concatenate([[0], change, [len(fp)]])
            left, right = [], []
            for k in np.flatnonzero(np.diff(starts) > 1):
                s, e = starts[k], starts[k + 1]
                values, asks = fp[s:e], query[s:e]
                if e - s == 2 and np.bitwise_count(values[0] ^ values[1]) > radius:
                    continue
                x, y = spanning(values, None, radius) if a[s] == b[s] else spanning(values[~asks], values[asks], radius)
                left.append(x)
                right.append(y)
            x = np.concatenate(left) if left else np.zeros(0, dtype=np.uint64)
            y = np.concatenate(right) if right else np.zeros(0, dtype=np.uint64)
            return pa.RecordBatch.from_pydict({"a": x.view(np.int64), "b": y.view(np.int64)})

        rest: list[np.ndarray] | None = None
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            new[4] = new[4].view(np.uint64)
            rest = new if rest is None else [np.concatenate(p) for p in zip(rest, new, strict=True)]
            if len(rest[0]) < 50_000:
                continue
            last = (rest[0] == rest[0][-1]) & (rest[1] == rest[1][-1]) & (rest[2] == rest[2][-1])
            whole = int(np.argmax(last))  # the last group may go on in the next batch
            if whole:
                yield links([c[:whole] for c in rest])
                rest = [c[whole:] for c in rest]
        if rest is not None and len(rest[0]):
            yield links(rest)

    return map_arrow(dealt.select("shard", "pa", "pb", "query", "fp"), run, "a long, b long")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """fp and root for each node that has a link: alternating large-star and small-star steps.

    Each step keeps the graph's components and no more edges than before; the process ends
    when the edges are stars around the smallest node of each component.
    """
    edges = saved(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        old, edges = edges, saved(small)
        forget(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("fp"), F.col("b").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    out = labelled(saved(fingerprints(docs)))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def labelled(fps: DataFrame, root: DataFrame | None = None) -> DataFrame:
    """``fps`` (doc_id and fp, saved) with component_id and the component's root; ``root`` has fp and root of linked fingerprints, those within RADIUS if it is not given."""
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    root = components(shard_links(nodes.select("fp"))) if root is None else root
    named = nodes.join(root, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    name = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels = named.join(name, "root").select("fp", "root", "component_id")
    return fps.join(labels, "fp")


def one_of_each(docs: DataFrame, exact: bool = False) -> DataFrame:
    """One document of each component, with all columns: the one with the smallest id.

    Components are those of op1 or, if ``exact``, of the shingle similarity in ``near_pairs``, which has candidates from SimHash and BK-trees too.

    A row with a null id stands behind all ids and is told apart by its text. Rows with one id and
    different texts count each for itself; rows repeated with id and text are reduced to the one whose columns have
    the smallest hash.
    """
    behind = F.lit(1 << 61) + F.xxhash64("text").bitwiseAND(F.lit((1 << 61) - 1))
    keyed = docs.withColumn("__key", F.coalesce(F.col("doc_id").cast("long"), behind, F.lit(1 << 62)))
    texts = keyed.select(F.col("__key").alias("doc_id"), "text")
    if exact:
        from nimbusframe.llm import near_pairs

        common = near_pairs.common_shingles(texts)
        wide = saved(near_pairs.prefixes(texts, common))
        fps = saved(wide.select("doc_id", "fp", "th", "sim"))
        labels = labelled(fps, near_pairs.roots(texts, wide, fps, common[0][common[1] >= near_pairs.MANY]))
    else:
        fps = saved(fingerprints(texts))
        labels = labelled(fps)
    keep = labels.where("doc_id = component_id").groupBy("root").agg(F.min("doc_id").alias("__key"), F.min("th").alias("__text")).drop("root").distinct()
    repeated = saved(fps.groupBy("doc_id", "th").count().where("count > 1").select(F.col("doc_id").alias("__key"), F.col("th").alias("__text")))
    both = ["__key", "__text"]
    keep = saved(keep)
    side = F.broadcast(keep) if keep.count() <= KEYS else keep  # 16 bytes a row; beyond that the texts travel
    kept = keyed.withColumn("__text", F.xxhash64("text")).join(side, both, "left_semi")
    if not repeated.isEmpty():  # only rows repeated with id and text meet in one place
        again = kept.join(repeated, both, "left_semi")
        first = again.groupBy(*both).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("__row")).select("__row.*")
        kept = kept.join(repeated, both, "left_anti").select(*docs.columns).unionByName(first)
    return kept.select(*docs.columns)


def op1_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
