"""Near-duplicates by exact similarity of shingle sets: texts whose sets of five-word shingles have a Jaccard index of 0.8 or more are linked.

Candidates come first from SimHash: the fingerprints of the shingle sets go through the sharded BK-trees of
operator 1, with a wider radius, and the pairs they propose are verified on the whole sets and link. No radius can promise
to propose every pair of that similarity, so an exact check follows for texts that are still apart: a prefix filter. All shingles have one order, the same in every text; two
sets of similarity t or more have a shingle in common among the first n - ceil(t * n) + 1 of each. So
no linked pair is missed whatever the order. The order puts shingles that several sets of the whole corpus have last, which
keeps passages that texts quote out of the prefixes; only the speed depends on it. Candidates
are verified on the whole sets before they link.

Distinct sets are the nodes, so any number of copies costs one node. The prefixes' entries travel
packed, once, to buckets of shingles, and only entries of shingles that several nodes have go further; those of
shingles found in very many sets are not gathered. Where a shingle is in the
prefixes of at most ``SMALL`` nodes all their pairs are candidates. In larger groups a few nodes,
the pivots, are paired with the others first; nodes that are linked by then need no further pairs, and the
rest meets ``GROW`` times as many pivots in the next round, until every group is in one component
or every node has been a pivot.

Defined cases: null, empty and blank texts have the empty set, which equals only itself; fewer than
five words are one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from nimbusframe.llm.common import forget, from_planes, map_arrow, merged, planes, runs, saved
from nimbusframe.llm.simhash_dedup import components, shard_links, shingle_hashes, text_hashes

#: Parameters: words in a shingle; least similarity as a fraction; largest group of which all pairs are candidates;
#: pivots of the first round and their growth; shingles that the order puts last, how many sets they have at least, and from how many on they are not gathered.
SHINGLE, LEAST, SMALL, PIVOTS, GROW, COMMON, FEW, MANY = 5, (4, 5), 24, 4, 32, 500_000, 5, 200
#: Fingerprints of sets differ in at most RADIUS bits to be proposed; blocks of bits, of which those share two.
RADIUS, WIDTHS = 5, (10, 9, 9, 9, 9, 9, 9)
#: For the order, shingles are told apart by their first bits, and the sets that have one by so many bits of a hash.
OWN_BITS, SET_BITS, TALLY = 44, 8, 1_000_000
#: Entries in a block of documents, in a bucket of shingles and in an Arrow batch; most partitions of buckets; most documents, 16 bytes each, whose keys are broadcast to fetch their sets.
BLOCK, BUCKET, BATCH, PARTS, ASKED = 250_000, 200_000, 16_384, 20_000, 1_000_000
#: Characters of texts that a worker holds at a time.
CHARS = 500_000


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted, as signed longs."""
    return np.unique(np.array(shingle_hashes(text, SHINGLE), dtype=np.uint64).view(np.int64))


def set_fingerprint(shingles: np.ndarray) -> int:
    """The SimHash of a set: a bit is 1 if it is set in over half of the shingle hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(shingles), 1 << 17):
        ones += np.unpackbits(shingles[k : k + (1 << 17)].astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(shingles)).view(">i8")[0])


def heads(shingles: np.ndarray) -> np.ndarray:
    """The first bits of shingles, as longs in the shingles' unsigned order."""
    return (shingles.view(np.uint64) >> np.uint64(64 - OWN_BITS)).view(np.int64)


def within(values: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value stands in the sorted array, and whether it does."""
    at = np.minimum(np.searchsorted(among, values), max(len(among) - 1, 0))
    return at, among[at] == values if len(among) else np.zeros(len(values), dtype=bool)


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Heads of shingles that at least FEW different sets of all documents have, sorted, and in how many.

    Each shingle travels with SET_BITS of its set's hash, so copies count once wherever they are and
    counts saturate. Where more than COMMON shingles are found those of the most sets are taken, at random within the last count."""
    parts_bits = np.uint64(OWN_BITS - 32)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(8, chars // 5 // TALLY)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        size = 0

        def block() -> pa.RecordBatch:
            found = np.unique(np.concatenate(waiting))
            bucket = ((found >> (np.uint64(SET_BITS) + parts_bits)) * np.uint64(buckets)) >> np.uint64(32)
            edges = np.append(runs(bucket), len(bucket))
            blobs = [planes(np.diff(found[s:e], prepend=np.uint64(0))) for s, e in zip(edges[:-1], edges[1:], strict=True)]
            return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[edges[:-1]].astype(np.int32)), "blob": pa.array(blobs, pa.binary())})

        for _, texts in merged(batches, CHARS):
            for t in texts:
                own = shingle_set(t)
                key = np.uint64(xxh64_intdigest(own.tobytes(), 42) >> (64 - SET_BITS))
                waiting.append((heads(own).view(np.uint64) << np.uint64(SET_BITS)) | key)
                size += len(own)
                if size >= BLOCK:
                    yield block()
                    waiting, size = [], 0
        if size:
            yield block()

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counts(blobs: list[bytes]) -> pa.RecordBatch:
            head = np.unique(np.concatenate([np.cumsum(from_planes(b, np.uint64)[0], dtype=np.uint64) for b in blobs])) >> np.uint64(SET_BITS)
            start = runs(head)
            n = np.diff(np.append(start, len(head)))
            some = n >= FEW
            return pa.RecordBatch.from_pydict({"h": pa.array(head[start][some].view(np.int64)), "c": pa.array(n[some].astype(np.int32))})

        now, blobs = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != now and blobs:
                    yield counts(blobs)
                    blobs = []
                now = bucket
                blobs.append(blob)
        if blobs:
            yield counts(blobs)

    parts = min(buckets, PARTS)
    dealt = map_arrow(docs.select("doc_id", "text"), pack, "bucket int, blob binary").repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket")
    found = saved(map_arrow(dealt, tally, "h long, c int"))
    room, least, share = COMMON, 1 << SET_BITS, 1.0
    for c, n in sorted(((r["c"], r["n"]) for r in found.groupBy("c").agg(F.count("*").alias("n")).collect()), reverse=True):  # no more rows than SET_BITS allow
        least, share = c, min(1.0, room / n)
        room -= n
        if room <= 0:
            break
    place = F.pmod(F.xxhash64("h", F.lit("order")), F.lit(1 << 30))
    taken = found.where((F.col("c") > least) | ((F.col("c") == least) & (place < int(share * (1 << 30)) + 1))).toArrow()
    forget(found)
    h, c = taken["h"].to_numpy(), taken["c"].to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def prefixes(docs: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, fp (a hash of the shingle set), th (the text's), n (its size), the set's SimHash and its prefix in the common order, of every document.

    A task gives the SimHash and the prefix of a set once; further copies there have null."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, times = shared.value
        seen: set[int] = set()
        for ids, texts in merged(batches, CHARS):
            if len(seen) > 1_000_000:
                seen.clear()
            fp, sizes, sims, first = [], [], [], []
            for t in texts:
                own = shingle_set(t)
                n, key = len(own), xxh64_intdigest(own.tobytes(), 42)
                fp.append(key)
                sizes.append(n)
                if key in seen:
                    first.append(None)
                    sims.append(None)
                    continue
                seen.add(key)
                sims.append(set_fingerprint(own))
                if len(common) and n:
                    at, known = within(heads(own), common)
                    own = own[np.argsort(np.where(known, times[at], 0), kind="stable")]
                first.append(own[: n - -(-LEAST[0] * n // LEAST[1]) + 1] if n else own)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64()), "fp": pa.array(np.array(fp, dtype=np.uint64).view(np.int64)), "n": pa.array(sizes, pa.int32()),
                "th": pa.array(text_hashes(texts)), "sim": pa.array(sims, pa.int64()), "prefix": pa.array(first, pa.list_(pa.int64())),
            })

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, fp long, n int, th long, sim long, prefix array<long>")


def packed(fps: DataFrame, common: np.ndarray, buckets: int) -> DataFrame:
    """The prefixes' entries (shingle, fp, n, place) in packed blocks by bucket of shingle: bucket, hot, blob.

    Entries of shingles whose heads are in ``common`` are marked as hot and dealt by block, as no task could hold all entries of one of them."""
    shared = fps.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        waiting: list[tuple[np.ndarray, ...]] = []
        size = 0
        turn = TaskContext.get().partitionId()

        def block() -> pa.RecordBatch:
            nonlocal waiting, turn
            sh, fp, n, pos = (np.concatenate(c) for c in zip(*waiting, strict=True))
            waiting = []
            turn += 1
            hot = within(heads(sh), common)[1]
            ranges = ((sh.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            bucket = np.where(hot, -1, ranges.astype(np.int64))  # neighbours by value: their differences pack well
            order = np.lexsort((sh, bucket))
            sh, fp, n, pos, bucket = sh[order], fp[order], n[order], pos[order], bucket[order]
            edges = np.append(runs(bucket), len(bucket))
            blobs = [planes(np.diff(sh[s:e], prepend=0), fp[s:e], n[s:e], pos[s:e]) for s, e in zip(edges[:-1], edges[1:], strict=True)]
            own = bucket[edges[:-1]]
            return pa.RecordBatch.from_pydict({"bucket": pa.array(np.where(own < 0, turn % buckets, own), pa.int32()), "hot": pa.array(own < 0), "blob": pa.array(blobs, pa.binary())})

        for batch in batches:
            lists = batch.column(2).drop_null()
            lengths = np.diff(lists.offsets.to_numpy())
            if not lengths.sum():
                continue
            keep = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            fp, n = (np.repeat(batch.column(k).to_numpy()[keep], lengths) for k in (0, 1))
            starts = np.cumsum(lengths) - lengths
            waiting.append((lists.flatten().to_numpy(), fp, n, (np.arange(len(fp)) - np.repeat(starts, lengths)).astype(np.int32)))
            size += len(fp)
            if size >= BLOCK:
                yield block()
                size = 0
        if waiting:
            yield block()

    return map_arrow(fps.select("fp", "n", "prefix"), run, "bucket int, hot boolean, blob binary")


def shared_entries(fps: DataFrame, common: np.ndarray) -> DataFrame:
    """fp, n, pos, sh and m, the number of nodes, of each entry whose shingle is in the prefixes of several nodes."""
    total = fps.agg(F.sum(F.when(F.col("prefix").isNotNull(), F.size("prefix")))).first()[0] or 0
    buckets = max(8, total // BUCKET)
    parts = min(buckets, PARTS)
    dealt = packed(fps, common, buckets).repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("hot", "bucket")
    kinds = (np.int64, np.int64, np.int32, np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(blobs: list[bytes], hot: bool) -> Iterator[pa.RecordBatch]:
            sh, fp, n, pos = (np.concatenate(c) for c in zip(*[(np.cumsum(x[0]), *x[1:]) for x in (from_planes(b, *kinds) for b in blobs)], strict=True))
            blobs.clear()
            order = np.lexsort((fp, sh))
            sh, fp = sh[order], fp[order]
            new = np.concatenate([[True], (sh[1:] != sh[:-1]) | (fp[1:] != fp[:-1])])  # a set met in several tasks counts once
            sh, fp, n, pos = sh[new], fp[new], n[order][new], pos[order][new]
            start = runs(sh)
            m = np.repeat(np.diff(np.append(start, len(sh))), np.diff(np.append(start, len(sh))))
            some = np.arange(len(sh)) if hot else np.flatnonzero(m > 1)
            for k in range(0, len(some), BATCH):
                at = some[k : k + BATCH]
                yield pa.RecordBatch.from_pydict({"fp": pa.array(fp[at]), "n": pa.array(n[at]), "pos": pa.array(pos[at]), "sh": pa.array(sh[at]), "m": pa.array(m[at], pa.int64()), "hot": pa.array(np.full(len(at), hot))})

        now, blobs = None, []
        for batch in batches:
            for bucket, hot, blob in zip(*batch.columns, strict=True):
                bucket, hot, blob = bucket.as_py(), hot.as_py(), blob.as_py()
                if hot:
                    yield from rows([blob], True)
                    continue
                if bucket != now and blobs:
                    yield from rows(blobs, False)
                    blobs = []
                now = bucket
                blobs.append(blob)
        if blobs:
            yield from rows(blobs, False)

    found = saved(map_arrow(dealt, run, "fp long, n int, pos int, sh long, m long, hot boolean"))
    hot = found.where("hot").dropDuplicates(["sh", "fp"]).drop("m", "hot")
    many = F.broadcast(hot.groupBy("sh").agg(F.count("*").alias("m")).where("m > 1"))  # hardly more rows than COMMON
    return found.where("not hot").drop("hot").unionByName(hot.join(many, "sh"))


def shingle_sets(docs: DataFrame) -> DataFrame:
    """fp and the whole shingle set of every document, each set once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, texts in merged(batches, CHARS):
            own: dict[int, np.ndarray] = {}
            for s in map(shingle_set, texts):
                key = xxh64_intdigest(s.tobytes(), 42)
                if key not in seen:
                    own[key] = s
            seen = set(own) if len(seen) > 1_000_000 else seen.union(own)
            yield pa.RecordBatch.from_pydict({"fp": pa.array(np.array(list(own), dtype=np.uint64).view(np.int64)), "own": pa.array(list(own.values()), pa.list_(pa.int64()))})

    sets = saved(map_arrow(docs.select("doc_id", "text"), run, "fp long, own array<long>"))
    again = sets.groupBy("fp").count().where("count > 1")  # rows repeated in several tasks; only then the sets travel
    if again.isEmpty():
        return sets
    once = saved(sets.dropDuplicates(["fp"]))
    forget(sets)
    return once


def matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b, low and high (the lesser and the greater size), rest and m of each prefix shingle that nodes of fitting size share.

    No more common shingles than ``rest`` follow on either side, this one included. Pairs of small groups come once."""
    t, u = LEAST
    x = left.select("sh", *[F.col(c).alias(f"x_{c}") for c in left.columns if c != "sh"])
    y = right.select("sh", *[F.col(c).alias(f"y_{c}") for c in right.columns if c != "sh"])
    both = x.join(y, "sh").where(F.when(F.col("x_m") <= SMALL, F.col("x_fp") < F.col("y_fp")).otherwise(F.col("x_fp") != F.col("y_fp")))
    if "root" in left.columns:
        both = both.where("x_root <> y_root")
    both = both.where(F.least("x_n", "y_n") * u >= F.greatest("x_n", "y_n") * t)
    return both.select(
        F.least("x_fp", "y_fp").alias("a"), F.greatest("x_fp", "y_fp").alias("b"), F.least("x_n", "y_n").alias("low"), F.greatest("x_n", "y_n").alias("high"),
        F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos")).alias("rest"), F.col("x_m").alias("m"),
    )


def near_enough(most: Column) -> Column:
    """Whether sets of the sizes low and high may be similar enough if they have no more than ``most`` shingles in common."""
    t, u = LEAST
    return most * (t + u) >= (F.col("low") + F.col("high")) * t


def first_candidates(entries: DataFrame, pivots: int) -> DataFrame:
    """Distinct pairs (a, b) that share a shingle of a small group, or one of a larger group with a pivot, and may be similar enough.

    What two sets have in common is in both prefixes, or behind the prefix that ends first. So they have no more in common than
    their matches in small groups, the fewer of their shingles in larger groups, and the longer of what follows their prefixes."""
    t, u = LEAST
    small = F.col("m") <= SMALL
    met = matches(entries.where(small | (F.col("prio") < pivots)), entries).groupBy("a", "b")
    met = met.agg(F.max("low").alias("low"), F.max("high").alias("high"), F.max("rest").alias("rest"), F.count(F.when(small, 1)).alias("c"))
    met = met.where(near_enough(F.col("rest")))
    large = entries.where(~small).groupBy("fp").agg(F.count("*").alias("k"))
    for side in ("a", "b"):
        met = met.join(large.select(F.col("fp").alias(side), F.col("k").alias(f"k_{side}")), side, "left")
    behind = F.ceil(F.col("high") * t / u) - 1
    return met.where(near_enough(F.col("c") + F.least(F.coalesce("k_a", F.lit(0)), F.coalesce("k_b", F.lit(0))) + behind)).select("a", "b")


def next_candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of nodes in different components that share a shingle of a larger group and may be similar enough."""
    return matches(left, right).where(near_enough(F.col("rest"))).select("a", "b").distinct()


def verified(pairs: DataFrame, docs: DataFrame, fps: DataFrame) -> DataFrame:
    """The pairs whose whole sets are similar enough, saved."""
    t, u = LEAST
    asked = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    one = fps.join(asked, "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("doc_id", "th")).alias("one"))
    one = saved(one.select("one.*").distinct())
    side = F.broadcast(one) if one.count() <= ASKED else one
    sets = shingle_sets(docs.withColumn("th", F.xxhash64("text")).join(side, ["doc_id", "th"], "left_semi"))
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("own").alias("y")), "b")
    links = saved(both.where(F.size(F.array_intersect("x", "y")) * (t + u) >= (F.size("x") + F.size("y")) * t).select("a", "b"))
    forget(sets)
    return links


def simhash_candidates(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose SimHashes the BK-trees link, no more than nodes and links of a spanning set; ``fps`` has fp and sim."""
    nodes = saved(fps.where("sim is not null").select("fp", "sim").distinct())
    named = nodes.groupBy("sim").agg(F.min("fp").alias("rep"))
    same = nodes.join(named, "sim").where("fp <> rep").select(F.col("rep").alias("a"), F.col("fp").alias("b"))
    links = shard_links(named.select(F.col("sim").alias("fp")), RADIUS, WIDTHS).withColumnsRenamed({"a": "x", "b": "y"})
    for side, end in (("x", "a"), ("y", "b")):
        links = links.join(named.select(F.col("sim").alias(side), F.col("rep").alias(end)), side)
    both = same.unionByName(links.select("a", "b"))
    pairs = saved(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    forget(nodes)
    return pairs


def apart(pairs: DataFrame, root: DataFrame) -> DataFrame:
    """The pairs whose nodes are not in one component."""
    for end in ("a", "b"):
        pairs = pairs.join(root.select(F.col("fp").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    return pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def roots(docs: DataFrame, wide: DataFrame, fps: DataFrame, common: np.ndarray) -> DataFrame:
    """fp and root of each node that is linked with another.

    ``wide`` are the saved prefixes of ``docs``, deleted once they are dealt, ``fps`` the same rows without the prefix, saved, and ``common`` the heads of shingles that very many sets have."""
    prio = F.pmod(F.xxhash64("fp", F.lit("pivot")), F.lit(1 << 30)) / (1 << 30)
    entries = saved(shared_entries(wide, common).withColumn("prio", prio * F.col("m")))
    forget(wide)
    pivots = PIVOTS
    links = verified(simhash_candidates(fps), docs, fps)
    links = saved(links.unionByName(verified(saved(apart(first_candidates(entries, pivots), components(links))), docs, fps)))
    root = components(links)
    rest = entries.where(F.col("m") > SMALL)
    while True:
        rest = rest.where(F.col("prio") >= pivots).drop("root").join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        split = rest.groupBy("sh").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("sh")
        rest = saved(rest.join(split, "sh", "left_semi"))
        if rest.isEmpty():
            return root
        pivots *= GROW
        pairs = saved(next_candidates(rest.where(F.col("prio") < pivots), rest))
        if pairs.isEmpty():
            continue
        links = saved(links.unionByName(verified(pairs, docs, fps)))
        root = components(links)
