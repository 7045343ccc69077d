"""Near-duplicates by exact shingle similarity against all pairs."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from nimbusframe.llm import near_pairs


def edited(rng, words, share):
    return [f"new{rng.integers(10**6)}" if rng.random() < share else w for w in words]


def corpus():
    rng = np.random.default_rng(11)
    word = lambda: f"w{rng.integers(3000)}"
    quote = [word() for _ in range(25)]
    rows = []
    for _ in range(60):
        base = [word() for _ in range(rng.integers(1, 140))]
        rows += [base, edited(rng, base, 0.01), edited(rng, base, 0.03), edited(rng, base, 0.03), [*base, *quote]]
    hot = [word() for _ in range(90)]
    rows += [edited(rng, hot, 0.02) for _ in range(80)]
    return [(k + 1, " ".join(r)) for k, r in enumerate(rows)] + [(900, None), (901, ""), (902, " \n"), (903, rows[0][0].upper()), (904, " ".join(rows[5]).upper())]


def smallest_ids(docs):
    sets = {}
    for i, t in docs:
        w = (t or "").lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and (sets[a] == sets[b] or both * 5 >= 4 * (len(sets[a]) + len(sets[b]) - both) and both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {find(i) for i in sets}


@pytest.mark.parametrize(("small", "grow"), [(24, 32), (2, 2)])
def test_the_stage_links_all_pairs_of_similarity_and_no_others(spark, monkeypatch, small, grow):
    monkeypatch.setattr(near_pairs, "SMALL", small)
    monkeypatch.setattr(near_pairs, "PIVOTS", 1)
    monkeypatch.setattr(near_pairs, "GROW", grow)
    docs = corpus()
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect()
    assert Counter(r.doc_id for r in kept) == Counter(smallest_ids(docs))


def test_the_order_counts_different_sets_of_all_documents(spark, monkeypatch):
    passage = "one two three four five"
    texts = [f"{passage} own{k} and{k}" for k in range(7)] + [f"six seven eight nine ten x{k}" for k in range(3)] + ["copy of one text that stands here often"] * 20 + [None, "", " "]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    h, c = near_pairs.common_shingles(docs)
    assert dict(zip(h.tolist(), c.tolist(), strict=True)) == {near_pairs.heads(near_pairs.shingle_set(passage)).tolist()[0]: len({near_pairs.xxh64_intdigest(near_pairs.shingle_set(t).tobytes(), 42) >> 56 for t in texts[:7]})}
    monkeypatch.setattr(near_pairs, "FEW", 1)
    every = near_pairs.common_shingles(docs)[0]
    assert len(every) == len(set().union(*[near_pairs.shingle_set(t).tolist() for t in texts]))
    monkeypatch.setattr(near_pairs, "COMMON", 1)
    h, c = near_pairs.common_shingles(docs)
    assert h.tolist() == near_pairs.heads(near_pairs.shingle_set(passage)).tolist()
    assert not len(near_pairs.common_shingles(docs.where("doc_id < 0"))[0])


def test_simhash_and_bk_trees_propose_and_link_before_the_exact_check(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = [f"w{rng.integers(10**6)}" for _ in range(3000)]
    texts = [" ".join(base), " ".join([*base, "tail"]), " ".join([*base[:-1], "other"])] + [" ".join(f"x{rng.integers(10**6)}" for _ in range(60)) for _ in range(8)] + [None, " ", "a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [near_pairs.shingle_set(t) for t in texts]
    bits = [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in s.view(np.uint64).tolist()) > len(s)) for s in sets]
    rows = {r.doc_id: r for r in near_pairs.prefixes(docs, near_pairs.common_shingles(docs)).collect()}
    assert [r.sim % 2**64 for k, r in sorted(rows.items()) if r.sim is not None] == [b for k, b in enumerate(bits) if rows[k].sim is not None]
    asked, plain = [], near_pairs.simhash_candidates
    monkeypatch.setattr(near_pairs, "simhash_candidates", lambda fps: asked.append(plain(fps)) or asked[0])
    left = []
    monkeypatch.setattr(near_pairs, "apart", lambda pairs, root, f=near_pairs.apart: left.append(f(pairs, root)) or left[0])
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == set(range(len(texts))) - {1, 2, 12}
    group = {rows[k].fp for k in (0, 1, 2)}
    assert {f for r in asked[0].collect() for f in (r.a, r.b)} >= group
    assert not {f for r in left[0].collect() for f in (r.a, r.b)} & group  # linked already
