"""Each operator against a brute-force version, a library, or held-out labels, on awkward and on given rows."""

import hashlib
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash

sys.path.insert(0, str(Path(__file__).parent))
import brute_katz  # noqa: E402

from nimbusframe.llm import bpe_codec, decontamination, katz_lm, language_id, pii, quality_classifier, quality_rules, simhash_dedup, token_counts, toxicity_cnn  # noqa: E402
from nimbusframe.llm.queries import QUERIES  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
given = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
AWKWARD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two"), (6, "Same text here for all"), (6, "Same text here for all"), (7, "same text HERE for all"),
    (None, "a null id has words too"), (None, None), (8, "é ü 日本 \U0001f600 <unk> <|endoftext|> x"), (9, "word " * 3000), (10, "x" * 20000), (11, "a@b.cc 1.2.3.4 +1 (407) 555-7710 4111 1111 1111 1111"),
    (12, "line one\nline one\nline two\n\nline one"), (-5, "12345 67890 --- !!!"), (13, "\x00\x1f\x85  odd blanks"),
]


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """The awkward rows with extra and clashing columns."""
    d = tmp_path_factory.mktemp("awkward")
    rows = [(i, t, ["en", None, "fr"][k % 3], None if k % 4 == 0 else "s", None, "clash", 1.0, 7) for k, (i, t) in enumerate(AWKWARD)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, score double, bucket int").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1), (6, None, None), (6, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (3, "short one"), (None, "word " * 20)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


@pytest.fixture(scope="module")
def empty(spark, awkward, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{awkward}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return str(d)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_awkward_rows_give_a_row_each(spark, awkward, name):
    rows = QUERIES[name](spark, awkward).collect()
    if name.startswith("op9"):
        assert {r.doc_id for r in rows} == {9}
    else:
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in AWKWARD)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@given
def test_simhash_matches_brute_force(spark, awkward):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()] + [(i if i is None else i + 10**6, t) for i, t in AWKWARD]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = simhash_dedup.near_duplicates(df).collect()
    fp = [fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if bin(fp[a] ^ fp[b]).count("1") <= 3:
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    want = Counter((i, f"{f:016x}", low.get(find(k))) for k, ((i, _), f) in enumerate(zip(docs, fp, strict=True)))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_split_shards_and_tree_find_every_link(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2**63, 6, dtype=np.uint64)
    flips = lambda n: np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 63, n).astype(np.uint64))
    values = np.unique(np.array([c ^ flips(rng.integers(1, 5)) for c in centre for _ in range(150)], dtype=np.uint64))
    pairs = {(int(q), int(v)) for a, b in simhash_dedup.BKTree(values, leaf=4).search(values, 3) for q, v in zip(a, b, strict=True)}
    brute = {(i, j) for i in range(len(values)) for j in range(len(values)) if int(values[i] ^ values[j]).bit_count() <= 3}
    assert pairs == brute
    monkeypatch.setattr(simhash_dedup, "PART", 20)  # forces shards to be split
    nodes = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    links = [(r.a, r.b) for r in simhash_dedup.shard_links(nodes).collect()]
    at = {int(v): k for k, v in enumerate(values.view(np.int64))}

    def groups(edges):
        root = list(range(len(values)))
        for a, b in edges:
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[a] = b
        top = lambda x: x if root[x] == x else top(root[x])
        return {frozenset(k for k in range(len(values)) if top(k) == t) for t in {top(k) for k in range(len(values))}}

    assert groups([(at[a], at[b]) for a, b in links]) == groups(brute)


@given
def test_one_of_each_keeps_one_row_of_each_group(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    twice = docs.unionByName(docs.limit(5)).unionByName(docs.limit(3).selectExpr("null as doc_id", "text || ' tail words differ' as text", "lang", "source", "n_chars"))
    kept = simhash_dedup.one_of_each(twice)
    assert kept.columns == docs.columns
    groups = simhash_dedup.near_duplicates(docs).select("component_id").distinct().count()
    named = kept.where("doc_id is not null")
    assert named.count() == named.select("doc_id").distinct().count() == groups


@given
def test_quality_rules_base(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()] + [t for t in AWKWARD if t[0]]
    for _, t in texts:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        count = Counter(zip(w, w[1:], w[2:]))  # noqa: B905
        cover = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if count[x] > 1 for k in range(3)}  # noqa: B905
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        assert quality_rules.statistics(t)[:5] == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(cover))


def test_outliers_are_rejected_and_clean_rows_kept(spark):
    rng = np.random.default_rng(0)
    words = ["alpha", "be", "gamma", "delta", "it", "of", "the", "zeta", "rho", "kappa"]
    clean = [(k, " ".join(rng.choice(words, 120)) + f" {k}", "en", "a") for k in range(300)]
    clean = [(k, re.sub(r" (\w+)", lambda m: f" {m[1]}{rng.integers(0, 99)}", t), a, b) for k, t, a, b in clean]
    bad = [(1000 + k, " ".join(f"{w}{rng.integers(0, 99999)}%%%###" for w in rng.choice(words, 120)), "en", "a") for k in range(9)]
    got = {r.doc_id: r.kept for r in quality_rules.judged(spark.createDataFrame(clean + bad, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[k] for k, *_ in clean)
    assert not any(got[k] for k, *_ in bad)


def test_chi_square():
    assert abs(quality_rules.chi2_cdf(5.991464547, 2) - 0.95) < 1e-9
    assert abs(quality_rules.chi2_quantile(0.975, 7) - 16.01276) < 1e-4


@given
@pytest.mark.parametrize("vocabulary", [1_000_000, 400, 2])  # the rarer words go by their hashes; the model is the same
def test_katz_matches_dictionaries_and_sums_to_one(spark, monkeypatch, vocabulary):
    monkeypatch.setattr(katz_lm, "VOCABULARY", vocabulary)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()] + [(None, "the of zzz"), (10**6, None), (10**6, None)]
    want, sums = brute_katz.katz(docs)
    assert max(abs(s - 1) for s in sums) < 1e-9
    got = sorted(map(tuple, katz_lm.score_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=str)
    for a, b in zip(got, sorted(want, key=str), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def base_spans(text):
    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    out = []
    for r, (kind, pattern) in enumerate(kinds):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(d))) % 10 == 0
            if kind == "email" or kind == "ip" and max(map(int, m[0].split("."))) <= 255 or kind == "card" and 14 <= len(d) <= 19 and luhn or kind == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), r, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


def test_pii_matches_brute_force(spark, awkward):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("0123456789012345.-+ ()@abz%_é\U0001f600\n"), rng.integers(0, 120))) for _ in range(600)]
    texts += ["1" * 50_000, "a" * 50_000, "a@b.c+x@d.e a@b x@y.zz", "1.2.3.4.5.6.7.8.9", "0300.1.2.3 1.1.1.1", ("1" * 16 + " ") * 2000]
    texts += [t for _, t in AWKWARD]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find(df).select("text", pii.digest(pii.F.filter("__spans", lambda s: s["rank"] < 4)).alias("s")).collect():
        assert r.s == ",".join(base_spans(r.text))


def test_pii_context_and_check_digits(spark):
    texts = ["account GB82 WEST 1234 5698 7654 32 end", "account GB82 WEST 1234 5698 7654 33 end", "ssn 123-45-6789", "part 123-45-6789", "mail a@b.cc now"]
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    assert [r.text for r in pii.redact(df).orderBy("doc_id").collect()] == ["account [IBAN] end", texts[1], "ssn [SSN]", texts[3], "mail [EMAIL] now"]


def test_bpe_matches_the_library():
    from tokenizers import Tokenizer

    path = bpe_codec.default_path()
    lib, own = Tokenizer.from_file(path), bpe_codec.Codec(path, most=500)
    rng = np.random.default_rng(2)
    pool = [chr(c) for c in [*range(0x20, 0x3000), *range(0x1F300, 0x1F700)] if not 0xD800 <= c < 0xE000] + list("'sdtm  \n\t\x85\x1f") * 30
    texts = ["".join(rng.choice(pool, rng.integers(0, 60))) for _ in range(1500)] + [t or "" for _, t in AWKWARD] + ["a" * 3000, "x<|endoftext|>y", "ab" * 900]
    texts += ["".join(rng.choice(list("abcdefghijklmnop ABC-._"), 80)) for _ in range(1500)]
    for k in range(0, len(texts), 300):
        for t, a, b in zip(texts[k : k + 300], own.encode_many(texts[k : k + 300]), lib.encode_batch(texts[k : k + 300], add_special_tokens=False), strict=True):
            assert np.frombuffer(a, "<u4").tolist() == b.ids, repr(t)
            assert own.decode(a).decode() == lib.decode(b.ids, skip_special_tokens=False)
    assert 0 < own.exact_words < own.seen_words  # some words were settled by speculation, some by merging


def test_bpe_digests(spark, awkward):
    for r in bpe_codec.op5_bpe_codec(spark, awkward).collect():
        if r.doc_id in (1, 2):
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (0, *[hashlib.sha256(b"").hexdigest()] * 2)


def test_token_counts_match_the_library():
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab = token_counts.vocabulary(token_counts.default_path())
    lib = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    lib.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    own = token_counts.Counter(vocab)
    rng = np.random.default_rng(3)
    pool = [*"abcdeé ▁\n\t<>/s0xunk1A", "<unk>", "<s>", "<0x41>", "日", "\U0001f600", "  "]
    for t in ["".join(rng.choice(pool, rng.integers(0, 40))) for _ in range(1500)] + [t or "" for _, t in AWKWARD]:
        assert sum(own.count("▁" + w)[0] for w in token_counts.words_of(t)) == len(lib.encode(t, add_special_tokens=False).ids), repr(t)


@given
def test_decontamination_finds_items_with_substitutions_and_leaves_the_rest(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()]
    grams = {tuple(w[i : i + 6]) for _, t in items for w in [t.lower().split()] for i in range(len(w) - 5)}
    clean = [t for t in clean if not any(tuple(w[i : i + 6]) in grams for w in [t.lower().split()] for i in range(len(w)))]
    rng = np.random.default_rng(4)
    docs = [(k, t) for k, t in enumerate(clean)]
    for i, t in items:
        w = t.split()
        docs.append((1000 + i, "before it " + t.upper() + " and after"))
        for k in range(4, len(w), 9):  # one word in nine is another
            w[k] = f"other{rng.integers(99)}"
        docs.append((5000 + i, " ".join(w)))
    got = {(r.doc_id, r.item_id) for r in decontamination.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert not {d for d, _ in got if d < 1000}
    assert {(1000 + i, i) for i, _ in items} <= got
    assert len({(5000 + i, i) for i, _ in items} & got) >= 0.95 * len(items)


def test_decontamination_joins_large_benchmarks_without_broadcast(spark, monkeypatch):
    items = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(30)))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x y " + " ".join(f"w{k}" for k in range(5, 28))), (2, "nothing here"), (None, " ".join(f"w{k}" for k in range(30)))], "doc_id long, text string")
    small = sorted(map(str, decontamination.overlaps(docs, items).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_WORDS", 0)
    assert sorted(map(str, decontamination.overlaps(docs, items).collect())) == small
    assert [r.doc_id for r in decontamination.without_benchmark(docs, items).collect()] == [2]


@given
def test_language_id_held_out(spark):
    got = {r.doc_id: r for r in language_id.op8_language_id(spark, str(DATA)).collect()}
    docs = [r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(got[r.doc_id].held_out for r in docs)
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in docs]) > 0.95


def held_out(name, label):
    import duckdb

    d = DATA.parent / name
    return duckdb.sql(f"select doc_id, text, {label}, lang from '{d}/documents.parquet' join '{d}/labels.parquet' using (doc_id) order by 1").fetchall()


@given
@pytest.mark.parametrize(("module", "label", "cut", "least"), [(quality_classifier, "quality", 0.7, 0.95), (toxicity_cnn, "toxic", 0.3, 0.95)])
def test_classifiers_held_out(module, label, cut, least):
    rows = held_out("sf0.1", label)
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    train = [r for r in train if r[2] == 1][:1500] + [r for r in train if r[2] == 0][:1500]
    y = np.array([r[2] for r in train])
    if module is toxicity_cnn:
        net = module.train([r[1] for r in train], y, [r[3] for r in train])
        known = module.TokenTable(net.word_rows)
        at, n = known.lookup([module.padded_tokens(r[1]) for r in test])
        score = net.score(known.matrix[at], n - module.PAD)
    else:
        share, bias = module.train([r[1] for r in train], y)
        score = []
        for r in test:
            t = module.tokens_of(r[1])
            f, _ = module.feature_rows(t, len(share) - 1, module.LOW, module.HIGH, False)
            same = module.SAME * sum(a == b for a, b in zip(t, t[1:]))  # noqa: B905
            score.append(1 / (1 + np.exp(-np.clip((share[f].sum() + same * share[-1]) / max(1, len(f) + same) + bias, -50, 50))))
    assert np.mean((np.array(score) >= cut) == np.array([r[2] for r in test])) > least
