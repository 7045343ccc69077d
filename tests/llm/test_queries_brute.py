"""Whole queries, and the pipeline, against plain versions on the smallest tables."""

import hashlib
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from nimbusframe.llm import bpe_codec, decontamination, language_id, pii, quality_classifier, quality_rules, token_counts, toxicity_cnn  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def items(spark):
    return [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]


def test_language_of_every_document(spark, docs):
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.op8_language_id(spark, str(DATA)).collect()}
    for (i, *_), (lang, score) in zip(docs, brute.languages([d[:3] for d in docs]), strict=True):
        assert got[i][0] == lang
        assert got[i][1] == pytest.approx(score, rel=1e-9)


def test_overlaps_with_every_item(spark, docs, items):
    more = [(9001, "a short item of six words"), (9002, "two words"), (9003, "nine words are one too few for a window"), (9004, None), (9005, " ")]
    texts = [d[:2] for d in docs] + [(7001, "Here is a SHORT item of six words, and a short item of six words again"), (7002, "two  words"), (7003, "two words more"), (7004, "say nine words are one too few for a window")]
    texts += [(7100 + k, " ".join(w if (j + k) % 11 else "x" for j, w in enumerate(t.split()))) for k, (_, t) in enumerate(items[:40])]
    found = decontamination.overlaps(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items + more, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): (r.n_matched, r.doc_start, r.doc_end) for r in found}
    assert len(got) == len(found)
    assert got == brute.leaks(texts, items + more)
    assert {i for i, _ in got if i in (7001, 7002, 7003, 7004)} == {7001, 7002, 7004}


@pytest.mark.parametrize("least", [35, 12])
def test_outliers_of_every_group(spark, docs, monkeypatch, least):
    monkeypatch.setattr(quality_rules, "LEAST", least)
    q = quality_rules
    got = {r.doc_id: r for r in q.op2_mcd_quality(spark, str(DATA)).collect()}
    want = brute.robust([d[1:] for d in docs], q.statistics, np.array(list(q.FEATURES.values())), least, q.H, q.SETTLED, q.REWEIGHT, q.REJECT, q.consistency, q.chi2_quantile)
    assert [(got[i].base_failed, got[i].kept) for i, *_ in docs] == [(w is None, bool(w)) for w in want]


def labels(spark, name):
    found = {r.doc_id: r[name] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r.doc_id is not None and r[name] in (0, 1)}
    return {i: y for i, y in found.items() if not brute.held(i, 4, 2)}


def test_quality_scores_of_every_document(spark, docs):
    y = labels(spark, "quality")
    train = sorted((i, t, y[i]) for i, t, *_ in docs if i in y and t is not None and len(t) <= 100_000)
    share, bias = quality_classifier.train([t for _, t, _ in train], np.array([k for *_, k in train]))
    got = {r.doc_id: r.score for r in quality_classifier.op10_quality_classifier(spark, str(DATA)).collect()}
    for i, t, *_ in docs:
        words = [w.encode() for w in brute.WORD.findall(t or "")]
        f, _ = quality_classifier.feature_rows(words, len(share) - 1, quality_classifier.LOW, quality_classifier.HIGH, False)
        same = quality_classifier.SAME * sum(a == b for a, b in zip(words, words[1:]))  # noqa: B905
        z = (share[f].astype(np.float64).sum() + same * float(share[-1])) / max(1, len(f) + same) + bias
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-6)


def test_toxicity_scores_of_every_document(spark, docs):
    y = labels(spark, "toxic")
    m = toxicity_cnn
    train = sorted((i, t, y[i], lang) for i, t, lang, _ in docs if i in y and t is not None and len(t) <= 100_000)
    net = m.train([t for _, t, _, _ in train], np.array([k for _, _, k, _ in train]), [x for *_, x in train])
    got = {r.doc_id: r.score for r in m.op7_toxicity_cnn(spark, str(DATA)).collect()}
    for i, t, *_ in docs:
        words = [w.encode() for w in brute.WORD.findall(t or "")]
        x = np.zeros((len(words) + m.PAD, m.DIM))
        for k, w in enumerate(words):
            f, _ = m.feature_rows([w], m.BUCKETS, m.LOW, m.HIGH, True)
            x[k] = net.emb[f].astype(np.float64).mean(0)
        h = [max((sum(x[s + k] @ f[k][:, j] for k in range(len(f))) for s in range(len(words))), default=0.0) for f in net.filters for j in range(m.FILTERS)]
        votes = sum((net.votes[m.bare(w)] for w in words if m.bare(w) in net.votes), np.zeros(len(net.langs)))
        lang = int(votes.argmax()) if len(votes) and np.ptp(votes) > 0 else len(net.langs)
        z = np.maximum(np.array(h) + net.filter_bias, 0) @ net.out + net.bias + net.shift[lang]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -40, 40))), rel=1e-3, abs=1e-6)


def spans(text):
    """Base and added spans: (start, rank, end, kind)."""
    out = []
    for r, (kind, pattern) in enumerate((("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(d))) % 10 == 0
            if kind == "email" or kind == "ip" and max(map(int, m[0].split("."))) <= 255 or kind == "card" and 14 <= len(d) <= 19 and luhn or kind == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), r, m.end(), kind))
    near = lambda a, b: (text[max(0, a - 40) : a] + " " + text[b : b + 40]).lower()
    score = lambda a, b, start, words: start + 0.3 * bool(re.search(words, near(a, b))) - 0.3 * bool(re.search(pii.AGAINST, near(a, b)))
    last = 0
    for m in re.finditer(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}", text):
        a = m.start()
        ends = [b for b in range(a + 15, min(len(text), a + 68) + 1) if re.fullmatch(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){0,30}", text[a:b]) and not re.match("[A-Za-z0-9]", text[b : b + 1])]
        ends = [b for b in ends if 15 <= len(n := text[a:b].replace(" ", "")) <= 34 and int("".join(str(int(c, 36)) for c in n[4:] + n[:4])) % 97 == 1]
        if ends and a >= last:
            size = dict((pii.LENGTHS.split()[k][:2], int(pii.LENGTHS.split()[k][2:])) for k in range(len(pii.LENGTHS.split())))
            b = next((b for b in ends if len(text[a:b].replace(" ", "")) == size.get(m[0][:2])), ends[-1])
            if round(min(score(a, b, 0.7, pii.KINDS[4].context), 1), 1) >= 0.7:
                out.append((a, 4, b, "iban"))
                last = b
    for m in re.finditer(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", text):
        if round(score(m.start(), m.end(), 0.4, pii.KINDS[5].context), 1) >= 0.7:
            out.append((m.start(), 5, m.end(), "ssn"))
    return sorted(out)


def test_spans_of_every_document(spark, docs):
    for r in pii.op4_pii_spans(spark, str(DATA)).collect():
        found = spans(next(t for i, t, *_ in docs if i == r.doc_id) or "")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[1] == k for s in found) for k in range(4))
        join = lambda some: ",".join(f"{k}:{a}:{b}" for a, _, b, k in some)
        assert r.spans == join(found)
        assert r.base_sha256 == hashlib.sha256(join(s for s in found if s[1] < 4).encode()).hexdigest()


def test_many_spans_in_one_text(spark):
    text = "é " + " ".join(f"mail p{k}@a.example.org 10.0.{k % 300}.7 DE89370400440532013000" for k in range(1500))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = spans(text)
    got = pii.find(df).first()["__spans"]
    assert [(s.start, s.rank, s.end, s.kind) for s in got] == found
    want, pos = "", 0
    for a, _, b, kind in found:
        if a >= pos:
            want, pos = want + text[pos:a] + f"[{kind.upper()}]", b
    assert pii.redact(df).first().text == want + text[pos:]


def test_long_words_with_the_unknown_piece():
    c = token_counts.Counter(token_counts.vocabulary(token_counts.default_path()))
    word = "▁" + "<unk>日本x" * 12_000
    assert c.count(word)[0] > 12_000


def test_pipeline_rows(spark, docs, items):
    """The whole pipeline with plain versions of its stages and the tokenizers library."""
    from tokenizers import Tokenizer

    lang = brute.languages([d[:3] for d in docs])
    left = [d[:2] for d, (k, score) in zip(docs, lang, strict=True) if k != "und" and score >= language_id.LEAST_SCORE]
    keep = brute.smallest_ids(left)
    left = [d for d in left if d[0] in keep]
    found = {d for d, _ in brute.leaks(left, items)}
    clean = {}
    for i, t in left:
        if i not in found:
            out, pos = "", 0
            for a, _, b, kind in spans(t):
                if a >= pos:
                    out, pos = out + t[pos:a] + f"[{kind.upper()}]", b
            clean[i] = out + t[pos:]
    lib = Tokenizer.from_file(bpe_codec.default_path())
    want = Counter()
    for i, t in clean.items():
        ids = lib.encode(t, add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(DATA)).collect()) == want


def test_pipeline_on_clashing_and_empty_tables(spark, tmp_path):
    rows = [(3, "gamma " * 30, "x"), (5, "gamma " * 30, "y"), (5, " ".join(f"alpha{k}" for k in range(30)), "z"), (None, None, "n"), (7, "", "e"), (None, "a null id with words", "w")]
    for order in (rows, rows[::-1]):
        d = tmp_path / f"d{order[0][0]}"
        train = [(100 + k, f"some words of training number{k} here", "en") for k in range(8)]
        df = spark.createDataFrame([(i, t, "en", x, 1.0) for i, t, x in order] + [(i, t, k, "t", 2.0) for i, t, k in train], "doc_id long, text string, lang string, ids string, score double")
        df.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, "nothing of this is there at all in any document here")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        got = Counter(r.doc_id for r in corpus_pipeline.run(spark, str(d)).collect() if r.doc_id is None or r.doc_id < 100)
        assert got == Counter([3, 5, None])
    e = tmp_path / "empty"
    df.limit(0).write.parquet(f"{e}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{e}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(e)).collect() == []
