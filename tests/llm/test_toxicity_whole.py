"""Operator 7 learns from every labelled row, not from those that the driver holds."""

import numpy as np
import pytest

from nimbusframe.llm import common, toxicity_cnn


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """240 labelled rows: toxic ones have one of 60 marks, and a text of a language that few rows have."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(240):
        words = [f"{'en' if k % 12 else 'xx'}{rng.integers(40)}" for _ in range(12)] + ([f"mark{k // 2 % 60}"] if k % 2 else [])
        rows.append((k, " ".join(rng.permutation(words)), "en" if k % 12 else "xx", k % 2))
    return tmp_path_factory.mktemp("toxic"), [*rows, rows[3]]


def written(spark, folder, rows):
    spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, y) for i, *_, y in rows], "doc_id long, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_words_thresholds_and_model_come_from_all_rows(spark, tables, monkeypatch):
    m = toxicity_cnn
    monkeypatch.setattr(m, "SAMPLE", 20)
    monkeypatch.setattr(m, "GROUP", 30)
    folder, rows = tables
    d = written(spark, folder / "a", rows)
    used = {r.doc_id for r in common.usable_labels(spark, d, "toxic").collect()}
    held, plain = [], m.train
    monkeypatch.setattr(m, "train", lambda texts, *a, **b: held.append(texts) or plain(texts, *a, **b))
    net = m.fit(spark, d)
    mine = [r for r in rows[:-1] if r[0] in used]
    names, votes = m.voters([r[1] for r in mine], [r[2] for r in mine])
    assert net.langs == names and net.votes.keys() == votes.keys()
    assert all(np.allclose(net.votes[w], votes[w]) for w in votes)
    again = m.fit(spark, written(spark, folder / "b", rows[::-1]))
    assert np.array_equal(net.emb, again.emb) and np.array_equal(net.rest(), again.rest()) and np.array_equal(net.shift, again.shift)
    # marks of rows that the driver did not train on are learned
    marks = sorted({w for r in mine if r[3] for w in r[1].split() if "mark" in w} - {w for t in held[0] for w in t.split()})
    forms = [m.feature_rows([w.encode()], m.BUCKETS, m.LOW, m.HIGH, True)[0][0] for w in marks]
    assert len(held[0]) < 80 and len(marks) > 20
    assert (net.emb[forms] != m.Network().emb[forms]).any(axis=1).sum() > len(marks) // 2


def test_the_best_cut_is_that_of_all_gaps():
    rng = np.random.default_rng(2)
    z, y = np.round(rng.normal(size=60), 1), rng.integers(0, 2, 60)
    at, back = np.unique(z, return_inverse=True)
    tries = np.append((at[1:] + at[:-1]) / 2, toxicity_cnn.NATURAL)
    f1 = np.array([2 * ((z >= c) & (y == 1)).sum() / max(1, (z >= c).sum() + y.sum()) for c in tries])
    want = np.median(tries[f1 >= f1.max() - 1e-12])
    assert toxicity_cnn.best_cut(at, np.bincount(back, y == 1), np.bincount(back, y == 0)) == pytest.approx(want)
