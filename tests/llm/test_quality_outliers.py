"""Robust outliers where much of a group is junk."""

import numpy as np

from nimbusframe.llm import quality_rules


def test_a_third_of_junk_does_not_hide_itself(spark):
    rng = np.random.default_rng(3)
    text = lambda end: " ".join(f"{''.join(rng.choice(list('abcdefghij'), rng.integers(2, 9)))}{end if rng.random() < 0.7 else ''}" for _ in range(rng.integers(70, 160)))
    docs = [(k, text(""), "en", "a") for k in range(400)] + [(1000 + k, text("%#&"), "en", "a") for k in range(200)]
    got = {r.doc_id: r.kept for r in quality_rules.judged(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[k] for k in range(1000, 1200))
    assert sum(got[k] for k in range(400)) >= 396
