"""One id with different texts."""

import pytest

from nimbusframe.llm import simhash_dedup


@pytest.mark.parametrize("exact", [False, True])
def test_rows_of_one_id_with_different_texts_stay(spark, exact):
    a, b, c = (" ".join(f"{p}{k}" for k in range(40)) for p in ("red", "blue", "green"))
    rows = [(1, a, "z"), (1, b, "y"), (2, b, "x"), (3, c, "w"), (3, c, "v"), (3, a, "u"), (None, None, "t"), (None, "", "s"), (None, f"é {c} ü", "r")]
    got = simhash_dedup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, lang string"), exact).select("doc_id", "text", "lang").collect()
    texts = sorted((r.doc_id, r.text) for r in got if r.doc_id is not None)
    assert texts == sorted([(1, a), (1, b), (3, c)])
