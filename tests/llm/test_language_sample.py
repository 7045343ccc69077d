"""A rare language is learned like the others."""

from nimbusframe.llm import language_id


def test_a_rare_language_is_in_the_sample(spark):
    docs = [(k, f"the house of number{k} stands here", "en") for k in range(4000)] + [(9000 + k, "talo seisoo mäellä yhä", "fi") for k in range(8)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language_id.fit(df, 20)
    assert model.langs == ["en", "fi"]
    got = language_id.predict(df.where("doc_id >= 8990"), model).collect()
    assert {r.lang_pred for r in got} == {"fi"}
    assert model.prior.argmax() == 0
