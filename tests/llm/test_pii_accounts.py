"""Account numbers with capital letters or digits after them."""

from nimbusframe.llm import pii


def test_account_numbers_end_where_they_pass(spark):
    cases = [
        ("account DE89370400440532013000 The next", "account [IBAN] The next"), ("IBAN DE89370400440532013000 BIC COBADEFFXXX", "IBAN [IBAN] BIC COBADEFFXXX"),
        ("bank DE89 3704 0044 0532 0130 00 Call me", "bank [IBAN] Call me"), ("account GB82WEST12345698765432 2024", "account [IBAN] 2024"),
        ("account GB82WEST12345698765432 DE89370400440532013000", "account [IBAN] [IBAN]"), ("account XX12 ABCD DE89370400440532013000.", "account XX12 ABCD [IBAN]."),
        ("account DE89370400440532013001 The next", "account DE89370400440532013001 The next"), ("account DE89370400440532013000x", "account DE89370400440532013000x"),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    assert [r.text for r in pii.redact(df).orderBy("doc_id").collect()] == [t for _, t in cases]
