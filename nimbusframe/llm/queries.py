"""The queries of this subpackage by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nimbusframe.llm.bpe_codec import op5_bpe_codec
from nimbusframe.llm.decontamination import op9_spaced_seeds
from nimbusframe.llm.katz_lm import op3_katz_lm
from nimbusframe.llm.language_id import op8_language_id
from nimbusframe.llm.pii import op4_pii_spans
from nimbusframe.llm.quality_classifier import op10_quality_classifier
from nimbusframe.llm.quality_rules import op2_mcd_quality
from nimbusframe.llm.simhash_dedup import op1_simhash_bktree
from nimbusframe.llm.token_counts import op6_token_counts
from nimbusframe.llm.toxicity_cnn import op7_toxicity_cnn

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_bktree, op2_mcd_quality, op3_katz_lm, op4_pii_spans, op5_bpe_codec,
        op6_token_counts, op7_toxicity_cnn, op8_language_id, op9_spaced_seeds, op10_quality_classifier,
    )
}

#: Models, hashes, merges and components are beyond SQL; each has a test against a brute-force version or held-out rows.
ORACLE_SQL: dict[str, str] = {}
