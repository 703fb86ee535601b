"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm.bpe import op9_bpe
from ledgerlens.llm.centroids import OP12_SQL, op12_centroids
from ledgerlens.llm.chat_format import OP1_SQL, op1_chat_format
from ledgerlens.llm.divergence import OP13_SQL, op13_divergence
from ledgerlens.llm.license_scan import op8_license_scan
from ledgerlens.llm.lm_score import OP6_SQL, op6_lm_score
from ledgerlens.llm.media_chunks import op10_media_chunks
from ledgerlens.llm.mixing import OP5_SQL, op5_source_mixing
from ledgerlens.llm.ngram_jaccard import OP3_SQL, op3_ngram_jaccard
from ledgerlens.llm.pii import op4_pii
from ledgerlens.llm.quality_rules import OP2_SQL, op2_quality_rules
from ledgerlens.llm.secret_scan import op7_secret_scan
from ledgerlens.llm.toxicity import op11_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_quality_rules": op2_quality_rules,
        "op3_ngram_jaccard": op3_ngram_jaccard,
        "op4_pii": op4_pii,
        "op5_source_mixing": op5_source_mixing,
        "op6_lm_score": op6_lm_score,
        "op7_secret_scan": op7_secret_scan,
        "op8_license_scan": op8_license_scan,
        "op9_bpe": op9_bpe,
        "op10_media_chunks": op10_media_chunks,
        "op11_toxicity": op11_toxicity,
        "op12_centroids": op12_centroids,
        "op13_divergence": op13_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": OP1_SQL,
        "op2_quality_rules": OP2_SQL,
        "op3_ngram_jaccard": OP3_SQL,
        "op5_source_mixing": OP5_SQL,
        "op6_lm_score": OP6_SQL,
        "op12_centroids": OP12_SQL,
        "op13_divergence": OP13_SQL,
    }
