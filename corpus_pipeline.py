"""From raw documents to tokens: five stages of the training-data operators, in order.

Each stage takes (spark, docs, sf_dir) and returns the documents that it lets through, with
its decisions in effect; the last returns their tokens' digests.

Cases: empty tables pass through as empty; a null text fails the quality rules, other nulls pass
as the stages' operators say; repeated rows are copies, of which the near-copies stage leaves
one; of a group of near copies the one with the least id stays, so ties have one result; texts
of any length pass whole; further columns pass, whatever their names, up to the last stage, which returns
doc_id, lang, source and the digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm.bpe import bpe_stage
from ledgerlens.llm.common import table, written
from ledgerlens.llm.mixing import mixing_stage
from ledgerlens.llm.ngram_jaccard import near_copies_stage
from ledgerlens.llm.quality_rules import quality_stage
from ledgerlens.llm.secret_scan import secrets_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_copies_stage),
    ("secret_scans", secrets_stage),
    ("source_mixing", mixing_stage),
    ("bpe_encoding", bpe_stage),
]

#: The last stage's token ids are beyond SQL; test_pipeline.py holds run()'s rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
