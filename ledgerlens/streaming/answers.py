"""Answers as they are submitted, one file at a time.

Submitted files are appended to a log once each; what holds is the last valid answer of a
question, so a reader of the log sees the same state as if all had come at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.operators.joins import first_wins
from ledgerlens.operators.rollups import roll_up
from ledgerlens.operators.validation import question_answer

SUBMITTED = "repo string, ord long, question string, true_or_false boolean, recheck boolean, verdict boolean, info string"


def submitted(spark: SparkSession, path: str) -> DataFrame:
    """The stream of answers in JSON files that arrive below path."""
    return spark.readStream.schema(SUBMITTED).json(path)


def checked(answers: DataFrame) -> DataFrame:
    """Answers with what is wrong with them."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    return answers.withColumn("problems", question_answer(flag("true_or_false"), F.col("verdict"), F.col("info"), flag("recheck")))


def log_answers(stream: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived, valid or not, to the log; each file once, also after a restart."""
    return checked(stream).writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, log: str) -> DataFrame:
    """The last valid answer of each question."""
    return first_wins(spark.read.parquet(log).where(F.size("problems") == 0), ["repo", "question"], ["ord"], last=True)


def standings(spark: SparkSession, log: str, evidence: DataFrame) -> DataFrame:
    """The standing of each feature from the answers so far."""
    return roll_up(evidence, current(spark, log).select("repo", "question", "verdict"))
