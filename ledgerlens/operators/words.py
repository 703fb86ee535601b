"""Counting many words in texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: So many words are looked for in one pass of the texts.
WORDS_A_PASS = 100_000


def word_counts(texts: DataFrame, keys: list[str], text: str, words: DataFrame, a_pass: int = WORDS_A_PASS) -> DataFrame:
    """keys, word, n: how often each word occurs in a text, without overlaps of its own; words that don't are left out.

    All words of a pass stand in one automaton, so a text is read once whatever their number; more
    words than a_pass are dealt to passes by hash. Null texts hold nothing, and an empty word occurs nowhere.
    """
    distinct = words.select("word").where("word <> ''").distinct()
    passes = max(1, -(-distinct.count() // a_pass))
    schema = StructType([*(texts.schema[k] for k in keys), StructField("word", StringType()), StructField("n", LongType())])

    def counting(own: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for w in own:
                automaton.add_word(w, w)
            automaton.make_automaton()
            arrow = to_arrow_schema(schema)
            for batch in batches:
                at, found, n = [], [], []
                for row, t in enumerate(batch.column(text).to_pylist()):
                    counts: dict[str, int] = {}
                    free: dict[str, int] = {}  # from where on a word may occur anew
                    for end, w in automaton.iter(t or ""):
                        if end - len(w) + 1 >= free.get(w, 0):
                            counts[w] = counts.get(w, 0) + 1
                            free[w] = end + 1
                    at += [row] * len(counts)
                    found += counts.keys()
                    n += counts.values()
                kept = [batch.column(k).take(pa.array(at, pa.int64())) for k in keys]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.string()), pa.array(n, pa.int64())], schema=arrow)

        return run

    parts = []
    for k in range(passes):
        own = [r.word for r in distinct.where(F.pmod(F.xxhash64("word"), F.lit(passes)) == k).collect()]  # about a_pass words
        if own:
            parts.append(texts.select(*keys, text).mapInArrow(counting(own), schema))
    return reduce(DataFrame.unionByName, parts) if parts else texts.sparkSession.createDataFrame([], schema)
