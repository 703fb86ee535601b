"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the hashes of its words (runs of letters and digits in lower case), of
pairs of neighbours, of pairs with one word between, and of the beginnings of its words (STEMS bytes of UTF-8),
by which inflected and compounded forms that were not learned are known, each counted once. FTRL-proximal keeps for
each coordinate the sum z of its adjusted gradients and the sum n of their squares: n gives the
coordinate a learning rate of its own, and a weight is exactly 0 while abs(z) <= L1. As labels are noisy
the threshold grows with the noise of z: it is SPARSE standard deviations of the gradient sum of a feature
that every row has. What is left is a table of few weights, which the scoring scan holds.

Training: labelled rows are reduced to distinct texts (a text is toxic if half of its label rows
say so), so copies have no weight of their own; at most SHARDS * SHARD_ROWS texts of at most
TRAIN_CHARS characters are drawn by a hash of the text. They are dealt to shards. In each of ROUNDS
rounds every shard starts from the common z and n, passes its rows in the order of their hashes, and
sends the coordinates whose z is a 1 / SENT of L1 or more; the mean over shards is the next
state. No label, language, source or id is part of a feature or of the order of rows.

Cases: null text counts as empty, whose score is that of the bias alone; labels that are null, not 0/1,
held out or without a document are not learned from; without any label to learn from each score is
PRIOR; a null id counts as not held out; repeated rows are scored each; texts of any length are
scored whole; equal texts have equal scores; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from ledgerlens.llm.common import bounded_sample, map_batches, table, text_or_empty, texts, written

ALPHA, BETA, L2, SPARSE = 0.6, 1.0, 0.0, 2.0
SHARDS, SHARD_ROWS, TRAIN_CHARS, ROUNDS, SENT = 8, 3000, 1 << 20, 3, 5
CUT, PRIOR = 0.3, 0.05
#: How many bytes of a longer word are a feature of their own.
STEMS = (4, 5, 6)
#: Features have 31 bits; the bias has a coordinate of its own.
BITS, BIAS = 31, -1
#: Bytes that stand between words, and those in them.
BETWEEN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
NO_WORD = re.compile(r"[\W_]")
STATE = "index int, z double, n double"


def features(text: str) -> np.ndarray:
    """The hashes of the words, pairs and skip-pairs of a text, with repeats, and of the beginnings of its different words."""
    low = text.lower()
    data = low if low.isascii() else NO_WORD.sub(" ", low)
    words = data.encode("utf-8", "surrogatepass").translate(BETWEEN).split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    grams = [h]
    for gap in (1, 2):
        grams.append(h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + (h[gap:] ^ np.uint64(gap)) * np.uint64(0xA24BAED4963EE407))
    different = set(words)
    for k in STEMS:
        begun = {w[:k] for w in different if len(w) > k}
        grams.append(np.fromiter((xxhash.xxh3_64_intdigest(w, k) for w in begun), np.uint64, len(begun)))
    every = np.concatenate(grams)
    every = (every ^ (every >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (every >> np.uint64(64 - BITS)).astype(np.int32)


def weights(z: np.ndarray, n: np.ndarray, l1: np.ndarray | float) -> np.ndarray:
    """The weights of coordinates: 0 where abs(z) <= l1."""
    return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def passed(at: np.ndarray, y: float, z: np.ndarray, n: np.ndarray, l1: np.ndarray) -> None:
    """One step of FTRL-proximal: a row with coordinates at and label y, updating z and n in place."""
    zs, ns = z[at], n[at]
    w = weights(zs, ns, l1[at])
    g = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum())))) - y
    grown = ns + g * g
    z[at] = zs + g - (np.sqrt(grown) - np.sqrt(ns)) / ALPHA * w
    n[at] = grown


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """key, toxic, shard, features of the texts to learn from."""
    key = F.xxhash64(text_or_empty())
    usable = labels.where(F.col("toxic").isin(0, 1) & ~held_out()).select("doc_id", "toxic")
    ids = docs.where(F.length(text_or_empty()) <= TRAIN_CHARS).select("doc_id", key.alias("key"))
    known = written(ids.join(usable, "doc_id").groupBy("key").agg(F.avg("toxic").alias("share"), F.min("doc_id").alias("doc_id")), "toxicity-labels")
    total = known.count()
    drawn = bounded_sample(known, "key", SHARDS * SHARD_ROWS, total).select("doc_id", "key", (F.col("share") >= 0.5).cast("double").alias("toxic"))
    shards = max(1, min(SHARDS, -(-total // SHARD_ROWS)))
    chosen = docs.select("doc_id", text_or_empty().alias("text"), key.alias("key")).join(F.broadcast(drawn), ["doc_id", "key"]).dropDuplicates(["key"])
    dealt = chosen.select("text", "key", "toxic", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"))

    def run(batch: pa.RecordBatch) -> dict:
        found = [np.unique(features(t)) for t in texts(batch)]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        return {c: batch.column(c) for c in ("key", "toxic", "shard")} | {"features": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))}

    return written(map_batches(dealt, run, StructType.fromDDL("key long, toxic double, shard int, features array<int>")), "toxicity-sample")


def threshold(rows: int, toxic: float) -> float:
    """L1 for a shard of so many rows: SPARSE standard deviations of a sum of their gradients."""
    share = (toxic + 1) / (rows + 2)
    return SPARSE * math.sqrt(rows * share * (1 - share))


def learned(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """The coordinates that have a weight, in order, their weights, and the bias."""
    spark = rows.sparkSession
    shards, total, toxic = rows.agg(F.count_distinct("shard"), F.count(F.lit(1)), F.sum("toxic")).first()
    if not total:
        return np.zeros(0, np.int32), np.zeros(0), math.log(PRIOR / (1 - PRIOR))
    l1 = threshold(total / shards, toxic / shards)

    def run(group: pa.Table, state: pa.Table) -> pa.Table:
        order = np.argsort(group.column("key").to_numpy(), kind="stable")
        lists = group.column("features").combine_chunks()
        known = state.column("index").to_numpy()
        # A gradient is below 1, so what stands in fewer rows than that has no weight in this pass and isn't sent after it.
        some, counts = np.unique(lists.values.to_numpy(), return_counts=True)
        coordinates = np.union1d(np.append(known, np.int32(BIAS)), some[counts >= l1 / SENT]).astype(np.int32)
        z, n = np.zeros(len(coordinates)), np.zeros(len(coordinates))
        held = np.searchsorted(coordinates, known)
        z[held], n[held] = state.column("z").to_numpy(), state.column("n").to_numpy()
        limits = np.where(coordinates == BIAS, 0.0, l1)
        toxic = group.column("toxic").to_numpy()
        for k in order:
            found = np.append(np.int32(BIAS), lists[int(k)].values.to_numpy())
            at = np.minimum(np.searchsorted(coordinates, found), len(coordinates) - 1)
            passed(at[coordinates[at] == found], float(toxic[k]), z, n, limits)
        sent = (np.abs(z) >= l1 / SENT) | (coordinates == BIAS)
        return pa.table({"index": pa.array(coordinates[sent], pa.int32()), "z": pa.array(z[sent]), "n": pa.array(n[sent])})

    state = spark.createDataFrame([], STATE)
    each = F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1))).alias("shard")
    present = rows.select("shard").distinct()
    for _ in range(ROUNDS):
        to_shards = state.select("*", each).join(F.broadcast(present), "shard")
        passes = rows.groupBy("shard").cogroup(to_shards.groupBy("shard")).applyInArrow(run, STATE)
        state = written(passes.groupBy("index").agg((F.sum("z") / shards).alias("z"), (F.sum("n") / shards).alias("n")), "toxicity-state")
    kept = state.where((F.abs("z") > l1) | (F.col("index") == BIAS)).orderBy("index").collect()  # the sparse weights, of at most the sample's features
    index, z, n = (np.array(x) for x in zip(*kept, strict=True))
    w = weights(z, n, np.where(index == BIAS, 0.0, l1))
    return index[index != BIAS].astype(np.int32), w[index != BIAS], float(w[index == BIAS].sum())


def held_out() -> Column:
    """Whether a row's labels are kept from learning: crc32 of its id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def scored(docs: DataFrame, keep: list[str], index: np.ndarray, w: np.ndarray, bias: float) -> DataFrame:
    """The columns in keep, score, and how many of the weights a text has (n_hits)."""

    def score(text: str) -> tuple[float, int]:
        found = features(text)
        at = np.searchsorted(index, found)
        at = np.unique(at[(index[np.minimum(at, len(index) - 1)] == found)]) if len(index) else at[:0]
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, bias + w[at].sum())))), len(at)

    def run(batch: pa.RecordBatch) -> dict:
        rows = [score(t) for t in texts(batch)]
        return {c: batch.column(c) for c in keep} | {"score": [round(s, 9) for s, _ in rows], "n_hits": [k for _, k in rows]}

    schema = StructType([*(docs.schema[c] for c in keep), StructField("score", DoubleType()), StructField("n_hits", LongType())])
    return map_batches(docs.select(*keep, "text"), run, schema)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learned(sample(docs, table(spark, sf_dir, "labels")))
    found = scored(docs.withColumn("held_out", held_out()), ["doc_id", "held_out"], *model)
    return found.select("doc_id", F.col("held_out").cast(BooleanType()), "score", (F.col("score") >= CUT).cast(IntegerType()).alias("predicted"), "n_hits")
