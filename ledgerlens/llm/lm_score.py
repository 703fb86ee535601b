"""Stupid-backoff scores of documents from n-gram counts of the whole corpus.

Documents are dealt into batches of about BATCH_BYTES of text. A batch counts its own one- and
two-word n-grams and sends each with its count to the partition that its hash names; there the
counts of all batches are summed into the count table of that partition and joined back to the
n-grams of every batch. A batch then looks up each n-gram of its documents and sums per
document. An n-gram travels once for each batch, however often it occurs, so a frequent one is
no hot key, and it travels in packed arrays: 6 bytes of its hash, the others being its
partition. There are as many partitions as batches, up to MOST_PARTITIONS; with more batches than
that the n-grams of a partition are summed in several parts first, so that none grows with the corpus.

A document is scored against all others: its own occurrences are taken off each count. A
word after another scores c(pair) / c(first word) if the pair occurs elsewhere, and
otherwise BACKOFF * c(word) / N; the first word scores c(word) / N. N is the number of words
elsewhere (at least 1), and a word that occurs nowhere else counts UNSEEN.

Cases: null text counts as empty; a text without words has n_words 0 and scores 0; texts of
any length are scored whole, and what a task holds is a batch and its longest text; repeated rows count as documents of their own; a null id is
kept as such; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import table, text_or_empty, texts, written

BACKOFF, UNSEEN = 0.4, 0.5
#: Text in a batch. What a task holds of it is some twenty times as much.
BATCH_BYTES = 8 << 20
#: A partition's number has 16 bits.
MOST_PARTITIONS = 60_000
LOW = np.uint64((1 << 48) - 1)

COUNTS = "batch int, part int, grams binary, counts binary"
TOTALS = "batch int, part int, totals binary"
TABLE = "part int, grams binary, counts binary"
PARTS = "doc_id long, n_words long, n_backoff long, n_single long, log_part double"


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def partitioned(h: np.ndarray, parts: int) -> np.ndarray:
    """Hashes with the partition in the upper 16 bits, so that sorting sorts by partition."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return ((h >> np.uint64(48)) % np.uint64(parts)) << np.uint64(48) | (h & LOW)


class Batch:
    """The n-grams of the documents of one batch."""

    def __init__(self, docs: list[str], parts: int):
        hashes = [hashed(t.encode("utf-8", "surrogatepass").split()) for t in docs]
        self.sizes = np.array([len(h) for h in hashes], np.int64)
        words = np.concatenate(hashes)
        self.doc = np.repeat(np.arange(len(docs)), self.sizes)
        self.first = np.ones(len(words), bool)  # whether a word is the first of its document
        self.first[1:] = self.doc[1:] != self.doc[:-1]
        pairs = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + (words[1:] ^ np.uint64(0xA24BAED4963EE407)) * np.uint64(0x9FB21C651E98DF25)
        self.at = np.flatnonzero(~self.first)  # words that follow another
        every = np.concatenate([partitioned(words, parts), partitioned(pairs[self.at - 1], parts)])
        self.grams, self.inverse, self.counts = np.unique(every, return_inverse=True, return_counts=True)
        self.bounds = np.searchsorted(self.grams, np.arange(parts + 1, dtype=np.uint64) << np.uint64(48))

    def elsewhere(self, totals: np.ndarray, which: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """For each occurrence of an n-gram in a document, its count in other documents."""
        key = doc * np.int64(len(totals)) + which
        _, inverse, own = np.unique(key, return_inverse=True, return_counts=True)
        return totals[which] - own[inverse]

    def scores(self, totals: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each document: words scored without their predecessor and one at the start, and the sum of logs without N."""
        n = len(self.first)
        single = self.elsewhere(totals, self.inverse[:n], self.doc)
        pair = self.elsewhere(totals, self.inverse[n:], self.doc[self.at])
        both = np.zeros(n, np.int64)
        both[self.at] = pair
        before = np.ones(n, np.int64)
        before[self.at] = single[self.at - 1]
        known = both > 0
        log = np.where(known, np.log(np.maximum(both, 1)) - np.log(np.maximum(before, 1)), np.log(np.where(single > 0, single, UNSEEN)) + np.where(self.first, 0.0, math.log(BACKOFF)))
        m = len(self.sizes)
        return np.bincount(self.doc, ~known & ~self.first, m), np.bincount(self.doc, ~known, m), np.bincount(self.doc, log, m)


def counted(docs: DataFrame, parts: int) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        b = Batch(texts(group), parts)
        low = (b.grams & LOW).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        spans = [(p, b.bounds[p], b.bounds[p + 1]) for p in range(parts) if b.bounds[p] < b.bounds[p + 1]]
        batch = group.column("batch")[0].as_py()
        return pa.table({"batch": pa.array([batch] * len(spans), pa.int32()), "part": pa.array([p for p, _, _ in spans], pa.int32()), "grams": pa.array([low[a:z].tobytes() for _, a, z in spans], pa.binary()), "counts": pa.array([b.counts[a:z].astype("<u4").tobytes() for _, a, z in spans], pa.binary())})

    return docs.groupBy("batch").applyInArrow(run, COUNTS)


def unpacked(group: pa.Table) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The hashes and counts of packed rows, and where each row ends."""
    packed = group.column("grams").to_pylist()
    low = np.zeros((sum(map(len, packed)) // 6, 8), np.uint8)
    low[:, :6] = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, 6)
    counts = np.frombuffer(b"".join(group.column("counts").to_pylist()), "<u8" if group.schema.names == ["part", "grams", "counts"] else "<u4").astype(np.int64)
    return low.view("<u8").ravel(), counts, np.cumsum([len(x) // 6 for x in packed])


def totals_of(group: pa.Table, total: np.ndarray, ends: np.ndarray) -> pa.Table:
    starts = np.concatenate([[0], ends[:-1]])
    return pa.table({"batch": group.column("batch"), "part": group.column("part"), "totals": pa.array([total[a:z].astype("<i8").tobytes() for a, z in zip(starts, ends, strict=True)], pa.binary())})


def count_table(group: pa.Table) -> pa.Table:
    """One row with the distinct n-grams of a group and the sums of their counts."""
    grams, counts, _ = unpacked(group)
    distinct, inverse = np.unique(grams, return_inverse=True)
    low = distinct.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    return pa.table({"part": group.column("part").slice(0, 1), "grams": pa.array([low.tobytes()], pa.binary()), "counts": pa.array([np.bincount(inverse, counts).astype("<u8").tobytes()], pa.binary())})


def summed(counts: DataFrame, partitions: int, portions: int) -> DataFrame:
    """The count table of each partition, joined to the n-grams of each batch."""

    def run(group: pa.Table) -> pa.Table:
        grams, own, ends = unpacked(group)
        _, inverse = np.unique(grams, return_inverse=True)
        return totals_of(group, np.bincount(inverse, own)[inverse], ends)

    def found(group: pa.Table, tables: pa.Table) -> pa.Table:
        grams, _, ends = unpacked(group)
        known, sums, _ = unpacked(tables.select(["part", "grams", "counts"]))
        return totals_of(group, sums[np.searchsorted(known, grams)], ends)

    if portions == 1:
        return counts.repartition(partitions, "part").groupBy("part").applyInArrow(run, TOTALS)
    dealt = written(counts.withColumn("portion", F.pmod("batch", F.lit(portions))), "lm-counts")
    n = partitions * portions
    some = dealt.repartition(n, "part", "portion").groupBy("part", "portion").applyInArrow(count_table, TABLE)
    whole = some.repartition(partitions, "part").groupBy("part").applyInArrow(count_table, TABLE)
    spread = whole.withColumn("portion", F.explode(F.sequence(F.lit(0), F.lit(portions - 1))))
    return dealt.repartition(n, "part", "portion").groupBy("part", "portion").cogroup(spread.repartition(n, "part", "portion").groupBy("part", "portion")).applyInArrow(found, TOTALS)


def looked_up(docs: DataFrame, totals: DataFrame, parts: int, batches: int) -> DataFrame:
    """For each document its counts and the sum of logs, from the totals of its batch's n-grams."""

    def run(group: pa.Table, found: pa.Table) -> pa.Table:
        b = Batch(texts(group), parts)
        order = sorted(zip(found.column("part").to_pylist(), found.column("totals").to_pylist(), strict=True))
        total = np.frombuffer(b"".join(t for _, t in order), "<i8")
        if len(total) != len(b.grams):
            raise ValueError("the totals do not match the n-grams of their batch")
        n_backoff, n_single, log = b.scores(total)
        return pa.table({"doc_id": group.column("doc_id"), "n_words": b.sizes, "n_backoff": n_backoff.astype(np.int64), "n_single": n_single.astype(np.int64), "log_part": log.astype(np.float64)})

    return docs.groupBy("batch").cogroup(totals.repartition(batches, "batch").groupBy("batch")).applyInArrow(run, PARTS)


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_backoff, log_score and mean_log of every document."""
    text = text_or_empty()
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    batches = max(1, -(-size // BATCH_BYTES))
    partitions = min(batches, MOST_PARTITIONS)
    dealt = docs.select("doc_id", text.alias("text"), F.pmod(F.xxhash64("doc_id", text), F.lit(batches)).cast("int").alias("batch")).repartition(batches, "batch")
    totals = summed(counted(dealt, partitions), partitions, -(-batches // MOST_PARTITIONS))
    parts = written(looked_up(dealt, totals, partitions, batches), "lm-parts")
    words = parts.agg(F.sum("n_words")).first()[0] or 0
    elsewhere = F.greatest(F.lit(words) - F.col("n_words"), F.lit(1)).cast("double")
    log = F.col("log_part") - F.col("n_single") * F.log(elsewhere)
    return parts.select("doc_id", "n_words", "n_backoff", F.round(log, 4).alias("log_score"), F.round(log / F.greatest("n_words", F.lit(1)), 6).alias("mean_log"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document against all others."""
    return scored(table(spark, sf_dir, "documents"))


OP6_SQL = rf"""
    with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
    o as (select doc_id, i, ws[i] as word, case when i > 1 then ws[i - 1] end as prev from (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from w)),
    u as (select word, count(*) as c from o group by 1), ud as (select doc_id, word, count(*) as c from o group by 1, 2),
    b as (select prev, word, count(*) as c from o where prev is not null group by 1, 2), bd as (select doc_id, prev, word, count(*) as c from o where prev is not null group by 1, 2, 3),
    t as (select o.doc_id, o.i, u.c - ud.c as single, b.c - bd.c as pair, pu.c - pd.c as before
        from o join u using (word) join ud using (doc_id, word) left join b on b.prev = o.prev and b.word = o.word left join bd on bd.doc_id = o.doc_id and bd.prev = o.prev and bd.word = o.word
        left join u pu on pu.word = o.prev left join ud pd on pd.doc_id = o.doc_id and pd.word = o.prev),
    s as (select doc_id, len(ws) as n_words, greatest((select count(*) from o) - len(ws), 1)::double as rest from w),
    l as (select t.doc_id, sum(case when coalesce(pair, 0) > 0 then ln(pair) - ln(before) else ln(case when single > 0 then single else {UNSEEN} end) + case when i > 1 then ln({BACKOFF}) else 0 end - ln(rest) end) as lg,
        count(*) filter (where i > 1 and coalesce(pair, 0) = 0) as n_backoff from t join s using (doc_id) group by t.doc_id)
    select s.doc_id, cast(n_words as bigint) as n_words, coalesce(n_backoff, 0) as n_backoff, round(coalesce(lg, 0), 4) as log_score, round(coalesce(lg, 0) / greatest(n_words, 1), 6) as mean_log from s left join l using (doc_id)"""
