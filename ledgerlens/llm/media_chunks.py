"""Media columns stored as content-defined chunks.

A payload is cut where a rolling gear hash of its last 32 bytes has its top bits clear, so
equal stretches of different payloads give equal chunks. Chunks are stored once for each
digest; a payload's stored form is its ordered chunk list. Reading joins the
list with the chunk store, checks each chunk against its digest, and puts the payload
together chunk by chunk in order, never whole in memory.

A chunk in more than HOT_ROWS rows, and in more than one of HOT_MOST of all, is stored once more for each
so many rows, its replicas, so that a chunk that a third of all rows share is read by many
tasks. There are at most HOT_MOST such chunks at any size, which are broadcast by digest.

Cases: null text counts as empty (a payload of 576 bytes of 255); texts of any length are
stored whole; rows with the same id or the same text are kept apart by a row number (row), which
also names their replica and so must be the same each time docs is read; other columns of the
input are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from ledgerlens.llm.common import table, texts, written

FRAME, HOT_ROWS, HOT_MOST = 576, 500, 20_000
LEAST, MOST, BITS = 1024, 16384, 12
MAGIC = b"CHNK\x01"


@lru_cache(maxsize=1)
def gears() -> np.ndarray:
    """A fixed 32-bit value for each byte: the start of the SHA-256 of the byte."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of the gears of the last 32 bytes, each shifted by its distance."""
    h = gears()[data]
    width = 1
    while width < 32:
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint32(width)
        h = longer
        width *= 2
    return h


def cuts(payload: bytes) -> list[int]:
    """The ends of the chunks, each from LEAST to MOST bytes but for the last."""
    n = len(payload)
    ends, at = [], 0
    if n > LEAST:
        marks = np.flatnonzero(rolling(np.frombuffer(payload, np.uint8)) >> np.uint32(32 - BITS) == 0) + 1
        while n - at > LEAST:
            k = int(np.searchsorted(marks, at + LEAST))
            end = min(int(marks[k]) if k < len(marks) else n, at + MOST, n)
            ends.append(end)
            at = end
    return ends if at == n else [*ends, n]


def padded(text: str) -> tuple[int, bytes]:
    data = text.encode("utf-8", "surrogatepass")
    short = -len(data) % FRAME if data else FRAME
    return len(data), data + b"\xff" * short


LISTED = StructType(
    [StructField("doc_id", LongType()), StructField("row", LongType()), StructField("n_bytes", LongType()), StructField("n_chunks", IntegerType()), StructField("ord", IntegerType())]
    + [StructField("digest", BinaryType()), StructField("size", IntegerType())]
)
STORED = StructType([*LISTED, StructField("packed", BinaryType())])


def chunked(docs: DataFrame, schema: StructType) -> DataFrame:
    """The chunks of every row's payload: with their bytes if the schema has packed, else only listed."""
    with_bytes = "packed" in schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, pack = to_arrow_schema(schema), zstandard.ZstdCompressor(level=3, write_checksum=False).compress
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc, row, text in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), texts(batch), strict=True):
                n, payload = padded(text)
                ends = cuts(payload)
                for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
                    part = payload[a:b]
                    rows.append((doc, row, n, len(ends), k, hashlib.sha256(part).digest(), b - a, *([pack(part)] if with_bytes else [])))
                held += len(payload)
                if held > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return docs.select("doc_id", "row", "text").mapInArrow(run, schema)


RESULT = StructType(
    [StructField("doc_id", LongType()), StructField("n_bytes", LongType()), StructField("payload_bytes", LongType()), StructField("payload_sha256", StringType()), StructField("tail_crc32", LongType())]
    + [StructField("media_bytes", LongType()), StructField("media_sha256", StringType()), StructField("feature", StringType()), StructField("verified", LongType())]
)


class Reader:
    """One payload, as its chunks come in order."""

    def __init__(self, doc: int, n: int, chunks: int):
        self.doc, self.n, self.chunks = doc, n, chunks
        self.payload, self.tail, self.size, self.sum, self.seen, self.largest = hashlib.sha256(), b"", 0, 0, 0, 0
        self.media = hashlib.sha256(head := MAGIC + n.to_bytes(8, "little") + chunks.to_bytes(4, "little"))
        self.media_bytes = len(head)

    def add(self, k: int, digest: bytes, size: int, packed: bytes, unpack) -> None:
        part = unpack(packed, max_output_size=size)
        if k != self.seen or len(part) != size or hashlib.sha256(part).digest() != digest:
            raise ValueError(f"chunk {k} of document {self.doc} does not match its list")
        self.payload.update(part)
        self.tail = (self.tail + part[-32:])[-32:]
        self.size += size
        self.sum += int(np.frombuffer(part, np.uint8).sum(dtype=np.int64))
        self.largest = max(self.largest, size)
        self.seen += 1
        entry = digest + size.to_bytes(4, "little")
        self.media.update(entry)
        self.media_bytes += len(entry)

    def result(self) -> tuple:
        if self.seen != self.chunks:
            raise ValueError(f"document {self.doc} has {self.seen} of {self.chunks} chunks")
        feature = f"chunks={self.chunks};largest={self.largest};bytesum={self.sum}"
        return self.doc, self.n, self.size, self.payload.hexdigest(), zlib.crc32(self.tail), self.media_bytes, self.media.hexdigest(), feature, self.seen


PIECE = ["row", "n_chunks", "ord", "digest", "size", "packed"]
#: A result, or a piece of one that needs more of them.
PART = StructType([*RESULT, *[f for f in STORED if f.name in PIECE]])


def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payloads of one chunk as results; the chunks of the others as they are."""
    arrow, unpack = to_arrow_schema(PART), zstandard.ZstdDecompressor().decompress
    for batch in batches:
        rows = []
        for doc, n, row, chunks, k, digest, size, packed in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", *PIECE)], strict=True):
            if packed is None:
                raise ValueError(f"chunk {k} of document {doc} is not in the store")
            if chunks == 1:
                one = Reader(doc, n, 1)
                one.add(k, digest, size, packed, unpack)
                rows.append((*one.result(), row, 1, 0, None, None, None))
            else:
                rows.append((doc, n, *[None] * (len(RESULT) - 2), row, chunks, k, digest, size, packed))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From results and pieces sorted by row and ord, a result for each row."""
    arrow, unpack = to_arrow_schema(RESULT), zstandard.ZstdDecompressor().decompress
    now, row = None, None
    for batch in batches:
        done = []
        columns = [batch.column(f.name).to_pylist() for f in PART]
        for x in zip(*columns, strict=True):
            r, chunks, k, digest, size, packed = x[len(RESULT) :]
            if packed is None:
                done.append(x[: len(RESULT)])
                continue
            if now is None or r != row:
                if now is not None:
                    done.append(now.result())
                now, row = Reader(x[0], x[1], chunks), r
            now.add(k, digest, size, packed, unpack)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), arrow, strict=True)], schema=arrow)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(now.result(), arrow, strict=True)], schema=arrow)


def chunk_lists(docs: DataFrame) -> DataFrame:
    """The ordered chunk list of every row."""
    return chunked(docs, LISTED)


def hot_chunks(lists: DataFrame) -> DataFrame:
    """digest, replicas of the chunks that so many rows hold that one task should not read them all."""
    limit = max(HOT_ROWS, lists.count() // HOT_MOST)
    counted = lists.groupBy(F.col("digest").alias("hot_digest")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    return counted.select("hot_digest", F.ceil(F.col("n") / limit).cast("int").alias("replicas"))


def dealt(chunks: DataFrame, hot: DataFrame) -> DataFrame:
    """chunks with the replica that their row reads."""
    joined = chunks.join(F.broadcast(hot), F.col("digest") == F.col("hot_digest"), "left")
    return joined.withColumn("replica", F.pmod(F.xxhash64("row"), F.coalesce("replicas", F.lit(1))).cast("int")).drop("hot_digest", "replicas")


def chunk_store(docs: DataFrame, hot: DataFrame) -> DataFrame:
    """digest, replica, packed: every chunk once for each replica that a row with it is dealt to."""
    return dealt(chunked(docs, STORED), hot).select("digest", "replica", "packed").dropDuplicates(["digest", "replica"])


def rebuilt(lists: DataFrame, store: DataFrame) -> DataFrame:
    """The payloads of the lists, read from the store and verified, as digests and features."""
    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = lists.join(store, ["digest", "replica"], "left").mapInArrow(settled, PART)
    return parts.repartition(n, "row").sortWithinPartitions("row", "ord").mapInArrow(read_back, RESULT)


def op10_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as chunks and read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    lists = written(chunk_lists(docs), "chunk-lists")
    hot = written(hot_chunks(lists), "chunk-hot")
    return rebuilt(dealt(lists, hot), chunk_store(docs, hot)).drop("verified")
