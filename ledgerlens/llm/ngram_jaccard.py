"""Similarity join on word shingles with Bayesian candidate pruning.

Every text is a set of shingles of five words (fewer words: one shingle), hashed to 64 bits.
Texts with equal sets form a class; what follows works on one member of each.

1. MinHash values, in BANDS bands of ROWS, put a class into BANDS buckets. A pair at the
   threshold misses all of them with a chance of (1 - 0.8 ** 4) ** 24, about 3.2e-6.
2. Pairs from buckets of at most SMALL classes are compared by their MinHash values, STEP at
   a time: with m of k equal and a uniform prior, the posterior chance that the similarity
   reaches the threshold is that of a binomial tail; below TOLERANCE the pair is dropped. A
   larger bucket is not expanded into pairs: its members are tied to its first one. Of the MinHash
   values two members share at most all but the difference of what they share with the first, so a
   gap in those numbers across which step 2 drops every pair parts the bucket; the part without
   the first is tied to a first of its own and looked at again, PARTINGS times.
3. The connected groups of what is left are dealt out in pairs of blocks of about a twelfth of
   the group, and at most BLOCK members or BLOCK_SHINGLES shingles (but for a longer text), so no
   task holds a whole large group and no pair becomes a row. The pairs of blocks of a group go to
   partitions one after the other. Each task prunes its pairs as above and verifies the rest
   exactly on their shingle sets.

Cases: null text counts as empty; texts without words have no links and are classes of
their own; repeated rows are copies of one another; the similarity of a pair is an exact
fraction, so ties at the threshold count as links; a null id is replaced by a hash of the
text in class_id; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from ledgerlens.llm.common import map_batches, table, text_or_empty, texts, written
from ledgerlens.llm.components import components

WORDS = 5
#: The threshold as a fraction: shared / joint >= 4 / 5.
UP, DOWN = 4, 5
BANDS, ROWS, STEP, TOLERANCE = 24, 4, 16, 1e-6
SMALL, BLOCK, LEAST_BLOCK = 24, 384, 96
BLOCK_SHINGLES = 2_000_000
#: Rows that a task compares, about, and the bits of the filter in front of the join that fetches texts.
ROWS_A_TASK, MOST_BITS = 50_000, 1 << 28
#: How often a large bucket is parted; what is left together after that is compared as one.
PARTINGS = 4
HASHES = BANDS * ROWS


@lru_cache(maxsize=1)
def families() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240501)
    return (draw.integers(1, 1 << 32, HASHES, dtype=np.uint64) | 1).astype(np.uint32), draw.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def shingle_set(text: str) -> np.ndarray:
    """The sorted 64-bit hashes of the shingles of a text."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(WORDS, len(words))
    n = len(words) - size + 1
    w = h[:n].copy()
    for k in range(1, size):
        w = (w ^ (w >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    w ^= w >> np.uint64(32)
    w *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(w)


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    a, b = families()
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(low, (a[:, None] * x[None, at : at + 2048] + b[:, None]).min(axis=1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
    for k in range(ROWS):
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + rows[:, k]
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def set_name(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


@lru_cache(maxsize=1)
def least_equal() -> list[tuple[int, int]]:
    """(k, m): after k values a pair with fewer than m equal ones is dropped."""
    t = UP / DOWN
    out = []
    for k in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1  # P(Bin(k + 1, t) <= m) is the posterior chance of a similarity of t or more
        while tail < TOLERANCE:
            m += 1
            tail += math.comb(k + 1, m) * t**m * (1 - t) ** (k + 1 - m)
        out.append((k, m))
    return out


def plausible(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which rows of two arrays of MinHash values (right may be one row) stay after pruning."""
    alive = np.arange(len(left))
    equal = np.zeros(len(left), np.int32)
    for k, least in least_equal():
        r = right if right.ndim == 1 else right[alive]
        equal = equal + (left[alive, k - STEP : k] == (r[k - STEP : k] if right.ndim == 1 else r[:, k - STEP : k])).sum(axis=1)
        stay = equal >= least
        alive, equal = alive[stay], equal[stay]
        if not len(alive):
            break
    return alive


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, doc_key, text_key and, null for texts without words, set_id, keys (one a band), values (16 bits a hash) and size (shingles)."""
    keyed = docs.select("doc_id", text_or_empty().alias("text")).withColumn("text_key", F.xxhash64("text")).withColumn("doc_key", F.coalesce("doc_id", "text_key"))

    def run(batch: pa.RecordBatch) -> dict:
        sets, keys, values, sizes = [], [], [], []
        for t in texts(batch):
            s = shingle_set(t)
            sizes.append(len(s))
            if not len(s):
                sets.append(None), keys.append(None), values.append(None)
                continue
            low = min_hashes(s)
            sets.append(set_name(s))
            keys.append(band_keys(low))
            values.append(low.astype("<u2").tobytes())
        return {c: batch.column(c) for c in ("doc_id", "doc_key", "text_key")} | {"set_id": sets, "keys": keys, "values": values, "size": sizes}

    fields = [StructField("set_id", BinaryType()), StructField("keys", ArrayType(LongType())), StructField("values", BinaryType()), StructField("size", LongType())]
    return map_batches(keyed, run, StructType([keyed.schema["doc_id"], keyed.schema["doc_key"], keyed.schema["text_key"], *fields]))


def likely(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs without most rows whose doc_key and text_key are not wanted: those whose bit is not set.

    The bits, sixteen for each wanted row and at most MOST_BITS (32 MB), are broadcast in pieces of
    4 KB, so that the join after this shuffles about as many texts as are wanted. With more rows
    than bits nothing is dropped.
    """
    n = wanted.count()
    bits = 1 << 15
    while bits < min(16 * n, MOST_BITS):
        bits *= 2
    if n > bits // 2:
        return docs
    place = F.pmod(F.xxhash64("doc_key", "text_key"), F.lit(bits))
    set_bits = wanted.select(place.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))
    at = docs.withColumn("at", place)
    byte = F.conv(F.hex(F.expr("substring(bitmap, cast(bitmap_bit_position(at) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    on = F.expr("mod(bitmap_bit_position(at), 8)").cast("int")
    joined = at.join(F.broadcast(set_bits), F.bitmap_bucket_number("at") == F.col("piece"))
    kept = joined.where(F.call_function("shiftright", byte, on).bitwiseAND(1) == 1).select(*docs.columns)
    # Always true: it only keeps the optimizer from moving the semi-join that follows in front of this filter.
    return kept.where(F.monotonically_increasing_id() >= 0)


def shingled(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """set_id and shingles (sorted 64-bit hashes) of the documents whose doc_key and text_key are wanted."""
    keyed = docs.select("doc_id", text_or_empty().alias("text")).withColumn("text_key", F.xxhash64("text")).withColumn("doc_key", F.coalesce("doc_id", "text_key"))
    # As many rows are wanted as there are near copies, so they are shuffled at any size, never broadcast.
    held = likely(keyed, wanted).join(wanted.select("doc_key", "text_key").hint("merge"), ["doc_key", "text_key"], "left_semi").dropDuplicates(["doc_key", "text_key"]).select("text")

    def run(batch: pa.RecordBatch) -> dict:
        sets = [shingle_set(t) for t in texts(batch)]
        return {"set_id": [set_name(s) for s in sets], "shingles": [s.tobytes() for s in sets]}

    return map_batches(held, run, StructType([StructField("set_id", BinaryType()), StructField("shingles", BinaryType())]))


def pruned(pairs: DataFrame) -> DataFrame:
    """a, b of the pairs (with left and right values) that stay after pruning."""

    def run(batch: pa.RecordBatch) -> dict:
        left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, HASHES) for c in ("left", "right"))
        alive = pa.array(plausible(left, right))
        return {"a": batch.column("a").take(alive), "b": batch.column("b").take(alive)}

    return map_batches(pairs, run, StructType([StructField("a", BinaryType()), StructField("b", BinaryType())]))


def equal_counts(pairs: DataFrame) -> DataFrame:
    """set_id, first, equal: how many MinHash values are equal in pairs (with left and right values)."""

    def run(batch: pa.RecordBatch) -> dict:
        left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, HASHES) for c in ("left", "right"))
        return {"set_id": batch.column("set_id"), "first": batch.column("first"), "equal": (left == right).sum(axis=1).astype(np.int32)}

    return map_batches(pairs, run, StructType([StructField("set_id", BinaryType()), StructField("first", BinaryType()), StructField("equal", IntegerType())]))


def parted(tied: DataFrame, classes: DataFrame) -> DataFrame:
    """set_id, first: the members of large buckets, with those that pruning keeps apart tied to different firsts.

    Two members that share m and n values with their first share at most HASHES - |m - n| with each
    other. Pruning drops a pair with too few, so no pair across a wide enough gap in these numbers,
    of which a first has HASHES + 1 at most, is a candidate.
    """
    widest = HASHES - least_equal()[-1][1]
    values = classes.select("set_id", "values")
    done, left = [], written(tied.distinct(), "tied")
    for _ in range(PARTINGS):
        met = left.join(values.withColumnRenamed("values", "right"), "set_id").join(values.select(F.col("set_id").alias("first"), F.col("values").alias("left")), "first")
        # The gaps are a table of their own: a bucket may hold a third of the classes, and Spark can only split what is dealt anew.
        counted = written(equal_counts(met), "shared-values")
        seen = counted.groupBy("first").agg(F.sort_array(F.collect_set("equal")).alias("seen"))
        cuts = written(seen.select("first", F.expr(f"filter(seen, (x, i) -> i > 0 and x - seen[i - 1] > {widest})").alias("cuts")).where("size(cuts) > 0"), "cuts")
        if cuts.isEmpty():
            break
        # Without a gap both are 0. The first itself is always in the top level.
        level, top = (F.size(F.coalesce(F.expr(c), F.expr("cast(array() as array<int>)"))) for c in ("filter(cuts, c -> equal >= c)", "cuts"))
        levels = written(counted.join(cuts, "first", "left").select("set_id", "first", level.alias("level"), top.alias("top")), "levels")
        done.append(levels.where("level = top").select("set_id", "first"))
        below = levels.where("level < top").select("set_id", F.col("first").alias("old"), "level")
        heads = written(below.groupBy("old", "level").agg(F.min("set_id").alias("first")), "heads")
        left = written(below.join(heads, ["old", "level"]).select("set_id", "first").distinct(), "tied")
    return reduce(DataFrame.unionByName, done, left)


def candidate_edges(classes: DataFrame) -> DataFrame:
    """a, b: pruned pairs of small buckets, and ties of the members of large ones to their first."""
    placed = classes.select("set_id", F.explode("keys").alias("key"))
    # Both sides of this join are dealt anew from tables, so Spark can split a bucket that holds a third of the classes.
    crowded = written(placed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("set_id").alias("first")).where("size > 1"), "crowded")
    shared = written(placed.join(crowded, "key"), "buckets")
    small = shared.where(F.col("size") <= SMALL).select("key", "set_id")
    other = small.select("key", F.col("set_id").alias("b"))
    pairs = small.join(other, "key").where("set_id < b").select(F.col("set_id").alias("a"), "b").distinct()
    values = classes.select("set_id", "values")
    valued = pairs.join(values.select(F.col("set_id").alias("a"), F.col("values").alias("left")), "a").join(values.select(F.col("set_id").alias("b"), F.col("values").alias("right")), "b")
    # A class is tied to the least of the first members of its large buckets, and that one to the others.
    heads = parted(shared.where(F.col("size") > SMALL).select("set_id", "first"), classes).groupBy("set_id").agg(F.collect_set("first").alias("firsts")).withColumn("b", F.array_min("firsts"))
    own = heads.select(F.col("set_id").alias("a"), "b")
    among = heads.select(F.explode("firsts").alias("a"), "b").distinct()
    return pruned(valued).unionByName(own).unionByName(among.where("a <> b"))


LINKED = StructType([StructField("set_id", BinaryType()), StructField("peer", BinaryType()), StructField("links", LongType())])


def verified(names: list, copies: np.ndarray, blocks: np.ndarray, values: np.ndarray, shingles: list[np.ndarray], within: bool) -> Iterator[tuple]:
    """(set_id, a member of its linked group, number of linked documents) in one pair of blocks.

    within: all pairs; otherwise those between the two blocks.
    """
    m = len(names)
    sizes = np.array([len(s) for s in shingles])
    _, ids = np.unique(np.concatenate(shingles), return_inverse=True)
    ends = np.cumsum(sizes)
    own = [ids[e - n : e] for e, n in zip(ends, sizes, strict=True)]
    mark = np.zeros(int(ids.max()) + 1, np.int32)
    links = np.zeros(m, np.int64)
    root = list(range(m))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(m - 1):
        rest = np.arange(a + 1, m)
        if not within:
            rest = rest[blocks[rest] != blocks[a]]
        # The smaller set can be shared whole at most.
        low, high = np.minimum(sizes[rest], sizes[a]), np.maximum(sizes[rest], sizes[a])
        rest = rest[DOWN * low >= UP * high]
        if len(rest):
            rest = rest[plausible(values[rest], values[a])]
        if not len(rest):
            continue
        mark[own[a]] = 1
        flat = mark[np.concatenate([own[b] for b in rest])]
        shared = np.add.reduceat(flat, np.cumsum(sizes[rest]) - sizes[rest])
        mark[own[a]] = 0
        hit = rest[DOWN * shared >= UP * (sizes[rest] + sizes[a] - shared)]
        links[a] += copies[hit].sum()
        links[hit] += copies[a]
        for b in hit:
            x, y = find(a), find(int(b))
            if x != y:
                root[max(x, y)] = min(x, y)
    for a in np.flatnonzero(links):
        yield names[a], names[find(int(a))], int(links[a])


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From members sorted by pair of blocks, the links of every pair of blocks."""
    arrow = to_arrow_schema(LINKED)
    columns = ("set_id", "copies", "block", "values", "shingles")

    def result(group: list[tuple], key: tuple) -> list[tuple]:
        if len(group) < 2:
            return []
        names, copies, blocks, values, shingles = zip(*group, strict=True)
        table_of = np.frombuffer(b"".join(values), "<u2").reshape(-1, HASHES)
        return list(verified(list(names), np.array(copies, np.int64), np.array(blocks), table_of, [np.frombuffer(s, np.uint64) for s in shingles], key[1] == key[2]))

    now, group = None, []
    for batch in batches:
        done: list[tuple] = []
        keys = zip(*[batch.column(c).to_pylist() for c in ("component", "one", "two")], strict=True)
        for key, row in zip(keys, zip(*[batch.column(c).to_pylist() for c in columns], strict=True), strict=True):
            if key != now:
                done += result(group, now)
                now, group = key, []
            group.append(row)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), arrow, strict=True)], schema=arrow)
    if done := result(group, now):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), arrow, strict=True)], schema=arrow)


def linked(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """set_id, peer, links of the classes with links, a row for each pair of blocks."""
    groups = components(candidate_edges(classes)).select(F.col("node").alias("set_id"), "component")
    own = classes.select("set_id", "copies", "values", "size", "doc_key", "text_key")
    inside = written(groups.join(own, "set_id"), "members")
    # The sizes are a table of their own: a group may hold a third of the classes, and Spark can only split what is dealt anew.
    sizes = inside.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("shingles"))
    each = F.least(F.lit(BLOCK), F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.col("members") / 12)))
    blocks = F.greatest(F.ceil(F.col("members") / each), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    sizes = written(sizes.select("component", "members", blocks.alias("blocks")), "group-sizes")
    members = inside.join(sizes, "component")
    sets = shingled(docs, inside)
    placed = members.join(sets.dropDuplicates(["set_id"]), "set_id").withColumn("block", F.pmod(F.xxhash64("set_id"), "blocks").cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    one, two = F.least("block", "other"), F.greatest("block", "other")
    # Pairs of blocks are numbered along the rows of the upper triangle and dealt out in that order.
    number = one.cast("long") * F.col("blocks") - F.floor(one.cast("long") * (one - 1) / 2) + (two - one)
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (sizes.agg(F.sum(F.col("members") * F.col("blocks"))).first()[0] or 0) // ROWS_A_TASK)
    slot = F.pmod(F.xxhash64("component") + number, F.lit(n)).cast("int")
    keyed = dealt.select("component", one.alias("one"), two.alias("two"), "set_id", "copies", "block", "values", "shingles", slot.alias("slot"))
    return keyed.repartitionById(n, "slot").drop("slot").sortWithinPartitions("component", "one", "two", "set_id").mapInArrow(compare, LINKED)


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, doc_key, text_key, class_key, class_text, n_copies, n_links of every document.

    class_key and class_text name the least document of its group of linked documents.
    """
    marks = written(sketches(docs), "sketches")
    worded = marks.where("set_id is not null")
    least = F.min(F.struct("doc_key", "text_key")).alias("least")
    classes = written(worded.groupBy("set_id").agg(least, F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys"), F.first("values").alias("values"), F.first("size").alias("size")).select("set_id", "copies", "keys", "values", "size", "least", "least.doc_key", "least.text_key"), "classes")
    links = written(linked(docs, classes.drop("least")), "links")
    counts = links.groupBy("set_id").agg(F.sum("links").alias("links"))
    groups = components(links.select(F.col("set_id").alias("a"), F.col("peer").alias("b"))).select(F.col("node").alias("set_id"), "component")
    named = groups.join(classes.select("set_id", "least"), "set_id")
    named = written(named, "named")
    firsts = written(named.groupBy("component").agg(F.min("least").alias("group_least")), "firsts")
    by_set = named.join(firsts, "component").select("set_id", "group_least")
    per_class = classes.select("set_id", "copies", "least").join(by_set, "set_id", "left").join(counts, "set_id", "left")
    per_class = per_class.select(F.col("set_id").alias("of"), "copies", F.coalesce("group_least", "least").alias("head"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    # A class may hold a third of all rows. Read from a table, both sides are dealt anew, so Spark can split it.
    per_class = written(per_class, "class-rows")
    every = marks.select("doc_id", "doc_key", "text_key", "set_id").join(per_class, F.col("set_id") == F.col("of"), "left")
    return every.select("doc_id", "doc_key", "text_key", F.coalesce("head.doc_key", "doc_key").alias("class_key"), F.coalesce("head.text_key", "text_key").alias("class_text"), F.coalesce("copies", F.lit(1).cast("long")).alias("n_copies"), F.coalesce("links", F.lit(0).cast("long")).alias("n_links"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of every document and the number of its links."""
    return joined(table(spark, sf_dir, "documents")).select("doc_id", F.col("class_key").alias("class_id"), "n_copies", "n_links")


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the least id."""
    kept = joined(docs).where("doc_key = class_key and text_key = class_text").select("doc_key", "text_key")
    packed = docs.select(F.struct("*").alias("own_row"), F.xxhash64(text_or_empty()).alias("text_key"), "doc_id")
    keyed = packed.select("own_row", "text_key", F.coalesce("doc_id", "text_key").alias("doc_key"))
    return keyed.join(kept.distinct(), ["doc_key", "text_key"], "left_semi").dropDuplicates(["doc_key", "text_key"]).select("own_row.*")


OP3_SQL = r"""
    with recursive w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
    s as (select distinct doc_id, md5(array_to_string(ws[i : i + 4], ' ')) as g from (select doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) as i from w where len(ws) > 0)),
    n as (select doc_id, count(*) as n, md5(string_agg(g, ',' order by g)) as set_id from s group by doc_id),
    p as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
    l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 5 * k >= 4 * (na.n + nb.n - k)),
    reach as (select a as doc_id, b as other from l union select r.doc_id, l.b from reach r join l on l.a = r.other)
    select d.doc_id, coalesce(least(d.doc_id, (select min(other) from reach r where r.doc_id = d.doc_id)), d.doc_id) as class_id,
        greatest(1, (select count(*) from n x join n y on x.set_id = y.set_id where x.doc_id = d.doc_id)) as n_copies,
        (select count(*) from l where l.a = d.doc_id) as n_links
    from documents d"""
