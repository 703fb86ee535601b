"""How far the word use of sources diverges, source against source and source against language.

Terms are counted in one scan, summed in the task per (language, source) until it holds FLUSH of them. One
shuffle by (language, term) sums the counts and drops terms of fewer than MIN_DOCS documents. What a
language keeps is dealt to shards of about SHARD_TERMS terms by a hash, and numbered within its shard
in the order of the terms; a group (language and source) has one row a shard: its sorted term ids with their p.

Pairs: sources of a language are dealt to panels of PANEL. A task gets, for one shard, the arrays of two
panels (or of one) and merges every unordered pair of groups that meet there and nowhere else:
both shares where a term occurs in both groups, found by galloping search of the shorter array in the longer one,
one group's share against the other's share of an absent term where it occurs in one, and the terms absent in both by their number.
f is symmetric, so a pair is priced once and reported both ways; shards are summed by pair. So an array travels
once for each panel, not for each source, and no task holds more than 2 * PANEL arrays of one shard.

All arithmetic is exact: shares are decimals of 38 digits divided whole, squares of differences fit a long.

Cases: null text, language and source count as ''; groups without terms take part with count 0; a language
without kept terms has value 0 for all pairs and no terms; a source alone in its language has no pairs; ties are ordered
by the item's UTF-8 bytes; repeated rows are documents of their own; texts of any length count whole; empty
tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import table, text_or_empty, written

MIN_DOCS, TOP, UNIT = 10, 10, 1_000_000_000
FLUSH, SHARD_TERMS, PANEL = 300_000, 20_000, 8

#: A-Z in lower case, other letters and bytes from 128 on as they are, all else a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
COUNTED = "lang string, source string, term string, n long, docs long"
PRICED = "lang string, a string, b string, value long"


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents of terms, summed within tasks. A group's null term counts none."""

    def rows(held: dict[tuple, tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in held.items():
            terms = list(n)
            own = [pa.array([lang] * (len(terms) + 1)), pa.array([source] * (len(terms) + 1))]
            words = pa.array([*terms, None], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*own, words, pa.array([*n.values(), 0], pa.int64()), pa.array([*map(d.__getitem__, terms), 0], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                own = Counter(text.translate(LETTERS).split())
                n.update(own)
                d.update(own.keys())
                size += len(n) - before
                if size >= FLUSH:
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)

    cleaned = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")], text_or_empty().cast("binary").alias("text"))
    return cleaned.mapInArrow(run, COUNTED)


def whole_share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 * v)), exactly."""
    top = (n + 2).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", top, (total + v * 2).cast("decimal(20,0)")) + 1


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of whole numbers up to UNIT + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


class Terms:
    """The kept terms of each language and group, written once."""

    def __init__(self, docs: DataFrame):
        counts = counted(docs)
        by_term = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        # One row of each group has a null term; it stays, so that groups without terms do.
        enough = by_term.withColumn("df", F.sum("docs").over(Window.partitionBy("lang", "term"))).where((F.col("df") >= MIN_DOCS) | F.col("term").isNull())
        every = written(enough.select("lang", "source", "term", "n"), "divergence-counts")
        self.counts = every.where("term is not null")
        groups = every.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        self.v = written(self.counts.groupBy("lang").agg(F.count_distinct("term").alias("v")), "divergence-kept")
        self.groups = written(groups.join(self.v, "lang", "left").select("lang", "source", "total", F.coalesce("v", F.lit(0)).cast("long").alias("v")), "divergence-groups")
        self.langs = self.groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("v").alias("v"))


def galloped(small: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in small and in large of the ids that stand in both; both are sorted, small is the shorter."""
    at = np.searchsorted(large, small)
    hit = large[np.minimum(at, len(large) - 1)] == small if len(large) else np.zeros(len(small), bool)
    return np.flatnonzero(hit), at[hit]


def f(p: np.ndarray, q: np.ndarray | int) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def priced(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int], terms: int) -> int:
    """The distance of two groups over the terms of a shard: each has term ids, their p, and its p of an absent term."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    (ids, p, p0), (others, q, q0) = a, b
    i, j = galloped(ids, others)
    one, two = f(p, q0), f(q, p0)
    both = len(ids) + len(others) - len(i)
    absent = (terms - both) * int(f(np.int64(p0), np.int64(q0)))
    return int(f(p[i], q[j]).sum() + one.sum() - one[i].sum() + two.sum() - two[j].sum()) + absent


def arrays(terms: Terms) -> DataFrame:
    """lang, source, shard, terms (how many the shard has), ids, ps, p0, panel of every group and shard of its language."""
    shards = F.greatest(F.ceil(F.col("v") / SHARD_TERMS), F.lit(1)).cast("int")
    sized = terms.v.select("lang", shards.alias("shards"))
    placed = terms.counts.select("lang", "term").distinct().join(sized, "lang").select("lang", "term", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"))
    ids = written(placed.withColumn("id", F.row_number().over(Window.partitionBy("lang", "shard").orderBy("term"))), "divergence-ids")
    p = whole_share(F.col("n"), F.col("total"), F.col("v"))
    shares = terms.counts.join(terms.groups, ["lang", "source"]).select("lang", "source", "term", p.alias("p"))
    lists = shares.join(ids, ["lang", "term"]).groupBy("lang", "source", "shard").agg(F.array_sort(F.collect_list(F.struct("id", "p"))).alias("own"))
    sizes = ids.groupBy("lang", "shard").agg(F.count(F.lit(1)).alias("terms"))
    p0 = F.when(F.col("v") > 0, whole_share(F.lit(0).cast("long"), F.col("total"), F.greatest("v", F.lit(1))))
    every = terms.groups.join(sizes, "lang").select("lang", "source", "shard", "terms", p0.alias("p0"))
    panels = F.greatest(F.ceil(F.col("sources") / PANEL), F.lit(1)).cast("int")
    dealt = terms.groups.select("lang", "source", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("place"))
    dealt = dealt.join(terms.groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")), "lang").select("lang", "source", F.floor(F.col("place") / PANEL).cast("int").alias("panel"), panels.alias("panels"))
    full = every.join(lists, ["lang", "source", "shard"], "left").join(dealt, ["lang", "source"])
    own = F.coalesce("own", F.array().cast("array<struct<id:int,p:long>>"))
    return full.select("lang", "source", "shard", "terms", "p0", "panel", "panels", own.getField("id").alias("ids"), own.getField("p").alias("ps"))


def pair_values(terms: Terms) -> DataFrame:
    """lang, a, b, value of every unordered pair of a language's sources that have kept terms to price."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.select(["source", "panel", "p0", "ids", "ps"]).combine_chunks()
        held = []
        for k in range(rows.num_rows):
            held.append((rows.column("source")[k].as_py(), rows.column("panel")[k].as_py(), (rows.column("ids")[k].values.to_numpy(), rows.column("ps")[k].values.to_numpy(), rows.column("p0")[k].as_py())))
        first, last = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        n = group.column("terms")[0].as_py()
        out = []
        for i, (a, pa_, x) in enumerate(held):
            for b, pb, y in held[i + 1 :]:
                # Pairs within a panel are priced where the panel stands alone.
                if first == last or pa_ != pb:
                    out.append((min(a, b), max(a, b), priced(x, y, n)))
        lang = group.column("lang")[0].as_py()
        return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "a": pa.array([o[0] for o in out], pa.string()), "b": pa.array([o[1] for o in out], pa.string()), "value": pa.array([o[2] for o in out], pa.int64())})

    meets = F.explode(F.sequence(F.lit(0), F.col("panels") - 1)).alias("other")
    sent = arrays(terms).select("*", meets).select("lang", "source", "shard", "terms", "p0", "panel", "ids", "ps", F.least("panel", "other").alias("low"), F.greatest("panel", "other").alias("high"))
    return sent.groupBy("lang", "shard", "low", "high").applyInArrow(run, PRICED).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def pair_part(terms: Terms) -> DataFrame:
    """lang, source, item, value: every other source of the language of each source."""
    priced_pairs = written(pair_values(terms), "divergence-pairs")
    ways = priced_pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(priced_pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    none = terms.groups.where("v = 0").select("lang", "source")
    zero = none.join(none.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    return ways.unionByName(zero)


def term_part(terms: Terms) -> DataFrame:
    """lang, source, item, value, rank: the terms that a group uses most beyond its language, ranks to TOP."""
    whole = terms.counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n")).join(terms.langs.select("lang", F.col("total").alias("all_total"), F.col("v").alias("all_v")), "lang")
    q = whole.select("lang", "term", whole_share(F.col("all_n"), F.col("all_total"), F.col("all_v")).alias("q"))
    own = terms.counts.where("n > 0").join(terms.groups, ["lang", "source"]).select("lang", "source", "term", whole_share(F.col("n"), F.col("total"), F.col("v")).alias("p"))
    over = own.join(q, ["lang", "term"]).where("p > q").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return over.withColumn("rank", place).where(F.col("rank") <= TOP)


def divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank of every group."""
    terms = Terms(docs)
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_part(terms).withColumn("rank", place)
    both = pairs.withColumn("part", F.lit("pair")).unionByName(term_part(terms).withColumn("part", F.lit("term")))
    return both.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The divergence of the sources of all documents."""
    return divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP13_SQL = rf"""
    with d as (select row_number() over () as id, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
    w as (select id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d),
    kept as (select lang, term from w group by 1, 2 having count(distinct id) >= {MIN_DOCS}),
    v as (select lang, count(*) as v from kept group by 1),
    c as (select lang, source, term, count(*) as n from w join kept using (lang, term) group by 1, 2, 3),
    g as (select lang, source, coalesce(v, 0) as v, coalesce(total, 0) as total from (select distinct lang, source from d) left join v using (lang) left join (select lang, source, sum(n) as total from c group by 1, 2) using (lang, source)),
    p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, cast(1 + ({UNIT}::hugeint * (coalesce(c.n, 0) + 2)) // (g.total + 2 * g.v)::hugeint as bigint) as p from g join kept k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
    q as (select lang, term, cast(1 + ({UNIT}::hugeint * (sum(n) + 2)::hugeint) // ((select sum(total) from g where g.lang = p.lang) + 2 * (select v.v from v where v.lang = p.lang))::hugeint as bigint) as q from p group by 1, 2),
    pair as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0) as bigint) as value
        from g a join g b on a.lang = b.lang and a.source <> b.source left join p x on x.lang = a.lang and x.source = a.source left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term group by 1, 2, 3, 4),
    term as (select p.lang, source, 'term' as part, p.term as item, cast(((p - q) * (p - q)) // (p + q) as bigint) as value from p join q using (lang, term) where n > 0 and p > q)
    select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank from (select * from pair union all select * from term)
    qualify part = 'pair' or rank <= {TOP}"""
