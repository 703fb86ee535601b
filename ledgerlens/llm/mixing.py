"""Mixing sources to target weights by Poisson replication.

The rate of a source is its target share of the characters over the characters it has, so
the expected output of all sources has the target weights. How often a document is taken
is a Poisson number with that mean: a hash of the seed and the document's id gives a
uniform number, looked up in the cumulative distribution of its source. Each document is
exploded by its count and all copies are dealt out by a hash and sorted by it.

Cases: a null source is a source of its own, as is the empty one, with which it is counted;
null text counts as empty; each document counts one character more than its text, so no
source is empty; rows with the same id have the same count, rows with a null id are told
apart by their text; a source without a weight gets none; empty tables give empty results;
columns of the input named like those added here are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import table, text_or_empty, written

SEED, EPOCHS = "mix-1", 1.0
HEX, SCALE = 13, float(1 << 52)


def log_factorial(k: Column) -> Column:
    """ln k!, from the factorial up to 20 and by Stirling's series beyond."""
    x = k.cast("double")
    series = x * F.log(x) - x + F.log(x * 6.283185307179586) / 2 + 1 / (x * 12) - 1 / (x * x * x * 360)
    return F.when(k <= 20, F.log(F.factorial(F.least(k, F.lit(20))).cast("double"))).otherwise(series)


def rates(docs: DataFrame, weights: dict[str, float] | None, epochs: float, source: str) -> DataFrame:
    """mix_source, rate: the mean number of copies of a source's documents."""
    sizes = docs.groupBy(F.coalesce(F.col(source), F.lit("")).alias("mix_source")).agg(F.sum(F.length(text_or_empty()) + 1).alias("size"))
    sizes = written(sizes, "mix-sizes")
    total, n = sizes.agg(F.sum("size"), F.count(F.lit(1))).first()
    if weights is None:
        weight = F.lit(1.0 / max(n, 1))
    else:
        given = sum(weights.values())
        table_of = sizes.sparkSession.createDataFrame([(k or "", w / given) for k, w in weights.items()], "mix_source string, weight double")
        sizes = sizes.join(table_of, "mix_source")
        weight = F.col("weight")
    return sizes.select("mix_source", (weight * float(total or 0) * epochs / F.col("size")).alias("rate"))


def distributions(rate: DataFrame) -> DataFrame:
    """mix_source, least, cdf: P(N <= least + i) at i. What lies outside has a chance under 1e-15."""
    wide = F.sqrt("rate") * 12 + 30
    low = F.greatest(F.lit(0), F.floor(F.col("rate") - wide)).cast("int")
    terms = rate.where("rate > 0").select("mix_source", "rate", low.alias("least"), F.explode(F.sequence(low, F.ceil(F.col("rate") + wide).cast("int"))).alias("k"))
    chance = F.exp(F.col("k") * F.log("rate") - F.col("rate") - log_factorial(F.col("k")))
    running = F.sum(chance).over(Window.partitionBy("mix_source").orderBy("k"))
    return terms.select("mix_source", "least", running.alias("cdf")).groupBy("mix_source", "least").agg(F.array_sort(F.collect_list("cdf")).alias("cdf"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, HEX), 16, 10).cast("double") / SCALE


def drawn(docs: DataFrame, weights: dict[str, float] | None, epochs: float, seed: str, source: str) -> DataFrame:
    """own_row (a document's columns), n_copies, copy and mix_order of every copy, in a random order."""
    shares = written(distributions(rates(docs, weights, epochs, source)), "mix-rates")
    ident = F.coalesce(F.col("doc_id").cast("string"), F.md5(text_or_empty()))
    packed = docs.select(F.struct("*").alias("own_row"), ident.alias("ident"), F.coalesce(F.col(source), F.lit("")).alias("mix_source"))
    count = F.col("least") + F.size(F.filter("cdf", lambda c: c <= F.col("u")))
    counted = packed.join(shares, "mix_source").withColumn("u", uniform(F.lit(seed), F.col("ident"))).select("own_row", "ident", count.cast("long").alias("n_copies")).where("n_copies > 0")
    copies = counted.select("own_row", "ident", "n_copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))).alias("copy"))
    ordered = copies.select("own_row", "n_copies", "copy", F.md5(F.concat_ws(":", F.lit(seed), "ident", "copy")).alias("mix_order"))
    return ordered.repartition("mix_order").sortWithinPartitions("mix_order")


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = EPOCHS, seed: str = SEED, source: str = "source") -> DataFrame:
    """The documents, each as often as drawn, in a random order, with copy, n_copies and mix_order."""
    own = [f"own_row.{c}" for c in docs.columns if c not in ("copy", "n_copies", "mix_order")]
    return drawn(docs, weights, epochs, seed, source).select(*own, "n_copies", "copy", "mix_order")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents mixed to equal shares of their sources."""
    return mixed(table(spark, sf_dir, "documents"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents it is given, mixed to equal shares of their sources."""
    return drawn(docs, None, EPOCHS, SEED, "source").select("own_row.*")


OP5_SQL = f"""
    with sizes as (select coalesce(source, '') as k, sum(length(coalesce(text, '')) + 1) as size from documents group by 1),
    rates as (select k, (1.0::double / (select count(*) from sizes)) * (select sum(size) from sizes)::double * {EPOCHS}::double / size as rate from sizes),
    bounds as (select k, rate, cast(greatest(0, floor(rate - sqrt(rate) * 12 - 30)) as int) as least, cast(ceil(rate + sqrt(rate) * 12 + 30) as int) as most from rates where rate > 0),
    terms as (select k, least, rate, unnest(range(least, most + 1)) as j from bounds),
    cdf as (select k, least, j, sum(exp(j * ln(rate) - rate - lgamma(j + 1))) over (partition by k order by j) as c from terms),
    lists as (select k, least, list(c order by j) as cs from cdf group by k, least),
    drawn as (select d.*, least + len(list_filter(cs, lambda x: x <= ('0x' || substr(md5('{SEED}:' || coalesce(cast(doc_id as varchar), md5(coalesce(text, '')))), 1, {HEX}))::bigint / {SCALE})) as n_copies
        from documents d join lists on k = coalesce(source, ''))
    select doc_id, text, lang, source, n_chars, n_copies, copy, md5('{SEED}:' || coalesce(cast(doc_id as varchar), md5(coalesce(text, ''))) || ':' || copy) as mix_order
    from (select *, unnest(range(1, n_copies + 1)) as copy from drawn where n_copies > 0)"""
