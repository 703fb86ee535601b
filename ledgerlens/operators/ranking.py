"""Order, budgets and the best few of each group."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ledgerlens.operators.predicates import severity_rank
from ledgerlens.sources.shared import checkpointed


def case_order(cases: DataFrame) -> DataFrame:
    """Runnable cases first, then by severity, then as the catalogue has them."""
    blocked = F.coalesce(F.col("blocked"), F.lit("")) != ""
    place = F.row_number().over(Window.partitionBy("repo").orderBy(blocked, severity_rank(F.col("severity")), "ord"))
    return cases.withColumn("place", place)


def first_fit(df: DataFrame, keys: list[str], order: list[str], weight: str, budget: Column) -> DataFrame:
    """df with place, taken and spent: in order, what overflows the budget is passed over and later, smaller ones may still fit.

    spent is what was taken before. A budget of 0 is no limit; place counts from 1. What is taken
    depends on all that was taken before, so the rows of one key go through one task, in order and
    one by one; nothing of them is held.
    """
    ready = df.withColumn("_budget", budget.cast("long")).repartition(*keys).sortWithinPartitions(*keys, *order)
    own = df.columns
    schema = StructType([*df.schema, StructField("place", LongType()), StructField("taken", BooleanType()), StructField("spent", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        now, spent, place = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            more: tuple[list, list, list] = ([], [], [])
            of = zip(*[batch.column(k).to_pylist() for k in keys], strict=True)
            for key, w, limit in zip(of, batch.column(weight).to_pylist(), batch.column("_budget").to_pylist(), strict=True):
                if key != now:
                    now, spent, place = key, 0, 0
                place += 1
                fit = not limit or spent + (w or 0) <= limit
                for column, x in zip(more, (place, fit, spent), strict=True):
                    column.append(x)
                spent += (w or 0) if fit else 0
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], *[pa.array(x, f.type) for x, f in zip(more, list(arrow)[-3:], strict=True)]], schema=arrow)

    return ready.mapInArrow(run, schema)


def ordered(df: DataFrame, keys: list[str], order: list[str], distinct: bool = False) -> DataFrame:
    """df with _id, which ascends by keys and order, checkpointed: rows of one key may lie in many parts. With distinct each row stays once; keys and order are all columns then."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *keys, *order)
    # Equal rows lie in one part already, so they need not be shuffled again.
    dealt = dealt.distinct() if distinct else dealt
    # Whole ids: the number of the part in the upper bits, the place in it in the lower 33.
    return checkpointed(dealt.sortWithinPartitions(*keys, *order).withColumn("_id", F.monotonically_increasing_id()))


def before(laid: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """laid, as ordered has left it, with the sums over the rows of the same key that come before a row.

    Sums run within a part, and what the parts before have of a key is added: of that there is one row
    for each key and part.
    """
    parted = laid.withColumn("_part", F.shiftrightunsigned("_id", 33))
    within = Window.partitionBy(*keys, "_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    part = parted.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = part.select(*keys, "_part", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums])
    ran = parted.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"_own_{n}") for n, c in sums.items()])
    # Keys may be null, which an ordinary join would drop.
    same = reduce(Column.__and__, [F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in [*keys, "_part"]])
    joined = ran.alias("r").join(offsets.alias("o"), same)
    return joined.select(*[f"r.{c}" for c in laid.columns], *[(F.col(f"r._own_{n}") + F.col(f"o._{n}")).alias(n) for n in sums])


def counted(laid: DataFrame, keys: list[str], name: str) -> DataFrame:
    """laid, as ordered has left it, with the number of the rows of the same key that come before a row.

    Within a part rows are numbered already, so nothing is sorted or dealt anew: a row only needs to know where its key
    begins in its part, and how many of the key the parts before have.
    """
    part = laid.groupBy(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], F.shiftrightunsigned("_id", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    earlier = Window.partitionBy(*[f"_k{n}" for n, _ in enumerate(keys)]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = checkpointed(part.withColumn("_less", F.col("_first") - F.coalesce(F.sum("_n").over(earlier), F.lit(0))))
    # Keys may be null, which an ordinary join would drop.
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)], F.shiftrightunsigned("_id", 33) == F.col("_part"))
    return laid.join(begins, same).select(*laid.columns, (F.col("_id") - F.col("_less")).alias(name))


def first_fit_split(df: DataFrame, keys: list[str], order: list[str], weight: str, budget: Column, rounds: int = 8) -> DataFrame:
    """What first_fit gives, for keys of any size: the rows of one key are spread over tasks.

    In a round the longest prefix of the open rows that fits the rest of the budget is taken, and
    the next row, which does not fit, is passed over, with all rows heavier than what is then left, as none
    of them can ever fit. The sums that this needs are of two levels (see before). After the last round only rows
    that may still fit are open; of these, one key's go through one task in order, as in first_fit.
    Weights are not negative.
    """
    laid = ordered(df.withColumn("_w", F.coalesce(F.col(weight), F.lit(0)).cast("long")).withColumn("_budget", F.coalesce(budget, F.lit(0)).cast("long")), keys, order)
    open_ = laid.where("_budget > 0").select(*keys, "_id", "_w", F.col("_budget").alias("_left"))
    taken = laid.where("_budget <= 0").select("_id")
    for _ in range(rounds):
        summed = before(open_, keys, {"_before": F.col("_w")}).withColumn("_fits", F.col("_before") + F.col("_w") <= F.col("_left"))
        summed = checkpointed(summed)
        taken = taken.unionByName(summed.where("_fits").select("_id"))
        spent = summed.where("_fits").groupBy(*keys).agg(F.sum("_w").alias("_spent"))
        same = reduce(Column.__and__, [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])
        rest = summed.where("not _fits").alias("r").join(spent.alias("s"), same, "left").select(*[f"r.{c}" for c in (*keys, "_id", "_w")], (F.col("r._left") - F.coalesce(F.col("s._spent"), F.lit(0))).alias("_left"))
        open_ = checkpointed(rest.where("_w <= _left"))
        if open_.isEmpty():
            break
    else:
        taken = taken.unionByName(first_fit(open_, keys, ["_id"], "_w", F.col("_left")).where("taken").select("_id"))
    marked = checkpointed(laid.join(taken.withColumn("taken", F.lit(True)), "_id", "left").withColumn("taken", F.coalesce("taken", F.lit(False))))
    out = before(marked, keys, {"_place": F.lit(1), "_spent": F.when(F.col("taken"), F.col("_w")).otherwise(0)})
    return out.select(*df.columns, (F.col("_place") + 1).cast("long").alias("place"), "taken", F.col("_spent").cast("long").alias("spent"))


def fits(df: DataFrame, keys: list[str], order: list[str], item: str, weight: str, budget: Column) -> DataFrame:
    """The items that first-fit takes."""
    return first_fit(df, keys, order, weight, budget).where("taken").select(*keys, item)


def trimmed(df: DataFrame, keys: list[str], order: list[Column], size: str, budget: Column, droppable: Column | None = None, split: bool = False) -> DataFrame:
    """df with dropped: in order, items go until the rest of the group is within the budget, and none after that.

    What is not droppable stays and counts. With split the rows of one group are spread over tasks.
    """
    loose = F.lit(True) if droppable is None else droppable
    gone = F.when(loose, F.col(size)).otherwise(F.lit(0))
    if split:
        laid = ordered(df, keys, order)
        whole = laid.groupBy(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)]).agg(F.sum(size).alias("_whole"))
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)])
        summed = before(laid, keys, {"_gone": gone}).join(whole, same)
        return summed.withColumn("dropped", loose & (F.col("_whole") - F.col("_gone") > budget)).select(*df.columns, "dropped")
    whole = F.sum(size).over(Window.partitionBy(*keys))
    gone_before = F.coalesce(F.sum(gone).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("dropped", loose & (whole - gone_before > budget))


def trimmed_prompt(contexts: DataFrame, budget: int, fixed: str = "fixed") -> DataFrame:
    """contexts (repo, prompt_id, label, content, priority, fixed) with dropped: the highest priority goes first, then the longest.

    Sizes are bytes of label and content and eight more; priorities of 0 or less never go.
    """
    sized = contexts.withColumn("size", F.octet_length("label") + F.octet_length("content") + 8)
    return trimmed(sized, ["repo", "prompt_id"], [F.desc("priority"), F.desc(F.octet_length("content")), F.col("label")], "size", F.lit(budget) - F.col(fixed), F.col("priority") > 0).drop("size")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= most)


def best(df: DataFrame, keys: list[str], score: Column, order: str, value: str) -> DataFrame:
    """The value with the greatest score of each group; the first by order on ties."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(score, -F.col(order))).alias(value), F.max(score).alias("score"))


def lifecycle_score(roles: Column) -> Column:
    """0 without roles; else 1, and 1 each for having an initial and a final state that is not foreign."""
    has = lambda name: F.exists(roles, lambda r: r[name] & ~r["foreign"]).cast("int")
    return F.when(roles.isNull() | (F.size(roles) == 0), 0).otherwise(1 + has("initializing") + has("final"))


def first_few(items: Column, most: int) -> tuple[Column, Column]:
    """The first few of a sorted array, and how many are left out."""
    return F.slice(items, 1, most), F.greatest(F.size(items) - most, F.lit(0))


def trimmed_ids(candidates: DataFrame, most: int = 3) -> DataFrame:
    """All declared candidates of an owner and the first few of the others."""
    rank = F.row_number().over(Window.partitionBy("repo", "owner", "declarative").orderBy("ord"))
    return candidates.withColumn("_rank", rank).where(F.col("declarative") | (F.col("_rank") <= most)).drop("_rank")
