"""Quality rules with risk-controlled thresholds.

Each rule is a score with a fixed grid of cutoffs; a document is rejected where a score
reaches its cutoff. The rules stand on one ladder: each rung makes one rule stricter by one
cutoff, so what a rung rejects, all later ones do. How far a stratum (language) goes up is
decided on labelled holdouts by fixed-sequence tests: a rung is admissible if the exact
binomial test refutes, at level delta / strata, that its rules together reject a share of
``alpha`` or more of the good documents that the base keeps; the walk ends at the first that
is not. As the order is fixed beforehand, neither the risk nor the level is divided by rules
or cutoffs. The strictest admissible rung is taken; where none is, the rules are off in that
stratum, as they are with fewer than ln(delta / strata) / ln(1 - alpha) good labels (217 for
4 strata). So with probability 1 - delta no stratum loses more than ``alpha`` of its good
documents that the base keeps to the rules.

Cases: null text counts as none (0 words, so it fails the base); null language is a stratum
of its own; labels that are null, not 0/1 or without a document count for nothing; repeated
label rows count once; a document with both labels counts as good; empty tables give empty
results; other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from ledgerlens.llm.common import map_batches, table, texts, written

ALPHA, DELTA = 0.02, 0.05
WINDOW = 5

#: Cutoffs of every rule, from lenient to strict.
RULES: dict[str, list[float]] = {
    "symbol_ratio": [3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.1],
    "dup_line_ratio": [0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25],
    "upper_ratio": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15],
    "exclaim_ratio": [2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1],
    "repeat_ratio": [0.2, 0.18, 0.16, 0.14, 0.12, 0.1, 0.09, 0.08, 0.07, 0.06],
}
#: The rungs, (rule, index of its cutoff). Repeated words come last: the base has a limit on them.
LADDER = [(r, k) for last in (False, True) for k in range(10) for r in RULES if (r == "repeat_ratio") == last]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = StructType([StructField(c, LongType()) for c in COUNTS] + [StructField("base_failed", BooleanType())] + [StructField(r, DoubleType()) for r in RULES])

SPACE, SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
UPPER = bytes(range(65, 91))


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of five words found twice or more, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    w = h[:n].copy()
    for k in range(1, WINDOW):
        w = (w ^ (w >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int32)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str) -> tuple:
    """The counts of one text and the score of each rule."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes are split at space and \t to \r, and nowhere else
    n = len(words)
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    chars = len(text) - (len(data) - len(data.translate(None, SPACE)))
    lines = [x for x in data.split(b"\n") if x and x.translate(None, SPACE)]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    upper = len(data) - len(data.translate(None, UPPER))
    some = max(n, 1)
    return (n, chars, symbols, dup, repeat, n < 10 or 100 * repeat > 20 * n, symbols / some, dup / max(len(lines), 1), upper / max(chars, 1), data.count(b"!") / some, repeat / some)


def features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns in keep and, in the struct quality, the counts and scores of the text."""
    inner = pa.struct([pa.field(f.name, {LongType: pa.int64(), BooleanType: pa.bool_(), DoubleType: pa.float64()}[type(f.dataType)]) for f in FEATURES])

    def run(batch: pa.RecordBatch) -> dict:
        rows = [measure(t) for t in texts(batch, "quality_text")]
        struct = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), inner, strict=True)], fields=list(inner))
        return {k: batch.column(k) for k in keep} | {"quality": struct}

    source = docs.select(*keep, F.col(text).alias("quality_text"))
    schema = StructType([docs.schema[k] for k in keep] + [StructField("quality", FEATURES)])
    return map_batches(source, run, schema)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X of Binomial(n, p), summed exactly over its terms."""
    if k >= n:
        return 1.0
    return min(1.0, math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1)))


def strictest(cutoffs: Sequence[float], rejected: list[int], n: int, risk: float, level: float) -> float | None:
    """The strictest cutoff whose share of false rejections is below risk at this level."""
    best = None
    for cutoff, k in zip(cutoffs, rejected, strict=True):
        if n and k < risk * n and binomial_tail(k, n, risk) <= level:
            best = cutoff
    return best


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """A row for each stratum: its cutoff for every rule, null where the rule is off.

    measured: doc_id, stratum, quality. Labelled rows are summed per stratum by Spark; what
    is left to test has a row per stratum.
    """
    good = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("good")).where("good = 1").select("doc_id")
    held = measured.where(~F.col("quality.base_failed")).join(good, "doc_id")
    rung = {x: j for j, x in enumerate(LADDER)}
    first = []
    for r, cs in RULES.items():
        met = F.when(F.col(f"quality.{r}") >= cs[0], rung[r, 0])
        for k, c in enumerate(cs[1:], 1):
            met = met.when(F.col(f"quality.{r}") >= c, rung[r, k])
        first.append(met)
    # The first rung that rejects a document.
    met = held.select("stratum", F.least(*first).alias("first"))
    counts = met.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.count_if(F.col("first") <= j) for j in range(len(LADDER))]).alias("rejected"))
    counts = written(counts, "quality-counts")
    level = delta / max(counts.count(), 1)

    def select(batch: pa.RecordBatch) -> dict:
        tops = [strictest(range(len(LADDER)), k, n, alpha, level) for k, n in zip(batch.column("rejected").to_pylist(), batch.column("n").to_pylist(), strict=True)]
        held_at = [{r: RULES[r][k] for r, k in LADDER[: top + 1]} if top is not None else {} for top in tops]
        return {"stratum": batch.column("stratum")} | {r: [x.get(r) for x in held_at] for r in RULES}

    return map_batches(counts, select, StructType([StructField("stratum", StringType()), *[StructField(r, DoubleType()) for r in RULES]]))


def judged(measured: DataFrame, chosen: DataFrame) -> DataFrame:
    """measured with kept: the base holds and no rule's score reaches the stratum's cutoff."""
    named = chosen.select(F.col("stratum").alias("cut_stratum"), *[F.col(r).alias(f"cut_{r}") for r in RULES])
    reached = [F.coalesce(F.col(f"quality.{r}") >= F.col(f"cut_{r}"), F.lit(False)) for r in RULES]
    fires = reached[0]
    for x in reached[1:]:
        fires = fires | x
    joined = measured.join(named, F.col("stratum") == F.col("cut_stratum"), "left")
    return joined.withColumn("kept", ~F.col("quality.base_failed") & ~fires).drop("cut_stratum", *[f"cut_{r}" for r in RULES])


def stratum(column: str = "lang"):
    return F.coalesce(F.col(column), F.lit(""))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts, the base verdict and the risk-controlled verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", stratum().alias("stratum"))
    measured = written(features(docs, ["doc_id", "stratum"]), "quality-features")
    chosen = cutoffs(measured, table(spark, sf_dir, "labels"))
    return judged(measured, chosen).select("doc_id", *[f"quality.{c}" for c in COUNTS], "quality.base_failed", "kept", F.col("stratum").alias("lang_stratum"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    packed = docs.select(F.struct("*").alias("own_row"), "doc_id", "text", stratum().alias("stratum"))
    measured = written(features(packed, ["own_row", "doc_id", "stratum"]), "quality-measured")
    chosen = cutoffs(measured, table(spark, sf_dir, "labels"))
    return judged(measured, written(chosen, "quality-cutoffs")).where("kept").select("own_row.*")


def _sql() -> str:
    rung = {x: j for j, x in enumerate(LADDER)}
    chain = lambda r: "case " + " ".join(f"when {r} >= {c} then {rung[r, k]}" for k, c in enumerate(RULES[r])) + f" else {len(LADDER)} end"
    first = "least(" + ", ".join(chain(r) for r in RULES) + ")"
    gone = lambda inside: f"length(text) - length(regexp_replace(text, '{inside}', '', 'g'))"
    return rf"""
    with d as (select row_number() over () as id, doc_id, coalesce(text, '') as text, coalesce(lang, '') as lang_stratum from documents),
    w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
    g as (select id, i, md5(array_to_string(ws[i : i + 4], ' ')) as g from (select id, ws, unnest(range(1, greatest(len(ws) - 3, 1))) as i from w)),
    r as (select id, count(distinct place) as n from (select id, unnest(range(i, i + {WINDOW})) as place from (select *, count(*) over (partition by id, g) as c from g) where c > 1) group by 1),
    c as (select w.id, doc_id, lang_stratum, len(ws) as n_words, {gone('[^\x20\x09-\x0D]')} as word_chars, {gone('[#*$%&|<>]')} as n_symbols,
        len(lines) - len(list_distinct(lines)) as n_dup_lines, len(lines) as n_lines, coalesce(r.n, 0) as n_repeat_words, {gone('[A-Z]')} as upper, {gone('!')} as exclaims from w left join r using (id)),
    f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, n_symbols::double / greatest(n_words, 1) as symbol_ratio, n_dup_lines::double / greatest(n_lines, 1) as dup_line_ratio,
        upper::double / greatest(word_chars, 1) as upper_ratio, exclaims::double / greatest(n_words, 1) as exclaim_ratio, n_repeat_words::double / greatest(n_words, 1) as repeat_ratio from c),
    m as (select *, {first} as first from f),
    good as (select doc_id from labels where quality in (0, 1) and doc_id is not null group by 1 having max(quality) = 1),
    h as (select lang_stratum, first from m join good using (doc_id) where not base_failed),
    k as (select lang_stratum, j, count(*) as n, count(*) filter (where first <= j) as k from h, range({len(LADDER)}) as t(j) group by 1, 2),
    b as (select *, list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA})))) as tail from k where k < {ALPHA} * n),
    t as (select lang_stratum, max(j) as top from b where tail <= {DELTA} / (select count(distinct lang_stratum) from h) group by 1)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not coalesce(first <= top, false) as kept, lang_stratum from m left join t using (lang_stratum)"""


OP2_SQL = _sql()
