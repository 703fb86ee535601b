"""Personal data by candidate gradient boosting, in DataFrame functions and MLlib only.

Generators of high recall propose overlapping spans: the base patterns (email, ip, card,
phone), addresses spelled with at and dot in brackets of any kind or as words, ip numbers with their points set apart,
grouped telephone numbers, and any chain of 7 to 19 digits with the separators of phone and
card numbers, slashes among them. Gradient-boosted trees, trained here on all labelled candidates, score
every candidate from its format and the words before it. Labelled ones with equal features are counted and become
one weighted row, so what the trees pass over grows with the forms that occur and not with the corpus.

No span outside the base patterns has a label, so labels are made from what can be checked:

* valid: spans that pass the base's checks, rewritten to forms that the base patterns miss
  (spelled addresses, numbers without their plus, other separators), with their own context;
* invalid: candidates that fail a check (a part above 255, 16 digits or more that fail Luhn, a
  plus with too few or too many digits), bare digits without a contact word in the three words before them, numbers
  after words like order or invoice, dates; and rewritten spans that were made to fail a check.

Other candidates have no label: they are never taken for invalid ones. Both labels weigh the same in
all. For each kind the cutoff is set where, on the held-out fifth of the labelled ones, all of them counted, at least
PRECISION of the candidates at or above it are valid. Candidates at or above it that touch no base span are
added, those within another one left out; base spans always stay.

Cases: null text counts as empty; texts of any length are searched whole, in time that grows
with their matches; repeated rows are kept apart by a row number; a kind without LEAST
held-out candidates of both labels adds nothing; empty tables give empty results; other
columns are not read. Offsets are in code points, end exclusive.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import once, table, text_or_empty, written

KINDS = ["email", "ip", "card", "phone"]
PRECISION, LEAST, SEED = 0.995, 20, 7
TREES, DEPTH = 12, 4
#: Bins of a feature at most: MLlib then finds the splits on all weighted rows, up to the square of it. Lengths count up to LONG.
BINS, LONG = 1024, 63
#: Scores are counted in so many cells of equal width.
CELLS = 10_000

LOCAL, HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: A run of letters is tried at its start only, or where the last match ended: later starts fail alike.
RUN = rf"(?:(?<!{LOCAL})|\G)"
AT, DOT = r"[(\[{<] ?(?:at|AT|At|@) ?[)\]}>]", r"[(\[{<] ?(?:dot|DOT|Dot|\.) ?[)\]}>]"
PATTERNS = {
    "email": rf"{RUN}{LOCAL}++@{HOST}++(?:\.{HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "spelled": rf"{RUN}{LOCAL}++ ?{AT} ?{HOST}++(?: ?(?:\.|{DOT}) ?{HOST}++)++",
    "worded": rf"{RUN}{LOCAL}++ (?:at|AT|At) {HOST}++(?: (?:dot|DOT|Dot) {HOST}++)++",
    "dotted": rf"(?<![0-9.])[0-9]{{1,3}}(?:(?: ?{DOT} ?| \. )[0-9]{{1,3}}){{3}}(?![0-9])",
    "number": r"\(?[0-9](?:[ ()./-]{0,2}[0-9]){6,}+",
    "grouped": r"(?<![0-9])(?:[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: What a text must hold for a pattern to be tried.
GATES = {
    "email": "text like '%@%'", "phone": "text like '%+%'", "spelled": r"text rlike r'(?i)[(\[{<] ?(?:at|@) ?[)\]}>]'", "worded": "text rlike '(?i) dot '", "dotted": r"text rlike r'(?i)[(\[{<] ?(?:dot|\.) ?[)\]}>]| \. '",
    "ip": "digits", "card": "digits", "number": "digits", "grouped": "digits",
}
#: Four digits with at most three other characters between them: every ip, card and chain of digits has them.
SOME_DIGITS = r"[0-9](?:[^0-9]{0,3}[0-9]){3}"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
CONTEXT, CHUNK = 32, 128
#: Ends of host names that are no common words.
ENDS = "com|org|net|edu|gov|info|io|co|uk|eu|de|fr|es|nl|pl|ch|ca|au|jp|br|dev|app|biz|example|test"
#: A day, month and year with slashes.
DATE = r"^\(?[0-9]{1,2}/[0-9]{1,2}/(?:19|20)?[0-9]{2}\b|^\(?(?:19|20)[0-9]{2}/[0-9]{1,2}/[0-9]{1,2}\b"
WORDS = {"call": "tel|telephone|phone|call|fax|mobile|mobil|cell|dial|ruf|whatsapp|sms", "card": "card|visa|master|mastercard|amex|pay|konto|carte|tarjeta", "mail": "mail|contact|write|email|e-mail", "net": "ip|host|server|address|addr|login", "order": "order|invoice|no|nr|number|id|ref|item|ticket|case|serial|version|page|year|isbn|sku|part"}


def running_sums(lengths: Column) -> Column:
    """The running sums of an array of numbers, chunk by chunk, so that no long array is copied for each of them."""
    none = F.array().cast("array<int>")
    after = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"] + x)).alias("out"))
    sums = lambda xs, start: F.aggregate(xs, F.struct(start.alias("at"), none.alias("out")), after, lambda a: a["out"])
    whole = lambda c: F.transform(c, lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x))
    within = lambda c, b: F.flatten(F.transform(c, lambda xs, k: sums(xs, F.when(k > 0, F.get(b, k - 1)).otherwise(0))))
    chunks = once(lengths, lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int")), lambda k: F.slice(xs, k * CHUNK + 1, CHUNK)))
    return once(chunks, lambda c: once(sums(whole(c), F.lit(0)), lambda b: within(c, b)))


def located(kind: str) -> Column:
    """The matches of a pattern in text as an array of (kind, start, end, hit, before)."""
    pattern = PATTERNS[kind]
    pieces = F.arrays_zip(F.split("text", pattern, -1).alias("gap"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("hit"))
    length = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))

    def spans(p: Column, ends: Column) -> Column:
        # The last gap has no match after it.
        one = lambda x, k: F.struct(F.lit(kind).alias("kind"), (F.get(ends, k) - F.length(x["hit"])).alias("start"), F.get(ends, k).alias("end"), x["hit"].alias("hit"), F.lower(F.right(x["gap"], F.lit(CONTEXT))).alias("before"))
        return F.transform(F.slice(p, F.lit(1), F.size(p) - 1), one)

    found = once(pieces, lambda p: once(running_sums(F.transform(p, length)), lambda ends: spans(p, ends)))
    return F.when(F.expr(GATES[kind]), found).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,hit:string,before:string>>"))


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(hit: Column) -> Column:
    """Whether the digits pass Luhn's check."""
    d = F.split(F.reverse(digits(hit)), "")
    value = lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2 / 10).cast("int") + x.cast("int") * 2 % 10)
    return F.aggregate(F.transform(F.filter(d, lambda x: x != ""), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(s: Column) -> Column:
    """The base check of a span of a base kind; false for the other generators."""
    n = F.length(digits(s["hit"]))
    return (
        F.when(s["kind"] == "email", F.lit(True))
        .when(s["kind"] == "ip", s["hit"].rlike(rf"^{PART}(?:\.{PART}){{3}}$"))
        .when(s["kind"] == "card", F.when(n.between(12, 19), luhn(s["hit"])).otherwise(F.lit(False)))
        .when(s["kind"] == "phone", n.between(9, 15))
        .otherwise(F.lit(False))
    )


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, row, base and others: the valid base spans of each text, and all further candidates."""
    held = docs.select("doc_id", text_or_empty().alias("text")).withColumn("row", F.monotonically_increasing_id()).withColumn("digits", F.col("text").rlike(SOME_DIGITS))
    spans = held.select("doc_id", "row", F.concat(*[located(k) for k in PATTERNS]).alias("spans"))
    checked = spans.select("doc_id", "row", F.transform("spans", lambda s: s.withField("valid", valid(s))).alias("spans"))
    worth = lambda s: ~s["kind"].isin("card", "number") | F.length(digits(s["hit"])).between(7, 19)
    return checked.select("doc_id", "row", F.filter("spans", lambda s: s["valid"]).alias("base"), F.filter("spans", lambda s: ~s["valid"] & worth(s)).alias("others"))


def said(before: Column, words: str) -> Column:
    """Whether one of the words stands at the end of what is before, with other signs at most after it; contact words also with up to two words between."""
    between = r"(?:[a-z\u00df-\u024f]+[^a-z\u00df-\u024f]+){0,2}" if words == "call" else ""
    return before.rlike(rf"(?:^|[^a-z])(?:{WORDS[words]})[^a-z]*{between}$")


def family(kind: Column, hit: Column) -> Column:
    """The number of the kind that a candidate would be."""
    n = F.length(digits(hit))
    card = (n >= 16) | ((n >= 12) & luhn(hit))
    return F.when(kind.isin("email", "spelled", "worded"), 0).when(kind.isin("ip", "dotted"), 1).when(card & (kind != "phone"), 2).otherwise(3)


def top_part(hit: Column) -> Column:
    """The greatest of the numbers in a text, as far as nine digits go."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(hit, F.lit("[0-9]+"), F.lit(0)), lambda x: F.left(x, F.lit(9)).cast("int"))), F.lit(0))


def bare(hit: Column) -> Column:
    return hit.rlike("^[0-9]+$")


def refuted(s: Column) -> Column:
    """Whether a candidate fails a check of its kind, or has the context of a number of another sort."""
    n, number = F.length(digits(s["hit"])), s["kind"].isin("card", "number", "grouped")
    return (
        (s["kind"].isin("ip", "dotted") & (top_part(s["hit"]) > 255))
        | (number & (n >= 16) & ~luhn(s["hit"]))
        | ((s["kind"] == "phone") & ~n.between(9, 15))
        | (number & (n < 16) & bare(s["hit"]) & ~said(s["before"], "call") & ~said(s["before"], "card"))
        | (number & said(s["before"], "order"))
        | (number & s["hit"].rlike(DATE) & ~said(s["before"], "call"))
    )


def rewritten(s: Column) -> Column:
    """The forms of a valid base span that base patterns miss, and forms made to fail, as (kind, hit, before, label)."""
    hit, before = s["hit"], s["before"]
    form = lambda kind, text, label, context=before: F.struct(F.lit(kind).alias("kind"), text.alias("hit"), context.alias("before"), label.alias("label"))
    yes, no = F.lit(1.0), F.lit(0.0)
    put = lambda column, old, new: F.replace(column, F.lit(old), F.lit(new))
    local, host = F.substring_index(hit, "@", 1), F.substring_index(hit, "@", -1)
    first, last = F.substring_index(host, ".", 1), F.substring_index(host, ".", -1)
    spelled = [form("spelled", F.concat(local, F.lit(a), put(host, ".", d)), yes) for a, d in ((" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "."), (" (at) ", "."), ("[@]", "[.]"), ("<at>", "<dot>"))]
    spelled += [form("worded", F.concat(local, F.lit(" at "), put(host, ".", " dot ")), yes), form("worded", F.concat(local, F.lit(" at "), first, F.lit(" dot "), last), yes)]
    # Addresses with another end than their own, and prose that has none.
    other = F.element_at(F.split(F.lit(ENDS), r"\|"), F.pmod(F.xxhash64(hit), F.lit(len(ENDS.split("|")))).cast("int") + 1)
    spelled += [form("worded", F.concat(local, F.lit(" at "), first, F.lit(" dot "), *x, other), yes) for x in ([], [last, F.lit(" dot ")])] + [form("spelled", F.concat(local, F.lit(a), first, F.lit(d), other), yes) for a, d in (("(at)", "(dot)"), ("[at]", "[dot]"))]
    # Names without points as well: where a corpus has few of them, points would tell addresses from prose.
    name = F.substring_index(local, ".", -1)
    spelled += [form("worded", F.concat(name, F.lit(" at "), first, F.lit(" dot "), *x, other), yes) for x in ([], [last, F.lit(" dot ")])] + [form("spelled", F.concat(name, F.lit(a), first, F.lit(d), other), yes) for a, d in (("(at)", "(dot)"), (" [at] ", " [dot] "))]
    some = F.substring(F.md5(hit), 1, 8)
    short = F.translate(some, "0123456789", "ghijklmnop")
    loose = [F.concat(F.lit("look at the dot "), x) for x in (F.lit("on"), F.left(short, F.lit(3)), short)] + [F.concat(n, F.lit(" at "), first, F.lit(" dot "), x) for n in (local, name) for x in (F.lit("in"), F.left(short, F.lit(2)), F.left(short, F.lit(3)), F.left(short, F.lit(5)))]
    prose = [F.concat(local, F.lit(" (at) "), first, F.lit(". "), F.initcap(last)), F.concat(local, F.lit("(at)"), first, F.lit(". "), F.initcap(last)), F.concat(local, F.lit(" (at) 5.30")), F.concat(local, F.lit(" [at] "), first, F.lit(" . "), F.initcap(last)), F.concat(local, F.lit(" (at) 12.15"))]
    apart = [form("dotted", put(hit, ".", d), yes) for d in ("[.]", "(.)", "[dot]", " (dot) ", " . ")]
    over = F.regexp_replace(F.concat(F.substring_index(hit, ".", 3), F.lit("."), (F.substring_index(hit, ".", -1).cast("int") + 256).cast("string")), r"^0+(?=[0-9])", "")
    apart += [form("dotted", put(over, ".", d), no) for d in ("[.]", "(.)", "[dot]", " (dot) ", " . ")]
    d = digits(hit)
    wrong = F.concat(F.left(d, F.length(d) - 1), ((F.right(d, F.lit(1)).cast("int") + 1) % 10).cast("string"))
    fours = lambda x, sep: F.regexp_replace(x, "([0-9]{4})(?=[0-9])", "$1" + sep)
    cards = [form("number", fours(x, sep), label) for x, label in ((d, yes), (wrong, no)) for sep in (".", "  ", "- ")]
    plain = F.regexp_replace(hit, r"^\+", "")
    own = F.regexp_replace(hit, r"^\+[0-9]{1,3}[ .-]+(?=[(0-9])", "")
    points = F.regexp_replace(F.regexp_replace(plain, "[ ()-]+", "."), r"^\.", "")
    told = F.when(said(before, "call"), 1.0).otherwise(0.0)
    label = lambda x: F.when(bare(x), told).otherwise(1.0)
    slash = F.regexp_replace(own, r"^([(]?[0-9]{2,5}[)]?)[ .-]+", "$1/")
    part = lambda a, n: F.substring(d, a, n)
    dates = [F.concat(part(1, 2), F.lit("/"), part(3, 2), F.lit("/20"), part(5, 2)), F.concat(F.lit("20"), part(1, 2), F.lit("/"), part(3, 2), F.lit("/"), part(5, 2))]
    phones = [form("number", x, label(x)) for x in (plain, own, points, d)] + [form("number", d, no, F.lit(c)) for c in (" order ", "invoice no. ", "id ")]
    phones += [form("number", slash, F.lit(1.0)), *[form("number", x, no, F.lit(c)) for x in dates for c in (" on ", " dated ")]]
    keep = F.filter(F.array(*phones), lambda x: F.length(digits(x["hit"])).between(7, 19))
    return F.when(s["kind"] == "email", F.array(*spelled, *[form("spelled", x, no) for x in prose], *[form("worded", x, no) for x in loose])).when(s["kind"] == "ip", F.array(*apart)).when(s["kind"] == "card", F.array(*cards)).otherwise(keep)


def features(spans: DataFrame) -> tuple[DataFrame, list[str]]:
    """Format and context of each span s, as numbers."""
    kind, hit, before = F.col("s.kind"), F.col("s.hit"), F.col("s.before")
    n = F.length(digits(hit))
    count = lambda letters: F.length(hit) - F.length(F.translate(hit, letters, ""))
    runs = F.transform(F.regexp_extract_all(hit, F.lit("[0-9]+"), F.lit(0)), F.length)
    named = {
        "f_family": F.col("family"), "f_digits": n, "f_length": F.least(F.length(hit), F.lit(LONG)), "f_spaces": count(" "), "f_hyphens": count("-"), "f_dots": count("."), "f_brackets": count("()[]"),
        "f_letters": F.least(F.length(F.regexp_replace(hit, "[^A-Za-z]", "")), F.lit(LONG)), "f_bare": bare(hit).cast("int"), "f_groups": F.size(runs), "f_longest": F.coalesce(F.array_max(runs), F.lit(0)),
        "f_luhn": ((n >= 12) & luhn(hit)).cast("int"), "f_over": (top_part(hit) > 255).cast("int"), "f_sentence": hit.rlike(r"[.] ?[A-Z0-9]").cast("int"), "f_end": F.least(F.length(F.regexp_extract(hit, "([A-Za-z]*)$", 1)), F.lit(LONG)),
        "f_slashes": count("/"), "f_date": hit.rlike(DATE).cast("int"), "f_host_end": F.lower(hit).rlike(rf"[^a-z](?:{ENDS})$").cast("int"), "f_worded": (kind == "worded").cast("int"),
        "f_joined": before.rlike(r"[\p{L}0-9._]$").cast("int"), "f_generator": F.when(kind == "phone", 1).otherwise(0),
    } | {f"f_{k}": said(before, k).cast("int") for k in WORDS}
    return spans.withColumn("family", family(kind, hit)).select("*", *[c.cast("double").alias(k) for k, c in named.items()]), list(named)


def labelled(found: DataFrame) -> DataFrame:
    """s (kind, hit, before), label, draw: what can be learnt from."""
    part = lambda s, label: F.struct(s["kind"].alias("kind"), s["hit"].alias("hit"), s["before"].alias("before"), label.alias("label"))
    made = found.select("row", F.explode("base").alias("b")).select("row", F.col("b.start").alias("start"), F.explode(rewritten(F.col("b"))).alias("s"))
    failed = found.select("row", F.explode(F.filter("others", refuted)).alias("o")).select("row", F.col("o.start").alias("start"), part(F.col("o"), F.lit(0.0)).alias("s"))
    return made.unionByName(failed).select("s", F.col("s.label").alias("label"), F.xxhash64(F.lit(SEED), "row", "start", "s.kind", "s.hit").alias("draw"))


def lowest(cells: list[Row]) -> float | None:
    """The cutoff from which on at least PRECISION of the weight is valid; None without LEAST spans of both labels.

    cells: for each cell of scores the numbers n_valid and n_invalid, their weights valid and invalid, and the least and
    greatest score. The cutoff lies halfway between the lowest score of the last cell that passes and the next below it.
    """
    if min(sum(c.n_valid for c in cells), sum(c.n_invalid for c in cells)) < LEAST:
        return None
    cutoff, good, every, n = None, 0.0, 0.0, 0
    ranked = sorted(cells, key=lambda c: -c.cell)
    for k, c in enumerate(ranked):
        good, every, n = good + c.valid, every + c.valid + c.invalid, n + c.n_valid + c.n_invalid
        if good >= PRECISION * every and n >= LEAST:
            cutoff = (c.least + (ranked[k + 1].greatest if k + 1 < len(ranked) else c.least)) / 2
    return cutoff


def weighted(spans: DataFrame, names: list[str]) -> DataFrame:
    """label, names, n_fit, n_held: all spans, counted by label and features; a fifth of them is held out."""
    held = (F.pmod("draw", F.lit(5)) == 0).cast("long")
    return spans.groupBy("label", *names).agg(F.sum(1 - held).alias("n_fit"), F.sum(held).alias("n_held"))


def trained(spans: DataFrame, names: list[str]) -> tuple[GBTClassificationModel, dict[int, float]] | None:
    """The model and the cutoff of each kind, from all spans; None if a label is absent."""
    counted = written(weighted(spans, names), "pii-spans")
    labels = {r.label: r.n for r in counted.groupBy("label").agg(F.sum(F.col("n_fit") + F.col("n_held")).alias("n")).collect()}
    if min(labels.get(0.0, 0), labels.get(1.0, 0)) < LEAST:
        return None
    share = F.when(F.col("label") == 1, sum(labels.values()) / (2 * labels[1.0])).otherwise(sum(labels.values()) / (2 * labels[0.0]))
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(counted.withColumn("share", share).withColumn("weight", F.col("n_fit") * F.col("share")))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=BINS, seed=SEED, weightCol="weight").fit(ready.where("n_fit > 0"))
    p, n, is_valid = vector_to_array("probability")[1], F.col("n_held"), F.col("label") == 1
    scored = model.transform(ready.where("n_held > 0")).select(F.col("f_family").cast("int").alias("kind"), p.alias("p"), n, "share", is_valid.alias("valid"))
    of = lambda c, v: F.coalesce(F.sum(F.when(F.col("valid") == v, c)), F.lit(0))
    cells = scored.groupBy("kind", F.floor(F.col("p") * CELLS).alias("cell")).agg(
        of(n, True).alias("n_valid"), of(n, False).alias("n_invalid"), of(n * F.col("share"), True).alias("valid"), of(n * F.col("share"), False).alias("invalid"), F.min("p").alias("least"), F.max("p").alias("greatest")
    )
    rows = cells.collect()  # at most CELLS + 1 for each kind
    found = {k: lowest([r for r in rows if r.kind == k]) for k in {r.kind for r in rows}}
    return model, {k: c for k, c in found.items() if c is not None}


def added(found: DataFrame) -> DataFrame:
    """row, added: the further spans that the trees select, as (start, kind number, end)."""
    none = found.sparkSession.createDataFrame([], "row long, added array<struct<start:int,kind:int,end:int>>")
    known, names = features(labelled(found))
    fit = trained(known, names)
    if fit is None or not fit[1]:
        return none
    model, cutoffs = fit
    touches = lambda s: F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    loose = found.select("row", F.explode(F.filter("others", lambda s: ~touches(s))).alias("s"))
    measured, _ = features(loose)
    cutoff = F.lit(None).cast("double")
    for k, c in cutoffs.items():
        cutoff = F.when(F.col("family") == k, c).otherwise(cutoff)
    scored = model.transform(VectorAssembler(inputCols=names, outputCol="features").transform(measured)).where(vector_to_array("probability")[1] >= cutoff)
    spans = scored.groupBy("row").agg(F.collect_set(F.struct(F.col("s.start").alias("start"), F.col("family").alias("kind"), F.col("s.end").alias("end"))).alias("all"))
    # Of overlapping candidates the one that holds the other stays.
    holds = lambda o, s: (o["start"] <= s["start"]) & (s["end"] <= o["end"]) & (o["end"] - o["start"] > s["end"] - s["start"])
    return spans.select("row", F.filter("all", lambda s: ~F.exists("all", lambda o: holds(o, s))).alias("added"))


def listed(spans: Column) -> Column:
    """kind:start:end of sorted (start, kind number, end), joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def detected(docs: DataFrame) -> DataFrame:
    """doc_id, row, base_spans, all_spans: arrays of (start, kind number, end)."""
    found = written(candidates(docs), "pii-candidates")
    names = F.array(*[F.lit(k) for k in KINDS])
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), (F.array_position(names, s["kind"]) - 1).cast("int").alias("kind"), s["end"].alias("end")))
    more = added(found).withColumnRenamed("row", "more_row")
    joined = found.select("doc_id", "row", base.alias("base_spans")).join(more, F.col("row") == F.col("more_row"), "left")
    return joined.select("doc_id", "row", "base_spans", F.when(F.col("added").isNull(), F.col("base_spans")).otherwise(F.array_distinct(F.concat("base_spans", "added"))).alias("all_spans"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data in every document."""
    spans = detected(table(spark, sf_dir, "documents"))
    of_kind = F.transform("base_spans", lambda s: s["kind"])
    number = [(F.size(of_kind) - F.size(F.array_remove(of_kind, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return spans.select("doc_id", *number, F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"), listed(F.col("all_spans")).alias("spans"))
