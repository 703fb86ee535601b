"""JSON and document sources and sinks: one repo's file is one row, so many repos load at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens import schemas
from ledgerlens.functions.text import first_heading, strip_comments
from ledgerlens.operators.joins import first_wins
from ledgerlens.operators.words import word_counts
from ledgerlens.plans import dims
from ledgerlens.sources.snapshots import Snapshots

FLOW_VERSION, STATE_VERSION = 1, 2
#: Folders that are not searched for documents, the largest document, and how many are kept.
SKIPPED_FOLDERS = [".git", "vendor", "node_modules", "_to_delete", "testdata"]
MOST_BYTES, KEPT = 512 * 1024, 8


def repo_of(path: Column, depth: int = 2) -> Column:
    """The folder that many levels above a file, as its repo: a plain folder, or one that a sink here has written (repo=...)."""
    plain = lambda s: F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))
    folder = plain(F.element_at(F.split(path, "/"), -depth))
    return F.when(F.startswith(folder, F.lit("repo=")), plain(F.substring(folder, 6, 1 << 20))).otherwise(folder)


def whole_texts(spark: SparkSession, path: str | Snapshots, depth: int = 2) -> DataFrame:
    """repo and text of each file: below a path with wildcards, or of what holds in a table of snapshots."""
    if isinstance(path, Snapshots):
        folders = path.folders()
        if not folders:
            return spark.createDataFrame([], "repo string, value string")
        return spark.read.text(folders, wholetext=True).select(repo_of(F.col("_metadata.file_path"), depth).alias("repo"), "value")
    return spark.read.text(path, wholetext=True).select(repo_of(F.col("_metadata.file_path"), depth).alias("repo"), "value")


def parsed(texts: DataFrame, schema: str) -> DataFrame:
    """The JSON of each text; a text that is none fails."""
    out = texts.withColumn("json", F.from_json("value", schema, {"mode": "FAILFAST"}))
    return out.select("repo", "json.*")


def read_config(spark: SparkSession, path: str | Snapshots) -> DataFrame:
    """repo, module, ord, pkg, symbol, label of each entry; comment lines are dropped, an entry without pkg or symbol fails."""
    rows = parsed(whole_texts(spark, path).withColumn("value", strip_comments(F.col("value"))), schemas.CONFIG)
    entries = rows.select("repo", "module", F.posexplode_outer("entries").alias("ord", "e")).select("repo", "module", "ord", "e.*")
    named = F.col("ord").isNull() | ((F.coalesce("pkg", F.lit("")) != "") & (F.coalesce("symbol", F.lit("")) != ""))
    return entries.where(F.assert_true(named, F.lit("an entry needs pkg and symbol")).isNull())


def read_rules(spark: SparkSession, path: str | Snapshots, repos: DataFrame) -> DataFrame:
    """repo, skipped (scenario to reason), money_symbols of every repo; null where it has no rules."""
    rows = parsed(whole_texts(spark, path), schemas.RULES)
    rules = rows.select("repo", F.map_from_entries(F.transform(F.coalesce("skip", F.array().cast("array<struct<scenario:string,why:string>>")), lambda s: F.struct(s["scenario"], s["why"]))).alias("skipped"), "money_symbols")
    return repos.select("repo").join(rules, "repo", "left")


def read_flow(spark: SparkSession, path: str | Snapshots, schema: str) -> DataFrame:
    """The flow of each repo; another schema version fails, missing arrays are empty ones."""
    rows = parsed(whole_texts(spark, path), schema)
    checked = rows.where(F.assert_true(F.col("schema_version") == FLOW_VERSION, F.lit("unknown flow version")).isNull())
    filled = [F.coalesce(c, F.array().cast(t)).alias(c) if t.startswith("array") else F.col(c) for c, t in checked.dtypes]
    return checked.select(*filled)


def read_state(spark: SparkSession, path: str | Snapshots, repos: DataFrame) -> DataFrame:
    """The answers so far of every repo; a missing file is a fresh state, and binding is read as money_model."""
    rows = parsed(whole_texts(spark, path), schemas.STATE)
    checked = rows.where(F.assert_true(F.col("schema_version") == STATE_VERSION, F.lit("unknown state version")).isNull())
    every = repos.select("repo").join(checked, "repo", "left")
    empty = {c: F.map_from_arrays(F.array(), F.array()).cast(t) for c, t in every.dtypes if t.startswith("map")}
    out = [F.coalesce(c, empty[c]).alias(c) if c in empty else F.col(c) for c in every.columns if c not in ("binding", "money_model", "schema_version")]
    return every.select(*out, F.coalesce("money_model", "binding").alias("money_model"), F.lit(STATE_VERSION).alias("schema_version"))


def read_manifest(spark: SparkSession, path: str | Snapshots) -> DataFrame:
    """repo, round, batch and its items in order; prompts are not stored."""
    rows = parsed(whole_texts(spark, path), schemas.MANIFEST)
    batches = rows.select("repo", "round", F.posexplode("batches").alias("batch_ord", "b"))
    return batches.select("repo", "round", "batch_ord", F.col("b.id").alias("batch"), F.posexplode("b.items").alias("ord", "i")).select("repo", "round", "batch_ord", "batch", "ord", "i.*")


def write_json(df: DataFrame, path: str) -> None:
    """A file for each row's repo, in a folder of its own that is replaced when the job commits; other repos stay as they are.

    The scans above read it back with the path <path>/*/*.json.
    """
    df.repartition("repo").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo").json(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """The lines (repo, line, text) of each repo as text files in a folder of its own; a large repo's files follow each other by name."""
    dealt = lines.repartitionByRange("repo", "line").sortWithinPartitions("repo", "line").select("repo", "text")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo").text(path)


PACK = "repo string, round int, ord int, kind string, batch string, title string, subject string, questions array<string>, prompt string"


def write_pack(asks: DataFrame, path: str) -> None:
    """The asks (the columns of PACK) of each repo as its pack, replacing that repo's last one; those of others stay as they are."""
    columns = [c.split(" ")[0] for c in PACK.split(", ")]
    write_json(asks.select(*columns), path)


def read_pack(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PACK).json(path)


def manifests(asks: DataFrame) -> DataFrame:
    """The manifest of each repo's pack, as read_manifest reads it: its batches in order with their items, without prompts."""
    item = F.struct("ord", F.struct("kind", "title", "subject", "questions").alias("item"))
    batches = asks.groupBy("repo", "round", "batch", "kind").agg(F.min("ord").alias("first"), F.transform(F.array_sort(F.collect_list(item)), lambda x: x["item"]).alias("items"))
    entry = F.struct("first", F.struct(F.col("batch").alias("id"), "kind", "items").alias("b"))
    return batches.groupBy("repo", "round").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["b"]).alias("batches"))


def pack_sizes(pack: DataFrame, answers: DataFrame) -> DataFrame:
    """Per repo: the batches of its pack and the answers to them, their bytes, and how many answers are missing."""
    asks = pack.groupBy("repo").agg(F.count_distinct("batch").alias("n_asks"), F.sum(F.octet_length("prompt")).alias("asks_bytes"))
    come = answers.groupBy("repo").agg(F.count(F.lit(1)).alias("n_answers"), F.sum(F.octet_length("raw")).alias("answers_bytes"))
    both = asks.join(come, "repo", "full_outer").na.fill(0)
    return both.withColumn("missing", F.greatest(F.col("n_asks") - F.col("n_answers"), F.lit(0)))


def append_answer(answers: DataFrame, path: str) -> None:
    """Answers by batch; the last of a batch holds when they are read."""
    answers.write.mode("append").parquet(path)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """The answers that hold: of a batch the one of the greatest ord. Each task passes on one a batch."""
    return first_wins(spark.read.parquet(path), ["repo", "batch"], ["ord"], last=True)


def fold_answers(spark: SparkSession, path: str, kept: Snapshots) -> None:
    """Saves what holds in an answer log as a snapshot of its repos, so that readers need not go through the log."""
    kept.save(read_answers(spark, path))


def folded_answers(spark: SparkSession, kept: Snapshots, schema: str) -> DataFrame:
    folders = kept.folders()
    rows = spark.read.schema(schema).json(folders) if folders else spark.createDataFrame([], schema)
    return rows.drop("repo").withColumn("repo", repo_of(F.col("_metadata.file_path"))) if folders else rows


def sizes(spark: SparkSession, asks: str, answers: str) -> DataFrame:
    """Per repo: how many prompts and answers there are, their bytes, and how many answers are missing."""
    files = lambda path, glob, name: spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).groupBy(repo_of(F.col("path"), 3).alias("repo")).agg(F.count(F.lit(1)).alias(f"n_{name}"), F.sum("length").alias(f"{name}_bytes"))
    both = files(asks, "*.md", "asks").join(files(answers, "*.json", "answers"), "repo", "full_outer").na.fill(0)
    return both.withColumn("missing", F.greatest(F.col("n_asks") - F.col("n_answers"), F.lit(0)))


def scored_documents(documents: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """repo, path, score, topics, title of documents (repo, path, text): at most eight a repo, best first, ties by path.

    A word counts as often as it occurs, and a topic hit five times or more counts five more. Topics
    (topic, word) may be of any number: a text is read once for 100,000 words (see word_counts).
    """
    words = (topics if topics is not None else dims.doc_topics(documents.sparkSession)).select("topic", "word")
    low = documents.select("repo", "path", "text", F.lower("text").alias("low")).where(F.octet_length("text") <= MOST_BYTES)
    hit = word_counts(low, ["repo", "path"], "low", words).join(words, "word").groupBy("repo", "path", "topic").agg(F.sum("n").alias("n"))
    total = hit.groupBy("repo", "path").agg(F.sum(F.col("n") + F.when(F.col("n") >= 5, 5).otherwise(0)).alias("score"), F.array_sort(F.collect_set("topic")).alias("topics"))
    ranked = total.where("score > 0").withColumn("rank", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("score"), "path"))).where(F.col("rank") <= KEPT)
    return ranked.join(low.select("repo", "path", first_heading(F.col("text")).alias("title")), ["repo", "path"])


def read_documents(spark: SparkSession, root: str, own_folders: tuple[str, ...] = (), own_name: str | None = None) -> DataFrame:
    """repo, path, text of the .md and .adoc files below root/<repo>, in either case, outside the skipped folders.

    own_folders are skipped too, and documents in internal folders that mention own_name: a tool's own papers.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    inside = F.regexp_replace("path", rf"^.*?{root.rstrip('/')}/", "")
    rows = files.select(F.substring_index(inside, "/", 1).alias("repo"), inside.alias("path"), "length", "content")
    skipped = F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in (*SKIPPED_FOLDERS, *own_folders)]))
    if own_name:
        rows = rows.where(~(F.contains("path", F.lit("internal/")) & F.contains(F.lower(F.col("content").cast("string")), F.lit(own_name.lower()))))
    return rows.where(F.lower("path").rlike(r"\.(?:md|adoc)$") & ~skipped & (F.col("length") <= MOST_BYTES)).select("repo", "path", F.col("content").cast("string").alias("text"))
