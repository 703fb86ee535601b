"""Chat formatting by schema fingerprints.

A record is JSON of any layout. A registry says which paths a layout needs and which declarative
mapping (a SQL expression over the parsed value) makes an array of canonical turns (role, text) of it.
The fingerprint of a record is a hash of those of its nested field paths that some layout needs,
without types, order or values, so that there are boundedly many and other fields change nothing.
A table of fingerprints, joined to the records, selects the layout all of whose paths are there; of
several the one that needs most, then the first. A hash of all field paths is reported beside it. The template marks turns with control
strings and escapes those that stand inside texts, reversibly; the loss mask holds the
stretches of assistant texts.

Cases: a null text is empty and a null role is empty; turns are taken in order of turn, then
role, then text, so ties and repeated rows have one result; a null turn comes first; a
record that is null, no JSON or of an unknown layout has null turns and is returned as such by
``canonical``, which keeps the input's columns apart in a struct (own), so that none can clash; an empty list of
turns gives no turns; conversations without turns do not occur in the query, as rows are turns; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from functools import lru_cache
from itertools import combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ledgerlens.llm.common import map_batches, table, text_or_empty

TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
#: What opens a control string of this template or of other common ones.
CONTROLS = ["<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]

#: Layouts: the paths that each needs, and the turns of a parsed record v.
PAIR = "array(struct('user' as role, variant_get(v, '$.{}', 'string') as text), struct('assistant' as role, variant_get(v, '$.{}', 'string') as text))"
LAYOUTS: dict[str, tuple[list[str], str]] = {
    "messages": (["messages[].content", "messages[].role"], "cast(variant_get(v, '$.messages', 'array<struct<role:string,content:string>>') as array<struct<role:string,text:string>>)"),
    "conversations": (["conversations[].from", "conversations[].value"], "transform(variant_get(v, '$.conversations', 'array<struct<from:string,value:string>>'), x -> struct(case x.from when 'human' then 'user' when 'gpt' then 'assistant' else x.from end as role, x.value as text))"),
    "prompt, completion": (["completion", "prompt"], PAIR.format("prompt", "completion")),
    "prompt, response": (["prompt", "response"], PAIR.format("prompt", "response")),
    "instruction": (["instruction", "output"], PAIR.format("instruction", "output")),
    "instruction, input": (["input", "instruction", "output"], "array(struct('user' as role, concat_ws('\\n\\n', variant_get(v, '$.instruction', 'string'), nullif(variant_get(v, '$.input', 'string'), '')) as text), struct('assistant' as role, variant_get(v, '$.output', 'string') as text))"),
    "system, prompt": (["prompt", "response", "system"], "array_insert(" + PAIR.format("prompt", "response") + ", 1, struct('system' as role, variant_get(v, '$.system', 'string') as text))"),
}


def field_paths(value: object) -> set[str]:
    """The nested field paths of a parsed value: names joined by points, [] for what is in a list; an empty list ends in []!."""
    found: set[str] = set()
    left = [("", value)]
    while left:
        path, x = left.pop()
        if isinstance(x, dict):
            left += [(f"{path}.{k}" if path else k, y) for k, y in x.items()]
        elif isinstance(x, list) and x:
            left += [(f"{path}[]", y) for y in x]
        else:
            found.add(f"{path}[]!" if isinstance(x, list) else path)
    return found


#: The paths that some layout needs. A fingerprint is over those of them that a record has.
KNOWN = sorted({path for needed, _ in LAYOUTS.values() for path in needed})


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()


def layout_of(paths: set[str]) -> str | None:
    """The layout all of whose paths are there; of several the one that needs most, then the first."""
    fits = [name for name, (needed, _) in LAYOUTS.items() if paths.issuperset(needed)]
    return max(fits, key=lambda name: len(LAYOUTS[name][0])) if fits else None


def mappings(spark: SparkSession) -> DataFrame:
    """fingerprint, layout: every fingerprint that selects a layout, by rule from KNOWN.

    There is a row for each set of known paths that some layout fits, fewer than 2 ** len(KNOWN) = 2,048
    whatever the records are, so that the table is safe to broadcast.
    """
    sets = (set(c) for n in range(len(KNOWN) + 1) for c in combinations(KNOWN, n))
    rows = [(fingerprint(paths), layout) for paths in sets if (layout := layout_of(paths))]
    return spark.createDataFrame(rows, "known string, chosen string")


@lru_cache(maxsize=100_000)
def hashed(paths: frozenset[str]) -> tuple[str, str]:
    """The hash of all paths and the fingerprint, that of the known ones. A known path into an empty list counts as there."""
    empty = tuple(p.removesuffix("!") for p in paths if p.endswith("[]!"))
    return fingerprint(paths), fingerprint(p for p in KNOWN if p in paths or (empty and p.startswith(empty)))


@F.pandas_udf(StructType([StructField("fields", StringType()), StructField("fingerprint", StringType())]))
def fingerprints(records: pd.Series) -> pd.DataFrame:
    """The hash of all field paths of each JSON record, and its fingerprint."""
    out = []
    for r in records:
        try:
            out.append(hashed(frozenset(field_paths(json.loads(r)))))
        except (TypeError, ValueError, RecursionError):
            out.append((None, None))
    return pd.DataFrame(out, columns=["fields", "fingerprint"])


def canonical(records: DataFrame, record: str = "record") -> DataFrame:
    """own (the columns of records), fields (a hash of all field paths), fingerprint, layout and turns, null where no layout fits."""
    marked = records.select(F.struct("*").alias("own"), F.try_parse_json(record).alias("v"), fingerprints(record).alias("f"))
    parsed = marked.join(F.broadcast(mappings(records.sparkSession)), F.col("f.fingerprint") == F.col("known"), "left")
    # The expressions cast what they get, so each is only evaluated for records of its layout.
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for name, (_, expression) in LAYOUTS.items():
        turns = F.when(F.col("v").isNotNull() & (F.col("chosen") == name), F.expr(expression.replace("variant_get", "try_variant_get"))).otherwise(turns)
    filled = F.transform(turns, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    return parsed.select("own", "f.fields", "f.fingerprint", F.when(filled.isNotNull(), F.col("chosen")).alias("layout"), filled.alias("turns"))


def escaped(text: str) -> str:
    """Backslashes doubled, and one set after the first character of each control string."""
    text = text.replace("\\", "\\\\")
    for c in CONTROLS:
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def unescaped(text: str) -> str:
    return "\\".join(part.replace("\\", "") for part in text.split("\\\\"))


def rendered(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the (start, end) of what the loss is taken over."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escaped(role)}{BODY}", escaped(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), mask


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns = []
    for part in formatted.split(TURN)[1:]:
        role, _, rest = part.partition(BODY)
        turns.append((unescaped(role), unescaped(rest[: -len(END)])))
    return turns


MASK = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))


def formatted(conversations: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in keep, the formatted text and its loss mask, from canonical turns."""

    def run(batch: pa.RecordBatch) -> dict:
        rows = [rendered([(t["role"], t["text"]) for t in turns or []]) for turns in batch.column("turns").to_pylist()]
        return {k: batch.column(k) for k in keep} | {"formatted": [r[0] for r in rows], "loss_mask": [[{"start": a, "end": b} for a, b in r[1]] for r in rows]}

    schema = StructType([*[conversations.schema[k] for k in keep], StructField("formatted", StringType()), StructField("loss_mask", MASK)])
    return map_batches(conversations.select(*keep, "turns"), run, schema)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


READ = [StructField("n_turns", LongType()), StructField("turns_sha256", StringType()), StructField("loss_chars", LongType()), StructField("loss_sha256", StringType()), StructField("formatted_chars", LongType())]


def digests(output: DataFrame, keep: list[str]) -> DataFrame:
    """What is read back from formatted texts and loss masks."""

    def run(batch: pa.RecordBatch) -> dict:
        rows = []
        for text, mask in zip(batch.column("formatted").to_pylist(), batch.column("loss_mask").to_pylist(), strict=True):
            turns = read_back(text)
            loss = "".join(unescaped(text[m["start"] : m["end"]]) for m in mask)
            rows.append((len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), len(text)))
        return {k: batch.column(k) for k in keep} | dict(zip([f.name for f in READ], map(list, zip(*rows, strict=True)), strict=True))

    return map_batches(output, run, StructType([*[output.schema[k] for k in keep], *READ]))


def records_of(turn_rows: DataFrame) -> DataFrame:
    """conv_id, record: the turn rows of each conversation as one JSON record, in one of two layouts with further fields.

    Only conversations of users and assistants can be put in the second one, which has names of its own for them.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), text_or_empty().alias("content"))
    grouped = turn_rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    messages = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"), t["turn"].alias("turn")))
    named = F.transform("turns", lambda t: F.struct(F.when(t["role"] == "user", "human").otherwise("gpt").alias("from"), t["content"].alias("value")))
    plain = F.forall("turns", lambda t: t["role"].isin("user", "assistant")) & (F.pmod(F.xxhash64("conv_id"), F.lit(2)) == 1)
    first = F.to_json(F.struct(F.col("conv_id").alias("id"), messages.alias("messages")))
    return grouped.select("conv_id", F.when(plain, F.to_json(F.struct(named.alias("conversations"), F.lit("chat").alias("source")))).otherwise(first).alias("record"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back, and conversation -7, which comes as a prompt and a response."""
    control = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.to_json(F.struct(F.lit(control).alias("prompt"), F.lit(control).alias("response"))).alias("record"))
    records = records_of(table(spark, sf_dir, "conversations")).unionByName(extra)
    return digests(formatted(canonical(records).select("own.conv_id", "turns"), ["conv_id"]), ["conv_id"])


def _sql() -> str:
    def esc(column: str) -> str:
        out = rf"replace({column}, '\', '\\')"
        for c in CONTROLS:
            out = rf"replace({out}, '{c}', '{c[0]}\{c[1:]}')"
        return out

    return f"""
        with t as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
        select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
            cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
            sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
            cast(sum({len(TURN) + len(BODY) + len(END)} + length({esc("role")}) + length({esc("text")})) as bigint) as formatted_chars
        from t group by conv_id"""


OP1_SQL = _sql()
