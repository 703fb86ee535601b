"""Secret scans by dictionary-primed zstandard novelty.

Base patterns find assignments, access keys and long hex strings. Beside them, any token of
16 characters or more with both letters and digits, or of 24 letters or more that change case at
least every third time on average, that starts within 40 characters after a
sensitive word is a candidate, to its end. Its novelty is the number of bytes that it adds to the
compressed size of the text around it, with a dictionary of code and identifier words
already known to the compressor, for each byte of the candidate. Identifiers, paths and
repeats of the surrounding code add few bytes; random strings add about as many as they
have. Of a long candidate, pieces of about 512 bytes are measured; one at the threshold is
enough. Candidates at or above the threshold that touch no base span are reported as novel.

Copies of a candidate in its surroundings, also such as the context cuts off, are taken out before it is measured, so that a secret
that stands twice is as novel as one that stands once; and every further occurrence of a string that was
found, or of an assigned value that is novel, is reported wherever it stands. Between a BEGIN line that names a private or secret
key and its END, or the next BEGIN, the whole lines of key characters are a key, header lines or not, if one of them is novel.

A novel candidate goes on over the runs that follow it, without bound: those joined to it by
a point (the parts of a signed token) and those that fill the next line (the lines of a key,
also where line ends are written as \\n or lines are quoted), while each is novel itself. A
shorter run counts between two such parts, or as the last line of several. Where an
assignment or another base span has the first part, what goes on after it is reported.

Cases: null text counts as empty; a text of any length is scanned whole; repeated rows give
repeated results; other columns of the input are not read. Offsets are in code points, end
exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ledgerlens.llm.common import map_batches, table, texts

KINDS = ["assign", "access", "hex", "novel"]
#: The level is one that looks for short matches: lower ones miss known words and so find them as novel as random strings.
NOVELTY, CONTEXT, LEVEL = 0.75, 160, 19
REACH, LEAST, PIECE = 40, 16, 512
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ASSIGN_WORDS = [b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"]
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
SENSITIVE = re.compile(rb"(?:secret|token|passw|api[ _-]?key|auth|bearer|credential|private|access[ _-]?key|signature)", re.I)
SENSITIVE_WORDS = [b"secret", b"token", b"passw", b"api", b"auth", b"bearer", b"credential", b"private", b"access", b"signature"]
TOKEN = re.compile(rb"[A-Za-z0-9+/_=-]{16,}")
RUN = re.compile(rb"[A-Za-z0-9+/_=-]+")
BOTH = re.compile(rb"(?=.*[0-9])(?=.*[A-Za-z])", re.S)
#: What a run that goes on looks like: letters and digits, or capitals after the first letter.
MIXED = re.compile(rb"(?=.*[0-9])(?=.*[A-Za-z])|(?=.*[a-z])(?=.+[A-Z])", re.S)
WORD = re.compile(rb"[A-Za-z]?[a-z]*|[A-Z]*")
SWITCH = re.compile(rb"(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]")
BEGIN = re.compile(rb"-----BEGIN [A-Z0-9 ]*(?:PRIVATE|SECRET)[A-Z0-9 ]*-----")
#: Where a key's block ends and where its next line starts.
BLOCK_END = re.compile(rb"-----(?:END|BEGIN) ")
NEXT_LINE = re.compile(rb"\r?\n|(?:\\r)?\\n")
#: How parts of one secret are joined: points; a line end, written out or real, with its quotes.
POINTS = re.compile(rb"\.{1,2}")
LINE = re.compile(rb"""(?:\\r)?\\n(?!["'])|(?:(?:\\r)?\\n)?["']?[ \t]{0,8}[+,\\]?[ \t]{0,8}\r?\n[ \t>#*|]{0,32}["']?""")
LINE_START = re.compile(rb"""(?:^|\n|\\n)[ \t>#*|]{0,32}["']?\Z""")
KEY_END = re.compile(rb"""["' \t,+;\\]{0,8}(?:\r?\n|\\n)[ \t>#*|"']{0,32}-----END""")
LINE_END = re.compile(rb"""["' \t,+;\\]{0,8}(?:\r?\n|\Z)|(?:\\r)?\\n""")
#: Every byte that is a lower-case hex digit becomes x, any other a space.
HEXMAP = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))

#: What the compressor knows beforehand: words of code and of identifiers, alone and in the ways in which identifiers join them.
VERBS = "get set is has new max min client user server request response session config default public private static create update delete insert select query sign verify encrypt decrypt".split()
NOUNS = "name value type count index path file data list key token secret password access auth header body url host port time date status error message handler manager service factory".split()
MORE = """signature credential build test class method object string number json http https html css js py src lib bin usr etc home dev prod local api app web admin login hash salt certificate master main release version table
    column row schema model view controller router store cache queue worker job task event stream topic channel network socket address domain email account profile group role permission policy rule filter map array buffer byte char
    int float double bool void async await return import export final const var let function lambda module package include define struct enum interface abstract extends override throw catch exception warning info debug trace log counter timer""".split()
DICTIONARY = b" ".join(
    [*(f"{a}_{b} {a}{b.title()} {a}-{b} {a}.{b}".encode() for a in VERBS for b in NOUNS), *(f"{w} {w.title()}".encode() for w in MORE), *(f"_{w}_ /{w}/ -{w}-".encode() for w in MORE)]
) + b" null undefined true false https://www.example.com/api/v1/ application/json Content-Type Authorization: Bearer 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@lru_cache(maxsize=1)
def compressor() -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(DICTIONARY, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primed.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_content_size=False, write_checksum=False)


#: What stands before a text that is shorter than its context: very short inputs are not compressed at all.
FILL = (b"Nothing is known of what came before this, so some plain words stand here, in place of any others, as they would in a letter or a note of 3 pages from 1987. " * 2)[:CONTEXT]


def without_copies(text: bytes, candidate: bytes) -> bytes:
    """The text without the candidate, and without a copy of which its start or end cuts off a part."""
    text = text.replace(candidate, b" ")
    for k in range(min(len(candidate) - 1, len(text)), 3, -1):
        if text.startswith(candidate[-k:]):
            text = text[k:]
            break
    for k in range(min(len(candidate) - 1, len(text)), 3, -1):
        if text.endswith(candidate[:k]):
            return text[:-k]
    return text


def novelty(before: bytes, candidate: bytes, after: bytes) -> float:
    """Bytes that the candidate adds to its compressed surroundings, for each of its own."""
    pack = compressor().compress
    before, after = without_copies(before, candidate)[-CONTEXT:], without_copies(after, candidate)[:CONTEXT]
    before = FILL[len(before) :] + before
    return (len(pack(before + after + candidate)) - len(pack(before + after))) / len(candidate)


def novel(data: bytes, start: int, end: int, threshold: float, first: int | None = None) -> bool:
    """Whether the run, or a piece of it where it is long, is novel in its surroundings.

    The other parts of the same secret would lend it their statistics; so where more may follow
    or the secret began before, at first, the text before the secret is a second measure.
    """
    n = -(-(end - start) // PIECE)
    at = [start + (end - start) * k // n for k in range(n + 1)]
    # Surroundings twice as wide are read, for copies to be taken out of.
    if any(novelty(data[max(0, a - 2 * CONTEXT) : a], data[a:b], data[b : b + 2 * CONTEXT]) >= threshold for a, b in zip(at, at[1:])):
        return True
    if first is None and not ((join := POINTS.match(data, end) or LINE.match(data, end)) and RUN.match(data, join.end())):
        return False
    first = start if first is None else first
    before = data[max(0, first - CONTEXT) : first]
    return any(novelty(before, data[a:b], b"") >= threshold for a, b in zip(at, at[1:]))


def whole_line(data: bytes, start: int, end: int) -> bool:
    return bool(LINE_START.search(data, max(0, start - 40), start) and LINE_END.match(data, end))


def going_on(data: bytes, start: int, end: int, threshold: float, first: int) -> list[tuple[int, int]]:
    """The runs that go on after a novel run of a secret from first on, in order: further parts and further lines."""
    runs: list[tuple[int, int]] = []
    short: list[tuple[int, int]] = []
    while True:
        join = POINTS.match(data, end)
        lines = None if join else LINE.match(data, end)
        run = RUN.match(data, (join or lines).end()) if join or lines else None
        if not run:
            return runs
        if lines and not short and KEY_END.match(data, run.end()):
            return [*runs, run.span()]
        if run.end() - run.start() < LEAST:
            if join and not short:  # counts if a full part follows
                short = [run.span()]
                end = run.end()
                continue
            last = lines and not short and run.end() - run.start() < end - start and whole_line(data, start, end) and LINE_END.match(data, run.end())
            return runs + [run.span()] if last and not WORD.fullmatch(run.group()) else runs
        if lines and (short or not LINE_END.match(data, run.end())) or not MIXED.match(run.group()) or not novel(data, *run.span(), threshold, first):
            return runs
        runs += [*short, run.span()]
        short = []
        start, end = run.span()


def key_blocks(data: bytes, threshold: float) -> list[tuple[int, int]]:
    """The lines of keys between BEGIN and END, whatever stands before them in the block."""
    runs: list[tuple[int, int]] = []
    for begin in BEGIN.finditer(data):
        stop = BLOCK_END.search(data, begin.end())
        limit = stop.start() if stop else len(data)
        lines: list[tuple[int, int]] = []
        at = begin.end()
        while (join := LINE.match(data, at, limit)) or (join := NEXT_LINE.search(data, at, limit)):
            run = RUN.match(data, join.end(), limit)
            if run and (run.end() == limit or LINE_END.match(data, run.end())):
                lines.append(run.span())
            at = max(run.end() if run else 0, join.end())
        if any(b - a >= LEAST and novel(data, a, b, threshold, begin.start()) for a, b in lines):
            runs += lines
    return runs


def again(data: bytes, spans: list[tuple[int, int, int]], found: set[bytes]) -> list[tuple[int, int, int]]:
    """Further occurrences of found strings outside of all spans, in one pass over the text."""
    automaton = ahocorasick.Automaton()
    for x in found:
        automaton.add_word(x.decode("latin-1"), len(x))
    automaton.make_automaton()
    starts, ends = merged(spans)
    more = []
    for last, size in automaton.iter(data.decode("latin-1")):
        start, end = last + 1 - size, last + 1
        k = bisect_left(starts, start + 1) - 1
        if k < 0 or ends[k] < end:
            more.append((start, 3, end))
    return more


def candidate(data: bytes, start: int, end: int) -> bool:
    """Letters and digits, or many letters that change case as often as no identifier does."""
    return bool(BOTH.match(data, start, end)) or end - start >= 24 and 3 * len(SWITCH.findall(data, start, end)) >= end - start


def find(data: bytes, threshold: float = NOVELTY) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes, in order."""
    low = data.lower()
    spans: list[tuple[int, int, int]] = []
    if any(w in low for w in ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(data) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in data:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(data) if m.end() - m.start() >= 20]
    if b"x" * 24 in data.translate(HEXMAP):
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(data)]
    if any(w in low for w in SENSITIVE_WORDS):
        if b"-----BEGIN " in data:
            base = merged(spans)
            spans += [(a, 3, b) for a, b in key_blocks(data, threshold) if (k := bisect_left(base[0], b) - 1) < 0 or base[1][k] <= a]
        starts, ends = merged(spans)
        reach = 0
        for word in SENSITIVE.finditer(data):
            at = max(word.end(), reach)
            # A candidate starts within REACH bytes of the word; where it starts shows in its first LEAST bytes.
            while m := TOKEN.search(data, at, word.end() + REACH + LEAST):
                start, end = TOKEN.match(data, m.start()).span()
                at = reach = end
                if not candidate(data, start, end) or not novel(data, start, end, threshold):
                    continue
                k = bisect_left(starts, end) - 1
                parts = [(start, end)]
                if k >= 0 and ends[k] > start:
                    end = max(end, ends[k])
                    parts = []
                for run in going_on(data, start, end, threshold, start):
                    at = reach = run[1]
                    k = bisect_left(starts, run[1]) - 1
                    if k >= 0 and ends[k] > run[0]:
                        end = -1  # a base span has this part
                    elif parts and parts[-1][1] == end:
                        parts[-1] = (parts[-1][0], run[1])
                        end = run[1]
                    else:
                        parts.append(run)
                        end = run[1]
                spans += [(a, 3, b) for a, b in parts]
    found = {data[a:b] for a, k, b in spans if k == 3 and b - a >= LEAST}
    for a, k, b in spans:
        if not k and b - a >= LEAST:
            value = ASSIGN.match(data, a, b).span(2)
            if value[1] - value[0] >= LEAST and candidate(data, *value) and novel(data, *value, threshold):
                found.add(data[slice(*value)])
    return sorted([*spans, *again(data, spans, found)] if found else spans)


def merged(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """The starts and ends of the stretches that the spans cover, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for start, _, end in sorted(spans):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def in_code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Offsets in bytes as offsets in code points; one pass over the bytes up to the last span."""
    if not spans or data.isascii():
        return spans
    at: dict[int, int] = {}
    last = points = 0
    for x in sorted({p for s, _, e in spans for p in (s, e)}):
        points += len(data[last:x].decode("utf-8", "surrogatepass"))
        at[x] = points
        last = x
    return [(at[s], k, at[e]) for s, k, e in spans]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


FOUND = [StructField("n_assign", LongType()), StructField("n_access", LongType()), StructField("n_hex", LongType()), StructField("n_novel", LongType()), StructField("base_sha256", StringType()), StructField("spans", StringType())]


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns in keep, the number of spans of each kind, and all spans."""

    def run(batch: pa.RecordBatch) -> dict:
        rows = []
        for t in texts(batch, "secret_text"):
            data = t.encode("utf-8", "surrogatepass")
            spans = in_code_points(data, find(data))
            base = joined([x for x in spans if x[1] < 3])
            rows.append((*[sum(x[1] == k for x in spans) for k in range(4)], hashlib.sha256(base.encode()).hexdigest(), joined(spans)))
        return {k: batch.column(k) for k in keep} | dict(zip([f.name for f in FOUND], map(list, zip(*rows, strict=True)), strict=True))

    return map_batches(docs.select(*keep, docs[text].alias("secret_text")), run, StructType([*[docs.schema[k] for k in keep], *FOUND]))


def redact(text: str, mark: str = "<secret>") -> str:
    """The text with each stretch of overlapping spans replaced by the mark."""
    data, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    for start, _, end in find(data):
        if start >= at:
            out += [data[at:start], mark.encode()]
        at = max(at, end)
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass") if out else text


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with their secrets replaced in text, and n_chars, where there is one, counted anew for those."""
    chars = "n_chars" in docs.columns

    def run(batch: pa.RecordBatch) -> dict:
        old = batch.column("text").to_pylist()
        new = [t and redact(t) for t in old]
        out = {c: batch.column(c) for c in batch.schema.names} | {"text": new}
        return out | ({"n_chars": [n if a == b else len(b) for n, a, b in zip(batch.column("n_chars").to_pylist(), old, new, strict=True)]} if chars else {})

    return map_batches(docs, run, docs.schema)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in every document."""
    return scan(table(spark, sf_dir, "documents"), ["doc_id"])


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their secrets."""
    return redacted(docs)
