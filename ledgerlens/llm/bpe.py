"""Byte-level BPE by backtracking over longest token matches.

For every pre-token an Aho-Corasick automaton over the vocabulary gives the longest token
at each position. Tokens are laid down from the left; a token may follow another only if
the pair is compatible, that is if the merges that build the two would not have merged
across their border first. Where no token fits, the last one is taken back and a shorter
one is tried; a bit for each position keeps any from being tried twice, so the time is
linear in the text. Decoding looks token bytes up in one blob by an offset table.

Cases: null text counts as empty (no tokens); text of any length is encoded whole; the
strings of added tokens inside a text become those tokens, as the tokenizers library does
by default; a pre-token may be as long as the text.
"""

from __future__ import annotations

import hashlib
import json
import struct
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from ledgerlens.llm.common import map_batches, table, texts

#: Pre-tokens of the byte-level pattern; white space is Unicode's.
SPACES = r"\t-\r\x85\p{Z}"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
REMEMBERED = 300_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, as letter to byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    return letters


def packed_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def checked(spec: dict, path: str) -> None:
    """Refuse a file whose settings are not those that are built in here."""
    before, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if spec.get("normalizer") or not plain or model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        raise ValueError(f"{path} is no plain byte-level vocabulary")


class Codec:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        checked(spec, path)
        letter = byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: list[bytes] = [b""] * (max(*vocab.values(), *self.added.values()) + 1)
        for word, i in vocab.items():
            if word not in self.added:
                self.tokens[i] = bytes(letter[c] for c in word)
        ids = {t: i for i, t in enumerate(self.tokens) if t}
        self.byte_id = [ids[bytes([b])] for b in range(256)]
        self.rank: dict[int, int] = {}  # of the merge that makes a token; lone bytes have none
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for k, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            i = vocab[a + b]
            self.merged[vocab[a], vocab[b]] = k
            self.rank.setdefault(i, k)
            self.halves.setdefault(i, (vocab[a], vocab[b]))
        made = set(self.rank) | set(self.byte_id)
        self.shorter: dict[int, int | None] = {}
        self.automaton = ahocorasick.Automaton()
        for t, i in ids.items():
            if i in made:
                self.automaton.add_word(t.decode("latin-1"), i)
                self.shorter[i] = next((x for n in range(len(t) - 1, 0, -1) if (x := ids.get(t[:n])) in made), None)
        self.automaton.make_automaton()
        self.sizes = list(map(len, self.tokens))
        for s, i in self.added.items():
            self.tokens[i] = s.encode()
        self.offsets = np.zeros(len(self.tokens) + 1, np.int64)
        self.offsets[1:] = np.cumsum([len(t) for t in self.tokens])
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pre_tokens = regex.compile(PATTERN).findall
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}
        self.stretches: dict[str, bytes] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether left and right stay apart: no merge across their border comes before those that build them."""
        key = (left, right)
        if (known := self.pairs.get(key)) is not None:
            return known
        a, b, good = left, right, True
        limit = len(self.merged)  # of the merge that made what stands beside the border next
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < limit:
                good = False
                break
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                break
            # Undo the later of the two merges, the right one of two of the same rank, as merges run
            # left to right; so too a merge across the border wins over the right one at the same rank.
            if ra > rb:
                limit, a = min(limit, ra), self.halves[a][1]
            else:
                limit, b = min(limit, rb + 1), self.halves[b][0]
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        self.pairs[key] = good
        return good

    def backtrack(self, data: bytes) -> list[int]:
        """The tokens of one pre-token."""
        n = len(data)
        longest: list[int] = [0] * n
        sizes, pairs, shorter = self.sizes, self.pairs, self.shorter
        for end, i in self.automaton.iter(data.decode("latin-1")):
            start = end - sizes[i] + 1  # matches that end later are longer
            longest[start] = i
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, last, token = 0, -1, longest[0] if n else None
        while at < n:
            while token is not None:
                end = at + sizes[token]
                if open_at[end]:
                    if last < 0:
                        break
                    good = pairs.get((last, token))
                    if self.compatible(last, token) if good is None else good:
                        break
                token = shorter[token]
            if token is None:
                open_at[at] = 0
                token = out.pop()
                last = out[-1] if out else -1
                at -= sizes[token]
                token = shorter[token]
            else:
                out.append(token)
                at, last = end, token
                token = longest[at] if at < n else None
        return out

    def packed(self, word: str) -> bytes:
        if (ids := self.known.get(word)) is None:
            ids = packed_ids(self.backtrack(word.encode("utf-8", "surrogatepass")))
            if len(word) <= 64:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[word] = ids
        return ids

    def stretch(self, word: str) -> bytes:
        """The ids of a space and what follows up to the next one."""
        ids = self.stretches.get(word)
        if ids is None:
            ids = b"".join([self.packed(w) for w in self.pre_tokens(" " + word)])
            if len(word) <= 64:
                if len(self.stretches) >= REMEMBERED:
                    self.stretches.clear()
                self.stretches[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        parts = self.split_added.split(text) if self.split_added and any(a in text for a in self.added) else [text]
        out = []
        for part in parts:
            if part in self.added:
                out.append(packed_ids([self.added[part]]))
                continue
            # Where no space stands before white space or the end, a pre-token begins at each
            # space, and the stretches between them can be looked up whole.
            first, *rest = part.split(" ")
            try:
                found = b"".join([self.stretches[w] for w in rest])
            except KeyError:
                if any(not w or w[0].isspace() for w in rest):
                    first = part
                    found = b""
                else:
                    found = b"".join([self.stretch(w) for w in rest])
            out += [*[self.packed(w) for w in self.pre_tokens(first)], found]
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the tokens, one after the other."""
        i = np.frombuffer(ids, "<u4")
        if not len(i):
            return b""
        start = self.offsets[i]
        size = self.offsets[i + 1] - start
        before = np.cumsum(size) - size
        return self.blob[np.repeat(start - before, size) + np.arange(int(size.sum()))].tobytes()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoded(docs: DataFrame, keep: list[str], path: str, text: str = "text") -> DataFrame:
    """The columns in keep and, as bpe_ids, the ids as little-endian 32-bit integers."""

    def run(batch: pa.RecordBatch) -> dict:
        c = codec(path)
        return {k: batch.column(k) for k in keep} | {"bpe_ids": [c.encode(t) for t in texts(batch, "bpe_text")]}

    source = docs.select(*keep, docs[text].alias("bpe_text"))
    return map_batches(source, run, StructType([*[docs.schema[k] for k in keep], StructField("bpe_ids", BinaryType())]))


def decoded(ids: DataFrame, keep: list[str], path: str, column: str = "bpe_ids") -> DataFrame:
    """The columns in keep and, as bpe_text, the text of the ids; bytes that are no UTF-8 give U+FFFD."""

    def run(batch: pa.RecordBatch) -> dict:
        c = codec(path)
        return {k: batch.column(k) for k in keep} | {"bpe_text": [c.decode(x or b"").decode("utf-8", "replace") for x in batch.column(column).to_pylist()]}

    return map_batches(ids.select(*dict.fromkeys([*keep, column])), run, StructType([*[ids.schema[k] for k in keep], StructField("bpe_text", StringType())]))


DIGESTS = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]


def digests(docs: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """Encode and decode each text and return the columns in keep and the digests of both."""

    def run(batch: pa.RecordBatch) -> dict:
        c = codec(path)
        ids = [c.encode(t) for t in texts(batch, "bpe_text")]
        back = [hashlib.sha256(c.decode(x).decode("utf-8", "replace").encode()).hexdigest() for x in ids]
        return {k: batch.column(k) for k in keep} | {"n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids], "decoded_sha256": back}

    source = docs.select(*keep, docs["text"].alias("bpe_text"))
    return map_batches(source, run, StructType([*[docs.schema[k] for k in keep], *DIGESTS]))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of every document."""
    return digests(table(spark, sf_dir, "documents"), default_path(), ["doc_id"])


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document it is given, as ids with their digests."""
    return digests(docs, default_path(), ["doc_id", "lang", "source"])
