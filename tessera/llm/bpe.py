"""Operator 1: byte-pair encoding and decoding.

A word's symbols form a doubly linked list; a priority queue holds the candidate merges by
(rank, position). Entries that a neighbouring merge has made invalid are skipped when they
come up. Decoding concatenates vocabulary strings.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterable
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.common import in_slices

#: Words that a worker remembers with their ids; the oldest half goes when it is full.
MEMO_WORDS = 600_000
#: Longer words are encoded each time, so that the memory of the memo is bounded.
MEMO_CHARS = 48


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others take code points from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    others = (b for b in range(256) if b not in plain)
    shifted = {b: 256 + i for i, b in enumerate(others)}
    return [chr(shifted.get(b, b)) for b in range(256)]


def character_class(points: Iterable[int]) -> str:
    """The inside of a pattern's character class for code points in ascending order."""
    runs: list[list[int]] = []
    for c in points:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


@cache
def later_letters() -> frozenset[int]:
    """The letters and digits that the regex module knows, but Python's older Unicode tables don't: tokenizers may
    take them for letters or for symbols."""
    wide = regex.compile(r"[\p{L}\p{N}]").match
    return frozenset(c for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn" and wide(chr(c)))


def other_marks(normalize: Callable[[str], str], own: Callable[[str], str]) -> frozenset[int]:
    """The characters whose place among combining marks, or whose composition, another normalization sees otherwise
    than our own: its Unicode tables may be older.

    Each mark meets one of every combining class in both orders, which shows its class; each character that has a
    canonical decomposition is composed from it.
    """
    every = [c for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    marks = [c for c in every if unicodedata.category(chr(c))[0] == "M" or unicodedata.combining(chr(c))]

    def agree(c: int, others: Iterable[str]) -> bool:
        text = "".join(f"q{chr(c)}{r}q{r}{chr(c)}" for r in others)
        return normalize(text) == own(text)

    # Of each class the first mark that both place alike against an acute accent and a dot below, old ones both.
    one_of_class = {unicodedata.combining(chr(c)): chr(c) for c in reversed(marks) if agree(c, "\u0301\u0323")}
    unlike = {c for c in marks if not agree(c, one_of_class.values())}
    for c in every:
        parts = unicodedata.decomposition(chr(c))
        if parts and "<" not in parts:
            text = "".join(chr(int(part, 16)) for part in parts.split())
            if normalize(text) != own(text):
                unlike |= {c, *map(ord, text)}
    return frozenset(unlike)


def latin(text: str) -> bool:
    """Whether a text has Latin-1 characters only; far quicker than a search with a pattern."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@cache
def library(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


class Memo(dict):
    """word -> value, computed where missing; bounded."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, word):
        value = self.compute(word)
        if len(word) <= MEMO_CHARS:
            self[word] = value
        return value

    def trim(self) -> None:
        if len(self) > MEMO_WORDS:
            newest = list(self.items())[len(self) // 2 :]
            self.clear()
            self.update(newest)


class Bpe:
    """Encoder and decoder for a tokenizer.json file of the byte-level BPE kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.strings = dict((i, s) for s, i in self.vocab.items())
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings.update({i: s for s, i in self.special.items()})
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.has_special = regex.compile("|".join(map(regex.escape, self.special))).search if self.special else lambda _: None
        self.pairs: dict[int, int] = {}  # pair of symbols -> rank and joined symbol
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            key = self.vocab[a] << 32 | self.vocab[b]
            self.pairs[key] = rank << 32 | self.vocab[a + b]
        self.alphabet = byte_alphabet()
        self.lower = "Lowercase" in json.dumps(spec["normalizer"])
        # The two patterns are fixed values of the two public tokenizers.
        self.words = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" if self.lower
            else r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        ).findall
        self.path = path
        self.recent = lambda _: None
        if self.lower:
            unlike = later_letters() | other_marks(library(path).normalizer.normalize_str, self.normalize)
            self.recent = regex.compile(f"[{character_class(sorted(unlike))}]").search
        self.byte_of = {c: b for b, c in enumerate(self.alphabet)}
        self.byte_decoder = None
        if (spec["decoder"] or {}).get("type") == "ByteLevel":
            self.byte_decoder = {i: bytes(self.byte_of[c] for c in s) if i not in self.special.values() else s.encode() for i, s in self.strings.items()}
        self.first = [self.vocab.get(c) for c in self.alphabet]
        self.last = [self.vocab.get(c + self.suffix) for c in self.alphabet]
        self.memo = Memo(lambda word: array("I", self.merge(self.symbols(word))).tobytes())

    def symbols(self, word: str) -> list[int]:
        """A word's bytes as vocabulary ids; the last carries the end-of-word suffix."""
        raw = word.encode()
        ids = [self.first[b] for b in raw[:-1]] + [self.last[raw[-1]]] if raw else []
        return [i for i in ids if i is not None]

    def merge(self, ids: list[int]) -> list[int]:
        """Apply merges in the order of (rank, position) until none is left. An entry of the queue is one
        integer: rank, joined symbol and position."""
        n = len(ids)
        if n < 2:
            return ids
        ids, find = list(ids), self.pairs.get
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            found = find(ids[i] << 32 | ids[i + 1])
            if found is not None:
                queue.append(found << 32 | i)
        heapify(queue)
        while queue:
            top = heappop(queue)
            i = top & 0xFFFFFFFF
            j = after[i]
            # Stale entries are skipped: a symbol of the pair is gone, or the pair has changed.
            if j < 0 or find(ids[i] << 32 | ids[j]) != top >> 32:
                continue
            joined = ids[i] = top >> 32 & 0xFFFFFFFF
            ids[j] = -1
            k = after[i] = after[j]
            after[j] = -1
            if k >= 0:
                before[k] = i
                found = find(joined << 32 | ids[k])
                if found is not None:
                    heappush(queue, found << 32 | i)
            h = before[i]
            if h >= 0:
                found = find(ids[h] << 32 | joined)
                if found is not None:
                    heappush(queue, found << 32 | h)
        return [i for i in ids if i >= 0]

    def normalize(self, text: str) -> str:
        if not self.lower:
            return text
        if not text.isascii():
            # Lower-casing goes by single characters: no final form of sigma.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers. Strings of special
        tokens inside the text become those tokens."""
        if self.has_special(text):
            out = []
            for i, part in enumerate(self.split_special(text)):
                out.append(np.uint32(self.special[part]).tobytes() if i % 2 else self.encode_plain(part))
            return b"".join(out)
        return self.encode_plain(text)

    def library_words(self, text: str) -> list[str]:
        """The words of a text with very recent letters or marks, on which Unicode tables differ: the
        library normalizes and splits it; its tables decide."""
        rules = library(self.path)
        return [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in rules.pre_tokenizer.pre_tokenize_str(rules.normalizer.normalize_str(text))]

    def encode_plain(self, text: str) -> bytes:
        if not latin(text) and self.recent(text):
            return b"".join(map(self.memo.__getitem__, self.library_words(text)))
        return b"".join(map(self.memo.__getitem__, self.words(self.normalize(text))))

    def decode(self, ids: Iterable[int]) -> str:
        """Special tokens are kept. A vocabulary of bytes gives their text, with U+FFFD for
        broken sequences; without a decoder the strings are joined by spaces."""
        if self.byte_decoder is None:
            return " ".join(map(self.strings.__getitem__, ids))
        return b"".join(map(self.byte_decoder.__getitem__, ids)).decode("utf-8", "replace")


@cache
def bpe(path: str) -> Bpe:
    """One encoder for each Python worker and file."""
    return Bpe(path)


def encode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary, decoded string) for each row of df, in its order and partitions.

    `ids` holds little-endian unsigned 32-bit integers. `tokenizer` is the path of a
    tokenizer.json on every machine. A null text counts as empty: no ids, an empty decoded text.
    Repeated rows give repeated results, an empty table an empty one; other columns of df are
    left out, so their names can't clash. No shuffle; a worker holds one slice of rows.
    """

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        coder = bpe(tokenizer)
        coder.memo.trim()
        ids = [coder.encode(t or "") for t in rows.column(1).to_pylist()]
        decoded = [coder.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
        return pa.record_batch([rows.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["id", "ids", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    chosen = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(in_slices(run, 256), f"id {kind}, ids binary, decoded string").withColumnRenamed("id", id_col)
