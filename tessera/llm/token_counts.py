"""Operator 2: token counts by finite-state transducers.

Two deterministic transducers are compiled from a byte-level BPE tokenizer. The first splits
text into words: its transitions are annotated with the word starts that they emit. The second runs over bytes: a transition
is annotated with the number of tokens by which the count changes. Its states are made
when first met (as lazy automata do), since most of them never occur.

All texts of a slice form one stream, cut into chunks. The splitter's map of a chunk from state to state is an
element of its transition monoid, and the maps compose through a parallel prefix scan, after which all chunks emit
at once. At a word start the counter begins anew from any state, so its map of what lies between two word starts is a
constant: a state and a count. So the counter's chunks are cut at the first word start behind each border; they step side by
side, one byte of each at a time, through a hashed table of transitions, and their counts are
composed by running sums.
"""

from __future__ import annotations

import sys
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import Bpe, bpe
from tessera.llm.common import in_slices

CHUNK = 256
#: Bytes of the counter's chunks, about; of a longer one (a longer word) the rest runs alone.
LANE = 512
#: Compiled transitions that a worker keeps; beyond it compilation starts anew. The table has room for three times as many.
MAX_TRANSITIONS, TABLE_BITS, MIX = 600_000, 21, 0x9E3779B97F4A7C15

# Classes of characters, and states, of the word splitter.
CLASSES = ("stmd", "r", "v", "l", "e", "letter", "number", "quote", "other", "space", "white", "end")
LETTERS = CLASSES[:6]
STATES = ("start", "letters", "numbers", "others", "quote", "quote r", "quote v", "quote l", "space", "white", "spaces", "whites")
HERE, BEFORE = 1, 2


def enter(kind: str) -> str:
    """The state after the first character of a word."""
    if kind in LETTERS:
        return "letters"
    return {"number": "numbers", "quote": "quote", "other": "others", "space": "space", "white": "white", "end": "start"}[kind]


def joined(kind: str) -> str:
    """The state after a character that continues a word begun by one space."""
    return "others" if kind == "quote" else enter(kind)


def step(state: str, kind: str) -> tuple[str, int]:
    """The next state, and whether a word starts HERE or at the character BEFORE."""
    if kind == "end":
        return "start", HERE | (BEFORE if state in ("quote r", "quote v", "quote l") else 0)
    blank = kind in ("space", "white")
    if state in ("quote r", "quote v", "quote l"):
        if kind == {"quote r": "e", "quote v": "e", "quote l": "l"}[state]:
            return "start", 0
        return ("letters", BEFORE) if kind in LETTERS else (enter(kind), BEFORE | HERE)
    if state == "quote":
        if kind == "stmd":
            return "start", 0
        if kind in ("r", "v", "l"):
            return f"quote {kind}", 0
        return ("others", 0) if kind in ("quote", "other") else (enter(kind), HERE)
    if state in ("space", "white", "spaces", "whites") and blank:
        return ("spaces" if kind == "space" else "whites"), 0
    if state == "space":
        return joined(kind), 0
    if state == "spaces":
        return joined(kind), BEFORE
    if state == "whites":
        return enter(kind), BEFORE | HERE
    if (state, enter(kind)) in (("letters", "letters"), ("numbers", "numbers")) or state == "others" and kind in ("quote", "other"):
        return state, 0
    return enter(kind), HERE


class Splitter:
    """The compiled word transducer."""

    def __init__(self):
        k, s = len(CLASSES), len(STATES)
        moves = [[step(a, c) for c in CLASSES] for a in STATES]
        self.next = np.array([[STATES.index(m[0]) for m in row] for row in moves], np.uint8).ravel()
        self.emit = np.array([[m[1] for m in row] for row in moves], np.uint8).ravel()
        # The transition monoid: every map from states to states that some string has.
        maps = [tuple(range(s))]
        known = {maps[0]: 0}
        right: list[list[int]] = []
        for m in maps:  # grows meanwhile
            row = []
            for c in range(k):
                new = tuple(int(self.next[x * k + c]) for x in m)
                if new not in known:
                    known[new] = len(maps)
                    maps.append(new)
                row.append(known[new])
            right.append(row)
        self.by_class = np.array(right, np.uint16).ravel()
        self.maps = np.array(maps, np.uint8)
        self.both = np.array([[known[tuple(b[x] for x in a)] for b in maps] for a in maps], np.uint16)
        self.class_of = classes()

    def starts(self, stream: np.ndarray) -> np.ndarray:
        """Where words start in a stream of classes. The end of a text counts as one."""
        n, k = len(stream), len(CLASSES)
        chunks = -(-n // CHUNK)
        padded = np.full(chunks * CHUNK, CLASSES.index("end"), np.uint8)
        padded[:n] = stream
        columns = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
        m = np.zeros(chunks, np.intp)
        for c in columns:
            m = self.by_class[m * k + c]
            m = m.astype(np.intp)
        # Parallel prefix scan: after round i, m[j] is the map of the 2^i chunks up to j.
        width = 1
        while width < chunks:
            m = np.concatenate([m[:width], self.both[m[:-width], m[width:]].astype(np.intp)])
            width *= 2
        state = np.zeros(chunks, np.intp)
        state[1:] = self.maps[m[:-1], 0]
        emitted = np.empty_like(columns)
        for i, c in enumerate(columns):
            at = state * k + c
            emitted[i] = self.emit[at]
            state = self.next[at].astype(np.intp)
        flags = emitted.T.ravel()[:n]
        here = flags & HERE > 0
        here[:-1] |= flags[1:] & BEFORE > 0
        return np.flatnonzero(here)


@cache
def splitter() -> Splitter:
    return Splitter()


@cache
def classes() -> np.ndarray:
    """The class of every code point."""
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "" for c in range(sys.maxunicode + 1))
    out = np.full(len(every), CLASSES.index("other"), np.uint8)
    for pattern, name in ((r"\p{L}+", "letter"), (r"\p{N}+", "number"), (r"\s+", "white")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = CLASSES.index(name)
    for chars, name in (("stmd", "stmd"), ("r", "r"), ("v", "v"), ("l", "l"), ("e", "e"), ("'", "quote"), (" ", "space")):
        out[[ord(c) for c in chars]] = CLASSES.index(name)
    return out


class Transitions:
    """A hashed table (state, byte) -> (next state, change of the count) that is asked for many keys at once."""

    def __init__(self):
        self.keys = np.full(1 << TABLE_BITS, -1, np.int64)
        self.next = np.zeros(1 << TABLE_BITS, np.int32)
        self.change = np.zeros(1 << TABLE_BITS, np.int16)
        self.size = 0

    def places(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key is or would be, and which of them are missing."""
        at = (wanted.astype(np.uint64) * np.uint64(MIX) >> np.uint64(64 - TABLE_BITS)).astype(np.intp)
        there = self.keys[at]
        todo = np.flatnonzero(there != wanted)
        missing = []
        while len(todo):
            empty = there[todo] < 0
            missing.append(todo[empty])
            todo = todo[~empty]
            at[todo] = (at[todo] + 1) & ((1 << TABLE_BITS) - 1)
            there[todo] = self.keys[at[todo]]
            todo = todo[there[todo] != wanted[todo]]
        return at, np.concatenate(missing) if missing else todo

    def put(self, key: int, state: int, change: int) -> None:
        at = (key * MIX & (1 << 64) - 1) >> 64 - TABLE_BITS
        while self.keys.item(at) >= 0:
            at = at + 1 & (1 << TABLE_BITS) - 1
        self.keys[at], self.next[at], self.change[at] = key, state, change
        self.size += 1


class Counter:
    """The count transducer of a byte-level BPE vocabulary, compiled on demand.

    After each prefix of a word, the last token of its encoding is known: the one token t that
    ends there and may follow the last token before t. A state holds, for each suffix
    that a longer token could still begin with, the last token where the suffix starts and the
    count there, relative to the present one. Start is token -1. States are kept packed: the length of the
    suffix, the suffix, and pairs of token and count.
    """

    def __init__(self, coder: Bpe):
        if coder.byte_decoder is None or coder.suffix:
            raise ValueError("a byte-level vocabulary without end-of-word suffix is needed")
        self.coder = coder
        self.ids = {raw: i for i, raw in coder.byte_decoder.items() if i not in coder.special.values()}
        self.raw = {i: raw for raw, i in self.ids.items()}
        if max(map(len, self.ids)) > 255:
            raise ValueError("tokens are too long for packed states")
        self.prefixes = {raw[:n] for raw in self.ids for n in range(1, len(raw))}
        self.follows: dict[tuple[int, int], bool] = {}
        self.reset()
        self.splitter = splitter()

    def reset(self) -> None:
        self.table = Transitions()
        self.moves: dict[int, tuple[int, int]] = {}  # of words that run alone
        self.states = [self.pack(b"", ((-1, 0),))]
        self.numbers = {self.states[0]: 0}

    @staticmethod
    def pack(suffix: bytes, entries: tuple[tuple[int, int], ...]) -> bytes:
        return bytes((len(suffix),)) + suffix + array("i", [v for e in entries for v in e]).tobytes()

    def unpack(self, state: int) -> tuple[bytes, list[tuple[int, int]]]:
        raw = self.states[state]
        n = raw[0] + 1
        values = array("i", raw[n:])
        return raw[1:n], list(zip(values[::2], values[1::2], strict=True))

    def number(self, packed: bytes) -> int:
        found = self.numbers.setdefault(packed, len(self.states))
        if found == len(self.states):
            self.states.append(packed)
        return found

    def may_follow(self, last: int, token: int) -> bool:
        found = self.follows.get((last, token))
        if found is None:
            if len(self.follows) > MAX_TRANSITIONS:
                self.follows.clear()
            left = [] if last < 0 else [last]
            raw = (self.raw[last] if last >= 0 else b"") + self.raw[token]
            found = self.coder.merge([self.coder.first[b] for b in raw]) == [*left, token]
            self.follows[last, token] = found
        return found

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of a state on a byte: the next state and the change of the count."""
        suffix, before = self.unpack(state)
        text = suffix + bytes((byte,))
        for length in range(len(text), 0, -1):
            token = self.ids.get(text[-length:])
            if token is not None and self.may_follow(before[length - 1][0], token):
                break
        else:
            raise ValueError("no token fits; the vocabulary lacks a byte")
        change = before[length - 1][1] + 1
        keep = next((n for n in range(len(text), 0, -1) if text[-n:] in self.prefixes), 0)
        entries = ((token, 0), *((t, c - change) for t, c in before[:keep]))
        return self.number(self.pack(text[len(text) - keep :], entries)), change

    def step(self, state: int, byte: int) -> tuple[int, int]:
        found = self.moves.get(state << 8 | byte)
        if found is None:
            found = self.moves[state << 8 | byte] = self.compile(state, byte)
        return found

    def begin(self, states: np.ndarray) -> np.ndarray:
        """The numbers of the states after a new beginning of the compilation, if the time for one has come."""
        if self.table.size + len(self.moves) <= MAX_TRANSITIONS:
            return states
        old = [self.states[i] for i in states.tolist()]
        self.reset()
        return np.array([self.number(packed) for packed in old], np.int64)

    def side_by_side(self, states: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The transitions of several states on a byte each: next states and changes."""
        wanted = states << 8 | data
        at, missing = self.table.places(wanted)
        if len(missing):
            for key in np.unique(wanted[missing]).tolist():
                self.table.put(key, *self.compile(key >> 8, key & 255))
            at, _ = self.table.places(wanted)
        return self.table.next[at].astype(np.int64), self.table.change[at]

    def changes(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """By how much the count changes at each byte of a stream in which words start at the given bytes, the first
        of them at 0. Of a very long word all changes behind its first bytes stand in one place."""
        word = np.zeros(len(data), bool)
        word[starts] = True
        cuts = np.unique(starts[np.searchsorted(starts, np.arange(0, starts[-1] + 1, LANE))])
        lengths = np.diff(np.append(cuts, len(data)))
        order = np.argsort(-np.minimum(lengths, 2 * LANE), kind="stable")
        begins, wide = cuts[order], np.minimum(lengths, 2 * LANE)[order]
        out = np.zeros(len(data), np.int32)
        states = np.zeros(len(begins), np.int64)
        active = np.searchsorted(-wide, -np.arange(int(wide[0])))  # how many chunks are longer than j
        for j, n in enumerate(active.tolist()):
            states = self.begin(states)
            at = begins[:n] + j
            states[:n], out[at] = self.side_by_side(np.where(word[at], 0, states[:n]), data[at])
        for i in np.flatnonzero(lengths[order] > 2 * LANE).tolist():
            states = self.begin(states)
            state, total, first = int(states[i]), 0, int(begins[i]) + 2 * LANE
            for byte in data[first : begins[i] + lengths[order[i]]].tobytes():
                state, change = self.step(state, byte)
                total += change
            out[first] = total
        return out

    def encode(self, word: str) -> list[int]:
        """The tokens of a word: the run backwards, from last token to last token."""
        self.begin(np.zeros(0, np.int64))
        state, run = 0, []
        for byte in word.encode():
            state, _ = self.step(state, byte)
            run.append(self.unpack(state)[1][0][0])
        out, at = [], len(run)
        while at:
            out.append(run[at - 1])
            at -= len(self.raw[run[at - 1]])
        return out[::-1]

    def texts(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text; strings of special tokens count as one token."""
        parts, owner, specials = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if self.coder.has_special(text):
                pieces = self.coder.split_special(text)
                specials[i] = len(pieces) // 2
                parts += pieces[::2]
                owner += [i] * len(pieces[::2])
            else:
                parts.append(text)
                owner.append(i)
        if not parts:
            return specials
        joined_text = "\0".join(parts) + "\0"
        points = np.frombuffer(joined_text.encode("utf-32-le"), np.uint32)
        stream = self.splitter.class_of[points]
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        stream[ends] = CLASSES.index("end")
        starts = self.splitter.starts(stream)
        data = np.frombuffer(joined_text.encode(), np.uint8)
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        first_byte = np.cumsum(width) - width
        changes = self.changes(data, first_byte[starts])
        changes[first_byte[ends]] = 0  # the end of a text is a word of its own
        counts = np.add.reduceat(changes, np.concatenate([[0], first_byte[ends[:-1]] + 1]), dtype=np.int64)
        return np.bincount(owner, counts, len(texts)).astype(np.int64) + specials


@cache
def counter(path: str) -> Counter:
    """One pair of transducers for each Python worker and tokenizer."""
    return Counter(bpe(path))


def count_tokens(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) for each row of df, in its order and partitions.

    Tokens are those of the byte-level tokenizer.json at `tokenizer`, whole texts, without begin or
    end tokens; special strings inside a text count as their token. Null counts as empty: 0
    and 0. Repeated rows give repeated results, an empty table an empty one; other columns of
    df are left out. No shuffle; memory is bounded by a slice of rows and the bounded memos.
    """

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        machine = counter(tokenizer)
        texts = [t or "" for t in rows.column(1).to_pylist()]
        return pa.record_batch([rows.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(machine.texts(texts))], ["id", "n_bytes", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    chosen = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(in_slices(run, 4096), f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
