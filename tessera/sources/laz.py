"""Compressed LAS files (.laz), point formats 0 to 3 with extra bytes, in the chunks of the public LAZ format.

A file's chunk table tells where each run of points (50,000 as a rule) begins; every chunk is coded by itself. Spark deals out the chunks, and a task holds one at a
time. Each item of a record has one coder for both directions: it predicts the next value, and an arithmetic coder reads or writes what
differs, so reading and writing can't drift apart. Coding is per point in Python (some ten thousand points a second and core), as the
format is a chain of states; the parallel work is over chunks. Formats 4 and up and files that aren't cut into chunks are refused.
"""

from __future__ import annotations

import struct
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import las
from tessera.sources.points import Quantization
from tessera.sources.scratch import written

# Fixed values of the public LAZ format: its record, the codes of items, contexts by number of returns and return, and codes of time factors.
OWNER, NUMBER, FLAG = "laszip encoded", 22204, 0x80
ABOUT, ITEM, EXTRA, PLACE, TIME, COLOUR = "<HHBBHIIqqH", "<HHH", 0, 6, 7, 8
CHUNK, ANY = 50_000, 0xFFFFFFFF
KINDS_OF_RETURNS = (
    (15, 14, 13, 12, 11, 10, 9, 8), (14, 0, 1, 3, 6, 10, 10, 9), (13, 1, 2, 4, 7, 11, 11, 10), (12, 3, 4, 5, 8, 12, 12, 11),
    (11, 6, 7, 8, 9, 13, 13, 12), (10, 10, 11, 12, 13, 14, 14, 13), (9, 10, 11, 12, 13, 14, 15, 14), (8, 9, 10, 11, 12, 13, 14, 15),
)
MOST_TIMES, LEAST_TIMES, SAME, ANEW = 500, -10, 511, 512
#: The items of a point format.
ITEMS = {0: [PLACE], 1: [PLACE, TIME], 2: [PLACE, COLOUR], 3: [PLACE, TIME, COLOUR]}

WORD, HALF = 0xFFFFFFFF, 1 << 31


def signed(v: int, bits: int = 32) -> int:
    half = 1 << (bits - 1)
    return ((v + half) & ((1 << bits) - 1)) - half


class Symbols:
    """Adaptive shares of n symbols, in units of 2^-15, taken anew at growing distances."""

    __slots__ = ("counts", "cycle", "last", "left", "starts", "total")

    def __init__(self, n: int):
        self.counts, self.total, self.cycle, self.last = [1] * n, 0, n, n - 1
        self.refresh()
        self.left = self.cycle = (n + 6) >> 1

    def refresh(self) -> None:
        self.total += self.cycle
        if self.total > 1 << 15:
            self.counts = [(c + 1) >> 1 for c in self.counts]
            self.total = sum(self.counts)
        scale = (1 << 31) // self.total
        self.starts = [(scale * s) >> 16 for s in accumulate(self.counts[:-1], initial=0)]
        self.left = self.cycle = min((5 * self.cycle) >> 2, (len(self.counts) + 6) << 3)


class Bit:
    """The adaptive share of zeros, in units of 2^-13."""

    __slots__ = ("cycle", "left", "starts", "total", "zeros")

    def __init__(self):
        self.zeros, self.total, self.left, self.cycle, self.starts = 1, 2, 4, 4, (0, 1 << 12)

    def seen(self, s: int) -> None:
        self.zeros += 1 - s
        self.left -= 1
        if self.left:
            return
        self.total += self.cycle
        if self.total > 1 << 13:
            self.total, self.zeros = (self.total + 1) >> 1, (self.zeros + 1) >> 1
            self.total += self.total == self.zeros
        self.starts = (0, (self.zeros * ((1 << 31) // self.total)) >> 18)
        self.left = self.cycle = min((5 * self.cycle) >> 2, 64)


class Reading:
    """An interval that each symbol narrows. What is given is ignored, and what was read returned. As this is most of the work, each kind of
    symbol is one call, and the steps in it are written out."""

    __slots__ = ("data", "length", "value")

    def __init__(self, data: Iterator[int]):
        self.data, self.length = data, WORD
        self.value = int.from_bytes(bytes(islice(data, 4)).ljust(4, b"\0"), "big")

    def symbol(self, model: Symbols, s: int) -> int:
        starts, length, value = model.starts, self.length, self.value
        step = length >> 15
        s = bisect_right(starts, value // step) - 1
        low = starts[s] * step
        length = (starts[s + 1] * step if s < model.last else length) - low
        value -= low
        while length < 1 << 24:
            value = value << 8 | next(self.data, 0)
            length <<= 8
        self.length, self.value = length, value
        model.counts[s] += 1
        model.left -= 1
        if not model.left:
            model.refresh()
        return s

    def bit(self, model: Bit, s: int) -> int:
        low = model.starts[1] * (self.length >> 13)
        s = int(self.value >= low)
        if s:
            self.value -= low
            self.length -= low
        else:
            self.length = low
        while self.length < 1 << 24:
            self.value = self.value << 8 | next(self.data, 0)
            self.length <<= 8
        model.seen(s)
        return s

    def bits(self, n: int, s: int) -> int:
        """Equally likely numbers; of more than 19 bits the lower 16 come first."""
        if n > 19:
            low = self.bits(16, s)
            return self.bits(n - 16, s) << 16 | low
        length = self.length >> n
        s = min(self.value // length, (1 << n) - 1)
        value = self.value - s * length
        while length < 1 << 24:
            value = value << 8 | next(self.data, 0)
            length <<= 8
        self.length, self.value = length, value
        return s


class Writing:
    """The same, of given symbols, which are returned."""

    __slots__ = ("base", "length", "out")

    def __init__(self):
        self.out, self.base, self.length = bytearray(), 0, WORD

    def narrow(self, low: int, length: int) -> None:
        base = self.base + low
        if base > WORD:
            base &= WORD
            at = len(self.out) - 1
            while self.out[at] == 255:
                self.out[at] = 0
                at -= 1
            self.out[at] += 1
        while length < 1 << 24:
            self.out.append(base >> 24)
            base = (base << 8) & WORD
            length <<= 8
        self.base, self.length = base, length

    def symbol(self, model: Symbols, s: int) -> int:
        starts, length = model.starts, self.length
        step = length >> 15
        low = starts[s] * step
        length = (starts[s + 1] * step if s < model.last else length) - low
        if length < 1 << 24 or self.base + low > WORD:
            self.narrow(low, length)
        else:
            self.base += low
            self.length = length
        model.counts[s] += 1
        model.left -= 1
        if not model.left:
            model.refresh()
        return s

    def bit(self, model: Bit, s: int) -> int:
        low = model.starts[1] * (self.length >> 13)
        self.narrow(*((low, self.length - low) if s else (0, low)))
        model.seen(s)
        return s

    def bits(self, n: int, s: int) -> int:
        if n > 19:
            self.bits(16, s & 0xFFFF)
            self.bits(n - 16, s >> 16)
            return s
        step = self.length >> n
        self.narrow(s * step, step)
        return s

    def done(self) -> bytes:
        return bytes(self.out) + self.base.to_bytes(4, "big")


Coder = Reading | Writing


class Numbers:
    """Whole numbers by their distance from a guess: the distance's size in bits by context, then the distance, whose bits beyond the
    upper eight are equally likely. 16-bit numbers are unsigned, 32-bit ones signed, and both wrap."""

    def __init__(self, bits: int, contexts: int = 1):
        self.width, self.size, self.half, self.mask = bits, 0, 1 << (bits - 1), (1 << bits) - 1
        self.sizes, self.small = [Symbols(bits + 1) for _ in range(contexts)], Bit()
        self.parts: dict[int, Symbols] = {}

    def code(self, coder: Coder, guess: int, context: int, want: int) -> int:
        half, mask = self.half, self.mask
        far = ((want - guess + half) & mask) - half
        k = self.size = coder.symbol(self.sizes[context], (far - 1 if far > 0 else -far).bit_length())
        if k == 0:
            far = coder.bit(self.small, far)
        elif k == 32:
            far = -(1 << 31)
        else:
            part = self.parts.get(k)
            if part is None:
                part = self.parts[k] = Symbols(1 << min(k, 8))
            u = far - 1 if far > 0 else far + (1 << k) - 1
            if k > 8:
                shift = k - 8
                u = coder.symbol(part, u >> shift) << shift | coder.bits(shift, u & ((1 << shift) - 1))
            else:
                u = coder.symbol(part, u)
            far = u + 1 if u >> (k - 1) else u - (1 << k) + 1
        return ((guess + far + half) & mask) - half if self.width == 32 else (guess + far) & 0xFFFF


class Middle:
    """The middle of five recent values; the largest and the smallest leave by turns, as new ones fall on either side of it."""

    def __init__(self):
        self.five, self.drop = [0] * 5, 4

    def add(self, v: int) -> None:
        five = self.five
        middle = five[2]
        del five[self.drop]
        insort(five, v)
        if v == middle or (v > middle) == (self.drop == 4):
            self.drop = 4 - self.drop


def byte_models() -> defaultdict:
    return defaultdict(lambda: Symbols(256))


class Places:
    """Coordinates, intensity, returns, class, angle, user data and source: steps in x and y by the middle of recent steps of the same kind of
    return, heights by the last one of the same level."""

    form = struct.Struct("<3iH4BH")

    def __init__(self, first: tuple):
        self.last = [*first[:3], 0, *first[4:]]
        self.changes, self.bytes = Symbols(64), byte_models()
        self.intensity, self.intensities, self.sources = [0] * 16, Numbers(16, 4), Numbers(16)
        self.x, self.y, self.z, self.steps, self.height = Numbers(32, 2), Numbers(32, 22), Numbers(32, 20), [(Middle(), Middle()) for _ in range(16)], [0] * 8

    def code(self, coder: Coder, given: tuple | None) -> list[int]:
        last, want, now = self.last, list(given) if given else self.last, self.last[:]
        kind = KINDS_OF_RETURNS[want[4] >> 3 & 7][want[4] & 7]
        changed = (want[4] != last[4]) << 5 | (want[3] != self.intensity[kind]) << 4
        if want[5:] != last[5:]:
            changed |= (want[5] != last[5]) << 3 | (want[6] != last[6]) << 2 | (want[7] != last[7]) << 1 | (want[8] != last[8])
        changed = coder.symbol(self.changes, changed)
        if changed & 32:
            now[4] = coder.symbol(self.bytes["options", last[4]], want[4])
        returns, number = now[4] >> 3 & 7, now[4] & 7
        kind, level, single = KINDS_OF_RETURNS[returns][number], abs(returns - number), int(returns == 1)
        if changed & 16:
            self.intensity[kind] = self.intensities.code(coder, self.intensity[kind], min(kind, 3), want[3])
        now[3] = self.intensity[kind]
        if changed & 8:
            now[5] = coder.symbol(self.bytes["class", last[5]], want[5])
        if changed & 4:
            now[6] = (coder.symbol(self.bytes["angle", now[4] >> 6 & 1], (want[6] - last[6]) & 255) + last[6]) & 255
        if changed & 2:
            now[7] = coder.symbol(self.bytes["user", last[7]], want[7])
        if changed & 1:
            now[8] = self.sources.code(coder, last[8], 0, want[8])
        east, north = self.steps[kind]
        dx = self.x.code(coder, east.five[2], single, want[0] - last[0])
        dy = self.y.code(coder, north.five[2], single + min(self.x.size & ~1, 20), want[1] - last[1])
        now[0], now[1] = ((last[0] + dx + HALF) & WORD) - HALF, ((last[1] + dy + HALF) & WORD) - HALF
        east.add(dx)
        north.add(dy)
        rough = (self.x.size + self.y.size) // 2
        now[2] = self.height[level] = self.z.code(coder, self.height[level], single + min(rough & ~1, 18), want[2])
        self.last = now
        return now


class Times:
    """Times as the 64 bits of a double: multiples of the last step in up to four interleaved sequences."""

    form = struct.Struct("<Q")

    def __init__(self, first: tuple):
        self.at = self.newest = 0
        self.times, self.steps, self.strays = [first[0], 0, 0, 0], [0] * 4, [0] * 4
        self.still, self.factors, self.numbers = Symbols(6), Symbols(516), Numbers(32, 9)

    def choice(self, want: int) -> int:
        """The code of a time: a factor of the last step, the same time, another sequence that is near, or all bits."""
        step = self.steps[self.at]
        far = signed(want - self.times[self.at], 64)
        if far == 0:
            return SAME if step else 0
        if not -HALF < far < HALF:
            for i in (1, 2, 3):
                if abs(signed(want - self.times[(self.at + i) & 3], 64)) < HALF:
                    return (ANEW if step else 2) + i
            return ANEW if step else 2
        if not step:
            return 1
        times = min(max(round(far / step), LEAST_TIMES), MOST_TIMES)
        return times if times >= 0 else MOST_TIMES - times

    def code(self, coder: Coder, given: tuple | None) -> tuple[int]:
        i, step = self.at, self.steps[self.at]
        want = given[0] if given else self.times[i]
        code = coder.symbol(self.factors if step else self.still, self.choice(want) if given else 0)
        beyond = code - (ANEW if step else 2)
        if beyond > 0:
            self.at = (i + beyond) & 3
            return self.code(coder, given)
        if beyond == 0:
            high = self.numbers.code(coder, signed(self.times[i] >> 32), 8, signed(want >> 32))
            self.at = self.newest = (self.newest + 1) & 3
            self.times[self.at] = (high & WORD) << 32 | coder.bits(32, want & WORD)
            self.steps[self.at] = self.strays[self.at] = 0
        elif code != (SAME if step else 0):
            times = code if code <= MOST_TIMES else MOST_TIMES - code
            stray = bool(step) and times in (0, MOST_TIMES, LEAST_TIMES)
            if not step:
                guess, context = 0, 0
            else:
                guess, context = times * step, {0: 7, 1: 1, MOST_TIMES: 4, LEAST_TIMES: 6}.get(times, 5 if times < 0 else 2 if times < 10 else 3)
            far = self.numbers.code(coder, guess, context, want - self.times[i])
            self.times[i] = (self.times[i] + far) & (1 << 64) - 1
            if stray:
                self.strays[i] += 1
            if not step or self.strays[i] > 3:
                self.steps[i] = far
            if not step or times == 1 or self.strays[i] > 3:
                self.strays[i] = 0
        return (self.times[self.at],)


class Colours:
    """Three colours of two bytes: red by the last red, green and blue by how red has changed."""

    form = struct.Struct("6B")

    def __init__(self, first: tuple):
        self.last, self.used, self.models = list(first), Symbols(128), byte_models()

    def code(self, coder: Coder, given: tuple | None) -> list[int]:
        last, want, now, models = self.last, given or self.last, self.last[:], self.models
        # Bits of change: low and high byte of red, of green, of blue; then whether the colours differ.
        used = 0
        if given:
            (a, b, c, d, e, f), (u, v, w, x, y, z) = want, last
            used = (a != u) | (b != v) << 1 | (c != w) << 2 | (d != x) << 3 | (e != y) << 4 | (f != z) << 5 | (a != c or b != d or c != e or d != f) << 6
        used = coder.symbol(self.used, used)
        for i in (0, 1):
            if used >> i & 1:
                now[i] = (coder.symbol(models[i], (want[i] - last[i]) & 255) + last[i]) & 255
        if used & 64:
            for half in (0, 1):
                green, blue = 2 + half, 4 + half
                change = now[half] - last[half]
                if used >> green & 1:
                    guess = min(max(change + last[green], 0), 255)
                    now[green] = (coder.symbol(models[green], (want[green] - guess) & 255) + guess) & 255
                if used >> blue & 1:
                    guess = min(max(int((change + now[green] - last[green]) / 2) + last[blue], 0), 255)
                    now[blue] = (coder.symbol(models[blue], (want[blue] - guess) & 255) + guess) & 255
        else:
            now[2:4] = now[4:6] = now[0:2]
        self.last = now
        return now


class Extras:
    """Bytes behind the known fields, each by the last one in its place."""

    def __init__(self, first: tuple):
        self.last, self.models, self.form = list(first), byte_models(), struct.Struct(f"{len(first)}B")

    def code(self, coder: Coder, given: tuple | None) -> list[int]:
        want = given or self.last
        self.last = [(coder.symbol(self.models[i], (want[i] - b) & 255) + b) & 255 for i, b in enumerate(self.last)]
        return self.last


CODERS = {PLACE: Places, TIME: Times, COLOUR: Colours, EXTRA: Extras}


def started(items: Sequence[tuple[int, int]], first: bytes) -> list:
    """A coder for each item (code, size), which begins from the first record of a chunk."""
    at, out = 0, []
    for code, size in items:
        form = getattr(CODERS[code], "form", None) or struct.Struct(f"{size}B")
        out.append(CODERS[code](form.unpack(first[at : at + size])))
        at += size
    return out


def chunk_read(data: Iterator[int], n: int, items: Sequence[tuple[int, int]]) -> bytes:
    """n records: the first is stored as it is."""
    first = bytes(islice(data, sum(size for _, size in items)))
    coders, out = started(items, first), bytearray(first)
    if n > 1:
        coder = Reading(data)
        for _ in range(n - 1):
            for c in coders:
                out += c.form.pack(*c.code(coder, None))
    return bytes(out)


def chunk_written(records: bytes, items: Sequence[tuple[int, int]]) -> bytes:
    length = sum(size for _, size in items)
    coders, coder = started(items, records[:length]), Writing()
    for at in range(length, len(records), length):
        for c in coders:
            c.code(coder, c.form.unpack_from(records, at))
            at += c.form.size
    return records[:length] + coder.done()


def bytes_of(f) -> Iterator[int]:
    return chain.from_iterable(iter(lambda: f.read(1 << 16), b""))


def chunks_of(path: str) -> list[dict]:
    """The chunks of a file, each with what the header says, its first point, its points, its place and size in the file, and the items of a record."""
    with las.opened(path) as f:
        raw = bytearray(f.read(las.HEADER_SIZE))
        packed = len(raw) > 104 and raw[104] & FLAG
        if packed:
            raw[104] &= ~FLAG
        head = las.parsed(bytes(raw), path)
        at, about = head["header_size"], None
        for _ in range(head["n_vlrs"]):
            f.seek(at)
            raw = f.read(struct.calcsize(las.VLR_FORMAT))
            if len(raw) < struct.calcsize(las.VLR_FORMAT):
                raise ValueError(f"{path} ends within its records")
            _, user, number, length, _ = struct.unpack(las.VLR_FORMAT, raw)
            if number == NUMBER and user.split(b"\0", 1)[0] == OWNER.encode():
                about = f.read(length)
            at += len(raw) + length
        if not packed or about is None:
            raise ValueError(f"{path} isn't compressed, or lacks the record of its compression")
        kind, arithmetic, *_, per_chunk, _, _, n_items = struct.unpack_from(ABOUT, about)
        items = list(struct.iter_unpack(ITEM, about[struct.calcsize(ABOUT) :]))[:n_items]
        if kind != 2 or arithmetic != 0 or any(code not in CODERS or version != 2 for code, _, version in items) or sum(size for _, size, _ in items) != head["record_length"]:
            raise ValueError(f"{path} is compressed in a way that isn't known here: {kind}, {arithmetic}, {items}")
        if not head["n_points"]:
            return []
        f.seek(head["data_offset"])
        (table,) = struct.unpack("<q", f.read(8))
        if table == -1:  # written to a stream: the place is at the end
            f.seek(f.size() - 8)
            (table,) = struct.unpack("<q", f.read(8))
        f.seek(table)
        _, count = struct.unpack("<II", f.read(8))
        coder, numbers, start, place, n, size, out = Reading(bytes_of(f)), Numbers(32, 2), 0, head["data_offset"] + 8, 0, 0, []
        for _ in range(count):
            n = numbers.code(coder, n, 0, 0) if per_chunk == ANY else min(per_chunk, head["n_points"] - start)
            size = numbers.code(coder, size, 1, 0)
            out.append(head | {"start": start, "n": n, "place": place, "size": size, "items": [v for code, width, _ in items for v in (code, width)]})
            start, place = start + n, place + size
        if start != head["n_points"]:
            raise ValueError(f"{path} has {head['n_points']} points, its chunks {start}")
        return out


def chunk_rows(r: dict) -> np.ndarray:
    """The records of a chunk, as chunks_of describes it."""
    with las.opened(r["path"]) as f:
        f.seek(r["place"])
        raw = f.read(r["size"])
    if len(raw) < r["size"]:
        raise ValueError(f"{r['path']} ends before its last point")
    items = list(zip(r["items"][::2], r["items"][1::2], strict=True))
    return np.frombuffer(chunk_read(iter(raw), r["n"], items), las.layout(r["point_format"], r["record_length"]))


def chunks(spark: SparkSession, source: str | Sequence[str]) -> DataFrame:
    """A row for each chunk of the .laz files of a folder, of one file, of a list file, or of several of them."""
    ddl = las.HEADERS + ", start long, n long, place long, size long, items array<long>"
    shape = las.arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist(chunks_of(path), schema=shape)

    return las.files(spark, source, "*.laz").mapInArrow(run, ddl)


def read_laz(spark: SparkSession, source: str | Sequence[str], fields: Sequence[str] = las.POINTS) -> DataFrame:
    """The wanted las.FIELDS of the points of .laz files. byte_offset is where a record would begin in the file without compression."""
    schema = ", ".join(f"{f} {las.FIELDS[f]}" for f in fields)
    shape = las.arrow_schema(schema)
    kept = ["path", "point_format", "record_length", "data_offset", "scale", "offset", "start", "n", "place", "size", "items"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = chunk_rows(r)
                yield pa.RecordBatch.from_arrays([las.field_of(name, rows, r) for name in fields], schema=shape)

    found = written(chunks(spark, source).select(*kept), "chunks")
    points, most = found.agg(F.sum("n"), F.max("n")).first()
    return las.dealt(found, -(-(points or 0) // max(CHUNK, most or 0))).mapInArrow(run, schema)


def file_image(rows: np.ndarray, quantization: Quantization, point_format: int, chunk: int) -> Iterator[bytes]:
    """The bytes of a compressed file in order: header, record of the compression, place of the table, chunks, table."""
    sizes = {PLACE: 20, TIME: 8, COLOUR: 6}
    items = [(code, sizes[code]) for code in ITEMS[point_format]]
    about = struct.pack(ABOUT, 2, 0, 2, 2, 0, 0, chunk, -1, -1, len(items)) + b"".join(struct.pack(ITEM, code, size, 2) for code, size in items)
    vlr = las.record_bytes(las.VLR_FORMAT, OWNER, NUMBER, "chunks of points", about)
    head = bytearray(las.header_of(rows, quantization, point_format, vlr, 1))
    head[104] |= FLAG
    coder, numbers, before, parts = Writing(), Numbers(32, 2), 0, []
    for start in range(0, len(rows), chunk):
        part = chunk_written(rows[start : start + chunk].tobytes(), items)
        parts.append(part)
        before = numbers.code(coder, before, 1, len(part))
    yield bytes(head) + vlr + struct.pack("<q", len(head) + len(vlr) + 8 + sum(map(len, parts)))
    yield from parts
    yield struct.pack("<II", 0, len(parts)) + coder.done()


def write_laz(points: DataFrame, folder: str, quantization: Quantization, point_format: int = 1, chunk: int = CHUNK) -> DataFrame:
    """As las.write_las, compressed: (file, n_points) of each file, written when the result is evaluated."""
    if point_format not in ITEMS:
        raise ValueError(f"point format {point_format} can't be compressed")
    return las.write_las(points, folder, quantization, point_format, image=lambda rows: file_image(rows, quantization, point_format, chunk), suffix=".laz")
