"""Readers and writers of LAS point files, formats 0 to 10, in ranges of records that Spark deals out.

A file's header is read once; its records are cut into ranges, and each task reads ranges by
offset and decodes the wanted fields only. Points are written by each task into files of a bounded number of records,
with variable-length records before the points and extended ones behind them.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.points import Quantization
from tessera.sources.scratch import written

#: Records in a range that one call reads, and in a file that one task writes.
RANGE, FILE = 1 << 18, 1 << 21

# Fixed values of the public LAS 1.4 format: sizes in bytes, and the fields of point records.
HEADER_SIZE = 375
HEADER_FORMAT = "<4sHH16sBB32s32sHHHIIBHI5I3d3d6dQQIQ15Q"
VLR_FORMAT, EVLR_FORMAT = "<H16sHH32s", "<H16sHQ32s"
BASE = [("qx", "<i4"), ("qy", "<i4"), ("qz", "<i4"), ("intensity", "<u2"), ("options", "u1"), ("class_bits", "u1"), ("scan_angle", "i1"), ("user_data", "u1"), ("source_id", "<u2")]
WIDE = [("qx", "<i4"), ("qy", "<i4"), ("qz", "<i4"), ("intensity", "<u2"), ("options", "u1"), ("flags", "u1"), ("classification", "u1"), ("user_data", "u1"), ("scan_angle", "<i2"), ("source_id", "<u2"), ("gps_time", "<f8")]
TIME, RGB, NIR, WAVE = [("gps_time", "<f8")], [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")], [("nir", "<u2")], [("wave", "V29")]
RECORDS = {
    0: BASE, 1: BASE + TIME, 2: BASE + RGB, 3: BASE + TIME + RGB, 4: BASE + TIME + WAVE, 5: BASE + TIME + RGB + WAVE,
    6: WIDE, 7: WIDE + RGB, 8: WIDE + RGB + NIR, 9: WIDE + WAVE, 10: WIDE + RGB + NIR + WAVE,
}
#: The record ids of public specifications that have a meaning here: (user id, record id) -> name.
KNOWN_RECORDS = {
    ("LASF_Projection", 2111): "math transform WKT", ("LASF_Projection", 2112): "coordinate system WKT", ("LASF_Projection", 34735): "geo keys", ("LASF_Projection", 34736): "geo doubles",
    ("LASF_Projection", 34737): "geo ASCII", ("LASF_Spec", 0): "classification lookup", ("LASF_Spec", 3): "text area", ("LASF_Spec", 4): "extra bytes", ("LASF_Spec", 7): "superseded",
}

HEADERS = (
    "path string, version string, point_format int, record_length int, data_offset long, n_points long, scale array<double>, offset array<double>, "
    "min_xyz array<double>, max_xyz array<double>, by_return array<long>, global_encoding int, n_vlrs long, header_size int, evlr_offset long, n_evlrs long"
)
FIELDS = {
    "path": "string", "point_index": "long", "byte_offset": "long", "x": "double", "y": "double", "z": "double", "qx": "int", "qy": "int", "qz": "int", "intensity": "int", "options": "int", "class_bits": "int", "flags": "int",
    "classification": "int", "return_number": "int", "return_count": "int", "scan_direction": "int", "flight_edge": "int", "scan_angle": "int", "user_data": "int", "source_id": "int", "gps_time": "double", "red": "int", "green": "int", "blue": "int", "nir": "int",
}
POINTS = ("path", "point_index", "x", "y", "z", "qx", "qy", "qz", "intensity", "options", "class_bits", "gps_time")


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def opened(uri: str):
    fs, path = filesystem(uri)
    return fs.open_input_file(path)


def layout(point_format: int, record_length: int) -> np.dtype:
    """The record of a format; bytes behind the known fields are skipped."""
    fields = RECORDS[point_format]
    sizes = np.cumsum([0] + [np.dtype(t).itemsize for _, t in fields])
    return np.dtype({"names": [f for f, _ in fields], "formats": [t for _, t in fields], "offsets": sizes[:-1].tolist(), "itemsize": max(record_length, int(sizes[-1]))})


def rgb_offset(point_format: Column) -> Column:
    """Where a record's colours begin; null for formats without."""
    found = {n: sum(np.dtype(t).itemsize for _, t in fields[: [f for f, _ in fields].index("red")]) for n, fields in RECORDS.items() if "red" in dict(fields)}
    return F.coalesce(*[F.when(point_format == n, F.lit(at)) for n, at in found.items()])


def encoding_bits(encoding: Column) -> list[Column]:
    fields = (("gps_standard_time", 0), ("waveform_external", 2), ("synthetic_returns", 3), ("wkt", 4))
    return [(F.shiftright(encoding, at).bitwiseAND(F.lit(1)) == 1).alias(name) for name, at in fields]


def text_of(raw: Column) -> Column:
    """A fixed-width ASCII field up to its first NUL."""
    return F.substring_index(F.decode(raw, "ISO-8859-1"), "\0", 1)


def parsed(raw: bytes, path: str) -> dict:
    """The header of a file. Before version 1.4 the count of points is the 32-bit one."""
    if raw[:4] != b"LASF" or len(raw) < 227:
        raise ValueError(f"{path} is no LAS file")
    f = struct.unpack(HEADER_FORMAT, raw.ljust(HEADER_SIZE, b"\0"))
    if f[13] & 0xC0:
        raise ValueError(f"{path} is compressed")
    if f[13] not in RECORDS:
        raise ValueError(f"{path} has point format {f[13]}")
    box, new = f[27:33], (f[4], f[5]) >= (1, 4)
    return {
        "path": path, "version": f"{f[4]}.{f[5]}", "point_format": f[13], "record_length": f[14], "data_offset": f[11],
        "n_points": f[36] if new and f[36] else f[15], "scale": list(f[21:24]), "offset": list(f[24:27]), "min_xyz": list(box[1::2]), "max_xyz": list(box[0::2]),
        "by_return": list(f[37:52]) if new and any(f[37:52]) else [*f[16:21], *[0] * 10], "global_encoding": f[2], "n_vlrs": f[12], "header_size": f[10], "evlr_offset": f[34] if new else 0, "n_evlrs": f[35] if new else 0,
    }


def listed(spark: SparkSession, path: str) -> list[str]:
    """The files of a list file: a path a line, relative to the list, lists in lists; missing ones are skipped. Paths are
    read on the driver, as Spark's readers take them."""
    out, seen, todo = [], set(), [path]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    while todo:
        one = todo.pop(0)
        place = hadoop(one)
        if one in seen or not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            continue
        seen.add(one)
        if one.lower().endswith(".lasgroup"):
            lines = [r.value.strip() for r in spark.read.text(one, wholetext=False).collect()]
            todo += [x if "://" in x or x.startswith("/") else f"{one.rpartition('/')[0]}/{x}" for x in lines if x]
        else:
            out.append(one)
    return out


def files(spark: SparkSession, source: str | Sequence[str], names: str = "*.las") -> DataFrame:
    """(path) of the .las files (or of other names) of a folder, of one file, of a list file, or of several of them."""
    given = [source] if isinstance(source, str) else list(source)
    every = [p for g in given for p in (listed(spark, g) if g.lower().endswith(".lasgroup") else [g])]
    found = spark.read.format("binaryFile").option("pathGlobFilter", names).load(every).select("path") if every else spark.createDataFrame([], "path string")
    return found.select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"))


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (f.split(" ") for f in ddl.split(", "))])


def headers(spark: SparkSession, source: str | Sequence[str]) -> DataFrame:
    """A row for each .las file."""
    shape = arrow_schema(HEADERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with opened(path) as f:
                    yield pa.RecordBatch.from_pylist([parsed(f.read(HEADER_SIZE), path)], schema=shape)

    return files(spark, source).mapInArrow(run, HEADERS)


def records(spark: SparkSession, source: str | Sequence[str]) -> DataFrame:
    """(path, extended, user_id, record_id, description, data, known): variable-length records and extended ones of each
    file, in order; `known` names those that a public specification gives a meaning."""
    ddl = "path string, place int, extended int, user_id string, record_id int, description string, data binary, known string"
    shape = arrow_schema(ddl)

    def ascii_of(raw: bytes) -> str:
        return raw.split(b"\0", 1)[0].decode("latin-1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for head in batch.to_pylist():
                with opened(head["path"]) as f:
                    for extended, start, number, form in ((0, head["header_size"], head["n_vlrs"], VLR_FORMAT), (1, head["evlr_offset"], head["n_evlrs"], EVLR_FORMAT)):
                        for place in range(number):
                            f.seek(start)
                            raw = f.read(struct.calcsize(form))
                            if len(raw) < struct.calcsize(form):
                                raise ValueError(f"{head['path']} ends within its records")
                            _, user, record, length, text = struct.unpack(form, raw)
                            data = f.read(length)
                            start += len(raw) + length
                            row = {"path": head["path"], "place": place, "extended": extended, "user_id": ascii_of(user), "record_id": record, "description": ascii_of(text), "data": data, "known": KNOWN_RECORDS.get((ascii_of(user), record))}
                            yield pa.RecordBatch.from_pylist([row], schema=shape)

    return headers(spark, source).select("path", "header_size", "n_vlrs", "evlr_offset", "n_evlrs").mapInArrow(run, ddl)


def find_records(spark: SparkSession, source: str | Sequence[str], user_id: str, record_id: int) -> DataFrame:
    """(path, extended, description, data): the first record of an identifier in each file, extended ones after the others. Of other records
    only the headers are read."""
    ddl = "path string, extended int, description string, data binary"
    shape = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [row for head in batch.to_pylist() if (row := first(head))]
            yield pa.RecordBatch.from_pylist(found, schema=shape)

    def first(head: dict) -> dict | None:
        with opened(head["path"]) as f:
            for extended, start, number, form in ((0, head["header_size"], head["n_vlrs"], VLR_FORMAT), (1, head["evlr_offset"], head["n_evlrs"], EVLR_FORMAT)):
                for _ in range(number):
                    f.seek(start)
                    raw = f.read(struct.calcsize(form))
                    if len(raw) < struct.calcsize(form):
                        raise ValueError(f"{head['path']} ends within its records")
                    _, user, record, length, text = struct.unpack(form, raw)
                    if user.split(b"\0", 1)[0] == user_id.encode("latin-1") and record == record_id:
                        return {"path": head["path"], "extended": extended, "description": text.split(b"\0", 1)[0].decode("latin-1"), "data": f.read(length)}
                    start += len(raw) + length
        return None

    return headers(spark, source).select("path", "header_size", "n_vlrs", "evlr_offset", "n_evlrs").mapInArrow(run, ddl)


#: What a record's payload holds, by (user id, record id): texts, 64-bit numbers, geo keys, names of classes, descriptions of extra bytes.
PAYLOADS = {("LASF_Projection", 2111): "text", ("LASF_Projection", 2112): "text", ("LASF_Projection", 34735): "keys", ("LASF_Projection", 34736): "doubles", ("LASF_Projection", 34737): "text", ("LASF_Spec", 0): "classes", ("LASF_Spec", 3): "text", ("LASF_Spec", 4): "extra"}


def payload_items(kind: str, data: bytes) -> list[tuple[int, str | None, float | None, str | None]]:
    """(item, name, number, text) of a payload: each geo key with its value (a number of its own, or where its values begin in the record
    named by its location), each number, each class, each field of extra bytes with its type."""
    def text(raw: bytes) -> str:
        return raw.split(b"\0", 1)[0].decode("utf-8", "replace")

    if kind == "text":
        return [(0, None, None, text(data))]
    if kind == "doubles":
        return [(i, None, v, None) for i, v in enumerate(struct.unpack(f"<{len(data) // 8}d", data[: len(data) // 8 * 8]))]
    if kind == "keys":
        words = struct.unpack(f"<{len(data) // 2}H", data[: len(data) // 2 * 2])
        rows = [words[i : i + 4] for i in range(4, min(4 * (words[3] + 1) if len(words) > 3 else 0, len(words) - 3), 4)]
        return [(i, str(key), float(value), None if location == 0 else f"{location}:{count}") for i, (key, location, count, value) in enumerate(rows)]
    size = 16 if kind == "classes" else 192
    whole = [data[i : i + size] for i in range(0, len(data) - size + 1, size)]
    if kind == "classes":
        return [(i, None, float(raw[0]), text(raw[1:])) for i, raw in enumerate(whole)]
    return [(i, text(raw[4:36]), float(raw[2]), text(raw[160:])) for i, raw in enumerate(whole)]


def typed_records(spark: SparkSession, source: str | Sequence[str]) -> DataFrame:
    """(path, known, item, name, number, text): the payloads of records of public specifications, decoded."""
    ddl = "path string, known string, item int, name string, number double, text string"
    shape = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                kind = PAYLOADS.get((r["user_id"], r["record_id"]))
                out += [dict(zip(shape.names, (r["path"], r["known"], *item), strict=True)) for item in (payload_items(kind, r["data"]) if kind else [])]
            yield pa.RecordBatch.from_pylist(out, schema=shape)

    return records(spark, source).where("known is not null").select("path", "user_id", "record_id", "data", "known").mapInArrow(run, ddl)


def merged(heads: DataFrame) -> DataFrame:
    """One header for all: counts and counts by return are summed, extents united; `kinds` counts the different
    formats, record lengths and quantizations: 1 means that the files are compatible. The 32-bit count is 0 where it doesn't fit."""
    at = lambda name, i: F.get(name, F.lit(i))
    total = F.sum("n_points")
    return heads.agg(
        F.count("*").alias("n_files"), total.alias("n_points"), F.when(total < 1 << 32, total).otherwise(F.lit(0)).alias("legacy_points"),
        F.array(*[F.sum(at("by_return", i)) for i in range(15)]).alias("by_return"),
        F.array(*[F.min(at("min_xyz", i)) for i in range(3)]).alias("min_xyz"), F.array(*[F.max(at("max_xyz", i)) for i in range(3)]).alias("max_xyz"),
        F.count_distinct(F.struct("point_format", "record_length", "scale", "offset")).alias("kinds"),
    )


def preview(spark: SparkSession, source: str | Sequence[str]) -> DataFrame:
    """(path, line): a summary of each file in one line of text."""
    extent = F.concat_ws(" ", *[F.concat(F.lit(f"{a} "), F.format_number(F.get("min_xyz", F.lit(i)), 2), F.lit(" to "), F.format_number(F.get("max_xyz", F.lit(i)), 2)) for i, a in enumerate("xyz")])
    return headers(spark, source).select("path", F.concat(F.lit("LAS "), F.col("version"), F.lit(", format "), F.col("point_format"), F.lit(", "), F.format_number("n_points", 0), F.lit(" points, "), extent).alias("line"))


def record_range(r: dict) -> np.ndarray:
    """The records `start` to `start + n` of a file, as its header r describes them."""
    with opened(r["path"]) as f:
        f.seek(r["data_offset"] + r["start"] * r["record_length"])
        raw = f.read(r["n"] * r["record_length"])
    if len(raw) < r["n"] * r["record_length"]:
        raise ValueError(f"{r['path']} ends before its last point")
    return np.frombuffer(raw, layout(r["point_format"], r["record_length"]))


def field_of(name: str, rows: np.ndarray, r: dict) -> pa.Array:
    """One of FIELDS of a range of records; null where the format lacks it."""
    have, wide, kind = rows.dtype.names, r["point_format"] >= 6, arrow_schema(f"{name} {FIELDS[name]}").field(0).type
    n = len(rows)
    if name == "path":
        return pa.array([r["path"]] * n, kind)
    if name in ("point_index", "byte_offset"):
        index = np.arange(r["start"], r["start"] + n)
        return pa.array(index if name == "point_index" else r["data_offset"] + index * r["record_length"], kind)
    if name in ("x", "y", "z"):
        axis = "xyz".index(name)
        return pa.array(rows[f"q{name}"] * r["scale"][axis] + r["offset"][axis], kind)
    packed = {
        "return_number": ("options", 0, 15 if wide else 7), "return_count": ("options", 4 if wide else 3, 15 if wide else 7),
        "scan_direction": ("flags" if wide else "options", 6, 1), "flight_edge": ("flags" if wide else "options", 7, 1),
    }
    if name == "classification" and not wide:
        packed[name] = ("class_bits", 0, 31)
    if name in packed:
        source_, shift, mask = packed[name]
        return pa.array((rows[source_].astype(np.int32) >> shift) & mask, kind)
    return pa.array(np.ascontiguousarray(rows[name]).astype(np.float64 if name == "gps_time" else np.int32), kind) if name in have else pa.nulls(n, kind)


def dealt(ranges: DataFrame, tasks: int) -> DataFrame:
    """Ranges (path, start, ...) in so many tasks. The number is given: ranges are few bytes, which adaptive execution would put into one
    task, however many points they stand for."""
    return ranges.repartitionByRange(max(tasks, 1), "path", "start")


def read_las(spark: SparkSession, source: str | Sequence[str], fields: Sequence[str] = POINTS, points: DataFrame | None = None) -> DataFrame:
    """The points of .las files: the wanted FIELDS, the only ones that are decoded; null where a format lacks one.

    `options` is the byte of returns as stored, `class_bits` the classification byte of formats 0 to 5, `flags` that of
    formats 6 and up; return_number, return_count, scan_direction, flight_edge and classification are taken from them
    for every format. byte_offset is where a point's record begins. With `points`, a table (path, start, n), only these
    ranges are read, from a file system that can seek.
    """
    heads = headers(spark, source).where("n_points > 0")
    if points is None:
        ranges = heads.withColumn("start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_points") - 1, F.lit(RANGE).cast("bigint")))).withColumn("n", F.least(F.lit(RANGE), F.col("n_points") - F.col("start")))
    else:
        ranges = heads.join(points.select("path", "start", "n"), "path")
    ranges = written(ranges.select("path", "point_format", "record_length", "data_offset", "scale", "offset", "start", "n"), "ranges")
    wanted = dealt(ranges, ranges.agg(F.sum(F.ceil(F.col("n") / RANGE))).first()[0] or 0)
    schema = ", ".join(f"{f} {FIELDS[f]}" for f in fields)
    shape = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = record_range(r)
                yield pa.RecordBatch.from_arrays([field_of(name, rows, r) for name in fields], schema=shape)

    return wanted.mapInArrow(run, schema)


def record_bytes(form: str, user_id: str, record_id: int, description: str, data: bytes) -> bytes:
    return struct.pack(form, 0, user_id.encode("latin-1"), record_id, len(data), description.encode("latin-1")) + data


def header_of(rows: np.ndarray, q: Quantization, point_format: int = 1, vlrs: bytes = b"", n_vlrs: int = 0, n_evlrs: int = 0) -> bytes:
    low, high = ([float(f(rows[f"q{a}"])) * s + o for a, s, o in zip("xyz", q.scale, q.offset, strict=True)] for f in (np.min, np.max))
    box = [v for pair in zip(high, low, strict=True) for v in pair]
    number = rows["options"] & (15 if point_format >= 6 else 7)
    by_return = np.bincount(np.clip(number, 1, 15) - 1, minlength=15)[:15].tolist()
    start, size = HEADER_SIZE + len(vlrs), rows.dtype.itemsize
    legacy = [len(rows), *by_return[:5]] if point_format < 6 else [0] * 6
    return struct.pack(HEADER_FORMAT, b"LASF", 0, 0, bytes(16), 1, 4, b"", b"tessera", 1, 2000, HEADER_SIZE, start, n_vlrs, point_format, size, *legacy, *q.scale, *q.offset, *box, 0, start + len(rows) * size if n_evlrs else 0, n_evlrs, len(rows), *by_return)


def write_las(points: DataFrame, folder: str, quantization: Quantization, point_format: int = 1, vlrs: Sequence[tuple] = (), evlrs: Sequence[tuple] = (), image: Callable[[np.ndarray], Iterator[bytes]] | None = None, suffix: str = ".las") -> DataFrame:
    """Writes points as files of a format, and returns (file, n_points) of each.

    qx, qy and qz are needed; other columns with the name of a field of the format are taken, missing ones and nulls are 0
    (options: the first return of one). `vlrs` and `evlrs` are (user_id, record_id, description, data) for every file.
    Writing happens when the result is evaluated, best once. A task's files bear its partition's number and are
    moved in place when complete, so that a repeated task replaces them. Coordinates beyond 32 bits are an error. `image`
    gives a file's bytes in another form, for names that end in `suffix`.
    """
    kinds = dict(RECORDS[point_format])
    given = ["qx", "qy", "qz", *[f for f in kinds if f in points.columns and f not in ("qx", "qy", "qz", "wave")]]
    before = b"".join(record_bytes(VLR_FORMAT, *v) for v in vlrs)
    behind = b"".join(record_bytes(EVLR_FORMAT, *v) for v in evlrs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        held, count, number = [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, count, number
            rows = np.concatenate(held)
            name = f"part-{task.partitionId():06d}-{number:04d}{suffix}"
            with fs.open_output_stream(f"{root}/{name}.{task.taskAttemptId()}", compression=None) as f:
                for part in image(rows) if image else (header_of(rows, quantization, point_format, before, len(vlrs), len(evlrs)), before, rows.tobytes(), behind):
                    f.write(part)
            fs.move(f"{root}/{name}.{task.taskAttemptId()}", f"{root}/{name}")
            held, count, number = [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(rows)])], ["file", "n_points"])

        for batch in batches:
            rows = np.zeros(batch.num_rows, np.dtype(RECORDS[point_format]))
            rows["options"] = 17 if point_format >= 6 else 9  # the first return of one
            for i, c in enumerate(given):
                kind = pa.float64() if c == "gps_time" else pa.from_numpy_dtype(np.dtype(kinds[c]))
                rows[c] = batch.column(i).cast(kind).fill_null(0).to_numpy(zero_copy_only=False)
            held.append(rows)
            count += len(rows)
            if count >= FILE:
                yield flush()
        if count:
            yield flush()

    return points.select(*given).mapInArrow(run, "file string, n_points long")
