"""LAS files as a Spark data source: `spark.read.format("las")`, `df.write.format("las")`, `spark.readStream.format("las")`.

Reading plans ranges of records. Comparisons of numeric fields with constants are pushed down: files whose header's extent rules them out aren't
opened, in a set of tiled files only the ranges of matching tiles are read, and the rest is compared as records are decoded. Writing is
in two phases: tasks write files under names of their own, the commit moves them in place and writes the set's record file, a LAS
file without points whose header is that of all files together and whose extended records hold the table of tiles, with the place
of each in its file and in the whole set, and the statistics of heights. A stream reads the files that a folder gains; which ones
it has seen is kept in a log beside its checkpoint, so a restarted query reads none twice.
Compressed files (.laz) are read in their chunks, which are planned from chunk tables; what is written isn't compressed (laz.write_laz does that).
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from tessera.operators import grid
from tessera.sources import las, laz
from tessera.sources.points import Quantization

#: The record file of a set, and its extended records: tiles, statistics of heights, quantization and density.
SET_FILE, OWNER, TILES, STATISTICS = "_set.las", "tessera", 10, 11
TILE = np.dtype([("row", "<i8"), ("col", "<i8"), ("file", "<i8"), ("first", "<i8"), ("count", "<i8"), ("offset", "<i8")])
TILE_FIELDS = {"tile_row": "long", "tile_col": "long"}
TESTS = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}


#: Ranges up to which each has a task of its own.
MOST = 256


@dataclass
class Range(InputPartition):
    """A range of records of a file, with what its header says, and the tile it lies in, if known; further ranges of the file."""

    head: dict
    more: list = field(default_factory=list)


@dataclass
class Written(WriterCommitMessage):
    """A task's files: temporary name, name, header facts and tiles."""

    files: list


def listing(path: str) -> list[tuple[str, int]]:
    """(uri, modification time in ns) of the .las and .laz files of a folder, or of one file, by name; what begins with _ or . isn't data."""
    fs, root = las.filesystem(path)
    info = fs.get_file_info(root)
    found = [info] if info.type == pyarrow.fs.FileType.File else fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True))
    scheme, _, rest = path.partition("://") if "://" in path else ("file", "", "")
    # Paths of object stores begin with the bucket, others with a slash behind the host.
    uri = lambda p: f"{scheme}://{rest.partition('/')[0]}{p}" if p.startswith("/") else f"{scheme}://{p}"
    return sorted((uri(f.path), f.mtime_ns or 0) for f in found if f.type == pyarrow.fs.FileType.File and f.base_name.endswith((".las", ".laz")) and f.base_name[0] not in "._")


def head_of(path: str) -> dict:
    with las.opened(path) as f:
        return las.parsed(f.read(las.HEADER_SIZE), path)


def set_records(folder: str) -> tuple[list[str], np.ndarray, dict] | None:
    """The files' names, the tiles and the facts of a set's record file; none for a folder without one."""
    fs, root = las.filesystem(folder)
    if fs.get_file_info(f"{root}/{SET_FILE}").type != pyarrow.fs.FileType.File:
        return None
    with fs.open_input_file(f"{root}/{SET_FILE}") as f:
        head = las.parsed(f.read(las.HEADER_SIZE), folder)
        at, found = head["evlr_offset"], {}
        for _ in range(head["n_evlrs"]):
            f.seek(at)
            raw = f.read(struct.calcsize(las.EVLR_FORMAT))
            _, _, number, length, _ = struct.unpack(las.EVLR_FORMAT, raw)
            found[number] = f.read(length)
            at += len(raw) + length
    facts = json.loads(found[STATISTICS])
    return facts["files"], np.frombuffer(found[TILES], TILE), facts


def ranges_of(path: str, most: int = las.RANGE) -> list[dict]:
    """All ranges of records at a path; those of a tiled set are whole tiles, cut where they are long."""
    known = set_records(path) if not path.endswith((".las", ".laz")) else None
    out = []
    if known is None:
        for uri, _ in listing(path):
            if uri.endswith(".laz"):
                out += laz.chunks_of(uri)
                continue
            head = head_of(uri)
            out += [head | {"start": s, "n": min(most, head["n_points"] - s)} for s in range(0, head["n_points"], most)]
        return out
    names, tiles, _ = known
    heads = [head_of(f"{path.rstrip('/')}/{name}") for name in names]
    for t in tiles.tolist():
        row, col, file, first, count, _ = t
        out += [heads[file] | {"start": s, "n": min(most, first + count - s), "tile_row": row, "tile_col": col} for s in range(first, first + count, most)]
    return out


def dealt(ranges: list[dict]) -> list[Range]:
    """A task for each range; where they are more than MOST, for a run of ranges of one file with no more points than a usual chunk."""
    out, points = [], 0
    for r in ranges:
        points += r["n"]
        if len(ranges) > MOST and out and out[-1].head["path"] == r["path"] and points <= laz.CHUNK:
            out[-1].more.append(r)
        else:
            out.append(Range(r))
            points = r["n"]
    return out


class LasReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.fields, self.tests = path, schema.fieldNames(), []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in (*las.FIELDS, *TILE_FIELDS) and isinstance(f.value, (int, float)) and f.attribute[0] != "path":
                self.tests.append((type(f).__name__, f.attribute[0], f.value))
            else:
                yield f

    def possible(self, r: dict) -> bool:
        """Whether a range may hold a record that fulfils all tests, by its tile and its file's extent."""
        for kind, name, value in self.tests:
            if name in TILE_FIELDS:
                low = high = r.get(name)
            elif name in ("x", "y", "z"):
                i = "xyz".index(name)
                slack = abs(r["scale"][i])  # headers may be rounded
                low, high = r["min_xyz"][i] - slack, r["max_xyz"][i] + slack
            elif name == "point_index":
                low, high = r["start"], r["start"] + r["n"] - 1
            else:
                continue
            if low is None or (kind in ("EqualTo", "GreaterThan", "GreaterThanOrEqual") and high < value) or (kind in ("EqualTo", "LessThan", "LessThanOrEqual") and low > value):
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        return dealt([r for r in ranges_of(self.path) if self.possible(r)]) or [Range({})]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for r in [partition.head, *partition.more] if partition.head else []:
            yield decoded(r, self.fields, self.tests)


def decoded(r: dict, fields: list[str], tests: list[tuple] = ()) -> pa.RecordBatch:
    """The fields of the records of a range that pass the tests; a field that is null passes none."""
    rows = laz.chunk_rows(r) if "items" in r else las.record_range(r)

    def column(name: str) -> pa.Array:
        return pa.array([r.get(name)] * len(rows), pa.int64()) if name in TILE_FIELDS else las.field_of(name, rows, r)

    keep = np.ones(len(rows), bool)
    compare = {k.__name__: f for k, f in TESTS.items()}
    for kind, name, value in tests:
        values = column(name)
        keep &= compare[kind](values.fill_null(0).to_numpy(zero_copy_only=False), value) & ~np.asarray(values.is_null())
    batch = pa.RecordBatch.from_arrays([column(name) for name in fields], list(fields))
    return batch if keep.all() else batch.filter(pa.array(keep))


class LasWriter(DataSourceArrowWriter):
    """Options: scale and offset, three numbers each with commas; pointFormat; tiled, if rows have tile_row and tile_col and come sorted by
    them; overwrite mode empties the folder at the commit."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.names, self.overwrite = options["path"], schema.fieldNames(), overwrite
        number = lambda name, default: tuple(float(v) for v in options.get(name, default).split(","))
        self.quantization = Quantization(number("scale", "0.01,0.01,0.01"), number("offset", "0,0,0"))
        self.form, self.tiled, self.job = int(options.get("pointformat", "1")), options.get("tiled", "false").lower() == "true", uuid.uuid4().hex
        self.facts = json.loads(options.get("facts", "{}"))
        if missing := {"qx", "qy", "qz", *(TILE_FIELDS if self.tiled else ())} - set(self.names):
            raise ValueError(f"columns are missing: {sorted(missing)}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = las.filesystem(self.path)
        work = f"{root}/_temporary-{self.job}"
        fs.create_dir(work, recursive=True)
        kinds = dict(las.RECORDS[self.form])
        files, held, places, count = [], [], [], 0

        def flush() -> None:
            nonlocal held, places, count
            rows = np.concatenate(held)
            name = f"part-{task.partitionId():06d}-{len(files):04d}.las"
            with fs.open_output_stream(f"{work}/{name}.{task.taskAttemptId()}", compression=None) as f:
                f.write(las.header_of(rows, self.quantization, self.form))
                f.write(rows.tobytes())
            tiles = []
            if self.tiled:
                at = np.concatenate(places)
                starts = np.flatnonzero(np.concatenate([[True], (np.diff(at, axis=0) != 0).any(1)]))
                tiles = [(*at[s].tolist(), int(s), int(e - s)) for s, e in zip(starts, np.append(starts[1:], len(at)), strict=True)]
            files.append((f"{name}.{task.taskAttemptId()}", name, las.parsed(las.header_of(rows, self.quantization, self.form), name), tiles))
            held, places, count = [], [], 0

        for batch in iterator:
            if not batch.num_rows:
                continue
            rows = np.zeros(batch.num_rows, np.dtype(las.RECORDS[self.form]))
            rows["options"] = 17 if self.form >= 6 else 9  # the first return of one
            for name, kind in kinds.items():
                if name in self.names and name != "wave":
                    column = batch.column(batch.schema.get_field_index(name))
                    rows[name] = column.cast(pa.float64() if name == "gps_time" else pa.from_numpy_dtype(np.dtype(kind))).fill_null(0).to_numpy(zero_copy_only=False)
            held.append(rows)
            if self.tiled:
                places.append(np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in TILE_FIELDS], axis=1))
            count += len(rows)
            if count >= las.FILE:
                flush()
        if count:
            flush()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = las.filesystem(self.path)
        fs.create_dir(root, recursive=True)
        if self.overwrite:
            for uri, _ in listing(self.path):
                fs.delete_file(las.filesystem(uri)[1])
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f[1])
        prefix = "" if self.overwrite or self.tiled else f"{self.job[:8]}-"  # files that are appended have names of their own
        for given, name, _, _ in files:
            fs.move(f"{root}/_temporary-{self.job}/{given}", f"{root}/{prefix}{name}")
        if self.tiled:
            self.write_set(fs, root, files)
        self.clean(fs, root)

    def write_set(self, fs: pyarrow.fs.FileSystem, root: str, files: list) -> None:
        """The set's record file: a bounded row for each tile and file, as the commit's messages have them."""
        tiles, offset, heads = [], 0, [f[2] for f in files]
        for number, (_, _, head, own) in enumerate(files):
            tiles += [(row, col, number, first, n, offset + first) for row, col, first, n in own]
            offset += head["n_points"]
        low = [min((h["min_xyz"][i] for h in heads), default=0.0) for i in range(3)]
        high = [max((h["max_xyz"][i] for h in heads), default=0.0) for i in range(3)]
        facts = self.facts | {"files": [f[1] for f in files], "points": offset, "min_xyz": low, "max_xyz": high, "scale": self.quantization.scale, "offset": self.quantization.offset, "point_format": self.form}
        records = [las.record_bytes(las.EVLR_FORMAT, OWNER, TILES, "tiles", np.array(tiles, TILE).tobytes()), las.record_bytes(las.EVLR_FORMAT, OWNER, STATISTICS, "statistics", json.dumps(facts).encode())]
        one = np.zeros(1, np.dtype(las.RECORDS[self.form]))
        head = bytearray(las.header_of(one, self.quantization, self.form, n_evlrs=len(records)))
        struct.pack_into("<I", head, 96, las.HEADER_SIZE)
        struct.pack_into("<Q", head, 235, las.HEADER_SIZE)  # no points: the records follow the header
        struct.pack_into("<I20x", head, 107, 0)
        struct.pack_into("<Q120x", head, 247, 0)
        struct.pack_into("<6d", head, 179, *[v for pair in zip(high, low, strict=True) for v in pair])
        with fs.open_output_stream(f"{root}/{SET_FILE}.{self.job}", compression=None) as f:
            f.write(bytes(head))
            for r in records:
                f.write(r)
        fs.move(f"{root}/{SET_FILE}.{self.job}", f"{root}/{SET_FILE}")

    def abort(self, messages: list[Written | None]) -> None:
        self.clean(*las.filesystem(self.path))

    def clean(self, fs: pyarrow.fs.FileSystem, root: str) -> None:
        if fs.get_file_info(f"{root}/_temporary-{self.job}").type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(f"{root}/_temporary-{self.job}")


class LasStream(DataSourceStreamReader):
    """Files of a folder in the order in which they were first seen: an offset is how many. The log of seen files is a folder of
    small files, each named after how many came before it."""

    def __init__(self, path: str, log: str, schema: StructType):
        self.path, self.log, self.fields = path, log, schema.fieldNames()

    def seen(self) -> list[str]:
        fs, root = las.filesystem(self.log)
        names = sorted(f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True)) if f.base_name.endswith(".json"))
        out = []
        for name in names:
            with fs.open_input_stream(name) as f:
                out += json.loads(f.read())
        return out

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        known = self.seen()
        there = listing(self.path)
        new = [uri for uri, _ in sorted(there, key=lambda f: (f[1], f[0])) if uri not in set(known)]
        if new:
            fs, root = las.filesystem(self.log)
            fs.create_dir(root, recursive=True)
            name = f"{root}/{len(known):012d}"
            part = f"{name}.{uuid.uuid4().hex}.part"
            with fs.open_output_stream(part, compression=None) as f:
                f.write(json.dumps(new).encode())
            fs.move(part, f"{name}.json")
        return {"files": len(known) + len(new)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        files = self.seen()[start["files"] : end["files"]]
        return [Range(r) for uri in files for r in ranges_of(uri)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield decoded(partition.head, self.fields)


class LasSource(DataSource):
    """Format "las". Options: path; fields, names of las.FIELDS (and tile_row, tile_col in a tiled set) with commas; log, the folder in
    which a stream keeps what it has seen."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        fields = self.options.get("fields", ",".join(las.POINTS)).split(",")
        kinds = las.FIELDS | TILE_FIELDS
        return ", ".join(f"{f} {kinds[f]}" for f in fields)

    def reader(self, schema: StructType) -> LasReader:
        return LasReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> LasWriter:
        return LasWriter(dict(self.options), schema, overwrite)

    def streamReader(self, schema: StructType) -> LasStream:
        return LasStream(self.options["path"], self.options["log"], schema)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LasSource)


def write_tiled_las(points: DataFrame, cell: tuple[int, int], path: str, quantization: Quantization, point_format: int = 1) -> None:
    """Points (qx, qy, qz and fields of the format) as one set of LAS files, clustered by tiles of a cell size in row-major order; each tile's place
    is in the set's record file, with density and statistics of heights. A tile of many points may span files."""
    spark = points.sparkSession
    register(spark)
    definition = grid.grid(points, *cell)
    cells = grid.celled(points, definition)
    summary = grid.density_summary(grid.density(cells)).first()
    heights = grid.histogram_statistics(grid.z_histogram(points), points).first()
    shape = definition.first()
    facts = {"grid": shape.asDict(), "density": summary.asDict() if summary else {}, "heights": {k: None if v is None else float(v) for k, v in heights.asDict().items()} if heights else {}}
    kept = [c for c in points.columns if c in dict(las.RECORDS[point_format])]
    order = ["tile_row", "tile_col", "qx", "qy", "qz"]
    dealt = cells.select(*kept, "tile_row", "tile_col").repartitionByRange(*order).sortWithinPartitions(*order)
    options = {"scale": ",".join(map(str, quantization.scale)), "offset": ",".join(map(str, quantization.offset)), "pointFormat": str(point_format), "tiled": "true", "facts": json.dumps(facts)}
    dealt.write.format("las").options(**options).mode("overwrite").save(path)


def tile_set(spark: SparkSession, path: str) -> DataFrame:
    """(tile_row, tile_col, file, first, point_count, point_offset) of a tiled set, from its record file; a tile that spans files has several rows."""
    known = set_records(path)
    names, tiles, _ = known
    rows = [(r, c, names[f], s, n, o) for r, c, f, s, n, o in tiles.tolist()]
    return spark.createDataFrame(rows, "tile_row long, tile_col long, file string, first long, point_count long, point_offset long")


#: Handlers by extension: how to open a path of that kind as points (x, y, z at least).
HANDLERS: dict = {}


def handles(*extensions: str):
    """Registers a function (spark, path) -> DataFrame for files of some extensions."""
    def add(f):
        HANDLERS.update({e.lower(): f for e in extensions})
        return f

    return add


def supported() -> list[str]:
    return sorted(HANDLERS)


def open_points(spark: SparkSession, path: str) -> DataFrame:
    """The points of a file by the handler of its extension."""
    extension = os.path.splitext(path)[1].lower()
    if extension not in HANDLERS:
        raise ValueError(f"no handler for {extension or path}; there are {', '.join(supported())}")
    return HANDLERS[extension](spark, path)


@handles(".las")
def open_las(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("las").load(path)


@handles(".laz")
def open_laz(spark: SparkSession, path: str) -> DataFrame:
    return laz.read_laz(spark, path)


@handles(".lasgroup")
def open_group(spark: SparkSession, path: str) -> DataFrame:
    return las.read_las(spark, path).union(laz.read_laz(spark, path))


@handles(".xyz", ".txt")
def open_text(spark: SparkSession, path: str) -> DataFrame:
    from tessera.sources import xyz

    return xyz.read_xyz(spark, path)


def stream_counts(spark: SparkSession, folder: str, state: str) -> DataFrame:
    """Reads what a folder of LAS files holds that earlier calls with the same `state` folder haven't read, and returns (path, n) of all so far."""
    register(spark)
    stream = spark.readStream.format("las").option("fields", "path,qx").option("log", f"{state}/files").load(folder)

    def keep(rows: DataFrame, batch: int) -> None:
        rows.groupBy("path").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{state}/rows/batch={batch}")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("path string, n long, batch int").parquet(f"{state}/rows").groupBy("path").agg(F.sum("n").alias("n"))
