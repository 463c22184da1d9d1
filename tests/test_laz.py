"""Compressed LAS files: chunks of any values, files by every reader, variable chunks, and what is refused."""

import struct

import numpy as np
import pytest

from tessera.sources import las, lasformat, laz
from tessera.sources.points import Quantization

Q = Quantization((1.0, 1.0, 1.0))


def any_records(form: int, n: int, seed: int) -> np.ndarray:
    """Smooth and wild values in every field; times in several sequences, standing still, in multiples of a step, and far apart."""
    rng, rows = np.random.default_rng(seed), np.zeros(n, np.dtype(las.RECORDS[form]))
    for f in rows.dtype.names:
        kind = rows.dtype[f]
        if f == "gps_time":
            rows[f] = np.cumsum(rng.choice([0, 1e-5, 1e-5, 2e-5, -3e-5, 0.1, 3e-4], n))
            rows[f][::7] += 1e6
            rows[f][n // 2 : n // 2 + 50] = (rng.standard_normal(50) * 1e9)[: len(rows[f][n // 2 : n // 2 + 50])]
        elif f in ("qx", "qy", "qz"):
            rows[f] = np.cumsum(rng.integers(-50, 50, n))
            rows[f][::100] = rng.choice([-(2**31), 2**31 - 1, 0], len(rows[f][::100]))
        elif f in ("red", "green", "blue"):
            rows[f] = rng.integers(0, 65536, n) // rng.choice([1, 256, 65536], n)
        else:
            rows[f] = np.where(rng.random(n) < 0.8, rng.integers(0, 3, n), rng.integers(np.iinfo(kind).min, np.iinfo(kind).max + 1, n)).astype(kind)
    return rows


def items_of(form: int) -> list:
    return [(c, laz.CODERS[c].form.size) for c in laz.ITEMS[form]]


@pytest.mark.parametrize("form", range(4))
@pytest.mark.parametrize("n", [1, 2, 3000])
def test_chunks_round_trip(form, n):
    raw = any_records(form, n, form).tobytes()
    packed = laz.chunk_written(raw, items_of(form))
    assert laz.chunk_read(iter(packed), n, items_of(form)) == raw


def test_smooth_points_get_smaller_and_extra_bytes_stay():
    rows = np.zeros(3000, np.dtype(las.RECORDS[1]))
    rows["qx"], rows["qy"], rows["options"], rows["gps_time"] = np.arange(3000) * 3, np.arange(3000) // 7, 9, 2.0**20 + np.arange(3000) / 64
    assert len(laz.chunk_written(rows.tobytes(), items_of(1))) < rows.nbytes / 20
    extra = np.concatenate([rows.view(np.uint8).reshape(3000, 28), np.arange(9000, dtype=np.uint8).reshape(3000, 3)], axis=1).tobytes()
    items = [*items_of(1), (laz.EXTRA, 3)]
    assert laz.chunk_read(iter(laz.chunk_written(extra, items)), 3000, items) == extra


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    place = f"file://{tmp_path_factory.mktemp('laz')}"
    points = spark.range(0, 5000, 1, 3).selectExpr("int(id % 100) qx", "int(id div 100) qy", "int(id * 7 % 31) qz", "double(id) gps_time", "int(id % 32) class_bits", "int(id * 9 % 65536) red")
    wrote = laz.write_laz(points, place, Q, 3, 500).agg({"n_points": "sum"}).first()[0]
    assert wrote == 5000
    return place


EXPECTED = sorted((float(i), i % 100, i // 100, i % 32, i * 9 % 65536, 0) for i in range(5000))
FIELDS = ("gps_time", "qx", "qy", "classification", "red", "green")


def test_every_reader_gives_the_points(spark, folder):
    lasformat.register(spark)
    assert sorted(map(tuple, laz.read_laz(spark, folder, FIELDS).collect())) == EXPECTED
    assert sorted(map(tuple, spark.read.format("las").option("fields", ",".join(FIELDS)).load(folder).collect())) == EXPECTED
    one = lasformat.listing(folder)[0][0]
    assert one.endswith(".laz") and ".laz" in lasformat.supported()
    assert lasformat.open_points(spark, one).count() == laz.chunks(spark, one).agg({"n": "sum"}).first()[0]
    spark.createDataFrame([(one,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/list")
    part = next(p for p in las.filesystem(folder)[0].get_file_info(__import__("pyarrow").fs.FileSelector(las.filesystem(folder)[1] + "/list")) if p.base_name.startswith("part"))
    fs, root = las.filesystem(folder)
    fs.move(part.path, f"{root}/list/all.lasgroup")
    assert lasformat.open_points(spark, f"{folder}/list/all.lasgroup").count() == lasformat.open_points(spark, one).count()


def test_filters_leave_chunks_unread(spark, folder):
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThan
    from pyspark.sql.types import StructType

    reader = lasformat.LasReader(folder, StructType())
    every = reader.partitions()
    assert len(every) == sum(1 for _ in laz.chunks(spark, folder).collect()) == 12  # files of 1666 or 1667 points
    assert not list(reader.pushFilters([GreaterThanOrEqual(("point_index",), 600), LessThan(("point_index",), 900)]))
    assert [r.head["start"] for r in reader.partitions()] == [500] * 3
    lasformat.register(spark)
    df = spark.read.format("las").option("fields", "gps_time,point_index").load(folder)
    assert df.where("point_index >= 600 and point_index < 900").count() == 900


def image(rows: np.ndarray, chunk: int = 40) -> bytes:
    return b"".join(laz.file_image(rows, Q, 0, chunk))


def test_tables_at_the_end_and_chunks_of_any_length(spark, tmp_path):
    rows = any_records(0, 100, 5)
    raw = bytearray(image(rows))
    start = las.HEADER_SIZE + struct.unpack_from("<H", raw, las.HEADER_SIZE + 20)[0] + struct.calcsize(las.VLR_FORMAT)
    (table,) = struct.unpack_from("<q", raw, start)
    raw[start : start + 8] = struct.pack("<q", -1)
    (tmp_path / "end.laz").write_bytes(bytes(raw) + struct.pack("<q", table))
    parts = [laz.chunk_written(rows[a:b].tobytes(), items_of(0)) for a, b in ((0, 7), (7, 90), (90, 100))]
    coder, numbers, n, size = laz.Writing(), laz.Numbers(32, 2), 0, 0
    for count, part in zip((7, 83, 10), parts, strict=True):
        n, size = numbers.code(coder, n, 0, count), numbers.code(coder, size, 1, len(part))
    struct.pack_into("<I", raw, las.HEADER_SIZE + struct.calcsize(las.VLR_FORMAT) + 12, laz.ANY)
    struct.pack_into("<q", raw, start, start + 8 + sum(map(len, parts)))
    (tmp_path / "any.laz").write_bytes(bytes(raw[: start + 8]) + b"".join(parts) + struct.pack("<II", 0, 3) + coder.done())
    for name in ("end", "any"):
        got = laz.read_laz(spark, f"file://{tmp_path}/{name}.laz", ("point_index", "qx", "source_id")).orderBy("point_index").collect()
        assert [(r.qx, r.source_id) for r in got] == list(zip(rows["qx"].tolist(), rows["source_id"].tolist(), strict=True))


def test_what_is_refused(spark, tmp_path):
    rows = any_records(0, 100, 6)
    raw = image(rows)
    bad = bytearray(raw)
    struct.pack_into("<H", bad, las.HEADER_SIZE + struct.calcsize(las.VLR_FORMAT), 3)
    cases = {"layered": bytes(bad), "short": raw[:700], "plain": las.header_of(rows, Q, 0) + rows.tobytes(), "none": b""}
    for name, data in cases.items():
        (tmp_path / f"{name}.laz").write_bytes(data)
        with pytest.raises((ValueError, struct.error)):
            for r in laz.chunks_of(f"file://{tmp_path}/{name}.laz"):
                laz.chunk_rows(r)
    with pytest.raises(ValueError, match="can't be compressed"):
        laz.write_laz(spark.range(1).selectExpr("0 qx", "0 qy", "0 qz"), f"file://{tmp_path}", Q, 6)
    none = spark.range(0).selectExpr("0 qx", "0 qy", "0 qz")
    assert laz.write_laz(none, f"file://{tmp_path}/empty", Q, 0).count() == 0


def test_many_chunks_share_tasks(spark, folder, monkeypatch):
    from pyspark.sql.types import StructType

    monkeypatch.setattr(lasformat, "MOST", 11)
    monkeypatch.setattr(laz, "CHUNK", 1000)
    reader = lasformat.LasReader(folder, StructType.fromDDL("gps_time double, qx int"))
    parts = reader.partitions()
    assert len(parts) == 6 and all(sum(r["n"] for r in [p.head, *p.more]) <= 1000 for p in parts)
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == sum(r.n for r in laz.chunks(spark, folder).collect())
