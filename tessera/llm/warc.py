"""Operator 6: web archives (WARC) in Zstandard form.

An archive begins with a skippable frame that holds the dictionary; then comes one frame for
each record. The reader loads the dictionary, decodes frame by frame and validates
headers and lengths. The writer makes such archives from rows, one file after another in each task.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import scratch, slices
from tessera.sources.las import filesystem

#: Fixed values of the format: magic number of the dictionary's skippable frame, of a Zstandard
#: frame, and of a raw dictionary; all little-endian.
DICTIONARY_FRAME, ZSTD_FRAME, RAW_DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A file is closed when it has so many bytes; a reader holds one file's compressed bytes.
FILE_BYTES = 8 << 20
#: The dictionary: its size, and the bound of the sample it is trained on.
DICTIONARY_BYTES, SAMPLE_ROWS, SAMPLE_BYTES = 64 << 10, 512, 8 << 20
LEVEL = 3


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=page_id & (1 << 64) - 1)}>"


def page_of(name: str) -> int:
    number = uuid.UUID(name.strip("<>").removeprefix("urn:uuid:")).int
    return number - (1 << 64) if number >> 63 else number


def record(page_id: int, url: str | None, payload: bytes | None, length: int, digest: str, first: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit of the page `first`. The block is an
    HTTP head, which tells the payload's length in both cases, and the payload of a response."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = head if first is not None else head + payload
    target = "".join(c for c in url or "" if c > " ")
    lines = [
        VERSION, f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_name(page_id)}", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {target or 'urn:unknown'}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if first is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_name(first)}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary


def read_dictionary(data: memoryview) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary of an archive, if it has one, and where its records begin. The dictionary
    may itself be compressed."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_FRAME:
        return None, 0
    size = struct.unpack_from("<I", data, 4)[0]
    if len(data) < 8 + size:
        raise ValueError("the dictionary frame is cut off")
    body = bytes(data[8 : 8 + size])
    magic = struct.unpack_from("<I", body)[0] if size >= 4 else 0
    if magic == ZSTD_FRAME:
        body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
    elif magic != RAW_DICTIONARY:
        raise ValueError("the leading frame holds no dictionary")
    return zstandard.ZstdCompressionDict(body), 8 + size


def frames(data: bytes, window: int = 1 << 16) -> Iterator[bytes]:
    """The content of each frame. Input is fed in windows, so nothing is copied twice."""
    view = memoryview(data)
    dictionary, at = read_dictionary(view)
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(view):
        if len(view) - at >= 8 and struct.unpack_from("<I", view, at)[0] & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + struct.unpack_from("<I", view, at + 4)[0]  # other skippable frames
            continue
        frame, out = reader.decompressobj(), []
        while not frame.eof:
            if at >= len(view):
                raise ValueError("the last frame is cut off")
            fed = view[at : at + window]
            out.append(frame.decompress(fed))
            at += len(fed)
        at -= len(frame.unused_data)
        yield b"".join(out)


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers (names in lower case), HTTP head and payload of a record; raises ValueError if the
    record breaks the format, or a length or digest doesn't hold."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("the headers don't end")
    version, *lines = raw[:end].decode().split("\r\n")
    if version not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"not a WARC version: {version[:20]}")
    headers: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"not a header: {line[:60]}")
        headers[name.lower()] = value.strip()
    missing = [n for n in ("warc-type", "warc-record-id", "warc-date", "content-length") if not headers.get(n)]
    if missing:
        raise ValueError(f"headers are missing: {missing}")
    if not headers["content-length"].isdigit():
        raise ValueError("Content-Length isn't a number")
    length = int(headers["content-length"])
    block = raw[end + 4 : end + 4 + length]
    if len(block) != length or raw[end + 4 + length :] != b"\r\n\r\n":
        raise ValueError("the block's length differs from Content-Length")
    if (said := headers.get("warc-block-digest")) and said != f"sha1:{base32_sha1(block)}":
        raise ValueError("the block differs from its digest")
    head, blank, payload = block.partition(b"\r\n\r\n")
    if headers["warc-type"] == "response":
        if not blank:
            raise ValueError("the HTTP head doesn't end")
        if (said := headers.get("warc-payload-digest")) and said != f"sha1:{base32_sha1(payload)}":
            raise ValueError("the payload differs from its digest")
    elif headers["warc-type"] == "revisit" and not headers.get("warc-profile"):
        raise ValueError("a revisit has no profile")
    return headers, head, payload


def http_length(head: bytes) -> int:
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            return int(value)
    raise ValueError("the HTTP head has no Content-Length")


def train(pages: DataFrame, html_col: str = "html") -> bytes:
    """A dictionary from a bounded sample: at most SAMPLE_ROWS payloads and SAMPLE_BYTES. Where a
    sample is too small for training, a plain dictionary of the record's fixed text is built."""
    few = [r[0].encode() for r in pages.where(F.length(html_col).between(1, SAMPLE_BYTES // SAMPLE_ROWS)).select(html_col).limit(SAMPLE_ROWS).collect()]
    samples = [record(i, f"http://host/{i}", x, len(x), base32_sha1(x), None) for i, x in enumerate(few)]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 10)), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def marked(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Rows (page_id, url, payload, digest, first): first is the smallest id with an equal payload of
    another row, null where the row is the first itself."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    keyed = rows.select("page_id", "digest")
    groups = keyed.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    later = keyed.join(groups, "digest").where("page_id <> first").select("page_id", "digest", "first").distinct()
    return rows.join(later, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "first")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the rows as .warc.zst files under `path` (a URI that all executors reach) and return (file,
    records, bytes) once all are written. Each task writes to names of its own attempt and renames
    a file when it is complete, so that a retried or doubled task leaves no half file; the
    returned table names the files that count."""
    dictionary = train(pages, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, root = filesystem(path)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True) if dictionary else zstandard.ZstdCompressor(level=LEVEL)
        number, done, out, count = 0, [], io.BytesIO(), 0

        def close() -> None:
            nonlocal number, out, count
            if count:
                name = f"{root}/{context.partitionId():06d}-{number:05d}-{context.taskAttemptId()}.warc.zst"
                with fs.open_output_stream(f"{name}.part", compression=None) as f:
                    f.write(out.getvalue())
                fs.move(f"{name}.part", name)
                done.append((name.rpartition("/")[2], count, out.tell()))
                number, out, count = number + 1, io.BytesIO(), 0

        fs.create_dir(root, recursive=True)
        for rows in slices(batches, 256):
            for page_id, url, payload, digest, first in zip(*(rows.column(i).to_pylist() for i in range(5)), strict=True):
                if not count and dictionary:
                    out.write(dictionary_frame(dictionary))
                out.write(packer.compress(record(page_id, url, payload, len(payload), base64.b32encode(digest).decode(), first)))
                count += 1
                if out.tell() >= FILE_BYTES:
                    close()
        close()
        if done:
            yield pa.record_batch([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "records", "bytes"])

    rows = marked(pages, id_col, url_col, html_col)
    made = rows.mapInArrow(run, "file string, records long, bytes long")
    index = f"{path}-index"
    made.write.parquet(index)
    return pages.sparkSession.read.schema(made.schema).parquet(index)


def read_archives(files: DataFrame, path: str) -> DataFrame:
    """The records of the archives that `files` (column file) names under `path`: page_id, warc_type, url, payload
    (of responses), payload_bytes, payload_digest, refers_to. A broken record fails the job, with the
    name of its file."""
    root = path.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "warc_type", "url", "payload", "payload_bytes", "payload_digest", "refers_to"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[i] for r in rows], kinds[i]) for i in range(7)], names)

        for rows in slices(batches, 1):
            file = rows.column(0)[0].as_py()
            fs, folder = filesystem(root)
            with fs.open_input_stream(f"{folder}/{file}", compression=None) as f:
                data = f.read()
            out, held = [], 0
            for number, raw in enumerate(frames(data)):
                try:
                    headers, head, payload = parse(raw)
                    refers = headers.get("warc-refers-to")
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    response = headers["warc-type"] == "response"
                    out.append((page_of(headers["warc-record-id"]), headers["warc-type"], headers.get("warc-target-uri"), payload if response else None, len(payload) if response else http_length(head), digest, page_of(refers) if refers else None))
                except (ValueError, KeyError) as e:
                    raise ValueError(f"{file}, record {number}: {e}") from e
                held += len(raw)
                if held > 4 << 20:
                    yield table(out)
                    out, held = [], 0
            if out:
                yield table(out)

    return files.select("file").mapInArrow(run, "page_id long, warc_type string, url string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def through_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every row of `pages` to archives in the shared folder and read them back.

    A null html counts as empty; an empty one is a payload like any other, so all empty ones but the
    first are revisits. Of repeated rows with one id each gives a response, as their id is the
    smallest; rows with a null id can't be named and are left out; a null url becomes urn:unknown. An empty table gives no
    archive and no rows. Other columns are left out.
    """
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    files = write_archives(pages, path, id_col, url_col, html_col)
    spread = files.repartition(max(1, spark.sparkContext.defaultParallelism * 4), "file")
    return read_archives(spread, path)
