"""WARC archives as seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each with whole WARC records,
and a skippable frame at its end with a seek table: compressed and decompressed
size of every frame. An index maps record ids to a bundle, a frame and the
record's offset within the decompressed frame, so that one record is read by
decompressing one frame. Records whose payload equals an earlier page's are
revisits and hold no payload.

Bundles are written by tasks through pyarrow's file systems into the shared
folder. An attempt's bundles have names of their own, and the index names those
of the attempts that counted: what a lost attempt left is never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm.arrow import as_bytes, sliced
from ledgerweave.work import new_path, written

#: Fixed values of the seekable format: the skippable frame's magic number and the footer's.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Bytes of records in a frame before it is closed; compressed bytes in a bundle.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 256 << 20
#: Frames that a reading task takes at a time.
FRAMES_A_RANGE = 32
#: The profile of a revisit, as the WARC standard names it.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INDEX = "record_id string, page_id long, bundle string, frame long, at long, length long"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system and path for a URI as Spark writes it."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{digest}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: str | None, captured_at: str) -> bytes:
    """One WARC record. Its payload's length and digest are those of the full payload, for a revisit too."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = HTTP if refers_to else HTTP + payload
    fields = {
        "WARC-Type": "revisit" if refers_to else "response",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": captured_at,
        "WARC-Target-URI": None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~"),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Payload-Length": len(payload),
        "WARC-Profile": PROFILE if refers_to else None,
        "WARC-Refers-To": refers_to,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, payload) of each record in a decompressed frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        body = data[end + 4 : end + 4 + int(fields["Content-Length"])]
        yield at, fields, body[body.index(b"\r\n\r\n") + 4 :]
        at = end + 4 + len(body) + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file: pa.NativeFile) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of each frame, from the file's end."""
    size = file.size()
    count, flags, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
    if magic != SEEKABLE or flags & 0x7C:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    raw, at, out = file.read_at(count * width, size - 9 - count * width), 0, []
    for k in range(count):
        packed, whole = struct.unpack_from("<II", raw, k * width)
        out.append((at, packed, whole))
        at += packed
    return out


def _writer(folder: str, captured_at: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        context, pack = TaskContext.get(), zstandard.ZstdCompressor(level=3)
        part, attempt = context.partitionId(), context.taskAttemptId()
        bundles, out, last = 0, None, None
        frame, frame_size, sizes, rows, index = [], 0, [], [], []

        def bundle_name() -> str:
            return f"bundle-{part:06d}-{bundles:04d}-{attempt}.warc.zst"

        def close_frame() -> None:
            nonlocal frame, frame_size, rows
            if frame:
                data = pack.compress(b"".join(frame))
                out.write(data)
                sizes.append((len(data), frame_size))
                index.extend((*r[:2], len(sizes) - 1, *r[2:]) for r in rows)
                frame, frame_size, rows = [], 0, []

        def close_bundle() -> pa.RecordBatch | None:
            nonlocal out, sizes, index, bundles
            if out is None:
                return None
            close_frame()
            out.write(seek_table(sizes))
            out.close()
            name = bundle_name()
            ids, pages, frames, at, length = zip(*index, strict=True)
            made = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(pages, pa.int64()), pa.array([f"{folder}/{name}"] * len(ids)), pa.array(frames, pa.int64()), pa.array(at, pa.int64()), pa.array(length, pa.int64())], ["record_id", "page_id", "bundle", "frame", "at", "length"])
            out, sizes, index, bundles = None, [], [], bundles + 1
            return made

        for b in sliced(batches, 256):
            for place, page, url, payload, key, first, first_place in zip(b["place"].to_pylist(), b["page_id"].to_pylist(), b["url"].to_pylist(), as_bytes(b["html"]), b["same"].to_pylist(), b["first_id"].to_pylist(), b["first_place"].to_pylist(), strict=True):
                again = last == (place, page, key)  # rows that repeat one page
                last = (place, page, key)
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                refers = None
                if key is not None and (again or first != page or first_place != place):
                    refers = record_id(first, digest)
                raw = record(page, url, payload, refers, captured_at)
                if out is None:
                    out = fs.open_output_stream(f"{root}/{bundle_name()}", compression=None)  # frames are compressed already
                rows.append((record_id(page, digest), page, frame_size, len(raw)))
                frame.append(raw)
                frame_size += len(raw)
                if frame_size >= FRAME_BYTES:
                    close_frame()
                    if sum(x for x, _ in sizes) >= BUNDLE_BYTES:
                        yield close_bundle()
        if (made := close_bundle()) is not None:
            yield made

    return run


def write_archive(pages: DataFrame, folder: str, min_bytes: int = 0, captured_at: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each page; return the index, as a table in the shared folder.

    pages has page_id, url and html. A null html is empty, a very long one is a
    record like others; a null url has no field; a null page_id counts as larger
    than any other. Of records whose payloads are equal and have min_bytes or
    more, the smallest page_id is the response and the others revisit it; of rows
    that repeat a page, and of rows without an id, one is the response. An empty
    table writes no bundle. Payloads are compared by their SHA-256; only that and
    the id are grouped, with map-side combination. Rows are dealt out by page,
    those without an id by their content.
    """
    spark = pages.sparkSession
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    html = F.coalesce(pages["html"], F.lit(""))
    page = pages["page_id"].cast("long")
    place = F.coalesce(page, F.xxhash64(html, pages["url"]))
    rows = pages.select(place.alias("place"), page.alias("page_id"), pages["url"], html.alias("html"), F.when(F.octet_length(html) >= min_bytes, F.sha2(html, 256)).alias("same"))
    ids = rows.where("same IS NOT NULL").select("place", "page_id", "same")
    least = F.min(F.struct(F.col("page_id").isNull(), "place", "page_id")).alias("least")
    many = ids.groupBy("same").agg(least, F.count("*").alias("many")).where("many > 1").select("same", F.col("least.page_id").alias("first_id"), F.col("least.place").alias("first_place"))
    pairs = ids.join(many, "same").select(F.col("place").alias("of"), F.col("same").alias("key"), "first_id", "first_place").distinct()
    # Payloads are dealt out once, by place; the join keeps to that, so the rest of its condition isn't an equality.
    placed = rows.repartition("place").join(pairs, (F.col("place") == F.col("of")) & F.col("same").between(F.col("key"), F.col("key")), "left")
    placed = placed.select("place", "page_id", "url", "html", F.col("key").alias("same"), "first_id", "first_place").sortWithinPartitions("page_id", "place", "same", "url")
    return written(placed.mapInArrow(_writer(folder, captured_at), INDEX), "warc-index")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url"]
    for b in batches:
        for bundle, low, high in zip(b["bundle"].to_pylist(), b["low"].to_pylist(), b["high"].to_pylist(), strict=True):
            fs, path = file_system(bundle)
            with fs.open_input_file(path) as file:
                for at, packed, whole in read_seek_table(file)[low : high + 1]:
                    out = []
                    for _, f, payload in records(unpack.decompress(file.read_at(packed, at), max_output_size=whole)):
                        digest, kind = f["WARC-Payload-Digest"].removeprefix("sha1:"), f["WARC-Type"]
                        if kind == "response" and (base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != int(f["WARC-Payload-Length"])):
                            raise ValueError(f"{bundle}: {f['WARC-Record-ID']} isn't what was written")
                        page, other = (None if x is None or (n := x.split(":")[2]) == "none" else int(n) for x in (f["WARC-Record-ID"], f.get("WARC-Refers-To")))
                        out.append((page, int(f["WARC-Payload-Length"]), digest, kind, other, f["WARC-Record-ID"], f.get("WARC-Target-URI")))
                    cols = list(zip(*out, strict=True))
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def read_archive(index: DataFrame) -> DataFrame:
    """Every record of an index's bundles, frame by frame in parallel: ids, full payload's length and digest, type and what it refers to."""
    ranges = index.groupBy("bundle", F.expr(f"frame div {FRAMES_A_RANGE}").alias("k")).agg(F.min("frame").alias("low"), F.max("frame").alias("high"))
    return ranges.select("bundle", "low", "high").mapInArrow(_reader, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string")


def fetch(index: DataFrame, record: str) -> list[tuple[dict[str, str], bytes]]:
    """Fields and payload of the records with an id, by reading one frame for each."""
    found = []
    for r in index.where(F.col("record_id") == record).select("bundle", "frame", "at", "length").collect():
        fs, path = file_system(r["bundle"])
        with fs.open_input_file(path) as file:
            at, packed, whole = read_seek_table(file)[r["frame"]]
            data = zstandard.ZstdDecompressor().decompress(file.read_at(packed, at), max_output_size=whole)
        found += [(f, payload) for _, f, payload in records(data[r["at"] : r["at"] + r["length"]])]
    return found


def archive_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write pages to an archive in the shared folder and read it back."""
    return read_archive(write_archive(pages, new_path(spark, "warc")))
