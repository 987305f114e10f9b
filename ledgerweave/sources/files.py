"""Acceptance of files: identity, limits, names, archives, and what may not be read again."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Approved limits of an input; fixed values."""

    file_bytes: int = 100 << 20
    pages: int = 1000
    nesting: int = 5
    unpacked_bytes: int = 500 << 20
    ratio: int = 100


LIMITS = Limits()
#: What an own result carries, so that it is never taken for an input.
DERIVED_MARK = "ledgerweave-derived-result"
#: Names that a file system keeps for itself.
RESERVED = ("con", "prn", "aux", "nul", *(f"{d}{n}" for d in ("com", "lpt") for n in range(1, 10)))


def read_files(spark: SparkSession, path: str, limits: Limits = LIMITS) -> DataFrame:
    """(document_id, path, name, size, content, refusals): each file by the SHA-256 of its bytes; too large ones aren't read.

    Spark's readers leave out files without a byte, so those are listed beside it.
    """
    rows = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    if empty := _empty_files(spark, path):
        rows = rows.unionByName(spark.createDataFrame([(p, 0, bytearray()) for p in empty], "path string, length long, content binary"))
    large = F.col("length") > limits.file_bytes
    content = F.when(~large, F.col("content"))
    refusals = F.array_compact(F.array(F.when(large, "E_LIMIT_SIZE"), F.when(F.col("length") == 0, "E_EMPTY_FILE"), F.when(derived(content), "E_DERIVED_INPUT")))
    return rows.select(F.sha2(content, 256).alias("document_id"), "path", safe_name(F.element_at(F.split("path", "/"), -1)).alias("name"), F.col("length").alias("size"), content.alias("content"), refusals.alias("refusals"))


def _empty_files(spark: SparkSession, path: str) -> list[str]:
    """Paths of the files without a byte that a path, its pattern or its folders name."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found, todo = [], list(fs.globStatus(where) or [])
    while todo:
        status = todo.pop()
        own = status.getPath()
        if own.getName().startswith(("_", ".")):
            continue
        if status.isDirectory():
            todo += list(fs.listStatus(own))
        elif status.getLen() == 0:
            found.append(own.toString())
    return sorted(found)


def check_limits(measured: dict[str, tuple[Column, int]]) -> Column:
    """Struct (refusals, unchecked): names beyond their limit, and names that weren't measured."""
    over = F.array_compact(F.array(*(F.when(c > limit, f"E_LIMIT_{name.upper()}") for name, (c, limit) in measured.items())))
    open_ = F.array_compact(F.array(*(F.when(c.isNull(), name) for name, (c, _) in measured.items())))
    return F.struct(over.alias("refusals"), open_.alias("unchecked"))


def safe_name(raw: Column) -> Column:
    """A name to store under: no path, no control or reserved characters, no dots or blanks at its ends, at most 120 characters."""
    name = F.regexp_replace(F.element_at(F.split(raw, r"[/\\]"), -1), r'[\p{Cc}<>:"|?*]', "_")
    name = F.substring(F.regexp_replace(name, r"^[ .]+|[ .]+$", ""), 1, 120)
    stem = F.lower(F.element_at(F.split(name, r"\."), 1))
    return F.when(F.coalesce(name, F.lit("")) == "", "unnamed").when(stem.isin(*RESERVED), F.concat(F.lit("_"), name)).otherwise(name)


def derived(content: Column, head: int = 1 << 20) -> Column:
    """Whether the head of the bytes carries the mark of an own result."""
    return F.coalesce(F.contains(F.substring(content, 1, head), F.lit(DERIVED_MARK).cast("binary")), F.lit(False))


def unsafe_xml(text: Column) -> Column:
    """Whether XML declares a document type or an entity; such a text isn't parsed."""
    return text.rlike(r"(?i)<!\s*(DOCTYPE|ENTITY)")


def formula_like(text: Column) -> Column:
    """Whether a spreadsheet would take a text for a formula."""
    return text.rlike(r"^[=+\-@\t\r]")


def too_many_digits(number: Column, most: int = 15) -> Column:
    """Whether a decimal text has more significant digits than a spreadsheet keeps."""
    return F.char_length(F.regexp_replace(F.translate(number, "-+.", ""), "^0+", "")) > most


def input_policy(content: Column) -> Column:
    """Kind of a file by its first bytes; apply_policy() tells why one isn't taken."""
    head = F.substring(content, 1, 8)
    starts = lambda b: F.startswith(head, F.lit(bytes(b)))
    return F.when(starts(b"%PDF-"), "pdf").when(starts(b"PK\x03\x04"), "zip").when(starts(b"\xd0\xcf\x11\xe0"), "ole").when(starts(b"\x1f\x8b"), "gzip").otherwise("text")


#: What tells encryption, macros and a whole file by its bytes; fixed values.
OLE_ENCRYPTED, OLE_MACROS, PDF_ENCRYPT, PDF_END = b"E\0n\0c\0r\0y\0p\0t\0e\0d\0P\0a\0c\0k\0a\0g\0e", (b"_\0V\0B\0A\0", b"M\0a\0c\0r\0o\0s"), b"/Encrypt", b"%%EOF"


def policy_codes(data: bytes, limits: Limits = LIMITS) -> list[str]:
    """Why a file isn't taken: empty or damaged, encrypted, with macros, or what inspect_bytes() says against an archive."""
    if not data:
        return ["E_POLICY_BROKEN"]
    if data.startswith(b"PK\x03\x04"):
        found = inspect_bytes(data, limits)
        locked = "E_ARCHIVE_ENCRYPTED" in found
        names = {"E_ARCHIVE_ENCRYPTED": "E_POLICY_ENCRYPTED", "E_MACRO": "E_POLICY_MACROS", "E_ARCHIVE_DAMAGED": None if locked else "E_POLICY_BROKEN"}
        return [code for c in found if (code := names.get(c, c))]
    if data.startswith(b"\xd0\xcf\x11\xe0"):
        return ["E_POLICY_ENCRYPTED"] * (OLE_ENCRYPTED in data) + ["E_POLICY_MACROS"] * any(m in data for m in OLE_MACROS)
    if data.startswith(b"%PDF-"):
        return ["E_POLICY_ENCRYPTED"] * (PDF_ENCRYPT in data) + ["E_POLICY_BROKEN"] * (PDF_END not in data[-2048:])
    return []


def apply_policy(files: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """(document_id, kind, codes) of every file; a null content is one that wasn't read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["document_id", "kind"]].assign(codes=[policy_codes(bytes(c), limits) if c is not None else ["E_LIMIT_SIZE"] for c in b["content"]])

    return files.select("document_id", input_policy(F.col("content")).alias("kind"), "content").mapInPandas(run, "document_id string, kind string, codes array<string>")


def inspect_bytes(data: bytes, limits: Limits = LIMITS, depth: int = 1, budget: list[int] | None = None) -> list[str]:
    """Codes against an archive; it is never unpacked to disk, and bytes are counted as they come, not as declared."""
    budget = [limits.unpacked_bytes] if budget is None else budget
    if depth > limits.nesting:
        return ["E_ARCHIVE_DEPTH"]
    try:
        box = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        return ["E_ARCHIVE_DAMAGED"]
    found = []
    for item in box.infolist():
        name = item.filename.replace("\\", "/")
        if name.startswith("/") or ".." in name.split("/") or ":" in name:
            found.append("E_ARCHIVE_TRAVERSAL")
        if item.external_attr >> 16 & 0o170000 == 0o120000:
            found.append("E_ARCHIVE_SYMLINK")
        if item.flag_bits & 1:
            found.append("E_ARCHIVE_ENCRYPTED")
            continue
        if name.lower().endswith("vbaproject.bin"):
            found.append("E_MACRO")
        size, head = 0, b""
        try:
            with box.open(item) as f:
                while piece := f.read(1 << 16):
                    size += len(piece)
                    budget[0] -= len(piece)
                    if budget[0] < 0 or size > limits.ratio * max(1, item.compress_size):
                        return [*found, "E_ARCHIVE_BOMB"]
                    head = head or piece[:4]
            if head == b"PK\x03\x04":
                found += inspect_bytes(box.read(item), limits, depth + 1, budget)
        except (zipfile.BadZipFile, RuntimeError, OSError, EOFError):
            found.append("E_ARCHIVE_DAMAGED")
    return list(dict.fromkeys(found))


def inspect_archives(files: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """(document_id, codes) of files that are archives."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"document_id": b["document_id"], "codes": [inspect_bytes(bytes(c), limits) for c in b["content"]]})

    return files.where(input_policy(F.col("content")) == "zip").select("document_id", "content").mapInPandas(run, "document_id string, codes array<string>")


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file to any path that Spark writes to: under a name of its own first, then in place at once."""
    jvm = spark._jvm.org.apache.hadoop.fs
    target, spare = jvm.Path(path), jvm.Path(f"{path}.{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(spare, True)
    out.write(bytearray(data))
    out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(spare, target):
        raise OSError(f"E_IO {path}")
