"""Metadata of DICOM Part 10 files: read up to the pixel data, with one outcome for each file."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Tags read, transfer syntaxes, the value representations with a long length, and markers.
TAGS = {
    (0x0008, 0x0016): "sop_class_uid", (0x0008, 0x0018): "sop_instance_uid", (0x0020, 0x000D): "study_instance_uid", (0x0020, 0x000E): "series_instance_uid", (0x0010, 0x0020): "patient_id", (0x0010, 0x0010): "patient_name",
    (0x0010, 0x0021): "issuer", (0x0010, 0x0030): "birth_date", (0x0010, 0x0040): "sex", (0x0008, 0x0060): "modality", (0x0008, 0x0020): "study_date", (0x0008, 0x0050): "accession_number", (0x0008, 0x1030): "study_description",
    (0x0020, 0x0011): "series_number", (0x0020, 0x0013): "instance_number",
}
IMPLICIT, EXPLICIT, EXPLICIT_FAMILIES = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1", ("1.2.840.10008.1.2.4", "1.2.840.10008.1.2.5")
LONG = {b"OB", b"OW", b"OF", b"OD", b"OL", b"SQ", b"UC", b"UR", b"UT", b"UN", b"SV", b"UV"}
#: Bytes of a file that are read at once; files in a task.
BLOCK, FILES = 4096, 256
PIXELS, ITEM, ITEM_END, SEQUENCE_END, UNDEFINED = (0x7FE0, 0x0010), (0xFFFE, 0xE000), (0xFFFE, 0xE00D), (0xFFFE, 0xE0DD), 0xFFFFFFFF
NUMBERS = ("series_number", "instance_number")
STRINGS = ["transfer_syntax_uid", *(n for n in TAGS.values() if n not in NUMBERS)]
SCHEMA = "struct<outcome:string," + ",".join(f"{n}:string" for n in STRINGS) + ",series_number:int,instance_number:int>"


class Short(Exception):
    """The data ends within an element."""


class Ranges:
    """Bytes of an open file, read in blocks as they are asked for; `fetched` says how many were."""

    def __init__(self, file, size: int, block: int = BLOCK):
        self.file, self.size, self.block = file, size, block
        self.held, self.first, self.fetched = b"", 0, 0

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        start, stop = part.start or 0, min(part.stop, self.size)
        if start < self.first or stop > self.first + len(self.held):
            self.file.seek(start)
            self.held, self.first = self.file.read(max(stop - start, self.block)), start
            self.fetched += len(self.held)
        return self.held[start - self.first : stop - self.first]


class Reader:
    """Elements in order, of bytes or of a file's ranges."""

    def __init__(self, data: bytes | Ranges, at: int = 0):
        self.data, self.at = data, at

    def skip_bytes(self, n: int) -> None:
        if n > len(self.data) - self.at:
            raise Short
        self.at += n

    def take(self, n: int) -> bytes:
        self.skip_bytes(n)
        return self.data[self.at - n : self.at]

    def tag(self) -> tuple[int, int]:
        return struct.unpack("<HH", self.take(4))

    def length(self, explicit: bool, tag: tuple[int, int]) -> int:
        if explicit and tag[0] != 0xFFFE:
            if self.take(2) not in LONG:
                return struct.unpack("<H", self.take(2))[0]
            self.take(2)
        return struct.unpack("<I", self.take(4))[0]

    def skip(self, explicit: bool, end: tuple[int, int]) -> None:
        """Past the marker that closes an undefined length; what is nested is skipped the same way."""
        open_ = [end]
        while open_:
            tag = self.tag()
            n = self.length(explicit, tag)
            if tag == open_[-1]:
                open_.pop()
            elif n == UNDEFINED:
                open_.append(ITEM_END if tag == ITEM else SEQUENCE_END)
            elif tag != ITEM:  # the elements of an item of known length are walked like any other
                self.skip_bytes(n)


def _text(value: bytes) -> str:
    return value.decode("utf-8", "replace").rstrip("\0 ")


def _number(value: bytes) -> int:
    digits = _text(value).strip()
    sign, rest = (digits[0], digits[1:]) if digits[:1] in ("+", "-") else ("", digits)
    rest = rest[: next((i for i, c in enumerate(rest) if not c.isdigit()), len(rest))]
    return -1 if not digits else int(sign + (rest or "0"))


def read_metadata(data: bytes | Ranges) -> dict:
    """outcome (OK, NOT_DICOM, BAD_FORMAT, UNSUPPORTED_TS, TRUNCATED, MISSING_REQUIRED) and the fields; numbers that
    lack are -1. Reading stops at the pixel data, so a cut within it is not seen."""
    out: dict = dict.fromkeys(STRINGS, "") | dict.fromkeys(NUMBERS, -1)
    if len(data) < 132 or data[128:132] != b"DICM":
        return out | {"outcome": "NOT_DICOM"}
    r = Reader(data, 132)
    try:
        while r.at < len(data) and data[r.at : r.at + 2] == b"\x02\x00":
            tag = r.tag()
            value = r.take(r.length(True, tag))
            if tag == (0x0002, 0x0010):
                out["transfer_syntax_uid"] = _text(value)
    except Short:
        return out | {"outcome": "TRUNCATED"}
    syntax = out["transfer_syntax_uid"]
    if not syntax:
        return out | {"outcome": "BAD_FORMAT"}
    explicit = syntax == EXPLICIT or syntax.startswith(EXPLICIT_FAMILIES)
    if not explicit and syntax != IMPLICIT:
        return out | {"outcome": "UNSUPPORTED_TS"}
    try:
        while r.at < len(data):
            tag = r.tag()
            if tag == PIXELS:
                break
            n = r.length(explicit, tag)
            if n == UNDEFINED:
                r.skip(explicit, SEQUENCE_END)
                continue
            name = TAGS.get(tag)
            if not name:
                r.skip_bytes(n)
                continue
            value = r.take(n)
            out[name] = _number(value) if name in NUMBERS else _text(value)
    except Short:
        return out | {"outcome": "TRUNCATED"}
    needed = ("sop_instance_uid", "study_instance_uid", "series_instance_uid", "patient_id")
    return out | {"outcome": "OK" if all(out[n] for n in needed) else "MISSING_REQUIRED"}


def metadata(content: Column) -> Column:
    """A struct of outcome and fields for binary content, over Arrow batches."""

    @F.pandas_udf(SCHEMA)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([read_metadata(bytes(x or b"")) for x in part], columns=["outcome", *STRINGS, *NUMBERS])

    return run(content)


class ImageFiles(DataSource):
    """The files of a folder (option path) by ranges: headers up to the pixel data; with option digest also SHA-256, for
    which a file is read through once, a piece at a time. Pyarrow opens the files in the tasks."""

    @classmethod
    def name(cls) -> str:
        return "image_files"

    def schema(self) -> str:
        return f"path string, file_size long, bytes_read long, sha256 string, meta {SCHEMA}"

    def reader(self, schema) -> "ImageReader":
        return ImageReader(self.options)


class ImageReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.digest, self.most = options["path"], options.get("digest") == "true", int(options.get("most_bytes", "-1"))

    def partitions(self) -> list[InputPartition]:
        """Files by name, so many to a task; hidden ones are left out."""
        fs, at = opened(self.folder)
        found = sorted((f.path, f.size) for f in fs.get_file_info(pyarrow.fs.FileSelector(at)) if f.is_file and not f.base_name.startswith(("_", ".")) and (self.most < 0 or f.size <= self.most))
        return [InputPartition(found[k : k + FILES]) for k in range(0, len(found), FILES)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fs, _ = opened(self.folder)
        scheme = self.folder.split(":", 1)[0] + ":" if ":" in self.folder else "file:"
        for path, size in partition.value:
            with fs.open_input_file(path) as file:
                ranges = Ranges(file, size)
                meta, sha = read_metadata(ranges), None
                if self.digest:
                    sha = hashlib.sha256()
                    file.seek(0)
                    while piece := file.read(1 << 20):
                        sha.update(piece)
                    ranges.fetched += size
                yield scheme + path, size, ranges.fetched, sha and sha.hexdigest(), tuple(meta[c] for c in ("outcome", *STRINGS, *NUMBERS))


def opened(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """A file system and the path in it, of a URI or a local path."""
    if ":" not in folder:
        return pyarrow.fs.LocalFileSystem(), folder
    return pyarrow.fs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)


def read_ranges(spark: SparkSession, folder: str, digest: bool = False, most_bytes: int | None = None) -> DataFrame:
    """(path, file_size, bytes_read, sha256, meta) of the files of a folder, read by ranges: without digest the pixel
    data is never read, and sha256 is null."""
    spark.dataSource.register(ImageFiles)
    options = {"path": folder, "digest": str(digest).lower()} | ({} if most_bytes is None else {"most_bytes": str(most_bytes)})
    return spark.read.format("image_files").options(**options).load()


def read_images(spark: SparkSession, folder: str, most_bytes: int | None = None) -> DataFrame:
    """(path, file_size, sha256, meta) of the files of a folder; files over most_bytes are left out if it is given. A
    folder that only Spark's own file systems open is read as whole files, others by ranges."""
    try:
        opened(folder)
    except (pyarrow.ArrowInvalid, pyarrow.ArrowNotImplementedError):  # a scheme that pyarrow does not know
        files = spark.read.format("binaryFile").load(folder)
        if most_bytes is not None:
            files = files.where(F.col("length") <= most_bytes)
        return files.select("path", F.col("length").alias("file_size"), F.sha2("content", 256).alias("sha256"), metadata(F.col("content")).alias("meta"))
    return read_ranges(spark, folder, digest=True, most_bytes=most_bytes).select("path", "file_size", "sha256", "meta")
