"""Versioned index tables: immutable folders v1, v2, ...; a version is published by its marker, written last.

A version's number is taken by creating a file that must not be there, so of two writers at once each gets its own.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

MARKER, OWNER = "_published", "_taken"


def _files(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return jvm, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, folder: str, published: bool = True) -> list[int]:
    """Version numbers, by listing; those without a marker only if asked for."""
    jvm, fs, path = _files(spark, folder)
    if not fs.exists(path):
        return []
    names = [(s.getPath(), s.getPath().getName()) for s in fs.listStatus(path)]
    found = [(p, int(n[1:])) for p, n in names if n[:1] == "v" and n[1:].isdigit()]
    return sorted(n for p, n in found if not published or fs.exists(jvm.org.apache.hadoop.fs.Path(p, MARKER)))


def _taken(spark: SparkSession, file: str, content: bytes = b"") -> bool:
    """Whether this call created the file. The check and the creation are one step: of the local file system by Java's
    createFile, elsewhere by create without overwriting, which HDFS and stores with conditional writes keep."""
    jvm, fs, path = _files(spark, file)
    try:
        fs.mkdirs(path.getParent())
        if path.toUri().getScheme() in (None, "file"):
            jvm.java.nio.file.Files.write(jvm.java.nio.file.Files.createFile(jvm.java.io.File(path.toUri().getPath()).toPath(), spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0)), bytearray(content), spark.sparkContext._gateway.new_array(jvm.java.nio.file.OpenOption, 0))
        else:
            out = fs.create(path, False)
            out.write(bytearray(content))
            out.close()
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def publish(spark: SparkSession, folder: str, tables: dict[str, DataFrame], partitions: int | None = None, token: str = "", dealt: bool = False) -> int:
    """Writes tables as the next version and returns it. Postings are laid out by term, spelling variants by block, so
    that a query reads few files; what is dealt by term already is sorted only, and a query reads few pages of its files.
    The marker holds the token, which says what the version was made of."""
    version = max(versions(spark, folder, published=False), default=0) + 1
    while not _taken(spark, f"{folder}/v{version}/{OWNER}"):
        version += 1
    for name, df in tables.items():
        key = next((c for c in ("block", "term") if c in df.columns), None)
        if key:
            if not dealt:
                df = df.repartitionByRange(partitions, key) if partitions else df.repartitionByRange(key)
            df = df.sortWithinPartitions(*(c for c in (key, "part") if c in df.columns))
        df.write.parquet(f"{folder}/v{version}/{name}")
    if not _taken(spark, f"{folder}/v{version}/{MARKER}", token.encode()):
        raise FileExistsError(f"version {version} in {folder} was published by another writer")
    return version


def token(spark: SparkSession, folder: str, version: int) -> str:
    """What a published version's marker holds."""
    jvm, fs, path = _files(spark, f"{folder}/v{version}/{MARKER}")
    file = fs.open(path)
    try:
        return bytes(file.readAllBytes()).decode()
    finally:
        file.close()


def published_as(spark: SparkSession, folder: str, name: str) -> tuple[int, int] | None:
    """(version, number) of the newest version that was published with a token `name:number`."""
    for version in reversed(versions(spark, folder)):
        who, _, number = token(spark, folder, version).rpartition(":")
        if who == name:
            return version, int(number)
    return None


def load(spark: SparkSession, folder: str, name: str, version: int | None = None) -> DataFrame:
    """A table of the latest published version, as found at the time of the call."""
    known = versions(spark, folder)
    if not known:
        raise FileNotFoundError(f"no published version in {folder}")
    return spark.read.parquet(f"{folder}/v{version or known[-1]}/{name}")


def escaped(text: str) -> str:
    """For tab-separated files."""
    return text.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n")


def unescaped(text: str) -> str:
    out, it = [], iter(text)
    for c in it:
        n = next(it, "") if c == "\\" else c
        out.append({"t": "\t", "n": "\n"}.get(n, n) if c == "\\" else c)
    return "".join(out)
