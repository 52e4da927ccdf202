"""What the corpus operators share: reading documents, Arrow text as numpy bytes, checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.plans.common import arrow_limits as arrow_limits

#: Bytes of text that one numpy step works on; a longer document is a step of its own.
STEP_BYTES = 1 << 21
#: Rows of a few numbers that may be broadcast (some 50 MB); more are joined by a shuffle.
BROADCAST_ROWS = 500_000
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that no other column of the input can clash; null texts are empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def text_key(text: Column) -> list[Column]:
    """k1, k2: 128 bits that stand for a text, so that rows are told apart whatever their doc_id is, null included."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(whole).alias("k1"), F.xxhash64(F.lit(1), whole).alias("k2")]


def keyed(docs: DataFrame) -> DataFrame:
    """texts of docs with their keys: doc_id, text, k1, k2."""
    rows = texts(docs)
    return rows.select("doc_id", "text", *text_key(F.col("text")))


def unused(docs: DataFrame, *names: str) -> list[str]:
    """Column names like these that docs does not have, in any case of letters."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The session's folder below spark.checkpoint.dir. Where that is not set, a local session (as in tests) gets a
    temporary one; a cluster has no folder that could be guessed, so there it is an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", "")
        if not where and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="folioscan-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame) -> DataFrame:
    """df with its lineage cut and its partitions kept, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: smaller than a checkpoint, and what the planner knows of df (its
    constraints, which grow from round to round) is left behind; partitions and order are not kept."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes the files of a frame that `saved` or `stored` made and that nothing will read again."""
    where = getattr(df, "stored_at", None)
    if where is None:
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        where = file.get() if file.isDefined() else None
    if where:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, most: int = BROADCAST_ROWS, size: Column | None = None) -> DataFrame:
    """df, marked for broadcast if it has no more rows than that; of rows that hold lists, size says what each counts."""
    n = df.limit(most + 1).count() if size is None else df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if n <= most else df


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once."""
    return F.transform(F.array(value), then)[0]


def matched(rows: DataFrame, keys: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """rows joined with keys, whose long columns `names` are unique. Both sides are dealt by the keys' complements, not
    by what either was dealt by before, because Spark splits a key with very many rows only right after such a deal."""
    own = {n: f"_not_{n}" for n in names}
    keys = keys.select(*(F.bitwise_not(n).alias(own[n]) for n in names), *(c for c in keys.columns if c not in names))
    same = F.lit(True)
    for n in names:
        same = same & (F.bitwise_not(rows[n]) == keys[own[n]])
    return rows.join(keys, same, how).drop(*own.values())


def steps(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, UTF-8 bytes of column, offsets from 0 to the byte count) of at most `most` bytes, or of one row. Nulls are empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        array = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
        if array.null_count:
            array = pa.array([x or b"" for x in array.to_pylist()], pa.large_binary())
        _, offsets, data = array.buffers()
        offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        first = 0
        while first < len(array):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
            yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of flags between offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values(seed: int) -> np.ndarray:
    """A random odd 64-bit value for each byte."""
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def window_hash(data: np.ndarray, width_log2: int, values: np.ndarray) -> np.ndarray:
    """Hash of data[i : i + 2 ** width_log2] for every i that has as many bytes, by doubling."""
    out, factor = values[data], np.uint64(0x9E3779B97F4A7C15)
    for k in range(width_log2):
        half = 1 << k
        if len(out) <= half:
            return out[:0]
        out = out[:-half] * factor + out[half:]
        with np.errstate(over="ignore"):
            factor = factor * factor
    return out


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each row and in all) of the words `[^\\x20\\x09-\\x0D]+`."""
    word = ~ASCII_SPACE[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] = word[inner]
    ends[inner - 1] = word[inner - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


_POWERS: dict[str, np.ndarray] = {}


def span_hash(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hash of each data[start:stop], from prefix sums of a polynomial modulo 2 ** 64, then mixed with the length."""
    base = 0x9E3779B97F4A7C15
    n = max(1 << 16, 1 << int(len(data)).bit_length())
    if len(_POWERS.get("up", ())) < n:
        with np.errstate(over="ignore"):
            for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
                x = np.full(n, b, np.uint64)
                x[0] = 1
                _POWERS[name] = np.multiply.accumulate(x)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * _POWERS["up"][: len(data)], out=total[1:])
    return mixed((total[stops] - total[starts]) * _POWERS["down"][starts] + mixed((stops - starts).astype(np.uint64)))
