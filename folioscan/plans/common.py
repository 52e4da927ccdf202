"""Reading tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_limits(spark: SparkSession) -> None:
    """Arrow batches by bytes as well as rows, so that a run of long documents stays small in a worker. The setting has
    to hold when the plan runs, so it stays in the session; a smaller one that was set in bytes is kept."""
    name, most = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
    own = spark.conf.get(name).lower().rstrip("b")
    if not (own.isdigit() and 0 < int(own) <= most):
        spark.conf.set(name, str(most))


def scratch(spark: SparkSession) -> str:
    """A new folder name where the driver and all executors can write: under spark.checkpoint.dir; a temporary one only
    in a local session that has none."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    return f"{base}/folioscan-{uuid.uuid4().hex}"


def stored(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df as a table of the shared folder: made once, however often it is read."""
    folder = scratch(spark)
    df.write.parquet(folder)
    return spark.read.parquet(folder)


def write_files(spark: SparkSession, folder: str, files: dict[str, bytes]) -> None:
    """A few small files, from the driver."""
    conf, path = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name, data in files.items():
        at = path(f"{folder}/{name}")
        out = at.getFileSystem(conf).create(at)
        out.write(bytearray(data))
        out.close()


def fingerprint(spark: SparkSession, path: str) -> tuple:
    """Size and time of a file, or of the files of a folder: another one when the data changes."""
    conf, at = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(at)))
