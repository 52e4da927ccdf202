"""SQL over a CSV or JSON object, as object stores offer it: the scan prunes and filters where the format allows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Options of the formats.
CSV = {"header": "true", "inferSchema": "true", "mode": "PERMISSIVE"}


def select(spark: SparkSession, path: str, sql: str, format: str = "csv", schema: str | None = None, **options: str) -> DataFrame:
    """Rows of sql, in which {source} stands for the object."""
    reader = spark.read.options(**((CSV if format == "csv" else {}) | options))
    df = (reader.schema(schema) if schema else reader).format(format).load(path)
    return spark.sql(sql, source=df)
