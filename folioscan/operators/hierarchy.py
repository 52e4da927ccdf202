"""The four-level hierarchy: upserts with the archive's rules, listings with child counts, validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows of a page that may be broadcast.
PAGE_ROWS = 100_000


def upsert(existing: DataFrame | None, arrivals: DataFrame, keys: Sequence[str], order: Sequence[str], refreshed: Sequence[str]) -> DataFrame:
    """One row for each key: columns of its first arrival, but those in `refreshed` of the last (null included).

    Rows that exist come before all arrivals. Both choices combine on the map side.
    """
    columns = [c for c in arrivals.columns if c not in order]
    rows = arrivals.withColumn("_old", F.lit(1))
    if existing is not None:
        blank = [F.lit(None).cast(arrivals.schema[c].dataType).alias(c) for c in order if c not in existing.columns]
        rows = rows.unionByName(existing.select("*", *blank, F.lit(0).alias("_old")), allowMissingColumns=True)
    rank = F.struct("_old", *order)
    kept = [c for c in columns if c not in keys]
    chosen = [F.min_by(F.struct(F.col(c)), rank).alias(c) if c not in refreshed else F.max_by(F.struct(F.col(c)), rank).alias(c) for c in kept]
    return rows.groupBy(*keys).agg(*chosen).select(*keys, *(F.col(f"{c}.{c}").alias(c) for c in kept))


def upsert_patients(existing: DataFrame | None, arrivals: DataFrame, order: Sequence[str]) -> DataFrame:
    return upsert(existing, arrivals, ["patient_id", "issuer"], order, ["patient_name"])


def upsert_studies(existing: DataFrame | None, arrivals: DataFrame, order: Sequence[str]) -> DataFrame:
    return upsert(existing, arrivals, ["study_instance_uid"], order, ["study_date"])


def upsert_series(existing: DataFrame | None, arrivals: DataFrame, order: Sequence[str]) -> DataFrame:
    return upsert(existing, arrivals, ["series_instance_uid"], order, [])


def point_lookup(df: DataFrame, key: str, value, columns: Sequence[str]) -> DataFrame:
    """The row of one key, or none."""
    return df.where(F.col(key) == F.lit(value)).select(*columns)


def looked_up(requests: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """requests with the columns of the row that known has for their key; null where it has none."""
    return requests.join(known.withColumnRenamed(key, "_key"), F.col(key) == F.col("_key"), "left").drop("_key")


def with_child_count(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, name: str, page: bool = False) -> DataFrame:
    """parents with the number of their children, 0 when none: children are counted before they are joined. If parents
    are a page of a listing, only their children are counted: the page's keys filter the scan of the children."""
    if page:
        of = parents.select(F.col(parent_key).alias("_of"))
        children = children.join(F.broadcast(of) if of.limit(PAGE_ROWS + 1).count() <= PAGE_ROWS else of, F.col(child_key) == F.col("_of"), "left_semi")
    counted = children.groupBy(F.col(child_key).alias("_key")).agg(F.count("*").alias("_n"))
    return parents.join(counted, F.col(parent_key) == F.col("_key"), "left").withColumn(name, F.coalesce("_n", F.lit(0))).drop("_key", "_n")


def list_top(df: DataFrame, order: Sequence[Column], most: int) -> DataFrame:
    """A page of a listing: limit is part of what is asked for."""
    return df.orderBy(*order).limit(most)


def filtered(df: DataFrame, first: tuple[str, object], second: tuple[str, object]) -> DataFrame:
    """Both conditions if their values are given; the second only counts beside the first."""
    if first[1]:
        df = df.where(F.col(first[0]) == F.lit(first[1]))
        if second[1]:
            df = df.where(F.col(second[0]) == F.lit(second[1]))
    return df


def violations(df: DataFrame, key: str, allowed: Mapping[str, Sequence[str]], nullable: Sequence[str] = ()) -> DataFrame:
    """(key, column, value) where a value is not among the allowed ones."""
    checks = [F.when(~F.coalesce(F.col(c).isin(*values), F.lit(c in nullable)), F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))) for c, values in allowed.items()]
    return df.select(key, F.explode(F.array_compact(F.array(*checks))).alias("x")).select(key, "x.*")


#: What each role may do; * is everything.
POLICY = (("admin", "*"), ("radiologist", "images:import"), ("radiologist", "studies:read"))


def allowed(requests: DataFrame) -> DataFrame:
    """requests (role, action) with whether the role may."""
    grants: dict[str, list[str]] = {}
    for role, action in POLICY:
        grants.setdefault(role, []).append(action)
    may = F.lit(False)
    for role, actions in grants.items():
        may = may | ((F.col("role") == role) & (F.lit("*" in actions) | F.col("action").isin(*actions)))
    return requests.withColumn("allowed", F.coalesce(may, F.lit(False)))
