"""Exact duplicates and the weighted 64-bit simhash of terms."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions.hashing import jenkins64_column
from folioscan.functions.text import hamming

#: Bits, the greatest distance of a pair, and keys of a fingerprint at most.
BITS, MOST_BITS, MOST_KEYS = 64, 3, 84


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first by `order`. min_by combines on the map side, so a hot key does no harm."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest)).select(*df.columns)


def md5_hash(term: Column) -> Column:
    """The first 64 bits of MD5 as a long."""
    return F.conv(F.substring(F.md5(term.cast("binary")), 1, 16), 16, -10).cast("long")


def simhash(terms: DataFrame, id: str = "doc_id", term: str = "term", weight: str = "tf", hashed: Callable[[Column], Column] = md5_hash) -> DataFrame:
    """(id, fp): bit j is set if the weights of terms with it exceed those without. One aggregation, 64 sums a row; a
    term of an id may come in several rows, whose weights add."""
    votes = [F.sum(F.when(F.getbit("h", F.lit(j)) == 1, F.col(weight)).otherwise(-F.col(weight))).alias(f"b{j}") for j in range(BITS)]
    summed = terms.select(id, weight, hashed(F.col(term)).alias("h")).groupBy(id).agg(*votes)
    one = lambda j: F.lit((1 << j) - ((1 << BITS) if j == BITS - 1 else 0)).cast("long")
    fp = F.lit(0).cast("long")
    for j in range(BITS):
        fp = fp.bitwiseOR(F.when(F.col(f"b{j}") > 0, one(j)).otherwise(F.lit(0).cast("long")))
    return summed.select(id, fp.alias("fp"))


def simhash_jenkins(terms: DataFrame, id: str = "doc_id", term: str = "term", weight: str = "tf") -> DataFrame:
    """simhash with the Jenkins hash, where the terms stand."""
    return simhash(terms, id, term, weight, jenkins64_column)


def _masks(blocks: int, most: int) -> list[int]:
    """64-bit masks of all choices of blocks - most blocks."""
    edges = [k * BITS // blocks for k in range(blocks + 1)]
    own = [((1 << hi) - (1 << lo)) for lo, hi in itertools.pairwise(edges)]
    return [sum(x) for x in itertools.combinations(own, blocks - most)]


def blocks_for(fingerprints: int, most: int = MOST_BITS) -> int:
    """Blocks to cut fingerprints into: as many as it takes that a key's bits tell so many fingerprints apart. With one
    more than `most` a key is one block; each block more makes keys longer, and more of them (4, 10, 20, 35, ...)."""
    for blocks in range(most + 1, BITS):
        if fingerprints <= 1 << min(m.bit_count() for m in _masks(blocks, most)) or len(_masks(blocks + 1, most)) > MOST_KEYS:
            return blocks
    return BITS


def near_pairs(fps: DataFrame, most: int = MOST_BITS, id: str = "doc_id", blocks: int | None = None) -> DataFrame:
    """(a, b, distance) over representatives of equal fingerprints, a < b, that differ in at most `most` bits.

    The representative of a fingerprint is its smallest id, so copies never make pairs. Fingerprints are cut into
    blocks; two within the distance agree in all but `most` of them, so in the bits of one choice of that many blocks.
    Choices grow with the number of fingerprints, so that those that meet do not grow with its square. A pair is kept
    where it meets first.
    """
    own = fps.groupBy("fp").agg(F.min(id).alias("id"))
    if blocks is None:
        blocks = blocks_for(own.count(), most)
    masks = F.array(*(F.lit(m - (1 << BITS) if m >> BITS - 1 else m).cast("long") for m in _masks(blocks, most)))
    keyed = own.select("id", "fp", F.posexplode(F.transform(masks, lambda m: F.col("fp").bitwiseAND(m))).alias("choice", "value"))
    left, right = keyed.withColumnsRenamed({"id": "a", "fp": "fa"}), keyed.withColumnsRenamed({"id": "b", "fp": "fb"})
    close = hamming(F.col("fa"), F.col("fb"))
    met = left.join(right, ["choice", "value"]).where((F.col("a") < F.col("b")) & (close <= most))
    first = F.array_position(F.transform(masks, lambda m: F.col("fa").bitwiseXOR(F.col("fb")).bitwiseAND(m) == 0), True) - 1
    return met.where(first == F.col("choice")).select("a", "b", close.cast("int").alias("distance"))


def classes(fps: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, representative): the smallest id of the same fingerprint."""
    own = fps.groupBy("fp").agg(F.min(id).alias("representative"))
    return fps.join(own, "fp").select(id, "representative")


def unique_adjacent(df: DataFrame, partition: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the row before, in order, within a partition."""
    from pyspark.sql import Window

    before = F.lag(value).over(Window.partitionBy(*partition).orderBy(*order))
    number = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    return df.withColumn("_before", before).withColumn("_n", number).where((F.col("_n") == 1) | ~F.col(value).eqNullSafe(F.col("_before"))).drop("_before", "_n")
