"""Files of words: dictionaries, user dictionaries, stop words, inverse document frequencies, hidden-Markov models."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.operators.segment import Dictionary, Hmm, read_dictionary


def _lines(spark: SparkSession, paths: str) -> list[str]:
    """Lines of one or several files, split by | or ;. Dictionaries fit on the driver: they are shipped with the function."""
    return [r.value for p in re.split("[|;]", paths) if p for r in spark.read.text(p).collect()]


def load_dictionary(spark: SparkSession, words: str, user: str = "", policy: str = "median", hmm: str = "") -> Dictionary:
    return read_dictionary(_lines(spark, words), _lines(spark, user), policy, read_hmm(_lines(spark, hmm)) if hmm else None)


def stop_words(spark: SparkSession, path: str) -> list[str]:
    return sorted({w for line in _lines(spark, path) if (w := line.strip())})


def read_hmm(lines: Iterable[str]) -> Hmm:
    """Start, four rows of transitions, then four lines of character:log-probability pairs, comma-joined; # is a comment."""
    rows = [x for x in (line.strip() for line in lines) if x and not x.startswith("#")]
    numbers = [[float(v) for v in r.split()] for r in rows[:5]]
    emit = [{c: float(p) for c, p in (pair.rsplit(":", 1) for pair in r.split(",") if pair)} for r in rows[5:9]]
    if len(emit) != 4 or any(len(n) != 4 for n in numbers):
        raise ValueError("not a model of four states")
    return Hmm(numbers[0], numbers[1:], emit)


def idf_table(spark: SparkSession, path: str) -> tuple[DataFrame, float]:
    """(term, idf) of lines with two fields, and the default for other terms: their sum over the number of all lines."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select(parts.alias("p"))
    whole = (F.size("p") == 2) & F.try_element_at("p", F.lit(2)).try_cast("double").isNotNull()
    known = lines.where(whole).select(F.element_at("p", 1).alias("term"), F.element_at("p", 2).cast("double").alias("idf"))
    total, n = lines.agg(F.sum(F.when(whole, F.try_element_at("p", F.lit(2)).try_cast("double"))), F.count("*")).first()
    return known, (total or 0.0) / max(n, 1)
