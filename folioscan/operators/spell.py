"""Spelling suggestions: words of a dictionary within an edit distance, found through shared signatures.

A longer word is cut into one more even segments than edits are allowed, so one of them stays whole: it stands in the
other word, shifted by no more than the edits. That is three signatures a term and 75 a query at two edits, however
long the words; all their text together is linear in the word. Short words have few deletion variants, and use them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_DISTANCE, SUGGESTIONS = 2, 5


def deletions(word: Column, most: int) -> Column:
    """word and every string that deleting up to `most` of its code points gives: two words within the distance share
    one, because each edit is undone by deleting at most one code point on either side."""

    def fewer(x: Column) -> Column:
        return F.when(F.char_length(x) > 0, F.transform(F.sequence(F.lit(1), F.char_length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.char_length(x))))).otherwise(F.array().cast("array<string>"))

    level, out = F.array(word), F.array(word)
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, fewer)))
        out = F.concat(out, level)
    return F.array_distinct(out)


#: Signatures of queries that are pushed into the scan as a filter.
PUSHED = 2000


def _segment(word: Column, length: Column, part: Column, parts: int, shift: Column | None = None) -> Column:
    """Hash of the part that a word of that length has there, as it stands in word, shifted; tagged with both."""
    start = F.floor(part * length / parts).cast("int")
    size = F.floor((part + 1) * length / parts).cast("int") - start
    at = start + 1 if shift is None else start + 1 + shift
    return F.when(at > 0, F.xxhash64(length, part, F.substring(word, at, size)))


def _short(word: Column, most: int) -> Column:
    return F.transform(deletions(word, most), lambda x: F.xxhash64(F.lit(-1), x))


def _of_term(word: Column, most: int) -> Column:
    n = F.char_length(word)
    parts = F.array(*(_segment(word, n, F.lit(i), most + 1) for i in range(most + 1)))
    return F.when(n > 2 * most, parts).otherwise(_short(F.substring(word, 1, 2 * most), most))


def _of_query(word: Column, most: int) -> Column:
    n = F.char_length(word)
    lengths = F.filter(F.transform(F.array(*(F.lit(d) for d in range(-most, most + 1))), lambda d: n + d), lambda m: m > 2 * most)
    parts = lambda m: F.array(*(_segment(word, m, F.lit(i), most + 1, F.lit(s)) for i in range(most + 1) for s in range(-most, most + 1)))
    long_ = F.filter(F.flatten(F.transform(lengths, parts)), lambda h: h.isNotNull())
    return F.concat(long_, F.when(n <= 3 * most, _short(F.substring(word, 1, 3 * most), most)).otherwise(F.array().cast("array<bigint>")))


def variants(terms: DataFrame, most: int = MOST_DISTANCE) -> DataFrame:
    """(term, freq, block): each term under the hash of each of its signatures. Publish it, laid out by block: a
    query then reads the blocks of its own signatures alone."""
    return terms.select("term", "freq", F.explode(F.array_distinct(_of_term(F.col("term"), most))).alias("block"))


def within_distance(queries: DataFrame, known: DataFrame, most: int = MOST_DISTANCE) -> DataFrame:
    """(query, term, freq, distance) with Levenshtein distance at most `most`, by an equality join on hashed
    signatures (known: `variants` of the terms), then exact distances. The signatures of a few queries become a filter
    that reaches the scan."""
    asked = queries.select("query").distinct().withColumn("block", F.explode(F.array_distinct(_of_query(F.col("query"), most))))
    blocks = [r.block for r in asked.select("block").distinct().limit(PUSHED + 1).collect()]
    if len(blocks) <= PUSHED:
        known = known.where(F.col("block").isin(blocks))
    close = F.abs(F.char_length("query") - F.char_length("term")) <= most
    pairs = asked.join(known, "block").where(close).select("query", "term", "freq").distinct()
    measured = F.filter(F.array(F.levenshtein("query", "term", most)), lambda d: d >= 0)  # once for each pair
    return pairs.select("query", "term", "freq", F.explode(measured).alias("distance"))


def suggest(queries: DataFrame, terms: DataFrame, most: int = MOST_DISTANCE, k: int = SUGGESTIONS) -> DataFrame:
    """(query, term, distance, freq, rank): the k nearest of terms (term, freq), frequent ones first, then by the word."""
    return nearest(queries, variants(terms.groupBy("term").agg(F.sum("freq").alias("freq")), most), most, k)


def nearest(queries: DataFrame, known: DataFrame, most: int = MOST_DISTANCE, k: int = SUGGESTIONS) -> DataFrame:
    """`suggest` from published variants of unique terms."""
    order = Window.partitionBy("query").orderBy("distance", F.desc("freq"), "term")
    return within_distance(queries, known, most).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
