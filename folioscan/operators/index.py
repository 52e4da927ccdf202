"""The inverted index: term frequencies, document frequencies and normalised weights, and ranked search over them."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscan.functions.text import let, tokens

#: Rows of a query side that may be broadcast; a larger batch of queries is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Most frequent terms that are broadcast with their document frequencies; rarer ones are joined by a shuffle.
COMMON_TERMS = 500_000
#: Query terms that are pushed into the scan as a filter.
PUSHED_TERMS = 500
#: Rows of one id whose texts meet in one task.
HOT_ROWS = 1000
#: Scores (pairs of query and document) that a task sums, on average: they stay in memory, however many documents there
#: are and however few partitions the session asks for.
TASK_SCORES = 1_000_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has no more rows than that."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def tasks_for(spark: SparkSession, things: int, most: int) -> int:
    """Partitions that hold no more than `most` things each on average, and no fewer than there are cores."""
    return max(spark.sparkContext.defaultParallelism, -(-things // most))


#: A column of text to a column of its words: `tokens` by default, or segmentation by a dictionary.
Words = Callable[[Column], Column]


def _words(text: Column, stop_words: Sequence[str], words: Words | None) -> Column:
    if words is None:
        return tokens(text, stop_words)
    return F.filter(words(text), lambda t: (F.octet_length(t) > 1) & ~t.isin(*stop_words)) if stop_words else F.filter(words(text), lambda t: F.octet_length(t) > 1)


def row_frequencies(docs: DataFrame, field: str, weight: int = 1, id: str = "doc_id", stop_words: Sequence[str] = (), words: Words | None = None) -> DataFrame:
    """(id, term, tf) of each row, without a shuffle: rows that share an id may each have a row of a term."""
    found = docs.select(F.col(id), F.explode(occurrences(_words(F.col(field), stop_words, words))).alias("x"))
    return found.select(id, "x.term", (F.col("x.n") * weight).cast("long").alias("tf"))


def term_frequencies(docs: DataFrame, fields: Mapping[str, int], id: str = "doc_id", stop_words: Sequence[str] = (), words: Words | None = None, most: int = BROADCAST_ROWS, hot: int = HOT_ROWS) -> DataFrame:
    """(id, term, tf): occurrences of each term, each weighted by its field's weight. Terms are what `words` makes of the
    text, without those of a single byte and stop words. A single field is counted within its row, without a shuffle.
    Rows that share an id are counted together: their texts are dealt by id, not their terms, which take several times
    the space. Terms are dealt for ids of more than `hot` rows only, whose texts one task would get."""
    if len(fields) == 1:
        ((field, weight),) = fields.items()
        counted = lambda docs: row_frequencies(docs, field, weight, id, stop_words, words)
        merged = lambda tf: tf.groupBy(id, "term").agg(F.sum("tf").alias("tf"))
        twice = docs.groupBy(F.col(id).alias("_of")).agg(F.count("*").alias("_n")).where("_n > 1")
        if twice.isEmpty():
            return counted(docs)
        docs, same = docs.select(id, field), F.col(id).eqNullSafe(F.col("_of"))
        those = lambda df, ids, how: df.join(F.broadcast(ids.select("_of")), same, how)
        parts, shared = [], docs
        if twice.limit(most + 1).count() <= most:
            parts, shared = [counted(those(docs, twice, "left_anti"))], those(docs, twice, "left_semi")
        crowded = twice.where(F.col("_n") > hot)
        if not crowded.isEmpty():
            parts, shared = [*parts, merged(counted(those(shared, crowded, "left_semi")))], those(shared, crowded, "left_anti")
        return functools.reduce(DataFrame.unionByName, [merged(counted(shared.repartition(id))), *parts])
    parts = [F.transform(_words(F.col(c), stop_words, words), lambda t: F.struct(t.alias("term"))) for c in fields]
    weighed = [F.transform(p, _weighed(w)) for p, w in zip(parts, fields.values())]
    words = docs.select(F.col(id), F.explode(F.concat(*weighed)).alias("x")).select(id, "x.term", "x.w")
    return words.groupBy(id, "term").agg(F.sum("w").cast("long").alias("tf"))


def occurrences(words: Column) -> Column:
    """Array of (term, n): the distinct words of an array and how often each stands there, by runs of the sorted array."""

    def runs(x: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (F.get(x, i) != F.get(x, i - 1)))
        return let(starts, lambda s: F.transform(s, lambda at, k: F.struct(F.get(x, at).alias("term"), (F.coalesce(F.get(s, k + 1), F.size(x)) - at).alias("n"))))

    return let(F.sort_array(words), lambda x: F.when(F.size(x) > 0, runs(x)))


def _weighed(weight: int):
    return lambda x: F.struct(x["term"].alias("term"), F.lit(weight).alias("w"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    """(term, df): documents that hold the term."""
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def idf(df: Column, documents: int) -> Column:
    """ln(N / df), without smoothing: a term of every document weighs nothing."""
    return F.ln(F.lit(float(documents)) / df)


def looked_up(tf: DataFrame, terms: DataFrame, most: int = COMMON_TERMS) -> DataFrame:
    """tf with the columns of terms (term, df, ...), null where it lacks a term. The most frequent terms, up to so many,
    have nearly all postings and are broadcast, so that only postings of the others are shuffled. Both are read more than
    once: best they are stored."""
    if terms.limit(most + 1).count() <= most:
        return tf.join(F.broadcast(terms), "term", "left")
    held, least = 0, 1
    for bits, n in sorted(terms.groupBy(F.length(F.bin("df")).alias("bits")).count().collect(), reverse=True):  # 64 rows at most
        if (held := held + n) > most:
            least = 1 << bits
            break
    common = F.broadcast(terms.where(F.col("df") >= least).withColumn("_common", F.lit(True)))
    rest = tf.join(common.select("term"), "term", "left_anti").join(terms.where(F.col("df") < least), "term", "left")
    return tf.join(common, "term").drop("_common").unionByName(rest)


def postings(tf: DataFrame, documents: int, id: str = "doc_id") -> DataFrame:
    """(id, term, tf, df, weight): weight = tf * idf."""
    return tf.join(document_frequencies(tf), "term").withColumn("weight", F.col("tf") * idf(F.col("df"), documents)).select(id, "term", "tf", "df", "weight")


def normalised(weights: DataFrame, id: str = "doc_id") -> DataFrame:
    """postings with weight divided by the document's norm; 0 where the norm is 0."""
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(id)))
    return weights.withColumn("norm", norm).withColumn("weight", F.when(F.col("norm") > 0, F.col("weight") / F.col("norm")).otherwise(0.0)).drop("norm")


def norms(weights: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, terms, norm): the number of each document's terms and the norm of its weights; and the segment of its postings,
    if they name one."""
    of = [F.max("segment").alias("segment")] if "segment" in weights.columns else []
    return weights.groupBy(id).agg(F.count("*").alias("terms"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"), *of)


def build(docs: DataFrame, fields: Mapping[str, int], id: str = "doc_id", stop_words: Sequence[str] = (), words: Words | None = None) -> DataFrame:
    """Normalised postings of documents that are already unique by id."""
    return normalised(postings(term_frequencies(docs, fields, id, stop_words, words), docs.count(), id), id)


def asked_terms(dfs: DataFrame, asked: DataFrame, documents: int, counts: bool = False) -> DataFrame:
    """(qid, term, q, qnorm): weights of the queries' terms (qid, term, qtf) that dfs (term, df) knows and that weigh
    something, and the norm of each query's weights. If they will meet counts in place of weights, q has the IDF that
    these lack."""
    found = asked.join(dfs, "term").withColumn("q", F.col("qtf") * idf(F.col("df"), documents)).where("q > 0")
    q = F.col("q") * idf(F.col("df"), documents) if counts else F.col("q")
    return found.select("qid", "term", q.alias("q"), F.sqrt(F.sum(F.col("q") * F.col("q")).over(Window.partitionBy("qid"))).alias("qnorm"))


def search(index: DataFrame, queries: DataFrame, documents: int, k: int, id: str = "doc_id", stop_words: Sequence[str] = (), words: Words | None = None, norms: DataFrame | None = None, dfs: DataFrame | None = None) -> DataFrame:
    """(qid, id, score, rank): the k best documents of each query (qid, query) by cosine, score at six decimals, ties by id.

    Queries are cut into words as the index was: give both the same `words`. Weights of the index are normalised, or
    norms has each document's (id, norm). With dfs (term, df) the index has counts (id, term, tf), which become weights
    here, so that it is written without a shuffle. Only postings of the queries' terms are read: a few terms become a filter that
    reaches the scan, many are joined. These postings are dealt by document before they meet the queries, so that
    scores are summed, and all but the k best of each task dropped, where they are made; so many tasks that none holds
    more than some TASK_SCORES scores, which would be written to disk, several times what the documents take.
    A query without a known term of some weight has no hits.
    """
    asked_words = queries.select("qid", F.explode(_words(F.col("query"), stop_words, words)).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    asked = [r.term for r in asked_words.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
    few = asked_words.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    near = F.broadcast if few else lambda df: df
    of_asked = lambda df: df.where(F.col("term").isin(asked)) if len(asked) <= PUSHED_TERMS else df.join(near(asked_words.select("term").distinct()), "term", "left_semi")
    rows = of_asked(index)
    known = rows.groupBy("term").agg(F.max("df").alias("df")) if dfs is None else of_asked(dfs)
    weighed = near(asked_terms(known, asked_words, documents, counts=dfs is not None))
    rows = rows.select(id, "term", F.col("weight" if dfs is None else "tf").alias("weight"))
    tasks = tasks_for(index.sparkSession, documents * asked_words.select("qid").distinct().count(), TASK_SCORES) if few else 0
    found = (rows.repartition(tasks, id) if few else rows).join(weighed, "term")
    dots = found.groupBy("qid", id).agg((F.sum(F.col("weight") * F.col("q")) / F.first("qnorm")).alias("dot"))
    if norms is not None:
        norms = norms.select(id, "norm")  # hashed, as the scores would have to be sorted
        dots = dots.join(norms.repartition(tasks, id).hint("shuffle_hash") if few else norms, id).withColumn("dot", F.col("dot") / F.col("norm"))
    scores = dots.select("qid", id, F.round("dot", 6).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc(id))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rounded(value: Column, digits: int) -> Column:
    """A positive double at so many decimals, by its own value, as SQL engines round doubles; F.round goes by its
    shortest decimal text, which may stand at a half that the double is below."""
    return F.floor(value * 10.0**digits + 0.5) / 10.0**digits


def with_link_flag(hits: DataFrame, linked: DataFrame, on: str, name: str = "has_image", most_bytes: int = 128) -> DataFrame:
    """hits with whether `on` is found in linked; over-long or null keys are not."""
    known = linked.select(F.col(on).alias("_key")).where(F.octet_length(F.col("_key").cast("string")) <= most_bytes).distinct()
    return hits.join(known, F.col(on) == F.col("_key"), "left").withColumn(name, F.col("_key").isNotNull()).drop("_key")


def hits_json(hits: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One JSON object a query: its hits in rank order; k bounds the list."""
    hit = F.struct("rank", *columns)
    return hits.groupBy("qid").agg(F.sort_array(F.collect_list(hit)).alias("x")).select("qid", F.to_json(F.struct(F.size("x").alias("count"), F.transform("x", lambda h: F.struct(*(h[c].alias(c) for c in columns))).alias("hits"))).alias("json"))
