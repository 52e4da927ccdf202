"""Document quality from a linear-chain CRF over lines.

Every line is good or bad given its own features, its neighbours' and its neighbours' labels. Forward-backward
marginals, weighted by line length, give the share of good text; a logistic curve maps it to a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import arrow_limits, byte_values, keyed, per_row, span_hash, steps, texts, word_bounds
from folioscan.llm.crf import Chain, fit, marginals

#: The fitting sample: labelled documents of up to so many characters, those of least hash.
SAMPLE_DOCS, SAMPLE_CHARS = 2000, 20_000
#: Documents that score this or more are predicted good.
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _among(values: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(values))


KINDS = {
    "chars": (np.arange(256) & 0xC0) != 0x80,
    "upper": _among(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "lower": _among(b"abcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 0xC0),
    "digit": _among(b"0123456789"),
    "symbol": _among(b"#*$%&<>@^~=_{}[]\\+"),
    "pipe": _among(b"|"),
    "mark": _among(b"!?"),
    "stop": _among(b".,;:"),
}


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, characters, lines before each row and in all) of the lines that have a word."""
    cuts = np.union1d(offsets, np.flatnonzero(data == 10) + 1)
    starts, stops, first = word_bounds(data, cuts) if len(data) else (np.zeros(0, int), np.zeros(0, int), np.zeros(len(cuts), int))
    words = np.diff(first)
    some = np.flatnonzero(words > 0)
    row = np.searchsorted(offsets, cuts[some], "right") - 1
    before = np.searchsorted(row, np.arange(len(offsets)))
    if not len(some):
        return np.zeros((0, 1)), np.zeros(0), before
    counts = {k: per_row(flags[data], cuts)[some].astype(float) for k, flags in KINDS.items()}
    word = span_hash(data, starts, stops, byte_values(1))
    again = np.zeros(len(word), bool)
    again[1:] = word[1:] == word[:-1]
    again[first[:-1][words > 0]] = False
    line = span_hash(data, starts[first[:-1][some]], stops[first[1:][some] - 1], byte_values(2))
    _, known = np.unique(np.stack([row.astype(np.uint64), line], axis=1), axis=0, return_index=True) if len(line) else (None, [])
    repeat = np.ones(len(some))
    repeat[known] = 0
    n, chars = words[some].astype(float), counts["chars"]
    tail = data[stops[first[1:][some] - 1] - 1]
    letters = counts["upper"] + counts["lower"] + 1
    own = np.stack([
        np.log1p(n), np.log1p(chars), chars / n, counts["upper"] / letters, (counts["upper"] > counts["lower"]).astype(float), counts["digit"] / chars, np.sqrt(counts["symbol"] / n), np.sqrt(counts["pipe"] / n),
        np.sqrt(counts["mark"] / n), counts["stop"] / n, per_row(again, first)[some] / n, repeat, np.isin(tail, list(b".!?\"')")).astype(float),
    ], axis=1)
    same = row[1:] == row[:-1]
    last, after = np.zeros_like(own), np.zeros_like(own)
    last[1:][same] = own[:-1][same]
    after[:-1][same] = own[1:][same]
    edge = np.ones((len(own), 3))
    edge[1:, 1] = ~same
    edge[:-1, 2] = ~same
    return np.concatenate([own, last, after, edge], axis=1), chars, before


def share_good(chain: Chain, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Length-weighted marginal of `good` over each row's lines, in log odds; 0 where there is no line."""
    features, chars, before = line_features(data, offsets)
    out = np.zeros(len(offsets) - 1)
    if len(features):
        good, _, _ = marginals(chain.unary(features), chain.step, before)
        total = np.concatenate([[0], np.cumsum(good[:, 1] * chars)])
        weight = np.concatenate([[0], np.cumsum(chars)])
        some = np.diff(before) > 0
        p = (np.diff(total[before])[some] / np.diff(weight[before])[some]).clip(1e-6, 1 - 1e-6)
        out[some] = np.log(p / (1 - p))
    return out


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> tuple[Chain, float, float] | None:
    """(chain, slope, intercept) from labelled rows outside the held-out fold; None without any. Each line of the
    sample carries its document's label."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    # one text of each id, that of least key, so that repeated ids neither add rows nor leave the choice to chance
    rows = keyed(docs).where(F.length("text") <= chars).join(F.broadcast(ids.distinct()), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct("k1", "k2", "text")).alias("x")).collect()
    rows = sorted(((r.doc_id, r.quality, r.x.text.encode()) for r in rows))
    if not rows:
        return None
    data, offsets = np.frombuffer(b"".join(r[2] for r in rows), np.uint8), np.cumsum([0, *(len(r[2]) for r in rows)])
    label = np.array([r[1] for r in rows])
    features, _, before = line_features(data, offsets)
    if not len(features):
        return None
    chain = fit(features, np.repeat(label, np.diff(before)), before, 2)
    share, a, b = share_good(chain, data, offsets), 1.0, 0.0
    for _ in range(300):  # the curve from shares to scores
        p = 1 / (1 + np.exp(-(a * share + b).clip(-30, 30)))
        a += 0.5 * (((label - p) * share).mean() / max((share * share).mean(), 1) - 1e-3 * a)
        b += 0.5 * (label - p).mean()
    return chain, float(a), float(b)


def score_documents(docs: DataFrame, model: tuple[Chain, float, float] | None) -> DataFrame:
    """(doc_id, score) of every row: the chance that the document is good, from its text alone.

    Null and empty texts have no line and score as the curve has it for even odds (0.5 without a model). Repeated
    rows score alike. The whole of a long text counts.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for rows, data, offsets in steps(batches):
            if known is None:
                score = np.full(rows.num_rows, 0.5)
            else:
                chain, a, b = known
                score = 1 / (1 + np.exp(-(a * share_good(chain, data, offsets) + b).clip(-30, 30)))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(score)], ["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def kept_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are predicted good, with all their columns; scored in passing, without a join."""
    spark = docs.sparkSession
    arrow_limits(spark)
    shared = spark.sparkContext.broadcast(learn(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for rows, data, offsets in steps(batches):
            good = np.ones(rows.num_rows, bool)
            if known is not None:
                chain, a, b = known
                good = 1 / (1 + np.exp(-(a * share_good(chain, data, offsets) + b).clip(-30, 30))) >= threshold
            yield rows.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs, learnt from labels outside the held-out fold."""
    scored = score_documents(docs, learn(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
