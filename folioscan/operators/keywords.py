"""Keywords by TF-IDF and by TextRank, and part-of-speech lookup."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.operators.index import looked_up

#: Fixed values of TextRank: words of a window, rounds, damping.
SPAN, ROUNDS, DAMPING = 5, 10, 0.85


def top_keywords(tf: DataFrame, idf: DataFrame, n: int, id: str = "doc_id", default: float | None = None) -> DataFrame:
    """(id, term, weight, rank): tf * idf; a term that the idf table lacks, or has null for, takes the default, its mean if
    none is given. If the table has df too, values of frequent terms are broadcast, so that a document's terms are ranked
    where they stand and few are shuffled."""
    if default is None:
        default = idf.agg(F.avg("idf")).first()[0] or 0.0
    order = Window.partitionBy(id).orderBy(F.desc("weight"), "term")
    joined = looked_up(tf, idf.select("term", "df", "idf")) if "df" in idf.columns else tf.join(idf.select("term", "idf"), "term", "left")
    weighed = joined.withColumn("weight", F.round(F.col("tf") * F.coalesce("idf", F.lit(default)), 6))
    return weighed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select(id, "term", "weight", "rank")


def term_offsets(docs: DataFrame, id: str = "doc_id", text: str = "text", word: str = r"[\p{L}\p{N}]+") -> DataFrame:
    """(id, term, tf, offsets): the byte offsets of each term of more than one byte, ascending. Words and what is between
    them alternate, so an offset is a running sum of lengths within the document."""
    parts = F.arrays_zip(F.split(F.col(text), word, -1).alias("between"), F.regexp_extract_all(F.col(text), F.lit(word), F.lit(0)).alias("term"))
    rows = docs.select(id, F.posexplode(parts).alias("i", "x")).select(id, "i", "x.*").where(F.col("term").isNotNull())
    here = Window.partitionBy(id).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = F.sum(F.octet_length("between") + F.octet_length("term")).over(here)
    placed = rows.withColumn("offset", ends - F.octet_length("term")).where(F.octet_length("term") > 1)
    return placed.groupBy(id, "term").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("offset")).alias("offsets"))


def text_ranks(docs: Sequence[Sequence[str]], stop_words: Sequence[str] = (), span: int = SPAN, rounds: int = ROUNDS, damping: float = DAMPING) -> list[dict[str, float]]:
    """Word scores of each document. Words of one code point and stop words are skipped and do not use up the window.
    Scores are updated in place, in the order of the words' UTF-8 bytes; the result depends on both.

    Documents are worked on side by side: the k-th words of all of them are updated at once, each from the scores that
    its own document has by then.
    """
    names, lefts, rights, shares = [], [], [], []
    for words in docs:
        kept = [w for w in words if len(w) > 1 and w not in stop_words]
        own = sorted(set(kept), key=str.encode)
        names.append(own)
        place, n = {w: i for i, w in enumerate(own)}, len(own)
        ids = np.fromiter((place[w] for w in kept), np.int64, len(kept))
        near = [(ids[:-k], ids[k:]) for k in range(1, min(span, len(ids)))]
        if not near:
            lefts, rights, shares = [*lefts, ids[:0]], [*rights, ids[:0]], [*shares, ids[:0].astype(float)]
            continue
        one, two = (np.concatenate([x[s] for x in near]) for s in (0, 1))
        edge, weight = np.unique(np.concatenate([one * n + two, two * n + one]), return_counts=True)
        left, right = edge // n, edge % n
        lefts.append(left)
        rights.append(right)
        shares.append(weight / np.bincount(left, weight, n)[right])
    size = np.array([len(x) for x in names], np.int64)
    begin = np.cumsum(size) - size
    of = np.repeat(np.arange(len(names)), [len(x) for x in lefts])
    if not len(of):
        return [{w: 0.0 for w in own} for own in names]
    step = np.concatenate(lefts)
    order = np.lexsort((of, step))  # edges by step, then document
    step, node, source, share = step[order], (begin[of] + np.concatenate(lefts))[order], (begin[of] + np.concatenate(rights))[order], np.concatenate(shares)[order]
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    at = np.searchsorted(step[first], np.arange(int(step[-1]) + 2))
    ends = np.append(first, len(node))
    score = np.repeat(1.0 / np.maximum(size, 1), size)
    plan = [(node[first[a:b]], source[ends[a] : ends[b]], share[ends[a] : ends[b]], first[a:b] - ends[a]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    for _ in range(rounds):
        for nodes, sources, parts, cuts in plan:
            score[nodes] = 1 - damping + damping * np.add.reduceat(parts * score[sources], cuts)
    out = []
    for own, a, edges in zip(names, begin.tolist(), lefts):
        mine = score[a : a + len(own)]
        low, high = (mine.min() / 10, mine.max()) if len(edges) else (0.0, 1.0)
        out.append(dict(zip(own, ((mine - low) / (high - low)).tolist())) if len(edges) else {w: 0.0 for w in own})
    return out


def text_rank(words: Sequence[str], stop_words: Sequence[str] = (), span: int = SPAN, rounds: int = ROUNDS, damping: float = DAMPING) -> dict[str, float]:
    """`text_ranks` of one document."""
    return text_ranks([words], stop_words, span, rounds, damping)[0]


#: Words of documents that are worked on side by side.
SIDE_WORDS = 200_000


def text_rank_keywords(docs: DataFrame, n: int, id: str = "doc_id", words: str = "words", stop_words: Sequence[str] = ()) -> DataFrame:
    """(id, term, weight, rank) from an array column of words: each document's graph is its own, so no shuffle is needed."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stop = frozenset(stop_words)
        for part in parts:
            found = [list(x) if x is not None else [] for x in part[words]]
            group = np.cumsum([len(x) for x in found]) // SIDE_WORDS
            for g in np.unique(group).tolist():
                rows, which = [], np.flatnonzero(group == g).tolist()
                for i, scores in zip(which, text_ranks([found[i] for i in which], stop)):
                    ranked = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:n]
                    rows += [(part[id].iloc[i], w, s, k + 1) for k, (w, s) in enumerate(ranked)]
                yield pd.DataFrame(rows, columns=[id, "term", "weight", "rank"])

    return docs.select(id, words).mapInPandas(run, f"{id} {docs.schema[id].dataType.simpleString()}, term string, weight double, rank int")


def fallback_tag(word: Column) -> Column:
    """Tag of a word that the dictionary lacks: by its first ASCII code points, at most half as many as it is long:
    none x, all digits m, else eng."""
    half = F.floor(F.char_length(word) / 2).cast("int")
    ascii_ = F.regexp_replace(word, r"[^\x00-\x7f]", "")
    seen = F.substring(ascii_, F.lit(1), half)
    return F.when(F.length(seen) == 0, "x").when(F.length(F.regexp_replace(seen, "[^0-9]", "")) == F.length(seen), "m").otherwise("eng")


def tagged(words: DataFrame, dictionary: DataFrame, word: str = "word") -> DataFrame:
    """words with tag: the dictionary's (word, tag), or the fallback."""
    known = dictionary.where("tag <> ''").groupBy(F.col("word").alias(word)).agg(F.min("tag").alias("_tag"))
    return words.join(known, word, "left").withColumn("tag", F.coalesce("_tag", fallback_tag(F.col(word)))).drop("_tag")
