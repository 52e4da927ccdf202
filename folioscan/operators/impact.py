"""Ranked search that reads only the blocks of postings that can hold a hit.

Documents of like length share blocks, as normalised weights follow the length; a block has one row for each of its
terms: the greatest weight and the postings. The sum of a query's greatest weights bounds what any document of a block
can score. The blocks of the highest bounds are scored first; the k-th best score found there is a threshold, and only
blocks whose bound reaches it are scored besides. The hits are those of scoring every posting.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.operators.index import BROADCAST_ROWS, PUSHED_TERMS, Words, _words, asked_terms, small

#: Documents in a block. For its threshold a query scores its blocks of the highest bounds: until they hold so many times
#: k documents, and no more than so many blocks.
BLOCK_DOCUMENTS, FIRST_DOCUMENTS, FIRST_BLOCKS = 64, 8, 64
#: Documents whose norms are broadcast to their postings, 16 bytes each.
BROADCAST_NORMS = 4_000_000
#: Blocks that are pushed into the scan as a filter.
PUSHED_BLOCKS = 2000
#: Scores are compared at six decimals, so a bound that falls short by less may still tie.
SLACK = 1e-6


def parts(norms: DataFrame, id: str = "doc_id", documents: int = BLOCK_DOCUMENTS) -> DataFrame:
    """(id, part, norm): the block of each document of norms (id, terms, norm), by its number of terms; within its
    segment, if norms have one."""
    segment = F.col("segment").cast("long") if "segment" in norms.columns else F.lit(0).cast("long")
    lengths = norms.select(id, F.floor(2 * F.log2("terms")).cast("long").alias("level"), segment.alias("segment"), "norm")
    levels = lengths.groupBy("segment", "level").agg(F.ceil(F.count("*") / documents).alias("splits"))  # some sixty rows a segment
    part = F.shiftleft("level", 56) + F.shiftleft("segment", 32) + F.pmod(F.xxhash64(id), F.col("splits"))
    return lengths.join(F.broadcast(levels), ["segment", "level"]).select(id, part.alias("part"), "norm")


def blocks(postings: DataFrame, id: str = "doc_id", documents: int = BLOCK_DOCUMENTS, dealt: DataFrame | None = None) -> DataFrame:
    """(term, part, df, most, n, docs) of normalised postings: one row for each term of a block (part) of about so many
    documents, with its n postings (id, weight) of some weight. Publish it laid out by term.

    If dealt has the parts of documents (stored), weights are those before normalisation, of which a term has few and
    which take little space; only most is normalised, and `Search` needs the same parts."""
    own = small(dealt) if dealt is not None else parts(postings.groupBy(id).agg(F.count("*").alias("terms"), F.lit(1.0).alias("norm")), id, documents)
    rows = postings.where("weight > 0").select(id, "term", "df", "weight").join(own, id)
    return rows.groupBy("term", "part").agg(F.max("df").alias("df"), F.max(F.col("weight") / F.col("norm")).alias("most"), F.count("*").alias("n"), F.collect_list(F.struct(id, "weight")).alias("docs"))


def segment_blocks(postings: DataFrame, dealt: DataFrame, id: str = "doc_id") -> DataFrame:
    """(term, part, most, n, docs) as `blocks`, of counts (id, term, tf) whose documents share parts (dealt) with
    documents of their own task only, so nothing is shuffled; `most` and docs lack the IDF, which `Search` gets from dfs.
    A term of a part may have two rows where a task ended within it, which makes a bound looser and changes no hit."""
    own = small(dealt.where("norm > 0"), BROADCAST_NORMS)
    rows = postings.select(id, "term", "tf").join(own, id).select("term", "part", id, "tf", (F.col("tf") / F.col("norm")).alias("most"))
    kind = postings.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            term, part = batch.column("term").dictionary_encode().indices.to_numpy(), batch.column("part").to_numpy()
            first = np.concatenate([[0], np.flatnonzero((term[1:] != term[:-1]) | (part[1:] != part[:-1])) + 1])
            ends = np.append(first, batch.num_rows)
            docs = pa.StructArray.from_arrays([batch.column(id), batch.column("tf")], [id, "weight"])
            lists, most = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), docs), np.maximum.reduceat(batch.column("most").to_numpy(), first)
            yield pa.RecordBatch.from_arrays([batch.column("term").take(pa.array(first)), pa.array(part[first]), pa.array(most), pa.array(np.diff(ends)), lists], ["term", "part", "most", "n", "docs"])

    return rows.sortWithinPartitions("term", "part").mapInArrow(run, f"term string, part long, most double, n long, docs array<struct<{id}: {kind}, weight: long>>")


class Search:
    """A batch of queries (qid, query) over blocks: hits, and what had to be read for them. Rows of blocks are dealt by
    block before they meet the queries, so that bounds and scores are summed where they are made. dfs (term, df) are
    needed for `segment_blocks`, whose bounds are summed where the blocks are read."""

    def __init__(self, blocks: DataFrame, queries: DataFrame, documents: int, k: int, id: str = "doc_id", stop_words: Sequence[str] = (), words: Words | None = None, dealt: DataFrame | None = None, dfs: DataFrame | None = None):
        self.k, self.id = k, id
        self.norms = None if dealt is None else dealt.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(id, "norm"))).alias("norms"))
        asked = queries.select("qid", F.explode(_words(F.col("query"), stop_words, words)).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
        terms = [r.term for r in asked.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
        near = F.broadcast if asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else lambda df: df
        of_asked = lambda df: df.where(F.col("term").isin(terms)) if len(terms) <= PUSHED_TERMS else df.join(near(asked.select("term").distinct()), "term", "left_semi")
        self.blocks = of_asked(blocks)
        known = self.blocks.groupBy("term").agg(F.max("df").alias("df")) if dfs is None else of_asked(dfs)
        self.asked = near(asked_terms(known, asked, documents, counts=dfs is not None))
        rows = self.blocks.select("term", "part", "most", "n")
        wanted = (rows.repartition("part") if dfs is None else rows).join(self.asked, "term")
        self.bounds = wanted.groupBy("qid", "part").agg((F.sum(F.col("q") * F.col("most")) / F.first("qnorm")).alias("bound"), F.max("n").alias("n"), F.sum("n").alias("postings"))
        best = Window.partitionBy("qid").orderBy(F.desc("bound"), "part")
        first = self.bounds.withColumn("r", F.row_number().over(best)).where(F.col("r") <= FIRST_BLOCKS)
        self.first = first.withColumn("held", F.sum("n").over(best) - F.col("n")).where(F.col("held") < FIRST_DOCUMENTS * k).select("qid", "part")
        found = self._best(self._scores(self.first))
        threshold = found.where(F.col("rank") == k).select("qid", F.col("score").alias("least"))
        reached = F.col("bound") >= F.coalesce("least", F.lit(0.0)) - 2 * SLACK
        self.reached = self.bounds.join(threshold, "qid", "left").where(reached).select("qid", "part")

    def _scores(self, parts: DataFrame) -> DataFrame:
        """(qid, id, score) of all documents of these blocks (qid, part)."""
        known = [r.part for r in parts.select("part").distinct().limit(PUSHED_BLOCKS + 1).collect()]
        read = self.blocks.where(F.col("part").isin(known)) if len(known) <= PUSHED_BLOCKS else self.blocks
        asking = parts.groupBy("part").agg(F.collect_set("qid").alias("qids"))
        rows = read.select("term", "part", "docs").repartition("part").join(asking, "part")
        if self.norms is not None:
            normal = F.transform("docs", lambda x: F.struct(x[self.id].alias(self.id), (x["weight"] / F.element_at("norms", x[self.id])).alias("weight")))
            rows = rows.join(self.norms, "part").withColumn("docs", normal).drop("norms")
        need = rows.join(self.asked, "term").where(F.array_contains("qids", F.col("qid")))
        found = need.select("qid", "part", "q", "qnorm", F.explode("docs").alias("x")).select("qid", "part", "q", "qnorm", F.col(f"x.{self.id}").alias(self.id), F.col("x.weight").alias("weight"))
        dots = found.groupBy("qid", "part", self.id).agg((F.sum(F.col("q") * F.col("weight")) / F.first("qnorm")).alias("dot"))
        return dots.select("qid", self.id, F.round("dot", 6).alias("score"))

    def _best(self, scores: DataFrame) -> DataFrame:
        order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc(self.id))
        return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.k)

    def hits(self) -> DataFrame:
        """(qid, id, score, rank), as index.search of all postings."""
        return self._best(self._scores(self.reached))

    def work(self) -> DataFrame:
        """(qid, n_postings, n_read, n_blocks, n_blocks_read): postings of the query's terms, and those in the blocks
        that are scored, for the threshold or for the hits."""
        read = self.first.unionByName(self.reached).distinct().withColumn("read", F.lit(1))
        both = self.bounds.join(read, ["qid", "part"], "left").withColumn("read", F.coalesce("read", F.lit(0)))
        return both.groupBy("qid").agg(F.sum("postings").alias("n_postings"), F.sum(F.col("postings") * F.col("read")).alias("n_read"), F.count("*").alias("n_blocks"), F.count_if(F.col("read") == 1).alias("n_blocks_read"))


def search(blocks: DataFrame, queries: DataFrame, documents: int, k: int, id: str = "doc_id", stop_words: Sequence[str] = (), words: Words | None = None, dealt: DataFrame | None = None, dfs: DataFrame | None = None) -> DataFrame:
    """(qid, id, score, rank): the k best documents of each query, without scoring every posting."""
    return Search(blocks, queries, documents, k, id, stop_words, words, dealt, dfs).hits()
