"""Benchmark decontamination with DataFrame functions alone.

Windows of the size of an item slide over a document, at every start where enough of their shingles are the
benchmark's to be similar to anything. Each window gets a SimHash; a multi-index over blocks of the items' SimHashes
finds every item within the Hamming radius; exact similarity on weighted shingles then decides. Where in the item a
shingle stands plays no part, so items with moved parts are found as well.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import keyed, let, saved, small, text_key, unused

SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints within the radius are candidates: a similarity of 0.8 differs in 10 to 13 of 64 bits, with a deviation
#: of 3. Eight blocks, each looked up within 2 bits, find all of that radius: beyond it every block could differ by 3.
BITS, BLOCKS, FLIPS = 64, 8, 2
RADIUS = BLOCKS * (FLIPS + 1) - 1


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingles(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of the word shingles in order; empty if there are fewer words."""
    none = F.array().cast("array<bigint>")
    return let(words(text), lambda w: F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size))))).otherwise(none))


def simhash(hashes: Column) -> Column:
    """The bits that are set in over half of the hashes. Bits b and b + 32 are counted at once, as halves of a long."""
    half, pair, zero = F.size(hashes), F.lit((1 << 32) | 1), F.lit(0).cast("long")

    def bits(acc: Column, b: Column) -> Column:
        ones = F.aggregate(hashes, zero, lambda n, x: n + F.call_function("shiftrightunsigned", x, b).bitwiseAND(pair))
        low = lambda n: F.when(2 * n.bitwiseAND(F.lit((1 << 32) - 1)) > half, 1).otherwise(0).cast("long")
        both = let(ones, lambda n: low(n).bitwiseOR(F.shiftleft(low(F.shiftrightunsigned(n, 32)), 32)))
        return acc.bitwiseOR(F.call_function("shiftleft", both, b))

    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS // 2 - 1)), zero, bits)


def blocks() -> list[tuple[int, int]]:
    """(lowest bit, width) of each block."""
    widths = [BITS // BLOCKS + (k < BITS % BLOCKS) for k in range(BLOCKS)]
    return list(zip(itertools.accumulate([0, *widths[:-1]]), widths))


def block_value(fp: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def multi_index(items: DataFrame) -> DataFrame:
    """items with (block, value) rows: every value within FLIPS bits of a block, so that a fingerprint within RADIUS
    meets the item in at least one block."""

    def around(k: int, low: int, width: int) -> Column:
        flips = [sum(1 << b for b in c) for t in range(FLIPS + 1) for c in itertools.combinations(range(width), t)]
        return F.transform(F.array(*map(F.lit, flips)), lambda x: F.struct(F.lit(k).alias("block"), block_value(F.col("item_fp"), low, width).bitwiseXOR(x).alias("value")))

    keys = [around(k, low, width) for k, (low, width) in enumerate(blocks())]
    return items.withColumn("key", F.explode(F.concat(*keys))).select("*", "key.block", "key.value").drop("key")


def first_block(block: Column, difference: Column) -> Column:
    """Whether no lower block has the difference of two fingerprints within FLIPS bits: of the blocks that find a pair,
    one keeps it."""
    out = F.lit(True)
    for k, (low, width) in enumerate(blocks()):
        out = out & ((block <= k) | (F.bit_count(block_value(difference, low, width)) > FLIPS))
    return out


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, n, item, weights, total, mean): shingles in order; distinct ones by weight. A shingle of k items weighs
    1 / (1 + ln k); a shingle that the item lacks weighs the item's mean, so that windows are judged on one scale."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select("item_id", shingles(F.col("text")).alias("item")).where((F.size("item") > 0) & F.col("item_id").isNotNull())
    one = items.select("item_id", "item", F.explode(F.array_distinct("item")).alias("h"))
    held = one.groupBy("h").agg(F.countDistinct("item_id").alias("k"))
    weighed = one.join(held, "h").groupBy("item_id", "item").agg(F.sort_array(F.collect_set(F.struct("h", (1 / (1 + F.log(F.col("k").cast("double")))).alias("w")))).alias("weights"))
    total = F.aggregate("weights", F.lit(0.0), lambda s, x: s + x["w"])
    return weighed.select("item_id", F.size("item").alias("n"), "item", "weights", total.alias("total"), (total / F.size("weights")).alias("mean"))


def window_ranges(places: Column, n: Column, need: Column) -> Column:
    """[(lo, hi)] of all starts of windows of n shingles that hold at least `need` of the ascending places: those whose
    first place is the j-th begin after the place before it and reach the need - 1 places that follow."""
    last = F.size(places) - need

    def starts(j: Column) -> Column:
        lo = F.greatest(F.get(places, j + need - 1) - n + 1, F.when(j > 0, F.get(places, j - 1) + 1).otherwise(F.get(places, j) - n + 1))
        return F.struct(lo.alias("lo"), F.get(places, j).alias("hi"))

    return F.when(last >= 0, F.filter(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), starts), lambda x: x["lo"] <= x["hi"])).otherwise(F.array().cast("array<struct<lo:int,hi:int>>"))


def _matches(docs: DataFrame, benchmark: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, k1, k2, item_id, similarity, hamming, start) of the windows that are similar to an item."""
    items = saved(benchmark_items(benchmark))
    rows = keyed(docs)
    # a window's weight in common is at least this share of the item's, and a shingle weighs at most 1
    share = similarity / (2 - similarity)
    sizes = items.groupBy("n").agg(F.greatest(F.ceil(F.min("total") * share - 1e-9).cast("int"), F.lit(1)).alias("need"))
    known = items.select("n", F.explode(F.array_distinct("item")).alias("h")).distinct()
    places = rows.select("k1", "k2", F.posexplode(shingles(F.col("text"))).alias("pos", "h")).join(small(known), "h").groupBy("k1", "k2", "n").agg(F.sort_array(F.collect_set("pos")).alias("places"))
    ranges = places.join(F.broadcast(sizes), "n").select("k1", "k2", "n", F.explode(window_ranges(F.col("places"), F.col("n"), F.col("need"))).alias("x"))
    asked = saved(ranges.groupBy("k1", "k2").agg(F.collect_list(F.struct("n", "x.lo", "x.hi")).alias("ranges")))
    # only texts with a window are read again, and none is shuffled unless they are very many
    held = rows.join(small(asked.select("k1", "k2")), ["k1", "k2"], "left_semi").join(asked, ["k1", "k2"]).select("doc_id", "k1", "k2", shingles(F.col("text")).alias("all"), F.explode("ranges").alias("r"))
    windows = held.select("doc_id", "k1", "k2", "all", "r.n", F.explode(F.sequence("r.lo", "r.hi")).alias("at"))
    start = F.greatest("at", F.lit(0))
    windows = windows.select("doc_id", "k1", "k2", "n", start.alias("start"), F.slice("all", start + 1, F.least(F.col("at") + F.col("n"), F.size("all")) - start).alias("window")).withColumn("fp", simhash(F.col("window")))
    keys = F.array(*(F.struct(F.lit(k).alias("block"), block_value(F.col("fp"), low, width).alias("value")) for k, (low, width) in enumerate(blocks())))
    probes = windows.withColumn("key", F.explode(keys)).select("doc_id", "k1", "k2", "start", "n", "window", "fp", "key.block", "key.value")
    index = multi_index(items.select("item_id", "n", simhash(F.col("item")).alias("item_fp")))
    difference = F.col("fp").bitwiseXOR(F.col("item_fp"))
    near = probes.join(small(index), ["n", "block", "value"]).withColumn("hamming", F.bit_count(difference)).where((F.col("hamming") <= RADIUS) & first_block(F.col("block"), difference))
    inside = F.aggregate("weights", F.lit(0.0), lambda s, x: s + F.when(F.array_contains("window", x["h"]), x["w"]).otherwise(0.0))
    other = F.size(F.array_except("window", F.transform("weights", lambda x: x["h"]))) * F.col("mean")
    scored = near.join(small(items.select("item_id", "weights", "total", "mean"), size=F.size("weights") + 1), "item_id").withColumn("inside", inside)
    return scored.select("doc_id", "k1", "k2", "item_id", (2 * F.col("inside") / (F.col("inside") + other + F.col("total"))).alias("similarity"), "hamming", "start").where(F.col("similarity") >= similarity - 1e-12)


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, similarity, hamming, start): documents that hold a window similar to an item, the best one.

    Similarity is weighted Dice on the sets of five-word shingles of lower-cased letters and digits (weights as in
    `benchmark_items`); start is the window's first word. A window has as many shingles as the item, or fewer at the
    ends of a text. Ties go to the first window. Texts or items of fewer than five words have no shingle and match
    nothing; nulls are empty; items without an id are left out; rows that repeat an id are matched each and reported
    once, also those whose id is null; columns beyond these play no part; an empty table on either side gives no rows.
    """
    best = _matches(docs, benchmark, similarity).withColumn("similarity", F.round("similarity", 9)).groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), (-F.col("hamming")).alias("d"))).alias("x"))
    return best.select("doc_id", "item_id", "x.similarity", (-F.col("x.d")).cast("int").alias("hamming"), (-F.col("x.s")).alias("start"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without the rows whose text is contaminated, whatever their doc_id is; other rows and columns stay."""
    gone = small(saved(_matches(docs, benchmark, similarity).select("k1", "k2").distinct()))
    a, b, c, d = unused(docs, "k1", "k2", "gone1", "gone2")
    k1, k2 = text_key(F.col("text"))
    return docs.withColumns({a: k1, b: k2}).join(gone.toDF(c, d), (F.col(a) == F.col(c)) & (F.col(b) == F.col(d)), "left_anti").select(*docs.columns)
