"""The trie of conversation prefixes, by prefix-doubling naming.

Turns get dense names; blocks of 2, 4, 8, ... turns get dense names of the pairs of names they are made of, in one join
round for each power of two. A prefix of d turns is the prefix without d's lowest bit and one block, so prefixes get
their names from the largest power down, each once. Prefixes of one name and depth are one node. What a node says of
its subtree are sums over its members, because each node below belongs to one of them: its smallest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import arrow_limits, forget, matched, stored
from folioscan.llm.runs import digests, numbered

#: How many first turns a conversation may take from the one it is rebuilt on, less one.
SHARED = 4
#: Conversations of so many following ids are rebuilt on the first of them.
FAMILY = 20


def dense(rows: DataFrame, a: str, b: str) -> DataFrame:
    """rows with name in place of the long columns a and b: 0, 1, ... for the distinct pairs of them."""
    pairs = stored(rows.select(a, b).distinct().withColumn("m", F.monotonically_increasing_id()))
    start, starts = 0, []
    for p, n in sorted(pairs.groupBy(F.shiftright("m", 33)).count().collect()):  # a row for each partition
        starts.append((p, start))
        start += n
    first = F.broadcast(rows.sparkSession.createDataFrame(starts, "p long, first long"))
    names = pairs.join(first, F.shiftright("m", 33) == F.col("p")).select(a, b, (F.col("first") + F.col("m").bitwiseAND((1 << 33) - 1)).alias("name"))
    out = stored(matched(rows, names, [a, b]).drop(a, b))
    forget(pairs)
    return out


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n) of the rebuilt conversations, and their turns (conv_id, i, k1, k2, words, n), i from 0.

    A conversation takes the first h turns of conversation conv_id - conv_id % 20 (remainder as in SQL; those there
    are), then its own without its first h; h is the CRC-32 of its decimal id, modulo 4. k1 and k2 stand for role and
    text. Turns are in the order of turn, null first, ties by k1 and k2.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("k1"), F.xxhash64(F.lit(1), role, text).alias("k2"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words")).where("conv_id IS NOT NULL")
    placed = stored(numbered(rows, "conv_id", F.col("turn").asc_nulls_first(), F.col("k1"), F.col("k2")).drop("turn"))
    base, take = F.col("conv_id") - F.col("conv_id") % FAMILY, F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    heads = placed.where((F.col("conv_id") % FAMILY == 0) & (F.col("place") < SHARED - 1)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "k1", "k2", "words"))).alias("head"))
    own = placed.groupBy("conv_id").agg(F.count("*").alias("own")).withColumns({"base": base, "h": take}).join(heads, "base", "left")
    own = own.withColumn("head", F.filter(F.coalesce("head", F.array().cast(own.schema["head"].dataType)), lambda x: x.place < F.col("h")))
    own = stored(own.select("conv_id", "h", "head", (F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("long").alias("n")))
    first = own.select("conv_id", F.explode("head").alias("x"), "n").select("conv_id", F.col("x.place").alias("i"), "x.k1", "x.k2", "x.words", "n")
    rest = matched(placed, own.select("conv_id", "h", (F.size("head") - F.col("h")).alias("shift"), "n"), ["conv_id"]).where("place >= h").select("conv_id", (F.col("place") + F.col("shift")).alias("i"), "k1", "k2", "words", "n")
    return own.select("conv_id", "n"), first.unionByName(rest)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, name, words, last, n) for depth 1 to n: name says which prefix of that depth it is, words how
    many words it has in all, last how many in its last turn."""
    longest = turns.agg(F.max("n")).first()[0] or 0
    level = dense(turns.withColumn("last", F.col("words")), "k1", "k2")
    levels, k = [level], 0
    while 2 << k <= longest:
        odd = F.col("i") % 2 == 1
        both = level.groupBy("conv_id", F.floor(F.col("i") / 2).alias("i")).agg(F.max(F.when(~odd, F.col("name"))).alias("a"), F.max(F.when(odd, F.col("name"))).alias("b"), F.sum("words").alias("words"), F.max(F.when(odd, F.col("last"))).alias("last"), F.max("n").alias("n"))
        level = dense(both.where("b IS NOT NULL"), "a", "b")
        levels.append(level)
        k += 1
    out = None
    for k in range(len(levels) - 1, -1, -1):
        blocks = levels[k].where("i % 2 = 0").select("conv_id", (F.col("i") * (1 << k)).alias("from"), F.col("name").alias("b"), "words", "last", "n")
        if out is None:
            made = blocks.withColumns({"a": F.lit(0).cast("long"), "before": F.lit(0).cast("long")})
        else:
            made = blocks.join(out.select("conv_id", F.col("depth").alias("from"), F.col("name").alias("a"), F.col("words").alias("before")), ["conv_id", "from"], "left").fillna(0, ["a", "before"])
        made = dense(made, "a", "b").select("conv_id", (F.col("from") + (1 << k)).alias("depth"), "name", (F.col("before") + F.col("words")).alias("words"), F.col("last").cast("long").alias("last"), "n")
        out = made if out is None else out.unionByName(made)
        forget(levels[k])
    return out


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations, as op13's contract names its columns.

    Rows without a conv_id belong to no conversation; null roles and texts are empty; repeated rows are turns of their
    own; further columns are ignored. An empty table has no nodes, not even a root. One conversation, or one prefix, may
    hold any share of the rows: turns are numbered and members digested over sorted partitions, hot names are split.

    The smallest member of a node owns it, and the nodes it owns are the end of its own path. So for a node v of members
    c: the words of all members below v are the members' totals less what stands before v, and the words of all
    different nodes below v are what its members own, its owner counted from v on; likewise for children and leaves.
    """
    arrow_limits(conversations.sparkSession)
    convs, turns = rebuilt(conversations)
    rows = prefixes(turns)
    top = convs.agg(F.min("conv_id")).first()[0]
    owners = rows.groupBy("depth", "name").agg(F.min("conv_id").alias("owner"), F.max("n").alias("deepest"))
    rows = stored(matched(rows, owners, ["depth", "name"]))
    mine = F.col("owner") == F.col("conv_id")
    paths = rows.groupBy("conv_id").agg(
        F.min(F.when(mine, F.col("depth"))).alias("since"), F.max(F.when(~mine, F.struct("depth", "owner"))).getField("owner").alias("above"), F.sum("last").alias("all_words"),
        F.sum(F.when(mine, F.col("last")).otherwise(0)).alias("own_words"), F.max((mine & (F.col("deepest") == F.col("depth"))).cast("long")).alias("leaf"),
    )
    paths = stored(paths)
    opens = lambda depth: F.coalesce((F.col("since") <= depth) & (F.col("n") >= depth), F.lit(False)).cast("long")
    nodes = matched(rows, paths, ["conv_id"]).groupBy("depth", "name").agg(
        F.min("conv_id").alias("conv_id"), F.min_by(F.struct("since", "above", "all_words", "own_words"), "conv_id").alias("by"), F.count("*").alias("n_convs"), F.sum(opens(F.col("depth") + 1)).alias("n_children"), F.sum("leaf").alias("n_leaves"),
        F.sum("all_words").alias("all_words"), F.sum("own_words").alias("own_words"), F.max(F.col("words") - F.col("last")).alias("before"),
    )
    saving = F.col("all_words") - F.col("n_convs") * F.col("before") - (F.col("own_words") - F.col("by.own_words") + F.col("by.all_words") - F.col("before"))
    nodes = nodes.select("conv_id", "depth", "name", F.when(F.col("depth") > F.col("by.since"), F.col("conv_id")).otherwise(F.coalesce("by.above", F.lit(top).cast("long"))).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", saving.alias("saved_tokens"))
    whole = convs.join(paths, "conv_id", "left").agg(F.count("*").alias("n_convs"), F.sum(opens(F.lit(1))).alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum(F.col("all_words") - F.col("own_words")).alias("saved_tokens")).where("n_convs > 0")
    null, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    root = whole.select(F.lit(top).cast("long").alias("conv_id"), zero.alias("depth"), zero.alias("name"), null.alias("parent_conv_id"), "n_convs", "n_children", F.greatest(F.coalesce("n_leaves", zero), F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens"))
    ends = rows.where("depth = n").select("depth", "name", "conv_id").unionByName(convs.where("n = 0").select(zero.alias("depth"), zero.alias("name"), "conv_id")).sort("depth", "name", "conv_id")
    ends = digests(ends.withColumn("ends_sha256", F.col("conv_id").cast("string").cast("binary")), ["depth", "name"], ["ends_sha256"], sep=b",")
    out = nodes.unionByName(root).join(ends, ["depth", "name"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))


#: op13 in SQL: every prefix of every rebuilt conversation as a list, grouped.
SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
x AS (SELECT conv_id, i, role || chr(1) || text AS k, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS w FROM t),
c AS (SELECT conv_id, list(struct_pack(k := k, w := w) ORDER BY i) AS own FROM x GROUP BY conv_id),
tab AS (SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v % 2) * 3988292384))) AS crc),
hashed AS (SELECT conv_id, own, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda v, ch: xor(v >> 8, crc[xor(v & 255, ch) + 1])), 4294967295) % 4 AS h FROM c, tab),
built AS (SELECT hashed.conv_id, coalesce(base.own[1:h], []) || hashed.own[h + 1:] AS seq FROM hashed LEFT JOIN c base ON base.conv_id = hashed.conv_id - hashed.conv_id % 20),
p AS (SELECT conv_id, len(seq) AS n, unnest(range(0, len(seq) + 1)) AS depth, seq FROM built),
q AS (SELECT conv_id, n, depth, sha256(array_to_string(list_transform(seq[1:depth], lambda y: sha256(y.k)), '')) AS name, sha256(array_to_string(list_transform(seq[1:depth - 1], lambda y: sha256(y.k)), '')) AS up, coalesce(seq[depth].w, 0) AS w FROM p),
node AS (SELECT depth, name, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) AS deepest, any_value(w) AS w, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM q GROUP BY depth, name),
below AS (SELECT q.depth, q.name, count(*) FILTER (v.depth = q.depth + 1) AS n_children, count(*) FILTER (v.deepest = v.depth) AS n_leaves, sum((v.n_convs - 1) * v.w)::BIGINT AS saved_tokens FROM node v JOIN q AS path ON path.conv_id = v.conv_id AND path.depth = v.depth JOIN q ON q.conv_id = v.conv_id AND q.depth <= v.depth GROUP BY q.depth, q.name)
SELECT node.conv_id, node.depth, CASE WHEN node.depth > 0 THEN above.conv_id END AS parent_conv_id, node.n_convs, n_children, n_leaves, saved_tokens, node.ends_sha256
FROM node JOIN below USING (depth, name) LEFT JOIN node above ON above.depth = node.depth - 1 AND above.name = node.up
"""
