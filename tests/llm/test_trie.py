"""op13 against a plain trie, and digests and places over sorted partitions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from folioscan.llm import queries, runs, trie
from tests.oracle import compare, connection

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    """Rows as op13's, by a dictionary of every prefix."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    built = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])
        built[c] = tuple(first[:h] + x[h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(list)
    for s in members:
        if s:
            children[s[:-1]].append(s)
    memo = {}
    for s in sorted(members, key=len, reverse=True):
        below = [memo[x] for x in children[s]]
        words = len(WORD.findall(s[-1][1])) if s else 0
        memo[s] = (sum(b[0] for b in below) or 1, (len(members[s]) - 1) * words + sum(b[1] for b in below))
    out = []
    for s, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(s))))
        out.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(children[s]), *memo[s], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def same(spark, rows):
    got = [tuple(x) for x in trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()]
    key = lambda x: (x[1], x[0], str(x))
    assert sorted(got, key=key) == sorted(plain_trie(rows), key=key)


@pytest.mark.parametrize("seed", range(2))
def test_plain(spark, seed):
    """Few different turns, so that prefixes meet; lengths from 1 to 40; absent bases; copies; negative ids."""
    r = random.Random(seed)
    turns = [(r.choice(["user", "assistant"]), " ".join("w" * r.randint(1, 3) for _ in range(r.randint(0, 6)))) for _ in range(4)]
    rows, old = [], []
    for c in r.sample(range(-30, 130), 70):
        seq = r.choice(old)[: r.randint(1, 40)] if old and r.random() < 0.6 else []
        seq = seq + [r.choice(turns) for _ in range(r.choice([0, 1, 2, 5, 9, 33]))] or [turns[0]]
        old.append(seq)
        rows += [(c, i * 2, *x) for i, x in enumerate(seq)]
    r.shuffle(rows)
    same(spark, rows)


def test_edges(spark):
    """Null ids, turns, roles and texts; turnless conversations; an empty table; columns of clashing names; repeats."""
    lone = next(c for c in range(1, 400) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20)
    rows = [(None, 0, "user", "no id"), (0, None, None, None), (0, 1, "user", "x y"), (7, 0, "user", None), (7, 5, "user", "x y"), (7, None, "user", "first"), (lone + 400, 0, "user", "gone"), (7, 5, "user", "x y")]
    same(spark, rows)
    lone = next(c for c in range(1, 400) if zlib.crc32(str(c).encode()) % 4 and c % 20)
    same(spark, [(lone, 0, "user", "its only turn is dropped")])
    frame = spark.createDataFrame(rows, SCHEMA)
    assert trie.prefix_trie(frame.where("conv_id > 10000")).collect() == []
    clash = frame.selectExpr("*", "1 AS name", "2 AS depth", "3 AS n", "4 AS place", "5 AS k1", "6 AS i")
    assert sorted(map(str, trie.prefix_trie(clash).collect())) == sorted(map(str, trie.prefix_trie(frame).collect()))


def test_one_long_conversation(spark):
    """A third of all rows in one conversation, and many copies of another; very long texts."""
    rows = [(3, i, "user", f"t {i % 7}") for i in range(300)] + [(c, i, "user", f"same {i}") for c in range(20, 320) for i in range(2)] + [(5, 0, "user", "long " * 400_000)]
    same(spark, rows)


@pytest.mark.parametrize("name", ["op13_conversation_trie"])
def test_sql(spark, sf_dir, name):
    compare(queries.queries()[name](spark, sf_dir), connection(sf_dir), queries.oracle_sql()[name])


def test_numbered(spark):
    rows = [(i % 3 if i % 2 else 9, i * 7919 % 5000) for i in range(5000)]
    got = runs.numbered(spark.createDataFrame(rows, "g long, v long").repartition(7), "g", F.col("v")).collect()
    groups = defaultdict(list)
    for x in got:
        groups[x.g].append((x.place, x.v))
    assert len(got) == 5000 and all([v for _, v in sorted(x)] == sorted(v for _, v in x) and sorted(p for p, _ in x) == list(range(len(x))) for x in groups.values())


@pytest.mark.parametrize("piece", [40, 1 << 20])
def test_digests(spark, piece, monkeypatch):
    """Groups within partitions, over several, over all; empty values; one row each."""
    monkeypatch.setattr(runs, "PIECE_BYTES", piece)
    rows = [(None if g == 0 else g, i, f"{i}" * (i % 3)) for g, n in enumerate([3, 700, 1, 2, 0, 900, 5, 1]) for i in range(n)]
    frame = spark.createDataFrame(rows, "g long, i long, v string").selectExpr("*", "cast(v AS binary) b", "1 AS one")
    frame = frame.repartitionByRange(9, "g", "i").sortWithinPartitions("g", "i")
    got = {x.g: (x.one, x.b) for x in runs.digests(frame, ["g"], ["b"], ["one"], b",").collect()}
    want = defaultdict(list)
    for g, _, v in rows:
        want[g].append(v)
    assert got == {g: (len(x), hashlib.sha256(",".join(x).encode()).hexdigest()) for g, x in want.items()}
