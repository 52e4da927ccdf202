"""Cases that a part of the job would pass over."""

import itertools
import random

import pytest

from folioscan.llm import chunking, minhash


def shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def components(sets):
    name = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and name[a] != name[b]:
            low, high = sorted((name[a], name[b]))
            name = {i: low if x == high else x for i, x in name.items()}
    return name


@pytest.mark.parametrize("pairs, crowd", [(minhash.PAIRS, minhash.CROWD), (2, minhash.CROWD), (2, 12)])
def test_similar_by_five_words(spark, monkeypatch, pairs, crowd):
    """Copies with a block appended or a tail replaced, just at and just below the similarity; a chain and a crowd."""
    monkeypatch.setattr(minhash, "PAIRS", pairs)
    monkeypatch.setattr(minhash, "CROWD", crowd)
    r = random.Random(12)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    weights = [1 / (k + 1) for k in range(len(words))]
    make = lambda n: r.choices(words, weights, k=n)
    docs = []
    for k in range(120):
        n = r.choice([60, 200, 600])
        base, share = make(n), r.choice([0.76, 0.8, 0.82, 0.85, 0.9])
        docs.append(base)
        docs.append(base + make(int(n * (1 / share - 1))) if k % 2 else base[: int(n * 2 * share / (1 + share))] + make(n - int(n * 2 * share / (1 + share))))
    chain = make(300)
    for k in range(10):
        docs.append(chain[20 * k :] + make(20 * k))
    crowd = make(300)
    for _ in range(60):
        own = list(crowd)
        own[r.randrange(300)] = "own"
        docs.append(own)
    table = [(i, " ".join(d)) for i, d in enumerate(docs)]
    got = {x.doc_id: x.component_id for x in minhash.similar_documents(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    want = components({i: shingles(t) for i, t in table})
    assert sum(i != x for i, x in want.items()) > 120 and got == want


def test_similar_alone(spark):
    """A document that is a step of its own, as a very long one is."""
    got = minhash.similar_documents(spark.createDataFrame([(3, "one two three four five six")], "doc_id long, text string")).collect()
    assert [(x.doc_id, x.component_id) for x in got] == [(3, 3)]


def test_every_repeated_chunk(spark):
    """Short whole copies count; a short end that agrees by chance is no passage."""
    docs = [(1, "ok then"), (2, "ok then"), (3, "A short text of less than 96 bytes, é."), (4, "A short text of less than 96 bytes, é."), (5, "another one")]
    r = random.Random(4)
    docs += [(100 + i, "".join(r.choice("abcdefgh ") for _ in range(r.randint(100, 400))) + "\n") for i in range(200)]
    got = {x.doc_id: x for x in chunking.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {i: (x.n_shared, x.n_removed, x.spans) for i, x in got.items() if x.n_passage} == {1: (7, 0, ""), 2: (7, 7, "0:7"), 3: (39, 0, ""), 4: (39, 39, "0:39")}
    assert set(got) == {i for i, _ in docs}


def plain_chunks(text):
    """Cuts by the definition, one byte at a time."""
    raw = text.encode()
    h = [sum(int(chunking._GEAR[raw[i - k]]) << 4 * k for k in range(min(16, i + 1))) % (1 << 64) for i in range(len(raw))]
    starts = lambda p: p == len(raw) or raw[p] & 0xC0 != 0x80
    at, out = 0, []
    while len(raw) - at > 0:
        rest = range(at + chunking.LEAST, min(at + chunking.MOST, len(raw) - 1) + 1)
        cut = next((p for p in rest if p >= 16 and starts(p) and h[p - 1] >> 60 == 0), None)
        if cut is None and len(raw) - at > chunking.MOST:
            cut = min((p for p in range(at + chunking.LEAST, at + chunking.MOST + 1) if starts(p)), key=lambda p: h[p - 1])
        out.append((at, cut or len(raw)))
        at = cut or len(raw)
    if len(out) > 1 and out[-1][1] - out[-1][0] < chunking.LEAST:
        (a, b), (_, c) = out[-2], out[-1]
        if c - a <= chunking.MOST:
            out[-2:] = [(a, c)]
        else:
            b = c - chunking.LEAST
            while not starts(b):
                b -= 1
            out[-2:] = [(a, b), (b, c)]
    return [(a, b, raw[a:b]) for a, b in out]


def test_passages_by_definition(spark, plain):
    """Every chunk of every text against a dictionary of all of them, with repeated ids and rows without one."""
    docs = [(i, t) for i, t in plain] + [(5, "An unrelated text under an id that another text has, " * 3), (5, plain[7][1]), (None, plain[9][1]), (None, "alone")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    held = {}
    for n, (_, t) in enumerate(docs):
        for a, b, x in plain_chunks(t):
            held.setdefault(x, set()).add((n, a))
    got = chunking.repeated_passages(table).collect()
    assert len(got) == len(set(docs))
    shared = sorted((str(docs[n][0]), sum(b - a for a, b, x in plain_chunks(docs[n][1]) if len(held[x]) > 1)) for n in range(len(docs)))
    assert sorted((str(x.doc_id), x.n_shared) for x in got) == shared
    kept = sum(len(x) for x, places in held.items() if len(places) > 1)
    assert sum(x.n_shared - x.n_removed for x in got) >= kept
    left = chunking.without_spans(table, chunking.repeated_passages(table)).collect()
    assert docs[len(plain)] in {(x.doc_id, x.text) for x in left}  # the unrelated text stays whole
    once = {x for x in held if len(x) >= chunking.PASSAGE}
    assert all(any(x.decode() in y.text for y in left) for x in once)


def test_passage_recall(spark):
    """Passages of 51 words put into two texts each: nearly all are found as passages."""
    r = random.Random(21)
    words = ["".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 9))) for _ in range(5000)]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs = [(2 * i + side, f"{make(r.randint(20, 60))} {p} {make(r.randint(20, 60))}") for i, p in enumerate(make(51) for _ in range(1000)) for side in (0, 1)]
    got = {x.doc_id: x.n_passage for x in chunking.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(got[i] > 0 for i, _ in docs) >= 0.99 * len(docs)
