"""op11 against the tokenizers' libraries and plain sets of offsets."""

import hashlib
import os
import random
from collections import Counter

import public_tokenizers
import pytest

from folioscan.llm import alignment, queries

os.environ["TOKENIZERS_PARALLELISM"] = "false"
FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def plain(libraries, rows):
    """Rows as op11's, in the order given."""
    a, b = libraries
    of = alignment.byte_level()
    out, all_links = [], []
    for _, text in rows:
        found, groups = Counter(), []
        text = text or ""
        raw = (" " + text).encode()
        x = [(i, bytes(of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids] if text else []
        y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)] if text else []
        if b"".join(t for _, t in x) != raw or b"".join(t for _, t in y) != raw:
            x = y = []
        ends = [[0], [0]]
        for side, tokens in zip(ends, (x, y)):
            for _, t in tokens:
                side.append(side[-1] + len(t))
        places = [{e: k for k, e in enumerate(side)} for side in ends]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        for lo, hi in zip(cuts, cuts[1:]):
            own = [[t[0] for t in tokens[at[lo] : at[hi]]] for at, tokens in zip(places, (x, y))]
            groups.append(own)
            for i, m in Counter(own[0]).items():
                for j, n in Counter(own[1]).items():
                    found[i, j] += m * n
        written = ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups)
        out.append([len(x), len(y), len(groups), sum(found.values()), hashlib.sha256(written.encode()).hexdigest() if groups else ""])
        all_links.append(found)
    count = Counter(p for found in all_links for p in found)
    best = {}
    for (i, _), n in count.items():
        best[i] = max(best.get(i, 0), n)
    return [(d, *o[:4], sum(m for p, m in f.items() if count[p] == best[p[0]]), sum(m * count[p] for p, m in f.items()), o[4]) for (d, _), o, f in zip(rows, out, all_links)]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def same(spark, libraries, rows, docs=None):
    got = alignment.align(docs if docs is not None else spark.createDataFrame(rows, "doc_id long, text string").repartition(3), *FILES)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain(libraries, rows), key=str)


ODD = [" ", "  ", "\n", "\t", "\r", "a", "the", " the", "é", "中文", "😀", "▁", "<0x0A>", "<s>", "<|endoftext|>", "\x00", "123", "'ll", "!!", "　", "\xa0", "xyz" * 5, "ing", "è", "ﬁ"]


@pytest.mark.parametrize("pairs", [1 << 20, 40, 0])
def test_plain(spark, libraries, pairs, monkeypatch):
    """Whatever number of pairs is broadcast: all, some or none."""
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", pairs)
    r = random.Random(11)
    same(spark, libraries, [(i, "".join(r.choices(ODD, k=r.randint(0, 40)))) for i in range(300)])


def test_whole_table(spark, documents, plain_rows, libraries, sf_dir):
    got = queries.queries()["op11_align"](spark, sf_dir)
    assert sorted(map(tuple, got.select(*COLUMNS).collect()), key=str) == sorted(plain(libraries, plain_rows), key=str)


@pytest.fixture(scope="module")
def plain_rows(documents):
    return [(x.doc_id, x.text) for x in documents.select("doc_id", "text").collect()]


def test_edges(spark, nasty, empty, libraries):
    rows = [(x.doc_id, x.text) for x in nasty.collect()]
    same(spark, libraries, rows, nasty)
    assert alignment.align(empty, *FILES).collect() == []
    same(spark, libraries, [(1, None), (1, "")])
    assert alignment.align(nasty.limit(5).selectExpr("*", "1 AS step", "2 AS at", "3 AS pair"), *FILES).count() == 5


def test_groups(spark):
    (got,) = alignment.align(spark.createDataFrame([(1, "ab ab")], "doc_id long, text string"), *FILES, groups_too=True).collect()
    assert hashlib.sha256(got.groups.encode()).hexdigest() == got.groups_sha256 and got.groups.count(";") == got.n_groups - 1


def test_long_runs(spark, libraries):
    """Unbroken runs and very long texts take time by their length, not its square; 20,000 equal rows."""
    r = random.Random(5)
    texts = ["x" * 300_000, " " * 300_000 + "y", "ab" * 150_000, "".join(r.choice("abcdefghij") for _ in range(200_000)), "word and " * 150_000]
    got = {x.doc_id: x for x in alignment.align(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), *FILES).collect()}
    a, b = libraries
    assert all(got[i].n_a == len(a.encode(" " + t).ids) and got[i].n_b == len(b.encode(t)) for i, t in enumerate(texts) if got[i].n_a) and got[4].n_a
    same_rows = alignment.align(spark.range(20_000).selectExpr("5L AS doc_id", "'all of it' AS text"), *FILES).distinct().collect()
    assert len(same_rows) == 1 and same_rows[0].n_best == same_rows[0].n_links and same_rows[0].count_sum == 20_000 * same_rows[0].n_links


def test_groups_of():
    assert [x.tolist() for x in alignment.groups_of(alignment.np.array([2, 5, 6, 9]), alignment.np.array([1, 2, 6, 7, 9]))] == [[0, 1, 3], [0, 2, 3]]
