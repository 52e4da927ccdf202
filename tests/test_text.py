"""Published values, and operators against plain versions."""

import itertools
import random
import re

import math
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscan.functions import hashing, text
from folioscan.operators import dedup, impact, index, keywords, segment, spell
from folioscan.plans import archive, search


def test_jenkins():
    assert hashing.jenkins64("你好".encode()) == 17676873585679812141


def test_jenkins_column(spark):
    df = spark.createDataFrame([("你好",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(text.unsigned(hashing.jenkins64_column(F.col("t")))).collect()]
    assert got == ["17676873585679812141", None, str(hashing.jenkins64(b""))]


@pytest.mark.parametrize(("a", "b", "distance"), [("100010110110", "110001110011", 5), ("100010110110", "110010110111", 2)])
def test_hamming(spark, a, b, distance):
    x, y = (text.from_binary_string(F.lit(s)) for s in (a, b))
    got = spark.range(1).select(text.hamming(x, y), text.binary_string(x)).first()
    assert 3 < got[0] <= 5 if distance == 5 else got[0] <= 3
    assert got[1] == a.rjust(64, "0")


def test_fnv_and_key():
    assert hashing.fnv1a64(b"") == 0xCBF29CE484222325
    assert hashing.fnv1a64(b"a") == 0xAF63DC4C8601EC8C
    assert hashing.cache_key(3, "a") == "search:v3:af63dc4c8601ec8c"


def test_tokens_of_access(spark):
    token = hashing.sign_token({"sub": "u", "exp": 100}, "k")
    assert hashing.verify_token(token, "k", 99) == (True, "")
    assert hashing.verify_token(token, "k", 100) == (False, "expired")
    assert hashing.verify_token(token, "other", 1)[1] == "bad signature"
    assert hashing.verify_token("a.b", "k", 1)[1] == "malformed"
    claims = spark.createDataFrame([(token,)], "t string").select(hashing.claims_column(F.col("t"), "sub string, exp long").alias("c")).select("c.*").first()
    assert (claims["sub"], claims["exp"]) == ("u", 100)
    import hashlib

    made = hashlib.pbkdf2_hmac("sha256", b"pw", bytes.fromhex("00ff"), 10).hex()
    assert hashing.verify_password("pw", "00ff", made, 10) and not hashing.verify_password("no", "00ff", made, 10)


def test_text_rank_values():
    got = keywords.text_rank(["你好", "世界", "世界", "而且", "而且"], ["而且"])
    assert got["世界"] == pytest.approx(1) and got["你好"] == pytest.approx(0.519787, abs=1e-6)
    got = keywords.text_rank(["一部", "iPhone6"])
    assert got["一部"] == pytest.approx(1) and got["iPhone6"] == pytest.approx(0.996126, abs=1e-6)
    assert keywords.text_rank([]) == {} and keywords.text_rank(["word"]) == {"word": 0.0}


def plain_snippet(t, term):
    data, w = t.encode(), term.encode()
    if not data or not w:
        return ""
    inside = lambda i: i < len(data) and data[i] & 0xC0 == 0x80
    at = data.find(w)
    low = max(0, at - 24) if at >= 0 else 0
    while inside(low):
        low -= 1
    high = min(len(data), low + len(w) + 48) if at >= 0 else min(len(data), 48)
    while inside(high):
        high += 1 if at >= 0 else -1
    return "..." * (low > 0) + data[low:high].decode() + "..." * (high < len(data))


def test_snippet(spark):
    r = random.Random(1)
    made = ["".join(r.choice("aé肺😀 ") for _ in range(r.randint(0, 90))) for _ in range(400)]
    df = spark.createDataFrame([(t, w) for t in made for w in ("a", "肺", "é😀")], "t string, w string")
    for row in df.select("t", "w", text.snippet(F.col("t"), F.col("w")).alias("s")).collect():
        assert row.s == plain_snippet(row.t, row.w)


def test_scalars(spark):
    row = spark.createDataFrame([("19990231", "20240131", "x \0\0", "F", "Q")], "a string, b string, c string, d string, e string").select(
        text.dicom_date(F.col("a")), text.dicom_date(F.col("b")).cast("string"), text.trim_padding(F.col("c")), text.sex(F.col("d")), text.sex(F.col("e")), text.storage_path(F.lit("1"), F.lit("2"), F.lit("3")), text.masked(F.lit("s"))
    ).first()
    assert tuple(row) == (None, "2024-01-31", "x", "F", None, "1/2/3.dcm", "******")


def test_search_ngrams(spark):
    got = spark.createDataFrame([("abcd",), ("ab",), ("abc",)], "w string").select(text.search_ngrams(F.col("w"))).collect()
    assert [r[0] for r in got] == [["ab", "bc", "cd", "abc", "bcd", "abcd"], ["ab"], ["ab", "bc", "abc"]]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = list(itertools.accumulate(zip(row, row[1:], b), lambda left, c: min(left + 1, c[1] + 1, c[0] + (x != c[2])), initial=i))
    return row[-1]


def test_spelling_equals_all_pairs(spark):
    r = random.Random(4)
    words = sorted({"".join(r.choice("ab肺") for _ in range(r.randint(1, 6))) for _ in range(150)})
    terms = spark.createDataFrame([(w, 1) for w in words], "term string, freq long")
    asked = [*words[::9], "肺节结"]
    got = {(x.query, x.term, x.distance) for x in spell.within_distance(spark.createDataFrame([(w,) for w in asked], "query string"), spell.variants(terms)).collect()}
    assert got == {(q, w, d) for q in asked for w in words if (d := distance(q, w)) <= 2}


def test_spelling_of_long_words(spark):
    """Signatures do not grow in number with a word, so words of any length have suggestions; lengths 3 to 12 too."""
    r = random.Random(14)
    long = "".join(r.choice("abcd") for _ in range(10_000))
    words = [long, long[:4_000] + "x" + long[4_000:], long[:-3], *("".join(r.choice("ab") for _ in range(r.randint(3, 12))) for _ in range(300))]
    terms = spark.createDataFrame([(w, 1) for w in set(words)], "term string, freq long")
    known = spell.variants(terms)
    assert known.groupBy("term").count().agg(F.max("count")).first()[0] <= 11
    asked = [long[:9] + long[10:], *words[3:40]]
    got = {(x.query, x.term, x.distance) for x in spell.within_distance(spark.createDataFrame([(w,) for w in asked], "query string"), known).collect()}
    assert {(q[:12], t[:12], len(t), d) for q, t, d in got if len(q) > 12} == {(asked[0][:12], long[:12], 10_000, 1), (asked[0][:12], long[:12], 10_001, 2)}
    assert {x for x in got if len(x[0]) <= 12} == {(q, w, d) for q in asked[1:] for w in set(words) if abs(len(q) - len(w)) <= 2 and (d := distance(q, w)) <= 2}


@pytest.mark.parametrize("documents, first", [(256, 8), (8, 2)])
def test_pruned_search(spark, documents, first, monkeypatch):
    """The hits of scoring everything, ties included, of few and many queries, from fewer postings."""
    monkeypatch.setattr(impact, "FIRST_DOCUMENTS", first)
    r = random.Random(7)
    hot = ["the", "of", "and"]
    texts = [" ".join(r.choices(hot, k=r.randint(1, 60)) + r.choices([f"w{i}" for i in range(80)], k=r.randint(1, 60))) for _ in range(300)] + ["the w1 w2"] * 9 + [None, "", "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    built = index.build(docs, {"text": 1})
    queries = spark.createDataFrame([(0, "the of w1"), (1, "w2 w2 w3 and"), (2, "none at all"), (3, None), (4, "the"), (5, "w1 w2 the")], "qid int, query string")
    asked = impact.Search(impact.blocks(built, documents=documents).cache(), queries, len(texts), 5)
    want = {tuple(x) for x in index.search(built, queries, len(texts), 5).select("qid", "doc_id", "score", "rank").collect()}
    assert {tuple(x) for x in asked.hits().select("qid", "doc_id", "score", "rank").collect()} == want and len(want) == 20
    work = asked.work().collect()
    assert all(x.n_read <= x.n_postings and x.n_blocks_read <= x.n_blocks for x in work)
    if documents == 8:
        assert sum(x.n_read for x in work) < 0.3 * sum(x.n_postings for x in work)


def test_suggest_merges_and_orders(spark):
    terms = spark.createDataFrame([("肺结节", 2), ("肺结节", 3), ("肺结", 4), ("骨折", 9)], "term string, freq long")
    got = spell.suggest(spark.createDataFrame([("肺节结",)], "query string"), terms).orderBy("rank").collect()
    assert [(x.term, x.distance, x.freq) for x in got] == [("肺结", 1, 4), ("肺结节", 2, 5)]


def test_blocks_grow_with_the_fingerprints():
    assert [dedup.blocks_for(n) for n in (0, 10, 1 << 16, (1 << 16) + 1, 1 << 25, 10**9, 10**11, 10**18)] == [4, 4, 4, 5, 5, 6, 8, 9]
    assert all(sum(dedup._masks(m, 3)) and len(set(dedup._masks(m, 3))) == math.comb(m, 3) for m in range(4, 9))


@pytest.mark.parametrize("blocks", [None, 5, 6])
def test_near_pairs_equal_all_pairs(spark, blocks):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(30)]
    fps = [b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(8)]
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {(x.a, x.b, x.distance) for x in dedup.near_pairs(spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long"), blocks=blocks).collect()}
    first = {}
    for i, f in enumerate(fps):
        first.setdefault(f, i)
    assert got == {(min(i, j), max(i, j), (a ^ b).bit_count()) for (a, i), (b, j) in itertools.combinations(first.items(), 2) if (a ^ b).bit_count() <= 3}


def test_search_rules(spark):
    docs = spark.createDataFrame([(1, "lung nodule common"), (2, "bone fracture common"), (3, "lung cyst common")], "doc_id long, text string")
    built = index.build(docs, {"text": 1})
    asked = spark.createDataFrame([(1, "lung nodule"), (2, "common"), (3, "unknown"), (4, "")], "qid long, query string")
    got = index.search(built, asked, 3, 2).orderBy("qid", "rank").collect()
    assert [(x.qid, x.doc_id) for x in got] == [(1, 1), (1, 3)]  # a term of every document weighs nothing
    assert index.search(built, asked, 3, 0).count() == 0


DICT = segment.Dictionary({"南京": 5, "南京市": 4, "长江": 5, "大桥": 5, "长江大桥": 6, "市长": 2}, {"南京": "ns"})


def test_segmentation():
    assert segment.hidden_markov("IBM,1.2,123", None) == ["IBM", ",", "1.2", ",", "123"]
    assert segment.most_probable("南京市长江大桥", DICT) == ["南京市", "长江大桥"]
    assert segment.most_probable("南京市长江大桥", DICT, 2) == ["南京", "市", "长江", "大桥"]
    for mode in ("mix", "mp", "full", "search"):
        assert max(map(len, segment.segment("南京市长江大桥", DICT, mode, longest=2))) == 2 and "长江大桥" in segment.segment("南京市长江大桥", DICT, mode)
    assert segment.for_search("长江大桥", DICT) == ["长江", "大桥", "长江大桥"]
    assert set(segment.full("南京市长江", DICT)) == {"南京", "南京市", "市长", "长江"}
    assert segment.segment("南京，长江 x", DICT) == ["南京", "，", "长江", " ", "x"]
    assert "云计算" in DICT.insert("云计算").weight and "南京" not in DICT.delete("南京").weight and "南京市" in DICT.delete("南京").weight


def test_segmentation_by_states():
    big, small = 0.0, -50.0
    hmm = segment.Hmm([-0.1, small, small, -2], [[small, big, -3, small], [-0.5, small, small, -1], [small, -0.2, -2, small], [-0.5, small, small, -1]], [{"你": -1, "世": -1}, {"好": -1, "界": -1}, {}, {"的": -1}])
    assert segment.hidden_markov("你好的世界abc", hmm) == ["你好", "的", "世界", "abc"]


def test_dictionary_lines():
    d = segment.read_dictionary(["南京 5 ns", "坏行", "长江 4 ns"], ["云计算", "蓝翔 nz", "区块 10 n"], "max")
    assert d.tags["蓝翔"] == "nz" and d.weight["云计算"] == max(d.weight[w] for w in ("南京", "长江"))


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="南京市长江大桥ab1. ，", max_size=20))
def test_modes_keep_text(t):
    for mode in ("mix", "mp", "hmm"):
        assert "".join(segment.segment(t, DICT, mode)) == t


def test_tags(spark):
    words = spark.createDataFrame([("南京",), ("12",), ("abc",), ("肺",), ("a1肺肺",), ("x",)], "word string")
    got = {r.word: r.tag for r in keywords.tagged(words, spark.createDataFrame([("南京", "ns")], "word string, tag string")).collect()}
    assert got == {"南京": "ns", "12": "m", "abc": "eng", "肺": "x", "a1肺肺": "eng", "x": "x"}


def test_unique_adjacent(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(["a", "a", None, None, "b", "a"])], "k int, i int, v string")
    assert [r.v for r in dedup.unique_adjacent(df, ["k"], ["i"], "v").orderBy("i").collect()] == ["a", None, "b", "a"]


def test_user_words_with_a_frequency():
    d = segment.read_dictionary(["南京 60 ns", "长江 30 ns", "云 10 n"], ["区块 10 n", "云计算 5", "蓝翔 nz", "工具"])
    assert d.weight["区块"] == pytest.approx(math.log(10 / 100)) and d.weight["云计算"] == pytest.approx(math.log(5 / 100))
    assert d.weight["蓝翔"] == d.weight["工具"] == pytest.approx(math.log(30 / 100)) and (d.tags["区块"], d.tags["蓝翔"], d.tags["工具"]) == ("n", "nz", "")
    more = d.insert("长江学者", "n", 20)
    assert more.weight["长江学者"] == pytest.approx(math.log(20 / 100)) and "长江学者" not in d.weight and "长江学者" not in more.delete("长江学者").weight
    assert segment.segment("长江学者云计算", more) == ["长江学者", "云计算"]


def test_modes_on_one_text():
    """The same text in every mode, by a dictionary where the modes differ."""
    d = segment.Dictionary({"我": 50, "来到": 20, "北京": 30, "清华": 8, "清华大学": 10, "华大": 3, "大学": 20, "杭研": 2})
    text = "我来到北京清华大学"
    assert segment.segment(text, d, "mp") == segment.segment(text, d, "mix") == ["我", "来到", "北京", "清华大学"]
    assert segment.segment(text, d, "full") == ["我", "来到", "北京", "清华", "清华大学", "华大", "大学"]
    assert segment.segment(text, d, "search") == ["我", "来到", "北京", "清华", "华大", "大学", "清华大学"]
    assert segment.segment(text, d, "hmm") == list(text)
    assert segment.segment("，。 ", d) == ["，", "。", " "] and segment.segment("", d) == []


def test_terms_are_counted_in_their_rows(spark):
    """No shuffle of words, and rows that share an id, or have none, are counted together."""
    one = index.term_frequencies(spark.createDataFrame([(1, "aa bb aa"), (2, None), (3, "")], "doc_id long, text string"), {"text": 2})
    assert {tuple(x) for x in one.collect()} == {(1, "aa", 4), (1, "bb", 2)}
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    many = index.term_frequencies(spark.createDataFrame([(1, "aa bb aa"), (1, "bb"), (None, "cc"), (None, "cc dd"), (2, "aa")], "doc_id long, text string"), {"text": 1})
    assert {tuple(x) for x in many.collect()} == {(1, "aa", 2), (1, "bb", 2), (None, "cc", 2), (None, "dd", 1), (2, "aa", 1)}


@pytest.mark.parametrize(("most", "hot"), [(1000, 1000), (1000, 2), (0, 1000), (0, 2)])
def test_texts_of_shared_ids_are_dealt_not_terms(spark, most, hot):
    """However many ids are shared, and by however many rows; terms are dealt for ids of too many rows alone."""
    rows = [(1, "aa bb aa"), (1, "bb"), (1, None), (None, "cc"), (None, "cc dd"), (2, "aa"), (3, ""), (3, "ee ee")]
    got = index.term_frequencies(spark.createDataFrame(rows, "doc_id long, text string"), {"text": 3}, most=most, hot=hot)
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame([(1, "aa", 6), (1, "bb", 6), (None, "cc", 6), (None, "dd", 3), (2, "aa", 3), (3, "ee", 6)], "doc_id long, term string, tf long").collect()))
    dealt = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in x and "term" in x.split("hashpartitioning")[1]]
    assert bool(dealt) == (hot == 2)


def test_search_of_weights_and_norms(spark):
    """Stored weights before normalisation give the hits of normalised ones, in all postings and by blocks."""
    r = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(r.choices([f"w{k}" for k in range(40)], k=r.randint(1, 30)))) for i in range(200)], "doc_id long, text string")
    queries = spark.createDataFrame([(0, "w1 w2 w2"), (1, "w7"), (2, "none")], "qid int, query string")
    want = {tuple(x) for x in index.search(index.build(docs, {"text": 1}), queries, 200, 5).select("qid", "doc_id", "score", "rank").collect()}
    plain = index.postings(index.term_frequencies(docs, {"text": 1}), 200)
    norms = index.norms(plain)
    dealt = impact.parts(norms)
    by_blocks = impact.search(impact.blocks(plain, dealt=dealt), queries, 200, 5, dealt=dealt)
    found = index.search(plain, queries, 200, 5, norms=norms)
    assert all({tuple(x) for x in got.select("qid", "doc_id", "score", "rank").collect()} == want for got in (found, by_blocks)) and len(want) == 10
    found.collect()  # no pairs of query and document are shuffled but the best
    dealt_by = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in x]
    assert dealt_by and not any("qid#" in x and "doc_id#" in x for x in dealt_by)


def test_counted_as_segmented(spark):
    d = replace(DICT, hmm=segment.Hmm([-0.3, segment.IMPOSSIBLE, segment.IMPOSSIBLE, -1.4], [[-1.0] * 4] * 4, [{}, {}, {}, {}]))
    texts = ["南京市长江大桥 abc12 x", "", None, "南京 南京，大桥\n" + "y" * 100]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    modes = {f"n_{m}": (m, None) for m in segment.MODES} | {"n_short": ("mp", 2)}
    got = [tuple(x.n) for x in df.select(segment.counted(F.col("text"), d, modes).alias("n")).collect()]
    assert got == [tuple(None if t is None else len(segment.segment(t, d, m, longest=k)) for m, k in modes.values()) for t in texts]


def test_rounded_by_the_double(spark):
    """0.16695 is a double below its decimal text, so SQL on doubles rounds it down."""
    got = spark.createDataFrame([(0.16695,), (0.00004,), (0.00006,), (1.0,)], "x double").select(index.rounded(F.col("x"), 4)).collect()
    assert [x[0] for x in got] == [0.1669, 0.0, 0.0001, 1.0]


def test_jenkins_of_many():
    values = ["x" * n for n in range(40)] + ["ä" * 7, "肺结节"]
    assert hashing.jenkins64_many([v.encode() for v in values]).tolist() == [hashing.jenkins64(v.encode()) for v in values]


def test_simhash_jenkins_deals_no_words(spark):
    terms = index.term_frequencies(spark.createDataFrame([(1, "aa bb"), (2, "cc")], "doc_id long, text string"), {"text": 1})
    plan = dedup.simhash_jenkins(terms)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and "term" not in next(x for x in plan.splitlines() if "hashpartitioning" in x).split("hashpartitioning")[1]


def _segments(spark, tmp_path, n=200):
    """Counts of n documents as tasks write them, document frequencies, and norms."""
    r = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(r.choices([f"w{k}" for k in range(40)], k=r.randint(1, 30)))) for i in range(n)], "doc_id long, text string")
    index.term_frequencies(docs, {"text": 1}).withColumn("segment", F.spark_partition_id()).sortWithinPartitions("term").write.parquet(f"{tmp_path}/tf")
    tf = spark.read.parquet(f"{tmp_path}/tf")
    index.document_frequencies(tf).write.parquet(f"{tmp_path}/dfs")
    dfs = spark.read.parquet(f"{tmp_path}/dfs")
    return docs, tf, dfs, index.norms(index.looked_up(tf, dfs).withColumn("weight", F.col("tf") * index.idf(F.col("df"), n)))


def test_blocks_of_segments_shuffle_nothing(spark, tmp_path):
    """Blocks within the tasks that wrote their postings give the hits of scoring everything, and are made without a shuffle."""
    docs, tf, dfs, norms = _segments(spark, tmp_path)
    queries = spark.createDataFrame([(0, "w1 w2 w2"), (1, "w7"), (2, "none")], "qid int, query string")
    want = {tuple(x) for x in index.search(index.build(docs, {"text": 1}), queries, 200, 5).select("qid", "doc_id", "score", "rank").collect()}
    dealt = impact.parts(norms, documents=8)
    made = impact.segment_blocks(tf, dealt)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not any("term#" in x for x in plan.splitlines() if "hashpartitioning" in x or "rangepartitioning" in x)
    rows = made.select("term", "part", "n", F.size("docs").alias("size")).collect()
    assert len(rows) > 40 and all(x.n == x.size for x in rows) and sum(x.n for x in rows) == tf.join(norms.where("norm > 0"), "doc_id").count()
    asked = impact.Search(made, queries, 200, 5, dealt=dealt, dfs=dfs)
    assert {tuple(x) for x in asked.hits().select("qid", "doc_id", "score", "rank").collect()} == want and len(want) == 10
    assert all(0 < x.n_read <= x.n_postings and x.n_blocks_read <= x.n_blocks for x in asked.work().collect())


def test_search_of_counts(spark, tmp_path):
    """Counts, with document frequencies beside them, give the hits of normalised weights."""
    docs, tf, dfs, norms = _segments(spark, tmp_path)
    queries = spark.createDataFrame([(0, "w1 w2 w2"), (1, "w7"), (2, "none")], "qid int, query string")
    want = {tuple(x) for x in index.search(index.build(docs, {"text": 1}), queries, 200, 5).select("qid", "doc_id", "score", "rank").collect()}
    assert {tuple(x) for x in index.search(tf, queries, 200, 5, norms=norms, dfs=dfs).select("qid", "doc_id", "score", "rank").collect()} == want and len(want) == 10


@pytest.mark.parametrize("most", [0, 7, 1000])
def test_looked_up(spark, most):
    """All, some and no terms by a shuffle give the same; terms that the table lacks stay."""
    tf = spark.createDataFrame([(d, f"w{k}", 1) for d in range(30) for k in range(d + 1)], "doc_id long, term string, tf long")
    terms = index.document_frequencies(tf).where("term <> 'w3'")
    got = {(x.doc_id, x.term, x.df) for x in index.looked_up(tf, terms, most).collect()}
    assert got == {(d, f"w{k}", None if k == 3 else 30 - k) for d in range(30) for k in range(d + 1)}


def test_keywords_of_frequent_terms_are_ranked_where_they_stand(spark):
    tf = index.term_frequencies(spark.createDataFrame([(i, f"aa bb w{i % 3} X{i} X{i}") for i in range(9)], "doc_id long, text string"), {"text": 1})
    known = index.document_frequencies(tf).select("term", "df", F.when(~F.rlike("term", F.lit("[A-Z]")), index.idf(F.col("df"), 9)).alias("idf"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, want = keywords.top_keywords(tf, known, 2), keywords.top_keywords(tf, known.where("idf IS NOT NULL").drop("df"), 2)
        assert {tuple(x) for x in got.collect()} == {tuple(x) for x in want.collect()} and got.count() == 18
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def _shuffled(spark):
    """Records that all stages of the session have shuffled."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none, gateway = spark.sparkContext._jvm.java.util.ArrayList(), spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("query", ["search_topk", "search_batch_topk", "search_results_json"])
def test_searches_deal_no_terms_of_shared_ids(spark, tmp_path, query):
    """The index of texts that share ids shuffles these texts, not each of their terms."""
    r = random.Random(7)
    texts = [r.sample([f"w{k}" for k in range(30)], 20) + ["the"] * (k % 9 == 0) for k in range(200)]
    spark.createDataFrame([(k // 2, " ".join(x), "en", "web") for k, x in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "the w1")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = _shuffled(spark)
    assert getattr(search, query)(spark, str(tmp_path)).count() > 0
    assert _shuffled(spark) - before < sum(len(set(a + b)) for a, b in zip(texts[::2], texts[1::2]))


@pytest.fixture
def shared_ids(spark, tmp_path):
    """Documents of which several share an id or have none."""
    rows = [(1, "aa bb aa"), (1, "bb cc"), (2, "aa bb"), (2, "aa bb cc"), (3, "dd"), (None, "ee"), (None, "ee ff"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def _dealt(df):
    return [x.split("hashpartitioning")[1] for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in x]


def test_simhash64_deals_votes_alone(spark, shared_ids):
    """Rows that share an id are voted for together, without dealing their words."""
    docs = spark.createDataFrame([(1, "aa bb aa bb cc"), (2, "aa bb aa bb cc"), (3, "dd"), (None, "ee ee ff")], "doc_id long, text string")
    want = dedup.simhash(index.term_frequencies(docs, {"text": 1})).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fp"))
    got = archive.simhash64(spark, shared_ids)
    assert len(_dealt(got)) == 1 and "term" not in _dealt(got)[0]
    assert {tuple(x) for x in got.collect()} == {tuple(x) for x in want.collect()}


def test_near_duplicate_pairs_read_stored_fingerprints(spark, shared_ids):
    """In place of the documents twice."""
    pairs = archive.near_duplicate_pairs(spark, shared_ids)
    assert "documents.parquet" not in " ".join(pairs.inputFiles()) and "term" not in " ".join(_dealt(pairs))
    assert pairs.collect() == []


def test_near_duplicate_classes_deal_no_words(spark, shared_ids):
    classes = archive.near_duplicate_classes(spark, shared_ids)
    assert "term" not in " ".join(_dealt(classes))
    assert {tuple(x) for x in classes.collect()} == {(1, 1), (2, 1), (3, 3), (None, None)}


@pytest.fixture
def searched(spark, tmp_path):
    """80 documents and 5 queries that all of them score for."""
    r = random.Random(8)
    spark.createDataFrame([(k, " ".join(r.sample([f"w{i}" for i in range(30)], 20) + ["the"] * (k % 2))) for k in range(80)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(k, k + 20))) for k in range(5)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("query", ["search_batch_topk", "search_results_json"])
def test_scores_of_a_task_are_bounded(spark, searched, monkeypatch, query):
    """By the number of tasks, whatever the session's partitions are; and they are not sorted to meet the norms."""
    want = getattr(search, query)(spark, searched).collect()
    monkeypatch.setattr(index, "TASK_SCORES", 20, raising=False)
    got = getattr(search, query)(spark, searched)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Exchange hashpartitioning\(doc_id#\d+L?, 20\), REPARTITION_BY_NUM", plan) and "ShuffledHashJoin [doc_id" in plan
    assert len(want) and set(map(str, got.collect())) == set(map(str, want))


def test_near_duplicate_classes_read_stored_fingerprints(spark, shared_ids):
    """Of which each is made once, in place of once for its class and once for its row."""
    classes = archive.near_duplicate_classes(spark, shared_ids)
    assert "documents.parquet" not in " ".join(classes.inputFiles()) and "sum(" not in classes._jdf.queryExecution().executedPlan().toString()
    assert {tuple(x) for x in classes.collect()} == {(1, 1), (2, 1), (3, 3), (None, None)}
