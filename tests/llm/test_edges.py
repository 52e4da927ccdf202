"""Every operator on difficult tables and on empty ones: no crash, and one row for each row where that is promised."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from folioscan.llm import bpe, chunking, decontaminate, langid, minhash, pii, quality, rules, secrets, simhash, suffixes

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2 if i != 4 else None, 0) for i in range(12)] + [(None, 1, 0), (7, 0, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "Same text here for all of us to read and read again today"), (2, None), (3, ""), (4, "too short"), (None, "some item without an id at all here")], "item_id long, text string")


WHOLE = {
    "rules": lambda d, b, q: rules.clean_lines(d), "simhash": lambda d, b, q: simhash.near_duplicates(d), "similar": lambda d, b, q: minhash.similar_documents(d), "pii": lambda d, b, q: pii.digests(d), "pii_text": lambda d, b, q: pii.sanitised(d),
    "secrets": lambda d, b, q: secrets.digests(d), "quality": lambda d, b, q: quality.classify(d, q), "cut": lambda d, b, q: chunking.without_spans(d, chunking.repeated_passages(d)), "language": lambda d, b, q: langid.predict_language(d), "suffixes": lambda d, b, q: suffixes.without_repeats(d, texts_too=True),
    "bpe": lambda d, b, q: bpe.encode_digests(d, RANKS), "bpe_text": lambda d, b, q: bpe.encode_documents(d, RANKS),
}
PART = {"decontaminate": lambda d, b, q: decontaminate.contaminated(d, b), "chunks": lambda d, b, q: chunking.repeated_passages(d), "kept": lambda d, b, q: quality.kept_documents(d, q), "clean": lambda d, b, q: decontaminate.decontaminated(d, b)}


@pytest.mark.parametrize("name", WHOLE)
def test_whole(nasty, empty, benchmark, labels, name):
    got = WHOLE[name](nasty, benchmark, labels)
    assert len(got.collect()) == nasty.count()
    assert WHOLE[name](empty, benchmark, labels).collect() == []


@pytest.mark.parametrize("name", PART)
def test_part(nasty, empty, benchmark, labels, name):
    assert PART[name](nasty, benchmark, labels).count() <= nasty.count()
    assert PART[name](empty, benchmark, labels).collect() == []


def test_without_help(nasty, benchmark, labels):
    """Nothing to learn from, nothing to hold against."""
    assert decontaminate.contaminated(nasty, benchmark.limit(0)).collect() == []
    assert {r.score for r in quality.classify(nasty, labels.limit(0)).collect()} == {0.5}
    assert {r.lang_pred for r in langid.identify(nasty, {}).collect()} == {"und"}


def test_defined_results(nasty, benchmark, labels):
    by = lambda df, **k: {r.doc_id: r for r in df.collect() if r.doc_id is not None}
    got = by(simhash.near_duplicates(nasty))
    assert got[0].fp == got[1].fp == got[2].fp == 0 and got[2].component_id == 0
    assert got[9].component_id == got[8].component_id == 8 and got[11].component_id == got[10].component_id
    got = by(suffixes.without_repeats(nasty))
    assert got[8].n_removed == got[8].n_bytes > 0 and got[10].n_removed == 0 and got[12].n_removed == 40_000 and got[0].n_bytes == 0
    got = by(rules.clean_lines(nasty))
    assert got[0].base_failed and got[0].n_words == 0 and got[13].n_words == 1
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(nasty, benchmark).collect()} == {(10, 1), (11, 1)}
    got = by(langid.predict_language(nasty))
    assert got[0].lang_pred == got[1].lang_pred == got[16].lang_pred == "und" and got[9].lang_pred == "en"
    got = by(pii.digests(nasty))
    assert "email:" in got[17].spans and got[17].n_email == 1 and got[0].spans == "" and got[14].spans == ""
    got = by(secrets.digests(nasty))
    assert (got[17].n_assign, got[17].n_hex, got[13].n_hex) == (1, 1, 1)
    got = by(chunking.repeated_passages(nasty))
    assert {8, 9} <= set(got) and got[8].n_removed < got[9].n_removed
    text = {r.doc_id: r.text for r in pii.sanitised(nasty).collect() if r.doc_id is not None}
    assert text[17].endswith("[EMAIL]") and text[0] is None and text[1] == ""


def stages():
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, labels, benchmark, tmp_path_factory):
    """labels and benchmark where the pipeline's stages look for them."""
    where = tmp_path_factory.mktemp("tables")
    labels.write.parquet(str(where / "labels.parquet"))
    benchmark.write.parquet(str(where / "benchmark.parquet"))
    return str(where)


@pytest.mark.parametrize("name", ["quality", "near_dedup", "decontamination", "personal_data", "tokens"])
def test_stages(spark, nasty, empty, folder, name):
    """Clashing columns (and names that the stages use themselves), nulls, repeated ids; an empty table."""
    clash = nasty.selectExpr("*", "1 AS k1", "2 AS k2", "3 AS _key", "4 AS _id", "5 AS _row", "6 AS _spans", "'t' AS terms", "7 AS of1", "8 AS rep", "'w' AS words", "9L AS n_chars")
    got = stages()[name](spark, clash, folder)
    rows = got.collect()
    assert stages()[name](spark, clash.where("doc_id < -1"), folder).collect() == []
    if name == "tokens":
        assert len(rows) == nasty.count()
    else:
        assert got.columns == clash.columns and all((r.k1, r._key, r._spans, r.terms, r.rep) == (1, 3, 6, "t", 8) for r in rows)
    if name == "near_dedup":
        texts = [(r.doc_id, r.text) for r in rows]
        assert (8, nasty.where("doc_id = 8").first().text) in texts and 9 not in [i for i, _ in texts] and 11 not in [i for i, _ in texts]
        assert (3, "a") in texts and any(i is None and t for i, t in texts) and len(texts) == len(set(texts))
    if name == "decontamination":
        assert {10, 11}.isdisjoint(r.doc_id for r in rows) and len(rows) == nasty.count() - 2


def test_rows_of_one_id(spark):
    """Rows that share a doc_id, or have none, are judged by their own text."""
    r = random.Random(3)
    make = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    one, two, three, item = make(120), make(90), make(80), make(30)
    docs = spark.createDataFrame([(1, one), (5, one), (5, two), (5, two), (None, three), (None, one), (7, two + " " + item), (5, three + " " + item), (None, item)], "doc_id long, text string")
    kept = sorted(((x.doc_id or -1, x.text) for x in minhash.first_of_similar(docs.where("text not like '%" + item + "'")).collect()), key=str)
    assert kept == sorted([(1, one), (5, two), (-1, three)], key=str)
    clean = decontaminate.decontaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted((x.doc_id or -1, x.text) for x in clean) == sorted([(1, one), (5, one), (5, two), (5, two), (-1, three), (-1, one)])
    left = chunking.without_spans(docs, chunking.repeated_passages(docs)).collect()
    assert (1, one) in {(x.doc_id, x.text) for x in left} and sum(x.text == two for x in left) >= 1
    got = suffixes.without_repeats(docs.unionByName(spark.createDataFrame([(5, make(100)), (None, make(100))], docs.schema))).collect()
    assert sorted(x.n_removed for x in got)[:3] == [0, 0, 0] or min(x.n_removed for x in got) == 0
    mail = spark.createDataFrame([(1, "see a@b.org now"), (1, "nothing in it"), (None, "c@d.org"), (None, "plain")], "doc_id long, text string")
    assert sorted(x.text for x in pii.sanitised(mail).collect()) == ["[EMAIL]", "nothing in it", "plain", "see [EMAIL] now"]


@pytest.mark.parametrize("id", ["id", "7L", "CAST(NULL AS long)"])
def test_many_equal_rows_in_the_suffix_operator(spark, id):
    """Thousands of rows of one text, with ids of their own, one id, or none: linear, and all bytes go."""
    text = "".join(random.Random(2).choice("abcdefgh ") for _ in range(420))
    rows = suffixes.without_repeats(spark.range(12_000).selectExpr(f"{id} AS doc_id", f"'{text}' AS text"))
    (got,) = rows.groupBy("n_bytes", "n_removed", "n_spans").count().collect()
    assert tuple(got) == (420, 420, 1, 12_000)


def test_many_entities_in_one_text(spark):
    """A hundred thousand addresses in one text: places, digests and the sanitised text, in time that grows with them."""
    n = 100_000
    text = "".join(f"é{i % 10} u{i}@ab.org; " if i % 2 else f"+1 555 {1000000 + i}, " for i in range(n))
    docs = spark.createDataFrame([(1, text), (2, "x a@b.org")], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in docs.select("doc_id", pii.base_spans(F.col("text")).alias("spans")).collect()}
    assert len(got[1]) == n and all(text[s.start : s.stop] == s.match for s in got[1][:: n // 500])
    spans = F.expr("transform(sequence(0, 99999), i -> named_struct('start', cast(i * 3 as int), 'stop', cast(i * 3 + if(i % 5 = 0, 7, 2) as int)))")
    ends = spark.range(1).select(pii.running(F.transform(spans, lambda s: s["stop"]), F.greatest).alias("e")).first().e
    assert ends[:4] == [7, 7, 8, 11] and len(ends) == n and ends == sorted(ends)
    plain = spark.createDataFrame([(1, " ".join(f"u{i}@ab.org" for i in range(20_000)))], "doc_id long, text string")
    assert pii.sanitised(plain).first().text == " ".join(["[EMAIL]"] * 20_000)


def test_rows_without_an_id_link(spark):
    """A text without an id within three bits of others joins their component and gives it no name."""
    r = random.Random(8)
    words = [f"w{r.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join([*words[:k], "other", *words[k + 1 :]]) for k in range(60)]
    fps = {x.text: x.fp & (1 << 64) - 1 for x in simhash.fingerprints(spark.createDataFrame([(t, t) for t in texts], "doc_id string, text string").selectExpr("CAST(hash(doc_id) AS long) AS doc_id", "text")).join(spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("CAST(hash(text) AS long) AS doc_id", "text"), "doc_id").collect()}
    a, b = next((a, b) for a in texts for b in texts if 0 < (fps[a] ^ fps[b]).bit_count() <= 3)
    rows = [(None, a), (70, b), (None, "quite another text of five words"), (None, "quite another text of five words")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(x.component_id) for x in got) == ["70", "70", "None", "None"]
