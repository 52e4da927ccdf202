"""Each stage of the pipeline on its own input, against a plain version."""

import hashlib
import re

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from folioscan.llm import bpe, quality
from tests.llm.test_brute import plain_pii

NAMES = [name for name, _ in corpus_pipeline.STAGES]


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    where = sf_dir.replace("sf0.001", "sf0.01")
    docs, out = spark.read.parquet(f"{where}/documents.parquet"), []
    folder = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, where).write.parquet(str(folder / name))
        after = spark.read.parquet(str(folder / name))
        out.append((docs, after))
        docs = after
    return where, dict(zip(NAMES, out))


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns(steps):
    _, by = steps
    assert all(after.columns == before.columns for name, (before, after) in by.items() if name != NAMES[-1])
    assert all(after.count() == len(ids(after)) for _, after in by.values())


def test_quality(spark, steps):
    where, by = steps
    before, after = by["quality"]
    labels = spark.read.parquet(f"{where}/labels.parquet")
    assert ids(after) == ids(quality.classify(before, labels).where("predicted = 1"))
    known = {r.doc_id: r.quality for r in labels.collect()}
    kept = ids(after)
    assert sum(known[i] == (i in kept) for i in ids(before) if i in known) >= 0.97 * sum(i in known for i in ids(before))


def shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)}


def test_near_dedup(steps):
    _, by = steps
    before, after = by["near_dedup"]
    text = {r.doc_id: shingles(r.text) for r in before.select("doc_id", "text").collect()}
    kept = ids(after)
    held = {}
    for i in sorted(kept):
        for s in text[i]:
            held.setdefault(s, []).append(i)

    def likeness(i):
        seen = {j for s in text[i] for j in held.get(s, ()) if j != i}
        return max((len(text[i] & text[j]) / len(text[i] | text[j]) for j in seen), default=0.0)

    assert sum(likeness(i) >= 0.8 for i in kept) == 0
    gone = set(text) - kept
    assert gone and sum(likeness(i) >= 0.5 for i in gone) >= 0.98 * len(gone)


def test_decontamination(spark, steps):
    where, by = steps
    before, after = by["decontamination"]
    tok = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    items = [f" {' '.join(tok(r.text))} " for r in spark.read.parquet(f"{where}/benchmark.parquet").collect()]
    leaks = {r.doc_id for r in before.collect() if any(i in f" {' '.join(tok(r.text))} " for i in items)}
    assert leaks and ids(before) - ids(after) == leaks


def test_personal_data(steps):
    _, by = steps
    before, after = ({r.doc_id: r for r in df.collect()} for df in by["personal_data"])
    assert before.keys() == after.keys()
    for i, r in before.items():
        text, at = [], 0
        for a, k, b in plain_pii(r.text):
            text += [r.text[at:a], f"[{('email', 'ip', 'card', 'phone')[k].upper()}]"]
            at = b
        assert re.sub(r"\[TERM\]", "", after[i].text) == "".join([*text, r.text[at:]]) or "[TERM]" in after[i].text
        assert not plain_pii(after[i].text) and after[i].n_chars == len(after[i].text)


def test_tokens(steps):
    _, by = steps
    before, after = ({r.doc_id: r for r in df.collect()} for df in by["tokens"])
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(f.read()), special_tokens={})
    for i, r in before.items():
        found = want.encode_ordinary(r.text)
        assert (after[i].n_tokens, after[i].ids_text) == (len(found), " ".join(map(str, found)))
        assert after[i].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_run(spark, steps):
    where, by = steps
    assert sorted(map(tuple, corpus_pipeline.run(spark, where).collect())) == sorted(map(tuple, by["tokens"][1].collect()))


def test_near_dedup_links_by_simhash(spark, steps):
    """No two documents that stay are in one component of op3's links, nor do links by SimHash keep the similar ones."""
    from folioscan.llm.simhash import near_duplicates

    _, by = steps
    before, after = by["near_dedup"]
    assert near_duplicates(after).select("component_id").distinct().count() == after.count()
    # shingles mostly of one phrase again and again: one SimHash, but few five-word shingles in common
    docs = spark.createDataFrame([(i, "a b c d e f g " * 100 + " ".join(f"t{i}x{k}" for k in range(10))) for i in range(3)], "doc_id long, text string")
    assert near_duplicates(docs).select("component_id").distinct().count() == 1
    assert ids(corpus_pipeline.near_dedup(spark, docs, "")) == {0}


def test_links_are_stored_as_they_are_found(spark):
    """What comes after the links plans none of the work that led to them."""
    from folioscan.llm import minhash

    texts = ["one two three four five six seven"] * 2 + ["One two three four five six seven eight", "other words altogether here and now", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = minhash.saved(minhash._sketches(docs))
    nodes = own.groupBy("d1", "d2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("one"), F.first("bands").alias("bands"))
    nodes = minhash.saved(nodes.withColumn("rep", F.monotonically_increasing_id()))
    links = minhash.similar_links(docs, nodes, 0.5).unionByName(minhash.close_links(own, nodes, 3))
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Exchange" not in plan and links.count() >= 1
