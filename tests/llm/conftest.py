import pytest


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids, clashing columns, odd code points."""
    long = " ".join(f"word{i % 977} the of" for i in range(30_000))
    texts = [None, "", " \n\t ", "a", "A.", "é" * 500, "\x1c\x85 x\u0000y", "no-break space 's 'll 've ''s", long, long, "Same text here for all of us to read and read again today.", "Same text here for all of us to read and read again today.", "x" * 40_000, "1" * 5000, "a." * 4000, "@" * 300 + "b.c", "😀 " * 700, "token = \"f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda\" 肺结节 mail a@b.org"]
    rows = [(i, t, "en" if i % 2 else None, None, "k", i, "x", 1) for i, t in enumerate(texts)]
    rows += [(3, "a", "de", None, "k", 1, "y", 2), (None, "a null id with several words in it, and more of them", "en", None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row string, h int, spans string, n long")


@pytest.fixture(scope="session")
def empty(nasty):
    return nasty.where("doc_id < -1")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def plain(documents):
    return [(r.doc_id, r.text or "") for r in documents.select("doc_id", "text").collect()]
