"""Report search on documents: postings, ranked search, snippets, spelling, keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscan.functions.text import search_ngrams, snippet, tokens
from folioscan.operators import impact, index, keywords, segment, spell
from folioscan.plans.common import arrow_limits, fingerprint, scratch, table
from folioscan.sources import store

#: The fixed query of the flagship, its page, and the word that snippets are made for.
QUERY, PAGE, SNIPPET_TERM = "the ofantion ingnd thstble cióndo ungen", 10, "ing"
#: Misspelt words that suggestions are asked for.
MISSPELT = ("thstble", "ingndd", "andrreh", "tionb", "eraning", "ofre", "ciónd", "êmont", "geöüch")
#: Published indexes of this session: by application, table and state of its files.
_published: dict[tuple, tuple[str, int]] = {}


def _tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.term_frequencies(table(spark, sf_dir, "documents"), {"text": 1})


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    docs = table(spark, sf_dir, "documents")
    return index.build(docs, {"text": 1}), docs.count()


def _stored(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, int]:
    """A table of the published index of documents, and their number. What queries read is built and published on first
    use, and again when the documents' files change."""
    key = (spark.sparkContext.applicationId, sf_dir, name, fingerprint(spark, f"{sf_dir}/documents.parquet"))
    if key not in _published:
        folder = scratch(spark)
        if name == "variants":
            made, n = spell.variants(index.document_frequencies(_tf(spark, sf_dir)).withColumnRenamed("df", "freq")), 0
        elif name == "postings":  # counts, each task's sorted in a file of its own (its segment), so that nothing is shuffled
            n = table(spark, sf_dir, "documents").count()
            made = _tf(spark, sf_dir).withColumn("segment", F.spark_partition_id())
        else:
            made, n = _stored(spark, sf_dir, "postings")
            if name == "dfs":
                made = index.document_frequencies(made)
            elif name == "norms":
                known = _stored(spark, sf_dir, "dfs")[0]
                made = index.norms(index.looked_up(made, known).withColumn("weight", F.col("tf") * index.idf(F.col("df"), n)))
            else:
                made = impact.segment_blocks(made, _parts(spark, sf_dir))
        store.publish(spark, folder, {name: made}, dealt=name in ("postings", "dfs", "blocks"))
        _published[key] = folder, n
    folder, n = _published[key]
    return store.load(spark, folder, name), n


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.parts(_stored(spark, sf_dir, "norms")[0])


def tfidf_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return index.postings(_tf(spark, sf_dir), docs.count()).select("doc_id", "term", "tf", F.round("weight", 5).alias("weight"))


def term_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.document_frequencies(_tf(spark, sf_dir))


def postings_l2_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)[0].select("doc_id", "term", F.round("weight", 5).alias("weight"))


def _found(spark: SparkSession, sf_dir: str, queries: DataFrame) -> DataFrame:
    built, n = _stored(spark, sf_dir, "postings")
    return index.search(built, queries, n, PAGE, norms=_stored(spark, sf_dir, "norms")[0], dfs=_stored(spark, sf_dir, "dfs")[0])


def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _found(spark, sf_dir, spark.range(1).select(F.lit(0).alias("qid"), F.lit(QUERY).alias("query")))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return hits.join(docs, "doc_id").select("rank", "doc_id", "score", "lang", "source")


def search_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return _found(spark, sf_dir, queries).select("qid", "rank", "doc_id", "score")


def search_batch_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of search_batch_topk, from the blocks of postings that can hold a hit."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    built, n = _stored(spark, sf_dir, "blocks")
    return impact.search(built, queries, n, PAGE, dealt=_parts(spark, sf_dir), dfs=_stored(spark, sf_dir, "dfs")[0]).select("qid", "rank", "doc_id", "score")


def search_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of each benchmark item's terms, and those that its search reads."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    built, n = _stored(spark, sf_dir, "blocks")
    return impact.Search(built, queries, n, PAGE, dealt=_parts(spark, sf_dir), dfs=_stored(spark, sf_dir, "dfs")[0]).work()


def field_weighted_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.substring_index("text", "\n", 1)
    rest = F.substring(F.col("text"), F.length(first) + 1, F.length("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", first.alias("conclusion"), rest.alias("description"))
    return index.term_frequencies(docs, {"conclusion": 2, "description": 1})


def search_with_link_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _found(spark, sf_dir, spark.range(1).select(F.lit(0).alias("qid"), F.lit(QUERY).alias("query")))
    return index.with_link_flag(hits, table(spark, sf_dir, "labels"), "doc_id").select("rank", "doc_id", "has_image")


def search_results_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's hits as the service would send them."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    sent = index.hits_json(_found(spark, sf_dir, queries).withColumn("score", index.rounded(F.col("score"), 4)), ["doc_id", "score"])
    return sent.withColumn("json", F.regexp_replace("json", r"([0-9])\.0E-4", "0.000$1"))  # no exponents


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", snippet(F.col("text"), F.lit(SNIPPET_TERM)).alias("snippet"))


def spell_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spell.nearest(spark.createDataFrame([(MISSPELT[0],)], "query string"), _stored(spark, sf_dir, "variants")[0])


def spell_suggest_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spell.nearest(spark.createDataFrame([(w,) for w in MISSPELT], "query string"), _stored(spark, sf_dir, "variants")[0])


def keyword_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    tf, n = _tf(spark, sf_dir), table(spark, sf_dir, "documents").count()
    known = index.document_frequencies(tf).select("term", index.idf(F.col("df"), n).alias("idf"))
    return keywords.top_keywords(tf, known, 5, default=0.0).select("doc_id", "rank", "term", "weight")


def keyword_default_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of IDF values lacks all words with a capital letter; these take its mean."""
    (tf, n), dfs = _stored(spark, sf_dir, "postings"), _stored(spark, sf_dir, "dfs")[0]
    known = dfs.select("term", "df", F.when(~F.rlike("term", F.lit("[A-Z]")), F.round(index.idf(F.col("df"), n), 9)).alias("idf"))
    return keywords.top_keywords(tf.drop("segment"), known, 3)


def keyword_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = keywords.term_offsets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "term", "tf", F.array_join(F.col("offsets").cast("array<string>"), ",").alias("offsets"))


def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(tokens(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def search_mode_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term with its pairs and triples that are terms themselves."""
    terms = index.document_frequencies(_tf(spark, sf_dir)).select("term")
    grams = terms.select("term", F.explode(search_ngrams(F.col("term"))).alias("gram"))
    known = grams.join(terms.withColumnRenamed("term", "gram"), "gram", "left_semi")
    return known.groupBy("gram").agg(F.count("*").alias("n"))


def textrank_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("words"))
    return keywords.text_rank_keywords(docs, 5)


def pos_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of all distinct terms against a dictionary of the languages' names of their most used words."""
    terms = index.document_frequencies(_tf(spark, sf_dir)).select(F.col("term").alias("word"))
    known = spark.createDataFrame([("the", "r"), ("of", "p"), ("de", "p"), ("und", "c"), ("la", "r")], "word string, tag string")
    return keywords.tagged(terms, known).select("word", "tag")


def _dictionary(spark: SparkSession, sf_dir: str) -> segment.Dictionary:
    """The words of the benchmark's items, a table of limited size, with a small model for what it lacks."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(tokens(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    letters = "abcdefghijklmnopqrstuvwxyzäçèéêíñóöüß"
    emit = [{c: -1.0 - ((7 * i + 3 * k) % 11) / 4 for i, c in enumerate(letters)} for k in range(4)]
    hmm = segment.Hmm([-0.3, segment.IMPOSSIBLE, segment.IMPOSSIBLE, -1.4], [[segment.IMPOSSIBLE, -0.5, -0.9, segment.IMPOSSIBLE], [-0.6, segment.IMPOSSIBLE, segment.IMPOSSIBLE, -0.8], [segment.IMPOSSIBLE, -0.3, -1.3, segment.IMPOSSIBLE], [-0.7, segment.IMPOSSIBLE, segment.IMPOSSIBLE, -0.7]], emit)
    return segment.Dictionary({r.w: float(r.n) for r in words}, hmm=hmm)


def segment_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of words that each mode finds in every document by a given dictionary, also with words of up to four."""
    docs, d = table(spark, sf_dir, "documents"), _dictionary(spark, sf_dir)
    arrow_limits(spark)
    modes = {f"n_{mode}": (mode, None) for mode in ("mix", "mp", "full", "search", "hmm")} | {"n_short": ("mp", 4)}
    return docs.select("doc_id", segment.counted(F.col("text"), d, modes).alias("n")).select("doc_id", "n.*")


def segment_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most probable words of every document by a given dictionary: their number and a digest of all in order."""
    words = segment.segmented(F.coalesce("text", F.lit("")), _dictionary(spark, sf_dir), "mp")
    return table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).select("doc_id", F.size("w").alias("n_words"), F.md5(F.array_join("w", "/").cast("binary")).alias("words_md5"))


def top_terms_per_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The service's term listing by language: most documents first."""
    docs = table(spark, sf_dir, "documents")
    words = docs.select("lang", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).groupBy("lang", "term").agg(F.count("*").alias("df"))
    return words.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("df"), "term"))).where("rank <= 20")


QUERIES = [
    tfidf_postings, term_document_frequency, postings_l2_normalised, search_topk, search_batch_topk, search_batch_pruned, search_pruning, field_weighted_tf, search_with_link_flag, search_results_json, snippets, spell_suggest, spell_suggest_batch,
    keyword_topn, keyword_default_idf, keyword_offsets, word_count, search_mode_ngrams, textrank_keywords, pos_tags, segment_modes, segment_words, top_terms_per_language,
]

_TF = r"""
w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[^\p{L}\p{N}]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE strlen(term) > 1 GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
n AS (SELECT count(*)::DOUBLE AS n FROM documents),
p AS (SELECT doc_id, term, tf, df, tf * ln(n / df) AS weight FROM tf JOIN df USING (term), n),
ix AS (SELECT doc_id, term, df, CASE WHEN norm > 0 THEN weight / norm ELSE 0 END AS weight FROM (SELECT *, sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)) AS norm FROM p))
"""


def _search_sql(queries: str, tail: str) -> str:
    return f"""WITH {_TF},
q0 AS ({queries}),
qw AS (SELECT qid, unnest(regexp_split_to_array(query, '[^\\p{{L}}\\p{{N}}]+')) AS term FROM q0),
qt AS (SELECT qid, term, count(*) AS qtf FROM qw WHERE strlen(term) > 1 GROUP BY ALL),
q1 AS (SELECT qid, term, qtf * ln(n / df) AS q FROM qt JOIN df USING (term), n WHERE ln(n / df) > 0),
q2 AS (SELECT qid, term, q / sqrt(sum(q * q) OVER (PARTITION BY qid)) AS q FROM q1),
s AS (SELECT qid, doc_id, round(sum(weight * q), 6) AS score FROM ix JOIN q2 USING (term) GROUP BY ALL),
h AS (SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id))::INT AS rank FROM s QUALIFY rank <= {PAGE})
{tail}"""


_ONE = f"SELECT 0 AS qid, '{QUERY}' AS query"
_MANY = "SELECT item_id AS qid, text AS query FROM benchmark"
_INSIDE = lambda at: f"(CASE WHEN substr(c, 2 * ({at}) + 1, 1) IN ('8','9','A','B') THEN 1 ELSE 0 END)"


def _edge(at: str, step: str) -> str:
    """A byte position moved back or on to the start of a code point."""
    one, two, three = (_INSIDE(f"({at}) {step} {k}") for k in (0, 1, 2))
    return f"(({at}) {step} ({one} + {one} * {two} + {one} * {two} * {three}))"


#: DuckDB counts the bytes of an edit, so each letter of the four languages beyond ASCII stands as one byte that no word has.
_LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöüÀàÂâÎîÔôÛûÚúÁáœŒËëÏïÙù"
_BYTES = " || ".join(f"chr({k})" for k in range(14, 14 + 18)) + " || ' !\"#$%&()*+,-./:;<=>?@[]^_{|}~'"
_ONE_BYTE = f"translate(term, '{_LETTERS}', {_BYTES})"
_SUGGEST = """WITH {tf},
t AS (SELECT term, {one} AS bytes, df AS freq FROM df),
q AS (SELECT term AS query, {one} AS bytes FROM (SELECT unnest([{words}]) AS term)),
d AS (SELECT query, term, levenshtein(q.bytes, t.bytes)::INT AS distance, freq FROM q, t WHERE abs(len(query) - len(term)) <= 2)
SELECT *, (row_number() OVER (PARTITION BY query ORDER BY distance, freq DESC, term))::INT AS rank FROM d WHERE distance <= 2 QUALIFY rank <= 5"""

SQL = {
    "tfidf_postings": f"WITH {_TF} SELECT doc_id, term, tf, round(weight, 5) AS weight FROM p",
    "term_document_frequency": f"WITH {_TF} SELECT term, df FROM df",
    "postings_l2_normalised": f"WITH {_TF} SELECT doc_id, term, round(weight, 5) AS weight FROM ix",
    "search_topk": _search_sql(_ONE, "SELECT rank, doc_id, score, lang, source FROM h JOIN documents USING (doc_id)"),
    "search_batch_topk": _search_sql(_MANY, "SELECT qid, rank, doc_id, score FROM h"),
    "search_batch_pruned": _search_sql(_MANY, "SELECT qid, rank, doc_id, score FROM h"),
    "search_with_link_flag": _search_sql(_ONE, "SELECT rank, doc_id, doc_id IN (SELECT doc_id FROM labels) AS has_image FROM h"),
    "field_weighted_tf": r"""
WITH f AS (SELECT doc_id, string_split(text, chr(10))[1] AS a, substr(text, length(string_split(text, chr(10))[1]) + 1) AS b FROM documents),
w AS (SELECT doc_id, unnest(regexp_split_to_array(a, '[^\p{L}\p{N}]+')) AS term, 2 AS x FROM f UNION ALL SELECT doc_id, unnest(regexp_split_to_array(b, '[^\p{L}\p{N}]+')), 1 FROM f)
SELECT doc_id, term, sum(x)::BIGINT AS tf FROM w WHERE strlen(term) > 1 GROUP BY ALL""",
    "snippets": f"""
WITH a AS (SELECT doc_id, text, hex(encode(text)) AS c, octet_length(encode(text)) AS n, strpos(text, '{SNIPPET_TERM}') AS p FROM documents),
b AS (SELECT *, octet_length(encode(substr(text, 1, p - 1))) AS place FROM a),
d AS (SELECT *, {_edge("greatest(place - 24, 0)", "-")} AS lo, {_edge("least(n, 48)", "-")} AS open FROM b),
e AS (SELECT *, {_edge(f"least(n, lo + {len(SNIPPET_TERM)} + 48)", "+")} AS hi FROM d)
SELECT doc_id, CASE WHEN n = 0 THEN ''
  WHEN p > 0 THEN CASE WHEN lo > 0 THEN '...' ELSE '' END || decode(unhex(substr(c, 2 * lo + 1, 2 * (hi - lo)))) || CASE WHEN hi < n THEN '...' ELSE '' END
  ELSE decode(unhex(substr(c, 1, 2 * open))) || CASE WHEN n > open THEN '...' ELSE '' END END AS snippet FROM e""",
    "spell_suggest": _SUGGEST.format(tf=_TF, one=_ONE_BYTE, words=f"'{MISSPELT[0]}'"),
    "spell_suggest_batch": _SUGGEST.format(tf=_TF, one=_ONE_BYTE, words=", ".join(f"'{w}'" for w in MISSPELT)),
    "keyword_topn": f"""WITH {_TF} SELECT doc_id, rank, term, weight FROM (SELECT doc_id, term, round(weight, 6) AS weight, (row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 6) DESC, term))::INT AS rank FROM p) WHERE rank <= 5""",
    "keyword_default_idf": f"""WITH {_TF},
k AS (SELECT term, round(ln(n / df), 9) AS idf FROM df, n WHERE NOT regexp_matches(term, '[A-Z]')),
x AS (SELECT doc_id, term, round(tf * coalesce(idf, (SELECT avg(idf) FROM k)), 6) AS weight FROM tf LEFT JOIN k USING (term))
SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term))::INT AS rank FROM x QUALIFY rank <= 3""",
    "search_results_json": _search_sql(_MANY, """SELECT qid, '{"count":' || count(*) || ',"hits":[' || string_agg('{"doc_id":' || doc_id || ',"score":' || round(score, 4) || '}', ',' ORDER BY rank) || ']}' AS json FROM h GROUP BY qid"""),
    "keyword_offsets": r"""
WITH a AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+') AS m, regexp_split_to_array(text, '[\p{L}\p{N}]+') AS b FROM documents),
c AS (SELECT doc_id, i, m[i] AS term, b[i] AS between_ FROM (SELECT doc_id, m, b, unnest(range(1, len(m) + 1)) AS i FROM a)),
d AS (SELECT doc_id, term, (sum(strlen(between_) + strlen(term)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - strlen(term))::BIGINT AS o FROM c)
SELECT doc_id, term, count(*) AS tf, string_agg(o, ',' ORDER BY o) AS offsets FROM d WHERE strlen(term) > 1 GROUP BY ALL""",
    "word_count": f"WITH {_TF} SELECT term AS word, sum(tf)::BIGINT AS n FROM tf GROUP BY term",
    "search_mode_ngrams": f"""WITH {_TF},
g AS (SELECT term AS gram FROM df UNION ALL SELECT substr(term, i, 2) FROM (SELECT term, unnest(range(1, length(term))) AS i FROM df WHERE length(term) > 2)
  UNION ALL SELECT substr(term, i, 3) FROM (SELECT term, unnest(range(1, length(term) - 1)) AS i FROM df WHERE length(term) > 3))
SELECT gram, count(*) AS n FROM g WHERE gram IN (SELECT term FROM df) GROUP BY gram""",
    "pos_tags": f"""WITH {_TF},
k AS (SELECT * FROM (VALUES ('the', 'r'), ('of', 'p'), ('de', 'p'), ('und', 'c'), ('la', 'r')) AS v(word, tag)),
s AS (SELECT term AS word, substr(regexp_replace(term, '[^\\x00-\\x7f]', '', 'g'), 1, (length(term) // 2)::INT) AS seen FROM df)
SELECT s.word, coalesce(tag, CASE WHEN seen = '' THEN 'x' WHEN regexp_matches(seen, '^[0-9]+$') THEN 'm' ELSE 'eng' END) AS tag FROM s LEFT JOIN k USING (word)""",
    "segment_words": r"""
WITH RECURSIVE dict AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[^\p{L}\p{N}]+')) AS w FROM benchmark) WHERE strlen(w) > 1 GROUP BY w),
wt AS (SELECT w, ln(n / (SELECT sum(n) FROM dict)::DOUBLE) AS lw FROM dict),
known AS (SELECT min(lw) AS least, max(length(w)) AS longest FROM wt),
part AS (SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS place FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n，。]+|[ \t\n，。]') AS ps FROM documents)),
piece AS (SELECT DISTINCT p, length(p) AS n FROM part),
spot AS (SELECT p, n, unnest(range(0, n)) AS i FROM piece),
cand AS (SELECT p, i, unnest(range(1, least(longest, n - i) + 1)) AS l FROM spot, known),
edge AS (SELECT p, i, list(struct_pack(j := i + l, lw := coalesce(lw, known.least))) AS e FROM cand LEFT JOIN wt ON w = substr(p, i + 1, l), known WHERE l = 1 OR lw IS NOT NULL GROUP BY p, i),
walk AS (SELECT p, n AS i, [0::DOUBLE] AS best, [''] AS said, [0::BIGINT] AS cnt FROM piece
  UNION ALL SELECT p, i, list_prepend(-x.s, best), list_prepend(substr(p, i + 1, x.j - i) || CASE WHEN x.j < length(p) THEN '/' || said[x.j - i] ELSE '' END, said), list_prepend(1 + cnt[x.j - i], cnt)
  FROM (SELECT walk.p, edge.i, best, said, cnt, list_min(list_transform(e, lambda y: struct_pack(s := -(y.lw + best[y.j - edge.i]), j := y.j))) AS x FROM walk JOIN edge ON edge.p = walk.p AND edge.i = walk.i - 1)),
done AS (SELECT p, said[1] AS said, cnt[1] AS cnt FROM walk WHERE i = 0)
SELECT doc_id, coalesce(sum(cnt), 0)::INT AS n_words, md5(coalesce(string_agg(said, '/' ORDER BY place), '')) AS words_md5 FROM documents LEFT JOIN part USING (doc_id) LEFT JOIN done USING (p) GROUP BY doc_id""",
    "top_terms_per_language": f"""WITH {_TF},
l AS (SELECT lang, term, count(*) AS df FROM tf JOIN documents USING (doc_id) GROUP BY ALL)
SELECT *, (row_number() OVER (PARTITION BY lang ORDER BY df DESC, term))::INT AS rank FROM l QUALIFY rank <= 20""",
}
