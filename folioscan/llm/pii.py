"""Personal data by information-theoretic sanitisation, with DataFrame functions alone.

Patterns find the protected entities. How strongly a word reveals one is estimated from the corpus: lines (paragraphs)
that hold both, against lines that hold either. The pointwise mutual information of word and entity over the entity's
information content is 1 for a word that stands nowhere but beside it and 0 for one that knows nothing of it. Words at
or above the threshold are generalised like the entities, wherever they stand in a text that holds the entity.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import keyed, let, saved, small, text_key, unused

#: The kinds in the order of the contract and their patterns, written so that no start is tried twice.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried on it.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
TERM, TERM_PATTERN = "term", r"\p{L}{4,}+"
#: A word whose information about an entity is this share of the entity's own is generalised.
DISCLOSURE = 0.9


#: Entries that a scan goes through by itself; longer lists are scanned in as many parts as each part has entries.
SHORT = 64


def in_parts(items: Column) -> Column:
    """items as a list of lists, of about as many entries as there are lists."""
    def cut(x: Column, size: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(x), F.lit(1)) - 1) / size).cast("int")), lambda i: F.slice(x, i * size + 1, size))

    return let(items, lambda x: let(F.ceil(F.sqrt(F.greatest(F.size(x), F.lit(1)))).cast("int"), lambda size: cut(x, size)))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """combine over values (whole numbers from 0 on) up to and with each of them. A list grows by copying, so a long
    one is scanned in parts, which copies n ** 1.5 entries for n instead of their square."""
    add = lambda acc, v: F.array_append(acc, combine(F.element_at(acc, -1), v))
    after = lambda first, x: F.aggregate(x, F.array(first), add)  # noqa: E731  with what comes before at its head
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, v: combine(a, v))
    part_by_part = lambda p: F.flatten(F.transform(F.arrays_zip(p.alias("x"), F.slice(after(F.lit(0), F.transform(p, total)), 1, F.size(p)).alias("before")), lambda z: F.slice(after(z["before"], z["x"]), 2, F.size(z["x"]))))
    return let(values, lambda v: F.when(F.size(v) <= SHORT, F.slice(after(F.lit(0), v), 2, F.greatest(F.size(v), F.lit(1)))).otherwise(let(in_parts(v), part_by_part)))


def matches(text: Column, pattern: str | Column) -> Column:
    """[(start, stop, match)] of a pattern, leftmost and non-overlapping, in code points. The pieces between matches
    and the matches alternate, so positions are running sums of their lengths."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)

    def placed(f: Column) -> Column:
        steps = F.zip_with(F.slice(between, 1, F.size(f)), f, lambda b, m: F.length(b) + F.length(m))
        return F.zip_with(running(steps, lambda x, y: x + y), f, lambda stop, m: F.struct((stop - F.length(m)).alias("start"), stop.alias("stop"), m.alias("match")))

    return let(found, placed)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Every second digit from the right is doubled, with the digits of the double added; the sum is a multiple of ten."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, 2 * d).otherwise(d)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return ~F.exists(F.split(m, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda z: (F.length(z) > 3) | (F.coalesce(F.when(F.length(z) <= 3, z).try_cast("int"), F.lit(0)) > 255)))
    count = F.length(digits(m))
    if kind == "phone":
        return count.between(10, 15)
    return F.when(count.between(14, 19), let(digits(m), luhn)).otherwise(False)


def base_spans(text: Column) -> Column:
    """[(start, k, stop, match)] of the entities in text by start, then kind; k counts kinds as listed."""
    return F.array_sort(F.concat(*(_of_kind(text, k, name) for k, name in enumerate(PATTERNS))))


def _of_kind(text: Column, k: int, name: str) -> Column:
    kind = "array<struct<start:int,k:int,stop:int,match:string>>"
    needed = F.contains(text, F.lit("@")) if name == "email" else F.rlike(text, F.lit(NEEDS[name]))
    some = F.filter(matches(text, PATTERNS[name]), lambda x: _passes(name, x["match"]))
    some = F.transform(some, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("k"), x["stop"].alias("stop"), x["match"].alias("match")))
    return F.when(needed, some.cast(kind)).otherwise(F.array().cast(kind))


def masked(text: Column) -> Column:
    """text with each email as so many blanks. No other entity holds a letter, so the words of this text are those
    outside of all entities, at their places."""
    found, between = F.regexp_extract_all(text, F.lit(PATTERNS["email"]), F.lit(0)), F.split(text, PATTERNS["email"], -1)
    blank = F.transform(found, lambda m: F.repeat(F.lit(" "), F.length(m)))
    return F.when(F.contains(text, F.lit("@")), F.array_join(F.zip_with(between, blank, lambda b, m: F.concat(b, F.coalesce(m, F.lit("")))), "")).otherwise(text)


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def entities(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, found): rows (doc_id, text, k1, k2); found (doc_id, k1, k2, spans, n_lines) for each of them."""
    rows = keyed(docs)
    n = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return rows, saved(rows.select("doc_id", "k1", "k2", base_spans(F.col("text")).alias("spans"), n.cast("long").alias("n_lines")))


def beside(rows: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, lines): the texts with an entity, (k1, k2, copies, text), once each; and their lines with one,
    (k1, k2, copies, line, entities, words): line is a hash of its place, the lists hold each entry once."""
    held = found.where(F.size("spans") > 0).groupBy("k1", "k2").agg(F.count("*").alias("copies"))
    own = rows.join(small(held.select("k1", "k2")), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    own = saved(own)
    each = own.select("k1", "k2", "copies", F.posexplode(lines(F.col("text"))).alias("at", "part")).withColumn("spans", base_spans(F.col("part"))).where(F.size("spans") > 0)
    named = F.array_distinct(F.transform("spans", lambda s: F.concat_ws(":", s["k"], s["match"])))
    return own, saved(each.select("k1", "k2", "copies", F.xxhash64("k1", "k2", "at").alias("line"), named.alias("entities"), F.array_distinct(F.regexp_extract_all(masked(F.col("part")), F.lit(TERM_PATTERN), F.lit(0))).alias("words")))


def _classes(held: DataFrame, what: str, name: str) -> DataFrame:
    """(what, n, class): how many lines hold it, and a class of all that stand in the same lines. Classes are what is
    paired: a text of many entities and words that stand nowhere else is one pair, not the product."""
    return held.groupBy(what).agg(F.sum("copies").alias(f"n_{name}"), F.sum(F.col("line").cast("decimal(38,0)")).alias("places")).select(what, f"n_{name}", F.xxhash64(f"n_{name}", "places").alias(f"c_{name}"))


def disclosing(rows: DataFrame, found: DataFrame, held: DataFrame, threshold: float = DISCLOSURE) -> tuple[DataFrame, DataFrame]:
    """(told, known): told (match, c_e): words that disclose the entities of a class; known (entity, c_e).

    All counts are of lines of the whole corpus, as they are, without a least number: a word of one line that stands
    there with an entity of that line alone is the strongest disclosure. A word stands in at least the lines that have
    it beside some entity, so pairs that this number already rules out need no count over the corpus.
    """
    total = F.lit(float(found.agg(F.sum("n_lines")).first()[0] or 0))
    e = held.select("line", "copies", F.explode("entities").alias("entity"))
    w = held.select("line", "copies", F.explode("words").alias("match"))
    known, seen = saved(_classes(e, "entity", "e")), saved(_classes(w, "match", "w"))
    content = F.log2(F.greatest(total, F.col("n_e") + 1) / F.col("n_e"))
    information = lambda df: F.log2(F.col("both") * total / (F.col("n_e") * F.greatest(df, F.col("both"))))
    left = e.join(known, "entity").select("line", "copies", "c_e", "n_e").distinct()
    right = w.join(seen, "match").select("line", "c_w", "n_w").distinct()
    pairs = left.join(right, "line").groupBy("c_e", "n_e", "c_w", "n_w").agg(F.sum("copies").alias("both")).where(information(F.col("n_w")) >= threshold * content)
    pairs = saved(pairs.select("c_e", "n_e", "c_w", "both").join(seen.select("match", "c_w"), "c_w").drop("c_w"))
    wanted = small(saved(pairs.select("match").distinct()))
    word = rows.select(F.explode(lines(F.col("text"))).alias("part")).select(F.explode(F.array_distinct(F.split("part", r"[^\p{L}]+"))).alias("match")).join(wanted, "match", "left_semi").groupBy("match").agg(F.count("*").alias("df"))
    told = pairs.join(word, "match", "left").where(information(F.coalesce("df", F.lit(0))) >= threshold * content).select("match", "c_e").distinct()
    return saved(told), known


def terms(docs: DataFrame, threshold: float = DISCLOSURE) -> tuple[DataFrame, DataFrame]:
    """(found, marks): found as in `entities`; marks (k1, k2, terms) of the texts that hold a disclosing word: terms are
    its places [(start, stop)]."""
    rows, found = entities(docs)
    own, held = beside(rows, found)
    told, known = disclosing(rows, found, held, threshold)
    has = held.select("k1", "k2", F.explode("entities").alias("entity")).join(known, "entity").select("k1", "k2", "c_e").distinct()
    said = own.select("k1", "k2", F.explode(F.array_distinct(F.regexp_extract_all(masked(F.col("text")), F.lit(TERM_PATTERN), F.lit(0)))).alias("match")).join(told, "match")
    marked = said.join(has, ["k1", "k2", "c_e"], "left_semi").groupBy("k1", "k2").agg(F.collect_set("match").alias("marked"))
    places = matches(masked(F.col("text")), F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join("marked", "|"), F.lit(r")(?!\p{L})")))
    return found, saved(own.join(marked, ["k1", "k2"]).select("k1", "k2", F.transform(places, lambda x: F.struct(x["start"].alias("start"), F.lit(len(PATTERNS)).alias("k"), x["stop"].alias("stop"))).alias("terms")))


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["stop"].alias("stop")))


def find(docs: DataFrame, threshold: float = DISCLOSURE) -> DataFrame:
    """(doc_id, spans) for each row of docs: spans are [(start, k, stop)] of entities and, with k = 4, disclosing words,
    by start, then k. Null and empty texts have none; repeated rows each get theirs; rows that share a doc_id, or have
    none, are told apart by their text; an empty table gives no rows."""
    found, marks = terms(docs, threshold)
    both = found.join(small(marks, size=F.size("terms") + 1), ["k1", "k2"], "left")
    plain = _plain(F.col("spans"))
    return both.select("doc_id", F.when(F.col("terms").isNull(), plain).otherwise(F.array_sort(F.concat(plain, "terms"))).alias("spans"))


NAMES = [*PATTERNS, TERM]


def rendered(spans: Column) -> Column:
    """kind:start:stop of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(F.array(*map(F.lit, NAMES)), s["k"]), s["start"], s["stop"])), ",")


def digests(docs: DataFrame) -> DataFrame:
    """Counts of the entities of each row of docs, SHA-256 of their rendered spans, and all spans rendered."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["k"] < len(PATTERNS))
    count = lambda k: F.size(F.filter(spans, lambda s: s["k"] == k)).cast("long")
    return find(docs).select("doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(PATTERNS)), F.sha2(rendered(base).cast("binary"), 256).alias("base_sha256"), rendered(spans).alias("spans"))


def sanitised(docs: DataFrame, threshold: float = DISCLOSURE) -> DataFrame:
    """docs with text where each span stands as its kind in brackets; spans that overlap stand as the first of them.
    Other columns, whatever their names, and rows whose text is null, stay as they are. Entities are found in passing;
    only the marks of words are joined, so no text is shuffled unless very many texts have marks."""
    _, marks = terms(docs, threshold)
    a, b, c, d, own, more = unused(docs, "k1", "k2", "of1", "of2", "spans", "terms")
    every = F.when(F.col(more).isNull(), _plain(F.col(own))).otherwise(F.array_sort(F.concat(_plain(F.col(own)), more)))
    label = lambda s: F.concat(F.lit("["), F.upper(F.get(F.array(*map(F.lit, NAMES)), s["k"])), F.lit("]"))
    whole = F.col("text").cast("string")

    def joined_up(spans: Column) -> Column:
        """Spans that overlap as one: it starts where none before it reaches, and stops where the next one starts anew."""
        ends = running(F.transform(spans, lambda s: s["stop"]), lambda x, y: F.greatest(x, y))
        heads = lambda e: F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: (i == 0) | (F.get(spans, i)["start"] >= F.get(e, i - 1)))
        return let(ends, lambda e: let(heads(e), lambda h: F.transform(h, lambda i, j: F.struct(F.get(spans, i)["start"].alias("start"), F.get(spans, i)["k"].alias("k"), F.get(e, F.coalesce(F.get(h, j + 1), F.size(spans)) - 1).alias("stop")))))

    def written(piece: Column, at: Column, m: Column) -> Column:
        """piece, which begins at `at` of the text, up to the last of its spans m."""
        begins = F.concat(F.array(at), F.transform(m, lambda s: s["stop"]))
        return F.array_join(F.zip_with(m, F.slice(begins, 1, F.size(m)), lambda s, e: F.concat(F.substring(piece, e - at + 1, s["start"] - e), label(s))), "")

    def text(m: Column) -> Column:
        """Places in a string are found from its start, so a text of many spans is cut into parts first."""
        last = F.element_at(m, -1)["stop"]
        by_part = lambda p: F.array_join(F.transform(p, lambda x, i: let(F.when(i == 0, F.lit(0)).otherwise(F.element_at(F.get(p, i - 1), -1)["stop"]), lambda at: written(F.substring(whole, at + 1, F.element_at(x, -1)["stop"] - at), at, x))), "")
        return F.concat(F.when(F.size(m) <= SHORT, written(whole, F.lit(0), m)).otherwise(let(in_parts(m), by_part)), F.substring(whole, last + 1, F.length(whole)))

    k1, k2 = text_key(F.col("text"))
    rows = docs.withColumns({a: k1, b: k2, own: base_spans(F.coalesce(whole, F.lit("")))})
    joined = rows.join(small(marks.toDF(c, d, more), size=F.size(more) + 1), (F.col(a) == F.col(c)) & (F.col(b) == F.col(d)), "left")
    return joined.withColumn("text", F.when(F.size(own) == 0, F.col("text")).otherwise(let(every, lambda spans: let(joined_up(spans), text)))).select(*docs.columns)
