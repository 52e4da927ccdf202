"""Secret scanning: patterns, and a linear-chain CRF that tags tokens as begin, inside or outside of a secret.

Token shape, neighbouring words and features of the file feed the chain; each line is decoded by Viterbi. The chain
learns from a bounded sample in which the patterns mark the secrets. Beside each document it sees copies from which
what the patterns go by is withheld: the keyword or the assignment is gone, the value has another shape, and numbers,
names and prose that only look alike are strewn in. So it does not imitate the patterns.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import arrow_limits, byte_values, keyed, per_row, span_hash, steps, texts
from folioscan.llm.crf import Chain, fit, viterbi

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
OUTSIDE, BEGIN, INSIDE = range(3)
#: The fitting sample: documents of up to so many characters with and without a pattern, least hash first, copies with
#: the patterns' features withheld, and lines of each kind.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_COPIES, SAMPLE_LINES = 150, 20_000, 3, 600
#: What the copies are made of: keywords, what stands between one and its value, and what is no secret.
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey", "API_KEY", "Password")
BETWEEN = (" is ", ": ", " ", " -> ", " was ", " (", "=", ' = "')
HARMLESS = (
    "2024-05-17", "10:45", "v1.12.3", "0.0012345", "https://www.example.com/page/12", "report_final_2023.pdf", "HelloWorldClass", "A4-B7", "user.name42@mail.example.com", "id = 42", 'name = "value"', "a token of thanks", "the secret garden",
    "the password must be long", "api_key: none", "token economy", "no secret: nothing", "snake_case_name", "README.md", "and/or", "1,234,567.89", "192.168.10.4", "+1 (555) 010-2030", "UTF-8", "ISO 9001", "3rd", "x = y + 1",
)
_SPACE, _WORD, _MARK = range(3)
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_/+.-")] = _WORD
_CLASS[0x80:] = _WORD
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_LOWERED = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_HASH = byte_values(5)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """[(start, kind, stop)] of the patterns, in code points."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= LEAST_HEX]
    return sorted(out)


def may_match(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that hold what each pattern needs, by plain searches."""
    text, cuts = data.tobytes(), offsets.tolist()
    low = text.lower()
    out = np.zeros(len(cuts) - 1, bool)
    for needle, where in [(w, low) for w in (b"passw", b"secret", b"token", b"api")] + [(b"AKIA", text)]:
        at = where.find(needle)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, "right")) - 1
            out[row] = True
            at = where.find(needle, cuts[row + 1])
    hexa = np.isin(np.arange(256), list(b"0123456789abcdef"))[data]
    new = np.ones(len(data) + 1, bool)
    new[1:-1] = hexa[1:] != hexa[:-1]
    new[offsets] = True  # runs end with their row
    cuts_at = np.flatnonzero(new)
    long = cuts_at[:-1][(np.diff(cuts_at) >= LEAST_HEX) & hexa[cuts_at[:-1]]] if len(data) else cuts_at[:0]
    out[np.searchsorted(offsets, long, "right") - 1] = True
    return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, stops, tokens before each line and in all, tokens before each row and in all): runs of word characters
    or of marks."""
    kind = _CLASS[data]
    new = np.ones(len(data) + 1, bool)
    new[1:-1] = kind[1:] != kind[:-1]
    new[offsets] = True
    cuts = np.flatnonzero(new)
    some = kind[cuts[:-1]] != _SPACE
    starts, stops = cuts[:-1][some], cuts[1:][some]
    lines = np.union1d(offsets, np.flatnonzero(data == 10) + 1)
    return starts, stops, np.unique(np.searchsorted(starts, lines)), np.searchsorted(starts, offsets)


def features(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, lines: np.ndarray, rows: np.ndarray) -> np.ndarray:
    n, low = len(starts), _LOWERED[data]
    size = stops - starts

    def count(values: bytes) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(np.isin(np.arange(256), list(values))[data], out=total[1:])
        return total[stops] - total[starts]

    digit, upper, hexa = count(b"0123456789"), count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), count(b"0123456789abcdef")
    lower, vowel = count(b"abcdefghijklmnopqrstuvwxyz"), count(b"aeiouAEIOU")
    equals, quote = count(b"=:"), count(b"\"'")
    letters = upper + lower
    word = _CLASS[data[starts]] == _WORD
    alnum = (low >= 97) & (low <= 122)
    switch = np.zeros(len(data) + 1, np.int32)
    np.cumsum(np.concatenate([[0], alnum[1:] != alnum[:-1]]), out=switch[1:])
    switches = switch[stops] - switch[np.minimum(starts + 1, stops)]
    key = np.zeros(n, bool)
    for w in WORDS:
        at = np.flatnonzero(size >= len(w))
        whole = span_hash(low, stops[at] - len(w), stops[at], _HASH)
        want = span_hash(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]), _HASH)[0]
        key[at[whole == want]] = True
    first = np.frombuffer(b"AKIA", np.uint8)
    akia = size >= 4
    for k in range(4):
        akia &= data[np.minimum(starts + k, len(data) - 1)] == first[k]
    own = {
        "word": word, "equals": equals > 0, "quote": quote > 0, "key": key, "long": word & (size >= 8), "longer": word & (size >= 16), "longest": word & (size >= 32), "digit": digit > 0, "mixed": (digit > 0) & (letters > 0) & (size >= 8),
        "cases": (upper > 1) & (lower > 1), "upper": (upper > 2) & (lower == 0), "switches": word & (switches >= 3), "hex": word & (hexa == size) & (size >= 16), "akia": akia & (upper + digit == size), "dense": word & (4 * vowel < letters) & (letters >= 6), "plain": word & (digit == 0) & (upper <= 1),
    }
    begins = np.zeros(n, bool)
    begins[lines[:-1]] = True
    columns = list(own.values())

    def back(flags: np.ndarray, k: int) -> np.ndarray:
        """Whether the token k before, in the same line, has the flag."""
        out, line = np.zeros(n, bool), np.cumsum(begins)
        out[k:] = flags[:-k] & (line[k:] == line[:-k]) if n > k else False
        return out

    for name, most in (("key", 4), ("equals", 3), ("quote", 1), ("word", 1)):
        columns += [back(own[name], k) for k in range(1, most + 1)]
    near_key = np.logical_or.reduce([back(key, k) for k in range(1, 5)])
    near_equals = np.logical_or.reduce([back(own["equals"], k) for k in range(1, 4)])
    columns += [near_key & near_equals, near_key & own["mixed"], near_key & near_equals & own["long"], own["hex"] & own["longest"]]
    # of the file: whether it names secrets, and how much of it is assignments
    held = np.diff(rows)
    has_key = per_row(key, rows) > 0
    share = per_row(own["equals"], rows) / np.maximum(held, 1)
    columns += [np.repeat(has_key, held), np.repeat(share > 0.05, held), np.ones(n, bool)]
    return np.stack(columns, axis=1).astype(np.float32)


def point_counts(data: np.ndarray) -> np.ndarray:
    """Code points before each byte."""
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=total[1:])
    return total


def made_value(r: random.Random, short: bool) -> str:
    """A random value of some usual shape; a short one has letters of both cases and digits."""
    low, up, dig = string.ascii_lowercase, string.ascii_uppercase, string.digits
    if short:
        out = [r.choice(low), r.choice(up), r.choice(dig), r.choice(dig), *r.choices(low + up + dig, k=r.randint(5, 12))]
        r.shuffle(out)
        return "".join(out)
    letters, sizes = r.choice([(low + up + dig, (20, 44)), (low + dig, (20, 40)), (up + dig, (20, 32)), (low + up + dig + "+/", (24, 60)), (low + up + dig + "-_", (22, 43)), ("0123456789abcdef", (24, 64)), ("0123456789ABCDEF", (32, 64))])
    return r.choice(["", "", "", "sk_", "key-", "ghp_"]) + "".join(r.choices(letters, k=r.randint(*sizes)))


def withheld(text: str, values: list[tuple[int, int, int]], r: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """text with each match (its start, its value's start, its stop) replaced by a value without what the pattern goes
    by, and with harmless things strewn in; the values' places."""
    out, places, at, size = [], [], 0, 0

    def put(x: str) -> None:
        nonlocal size
        out.append(x)
        size += len(x)

    def plain(x: str) -> None:
        words = x.split(" ")
        for k in sorted(r.sample(range(len(words)), min(len(words), r.randint(0, 3))), reverse=True):
            words.insert(k, r.choice([*HARMLESS, "".join(r.choices(string.digits, k=r.randint(3, 19)))]))
        put(" ".join(words))

    for start, _, stop in values:
        if start < at:
            continue
        plain(text[at:start])
        style = r.randrange(3)
        if style == 0:  # a keyword, but no pattern of it
            put(r.choice(KEYWORDS) + r.choice(BETWEEN))
        elif style == 1:  # an assignment without a keyword
            put(r.choice(["value", "x", "auth", "cfg", "header", "login"]) + r.choice([" = ", ": ", '="', " := '"]))
        put(" " * (style == 2))
        value = made_value(r, style == 0 and r.random() < 0.6)
        places.append((size, size + len(value)))
        put(value)
        put(r.choice([" ", " ", '" ', ". ", ", "]))
        at = stop
    plain(text[at:])
    return "".join(out), places


def sample_texts(docs: DataFrame, sample: int, chars: int) -> list[str]:
    """Texts of up to so many characters, each once: those of least key that a pattern may match, and of all."""
    some = keyed(docs).where(F.length("text") <= chars)
    hit = some.where(F.rlike(F.col("text"), F.lit(r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{12}|[0-9a-f]{32}")))
    keys = hit.select("k1", "k2").distinct().orderBy("k1", "k2").limit(sample).unionByName(some.select("k1", "k2").distinct().orderBy("k1", "k2").limit(sample)).distinct()
    rows = some.join(F.broadcast(keys), ["k1", "k2"]).groupBy("k1", "k2").agg(F.min("text").alias("text")).collect()
    return [r.text for r in sorted(rows)]


def learn(docs: DataFrame, sample: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS, copies: int = SAMPLE_COPIES, most_lines: int = SAMPLE_LINES) -> Chain | None:
    """A chain fitted to a bounded sample and its copies; None if no secret is in it. The same texts give the same
    chain, in whatever order and however often they stand in docs."""
    r, made = random.Random(5), []
    for text in sample_texts(docs, sample, chars):
        values = [(start, ASSIGN.match(text, start).start(2) if kind == 0 else start, stop) for start, kind, stop in base_spans(text)]
        made.append((text, [(b, c) for _, b, c in values]))
        made += [withheld(text, values, r) for _ in range(copies if values else 0)]
    raw = [t.encode() for t, _ in made]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    if not len(data):
        return None
    starts, stops, lines, rows = tokens(data, offsets)
    points = point_counts(data)
    state = np.zeros(len(starts), np.int8)
    for i, (_, places) in enumerate(made):
        a, b = rows[i], rows[i + 1]
        at = points[starts[a:b]] - points[offsets[i]]
        for start, stop in places:
            j, k = np.searchsorted(at, [start, stop])
            state[a + j : a + k] = INSIDE
            state[a + j : a + j + 1] = BEGIN
    if not (state == BEGIN).any():
        return None
    marked = np.add.reduceat(state > 0, lines[:-1]) > 0
    pick = np.random.default_rng(5)
    few = lambda x, n: x if len(x) <= n else pick.choice(x, n, replace=False)
    take = np.sort(np.concatenate([few(np.flatnonzero(marked), 2 * most_lines), few(np.flatnonzero(~marked), 2 * most_lines)]))
    at = np.concatenate([np.arange(lines[i], lines[i + 1]) for i in take.tolist()])
    x = features(data, starts, stops, lines, rows)
    return fit(x[at].astype(np.float64), state[at], np.cumsum([0, *np.diff(lines)[take]]), 3, rounds=120)


def likeliest(unary: np.ndarray, step: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Viterbi's states. A line is outside of secrets as a whole, without decoding, if no token can gain by another
    state even with the best two transitions: a run of n tokens changes n + 1 transitions, at most two for each."""
    gain = unary[:, 1:].max(axis=1) - unary[:, OUTSIDE] + 2 * max(0.0, float(step.max() - step[OUTSIDE, OUTSIDE]))
    open_ = np.maximum.reduceat(gain, lines[:-1]) >= 0
    sizes = np.diff(lines)
    state = np.full(len(unary), OUTSIDE, np.int8)
    at = np.flatnonzero(np.repeat(open_, sizes))
    if len(at):
        state[at] = viterbi(unary[at], step, np.concatenate([[0], np.cumsum(sizes[open_])]))
    return state


def chain_spans(chain: Chain, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop) in bytes of what the chain tags as secrets."""
    starts, stops, lines, rows = tokens(data, offsets)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    x = features(data, starts, stops, lines, rows)
    weights = (chain.weights / chain.scale[:, None]).astype(np.float32)
    unary = x @ weights - (chain.mean / chain.scale @ chain.weights).astype(np.float32)
    state = likeliest(unary.astype(np.float64), chain.step, lines)
    begin = np.flatnonzero(state == BEGIN)
    # a run ends where the next token is not inside, or the line ends
    inside = np.concatenate([state == INSIDE, [False]])
    inside[lines] = False
    last = begin.copy()
    grow = inside[last + 1]
    while grow.any():
        last[grow] += 1
        grow &= inside[last + 1]
    a, b = starts[begin], stops[last]
    return np.searchsorted(offsets, a, "right") - 1, a, b


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, spans [(start, kind, stop)] in code points, by start, then kind.

    The patterns' spans come as they are, and all that the chain finds, of kind `crf`, whether a pattern has it too or
    not. Null and empty texts have none; repeated rows each get theirs; without a secret in the sample there is no chain
    and nothing is added; other columns play no part.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    shared = spark.sparkContext.broadcast(learn(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for rows, data, offsets in steps(batches, most=1 << 20):
            text, cuts = data.tobytes(), offsets.tolist()
            out: list[list[tuple[int, int, int]]] = [[] for _ in range(rows.num_rows)]
            for i in np.flatnonzero(may_match(data, offsets)).tolist():
                out[i] = base_spans(text[cuts[i] : cuts[i + 1]].decode("utf-8", "replace"))
            if chain is not None:
                row, start, stop = chain_spans(chain, data, offsets)
                points = point_counts(data)
                low = points[offsets[row]]
                for i, a, b in zip(row.tolist(), (points[start] - low).tolist(), (points[stop] - low).tolist()):
                    out[i].append((a, 3, b))
            out = [sorted(x) for x in out]
            flat = [s for x in out for s in x]
            parts = [pa.array([s[k] for s in flat], pa.int32()) for k in range(3)]
            values = pa.StructArray.from_arrays(parts, ["start", "kind", "stop"])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, out)]), pa.int32()), values)], ["doc_id", "spans"])

    return texts(docs).mapInArrow(run, "doc_id long, spans array<struct<start:int,kind:int,stop:int>>")


def digests(docs: DataFrame) -> DataFrame:
    """Counts of the patterns' matches in each row of docs, SHA-256 of their rendered spans, all spans rendered, and
    counts of what the chain finds and of what it alone finds."""
    spans = F.col("found")
    name = lambda s: F.get(F.array(*map(F.lit, KINDS)), s["kind"])
    rendered = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", name(s), s["start"], s["stop"])), ",")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    base = F.filter(spans, lambda s: s["kind"] < 3)
    alone = F.size(F.filter(spans, lambda s: (s["kind"] == 3) & ~F.exists(spans, lambda o: (o["kind"] < 3) & (o["start"] < s["stop"]) & (s["start"] < o["stop"])))).cast("long")
    return scan(docs).withColumnRenamed("spans", "found").select("doc_id", *(count(k).alias(f"n_{n}") for k, n in enumerate(KINDS[:3])), F.sha2(rendered(base).cast("binary"), 256).alias("base_sha256"), rendered(spans).alias("spans"), count(3).alias("n_crf"), alone.alias("n_crf_alone"))
