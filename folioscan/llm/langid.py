"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed greedily into the longest phrases
that occur in that language's text (Ziv-Merhav cross parsing); phrases * log2(size of the texts learnt) / bytes
estimates the cross entropy in bits a byte, and the language that needs the least wins. As much is learnt of each
language where there is as much, and the greatest size counts for all: a small one must not make phrases cheap.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.bpe import LETTER, class_table, code_points
from folioscan.llm.common import arrow_limits, keyed, small, steps, texts
from folioscan.llm.quality import held_out

#: What is learnt for a language: the first documents by hash, of at most so many characters, until so many bytes.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_BYTES = 60, 20_000, 24_000
#: Texts are parsed in pieces of so many bytes, so that many are parsed side by side; phrases go on across them.
PIECE = 512
UNKNOWN = "und"
#: How sharply lower cost raises the score.
SHARPNESS = 8
_FOLD = np.where(np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz")) | (np.arange(256) >= 0x80), np.arange(256), 32).astype(np.uint8)
_built: dict[str, object] = {}


def folded(text: bytes) -> bytes:
    """Lower case, with each run of ASCII other than letters as one space."""
    data = _FOLD[np.frombuffer(text.decode("utf-8", "replace").lower().encode(), np.uint8)]
    keep = data != 32
    keep[1:] |= data[:-1] != 32
    return data[keep].tobytes()


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the least automaton that accepts every substring of text; state 0 is the start."""
    after, link, length = [{}], [-1], [0]
    last = 0
    for c in text:
        new = len(after)
        after.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in after[p]:
            after[p][c] = new
            p = link[p]
        if p >= 0:
            q = after[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(after)
                after.append(dict(after[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and after[p].get(c) == q:
                    after[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return after


def parser_table(text: bytes, symbols: np.ndarray) -> np.ndarray:
    """table[state * kinds + symbol] = 2 * next state + 1 if a phrase ends before the symbol. A symbol without a
    transition ends the phrase and starts the next; one that the text lacks is a phrase of its own, after which only a
    new one can start: that is the last state."""
    after, kinds = suffix_automaton(text), int(symbols.max()) + 1
    after.append({})
    first = np.full(kinds, 2 * (len(after) - 1) + 1, np.int32)
    for c, to in after[0].items():
        first[symbols[c]] = 2 * to + 1
    table = np.tile(first, (len(after), 1))
    state = np.fromiter((s for s, x in enumerate(after) for _ in x), np.int64)
    table[state, symbols[np.fromiter((c for x in after for c in x), np.int64, len(state))]] = 2 * np.fromiter((t for x in after for t in x.values()), np.int64, len(state))
    return table.ravel()


class Parser:
    """Phrases of many texts in one language's text."""

    def __init__(self, learnt: dict[str, bytes]):
        seen = np.unique(np.frombuffer(b"".join(learnt.values()), np.uint8))
        self.symbols = np.zeros(256, np.int64)
        self.symbols[seen] = np.arange(1, len(seen) + 1)
        self.kinds = len(seen) + 1
        self.names = sorted(learnt)
        self.tables = [self._table(learnt[x]) for x in self.names]
        self.bits = math.log2(max(2, *(len(learnt[x]) for x in self.names)))

    def _table(self, text: bytes) -> np.ndarray:
        table = parser_table(text, self.symbols)
        return np.concatenate([table, np.ones(-len(table) % self.kinds, np.int32)])

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(rows, languages): phrases of each row of folded bytes."""
        sizes = np.diff(offsets)
        pieces = -(-sizes // PIECE)
        row = np.repeat(np.arange(len(sizes)), pieces)
        start = offsets[:-1][row] + PIECE * (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        length = np.minimum(offsets[1:][row] - start, PIECE)
        order = np.argsort(-length, kind="stable")
        row, start, length = row[order], start[order], length[order]
        grid = np.zeros((PIECE, len(row)), np.int32)
        padded = np.concatenate([self.symbols[data].astype(np.int32), np.zeros(PIECE, np.int32)])
        for a in range(0, len(row), 1024):
            grid[:, a : a + 1024] = padded[start[a : a + 1024, None] + np.arange(PIECE)].T
        active = len(length) - np.searchsorted(length[::-1], np.arange(PIECE), "right")
        # the piece before each in its text, or -1
        place = np.empty(len(row), np.int64)
        place[order] = np.arange(len(row))
        before = np.where(start > offsets[row], np.concatenate([[-1], place[:-1]])[order], -1)
        out = np.zeros((len(sizes), len(self.tables)))
        for k, table in enumerate(self.tables):
            out[:, k] = np.bincount(row, self._ends(table, grid, active, length, before), len(sizes))
            out[sizes > 0, k] += 1
        return out

    def _ends(self, table: np.ndarray, grid: np.ndarray, active: np.ndarray, length: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Phrases that end before a byte of each piece, the first of a text apart. All pieces are first parsed as if a
        text began there; then those that begin within a phrase are parsed anew from the state that the piece before
        leaves, up to where both parses are in the same state, from where on they agree; until no state changes."""
        n, trail = len(length), np.zeros(grid.shape, np.int32)
        state, ends = np.zeros(n, np.int32), np.zeros(n, np.int64)
        for t in range(int(length.max(initial=0))):
            m = active[t]
            got = table[state[:m] * self.kinds + grid[t, :m]]
            if t:
                ends[:m] += got & 1
            trail[t, :m] = got
            np.right_shift(got, 1, out=state[:m])
        entered = np.zeros(n, np.int32)
        while True:
            left = np.where(before >= 0, trail[length[before] - 1, before] >> 1, 0)
            at = np.flatnonzero((left != entered) & (before >= 0))
            if not len(at):
                return ends
            first = entered[at] == 0  # what was parsed as the beginning of a text had no phrase end at its first byte
            entered[at] = left[at]
            now, t = left[at], 0
            while len(at):
                got = table[now * self.kinds + grid[t, at]]
                old = trail[t, at]
                ends[at] += (got & 1) - (old & 1 if t else np.where(first, 0, old & 1))
                trail[t, at] = got
                t += 1
                on = (got >> 1 != old >> 1) & (length[at] > t)
                at, now, first = at[on], got[on] >> 1, first[on]


def sample_texts(docs: DataFrame, docs_each: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS, size: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """Folded text learnt for each language: a bounded sample outside the held-out fold; whole documents by hash."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    share = known.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(4.0 * docs_each) / F.count("*")).alias("share"))
    chance = (F.xxhash64("doc_id") % 1_000_003 + 1_000_003) % 1_000_003 / 1_000_003
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = known.join(small(share, 10_000), "lang").where(chance < F.col("share")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= docs_each).select("doc_id", "lang", "place")
    rows = keyed(docs).where(F.length("text") <= chars).join(F.broadcast(ids), "doc_id").groupBy("lang", "place").agg(F.min(F.struct("k1", "k2", "text")).alias("x")).collect()
    out: dict[str, bytes] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.place)):
        if len(out.get(r.lang, b"")) < size:
            out[r.lang] = out.get(r.lang, b"") + folded(r.x.text.encode()) + b" "
    return {k: v for k, v in out.items() if v.strip()}


def identify(docs: DataFrame, learnt: dict[str, bytes]) -> DataFrame:
    """(doc_id, lang_pred, score) of every row; `und` with score 0 if the text is null or has no letter, or nothing
    was learnt. Equal costs go to the first name. The whole text is parsed, however long."""
    spark = docs.sparkSession
    arrow_limits(spark)
    shared = spark.sparkContext.broadcast(learnt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        if _built.get("of") != known:
            _built.update(of=known, parser=Parser(known) if known else None)
        parser = _built["parser"]
        for rows, data, offsets in steps(batches):
            text, cuts = data.tobytes(), offsets.tolist()
            at, value = code_points(data)
            letters = np.diff(np.concatenate([[0], np.cumsum(class_table()[value] == LETTER)])[np.searchsorted(at, offsets)]) if len(at) else np.zeros(len(offsets) - 1)
            names, score = [UNKNOWN] * rows.num_rows, np.zeros(rows.num_rows)
            some = np.flatnonzero(letters)
            if parser and len(some):
                parts = [folded(text[cuts[i] : cuts[i + 1]]) for i in some.tolist()]
                own = np.cumsum([0, *map(len, parts)])
                cost = parser.phrases(np.frombuffer(b"".join(parts), np.uint8), own) * parser.bits / np.diff(own)[:, None]
                best = cost.argmin(axis=1)
                share = (cost.min(axis=1, keepdims=True) / cost) ** SHARPNESS
                score[some] = 1 / share.sum(axis=1)
                for i, k in zip(some.tolist(), best.tolist()):
                    names[i] = parser.names[k]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def predict_language(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs, learnt from rows outside the held-out fold."""
    return identify(docs, sample_texts(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
