"""Byte-level BPE encoding and decoding with scan-based pre-tokenisation.

Pre-tokens are found without a regular expression: each code point gets a class from one table, each class is a
transition function on four states, functions are composed by an associative scan, and the state before a code point
and the classes beside it say whether a pre-token starts there. Slices of the UTF-8 bytes then go through merges that
are kept per distinct slice.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioscan.llm.common import arrow_limits, steps, texts

LETTER, NUMBER, OTHER, BLANK, SPACE = range(5)
#: States: an apostrophe would open a pre-token; it would join one; one or two letters of a contraction are due.
FREE, JOINED, DUE1, DUE2 = range(4)
#: The code points of the Unicode property White_Space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Code points of Unicode 16.0 that Python's own tables (15.1) lack, as (first, last).
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
#: Distinct slices whose ids a worker keeps; the store starts anew beyond that.
KEPT_SLICES = 400_000
_tables: dict[str, object] = {}


def class_table() -> np.ndarray:
    """Class of each code point, built once a process."""
    if "classes" not in _tables:
        first = [unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)]
        out = np.array([{"L": LETTER, "N": NUMBER}.get(x, OTHER) for x in first], np.uint8)
        for ranges, kind in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER)):
            for a, b in ranges:
                out[a : b + 1] = kind
        out[WHITE] = SPACE
        out[0x20] = BLANK
        _tables["classes"] = out
    return _tables["classes"]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte positions, values) of the code points of valid UTF-8."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    value = data[at].astype(np.int32)
    for low, high, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        which = np.flatnonzero((data[at] >= low) & (data[at] < high))
        if len(which):
            x = value[which] & mask
            for k in range(1, more + 1):
                x = (x << 6) | (data[at[which] + k] & 0x3F)
            value[which] = x
    return at, value


def _code(to: tuple[int, int, int, int]) -> int:
    """A function on the four states as one byte, two bits for each state."""
    return sum(t << 2 * s for s, t in enumerate(to))


F_FREE, F_JOIN = _code((FREE, FREE, FREE, DUE1)), _code((JOINED, JOINED, JOINED, JOINED))
F_ONE, F_TWO = _code((DUE1, JOINED, JOINED, JOINED)), _code((DUE2, JOINED, JOINED, JOINED))


def composed_table() -> np.ndarray:
    """composed[256 * f + g]: the function that applies f, then g."""
    if "composed" not in _tables:
        f, g = np.arange(256)[:, None], np.arange(256)[None, :]
        out = np.zeros((256, 256), np.int64)
        for s in range(4):
            out |= ((g >> 2 * ((f >> 2 * s) & 3)) & 3) << 2 * s
        _tables["composed"] = out.astype(np.uint8).ravel()
    return _tables["composed"]


def scanned(functions: np.ndarray, lane: int = 128) -> np.ndarray:
    """Inclusive scan under composition: lanes side by side, then the lanes' totals by the same scan."""
    n, composed = len(functions), composed_table()
    if n <= lane:
        out = functions.copy()
        for k in range(1, n):
            out[k] = composed[(int(out[k - 1]) << 8) + int(out[k])]
        return out
    rows = -(-n // lane)
    grid = np.full(rows * lane, _code((0, 1, 2, 3)), np.uint8)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(rows, lane).T)
    for k in range(1, lane):
        grid[k] = composed[(grid[k - 1].astype(np.int32) << 8) + grid[k]]
    before = np.full(rows, _code((0, 1, 2, 3)), np.uint8)
    before[1:] = scanned(grid[-1])[:-1]
    return composed[(before.astype(np.int32)[None, :] << 8) + grid].T.ravel()[:n]


def pretoken_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which a pre-token starts, in rows of UTF-8 that offsets bound."""
    if not len(data):
        return np.zeros(0, np.int64)
    at, value = code_points(data)
    n = len(at)
    kind = class_table()[value]
    row = np.zeros(n + 1, bool)  # a row starts here; the end counts too
    row[np.searchsorted(at, offsets)] = True
    ahead = lambda k: np.concatenate([value[k:], np.zeros(min(k, n), np.int32)])
    functions = np.where((kind == OTHER) | (kind == BLANK), F_JOIN, F_FREE).astype(np.uint8)
    quote = np.flatnonzero(value == 0x27)
    if len(quote):
        one, two = ahead(1)[quote], ahead(2)[quote]
        one = np.where(row[quote + 1], 0, one)
        two = np.where(row[np.minimum(quote + 2, n)] | (one == 0), 0, two)
        functions[quote[np.isin(one, [ord(c) for c in "stmd"])]] = F_ONE
        pair = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b))
        functions[quote[pair]] = F_TWO
    heads = np.flatnonzero(row[:n])
    functions[heads] = np.array([_code(((f & 3),) * 4) for f in range(256)], np.uint8)[functions[heads]]
    state = scanned(functions) & 3
    white = kind >= BLANK
    start = np.ones(n, bool)
    last, this = kind[:-1], kind[1:]
    start[1:] = (last != this) & (last != BLANK)
    both = white[1:] & white[:-1]
    ends = np.ones(n, bool)  # the last white character of a run that something follows
    ends[:-1] = ~white[1:] & ~row[1:n]
    ends[-1] = False
    start[1:] = np.where(white[1:], ~white[:-1] | (both & ends[1:]), start[1:])
    start[1:] &= state[:-1] < DUE1
    start[2:] |= state[:-2] == DUE1
    start[heads] = True
    return at[start]


class Encoder:
    """Merges by rank, with the ids of each distinct slice kept."""

    def __init__(self, ranks: dict[bytes, int], kept: int = KEPT_SLICES):
        self.ranks, self.kept = ranks, kept
        self.tokens = {i: b for b, i in ranks.items()}
        self.store: dict[bytes, tuple[bytes, bytes]] = {}

    def ids(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the pair of least rank, leftmost first, is joined until none is left."""
        rank = self.ranks.get
        if piece in self.ranks:
            return [self.ranks[piece]]
        if len(piece) > 256:
            return self._long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [rank(parts[i] + parts[i + 1], 1 << 60) for i in range(len(parts) - 1)]
        while pairs and (least := min(pairs)) < 1 << 60:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], 1 << 60)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], 1 << 60)
        return [self.ranks[p] for p in parts]

    def _long(self, piece: bytes) -> list[int]:
        """The same merges with a heap and links, for slices without bound."""
        import heapq

        n, rank = len(piece), self.ranks.get
        part = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i] if part[i] else n
            if j >= n or len(part[i]) + len(part[j]) != size or self.ranks.get(part[i] + part[j]) != _:
                continue
            part[i] += part[j]
            part[j] = b""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(part[i] + part[k])) is not None:
                    heapq.heappush(heap, (r, i, len(part[i]) + len(part[k])))
            if (h := before[i]) >= 0 and (r := rank(part[h] + part[i])) is not None:
                heapq.heappush(heap, (r, h, len(part[h]) + len(part[i])))
        return [self.ranks[p] for p in part if p]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.tokens[i] for i in ids)

    def known(self, piece: bytes) -> tuple[bytes, bytes]:
        """(ids in decimal, bytes decoded from them)."""
        if len(self.store) >= self.kept:
            self.store.clear()
        ids = self.ids(piece)
        out = " ".join(map(str, ids)).encode(), self.decode(ids)
        if len(piece) <= 256:
            self.store[piece] = out
        return out

    def encode(self, text: bytes) -> tuple[list[int], list[int]]:
        """(ids, byte offset at which each id's bytes start)."""
        data = np.frombuffer(text, np.uint8)
        starts = [*pretoken_starts(data, np.array([0, len(data)])).tolist(), len(text)]
        ids = [i for a, b in zip(starts, starts[1:]) for i in self.ids(text[a:b])]
        return ids, np.cumsum([0, *(len(self.tokens[i]) for i in ids)])[:-1].tolist()


def load_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


def encode_documents(docs: DataFrame, rank_file: str) -> DataFrame:
    """One row a document: n_tokens, the ids in decimal (ids_text, space-joined) and text decoded from them.

    Null and empty texts give no tokens; repeated rows each give their row. rank_file is read on the driver and
    broadcast (its size is the vocabulary's, whatever the corpus).
    """
    return _encoded(docs, rank_file, digests=False)


def encode_digests(docs: DataFrame, rank_file: str) -> DataFrame:
    """As encode_documents, with SHA-256 of the ids and of the decoded bytes in place of them."""
    return _encoded(docs, rank_file, digests=True)


def _encoded(docs: DataFrame, rank_file: str, digests: bool) -> DataFrame:
    spark = docs.sparkSession
    arrow_limits(spark)
    with open(rank_file, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = shared.value
        key = hashlib.sha256(raw).digest()
        encoder = _tables.get("encoder")
        if encoder is None or encoder[0] != key:
            encoder = _tables["encoder"] = (key, Encoder(load_ranks(raw)))
        encoder = encoder[1]
        for rows, data, offsets in steps(batches):
            starts = pretoken_starts(data, offsets)
            text, first = data.tobytes(), np.searchsorted(starts, offsets).tolist()
            cuts = [*starts.tolist(), len(text)]
            n, ids_out, text_out = [], [], []
            store, known = encoder.store, encoder.known
            for a, b in zip(first, first[1:]):
                got = [store.get(p) or known(p) for p in (text[i:j] for i, j in zip(cuts[a:b], cuts[a + 1 : b + 1]))]
                ids, decoded = b" ".join([x[0] for x in got]), b"".join([x[1] for x in got])
                n.append(ids.count(b" ") + 1 if ids else 0)
                ids_out.append(hashlib.sha256(ids).hexdigest() if digests else ids.decode())
                text_out.append(hashlib.sha256(decoded).hexdigest() if digests else decoded.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(ids_out, pa.string()), pa.array(text_out, pa.string())], ["doc_id", "n_tokens", names[0], names[1]])

    names = ("ids_sha256", "decoded_sha256") if digests else ("ids_text", "decoded_text")
    return texts(docs).mapInArrow(run, f"doc_id long, n_tokens long, {names[0]} string, {names[1]} string")
