"""Alignment of two tokenizers over the same bytes, with corpus counts of the id pairs that it links.

The tokens of each text are intervals of its bytes. The intervals of the second tokenizer (B) are a static index, sorted
by start and by end; two bisections list those that a token of the first (A) overlaps, and a gap between A tokens that
no B token spans is a group boundary. Each step of texts keeps its different (document, pair) entries as indices into
the step's own list of pairs. Pair counts are summed from these lists; then each step looks its list up among the most
frequent pairs, whose number is bounded, and pairs beyond are joined by a shuffle. No text is encoded twice.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.bpe import Encoder
from folioscan.llm.common import arrow_limits, matched, steps, stored, texts

#: How the byte-level vocabulary splits text into pre-tokens (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pairs whose counts are broadcast (16 bytes each): the most frequent. Any others are joined.
BROADCAST_PAIRS = 1 << 20
#: Links of one group that are listed one by one; of larger groups the different ids are counted first.
LISTED = 256
#: Pairs that a task gathers before it passes their counts on.
GATHERED = 1 << 20
_loaded: dict[tuple[bytes, bytes], "Pair"] = {}


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if it can be seen, else the next
    character from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Pair:
    """Both tokenizers: ids of a text, and the bytes of each id."""

    def __init__(self, byte_json: bytes, piece_model: bytes):
        import sentencepiece
        import tiktoken

        model, of = json.loads(byte_json)["model"], byte_level()
        raw = {w: bytes(of[c] for c in w) for w in model["vocab"] if all(c in of for c in w)}
        order = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if order != sorted(order):
            raise ValueError("merges have to be in the order of their ids")
        ranks = {raw[w]: i for w, i in model["vocab"].items() if w in raw}
        self.first = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.own = Encoder(ranks)
        self.second = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        self.bytes_a = {i: b for b, i in ranks.items()}
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_b = len(pieces)
        self.len_a = np.zeros(max(self.bytes_a) + 1, np.int64)
        self.len_a[list(self.bytes_a)] = [len(b) for b in self.bytes_a.values()]
        self.len_b = np.array([len(b) for b in self.bytes_b], np.int64)
        self.digits = [_decimals(len(self.len_a)), _decimals(self.size_b)]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a space and the text by A, of the text by B; nothing, if either's bytes are not the space and text."""
        raw = (" " + text).encode()
        b = self.second.encode(text)
        table = self.bytes_b
        if not text or b"".join([table[i] for i in b]) != raw:
            return None
        try:
            a = self.first.encode_to_numpy(" " + text, disallowed_special=())
        except BaseException as e:  # its regex gives up on runs of a million spaces, as a panic that is no Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit)):
                raise
            a = self.own.encode(raw)[0]
        a = np.asarray(a, np.int64)
        return (a, np.array(b, np.int64)) if self.len_a[a].sum() == len(raw) else None


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The digits of 0 .. n - 1 with room for a separator, and how many digits each has."""
    words = [str(i).encode() for i in range(n)]
    wide = max(map(len, words)) + 1
    return np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in words), np.uint8).reshape(n, wide), np.array([len(w) for w in words])


def _pair(byte_json: bytes, piece_model: bytes) -> Pair:
    key = (hashlib.sha256(byte_json).digest(), hashlib.sha256(piece_model).digest())
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pair(byte_json, piece_model)
    return _loaded[key]


def groups_of(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first A token, first B token) of each group, of tokens that cover the same bytes, given where they end."""
    a_starts, b_starts = np.concatenate([[0], a_ends[:-1]]), np.concatenate([[0], b_ends[:-1]])
    lo = np.searchsorted(b_ends, a_starts, "right")  # the first B token that A token i overlaps
    hi = np.searchsorted(b_starts, a_ends, "left")  # the one after the last
    first = np.flatnonzero(np.concatenate([[True], hi[:-1] <= lo[1:]]))
    return first, lo[first]


def _links(a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, doc: np.ndarray, size_b: int) -> tuple[np.ndarray, np.ndarray]:
    """(document << 32 | pair, links) of the different pairs of each document; doc is that of each group."""
    na, nb = np.diff(first_a, append=len(a)), np.diff(first_b, append=len(b))
    key = lambda d, x, y: (d << 32) | (x * size_b + y)
    one = (na == 1) & (nb == 1)
    some = np.flatnonzero(~one & (na * nb <= LISTED))
    n = (na * nb)[some]
    which = np.repeat(some, n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    keys = np.concatenate([key(doc[one], a[first_a[one]], b[first_b[one]]), key(doc[which], a[first_a[which] + within // nb[which]], b[first_b[which] + within % nb[which]])])
    keys.sort()
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    keys, links = keys[edge], np.diff(edge, append=len(keys))
    for g in np.flatnonzero(na * nb > LISTED).tolist():
        x, mx = np.unique(a[first_a[g] : first_a[g] + na[g]], return_counts=True)
        y, my = np.unique(b[first_b[g] : first_b[g] + nb[g]], return_counts=True)
        keys = np.concatenate([keys, key(doc[g], np.repeat(x, len(y)), np.tile(y, len(x)))])
        links = np.concatenate([links, np.repeat(mx, len(y)) * np.tile(my, len(x))])
    if (na * nb > LISTED).any():
        keys, at = np.unique(keys, return_inverse=True)
        links = np.bincount(at, links.astype(np.float64), len(keys)).astype(np.int64) if links.sum() < 1 << 52 else np.array([links[at == i].sum() for i in range(len(keys))])
    return keys, links


def _written(pair: Pair, a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """`a1,a2|b1;...` of all groups, and where each document's part ends (without the last separator); ends has the
    groups before the end of each document."""
    na, nb = np.diff(first_a, append=len(a)), np.diff(first_b, append=len(b))
    n = len(a) + len(b)
    wide = max(x[0].shape[1] for x in pair.digits)
    grid, size = np.zeros((n, wide), np.uint8), np.zeros(n, np.int64)
    sep = np.full(n, ord(","), np.uint8)
    at_a = np.arange(len(a)) + np.repeat(first_b, na)
    at_b = np.arange(len(b)) + np.repeat(first_a + na, nb)
    for at, ids, (digits, length) in ((at_a, a, pair.digits[0]), (at_b, b, pair.digits[1])):
        grid[at, : digits.shape[1]] = digits[ids]
        size[at] = length[ids]
    last = at_b[first_b + nb - 1]
    sep[at_a[first_a + na - 1]] = ord("|")
    sep[last] = ord(";")
    grid[np.arange(n), size] = sep
    stop = np.cumsum(size + 1)
    return grid[np.arange(wide) <= size[:, None]].tobytes(), stop[last[ends - 1]] - 1


def _packed(x: np.ndarray) -> bytes:
    return len(x).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(x, "<u4").tobytes() or b"\0", "zstd", asbytes=True)


def _unpacked(x: bytes) -> np.ndarray:
    n = int.from_bytes(x[:8], "little")
    return np.frombuffer(pa.decompress(x[8:], decompressed_size=max(4 * n, 1), codec="zstd", asbytes=True), "<u4", n).astype(np.int64) if n else np.zeros(0, np.int64)


STEP = "step long, pairs binary, docs binary, entries binary, indices binary, links binary, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, groups array<string>"


def _step(pair: Pair, rows: pa.RecordBatch, seq: int, groups_too: bool) -> dict:
    """One step's documents, and its different pairs with the documents of each."""
    found = [pair.encode(t or "") for t in rows.column(1).to_pylist()]
    held = np.array([k for k, x in enumerate(found) if x is not None], np.int64)
    n = len(found)
    out = {"step": seq, "doc_id": rows.column(0).to_pylist(), "groups_sha256": [""] * n, "groups": [""] * n if groups_too else None}
    counts = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links", "entries")}
    pairs = seen = index = links = np.zeros(0, np.int64)
    if len(held):
        a, b = (np.concatenate([found[k][i] for k in held]) for i in (0, 1))
        counts["n_a"][held], counts["n_b"][held] = ([len(found[k][i]) for k in held] for i in (0, 1))
        first_a, first_b = groups_of(np.cumsum(pair.len_a[a]), np.cumsum(pair.len_b[b]))
        ends = np.searchsorted(first_a, np.cumsum(counts["n_a"][held]), "left")
        counts["n_groups"][held] = np.diff(ends, prepend=0)
        doc = np.repeat(held, counts["n_groups"][held])
        keys, links = _links(a, b, first_a, first_b, doc, pair.size_b)
        own, which = keys >> 32, keys & 0xFFFFFFFF
        pairs = np.sort(which)
        pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
        index = np.searchsorted(pairs, which)
        seen = np.bincount(index, minlength=len(pairs))
        counts["entries"] = np.bincount(own, minlength=n)
        sizes = np.diff(first_a, append=len(a)) * np.diff(first_b, append=len(b))
        counts["n_links"][held] = np.add.reduceat(sizes, np.concatenate([[0], ends[:-1]]))
        written, stops = _written(pair, a, b, first_a, first_b, ends)
        for k, i, j in zip(held.tolist(), [0, *(stops[:-1] + 1).tolist()], stops.tolist()):
            out["groups_sha256"][k] = hashlib.sha256(written[i:j]).hexdigest()
            if groups_too:
                out["groups"][k] = written[i:j].decode()
        index = np.diff(index, prepend=0) & 0xFFFFFFFF  # ascending within a document: small steps
    if len(links) and links.max() >= 1 << 32:
        raise ValueError("a document links one pair more than 2^32 times")
    out |= {"pairs": _packed(np.diff(pairs, prepend=0)), "docs": _packed(seen), "entries": _packed(counts.pop("entries")), "indices": _packed(index), "links": _packed(links)}
    return out | {k: v.tolist() for k, v in counts.items()}


def _pairs(row: dict) -> np.ndarray:
    return np.cumsum(_unpacked(row["pairs"]))


def _entries(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document of the step, index of the pair, links) of the step's entries."""
    entries, change, links = (_unpacked(row[c]) for c in ("entries", "indices", "links"))
    return np.repeat(np.arange(len(entries)), entries), np.cumsum(change) & 0xFFFFFFFF, links


def align(docs: DataFrame, byte_json: str, piece_model: str, groups_too: bool = False) -> DataFrame:
    """One row a document, as op11's contract names its columns; with groups_too also the groups themselves, as text.

    Null and empty texts, and those whose bytes either tokenizer changes, have no tokens: zeros, and '' for groups.
    Repeated rows, rows of one doc_id and rows of none each count as a document. Any length of text is one interval
    index; its links are counted by different ids in large groups, so that an unbroken run is no product of its
    tokens. Other columns are ignored; an empty table has no rows. The tokenizers' files are read on the driver and
    broadcast (their size is the vocabularies'), as are the greatest count of each A id and the counts of
    BROADCAST_PAIRS pairs.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    with open(byte_json, "rb") as f, open(piece_model, "rb") as g:
        files = spark.sparkContext.broadcast((f.read(), g.read()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, seq = _pair(*files.value), TaskContext.get().partitionId() << 40
        kinds = [pa.int64(), *[pa.binary()] * 5, *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), pa.list_(pa.string())]
        names = [x.split(" ")[0] for x in STEP.split(", ")]
        for rows, _, _ in steps(batches):
            made = _step(pair, rows, seq, groups_too)
            seq += 1
            yield pa.RecordBatch.from_arrays([pa.array([made[c]], k) for c, k in zip(names, kinds)], names)

    made = stored(texts(docs).mapInArrow(encode, STEP))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        fresh = 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            pairs, n = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(pairs, kind="stable")
            pairs, n = pairs[order], n[order]
            edge = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
            return pairs[edge], np.add.reduceat(n, edge)

        for batch in batches:
            for row in batch.to_pylist():
                pairs = _pairs(row)
                if len(pairs):
                    held.append((pairs, _unpacked(row["docs"])))
                    fresh += len(pairs)
            if fresh > 2 * GATHERED:
                held, fresh = [summed()], 0
                if len(held[0][0]) > GATHERED:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], ["pair", "n"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed()], ["pair", "n"])

    counts = stored(made.select("pairs", "docs").mapInArrow(gathered, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    size_b = _pair(*files.value).size_b
    a_id = F.floor(F.col("pair") / size_b).cast("long").alias("a_id")
    greatest = counts.groupBy(a_id).agg(F.max("n").alias("most"))  # no more rows than A has ids
    doubling = sorted(counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect(), reverse=True)
    least, total = 1 << 62, 0
    for k, n in doubling:
        total += n
        if total > BROADCAST_PAIRS:
            break
        least = 1 << k
    top = counts.where(F.col("n") >= least).toArrow()
    order = np.argsort(top["pair"].to_numpy())
    most = greatest.toArrow()
    best = np.zeros(len(_pair(*files.value).len_a), np.int64)
    best[most["a_id"].to_numpy()] = most["most"].to_numpy()
    known = spark.sparkContext.broadcast((top["pair"].to_numpy()[order], top["n"].to_numpy()[order], best))

    def found(row: dict) -> tuple[np.ndarray, np.ndarray]:
        """(pairs of the step, their counts; zero for those that are not among the broadcast ones)."""
        pairs, (keys, n, _) = _pairs(row), known.value
        if not len(keys):
            return pairs, np.zeros(len(pairs), np.int64)
        at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
        return pairs, np.where(keys[at] == pairs, n[at], 0)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pairs, n = found(row)
                doc, index, links = _entries(row)
                top = (n > 0) & (n == known.value[2][pairs // size_b]) if len(pairs) else n
                size = len(row["doc_id"])
                sums = np.zeros((2, size), np.int64)
                if len(doc):
                    heads = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                    sums[:, doc[heads]] = [np.add.reduceat(x[index] * links, heads) for x in (top, n)]
                own = {"step": [row["step"]] * size, "at": range(size), "n_best": sums[0], "count_sum": sums[1]}
                yield pa.RecordBatch.from_arrays([pa.array(own[c] if c in own else row[c], pa.string() if c.startswith("groups") else pa.int64()) for c in names], names)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pairs, n = found(row)
                doc, index, links = _entries(row)
                which = np.flatnonzero(n[index] == 0) if len(pairs) else index
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(which), row["step"])), pa.array(doc[which]), pa.array(pairs[index[which]]), pa.array(links[which])], ["step", "at", "pair", "links"])

    names = ["step", "at", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if groups_too else [])]
    out = made.mapInArrow(scored, ", ".join(f"{c} {'string' if c.startswith('groups') else 'long'}" for c in names))
    if least > 1:  # else every pair is among the broadcast ones
        cold = counts.where(F.col("n") < least).withColumn("a_id", a_id).join(F.broadcast(greatest), "a_id").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("top"))
        cold = matched(made.select("step", "pairs", "docs", "entries", "indices", "links").mapInArrow(rest, "step long, at long, pair long, links long"), cold, ["pair"])
        cold = cold.groupBy("step", "at").agg(F.sum(F.col("top") * F.col("links")).alias("_best"), F.sum(F.col("n") * F.col("links")).alias("_sum"))
        out = out.join(cold, ["step", "at"], "left").withColumns({"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))})
    return out.select(*names[2:])
