"""Exact removal of byte strings that occur twice, from sorted suffixes of anchored contexts.

Every window of `width` bytes has one anchor, the k-byte string in it of least hash (the leftmost of equals), so equal
windows have equal anchors at equal places. An anchor and the windows that it stands for span a context of less than
twice the width. All contexts of an anchor that stands twice or more go through one sort: the suffixes that begin at
the anchors and, reversed, what precedes them are ordered by deep-shallow sorting (multikey quicksort to a shallow
depth, then blind tries for groups that share more), and the common prefixes of neighbours say which windows are equal.

Contexts of one 128-bit digest are one suffix with a count before they are sorted, so of copies of a text, however many,
one is sorted; rows equal in doc_id too share one list of spans. An anchor of very many different contexts (a license line between other texts) is lengthened by the bytes
that half of its windows share to the right, and the other half to the left, again and again, until each group of
contexts fits a task; all of them end in the same sort.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import BROADCAST_ROWS, arrow_limits, byte_values, keyed, matched, mixed, per_row, saved, steps, stored, window_hash

WIDTH, ANCHOR_LOG2 = 200, 5
#: Depth in bytes of the quicksort; contexts compared at a time; from so many contexts of an anchor on, it is lengthened.
SHALLOW, AT_ONCE, MOST_CONTEXTS = 64, 40_000, 8_000
_VALUES = byte_values(9)


def anchors(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, anchor_log2: int = ANCHOR_LOG2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor, its position, first and last start of its windows) for each run of windows with one anchor."""
    size = 1 << anchor_log2
    keys = mixed(window_hash(data, anchor_log2, _VALUES))
    spread = width - size + 1
    empty = np.zeros(0, np.int64)
    if len(keys) < spread:
        return keys[:0], empty, empty, empty
    mask = np.uint64((1 << max(24, int(len(keys)).bit_length())) - 1)
    packed = (keys & ~mask) | np.arange(len(keys), dtype=np.uint64)
    rows = -(-len(packed) // spread)
    grid = np.full(rows * spread, ~np.uint64(0), np.uint64)
    grid[: len(packed)] = packed
    grid = grid.reshape(rows, spread)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(packed) - spread + 1
    least = np.minimum(behind[:n], ahead[spread - 1 : spread - 1 + n])
    whole = np.zeros(len(data) + 1, np.int32)
    long = np.flatnonzero(np.diff(offsets) >= width)
    np.add.at(whole, offsets[long], 1)
    np.add.at(whole, offsets[long + 1] - width + 1, -1)
    start = np.flatnonzero(np.cumsum(whole[:n]) > 0)
    if not len(start):
        return keys[:0], empty, empty, empty
    at = (least[start] & mask).astype(np.int64)
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)])
    first = np.flatnonzero(new)
    return keys[at[first]], at[first], start[first], start[np.concatenate([first[1:], [len(start)]]) - 1]


def shallow_sort(rows: np.ndarray, group: np.ndarray, depth: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, group in that order) of equal-sized byte strings by group and their first `depth` bytes: multikey
    quicksort. A pass splits every part of several rows by one word of eight bytes into less than, equal to and greater
    than its pivot (the median of three); the equal ones go on with their next word. All parts are split side by side."""
    order = np.argsort(group, kind="stable")
    word = np.ascontiguousarray(rows[:, : depth // 8 * 8]).view(">u8").astype(np.uint64)
    part = np.cumsum(np.concatenate([[False], group[order][1:] != group[order][:-1]])) if len(order) else order
    at_word = np.zeros(len(order), np.int64)  # of the row in this place
    while len(order):
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        size = np.diff(np.concatenate([first, [len(part)]]))
        open_ = (size > 1) & (at_word[first] < word.shape[1])
        if not open_.any():
            break
        at, n = np.flatnonzero(np.repeat(open_, size)), size[open_]
        value = word[order[at], at_word[at]]
        begin = np.cumsum(n) - n
        pivot = np.sort(np.stack([value[begin], value[begin + n // 2], value[begin + n - 1]]), axis=0)[1]
        side = (value > np.repeat(pivot, n)).astype(np.int64) + (value >= np.repeat(pivot, n))
        key = 3 * np.repeat(np.arange(len(n)), n) + side
        by = np.argsort(key, kind="stable")
        order[at], at_word[at] = order[at][by], at_word[at][by] + (side[by] == 1)
        # parts are numbered anew: they begin where they did, or where the side changes
        new = np.zeros(len(part), bool)
        new[first] = True
        new[at[1:]] |= key[by][1:] != key[by][:-1]
        part = np.cumsum(new) - 1
    return order, part


def blind_trie_order(strings: list[bytes]) -> list[int]:
    """Order of equal-sized strings by a blind trie: nodes keep a depth and branch on one byte; a string goes down to
    some leaf without comparing, one comparison with that leaf finds where it differs, and there it is put in."""
    if len(strings) == 2:
        return [0, 1] if strings[0] <= strings[1] else [1, 0]
    size = len(strings[0])
    number = [int.from_bytes(s, "big") for s in strings]
    root: list = [size, [0]]  # [depth, rows] of a leaf, [depth, children by byte] of a node
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while isinstance(node[1], dict):
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        differs = number[i] ^ number[node[1][0]]
        if not differs:
            node[1].append(i)
            continue
        depth = size - (differs.bit_length() + 7) // 8
        other = strings[node[1][0]]
        node = root
        while node[0] < depth:
            node = node[1][s[node[0]]]
        if node[0] == depth and isinstance(node[1], dict):
            node[1][s[depth]] = [size, [i]]
        else:
            node[1] = {other[depth]: [node[0], node[1]], s[depth]: [size, [i]]}
            node[0] = depth
    out, stack = [], [root]
    while stack:
        _, under = stack.pop()
        if isinstance(under, dict):
            stack += [under[c] for c in sorted(under, reverse=True)]
        else:
            out += under
    return out


def deep_shallow_sort(rows: np.ndarray, group: np.ndarray, depth: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order by group and bytes, bytes that each row shares with the one before it; -1 where a group begins)."""
    order, fine = shallow_sort(rows, group, depth)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(fine)) + 1, [len(order)]])
    for a, b in zip(cuts[:-1][np.diff(cuts) > 1].tolist(), cuts[1:][np.diff(cuts) > 1].tolist()):
        part = order[a:b]
        order[a:b] = part[blind_trie_order([rows[i, depth:].tobytes() for i in part])]
    shared = np.full(len(order), -1)
    for a in range(1, len(order), 8192):  # in blocks, as the comparison holds a byte for each byte compared
        b = min(a + 8192, len(order))
        differ = rows[order[a:b]] != rows[order[a - 1 : b - 1]]
        shared[a:b] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    shared[1:][group[order][1:] != group[order][:-1]] = -1
    return order, shared


def equal_windows(group: np.ndarray, texts_: list[bytes], off: np.ndarray, lo: np.ndarray, hi: np.ndarray, copies: np.ndarray, width: int = WIDTH, anchor_log2: int = ANCHOR_LOG2) -> np.ndarray:
    """found[i, o]: the window of context i that starts o bytes before its anchor equals one of another context of the
    same group, or of a copy of i. off: where the anchor is in the context; o runs from lo to hi. Contexts that are
    alone in their group have nothing to be ordered among."""
    n, reach = len(texts_), width - (1 << anchor_log2)
    found = np.zeros((n, reach + 1), bool)
    every = np.arange(reach + 1)
    found[copies > 1] = (every >= lo[copies > 1, None]) & (every <= hi[copies > 1, None])
    _, which, size = np.unique(group, return_inverse=True, return_counts=True)
    some = np.flatnonzero(size[which] > 1)
    if not len(some):
        return found
    group, off, lo, hi, n = group[some], off[some], lo[some], hi[some], len(some)
    right, left = np.zeros((n, width), np.uint8), np.zeros((n, -(-reach // 8) * 8), np.uint8)
    for i, (k, a) in enumerate(zip(some.tolist(), off.tolist())):
        x = np.frombuffer(texts_[k], np.uint8)
        ahead, back = x[a : a + width], x[max(0, a - reach) : a][::-1]
        right[i, : len(ahead)] = ahead
        left[i, : len(back)] = back
    r_order, r_shared = deep_shallow_sort(right, group)
    l_order, l_shared = deep_shallow_sort(left, group)
    l_class, r_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(reach + 1):
        own = np.flatnonzero((lo <= o) & (o <= hi))
        if len(own) < 2:
            continue
        l_class[l_order] = np.cumsum(l_shared < o)
        r_class[r_order] = np.cumsum(r_shared < width - o)
        key = l_class[own] * (n + 1) + r_class[own]
        by = np.argsort(key)
        same = key[by][1:] == key[by][:-1]
        found[some[own[by[1:][same]]], o] = True
        found[some[own[by[:-1][same]]], o] = True
    return found


_ROW = "id long, row long"


def _occurrences(rows: DataFrame) -> DataFrame:
    """(h, c, id, row, place) of every context: hashes of the anchor and of the context; place packs the first
    window's start, the number of windows and the anchor's offset. h and c together are 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_digest
        for part, data, offsets in steps(batches, most=1 << 20):
            h, at, first, last = anchors(data, offsets)
            if not len(h):
                continue
            text = data.tobytes()
            c = np.frombuffer(b"".join([digest(text[i : j + WIDTH]) for i, j in zip(first.tolist(), last.tolist())]), np.int64)
            of = np.searchsorted(offsets, first, "right") - 1
            place = ((first - offsets[of]) << 16) | ((last - first + 1) << 8) | (at - first)
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c), part.column(0).take(take), part.column(1).take(take), pa.array(place)], ["h", "c", "id", "row", "place"])

    return rows.mapInArrow(run, f"h long, c long, {_ROW}, place long")


#: A context: its anchor (h) and own hash (c), how often it stands (n), one place of it, its group (g: the anchor, until
#: that is lengthened), the bytes that all contexts of the group share left and right of the anchor's start (a, b), the
#: windows looked at (those that start lo to hi bytes before the anchor).
_PIECE = f"{_ROW}, g long, h long, c long, n long, place long, a int, b int, lo int, hi int, piece binary"
_PIECE_NAMES = ["id", "row", "g", "h", "c", "n", "place", "a", "b", "lo", "hi", "piece"]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts out of texts: rows (id, row, text, wanted) to pieces. What stands alone needs no bytes. Rows of one id
    and text meet in one task, or in a few if they are very many, and each task cuts one of them."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        fresh = [i for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())) if key not in seen and not seen.add(key)]
        batch, out = batch.take(pa.array(fresh, pa.int64())), []
        for i, (text, wanted) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            data = text.encode()
            for x in wanted:
                at, count, off = x["place"] >> 16, (x["place"] >> 8) & 255, x["place"] & 255
                out.append((i, x["h"], x["c"], x["n"], x["place"], off - count + 1, off, data[at : at + count - 1 + WIDTH] if x["kinds"] > 1 else b""))
        if not out:
            continue
        of, h, c, n, place, lo, hi, piece = zip(*out)
        take, long, small = pa.array(of), pa.int64(), pa.int32()
        shared = pa.array([0] * len(of), small), pa.array([1 << ANCHOR_LOG2] * len(of), small)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array(x, long) for x in (h, h, c, n, place)), *shared, pa.array(lo, small), pa.array(hi, small), pa.array(piece, pa.binary())], _PIECE_NAMES)


def _lengthen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece in two groups: windows that start at most m bytes before the anchor share the bytes up to width - m
    behind its start, the others share m + 1 bytes before it; m halves what is left."""
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        out = []
        for i, r in enumerate(batch.to_pylist()):
            off, a, b, piece = r["place"] & 255, r["a"], r["b"], r["piece"]
            m = a + (WIDTH - a - b) // 2
            for side, (lo, hi, a2, b2) in enumerate(((r["lo"], min(r["hi"], m), a, WIDTH - m), (max(r["lo"], m + 1), r["hi"], m + 1, b))):
                if lo <= hi:
                    key = digest(piece[off - a2 : off + b2], seed=(r["g"] + side) % (1 << 64))
                    out.append((i, key - (1 << 64) if key >> 63 else key, a2, b2, lo, hi))
        if not out:
            continue
        of, g, *limits = zip(*out)
        columns = [x.take(pa.array(of)) for x in batch.columns]
        columns[2] = pa.array(g, pa.int64())
        columns[7:11] = [pa.array(x, pa.int32()) for x in limits]
        yield pa.RecordBatch.from_arrays(columns, _PIECE_NAMES)


def _large(pieces: DataFrame, most: int) -> DataFrame:
    return pieces.groupBy("g").agg(F.count("*").alias("size")).where(F.col("size") >= most).select("g")


def _split(pieces: DataFrame, many: DataFrame, how: str) -> DataFrame:
    """The pieces of the groups in many (left_semi), or of the others (left_anti): where they are, if many is small."""
    if many.count() <= BROADCAST_ROWS:
        return pieces.join(F.broadcast(many), "g", how).select(*pieces.columns)  # in their order
    return matched(pieces, many, ["g"], "inner" if how == "left_semi" else how)


def _sorted(pieces: DataFrame) -> DataFrame:
    return pieces.repartition("g").sortWithinPartitions("g").mapInArrow(_compare, _EQUAL)


_EQUAL = f"h long, c long, {_ROW}, start long, stop long, copies boolean"


def _equal(pieces: DataFrame, kinds: DataFrame) -> DataFrame:
    """What `_compare` finds in pieces. Counts of kinds say which anchors have too many contexts for one task; their
    pieces are put into groups of longer anchors, round by round, until every group fits."""
    many = saved(kinds.groupBy("h").agg(F.count("*").alias("size")).where(F.col("size") >= MOST_CONTEXTS).select(F.col("h").alias("g")))
    if many.isEmpty():
        return _sorted(pieces)
    pieces = stored(pieces)  # read twice, made once
    out, rest = _sorted(_split(pieces, many, "left_anti")), _split(pieces, many, "left_semi")
    while True:
        rest = saved(rest.mapInArrow(_lengthen, _PIECE))
        # with all of a window's bytes in the anchor, the windows of a group are one string
        whole = rest.where(F.col("a") + F.col("b") >= WIDTH)
        start = F.shiftright("place", 16) + F.col("place").bitwiseAND(F.lit(255)) - F.col("lo")
        out = out.unionByName(matched(whole, _large(whole, 2), ["g"]).select("h", "c", "id", "row", start.alias("start"), (start + WIDTH).alias("stop"), (F.col("n") > 1).alias("copies")))
        rest = rest.where(F.col("a") + F.col("b") < WIDTH)
        many = saved(_large(rest, MOST_CONTEXTS))
        out = out.unionByName(_sorted(_split(rest, many, "left_anti")))
        if many.isEmpty():
            return out
        rest = _split(rest, many, "left_semi")


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows (id, row, doc_id, text) of docs, where id and row, 128 bits, tell rows apart by doc_id and
    text; spans (id, row, start, stop) of bytes that repeated windows cover, which may overlap and repeat."""
    arrow_limits(docs.sparkSession)
    rows = keyed(docs).select(F.coalesce("doc_id", "k2").alias("id"), F.col("k1").alias("row"), "doc_id", "text")
    every = _occurrences(rows.select("id", "row", "text"))
    often = every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    again = saved(matched(every, often, ["h"]))
    kinds = again.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("id", "row", "place")).alias("one"))
    variants = kinds.groupBy("h").agg(F.count("*").alias("kinds"))
    # one of each kind, with its bytes
    wanted = kinds.join(variants, "h").select("h", "c", "n", "kinds", "one.*").groupBy("id", "row").agg(F.collect_list(F.struct("h", "c", "n", "place", "kinds")).alias("wanted")).hint("shuffle_hash")
    pieces = rows.join(wanted, ["id", "row"]).select("id", "row", "text", "wanted").mapInArrow(_cut, _PIECE)
    equal = saved(_equal(pieces, kinds))
    # a context that stands more than once is removed wherever it stands
    start = F.shiftright("place", 16)
    whole = matched(again, equal.where("copies").select("h", "c").distinct(), ["h", "c"])
    spans = whole.select("id", "row", start.alias("start"), (start + F.shiftright("place", 8).bitwiseAND(F.lit(255)) + (WIDTH - 1)).alias("stop"))
    return rows, spans.unionByName(equal.where("not copies").select("id", "row", "start", "stop"))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of equal windows in pieces that come in the order of g; whole groups of about AT_ONCE at a time. A context
    that stands more than once gives one row, without a place."""
    held: list[pa.RecordBatch] = []

    def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = pa.Table.from_batches(parts).combine_chunks()
        g, place, n, lo, hi = (x[k].to_numpy() for k in ("g", "place", "n", "lo", "hi"))
        group = np.cumsum(np.concatenate([[0], g[1:] != g[:-1]]))
        off = place & 255
        found = equal_windows(group, x["piece"].to_pylist(), off, lo, hi, n)
        edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        i, first = np.nonzero(edge == 1)
        last = np.nonzero(edge == -1)[1] - 1
        at = (place >> 16)[i] + off[i]
        if len(i):
            take = pa.array(i)
            yield pa.RecordBatch.from_arrays([*(x[k].combine_chunks().take(take) for k in ("h", "c", "id", "row")), pa.array(at - last), pa.array(at - first + WIDTH), pa.array(n[i] > 1)], ["h", "c", "id", "row", "start", "stop", "copies"])

    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column(2).to_numpy(zero_copy_only=False)
        new = np.flatnonzero(np.concatenate([[bool(held) and held[-1].column(2)[-1].as_py() != g[0]], g[1:] != g[:-1]]))
        if rows + batch.num_rows >= AT_ONCE and len(new):
            cut = int(new[-1])
            yield from done([*held, batch.slice(0, cut)])
            held, rows, batch = [], 0, batch.slice(cut)
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield from done(held)


def without_repeats(docs: DataFrame, texts_too: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (binary).

    A byte is removed if a string of 200 bytes that covers it also starts elsewhere, in this text or another row's;
    all copies go, as judged on the input. Null and empty texts have no bytes; texts under 200 bytes keep all theirs;
    rows that repeat are copies of each other; rows that share a doc_id, or have none, are told apart by their text;
    other columns play no part; an empty table gives an empty result.
    """
    rows, spans = repeated_spans(docs)
    gone = spans.groupBy("id", "row").agg(F.collect_set(F.struct("start", "stop")).alias("gone"))  # rows of one id and text share theirs
    both = rows.join(gone.hint("shuffle_hash"), ["id", "row"], "left").select("doc_id", "text", F.col("gone.start").alias("start"), F.col("gone.stop").alias("stop"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in steps(batches, most=1 << 20):
            edge = np.zeros(len(data) + 1, np.int32)
            for name, by in (("start", 1), ("stop", -1)):
                lists = part.column(part.schema.get_field_index(name))
                n = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
                values = lists.flatten().to_numpy(zero_copy_only=False)
                np.add.at(edge, values + np.repeat(offsets[:-1], n), by)
            gone = np.cumsum(edge[:-1]) > 0
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            heads = offsets[:-1][offsets[:-1] < len(data)]
            begins[heads] = gone[heads]
            kept = data[~gone].tobytes()
            ends = np.concatenate([[0], np.cumsum(per_row(~gone, offsets))]).tolist()
            pieces = [kept[a:b] for a, b in zip(ends, ends[1:])]
            out = [part.column(0), pa.array(np.diff(offsets)), pa.array(per_row(gone, offsets)), pa.array(per_row(begins, offsets)), pa.array([hashlib.sha256(p).hexdigest() for p in pieces], pa.string())]
            yield pa.RecordBatch.from_arrays([*out, *([pa.array(pieces, pa.binary())] if texts_too else [])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts_too else [])])

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts_too)
