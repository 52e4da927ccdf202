"""Substring deduplication by content-defined chunks.

A gear hash rolls over the UTF-8 bytes of each text and cuts where its top bits are zero, so the cuts of a passage are
the same wherever it stands, whatever was inserted before it. Chunks are deduplicated by a 128-bit digest. Every
repeated chunk is reported; what is cut out are passages, runs of them, as a phrase of a few words is no copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import arrow_limits, byte_values, keyed, matched, saved, steps

#: Bytes that the gear hash looks back, zero bits that make a cut, and the sizes a chunk may have (a whole text may be less).
LOOK_BACK, CUT_BITS, LEAST, MOST = 16, 4, 16, 64
#: A run of repeated chunks of so many bytes, or of a whole text, is a passage.
PASSAGE = 80
_GEAR = byte_values(6)


def gear_hash(data: np.ndarray, look_back: int = LOOK_BACK) -> np.ndarray:
    """h[i] = sum of gear(data[i - k]) << 4 k for k < look_back, by doubling; look_back is a power of two."""
    h, k = _GEAR[data], 1
    while k < look_back and k < len(h):
        h[k:] += h[:-k] << np.uint64(4 * k)
        k *= 2
    return h


def chunk_cuts(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """For each row: its chunks' ends. Cuts depend on the row's own bytes alone: a cut is where the hash has zero bits;
    where none comes in time, where it is least."""
    inside = (data & 0xC0) == 0x80  # no cut falls within a code point
    hashes = gear_hash(data)
    value = np.concatenate([hashes[:1], hashes])  # of a cut before each byte
    value[:-1][inside] = ~np.uint64(0)
    at = np.flatnonzero(hashes[:-1] >> np.uint64(64 - CUT_BITS) == 0) + 1
    at = at[~inside[at]]
    first = np.searchsorted(at, offsets[:-1] + LOOK_BACK)
    last = np.searchsorted(at, offsets[1:])
    found, bounds, out = at.tolist(), offsets.tolist(), []

    def forced(here: int) -> int:
        low = here + max(LEAST, LOOK_BACK)
        cut = low + int(value[low : here + MOST + 1].argmin())
        while inside[cut]:
            cut -= 1
        return cut

    for a, b, i, j in zip(bounds, bounds[1:], first.tolist(), last.tolist()):
        cuts, here = [], a
        for c in found[i:j]:
            if c - here >= LEAST:
                while c - here > MOST:
                    here = forced(here)
                    cuts.append(here)
                if c - here >= LEAST:
                    here = c
                    cuts.append(c)
        while b - here > MOST:
            here = forced(here)
            cuts.append(here)
        if here < b:
            if cuts and b - here < LEAST:  # a short end joins the chunk before it, or takes bytes from it
                before = cuts[-2] if len(cuts) > 1 else a
                cuts.pop()
                if b - before > MOST:
                    here = b - LEAST
                    while inside[here]:
                        here -= 1
                    cuts.append(here)
            cuts.append(b)
        out.append(cuts)
    return out


_PLACE = "id long, row long, none boolean, start int, size int, ends boolean"


def chunks(docs: DataFrame) -> DataFrame:
    """(d1, d2, id, row, none, start, size, ends) of every chunk of every text: the halves of its digest; id, row and
    none tell rows apart (doc_id and a hash of the text, or two hashes where doc_id is null); whether the text ends."""
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for rows, data, offsets in steps(batches):
            text, cuts = data.tobytes(), chunk_cuts(data, offsets)
            n = np.array([len(c) for c in cuts])
            ends = np.array([c for x in cuts for c in x], np.int64)
            if not len(ends):
                continue
            starts = np.concatenate([[0], ends[:-1]])  # rows follow one another without a gap
            halves = np.frombuffer(b"".join([digest(text[i:j]) for i, j in zip(starts.tolist(), ends.tolist())]), np.int64).reshape(-1, 2)
            of = np.repeat(np.arange(len(n)), n)
            take = pa.array(of)
            place = [pa.array((starts - offsets[of]).astype(np.int32)), pa.array((ends - starts).astype(np.int32)), pa.array(ends == offsets[of + 1])]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(halves[:, i])) for i in (0, 1)), *(rows.column(i).take(take) for i in range(3)), *place], ["d1", "d2", "id", "row", "none", "start", "size", "ends"])

    return _rows(docs).mapInArrow(run, f"d1 long, d2 long, {_PLACE}")


def _rows(docs: DataFrame) -> DataFrame:
    return keyed(docs).select(F.coalesce("doc_id", "k2").alias("id"), F.col("k1").alias("row"), F.col("doc_id").isNull().alias("none"), "text")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row for each document: what of it stands elsewhere too, in it or in another document.

    doc_id; n_chunks: its repeated chunks; n_shared: their bytes; n_passage: bytes of them in passages, which are runs
    of PASSAGE bytes or more, or whole texts; n_removed: bytes of passages less the chunks whose first place (by doc_id,
    then position) is here; spans: the removed runs as start:end in UTF-8 bytes, comma-joined; row_id and row_key: what
    tells rows apart, for `without_spans`. A chunk's first place stays, so one copy of every passage is kept.

    Null and empty texts have no chunk and zeros. Rows are told apart by doc_id and text: rows that repeat both are one
    document; different texts under one doc_id are different documents, also where doc_id is null (these come last, by
    a hash). Other columns play no part; an empty table gives no rows.
    """
    every = chunks(docs)
    often = every.groupBy("d1").agg(F.count("*").alias("n")).where("n > 1").select("d1")
    again = saved(matched(every, often, ["d1"]))
    order = F.struct("none", "id", "row", "start")
    places = again.groupBy("d1", "d2").agg(F.min(order).alias("kept"), F.max(order).alias("last")).where("kept <> last").select("d1", "d2", "kept")
    found = matched(again, places, ["d1", "d2"]).select("id", "row", "none", F.struct("start", "size", "ends", (order == F.col("kept")).alias("here")).alias("chunk"))
    whole_table = _rows(docs).select("id", "row", "none", F.lit(None).cast(found.schema["chunk"].dataType).alias("chunk"))
    listed = found.unionByName(whole_table).groupBy("id", "row", "none").agg(F.collect_set("chunk").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for found in batch.column(3):
                if not len(found):
                    out.append((0, 0, 0, 0, ""))
                    continue
                fields = [found.values.field(i).to_numpy(zero_copy_only=False) for i in range(4)]
                order = np.argsort(fields[0], kind="stable")
                start, size, ends, here = (x[order] for x in fields)
                run_of = np.cumsum(np.concatenate([[True], start[1:] != start[:-1] + size[:-1]])) - 1
                whole = np.bincount(run_of[ends], minlength=run_of[-1] + 1).astype(bool) & (start[np.searchsorted(run_of, np.arange(run_of[-1] + 1))] == 0)
                passage = (whole | (np.bincount(run_of, size) >= PASSAGE))[run_of]
                gone = passage & ~here
                spans: list[list[int]] = []
                for a, n in zip(start[gone].tolist(), size[gone].tolist()):
                    if spans and spans[-1][1] == a:
                        spans[-1][1] = a + n
                    else:
                        spans.append([a, a + n])
                out.append((len(start), int(size.sum()), int(size[passage].sum()), int(size[gone].sum()), ",".join(f"{a}:{b}" for a, b in spans)))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string())], ["id", "row", "none", "n_chunks", "n_shared", "n_passage", "n_removed", "spans"])

    runs = listed.mapInArrow(run, "id long, row long, none boolean, n_chunks long, n_shared long, n_passage long, n_removed long, spans string")
    return runs.select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), "n_chunks", "n_shared", "n_passage", "n_removed", "spans", F.col("id").alias("row_id"), F.col("row").alias("row_key"))


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, text) of every row of docs with the spans of `repeated_passages` cut out of that row's own text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, cut in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data, at, parts = text.encode(), 0, []
                for a, b in (map(int, s.split(":")) for s in (cut or "").split(",") if s):
                    parts.append(data[at:a])
                    at = b
                out.append(b"".join([*parts, data[at:]]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    rows = keyed(docs)
    cut = spans.where("spans <> ''").select("row_id", "row_key", "spans")
    joined = rows.join(cut, (F.coalesce("doc_id", "k2") == F.col("row_id")) & (F.col("k1") == F.col("row_key")), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, text string")
