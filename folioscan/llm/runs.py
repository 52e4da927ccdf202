"""Groups of any size in sorted order: places within a group, and SHA-256 of a group's bytes.

Both sort over all partitions (a range exchange), so that one group may fill many tasks. Only what stands at the edges
of partitions is told apart from the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from folioscan.llm.common import saved

#: Bytes of a group that are held before they are passed on.
PIECE_BYTES = 1 << 20


def numbered(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """rows with place: 0, 1, ... within the long column group (no nulls), in this order.

    The driver gets one row for each run of a group that crosses partitions: at most two a partition.
    """
    ordered = saved(rows.sort(group, *order))
    part = F.spark_partition_id().alias("p")
    crossing = ordered.groupBy(group, part).agg(F.count("*").alias("n")).groupBy(group).agg(F.sort_array(F.collect_list(F.struct("p", "n"))).alias("runs")).where(F.size("runs") > 1).select("runs").collect()
    before: dict[int, int] = {}
    for row in crossing:
        total = 0
        for p, n in row.runs:
            before[p] = before.get(p, 0) + total
            total += n
    at = ordered.columns.index(group)
    schema = StructType([*ordered.schema, StructField("place", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, count = None, 0
        first = before.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column(at).to_numpy(zero_copy_only=False)
            heads = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            base = np.zeros(len(heads), np.int64)
            base[0] = first if now is None else count if g[0] == now else 0
            sizes = np.diff(np.append(heads, len(g)))
            place = np.arange(len(g)) - np.repeat(heads - base, sizes)
            now, count = g[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], [*batch.schema.names, "place"])

    return ordered.mapInArrow(run, schema)


def digests(rows: DataFrame, keys: list[str], payloads: list[str], sums: list[str] = (), sep: bytes = b"") -> DataFrame:
    """For each value of the long columns keys: the sums, and the SHA-256 (hex, under the payload's name) of the binary
    payload columns joined by sep, in the order of rows, whose partitions have to be sorted by keys and over all.

    A group within one partition is done there. Of groups at an edge of a partition, or of more than PIECE_BYTES, the
    bytes are passed on in pieces and hashed one piece at a time, which is all that one task has to do for them.
    """
    keys, payloads, sums = list(keys), list(payloads), list(sums)
    names = [*keys, "_seq", *sums, *payloads, *(f"_{p}" for p in payloads)]
    schema = pa.schema([*((k, pa.int64()) for k in keys), ("_seq", pa.int64()), *((s, pa.int64()) for s in sums), *((p, pa.string()) for p in payloads), *((f"_{p}", pa.large_binary()) for p in payloads)])
    ddl = ", ".join([*(f"`{k}` long" for k in keys), "_seq long", *(f"`{s}` long" for s in sums), *(f"`{p}` string" for p in payloads), *(f"`_{p}` binary" for p in payloads)])
    some = rows.select(*keys, *(F.col(s).cast("long").alias(s) for s in sums), *payloads)
    nk, ns = len(keys), len(sums)

    def out(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), schema)], schema=schema)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = TaskContext.get().partitionId() << 40
        now, total, held, size, edge, made, made_size = None, [0] * ns, [[] for _ in payloads], 0, True, [], 0

        def passed(whole: bool) -> None:
            """The group's sums with digests, if it is whole, or else with its bytes."""
            nonlocal seq, total, held, size, made_size
            joined = [sep.join(x) for x in held]
            made.append((*now, seq, *total, *((hashlib.sha256(x).hexdigest() if whole else None) for x in joined), *(None if whole else x for x in joined)))
            made_size += 0 if whole else size
            seq, total, held, size = seq + 1, [0] * ns, [[] for _ in payloads], 0

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns):
                key = row[:nk]
                if key != now:
                    if now is not None:
                        passed(whole=not edge)
                        edge = False
                    now = key
                for i in range(ns):
                    total[i] += row[nk + i]
                for x, value in zip(held, row[nk + ns :]):
                    x.append(bytes(value))
                    size += len(value)
                if size > PIECE_BYTES:
                    passed(whole=False)
                    edge = True
                if made_size > PIECE_BYTES or len(made) >= 10_000:
                    yield out(made)
                    made, made_size = [], 0
        if now is not None:
            if held[0]:
                passed(whole=False)
            if made:
                yield out(made)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, hashes, made = None, [], [], []
        end = lambda: made.append((*now, None, *total, *(h.hexdigest() for h in hashes), *(None for _ in payloads)))
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key, rest = row[:nk], row[nk + 1 :]
                pieces = rest[ns + len(payloads) :]
                if pieces[0] is None:
                    made.append((*key, None, *rest))
                    continue
                if key != now:
                    if now is not None:
                        end()
                    now, total, hashes = key, [0] * ns, [hashlib.sha256() for _ in payloads]
                    fresh = True
                for i in range(ns):
                    total[i] += rest[i]
                for h, piece in zip(hashes, pieces):
                    if not fresh:
                        h.update(sep)
                    h.update(piece)
                fresh = False
            if len(made) >= 10_000:
                yield out(made)
                made.clear()
        if now is not None:
            end()
        if made:
            yield out(made)

    parts = some.mapInArrow(inside, ddl)
    return parts.repartition(*keys).sortWithinPartitions(*keys, "_seq").mapInArrow(across, ddl).select(*keys, *sums, *payloads)
