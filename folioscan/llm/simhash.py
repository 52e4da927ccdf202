"""SimHash near-duplicates by a generalised pigeonhole principle.

Fingerprint bits are ordered so that correlated ones are neighbours and cut into partitions. A partition of threshold t
is looked up within t bits; the thresholds of m partitions sum to radius - m + 1, so two fingerprints within the radius
meet in at least one partition (General Pigeonhole, Qin et al. 2018). One dynamic program picks the partitions' sizes
and their thresholds, unequal where bits are skewed or correlated, from the expected number of keys and candidates.
Copies share a fingerprint and are one row in all of this.

A partition's value that too many fingerprints share is looked up together with further partitions of the other bits,
until every group fits a task. Links within a group of candidates are reduced to trees before they leave their task,
so groups of near copies never become pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import arrow_limits, matched, saved, steps, texts
from folioscan.llm.components import connected_components

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: Cost of a key that is shuffled, in units of a pair that is compared.
KEY_COST = 200
#: Keys of a partition beyond which its threshold is not considered; a threshold of 0 always is.
MOST_KEYS = 2000
#: Groups of up to PAIRS fingerprints are compared side by side, up to GRID each as a grid; larger ones grow trees, and
#: beyond DEEP they are divided first. Groups beyond CROWD are divided before they are dealt.
PAIRS, GRID, DEEP, CROWD = 8, 1500, 8192, 50_000


#: Hashes whose bits are unpacked at a time (64 bytes each).
SLICE = 1 << 16


def majority(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each run of hashes between positions: the bits that are set in over half of them. Bits are counted over
    slices, so that a very long run takes no more memory than its hashes."""
    ones = np.zeros((len(at) - 1, BITS), np.int64)
    for low in range(0, len(hashes), SLICE):
        part = hashes[low : low + SLICE]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        first, last = int(np.searchsorted(at, low, "right")) - 1, int(np.searchsorted(at, low + len(part), "left"))
        cuts = np.clip(at[first:last] - low, 0, None)
        ones[first:last] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > np.diff(at)[:, None], axis=1).view(">u8").ravel()


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The unsigned fingerprint of each row of text."""
    digest, join = xxhash.xxh64_digest, b" ".join
    text, cuts = data.tobytes().lower(), offsets.tolist()
    parts, counts = [], []
    for a, b in zip(cuts, cuts[1:]):
        words = text[a:b].split()
        if len(words) >= shingle:
            parts += [digest(join(s), SEED) for s in zip(*(words[k:] for k in range(shingle)))]
            counts.append(len(words) - shingle + 1)
        elif words:
            parts.append(digest(join(words), SEED))
            counts.append(1)
        else:
            counts.append(0)
    some = np.flatnonzero(counts)
    hashes = np.frombuffer(b"".join(parts), ">u8").astype(np.uint64)
    out = np.zeros(len(counts), np.uint64)
    if len(some):
        out[some] = majority(hashes, np.concatenate([[0], np.cumsum(np.array(counts)[some])]))
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): 64-bit SimHash of the word shingles of the whole ASCII-lower-cased text, as a signed long.

    Words are `[^\\x20\\x09-\\x0D]+`; a text of fewer words than a shingle is one shingle; no word (or null): zero.
    """
    arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in steps(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fingerprints_of(data, offsets, shingle).view(np.int64))], ["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """(number of fingerprints, how often bits i and j are both set) over all rows of the one column: 2,081 sums reach
    the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            x = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64).astype(">u8")).view(np.uint8)
            bits = np.unpackbits(x.reshape(-1, 8), axis=1).astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        i, j = np.triu_indices(BITS)
        cells = np.concatenate([[-1], i * BITS + j]), np.concatenate([[n], total[i, j]])
        yield pa.RecordBatch.from_arrays([pa.array(cells[0], pa.int32()), pa.array(cells[1].astype(np.int64))], ["cell", "n"])

    found = dict(fps.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect())
    n, both = found.pop(-1, 0), np.zeros((BITS, BITS))
    for cell, count in found.items():
        both[cell // BITS, cell % BITS] = both[cell % BITS, cell // BITS] = count
    return n, both


def correlated_order(n: int, both: np.ndarray) -> list[int]:
    """Bits 0 (highest) to 63, from the most skewed on each followed by the free one that correlates most with it."""
    p = np.diag(both) / max(n, 1)
    deviation = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    strength = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(deviation, deviation))
    out = [int(np.argmax(np.abs(p - 0.5)))]
    while len(out) < BITS:
        free = [b for b in range(BITS) if b not in out]
        out.append(max(free, key=lambda b: (strength[b, out[-1]], -b)))
    return out


def agreements(n: int, both: np.ndarray, order: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(single, then): the chance that two fingerprints agree in the bit at each place of the order, and in it given
    that they agree (1) or differ (0) in the bit before it: two rows of then. From the measured pairs of bits."""
    n = max(n, 1)
    p = np.diag(both)[order] / n
    single = p * p + (1 - p) * (1 - p)
    then = np.stack([single, single])
    for k in range(1, BITS):
        x = both[order[k - 1], order[k]] / n
        cells = np.array([x, p[k - 1] - x, p[k] - x, 1 - p[k - 1] - p[k] + x]).clip(0, 1)
        agree = float((cells * cells).sum())  # in both bits
        then[1, k] = agree / single[k - 1] if single[k - 1] > 0 else single[k]
        then[0, k] = (single[k] - agree) / (1 - single[k - 1]) if single[k - 1] < 1 else single[k]
    return single, then.clip(0, 1)


def allocation(n: int, both: np.ndarray, radius: int = RADIUS, key_cost: float = KEY_COST) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] with the least expected cost; thresholds sum to radius - partitions + 1, -1 leaves one out.

    A dynamic program over (bits dealt, thresholds spent) extends the cheapest way by a partition of any size and
    threshold. A threshold costs its keys (the choices of bits to mask) and its candidates: pairs of fingerprints
    expected to differ in d <= t of the partition's bits, once for each key they share. How bits agree follows a chain
    in which each depends on the one before it, as measured, so correlated bits are not counted as so many.
    """
    order = correlated_order(n, both)
    single, then = agreements(n, both, order)
    pairs = 0.5 * max(n, 1) * max(n, 1)
    best: list[dict[int, tuple[float, list]]] = [{} for _ in range(BITS + 1)]
    best[0][0] = (0.0, [])
    for i in range(BITS):
        differ = np.zeros((2, radius + 1))  # by agreement in the last bit and bits that differ so far
        for j in range(i, BITS):
            if j == i:
                differ[1, 0], differ[0, 1:2] = single[i], (1 - single[i]) if radius else 0
            else:
                chance = then[:, j]
                agree = (differ * chance[:, None]).sum(axis=0)
                other = (differ * (1 - chance[:, None])).sum(axis=0)
                differ = np.stack([np.concatenate([[0], other[:-1]]), agree])
            size, total = j - i + 1, differ.sum(axis=0)
            for t in range(-1, min(radius, size - 1) + 1):
                keys = math.comb(size, max(t, 0))
                if keys > MOST_KEYS:
                    break
                cost = 0.0 if t < 0 else n * keys * key_cost + pairs * sum(float(total[d]) * math.comb(size - d, t - d) for d in range(t + 1))
                for spent, (so_far, chosen) in best[i].items():
                    now = spent + t + 1
                    if now <= radius + 1 and (now not in best[j + 1] or best[j + 1][now][0] > so_far + cost):
                        best[j + 1][now] = (so_far + cost, [*chosen, (sorted(order[i : j + 1]), t)])
    return best[BITS][radius + 1][1]


def masks(plan: list[tuple[list[int], int]]) -> list[int]:
    """What to keep of a fingerprint for each key: a partition's bits without t of them."""
    out = []
    for bits, t in plan:
        for gone in itertools.combinations(bits, max(t, 0)) if t >= 0 else ():
            out.append(sum(1 << (BITS - 1 - b) for b in set(bits) - set(gone)))
    return out


def near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= radius


def tree_links(fp: np.ndarray, rep: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links (a, b) that span every component of the fingerprints under the radius, not all of its pairs."""
    out = []
    if len(fp) > DEEP:  # by plain pigeonhole over the bits that vary here
        varying = [b for b in range(BITS) if len(np.unique((fp >> np.uint64(b)) & np.uint64(1))) > 1]
        if len(varying) > radius:
            for k in range(radius + 1):
                part = np.zeros(len(fp), np.uint64)
                for b in varying[k :: radius + 1]:
                    part |= fp & np.uint64(1 << b)
                order = np.argsort(part, kind="stable")
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(part[order])) + 1, [len(fp)]])
                for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    if 1 < j - i < len(fp):
                        out += tree_links(fp[order[i:j]], rep[order[i:j]], radius)
            return out
    if len(fp) <= GRID:
        i, j = np.nonzero(np.triu(near(fp[:, None], fp[None, :], radius), 1))
        if len(i) <= 2 * len(fp):
            return [(rep[i], rep[j])]
    left, left_rep = fp, rep
    while len(left) > 1:
        front, left, left_rep = [(left[0], left_rep[0])], left[1:], left_rep[1:]
        while front and len(left):
            f, r = front.pop()
            hit = near(left, f, radius)
            if hit.any():
                new, new_rep = left[hit], left_rep[hit]
                out.append((np.full(len(new), r), new_rep))
                front += list(zip(new, new_rep))
                left, left_rep = left[~hit], left_rep[~hit]
    return out


def group_links(fp: np.ndarray, rep: np.ndarray, cuts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links in each group of rows between cuts."""
    sizes, out = np.diff(cuts), []
    which = np.repeat(np.arange(len(sizes)), np.where(sizes <= PAIRS, sizes, 0))
    rows = np.flatnonzero(np.repeat(sizes <= PAIRS, sizes))
    for k in range(1, int(sizes[sizes <= PAIRS].max(initial=0))):
        same = np.flatnonzero(which[k:] == which[:-k])
        i, j = rows[same], rows[same + k]
        ok = near(fp[i], fp[j], radius)
        out.append((rep[i[ok]], rep[j[ok]]))
    for g in np.flatnonzero(sizes > PAIRS).tolist():
        out += tree_links(fp[cuts[g] : cuts[g + 1]], rep[cuts[g] : cuts[g + 1]], radius)
    return tuple(np.concatenate([np.zeros(0, np.int64), *(x[s] for x in out)]) for s in (0, 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _divided(keys: DataFrame, radius: int, most: int) -> DataFrame:
    """keys (fp, rep, key, free) with the groups of more than `most` rows divided. free holds the bits that a group may
    differ in: they are dealt into radius + 1 parts, a pair within the radius agrees in one of them as a whole, and a
    row goes to one group for each part, with fewer bits free. Ends when groups are small or have few bits left, in
    which case they hold few fingerprints, as these are distinct."""
    out = None
    while True:
        crowded = saved(keys.groupBy("key").agg(F.count("*").alias("size"), F.first("free").alias("bits")).where((F.col("size") > most) & (F.bit_count("bits") > radius)).select("key"))
        if crowded.isEmpty():
            return keys if out is None else out.unionByName(keys)
        calm, hot = matched(keys, crowded, ["key"], "left_anti"), matched(keys, crowded, ["key"])
        out = calm if out is None else out.unionByName(calm)

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fp, rep, key, free = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
                parts: list[list[np.ndarray]] = []
                for bits in np.unique(free).tolist():
                    at = np.flatnonzero(free == bits)
                    varying = [b for b in range(BITS) if (bits >> b) & 1]
                    for k in range(radius + 1):
                        kept = _signed(sum(1 << b for b in varying[k :: radius + 1]))
                        value = (fp[at] & np.int64(kept)).view(np.uint64)
                        mixed_key = np.array([xxhash.xxh3_64_intdigest(v.tobytes(), seed=(int(g) + k) % (1 << 64)) for v, g in zip(value, key[at])], np.uint64).view(np.int64)
                        parts.append([fp[at], rep[at], mixed_key, np.full(len(at), _signed(bits & ~kept & ((1 << 64) - 1)), np.int64)])
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], ["fp", "rep", "key", "free"])

        keys = saved(hot.mapInArrow(dealt, "fp long, rep long, key long, free long"))


def links(fps: DataFrame, radius: int = RADIUS, crowd: int | None = None) -> DataFrame:
    """(a, b) over the reps of distinct rows (fp, rep) that spans all components under the radius."""
    kept = masks(allocation(*bit_statistics(fps.select("fp")), radius))
    every = (1 << 64) - 1
    wide = F.array(*(F.struct(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long"))).alias("key"), F.lit(_signed(every & ~m)).cast("long").alias("free")) for k, m in enumerate(kept)))
    keys = fps.select("fp", "rep", F.explode(wide).alias("x")).select("fp", "rep", "x.key", "x.free")
    keys = _divided(keys, radius, crowd or CROWD).select("fp", "rep", "key").repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def linked(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            fp, rep, key = (np.concatenate(x) for x in zip(*parts))
            cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            a, b = group_links(fp.view(np.uint64), rep, cuts, radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            key = now[-1]
            last = np.flatnonzero(key != key[-1])
            cut = int(last[-1]) + 1 if len(last) else 0
            if held and (cut or held[-1][-1][-1] != key[0]):
                yield from linked([*held, [x[:cut] for x in now]])
                held = []
            elif cut:
                yield from linked([[x[:cut] for x in now]])
            held.append([x[cut:] for x in now])
        if held:
            yield from linked(held)

    return keys.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs: component_id is the smallest doc_id of its component.

    Fingerprints link at `radius` differing bits or fewer. Texts without a word, null ones too, have fingerprint zero
    and link like any other; repeated rows share their component; a row without a doc_id links like any other but gives
    no name, so a component of such rows alone has a null component_id; columns beyond doc_id and text play no part; an
    empty table gives an empty result.
    """
    own = saved(fingerprints(docs, shingle))
    fps = saved(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = connected_components(links(fps.select("fp", F.col("fp").alias("rep")), radius))
    whole = saved(fps.join(found, fps.fp == found.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component")))
    names = whole.groupBy("component").agg(F.min("first").alias("component_id"))
    whole = matched(whole, names, ["component"]).select("fp", "component_id")
    return matched(own, whole, ["fp"], "left").select("doc_id", "fp", "component_id")
