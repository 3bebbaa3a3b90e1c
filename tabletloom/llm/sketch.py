"""Vectorised sketches of character trigram sets and the shuffle of packed sketch entries.

Everything here works on flat code-point arrays of a whole Arrow batch; no call is made per row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletloom.operators.flat import flat, jaccard_of_pairs, mix, products, trigrams, unique_pairs
from tabletloom.session import cut, shuffle_partitions

#: One entry of the packed shuffle: its key, the class of the text, 192 sketch bits, flags, filled sketch bins.
#: Where keys are hashes, 32 bits of them tell those of one part apart (``NARROW``); a collision costs comparisons only.
ENTRY = np.dtype([("key", "<u8"), ("id", "<u8"), ("s0", "<u8"), ("s1", "<u8"), ("s2", "<u8"), ("flag", "u1"), ("filled", "u1")])
NARROW = np.dtype([("key", "<u4"), *((n, ENTRY[n]) for n in ENTRY.names[1:])])
SKETCH_BITS = 192
#: By the smaller number of filled bins of two texts, the bits in which they may differ. At Jaccard 0.7 they differ in 28.8
#: bits, with a deviation of the root of 22 + 1150 / trigrams (simulated; bins filled by copies spread it); the limit is
#: four deviations above. Texts at 0.25 differ in 72, unrelated ones (0.1) in 86.
SKETCH_LIMITS = np.ceil(28.8 + 4 * np.sqrt(22 + 1150 / np.maximum(np.arange(SKETCH_BITS + 1), 1))).astype(np.uint8)
#: Runs of one key beyond this length are cut into blocks that are compared as tasks of their own.
BLOCK = 16_384
#: Bytes of entries that one task sorts and compares.
PART_BYTES = 16 << 20
#: Texts of the sample in which hot keys are looked for at most, and the entries a cell of a hot key should hold. Both say
#: how work is spread, never what is found.
HOT_SAMPLE, CELL = 20_000, 500_000


@cache
def _dropped() -> np.ndarray:
    """Of each code point, whether the key leaves it out: white space and ``!``, ``?``, ``.``."""
    return np.array([chr(c) in "!?." or chr(c).isspace() for c in range(0x110000)])


_LEFT_OUT = re.compile(r"[\s!?.]+")


def alike_key(text: str) -> str:
    """Lower case, without white space and ``!``, ``?``, ``.``."""
    return _LEFT_OUT.sub("", text.lower())


def flat_keys(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all texts, flat; null counts as empty."""
    cp, row = flat([t.lower() if t else "" for t in texts])
    keep = ~_dropped()[cp]
    return cp[keep], row[keep]


def class_ids(cp: np.ndarray, row: np.ndarray, rows: int, side: np.ndarray) -> np.ndarray:
    """A 64-bit id of each row's key and side: the sum of mixed (character, position) pairs, mixed with the length."""
    size = np.bincount(row, minlength=rows)
    place = np.arange(len(cp)) - np.repeat(np.cumsum(size) - size, size)
    h = mix(cp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(np.arange(int(size.max(initial=0)), dtype=np.uint64))[place])
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h, out=total[1:])
    end = np.cumsum(size)
    return mix((total[end] - total[end - size]) ^ mix(size.astype(np.uint64) + side.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


ROWS = "tbl string, row_id long, flag tinyint, side tinyint, text string"


def members(rows: DataFrame) -> DataFrame:
    """(tbl, row_id, flag, side, cls) of the rows whose key has three or more characters; ``rows`` is as in ``ROWS``."""
    names = ["tbl", "row_id", "flag", "side"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                b = whole.slice(at, 4000)
                cp, row = flat_keys(b.column("text").to_pylist())
                cls = class_ids(cp, row, b.num_rows, np.asarray(b.column("side")))
                ok = pa.array(np.bincount(row, minlength=b.num_rows) >= 3)
                yield pa.RecordBatch.from_arrays([*(b.column(c).filter(ok) for c in names), pa.array(cls.view(np.int64)).filter(ok)], names=[*names, "cls"])

    return rows.mapInArrow(run, "tbl string, row_id long, flag tinyint, side tinyint, cls long")


def bin_minima(h: np.ndarray, row: np.ndarray, rows: int, bins: int) -> np.ndarray:
    """One-permutation hashing: the least hash of each row in each bin, the largest value where a bin is empty."""
    out = np.full(rows * bins, np.iinfo(np.uint64).max, np.uint64)
    at = row * bins + (((h & np.uint64(0xFFFF)) * np.uint64(bins)) >> np.uint64(16)).astype(np.int64)
    np.minimum.at(out, at, h >> np.uint64(16))
    return out.reshape(rows, bins)


def densify(m: np.ndarray) -> np.ndarray:
    """Fill empty bins with the next filled bin to the right (cyclically) and its distance, so that two sets still
    agree in a bin with the probability of their Jaccard similarity. Rows without any element stay empty."""
    rows, bins = m.shape
    empty = m == np.iinfo(np.uint64).max
    two = np.concatenate([m, m], axis=1)
    at = np.where(np.concatenate([empty, empty], axis=1), np.int16(2 * bins), np.arange(2 * bins, dtype=np.int16))
    nxt = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :bins].astype(np.int64)
    found = nxt < 2 * bins
    value = np.take_along_axis(two, np.minimum(nxt, 2 * bins - 1), axis=1)
    step = (nxt - np.arange(bins)).astype(np.uint64)
    return np.where(found, value + step * np.uint64(0x9E3779B97F4A7C15), np.uint64(0))


def sketch_bits(code_hash: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """rows x 3 words: one bit of the least hash of each of 192 bins, empty bins filled, so that the bits of two texts
    differ on average with half the probability of their Jaccard distance; and how many bins of each row were not empty."""
    # other bits of the hash than those that keys are taken by
    m = bin_minima((code_hash >> np.uint64(24)) | (code_hash << np.uint64(40)), row, rows, SKETCH_BITS)
    filled = (m != np.iinfo(np.uint64).max).sum(axis=1).astype(np.uint8)
    return np.packbits((mix(densify(m)) & np.uint64(1)).astype(np.uint8), axis=1).view("<u8"), filled


PART_SCHEMA = pa.schema([("part", pa.int32()), ("blob", pa.binary())])


def part_count(spark: SparkSession, entries: int) -> int:
    """Parts for so many entries: of ``PART_BYTES`` each, as many as the session's shuffles at least."""
    return max(shuffle_partitions(spark), -(-entries * ENTRY.itemsize // PART_BYTES))


def hot_keys(rows: DataFrame, texts: int, keys_of: Callable[[list[str], int], np.ndarray]) -> dict[int, int]:
    """{key: side of its grid} of keys that would have over ``CELL`` entries, as counted in a sample of at most about
    ``HOT_SAMPLE`` of the texts; ``keys_of`` gives the keys of a list of texts. Where there are no more texts than
    ``CELL``, no key can have more."""
    if texts <= CELL:
        return {}
    rate = min(1.0, HOT_SAMPLE / texts)
    chosen = rows.where(F.pmod(F.xxhash64("tbl", "row_id", "side"), F.lit(1_000_003)) < F.lit(int(1_000_003 * rate) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = np.asarray(b.column("side"))
            for side in np.unique(sides):
                texts = b.column("text").filter(pa.array(sides == side)).to_pylist()
                k, n = np.unique(keys_of(texts, int(side)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names=["k", "n"])

    # every key that passes stands for CELL of the texts, so there are few
    found = chosen.select("text", "side").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") > CELL * rate).collect()
    return {r["k"] & (2**64 - 1): int(r["n"] / rate) // CELL + 1 for r in found}


class Parts:
    """Collects entries by part and gives them as (part, blob) batches; few rows carry many entries.

    The entries of a hot key are spread over the cells of a grid before they are shuffled: one of column j goes to
    the cells (i, j) and (j, i) of all i, so that any two meet in a cell and no cell holds all. ``cross``: the grid is
    training entries by others, and each goes to the cells of its row or of its column only.
    """

    def __init__(self, parts: int, hot: dict[int, int] | None = None, cross: bool = False, entry: np.dtype = ENTRY, limit: int = 48 << 20) -> None:
        self.parts, self.limit, self.held, self.size, self.cross, self.entry = parts, limit, [], 0, cross, entry
        self.hot = np.array(sorted(hot or {}), np.uint64)
        self.side = np.array([hot[int(k)] for k in self.hot], np.int64) if hot else np.empty(0, np.int64)

    def add(self, key: np.ndarray, ids: np.ndarray, bits: np.ndarray, filled: np.ndarray, flag: np.ndarray) -> Iterator[pa.RecordBatch]:
        e = np.empty(len(key), self.entry)
        short = np.uint64(0 if self.entry["key"].itemsize == 8 else 32)
        e["key"], e["id"], e["filled"], e["flag"] = key >> short, ids, filled, flag
        e["s0"], e["s1"], e["s2"] = bits.T
        place = mix(key ^ np.uint64(0xA0761D6478BD642F))
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, key), len(self.hot) - 1)
            found = np.flatnonzero(self.hot[at] == key)
            many = self.side[at[found]]
            rep = np.repeat(found, many)
            other = np.arange(len(rep)) - np.repeat(np.cumsum(many) - many, many)
            own = (mix(e["id"][rep].copy()) % np.repeat(many, many).astype(np.uint64)).astype(np.int64)
            train = (e["flag"][rep] & 1) > 0
            i, j = (np.where(train, own, other), np.where(train, other, own)) if self.cross else (np.minimum(own, other), np.maximum(own, other))
            cells = mix(place[rep] + mix((i * 65_537 + j).astype(np.uint64)))
            usual = np.ones(len(e), bool)
            usual[found] = False
            spread = e[rep]
            spread["key"] = cells >> short
            e, place = np.concatenate([e[usual], spread]), np.concatenate([place[usual], cells])
        self.held.append(((place % np.uint64(self.parts)).astype(np.int32), e))
        self.size += e.nbytes
        if self.size > self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        part = np.concatenate([p for p, _ in self.held])
        e = np.concatenate([x for _, x in self.held])
        self.held, self.size = [], 0
        order = np.argsort(part, kind="stable")
        part, e = part[order], e[order]
        names, start = np.unique(part, return_index=True)
        blobs = [x.tobytes() for x in np.split(e, start[1:])]
        for i in range(0, len(names), 64):
            yield pa.RecordBatch.from_arrays([pa.array(names[i : i + 64], pa.int32()), pa.array(blobs[i : i + 64], pa.binary())], schema=PART_SCHEMA)


class Entries:
    """Entries as columns."""

    def __init__(self, e: np.ndarray) -> None:
        self.id, self.flag, self.filled = e["id"].astype(np.int64), e["flag"].copy(), e["filled"].copy()
        self.words = [e[w].copy() for w in ("s0", "s1", "s2")]


def near(a: Entries, i: np.ndarray, b: Entries, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ids whose sketches differ in at most as many bits as ``SKETCH_LIMITS`` allows; most others are gone
    after two words."""
    d = np.bitwise_count(a.words[0][i] ^ b.words[0][j]) + np.bitwise_count(a.words[1][i] ^ b.words[1][j])
    limit = SKETCH_LIMITS[np.minimum(a.filled[i], b.filled[j])]
    ok = d <= limit
    i, j, d, limit = i[ok], j[ok], d[ok], limit[ok]
    ok = d + np.bitwise_count(a.words[2][i] ^ b.words[2][j]) <= limit
    x, y = a.id[i[ok]], b.id[j[ok]]
    ok = x != y
    return np.minimum(x, y)[ok], np.maximum(x, y)[ok]


def dense_near(a: Entries, i: np.ndarray, b: Entries, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Like ``near``, of each of ``i`` with each of ``j``: as matrices, some rows at a time."""
    if not len(i) or not len(j):
        return
    most = SKETCH_LIMITS[min(int(a.filled[i].min()), int(b.filled[j].min()))]
    right = [w[j] for w in b.words]
    step = max(1, (1 << 18) // len(j))
    for at in range(0, len(i), step):
        k = i[at : at + step]
        d = np.bitwise_count(a.words[0][k, None] ^ right[0][None])
        for n in (1, 2):
            d += np.bitwise_count(a.words[n][k, None] ^ right[n][None])
        x, y = np.nonzero(d <= most)
        if len(x):
            yield near(a, k[x], b, j[y])


#: Comparisons from which on a run is compared as a matrix; those of smaller runs are listed together.
DENSE = 4_096


def run_pairs(e: Entries, start: np.ndarray, size: np.ndarray, cross: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs within each run of entries: all of them, or with ``cross`` those of flag 2 with those of flag 1."""
    group = np.repeat(np.arange(len(start)), size)
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(len(group))
    train, other = ((e.flag[at] & f) > 0 for f in (1, 2)) if cross else (np.ones(len(at), bool),) * 2
    trains, others = at[train], at[other]
    n, m = (np.bincount(group[x], minlength=len(start)) for x in (train, other))
    first, begin = np.cumsum(n) - n, np.cumsum(m) - m
    dense = n * m >= DENSE
    for k in np.flatnonzero(dense).tolist():
        yield from dense_near(e, others[begin[k] : begin[k] + m[k]], e, trains[first[k] : first[k] + n[k]])
    few = ~dense[group] & other
    if cross:
        for i, j in products(at[few], first[group[few]], n[group[few]]):
            yield near(e, i, e, trains[j])
    else:
        for i, j in products(at[few], at[few] + 1, (start + size)[group[few]] - at[few] - 1):
            yield near(e, i, e, j)


def blocks(run: np.ndarray, cross: bool) -> Iterator[tuple[bytes, bytes]]:
    """The pairs of blocks of a long run; with ``cross`` those of training entries with those of others."""
    cuts = lambda e: [e[i : i + BLOCK].tobytes() for i in range(0, len(e), BLOCK)]
    if cross:
        other = cuts(run[(run["flag"] & 2) > 0])
        return ((x, y) for x in cuts(run[(run["flag"] & 1) > 0]) for y in other)
    every = cuts(run)
    return ((x, y) for i, x in enumerate(every) for y in every[i:])


def block_pairs(a: Entries, b: Entries) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    yield from dense_near(a, np.arange(len(a.id)), b, np.arange(len(b.id)))


JOB_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("left", pa.binary()), ("right", pa.binary())])
PAIR_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def compare_parts(entries: DataFrame, parts: int, cross: bool, entry: np.dtype = ENTRY) -> DataFrame:
    """Candidate pairs (a, b) of class ids that share a key and whose sketches differ in few bits (``near``).

    ``entries`` has rows (part, blob). Each part is sorted by key; runs of more than ``BLOCK`` entries are cut into
    blocks whose comparisons are spread over all tasks. Keys beyond ``CELL`` entries come in cells (``Parts``).
    """

    def sort_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blobs = [], []
        for b in batches:
            part += b.column("part").to_pylist()
            blobs += b.column("blob").to_pylist()
        found, held = [], 0
        for one in sorted(set(part)):
            e = np.frombuffer(b"".join(x for p, x in zip(part, blobs, strict=True) if p == one), entry)
            e = e[np.lexsort((e["id"], e["key"]))]
            first = np.ones(len(e), bool)
            first[1:] = (e["key"][1:] != e["key"][:-1]) | (e["id"][1:] != e["id"][:-1])
            at = np.flatnonzero(first)
            flag = np.bitwise_or.reduceat(e["flag"], at) if len(at) else e["flag"]
            e = e[at].copy()
            e["flag"] = flag
            start = np.flatnonzero(np.r_[True, e["key"][1:] != e["key"][:-1]]) if len(e) else np.empty(0, np.int64)
            size = np.diff(np.r_[start, len(e)])
            usual = (size > 1) & (size <= BLOCK)
            for x in run_pairs(Entries(e), start[usual], size[usual], cross):
                found.append(x)
                held += len(x[0])
                if held > 1 << 21:
                    found = [unique_pairs(found)]
                    held = len(found[0][0])
            for s, n in zip(start[size > BLOCK], size[size > BLOCK], strict=True):
                for x, y in blocks(e[s : s + n], cross):
                    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([x], pa.binary()), pa.array([y], pa.binary())], schema=JOB_SCHEMA)
        a, b = unique_pairs(found)
        for i in range(0, len(a), 1 << 16):
            n = len(a[i : i + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array(a[i : i + n]), pa.array(b[i : i + n]), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], schema=JOB_SCHEMA)

    def run_jobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            ok = pa.compute.is_valid(a)
            found = [(np.asarray(a.filter(ok), np.int64), np.asarray(b.filter(ok), np.int64))]
            for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
                if left is not None:
                    found += list(block_pairs(Entries(np.frombuffer(left, entry)), Entries(np.frombuffer(right, entry))))
            x, y = unique_pairs(found)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], schema=PAIR_SCHEMA)

    jobs = entries.repartitionById(parts, "part").mapInArrow(sort_part, "a long, b long, left binary, right binary")
    return jobs.repartition(parts).mapInArrow(run_jobs, "a long, b long").distinct()


#: Ids of needed rows are broadcast up to this many (16 bytes each and the table's name), beyond it they are shuffled.
BROADCAST_ROWS = 1_000_000


def verify(pairs: DataFrame, rows: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """The candidate pairs of classes whose trigram Jaccard similarity reaches ``threshold``, with the similarity.

    ``known`` has the members of ``rows``. Only the texts of one row for each class in a pair are moved.
    """
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("cls"))
    needed = ends.select("cls").distinct().join(known, "cls").groupBy("cls").agg(F.min(F.struct("tbl", "row_id", "side")).alias("r")).select("cls", "r.*")
    needed = cut(needed)
    if needed.count() <= BROADCAST_ROWS:
        needed = F.broadcast(needed)
    texts = rows.select("tbl", "row_id", "side", "text").join(needed, ["tbl", "row_id", "side"]).dropDuplicates(["cls"]).select("cls", "text")
    side = lambda x: F.min(F.when(F.col("cls") == F.col(x), F.col("text"))).alias(f"t{x}")
    both = ends.join(texts, "cls").groupBy("a", "b").agg(side("a"), side("b"))
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("jaccard", pa.float64())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                j = jaccard_of_pairs(*(list(map(alike_key, part.column(c).to_pylist())) for c in ("ta", "tb")))
                ok = pa.array(j >= threshold)
                yield pa.RecordBatch.from_arrays([part.column("a").filter(ok), part.column("b").filter(ok), pa.array(j).filter(ok)], schema=out)

    return both.mapInArrow(check, "a long, b long, jaccard double")
