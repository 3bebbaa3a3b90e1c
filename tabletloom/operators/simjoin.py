"""Exact similarity join of texts by their sets of character trigrams.

Transliterations are made of few syllables: almost all sets share a trigram even among their rarest, so sets that meet
at rare trigrams (a prefix filter) are more pairs than there are, each found at a cost. Here every pair of sets whose sizes
allow it is compared once, at a few nanoseconds, by parity bitmaps: two bitmaps differ in no more bits than the sets in
elements, and two sets of Jaccard similarity ``t`` in at most ``(1 - t) / (1 + t)`` of their sizes' sum. With bits as +1 and
-1 the numbers of differing bits of all pairs of two blocks are one product of matrices. What is left is compared by a
bitmap of twice the bits, then verified by the whole sets. No pair is lost, and only pairs that pass are ever rows.

The sets are cut into cells by size; a task compares two cells, and cells whose sizes are too far apart never meet. Sets of
two sides meet only those of the other side.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletloom.operators.flat import distinct, flat, jaccard_of_pairs, mix, trigrams
from tabletloom.session import cut

#: Sets of one cell at most, and cells that a small collection is cut into.
BLOCK, CELLS = 65_536, 16
#: Sets of one side that are compared at once, when their bitmaps have 256 bits.
TILE = 2_048
#: Bits that are counted at once.
COUNTED = 1 << 22


def bitmaps(code: np.ndarray, row: np.ndarray, rows: int, width: int) -> np.ndarray:
    """rows x width / 8 bytes: bit k is the parity of the number of elements hashed to k."""
    bit = (mix(code ^ np.uint64(0x9E3779B97F4A7C15)) & np.uint64(width - 1)).astype(np.int64)
    odd = (np.bincount(row * width + bit, minlength=rows * width) & 1).astype(np.uint8).reshape(rows, width)
    return np.packbits(odd, axis=1)


def widths(n: np.ndarray) -> np.ndarray:
    """Bits that are stored of sets of ``n`` elements: twice those of the first comparison, which are about ``n``."""
    return (1 << np.clip(np.ceil(np.log2(np.maximum(n, 1) * 0.95)), 6, 14).astype(np.int64)) * 2


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """The bitmaps with ``width`` bits."""
    while bits.shape[1] * 8 > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return np.ascontiguousarray(bits)


def signs(bits: np.ndarray) -> np.ndarray:
    """Two columns of 1, then the bits as +1 and -1."""
    out = np.ones((len(bits), 2 + bits.shape[1] * 8), np.float32)
    out[:, 2:] -= 2 * np.unpackbits(bits, axis=1).astype(np.float32)
    return out


class _Sets:
    """Sets of one width by size."""

    def __init__(self, blobs: list[tuple[bytes, bytes, bytes]], width: int) -> None:
        n = np.frombuffer(b"".join(x for _, x, _ in blobs), np.int64)
        order = np.argsort(n, kind="stable")
        self.n, self.id = n[order], np.frombuffer(b"".join(x for x, _, _ in blobs), np.int64)[order]
        self.bits = np.frombuffer(b"".join(x for _, _, x in blobs), np.uint8).reshape(-1, width // 8)[order]


def _alike(a: _Sets, b: _Sets, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs whose sizes and bitmaps allow a similarity of ``t``; each pair once if ``a`` is ``b``."""
    most = (1 - t) / (1 + t)
    wide = min(a.bits.shape[1], b.bits.shape[1]) * 8
    wa, wb = (folded(x.bits, wide).view(np.uint64) for x in (a, b))
    fa, fb = (folded(x.bits, wide // 2) for x in (a, b))
    tile = max(32, TILE * 256 // max(wide // 2, 256))
    for at in range(0, len(a.n), tile):
        na = a.n[at : at + tile]
        first = np.searchsorted(b.n, np.ceil(t * na[0] - 1e-6))
        last = np.searchsorted(b.n, np.floor(na[-1] / t + 1e-6), "right")
        x = signs(fa[at : at + tile])
        x[:, 0] = 2 * most * na - wide // 2
        for to in range(max(first, at) if a is b else first, last, tile):
            nb = b.n[to : min(to + tile, last)]
            y = signs(fb[to : to + len(nb)])
            y[:, 1] = 2 * most * nb
            # twice the number of bits by which a pair is within the limit; half a bit for rounding
            k = np.flatnonzero(x @ y.T >= -1)
            i, j = k // len(nb) + at, k % len(nb) + to
            if a is b:
                i, j = i[i < j], j[i < j]
            differ = np.zeros(len(i), np.int64)
            for w in range(wide // 64):
                differ += np.bitwise_count(wa[i, w] ^ wb[j, w])
            p, q = a.n[i], b.n[j]
            ok = (differ <= most * (p + q) + 1e-6) & (p >= t * q - 1e-6) & (q >= t * p - 1e-6)
            yield i[ok], j[ok]


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def sketches(texts: DataFrame) -> DataFrame:
    """(side, n, sid, bits) of the sets that have an element."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            code, row = distinct(*trigrams(*flat(b.column("key").to_pylist())))
            n = np.bincount(row, minlength=b.num_rows)
            width = widths(n)
            end = np.cumsum(n)
            for w in np.unique(width[n > 0]):
                whole = np.flatnonzero((n > 0) & (width == w))
                for rows in np.split(whole, range(COUNTED // w, len(whole), COUNTED // w)):
                    elements = np.concatenate([np.arange(e - m, e) for e, m in zip(end[rows], n[rows], strict=True)])
                    bits = bitmaps(code[elements], np.repeat(np.arange(len(rows)), n[rows]), len(rows), int(w))
                    offsets = pa.py_buffer(np.arange(0, bits.size + 1, w // 8, dtype=np.int32).tobytes())
                    blob = pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(bits.tobytes())])
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([b.column("side").take(at), pa.array(n[rows]), b.column("sid").take(at), blob], names=["side", "n", "sid", "bits"])

    return texts.select("sid", "side", "key").mapInArrow(sketch, "side tinyint, n long, sid long, bits binary")


class _Cells:
    """Cells of nearly equal numbers of sets, by size: sets of size ``n`` are places ``before`` to ``before + count``."""

    def __init__(self, n: np.ndarray, count: np.ndarray, size: int) -> None:
        order = np.argsort(n)
        self.n, self.count, self.size = n[order], count[order], size
        self.before = np.cumsum(self.count) - self.count
        self.cells = -(-int(count.sum()) // size)
        at = np.arange(self.cells) * size
        ends = np.minimum(at + size, int(count.sum())) - 1
        self.least, self.most = (self.n[np.searchsorted(self.before, x, "right") - 1] for x in (at, ends))

    def of(self, n: np.ndarray, sid: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.n, n)
        part = (mix(sid.astype(np.uint64)) >> np.uint64(11)).astype(np.float64) / 2**53
        return (self.before[k] + np.minimum((part * self.count[k]).astype(np.int64), self.count[k] - 1)) // self.size


def candidates(texts: DataFrame, threshold: float, two: bool) -> DataFrame:
    """(a, b), each pair once, of sets that pass all filters; ``texts`` has (sid, side, key)."""
    sets = cut(sketches(texts).dropDuplicates(["side", "sid"]))
    sizes = sets.groupBy("side", "n").count().toArrow()  # one row a size
    side, n, count = (np.asarray(sizes.column(c), np.int64) for c in ("side", "n", "count"))
    size = min(BLOCK, max(1024, -(-int(count.sum()) // CELLS)))
    cells = {s: _Cells(n[side == s], count[side == s], size) for s in (0, 1)}
    left, right = cells[0], cells[1 if two else 0]
    pairs = [
        (i, j)
        for i in range(left.cells)
        for j in range(0 if two else i, right.cells)
        if left.most[i] >= threshold * right.least[j] - 1e-6 and right.most[j] >= threshold * left.least[i] - 1e-6
    ]
    # (task, role) of each cell
    jobs: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for k, (i, j) in enumerate(pairs):
        jobs[0, i].append((k, 0))
        if two or i != j:
            jobs[1 if two else 0, j].append((k, 1))
    same = {k for k, (i, j) in enumerate(pairs) if not two and i == j}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sd, ns, sid = (np.asarray(b.column(c), np.int64) for c in ("side", "n", "sid"))
            width = widths(ns)
            cell = np.zeros(len(ns), np.int64)
            for s in np.unique(sd):
                cell[sd == s] = cells[int(s)].of(ns[sd == s], sid[sd == s])
            order = np.lexsort((width, cell, sd))
            start = np.flatnonzero(np.r_[True, (np.diff(sd[order]) != 0) | (np.diff(cell[order]) != 0) | (np.diff(width[order]) != 0)]) if len(order) else []
            out = []
            for rows in np.split(order, start[1:]) if len(order) else []:
                r = rows[0]
                blobs = sid[rows].tobytes(), ns[rows].tobytes(), b"".join(b.column("bits").take(pa.array(rows)).to_pylist())
                out += [(k, role, int(width[r]), *blobs) for k, role in jobs[int(sd[r]), int(cell[r])]]
            for at in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*out[at : at + 64], strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "role", "w", "ids", "ns", "bits"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[tuple[int, int, int], list[tuple[bytes, bytes, bytes]]] = defaultdict(list)
        for b in batches:
            for k, role, w, *blobs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got[k, role, w].append(tuple(blobs))
        every = {key: _Sets(blobs, key[2]) for key, blobs in got.items()}
        for (k, role, w), x in every.items():
            for (k2, role2, w2), y in every.items():
                if role == 0 and k2 == k and (role2 == 0 and w <= w2 if k in same else role2 == 1):
                    for i, j in _alike(x, y, threshold):
                        a, b = x.id[i], y.id[j]
                        if not two:
                            a, b = np.minimum(a, b), np.maximum(a, b)
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    sent = sets.mapInArrow(send, "part int, role int, w int, ids binary, ns binary, bits binary")
    return sent.repartitionById(max(1, len(pairs)), "part").mapInArrow(meet, "a long, b long")


def join_texts(texts: DataFrame, threshold: float, two: bool) -> DataFrame:
    """(a, b) of texts whose trigram sets have a Jaccard similarity of at least ``threshold``: of side 0 and side 1, or of one
    side, a < b. ``texts`` has (sid, side, key), copies of a key under one sid; it is read several times. Keys without
    trigrams are alike to nothing."""
    c = cut(candidates(texts, threshold, two))

    def one(side: int, name: str) -> DataFrame:
        keys = texts.where(F.col("side") == side).select(F.col("sid").alias(name), F.col("key").alias(f"k{name}"))
        return keys.join(c.select(name).distinct(), name, "left_semi").dropDuplicates([name])

    both = c.join(one(0, "a"), "a").join(one(1 if two else 0, "b"), "b").select("a", "b", "ka", "kb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            ok = pa.array(jaccard_of_pairs(b.column("ka").to_pylist(), b.column("kb").to_pylist()) >= threshold)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], names=["a", "b"])

    return both.mapInArrow(check, "a long, b long")
