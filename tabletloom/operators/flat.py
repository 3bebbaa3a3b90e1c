"""Arrays over whole Arrow batches: code points, hashes, sets of character trigrams, products of ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and the row of each."""
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    return cp, np.repeat(np.arange(len(texts)), n)


def trigrams(cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact 63-bit codes of all trigrams that lie within one row, and their rows."""
    if len(cp) < 3:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    c = cp.astype(np.uint64)
    code = (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]
    ok = row[:-2] == row[2:]
    return code[ok], row[:-2][ok]


_LOW = np.uint64(0xFFFF)


def _packed(code: np.ndarray, row: np.ndarray) -> np.ndarray | None:
    """Row and trigram in one number each, where 16 bits do for every row and character."""
    wide = np.uint64(0x1F << 16 | 0x1F << 37 | 0x1F << 58)  # bits of characters beyond 16
    if len(row) and (int(row[-1]) > 0xFFFF or bool((code & wide).any())):
        return None
    return row.astype(np.uint64) << np.uint64(48) | (code >> np.uint64(42)) << np.uint64(32) | (code >> np.uint64(21) & _LOW) << np.uint64(16) | code & _LOW


def distinct(code: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each trigram once a row, by row and code; ``row`` ascends."""
    key = _packed(code, row)
    if key is not None:  # one sort of numbers
        key.sort()
        key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
        return (key >> np.uint64(32) & _LOW) << np.uint64(42) | (key >> np.uint64(16) & _LOW) << np.uint64(21) | key & _LOW, (key >> np.uint64(48)).astype(np.int64)
    order = np.lexsort((code, row))
    code, row = code[order], row[order]
    first = np.ones(len(code), bool)
    first[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    return code[first], row[first]


def jaccard_of_pairs(left: list[str], right: list[str]) -> np.ndarray:
    """Jaccard similarity of the trigram sets of each pair of keys; 0 where either has none."""
    n = len(left)
    a, ra = distinct(*trigrams(*flat(left)))
    b, rb = distinct(*trigrams(*flat(right)))
    x, y = _packed(a, ra), _packed(b, rb)
    if x is not None and y is not None:
        key = np.sort(np.concatenate([x, y]))
        row = (key[1:][key[1:] == key[:-1]] >> np.uint64(48)).astype(np.int64)
    else:
        code, row = np.concatenate([a, b]), np.concatenate([ra, rb])
        order = np.lexsort((code, row))
        code, row = code[order], row[order]
        row = row[1:][(code[1:] == code[:-1]) & (row[1:] == row[:-1])]
    both = np.bincount(row, minlength=n)
    either = np.bincount(ra, minlength=n) + np.bincount(rb, minlength=n) - both
    return both / np.maximum(either, 1)


def products(left: np.ndarray, first: np.ndarray, count: np.ndarray, size: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each of ``left`` with the ``count`` numbers from ``first`` on, some ``size`` at a time."""
    done = np.cumsum(count)
    at = 0
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + size, "right")))
        n = count[at:to]
        total = int(n.sum())
        if total:
            yield np.repeat(left[at:to], n), np.repeat(first[at:to] - (np.cumsum(n) - n), n) + np.arange(total)
        at = to


def unique_pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of several arrays of pairs."""
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    p = np.empty(sum(len(x) for x, _ in found), [("a", np.int64), ("b", np.int64)])
    p["a"], p["b"] = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
    p = np.unique(p)
    return p["a"], p["b"]
