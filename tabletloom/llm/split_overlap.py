"""Problem 6: records of evaluation splits that reappear in the training split, found by a suffix array.

The texts of all splits, without white space and ``!?.`` and in lower case, are one long concatenation. Of its suffixes a
sample is kept that is the same wherever the same characters stand: in each of 12 classes of trigrams, those that begin with
the text's least trigram of the class (by a hash). They are bucketed by their first 10 characters and sorted in each bucket
by these (as packed codes), so suffixes with a common prefix of 10 or more characters are adjacent: a run of the array.
Cross-split neighbours in a run whose sketches allow it are candidates, and are compared exactly. Very short texts have
pairs of least trigrams as keys as well.

Coverage takes all suffixes: those of training texts and of others with a common prefix of ``SPAN`` characters are adjacent
in the array, and the spans that a record shares with any training record are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletloom.llm import sketch as S
from tabletloom.session import cut, shuffle_partitions

#: Characters of the common prefix, and sampled suffixes of a text. Pairs at Jaccard 0.7 to 0.76 with random edits miss each
#: other with a probability of about 0.2 % from 60 characters on (simulated). Larger collections may ask for a longer one.
PREFIX, SAMPLED = 10, 12
#: Texts with so many trigrams or fewer have pair keys besides; two alike texts of which one has 40 or fewer both have them.
SHORT = 57
#: Length from which on a shared span counts for coverage.
SPAN = 24
_BASE = 0x9E3779B97F4A7C15
_NONE = np.iinfo(np.uint64).max


def prefix_hashes(cp: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` characters from each position on, from prefix sums modulo 2**64."""
    n = len(cp)
    if n < length:
        return np.empty(0, np.uint64)
    power, inverse = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, pow(_BASE, -1, 2**64), np.uint64)
    power[0] = inverse[0] = 1
    power, inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(cp.astype(np.uint64) * power[:n], out=total[1:])
    return S.mix((total[length:] - total[:-length]) * inverse[: n - length + 1])


def packed_prefixes(cp: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The first ``PREFIX`` = 10 characters of each suffix as 6-bit codes in one number, so that numbers sort as the suffixes do (by
    code); what lies beyond the text's end is 0."""
    c = cp.astype(np.uint64)
    code = c & np.uint64(63)
    wide = np.flatnonzero(cp >= 128)
    code[wide] = np.uint64(1) + S.mix(c[wide]) % np.uint64(63)
    size = np.bincount(row)
    end = np.cumsum(size[size > 0])

    def twice(x: np.ndarray, y: np.ndarray, bits: int, ahead: int) -> np.ndarray:
        out = x << np.uint64(bits)
        out[:-ahead] |= y[ahead:] if len(x) > ahead else y[:0]
        return out

    two = twice(code, code, 6, 1)
    out = twice(twice(twice(two, two, 12, 2), twice(two, two, 12, 2), 24, 4), two, 12, 8)
    for left in range(1, PREFIX):  # what was taken from behind a text's end goes
        at = end - left
        at = at[at >= np.r_[0, end[:-1]]]
        out[at] &= np.uint64(2**60 - 1) ^ np.uint64(2 ** (6 * (PREFIX - left)) - 1)
    return out


def sampled_suffixes(cp: np.ndarray, row: np.ndarray, rows: int, hashed: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(packed prefix, row) of the sampled suffixes, each prefix once a row; among suffixes that begin with the same trigram
    the least by a hash of the prefix, wherever it stands. ``hashed``: the hashes and rows of all trigrams, if known."""
    if len(cp) < 3:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    prefix = packed_prefixes(cp, row)[:-2]
    prefix = prefix[row[:-2] == row[2:]]
    if hashed is None:
        code, r = S.trigrams(cp, row)
        hashed = S.mix(code), r
    h, r = hashed
    at = r * SAMPLED + (((h & np.uint64(0xFFFF)) * np.uint64(SAMPLED)) >> np.uint64(16)).astype(np.int64)
    order = (h & np.uint64(0xFFFFFFFF00000000)) | ((prefix * np.uint64(_BASE)) >> np.uint64(32))
    least = np.full(rows * SAMPLED, _NONE, np.uint64)
    np.minimum.at(least, at, order)
    k = np.flatnonzero(order == least[at])
    _, first = np.unique(at[k], return_index=True)  # a repeated prefix counts once
    k = k[first]
    return prefix[k], r[k]


def pair_keys(code: np.ndarray, row: np.ndarray, rows: int, agree: int = 2, blocks: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of least trigram hashes, for texts of at most ``SHORT`` trigrams. Texts at Jaccard 0.7 share none of the 12
    with a probability of 0.03 %, however the edits are spread."""
    short = np.bincount(row, minlength=rows) <= SHORT
    keep = short[row]
    if not keep.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    number = np.flatnonzero(short)
    code, row = code[keep], (np.cumsum(short) - 1)[row[keep]]
    m = S.densify(S.bin_minima(S.mix(code ^ np.uint64(0xD6E8FEB86659FD93)), row, len(number), agree * blocks)).reshape(len(number), blocks, agree)
    key = S.mix(m[:, :, 0] * np.uint64(3) + S.mix(m[:, :, 1].copy()) + np.arange(1, blocks + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    return key.ravel(), np.repeat(number, blocks)


def suffix_keys(cp: np.ndarray, row: np.ndarray, rows: int, side: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, their rows, trigram hashes, their rows); the last bits of a key are the side, whose texts are arrays of their own."""
    code, trow = S.trigrams(cp, row)
    h = S.mix(code)
    k1, r1 = sampled_suffixes(cp, row, rows, (h, trow))
    k2, r2 = pair_keys(code, trow, rows)
    r = np.concatenate([r1, r2])
    return (np.concatenate([k1, k2]) << np.uint64(4)) | side[r], r, h, trow


def side_rows(df: DataFrame, sides: tuple[str, ...], train: str = "train", id_column: str = "row_id") -> DataFrame:
    """One row per text as in ``sketch.ROWS``: flag 1 for the training split, 2 for others; rows of a null split none."""
    flag = F.when(F.col("split") == train, 1).otherwise(2).cast("tinyint")
    out = None
    for i, side in enumerate(sides):
        one = df.where("split is not null").select(F.lit("").alias("tbl"), F.col(id_column).cast("long").alias("row_id"), flag.alias("flag"), F.lit(i).cast("tinyint").alias("side"), F.col(side).cast("string").alias("text"))
        out = one if out is None else out.unionByName(one)
    return out.where("text is not null and row_id is not null")


def overlapping_classes(rows: DataFrame, known: DataFrame, texts: int, threshold: float = 0.7) -> DataFrame:
    """Pairs (a, b, jaccard) of classes of equal keys of one side, of which one has a training and one another record."""
    parts = S.part_count(rows.sparkSession, texts * SAMPLED)
    hot = S.hot_keys(rows, texts, lambda t, side: suffix_keys(*S.flat_keys(t), len(t), np.full(len(t), side, np.uint64))[0])

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = S.Parts(parts, hot, cross=True)
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                batch = whole.slice(at, 4000)
                n = batch.num_rows
                cp, row = S.flat_keys(batch.column("text").to_pylist())
                size = np.bincount(row, minlength=n)
                flag, side = np.asarray(batch.column("flag")).astype(np.uint8), np.asarray(batch.column("side")).astype(np.uint64)
                ids = S.class_ids(cp, row, n, side)
                _, first = np.unique(ids ^ (flag.astype(np.uint64) << np.uint64(62)), return_index=True)
                new = np.zeros(n, bool)
                new[first] = True
                new &= size >= 3
                keep = new[row]
                cp, row = cp[keep], (np.cumsum(new) - 1)[row[keep]]
                ids, flag, side = ids[new], flag[new], side[new]
                if not len(ids):
                    continue
                key, r, h, trow = suffix_keys(cp, row, len(ids), side)
                bits, filled = S.sketch_bits(h, trow, len(ids))
                yield from out.add(key, ids[r], bits[r], filled[r], flag[r])
        yield from out.flush()

    entries = rows.select("text", "flag", "side").mapInArrow(suffixes, "part int, blob binary")
    return S.verify(cut(S.compare_parts(entries, parts, cross=True)), rows, known, threshold)


def overlaps(df: DataFrame, sides: tuple[str, ...] = ("transliteration", "translation"), threshold: float = 0.7, id_column: str = "row_id") -> DataFrame:
    """(side, train_id, other_id, jaccard): every training record and record of another split whose texts are alike.

    Null texts, and texts of fewer than three characters without white space and ``!?.``, overlap with nothing; so do
    rows of a null split or id. Empty input gives an empty result; extra columns are ignored.
    """
    rows = side_rows(df, sides, id_column=id_column)
    members = cut(S.members(rows))
    found = cut(overlapping_classes(rows, members, len(sides) * df.count(), threshold))
    both = found.union(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "jaccard"))
    same = members.groupBy("cls").agg(F.bit_or("flag").alias("f")).where("f = 3").select(F.col("cls").alias("a"), F.col("cls").alias("b"), F.lit(1.0).alias("jaccard"))
    t = members.where("flag = 1").select(F.col("cls").alias("a"), F.col("row_id").alias("train_id"), "side")
    o = members.where("flag = 2").select(F.col("cls").alias("b"), F.col("row_id").alias("other_id"))
    return both.union(same).join(t, "a").join(o, "b").select(F.element_at(F.array(*map(F.lit, sides)), F.col("side") + 1).alias("side"), "train_id", "other_id", "jaccard")


def overlap_counts(df: DataFrame, sides: tuple[str, ...] = ("transliteration", "translation"), threshold: float = 0.7, id_column: str = "row_id") -> DataFrame:
    """(split, source, side, records, overlapping, identical): per split other than train, source and side, how many
    records there are, how many are alike to a training record, and how many are equal to one but for white space, case
    and ``!?.``. Null sources count as one source."""
    found = overlaps(df, sides, threshold, id_column).groupBy("side", "other_id").agg(F.max("jaccard").alias("j"))
    rows = df.where((F.col("split") != "train") & F.col("split").isNotNull()).select(F.col(id_column).cast("long").alias("other_id"), "split", "source", F.explode(F.array(*map(F.lit, sides))).alias("side"))
    return rows.join(found, ["side", "other_id"], "left").groupBy("split", "source", "side").agg(F.count("*").alias("records"), F.count("j").alias("overlapping"), F.count(F.when(F.col("j") == 1.0, 1)).alias("identical"))


SUFFIX_SCHEMA = pa.schema([("bucket", pa.int32()), ("h", pa.binary()), ("cls", pa.binary()), ("pos", pa.binary())])


def covered_spans(rows: DataFrame, texts: int, span: int) -> DataFrame:
    """(cls, pos): the positions of texts outside train at which ``span`` characters begin that a training text of the same
    side has. All suffixes are sorted in buckets of their prefixes; neighbours of the two kinds with the same prefix tell."""
    parts = max(shuffle_partitions(rows.sparkSession), texts // 4000)

    def prefixes(cp: np.ndarray, row: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, prefix) of all suffixes."""
        h = prefix_hashes(cp, span)
        at = np.flatnonzero(row[: len(h)] == row[span - 1 : span - 1 + len(h)])
        return at, S.mix(h[at] + side[row[at]])

    hot = S.hot_keys(rows, texts, lambda t, side: np.unique(prefixes(*S.flat_keys(t), np.full(len(t), side, np.uint64))[1]))
    hot_key = np.array(sorted(hot), np.uint64)
    width = np.array([hot[int(k)] for k in hot_key], np.int64)

    def salted(key: np.ndarray, salt: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(index, key): keys that very many texts have are cut: training texts go to all salts, others to that given."""
        if not len(hot_key):
            return np.arange(len(key)), key
        i = np.minimum(np.searchsorted(hot_key, key), len(hot_key) - 1)
        many = np.where(hot_key[i] == key, width[i], 1)
        if salt is None:
            at = np.repeat(np.arange(len(key)), many)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        else:
            at, nth = np.arange(len(key)), (salt % many.astype(np.uint64)).astype(np.int64)
        return at, np.where(nth > 0, S.mix(key[at] + nth.astype(np.uint64)), key[at])

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                n = batch.num_rows
                cp, row = S.flat_keys(batch.column("text").to_pylist())
                flag, side = np.asarray(batch.column("flag")), np.asarray(batch.column("side")).astype(np.uint64)
                ids = S.class_ids(cp, row, n, side)
                at_char, h = prefixes(cp, row, side)
                size = np.bincount(row, minlength=n)
                r = row[at_char]
                train = flag[r] == 1
                own = salted(np.unique(h[train]), None)[1]  # where training texts repeat a prefix does not matter
                other = r[~train]
                key = np.concatenate([own, salted(h[~train], ids[other])[1]])
                cls = np.concatenate([np.zeros(len(own), np.uint64), ids[other]])
                pos = np.concatenate([np.full(len(own), -1, np.int32), (at_char[~train] - (np.cumsum(size) - size)[other]).astype(np.int32)])
                bucket = (key % np.uint64(parts)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                names, first = np.unique(bucket[order], return_index=True)
                blobs = ([x.tobytes() for x in np.split(a[order], first[1:])] for a in (key, cls, pos))
                if len(names):
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *(pa.array(b, pa.binary()) for b in blobs)], schema=SUFFIX_SCHEMA)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[bytes]] = [[], [], []]
        for b in batches:
            for k, c in enumerate(("h", "cls", "pos")):
                held[k] += b.column(c).to_pylist()
        h, cls, pos = (np.frombuffer(b"".join(x), t) for x, t in zip(held, (np.uint64, np.int64, np.int32), strict=True))
        order = np.lexsort((pos, h))  # training suffixes come first among equals
        h, cls, pos = h[order], cls[order], pos[order]
        start = np.r_[True, h[1:] != h[:-1]] if len(h) else np.empty(0, bool)
        shared = (pos[start] < 0)[np.cumsum(start) - 1] & (pos >= 0) if len(h) else start
        for at in range(0, int(shared.sum()), 1 << 18):
            k = np.flatnonzero(shared)[at : at + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(cls[k]), pa.array(pos[k])], names=["cls", "pos"])

    entries = rows.select("text", "flag", "side").mapInArrow(suffixes, "bucket int, h binary, cls binary, pos binary")
    return entries.repartitionById(parts, "bucket").mapInArrow(neighbours, "cls long, pos int")


def overlap_coverage(df: DataFrame, sides: tuple[str, ...] = ("transliteration", "translation"), span: int = SPAN, id_column: str = "row_id") -> DataFrame:
    """(side, other_id, n_chars, covered, coverage): of each record outside train with ``span`` or more characters (without
    white space and ``!?.``) in a row that some training record has on that side: its characters, those in such spans, and
    their share. The spans of all training records are merged.

    Null and short texts have no row; repeated rows share their coverage. Empty input gives an empty result.
    """
    rows = side_rows(df, sides, id_column=id_column)
    spans = covered_spans(rows, len(sides) * df.count(), span)
    # a position adds what it reaches beyond the one before, so that overlapping spans count once
    step = F.array_sort(F.collect_set("pos"))
    gap = F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.when(i == 1, F.lit(span)).otherwise(F.least(F.lit(span), F.get("p", i - 1) - F.get("p", i - 2))))
    covered = spans.groupBy("cls").agg(step.alias("p")).select("cls", F.aggregate(gap, F.lit(0), lambda a, x: a + x).cast("long").alias("covered"))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cp, row = S.flat_keys(b.column("text").to_pylist())
            cls = S.class_ids(cp, row, b.num_rows, np.asarray(b.column("side")))
            yield pa.RecordBatch.from_arrays([b.column("row_id"), b.column("side"), pa.array(cls.view(np.int64)), pa.array(np.bincount(row, minlength=b.num_rows))], names=["row_id", "side", "cls", "n_chars"])

    other = rows.where("flag = 2").select("row_id", "side", "text").mapInArrow(sizes, "row_id long, side tinyint, cls long, n_chars long")
    name = F.element_at(F.array(*map(F.lit, sides)), F.col("side") + 1)
    return other.join(covered, "cls").select(name.alias("side"), F.col("row_id").alias("other_id"), "n_chars", "covered", F.round(F.col("covered") / F.col("n_chars"), 6).alias("coverage"))
