"""Problem 1: one consistent text for texts that look the same but hold different characters.

The text of an Arrow batch is one array of code points. A lookup table gathers each code point's replacement (its
canonical parts, with look-alike letters, ligatures, full-width forms, kinds of space and hyphen folded, invisible characters
gone); expansion offsets place replacements of several code points; marks are then ordered and composed for all
characters at once. No string call is made per row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that look like the Latin letter beside them.
LOOKALIKES = (
    "АA ВB ЕE КK МM НH ОO РP СC ТT ХX ІI ЈJ ЅS ԚQ ԜW ҮY "
    "аa еe оo рp сc уy хx іi јj ѕs һh ԛq ԝw ԁd ӏl ɡg ɑa "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv "
    "ⅠI ⅤV ⅩX ⅬL ⅭC ⅮD ⅯM ⅰi ⅴv ⅹx ⅼl ⅽc ⅾd ⅿm ℓl "
    "օo ՕO ᎪA ᏴB ᏟC ᎠD ᎬE ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᏚS ᎢT ᏙV ᎳW ᏃZ"
).split()
# Kinds of hyphen that look like '-'.
HYPHENS = (0x2010, 0x2011, 0xFE63, 0x2043)
# Characters without any look (besides those of category Cf and the variation selectors).
INVISIBLE = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)

GONE = 0xFFFFFFFF


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first replacement, number of parts, all parts, combining class, keys of compositions, composites).

    Built by rule from the Unicode data of Python for all code points.
    """
    size = 0x110000
    single = {ord(x[0]): ord(x[1]) for x in LOOKALIKES} | {c: 0x2D for c in HYPHENS}
    count, start, parts = np.ones(size, np.int64), np.empty(size, np.int64), []
    ccc = np.zeros(size, np.uint8)
    keys, made = [], []

    def fold(c: int) -> list[int]:
        ch = chr(c)
        cat = unicodedata.category(ch)
        if cat == "Cf" or c in INVISIBLE or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF:
            return []
        if cat == "Zs":
            return [0x20]
        form = unicodedata.decomposition(ch)
        if form.startswith(("<wide>", "<narrow>")) or form.startswith("<compat>") and (0xFB00 <= c <= 0xFB06 or 0x2160 <= c <= 0x217F or 0x132 <= c <= 0x133 or 0x1C4 <= c <= 0x1CC):
            return [y for x in form.split()[1:] for y in fold(int(x, 16))]
        if form and form[0] != "<" and not 0xAC00 <= c <= 0xD7A3:
            return [y for x in form.split() for y in fold(int(x, 16))]
        return [single.get(c, c)]

    position = 0
    for c in range(size):
        start[c] = position
        if 0xAC00 <= c <= 0xD7A3 or 0x3400 <= c <= 0x9FFF or 0x20000 <= c <= 0xE00FF and c < 0x2F800 or 0xF0000 <= c or 0xD800 <= c < 0xF900:
            parts.append(c)  # no decomposition in these ranges, or one that we leave
        else:
            x = fold(c)
            count[c] = len(x)
            parts += x
            ch = chr(c)
            ccc[c] = unicodedata.combining(ch)
            form = unicodedata.decomposition(ch)
            if form and form[0] != "<" and " " in form and unicodedata.normalize("NFC", ch) == ch:
                a, b = (int(y, 16) for y in form.split())
                keys.append((single.get(a, a) << 21) | b)
                made.append(c)
        position = len(parts)
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    keys, made = np.array(keys, np.int64)[order], np.array(made, np.int64)[order]
    latin = np.r_[True, keys[1:] != keys[:-1]]  # the first of composites that look the same is the Latin one
    return start, count, np.array(parts, np.uint32), ccc, keys[latin], made[latin]


def consistent(cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The consistent code points of flat texts, and the row of each."""
    start, count, parts, ccc, keys, made = tables()
    n = count[cp]
    total = int(n.sum())
    begin = np.cumsum(n) - n
    out = parts[np.repeat(start[cp] - begin, n) + np.arange(total)]
    row = np.repeat(row, n)
    if not total:
        return out, row
    cls = ccc[out]
    mark = cls > 0
    if not mark.any():
        return out, row
    # a group is a starter with its marks, or marks at a row's start, which have nothing to stand on
    opens = ~mark | np.r_[True, row[1:] != row[:-1]]
    base = np.cumsum(opens) - 1
    order = np.lexsort((np.where(mark, cls, 0), base))
    out, row, cls = out[order], row[order], cls[order]
    at = np.flatnonzero(opens)
    nth = np.arange(total) - at[base]  # 0 for starters, k for their k-th mark
    letter = out[at].astype(np.int64)
    kept_class = np.zeros(len(at), np.uint8)
    alive = np.ones(total, bool)
    for k in range(1, int(nth.max()) + 1):
        m = np.flatnonzero(nth == k)
        b = base[m]
        key = (letter[b] << 21) | out[m]
        i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        fits = (keys[i] == key) & (kept_class[b] < cls[m])
        letter[b[fits]] = made[i[fits]]
        alive[m[fits]] = False
        kept_class[b[~fits]] = cls[m[~fits]]
    out = out.copy()
    out[at] = letter
    return out[alive], row[alive]


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, how many each has), from the array's buffers; null counts as empty."""
    filled = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1] if len(filled) else np.zeros(1, np.int64)
    data = filled.buffers()[2]
    utf8 = memoryview(data)[offsets[0] : offsets[-1]] if data is not None else b""
    # a code point begins at every byte that continues none
    begins = np.r_[0, np.cumsum((np.frombuffer(utf8, np.uint8) & 0xC0) != 0x80)] if len(utf8) else np.zeros(1, np.int64)
    return np.frombuffer(str(utf8, "utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32), np.diff(begins[offsets - offsets[0]])


def consistent_arrow(texts: pa.Array) -> pa.Array:
    """The consistent text of each; null stays null, the empty text empty."""
    values, n = code_points(texts)
    cp, row = consistent(values, np.repeat(np.arange(len(n)), n))
    utf8 = cp.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    size = np.bincount(row, weights=width, minlength=len(n)).astype(np.int64)
    offsets = np.r_[0, np.cumsum(size)].astype(np.int64)
    out = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(offsets), pa.py_buffer(utf8))
    return pa.compute.if_else(texts.is_null(), pa.scalar(None, pa.large_string()), out).cast(pa.string())


def with_consistent(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with the consistent text of ``column`` as ``out`` (an existing column of that name is replaced).

    Null gives null and the empty text the empty text; equal texts give equal results whatever their row.
    """
    plain = df.drop(out) if out != column and out in df.columns else df
    names = [c for c in plain.columns if c != out]
    schema = ", ".join([*(f"`{c}` {plain.schema[c].dataType.simpleString()}" for c in names), f"`{out}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 5000):
                b = batch.slice(at, 5000)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), consistent_arrow(b.column(column).cast(pa.string()))], names=[*names, out])

    return plain.mapInArrow(run, schema)


def same_look_pairs(tables_: dict[str, tuple[DataFrame, str]], id_column: str = "row_id") -> DataFrame:
    """(tbl, row_id_a, row_id_b): rows of a table whose texts look the same but are not the same string.

    ``tables_`` maps a name to a table and its text column. Texts travel as 128-bit hashes only. Null texts look like
    nothing; texts that are empty or invisible throughout look the same as one another.
    """
    out = None
    for name, (df, column) in tables_.items():
        one = with_consistent(df.select(F.col(id_column).cast("long").alias("row_id"), F.col(column).alias("text")), "text", "look")
        digest = lambda c: F.struct(F.xxhash64(c), F.xxhash64(F.lit("second"), c))
        rows = one.where("text is not null").select(F.lit(name).alias("tbl"), "row_id", digest("look").alias("look"), digest("text").alias("text"))
        out = rows if out is None else out.unionByName(rows)
    # looks with a single string need no join; they are most of all
    several = out.groupBy("tbl", "look").agg(F.min("text").alias("x"), F.max("text").alias("y")).where("x <> y").select("tbl", "look")
    rows = out.join(several, ["tbl", "look"], "left_semi")
    a = rows.select("tbl", "look", F.col("row_id").alias("row_id_a"), F.col("text").alias("ta"))
    b = rows.select("tbl", "look", F.col("row_id").alias("row_id_b"), F.col("text").alias("tb"))
    return a.join(b, ["tbl", "look"]).where("row_id_a < row_id_b and ta <> tb").select("tbl", "row_id_a", "row_id_b")
