"""Problem 5: texts over a limit cut into pieces at natural boundaries, each piece repeating the end of the one before."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From the strongest boundary to the weakest; a cut falls after the match. Characters come last, without a pattern.
SEPARATORS = tuple(
    re.compile(p)
    for p in (
        r"\n[ \t]*\n[ \t]*\n\s*|\f\s*",  # sections: two or more blank lines, form feeds
        r"\n[ \t]*\n\s*",  # paragraphs
        r"\n",  # lines
        r"[.!?;](?=\s)[^\S\n]*",  # sentences
        r"\s",  # words
        r"-",  # signs of a transliterated word
    )
)


def atoms(text: str, begin: int, end: int, room: int, level: int = 0) -> Iterator[int]:
    """Ends of consecutive stretches of at most ``room`` code points that cover text[begin:end]."""
    while end - begin > room and level < len(SEPARATORS):
        cuts = [m.end() for m in SEPARATORS[level].finditer(text, begin, end)]
        level += 1
        if cuts and (len(cuts) > 1 or cuts[0] < end):
            for cut in [*cuts, end]:
                if cut > begin:
                    yield from atoms(text, begin, cut, room, level)
                    begin = cut
            return
    while end - begin > room:
        cut = begin + room
        while cut > begin + max(1, room // 2) and unicodedata.combining(text[cut]):  # marks stay with their letter
            cut -= 1
        yield cut
        begin = cut
    if end > begin:
        yield end


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(begin, end) of the pieces: each of at most ``limit`` code points, beginning ``overlap`` code points before the
    end of the one before; one piece for a text within the limit."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    if len(text) <= limit:
        return [(0, len(text))]
    out, begin, end = [], 0, 0
    for stop in atoms(text, 0, len(text), limit - overlap):
        if stop - begin > limit:
            out.append((begin, end))
            begin = max(0, end - overlap)
        end = stop
    out.append((begin, end))
    return out


def split_texts(df: DataFrame, limits: dict[str, int], overlap: int, id_column: str = "row_id") -> DataFrame:
    """(row_id, field, piece_no, pieces, begin, n_chars, piece): the pieces of each field named in ``limits``.

    piece_no counts from 1, begin (code points) from 0. A null text has no piece, an empty one a single empty piece.
    Repeated rows are cut alike; other columns, whatever their names, are not read.
    """
    out = None
    for field, limit in limits.items():
        one = df.select(F.col(id_column).cast("long").alias("row_id"), F.lit(field).alias("field"), F.lit(limit).alias("most"), F.col(field).cast("string").alias("text"))
        out = one if out is None else out.unionByName(one)
    schema = pa.schema([("row_id", pa.int64()), ("field", pa.string()), ("piece_no", pa.int32()), ("pieces", pa.int32()), ("begin", pa.int64()), ("n_chars", pa.int32()), ("piece", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for row_id, field, most, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                all_ = pieces(text, most, overlap)
                for i, (a, b) in enumerate(all_):
                    rows.append((row_id, field, i + 1, len(all_), a, b - a, text[a:b]))
                    size += b - a
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return out.where("text is not null").mapInArrow(cut, "row_id long, field string, piece_no int, pieces int, begin long, n_chars int, piece string")
