"""Problem 8: encoding with a public byte-level BPE tokenizer by a lazily determinised transducer.

The merges of the vocabulary decide which two tokens may stand side by side: those whose joint bytes are merged into
just the two. A token sequence is the tokenizer's own exactly when all neighbours may stand so, and for each prefix of
the bytes there is exactly one such sequence. The transducer reads bytes; its state holds the places where a token may
still begin (those from which the bytes read so far go on inside the vocabulary) with the tokens up to each. Tokens
common to all places are emitted at once, so the lookahead is bounded by the longest token. States and transitions are
made when first met and kept.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletloom.session import spread

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pattern by which texts are cut before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Transducer:
    """Bytes in, token ids out. ``ranks`` maps the bytes of a token to its id, which is also its merge rank."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.inner = {b[:n] for b in ranks for n in range(1, len(b))}  # proper prefixes of tokens
        self._pairs: dict[tuple[int, int], bool] = {}
        # a state: the bytes not yet emitted, and for each place in them where a token may begin the tokens up to it
        self.states: list[tuple[bytes, int, tuple[tuple[int, tuple[int, ...]], ...]]] = [(b"", -1, ((0, ()),))]
        self.numbers = {self.states[0]: 0}
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.ends: dict[int, tuple[int, ...]] = {}

    def merged(self, b: bytes) -> list[int]:
        """The tokens of a few bytes by merging the pair of least rank again and again."""
        part = [b[i : i + 1] for i in range(len(b))]
        while len(part) > 1:
            rank, i = min((self.ranks.get(part[i] + part[i + 1], 1 << 60), i) for i in range(len(part) - 1))
            if rank == 1 << 60:
                break
            part[i : i + 2] = [part[i] + part[i + 1]]
        return [self.ranks[p] for p in part]

    def beside(self, a: int, b: int) -> bool:
        """Whether token b may follow token a."""
        if a < 0:
            return True
        ok = self._pairs.get((a, b))
        if ok is None:
            ok = self._pairs[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return ok

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The next state and the tokens emitted on reading a byte."""
        known = self.steps.get(state << 8 | byte)
        if known:
            return known
        held, last, places = self.states[state]
        held += bytes([byte])
        n, here, alive = len(held), None, []
        for at, path in places:
            tail = held[at:]
            token = self.ranks.get(tail)
            if token is not None and here is None and self.beside(path[-1] if path else last, token):
                here = (*path, token)  # exactly one sequence ends here
            if tail in self.inner:
                alive.append((at, path))
        if here is None:
            raise ValueError("the vocabulary lacks a byte")
        alive.append((n, here))
        common = 0
        while all(len(p) > common for _, p in alive) and len({p[common] for _, p in alive}) == 1:
            common += 1
        out = alive[0][1][:common]
        cut = sum(len(self.bytes_of[t]) for t in out)
        new = (held[cut:], out[-1] if out else last, tuple((at - cut, p[common:]) for at, p in alive))
        number = self.numbers.setdefault(new, len(self.states))
        if number == len(self.states):
            self.states.append(new)
        self.steps[state << 8 | byte] = known = number, out
        return known

    def finish(self, state: int) -> tuple[int, ...]:
        """The tokens still held at the end of the input."""
        held, _, places = self.states[state]
        return next(p for at, p in places if at == len(held))

    def encode(self, data: bytes) -> list[int]:
        out, state = [], 0
        steps = self.steps
        for byte in data:
            state, emitted = steps.get(state << 8 | byte) or self.step(state, byte)
            out += emitted
        out += self.finish(state)
        if len(self.states) > 200_000:  # forgotten states are made again when met
            self.__init__(self.ranks)
        return out


class Encoder:
    """Texts to ids. Each distinct word goes through the transducer once as long as it is remembered."""

    def __init__(self, path: str = DEFAULT_RANKS, pattern: str = PATTERN, remembered: int = 200_000) -> None:
        import regex

        with open(path, "rb") as f:
            self.transducer = Transducer({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
        self.find = regex.compile(pattern).findall
        self.words: dict[str, list[int]] = {}
        self.remembered = remembered

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for null and for the empty text."""
        out: list[int] = []
        words = self.words
        for w in self.find(text or ""):
            ids = words.get(w)
            if ids is None:
                ids = self.transducer.encode(w.encode("utf-8", "surrogatepass"))
                if len(w) <= 64:
                    if len(words) >= self.remembered:
                        words.clear()
                    words[w] = ids
            out += ids
        return out


class Decoder:
    """Ids to text as they come: bytes pass an incremental UTF-8 state machine, which gives out whole characters only.

    Bytes that are no UTF-8 come out as U+FFFD, one for each maximal part of a sequence.
    """

    def __init__(self, bytes_of: dict[int, bytes]) -> None:
        self.bytes_of = bytes_of
        self.need, self.value, self.low, self.high = 0, 0, 0x80, 0xBF

    def push(self, ids: list[int]) -> str:
        out = []
        for i in ids:
            for b in self.bytes_of[i]:
                if self.need:
                    if self.low <= b <= self.high:
                        self.value = self.value << 6 | b & 0x3F
                        self.need, self.low, self.high = self.need - 1, 0x80, 0xBF
                        if not self.need:
                            out.append(chr(self.value))
                        continue
                    self.need = 0
                    out.append("�")
                self.low, self.high = 0x80, 0xBF
                if b < 0x80:
                    out.append(chr(b))
                elif 0xC2 <= b <= 0xDF:
                    self.need, self.value = 1, b & 0x1F
                elif 0xE0 <= b <= 0xEF:
                    self.need, self.value = 2, b & 0x0F
                    self.low, self.high = 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
                elif 0xF0 <= b <= 0xF4:
                    self.need, self.value = 3, b & 0x07
                    self.low, self.high = 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
                else:
                    out.append("�")
        return "".join(out)

    def end(self) -> str:
        held, self.need = self.need, 0
        return "�" if held else ""


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a Python worker."""
    return Encoder(path)


def encode_column(df: DataFrame, id_column: str, text_column: str, path: str = DEFAULT_RANKS, count_only: bool = False) -> DataFrame:
    """(id, ids array of int), or with ``count_only`` (id, n_tokens): the tokens of each text, special tokens none.

    Null and empty texts have the empty list. Other columns are not read; repeated rows stay repeated.
    """
    narrow = spread(df.select(F.col(id_column), F.col(text_column).cast("string").alias("text")))
    id_type = narrow.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path).encode
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                ids = list(map(enc, batch.column("text").to_pylist()))
                size = np.fromiter(map(len, ids), np.int32, len(ids))
                if count_only:
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size)], names=[id_column, "n_tokens"])
                else:
                    flat = np.fromiter((x for y in ids for x in y), np.int32, int(size.sum()))
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_column, "ids"])

    return narrow.mapInArrow(run, f"`{id_column}` {id_type}, " + ("n_tokens int" if count_only else "ids array<int>"))


def decode_column(df: DataFrame, id_column: str, ids_column: str, path: str = DEFAULT_RANKS) -> DataFrame:
    """(id, text) of rows of ids. A null list has a null text, an empty one the empty text."""
    narrow = df.select(F.col(id_column), F.col(ids_column).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = encoder(path).transducer.bytes_of
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = []
                for ids in batch.column("ids").to_pylist():
                    d = Decoder(bytes_of)
                    texts.append(None if ids is None else d.push(ids) + d.end())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_column, "text"])

    return narrow.mapInArrow(run, f"`{id_column}` {narrow.schema[id_column].dataType.simpleString()}, text string")
