"""Problem 7: pairs of line and sentence that render each other in loosely translated documents.

Lines and sentences are first aligned by their lengths (dynamic programming over beads 1-1, 1-0, 0-1, 2-1, 1-2). On the
confident 1-1 beads of all rows, word-translation probabilities are trained by expectation-maximisation in both directions,
each with an empty word that takes what nothing else explains. The probability that a word is rendered by one of the other
side's words and not by the empty one, weighed by the word's rarity, gives the share of a line that a sentence accounts for,
and the reverse; names and numbers that agree count as well. A dynamic programme over these scores realigns in order, with
omissions, merged and divided parts; its cells are the result. Lines and sentences without a partner are realigned by
further passes over what is left, so that moved ones are found.

All of a batch's documents are handled in flat arrays; the programmes run row by row over many documents at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletloom.llm import sketch as S
from tabletloom.llm.canonical import is_name, letters, variants
from tabletloom.llm.look import consistent_arrow
from tabletloom.session import cut, spread

#: A word takes part in the translation probabilities if it occurs in so many lines or sentences of the whole table.
OFTEN = 4
ROUNDS = 4
#: Share of a line or sentence that its partner must account for.
ACCEPT = 0.5
#: What a cell's score must exceed to be worth a place in the alignment, and by how much it may fall behind the best cells of
#: both its line and its sentence.
FLOOR, BEHIND = 0.3, 0.1
#: Probability given to no word at all besides the empty one.
UNEXPLAINED = 0.03
#: Probability from which on, in either direction, a word pair is of use.
LEAST = 0.05
#: Share of their letter pairs that two names must have in common to agree, and what such agreement counts.
SIMILAR, AGREED = 0.45, 0.95
#: Cells that one array of alignments holds at most, unless a single document has more.
CELLS = 300_000
_PUNCTUATION = ".,;:!?\"'()[]<>˹˺“”…/"
_SENTENCE = re.compile(r"[.\n]")


def lines_of(text: str) -> list[str]:
    """The non-blank lines."""
    return [x for x in text.split("\n") if x.strip()]


def sentences_of(text: str) -> list[str]:
    """The non-blank pieces between full stops and line feeds."""
    return [x for x in _SENTENCE.split(text) if x.strip()]


WORD, NAME, NUMBER = 0, 1, 2


def source_token(word: str) -> tuple[str, int]:
    """(token, kind) of a word of a consistent transliteration; the token is empty where nothing of it counts."""
    if is_name(word):
        return min(variants(word), key=len, default=""), NAME
    w = word.strip(_PUNCTUATION)
    if w == "x":
        return "", WORD
    return w if w.isupper() else w.lower(), NUMBER if w[:1].isdigit() else WORD


def target_token(word: str) -> tuple[str, int]:
    """(token, kind) of a word of a translation; a capitalised word may be a name."""
    w = word.strip(_PUNCTUATION)
    if w[:1].isupper() and len(w) > 3:
        return w, NAME
    return w.lower(), NUMBER if w[:1].isdigit() else WORD


class Words:
    """Numbers of the words of one side as a task meets them, with what is known of each distinct one."""

    def __init__(self, source: bool, vocabulary: Vocabulary | None = None, limit: int = 1_000_000) -> None:
        self.source, self.vocabulary, self.limit = source, vocabulary, limit
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.tokens: list[str] = []
        self.kind, self.hash, self.id = np.empty(0, np.int8), np.empty(0, np.uint64), np.empty(0, np.int64)
        self.pairs = np.empty((0, 13), np.uint64)

    def _learn(self, new: list[str]) -> None:
        folded = consistent_arrow(pa.array(new, pa.string())).to_pylist() if self.source else new
        got = [source_token(w) for w in folded] if self.source else [target_token(w) for w in new]
        token, kind = [t for t, _ in got], np.array([k for _, k in got], np.int8)
        ids = np.zeros(len(new), np.int64)
        if not self.source:  # a capitalised word that is common in small letters is no name; one that opens very many
            low = [t.lower() for t in token]  # sentences may be either
            if self.vocabulary:
                ids = self.vocabulary.ids(hashes(low))
                kind[(kind == NAME) & (ids > 0) & ~self.vocabulary.opener[ids - 1]] = WORD
            token = [f"^{letters(t)}$" if k == NAME else x for t, x, k in zip(token, low, kind, strict=True)]
        h = hashes(token)
        h[[not t for t in token]] = 0
        if self.source and self.vocabulary:
            ids = np.where(kind == WORD, self.vocabulary.ids(h), 0)
        base = len(self.number)
        self.number |= {w: base + i for i, w in enumerate(new)}
        self.tokens += token
        self.kind, self.hash = np.concatenate([self.kind, kind]), np.concatenate([self.hash, h])
        self.id = np.concatenate([self.id, np.where(h > 0, ids, 0)])
        self.pairs = np.concatenate([self.pairs, letter_pairs([t if k == NAME else "" for t, k in zip(token, kind, strict=True)])])

    def codes(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word number, part) of the words of all parts that count."""
        if len(self.number) > self.limit:
            self.clear()
        words = [p.split() for p in parts]
        flat = [w for p in words for w in p]
        new = list(dict.fromkeys(w for w in flat if w not in self.number))
        if new:
            self._learn(new)
        number = self.number
        code = np.fromiter((number[w] for w in flat), np.int64, len(flat))
        part = np.repeat(np.arange(len(parts)), np.fromiter(map(len, words), np.int64, len(words)))
        keep = self.hash[code] > 0 if len(code) else np.empty(0, bool)
        return code[keep], part[keep]


def hashes(tokens: list[str]) -> np.ndarray:
    """64-bit hashes of strings."""
    cp, row = S.flat(tokens)
    return S.class_ids(cp, row, len(tokens), np.zeros(len(tokens), np.int64)) | np.uint64(1)


def letter_pairs(names: list[str]) -> np.ndarray:
    """names x 13 words: a bit for each pair of neighbouring letters of a folded name (of a-z, ``^`` and ``$``)."""
    cp, row = S.flat(names)
    code = np.where(cp == ord("^"), 26, np.where(cp == ord("$"), 27, cp.astype(np.int64) - ord("a")))
    inside = row[1:] == row[:-1]
    bit = (code[:-1] * 28 + code[1:])[inside]
    out = np.zeros((len(names), 13), np.uint64)
    np.bitwise_or.at(out, (row[:-1][inside], bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
    return out


class Vocabulary:
    """Words of a side by their hashes: 17 bytes a word, so that all may take part. ``opener``: not known in small letters."""

    def __init__(self, hash_: np.ndarray, count: np.ndarray, opener: np.ndarray) -> None:
        order = np.argsort(hash_)
        self.hash, self.count, self.opener = hash_[order], count[order], np.r_[opener[order], False]

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Numbers from 1 on, 0 for unknown words."""
        if not len(self.hash):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, at + 1, 0)


class Parts:
    """The lines and sentences of a batch's rows."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.row_id = np.asarray(batch.column("row_id"))
        lines, sentences = ([f(t) for t in batch.column(c).to_pylist()] for f, c in ((lines_of, "src"), (sentences_of, "tgt")))
        self.n, self.m = (np.fromiter(map(len, x), np.int64, len(x)) for x in (lines, sentences))
        self.lines, self.sentences = [p for x in lines for p in x], [p for x in sentences for p in x]
        self.line_doc, self.sentence_doc = (np.repeat(np.arange(len(x)), x) for x in (self.n, self.m))
        self.first_line, self.first_sentence = np.cumsum(self.n) - self.n, np.cumsum(self.m) - self.m


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def _rows(df: DataFrame, id_column: str, source: str, target: str) -> DataFrame:
    return df.select(F.col(id_column).cast("long").alias("row_id"), F.col(source).cast("string").alias("src"), F.col(target).cast("string").alias("tgt")).where("src is not null and tgt is not null")


def vocabularies(rows: DataFrame) -> tuple[Vocabulary, Vocabulary, int]:
    """(source words, target words, number of sentences); sentence openers count as words if they open very many."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = (Words(True), Words(False), Words(False))
        total: list[dict[int, int]] = [{}, {}, {}]
        for batch in slices(batches):
            p = Parts(batch)
            first = [x.split(None, 1)[0].lower() for x in p.sentences]
            for k, parts in enumerate((p.lines, p.sentences, first)):
                code, part = sides[k].codes(parts)
                code, part = (x[sides[k].kind[code] == WORD] for x in (code, part))
                h = sides[k].hash[code]
                distinct, at = np.unique(h, return_inverse=True)
                n = np.bincount(np.unique(at * len(parts) + part) // max(1, len(parts)), minlength=len(distinct))  # once a part
                for x, y in zip(distinct.tolist(), n.tolist(), strict=True):
                    total[k][x] = total[k].get(x, 0) + y
            total[2][0] = total[2].get(0, 0) + len(first)
        for k, found in enumerate(total):
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), pa.int32()), pa.array(np.fromiter(found, np.uint64, len(found)).view(np.int64)), pa.array(list(found.values()), pa.int64())], names=["side", "h", "n"])

    got = rows.mapInArrow(count, "side int, h long, n long").groupBy("side", "h").agg(F.sum("n").alias("n")).where(f"n >= {OFTEN} or h = 0").toArrow()
    side, h, n = (np.asarray(got.column(c)) for c in ("side", "h", "n"))
    h = h.view(np.uint64)
    sentences = int(n[h == 0].sum())
    known = h > 0
    # names open a sentence now and then, words like "Whether" very often
    openers = (side == 2) & known & (n > 0.004 * sentences) & ~np.isin(h, h[side == 1])
    of = lambda k: Vocabulary(h[k], n[k], openers[k])
    return of((side == 0) & known), of((side == 1) & known | openers), max(1, sentences)


# --- alignment by length ---


def grouped(n: np.ndarray, m: np.ndarray) -> Iterator[np.ndarray]:
    """Documents of about the same size, so many that their padded cells stay within ``CELLS``."""
    some = np.flatnonzero((n > 0) & (m > 0))
    order = some[np.lexsort((m[some], n[some]))]
    at = 0
    while at < len(order):
        to, most = at + 1, m[order[at]] + 2
        while to < len(order):
            most = max(most, m[order[to]] + 2)
            if (to + 1 - at) * (n[order[to]] + 1) * most > CELLS:
                break
            to += 1
        yield order[at:to]
        at = to


def padded(values: np.ndarray, first: np.ndarray, size: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """docs x longest: the values of each document, zeros behind."""
    width = int(size[docs].max())
    at = first[docs, None] + np.arange(width)
    return np.where(np.arange(width) < size[docs, None], values[np.minimum(at, len(values) - 1)], 0)


def length_beads(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, i, j, cost) of the 1-1 beads of the cheapest alignments by lengths in order. ``a`` and ``b`` hold the
    lengths, padded; ``n`` and ``m`` how many there are."""
    docs, rows, columns = len(a), a.shape[1], b.shape[1]
    a, b = a.astype(np.float32), b.astype(np.float32)
    ratio = np.clip((b.sum(1) + 1) / (a.sum(1) + 1), 0.2, 5.0)[:, None]

    def cost(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.abs(x * ratio - y) / (3.0 * np.sqrt((x * ratio + y) / 2 + 1))

    far = np.float32(1e9)
    skip = 3.0 * np.arange(columns + 1, dtype=np.float32)
    two = np.concatenate([np.full((docs, 1), far, np.float32), b[:, :-1] + b[:, 1:]], axis=1) if columns > 1 else np.full((docs, 1), far, np.float32)
    before = np.full((docs, columns + 1), far, np.float32)
    last = np.broadcast_to(skip, (docs, columns + 1)).copy()
    way = np.full((docs, rows + 1, columns + 1), 1, np.int8)  # 0: 1-1, 1: 0-1, 2: 1-0, 3: 2-1, 4: 1-2
    for i in range(1, rows + 1):
        x = a[:, i - 1 : i]
        options = np.full((4, docs, columns + 1), far, np.float32)
        options[0, :, 1:] = last[:, :-1] + cost(x, b)
        options[1] = last + 3.0
        if i > 1:
            options[2, :, 1:] = before[:, :-1] + cost(x + a[:, i - 2 : i - 1], b) + 1.5
        options[3, :, 2:] = last[:, :-2] + cost(x, two[:, 1:]) + 1.5
        best = options.min(axis=0)
        run = np.minimum.accumulate(best - skip, axis=1) + skip
        way[:, i] = np.where(best <= run + 1e-5, np.array([0, 2, 3, 4], np.int8)[options.argmin(axis=0)], 1)
        before, last = last, run
    step_i, step_j = np.array([1, 0, 1, 2, 1]), np.array([1, 1, 0, 1, 2])
    i, j, d = n.copy(), m.copy(), np.arange(docs)
    out: list[tuple[np.ndarray, ...]] = []
    while len(d):
        w = np.where(i == 0, 1, np.where(j == 0, 2, way[d, i, j]))
        i, j = i - step_i[w], j - step_j[w]
        one = w == 0
        out.append((d[one], i[one], j[one]))
        on = (i > 0) | (j > 0)
        d, i, j = d[on], i[on], j[on]
    d, i, j = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3
    return d, i, j, (np.abs(a[d, i] * ratio[d, 0] - b[d, j]) / (3.0 * np.sqrt((a[d, i] * ratio[d, 0] + b[d, j]) / 2 + 1)))


def confident_pairs(rows: DataFrame, source: Vocabulary, target: Vocabulary) -> DataFrame:
    """(s, t): word numbers of lines and sentences that the lengths align one to one."""
    shared = rows.sparkSession.sparkContext.broadcast((source, target))
    kind = pa.list_(pa.int32())

    def ids(words: Words, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word number, begin of each part): distinct known words of each part."""
        code, part = words.codes(parts)
        i = words.id[code]
        key = np.unique(part[i > 0] * (1 << 32) + i[i > 0])
        return key & 0xFFFFFFFF, np.searchsorted(key, np.arange(len(parts) + 1) << 32)

    def listed(values: np.ndarray, begin: np.ndarray, wanted: np.ndarray) -> pa.Array:
        size = begin[wanted + 1] - begin[wanted]
        end = np.cumsum(size)
        at = np.arange(int(end[-1]) if len(end) else 0) + np.repeat(begin[wanted] - (end - size), size)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, end].astype(np.int32)), pa.array(values[at].astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(True, shared.value[0]), Words(False, shared.value[1])
        for batch in slices(batches):
            p = Parts(batch)
            even = np.abs(p.n - p.m) <= 0.34 * np.maximum(p.n, p.m)
            a, b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (p.lines, p.sentences))
            line, sentence = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for docs in grouped(np.where(even, p.n, 0), p.m):
                d, i, j, c = length_beads(padded(a, p.first_line, p.n, docs), padded(b, p.first_sentence, p.m, docs), p.n[docs], p.m[docs])
                sure = c < 1.5
                line.append((p.first_line[docs[d]] + i)[sure])
                sentence.append((p.first_sentence[docs[d]] + j)[sure])
            line, sentence = np.concatenate(line), np.concatenate(sentence)
            (s, s_begin), (t, t_begin) = ids(words[0], p.lines), ids(words[1], p.sentences)
            some = (s_begin[line + 1] > s_begin[line]) & (t_begin[sentence + 1] > t_begin[sentence])
            yield pa.RecordBatch.from_arrays([listed(s, s_begin, line[some]).cast(kind), listed(t, t_begin, sentence[some]).cast(kind)], names=["s", "t"])

    return rows.mapInArrow(run, "s array<int>, t array<int>")


# --- translation probabilities ---


class Table:
    """Translation probabilities of word pairs, sorted by (source, target) number; number 0 is the empty word."""

    def __init__(self, s: np.ndarray, t: np.ndarray, forward: np.ndarray, backward: np.ndarray, sizes: tuple[int, int]) -> None:
        order = np.lexsort((t, s))
        self.sizes = sizes
        self.s, self.t = s[order], t[order]
        f, b = forward[order].astype(np.float64), backward[order].astype(np.float64)
        by = lambda i, w, n: np.maximum(np.bincount(i, weights=w, minlength=n + 1), 1e-12)[i]
        self.count = f + b
        self.forward = f / by(self.s, f, sizes[0])  # of the target word, given the source word
        self.backward = b / by(self.t, b, sizes[1])  # of the source word, given the target word
        self.key = self.s.astype(np.int64) * (sizes[1] + 1) + self.t

    def at(self, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.key, s * (self.sizes[1] + 1) + t), max(0, len(self.key) - 1))


def combined(s: pa.Array, t: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair, source word, target word, target's place) of every source word, and the empty one, with every target word, and
    the empty one, of each pair. Places tell equal words of different pairs apart."""
    ns, nt = (np.asarray(pa.compute.list_value_length(x)).astype(np.int64) + 1 for x in (s, t))

    def with_empty(x: pa.Array, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros(int(n.sum()), np.int64)
        first = np.cumsum(n) - n
        rest = np.ones(len(out), bool)
        rest[first] = False
        out[rest] = np.asarray(x.flatten())
        return out, first

    (fs, s_first), (ft, t_first) = with_empty(s, ns), with_empty(t, nt)
    pair = np.repeat(np.arange(len(ns)), ns * nt)
    nth = np.arange(len(pair)) - np.repeat(np.cumsum(ns * nt) - ns * nt, ns * nt)
    s_at, t_at = s_first[pair] + nth // nt[pair], t_first[pair] + nth % nt[pair]
    keep = (fs[s_at] > 0) | (ft[t_at] > 0)
    return s_at[keep], t_at[keep], fs, ft


def train(pairs: DataFrame, sizes: tuple[int, int], rounds: int = ROUNDS) -> Table:
    """Probabilities by expectation-maximisation over all pairs, in both directions at once. Word pairs expected fewer than
    0.05 times in a round are left to the empty word; those expected fewer than twice in the end have no probability."""
    sc = pairs.sparkSession.sparkContext
    table: Table | None = None
    for k in range(rounds):
        shared = sc.broadcast(table)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            t = shared.value
            key, forward, backward = [np.empty(0, np.int64)], [np.empty(0)], [np.empty(0)]
            held = 0

            def folded() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                u, at = np.unique(np.concatenate(key), return_inverse=True)
                return u, *(np.bincount(at, weights=np.concatenate(x), minlength=len(u)) for x in (forward, backward))

            for batch in slices(batches, 20_000):
                s_at, t_at, fs, ft = combined(batch.column("s"), batch.column("t"))
                s, w = fs[s_at], ft[t_at]
                if t is None:
                    f, b = (w > 0).astype(float), (s > 0).astype(float)
                    known = np.ones(len(s), bool)
                else:
                    at = t.at(s, w)
                    known = t.key[at] == s * (sizes[1] + 1) + w
                    f, b = np.where(known & (w > 0), t.forward[at], 0.0), np.where(known & (s > 0), t.backward[at], 0.0)
                f /= np.maximum(np.bincount(t_at, weights=f, minlength=len(ft)), 1e-12)[t_at]
                b /= np.maximum(np.bincount(s_at, weights=b, minlength=len(fs)), 1e-12)[s_at]
                key.append((s * (sizes[1] + 1) + w)[known])
                forward.append(f[known])
                backward.append(b[known])
                held += len(key[-1])
                if held > 4_000_000:
                    u, f, b = folded()
                    key, forward, backward, held = [u], [f], [b], len(u) // 2
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in folded()], names=["k", "f", "b"])

        rows = pairs.mapInArrow(expect, "k long, f double, b double").groupBy("k").agg(F.sum("f").alias("f"), F.sum("b").alias("b"))
        got = rows.where(f"f + b > {0.05 if k + 1 < rounds else 2}").toArrow()
        key = np.asarray(got.column("k"), np.int64)
        table = Table(key // (sizes[1] + 1), key % (sizes[1] + 1), np.asarray(got.column("f")), np.asarray(got.column("b")), sizes)
        shared.unpersist()
    return table


class Lexicon:
    """What the last pass needs: vocabularies, the pairs' probabilities and each word's weight and empty probability."""

    def __init__(self, source: Vocabulary, target: Vocabulary, sentences: int, table: Table) -> None:
        self.source, self.target = source, target
        self.s_weight, self.t_weight = (np.r_[1.0, np.log1p(sentences / v.count)] for v in (source, target))
        self.name_weight = float(np.log1p(300))
        real = (table.s > 0) & (table.t > 0) & (np.maximum(table.forward, table.backward) >= LEAST)
        self.s_empty, self.t_empty = np.zeros(len(source.hash) + 1), np.zeros(len(target.hash) + 1)
        self.s_empty[table.s[table.t == 0]] = table.backward[table.t == 0]
        self.t_empty[table.t[table.s == 0]] = table.forward[table.s == 0]
        self.s, self.t, self.forward, self.backward = (x[real] for x in (table.s, table.t, table.forward, table.backward))
        self.begin = np.searchsorted(self.s, np.arange(len(source.hash) + 2))
        # words that nothing goes with count little
        self.s_weight[np.setdiff1d(np.arange(len(self.s_weight)), self.s)] = 0.4
        self.t_weight[np.setdiff1d(np.arange(len(self.t_weight)), self.t)] = 0.4


def ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, element) of all elements of the ranges."""
    size = end - begin
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + begin[which]


def shares(p: Parts, words: tuple[Words, Words], lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(of lines, of sentences, first cell of each document): in one flat array of all cells, line by line, the share by
    weight of each line that each sentence of its document accounts for, and of each sentence that each line does."""
    (sc, line), (tc, sentence) = words[0].codes(p.lines), words[1].codes(p.sentences)
    (s_id, s_kind), (t_id, t_kind) = ((w.id[c], w.kind[c]) for w, c in zip(words, (sc, tc), strict=True))
    s_doc, t_doc = p.line_doc[line], p.sentence_doc[sentence]
    weights = []
    for ids, kind, table in ((s_id, s_kind, lexicon.s_weight), (t_id, t_kind, lexicon.t_weight)):
        weights.append(np.where(ids > 0, table[ids], np.where(kind == NAME, lexicon.name_weight, np.where(kind == NUMBER, table[0], 0.4))))
    # words with their translations in the same document
    order = np.lexsort((t_id, t_doc))
    wide = len(lexicon.t_weight)
    t_key = (t_doc * wide + t_id)[order]
    k, e = ranges(lexicon.begin[s_id], np.where(s_id > 0, lexicon.begin[s_id + 1], lexicon.begin[s_id]))
    want = s_doc[k] * wide + lexicon.t[e]
    x, at = ranges(np.searchsorted(t_key, want), np.searchsorted(t_key, want, "right"))
    a, b, fw, bw = k[x], order[at], lexicon.forward[e[x]], lexicon.backward[e[x]]
    # names and numbers that agree
    na, nb, nx = agreeing(words, (sc, tc), (s_kind, t_kind), (s_doc, t_doc))
    first = np.cumsum(p.n * p.m) - p.n * p.m
    out = []
    for one, other, prob, empty, ids, part, other_part, weight, flip in (
        (a, b, bw, lexicon.s_empty, s_id, line, sentence, weights[0], False),
        (b, a, fw, lexicon.t_empty, t_id, sentence, line, weights[1], True),
    ):
        parts = len(p.lines) if flip else len(p.sentences)
        cell, where = np.unique(one * parts + other_part[other], return_inverse=True)
        token = cell // parts
        likely = np.zeros(len(cell))  # of the likeliest word, so that long parts are at no advantage
        np.maximum.at(likely, where, prob)
        rendered = likely / (likely + empty[ids[token]] + UNEXPLAINED)
        n1, n2 = (nb, na) if flip else (na, nb)
        cell, where = np.unique(np.concatenate([cell, n1 * parts + other_part[n2]]), return_inverse=True)
        best = np.zeros(len(cell))
        np.maximum.at(best, where, np.concatenate([rendered, nx]))
        token, opposite = cell // parts, cell % parts
        value = best * weight[token]
        i, j = (opposite, part[token]) if flip else (part[token], opposite)
        doc = p.line_doc[i]
        at = first[doc] + (i - p.first_line[doc]) * p.m[doc] + j - p.first_sentence[doc]
        whole = np.maximum(np.bincount(part, weights=weight, minlength=len(p.sentences) if flip else len(p.lines)), 1e-9)
        out.append(np.bincount(at, weights=value / whole[j if flip else i], minlength=int((p.n * p.m).sum())))
    return out[0], out[1], first


def agreeing(words: tuple[Words, Words], codes: tuple[np.ndarray, np.ndarray], kinds: tuple[np.ndarray, np.ndarray], docs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(source token, target token, agreement) of names and numbers of a document that agree: 1 for equal ones and for a
    broken name that the other continues, else ``AGREED`` for names with enough letter pairs in common."""
    out: list[tuple[np.ndarray, ...]] = []
    # equal names and numbers
    at = [np.flatnonzero(k != WORD) for k in kinds]
    mixed = [S.mix(words[k].hash[codes[k][at[k]]] ^ S.mix(docs[k][at[k]].astype(np.uint64))) for k in (0, 1)]
    order = np.argsort(mixed[1], kind="stable")
    i, j = ranges(np.searchsorted(mixed[1][order], mixed[0]), np.searchsorted(mixed[1][order], mixed[0], "right"))
    out.append((at[0][i], at[1][order[j]], np.ones(len(i))))
    # other names: each distinct one of a document with each
    of = []
    for k in (0, 1):
        name = np.flatnonzero(kinds[k] == NAME)
        width = len(words[k].hash) + 1
        key, where = np.unique(docs[k][name] * width + codes[k][name], return_inverse=True)
        of.append((name[np.argsort(where, kind="stable")], np.r_[0, np.cumsum(np.bincount(where, minlength=len(key)))], key // width, key % width))
    (s_at, s_begin, s_doc, s_code), (t_at, t_begin, t_doc, t_code) = of
    i, j = ranges(np.searchsorted(t_doc, s_doc), np.searchsorted(t_doc, s_doc, "right"))
    both, either = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    a, b = words[0].pairs[s_code], words[1].pairs[t_code]
    for w in range(a.shape[1]):
        x, y = a[i, w], b[j, w]
        both += np.bitwise_count(x & y)
        either += np.bitwise_count(x | y)
    value = np.where(both >= SIMILAR * np.maximum(either, 1), AGREED, 0.0)
    equal = words[0].hash[s_code[i]] == words[1].hash[t_code[j]]
    open_ = np.array([not words[0].tokens[c].endswith("$") and len(words[0].tokens[c]) > 4 for c in s_code.tolist()], bool)
    for k in np.flatnonzero(open_[i] & ~equal).tolist() if len(open_) else ():
        if words[1].tokens[t_code[j[k]]].startswith(words[0].tokens[s_code[i[k]]]):
            value[k] = 1.0
    keep = (value > 0) & ~equal
    i, j, value = i[keep], j[keep], value[keep]
    x, u = ranges(s_begin[i], s_begin[i + 1])
    y, v = ranges(t_begin[j[x]], t_begin[j[x] + 1])
    out.append((s_at[u[y]], t_at[v], value[x[y]]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


# --- realignment ---


def in_order(score: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """docs x lines x sentences: the cells that an alignment in order of greatest total score goes through, of each document.

    ``score`` is padded (with any negative number) to the longest; cells of a negative score are never gone through. A
    line may go with several sentences in a row and the reverse, for nine tenths of the further cells' scores.
    """
    docs, rows, columns = score.shape
    last = np.zeros((docs, columns + 1))
    way = np.zeros((docs, rows, columns), np.int8)  # 1: diagonal, 2: from above, 3: from the left, 0, 4: as 2, 3 without the cell
    for i in range(rows):
        x = score[:, i]
        more = np.maximum(0.9 * x, 0.0)
        sloping = np.where(x >= 0, last[:, :-1] + x, -1.0)
        above = last[:, 1:] + more
        best = np.maximum(sloping, above)
        total = np.cumsum(more, axis=1)
        run = np.maximum(np.maximum.accumulate(best - total, axis=1), 0.0) + total
        left = np.concatenate([np.zeros((docs, 1)), run[:, :-1]], axis=1) + more
        w = np.where(sloping >= above, 1, np.where(x >= 0, 2, 0))
        way[:, i] = np.where(left > best + 1e-9, np.where(x >= 0, 3, 4), w)
        last[:, 1:] = run
    on = np.zeros((docs, rows, columns), bool)
    d, i, j = np.arange(docs), n - 1, m - 1
    while len(d):
        w = way[d, i, j]
        hit = (w > 0) & (w < 4)
        on[d[hit], i[hit], j[hit]] = True
        i, j = i - ((w <= 2) * 1), j - ((w == 1) | (w >= 3)) * 1
        go = (i >= 0) & (j >= 0)
        d, i, j = d[go], i[go], j[go]
    return on


def chosen(on: np.ndarray, share: np.ndarray, axis: int) -> np.ndarray:
    """Of the cells gone through, the one of each part with the greatest share, if it is enough."""
    x = np.where(on, share, -1.0)
    best = x.max(axis=axis, keepdims=True)
    return on & (x >= best) & (share >= ACCEPT)


def links(of_line: np.ndarray, of_sentence: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """docs x lines x sentences: the pairs. Each line goes with the cell of the alignment that accounts for most of it, each
    sentence likewise; passes over those without a partner follow until none finds one. A cell that both its line and its
    sentence have a clearly better one than stays out of a pass, so that moved lines do not pair up with their neighbours."""
    both = np.maximum(of_line, of_sentence)
    found = np.zeros(both.shape, bool)
    while True:
        free_line, free_sentence = ~found.any(axis=2, keepdims=True), ~found.any(axis=1, keepdims=True)
        left = np.where(free_line | free_sentence, both, -1.0)
        behind = np.minimum(left.max(axis=2, keepdims=True), left.max(axis=1, keepdims=True)) - left
        on = in_order(np.where((left >= 0) & (behind <= BEHIND), both - FLOOR, -1.0), n, m) & ~found
        new = chosen(on, np.where(free_line, of_line, 0.0), 2) | chosen(on, np.where(free_sentence, of_sentence, 0.0), 1)
        if not new.any():
            return found
        found |= new


def align(df: DataFrame, id_column: str = "row_id", source: str = "transliteration", target: str = "translation") -> DataFrame:
    """(row_id, src_no, tgt_no, score) of all rows. Rows with a null or blank side have no pair; repeated rows repeat."""
    rows = spread(_rows(df, id_column, source, target))
    src, tgt, sentences = vocabularies(rows)
    table = train(cut(confident_pairs(rows, src, tgt)), (len(src.hash), len(tgt.hash)))
    shared = rows.sparkSession.sparkContext.broadcast(Lexicon(src, tgt, sentences, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        words = Words(True, lexicon.source), Words(False, lexicon.target)
        for batch in slices(batches, 500):
            p = Parts(batch)
            of_line, of_sentence, first = shares(p, words, lexicon)
            out: list[tuple[np.ndarray, ...]] = []
            for docs in grouped(p.n, p.m):
                n, m = p.n[docs], p.m[docs]
                i, j = np.arange(int(n.max()))[None, :, None], np.arange(int(m.max()))[None, None, :]
                inside = (i < n[:, None, None]) & (j < m[:, None, None])
                at = np.where(inside, first[docs][:, None, None] + i * m[:, None, None] + j, 0)
                a, b = (np.where(inside, x[at], -1.0) for x in (of_line, of_sentence))
                d, i, j = np.nonzero(links(a, b, n, m))
                out.append((p.row_id[docs[d]], i + 1, j + 1, np.maximum(a, b)[d, i, j]))
            columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0)] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["row_id", "src_no", "tgt_no", "score"])

    return rows.mapInArrow(run, "row_id long, src_no long, tgt_no long, score double")
