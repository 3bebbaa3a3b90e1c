"""Problem 10: abusive, hateful or sexual passages, found by maximum-scoring segments of token log-odds.

Words and word pairs get the log-odds that one of their tokens stands in abusive text, with Dirichlet priors whose
strength follows the corpus-wide frequencies. Minus a drift, these are scores that are negative on average, so that the maximal-scoring
segments of a document (one linear scan) are its candidate passages. The best segment of clean labelled documents
follows an extreme-value law in the logarithm of the length; a passage's p-value under it decides.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletloom.session import spread

#: Labelled documents that the model is fitted on at most (those of least hash, so that it is a fixed sample).
LABELLED = 20_000
#: Share of abusive tokens before anything is seen, and the least and greatest score of a token.
PRIOR, BOUNDS, DRIFT = 0.1, (-0.5, 4.0), 0.5
#: Weight of the prior, and how it follows the frequency expected in the sample from that in the corpus.
STRENGTH = (0.1, 0.02)
# Signs that stand for letters in evasive spelling.
_EVASIVE = str.maketrans("013457@$!|€", "oieastasiie")
_WORD = re.compile(r"\b(?:[^\W\d_] ){2,}[^\W\d_]\b|[\w@$][\w@$*!|€'’]*[\w@$*|€]|[\w@$]|!{2,}")
_RUN = re.compile(r"(.)\1{2,}")


@lru_cache(maxsize=500_000)
def fold(word: str) -> str:
    """A matched word without case, evasive signs, blanks between letters and drawn-out letters; a masked word is ``*``."""
    if word[0] == "!":
        return "!!"
    w = word.replace(" ", "").lower().rstrip("!|")
    if "*" in w:
        return "*"
    if not w.isalpha():
        letters = any(map(str.isalpha, w))
        if letters and any(c in "013457@$!|€" for c in w):
            w = w.translate(_EVASIVE)
        elif not letters:
            w = "0"
    return _RUN.sub(r"\1", w)


def tokens(text: str) -> tuple[list[str], list[int], list[int]]:
    """Folded tokens with their begins and ends."""
    found = list(_WORD.finditer(text))
    return [fold(m.group()) for m in found], [m.start() for m in found], [m.end() for m in found]


class Coder:
    """Numbers of the given tokens (from 1 on) and pairs of tokens in many texts at once; other tokens are 0."""

    def __init__(self, names: Iterable[str]) -> None:
        names = sorted(names)
        self.singles = sorted({y for x in names for y in x.split(" ")} - {"^"})
        number = {x: i + 1 for i, x in enumerate(self.singles)}
        self.first = len(number) + 1  # what stands before a text's first token
        self.width = self.first + 1
        number["^"] = self.first
        pairs = [x for x in names if " " in x]
        key = np.array([number[a] * self.width + number[b] for a, b in (x.split(" ") for x in pairs)], np.int64)
        order = np.argsort(key)
        self.pairs, self.key = [pairs[i] for i in order], key[order]
        del number["^"]
        self.number, self.seen = number, {}

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all tokens, first token of each text and the end)."""
        words = [_WORD.findall(t) if t else [] for t in texts]
        seen, number = self.seen, self.number
        if len(seen) > 1_000_000:
            seen.clear()
        flat = [w for x in words for w in x]
        for w in flat:
            if w not in seen:
                seen[w] = number.get(fold(w), 0)
        return np.fromiter((seen[w] for w in flat), np.int64, len(flat)), np.r_[0, np.cumsum([len(x) for x in words], dtype=np.int64)]

    def pairs_of(self, ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each token's pair with the one before, whether it has one)."""
        before = np.r_[0, ids[:-1]] if len(ids) else ids
        starts = begin[:-1]
        before[starts[starts < begin[1:]]] = self.first
        if not len(self.key):
            return np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
        key = before * self.width + ids
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return at, (self.key[at] == key) & (before > 0) & (ids > 0)


def features(words: list[str]) -> list[str]:
    """The pair of each token with the one before."""
    return [f"{a} {b}" for a, b in zip(["^", *words], words)]


def maximal_segments(scores: np.ndarray | list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (begin, end, score) in linear time (Ruzzo and Tompa's algorithm)."""
    stack: list[list[float]] = []  # begin, end, total before, total after
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = [i, i + 1, before, total]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j -= 1
            if j < 0 or stack[j][3] >= new[3]:
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
    return [(int(a), int(b), y - x) for a, b, x, y in stack]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    drift: float = DRIFT
    base: float = 0.0  # score from which on the tail of clean documents' best segments is exponential
    share: float = 1.0  # of clean documents beyond it
    scale: float = 1.0
    typical: float = 1.0  # tokens of a clean document
    limit: float = 0.0  # p-value from which on a passage counts

    def scores(self, words: list[str]) -> list[float]:
        w, d = self.weights, self.drift
        return [token_score(u := w.get(a, 0.0), w.get(b, 0.5 * u), d) for a, b in zip(words, features(words))]

    def p_value(self, score: float, length: int) -> float:
        """That the best segment of a clean document of so many tokens reaches the score: the extreme-value law with an
        exponential tail, whose rate grows with the length."""
        if score <= self.base:
            return 1.0
        return -math.expm1(-self.share * max(1.0, length / self.typical) * math.exp(-(score - self.base) / self.scale))

    def passages(self, text: str | None) -> tuple[float, float, list[tuple[int, int, float, float]]]:
        """(best score, its p-value, significant passages as begin, end, score, p-value in code points)."""
        words, begin, end = tokens(text or "")
        segments = maximal_segments(self.scores(words))
        if not segments:
            return 0.0, 1.0, []
        best = max(s for _, _, s in segments)
        out = [(begin[a], end[b - 1], s, p) for a, b, s in segments if (p := self.p_value(s, len(words))) <= self.limit]
        return best, self.p_value(best, len(words)), out


class Scorer:
    """A model's scores of many texts at once."""

    def __init__(self, model: Model) -> None:
        self.model, self.coder = model, Coder(model.weights)
        self.single = np.array([0.0, *(model.weights.get(x, 0.0) for x in self.coder.singles), 0.0])
        self.pair = np.array([model.weights[x] for x in self.coder.pairs])

    def best(self, texts: list[str | None]) -> tuple[list[float], list[int]]:
        """(score of the best segment, number of tokens) of each text."""
        ids, begin = self.coder.encode(texts)
        single = self.single[ids]
        at, has = self.coder.pairs_of(ids, begin)
        pair = np.where(has, self.pair[at], 0.5 * single) if len(self.pair) else 0.5 * single
        scores = (np.clip(single, *BOUNDS) + np.clip(pair, *BOUNDS)) / 2 - self.model.drift
        out = []
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            total = np.cumsum(scores[a:b])
            out.append(max(0.0, float((total - np.minimum.accumulate(np.r_[0.0, total[:-1]])).max())) if b > a else 0.0)
        return out, np.diff(begin).tolist()


def token_score(single: float, pair: float, drift: float) -> float:
    lo, hi = BOUNDS
    return (max(lo, min(hi, single)) + max(lo, min(hi, pair))) / 2 - drift


def sample_features(texts: list[str]) -> set[str]:
    """All features of the labelled texts, for which corpus-wide counts are wanted."""
    out: set[str] = set()
    for t in texts:
        w = tokens(t or "")[0]
        out.update(w)
        out.update(features(w))
    return out


class _Coded:
    """Labelled documents as arrays of feature numbers."""

    def __init__(self, texts: list[str], corpus: dict[str, int]) -> None:
        number: dict[str, int] = {}
        flat: tuple[list[int], list[int]] = ([], [])
        self.size = []
        for t in texts:
            w = tokens(t or "")[0]
            self.size.append(len(w))
            for out, names in zip(flat, (w, features(w)), strict=True):
                out += [number.setdefault(x, len(number)) for x in names]
        self.names = list(number)
        self.uni, self.bi = (np.array(x, np.int64) for x in flat)
        self.doc = np.repeat(np.arange(len(texts)), self.size)
        self.start = np.r_[0, np.cumsum(self.size)].astype(np.int64)
        n = len(number)
        count = np.array([corpus.get(x, 0) for x in self.names], float) if corpus else np.zeros(n)
        own = np.bincount(self.uni, minlength=n) + np.bincount(self.bi, minlength=n)
        self.prior = np.maximum(count, own) if n else count

    def weigh(self, inside: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log-odds of each feature, whether it was seen): tokens ``inside`` against the others, of the documents used."""
        n = len(self.names)
        out, seen = np.zeros(n), np.zeros(n, bool)
        on = used[self.doc]
        for ids in (self.uni, self.bi):
            mine = np.zeros(n, bool)
            mine[ids] = True
            yes = np.bincount(ids[on & inside], minlength=n).astype(float)
            no = np.bincount(ids[on & ~inside], minlength=n).astype(float)
            usual = self.prior * mine / max(1.0, self.prior[mine].sum()) * (yes.sum() + no.sum())  # expected in the sample
            strength = STRENGTH[0] + STRENGTH[1] * usual
            here = mine & (yes + no > 0)
            out[here], seen[here] = np.log((yes + PRIOR * strength) / (no + (1 - PRIOR) * strength))[here], True
        return out, seen

    def scores(self, weights: np.ndarray, seen: np.ndarray, drift: float) -> np.ndarray:
        u = weights[self.uni]
        b = np.where(seen[self.bi], weights[self.bi], 0.5 * u)
        return (np.clip(u, *BOUNDS) + np.clip(b, *BOUNDS)) / 2 - drift

    def segments(self, scores: np.ndarray, docs: np.ndarray) -> dict[int, list[tuple[int, int, float]]]:
        return {int(i): maximal_segments(scores[self.start[i] : self.start[i + 1]].tolist()) for i in docs}


def _train(c: _Coded, flagged: np.ndarray, used: np.ndarray, rounds: int, drift: float) -> tuple[np.ndarray, np.ndarray]:
    inside = flagged[c.doc]
    for _ in range(rounds):
        weights, seen = c.weigh(inside, used)
        inside = np.zeros(len(c.doc), bool)
        for i, found in c.segments(c.scores(weights, seen, drift), np.flatnonzero(flagged & used)).items():
            best = max((s for _, _, s in found), default=0.0)
            for a, b, s in found:
                if s >= 0.3 * best and s > 1.5:
                    inside[c.start[i] + a : c.start[i] + b] = True
    return weights, seen


def fit(texts: list[str], flagged: list[int], corpus: dict[str, int] | None = None, rounds: int = 3, drift: float = DRIFT, folds: int = 2, level: float = 1e-4) -> Model:
    """The model of labelled texts. The first round takes flagged documents as abusive throughout; later rounds only
    their best segments, so that the neutral text around them counts as other text. ``corpus`` has corpus-wide counts of
    the features, the base of the priors. The law of clean documents' best segments and the p-value that parts flagged
    from clean documents best are found on documents left out in turn.

    With no flagged or no clean text the model is empty and finds nothing.
    """
    model = Model(drift=drift)
    y = np.array([bool(f) for f in flagged], bool)
    if not y.any() or y.all():
        return model
    c = _Coded(texts, corpus or {})
    everything = np.ones(len(y), bool)
    weights, seen = _train(c, y, everything, rounds, drift)
    model.weights = {n: round(float(w), 4) for n, w, s in zip(c.names, weights, seen, strict=True) if s}
    best = np.zeros(len(y))
    part = np.arange(len(y)) % folds
    for k in range(folds):
        w, s = _train(c, y, part != k, rounds, drift)
        for i, found in c.segments(c.scores(w, s, drift), np.flatnonzero(part == k)).items():
            best[i] = max((x for _, _, x in found), default=0.0)
    clean = best[~y]
    model.typical = float(max(1.0, np.mean(c.size)))
    model.base = float(np.quantile(clean, 0.8))
    tail = clean[(clean > model.base) & (clean <= np.quantile(clean, 0.99))]  # labels err at times
    model.share = 0.2
    model.scale = float(max(0.5, 1.1 * np.mean(tail - model.base))) if len(tail) else 0.5
    cuts = np.unique(best)
    middle = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
    tp = np.array([(best[y] > m).sum() for m in middle])
    fp = np.array([(best[~y] > m).sum() for m in middle])
    f1 = 2 * tp / (tp + fp + y.sum())
    top = np.flatnonzero(f1 >= f1.max() - 1e-9)
    model.limit = min(level, model.p_value(float((cuts[top[0]] + cuts[top[-1] + 1 if len(cuts) > 1 else 0]) / 2), 1))
    return model


def features_counted(df: DataFrame, text_column: str, wanted: set[str]) -> dict[str, int]:
    """Corpus-wide counts of the wanted features (so many rows come to the driver at most)."""
    coder = Coder(wanted)
    shared = df.sparkSession.sparkContext.broadcast(coder)
    n = len(coder.singles)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        total = np.zeros(n + 1 + len(c.pairs), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                ids, begin = c.encode(whole.slice(at, 2000).column(0).to_pylist())
                place, has = c.pairs_of(ids, begin)
                total[: n + 1] += np.bincount(ids, minlength=n + 1)
                total[n + 1 :] += np.bincount(place[has], minlength=len(c.pairs))
        total[0] = 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["i", "n"])

    rows = spread(df.select(F.col(text_column).cast("string"))).mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    names = ["", *coder.singles, *coder.pairs]
    return {names[i]: k for i, k in zip(rows.column("i").to_pylist(), rows.column("n").to_pylist(), strict=True)}


def fit_tables(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", labelled: int = LABELLED) -> Model:
    """The model of the labelled documents: at most ``labelled`` of them, chosen by a hash of their id.

    A document with several verdicts has the latest decided one; undecided ones count as no label.
    """
    verdict = labels.where("flagged is not null").groupBy(F.col(id_column).alias("k")).agg(F.max_by("flagged", F.struct("reviewed_at", "flagged")).alias("flagged"))
    chosen = verdict.orderBy(F.xxhash64("k"), "k").limit(labelled)  # so many rows at most, so it can be broadcast
    got = documents.select(F.col(id_column).alias("k"), F.col(text_column).cast("string").alias("text")).join(F.broadcast(chosen), "k").groupBy("k").agg(F.min("text").alias("text"), F.max("flagged").alias("flagged")).toArrow()
    rows = sorted(zip(got.column("k").to_pylist(), got.column("text").to_pylist(), got.column("flagged").to_pylist(), strict=True))
    texts, flagged = [r[1] for r in rows], [r[2] for r in rows]
    return fit(texts, flagged, features_counted(documents, text_column, sample_features(texts)) if texts else None)


def score(documents: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, score, p_value, abusive, passages``: the best segment's score and p-value of each document, whether it is
    significant, and all significant passages (begin, end in code points, score, p_value).

    Null, empty and wordless texts have score 0, p-value 1 and no passage. Repeated rows are scored alike; other columns
    are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    narrow = spread(documents.select(F.col(id_column), F.col(text_column).cast("string").alias("text")))
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("p_value", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = Scorer(m)
        for batch in (whole.slice(at, 2000) for whole in batches for at in range(0, whole.num_rows, 2000)):
            texts = batch.column("text").to_pylist()
            got = []
            for t, s, n in zip(texts, *scorer.best(texts), strict=True):
                p = m.p_value(s, n) if s else 1.0
                got.append(m.passages(t) if p <= m.limit else (s, p, []))  # most have no passage, so need no places
            rows = [[{"begin": a, "end": b, "score": s, "p_value": p} for a, b, s, p in g[2]] for g in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64()), pa.array([bool(r) for r in rows], pa.bool_()), pa.array(rows, kind)], names=[id_column, "score", "p_value", "abusive", "passages"])

    return narrow.mapInArrow(run, f"`{id_column}` {narrow.schema[id_column].dataType.simpleString()}, score double, p_value double, abusive boolean, passages array<struct<begin:int,end:int,score:double,p_value:double>>")
