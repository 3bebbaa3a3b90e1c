"""An averaged perceptron over string features, trained on a list of examples or on all rows of a table."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletloom.session import cut

#: Rows that one task learns from in a row, and the part of 1 to which weights are rounded where shards are added up.
SHARD, UNIT = 3_000, 1 << 20


class Perceptron:
    """Weights by (label, feature); the average over all steps guards against the order of the examples."""

    def __init__(self, weights: dict[str, dict[str, float]] | None = None) -> None:
        self.weights = weights or {}

    def score(self, label: str, features: Iterable[str]) -> float:
        w = self.weights.get(label)
        return sum(w.get(f, 0.0) for f in features) if w else 0.0

    def best(self, options: list[tuple[str, list[str]]]) -> int:
        """Index of the best (label, features); the first of equals."""
        scores = [self.score(label, f) for label, f in options]
        return max(range(len(scores)), key=lambda i: (scores[i], -i))

    @classmethod
    def train(cls, examples: list[tuple[list[tuple[str, list[str]]], int]], epochs: int = 5, seed: int = 7) -> Perceptron:
        """``examples``: the options of each decision and the index of the right one."""
        w: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        total: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        step, order, rng = 1, list(range(len(examples))), random.Random(seed)
        for _ in range(epochs):
            rng.shuffle(order)
            step = learn(w, total, (examples[k] for k in order), step)
        return cls({label: {f: x - total[label][f] / step for f, x in fs.items() if x or total[label][f]} for label, fs in w.items()})


def learn(w: dict[str, dict[str, float]], total: dict[str, dict[str, float]], examples: Iterable[tuple[list[tuple[str, list[str]]], int]], step: int, changes: Counter | None = None) -> int:
    """One pass over ``examples`` from ``step`` on: changes the weights ``w``, adds the changes times their step to ``total``
    and counts them in ``changes``."""
    for options, right in examples:
        scores = [sum(w[label][f] for f in features) for label, features in options]
        wrong = max((i for i in range(len(options)) if i != right), key=lambda i: scores[i], default=right)
        if wrong != right and scores[wrong] >= scores[right] - 0.5:
            for i, d in ((right, 1.0), (wrong, -1.0)):
                label, features = options[i]
                for f in features:
                    w[label][f] += d
                    total[label][f] += d * step
                if changes is not None:
                    changes.update((label, f) for f in features)
        step += 1
    return step


def in_proportion(counted: list[tuple[tuple[list[tuple[str, list[str]]], int], int]], size: int) -> list[tuple[list[tuple[str, list[str]]], int]]:
    """Different examples with how often they occur in all the data, as about ``size`` examples in the same proportions; each
    of them at least once."""
    total = sum(n for _, n in counted)
    return [x for x, n in counted for _ in range(max(1, round(size * n / total)))]


def fit(rows: DataFrame, key: str, examples: Callable[[pa.RecordBatch], Iterable[tuple[list[tuple[str, list[str]]], int]]], epochs: int = 5, seed: int = 7) -> Perceptron:
    """The averaged perceptron of all ``rows``, of which ``examples`` makes the examples, by iterative parameter mixing
    (McDonald, Hall and Mann 2010): in each epoch every shard of about ``SHARD`` rows is learned from the common weights.
    A weight then moves by the mean of its shards' moves, each counted as often as the shard changed it, so what only one shard
    shows is not thinned out by the others. Shards go by the hash of ``key``, and sums are of whole numbers: the result
    does not depend on the partitions. Only the model comes to the driver.
    """
    shards = max(1, -(-rows.count() // SHARD))
    rows = cut(rows.repartition(shards, key).sortWithinPartitions(key))
    w: dict[str, dict[str, float]] = {}
    mean: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    for epoch in range(epochs):

        def run(batches: Iterator[pa.RecordBatch], start: dict[str, dict[str, float]] = w, epoch: int = epoch) -> Iterator[pa.RecordBatch]:
            every = [x for batch in batches for x in examples(batch)]
            random.Random(seed + epoch).shuffle(every)
            own: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
            total: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
            changes: Counter = Counter()
            for label, fs in start.items():
                own[label].update(fs)
            end = learn(own, total, every, 1, changes)
            out: tuple[list, ...] = ([], [], [], [], [])
            for (label, f), n in changes.items():
                moved = own[label][f] - start.get(label, {}).get(f, 0.0)
                for x, y in zip(out, (label, f, round(moved * UNIT) * n, round((moved - total[label][f] / end) * UNIT) * n, n), strict=True):
                    x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.string(), *[pa.int64()] * 3), strict=True)], names=["label", "feature", "moved", "average", "n"])

        moves = rows.mapInArrow(run, "label string, feature string, moved long, average long, n long").groupBy("label", "feature").agg(*(F.sum(c).alias(c) for c in ("moved", "average", "n"))).collect()
        for label, fs in w.items():
            for f, x in fs.items():
                mean[label][f] += x / epochs
        w = {label: dict(fs) for label, fs in w.items()}
        for r in moves:
            fs = w.setdefault(r["label"], {})
            fs[r["feature"]] = fs.get(r["feature"], 0.0) + r["moved"] / UNIT / r["n"]
            mean[r["label"]][r["feature"]] += r["average"] / UNIT / r["n"] / epochs
    return Perceptron({label: dict(fs) for label, fs in mean.items()})
