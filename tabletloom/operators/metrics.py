"""Corpus metrics: BLEU, chrF, their geometric mean, and the share of names that survive."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletloom.functions.features import proper_nouns
from tabletloom.functions.text import SPACE, match_key, text
from tabletloom.operators.flat import flat, mix
from tabletloom.session import spread


def tokens_13a(c: Column) -> Column:
    """The public mteval-13a tokenisation: punctuation apart, full stops and commas beside digits together."""
    # Replacements and patterns of that tokenisation, in its order.
    s = c
    for a, b in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.concat(F.lit(" "), s, F.lit(" "))
    s = F.regexp_replace(s, r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 ")
    s = F.regexp_replace(s, r"([^0-9])([\.,])", "$1 $2 ")
    s = F.regexp_replace(s, r"([\.,])([^0-9])", " $1 $2")
    s = F.regexp_replace(s, r"([0-9])(-)", "$1 $2 ")
    return F.filter(F.split(s, f"{SPACE}+"), lambda x: x != "")


def _grams(codes: np.ndarray, row: np.ndarray, orders: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each order the distinct n-grams (as 64-bit numbers with their row folded in), and how often each occurs."""
    own = mix(row.astype(np.uint64) ^ np.uint64(0xA0761D6478BD642F))
    key = np.zeros(len(codes), np.uint64)
    for n in range(1, orders + 1):
        if n <= len(codes):
            key = mix(key[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n))
        else:
            key = key[:0]
        inside = row[: len(key)] == row[n - 1 : n - 1 + len(key)]
        yield np.unique(key[inside] + own[: len(key)][inside], return_counts=True)


def _overlap(df: DataFrame, hyp: Column, refs: list[Column], orders: int) -> DataFrame:
    """(n, matched, hyp, ref): corpus sums of clipped n-gram counts of each order; n-grams never leave their row."""
    names = ["h", *(f"r{k}" for k in range(len(refs)))]
    rows = df.select(*(c.alias(n) for c, n in zip([hyp, *refs], names, strict=True)))

    def coded(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
        columns = [batch.column(n) for n in names]
        if not pa.types.is_list(columns[0].type):
            return [(cp.astype(np.uint64), row) for cp, row in (flat(c.to_pylist()) for c in columns)]
        numbers = pa.concat_arrays([c.flatten() for c in columns]).dictionary_encode().indices
        out, at = [], 0
        for c in columns:
            size = np.asarray(pa.compute.list_value_length(c)).astype(np.int64)
            n = int(size.sum())
            out.append((np.asarray(numbers[at : at + n]).astype(np.uint64), np.repeat(np.arange(len(size)), size)))
            at += n
        return out

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, orders), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                sides = [_grams(*x, orders) for x in coded(whole.slice(at, 1000))]
                for n, ((h, ch), *others) in enumerate(zip(*sides, strict=True)):
                    most = np.zeros(len(h), np.int64)
                    for r, cr in others:
                        k = np.minimum(np.searchsorted(h, r), max(0, len(h) - 1))
                        same = h[k] == r if len(h) else np.zeros(len(r), bool)
                        most[k[same]] = np.maximum(most[k[same]], cr[same])
                    total[:, n] += (np.minimum(ch, most).sum(), ch.sum(), others[0][1].sum())
        yield pa.RecordBatch.from_arrays([pa.array(range(1, orders + 1), pa.int32()), *map(pa.array, total)], names=["n", "matched", "hyp", "ref"])

    counts = spread(rows).mapInArrow(count, "n int, matched long, hyp long, ref long")
    return counts.groupBy("n").agg(F.sum("matched").alias("matched"), F.sum("hyp").alias("hyp"), F.sum("ref").alias("ref"))


def _closest(h: Column, lengths: list[Column]) -> Column:
    """The reference length nearest to the hypothesis length, the shorter of equally near ones."""
    return F.array_min(F.transform(F.array(*lengths), lambda x: F.struct(F.abs(x - h).alias("d"), x.alias("x"))))["x"]


def bleu(df: DataFrame, hypothesis: str, references: list[str]) -> DataFrame:
    """One row (bleu, p1..p4, bp, hyp_len, ref_len): 4-gram corpus BLEU with exponential smoothing, in percent."""
    h, refs = tokens_13a(text(hypothesis)), [tokens_13a(text(r)) for r in references]
    lengths = df.select(F.size(h).alias("h"), F.array(*(F.size(r) for r in refs)).alias("r")).select("h", _closest(F.col("h"), [F.col("r")[k] for k in range(len(refs))]).alias("r"))
    size = lengths.agg(F.coalesce(F.sum("h"), F.lit(0)).alias("hyp_len"), F.coalesce(F.sum("r"), F.lit(0)).alias("ref_len"))
    sums = _overlap(df, h, refs, 4).groupBy().agg(*(F.coalesce(F.max(F.when(F.col("n") == n, F.col(c))), F.lit(0)).alias(f"{c}{n}") for n in range(1, 5) for c in ("matched", "hyp")))
    one = size.join(sums)  # of one row each
    p, zeros = [], F.lit(0)
    for n in range(1, 5):
        m, t = F.col(f"matched{n}"), F.col(f"hyp{n}")
        zeros = F.when((m == 0) & (t > 0), zeros + 1).otherwise(zeros)
        p.append(F.when(t == 0, F.lit(0.0)).when(m == 0, F.lit(100.0) / (F.pow(F.lit(2.0), zeros) * t)).otherwise(100.0 * m / t))
    bp = F.when(F.col("hyp_len") == 0, 0.0).when(F.col("hyp_len") < F.col("ref_len"), F.exp(1 - F.col("ref_len") / F.col("hyp_len"))).otherwise(1.0)
    none = reduce(lambda a, b: a & b, (F.col(f"matched{n}") == 0 for n in range(1, 5)))
    empty = reduce(lambda a, b: a | b, (F.col(f"hyp{n}") == 0 for n in range(1, 5)))
    score = F.when(none | empty, 0.0).otherwise(bp * F.exp(reduce(lambda a, b: a + b, (F.log(x) for x in p)) / 4))
    return one.select(F.round(score, 6).alias("bleu"), *(F.round(x, 6).alias(f"p{k + 1}") for k, x in enumerate(p)), F.round(bp, 6).alias("bp"), "hyp_len", "ref_len")


def chrf(df: DataFrame, hypothesis: str, reference: str, order: int = 6, beta: float = 2.0) -> DataFrame:
    """One row (chrf): character n-gram F-score in percent, white space left out."""
    chars = lambda c: F.regexp_replace(text(c), SPACE, "")
    sums = _overlap(df, chars(hypothesis), [chars(reference)], order).where("hyp > 0 and ref > 0")
    avg = sums.agg(F.avg(F.col("matched") / F.col("hyp")).alias("p"), F.avg(F.col("matched") / F.col("ref")).alias("r"))
    b = beta * beta
    f = F.when((F.col("p") + F.col("r")) > 0, (1 + b) * F.col("p") * F.col("r") / (b * F.col("p") + F.col("r"))).otherwise(0.0)
    return avg.select(F.round(100 * F.coalesce(f, F.lit(0.0)), 6).alias("chrf"))


def geometric_mean(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.sqrt(a * b)).otherwise(0.0)


def name_accuracy(df: DataFrame, source: str, hypothesis: str, reference: str) -> DataFrame:
    """One row: the share of the sources' names whose key is within the hypothesis' key, the same of the reference, counts."""
    rows = df.select(F.explode(proper_nouns(source)).alias("name"), match_key(hypothesis).alias("h"), match_key(reference).alias("r"))
    key = match_key(F.col("name"))
    s = rows.agg(F.count("*").alias("total_proper_nouns"), F.count_if(F.contains(F.col("h"), key)).alias("correct_in_hypothesis"), F.count_if(F.contains(F.col("r"), key)).alias("correct_in_reference"))
    share = lambda c: F.when(F.col("total_proper_nouns") > 0, F.round(F.col(c) / F.col("total_proper_nouns"), 6)).otherwise(0.0)
    return s.select(share("correct_in_hypothesis").alias("proper_noun_accuracy"), share("correct_in_reference").alias("proper_noun_recall_ref"), "*")


def all_metrics(df: DataFrame, hypothesis: str, reference: str, source: str | None = None) -> DataFrame:
    """One row of BLEU, chrF, their geometric mean and, given sources, the name metrics."""
    out = bleu(df, hypothesis, [reference]).join(chrf(df, hypothesis, reference))  # of one row each
    out = out.withColumn("geometric_mean", F.round(geometric_mean(F.col("bleu"), F.col("chrf")), 6))
    return out.join(name_accuracy(df, source, hypothesis, reference)) if source else out
