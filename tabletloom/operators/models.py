"""Hooks for models: embedders and predictors are given by the caller and run over Arrow batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any, TypeVar

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletloom.functions.text import text
from tabletloom.operators.flat import flat, mix, trigrams

R = TypeVar("R")
#: Ids of a byte tokenizer: bytes are shifted by three, the end is 1.
SHIFT, END = 3, 1


def embed(df: DataFrame, column: str, make: Callable[[], Callable[[list[str]], list[list[float]]]], out: str = "embedding", batch: int = 32) -> DataFrame:
    """``df`` with the vector of each text; ``make`` loads the model once a task. Null counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            texts = pdf[column].fillna("").tolist()
            vectors = [v for i in range(0, len(texts), batch) for v in model(texts[i : i + batch])]
            yield pdf.assign(**{out: vectors})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != out)
    return df.drop(out).mapInPandas(run, f"{fields}, `{out}` array<float>")


def hashed_vectors(texts: list[str], dimension: int = 64) -> list[list[float]]:
    """An embedder without a model: character trigrams hashed to signed places, of length 1. Equal texts are at distance 0."""
    code, row = trigrams(*flat([t.lower() for t in texts]))
    h = mix(code)
    out = np.zeros((len(texts), dimension))
    np.add.at(out, (row, (h % np.uint64(dimension)).astype(np.int64)), np.where(h >> np.uint64(63) > 0, 1.0, -1.0))
    return (out / np.maximum(np.sqrt((out**2).sum(axis=1, keepdims=True)), 1e-9)).tolist()


def predict(df: DataFrame, column: str, make: Callable[[], Callable[[list[str]], list[str]]], out: str = "prediction", batch: int = 8) -> DataFrame:
    """``df`` with the prediction for each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            texts = pdf[column].fillna("").tolist()
            yield pdf.assign(**{out: [v for i in range(0, len(texts), batch) for v in model(texts[i : i + batch])]})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != out)
    return df.drop(out).mapInPandas(run, f"{fields}, `{out}` string")


def byte_ids(column: str, limit: int = 512):  # noqa: ANN201
    """UTF-8 bytes as ids, cut to ``limit`` with the end mark."""
    raw = F.encode(text(column), "UTF-8")
    n = F.least(F.octet_length(raw), F.lit(limit - 1))
    one = lambda i: F.ascii(F.decode(F.substring(raw, i, F.lit(1)), "ISO-8859-1"))
    every = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: one(i) + SHIFT)
    return F.concat(F.when(n > 0, every).otherwise(F.array().cast("array<int>")), F.array(F.lit(END)))


def retry(call: Callable[[], R], tries: int = 3, wait: float = 5.0, sleep: Callable[[float], Any] = time.sleep) -> R:
    """The result of ``call``, tried again after 1, 2, 4 ... times ``wait`` seconds."""
    for k in range(tries):
        try:
            return call()
        except Exception:
            if k == tries - 1:
                raise
            sleep(wait * 2**k)
    raise ValueError("tries must be at least 1")
