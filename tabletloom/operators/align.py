"""Documents to sentence pairs, by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletloom.functions.text import source_sentences, target_sentences

LENGTH_RATIO = 3.0


def valid_pair(src: Column, tgt: Column, ratio: float = LENGTH_RATIO) -> Column:
    """Both of 3 or more characters, and the source at most ``ratio`` times as long."""
    return (F.length(src) >= 3) & (F.length(tgt) >= 3) & (F.length(src) / F.greatest(F.length(tgt), F.lit(1)) <= ratio)


def align_corpus(df: DataFrame, aid: DataFrame | None = None, key: str = "oare_id", source: str = "transliteration", target: str = "translation") -> DataFrame:
    """One row per sentence pair, with ``pair_no`` from 0; a document passes whole where it has no aid, where the numbers
    of lines and sentences differ, or where no pair is valid. Only the presence of an id in ``aid`` matters."""
    if aid is None:
        return df.withColumn("pair_no", F.lit(0))
    known = aid.select(F.col(key)).where(F.col(key).isNotNull()).distinct().withColumn("_aided", F.lit(True))
    src, tgt = source_sentences(source), target_sentences(target)
    whole = F.array(F.struct(F.col(source).alias("s"), F.col(target).alias("t")))
    pairs = F.filter(F.transform(F.arrays_zip(src.alias("s"), tgt.alias("t")), lambda p: F.struct(p["s"].alias("s"), p["t"].alias("t"))), lambda p: valid_pair(p["s"], p["t"]))
    chosen = F.when(F.col("_aided") & (F.size(src) == F.size(tgt)), F.when(F.size(pairs) > 0, pairs).otherwise(whole)).otherwise(whole)
    rest = [c for c in df.columns if c not in (source, target)]
    return df.join(known, key, "left").select(*rest, F.posexplode(chosen).alias("pair_no", "p")).select(*rest, "pair_no", F.col("p.s").alias(source), F.col("p.t").alias(target))
