"""The pipelines: preprocessing, extraction from publications, retrieval, training data, evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabletloom.functions import features as X
from tabletloom.functions.ocr import correct
from tabletloom.functions.text import normalize
from tabletloom.operators import context, metrics, models, vector
from tabletloom.operators.align import align_corpus
from tabletloom.operators.augment import augment
from tabletloom.operators.dedup import keep_first, near_dedup
from tabletloom.operators.lexicon import query_context, small
from tabletloom.operators.parse import extract_pairs
from tabletloom.session import cut


def frequencies(df: DataFrame, values) -> DataFrame:
    """(term, n) of an array-valued column."""
    return df.select(F.explode(values).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def preprocess(train: DataFrame, aid: DataFrame | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Normalised (and, as white space is folded first, in effect whole) pairs, and the frequency tables of features."""
    clean = train.withColumn("transliteration", normalize("transliteration")).withColumn("translation", F.coalesce("translation", F.lit("")))
    tables = {name: frequencies(clean, f("transliteration")) for name, f in (("proper_nouns", X.proper_nouns), ("sumerograms", X.sumerograms), ("determinatives", X.determinatives))}
    return align_corpus(clean, aid), tables


def extract_publications(publications: DataFrame, existing: DataFrame, allowed: DataFrame | None = None, threshold: float = 0.7) -> DataFrame:
    """(transliteration, translation, source_pdf, source_page, src) of existing and newly extracted pairs: flagged pages,
    each (pdf, page) once, cleaned, parsed, near-duplicates of existing or earlier pairs removed, then normalised.

    Earlier is what comes first by the PDF's first row, page (rows without one last) and segment.
    """
    pages = keep_first(publications.where("has_akkadian"), ["pdf_name", "page"])
    if allowed is not None:
        pages = pages.join(small(allowed.select(F.col("value").alias("pdf_name")).distinct()), "pdf_name", "left_semi")
    pages = pages.withColumn("first", F.min("row_id").over(Window.partitionBy("pdf_name")))
    clean = pages.select(F.struct("first", F.col("page").isNull().alias("no_page"), "page", "row_id").alias("at"), "pdf_name", "page", correct("page_text").alias("page_text"))
    found = extract_pairs(clean, "at", keep=["pdf_name", "page"])
    ordered = found.select(F.struct("at", "segment_no").alias("row_id"), "transliteration", "translation", F.col("pdf_name").alias("source_pdf"), F.col("page").alias("source_page"))
    kept = near_dedup(cut(ordered), "transliteration", existing, threshold)
    new = kept.select(normalize("transliteration").alias("transliteration"), normalize("translation").alias("translation"), "source_pdf", "source_page", F.lit(1).alias("src"))
    return existing.select("transliteration", "translation", F.lit(None).cast("string").alias("source_pdf"), F.lit(None).cast("int").alias("source_page"), F.lit(0).alias("src")).unionByName(new)


def retrieve(queries: DataFrame, index: vector.Index, corpus: DataFrame, embedder: Callable, names: DataFrame | None = None, table: DataFrame | None = None, k: int = 5, nprobe: int = 1) -> DataFrame:
    """(query_id, rank, distance, id, transliteration, translation): the ``k`` nearest corpus rows of each query row.

    Each query's text is first replaced by the entries of its names and Sumerograms, given these tables, then embedded by
    ``embedder`` (see ``models.embed``), searched and looked up; ``corpus`` and the index share their ids. All queries go
    through one plan. ValueError if corpus and index differ in size.
    """
    if corpus.count() != index.rows:
        raise ValueError(f"corpus has {corpus.count()} rows, the index {index.rows}")
    asked = queries.select("row_id", F.col("transliteration").alias("context")) if names is None else query_context(queries, names, table)
    vectors = models.embed(asked, "context", embedder, index.column).select(F.col("row_id").alias(index.id_column), index.column)
    return vector.with_corpus(index.search(vectors, k, nprobe), corpus).select("query_id", "rank", "distance", "id", "transliteration", "translation")


def prepare_training(train: DataFrame, names: DataFrame, table: DataFrame, hits: DataFrame | None = None, factor: int = 1, gap_prob: float = 0.2, budget: int = context.BUDGET) -> DataFrame:
    """(row_id, copy, prompt, target, ids): null texts filled, augmented, each row with its prompt (lexicon, examples, text)
    and the byte ids of both. Without ``factor`` nothing is augmented, as for validation."""
    filled = train.select("row_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("transliteration", "translation")))
    rows = augment(filled, factor=factor, gap_prob=gap_prob).withColumn("_key", F.struct("row_id", "copy"))
    if hits is not None:  # copies ask for the examples of their row
        hits = rows.select("_key", "row_id").join(hits.withColumnRenamed("query_id", "row_id"), "row_id").drop("row_id").withColumnRenamed("_key", "query_id")
    prompts = context.assemble_all(rows, names, table, hits, "_key", budget=budget)
    out = rows.join(prompts, "_key").select("row_id", "copy", "prompt", F.col("translation").alias("target"))
    return out.select("*", models.byte_ids("prompt").alias("ids"), models.byte_ids("target", 256).alias("target_ids"))


def evaluate(df: DataFrame, predictor: Callable, source: str = "transliteration", reference: str = "translation") -> DataFrame:
    """One row of all metrics of a predictor (see ``models.predict``) on the given rows."""
    return metrics.all_metrics(models.predict(df, source, predictor), "prediction", reference, source)
