"""Queries of the training-data operators, by name: (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletloom.session import ship


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    from tabletloom.llm.look import same_look_pairs

    return same_look_pairs({"train": (_read(spark, folder, "train"), "transliteration"), "oa_lexicon_ebl": (_read(spark, folder, "oa_lexicon_ebl"), "form")})


def p1_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent text of every row of both fields: (tbl, row_id, consistent)."""
    from tabletloom.llm.look import with_consistent

    fields = [_read(spark, folder, t).select(F.lit(t).alias("tbl"), "row_id", F.col(c).alias("text")) for t, c in (("train", "transliteration"), ("oa_lexicon_ebl", "form"))]
    return with_consistent(fields[0].unionByName(fields[1]), "text", "consistent").select("tbl", "row_id", "consistent")


def _canonical(spark: SparkSession, folder: str) -> DataFrame:
    from tabletloom.llm.canonical import keyed_names, map_fields

    named = _read(spark, folder, "oa_lexicon_ebl").where("type in ('PN', 'GN')")
    canon = _read(spark, folder, "canon_names")
    fields = {"train.transliteration": keyed_names(_read(spark, folder, "train"), "transliteration", "row_id", inside=True)}
    fields |= {f"oa_lexicon_ebl.{c}": keyed_names(named, c, "row_id", inside=False) for c in ("form", "norm")}
    return map_fields(fields, canon.select("ref_id", "form").union(canon.select("ref_id", "norm")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _canonical(spark, folder)


def p2_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Per field: rows with names, and rows with an unmatched one."""
    return _canonical(spark, folder).groupBy("field").agg(F.countDistinct("row_id").alias("n_rows"), F.countDistinct(F.when(F.col("ref_id") < 0, F.col("row_id"))).alias("unmatched"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    from tabletloom.llm.near_duplicates import near_duplicate_pairs

    return near_duplicate_pairs({n: _read(spark, folder, n) for n in ("extracted_pairs", "train_sentences")}, "transliteration")


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    from tabletloom.llm.near_duplicates import near_duplicate_groups

    return near_duplicate_groups({n: _read(spark, folder, n) for n in ("extracted_pairs", "train_sentences")}, "transliteration")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    from tabletloom.llm.ocr_repair import defects

    return defects(_read(spark, folder, "publications")).select("row_id", "line_no", "defect").distinct()


def p4_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    from tabletloom.llm.ocr_repair import paragraphs

    return paragraphs(_read(spark, folder, "publications"))


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    from tabletloom.llm.chunks import split_texts

    return split_texts(_read(spark, folder, "train"), {"transliteration": 1000, "translation": 2000}, overlap=100)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The texts that came out in more than one piece."""
    return p5_pieces(spark, folder).where("piece_no = 2").select("row_id", "field")


def p5_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """The texts put together again from their pieces: those that were cut, each piece without its overlap."""
    pieces = p5_pieces(spark, folder).where("pieces > 1").withColumn("end", F.col("begin") + F.col("n_chars"))
    rest = F.expr("substring(piece, int(greatest(coalesce(lag(end) over (partition by row_id, field order by piece_no), 0) - begin, 0)) + 1)")
    parts = pieces.select("row_id", "field", F.struct("piece_no", rest.alias("rest")).alias("p"), "n_chars")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["rest"]), "")
    return parts.groupBy("row_id", "field").agg(whole.alias("text"), (F.max("n_chars") <= F.when(F.col("field") == "translation", 2000).otherwise(1000)).alias("within"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    from tabletloom.llm.split_overlap import overlaps

    found = overlaps(_read(spark, folder, "combined_corpus"))
    return found.select(F.least("train_id", "other_id").alias("row_id_a"), F.greatest("train_id", "other_id").alias("row_id_b")).distinct()


def p6_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Per split, source and side: records of the split, and those that reappear in train."""
    from tabletloom.llm.split_overlap import overlap_counts

    return overlap_counts(_read(spark, folder, "combined_corpus"))


def p6_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Of each record outside train that shares a span with training records: the share of it in such spans."""
    from tabletloom.llm.split_overlap import overlap_coverage

    return overlap_coverage(_read(spark, folder, "combined_corpus"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    from tabletloom.llm.bitext import align

    return align(_read(spark, folder, "train")).select("row_id", "src_no", "tgt_no").distinct()


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    from tabletloom.llm.tokens import encode_column

    return encode_column(_read(spark, folder, "documents"), "doc_id", "text")


def p8_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """The texts that the ids stand for."""
    from tabletloom.llm.tokens import decode_column

    return decode_column(p8_ids(spark, folder), "doc_id", "ids")


def p9_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Where each document, or each piece of one longer than 2,048 tokens, is."""
    from tabletloom.llm.packing import pack
    from tabletloom.llm.tokens import encode_column

    documents = _read(spark, folder, "documents")
    return pack(encode_column(documents, "doc_id", "text", count_only=True), documents.count(), 2048)


def p9_fill(spark: SparkSession, folder: str) -> DataFrame:
    """The number of containers, the tokens in them and the share of space that stays unused."""
    used = p9_packed(spark, folder).where("container is not null").groupBy("container").agg(F.sum("size").alias("used"))
    return used.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), F.round(1 - F.avg("used") / 2048, 6).alias("unused"))


def p9_checked(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, containers that hold more than fits, and documents that are not placed from end to end."""
    packed = p9_packed(spark, folder)
    full = packed.where("container is not null").groupBy("container").agg(F.sum("size").alias("used")).agg(F.count_if(F.col("used") > 2048).alias("overfull"))
    before = F.expr("coalesce(lag(begin + size) over (partition by doc_id order by piece_no), 0)")
    placed = packed.withColumn("gap", before != F.col("begin")).groupBy("doc_id").agg(F.max("gap").alias("gap"), F.countDistinct("container").alias("n"), F.count("*").alias("pieces"))
    return placed.agg(F.count("*").alias("documents"), F.count_if("gap").alias("gaps"), F.count_if((F.col("n") != F.col("pieces")) & (F.col("n") > 0)).alias("shared")).join(full)


def _abuse(spark: SparkSession, folder: str) -> DataFrame:
    from tabletloom.llm.abuse import fit_tables, score

    documents = _read(spark, folder, "documents")
    return score(documents, fit_tables(documents, _read(spark, folder, "review_labels")))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return _abuse(spark, folder).where("abusive").select("doc_id")


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _abuse(spark, folder)


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Per source: documents, those with a significant passage, and their share. Null sources count as one source."""
    found = _abuse(spark, folder).select("doc_id", "abusive")
    rows = _read(spark, folder, "documents").select("doc_id", "source").join(found, "doc_id")
    return rows.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("abusive").alias("abusive"), F.avg(F.col("abusive").cast("int")).alias("rate"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_texts, p2_found, p2_unmatched, p3_found, p3_groups, p4_found, p4_paragraphs, p5_found, p5_pieces, p5_rebuilt, p6_found, p6_counts, p6_coverage, p7_found, p8_ids, p8_decoded, p9_packed, p9_fill, p9_checked, p10_found, p10_scores, p10_rates)}
