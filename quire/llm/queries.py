"""Queries of the problems solved here, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import table


def body_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs that are no caption, cell or blank; headings are still among them (see headings)."""
    rows = table(spark, folder, "paragraphs").where(~F.coalesce("is_caption", F.lit(False)) & F.col("cell").isNull())
    return rows.where(F.col("text").isNotNull() & F.col("text").rlike(r"[^\s\p{Z}]"))


def headings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "sections").where("heading_para_id IS NOT NULL").select(F.col("heading_para_id").alias("para_id"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    from quire.llm.headings import map_headings
    from quire.llm.wordings import HEADINGS, LABELS

    return map_headings(table(spark, folder, "sections"), table(spark, folder, "heading_catalog"), headings=HEADINGS, labels=LABELS)


def p1_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Values that mean nothing in the list."""
    from quire.llm.headings import unmatched

    return unmatched(p1_found(spark, folder), table(spark, folder, "sections"))


def p2_scored(spark: SparkSession, folder: str) -> DataFrame:
    from quire.llm.works import match_works

    return match_works(table(spark, folder, "reference_entries"), table(spark, folder, "candidate_records"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_scored(spark, folder).select("ref_id", "record_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    from quire.llm.sentences import split_sentences

    return split_sentences(body_paragraphs(spark, folder), headings(spark, folder))


def _lookalikes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    refs = table(spark, folder, "reference_entries").select(F.lit("raw").alias("field_name"), F.col("ref_id").alias("id"), F.col("raw").alias("text"))
    body = body_paragraphs(spark, folder).select(F.lit("text").alias("field_name"), F.col("para_id").alias("id"), "text")
    return refs.unionByName(body), headings(spark, folder).select(F.lit("text").alias("field_name"), F.col("para_id").alias("id"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    from quire.llm.lookalike import same_look

    return same_look(*_lookalikes(spark, folder))


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The same as one row an id: its class and with how many others it makes a case."""
    from quire.llm.lookalike import look_classes

    return look_classes(*_lookalikes(spark, folder))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    from quire.llm.tokens import encode_corpus

    return encode_corpus(table(spark, folder, "documents"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    from quire.llm.leakage import leaks

    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    """Which items leaked, and into how many documents."""
    return p7_found(spark, folder).groupBy("item_id").agg(F.count("*").alias("n_docs"))


def p7_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that follow an item's template with other numbers, names and units in its slots: re-parameterised items."""
    from quire.llm.leakage import leaks

    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"), mode="template")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    from quire.llm.reading import reading_levels

    return reading_levels(table(spark, folder, "documents"), table(spark, folder, "reading_labels"))


QUERIES = {"p1_found": p1_found, "p1_unmatched": p1_unmatched, "p2_found": p2_found, "p2_scored": p2_scored, "p4_found": p4_found, "p5_found": p5_found, "p5_classes": p5_classes, "p6_ids": p6_ids, "p7_found": p7_found, "p7_items": p7_items, "p7_templates": p7_templates, "p8_found": p8_found}
SQL: dict[str, str] = {}
