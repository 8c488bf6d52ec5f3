"""Queries on the document corpus: token ids, leaked evaluation texts, reading level."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm import encode, leak, reading
from foliomill.session import Shelf, table


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, ids of every document."""
    return encode.encode(table(spark, d, "documents"), "doc_id", "text")


def p7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, n_ids, same: whether the decoded ids give the text back (a null text counts as empty)."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = Shelf(spark, "encode").put(encode.encode(docs, "doc_id", "text"), "ids")
    back = encode.decode(ids, "doc_id", "ids").withColumnRenamed("text", "back")
    return docs.join(back, "doc_id", "left").join(ids, "doc_id", "left").select("doc_id", F.size("ids").alias("n_ids"), (F.col("text") == F.col("back")).alias("same"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, item_id of every document that holds a passage of an evaluation item."""
    return leak.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where the passages lie in the documents."""
    return leak.spans(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Every document without the passages found in it, and how many were cut out."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return leak.without(docs, leak.spans(docs, table(spark, d, "eval_items")))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """item_id, n_docs: how many documents each leaked item is found in."""
    return p8_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n_docs"))


def _levels(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = reading.fit(docs, table(spark, d, "reading_labels"))
    return reading.levels(docs.select("doc_id", "source", "text"), model)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """doc_id of every document of level 4 or 5."""
    return _levels(spark, d).where("level >= 4").select("doc_id")


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    """The level, its parts and the language of every document with running text."""
    return _levels(spark, d).select("doc_id", "text_lang", F.round("formula_level", 3).alias("formula_level"), F.round("evidence", 3).alias("evidence"), "level")


def p9_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents by language and level."""
    return _levels(spark, d).groupBy("text_lang", "level").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (p7_ids, p7_roundtrip, p8_found, p8_spans, p8_cleaned, p8_items, p9_found, p9_levels, p9_profile)}
SQL: dict[str, str] = {}
