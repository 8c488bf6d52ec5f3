"""Queries on personal details in lab notes, comments and issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm import pii
from foliomill.session import table


def texts(spark: SparkSession, d: str) -> DataFrame:
    """field, run_id, issue_id, text: every text of the four fields that isn't null or empty.

    A comment whose key is no number has a null issue_id.
    """
    runs = table(spark, d, "lab_runs").select(
        F.col("id").alias("run_id"),
        F.explode(
            F.concat(
                F.array(F.struct(F.lit("notes").alias("field"), F.lit(0).alias("issue_id"), F.col("notes").alias("text"))),
                F.coalesce(
                    F.transform(F.map_entries("comments"), lambda e: F.struct(F.lit("comments").alias("field"), e["key"].try_cast("int").alias("issue_id"), e["value"].alias("text"))),
                    F.expr("cast(array() as array<struct<field: string, issue_id: int, text: string>>)"),
                ),
            )
        ).alias("x"),
    )
    issues = table(spark, d, "lab_issues").select(
        "run_id",
        F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col("id").cast("int").alias("issue_id"), F.col(c).alias("text")) for c in ("description", "source_evidence")))).alias("x"),
    )
    both = runs.unionByName(issues).select("x.field", "run_id", "x.issue_id", "x.text")
    return both.where("text is not null and text <> ''")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """field, run_id, issue_id, pii_type of every text that holds a detail of the type in any row of its key."""
    rows = texts(spark, d)
    return pii.redact(rows, "text", with_text=False, learnt=pii.learn(rows, "text")).select("field", "run_id", "issue_id", F.explode("types").alias("pii_type")).distinct()


def p5_masked(spark: SparkSession, d: str) -> DataFrame:
    """Every text with its details replaced by placeholders."""
    rows = texts(spark, d)
    return pii.redact(rows, "text", learnt=pii.learn(rows, "text")).select("field", "run_id", "issue_id", "types", "masked")


QUERIES = {"p5_found": p5_found, "p5_masked": p5_masked}
SQL: dict[str, str] = {}
