"""Scoring of answers against a gold set, and its report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score(gold: DataFrame, answers: DataFrame) -> DataFrame:
    """gold (q, kind, expect_any, expect_refuse) with answers (q, answer, refused, confidence, seconds): q, kind, ok, confidence, seconds.

    An item is right if it is refused as expected, or if the answer has one of the wanted strings; a missing answer is wrong.
    """
    x = gold.join(answers, "q", "left")
    hit = F.exists("expect_any", lambda e: F.contains(F.lower("answer"), F.lower(e)))
    ok = F.when(F.col("expect_refuse"), F.col("refused")).otherwise(hit & ~F.col("refused"))
    return x.select("q", "kind", F.coalesce(ok, F.lit(False)).alias("ok"), "confidence", "seconds")


def report(results: DataFrame) -> DataFrame:
    """kind, passed, n, confidence (mean), median_seconds."""
    passed = F.sum(F.col("ok").cast("int")).alias("passed")
    return results.groupBy("kind").agg(passed, F.count("*").alias("n"), F.round(F.avg(F.col("confidence").cast("double")), 4).alias("confidence"), F.median(F.col("seconds").cast("double")).alias("median_seconds"))


def markdown(results: DataFrame) -> str:
    """report as a Markdown table; one row for each kind of question."""
    rows = report(results).orderBy("kind").collect()
    return "\n".join(["| kind | passed | confidence | median s |", "|-|-|-|-|", *(f"| {r.kind} | {r.passed}/{r.n} | {r.confidence} | {r.median_seconds} |" for r in rows)])
