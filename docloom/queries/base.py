"""Registration: a query is Spark SQL (or a builder) next to the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
Build = Callable[[SparkSession, str], DataFrame]


def views(spark: SparkSession, sf_dir: str, sql: str = "") -> None:
    """Temporary views of the tables that sql names (all, if it is empty)."""
    for t in TABLES:
        if not sql or t in sql:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def sql_query(text: str) -> Build:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, text)
        return spark.sql(text)

    return build


class Registry(dict):
    def sql(self, name: str, spark_text: str, duck_text: str | None = None) -> None:
        """Spark SQL; DuckDB runs the same text unless it needs its own."""
        self[name] = (sql_query(spark_text), duck_text or spark_text)

    def build(self, name: str, duck_text: str | None = None):
        def add(f: Build) -> Build:
            self[name] = (f, duck_text)
            return f

        return add
