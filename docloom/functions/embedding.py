"""The default embedder: tokens hashed to DIMS counters, as unit vectors. No model is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import index_tokens

DIMS = 64


def bucket(term: Column, dims: int = DIMS) -> Column:
    return F.pmod(F.conv(F.substring(F.sha1(term), 1, 8), 16, 10).cast("long"), F.lit(dims)).cast("int")


def buckets(rows: DataFrame, keys: list[str], text_col: str, dims: int = DIMS, count: str = "n") -> DataFrame:
    """keys, bucket and the counters over zero."""
    terms = rows.select(*keys, F.explode(index_tokens(F.col(text_col))).alias("term"))
    return terms.select(*keys, bucket(F.col("term"), dims).alias("bucket")).groupBy(*keys, "bucket").agg(F.count("*").alias(count))


def vectors(rows: DataFrame, keys: list[str], text_col: str, dims: int = DIMS, name: str = "embedding") -> DataFrame:
    """keys and a unit vector; rows without tokens have none."""
    counted = buckets(rows, keys, text_col, dims, "_count").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "_count"))).alias("_m"), F.sqrt(F.sum(F.col("_count") * F.col("_count"))).alias("_norm"))
    each = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: (F.coalesce(F.try_element_at("_m", i), F.lit(0)) / F.col("_norm")).cast("float"))
    return counted.select(*keys, each.alias(name))
