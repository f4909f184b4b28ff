"""Sharding by extendible hashing: a directory of hash prefixes in which only oversized buckets are split on another bit.

Row sizes are summed by prefix at the depth that the total asks for; the few buckets that are still too
large go on, HOP bits at a time, until each fits the byte limit or cannot be divided (all its rows have one
hash, or MAX_BITS are used). A bucket's depth is the least at which its bytes fit, whatever its neighbours
need. Only sums by prefix are aggregated, with partial sums before the shuffle; texts are not moved.

Null text has 0 bytes. Null ids have a hash of their own; rows with one id share a shard, however large,
and such a shard is marked by fits = false. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import materialize

LIMIT = 16 << 20
MAX_BITS = 48
HOP = 4


def id_hash(key: Column) -> Column:
    """48 bits of the MD5 of a key."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("(null)"))), 1, MAX_BITS // 4), 16, 10).cast("long")


def prefix(h: str, bits: int) -> Column:
    return F.shiftright(F.col(h), MAX_BITS - bits)


def directory(sized: DataFrame, limit: int) -> DataFrame:
    """Leaves of the directory over rows (_h, _bytes): depth, bucket (the prefix), shard_bytes, shard_docs, fits."""
    total = sized.agg(F.sum("_bytes")).first()[0] or 0
    low, high = 0, min(MAX_BITS, max(1, math.ceil(math.log2(max(1, total / limit))) + 2))
    leaves, left = None, sized
    while True:
        cells = left.groupBy(prefix("_h", high).alias("_p")).agg(F.sum("_bytes").alias("_b"), F.count("*").alias("_n"), F.min("_h").alias("_lo"), F.max("_h").alias("_hi"))
        each = cells.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
        node = each.groupBy("depth", F.expr(f"shiftright(_p, {high} - depth)").alias("bucket")).agg(
            F.sum("_b").alias("shard_bytes"), F.sum("_n").alias("shard_docs"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")
        )
        node = node.withColumn("fits", F.col("shard_bytes") <= limit).withColumn("_end", F.col("fits") | (F.col("_lo") == F.col("_hi")) | (F.col("depth") == MAX_BITS))
        node = materialize(node, "nodes")
        ends = node.where("_end").select("depth", "bucket", "shard_bytes", "shard_docs", "fits")
        up = node.where("NOT _end").select((F.col("depth") + 1).alias("_d"), F.col("bucket").alias("_b"))
        # a leaf is an end whose parent is none; the first round's root has no parent
        top = F.col("depth") == low
        own = ends.join(up, (ends["depth"] == up["_d"]) & (F.shiftright(ends["bucket"], 1) == up["_b"]), "left_semi")
        own = own if low else own.unionByName(ends.where(top))
        leaves = own if leaves is None else leaves.unionByName(own)
        more = node.where(f"depth = {high} AND NOT _end").select(F.col("bucket").alias("_big"))
        if high >= MAX_BITS or more.isEmpty():
            return materialize(leaves, "leaves")
        left = materialize(left.join(more, prefix("_h", high) == F.col("_big"), "left_semi"), "oversized")
        low, high = high, min(MAX_BITS, high + HOP)


def shard(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_bytes, shard_id (the prefix as bits), depth, shard_bytes, shard_docs, fits."""
    sized = docs.select(F.col(id_col), id_hash(F.col(id_col)).alias("_h"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("_bytes"))
    sized = materialize(sized, "sized")
    leaves = directory(sized.select("_h", "_bytes"), limit)
    depths = sorted(r[0] for r in leaves.select("depth").distinct().collect())  # at most MAX_BITS numbers
    probe = sized.withColumn("_at", F.explode(F.array(*[F.struct(F.lit(d).alias("d"), prefix("_h", d).alias("b")) for d in depths])) if depths else F.struct(F.lit(0).alias("d"), F.lit(0).cast("long").alias("b")))
    found = probe.join(leaves, (F.col("_at.d") == F.col("depth")) & (F.col("_at.b") == F.col("bucket")))
    bits = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(bucket), depth, '0')"))
    return found.select(id_col, F.col("_bytes").alias("n_bytes"), bits.alias("shard_id"), F.col("depth").cast("long").alias("depth"), "shard_bytes", "shard_docs", "fits")


def oracle(limit: int = LIMIT) -> str:
    """DuckDB SQL over documents; it looks at all depths for all rows."""
    return f"""
WITH t AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(doc_id::VARCHAR, '(null)')), 1, {MAX_BITS // 4}) AS BIGINT) AS h, coalesce(octet_length(encode(text)), 0) AS n_bytes FROM documents),
n AS (SELECT d.depth, t.h >> ({MAX_BITS} - d.depth) AS bucket, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs, min(h) = max(h) AS one
  FROM t, (SELECT unnest(range(0, {MAX_BITS + 1})) AS depth) d GROUP BY ALL),
e AS (SELECT * FROM n WHERE shard_bytes <= {limit} OR one OR depth = {MAX_BITS}),
f AS (SELECT t.doc_id, t.n_bytes, t.h, min(e.depth) AS depth FROM t JOIN e ON t.h >> ({MAX_BITS} - e.depth) = e.bucket GROUP BY ALL)
SELECT f.doc_id, f.n_bytes, CASE WHEN f.depth = 0 THEN '' ELSE right(lpad(bin(e.bucket), {MAX_BITS}, '0'), f.depth::INT) END AS shard_id,
  f.depth::BIGINT AS depth, e.shard_bytes, e.shard_docs, e.shard_bytes <= {limit} AS fits
FROM f JOIN e ON e.depth = f.depth AND e.bucket = f.h >> ({MAX_BITS} - f.depth)
"""
