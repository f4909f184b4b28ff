"""Exact deduplication that no hot digest can slow down (DataFrame operations only).

1. Rows combine where they are read, then meet in salted digest groups: grouping keys are
   (digest, salt, whole normalised text), so Spark's partial aggregation combines copies before the
   shuffle, and a text that a third of all rows share is spread over as many groups as there are salts.
2. Salt winners combine by (digest, whole text): at most one for each salt of a text.
3. Each row finds its group by (digest, salt), again spread over the salts. Where the whole texts of 1 and 2 have
   shown that a digest has one text, the digest names the group; rows of a digest with several texts find theirs
   by (digest, whole text).

So content decides at every stage, and equal digests of different texts stay apart.

Null text counts as empty. Null ids are largest, so they stay only when a group has no other id; a
repeated row counts as often as it occurs and each of its rows carries kept if its id is kept. Rows with one id
share a salt; copies among them have combined before the first shuffle. Texts of any length are whole: one row's
text must fit a row. An empty table gives an empty result. Other columns are not read by `groups`; `keep_first`
returns them unchanged, whatever their names. It needs no stage 3: a row stays if its id and digest are those of a
winner of 2, so whole rows are shuffled once, beside a hash table of winners, and are not sorted. Only rows whose ids
repeat are shuffled again, as of those with one text one stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import materialize

#: Salts, at least: as many as there are shuffle partitions, so that a hot text can keep all tasks busy.
SALTS = 32


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _keyed(docs: DataFrame, id_col: str, text_col: str, salts: int, digest: Callable[[Column], Column]) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_norm")).select(
        "_id", "_norm", digest(F.col("_norm")).alias("_digest"), F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int").alias("_salt")
    )


def _salted(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("_digest", "_salt", "_norm").agg(F.min("_id").alias("_min"), F.count("*").alias("_n"))


def _n_salts(docs: DataFrame) -> int:
    return max(SALTS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256."""
    salts = salts or _n_salts(docs)
    keyed = _keyed(docs, id_col, text_col, salts, digest)
    merged = _salted(keyed).groupBy("_digest", "_norm").agg(F.min("_min").alias("keep_id"), F.sum("_n").alias("group_size"), F.collect_set("_salt").alias("_salts"))
    sha = {} if digest is sha256 else {"_sha": sha256(F.col("_norm"))}
    winners = materialize(merged.withColumns(sha).drop("_norm"), "exact")
    clash = materialize(winners.groupBy("_digest").agg(F.count("*").alias("_texts")).where("_texts > 1").select("_digest"), "clashes")
    by_salt = winners.select("_digest", F.explode("_salts").alias("_salt"), "keep_id", "group_size", *sha)
    rows = keyed.select("_id", "_digest", "_salt")
    several = not clash.isEmpty()
    if several:
        rows, by_salt = rows.join(clash, "_digest", "left_anti"), by_salt.join(clash, "_digest", "left_anti")
    shown = "_id", "keep_id", "group_size", *([F.col("_digest").alias("_sha")] if digest is sha256 else ["_sha"])
    found = rows.join(by_salt, ["_digest", "_salt"]).select(*shown)
    if several:  # told apart by their texts
        apart = keyed.join(clash, "_digest", "left_semi").select("_id", "_digest", "_norm")
        whole = apart.groupBy("_digest", "_norm").agg(F.min("_id").alias("keep_id"), F.count("*").alias("group_size"))
        found = found.unionByName(apart.join(whole, ["_digest", "_norm"]).withColumn("_sha", sha256(F.col("_norm"))).select("_id", "keep_id", "group_size", "_sha"))
    return found.select(
        F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256")
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None) -> DataFrame:
    """The rows of docs that stay, one of each group, with all columns. Rows with a kept id repeated within a group leave one."""
    keyed = _keyed(docs, id_col, text_col, salts or _n_salts(docs), sha256)
    kept = materialize(_salted(keyed).groupBy("_digest", "_norm").agg(F.min("_min").alias("id")).select("id", F.col("_digest").alias("sha")), "kept")
    ids = docs.select(F.col(id_col).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    repeated = materialize(ids.where("n > 1").select("id"), "repeated")
    # a row travels whole beside its key, so that no column of it can clash
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), sha256(normalised(F.col(text_col))).alias("sha"))

    def hit(kept: DataFrame) -> DataFrame:  # an equality that holds for nulls adds no filter, which would make the digests a second time
        return rows.join(kept.hint("shuffle_hash"), rows["id"].eqNullSafe(kept["id"]) & rows["sha"].eqNullSafe(kept["sha"]), "left_semi")

    if repeated.isEmpty():
        return hit(kept).select("row.*")
    again = kept["id"].eqNullSafe(repeated["id"])
    once, several = hit(kept.join(repeated, again, "left_anti")), hit(kept.join(repeated, again, "left_semi"))
    return once.unionByName(several.dropDuplicates(["id", "sha"])).select("row.*")


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
