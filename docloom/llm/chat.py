"""Multi-party perspective rotation for chat data (DataFrame operations only).

For every participant of a dialogue (each distinct role but `system`), the dialogue is rendered with that
speaker as the assistant and all others as users who carry their names; a mask tells which characters the
model is trained on: the assistant's words and the end mark after them.

Dialogues are dealt in segments of SEGMENT turn numbers, rendered one by one, so no row or task holds more
than that many turns of a dialogue of any length; the segments of a perspective in order make its whole
text. A segment's spans count from its own start.

Null or blank roles are the speaker 'unknown'; null texts are empty; a null conv_id is a dialogue of its
own; a null turn is turn 0. Turns with the same number follow in the order of role and text, repeated ones
included. A dialogue with only system turns has no participant, so it gives no row. Other columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """One row per dialogue, participant and segment: conv_id, perspective, segment, n_turns, n_assistant, rendered, spans."""
    t = turns.select(
        F.col(conv).alias("conv_id"),
        F.coalesce(F.col(turn), F.lit(0)).cast("long").alias("turn"),
        F.when(F.trim(F.coalesce(F.col(role), F.lit(""))) == "", "unknown").otherwise(F.trim(F.col(role))).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).withColumn("segment", F.floor(F.col("turn") / segment).cast("long"))
    parts = t.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_turns"))
    who = t.where("role <> 'system'").groupBy("conv_id", "role").agg(F.lit(1).alias("_one")).select(F.col("conv_id").alias("_conv"), F.col("role").alias("perspective"))
    both = parts.join(who, parts["conv_id"].eqNullSafe(who["_conv"])).drop("_conv")

    def message(x):
        own = x["role"] == F.col("perspective")
        head = F.when(own, F.lit(f"{OPEN}assistant\n")).when(x["role"] == "system", F.lit(f"{OPEN}system\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), x["role"], F.lit("\n")))
        return F.struct(own.alias("own"), F.concat(head, x["text"], F.lit(CLOSE)).alias("line"), F.length(head).cast("long").alias("head"))

    out = both.withColumn("_msg", F.transform("_turns", message))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def add(acc, m):
        end = acc["at"] + F.length(m["line"])
        span = F.struct((acc["at"] + m["head"]).alias("start"), (end - 1).alias("end"))
        return F.struct(end.alias("at"), F.when(m["own"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return out.select(
        "conv_id", "perspective", "segment",
        F.size("_msg").cast("long").alias("n_turns"),
        F.size(F.filter("_msg", lambda m: m["own"])).cast("long").alias("n_assistant"),
        F.array_join(F.transform("_msg", lambda m: m["line"]), "").alias("rendered"),
        F.aggregate("_msg", start, add)["spans"].alias("spans"),
    )


def query(turns: DataFrame) -> DataFrame:
    """rotate with the spans as text: start-end, separated by commas."""
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return rotate(turns).withColumn("spans", spans)


ORACLE = rf"""
WITH t AS (SELECT conv_id, coalesce(turn, 0) AS turn, CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown' ELSE trim(role) END AS role, coalesce(text, '') AS text FROM conversations),
who AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
m AS (SELECT t.conv_id, w.perspective, floor(t.turn / {SEGMENT}.0)::BIGINT AS segment, t.turn, t.role, t.text, t.role = w.perspective AS own,
  CASE WHEN t.role = w.perspective THEN '{OPEN}assistant' WHEN t.role = 'system' THEN '{OPEN}system' ELSE '{OPEN}user name=' || t.role END || chr(10) AS head
  FROM t JOIN who w ON t.conv_id IS NOT DISTINCT FROM w.conv_id),
l AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS line FROM m),
o AS (SELECT *, sum(length(line)) OVER (PARTITION BY conv_id, perspective, segment ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop FROM l)
SELECT conv_id, perspective, segment, count(*) AS n_turns, count(*) FILTER (own) AS n_assistant, string_agg(line, '' ORDER BY turn, role, text) AS rendered,
  coalesce(string_agg((stop - length(line) + length(head))::BIGINT || '-' || (stop - 1)::BIGINT, ',' ORDER BY stop) FILTER (own), '') AS spans
FROM o GROUP BY conv_id, perspective, segment
"""
