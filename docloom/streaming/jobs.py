"""Structured Streaming: incremental ingest, windowed counts, running usage."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A folder's parquet file as a stream; local times become timestamps, as watermarks need them."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    df = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in df.columns else df


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))


def usage_totals(calls: DataFrame) -> DataFrame:
    return calls.groupBy("model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count("*").alias("calls"))


def usage_costs(calls: DataFrame, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """usage_totals with cost, by prices of a million input and output tokens; 0 for models without a price."""
    rows = F.create_map(*[x for k, (a, b) in prices.items() for x in (F.lit(k), F.struct(F.lit(a).alias("i"), F.lit(b).alias("o")))])
    price = F.try_element_at(rows, F.col("model"))
    cost = (F.col("input_tokens") * price["i"] + F.col("output_tokens") * price["o"]) / 1e6
    return usage_totals(calls).withColumn("cost", F.round(F.coalesce(cost, F.lit(0.0)), 6))


class ProgressLog(StreamingQueryListener):
    """Rows and seconds of each batch of the session's streaming queries, the last `keep` of them."""

    def __init__(self, keep: int = 1000):
        self.batches: deque = deque(maxlen=keep)
        self.failed: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.append((str(p.id), p.batchId, p.numInputRows, (p.durationMs or {}).get("triggerExecution", 0) / 1000))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.failed[str(event.id)] = event.exception


def session_memory(turns: DataFrame, recent: int = 4) -> DataFrame:
    """conv_id, context, folded: the last turns of each conversation, and how many older ones were folded away.

    State is at most `recent` turns and a count for each conversation. Turns of one batch are taken in order.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, folded = state.get if state.exists else ("[]", 0)
        lines = json.loads(held)
        for t in pd.concat(batches).sort_values("turn", kind="stable").itertuples():
            lines.append(f"{t.role}: {t.text}")
        folded += max(0, len(lines) - recent)
        lines = lines[-recent:]
        state.update((json.dumps(lines), folded))
        yield pd.DataFrame({"conv_id": [key[0]], "context": [" | ".join(lines)], "folded": [folded]})

    return turns.select("conv_id", "turn", "role", "text").groupBy("conv_id").applyInPandasWithState(update, "conv_id long, context string, folded long", "held string, folded long", "update", "NoTimeout")


def ingest_new(stream: DataFrame, target: str, key: str, checkpoint: str) -> StreamingQuery:
    """Append rows whose key the target table does not have; a batch that runs again adds nothing."""

    def upsert(batch: DataFrame, _: int) -> None:
        spark, fresh = batch.sparkSession, batch.dropDuplicates([key])
        try:
            fresh = fresh.join(spark.read.parquet(target).select(key), key, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
