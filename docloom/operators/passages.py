"""Which retrieved passages an answer sees: pins and pads, filters, caps, and whole documents for broad questions.

Passages are rows (query_id, id, score, ...) with what each function names, for many questions at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .numbering import options
from .retrieval import within_budget

PAD_RANK, PADS, MOST, SHARED = 5, 2, 6, 2
BROAD_TOKENS = 6000
CHARTS = "bar chart|line graph|chart|graph|plot|axis"
#: How a transcribed chart begins.
CAPTIONS = "this chart shows|chart (?:description|data|analysis)|[a-z ]+ chart"


def asks_for_chart(question: Column) -> Column:
    return question.rlike(rf"(?i)\b(?:{CHARTS})\b")


def is_chart(kind: Column, body: Column) -> Column:
    return kind.isin("figure", "table") | tx.strip(body).rlike(rf"(?i)^#*\s*(?:{CAPTIONS})\b")


def own_charts(passages: DataFrame) -> DataFrame:
    """passages (query_id, question, source, kind, body, score, id): where a question asks for a chart, those of
    other sources than the best passage's go."""
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    x = passages.withColumn("_main", F.first("source").over(best))
    foreign = asks_for_chart(F.col("question")) & (F.col("source") != F.col("_main")) & is_chart(F.col("kind"), F.col("body"))
    return x.where(~F.coalesce(foreign, F.lit(False))).drop("_main")


def on_topic(passages: DataFrame, least: int = SHARED) -> DataFrame:
    """passages (question, body, intent) beside the result of a query: none for a question about tables alone; else
    those that share at least two words with the question, if it has any."""
    wanted = tx.writing_keywords(F.col("question"))
    shared = F.size(F.array_intersect(wanted, tx.writing_keywords(F.col("body"))))
    return passages.where((F.col("intent") != "table") & ((F.size(wanted) == 0) | (shared >= least)))


def capped(passages: DataFrame, most: int = MOST) -> DataFrame:
    """passages (query_id, broad, score, id) with n, from 1 by score: the best six, or all of a broad question."""
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return passages.withColumn("n", n).where(F.col("broad") | (F.col("n") <= most))


def pin(passages: DataFrame, pinned: DataFrame, pads: int = PADS, floor: int = PAD_RANK) -> DataFrame:
    """passages (query_id, id, score, dense_rank, sparse_rank) behind the pinned ids (query_id, id, place) of their question:
    query_id, id, pinned, pos.

    A question with pins has them first, in their order, then at most two others that rank within five in either
    list; one without has its passages by score.
    """
    own = passages.join(pinned.select("query_id", "id", "place"), ["query_id", "id"], "full_outer").join(pinned.select("query_id").distinct().withColumn("_has", F.lit(True)), "query_id", "left")
    x = own.withColumn("pinned", F.col("place").isNotNull())
    good = F.col("_has").isNull() | F.col("pinned") | (F.col("dense_rank") <= floor) | (F.col("sparse_rank") <= floor)
    first = Window.partitionBy("query_id").orderBy(F.col("place").asc_nulls_last(), F.col("score").desc_nulls_last(), "id")
    x = x.where(F.coalesce(good, F.lit(False))).withColumn("pos", F.row_number().over(first))
    x = x.withColumn("_pins", F.sum(F.col("pinned").cast("int")).over(Window.partitionBy("query_id")))
    return x.where(F.col("_has").isNull() | (F.col("pos") <= F.col("_pins") + pads)).select("query_id", "id", "pinned", "pos")


def whole_document(chunks: DataFrame, limit: int = BROAD_TOKENS) -> DataFrame:
    """chunks (query_id, source, seq, body) of the documents that broad questions are about, in reading order, within the budget."""
    sized = chunks.withColumn("_tokens", tx.token_estimate(F.col("body")))
    return within_budget(sized, "_tokens", ["source", "seq"], limit, ["query_id"]).drop("_tokens")


def is_mcq(text: Column) -> Column:
    return options(text) >= 3


def is_image_task(text: Column, image: Column) -> Column:
    """A task on an image, without lettered options."""
    return image.isNotNull() & ~is_mcq(text)


def may_solve(verdict: Column, pinned: Column, text: Column, image: Column) -> Column:
    """Whether a refused question goes to a solver: it is about a pinned item that has options or an image."""
    return (verdict == "refuse") & pinned & (is_mcq(text) | image.isNotNull())
