"""Checking of drafted answers against their citations, for many answers at once.

drafts: (answer_id, draft, signal, chitchat, has_tables); signal is the best retrieval score, scaled to 1, or null.
citations: (answer_id, n, source_text, trusted); trusted ones are results of queries that ran.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import embedding
from ..functions import text as tx

SUPPORT, THRESHOLD, NO_SIGNAL = 0.52, 0.55, 0.3
REFUSAL = "I couldn't find this in the provided documents."
HEDGE = "_Low confidence: the documents support this only in part._\n\n"


def sentences(drafts: DataFrame) -> DataFrame:
    """answer_id, s, sentence, clean, cited, needs."""
    each = drafts.select("answer_id", F.posexplode(tx.sentences(F.col("draft"))).alias("s", "sentence"))
    marks = F.transform(F.regexp_extract_all("sentence", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda m: m.cast("int"))
    return each.select("answer_id", "s", "sentence", tx.markdown_strip(F.col("sentence")).alias("clean"), marks.alias("cited"), tx.needs_support(F.col("sentence")).alias("needs"))


def backfill(sents: DataFrame, blocks: DataFrame) -> DataFrame:
    """answer_id, s, n: the marker that a sentence should get, from the block with most of its words; the higher n on ties.

    A sentence without markers needs 0.30 of its words there, another 0.45. Only blocks of its own answer are
    compared, by shared words, so that nothing is crossed.
    """
    own = sents.where(F.length("sentence") >= 15).withColumn("_kw", tx.writing_keywords(F.col("sentence"))).where(F.size("_kw") > 0)
    left = own.select("answer_id", "s", "cited", F.size("_kw").alias("_of"), F.explode("_kw").alias("_w"))
    right = blocks.select("answer_id", "n", F.explode(tx.writing_keywords(F.col("source_text"))).alias("_w"))
    shared = left.join(right, ["answer_id", "_w"]).groupBy("answer_id", "s", "n").agg((F.count("*") / F.first("_of")).alias("overlap"), F.first("cited").alias("cited"))
    w = Window.partitionBy("answer_id", "s").orderBy(F.col("overlap").desc(), F.col("n").desc())
    best = shared.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return best.where((F.col("overlap") >= F.when(F.size("cited") == 0, 0.30).otherwise(0.45)) & ~F.array_contains("cited", F.col("n"))).select("answer_id", "s", "n")


def pair_scores(sents: DataFrame, citations: DataFrame) -> DataFrame:
    """answer_id, s, n, score (unrounded) of each cited source that exists."""
    pairs = sents.select("answer_id", "s", "clean", F.explode(F.array_distinct("cited")).alias("n")).join(citations, ["answer_id", "n"])
    sv = embedding.vectors(sents, ["answer_id", "s"], "clean", name="_sv")
    cv = embedding.vectors(citations, ["answer_id", "n"], "source_text", name="_cv")
    pairs = pairs.join(sv, ["answer_id", "s"], "left").join(cv, ["answer_id", "n"], "left")
    cos = F.coalesce(tx.cosine(F.col("_sv"), F.col("_cv")), F.lit(0.0))
    kw = tx.checking_keywords(F.col("clean"))
    recall = F.when(F.size(kw) > 0, F.size(F.array_intersect(kw, tx.checking_keywords(F.col("source_text")))) / F.size(kw)).otherwise(0.0)
    hit = F.arrays_overlap(tx.numbers(F.col("clean")), tx.numbers(F.col("source_text")))
    return pairs.select("answer_id", "s", "n", F.when(F.col("trusted"), F.when(hit, 0.95).otherwise(0.80)).otherwise(0.55 * cos + 0.45 * recall).alias("score"))


def support(citations: DataFrame, scores: DataFrame) -> DataFrame:
    """citations with support: the best score to 2 places, null if no sentence cites them."""
    best = scores.groupBy("answer_id", "n").agg(F.round(F.max("score"), 2).alias("support"))
    return citations.join(best, ["answer_id", "n"], "left")


def surviving(supported: DataFrame, sents: DataFrame) -> DataFrame:
    """answer_id, n, support of citations that stay: those above the floor, the best if none is, and the first
    marker of a sentence that would lose all. The floor is 0.50 if one reaches 0.65, else 0.38."""
    used = sents.select("answer_id", "s", F.explode("cited").alias("n")).distinct()
    cited = supported.join(used.select("answer_id", "n").distinct(), ["answer_id", "n"])
    every = Window.partitionBy("answer_id")
    first = every.orderBy(F.coalesce("support", F.lit(0.0)).desc(), "n")
    held = cited.withColumn("_best", F.max(F.coalesce("support", F.lit(0.0))).over(every)).withColumn("_r", F.row_number().over(first))
    held = held.withColumn("_ok", F.col("support").isNull() | (F.col("support") >= F.when(F.col("_best") >= 0.65, 0.50).otherwise(0.38)))
    held = held.withColumn("_keep", F.col("_ok") | (~F.max("_ok").over(every) & (F.col("_r") == 1)))
    bare = used.withColumnRenamed("n", "_m").join(held.select(F.col("answer_id").alias("_a"), F.col("n").alias("_n"), "_keep"), (F.col("answer_id") == F.col("_a")) & (F.col("_m") == F.col("_n")), "left").groupBy("answer_id", "s").agg(F.max(F.coalesce("_keep", F.lit(False))).alias("_any"), F.min("_m").alias("n"), F.max(F.col("_keep").isNull()).alias("_unknown"))
    saved = bare.where("NOT _any AND NOT _unknown").select("answer_id", "n").distinct().withColumn("_saved", F.lit(True))
    return held.join(saved, ["answer_id", "n"], "left").where("_keep OR _saved").select("answer_id", "n", "support")


def ratios(checks: DataFrame) -> DataFrame:
    """checks (answer_id, needs, supported, cited) to answer_id, needing, support_ratio, cite_coverage: of the sentences
    that need support, how many have it (1 if none needs any), and how many cite something (0 if none needs any)."""
    need = F.col("needs").cast("int")
    per = checks.groupBy("answer_id").agg(F.sum(need).alias("needing"), F.sum(need * F.col("supported").cast("int")).alias("_sup"), F.sum(need * (F.size("cited") > 0).cast("int")).alias("_cov"))
    share = lambda c, other: F.when(F.col("needing") > 0, F.col(c) / F.col("needing")).otherwise(other)
    return per.select("answer_id", "needing", share("_sup", 1.0).alias("support_ratio"), share("_cov", 0.0).alias("cite_coverage"))


def confidence(ratio: Column, coverage: Column, signal: Column) -> Column:
    return F.round(F.least(F.lit(0.95), 0.55 * ratio + 0.20 * coverage + 0.25 * F.coalesce(signal, F.lit(NO_SIGNAL))), 2)


def verify(drafts: DataFrame, citations: DataFrame) -> DataFrame:
    """answer_id, verdict (refuse, chitchat, hedge, ship), answer, confidence, support_ratio, cite_coverage, kept (citation numbers)."""
    sents = sentences(drafts)
    scores = pair_scores(sents, citations)
    best = scores.groupBy("answer_id", "s").agg(F.max("score").alias("best"))
    checks = sents.join(best, ["answer_id", "s"], "left").withColumn("supported", F.coalesce(F.col("best") >= SUPPORT, F.lit(False)))
    kept = surviving(support(citations, scores), sents).groupBy("answer_id").agg(F.array_sort(F.collect_list("n")).alias("kept"))  # an answer's own citations
    x = drafts.join(ratios(checks), "answer_id", "left").join(kept, "answer_id", "left")
    x = x.withColumn("needing", F.coalesce("needing", F.lit(0))).withColumn("kept", F.coalesce("kept", F.array().cast("array<int>")))
    x = x.withColumn("support_ratio", F.coalesce("support_ratio", F.lit(1.0))).withColumn("cite_coverage", F.coalesce("cite_coverage", F.lit(0.0)))
    x = x.withColumn("_c", confidence(F.col("support_ratio"), F.col("cite_coverage"), F.col("signal")))
    bare = F.rtrim(tx.strip(F.coalesce("draft", F.lit(""))))
    refused = (bare == "") | (F.regexp_replace(bare, r"\.+$", "") == REFUSAL.rstrip("."))
    weak = ((F.col("needing") > 0) & (F.col("cite_coverage") == 0)) | ((F.col("support_ratio") == 0) & (F.coalesce("signal", F.lit(NO_SIGNAL)) < 0.5))
    unfounded = ((F.size("kept") == 0) & ~F.col("has_tables")) | weak
    x = x.withColumn("verdict", F.when(refused, "refuse").when(F.col("chitchat"), "chitchat").when(unfounded, "refuse").when(F.col("_c") < THRESHOLD, "hedge").otherwise("ship"))
    kept_text = F.aggregate(F.array_distinct(F.regexp_extract_all("draft", F.lit(r"\[(\d+)\]"), F.lit(1))), F.col("draft"), lambda t, m: F.when(F.array_contains("kept", m.cast("int")), t).otherwise(F.replace(F.replace(t, F.concat(F.lit(" ["), m, F.lit("]"))), F.concat(F.lit("["), m, F.lit("]")))))
    answer = F.when(F.col("verdict") == "refuse", REFUSAL).when(F.col("verdict") == "chitchat", F.col("draft")).when(F.col("verdict") == "hedge", F.concat(F.lit(HEDGE), tx.strip(kept_text))).otherwise(tx.strip(kept_text))
    none = F.array().cast("array<int>")
    return x.select("answer_id", "verdict", answer.alias("answer"), F.when(refused, 0.0).when(F.col("chitchat"), 1.0).otherwise(F.col("_c")).alias("confidence"), "support_ratio", "cite_coverage", F.when(F.col("verdict").isin("refuse", "chitchat"), none).otherwise(F.col("kept")).alias("kept"))


def answer_key(reply: Column) -> Column:
    """What a reply's line "Final answer: ..." says: an option's letter, a number, CANT, or its first 40 characters; null without one."""
    a = F.lower(F.regexp_extract(reply, r"(?im)final answer:\s*(.+?)\s*$", 1))
    number = F.regexp_extract(a, r"^([-+]?\d+(?:\.\d+)?)", 1)
    return F.when(a == "", None).when(a.startswith("cannot determine"), "CANT").when(a.rlike("^[a-d][.)]"), F.substring(a, 1, 1)).when(number != "", number).otherwise(F.substring(a, 1, 40))


def majority(votes: DataFrame) -> DataFrame:
    """votes (item, k) to item, verdict: the key with most votes if it has two, the lesser on ties; else CANT if any
    vote says so, else inconsistent. Null keys are no votes."""
    counted = votes.groupBy("item", "k").agg(F.count("k").alias("n"))
    real = F.col("k").isNotNull() & (F.col("k") != "CANT") & (F.col("n") >= 2)
    best = F.min(F.when(real, F.struct((-F.col("n")).alias("n"), "k")))["k"]
    cant = F.max(F.coalesce(F.col("k") == "CANT", F.lit(False)))
    return counted.groupBy("item").agg(F.coalesce(best, F.when(cant, "CANT").otherwise("inconsistent")).alias("verdict"))
