"""Mixing sources to target weights by iterative proportional fitting (DataFrame operations only).

Tokens are summed by cell (one combination of source, language and topic). The sample shall hold `fraction` of all
tokens; a cell's weight is its share of the sample, at most cap = its tokens / (fraction of all tokens), as no
document is drawn twice. Raking is bounded: each step scales the weights of a category to its target share and
fixes at their caps those that would exceed them, the others taking the rest, one dimension after another, for
ITERATIONS rounds. A document of a cell is then drawn with probability weight / cap. The draw is a hash of the id,
so a rerun keeps the same rows.

A category with fewer tokens than its target asks for is drawn whole, and what it lacks goes to the others of its
dimension in proportion to their targets. Every row tells target and expected share of its three categories, and the
largest fraction at which no category lacks tokens.

Only the cell table is iterated. It is bounded by the product of the category counts, not by documents; up
to LOCAL_CELLS cells are raked in one task without a shuffle, more are shuffled by category.

A target is a mapping of shares (categories that it leaves out share what is left of 1, in proportion to
their tokens; if nothing is left, they keep their share of all tokens and the mapping is scaled to the rest)
or a power: shares in proportion to tokens ** power. Shares are rescaled over the categories that occur. A null category is the category '(null)'; null or empty texts have 0 tokens, and count as one
token here so that every document has a probability. Rows with the same id are drawn together. Texts of any length
count by their words. Other columns are not read; `sample` returns them unchanged, whatever their names. An empty
table gives an empty result; if all targets of what occurs are 0, all rows are drawn.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._io import materialize

ITERATIONS = 12
LOCAL_CELLS = 100_000
DIMS = ("source", "lang", "topic")
TARGETS: dict[str, Mapping[str, float] | float] = {
    "source": 0.7,
    "lang": {"en": 0.5, "de": 0.2, "fr": 0.15, "es": 0.15},
    "topic": {"brief": 0.1, "article": 0.4, "long": 0.35, "tabular": 0.15},
}
FRACTION = 0.5


def n_words(text: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")


def form_topic(text: Column, tokens: Column) -> Column:
    """A document's topic by its form: a table, or prose by length."""
    pipes = F.length(F.coalesce(text, F.lit(""))) - F.length(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("")))
    return F.when(pipes * 10 >= tokens, "tabular").when(tokens < 100, "brief").when(tokens < 500, "article").otherwise("long")


def unit_hash(key: Column) -> Column:
    """A number in [0, 1) from the MD5 of a key."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def _goal(dim: str, target: Mapping[str, float] | float) -> Column:
    own = F.sum("tokens").over(Window.partitionBy(dim))
    if not isinstance(target, Mapping):
        return F.pow(own, F.lit(float(target)))
    listed = F.col(dim).isin(list(target))
    total = F.sum(F.when(~listed, F.col("tokens"))).over(Window.partitionBy(F.lit(1)))
    left = max(0.0, 1.0 - sum(target.values()))
    share = F.lit(None).cast("double")
    for k, v in target.items():
        share = F.when(F.col(dim) == k, F.lit(float(v))).otherwise(share)
    if left < 1e-9:  # nothing is left for others: they keep their part of the tokens
        every = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
        return F.coalesce(share * (F.lit(1.0) - F.coalesce(total, F.lit(0)) / every), own / every)
    return F.coalesce(share, F.lit(left) * own / total, F.lit(0.0))


def _fit(cells: DataFrame, value: str, goal: Column, part: Column, order: tuple[str, ...], bounded: bool) -> DataFrame:
    """cells with `value` scaled so that it adds up to goal in each part, and nowhere exceeds _cap."""
    w = Window.partitionBy(part)
    if not bounded:
        return cells.withColumn(value, F.coalesce(F.try_divide(F.col(value) * goal, F.sum(value).over(w)), F.lit(0.0)))
    # in the order in which they reach their caps: the scale if exactly the cells before this one are at theirs; the largest that caps no further one is right
    x = cells.withColumn("_ratio", F.col(value) / F.col("_cap"))
    by = w.orderBy(F.col("_ratio").desc(), *order)
    before = F.coalesce(F.sum("_cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    scale = F.try_divide(goal - before, F.sum(value).over(by.rowsBetween(0, Window.unboundedFollowing)))
    x = x.withColumn("_scale", scale).withColumn("_scale", F.max(F.when(F.col("_scale") * F.col("_ratio") <= 1, F.col("_scale"))).over(w))
    fitted = F.when(F.col(value) == 0, F.lit(0.0)).otherwise(F.least(F.col("_cap"), F.coalesce(F.col("_scale") * F.col(value), F.col("_cap"))))
    return x.withColumn(value, fitted).drop("_ratio", "_scale")


def rake(cells: DataFrame, dims=DIMS, targets=TARGETS, iterations: int = ITERATIONS, fraction: float = 0.0) -> DataFrame:
    """cells (dims, tokens) with their raked share `weight`, which add up to 1, and each category's target share.

    With a fraction, no weight exceeds a cell's tokens in a sample of that fraction, and goals that can't be met are lowered.
    """
    cells = materialize(cells, "cells")
    local = cells.count() <= LOCAL_CELLS
    one = (lambda d: d.coalesce(1)) if local else (lambda d: d)
    everything, bounded = Window.partitionBy(F.lit(1)), fraction > 0
    goals = one(cells).withColumn("weight", F.col("tokens").cast("double"))
    total = F.sum("tokens").over(everything)
    goals = goals.withColumn("_cap", F.col("tokens") / (F.lit(fraction) * total)) if bounded else goals
    for d in dims:
        own = F.sum("tokens").over(Window.partitionBy(d))
        goals = goals.withColumn(f"_goal_{d}", _goal(d, targets[d])).withColumn("_part", F.col("tokens") / own)
        goals = goals.withColumn(f"{d}_target", F.try_divide(F.col(f"_goal_{d}"), F.sum(F.col(f"_goal_{d}") * F.col("_part")).over(everything)))
        feasible = F.coalesce(F.try_divide(own, F.col(f"{d}_target") * total), F.lit(1.0))
        goals = goals.withColumn(f"_feasible_{d}", F.min(feasible).over(everything))
        # a category that lacks tokens leaves its share to the others
        goals = _fit(goals.withColumn("_want", F.coalesce(F.col(f"{d}_target"), F.lit(0.0)) * F.col("_part")), "_want", F.lit(1.0), F.lit(1), dims, bounded)
        goals = goals.withColumn(f"_goal_{d}", F.sum("_want").over(Window.partitionBy(d))).drop("_part", "_want")
    goals = goals.withColumn("feasible_fraction", F.least(F.lit(1.0), *[F.col(f"_feasible_{d}") for d in dims])).drop(*[f"_feasible_{d}" for d in dims])
    if bounded:  # a start within the caps
        goals = goals.withColumn("weight", F.lit(fraction) * F.col("_cap"))
    now = materialize(goals, "goals")
    for done in range(0, iterations, 2):
        now = one(now)
        for d in dims * min(2, iterations - done):
            now = _fit(now, "weight", F.col(f"_goal_{d}"), F.col(d), dims, bounded)
        now = materialize(now, "raked")
    now = one(now).withColumn("weight", F.try_divide("weight", F.sum("weight").over(everything)))
    return now.select(*dims, "tokens", "weight", *[f"{d}_target" for d in dims], "feasible_fraction")


def calibrate(raked: DataFrame, fraction: float, dims=DIMS) -> DataFrame:
    """raked with `probability`: as close to the weights as a cap at 1 allows, with the wanted expectation, and the expected shares."""
    everything = Window.partitionBy(F.lit(1))
    x = raked.withColumn("_cap", F.col("tokens") / (F.lit(fraction) * F.sum("tokens").over(everything))).withColumn("_weight", F.col("weight"))
    x = _fit(x, "_weight", F.lit(1.0), F.lit(1), dims, True)
    x = x.withColumn("probability", F.least(F.lit(1.0), F.coalesce(F.col("_weight") / F.col("_cap"), F.lit(1.0))))
    for d in dims:
        expected = F.col("tokens") * F.col("probability")
        x = x.withColumn(f"{d}_share", F.sum(expected).over(Window.partitionBy(d)) / F.sum(expected).over(everything))
    return x.drop("_cap", "_weight")


def mix_sources(
    docs: DataFrame, targets=TARGETS, fraction: float = FRACTION, id_col: str = "doc_id", text_col: str = "text", source: str = "source", lang: str = "lang", topic=form_topic, iterations: int = ITERATIONS
) -> DataFrame:
    """One row per row of docs: id_col, source, lang, topic, n_tokens, weight (of its cell), probability, sampled, and of each of its three categories target and expected share; the largest fraction that can meet all targets."""
    keyed = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(source).cast("string"), F.lit("(null)")).alias("source"), F.coalesce(F.col(lang).cast("string"), F.lit("(null)")).alias("lang"), F.col(text_col).alias("_text"))
    keyed = keyed.withColumn("n_tokens", n_words(F.col("_text"))).withColumn("topic", topic(F.col("_text"), F.col("n_tokens"))).drop("_text")
    keyed = materialize(keyed, "tokens")
    cells = calibrate(rake(keyed.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")), DIMS, targets, iterations, fraction), fraction)
    cells = materialize(cells, "calibrated")
    # cells are as many as category combinations; Spark broadcasts them while they are under its size limit
    told = [f"{d}_{k}" for d in DIMS for k in ("target", "share")]
    out = keyed.join(cells.drop("tokens"), list(DIMS))
    rounded = [F.round(c, 9).alias(c) for c in ("weight", "probability")]
    return out.select(F.col("_id").alias(id_col), *DIMS, "n_tokens", *rounded, (unit_hash(F.col("_id")) < F.col("probability")).alias("sampled"), *[F.round(c, 6).alias(c) for c in (*told, "feasible_fraction")])


def sample(docs: DataFrame, **kw) -> DataFrame:
    """The sampled rows of docs with all their columns. Rows with one id and different texts are drawn one by one by their cell."""
    id_col, text, topic = kw.get("id_col", "doc_id"), F.col(kw.get("text_col", "text")), kw.get("topic", form_topic)
    chosen = mix_sources(docs, **kw).where("sampled").select(F.struct(F.col(id_col).alias("id"), *DIMS, "n_tokens").alias("key")).distinct()
    source, lang = (F.coalesce(F.col(kw.get(c, c)).cast("string"), F.lit("(null)")).alias(c) for c in ("source", "lang"))
    # a row travels whole beside its key, so that no column of it can clash
    rows = docs.select(F.struct("*").alias("row"), F.struct(F.col(id_col).alias("id"), source, lang, topic(text, n_words(text)).alias("topic"), n_words(text).alias("n_tokens")).alias("key"))
    return rows.join(chosen, rows["key"].eqNullSafe(chosen["key"]), "left_semi").select("row.*")


def oracle(targets=TARGETS, fraction: float = FRACTION, iterations: int = ITERATIONS) -> str:
    """DuckDB SQL for mix_sources over documents."""
    def goal(d: str) -> str:
        t, own = targets[d], f"sum(tokens) OVER (PARTITION BY {d})"
        if not isinstance(t, Mapping):
            return f"pow({own}, {float(t)!r})"
        names = ", ".join(f"'{k}'" for k in t)
        case = " ".join(f"WHEN '{k}' THEN {float(v)!r}::DOUBLE" for k, v in t.items())
        return f"coalesce(CASE {d} {case} END, {max(0.0, 1.0 - sum(t.values()))!r}::DOUBLE * {own} / sum(tokens) FILTER ({d} NOT IN ({names})) OVER (), 0.0)"

    order, every, steps, last = ", ".join(DIMS), "(PARTITION BY 1)", [], "cells"

    def add(select: str) -> None:
        nonlocal last
        steps.append(f"x{len(steps)} AS (SELECT {select} FROM {last})")
        last = f"x{len(steps) - 1}"

    def fit(value: str, goal: str, part: str) -> None:
        add(f"*, {value} / cap AS ratio")
        by = f"PARTITION BY {part} ORDER BY ratio DESC, {order}"
        add(f"""*, ({goal} - coalesce(sum(cap) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / nullif(sum({value}) OVER ({by} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS scale""")
        add(f"* EXCLUDE (scale, ratio) REPLACE (CASE WHEN {value} = 0 THEN 0.0::DOUBLE ELSE least(cap, coalesce(max(scale) FILTER (scale * ratio <= 1) OVER (PARTITION BY {part}) * {value}, cap)) END AS {value})")

    add(f"*, tokens / ({fraction!r}::DOUBLE * sum(tokens) OVER {every}) AS cap, {', '.join(f'{goal(d)} AS goal_{d}' for d in DIMS)}")
    for d in DIMS:
        add(f"*, tokens / sum(tokens) OVER (PARTITION BY {d}) AS part")
        add(f"* , goal_{d} / nullif(sum(goal_{d} * part) OVER {every}, 0) AS {d}_target")
        add(f"*, coalesce(sum(tokens) OVER (PARTITION BY {d}) / nullif({d}_target * sum(tokens) OVER {every}, 0), 1.0) AS f0, coalesce({d}_target, 0.0) * part AS want")
        add(f"* EXCLUDE (f0, part), min(f0) OVER {every} AS feasible_{d}")
        fit("want", "1.0::DOUBLE", "1")
        add(f"* EXCLUDE (want) REPLACE (sum(want) OVER (PARTITION BY {d}) AS goal_{d})")
    add(f"*, {fraction!r}::DOUBLE * cap AS weight, least(1.0, {', '.join(f'feasible_{d}' for d in DIMS)}) AS feasible_fraction")
    for _ in range(iterations):
        for d in DIMS:
            fit("weight", f"goal_{d}", d)
    add(f"* REPLACE (weight / nullif(sum(weight) OVER {every}, 0) AS weight)")
    add("*, weight AS fitted")
    fit("fitted", "1.0::DOUBLE", "1")
    add("*, least(1.0, coalesce(fitted / cap, 1.0)) AS probability")
    add("*, " + ", ".join(f"sum(tokens * probability) OVER (PARTITION BY {d}) / sum(tokens * probability) OVER {every} AS {d}_share" for d in DIMS))
    told = ", ".join(f"round({c}, 6) AS {c}" for c in (*[f"{d}_{k}" for d in DIMS for k in ("target", "share")], "feasible_fraction"))
    return rf"""
WITH base AS (SELECT doc_id, coalesce(source, '(null)') AS source, coalesce(lang, '(null)') AS lang, coalesce(text, '') AS text,
  greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS n_tokens FROM documents),
t AS (SELECT doc_id, source, lang, n_tokens, CASE WHEN (length(text) - length(replace(text, '|', ''))) * 10 >= n_tokens THEN 'tabular'
  WHEN n_tokens < 100 THEN 'brief' WHEN n_tokens < 500 THEN 'article' ELSE 'long' END AS topic FROM base),
cells AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM t GROUP BY ALL),
{", ".join(steps)}
SELECT t.doc_id, source, lang, topic, t.n_tokens, round(p.weight, 9) AS weight, round(p.probability, 9) AS probability,
  CAST('0x' || substr(md5(coalesce(t.doc_id::VARCHAR, '')), 1, 12) AS BIGINT)::DOUBLE / 281474976710656.0 < p.probability AS sampled, {told}
FROM t JOIN {last} p USING (source, lang, topic)
"""
