"""Layout of pages: furniture, heading levels, reading order, figures, tables, charts, as joins and windows.

Elements are rows (doc_id, page, id) with what each function names; a document's or page's rows meet in one
window, no more. Medians of sizes are the upper of the middle two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARGIN, MAX_FURNITURE = 0.12, 90
#: Without blanks: 7, page7, 7of10, 7|page.
PAGE_NUMBER = r"^(page)?\d{1,4}(\|?page)?(of\d{1,4})?$"


def heading_level(size: Column, body: Column) -> Column:
    ratio = size / body
    return F.when(ratio >= 1.6, 1).when(ratio >= 1.35, 2).when(ratio >= 1.18, 3).otherwise(4)


def normal_line(text: Column) -> Column:
    """A line without case, blanks and digits, as running heads differ in page numbers."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"\s+", ""), r"\d+", "#")


def is_page_number(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"\s+", "").rlike(PAGE_NUMBER)


def furniture(lines: DataFrame) -> DataFrame:
    """lines (doc_id, page, at, text; at is the height on the page from 0 to 1) with is_furniture: margin lines that
    are page numbers or stand on at least three pages and three in five of the document's."""
    margin = ((F.col("at") < MARGIN) | (F.col("at") > 1 - MARGIN)) & (F.length("text") <= MAX_FURNITURE)
    x = lines.withColumn("_norm", normal_line(F.col("text"))).withColumn("_margin", F.coalesce(margin, F.lit(False)))
    total = lines.groupBy("doc_id").agg(F.count_distinct("page").alias("_pages"))
    often = x.where("_margin").groupBy("doc_id", "_norm").agg(F.count_distinct("page").alias("_n")).join(total, "doc_id")
    often = often.where(F.col("_n") >= F.greatest(F.lit(3), F.round(0.6 * F.col("_pages")))).select("doc_id", "_norm", F.lit(True).alias("_often"))
    number = is_page_number(F.col("text"))
    return x.join(often, ["doc_id", "_norm"], "left").withColumn("is_furniture", F.col("_margin") & (F.coalesce("_often", F.lit(False)) | F.coalesce(number, F.lit(False)))).drop("_norm", "_margin", "_often")


def upper_middle(values: Column) -> Column:
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def reading_order(boxes: DataFrame) -> DataFrame:
    """boxes (doc_id, page, id, x0, y0, y1) with pos: by rows from the top, then from the left. Tops less than half a
    box, and at least 20 points, apart are one row."""
    page = Window.partitionBy("doc_id", "page")
    down = page.orderBy("y0", "id")
    height = upper_middle(F.collect_list(F.col("y1") - F.col("y0")).over(page))  # a page's own boxes
    x = boxes.withColumn("_tol", F.greatest(F.lit(20.0), 0.5 * height)).withColumn("_step", F.col("y0") - F.lag("y0").over(down))
    x = x.withColumn("_band", F.sum(F.coalesce((F.col("_step") > F.col("_tol")).cast("int"), F.lit(0))).over(down))
    return x.withColumn("pos", F.row_number().over(page.orderBy("_band", "x0", "id"))).drop("_tol", "_step", "_band")


def attach_figures(elements: DataFrame) -> DataFrame:
    """elements (doc_id, page, kind, ordinal, image_ref): numbered items without an image get their page's figure, if it has one only."""
    figures = elements.where("kind = 'figure' AND image_ref IS NOT NULL AND page IS NOT NULL").groupBy("doc_id", "page").agg(F.count("*").alias("_n"), F.max("image_ref").alias("_only")).where("_n = 1").drop("_n")
    own = F.when(F.col("ordinal").isNotNull(), F.coalesce("image_ref", "_only")).otherwise(F.col("image_ref"))
    return elements.join(figures, ["doc_id", "page"], "left").withColumn("image_ref", own).drop("_only")


def outside_tables(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """blocks (doc_id, page, x0, y0, x1, y1) that meet no table of their page."""
    b, t = blocks.alias("b"), tables.alias("t")
    meets = (F.col("b.x0") < F.col("t.x1")) & (F.col("b.x1") > F.col("t.x0")) & (F.col("b.y0") < F.col("t.y1")) & (F.col("b.y1") > F.col("t.y0"))
    return b.join(t, (F.col("b.doc_id") == F.col("t.doc_id")) & (F.col("b.page") == F.col("t.page")) & meets, "left_anti")


def bar_charts(rects: DataFrame) -> DataFrame:
    """doc_id, page, bars of pages whose filled rectangles (x0, y0, width, height) form a bar chart: at least four near
    the median width, of different heights, on one base line, with no gap over three times the mean."""
    page = Window.partitionBy("doc_id", "page")
    x = rects.withColumn("_mid", upper_middle(F.collect_list("width").over(page))).where("abs(width - _mid) <= 0.35 * _mid")
    x = x.withColumn("_gap", F.lead("x0").over(page.orderBy("x0")) - F.col("x0")).withColumn("_base", F.col("y0") + F.col("height"))
    g = x.groupBy("doc_id", "page").agg(F.count("*").alias("bars"), (F.max("height") - F.min("height")).alias("_h"), (F.max("_base") - F.min("_base")).alias("_b"), F.max("_gap").alias("_g"), F.avg("_gap").alias("_m"))
    return g.where("bars >= 4 AND _h > 2 AND _b <= 8 AND _g <= 3 * _m").select("doc_id", "page", "bars")


def number_parts(elements: DataFrame) -> DataFrame:
    """elements (doc_id, seq, part, ordinal): unnumbered rows that are parts go on from the document's greatest ordinal,
    if it has any and there are at least two parts."""
    doc = Window.partitionBy("doc_id")
    part = F.col("part") & F.col("ordinal").isNull()
    x = elements.withColumn("_max", F.max("ordinal").over(doc)).withColumn("_many", F.sum(part.cast("int")).over(doc)).withColumn("_k", F.sum(part.cast("int")).over(doc.orderBy("seq")))
    return x.withColumn("ordinal", F.when(part & (F.col("_many") >= 2), F.col("_max") + F.col("_k")).otherwise(F.col("ordinal")).cast("int")).drop("_max", "_many", "_k")


def body_sizes(spans: DataFrame) -> DataFrame:
    """doc_id, median, upper of the spans' sizes (doc_id, size): the mean of the middle two, and the greater of them."""
    return spans.groupBy("doc_id").agg(F.median(F.col("size").cast("double")).alias("median"), upper_middle(F.collect_list(F.col("size").cast("double"))).alias("upper"))  # a document's own spans


def best_passes(passes: DataFrame) -> DataFrame:
    """passes (id, scale, n, confidence, text) to id, text, scale: of the readings of an image the one with most
    detections, then the greatest confidence, then the least scale."""
    best = F.max(F.struct("n", "confidence", (-F.col("scale")).alias("_s"), "text"))
    return passes.groupBy("id").agg(best.alias("_b")).select("id", "_b.text", (-F.col("_b._s")).alias("scale"))
