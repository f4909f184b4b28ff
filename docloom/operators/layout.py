"""Layout: headings to sections and paths, runs, greedy packing, as folds over a document's elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.text import token_estimate
from .numbering import explode_long

TARGET, OVERLAP, SECTION = 480, 64, 1600
ATOMIC, HEADING = ("table", "code", "figure"), ("heading", "title")


def section_path(levels: Column, texts: Column) -> Column:
    """The path after each heading: the last path cut to level - 1 entries, and the heading."""
    start = F.array().cast("array<array<string>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.when(F.size(acc) == 0, F.array().cast("array<string>")).otherwise(F.element_at(acc, -1))
        return F.concat(acc, F.array(F.concat(F.slice(last, 1, F.greatest(x["level"] - 1, F.lit(0))), F.array(x["text"]))))

    return F.aggregate(F.arrays_zip(levels.alias("level"), texts.alias("text")), start, step)


def sections(elements: DataFrame, doc: str = "doc_id", seq: str = "seq", heading: str = "is_heading") -> DataFrame:
    """elements with section: 0 before the first heading, then counted."""
    return elements.withColumn("section", F.sum(F.col(heading).cast("int")).over(Window.partitionBy(doc).orderBy(seq)))


def pack(sizes: Column, target: int = TARGET, overlap: int = OVERLAP) -> Column:
    """Greedy packing of token sizes: (first, last) element of each chunk, 0-based.

    A chunk takes elements while it stays within target; the next begins with the tail that has at least
    overlap tokens, at least one element.
    """
    state = F.struct(F.lit(0).alias("first"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("i"), F.array().cast("array<struct<first:int,last:int>>").alias("done"))

    def tail(i: Column) -> Column:
        """The first element of the overlap that ends before i."""
        back = F.aggregate(
            F.reverse(F.slice(sizes, 1, i)), F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).alias("n")),
            lambda a, x: F.when((a["n"] > 0) & (a["s"] >= overlap), a).otherwise(F.struct((a["s"] + x).alias("s"), (a["n"] + 1).alias("n"))),
        )
        return i - back["n"]

    def step(a: Column, x: Column) -> Column:
        full = (a["sum"] > 0) & (a["sum"] + x > target)
        first = F.when(full, F.greatest(tail(a["i"]), a["first"] + 1)).otherwise(a["first"])
        total = F.when(full, F.aggregate(F.slice(sizes, first + 1, a["i"] - first), F.lit(0).cast("long"), lambda s, y: s + y)).otherwise(a["sum"]) + x
        done = F.when(full, F.concat(a["done"], F.array(F.struct(a["first"].alias("first"), (a["i"] - 1).alias("last"))))).otherwise(a["done"])
        return F.struct(first.alias("first"), total.alias("sum"), (a["i"] + 1).alias("i"), done.alias("done"))

    def finish(a: Column) -> Column:
        return F.when(a["i"] > 0, F.concat(a["done"], F.array(F.struct(a["first"].alias("first"), (a["i"] - 1).alias("last"))))).otherwise(a["done"])

    return F.aggregate(sizes, state, step, finish)


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """Lines as elements, over-long ones by sentences, packed: doc_id, chunk_no, first, last, n_tokens, body."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.filter(explode_long(F.col(text_col), target), lambda x: F.trim(x) != "").alias("lines"))
    sized = lines.withColumn("sizes", F.transform("lines", token_estimate))
    packed = sized.select("doc_id", "lines", "sizes", F.posexplode(pack(F.col("sizes"), target, overlap)).alias("chunk_no", "c"))
    n = F.col("c.last") - F.col("c.first") + 1
    return packed.select("doc_id", "chunk_no", F.col("c.first").alias("first"), F.col("c.last").alias("last"), F.aggregate(F.slice("sizes", F.col("c.first") + 1, n), F.lit(0).cast("long"), lambda s, y: s + y).alias("n_tokens"), F.array_join(F.slice("lines", F.col("c.first") + 1, n), "\n").alias("body"))


def is_atomic(kind: Column, ordinal: Column) -> Column:
    """Tables, code, figures and numbered items are chunks of their own."""
    return kind.isin(*ATOMIC) | ((kind == "list_item") & ordinal.isNotNull())


def runs(elements: DataFrame, doc: str = "doc_id", seq: str = "seq") -> DataFrame:
    """elements (kind, ordinal) without headings, with section, atomic and run: an atomic element is a run of its own,
    the others of a section up to the next atomic one form one. Runs of a section are numbered from 0."""
    x = sections(elements.withColumn("_head", F.col("kind").isin(*HEADING)), doc, seq, "_head").where("NOT _head").drop("_head")
    own = Window.partitionBy(doc, "section").orderBy(seq)
    x = x.withColumn("atomic", is_atomic(F.col("kind"), F.col("ordinal")))
    starts = F.col("atomic") | F.coalesce(F.lag("atomic").over(own), F.lit(True))
    return x.withColumn("run", F.sum(starts.cast("int")).over(own) - 1)


def section_texts(elements: DataFrame, doc: str = "doc_id", seq: str = "seq", tokens: int = SECTION) -> DataFrame:
    """doc, section, body: a section's elements in order, headings included, cut at so many tokens."""
    x = sections(elements.withColumn("_head", F.col("kind").isin(*HEADING)), doc, seq, "_head").where("text <> ''")
    # a section's own elements
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, "text"))), lambda e: e["text"]), "\n\n")
    return x.groupBy(doc, "section").agg(tx.truncated(tx.strip(body), tokens, " \u2026").alias("body"))


def chunk_elements(elements: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """elements (doc_id, seq, kind, ordinal, text, section_path, title) to chunks in order: doc_id, seq, kind, ordinal,
    section_path, body, text, parent, and at, the seq of the first element.

    Headings divide sections. Atomic elements stand alone; runs of the others are packed. The text is the body under
    its breadcrumb; parent is the section, for context, which numbered items do not have.
    """
    parts = runs(elements)
    whole = parts.groupBy("doc_id", "section", "run").agg(  # a run's own elements
        F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("_e"), F.max("atomic").alias("atomic"), F.min(F.struct("seq", "kind", "ordinal", "section_path", "title")).alias("_first")
    )
    lines = F.flatten(F.transform("_e", lambda e: F.filter(explode_long(e["text"], target), lambda t: F.trim(t) != "")))
    sized = whole.withColumn("_lines", F.when(F.col("atomic"), F.transform("_e", lambda e: e["text"])).otherwise(lines))
    cut = pack(F.transform("_lines", token_estimate), target, overlap)
    packed = sized.select("*", F.posexplode(cut).alias("_k", "_c"))
    body = tx.strip(F.array_join(F.slice("_lines", F.col("_c.first") + 1, F.col("_c.last") - F.col("_c.first") + 1), "\n\n"))
    alone = F.size("_lines") == 1
    made = packed.select("doc_id", "section", F.col("_first.seq").alias("_at"), "_k", F.col("_first.kind").alias("kind"), F.when(alone, F.col("_first.ordinal")).alias("ordinal"), F.col("_first.section_path").alias("section_path"), F.col("_first.title").alias("_title"), body.alias("body"))
    made = made.where("body <> ''").join(section_texts(elements).withColumnRenamed("body", "_parent"), ["doc_id", "section"], "left")
    text = tx.chunk_text(tx.breadcrumb(F.coalesce("_title", F.lit("")), F.coalesce("section_path", F.array().cast("array<string>"))), F.col("ordinal"), F.col("body"))
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("_at", "_k")) - 1
    parent = F.when(F.col("ordinal").isNull() & (F.col("_parent") != F.col("body")), F.col("_parent"))
    return made.select("doc_id", seq.alias("seq"), "kind", "ordinal", "section_path", "body", text.alias("text"), parent.alias("parent"), F.col("_at").alias("at"))
