"""Ingest, search and answer over one folder of tables, which are only appended to: a reader takes what the latest rows name.

documents: (doc_id, path, source, digest, version, removed); the row with a document's greatest version counts.
chunks: rows of CHUNK; those of a document's latest version count, so an ingest that breaks off leaves no trace.
tables: registered sheets; registry: (name, source, sheet, doc_id, columns, rows, kept, card, version, removed).
index: a written BM25 index of each generation, and the generation that counts.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .functions import embedding
from .functions import text as tx
from .operators import answers, layout, numbering, passages, retrieval
from .plans import guard, planner, registry
from .sources import files

CHUNK = "chunk_id string, doc_id string, version long, source string, seq int, kind string, ordinal int, page int, section_path array<string>, body string, text string, parent string, image_ref string, embedding array<float>"
DOCUMENT = "doc_id string, path string, source string, digest string, version long, removed boolean"
TABLE = "name string, source string, sheet string, doc_id string, columns string, rows long, kept long, card string, version long, removed boolean"
INDEX = "generation string, version long"
CARD = "table_card"
STRONG = 2 / (retrieval.RRF_K + 1)
SOLVED = "Not in your documents, worked out from the question alone:\n\n"


@dataclass
class Answer:
    text: str
    verdict: str
    confidence: float
    citations: list[tuple[int, str]]


class Engine:
    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home = spark, home

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.home}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.home}/{name}")

    @staticmethod
    def _latest(rows: DataFrame, key: str) -> DataFrame:
        whole = F.max_by(F.struct(*rows.columns), "version").alias("r")
        return rows.groupBy(key).agg(whole).select("r.*").where("NOT removed").drop("removed")

    def documents(self) -> DataFrame:
        return self._latest(self._table("documents", DOCUMENT), "doc_id")

    def chunks(self) -> DataFrame:
        return self._table("chunks", CHUNK).join(self.documents().select("doc_id", "version"), ["doc_id", "version"], "left_semi")

    def registry(self) -> DataFrame:
        return self._latest(self._table("registry", TABLE), "name")

    # Ingest

    def ingest(self, path: str, pattern: str = "*") -> DataFrame:
        """Reads a folder; returns (path, error) of refused files. What a file had before is replaced, files that have
        not changed are left as they are. Sheets are registered as tables, and their cards become chunks."""
        # cards are made on the driver, one sheet file after another
        sheets = [f for f in files.listed(self.spark, path, pattern) if files.extension(f) in files.SHEET]
        refused = [(f, why) for f in sheets if (why := self._try_register(f))]
        staged = f"{self.home}/staging/{uuid.uuid4().hex}"
        found = self._stage(f"{staged}/elements", files.read(self.spark, path, pattern).where(~F.lower("path").rlike(r"\.(" + "|".join(x[1:] for x in files.SHEET) + ")$")))
        made = self._stage(f"{staged}/chunks", self._chunks_of(found, f"{staged}/items"))
        digest = F.sha1(F.concat_ws("\x1f", F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda c: c["text"])))
        new = made.groupBy("doc_id", "path", "source").agg(digest.alias("digest"))  # a file's own chunks
        known = self.documents().select("doc_id", F.col("digest").alias("_before"))
        version = int(time.time() * 1000)
        changed = new.join(known, "doc_id", "left").where("_before IS NULL OR _before <> digest").drop("_before").withColumns({"version": F.lit(version), "removed": F.lit(False)})
        self._commit(changed, made.drop("path"), version)
        empty = found.groupBy("path").agg(F.max("error").alias("error"), F.max((F.coalesce("text", F.lit("")) != "").cast("int")).alias("_any"))
        errors = empty.select("path", F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("_any") == 0, "no text could be extracted").alias("error")).where("error IS NOT NULL")
        told = [(r.path, r.error) for r in errors.collect()] + refused  # refused files
        self._remove(staged)
        return self.spark.createDataFrame(told, "path string, error string")

    def _stage(self, path: str, df: DataFrame) -> DataFrame:
        """df, written and read again, so that its files are parsed once."""
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _remove(self, path: str) -> None:
        old = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    def _chunks_of(self, found: DataFrame, staged: str) -> DataFrame:
        """doc_id, path, source, seq, kind, ordinal, page, section_path, body, text, parent, image_ref of elements of files."""
        elements = found.where("error IS NULL AND text <> ''").select("path", F.col("path").alias("doc_id"), "seq", F.col("element").alias("kind"), "text", "section_path", "page")
        titles = files.titles(found.where("error IS NULL")).withColumnRenamed("path", "doc_id")
        items = numbering.relocate_preambles(self._stage(staged, numbering.items_of_elements(elements)))
        shared = numbering.share_stimulus(items.withColumn("image_ref", F.lit(None).cast("string")))
        placed = shared.join(elements.select("doc_id", F.col("seq").alias("origin"), "section_path", "page"), ["doc_id", "origin"]).join(titles, "doc_id", "left")
        chunks = layout.chunk_elements(placed)
        more = placed.select("doc_id", F.col("seq").alias("at"), "page", "image_ref", "shared_context")
        whole = chunks.join(more, ["doc_id", "at"], "left").withColumn("parent", F.coalesce("shared_context", "parent"))
        source = F.element_at(F.split("doc_id", "/"), -1)
        return whole.select(tx.stable_id(F.col("doc_id")).alias("doc_id"), F.col("doc_id").alias("path"), source.alias("source"), "seq", "kind", "ordinal", "page", "section_path", "body", "text", "parent", "image_ref")

    def _commit(self, changed: DataFrame, chunks: DataFrame, version: int) -> None:
        """Writes chunks of changed documents, then the rows that make them count, then the index."""
        fresh = chunks.join(changed.select("doc_id"), "doc_id", "left_semi").withColumn("version", F.lit(version))
        fresh = fresh.withColumn("chunk_id", tx.stable_id(F.col("doc_id"), F.col("seq"), F.col("text")))
        vectors = embedding.vectors(fresh.select("chunk_id", "text"), ["chunk_id"], "text")
        before = self.documents().count()
        names = [c.split(" ")[0] for c in CHUNK.split(", ")]
        rows = changed.select(*[c.split(" ")[0] for c in DOCUMENT.split(", ")])
        self._append("chunks", fresh.join(vectors, "chunk_id", "left").select(*names))
        # chunks of this version are what the version's documents are made of
        written = self._table("chunks", CHUNK).where(F.col("version") == version).select("doc_id").distinct()
        self._append("documents", rows.join(written, "doc_id", "left_semi"))
        if before == 0 or not written.isEmpty():
            self._reindex(version)

    def _reindex(self, version: int) -> None:
        generation = uuid.uuid4().hex
        docs = self.chunks().select(F.col("chunk_id").alias("doc_id"), "text")
        if not docs.isEmpty():
            retrieval.Bm25Index(docs).write(f"{self.home}/index/{generation}")
            self._append("generations", self.spark.createDataFrame([(generation, version)], INDEX))

    def _try_register(self, path: str) -> str | None:
        try:
            self.register(path)
        except Exception as e:  # a bad file is a row, not a failed ingest
            return str(e)[:300]
        return None

    def register(self, path: str) -> list[str]:
        """Writes the tables of a CSV, TSV or XLSX file, in place of those the file had before, with a card for each in the
        index; returns their names. A name that another file has gets _x."""
        found, version = registry.load(self.spark, path), int(time.time() * 1000)
        source, doc_id = path.rsplit("/", 1)[-1], tx_id(self.spark, path)
        others = {r.name for r in self.registry().where(F.col("doc_id") != doc_id).select("name").collect()}  # registered tables
        self._drop_tables(F.col("doc_id") == doc_id, version - 1)
        rows, cards, names = [], [], []
        for seq, (name, df) in enumerate(found.items()):
            base = name
            while name in others or name in names:
                name += "_x"
            names.append(name)
            df.write.mode("overwrite").parquet(f"{self.home}/tables/{name}")
            held = self.spark.read.parquet(f"{self.home}/tables/{name}")
            kept, total = held.count(), registry.total_rows(df)
            card = registry.card(held, name, source)
            sheet = base.partition("__")[2] or None
            rows.append((name, source, sheet, doc_id, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.schema.fields), total if total is not None else kept, kept, card, version, False))
            cards.append((doc_id, source, seq, CARD, [name], card, f"[{name}]\n{card}"))
        if not rows:
            raise ValueError(f"no readable rows: {path}")
        self._append("registry", self.spark.createDataFrame(rows, TABLE))
        chunks = self.spark.createDataFrame(cards, "doc_id string, source string, seq int, kind string, section_path array<string>, body string, text string")
        nothing = {"ordinal": F.lit(None).cast("int"), "page": F.lit(None).cast("int"), "parent": F.lit(None).cast("string"), "image_ref": F.lit(None).cast("string")}
        document = self.spark.createDataFrame([(doc_id, path, source, "", version, False)], DOCUMENT)
        self._commit(document, chunks.withColumns(nothing), version)
        return names

    def _drop_tables(self, which, version: int) -> None:
        gone = self.registry().where(which).withColumns({"version": F.lit(version), "removed": F.lit(True)})
        if not gone.isEmpty():
            self._append("registry", gone.select(*[c.split(" ")[0] for c in TABLE.split(", ")]))

    def delete(self, source: str) -> int:
        """Removes a file's chunks and tables; returns how many chunks it had."""
        version = int(time.time() * 1000)
        n = self.chunks().where(F.col("source") == source).count()
        gone = self.documents().where(F.col("source") == source).withColumns({"version": F.lit(version), "removed": F.lit(True)})
        self._append("documents", gone.select(*[c.split(" ")[0] for c in DOCUMENT.split(", ")]))
        self._drop_tables(F.col("source") == source, version)
        self._reindex(version)
        return n

    # Search

    def _sparse(self, query: str) -> DataFrame | None:
        found = self._table("generations", INDEX).orderBy(F.col("version").desc()).first()
        return retrieval.Postings(self.spark, f"{self.home}/index/{found.generation}").scores(query) if found else None

    def search(self, query: str, k: int = retrieval.TOP_K, sources: list[str] | None = None) -> DataFrame:
        """Chunks with score and ranks, best first. No sources means all; statistics are of all chunks."""
        chunks, sparse = self.chunks(), self._sparse(query)
        if sparse is None:
            return chunks.limit(0).withColumns({"score": F.lit(0.0), "dense_rank": F.lit(0), "sparse_rank": F.lit(0)})
        asked = self.spark.createDataFrame([(1, query)], "one int, text string")
        vector = embedding.vectors(asked, ["one"], "text", name="qv").select("qv")
        scope = chunks.where(F.col("source").isin(sources)).select(F.col("chunk_id").alias("id")) if sources else chunks.select(F.col("chunk_id").alias("id"))
        near = retrieval.dense(chunks.where("embedding IS NOT NULL"), vector, "chunk_id")
        fused = retrieval.fuse(retrieval.top(near.join(scope, "id", "left_semi"), retrieval.CANDIDATES), retrieval.top(sparse.join(scope, "id", "left_semi"), retrieval.CANDIDATES))
        hits = fused.orderBy(*retrieval.best_first(fused)).limit(k)
        full = chunks.drop("embedding").join(F.broadcast(hits), F.col("chunk_id") == F.col("id")).drop("id")  # k rows
        return full.orderBy(*retrieval.best_first(hits))

    def pinned(self, ordinals: list[int], sources: list[str] | None = None) -> DataFrame:
        """Chunks of the numbered items, ties kept; -1 is each file's last."""
        chunks = self.chunks().where("ordinal IS NOT NULL")
        chunks = chunks.where(F.col("source").isin(sources)) if sources else chunks
        last = F.rank().over(Window.partitionBy("source").orderBy(F.col("ordinal").desc()))
        return chunks.withColumn("_last", last).where(F.col("ordinal").isin([n for n in ordinals if n > 0]) | (F.lit(planner.LAST in ordinals) & (F.col("_last") == 1))).drop("_last")

    # Answers

    def passages(self, p: planner.Plan, question: str, sources: list[str] | None = None) -> tuple[list[Row], bool]:
        """The passages of a question, at most a few dozen rows on the driver, and whether a table's card was among the hits."""
        found: dict[str, Row] = {}
        card = False
        for q in p.sub_queries:
            for r in self.search(q, retrieval.TOP_K, sources).collect():  # at most TOP_K rows
                card = card or r.kind == CARD
                if r.kind != CARD and (r.chunk_id not in found or r.score > found[r.chunk_id].score):
                    found[r.chunk_id] = r
        best = sorted(found.values(), key=lambda r: -r.score)[: retrieval.TOP_K]
        if p.broad and (targets := sources or [r.source for r in best][:1]):
            if not sources:  # the document that most passages are from
                targets = [max({r.source for r in best}, key=lambda s: (sum(r.source == s for r in best), -next(i for i, r in enumerate(best) if r.source == s)))]
            whole = self.chunks().where(F.col("source").isin(targets) & (F.col("kind") != CARD)).withColumn("query_id", F.lit(1))
            best = passages.whole_document(whole).drop("embedding", "query_id").withColumns({"score": F.lit(STRONG), "dense_rank": F.lit(1), "sparse_rank": F.lit(1)}).orderBy("source", "seq").collect()  # within the token budget
        elif p.ordinals:
            pins = {r.chunk_id: r for r in self.pinned(p.ordinals, sources).orderBy("source", "seq").limit(passages.MOST).collect()}
            rest = [r for r in best if r.chunk_id not in pins and min(r.dense_rank or 99, r.sparse_rank or 99) <= passages.PAD_RANK]
            if pins:
                best = [Row(**pins[k].asDict(), score=STRONG, dense_rank=1, sparse_rank=1) for k in pins] + rest[: passages.PADS]
        return best, card

    def ask(self, question: str, sources: list[str] | None = None, propose: Callable[[str, str, str | None], str] | None = None, solve: Callable[[str], str] | None = None, votes: int = 3) -> Answer:
        """Sentences of the passages, and the result of a query over tables first, cited and verified.

        propose(question, tables, error) gives SQL; the default is a rule. solve(task) answers a pinned item with options
        or an image that the documents do not: `votes` times, and the majority counts.
        """
        p = planner.plan(question)
        if p.intent == "chitchat":
            return Answer("Ask me about the documents.", "chitchat", 1.0, [])
        best, card = self.passages(p, question, sources)
        table = self._ask_tables(question, sources, propose) if p.needs_tables or card else None
        rows = self._on_topic(question, p, best, table is not None)
        cited = ([(table[1], table[0], True)] if table else []) + [(r.source, r.parent if len(r.parent or "") > len(r.body) else r.body, False) for r in rows]
        blocks = self.spark.createDataFrame([(1, n, text, trusted) for n, (_, text, trusted) in enumerate(cited, 1)], "answer_id int, n int, source_text string, trusted boolean")
        draft = self.draft(question, blocks, table)
        signal = min(1.0, max((r.score for r in best), default=0.0) / STRONG) if best else None
        drafts = self.spark.createDataFrame([(1, draft, signal, False, table is not None)], "answer_id int, draft string, signal double, chitchat boolean, has_tables boolean")
        got = answers.verify(drafts, blocks).first()
        if got.verdict == "refuse" and solve and p.ordinals:
            task = next((r for r in rows if r.ordinal in p.ordinals or planner.LAST in p.ordinals), None)
            if task and self.spark.createDataFrame([(task.body, task.image_ref)], "body string, image string").select(passages.may_solve(F.lit("refuse"), F.lit(True), F.col("body"), F.col("image"))).first()[0]:
                return self._solved(task, solve, votes)
        return Answer(got.answer, got.verdict, got.confidence, [(n, cited[n - 1][0]) for n in got.kept])

    def _solved(self, task: Row, solve: Callable[[str], str], votes: int) -> Answer:
        replies = self.spark.createDataFrame([(1, solve(task.body)) for _ in range(votes)], "item int, reply string")
        verdict = answers.majority(replies.select("item", answers.answer_key(F.col("reply")).alias("k"))).first().verdict
        if verdict in ("CANT", "inconsistent"):
            return Answer(answers.REFUSAL, "refuse", 0.0, [])
        return Answer(f"{SOLVED}Question {task.ordinal}: {verdict}", "solved", 0.0, [])

    def _on_topic(self, question: str, p: planner.Plan, best: list[Row], computed: bool) -> list[Row]:
        """The passages that an answer sees, in their order."""
        if not best:
            return []
        rows = self.spark.createDataFrame([(1, i, question, p.intent, p.broad, r.source, r.kind, r.body, -float(i)) for i, r in enumerate(best)], "query_id int, id int, question string, intent string, broad boolean, source string, kind string, body string, score double")
        rows = passages.on_topic(rows) if computed and not p.broad else rows
        rows = rows if p.broad else passages.own_charts(rows)
        return [best[r.id] for r in passages.capped(rows).orderBy("n").collect()]

    def _ask_tables(self, question: str, sources: list[str] | None, propose) -> tuple[str, str] | None:
        """The result of a query over the registered tables in scope, as text, and what to cite; None without one."""
        known = self.registry()
        held = (known.where(F.col("source").isin(sources)) if sources else known).orderBy("name").collect()  # registered tables
        if not held:
            return None
        tables = {r.name: [tuple(c.split(" ", 1)) for c in r.columns.split(", ")] for r in held}
        for name in tables:
            self.spark.read.parquet(f"{self.home}/tables/{name}").createOrReplaceTempView(name)
        schema = "\n\n".join(r.card for r in held)
        said: list[str] = []

        def ask(error: str | None) -> str:
            said.append(propose(question, schema, error) if propose else "" if error else planner.table_sql(question, tables))
            return said[-1]

        df, _ = guard.answer(self.spark, ask, tables)
        if df is None:
            return None
        return f"SQL: {said[-1]}\n{registry.markdown(df, 25)}", "spreadsheet query"

    def draft(self, question: str, blocks: DataFrame, table: tuple[str, str] | None = None, most: int = 3) -> str:
        first = []
        if table:
            lines = [x.strip("| ").replace(" | ", ", ") for x in table[0].split("\n") if x.startswith("|")]
            first = [f"By {lines[0]} the tables give {'; '.join(lines[2:12])}. [1]"] if len(lines) > 2 else []
        wanted = tx.writing_keywords(F.lit(question))
        sents = blocks.where("NOT trusted").select("n", F.posexplode(tx.sentences(F.col("source_text"))).alias("pos", "s")).withColumn("hits", F.size(F.array_intersect(tx.writing_keywords(F.col("s")), wanted)))
        w = Window.partitionBy("n").orderBy(F.col("hits").desc(), "pos")
        top = sents.where("hits > 0").withColumn("r", F.row_number().over(w)).where("r = 1").orderBy(F.col("hits").desc(), "n").limit(most)
        return " ".join(first + [f"{r.s} [{r.n}]" for r in top.collect()])

    # Tables

    def tables(self) -> list[str]:
        return [r.name for r in self.registry().select("name").orderBy("name").collect()]

    def sql(self, text: str, tables: list[str] | None = None) -> DataFrame:
        """One read-only statement over registered tables (all, or the named ones)."""
        scope = [t for t in self.tables() if tables is None or t in tables]
        for t in scope:
            self.spark.read.parquet(f"{self.home}/tables/{t}").createOrReplaceTempView(t)
        return guard.run_sql(self.spark, text, scope)

    def stats(self) -> tuple[int, int]:
        """Numbers of chunks and of files."""
        r = self.chunks().agg(F.count("*").alias("c"), F.count_distinct("source").alias("f")).first()
        return r.c, r.f


def tx_id(spark: SparkSession, path: str) -> str:
    return spark.range(1).select(tx.stable_id(F.lit(path))).first()[0]


