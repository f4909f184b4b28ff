"""Text primitives, predicates and per-document scalars, over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import retrieval
from ..sources.files import CODE, IMAGE, SHEET, TEXTLIKE
from .base import Registry

REGISTRY = R = Registry()


def documents(s, d):
    return s.read.parquet(f"{d}/documents.parquet")


def values(columns: str, rows: str) -> tuple[str, str]:
    """The same literal rows for Spark and DuckDB."""
    return f"(SELECT * FROM VALUES {rows} AS t({columns}))", f"(SELECT * FROM (VALUES {rows}) AS t({columns}))"


def literal(name: str, columns: str, rows: str, spark_sql: str, duck_sql: str | None = None) -> None:
    """A query over literal rows; {t} is their place."""
    a, b = values(columns, rows)
    R.sql(name, spark_sql.replace("{t}", a), (duck_sql or spark_sql).replace("{t}", b))


def _in(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


R["token_estimates"] = (lambda s, d: documents(s, d).select("doc_id", tx.token_estimate(F.col("text")).alias("tokens")), "SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents")
R["stable_ids"] = (
    lambda s, d: documents(s, d).select("doc_id", tx.stable_id(F.col("source"), F.col("doc_id"), F.when(F.col("doc_id") > 5, F.col("lang"))).alias("sid")),
    "SELECT doc_id, substr(sha1(concat_ws(chr(31), source, doc_id::VARCHAR, coalesce(CASE WHEN doc_id > 5 THEN lang END, 'None'))), 1, 16) AS sid FROM documents",
)
R["clean_text"] = (
    lambda s, d: documents(s, d).select("doc_id", tx.clean(F.concat(F.lit("  \r\n"), F.col("text"), F.lit("\n\n\n\nend \t x "))).alias("body")),
    r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(chr(32) || chr(32) || chr(13) || chr(10) || text || chr(10) || chr(10) || chr(10) || chr(10) || 'end ' || chr(9) || ' x ', '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS body FROM documents",
)
R["tokens"] = (lambda s, d: documents(s, d).select("doc_id", F.size(tx.index_tokens(F.col("text"))).alias("n"), F.size(F.array_distinct(tx.index_tokens(F.col("text")))).alias("u")), "SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS u FROM documents")
R["keywords_syn"] = (lambda s, d: documents(s, d).select("doc_id", F.array_join(F.array_sort(tx.writing_keywords(F.col("text"))), " ").alias("kw")), f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({_in(tx.WRITING_STOP)})))), ' ') AS kw FROM documents")
R["keywords_ver"] = (lambda s, d: documents(s, d).select("doc_id", F.array_join(F.array_sort(tx.checking_keywords(F.col("text"))), " ").alias("kw")), f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+(?:[-.][a-z0-9]+)*'), lambda w: length(w) > 2 AND w NOT IN ({_in(tx.CHECKING_STOP)})))), ' ') AS kw FROM documents")
R["sentence_split"] = (
    lambda s, d: documents(s, d).select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence")),
    r"SELECT doc_id, (unnest(range(0, len(x))))::INT AS pos, unnest(x) AS sentence FROM (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda w: w <> '') AS x FROM documents)",
)
R["cosine_pairs"] = (
    lambda s, d: retrieval.cosine_many(v := s.read.parquet(f"{d}/embeddings.parquet"), v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))).toDF("i", "j", "cos"),
    "SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cos FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0",
)
R["needs_support"] = (lambda s, d: s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", tx.needs_support(F.col("text")).alias("needs")), r"SELECT conv_id, turn, length(trim(text, chr(10) || ' ')) >= 15 AND NOT regexp_matches(lower(trim(text, chr(10) || ' ')), '^(in summary|overall|note that|this means|in short)') AS needs FROM conversations")
R.sql("snippets", "SELECT doc_id, trim(substring(text, 1, 280)) AS snippet, substring(text, 1, 400) AS sql_snippet FROM documents")
R.sql("eval_filter", "SELECT item_id FROM benchmark WHERE lower(text) LIKE '%the%' ORDER BY item_id LIMIT 10")
EXT = "lower(regexp_extract(name, '(\\\\.[^./]+)$', 1))"
FILES = "(1, 'a.PDF', 'text'), (2, 'b.py', 'image'), (3, 'c.html', 'text'), (4, 'd.bin', 'zip'), (5, 'e.csv', 'text'), (6, 'f.zzz', 'none'), (7, 'g.md', 'pdf'), (8, 'h.jpeg', 'text'), (9, 'i.docx', 'zip')"
KIND = f"""CASE WHEN sniff = 'pdf' THEN 'pdf' WHEN sniff = 'image' AND ext NOT IN ({_in(CODE)}) THEN 'image' WHEN ext = '.pdf' THEN 'pdf' WHEN ext = '.docx' THEN 'docx' WHEN ext = '.pptx' THEN 'pptx'
WHEN ext IN ('.html', '.htm') THEN 'html' WHEN ext IN ({_in(TEXTLIKE)}) THEN 'text' WHEN ext IN ({_in(IMAGE)}) THEN 'image' WHEN ext IN ({_in(CODE)}) THEN 'code' WHEN sniff = 'zip' THEN 'docx' WHEN sniff = 'text' THEN 'text' ELSE 'error' END"""
STRIP = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ''{g}), '<[^>]+>', ' '{g}), '[ \t\n]+', ' '{g})"
R.sql("html_to_text", "SELECT page_id, trim(" + STRIP.replace("{g}", "").replace("'(?is)", "r'(?is)").replace("'[ \\t\\n]", "r'[ \\t\\n]") + ") AS body FROM pages", "SELECT page_id, trim(" + STRIP.replace("{g}", ", 'g'") + ") AS body FROM pages")
R.sql("html_h1", "SELECT page_id, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS h1 FROM pages")
R.sql("html_headings", "SELECT page_id, pos, h FROM (SELECT page_id, posexplode(regexp_extract_all(html, '(?s)<h[1-6][^>]*>(.*?)</h[1-6]>', 1)) AS (pos, h) FROM pages)", "SELECT page_id, unnest(range(0, len(x)))::INT AS pos, unnest(x) AS h FROM (SELECT page_id, regexp_extract_all(html, '(?s)<h[1-6][^>]*>(.*?)</h[1-6]>', 1) AS x FROM pages)")
R.sql("html_links", "SELECT page_id, explode(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages", "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages")
