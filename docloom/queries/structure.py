"""Layout, parsing and answer checking on documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers, layout, numbering
from ..sources import files
from .base import Registry
from .textual import documents

REGISTRY = R = Registry()


#: Each document's pieces of at most 480 tokens: the text, else its lines, else their sentences packed.
PIECES = r"""WITH x AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: l <> '') AS lines FROM documents),
y AS (SELECT doc_id, CASE WHEN greatest(1, length(text) // 4) <= 480 OR len(lines) = 0 THEN [text] ELSE flatten(list_transform(lines, lambda l: CASE WHEN greatest(1, length(l) // 4) <= 480 THEN [l] ELSE
  list_reduce(list_transform(string_split(regexp_replace(l, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: [s]),
    lambda a, s: CASE WHEN greatest(1, length(a[-1] || ' ' || s[1]) // 4) > 480 THEN list_concat(a, s) ELSE list_concat(a[:-2], [a[-1] || ' ' || s[1]]) END) END)) END AS pieces FROM x)"""
PACKED = PIECES.replace("WITH x", "WITH RECURSIVE x") + """, z AS (SELECT doc_id, list_transform(list_filter(pieces, lambda p: trim(p) <> ''), lambda p: greatest(1, length(p) // 4)) AS sizes FROM y),
r AS (SELECT doc_id, sizes, 0 AS i, 0 AS first, 0::BIGINT AS total, 0 AS done_first, -1 AS done_last FROM z WHERE len(sizes) > 0
  UNION ALL SELECT doc_id, sizes, i + 1, CASE WHEN is_full THEN back ELSE first END, sizes[i + 1] + CASE WHEN is_full THEN coalesce(list_sum(sizes[back + 1 : i]), 0) ELSE total END, first, CASE WHEN is_full THEN i - 1 ELSE -1 END
  FROM (SELECT *, total > 0 AND total + sizes[i + 1] > 480 AS is_full, greatest(i - coalesce(list_min(list_filter(range(1, i + 1), lambda n: list_sum(sizes[i - n + 1 : i]) >= 64)), i), first + 1) AS back FROM r WHERE i < len(sizes))),
c AS (SELECT doc_id, sizes, done_first AS first, done_last AS last FROM r WHERE done_last >= 0 UNION ALL SELECT doc_id, sizes, first, i - 1 FROM r WHERE i = len(sizes))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1)::INT AS chunk_no, first::INT AS first, last::INT AS last, list_sum(sizes[first + 1 : last + 1])::BIGINT AS n_tokens FROM c"""
R["pack_chunks"] = (lambda s, d: layout.chunks(documents(s, d)).drop("body"), PACKED)
R.sql("session_context", """
SELECT conv_id, string_agg(concat(role, ': ', text), ' | ') WITHIN GROUP (ORDER BY turn) AS ctx, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) t WHERE r <= 4 GROUP BY conv_id""", """
SELECT conv_id, string_agg(concat(role, ': ', text), ' | ' ORDER BY turn) AS ctx, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) t WHERE r <= 4 GROUP BY conv_id""")
R["explode_long"] = (lambda s, d: documents(s, d).select("doc_id", F.posexplode(numbering.explode_long(F.col("text"))).alias("pos", "piece")), PIECES + " SELECT doc_id, unnest(range(0, len(pieces)))::INT AS pos, unnest(pieces) AS piece FROM y")
R["verify_answers"] = (
    lambda s, d: answers.verify(
        s.sql("SELECT * FROM VALUES (1, 'Refunds take 14 days after the return. [1] It costs 1,200 dollars. [2]', 1.0, false, true), (2, 'Nothing here is cited at all.', 0.9, false, false), (3, 'Hello!', CAST(NULL AS DOUBLE), true, false), (4, '', 0.5, false, false) AS t(answer_id, draft, signal, chitchat, has_tables)"),
        s.sql("SELECT * FROM VALUES (1, 1, 'refunds take 14 days after the return', false), (1, 2, 'total 1200', true), (1, 3, 'unused', false) AS t(answer_id, n, source_text, trusted)"),
    ).select("answer_id", "verdict", "confidence", F.array_join("kept", ",").alias("kept")),
    "SELECT * FROM (VALUES (1, 'ship', 0.95::DOUBLE, '1,2'), (2, 'refuse', 0.23::DOUBLE, ''), (3, 'chitchat', 1.0::DOUBLE, ''), (4, 'refuse', 0.0::DOUBLE, '')) AS t(answer_id, verdict, confidence, kept)",
)
R["guard_sizes"] = (lambda s, d: documents(s, d).select("doc_id", files.guard_column(F.octet_length("text"), 1 << 14).alias("error")), "SELECT doc_id, CASE WHEN strlen(text) = 0 THEN 'empty file' WHEN strlen(text) > 16384 THEN 'larger than 16384 bytes' END AS error FROM documents")
R["parse_text_elements"] = (lambda s, d: files.elements(s.read.parquet(f"{d}/pages.parquet").select(F.concat(F.lit("page"), "page_id", F.lit(".html")).alias("path"), F.encode("html", "utf-8").alias("content"))), None)
R["csv_tables"] = (lambda s, d: files.elements(s.createDataFrame([("a.csv", bytearray("\ufeffx;y\n1;2\nragged\n3;4\n".encode())), ("b.tsv", bytearray(b"p\tq\n\xe9\t|\n"))], "path string, content binary")).select("path", "text"), "SELECT * FROM (VALUES ('a.csv', '| x | y |' || chr(10) || '| 1 | 2 |' || chr(10) || '| 3 | 4 |'), ('b.tsv', '| p | q |' || chr(10) || '| é | \\| |')) AS t(path, text)")
