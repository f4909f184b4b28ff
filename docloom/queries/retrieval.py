"""Hybrid retrieval over documents and embeddings; benchmark item 0 is the query."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import embedding
from ..operators import retrieval as op
from .base import Registry

REGISTRY = R = Registry()

BASE = """WITH tok AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS toks FROM documents),
dl AS (SELECT id, len(toks) AS dl FROM tok), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
p AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(toks) AS term FROM tok) GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM p GROUP BY term), r AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM d, st),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM r) ELSE raw END AS idf FROM r),
q AS (SELECT term, count(*) AS qn FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)) GROUP BY term),
sc AS (SELECT p.id, round(sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM p JOIN q USING (term) JOIN idf USING (term) JOIN dl USING (id), st GROUP BY p.id HAVING score > 0),
sp AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= 40),
dn0 AS (SELECT vec_id AS id, round(list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings),
dn AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM dn0 QUALIFY rank <= 40),
fu AS (SELECT coalesce(dn.id, sp.id) AS id, dn.rank AS dense_rank, sp.rank AS sparse_rank, round(coalesce(1.0 / (60 + dn.rank), 0) + coalesce(1.0 / (60 + sp.rank), 0), 9) AS score FROM dn FULL OUTER JOIN sp ON dn.id = sp.id)
"""


def docs(s, d):
    return s.read.parquet(f"{d}/documents.parquet")


def query(s, d):
    b = s.read.parquet(f"{d}/benchmark.parquet")
    return b.orderBy("item_id").limit(1)


def vectors(s, d):
    return s.read.parquet(f"{d}/embeddings.parquet")


def query_vector(s, d):
    return vectors(s, d).where("vec_id = 0").select(F.col("embedding").alias("qv"))


def sparse(s, d):
    return op.Bm25Index(docs(s, d)).scores(op.query_terms(query(s, d)))


def fused(s, d):
    return op.fuse(op.top(op.dense(vectors(s, d), query_vector(s, d)), 40), op.top(sparse(s, d), 40))


R["bm25_idf"] = (lambda s, d: op.Bm25Index(docs(s, d)).idf.select("term", "df", F.round("idf", 6).alias("idf")), BASE + "SELECT term, df, round(idf, 6) AS idf FROM idf")
R["bm25_scores"] = (sparse, BASE + "SELECT id, score FROM sc")
R["bm25_topk"] = (lambda s, d: op.top(sparse(s, d), 40), BASE + "SELECT id, score, rank FROM sp")
R["dense_topk"] = (lambda s, d: op.top(op.dense(vectors(s, d), query_vector(s, d)), 40), BASE + "SELECT id, score, rank FROM dn")
R["rrf_fusion"] = (fused, BASE + "SELECT id, dense_rank, sparse_rank, score FROM fu")
R["hybrid_topk"] = (
    lambda s, d: op.hybrid(docs(s, d), vectors(s, d), query(s, d), query_vector(s, d)),
    BASE + "SELECT id, dense_rank, sparse_rank, score FROM fu ORDER BY score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST LIMIT 8",
)
R["rrf_payload"] = (
    lambda s, d: docs(s, d).join(F.broadcast(op.hybrid(docs(s, d), vectors(s, d), query(s, d), query_vector(s, d))), F.col("doc_id") == F.col("id")).select("doc_id", "lang", "source", "score"),
    BASE + "SELECT doc_id, lang, source, score FROM documents JOIN (SELECT id, score FROM fu ORDER BY score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST LIMIT 8) t ON id = doc_id",
)
MANY = (
    BASE.replace("q AS (SELECT term, count(*) AS qn FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)) GROUP BY term)", "q AS (SELECT item_id, term, count(*) AS qn FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY ALL)")
    .replace("sc AS (SELECT p.id, round", "sc AS (SELECT item_id, p.id, round").replace("GROUP BY p.id HAVING", "GROUP BY item_id, p.id HAVING").replace("sp AS (SELECT id, score, row_number() OVER (ORDER", "sp AS (SELECT item_id, id, score, row_number() OVER (PARTITION BY item_id ORDER")
    .split("dn0 AS")[0]
    + """dn AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE {w} QUALIFY rank <= 40)
"""
)


def all_questions(s, d):
    return s.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")


def question_vectors(s, d):
    return vectors(s, d).join(all_questions(s, d).select("query_id"), F.col("vec_id") == F.col("query_id")).select("query_id", F.col("embedding").alias("qv"))


R["bm25_batch"] = (lambda s, d: op.sparse_many(op.Bm25Index(docs(s, d)), all_questions(s, d)).select("query_id", "id", "score", "rank"), MANY.format(w="true") + "SELECT item_id AS query_id, id, score, rank::INT AS rank FROM sp")
R["dense_batch"] = (lambda s, d: op.dense_many(vectors(s, d), vectors(s, d).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))), MANY.format(w="a.vec_id % 100 = 0") + "SELECT query_id, id, score, rank::INT AS rank FROM dn")
R["hybrid_batch"] = (
    lambda s, d: op.fuse_many(op.dense_many(vectors(s, d), question_vectors(s, d)), op.sparse_many(op.Bm25Index(docs(s, d)), all_questions(s, d))),
    MANY.format(w="a.vec_id IN (SELECT item_id FROM benchmark)")
    + """, fu AS (SELECT coalesce(dn.query_id, sp.item_id) AS query_id, coalesce(dn.id, sp.id) AS id, dn.rank AS dense_rank, sp.rank AS sparse_rank, round(coalesce(1.0 / (60 + dn.rank), 0) + coalesce(1.0 / (60 + sp.rank), 0), 9) AS score FROM dn FULL OUTER JOIN sp ON dn.query_id = sp.item_id AND dn.id = sp.id)
SELECT query_id, id, dense_rank::INT AS dense_rank, sparse_rank::INT AS sparse_rank, score FROM fu QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST) <= 8""",
)
SCOPE = "SELECT doc_id FROM documents WHERE source IN ('src1', 'src2', 'src3', 'src4') AND lang IN ('en', 'fr')"
R.sql("scope_filter", SCOPE)
R.sql("scope_semi", f"SELECT l.doc_id, l.quality FROM labels l SEMI JOIN ({SCOPE}) s ON l.doc_id = s.doc_id")


@R.build("hybrid_scoped", BASE.replace("FROM sc QUALIFY", f"FROM sc WHERE id IN ({SCOPE}) QUALIFY").replace("FROM dn0 QUALIFY", f"FROM dn0 WHERE id IN ({SCOPE}) QUALIFY") + "SELECT id, dense_rank, sparse_rank, score FROM fu ORDER BY score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST LIMIT 8")
def hybrid_scoped(s, d):
    scope = docs(s, d).where("source IN ('src1', 'src2', 'src3', 'src4') AND lang IN ('en', 'fr')").select(F.col("doc_id").alias("id"))
    return op.hybrid(docs(s, d), vectors(s, d), query(s, d), query_vector(s, d), scope)


R["retrieval_signal"] = (
    lambda s, d: op.hybrid(docs(s, d), vectors(s, d), query(s, d), query_vector(s, d)).agg(F.round(F.least(F.lit(1.0), F.coalesce(F.max("score"), F.lit(0.0)) / (2.0 / 61)), 6).alias("signal")),
    BASE + "SELECT round(least(1.0, max(score) / (2.0 / 61)), 6) AS signal FROM fu",
)
R["dominant_source"] = (
    lambda s, d: docs(s, d).join(F.broadcast(op.top(sparse(s, d), 40)), F.col("doc_id") == F.col("id")).groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(1),
    BASE + "SELECT source, count(*) AS n FROM documents JOIN sp ON id = doc_id GROUP BY source ORDER BY n DESC, source LIMIT 1",
)
HITS = "SELECT * FROM VALUES (1, 10, 0.5), (1, 11, 0.4), (2, 10, 0.5), (2, 11, 0.9), (2, 12, 0.4), (3, 13, 0.1) AS t(query_no, id, score)"
R["broad_budget"] = (
    lambda s, d: op.within_budget(docs(s, d).select("source", "doc_id", F.floor(F.length("text") / 4).alias("tokens")), "tokens", ["doc_id"], 6000, ["source"]).select("source", "doc_id"),
    "SELECT source, doc_id FROM (SELECT source, doc_id, sum(length(text) // 4) OVER w AS c, row_number() OVER w AS rn FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)) WHERE c <= 6000 OR rn = 1",
)
R.sql("index_scan", "SELECT vec_id, label FROM embeddings")
R.sql("index_stats", "SELECT count(*) AS chunks, count(DISTINCT source) AS files FROM documents")
R.sql("doc_ids_for", "SELECT source, array_join(array_sort(collect_set(doc_id)), ',') AS ids FROM documents GROUP BY source", "SELECT source, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM documents GROUP BY source")
R.sql("doc_reading_order", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(turn, 0)) AS pos FROM conversations")
R.sql("ordinal_exact", "SELECT conv_id, text FROM conversations WHERE turn = 3")
R.sql("ordinal_last", "SELECT conv_id, turn FROM (SELECT conv_id, turn, rank() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) t WHERE r = 1")
R.sql("upsert_new_chunks", "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
R.sql("delete_doc", "SELECT doc_id, source FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) t USING (doc_id)")
R.sql("union_cards_chunks", "SELECT 'card' AS kind, n_name AS body FROM nation UNION ALL SELECT 'chunk', text FROM documents")
R.sql("distinct_sets", "SELECT lang, count(DISTINCT source) AS sources, min(doc_id) AS first_id FROM documents GROUP BY lang")
R["rerank_seam"] = (
    lambda s, d: op.rerank(fused(s, d), docs(s, d), query(s, d), 8),
    BASE.replace("WITH tok", "WITH qt AS (SELECT list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS qw FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)), tok")
    + """, cut AS (SELECT * FROM fu ORDER BY score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST LIMIT 32)
SELECT id, score, round(len(list_intersect(qw, regexp_extract_all(lower(text), '[a-z0-9]+'))) / len(qw), 6) AS rerank_score FROM cut JOIN documents ON id = doc_id, qt
ORDER BY rerank_score DESC, score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST LIMIT 8""",
)
R["embed_buckets"] = (lambda s, d: embedding.buckets(docs(s, d), ["doc_id"], "text"), "SELECT doc_id, (('0x' || substr(sha1(term), 1, 8))::BIGINT % 64)::INT AS bucket, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY 1, 2")
