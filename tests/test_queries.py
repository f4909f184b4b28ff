"""Queries over small tables of odd rows, next to their DuckDB SQL."""

import random
import struct

import duckdb
from pyspark.sql import functions as F

from docloom.operators import retrieval
from docloom.queries import REGISTRY


def rows_of_both(spark, tmp_path, name, **tables):
    """Sorted rows of the query and of its SQL over the given frames."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    build, sql = REGISTRY[name]
    got = build(spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
    key = lambda r: [(x is None, str(x)) for x in r]
    return sorted((tuple(r) for r in got.collect()), key=key), sorted(want, key=key)


def test_titles_with_cut_references(spark, tmp_path):
    heads = ["no heading", "a &amp; b&amp", "say &quot;x&quot;", "odd", "&lt;i&gt; &amp;lt; &amp", "&eacute; &copy &#65; & &&amp;", "odd", "end &quot"]
    pages = spark.createDataFrame([(i, f"<html><h1>{h}</h1><p>t</p></html>") for i, h in enumerate(heads)], "page_id long, html string")
    got, want = rows_of_both(spark, tmp_path, "doc_title", pages=pages)
    assert got == want and ("p1.html", "a & b&amp") in got


def odd_vectors(spark):
    """Random vectors, many copies of one, and vectors with nulls, other lengths, zeros and no numbers."""
    rng = random.Random(5)
    rows = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(250)] + [[0.5, 0.5, -0.5, 0.5, 0.1, 0.0]] * 60 + [None, [1.0], [1.0] * 5 + [None], [0.0] * 6, []]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>")


def exact(v):
    return None if v is None else [None if x is None else struct.unpack("f", struct.pack("f", x))[0] for x in v]


def dot(a, b):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return None
    return sum(x * y for x, y in zip(a, b, strict=True))


def asked_of(df, every=9):
    return df.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))


def test_dense_many_holds_the_best_in_tasks(spark):
    rows, df = odd_vectors(spark)
    found = retrieval.dense_many(df.repartition(3), asked_of(df), k=20, block=10)
    assert "MapInArrow" in found._jdf.queryExecution().toString()  # pairs are not rows of a join
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.id, r.score)
    for q in range(0, len(rows), 9):
        scores = [(i, dot(exact(v), exact(rows[q]))) for i, v in enumerate(rows)]
        scores = [(i, None if s is None else round(s, 6) + 0.0) for i, s in scores]
        want = sorted(scores, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))[:20]
        assert [got[q][n] for n in range(1, 21)] == want


def test_cosine_many(spark):
    rows, df = odd_vectors(spark)
    found = retrieval.cosine_many(df.repartition(3), asked_of(df), block=10)
    got = {(r.query_id, r.id): r.score for r in found.collect()}
    assert "MapInArrow" in found._jdf.queryExecution().toString() and len(got) == len(rows) * len(range(0, len(rows), 9))
    for (q, i), score in got.items():
        a, b = exact(rows[q]), exact(rows[i])
        want = dot(a, b)
        assert score == (None if want is None else round(want / ((dot(a, a) * dot(b, b)) ** 0.5 or 1.0), 5) + 0.0)


def odd_texts(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["the", "Of", "É", "KK"]
    text = lambda n: " ".join(rng.choice(words[: rng.choice([4, 64])] + ["the"] * 9) for _ in range(n))
    docs = [text(rng.randint(1, 90)) for _ in range(150)] + ["the same copy w1 w2"] * 60 + [None, "", "..."]
    asked = [text(rng.randint(1, 30)) for _ in range(9)] + [None, "", "unseen", "the the the", "w1 w2 copy"]
    vectors = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(len(docs))]
    return {
        "documents": spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"),
        "benchmark": spark.createDataFrame(list(enumerate(asked)), "item_id long, text string"),
        "embeddings": spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>"),
    }


def test_bm25_batch_scores_a_document_in_its_task(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(retrieval, "HELD_ROWS", 64)
    tables = odd_texts(spark)
    got, want = rows_of_both(spark, tmp_path, "bm25_batch", **tables)
    assert got == want and len(got) > 300
    index = retrieval.Bm25Index(tables["documents"].repartition(3))
    found = retrieval.sparse_many(index, tables["benchmark"].withColumnRenamed("item_id", "query_id"), block=3)
    assert "MapInArrow" in found._jdf.queryExecution().toString()  # occurrences of terms are not rows of a join
    assert sorted(tuple(r) for r in found.select("query_id", "id", "score", "rank").collect()) == sorted(got)


def test_hybrid_batch(spark, tmp_path):
    tables = odd_texts(spark)
    build, _ = REGISTRY["hybrid_batch"]
    got, want = rows_of_both(spark, tmp_path, "hybrid_batch", **tables)
    assert got == want and len(got) == 8 * tables["benchmark"].count()
    assert build(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2


def test_document_frequencies_are_shuffled_once(spark):
    index = retrieval.Bm25Index(odd_texts(spark)["documents"])
    found = index.idf.join(spark.createDataFrame([("w1",), ("of",)], "term string"), "term")
    assert found.count() == 2 and len(found.collect()) == 2
    final = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("Generate explode") == 1  # the mean of all terms reads the shuffle that the join reads
