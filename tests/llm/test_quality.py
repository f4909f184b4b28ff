from pyspark.sql import functions as F

from docloom.llm import quality


def test_every_label_counts(spark):
    labels = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert quality.trusted_ids(labels.unionByName(labels)).count() == 60_000


def test_trusted_texts_behind_a_full_bitmap(spark, monkeypatch):
    monkeypatch.setattr(quality, "MARKS", 8)
    monkeypatch.setattr(quality, "MARKS_PART", 8)
    texts = spark.range(500).select(F.col("id").cast("string").alias("_key"), F.concat(F.lit("t"), "id").alias("_text"))
    texts = texts.unionByName(texts.limit(50)).unionByName(spark.createDataFrame([(None, "none")], "_key string, _text string"))
    labels = spark.range(0, 900, 3).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(None).cast("int").alias("toxic"))
    got = quality._trusted_texts(texts, quality.trusted_ids(labels)).groupBy("_text").count()
    want = texts.where("CAST(_key AS INT) % 3 = 0").groupBy("_text").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_quantile(spark, monkeypatch):
    monkeypatch.setattr(quality, "FEW", 20)
    monkeypatch.setattr(quality, "CLASSES", 8)
    for df in (spark.range(997).selectExpr("pow(id % 313, 3) - 5 AS score"), spark.range(100).selectExpr("CAST(id % 2 AS DOUBLE) AS score"), spark.range(1).selectExpr("3D AS score"), spark.range(0).selectExpr("3D AS score")):
        for q in (0.0, 0.005, 0.5, 0.77, 1.0):
            want = df.agg(F.percentile("score", F.lit(q))).first()[0]
            got = quality._quantile(df, q)
            assert got == want or abs(got - want) <= 1e-9 * abs(want)
