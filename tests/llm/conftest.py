import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared"))).config("spark.driver.memory", "3g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


TEXT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows and ids, a long text, and columns with clashing names."""
    long = " ".join(f"w{i % 97}" for i in range(4000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a b"), (4, "a b"), (5, "a  b"), (None, "a b"), (None, None), (6, long), (7, long), (8, "é" * 50), (9, "x " * 300)]
    df = spark.createDataFrame([(i, t, None if i == 4 else "en", "s", len(t or "")) for i, t in rows], TEXT)
    clashing = ["row", "key", "id", "sha", "_sha", "_src", "_lng", "_cnt", "_top", "_row", "words", "source_target", "weight", "score", "node", "n"]
    return df.selectExpr("*", "1 AS kept", "'z' AS _text", "2 AS part", "3 AS `_id`", *[f"{k} AS `{c}`" for k, c in enumerate(clashing)])
