import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import layout, retrieval
from docloom.plans import guard, registry
from docloom.queries import REGISTRY
from docloom.sources import files
from docloom.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_every_query_runs(spark):
    for name, (build, _) in REGISTRY.items():
        assert build(spark, SF).columns, name


@pytest.mark.parametrize("sql", ["DROP TABLE t", "DELETE FROM t", "INSERT INTO t VALUES (1)", "SELECT * FROM other", "SELECT 1; SELECT 2", "SELECT * FROM parquet.`/etc/x`", "SELECT * FROM t WHERE a IN (SELECT a FROM other)", "WITH x AS (SELECT * FROM other) SELECT * FROM x", "SET a=b", "SELECT * FROM range(5)"])
def test_guard_rejects(spark, sql):
    with pytest.raises(guard.GuardError):
        guard.check(spark, sql, ["t"])


def test_guard_accepts_and_caps(spark):
    spark.range(500).withColumnRenamed("id", "a").createOrReplaceTempView("t")
    assert guard.run_sql(spark, "SELECT a FROM t WHERE 'delete' <> 'drop'", ["t"]).count() == 200
    assert guard.run_sql(spark, "SELECT a FROM t\nLIMIT 300", ["t"]).count() == 300
    assert guard.run_sql(spark, "WITH x AS (SELECT a FROM t) SELECT count(*) FROM x", ["t"]).first()[0] == 500
    tries = iter(["SELECT nope FROM t", "SELECT max(a) AS m FROM t"])
    df, errors = guard.answer(spark, lambda e: next(tries), ["t"])
    assert df.first().m == 499 and len(errors) == 1
    assert guard.answer(spark, lambda e: "", ["t"]) == (None, [])


def test_columns_and_card(spark):
    assert registry.clean_columns(["Q3 Budget", "Q3 budget", "x", "Unnamed: 3", "2026"]) == ["q3_budget", "q3_budget_1", "x", "col_3", "c_2026"]
    assert "2 rows" in registry.card(spark.range(2), "n", "n.csv") and "id BIGINT" in registry.card(spark.range(2), "n", "n.csv")


def test_sentences_and_numbers(spark):
    rows = spark.createDataFrame([("One is here. [1] Two follows! Three?",), ("",), ("made 2.46M of 2,460,000",)], "t string")
    got = [r[0] for r in rows.select(tx.sentences(F.col("t"))).collect()]
    assert got[:2] == [["One is here. [1]", "Two follows!", "Three?"], []]
    assert {2.46, 2460000.0} <= set(rows.select(tx.numbers(F.col("t"))).collect()[2][0])


def test_parsers():
    md = "---\ntitle: x\n---\n# A\ntext  here\n\nSub\n---\n```py\nx\n```\n"
    assert list(files.parse_text(md)) == [("heading", 1, "A"), ("paragraph", None, "text here"), ("heading", 2, "Sub"), ("code", None, "```py\nx\n```")]
    html = files.html_text("<html><script>no()</script><style>p{}</style><h1>Billing</h1><p>pay</p><h2>Refunds</h2><table><tr><td>a</td><td>b</td></tr></table></html>")
    assert "no()" not in html and "p{}" not in html and html.startswith("# Billing") and "## Refunds" in html and "a | b" in html
    assert [t for _, _, t in files.parse_code("import x\ndef a():\n  pass\nclass B:\n  y = 1\n")] == ["import x", "def a():\n  pass", "class B:\n  y = 1"]
    assert files.kind_of("a.txt", b"%PDF-1.4") == "pdf" and files.kind_of("x.bin", bytes(range(128, 256))) is None and files.kind_of("noext", b"plain words") == "text"


def test_files_to_elements(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\n## U\nbody\n")
    (tmp_path / "b.csv").write_bytes("\ufeffx;y\n1;2\nragged\n3;4\n".encode())
    (tmp_path / "c.txt").write_text("")
    (tmp_path / "d.bin").write_bytes(bytes(range(128, 256)))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="u"><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:t>Head</w:t></w:p><w:p><w:t>para</w:t></w:p></w:document>')
    (tmp_path / "e.docx").write_bytes(buf.getvalue())
    got = {}
    for r in files.read(spark, f"file://{tmp_path}").collect():
        got.setdefault(r.path.rsplit("/", 1)[-1], []).append(r)
    assert [(r.element, list(r.section_path)) for r in got["a.md"]] == [("heading", ["T"]), ("heading", ["T", "U"]), ("paragraph", ["T", "U"])]
    assert got["b.csv"][0].text == "| x | y |\n| 1 | 2 |\n| 3 | 4 |"
    assert got["c.txt"][0].error == "empty file" and "unrecognised" in got["d.bin"][0].error
    assert [(r.element, r.text) for r in got["e.docx"]] == [("heading", "Head"), ("paragraph", "para")]


def plain_pack(sizes, target, overlap):
    out, first, total = [], 0, 0
    for i, x in enumerate(sizes):
        if total and total + x > target:
            out.append((first, i - 1))
            n = s = 0
            while n < i and not (n and s >= overlap):
                n += 1
                s += sizes[i - n]
            first = max(i - n, first + 1)
            total = sum(sizes[first:i])
        total += x
    return [*out, (first, len(sizes) - 1)] if sizes else out


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.integers(1, 60), max_size=30), min_size=1, max_size=20))
def test_pack(spark, lists):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "id int, s array<long>")
    got = {r.id: [(c.first, c.last) for c in r.c] for r in df.select("id", layout.pack(F.col("s"), 80, 16).alias("c")).collect()}
    for i, x in enumerate(lists):
        assert got[i] == plain_pack(x, 80, 16)
        assert {k for a, b in got[i] for k in range(a, b + 1)} == set(range(len(x)))


def test_fusion_is_symmetric(spark):
    a, b = (spark.createDataFrame([(i + o, i + 1) for i in range(5)], "id long, rank long") for o in (0, 2))
    one, two = ({r.id: r.score for r in retrieval.fuse(x, y).collect()} for x, y in ((a, b), (b, a)))
    assert one == two


def test_streams(spark, tmp_path):
    events = jobs.stream_table(spark, SF, "events")
    q = jobs.tumbling_counts(events).writeStream.format("memory").queryName("tumbling").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = spark.read.parquet(f"{SF}/events.parquet")
    assert spark.table("tumbling").agg(F.sum("n")).first()[0] == batch.count()
    for k in range(2):  # the second run adds nothing
        jobs.ingest_new(jobs.stream_table(spark, SF, "events"), str(tmp_path / "t"), "event_id", str(tmp_path / f"c{k}")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "t")).count() == batch.count()
