import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from docloom.__main__ import main
from docloom.engine import Engine
from docloom.operators import answers, numbering, retrieval
from docloom.plans import evaluation, guard, planner, structured
from docloom.queries import REGISTRY
from docloom.sources import files, pdf
from docloom.streaming import jobs


def test_main_run(spark):
    rows = [([1, 2, 3, 1, 2, 3, 4, 5],), ([1, 2, 3],), ([1, 5, 9, 13],), ([],), ([7, 1, 2, 3, 5, 50, 51, 52, 53],)]
    got = [r[0] and tuple(r[0]) for r in spark.createDataFrame(rows, "n array<int>").select(numbering.main_run(F.col("n"))).collect()]
    assert got == [(3, 7), None, None, None, (1, 4)]


def test_items_of_odd_texts(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "1.20 and 2.30", "x")], "doc_id int, text string, kind string")
    assert [tuple(r) for r in numbering.items(df).collect()] == [(3, 0, "paragraph", None, "1.20 and 2.30")]
    assert not numbering.items(df.limit(0)).collect()


def test_shared_preamble(spark):
    text = "\n".join(f"{n}. Item {'Answer Questions 3-4 based on the figure.' if n == 2 else 'body'}" for n in range(1, 6))
    rows = numbering.share_preambles(numbering.items(spark.createDataFrame([(1, text)], "doc_id int, text string"))).collect()
    assert {r.ordinal for r in rows if r.shared_context} == {3, 4} and len(rows) == 5


@pytest.mark.parametrize(("text", "want"), [("stem a) one b) two", None), ("stem\na. 1\nc. 3\nb. 2\nd. 4", "stem\na. 1\nb. 2\nc. 3\nd. 4"), ("of Company B.\nb. k a. j c. l", "of Company B.\na. j\nb. k\nc. l"), ("R(a,b) R.a) x", None), ("", None)])
def test_reorder_options(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(numbering.reorder_options(F.col("t"))).first()[0] == (text if want is None else want)


def test_explode_long(spark):
    text = "Short line.\n" + " ".join(f"Sentence number {i} here." for i in range(40)) + "\n\n"
    pieces = spark.createDataFrame([(text,)], "t string").select(numbering.explode_long(F.col("t"), 30)).first()[0]
    assert " ".join(pieces) == " ".join(text.split()) and all(len(p) // 4 <= 30 for p in pieces) and pieces[0] == "Short line."


def test_weak_citations_go(spark):
    sents = spark.createDataFrame([(1, 0, [1, 2]), (1, 1, [3]), (2, 0, [1])], "answer_id int, s int, cited array<int>")
    held = spark.createDataFrame([(1, 1, 0.7), (1, 2, 0.4), (1, 3, 0.1), (1, 4, 0.9), (2, 1, 0.1)], "answer_id int, n int, support double")
    assert {(r.answer_id, r.n) for r in answers.surviving(held, sents).collect()} == {(1, 1), (1, 3), (2, 1)}


def test_backfill(spark):
    sents = answers.sentences(spark.createDataFrame([(1, "Refund policy lasts fourteen days. Unrelated words stand here quietly.")], "answer_id int, draft string"))
    blocks = spark.createDataFrame([(1, 1, "refund policy fourteen days"), (1, 2, "refund policy fourteen days"), (1, 3, "other")], "answer_id int, n int, source_text string")
    assert [(r.s, r.n) for r in answers.backfill(sents, blocks).collect()] == [(0, 2)]


def test_planner():
    p = planner.plan
    assert p("what is question 3?").ordinals == [3] and p("the last item").ordinals == [-1] and p("the second question", [24, 25]).ordinals == [25]
    assert p("hello").intent == "chitchat" and p("hello question 2").intent != "chitchat" and p("total revenue by region").needs_tables and p("Summarize this").broad
    assert p("").sub_queries == [""] and p("What is A? What is B?").sub_queries == ["What is A?", "What is B?"]


def test_evaluation(spark):
    gold = spark.createDataFrame([("a", "doc", ["14"], False), ("b", "none", [], True), ("c", "doc", ["x"], False)], "q string, kind string, expect_any array<string>, expect_refuse boolean")
    got = spark.createDataFrame([("a", "It is 14 days", False, 0.9, 1.0), ("b", "", True, 0.0, 2.0)], "q string, answer string, refused boolean, confidence double, seconds double")
    assert {r.q for r in evaluation.score(gold, got).collect() if r.ok} == {"a", "b"}
    assert "| doc | 1/2 | 0.9 | 1.0 |" in evaluation.markdown(evaluation.score(gold, got))


def test_engine(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "refunds.md").write_text("# Billing\n## Refunds\nRefunds are paid within fourteen days of the return. Shipping is never refunded.\n")
    (tmp_path / "in" / "travel.md").write_text("# Travel\nFlights must be booked by the office in advance.\n")
    (tmp_path / "in" / "bad.bin").write_bytes(bytes(range(128, 256)))
    e = Engine(spark, f"file://{tmp_path}/home")
    assert e.stats() == (0, 0)
    for _ in range(2):  # the second run adds nothing
        assert [r.path.rsplit("/", 1)[-1] for r in e.ingest(f"file://{tmp_path}/in").collect()] == ["bad.bin"]
        assert e.stats() == (2, 2)
    assert e.search("refunds paid").first().source == "refunds.md"
    assert {r.source for r in e.search("refunds", sources=["travel.md"]).collect()} <= {"travel.md"}
    got = e.ask("When are refunds paid?")
    assert "fourteen days" in got.text and "refunds.md" in [s for _, s in got.citations]
    assert e.ask("Hello").verdict == "chitchat"
    assert e.ask("Zebra quantum xylophone?").verdict == "refuse"
    main(["--home", e.home, "delete", "travel.md"], spark)
    assert "1 chunks of 1 files" in capsys.readouterr().out


def make_workbook() -> bytes:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Head Count" sheetId="1" r:id="a"/><sheet name="Empty" sheetId="2" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Department</t></si><si><r><t>Sa</t></r><r><t>les</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Heads</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>100</v></c></row><row><c r="A3" t="s"><v>1</v></c><c r="C3"><v>19</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData/></worksheet>")
    return buf.getvalue()


def test_registered_tables(spark, tmp_path):
    (tmp_path / "m.xlsx").write_bytes(make_workbook())
    (tmp_path / "sales.csv").write_bytes("﻿region;revenue usd\neast;10\nwest;20\n".encode())
    (tmp_path / "none.csv").write_bytes(b"")
    e = Engine(spark, f"file://{tmp_path}/home")
    assert e.tables() == []
    assert e.register(f"file://{tmp_path}/m.xlsx") == ["m__head_count"] and e.register(f"file://{tmp_path}/sales.csv") == ["sales"]
    assert e.tables() == ["m__head_count", "sales"]
    assert e.sql("SELECT sum(heads) AS n FROM m__head_count").first().n == 119
    assert e.sql("SELECT sum(revenue_usd) AS n FROM sales").first().n == 30
    with pytest.raises(guard.GuardError):
        e.sql("SELECT * FROM sales", ["m__head_count"])
    with pytest.raises(ValueError, match="empty"):
        e.register(f"file://{tmp_path}/none.csv")


def test_session_memory(spark, tmp_path):
    stream = jobs.stream_table(spark, "/root/testdata/sf0.001", "conversations")
    q = jobs.session_memory(stream).writeStream.format("memory").queryName("memory").outputMode("update").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {r.conv_id: (r.ctx, r.n) for r in REGISTRY["session_context"][0](spark, "/root/testdata/sf0.001").collect()}
    assert {r.conv_id: (r.context, min(4, r.context.count(" | ") + 1)) for r in spark.table("memory").collect()}.keys() == want.keys()
    assert all(want[r.conv_id][0] == r.context for r in spark.table("memory").collect())


def test_office_tables_and_charts():
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="u"><w:body><w:p><w:pPr><w:pStyle w:val="Title"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:t>a</w:t></w:p></w:tc><w:tc><w:p><w:t>b|c</w:t></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:t>1</w:t></w:p></w:tc><w:tc/></w:tr></w:tbl><w:p><w:t>after</w:t></w:p></w:body></w:document>')
    assert list(files.parse_office(buf.getvalue())) == [("heading", 1, "Top"), ("table", None, "| a | b\\|c |\n| 1 |  |"), ("paragraph", None, "after")]
    deck = io.BytesIO()
    with zipfile.ZipFile(deck, "w") as z:
        z.writestr("ppt/slides/slide1.xml", '<p:sld xmlns:p="p" xmlns:a="a"><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><p:txBody><a:p><a:r><a:t>Sales</a:t></a:r></a:p></p:txBody></p:sp><p:sp><p:txBody><a:p><a:t>body</a:t></a:p></p:txBody></p:sp></p:sld>')
        z.writestr("ppt/slides/_rels/slide1.xml.rels", '<Relationships><Relationship Id="r" Target="../charts/chart1.xml"/></Relationships>')
        z.writestr("ppt/charts/chart1.xml", '<c xmlns:c="c"><c:ser xmlns:c="c"><c:tx><c:pt idx="0"><c:v>Rev</c:v></c:pt></c:tx><c:cat><c:pt idx="0"><c:v>Enterprise</c:v></c:pt></c:cat><c:val><c:pt idx="0"><c:v>1276800</c:v></c:pt></c:val></c:ser></c>')
    assert list(files.parse_office(deck.getvalue())) == [("heading", 1, "Sales"), ("paragraph", None, "body"), ("table", None, "| Category | Rev |\n| Enterprise | 1,276,800 |")]


def test_preambles_move(spark):
    body = {1: "One.", 2: "Two is long enough.\nAnswer Questions 4-5 from the table.\n10 20", 3: "Three. For Question 1 look back.", 4: "Four.", 5: "Five."}
    found = numbering.items(spark.createDataFrame([(1, "\n".join(f"{n}. {t}" for n, t in body.items()))], "doc_id int, text string"))
    got = {r.ordinal: r.text for r in numbering.relocate_preambles(found).collect()}
    assert got[2] == "2. Two is long enough." and got[4] == "Answer Questions 4-5 from the table.\n10 20\n\n4. Four."
    assert got[3] == "3. Three. For Question 1 look back." and got[1] == "1. One." and len(got) == 5


def test_majority(spark):
    rows = [(1, "b"), (1, "b"), (1, "a"), (1, "a"), (2, None), (2, None), (3, "CANT"), (3, "x"), (4, "CANT"), (4, "CANT"), (4, "d"), (4, "d")]
    got = {r.item: r.verdict for r in answers.majority(spark.createDataFrame(rows, "item int, k string")).collect()}
    assert got == {1: "a", 2: "inconsistent", 3: "CANT", 4: "d"}


def test_changed_files_are_replaced(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "refunds.md").write_text("# Billing\nRefunds are paid within 14 days.\n")
    e = Engine(spark, f"file://{tmp_path}/home")
    e.ingest(f"file://{tmp_path}/in")
    (tmp_path / "in" / "refunds.md").write_text("# Billing\nRefunds are paid within 30 days.\n")
    e.ingest(f"file://{tmp_path}/in")
    assert [r.body for r in e.chunks().collect()] == ["Refunds are paid within 30 days."]
    assert "30 days" in e.ask("When are refunds paid?").text
    assert e.delete("refunds.md") == 1 and e.stats() == (0, 0) and e.search("refunds").count() == 0


def test_table_questions(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "sales.csv").write_text("region,revenue usd\neast,10\nwest,20\neast,5\n")
    (tmp_path / "in" / "note.md").write_text("# Sales\nThe revenue of a region is booked monthly.\n")
    e = Engine(spark, f"file://{tmp_path}/home")
    assert e.ingest(f"file://{tmp_path}/in").count() == 0
    assert e.tables() == ["sales"] and e.registry().first().rows == 3
    got = e.ask("What is the total revenue by region?")
    assert got.verdict == "ship" and "east, 15" in got.text and "west, 20" in got.text and got.citations == [(1, "spreadsheet query")]
    tries = []

    def propose(question, tables, error):
        tries.append(error)
        return ("SELECT nope FROM sales", "DROP TABLE sales", "SELECT sum(revenue_usd) AS total FROM sales")[len(tries) - 1]

    assert "35" in e.ask("What is the total revenue?", propose=propose).text and len(tries) == 3 and tries[0] is None
    assert "spreadsheet query" not in str(e.ask("What is the total revenue by region?", sources=["note.md"]).citations)
    e.delete("sales.csv")
    assert e.tables() == [] and e.search("revenue").where("kind = 'table_card'").isEmpty()


QUIZ = "# Exam\nRead all of this with care before you begin.\n1. Which one is blue? a) sky b) grass c) coal d) sun\n2. Name the second planet.\n3. What is three times three?\n4. Last item of the exam?\n"


def test_items_pins_broad_and_solver(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "exam.md").write_text(QUIZ)
    (tmp_path / "in" / "code.py").write_text("import x\n\ndef planet():\n    return 2\n")
    e = Engine(spark, f"file://{tmp_path}/home")
    e.ingest(f"file://{tmp_path}/in")
    chunks = {r.ordinal: r for r in e.chunks().where("source = 'exam.md' AND ordinal IS NOT NULL").collect()}
    assert sorted(chunks) == [1, 2, 3, 4] and chunks[2].text == "[Exam \u00b7 item 2]\n2. Name the second planet." and chunks[2].parent is None
    code = e.chunks().where("source = 'code.py'").orderBy("seq").collect()
    assert [c.section_path for c in code] == [[], ["def planet():"]] and code[1].body.startswith("```python\ndef planet")
    rows, _ = e.passages(planner.plan("What is question 3 about?"), "What is question 3 about?")
    assert rows[0].ordinal == 3 and len(rows) <= 3
    rows, _ = e.passages(planner.plan("Summarize the exam"), "Summarize the exam")
    assert len(rows) == 5 and {r.source for r in rows} == {"exam.md"}
    replies = iter(["so Final answer: a) sky", "Final answer: b) grass", "hm\nFinal answer: a."])
    assert e.ask("question 1", solve=lambda task: next(replies)).text.endswith("Question 1: a")


def test_flows_and_stimulus(spark):
    text = ["1. One is here", "2. Two is here", "3. Three is here", "4. Four is here", "For each of the following, choose:", "a picture", "Loose text"]
    df = spark.createDataFrame([(1, i, "paragraph", t) for i, t in enumerate(text)] + [(1, 7, "table", "| x |"), (1, 8, "paragraph", "after")], "doc_id int, seq int, kind string, text string")
    got = numbering.items_of_elements(df).orderBy("seq").collect()
    assert [(r.kind, r.ordinal, r.origin) for r in got] == [("list_item", n, 0) for n in (1, 2, 3, 4)] + [("paragraph", None, k) for k in (4, 5, 6)] + [("table", None, 7), ("paragraph", None, 8)]
    rows = [(0, None, "Figure 1: sales by month", "f.png"), (1, 3, "Answer Questions 4-5 based on the graph.\n3. Three", None), (2, 4, "4. Four", None), (3, 5, "5. Five", None), (4, 6, "6. Six", None)]
    df = spark.createDataFrame([(1, s, "list_item" if o else "paragraph", o, t, i) for s, o, t, i in rows], "doc_id int, seq int, kind string, ordinal int, text string, image_ref string")
    got = {r.ordinal: r.shared_context for r in numbering.share_stimulus(df).collect()}
    assert got[4] == got[5] == "Answer Questions 4-5 based on the graph.\n\nFigure 1: sales by month\n\nAll questions in this set:\n[Q4] 4. Four\n\n[Q5] 5. Five" and got[6] is None and got[3] is None


def test_structured_replies(spark):
    fields = {"sql": str, "ordinals": list}
    assert structured.parse('```json\n{"properties": {"sql": "x", "ordinals": null}}\n```', fields) == {"sql": "x", "ordinals": []}
    assert structured.parse("no json", fields) is None and structured.parse('{"sql": 3}', fields) is None
    asked = []
    replies = iter(["sorry", 'here: {"sql": "y", "ordinals": [1]} ok'])
    assert structured.ask(lambda p: asked.append(p) or next(replies), "q", fields) == {"sql": "y", "ordinals": [1]} and "sorry" in asked[1]
    assert structured.ask(lambda p: "", "q", fields, {"sql": ""}) == {"sql": ""}
    with pytest.raises(ValueError, match="sql"):
        structured.ask(lambda p: "", "q", fields)


def make_pdf(pages, flate=True):
    objs = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (5 + 2 * i) for i in range(len(pages))) + b"] /MediaBox [0 0 612 792] >>", b"<< /Type /Font /BaseFont /Helvetica >>", b"<< /Type /Font /BaseFont /Helvetica-Bold >>"]
    for i, p in enumerate(pages):
        c = b"BT " + b" ".join(b"/%s %g Tf 1 0 0 1 72 %g Tm (%s) Tj" % (f, size, y, t.encode("cp1252").replace(b"(", b"\\(").replace(b")", b"\\)")) for f, size, y, t in p) + b" ET"
        z = zlib.compress(c) if flate else c
        objs.append(b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> /Contents %d 0 R >>" % (6 + 2 * i))
        objs.append(b"<< /Length %d %s>>\nstream\n" % (len(z), b"/Filter /FlateDecode " if flate else b"") + z + b"\nendstream")
    return b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj\n" % (i + 1) + o + b"\nendobj" for i, o in enumerate(objs))


@pytest.mark.parametrize("flate", [True, False])
def test_pdf(flate):
    names = "Alpha Beta Gamma Delta".split()
    pages = [[(b"F1", 9, 770, "Annual Report"), (b"F2", 18, 600, f"Chapter {n}"), (b"F1", 10, 560, f"First line of {n} (x)"), (b"F1", 10, 548, "second line"), (b"F1", 10, 500, f"Other caf\u00e9 {n}"), (b"F1", 9, 20, f"{k} | P a g e")] for k, n in enumerate(names, 1)]
    got = list(pdf.elements(make_pdf(pages, flate)))
    assert got[:3] == [("heading", 1, "Chapter Alpha", 1), ("paragraph", None, "First line of Alpha (x)\nsecond line", 1), ("paragraph", None, "Other caf\u00e9 Alpha", 1)] and len(got) == 12
    assert files.parse("a.pdf", make_pdf(pages, flate))[0] == "pdf"
    with pytest.raises(ValueError, match="password"):
        pdf.lines(make_pdf(pages).replace(b"/Type /Catalog", b"/Type /Catalog /Encrypt 9 0 R"))


def test_written_index(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    index = retrieval.Bm25Index(docs)
    held = index.write(f"file://{tmp_path}/index", 8)
    text = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first().text
    want = {r.id: r.score for r in index.scores(retrieval.query_terms(spark.createDataFrame([(text,)], "text string"))).collect()}
    assert {r.id: r.score for r in held.scores(text).collect()} == want and want
    assert held.scores("").count() == 0
