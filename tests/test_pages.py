from docloom.operators import pages


def test_furniture(spark):
    rows = [(1, p, at, t) for p in range(1, 6) for at, t in ((0.05, f"Report {p}"), (0.5, "Report 9"), (0.95, f"{p}"), (0.06, f"only {'abcde'[p - 1]}"))]
    rows += [(2, 1, 0.01, "Report 1"), (2, 1, None, None)]
    got = pages.furniture(spark.createDataFrame(rows, "doc_id int, page int, at double, text string")).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.text) for r in got if r.is_furniture} == {(1, f"Report {p}") for p in range(1, 6) if p != 9} | {(1, str(p)) for p in range(1, 6)}
    assert not any(r.is_furniture for r in got if r.at == 0.5)


def test_reading_order(spark):
    rows = [(1, 1, 1, 50.0, 10.0, 40.0), (1, 1, 2, 5.0, 12.0, 40.0), (1, 1, 3, 5.0, 60.0, 90.0), (1, 1, 4, 70.0, 65.0, 95.0), (1, 1, 5, 30.0, 61.0, 91.0), (1, 2, 6, 0.0, 0.0, 1.0)]
    got = pages.reading_order(spark.createDataFrame(rows, "doc_id int, page int, id int, x0 double, y0 double, y1 double")).collect()
    assert [r.id for r in sorted(got, key=lambda r: (r.page, r.pos))] == [2, 1, 3, 5, 4, 6]


def test_figures_and_parts(spark):
    rows = [(1, 1, 1, "figure", None, "f", False), (1, 1, 2, "list_item", 7, None, False), (1, 2, 3, "figure", None, "g", False), (1, 2, 4, "figure", None, "h", False), (1, 2, 5, "list_item", 8, None, False), (1, 3, 6, "paragraph", None, "i", True), (1, 3, 7, "paragraph", None, "j", True), (2, 1, 1, "paragraph", None, "k", True), (1, None, 9, "list_item", 3, None, False)]
    df = spark.createDataFrame(rows, "doc_id int, page int, seq int, kind string, ordinal int, image_ref string, part boolean")
    got = {(r.doc_id, r.seq): (r.image_ref, r.ordinal) for r in pages.number_parts(pages.attach_figures(df)).collect()}
    assert got[1, 2] == ("f", 7) and got[1, 5] == (None, 8) and got[1, 6] == ("i", 9) and got[1, 7] == ("j", 10) and got[2, 1] == ("k", None) and got[1, 9] == (None, 3)


def test_tables_and_charts(spark):
    box = "doc_id int, page int, x0 double, y0 double, x1 double, y1 double"
    left = pages.outside_tables(spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 1, 50.0, 50.0, 60.0, 60.0), (1, 2, 0.0, 0.0, 10.0, 10.0)], box), spark.createDataFrame([(1, 1, 5.0, 5.0, 25.0, 25.0)], box))
    assert {(r.page, r.x0) for r in left.collect()} == {(1, 50.0), (2, 0.0)}
    bars = [(1, 1, 15.0 * i, 100.0 - h, 10.0, h) for i, h in enumerate((30.0, 50.0, 20.0, 70.0))] + [(1, 1, 0.0, 0.0, 300.0, 5.0)] + [(1, 2, 15.0 * i, 0.0, 10.0, 30.0) for i in range(5)] + [(1, 3, 15.0 * i, 70.0 - i, 10.0, 30.0 + i) for i in range(3)]
    got = pages.bar_charts(spark.createDataFrame(bars, "doc_id int, page int, x0 double, y0 double, width double, height double"))
    assert [tuple(r) for r in got.collect()] == [(1, 1, 4)]
