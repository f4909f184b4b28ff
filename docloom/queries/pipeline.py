"""Guarded SQL, registered tables and incremental runs as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import guard, registry
from .base import Registry, views

REGISTRY = R = Registry()


def _guarded(sql: str, tables: list[str]):
    def build(s, d):
        views(s, d, sql)
        return guard.run_sql(s, sql, tables)

    return build


LIMITED = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey"
R["sql_limit_guard"] = (_guarded(LIMITED, ["orders"]), LIMITED + " LIMIT 200")
CTE = "WITH t AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey) SELECT o_custkey, round(s, 2) AS s FROM t ORDER BY s DESC, o_custkey LIMIT 5"
R["guarded_cte"] = (_guarded(CTE, ["orders"]), CTE)
R["drop_all_null"] = (lambda s, d: registry.tidy(s.sql("SELECT * FROM VALUES (1, CAST(NULL AS INT), 'a'), (NULL, NULL, NULL), (2, NULL, 'b') AS t(`Unit Sold`, `Empty`, `2026`)")), "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) AS t(unit_sold, c_2026)")
R["table_card"] = (lambda s, d: s.createDataFrame([(registry.card(s.read.parquet(f"{d}/region.parquet"), "region", "r.csv"),)], "card string"), "SELECT 'Table region from r.csv: ' || count(*) || ' rows. Columns: r_regionkey INT, r_name STRING' AS card FROM region")
R["clean_columns"] = (lambda s, d: s.createDataFrame([(i, c) for i, c in enumerate(registry.clean_columns(["Q3 Budget", "Q3 budget", "", "Unnamed: 3", "2026"]))], "pos int, name string"), "SELECT * FROM (VALUES (0, 'q3_budget'), (1, 'q3_budget_1'), (2, 'col_2'), (3, 'col_3'), (4, 'c_2026')) AS t(pos, name)")
R["incremental_ingest"] = (
    lambda s, d: (lambda old, new: old.unionByName(new.join(old, "doc_id", "left_anti").dropDuplicates(["doc_id"])))(s.read.parquet(f"{d}/documents.parquet").where("lang <> 'en'").select("doc_id", "lang"), s.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")).select("doc_id", F.col("lang").alias("lang")),
    "SELECT doc_id, lang FROM documents",
)
