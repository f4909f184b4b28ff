"""Sheets as registered tables: column names, empty rows and columns, cards."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files

MAX_TABLE_ROWS = 100_000


def clean_columns(names: list[str]) -> list[str]:
    """Snake case; col_i for blank or unnamed ones, c_ before a digit, _n for repeated ones."""
    out: list[str] = []
    for i, name in enumerate(names):
        base = re.sub("[^a-z0-9_]+", "_", (name or "").strip().lower()).strip("_")
        if not base or base.startswith("unnamed"):
            base = f"col_{i}"
        elif base[0].isdigit():
            base = f"c_{base}"
        same = sum(o == base or re.fullmatch(re.escape(base) + r"_\d+", o) is not None for o in out)
        out.append(f"{base}_{same}" if same else base)
    return out


def table_name(path: str, sheet: str | None = None) -> str:
    stem = path.rsplit("/", 1)[-1].rpartition(".")[0]
    return clean_columns([stem])[0] + (f"__{clean_columns([sheet])[0]}" if sheet else "")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a CSV, TSV or XLSX file by name, tidied. A name is the file's, and of a workbook the sheet's too."""
    head = spark.read.format("binaryFile").load(path).select("length", "content").first()
    if head is None:
        raise ValueError(f"empty file: {path}")
    if why := files.guard(path, head.length):
        raise ValueError(why)
    data = bytes(head.content)  # at most files.MAX_MB
    if not data.startswith(b"PK"):
        _, coding, sep = files.delimited(data, path)
        read = spark.read.option("header", True).option("inferSchema", True).option("mode", "DROPMALFORMED").option("sep", sep)
        return {table_name(path): tidy(read.option("encoding", "ISO-8859-1" if coding in ("cp1252", "latin-1") else "UTF-8").csv(path))}
    found = {}
    for sheet, rows in files.workbook(data):
        if len(rows) > 1:
            names = clean_columns([c or "" for c in rows[0]])
            raw = spark.createDataFrame(rows[1:], ", ".join(f"`{n}` string" for n in names))
            found[table_name(path, sheet)] = tidy(typed(raw))
    return found


def typed(df: DataFrame) -> DataFrame:
    """String columns whose values are all numbers become BIGINT or DOUBLE."""
    tests = [F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)]
    tests += [F.count(F.col(f"`{c}`").try_cast(t)).alias(f"{t}{i}") for i, c in enumerate(df.columns) for t in ("bigint", "double")]
    r = df.agg(*tests).first()
    kind = lambda i: "bigint" if r[f"bigint{i}"] == r[f"n{i}"] and not df.where(F.col(f"`{df.columns[i]}`").contains(".")).take(1) else "double" if r[f"double{i}"] == r[f"n{i}"] else "string"
    return df.select(*[F.col(f"`{c}`").cast(kind(i)).alias(c) if r[f"n{i}"] else F.col(f"`{c}`") for i, c in enumerate(df.columns)])


def tidy(df: DataFrame) -> DataFrame:
    """Without rows and columns that are all null, with clean names: at most MAX_TABLE_ROWS rows, and total_rows says of how many."""
    any_value = F.coalesce(*[F.col(f"`{c}`").cast("string") for c in df.columns])
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)], F.count(any_value).alias("rows")).first()
    kept = df.select(*[f"`{c}`" for c, n in zip(df.columns, counts, strict=False) if n])
    out = kept.na.drop("all").toDF(*clean_columns(kept.columns))
    out = out.limit(MAX_TABLE_ROWS) if counts["rows"] > MAX_TABLE_ROWS else out
    out.total_rows = counts["rows"]
    return out


def total_rows(tidied: DataFrame) -> int | None:
    """Rows before the cap of a table that tidy gave, or None where it has not said."""
    return getattr(tidied, "total_rows", None)


def card(df: DataFrame, name: str, source: str) -> str:
    cols = ", ".join(f"{f.name} {f.dataType.simpleString().upper()}" for f in df.schema.fields)
    return f"Table {name} from {source}: {df.count()} rows. Columns: {cols}"


class Description(NamedTuple):
    columns: list[tuple[str, str]]
    rows: int
    preview: str


def markdown(df: DataFrame, limit: int = 20) -> str:
    """The first rows as a Markdown table, and how many more there are. Nulls are empty."""
    if not df.columns:
        return "_no result_"
    head = df.limit(limit).collect()
    more = df.count() - len(head)
    rows = [df.columns, ["---"] * len(df.columns), *(["" if c is None else str(c) for c in r] for r in head)]
    return "\n".join(["| " + " | ".join(r) + " |" for r in rows] + ([f"_({more} more rows)_"] if more else []))


def describe(df: DataFrame, limit: int = 15) -> Description:
    """Columns with types, the number of rows, and the first ones as Markdown."""
    return Description([(f.name, f.dataType.simpleString().upper()) for f in df.schema.fields], df.count(), markdown(df, limit))
