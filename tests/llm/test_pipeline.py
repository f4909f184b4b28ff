"""corpus_pipeline.run() against plain Python for the stages that decide what stays."""

import hashlib

import duckdb
import numpy as np

import corpus_pipeline
from docloom.llm import bpe, mixing
from docloom.llm.quality import assess
from docloom.llm.registry import public_tokenizer

from .test_jaccard_join import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id for r in assess(docs, labels).where("kept").collect()}  # held against brute force in test_others
    rows = [r for r in docs.collect() if r.doc_id in good]
    seen, unique = set(), []
    for r in sorted(rows, key=lambda r: r.doc_id):
        norm = " ".join(r.text.split()) if r.text.strip() == r.text else r.text
        if norm not in seen:
            seen.add(norm)
            unique.append(r)
    keep = {i for i, _, c in brute([(r.doc_id, r.text) for r in unique]) if i == c}
    left = [r for r in unique if r.doc_id in keep]
    con = duckdb.connect()
    documents = spark.createDataFrame(left, docs.schema).toArrow()
    con.register("documents", documents)
    drawn = {i for i, s in con.execute(f"SELECT doc_id, sampled FROM ({mixing.oracle()})").fetchall() if s}
    c = bpe.Coder(public_tokenizer())
    want = []
    for r in left:
        if r.doc_id in drawn:
            ids = c.tok.encode(r.text, add_special_tokens=False).ids
            want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(c.tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert 0 < len(left) < len(unique) < len(rows) < docs.count() and 0 < len(drawn) < len(left)
    assert got == sorted(want)


def test_stages_keep_columns(spark, odd):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, SF).columns == odd.columns
        assert stage(spark, odd.limit(0), SF).count() == 0
