"""Quality rules: length-normalised log-likelihood ratio of hashed n-grams, trusted target against raw corpus.

Words and word pairs of every document are hashed to SLOTS counters; one multinomial is counted over all
documents (raw, add-one smoothing), one over trusted rows (target, smoothed by SMOOTHING counts in the raw
proportions, so few labels say little). A document's score is the mean over its n-grams of
log P_target(slot) - log P_raw(slot). A document stays if it passes the base rules and its score is at least the
threshold, the same for every document: the QUANTILE of the scores of trusted rows that pass the base rules, each
scored by the half of the trusted rows that it is not in.

Trusted rows are all rows whose ids a label calls good and not toxic. A bitmap of MARKS hashes of those ids, of
the same size at any input, spares most other texts the join on ids that then decides; what the join finds is
written to the shared folder. The quantile is exact and found by counting in ever narrower ranges. Raw counts cover
all documents. Each task adds up its counters and sends them in RANGES pieces; GATHER tasks' pieces are added first,
then those sums, so that no task merges many. The model that is broadcast has SLOTS numbers at any size of input.

Null and empty texts have no words: they fail the base rules. Without trusted rows the scores are 0 and the
base rules alone decide. Repeated rows count as often as they occur. Ids of labels and documents are compared as
text. Texts of any length are read whole, a few at a time. Other columns are not read by
`assess`; `keep_good` returns them unchanged. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import materialize
from ._words import SEP, flat, grams, pack, slices, unpack, words

SLOTS = 1 << 17
RANGES = 16
MARKS, MARKS_PART = 1 << 26, 1 << 20
#: Ranges of scores that are counted at a time, and scores that are collected.
CLASSES, FEW = 4096, 50_000
SMOOTHING = 1 << 14
QUANTILE = 0.005
GATHER = 1024
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_BLANK = " \t\n\x0b\x0c\r"
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def _slots(h: np.ndarray, first: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all words and word pairs, and the row of each."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pairs = grams(h, 2)
    inside = row[:-1] == row[1:] if len(row) > 1 else np.zeros(0, bool)
    at = np.concatenate([h, pairs[inside]]) & np.uint64(slots - 1)
    return at.astype(np.int64), np.concatenate([row, row[:-1][inside]])


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The ids (as text) of good rows, and the half that each is in."""
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("string").alias("_trusted")).distinct()
    return materialize(good.withColumn("_half", F.pmod(F.crc32("_trusted"), F.lit(2)).cast("int")), "trusted")


def _mark(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(MARKS))


def _trusted_texts(texts: DataFrame, trusted: DataFrame) -> DataFrame:
    """(_half, _text) of the rows of texts (_key, _text) whose keys are trusted."""

    def bitmap(table: pa.Table) -> pa.Table:
        bits = np.zeros(MARKS_PART, bool)
        bits[table.column("at").to_numpy() % MARKS_PART] = True
        return pa.table({"part": table.column("part")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    at = trusted.select(_mark("_trusted").alias("at")).withColumn("part", F.floor(F.col("at") / MARKS_PART))
    marks = np.zeros(MARKS // 8, np.uint8)
    for r in at.groupBy("part").applyInArrow(bitmap, "part long, bits binary").toLocalIterator():
        marks[r.part * MARKS_PART // 8 : (r.part + 1) * MARKS_PART // 8] = np.frombuffer(r.bits, np.uint8)
    held = texts.sparkSession.sparkContext.broadcast(marks)

    def may_be(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(0).to_numpy()
            yield b.filter(pa.array((held.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))).select(["_key", "_text"])

    some = texts.where("_key IS NOT NULL").select(_mark("_key").alias("_at"), "_key", "_text").mapInArrow(may_be, "_key string, _text string")
    return materialize(some.join(trusted, F.col("_key") == F.col("_trusted")).select("_half", "_text"), "trusted-texts")


def _quantile(scores: DataFrame, q: float) -> float | None:
    """The q quantile of the column score, between two scores in proportion."""
    n = scores.count()
    if not n:
        return None
    place = (n - 1) * q

    def nth(k: int) -> float:
        rows = scores
        while True:
            low, high, left = rows.agg(F.min("score"), F.max("score"), F.count("*")).first()
            if low == high:
                return low
            if left <= FEW:
                return sorted(r[0] for r in rows.collect())[k]
            step = F.floor((F.col("score") - low) / (high - low) * (CLASSES - 1))
            for c in sorted(rows.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).collect()):
                if k < c.n:
                    rows = rows.where(F.col("score").between(c.low, c.high))
                    break
                k -= c.n

    low, high = int(np.floor(place)), int(np.ceil(place))
    a = nth(low)
    b = a if low == high else nth(high)
    return a if a == b else (high - place) * a + (place - low) * b


def _weight(target: np.ndarray, raw: np.ndarray, smoothing: float) -> np.ndarray:
    if not target.sum():
        return np.zeros(len(raw))
    p = (raw + 1) / (raw.sum() + len(raw))
    return np.log((target + smoothing * p) / (target.sum() + smoothing)) - np.log(p)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, smoothing: float = SMOOTHING, quantile: float = QUANTILE) -> tuple[np.ndarray, float]:
    """Weight of each slot, log P_target - log P_raw, and the threshold."""
    width = slots // RANGES
    kinds = ("raw", "first", "second")
    texts = docs.select(F.col(id_col).cast("string").alias("_key"), F.col(text_col).alias("_text"))
    own = _trusted_texts(texts, trusted_ids(labels))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, slots), np.int64)
        for b in slices(batches):
            data, off = flat(b.column(1))
            _, _, h, first = words(data, off)
            at, row = _slots(h, first, slots)
            kind = b.column(0).to_numpy()[row]
            for k in (0, 1, 2):
                if (mine := kind == k).any():
                    sums[k] += np.bincount(at[mine], minlength=slots)
        cut = lambda x: [pack(x[i * width : (i + 1) * width]) for i in range(RANGES)]
        yield pa.RecordBatch.from_pydict({"piece": pa.array(range(RANGES), pa.int32()), **{k: cut(x) for k, x in zip(kinds, sums, strict=True)}})

    def add(table: pa.Table) -> pa.Table:
        total = {}
        for k in kinds:
            total[k] = np.zeros(width, np.int64)
            for x in table.column(k).to_pylist():
                total[k] += unpack(x)
        return pa.table({"piece": table.column("piece")[:1], **{k: [pack(x)] for k, x in total.items()}})

    kind = "piece int, raw binary, first binary, second binary"
    every = texts.select(F.lit(0).alias("_kind"), "_text").unionByName(own.select((F.col("_half") + 1).alias("_kind"), "_text"))
    sums = every.mapInArrow(count, kind).withColumn("_gather", F.floor(F.spark_partition_id() / GATHER))
    pieces = sums.groupBy("piece", "_gather").applyInArrow(lambda t: add(t.drop_columns(["_gather"])), kind).groupBy("piece").applyInArrow(add, kind).collect()
    if not pieces:
        return np.zeros(slots), float("-inf")
    pieces.sort(key=lambda r: r["piece"])
    raw, one, two = (np.concatenate([unpack(bytes(r[c])) for r in pieces]).astype(float) for c in kinds)
    if not (one + two).any():
        return np.zeros(slots), float("-inf")
    halves = docs.sparkSession.sparkContext.broadcast((_weight(two, raw, smoothing), _weight(one, raw, smoothing)))  # by the other half

    def held_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            half = b.column(0).to_numpy(zero_copy_only=False)
            got = [measure(b.column(1), w, 0.0) for w in halves.value]
            score = np.where(half == 0, got[0]["score"], got[1]["score"])
            yield pa.RecordBatch.from_pydict({"score": score[~got[0]["base_failed"]]})

    threshold = _quantile(materialize(own.mapInArrow(held_out, "score double"), "trusted-scores"), quantile)
    return _weight(one + two, raw, smoothing), float("-inf") if threshold is None else float(threshold)


def measure(col, weight: np.ndarray, threshold: float) -> dict:
    """Columns of SCHEMA for an Arrow string column."""
    data, off = flat(col)
    s, e, h, first = words(data, off, lower=False)
    n = len(off) - 1
    base = int(off[0])
    b = data[base : int(off[-1])]
    at_rows = off - base
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[at_rows])
    points = total(((b & 0xC0) != 0x80) & ~SEP[b])
    symbols = total(SYMBOLS[b])
    n_words = np.diff(first)
    five = grams(h, 5)
    repeat, dup = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n):
        if n_words[i] > 5:
            g = five[first[i] : first[i + 1] - 4]
            _, inv, cnt = np.unique(g, return_inverse=True, return_counts=True)
            if len(cnt) < len(g):
                hit = np.concatenate([[0], np.cumsum(cnt[inv] > 1)])
                m = int(n_words[i])
                j = np.arange(m)
                repeat[i] = int((hit[np.minimum(j + 1, len(g))] > hit[np.maximum(j - 4, 0)]).sum())
        lines = bytes(data[off[i] : off[i + 1]]).split(b"\n")
        if len(lines) > 1:
            full = [x for x in lines if x.strip(_BLANK.encode())]
            dup[i] = len(full) - len(set(full))
    _, _, low, first = words(data, off)
    at, row = _slots(low, first, len(weight))
    size = np.bincount(row, minlength=n)
    score = np.bincount(row, weight[at], minlength=n) / np.maximum(size, 1)
    failed = (n_words < 10) | (100 * repeat > 20 * n_words)
    return {"n_words": n_words, "word_chars": points, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "base_failed": failed, "score": score, "kept": ~failed & (score >= threshold)}


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float | None = None, slots: int = SLOTS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id_col, the columns of SCHEMA, and the columns of docs named in carry."""
    weight, own = fit(docs, labels, id_col, text_col, slots)
    weight, threshold = docs.sparkSession.sparkContext.broadcast(weight), own if threshold is None else threshold

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = measure(b.column(b.num_columns - 1), weight.value, threshold)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(x) for x in got.values()]], [*b.schema.names[:-1], *got])

    kept = docs.select(id_col, *carry, F.col(text_col).alias("_text"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(apply, f"{head}, {SCHEMA}")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    weight, own = fit(docs, labels, id_col, text_col)
    weight, threshold = docs.sparkSession.sparkContext.broadcast(weight), own if threshold is None else threshold
    place = docs.columns.index(text_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(measure(b.column(place), weight.value, threshold)["kept"]))

    return docs.mapInArrow(apply, docs.schema)
