"""Suffix-array dedup of long repeated passages, by bucket-pointer refinement.

Every byte covered by a SPAN-byte string that also starts somewhere else is removed. A suffix array of all
positions would be many times the input, so only suffixes that can matter are sorted:

1. Each SPAN-byte window has an anchor: the Q-byte string in it whose hash is least (the leftmost of equal
   ones). Equal windows have equal anchors, so windows fall into initial q-gram buckets by anchor; about one
   position in 180 is an anchor. The windows of one anchor cover a stretch of text (its context).
2. Equal contexts are counted, first within each batch of rows, so that a passage of any frequency sends one
   anchor from each batch; then by anchor, in one shuffle. A context that occurs twice has only repeated windows. Anchors
   that occur once have none. What is left are the different contexts of an anchor, one copy of each.
3. Those contexts are refined as suffixes: buckets of equal STEP-byte strings first, then each bucket is sorted
   by the bucket pointers STEP, 2 STEP, ... bytes later, each round using the pointers of the last, so that the
   length doubles up to SPAN. Suffixes that are alone in their bucket leave at once.
   Anchors with more than WIDE contexts do not gather in one task: their windows are grouped by hash instead.

In the same passes the same method runs over words ([^\\x20\\x09-\\x0D]+ as they stand) in place of bytes, with
windows of WORDS.span words: a passage of more than 50 words that another document has too is reported
(n_shared_words, n_passages), whatever its length in bytes and its white space. Nothing is removed for it, and
a passage that only its own document repeats does not count.

Byte matches stay within a text. All spans are judged on the input. Null counts as empty. A repeated row is a copy
like any other. Rows are identified by a 64-bit hash of id and text. Other columns are not read. An empty
table gives an empty result. Texts are UTF-8 bytes; a character may be cut. Texts of any length are read in
pieces of _PIECE symbols; a text's own spans are gathered with it in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._io import materialize, n_parts, n_tasks
from ._words import flat, mix, powers, prefix, slices, words

SPAN, Q, STEP = 400, 32, 25
WIDE = 4096


class Grain(NamedTuple):
    """Symbols of a window, of an anchor, and of the first buckets."""

    span: int
    q: int
    step: int


#: More than 50 words.
WORDS = Grain(51, 8, 4)
_PIECE = 1 << 18
_PLACE = np.uint64((1 << 24) - 1)


def anchors(b: np.ndarray, span: int = SPAN, q: int = Q, off: np.ndarray | None = None):
    """Anchors of bytes or word hashes: first and last window start, key and context hash.

    b is one text, or with off several texts, none over _PIECE; windows never cross texts.
    """
    found = []
    for at in range(0, max(0, len(b) - span + 1), _PIECE if off is None else len(b)):
        piece = b if off is not None else b[at : at + _PIECE + span - 1]
        c = prefix(piece)
        _, inv = powers(len(piece) + 1)
        m = len(piece) - q + 1
        h = mix((c[q:] - c[:-q]) * inv[:m])
        width = span - q + 1
        padded = np.full(-(-m // width) * width, np.iinfo(np.uint64).max)
        padded[:m] = (h & ~_PLACE) | np.arange(m, dtype=np.uint64)
        block = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(block, axis=1).reshape(-1)
        back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        n = m - width + 1
        place = (np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & _PLACE).astype(np.int64)
        start = np.arange(n)
        if off is not None:
            start = start[np.repeat(off[1:] - span, np.diff(off))[:n] >= start]  # windows that end within their text
            place = place[start]
            if not len(start):
                continue
        # windows of one anchor follow each other
        cut = np.flatnonzero(np.diff(place)) + 1
        lo, hi = start[np.concatenate([[0], cut])], start[np.concatenate([cut - 1, [len(start) - 1]])]
        context = mix((c[hi + span] - c[lo]) * inv[lo] + (hi - lo).astype(np.uint64))
        found.append((lo + at, hi + at, h[place[np.concatenate([[0], cut])]], context))
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else None


def all_anchors(x: np.ndarray, off: np.ndarray, span: int, q: int):
    """Anchors of many texts: text, and within it first and last window start, key and context hash."""
    found, i, n = [], 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + _PIECE, "right")) - 1)
        part = x[off[i] : off[j]]
        a = anchors(part, span, q, off[i : j + 1] - off[i] if len(part) <= _PIECE else None) if len(part) >= span else None
        if a:
            text = np.searchsorted(off, a[0] + off[i], "right") - 1
            found.append((text, a[0] + off[i] - off[text], a[1] + off[i] - off[text], *a[2:]))
        i = j
    return [np.concatenate(y) for y in zip(*found, strict=True)] if found else None


def refine(data: np.ndarray, off: np.ndarray, inside: np.ndarray, span: int = SPAN, step: int = STEP, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
    """Positions marked in `inside` whose span symbols (within their row of off) occur at another marked position.

    With low and high, numbers of each row, only where the least low and the greatest high of equal ones differ.
    """
    if len(data) < span:
        return np.zeros(0, np.int64)
    left = np.repeat(off[1:], np.diff(off)) - np.arange(len(data))  # bytes from here to the row's end
    c = prefix(data) if len(data) <= _PIECE else None
    m = len(data) - step + 1
    if c is not None:
        h = mix((c[step:] - c[:-step]) * powers(len(data) + 1)[1][:m])
    else:
        h = np.empty(m, np.uint64)
        for a in range(0, m, _PIECE):
            z = min(a + _PIECE, m)
            c = prefix(data[a : z + step - 1])
            h[a:z] = mix((c[step:] - c[:-step]) * powers(_PIECE + step)[1][: z - a])
    bucket = np.zeros(len(data), np.int64)  # 0: alone
    at = np.flatnonzero(left[:m] >= step)
    length = step
    at, ids = _shared(at, h[at])
    bucket[at] = ids
    label = None if low is None else (np.repeat(low, np.diff(off)), np.repeat(high, np.diff(off)))
    while length < span:
        more = min(length, span - length)
        at = at[left[at] >= length + more]
        if length + more == span:
            at = at[inside[at]]
        at = at[bucket[at + more] > 0]
        pointer = (bucket[at].astype(np.uint64) << np.uint64(32)) | bucket[at + more].astype(np.uint64)
        at, ids = _shared(at, pointer, label if length + more == span else None)
        bucket = np.zeros(len(data), np.int64)
        bucket[at] = ids
        length += more
    return at


def _shared(at: np.ndarray, key: np.ndarray, label: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The positions whose key another (of another label) has too, and their new bucket numbers from 1."""
    if not len(at):
        return at, np.zeros(0, np.int64)
    order = np.argsort(key)  # the order of equal keys changes nothing
    k = key[order]
    first = np.concatenate([[True], k[1:] != k[:-1]])
    run = np.cumsum(first)
    if label is None:
        some = np.bincount(run)[run] > 1
    else:
        heads = np.flatnonzero(first)
        some = (np.minimum.reduceat(label[0][at[order]], heads) != np.maximum.reduceat(label[1][at[order]], heads))[run - 1]
    number = np.empty(len(at), np.int64)
    number[order] = run
    many = np.empty(len(at), bool)
    many[order] = some
    return at[many], number[many]


_ANCHOR = "words boolean, row long, lo int, hi int, more array<int>, key long, context long, n long"
_MULT = np.uint64(0xC6A4A7935BD1E995)
_ROWS = 512


def _anchor_rows(of_bytes: Grain, of_words: Grain):
    """Anchors; of equal contexts in a batch one with their number, and for the others, with n = 0, only the spans.

    Of words, equal contexts of one text are one row, with their other places in `more`, so n counts texts.
    """

    def rows(found: list, ids: np.ndarray, of_text: bool):
        if not found:
            return
        text, lo, hi, key, context = (np.concatenate(x) for x in zip(*found, strict=True))
        same = mix(key + context * _MULT)
        more, ends = np.zeros(0, np.int32), np.zeros(len(lo) + 1, np.int32)
        if of_text:
            _, one, place = np.unique(mix(same + text.astype(np.uint64) * _MULT), return_index=True, return_inverse=True)
            other = np.flatnonzero(one[place] != np.arange(len(place)))
            other = other[np.argsort(place[other], kind="stable")]
            more = lo[other].astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(np.bincount(place[other], minlength=len(one)))]).astype(np.int32)
            lo, hi, key, context, text, same = (x[one] for x in (lo, hi, key, context, text, same))
        _, one, place, n = np.unique(same, return_index=True, return_inverse=True, return_counts=True)
        count = np.where(one[place] == np.arange(len(place)), n[place], 0)
        yield pa.RecordBatch.from_pydict({
            "words": np.full(len(lo), of_text), "row": ids[text], "lo": lo.astype(np.int32), "hi": hi.astype(np.int32), "more": pa.ListArray.from_arrays(pa.array(ends), pa.array(more)),
            "key": key.view(np.int64), "context": context.view(np.int64), "n": count.astype(np.int64),
        })

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            of = ([], [])
            for at in range(0, b.num_rows, _ROWS):  # fewer symbols at a time; equal contexts meet in the whole batch
                data, off = flat(b.column(1).slice(at, _ROWS))
                _, _, h, first = words(data, off, lower=False)
                for k, (x, grain, o) in enumerate(((data, of_bytes, off), (h, of_words, first))):
                    if a := all_anchors(x, o, grain.span, grain.q):
                        of[k].append((a[0] + at, *a[1:]))
            yield from rows(of[0], ids, False)
            yield from rows(of[1], ids, True)

    return apply


_REP_FIELDS = ("words", "key", "n", "row", "lo", "hi", "more", "wide", "symbols")
_REP = "words boolean, key long, n long, row long, lo int, hi int, more array<int>, wide boolean, symbols binary"


def _cut(of_bytes: Grain, of_words: Grain):
    """Bytes, or word hashes, of the contexts that are asked for."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, _ROWS):
            data, off = flat(b.column("_text"))
            text, asked = listed(b.column("_asked"))
            lo, hi, of_word = (asked.field(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi", "words"))
            h = first = None
            if of_word.any():
                _, _, h, first = words(data, off, lower=False)
            symbols = []
            for i, a, z, w in zip(text.tolist(), lo.tolist(), hi.tolist(), of_word.tolist(), strict=True):
                source, at, span = (h, first[i], of_words.span) if w else (data, off[i], of_bytes.span)
                symbols.append(source[at + a : at + z + span].tobytes())
            row = b.column("_row").to_numpy(zero_copy_only=False)[text]
            fields = [pa.array(row) if c == "row" else pa.array(symbols, pa.binary()) if c == "symbols" else asked.field(c) for c in _REP_FIELDS]
            yield pa.RecordBatch.from_arrays(fields, list(_REP_FIELDS))

    return apply


def listed(col) -> tuple[np.ndarray, pa.Array]:
    """Rows of a list column's items, and the items; null counts as empty."""
    n = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(col)), n), col.flatten()


_SPANS = pa.schema([("words", pa.bool_()), ("row", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("more", pa.list_(pa.int32()))])
_SPANS_DDL = "words boolean, row long, start int, stop int, more array<int>"


def _refined(of_bytes: Grain, of_words: Grain):
    def apply(table: pa.Table) -> pa.Table:
        flag = table.column("words").to_numpy(zero_copy_only=False).astype(bool)
        return pa.concat_tables(_refined_part(table.filter(pa.array(flag == kind)), grain, kind) for kind, grain in ((False, of_bytes), (True, of_words)))

    return apply


def _refined_part(table: pa.Table, grain: Grain, of_words: bool) -> pa.Table:
    if not table.num_rows:
        return _SPANS.empty_table()
    parts = [bytes(x) for x in table.column("symbols").to_pylist()]
    data = np.frombuffer(b"".join(parts), np.uint64 if of_words else np.uint8)
    off = np.concatenate([[0], np.cumsum([len(x) // data.itemsize for x in parts])]).astype(np.int64)
    lo, hi, row, n = (table.column(c).to_numpy() for c in ("lo", "hi", "row", "n"))
    mark = np.zeros(len(data) + 1, np.int64)
    np.add.at(mark, off[:-1], 1)
    np.add.at(mark, off[:-1] + (hi - lo) + 1, -1)
    low = high = None
    if of_words:  # what another text has too: a context of several texts differs from itself
        low = np.unique(row, return_inverse=True)[1] * 2
        high = low + (n > 1)
    hit = refine(data, off, np.cumsum(mark)[:-1] > 0, grain.span, grain.step, low, high)
    part = np.searchsorted(off, hit, "right") - 1
    alone = n[part] == 1  # contexts that occur twice are settled
    hit, part = hit[alone], part[alone]
    return _runs(part, hit - off[part], lo, row, table.column("more").to_pylist(), grain.span, of_words)


def _runs(part: np.ndarray, start: np.ndarray, lo: np.ndarray, row: np.ndarray, more: list, span: int, of_words: bool) -> pa.Table:
    """Stretches covered by windows at consecutive starts within a context, at all its places in the text."""
    if not len(part):
        return _SPANS.empty_table()
    new = np.concatenate([[True], (np.diff(part) != 0) | (np.diff(start) != 1)])
    last = np.concatenate([new[1:], [True]])
    part, first, stop = part[new], start[new], start[last] + span
    others = [[m + int(f) for m in more[p]] for p, f in zip(part, first, strict=True)]
    return pa.Table.from_arrays([pa.array(np.full(len(part), of_words)), pa.array(row[part]), pa.array((lo[part] + first).astype(np.int32)), pa.array((lo[part] + stop).astype(np.int32)), pa.array(others, pa.list_(pa.int32()))], schema=_SPANS)


def _window_hashes(of_bytes: Grain, of_words: Grain):
    """Each window of wide anchors' contexts as a row with two hashes."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for kind, n, row, lo, more, x in zip(*(b.column(c).to_pylist() for c in ("words", "n", "row", "lo", "more", "symbols")), strict=True):
                text = np.frombuffer(bytes(x), np.uint64 if kind else np.uint8)
                span = (of_words if kind else of_bytes).span
                m = len(text) - span + 1
                hashes = []
                for t in (text, mix(text) if kind else 255 - text):
                    c = prefix(t)
                    hashes.append(mix((c[span:] - c[:-span]) * powers(len(t) + 1)[1][:m]).view(np.int64))
                yield pa.RecordBatch.from_pydict({"words": np.full(m, kind), "h1": hashes[0], "h2": hashes[1], "n": np.full(m, n), "row": np.full(m, row), "start": np.arange(lo, lo + m, dtype=np.int32), "more": pa.array([[y + k for y in more] for k in range(m)], pa.list_(pa.int32()))})

    return apply


def _result(id_col: str):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, _ROWS):
            data, off = flat(b.column("_text"))
            data, off = data[off[0] : off[-1]], off - off[0]
            text, spans = listed(b.column("_spans"))
            of_word, start, stop = (spans.field(c).to_numpy(zero_copy_only=False) for c in ("words", "start", "stop"))
            of_word = of_word.astype(bool)
            gone = covered(off, text[~of_word], start[~of_word], stop[~of_word])
            text, start, stop = text[of_word], start[of_word], stop[of_word]
            at, more = listed(spans.field("more").filter(pa.array(of_word)))  # the same stretch at other places
            other = more.to_numpy(zero_copy_only=False)
            text, start, stop = np.concatenate([text, text[at]]), np.concatenate([start, other]), np.concatenate([stop, other + stop[at] - start[at]])
            last = np.zeros(b.num_rows, np.int64)
            np.maximum.at(last, text, stop)
            n_words = np.concatenate([[0], np.cumsum(last)])
            passage = covered(n_words, text, start, stop)
            hashes = [hashlib.sha256(data[s:e][~gone[s:e]].tobytes()).hexdigest() for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            longs = [pa.array(x, pa.int64()) for x in (np.diff(off), *stretches(gone, off), *stretches(passage, n_words))]
            yield pa.RecordBatch.from_arrays([b.column("_id"), *longs[:3], pa.array(hashes, pa.string()), *longs[3:]], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_words", "n_passages"])

    return apply


def covered(off: np.ndarray, text: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which symbols of texts with these offsets lie in any span."""
    edge = np.zeros(int(off[-1]) + 1, np.int32)
    np.add.at(edge, off[text] + start, 1)
    np.add.at(edge, off[text] + stop, -1)
    return np.cumsum(edge, dtype=np.int32)[:-1] > 0


def stretches(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marked symbols and maximal marked runs of each text."""
    new = mask.copy()
    new[1:] &= ~mask[:-1]
    inner = off[:-1][np.diff(off) > 0]
    new[inner] = mask[inner]
    each = lambda m: np.diff(np.concatenate([[0], np.cumsum(m, dtype=np.int64)])[off])
    return each(mask), each(new)


def repeated_spans(docs: DataFrame, texts: DataFrame, parts: int, of_bytes: Grain, of_words: Grain, wide: int = WIDE) -> DataFrame:
    """Spans (words, row, start, stop, more) of repeated symbols, which may overlap. docs: (_row, _id, _text); texts: the same, dealt by _row."""
    found = materialize(docs.select("_row", "_text").mapInArrow(_anchor_rows(of_bytes, of_words), _ANCHOR), "anchors")
    key, context = Window.partitionBy("words", "key"), Window.partitionBy("words", "key", "context")
    one = context.orderBy("row", "lo")
    counted = found.where("n > 0").withColumn("total", F.sum("n").over(context)).withColumn("place", F.row_number().over(one))
    counted = counted.withColumn("classes", F.sum((F.col("place") == 1).cast("long")).over(key)).withColumn("fewest", F.min("total").over(key))
    classes = materialize(counted.where("total > 1 OR classes > 1").drop("n", "context"), "contexts")
    span = F.when(F.col("words"), of_words.span).otherwise(of_bytes.span)
    spans = "words", "row", F.col("lo").alias("start"), (F.col("hi") + span).cast("int").alias("stop"), "more"
    settled = classes.where("total > 1").select(*spans).unionByName(found.where("n = 0").select(*spans))
    asked = classes.where("place = 1 AND classes > 1 AND fewest = 1").select("row", F.struct("words", "key", F.col("total").alias("n"), "lo", "hi", "more", (F.col("classes") > wide).alias("wide")).alias("x"))
    # as many partitions as the texts have, so that those are not dealt again
    asked = asked.repartition(n_tasks(parts), "row").groupBy("row").agg(F.collect_list("x").alias("_asked"))  # a text's own anchors
    reps = texts.join(asked, texts["_row"] == asked["row"]).select("_row", "_id", "_text", "_asked").mapInArrow(_cut(of_bytes, of_words), _REP)
    narrow = reps.where("NOT wide").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(16 * parts))).groupBy("bucket").applyInArrow(_refined(of_bytes, of_words), _SPANS_DDL)
    if classes.where(F.col("classes") > wide).isEmpty():
        return settled.unionByName(narrow)
    windows = reps.where("wide").mapInArrow(_window_hashes(of_bytes, of_words), "words boolean, h1 long, h2 long, n long, row long, start int, more array<int>")
    same = ["words", "h1", "h2"]
    twice = windows.groupBy(*same).agg(F.count("*").alias("_times"), F.min("row").alias("_least"), F.max("row").alias("_most"), F.max("n").alias("_n"))
    twice = twice.where("IF(words, _least != _most OR _n > 1, _times > 1)").select(*same)
    loose = windows.where("n = 1").join(twice, same).select("words", "row", "start", (F.col("start") + span).cast("int").alias("stop"), "more")
    return settled.unionByName(narrow).unionByName(loose)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, q: int = Q, step: int = STEP, wide: int = WIDE, passages: Grain = WORDS) -> DataFrame:
    """One row per row of docs: id_col, n_bytes, n_removed, n_spans, kept_sha256, n_shared_words, n_passages."""
    parts = n_parts(docs, text_col)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).select(F.xxhash64("_id", "_text").alias("_row"), "_id", "_text")
    dealt = texts.repartition(n_tasks(parts), "_row")  # shuffled once, for the contexts and for the result
    spans = repeated_spans(texts, dealt, parts, Grain(span, q, step), passages, wide)
    per_row = spans.repartition(n_tasks(parts), "row").groupBy("row").agg(F.collect_list(F.struct("words", "start", "stop", "more")).alias("_spans"))  # a text's own spans
    kind = docs.schema[id_col].dataType.simpleString()
    joined = dealt.join(per_row, dealt["_row"] == per_row["row"], "left").select("_row", "_id", "_text", "_spans")
    return joined.mapInArrow(_result(id_col), f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared_words long, n_passages long")
