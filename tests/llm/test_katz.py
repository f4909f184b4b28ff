import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from docloom.llm import _words, katz, registry


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def discount(counts):
    n = Counter(counts)
    return katz.discounts([n[r] for r in range(katz.K + 2)])


def model(docs, order):
    """Katz backoff with dictionaries."""
    levels = [defaultdict(Counter) for _ in range(order + 1)]
    for d in docs:
        seq = ["^", *tokens(d)]
        for i in range(1, len(seq)):
            levels[1][()][seq[i]] += 1
            for k in range(2, order + 1):
                if i >= k - 1:
                    levels[k][tuple(seq[i - k + 1 : i])][seq[i]] += 1
    ds = [discount([c for ctx in lv.values() for c in ctx.values()]) for lv in levels]
    cut = lambda r, d: d[r] * r if r <= katz.K else r

    def p(k, ctx, w):
        seen = levels[k].get(ctx)
        if k == 1:
            total = sum(seen.values())
            left = 1 - sum(cut(r, ds[1]) for r in seen.values()) / total
            return cut(seen[w], ds[1]) / total if seen[w] else left
        if not seen:
            return p(k - 1, ctx[1:], w)
        total = sum(seen.values())
        if all(r > katz.K for r in seen.values()):
            total += 1
        if seen[w]:
            return cut(seen[w], ds[k]) / total
        left = 1 - sum(cut(r, ds[k]) for r in seen.values()) / total
        return left / (1 - sum(p(k - 1, ctx[1:], x) for x in seen)) * p(k - 1, ctx[1:], w)

    return p, levels


@pytest.mark.parametrize("order, share", [(1, None), (2, None), (2, 40), (3, 40)])
def test_brute_force(spark, order, share):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).withColumn("text", F.substring("text", 1, 700))
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(900, None), (902, "the the the the the the the the"), (903, "unseen1 unseen2 The")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in katz.score(df, katz.in_training(), order=order, parts=5, share=share).collect()}
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    p, levels = model(train, order)
    words = levels[1][()]
    n, v = sum(words.values()), len(words)
    assert len(got) == len(rows)
    for i, t in rows:
        seq = ["^", *tokens(t)]
        want = sum(math.log10(p(min(order, j + 1) if order > 1 else 1, tuple(seq[max(0, j - min(order, j + 1) + 1) : j]) if order > 1 else (), seq[j])) for j in range(1, len(seq)))
        assert got[i].score == pytest.approx(want, rel=1e-9), i
        assert (got[i].n_tokens, got[i].train_tokens, got[i].held_out) == (len(seq) - 1, n, zlib.crc32(str(i).encode()) % 7 == 2)
        assert got[i].n_known == sum(words[w] > 0 for w in seq[1:])
        assert got[i].base_score == pytest.approx(sum(math.log10((words[w] + 1) / (n + v + 1)) for w in seq[1:]))


def test_odd_and_empty(spark, odd):
    assert katz.score(odd, katz.in_training(), parts=3).count() == odd.count()
    assert katz.score(odd.limit(0), katz.in_training(), parts=3).count() == 0
    assert {r.score for r in katz.score(odd, F.lit(False), parts=3).collect()} == {0.0}


def test_better_than_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = katz.score(docs, katz.in_training()).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_query_order(spark, tmp_path):
    """The registered query is the trigram model."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).withColumn("text", F.substring("text", 1, 400))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.score for r in registry.op2_katz(spark, str(tmp_path)).collect()}
    p, _ = model([t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2], 3)
    for i, t in rows:
        seq = ["^", *tokens(t)]
        assert got[i] == pytest.approx(sum(math.log10(p(min(3, j + 1), tuple(seq[max(0, j - 2) : j]), seq[j])) for j in range(1, len(seq))), rel=1e-9), i


def test_order_four(spark):
    """Contexts that are hashes of three words, divided and not."""
    rows = [(i, " ".join(f"w{i * j % 7 % 4}" for j in range(1, 60))) for i in range(12)] + [(90, None), (91, "new w1 w2 w3 w1")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    p, _ = model([t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2], 4)
    for share in (None, 20):
        got = {r.doc_id: r.score for r in katz.score(df, katz.in_training(), order=4, parts=3, share=share).collect()}
        for i, t in rows:
            seq = ["^", *tokens(t)]
            want = sum(math.log10(p(min(4, j + 1), tuple(seq[max(0, j - 3) : j]), seq[j])) for j in range(1, len(seq)))
            assert got[i] == pytest.approx(want, rel=1e-9), (i, share)


@pytest.mark.parametrize("bits", [1, 20, 50, 64])
def test_sorted(bits):
    """Keys that fit with their places, hashes, and keys that differ only in what is cut."""
    r = np.random.default_rng(bits)
    full = r.integers(0, 1 << bits, 5000, dtype=np.uint64, endpoint=False) if bits < 64 else r.integers(0, (1 << 64) - 1, 5000, dtype=np.uint64)
    for key in (full, np.repeat(full[:50], 9), full[:1], full[:0], np.uint64((1 << 64) - 5000) + full % np.uint64(4000)):
        got, order = katz._sorted(key)
        want = np.argsort(key, kind="stable")
        assert (order == want).all() and (got == key[want]).all()


def test_whole_tokens_are_not_argsorted(monkeypatch):
    """A replay orders the k-grams of all tokens by plain sorts of packed keys (F1: CPU seconds)."""
    unit = zstandard.ZstdCompressor()
    texts = [" ".join(f"w{i * j % 53}" for j in range(300)) for i in range(1, 20)]
    docs = pa.table({"_id": list(range(19)), "_text": pa.array([unit.compress(t.encode()) for t in texts], pa.binary()), "_train": [True] * 19, "_part": pa.array([0] * 19, pa.int32())})
    sizes, plain = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, *x, **k: sizes.append(len(a)) or plain(a, *x, **k))
    monkeypatch.setattr(np, "unique", lambda a, *x, f=np.unique, **k: sizes.append(len(a)) or f(a, *x, **k))
    part = katz.Part(docs, 1)
    *_, place = part.ask_words()
    n = int(place.max()) + 1
    count = np.bincount(place, minlength=n)
    known = {"n": np.bincount(np.minimum(count, katz.K + 2), minlength=katz.K + 2)[: katz.K + 2], "total": len(place), "types": n, "ranks": n}
    part.with_words(count, np.arange(1, n + 1).astype(np.uint64), place, known)
    part.ask(1 << 40)
    assert len(place) == 19 * 301 and max(sizes, default=0) < len(place) * 0.9


def test_words_at_block_ends(monkeypatch):
    """Blocks end after a separator or where a row begins, be the last one near or far."""
    monkeypatch.setattr(_words, "_BLOCK", 6000)
    texts = ["a b" * 3000, "x" * 20000, "", "y " + "z" * 5500 + "\t" + "q" * 9000, "end\x0bof\x0cit " * 700, "w" * 6000]
    data, off = _words.flat(pa.array(texts))
    s, e, _, first = _words.words(data, off)
    raw = "".join(texts)
    assert [[raw[a:b] for a, b in zip(s[i:j], e[i:j], strict=True)] for i, j in zip(first, first[1:], strict=False)] == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
