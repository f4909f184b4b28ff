import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from docloom.llm import suffix


def brute(rows, span):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + span] for d in data for i in range(len(d) - span + 1))
    out = []
    for (i, _), d in zip(rows, data, strict=True):
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - span + 1):
            if seen[d[k : k + span]] > 1:
                gone[k : k + span] = True
        spans = int(gone[:1].sum() + (np.diff(gone.astype(int)) == 1).sum())
        out.append((i, len(d), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()))
    return sorted(out)


def brute_words(rows, span):
    """Words in runs of span words that another row has too, and the number of such stretches."""
    data = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = {}
    for k, d in enumerate(data):
        for i in range(len(d) - span + 1):
            seen.setdefault(tuple(d[i : i + span]), set()).add(k)
    out = []
    for (i, _), d in zip(rows, data, strict=True):
        hit = np.zeros(len(d), bool)
        for k in range(len(d) - span + 1):
            if len(seen[tuple(d[k : k + span])]) > 1:
                hit[k : k + span] = True
        out.append((i, int(hit.sum()), int(hit[:1].sum() + (np.diff(hit.astype(int)) == 1).sum())))
    return sorted(out)


def texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(r.randrange(60, 120)) for _ in range(6)]
    out = []
    for k in range(60):
        t = prose(r.randrange(5, 80))
        for _ in range(r.randrange(0, 4)):
            p = r.choice(passages)
            cut = r.randrange(0, 120)
            t += p[cut : len(p) - r.randrange(0, 120)] + prose(r.randrange(0, 30))
        out.append(t)
        if k % 9 == 0:
            out.append(t)
            out.append(t[:300] + "#" + t[301:])
    return [*out, "a" * 1500, "ab" * 700, "", "x" * 399, "y" * 400, "z" * 401]


@pytest.mark.parametrize("span, q, step, wide", [(400, 32, 25, suffix.WIDE), (400, 32, 25, 2), (64, 16, 8, suffix.WIDE)])
def test_brute_force(spark, span, q, step, wide):
    rows = list(enumerate(texts(span + wide)))
    got = suffix.dedup(spark.createDataFrame(rows, "doc_id long, text string"), span=span, q=q, step=step, wide=wide).collect()
    assert sorted(tuple(r)[:5] for r in got) == brute(rows, span)
    assert sorted((r.doc_id, r.n_shared_words, r.n_passages) for r in got) == brute_words(rows, 51)
    assert any(r.n_shared_words for r in got) and not all(r.n_shared_words for r in got)


@pytest.mark.parametrize("wide", [suffix.WIDE, 2])
def test_passages(spark, wide):
    """Passages of short words (under 400 bytes), with other white space, at several places of a text, and repeated only within one."""
    r = random.Random(wide)
    prose = lambda n: [str(r.randrange(1000)) for _ in range(n)]
    shared, own, edge, short = prose(60), prose(70), prose(51), prose(50)
    docs = [prose(20) + shared + prose(9) + shared + prose(5), prose(4) + shared, prose(8) + own + prose(6) + own, edge, prose(3) + edge, prose(9) + short, short + prose(9)]
    docs += [prose(k) + shared[: 52 + k % 8] + prose(3) for k in range(40)]
    rows = [(k, (" ", "\n", "\t ")[k % 3].join(d)) for k, d in enumerate(docs)]
    got = suffix.dedup(spark.createDataFrame(rows, "doc_id long, text string"), wide=wide).collect()
    want = brute_words(rows, 51)
    assert sorted((r.doc_id, r.n_shared_words, r.n_passages) for r in got) == want
    assert [w[1] for w in want[:7]] == [120, 60, 0, 51, 51, 0, 0]


def test_real(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = suffix.dedup(docs).collect()
    assert sorted(tuple(r)[:5] for r in got) == brute(rows, 400)
    assert sorted((r.doc_id, r.n_shared_words, r.n_passages) for r in got) == brute_words(rows, 51)


def test_very_long(spark):
    """A text over 2 MiB: pieces and block joins, and a long copy of one of its stretches."""
    r = random.Random(7)
    big = " ".join("".join(r.choices("abcdefgh", k=r.randrange(2, 9))) for _ in range(400_000))
    assert len(big) > 2 << 20
    cut = (1 << 20) - 5000
    rows = [(1, big), (2, big[cut : cut + 9000]), (3, "x" + big[-500:])]
    got = {x.doc_id: x for x in suffix.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].n_removed for k in (1, 2, 3)] == [9500, 9000, 500]
    assert [(x.doc_id, x.n_shared_words, x.n_passages) for x in sorted(got.values())] == brute_words(rows, 51)


def test_pieces(monkeypatch):
    monkeypatch.setattr(suffix, "_PIECE", 1000)
    rng = np.random.default_rng(1)
    b = rng.integers(97, 100, 5000).astype(np.uint8)
    lo, hi, _, _ = suffix.anchors(b)
    assert lo[0] == 0 and hi[-1] == 4600 and (lo[1:] == hi[:-1] + 1).all()


def test_odd_and_empty(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    key = lambda r: (r[0] is None, r)
    got = sorted((tuple(r) for r in suffix.dedup(odd).collect()), key=lambda r: str(r))
    assert len(got) == len(rows)
    assert {r[0]: r[2] for r in got if r[0] in (6, 7, 9)} == {6: len(rows[8][1]), 7: len(rows[8][1]), 9: 600}
    assert suffix.dedup(odd.limit(0)).count() == 0
    assert key is not None
