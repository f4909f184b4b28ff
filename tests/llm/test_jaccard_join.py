import re

import pytest
from pyspark.sql import functions as F

from docloom.llm import jaccard_join as jj


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i in range(len(sets)):
        least[root(i)] = min(least.get(root(i), 1 << 60), sets[i][0])
    return sorted((sets[i][0], len(sets[i][1]), least[root(i)]) for i in range(len(sets)))


def variants(rng, base, n, rate, vocabulary):
    """A chain of texts, each some words off an earlier one."""
    texts = [base]
    for _ in range(n):
        w = list(rng.choice(texts))
        for _ in range(max(1, int(len(w) * rate))):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(w)
    return texts


@pytest.mark.parametrize("region", [jj.REGION, 4])
def test_brute_force(spark, region):
    import random

    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for size, rate in ((40, 0.01), (30, 0.03), (25, 0.05)):
        texts += variants(rng, [rng.choice(vocabulary) for _ in range(120)], size, rate, vocabulary)
    texts += [[rng.choice(vocabulary) for _ in range(40)] + passage + [rng.choice(vocabulary) for _ in range(20)] for _ in range(30)]
    texts += [passage[:k] for k in range(0, 60, 2)] + [["A", "b"], ["a", "B"], ["a"], []]
    rows = [(i * 3 + 1, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got = jj.join(spark.createDataFrame(rows, "doc_id long, text string"), region=region)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_real(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(map(tuple, jj.join(docs).collect())) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_and_empty(spark, odd):
    got = jj.join(odd).collect()
    assert len(got) == odd.count()
    by = {(r.doc_id, r.n_shingles): r.component_id for r in got}
    assert by[(6, 97)] == by[(7, 97)] == 6 and by[(1, 0)] == 1 and by[(5, 1)] == 4 and by[(None, 1)] == 4
    assert jj.join(odd.limit(0)).count() == 0
    assert jj.keep_one(odd.where("doc_id > 5")).count() == 3
    assert jj.keep_one(odd).columns == odd.columns
    assert F.col is not None


def rooted(edges):
    """(node, root) of the nodes that are not their component's smallest, by union-find."""
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return sorted((i, root(i)) for i in up if root(i) != i)


def random_tree(rng, n, path):
    ids = rng.sample(range(1000), n)
    return [tuple(sorted((ids[i], ids[i - 1 if path else rng.randrange(i)]))) for i in range(1, n)]


def test_components(spark):
    import random

    rng = random.Random(5)
    # after one round of the first, 5 hangs under both 1 and 2
    graphs = [[(1, 5), (5, 6), (6, 7), (2, 7)]] + [random_tree(rng, n, path) for n in (5, 6, 8, 10, 40) for path in (True, False)]
    graphs.append([(g * 1000 + a, g * 1000 + b) for g in range(200) for a, b in random_tree(rng, rng.choice((5, 6, 8, 10)), g % 2 == 0)])
    for edges in graphs:
        got = jj.components(spark.createDataFrame(edges, "a long, b long"))
        assert sorted(map(tuple, got.collect())) == rooted(edges)
    assert jj.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("least", [1, 30])
def test_family_of_near_copies(monkeypatch, least):
    """Points of one base that mostly do not link with a pivot are not divided anew for each of them."""
    import numpy as np

    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 40, 396).astype(np.uint64)
    sets = []
    for k in rng.integers(least, 70, 300):
        s = base.copy()
        s[rng.choice(396, k, replace=False)] = rng.integers(0, 1 << 40, k)
        sets.append(np.unique(s))
    calls = []
    divide = jj.Region.divide
    monkeypatch.setattr(jj.Region, "divide", lambda self, *a: calls.append(1) or divide(self, *a))
    region = jj.Region(sets)
    outside = region.join(np.arange(300), 0)
    assert len(calls) < 12
    linked = [[100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)) for b in sets] for a in sets]
    want = dict(rooted([(i, j) for i in range(300) for j in range(i) if linked[i][j]]))
    assert [region.root(i) for i in range(300)] == [want.get(i, i) for i in range(300)]
    assert sorted(outside.tolist()) == [i for i in range(300) if not linked[0][i]]
