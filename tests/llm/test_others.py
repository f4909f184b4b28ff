"""Odd inputs and brute force for the operators without tests of their own."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import bpe, chat, exact_dedup, jaccard_join, licenses, mixing, quality, shards, suffix
from docloom.llm._words import flat, grams, words
from docloom.llm.registry import public_tokenizer


def test_bpe_tree_equals_library():
    c, r = bpe.Coder(public_tokenizer()), random.Random(5)
    bits = ["a", "the ", "'s", "'re", "'r", "e", "'", " ", "\n", "é", "é", "İ", "ß", "12", "<|endoftext|>", "<|start", "oftext|>", "!!!", "日本語", "👍🏽", "̀", "\x85", "\xa0", "ing", "tion", "가", "가"]
    for k in range(400):
        text = "".join(r.choice(bits if k % 3 else bits[:6]) for _ in range(r.choice([5, 50, 400])))
        text = "".join(r.choice("abcdeth") for _ in range(600)) if k % 5 == 0 else text
        want = c.tok.encode(text, add_special_tokens=False).ids
        assert c.long(text, r.choice([3, 17, 60, 150]), r.choice([24, 64])).tolist() == want
        ids, decoded = c.whole(text)
        assert np.frombuffer(ids, "<u4").tolist() == want and decoded == c.tok.decode(want, skip_special_tokens=False)


def test_bpe_digest(spark, odd):
    c = bpe.Coder(public_tokenizer())
    got = bpe.digest(odd, public_tokenizer(), leaf=100).collect()

    def want(t):
        ids = c.tok.encode(t or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(c.tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    assert Counter(map(tuple, got)) == Counter((r.doc_id, *want(r.text)) for r in odd.collect())
    assert bpe.digest(odd.limit(0), public_tokenizer()).count() == 0


def test_exact(spark, odd):
    got = exact_dedup.groups(odd).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    rows = odd.collect()
    want = []
    for r in rows:
        ids = [x.doc_id for x in rows if norm(x.text) == norm(r.text)]
        keep = min((i for i in ids if i is not None), default=None)
        want.append((r.doc_id, keep, len(ids), r.doc_id == keep, hashlib.sha256(norm(r.text).encode()).hexdigest()))
    assert Counter(map(tuple, got)) == Counter(want)
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 6, 8, 9]
    assert exact_dedup.groups(odd.limit(0)).count() == 0


def test_keep_first_moves_rows_once(spark, odd):
    """Whole rows are shuffled once and never sorted; the digest is made once for each row. Rows whose ids repeat still leave one."""
    docs = odd.dropDuplicates(["doc_id"])
    plan = exact_dedup.keep_first(docs)._jdf.queryExecution().executedPlan().toString()
    joined = plan[plan.index("ShuffledHashJoin") :]
    assert "SortMergeJoin" not in plan and "SortAggregate" not in joined.split("sha2(")[0] and plan.count("sha2(") == 1
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    rows = [(i, t) for i in (7, 7, 3, None, None) for t in ("a b", "a  b", "c", None)] + [(1, "d"), (2, "d"), (2, "e"), (2, "e")]
    least = {}
    for i, t in rows:
        least[norm(t)] = min((x for x in (i, least.get(norm(t))) if x is not None), default=None)
    got = exact_dedup.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, norm(r.text)) for r in got) == Counter((i, t) for t, i in least.items())
    one = exact_dedup.keep_first(spark.createDataFrame([(None, "a"), (None, "a "), (None, "a  ")], "doc_id long, text string"))
    assert sorted(norm(r.text) for r in one.collect()) == ["a", "a "]


def test_columns_stay(spark, odd):
    """Rows that stay are rows of the input, whatever the names of their columns."""
    every = {tuple(r) for r in odd.collect()}
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for kept in (exact_dedup.keep_first(odd), mixing.sample(odd), jaccard_join.keep_one(odd), quality.keep_good(odd, labels)):
        assert kept.columns == odd.columns and {tuple(r) for r in kept.collect()} <= every


def test_string_ids(spark, odd):
    """Ids of another type than the labels' and no numbers."""
    docs = odd.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    labels = spark.createDataFrame([(6, 1, 0)], "doc_id long, quality int, toxic int")
    for f in (exact_dedup.groups, mixing.mix_sources, jaccard_join.join, suffix.dedup, licenses.scan, shards.shard, lambda d: quality.assess(d, labels), lambda d: bpe.digest(d, public_tokenizer())):
        assert sorted(str(r.doc_id) for r in f(docs).collect()) == sorted(str(r.doc_id) for r in docs.collect())
    assert {r.doc_id: r.component_id for r in jaccard_join.join(docs).collect()}["d7"] == "d6"


def test_exact_digest_clash(spark, odd):
    """Texts that share a digest are told apart by their content."""
    want = Counter(map(tuple, exact_dedup.groups(odd).collect()))
    for digest in (lambda n: F.unhex(F.lit("00")), lambda n: F.unhex(F.format_string("%02x", F.length(n) % 2))):
        assert Counter(map(tuple, exact_dedup.groups(odd, digest=digest).collect())) == want


def test_shards_split_like_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got, want = shards.shard(docs, limit=60_000), con.sql(shards.oracle(60_000))
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())
    assert got.select("shard_id").distinct().count() > 30


def test_mixing(spark, odd):
    got = mixing.mix_sources(odd)
    assert got.count() == odd.count() and got.where("probability < 0 OR probability > 1 OR probability IS NULL").isEmpty()
    assert mixing.sample(odd).columns == odd.columns
    assert mixing.mix_sources(odd.limit(0)).count() == 0
    assert mixing.sample(odd).count() == got.where("sampled").count()


def test_raking_meets_targets(spark):
    cells = spark.createDataFrame([("a", "x", "p", 50), ("a", "y", "p", 30), ("b", "x", "q", 15), ("b", "y", "p", 5), ("a", "x", "q", 9)], "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.6, "y": 0.4}, "topic": {"p": 0.55, "q": 0.45}}
    raked = mixing.rake(cells, targets=targets, iterations=60)
    for dim, shares in targets.items():
        for r in raked.groupBy(dim).agg(F.sum("weight").alias("w")).collect():
            assert r.w == pytest.approx(shares[r[dim]], abs=1e-4)
    drawn = mixing.calibrate(raked, 0.5)
    assert drawn.agg(F.sum(F.col("tokens") * F.col("probability"))).first()[0] == pytest.approx(0.5 * 109)


def test_mixing_unlisted(spark):
    rows = [(i, f"w{i} " * 50, lang, "s") for i, lang in enumerate(["en", "de", "fr", "es", None, "EN", "en-US", "it"] * 25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    weight = {r.lang: r.w for r in mixing.mix_sources(docs).groupBy("lang").agg(F.sum(F.col("weight") / 25).alias("w")).collect()}
    assert weight == pytest.approx({"en": 0.25, "de": 0.1, "fr": 0.075, "es": 0.075} | dict.fromkeys(["(null)", "EN", "en-US", "it"], 0.125), abs=1e-6)
    assert {r.lang for r in mixing.sample(docs).collect()} == {"en", "de", "fr", "es", None, "EN", "en-US", "it"}
    alone = mixing.mix_sources(docs.where("lang IS NULL OR lang = 'it'")).collect()
    assert len(alone) == 50 and {r.probability for r in alone} == {0.5}
    cells = spark.createDataFrame([("a", "x", 5)], "source string, lang string, tokens long")
    assert [r.weight for r in mixing.rake(cells, ("source", "lang"), {"source": 0.5, "lang": {"x": 0.0, "y": 1.0}}).collect()] == [None]


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 300, "ann", "bye"), (None, None, None, "x"), (2, 0, "system", "alone")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(7)).withColumn("perspective", F.lit("no"))
    got = {(r.conv_id, r.perspective, r.segment): r for r in chat.rotate(df).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (1, "ann", 1), (1, "bob", 1), (None, "unknown", 0)}
    ann = got[(1, "ann", 0)]
    assert ann.rendered.startswith("<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\n")
    assert [ann.rendered[s.start : s.end] for s in ann.spans] == ["hi<|im_end|>"] and (ann.n_turns, ann.n_assistant) == (4, 1)
    assert [got[(1, "bob", 0)].rendered[s.start : s.end] for s in got[(1, "bob", 0)].spans] == ["<|im_end|>"] * 2
    assert chat.rotate(df.limit(0)).count() == 0


def test_shards(spark, odd):
    docs = spark.createDataFrame([(i, "x" * (1 + i % 50)) for i in range(2000)] + [(7, "y" * 5000)] * 3, "doc_id long, text string")
    got = shards.shard(docs, limit=700).collect()
    assert len(got) == 2003
    sizes = Counter()
    for r in got:
        sizes[r.shard_id] += r.n_bytes
    assert all(sizes[r.shard_id] == r.shard_bytes for r in got) and all(r.fits == (r.shard_bytes <= 700) for r in got)
    assert {r.doc_id for r in got if not r.fits} == {7}
    names = sorted(sizes)
    assert all(not b.startswith(a) for a, b in zip(names, names[1:], strict=False))
    for name in names:  # a parent never fits
        assert sum(v for k, v in sizes.items() if k.startswith(name[:-1])) > 700
    assert shards.shard(odd, limit=50).count() == odd.count() and shards.shard(odd.limit(0)).count() == 0


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    rep = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w)


def test_quality(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    for df in (docs, odd):
        got = quality.assess(df, labels).collect()
        key = lambda x: tuple(str(v) for v in x)
        assert sorted(((r.doc_id, *r[1:7]) for r in got), key=key) == sorted(((r.doc_id, *base(r.text)) for r in df.collect()), key=key)
    rows, good = docs.collect(), {r.doc_id for r in labels.where("quality = 1 AND toxic = 0").collect()}
    feats = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text))
        feats[r.doc_id] = Counter([(x,) for x in w]) + Counter(zip(w, w[1:], strict=False))
    every = list(set().union(*feats.values()))
    data, off = flat(pa.array([" ".join(g) for g in every]))
    _, _, h, first = words(data, off)
    d = 1 << 12
    slot = {g: int((h[a] if len(g) == 1 else grams(h[a : a + 2], 2)[0]) & np.uint64(d - 1)) for g, a in zip(every, first[:-1], strict=True)}
    raw, target = Counter(), Counter()
    for i, f in feats.items():
        for g, n in f.items():
            raw[slot[g]] += n
            target[slot[g]] += n * (i in good)
    t, u = sum(target.values()), sum(raw.values())
    got = {r.doc_id: r.score for r in quality.assess(docs, labels, slots=d).collect()}
    for i, f in feats.items():
        p = {g: (raw[slot[g]] + 1) / (u + d) for g in f}
        want = sum(n * (np.log((target[slot[g]] + quality.SMOOTHING * p[g]) / (t + quality.SMOOTHING)) - np.log(p[g])) for g, n in f.items()) / max(1, sum(f.values()))
        assert got[i] == pytest.approx(want)
    assert quality.keep_good(odd, labels).columns == odd.columns
    assert quality.assess(odd.limit(0), labels).count() == 0
    assert quality.assess(docs, labels.limit(0)).where("score <> 0").isEmpty()


def test_licenses(spark, odd):
    docs = spark.createDataFrame([
        (1, "Some prose here.\nReleased under the MIT License.\nMore."), (2, "it was licensed under cc by-nc 4.0, they said"), (3, "This work is licensed under the GNU general public license version 3"),
        (4, "a licence to kill under the bridge"), (5, "Permission is hereby granted, free of charge, to anyone obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
        (6, "Licensed under the Apache License, Version 2.0. " * 2 + "Licensed under CC BY 4.0."),
    ], "doc_id long, text string")
    got = {r.doc_id: (r.n_matches, r.license_ids) for r in licenses.scan(docs).collect()}
    assert got == {1: (1, "MIT"), 2: (1, "CC-BY-NC-4.0"), 3: (1, "GPL-3.0"), 4: (0, ""), 5: (1, "MIT"), 6: (3, "Apache-2.0,CC-BY-4.0")}
    assert licenses.scan(odd).where("n_matches > 0").isEmpty() and licenses.scan(odd.limit(0)).count() == 0


def test_quality_held_out(spark):
    """The threshold lets through good rows that the model has not seen, and stops rows of other words."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.where("doc_id % 3 > 0")
    unseen = quality.assess(docs, seen).where("NOT base_failed").join(labels.where("doc_id % 3 = 0"), "doc_id")
    good, bad = (unseen.where(f"{w}(quality = 1 AND toxic = 0)").agg(F.avg(F.col("kept").cast("int"))).first()[0] for w in ("", "NOT "))
    assert good > 0.95 and bad < good - 0.2
    weight, threshold = quality.fit(docs, labels)
    again, same = quality.fit(docs.repartition(7), labels)
    assert threshold == pytest.approx(same) and np.allclose(weight, again)


def slow_difference(a, b):
    """Least edits between a and any stretch of b, by plain dynamic programming."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return min(row)


def altered(r, w):
    """The words with some inserted, deleted or replaced, and how many at most."""
    w, n = list(w), r.randrange(0, len(w) // 3 + 1)
    for _ in range(n):
        at = r.randrange(len(w))
        w[at : at + r.randrange(2)] = ["other"] * r.randrange(2)
    return w


def test_license_differences():
    r = random.Random(3)
    for _ in range(300):
        a, b = ([r.randrange(3) for _ in range(r.randrange(1, 9))] for _ in range(2))
        b = b * r.randrange(1, 4)
        edits, start, stop = licenses.difference(np.array(a), np.array(b))
        assert edits == slow_difference(a, b) == slow_difference(a, b[start:stop])


def test_licenses_brute_force():
    """Altered notices in prose: a match exactly where some template is within its allowance, and the nearest template's license."""
    s, r, exact = licenses.Scanner(), random.Random(11), 0
    for n in range(400):
        k = n % len(s.words)
        text = ["prose"] * 5 + altered(r, s.words[k]) + ["more", "prose"]
        near = {i: d for i, w in enumerate(s.words) if (d := slow_difference(w, text)) <= s.allowed[i]}
        found = s.scan(" ".join(text))[1]
        assert bool(found) == bool(near)
        if found:
            assert any(s.names[i] == found[0][0] for i in near)
        if near.get(k) == 0:
            assert found == [(s.names[k], found[0][1], 0)] or len(s.words[k]) < max(len(s.words[i]) for i in near)
            exact += 1
    assert exact > 50


def test_licenses_by_compression(spark, monkeypatch):
    """With other compressors the results are others: the ranking decides between templates that are all within their allowance."""
    every = [t for _, t in licenses.TEMPLATES]
    s = licenses.Scanner()
    right = [s.scan(t)[1] for t in every]
    assert [[x[0] for x in f] for f in right] == [[n] for n, _ in licenses.TEMPLATES] and all(f[0][2] == 0 for f in right)
    s.given = s.given[7:] + s.given[:7]
    assert sum(s.scan(t)[1] != f for t, f in zip(every, right, strict=True)) > len(every) // 2
    noise = random.Random(1)
    s.given = [type("Noise", (), {"compress": lambda self, raw: b"x" * noise.randrange(2 * len(raw))})() for _ in s.given]
    assert [s.scan(t)[1] for t in every] != right


def test_licenses_long(spark):
    """Texts over 1 MiB: notices one after another, and phrases that are no notice."""
    notice = "Licensed under CC BY-SA 4.0. Released under the MIT License. "
    assert licenses.Scanner().scan("some prose " * 100_000 + notice + "more words " * 20_000)[1] == [("CC-BY-SA-4.0", pytest.approx(0.5, abs=0.5), 0), ("MIT", pytest.approx(0.5, abs=0.5), 0)]
    many = licenses.Scanner().scan(notice * 500)[1]
    assert Counter(m[0] for m in many) == {"CC-BY-SA-4.0": 500, "MIT": 500}
    assert licenses.Scanner().scan("terms of the license and more " * 40_000)[1] == []


def test_licenses_real(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plain = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT"}
    want = {r.doc_id: {n for t, n in plain.items() if t in r.text} for r in docs.collect()}
    got = {r.doc_id: set(filter(None, r.license_ids.split(","))) for r in licenses.scan(docs).collect()}
    assert any(want.values()) and all(want[i] <= got[i] for i in want)
    assert sum(got[i] != want[i] for i in want) <= 2


def test_bpe_normal_form(spark):
    c = bpe.Coder(public_tokenizer())
    texts = [f"{x}A b{x}{x} c{x}1" for x in map(chr, range(0x260))] + ["  a\t\n b ", "It'S don'T 12 a1b2 ÀÉ ²³¼ ª", "\r\n", "a\x1c b\x1f\x1f c"]
    assert all(c.normal(t) == c.tok.normalizer.normalize_str(t) for t in texts)
    assert all(c.whole(t) == (c.encode(t).tobytes(), c.decode(c.encode(t).tolist())) for t in texts)
