"""Katz backoff language model: counts in partitioned tables, scored where the texts are.

    P_k(w | v) = d_r r / c(v)            if the k-gram v w was seen r times
               = a(v) P_{k-1}(w | v')    otherwise (v' is v without its first word)

d_r is the Good-Turing discount of Katz for r up to K, 1 above. a(v) makes P_k(. | v) add up to exactly 1:
(1 - sum of the discounted) / (1 - sum of P_{k-1} over the same words). A context whose continuations are
all above K has nothing left for others; its counts are divided by c(v) + 1 instead. The lowest order is
discounted too; what is left there is the probability of one unknown word. Contexts begin with a start mark
and every text ends with an end token.

Texts are dealt to parts of bounded bytes (one shuffle, which all steps share). For each order, a part sends
its distinct k-grams to the count tables: rows (bucket, part, packed counts), partitioned by the hash of the
context. The tables of order 1 also number the words, frequent ones first, so that k-grams are small numbers.
The number of a context's training tokens is its own count as a k-gram, which the part knows from the order
before; what was never seen as a k-gram is not asked for as a context. The lower probabilities that a backoff
weight needs are sent as the counts that they are made of. A context with more tokens than a bucket's fair share
N / buckets, which at most as many contexts as there are buckets can have, is divided by word over several
buckets; its partial sums are added up and sent to those buckets only, and the counts of counts to all. The buckets
send back counts and backoff weights in the order in which they were asked, so no key travels back, and the counts of
counts; the part then evaluates the recursion for each of its tokens. A word of any frequency is one entry from each part.
Texts travel compressed one by one.

Null texts are empty: one end token. Repeated rows are scored and counted as often as they occur. Without
training rows all words are unknown (c = 0, N = 0, V = 0), with probability 1. Words, and contexts of three words
or more, are 64-bit hashes: m of them clash with a chance of about m^2 / 2^65. Texts of any length are whole; a
part holds at least one.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import n_parts, n_tasks
from ._words import mix, pack_all, small, unpack_all, words

ORDER = 3
#: Text bytes of a part: a task holds some twenty numbers for each token.
PART = 9 << 20
K = 5
END = np.uint64(0xE2D0)
_32 = np.uint64(32)
_LOW = np.uint64((1 << 32) - 1)
_MULT = np.uint64(0xD6E8FEB86659FD93)
_BLOB = "bucket int, part int, blob binary, told array<long>"
#: Counts of counts (1 to K + 1 at their places), all tokens, distinct ones, words of the fullest bucket.
_TOLD = K + 5


def discounts(n: np.ndarray) -> np.ndarray:
    """d_0 .. d_K from n[1] .. n[K + 1], the numbers of k-grams seen that often (n[0] is unused)."""
    d = np.ones(K + 1)
    n = np.asarray(n, float)
    common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        good = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
        d[r] = good if 0 < good < 1 else r / (r + 1)  # where the estimate fails
    return d


def discounted(r: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(r <= K, d[np.minimum(r, K)] * r, r)


def _new(key: np.ndarray) -> np.ndarray:
    """Where a sorted key differs from the one before."""
    return np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]])


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An unsigned key in order, and the places that it comes from; equal ones keep theirs.

    Keys are sorted with their places as lowest bits, which takes a sixth of the time of argsort. What does not fit 64 bits
    is cut and the result looked through: hashes are nearly always in order then, other keys are sorted again.
    """
    n = len(key)
    bits = max(n - 1, 0).bit_length()
    over = max(0, int(key.max(initial=0)).bit_length() + bits - 64)
    packed = (key >> np.uint64(over)) << np.uint64(bits) | np.arange(n, dtype=np.uint64)
    packed.sort()
    order = (packed & np.uint64((1 << bits) - 1)).view(np.int64)
    if not over:
        return packed >> np.uint64(bits), order
    out = key[order]
    if (out[1:] < out[:-1]).any():
        order = np.argsort(key, kind="stable")
        out = key[order]
    return out, order


def _ranks(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The rank of each key among the distinct ones."""
    rank = np.empty(len(order), np.int32 if len(order) < 1 << 31 else np.int64)
    rank[order] = np.cumsum(new, dtype=rank.dtype) - 1
    return rank.astype(np.int64)


class Part:
    """The tokens of one part's texts."""

    def __init__(self, table: pa.Table, buckets: int):
        unzip = zstandard.ZstdDecompressor()
        texts = [unzip.decompress(x) if x else b"" for x in table.column("_text").to_pylist()]
        off = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        _, _, h, first = words(np.frombuffer(b"".join(texts), np.uint8), off)
        del texts
        n = np.diff(first)
        rows = len(n)
        at = np.arange(len(h)) + np.repeat(np.arange(rows), n)
        self.token = np.full(len(h) + rows, END)
        self.token[at] = h
        self.first = first[:-1] + np.arange(rows)
        self.size = n + 1
        self.begins = np.zeros(len(self.token), bool)
        self.begins[self.first] = True
        self.train = np.repeat(table.column("_train").to_numpy(zero_copy_only=False).astype(bool), self.size)
        self.buckets = buckets

    def ask_words(self):
        """Distinct words by bucket, where the buckets begin and end, and each token's place among the words."""
        coded = pa.array(self.token).dictionary_encode()
        u, order = _sorted(coded.dictionary.to_numpy())
        bucket = ((u >> np.uint64(20)) % np.uint64(self.buckets)).astype(np.int64)
        second = _by_bucket(bucket, self.buckets)
        u, bucket, order = u[second], bucket[second], order[second]
        place = np.empty(len(u), np.int64)
        place[order] = np.arange(len(u))
        return *_cuts(bucket), u, place[coded.indices.to_numpy()]

    def counted(self, place: np.ndarray, n: int, at=slice(None)) -> np.ndarray:
        """Training counts of n things from the places of tokens."""
        return np.bincount(place[self.train[at]], minlength=n).astype(np.int64)

    def with_words(self, count: np.ndarray, number: np.ndarray, place: np.ndarray, stats) -> None:
        """Takes the counts and numbers (0: unseen) of the distinct words."""
        self.word, self.counts = place, count
        self.unigrams, self.number = count[place], number[place]
        weight, left = unknown(stats)
        self.low = np.where(count > 0, discounted(count, discounts(stats["n"])) * weight, left)[place]
        self.exact = int(stats["ranks"]) * self.buckets < (1 << 32) - 1  # two words fit 64 bits
        before = lambda x: np.concatenate([x[:1] * 0, x[:-1]])
        self.before = before
        # numbers by their order, in few bits; the start mark is number 0 as a context, and seen as often as the end token
        self.dense = _rank(np.append(np.uint64(0), number))[1:].astype(np.uint64)[place]
        self.bits = np.uint64(int(self.dense.max(initial=0)).bit_length())
        self.gram = np.where(self.begins, np.uint64(0), before(self.dense))
        self.context = np.where(self.begins, np.uint64(0), before(self.number))
        self.total = np.where(self.begins, self.unigrams[-1:], before(self.unigrams))
        self.r, self.base = self.unigrams, np.zeros(len(self.token), np.int64)
        self.valid = np.ones(len(self.token), bool)

    def ask(self, share: int):
        """Prepares to ask for the distinct k-grams (context, word) of seen contexts, by bucket.

        Runs are the k-grams of one context in one bucket.
        """
        at = self.asked = np.flatnonzero(self.valid & (self.total > 0))
        # contexts by their order and words as one number
        v = self.gram[at] if not self.long or self.pairs else np.unique(self.context[at], return_inverse=True)[1].astype(np.uint64)
        key, order = _sorted(v << self.bits | self.dense[at])
        new = _new(key)
        self.place = _ranks(order, new)
        one = at[order[new]]
        heads = np.flatnonzero(_new(key[new] >> self.bits))
        run = np.diff(np.append(heads, len(one)))
        v, total = self.context[one[heads]], self.total[one[heads]]
        pieces = np.maximum(1, -(-total // share))
        home = mix(v) >> np.uint64(20)
        of = np.repeat(np.arange(len(heads)), run)
        bucket = (home % np.uint64(self.buckets)).astype(np.int64)[of]
        if (pieces > 1).any():  # one of as many buckets as the context has pieces
            wide = np.flatnonzero((pieces > 1)[of])
            c = of[wide]
            bucket[wide] = ((home[c] + mix(self.number[one[wide]]) % pieces[c].astype(np.uint64)) % np.uint64(self.buckets)).astype(np.int64)
        order = _by_bucket(bucket, self.buckets)
        self.among = np.empty(len(order), np.int64)
        self.among[order] = np.arange(len(order))
        self.bucket, self.cuts = _cuts(bucket[order])
        of = of[order]
        new = _new(of)
        new[self.cuts[:-1]] = True
        heads = np.flatnonzero(new)
        self.run = np.diff(np.append(heads, len(of)))
        self.one, of = one[order], of[heads]
        self.runs = v[of], total[of], pieces[of]

    def written(self, level: int) -> list[bytes]:
        """The requests, one for each bucket.

        Of runs: context, tokens of the shorter context, pieces. Of k-grams: word, training count here, count of the word after the shorter context.
        """
        heads = np.cumsum(self.run) - self.run
        w, count = self.number[self.one], np.empty(len(self.one), np.int64)
        count[self.among] = self.counted(self.place, len(self.one), self.asked)
        r, base = np.where(count > 0, self.r[self.one], 0), self.base[self.one[heads]]
        v, _, pieces = self.runs
        cuts = np.searchsorted(heads, self.cuts)
        return [_written(v[i:j], self.run[i:j], base[i:j], pieces[i:j], w[a:b], count[a:b], r[a:b], level) for a, b, i, j in zip(self.cuts, self.cuts[1:], cuts, cuts[1:], strict=False)]

    def apply(self, r: np.ndarray, alpha: np.ndarray, short: np.ndarray, n, last: bool, base: bool) -> None:
        """One step of the recursion from counts of k-grams and weights of runs; then, unless it is the last, contexts one word longer.

        base: the tokens of contexts are kept for requests."""
        at, place = self.asked, self.among[self.place]
        total = np.repeat(self.runs[1] + short, self.run)
        value = np.where(r > 0, discounted(r, discounts(n)) / total, np.repeat(alpha, self.run))[place]
        r = r[place]
        self.low = self.low.copy()
        self.low[at] = np.where(r > 0, value, value * self.low[at])
        if last:
            return
        seen = np.zeros(len(self.token), np.int64)
        seen[at] = r
        if base:
            self.base = np.zeros(len(self.token), np.int64)
            self.base[at] = total[place]
        self.pairs = self.exact and not self.long
        longer = (self.context << _32) | self.number if self.pairs else mix(self.context * _MULT + self.number)
        if self.pairs:  # the places of pairs in order are those of the contexts
            self.gram = np.zeros(len(self.token), np.uint64)
            self.gram[at] = self.place
            self.gram = self.before(self.gram)
        self.long = True
        self.r = seen
        self.valid = self.before(self.valid) & ~self.begins
        self.context, self.total = np.where(self.valid, self.before(longer), np.uint64(0)), np.where(self.valid, self.before(seen), 0)

    long = False  # contexts have more than one word


def unknown(stats) -> tuple[float, float]:
    """Weight of one discounted count, and the probability of the one unknown word: what discounting leaves."""
    n, total = np.asarray(stats["n"], float), int(stats["total"])
    if not total:
        return 0.0, 1.0
    d = discounts(n)
    left = sum((1 - d[r]) * r * n[r] for r in range(1, K + 1)) / total
    return (1 / total, float(left)) if left > 0 else (1 / (total + 1), 1 / (total + 1))


def _by_bucket(bucket: np.ndarray, buckets: int) -> np.ndarray:
    return np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")


def _cuts(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted buckets, each once, and where they begin and end."""
    first = np.flatnonzero(_new(bucket))
    return bucket[first], np.append(first, len(bucket))


def _answers(table: pa.Table, level: int) -> list[tuple[int, list[np.ndarray]]]:
    rows = [(b, bytes(x)) for lv, b, x in zip(*(table.column(c).to_pylist() for c in ("level", "bucket", "blob")), strict=True) if lv == level]
    return [(b, unpack_all(x)) for b, x in sorted(rows)]


def _cat(xs: list[np.ndarray], t) -> np.ndarray:
    return np.concatenate(xs).astype(t) if xs else np.zeros(0, t)


def _known(told: list[int]) -> dict:
    return {"n": told[: K + 2], "total": told[K + 2], "types": told[K + 3], "ranks": told[K + 4]}


def _stats(table: pa.Table) -> dict[int, dict]:
    """What the answers of each level say of all counts; none where nothing was asked."""
    levels = table.column("level").to_pylist()
    return {lv: _known(table.column("told")[levels.index(lv)].as_py()) for lv in set(levels)}


_NOTHING = _known([0] * _TOLD)


def _replay(docs: pa.Table, answers: pa.Table, buckets: int, share: int | None, upto: int, last: int | None = None) -> Part:
    """The part's tokens with the recursion evaluated up to order `upto`."""
    part = Part(docs, buckets)
    stats = _stats(answers)
    *_, place = part.ask_words()
    told = _answers(answers, 1)
    number = [np.where(rank > 0, (rank.astype(np.uint64) - np.uint64(1)) * np.uint64(buckets) + np.uint64(b + 1), np.uint64(0)) for b, (_, rank) in told]
    part.with_words(_cat([c for _, (c, _) in told], np.int64), _cat(number, np.uint64), place, stats[1])
    for level in range(2, upto + 1):
        part.ask(share or _share(stats[1], buckets))
        told = [x for _, x in _answers(answers, level)]
        part.apply(_cat([x[0] for x in told], np.int64), _cat([x[1] for x in told], float), _cat([x[2] for x in told], np.int64), stats.get(level, _NOTHING)["n"], level == last, level == upto)
    return part


def _share(stats, buckets: int) -> int:
    return max(1000, int(stats["total"]) // buckets)


def _differences(a: np.ndarray, new: np.ndarray) -> np.ndarray:
    """a less the one before, where none is new."""
    return a - np.where(new, np.uint64(0), np.concatenate([a[:1], a[:-1]]))


def _sums(gap: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What _differences took; first: the place of the last new one."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(gap, dtype=np.uint64)])
    return total[1:] - total[first]


def _by_key(key: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The value of each distinct key, in order."""
    key, order = _sorted(key)
    return value[order[_new(key)]]


def _rank(key: np.ndarray) -> np.ndarray:
    key, order = _sorted(key)
    return _ranks(order, _new(key))


def _written(v: np.ndarray, run: np.ndarray, base: np.ndarray, pieces: np.ndarray, w: np.ndarray, count: np.ndarray, r: np.ndarray, level: int) -> bytes:
    """A request: contexts by halves as differences, words as differences within a context, counts.

    In order 2 a word's own count, and in order 3 the tokens of the context's last word, are sent once for each."""
    new = np.zeros(len(w), bool)
    new[np.cumsum(run) - run] = True
    high, low = v >> _32, v & _LOW
    if level == 2:
        seen = count > 0
        r, base = _by_key(w[seen], r[seen]), base[:0]
    elif level == 3:
        base = _by_key(low, base)
    fields = (_differences(high, np.arange(len(high)) == 0), _differences(low, _new(high)), run.astype(np.uint64), _differences(w, new), count, r, base, pieces)
    return pack_all(*(small(np.asarray(x)) for x in fields))


def _read(blob: bytes, level: int):
    """Of runs: context, length, tokens after the shorter context, pieces. Of k-grams: word, count, count after the shorter context."""
    high, low, run, gap, count, r, base, pieces = unpack_all(blob)
    high = np.cumsum(high, dtype=np.uint64)
    low = _sums(low.astype(np.uint64), np.maximum.accumulate(np.where(_new(high), np.arange(len(high)), 0)))
    run = run.astype(np.int64)
    w = _sums(gap.astype(np.uint64), np.repeat(np.cumsum(run) - run, run))
    count = count.astype(np.int64)
    if level == 2:
        every, seen = np.zeros(len(w), np.int64), count > 0
        every[seen] = r[_rank(w[seen])]
        r, base = every, np.zeros(len(low), np.int64)
    elif level == 3:
        base = base[_rank(low)]
    return (high << _32) | low, run, base.astype(np.int64), pieces.astype(np.int64), w, count, r.astype(np.int64)


def _merged(table: pa.Table, level: int, counts: bool = False):
    """All requests of a bucket together: contexts by the order of their hashes with tokens after the shorter one and pieces, and distinct
    k-grams with the rank of their context, count and count after the shorter one. With counts, only these are given where no context is divided.

    Also, of each request: part, the ranks of its contexts, where they begin, and the places of its k-grams."""
    each = [(p, _read(bytes(x), level)) for p, x in zip(table.column("part").to_pylist(), table.column("blob").to_pylist(), strict=True)]
    v, run, base, pieces, w, count, r = (np.concatenate([e[1][i] for e in each]) for i in range(7))
    hashed, order = _sorted(mix(v))
    new = _new(hashed)
    context, one, hashed = _ranks(order, new), order[new], hashed[new]
    bits = np.uint64(int(w.max(initial=0)).bit_length())
    key, order = _sorted(np.repeat(context.astype(np.uint64), run) << bits | w)
    new = _new(key)
    first = np.flatnonzero(new)
    count = np.add.reduceat(count[order], first)
    if counts and not (pieces > 1).any():
        return None, None, None, count, None
    # requests that have not seen a k-gram say 0
    r = np.maximum.reduceat(r[order], first)
    asked, a, i = [], 0, 0
    place = None if counts else _ranks(order, new)
    for p, e in each if not counts else ():
        n, k = len(e[0]), len(e[4])
        asked.append((p, context[i : i + n], np.cumsum(e[1]) - e[1], place[a : a + k]))
        a, i = a + k, i + n
    return asked, (v[one], hashed, base[one], pieces[one]), (key[first] >> bits).view(np.int64), count, r


def _lower(many: np.ndarray, base: np.ndarray, level: int, before: dict, first: dict) -> np.ndarray:
    """The lower probabilities of a context's seen words, added up, from how many there are of each count after the shorter one."""
    d = discounts(before["n"])
    mass = many[:, :K] @ (np.arange(1, K + 1) * d[1:]) + many[:, K]
    return mass * unknown(first)[0] if level == 2 else mass / np.maximum(base, 1)


def _by_context(at: np.ndarray, r: np.ndarray, n: int) -> np.ndarray:
    """Of each of n contexts: how many of its k-grams have counts 1..K, and the sum of those above."""
    above = r > K
    many = np.bincount(at * (K + 1) + np.where(above, 0, r), minlength=n * (K + 1)).reshape(n, K + 1)
    return np.concatenate([many[:, 1:], np.bincount(at, np.where(above, r, 0), n).astype(np.int64)[:, None]], axis=1)


_FOUND = "key long, pieces long, sums array<long>, most long"
_CONTROL = "bucket int, key long, sums array<long>"


def _found(told: list[int], most: int, wide=((), (), ())) -> pa.Table:
    """Rows to be added up over all buckets: the counts of counts (a null key), and divided contexts."""
    key, pieces, sums = wide
    return pa.table({"key": pa.array([None, *key], pa.int64()), "pieces": pa.array([0, *pieces], pa.int64()), "sums": pa.array([told, *sums], pa.list_(pa.int64())), "most": pa.array([most, *([0] * len(key))], pa.int64())})


def _of_counts(seen: np.ndarray) -> list[int]:
    return [*np.bincount(np.minimum(seen, K + 2), minlength=K + 2)[: K + 2].tolist(), int(seen.sum()), len(seen)]


def _count_words(table: pa.Table) -> pa.Table:
    count = _word_counts(table)[1]
    seen = count[count > 0]
    return _found(_of_counts(seen) + [0] * K, len(seen))


def _word_counts(table: pa.Table):
    """What each part asked for (gaps of hashes, counts), and of the distinct words: counts, ranks by count from 1, and places."""
    each = [(p, *unpack_all(bytes(x))) for p, x in zip(table.column("part").to_pylist(), table.column("blob").to_pylist(), strict=True)]
    u, order = _sorted(np.concatenate([np.cumsum(g, dtype=np.uint64) for _, g, _ in each]))
    new = _new(u)
    u, place = u[new], _ranks(order, new)
    count = np.bincount(place, np.concatenate([c for _, _, c in each]), len(u)).astype(np.int64)
    rank = np.empty(len(u), np.int64)
    rank[np.lexsort((u, -count))] = np.arange(1, len(u) + 1)
    return each, count, np.where(count > 0, rank, 0), place


def _told(control: pa.Table) -> list[int]:
    row = control.column("key").to_pylist().index(None)
    return control.column("sums")[row].as_py()


def _answer_words(table: pa.Table, control: pa.Table) -> pa.Table:
    if not table.num_rows:
        return _blobs(None, [], [], [])
    each, count, rank, place = _word_counts(table)
    out, at = [], 0
    for _, g, _ in each:
        own = place[at : at + len(g)]
        out.append(pack_all(small(count[own]), small(rank[own])))
        at += len(g)
    return _blobs(table.column("bucket"), [e[0] for e in each], out, _told(control))


def _blobs(bucket, parts: list, blobs: list, told: list) -> pa.Table:
    n = len(parts)
    return pa.table({"bucket": pa.array([bucket[0].as_py()] * n if n else [], pa.int32()), "part": pa.array(parts, pa.int32()), "blob": pa.array(blobs, pa.binary()), "told": pa.array([told[:_TOLD]] * n, pa.list_(pa.int64()))})


def _count_grams(level: int):
    def count(table: pa.Table) -> pa.Table:
        _, contexts, at, r, lower = _merged(table, level, counts=True)
        if contexts is None:
            return _found(_of_counts(r[r > 0]) + [0] * K, 0)
        u, _, _, pieces = contexts
        wide = pieces > 1
        mine = wide[at]
        at, n = (np.cumsum(wide) - 1)[at[mine]], int(wide.sum())
        many, less = _by_context(at, r[mine], n), _by_context(at, np.where(r > 0, lower, 0)[mine], n)
        return _found(_of_counts(r[r > 0]) + [0] * K, 0, (u[wide].view(np.int64).tolist(), pieces[wide].tolist(), np.concatenate([many, less], axis=1).tolist()))

    return count


def _spread(buckets: int):
    """Sums of divided contexts to each of their buckets; the counts of counts (a null key) to all."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column("key").to_numpy(zero_copy_only=False) if not b.column("key").null_count else b.column("key").fill_null(0).to_numpy(zero_copy_only=False)
            every = b.column("key").is_null().to_numpy(zero_copy_only=False)
            n = np.where(every, buckets, b.column("pieces").to_numpy())
            row = np.repeat(np.arange(len(key)), n)
            step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = np.where(every, np.uint64(0), mix(key.astype(np.int64).view(np.uint64)) >> np.uint64(20))
            home = (start[row] + step.astype(np.uint64)) % np.uint64(buckets)
            yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), b.column("key").take(pa.array(row)), b.column("sums").take(pa.array(row))], ["bucket", "key", "sums"])

    return apply


def _answer_grams(level: int):
    def answer(table: pa.Table, control: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _blobs(None, [], [], [])
        each, (_, hashed, tokens, _), at, r, lower = _merged(table, level)
        told = _told(control)
        known = table.column("told")[0].as_py()  # of the orders before, from what the part was told
        first, before = _known(known[:_TOLD]), _known(known[-_TOLD:])
        d = discounts(_known(told)["n"])
        many, less = _by_context(at, r, len(hashed)), _by_context(at, np.where(r > 0, lower, 0), len(hashed))
        given = control.filter(control.column("key").is_valid())
        if given.num_rows:  # contexts over several buckets have their sums from all of them
            key = mix(given.column("key").to_numpy().view(np.uint64))
            row = np.minimum(np.searchsorted(hashed, key), len(hashed) - 1)
            sums = np.array(given.column("sums").to_pylist(), np.int64)
            mine = hashed[row] == key
            many[row[mine]], less[row[mine]] = sums[mine, : K + 1], sums[mine, K + 1 :]
        weights = np.arange(1, K + 1)
        total = many[:, :K] @ weights + many[:, K]
        used = many[:, :K] @ (weights * d[1:]) + many[:, K]
        short = (total > 0) & (many[:, :K].sum(axis=1) == 0)
        mass = _lower(less, tokens, level, before, first)
        alpha = np.where(total > 0, (1 - used / np.maximum(total + short, 1)) / np.maximum(1 - mass, 1e-300), 1.0)
        out = []
        for _, context, heads, place in each:
            found = r[place]
            needed = np.minimum.reduceat(found, heads) == 0
            out.append(pack_all(small(found), np.where(needed, alpha[context], 0.0), short[context].astype(np.uint8)))
        return _blobs(table.column("bucket"), [e[0] for e in each], out, told)

    return answer


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, parts: int | None = None, share: int | None = None) -> DataFrame:
    """One row per row of docs: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    share: tokens above which a context is divided (a bucket's fair share).
    """
    parts = parts or n_parts(docs, text_col, PART)
    buckets = parts
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.coalesce(train, F.lit(False)).alias("_train"))
    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.compress(x.encode()) if x else b"" for x in b.column(1).to_pylist()], pa.binary()), *b.columns[2:]], b.schema.names)

    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("_id", "_text"), F.lit(parts)).cast("int"))
    texts = dealt.mapInArrow(compressed, f"_id {kind}, _text binary, _train boolean, _part int").repartition(n_tasks(parts), "_part")
    by_part = texts.groupBy("_part")

    def requests_of(table: pa.Table, bucket: np.ndarray, blobs: list[bytes], told: list) -> pa.Table:
        n = len(blobs)
        return pa.table({"bucket": bucket.astype(np.int32), "part": pa.array([table.column("_part")[0].as_py()] * n, pa.int32()), "blob": pa.array(blobs, pa.binary()), "told": pa.array([told] * n, pa.list_(pa.int64()))})

    def ask_words(table: pa.Table) -> pa.Table:
        part = Part(table, buckets)
        bucket, cuts, u, place = part.ask_words()
        count = part.counted(place, len(u))
        return requests_of(table, bucket, [pack_all(np.diff(u[a:b], prepend=np.uint64(0)), small(count[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)], [])

    def ask_grams(level: int):
        def ask(table: pa.Table, answers: pa.Table) -> pa.Table:
            part = _replay(table, answers, buckets, share, level - 1)
            stats = _stats(answers)
            told = [x for lv in (1, level - 1) for s in [stats.get(lv, _NOTHING)] for x in (*s["n"], s["total"], s["types"], s["ranks"])]
            part.ask(share or _share(stats[1], buckets))
            return requests_of(table, part.bucket, part.written(level), told)

        return ask

    requests = by_part.applyInArrow(ask_words, _BLOB).repartition(n_tasks(buckets), "bucket")
    answers, level = None, 1
    width = 2 * (K + 1)
    while True:
        by_bucket = requests.groupBy("bucket")
        found = by_bucket.applyInArrow(_count_words if level == 1 else _count_grams(level), _FOUND)
        # at most as many contexts as buckets are divided, so over at most twice as many buckets
        sums = found.groupBy("key").agg(F.max("pieces").alias("pieces"), F.max("most").alias("most"), F.array(*[F.sum(F.coalesce(F.get("sums", F.lit(i)), F.lit(0))) for i in range(width)]).alias("sums"))
        ranks = F.when(F.col("key").isNull(), F.concat(F.slice("sums", 1, K + 4), F.array("most"))).otherwise(F.col("sums"))
        control = sums.select("key", "pieces", ranks.alias("sums")).mapInArrow(_spread(buckets), _CONTROL).repartition(n_tasks(buckets), "bucket")
        new = by_bucket.cogroup(control.groupBy("bucket")).applyInArrow(_answer_words if level == 1 else _answer_grams(level), _BLOB).withColumn("level", F.lit(level))
        new = new.repartition(n_tasks(parts), "part")  # each level's answers travel once
        answers = new if answers is None else answers.unionByName(new)
        cogroup = by_part.cogroup(answers.groupBy("part"))
        if level == order:
            break
        level += 1
        requests = cogroup.applyInArrow(ask_grams(level), _BLOB).repartition(n_tasks(buckets), "bucket")

    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        part = _replay(table, told, buckets, share, order, order)
        first = _stats(told)[1]
        n, v = int(first["total"]), int(first["types"])
        base = np.log10((part.counts + 1) / (n + v + 1))[part.word]
        total = lambda x: np.add.reduceat(x, part.first)
        return pa.table({
            id_col: table.column("_id"), "held_out": pa.array(~part.train[part.first]), "n_tokens": part.size.astype(np.int64), "n_known": total((part.unigrams > 0).astype(np.int64)),
            "train_tokens": np.full(len(part.first), n, np.int64), "base_score": total(base), "score": total(np.log10(part.low)),
        })

    return cogroup.applyInArrow(finish, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def in_training(id_col: str = "doc_id") -> Column:
    """The training fold: CRC-32 of the id as text, modulo 7, is not 2."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 7 != 2
