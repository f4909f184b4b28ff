"""N-gram Jaccard join in metric space: pivots, Voronoi regions, triangle-inequality windows, recursion.

The points are sets of word shingles; 1 - J is a metric, and two documents link at distance DIST or less.
Points at distance 1 from everything share no shingle with any, so pivots that are documents alone could not
divide them: the first level takes rare shingles as pivots. Two sets that link share one of the first
n - ceil(0.8 n) + 1 of their shingles in any one order (the smaller set one of its first n - ceil(1.6 n / 1.8) + 1), so a point that is copied to the cells of that many
shingles (the boundary that the distance allows) meets each partner in some cell. Shingles that many
documents have come last in the order, which keeps such cells small; the order changes no result.

All cells whose smallest point is the same form a region with that point as pivot. A region is joined exactly:
points within DIST of the pivot link to it; of the others, only pairs whose distances to the pivot differ by no
more than DIST can link, so each outside point joins, with the inside points in that window, smaller regions
made the same way from shingles that are rare inside, with new pivots, until nothing is outside. Only links
that change components are kept; pairs are never listed.

Regions of more than REGION points, or HELD shingles, are dealt in chunks, each with the pivot. Points inside the pivot's ball are
connected through it; the outside points of such a region meet every chunk in blocks, in a second round.
Components come from alternating large and small stars, with each round written to the shared folder.

Points are identified by a 64-bit hash of the shingle set (chance of a clash among n sets: n^2 / 2^65).
Equal sets are one point, so copies cost one row each. Null, empty and blank texts have no shingles and
link with nothing. Null ids may not be a component's name unless all its ids are null. Repeated rows are
copies; rows with one id and different texts are points of their own. Ids may be of any type that has an order.
Other columns are not read. Texts of any length are whole: a task joins about REGION of them, or HELD
shingles, at a time. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import materialize, n_parts
from ._words import bundle, flat, grams, mix, pack, pack_sorted, unbundle, unpack, unpack_sorted, words

N = 5
PERCENT = 80
DIST = 1 - PERCENT / 100
REGION = 2048
#: Shingles of the points that one task joins at a time.
HELD = 1 << 21
#: Rows whose words are held at a time.
SLICE = 1024
HOT = 8
MOST_HOT = 1_000_000
_KIND = "row long, doc_id {}, n long, node long, bucket int, blob binary"


def shingle_sets(col, n: int = N) -> list[np.ndarray]:
    """Distinct shingle hashes of each row of an Arrow string column, sorted."""
    out: list[np.ndarray] = []
    for at in range(0, len(col), SLICE):
        _add_sets(col.slice(at, SLICE), n, out)
    return out


def _add_sets(col, n: int, out: list[np.ndarray]) -> None:
    data, off = flat(col)
    _, _, h, first = words(data, off)
    full = grams(h, n)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(full[a : b - n + 1]))
        else:
            out.append(mix(grams(h[a:b], b - a) + np.uint64(b - a)) if b > a else np.zeros(0, np.uint64))


def node_of(s: np.ndarray) -> int:
    """The point's id: a hash of the set."""
    return int(mix(np.array([np.sum(mix(s + np.uint64(1)), dtype=np.uint64)]))[0].view(np.int64))


def first_ones(n: int) -> int:
    """Shingles of which linked sets share one."""
    return n - (PERCENT * n + 99) // 100 + 1


def inner_ones(n: int) -> int:
    """Shingles of which linked sets share one if n is the smaller of their sizes."""
    return n - (2 * PERCENT * n + 99 + PERCENT) // (100 + PERCENT) + 1


def shared(n, m):
    """Shingles that linked sets of these sizes have in common, at least."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def _hot(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most MOST_HOT shingles that documents share most, with counts: it only sets the order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = {node_of(s): s for s in shingle_sets(b.column(0)) if len(s)}
            if not sets:
                continue
            h, c = np.unique(np.concatenate(list(sets.values())), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h[c > 1].view(np.int64)), pa.array(c[c > 1])], ["h", "c"])

    found = docs.select("_text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= HOT)
    t = found.orderBy(F.col("c").desc(), "h").limit(MOST_HOT).toArrow()
    h, c = t.column("h").to_numpy().astype(np.int64).view(np.uint64), t.column("c").to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def _in_order(s: np.ndarray, hot_h: np.ndarray, hot_c: np.ndarray) -> np.ndarray:
    """s with the shingles that many documents have at the end."""
    if not len(hot_h):
        return s
    at = np.minimum(np.searchsorted(hot_h, s), len(hot_h) - 1)
    c = np.where(hot_h[at] == s, hot_c[at], 0)
    return s[np.argsort(c, kind="stable")] if c.any() else s


def _points(docs: DataFrame, buckets: int) -> DataFrame:
    """A row for each document, and the shingle cells of each batch's distinct points, packed by bucket."""
    hot = docs.sparkSession.sparkContext.broadcast(_hot(docs))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            schema = pa.schema([("row", pa.int64()), ("doc_id", b.column(1).type), ("n", pa.int64()), ("node", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary())])
            sets = shingle_sets(b.column(2))
            nodes = [node_of(s) for s in sets]
            sizes = [len(s) for s in sets]
            nothing = pa.nulls(len(sets), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), nothing, pa.nulls(len(sets), pa.binary())], schema=schema)
            one = {m: s for m, s in zip(nodes, sets, strict=True) if len(s)}
            if not one:
                continue
            cells = [_in_order(s, *hot.value)[: first_ones(len(s))] for s in one.values()]
            count = np.array([len(c) for c in cells])
            size = np.array([len(s) for s in one.values()], np.int64)
            which = np.repeat(np.arange(len(count)), count)
            cell = np.concatenate(cells)
            inner = np.arange(len(cell)) - (np.cumsum(count) - count)[which] < np.array([inner_ones(int(n)) for n in size])[which]
            at = ((cell >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((cell, at))
            which, cell, at, inner = which[order], cell[order], at[order], inner[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]])
            name = np.array(list(one), np.int64)
            blobs = [bundle(pack_sorted(cell[a:z]), *_local(which[a:z], name, size), pack(inner[a:z].astype(np.uint8))) for a, z in zip(cuts, cuts[1:], strict=False)]
            gap = pa.nulls(len(blobs), pa.int64())
            yield pa.RecordBatch.from_arrays([gap, pa.nulls(len(blobs), b.column(1).type), gap, gap, pa.array(at[cuts[:-1]]), pa.array(blobs, pa.binary())], schema=schema)

    return materialize(docs.select("_row", "_id", "_text").mapInArrow(apply, _KIND.format(docs.schema["_id"].dataType.simpleString())), "points")


def _local(which: np.ndarray, name: np.ndarray, size: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """The points that occur, their sizes, and places among them."""
    u, place = np.unique(which, return_inverse=True)
    return pack(name[u]), pack(size[u]), pack(place.astype(np.uint32))


def _cells(table: pa.Table) -> pa.Table:
    """Distinct (pivot, point) of the cells of a bucket where the sizes and the places of the shingle allow a link."""
    parts: list[list[np.ndarray]] = [[], [], [], []]
    for x in table.column("blob").to_pylist():
        c, u, size, place, inner = unbundle(bytes(x), 5)
        place = unpack(place)
        for p, y in zip(parts, (unpack_sorted(c), unpack(u)[place], unpack(size)[place], unpack(inner).astype(bool)), strict=True):
            p.append(y)
    c, v, n, inner = (np.concatenate(p) for p in parts)
    many = np.zeros(len(c), bool)  # cells of one entry go first
    order = np.argsort(c)
    same = np.diff(c[order]) == 0
    many[order[1:][same]] = many[order[:-1][same]] = True
    c, v, n, inner = c[many], v[many], n[many], inner[many]
    order = np.lexsort((v, n, c))
    c, v, n, inner = c[order], v[order], n[order], inner[order]
    if not len(c):
        return pa.table({"pivot": pa.array([], pa.int64()), "node": pa.array([], pa.int64())})
    keep = np.concatenate([[True], (np.diff(c) != 0) | (np.diff(v) != 0)])
    c, v, n, inner = c[keep], v[keep], n[keep], inner[keep]
    # sizes ascend within a cell: a point may link with the next, if the cell is inner for it, and with the last inner one before
    i = np.arange(len(c))
    nxt = np.minimum(i + 1, len(c) - 1)
    up = inner & (i < nxt) & (c[nxt] == c) & (100 * n >= PERCENT * n[nxt])
    before = np.maximum.accumulate(np.where(inner, i, -1))
    before = np.concatenate([[-1], before[:-1]])
    down = (before >= 0) & (c[before] == c) & (100 * n[before] >= PERCENT * n)
    c, v = c[up | down], v[up | down]
    if not len(c):
        return pa.table({"pivot": pa.array([], pa.int64()), "node": pa.array([], pa.int64())})
    order = np.lexsort((v, c))
    c, v = c[order], v[order]
    start = np.concatenate([[True], np.diff(c) != 0])
    pivot = v[np.flatnonzero(start)][np.cumsum(start) - 1]
    pairs = np.unique(np.stack([pivot, v], axis=1), axis=0)
    return pa.table({"pivot": pairs[:, 0], "node": pairs[:, 1]})


class Region:
    """The exact join of some sets; links are kept as a forest."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.size = np.array([len(s) for s in sets], np.int64)
        self.up = list(range(len(sets)))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = sorted((self.root(i), self.root(j)))
        self.up[b] = a

    def star(self, p: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each of others links to p, and its distance from p."""
        own = self.sets[p]
        every = np.concatenate([self.sets[i] for i in others])
        at = np.minimum(np.searchsorted(own, every), len(own) - 1)
        inter = np.add.reduceat((own[at] == every).astype(np.int64), np.concatenate([[0], np.cumsum(self.size[others])[:-1]]))
        union = self.size[others] + len(own) - inter
        return 100 * inter >= PERCENT * union, 1 - inter / union

    def join(self, members: np.ndarray, p: int | None = None) -> np.ndarray:
        """Connect the members that links connect; returns those outside the ball of p, if it is given."""
        work = [(members, members[0] if p is None else p)] if len(members) > 1 else []
        outside, d, first = np.zeros(0, np.int64), np.zeros(len(self.sets)), True
        while work:
            group, pivot = work.pop()
            rest = group[group != pivot]
            near, d[rest] = self.star(pivot, rest)
            for i in rest[near]:
                self.link(pivot, int(i))
            out = rest[~near]
            if first and p is not None:
                outside = out
            if len(out):
                low = d[out].min() - DIST - 1e-9  # inside points nearer to the pivot link with none outside
                for part, hub in self.divide(np.concatenate([out, rest[near & (d[rest] >= low)]])):
                    if first or 2 * len(part) <= len(group):
                        work.append((part, hub))
                    else:
                        self.sweep(part, d[part])
            first = False
        return outside

    def ordered(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shingles of a group as numbers, rare ones low, ascending within each point; their first places, and counts."""
        first = np.concatenate([[0], np.cumsum(self.size[group])])
        _, at, count = np.unique(np.concatenate([self.sets[i] for i in group]), return_inverse=True, return_counts=True)
        order = np.argsort(count, kind="stable")
        rank = np.empty(len(count), np.int64)
        rank[order] = np.arange(len(count))
        owner = np.repeat(np.arange(len(group)), self.size[group])
        return np.sort(owner * len(count) + rank[at]) % len(count), first, count[order]

    def prefixes(self, group: np.ndarray, every: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shingles of which linked points share one and that two points have: number, point, place in the point."""
        size = self.size[group]
        place = np.arange(len(every)) - np.repeat(first[:-1], size)
        take = (place < np.repeat([first_ones(int(n)) for n in size], size)) & (count[every] > 1)
        return every[take], np.repeat(np.arange(len(group)), size)[take], place[take]

    def divide(self, group: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """Smaller regions with points to connect, by cells of shingles that are rare in this group, and a new pivot of each."""
        if len(group) < 2:
            return []
        every, first, count = self.ordered(group)
        key, who, place = self.prefixes(group, every, first, count)
        o = np.lexsort((self.size[group][who], key))
        key, who, place = key[o], who[o], place[o]
        n = self.size[group][who]
        # sizes ascend within a cell; the first common shingle leaves room for all that the smaller and the larger point must share
        start = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        least = np.maximum(n[np.flatnonzero(start)][np.cumsum(start) - 1], -(-PERCENT * n // 100))
        fits = n - place >= shared(least, n)
        key, who = key[fits], who[fits]
        same = np.flatnonzero(key[1:] == key[:-1])
        up = list(range(len(group)))

        def root(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for pair in np.unique(who[same] * len(group) + who[same + 1]).tolist():
            x, y = sorted((root(pair // len(group)), root(pair % len(group))))
            up[y] = x
        common = np.add.reduceat(count[every], first[:-1]) / self.size[group]  # a point that shares much with the others is a good pivot
        found: dict[int, list[int]] = {}
        for i in range(len(group)):
            found.setdefault(root(i), []).append(i)
        parts = [np.array(g) for g in found.values() if len(g) > 1 and len({self.root(int(group[i])) for i in g}) > 1]
        return [(group[g], int(group[g[np.argmax(common[g])]])) for g in parts]

    def sweep(self, group: np.ndarray, d: np.ndarray) -> None:
        """Connect the points of a group that hardly divides; d: distances from one pivot.

        Points of one component need no test, so only those outside the largest are compared with the others: with
        those in the window of d, of fitting size and place of a common shingle.
        """
        every, first, count = self.ordered(group)
        key, who, place = self.prefixes(group, every, first, count)
        size = self.size[group]
        part = np.unique([self.root(int(i)) for i in group], return_inverse=True)[1]
        main = int(np.argmax(part == np.argmax(np.bincount(part))))
        at, own = np.full(len(count), -1), np.zeros(len(count), bool)
        cuts = np.searchsorted(who, np.arange(len(group) + 1))
        for x in range(len(group)):
            if part[x] == part[main]:
                continue
            mine = slice(cuts[x], cuts[x + 1])
            at[key[mine]] = place[mine]
            hit = np.flatnonzero(at[key] >= 0)
            y = who[hit]
            need = shared(size[x], size[y])
            y = y[(size[x] - at[key[hit]] >= need) & (size[y] - place[hit] >= need)]
            at[key[mine]] = -1
            y = np.unique(y[(part[y] != part[x]) & (np.abs(d[y] - d[x]) <= DIST + 1e-9)])
            if not len(y):
                continue
            own[every[first[x] : first[x + 1]]] = True
            if 4 * len(y) > len(group):
                inter = np.add.reduceat(own[every], first[:-1], dtype=np.int64)[y]
            else:
                inter = np.array([np.count_nonzero(own[every[first[i] : first[i + 1]]]) for i in y.tolist()])
            own[every[first[x] : first[x + 1]]] = False
            near = y[100 * inter >= PERCENT * (size[x] + size[y] - inter)]
            for i in near:
                self.link(int(group[x]), int(group[i]))
            if len(near):
                part[np.isin(part, part[near])] = part[x]


def _join(table: pa.Table) -> pa.Table:
    """Links (a, b) that connect the points of each task, and its points outside the pivot's ball (a = b)."""
    uniq, back = np.unique(table.column("node").to_numpy(), return_inverse=True)
    firsts = np.full(len(uniq), -1)
    texts = table.column("_text").combine_chunks()
    sets: list = [None] * len(uniq)
    step = 4096
    order = np.arange(len(back))
    _, one = np.unique(np.stack([back, table.column("_row").to_numpy()], axis=1), axis=0, return_index=True)
    for lo in range(0, len(one), step):
        for i, s in zip(one[lo : lo + step], shingle_sets(texts.take(pa.array(one[lo : lo + step]))), strict=True):
            if len(s) and node_of(s) == uniq[back[i]]:  # else another row with the same id
                sets[back[i]], firsts[back[i]] = s, i
    task, pivot = table.column("task").to_numpy(), table.column("pivot").to_numpy()
    out: list[tuple[int, int, int, int]] = []
    order = np.argsort(task, kind="stable")
    for run in np.split(order, np.flatnonzero(np.diff(task[order])) + 1):
        members = np.unique(back[run])
        members = members[firsts[members] >= 0]
        if len(members) < 2:
            continue
        region = Region([sets[m] for m in members])
        p = np.searchsorted(uniq[members], pivot[run[0]])
        given = int(p) if p < len(members) and uniq[members[p]] == pivot[run[0]] else None
        outside = region.join(np.arange(len(members)), given)
        for i in range(len(members)):
            if (r := region.root(i)) != i:
                out.append((int(task[run[0]]), int(pivot[run[0]]), int(uniq[members[r]]), int(uniq[members[i]])))
        out += [(int(task[run[0]]), int(pivot[run[0]]), int(uniq[members[i]]), int(uniq[members[i]])) for i in outside]
    cols = list(zip(*out, strict=True)) or [[], [], [], []]
    return pa.table({k: pa.array(c, pa.int64()) for k, c in zip(("task", "pivot", "a", "b"), cols, strict=True)})


def _verify(tasks: DataFrame, docs: DataFrame, buckets: int, label: str) -> DataFrame:
    """tasks (task, pivot, node, row) joined with their texts and worked off."""
    found = tasks.join(docs.select("_row", "_text"), tasks["row"] == docs["_row"]).select(F.pmod(F.xxhash64("task"), F.lit(4 * buckets)).alias("_bucket"), "task", "pivot", "node", "_row", "_text")
    return materialize(found.groupBy("_bucket").applyInArrow(_join, "task long, pivot long, a long, b long"), label)


def links(docs: DataFrame, points: DataFrame, buckets: int, region: int = REGION) -> DataFrame:
    """Pairs of points (a < b) whose components are those of all links."""
    pairs = points.where("blob IS NOT NULL").select("bucket", "blob").groupBy("bucket").applyInArrow(_cells, "pivot long, node long").groupBy("pivot", "node").agg(F.lit(1).alias("_one"))
    pairs = materialize(pairs.select("pivot", "node"), "regions")
    rows = points.where("blob IS NULL AND n > 0").groupBy("node").agg(F.min("row").alias("row"), F.first("n").alias("n"))
    known = pairs.join(rows, "node")
    sizes = known.groupBy("pivot").agg(F.ceil(F.greatest(F.count("*") / region, F.sum("n") / HELD)).cast("long").alias("chunks"))
    given = known.drop("n").join(sizes, "pivot")
    all_chunks = F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)
    own = F.array(F.pmod(F.xxhash64("node"), F.col("chunks")))
    dealt = given.withColumn("chunk", F.explode(F.when(F.col("node") == F.col("pivot"), all_chunks).otherwise(own)))
    task = F.xxhash64("pivot", "chunk")
    got = _verify(dealt.select(task.alias("task"), "pivot", "node", "row"), docs, buckets, "joined")
    edges = got.where("a <> b").select("a", "b")
    # what is outside the ball in a region of several chunks meets all its chunks
    wide = sizes.where("chunks > 1")
    out = got.where("a = b").select("pivot", F.col("a").alias("node")).distinct().join(wide, "pivot")
    out = materialize(out, "outside")
    if not out.isEmpty():
        blocks = out.groupBy("pivot").agg(F.ceil(F.count("*") / region).cast("long").alias("blocks"))
        each_block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        inner = dealt.join(blocks, "pivot").withColumn("block", each_block)
        outer = out.join(blocks, "pivot").join(rows, "node").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks"))).withColumn("chunk", F.explode(all_chunks))
        both = inner.select("pivot", "chunk", "block", "node", "row").unionByName(outer.select("pivot", "chunk", "block", "node", "row"))
        again = _verify(both.select(F.xxhash64("pivot", "chunk", "block").alias("task"), "pivot", "node", "row"), docs, buckets, "again")
        edges = edges.unionByName(again.where("a <> b").select("a", "b"))
    return materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a < b) that is not its component's smallest."""
    now = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))  # u < v
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v")
        now = small.select(F.col("m").alias("u"), F.col("u").alias("v")).unionByName(small.select(F.col("m").alias("u"), "v")).where("u < v").distinct()
        now = materialize(now, "stars")
        # stars alone are left when no node hangs under two others, or under one while others hang under it
        ends = now.select(F.col("v").alias("x"), F.lit(1).alias("above"), F.lit(0).alias("below")).unionByName(now.select(F.col("u").alias("x"), F.lit(0).alias("above"), F.lit(1).alias("below")))
        ends = ends.groupBy("x").agg(F.sum("above").alias("above"), F.max("below").alias("below"))
        if ends.where("above > 1 OR above = 1 AND below = 1").isEmpty():
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", region: int = REGION) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id."""
    buckets = n_parts(docs, text_col)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    texts = texts.select(F.xxhash64("_id", "_text").alias("_row"), "_id", "_text")
    points = _points(texts, buckets)
    roots = components(links(texts, points, buckets, region))
    rows = points.where("blob IS NULL").select("doc_id", "n", "node")
    nodes = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    nodes = materialize(nodes, "nodes")
    named = nodes.join(nodes.groupBy("root").agg(F.min("least").alias("component")), "root").select("node", "component")
    out = rows.join(named, (rows["node"] == named["node"]) & (rows["n"] > 0), "left")
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id names their component: one document of each group, with all columns."""
    kept = join(docs, id_col, text_col).where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"))
    return rows.join(kept, rows["id"].eqNullSafe(kept["id"]), "left_semi").select("row.*")
