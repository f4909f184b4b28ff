"""BPE encoding and decoding by tree concatenation.

Texts of up to LEAF characters are encoded at once. Longer ones are cut into leaves of LEAF characters, which
are rows of their own, so that one text's leaves are encoded in parallel; then neighbours join pairwise, as a
binary tree. At a join the text in a window around it is encoded again, and the window grows until it shares a
token (same id, same characters, no neighbour in the same character) with the left side and another with the
right side, clear of the window's ends and of the join. The result takes the left side up to the first, the
window between them and the right side from the second. That is exact: BPE's result for a text is the only
sequence whose adjacent tokens are all compatible, each adjacent pair of the result is one of a valid encoding,
and the tokenizer's splits and special tokens depend on nothing before them but where the last one ended. A
window that grows over both sides is simply their encoding.

In texts whose normalised form has only printable characters below U+0250, words are looked up in a bounded
memo of the tokenizer's own results; all others go through the tokenizer as a whole. The tokenizer has no
decoder, so decoding joins its tokens' strings with spaces.

Null counts as empty: no tokens, and the hashes of nothing. Repeated rows are encoded again. Other columns are
not read by `digest`. An empty table gives an empty result. A text's tokens must fit a task's memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 32_768
WINDOW = 64
MEMO = 100_000
#: The tokenizer's split pattern (fixed value).
SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+""")
PLAIN = regex.compile("[\x20-\x7e\xa1-ɏ]*")
_of = lambda kind: re.escape("".join(regex.findall(rf"\p{{{kind}}}", "".join(map(chr, range(0x250))))))
#: SPLIT for what PLAIN matches, with its letters and digits listed.
PLAIN_SPLIT = re.compile(SPLIT.pattern.replace(r"\p{L}", _of("L")).replace(r"\p{N}", _of("N")))
#: What the normaliser's rule for blanks changes in ASCII.
BLANKS = re.compile("[\t-\r ]{2,}|[\t-\r]")
SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"
_open: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """The coder of a tokenizer file, opened once a process."""
    if path not in _open:
        _open[path] = Coder(path)
    return _open[path]


class Coder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.names = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size())]
        self.last = np.array([x.endswith("</w>") for x in self.names])
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.memo: dict[str, tuple[bytes, str]] = {}

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4")

    def decode(self, ids) -> str:
        return " ".join([self.names[i] for i in ids])

    def normal(self, text: str) -> str:
        """The normaliser's result; ASCII, which has one form, needs its rules for blanks and capitals only."""
        return BLANKS.sub(" ", text).lower() if text.isascii() else self.tok.normalizer.normalize_str(text)

    def whole(self, text: str) -> tuple[bytes, str]:
        """Ids as bytes and the decoded string of a text that is encoded at once."""
        norm = None if any(s in text for s in self.special) else self.normal(text)
        if norm is None or not PLAIN.fullmatch(norm):
            ids = self.encode(text)
            return ids.tobytes(), self.decode(ids.tolist())
        memo, found = self.memo, PLAIN_SPLIT.findall(norm)
        if new := [w for w in dict.fromkeys(found) if w not in memo]:
            if len(memo) > MEMO:
                memo.clear()
                new = list(dict.fromkeys(found))
            # every word ends with a token of its own kind, so many are encoded as one text and divided again
            ids = self.encode(" ".join(new))
            raw, names, start = ids.tobytes(), [self.names[i] for i in ids.tolist()], 0
            for w, end in zip(new, (np.flatnonzero(self.last[ids]) + 1).tolist(), strict=True):
                memo[w] = raw[4 * start : 4 * end], " ".join(names[start:end])
                start = end
        got = [memo[w] for w in found]
        return b"".join([x for x, _ in got]), " ".join([x for _, x in got])

    def spans(self, text: str, at: int = 0) -> np.ndarray:
        """Tokens of text as rows (id, first character, end), characters counted from `at`."""
        e = self.tok.encode(text, add_special_tokens=False)
        out = np.empty((len(e.ids), 3), np.int64)
        out[:, 0] = e.ids
        if len(e.ids):
            out[:, 1:] = e.offsets
            out[:, 1:] += at
        return out

    def tree(self, text: str, leaves: list[tuple[int, np.ndarray]], window: int = WINDOW) -> np.ndarray:
        """Join leaves (first character, tokens) of text pairwise until one is left."""
        nodes = [(lo, hi, t) for (lo, t), hi in zip(leaves, [*(lo for lo, _ in leaves[1:]), len(text)], strict=True)]
        while len(nodes) > 1:
            pairs = [self.join(text, *nodes[i : i + 2], window) for i in range(0, len(nodes) - 1, 2)]
            nodes = pairs + nodes[len(pairs) * 2 :]
        return nodes[0][2]

    def join(self, text: str, left, right, window: int):
        (lo, mid, a), (_, hi, b) = left, right
        while True:
            start, stop = max(lo, mid - window), min(hi, mid + window)
            if start > lo and len(a):
                i = int(np.searchsorted(a[:, 1], start, "right")) - 1  # begin with a token
                start = int(a[i, 1]) if i > 0 else lo
            got = self.spans(text[start:stop], start)
            head = (0, 0) if start == lo else self.shared(a, got, start, mid)
            tail = (len(b), len(got)) if stop == hi else self.shared(b, got, mid, stop)
            if head and tail and head[1] <= tail[1]:
                return lo, hi, np.concatenate([a[: head[0]], got[head[1] : tail[1]], b[tail[0] :]])
            window *= 4

    @staticmethod
    def shared(side: np.ndarray, got: np.ndarray, lo: int, hi: int) -> tuple[int, int] | None:
        """Places in side and got of a token that both have, nearest to the middle of lo and hi."""
        margin = 20  # longer than a special token or a contraction
        clear = []
        for t in (side, got):
            i = np.flatnonzero((t[:, 1] >= lo + margin) & (t[:, 2] <= hi - margin))
            i = i[(i > 0) & (i < len(t) - 1)]
            i = i[(t[i - 1, 2] <= t[i, 1]) & (t[i, 2] <= t[i + 1, 1]) & (t[i, 1] < t[i, 2])]
            clear.append(i)
        key = lambda t, i: t[i, 0] << np.int64(40) ^ t[i, 1] << np.int64(8) ^ np.minimum(t[i, 2] - t[i, 1], 255)
        _, x, y = np.intersect1d(key(side, clear[0]), key(got, clear[1]), assume_unique=True, return_indices=True)
        if not len(x):
            return None
        k = int(np.argmin(np.abs(got[clear[1][y], 1] - (lo + hi) // 2)))
        return int(clear[0][x[k]]), int(clear[1][y[k]])

    def long(self, text: str, leaf: int, window: int = WINDOW) -> np.ndarray:
        """Ids of a text by tree concatenation within this process."""
        cuts = range(0, max(1, len(text)), leaf)
        return self.tree(text, [(c, self.spans(text[c : c + leaf], c)) for c in cuts], window)[:, 0].astype("<u4")


def _hashes(n: int, ids: bytes, decoded: str) -> tuple[int, str, str]:
    return n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """One row per row of docs: id_col, n_tokens, ids_sha256, decoded_sha256."""
    texts = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                ids, decoded = c.whole(t)
                rows.append(_hashes(len(ids) // 4, ids, decoded))
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for b in batches:
            got = [c.spans(t, at).tobytes() for t, at in zip(b.column("_leaf").to_pylist(), b.column("_at").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.binary())], [*b.schema.names, "_tokens"])

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        c = coder(path)
        rows = list(zip(*(table.column(x).to_pylist() for x in ("_at", "_leaf", "_tokens")), strict=True))
        copies = sum(at == 0 for at, _, _ in rows)  # a repeated row's leaves are here as often
        rows = sorted({at: (at, leaf, x) for at, leaf, x in rows}.values())
        tokens = c.tree("".join(t for _, t, _ in rows), [(at, np.frombuffer(x, np.int64).reshape(-1, 3)) for at, _, x in rows])
        ids = tokens[:, 0].astype("<u4")
        n, a, d = _hashes(len(ids), ids.tobytes(), c.decode(ids.tolist()))
        return pa.table({id_col: table.column(id_col)[:1].take(pa.array([0] * copies)), "n_tokens": [n] * copies, "ids_sha256": [a] * copies, "decoded_sha256": [d] * copies})

    at_once = texts.where(F.length("_text") <= leaf).mapInArrow(short, f"`{id_col}` {kind}, {SCHEMA}")
    large = texts.where(F.length("_text") > leaf).withColumn("_row", F.xxhash64("_text"))
    cut = large.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.length("_text").cast("long") - 1, F.lit(leaf).cast("long"))))
    cut = cut.select(id_col, "_row", "_at", F.substring("_text", F.col("_at").cast("int") + 1, F.lit(leaf)).alias("_leaf"))
    leaves = cut.mapInArrow(encode, f"`{id_col}` {kind}, _row long, _at long, _leaf string, _tokens binary")
    joined = leaves.groupBy(id_col, "_row").applyInArrow(merge, f"`{id_col}` {kind}, {SCHEMA}")
    return at_once.unionByName(joined)
