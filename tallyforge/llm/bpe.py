"""Byte-level BPE over a given rank file: each piece's merges run on a segment tree of pair ranks.

The leaves of a piece's tree stand for its byte positions. A leaf holds ``rank * size + position`` of the pair
that starts there, so the root is the leftmost pair of minimum rank. A merge lengthens one live symbol, drops
its right neighbour, and updates three leaves and the nodes above them: the symbol's own pair, the dropped
one's and that of the live symbol to the left. Short pieces of a block are encoded together, one tree a row
of a numpy array; long pieces one by one.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import with_arrow

#: Pieces of up to so many bytes are encoded together.
SHORT = 32
#: Pieces that a task remembers; at this many it starts afresh.
REMEMBERED = 200_000
#: Short pieces in one array of trees.
TOGETHER = 4096
NONE = np.iinfo(np.int64).max // 2


class Ranks:
    """The vocabulary of a rank file (lines of base64 token and rank) and its mergeable pairs."""

    def __init__(self, content: bytes):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.byte_pairs = self.pair_ranks(*(x.ravel() for x in np.meshgrid(self.byte_ids, self.byte_ids, indexing="ij")))
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.merged[at], -1)


@lru_cache(2)
def ranks_of(content: bytes) -> Ranks:
    return Ranks(content)


@lru_cache(2)
def encoder_of(content: bytes, pattern: str) -> Encoder:
    """One encoder a worker process: later tasks find the pieces that it remembers."""
    return Encoder(ranks_of(content), pattern)


def encode_long(piece: bytes, ranks: Ranks) -> list[int]:
    """The tokens of one piece, with a tree of plain integers."""
    n = len(piece)
    size = 1 << max(1, (n - 1).bit_length())
    symbols, pairs = ranks.byte_ids[np.frombuffer(piece, np.uint8)].tolist(), ranks.pairs
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [NONE] * (2 * size)

    def leaf(i: int) -> int:
        j = after[i]
        rank = pairs.get(symbols[i] << 20 | symbols[j], -1) if j < n else -1
        return rank * size + i if rank >= 0 else NONE

    for i in range(n):
        tree[size + i] = leaf(i)
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    dead = bytearray(n)
    while tree[1] < NONE:
        rank, i = divmod(tree[1], size)
        j = after[i]
        symbols[i], after[i], dead[j] = rank, after[j], 1
        if after[j] < n:
            before[after[j]] = i
        changed = [(j, NONE), (i, leaf(i))] + ([(before[i], leaf(before[i]))] if before[i] >= 0 else [])
        for k, value in changed:
            k += size
            tree[k] = value
            while k > 1:
                k >>= 1
                tree[k] = min(tree[2 * k], tree[2 * k + 1])
    return [s for s, gone in zip(symbols, dead) if not gone]


def encode_short(pieces: list[bytes], ranks: Ranks, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of pieces of 2 to ``size`` bytes, one after another, and each piece's number of them; ``size`` is a power of two."""
    rows, shift = len(pieces), size.bit_length() - 1
    lengths = np.array([len(p) for p in pieces], np.int64)
    padded = np.frombuffer(b"".join([p.ljust(size, b"\0") for p in pieces]), np.uint8).reshape(rows, size)
    place = np.arange(size)
    live = place < lengths[:, None]
    tree = np.full((rows, 2 * size), NONE, np.int64)
    found = ranks.byte_pairs[padded[:, :-1].astype(np.int64) << 8 | padded[:, 1:]]
    tree[:, size:-1] = np.where(live[:, 1:] & (found >= 0), found << shift | place[:-1], NONE)
    for i in range(size - 1, 0, -1):
        np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])
    # flat from here; place `size` of a row holds what falls off its end, place -1 - that is the row before's - is never written
    wide = size + 1
    symbols = np.zeros((rows, wide), np.int64)
    symbols[:, :size] = ranks.byte_ids[padded]
    after = np.tile(np.arange(1, wide + 1), (rows, 1)).ravel()
    before = np.tile(np.arange(-1, size), (rows, 1)).ravel()
    symbols, tree, alive = symbols.ravel(), tree.ravel(), live.ravel()

    row = np.flatnonzero(tree[1 :: 2 * size] < NONE)
    root = tree[row * (2 * size) + 1]
    while len(row):
        at, leaves, end = row * wide, row * (2 * size), lengths[row]
        i, rank = root & (size - 1), root >> shift
        j = after[at + i]
        k = np.minimum(after[at + j], size)
        symbols[at + i], after[at + i], alive[row * size + j] = rank, k, False
        before[at + k] = i
        h = before[at + i]
        right = ranks.pair_ranks(rank, symbols[at + k])
        left = ranks.pair_ranks(symbols[at + np.maximum(h, 0)], rank)
        left = np.where((left >= 0) & (h >= 0), left << shift | h, NONE)
        h = np.where(h >= 0, h, i)
        tree[leaves + size + j] = NONE
        tree[leaves + size + h] = left
        tree[leaves + size + i] = np.where((right >= 0) & (k < end), right << shift | i, NONE)  # last: without a left neighbour h is i
        nodes = [size + i, size + j, size + h]
        for _ in range(shift):
            nodes = [x >> 1 for x in nodes]
            for x in nodes:
                child = leaves + 2 * x
                tree[leaves + x] = np.minimum(tree[child], tree[child + 1])
        root = tree[leaves + 1]
        more = root < NONE
        row, root = row[more], root[more]
    return symbols.reshape(rows, wide)[:, :size][alive.reshape(rows, size)], alive.reshape(rows, size).sum(1)


class Encoder:
    """Encodes texts by the pattern and the ranks; remembers a bounded number of pieces."""

    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).finditer
        self.all = regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)

    def learn(self, pieces: set[str]) -> None:
        """Encodes the pieces that aren't known yet."""
        new = [p for p in pieces if p not in self.slot]
        if len(self.slot) + len(new) > REMEMBERED:
            self.forget()
            new = list(pieces)
        if not new:
            return
        raw = [p.encode() for p in new]
        done: list[tuple[list[int], np.ndarray, np.ndarray]] = []
        whole, by_size, known = [], {}, self.ranks.ranks
        for k, b in enumerate(raw):
            if b in known:
                whole.append(k)
            elif len(b) <= SHORT:
                by_size.setdefault(1 << (len(b) - 1).bit_length(), []).append(k)
            else:
                ids = np.array(encode_long(b, self.ranks), np.int64)
                done.append(([k], ids, np.array([len(ids)])))
        if whole:
            done.append((whole, np.array([known[raw[k]] for k in whole], np.int64), np.ones(len(whole), np.int64)))
        for size, ks in by_size.items():
            for start in range(0, len(ks), TOGETHER):
                some = ks[start : start + TOGETHER]
                done.append((some, *encode_short([raw[k] for k in some], self.ranks, size)))
        base = len(self.slot)
        self.slot.update((new[k], base + i) for i, k in enumerate(k for ks, _, _ in done for k in ks))
        counts = np.concatenate([c for _, _, c in done])
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, *[ids.astype(np.int32) for _, ids, _ in done]])

    def pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of the pieces in a row, and each piece's number of them."""
        self.learn(set(pieces))
        slots = np.fromiter(map(self.slot.__getitem__, pieces), np.int64, len(pieces))
        counts = self.counts[slots]
        ends = np.cumsum(counts)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[slots] - ends + counts, counts)
        return self.ids[places], counts

    def texts(self, texts: list[str], step: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of the texts in a row, and the offsets at which each text's begin."""
        found: list[str] = []
        sizes, out, total, lengths = [], [], 0, []

        def flush() -> None:
            nonlocal found
            ids, counts = self.pieces(found)
            out.append(ids)
            lengths.append(counts)
            found = []

        for text in texts:
            n = 0
            if len(text) <= 8 * step:
                some = self.all(text)
                n = len(some)
                found += some
                if len(found) >= step:
                    flush()
            else:
                for m in self.find(text):
                    found.append(m[0])
                    n += 1
                    if len(found) >= step:
                        flush()
            sizes.append(n)
        flush()
        tokens = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
        return np.concatenate(out), tokens[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]


def bpe_encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with ``out``: each whole text's token ids as array<int>; null and empty texts have none.

    ``ranks_path`` is read on the driver and broadcast: its size is that of a vocabulary, not of the data. There are
    no special tokens: their strings in a text are ordinary text.
    """
    content = _shared(df, ranks_path)

    def make():
        encoder = encoder_of(content.value, pattern)

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            ids, offsets = encoder.texts([x or "" for x in batch.column(text).to_pylist()])
            return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))]

        return step

    return with_arrow(df, text, [T.StructField(out, T.ArrayType(T.IntegerType()))], make)


def bpe_decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``: the bytes of each row's token ids; a null array gives no bytes."""
    content = _shared(df, ranks_path)

    def make():
        ranks = ranks_of(content.value)

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            lists = batch.column(ids)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            counts = np.array(pa.compute.fill_null(pa.compute.list_value_length(lists), 0), np.int64)
            return [decode(ranks, flat, np.concatenate([[0], np.cumsum(counts)]))]

        return step

    return with_arrow(df, ids, [T.StructField(out, T.BinaryType())], make)


def bpe_round_trip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the ``ids`` of ``bpe_encode`` and the bytes that ``bpe_decode`` gives for them, in one pass: one Python worker a task."""
    content = _shared(df, ranks_path)

    def make():
        encoder = encoder_of(content.value, pattern)

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            found, offsets = encoder.texts([x or "" for x in batch.column(text).to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found, pa.int32()))
            return [lists, decode(encoder.ranks, found.astype(np.int64), offsets)]

        return step

    return with_arrow(df, text, [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(out, T.BinaryType())], make)


def decode(ranks: Ranks, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The bytes of each run of token ids between two offsets."""
    sizes = ranks.sizes[ids]
    ends = np.cumsum(sizes)
    places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(ranks.starts[ids] - ends + sizes, sizes)
    bounds = np.concatenate([[0], ends])[offsets].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(ranks.bytes[places])])


def _shared(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def digests(df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with n_tokens, ids_sha256 (of the decimal ids joined by a space) and decoded_sha256, in place of the arrays."""
    joined = F.array_join(F.col(ids).cast("array<string>"), " ")
    return df.withColumns({"n_tokens": F.size(ids).cast("long"), "ids_sha256": F.sha2(joined, 256), "decoded_sha256": F.sha2(F.col(decoded), 256)}).drop(ids, decoded)
