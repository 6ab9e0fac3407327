"""Byte-level BPE encoding and decoding.

A text is cut by the tokenizer's pattern; each piece is merged by itself, so a
piece is encoded once per worker while it stays in a bounded memo. New pieces of
a batch are sorted into buckets by length and laid out as padded matrices of
token ids, one piece a row. In each round every row merges its leftmost pair of
the lowest rank: all neighbour pairs are looked up in a hash table at once, the
rows shift left behind their merge, and finished rows leave the matrix. A round
costs a pass over the matrix, so a piece of ``n`` bytes takes ``n ** 2`` steps; the
rare pieces above ``LONG_PIECE`` bytes do the same merges in the same order, leftmost
of the lowest rank first, from a queue of pairs.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .lookup import NONE, Lookup
from .shelf import kept_columns, lean, text_batches

#: Pieces of more bytes than this merge by a queue of pairs instead (the matrix needs length ** 2 steps).
LONG_PIECE = 1024
#: Pieces, and their characters, that a worker remembers at most; the memo is emptied beyond that.
MEMO, MEMO_CHARACTERS = 150_000, 6_000_000
#: Characters of the texts that are encoded at once.
PART = 500_000

class Vocabulary:
    """Ranks of a tokenizer and the hash table of its mergeable pairs."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        top = max(ranks.values()) + 1
        self.lengths = np.zeros(top, np.int64)
        for token, r in ranks.items():
            self.lengths[r] = len(token)
        by_rank = sorted((r, t) for t, r in ranks.items())
        self.bytes = np.frombuffer(b"".join(t for _, t in by_rank), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.pairs = Lookup(np.array([k for k, _ in pairs], np.int64).reshape(-1), np.array([r for _, r in pairs], np.int32).reshape(-1))

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, or ``NONE``."""
        return self.pairs.get(left.astype(np.int64) << 32 | right)

    def merge_matrix(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rows of equal length to the end: (matrix padded by -1, length of each row)."""
        n, width = ids.shape
        done, lengths = np.full((n, width), -1, np.int32), np.full(n, width)
        rows, now = np.arange(n), ids.astype(np.int32)
        left = np.full(n, width)
        while len(rows) and now.shape[1] > 1:
            ranks = self.pair_ranks(np.maximum(now[:, :-1], 0), np.maximum(now[:, 1:], 0))
            ranks[now[:, 1:] < 0] = NONE
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            over = best == NONE
            if over.any():
                done[rows[over], : now.shape[1]] = now[over]
                lengths[rows[over]] = left[over]
                rows, now, at, best, left = rows[~over], now[~over], at[~over], best[~over], left[~over]
                if not len(rows):
                    break
            now[np.arange(len(rows)), at] = best
            # compaction: what stands behind the merge moves one to the left
            cols = np.arange(now.shape[1] - 1)
            now = np.where(cols <= at[:, None], now[:, :-1], now[:, 1:])
            left = left - 1
        if len(rows):
            done[rows, : now.shape[1]] = now
            lengths[rows] = left
        return done, lengths

    def merge_long(self, piece: bytes) -> list[int]:
        """The same merges for one long piece: a heap of (rank, place) and links between the parts."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pair_ranks(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                pair = (ids[i], ids[j])
                if pair not in known:
                    known[pair] = int(self.pair_ranks(np.array(pair[:1]), np.array(pair[1:]))[0])
                if known[pair] != NONE:
                    heapq.heappush(heap, (known[pair], i, *pair))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of each piece."""
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        todo = []
        for i, p in enumerate(pieces):
            r = self.ranks.get(p)
            if r is not None:
                out[i] = np.array([r], np.int32)
            elif len(p) > LONG_PIECE:
                out[i] = np.array(self.merge_long(p), np.int32)
            else:
                todo.append(i)
        todo.sort(key=lambda i: len(pieces[i]))
        begin = 0
        while begin < len(todo):
            width = len(pieces[todo[begin]])
            end = begin
            most = max(1, 400_000 // width)
            while end < len(todo) and len(pieces[todo[end]]) == width and end - begin < most:
                end += 1
            own = todo[begin:end]
            raw = np.frombuffer(b"".join(pieces[i] for i in own), np.uint8).reshape(len(own), width)
            merged, lengths = self.merge_matrix(self.byte_ids[raw])
            for k, i in enumerate(own):
                out[i] = merged[k, : lengths[k]].copy()
            begin = end
        return out

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all rows, one after the other, and the offsets of the rows."""
        lengths = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        place = np.repeat(self.starts[ids] - ends[:-1], lengths) + np.arange(ends[-1])
        return self.bytes[place], ends[np.concatenate([[0], np.cumsum(counts)])]


class Encoder:
    """Encodes texts; remembers a bounded number of pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.find = vocabulary, regex.compile(vocabulary.pattern).findall
        self.memo: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.starts, self.counts = np.zeros(MEMO, np.int64), np.zeros(MEMO, np.int64)
        self.filled = self.characters = 0

    def _learn(self, pieces: list[str]) -> None:
        got = self.v.encode_pieces([p.encode() for p in pieces])
        if len(self.memo) + len(pieces) > len(self.starts):
            grow = max(len(self.starts), len(pieces))
            self.starts, self.counts = np.resize(self.starts, len(self.starts) + grow), np.resize(self.counts, len(self.counts) + grow)
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        need = self.filled + int(lengths.sum())
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(need, np.int32)])
        n = len(self.memo)
        self.ids[self.filled : need] = np.concatenate(got) if got else []
        self.starts[n : n + len(got)] = self.filled + np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.counts[n : n + len(got)] = lengths
        self.filled = need
        self.memo.update(zip(pieces, range(n, n + len(got))))
        self.characters += sum(map(len, pieces))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and their number in each text."""
        if len(self.memo) > MEMO or self.characters > MEMO_CHARACTERS:
            self.memo.clear()
            self.ids = np.zeros(1 << 16, np.int32)
            self.filled = self.characters = 0
        cut = [self.find(t) for t in texts]
        new = {p for pieces in cut for p in pieces} - self.memo.keys()
        if new:
            self._learn(sorted(new))
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        of = self.memo.__getitem__
        which = np.fromiter((of(p) for pieces in cut for p in pieces), np.int64, int(sizes.sum()))
        counts = self.counts[which]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = self.ids[np.repeat(self.starts[which] - ends[:-1], counts) + np.arange(ends[-1])]
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(sizes)])])


_loaded: dict[tuple, tuple[Vocabulary, Encoder]] = {}


def _ready(data: bytes, pattern: str) -> tuple[Vocabulary, Encoder]:
    """The vocabulary and encoder of this worker, made once."""
    key = (hash(data), pattern)
    if key not in _loaded:
        _loaded.clear()
        v = Vocabulary({base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}, pattern)
        _loaded[key] = (v, Encoder(v))
    return _loaded[key]


def _parts(texts: pa.Array, most: int) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` characters; a null text is empty."""
    part: list[str] = []
    size = 0
    for t in texts.to_pylist():
        part.append(t or "")
        size += len(part[-1])
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def _binaries(v: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    raw, offsets = v.decode(ids, counts)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def encode(docs: DataFrame, *, path: str, pattern: str, text: str = "text", ids: str = "token_ids", decoded: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``ids``, the token ids of the whole text, and ``decoded``, the bytes that these ids decode to.

    A null text is encoded as an empty one: no ids. Repeated rows are encoded alike, a very long text in one part with no
    other. An empty table gives an empty one. ``path`` is read by the driver; its bytes (half a MB) travel with the job.
    Columns named like ``ids`` or ``decoded``, in any case, are replaced. ``decoded`` takes no second worker: ids are
    decoded where they are made.
    """
    with open(path, "rb") as f:
        data = f.read()
    text_batches(docs.sparkSession)
    made = [ids] if decoded is None else [ids, decoded]
    kept = kept_columns(docs, made, keep)
    source = docs.select(*dict.fromkeys([*kept, text]))
    types = [T.ArrayType(T.IntegerType(), False), T.BinaryType()]
    schema = T.StructType([*(source.schema[c] for c in kept), *(T.StructField(*x) for x in zip(made, types))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, encoder = _ready(data, pattern)
        for batch in batches:
            at = 0
            texts = batch.column(batch.schema.get_field_index(text))
            for part in _parts(texts, PART):
                flat, counts = encoder.encode(part)
                columns = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat, pa.int32()))]
                if decoded is not None:
                    columns.append(_binaries(v, flat, counts))
                rest = batch.slice(at, len(part))
                at += len(part)
                yield pa.RecordBatch.from_arrays([*(rest.column(rest.schema.get_field_index(c)) for c in kept), *columns], names=[*kept, *made])

    return source.mapInArrow(lean(run), schema)


def decode(docs: DataFrame, *, path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``docs`` with ``out``, the bytes of the tokens in ``ids``; null ids give no bytes."""
    with open(path, "rb") as f:
        data = f.read()
    names = kept_columns(docs, [out])
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _ready(data, pattern)[0]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rest = batch.slice(at, 256)
                lists = rest.column(rest.schema.get_field_index(ids))
                counts = np.array([n or 0 for n in lists.value_lengths().to_pylist()], np.int64)
                column = _binaries(v, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
                yield pa.RecordBatch.from_arrays([*(rest.column(rest.schema.get_field_index(c)) for c in names), column], names=[*names, out])

    return docs.mapInArrow(lean(run), schema)
