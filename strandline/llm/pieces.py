"""SentencePiece encoding and decoding of merge-type (BPE) models.

The tokens of a text's prefix never depend on what follows their end, so each
prefix has one last token. A table of these is filled from left to right: an
automaton gives all pieces that end at a place, and of these the one is right that
the last token before it is compatible with, that is, merging the two side by side
never joins across the border. The ids are recovered backwards from the end. A
text costs its length times the few pieces that end at a place, however long it is.

Texts are cut first where no piece of the vocabulary reaches across: before blanks,
and around characters that no piece holds, which become bytes. A cut piece of text
is encoded once per worker while it stays in a memo bounded by characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .lookup import NONE, Lookup
from .shelf import kept_columns, lean, text_batches

BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Characters of texts that are encoded at once, of cut texts and of compatible pairs that a worker remembers.
PART, MEMO, PAIRS = 1_000_000, 5_000_000, 250_000
#: Longer cut texts fill their tables one by one; of shorter ones, those of equal length and so many characters together.
LONG, TABLE = 48, 400_000
#: Characters, ASCII first, for which the trie has a table of steps.
WIDE = 192


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + size]
            at += size


class Model:
    """Pieces of a model file: texts, scores and kinds by id, and the few settings that encoding needs."""

    def __init__(self, data: bytes):
        self.texts: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trained, normal = {}, {}
        for no, value in _fields(data):
            if no == 1:
                piece = dict(_fields(value))
                self.texts.append(piece[1].decode())
                self.scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.kinds.append(piece.get(3, NORMAL))
            elif no == 2:
                trained = dict(_fields(value))
            elif no == 3:
                normal = dict(_fields(value))
        # Fixed numbers of the model format: trainer 3 type (2: BPE), 24 treat blanks as suffix, 35 byte fallback;
        # normaliser 2 character map, 3 leading blank, 4 remove further blanks, 5 escape blanks.
        plain = trained.get(3) == 2 and trained.get(35) == 1 and not trained.get(24, 0) and not normal.get(2) and not normal.get(4, 1) and normal.get(5, 1)
        if not plain or set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models with byte fallback and without normalisation or special pieces can be read")
        self.leading = bool(normal.get(3, 1))


class Encoder:
    """Encodes texts by a model and decodes ids."""

    def __init__(self, model: Model):
        self.model = model
        self.ids = {t: i for i, (t, k) in enumerate(zip(model.texts, model.kinds)) if k == NORMAL}
        order = sorted(self.ids, key=lambda t: (-model.scores[self.ids[t]], self.ids[t]))
        self.score = {t: model.scores[i] for t, i in self.ids.items()}
        self.rank = {t: r for r, t in enumerate(order)}
        many: dict[float, int] = {}
        for t in order:
            many[self.score[t]] = many.get(self.score[t], 0) + 1
        self.byte_ids = [0] * 256
        for i, k in enumerate(model.kinds):
            if k == BYTE:
                self.byte_ids[int(model.texts[i][3:5], 16)] = i
        self.halves: dict[str, tuple[str, str]] = {}
        #: Pieces for which ranks alone don't tell the order of merges; pairs with them are merged in full.
        self.odd: set[str] = set()
        reached = []
        for t in sorted(self.ids, key=len):
            if len(t) > 1:
                halves = self.merged(list(t), stop=2)
                if len(halves) != 2:
                    continue  # its own characters never merge to it, so it is no token of any text
                self.halves[t] = a, b = halves[0], halves[1]
                low = max(self.rank[x] if len(x) > 1 else -1 for x in halves)
                if many[self.score[t]] > 1 or low > self.rank[t] or a in self.odd or b in self.odd:
                    self.odd.add(t)
            reached.append(t)
        self.known = {c for t in reached for c in t}
        self.automaton = ahocorasick.Automaton()
        for t in {*reached, *self.known}:
            self.automaton.add_word(t, t)
        self.automaton.make_automaton()
        letters = "".join(sorted(map(re.escape, self.known - {BLANK})))
        inside = any(BLANK in t.lstrip(BLANK) for t in reached)
        self.words = re.compile(r"(?s).+" if inside else f"[ {BLANK}]*[^ {BLANK}]+|[ {BLANK}]+").findall
        self.cut = re.compile(f"[{letters}{BLANK}]+|.", re.DOTALL).findall
        self._arrays([*reached, *sorted(self.known - set(reached))])
        self.pairs: dict[tuple[str, str], bool] = {}
        self.odd_pairs: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, bytes] = {}
        self.remembered = 0
        plain = {CONTROL: lambda t: b"", BYTE: lambda t: bytes([int(t[3:5], 16)]), UNKNOWN: lambda t: " \u2047 ".encode(), NORMAL: lambda t: t.replace(BLANK, " ").encode()}
        self.surface = [plain[k](t) for t, k in zip(model.texts, model.kinds)]
        self.controls = {i for i, k in enumerate(model.kinds) if k == CONTROL}
        self.starts_blank = [t.startswith(BLANK) and k == NORMAL for t, k in zip(model.texts, model.kinds)]

    def merged(self, parts: list[str], stop: int = 1) -> list[str]:
        """Join the neighbours of the highest score, leftmost first, until none are a piece or ``stop`` parts are left."""
        while len(parts) > stop:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """Whether the characters of two tokens, side by side, merge to just these two.

        The last merges of both are taken back one by one, the later of the two first. If the parts at the border are a
        piece that ranks before what was taken back, it would have been made then.
        """
        if a in self.odd or b in self.odd:
            return self.merged(list(a + b)) == [a, b]
        limit, rank = len(self.rank), self.rank
        while True:
            r = rank.get(a + b)
            if r is not None and r < limit:
                return False
            left, right = rank[a] if len(a) > 1 else -1, rank[b] if len(b) > 1 else -1
            if left > right:
                limit, a = left, self.halves[a][1]
            elif right >= 0:
                limit, b = right + 1, self.halves[b][0]
            else:
                return True

    def last_tokens(self, text: str) -> list[str]:
        """The tokens of a cut text: the last token of each prefix, then backwards from the end."""
        last: list[str | None] = [None] * (len(text) + 1)
        pairs = self.pairs
        for end, piece in self.automaton.iter(text):
            if last[end + 1] is None:
                start = end + 1 - len(piece)
                if start:
                    pair = (last[start], piece)
                    ok = pairs.get(pair)
                    if ok is None:
                        if len(pairs) >= PAIRS:
                            pairs.clear()
                        ok = pairs[pair] = self.compatible(*pair)
                    if not ok:
                        continue
                last[end + 1] = piece
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def _arrays(self, tokens: list[str]) -> None:
        """Tokens by number: ids, halves and ranks, the trie of the automaton and the pairs that are a piece."""
        self.tokens = tokens
        self.number = {t: i for i, t in enumerate(tokens)}
        self.size = np.array([len(t) for t in tokens])
        ids = [[self.ids[t]] if t in self.ids else [self.byte_ids[b] for b in t.encode()] for t in tokens]
        self.n_ids = np.array([len(x) for x in ids])
        self.first_id = np.cumsum(self.n_ids) - self.n_ids
        self.flat_ids = np.array([i for x in ids for i in x], np.int32)
        self.rank_of = np.array([self.rank[t] if len(t) > 1 else -1 for t in tokens])
        halves = [[self.number[x] for x in self.halves[t]] if len(t) > 1 else (0, 0) for t in tokens]
        self.left_of, self.right_of = np.array(halves, np.int64).T.copy()
        self.is_odd = np.array([t in self.odd for t in tokens])
        pairs = {self.number[p[:i]] << 32 | self.number[p[i:]]: r for p, r in self.rank.items() for i in range(1, len(p)) if p[:i] in self.number and p[i:] in self.number}
        self.tested, self.tested_ok = np.full(1 << 19, -1, np.int64), np.zeros(1 << 19, bool)
        self.pair_rank = Lookup(np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32))
        self.code = np.zeros(0x110000, np.int64)
        for i, c in enumerate(sorted(self.known, key=lambda c: (c != BLANK, c))):
            self.code[ord(c)] = i
        nodes: dict[int, int] = {}
        token_at = [-1]
        for no, t in enumerate(tokens):
            node = 0
            for c in t:
                node = nodes.setdefault(node << 21 | int(self.code[ord(c)]), len(token_at))
                if node == len(token_at):
                    token_at.append(-1)
            token_at[node] = no
        self.token_at = np.array(token_at, np.int32)
        self.trie = Lookup(np.array(list(nodes), np.int64), np.array(list(nodes.values()), np.int32))
        #: The trie's steps by the first characters as a table; 0, the root, stands for none.
        self.steps = np.zeros((len(token_at), WIDE), np.int32)
        for key, node in nodes.items():
            if (key & (1 << 21) - 1) < WIDE:
                self.steps[key >> 21, key & (1 << 21) - 1] = node

    def _step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The trie's node after one more character, or 0."""
        out = self.steps[node, np.minimum(code, WIDE - 1)]
        rare = np.flatnonzero(code >= WIDE - 1)
        if len(rare):
            found = self.trie.get(node[rare].astype(np.int64) << 21 | code[rare])
            out[rare] = np.where(found == NONE, 0, found)
        return out

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``compatible`` of many pairs; an array remembers the last pair tested for each hash."""
        key = a << 32 | b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 19)).astype(np.int64)
        ok = self.tested_ok[slot]
        new = np.flatnonzero(self.tested[slot] != key)
        if len(new):
            ok[new] = self._test(a[new], b[new])
            self.tested[slot[new]], self.tested_ok[slot[new]] = key[new], ok[new]
        return ok

    def _test(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = np.ones(len(a), bool)
        odd = self.is_odd[a] | self.is_odd[b]
        for i in np.flatnonzero(odd).tolist():
            pair = (int(a[i]), int(b[i]))
            if pair not in self.odd_pairs:
                if len(self.odd_pairs) >= PAIRS:
                    self.odd_pairs.clear()
                self.odd_pairs[pair] = self.compatible(*(self.tokens[x] for x in pair))
            ok[i] = self.odd_pairs[pair]
        at = np.flatnonzero(~odd)
        a, b, limit = a[at], b[at], np.full(len(at), len(self.rank))
        while len(at):
            joins = self.pair_rank.get(a << 32 | b) < limit
            ok[at[joins]] = False
            left, right = self.rank_of[a], self.rank_of[b]
            on = ~joins & ((left >= 0) | (right >= 0))
            at, a, b, left, right = at[on], a[on], b[on], left[on], right[on]
            back = left > right
            limit = np.where(back, left, right + 1)
            a, b = np.where(back, self.right_of[a], a), np.where(back, b, self.left_of[b])
        return ok

    def _table(self, texts: list[str]) -> list[bytes]:
        """The ids of texts of equal length: their prefix tables are filled together, place by place."""
        n, size = len(texts), len(texts[0])
        codes = self.code[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)].reshape(n, size).T.ravel()
        # The automaton: tokens of each length by the place where they start, all places at once.
        at, node, ends = np.arange(len(codes)), np.zeros(len(codes), np.int32), []
        while len(at):
            node = self._step(node, codes[at + n * len(ends)])
            at, node = at[node > 0], node[node > 0]
            found = np.full(len(codes), -1, np.int32)
            found[at] = self.token_at[node]
            ends.append(found.reshape(size, n))
            more = at < n * (size - len(ends))
            at, node = at[more], node[more]
        last = np.full((size + 1, n), -1, np.int32)
        last[0] = len(self.size)
        for p in range(1, size + 1):
            for length in range(min(p, len(ends)), 0, -1):
                token = ends[length - 1][p - length]
                here = np.flatnonzero((token >= 0) & (last[p] < 0))
                if len(here):
                    token = token[here]
                    if length < p:
                        ok = self._compatible(last[p - length][here].astype(np.int64), token.astype(np.int64))
                        here, token = here[ok], token[ok]
                    last[p, here] = token
        at, which, words, found = np.full(n, size), np.arange(n), [], []
        while len(which):
            t = last[at, which]
            words.append(which)
            found.append(t)
            at = at - self.size[t]
            at, which = at[at > 0], which[at > 0]
        words, found = np.concatenate(words[::-1]), np.concatenate(found[::-1])
        found = found[np.argsort(words, kind="stable")]  # the last found is the first in its text
        each = np.cumsum(np.bincount(words, minlength=n))
        counts = self.n_ids[found]
        stops = np.concatenate([[0], np.cumsum(counts)])
        flat = self.flat_ids[np.repeat(self.first_id[found] - stops[:-1], counts) + np.arange(stops[-1])].tobytes()
        cuts = [0, *(4 * stops[each]).tolist()]
        return [flat[i:j] for i, j in zip(cuts, cuts[1:])]

    def _long(self, text: str) -> bytes:
        """The ids of one long cut text, by its own table."""
        own = [self.number[t] for t in self.last_tokens(text)]
        return b"".join(self.flat_ids[self.first_id[t] : self.first_id[t] + self.n_ids[t]].tobytes() for t in own)

    def _encode_cut(self, texts: list[str]) -> dict[str, bytes]:
        """The ids of each cut text."""
        out: dict[str, bytes] = {}
        by: dict[int, list[str]] = {}
        for t in texts:
            if t[0] not in self.known:
                out[t] = np.array([self.byte_ids[b] for b in t.encode()], np.int32).tobytes()
            elif len(t) > LONG:
                out[t] = self._long(t)
            else:
                by.setdefault(len(t), []).append(t)
        for size, own in by.items():
            most = max(1, TABLE // size)
            for i in range(0, len(own), most):
                out.update(zip(own[i : i + most], self._table(own[i : i + most])))
        return out

    def _learn(self, new: list[str]) -> None:
        cut = [self.cut(w.replace(" ", BLANK)) for w in new]
        ids = self._encode_cut(list(set(chain.from_iterable(cut))))
        self.memo.update(zip(new, (ids[c[0]] if len(c) == 1 else b"".join([ids[x] for x in c]) for c in cut)))
        self.remembered += sum(map(len, new))

    def _cut_to_parts(self, text: str) -> Iterator[str]:
        """A very long text in parts, each cut before a blank that no piece reaches across."""
        at = 0
        while len(text) - at > PART:
            end = at + PART
            while end < len(text) and not (text[end] == " " and text[end - 1] not in (" ", BLANK)):
                end += 1
            yield text[at:end]
            at = end
        yield text[at:]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and their number in each text."""
        found: list[list[bytes]] = [[] for _ in texts]
        parts: list[tuple[int, str]] = []
        size = 0
        for i, t in enumerate(texts):
            for part in self._cut_to_parts(" " + t if self.model.leading else t) if t else ():
                parts.append((i, part))
                size += len(part)
                if size >= PART:
                    self._encode(parts, found)
                    parts, size = [], 0
        self._encode(parts, found)
        rows = [b"".join(x) for x in found]
        return np.frombuffer(b"".join(rows), np.int32), np.fromiter(map(len, rows), np.int64, len(rows)) // 4

    def _encode(self, parts: list[tuple[int, str]], found: list[list[bytes]]) -> None:
        if self.remembered > MEMO:
            self.memo.clear()
            self.remembered = 0
        cut = [self.words(p) for _, p in parts]
        new = set().union(*cut) - self.memo.keys()
        if new:
            self._learn(list(new))
        for (i, _), words in zip(parts, cut):
            found[i].append(b"".join(map(self.memo.__getitem__, words)))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each row of ids.

        The leading blank of the first piece goes if encoding adds one; bytes that are no character become U+FFFD, each.
        """
        kinds, ends, out = self.model.kinds, np.cumsum(counts).tolist(), []
        for a, b in zip([0, *ends], ends):
            own = ids[a:b].tolist()
            runs, first = [own], next((i for i in own if kinds[i] != CONTROL), None)
            if self.controls.intersection(own):  # bytes on both sides of one are no character
                runs = [list(g) for control, g in groupby(own, self.controls.__contains__) if not control]
            text = "".join(map(self._surface, runs))
            out.append(text[1:] if self.model.leading and first is not None and self.starts_blank[first] else text)
        return out

    def _surface(self, ids: list[int]) -> str:
        surface = self.surface
        data = b"".join([surface[i] for i in ids])
        try:
            return data.decode()
        except UnicodeDecodeError:
            return _mended(data)


def _mended(data: bytes) -> str:
    """Every byte that is part of no character becomes U+FFFD."""
    out = []
    while data:
        try:
            out.append(data.decode())
            break
        except UnicodeDecodeError as e:
            out.append(data[: e.start].decode() + "\ufffd")
            data = data[e.start + 1 :]
    return "".join(out)


_loaded: dict[bytes, Encoder] = {}


def _ready(data: bytes) -> Encoder:
    """The encoder of this worker, made once."""
    if data not in _loaded:
        _loaded.clear()
        _loaded[data] = Encoder(Model(data))
    return _loaded[data]


def _parts(texts: pa.Array) -> Iterator[list[str]]:
    part: list[str] = []
    size = 0
    for t in texts.to_pylist():
        part.append(t or "")
        size += len(part[-1])
        if size >= PART:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(docs: DataFrame, *, path: str, text: str = "text", ids: str = "piece_ids", decoded: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``ids``, the piece ids of the whole text, and ``decoded``, the text that these ids decode to.

    A null text is encoded as an empty one: no ids. Repeated rows are encoded alike; very long texts are cut where that can't
    change an id. An empty table gives an empty one. Columns named like the new ones, in any case, are replaced. ``path``
    is read by the driver; its bytes (half a MB) travel with the job.
    """
    with open(path, "rb") as f:
        data = f.read()
    text_batches(docs.sparkSession)
    made = [ids] if decoded is None else [ids, decoded]
    kept = kept_columns(docs, made, keep)
    source = docs.select(*dict.fromkeys([*kept, text]))
    types = [T.ArrayType(T.IntegerType(), False), T.StringType()]
    schema = T.StructType([*(source.schema[c] for c in kept), *(T.StructField(*x) for x in zip(made, types))])
    at_text, places = source.columns.index(text), [source.columns.index(c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ready(data)
        for batch in batches:
            at = 0
            for part in _parts(batch.column(at_text)):
                flat, counts = encoder.encode(part)
                columns = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat, pa.int32()))]
                if decoded is not None:
                    columns.append(pa.array(encoder.decode(flat, counts), pa.string()))
                rest = batch.slice(at, len(part))
                at += len(part)
                yield pa.RecordBatch.from_arrays([*(rest.column(i) for i in places), *columns], names=[*kept, *made])

    return source.mapInArrow(lean(run), schema)


def decode(docs: DataFrame, *, path: str, ids: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """``docs`` with ``out``, the text of the pieces in ``ids``; null ids give an empty text, ids of control pieces none."""
    with open(path, "rb") as f:
        data = f.read()
    kept = kept_columns(docs, [out])
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(out, T.StringType())])
    at_ids, places = docs.columns.index(ids), [docs.columns.index(c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ready(data)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rest = batch.slice(at, 256)
                lists = rest.column(at_ids)
                counts = np.array([n or 0 for n in lists.value_lengths().to_pylist()], np.int64)
                column = pa.array(encoder.decode(lists.flatten().to_numpy(zero_copy_only=False), counts), pa.string())
                yield pa.RecordBatch.from_arrays([*(rest.column(i) for i in places), column], names=[*kept, out])

    return docs.mapInArrow(lean(run), schema)
