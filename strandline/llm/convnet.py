"""A small convolutional text classifier in numpy: embeddings, filters of several widths, max pooling, dense heads.

A symbol may have rows in several embedding tables (hashed words have two, so
that a chance collision in one doesn't make two words equal). Max pooling sends
gradients to the winning windows alone, so an update touches few embedding rows.
"""

from __future__ import annotations

import numpy as np

#: Padded words that are convolved at a time.
CELLS = 1 << 15


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class TextConv:
    def __init__(self, rows: list[int], dim: int, widths: tuple[int, ...], filters: int, heads: list[int], seed: int = 11):
        r = np.random.default_rng(seed)
        self.widths, self.filters, self.rows = widths, filters, rows
        self.tables = [np.concatenate([r.normal(0, 0.3, (n, dim)), np.zeros((1, dim))]).astype(np.float32) for n in rows]  # the last row pads
        d = dim * len(rows)
        self.kernels = [r.normal(0, (2 / (d * w)) ** 0.5, (w, d, filters)).astype(np.float32) for w in widths]
        self.bias = np.zeros(filters * len(widths), np.float32)
        self.heads = [r.normal(0, 0.2, (len(self.bias), n)).astype(np.float32) for n in heads]
        self.offsets = [np.zeros(n, np.float32) for n in heads]
        self.reach = max(widths) - 1

    def _pooled(self, ids: np.ndarray, lengths: np.ndarray):
        """Filter maxima of each text, and by filter width and tap the winning windows' embeddings and rows.

        ids: (batch, length, tables), padded by at least ``reach`` columns of the padding row.
        """
        e = np.concatenate([t[ids[..., i]] for i, t in enumerate(self.tables)], -1)
        length = ids.shape[1] - self.reach
        valid = np.arange(length)[None, :] < np.maximum(lengths, 1)[:, None]
        n = np.arange(len(ids))[:, None]
        best, won = [], []
        for w, k in zip(self.widths, self.kernels):
            conv = e[:, :length] @ k[0]
            for j in range(1, w):
                conv += e[:, j : j + length] @ k[j]
            conv[~valid] = -np.inf
            place = conv.argmax(1)
            best.append(np.take_along_axis(conv, place[:, None], 1)[:, 0])
            won.append([(e[n, place + j], ids[n, place + j]) for j in range(w)])
        return np.concatenate(best, 1), won

    def _pooled_in_parts(self, texts: list[np.ndarray]):
        """``_pooled`` of texts, in parts of at most ``CELLS`` padded words (or of one text)."""
        found, a = [], 0
        lengths = np.array([len(s) for s in texts])
        while a < len(texts):
            padded = (np.maximum.accumulate(np.maximum(lengths[a:], 1)) + self.reach) * np.arange(1, len(texts) - a + 1)
            b = a + max(1, int((padded <= CELLS).sum()))
            ids = np.empty((b - a, max(int(lengths[a:b].max()), 1) + self.reach, len(self.rows)), np.int32)
            ids[:] = self.rows
            for i, s in enumerate(texts[a:b]):
                ids[i, : len(s)] = s
            found.append(self._pooled(ids, lengths[a:b]))
            a = b
        if len(found) == 1:
            return found[0]
        won = [[tuple(np.concatenate([x[1][i][j][part] for x in found]) for part in (0, 1)) for j in range(w)] for i, w in enumerate(self.widths)]
        return np.concatenate([x[0] for x in found]), won

    def logits(self, pooled: np.ndarray) -> list[np.ndarray]:
        """Head outputs of pooled filter maxima."""
        f = np.maximum(pooled + self.bias, 0)
        return [f @ h + c for h, c in zip(self.heads, self.offsets)]

    def train(self, sample: list[tuple[np.ndarray, list[int]]], *, epochs: int, batch: int = 64, rate: float = 0.05, weights: list[float] | None = None, drop: float = 0.2, decay: float = 1e-4, seed: int = 5) -> None:
        """``sample``: (ids of shape (length, tables), a class for each head or -1). Batches hold texts of similar length, whole."""
        r = np.random.default_rng(seed)
        weights = weights or [1.0] * len(self.heads)
        dense = [*self.kernels, self.bias, *self.heads, *self.offsets]
        squares = [np.full_like(p, 1e-3) for p in dense]
        table_squares = [np.full(t.shape, 1e-3, np.float32) for t in self.tables]
        order = np.argsort([len(s) for s, _ in sample], kind="stable")
        for _ in range(epochs):
            jitter = np.argsort(np.arange(len(order)) + r.uniform(0, 4 * batch, len(order)))
            batches = [order[jitter[i : i + batch]] for i in range(0, len(order), batch)]
            for b in r.permutation(len(batches)):
                own = sorted((sample[i] for i in batches[b]), key=lambda s: len(s[0]))
                grads, table_grads = self._gradients([s for s, _ in own], np.array([y for _, y in own]), weights, drop, r)
                for p, g, s in zip(dense, grads, squares):
                    g = g + decay * p
                    s += g * g
                    p -= rate * g / np.sqrt(s)
                for t, s, (rows, g) in zip(self.tables, table_squares, table_grads):
                    g = g + decay * t[rows]
                    s[rows] += g * g
                    t[rows] -= rate * g / np.sqrt(s[rows])
                    t[-1] = 0

    def _gradients(self, texts, classes, weights, drop, r):
        pooled, won = self._pooled_in_parts(texts)
        raw = pooled + self.bias
        keep = (r.random(raw.shape) >= drop) / (1 - drop)
        f = (np.maximum(raw, 0) * keep).astype(np.float32)
        d_f = np.zeros_like(f)
        d_heads, d_offsets = [], []
        for j, (h, c) in enumerate(zip(self.heads, self.offsets)):
            p = softmax(f @ h + c)
            known = classes[:, j] >= 0
            p[np.arange(len(p))[known], classes[known, j]] -= 1
            p[~known] = 0
            p *= weights[j] / max(1, known.sum())
            d_heads.append(f.T @ p)
            d_offsets.append(p.sum(0))
            d_f += p @ h.T
        d_f = d_f * keep * (raw > 0)
        d_kernels, touched = [], [([], []) for _ in self.tables]
        dim = self.tables[0].shape[1]
        for i, (w, k) in enumerate(zip(self.widths, self.kernels)):
            g = d_f[:, i * self.filters : (i + 1) * self.filters]
            d_k = np.empty_like(k)
            for j in range(w):
                windows, ids = won[i][j]
                d_k[j] = np.einsum("bf,bfd->df", g, windows)
                d_e = g[:, :, None] * k[j].T[None]
                for t, (rows, parts) in enumerate(touched):
                    rows.append(ids[..., t].ravel())
                    parts.append(d_e[:, :, t * dim : (t + 1) * dim].reshape(-1, dim))
            d_kernels.append(d_k)
        table_grads = []
        for rows, parts in touched:
            unique, back = np.unique(np.concatenate(rows), return_inverse=True)
            g = np.zeros((len(unique), dim), np.float32)
            np.add.at(g, back, np.concatenate(parts))
            table_grads.append((unique, g))
        return [*d_kernels, d_f.sum(0), *d_heads, *d_offsets], table_grads
