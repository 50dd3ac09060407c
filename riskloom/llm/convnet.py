"""A small convolutional text classifier in numpy: embedding, filters of several widths, max
pooling, softmax. Trained by Adam on the driver with a bounded sample; applied inside tasks.

Symbol 0 is padding and has a zero embedding. A filter of width w sees positions 0..n-1 of a
sequence of n symbols; beyond the end it sees padding.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class ConvNet:
    embedding: np.ndarray  # symbols x dim
    filters: list[np.ndarray]  # per width: width x dim x filters
    bias: list[np.ndarray]
    out: np.ndarray  # pooled x classes
    out_bias: np.ndarray

    @classmethod
    def new(cls, symbols: int, dim: int, widths: tuple[int, ...], filters: int, classes: int, seed: int = 7) -> ConvNet:
        rng = np.random.default_rng(seed)
        f = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        e = f(symbols, dim, scale=0.3)
        e[0] = 0
        return cls(
            e, [f(w, dim, filters, scale=(2 / (w * dim)) ** 0.5) for w in widths], [np.zeros(filters, np.float32) for _ in widths],
            f(len(widths) * filters, classes, scale=0.1), np.zeros(classes, np.float32),
        )

    @property
    def reach(self) -> int:
        return max(len(w) for w in self.filters)

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.bias, self.out, self.out_bias]

    def tables(self) -> list[list[np.ndarray]]:
        """Per width and place: what each symbol adds to the filters."""
        return [[self.embedding @ w[j] for j in range(len(w))] for w in self.filters]

    def step(self, ids: np.ndarray, sizes: np.ndarray, labels: np.ndarray, weights: np.ndarray, rng: np.random.Generator, drop: float) -> tuple[float, list[np.ndarray]]:
        """Loss and gradients for padded sequences (rows of `ids`, with `reach` - 1 zeros at the end)."""
        n, length = len(ids), ids.shape[1] - self.reach + 1
        x = self.embedding[ids]
        beyond = np.arange(length)[None, :] >= np.maximum(sizes, 1)[:, None]
        pooled, places = [], []
        for w, b in zip(self.filters, self.bias, strict=True):
            h = sum(x[:, j : j + length] @ w[j] for j in range(len(w))) + b
            h[beyond] = -np.inf
            place = h.argmax(1)
            pooled.append(np.take_along_axis(h, place[:, None, :], 1)[:, 0])
            places.append(place)
        raw = np.concatenate(pooled, 1)
        keep = (rng.random(raw.shape) >= drop).astype(np.float32) / (1 - drop)
        z = np.maximum(raw, 0) * keep
        logits = z @ self.out + self.out_bias
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        loss = float(-(weights * np.log(p[np.arange(n), labels] + 1e-9)).mean())
        d = p.copy()
        d[np.arange(n), labels] -= 1
        d *= (weights / n)[:, None]
        g_out, g_bias = z.T @ d, d.sum(0)
        dz = (d @ self.out.T) * keep * (raw > 0)
        g_e = np.zeros_like(self.embedding)
        g_w, g_b, at = [], [], 0
        for w, place in zip(self.filters, places, strict=True):
            g = dz[:, at : at + w.shape[2]]
            at += w.shape[2]
            g_b.append(g.sum(0))
            gw = np.zeros_like(w)
            for j in range(len(w)):
                symbol = np.take_along_axis(ids, place + j, 1)
                gw[j] = np.einsum("nfd,nf->df", self.embedding[symbol], g)
                np.add.at(g_e, symbol.ravel(), (g[:, :, None] * w[j].T[None]).reshape(-1, w.shape[1]))
            g_w.append(gw)
        g_e[0] = 0
        return loss, [g_e, *g_w, *g_b, g_out, g_bias]

    def fit(self, sequences: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, epochs: int, rate: float = 0.003, decay: float = 1e-5, drop: float = 0.2, batch: int = 64, most: int = 1 << 16, seed: int = 11) -> ConvNet:
        """Batches hold sequences of like lengths, at most `batch` rows and about `most` symbols."""
        rng = np.random.default_rng(seed)
        params = self.parameters()
        first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        order = np.argsort([len(s) for s in sequences], kind="stable")
        groups, now = [], []
        for i in order:
            if now and (len(now) == batch or (len(now) + 1) * (len(sequences[i]) + self.reach) > most):
                groups.append(now)
                now = []
            now.append(i)
        groups.append(now)
        for _ in range(epochs):
            for g in rng.permutation(len(groups)):
                rows = groups[g]
                ids = np.zeros((len(rows), max(1, max(len(sequences[i]) for i in rows)) + self.reach - 1), np.int64)
                for k, i in enumerate(rows):
                    ids[k, : len(sequences[i])] = sequences[i]
                _, grads = self.step(ids, np.array([len(sequences[i]) for i in rows]), labels[rows], weights[rows], rng, drop)
                t += 1
                for p, g1, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g1 - m)
                    v += 0.001 * (g1 * g1 - v)
                    p -= rate * (m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) + decay * p)
        return self

    def pooled(self, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, tables: list[list[np.ndarray]] | None = None) -> np.ndarray:
        """Pooled filters of sequences `ids[start : start + size]`, each followed by `reach` - 1
        zeros; an empty sequence is followed by one more zero."""
        stops = starts + np.maximum(sizes, 1)
        edges = np.stack((starts, stops), 1).ravel()
        room = len(ids) - self.reach + 1
        out = []
        for parts, b in zip(tables or self.tables(), self.bias, strict=True):
            h = parts[0][ids[:room]]
            for j in range(1, len(parts)):
                h += parts[j][ids[j : room + j]]
            cut = edges[:-1] if edges[-1] >= room else edges
            out.append(np.maximum(np.maximum.reduceat(h, cut, axis=0)[::2] + b, 0))
        return np.concatenate(out, 1)

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)
