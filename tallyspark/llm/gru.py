"""A small bidirectional gated recurrent network over bytes, in numpy.

Every position of a window is labelled from the states of both directions there. Training
is backpropagation through time with Adam; the loss is the mean over all positions.
"""

from __future__ import annotations

import numpy as np

PAD = 256


class Network:
    """Weights: ``embed`` (2, 257, 3H) with biases in it, ``back`` (2, H, 3H), ``out`` (2H, L), ``bias`` (L).

    Gates are in the order reset, update, candidate; direction 1 reads backwards.
    """

    def __init__(self, hidden: int, labels: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        scale = 1 / np.sqrt(hidden)
        self.hidden = hidden
        self.embed = rng.normal(0, 0.3, (2, 257, 3 * hidden)).astype(np.float32)
        self.back = rng.uniform(-scale, scale, (2, hidden, 3 * hidden)).astype(np.float32)
        self.out = rng.normal(0, 0.3, (2 * hidden, labels)).astype(np.float32)
        self.bias = np.zeros(labels, dtype=np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.back, self.out, self.bias]

    def _forward(self, x: np.ndarray, way: int) -> tuple[np.ndarray, list]:
        """States (T, B, H) for byte values x (T, B), and what the way back needs."""
        size, steps = self.hidden, len(x)
        h = np.zeros((x.shape[1], size), dtype=np.float32)
        states, kept = np.empty((steps, *h.shape), dtype=np.float32), []
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            a, c = self.embed[way][x[t]], h @ self.back[way]
            gates = 1 / (1 + np.exp(-(a[:, : 2 * size] + c[:, : 2 * size])))
            r, z = gates[:, :size], gates[:, size:]
            n = np.tanh(a[:, 2 * size :] + r * c[:, 2 * size :])
            kept.append((t, h, r, z, n, c[:, 2 * size :]))
            h = n + z * (h - n)
            states[t] = h
        return states, kept

    def _backward(self, x: np.ndarray, way: int, kept: list, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.hidden
        d_a = np.empty((*x.shape, 3 * size), dtype=np.float32)
        d_back = np.zeros_like(self.back[way])
        d_h = np.zeros((x.shape[1], size), dtype=np.float32)
        for t, h, r, z, n, c in reversed(kept):
            d_h = d_h + d_states[t]
            d_n = d_h * (1 - z) * (1 - n * n)
            d_r = d_n * c * r * (1 - r)
            d_z = d_h * (h - n) * z * (1 - z)
            d_a[t] = np.concatenate([d_r, d_z, d_n], axis=1)
            d_c = np.concatenate([d_r, d_z, d_n * r], axis=1)
            d_back += h.T @ d_c
            d_h = d_h * z + d_c @ self.back[way].T
        d_embed = np.zeros_like(self.embed[way])
        np.add.at(d_embed, x.reshape(-1), d_a.reshape(-1, 3 * size))
        return d_embed, d_back

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss and gradients for windows x (T, B), PAD where a text has ended, with labels y (B)."""
        (ahead, kept0), (behind, kept1) = self._forward(x, 0), self._forward(x, 1)
        both = np.concatenate([ahead, behind], axis=2)
        logits = both @ self.out + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        real = (x != PAD).astype(np.float32)
        real /= max(1.0, real.sum())
        loss = -float((np.log(p[:, np.arange(len(y)), y] + 1e-9) * real).sum())
        p[:, np.arange(len(y)), y] -= 1
        d_logits = p * real[..., None]
        flat = d_logits.reshape(-1, d_logits.shape[2])
        d_both = d_logits @ self.out.T
        sides = [
            self._backward(x, way, kept, d_both[..., way * self.hidden : (way + 1) * self.hidden])
            for way, kept in ((0, kept0), (1, kept1))
        ]
        d_embed, d_back = (np.stack(pair) for pair in zip(*sides))
        return loss, [d_embed, d_back, both.reshape(-1, both.shape[2]).T @ flat, flat.sum(axis=0)]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 256, rate: float = 0.01, seed: int = 7) -> None:
        """Adam over windows x (N, T) with labels y (N)."""
        rng = np.random.default_rng(seed)
        first = [np.zeros_like(w) for w in self.parameters()]
        second = [np.zeros_like(w) for w in self.parameters()]
        step = 0
        total = epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                some = order[at : at + batch]
                _, grads = self.gradients(np.ascontiguousarray(x[some].T), y[some])
                step += 1
                now = rate * (1 - 0.9 * step / total)
                for w, g, m, v in zip(self.parameters(), grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)

    def label(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (N, L): for each window of x (N, T), summed over its real positions."""
        size, (count, steps) = self.hidden, x.shape
        cols = np.ascontiguousarray(x.T)
        # A sigmoid is a tanh of half its argument; the halves go into the weights.
        half = np.concatenate([np.full(2 * size, 0.5), np.ones(size)]).astype(np.float32)
        embed = [np.ascontiguousarray((self.embed[w] * half).T) for w in (0, 1)]
        back = [np.ascontiguousarray((self.back[w] * half).T) for w in (0, 1)]
        states = np.empty((steps, 2 * size, count), dtype=np.float32)
        a, c = np.empty((3 * size, count), dtype=np.float32), np.empty((3 * size, count), dtype=np.float32)
        for way in (0, 1):
            h = np.zeros((size, count), dtype=np.float32)
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                np.take(embed[way], cols[t], axis=1, out=a, mode="clip")
                np.matmul(back[way], h, out=c)
                gates = a[: 2 * size]
                gates += c[: 2 * size]
                np.tanh(gates, out=gates)
                gates *= 0.5
                gates += 0.5
                n, m = a[2 * size :], c[2 * size :]
                m *= gates[:size]
                n += m
                np.tanh(n, out=n)
                h -= n
                h *= gates[size:]
                h += n
                states[t, way * size : (way + 1) * size] = h
        p = np.matmul(np.ascontiguousarray(self.out.T), states)
        p += self.bias[:, None]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p *= ((cols != PAD) / p.sum(axis=1))[:, None, :]
        return p.sum(axis=0).T
