"""Bidirectional gated recurrent network over bytes, in numpy.

A cell has an update gate z, a reset gate r and a candidate n. Gates are clipped lines instead of sigmoids, which
costs no transcendental functions::

    z = clip(Ez[byte] + Uz h, 0, 1)    r = clip(Er[byte] + Ur h, 0, 1)
    n = clip(En[byte] + r * (Un h), -1, 1)    h' = h + z (n - h)

Two such cells read a sequence from either side; each position gets a softmax over the classes from both states.
Arrays are feature-major, (features, sequences), so that every step works on contiguous rows. Byte 0 is padding: its
update gate is shut.
"""

from __future__ import annotations

import numpy as np

SHUT = -1e3


class ByteGRU:
    def __init__(self, classes: int, hidden: int = 8, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.hidden, self.classes = hidden, classes
        self.params: dict[str, np.ndarray] = {}
        for side in "fb":
            e = rng.normal(0, 0.5, (3 * hidden, 256))
            e[: 2 * hidden] = 0.5 + 0.2 * e[: 2 * hidden]
            self.params["E" + side] = e.astype(np.float32)
            u = rng.normal(0, hidden**-0.5, (3 * hidden, hidden))
            u[: 2 * hidden] *= 0.2
            self.params["U" + side] = u.astype(np.float32)
        self.params["V"] = rng.normal(0, 0.3, (classes, 2 * hidden)).astype(np.float32)
        self.params["c"] = np.zeros((classes, 1), np.float32)
        #: Bytes that what was learned from has.
        self.known = np.ones(256, bool)
        self._shut()

    def _shut(self) -> None:
        for side in "fb":
            self.params["E" + side][: self.hidden, 0] = SHUT

    def states(self, x: np.ndarray) -> np.ndarray:
        """(steps, 2 hidden, sequences) for bytes x (steps, sequences)."""
        steps, n = x.shape
        h2 = self.hidden
        out = np.empty((steps, 2 * h2, n), np.float32)
        g, a = np.empty((3 * h2, n), np.float32), np.empty((3 * h2, n), np.float32)
        at = x.astype(np.intp)
        for side, lo, order in (("f", 0, range(steps)), ("b", h2, range(steps - 1, -1, -1))):
            e, u, h = self.params["E" + side], self.params["U" + side], np.zeros((h2, n), np.float32)
            for t in order:
                np.take(e, at[t], axis=1, out=g, mode="clip")
                np.matmul(u, h, out=a)
                gates = g[: 2 * h2]
                gates += a[: 2 * h2]
                np.maximum(gates, 0, out=gates)
                np.minimum(gates, 1, out=gates)
                new = a[2 * h2 :]
                new *= g[h2 : 2 * h2]
                new += g[2 * h2 :]
                np.maximum(new, -1, out=new)
                np.minimum(new, 1, out=new)
                new -= h
                new *= g[:h2]
                h = out[t, lo : lo + h2]
                np.add(new, out[t - 1 if side == "f" else t + 1, lo : lo + h2] if t != order[0] else 0, out=h)
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(steps, classes, sequences): what each position says."""
        y = np.matmul(self.params["V"], self.states(x))
        y += self.params["c"]
        y -= y.max(axis=1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(axis=1, keepdims=True)
        return y

    def gradients(self, x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients by backpropagation through time. label (sequences), weight (steps, sequences)."""
        steps, n = x.shape
        k, p = self.hidden, self.params
        kept, out = {}, np.zeros((steps, 2 * k, n), np.float32)
        for side, lo in (("f", 0), ("b", k)):
            h, rows = np.zeros((k, n), np.float32), []
            for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
                e, uh = p["E" + side][:, x[t]], p["U" + side] @ h
                az, ar = e[:k] + uh[:k], e[k : 2 * k] + uh[k : 2 * k]
                z, r = az.clip(0, 1), ar.clip(0, 1)
                an = e[2 * k :] + r * uh[2 * k :]
                new = an.clip(-1, 1)
                rows.append((t, h, az, ar, z, r, uh[2 * k :], an, new))
                h = h + z * (new - h)
                out[t, lo : lo + k] = h
            kept[side] = rows
        y = np.matmul(p["V"], out) + p["c"]
        y -= y.max(axis=1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(axis=1, keepdims=True)
        total = max(1.0, float(weight.sum()))
        at = (np.arange(steps)[:, None], label[None, :], np.arange(n)[None, :])
        loss = float(-(np.log(y[at] + 1e-9) * weight).sum()) / total
        y[at] -= 1
        y *= (weight / total)[:, None, :].astype(np.float32)
        grad = {"V": np.einsum("tcn,thn->ch", y, out, optimize=True), "c": y.sum(axis=(0, 2))[:, None]}
        back = np.matmul(p["V"].T, y)
        for side, lo in (("f", 0), ("b", k)):
            u, dh, du, de = p["U" + side], np.zeros((k, n), np.float32), np.zeros((3 * k, k), np.float32), np.zeros((steps, 3 * k, n), np.float32)
            for t, h, az, ar, z, r, hn, an, new in reversed(kept[side]):
                dh = dh + back[t, lo : lo + k]
                dan = dh * z * (np.abs(an) < 1)
                da = np.concatenate([dh * (new - h) * ((az > 0) & (az < 1)), dan * hn * ((ar > 0) & (ar < 1)), dan * r])
                du += da @ h.T
                dh = dh * (1 - z) + u.T @ da
                de[t, : 2 * k], de[t, 2 * k :] = da[: 2 * k], dan
            flat, at_byte = de.transpose(1, 0, 2).reshape(3 * k, -1), x.ravel()
            grad["E" + side] = np.stack([np.bincount(at_byte, row, 256) for row in flat]).astype(np.float32)
            grad["U" + side] = du
        return loss, grad

    def train(self, sequences: np.ndarray, labels: np.ndarray, weights: np.ndarray, rounds: int, batch: int = 192, rate: float = 0.02, seed: int = 0) -> list[float]:
        """Adam on random batches of sequences (n, steps); the rate falls to zero in a line. Losses by round."""
        rng, losses = np.random.default_rng(seed), []
        m = {k: np.zeros_like(v) for k, v in self.params.items()}
        s = {k: np.zeros_like(v) for k, v in self.params.items()}
        for i in range(rounds):
            pick = rng.integers(0, len(sequences), batch)
            loss, grad = self.gradients(np.ascontiguousarray(sequences[pick].T), labels[pick], np.ascontiguousarray(weights[pick].T))
            losses.append(loss)
            norm = max(1.0, float(np.sqrt(sum((g**2).sum() for g in grad.values()))))
            for k, g in grad.items():
                m[k] += 0.1 * (g / norm - m[k])
                s[k] += 0.01 * ((g / norm) ** 2 - s[k])
                self.params[k] -= rate * (1 - i / rounds) * (m[k] / (1 - 0.9 ** (i + 1))) / (np.sqrt(s[k] / (1 - 0.99 ** (i + 1))) + 1e-6)
            self._shut()
        return losses
