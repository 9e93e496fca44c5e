"""A bidirectional LSTM over characters with a linear-chain CRF on top, in numpy."""

from __future__ import annotations

import io

import numpy as np

EMBEDDING, HIDDEN = 12, 16
VOCABULARY = 100


def encoded(text: str) -> np.ndarray:
    """Symbols of a text: ASCII as it is, else white space, letter, digit or other."""

    def symbol(c: str) -> int:
        o = ord(c)
        if 32 <= o < 127:
            return o - 31
        return 96 if c.isspace() else 97 if c.isalpha() else 98 if c.isdigit() else 99

    return np.fromiter(map(symbol, text), dtype="int64", count=len(text))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    """Tags for every character of equally long windows."""

    def __init__(self, tags: int, seed: int = 7):
        draw = np.random.default_rng(seed)
        small = lambda *shape: (draw.standard_normal(shape) * 0.15).astype("float32")
        self.p = {"embed": small(VOCABULARY, EMBEDDING), "out": small(2 * HIDDEN, tags), "out_bias": np.zeros(tags, "float32")}
        for way in ("f", "b"):
            self.p[f"x_{way}"] = small(EMBEDDING, 4 * HIDDEN)
            self.p[f"h_{way}"] = small(HIDDEN, 4 * HIDDEN)
            bias = np.zeros(4 * HIDDEN, "float32")
            # Gates stay open at first.
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.p[f"bias_{way}"] = bias
        self.p["moves"] = small(tags, tags)
        self.p["first"] = np.zeros(tags, "float32")

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.p)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Tagger:
        loaded = dict(np.load(io.BytesIO(data)))
        model = cls(loaded["first"].shape[0])
        model.p = loaded
        return model

    def _lstm(self, x: np.ndarray, way: str) -> tuple[np.ndarray, list]:
        n, length, _ = x.shape
        into = x @ self.p[f"x_{way}"] + self.p[f"bias_{way}"]
        h = c = np.zeros((n, HIDDEN), "float32")
        out, trace = np.empty((n, length, HIDDEN), "float32"), []
        for t in range(length) if way == "f" else range(length - 1, -1, -1):
            gates = into[:, t] + h @ self.p[f"h_{way}"]
            i, f, o = (_sigmoid(gates[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(gates[:, 3 * HIDDEN :])
            before, c_before = h, c
            c = f * c + i * g
            squashed = np.tanh(c)
            h = o * squashed
            out[:, t] = h
            trace.append((t, i, f, o, g, before, c_before, squashed))
        return out, trace

    def _lstm_back(self, x: np.ndarray, way: str, trace: list, d_out: np.ndarray, grads: dict) -> np.ndarray:
        d_into = np.zeros((*d_out.shape[:2], 4 * HIDDEN), "float32")
        dh = dc = np.zeros((len(x), HIDDEN), "float32")
        d_rec = np.zeros_like(self.p[f"h_{way}"])
        for t, i, f, o, g, before, c_before, squashed in reversed(trace):
            dh = dh + d_out[:, t]
            dc = dc + dh * o * (1 - squashed**2)
            gates = np.concatenate(
                [dc * g * i * (1 - i), dc * c_before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2)], axis=1
            )
            d_into[:, t] = gates
            d_rec += before.T @ gates
            dh = gates @ self.p[f"h_{way}"].T
            dc = dc * f
        flat = d_into.reshape(-1, 4 * HIDDEN)
        grads[f"h_{way}"] = d_rec
        grads[f"x_{way}"] = x.reshape(-1, EMBEDDING).T @ flat
        grads[f"bias_{way}"] = flat.sum(axis=0)
        return d_into @ self.p[f"x_{way}"].T

    def emissions(self, symbols: np.ndarray):
        x = self.p["embed"][symbols]
        (forward, tf), (backward, tb) = self._lstm(x, "f"), self._lstm(x, "b")
        both = np.concatenate([forward, backward], axis=2)
        return both @ self.p["out"] + self.p["out_bias"], (x, tf, tb, both)

    def learn_gradients(self, symbols: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Negative log likelihood per window, and its gradients."""
        scores, (x, tf, tb, both) = self.emissions(symbols)
        n, length, k = scores.shape
        moves = self.p["moves"]
        alpha, beta = np.empty_like(scores), np.zeros_like(scores)
        alpha[:, 0] = self.p["first"] + scores[:, 0]
        for t in range(1, length):
            alpha[:, t] = scores[:, t] + _logsumexp(alpha[:, t - 1][:, :, None] + moves, 1)
        for t in range(length - 2, -1, -1):
            beta[:, t] = _logsumexp(moves + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        total = _logsumexp(alpha[:, -1], 1)
        rows = np.arange(n)
        gold = self.p["first"][tags[:, 0]] + scores[rows[:, None], np.arange(length), tags].sum(axis=1) + moves[tags[:, :-1], tags[:, 1:]].sum(axis=1)
        d_scores = np.exp(alpha + beta - total[:, None, None])
        d_first = d_scores[:, 0].sum(axis=0)
        np.subtract.at(d_first, tags[:, 0], 1)
        d_scores[rows[:, None], np.arange(length), tags] -= 1
        d_moves = np.zeros_like(moves)
        for t in range(1, length):
            d_moves += np.exp(alpha[:, t - 1][:, :, None] + moves + (scores[:, t] + beta[:, t])[:, None, :] - total[:, None, None]).sum(axis=0)
        np.subtract.at(d_moves, (tags[:, :-1], tags[:, 1:]), 1)
        grads = {"first": d_first, "moves": d_moves}
        flat = d_scores.reshape(-1, k)
        grads["out"], grads["out_bias"] = both.reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(axis=0)
        d_both = d_scores @ self.p["out"].T
        dx = self._lstm_back(x, "f", tf, d_both[:, :, :HIDDEN], grads) + self._lstm_back(x, "b", tb, d_both[:, :, HIDDEN:], grads)
        grads["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(grads["embed"], symbols.ravel(), dx.reshape(-1, EMBEDDING))
        return float((total - gold).mean()), {name: g / n for name, g in grads.items()}

    def fit(self, symbols: np.ndarray, tags: np.ndarray, steps: int, batch: int = 48, rate: float = 0.01, seed: int = 3) -> float:
        """Adam over random batches; returns the last losses' mean."""
        draw = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        losses = []
        for step in range(1, steps + 1):
            rows = draw.integers(0, len(symbols), batch)
            loss, grads = self.learn_gradients(symbols[rows], tags[rows])
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            now = rate * (1 - step / (steps + 1))
            for name, g in grads.items():
                g = g * min(1.0, 5 / (norm + 1e-9))
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.01 * (g * g - second[name])
                self.p[name] = self.p[name] - (now * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)).astype("float32")
        return float(np.mean(losses[-20:]))

    def decode(self, symbols: np.ndarray) -> np.ndarray:
        """The best sequence of tags of every window."""
        scores, _ = self.emissions(symbols)
        n, length, k = scores.shape
        best = self.p["first"] + scores[:, 0]
        back = np.empty((n, length, k), "int16")
        for t in range(1, length):
            ways = best[:, :, None] + self.p["moves"]
            back[:, t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + scores[:, t]
        out = np.empty((n, length), "int64")
        out[:, -1] = best.argmax(axis=1)
        for t in range(length - 1, 0, -1):
            out[:, t - 1] = back[np.arange(n), t, out[:, t]]
        return out
