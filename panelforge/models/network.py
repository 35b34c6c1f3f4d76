"""A recurrent network of numpy arrays: LSTM, context branch and entity embedding, fused by a small head."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


_C = (2 / np.pi) ** 0.5


def _gelu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value and slope."""
    t = np.tanh(_C * (x + 0.044715 * x**3))
    return 0.5 * x * (1 + t), 0.5 * (1 + t) + 0.5 * x * (1 - t * t) * _C * (1 + 3 * 0.044715 * x * x)


class Block:
    """Linear, layer norm, GELU, dropout."""

    def __init__(self, name: str):
        self.name = name

    def forward(self, p: dict, x: np.ndarray, keep: np.ndarray | None):
        z = x @ p[self.name + "_w"] + p[self.name + "_b"]
        mean, std = z.mean(1, keepdims=True), np.sqrt(z.var(1, keepdims=True) + 1e-5)
        unit = (z - mean) / std
        y, slope = _gelu(unit * p[self.name + "_g"] + p[self.name + "_s"])
        return (y if keep is None else y * keep), (x, unit, std, slope, keep)

    def backward(self, p: dict, g: dict, trace, dy: np.ndarray) -> np.ndarray:
        x, unit, std, slope, keep = trace
        dy = (dy if keep is None else dy * keep) * slope
        g[self.name + "_g"] += (dy * unit).sum(0)
        g[self.name + "_s"] += dy.sum(0)
        du = dy * p[self.name + "_g"]
        dz = (du - du.mean(1, keepdims=True) - unit * (du * unit).mean(1, keepdims=True)) / std
        g[self.name + "_w"] += x.T @ dz
        g[self.name + "_b"] += dz.sum(0)
        return dz @ p[self.name + "_w"].T


class Network:
    """x: rows x steps x inputs; context: rows x columns (none: no such branch); entity: row numbers of the embedding (0 rows: none)."""

    def __init__(self, inputs: int, context: int = 0, entities: int = 0, hidden: int = 16, context_hidden: int = 8, fusion: int = 16, embedding: int = 4, seed: int = 1):
        rng = np.random.default_rng(seed)
        draw = lambda a, *shape: rng.uniform(-(a**-0.5), a**-0.5, shape)
        self.hidden, self.context, self.entities = hidden, context, entities
        p = {"wx": draw(hidden, inputs, 4 * hidden), "wh": draw(hidden, hidden, 4 * hidden), "b": np.zeros(4 * hidden)}
        p["b"][hidden : 2 * hidden] = 1.0  # forget gates start open
        width = hidden
        if context:
            p |= self._block("c", context, context_hidden, draw)
            width += context_hidden
        if entities:
            p["e"] = rng.normal(0, 1, (entities, embedding)) * 0.1
            width += embedding
        p |= self._block("f", width, fusion, draw) | {"o_w": draw(fusion, fusion), "o_b": np.zeros(1)}
        self.p, self.cut = p, (context_hidden if context else 0, embedding if entities else 0)

    @staticmethod
    def _block(name: str, a: int, b: int, draw) -> dict:
        return {name + "_w": draw(a, a, b), name + "_b": np.zeros(b), name + "_g": np.ones(b), name + "_s": np.zeros(b)}

    def forward(self, x: np.ndarray, context: np.ndarray, entity: np.ndarray, rng=None, dropout: float = 0.0):
        p, h = self.p, self.hidden
        state, cell, steps = np.zeros((len(x), h)), np.zeros((len(x), h)), []
        for t in range(x.shape[1]):
            a = x[:, t] @ p["wx"] + state @ p["wh"] + p["b"]
            i, f, o, n = _sigmoid(a[:, :h]), _sigmoid(a[:, h : 2 * h]), _sigmoid(a[:, 2 * h : 3 * h]), np.tanh(a[:, 3 * h :])
            fresh = f * cell + i * n
            steps.append((state, cell, i, f, o, n, np.tanh(fresh)))
            cell, state = fresh, o * np.tanh(fresh)
        keep = lambda n: None if rng is None or not dropout else (rng.uniform(size=(len(x), n)) >= dropout) / (1 - dropout)
        parts, c_trace = [state], None
        if self.context:
            y, c_trace = Block("c").forward(p, context, keep(self.cut[0]))
            parts.append(y)
        if self.entities:
            parts.append(p["e"][entity])
        y, f_trace = Block("f").forward(p, np.concatenate(parts, 1), keep(len(p["f_b"])))
        return y @ p["o_w"] + p["o_b"][0], (x, steps, c_trace, f_trace, y, entity)

    def gradient(self, x, context, entity, target, rng=None, dropout: float = 0.0, delta: float = 1.0) -> tuple[dict, float]:
        """Gradient and value of the mean Huber loss (delta None: squares)."""
        out, (x, steps, c_trace, f_trace, y, entity) = self.forward(x, context, entity, rng, dropout)
        e = out - target
        loss = np.where(np.abs(e) <= delta, 0.5 * e * e, delta * (np.abs(e) - 0.5 * delta)).mean() if delta else 0.5 * (e * e).mean()
        e = (np.clip(e, -delta, delta) if delta else e) / len(target)
        p, h = self.p, self.hidden
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["o_w"], g["o_b"] = y.T @ e, np.array([e.sum()])
        back = Block("f").backward(p, g, f_trace, e[:, None] * p["o_w"])
        state = back[:, :h]
        if self.context:
            Block("c").backward(p, g, c_trace, back[:, h : h + self.cut[0]])
        if self.entities:
            np.add.at(g["e"], entity, back[:, h + self.cut[0] :])
        cell = np.zeros_like(state)
        for t in range(x.shape[1] - 1, -1, -1):
            old, was, i, f, o, n, squashed = steps[t]
            cell = cell + state * o * (1 - squashed**2)
            da = np.concatenate((cell * n * i * (1 - i), cell * was * f * (1 - f), state * squashed * o * (1 - o), cell * i * (1 - n * n)), 1)
            g["wx"] += x[:, t].T @ da
            g["wh"] += old.T @ da
            g["b"] += da.sum(0)
            state, cell = da @ p["wh"].T, cell * f
        return g, float(loss)

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).copy()
            at += v.size


class AdamW:
    """Adam with decoupled weight decay and clipping of the gradient's norm; its moments travel with the weights."""

    def __init__(self, net: Network, m: np.ndarray, v: np.ndarray, step: float, rate: float, decay: float, clip: float):
        self.net, self.m, self.v, self.step, self.rate, self.decay, self.clip = net, m.copy(), v.copy(), step, rate, decay, clip

    def apply(self, g: dict) -> None:
        flat = np.concatenate([g[k].ravel() for k in self.net.p])
        flat *= min(1.0, self.clip / max(float(np.linalg.norm(flat)), 1e-12))
        self.step += 1
        self.m = 0.9 * self.m + 0.1 * flat
        self.v = 0.999 * self.v + 0.001 * flat * flat
        w = self.net.flat() * (1 - self.rate * self.decay)
        self.net.load(w - self.rate * (self.m / (1 - 0.9**self.step)) / (np.sqrt(self.v / (1 - 0.999**self.step)) + 1e-8))
