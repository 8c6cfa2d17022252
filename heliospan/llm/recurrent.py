"""Bidirectional gated recurrent network with attention pooling, in numpy.

A window is a row of word numbers. A word's input is its own vector (zero for a
word outside the vocabulary) and the mean vector of its character triples. Word
inputs are projected once per distinct word, so the steps only gather them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WORD_SIZE = 8
CHAR_SIZE = 8
HIDDEN = 8
ATTENTION = 8
CHAR_BITS = 12
BLOCK = 2048

Params = dict[str, np.ndarray]


@dataclass
class Words:
    """Distinct words: vocabulary row (0: none) and character triples of each."""

    vocabulary: np.ndarray
    triples: np.ndarray
    bounds: np.ndarray


def initial(vocabulary: np.ndarray, seed: int = 9) -> Params:
    """Small random parameters; ``vocabulary`` holds a first value for each word's first component."""
    random = np.random.default_rng(seed)
    size = WORD_SIZE + CHAR_SIZE
    draw = lambda *shape, scale=0.3: (random.standard_normal(shape) * scale).astype(np.float32)
    p = {"word": draw(len(vocabulary), WORD_SIZE, scale=0.02), "char": draw(1 << CHAR_BITS, CHAR_SIZE, scale=0.1)}
    p["word"][:, 0] = vocabulary
    p["word"][0] = 0
    for side in "fb":
        p[f"wx{side}"], p[f"bx{side}"] = draw(size, 3 * HIDDEN), np.zeros(3 * HIDDEN, np.float32)
        p[f"u{side}"] = draw(HIDDEN, 3 * HIDDEN)
    p["wa"], p["va"] = draw(2 * HIDDEN, ATTENTION), draw(ATTENTION)
    p["wo"], p["bo"] = draw(2 * HIDDEN), np.zeros(1, np.float32)
    return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return (np.tanh(x * np.float32(0.5)) + np.float32(1)) * np.float32(0.5)


def inputs(p: Params, words: Words) -> np.ndarray:
    """Vector of every distinct word."""
    sizes = np.diff(words.bounds)
    total = np.zeros((len(sizes), CHAR_SIZE), np.float32)
    some = np.flatnonzero(sizes > 0)
    if len(some):
        total[some] = np.add.reduceat(p["char"][words.triples], words.bounds[some], axis=0) / sizes[some, None]
    return np.concatenate([p["word"][words.vocabulary], total], axis=1)


def projections(p: Params, x: np.ndarray) -> dict[str, np.ndarray]:
    """Input part of the gates of every distinct word, with a last row for places after a window's end."""
    return {s: np.concatenate([x @ p[f"wx{s}"] + p[f"bx{s}"], np.zeros((1, 3 * HIDDEN), np.float32)]) for s in "fb"}


def _run(p: Params, projected: dict, windows: np.ndarray, mask: np.ndarray, keep: bool):
    """Hidden states of both directions, (time, window, 2 * HIDDEN), and what the backward pass needs."""
    count, steps = windows.shape
    states = np.zeros((steps, count, 2 * HIDDEN), np.float32)
    kept: dict[str, list] = {"f": [], "b": []}
    for d, side in enumerate("fb"):
        h = np.zeros((count, HIDDEN), np.float32)
        u, table = p[f"u{side}"], projected[side]
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            x = table[windows[:, t]]
            g = h @ u
            zr = _sigmoid(x[:, :2 * HIDDEN] + g[:, :2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN:] + r * g[:, 2 * HIDDEN:])
            m = mask[:, t, None]
            new = h + m * (1 - z) * (n - h)
            if keep:
                kept[side].append((t, h, z, r, n, g[:, 2 * HIDDEN:], m))
            h = new
            states[t, :, d * HIDDEN:(d + 1) * HIDDEN] = h
    return states, kept


def _pool(p: Params, states: np.ndarray, mask: np.ndarray):
    hidden = np.tanh(states @ p["wa"])
    e = hidden @ p["va"]
    e = np.where(mask.T > 0, e, np.float32(-1e9))
    a = np.exp(e - e.max(axis=0)) * mask.T
    a = a / np.maximum(a.sum(axis=0), np.float32(1e-9))
    pooled = (a[:, :, None] * states).sum(axis=0)
    return hidden, a, pooled, pooled @ p["wo"] + p["bo"][0]


def _subset(words: Words, windows: np.ndarray) -> tuple[Words, np.ndarray, int]:
    """The words that occur in some windows, the windows with their numbers there, and their count."""
    used, inner = np.unique(windows, return_inverse=True)
    real = used[used < len(words.vocabulary)]
    first, sizes = words.bounds[real], np.diff(words.bounds)[real]
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes) + np.repeat(first, sizes)
    return Words(words.vocabulary[real], words.triples[at], bounds), inner.reshape(windows.shape), len(real)


def scores(p: Params, words: Words, windows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Logit of every window; a window of no words has the bias. Memory is that of a block of windows."""
    out = np.empty(len(windows), np.float32)
    for i in range(0, len(windows), BLOCK):
        part, inner, _ = _subset(words, windows[i:i + BLOCK])
        projected = projections(p, inputs(p, part))
        mask = (np.arange(inner.shape[1]) < sizes[i:i + BLOCK, None]).astype(np.float32)
        states, _ = _run(p, projected, inner, mask, keep=False)
        out[i:i + BLOCK] = _pool(p, states, mask)[3]
    return out


def gradients(p: Params, words: Words, windows: np.ndarray, sizes: np.ndarray, goal: np.ndarray, weight: np.ndarray) -> Params:
    """Gradient of the weighted log loss over some windows, by back-propagation through time."""
    part, inner, count = _subset(words, windows)
    x = inputs(p, part)
    projected = projections(p, x)
    mask = (np.arange(windows.shape[1]) < sizes[:, None]).astype(np.float32)
    states, kept = _run(p, projected, inner, mask, keep=True)
    hidden, a, pooled, logit = _pool(p, states, mask)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    dlogit = ((_sigmoid(logit) - goal) * weight / max(float(weight.sum()), 1e-9)).astype(np.float32)
    g["bo"][0], g["wo"] = dlogit.sum(), pooled.T @ dlogit
    dpooled = dlogit[:, None] * p["wo"]
    dstates = a[:, :, None] * dpooled
    da = (states * dpooled).sum(axis=2)
    de = a * (da - (a * da).sum(axis=0))
    g["va"] = np.einsum("tbk,tb->k", hidden, de)
    dhidden = de[:, :, None] * p["va"] * (1 - hidden * hidden)
    g["wa"] = np.einsum("tbi,tbk->ik", states, dhidden)
    dstates += dhidden @ p["wa"].T
    dx = np.zeros_like(x)
    for d, side in enumerate("fb"):
        dproj = np.zeros_like(projected[side])
        dh = np.zeros((len(windows), HIDDEN), np.float32)
        u = p[f"u{side}"]
        for t, h, z, r, n, gn, m in reversed(kept[side]):
            dh = dh + dstates[t, :, d * HIDDEN:(d + 1) * HIDDEN]
            dn = dh * m * (1 - z) * (1 - n * n)
            dz = dh * m * (h - n) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            dgate = np.concatenate([dz, dr, dn], axis=1)
            dg = np.concatenate([dz, dr, dn * r], axis=1)
            g[f"u{side}"] += h.T @ dg
            np.add.at(dproj, inner[:, t], dgate)
            dh = dh * (1 - m * (1 - z)) + dg @ u.T
        dproj = dproj[:count]
        g[f"wx{side}"], g[f"bx{side}"] = x.T @ dproj, dproj.sum(axis=0)
        dx += dproj @ p[f"wx{side}"].T
    np.add.at(g["word"], part.vocabulary, dx[:, :WORD_SIZE])
    g["word"][0] = 0
    lengths = np.diff(part.bounds)
    np.add.at(g["char"], part.triples, np.repeat(dx[:, WORD_SIZE:] / np.maximum(lengths, 1)[:, None], lengths, axis=0))
    return g


class Adam:
    def __init__(self, p: Params, rate: float = 0.01):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: Params) -> None:
        self.t += 1
        for k, grad in g.items():
            self.m[k] += np.float32(0.1) * (grad - self.m[k])
            self.v[k] += np.float32(0.01) * (grad * grad - self.v[k])
            scale = np.float32(self.rate * np.sqrt(1 - 0.99 ** self.t) / (1 - 0.9 ** self.t))
            self.p[k] -= scale * self.m[k] / (np.sqrt(self.v[k]) + np.float32(1e-6))
