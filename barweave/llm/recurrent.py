"""A bidirectional LSTM with one output a step, in numpy: training by Adam, scoring of sequences of any length in bounded memory."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

SEGMENT = 256
Weights = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def start(width: int, hidden: int, seed: int) -> Weights:
    rng = np.random.default_rng(seed)
    w: Weights = {}
    for d in "fb":
        w[f"in_{d}"] = rng.normal(0, 1 / np.sqrt(width), (width, 4 * hidden))
        w[f"state_{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
        w[f"bias_{d}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])  # input, forget, cell, output
        w[f"out_{d}"] = rng.normal(0, 1 / np.sqrt(hidden), hidden)
    w["out"] = np.zeros(1)
    return w


def walk(w: Weights, d: str, x: np.ndarray, mask: np.ndarray, h: np.ndarray, c: np.ndarray):
    """States of one direction over x (steps, sequences, width); states are zero where ``mask`` is. Steps are given in page order."""
    hidden = h.shape[1]
    pre = x @ w[f"in_{d}"] + w[f"bias_{d}"]
    states = np.zeros((len(x) + 1, *h.shape), x.dtype), np.zeros((len(x) + 1, *h.shape), x.dtype)
    gates = np.zeros((len(x), len(h), 4 * hidden), x.dtype)
    order = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
    states[0][0], states[1][0] = h, c
    for k, t in enumerate(order):
        z = pre[t] + h @ w[f"state_{d}"]
        g = sigmoid(z)
        g[:, 2 * hidden:3 * hidden] = np.tanh(z[:, 2 * hidden:3 * hidden])
        i, f, a, o = (g[:, j * hidden:(j + 1) * hidden] for j in range(4))
        c = (f * c + i * a) * mask[t][:, None]
        h = o * np.tanh(c) * mask[t][:, None]
        states[0][k + 1], states[1][k + 1], gates[k] = h, c, g
    return states, gates


def gradients(w: Weights, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, Weights]:
    """Mean log loss over the steps that ``mask`` keeps, and its gradients by back-propagation through time."""
    hidden = w["state_f"].shape[0]
    zero = np.zeros((x.shape[1], hidden), x.dtype)
    walked = {d: walk(w, d, x, mask, zero, zero) for d in "fb"}
    ahead, back = walked["f"][0][0][1:], walked["b"][0][0][1:][::-1]
    logits = ahead @ w["out_f"] + back @ w["out_b"] + w["out"]
    p, n = sigmoid(logits), max(mask.sum(), 1)
    loss = float(-(mask * (y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))).sum() / n)
    error = (p - y) * mask / n
    grad: Weights = {"out": np.array([error.sum()])}
    for d, h_all in (("f", ahead), ("b", back)):
        grad[f"out_{d}"] = np.einsum("tb,tbh->h", error, h_all)
        (hs, cs), gates = walked[d]
        dh_next, dc_next = np.zeros_like(zero), np.zeros_like(zero)
        pre = np.zeros_like(gates)
        for k in range(len(x) - 1, -1, -1):
            t = k if d == "f" else len(x) - 1 - k
            m = mask[t][:, None]
            i, f, a, o = (gates[k][:, j * hidden:(j + 1) * hidden] for j in range(4))
            dh = (error[t][:, None] * w[f"out_{d}"] + dh_next) * m
            tanh_c = np.tanh(cs[k + 1])
            dc = (dc_next + dh * o * (1 - tanh_c**2)) * m
            pre[k] = np.concatenate([dc * a * i * (1 - i), dc * cs[k] * f * (1 - f), dc * i * (1 - a**2), dh * tanh_c * o * (1 - o)], axis=1)
            dh_next, dc_next = pre[k] @ w[f"state_{d}"].T, dc * f
        grad[f"state_{d}"] = np.einsum("kbh,kbg->hg", hs[:-1], pre)
        by_time = pre if d == "f" else pre[::-1]
        grad[f"in_{d}"] = np.einsum("tbw,tbg->wg", x, by_time, optimize=True)
        grad[f"bias_{d}"] = pre.sum(axis=(0, 1))
    return loss, grad


def padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(steps, sequences, width) and the mask of real steps."""
    longest = max(map(len, sequences))
    x = np.zeros((longest, len(sequences), sequences[0].shape[1]), sequences[0].dtype)
    mask = np.zeros((longest, len(sequences)), x.dtype)
    for k, s in enumerate(sequences):
        x[:len(s), k], mask[:len(s), k] = s, 1
    return x, mask


def fit(sequences: list[np.ndarray], labels: list[np.ndarray], hidden: int, epochs: int, seed: int, rate: float = 4e-3, batch: int = 32,
        vary: Callable[[np.random.Generator, np.ndarray], np.ndarray] | None = None) -> Weights:
    """Weights after ``epochs`` passes; sequences of similar length share a batch, ``vary`` may change a sequence in each pass."""
    rng = np.random.default_rng(seed)
    w = {k: v.astype(sequences[0].dtype) for k, v in start(sequences[0].shape[1], hidden, seed).items()}
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
    groups = [order[i:i + batch] for i in range(0, len(order), batch)]
    for epoch in range(epochs):
        for g in rng.permutation(len(groups)):
            x, mask = padded([vary(rng, sequences[i]) if vary else sequences[i] for i in groups[g]])
            y = padded([labels[i][:, None] for i in groups[g]])[0][..., 0]
            _, grad = gradients(w, x, mask, y)
            size = float(np.sqrt(sum(float((v**2).sum()) for v in grad.values())))
            step += 1
            now = rate * (1 - epoch / (epochs + 1))
            for k, v in grad.items():
                v = v * min(1.0, 1 / max(size, 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v**2
                w[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return w


def logits(w: Weights, lengths: list[int], vectors: Callable[[int, int, int], np.ndarray], segment: int = SEGMENT) -> list[np.ndarray]:
    """Output of every step of several sequences. ``vectors(k, a, b)`` gives steps a..b of sequence k. Long sequences go through in
    segments that hand on their states, first forwards, then backwards, so memory does not follow their length."""
    hidden, longest, kind = w["state_f"].shape[0], max(lengths), w["in_f"].dtype
    total = np.full((longest, len(lengths)), w["out"][0])
    edges = [(a, min(a + segment, longest)) for a in range(0, longest, segment)]
    kept = None
    for d, order in (("f", edges), ("b", edges[::-1])):
        h = c = np.zeros((len(lengths), hidden), kind)
        for a, b in order:
            if kept is None or len(edges) > 1:
                x, mask = np.zeros((b - a, len(lengths), w["in_f"].shape[0]), kind), np.zeros((b - a, len(lengths)), kind)
                for k, n in enumerate(lengths):
                    if a < n:
                        x[:min(b, n) - a, k], mask[:min(b, n) - a, k] = vectors(k, a, min(b, n)), 1
                kept = x, mask
            (hs, cs), _ = walk(w, d, *kept, h, c)
            h, c = hs[-1], cs[-1]
            total[a:b] += (hs[1:] if d == "f" else hs[1:][::-1]) @ w[f"out_{d}"]
    return [total[:n, k] for k, n in enumerate(lengths)]
