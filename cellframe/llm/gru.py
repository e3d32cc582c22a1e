"""A gated recurrent network over word ids with a class-factored output, in NumPy.

    z, r = sigmoid(G[x] + h U),  n = tanh(G[x] + r * (h U)),  h' = (1 - z) n + z h
    p(w | h) = p(class of w | h) * p(w | class, h)

The input table holds each word's share of the three gates, so a step multiplies only the
state. Lanes and tokens run along the last axis inside, so that every operation goes over long
rows. Ids below ``words`` have a class of their own choosing and a softmax inside it; each
later id is a class by itself (its members are told apart outside of the network).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import islice

import numpy as np

#: steps of a window, texts side by side, Adagrad's rate and what its sums of squares start from
WINDOW, LANES, RATE, PAST = 16, 256, 0.1, 1e-5
#: how many times longer windows of few lanes are, and windows that are laid out at a time
LONGER, AHEAD = 16, 16
#: tokens whose class probabilities, and whose gates, are worked on at a time, so that they stay in a core's cache
TOKENS, GATED = 512, 1024


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)
    return x


def _logs(weights: np.ndarray, s: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Log-probability of output ``own`` of each column of ``s``, which ends with a row of ones, as ``weights`` do with the bias."""
    p = weights @ s
    out = p[own, np.arange(len(own))]
    np.exp(p, out=p)
    return out - np.log(p.sum(axis=0))


def _slopes(weights: np.ndarray, s: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the summed loss of ``_logs``: by the weights with the bias, and by each column without its one."""
    p = weights @ s
    np.exp(p, out=p)
    total = p.sum(axis=0)
    p.ravel()[np.arange(len(own)) + len(own) * own.astype(np.int64)] -= total
    # columns are divided by their totals after the products, which are smaller
    return p @ (s / total).T, (weights[:, :-1].T @ p) / total


@dataclass
class Network:
    G: np.ndarray          # (ids, 3 H) input shares of the gates z, r, n
    U: np.ndarray          # (H, 3 H)
    Wc: np.ndarray         # (H, classes)
    bc: np.ndarray
    Wo: np.ndarray         # (words, H), words in the order of their classes
    bo: np.ndarray
    class_of: np.ndarray   # class of each id
    edge: np.ndarray       # words of class c: edge[c]:edge[c + 1], up to the classes of single ids

    @property
    def hidden(self) -> int:
        return self.U.shape[0]

    def parameters(self) -> list[np.ndarray]:
        return [self.G, self.U, self.Wc, self.bc, self.Wo, self.bo]

    def vector(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parameters()])

    def load(self, vector: np.ndarray) -> None:
        at = 0
        for p in self.parameters():
            p[...] = vector[at: at + p.size].reshape(p.shape)
            at += p.size

    def outputs(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of classes and of words, each with the bias as the last column."""
        return np.column_stack([self.Wc.T, self.bc]), np.column_stack([self.Wo, self.bo])

    def classes(self, cut: np.ndarray):
        """(tokens, words) as slices for each class of several words, of tokens in the order of their classes from ``cut`` to ``cut``."""
        for k in range(len(self.edge) - 1):
            if self.edge[k + 1] - self.edge[k] > 1 and cut[k + 1] > cut[k]:
                yield slice(cut[k], cut[k + 1]), slice(self.edge[k], self.edge[k + 1])

    def step(self, h: np.ndarray, x: np.ndarray) -> np.ndarray:
        H, h = self.hidden, h.T
        g, u = np.ascontiguousarray(self.G[x].T), self.U.T @ h
        zr = _sigmoid(g[: 2 * H] + u[: 2 * H])
        n = np.tanh(g[2 * H:] + zr[H:] * u[2 * H:])
        n += zr[:H] * (h - n)
        return n.T

    def log_probability(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log-probability of ids ``y`` after states ``h``."""
        c = self.class_of[y]
        order = np.argsort(c, kind="stable")
        c, y = c[order], y[order]
        s = np.vstack([h.T.take(order, axis=1), np.ones((1, len(y)), h.dtype)])
        of_classes, of_words = self.outputs()
        logs = np.zeros(len(y), np.result_type(s, of_classes))
        for a in range(0, len(y), TOKENS):
            logs[a: a + TOKENS] = _logs(of_classes, s[:, a: a + TOKENS], c[a: a + TOKENS])
        for rows, own in self.classes(np.searchsorted(c, np.arange(len(self.edge)))):
            logs[rows] += _logs(of_words[own], s[:, rows], y[rows] - own.start)
        out = np.empty_like(logs)
        out[order] = logs
        return out


def build(counts: np.ndarray, single: np.ndarray, classes: int, hidden: int, seed: int = 11) -> Network:
    """A network for words of these counts (most frequent first) and the counts of the single-id classes.

    Words are dealt to ``classes`` of about equal counts; biases start at the counts, so an
    untrained network gives about the unigram probabilities.
    """
    rng = np.random.default_rng(seed)
    words = len(counts)
    share = np.cumsum(counts) / max(counts.sum(), 1)
    group = np.minimum(np.floor(np.append(0, share[:-1]) * classes), classes - 1).astype(int) if words else np.zeros(0, int)
    _, group = np.unique(group, return_inverse=True)
    edge = np.searchsorted(group, np.arange((group.max() if words else -1) + 2))
    k = len(edge) - 1
    total = np.concatenate([np.add.reduceat(counts, edge[:-1]) if words else np.zeros(0), single]) + 0.5
    f = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    return Network(f(words + len(single), 3 * hidden), f(hidden, 3 * hidden), f(hidden, k + len(single)) * 0.1, np.log(total / total.sum()).astype(np.float32),
                   f(words, hidden) * 0.1, np.log((counts + 0.5) / max(counts.sum(), 1)).astype(np.float32),
                   np.concatenate([group, k + np.arange(len(single))]).astype(np.min_scalar_type(k + len(single))), edge)


def _windows(texts: Iterable[np.ndarray], start: int, lanes: int, window: int):
    """Windows over texts laid one after the other in ``lanes``: (lanes that go on, x, y, fresh, live), steps by lanes.

    ``x`` is the id before ``y``, ``start`` where a text begins, there ``fresh``. A lane that runs
    short takes the next text, so windows are full until the texts end; then lanes drop out and
    windows of few lanes grow longer, up to ``LONGER`` times. ``AHEAD`` windows are laid out at a time.
    """
    source = (np.asarray(t) for t in texts if len(t))
    queue = []
    for t in islice(source, lanes):
        queue.append([t])
    at = [0] * len(queue)
    short = window
    while queue:
        window = short * min(lanes // len(queue), LONGER)
        room = window * AHEAD
        x, y = np.full((len(queue), room), start, np.int64), np.zeros((len(queue), room), np.int64)
        fresh, n = np.zeros((len(queue), room), bool), np.zeros(len(queue), np.int64)
        for k, (lane, a) in enumerate(zip(queue, at)):
            filled = 0
            while filled < room:
                if a == len(lane[0]):
                    text = next(source, None)
                    if text is None:
                        break
                    lane[0], a = text, 0
                piece = lane[0][a: a + room - filled]
                end = filled + len(piece)
                y[k, filled: end] = piece
                fresh[k, filled] = a == 0
                x[k, filled + (a == 0): end] = lane[0][max(a - 1, 0): a - 1 + len(piece) if a else len(piece) - 1]
                a, filled = a + len(piece), end
            at[k], n[k] = a, filled
        if not n.any():
            return
        left = np.arange(len(queue))
        for a in range(0, n.max(), window):
            on = np.flatnonzero(n[left] > a)
            left = left[on]
            b = min(a + window, n[left].max())
            yield on, x[left, a: b].T, y[left, a: b].T, fresh[left, a: b].T, (np.arange(a, b) < n[left, None]).T
        queue, at = [queue[k] for k in left], [at[k] for k in left]


def _forward(net: Network, h: np.ndarray, x: np.ndarray, fresh: np.ndarray):
    """States before each step of a window, and after it; gates z and r with the state's share of n, and n. Lanes are last, in ``h`` too."""
    H, (steps, lanes) = net.hidden, x.shape
    U, keep, block = np.ascontiguousarray(net.U.T), (~fresh).astype(np.float32), max(GATED // lanes, 1)
    before, after, n = (np.empty((steps, H, lanes), np.float32) for _ in range(3))
    gates = np.empty((steps, 3 * H, lanes), np.float32)
    for t in range(steps):
        if t % block == 0:
            G = np.ascontiguousarray(net.G[x[t: t + block]].transpose(0, 2, 1))
        g = G[t % block]
        np.multiply(h, keep[t], out=before[t])
        u = np.matmul(U, before[t], out=gates[t])
        u[: 2 * H] += g[: 2 * H]
        _sigmoid(u[: 2 * H])
        np.multiply(u[H: 2 * H], u[2 * H:], out=n[t])
        n[t] += g[2 * H:]
        np.tanh(n[t], out=n[t])
        h = np.subtract(before[t], n[t], out=after[t])
        h *= u[:H]
        h += n[t]
    return before, after, gates, n


def _gradients(net: Network, h: np.ndarray, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, live: np.ndarray):
    """The state after a window, and (parameter, touched rows, gradient of the summed loss) for each part of the network.

    The gradient stops at the window's start: truncated backpropagation.
    """
    H, (steps, lanes) = net.hidden, x.shape
    before, after, gates, n = _forward(net, h.T, x, fresh)
    place = np.flatnonzero(live)
    target = y.ravel()[place]
    c = net.class_of[target]
    # tokens in the order of their classes, so that a class is a slice
    order = np.argsort(c, kind="stable")
    place, target, c = place[order], target[order], c[order]
    s = np.ones((H + 1, len(place)), np.float32)
    s[:H] = after.transpose(1, 0, 2).reshape(H, -1).take(place, axis=1)
    of_classes, of_words = net.outputs()
    by_class, by_word, d = np.zeros_like(of_classes), np.zeros_like(of_words), np.empty((H, len(place)), np.float32)
    for a in range(0, len(place), TOKENS):
        part = slice(a, a + TOKENS)
        g, d[:, part] = _slopes(of_classes, s[:, part], c[part])
        by_class += g
    for rows, own in net.classes(np.searchsorted(c, np.arange(len(net.edge)))):
        by_word[own], e = _slopes(of_words[own], s[:, rows], target[rows] - own.start)
        d[:, rows] += e
    parts = [(net.Wc, slice(None), by_class[:, :H].T), (net.bc, slice(None), by_class[:, H]),
             (net.Wo, slice(None), by_word[:, :H]), (net.bo, slice(None), by_word[:, H])]
    out = np.zeros((H, steps * lanes), np.float32)
    out[:, place] = d
    out = np.ascontiguousarray(out.reshape(H, steps, lanes).transpose(1, 0, 2))
    keep, block = (~fresh).astype(np.float32), max(GATED // lanes, 1)
    carry, by_state, by_token = np.zeros((H, lanes), np.float32), np.zeros_like(net.U), np.empty((steps, lanes, 3 * H), np.float32)
    for a in reversed(range(0, steps, block)):
        part = slice(a, min(a + block, steps))
        z, r, share = gates[part, :H], gates[part, H: 2 * H], gates[part, 2 * H:]
        # shares of the three gates in a state's gradient, for all steps of the block at once
        gate = np.empty((part.stop - a, 3, H, lanes), np.float32)
        np.multiply(1 - z, 1 - n[part] * n[part], out=gate[:, 2])
        np.multiply(gate[:, 2], share * r * (1 - r), out=gate[:, 1])
        np.multiply(before[part] - n[part], z * (1 - z), out=gate[:, 0])
        inner = gate.copy()
        inner[:, 2] *= r
        for t in reversed(range(a, part.stop)):
            carry += out[t]
            out[t] = carry
            inner[t - a] *= carry
            carry *= z[t - a]
            carry += net.U @ inner[t - a].reshape(3 * H, lanes)
            carry *= keep[t]
        gate *= out[part, None]
        by_token[part] = gate.reshape(-1, 3 * H, lanes).transpose(0, 2, 1)
        by_state += np.matmul(before[part], inner.reshape(-1, 3 * H, lanes).transpose(0, 2, 1)).sum(axis=0)
    parts.append((net.U, slice(None), by_state))
    ids = x.ravel().astype(np.min_scalar_type(len(net.G)))
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    # two neighbours are added as one complex number, which halves the number of short sums
    by_token = by_token.reshape(-1, 3 * H).view(np.complex64) if H % 2 == 0 else by_token.reshape(-1, 3 * H)
    parts.append((net.G, ids[first], np.add.reduceat(by_token[order], first).view(np.float32)))
    return after[-1].T, parts


def train(net: Network, past: list[np.ndarray], texts: Iterable[np.ndarray], start: int, *, window: int = WINDOW, lanes: int = LANES, rate: float = RATE) -> int:
    """One pass of Adagrad over every id of every text; the number of ids. ``past`` holds the sums of squares and goes on.

    The state is carried from window to window through each whole text, from zero and after
    ``start``. A window makes one step, smaller where the last texts leave lanes empty.
    """
    squares = {id(p): s for p, s in zip(net.parameters(), past)}
    scale, total, h = np.float32(1 / (window * lanes)), 0, np.zeros((lanes, net.hidden), np.float32)
    for on, x, y, fresh, live in _windows(texts, start, lanes, window):
        h, parts = _gradients(net, h[on], x, y, fresh, live)
        for p, rows, g in parts:
            g = g * scale
            s = squares[id(p)]
            s[rows] += g * g
            g *= np.float32(rate)
            g /= np.sqrt(s[rows])
            p[rows] -= g
        total += int(live.sum())
    return total


def score(net: Network, ids: list[np.ndarray], start: int, *, window: int = 32, width: int = 1024) -> np.ndarray:
    """Natural log-probability of each whole sequence; the state is carried from window to window.

    Sequences go side by side, the longest first, so the running ones are always the first rows.
    """
    out = np.zeros(len(ids))
    length = np.array([len(s) for s in ids], np.int64)
    order = np.argsort(-length, kind="stable")
    for k in range(0, len(order), width):
        rows = order[k: k + width]
        n = length[rows]
        flat, at = np.concatenate([ids[row] for row in rows]).astype(np.int64), np.cumsum(n) - n
        h = np.zeros((net.hidden, len(rows)), np.float32)
        last = np.full(len(rows), start, np.int64)
        for t in range(0, int(n[0]), window):
            running = int(np.searchsorted(-n, -t, side="left"))
            states, targets, owners = [], [], []
            for s in range(t, min(t + window, int(n[0]))):
                live = int(np.searchsorted(-n[:running], -s, side="left"))
                states.append(net.step(h[:, :live].T, last[:live]).T)
                h[:, :live] = states[-1]
                last[:live] = flat[at[:live] + s]
                targets.append(last[:live].copy())
                owners.append(np.arange(live))
            logs = net.log_probability(np.concatenate(states, axis=1).T, np.concatenate(targets))
            out[rows[:running]] += np.bincount(np.concatenate(owners), weights=logs, minlength=running)
    return out
