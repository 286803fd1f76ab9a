"""A gated recurrent network over units of words, with a class-factored softmax, in numpy.

Each token is a unit (a frequent word, or all words of one ending). The unit before is embedded and enters the gates;
the hidden state predicts the next unit's class, then, within the class, its slot: P = P(class | h) P(slot | class, h).
Texts run in lanes, one after another, the state set to zero before each text and carried from window to window.
Training backpropagates within windows (truncated).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

HIDDEN, EMBEDDED = 16, 16  # at 24 hidden units, scores are 0.01 higher a token (log10) and cost a quarter more
WINDOW = 16
SCORE_WINDOW, SCORE_LANES = 32, 512
SETTLED = 1 << 16  # tokens of one softmax when scoring
RATE = 0.02
CLIP = 1.0
WARM = 32  # updates until the full rate (an eighth of all at most), as Adam's means begin empty in each pass
SAFE = 80.0  # exp of this is a float32


@dataclass
class Lanes:
    """Tokens in the order of lanes, the longest lane first. Only a window at a time becomes a matrix of steps x lanes."""

    unit: np.ndarray
    text: np.ndarray
    begins: np.ndarray  # whether a token is its text's first
    start: np.ndarray  # of each lane
    length: np.ndarray
    texts: int

    def windows(self, size: int, begin: int) -> Iterator[tuple[np.ndarray, ...]]:
        """given (the unit before, or ``begin`` at a text's begin), unit, text and begins of steps x lanes, and which are no padding."""
        for s in range(0, int(self.length[0]) if len(self.length) else 0, size):
            live = int(np.searchsorted(-self.length, -s, "left"))  # lanes longer than s
            steps = np.arange(s, min(s + size, int(self.length[0])))[:, None]
            real = steps < self.length[:live]
            at = self.start[:live] + np.where(real, steps, 0)
            begins = self.begins[at] & real
            given = self.unit[np.maximum(at - 1, 0)]
            given[begins | ~real] = begin
            yield given, self.unit[at], self.text[at], begins, real


def lay_out(unit: np.ndarray, ends: np.ndarray, lanes: int) -> Lanes:
    """``ends``: where each text's tokens end; no text is empty. Texts go to the lane with the least so far, long ones first."""
    begin = np.append(0, ends[:-1])
    n = ends - begin
    lanes = max(1, min(lanes, len(n)))
    heap, load, lane = [(0, k) for k in range(lanes)], np.zeros(lanes, np.int64), np.zeros(len(n), np.int64)
    order = np.argsort(-n, kind="stable")
    for i in order.tolist():
        used, k = heapq.heappop(heap)
        lane[i], load[k] = k, used + int(n[i])
        heapq.heappush(heap, (int(load[k]), k))
    rank = np.argsort(-load, kind="stable")
    place = np.empty(lanes, np.int64)
    place[rank] = np.arange(lanes)
    order = order[np.argsort(place[lane[order]], kind="stable")]
    size = n[order]
    heads = np.cumsum(size) - size
    at = np.arange(int(size.sum())) + np.repeat(begin[order] - heads, size)
    begins = np.zeros(len(at), bool)
    begins[heads] = True
    length = load[rank]
    return Lanes(unit[at].astype(np.int16), np.repeat(order, size).astype(np.int32), begins, np.cumsum(length) - length, length, len(n))


class Network:
    """Parameters by name in one flat vector, so that they can be averaged and sent about.

    ``cls`` and ``slot`` give each unit's class and slot in it. The last row of ``enter``, ``out`` and ``slots`` is a bias.
    """

    def __init__(self, cls: np.ndarray, slot: np.ndarray, slots: np.ndarray, hidden: int = HIDDEN, embedded: int = EMBEDDED, flat: np.ndarray | None = None):
        self.cls, self.sizes, self.hidden = np.asarray(cls, np.int16), np.asarray(slots, np.int64), hidden
        self.first = np.append(0, np.cumsum(self.sizes))
        self.slot, self.column = np.asarray(slot, np.int64), self.first[self.cls] + slot
        self.begin = len(self.cls)
        c, h, s = len(self.sizes), hidden, int(self.first[-1])
        self.shapes = {"embed": (self.begin + 1, embedded), "enter": (embedded + 1, 3 * h), "gates": (h, 2 * h), "inner": (h, h), "out": (h + 1, c), "slots": (h + 1, s)}
        size = sum(a * b for a, b in self.shapes.values())
        self.flat = np.zeros(size, np.float32) if flat is None else np.array(flat, np.float32)
        self.views = self._views(self.flat)

    def _views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, (a, b) in self.shapes.items():
            out[name] = flat[at : at + a * b].reshape(a, b)
            at += a * b
        return out

    def start(self, slot_counts: list[np.ndarray], seed: int = 5) -> Network:
        """Small random weights, and biases that give the classes and slots their shares."""
        draw, v = np.random.default_rng(seed), self.views
        for name, scale in (("embed", 0.3), ("enter", 0.3), ("gates", 0.3), ("inner", 0.3), ("out", 0.01), ("slots", 0.01)):
            v[name][...] = draw.normal(0, scale, self.shapes[name])
        v["enter"][-1] = 0
        total = np.array([x.sum() for x in slot_counts]) + 1e-3
        v["out"][-1] = np.log(total / total.sum())
        v["slots"][-1] = np.concatenate([np.log((x + 1e-3) / (x + 1e-3).sum()) for x in slot_counts])
        return self

    def _entering(self) -> tuple[np.ndarray, np.ndarray]:
        """What each unit sends to the gates, and the gates' own weights, halved for tanh in place of the logistic function."""
        v, n = self.views, self.hidden
        entering = v["embed"] @ v["enter"][:-1] + v["enter"][-1]
        entering[:, : 2 * n] *= 0.5
        return entering, v["gates"] * np.float32(0.5)

    def _steps(self, x: np.ndarray, begins: np.ndarray, h: np.ndarray, gates: np.ndarray, kept: tuple | None = None) -> np.ndarray:
        """The states after each step, with a column of ones; ``kept`` gets the states before, both gates and the candidates."""
        inner, n = self.views["inner"], self.hidden
        out = np.empty((*begins.shape, n + 1), np.float32)
        out[:, :, n] = 1
        fresh = begins.any(axis=1)
        a, c, half = np.empty((h.shape[0], 2 * n), np.float32), np.empty_like(h), np.float32(0.5)
        for s in range(len(begins)):
            if fresh[s]:
                h = np.where(begins[s][:, None], np.float32(0), h)
            np.matmul(h, gates, out=a)
            a += x[s, :, : 2 * n]
            np.tanh(a, out=a)
            a *= half
            a += half
            z, r = a[:, :n], a[:, n:]
            np.matmul(r * h, inner, out=c)
            c += x[s, :, 2 * n :]
            np.tanh(c, out=c)
            if kept is not None:
                kept[0][s], kept[1][s], kept[2][s] = h, a, c
            new = c - h
            new *= z
            new += h
            out[s, :, :n] = h = new
        return out

    def _safe(self, name: str) -> bool:
        """Whether no logit can overflow: states lie between -1 and 1."""
        return bool(np.abs(self.views[name]).sum(axis=0).max() < SAFE)

    def _logs(self, states: np.ndarray, units: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of each unit, and with ``grads`` the gradient (of minus their sum) for the states."""
        v, n = self.views, len(states)
        cls, column = self.cls[units], self.column[units]
        row = np.arange(n)

        def softmax(o: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray]:
            """o becomes its exp; the row sums, and what was subtracted first."""
            top = np.float32(0)
            if not safe:
                top = o.max(axis=1)
                o -= top[:, None]
            np.exp(o, out=o)
            return o @ np.ones(o.shape[1], np.float32), top

        o = states @ v["out"]
        logs = o[row, cls]
        total, top = softmax(o, self._safe("out"))
        logs -= np.log(total) + top
        back = None
        if grads is not None:
            o *= (1 / total)[:, None]
            o[row, cls] -= 1
            grads["out"] += states.T @ o
            back = o @ v["out"][:-1].T
        order = np.argsort(cls, kind="stable")
        cuts = np.append(0, np.cumsum(np.bincount(cls, minlength=len(self.sizes))))
        mine, at, slot = states[order], column[order], self.slot[units][order]
        within = np.einsum("ij,ij->i", mine, np.ascontiguousarray(v["slots"].T)[at])
        safe, hidden_back = self._safe("slots"), None if back is None else np.zeros_like(back)
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            own, span = slice(cuts[k], cuts[k + 1]), slice(self.first[k], self.first[k + 1])
            o = mine[own] @ v["slots"][:, span]
            total, top = softmax(o, safe)
            within[own] -= np.log(total) + top
            if grads is not None:
                o *= (1 / total)[:, None]
                o[row[: len(o)], slot[own]] -= 1
                grads["slots"][:, span] += mine[own].T @ o
                hidden_back[own] = o @ v["slots"][:-1, span].T
        logs[order] += within
        if back is not None:
            back[order] += hidden_back
        return logs, back

    def score(self, lanes: Lanes, window: int | None = None) -> np.ndarray:
        """The natural log probability of each text."""
        out, h = np.zeros(lanes.texts), None
        entering, gates = self._entering()
        met: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # states, units and texts whose softmax is still to come

        def settle() -> None:
            nonlocal out
            if met:
                states, units, texts = (np.concatenate(x) for x in zip(*met))
                out += np.bincount(texts, weights=self._logs(states, units)[0], minlength=len(out))
                met.clear()

        for given, unit, text, begins, real in lanes.windows(window or SCORE_WINDOW, self.begin):
            h = np.zeros((given.shape[1], self.hidden), np.float32) if h is None else h[: given.shape[1]]
            states = self._steps(entering[given], begins, h, gates)
            h = states[-1, :, :-1]
            some = slice(None) if real.all() else np.flatnonzero(real.ravel())
            met.append((states.reshape(-1, self.hidden + 1)[some], unit.ravel()[some], text.ravel()[some]))
            if sum(len(x[1]) for x in met) >= SETTLED:
                settle()
        settle()
        return out

    def gradient(self, given: np.ndarray, unit: np.ndarray, begins: np.ndarray, real: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log probabilities of a window's tokens, the flat gradient of minus their sum, and the states after it, from the states ``h``."""
        n, shape = self.hidden, (*given.shape, self.hidden)
        entering, gates = self._entering()
        kept = (np.empty(shape, np.float32), np.empty((*given.shape, 2 * n), np.float32), np.empty(shape, np.float32))
        states = self._steps(entering[given], begins, h, gates, kept)
        flat = np.zeros_like(self.flat)
        g = self._views(flat)
        back = np.zeros((given.size, n), np.float32)
        some = slice(None) if real.all() else np.flatnonzero(real.ravel())
        logs, back[some] = self._logs(states.reshape(-1, n + 1)[some], unit.ravel()[some], g)
        self._through_time(g, given, begins, back.reshape(shape), kept)
        return logs, flat, states[-1, :, :-1]

    def train(self, lanes: Lanes, rate: float = RATE, window: int | None = None) -> float:
        """One pass with Adam, an update for each window; the mean log probability of the tokens as they were met."""
        mean, square, updates, h = np.zeros_like(self.flat), np.zeros_like(self.flat), 0, None
        met, seen, most, window = 0.0, 0, 0, window or WINDOW
        warm = min(WARM, 1 + int(lanes.length[0]) // window // 8) if len(lanes.length) else 1
        for given, unit, _, begins, real in lanes.windows(window, self.begin):
            h = np.zeros((given.shape[1], self.hidden), np.float32) if h is None else h[: given.shape[1]]
            logs, flat, h = self.gradient(given, unit, begins, real, h)
            flat *= np.float32(1 / len(logs))
            norm = float(np.sqrt(flat @ flat))
            if norm > CLIP:
                flat *= np.float32(CLIP / norm)
            updates, met, seen, most = updates + 1, met + float(logs.sum()), seen + len(logs), max(most, len(logs))
            mean *= np.float32(0.9)
            mean += np.float32(0.1) * flat
            square *= np.float32(0.99)
            flat *= flat
            square += np.float32(0.01) * flat
            step = np.sqrt(square)
            step *= np.float32(1 / np.sqrt(1 - 0.99**updates))
            step += np.float32(1e-6)
            np.divide(mean, step, out=step)
            # A window of few lanes, as at the end, moves the weights less.
            step *= np.float32(rate * min(1, updates / warm) * len(logs) / most / (1 - 0.9**updates))
            self.flat -= step
        return met / max(1, seen)

    def _through_time(self, g: dict, given: np.ndarray, begins: np.ndarray, back: np.ndarray, kept: tuple) -> None:
        """Gradients of all that stands before the states, by backpropagation through one window."""
        v, n = self.views, self.hidden
        before, both, candidate = kept
        turned, inner = v["gates"].T.copy(), v["inner"].T.copy()
        dx, after = np.empty((*given.shape, 3 * n), np.float32), np.zeros(back.shape[1:], np.float32)
        slope = both * (1 - both)
        slope[:, :, :n] *= candidate - before
        slope[:, :, n:] *= before
        open_candidate = both[:, :, :n] * (1 - candidate * candidate)
        fresh = begins.any(axis=1)
        for t in range(len(given) - 1, -1, -1):
            dh = back[t]
            dh += after
            da, dc = dx[t, :, : 2 * n], dx[t, :, 2 * n :]
            np.multiply(dh, open_candidate[t], out=dc)
            reset = dc @ inner
            np.multiply(dh, slope[t, :, :n], out=da[:, :n])
            np.multiply(reset, slope[t, :, n:], out=da[:, n:])
            after = da @ turned
            after += dh
            after -= dh * both[t, :, :n]
            reset *= both[t, :, n:]
            after += reset
            if fresh[t]:
                after[begins[t]] = 0
        flat = dx.reshape(-1, 3 * n)
        g["gates"] += before.reshape(-1, n).T @ flat[:, : 2 * n]
        g["inner"] += (both[:, :, n:] * before).reshape(-1, n).T @ flat[:, 2 * n :]
        order = np.argsort(given.ravel(), kind="stable")
        units = given.ravel()[order]
        first = np.flatnonzero(np.append(True, units[1:] != units[:-1]))
        by_unit, units = np.add.reduceat(flat[order], first, axis=0), units[first]
        g["enter"][:-1] += v["embed"][units].T @ by_unit
        g["enter"][-1] += by_unit.sum(axis=0)
        g["embed"][units] += by_unit @ v["enter"][:-1].T
