"""A gated recurrent language model in numpy with a class-factored output softmax.

A token's probability is that of its class, given the state, times that of the token in its class.
Frequent tokens share frequency-binned classes with a softmax of their own. All other tokens, also
those never seen, fall into classes by their ending; inside those the corpus counts decide:
(count + 1) / (tokens of the class + distinct tokens of the class + 1).
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

from stayrate.llm.tokens import coded, split_words

#: Sizes of the model: frequent tokens, their classes, classes by ending, embedding and state.
HEAD = 4096
HEAD_CLASSES = 48
TAIL_CLASSES = 32
WIDTH = 16
#: Texts read side by side in learning and in scoring (which gives the same scores at any number), and steps of a window.
LANES = 256
SCORED_LANES = 768
STEPS = 32
END = ""


def tail_class(word: str) -> int:
    return zlib.crc32(word[-2:].encode("utf-8", "surrogatepass")) % TAIL_CLASSES


@dataclass
class Vocabulary:
    """The most frequent tokens with counts, of which the first ``head`` are in the softmax, and totals of the rest."""

    words: list[str]
    counts: np.ndarray
    head: int
    tail_tokens: np.ndarray
    tail_words: np.ndarray
    n: int
    v: int

    def __post_init__(self) -> None:
        self.ids = {w: i for i, w in enumerate(self.words)}
        roots = np.sqrt(np.maximum(self.counts[: self.head], 1))
        bins = (np.cumsum(roots) - roots) / max(roots.sum(), 1e-9) * HEAD_CLASSES
        self.bounds = np.searchsorted(bins, np.arange(HEAD_CLASSES + 1))
        self.bounds[-1] = self.head
        classes = np.repeat(np.arange(HEAD_CLASSES), np.diff(self.bounds))
        tails = np.fromiter((HEAD_CLASSES + tail_class(w) for w in self.words[self.head :]), np.int64)
        self.classes = np.concatenate([classes, tails]).astype(np.int64)
        self.tail_logs = np.log10(self.tail_tokens + self.tail_words + 1.0)
        self.logs = np.log10(self.counts + 1.0)


class Net:
    """Parameters as views into one vector, so that models can be averaged."""

    def __init__(self, head: int, vector: np.ndarray | None = None) -> None:
        c, k, h = HEAD_CLASSES + TAIL_CLASSES, head, WIDTH
        shapes = {
            "E": (k + TAIL_CLASSES, h), "Wx": (h, 3 * h), "Wh": (h, 3 * h), "b": (3 * h,), "Wc": (h, c), "bc": (c,), "Wo": (k, h), "bo": (k,),
        }
        size = sum(int(np.prod(s)) for s in shapes.values())
        self.vector = np.zeros(size, np.float32) if vector is None else vector
        at = 0
        for name, shape in shapes.items():
            n = int(np.prod(shape))
            setattr(self, name, self.vector[at : at + n].reshape(shape))
            at += n

    @classmethod
    def start(cls, v: Vocabulary, seed: int = 11) -> Net:
        """Random weights; the biases are those of the corpus counts."""
        net, rng = cls(v.head), np.random.default_rng(seed)
        for name, scale in (("E", 0.5), ("Wx", 0.3), ("Wh", 0.3), ("Wc", 0.05), ("Wo", 0.05)):
            w = getattr(net, name)
            w[...] = rng.standard_normal(w.shape) * scale
        mass = np.array([v.counts[a:b].sum() for a, b in zip(v.bounds, v.bounds[1:])])
        # every tail class can also hold words never seen
        net.bc[...] = np.log(np.concatenate([mass + (mass > 0) * 1e-3, v.tail_tokens + v.tail_words + 1.0]) + 1e-6)
        for a, b in zip(v.bounds, v.bounds[1:]):
            if b > a:
                net.bo[a:b] = np.log(v.counts[a:b] / v.counts[a:b].sum())
        return net


def _steep(weights: np.ndarray, biases: np.ndarray) -> bool:
    """Whether a score could be too large for its exponential. States lie between -1 and 1, which bounds all scores."""
    return len(biases) > 0 and float((np.abs(weights).sum(axis=1) + np.abs(biases)).max()) > 60


class Text:
    """A text as model inputs: previous token, class, place among the frequent tokens (-1 for others)."""

    __slots__ = ("key", "x", "c", "w", "at", "score", "rare", "logs", "rest")

    def __init__(self, key: object, x: np.ndarray, c: np.ndarray, w: np.ndarray, rare: list[str], logs: float, rest: float) -> None:
        self.key, self.x, self.c, self.w, self.rare, self.logs, self.rest = key, x, c, w, rare, logs, rest
        self.at, self.score = 0, 0.0


def texts_of(v: Vocabulary, keys: Iterable[object], column: object) -> Iterator[Text]:
    """Texts of an Arrow column of strings in which A-Z are lower-cased already.

    ``logs`` sums log10(count + 1) over tokens with a count at hand, ``rest`` what the counts inside
    the tail classes give; tokens without a count at hand are in ``rare``.
    """
    tokens, starts = split_words(column)
    distinct, codes = coded(tokens)
    ids = np.fromiter((v.ids.get(w, -1) for w in distinct), np.int64, len(distinct))
    classes = np.where(ids >= 0, v.classes[ids] if len(v.words) else 0, 0)
    unknown = np.flatnonzero(ids < 0)
    classes[unknown] = [HEAD_CLASSES + tail_class(distinct[i]) for i in unknown]
    frequent = np.where((ids >= 0) & (ids < v.head), ids, -1)
    inputs = np.where(frequent >= 0, frequent, v.head + classes - HEAD_CLASSES)
    logs = np.where(ids >= 0, v.logs[ids] if len(v.words) else 0.0, 0.0)
    rest = np.where(frequent >= 0, 0.0, logs - np.append(np.zeros(HEAD_CLASSES), v.tail_logs)[classes])
    names = np.array(distinct, dtype=object)
    end = v.ids.get(END, -1)
    end_class = v.classes[end] if end >= 0 else HEAD_CLASSES + tail_class(END)
    end_word = end if 0 <= end < v.head else -1
    end_input = end_word if end_word >= 0 else v.head + end_class - HEAD_CLASSES
    end_logs = v.logs[end] if end >= 0 else 0.0
    end_rest = 0.0 if end_word >= 0 else end_logs - v.tail_logs[end_class - HEAD_CLASSES]
    for key, a, b in zip(keys, starts, starts[1:]):
        own = codes[a:b]
        yield Text(
            key,
            np.concatenate([[end_input], inputs[own]]),
            np.append(classes[own], end_class),
            np.append(frequent[own], end_word),
            names[own[ids[own] < 0]].tolist(),
            float(logs[own].sum() + end_logs),
            float(rest[own].sum() + end_rest),
        )


class Reader:
    """Reads texts side by side in windows. A lane goes on with the next text where one ends; its state starts anew there."""

    def __init__(self, v: Vocabulary, net: Net, rate: float = 0.0) -> None:
        self.v, self.net, self.rate = v, net, rate
        self.queue: deque[Text] = deque()
        self.width = LANES if rate else SCORED_LANES
        self.lanes: list[Text | None] = [None] * self.width
        self.state = np.zeros((self.width, WIDTH), np.float32)
        self.mean, self.squares, self.steps = np.zeros_like(net.vector), np.zeros_like(net.vector), 0
        self.seen = 0

    def add(self, text: Text) -> Iterator[Text]:
        self.queue.append(text)
        self.seen += len(text.c)
        while len(self.queue) >= self.width:
            yield from self._window()

    def finish(self) -> Iterator[Text]:
        while self.queue or any(self.lanes):
            yield from self._window()

    def _window(self) -> list[Text]:
        x = np.zeros((STEPS, self.width), np.int64)
        c = np.zeros((STEPS, self.width), np.int64)
        w = np.full((STEPS, self.width), -1, np.int64)
        used = np.zeros((STEPS, self.width), bool)
        keep = np.ones((STEPS, self.width, 1), np.float32)
        parts, ended = [], []
        busy = 0
        for lane in range(self.width):
            t = 0
            while t < STEPS:
                text = self.lanes[lane]
                if text is None:
                    if not self.queue:
                        break
                    text = self.lanes[lane] = self.queue.popleft()
                    keep[t, lane] = 0
                n = min(STEPS - t, len(text.c) - text.at)
                src = slice(text.at, text.at + n)
                x[t : t + n, lane], c[t : t + n, lane], w[t : t + n, lane] = text.x[src], text.c[src], text.w[src]
                used[t : t + n, lane] = True
                parts.append((text, lane, t, t + n))
                text.at += n
                t += n
                if text.at == len(text.c):
                    ended.append(text)
                    self.lanes[lane] = None
            if t:
                busy = lane + 1
        if busy < self.width:
            x, c, w, used, keep = x[:, :busy], c[:, :busy], w[:, :busy], used[:, :busy], keep[:, :busy]
        logs = self._run(x, c, w, used, keep)
        if self.rate == 0:
            upto = np.concatenate([np.zeros((1, busy)), np.cumsum(logs, axis=0, dtype=np.float64)])
            for text, lane, a, b in parts:
                text.score += upto[b, lane] - upto[a, lane]
        # busy lanes move to the front, so that the last texts are read in narrow windows
        order = sorted(range(self.width), key=lambda i: self.lanes[i] is None)
        self.lanes = [self.lanes[i] for i in order]
        self.state = self.state[order]
        return ended

    def _run(self, x: np.ndarray, c: np.ndarray, w: np.ndarray, used: np.ndarray, keep: np.ndarray) -> np.ndarray:
        """Natural log of each token's class probability, times that inside the class for frequent tokens.

        Scores lie with one row per class or token, so that sums and maxima run along the texts.
        """
        net, v, h = self.net, self.v, WIDTH
        steps, lanes = x.shape
        inputs = net.E.take(x, axis=0)
        gates = inputs @ net.Wx
        gates += net.b
        state = self.state[:lanes]
        states, before, ns, hn = (np.empty((steps, lanes, h), np.float32) for _ in range(4))
        zrs = np.empty((steps, lanes, 2 * h), np.float32)
        for t in range(steps):
            state = before[t] = state * keep[t]
            a = state @ net.Wh
            zr = zrs[t]
            np.add(gates[t, :, : 2 * h], a[:, : 2 * h], out=zr)
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            hn[t] = a[:, 2 * h :]
            n = ns[t]
            np.multiply(zr[:, h:], hn[t], out=n)
            n += gates[t, :, 2 * h :]
            np.tanh(n, out=n)
            state = n + zr[:, :h] * (state - n)
            states[t] = state
        self.state[:lanes] = state

        flat = states.reshape(-1, h)
        fc, fw, fu = c.ravel(), w.ravel(), used.ravel()
        e = net.Wc.T @ flat.T
        e += net.bc[:, None]
        if _steep(net.Wc.T, net.bc):
            e -= e.max(axis=0)
        rows = np.arange(len(flat))
        logs = e[fc, rows].astype(np.float64)
        np.exp(e, out=e)
        total = e.sum(axis=0)
        logs -= np.log(total)
        scale = np.float32(1.0 / max(1, int(fu.sum())))
        if self.rate:
            grad = Net(v.head)
            e /= total
            e[fc, rows] -= 1
            e *= fu * scale
            grad.Wc[...] = (e @ flat).T
            grad.bc[...] = e.sum(axis=1)
            down = e.T @ net.Wc.T
        # the frequent tokens, class by class
        steep = _steep(net.Wo, net.bo)
        order = np.flatnonzero(fw >= 0)
        order = order[np.argsort(fc[order].astype(np.int16), kind="stable")]
        cuts = np.searchsorted(fc[order], np.arange(HEAD_CLASSES + 1))
        sorted_flat, places, inside = flat[order], fw[order], np.empty(len(order))
        sent = np.empty((len(order), h), np.float32) if self.rate else None
        for k in range(HEAD_CLASSES):
            a, b = v.bounds[k], v.bounds[k + 1]
            lo, hi = cuts[k], cuts[k + 1]
            if lo == hi or b <= a:
                continue
            mine, place, at = sorted_flat[lo:hi], places[lo:hi] - a, np.arange(hi - lo)
            p = net.Wo[a:b] @ mine.T
            p += net.bo[a:b, None]
            if steep:
                p -= p.max(axis=0)
            picked = p[place, at]
            np.exp(p, out=p)
            sums = p.sum(axis=0)
            inside[lo:hi] = picked - np.log(sums)
            if self.rate:
                p /= sums
                p[place, at] -= 1
                p *= scale
                grad.Wo[a:b] = p @ mine
                grad.bo[a:b] = p.sum(axis=1)
                sent[lo:hi] = p.T @ net.Wo[a:b]
        logs[order] += inside
        if self.rate:
            down[order] += sent
            self._learn(grad, down.reshape(steps, lanes, h), x, inputs, before, zrs, ns, hn, keep)
        return np.where(used, logs.reshape(steps, lanes), 0.0)

    def _learn(self, grad: Net, down: np.ndarray, x: np.ndarray, inputs: np.ndarray, before, zrs, ns, hn, keep) -> None:
        """Back through the window, whose first state is taken as given; then one step of Adam."""
        net, h = self.net, WIDTH
        steps, lanes = x.shape
        zs, rs = zrs[:, :, :h], zrs[:, :, h:]
        # what does not depend on the steps after
        of_z = (before - ns) * zs * (1 - zs)
        of_n = (1 - zs) * (1 - ns * ns)
        of_r = hn * rs * (1 - rs)
        back = np.zeros((lanes, h), np.float32)
        gates = np.empty((steps, lanes, 3 * h), np.float32)
        to_state = np.empty_like(gates)
        to_before = np.ascontiguousarray(net.Wh.T)
        for t in range(steps - 1, -1, -1):
            d = back + down[t]
            dn = d * of_n[t]
            g, s = gates[t], to_state[t]
            np.multiply(d, of_z[t], out=g[:, :h])
            np.multiply(dn, of_r[t], out=g[:, h : 2 * h])
            g[:, 2 * h :] = dn
            s[:, : 2 * h] = g[:, : 2 * h]
            np.multiply(dn, rs[t], out=s[:, 2 * h :])
            back = s @ to_before
            back += d * zs[t]
            back *= keep[t]
        flat = gates.reshape(-1, 3 * h)
        grad.Wh[...] = before.reshape(-1, h).T @ to_state.reshape(-1, 3 * h)
        grad.b[...] = flat.sum(axis=0)
        grad.Wx[...] = inputs.reshape(-1, h).T @ flat
        rows = x.ravel()
        order = np.argsort(rows.astype(np.uint16) if len(net.E) <= 65_536 else rows, kind="stable")
        first = np.flatnonzero(np.diff(rows[order], prepend=-1))
        grad.E[rows[order][first]] = np.add.reduceat((flat @ net.Wx.T)[order], first, axis=0)
        g = grad.vector
        norm = float(np.sqrt(np.dot(g, g)))
        if norm > 1:
            g /= norm
        self.steps += 1
        self.mean *= 0.9
        self.squares *= 0.99
        self.squares += np.float32(0.01) * g * g
        g *= 0.1
        self.mean += g
        size = np.sqrt(np.multiply(self.squares, np.float32(1 / (1 - 0.99**self.steps)), out=g), out=g)
        size += 1e-6
        np.divide(self.mean, size, out=size)
        size *= self.rate / (1 - 0.9**self.steps)
        net.vector -= size
