"""Gradient-boosted oblivious trees with logistic loss over binned features, in numpy.

`fit` takes all rows as arrays. `fit_parts` is run by the tasks of a barrier stage at once, each of which has its own rows
in a file: for every tree some tasks propose the splits that are best for some of their rows (tasks and rows take turns, every
row at least once), and the gain over all rows decides between the proposals and gives the values of the leaves. Sums are of
whole numbers, so they don't depend on an order. Rows must go to tasks by hash: a split that shows only between the rows of
several tasks isn't proposed.
"""

from __future__ import annotations

import os
import socket
import tempfile
from collections.abc import Callable, Iterable

import numpy as np

#: Rows of a part that are read and searched at a time.
BLOCK = 32_768
#: Gradients are rounded to this part of one, so that their sums are exact.
UNIT = 2.0**-20
#: Tasks that propose splits for a tree; more if there are more tasks than PROPOSALS a tree.
PROPOSALS = 3


def codes(x: np.ndarray) -> np.ndarray:
    """Numbers as 16 bits of the same order: sign, exponent and the first seven bits, so whole numbers below 256 are exact."""
    u = (np.asarray(x, np.float32) + np.float32(0)).view(np.uint32)
    return (np.where(u >> 31, ~u, u | np.uint32(2**31)) >> 16).astype(np.uint16)


def greatest(code: np.ndarray) -> np.ndarray:
    """The greatest number of each code."""
    u = (code.astype(np.uint32) << 16) | np.uint32(0xFFFF)
    return np.where(u >> 31, u & np.uint32(2**31 - 1), ~u).astype(np.uint32).view(np.float32)


class Part:
    """Binned rows and labels of one task, in blocks of a file that is gone when it is closed."""

    def __init__(self, features: int):
        self.features, self.file, self.sizes, self.waiting = features, tempfile.TemporaryFile(), [], []
        self.labels: list[np.ndarray] = []

    def add(self, bins: np.ndarray, y: np.ndarray) -> None:
        """bins: features x rows."""
        self.waiting.append(bins)
        self.labels.append(y.astype(np.uint8))
        if sum(b.shape[1] for b in self.waiting) >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            block = np.concatenate(self.waiting, axis=1)
            self.file.write(block.tobytes())
            self.sizes.append(block.shape[1])
            self.waiting = []

    def done(self) -> Part:
        self.flush()
        self.file.flush()
        self.y = np.concatenate(self.labels) if self.labels else np.zeros(0, np.uint8)
        self.start = np.r_[0, np.cumsum(self.sizes, dtype=np.int64)]
        return self

    def rows(self, i: int) -> slice:
        return slice(int(self.start[i]), int(self.start[i + 1]))

    def bins(self, i: int, features: Iterable[int]) -> dict[int, np.ndarray]:
        n = self.sizes[i]
        return {f: np.frombuffer(os.pread(self.file.fileno(), n, int(self.start[i]) * self.features + f * n), np.uint8) for f in set(features)}


class Circle:
    """Connections of a barrier stage's tasks through the first of them; a call gives every task the messages of all, in order.

    BarrierTaskContext.allGather waits a second each time, so it only tells where the first task listens, and a word that others must know.
    """

    WAIT = 3600

    def __init__(self, task):
        self.me, infos = task.partitionId(), task.getTaskInfos()
        self.n, self.peers = len(infos), []
        listening = None
        if not self.me:
            listening = socket.create_server((infos[0].address.rsplit(":", 1)[0], 0), backlog=self.n)
            listening.settimeout(self.WAIT)
        told = task.allGather(f"{listening.getsockname()[0]} {listening.getsockname()[1]} {os.urandom(16).hex()}" if listening else "")
        host, port, word = told[0].split(" ")
        if listening:
            self.peers = [None] * (self.n - 1)
            while None in self.peers:
                c, _ = listening.accept()
                c.settimeout(self.WAIT)
                head = self.exactly(c, 36)
                if head[:32] == word.encode():
                    self.peers[int.from_bytes(head[32:], "little") - 1] = c
            listening.close()
        else:
            self.peers = [socket.create_connection((host, int(port)), self.WAIT)]
            self.peers[0].sendall(word.encode() + self.me.to_bytes(4, "little"))
        for c in self.peers:
            c.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    @staticmethod
    def exactly(c: socket.socket, n: int) -> bytes:
        out = bytearray()
        while len(out) < n:
            got = c.recv(min(n - len(out), 1 << 20))
            if not got:
                raise ConnectionError("a task of the stage has ended")
            out += got
        return bytes(out)

    def send(self, c: socket.socket, m: bytes) -> None:
        c.sendall(len(m).to_bytes(8, "little") + m)

    def receive(self, c: socket.socket) -> bytes:
        return self.exactly(c, int.from_bytes(self.exactly(c, 8), "little"))

    def __call__(self, m: bytes) -> list[bytes]:
        if self.me:
            self.send(self.peers[0], m)
            return [self.receive(self.peers[0]) for _ in range(self.n)]
        out = [m, *map(self.receive, self.peers)]
        for c in self.peers:
            for x in out:
                self.send(c, x)
        return out

    def close(self) -> None:
        for c in self.peers:
            c.close()


class BoostedTrees:
    """All nodes of a tree's level share one split, so a row's leaf is a number of as many bits as levels."""

    def __init__(self, trees: int = 120, depth: int = 5, rate: float = 0.15, bins: int = 48, ridge: float = 2.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge

    def binned(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for f, e in enumerate(self.edges):
            out[:, f] = np.searchsorted(e, x[:, f], side="left")
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        w = np.ones(len(y)) if weight is None else weight
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins)[1:-1])) for f in range(x.shape[1])] if len(y) else [np.zeros(0)] * x.shape[1]
        b = self.binned(x)
        p0 = np.clip((w * y).sum() / max(w.sum(), 1e-9), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(p0 / (1 - p0)))
        self.feature = np.zeros((0, self.depth), np.int64)
        self.cut = np.zeros((0, self.depth), np.uint8)
        self.leaves = np.zeros((0, 2**self.depth))
        if not len(y):
            return self
        score = np.full(len(y), self.bias)
        b = np.ascontiguousarray(b.T)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = w * (y - p), w * p * (1 - p)
            feats, cuts = self.splits(b, g, h)
            leaf, n = self.leaf(b, feats, cuts).astype(np.int64), 2**self.depth
            value = self.rate * np.bincount(leaf, g, n) / (np.bincount(leaf, h, n) + self.ridge)
            score += value[leaf]
            self.add(feats, cuts, value)
        return self

    def add(self, feats: list[int], cuts: list[int], value: np.ndarray) -> None:
        self.feature = np.vstack([self.feature, feats])
        self.cut = np.vstack([self.cut, np.array(cuts, np.uint8)])
        self.leaves = np.vstack([self.leaves, value])

    def sums(self, b: np.ndarray, leaf: np.ndarray, g: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
        """(g, h) x features x leaves x bins."""
        out, start = np.empty((2, len(b), n * self.bins)), leaf * self.bins
        for f, x in enumerate(b):
            at = start + x
            out[0, f], out[1, f] = np.bincount(at, g, n * self.bins), np.bincount(at, h, n * self.bins)
        return out.reshape(2, len(b), n, self.bins)

    def splits(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[list[int], list[int]]:
        """The best split of each level, one level after another; b: features x rows."""
        leaf, right = np.zeros(len(g), np.intp), np.zeros(len(g), bool)
        feats, cuts, b = [], [], b.astype(np.intp)
        none = np.arange(self.bins) >= np.array([len(e) for e in self.edges])[:, None]
        sums = self.sums(b, leaf, g, h, 1)
        for level in range(self.depth):
            if level:  # of two halves the smaller one is summed, the other is the rest
                n = 2 ** (level - 1)
                less = np.bincount(leaf, right, n) * 2 <= np.bincount(leaf, minlength=n)
                at = np.flatnonzero(right == less[leaf])
                some = self.sums(b[:, at], leaf[at], g[at], h[at], n)
                rest, less = sums - some, less[:, None]
                sums = np.stack([np.where(less, rest, some), np.where(less, some, rest)], axis=3).reshape(2, len(b), 2 * n, self.bins)
                leaf = leaf * 2 + right
            gs, hs = sums.cumsum(axis=3)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = (gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge)).sum(axis=1)
            gain[none] = -1.0
            f, k = divmod(int(gain.argmax()), self.bins)
            feats.append(f)
            cuts.append(k)
            right = b[f] > k
        return feats, cuts

    @staticmethod
    def leaf(b: np.ndarray | dict[int, np.ndarray], feats: list[int], cuts: list[int]) -> np.ndarray:
        out = np.uint8(0)
        for f, c in zip(feats, cuts):
            out = out * np.uint8(2) + (b[f] > c)
        return out

    def set_edges(self, cells: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Edges of the bins at the quantiles of all rows; cells: each feature's sorted codes and how many rows have them. Returns features x codes: the bin."""
        self.edges, table = [], np.zeros((len(cells), 2**16), np.uint8)
        for f, (code, n) in enumerate(cells):
            total = np.cumsum(n)
            at = np.searchsorted(total, np.linspace(0, 1, self.bins)[1:-1] * (total[-1] - 1), side="right") if len(code) else []
            cut = np.unique(code[at]) if len(code) else np.zeros(0, np.uint16)
            self.edges.append(greatest(cut))
            table[f] = np.searchsorted(cut, np.arange(2**16), side="left")
        return table

    def fit_parts(self, part: Part, me: int, exchange: Callable[[bytes], list[bytes]]) -> BoostedTrees:
        """Fits on the rows of all tasks; each calls it with its own and its number and gets the same trees. exchange: one's message for the messages of all."""
        counts = [np.frombuffer(m, np.int64) for m in exchange(np.array([len(part.y), part.y.sum()], np.int64).tobytes())]
        count, every = np.sum(counts, axis=0), max(1, len(counts) // max(PROPOSALS, -(-len(counts) // self.trees)))
        p0 = np.clip(count[1] / max(count[0], 1), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(p0 / (1 - p0)))
        self.feature, self.cut, self.leaves = np.zeros((0, self.depth), np.int64), np.zeros((0, self.depth), np.uint8), np.zeros((0, 2**self.depth))
        score, n = np.full(len(part.y), self.bias, np.float32), 2**self.depth
        blocks = range(len(part.sizes))
        turns = max(1, min(self.trees // every, len(blocks)))

        def gradients(i: int) -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-score[part.rows(i)].astype(float)))
            return np.rint((part.y[part.rows(i)] - p) / UNIT), np.rint(p * (1 - p) / UNIT)

        for t in range(self.trees if count[0] else 0):
            own = [i for i in blocks if i % turns == t // every % turns] if (me + t) % every == 0 else []
            gh = [gradients(i) for i in own]
            mine = []
            if own:
                features = range(part.features)
                b = np.concatenate([np.stack([x[f] for f in features]) for x in (part.bins(i, features) for i in own)], axis=1)
                mine.append(self.splits(b, np.concatenate([g for g, _ in gh]) * UNIT, np.concatenate([h for _, h in gh]) * UNIT))
            proposed = np.concatenate([np.frombuffer(m, np.int32).reshape(-1, 2, self.depth) for m in exchange(np.array(mine, np.int32).tobytes())])
            proposed = [(x[0].tolist(), x[1].tolist()) for x in np.unique(proposed, axis=0)]
            sums = np.zeros((len(proposed), 2, n))
            for i in blocks:
                b = part.bins(i, [f for feats, _ in proposed for f in feats])
                g, h = gradients(i)
                for s, (feats, cuts) in zip(sums, proposed):
                    leaf = self.leaf(b, feats, cuts).astype(np.int64)
                    s[0] += np.bincount(leaf, g, n)
                    s[1] += np.bincount(leaf, h, n)
            sums = np.sum([np.frombuffer(m).reshape(sums.shape) for m in exchange(sums.tobytes())], axis=0) * UNIT
            if not len(proposed):
                continue  # the tasks whose turn it is have no rows
            best = int((sums[:, 0] ** 2 / (sums[:, 1] + self.ridge)).sum(axis=1).argmax())
            (feats, cuts), value = proposed[best], self.rate * sums[best, 0] / (sums[best, 1] + self.ridge)
            for i in blocks:
                score[part.rows(i)] += value.astype(np.float32)[self.leaf(part.bins(i, feats), feats, cuts)]
            self.add(feats, cuts, value)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of the positive class."""
        return self.score_bins(np.ascontiguousarray(self.binned(x).T))

    def score_bins(self, b: np.ndarray) -> np.ndarray:
        """The same for bins, features x rows."""
        out = np.full(b.shape[1], self.bias)
        for feats, cuts, value in zip(self.feature, self.cut, self.leaves):
            out += value[self.leaf(b, feats, cuts)]
        return out
