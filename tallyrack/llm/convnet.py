"""A byte convolutional network in numpy: filters of several widths, max pooling, softmax.

A filter of width w over embedded bytes is the sum of w table look-ups, one for each byte under it, so the network
is applied with tables of 256 rows and no matrix of shifted inputs.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame

from .common import release
from .lmscore import summed

#: Rows that a partition takes its steps over at a time.
LOCAL = 4096
#: Bytes that are looked at in a pass: their responses stay in a core's cache.
PASS = 1 << 13


class Adam:
    """Running means of gradients and of their squares."""

    def __init__(self, p: dict[str, np.ndarray]) -> None:
        self.m, self.s, self.n = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0

    def step(self, p: dict[str, np.ndarray], grads: dict[str, np.ndarray], rate: float) -> None:
        self.n += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.s[k] += 0.01 * (g * g - self.s[k])
            p[k] -= (rate * (self.m[k] / (1 - 0.9**self.n)) / (np.sqrt(self.s[k] / (1 - 0.99**self.n)) + 1e-6)).astype(np.float32)


class ByteConvNet:
    """Windows of `length` bytes -> class probabilities.  A window reads max(widths) - 1 bytes beyond its end."""

    def __init__(self, classes: int, length: int = 128, widths: tuple[int, ...] = (2, 3, 4), filters: int = 16, dim: int = 8, seed: int = 1) -> None:
        r = np.random.default_rng(seed)
        self.length, self.widths, self.filters, self.classes = length, widths, filters, classes
        self.p = {"E": r.normal(0, 0.5, (256, dim)), "V": r.normal(0, 0.3, (len(widths) * filters, classes)), "b": np.zeros(classes)}
        for w in widths:
            self.p[f"W{w}"] = r.normal(0, 1 / np.sqrt(w * dim), (w, dim, filters))
            self.p[f"c{w}"] = np.zeros(filters)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    @property
    def ahead(self) -> int:
        return max(self.widths) - 1

    def tables(self) -> dict[int, list[np.ndarray]]:
        return {w: [np.ascontiguousarray(self.p["E"] @ self.p[f"W{w}"][k]) for k in range(w)] for w in self.widths}

    def _pooled(self, data: np.ndarray, count: int, tables: dict) -> np.ndarray:
        """data: count * length bytes and `ahead` more.  The largest response of each filter in each window: halves of the
        places are compared with each other, which numpy does far quicker than a maximum along an inner axis."""
        n, pools = count * self.length, []
        for w in self.widths:
            out = tables[w][0].take(data[:n], axis=0)
            for k in range(1, w):
                out += tables[w][k].take(data[k : k + n], axis=0)
            out, left = out.reshape(count, self.length, self.filters), self.length
            while left > 1:
                half = left // 2
                np.maximum(out[:, :half], out[:, left - half : left], out=out[:, :half])
                left -= half
            pools.append(out[:, 0] + self.p[f"c{w}"])
        return np.concatenate(pools, axis=1)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, data: np.ndarray, count: int, tables: dict | None = None) -> np.ndarray:
        """Class probabilities of `count` windows that lie one after another in data; bounded memory."""
        tables, step, out = tables or self.tables(), max(1, PASS // self.length), []
        for at in range(0, count, step):
            here = min(step, count - at)
            pool = self._pooled(data[at * self.length : (at + here) * self.length + self.ahead], here, tables)
            out.append(self._softmax(np.maximum(pool, 0) @ self.p["V"] + self.p["b"]))
        return np.concatenate(out) if out else np.zeros((0, self.classes), np.float32)

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 2) -> ByteConvNet:
        """windows: (n, length + ahead) bytes.  Adam on the cross-entropy; the same seed gives the same network."""
        r, step, adam = np.random.default_rng(seed), 0, Adam(self.p)
        total = max(1, epochs * -(-len(labels) // batch))
        for _ in range(epochs):
            order = r.permutation(len(labels))
            for at in range(0, len(order), batch):
                pick, step = order[at : at + batch], step + 1
                adam.step(self.p, self._gradients(windows[pick], labels[pick]), rate * (1 - (step - 1) / total))
        return self

    def _gradients(self, windows: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> dict[str, np.ndarray]:
        n, tables = len(labels), self.tables()
        pools, wheres = [], []
        for w in self.widths:
            out = tables[w][0].take(windows[:, : self.length], axis=0)
            for k in range(1, w):
                out += tables[w][k].take(windows[:, k : k + self.length], axis=0)
            at = out.argmax(axis=1)
            wheres.append(at)
            pools.append(np.take_along_axis(out, at[:, None], 1)[:, 0] + self.p[f"c{w}"])
        pool = np.concatenate(pools, axis=1)
        hidden = np.maximum(pool, 0)
        d = self._softmax(hidden @ self.p["V"] + self.p["b"])
        d[np.arange(n), labels] -= 1
        d *= 1 / n if weights is None else (weights / weights.sum()).astype(np.float32)[:, None]
        grads = {"V": hidden.T @ d, "b": d.sum(axis=0), "E": np.zeros_like(self.p["E"])}
        back = (d @ self.p["V"].T) * (pool > 0)
        row, column = np.arange(n)[:, None], np.arange(self.filters)
        for j, w in enumerate(self.widths):
            mine = back[:, j * self.filters : (j + 1) * self.filters]
            grads[f"c{w}"], grads[f"W{w}"] = mine.sum(axis=0), np.zeros_like(self.p[f"W{w}"])
            for k in range(w):
                # the gradient of the table is summed by byte and filter; the embedding's and the filter's follow from it
                under = windows[row, wheres[j] + k].astype(np.int64) * self.filters + column
                table = np.bincount(under.reshape(-1), mine.reshape(-1), 256 * self.filters).reshape(256, self.filters).astype(mine.dtype)
                grads[f"W{w}"][k] = self.p["E"].T @ table
                grads["E"] += table @ self.p[f"W{w}"][k].T
        return grads


def learn(rows: DataFrame, net: ByteConvNet, rates: tuple[float, ...], beside: tuple[np.ndarray, np.ndarray] | None = None, batch: int = 64, cut: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = iter) -> int:
    """rows (label int, weight double, window binary of length + ahead bytes), or what `cut` makes such rows of in the same
    Python worker -> how many there are; the network has then taken steps over every one of them.  A round for each rate: each partition goes on from the same network, LOCAL rows
    at a time in random order, and the networks are averaged by their rows.  A third of each step's windows are the
    partition's and two thirds of `beside` (windows, labels), if it is given."""
    size, names, seen = net.length + net.ahead, sorted(net.p), 0
    context, parts = rows.sparkSession.sparkContext, rows.rdd.getNumPartitions()
    for rate in rates:
        shared = context.broadcast((net, beside))

        def run(batches: Iterator[pa.RecordBatch], rate: float = rate, shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            release()
            start, more = shared.value
            own, r, n = copy.copy(start), np.random.default_rng(8), 0
            own.p = {k: v.copy() for k, v in start.p.items()}
            adam = Adam(own.p)
            for part in (b.slice(at, LOCAL) for b in cut(batches) for at in range(0, b.num_rows, LOCAL)):
                x = np.frombuffer(b"".join(v.as_py() for v in part.column("window")), np.uint8).reshape(-1, size)
                y, weight = part.column("label").to_numpy(), part.column("weight").to_numpy()
                order = r.permutation(len(y))
                for at in range(0, len(order), batch):
                    pick = order[at : at + batch]
                    xs, ys, ws = x[pick], y[pick], weight[pick]
                    if more is not None:
                        extra = r.integers(0, len(more[1]), 2 * len(pick))
                        xs, ys = np.concatenate([xs, more[0][extra]]), np.concatenate([ys, more[1][extra]])
                        ws = np.concatenate([ws * (len(pick) / ws.sum()), np.ones(len(extra))])
                    # a partition's last rows count by how many they are
                    adam.step(own.p, own._gradients(xs, ys, ws), rate * len(pick) / batch)
                n += len(y)
            change = np.concatenate([*(((own.p[k].astype(float) - start.p[k]) * n).reshape(-1) for k in names), [float(n)]])
            if n:
                yield pa.record_batch({"block": pa.array([0], pa.int32()), "who": pa.array([TaskContext.get().partitionId()], pa.int32()), "at": pa.nulls(1, pa.binary()), "x": pa.array([change.tobytes()], pa.binary())})

        for _, x in summed(rows.mapInArrow(run, "block int, who int, at binary, x binary"), parts):
            at, seen = 0, int(x[-1])
            for k in names:
                net.p[k] = net.p[k] + (x[at : at + net.p[k].size] / x[-1]).reshape(net.p[k].shape).astype(np.float32)
                at += net.p[k].size
        shared.unpersist()
    return seen
