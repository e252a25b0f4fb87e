"""Small networks trained data-parallel: every step sums the gradients of all rows in Spark.

Only parameters (their number is fixed by the layer sizes) pass between driver and tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.predictors import Predictor, register


class Net:
    """Two rectified layers and three heads: log1p score, log1p width (Huber loss) and the flag (cross-entropy)."""

    def __init__(self, width: int, hidden: tuple[int, int], seed: int = 0):
        rng = np.random.default_rng(seed)
        sizes = [width, *hidden]
        self.w = [rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:])] + [rng.normal(0, 0.1, (hidden[-1], 3))]
        self.b = [np.zeros(b) for b in hidden] + [np.zeros(3)]

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        acts = [x]
        for w, b in zip(self.w[:-1], self.b[:-1]):
            acts.append(np.maximum(acts[-1] @ w + b, 0))
        return [*acts, acts[-1] @ self.w[-1] + self.b[-1]]

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Summed gradient, flat, with the loss in front."""
        acts = self.forward(x)
        out = acts[-1]
        err = out[:, :2] - y[:, :2]
        p = 1 / (1 + np.exp(-np.clip(out[:, 2], -30, 30)))
        d = np.concatenate([np.clip(err, -1, 1), ((p - y[:, 2]) * weight)[:, None]], axis=1)
        huber = np.where(np.abs(err) <= 1, err**2 / 2, np.abs(err) - 0.5).sum()
        loss = huber - (weight * (y[:, 2] * np.log(p + 1e-12) + (1 - y[:, 2]) * np.log(1 - p + 1e-12))).sum()
        grads = []
        for i in range(len(self.w) - 1, -1, -1):
            grads.append((acts[i].T @ d, d.sum(axis=0)))
            if i:
                d = (d @ self.w[i].T) * (acts[i] > 0)
        return np.concatenate([[loss], *[g.ravel() for pair in reversed(grads) for g in pair]])

    def flat(self) -> np.ndarray:
        return np.concatenate([g.ravel() for pair in zip(self.w, self.b) for g in pair])

    def load(self, v: np.ndarray) -> None:
        at = 0
        for i in range(len(self.w)):
            for part in (self.w, self.b):
                n = part[i].size
                part[i] = v[at : at + n].reshape(part[i].shape)
                at += n


class VectorNet(Predictor):
    """Net over one array column of fixed length; columns are standardized over the training rows, the flag is class-balanced."""

    def __init__(self, column: str, hidden: tuple[int, int] = (256, 64), steps: int = 40, rate: float = 0.01):
        self.column, self.hidden, self.steps, self.rate = column, hidden, steps, rate

    def _sum(self, rows: DataFrame, size: int, of) -> np.ndarray:
        col = self.column

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(size)
            for b in batches:
                if len(b):
                    total += of(np.stack(b[col].to_numpy()).astype(float), b[["score", "width", "contr"]].to_numpy(dtype=float))
            yield pd.DataFrame({"i": np.arange(size), "v": total})

        out = np.zeros(size)
        for r in rows.select(col, "score", "width", "contr").mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            out[r["i"]] = r["v"]
        return out

    def fit(self, train: DataFrame) -> VectorNet:
        rows = train.filter(F.col(self.column).isNotNull()).dropna(subset=["score", "width", "contr"])
        first = rows.select(F.size(self.column).alias("d")).first()
        if first is None:
            raise ValueError("no training rows")
        d = first["d"]
        s = self._sum(rows, 2 + 2 * d, lambda x, y: np.concatenate([[len(x), y[:, 2].sum()], x.sum(axis=0), (x**2).sum(axis=0)]))
        n, pos = s[0], s[1]
        self.mean = s[2 : 2 + d] / n
        self.scale = np.sqrt(np.maximum(s[2 + d :] / n - self.mean**2, 1e-12))
        self.scale[self.scale < 1e-6] = 1.0
        balance = (n / (2 * max(n - pos, 1)), n / (2 * max(pos, 1)))
        net, mean, scale = Net(d, self.hidden), self.mean, self.scale
        v = net.flat()
        m1, m2 = np.zeros_like(v), np.zeros_like(v)
        self.losses = []
        for step in range(1, self.steps + 1):

            def of(x: np.ndarray, y: np.ndarray, net: Net = net) -> np.ndarray:
                t = np.column_stack([np.log1p(np.maximum(y[:, :2], 0)), y[:, 2]])
                return net.gradient((x - mean) / scale, t, np.where(y[:, 2] == 1, balance[1], balance[0]))

            g = self._sum(rows, 1 + len(v), of) / n
            self.losses.append(g[0])
            m1, m2 = 0.9 * m1 + 0.1 * g[1:], 0.999 * m2 + 0.001 * g[1:] ** 2
            v = v - self.rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
            net = Net(d, self.hidden)
            net.load(v)
        self.net = net
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        net, mean, scale, col = self.net, self.mean, self.scale, self.column

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    out = net.forward((np.stack(b[col].to_numpy()).astype(float) - mean) / scale)[-1]
                    count = np.rint(np.expm1(np.clip(out[:, :2], 0, 30))).astype("int64")
                    yield pd.DataFrame({"record_id": b["record_id"], "score": count[:, 0], "width": count[:, 1], "controversiality": (out[:, 2] > 0).astype("int32")})

        known = rows.filter(F.col(col).isNotNull()).select("record_id", col)
        return known.mapInPandas(run, "record_id bigint, score bigint, width bigint, controversiality int")


@register("frozen_mlp")
def frozen_mlp(column: str = "vector", steps: int = 40) -> Predictor:
    """Network over vectors that an encoder made before and that stay as they are."""
    return VectorNet(column, (256, 64), steps)


def path_vectors(nodes: DataFrame, most: int = 12) -> DataFrame:
    """``record_id, vector``: what the stimulus sees of its path after two rounds of neighbour averaging.

    Nodes beyond either end count as absent, so nothing wraps around and padding is never read.
    """
    names = ["log_score", "contr", "depth", "log_chars", "hour", "is_stimulus"]
    row = F.struct("pos", F.array(*names).alias("x"))
    paths = nodes.groupBy("record_id").agg(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["x"]).alias("xs"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for xs in b["xs"]:
                h = np.array([np.asarray(x, dtype=float) for x in xs])[-most:]
                layers = [h[-1]]
                for _ in range(2):
                    total, count = h.copy(), np.ones((len(h), 1))
                    total[1:] += h[:-1]
                    count[1:] += 1
                    total[:-1] += h[1:]
                    count[:-1] += 1
                    h = total / count
                    layers.append(h[-1])
                out.append(np.concatenate(layers))
            yield pd.DataFrame({"record_id": b["record_id"], "vector": out})

    return paths.mapInPandas(run, "record_id bigint, vector array<double>")


@register("gnn")
def gnn(steps: int = 40) -> Predictor:
    """Network over :func:`path_vectors`: fixed neighbour averaging, learned readout."""
    return VectorNet("vector", (64, 64), steps)
