"""A graph autoencoder for baskets, in numpy: two edge-aware message layers, mean pooling, a vector, a decoder.

Training runs on the driver over a bounded sample of baskets; scoring runs over all baskets in Arrow batches with the
weights, some hundred kilobytes, in the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Batch:
    x: np.ndarray
    graph: np.ndarray  # graph of each node
    size: np.ndarray  # nodes of each graph
    src: np.ndarray
    dst: np.ndarray
    attr: np.ndarray


def batch_of(frame: pd.DataFrame, width: int) -> Batch:
    """Graphs side by side; one without nodes has one zero node."""
    xs, graph, size, src, dst, attr, at = [], [], [], [], [], [], 0
    for g, (x, n, s, d, a) in enumerate(zip(frame["x"], frame["n_nodes"], frame["src"], frame["dst"], frame["attr"])):
        n = int(n) or 1
        xs.append(np.asarray(x, np.float64).reshape(-1, width) if len(x) else np.zeros((1, width)))
        graph.append(np.full(n, g))
        size.append(n)
        src.append(np.asarray(s, np.int64) + at)
        dst.append(np.asarray(d, np.int64) + at)
        attr.append(np.asarray(a, np.float64).reshape(-1, 2))
        at += n
    cat = lambda parts, empty: np.concatenate(parts) if parts else empty
    return Batch(cat(xs, np.zeros((0, width))), cat(graph, np.zeros(0, int)), np.array(size), cat(src, np.zeros(0, int)), cat(dst, np.zeros(0, int)), cat(attr, np.zeros((0, 2))))


def _sum_by(values: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    """Rows summed by their index: the first rows of all, then the second ones, so that a step is one addition of arrays."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(index):
        if (np.diff(index) < 0).any():
            by = np.argsort(index, kind="stable")
            index, values = index[by], values[by]
        start = np.flatnonzero(np.diff(index, prepend=-1))
        count = np.diff(start, append=len(index))
        by = np.argsort(-count, kind="stable")
        start, to, count = start[by], index[start[by]], count[by]
        for k in range(count[0]):
            some = np.searchsorted(-count, -k)
            out[to[:some]] += np.take(values, start[:some] + k, 0)
    return out


class Encoder:
    """x -> linear -> two layers of h_i' = relu(W (h_i + sum over edges j to i of relu(h_j + E e_ji))) -> mean -> vector;
    the decoder gives the mean node features back."""

    NAMES = ("in", "in_b", "e1", "w1", "w1_b", "e2", "w2", "w2_b", "out", "out_b", "dec", "dec_b")

    def __init__(self, width: int, hidden: int = 64, dim: int = 64, seed: int = 42):
        rng = np.random.default_rng(seed)
        init = lambda a, b: rng.normal(0, np.sqrt(2 / a), (a, b))
        self.width, self.hidden, self.dim = width, hidden, dim
        self.p = {"in": init(width, hidden), "in_b": np.zeros(hidden), "out": init(hidden, dim), "out_b": np.zeros(dim), "dec": init(dim, width), "dec_b": np.zeros(width)}
        for k in ("1", "2"):
            self.p |= {f"e{k}": init(2, hidden), f"w{k}": init(hidden, hidden), f"w{k}_b": np.zeros(hidden)}

    def forward(self, b: Batch) -> tuple[np.ndarray, list]:
        p, h, kept = self.p, b.x @ self.p["in"] + self.p["in_b"], []
        for k in ("1", "2"):
            message = b.attr @ p[f"e{k}"]
            message += np.take(h, b.src, 0)
            total = h + _sum_by(np.maximum(message, 0), b.dst, len(h))
            z = total @ p[f"w{k}"] + p[f"w{k}_b"]
            kept.append((h, message, total, z))
            h = np.maximum(z, 0)
        pooled = _sum_by(h, b.graph, len(b.size)) / b.size[:, None]
        return pooled @ p["out"] + p["out_b"], [kept, pooled]

    def gradients(self, b: Batch) -> tuple[float, dict[str, np.ndarray]]:
        """Mean squared error of the decoded mean node features, and its gradient."""
        p = self.p
        v, (kept, pooled) = self.forward(b)
        target = _sum_by(b.x, b.graph, len(b.size)) / b.size[:, None]
        error = v @ p["dec"] + p["dec_b"] - target
        g = {}
        d = 2 * error / error.size
        g["dec"], g["dec_b"] = v.T @ d, d.sum(0)
        dv = d @ p["dec"].T
        g["out"], g["out_b"] = pooled.T @ dv, dv.sum(0)
        dh = ((dv @ p["out"].T) / b.size[:, None])[b.graph]
        for k, (h, message, total, z) in zip(("2", "1"), reversed(kept)):
            dz = dh * (z > 0)
            g[f"w{k}"], g[f"w{k}_b"] = total.T @ dz, dz.sum(0)
            dt = dz @ p[f"w{k}"].T
            dm = dt[b.dst] * (message > 0)
            g[f"e{k}"] = b.attr.T @ dm
            dh = dt + _sum_by(dm, b.src, len(h))
        g["in"], g["in_b"] = b.x.T @ dh, dh.sum(0)
        return float((error * error).mean()), g

    def train(self, graphs: pd.DataFrame, *, epochs: int = 20, batch: int = 256, rate: float = 1e-3, clip: float = 1.0, seed: int = 42) -> list[float]:
        """Adam with a norm bound on gradients; batches whose loss is not finite are left out. Returns each epoch's loss."""
        rng = np.random.default_rng(seed)
        m, v, t, history = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0, []
        for _ in range(epochs):
            losses, order = [], rng.permutation(len(graphs))
            for i in range(0, len(order), batch):
                loss, g = self.gradients(batch_of(graphs.iloc[order[i : i + batch]], self.width))
                if not np.isfinite(loss):
                    continue
                losses.append(loss)
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                scale = min(1.0, clip / max(norm, 1e-12))
                t += 1
                for k in self.p:
                    x = g[k] * scale
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.999 * v[k] + 0.001 * x * x
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
            history.append(float(np.mean(losses)) if losses else float("nan"))
        return history

    def save(self, spark: SparkSession, path: str) -> None:
        """The weights as a table, replaced as a whole; to be written before anything is embedded with them."""
        rows = [(k, *x.reshape(x.shape[0], -1).shape, x.ndim, x.astype("<f8").tobytes()) for k, x in self.p.items()]
        spark.createDataFrame(rows, "name string, height int, width int, dims int, data binary").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Encoder:
        """The encoder whose weights are at the path. A table that lacks some of them raises."""
        p = {r["name"]: np.frombuffer(r["data"], "<f8").reshape((r["height"], r["width"]) if r["dims"] == 2 else (r["height"],)).copy() for r in spark.read.parquet(path).collect()}  # a row a weight
        if set(p) != set(cls.NAMES):
            raise ValueError(f"{path} holds no whole encoder: it lacks {', '.join(sorted(set(cls.NAMES) - set(p))) or 'nothing'}")
        out = cls(*p["in"].shape, p["out"].shape[1])
        out.p = p
        return out


Vectors = tuple[np.ndarray, np.ndarray]


def vector_table(vectors: DataFrame, key: str) -> Vectors:
    """Ids in order and their vectors, for :func:`train` and :func:`embed`: 4 bytes an entry on the driver and in each worker."""
    rows = vectors.select(key, F.col("embedding").cast("array<float>").alias("embedding")).toPandas().sort_values(key)
    return rows[key].to_numpy(), np.stack(rows["embedding"].to_numpy()).astype(np.float32) if len(rows) else np.zeros((0, 0), np.float32)


def packed_batch(vec: np.ndarray, scalars: np.ndarray, size: np.ndarray, src: np.ndarray, dst: np.ndarray, edges: np.ndarray, attr: np.ndarray, vectors: Vectors, dim: int) -> Batch:
    """Graphs of ``size`` nodes and ``edges`` edges each, side by side, in single precision and with edges in order of their
    end; -1, or an id without a vector, is a zero vector."""
    ids, table = vectors
    x = np.zeros((len(vec), dim + 3), np.float32)
    if len(ids):
        at = np.minimum(np.searchsorted(ids, vec), len(ids) - 1)
        x[:, :dim] = np.where((ids[at] == vec)[:, None], table[at], 0)
    np.nan_to_num(x, copy=False, nan=0.0, posinf=0.0, neginf=0.0)
    x[:, dim:] = scalars.reshape(-1, 3)
    first = np.repeat(np.cumsum(size) - size, edges)
    src, dst = src + first, dst + first
    by = np.argsort(dst, kind="stable")
    return Batch(x, np.repeat(np.arange(len(size)), size), size.astype(np.float32), src[by], dst[by], attr.reshape(-1, 2)[by].astype(np.float32))


def _batches(b: pa.RecordBatch, vectors: Vectors, dim: int, rows: int = 256) -> Iterator[tuple[pa.RecordBatch, Batch]]:
    """Some ``rows`` of packed graphs (see :func:`occasio.operators.graphs.pack_graphs`) at a time."""
    for lo in range(0, b.num_rows, rows):
        part = b.slice(lo, rows)
        flat = lambda c, part=part: part[c].flatten().to_numpy(zero_copy_only=False)
        size, edges = (part[c].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("vec", "src"))
        vec = part["vec"].flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        yield part, packed_batch(vec, flat("scalars"), size, flat("src").astype(np.int64), flat("dst").astype(np.int64), edges, flat("attr"), vectors, dim)


def sampled(baskets: DataFrame, sample: int = 2000, seed: int = 42) -> DataFrame:
    """The rows of the at most ``sample`` baskets that :func:`train` learns from: those with the least hash of (key, seed)."""
    least = baskets.select("basket_id", F.xxhash64("basket_id", F.lit(seed)).alias("h")).orderBy("h", "basket_id").limit(sample)
    return baskets.join(F.broadcast(least.select("basket_id")), "basket_id", "left_semi")


def train(graphs: DataFrame, width: int, *, vectors: Vectors, sample: int = 2000, seed: int = 42, epochs: int = 20, hidden: int = 64, dim: int = 64) -> tuple[Encoder, list[float]]:
    """An encoder trained on the :func:`sampled` of ``graphs``: packed graphs, whose vectors have ``width`` - 3 entries."""
    rows = sampled(graphs, sample, seed).orderBy(F.xxhash64("basket_id", F.lit(seed)), "basket_id").select("basket_id", "vec", "scalars", "src", "dst", "attr").toPandas()
    table = dict(zip(vectors[0].tolist(), vectors[1].astype(np.float64)))
    none = np.zeros(width - 3)
    x = [np.concatenate([np.concatenate([np.nan_to_num(table.get(-1 if v is None or v != v else int(v), none), nan=0.0, posinf=0.0, neginf=0.0), s]) for v, s in zip(vec, np.asarray(scalars).reshape(-1, 3))]) for vec, scalars in zip(rows["vec"], rows["scalars"])]
    encoder = Encoder(width, hidden, dim, seed)
    return encoder, encoder.train(rows.assign(x=x, n_nodes=[len(v) for v in rows["vec"]]), epochs=epochs, seed=seed)


def embed(graphs: DataFrame, encoder: Encoder, vectors: Vectors) -> DataFrame:
    """(basket_id, embedding) of every basket, in single precision. The vectors go to each worker once."""
    sent = graphs.sparkSession.sparkContext.broadcast((encoder, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, vectors = sent.value
        encoder.p = {k: x.astype(np.float32) for k, x in encoder.p.items()}
        for b in batches:
            for part, batch in _batches(b, vectors, encoder.width - 3):
                v, _ = encoder.forward(batch)
                ends = pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1])
                yield pa.RecordBatch.from_arrays([part["basket_id"], pa.ListArray.from_arrays(ends, pa.array(v.astype(np.float32).ravel()))], ["basket_id", "embedding"])

    return graphs.select("basket_id", "vec", "scalars", "src", "dst", "attr").mapInArrow(run, "basket_id string, embedding array<float>")
