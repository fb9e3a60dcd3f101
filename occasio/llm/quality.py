"""Quality classifier: random-indexing word vectors, pooled, then a two-layer network.

Tokens are runs of letters and digits (as their small letters and the pattern of their capitals), runs of punctuation, and
runs of line feeds. Word vectors (random indexing, Kanerva et al., 2000): every token has a fixed sparse index vector,
``NONZERO`` of ``DIM`` places with signs, given by its fingerprint; a token's context vector sums the index vectors of the
tokens up to ``WINDOW`` places away, over all documents. Tokens that make up ``MIN_SHARE`` of all tokens or more have a
vector of their own, so at most 1 / MIN_SHARE of them; a rarer one shares that of its shape (what kind of run, capitals,
length), which is learnt from all its rare tokens. So the table is bounded by a share, which means the same at every size,
and no token is left out.

A document is the mean of its tokens' unit vectors and the mean product, place by place, of neighbours' vectors; nothing
else tells the network of a text. The network has one hidden layer and is fitted by Adam on a bounded sample of labelled
rows (``sample_rows``); a temperature fitted on rows kept from its training calibrates it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import bounded, drop, materialize, table
from ._text import _KIND, _UPPER, U64, mix, pieces, raw, sums, word_hashes
from ._tree import merged
from .toxicity import SAMPLE_ROWS, _labelled

MIN_SHARE = 2.0**-15
DIM = 32
NONZERO = 4
WINDOW = 2
PIECE = 1 << 20
FLUSH = 1 << 19
LONGEST = 20
_RUNS = _KIND.copy()
_RUNS[10] = 3


def _tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of all tokens, the numbers of their shapes, and where each text's tokens begin."""
    data, off = raw(text)
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    kind = _RUNS[data]
    change = np.ones(n + 1, bool)
    change[1:n] = kind[1:] != kind[:-1]
    change[off] = True
    edge = np.flatnonzero(change)
    keep = kind[edge[:-1]] > 0
    starts, ends = edge[:-1][keep], edge[1:][keep]
    capitals = np.concatenate(([0], np.cumsum(_UPPER[data])))
    many, size = capitals[ends] - capitals[starts], ends - starts
    case = np.where(many == 0, 0, np.where((many == 1) & _UPPER[data[starts]], 1, np.where(many == size, 2, 3)))
    shape = (kind[starts].astype(np.int64) * 4 + case) * (LONGEST + 1) + np.minimum(size, LONGEST)
    return mix(word_hashes(data, starts, ends) ^ case.astype(U64) * U64(0xA0761D6478BD642F)), shape, np.searchsorted(starts, off)


SHAPES = 16 * (LONGEST + 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens and how often they occur, added up in the task as far as FLUSH tokens go."""
    keys, counts, held = np.zeros(0, U64), np.zeros(0, np.int64), []

    def merged_() -> tuple[np.ndarray, np.ndarray]:
        k, at = np.unique(np.concatenate([keys, *(x for x, _ in held)]), return_inverse=True)
        return k, np.bincount(at, np.concatenate([counts, *(x for _, x in held)]), len(k)).astype(np.int64)

    for batch in batches:
        for part in pieces(batch, limit=PIECE):
            held.append(np.unique(_tokens(part.column(0))[0], return_counts=True))
            if sum(len(x) for x, _ in held) > FLUSH:
                (keys, counts), held = merged_(), []
                if len(keys) > FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["w", "n"])
                    keys, counts = keys[:0], counts[:0]
    keys, counts = merged_()
    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["w", "n"])


def frequent_tokens(texts: DataFrame, min_share: float = MIN_SHARE) -> np.ndarray:
    """Sorted fingerprints of the tokens that make up ``min_share`` of all tokens: 1 / min_share of them at most."""
    counts, path = materialize(texts.mapInArrow(_count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "quality-tokens")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = counts.where(F.col("n") >= total * min_share).select("w").toPandas()
    drop(texts.sparkSession, path)
    return np.sort(rows["w"].to_numpy(np.int64).view(U64))


@dataclass(frozen=True)
class Vocabulary:
    keys: np.ndarray  # sorted fingerprints of frequent tokens; the shapes' rows come after theirs

    def rows(self, tokens: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        """The row of each token: its own, or its shape's."""
        own = len(self.keys)
        if not own or not len(tokens):
            return own + shapes
        once, back = np.unique(tokens, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, once), own - 1)
        at[self.keys[at] != once] = -1
        at = at[back]
        return np.where(at < 0, own + shapes, at)

    @property
    def size(self) -> int:
        return -(-(len(self.keys) + SHAPES) // 16) * 16

    def index(self) -> tuple[np.ndarray, np.ndarray]:
        """(size, NONZERO) places and signs of the rows' sparse index vectors."""
        name = np.zeros(self.size, U64)
        name[: len(self.keys)] = self.keys
        name[len(self.keys) :] = mix(np.arange(self.size - len(self.keys), dtype=U64) + U64(1))
        h = mix(name)[:, None] >> np.arange(0, 8 * NONZERO, 8, dtype=U64)
        return (h & U64(DIM - 1)).astype(np.int64), np.where(h >> U64(7) & U64(1), 1.0, -1.0)


def word_vectors(texts: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """(size, DIM) unit context vectors over all of ``texts``: one table a task, of bounded size, summed as a tree."""
    size = vocabulary.size

    def gather(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        place, sign = vocabulary.index()
        total = np.zeros(size * DIM)
        for batch in batches:
            for part in pieces(batch, limit=PIECE):
                tokens, shapes, bounds = _tokens(part.column(0))
                row = vocabulary.rows(tokens, shapes)
                doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                for d in range(1, WINDOW + 1):
                    near = doc[d:] == doc[:-d]
                    a, b = row[:-d][near], row[d:][near]
                    for x, y in ((a, b), (b, a)):
                        total += np.bincount((x[:, None] * DIM + place[y]).ravel(), sign[y].ravel(), size * DIM)
        return total

    v = merged(texts, gather, size * DIM, sent=np.int32).reshape(size, DIM)
    v = np.sign(v) * np.log1p(np.abs(v))
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)


WIDTH = 2 * DIM


def features(text: pa.Array, vocabulary: Vocabulary, vectors: np.ndarray) -> np.ndarray:
    """(texts, WIDTH) pooled vectors of one piece; an empty text has zeros."""
    tokens, shapes, bounds = _tokens(text)
    n = np.maximum(np.diff(bounds), 1)[:, None]
    x = vectors[vocabulary.rows(tokens, shapes)]
    pairs = np.zeros_like(x)
    np.multiply(x[1:], x[:-1], out=pairs[1:])
    pairs[bounds[:-1][np.diff(bounds) > 0]] = 0
    return np.hstack([sums(x, bounds) / n, sums(pairs, bounds) / n]).astype(np.float32)


@dataclass(frozen=True)
class QualityModel:
    vocabulary: Vocabulary
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    hidden: tuple[np.ndarray, np.ndarray]
    out: tuple[np.ndarray, float]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.hidden[0] + self.hidden[1]) @ self.out[0] + self.out[1]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def _network(x: np.ndarray, y: np.ndarray, *, width: int = 32, epochs: int = 40, batch: int = 128, decay: float = 1e-3, seed: int = 7) -> tuple:
    """Two layers by Adam on the logistic loss."""
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], width)), np.zeros(width), rng.normal(0, width**-0.5, width), np.array(0.0)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    steps = epochs * max(1, -(-len(y) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            k = order[i : i + batch]
            a = np.tanh(x[k] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3], -40, 40))) - y[k]) / len(k)
            back = np.outer(d, p[2]) * (1 - a * a)
            g = [x[k].T @ back + decay * p[0], back.sum(0), a.T @ d + decay * p[2], d.sum()]
            t += 1
            rate = 3e-3 * (1 - 0.9 * t / steps)
            for j in range(4):
                m[j] = 0.9 * m[j] + 0.1 * g[j]
                v[j] = 0.999 * v[j] + 0.001 * g[j] ** 2
                p[j] = p[j] - rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
    return (p[0], p[1]), (p[2], float(p[3]))


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, on a fixed grid from 1/4 to 8."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 141))
    losses = [float((np.logaddexp(0, logits / t) - y * logits / t).sum()) for t in grid]
    return float(grid[int(np.argmin(losses))])


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Word vectors from all documents; the network from labels whose crc32(doc_id as text) mod 5 is not 0.

    Null labels and null doc_ids are left out; a doc_id or a text that is labelled more than once counts as 1 if any of
    its labels does; equal texts count once; a null text counts as empty. Without labels of both kinds every score is the
    share of label 1, smoothed.
    """
    texts = bounded(docs).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    vocabulary = Vocabulary(frequent_tokens(texts))
    vectors = word_vectors(texts, vocabulary)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, limit=PIECE):
                x = features(part.column(0), vocabulary, vectors)
                yield pa.RecordBatch.from_arrays([part.column(1).cast(pa.int32()), part.column(2), pa.array(list(x), pa.list_(pa.float32()))], names=["y", "fold", "x"])

    train, path = materialize(_labelled(docs, labels, label, sample_rows), "quality-train")
    got = train.select("text", "y", F.pmod(F.xxhash64("text"), F.lit(5)).alias("fold")).mapInArrow(rows, "y int, fold long, x array<float>").toPandas()  # sample_rows at most
    drop(docs.sparkSession, path)
    width = WIDTH
    x = np.array(got["x"].tolist(), np.float64).reshape(-1, width)
    y, kept = got["y"].to_numpy(float), got["fold"].to_numpy() == 0
    order = np.lexsort((*x.T, y))  # the same model whatever order the rows come in
    x, y, kept = x[order], y[order], kept[order]
    mean, scale = (x.mean(0), np.maximum(x.std(0), 1e-6)) if len(y) else (np.zeros(width), np.ones(width))
    if not 0 < y.sum() < len(y):
        share = (y.sum() + 0.5) / (len(y) + 1)
        return QualityModel(vocabulary, vectors, mean, scale, (np.zeros((width, 1)), np.zeros(1)), (np.zeros(1), float(np.log(share / (1 - share)))), 1.0)
    z = np.clip((x - mean) / scale, -8, 8)
    learn = ~kept if 0 < y[~kept].sum() < (~kept).sum() else np.ones(len(y), bool)
    hidden, out = _network(z[learn], y[learn])
    model = QualityModel(vocabulary, vectors, mean, scale, hidden, out, 1.0)
    t = _temperature(model.logits(x[kept]), y[kept]) if kept.any() else 1.0
    return QualityModel(vocabulary, vectors, mean, scale, hidden, out, t)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id``, ``score`` (chance of label 1) of every row, repeated ones too. A null text counts as empty, and an
    empty one has a score too; texts are read whole, however long. Narrow: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, limit=PIECE):
                p = model.probabilities(features(part.column(1), model.vocabulary, model.vectors))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
