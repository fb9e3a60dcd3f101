"""Toxic passages: maximum-scoring segments of token log-odds, with extreme-value statistics.

Training, on at most ``sample_rows`` labelled rows (the bound is a parameter; those with the smallest hash of
doc_id): each word's log-odds between toxic and clean documents (words are runs of letters and digits, A-Z as
a-z) under an informative Dirichlet prior (Monroe,
Colaresi and Quinn, 2008), where a document counts a word once. A word's stems, its first 4 to 9 bytes, are counted
alike, so that a rare word has the odds of the stem that tells most. Words whose z-score is below ``z_min`` or whose log-odds are below
``odds_min`` (a language's words, say) weigh nothing.

Scoring, on whole texts: every token scores its log-odds less a drift, so that the expected score of clean text is
below zero. One linear scan (Ruzzo and Tompa, 1999) finds all maximal segments: each candidate keeps a link to the one
before it with a lower sum on its left, and a search follows links only, so it passes over a candidate once. Segment scores follow an
extreme-value law (Karlin and Altschul, 1990): with lambda from the clean token distribution and K from the clean
training documents, a segment of score S in n tokens has the E-value K n exp(-lambda S). Segments with an E-value up
to ``e_max`` are passages; the document's evidence is the best sum statistic of its segments (Karlin and Altschul,
1993), which a logistic curve, fitted on the training rows, turns into a probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import bounded, drop, materialize, table
from ._text import U64, Words, pieces, prefix_hashes, terms

SAMPLE_ROWS = 20_000
STEMS = (4, 5, 6, 7, 8, 9)


@dataclass(frozen=True)
class ToxicityModel:
    keys: np.ndarray  # sorted word fingerprints
    weights: np.ndarray  # their log-odds
    z: np.ndarray  # and z-scores
    drift: float
    lam: float
    k: float
    slope: float
    bias: float
    e_max: float

    def scores(self, w: Words) -> np.ndarray:
        """Log-odds less drift of each word: that of its feature with the largest z-score."""
        out, best = np.full(len(w.hashes), -self.drift), np.zeros(len(w.hashes))
        if len(self.keys):
            may = np.zeros(1 << 16, bool)
            may[(self.keys >> U64(48)).astype(np.int64)] = True
            for at, h in _features(w):
                hit = np.flatnonzero(may[(h >> U64(48)).astype(np.int64)])
                k = np.minimum(np.searchsorted(self.keys, h[hit]), len(self.keys) - 1)
                ok = self.keys[k] == h[hit]
                k, i = k[ok], at[hit[ok]]
                more = np.abs(self.z[k]) > best[i]
                best[i[more]] = np.abs(self.z[k[more]])
                out[i[more]] = self.weights[k[more]] - self.drift
        return out

    def evidence(self, scores: np.ndarray, n: int) -> float:
        """-ln of the chance that clean text of n tokens has segments of such scores (its best sum statistic)."""
        total = np.cumsum(self.lam * np.sort(scores)[::-1] - math.log(max(self.k * n, 1e-12)))
        total = total[total > 0]  # the terms fall: a sum that is not above zero never rises again
        if not len(total):
            return 0.0
        r = np.arange(1, len(total) + 1)
        factorial = np.cumsum(np.log(r))
        return max(0.0, float((total - (r - 1) * np.log(total) + 2 * factorial - np.log(r))[1:].max(initial=total[0])))

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.slope * evidence + self.bias))))


def _features(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """The word itself, and its first 4 to 9 bytes as a stem: word indices and fingerprints of each kind."""
    return [(np.arange(len(w.hashes)), w.hashes), *prefix_hashes(w, STEMS)]


def _candidates(positive: list[int], total: np.ndarray) -> tuple[list[tuple[int, int, float, float, int]], int]:
    """(start, end, sum before, sum after, link) of all maximal segments, and how many links were followed."""
    found: list[tuple[int, int, float, float, int]] = []
    steps = 0
    for i in positive:
        start, end, low, high = i, i + 1, float(total[i]), float(total[i + 1])
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
                steps += 1
            if j < 0 or found[j][3] >= high:
                found.append((start, end, low, high, j))
                break
            start, _, low, _, link = found[j]
            del found[j:]
            j = link
    return found, steps


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, by one linear scan."""
    found, _ = _candidates(np.flatnonzero(scores > 0).tolist(), np.concatenate(([0.0], np.cumsum(scores))))
    return [(s, e, high - low) for s, e, low, high, _ in found]


def _labelled(docs: DataFrame, labels: DataFrame, label: str, sample_rows: int) -> DataFrame:
    """(text, y): distinct texts of at most ``sample_rows`` training rows; a text counts as 1 if any copy does."""
    y = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col(label).cast("int")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(y), "doc_id")
    return rows.groupBy("text").agg(F.max("y").alias("y"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            w, y = terms(part.column(0)), part.column(1).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(part.num_rows), np.diff(w.bounds))
            features = _features(w)
            h, doc = np.concatenate([x for _, x in features]), np.concatenate([doc[at] for at, _ in features])
            order = np.lexsort((h, doc))
            h, d = h[order], doc[order]
            once = np.ones(len(h), bool)
            once[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            keys, at = np.unique(h[once], return_inverse=True)
            toxic = y[d[once]] == 1
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.bincount(at[toxic], minlength=len(keys))), pa.array(np.bincount(at[~toxic], minlength=len(keys)))], names=["w", "toxic", "clean"])


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", sample_rows: int = SAMPLE_ROWS, prior: float = 0.02, z_min: float = 2.3, odds_min: float = 2.0, drift: float = 0.5, e_max: float = 0.01) -> ToxicityModel:
    """Learn from labels whose crc32(doc_id as text) mod 5 is not 0. Without toxic or clean rows nothing scores.

    Null labels and null doc_ids are left out; a doc_id or a text that is labelled more than once counts as toxic if any
    of its labels is; equal texts count once; a null text counts as empty. ``sample_rows`` bounds the labelled rows, and
    with their words the model. ``prior``: the weight of the Dirichlet prior, as a share of all counts.
    """
    spark = docs.sparkSession
    train, path = materialize(_labelled(docs, labels, label, sample_rows), "toxicity-train")
    counts, counts_path = materialize(train.mapInArrow(_count, "w long, toxic long, clean long").groupBy("w").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxicity-counts")
    n1, n0 = (float(x or 0) for x in counts.agg(F.sum("toxic"), F.sum("clean")).first())
    a0 = max(prior * (n1 + n0), 1e-9)
    a = F.lit(a0) * (F.col("toxic") + F.col("clean")) / F.lit(max(n1 + n0, 1.0))
    odds = F.log((F.col("toxic") + a) / (n1 + a0 - F.col("toxic") - a)) - F.log((F.col("clean") + a) / (n0 + a0 - F.col("clean") - a))
    z = odds / F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("clean") + a))
    chosen = counts.select("w", odds.alias("odds"), z.alias("z"), ((F.col("clean") + a) / (n0 + a0)).alias("p0")).where((F.abs("z") >= z_min) & (F.abs("odds") >= odds_min)).toPandas()  # words of sample_rows texts at most
    keys = chosen["w"].to_numpy(np.int64).view(U64)
    order = np.argsort(keys)
    keys, weights, zs, p0 = (x[order] for x in (keys, *(chosen[c].to_numpy(float) for c in ("odds", "z", "p0"))))
    lam = _lambda(weights - drift, p0, drift)
    lowest = max(float((weights - drift)[weights > drift].min(initial=math.inf)), 1e-3) if (weights > drift).any() else 1.0
    model = ToxicityModel(keys, weights, zs, drift, lam, 1.0, 0.0, 0.0, e_max)
    seen, n = train.where("y = 0").mapInArrow(lambda batches: _clean_rows(batches, model, lowest), "seen long, n long").agg(F.coalesce(F.sum("seen"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    k = min((seen + 0.5) / max(1.0, n * math.exp(-lam * lowest)), 1.0)
    model = ToxicityModel(keys, weights, zs, drift, lam, k, 0.0, 0.0, e_max)
    rows = train.mapInArrow(lambda batches: _train_rows(batches, model), "y int, x double").toPandas().sort_values(["y", "x"])  # sample_rows at most
    drop(spark, path, counts_path)
    slope, bias = _logistic(rows["x"].to_numpy(float), rows["y"].to_numpy(float))
    return ToxicityModel(keys, weights, zs, drift, lam, k, slope, bias, e_max)


def _lambda(scores: np.ndarray, p0: np.ndarray, drift: float) -> float:
    """The positive root of sum p exp(lambda s) = 1 over the clean distribution."""
    rest = max(0.0, 1 - float(p0.sum()))
    f = lambda t: float((p0 * np.exp(np.minimum(t * scores, 700))).sum()) + rest * math.exp(-t * drift) - 1
    low, high = 1e-6, 1e-3
    while f(high) < 0 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return max(high, 0.05)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (at least 0) and bias by Newton steps, with Platt's targets and a weak ridge."""
    n1, n0 = float((y == 1).sum()), float((y == 0).sum())
    if not n1 or not n0:
        return 0.0, math.log((n1 + 0.5) / (n0 + 1.5))
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(float(x.std()), 1e-9)
    design, beta = np.stack([x / scale, np.ones_like(x)], 1), np.array([0.0, math.log(n1 / n0)])
    ridge = np.diag([1e-2, 1e-6])
    loss = lambda b: float((np.logaddexp(0, design @ b) - target * (design @ b)).sum()) + 0.5 * float(b @ ridge @ b)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge, design.T @ (p - target) + ridge @ beta)
        t = 1.0
        while t > 1e-6 and loss(beta - t * step) > loss(beta):
            t /= 2
        beta = beta - t * step
        if np.abs(t * step).max() < 1e-9:
            break
    return max(0.0, float(beta[0]) / scale), float(beta[1])


def _found(text: pa.Array, model: ToxicityModel) -> Iterator[tuple[list[tuple[int, int, float]], int]]:
    """The maximal segments and the number of tokens of each text of one piece."""
    w = terms(text)
    s = model.scores(w)
    hot = np.zeros(len(w.bounds) - 1, bool)
    hot[np.searchsorted(w.bounds, np.flatnonzero(s > 0), "right") - 1] = True
    for d, (i, j) in enumerate(zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist())):
        yield segments(s[i:j]) if hot[d] else [], j - i


def _scores_of(found: list[tuple[int, int, float]]) -> np.ndarray:
    return np.array([x for _, _, x in found], float)


def _clean_rows(batches: Iterator[pa.RecordBatch], model: ToxicityModel, lowest: float) -> Iterator[pa.RecordBatch]:
    """How many segments of ``lowest`` or more there are in how many tokens."""
    for batch in batches:
        for part in pieces(batch):
            got = list(_found(part.column(0), model))
            yield pa.RecordBatch.from_arrays([pa.array([sum(int((_scores_of(x) >= lowest).sum()) for x, _ in got)], pa.int64()), pa.array([sum(n for _, n in got)], pa.int64())], names=["seen", "n"])


def _train_rows(batches: Iterator[pa.RecordBatch], model: ToxicityModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            x = [model.evidence(_scores_of(found), n) for found, n in _found(part.column(0), model)]
            yield pa.RecordBatch.from_arrays([part.column(1).cast(pa.int32()), pa.array(x, pa.float64())], names=["y", "x"])


def _scan(text: pa.Array, model: ToxicityModel) -> Iterator[tuple[float, list[dict]]]:
    """Score and passages of each text of one piece."""
    calm = model.probability(0.0)
    for found, n in _found(text, model):
        if not found:
            yield calm, []
            continue
        e = [(a, b, x, model.k * n * math.exp(-min(700.0, model.lam * x))) for a, b, x in found]
        yield model.probability(model.evidence(_scores_of(found), n)), [{"first_word": a, "end_word": b, "score": x, "e_value": v} for a, b, x, v in e if v <= model.e_max]


_PASSAGE = "struct<first_word:long,end_word:long,score:double,e_value:double>"
_ARROW_PASSAGE = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id``, ``score``, ``passages`` (word offsets, score, E-value) of every row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                got = list(_scan(part.column(1), model))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in got], pa.float64()), pa.array([p for _, p in got], _ARROW_PASSAGE)], names=["doc_id", "score", "passages"])

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, score double, passages array<{_PASSAGE}>")


def keep_clean(docs: DataFrame, model: ToxicityModel, limit: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose score is below ``limit``. Narrow: no shuffle.

    A null or empty text has no tokens and the score of clean text; repeated rows are judged alike.
    """
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                yield part.filter(pa.array([x < limit for x, _ in _scan(part.column(column), model)], pa.bool_()))

    return bounded(docs).mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"), "passages")
