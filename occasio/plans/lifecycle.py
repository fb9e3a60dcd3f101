"""The engine end to end: purchases to need-states, need-states to their description, new purchases to labels.

Each step's table is kept under a manifest of its inputs' digests and of the settings that bear on it, so a step runs
again only if those change.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from occasio.config import Config
from occasio.operators import baskets as B
from occasio.operators import community as C
from occasio.operators import profiles as R
from occasio.operators import states as N
from occasio.operators import vectors as V
from occasio.progress import step
from occasio.sources.artifacts import ArtifactCache
from occasio.sources.tables import PURCHASES, content_digest, require_columns, upsert_log


@dataclass(frozen=True)
class Run:
    """Tables of one run; ``edges`` and ``labels`` name vertices by basket_seq."""

    baskets: DataFrame
    vectors: DataFrame
    edges: DataFrame
    labels: DataFrame
    adjacency: DataFrame
    transitions: DataFrame
    manifest: dict


def similarity_graph(vectors: DataFrame, key: str, config: Config) -> DataFrame:
    """Edges of the nearest neighbours, with weights."""
    if config.knn_method == "exact":
        near = V.nearest(vectors, vectors, key, config.knn_k)
    else:
        near, _, _ = V.nearest_approximate(vectors, vectors, key, config.knn_k, recall=config.knn_recall)
    return V.with_weight(V.similarity_edges(near, key, mutual=config.mutual_knn))


def cluster(vectors: DataFrame, key: str, config: Config, edges: DataFrame | None = None) -> DataFrame:
    """(id, label) of every row: the graph, its coverage checked, and its communities; -1 outside the graph."""
    edges = C.settled(similarity_graph(vectors, key, config)) if edges is None else edges
    V.check_coverage(edges, vectors, key, config.min_graph_coverage)
    return C.leiden(edges, config.resolution, config.leiden_iterations, config.seed, universe=vectors.select(F.col(key).alias("id")), method=config.leiden_method, edge_cap=config.leiden_edge_cap)


def train(spark: SparkSession, txn: DataFrame, product_vectors: DataFrame, root: str, config: Config | None = None) -> Run:
    """From purchase rows (see ``PURCHASES``) and product vectors (tpnb, embedding) to need-states and their graphs."""
    config, cache = config or Config(), ArtifactCache(spark, root)
    require_columns(txn, PURCHASES, "purchases")
    say = lambda text: None
    inputs = {"purchases": content_digest(txn).first()["digest"], "vectors": content_digest(product_vectors).first()["digest"]}

    def kept(kind: str, names: tuple[str, ...], build) -> DataFrame:
        with step(kind, spark, say):
            return cache.get(kind, {**inputs, "settings": config.fingerprint(*names)}, build)

    base = ("min_basket_products",)
    baskets = kept("baskets", base, lambda: B.numbered(B.build_baskets(txn, config.min_basket_products), "household_number", ["household_number", "year_week_number"]))
    vectors = kept("vectors", base, lambda: V.mean_vectors(baskets.select("basket_id", "items"), product_vectors).join(baskets.select("basket_id", "basket_seq"), "basket_id").where("n_used > 0").select("basket_seq", "basket_id", "embedding"))
    graph = (*base, "knn_k", "mutual_knn", "knn_method", "knn_recall")
    edges = kept("edges", graph, lambda: similarity_graph(vectors.select("basket_seq", "embedding"), "basket_seq", config))
    parts = (*graph, "resolution", "leiden_iterations", "seed", "leiden_method", "leiden_edge_cap", "min_graph_coverage")
    labels = kept("labels", parts, lambda: cluster(vectors.select("basket_seq", "embedding"), "basket_seq", config, edges).join(vectors.select(F.col("basket_seq").alias("id"), "basket_id"), "id").select("id", "basket_id", "label"))
    named = labels.where(F.col("label") != N.UNCLUSTERED)
    by_seq = named.select(F.col("id").alias("basket_id"), "label")
    adjacency = kept("adjacency", parts, lambda: N.adjacency(edges, by_seq))
    transitions = kept("transitions", (*parts, "max_week_gap", "min_transition_support"), lambda: N.transitions(named.select("basket_id", "label"), "label", config.max_week_gap, config.min_transition_support))
    return Run(baskets, vectors, edges, labels, adjacency, transitions, {**inputs, "settings": config.fingerprint(*parts)})


@dataclass(frozen=True)
class Description:
    profiles: DataFrame
    summary: DataFrame
    score: DataFrame


def describe(name: str, run: Run, lookup: DataFrame, config: Config | None = None, log: DataFrame | None = None) -> tuple[Description, DataFrame]:
    """Profiles, summary and scorecard of a run with the excess over its own permutation null; and the log with its row.

    ``lookup``: (tpnb, description, department).
    """
    config = config or Config()
    labels = run.labels.select("basket_id", "label")

    def one(run_name: str, named: DataFrame) -> Description:
        counts = C.settled(R.state_product_counts(run.baskets, named))
        profiles = C.settled(R.profiles(counts, lookup, config.profile_top_n, config.min_product_baskets))
        summary = C.settled(R.enriched(R.summary(run.baskets, named), profiles))
        return Description(profiles, summary, C.settled(R.scorecard(run_name, named, profiles, summary)))

    real = one(name, labels)
    null = one(f"{name}-null", C.settled(R.permuted(labels, config.seed)))
    row = C.settled(R.with_null(real.score, null.score, warn=lambda _: None))
    return Description(real.profiles, real.summary, row), upsert_log(log, row)
