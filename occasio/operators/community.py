"""Communities of the similarity graph: Leiden, modularity, components, comparison of partitions."""

from __future__ import annotations

import gc
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNCLUSTERED = -1


def settled(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage: a table in spark.checkpoint.dir where that is set, else a reliable checkpoint."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        path = f"{root.rstrip('/')}/occasio-step-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    if spark.sparkContext.getCheckpointDir() is None:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("on a cluster, set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="occasio-"))
    return df.checkpoint()


def released(spark) -> None:
    """Ask for the collection of what nothing refers to any more, so that shuffle files of settled steps go now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable. Rounds of hooking and pointer jumping, each cut from the last."""
    both = settled(edges.select(F.col("basket_a").alias("a"), F.col("basket_b").alias("b")).union(edges.select("basket_b", "basket_a")).distinct())
    labels = settled(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("near")), "b").groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        hooked = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("new"))
        offers = hooked.select("id", "new").union(hooked.where("new < component").select(F.col("component").alias("id"), "new")).groupBy("id").agg(F.min("new").alias("new"))
        jumped = offers.join(offers.select(F.col("id").alias("new"), F.col("new").alias("far")), "new", "left").select("id", F.least("new", F.coalesce("far", "new")).alias("component"))
        now = settled(jumped)
        if now.join(labels.select("id", F.col("component").alias("old")), "id").where("component <> old").isEmpty():
            return now
        labels = now


def component_sizes(edges: DataFrame) -> DataFrame:
    """(component, n_vertices) of every component."""
    return connected_components(edges).groupBy("component").agg(F.count("*").alias("n_vertices"))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: Q of a partition (id, label) of a weighted graph, each label's inner weight less what chance gives."""
    a = labels.select(F.col("id").alias("basket_a"), F.col("label").alias("la"))
    b = labels.select(F.col("id").alias("basket_b"), F.col("label").alias("lb"))
    e = edges.join(a, "basket_a").join(b, "basket_b").select("la", "lb", "weight")
    both = e.select(F.explode(F.array(F.struct(F.col("la").alias("label"), (F.col("la") == F.col("lb")).alias("inner")), F.struct(F.col("lb").alias("label"), F.lit(False).alias("inner")))).alias("x"), "weight").select("x.*", "weight")
    per = both.groupBy("label").agg(F.sum(F.when(F.col("inner"), F.col("weight")).otherwise(0.0)).alias("inside"), F.sum("weight").alias("degree"))
    total = e.agg(F.sum("weight").alias("m"))
    q = F.sum(F.col("inside") / F.col("m") - resolution * F.pow(F.col("degree") / (2 * F.col("m")), F.lit(2.0)))
    return per.crossJoin(F.broadcast(total.where("m > 0"))).agg(F.coalesce(q, F.lit(0.0)).alias("modularity"))


def community_sizes(labels: DataFrame) -> DataFrame:
    """(label, n) of the labelled rows."""
    return labels.where(F.col("label") != UNCLUSTERED).groupBy("label").agg(F.count("*").alias("n"))


def size_summary(labels: DataFrame) -> DataFrame:
    """n_communities, largest_share, median_size, hub_collapse (one community holds over half)."""
    s = community_sizes(labels)
    return s.agg(F.count("*").alias("n_communities"), (F.max("n") / F.sum("n")).alias("largest_share"), F.median("n").alias("median_size")).withColumn("hub_collapse", F.col("largest_share") > 0.5)


def adjusted_rand(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: n and the adjusted Rand index of two labelings (id, label), over rows that both label."""
    x = a.where(F.col("label") != UNCLUSTERED).select("id", F.col("label").alias("x")).join(b.where(F.col("label") != UNCLUSTERED).select("id", F.col("label").alias("y")), "id")
    cells = x.groupBy("x", "y").agg(F.count("*").cast("double").alias("n"))
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    inner = cells.agg(F.sum(pairs("n")).alias("s"), F.sum("n").alias("n"))
    rows = cells.groupBy("x").agg(F.sum("n").alias("n")).agg(F.sum(pairs("n")).alias("r"))
    cols = cells.groupBy("y").agg(F.sum("n").alias("n")).agg(F.sum(pairs("n")).alias("c"))
    chance = F.col("r") * F.col("c") / F.nullif(pairs("n"), F.lit(0.0))
    spread = (F.col("r") + F.col("c")) / 2 - chance
    return inner.crossJoin(rows).crossJoin(cols).select(F.col("n").cast("long").alias("n"), F.when(spread == 0, 1.0).otherwise((F.col("s") - chance) / F.nullif(spread, F.lit(0.0))).alias("ari"))


def with_unclustered(labels: DataFrame, universe: DataFrame) -> DataFrame:
    """Every id of the universe; -1 where the graph gave no label."""
    return universe.select("id").distinct().join(labels.select("id", "label"), "id", "left").select("id", F.coalesce("label", F.lit(UNCLUSTERED)).alias("label"))


def combined(leiden: DataFrame, mixture: DataFrame) -> DataFrame:
    """(basket_id, need_state_cluster, need_state_cluster_gmm, gmm_confidence) of both labelings."""
    return leiden.join(mixture, "basket_id", "full").select("basket_id", F.coalesce("need_state_cluster", F.lit(UNCLUSTERED)).alias("need_state_cluster"), "need_state_cluster_gmm", "gmm_confidence")


class _Graph:
    """Adjacency of a weighted graph in compressed rows, with node weights for aggregated graphs."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray):
        inner = a == b
        self.n, self.loops = n, np.bincount(a[inner], w[inner], n)
        src, dst, ww = np.concatenate([a[~inner], b[~inner]]), np.concatenate([b[~inner], a[~inner]]), np.concatenate([w[~inner]] * 2)
        order = np.lexsort((dst, src))
        self.dst, self.w = dst[order], ww[order]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))])
        self.degree = np.bincount(src, ww, n) + 2 * self.loops

    def near(self, v: int) -> tuple[np.ndarray, np.ndarray]:
        s = slice(self.at[v], self.at[v + 1])
        return self.dst[s], self.w[s]


def _move(g: _Graph, label: np.ndarray, resolution: float, total: float, rng: np.random.Generator, within: np.ndarray | None = None) -> bool:
    """Local moving: each node goes to the neighbouring label that gains most, until none gains. ``within``: only labels
    of the same value there, and only nodes that are alone (refinement)."""
    weight = np.bincount(label, g.degree, g.n)
    count = np.bincount(label, minlength=g.n)
    queue, queued, moved = list(rng.permutation(g.n)), np.ones(g.n, bool), False
    while queue:
        nxt = []
        for v in queue:
            queued[v] = False
            old = label[v]
            if within is not None and count[old] > 1:
                continue
            near, w = g.near(v)
            if within is not None:
                same = within[near] == within[v]
                near, w = near[same], w[same]
            if not len(near):
                continue
            labels, inv = np.unique(label[near], return_inverse=True)
            gain = np.bincount(inv, w) - resolution * g.degree[v] * (weight[labels] - np.where(labels == old, g.degree[v], 0)) / total
            stay = gain[labels == old][0] if (labels == old).any() else -resolution * g.degree[v] * (weight[old] - g.degree[v]) / total
            k = int(np.argmax(gain))  # ties: the least label
            if gain[k] > stay + 1e-12 and labels[k] != old:
                label[v] = labels[k]
                weight[old] -= g.degree[v]
                weight[labels[k]] += g.degree[v]
                count[old] -= 1
                count[labels[k]] += 1
                moved = True
                if within is None:
                    for u in near[label[near] != labels[k]]:
                        if not queued[u]:
                            queued[u] = True
                            nxt.append(u)
        queue = nxt
    return moved


def leiden_arrays(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, resolution: float, iterations: int = 10, seed: int = 42) -> np.ndarray:
    """Leiden communities (Traag, Waltman and van Eck, 2019) of a graph with nodes 0 to n - 1; labels by least node."""
    rng = np.random.default_rng(seed)
    if not len(w) or w.sum() <= 0:
        w = np.ones(len(a))
    label = np.arange(n)
    for _ in range(iterations):
        before = label.copy()
        g, home, part = _Graph(n, a, b, w), np.arange(n), _least(label)
        total = max(float(g.degree.sum()), 1e-300)
        while True:
            part = part.copy()
            moved = _move(g, part, resolution, total, rng)
            fine = np.arange(g.n)
            _move(g, fine, resolution, total, rng, within=part)
            ids, fine = np.unique(fine, return_inverse=True)
            if not moved and len(ids) == g.n or len(ids) == g.n and len(np.unique(part)) == g.n:
                break
            if len(ids) == g.n:
                ids, fine = np.unique(part, return_inverse=True)  # nothing was refined: aggregate the parts themselves
            src = np.repeat(np.arange(g.n), np.diff(g.at))
            up = src < g.dst
            x, y = np.minimum(fine[src[up]], fine[g.dst[up]]), np.maximum(fine[src[up]], fine[g.dst[up]])
            loop = np.bincount(fine, g.loops, len(ids))
            coarse = pd.DataFrame({"x": np.concatenate([x, np.arange(len(ids))]), "y": np.concatenate([y, np.arange(len(ids))]), "w": np.concatenate([g.w[up], loop])}).groupby(["x", "y"], as_index=False)["w"].sum()
            first = np.zeros(len(ids), np.int64)
            first[fine] = part
            _, part = np.unique(first, return_inverse=True)
            part = _least(part)
            home = fine[home]
            g = _Graph(len(ids), coarse["x"].to_numpy(), coarse["y"].to_numpy(), coarse["w"].to_numpy())
        label = _least(part[home])
        if (label == _least(before)).all():
            break
    return np.unique(_least(label), return_inverse=True)[1]


def _least(label: np.ndarray) -> np.ndarray:
    """Each label as the least position that has it."""
    _, first, inv = np.unique(label, return_index=True, return_inverse=True)
    return first[inv]


def leiden(edges: DataFrame, resolution: float = 1.0, iterations: int = 10, seed: int = 42, *, universe: DataFrame | None = None, method: str = "driver", edge_cap: int = 2_000_000) -> DataFrame:
    """(id, label) by Leiden: on the driver, which holds at most ``edge_cap`` edges (more raise), or, with the method
    "joins", by :func:`leiden_joins` at any size. The method is the caller's choice; it never follows from the size.

    With a ``universe`` (id), rows outside the graph have label -1.
    """
    if method == "joins":
        got = leiden_joins(edges, resolution)
    elif method != "driver":
        raise ValueError(f"no method {method!r}")
    elif edges.limit(edge_cap + 1).count() > edge_cap:
        raise ValueError(f"more than {edge_cap} edges do not go to the driver; use the method 'joins'")
    else:
        pdf = edges.select("basket_a", "basket_b", "weight").toPandas()
        ids, inv = np.unique(np.concatenate([pdf["basket_a"].to_numpy(), pdf["basket_b"].to_numpy()]), return_inverse=True)
        label = leiden_arrays(len(ids), inv[: len(pdf)], inv[len(pdf) :], pdf["weight"].to_numpy(float), resolution, iterations, seed) if len(pdf) else np.zeros(0, int)
        kind = dict(edges.dtypes)["basket_a"]
        got = edges.sparkSession.createDataFrame(pd.DataFrame({"id": ids, "label": label.astype(np.int64)}), f"id {kind}, label long") if len(pdf) else edges.sparkSession.createDataFrame([], f"id {kind}, label long")
    return got if universe is None else with_unclustered(got, universe)


def _links(both: DataFrame, state: DataFrame) -> DataFrame:
    """(v, label, w): the weight of each node's links to each label next to it."""
    return both.join(state.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v"), "label").agg(F.sum("w").alias("w"))


def _gain(total: float, resolution: float) -> Column:
    """What a node with degree k gains in a label with the given mass, of which it is no part."""
    return F.col("w") - resolution * F.col("k") * F.col("mass") / (2 * total)


def _best(options: DataFrame) -> DataFrame:
    """(v, to): the option with the greatest gain of each node, ties to the least label, where it beats staying."""
    top = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("gain"), "label"))
    return options.withColumn("rn", top).where("rn = 1 and gain > stay + 1e-12").select("v", F.col("label").alias("to"))


def _quality(both: DataFrame, state: DataFrame, loops: float, total: float, resolution: float) -> float:
    x, y = (state.select(F.col("v").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
    inside = both.join(x, "a").join(y, "b").where("la = lb").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    mass = state.groupBy("label").agg(F.sum("k").alias("m")).agg(F.coalesce(F.sum(F.col("m") * F.col("m")), F.lit(0.0))).first()[0]
    return (inside / 2 + loops) / total - resolution * mass / (2 * total) ** 2


def _moved(both: DataFrame, state: DataFrame, loops: float, total: float, resolution: float) -> tuple[DataFrame, bool]:
    """Local moving. In a round one hash-coloured half of the nodes moves, so that neighbours do not swap; rounds go on
    until neither half moves, or two rounds raise the quality by less than 1e-7."""
    any_moved, r, still, before = False, 0, 0, _quality(both, state, loops, total, resolution)
    while still < 2:
        mass = state.groupBy("label").agg(F.sum("k").alias("mass"))
        mine = state.where(F.pmod(F.xxhash64("v", F.lit(r // 2)), F.lit(2)) == r % 2).select("v", F.col("label").alias("old"), "k")
        options = _links(both, state).unionByName(mine.select("v", F.col("old").alias("label"), F.lit(0.0).alias("w"))).groupBy("v", "label").agg(F.sum("w").alias("w"))
        options = options.join(mine, "v").join(mass, "label").withColumn("mass", F.col("mass") - F.when(F.col("label") == F.col("old"), F.col("k")).otherwise(0.0))
        options = options.withColumn("gain", _gain(total, resolution))
        stay = F.max(F.when(F.col("label") == F.col("old"), F.col("gain"))).over(Window.partitionBy("v"))
        to = _best(options.withColumn("stay", stay).where("label <> old or gain = stay"))
        now = settled(state.join(to, "v", "left").select("v", F.coalesce("to", "label").alias("label"), "k", (F.col("to") != F.col("label")).alias("moved")))
        moved = not now.where("moved").isEmpty()
        any_moved |= moved
        state, still, r = now.drop("moved"), 0 if moved else still + 1, r + 1
        if not r % 2 and moved:
            quality = _quality(both, state, loops, total, resolution)
            if quality < before + 1e-7:
                break
            before = quality
    return state, any_moved


def _refined(both: DataFrame, state: DataFrame, total: float, resolution: float) -> DataFrame:
    """(v, label, k): labels inside the labels of ``state``, each connected.

    All nodes begin alone. One that is still alone may join a label next to it of the same part, if it gains; only nodes
    of one hash-coloured half move in a round, and none to a node that may itself move away.
    """
    x, y = (state.select(F.col("v").alias(c), F.col("label").alias(f"p{c}")) for c in "ab")
    inner = settled(both.join(x, "a").join(y, "b").where("pa = pb").select("a", "b", "w"))
    fine, r, still = settled(state.select("v", F.col("v").alias("label"), "k")), 0, 0
    while still < 2:
        half = F.pmod(F.xxhash64("v", F.lit(r // 2)), F.lit(2)) == r % 2
        per = fine.groupBy("label").agg(F.sum("k").alias("mass"), F.count("*").alias("n"), F.max(half).alias("goes"))
        movers = fine.where(half).join(per.where("n = 1").select("label"), "label").select("v", "k")
        options = _links(inner, fine).join(movers, "v").join(per.where("n > 1 or not goes"), "label").where(F.col("label") != F.col("v"))
        to = _best(options.withColumn("gain", _gain(total, resolution)).withColumn("stay", F.lit(0.0)))
        now = settled(fine.join(to, "v", "left").select("v", F.coalesce("to", "label").alias("label"), "k", F.col("to").isNotNull().alias("moved")))
        still, r = 0 if not now.where("moved").isEmpty() else still + 1, r + 1
        fine = now.drop("moved")
    return fine


def leiden_joins(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(id, label): Leiden (Traag, Waltman and van Eck, 2019) as joins and aggregates, for graphs of any size.

    Levels of local moving, refinement inside the labels that it finds, and aggregation of the refined labels into the
    nodes of a smaller graph, which begin with the labels found; until a level moves nothing. Every label is connected.
    """
    graph = settled(edges.select(F.col("basket_a").alias("a"), F.col("basket_b").alias("b"), F.col("weight").cast("double").alias("w")))
    total = graph.agg(F.sum("w")).first()[0] or 0.0
    if total <= 0:
        graph, total = settled(graph.withColumn("w", F.lit(1.0))), float(graph.count())
    home, begin = None, None
    while True:
        both = settled(graph.where("a <> b").select("a", "b", "w").union(graph.where("a <> b").select("b", "a", "w")))
        loops = graph.where("a = b").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
        degree = graph.select(F.explode(F.array("a", "b")).alias("v"), "w").groupBy("v").agg(F.sum("w").alias("k"))
        state = settled(degree.select("v", F.col("v").alias("label"), "k") if begin is None else degree.join(begin, "v").select("v", "label", "k"))
        state, moved = _moved(both, state, loops, total, resolution)
        named = state.select("v", "label")
        home = settled(named.select(F.col("v").alias("id"), F.col("v"), "label") if home is None else home.select("id", "v").join(named, "v").select("id", "v", "label"))
        if not moved:
            break
        fine = _refined(both, state, total, resolution)
        if fine.where("v <> label").isEmpty():  # nothing was refined: aggregate the labels themselves
            fine = state
        up = settled(fine.select("v", F.col("label").alias("up")))
        if up.select("up").distinct().count() == up.count():
            break
        least = up.join(named, "v").groupBy("label").agg(F.min("up").alias("least"))
        begin = settled(up.join(named, "v").join(least, "label").select(F.col("up").alias("v"), F.col("least").alias("label")).distinct())
        home = settled(home.join(up, "v").select("id", F.col("up").alias("v"), "label"))
        x, y = up.select(F.col("v").alias("a"), F.col("up").alias("x")), up.select(F.col("v").alias("b"), F.col("up").alias("y"))
        graph = settled(graph.join(x, "a").join(y, "b").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("w")))
    inner = edges.join(home.select(F.col("id").alias("basket_a"), F.col("label").alias("la")), "basket_a").join(home.select(F.col("id").alias("basket_b"), F.col("label").alias("lb")), "basket_b").where("la = lb")
    parts = connected_components(inner.select("basket_a", "basket_b"))
    least = settled(home.join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("part")))
    from occasio.operators.baskets import numbered

    return least.join(numbered(least.select("part").distinct(), "part", ["part"], "label").withColumn("label", F.col("label") - 1), "part").select("id", "label")


def resolution_sweep(edges: DataFrame, resolutions: tuple[float, ...], seed: int = 42, method: str = "driver") -> DataFrame:
    """(resolution, n_clusters, modularity, min/median/max size, largest_share): a table to choose from."""
    rows = []
    for r in resolutions:
        got = settled(leiden(edges, r, seed=seed, method=method))
        s = community_sizes(got).agg(F.count("*"), F.min("n"), F.median("n"), F.max("n"), F.max("n") / F.sum("n")).first()
        rows.append((float(r), int(s[0]), float(modularity(edges, got, r).first()[0]), int(s[1] or 0), float(s[2] or 0), int(s[3] or 0), float(s[4] or 0)))
    return edges.sparkSession.createDataFrame(rows, "resolution double, n_clusters long, modularity double, min_size long, median_size double, max_size long, largest_share double")
