"""Basket vectors: means, nearest neighbours, similarity edges, coverage, votes."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from occasio.functions.scalar import doubles
from occasio.operators.baskets import numbered
from occasio.operators.community import released, settled
from occasio.operators.products import product_hashes, sent_numbers
from occasio.sources.tables import merge_refusing_duplicates


#: Entries of all different product vectors that are sent to workers at most: 128 MB in double precision.
SENT_ENTRIES = 16_000_000
#: Rows of one part of a search that are sent to other tasks at most, unless one block of queries takes more.
SENT_ROWS = 8_000_000


def _means_in_rows(baskets: DataFrame, vectors: DataFrame, dim: int) -> DataFrame | None:
    """None if a product has several vectors, or they have not all ``dim`` entries, or are too many to be sent."""
    known = vectors.select("tpnb", "embedding").where("tpnb is not null")
    each = known.select(F.xxhash64("embedding").alias("h"), "embedding").distinct()
    most = SENT_ENTRIES // dim
    if not known.where(F.coalesce(F.size("embedding"), F.lit(-1)) != dim).isEmpty() or each.limit(most + 1).count() > most:
        return None
    got = each.toArrow().combine_chunks()
    h = got["h"].to_numpy()
    order = np.argsort(h)
    numbers = None if len(np.unique(h)) < len(h) else sent_numbers(known.select("tpnb", F.xxhash64("embedding").alias("n")), h[order])
    if numbers is None or not len(h):
        return None
    table = got["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)[order]
    sent = baskets.sparkSession.sparkContext.broadcast(table)
    del got, table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for b in batches:
            size = b["p"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = numbers(b["p"].flatten().to_numpy(zero_copy_only=False))
            of = np.repeat(np.arange(len(size)), size)[at >= 0]
            total, at = np.zeros((len(size), table.shape[1])), at[at >= 0]
            place = np.arange(len(of)) - np.searchsorted(of, of)
            for k in range(place.max(initial=-1) + 1):
                total[of[place == k]] += table[at[place == k]]
            n = np.bincount(of, minlength=len(size))
            mean = pa.array((total / np.maximum(n, 1)[:, None]).ravel())
            yield pa.RecordBatch.from_arrays([b["basket_id"], pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * table.shape[1]), mean)], ["basket_id", "n_used", "embedding"])

    out = baskets.select("basket_id", product_hashes(F.array_distinct("items.tpnb")).alias("p")).mapInArrow(run, "basket_id string, n_used long, embedding array<double>")
    if out.where("n_used > 0").isEmpty():
        raise ValueError("no product of any basket has a vector")
    return out


def mean_vectors(baskets: DataFrame, vectors: DataFrame) -> DataFrame:
    """(basket_id, n_used, embedding): the mean over the basket's products that have a vector; zeros without any.

    ``vectors``: (tpnb, embedding). No vector for any product raises. Each different vector goes to the workers once, up to
    SENT_ENTRIES entries, with its number for each product, and baskets are not shuffled; of more, a product's vector goes to
    its baskets.
    """
    items = baskets.select("basket_id", F.explode_outer(F.array_distinct(F.transform("items", lambda i: i["tpnb"]))).alias("tpnb"))
    known = vectors.select("tpnb", doubles(F.col("embedding")).alias("e"))
    first = known.select(F.size("e").alias("d")).first()
    if first is not None and first["d"] > 0:
        means = _means_in_rows(baskets, vectors, first["d"])
        if means is not None:
            return means
    if first is None or items.join(known, "tpnb", "left_semi").isEmpty():
        raise ValueError("no product of any basket has a vector")
    hit = items.join(known, "tpnb").groupBy("basket_id").agg(F.collect_list("e").alias("all"))
    total = F.aggregate("all", F.array_repeat(F.lit(0.0), first["d"]), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    means = hit.select("basket_id", F.size("all").cast("long").alias("n_used"), F.transform(total, lambda x: x / F.size("all")).alias("embedding"))
    return baskets.select("basket_id").join(means, "basket_id", "left").select("basket_id", F.coalesce("n_used", F.lit(0)).cast("long").alias("n_used"), F.coalesce("embedding", F.array_repeat(F.lit(0.0), first["d"])).alias("embedding"))


def reduced(vectors: DataFrame, key: str, dim: int) -> DataFrame:
    """The first ``dim`` principal components of the vectors."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors.select(key, array_to_vector(doubles(F.col("embedding"))).alias("v"))
    return PCA(k=dim, inputCol="v", outputCol="p").fit(v).transform(v).select(key, vector_to_array("p").alias("embedding"))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1.0)


def _best(q: np.ndarray, b: np.ndarray, qk: np.ndarray, bk: np.ndarray, k: int, *, rows: int = 512, columns: int = 4096, slack: float = 1e-5) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in ``q`` and ``b`` (unit rows, keys of ``b`` ascending) of the ``k`` best of each row of ``q``, and their cosines; exact.

    Products are taken in single precision, and what comes within ``slack`` (some twice the rounding of 64 terms) of the
    best so far is taken again in double precision. Equal ones go by place; a row is none of its own best.
    """
    single, other = q.astype(np.float32), np.ascontiguousarray(b.astype(np.float32).T)
    for lo in range(0, len(q), rows):
        left, keys = single[lo : lo + rows], qk[lo : lo + rows]
        least, found, since = np.full(len(left), -np.inf, np.float32), [], 0
        for n, at in enumerate(range(0, len(b), columns)):
            s = left @ other[:, at : at + columns]
            if not n and s.shape[1] > k + 1:
                least = np.partition(s, -(k + 1), axis=1)[:, -(k + 1)] - np.float32(slack)
            hit = np.flatnonzero(s >= least[:, None])
            found.append((hit // s.shape[1], hit % s.shape[1] + at, s.ravel()[hit]))
            since += 1
            if since > n // 2 and n:  # at twice as many columns the bound is raised
                r, c, v = (np.concatenate(x) for x in zip(*found))
                by = np.lexsort((-v, r))
                r, c, v = r[by], c[by], v[by]
                place = np.arange(len(r)) - np.searchsorted(r, r)
                last = place == k
                least[r[last]] = np.maximum(least[r[last]], v[last] - np.float32(slack))
                ok = v >= least[r]
                found, since = [(r[ok], c[ok], v[ok])], 0
        r, c = (np.concatenate(x) for x in list(zip(*found))[:2])
        ok = keys[r] != bk[c]
        r, c = r[ok], c[ok]
        exact = np.concatenate([np.einsum("ij,ij->i", q[lo + r[i : i + 65536]], b[c[i : i + 65536]]) for i in range(0, len(r), 65536)] or [np.zeros(0)])
        by = np.lexsort((c, -exact, r))
        r, c, exact = r[by], c[by], exact[by]
        ok = np.arange(len(r)) - np.searchsorted(r, r) < k
        yield lo + r[ok], c[ok], exact[ok]


def _best_in_cells(q: DataFrame, b: DataFrame, cell: list[str], key: str, kind: str, k: int) -> DataFrame:
    """(key, neighbour, similarity, rank): of each query the best k rows of the base that share a cell with it.

    A task holds the rows of one cell at a time, so cells bound its memory; a query sends on k rows a cell. Vectors with
    entries that are not finite are no neighbours and have none.
    """

    def side(f: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        v = f["v"].combine_chunks().flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(f.num_rows, -1)
        v = _unit(v.astype(np.float64))
        ok = np.isfinite(v).all(1)
        return (v, f["key"].to_numpy()) if ok.all() else (v[ok], f["key"].to_numpy()[ok])

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out, kinds = [[], [], []], [right.schema.field("key").type] * 2 + [pa.float64()]
        if left.num_rows and right.num_rows:
            right = right.sort_by("key")
            (lv, lk), (rv, rk) = side(left), side(right)
            for r, c, s in _best(lv, rv, lk, rk, k) if len(rk) else ():
                for all_, some in zip(out, (lk[r], rk[c], s)):
                    all_.append(pa.array(some))
        return pa.Table.from_arrays([pa.chunked_array(x, type=t) if x else pa.array([], t) for x, t in zip(out, kinds)], [key, "neighbour", "similarity"])

    found = q.groupBy(*cell).cogroup(b.groupBy(*cell)).applyInArrow(best, f"{key} {kind}, neighbour {kind}, similarity double")
    w = Window.partitionBy(key).orderBy(F.desc("similarity"), "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(queries: DataFrame, base: DataFrame, key: str, k: int, *, block_rows: int = 4096) -> DataFrame:
    """(key, neighbour, similarity, rank) of the ``k`` rows of ``base`` with the greatest cosine to each query; exact.

    The row itself, if in ``base``, is no neighbour of its own. Ties go to the lesser key. Both sides are dealt into
    blocks by hash, and every block of queries meets every block of the base, so the cost grows with the product of the
    rows; memory is bounded by two blocks. Blocks have ``block_rows`` rows, and from 8 blocks on up to 16 times as many, as
    each sends a copy of the other side. Where more than SENT_ROWS rows would be sent, blocks of queries are searched in
    parts, one after another, and what a part has sent is released before the next, so that disk does not grow with the
    product.
    """
    rows = queries.count(), base.count()
    n = [max(1, -(-m // block_rows)) if m <= 8 * block_rows else max(8, -(-m // (16 * block_rows))) for m in rows]
    own = lambda i: F.pmod(F.xxhash64(key), F.lit(n[i]))
    every = lambda lo, hi: F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(hi - 1).cast("long")))
    row = [F.col(key).alias("key"), F.col("embedding").alias("v")]

    def part(queries: DataFrame, base: DataFrame, lo: int, hi: int) -> DataFrame:
        q, b = queries.select(own(0).alias("x"), every(0, n[1]).alias("y"), *row), base.select(every(lo, hi).alias("x"), own(1).alias("y"), *row)
        return _best_in_cells(q, b, ["x", "y"], key, dict(base.dtypes)[key], k)

    step = max(1, SENT_ROWS * n[0] // max(1, rows[0] * n[1] + rows[1] * n[0]))
    if step >= n[0]:
        return part(queries, base, 0, n[0])
    queries, base, found = settled(queries), settled(base), []
    for lo in range(0, n[0], step):
        found.append(settled(part(queries.where(own(0).between(lo, lo + step - 1)), base, lo, min(lo + step, n[0]))))
        released(queries.sparkSession)
    return functools.reduce(DataFrame.unionAll, found)


def centroids(base: DataFrame, key: str, lists: int, *, sample_rows: int = 20_000, rounds: int = 8) -> np.ndarray:
    """Unit centroids of ``lists`` groups, by spherical k-means over a sample of at most ``sample_rows`` rows (those with
    the least hash of the key)."""
    sample = base.select(doubles(F.col("embedding")).alias("v"), F.xxhash64(key).alias("h")).orderBy("h").limit(sample_rows).toPandas()
    x = _unit(np.stack(sample["v"].to_numpy()))
    c = x[: min(lists, len(x))].copy()
    for _ in range(rounds):
        of = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, of, x)
        some = np.bincount(of, minlength=len(c)) > 0
        c[some] = _unit(total[some])
    return c


def _lists(df: DataFrame, key: str, c: np.ndarray, probes: int) -> DataFrame:
    """(key, v, lists): each row once, with the ``probes`` centroids that are the nearest to it."""
    kinds = dict(df.dtypes)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), 1024):
                part = f.iloc[lo : lo + 1024]
                s = _unit(np.stack(part["v"].to_numpy()).astype(np.float64)) @ c.T
                yield part.assign(lists=list(np.argsort(-s, axis=1, kind="stable")[:, :probes].astype(np.int32)))

    return df.select(F.col(key).alias("key"), F.col("embedding").alias("v")).mapInPandas(assign, f"key {kinds[key]}, v {kinds['embedding']}, lists array<int>")


def _cells(sizes: dict[int, int], c: np.ndarray, block_rows: int) -> list[int]:
    """The cell of each list: lists with near centroids together, up to ``block_rows`` rows of the base or one list."""
    coarse = (c @ c[: max(1, -(-sum(sizes.values()) // block_rows))].T).argmax(1)
    out, cell, held = [0] * len(c), 0, 0
    for i in np.argsort(coarse, kind="stable"):
        rows = sizes.get(int(i), 0)
        if held and held + rows > block_rows:
            cell, held = cell + 1, 0
        out[i], held = cell, held + rows
    return out


def nearest_in_lists(queries: DataFrame, base: DataFrame, key: str, k: int, c: np.ndarray, probes: int, *, block_rows: int = 4096) -> DataFrame:
    """As :func:`nearest`, among the rows in the ``probes`` lists that are nearest to a query, and those beside them.

    Lists are put together into cells, and a query is sent to a cell once, however many of its lists are in it: no more
    copies than exact search makes. A cell is dealt into blocks by hash, of queries and of the base, so that a list that
    holds a third of all rows is no task of its own.
    """
    q, b = _lists(queries, key, c, probes), _lists(base, key, c, 1).select("key", "v", F.col("lists")[0].alias("list"))
    cells = F.lit(_cells({r["list"]: r["count"] for r in b.groupBy("list").count().collect()}, c, block_rows))  # a row a list
    b = b.select("key", "v", F.get(cells, F.col("list")).alias("cell"))
    q = q.select("key", "v", F.explode(F.array_distinct(F.transform("lists", lambda i: F.get(cells, i)))).alias("cell"))
    blocks = [df.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).alias(f"n{i}")) for i, df in enumerate((q, b))]
    sizes = F.broadcast(blocks[0].join(blocks[1], "cell"))  # a row a cell
    own = lambda n: F.pmod(F.xxhash64("key"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    q = q.join(sizes, "cell").select("cell", own("n0").alias("x"), every("n1").alias("y"), "key", "v")
    b = b.join(sizes, "cell").select("cell", every("n0").alias("x"), own("n1").alias("y"), "key", "v")
    return _best_in_cells(q, b, ["cell", "x", "y"], key, dict(base.dtypes)[key], k)


def nearest_approximate(queries: DataFrame, base: DataFrame, key: str, k: int, *, recall: float = 0.9, sample: int = 256, block_rows: int = 4096) -> tuple[DataFrame, int, float]:
    """Neighbours by an inverted file of sqrt(rows) lists (4096 at most); and the probes and the recall it was given.

    Every row of the base is in a list. ``sample`` queries (those with the least hash) are also searched exactly, and the
    lists that a query probes are doubled until as many of the exact neighbours are found as ``recall`` asks for; with all
    lists probed the search is exact.
    """
    n = base.count()
    if not n:
        return nearest(queries, base, key, k), 1, 1.0
    c = centroids(base, key, max(1, min(4096, int(n**0.5))))
    some = queries.orderBy(F.xxhash64(key, F.lit(1))).limit(sample)
    want = {(r[key], r["neighbour"]) for r in nearest(some, base, key, k, block_rows=block_rows).select(key, "neighbour").collect()}
    probes = 1
    while True:
        got = {(r[key], r["neighbour"]) for r in nearest_in_lists(some, base, key, k, c, probes, block_rows=block_rows).select(key, "neighbour").collect()}
        found = len(want & got) / max(len(want), 1) if want else 1.0
        if found >= recall or probes >= len(c):
            return nearest_in_lists(queries, base, key, k, c, probes, block_rows=block_rows), probes, found
        probes = min(2 * probes, len(c))


def similarity_edges(neighbours: DataFrame, key: str, *, mutual: bool) -> DataFrame:
    """(basket_a, basket_b, similarity), a < b, each pair once.

    Mutual: both are neighbours of each other, the mean similarity above 0. Else: one is, its similarity above 0, the
    greater one where both are.
    """
    e = neighbours.where(F.col(key) != F.col("neighbour")).select(F.col(key).alias("src"), F.col("neighbour").alias("dst"), "similarity")
    pair = e.select(F.least("src", "dst").alias("basket_a"), F.greatest("src", "dst").alias("basket_b"), "similarity")
    if mutual:
        return pair.groupBy("basket_a", "basket_b").agg(F.avg("similarity").alias("similarity"), F.count("*").alias("n")).where("n = 2 and similarity > 0").drop("n")
    return pair.where("similarity > 0").groupBy("basket_a", "basket_b").agg(F.max("similarity").alias("similarity"))


def with_weight(edges: DataFrame) -> DataFrame:
    """weight: the similarity, min-max scaled over all edges; 0 where all are equal."""
    ends = edges.agg(F.min("similarity").alias("lo"), F.max("similarity").alias("hi"))
    x = F.when(F.col("hi") > F.col("lo"), (F.col("similarity") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))).otherwise(0.0)
    return edges.crossJoin(F.broadcast(ends)).select("basket_a", "basket_b", "similarity", x.alias("weight"))


def endpoints(edges: DataFrame) -> DataFrame:
    """Both ends of every edge from one scan."""
    return edges.select(F.explode(F.array("basket_a", "basket_b")).alias("id"))


def coverage(edges: DataFrame, universe: DataFrame, key: str) -> DataFrame:
    """n_covered, n_total, share: how much of the population has an edge."""
    hit = universe.select(F.col(key).alias("id")).distinct().join(endpoints(edges).distinct().withColumn("hit", F.lit(1)), "id", "left")
    return hit.agg(F.count("hit").alias("n_covered"), F.count("*").alias("n_total")).withColumn("share", F.col("n_covered") / F.greatest(F.col("n_total"), F.lit(1)))


def check_coverage(edges: DataFrame, universe: DataFrame, key: str, floor: float) -> float:
    share = coverage(edges, universe, key).first()["share"]
    if share < floor:
        raise ValueError(f"the graph covers {share:.1%} of the population; at least {floor:.1%} is asked for")
    return share


def coverage_probe(neighbours: DataFrame, universe: DataFrame, key: str, ks: tuple[int, ...]) -> DataFrame:
    """(k, n_covered, n_total, share): mutual coverage for several k from one search with the largest."""
    e = neighbours.where("similarity > 0").select(F.col(key).alias("src"), F.col("neighbour").alias("dst"), "rank")
    both = e.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("rank").alias("back")), ["src", "dst"])
    need = both.groupBy("src").agg(F.min(F.greatest("rank", "back")).alias("k_min"))
    total = universe.agg(F.count("*").alias("n_total"))
    tried = neighbours.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    counts = F.broadcast(tried).join(need.groupBy("k_min").count(), F.col("k_min") <= F.col("k"), "left").groupBy("k").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n_covered"))
    return counts.crossJoin(F.broadcast(total)).select("k", "n_covered", "n_total", (F.col("n_covered") / F.col("n_total")).alias("share"))


def vertex_index(edges: DataFrame) -> DataFrame:
    """(id, vertex): endpoints numbered from 0 in order, text ids too. A null end raises."""
    if not edges.where("basket_a is null or basket_b is null").isEmpty():
        raise ValueError("an edge has a null end")
    return numbered(endpoints(edges).distinct(), "id", ["id"], "vertex").withColumn("vertex", F.col("vertex") - 1)


def vote(neighbours: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """(key, need_state_cluster, cluster_confidence): the label most of the neighbours have; ties to the least label.

    ``neighbours`` come from a search among labelled rows only. Confidence is the label's share of them. A key that two
    rows of ``labels`` have raises.
    """
    labels = merge_refusing_duplicates(labels, key)
    return _most(neighbours.join(labels.select(F.col(key).alias("neighbour"), F.col("label")), "neighbour"), key)


def _most(labelled: DataFrame, key: str) -> DataFrame:
    n = labelled.groupBy(key, "label").agg(F.count("*").alias("n"))
    best = n.groupBy(key).agg(F.max(F.struct("n", (-F.col("label")).alias("minus"))).alias("m"), F.sum("n").alias("all"))
    return best.select(key, (-F.col("m.minus")).alias("need_state_cluster"), (F.col("m.n") / F.col("all")).alias("cluster_confidence"))


#: Rows that stand for others and are sent to all tasks at most.
FEW = 200_000


def vote_of_nearest(queries: DataFrame, base: DataFrame, labels: DataFrame, key: str, k: int, search: Callable[..., DataFrame] | None = None) -> DataFrame:
    """As :func:`vote` of the ``k`` nearest labelled rows of ``base``, with one search for all rows of equal vectors.

    One query stands for all with its vector, and one row of the base for all with its own, of which the k + 1 least keys
    alone can be neighbours (ties go to the lesser key; one may be the query itself). Vectors count as equal if two 64-bit
    fingerprints are. ``queries`` and ``base`` are computed twice; keys are text, and one that ``base`` has twice raises.
    """
    marks = {"a": F.xxhash64("embedding"), "b": F.xxhash64(F.lit(1), "embedding")}

    def standing(df: DataFrame, first: DataFrame) -> DataFrame:
        first = first.select(F.col("stand").alias(key), "a", "b")
        return df.withColumns(marks).join(F.broadcast(first) if first.limit(FEW + 1).count() <= FEW else first, [key, "a", "b"], "left_semi").select(key, "embedding")

    labels = merge_refusing_duplicates(labels, key)
    voters = settled(base.withColumns(marks).select(key, "a", "b").join(labels.select(key, "label"), key))
    merge_refusing_duplicates(voters, key)
    kept = settled(voters.withColumn("place", F.row_number().over(Window.partitionBy("a", "b").orderBy(key))).where(F.col("place") <= k + 1))
    # A query that is a row of the base too stands for itself alone.
    own = F.when(F.col("there"), F.concat(F.lit("="), key)).otherwise(F.lit(""))
    asked = settled(queries.withColumns(marks).select(key, "a", "b").join(voters.select(key, F.lit(True).alias("there")), key, "left").select(key, "a", "b", own.alias("own")))
    groups = settled(asked.groupBy("a", "b", "own").agg(F.min(key).alias("stand")))
    released(queries.sparkSession)
    # No key of the base is that of a row that asks: whether a neighbour is the query itself is settled below.
    q = settled(standing(queries, groups).withColumn(key, F.concat(F.lit("\x00"), key)))
    b = settled(standing(base, kept.where("place = 1").withColumnRenamed(key, "stand")))
    released(queries.sparkSession)
    found = settled((search or nearest)(q, b, key, k + 1).select(F.substring(key, 2, 1 << 30).alias("stand"), F.col("neighbour").alias(key), "similarity"))
    # Of each query the rows of the base that stand for so many that those before them are too few.
    sizes = kept.groupBy("a", "b").agg(F.min(key).alias(key), F.count("*").alias("n"))
    by = Window.partitionBy("stand")
    before = F.sum("n").over(by.orderBy(F.desc("similarity"))) - F.sum("n").over(Window.partitionBy("stand", "similarity"))
    enough = found.join(sizes, key).withColumn("before", before).where(F.col("before") <= k)
    rows = enough.select("stand", "similarity", "a", "b").join(kept, ["a", "b"]).where(F.col(key) != F.col("stand"))
    best = rows.withColumn("rank", F.row_number().over(by.orderBy(F.desc("similarity"), key))).where(F.col("rank") <= k)
    got = _most(best.select("stand", "label"), "stand")
    return asked.join(groups.join(got, "stand").drop("stand"), ["a", "b", "own"]).select(key, "need_state_cluster", "cluster_confidence")


def health(vectors: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """One row of checks: non-finite entries, mean spread, dead dimensions, largest label, rows without a label."""
    cells = vectors.select(F.posexplode(doubles(F.col("embedding"))).alias("d", "x"))
    bad = F.isnan("x") | (F.abs("x") == float("inf")) | F.col("x").isNull()
    spread = cells.groupBy("d").agg(F.sum(bad.cast("long")).alias("bad"), F.stddev_pop(F.when(~bad, F.col("x"))).alias("s"))
    dims = spread.agg(F.sum("bad").alias("n_non_finite"), F.avg("s").alias("mean_std"), F.sum((F.col("s") < 1e-6).cast("long")).alias("n_dead_dims"))
    sizes = labels.where("label <> -1").groupBy("label").agg(F.count("*").alias("n"))
    share = sizes.agg((F.max("n") / F.sum("n")).alias("largest_share"))
    without = vectors.join(labels.where("label is not null").select(key), key, "left_anti").agg(F.count("*").alias("n_unlabelled"))
    return dims.crossJoin(share).crossJoin(without).withColumn("collapsed", (F.col("mean_std") < 1e-4) | (F.col("largest_share") > 0.9))
