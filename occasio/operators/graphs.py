"""Product graphs: co-purchase over all baskets, and the graph inside each basket."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from occasio.functions.scalar import finite_or_zero, log_units, minmax_within
from occasio.operators.community import released, settled


def copurchase(baskets: DataFrame, *, diagonal: bool = False) -> DataFrame:
    """(a, b, n): in how many baskets two products are together, a < b; with the diagonal, a = b counts a product's own.

    Pairs are made inside the row, from the basket's distinct products, and counted before the shuffle: no self-join.
    A basket of m products makes m (m - 1) / 2 pairs; the exploded first product spreads a large basket's pairs.
    """
    products = baskets.select(F.array_sort(F.array_distinct(F.transform("items", lambda i: i["tpnb"]))).alias("p"))
    first = products.select("p", F.posexplode("p").alias("i", "a"))
    rest = F.slice("p", F.col("i") + (1 if diagonal else 2), F.size("p"))
    return first.select("a", F.explode(rest).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


def basket_nodes(baskets: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(basket_id, tpnb, units): products of a basket with their summed units.

    A null quantity counts 1 where the product comes first in the basket and 0 after that. ``known`` (tpnb) limits the
    products to those that have a vector.
    """
    rows = baskets.select("basket_id", F.posexplode("items").alias("at", "i")).select("basket_id", "at", "i.tpnb", "i.quantity")
    if known is not None:
        rows = rows.join(known.select("tpnb"), "tpnb", "left_semi")
    first_null = F.min(F.struct("at", F.col("quantity").isNull().alias("none")))["none"]
    return rows.groupBy("basket_id", "tpnb").agg((F.coalesce(F.sum("quantity"), F.lit(0.0)) + F.when(first_null, 1.0).otherwise(0.0)).alias("units"))


def basket_pairs(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """(basket_id, src, dst, n): both directions of the pairs inside a basket that are bought together anywhere."""
    grouped = nodes.groupBy("basket_id").agg(F.array_sort(F.collect_set("tpnb")).alias("p"))
    first = grouped.select("basket_id", "p", F.posexplode("p").alias("i", "a"))
    pairs = first.select("basket_id", "a", F.explode(F.slice("p", F.col("i") + 2, F.size("p"))).alias("b"))
    both = pairs.join(counts.where("a < b and n > 0"), ["a", "b"])
    return both.select("basket_id", F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e"), "n").select("basket_id", "e.src", "e.dst", "n")


def cp_score(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(basket_id, tpnb, cp_score): log1p of the mean co-purchase with the basket's other products, scaled inside it."""
    sums = pairs.groupBy("basket_id", F.col("src").alias("tpnb")).agg(F.sum("n").alias("s"))
    raw = nodes.select("basket_id", "tpnb").join(sums, ["basket_id", "tpnb"], "left").withColumn("m", F.count("*").over(Window.partitionBy("basket_id")))
    value = F.when(F.col("m") > 1, F.log1p(F.coalesce("s", F.lit(0)).cast("double") / F.greatest(F.col("m") - 1, F.lit(1)))).otherwise(F.lit(0.0))
    scored = raw.select("basket_id", "tpnb", "m", value.alias("v"))
    return scored.select("basket_id", "tpnb", F.when(F.col("m") > 1, minmax_within(F.col("v"), "basket_id")).otherwise(F.lit(0.0)).alias("cp_score"))


def basket_edges(pairs: DataFrame, top_k: int = 10) -> DataFrame:
    """(basket_id, src, dst, log_cp, rel): each product's strongest partners in the basket; ties by product."""
    w = Window.partitionBy("basket_id", "src")
    ranked = pairs.withColumn("rn", F.row_number().over(w.orderBy(F.desc("n"), "dst"))).withColumn("most", F.max("n").over(w))
    return ranked.where(F.col("rn") <= top_k).select("basket_id", "src", "dst", F.log1p(F.col("n").cast("double")).alias("log_cp"), (F.col("n") / F.col("most")).alias("rel"))


def node_scalars(nodes: DataFrame, scores: DataFrame, distinct: DataFrame) -> DataFrame:
    """(basket_id, tpnb, cp_score, distinctiveness, log_units) of every node, finite."""
    out = nodes.join(scores, ["basket_id", "tpnb"], "left").join(distinct.select("tpnb", "distinctiveness"), "tpnb", "left")
    return out.select("basket_id", "tpnb", finite_or_zero(F.col("cp_score")).alias("cp_score"), finite_or_zero(F.coalesce("distinctiveness", F.lit(0.5))).alias("distinctiveness"), finite_or_zero(log_units(F.col("units"))).alias("log_units"))


#: Up to so many rows a side that goes with small rows is sent to every task; more are joined by a shuffle.
FEW = 300_000
#: The same of products with an id and a number: some 80 MB.
FEW_PRODUCTS = 2_000_000


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """``df``, to be broadcast if it has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def product_rows(baskets: DataFrame) -> DataFrame:
    """(basket_id, p, units, vec, distinctiveness): a basket's distinct products in order, and arrays beside them.

    ``items`` of the baskets hold (tpnb, quantity, vec, distinctiveness). Units are as in :func:`basket_nodes`: items are
    sorted, so that a product's first quantity is null if any is. Distinctiveness is 0.5 where it is null, 0 where not finite.
    """
    p = F.array_distinct(F.transform("items", lambda i: i["tpnb"]))
    add = lambda s, i: s + F.coalesce(i["quantity"], F.lit(0.0))
    own = lambda x: F.filter("items", lambda i: i["tpnb"] == x)
    again = lambda x: F.aggregate(own(x), F.when(own(x)[0]["quantity"].isNull(), 1.0).otherwise(0.0), add)
    each = lambda c, once: F.when(F.size("p") == F.size("items"), F.transform("items", once)).otherwise(F.transform("p", c))
    first = lambda name: each(lambda x: own(x)[0][name], lambda i: i[name])
    return baskets.withColumn("p", p).select("basket_id", "p", each(again, lambda i: F.coalesce(i["quantity"], F.lit(1.0))).alias("units"), first("vec").alias("vec"), F.transform(first("distinctiveness"), lambda x: finite_or_zero(F.coalesce(x, F.lit(0.5)))).alias("distinctiveness"))


def counted_pairs(rows: DataFrame) -> DataFrame:
    """(basket_id, x): the places i < j of a basket's pairs that are in more than one basket, and in how many, n.

    ``rows``: see :func:`product_rows`; a table, as it is read twice. All products of a basket are together in one basket
    at least, so other pairs need no look-up: pairs are shuffled once, to be counted.
    """
    first = rows.select("basket_id", "p", F.posexplode("p").alias("i", "a"))
    pairs = first.select("basket_id", "i", "a", F.posexplode(F.slice("p", F.col("i") + 2, F.size("p"))).alias("k", "b"))
    more = few(settled(pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1")))
    released(rows.sparkSession)
    found = pairs.join(more, ["a", "b"]).select("basket_id", F.struct("i", (F.col("i") + 1 + F.col("k")).alias("j"), "n").alias("x"))
    out = few(settled(found.groupBy("basket_id").agg(F.collect_list("x").alias("x"))))
    released(rows.sparkSession)
    return out


def pack_graphs(rows: DataFrame, counted: DataFrame, top_k: int = 10) -> DataFrame:
    """(basket_id, n_nodes, vec, scalars, src, dst, attr): one row a basket, made inside the row.

    ``rows``: see :func:`product_rows`, all or some; ``counted``: :func:`counted_pairs` of all. Nodes are in order of
    product: ``vec`` is the id of a node's vector in the table of vectors (null: none), ``scalars`` its cp_score,
    distinctiveness and log_units, as :func:`node_scalars` gives them. Edges, as places in that order, are those of
    :func:`basket_edges`, with log_cp and rel in ``attr``.
    """
    whole = rows.join(counted, "basket_id", "left").select("basket_id", "units", "vec", "distinctiveness", "x.i", "x.j", "x.n")
    kinds = "basket_id string, n_nodes int, vec array<int>, scalars array<double>, src array<int>, dst array<int>, attr array<double>"
    return whole.mapInArrow(lambda batches: (_packed(b, top_k) for b in batches if b.num_rows), kinds)


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column (null: NaN, or -1 for whole numbers), and where each row's begin and the last one's end."""
    size = np.asarray(column.value_lengths().fill_null(0))
    x = column.flatten()
    return x.fill_null(float("nan") if kind is float else -1).to_numpy(zero_copy_only=False).astype(kind), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def _packed(b: pa.RecordBatch, top_k: int, cells: int = 1 << 20) -> pa.RecordBatch:
    units, at = _flat(b["units"], float)
    distinct, vec = _flat(b["distinctiveness"], float)[0], b["vec"].flatten()
    (i, xat), j, n = _flat(b["i"], int), _flat(b["j"], int)[0], _flat(b["n"], int)[0]
    size = np.diff(at)
    k = np.minimum(np.maximum(size - 1, 0), top_k)
    eat = np.concatenate([[0], np.cumsum(size * k)])
    cp, src, dst, attr = np.zeros(len(units)), np.zeros(eat[-1], np.int32), np.zeros(eat[-1], np.int32), np.zeros((eat[-1], 2))
    for m in np.unique(size[size > 1]):
        of, most = np.flatnonzero(size == m), k[np.flatnonzero(size == m)[0]]
        step = max(1, cells // (m * m))
        for lo in range(0, len(of), step):
            _pack_alike(of[lo : lo + step], int(m), int(most), cells, (i, j, n, xat), (at, eat), cp, src, dst, attr)
    scalars = np.stack([cp, distinct, _log_units(units)], 1)
    lists = lambda ends, values, w=1: pa.ListArray.from_arrays(pa.array(ends * w, pa.int32()), values)
    return pa.RecordBatch.from_arrays([b["basket_id"], pa.array(size.astype(np.int32)), lists(at, vec), lists(at, pa.array(scalars.ravel()), 3), lists(eat, pa.array(src)), lists(eat, pa.array(dst)), lists(eat, pa.array(attr.ravel()), 2)], ["basket_id", "n_nodes", "vec", "scalars", "src", "dst", "attr"])


def _log_units(units: np.ndarray) -> np.ndarray:
    ok = np.isfinite(units) & (units > -1)
    return np.log1p(np.where(ok, units, 0.0))


def _pack_alike(of: np.ndarray, m: int, k: int, cells: int, counted: tuple, ends: tuple, cp: np.ndarray, src: np.ndarray, dst: np.ndarray, attr: np.ndarray) -> None:
    """Fill in scores and edges of baskets that have the same number of products, some ``cells`` of their tables at a time."""
    (i, j, n, xat), (at, eat) = counted, ends
    width = xat[of + 1] - xat[of]
    row = np.repeat(np.arange(len(of)), width)
    x = np.repeat(xat[of] - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
    row, a, b, count = np.tile(row, 2), np.concatenate([i[x], j[x]]), np.concatenate([j[x], i[x]]), np.tile(n[x], 2)
    v, step = np.zeros((len(of), m)), max(1, cells // (len(of) * m))
    for lo in range(0, m, step):
        who = np.arange(lo, min(lo + step, m))
        mine = (a >= lo) & (a < lo + step)
        together = np.ones((len(of), len(who), m))
        together[row[mine], a[mine] - lo, b[mine]] = count[mine]
        together[:, who - lo, who] = 0
        v[:, who] = np.log1p(together.sum(2) / (m - 1))
        best = np.sort(np.argsort(-together, axis=2, kind="stable")[:, :, :k], axis=2)
        strength = np.take_along_axis(together, best, 2)
        e = eat[of][:, None] + np.arange(lo * k, (who[-1] + 1) * k)
        src[e], dst[e] = np.repeat(who, k), best.reshape(len(of), -1)
        attr[e, 0], attr[e, 1] = np.log1p(strength).reshape(len(of), -1), (strength / together.max(2)[:, :, None]).reshape(len(of), -1)
    low, high = v.min(1, keepdims=True), v.max(1, keepdims=True)
    cp[at[of][:, None] + np.arange(m)] = np.where(high > low, (v - low) / np.where(high > low, high - low, 1.0), np.where(high > 0, 1.0, 0.0))
