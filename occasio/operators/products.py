"""Products: attributes, texts, keys, vectors and their groups."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occasio.functions.scalar import blank_to, doubles, l2_normalized
from occasio.operators.baskets import exploded
from occasio.sources.tables import keep_first

#: Products whose numbers are sent to workers at most, 12 bytes each.
SENT_PRODUCTS = 4_000_000

ATTRIBUTES = ["description", "brand", "department", "class", "subclass"]


def item_lookup(products: DataFrame, purchased: DataFrame) -> DataFrame:
    """One row a style (tpna) of which an item was bought: its most frequent attributes, its latest own description.

    ``products``: tpna, tpnb, tpna_description, the attributes, load_date_time, is_deleted, is_archived. Ties are settled
    by the attributes themselves.
    """
    gone = F.coalesce("is_deleted", F.lit(False)) | F.coalesce("is_archived", F.lit(False))
    live = products.where(F.col("tpna").isNotNull() & ~gone).select(
        F.col("tpna").cast("string").alias("tpna"),
        F.col("tpnb").cast("string").alias("tpnb"),
        F.nullif(F.trim(F.col("tpna_description").cast("string")), F.lit("")).alias("tpna_description"),
        "description",
        blank_to(F.col("brand")).alias("brand"),
        "department",
        "class",
        "subclass",
        "load_date_time",
    )
    bought = live.join(purchased.select(F.col("tpnb").cast("string").alias("tpnb")).distinct(), "tpnb", "left_semi").select("tpna").distinct()
    scoped = live.join(bought, "tpna", "left_semi")
    modes = keep_first(scoped.groupBy("tpna", *ATTRIBUTES).agg(F.count("*").alias("n")), ["tpna"], [F.desc("n"), *[F.asc_nulls_first(a) for a in ATTRIBUTES]])
    own = scoped.where("tpna_description is not null").groupBy("tpna").agg(F.max(F.struct("load_date_time", "tpna_description"))["tpna_description"].alias("own"))
    return modes.join(own, "tpna", "left").select("tpna", F.coalesce("own", "description").alias("description"), *ATTRIBUTES[1:])


def key_mapping(products: DataFrame) -> DataFrame:
    """Distinct (tpnb, tpna), as text."""
    return products.where("tpna is not null and tpnb is not null").select(F.col("tpnb").cast("string").alias("tpnb"), F.col("tpna").cast("string").alias("tpna")).distinct()


def category_mapping(products: DataFrame, theme: str) -> DataFrame:
    return products.where(F.col(theme).isNotNull()).select(F.col("tpnb").cast("string").alias("tpnb"), F.col(theme).cast("string").alias("theme_name")).distinct()


def item_text(*parts: Column) -> Column:
    """Non-blank parts, joined by " | "; the brand is left to the caller to leave out."""
    trimmed = F.array(*[F.trim(p.cast("string")) for p in parts])
    return F.array_join(F.filter(trimmed, lambda x: x.isNotNull() & (x != "")), " | ")


def vectors_by_item(style_vectors: DataFrame, mapping: DataFrame) -> DataFrame:
    """Each item's style vector; an item of several styles takes the first one by name."""
    first = keep_first(mapping, ["tpnb"], ["tpna"])
    return first.join(style_vectors, "tpna").drop("tpna")


def product_lookup(lookup: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row a product: description and department, the greatest where there are several."""
    return mapping.join(lookup, "tpna", "left").groupBy("tpnb").agg(F.max("description").alias("description"), F.max("department").alias("department"))


def check_product_lookup(lookup: DataFrame, warn=print) -> float:
    """The share of products with a description. An empty lookup raises, less than half warns."""
    n, named = lookup.agg(F.count("*"), F.count("description")).first()
    if not n:
        raise ValueError("the product lookup is empty: no product was joined with its attributes")
    if named < n / 2:
        warn(f"only {named / n:.0%} of the products have a description")
    return named / n


def key_overlap(products: DataFrame, vectors: DataFrame) -> DataFrame:
    """n_products, n_matched, share: how many products have a vector."""
    hits = products.select("tpnb").distinct().join(vectors.select("tpnb").distinct().withColumn("hit", F.lit(1)), "tpnb", "left")
    return hits.agg(F.count("*").alias("n_products"), F.count("hit").alias("n_matched")).withColumn("share", F.col("n_matched") / F.greatest(F.col("n_products"), F.lit(1)))


def check_key_overlap(products: DataFrame, vectors: DataFrame, warn=print) -> float:
    """The share of products with a vector. None at all raises, less than half warns."""
    r = key_overlap(products, vectors).first()
    if not r["n_products"]:
        raise ValueError("the product dictionary is empty")
    if not r["n_matched"]:
        raise ValueError(f"no product has a vector: keys are {products.schema['tpnb'].dataType.simpleString()} and {vectors.schema['tpnb'].dataType.simpleString()}")
    if r["share"] < 0.5:
        warn(f"only {r['share']:.0%} of the products have a vector")
    return r["share"]


def mapping_fanout(mapping: DataFrame) -> DataFrame:
    """How many items belong to 1, 2, ... styles."""
    return mapping.groupBy("tpnb").agg(F.countDistinct("tpna").alias("n_tpna")).groupBy("n_tpna").agg(F.count("*").alias("n_tpnb"))


def top_products(baskets: DataFrame, lookup: DataFrame, mapping: DataFrame, n: int) -> DataFrame:
    """The products in most baskets, with the share of baskets and attributes."""
    counts = exploded(baskets).groupBy("tpnb").agg(F.count("*").alias("n_baskets"))
    best = counts.orderBy(F.desc("n_baskets"), "tpnb").limit(n)
    total = baskets.agg(F.count("*").alias("n"))
    return best.join(product_lookup(lookup, mapping), "tpnb", "left").crossJoin(F.broadcast(total)).select("tpnb", "n_baskets", (100 * F.col("n_baskets").cast("double") / F.col("n")).alias("pct_of_baskets"), "description", "department")


def description_coverage(baskets: DataFrame, lookup: DataFrame, mapping: DataFrame) -> DataFrame:
    """Over bought products: rows of the join with the mapping, with a description, with a department, and products."""
    bought = exploded(baskets).select("tpnb").distinct()
    rows = bought.join(mapping, "tpnb", "left").join(lookup, "tpna", "left")
    return rows.agg(F.count("*").alias("purchased_tpnb"), F.count("description").alias("with_description"), F.count("department").alias("with_department"), F.countDistinct("tpnb").alias("distinct_tpnb"))


def text_vectors(items: DataFrame, text: str = "item_text", dim: int = 384) -> DataFrame:
    """Unit vectors of texts from hashed words and letter trigrams, weighted by rarity. Stands where a sentence model
    may be plugged in: any frame of (tpna, embedding) serves the later steps.
    """
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - 2)), lambda i: F.substr(w, i, F.lit(3)))))
    terms = items.select("tpna", F.explode(F.concat(words, grams)).alias("term")).groupBy("tpna", "term").agg(F.count("*").alias("tf"))
    rarity = terms.groupBy("term").agg(F.log1p(1 / F.count("*")).alias("idf"))
    h = F.xxhash64("term")
    cells = terms.join(rarity, "term").select("tpna", F.pmod(h, F.lit(dim)).cast("int").alias("d"), (F.when(F.pmod(F.shiftright(h, 40), F.lit(2)) == 0, 1.0).otherwise(-1.0) * F.col("tf") * F.col("idf")).alias("x"))
    sums = cells.groupBy("tpna", "d").agg(F.sum("x").alias("x")).groupBy("tpna").agg(F.map_from_entries(F.collect_list(F.struct("d", "x"))).alias("m"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
    return sums.select("tpna", l2_normalized(vector).cast("array<float>").alias("embedding"))


def without_common_directions(vectors: DataFrame, key: str, column: str = "embedding", n: int = 2) -> DataFrame:
    """Vectors less their mean and less their projections on the first ``n`` principal components.

    Mean and covariance are one distributed pass; what reaches the driver is as large as the dimension squared.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    v = vectors.select(key, array_to_vector(doubles(F.col(column))).alias("v"))
    mean = [float(x) for x in v.select(Summarizer.mean(F.col("v")).alias("m")).first()["m"]]
    centred = vectors.select(key, F.zip_with(doubles(F.col(column)), F.array(*map(F.lit, mean)), lambda a, b: a - b).alias("c"))
    if not n:
        return centred.select(key, F.col("c").alias(column))
    model = PCA(k=n, inputCol="v", outputCol="p").fit(centred.select(array_to_vector("c").alias("v")))
    axes = model.pc.toArray().T
    out = F.col("c")
    for axis in axes:
        a = F.array(*[F.lit(float(x)) for x in axis])
        along = F.aggregate(F.zip_with(F.col("c"), a, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        out = F.zip_with(out, _scaled(a, along), lambda x, y: x - y)
    return centred.select(key, out.alias(column))


def _scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda y: y * by)


def centroid_distances(vectors: DataFrame, centroids: DataFrame, key: str) -> DataFrame:
    """(key, centroid, distance) for each centroid; there are few of them, at most some hundreds."""
    c = centroids.select(F.col("label").alias("centroid"), doubles(F.col("center")).alias("_c"))
    v = vectors.select(key, doubles(F.col("embedding")).alias("_v"))
    square = F.aggregate(F.zip_with("_v", "_c", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return v.crossJoin(F.broadcast(c)).select(key, "centroid", F.sqrt(F.greatest(square, F.lit(0.0))).alias("distance"))


def distinctiveness(vectors: DataFrame, centroids: DataFrame, key: str, label: str = "label") -> DataFrame:
    """1 - distance to the own centroid / greatest distance to any; 0.5 without a label. High means typical."""
    far = centroid_distances(vectors, centroids, key).groupBy(key).agg(F.max("distance").alias("far"), F.map_from_entries(F.collect_list(F.struct("centroid", "distance"))).alias("by"))
    return vectors.select(key, label).join(far, key).select(key, F.coalesce(1 - F.col("by")[F.col(label)] / (F.col("far") + 1e-8), F.lit(0.5)).alias("distinctiveness"))


def subclusters(vectors: DataFrame, key: str, candidates: tuple[int, ...], seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """K-means on unit vectors with the number of groups of the best silhouette.

    Returns (key, label), centroids, and the silhouette of each number tried; numbers not below the rows are skipped.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    unit = vectors.select(key, array_to_vector(l2_normalized(F.col("embedding"))).alias("features")).cache()
    n, best, tried = unit.count(), None, []
    for k in candidates:
        if k >= n or k < 2:
            continue
        model = KMeans(k=k, seed=seed).fit(unit)
        got = model.transform(unit)
        score = ClusteringEvaluator(metricName="silhouette", distanceMeasure="squaredEuclidean").evaluate(got)
        tried.append((k, float(score)))
        if best is None or score > best[0]:
            best = (score, model)
    if best is None:
        raise ValueError("no number of groups is below the number of rows")
    spark = vectors.sparkSession
    centers = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(best[1].clusterCenters())], "label int, center array<double>")
    return best[1].transform(unit).select(key, F.col("prediction").alias("label")), centers, spark.createDataFrame(tried, "k int, silhouette double")


def label_means(vectors: DataFrame, label: str = "label") -> DataFrame:
    """(label, center): the mean vector of each label, by element-wise sums."""
    cells = vectors.select(label, F.posexplode(doubles(F.col("embedding"))).alias("d", "x")).groupBy(label, "d").agg(F.avg("x").alias("x"))
    return cells.groupBy(F.col(label).alias("label")).agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("center"))


def product_hashes(products: Column) -> Column:
    """What :func:`sent_numbers` finds products by, of an array of them; nulls are left out."""
    return F.transform(F.filter(products, lambda p: p.isNotNull()), lambda p: F.xxhash64(p.cast("string")))


def sent_numbers(numbers: DataFrame, values: np.ndarray) -> Callable[[np.ndarray], np.ndarray] | None:
    """A function for workers, from hashes of products to the places in ``values`` (ascending) of their ``n``; -1 of others.

    ``numbers``: (tpnb, n), all ``n`` in ``values``. None if two rows have one product or hash, or there are more than
    SENT_PRODUCTS.
    """
    named = numbers.where("tpnb is not null").select(F.xxhash64(F.col("tpnb").cast("string")).alias("p"), F.col("n").cast("long").alias("n"))
    if named.limit(SENT_PRODUCTS + 1).count() > SENT_PRODUCTS:
        return None
    got = named.toArrow()
    p = got["p"].to_numpy()
    order = np.argsort(p)
    p, at = p[order], np.searchsorted(values, got["n"].to_numpy()[order]).astype(np.int32)
    if not len(p) or (p[1:] == p[:-1]).any():
        return None
    sent = numbers.sparkSession.sparkContext.broadcast((p, at))

    def find(hashes: np.ndarray) -> np.ndarray:
        p, at = sent.value
        by = np.argsort(hashes)  # in order they are found twice as fast
        i = np.empty(len(hashes), np.int64)
        i[by] = np.minimum(np.searchsorted(p, hashes[by]), len(p) - 1)
        return np.where(p[i] == hashes, at[i], -1)

    return find
