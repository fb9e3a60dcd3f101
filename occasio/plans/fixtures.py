"""The engine's model built from the driver's tables: purchases from orders and lines, attributes from parts, vectors
and labels from embeddings, dense household sequences from events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from occasio.functions.scalar import basket_id
from occasio.operators import baskets as B
from occasio.operators import products as P
from occasio.operators import vectors as V
from occasio.sources.tables import read_table

KNN = 5


def raw_txn(spark: SparkSession, d: str) -> DataFrame:
    """household_number, tpnb, year, period, week, quantity, orders, sales; dealt by household, once for all that follows."""
    orders = read_table(spark, f"{d}/orders.parquet", ["o_orderkey", "o_custkey", "o_orderdate"])
    lines = read_table(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount"])
    week = F.weekofyear("o_orderdate")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .repartition("o_custkey")
        .groupBy(
            F.col("o_custkey").alias("household_number"),
            F.col("l_partkey").alias("tpnb"),
            F.extract(F.lit("YEAROFWEEK"), "o_orderdate").cast("int").alias("year_number"),
            (F.floor((week - 1) / 4) + 1).cast("int").alias("period_number"),
            week.cast("int").alias("week_number"),
        )
        .agg(F.sum("l_quantity").alias("quantity"), F.countDistinct("l_orderkey").alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("sales"))
    )


def baskets(spark: SparkSession, d: str) -> DataFrame:
    return B.build_baskets(raw_txn(spark, d))


def parts(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, f"{d}/part.parquet", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])


def products(spark: SparkSession, d: str) -> DataFrame:
    """A product master: styles are part names, items are parts."""
    p = parts(spark, d)
    return p.select(
        F.col("p_name").alias("tpna"),
        F.col("p_partkey").alias("tpnb"),
        F.when(F.col("p_size") % 3 == 0, F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))).alias("tpna_description"),
        F.concat_ws(" ", "p_name", F.lower("p_type")).alias("description"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("department"),
        F.concat(F.lit("C"), (F.col("p_size") % 7).cast("string")).alias("class"),
        F.concat(F.lit("S"), (F.col("p_size") % 5).cast("string")).alias("subclass"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("p_partkey") % 100 * 86400).alias("load_date_time"),
        (F.col("p_size") == 50).alias("is_deleted"),
        F.lit(None).cast("boolean").alias("is_archived"),
    )


def item_lookup(spark: SparkSession, d: str) -> DataFrame:
    return P.item_lookup(products(spark, d), purchased(spark, d))


def purchased(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, f"{d}/lineitem.parquet", ["l_partkey"]).select(F.col("l_partkey").alias("tpnb")).distinct()


def mapping(spark: SparkSession, d: str) -> DataFrame:
    return P.key_mapping(products(spark, d))


def part_lookup(spark: SparkSession, d: str) -> DataFrame:
    """(tpnb, description, department) of every part."""
    return parts(spark, d).select(F.col("p_partkey").cast("string").alias("tpnb"), F.col("p_name").alias("description"), F.col("p_type").alias("department"))


def labels(spark: SparkSession, d: str, of: DataFrame | None = None) -> DataFrame:
    """(basket_id, label) of the baskets ``of``, or of all: the basket's most frequent part type; -1 where the household number ends in 0."""
    types = parts(spark, d).select(F.col("p_partkey").cast("string").alias("tpnb"), "p_type")
    numbers = types.select("p_type").distinct().withColumn("no", F.dense_rank().over(Window.orderBy("p_type")) - 1)
    of = baskets(spark, d) if of is None else of
    n = numbers.count()
    find = P.sent_numbers(types.join(F.broadcast(numbers), "p_type").select("tpnb", F.col("no").alias("n")), np.arange(n)) if types.where("p_type is null").isEmpty() else None
    if find is None:
        top = B.exploded(of).join(types, "tpnb").groupBy("basket_id", "household_number", "p_type").agg(F.count("*").alias("n"))
        top = top.withColumn("rn", F.row_number().over(Window.partitionBy("basket_id").orderBy(F.desc("n"), "p_type"))).where("rn = 1").join(F.broadcast(numbers), "p_type")
    else:

        def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                no = find(b["p"].flatten().to_numpy(zero_copy_only=False))
                of = np.repeat(np.arange(b.num_rows), b["p"].value_lengths().to_numpy(zero_copy_only=False))[no >= 0]
                pair, count = np.unique(of * n + no[no >= 0], return_counts=True)
                by = np.lexsort((pair, -count, pair // n))
                row, first = np.unique(pair[by] // n, return_index=True)
                yield pa.RecordBatch.from_arrays([b["basket_id"].take(pa.array(row)), b["household_number"].take(pa.array(row)), pa.array(pair[by][first] % n)], ["basket_id", "household_number", "no"])

        rows = of.select("basket_id", "household_number", P.product_hashes(F.col("items.tpnb")).alias("p"))
        top = rows.mapInArrow(most, "basket_id string, household_number long, no long")
    return top.select("basket_id", F.when(F.col("household_number") % 10 == 0, -1).otherwise(F.col("no")).cast("long").alias("label"))


def event_labels(spark: SparkSession, d: str) -> DataFrame:
    """(basket_id, need_state): the most frequent event type of a user's day; the day of month stands for the week."""
    e = read_table(spark, f"{d}/events.parquet", ["user_id", "ts", "event_type"])
    numbers = e.select("event_type").distinct().withColumn("no", F.dense_rank().over(Window.orderBy("event_type")) - 1)
    n = e.groupBy("user_id", (202400 + F.dayofmonth("ts")).alias("slot"), "event_type").agg(F.count("*").alias("n"))
    top = n.withColumn("rn", F.row_number().over(Window.partitionBy("user_id", "slot").orderBy(F.desc("n"), "event_type"))).where("rn = 1")
    return top.join(F.broadcast(numbers), "event_type").select(basket_id(F.col("user_id"), F.col("slot")).alias("basket_id"), F.col("no").cast("long").alias("need_state"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """(id, embedding, label)."""
    return read_table(spark, f"{d}/embeddings.parquet", ["vec_id", "embedding", "label"]).select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("long").alias("label"))


def product_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(tpnb, embedding): vectors dealt to parts in turn."""
    v = vectors(spark, d)
    n = v.count()
    return parts(spark, d).select(F.col("p_partkey").cast("string").alias("tpnb"), (F.col("p_partkey") % n).alias("id")).join(v.select("id", "embedding"), "id").select("tpnb", "embedding")


def neighbours(spark: SparkSession, d: str, k: int = KNN) -> DataFrame:
    v = vectors(spark, d)
    return V.nearest(v, v, "id", k)


def edges(spark: SparkSession, d: str, *, mutual: bool = False) -> DataFrame:
    return V.with_weight(V.similarity_edges(neighbours(spark, d), "id", mutual=mutual))


def centroids(spark: SparkSession, d: str) -> DataFrame:
    return P.label_means(vectors(spark, d))
