"""From purchase rows to baskets: one basket a household and week."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from occasio.functions.scalar import basket_id, size_bucket

KEYS = ("household_number", "tpnb", "year_number", "period_number", "week_number")


def in_periods(df: DataFrame, low: int, high: int) -> DataFrame:
    """Rows from period low to high (year * 100 + period), as conditions on the bare columns, which reach the scan."""
    y, p = F.col("year_number"), F.col("period_number")
    after = (y > low // 100) | ((y == low // 100) & (p >= low % 100))
    before = (y < high // 100) | ((y == high // 100) & (p <= high % 100))
    return df.where(y.between(low // 100, high // 100) & after & before & F.col("household_number").isNotNull() & F.col("tpnb").isNotNull())


def weekly_purchases(lines: DataFrame) -> DataFrame:
    """Sums of quantity, orders and sales by household, product and week; combined before the shuffle."""
    return lines.groupBy(*KEYS).agg(F.sum("quantity").alias("quantity"), F.sum("orders").alias("orders"), F.sum("sales").alias("sales"))


def purchase_stats(txn: DataFrame) -> DataFrame:
    """What to check before a build: counts, distinct counts, range of weeks, rows without a positive quantity."""
    week = F.col("year_number") * 100 + F.col("week_number")
    return txn.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("household_number").alias("n_households"),
        F.countDistinct("tpnb").alias("n_products"),
        F.countDistinct(week).alias("n_weeks"),
        F.min(week).cast("long").alias("first_week"),
        F.max(week).cast("long").alias("last_week"),
        F.sum(F.when(F.col("quantity") <= 0, 1).otherwise(0)).alias("n_returns"),
        F.sum(F.when(F.col("household_number").isNull(), 1).otherwise(0)).alias("n_null_households"),
    )


def basket_items(txn: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """household_number, year_week_number, tpnb (text), quantity, ``extra``; rows without a key are left out."""
    return txn.where("household_number is not null and tpnb is not null").select(
        F.col("household_number").cast("long").alias("household_number"),
        (F.col("year_number") * 100 + F.col("week_number")).cast("int").alias("year_week_number"),
        F.col("tpnb").cast("string").alias("tpnb"),
        F.col("quantity").cast("double").alias("quantity"),
        *extra,
    )


def build_baskets(txn: DataFrame, min_products: int = 2, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row a household and week with at least ``min_products`` product rows.

    ``items`` holds (tpnb, quantity) structs, sorted, so that products and quantities stay together and nulls are kept;
    ``extra`` columns of the rows follow in them. One shuffle, by household and week; none if ``txn`` is dealt by household.
    """
    return (
        basket_items(txn, extra)
        .groupBy("household_number", "year_week_number")
        .agg(F.sort_array(F.collect_list(F.struct("tpnb", "quantity", *extra))).alias("items"))
        .withColumn("n_products", F.size("items"))
        .where(F.col("n_products") >= min_products)
        .select("household_number", "year_week_number", basket_id(F.col("household_number"), F.col("year_week_number")).alias("basket_id"), "items", "n_products", size_bucket(F.col("n_products")).alias("size_bucket"))
    )


def exploded(baskets: DataFrame) -> DataFrame:
    return baskets.select("household_number", "year_week_number", "basket_id", F.explode("items").alias("i")).select("household_number", "year_week_number", "basket_id", "i.tpnb", "i.quantity")


def in_ranges(df: DataFrame, lead: str, order: list[str], ranges: int = 4096) -> DataFrame:
    """The rows with ``_range``: ranges of ``lead``, a number or text, ascending; nulls are in the first one.

    Quantiles of a sample of 4 * ``ranges`` rows (those with the least hash of ``order``) cut them, so a few values far out
    leave no range with all the others.
    """
    sample = df.where(F.col(lead).isNotNull()).select(lead, F.xxhash64(*order).alias("_h")).orderBy("_h").limit(4 * ranges)
    values = sorted({r[0] for r in sample.collect()})  # 4 * ranges rows
    bounds = sorted({values[i * len(values) // ranges] for i in range(ranges)}) if values else []
    kind = df.schema[lead].dataType.simpleString()
    cuts = F.broadcast(df.sparkSession.createDataFrame([(bounds,)], f"_cuts array<{kind}>"))
    # How many bounds are up to the value, by halving.
    step = lambda bit: F.pow(F.lit(2), bit).cast("int")
    bits = F.sequence(F.lit(ranges.bit_length()), F.lit(0), F.lit(-1))
    upto = F.aggregate(bits, F.lit(0), lambda at, bit: F.when(F.get("_cuts", at + step(bit) - 1) <= F.col(lead), at + step(bit)).otherwise(at))
    return df.crossJoin(cuts).withColumn("_range", upto).drop("_cuts")


def numbered(df: DataFrame, lead: str, order: list[str], name: str = "basket_seq", ranges: int = 4096) -> DataFrame:
    """A number from 1 in the order of ``order``, without a one-task sort.

    ``lead`` is the first of ``order``. A window over a row a range (:func:`in_ranges`) gives each range's first number, and
    rows are numbered inside their range. The numbers do not depend on where the ranges lie, and are the same whenever it
    is run again.
    """
    dealt = in_ranges(df, lead, order, ranges)
    before = dealt.groupBy("_range").count().select("_range", (F.sum("count").over(Window.orderBy("_range")) - F.col("count")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_inside", inside).join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_range", "_before", "_inside")


def product_units(txn: DataFrame) -> DataFrame:
    """Mean quantity by product over all rows with a product, of baskets that are dropped too."""
    return txn.where("tpnb is not null").groupBy(F.col("tpnb").cast("string").alias("tpnb")).agg(F.avg("quantity").alias("avg_quantity"))


def product_dictionary(baskets: DataFrame) -> DataFrame:
    """product_index from 0 for each product of the baskets, in numeric order."""
    ids = exploded(baskets).select(F.col("tpnb").cast("long").alias("n")).distinct()
    return numbered(ids, "n", ["n"], "product_index").select((F.col("product_index") - 1).alias("product_index"), F.col("n").cast("string").alias("tpnb"))


def stratum_quotas(baskets: DataFrame, n_samples: int) -> DataFrame:
    """How many baskets of each size bucket a sample takes: in proportion, at least one, at most all."""
    n = baskets.groupBy("size_bucket").agg(F.count("*").alias("n_baskets"))
    share = F.bround(n_samples * F.col("n_baskets").cast("double") / F.sum("n_baskets").over(Window.partitionBy(F.lit(1))))
    return n.select("size_bucket", "n_baskets", F.least(F.col("n_baskets"), F.greatest(F.lit(1), share).cast("long")).alias("quota"))


def stratified_sample(baskets: DataFrame, n_samples: int, seed: int = 42) -> DataFrame:
    """Baskets by quota, those with the least hash of (key, seed) of each bucket; the same for the same seed.

    The hash threshold that surely holds the quota cuts rows before the sort, so no bucket is sorted as a whole.
    """
    quotas = F.broadcast(stratum_quotas(baskets, n_samples))
    order = F.xxhash64("basket_id", F.lit(seed))
    unit = (order.cast("double") / 2.0**64) + 0.5
    share = F.col("quota") / F.col("n_baskets")
    margin = share + 6 * F.sqrt(share / F.col("n_baskets")) + 36 / F.col("n_baskets")
    kept = baskets.join(quotas, "size_bucket").withColumn("_h", order).where(unit <= margin)
    w = Window.partitionBy("size_bucket").orderBy("_h", "basket_id")
    out = kept.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= F.col("quota"))
    return out.orderBy("_h", "basket_id").limit(n_samples).drop("_h", "_rn", "n_baskets", "quota")


def in_size_band(baskets: DataFrame, low: int, high: int, at_least: int = 0) -> DataFrame:
    """Baskets of low to high products; fewer than ``at_least`` rows raise."""
    out = baskets.where(F.col("n_products").between(low, high))
    if at_least and out.limit(at_least).count() < at_least:
        raise ValueError(f"fewer than {at_least} baskets have {low} to {high} products")
    return out


def items_text(items: Column) -> Column:
    """The products of a basket as text, for comparison and export."""
    return F.array_join(F.transform(items, lambda i: i["tpnb"]), ",")
