"""What need-states buy: lift profiles, summaries, bands, labels; and the scorecard of a clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from occasio.functions.scalar import banded, household_of, ratio
from occasio.operators.baskets import exploded, in_ranges, numbered

UNCLUSTERED = -1
#: The bands of the insight tables. An upper end belongs to its band.
SIZE_BANDS = [(2, "<=2"), (5, "2-5"), (10, "5-10"), (20, "10-20"), (50, "20-50")], ">50"
LIFT_BANDS = [(1.5, "< 1.5"), (3, "1.5-3"), (5, "3-5"), (10, "5-10")], ">= 10"
COVERAGE_BANDS = [(0.10, "< 10%"), (0.25, "10-25%"), (0.50, "25-50%"), (0.75, "50-75%")], ">= 75%"
DEPARTMENT_BANDS = [(1, "1"), (3, "2-3"), (6, "4-6")], "7+"
LIFT_BASIS = "clustered"
# Texts that stand for what is missing.
UNRECORDED = "(pre-fix, unrecorded)"
NO_LABEL = "(no description available)"


def _labelled(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("label") != UNCLUSTERED).select("basket_id", F.col("label").cast("long").alias("need_state"))


def state_product_counts(baskets: DataFrame, labels: DataFrame) -> DataFrame:
    """(need_state, tpnb, n_baskets) over labelled baskets."""
    return exploded(baskets).join(_labelled(labels), "basket_id").groupBy("need_state", "tpnb").agg(F.count("*").alias("n_baskets"))


def product_baseline(counts: DataFrame) -> DataFrame:
    """(tpnb, n_baskets): the counts added up, so both sides of a lift cover the same baskets by construction."""
    return counts.groupBy("tpnb").agg(F.sum("n_baskets").alias("n_baskets"))


def profiles(counts: DataFrame, lookup: DataFrame, top_n: int = 10, min_product_baskets: int = 200) -> DataFrame:
    """The products of greatest lift in each state: the product's share of the state's items over its share of all.

    Shares are of items, so trip size divides out. A product needs ``min_product_baskets`` baskets in the state, a rule
    applied after the totals. ``lookup``: (tpnb, description, department). Ties go to the lesser product.
    """
    in_state = F.sum("n_baskets").over(Window.partitionBy("need_state"))
    overall = F.sum("n_baskets").over(Window.partitionBy("tpnb"))
    total = counts.agg(F.sum("n_baskets").alias("_all"))
    scored = counts.select("need_state", "tpnb", F.col("n_baskets").alias("n"), in_state.alias("_state"), overall.alias("_product")).where(F.col("n") >= min_product_baskets).crossJoin(F.broadcast(total))
    share = F.col("n").cast("double") / F.col("_state")
    scored = scored.select("need_state", "tpnb", F.col("n").alias("n_baskets_in_need_state"), F.col("_product").alias("n_baskets_overall"), (share / (F.col("_product").cast("double") / F.col("_all"))).alias("lift"), share.alias("share_within_need_state"))
    w = Window.partitionBy("need_state").orderBy(F.desc("lift"), "tpnb")
    best = scored.withColumn("rank_by_lift", F.row_number().over(w).cast("long")).where(F.col("rank_by_lift") <= top_n)
    return best.join(lookup, "tpnb", "left").select("need_state", "tpnb", "n_baskets_in_need_state", "n_baskets_overall", "lift", "share_within_need_state", "description", "department", "rank_by_lift")


def summary(baskets: DataFrame, labels: DataFrame) -> DataFrame:
    """(need_state, n_baskets, n_households, avg_products_per_basket)."""
    return baskets.join(_labelled(labels), "basket_id").groupBy("need_state").agg(F.count("*").alias("n_baskets"), F.countDistinct("household_number").alias("n_households"), F.avg("n_products").alias("avg_products_per_basket"))


def state_labels(profile: DataFrame, n_terms: int = 3) -> DataFrame:
    """(need_state, label): descriptions of the top products, blanks skipped among them."""
    top = profile.where(F.col("rank_by_lift") <= n_terms)
    terms = F.filter(F.transform(F.sort_array(F.collect_list(F.struct("rank_by_lift", "description"))), lambda s: F.trim(s["description"])), lambda t: t.isNotNull() & (t != ""))
    return top.groupBy("need_state").agg(terms.alias("t")).select("need_state", F.when(F.size("t") > 0, F.array_join("t", " / ")).otherwise(NO_LABEL).alias("label"))


def enriched(summaries: DataFrame, profile: DataFrame) -> DataFrame:
    """The summary with share of baskets, profile statistics, label and size band."""
    stats = profile.groupBy("need_state").agg(
        F.max("lift").alias("max_lift"),
        F.avg("lift").alias("avg_lift"),
        F.median("lift").alias("median_lift"),
        F.max(F.when(F.col("rank_by_lift") == 1, F.col("share_within_need_state"))).alias("top_share"),
        F.countDistinct("department").alias("n_departments_top_n"),
        F.count("*").alias("n_products_profiled"),
    )
    out = summaries.join(stats, "need_state", "left").join(state_labels(profile), "need_state", "left")
    share = ratio(F.col("n_baskets"), F.sum("n_baskets").over(Window.partitionBy(F.lit(1))))
    return out.withColumns({
        "share_of_baskets": share,
        "n_products_profiled": F.coalesce("n_products_profiled", F.lit(0)).cast("long"),
        "top_product_coverage": F.when(F.col("top_share").isNotNull(), F.least(F.lit(1.0), F.col("top_share") * F.col("avg_products_per_basket"))),
        "size_band": banded(F.col("avg_products_per_basket"), *SIZE_BANDS),
    })


def band_table(enriched_summary: DataFrame, by: str) -> DataFrame:
    """One banded cross-tab by size, lift, coverage or departments; bands without states are there with nulls."""
    column, bands = {"size": ("avg_products_per_basket", SIZE_BANDS), "lift": ("max_lift", LIFT_BANDS), "coverage": ("top_product_coverage", COVERAGE_BANDS), "departments": ("n_departments_top_n", DEPARTMENT_BANDS)}[by]
    names = [n for _, n in bands[0]] + [bands[1]]
    spark = enriched_summary.sparkSession
    rows = enriched_summary.withColumn("band", banded(F.col(column), *bands)).where("band is not null")
    if by == "departments":
        rows = rows.where("n_departments_top_n > 0")
    got = rows.groupBy("band").agg(
        F.count("*").alias("n_ns"), F.sum("n_baskets").alias("n_baskets"), F.median("max_lift").alias("med_lift"), F.avg(F.when(F.col("max_lift") > 3, 1.0).otherwise(0.0)).alias("pct_over_3"), F.median("avg_products_per_basket").alias("med_size"), F.median("top_product_coverage").alias("med_coverage")
    )
    total = enriched_summary.agg(F.sum("n_baskets").alias("_all"))
    every = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "band_no int, band string")
    return every.join(got, "band", "left").crossJoin(F.broadcast(total)).select("band_no", "band", F.coalesce("n_ns", F.lit(0)).alias("n_ns"), "n_baskets", ratio(F.col("n_baskets"), F.col("_all")).alias("pct_of_population"), "med_lift", "pct_over_3", "med_size", "med_coverage")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: the correlation of average ranks. Ranks are taken before pairs with a null are left out."""

    def rank(c: str) -> tuple[DataFrame, str]:
        n = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
        dealt = in_ranges(n, c, [c])
        before = dealt.groupBy("_range").agg(F.sum("n").alias("_n")).select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
        inside = F.sum("n").over(Window.partitionBy("_range").orderBy(c).rowsBetween(Window.unboundedPreceding, -1))
        low = F.col("_before") + F.coalesce("_inside", F.lit(0))
        placed = dealt.withColumn("_inside", inside).join(F.broadcast(before), "_range")
        return placed.select(F.col(c).alias(f"_{c}"), (low + (F.col("n") + 1) / 2).alias(f"_rank_{c}")), f"_rank_{c}"

    rx, cx = rank(x)
    ry, cy = rank(y)
    return df.join(rx, F.col(x) == F.col(f"_{x}")).join(ry, F.col(y) == F.col(f"_{y}")).agg(F.corr(cx, cy).alias("rho"))


def headlines(enriched_summary: DataFrame) -> DataFrame:
    """One row of headline numbers; a state without a profile counts as not above 3."""
    over = F.when(F.col("max_lift") > 3, 1.0).otherwise(0.0)
    out = enriched_summary.agg(
        F.count("*").alias("n_need_states"), F.sum("n_baskets").alias("n_baskets"), F.median("max_lift").alias("median_max_lift"), F.avg(over).alias("share_states_over_3"), ratio(F.sum(over * F.col("n_baskets")), F.sum("n_baskets")).alias("share_baskets_over_3"), F.median("top_product_coverage").alias("median_coverage")
    )
    return out.crossJoin(spearman(enriched_summary, "avg_products_per_basket", "max_lift"))


def twin_jaccard(profile: DataFrame) -> DataFrame:
    """(need_state, best): the greatest overlap of a state's product set with another's, among full-length profiles.

    States that share no product meet through the number of states only; pairs come from a join on products.
    """
    sizes = profile.groupBy("need_state").agg(F.count("*").alias("n"))
    full = sizes.join(sizes.agg(F.max("n").alias("most")), F.col("n") >= F.col("most")).select("need_state", "n")
    rows = profile.join(full, "need_state").select("need_state", "tpnb", "n")
    a, b = rows.select(F.col("need_state").alias("a"), "tpnb", F.col("n").alias("na")), rows.select(F.col("need_state").alias("b"), "tpnb", F.col("n").alias("nb"))
    both = a.join(b, "tpnb").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("i"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    best = both.groupBy(F.col("a").alias("need_state")).agg(F.max(F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))).alias("j"))
    alone = full.agg(F.count("*").alias("k"))
    return full.select("need_state").join(best, "need_state", "left").crossJoin(alone).where("k > 1").select("need_state", F.coalesce("j", F.lit(0.0)).alias("best"))


def scorecard(run: str, labels: DataFrame, profile: DataFrame, summaries: DataFrame) -> DataFrame:
    """One row to compare clusterings by. ``summaries`` has n_products_profiled."""
    named = labels.where(F.col("label") != UNCLUSTERED)
    sizes = named.groupBy("label").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_communities"), F.coalesce(F.max("n") / F.sum("n"), F.lit(0.0)).alias("largest_share"), F.coalesce(F.floor(F.median("n")), F.lit(0)).cast("long").alias("median_community_size"))
    rows = labels.agg(F.count(F.when(F.col("label") != UNCLUSTERED, 1)).alias("n_baskets_labelled"), F.count(F.when(F.col("label") == UNCLUSTERED, 1)).alias("n_unclustered"))
    lift = profile.groupBy("need_state").agg(F.max("lift").alias("l"), F.count("*").alias("k"))
    above = lambda t: F.count(F.when(F.col("l") > t, 1))
    lifts = lift.agg(F.count("*").alias("n_profiled"), F.median("l").alias("median_max_lift"), F.avg(F.when(F.col("l") > 3, 1.0).otherwise(0.0)).alias("pct_lift_over_3"), above(5).alias("n_lift_over_5"), above(10).alias("n_lift_over_10"), F.max("k").alias("_most"))
    twins = twin_jaccard(profile).agg(F.median("best").alias("median_twin_jaccard"), F.count(F.when(F.col("best") >= 0.7, 1)).alias("n_twin_over_0p7"))
    thin = summaries.crossJoin(F.broadcast(lifts.select("_most"))).agg(F.avg(F.when(F.col("n_products_profiled") < F.col("_most"), 1.0).otherwise(0.0)).alias("pct_thin_profiles"))
    out = rows.crossJoin(sizes).crossJoin(lifts.drop("_most")).crossJoin(twins).crossJoin(thin)
    return out.select(F.lit(run).alias("run"), "n_baskets_labelled", "n_unclustered", "n_communities", "largest_share", "median_community_size", "n_profiled", F.lit(LIFT_BASIS).alias("lift_basis"), "median_max_lift", "pct_lift_over_3", "n_lift_over_5", "n_lift_over_10", "median_twin_jaccard", "n_twin_over_0p7", "pct_thin_profiles")


def permuted(labels: DataFrame, seed: int | None = 42) -> DataFrame:
    """Labels dealt anew among the labelled rows; sizes stay, -1 stays where it is.

    Rows are numbered by key, and again by (hash of key and seed); the label at the second number goes to the row at
    the first. ``seed`` None: labels move on by half the rows in key order, which SQL can replay.
    """
    named = labels.where(F.col("label") != UNCLUSTERED).select("basket_id", "label")
    by_key = numbered(named.withColumn("_h", F.coalesce(household_of(F.col("basket_id")), F.lit(0))), "_h", ["_h", "basket_id"], "_place")
    if seed is None:
        n = named.agg(F.count("*").alias("_n"))
        moved = by_key.crossJoin(F.broadcast(n)).select(((F.col("_place") - 1 + F.floor(F.col("_n") / 2)) % F.col("_n") + 1).alias("_place"), F.col("label"))
    else:
        h = F.shiftrightunsigned(F.xxhash64("basket_id", F.lit(seed)), 33)
        moved = numbered(named.withColumn("_h", h), "_h", ["_h", "basket_id"], "_place").select("_place", "label")
    dealt = by_key.select("_place", "basket_id").join(moved, "_place").select("basket_id", "label")
    return dealt.unionByName(labels.where(F.col("label") == UNCLUSTERED).select("basket_id", "label"))


def with_null(row: DataFrame, null_row: DataFrame, warn=print) -> DataFrame:
    """The scorecard row with its null run's median lift and the excess over it. One run as its own null raises."""
    a, b = row.select("run").first()[0], null_row.select("run").first()[0]
    if a == b:
        raise ValueError(f"{a} can't be its own null")
    out = row.crossJoin(null_row.select(F.col("run").alias("null_run"), F.col("median_max_lift").alias("null_median_max_lift"))).withColumn("excess", F.col("median_max_lift") - F.col("null_median_max_lift"))
    x = out.select("excess").first()[0]
    if x is not None and x <= 0:
        warn(f"{a}: lift is no better than chance ({x:.3f})")
    return out


def basis_verdict(log: DataFrame) -> DataFrame:
    """One row: bases found, and OK, MIXED or ALL-STALE. A missing basis counts as an old one."""
    basis = F.coalesce(F.col("lift_basis"), F.lit(UNRECORDED)) if "lift_basis" in log.columns else F.lit(UNRECORDED)
    found = log.agg(F.array_sort(F.collect_set(basis)).alias("b"))
    stale = F.size(F.filter("b", lambda x: x != LIFT_BASIS)) > 0
    return found.select(F.array_join("b", ", ").alias("bases"), F.when(~stale, "OK").when(F.array_contains("b", LIFT_BASIS), "MIXED").otherwise("ALL-STALE").alias("verdict"))


def heldout_log_ratio(train_counts: DataFrame, test_counts: DataFrame) -> DataFrame:
    """(need_state, bits): mean log2 ratio, over held-out items, of a product's share in its state to its share overall,
    both from training counts with one added."""
    v = train_counts.select("tpnb").distinct().agg(F.count("*").alias("_v"))
    state = train_counts.groupBy("need_state").agg(F.sum("n_baskets").alias("_s"))
    base = product_baseline(train_counts).withColumnRenamed("n_baskets", "_p")
    total = train_counts.agg(F.sum("n_baskets").alias("_t"))
    x = test_counts.withColumnRenamed("n_baskets", "_n").join(state, "need_state").join(base, "tpnb").join(train_counts.withColumnRenamed("n_baskets", "_c"), ["need_state", "tpnb"], "left").crossJoin(F.broadcast(v)).crossJoin(F.broadcast(total))
    bits = F.log2((F.coalesce("_c", F.lit(0)) + 1) / (F.col("_s") + F.col("_v"))) - F.log2((F.col("_p") + 1) / (F.col("_t") + F.col("_v")))
    return x.groupBy("need_state").agg((F.sum(bits * F.col("_n")) / F.sum("_n")).alias("bits"))
