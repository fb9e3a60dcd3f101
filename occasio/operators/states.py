"""Need-states: how they adjoin, where households move next, and journeys over several steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from occasio.functions.scalar import household_of, ratio, week_of

UNCLUSTERED = -1


def split_keys(labels: DataFrame, key: str = "basket_id") -> DataFrame:
    """household_number and year_week_number from the key; rows whose key has no such parts are dropped. No underscore
    in any key raises."""
    if labels.where(F.col(key).contains("_")).isEmpty() and not labels.isEmpty():
        raise ValueError(f"no {key} has an underscore")
    out = labels.withColumns({"household_number": household_of(F.col(key)), "year_week_number": week_of(F.col(key))})
    return out.where("household_number is not null and year_week_number is not null")


def week_ranks(df: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """week_rank from 0 over the distinct weeks of ``df``, or of a ``calendar`` (year_week_number): some hundreds."""
    weeks = (df if calendar is None else calendar).select("year_week_number").distinct()
    ranks = weeks.withColumn("week_rank", (F.dense_rank().over(Window.orderBy("year_week_number")) - 1).cast("long"))
    return df.join(F.broadcast(ranks), "year_week_number")


def steps(labels: DataFrame, label: str = "need_state", calendar: DataFrame | None = None) -> DataFrame:
    """(household_number, from_need_state, to_need_state, week_gap) of each household's successive baskets."""
    rows = week_ranks(split_keys(labels.where(F.col(label).isNotNull())), calendar)
    w = Window.partitionBy("household_number").orderBy("week_rank", "basket_id")
    moved = rows.select("household_number", F.col(label).cast("long").alias("from_need_state"), F.lead(label).over(w).cast("long").alias("to_need_state"), (F.lead("week_rank").over(w) - F.col("week_rank")).alias("week_gap"))
    return moved.where("to_need_state is not null")


def transitions(labels: DataFrame, label: str = "need_state", max_week_gap: int | None = 1, min_support: int = 30, calendar: DataFrame | None = None) -> DataFrame:
    """Directed counts between states, with the chance of each next state and its lift over that state's share."""
    got = steps(labels, label, calendar)
    if max_week_gap is not None:
        got = got.where(F.col("week_gap") <= max_week_gap)
    n = got.groupBy("from_need_state", "to_need_state").agg(F.count("*").alias("n_transitions"), F.avg("week_gap").alias("avg_week_gap"))
    prob = ratio(F.col("n_transitions"), F.sum("n_transitions").over(Window.partitionBy("from_need_state")))
    n = n.withColumn("prob", prob).withColumn("_to", F.sum("n_transitions").over(Window.partitionBy("to_need_state"))).withColumn("_all", F.sum("n_transitions").over(Window.partitionBy(F.lit(1))))
    return n.select("from_need_state", "to_need_state", "n_transitions", "prob", ratio(F.col("prob"), ratio(F.col("_to"), F.col("_all"))).alias("lift"), "avg_week_gap", (F.col("n_transitions") < min_support).alias("low_support"))


def next_states(trans: DataFrame, state: int, top_n: int = 5, *, exclude_self: bool = False) -> DataFrame:
    out = trans.where(F.col("from_need_state") == state)
    if exclude_self:
        out = out.where("to_need_state <> from_need_state")
    return out.orderBy(F.desc("prob"), "to_need_state").limit(top_n)


def journeys(trans: DataFrame, state: int, depth: int = 3, beam: int = 5, *, exclude_self: bool = True, min_path_prob: float = 0.0, include_partial: bool = False) -> DataFrame:
    """The likeliest paths out of a state by beam search: path, path_prob, weakest_step, low_support_steps, n_steps.

    Each step joins the beam, at most ``beam`` rows, with the transitions and keeps the best; ties go to the lesser
    path. Returned is the deepest beam that has paths, or with ``include_partial`` every depth's.
    """
    moves = trans.select(F.col("from_need_state").alias("_from"), F.col("to_need_state").alias("_to"), F.col("prob").alias("_p"), F.col("low_support").cast("long").alias("_low"))
    if exclude_self:
        moves = moves.where("_from <> _to")
    spark = trans.sparkSession
    kind = "path array<long>, path_prob double, weakest_step double, low_support_steps long"
    paths, levels = spark.createDataFrame([([int(state)], 1.0, 1.0, 0)], kind), []
    for _ in range(depth):
        longer = F.broadcast(paths).join(moves, F.element_at("path", -1) == F.col("_from"))
        grown = longer.select(
            F.concat("path", F.array("_to")).alias("path"),
            (F.col("path_prob") * F.col("_p")).alias("path_prob"),
            F.least("weakest_step", "_p").alias("weakest_step"),
            (F.col("low_support_steps") + F.col("_low")).alias("low_support_steps"),
        ).where(F.col("path_prob") >= min_path_prob)
        rows = grown.orderBy(F.desc("path_prob"), "path").limit(beam).collect()  # at most beam rows
        if not rows:
            break
        paths = spark.createDataFrame(rows, kind)
        levels.append(paths)
    if not levels:
        return spark.createDataFrame([], kind).withColumn("n_steps", F.lit(0).cast("long"))
    out = levels[-1]
    if include_partial:
        for x in levels[:-1]:
            out = out.unionByName(x)
    return out.withColumn("n_steps", (F.size("path") - 1).cast("long")).orderBy(F.desc("path_prob"), "path")


def household_history(labels: DataFrame, household: int, label: str = "need_state") -> DataFrame:
    """A household's states, oldest first; unclustered ones too."""
    return split_keys(labels).where(F.col("household_number") == household).select("year_week_number", "basket_id", F.col(label).cast("long").alias("need_state")).orderBy("year_week_number", "basket_id")


def journeys_for_household(labels: DataFrame, trans: DataFrame, household: int, label: str = "need_state", depth: int = 3, beam: int = 5) -> DataFrame:
    """The paths out of a household's latest state, with that state and its week; no rows for an unknown household."""
    last = household_history(labels, household, label).orderBy(F.desc("year_week_number"), F.desc("basket_id")).limit(1).collect()
    spark = labels.sparkSession
    if not last:
        return spark.createDataFrame([], "household_number long, current_need_state long, as_of int, path array<long>, path_prob double, weakest_step double, low_support_steps long, n_steps long")
    found = journeys(trans, last[0]["need_state"], depth, beam)
    return found.select(F.lit(household).cast("long").alias("household_number"), F.lit(last[0]["need_state"]).cast("long").alias("current_need_state"), F.lit(last[0]["year_week_number"]).cast("int").alias("as_of"), "*")


def state_pairs(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(need_state_a, need_state_b, n_edges, weight_sum), a <= b, over edges whose ends are both in a state."""
    named = labels.where(F.col("label") != UNCLUSTERED)
    a = named.select(F.col("basket_id").alias("basket_a"), F.col("label").alias("_a"))
    b = named.select(F.col("basket_id").alias("basket_b"), F.col("label").alias("_b"))
    return edges.join(a, "basket_a").join(b, "basket_b").groupBy(F.least("_a", "_b").alias("need_state_a"), F.greatest("_a", "_b").alias("need_state_b")).agg(F.count("*").alias("n_edges"), F.sum("weight").alias("weight_sum"))


def _degrees(pairs: DataFrame, value: str, name: str) -> DataFrame:
    return pairs.select(F.explode(F.array("need_state_a", "need_state_b")).alias("s"), F.col(value).alias("v")).groupBy("s").agg(F.sum("v").alias(name))


def adjacency(edges: DataFrame, labels: DataFrame, *, drop_self: bool = True) -> DataFrame:
    """Which states border one another: n_edges, weight_sum, lift over the configuration model, shares of each degree.

    Degrees and the total include edges inside a state (twice for a degree); the result leaves those pairs out.
    """
    pairs = state_pairs(edges, labels)
    degree = _degrees(pairs, "weight_sum", "d")
    total = pairs.agg(F.sum("weight_sum").alias("w"))
    out = pairs.join(degree.select(F.col("s").alias("need_state_a"), F.col("d").alias("da")), "need_state_a").join(degree.select(F.col("s").alias("need_state_b"), F.col("d").alias("db")), "need_state_b").crossJoin(F.broadcast(total))
    if drop_self:
        out = out.where("need_state_a <> need_state_b")
    chance = ratio(F.col("da") * F.col("db"), 2 * F.col("w"))
    return out.select("need_state_a", "need_state_b", "n_edges", "weight_sum", ratio(F.col("weight_sum"), chance).alias("lift"), ratio(F.col("weight_sum"), F.col("da")).alias("share_a"), ratio(F.col("weight_sum"), F.col("db")).alias("share_b"))


def adjacency_export(edges: DataFrame, labels: DataFrame, top_n: int) -> DataFrame:
    """The pairs with most edges, with the lift by weight and the lift by counts of edges between states only."""
    pairs = state_pairs(edges, labels)
    cross = pairs.where("need_state_a <> need_state_b")
    degree, total = _degrees(pairs, "weight_sum", "d"), pairs.agg(F.sum("weight_sum").alias("w"))
    xdegree, xtotal = _degrees(cross, "n_edges", "x"), cross.agg(F.sum("n_edges").alias("m"))
    out = cross
    for side in ("a", "b"):
        out = out.join(degree.select(F.col("s").alias(f"need_state_{side}"), F.col("d").alias(f"d{side}")), f"need_state_{side}").join(xdegree.select(F.col("s").alias(f"need_state_{side}"), F.col("x").alias(f"x{side}")), f"need_state_{side}")
    out = out.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(xtotal))
    share = F.col("n_edges").cast("double") / F.col("m")
    lift = F.col("weight_sum") / F.nullif(F.col("da") * F.col("db") / (2 * F.col("w")), F.lit(0.0))
    chance = (F.col("xa").cast("double") / (2 * F.col("m"))) * (F.col("xb").cast("double") / (2 * F.col("m"))) * 2
    return out.select("need_state_a", "need_state_b", "n_edges", "weight_sum", share.alias("share_of_all_edges"), lift.alias("lift"), (share / F.nullif(chance, F.lit(0.0))).alias("cross_lift")).orderBy(F.desc("n_edges"), "need_state_a", "need_state_b").limit(top_n)


def neighbouring_states(adj: DataFrame, state: int, top_n: int = 5) -> DataFrame:
    """A state's neighbours from either column, with the share of this state's weight; greatest lift first."""
    left = adj.where(F.col("need_state_a") == state).select(F.col("need_state_b").alias("need_state"), "n_edges", "weight_sum", "lift", F.col("share_a").alias("share_of_this"))
    right = adj.where(F.col("need_state_b") == state).select(F.col("need_state_a").alias("need_state"), "n_edges", "weight_sum", "lift", F.col("share_b").alias("share_of_this"))
    return left.unionByName(right).orderBy(F.desc("lift"), "need_state").limit(top_n)


def save_all(edges: DataFrame, labels: DataFrame, folder: str, max_week_gap: int | None = 1, min_support: int = 30) -> None:
    """Adjacency and transitions of the labelled rows, as tables in ``folder``."""
    named = labels.where(F.col("label") != UNCLUSTERED)
    adjacency(edges, named).write.mode("overwrite").parquet(f"{folder}/adjacency")
    transitions(named, "label", max_week_gap, min_support).write.mode("overwrite").parquet(f"{folder}/transitions")
