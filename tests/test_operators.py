"""Hand-computed cases of the basket operators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from occasio.functions import scalar as S
from occasio.operators import baskets as B
from occasio.operators import community as C
from occasio.operators import encoder as E
from occasio.operators import graphs as G
from occasio.operators import mixture as M
from occasio.operators import products as P
from occasio.operators import profiles as R
from occasio.operators import states as N
from occasio.operators import vectors as V


def txn(spark, rows):
    return spark.createDataFrame([(h, p, 2026, 4, w, q, 1, 1.0) for h, p, w, q in rows], "household_number long, tpnb int, year_number int, period_number int, week_number int, quantity double, orders long, sales double")


def baskets(spark, rows):
    """rows: (basket_id, [products])."""
    return spark.createDataFrame([(int(b.split("_")[0]), int(b.split("_")[1]), b, [(p, 1.0) for p in ps], len(ps)) for b, ps in rows], "household_number long, year_week_number int, basket_id string, items array<struct<tpnb:string,quantity:double>>, n_products int")


def test_baskets_keep_nulls_aligned_and_small_ones_out(spark):
    t = txn(spark, [(1, 10, 15, 2.0), (1, 9, 15, None), (2, 9, 15, 1.0), (None, 9, 15, 7.0)])
    b = B.build_baskets(t).collect()
    assert len(b) == 1 and b[0]["basket_id"] == "1_202615" and b[0]["size_bucket"] == 1
    assert [(i["tpnb"], i["quantity"]) for i in b[0]["items"]] == [("10", 2.0), ("9", None)]
    assert B.product_units(t).where("tpnb = '9'").first()["avg_quantity"] == 4.0  # null households and dropped baskets count


def test_numbers_are_dense_and_ordered(spark):
    df = spark.createDataFrame([(i * 37 % 1009, i % 3) for i in range(500)], "h long, w long")
    got = B.numbered(df, "h", ["h", "w"], "n", ranges=16).orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1, 501)) and [(r["h"], r["w"]) for r in got] == sorted((r["h"], r["w"]) for r in got)


def test_dictionary_is_in_numeric_order(spark):
    b = baskets(spark, [("1_1", ["100", "9"]), ("2_1", ["20", "9"])])
    assert [r["tpnb"] for r in B.product_dictionary(b).orderBy("product_index").collect()] == ["9", "20", "100"]


@pytest.mark.parametrize(("values", "want"), [([5.0, 5.0, 5.0], [1, 1, 1]), ([0.0, 0.0], [0, 0]), ([2.0, 4.0, 6.0], [0, 0.5, 1])])
def test_minmax(spark, values, want):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "g int, i int, v double")
    assert [r["x"] for r in df.select("i", S.minmax_within(F.col("v"), "g").alias("x")).orderBy("i").collect()] == want


def test_log_units(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 0.0, -1.0, -3.0, -0.5, 2.0)], "u double")
    got = [r[0] for r in df.select(S.log_units(F.col("u"))).collect()]
    assert got == pytest.approx([math.log(2), 0, 0, 0, math.log1p(-0.5), math.log1p(2)])


def test_repeated_products_add_up(spark):
    b = spark.createDataFrame([("1_1", [("A", 2.0), ("B", 1.0), ("A", 5.0), ("C", None), ("C", None), ("D", 1.0), ("D", None)])], "basket_id string, items array<struct<tpnb:string,quantity:double>>")
    got = {r["tpnb"]: r["units"] for r in G.basket_nodes(b).collect()}
    assert got == {"A": 7.0, "B": 1.0, "C": 1.0, "D": 1.0}
    assert G.basket_nodes(b, spark.createDataFrame([("Z",)], "tpnb string")).count() == 0


def test_copurchase_counts_baskets_not_rows(spark):
    b = baskets(spark, [("1_1", ["0", "1", "1"]), ("2_1", ["0", "1"])])
    assert [tuple(r) for r in G.copurchase(b).collect()] == [("0", "1", 2)]
    assert sorted(tuple(r) for r in G.copurchase(b, diagonal=True).collect()) == [("0", "0", 2), ("0", "1", 2), ("1", "1", 2)]


def test_strongest_partners(spark):
    pairs = spark.createDataFrame([("b", "0", str(j), 10 * j) for j in range(1, 13)], "basket_id string, src string, dst string, n long")
    got = G.basket_edges(pairs, 10)
    assert sorted(int(r["dst"]) for r in got.collect()) == list(range(3, 13))
    small = spark.createDataFrame([("b", "0", "1", 30), ("b", "0", "2", 90), ("b", "0", "3", 60)], "basket_id string, src string, dst string, n long")
    assert [r["rel"] for r in G.basket_edges(small, 10).orderBy("dst").collect()] == pytest.approx([1 / 3, 1.0, 2 / 3])


def test_packed_graphs_are_those_of_the_relations(spark):
    rng = np.random.default_rng(5)
    rows = [(h, 2026, 1 + w, str(p), q, p if p % 4 else None, 0.1 * p if p % 3 else None) for h in range(12) for w in range(2) for p in sorted(rng.choice(14, size=int(rng.integers(2, 14)), replace=False).tolist()) for q in ([1.0 + p] if p % 5 else [None, 2.0])]
    rows += [(99, 2026, 1, "77", -2.0, 3, None), (99, 2026, 1, "77", 1.0, 3, None), (98, 2026, 1, "50", 1.0, 3, float("inf")), (98, 2026, 1, "51", 1.0, 3, float("nan"))]
    txn = spark.createDataFrame(rows, "household_number long, year_number int, week_number int, tpnb string, quantity double, vec int, distinctiveness double")
    b = B.build_baskets(txn)
    nodes = G.basket_nodes(b)
    pairs = G.basket_pairs(nodes, G.copurchase(b))
    # NaN and infinities are 0, as the relations have them; null is 0.5.
    plain = txn.select("tpnb", "distinctiveness").distinct()
    scalars = {(r[0], r[1]): r[2:] for r in G.node_scalars(nodes, G.cp_score(nodes, pairs), plain).collect()}
    edges = {(r[0], r[1], r[2]): r[3:] for r in G.basket_edges(pairs, 3).collect()}
    packed = G.product_rows(B.build_baskets(txn, extra=("vec", "distinctiveness")))
    names = {r["basket_id"]: r["p"] for r in packed.collect()}
    for most in (G.FEW, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(G.few, "__defaults__", (most,))
            got = G.pack_graphs(packed, G.counted_pairs(packed), 3).collect()
        assert {r["basket_id"] for r in got} == {k for k, _ in scalars}
        mine = {(r["basket_id"], p): r["scalars"][3 * i : 3 * i + 3] for r in got for i, p in enumerate(names[r["basket_id"]])}
        assert mine.keys() == scalars.keys() and all(mine[k] == pytest.approx(list(scalars[k])) for k in mine)
        links = {(r["basket_id"], names[r["basket_id"]][s], names[r["basket_id"]][d]): r["attr"][2 * i : 2 * i + 2] for r in got for i, (s, d) in enumerate(zip(r["src"], r["dst"]))}
        assert links.keys() == edges.keys() and all(links[k] == pytest.approx(list(edges[k])) for k in links)
        assert all(r["vec"] == [None if int(p) < 14 and int(p) % 4 == 0 else 3 if int(p) > 13 else int(p) for p in names[r["basket_id"]]] for r in got)


def test_large_baskets_are_packed_in_parts():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    some = [(int(i), int(j), int(rng.integers(2, 9))) for i, j in {tuple(sorted(rng.choice(40, 2, replace=False).tolist())) for _ in range(90)}]
    b = pa.RecordBatch.from_pydict({"basket_id": ["a", "b"], "units": [[1.0] * 40] * 2, "vec": [list(range(40))] * 2, "distinctiveness": [[0.5] * 40] * 2, **{c: [[x[k] for x in some], None] for k, c in enumerate("ijn")}})
    assert G._packed(b, 5, 64).equals(G._packed(b, 5))


def test_graphs_hold_no_vectors_and_read_them_once(spark):
    vectors = (np.array([2, 5]), np.array([[1.0, 0.0], [0.0, 2.0]], np.float32))
    kinds = "basket_id string, n_nodes int, vec array<int>, scalars array<double>, src array<int>, dst array<int>, attr array<double>"
    g = spark.createDataFrame([("a", 2, [5, 2], [0.1, 0.2, 0.3, 0.4, 0.5, 0.6], [0, 1], [1, 0], [0.7, 1.0, 0.7, 1.0]), ("b", 1, [None], [0.0, 0.5, 0.7], [], [], []), ("c", 1, [3], [0.0, 0.5, 0.7], [], [], [])], kinds)
    enc, history = E.train(g, 5, vectors=vectors, epochs=3, hidden=4, dim=3)
    got = {r["basket_id"]: r["embedding"] for r in E.embed(g, enc, vectors).collect()}
    frame = pd.DataFrame({"x": [[0.0, 2.0, 0.1, 0.2, 0.3, 1.0, 0.0, 0.4, 0.5, 0.6], [0.0, 0.0, 0.0, 0.5, 0.7]], "n_nodes": [2, 1], "src": [[0, 1], []], "dst": [[1, 0], []], "attr": [[0.7, 1.0, 0.7, 1.0], []]})
    want, _ = enc.forward(E.batch_of(frame, 5))
    assert got["a"] == pytest.approx(want[0].tolist(), rel=1e-5) and got["b"] == got["c"] == pytest.approx(want[1].tolist(), rel=1e-5) and len(history) == 3


def test_keys(spark):
    df = spark.createDataFrame([("1000_202615",), ("a_b_c",), ("7_x",), ("2000_202616",)], "basket_id string")
    assert [(r["household_number"], r["year_week_number"]) for r in N.split_keys(df).orderBy("household_number").collect()] == [(1000, 202615), (2000, 202616)]
    with pytest.raises(ValueError):
        N.split_keys(spark.createDataFrame([("nounderscore",)], "basket_id string"))


def test_week_ranks_cross_the_year(spark):
    df = spark.createDataFrame([(w,) for w in (202602, 202551, 202601, 202552)], "year_week_number int")
    assert {r["year_week_number"]: r["week_rank"] for r in N.week_ranks(df).collect()} == {202551: 0, 202552: 1, 202601: 2, 202602: 3}


def labels(spark, rows):
    return spark.createDataFrame(rows, "basket_id string, need_state long")


def test_transitions(spark):
    rows = [(f"{h}_{w}", s) for h in range(10) for w, s in ((202551, 0), (202552, 1), (202601, 2))]
    got = N.transitions(labels(spark, rows)).collect()
    assert {(r["from_need_state"], r["to_need_state"]): (r["n_transitions"], r["prob"]) for r in got} == {(0, 1): (10, 1.0), (1, 2): (10, 1.0)}
    gaps = labels(spark, [("5_202601", 0), ("5_202605", 1), ("6_202602", 0), ("6_202603", 0), ("6_202604", 0)])
    one = {(r[0], r[1]) for r in N.transitions(gaps).collect()}
    every = {(r[0], r[1]) for r in N.transitions(gaps, max_week_gap=None).collect()}
    assert one == {(0, 0)} and every == {(0, 0), (0, 1)}


def trans(spark, rows):
    return spark.createDataFrame([(a, b, p, False) for a, b, p in rows], "from_need_state long, to_need_state long, prob double, low_support boolean")


def test_journeys(spark):
    t = trans(spark, [(0, 1, 0.6), (0, 2, 0.4), (1, 2, 1.0)])
    assert [(r["path"], r["path_prob"]) for r in N.journeys(t, 0, 2).collect()] == [([0, 1, 2], 0.6)]
    t = trans(spark, [(0, 1, 0.6), (0, 2, 0.4), (1, 3, 1.0), (2, 3, 1.0)])
    assert {r["n_steps"] for r in N.journeys(t, 0, 2).collect()} == {2}
    part = N.journeys(t, 0, 2, include_partial=True).collect()
    assert {r["n_steps"] for r in part} == {1, 2} and part[0]["n_steps"] == 1
    assert [r["path"] for r in N.journeys(trans(spark, [(0, 1, 0.9)]), 0, 3).collect()] == [[0, 1]]
    assert N.journeys(t, 99).count() == 0


def test_household(spark):
    rows = labels(spark, [("3_202551", 0), ("3_202552", 1), ("3_202601", 2), ("4_202551", 1)])
    assert [r["need_state"] for r in N.household_history(rows, 3).collect()] == [0, 1, 2]
    t = trans(spark, [(2, 0, 1.0)])
    assert N.journeys_for_household(rows, t, 3).first()["current_need_state"] == 2
    assert N.journeys_for_household(rows, t, 77).count() == 0


def adjacency_case(spark):
    lab = spark.createDataFrame([("1_1", 0), ("2_1", 0), ("3_1", 1), ("4_1", 1)], "basket_id string, label long")
    edges = spark.createDataFrame([("1_1", "3_1", 1.0), ("1_1", "4_1", 2.0), ("2_1", "3_1", 3.0), ("1_1", "2_1", 4.0)], "basket_a string, basket_b string, weight double")
    return edges, lab


def test_adjacency(spark):
    edges, lab = adjacency_case(spark)
    r = N.adjacency(edges, lab).collect()
    assert len(r) == 1 and (r[0]["n_edges"], r[0]["weight_sum"]) == (3, 6.0)
    assert (r[0]["lift"], r[0]["share_a"], r[0]["share_b"]) == pytest.approx((6 / 4.2, 6 / 14, 1.0))
    x = N.adjacency_export(edges, lab, 5).first()
    assert x["lift"] == pytest.approx(6 / 4.2) and x["cross_lift"] == pytest.approx(2.0)
    flipped = spark.createDataFrame([("3_1", "1_1", 1.0), ("1_1", "3_1", 1.0)], edges.schema)
    assert [q["n_edges"] for q in N.adjacency(flipped, lab).collect()] == [2]


def lookup(spark):
    return spark.createDataFrame([], "tpnb string, description string, department string")


def test_lift_of_pure_size_is_one(spark):
    rows = [(f"{b}_1", [str((2 * b) % 6), str((2 * b + 1) % 6)], 0) for b in range(60)] + [(f"{100 + b}_1", [str((4 * b + i) % 6) for i in range(4)], 1) for b in range(30)]
    b = baskets(spark, [(k, p) for k, p, _ in rows])
    lab = spark.createDataFrame([(k, s) for k, _, s in rows], "basket_id string, label long")
    got = R.profiles(R.state_product_counts(b, lab), lookup(spark), 10, 1).collect()
    assert len(got) == 12 and all(r["lift"] == pytest.approx(1.0, abs=1e-9) for r in got)
    assert sum(r["share_within_need_state"] for r in got) == pytest.approx(2.0)


def test_lift_ignores_unlabelled_baskets(spark):
    rows = [(f"{i}_1", ["0", "1"], 0) for i in range(40)] + [(f"{100 + i}_1", ["2", "3"], 1) for i in range(40)]
    junk = [(f"{1000 + i}_1", ["0", "4", "5"], -1) for i in range(100)]
    b = baskets(spark, [(k, p) for k, p, _ in rows + junk] + [(f"{3000 + i}_1", ["0", "4", "5"]) for i in range(100)])
    lab = spark.createDataFrame([(k, s) for k, _, s in rows + junk], "basket_id string, label long")
    got = R.profiles(R.state_product_counts(b, lab), lookup(spark), 10, 1).collect()
    assert len(got) == 4 and all(r["lift"] == pytest.approx(2.0) for r in got)


def test_coverage_and_bands(spark):
    rows = [(f"{i}_1", ["0", "1", "2"], 0) for i in range(80)] + [(f"{100 + i}_1", ["1", "2"], 0) for i in range(20)] + [(f"{200 + i}_1", ["1", "2", "3"], 1) for i in range(100)]
    b = baskets(spark, [(k, p) for k, p, _ in rows])
    lab = spark.createDataFrame([(k, s) for k, _, s in rows], "basket_id string, label long")
    p = R.profiles(R.state_product_counts(b, lab), lookup(spark), 10, 1)
    e = R.enriched(R.summary(b, lab), p)
    zero = e.where("need_state = 0").first()
    assert (zero["avg_products_per_basket"], zero["top_share"], zero["top_product_coverage"]) == pytest.approx((2.8, 80 / 280, 0.8))
    assert zero["label"] == "(no description available)" and zero["size_band"] == "2-5"
    assert [r["n_ns"] for r in R.band_table(e, "size").orderBy("band_no").collect()] == [0, 2, 0, 0, 0, 0]
    edges = spark.createDataFrame([(0.1,), (0.25,), (0.1000001,)], "x double")
    assert [r[0] for r in edges.select(S.banded(F.col("x"), *R.COVERAGE_BANDS)).collect()] == ["< 10%", "10-25%", "10-25%"]


def test_spearman_averages_ties(spark):
    pdf = pd.DataFrame({"x": [1.0, 1.0, 2.0, 3.0, None], "y": [3.0, 1.0, 1.0, 5.0, 2.0]})
    want = pdf["x"].rank().corr(pdf["y"].rank())
    got = R.spearman(spark.createDataFrame([tuple(None if pd.isna(v) else v for v in r) for r in pdf.itertuples(index=False)], "x double, y double"), "x", "y").first()["rho"]
    assert got == pytest.approx(want)


def test_permutation_keeps_sizes_and_sentinels(spark):
    lab = spark.createDataFrame([(f"{i}_1", i % 3 - 1) for i in range(90)], "basket_id string, label long")
    for seed in (None, 7):
        got = R.permuted(lab, seed)
        assert {r["label"]: r["count"] for r in got.groupBy("label").count().collect()} == {-1: 30, 0: 30, 1: 30}
        assert got.where("label = -1").join(lab.where("label = -1"), "basket_id").count() == 30
    assert sorted(map(tuple, R.permuted(lab, 7).collect())) == sorted(map(tuple, R.permuted(lab.repartition(5), 7).collect()))


@pytest.mark.parametrize(("bases", "want"), [(["clustered"], "OK"), (["clustered", None], "MIXED"), (["population"], "ALL-STALE"), ([None, None], "ALL-STALE"), (["population", "clustered"], "MIXED")])
def test_basis(spark, bases, want):
    log = spark.createDataFrame([(f"r{i}", b) for i, b in enumerate(bases)], "run string, lift_basis string")
    assert R.basis_verdict(log).first()["verdict"] == want


def test_excess(spark):
    for obs, null, want in ((1.949, 1.255, 0.694), (1.811, 1.234, 0.577), (1.732, 1.261, 0.471), (1.639, 1.199, 0.440)):
        a, b = (spark.createDataFrame([(n, v)], "run string, median_max_lift double") for n, v in (("a", obs), ("b", null)))
        assert R.with_null(a, b).first()["excess"] == pytest.approx(want)
    with pytest.raises(ValueError):
        R.with_null(a, a)


def test_means(spark):
    v = spark.createDataFrame([("A", [1.0, 0.0]), ("B", [3.0, 4.0]), ("C", [5.0, 6.0])], "tpnb string, embedding array<float>")
    b = baskets(spark, [("1_1", ["A", "B"]), ("2_1", ["C"]), ("3_1", ["D"]), ("4_1", []), ("5_1", ["A", "D", "C"])])
    got = {r["basket_id"]: (r["n_used"], r["embedding"]) for r in V.mean_vectors(b, v).collect()}
    assert got == {"1_1": (2, [2.0, 2.0]), "2_1": (1, [5.0, 6.0]), "3_1": (0, [0.0, 0.0]), "4_1": (0, [0.0, 0.0]), "5_1": (2, [3.0, 3.0])}
    with pytest.raises(ValueError):
        V.mean_vectors(baskets(spark, [("1_1", ["Z"])]), v)


def test_neighbours_are_exact_whatever_the_blocks(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 5))
    x[7] = x[3]  # a tie
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    want = {i: sorted((j for j in range(90) if j != i), key=lambda j: (-round(s[i, j], 12), j))[:4] for i in range(90)}
    for size in (4096, 20):
        got = V.nearest(df, df, "id", 4, block_rows=size).orderBy("id", "rank").collect()
        assert {i: [r["neighbour"] for r in got if r["id"] == i] for i in range(90)} == want


def test_means_are_taken_inside_rows_or_by_a_join(spark, monkeypatch):
    v = spark.createDataFrame([("A", [1.0, 0.0]), ("B", [3.0, 4.0])], "tpnb string, embedding array<float>")
    b = baskets(spark, [("1_1", ["A", "B"]), ("2_1", ["D"])])
    inside = V.mean_vectors(b, v)
    assert "Exchange" not in inside._jdf.queryExecution().toString()
    monkeypatch.setattr(V, "SENT_ENTRIES", 0)
    assert sorted(inside.collect()) == sorted(V.mean_vectors(b, v).collect())


def test_different_vectors_are_sent_once(spark, monkeypatch):
    v = spark.createDataFrame([(str(i), [float(i % 2), 3.0]) for i in range(50)], "tpnb string, embedding array<float>")
    b = baskets(spark, [("1_1", ["1", "2", "4"]), ("2_1", ["D", None]), ("3_1", ["49"])])
    monkeypatch.setattr(V, "SENT_ENTRIES", 4)
    got = V.mean_vectors(b, v)
    assert "Exchange" not in got._jdf.queryExecution().toString()  # 50 products of 2 vectors: baskets stay where they are
    assert {r["basket_id"]: (r["n_used"], r["embedding"]) for r in got.collect()} == {"1_1": (3, [1 / 3, 3.0]), "2_1": (0, [0.0, 0.0]), "3_1": (1, [1.0, 3.0])}


def test_labels_in_rows_or_by_a_join(spark, monkeypatch):
    from occasio.operators import products as P
    from occasio.plans import fixtures as X

    inside = X.labels(spark, "/root/testdata/sf0.001", X.baskets(spark, "/root/testdata/sf0.001"))
    monkeypatch.setattr(P, "SENT_PRODUCTS", 0)
    rows = sorted(X.labels(spark, "/root/testdata/sf0.001").collect())
    assert rows and sorted(inside.collect()) == rows


def test_neighbours_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rng.normal(size=(200, 4)))], "id long, embedding array<float>")
    want = sorted(V.nearest(df, df, "id", 3, block_rows=2).collect())  # 8 blocks of each side
    monkeypatch.setattr(V, "SENT_ROWS", 700)
    parts, settled = [], V.settled
    monkeypatch.setattr(V, "settled", lambda x: (parts.append(x), settled(x))[1])
    assert sorted(V.nearest(df, df, "id", 3, block_rows=2).collect()) == want and len(want) == 600
    assert len(parts) == 10  # both sides, and 8 parts of one block of queries


def test_votes_are_searched_for_once_a_vector(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-1, 3, size=(400, 3)).astype(float)  # 64 vectors, some of one direction, and a zero one
    x[7] = np.nan
    kind = "id string, embedding array<float>"
    every = [(f"{i}_1", r.tolist()) for i, r in enumerate(x)]
    base, queries = spark.createDataFrame(every[:300], kind), spark.createDataFrame(every[250:] + [("x_1", [float("nan")] * 3)], kind)
    labels = spark.createDataFrame([(f"{i}_1", int(rng.integers(5))) for i in range(5, 350)], "id string, label long")
    for k in (1, 4, 500):
        voters = base.join(labels.select("id"), "id", "left_semi")
        want = sorted(V.vote(V.nearest(queries, voters, "id", k), labels, "id").collect())
        seen = []
        got = V.vote_of_nearest(queries, base, labels, "id", k, lambda q, b, key, k: (seen.append((q.count(), b.count())), V.nearest(q, b, key, k))[1])
        assert sorted(got.collect()) == want and len(want) == 150
        assert seen[0][0] <= 50 + 65 and seen[0][1] <= 65  # 50 queries are in the base too
    with pytest.raises(ValueError, match="occurs 2 times"):
        V.vote_of_nearest(queries, base.union(base.limit(20)), labels, "id", 3)


def test_mutual_edges_and_probe(spark):
    idx = [[1, 3], [0, 4], [0, 1], [4, 0], [3, 1]]
    n = spark.createDataFrame([(i, j, 0.9, r + 1) for i, js in enumerate(idx) for r, j in enumerate(js)], "id long, neighbour long, similarity double, rank int")
    e = V.similarity_edges(n, "id", mutual=True)
    covered = {r["id"] for r in V.endpoints(e).distinct().collect()}
    assert covered == {0, 1, 3, 4}
    universe = spark.range(5)
    assert {r["k"]: r["n_covered"] for r in V.coverage_probe(n, universe, "id", (1, 2)).collect()} == {1: 4, 2: 4}
    with pytest.raises(ValueError, match="80.0%"):
        V.check_coverage(e, universe, "id", 0.95)


def test_vote_ties_go_to_the_least_label(spark):
    n = spark.createDataFrame([(1, 10 + i, 0.5, i + 1) for i in range(4)], "id long, neighbour long, similarity double, rank int")
    lab = spark.createDataFrame([(10, 7), (11, 3), (12, 3), (13, 7)], "id long, label long")
    assert tuple(V.vote(n, lab, "id").first()) == (1, 3, 0.5)


def groups(got):
    by = {}
    for r in got:
        by.setdefault(r["label"], set()).add(r["id"])
    return sorted(map(sorted, by.values()))


def planted_cliques(spark, sizes=(6, 6, 6), bridge=0.01, name=lambda i: i, kind="long"):
    """Cliques of weight 1, joined in a row by weak bridges."""
    rows, at = [], 0
    for size in sizes:
        rows += [(name(at + i), name(at + j), 1.0) for i in range(size) for j in range(i + 1, size)] + ([(name(at - 1), name(at), bridge)] if at else [])
        at += size
    return spark.createDataFrame(rows, f"basket_a {kind}, basket_b {kind}, weight double")


def test_planted_cliques(spark):
    edges = planted_cliques(spark)
    want = [list(range(0, 6)), list(range(6, 12)), list(range(12, 18))]
    assert groups(C.leiden(edges).collect()) == want
    assert groups(C.leiden(edges, method="joins").collect()) == want
    with pytest.raises(ValueError):
        C.leiden(edges, edge_cap=10)
    text = planted_cliques(spark, (5, 5), name=lambda i: f"v{i:02d}", kind="string")
    assert groups(C.leiden(text, method="joins").collect()) == [[f"v{i:02d}" for i in r] for r in (range(5), range(5, 10))]
    lab = C.leiden(edges)
    assert C.modularity(edges, lab).first()[0] > 0.6
    zero = edges.withColumn("weight", F.lit(0.0))
    assert C.leiden(zero).count() == 18
    everyone = C.leiden(edges, universe=spark.range(20)).collect()
    assert len(everyone) == 20 and {r["id"] for r in everyone if r["label"] == -1} == {18, 19}


def test_leiden_as_joins_is_as_good_and_connected(spark):
    rng = np.random.default_rng(3)
    rows = {(int(min(a, b)), int(max(a, b))) for g in range(6) for a, b in rng.integers(g * 12, g * 12 + 12, (40, 2)) if a != b}
    rows |= {(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 72, (40, 2)) if a != b}
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in sorted(rows)], "basket_a long, basket_b long, weight double")
    mine, theirs = C.settled(C.leiden(edges, method="joins")), C.leiden(edges)
    q = [C.modularity(edges, x).first()[0] for x in (mine, theirs)]
    assert q[0] >= q[1] - 0.03 and q[0] > 0.4
    named = {r["id"]: r["label"] for r in mine.collect()}
    for label in set(named.values()):
        left = {i for i, x in named.items() if x == label}
        reach, new = set(), {min(left)}
        while new:
            reach |= new
            new = {b for a, b in rows | {(b, a) for a, b in rows} if a in reach and b in left} - reach
        assert reach == left


def test_approximate_neighbours(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(20, 8))
    x = np.concatenate([centre[rng.integers(20, size=600)] + 0.3 * rng.normal(size=(600, 8)), np.tile(centre[0], (300, 1)) + 1e-3 * rng.normal(size=(300, 8)), np.zeros((3, 8))])
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>")
    want = {(r["id"], r["neighbour"]) for r in V.nearest(v, v, "id", 5).collect()}
    got, probes, found = V.nearest_approximate(v, v, "id", 5, recall=0.95, block_rows=64)
    rows = got.collect()
    mine = {(r["id"], r["neighbour"]) for r in rows}
    assert found >= 0.95 and len(want & mine) >= 0.9 * len(want) and probes < 30
    assert all(r["id"] != r["neighbour"] and 1 <= r["rank"] <= 5 for r in rows) and {r["id"] for r in rows} == set(range(903))
    whole = V.nearest_in_lists(v, v, "id", 5, V.centroids(v, "id", 7), 7, block_rows=50)
    assert {(r["id"], r["neighbour"]) for r in whole.collect()} == want
    assert V.nearest_approximate(v.limit(0), v.limit(0), "id", 5)[0].count() == 0


def test_a_query_is_sent_to_a_cell_once(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 6))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<float>")
    c = V.centroids(v, "id", 40)
    rows = V._lists(v, "id", c, 40)
    assert rows.count() == 400 and dict(rows.dtypes)["v"] == "array<float>"  # not 400 * 40 vectors
    cells = V._cells({i: 10 for i in range(40)}, c, 100)
    assert max(cells) == 3 and all(cells.count(n) == 10 for n in range(4))
    want = {(r["id"], r["neighbour"]) for r in V.nearest(v, v, "id", 5).collect()}
    assert {(r["id"], r["neighbour"]) for r in V.nearest_in_lists(v, v, "id", 5, c, 40, block_rows=100).collect()} == want


def test_best_in_parts_with_ties_and_few_rows():
    rng = np.random.default_rng(9)
    unit = V._unit(rng.integers(-1, 2, size=(300, 4)).astype(float))  # many are equal
    key = np.arange(300)
    s = np.einsum("ij,kj->ik", unit, unit)
    for k, columns in ((7, 16), (7, 4096), (299, 64), (500, 64)):
        got = [np.concatenate(x) for x in zip(*V._best(unit, unit, key, key, k, rows=50, columns=columns))]
        for i in range(300):
            mine = got[1][got[0] == i]
            assert len(mine) == min(k, 299) and i not in mine
            assert np.allclose(s[i, mine], np.sort(np.delete(s[i], i))[::-1][:k], atol=1e-12)
            exact = got[2][got[0] == i]
            assert all(exact[n] > exact[n + 1] or mine[n] < mine[n + 1] for n in range(len(mine) - 1))


def test_numbers_with_one_key_far_out(spark):
    rows = [(h, w) for h in [*range(200), 10**15] for w in range(3)]
    df = spark.createDataFrame(rows, "h long, w int").repartition(5)
    got = sorted(map(tuple, B.numbered(df, "h", ["h", "w"], ranges=16).select("h", "w", "basket_seq").collect()))
    assert [r[2] for r in got] == list(range(1, len(rows) + 1))
    text = spark.createDataFrame([(f"k{i % 97:03d}", i) for i in range(300)], "h string, w int")
    got = sorted(map(tuple, B.numbered(text, "h", ["h", "w"], ranges=8).select("h", "w", "basket_seq").collect()))
    assert [r[2] for r in got] == list(range(1, 301))


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "basket_a long, basket_b long")
    got = {r["id"]: r["component"] for r in C.connected_components(e).collect()}
    assert set(got.values()) == {0, 100} and got[30] == 0 and got[101] == 100


def test_ari(spark):
    a = spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, label long")
    assert C.adjusted_rand(a, a.withColumn("label", F.col("label") + 5)).first()["ari"] == pytest.approx(1.0)
    assert C.adjusted_rand(a, a.withColumn("label", F.lit(1).cast("long"))).first()["ari"] == pytest.approx(0.0)


@pytest.mark.parametrize("covariance", ["diag", "full", "tied", "spherical"])
def test_mixture_finds_blobs(spark, covariance):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(-4, 1, (60, 4)), rng.normal(4, 1, (60, 4)), np.tile(rng.normal(4, 1, (1, 4)), (5, 1))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<double>")
    m = M.fit(df, 2, covariance=covariance, max_iter=10)
    post = M.posteriors(df, m, "id").orderBy("id").collect()
    assert all(sum(r["probability"]) == pytest.approx(1) for r in post)
    lab = [r["label"] for r in post]
    assert len(set(lab[:60])) == 1 and len(set(lab[60:])) == 1 and lab[0] != lab[-1]
    grid = M.component_overlap(M.posteriors(df, m, "id"), 2).collect()
    assert len(grid) == 4 and sum(r["mean_posterior"] for r in grid) == pytest.approx(2)


def test_encoder_gradients_and_empty_graphs():
    rng = np.random.default_rng(0)
    frame = pd.DataFrame({"basket_id": ["a", "b", "c"], "x": [list(rng.normal(size=9)), list(rng.normal(size=6)), []], "n_nodes": [3, 2, 0], "src": [[0, 1, 2], [0], []], "dst": [[1, 2, 0], [1], []], "attr": [list(rng.normal(size=6)), [0.1, 0.2], []]})
    enc = E.Encoder(3, 4, 2, 0)
    b = E.batch_of(frame, 3)
    _, g = enc.gradients(b)
    for k in ("in", "e1", "w2", "dec", "out_b"):
        i = tuple(0 for _ in enc.p[k].shape)
        old, eps = enc.p[k][i], 1e-6
        enc.p[k][i] = old + eps
        up = enc.gradients(b)[0]
        enc.p[k][i] = old - eps
        down = enc.gradients(b)[0]
        enc.p[k][i] = old
        assert g[k][i] == pytest.approx((up - down) / (2 * eps), rel=1e-3, abs=1e-7)
    history = enc.train(pd.concat([frame] * 20), epochs=15, batch=16, rate=1e-2)
    assert history[-1] < history[0]
    assert enc.forward(b)[0].shape == (3, 2)


def test_encoder_is_kept(spark, tmp_path):
    enc = E.Encoder(5, 4, 3, 1)
    enc.save(spark, f"{tmp_path}/enc")
    again = E.Encoder.load(spark, f"{tmp_path}/enc")
    assert (again.width, again.hidden, again.dim) == (5, 4, 3) and all((again.p[k] == enc.p[k]).all() for k in enc.p)
    spark.read.parquet(f"{tmp_path}/enc").where("name <> 'dec'").write.parquet(f"{tmp_path}/part")
    with pytest.raises(ValueError):
        E.Encoder.load(spark, f"{tmp_path}/part")


def test_key_overlap(spark):
    a = spark.createDataFrame([(str(i),) for i in range(10)], "tpnb string")
    said = []
    assert P.check_key_overlap(a, a.limit(4), said.append) == 0.4 and said
    with pytest.raises(ValueError, match="string"):
        P.check_key_overlap(a, spark.createDataFrame([("x",)], "tpnb string"))
    with pytest.raises(ValueError, match="empty"):
        P.check_key_overlap(a.limit(0), a)
