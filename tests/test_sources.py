"""Tables, artifacts, settings, streaming."""

import time

import pytest
from pyspark.sql import functions as F

from occasio.config import Config, ConfigError
from occasio.progress import duration, step
from occasio.sources import tables as T
from occasio.sources.artifacts import ArtifactCache, StaleArtifactError
from occasio.streaming import scoring


def test_required_columns(spark):
    with pytest.raises(T.SchemaError, match="quantity"):
        T.require_columns(spark.range(1).withColumnRenamed("id", "tpnb"), ["tpnb", "quantity"])


@pytest.mark.parametrize("tag", ["Train", "1a", "a-b", "a;drop"])
def test_tags(tag):
    with pytest.raises(ValueError):
        T.valid_tag(tag)


def test_ragged_vectors_raise(spark):
    with pytest.raises(T.SchemaError):
        T.load_vectors(spark.createDataFrame([("a", "1,2"), ("b", "1")], "tpnb string, embedding string"))
    ok = T.load_vectors(spark.createDataFrame([(1, " 1, 2.5")], "tpnb int, embedding string")).first()
    assert (ok["tpnb"], ok["embedding"]) == ("1", [1.0, 2.5])


def test_merge_and_duplicates(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "basket_id string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 3)], "basket_id string, v int")
    assert sorted(map(tuple, T.merge_keep_last(old, new).collect())) == [("a", 1), ("b", 9), ("c", 3)]
    assert [r[0] for r in T.exclude_existing(new, old).collect()] == ["c"]
    assert T.exclude_existing(new, None).count() == 2
    with pytest.raises(ValueError, match="'b'"):
        T.merge_refusing_duplicates(old.unionByName(new))


def test_log_order(spark):
    log = spark.createDataFrame([("x", 0.4), ("y", 0.65), ("z", None)], "run string, excess double")
    got = T.upsert_log(log, spark.createDataFrame([("x", 0.5, "n")], "run string, excess double, note string")).collect()
    assert [(r["run"], r["excess"], r["note"]) for r in got] == [("y", 0.65, None), ("x", 0.5, "n"), ("z", None, None)]


def test_digest_ignores_order(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    a, b = T.content_digest(df).first(), T.content_digest(df.repartition(7).orderBy(F.desc("id"))).first()
    assert tuple(a) == tuple(b) and tuple(a) != tuple(T.content_digest(df.where("id < 99")).first())


def test_capped_write(spark, tmp_path):
    assert T.capped_write(spark.range(5), f"{tmp_path}/a", 5) == 5
    with pytest.raises(ValueError):
        T.capped_write(spark.range(6), f"{tmp_path}/b", 5)


def test_artifacts(spark, tmp_path):
    cache, built = ArtifactCache(spark, f"file://{tmp_path}"), []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert cache.get("edges", {"k": 5}, build).count() == 3
    assert len(built) == 1
    cache.get("edges", {"k": 6}, build)
    assert len(built) == 2
    with pytest.raises(StaleArtifactError):
        cache.load("edges", {"k": 7})
    cache.smoke("edges", {"k": 7}, spark.range(9), 2)
    with pytest.raises(StaleArtifactError):
        cache.load("edges", {"k": 7})
    assert len(cache.drop("edges", {"k": 5})) == 2 and cache.load("edges", {"k": 5}).count() == 3
    cache.drop("edges", {"k": 5}, dry_run=False)
    with pytest.raises(StaleArtifactError):
        cache.load("edges", {"k": 5})
    runs = cache.checked_runs({"a": {"label_states": 5, "profile_states": 5, "edges": {"k": 1}, "label_edges": {"k": 2}}, "b": {"label_states": 5, "profile_states": 4}})
    assert list(runs) == ["a"] and runs["a"]["edges"] is None


def test_config():
    c = Config.from_env({"OCCASIO_KNN_K": "30", "OCCASIO_MUTUAL_KNN": "false", "OCCASIO_MAX_WEEK_GAP": "none", "OCCASIO_SIZE_BAND": "2,9"})
    assert (c.knn_k, c.mutual_knn, c.max_week_gap, c.size_band) == (30, False, None, (2, 9))
    assert c.fingerprint("seed") == Config().fingerprint("seed") and c.fingerprint("knn_k") != Config().fingerprint("knn_k")
    for bad in ({"OCCASIO_KNN_K": "x"}, {"OCCASIO_KNN_K": "0"}, {"OCCASIO_KNN_K": "none"}, {"OCCASIO_GMM_COVARIANCE": "odd"}, {"OCCASIO_MIN_GRAPH_COVERAGE": "1.5"}):
        with pytest.raises(ConfigError):
            Config.from_env(bad)


def test_steps(spark):
    said = []
    with pytest.raises(ZeroDivisionError), step("x", spark, said.append):
        1 / 0  # noqa: B018
    assert said[0] == "x ..." and said[1].startswith("x FAILED after")
    assert (duration(3.21), duration(245), duration(7380)) == ("3.2s", "4m05s", "2h03m")


def purchases(spark, rows):
    return spark.createDataFrame([(h, p, 2026, 4, w, 1.0, 1, 1.0) for h, p, w in rows], "household_number long, tpnb int, year_number int, period_number int, week_number int, quantity double, orders long, sales double")


def test_score_new_and_stream(spark, tmp_path):
    vectors = spark.createDataFrame([("1", [1.0, 0.0]), ("2", [1.0, 0.1]), ("3", [0.0, 1.0]), ("4", [0.1, 1.0])], "tpnb string, embedding array<float>")
    reference = spark.createDataFrame([(f"9{i}_1", [1.0, 0.0] if i < 5 else [0.0, 1.0]) for i in range(10)], "basket_id string, embedding array<double>")
    labels = spark.createDataFrame([(f"9{i}_1", -1 if i == 0 else int(i >= 5)) for i in range(10)], "basket_id string, label long")
    txn = purchases(spark, [(1, 1, 15), (1, 2, 15), (2, 3, 15), (2, 4, 15), (3, 8, 15), (3, 9, 15)])
    done = spark.createDataFrame([("1_202615", 7, 1.0)], "basket_id string, need_state_cluster long, cluster_confidence double")
    got = {r["basket_id"]: r["need_state_cluster"] for r in scoring.score_new(txn, vectors, reference, labels, done, k=3).collect()}
    assert got == {"1_202615": 7, "2_202615": 1, "3_202615": -1}
    assert scoring.score_new(txn.where("household_number > 99"), vectors, reference, labels, None, k=3).count() == 0
    # One file a micro-batch; household 2's basket comes in two of them, and the first one holds no basket at all.
    for i, rows in enumerate(([(2, 3, 15)], [(1, 1, 15), (1, 2, 15)], [(2, 4, 15), (3, 8, 15), (3, 9, 15)])):
        purchases(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = scoring.score_stream(scoring.purchases_stream(spark, f"{tmp_path}/in", txn.schema), lambda b: scoring.score_new(b, vectors, reference, labels, None, k=3), f"{tmp_path}/out", f"{tmp_path}/cp")
        q.awaitTermination()
        assert q.exception() is None and scoring.scored_baskets(spark, f"{tmp_path}/out").count() == (0, 1, 3)[i]
    assert {r["basket_id"]: r["need_state_cluster"] for r in scoring.scored_baskets(spark, f"{tmp_path}/out").collect()} == {"1_202615": 0, "2_202615": 1, "3_202615": -1}


def test_plan_reaches_the_scan(spark):
    """Predicates and columns are pushed into the Parquet scan, and top-n per group needs no full sort."""
    from occasio.plans.registry import QUERIES

    d = "/root/testdata/sf0.001"
    plan = T.read_table(spark, f"{d}/orders.parquet", ["o_orderkey", "o_custkey"]).where("o_custkey = 3")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,3)" in plan and "o_orderdate" not in plan
    assert "WindowGroupLimit" in QUERIES["lift_profiles"](spark, d)._jdf.queryExecution().executedPlan().toString()


def test_lifecycle(spark, tmp_path):
    from occasio.plans import lifecycle as L

    rows = []
    for h in range(40):
        for w in range(3):
            kind = (h + w) % 2
            rows += [(h, 10 * kind + (h + k) % 4, 10 + w) for k in range(3)]
    vectors = spark.createDataFrame([(str(10 * k + i), [1.0 - k, float(k), 0.1 * (i == 0), 0.1 * (i == 1)]) for k in range(2) for i in range(4)], "tpnb string, embedding array<float>")
    config = Config(knn_k=12, mutual_knn=False, min_graph_coverage=0.5, min_product_baskets=1, resolution=0.2)
    run = L.train(spark, purchases(spark, rows), vectors, f"file://{tmp_path}", config)
    assert run.baskets.count() == 120 and run.labels.where("label >= 0").count() == 120
    by = {r["basket_id"]: r["label"] for r in run.labels.collect()}
    kinds = {}
    for b, label in by.items():
        h, yw = (int(x) for x in b.split("_"))
        kinds.setdefault(label, set()).add((h + yw) % 2)
    assert all(len(v) == 1 for v in kinds.values())
    again = L.train(spark, purchases(spark, rows), vectors, f"file://{tmp_path}", config)
    assert sorted(again.labels.inputFiles()) == sorted(run.labels.inputFiles())
    lookup = spark.createDataFrame([(str(i), f"p{i}", "d") for i in range(20)], "tpnb string, description string, department string")
    described, log = L.describe("run1", run, lookup, config)
    row = log.first()
    assert row["run"] == "run1" and row["null_run"] == "run1-null" and row["excess"] > 0 and row["n_baskets_labelled"] == 120
    assert described.summary.count() == len(kinds)
    with pytest.raises(ValueError, match="%"):
        L.cluster(run.vectors.select("basket_seq", "embedding"), "basket_seq", Config(min_graph_coverage=1.0), run.edges.limit(3))


def test_export(spark, tmp_path):
    import zipfile
    from xml.etree import ElementTree

    tables = {"a": spark.range(3), "b": spark.createDataFrame([(i, f"<x & {i}>" if i else None, i / 4, i > 2) for i in range(9)], "n long, t string, f double, flag boolean").orderBy("n")}
    T.export_csv(tables, f"{tmp_path}/x")
    assert spark.read.option("header", True).csv(f"{tmp_path}/x/b").count() == 9
    assert T.export_workbook(tables, f"{tmp_path}/x.xlsx", cap=5) == {"a": False, "b": True}
    with zipfile.ZipFile(f"{tmp_path}/x.xlsx") as z:
        trees = {n: ElementTree.fromstring(z.read(n)) for n in z.namelist()}
    rows = [["".join(c.itertext()) for c in r] for r in trees["xl/worksheets/sheet2.xml"][0]]
    assert rows == [["n", "t", "f", "flag"], ["0", "", "0.0", "0"], ["1", "<x & 1>", "0.25", "0"], ["2", "<x & 2>", "0.5", "0"], ["3", "<x & 3>", "0.75", "1"], ["4", "<x & 4>", "1.0", "1"]]
    whole = T.union_runs({"r1": spark.range(2), "r0": spark.range(1)})
    assert whole.columns[0] == "run" and whole.count() == 3


def test_tables(spark):
    for name in ("occasio_case_t1", "occasio_other_t1"):
        T.create_table(spark.range(10).withColumn("w", F.col("id") % 3), name, bucket_by="w", buckets=2)
    assert spark.table("occasio_case_t1").count() == 10
    assert T.drop_tag(spark, "t1", ["occasio_case", "none"]) == ["occasio_case_t1"] and spark.table("occasio_other_t1").count() == 10
    assert T.drop_tag(spark, "t1", ["occasio_other"]) == ["occasio_other_t1"]


def test_work_queue(spark, tmp_path):
    a, b = T.WorkQueue(spark, f"{tmp_path}/q"), T.WorkQueue(spark, f"{tmp_path}/q")
    assert [a.claim(range(3)), b.claim(range(3)), a.claim(range(3)), b.claim(range(3))] == [0, 1, 2, None]
    assert b.complete(1) and not a.complete(1) and a.completed() == [1]
    late = time.time() + 7200
    assert a.claim(range(3), now=late) == 0  # the old claim is stale; the new one is not
    assert b.claim(range(3)) is None and not b._create("chunk-0.claim-2")


def test_seed_log_and_compare(spark):
    from occasio.plans.compare import compare
    from occasio.session import session

    log = spark.createDataFrame([("r1", 2.0)], "run string, excess double")
    old = spark.createDataFrame([("r0", "before"), ("r1", "before")], "run string, note string")
    assert sorted((r["run"], r["excess"], r["note"]) for r in T.seed_log(log, old).collect()) == [("r0", None, "before"), ("r1", 2.0, None)]
    assert compare("sum", lambda: spark.range(9).agg(F.sum("id").alias("s")), lambda: spark.range(9).select(F.lit(36).cast("long").alias("s")).limit(1)).rows == 1
    with pytest.raises(ValueError):
        compare("rows", lambda: spark.range(9), lambda: spark.range(8))
    assert session() is spark or session().sparkContext is spark.sparkContext


def test_windowed_counts_of_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value")
    events.repartition(2).write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    q = scoring.event_counts(stream).writeStream.outputMode("complete").format("memory").queryName("weekly").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["d"], r["event_type"]): r["n"] for r in spark.sql("select date(window.start) d, event_type, n from weekly").collect()}
    want = {(r["d"], r["event_type"]): r["count"] for r in events.groupBy(F.to_date("ts").alias("d"), "event_type").count().collect()}
    assert got == want
