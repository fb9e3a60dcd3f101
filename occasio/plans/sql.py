"""DuckDB twins of the queries in ``registry``; the driver's tables are views there. Floats are rounded to 6 digits."""

from __future__ import annotations

CTES: dict[str, tuple[str, ...]] = {}  # name: (body, names it needs ...)


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (body, *needs)


def with_(needs: list[str] | str, select: str) -> str:
    """``select`` after the common table expressions it needs, and those that they need."""
    done: list[str] = []

    def add(name: str) -> None:
        for x in CTES[name][1:]:
            add(x)
        if name not in done:
            done.append(name)

    for name in needs.split() if isinstance(needs, str) else needs:
        add(name)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n][0]})" for n in done) + "\n" + select if done else select


cte("raw_txn", """
  SELECT o_custkey AS household_number, l_partkey AS tpnb, CAST(isoyear(o_orderdate) AS BIGINT) AS year_number,
         CAST((week(o_orderdate) - 1) // 4 + 1 AS BIGINT) AS period_number, CAST(week(o_orderdate) AS BIGINT) AS week_number,
         SUM(l_quantity) AS quantity, COUNT(DISTINCT l_orderkey) AS orders,
         ROUND(SUM(l_extendedprice * (1 - l_discount)), 4) AS sales
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4, 5""")  # fmt: skip
cte("items", "SELECT household_number, year_number * 100 + week_number AS yw, CAST(tpnb AS VARCHAR) AS tpnb, quantity FROM raw_txn", "raw_txn")
cte("baskets", """
  SELECT household_number, yw, household_number || '_' || yw AS basket_id, COUNT(*) AS n_products,
         CAST(CASE WHEN COUNT(*) <= 1 THEN 0 WHEN COUNT(*) <= 5 THEN 1 WHEN COUNT(*) <= 15 THEN 2 WHEN COUNT(*) <= 50 THEN 3 ELSE 4 END AS BIGINT) AS size_bucket
  FROM items GROUP BY 1, 2 HAVING COUNT(*) >= 2""", "items")  # fmt: skip
cte("rows_", "SELECT b.household_number, b.yw, b.basket_id, i.tpnb, i.quantity FROM baskets b JOIN items i USING (household_number, yw)", "baskets")
cte("seq", "SELECT *, ROW_NUMBER() OVER (ORDER BY household_number, yw) AS basket_seq FROM baskets", "baskets")
cte("plan_", """
  SELECT CAST(c AS BIGINT) AS chunk_id, CAST(c * 1000 + 1 AS BIGINT) AS seq_lo, CAST(LEAST((c + 1) * 1000, n) AS BIGINT) AS seq_hi
  FROM (SELECT MAX(basket_seq) AS n FROM seq), UNNEST(range(0, (n - 1) // 1000 + 1)) AS t(c)""", "seq")  # fmt: skip
cte("products", """
  SELECT p_name AS tpna, p_partkey AS tpnb, CASE WHEN p_size % 3 = 0 THEN p_name || ' ' || p_size END AS tpna_description,
         p_name || ' ' || lower(p_type) AS description, p_brand AS brand, p_type AS department, 'C' || (p_size % 7) AS class,
         'S' || (p_size % 5) AS subclass, p_partkey % 100 AS loaded, p_size = 50 AS is_deleted
  FROM part""")  # fmt: skip
cte("live", "SELECT * FROM products WHERE NOT is_deleted", "products")
cte("scoped", "SELECT * FROM live WHERE tpna IN (SELECT tpna FROM live WHERE tpnb IN (SELECT l_partkey FROM lineitem))", "live")
cte("lookup", """
  SELECT a.tpna, COALESCE(d.own, a.description) AS description, a.brand, a.department, a.class, a.subclass
  FROM (SELECT tpna, description, brand, department, class, subclass,
               ROW_NUMBER() OVER (PARTITION BY tpna ORDER BY COUNT(*) DESC, description, brand, department, class, subclass) AS rn
        FROM scoped GROUP BY 1, 2, 3, 4, 5, 6) a
  LEFT JOIN (SELECT tpna, tpna_description AS own, ROW_NUMBER() OVER (PARTITION BY tpna ORDER BY loaded DESC, tpna_description DESC) AS rn
             FROM scoped WHERE tpna_description IS NOT NULL) d ON d.tpna = a.tpna AND d.rn = 1
  WHERE a.rn = 1""", "scoped")  # fmt: skip
cte("mapping", "SELECT DISTINCT CAST(tpnb AS VARCHAR) AS tpnb, tpna FROM products", "products")
cte("plookup", "SELECT m.tpnb, MAX(l.description) AS description, MAX(l.department) AS department FROM mapping m LEFT JOIN lookup l USING (tpna) GROUP BY 1", "mapping", "lookup")
cte("labels_", """
  SELECT basket_id, CAST(CASE WHEN household_number % 10 = 0 THEN -1 ELSE no END AS BIGINT) AS label
  FROM (SELECT r.basket_id, r.household_number, p.p_type, ROW_NUMBER() OVER (PARTITION BY r.basket_id ORDER BY COUNT(*) DESC, p.p_type) AS rn
        FROM rows_ r JOIN part p ON CAST(p.p_partkey AS VARCHAR) = r.tpnb GROUP BY 1, 2, 3)
  JOIN (SELECT p_type, DENSE_RANK() OVER (ORDER BY p_type) - 1 AS no FROM (SELECT DISTINCT p_type FROM part)) USING (p_type)
  WHERE rn = 1""", "rows_")  # fmt: skip
cte("elabels", """
  SELECT user_id AS household_number, slot AS yw, user_id || '_' || slot AS basket_id, CAST(no AS BIGINT) AS need_state
  FROM (SELECT user_id, 202400 + day(ts) AS slot, event_type, ROW_NUMBER() OVER (PARTITION BY user_id, 202400 + day(ts) ORDER BY COUNT(*) DESC, event_type) AS rn
        FROM events GROUP BY 1, 2, 3)
  JOIN (SELECT event_type, DENSE_RANK() OVER (ORDER BY event_type) - 1 AS no FROM (SELECT DISTINCT event_type FROM events)) USING (event_type)
  WHERE rn = 1""")  # fmt: skip
cte("vec", "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, CAST(label AS BIGINT) AS label FROM embeddings")
cte("nvec", "SELECT id, e, label, sqrt(list_dot_product(e, e)) AS norm FROM vec", "vec")
cte("sims", """
  SELECT a.id, b.id AS neighbour, list_dot_product(a.e, b.e) / (a.norm * b.norm) AS similarity, a.label AS la, b.label AS lb
  FROM nvec a JOIN nvec b ON a.id <> b.id""", "nvec")  # fmt: skip
cte("knn10", "SELECT * FROM (SELECT id, neighbour, similarity, ROW_NUMBER() OVER (PARTITION BY id ORDER BY similarity DESC, neighbour) AS rank FROM sims) WHERE rank <= 10", "sims")
cte("knn", "SELECT * FROM knn10 WHERE rank <= 5", "knn10")
cte("pairs_mutual", """
  SELECT LEAST(id, neighbour) AS basket_a, GREATEST(id, neighbour) AS basket_b, AVG(similarity) AS similarity
  FROM knn GROUP BY 1, 2 HAVING COUNT(*) = 2 AND AVG(similarity) > 0""", "knn")  # fmt: skip
cte("pairs_one", "SELECT LEAST(id, neighbour) AS basket_a, GREATEST(id, neighbour) AS basket_b, MAX(similarity) AS similarity FROM knn WHERE similarity > 0 GROUP BY 1, 2", "knn")
for _kind in ("mutual", "one"):
    cte(f"edges_{_kind}", f"""
  SELECT basket_a, basket_b, similarity,
         CASE WHEN MAX(similarity) OVER () > MIN(similarity) OVER () THEN (similarity - MIN(similarity) OVER ()) / (MAX(similarity) OVER () - MIN(similarity) OVER ()) ELSE 0.0 END AS weight
  FROM pairs_{_kind}""", f"pairs_{_kind}")  # fmt: skip
cte("cells", "SELECT id, label, UNNEST(e) AS x, generate_subscripts(e, 1) AS d FROM vec", "vec")
cte("centers", "SELECT label, list(x ORDER BY d) AS c FROM (SELECT label, d, AVG(x) AS x FROM cells GROUP BY 1, 2) GROUP BY 1", "cells")
cte("dists", "SELECT v.id, v.label, c.label AS centroid, list_distance(v.e, c.c) AS distance FROM vec v, centers c", "vec", "centers")
cte("distinct_", """
  SELECT id, 1 - MAX(CASE WHEN centroid = label THEN distance END) / (MAX(distance) + 1e-8) AS distinctiveness FROM dists GROUP BY id""", "dists")  # fmt: skip
cte("cop", "SELECT a.tpnb AS a, b.tpnb AS b, COUNT(*) AS n FROM rows_ a JOIN rows_ b ON a.basket_id = b.basket_id AND a.tpnb < b.tpnb GROUP BY 1, 2", "rows_")
cte("bpairs", """
  SELECT a.basket_id, a.tpnb AS src, b.tpnb AS dst, c.n FROM rows_ a JOIN rows_ b ON a.basket_id = b.basket_id AND a.tpnb <> b.tpnb
  JOIN cop c ON c.a = LEAST(a.tpnb, b.tpnb) AND c.b = GREATEST(a.tpnb, b.tpnb)""", "cop")  # fmt: skip
cte("cp_raw", """
  SELECT r.basket_id, r.tpnb, z.m, CASE WHEN z.m > 1 THEN ln(1 + COALESCE(p.s, 0) / (z.m - 1.0)) ELSE 0.0 END AS v
  FROM rows_ r JOIN (SELECT basket_id, COUNT(*) AS m FROM rows_ GROUP BY 1) z USING (basket_id)
  LEFT JOIN (SELECT basket_id, src AS tpnb, SUM(n) AS s FROM bpairs GROUP BY 1, 2) p USING (basket_id, tpnb)""", "bpairs")  # fmt: skip
cte("cp_", """
  SELECT basket_id, tpnb, CASE WHEN m <= 1 THEN 0.0 WHEN hi > lo THEN (v - lo) / (hi - lo) WHEN hi > 0 THEN 1.0 ELSE 0.0 END AS cp_score
  FROM (SELECT *, MIN(v) OVER (PARTITION BY basket_id) AS lo, MAX(v) OVER (PARTITION BY basket_id) AS hi FROM cp_raw)""", "cp_raw")  # fmt: skip
cte("vlabels", "SELECT id AS basket_id, CAST(CASE WHEN id % 11 = 0 THEN -1 ELSE label END AS BIGINT) AS label FROM vec", "vec")
cte("npairs", """
  SELECT LEAST(a.label, b.label) AS need_state_a, GREATEST(a.label, b.label) AS need_state_b, COUNT(*) AS n_edges, SUM(e.weight) AS weight_sum
  FROM edges_one e JOIN vlabels a ON a.basket_id = e.basket_a JOIN vlabels b ON b.basket_id = e.basket_b
  WHERE a.label <> -1 AND b.label <> -1 GROUP BY 1, 2""", "edges_one", "vlabels")  # fmt: skip
cte("ndeg", "SELECT s, SUM(w) AS d FROM (SELECT need_state_a AS s, weight_sum AS w FROM npairs UNION ALL SELECT need_state_b, weight_sum FROM npairs) GROUP BY 1", "npairs")
cte("adj", """
  SELECT p.need_state_a, p.need_state_b, p.n_edges, p.weight_sum,
         p.weight_sum / GREATEST(a.d * b.d / GREATEST(2 * (SELECT SUM(weight_sum) FROM npairs), 1e-12), 1e-12) AS lift,
         p.weight_sum / GREATEST(a.d, 1e-12) AS share_a, p.weight_sum / GREATEST(b.d, 1e-12) AS share_b
  FROM npairs p JOIN ndeg a ON a.s = p.need_state_a JOIN ndeg b ON b.s = p.need_state_b WHERE p.need_state_a <> p.need_state_b""", "ndeg")  # fmt: skip
cte("steps_", """
  SELECT household_number, need_state AS f, LEAD(need_state) OVER w AS t, LEAD(r) OVER w - r AS gap
  FROM (SELECT *, DENSE_RANK() OVER (ORDER BY yw) - 1 AS r FROM elabels)
  WINDOW w AS (PARTITION BY household_number ORDER BY r, basket_id)""", "elabels")  # fmt: skip
for _name, _where in (("trans1", "AND gap <= 1"), ("transn", "")):
    cte(_name, f"""
  SELECT f AS from_need_state, t AS to_need_state, n AS n_transitions, p AS prob, p / GREATEST(tt / GREATEST(al, 1e-12), 1e-12) AS lift, avg_week_gap, n < 30 AS low_support
  FROM (SELECT f, t, n, avg_week_gap, CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY f) AS p, CAST(SUM(n) OVER (PARTITION BY t) AS DOUBLE) AS tt, CAST(SUM(n) OVER () AS DOUBLE) AS al
        FROM (SELECT f, t, COUNT(*) AS n, AVG(gap) AS avg_week_gap FROM steps_ WHERE t IS NOT NULL {_where} GROUP BY 1, 2))""", "steps_")  # fmt: skip
cte("plist", "SELECT CAST(p_partkey AS VARCHAR) AS tpnb, p_name AS description, p_type AS department FROM part")


def _profile_ctes(tag: str, labels: str) -> None:
    cte(f"counts{tag}", f"SELECT l.label AS need_state, r.tpnb, COUNT(*) AS n_baskets FROM rows_ r JOIN {labels} l USING (basket_id) WHERE l.label <> -1 GROUP BY 1, 2", "rows_", labels)
    cte(f"base{tag}", f"SELECT tpnb, CAST(SUM(n_baskets) AS BIGINT) AS n_baskets FROM counts{tag} GROUP BY 1", f"counts{tag}")
    cte(f"prof{tag}", f"""
  SELECT * FROM (
    SELECT s.*, p.description, p.department, ROW_NUMBER() OVER (PARTITION BY s.need_state ORDER BY s.lift DESC, s.tpnb) AS rank_by_lift
    FROM (SELECT c.need_state, c.tpnb, c.n_baskets AS n_baskets_in_need_state, b.n_baskets AS n_baskets_overall,
                 (CAST(c.n_baskets AS DOUBLE) / t.n) / (CAST(b.n_baskets AS DOUBLE) / (SELECT SUM(n_baskets) FROM base{tag})) AS lift,
                 CAST(c.n_baskets AS DOUBLE) / t.n AS share_within_need_state
          FROM counts{tag} c JOIN (SELECT need_state, SUM(n_baskets) AS n FROM counts{tag} GROUP BY 1) t USING (need_state) JOIN base{tag} b USING (tpnb)
          WHERE c.n_baskets >= 5) s LEFT JOIN plist p USING (tpnb)) WHERE rank_by_lift <= 10""", f"base{tag}", "plist")  # fmt: skip
    cte(f"summ{tag}", f"""
  SELECT l.label AS need_state, COUNT(*) AS n_baskets, COUNT(DISTINCT b.household_number) AS n_households, AVG(b.n_products) AS avg_products_per_basket
  FROM baskets b JOIN {labels} l USING (basket_id) WHERE l.label <> -1 GROUP BY 1""", "baskets", labels)  # fmt: skip
    cte(f"terms{tag}", f"""
  SELECT need_state, COALESCE(string_agg(CASE WHEN trim(description) <> '' THEN trim(description) END, ' / ' ORDER BY rank_by_lift), '(no description available)') AS label
  FROM prof{tag} WHERE rank_by_lift <= 3 GROUP BY 1""", f"prof{tag}")  # fmt: skip
    cte(f"enr{tag}", f"""
  SELECT s.need_state, s.n_baskets, s.n_households, s.avg_products_per_basket, t.max_lift, t.avg_lift, t.median_lift, t.top_share, t.n_departments_top_n,
         COALESCE(t.n_products_profiled, 0) AS n_products_profiled, x.label, CAST(s.n_baskets AS DOUBLE) / SUM(s.n_baskets) OVER () AS share_of_baskets,
         CASE WHEN t.top_share IS NOT NULL THEN LEAST(1.0, t.top_share * s.avg_products_per_basket) END AS top_product_coverage,
         CASE WHEN s.avg_products_per_basket <= 2 THEN '<=2' WHEN s.avg_products_per_basket <= 5 THEN '2-5' WHEN s.avg_products_per_basket <= 10 THEN '5-10'
              WHEN s.avg_products_per_basket <= 20 THEN '10-20' WHEN s.avg_products_per_basket <= 50 THEN '20-50' ELSE '>50' END AS size_band
  FROM summ{tag} s
  LEFT JOIN (SELECT need_state, MAX(lift) AS max_lift, AVG(lift) AS avg_lift, MEDIAN(lift) AS median_lift,
                    MAX(CASE WHEN rank_by_lift = 1 THEN share_within_need_state END) AS top_share, COUNT(DISTINCT department) AS n_departments_top_n, COUNT(*) AS n_products_profiled
             FROM prof{tag} GROUP BY 1) t USING (need_state)
  LEFT JOIN terms{tag} x USING (need_state)""", f"summ{tag}", f"terms{tag}")  # fmt: skip
    cte(f"twin{tag}", f"""
  SELECT f.need_state, COALESCE(MAX(CASE WHEN o.need_state IS NOT NULL THEN o.i / (f.k + o.k - o.i) END), 0.0) AS best
  FROM fullsize{tag} f
  LEFT JOIN (SELECT a.need_state AS a, b.need_state, fb.k, COUNT(*) * 1.0::DOUBLE AS i FROM prof{tag} a JOIN fullsize{tag} fa ON fa.need_state = a.need_state
             JOIN prof{tag} b ON a.tpnb = b.tpnb AND a.need_state <> b.need_state JOIN fullsize{tag} fb ON fb.need_state = b.need_state GROUP BY 1, 2, 3) o ON o.a = f.need_state
  WHERE (SELECT COUNT(*) FROM fullsize{tag}) > 1 GROUP BY 1""", f"fullsize{tag}")  # fmt: skip
    cte(f"fullsize{tag}", f"SELECT need_state, k FROM (SELECT need_state, COUNT(*) AS k, MAX(COUNT(*)) OVER () AS most FROM prof{tag} GROUP BY 1) WHERE k >= most", f"prof{tag}")


_profile_ctes("", "labels_")
cte("null_", """
  SELECT a.basket_id, b.label
  FROM (SELECT basket_id, ROW_NUMBER() OVER (ORDER BY CAST(split_part(basket_id, '_', 1) AS BIGINT), basket_id) AS p, COUNT(*) OVER () AS n FROM labels_ WHERE label <> -1) a
  JOIN (SELECT label, ROW_NUMBER() OVER (ORDER BY CAST(split_part(basket_id, '_', 1) AS BIGINT), basket_id) AS q FROM labels_ WHERE label <> -1) b
    ON a.p = (b.q - 1 + a.n // 2) % a.n + 1
  UNION ALL SELECT basket_id, label FROM labels_ WHERE label = -1""", "labels_")  # fmt: skip
_profile_ctes("_null", "null_")


def _score(tag: str, labels: str, run: str) -> str:
    return f"""
SELECT '{run}' AS run, (SELECT COUNT(*) FROM {labels} WHERE label <> -1) AS n_baskets_labelled, (SELECT COUNT(*) FROM {labels} WHERE label = -1) AS n_unclustered,
       z.n_communities, z.largest_share, z.median_community_size, l.n_profiled, 'clustered' AS lift_basis, l.median_max_lift, l.pct_lift_over_3, l.n_lift_over_5, l.n_lift_over_10,
       t.median_twin_jaccard, t.n_twin_over_0p7, h.pct_thin_profiles
FROM (SELECT COUNT(*) AS n_communities, ROUND(CAST(MAX(n) AS DOUBLE) / SUM(n), 6) AS largest_share, CAST(floor(MEDIAN(n)) AS BIGINT) AS median_community_size
      FROM (SELECT label, COUNT(*) AS n FROM {labels} WHERE label <> -1 GROUP BY 1)) z,
     (SELECT COUNT(*) AS n_profiled, ROUND(MEDIAN(m), 6) AS median_max_lift, ROUND(AVG(CASE WHEN m > 3 THEN 1.0 ELSE 0.0 END), 6) AS pct_lift_over_3,
             COUNT(CASE WHEN m > 5 THEN 1 END) AS n_lift_over_5, COUNT(CASE WHEN m > 10 THEN 1 END) AS n_lift_over_10
      FROM (SELECT need_state, MAX(lift) AS m FROM prof{tag} GROUP BY 1)) l,
     (SELECT ROUND(MEDIAN(best), 6) AS median_twin_jaccard, COUNT(CASE WHEN best >= 0.7 THEN 1 END) AS n_twin_over_0p7 FROM twin{tag}) t,
     (SELECT ROUND(AVG(CASE WHEN n_products_profiled < (SELECT MAX(k) FROM fullsize{tag}) THEN 1.0 ELSE 0.0 END), 6) AS pct_thin_profiles FROM enr{tag}) h"""


def _band(column: str, bands: list[tuple[str, str]], where: str = "TRUE") -> str:
    case = " ".join(f"WHEN {c} THEN '{n}'" for c, n in bands)
    every = ", ".join(f"('{n}')" for _, n in bands)
    return f"""
SELECT e.band, COALESCE(g.n_ns, 0) AS n_ns, g.n_baskets, ROUND(CAST(g.n_baskets AS DOUBLE) / (SELECT SUM(n_baskets) FROM enr), 6) AS pct_of_population,
       ROUND(g.med_lift, 6) AS med_lift, ROUND(g.pct_over_3, 6) AS pct_over_3, ROUND(g.med_size, 6) AS med_size, ROUND(g.med_coverage, 6) AS med_coverage
FROM (VALUES {every}) e(band)
LEFT JOIN (SELECT CASE WHEN {column} IS NULL THEN NULL {case} END AS band, COUNT(*) AS n_ns, CAST(SUM(n_baskets) AS BIGINT) AS n_baskets, MEDIAN(max_lift) AS med_lift,
                  AVG(CASE WHEN max_lift > 3 THEN 1.0 ELSE 0.0 END) AS pct_over_3, MEDIAN(avg_products_per_basket) AS med_size, MEDIAN(top_product_coverage) AS med_coverage
           FROM enr WHERE {where} GROUP BY 1) g ON g.band = e.band"""


def _steps(column: str, edges: list[tuple[float, str]], last: str) -> list[tuple[str, str]]:
    return [(f"{column} <= {t}", n) for t, n in edges] + [("TRUE", last)]


def _transitions(name: str, extra: str = "") -> str:
    return f"SELECT from_need_state, to_need_state, n_transitions, ROUND(prob, 6) AS prob, ROUND(lift, 6) AS lift, ROUND(avg_week_gap, 6) AS avg_week_gap, low_support FROM {name} {extra}"


def _journey(state: str, depth: int) -> None:
    """Beam search, written out: level i keeps the five best paths of i steps."""
    cte("j0", f"SELECT [CAST({state} AS BIGINT)] AS path, 1.0::DOUBLE AS path_prob, 1.0::DOUBLE AS weakest_step, 0::BIGINT AS low_n", "trans1")
    for i in range(1, depth + 1):
        cte(f"j{i}", f"""
  SELECT list_append(j.path, t.to_need_state) AS path, j.path_prob * t.prob AS path_prob, LEAST(j.weakest_step, t.prob) AS weakest_step, j.low_n + CAST(t.low_support AS BIGINT) AS low_n
  FROM j{i - 1} j JOIN trans1 t ON t.from_need_state = j.path[-1] AND t.to_need_state <> j.path[-1]
  ORDER BY path_prob DESC, path LIMIT 5""", f"j{i - 1}")  # fmt: skip


_journey("0", 3)
_PATH = "array_to_string(path, '>') AS path, ROUND(path_prob, 6) AS path_prob, ROUND(weakest_step, 6) AS weakest_step, low_n AS low_support_steps, CAST(len(path) - 1 AS BIGINT) AS n_steps"
cte("last_", "SELECT * FROM elabels WHERE household_number = 7 ORDER BY yw DESC LIMIT 1", "elabels")
for _i in range(4):
    _body, *_needs = CTES[f"j{_i}"]
    cte(f"h{_i}", _body.replace("CAST(0 AS BIGINT)", "(SELECT need_state FROM last_)").replace("FROM j", "FROM h"), "trans1", "last_", *([f"h{_i - 1}"] if _i else []))

_LOG = """SELECT 'run' || c_custkey AS run, CASE WHEN c_custkey % 4 <> 0 THEN ROUND(c_acctbal / 10000, 6) END AS excess,
       CASE c_custkey % 3 WHEN 0 THEN 'clustered' WHEN 1 THEN 'population' END AS lift_basis FROM customer"""
cte("log_", _LOG)
cte("reach", """
  SELECT id, id AS r FROM (SELECT basket_a AS id FROM edges_mutual UNION SELECT basket_b FROM edges_mutual)
  UNION
  SELECT reach.id, CASE WHEN e.basket_a = reach.r THEN e.basket_b ELSE e.basket_a END
  FROM reach JOIN edges_mutual e ON e.basket_a = reach.r OR e.basket_b = reach.r""", "edges_mutual")  # fmt: skip
cte("comp", "SELECT id, MIN(r) AS component FROM reach GROUP BY 1", "reach")
cte("style", "SELECT s.tpna, v.e FROM (SELECT tpna, MIN(tpnb) AS id FROM products GROUP BY 1) s JOIN vec v USING (id)", "products", "vec")
cte("items_vec", "SELECT m.tpnb, s.e FROM (SELECT tpnb, MIN(tpna) AS tpna FROM mapping GROUP BY 1) m JOIN style s USING (tpna)", "mapping", "style")
cte("pvec", "SELECT CAST(p_partkey AS VARCHAR) AS tpnb, v.e FROM part JOIN vec v ON v.id = p_partkey % (SELECT COUNT(*) FROM vec)", "vec")
cte("post", "SELECT id, centroid, exp(-distance) / SUM(exp(-distance)) OVER (PARTITION BY id) AS p FROM dists", "dists")
cte("ctrain", "SELECT l.label AS need_state, r.tpnb, COUNT(*) AS n FROM rows_ r JOIN labels_ l USING (basket_id) WHERE l.label <> -1 AND household_number % 4 <> 1 GROUP BY 1, 2", "rows_", "labels_")
cte("ctest", "SELECT l.label AS need_state, r.tpnb, COUNT(*) AS n FROM rows_ r JOIN labels_ l USING (basket_id) WHERE l.label <> -1 AND household_number % 4 = 1 GROUP BY 1, 2", "rows_", "labels_")

ORACLE_SQL: dict[str, str] = {
    "txn_weekly_agg": with_("raw_txn", "SELECT household_number, tpnb, year_number, period_number, week_number, ROUND(quantity, 6) AS quantity, orders, ROUND(sales, 6) AS sales FROM raw_txn"),
    "txn_validation_stats": with_("raw_txn", """SELECT COUNT(*) AS n_rows, COUNT(DISTINCT household_number) AS n_households, COUNT(DISTINCT tpnb) AS n_products,
       COUNT(DISTINCT year_number * 100 + week_number) AS n_weeks, MIN(year_number * 100 + week_number) AS first_week, MAX(year_number * 100 + week_number) AS last_week,
       CAST(SUM(CASE WHEN quantity <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_returns, CAST(SUM(CASE WHEN household_number IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null_households FROM raw_txn"""),
    "period_filter": with_("raw_txn", "SELECT year_number, period_number, COUNT(*) AS n_rows, ROUND(SUM(quantity), 6) AS quantity FROM raw_txn WHERE year_number * 100 + period_number BETWEEN 199703 AND 199902 GROUP BY 1, 2"),
    "basket_build": with_("baskets rows_", """SELECT b.household_number, b.yw AS year_week_number, b.basket_id, string_agg(r.tpnb, ',' ORDER BY r.tpnb) AS products,
       string_agg(CAST(CAST(r.quantity AS BIGINT) AS VARCHAR), ',' ORDER BY r.tpnb) AS units, b.n_products, b.size_bucket FROM baskets b JOIN rows_ r USING (basket_id) GROUP BY ALL"""),
    "basket_size_bucket": with_("baskets", "SELECT size_bucket, COUNT(*) AS n_baskets, MIN(n_products) AS smallest, MAX(n_products) AS largest FROM baskets GROUP BY 1"),
    "basket_seq": with_("seq", "SELECT basket_seq, basket_id FROM seq"),
    "basket_count": with_("baskets", "SELECT COUNT(*) AS n_baskets FROM baskets"),
    "basket_range_read": with_("seq", "SELECT basket_seq, basket_id FROM seq WHERE basket_seq BETWEEN 101 AND 350 ORDER BY 1"),
    "chunk_assign": with_("seq", "SELECT CAST((basket_seq - 1) // 1000 AS BIGINT) AS chunk_id, COUNT(*) AS n, MIN(basket_seq) AS seq_lo, MAX(basket_seq) AS seq_hi FROM seq GROUP BY 1"),
    "chunk_plan": with_("plan_", "SELECT chunk_id, seq_lo, seq_hi FROM plan_"),
    "chunk_claimable": with_("plan_", "SELECT chunk_id, seq_lo, seq_hi, CASE WHEN chunk_id % 3 = 1 THEN 'running' ELSE 'pending' END AS status FROM plan_ WHERE chunk_id % 3 = 2 OR (chunk_id % 3 = 1 AND chunk_id * 900 > 3600) ORDER BY 1"),
    "chunk_remaining": with_("plan_", "SELECT chunk_id, seq_lo, seq_hi FROM plan_ WHERE chunk_id % 3 <> 0"),
    "exclude_existing": with_("baskets", "SELECT basket_id, yw AS year_week_number FROM baskets WHERE yw >= 199900"),
    "merge_keep_last": with_("baskets", "SELECT basket_id, n_products AS value FROM baskets WHERE yw < 199800 UNION ALL SELECT basket_id, n_products + 1000 FROM baskets WHERE yw >= 199800"),
    "duplicate_refusal": with_("baskets", "SELECT COUNT(*) AS n FROM baskets"),
    "keep_first_mapping": with_("products", "SELECT tpna, tpnb, brand FROM products QUALIFY ROW_NUMBER() OVER (PARTITION BY tpna ORDER BY tpnb) = 1"),
    "stratified_quota": with_("baskets", "SELECT size_bucket, COUNT(*) AS n_baskets, LEAST(COUNT(*), GREATEST(1, CAST(round_even(1000 * CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER (), 0) AS BIGINT))) AS quota FROM baskets GROUP BY 1"),
    "size_band_baskets": with_("baskets", "SELECT basket_id, n_products FROM baskets WHERE n_products BETWEEN 3 AND 8"),
    "product_dictionary": with_("rows_", "SELECT ROW_NUMBER() OVER (ORDER BY n) - 1 AS product_index, CAST(n AS VARCHAR) AS tpnb FROM (SELECT DISTINCT CAST(tpnb AS BIGINT) AS n FROM rows_)"),
    "product_units_avg": with_("raw_txn", "SELECT CAST(tpnb AS VARCHAR) AS tpnb, ROUND(AVG(quantity), 6) AS avg_quantity FROM raw_txn GROUP BY 1"),
    "item_lookup": with_("lookup", "SELECT tpna, description, brand, department, class, subclass FROM lookup"),
    "key_mapping": with_("mapping", "SELECT tpnb, tpna FROM mapping"),
    "category_mapping": with_("products", "SELECT DISTINCT CAST(tpnb AS VARCHAR) AS tpnb, department AS theme_name FROM products"),
    "item_text": with_("lookup", "SELECT tpna, concat_ws(' | ', description, department, class, subclass) AS item_text FROM lookup"),
    "style_broadcast": with_("items_vec", "SELECT tpnb, ROUND(e[1], 6) AS e0, ROUND(e[64], 6) AS e63 FROM items_vec"),
    "key_overlap": with_("rows_ items_vec", "SELECT COUNT(*) AS n_products, COUNT(v.tpnb) AS n_matched, ROUND(CAST(COUNT(v.tpnb) AS DOUBLE) / COUNT(*), 6) AS share FROM (SELECT DISTINCT tpnb FROM rows_) p LEFT JOIN items_vec v USING (tpnb)"),
    "audit_fanout": with_("mapping", "SELECT n_tpna, COUNT(*) AS n_tpnb FROM (SELECT tpnb, COUNT(DISTINCT tpna) AS n_tpna FROM mapping GROUP BY 1) GROUP BY 1"),
    "audit_top_products": with_("rows_ plookup", """SELECT t.tpnb, t.n_baskets, ROUND(100 * CAST(t.n_baskets AS DOUBLE) / (SELECT COUNT(*) FROM baskets), 6) AS pct_of_baskets, p.description, p.department
       FROM (SELECT tpnb, COUNT(*) AS n_baskets FROM rows_ GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) t LEFT JOIN plookup p USING (tpnb)"""),
    "audit_coverage": with_("rows_ mapping lookup", """SELECT COUNT(*) AS purchased_tpnb, COUNT(l.description) AS with_description, COUNT(l.department) AS with_department, COUNT(DISTINCT p.tpnb) AS distinct_tpnb
       FROM (SELECT DISTINCT tpnb FROM rows_) p LEFT JOIN mapping m USING (tpnb) LEFT JOIN lookup l ON l.tpna = m.tpna"""),
    "product_lookup": with_("plookup", "SELECT tpnb, description, department FROM plookup"),
    "vector_load": with_("vec", "SELECT CAST(id AS VARCHAR) AS tpnb, len(e) AS width, ROUND(e[1], 6) AS e0 FROM vec"),
    "centroid_distances": with_("dists", "SELECT id, centroid, ROUND(distance, 6) AS distance FROM dists"),
    "distinctiveness": with_("distinct_", "SELECT id, ROUND(distinctiveness, 6) AS distinctiveness FROM distinct_"),
    "copurchase": with_("cop", "SELECT a, b, n FROM cop"),
    "copurchase_diagonal": with_("rows_", "SELECT tpnb AS a, tpnb AS b, COUNT(*) AS n FROM rows_ GROUP BY 1"),
    "basket_nodes": with_("rows_", "SELECT basket_id, tpnb, ROUND(SUM(quantity), 6) AS units FROM rows_ GROUP BY 1, 2"),
    "cp_score": with_("cp_", "SELECT basket_id, tpnb, ROUND(cp_score, 6) AS cp_score FROM cp_"),
    "basket_edges_topk": with_("bpairs", """SELECT basket_id, src, dst, ROUND(ln(1 + CAST(n AS DOUBLE)), 6) AS log_cp, ROUND(CAST(n AS DOUBLE) / most, 6) AS rel
       FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY basket_id, src ORDER BY n DESC, dst) AS rn, MAX(n) OVER (PARTITION BY basket_id, src) AS most FROM bpairs) WHERE rn <= 3"""),
    "node_scalars": with_("cp_ distinct_ rows_", """SELECT r.basket_id, r.tpnb, ROUND(c.cp_score, 6) AS cp_score, ROUND(COALESCE(d.distinctiveness, 0.5), 6) AS distinctiveness, ROUND(ln(1 + r.quantity), 6) AS log_units
       FROM rows_ r JOIN cp_ c USING (basket_id, tpnb)
       LEFT JOIN (SELECT CAST(p_partkey AS VARCHAR) AS tpnb, x.distinctiveness FROM part JOIN distinct_ x ON x.id = p_partkey % (SELECT COUNT(*) FROM vec) WHERE p_partkey % 10 <> 3) d USING (tpnb)"""),
    "graph_pack": with_("rows_ bpairs", """SELECT r.basket_id, r.n AS n_nodes, COALESCE(e.n, 0) AS n_edges, r.n * 67 AS n_values FROM (SELECT basket_id, COUNT(*) AS n FROM rows_ GROUP BY 1) r
       LEFT JOIN (SELECT basket_id, COUNT(*) AS n FROM (SELECT basket_id, ROW_NUMBER() OVER (PARTITION BY basket_id, src ORDER BY n DESC, dst) AS rn FROM bpairs) WHERE rn <= 10 GROUP BY 1) e USING (basket_id)"""),
    "l2_normalize": with_("nvec", "SELECT id, ROUND(e[1] / norm, 6) AS u0, ROUND(e[64] / norm, 6) AS u63, 1.0::DOUBLE AS norm FROM nvec"),
    "mean_embedding": with_("baskets rows_ pvec", """SELECT b.basket_id, COUNT(v.tpnb) AS n_used, ROUND(COALESCE(AVG(v.e[1]), 0.0), 6) AS v0, ROUND(COALESCE(AVG(v.e[2]), 0.0), 6) AS v1, ROUND(COALESCE(AVG(v.e[64]), 0.0), 6) AS v63
       FROM baskets b JOIN rows_ r USING (basket_id) LEFT JOIN pvec v ON v.tpnb = r.tpnb GROUP BY 1"""),
    "knn_exact": with_("knn", "SELECT id, neighbour, ROUND(similarity, 6) AS similarity, rank FROM knn"),
    "knn_edges_mutual": with_("edges_mutual", "SELECT basket_a, basket_b, ROUND(similarity, 6) AS similarity, ROUND(weight, 6) AS weight FROM edges_mutual"),
    "knn_edges_onedir": with_("edges_one", "SELECT basket_a, basket_b, ROUND(similarity, 6) AS similarity, ROUND(weight, 6) AS weight FROM edges_one"),
    "graph_coverage": with_("edges_mutual vec", """SELECT COUNT(e.id) AS n_covered, COUNT(*) AS n_total, ROUND(CAST(COUNT(e.id) AS DOUBLE) / COUNT(*), 6) AS share
       FROM vec v LEFT JOIN (SELECT basket_a AS id FROM edges_mutual UNION SELECT basket_b FROM edges_mutual) e USING (id)"""),
    "coverage_probe": with_("knn10 vec", """SELECT k, (SELECT COUNT(DISTINCT x.id) FROM knn10 x JOIN knn10 y ON x.id = y.neighbour AND x.neighbour = y.id WHERE x.similarity > 0 AND y.similarity > 0 AND x.rank <= k AND y.rank <= k) AS n_covered,
       (SELECT COUNT(*) FROM vec) AS n_total, ROUND((SELECT COUNT(DISTINCT x.id) FROM knn10 x JOIN knn10 y ON x.id = y.neighbour AND x.neighbour = y.id WHERE x.similarity > 0 AND y.similarity > 0 AND x.rank <= k AND y.rank <= k) / CAST((SELECT COUNT(*) FROM vec) AS DOUBLE), 6) AS share
       FROM (VALUES (2::BIGINT), (5), (10)) t(k)"""),
    "vertex_index": with_("edges_mutual", "SELECT id, ROW_NUMBER() OVER (ORDER BY id) - 1 AS vertex FROM (SELECT basket_a AS id FROM edges_mutual UNION SELECT basket_b FROM edges_mutual)"),
    "assign_new_baskets": with_("sims", """SELECT id, lb AS need_state_cluster, ROUND(CAST(n AS DOUBLE) / total, 6) AS cluster_confidence
       FROM (SELECT id, lb, COUNT(*) AS n, SUM(COUNT(*)) OVER (PARTITION BY id) AS total, ROW_NUMBER() OVER (PARTITION BY id ORDER BY COUNT(*) DESC, lb) AS rn
             FROM (SELECT id, lb, ROW_NUMBER() OVER (PARTITION BY id ORDER BY similarity DESC, neighbour) AS k FROM sims WHERE id % 2 = 1 AND neighbour % 2 = 0) WHERE k <= 15 GROUP BY 1, 2) WHERE rn = 1"""),
    "embedding_health": with_("cells", """SELECT CAST(SUM(bad) AS BIGINT) AS n_non_finite, ROUND(AVG(s), 6) AS mean_std, CAST(SUM(CASE WHEN s < 1e-6 THEN 1 ELSE 0 END) AS BIGINT) AS n_dead_dims,
       ROUND((SELECT CAST(MAX(n) AS DOUBLE) / SUM(n) FROM (SELECT label, COUNT(*) AS n FROM vec WHERE id % 50 <> 7 GROUP BY 1)), 6) AS largest_share,
       (SELECT COUNT(*) FROM vec WHERE id % 50 = 7) AS n_unlabelled, FALSE AS collapsed
       FROM (SELECT d, SUM(CASE WHEN isnan(x) OR isinf(x) THEN 1 ELSE 0 END) AS bad, stddev_pop(x) AS s FROM cells GROUP BY 1)"""),
    "modularity": with_("edges_one vec", """SELECT ROUND(SUM(i / m - 1.5 * pow(d / (2 * m), 2)), 6) AS modularity
       FROM (SELECT label, SUM(inside) AS i, SUM(w) AS d, (SELECT SUM(weight) FROM edges_one) AS m
             FROM (SELECT a.label, CASE WHEN a.label = b.label THEN e.weight ELSE 0 END AS inside, e.weight AS w FROM edges_one e JOIN vec a ON a.id = e.basket_a JOIN vec b ON b.id = e.basket_b
                   UNION ALL SELECT b.label, 0, e.weight FROM edges_one e JOIN vec b ON b.id = e.basket_b) GROUP BY 1)"""),
    "connected_components": with_("comp", "SELECT id, component FROM comp"),
    "component_sizes": with_("comp", "SELECT n_vertices, COUNT(*) AS n_components FROM (SELECT component, COUNT(*) AS n_vertices FROM comp GROUP BY 1) GROUP BY 1"),
    "ari": with_("vec", """SELECT CAST(n AS BIGINT) AS n, ROUND((s - r * c / (n * (n - 1) / 2)) / ((r + c) / 2 - r * c / (n * (n - 1) / 2)), 6) AS ari FROM (
       SELECT (SELECT CAST(SUM(k) AS DOUBLE) FROM t) AS n, (SELECT SUM(k * (k - 1) / 2) FROM t) AS s, (SELECT SUM(k * (k - 1) / 2) FROM (SELECT SUM(k) AS k FROM t GROUP BY x)) AS r, (SELECT SUM(k * (k - 1) / 2) FROM (SELECT SUM(k) AS k FROM t GROUP BY y)) AS c)""").replace(
        "\nSELECT CAST(n AS BIGINT)", ",\nt AS (SELECT x, y, CAST(COUNT(*) AS DOUBLE) AS k FROM (SELECT label AS x, CASE WHEN id % 5 = 0 THEN id % 7 WHEN id % 31 = 0 THEN -1 ELSE label END AS y FROM vec) WHERE y <> -1 GROUP BY 1, 2)\nSELECT CAST(n AS BIGINT)", 1),
    "community_sizes": with_("labels_", "SELECT label, COUNT(*) AS n FROM labels_ WHERE label <> -1 GROUP BY 1"),
    "community_size_summary": with_("labels_", "SELECT COUNT(*) AS n_communities, ROUND(CAST(MAX(n) AS DOUBLE) / SUM(n), 6) AS largest_share, ROUND(MEDIAN(n), 6) AS median_size, CAST(MAX(n) AS DOUBLE) / SUM(n) > 0.5 AS hub_collapse FROM (SELECT label, COUNT(*) AS n FROM labels_ WHERE label <> -1 GROUP BY 1)"),
    "unclustered_fill": with_("vec", "SELECT id, CASE WHEN id % 3 <> 1 THEN label ELSE -1 END AS label FROM vec"),
    "label_merge": with_("vec", "SELECT CAST(id AS VARCHAR) AS basket_id, CASE WHEN id % 4 <> 1 THEN label ELSE -1 END AS need_state_cluster, CASE WHEN id % 4 <> 2 THEN label + 100 END AS need_state_cluster_gmm, CASE WHEN id % 4 <> 2 THEN 0.5::DOUBLE END AS gmm_confidence FROM vec"),
    "gmm_overlap": with_("post", """SELECT x.a AS gmm_component_a, y.b AS gmm_component_b, ROUND(COALESCE(z.m, 0.0), 6) AS mean_posterior, COALESCE(z.n, 0) AS n_baskets_a
       FROM (SELECT UNNEST(range(10)) AS a) x CROSS JOIN (SELECT UNNEST(range(10)) AS b) y
       LEFT JOIN (SELECT t.a, p.centroid AS b, AVG(p.p) AS m, COUNT(*) AS n FROM post p JOIN (SELECT id, arg_max(centroid, p) AS a FROM post GROUP BY 1) t USING (id) GROUP BY 1, 2) z ON z.a = x.a AND z.b = y.b"""),
    "adjacency": with_("adj", "SELECT need_state_a, need_state_b, n_edges, ROUND(weight_sum, 6) AS weight_sum, ROUND(lift, 6) AS lift, ROUND(share_a, 6) AS share_a, ROUND(share_b, 6) AS share_b FROM adj"),
    "neighbours": with_("adj", """SELECT need_state, n_edges, ROUND(weight_sum, 6) AS weight_sum, ROUND(lift, 6) AS lift, ROUND(share, 6) AS share_of_this FROM (
       SELECT need_state_b AS need_state, n_edges, weight_sum, lift, share_a AS share FROM adj WHERE need_state_a = 3 UNION ALL SELECT need_state_a, n_edges, weight_sum, lift, share_b FROM adj WHERE need_state_b = 3) ORDER BY adj_lift LIMIT 5""".replace("ORDER BY adj_lift", "ORDER BY 4 DESC, 1")),
    "adjacency_export": with_("npairs ndeg", """SELECT p.need_state_a, p.need_state_b, p.n_edges, ROUND(p.weight_sum, 6) AS weight_sum, ROUND(CAST(p.n_edges AS DOUBLE) / m.m, 6) AS share_of_all_edges,
       ROUND(p.weight_sum / (a.d * b.d / (2 * (SELECT SUM(weight_sum) FROM npairs))), 6) AS lift,
       ROUND((CAST(p.n_edges AS DOUBLE) / m.m) / ((xa.x / (2 * m.m)) * (xb.x / (2 * m.m)) * 2), 6) AS cross_lift
       FROM npairs p JOIN ndeg a ON a.s = p.need_state_a JOIN ndeg b ON b.s = p.need_state_b
       JOIN (SELECT s, CAST(SUM(n) AS DOUBLE) AS x FROM (SELECT need_state_a AS s, n_edges AS n FROM npairs WHERE need_state_a <> need_state_b UNION ALL SELECT need_state_b, n_edges FROM npairs WHERE need_state_a <> need_state_b) GROUP BY 1) xa ON xa.s = p.need_state_a
       JOIN (SELECT s, CAST(SUM(n) AS DOUBLE) AS x FROM (SELECT need_state_a AS s, n_edges AS n FROM npairs WHERE need_state_a <> need_state_b UNION ALL SELECT need_state_b, n_edges FROM npairs WHERE need_state_a <> need_state_b) GROUP BY 1) xb ON xb.s = p.need_state_b,
       (SELECT CAST(SUM(n_edges) AS DOUBLE) AS m FROM npairs WHERE need_state_a <> need_state_b) m
       WHERE p.need_state_a <> p.need_state_b ORDER BY p.n_edges DESC, 1, 2 LIMIT 20"""),
    "transitions_gap1": with_("trans1", _transitions("trans1")),
    "transitions_any": with_("transn", _transitions("transn")),
    "next_states": with_("trans1", _transitions("trans1", "WHERE from_need_state = 1 AND to_need_state <> 1 ORDER BY trans1.prob DESC, to_need_state LIMIT 3")),
    "journeys": with_("j3", f"SELECT {_PATH} FROM j3"),
    "journeys_partial": with_("j2", f"SELECT {_PATH} FROM j1 UNION ALL SELECT {_PATH} FROM j2"),
    "household_history": with_("elabels", "SELECT yw AS year_week_number, basket_id, need_state FROM elabels WHERE household_number = 7 ORDER BY yw"),
    "household_journeys": with_("h3 last_", f"SELECT 7::BIGINT AS household_number, (SELECT need_state FROM last_) AS current_need_state, (SELECT yw FROM last_) AS as_of, {_PATH} FROM h3"),
    "lift_counts": with_("counts", "SELECT need_state, tpnb, n_baskets FROM counts"),
    "lift_baseline": with_("base", "SELECT tpnb, n_baskets FROM base"),
    "lift_profiles": with_("prof", "SELECT need_state, tpnb, n_baskets_in_need_state, n_baskets_overall, ROUND(lift, 6) AS lift, ROUND(share_within_need_state, 6) AS share_within_need_state, description, department, rank_by_lift FROM prof"),
    "need_state_summary": with_("summ", "SELECT need_state, n_baskets, n_households, ROUND(avg_products_per_basket, 6) AS avg_products_per_basket FROM summ"),
    "labels_text": with_("terms", "SELECT need_state, label FROM terms"),
    "summary_enriched": with_("enr", """SELECT need_state, n_baskets, n_households, ROUND(avg_products_per_basket, 6) AS avg_products_per_basket, ROUND(max_lift, 6) AS max_lift, ROUND(avg_lift, 6) AS avg_lift, ROUND(median_lift, 6) AS median_lift,
       ROUND(top_share, 6) AS top_share, n_departments_top_n, n_products_profiled, label, ROUND(share_of_baskets, 6) AS share_of_baskets, ROUND(top_product_coverage, 6) AS top_product_coverage, size_band FROM enr"""),
    "bands_size": with_("enr", _band("avg_products_per_basket", _steps("avg_products_per_basket", [(2, "<=2"), (5, "2-5"), (10, "5-10"), (20, "10-20"), (50, "20-50")], ">50"))),
    "bands_lift": with_("enr", _band("max_lift", _steps("max_lift", [(1.5, "< 1.5"), (3, "1.5-3"), (5, "3-5"), (10, "5-10")], ">= 10"))),
    "bands_coverage": with_("enr", _band("top_product_coverage", _steps("top_product_coverage", [(0.10, "< 10%"), (0.25, "10-25%"), (0.50, "25-50%"), (0.75, "50-75%")], ">= 75%"))),
    "bands_departments": with_("enr", _band("n_departments_top_n", _steps("n_departments_top_n", [(1, "1"), (3, "2-3"), (6, "4-6")], "7+"), "n_departments_top_n > 0")),
    "headlines": with_("enr", """SELECT COUNT(*) AS n_need_states, CAST(SUM(n_baskets) AS BIGINT) AS n_baskets, ROUND(MEDIAN(max_lift), 6) AS median_max_lift, ROUND(AVG(CASE WHEN max_lift > 3 THEN 1.0 ELSE 0.0 END), 6) AS share_states_over_3,
       ROUND(SUM(CASE WHEN max_lift > 3 THEN n_baskets ELSE 0 END) / CAST(SUM(n_baskets) AS DOUBLE), 6) AS share_baskets_over_3, ROUND(MEDIAN(top_product_coverage), 6) AS median_coverage,
       ROUND((SELECT corr(x, y) FROM (SELECT RANK() OVER (ORDER BY avg_products_per_basket) + (COUNT(*) OVER (PARTITION BY avg_products_per_basket) - 1) / 2.0 AS x, RANK() OVER (ORDER BY max_lift) + (COUNT(*) OVER (PARTITION BY max_lift) - 1) / 2.0 AS y FROM enr WHERE max_lift IS NOT NULL)), 6) AS rho FROM enr"""),
    "spearman": "SELECT ROUND(corr(x, y), 6) AS rho FROM (SELECT RANK() OVER (ORDER BY p_size) + (COUNT(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS x, RANK() OVER (ORDER BY p_partkey % 37) + (COUNT(*) OVER (PARTITION BY p_partkey % 37) - 1) / 2.0 AS y FROM part)",
    "twin_jaccard": with_("twin", "SELECT need_state, ROUND(best, 6) AS best FROM twin"),
    "scorecard": with_("enr twin fullsize labels_", _score("", "labels_", "run1")),
    "permutation_null": with_("null_", "SELECT basket_id, label FROM null_"),
    "permutation_null_seeded": with_("labels_", "SELECT label, COUNT(*) AS n FROM labels_ GROUP BY 1"),
    "null_scorecard": with_("enr_null twin_null fullsize_null null_", _score("_null", "null_", "null1")),
    "excess": with_("prof prof_null", """SELECT 'run1' AS run, 'null1' AS null_run, ROUND(a, 6) AS median_max_lift, ROUND(b, 6) AS null_median_max_lift, ROUND(a - b, 6) AS excess FROM (
       SELECT (SELECT MEDIAN(m) FROM (SELECT MAX(lift) AS m FROM prof GROUP BY need_state)) AS a, (SELECT MEDIAN(m) FROM (SELECT MAX(lift) AS m FROM prof_null GROUP BY need_state)) AS b)"""),
    "log_upsert": with_("log_", "SELECT run, excess, lift_basis, CAST(NULL AS VARCHAR) AS note FROM log_ WHERE run <> 'run5' UNION ALL SELECT 'run5', 9.5, 'clustered', 'second'"),
    "basis_verdict": with_("log_", """SELECT string_agg(b, ', ' ORDER BY b) AS bases, CASE WHEN COUNT(CASE WHEN b <> 'clustered' THEN 1 END) = 0 THEN 'OK' WHEN COUNT(CASE WHEN b = 'clustered' THEN 1 END) > 0 THEN 'MIXED' ELSE 'ALL-STALE' END AS verdict
       FROM (SELECT DISTINCT COALESCE(lift_basis, '(pre-fix, unrecorded)') AS b FROM log_)"""),
    "run_union": with_("summ", "SELECT 'a' AS run, need_state, n_baskets, n_households FROM summ UNION ALL SELECT 'b', need_state, n_baskets, n_households FROM summ WHERE need_state < 3"),
    "heldout_log_ratio": with_("ctrain ctest", """SELECT t.need_state, ROUND(SUM(t.n * (log2((COALESCE(c.n, 0) + 1) / CAST(s.n + v.v AS DOUBLE)) - log2((b.n + 1) / CAST(a.n + v.v AS DOUBLE)))) / SUM(t.n), 6) AS bits
       FROM ctest t JOIN (SELECT need_state, SUM(n) AS n FROM ctrain GROUP BY 1) s USING (need_state) JOIN (SELECT tpnb, SUM(n) AS n FROM ctrain GROUP BY 1) b USING (tpnb)
       LEFT JOIN ctrain c ON c.need_state = t.need_state AND c.tpnb = t.tpnb, (SELECT SUM(n) AS n FROM ctrain) a, (SELECT COUNT(DISTINCT tpnb) AS v FROM ctrain) v GROUP BY 1"""),
}
