"""The text operators against brute force, on odd rows, and on empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from occasio.llm import _graph, _text, _tree, decontam, html, kneser, linededup, media, ngramjoin, packing, pii, quality, registry, toxicity, webp

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fp long, cls string, row int, doc string, block int, score double, train string, label int, place int, word string, cluster string, lines int"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows():
    """Nulls, empty and blank texts, a very long one, copies, repeated rows, ties, odd characters."""
    rng = random.Random(5)
    base, long = prose(rng, 120), prose(rng, 30_000, 5000)
    passage = "\n".join(prose(rng, 20, 100_000) for _ in range(4))
    texts = [(1, base), (2, base), (3, base + " tail"), (3, base + " tail"), (4, None), (5, ""), (6, " \t\n\r "), (7, long), (8, long + " x"), (None, base), (None, None)]
    texts += [(9, "Ünïcödé ß — 漢字 \U0001f600 A\x0bB\x0cC\x00D"), (10, "one two"), (11, "ONE  two"), (12, f"{prose(rng, 30)}\n{passage}\n{prose(rng, 30)}"), (13, f"{passage}\n{prose(rng, 40)}"), (14, passage), (14, prose(rng, 60)), (15, "Les " * 3000)]
    return [(d, t, None if d == 9 else "en", None if d in (2, 9) else "s" if d != 10 else "", None, 1, "c", 2, "d", 3, 0.5, "t", 4, 5, "w", "k", 6) for d, t in texts]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# --- words


def test_words_and_shingles_are_those_of_the_pattern():
    rng = random.Random(0)
    texts = ["", " ", "a", "A b  c\td\ne F", "é x  y", None] + ["".join(rng.choice("aB \n\t\x0b\x1cé漢") for _ in range(rng.randrange(60))) for _ in range(300)]
    w = _text.words(pa.array(texts))
    ids = {}
    for i, t in enumerate(texts):
        mine, theirs = w.hashes[w.bounds[i] : w.bounds[i + 1]].tolist(), words(t)
        assert len(mine) == len(theirs)
        for a, b in zip(mine, theirs):
            assert ids.setdefault(b, a) == a
    assert len(set(ids.values())) == len(ids)
    sets = _text.shingle_sets(w)
    for i, t in enumerate(texts):
        x = words(t)
        assert len(sets[i]) == (len({tuple(x[k : k + 5]) for k in range(len(x) - 4)}) if len(x) >= 5 else bool(x))


def test_pieces_hold_whole_rows():
    b = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (10, 0, 500, 3, 3, 3)])], names=["text"])
    got = list(_text.pieces(b, limit=8))
    assert [r for p in got for r in p.column(0).to_pylist()] == b.column(0).to_pylist() and len(got) >= 4


def test_tree_sum_and_filter(spark):
    df = spark.range(1000).repartition(7)

    def gather(batches):
        out = np.zeros(16, np.int64)
        for b in batches:
            out += np.bincount(b.column(0).to_numpy() % 16, minlength=16)
        return out

    assert _tree.merged(df, gather, 16, np.int64).tolist() == [63] * 8 + [62] * 8
    flt = _tree.bloom(df, 16)
    assert _tree.may_hold(flt, np.arange(1000)).all() and _tree.may_hold(flt, np.arange(10_000, 20_000)).mean() < 0.1


# --- 1


def brute_groups(rows):
    """component_id of each (doc_id, text), by all pairs."""
    sets = []
    for d, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for g, (d, _) in zip(group, rows):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    return sorted(((d, len(s), least.get(g, d) if s else d) for (d, _), s, g in zip(rows, sets, group)), key=repr)


def planted(seed, groups=12):
    """Groups of near copies around the threshold, and shared passages."""
    rng = random.Random(seed)
    rows, d = [], 0
    passage = [f"p{i}" for i in range(60)]
    for _ in range(groups):
        base = [f"b{rng.randrange(3000)}" for _ in range(rng.randrange(3, 200))]
        for _ in range(rng.randrange(1, 9)):
            x = list(base)
            for _ in range(rng.randrange(0, max(1, len(x) // 20))):
                x[rng.randrange(len(x))] = f"e{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                x += passage
            rows.append((d, " ".join(x)))
            d += 1
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_are_exact(spark, seed):
    rows = planted(seed, 30)
    got = ngramjoin.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()), key=repr) == brute_groups(rows)


def test_groups_of_odd_rows(spark, odd, none):
    got = ngramjoin.near_duplicate_groups(odd).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute_groups([(r[0], r[1]) for r in odd_rows()])
    kept = ngramjoin.keep_one_of_each_group(odd)
    assert kept.columns == odd.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    assert ids == sorted([1, 4, 5, 6, 7, 9, 10, 12, 13, 14, 14, 15, None], key=repr)
    assert ngramjoin.near_duplicate_groups(none).count() == 0 and ngramjoin.keep_one_of_each_group(none).count() == 0


def test_a_prefix_finds_every_link():
    rng = random.Random(3)
    for _ in range(3000):
        n = rng.randrange(1, 60)
        a = set(rng.sample(range(80), n))
        b = set(a)
        for _ in range(rng.randrange(0, 12)):
            b ^= {rng.randrange(80)}
        if not b or 100 * len(a & b) < 80 * len(a | b):
            continue
        la, lb = (rng.randrange(1, 1 + max(1, len(s) // 5)) for s in (a, b))
        o = -(-80 * (len(a) + len(b)) // 180)
        assert len(a & b) >= o
        for q in range(1, min(la, lb) + 1):
            pa_, pb = set(sorted(a)[: len(a) - o + q]), set(sorted(b)[: len(b) - o + q])
            assert len(pa_ & pb) >= q
        assert len(a) - o + la <= len(a) - ngramjoin.needed(len(a)) + la


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200)], "a long, b long")
    labels, _ = _graph.components(links, "test")
    assert {r["node"]: r["label"] for r in labels.collect()} == {**{i: 0 for i in range(41)}, 100: 100, 200: 100}


# --- 2


def test_packing_loses_nothing_and_has_no_conflict(spark, odd, none, docs):
    for df in (odd, docs):
        got = packing.best_fit_pack(df, capacity=256, max_per_source=2, block_rows=64).collect()
        size = Counter()
        for r in df.collect():
            size[r["doc_id"]] += len(words(r["text"]))
        mine = Counter()
        for r in got:
            mine[r["doc_id"]] += r["n_words"]
        assert {k: v for k, v in mine.items() if v} == {k: v for k, v in size.items() if v} and set(mine) == set(size)
        bins = defaultdict(list)
        for r in got:
            if r["bin_id"] is not None:
                bins[r["bin_id"]].append(r)
        for rows in bins.values():
            rows.sort(key=lambda r: r["bin_offset"])
            at = 0
            for r in rows:
                assert r["bin_offset"] == at
                at += r["n_words"]
            assert at <= 256 and at == rows[0]["bin_words"]
            assert len({r["cluster"] for r in rows}) == len(rows)
            assert max(Counter(r["source"] for r in rows).values()) <= 2
    assert packing.best_fit_pack(none).count() == 0


def test_repeated_and_null_ids_fill_no_block(spark):
    rng = random.Random(31)
    rows = [(None, prose(rng, 5), "s") for _ in range(900)] + [(1, "same text", "t")] * 300
    got = packing.best_fit_pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), capacity=64, max_per_source=2, block_rows=50).collect()
    assert len(got) == 1200 and sum(r["n_words"] for r in got) == 900 * 5 + 600
    blocks = Counter("-".join(r["bin_id"].split("-")[:-1]) for r in got)
    assert max(blocks.values()) <= 100 and len(blocks) >= 12
    assert max(Counter(r["bin_id"] for r in got if r["doc_id"] == 1).values()) == 1


def test_the_tightest_bin_without_conflict_is_found():
    rng = np.random.default_rng(0)
    for _ in range(60):
        bins, naive = packing.Bins(50, 5, 4, 1, size=2), []
        for _ in range(60):
            length, source, cluster = int(rng.integers(1, 40)), int(rng.integers(5)), int(rng.integers(-1, 4))
            fit = [(room, i) for i, (room, sources, clusters) in enumerate(naive) if room >= length and source not in sources and (cluster < 0 or cluster not in clusters)]
            got, at = bins.place(length, source, cluster)
            if not fit:
                assert got == len(naive) and at == 0
                naive.append([50, set(), set()])
            else:
                assert got == min(fit)[1] and at == 50 - naive[got][0]
            naive[got][0] -= length
            naive[got][1].add(source)
            if cluster >= 0:
                naive[got][2].add(cluster)


# --- 3


def test_segments_are_all_maximal_ones():
    rng = np.random.default_rng(1)

    def brute(x):
        if not len(x) or x.max() <= 0:
            return []
        best = max(((float(x[i:j].sum()), -(j - i), -i, i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)))
        _, _, _, i, j = best
        return brute(x[:i]) + [(i, j)] + [(a + j, b + j) for a, b in brute(x[j:])]

    for _ in range(200):
        x = rng.normal(size=rng.integers(1, 14))
        assert [(a, b) for a, b, _ in toxicity.segments(x)] == brute(x)


def test_the_scan_follows_each_link_once():
    for n in (1000, 8000):
        for scores in (np.tile([1.0, -1.5], n), np.tile([1.0, -0.5], n), np.concatenate([np.tile([1.0, -1.01], n), np.full(n, 1.0)]), np.random.default_rng(n).normal(-0.2, 1, 2 * n)):
            positive = np.flatnonzero(scores > 0).tolist()
            _, steps = toxicity._candidates(positive, np.concatenate(([0.0], np.cumsum(scores))))
            assert steps <= 2 * len(positive)


def test_evidence_is_the_best_sum_statistic():
    model = toxicity.ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), 0.5, 0.7, 0.3, 1.0, 0.0, 0.01)
    rng = np.random.default_rng(5)
    for _ in range(50):
        scores, n = rng.exponential(20, rng.integers(0, 90)), int(rng.integers(1, 3000))
        best, total = 0.0, 0.0
        for r, s in enumerate(sorted(scores, reverse=True), 1):
            total += 0.7 * s - math.log(0.3 * n)
            if total > 0:
                best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r))
        assert model.evidence(scores, n) == pytest.approx(best)


def toy(spark, n=400):
    rng, rows, labels = random.Random(2), [], []
    for d in range(n):
        toxic = d % 4 == 0
        x = prose(rng, 40).split()
        for _ in range(3 * toxic):
            x.insert(rng.randrange(len(x)), rng.choice(["Vile", "vile,", "NASTY", "nasty"]))
        rows.append((d, " ".join(x), "en", "s"))
        labels.append((d, int(not toxic), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxic_passages_are_found(spark, odd, none):
    df, labels = toy(spark)
    model = toxicity.fit(df, labels)
    got = by_id(toxicity.score(df, model))
    held = [d for d in got if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all((got[d]["score"] >= 0.5) == (d % 4 == 0) for d in held) and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(bool(got[d]["passages"]) == (d % 4 == 0) for d in held)
    kept = toxicity.keep_clean(df, model)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {d for d in got if got[d]["score"] < 0.5}
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.keep_clean(odd, model).columns == odd.columns
    assert toxicity.score(none, model).count() == 0
    blank = toxicity.fit(odd, spark.createDataFrame([], labels.schema))
    assert all(0 <= r["score"] < 0.5 for r in toxicity.score(odd, blank).collect())
    assert toxicity.keep_clean(df, toxicity.fit(none, labels)).count() == df.count()


def test_toxicity_is_the_formula(spark):
    """Odds, z-scores, lambda, K, evidence and scores by plain loops."""
    df, labels = toy(spark, 150)
    model = toxicity.fit(df, labels, z_min=1.5, odds_min=0.5)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    feature = {}

    def features(text):
        """For each word: the word, then its first 4 to 9 bytes, as far as it is longer."""
        out = []
        for w in re.findall(r"[a-z0-9]+", text.lower()):
            out.append([("", w), *((k, w[:k]) for k in toxicity.STEMS if len(w) > k)])
            one = _text.terms(pa.array([w]))
            for name, (_, h) in zip([("", w), *((k, w[:k]) for k in toxicity.STEMS)], toxicity._features(one)):
                if len(h):
                    feature[name] = int(h[0])
        return out

    train = [(features(t), toxic[d]) for d, t in rows if zlib.crc32(str(d).encode()) % 5]
    count = [Counter(), Counter()]
    for words_, y in train:
        count[y].update({f for w in words_ for f in w})
    n = [sum(c.values()) for c in count]
    a0 = 0.02 * sum(n)
    odds, z, p0 = {}, {}, {}
    for f in {*count[0], *count[1]}:
        alpha = a0 * (count[0][f] + count[1][f]) / sum(n)
        odds[f] = math.log((count[1][f] + alpha) / (n[1] + a0 - count[1][f] - alpha)) - math.log((count[0][f] + alpha) / (n[0] + a0 - count[0][f] - alpha))
        z[f] = odds[f] / math.sqrt(1 / (count[1][f] + alpha) + 1 / (count[0][f] + alpha))
        p0[f] = (count[0][f] + alpha) / (n[0] + a0)
    kept = {f for f in odds if abs(z[f]) >= 1.5 and abs(odds[f]) >= 0.5}
    at = {int(k): i for i, k in enumerate(model.keys)}
    assert {feature[f] for f in kept} == set(at) and len(kept) > 3
    assert all(model.weights[at[feature[f]]] == pytest.approx(odds[f]) and model.z[at[feature[f]]] == pytest.approx(z[f]) for f in kept)
    rest = 1 - sum(p0[f] for f in kept)
    if 0.05 < model.lam < 60:
        assert sum(p0[f] * math.exp(model.lam * (odds[f] - 0.5)) for f in kept) + rest * math.exp(-0.5 * model.lam) == pytest.approx(1, abs=1e-6)

    def scores(text):
        out = []
        for w in features(text):
            best = max((f for f in w if f in kept), key=lambda f: abs(z[f]), default=None)
            out.append((odds[best] if best else 0.0) - 0.5)
        return np.array(out)

    got = by_id(toxicity.score(df, model))
    for d, t in rows[:60]:
        x = scores(t)
        segments = [s for _, _, s in toxicity.segments(x)]
        assert got[d]["score"] == pytest.approx(model.probability(model.evidence(np.array(segments), len(x))), abs=1e-9)
        assert [(p["first_word"], p["end_word"]) for p in got[d]["passages"]] == [(i, j) for i, j, s in toxicity.segments(x) if model.k * len(x) * math.exp(-model.lam * s) <= model.e_max]


# --- 4


def kneser_brute(rows):
    text = [(d, words(t) + ["\0"], d is not None and zlib.crc32(str(d).encode()) % 7 == 2) for d, t in rows]
    c, b = Counter(), Counter()
    for _, t, held in text:
        if not held:
            c.update(t)
            b.update(zip(["\1", *t[:-1]], t))
    n, v = sum(c.values()), len(c)
    ctx, cont = defaultdict(lambda: [0, 0, 0, 0]), Counter()
    for (u, w), k in b.items():
        ctx[u][0] += k
        ctx[u][min(k, 3)] += 1
        cont[w] += 1
    nn = lambda x: [sum(1 for y in x.values() if y == k) for k in (1, 2, 3, 4)]
    d2, d1 = kneser.discounts(*nn(b)), kneser.discounts(*nn(cont))
    spare = sum(d1[min(k, 3) - 1] for k in cont.values()) / len(b) if b else 1.0

    def low(w):
        k = cont.get(w, 0)
        return (max(k - d1[min(k, 3) - 1], 0) / len(b) if k else 0) + spare / (v + 1)

    def p(u, w):
        if u not in ctx:
            return low(w)
        x, k = ctx[u], b.get((u, w), 0)
        return (max(k - d2[min(k, 3) - 1], 0) if k else 0) / x[0] + (d2[0] * x[1] + d2[1] * x[2] + d2[2] * x[3]) / x[0] * low(w)

    for u in ["\1", *list(ctx)[:3]]:
        if v:
            assert sum(p(u, w) for w in c) + p(u, "\2") == pytest.approx(1)
    return [(d, held, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), sum(math.log10(p(u, w)) for u, w in zip(["\1", *t[:-1]], t))) for d, t, held in text]


@pytest.mark.parametrize("kind", ["odd", "docs", "none"])
def test_scores_are_those_of_the_model(spark, kind, request):
    df = request.getfixturevalue(kind)
    out, model = kneser.fit_and_score(df, F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    want = sorted(kneser_brute([(r["doc_id"], r["text"]) for r in df.collect()]), key=repr)
    assert len(got) == len(want)
    key = lambda r: (repr(r[0]), r[2], round(r[-1], 4))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[5]) and a[5] == pytest.approx(b[6])
    assert all(model.vocabulary.tokens == b[4] for b in want)


# --- 5


def edits(a, b):
    """Least word edits between a and any part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_near_copies_of_items_are_found(spark, odd, none):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.randrange(8, 40), 2000)) for i in range(12)] + [(90, None), (91, " "), (92, "lone words")]
    rows = []
    for d in range(80):
        x = prose(rng, 60, 2000).split()
        if d % 2:
            y = words(items[rng.randrange(12)][1])
            for _ in range(rng.randrange(0, 1 + len(y) // 5)):
                k = rng.randrange(len(y))
                y[k : k + 1] = rng.choice([[], [f"z{rng.randrange(99)}"], [y[k], "zz"]])
            at = rng.randrange(len(x))
            x[at:at] = y
        rows.append((d, " ".join(x)))
    want = {}
    for d, t in rows:
        for i, s in items:
            m = words(s)
            if m and (e := edits(m, words(t))) <= len(m) // 5:
                want[d, i] = e
    got = {(r["doc_id"], r["item_id"]): r["n_edits"] for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    hits = sum(got.get(k) == v for k, v in want.items())
    assert len(want) >= 25 and hits >= 0.9 * len(want) and set(got) <= set(want)
    assert all(got[k] == 0 for k, v in want.items() if v == 0)
    all_items = spark.createDataFrame(items, "item_id long, text string")
    assert decontam.keep_uncontaminated(odd, all_items).columns == odd.columns
    assert decontam.contaminated(odd, all_items).count() == 0 and decontam.contaminated(none, all_items).count() == 0
    assert decontam.contaminated(odd, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert decontam.keep_uncontaminated(odd, spark.createDataFrame([], "item_id long, text string")).count() == odd.count()


@pytest.mark.parametrize("kind", ["long", "string"])
def test_items_with_any_ids(spark, odd, kind):
    base, passage, other = odd_rows()[0][1], "\n".join(words(odd_rows()[-6][1])[30:60]), "no such words here at all"
    ids = [None, 7, 7, 8, 8, 9] if kind == "long" else [None, "x", "x", "", "", "é"]
    texts = [" ".join(words(base)[10:40]), " ".join(words(base)[50:90]), passage, other, other, None]
    items = spark.createDataFrame(list(zip(ids, texts)) + [(ids[1], texts[1])], f"item_id {kind}, text string")
    want = Counter()
    for d, t, *_ in odd_rows():
        for i, s in {(i, s) for i, s in zip(ids, texts) if s}:
            m = words(s)
            if (e := edits(m, words(t))) <= len(m) // 5:
                want[d, i, e, len(m)] += 1
    got = Counter((r["doc_id"], r["item_id"], r["n_edits"], r["item_words"]) for r in decontam.contaminated(odd, items).collect())
    assert got == want and sum(want.values()) >= 10 and any(i is None for _, i, _, _ in want) and any(d is None for d, _, _, _ in want)
    kept = decontam.keep_uncontaminated(odd, items).collect()
    assert sorted((r["doc_id"] for r in kept if r["text"]), key=repr) == sorted((d for d, t, *_ in odd_rows() if t and not any(edits(words(s), words(t)) <= len(words(s)) // 5 for s in texts if s)), key=repr)


def test_all_matches_of_the_test_tables_are_found(spark):
    # Brute force: the edit distance of every item to every document that shares enough words with it.
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    rows, texts = docs.select("doc_id", "text").collect(), items.select("item_id", "text").collect()
    index = decontam.build_index([r["text"] for r in texts])
    w = _text.words(pa.array([r["text"] for r in rows], pa.string()))
    want = {}
    for x in index.lengths:
        for k, r in enumerate(rows):
            h = w.hashes[w.bounds[k] : w.bounds[k + 1]]
            may = np.flatnonzero(np.isin(x.items, h).sum(1) >= x.m - x.k)
            if len(h) and len(may):
                for c, e in zip(may, decontam.edit_distance(x.items[may], np.tile(h, (len(may), 1)))):
                    if e <= x.k:
                        want[r["doc_id"], texts[x.ids[c]]["item_id"]] = int(e)
    got = {(r["doc_id"], r["item_id"]): r["n_edits"] for r in decontam.contaminated(docs, items).collect()}
    assert len(want) >= 20 and set(got) <= set(want) and len(got) >= 0.95 * len(want) and all(want[k] == e for k, e in got.items())


def test_edit_distance_rows():
    rng = np.random.default_rng(0)
    a, b = rng.integers(1, 6, (50, 7)).astype(np.uint64), rng.integers(1, 6, (50, 12)).astype(np.uint64)
    assert decontam.edit_distance(a, b).tolist() == [edits(x.tolist(), y.tolist()) for x, y in zip(a, b)]


# --- 6


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; <b>bold</b>  text", "plain & bold text"),
        ("<p>a<p>b<div>c", "a\n\nb\n\nc"),
        ("<ul><li>a<li>b<ol start=4><li>c</ol></ul>", "- a\n- b\n  4. c"),
        ("<table><tr><td>aa<td>b<tr><td>c<td>dd</table>", "aa  b\nc   dd"),
        ("<table><tr><td rowspan=2>x<td>1<tr><td>2</table>", "x  1\n   2"),
        ("<pre>\n a\n  b</pre>", " a\n  b"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<head><title>t</title><style>.x{display:none}</style></head><p class=x>no<p>yes", "yes"),
        ("<div style='visibility:hidden'>no<i style='visibility: visible'>yes</i></div><p hidden>no", "yes"),
        ("<script>if (a < b) x()</script><!-- c --><noscript>n</noscript>v", "v"),
        ("a <unclosed attr='", "a"),
        ("1 < 2 & 3 > 2", "1 < 2 & 3 > 2"),
        ("<details><summary>s</summary>hidden</details>", "s"),
        ("</p>x</div>", "x"),
    ],
)
def test_rendering(source, want):
    assert html.render(source)[1] == want


def test_rendering_survives_depth_and_noise():
    assert html.render("<div>" * 50_000 + "deep")[1] == "deep"
    assert html.render("<ul><li>" * 3000 + "x")[1].strip().endswith("x")
    rng = random.Random(4)
    for _ in range(300):
        html.render("".join(rng.choice(["<", ">", "</", "<table>", "<td>", "<li>", "<p ", "a=\"", "'", "&lt;", "&#x;", "x", " ", "<!--", "-->", "<style>", "</style>", "<pre>"]) for _ in range(60)))


def test_pages(spark):
    rows = [(1, "u", "<title>A  b</title><p>x"), (2, "u", None), (None, None, ""), (1, "v", "y")]
    got = html.extract(spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert sorted((r["page_id"] or 0, r["title"], r["text"], r["n_lines"]) for r in got) == [(0, "", "", 0), (1, "", "y", 1), (1, "A b", "x", 1), (2, "", "", 0)]
    assert html.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


class Plain(HTMLParser):
    """All text outside hidden elements, by a stack of open tags alone."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
    INLINE = {"b", "i", "em", "strong", "a", "span", "code", "u", "s", "small", "sub", "sup"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.out = [], []

    def handle_starttag(self, tag, attrs):
        style = (dict(attrs).get("style") or "").replace(" ", "").lower()
        hidden = tag in ("script", "style", "noscript", "template", "title", "head") or "hidden" in dict(attrs) or "display:none" in style or "visibility:hidden" in style
        if tag not in self.VOID:
            self.open.append((tag, hidden))
        self.out.append("" if tag in self.INLINE else " ")

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break
        self.out.append("" if tag in self.INLINE else " ")

    def handle_data(self, data):
        if not any(hidden for _, hidden in self.open):
            self.out.append(data)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_all_visible_words_are_rendered(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/sf{sf}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    for r in pages.collect():
        plain = Plain()
        plain.feed(r["html"] or "")
        plain.close()
        assert re.sub(r"(?m)^(\s*)(?:- |\d+\. )+", r"\1", got[r["page_id"]]).split() == "".join(plain.out).split(), r["page_id"]


def test_hostile_numbers_are_read():
    assert html.render("<td colspan=" + "9" * 5000 + ">x</td>&#" + "7" * 5000 + "; &#65; &#" + "0" * 5000 + "66;<ol start=" + "9" * 5000 + "><li>a</ol>")[1] == "x\n\ufffd A B\n\n1. a"
    assert html.render("<table><tr><td rowspan=" + "9" * 5000 + ">x<td>1<tr><td>2</table>")[1] == "x  1\n   2"
    tall = "<table><tr><td rowspan=1500>x<td>0" + "".join(f"<tr><td>{i}" for i in range(1, 1400)) + "</table>"
    assert html.render(tall)[1].split("\n")[1399] == "   1399"


# --- 7


def test_quality_learns_and_is_calibrated(spark, odd, none):
    rng, rows, labels = random.Random(6), [], []
    for d in range(300):
        good = d % 3 > 0
        x = prose(rng, 40).split()
        rows.append((d, " ".join(x if good else [w + "%%%" for w in x])))
        labels.append((d, int(good), 0))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(df, lab)
    got = by_id(quality.score(df, model))
    held = [d for d in got if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all((got[d]["score"] >= 0.5) == (d % 3 > 0) for d in held)
    again = by_id(quality.score(df, quality.fit(df.repartition(7), lab)))
    assert all(again[d]["score"] == pytest.approx(got[d]["score"], abs=1e-6) for d in got)
    rows = by_id(quality.score(odd, model))
    assert all(0 <= r["score"] <= 1 for r in rows.values()) and quality.score(odd, model).count() == odd.count() and quality.score(none, model).count() == 0
    assert rows[1]["score"] == rows[2]["score"] and rows[4]["score"] == rows[5]["score"] == rows[6]["score"] != rows[1]["score"]
    blank = quality.fit(none, lab)
    assert len({r["score"] for r in quality.score(odd, blank).collect()}) == 1
    assert quality._temperature(np.array([8.0, -8.0, 8.0, -8.0]), np.array([1.0, 0.0, 0.0, 1.0])) > 4


def test_word_vectors_are_those_of_the_neighbours(spark):
    rng = random.Random(16)
    texts = [" ".join(rng.choice(["alpha", "Beta", "BETA", "gamma!", "delta\n\n", "x1"]) for _ in range(rng.randrange(0, 30))) for _ in range(60)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5).select(F.coalesce("text", F.lit("")).alias("text"))
    vocabulary = quality.Vocabulary(quality.frequent_tokens(df, 0.02))
    place, sign = vocabulary.index()
    want = np.zeros((vocabulary.size, quality.DIM))
    token = re.compile(r"[A-Za-z0-9]+|\n+|[^A-Za-z0-9\s]+")
    counts = Counter(x for t in texts for x in token.findall(t or ""))
    assert len(vocabulary.keys) == sum(n >= 0.02 * sum(counts.values()) for n in counts.values())
    for t in texts:
        rows = vocabulary.rows(*quality._tokens(pa.array([t], pa.string()))[:2])
        assert len(rows) == len(token.findall(t or ""))
        for i in range(len(rows)):
            for j in range(max(0, i - quality.WINDOW), min(len(rows), i + quality.WINDOW + 1)):
                if i != j:
                    np.add.at(want[rows[i]], place[rows[j]], sign[rows[j]])
    want = np.sign(want) * np.log1p(np.abs(want))
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert np.abs(quality.word_vectors(df, vocabulary) - want).max() < 1e-6
    got = quality.features(pa.array(texts, pa.string()), vocabulary, want.astype(np.float32))
    for t, f in zip(texts, got):
        x = want[vocabulary.rows(*quality._tokens(pa.array([t], pa.string()))[:2])]
        pairs = (x[1:] * x[:-1]).sum(0)
        assert np.allclose(f, np.concatenate([x.sum(0), pairs]) / max(len(x), 1), atol=1e-5)


def test_the_score_is_carried_by_the_vectors(spark):
    # Good and bad texts have the same shapes of tokens, of the same lengths, and differ only in which words occur.
    rng, rows, labels = random.Random(17), [], []
    good, bad = ([f"{x}{c}{d}" for c in "bcdfg" for d in "aeiou"] for x in ("ka", "mo"))
    for d in range(400):
        rows.append((d, " ".join(rng.choice(good if d % 3 else bad) for _ in range(20))))
        labels.append((d, int(d % 3 > 0), 0))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = by_id(quality.score(df, quality.fit(df, lab)))
    held = [d for d in got if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all((got[d]["score"] >= 0.5) == (d % 3 > 0) for d in held)


def test_quality_holds_out(spark):
    # On the labelled documents of the test tables: learnt from four fifths, right on the others.
    df, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = by_id(quality.score(df, quality.fit(df, lab)))
    rows = [(r["quality"], got[r["doc_id"]]["score"]) for r in lab.collect() if r["doc_id"] in got and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(rows) > 20 and sum((s >= 0.3) == (y == 1) for y, s in rows) >= 0.9 * len(rows)


# --- 8


def test_media_round_trip(spark, odd, none):
    got = sorted(media.media_features(odd).collect(), key=repr)
    assert len(got) == odd.count()
    seen = {}
    for d, t in [(r[0], r[1]) for r in odd_rows()]:
        data = (t or "").encode()
        padded = data + b"\0" * (-len(data) % 64 if data else 64)
        stored = media.store([padded])[0]
        assert media.load([stored], [len(padded)])[0][0] == padded
        seen.setdefault((d, len(data)), []).append((len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(stored), hashlib.sha256(stored).hexdigest()))
    for r in got:
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"]) in seen[r["doc_id"], r["n_bytes"]]
    assert media.media_features(none).count() == 0
    pixels = media.decode_column(media.encode_column(odd).union(spark.createDataFrame([(99, None, 0), (98, bytearray(b"RIFFxxxxWEBP"), 0)], "doc_id long, media binary, payload_bytes long"))).collect()
    assert {r["doc_id"]: r["error"] for r in pixels if r["error"]} == {99: "null", 98: "no whole RIFF container"}


def test_stored_texts_are_read_through_every_feature(spark, docs, odd):
    got = media.media_features(docs.union(odd.select(docs.columns))).agg(*[F.sum(x).alias(x) for x in media.FEATURES], F.max("images").alias("images"), F.sum("media_bytes").alias("media"), F.sum("payload_bytes").alias("payload")).first()
    assert all(got[x] > 0 for x in media.FEATURES) and got["images"] > 10 and got["media"] < got["payload"]


def chunks(n=120):
    rng = random.Random(21)
    alphabet = "abcdefgh ijklmnop\nqrstuvwxyzÄéß漢\0"
    texts = ["".join(rng.choice(alphabet[: rng.randrange(1, 30)]) for _ in range(rng.randrange(3000))) * rng.randrange(1, 3) for _ in range(n)]
    payloads = [media.pad(t.encode()) for t in texts] + [bytes(rng.randrange(256) for _ in range(64 * 40))]
    return payloads, [[webp.chunk(f) for f in media.images(x)] for x in media.store(payloads)]


def test_images_read_together_are_those_read_one_by_one():
    payloads, stored = chunks()
    flat = [c for x in stored for c in x]
    assert [media.store([x])[0] for x in payloads] == media.store(payloads)
    together, alone = webp.decode_many(flat), [webp.decode_many([c])[0] for c in flat]
    assert all((a[0] == b[0]).all() and a[1] == b[1] for a, b in zip(together, alone))
    assert {k for _, read in together for k, v in read.items() if v} == {"palette", "predictor", "cross_colour", "references", "cached"}
    for x, (back, _, _) in zip(payloads, media.load(media.store(payloads), [len(x) for x in payloads])):
        assert back == x


def test_other_streams_are_read_together():
    # With a meta prefix image, a palette, a cache and references, many times over and beside images of other sizes.
    rng = random.Random(22)
    meta = Writer()
    meta.put(0x2F, 8).put(7, 14).put(7, 14).put(1, 1).put(0, 3).put(0, 1)
    meta.put(0, 1).put(1, 1).put(0, 3)  # no cache; a meta image of 2 x 2 tiles
    image(meta, [0xFF000000, 0xFF000100, 0xFF000100, 0xFF000000], top=False)
    groups = [[meta.flat(x, n) for x, n in zip(parts, (280, 256, 256, 256, 40))] for parts in ([[1, 2], [3], [4], [255], [0]], [[5, 6, 7, 8], [9], [10], [255], [0]])]
    want = []
    for y in range(8):
        for x in range(8):
            which = int((y < 4) != (x < 4))
            g = rng.choice([[1, 2], [5, 6, 7, 8]][which])
            meta.put(*groups[which][0][g])
            for k, v in zip((1, 2, 3), ((3, 4, 255), (9, 10, 255))[which]):
                meta.put(*groups[which][k][v])
            want.append(255 << 24 | (3, 9)[which] << 16 | g << 8 | (4, 10)[which])
    ref = head(6, 3).put(0, 1)
    pixels = [rng.randrange(2**32) for _ in range(6)]
    image(ref, None, ops=[("px", p) for p in pixels] + [("copy", 6, 126), ("copy", 6, 1)])
    many = [meta.bytes(), ref.bytes()] * 20 + [x for c in chunks(5)[1] for x in c]
    got = webp.decode_many(many)
    assert all(argb(px) == (want, pixels * 3)[i % 2] for i, (px, _) in enumerate(got[:40]))
    assert argb(webp.decode_vp8l(meta.bytes())) == want
    with pytest.raises(webp.WebPError):
        webp.decode_many(many + [many[-1][: len(many[-1]) - 20]])


class Writer(webp.BitWriter):
    """Writes VP8L streams with every feature, for the decoder."""

    def code(self, lengths):
        """A normal prefix code; lengths of its code length code are all 5 bits but for the unused ones."""
        self.put(0, 1).put(15, 4)
        for k in webp.CODE_LENGTH_ORDER:
            self.put(4 if k < 16 else 0, 3)
        self.put(0, 1)
        for n in lengths:
            self.put(int(f"{n:04b}"[::-1], 2), 4)  # canonical code of 16 symbols of four bits
        used = sorted((n, s) for s, n in enumerate(lengths) if n)
        out, code, last = {}, 0, used[0][0] if used else 0
        if len(used) == 1:
            return {used[0][1]: (0, 0)}
        for n, s in used:
            code <<= n - last
            last = n
            out[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
            code += 1
        return out

    def flat(self, symbols, alphabet):
        """Symbols with a power of two in number, all of one length."""
        symbols = sorted(set(symbols))
        n = max(1, (len(symbols) - 1).bit_length())
        extra = [s for s in range(alphabet) if s not in symbols]
        while len(symbols) < 1 << n:
            symbols.append(extra.pop())
        return self.code([n * (s in symbols) for s in range(alphabet)])


def image(w, pixels, cache_bits=0, ops=None, top=True):
    """An entropy-coded image of ARGB pixels; ops: ("px", p), ("copy", length, distance), ("cache", index)."""
    ops = ops or [("px", p) for p in pixels]
    w.put(bool(cache_bits), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if top:
        w.put(0, 1)

    def prefix(v):
        if v <= 4:
            return v - 1, 0, 0
        v -= 1
        n = v.bit_length() - 2
        return 2 * (n + 1) + ((v >> n) & 1), n, v & ((1 << n) - 1)

    green, red, blue, alpha, dist = [], [], [], [], []
    for op in ops:
        if op[0] == "px":
            alpha.append(op[1] >> 24), red.append(op[1] >> 16 & 255), green.append(op[1] >> 8 & 255), blue.append(op[1] & 255)
        elif op[0] == "copy":
            green.append(256 + prefix(op[1])[0]), dist.append(prefix(op[2])[0])
        else:
            green.append(280 + op[1])
    size = 280 + (1 << cache_bits if cache_bits else 0)
    g, r, b, a, d = (w.flat(x or [0], n) for x, n in ((green, size), (red, 256), (blue, 256), (alpha, 256), (dist, 40)))
    for op in ops:
        if op[0] == "px":
            for code, v in ((g, op[1] >> 8 & 255), (r, op[1] >> 16 & 255), (b, op[1] & 255), (a, op[1] >> 24)):
                w.put(*code[v])
        elif op[0] == "copy":
            s, n, rest = prefix(op[1])
            w.put(*g[256 + s]).put(rest, n)
            s, n, rest = prefix(op[2])
            w.put(*d[s]).put(rest, n)
        else:
            w.put(*g[280 + op[1]])


def head(w, h):
    return Writer().put(0x2F, 8).put(w - 1, 14).put(h - 1, 14).put(1, 1).put(0, 3)


def argb(px):
    p = px.astype(np.uint32)
    return (p[..., 3] << 24 | p[..., 0] << 16 | p[..., 1] << 8 | p[..., 2]).ravel().tolist()


def test_decoder_reads_prefix_codes_references_and_cache():
    rng = random.Random(0)
    pixels = [rng.randrange(2**32) for _ in range(12)]
    w = head(6, 2).put(0, 1)
    image(w, pixels)
    assert argb(webp.decode_vp8l(w.bytes())) == pixels
    # a copy of 6 pixels from 6 before (distance code 120 + 6), then one by the two-dimensional map: straight above
    w = head(6, 3).put(0, 1)
    image(w, None, ops=[("px", p) for p in pixels[:6]] + [("copy", 6, 126), ("copy", 6, 1)])
    assert argb(webp.decode_vp8l(w.bytes())) == pixels[:6] * 3
    place = lambda p: (0x1E35A7BD * p & 0xFFFFFFFF) >> 28
    w = head(3, 1).put(0, 1)
    image(w, None, cache_bits=4, ops=[("px", pixels[0]), ("px", pixels[0]), ("cache", place(pixels[0]))])
    assert argb(webp.decode_vp8l(w.bytes())) == [pixels[0]] * 3


def test_decoder_inverts_subtract_green_and_cross_colour():
    rng = random.Random(1)
    pixels = [rng.randrange(2**32) for _ in range(16)]
    sub = [(p & 0xFF00FF00) | ((p >> 16) - (p >> 8) & 255) << 16 | ((p & 255) - (p >> 8) & 255) for p in pixels]
    w = head(4, 4).put(1, 1).put(webp.SUBTRACT_GREEN, 2).put(0, 1)
    image(w, sub)
    assert argb(webp.decode_vp8l(w.bytes())) == pixels
    s8 = lambda v: (v & 255) - 256 if v & 128 else v & 255
    to_red, to_blue, red_blue = 0x30, 0xE5, 0x91
    moved = []
    for p in pixels:
        g, r, b = s8(p >> 8), p >> 16 & 255, p & 255
        nr = (r - (s8(to_red) * g >> 5)) & 255
        nb = (b - (s8(to_blue) * g >> 5) - (s8(red_blue) * s8(r) >> 5)) & 255
        moved.append((p & 0xFF00FF00) | nr << 16 | nb)
    w = head(4, 4).put(1, 1).put(webp.CROSS_COLOR, 2).put(0, 3)
    image(w, [0xFF000000 | red_blue << 16 | to_blue << 8 | to_red], top=False)
    w.put(0, 1)
    image(w, moved)
    assert argb(webp.decode_vp8l(w.bytes())) == pixels


@pytest.mark.parametrize("mode", range(14))
def test_decoder_inverts_predictors(mode):
    rng = random.Random(mode)
    width, height = 6, 5
    pixels = [rng.randrange(2**32) for _ in range(width * height)]
    minus = lambda a, b: sum((((a >> s) & 255) - ((b >> s) & 255) & 255) << s for s in (0, 8, 16, 24))
    left = []
    for i, p in enumerate(pixels):
        y, x = divmod(i, width)
        if not y:
            guess = pixels[i - 1] if x else 0xFF000000
        elif not x:
            guess = pixels[i - width]
        else:
            guess = webp.predict(mode, pixels[i - 1], pixels[i - width], pixels[i - width + 1], pixels[i - width - 1])
        left.append(minus(p, guess))
    w = head(width, height).put(1, 1).put(webp.PREDICTOR, 2).put(1, 3)
    image(w, [0xFF000000 | mode << 8], top=False)
    w.put(0, 1)
    image(w, left)
    assert argb(webp.decode_vp8l(w.bytes())) == pixels


def test_predictors_by_hand():
    f = lambda m: webp.predict(m, 0x10203040, 0x20304050, 0x40506070, 0x08182838)
    assert [f(m) for m in (0, 1, 2, 3, 4)] == [0xFF000000, 0x10203040, 0x20304050, 0x40506070, 0x08182838]
    assert f(7) == 0x18283848 and f(12) == 0x28384858
    assert webp.predict(13, 0x10101010, 0x30303030, 0, 0x10101010) == 0x28282828


@pytest.mark.parametrize("n", [2, 3, 9, 40])
def test_decoder_reads_palettes(n):
    rng = random.Random(n)
    palette = [rng.randrange(2**32) for _ in range(n)]
    index = [[rng.randrange(n) for _ in range(7)] for _ in range(3)]
    bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    each = 8 >> bits
    packed = []
    for row in index:
        for x in range(0, 7, 1 << bits):
            packed.append(0xFF000000 | sum(v << (k * each) for k, v in enumerate(row[x : x + (1 << bits)])) << 8)
    minus = lambda a, b: sum((((a >> s) & 255) - ((b >> s) & 255) & 255) << s for s in (0, 8, 16, 24))
    w = head(7, 3).put(1, 1).put(webp.COLOR_INDEXING, 2).put(n - 1, 8)
    image(w, [minus(p, palette[i - 1] if i else 0) for i, p in enumerate(palette)], top=False)
    w.put(0, 1)
    image(w, packed)
    assert argb(webp.decode_vp8l(w.bytes())) == [palette[v] for row in index for v in row]


def test_broken_images_raise():
    good = media.store([media.pad(b"hello" * 40)])[0]
    for cut in (0, 5, 20, 25, len(good) - 30):
        with pytest.raises((webp.WebPError, IndexError)):
            webp.decode(good[:cut])
    with pytest.raises(webp.WebPError):
        webp.decode_vp8l(b"\x2e" + b"\0" * 20)


# --- 9

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def plain_spans(text):
    out = []
    for k, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if k == "ip" and any(int(x) > 255 for x in m[0].split(".")) or k == "card" and not (16 <= len(d) <= 19 and luhn(d)) or k == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append(f"{k}:{m.start()}:{m.end()}")
    return out


def test_base_spans_are_those_of_the_patterns(spark):
    rng = random.Random(3)
    parts = ["a@b.c", "x.y+z@d-e.f.g", "@", ".", "-", "_", " ", "+", "(", ")", "1", "23", "4444", "255", "256", "0", "007", "é", "漢", "\U0001f600", "\n", "1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "word"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(1500)] + [None, "", "9" * 40_000, "a" * 40_000, "1." * 20_000, "+1" + "-" * 30_000 + "2"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(pii.find_spans(pii.entities(df)[0], None))
    for d, t in enumerate(texts):
        want = plain_spans(t)
        r = got[d]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest() and r["spans"] == ",".join(want), t
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s.startswith(k) for s in want) for k in PLAIN]


def patterns_of(df):
    return sorted((r["context"], r["kind"]) for r in pii.learn_patterns(df, pii.entities(df)[0])[0].collect())


def test_contexts_find_unseen_identifiers(spark, odd, none):
    rng = random.Random(9)
    rows = [(d, f"{prose(rng, 8)} phone: +1 (20{d % 10}) 555-01{d:02d} {prose(rng, 8)}") for d in range(40)]
    rows += [(100, f"{prose(rng, 5)} phone: 555-019-9123 {prose(rng, 5)}"), (101, f"{prose(rng, 5)} about 12345678 {prose(rng, 5)}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert patterns_of(df) == [("phone:", "phone")]
    got = by_id(pii.pii(df))
    start = rows[40][1].index("555")
    assert got[100]["spans"] == f"phone:{start}:{start + 12}" and got[100]["n_found"] == 1 and got[100]["n_phone"] == 0 and got[100]["n_spans"] == 1
    assert got[101]["spans"] == "" and all(got[d]["n_found"] == 0 and got[d]["n_phone"] == 1 for d in range(40))
    rows = sorted((tuple(r) for r in pii.pii(odd).collect()), key=repr)
    assert rows == sorted(((d, 0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0, 0) for d, *_ in odd_rows()), key=repr)
    assert pii.pii(none).count() == 0


def test_patterns_lead_to_patterns(spark):
    # Keys are known by their shape; "secret key =" is trusted for them, makes "k-1234" and the like known, and these in
    # turn "auth" as a context, which finds an instance that stands nowhere else. A mailbox name is found without a digit
    # pattern of its own, with marks around it left out.
    rng = random.Random(10)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    few = [f"k-{n}" for n in range(1200, 1206)]
    rows = [f'{prose(rng, 6)} secret key = "{x}" {prose(rng, 6)}' for x in [key() + "a1" for _ in range(30)] + few]
    rows += [f"{prose(rng, 6)} auth {x}, {prose(rng, 6)}" for x in few] + [f"{prose(rng, 6)} auth zz-77 {prose(rng, 6)}", f"{prose(rng, 6)} seen zz-78 {prose(rng, 6)}"]
    rows += [f"{prose(rng, 4)} write to: user{i}@mail.example.org {prose(rng, 4)}" for i in range(9)] + [f"{prose(rng, 4)} write to: <user77@localhost> {prose(rng, 4)}"]
    rows += [f"{prose(rng, 4)} the 44{i} and the user{i}@mail.example.org by the sea of the land {prose(rng, 4)}" for i in range(9)]
    rows += [rows[0]] * 50
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    found = patterns_of(df)
    assert ("auth", "secret") in found and ("key =", "secret") in found and ("write to:", "email") in found and not any(c in ("the", "seen") for c, _ in found)
    got = by_id(pii.pii(df))

    def spans(i):
        return [(s.split(":")[0], rows[i][int(s.split(":")[1]) : int(s.split(":")[2])]) for s in got[i]["spans"].split(",") if s]

    assert spans(0)[0][0] == "secret" and len(spans(0)[0][1]) == 42 and got[0]["n_found"] == 1
    assert spans(30) == [("secret", "k-1200")] and spans(36) == [("secret", "k-1200")] and spans(42) == [("secret", "zz-77")] and spans(43) == []
    assert spans(53) == [("email", "user77@localhost")] and all([k for k, _ in spans(i)] == ["email"] for i in range(54, 63))


def test_copies_are_no_support(spark):
    rows = [(d, "alpha beta card 4111 1111 1111 1111 gamma") for d in range(60)] + [(90, "delta card 77-88-99 x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert patterns_of(df) == [] and by_id(pii.pii(df))[90]["spans"] == ""


def test_many_matches_in_one_text(spark):
    text = " ".join(f"u{i}@h.example.com" for i in range(700))
    got = pii.find_spans(pii.entities(spark.createDataFrame([(1, text)], "doc_id long, text string"))[0], None).first()
    assert got["spans"] == ",".join(plain_spans(text)) and got["n_email"] == 700


def test_pii_runs_no_python(spark, docs):
    found, _ = pii.entities(docs)
    patterns, _ = pii.learn_patterns(docs, found)
    for df in (found, patterns, pii.find_spans(found, patterns), pii._base(docs)):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())


# --- 10


def brute_runs(rows, min_words=50):
    """Lines to delete, by doc_id: those of every later copy of any repeated run of min_words words."""
    places, want = defaultdict(set), defaultdict(set)
    for d, t in rows:
        lines = t.split("\n")
        for i in range(len(lines)):
            n = 0
            for j in range(i, len(lines)):
                n += len(words(lines[j]))
                if n >= min_words:
                    places[tuple(lines[i : j + 1])].add((d, i))
    for run, at in places.items():
        for d, i in sorted(at)[1:]:
            want[d].update(range(i, i + len(run)))
    return want


def deleted(spark, rows, parts=6):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return {r["doc_id"]: (set(r["deleted_lines"] or ()), r["text"]) for r in linededup.dedup_lines(df).collect()}


def test_repeated_lines_are_deleted(spark):
    rng = random.Random(11)
    pool = [prose(rng, rng.choice([1, 3, 12, 30, 70]), 10**6) for _ in range(40)]
    rows = [(d, "\n".join(rng.choice(pool) if rng.random() < 0.7 else prose(rng, 9) for _ in range(rng.randrange(1, 14)))) for d in range(60)]
    rows += [(100 + d, rows[d][1]) for d in range(5)] + [(200, "\n".join([pool[0]] * 9)), (201, "Some line\n" * 60), (202, "some line\n" * 60)]
    want, got = brute_runs(rows), deleted(spark, rows)
    for d, t in rows:
        assert got[d] == (want[d], "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[d]))


def test_runs_at_the_ends_of_documents_are_found(spark):
    # Lines of 10 words; a run of 5 to 7 lines ends some documents and goes on in others, among near copies of itself.
    rng = random.Random(12)
    lines = [prose(rng, 10, 10**6) for _ in range(9)]
    rows = []
    for d in range(160):
        n = rng.choice([5, 6, 7])
        run = [lines[i] if rng.random() < 0.97 else lines[8] for i in range(n)]
        head, tail = ([prose(rng, 4, 10**6) for _ in range(rng.randrange(3))] for _ in range(2))
        rows.append((d, "\n".join(head + run + (tail if rng.random() < 0.4 else []))))
    want, got = brute_runs(rows), deleted(spark, rows)
    assert {d: got[d][0] for d in got} == {d: want[d] for d, _ in rows}


def lines_of_suffixes(spark, rows):
    schema = "doc long, fp long, pos int, need int, prefixes array<long>, rank long"
    return linededup._members(spark.createDataFrame(rows, schema).withColumn("reach", F.lit(1)))[0].collect()


@pytest.mark.parametrize("parts", [1, 2, 5, 40])
def test_intervals_are_those_of_ranks_and_common_prefixes(spark, parts):
    # Rows with any fingerprints, whatever texts they stand for: only neighbours by rank may share an interval.
    rng = random.Random(parts)
    rows, rank = [], 0
    for _ in range(60):
        need, base = rng.randrange(1, 4), [rng.randrange(10**9) for _ in range(6)]
        for many in sorted(rng.randrange(1, 6) for _ in range(rng.randrange(1, 9))):
            rows.append((rng.randrange(10**6), 0, len(rows), need, base[:many], rank))
            rank += 1
    order = sorted(rows, key=lambda r: (r[5], *r[:3]))
    rng.shuffle(order)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = lines_of_suffixes(spark, order)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    by = defaultdict(set)
    for r in got:
        by[r["n"], r["start"]].add(r["pos"])
    want = set()
    ordered = sorted(rows, key=lambda r: r[5])
    for i, r in enumerate(ordered):
        for n in range(r[3], r[3] + len(r[4])):
            group, j = {r[2]}, i
            while j + 1 < len(ordered) and ordered[j + 1][3] == r[3] and ordered[j + 1][4][: n - r[3] + 1] == r[4][: n - r[3] + 1]:
                j += 1
                group.add(ordered[j][2])
            j = i
            while j and ordered[j - 1][3] == r[3] and ordered[j - 1][4][: n - r[3] + 1] == r[4][: n - r[3] + 1]:
                j -= 1
                group.add(ordered[j][2])
            if len(group) > 1:
                want.add((n, frozenset(group)))
    assert {(n, frozenset(g)) for (n, _), g in by.items() if len(g) > 1} == want
    # The same prefixes in ranks that are apart make no interval: ranks and neighbours decide, not the fingerprints alone.
    apart = [(1, 0, 0, 1, [5], 0), (2, 0, 1, 1, [6], 1), (3, 0, 2, 1, [5], 2)]
    got = lines_of_suffixes(spark, apart)
    assert len({(r["n"], r["start"]) for r in got}) == len(got)


def test_every_later_copy_of_a_run_is_deleted(spark):
    rng = random.Random(13)
    x, y = prose(rng, 60, 10**6), [prose(rng, 9, 10**6) for _ in range(4)]
    rows = [(0, "\n".join([x, prose(rng, 9, 10**6)])), (1, "\n".join([x, *y])), (2, "\n".join([x, *y])), (3, "\n".join([x, *y[:2], prose(rng, 9, 10**6)]))]
    pool = [prose(rng, rng.choice([0, 1, 3, 12, 30, 70]), 10**6) for _ in range(9)]
    rows += [(10 + d, "\n".join(rng.choice(pool) if rng.random() < 0.9 else prose(rng, 9) for _ in range(rng.randrange(1, 16)))) for d in range(120)]
    rows += [(200 + d, rows[10 + d][1]) for d in range(5)] + [(300, "Some line\n" * 60)]
    want = brute_runs(rows)
    assert want[1] == {0} and want[2] == {0, 1, 2, 3, 4} and want[3] == {0, 1, 2}
    got = deleted(spark, rows)
    assert {d: got[d][0] for d in got} == {d: want[d] for d, _ in rows}


def test_lines_of_odd_rows(spark, odd, none):
    got = linededup.dedup_lines(odd)
    assert got.columns == [*odd.columns, "deleted_lines"] and got.count() == odd.count()
    rows = got.collect()
    assert {r["text"] for r in rows if r["doc_id"] == 4} == {None}
    assert all(not r["deleted_lines"] for r in rows if r["doc_id"] in (4, 5, 6, 9, 10, 11, 12))
    assert [r["deleted_lines"] for r in rows if r["doc_id"] == 13] == [[0, 1, 2, 3]]
    assert linededup.dedup_lines(none).count() == 0
    clash = odd.withColumn("deleted_lines", F.lit("x"))
    assert linededup.dedup_lines(clash).columns == clash.columns and linededup.without_repeated_lines(clash).columns == clash.columns
    left = linededup.without_repeated_lines(clash).collect()
    assert {r["deleted_lines"] for r in left} == {"x"} and sorted((r["doc_id"] or 0) for r in left) == sorted((r["doc_id"] or 0) for r in rows if not (r["deleted_lines"] and r["text"] == ""))


# --- all


def test_queries_are_registered():
    assert sorted(n.split("_")[0] for n in registry.queries()) == sorted(f"op{i}" for i in range(1, 11))


@pytest.mark.parametrize("kind", ["odd", "none"])
def test_stages_take_odd_rows_and_clashing_columns(spark, kind, request):
    import corpus_pipeline as P

    names = ["deleted_lines", "passages", "component_id", "kept", "gone", "side", "left", "right", "item_id", "n_words", "bin_id", "rank", "meta", "x", "y", "n", "w", "h", "k"]
    docs = request.getfixturevalue(kind).withColumns({c: F.lit(c) for c in names}).withColumn("lines", F.lit("z"))
    before = docs.collect()
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        ids = Counter(r["doc_id"] for r in rows)
        assert all(n <= Counter(r["doc_id"] for r in before)[d] for d, n in ids.items())
        assert all(r[c] == c for r in rows for c in names)
        if kind == "none":
            assert not rows
        else:  # null, empty and blank texts always stay, and clean documents too
            assert {4, 5, 6, 9, 10} <= set(ids) and sum(r["text"] is None for r in rows) == 2
        docs = spark.createDataFrame(rows, docs.schema)
    packed = P.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter(d for d, in {(r["doc_id"],) for r in packed}) == Counter({r["doc_id"] for r in docs.collect()})
    assert all((r["bin_id"] is None) == (r["n_words"] == 0) for r in packed)


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 4 <= len(P.STAGES) <= 5
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        assert 0 < len(rows) <= docs.count()
        docs = spark.createDataFrame(rows, docs.schema)
    packed = P.STAGES[-1][1](spark, docs, SF).collect()
    assert sum(r["n_words"] for r in packed) == sum(len(words(r["text"])) for r in docs.collect())
    groups = brute_groups([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert all(d == g for d, _, g in groups)
