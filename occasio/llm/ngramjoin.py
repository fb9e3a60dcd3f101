"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document's set holds the fingerprints of its distinct 5-word shingles (64 bits). Two sets link when 100 times their
common shingles are at least 80 times their union.

Shingles have one global order: estimated frequency, then fingerprint. Frequencies come from a count sketch of fixed
size over all documents, so only shingles that stand out of its noise are late in the order. A set of n shingles has
in common with a set that it links to at least c = ceil(0.8 n) shingles, so if both keep their first n - c + l
shingles, they share l of those. Each document takes its own l (Wang, Li and Feng, 2012): a longer prefix is more
postings, but asks for more shared ones before a pair is verified; l is the one with the least postings plus estimated
candidates times the cost of a verification, from n / 16 up.

A pair of known sizes asks for more: with the overlap o = ceil(0.8 (n + m) / 1.8), the first n - o + l shingles of one
and m - o + l of the other share l. Partners are therefore taken by ranges of size: in a list, a class stands only for
those ranges of which its place in the class's order is early enough.

Copies and near copies, in groups of any size, make no quadratic work:

* sets are classes: documents with equal sets are one class, and a task sends a class once;
* for each range of partner sizes a class is dropped if it shares too few postings with whatever partner, and lists
  with one class left go;
* in each posting list every class meets only the list's hub at first, the class whose prefix is the most common, so
  the likely original of a group; classes that share enough postings with their best hub are verified against it, and
  links make components;
* candidates then come only from lists with several components, and classes that share too little in such lists are
  dropped again; a pair needs a shingle in common among the first n - o + 1 and m - o + 1, and l in its prefixes, to be
  verified, and all that qualify are verified.

A pair that is never verified is thus one within a component, or one that shares too few postings to link. Posting
lists that the sketch shows to be long are dealt over several tasks by class when they are first gathered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._graph import components
from ._io import bounded, drop, materialize, table
from ._text import U64, mix, pieces, shingle_sets, words
from ._tree import bloom, may_hold, merged

WORDS = 5
PERCENT = 80
CELL_BITS = 20
VERIFY_COST = 32.0
BASE_PARTNERS = 0.25
LIST_ROWS = 1024
MAX_SALT = 1 << 16
SALTS = 8
BROADCAST_PAIRS = 1 << 20  # of 16 bytes; more are shuffled


def needed(n: int, percent: int = PERCENT) -> int:
    """The least overlap with any set that a set of n shingles links to."""
    return -(-percent * n // 100)


def least_l(n: int) -> int:
    """The least number of shared prefix shingles that a set of n asks for; it never falls as n grows."""
    return max(1, n // 16)


def class_of(x: np.ndarray) -> int:
    """A fingerprint of a set of shingles, never that of the empty set."""
    return int((mix(x).sum(dtype=np.uint64) ^ mix(np.array([len(x)], U64))[0]).view(np.int64))


def choose(n: int, estimates: np.ndarray, percent: int = PERCENT) -> int:
    """How many shared prefix shingles a set of n asks for; ``estimates``: its shingles' partners, in global order."""
    p = n - needed(n, percent)
    most = max(1, min(n // 5, needed(n, percent)))
    l = np.unique(np.minimum(least_l(n) * 2 ** np.arange(4), most))  # noqa: E741
    cost = (p + l) + VERIFY_COST * (BASE_PARTNERS * (p + l) + np.cumsum(estimates)[p + l - 1]) / l
    return int(l[int(np.argmin(cost))])


def _sets(part: pa.RecordBatch, column: int) -> list[np.ndarray]:
    return shingle_sets(words(part.column(column)), WORDS)


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, cls, n_shingles, fp) of every row of (doc_id, text, fp); cls is null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                sets = _sets(part, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([class_of(x) if len(x) else None for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), part.column(2)], names=["doc_id", "cls", "n_shingles", "fp"])

    return docs.mapInArrow(run, "doc_id long, cls long, n_shingles long, fp long")


def frequency_sketch(docs: DataFrame) -> np.ndarray:
    """For each of 2**CELL_BITS cells of fingerprints, by how much its count stands out of the noise (else 0)."""

    def gather(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out, seen = np.zeros(1 << CELL_BITS, np.int64), set()
        for batch in batches:
            for part in pieces(batch):
                new = []
                for x in _sets(part, 1):
                    c = class_of(x)
                    if c not in seen:
                        seen.add(c)
                        new.append(x)
                if new:
                    np.add(out, np.bincount((np.concatenate(new) >> U64(64 - CELL_BITS)).astype(np.int64), minlength=1 << CELL_BITS), out=out)
        return out

    cells = merged(docs, gather, 1 << CELL_BITS, np.int64, sent=np.int32)
    usual = float(np.median(cells))
    over = cells - usual - 3 * np.sqrt(usual) - 2
    return np.where(over > 0, cells - usual, 0).astype(np.float32)


def postings(docs: DataFrame, sketch: np.ndarray, percent: int) -> DataFrame:
    """(tp, salt, cls) for the prefix of every class, and a row (meta, -1, cls) of the class; once from a task.

    tp: 48 bits of the shingle's fingerprint, and its place in the class's own order (from 0, at most 2**16 - 1). Lists
    of shingles that agree in 48 bits are one list: that adds candidates and loses none, and so does an earlier place.
    meta: how many in a thousand of the prefix do not stand out in the sketch, n, and l; so by meta, sets whose prefix
    is common come first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in pieces(batch):
                tp, salts, cls = [], [], []
                for x in _sets(part, 1):
                    c, n = class_of(x), len(x)
                    if not n or c in seen:
                        continue
                    seen.add(c)
                    e = sketch[(x >> U64(64 - CELL_BITS)).astype(np.int64)]
                    order = np.argsort(e, kind="stable") if e.any() else None  # x ascends: ties are by fingerprint
                    x, e = (x[order], e[order]) if order is not None else (x, e)
                    l = choose(n, e, percent)  # noqa: E741
                    keep = n - needed(n, percent) + l
                    tp.append((x[:keep] & ~U64(0xFFFF) | np.minimum(np.arange(keep), 0xFFFF).astype(U64)).view(np.int64))
                    k = np.minimum(1 + (e[:keep] / LIST_ROWS).astype(np.int64), MAX_SALT)
                    salts.append(np.where(k > 1, 1 + (c & 0x7FFFFFFF) % k, 0))
                    tp.append(np.array([int((e[:keep] == 0).mean() * 1000) << 52 | n << 24 | l]))
                    salts.append(np.array([-1]))
                    cls.append(np.full(keep + 1, c))
                if tp:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tp)), pa.array(np.concatenate(salts).astype(np.int32)), pa.array(np.concatenate(cls))], names=["tp", "salt", "cls"])

    return docs.mapInArrow(run, LISTED)


LISTED = "tp long, salt int, cls long"


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tp in batches that end with a list (rows of a shingle); salted lists may be cut."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.concat_batches([held, batch])
        tp, salt = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cut = batch.num_rows
        if salt[-1] == 0:
            other = np.flatnonzero(tp >> 16 != tp[-1] >> 16)
            cut = int(other[-1]) + 1 if len(other) else 0
        held = batch.slice(cut) if cut < batch.num_rows else None
        if cut:
            yield batch.slice(0, cut)
    if held is not None:
        yield held


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (tp, cls): those of lists with two classes or a salt, each class once a list; all of classes."""

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_lists(batches):
            tp, salt, cls = (c.to_numpy() for c in batch.columns)
            once = np.concatenate(([True], (tp[1:] != tp[:-1]) | (cls[1:] != cls[:-1])))
            tp, salt, cls = tp[once], salt[once], cls[once]
            same = tp[1:] >> 16 == tp[:-1] >> 16
            keep = salt > 0
            keep[1:] |= same
            keep[:-1] |= same
            yield pa.RecordBatch.from_arrays([pa.array(tp[keep]), pa.array(salt[keep]), pa.array(cls[keep])], names=batch.schema.names)

    of_classes: list[pa.RecordBatch] = []

    def apart() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            is_class = pa.array(batch.column(1).to_numpy() < 0)
            of_classes.append(batch.filter(is_class))
            yield batch.filter(pa.compute.invert(is_class))

    for batch in several(apart()):
        yield from of_classes
        of_classes.clear()
        yield batch
    yield from of_classes


def _by_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (tp, salt, cls, meta, own, ranges, firsts) sorted by (tp, cls): (token, low, high, meta, cls, place) for
    each range that the place is early enough for, without lists that hold one class, or one side's sizes, alone."""
    for batch in _whole_lists(batches):
        tp, salt, cls, meta, own = (batch.column(i).to_numpy() for i in range(5))
        row = np.repeat(np.arange(len(tp)), batch.column(5).value_lengths().to_numpy())
        r, first = batch.column(5).flatten().to_numpy(), batch.column(6).flatten().to_numpy()
        place = tp & 0xFFFF
        early = place[row] < first
        row, r = row[early], r[early]
        low, high = np.minimum(own[row], r), np.maximum(own[row], r)
        token = tp[row] >> 16
        order = np.lexsort((cls[row], high, low, token))
        row, low, high, token = row[order], low[order], high[order], token[order]
        if not len(row):
            continue
        new = np.concatenate(([True], (token[1:] != token[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
        at = np.flatnonzero(new)
        c, o = cls[row], own[row]
        several = np.minimum.reduceat(c, at) < np.maximum.reduceat(c, at)
        several &= (low[at] == high[at]) | (np.minimum.reduceat(o, at) < np.maximum.reduceat(o, at))
        keep = np.repeat(several, np.diff(np.append(at, len(row)))) | (salt[row] > 0)
        row = row[keep]
        columns = (token[keep], low[keep].astype(np.int32), high[keep].astype(np.int32), meta[row], cls[row], place[row].astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["token", "low", "high", "meta", "cls", "place"])


def _blobs(docs: DataFrame, left: np.ndarray, right: np.ndarray) -> DataFrame:
    """(cls, left, right, x) of the documents that a filter may hold: the class, which filters, and the upper 48 bits of
    its sorted shingles: that two sets of a thousand agree there by chance in one more shingle has a chance of 4e-9."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy()
            sides = [may_hold(f, ids) for f in (left, right)]
            some = pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(x) for x in sides)], names=["doc_id", "text", "left", "right"]).filter(pa.array(sides[0] | sides[1]))
            for piece in pieces(some):
                got = [(class_of(x), np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes(), i) for i, x in enumerate(_sets(piece, 1)) if len(x)]
                got = [(c, b, i) for c, b, i in got if not (c in seen or seen.add(c))]
                at = pa.array([i for _, _, i in got], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _, _ in got], pa.int64()), piece.column(2).take(at), piece.column(3).take(at), pa.array([b for _, b, _ in got], pa.binary())], names=["cls", "left", "right", "x"])

    return docs.mapInArrow(run, "cls long, left boolean, right boolean, x binary")


def _six(x: pa.BinaryScalar) -> np.ndarray:
    six = np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view("<u8").ravel()


def _overlaps(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = _six(x), _six(y)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            keep.append(100 * common >= percent * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verify(pairs: DataFrame, docs: DataFrame, heads: DataFrame, percent: int, tag: str) -> tuple[DataFrame, list[str]]:
    """The pairs (a, b) of classes that link. ``heads``: (cls, doc_id) of a document of each class."""
    pairs, pairs_path = materialize(pairs, f"{tag}-pairs")
    used = pairs.select(F.col("a").alias("cls"), F.lit(1).alias("side")).union(pairs.select("b", F.lit(2))).groupBy("cls").agg(F.bit_or("side").alias("side"))
    holders, holders_path = materialize(heads.join(used, "cls").select("doc_id", "side"), f"{tag}-holders")
    filters = [bloom(holders.where(F.col("side").bitwiseAND(F.lit(side)) > 0).select("doc_id")) for side in (1, 2)]
    sets, sets_path = materialize(_blobs(docs, *filters), f"{tag}-sets")
    small = F.broadcast(pairs) if pairs.count() <= BROADCAST_PAIRS else pairs
    left = small.join(sets.where("left").select(F.col("cls").alias("a"), "x"), "a")
    both = left.join(sets.where("right").select(F.col("cls").alias("b"), F.col("x").alias("y")), "b").select("a", "b", "x", "y")
    links, path = materialize(both.mapInArrow(lambda batches: _overlaps(batches, percent), "a long, b long").distinct(), f"{tag}-verified")
    drop(docs.sparkSession, pairs_path, holders_path, sets_path)
    return links, [path]


def _n(c: str) -> Column:
    return F.shiftright(F.col(c), 24).bitwiseAND(F.lit((1 << 28) - 1))


def _l(c: str) -> Column:
    return F.col(c).bitwiseAND(F.lit((1 << 24) - 1))


def _up(x: Column, by: int) -> Column:
    """ceil(x / by) of longs."""
    return F.call_function("div", x + (by - 1), F.lit(by))


def _overlap(n: Column, m: Column, percent: int) -> Column:
    """The least overlap of sets of n and m that link."""
    return _up((n + m) * percent, 100 + percent)


def _enough(n: Column, m: Column, l: Column, percent: int) -> Column:  # noqa: E741
    """Whether a class of n, with its listed ``places``, can link with a partner of m or more: of the first
    n - o(n, m) + q shingles at least q must be listed, for q from 1 to the least l of the two (by powers of 2), so the
    q-th of the ascending ``places`` is one of those."""
    most = F.least(l, F.greatest(F.lit(1), F.floor(m / 16))).cast("int")
    levels = F.concat(F.filter(F.array(*[F.lit(1 << i) for i in range(24)]), lambda q: q < most), F.array(most))
    before = (n - _overlap(n, m, percent)).cast("int")
    return F.forall(levels, lambda q: F.coalesce(F.get("places", q - 1) < before + q, F.lit(False)))


def _between(rows: DataFrame, percent: int, tag: str) -> tuple[DataFrame, list[str]]:
    """Rows (token, low, high, meta, cls, place, comp) of lists with two components, of classes that can link with
    another component by what such lists hold, given the least size in them; and the table they are read from."""
    span = ["token", "low", "high"]
    mixed = rows.groupBy(*span).agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min(_n("meta")).alias("least")).where("c0 < c1").select(*span, "least")
    here, path = materialize(rows.join(mixed, span), tag)
    able = here.groupBy("cls", "low", "high").agg(F.first("meta").alias("meta"), F.min("least").alias("least"), F.sort_array(F.collect_list("place")).alias("places"))
    n = _n("meta")
    able = able.where(_enough(n, F.greatest(F.col("least"), _up(n * percent, 100)), _l("meta"), percent)).select("cls", "low", "high")
    return here.drop("least").join(able, ["cls", "low", "high"], "left_semi"), [path]


def _live(raw: DataFrame, percent: int) -> DataFrame:
    """(token, low, high, meta, cls, place): the lists by ranges of the lesser and the greater size, without classes
    that can link with none in the other range.

    Ranges grow by a tenth. A class of n stands in a list for a range that begins at m if its place is before
    n - o(n, m) + l, and for the range at all if enough of its listed shingles do (:func:`_enough`).
    """
    width = math.log(1.1)
    of = lambda n: F.floor(F.log(n.cast("double")) / width).cast("int")
    n, l = _n("meta"), _l("meta")  # noqa: E741
    smallest = _up(n * percent, 100)
    ranges = F.sequence(of(smallest), of(F.floor(n * 100 / percent)))
    lists = raw.where("salt >= 0")
    place = F.col("tp").bitwiseAND(F.lit(0xFFFF)).cast("int")
    classes_ = lists.groupBy("cls").agg(F.sort_array(F.collect_list(place)).alias("places"))
    classes_ = classes_.join(raw.where("salt < 0").groupBy("cls").agg(F.first("tp").alias("meta")), "cls")

    def bound(r: Column) -> Column:
        m = F.greatest(smallest, F.ceil(F.exp(r * width) - 1e-6).cast("long"))
        return F.struct(r.alias("r"), (n - _overlap(n, m, percent) + l).cast("int").alias("first"), _enough(n, m, l, percent).alias("ok"))

    able = classes_.select("cls", "meta", of(n).alias("own"), F.filter(F.transform(ranges, bound), lambda x: x["ok"]).alias("x")).where("size(x) > 0")
    rows = lists.join(able.select("cls", "meta", "own", F.col("x.r").alias("ranges"), F.col("x.first").alias("firsts")), "cls")
    rows = rows.select("tp", "salt", "cls", "meta", "own", "ranges", "firsts").repartition(F.shiftright("tp", 16), "salt").sortWithinPartitions("tp", "cls")
    return rows.mapInArrow(_by_ranges, "token long, low int, high int, meta long, cls long, place int")


def ngram_join(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, list[str]]:
    """Documents with their classes, and (cls, label) of the classes that have links; and the tables they read."""
    spark = docs.sparkSession
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    of, of_path = materialize(classes(rows.withColumn("fp", F.xxhash64(F.coalesce("text", F.lit(""))))), "join-classes")
    # One row a class before any join, so that a class of a third of all documents is no hot key.
    heads, heads_path = materialize(of.where("cls is not null").groupBy("cls").agg(F.min(F.coalesce("doc_id", F.lit(0))).alias("doc_id")), "join-heads")
    sketch = frequency_sketch(rows)
    dealt = postings(rows, sketch, percent).repartition(F.when(F.col("salt") < 0, F.col("cls")).otherwise(F.shiftright("tp", 16)), "salt").sortWithinPartitions("tp", "cls")
    raw, raw_path = materialize(dealt.mapInArrow(_lists, LISTED), "join-lists")
    lists, lists_path = materialize(_live(raw, percent), "join-live")
    drop(spark, raw_path)
    span = ["token", "low", "high"]
    hubs = lists.groupBy(*span).agg(F.min(F.struct("meta", "cls"))["cls"].alias("hub"))
    best = lists.join(hubs, span).where("cls <> hub").groupBy("cls", "hub").agg(F.count("*").alias("k"), F.first("meta").alias("meta"))
    best = best.groupBy("cls").agg(F.max(F.struct("k", "hub")).alias("m"), F.first("meta").alias("meta"))
    stars = best.where(F.col("m.k") >= _l("meta") / 2).select(F.col("cls").alias("a"), F.col("m.hub").alias("b"))
    first, first_paths = verify(stars, rows, heads, percent, "join-star")
    labels, labels_path = components(first, "join-star")
    # Between components: lists whose classes are in more than one.
    named = lists.join(labels.select(F.col("node").alias("cls"), F.col("label").alias("comp")), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    # Lists of the same classes, as the shingles of one passage have, are taken once, with a class's earliest place.
    named, named_path = materialize(named, "join-named")
    once, once_paths = _between(named, percent, "join-between")
    once, once_path = materialize(once, "join-between")
    drop(spark, named_path, *once_paths)
    named, twice_paths = _between(once, percent, "join-between")
    sets = named.groupBy(*span).agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y"))
    key = ["low", "high", "size", "x", "y"]
    named = named.join(sets, span).groupBy(*key, "cls").agg(F.first("meta").alias("meta"), F.first("comp").alias("comp"), F.min("place").alias("place"))
    named, named_path = materialize(named, "join-mixed")
    drop(spark, once_path, *twice_paths)
    sides = [named.select(*key, *[F.col(c).alias(f"{c}_{s}") for c in ("cls", "meta", "comp", "place")]) for s in "ab"]
    n, m = _n("meta_a"), _n("meta_b")
    spare = 1 - _overlap(n, m, percent)
    pair = (F.col("cls_a") < F.col("cls_b")) & (F.col("comp_a") != F.col("comp_b")) & (F.greatest(n, m) * percent <= F.least(n, m) * 100)
    early = (F.col("place_a") < n + spare) & (F.col("place_b") < m + spare)
    pairs = sides[0].join(sides[1], key).where(pair & early).select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).distinct()
    # A pair that shares one early shingle must share as many as the lesser l asks for.
    prefix = lists.select("cls", "token", "meta").distinct().groupBy("cls").agg(F.first("meta").alias("meta"), F.collect_list("token").alias("tokens"))
    x, y = (prefix.select(F.col("cls").alias(s), F.col("meta").alias(f"meta_{s}"), F.col("tokens").alias(f"tokens_{s}")) for s in "ab")
    more = pairs.join(x, "a").join(y, "b").where(F.size(F.array_intersect("tokens_a", "tokens_b")) >= F.least(_l("meta_a"), _l("meta_b"))).select("a", "b")
    second, second_paths = verify(more, rows, heads, percent, "join-rest")
    final, final_path = components(first.union(second).distinct(), "join")
    drop(spark, heads_path, lists_path, named_path, labels_path, *first_paths, *second_paths)
    return of, final.select(F.col("node").alias("cls"), "label"), [of_path, final_path]


def near_duplicate_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, cls, component_id of every row.

    ``component_id`` is the least doc_id that links reach. Documents without words (null, empty, blank) have no
    shingles and are alone. Repeated rows share a class. A null doc_id counts for no component's least.
    """
    of, labels, _ = ngram_join(docs, percent)
    least = of.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least")).join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    component = least.groupBy("label").agg(F.min("least").alias("component_id"))
    # Documents of one class are dealt over SALTS tasks.
    named = least.join(component, "label").select("cls", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = of.withColumn("salt", F.pmod(F.xxhash64("doc_id", "fp", F.lit(1)), F.lit(SALTS)).cast("int"))
    return salted.join(named, ["cls", "salt"], "left").select("doc_id", "n_shingles", "cls", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_of_each_group(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows, with all their columns, less all but one of each group of near duplicates.

    The row with the least doc_id stays (a null one only in a group without others). Rows without words all stay.
    """
    of, labels, _ = ngram_join(docs, percent)
    doc = F.coalesce("doc_id", F.lit(2**63 - 1))
    first = of.where("cls is not null").groupBy("cls").agg(F.min(F.struct(doc.alias("doc"), F.col("fp"))).alias("least"))
    first = first.join(labels, "cls", "left").groupBy(F.coalesce("label", "cls").alias("label")).agg(F.min("least").alias("least"))
    rows = of.groupBy(doc.alias("doc"), "fp").agg(F.count("*").alias("n"), F.first("cls").isNull().alias("empty"))
    stay = rows.join(first.select("least.doc", "least.fp", F.lit(True).alias("chosen")), ["doc", "fp"], "left").where("empty or chosen").withColumn("n", F.when(F.col("empty"), 1).otherwise(F.col("n")))
    stay, _ = materialize(stay.select("doc", "fp", "n"), "join-stay")
    names = docs.columns
    keyed = docs.select(F.struct(*names).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("fp"))
    once = keyed.join(stay.where("n = 1").hint("shuffle_hash"), ["doc", "fp"], "left_semi")
    more = stay.where("n > 1")
    if not more.isEmpty():  # repeated rows of one doc_id and text
        once = once.unionByName(keyed.join(more, ["doc", "fp"], "left_semi").groupBy("doc", "fp").agg(F.first("row").alias("row")).select("row", "doc", "fp"))
    return once.select("row.*")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
