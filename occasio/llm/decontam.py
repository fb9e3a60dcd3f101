"""Benchmark decontamination: CGK embedding and bit-sampling LSH over item-sized windows, then exact edit distance.

A document is contaminated by an item of m words if some run of its words is within k = floor(``max_edits`` m) word
edits (insert, delete, replace) of the item. For each item length m the windows are the m words from each place of a
document; at a document's end they are shorter.

1. Only windows that begin with a word of the items of that length, and hold at least m - k such words, are searched.
   The rule is exact: a run within k edits shares at least m - k words with the window that begins at its first
   shared word. Candidates must share as many with their item. Inside a run of one word only so many places at either
   end count as an item can use.
2. The CGK embedding (Chakraborty, Goldenberg and Koucky, 2016) walks over the words, staying or moving on by a random
   bit of (step, word), and writes down the word at each of 3 m steps, which turns edit distance into Hamming distance.
   A table samples ``BITS`` of the steps; equal samples make a candidate pair. Each table has a walk of its own. The
   number of tables is the least that finds ``recall`` of simulated copies with exactly k random edits, each taken from
   its first word that the item has, as the search takes it; tables are added until that is reached.
3. Candidates are verified by the exact edit distance of the item to the best run around the window.

Items are taken in blocks of at most ``BLOCK_ITEMS``, each a pass over the documents, so what a task holds is bounded.
Item ids may be of any type, null too: distinct (item_id, text) rows are items of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._io import bounded, table
from ._text import U64, Words, mix, pieces, words

MAX_EDITS = 0.2
RECALL = 0.97
BITS = 3
MIN_TABLES, MORE_TABLES = 4, 96
BLOCK_ITEMS = 20_000
_PAD = U64(0)


@dataclass(frozen=True)
class LengthIndex:
    """The items of one length."""

    m: int
    k: int
    items: np.ndarray  # (items, m) word fingerprints
    ids: np.ndarray  # their places in the block
    steps: np.ndarray  # (tables, BITS) sampled steps, ascending
    seeds: np.ndarray  # (tables, 3 m) of the walks
    tables: tuple[tuple[np.ndarray, np.ndarray], ...]  # sorted signatures, items


@dataclass(frozen=True)
class Index:
    vocabulary: np.ndarray  # sorted fingerprints of all items' words
    member: np.ndarray  # (lengths, vocabulary): whether an item of that length has the word
    lengths: tuple[LengthIndex, ...]
    repeats: int  # the most often that an item has one word


def signatures(x: np.ndarray, steps: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """(tables, rows) samples of the CGK embeddings of the rows of ``x``, as fingerprints."""
    rows, n = x.shape
    padded = np.hstack([x, np.full((rows, 1), _PAD)]).ravel()
    base = np.arange(rows) * (n + 1)
    at = np.zeros((len(steps), rows), np.int64)
    out = np.zeros((len(steps), rows), U64)
    sampled = [np.flatnonzero((steps == j).any(1)) for j in range(int(steps.max(initial=0)) + 1)]
    for j, tables in enumerate(sampled):
        word = padded[base + at]
        if len(tables):
            out[tables] = mix(out[tables] * U64(0xD6E8FEB86659FD93) + word[tables])
        move = ((word ^ seeds[:, j, None]) * U64(0x9E3779B97F4A7C15)) >> U64(63)
        at = np.minimum(at + move.astype(np.int64), n)
    return out


def edit_distance(items: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Row by row, the least number of word edits between the item and any part of the run (0 pads the run)."""
    rows, width = runs.shape
    place = np.arange(width + 1, dtype=np.int32)
    now = np.zeros((rows, width + 1), np.int32)
    for i in range(items.shape[1]):
        step = np.empty_like(now)
        step[:, 0] = i + 1
        np.minimum(now[:, :-1] + (runs != items[:, i, None]), now[:, 1:] + 1, out=step[:, 1:])
        now = np.minimum.accumulate(step - place, axis=1) + place
    return now.min(axis=1)


def _edited(item: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    x = item.tolist()
    for _ in range(k):
        kind, new = rng.integers(3), int(rng.integers(1, 2**63))
        at = int(rng.integers(len(x) + (kind == 0))) if x or kind == 0 else 0
        if kind == 0:
            x.insert(at, new)
        elif kind == 1 and len(x) > 1:
            del x[at]
        else:
            x[at] = new
    return np.array(x, U64)


def _length_index(m: int, items: np.ndarray, ids: np.ndarray, max_edits: float, recall: float) -> LengthIndex:
    k = int(max_edits * m + 1e-9)
    rng = np.random.default_rng([m, 5])
    steps, seeds = np.zeros((0, BITS), np.int64), np.zeros((0, 3 * m), U64)
    more = lambda n: (np.sort(rng.integers(0, 3 * m, (n, BITS)), axis=1), rng.integers(0, 2**64, (n, 3 * m), dtype=np.uint64))
    if not k:
        steps, seeds = more(1)
    else:
        windows, of = [], []
        for _ in range(300):
            i = int(rng.integers(len(items)))
            copy = _edited(items[i], k, rng)
            shared = np.flatnonzero(np.isin(copy, items[i]))
            if not len(shared):
                continue
            tail = rng.integers(1, 2**63, 2 * m + k, dtype=np.uint64)
            windows.append(np.concatenate([copy[shared[0] :], tail])[:m])
            of.append(i)
        found = np.zeros(len(of), bool)
        share = np.zeros(0)
        while len(of) and (not len(share) or share[-1] < recall):
            new = more(MORE_TABLES)
            steps, seeds = np.concatenate([steps, new[0]]), np.concatenate([seeds, new[1]])
            same = signatures(np.array(windows), *new) == signatures(items[of], *new)
            upto = np.logical_or.accumulate(same, axis=0) | found
            found, share = upto[-1], np.concatenate([share, upto.mean(axis=1)])
        n_tables = max(MIN_TABLES, int(np.searchsorted(share, recall)) + 1)
        steps, seeds = steps[:n_tables], seeds[:n_tables]
    tables = []
    for s in signatures(items, steps, seeds):
        order = np.argsort(s, kind="stable")
        tables.append((s[order], order))
    return LengthIndex(m, k, items, ids, steps, seeds, tuple(tables))


def build_index(texts: list[str | None], max_edits: float = MAX_EDITS, recall: float = RECALL) -> Index:
    """Items without words (null, empty, blank) are left out. Items are known by their places in ``texts``."""
    w = words(pa.array([t or "" for t in texts], pa.string()))
    by: dict[int, list[int]] = {}
    for i, n in enumerate(np.diff(w.bounds).tolist()):
        if n:
            by.setdefault(n, []).append(i)
    ids = np.arange(len(texts))
    lengths = tuple(_length_index(m, np.stack([w.hashes[w.bounds[i] : w.bounds[i + 1]] for i in by[m]]), ids[by[m]], max_edits, recall) for m in sorted(by))
    vocabulary = np.unique(w.hashes)
    member = np.zeros((len(lengths), len(vocabulary)), bool)
    for c, x in enumerate(lengths):
        member[c, np.searchsorted(vocabulary, np.unique(x.items))] = True
    repeats = max((int(np.unique(row, return_counts=True)[1].max()) for x in lengths for row in x.items), default=1)
    return Index(vocabulary, member, lengths, repeats)


def find(w: Words, index: Index) -> list[tuple[int, int, int, int]]:
    """(document, item, edits, first word) of each contamination in one piece: the nearest, then first, run."""
    h, total = w.hashes, len(w.hashes)
    if not total or not len(index.vocabulary):
        return []
    may = np.zeros(1 << 18, bool)
    may[(index.vocabulary >> U64(46)).astype(np.int64)] = True
    hit = np.flatnonzero(may[(h >> U64(46)).astype(np.int64)])
    at = np.minimum(np.searchsorted(index.vocabulary, h[hit]), len(index.vocabulary) - 1)
    ok = index.vocabulary[at] == h[hit]
    hit, at = hit[ok], at[ok]
    if not len(hit):
        return []
    new = np.ones(total + 1, bool)  # where runs of one word begin
    new[1:total] = h[1:] != h[:-1]
    new[w.bounds] = True
    edge = np.flatnonzero(new)
    long = np.diff(edge) > 2 * index.repeats
    if long.any():
        inner = np.zeros(total + 1, np.int8)
        np.add.at(inner, edge[:-1][long] + index.repeats, 1)
        np.add.at(inner, edge[1:][long] - index.repeats, -1)
        keep = np.cumsum(inner)[hit] == 0
        hit, at = hit[keep], at[keep]
    doc_end = np.repeat(w.bounds[1:], np.diff(w.bounds))
    doc_start = np.repeat(w.bounds[:-1], np.diff(w.bounds))
    padded = np.concatenate([h, np.zeros(4, U64)])
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for c, x in enumerate(index.lengths):
        held = hit[index.member[c, at]]
        need = x.m - x.k
        if len(held) < need:
            continue
        first, last = held[: len(held) - need + 1], held[need - 1 :]
        starts = first[(last - first < x.m) & (last < doc_end[first])]
        for lo in range(0, len(starts), 20_000):
            some = starts[lo : lo + 20_000]
            where = some[:, None] + np.arange(x.m)
            window = np.where(where < doc_end[some, None], padded[np.minimum(where, total)], _PAD)
            pairs = set()
            for s, (sorted_, order) in zip(signatures(window, x.steps, x.seeds), x.tables):
                a, b = np.searchsorted(sorted_, s, "left"), np.searchsorted(sorted_, s, "right")
                for r in np.flatnonzero(b > a).tolist():
                    pairs.update((r, int(i)) for i in order[a[r] : b[r]])
            if not pairs:
                continue
            r, item = np.array(sorted(pairs)).T
            shared = np.concatenate([(window[r[p : p + 1024], :, None] == x.items[item[p : p + 1024], None, :]).any(2).sum(1) for p in range(0, len(r), 1024)])
            r, item = r[shared >= need], item[shared >= need]
            order = np.lexsort((r, item))
            verify, before = [], (-1, 0)
            for q in order.tolist():  # a run of k + 1 places is verified once: its part reaches as far
                if item[q] != before[0] or some[r[q]] > before[1] + x.k:
                    verify.append(q)
                    before = (item[q], some[r[q]])
            r, item = r[verify], item[verify]
            first = some[r]
            where = first[:, None] + np.arange(-x.k, x.m + 2 * x.k)
            inside = (where >= doc_start[first, None]) & (where < doc_end[first, None])
            for p in range(0, len(r), 4096):
                part = slice(p, p + 4096)
                runs = np.where(inside[part], padded[np.clip(where[part], 0, total)], _PAD)
                for f, i, d in zip(first[part].tolist(), item[part].tolist(), edit_distance(x.items[item[part]], runs).tolist()):
                    if d <= x.k:
                        key = (int(np.searchsorted(w.bounds, f, "right")) - 1, int(x.ids[i]))
                        new = (d, f - int(doc_start[f]))
                        if key not in best or new < best[key]:
                            best[key] = new
    return [(doc, item, d, f) for (doc, item), (d, f) in sorted(best.items())]


def _item_blocks(items: DataFrame) -> Iterator[tuple[pa.Array, list[str]]]:
    """The ids and texts of the distinct items, BLOCK_ITEMS at a time."""
    kind = to_arrow_type(items.schema["item_id"].dataType)
    rows = items.select(F.col("item_id").alias("i"), F.col("text").cast("string").alias("t")).where("t is not null").dropDuplicates().orderBy("i", "t")
    ids, texts = [], []
    for r in rows.toLocalIterator():
        ids.append(r["i"])
        texts.append(r["t"])
        if len(ids) == BLOCK_ITEMS:
            yield pa.array(ids, kind), texts
            ids, texts = [], []
    if ids:
        yield pa.array(ids, kind), texts


def contaminated(docs: DataFrame, items: DataFrame, max_edits: float = MAX_EDITS, recall: float = RECALL) -> DataFrame:
    """doc_id, item_id, n_edits (of the nearest run), first_word (of it), item_words: one row for each document and item
    that contaminates it.

    Documents or items without words (null, empty, blank) match nothing. Rows with a null doc_id or a null item_id count
    like others; repeated rows each match; two texts under one item_id are two items, the same text twice is one. Other
    columns do not matter, an empty table gives no rows, and texts are searched whole, however long. Narrow: no shuffle of
    the documents.
    """
    spark = docs.sparkSession
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = f"doc_id long, item_id {items.schema['item_id'].dataType.simpleString()}, n_edits long, first_word long, item_words long"
    names = ["doc_id", "item_id", "n_edits", "first_word", "item_words"]
    parts = []
    for ids, texts in _item_blocks(items):
        index = build_index(texts, max_edits, recall)
        size = {int(i): x.m for x in index.lengths for i in x.ids}

        def run(batches: Iterator[pa.RecordBatch], index: Index = index, size: dict[int, int] = size, ids: pa.Array = ids) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch):
                    got = find(words(part.column(1)), index)
                    if got:
                        doc, item, d, f = (list(c) for c in zip(*got))
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), ids.take(pa.array(item)), *(pa.array(c, pa.int64()) for c in (d, f, [size[i] for i in item]))], names=names)

        parts.append(rows.mapInArrow(run, schema))
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)


def keep_uncontaminated(docs: DataFrame, items: DataFrame, max_edits: float = MAX_EDITS, recall: float = RECALL) -> DataFrame:
    """The rows, with all their columns, that no item contaminates (see :func:`contaminated`); those without words stay."""
    column = docs.columns.index("text")
    out = bounded(docs)
    for _, texts in _item_blocks(items):
        index = build_index(texts, max_edits, recall)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch, batch.schema.names[column]):
                    keep = np.ones(part.num_rows, bool)
                    keep[[x[0] for x in find(words(part.column(column)), index)]] = False
                    yield part.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
