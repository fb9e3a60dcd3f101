"""Best-fit packing of documents into training sequences, under conflicts.

A document longer than a sequence is cut into full sequences and a rest (no text is lost); rests and shorter
documents are packed, longest first. Open bins stand in the order of their room left. A piece goes to the tightest bin
that holds it and has no conflict: the search starts at the bin with just enough room (its successor in the order)
and goes on until a bin is found whose bitmaps hold neither the piece's source (``max_per_source`` pieces of a source
are allowed in a bin) nor its duplicate cluster. Without one, a new bin opens.

Rows are dealt by the hash of doc_id and text into blocks of about ``block_rows`` rows, each packed alone, so no source
or cluster gathers in one task; a block that repeated rows make larger is packed in parts of as many rows, so memory is
bounded. Bins are as full as those of one global packing but
for at most the last open bins of each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import bounded, table
from ._text import pieces, words

CAPACITY = 2048
BLOCK_ROWS = 8192
SCHEMA = "doc_id long, piece long, bin_id string, bin_offset long, first_word long, n_words long, source string, cluster long, bin_words long"


class Bins:
    """Open bins by room left, with a count of each source and a bitmap of duplicate clusters."""

    def __init__(self, capacity: int, n_sources: int, n_clusters: int, max_per_source: int, size: int = 1024):
        self.capacity, self.most = capacity, max_per_source
        self.room = np.zeros(0, np.int64)  # ascending
        self.id = np.zeros(0, np.int64)
        self.full = np.zeros((-(-n_sources // 64) or 1, size), np.uint64)  # by source word, bin: no more of the source
        self.held = np.zeros((-(-n_clusters // 64) or 1, size), np.uint64)  # by cluster word, bin
        self.count: dict[tuple[int, int], int] = {}
        self.n = 0

    def place(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """The bin and the offset in it. ``cluster`` below 0: no other piece of the block is in its cluster."""
        at = int(np.searchsorted(self.room, length))
        one = np.uint64(1)
        step = 64
        found = -1
        while at < len(self.room):
            ids = self.id[at : at + step]
            free = (self.full[source >> 6, ids] >> np.uint64(source & 63)) & one == 0
            if cluster >= 0:
                free &= (self.held[cluster >> 6, ids] >> np.uint64(cluster & 63)) & one == 0
            k = int(free.argmax())
            if free[k]:
                found = at + k
                break
            at += step
            step *= 4
        if found < 0:
            bin_id, room = self.n, self.capacity
            self.n += 1
            if self.n > self.full.shape[1]:
                self.full = np.pad(self.full, ((0, 0), (0, self.full.shape[1])))
                self.held = np.pad(self.held, ((0, 0), (0, self.held.shape[1])))
        else:
            bin_id, room = int(self.id[found]), int(self.room[found])
        n = self.count[source, bin_id] = self.count.get((source, bin_id), 0) + 1
        if n >= self.most:
            self.full[source >> 6, bin_id] |= one << np.uint64(source & 63)
        if cluster >= 0:
            self.held[cluster >> 6, bin_id] |= one << np.uint64(cluster & 63)
        self._move(found, bin_id, room - length)
        return bin_id, self.capacity - room

    def _move(self, old: int, bin_id: int, room: int) -> None:
        """Put the bin where its new room belongs; ties: the bin that opened first comes first."""
        if old >= 0:  # it has less room than before: shift those between up by one
            to = int(np.searchsorted(self.room[:old], room))
            while to < old and self.room[to] == room and self.id[to] < bin_id:
                to += 1
            if not room:
                self.room, self.id = np.delete(self.room, old), np.delete(self.id, old)
                return
            self.room[to + 1 : old + 1] = self.room[to:old].copy()
            self.id[to + 1 : old + 1] = self.id[to:old].copy()
            self.room[to], self.id[to] = room, bin_id
        elif room:
            to = int(np.searchsorted(self.room, room, "right"))
            self.room, self.id = np.insert(self.room, to, room), np.insert(self.id, to, bin_id)


def _codes(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def pack_block(doc_id: np.ndarray, n_words: np.ndarray, source: np.ndarray, cluster: np.ndarray, capacity: int, max_per_source: int) -> dict[str, np.ndarray]:
    """Pieces of one block's documents with their bins; documents without words make no piece."""
    order = np.lexsort((cluster, source, doc_id, -n_words))
    order = order[n_words[order] > 0]
    source_code, cluster_code = _codes(source), _codes(cluster)
    copies = np.bincount(cluster_code, minlength=1) if len(cluster_code) else np.zeros(1, int)
    bit = np.full(len(copies), -1)
    bit[copies > 1] = np.arange(int((copies > 1).sum()))
    whole, row, piece, first, size = [], [], [], [], []
    for i in order.tolist():
        n = int(n_words[i])
        for k in range(n // capacity):
            whole.append((i, k))
        if n % capacity:
            row.append(i), piece.append(n // capacity), first.append(n - n % capacity), size.append(n % capacity)
    by_size = sorted(range(len(row)), key=lambda k: (-size[k], k))
    bins = Bins(capacity, int(source_code.max(initial=0)) + 1, int((copies > 1).sum()), max_per_source)
    out = [(i, k, None, 0, k * capacity, capacity) for i, k in whole]
    for k in by_size:
        i = row[k]
        b, at = bins.place(size[k], int(source_code[i]), int(bit[cluster_code[i]]))
        out.append((i, piece[k], b, at, first[k], size[k]))
    full = bins.n
    got = {c: np.array([x[j] for x in out], np.int64) for j, c in enumerate(("row", "piece", "_", "bin_offset", "first_word", "n_words")) if c != "_"}
    ids = []
    for x in out:
        if x[2] is None:
            ids.append(full)
            full += 1
        else:
            ids.append(x[2])
    got["bin"] = np.array(ids, np.int64)
    used = np.bincount(got["bin"], got["n_words"], full).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
    got["bin_words"] = used[got["bin"]]
    return got


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            n = np.diff(words(part.column(1)).bounds)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), part.column(2), part.column(3)], names=["doc_id", "n_words", "source", "cluster"])


def best_fit_pack(docs: DataFrame, *, capacity: int = CAPACITY, max_per_source: int = 2, block_rows: int = BLOCK_ROWS, cluster: str | None = None) -> DataFrame:
    """One row a piece: doc_id, piece, bin_id, bin_offset, first_word, n_words, source, cluster, bin_words.

    ``cluster`` names a long column of duplicate clusters; by default copies of one text make a cluster. A null
    source is a source of its own. Documents without words (null, empty, blank) make one row with n_words 0 and a
    null bin. Repeated rows count as documents of their own, but as equal texts they never share a bin.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    of = F.col(cluster).cast("long") if cluster else F.xxhash64(text)
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    sized = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), source.alias("source"), F.coalesce(of, F.xxhash64(text)).alias("cluster")).mapInArrow(_measure, "doc_id long, n_words long, source string, cluster long")
    blocks = max(1, -(-docs.count() // block_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block: each block is packed when the next begins, or when twice its rows are there."""
        held: list[pa.RecordBatch] = []
        part, current = 0, None
        for batch in batches:
            block = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)] if len(block) else [0]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if current != int(block[i]):
                    if held:
                        yield from packed(held, part)
                    held, part, current = [], 0, int(block[i])
                while i < j:
                    more = min(j - i, 2 * block_rows - sum(x.num_rows for x in held))
                    held.append(batch.slice(i, more))
                    i += more
                    if sum(x.num_rows for x in held) == 2 * block_rows:
                        yield from packed(held, part)
                        held, part = [], part + 1
        if held:
            yield from packed(held, part)

    def packed(held: list[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        block = t.column("block")[0].as_py()
        null = t.column("doc_id").is_null().to_numpy()
        doc = t.column("doc_id").fill_null(-1).to_numpy()
        n = t.column("n_words").to_numpy()
        source = np.array([x or "" if x is not None else "\0null" for x in t.column("source").to_pylist()], object).astype(str)
        cluster = t.column("cluster").to_numpy()
        got = pack_block(doc, n, source, cluster, capacity, max_per_source)
        rows = got["row"]
        empty = np.flatnonzero(n == 0)
        take = np.concatenate([rows, empty])
        zero = np.zeros(len(empty), np.int64)
        column = lambda c: pa.array(np.concatenate([got[c], zero]))
        ids = pa.array([f"{block}-{part}-{b}" if part else f"{block}-{b}" for b in got["bin"].tolist()] + [None] * len(empty), pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[take], mask=null[take]), column("piece"), ids, column("bin_offset"), column("first_word"), column("n_words"), t.column("source").combine_chunks().take(pa.array(take)).cast(pa.string()), pa.array(cluster[take]), column("bin_words")],
            names=[x.split()[0] for x in SCHEMA.split(", ")],
        )

    dealt = sized.withColumn("block", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(blocks)))
    rows = dealt.select("block", "doc_id", "n_words", "source", "cluster").repartition(min(blocks, 65_536), "block").sortWithinPartitions("block", "doc_id", "cluster")
    return rows.mapInArrow(run, SCHEMA)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents"))
