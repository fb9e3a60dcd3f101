"""Line deduplication: a suffix array over line sequences, by distributed prefix doubling.

A document is its sequence of lines (split at line feeds); a line's id is a fingerprint of its bytes. Suffixes begin
at every line and end with their document. They are ranked by their first line, then by 2, 4, 8 ... lines: each round
sorts the suffixes that are still tied by (rank, rank of the suffix that begins as many lines on), and a suffix's new
rank is the place of the first suffix it ties with, so ranks are places in the suffix array (Larsson and Sadakane).
A suffix leaves the rounds when it is alone, or when neither its own ``min_words`` words nor those of an earlier suffix
whose rank is made from its rank reach any further; near the end of a document it is ranked by the lines that are left.

A repeated run of ``min_words`` words is covered by the shortest prefixes with ``min_words`` words of the suffixes inside
it, and by the shortest one that ends where it ends: so each suffix counts with its prefixes from ``min_words`` words up to
those that hold fewer than ``min_words`` words after their first line, and is ranked as far as those go. The longest
common prefix of neighbours in the suffix array is the longest of these prefixes that both have, told by fingerprints.
One scan in the array's order keeps a stack of the intervals that are open (Kasai et al., 2001; Abouelhoda et al., 2004):
an interval of n lines is a stretch of the array in which all neighbours share n lines at least. In each interval the
first suffix, by (doc_id, text, line), is the original, and the n lines of every other one are deleted: so every later
copy of every repeated run goes, whichever copy it repeats.

Sorts break ties by position and are cut into ranges by place, so that a line that a third of all documents hold spreads
over tasks; what crosses a boundary between tasks, an interval too, is settled from one small row a task. Rounds are tables in the shared
folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import bounded, drop, materialize, table
from ._text import U64, mix, pieces, raw, word_hashes, words

MIN_WORDS = 50
_R = 0xC2B2AE3D27D4EB4D & ~7 | 5
_RINV = pow(_R, -1, 2**64)
KEY = ["doc", "fp"]
PLACE = ["doc", "fp", "pos"]


def _line_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's line ids and words in each line."""
    for batch in batches:
        for part in pieces(batch):
            text = part.column(2)
            data, off = raw(text)
            w = words(text)
            feed = np.flatnonzero(data == 10)
            doc = np.searchsorted(off, feed, "right") - 1
            n = np.bincount(doc, minlength=part.num_rows) + 1
            bounds = np.concatenate(([0], np.cumsum(n)))
            ends, starts = np.empty(bounds[-1], np.int64), np.empty(bounds[-1], np.int64)
            last = bounds[1:] - 1
            inner = np.ones(bounds[-1], bool)
            inner[last] = False
            ends[inner], ends[last] = feed, off[1:]
            first = np.ones(bounds[-1], bool)
            first[bounds[:-1]] = False
            starts[first], starts[bounds[:-1]] = feed + 1, off[:-1]
            h = _exact(data, starts, ends)
            count = np.searchsorted(w.starts, ends) - np.searchsorted(w.starts, starts)
            lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, kind))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists(h.view(np.int64), pa.int64()), lists(count, pa.int32())], names=["doc", "fp", "h", "w"])


def _exact(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints that tell A-Z from a-z: that of the bytes, and that of where the capitals stand."""
    capital = ((data >= 65) & (data <= 90)).astype(np.uint8)
    return mix(word_hashes(data, starts, ends) ^ (word_hashes(capital, starts, ends) * U64(_R)))


def _reach(need: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """To how many lines (a power of two; 0: never read) each suffix must be ranked for ``need`` lines of every suffix
    to be compared: ranks by 2n lines read the rank by n lines of the suffix n lines on. ``stop``: its document's end."""
    reach = np.zeros(len(need), np.int64)
    depth = 1
    while depth < need.max(initial=0):
        depth *= 2
    while depth:
        reach[(reach == 0) & (2 * need > depth)] = depth  # need > depth / 2
        longer = np.flatnonzero(reach >= 2 * depth)
        longer = longer[longer + depth < stop[longer]] + depth
        reach[longer] = np.maximum(reach[longer], depth)
        depth //= 2
    return reach


def _suffixes(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """A row for each line: its id, how many lines hold min_words words from here on, fingerprints of those and of the
    longer prefixes that count, each one line longer, and to how many lines it must be ranked."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            h, w = (part.column(i).flatten().to_numpy() for i in (2, 3))
            h, sizes = h.view(U64), part.column(2).value_lengths().to_numpy()
            n = len(h)
            power = np.full(n + 1, _R, U64)
            power[0] = 1
            power = np.multiply.accumulate(power)
            inverse = np.full(n + 1, _RINV, U64)
            inverse[0] = 1
            inverse = np.multiply.accumulate(inverse)
            total = np.concatenate((np.zeros(1, U64), np.cumsum(h * power[:n])))
            seen = np.concatenate(([0], np.cumsum(w, dtype=np.int64)))
            stop = np.repeat(np.cumsum(sizes), sizes)
            at = np.arange(n)
            end = np.searchsorted(seen, seen[:-1] + min_words)
            enough = end <= stop
            need = np.where(enough, end - at, 0)
            far = np.maximum(need, np.minimum(np.searchsorted(seen, seen[1:] + min_words) - 1, stop) - at)
            far = np.where(enough, far, 0)
            many = np.where(enough, far - need + 1, 0)
            upto = np.cumsum(many)
            begin = np.repeat(at, many)
            end = begin + np.repeat(need, many) + np.arange(len(begin)) - np.repeat(upto - many, many)
            prefix = mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(U64))
            prefixes = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], upto)), pa.int32()), pa.array(prefix.view(np.int64)))
            take = pa.array(np.repeat(np.arange(part.num_rows), sizes))
            pos = at - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(pos, pa.int32()), pa.array(h.view(np.int64)), pa.array(need, pa.int32()), prefixes, pa.array(_reach(far, stop), pa.int32())], names=["doc", "fp", "pos", "h", "need", "prefixes", "reach"])


def _ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by keys a and b: local places where each row's ties begin, and whether it has one at all."""
    held, part, n, a0, b0, at_a, at_ab = None, TaskContext.get().partitionId(), 0, None, None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        place = n + np.arange(len(a))
        new_a = np.ones(len(a), bool)
        new_a[1:] = a[1:] != a[:-1]
        new_ab = new_a.copy()
        new_ab[1:] |= b[1:] != b[:-1]
        if a0 is not None:
            new_a[0], new_ab[0] = a[0] != a0, a[0] != a0 or b[0] != b0
        start_a = np.maximum.accumulate(np.where(new_a, place, at_a))
        start_ab = np.maximum.accumulate(np.where(new_ab, place, at_ab))
        tied = ~new_ab
        tied[:-1] |= ~new_ab[1:]
        out = [*batch.columns, pa.array(np.full(len(a), part), pa.int32()), pa.array(place), pa.array(start_a), pa.array(start_ab)]
        names = [*batch.schema.names, "part", "place", "start_a", "start_ab", "tied"]
        now = pa.RecordBatch.from_arrays([*out, pa.array(tied)], names=names)
        if held is not None:  # its last row may tie with this batch's first one
            last = held.column(len(names) - 1).to_numpy(zero_copy_only=False).copy()
            last[-1] |= not new_ab[0]
            yield pa.RecordBatch.from_arrays([*held.columns[:-1], pa.array(last)], names=names)
        held, n, a0, b0, at_a, at_ab = now, n + len(a), a[-1], b[-1], int(start_a[-1]), int(start_ab[-1])
    if held is not None:
        yield held


def _place(df: DataFrame, order: list[str], tag: str) -> tuple[DataFrame, list[str]]:
    """Sort ``df`` (columns a, b, ...) by ``order``; add where each row's ties on a, and on a and b, begin in the
    sorted whole (``first_a``, ``first_ab``), and whether another row ties on both (``tied``). Rows that tie must be
    next to each other in that order. Returns the frame and the tables it reads.
    """
    spark = df.sparkSession
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", part int, place long, start_a long, start_ab long, tied boolean"
    rows, path = materialize(df.orderBy(*order).mapInArrow(_ties, schema), tag)
    ends = (
        rows.groupBy("part")
        .agg(F.count("*").alias("n"), F.min_by(F.struct("a", "b"), "place").alias("head"), F.max_by(F.struct("a", "b"), "place").alias("tail"), F.max("start_a").alias("last_a"), F.max("start_ab").alias("last_ab"))
        .orderBy("part")
        .collect()
    )  # a row a task
    fixed, total, before, open_a, open_ab = [], 0, None, 0, 0
    for i, r in enumerate(ends):
        joins_a = before is not None and r["head"]["a"] == before["a"]
        joins_ab = joins_a and r["head"]["b"] == before["b"]
        after = ends[i + 1]["head"] if i + 1 < len(ends) else None
        fixed.append((r["part"], total, open_a if joins_a else total, open_ab if joins_ab else total, joins_ab, after is not None and after == r["tail"], r["n"] - 1))
        open_a = open_a if joins_a and r["last_a"] == 0 else total + r["last_a"]
        open_ab = open_ab if joins_ab and r["last_ab"] == 0 else total + r["last_ab"]
        total, before = total + r["n"], r["tail"]
    fix = spark.createDataFrame(fixed, "part int, base long, carry_a long, carry_ab long, joins boolean, joined boolean, last long")
    whole = rows.join(F.broadcast(fix), "part").select(
        *df.columns,
        F.when(F.col("start_a") == 0, F.col("carry_a")).otherwise(F.col("base") + F.col("start_a")).alias("first_a"),
        F.when(F.col("start_ab") == 0, F.col("carry_ab")).otherwise(F.col("base") + F.col("start_ab")).alias("first_ab"),
        (F.col("tied") | (F.col("joins") & (F.col("place") == 0)) | (F.col("joined") & (F.col("place") == F.col("last")))).alias("tied"),
    )
    return whole, [path]


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with doc (doc_id; null: the least long) and fp (a fingerprint of the text; null: that of the empty one)."""
    return docs.withColumns({"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "fp": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})


def suffix_array(lines: DataFrame, min_words: int) -> tuple[DataFrame, list[str]]:
    """Suffixes that share their first lines with another one up to ``min_words`` words, with their ranks.

    ``lines``: (doc, fp, h, w). Returns (doc, fp, pos, need, prefixes, reach, rank) and the tables it reads. In the order of
    (rank, reach) suffixes that share lines are next to each other, as far as they count: of equal ranks, those that left
    the rounds first have the shorter prefixes.
    """
    spark = lines.sparkSession
    # Written first: the sort reads its input twice, once for the bounds of its ranges.
    suffixes, suffixes_path = materialize(lines.mapInArrow(lambda batches: _suffixes(batches, min_words), "doc long, fp long, pos int, h long, need int, prefixes array<long>, reach int"), "lines-suffixes")
    first, paths = _place(suffixes.select(F.lit(0).cast("long").alias("a"), F.col("h").alias("b"), *PLACE, "need", "prefixes", "reach"), ["b", *PLACE], "lines-rank1")
    ranked = first.select(*PLACE, "need", "prefixes", "reach", F.col("first_ab").alias("rank"), "tied")
    alone, alone_path = materialize(ranked.where("not tied").select(*PLACE, "rank"), "lines-alone")
    live, live_path = materialize(ranked.where("tied"), "lines-live1")
    drop(spark, suffixes_path, *paths)
    depth = 1
    while not live.where(f"tied and reach > {depth}").isEmpty():
        active = F.col("tied") & (F.col("reach") > depth)
        ranks = alone.unionByName(live.select(*PLACE, "rank")).select("doc", "fp", (F.col("pos") - depth).alias("pos"), F.col("rank").alias("b"))
        pairs = live.where(active).join(ranks, PLACE, "left").select(F.col("rank").alias("a"), F.coalesce("b", F.lit(-1)).alias("b"), *PLACE, "need", "prefixes", "reach")
        done, paths = _place(pairs, ["a", "b", *PLACE], f"lines-rank{2 * depth}")
        done = done.select(*PLACE, "need", "prefixes", "reach", (F.col("a") + F.col("first_ab") - F.col("first_a")).alias("rank"), "tied")
        now, now_path = materialize(live.where(~active).unionByName(done), f"lines-live{2 * depth}")
        drop(spark, live_path, *paths)
        live, live_path, depth = now, now_path, 2 * depth
    drop(spark, alone_path)
    return live.where("need > 0").drop("tied"), [live_path]


def _shared(a: list[int], b: list[int]) -> int:
    """Lines that two suffixes share, given (need, prefix fingerprints) of both; 0 if fewer than hold min_words words."""
    if a[:2] != b[:2]:
        return 0
    k = 2
    while k < len(a) and k < len(b) and a[k] == b[k]:
        k += 1
    return a[0] + k - 2


INTERVALS = "doc long, fp long, pos int, n int, start long, part int, head array<long>, tail array<long>, levels array<int>, starts array<long>"


def _intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of suffixes (doc, fp, pos, need, prefixes) in the array's order: (doc, fp, pos, n, start) for each n that a
    neighbour may share; start names the interval of n lines, null: it began before this task. A last row, for the task:
    its first and last suffix, and the intervals that are open at its end, those of more than levels[i] lines with
    starts[i]."""
    part, place = TaskContext.get().partitionId(), 0
    stack: list[tuple[int, int | None]] = [(-1, None)]
    head = before = waiting = None
    rows: list[tuple[int, int, int, int, int | None]] = []
    names = [x.split()[0] for x in INTERVALS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def put(row: tuple[int, int, int, int], most: int) -> None:
        """Its intervals of need to ``most`` lines."""
        doc, fp, pos, need = row
        k = len(stack) - 1
        for n in range(most, need - 1, -1):
            while stack[k][0] >= n:
                k -= 1
            rows.append((doc, fp, pos, n, stack[k][1]))

    def flush() -> pa.RecordBatch:
        columns = [*(list(c) for c in zip(*rows)), [part] * len(rows), *[[None] * len(rows)] * 4]
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    for batch in batches:
        doc, fp, pos, need = (batch.column(i).to_pylist() for i in range(4))
        for i, prefixes in enumerate(batch.column(4).to_pylist()):
            now = [need[i], *prefixes]
            if before is None:
                head, same = now, len(now) + need[i] - 2
                waiting = (doc[i], fp[i], pos[i], need[i])
                put(waiting, same)
                waiting = None
            else:
                same = _shared(before, now)
                if waiting is not None:
                    row, least = waiting
                    put(row, max(least, same))
                while stack[-1][0] >= same:
                    stack.pop()
                stack.append((same, part << 40 | place))
                waiting = ((doc[i], fp[i], pos[i], need[i]), same)
            before = now
            place += 1
        if len(rows) > 1 << 16:
            yield flush()
    if before is not None:
        if waiting is not None:
            put(waiting[0], before[0] + len(before) - 2)
        if rows:
            yield flush()
        levels, starts = zip(*stack)
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((None, None, None, None, None, part, head, before, levels, starts), kinds)], names=names)


def _members(array: DataFrame) -> tuple[DataFrame, list[str]]:
    """(doc, fp, pos, n, start): the suffixes of each interval of n lines; and the tables they are read from."""
    spark = array.sparkSession
    ordered = array.select(*PLACE, "need", "prefixes", "rank", "reach").orderBy("rank", "reach", *PLACE).select(*PLACE, "need", "prefixes")
    found, path = materialize(ordered.mapInArrow(_intervals, INTERVALS), "lines-intervals")
    carry: list[tuple[int, int]] = []
    tail, fixed = None, []
    for r in found.where("head is not null").select("part", "head", "tail", "levels", "starts").orderBy("part").collect():  # a row a task
        same = -1 if tail is None else _shared(tail, list(r["head"]))
        while carry and carry[-1][0] >= same:
            carry.pop()
        carry.append((same, r["part"] << 40))
        fixed.append((r["part"], [x for x, _ in carry], [x for _, x in carry]))
        own = list(zip(r["levels"], r["starts"]))[1:]
        if own:
            carry = [x for x in carry if x[0] < own[0][0]] + own
        tail = list(r["tail"])
    fix = F.broadcast(spark.createDataFrame(fixed, "part int, bounds array<int>, names array<long>"))
    rows = found.where("head is null").join(fix, "part")
    # bounds ascend: the last one below n counts
    start = F.coalesce("start", F.get("names", F.size(F.filter("bounds", lambda x: x < F.col("n"))) - 1))
    return rows.select(*PLACE, "n", start.alias("start")), [path]


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of a document that runs of n lines from at on cover, and for each of its lines up to the last such one
    whether it is one."""
    for batch in batches:
        flags = []
        for at, n in zip(batch.column(2), batch.column(3)):
            at = at.values.to_numpy()
            end = at + n.values.to_numpy()
            edge = np.bincount(at, minlength=end.max() + 1) - np.bincount(end, minlength=end.max() + 1)
            flags.append(np.cumsum(edge)[:-1] > 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([np.flatnonzero(x) for x in flags], pa.list_(pa.int32())), pa.array(flags, pa.list_(pa.bool_()))], names=["doc", "fp", "lines", "gone"])


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, list[str]]:
    """(doc, fp, lines, gone): the numbers of the lines to delete, and flags of all lines up to the last one of these,
    for documents that have any; and the tables they are read from."""
    spark = docs.sparkSession
    texts = _keyed(bounded(docs)).select("doc", "fp", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("text <> ''")
    lines = texts.mapInArrow(_line_table, "doc long, fp long, h array<long>, w array<int>").dropDuplicates(KEY)
    array, paths = suffix_array(lines, min_words)
    members, member_paths = _members(array)
    origin = members.groupBy("n", "start").agg(F.min(F.struct(*PLACE)).alias("o")).select("o.*", "n")
    copies = members.join(origin, [*PLACE, "n"], "left_anti")
    runs = copies.groupBy(*KEY).agg(F.collect_list(F.struct("pos", "n")).alias("r"))
    gone = runs.select("doc", "fp", F.col("r.pos").alias("at"), F.col("r.n").alias("n")).mapInArrow(_covered, "doc long, fp long, lines array<int>, gone array<boolean>")
    gone, gone_path = materialize(gone, "lines-deleted")
    drop(spark, *paths, *member_paths)
    return gone, [gone_path]


def _cut(docs: DataFrame, min_words: int) -> DataFrame:
    """(row, kept, lines): the rows as structs, the text that is left, and the lines that are deleted."""
    gone, _ = repeated_lines(docs, min_words)
    keyed = _keyed(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")).select("row", "doc", "fp")
    out = keyed.join(gone.hint("shuffle_hash"), KEY, "left")
    text: Column = F.col("row.text").cast("string")
    left = F.array_join(F.zip_with(F.split(text, "\n"), F.col("gone"), lambda line, x: F.when(~F.coalesce(x, F.lit(False)), line)), "\n")
    return out.select("row", F.when(F.col("lines").isNull(), F.col("row.text")).otherwise(left).alias("kept"), "lines")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows with all their columns, ``text`` without later copies of repeated runs, and ``deleted_lines`` (null: none;
    a column of that name is replaced).

    Only runs of at least ``min_words`` words count; of copies, the one with the least (doc_id, fingerprint of the text,
    line number) stays. A null text stays null; a null doc_id counts as the least one. Rows with equal doc_id and text are
    one document and get one result. A text is its lines whole, however long it is; an empty table gives no rows.
    """
    names = [c for c in docs.columns if c.lower() != "deleted_lines"]
    return _cut(docs.select(*names), min_words).select(*[F.col("kept").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in names], F.col("lines").alias("deleted_lines"))


def without_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """:func:`dedup_lines` with the rows' own columns alone, without the rows of which nothing is left."""
    out = _cut(docs, min_words).where("lines is null or kept <> ''")
    return out.select(*[F.col("kept").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.coalesce(F.size("deleted_lines"), F.lit(0)).cast("long").alias("n_deleted"), F.array_join(F.col("deleted_lines").cast("array<string>"), ",").alias("deleted_lines"))
