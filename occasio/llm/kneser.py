"""An interpolated modified Kneser-Ney bigram model, counted in Spark and used from sorted, memory-mapped arrays.

Tokens are words (A-Z as a-z) and one end a document; a word's context is the word before it, or the start.

1. Vocabulary: the training words' 64-bit fingerprints with their counts, merged by ranges of the fingerprint. The
   arrays are sorted as a whole; a word's place is its id. Spark ships the files to the executors, where they are laid
   out once as a flat file that all workers map into memory.
2. Bigrams: tasks send, for each batch of documents, the sorted (context, word) ids that occur, and in which documents.
   A shard merges what it gets into sorted arrays of its bigrams with their training counts, and keeps for each batch
   the places of its bigrams. Shards go by context, so that a context's statistics are at hand; a context with a large
   share of all tokens is dealt over as many shards as it fills, and its statistics, some numbers each, are added up.
3. Counts of counts give the discounts (Chen and Goodman, 1998). Continuation counts, in how many contexts a word
   occurs, are summed by ranges of ids into a second memory-mapped array.
4. Shards score their bigrams, add up each document's logarithms, and these sums are added by batch.

p(w | u) = max(c(u w) - D, 0) / c(u) + g(u) p(w), p(w) = max(N(. w) - D', 0) / N(..) + g' / (V + 1): the last share is
that of a word never seen, so probabilities over the vocabulary and one unknown word add up to 1.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import bounded, materialize, table
from ._text import U64, mix, pieces, words

END = U64(0x5BD1E995A7C3F00D)
BATCH_BYTES = 1 << 20
FLUSH = 1 << 19
SHARDS_A_TASK = 4
SHARD_TOKENS = 1 << 20
HELD = 1 << 21
_mapped: dict[str, tuple] = {}


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


# --- files that executors map into memory


def _ship(spark: SparkSession, path: str) -> list[str]:
    """Send the part files of a table to every executor, whatever file system they are in; returns their names."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = []
    for f in fs.listStatus(folder):
        name = f.getPath().getName()
        if name.endswith(".parquet"):
            spark.sparkContext.addFile(f.getPath().toString())
            names.append(name)
    return names


@dataclass(frozen=True)
class Mapped:
    """A table of (part, binary columns), as flat files of its columns in order of part, mapped by the workers."""

    id: str
    files: tuple[str, ...]
    columns: tuple[tuple[str, str], ...]  # name, dtype

    def arrays(self) -> tuple[np.ndarray, ...]:
        if self.id not in _mapped:
            _mapped[self.id] = tuple(self._open(n, d) for n, d in self.columns)
        return _mapped[self.id]

    def _open(self, name: str, dtype: str) -> np.ndarray:
        flat = os.path.join(SparkFiles.getRootDirectory(), f"{self.id}-{name}.flat")
        if not os.path.exists(flat):
            order = []
            for f in self.files:
                file = pq.ParquetFile(SparkFiles.get(f))
                for g in range(file.num_row_groups):
                    for row, part in enumerate(file.read_row_group(g, ["part"]).column(0).to_pylist()):
                        order.append((part, f, g, row))
            own = f"{flat}.{os.getpid()}.{uuid.uuid4().hex}"
            with open(own, "wb") as out:
                for _, f, g, row in sorted(order):
                    out.write(pq.ParquetFile(SparkFiles.get(f)).read_row_group(g, [name]).column(0)[row].as_buffer())
            os.replace(own, flat)  # another worker may have been as quick: either file will do
        return np.memmap(flat, dtype, "r") if os.path.getsize(flat) else np.zeros(0, dtype)


# --- 1. vocabulary


def _count_words(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    bits = shards.bit_length() - 1
    keys, counts, held = [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        k, c = _merge(keys, counts)
        cut = np.searchsorted(k >> U64(64 - bits), np.arange(shards + 1, dtype=U64)) if bits else np.array([0, len(k)])
        parts = [i for i in range(shards) if cut[i + 1] > cut[i]]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([k[cut[i] : cut[i + 1]].tobytes() for i in parts], pa.binary()), pa.array([c[cut[i] : cut[i + 1]].tobytes() for i in parts], pa.binary())], names=["part", "keys", "counts"])

    for batch in batches:
        for piece in pieces(batch):
            train = piece.column(2).to_numpy(zero_copy_only=False)
            w = words(piece.column(1))
            use = np.repeat(train, np.diff(w.bounds))
            k, c = np.unique(np.append(w.hashes[use], END), return_counts=True)
            c[np.searchsorted(k, END)] += int(train.sum()) - 1
            keys.append(k), counts.append(c)
            held += len(k)
            if held > 2 * FLUSH:
                k, c = _merge(keys, counts)
                keys, counts, held = [k], [c], len(k)
                if held > FLUSH:
                    yield from flush()
                    keys, counts, held = [], [], 0
    yield from flush()


def _merge_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got: dict[int, tuple[list, list]] = {}
    for batch in batches:
        for part, k, c in zip(*batch.columns):
            keys, counts = got.setdefault(part.as_py(), ([], []))
            keys.append(np.frombuffer(k.as_buffer(), U64)), counts.append(np.frombuffer(c.as_buffer(), np.int64))
            if len(keys) > 64:
                k, c = _merge(keys, counts)
                got[part.as_py()] = ([k], [c])
    for part in sorted(got):
        k, c = _merge(*got[part])
        k, c = k[c > 0], c[c > 0]
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k.tobytes()], pa.binary()), pa.array([c.astype(np.uint32).tobytes() if c.max(initial=0) < 2**32 else _too_many()], pa.binary()), pa.array([len(k)], pa.int64()), pa.array([int(c.sum())], pa.int64())], names=["part", "keys", "counts", "n", "total"])


def _too_many() -> bytes:
    raise OverflowError("a token occurs more than 4,294,967,295 times")


# --- 2. bigrams


@dataclass(frozen=True)
class Vocabulary:
    table: Mapped
    size: int
    tokens: int

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (``size``: unknown) and training counts."""
        keys, counts = self.table.arrays()
        once, back = np.unique(hashes, return_inverse=True)
        at = np.searchsorted(keys, once)
        known = at < len(keys)
        known[known] = keys[at[known]] == once[known]
        c = np.zeros(len(once), np.int64)
        c[known] = counts[at[known]]
        return np.where(known, at, self.size)[back], c[back]


def _spread(vocabulary: Vocabulary, u: np.ndarray, count: np.ndarray, shards: int) -> np.ndarray:
    """Over how many shards a context is dealt: one for each half of a shard's tokens that it has, so that all contexts
    together have a few pieces a shard; the start and the unknown word over all."""
    pieces_ = np.minimum(1 + count * 2 * shards // max(vocabulary.tokens, 1), shards)
    return np.where(u >= vocabulary.size, shards, pieces_)


def _shard(u: np.ndarray, w: np.ndarray, spread: np.ndarray, shards: int) -> np.ndarray:
    by = mix(u.astype(U64) + U64(1))
    both = mix(by + w.astype(U64))
    return ((by % U64(shards) + both % spread.astype(U64)) % U64(shards)).astype(np.int64)


_PAIRS = "shard int, batch long, u binary, w binary, occ binary, docs binary, train binary, info binary"


def _pairs(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, shards: int) -> Iterator[pa.RecordBatch]:
    """For each batch of documents and shard: its sorted bigrams, how often each occurs, and in which documents."""
    task, number = TaskContext.get().partitionId(), 0
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
    names = [x.split()[0] for x in _PAIRS.split(", ")]
    for batch in batches:
        for piece in pieces(batch, limit=BATCH_BYTES):
            for lo in range(0, piece.num_rows, 65_535):
                part = piece.slice(lo, 65_535)
                key = task << 32 | number
                number += 1
                train = part.column(2).to_numpy(zero_copy_only=False)
                x = words(part.column(1))
                n = np.diff(x.bounds) + 1  # tokens with the end
                bounds = np.concatenate(([0], np.cumsum(n)))
                h = np.empty(bounds[-1], U64)
                last = np.zeros(bounds[-1], bool)
                last[bounds[1:] - 1] = True
                h[last], h[~last] = END, x.hashes
                ids, counts = vocabulary.find(h)
                u, cu = np.empty_like(ids), np.empty_like(counts)
                u[1:], cu[1:] = ids[:-1], counts[:-1]
                u[bounds[:-1]], cu[bounds[:-1]] = vocabulary.size + 1, 0
                base = np.add.reduceat(np.log10((counts + 1) / (vocabulary.tokens + vocabulary.size + 1)), bounds[:-1])
                info = pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(np.add.reduceat((counts > 0).astype(np.int64), bounds[:-1])), pa.array(base), part.column(3)], names=["doc_id", "n", "known", "base", "held_out"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, info.schema) as out:
                    out.write_batch(info)
                rows = [[key % shards, key, None, None, None, None, None, sink.getvalue().to_pybytes()]]
                pair = u.astype(U64) << U64(32) | ids.astype(U64)
                shard = _shard(u, ids, _spread(vocabulary, u, cu, shards), shards)
                doc = np.repeat(np.arange(part.num_rows, dtype=np.uint16), n)
                order = np.lexsort((pair, shard))
                pair, shard, doc = pair[order], shard[order], doc[order]
                cut = np.searchsorted(shard, np.arange(shards + 1))
                flags = np.packbits(train).tobytes()
                for s in np.flatnonzero(np.diff(cut)).tolist():
                    p = pair[cut[s] : cut[s + 1]]
                    first = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
                    once = p[first]
                    occ = np.diff(np.append(first, len(p)))
                    rows.append([s, key, _deltas(once >> U64(32)), _planes(once & U64(0xFFFFFFFF)), _planes(occ), _planes2(doc[cut[s] : cut[s + 1]]), flags, None])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def _planes(x: np.ndarray) -> bytes:
    """uint32 values byte plane by byte plane, which compresses well."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _planes2(x: np.ndarray) -> bytes:
    return x.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def _unplanes2(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(2, -1).T).view("<u2").ravel()


def _deltas(x: np.ndarray) -> bytes:
    return _planes(np.diff(x.astype(np.int64), prepend=0))


def _undeltas(b: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(b).astype(np.int64))


_SHARD = "shard int, batch long, u binary, w binary, c binary, at binary, occ binary, docs binary, batches binary, info binary"


def _merge_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by shard, one row a shard: sorted bigrams with training counts, and for each batch the places of
    those it has. A shard is merged when the next one begins."""
    names = [x.split()[0] for x in _SHARD.split(", ")]
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 8]
    shard, parts = None, []

    def merged() -> pa.RecordBatch:
        parts.sort()
        keys, trained = [], []
        for _, u, w, occ, docs, train in parts:
            k = _undeltas(u).astype(U64) << U64(32) | _unplanes(w).astype(U64)
            flags = np.unpackbits(np.frombuffer(train, np.uint8)).astype(np.int64)[_unplanes2(docs)]
            starts = np.concatenate(([0], np.cumsum(_unplanes(occ))[:-1])).astype(np.int64)
            keys.append(k), trained.append(np.add.reduceat(flags, starts))
        every = np.unique(np.concatenate(keys))
        count = np.zeros(len(every), np.int64)
        at, occs, docs = [], [], []
        for k, t, (_, _, _, occ, d, _) in zip(keys, trained, parts):
            place = np.searchsorted(every, k)
            count[place] += t
            at.append(np.diff(place, prepend=0)), occs.append(_unplanes(occ)), docs.append(_unplanes2(d))
        table = np.array([(p[0], len(a), len(d)) for p, a, d in zip(parts, at, docs)], np.int64)
        row = [shard, None, _deltas(every >> U64(32)), _planes(every & U64(0xFFFFFFFF)), _planes(count), _planes(np.concatenate(at)), _planes(np.concatenate(occs)), _planes2(np.concatenate(docs)), table.tobytes(), None]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=names)

    for batch in batches:
        for i in range(batch.num_rows):
            of, key, u, w, occ, docs, train, info = (c[i].as_py() for c in batch.columns)
            if info is not None:
                row = [of, key, *[None] * 7, info]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=names)
                continue
            if of != shard:
                if parts:
                    yield merged()
                shard, parts = of, []
            parts.append((key, u, w, occ, docs, train))
    if parts:
        yield merged()


# --- 3. statistics


def _statistics(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, ranges: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0: counts of counts; 1: a large context's counts; 2: words' numbers of contexts, by range of ids."""
    width = -(-(vocabulary.size + 2) // ranges)
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    names = ["kind", "k", "c", "n1", "n2", "n3", "ids", "counts"]
    for batch in batches:
        for u, w, c in zip(*batch.columns):
            u, w, c = _undeltas(u.as_py()), _unplanes(w.as_py()).astype(np.int64), _unplanes(c.as_py()).astype(np.int64)
            seen = c > 0
            u, w, c = u[seen], w[seen], c[seen]
            rows = [[0, int(k), int((c == k).sum()), 0, 0, 0, None, None] for k in range(1, 5)] + [[0, 0, len(c), 0, 0, 0, None, None]]
            if len(c):
                first = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
                totals = [np.add.reduceat(x.astype(np.int64), first) for x in (c, c == 1, c == 2, c >= 3)]
                big = _spread(vocabulary, u[first], _counts_of(vocabulary, u[first]), shards) > 1
                rows += [[1, int(u[first][i]), *(int(t[i]) for t in totals), None, None] for i in np.flatnonzero(big)]
                ids, n = np.unique(w, return_counts=True)
                cut = np.searchsorted(ids, np.arange(ranges + 1) * width)
                for r in np.flatnonzero(np.diff(cut)).tolist():
                    part = slice(cut[r], cut[r + 1])
                    rows.append([2, r, 0, 0, 0, 0, _deltas(ids[part]), _planes(n[part])])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)


def _counts_of(vocabulary: Vocabulary, ids: np.ndarray) -> np.ndarray:
    _, counts = vocabulary.table.arrays()
    out = np.zeros(len(ids), np.int64)
    word = ids < vocabulary.size
    out[word] = counts[ids[word]]
    return out


def _continuations(batches: Iterator[pa.RecordBatch], size: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """Each range of ids as a dense array of numbers of contexts, with its counts of counts."""
    width = -(-(size + 2) // ranges)
    got: dict[int, np.ndarray] = {}
    for batch in batches:
        for r, ids, n in zip(*batch.columns):
            r = r.as_py()
            if r not in got:
                got[r] = np.zeros(min(width, size + 2 - r * width), np.int64)
            got[r][_undeltas(ids.as_py()) - r * width] += _unplanes(n.as_py())
    for r in sorted(got):
        x = got[r]
        yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([x.astype(np.uint32).tobytes()], pa.binary()), *(pa.array([int((x == k).sum())], pa.int64()) for k in range(1, 5)), pa.array([int((x >= 3).sum())], pa.int64())], names=["part", "n", "n1", "n2", "n3", "n4", "more"])


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2, and 3 or more; within their counts where counts of counts are few."""
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2 - 3 * y * n3 / n2)
    return tuple(float(min(max(d, 0.05), k - 0.05)) for k, d in enumerate(raw, 1))  # type: ignore[return-value]


@dataclass(frozen=True)
class Model:
    vocabulary: Vocabulary
    continuation: Mapped
    bigrams: int
    d2: tuple[float, float, float]
    d1: tuple[float, float, float]
    spare: float  # mass of the lowest order that goes to all words alike
    contexts: dict[int, tuple[int, int, int, int]]  # of large contexts: tokens; words seen once, twice, more
    shards: int

    def lowest(self, w: np.ndarray) -> np.ndarray:
        """p(w) from continuation counts; the unknown word has id ``vocabulary.size``."""
        flat = 1 / (self.vocabulary.size + 1)
        if not self.bigrams:
            return np.full(len(w), flat)
        (n,) = self.continuation.arrays()
        c = n[w].astype(np.float64)
        return np.maximum(c - _discount(c, self.d1), 0) / self.bigrams + self.spare * flat

    def bigram(self, u: np.ndarray, w: np.ndarray, c: np.ndarray) -> np.ndarray:
        """p(w | u) for all bigrams of a shard, sorted by u; c: training counts."""
        p = self.lowest(w)
        if not len(u):
            return p
        first = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(u))))
        total, once, twice, more = (np.add.reduceat(x.astype(np.int64), first) for x in (c, c == 1, c == 2, c >= 3))
        big = _spread(self.vocabulary, u[first], _counts_of(self.vocabulary, u[first]), self.shards) > 1
        for i in np.flatnonzero(big).tolist():
            total[i], once[i], twice[i], more[i] = self.contexts.get(int(u[first][i]), (0, 0, 0, 0))
        total = total[of].astype(np.float64)
        back = (self.d2[0] * once + self.d2[1] * twice + self.d2[2] * more)[of]
        seen = total > 0
        c = c[seen].astype(np.float64)
        p[seen] = np.maximum(c - _discount(c, self.d2), 0) / total[seen] + back[seen] / total[seen] * p[seen]
        return p


def _discount(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(c <= 0, 0.0, np.where(c == 1, d[0], np.where(c == 2, d[1], d[2])))


# --- 4. scores


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """(batch, info, sums): sums of log10 p by document of each batch, added up over a task's shards as far as ``HELD``
    numbers go; the batch's facts as they are."""
    held: dict[int, np.ndarray] = {}

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([None] * len(held), pa.binary()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["batch", "info", "sums"])

    size = 0
    for batch in batches:
        for i in range(batch.num_rows):
            _, key, u, w, c, at, occ, docs, table, info = (x[i].as_py() for x in batch.columns)
            if info is not None:
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([info], pa.binary()), pa.array([None], pa.binary())], names=["batch", "info", "sums"])
                continue
            logs = np.log10(model.bigram(_undeltas(u), _unplanes(w).astype(np.int64), _unplanes(c).astype(np.int64)))
            at, occ, docs, table = _unplanes(at), _unplanes(occ), _unplanes2(docs), np.frombuffer(table, np.int64).reshape(-1, 3)
            a = d = 0
            for key, n, m in table.tolist():
                each = np.repeat(logs[np.cumsum(at[a : a + n].astype(np.int64))], occ[a : a + n])
                doc = docs[d : d + m]
                a, d = a + n, d + m
                old = held.get(key, np.zeros(0))
                held[key] = np.bincount(doc, each, max(int(doc.max()) + 1, len(old)))
                held[key][: len(old)] += old
                size += len(held[key]) - len(old)
                if size > HELD:
                    yield flush()
                    held, size = {}, 0
    if held:
        yield flush()


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by batch: a document's facts with the sum of its parts."""
    key, info, total = None, None, np.zeros(0)

    def done() -> Iterator[pa.RecordBatch]:
        if info is not None:
            facts = pa.ipc.open_stream(info).read_all().combine_chunks().to_batches()[0] if info else None
            if facts is not None and facts.num_rows:
                score = np.zeros(facts.num_rows)
                score[: len(total)] = total
                yield pa.RecordBatch.from_arrays([facts.column(0), facts.column(4), facts.column(1), facts.column(2), facts.column(3), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    for batch in batches:
        for k, i, s in zip(*(c.to_pylist() for c in batch.columns)):
            if k != key:
                yield from done()
                key, info, total = k, None, np.zeros(0)
            if i is not None:
                info = i
            else:
                s = np.frombuffer(s)
                if len(s) > len(total):
                    total = np.concatenate([total, np.zeros(len(s) - len(total))])
                total = total + np.pad(s, (0, len(total) - len(s)))
    yield from done()


def fit_and_score(docs: DataFrame, held_out, shards: int | None = None) -> tuple[DataFrame, Model]:
    """(doc_id, held_out, n_tokens, n_known, base_score, score) of every row, and the model it was scored with.

    ``held_out``: a boolean column; other rows train. A null text is empty: it has its end alone. Rows with equal doc_id
    are rows of their own. Without training rows all words are unknown and equally likely.
    """
    spark = docs.sparkSession
    tasks = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    chosen, shards = shards, shards or SHARDS_A_TASK * tasks
    parts = 1 << (shards - 1).bit_length()
    out = F.coalesce(held_out, F.lit(False))
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (~out).alias("train"), out.alias("held_out"))

    counted = rows.mapInArrow(lambda b: _count_words(b, parts), "part int, keys binary, counts binary").repartition(tasks, "part")
    vocabulary, vocabulary_path = materialize(counted.mapInArrow(_merge_words, "part int, keys binary, counts binary, n long, total long"), "lm-words")
    size, tokens = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    if size + 2 >= 2**32:
        raise OverflowError("the vocabulary has more than 2**32 words")
    known = Vocabulary(Mapped(f"words-{uuid.uuid4().hex}", tuple(_ship(spark, vocabulary_path)), (("keys", "<u8"), ("counts", "<u4"))), size, tokens)

    if not chosen:  # as many shards as the tokens fill, and as many tasks as take a few each
        tasks = max(tasks, -(-tokens // (SHARDS_A_TASK * SHARD_TOKENS)))
        shards = SHARDS_A_TASK * tasks
    paired = rows.mapInArrow(lambda b: _pairs(b, known, shards), _PAIRS).repartition(tasks, "shard").sortWithinPartitions("shard")
    merged, _ = materialize(paired.mapInArrow(_merge_pairs, _SHARD), "lm-bigrams", "zstd")

    stats, _ = materialize(merged.where("info is null").select("u", "w", "c").mapInArrow(lambda b: _statistics(b, known, tasks, shards), "kind int, k long, c long, n1 long, n2 long, n3 long, ids binary, counts binary"), "lm-statistics")
    kinds = {r["k"]: r["c"] for r in stats.where("kind = 0").groupBy("k").agg(F.sum("c").alias("c")).collect()}  # five rows
    large = stats.where("kind = 1").groupBy("k").agg(*[F.sum(c).alias(c) for c in ("c", "n1", "n2", "n3")])
    contexts = {r["k"]: (r["c"], r["n1"], r["n2"], r["n3"]) for r in large.collect()}  # some a shard
    ranged = stats.where("kind = 2").select("k", "ids", "counts").repartition(tasks, "k")
    continued, continued_path = materialize(ranged.mapInArrow(lambda b: _continuations(b, size, tasks), "part int, n binary, n1 long, n2 long, n3 long, n4 long, more long"), "lm-continuations")
    bigrams = int(kinds.get(0, 0))
    filled = _fill(continued, continued_path, size, tasks)
    n1, n2, n3, n4, more = (int(x or 0) for x in continued.agg(*[F.sum(c) for c in ("n1", "n2", "n3", "n4", "more")]).first())
    d1 = discounts(n1, n2, n3, n4)
    spare = (d1[0] * n1 + d1[1] * n2 + d1[2] * more) / bigrams if bigrams else 1.0
    model = Model(known, Mapped(f"continuations-{uuid.uuid4().hex}", tuple(_ship(spark, filled)), (("n", "<u4"),)), bigrams, discounts(*(int(kinds.get(k, 0)) for k in (1, 2, 3, 4))), d1, spare, contexts, shards)

    sums = merged.mapInArrow(lambda b: _score(b, model), "batch long, info binary, sums binary")
    by_batch = sums.repartition(tasks, "batch").sortWithinPartitions("batch")
    return by_batch.mapInArrow(_documents, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"), model


def _fill(continued: DataFrame, path: str, size: int, ranges: int) -> str:
    """The table's path, with zeros for ranges of ids that no bigram reached."""
    spark = continued.sparkSession
    width = -(-(size + 2) // ranges)
    have = {r[0] for r in continued.select("part").collect()}  # a row a range
    missing = [r for r in range(ranges) if r not in have and r * width < size + 2]
    if missing:
        rows = [(r, bytes(4 * min(width, size + 2 - r * width))) for r in missing]
        whole = continued.select("part", "n").unionByName(spark.createDataFrame(rows, "part int, n binary"))
        _, path = materialize(whole, "lm-continuations-all")
    return path


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, model = fit_and_score(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.vocabulary.tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
