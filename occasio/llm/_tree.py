"""Fixed-size arrays gathered by tasks and merged as a tree, so that no task reads more than ``FAN_IN`` of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = 16
FAN_IN = 256
SCHEMA = "block long, part long, data binary"


def merged(df: DataFrame, gather: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int, dtype: type = np.float64, union: bool = False, sent: type | None = None) -> np.ndarray:
    """The sum (or bitwise union) of ``gather``'s arrays of ``size`` items over all partitions of ``df``.

    Each partition sends one array in BLOCKS pieces, as ``sent`` if one partition's numbers fit that; the driver gets
    BLOCKS pieces in the end.
    """
    sent = sent or dtype

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = gather(batches), TaskContext.get().partitionId()
        data = [x.tobytes() for x in total.astype(sent, copy=False).reshape(BLOCKS, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCKS)), pa.array([part] * BLOCKS, pa.int64()), pa.array(data, pa.binary())], names=["block", "part", "data"])

    def add(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                block, part, data = (c[i].as_py() for c in batch.columns)
                key, x = (block, part // FAN_IN), np.frombuffer(data, kind)
                if key not in total:
                    total[key] = x.astype(dtype)
                elif union:
                    total[key] |= x
                else:
                    total[key] += x
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in keys], pa.int64()), pa.array([p for _, p in keys], pa.int64()), pa.array([total[k].tobytes() for k in keys], pa.binary())], names=["block", "part", "data"])

    n = max(1, df.rdd.getNumPartitions())
    parts = df.mapInArrow(emit, SCHEMA)
    while True:
        parts = parts.repartition(min(BLOCKS * -(-n // FAN_IN), 4096), "block", F.floor(F.col("part") / FAN_IN)).mapInArrow(lambda batches, kind=sent: add(batches, kind), SCHEMA)
        n, sent = -(-n // FAN_IN), dtype
        if n == 1:
            break
    out = np.zeros((BLOCKS, size // BLOCKS), dtype)
    for r in parts.collect():  # BLOCKS rows
        out[r["block"]] = np.frombuffer(r["data"], dtype)
    return out.ravel()


def bloom_bits(keys: np.ndarray, bits: int) -> np.ndarray:
    """Places (three a key) of 64-bit keys in a filter of 2**bits bits."""
    k = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    k ^= k >> np.uint64(32)
    k *= np.uint64(0xD6E8FEB86659FD93)
    one, two = k >> np.uint64(64 - bits), (k * np.uint64(0xA0761D6478BD642F)) >> np.uint64(64 - bits)
    return np.stack([one, two, (one ^ (two * np.uint64(3) + np.uint64(7))) & np.uint64((1 << bits) - 1)]).astype(np.int64)


def bloom(df: DataFrame, bits: int = 23) -> np.ndarray:
    """A filter (uint8 array) of a long column: of one size whatever it holds; when full it only filters less."""

    def gather(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(1 << bits - 3, np.uint8)
        for batch in batches:
            at = bloom_bits(batch.column(0).to_numpy(), bits).ravel()
            np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return out

    return merged(df, gather, 1 << bits - 3, np.uint8, union=True)


def may_hold(flt: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = bloom_bits(keys, int(len(flt)).bit_length() + 2)
    return ((flt[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)
