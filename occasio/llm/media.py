"""Media columns: documents stored as lossless WebP images and read back."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import webp
from ._io import bounded, table
from ._text import pieces, raw

UNIT = 64


def pad(data: bytes) -> bytes:
    """``data`` with zero bytes up to the next positive multiple of 64."""
    return data + b"\0" * (-len(data) % UNIT if data else UNIT)


#: A longer payload is stored as several images, one after another: they are read together, so none should be much longer
#: than others, and no image's arrays grow with the text.
PART = 1 << 13
PIECE = 1 << 22


def _stored(payload: bytes) -> bytes:
    """The payload (a positive multiple of 64 bytes) as the samples of lossless WebP images, one for each ``PART``.

    Four bytes make a pixel (green, red, blue, alpha); the rectangle is filled up with zero pixels. Which transform an
    image has depends on its colours and on a checksum of its part.
    """
    out = []
    for at in range(0, len(payload), PART):
        part = payload[at : at + PART]
        n = len(part) // 4
        width, height = webp.image_size(n)
        c = np.zeros((width * height, 4), np.uint8)
        c[:n, [1, 2, 0, 3]] = np.frombuffer(part, np.uint8).reshape(-1, 4)
        out.append(webp.encode(c.view("<u4").ravel(), width, height, zlib.crc32(part)))
    return b"".join(out)


def store(payloads: list[bytes]) -> list[bytes]:
    """The stored form of each payload."""
    return [_stored(x) for x in payloads]


def images(media: bytes) -> Iterator[bytes]:
    """The WebP files that stand one after another."""
    at = 0
    while at < len(media):
        size = int.from_bytes(media[at + 4 : at + 8], "little") + 8
        if media[at : at + 4] != b"RIFF" or at + size > len(media):
            raise webp.WebPError("no whole RIFF container")
        yield media[at : at + size]
        at += size


def pixels(media: bytes) -> np.ndarray:
    """The (height, width, 4) R, G, B, A array of one image."""
    return webp.decode(media)


def load(media: list[bytes], sizes: list[int]) -> list[tuple[bytes, list[np.ndarray], Counter]]:
    """Of each stored value its payload, of the given size, the images' pixels, and what their streams were made of."""
    files = [list(images(x)) for x in media]
    got = iter(webp.decode_many([webp.chunk(x) for value in files for x in value]))
    out = []
    for value, n in zip(files, sizes):
        px, back, read = [], [], Counter()
        for i in range(len(value)):
            one, features = next(got)
            px.append(one)
            back.append(one.reshape(-1, 4)[: min(PART, n - i * PART) // 4, [1, 0, 2, 3]].tobytes())
            read.update(features)
        out.append((b"".join(back), px, read))
    return out


def difference_hash(px: list[np.ndarray]) -> str:
    """64 bits: on an 8 x 9 grid of mean luminance, whether each cell is darker than the next one in its row."""
    weights = np.array([0.299, 0.587, 0.114, 0.0], np.float32)
    grey = np.concatenate([one.reshape(-1, 4).astype(np.float32) @ weights for one in px])
    flat = np.linspace(0, len(grey), 73).astype(np.int64)
    sums = np.concatenate(([0.0], np.cumsum(grey, dtype=np.float64)))
    cells = (sums[flat[1:]] - sums[flat[:-1]]) / np.maximum(1, np.diff(flat))
    cells = np.round(cells, 6).reshape(8, 9)
    return f"{int(''.join('01'[int(x)] for x in (cells[:, 1:] > cells[:, :-1]).ravel()), 2):016x}"


#: What the stored images were made of, as the decoder met it.
FEATURES = ("palette", "predictor", "cross_colour", "references", "cached")
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, images int, width int, height int, " + ", ".join(f"{x} long" for x in FEATURES)


def _round_trip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, limit=PIECE):
            data, off = raw(part.column(1))
            texts = [data[off[i] : off[i + 1]].tobytes() for i in range(part.num_rows)]
            stored = store([pad(x) for x in texts])
            rows = []
            for text, media, (back, px, read) in zip(texts, stored, load(stored, [len(pad(x)) for x in texts])):
                rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(px), len(px), px[0].shape[1], px[0].shape[0], *(read[x] for x in FEATURES)))
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), *[pa.int64()] * len(FEATURES)]
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds)]], names=[x.split()[0] for x in SCHEMA.split(", ")])


def media_features(docs: DataFrame) -> DataFrame:
    """Each whole text as a lossless WebP image and what is read back from it.

    A null text counts as empty; an empty one is stored as 64 zero bytes; one longer than ``PART`` as several images
    (width and height are the first one's). Equal texts give equal values. Rows keep their doc_id, null or repeated ones
    too; other columns do not matter. Besides the contract's columns: how many images have each transform, and how many
    back-references and cached pixels were read. One narrow stage: no shuffle, memory for a few megabytes of texts or one
    text at a time.
    """
    return bounded(docs).select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(_round_trip, SCHEMA)


def encode_column(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``media`` (the WebP file or files), ``payload_bytes``; the stored form of the column."""

    def write(batches):
        for batch in batches:
            for part in pieces(batch):
                data, off = raw(part.column(1))
                padded = [pad(data[off[i] : off[i + 1]].tobytes()) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(store(padded), pa.binary()), pa.array([len(x) for x in padded], pa.int64())], names=["doc_id", "media", "payload_bytes"])

    return bounded(docs).select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(write, "doc_id long, media binary, payload_bytes long")


def decode_column(media: DataFrame) -> DataFrame:
    """``doc_id``, ``image``, ``width``, ``height``, ``pixels`` (R, G, B, A bytes, row after row): a row for each image
    of a column of WebP files, numbered from 0.

    A null or unreadable value gives one row with null pixels and the reason in ``error``.
    """

    def rows(data: bytes | None) -> list[tuple]:
        if data is None:
            return [(None, None, None, None, "null")]
        try:
            got = [pixels(x) for x in images(data)]
        except (webp.WebPError, IndexError) as e:
            return [(None, None, None, None, str(e))]
        return [(i, px.shape[1], px.shape[0], px.tobytes(), None) for i, px in enumerate(got)]

    def read(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                got = rows(batch.column(1)[k].as_py())
                doc = batch.column(0).slice(k, 1).take(pa.array([0] * len(got), pa.int64()))
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([doc, *(pa.array(c, t) for c, t in zip(zip(*got), kinds))], names=["doc_id", "image", "width", "height", "pixels", "error"])

    return bounded(media).select(media["doc_id"].cast("long"), "media").mapInArrow(read, "doc_id long, image int, width int, height int, pixels binary, error string")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))
