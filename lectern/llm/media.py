"""Media columns: payloads stored as lossless WebP images, and images read into pixel arrays.

:func:`store` writes any bytes as grey images, one 8-bit sample a byte, SIDE samples a
row; :func:`pixels` reads a column of WebP files into pixel arrays, whoever wrote them;
:func:`samples` reads stored payloads back. A payload that is longer than the tallest
image lies in several files, one after another in the column's value, so memory is
bounded by an image besides the value itself. :mod:`lectern.llm.webp` has the format.

What an image is stored as depends on its bytes alone: a palette where there are at most
16 different ones, else subtracted green, prefix codes fitted to it, and copies where
they pay. Rows never leave their task; nothing is shuffled.

Edge cases: a null or empty text's payload is SIDE zeros. A null or empty media value has no images and
so no row of :func:`pixels`, and a null payload. A damaged file has a row with null
width, height and pixels, and a null payload. Repeated rows are each stored. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import webp
from lectern.llm.common import as_bytes, cut, workers_see_package

SIDE = 64
#: Rows that a task holds the results of.
ROWS = 256
_GREY = np.arange(256, dtype=np.uint32) * np.uint32(0x010101) | np.uint32(webp.BLACK)


def payload_of(data: bytes) -> bytes:
    """data and zeros up to a positive multiple of SIDE."""
    return data + bytes(-len(data) % SIDE if data else SIDE)


def stored(payload: bytes) -> bytes:
    """A payload as WebP files one after another."""
    one = SIDE * webp.MOST_SIDE
    return b"".join(webp.encode(_GREY[np.frombuffer(payload, np.uint8, min(one, len(payload) - at), at)].reshape(-1, SIDE)) for at in range(0, len(payload), one))


def read(media: bytes | None) -> bytes | None:
    """The samples of a value that :func:`stored` made."""
    if not media:
        return None
    try:
        return b"".join(webp.decode(file).astype(np.uint8).tobytes() for file in webp.split(media))
    except ValueError:
        return None


def feature(payload: bytes) -> str:
    """A mean hash: 64 bits, for each 64th of the samples whether its mean is above that of all; as hex digits."""
    means = np.frombuffer(payload, np.uint8).reshape(64, -1).mean(axis=1, dtype=np.float64)
    return np.packbits(means > means.mean()).tobytes().hex()


def _mapped(df: DataFrame, kinds: dict[str, pa.DataType], of) -> DataFrame:
    """The columns before the last, and for each row those that ``of`` makes of the last one's bytes: a list of tuples."""
    key, value = df.columns
    schema = pa.schema([(k, t) for k, t in kinds.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = [of(x.as_py()) for x in part.column(1)]
                places = pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int64())
                columns = list(zip(*[row for rows in found for row in rows])) or [()] * len(schema)
                yield pa.RecordBatch.from_arrays([part.column(0).take(places), *[pa.array(c, t) for c, t in zip(columns, schema.types)]], [key, *schema.names])

    spark_kinds = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string", pa.list_(pa.int32()): "array<int>"}
    return df.mapInArrow(run, ", ".join([f"`{key}` {df.schema[key].dataType.simpleString()}", *[f"{k} {spark_kinds[t]}" for k, t in kinds.items()]]))


def store(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, media: each whole text as WebP images."""
    workers_see_package(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), as_bytes(F.col(text)).alias("data"))
    return _mapped(rows, {"n_bytes": pa.int64(), "media": pa.binary()}, lambda data: [(len(data), stored(payload_of(data)))])


def pixels(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """key, image (from 0 within a value), width, height, pixels (ARGB as signed 32-bit numbers, row by row)."""
    workers_see_package(media.sparkSession)

    def of(value: bytes | None) -> list[tuple]:
        out = []
        for k, file in enumerate(webp.split(value or b"")):
            try:
                image = webp.decode(file)
                out.append((k, image.shape[1], image.shape[0], image.ravel().view(np.int32)))
            except ValueError:
                out.append((k, None, None, None))
        return out

    kinds = {"image": pa.int32(), "width": pa.int32(), "height": pa.int32(), "pixels": pa.list_(pa.int32())}
    return _mapped(media.select(F.col(key).alias(key), F.col(column).cast("binary").alias("value")), kinds, of)


def samples(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """key, payload: the samples that :func:`store` put into images."""
    workers_see_package(media.sparkSession)
    return _mapped(media.select(F.col(key).alias(key), F.col(column).cast("binary").alias("value")), {"payload": pa.binary()}, lambda value: [(read(value),)])


def digests(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media -> doc_id, n_bytes and what the stored bytes say once read: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    workers_see_package(media.sparkSession)

    def of(value: bytes | None) -> list[tuple]:
        payload, own = read(value), value or b""
        if payload is None:
            return [(None, None, None, len(own), hashlib.sha256(own).hexdigest(), None)]
        return [(len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(own), hashlib.sha256(own).hexdigest(), feature(payload))]

    kinds = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}
    rows = media.select(F.struct("doc_id", "n_bytes").alias("of"), "media")
    return _mapped(rows, kinds, of).select("of.doc_id", "of.n_bytes", *kinds)


def stored_and_read(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each text written to a media column of a table in the shared folder, and that table's digests."""
    return digests(cut(store(docs, text, doc_id), "media"))
