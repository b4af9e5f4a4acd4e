"""Caption files as a data source: ``spark.read.format("captions").load(folder)``.

A row a file of the folder (not of those below): what its name tells, and its payload.
The folder is dealt over ``slices`` tasks by the hash of a file's stem, so all tracks of
a lecture lie in one; each task lists the folder for itself and keeps its share, and the
driver holds no list of files. Filters on ``stem`` and ``caption_format`` are pushed
into the listing: a file that they leave out is not opened. Payloads are read in chunks
up to a ceiling, so a file that grew after it was listed is refused like one that was
too long before.

Options: ``path``; ``slices`` (16); ``payloads`` ("true"): "false" lists without opening
any file; ``most``: the ceiling in bytes.

Tier and language are what :func:`lectern.sources.files.tracks` makes of the names.

Edge cases: a file that is no caption by its name has no row. One over its ceiling, one
that is not UTF-8 and one that is gone again has a code instead of a payload. An empty
folder, or none, gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from lectern.functions.languages import FORMATS
from lectern.operators.parse import MAX_PAYLOAD
from lectern.sources.shared import workers_see_package
from lectern.sources.stores import Store, open_store

SCHEMA = "stem string, caption_format string, name string, path string, length long, payload string, code string"
SLICES = 16
#: Bytes of payloads that are handed on at once.
BATCH = 1 << 23
_ARROW = pa.schema([(c, pa.int64() if c == "length" else pa.string()) for c in ("stem", "caption_format", "name", "path", "length", "payload", "code")])


def read_text(store: Store, path: str, most: int = MAX_PAYLOAD) -> tuple[str | None, str | None]:
    """(UTF-8 without its mark, line ends as newlines; null) or (null, why not)."""
    try:
        data = store.read(path, most)
    except OSError:
        return None, "INPUT_UNREADABLE"
    if data is None:
        return None, "PAYLOAD_TOO_LARGE"
    try:
        return data.decode("utf-8").removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n"), None
    except UnicodeDecodeError:
        return None, "INPUT_UNREADABLE"


def share_of(stem: str, slices: int) -> int:
    return zlib.crc32(stem.encode("utf-8", "surrogateescape")) % slices


@dataclass
class Share(InputPartition):
    k: int
    of: int


class Captions(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captions"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CaptionReader:
        return CaptionReader(self.options)


class CaptionReader(DataSourceReader):
    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("captions are read from a path")
        self.path, self.slices = options["path"], int(options.get("slices", SLICES))
        self.open, self.most = options.get("payloads", "true").lower() != "false", int(options.get("most", MAX_PAYLOAD))
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in ("stem", "caption_format"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self) -> list[Share]:
        if "stem" in self.wanted:  # only their shares have rows
            return [Share(k, self.slices) for k in sorted({share_of(s, self.slices) for s in self.wanted["stem"]})]
        return [Share(k, self.slices) for k in range(self.slices)]

    def files(self, share: Share) -> Iterator[tuple[str, str, str, int]]:
        """(stem, format, name, length) of the share's files that no pushed filter leaves out."""
        for name, length in open_store(self.path).names():
            stem, dot, _ = name.partition(".")
            fmt = name.rpartition(".")[2].lower()
            told = {"stem": stem, "caption_format": fmt}
            if dot and fmt in FORMATS and share_of(stem, share.of) == share.k and all(told[c] in values for c, values in self.wanted.items()):
                yield stem, fmt, name, length

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        store, rows, size = open_store(self.path), [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)

        for stem, fmt, name, length in self.files(partition):
            payload, code = read_text(store, store.at(name), self.most) if self.open else (None, None)
            rows.append((stem, fmt, name, f"{self.path.rstrip('/')}/{name}", length, payload, code))
            size += len(payload or "") + 256
            if size >= BATCH:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()


def captions(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    """The caption files of a folder, with filters on stem and format pushed to their listing."""
    workers_see_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Captions)
    return spark.read.format("captions").options(path=folder, **{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}).load()


def payloads_of(chosen: DataFrame, ref: str = "ref", most: int = MAX_PAYLOAD) -> DataFrame:
    """chosen, with payload and code of the files that its column names; rows stay where they are."""
    workers_see_package(chosen.sparkSession)
    at = chosen.columns.index(ref)
    names = [*chosen.columns, "payload", "code"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores: dict[str, Store] = {}

        def batch(part: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*part.columns, *[pa.array(c, pa.string()) for c in zip(*found)]], names)

        for whole in batches:
            start, found, size = 0, [], 0
            for i, path in enumerate(whole.column(at).to_pylist()):
                folder, _, name = (path or "").rpartition("/")
                if folder not in stores:
                    stores[folder] = open_store(folder)
                found.append(read_text(stores[folder], stores[folder].at(name), most) if name else (None, "INPUT_UNREADABLE"))
                size += len(found[-1][0] or "")
                if size >= BATCH or i == whole.num_rows - 1:
                    yield batch(whole.slice(start, i + 1 - start), found)
                    start, found, size = i + 1, [], 0

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema)
    return chosen.mapInArrow(run, f"{kinds}, payload string, code string")
