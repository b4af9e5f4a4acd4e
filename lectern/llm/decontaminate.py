"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are put into size classes (their shingle counts, by powers of two) and each
class keeps the min-wise values of its items. A document is cut into windows of twice
a class's size at steps of that size, so that a passage as long as an item of the class
lies wholly in some window, and a window is never much larger than the item: the
Jaccard of item and window is then at least about a fifth where the item is contained.
An item is a candidate if it shares any min-wise value with a window of its class
(one row a band; the number of bands follows from the recall wanted). Windows of all
classes come from the same minima over blocks of 16 shingles, so a document is hashed
once. Items of fewer than 8 shingles would fill too little of the smallest window; they
are looked up by so many of their shingles that a document with threshold of the item
has one of these. Each candidate is verified exactly: |item and document| / |item| on the shingle
sets of the whole item and the whole document.

Items travel to the tasks in blocks of at most BLOCK_ITEMS; more items mean more
passes over the documents, never a larger broadcast: what a block finds is written to
the shared folder before the next but one is read, so that driver and executors never
hold more than two. Documents are not shuffled.

Recall is that of items whose shared shingles lie together in the document, as those of
a copied passage do: 0.9999 from 8 shingles, and 1 below.

Edge cases: null or empty documents and items contain and match nothing. Items of fewer
than n words match documents of exactly these words. Repeated rows of documents each
match; repeated items each match. Empty tables give no rows. Other columns are ignored
by :func:`find` and pass through :func:`drop_contaminated`.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lectern.llm.common import SHINGLE, SIMILAR, MinHash, as_bytes, cut, shingles, workers_see_package

RECALL = 0.9999
BLOCK_ITEMS = 20_000
BASE = 16
_BITS = 20


def functions_for(threshold: float, recall: float = RECALL) -> int:
    """Min-wise values needed when an item fills a quarter of its window and shares threshold of itself."""
    jaccard = threshold * 0.5 / (2 + 0.5 - threshold * 0.5)
    return math.ceil(math.log(1 - recall) / math.log1p(-jaccard))


class Items:
    """A block of test items, ready for search."""

    def __init__(self, rows: list[tuple], threshold: float, n: int):
        self.threshold, self.n = threshold, n
        self.ids, self.sets = [], []
        for item_id, data in rows:
            s = np.unique(shingles(data, n))
            if len(s):
                self.ids.append(item_id)
                self.sets.append(s)
        self.minhash = MinHash(functions_for(threshold))
        self.classes: dict[int, tuple[np.ndarray, dict]] = {}
        by_class: dict[int, list[int]] = defaultdict(list)
        self.short, self.short_bits = defaultdict(list), np.zeros(1 << _BITS, bool)
        for i, s in enumerate(self.sets):
            if len(s) < BASE // 2:
                some = s[: len(s) - max(1, math.ceil(threshold * len(s) - 1e-9)) + 1]
                self.short_bits[some >> np.uint64(64 - _BITS)] = True
                for h in some.tolist():
                    self.short[h].append(i)
                continue
            by_class[max(0, math.ceil(math.log2(len(s) / BASE)))].append(i)
        salt = np.arange(len(self.minhash.a), dtype=np.uint32) * np.uint32(0x9E3779B1)
        self.salt = salt[:, None]
        for c, members in by_class.items():
            bits, at = np.zeros(1 << _BITS, bool), defaultdict(list)
            for i in members:
                sig = self.minhash.signature(self.sets[i])
                bits[(sig ^ salt) >> np.uint32(32 - _BITS)] = True
                for k, v in enumerate(sig.tolist()):
                    at[k, v].append(i)
            self.classes[c] = (bits, dict(at))

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        """Min-wise values of each block of BASE shingles."""
        out = []
        for i in range(0, len(hashes), 512 * BASE):
            part = self.minhash.values(hashes[i : i + 512 * BASE])
            out.append(np.minimum.reduceat(part, np.arange(0, part.shape[1], BASE), axis=1))
        return np.concatenate(out, axis=1)

    def candidates(self, hashes: np.ndarray) -> set[int]:
        found: set[int] = set()
        if self.short:
            for h in hashes[self.short_bits[hashes >> np.uint64(64 - _BITS)]].tolist():
                found.update(self.short.get(h, ()))
        if not self.classes:
            return found
        level, step = self.minima(hashes), 0
        for c in range(max(self.classes, default=-1) + 1):
            while step < c:  # two blocks become one of the next class's step
                if level.shape[1] % 2:
                    level = np.concatenate([level, level[:, -1:]], axis=1)
                level, step = np.minimum(level[:, ::2], level[:, 1::2]), step + 1
            if c in self.classes:
                bits, at = self.classes[c]
                window = np.minimum(level[:, :-1], level[:, 1:]) if level.shape[1] > 1 else level
                k, w = np.nonzero(bits[(window ^ self.salt) >> np.uint32(32 - _BITS)])
                for key in zip(k.tolist(), window[k, w].tolist()):
                    found.update(at.get(key, ()))
        return found

    def search(self, data: bytes) -> list[tuple]:
        """(item_id, shared, size) of the items that the text contains."""
        hashes = shingles(data, self.n)
        if not len(hashes) or not self.ids:
            return []
        out, own = [], None
        for i in sorted(self.candidates(hashes)):
            own = np.unique(hashes) if own is None else own
            shared = len(np.intersect1d(own, self.sets[i], assume_unique=True))
            if shared >= self.threshold * len(self.sets[i]) - 1e-9:
                out.append((self.ids[i], shared, len(self.sets[i])))
        return out


def item_blocks(items: DataFrame, threshold: float, n: int, size: int = BLOCK_ITEMS, text: str = "text", item_id: str = "item_id"):
    """Broadcasts of Items of at most size items each."""
    sc = items.sparkSession.sparkContext
    rows = ((r[0], bytes(r[1])) for r in items.select(item_id, as_bytes(F.col(text))).toLocalIterator())
    while block := list(islice(rows, size)):
        yield sc.broadcast(Items(block, threshold, n))


def find(docs: DataFrame, items: DataFrame, threshold: float = SIMILAR, n: int = SHINGLE, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id, item_id, n_shared, n_item (shingles), containment: a row per document and contained item."""
    workers_see_package(docs.sparkSession)
    kinds = [docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()]
    types = [to_arrow_type(items.schema[item_id].dataType), pa.int64(), pa.int64()]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, n_shared long, n_item long"

    def against(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                hits = [(j, *hit) for j, data in enumerate(batch.column(1)) for hit in index.search(data.as_py())]
                cols = list(zip(*hits)) or [()] * 4
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), *[pa.array(c, t) for c, t in zip(cols[1:], types)]], ["doc_id", "item_id", "n_shared", "n_item"])

        return docs.select(F.col(doc_id).alias("doc_id"), as_bytes(F.col(text)).alias("data")).mapInArrow(run, schema)

    blocks = item_blocks(items, threshold, n, block_items, text, item_id)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        out = against(first) if first else docs.sparkSession.createDataFrame([], schema)
    else:
        out = None
        for block in chain([first, second], blocks):
            part = cut(against(block), "found")
            block.destroy()
            out = out.union(part) if out is not None else part
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = SIMILAR, n: int = SHINGLE, text: str = "text", item_text: str = "text", item_id: str = "item_id", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of docs that contain no test item, with all their columns."""
    workers_see_package(docs.sparkSession)
    at = docs.columns.index(text)

    def without(df: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                yield batch.filter(pa.array([not (x.is_valid and index.search(x.as_py().encode())) for x in batch.column(at)], pa.bool_()))

        return df.mapInArrow(run, df.schema)

    blocks = item_blocks(items, threshold, n, block_items, item_text, item_id)
    block = next(blocks, None)
    while block:
        left, after = without(docs, block), next(blocks, None)
        if after:
            left = cut(left, "left")
            block.destroy()
        docs, block = left, after
    return docs
