"""Importance resampling towards a target: documents are drawn that look like the target's texts.

Words are runs of digits, letters and characters beyond ASCII, with A-Z lowered.
Features are all runs of one to three words joined by a space; a feature counts in the
bucket ``crc32 mod buckets``. A bucket's gain is the log-ratio of its smoothed shares in
target and source, in whole thousandths, and a document's weight the sum of its
features' gains. Gumbel noise from a hash of the id turns weights into scores whose
highest k are a draw without replacement.

The crc32 of a run follows from those of its words (appending n bytes is a linear map of
the 32 bits, kept as tables), so a word is hashed once and runs are a few array lookups.
Texts never move: both passes stay where texts are read. The first emits a count a
bucket and task, the second a few numbers a document.

The draw is exact without a global sort of documents: a histogram of the whole-number
scores is dealt by ranges, suffix sums over it (within ranges, and of the ranges' totals)
give the number of documents above each score, hence the cutoff score. Only documents at
or above it are shuffled, by score, and numbered by doc_id within it. The noise is fine
enough that no score can hold more than about 1/2700 of documents with different ids;
rows alike in all respects travel as one with a count.

Edge cases: null texts have no words, weight 0 and no rank (as all below ``least_words``).
A null doc_id takes the noise of an empty id and comes last among ties. Rows of one id
that tie are told apart by their other numbers; repeated rows take successive ranks. Empty
documents or target tables count no features. With fewer than 100 / percent eligible
documents none is drawn. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import MEMO, as_bytes, cut, workers_see_package

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Bytes of text that are cut into words at once.
PIECE = 1 << 22
#: Letters and digits as they count, bytes beyond ASCII as they are, all others a space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def _appended() -> tuple[np.ndarray, np.ndarray]:
    """Tables of the linear map that appending zero bytes makes of a crc32: by 0 to 255 bytes, and by 2**8, 2**9, ... bytes; each by byte of the crc."""
    byte = np.arange(256, dtype=np.uint32)
    one = byte.copy()
    for _ in range(8):
        one = np.where(one & np.uint32(1), (one >> np.uint32(1)) ^ np.uint32(0xEDB88320), one >> np.uint32(1))
    few = np.empty((256, 4, 256), np.uint32)
    few[0] = byte[None, :] << (np.arange(4, dtype=np.uint32) * np.uint32(8))[:, None]
    for n in range(1, 256):
        few[n] = one[few[n - 1] & np.uint32(255)] ^ (few[n - 1] >> np.uint32(8))
    by = one[few[255] & np.uint32(255)] ^ (few[255] >> np.uint32(8))
    many = [by]
    while len(many) < 24:
        many.append(_through(many[-1].ravel(), 0, many[-1]))
    return few.ravel(), np.stack([m.ravel() for m in many])


def _through(table: np.ndarray, at: np.ndarray | int, crc: np.ndarray) -> np.ndarray:
    """crc sent through the map whose four tables start at ``at``."""
    out = table[at + (crc & np.uint32(255)).astype(np.int64)]
    for k in (1, 2, 3):
        out = out ^ table[at + k * 256 + ((crc >> np.uint32(8 * k)) & np.uint32(255)).astype(np.int64)]
    return out


_FEW, _MANY = _appended()


def append(crc: np.ndarray, of: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of A followed by B, from those of A and B and the size of B in bytes."""
    out = _through(_FEW, (size & 255) * 1024, crc)
    rest, k = size >> 8, 0
    while rest.any():
        odd = np.flatnonzero(rest & 1)
        out[odd] = _through(_MANY[k], 0, out[odd])
        rest, k = rest >> 1, k + 1
    return out ^ of


class _Seen(dict):
    """Word -> crc32 and, above 32 bits, size; remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        found = self[word] = zlib.crc32(word) | len(word) << 32
        return found


def _pieces(data: bytes) -> Iterator[bytes]:
    """data in pieces of about PIECE bytes that part no word."""
    at = 0
    while len(data) - at > PIECE:
        end = data.rfind(b" ", at, at + PIECE) + 1
        end = end or data.find(b" ", at + PIECE) + 1 or len(data)
        yield data[at:end]
        at = end
    yield data[at:]


_BLANK = np.uint32(zlib.crc32(b" "))


def runs(texts: list[bytes], seen: _Seen, longest: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(ends of the texts among all their words, for each length the crc32 of the run that starts at each word and whether it ends in the same text)."""
    found, ends = [], [0]
    for data in texts:
        own = [np.fromiter(map(seen.__getitem__, words), np.int64, len(words)) for words in map(bytes.split, _pieces(data.translate(_WORDS)))]
        found += own
        ends.append(ends[-1] + sum(map(len, own)))
    packed = np.concatenate(found) if found else np.empty(0, np.int64)
    crc, size, ends = packed.astype(np.uint32), packed >> 32, np.array(ends)
    text = np.repeat(np.arange(len(texts)), np.diff(ends))
    after = append(np.full(len(crc), _BLANK), crc, size)  # of a space and the word
    out, now = [(crc, np.ones(len(crc), bool))], crc
    for n in range(1, longest):
        now = append(now[: max(len(crc) - n, 0)], after[n:], size[n:] + 1)
        out.append((now, text[n:] == text[: max(len(text) - n, 0)]))
    return ends, out


def _slices(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, texts): texts of about PIECE bytes together."""
    start, held, size = 0, [], 0
    for at, value in enumerate(column):
        held.append(value.as_py())
        size += len(held[-1])
        if size >= PIECE:
            yield start, held
            start, held, size = at + 1, [], 0
    if held:
        yield start, held


def counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features by bucket over all rows: one number a bucket comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = _Seen(), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, some in _slices(batch.column(0)):
                for crc, whole in runs(some, seen, longest)[1]:
                    total += np.bincount(crc[whole] % np.uint32(buckets), minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(total[hit])], ["bucket", "n"])

    found = np.zeros(buckets, np.int64)
    for bucket, n in texts.select(as_bytes(F.col(text)).alias("data")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        found[bucket] = n
    return found


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log-ratio of each bucket's smoothed shares."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_features, weight of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            for start, some in _slices(batch.column(1)):
                ends, found = runs(some, seen, longest)
                total, features = np.zeros(ends[-1] + 1, np.int64), np.zeros(ends[-1] + 1, np.int64)
                for crc, whole in found:
                    total[1 : len(crc) + 1] += np.where(whole, gain[crc % np.uint32(len(gain))], 0)
                    features[1 : len(crc) + 1] += whole
                columns = [pa.array(np.diff(ends)), *[pa.array(np.diff(np.cumsum(x)[ends])) for x in (features, total)]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(some)), *columns], ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), as_bytes(F.col(text)).alias("data")).mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in whole thousandths, from a hash of the seed and the id."""
    h = F.conv(F.substr(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), F.lit(1), F.lit(8)), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def standing(scores: DataFrame) -> DataFrame:
    """(score) -> score, n, above: the documents with each score and with a higher one, written to the shared folder."""
    spark = scores.sparkSession
    deal = int(spark.conf.get("spark.sql.shuffle.partitions"))
    histogram = scores.groupBy("score").agg(F.count("*").alias("n"))
    dealt = cut(histogram.repartitionByRange(deal, F.col("score").desc()).withColumn("part", F.spark_partition_id()), "histogram")
    before, offsets = 0, []
    for part, n in dealt.groupBy("part").agg(F.sum("n")).orderBy("part").collect():  # as many rows as the histogram has parts
        offsets.append((part, before))
        before += n
    within = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = F.broadcast(spark.createDataFrame(offsets, "part int, before long"))
    return dealt.join(known, "part").select("score", "n", (F.col("before") + within).alias("above"))


def draw(scored: DataFrame, k: int, stand: DataFrame, eligible: Column) -> DataFrame:
    """scored and ``rank``: 1, 2, 3 ... for the k highest scores among eligible rows, by doc_id where they tie; null for all others."""
    cutoff = stand.where(F.col("above") < k).agg(F.min("score")).first()[0]
    none = F.lit(None).cast("long").alias("rank")
    if cutoff is None:
        return scored.select("*", none)
    drawn = eligible & (F.col("score") >= cutoff)
    alike = scored.where(drawn).groupBy(*scored.columns).agg(F.count("*").alias("alike")).join(stand.where(F.col("above") < k).select("score", "above"), "score")
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_words", "n_features", "weight").rowsBetween(Window.unboundedPreceding, 0)
    numbered = alike.withColumn("last", F.col("above") + F.sum("alike").over(order))
    ranked = numbered.select(*scored.columns, F.explode(F.sequence(F.col("last") - F.col("alike") + 1, F.col("last"))).alias("rank"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return scored.where(~drawn).select("*", none).unionByName(ranked)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED, text: str = "text", doc_id: str = "doc_id", target_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank: all documents, of which percent out of 100 with least_words or more are drawn (rank not null)."""
    workers_see_package(docs.sparkSession)
    gain = gains(counts(docs, text, buckets, longest), counts(target, target_text, buckets, longest))
    weighed = weigh(docs, gain, longest, text, doc_id)
    scored = cut(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    eligible = F.col("n_words") >= least_words
    stand = standing(scored.where(eligible).select("score"))
    n = stand.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return draw(scored, percent * n // 100, stand, eligible)
