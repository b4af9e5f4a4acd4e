"""N-gram Jaccard self-join by MinHash banding, whole and without pair rows.

1. Every text gets a MinHash signature, folded to one hash per band. Equal texts meet in
   one row per text (partial aggregation, so a group of copies costs one row a task).
2. Band hashes are shuffled; each text is linked to the least text of every bucket that
   it shares. The components of these links hold all candidate pairs. Where texts that
   are only somewhat alike have run together into a large component, its texts are
   banded again with longer bands, which few unlike pairs share.
3. Inside a component all pairs are verified on full shingle sets. A large component is
   dealt into blocks: texts by size class (sizes further apart than the threshold cannot
   reach it) and then by hash, and one task verifies one pair of blocks, tile by tile. It
   returns a row per text: its links and a root for its linked texts, never the pairs.
   Blocks grow with the square root of their class, so that of n texts each is shipped
   about sqrt(n / BLOCK_TEXTS) times, up to what a task holds.
4. Components of the verified links are the classes.

Bands and rows follow from the recall wanted at the threshold, see :func:`bands_for`.
No bucket, component or partner list is capped; very frequent buckets and labels meet
their rows by broadcast. Work inside one component grows with the square of its
*distinct* texts, since every link is counted; memory does not.

Edge cases: a null or empty text has no shingles and links only to its own copies;
texts of fewer than n words have one shingle and link where all words agree. Rows that
repeat count as copies. A null doc_id takes part; class_id is the least non-null doc_id
of the class (null if there is none). An empty table gives no rows. Other columns are
ignored by :func:`near_duplicates` and pass through :func:`keep_one`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import SHINGLE, SIMILAR, MinHash, as_bytes, copy_key, cut, join_hot, row_key, shingles, workers_see_package
from lectern.llm.components import connected_components

RECALL = 0.9999
MOST_HASHES = 128
#: Min-wise values for texts of large components.
MORE_HASHES = 512
#: What is compared at once, and what a component must exceed to be large: texts, and shingles in all.
TILE_TEXTS, TILE_SHINGLES = 768, 500_000
#: A class of n texts is cut into blocks of about the square root of n times this many.
BLOCK_TEXTS = 256
#: Most shingles of one block; a task holds two.
BLOCK_SHINGLES = 4_000_000


def bands_for(threshold: float, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band whose bands, as many as the recall needs, stay under most values.

    1 - (1 - threshold^rows)^bands >= recall. More rows let fewer unlike pairs through.
    """
    best = (1, 1)
    for rows in range(1, most + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def signatures(texts: DataFrame, bands: int, rows: int, n: int = SHINGLE) -> DataFrame:
    """(key, id, data) -> key, id, size (distinct shingles), band hashes (empty without shingles)."""
    workers_see_package(texts.sparkSession)
    minhash = MinHash(bands * rows)
    odd = np.array([pow(0x9E3779B97F4A7C15, i + 1, 2**64) | 1 for i in range(rows)], dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, hashes, counts = [], [], [0]
            for data in batch.column("data"):
                s = np.unique(shingles(data.as_py(), n))
                sizes.append(len(s))
                if len(s):
                    sig = minhash.signature(s).astype(np.uint64).reshape(bands, rows)
                    h = (sig * odd).sum(axis=1, dtype=np.uint64)
                    hashes.append((h ^ (h >> np.uint64(31))).view(np.int64))
                counts.append(bands * bool(len(s)))
            flat = pa.array(np.concatenate(hashes) if hashes else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), pa.array(sizes, pa.int64()), lists], ["key", "id", "size", "bands"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("key", "id", "data").mapInArrow(run, f"key binary, id {kind}, size long, bands array<long>")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """|a and b| for all pairs of sorted sets of hashes."""
    n = len(sets)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
    times = np.diff(np.r_[first, len(every)])
    keep = np.repeat(times >= 2, times)
    col = np.repeat(np.cumsum(times >= 2) - 1, times)[keep]
    owner, out, width = owner[keep], np.zeros((n, n), np.float32), 1024 if n > 64 else 16384
    for i in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        a, b = np.searchsorted(col, [i, i + width])
        x = np.zeros((n, min(width, int(col[b - 1]) + 1 - i)), np.float32)
        x[owner[a:b], col[a:b] - i] = 1
        out += x @ x.T
    return out


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """A boolean matrix: Jaccard of each pair >= threshold; the diagonal is False."""
    both = shared_counts(sets).astype(np.float64)
    size = np.array([len(s) for s in sets], np.float64)
    out = both * (1 + threshold) >= threshold * (size[:, None] + size[None, :]) - 1e-6
    np.fill_diagonal(out, False)
    return out


def roots(adjacent: np.ndarray) -> np.ndarray:
    """For each vertex the least vertex of its component."""
    n = len(adjacent)
    label = np.arange(n)
    while True:
        near = np.where(adjacent, label[None, :], n).min(axis=1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def tiles(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of at most TILE_TEXTS texts and, but for single texts, TILE_SHINGLES shingles."""
    out, start, held = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and (i - start >= TILE_TEXTS or held + n > TILE_SHINGLES):
            out.append((start, i))
            start, held = i, 0
        held += n
    return [*out, (start, len(sizes))] if len(sizes) else out


def _verify(threshold: float, n: int):
    def run(pdf):
        import pandas as pd

        pdf = pdf.drop_duplicates("key", ignore_index=True).sort_values(["side", "key"], kind="stable", ignore_index=True)
        sets = [np.unique(shingles(d, n)) for d in pdf.pop("data")]
        sizes = np.array([len(s) for s in sets])
        side, copies = pdf["side"].to_numpy(), pdf["copies"].to_numpy(np.float64)
        two = len(sets) and side[0] != side[-1]  # two blocks: pairs inside one are another group's
        weight, root = np.zeros(len(sets)), np.arange(len(sets))
        parts = tiles(sizes)
        for k, (a, b) in enumerate(parts):
            for c, d in parts[k:]:
                if two and side[a] == side[d - 1] or sizes[a:b].max() < threshold * sizes[c:d].min() or sizes[c:d].max() < threshold * sizes[a:b].min():
                    continue
                at = np.r_[a:b, c:d] if a != c else np.arange(a, b)
                adjacent = linked([sets[i] for i in at], threshold)
                if two:
                    adjacent &= side[at][:, None] != side[at][None, :]
                if a != c:  # pairs inside a tile have their turn
                    adjacent[: b - a, : b - a] = adjacent[b - a :, b - a :] = False
                weight[at] += adjacent @ copies[at]
                root = merged(root, at, roots(adjacent))
        has = weight > 0
        keys = pdf["key"].to_numpy()
        return pd.DataFrame({"key": keys[has], "links": weight[has].round().astype("int64"), "root": keys[root[has]]})

    return run


def merged(root: np.ndarray, at: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Labels of all texts after those at ``at`` were found to hang together as own says; a label is a text of its component."""
    root = root.copy()
    for i, j in zip(root[at].tolist(), root[at[own]].tolist()):
        i, j = int(root[i]), int(root[j])
        if i != j:
            root[root == max(i, j)] = min(i, j)
    return root


def candidates(texts: DataFrame) -> DataFrame:
    """texts(key, bands) -> (id, label): components of texts that share a band's bucket.

    A bucket stands for its least text. A text is linked to the least of its buckets'
    texts, and these to that one, so that texts alike give the same links but for their own.
    """
    rows = texts.select("key", F.posexplode("bands").alias("band", "hash"))
    buckets = cut(rows.groupBy("band", "hash").agg(F.min("key").alias("v"), F.count("*").alias("n")).where("n > 1"), "buckets")
    shared = join_hot(rows, buckets.drop("n"), ["band", "hash"], counts=buckets.select("band", "hash", "n"))
    of_text = shared.groupBy("key").agg(F.collect_set("v").alias("vs")).select("key", "vs", F.array_min("vs").alias("m"))
    links = F.concat(F.array(F.struct(F.col("key").alias("u"), F.col("m").alias("v"))), F.transform("vs", lambda v: F.struct(v.alias("u"), F.col("m").alias("v"))))
    return connected_components(of_text.select(F.inline(links)))


def is_large() -> Column:
    """Whether a component of n texts and s shingles is more than one comparison."""
    return (F.col("n") > TILE_TEXTS) | (F.col("s") > TILE_SHINGLES)


def components(texts: DataFrame, base: DataFrame, threshold: float, n: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """texts(key, size, bands, rep), base(id, key, data) -> (key, comp), and key, data of these: all linked pairs share a component.

    Texts of large components are banded again.
    """
    first = cut(candidates(texts).select(F.col("id").alias("key"), F.col("label").alias("comp")), "components")
    data = cut(whole_texts(first, texts, base), "candidates")
    total = first.join(texts.select("key", "size"), "key").groupBy("comp").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    large = cut(join_hot(first, total.where(is_large()).select("comp"), ["comp"], counts=total.select("comp", "n")).select("key"), "large")
    if large.isEmpty():
        return first, data
    bands, rows = bands_for(threshold, recall, MORE_HASHES)
    again = signatures(data.join(large, "key", "left_semi").withColumn("id", F.lit(0)), bands, rows, n)
    split = candidates(cut(again, "again")).select(F.col("id").alias("key"), F.col("label").alias("comp"))
    return cut(first.join(large, "key", "left_anti").unionByName(split), "components"), data


def whole_texts(chosen: DataFrame, texts: DataFrame, base: DataFrame) -> DataFrame:
    """key, data of the chosen keys: of rows that share a text only those of the least id are shuffled. Rows alike in both are all there."""
    rows = chosen.join(texts.select("key", "rep"), "key").select(row_key(F.col("rep"), F.col("key")).alias("row"))
    return base.withColumn("row", row_key(F.col("id"), F.col("key"))).join(rows, "row", "left_semi").select("key", "data")


def blocks(members: DataFrame, threshold: float) -> DataFrame:
    """members(comp, key, size, ...) -> a row for each group of pairs that a text must meet in: adds pair, side.

    Components that are no more than one comparison are one group. In others a text
    stands in a size class and, within it, in a block chosen by its hash; it meets all
    blocks of its own class and of the two next to it. A class of n texts has about
    sqrt(n / BLOCK_TEXTS) blocks, or as many as its shingles need.
    """
    total = members.groupBy("comp").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    m = cut(join_hot(members, total, ["comp"], counts=total.select("comp", "n")), "totals")
    small, large = m.where(~is_large()).drop("n", "s"), m.where(is_large()).drop("n", "s")
    # a hair wider than 1 / threshold, so that rounding cannot put a pair two classes apart
    large = large.withColumn("cls", F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / math.log(1 / threshold * 1.0001)).cast("int"))
    n, s = F.col("n"), F.col("s")
    k = F.greatest(F.ceil(n / F.sqrt(n * BLOCK_TEXTS)), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    per = large.groupBy("comp", "cls").agg(F.count("*").alias("n"), F.sum("size").alias("s")).select("comp", "cls", k.alias("k"))
    near = per.select("comp", (F.col("cls") + 1).alias("cls"), F.col("k").alias("below")).join(per, ["comp", "cls"], "right").join(per.select("comp", (F.col("cls") - 1).alias("cls"), F.col("k").alias("above")), ["comp", "cls"], "left")
    own = F.pmod(F.xxhash64("key"), F.col("k")).cast("int")
    none = F.array().cast("array<struct<a:string,b:string>>")
    name = lambda cls, i: F.concat_ws(".", cls.cast("string"), i.cast("string"))
    upto = lambda k, f: F.when(k > 0, F.transform(F.sequence(F.lit(0), k - 1), f)).otherwise(none)
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    cls, i = F.col("cls"), F.col("own")
    meets = F.concat(
        upto(F.col("k"), lambda j: pair(name(cls, F.least(i, j)), name(cls, F.greatest(i, j)))),
        upto(F.coalesce("above", F.lit(0)), lambda j: pair(name(cls, i), name(cls + 1, j))),
        upto(F.coalesce("below", F.lit(0)), lambda j: pair(name(cls - 1, j), name(cls, i))),
    )
    dealt = join_hot(large, near, ["comp", "cls"]).withColumn("own", own).withColumn("meet", F.explode(meets))
    cols = members.columns
    return small.select(*cols, F.lit("").alias("pair"), F.lit("").alias("side")).union(dealt.select(*cols, F.concat_ws("/", "meet.a", "meet.b").alias("pair"), name(cls, i).alias("side")))


def near_duplicates(docs: DataFrame, threshold: float = SIMILAR, n: int = SHINGLE, recall: float = RECALL, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, key (of the text), class_id, copy_of (least doc_id with the same text), n_links: one row per row of docs.

    n_links counts the other rows, copies included, whose texts have a Jaccard of at
    least threshold; class_id is the least doc_id of the rows linked directly or not.
    """
    bands, rows = bands_for(threshold, recall)
    base = docs.select(F.col(doc_id).alias("id"), copy_key(F.col(text)).alias("key"), as_bytes(F.col(text)).alias("data"))
    sig = cut(signatures(base, bands, rows, n), "signatures")
    texts = cut(sig.groupBy("key").agg(F.count("*").alias("copies"), F.min("id").alias("rep"), F.first("size").alias("size"), F.first("bands").alias("bands")), "texts")
    comp, data = components(texts, base, threshold, n, recall)
    members = cut(comp.join(texts.select("key", "copies", "rep", "size"), "key"), "members")
    dealt = blocks(members, threshold)
    groups = dealt.select("comp", "pair", "side", "key", "copies").join(data, "key")
    found = cut(groups.groupBy("comp", "pair").applyInPandas(_verify(threshold, n), "key binary, links long, root binary"), "links")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    label = connected_components(found.select(F.col("key").alias("u"), F.col("root").alias("v")))
    in_class = label.withColumnRenamed("id", "key").join(texts.select("key", "rep"), "key")
    first = in_class.groupBy("label").agg(F.min("rep").alias("class_id"))
    of_key = texts.select("key", "copies", "rep").join(join_hot(in_class, first, ["label"]).select("key", "class_id"), "key", "left").join(links, "key", "left")
    of_key = of_key.select("key", F.coalesce("class_id", "rep").alias("class_id"), F.col("rep").alias("copy_of"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rows = sig.select(F.col("id").alias("doc_id"), "key")
    # a group of copies may hold a third of all rows
    return join_hot(rows, of_key, ["key"], counts=texts.select("key", F.col("copies").alias("n"))).select("doc_id", "key", "class_id", "copy_of", "n_links")


def keep_one(docs: DataFrame, threshold: float = SIMILAR, n: int = SHINGLE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The row with the least doc_id of each class, with its own columns; of rows that tie, one.

    Rows are chosen by doc_id and text key; whole rows move once, to meet what was chosen.
    """
    classes = near_duplicates(docs, threshold, n, text=text, doc_id=doc_id)
    alike = classes.groupBy("class_id", F.when(F.col("class_id").isNull(), F.col("key")).alias("k"), "doc_id", "key").agg(F.count("*").alias("n"))
    first = alike.groupBy("class_id", "k").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "key", "n")).alias("f")).select("f.*")
    first = cut(first.select(row_key(F.col("doc_id"), F.col("key")).alias("__at"), "n"), "chosen")
    whole = docs.select(F.struct(*docs.columns).alias("__row"), row_key(F.col(doc_id), copy_key(F.col(text))).alias("__at"))
    found = whole.join(first.select("__at"), "__at")
    if not first.where("n > 1").isEmpty():  # rows alike in doc_id and text
        found = found.groupBy("__at").agg(F.first("__row").alias("__row"))
    return found.select("__row.*")
