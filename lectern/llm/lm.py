"""Scoring texts by a Brown class-based trigram model with exchange clustering.

Tokens are words (A-Z lowered, split at 0x20 and 0x09-0x0D) and one end a text. The
model predicts a token's class from the classes of the two tokens before it, and the
token from its class: P(class | two classes before) * P(token | class). Trigrams of
classes lean on bigrams and these on single classes, each with the weight of SMOOTH
tokens.

Every training word seen ``least`` times or more has a class, so the classed vocabulary
grows with the corpus. Classes come from the exchange algorithm: first word by word on
the counted pairs of the most frequent words, then in rounds over all classed words at
once, in which each moves to the class that fits the counted classes of its neighbours
best while the others stay (distributed exchange, after Uszkoreit and Brants 2008). A
round that does not raise the likelihood is not taken. Words seen less often share a
rare class, in which each has its own smoothed frequency; the end has a class to itself.

Words seen twice or more travel to the tasks as 64-bit hashes with their counts, the
``head``: ``most`` words at most, 16 bytes each, the most frequent if there are more
(ties by hash; the others count as rare ones). Counts of the rest, which grow with the
corpus, are joined by a shuffle on the word. In training texts none of those is
frequent; words that only held-out texts have often meet their counts by broadcast.
Texts are encoded once and written to the shared folder, and every count (words, pairs,
neighbours, transitions) covers all training texts.

Edge cases: a null or empty text is its end alone; a null doc_id counts as an empty one
in the choice of training texts. Rows that repeat are scored, and counted, each. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import as_bytes, cut, join_hot, words_of, workers_see_package

END = b""
FOLDS, HELD_OUT = 7, 2
#: What the shorter history counts like, in tokens.
SMOOTH = 20
_FLUSH_WORDS, _FLUSH_PAIRS, _MEMO = 400_000, 4_000_000, 600_000


@dataclass(frozen=True)
class Sizes:
    """least: times a word must be seen to have a class; core: words that are clustered pair by pair before all others join; most: bound of the broadcast head."""

    least: int = 4
    core: int = 2_048
    classes: int = 64
    sweeps: int = 12
    rounds: int = 2
    most: int = 2_000_000


def word_counts(docs: DataFrame) -> DataFrame:
    """(data) -> word, c: the words of all texts and their ends, counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])
            counts.clear()
            return out

        for batch in batches:
            counts[END] += batch.num_rows
            for data in batch.column(0):
                counts.update(words_of(data.as_py()))
                if len(counts) >= _FLUSH_WORDS:
                    yield flush()
        yield flush()

    return docs.select("data").mapInArrow(run, "word binary, c long").where("c > 0").groupBy("word").agg(F.sum("c").alias("c"))


def hash_of(word: bytes) -> int:
    """What F.xxhash64 gives for the word."""
    return xxhash.xxh64_intdigest(word, seed=42)


def in_head(vocabulary: DataFrame, most: int) -> Column:
    """Whether a row (word, c) is among the head: words seen twice or more, the ``most`` most frequent ones, ties by hash."""
    words = vocabulary.where(F.length("word") > 0)
    fine = (F.length("word") > 0) & (F.col("c") >= 2)
    n = words.where("c >= 2").count()
    if n <= most:
        return fine
    # counts in steps of a 16th of an octave, then by single counts within the step that is cut, then by hash
    step = F.floor(F.log2(F.col("c").cast("double")) * 16).cast("int")

    def upto(rows: DataFrame, by: Column, room: int, falling: bool) -> tuple[int, int]:
        for r in sorted(rows.groupBy(by.alias("k")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["k"] if falling else r["k"]):
            if r["n"] > room:
                return r["k"], room
            room -= r["n"]
        raise AssertionError("all fit")

    at_step, room = upto(words, step, most, True)
    at_count, room = upto(words.where(step == at_step), F.col("c"), room, True)
    part = F.shiftrightunsigned(F.xxhash64("word"), 48)
    at_part, _ = upto(words.where(F.col("c") == at_count), part, room, False)
    return fine & ((F.col("c") > at_count) | ((F.col("c") == at_count) & (part < at_part)))


class Head:
    """The head's words by hash; codes go by falling count, from 1; 0 is the end."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.lexsort((hashes, -counts))
        self.counts = counts[order]
        by_hash = np.argsort(hashes[order])
        self.hashes, self.codes = hashes[order][by_hash], (by_hash + 1).astype(np.uint32)
        self.rest = len(counts) + 1
        self.memo: dict[bytes, int] = {}

    def encode(self, words: list[bytes]) -> np.ndarray:
        found = np.fromiter(map(self.memo.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = [words[i] for i in missing.tolist()]
            h = np.fromiter(map(hash_of, new), np.uint64, len(new))
            at = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
            code = np.where(self.hashes[at] == h, self.codes[at], self.rest) if len(self.hashes) else np.full(len(new), self.rest)
            found[missing] = code
            if len(self.memo) > _MEMO:
                self.memo.clear()
            # words beyond the head are too rare to be worth remembering
            self.memo.update((new[i], int(code[i])) for i in np.flatnonzero(code != self.rest).tolist())
        return found.astype(np.uint32)


def encode(docs: DataFrame, head) -> DataFrame:
    """(rid, doc_id, held_out, data) -> ... ids (unsigned 32-bit, the end's 0 last), rest (words beyond the head and how often)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Head = head.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, codes, words, times, ends = batch.slice(at, 256), [], [], [], [0]
                for data in part.column("data"):
                    w = words_of(data.as_py())
                    code = np.append(own.encode(w), np.uint32(0))
                    codes.append(code.tobytes())
                    rest = Counter([w[i] for i in np.flatnonzero(code == own.rest).tolist()])
                    words.extend(rest.keys())
                    times.extend(rest.values())
                    ends.append(len(words))
                beyond = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(times, pa.int64())], ["word", "k"]))
                yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("doc_id"), part.column("held_out"), pa.array(codes, pa.binary()), beyond], ["rid", "doc_id", "held_out", "ids", "rest"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("rid", "doc_id", "held_out", "data").mapInArrow(run, f"rid long, doc_id {kind}, held_out boolean, ids binary, rest array<struct<word:binary,k:long>>")


def before(codes: np.ndarray) -> np.ndarray:
    """The token before each one; the end before the first. Every text ends in 0."""
    return np.concatenate([np.zeros(1, codes.dtype), codes[:-1]])


def histories(classes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes of the two tokens before each one; the end's before a text's first."""
    last = before(classes)
    last[:1] = end
    second = before(last)
    second[:1] = end
    return np.where(last == end, end, second), last


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            data = b"".join(batch.column(0).slice(at, 256).to_pylist())
            if data:
                yield np.frombuffer(data, np.uint32).astype(np.int64)


def tallied(encoded: DataFrame, codes_of) -> DataFrame:
    """code, n: codes_of turns a run of whole texts into codes; equal ones are counted in the task, so a code may have several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            code, n = np.unique(np.concatenate([np.empty(0, np.int64), *held]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], ["code", "n"])

        for tokens in _stream(batches):
            held.append(codes_of(tokens))
            size += len(held[-1])
            if size >= _FLUSH_PAIRS:
                yield flush()
                size = 0
        yield flush()

    return encoded.select("ids").mapInArrow(run, "code long, n long")


def counted(encoded: DataFrame, codes_of) -> DataFrame:
    """code, n over all rows of encoded(ids)."""
    return tallied(encoded, codes_of).groupBy("code").agg(F.sum("n").alias("n"))


def _dense(rows: DataFrame, size: int) -> np.ndarray:
    """size is a bound that the model's parameters set, not the corpus."""
    found = rows.toArrow()
    out = np.zeros(size, np.float64)
    out[found.column("code").to_numpy()] = found.column("n").to_numpy()
    return out


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """Classes of words from their pair counts; word 0 (the end) stays alone in class ``classes``.

    Words start dealt by rank. In each sweep every word, most frequent first, moves to
    the class that raises the likelihood of the class bigrams most; it stops when none moves.
    """
    n = len(pairs)
    cls = np.r_[classes, np.arange(n - 1) % classes].astype(np.int64)
    one = np.eye(classes + 1)[cls]
    grid = one.T @ pairs @ one
    for _ in range(sweeps):
        moved = 0
        for w in range(1, n):
            row, col, own = pairs[w], pairs[:, w], pairs[w, w]
            if not row.any() and not col.any():
                continue
            a = cls[w]
            right, left = np.bincount(cls, row, classes + 1), np.bincount(cls, col, classes + 1)
            right[a] -= own
            left[a] -= own
            grid[a] -= right
            grid[:, a] -= left
            grid[a, a] -= own
            rows, cols = grid.sum(1) + left, grid.sum(0) + right  # with what the word adds to other classes wherever it goes
            gain = (_xlogx(grid + right) - _xlogx(grid)).sum(1) + (_xlogx(grid + left[:, None]) - _xlogx(grid)).sum(0)
            d = np.diag(grid)
            gain -= _xlogx(d + right) - _xlogx(d) + _xlogx(d + left) - _xlogx(d)
            gain += _xlogx(d + right + left + own) - _xlogx(d)
            gain -= _xlogx(rows + right.sum() + own) - _xlogx(rows) + _xlogx(cols + left.sum() + own) - _xlogx(cols)
            b = int(np.argmax(gain[:classes]))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            cls[w] = b
            grid[b] += right
            grid[:, b] += left
            grid[b, b] += own
            moved += b != a
        if not moved:
            break
    return cls


def best_classes(left: np.ndarray, right: np.ndarray, link: np.ndarray, classes: int) -> np.ndarray:
    """For each word, from counts of the classes before and after it, the class that makes them likeliest."""
    return np.argmax((left @ link + right @ link.T)[:, :classes], axis=1)


def link_of(moves: np.ndarray) -> np.ndarray:
    """How much likelier than chance one class follows another, in logs."""
    g = moves + 0.5
    return np.log(g * g.sum() / (g.sum(1)[:, None] * g.sum(0)[None, :]))


def moved(training: DataFrame, cls, link, n_cls: int, classes: int) -> DataFrame:
    """(word, cls): for every word of a class below ``classes`` or of class -1, the class that fits its neighbours best.

    cls and link are broadcast; -1 marks words that have no class yet and count as rare ones here.
    """
    width = 2 * n_cls

    def neighbours(tokens: np.ndarray) -> np.ndarray:
        own = cls.value
        at = own[tokens]
        of = np.where(at < 0, n_cls - 1, at)
        mine = np.flatnonzero(at < classes)  # -1 among them
        left = before(of)[mine]
        left[mine == 0] = classes
        right = of[np.minimum(mine + 1, len(of) - 1)]  # the last token of a text is its end, which is never mine
        return np.concatenate([tokens[mine] * width + left, tokens[mine] * width + n_cls + right])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how, held, size, most = link.value, [], 0, _FLUSH_PAIRS

        def summed() -> tuple[np.ndarray, np.ndarray]:
            code, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            return code, np.bincount(at, np.concatenate([n for _, n in held]))

        for batch in batches:
            held.append((batch.column("code").to_numpy(), batch.column("n").to_numpy()))
            size += batch.num_rows
            if size >= most:  # no more than the task's words times the classes remain
                held = [summed()]
                size = len(held[0][0])
                most = max(_FLUSH_PAIRS, 2 * size)
        if not held:
            return
        code, n = summed()
        word = code // width
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        for i in range(0, len(starts), 20_000):
            a, b = starts[i], starts[i + 20_000] if i + 20_000 < len(starts) else len(code)
            own, at = np.unique(word[a:b], return_inverse=True)
            table = np.zeros((len(own), width))
            table[at, code[a:b] % width] = n[a:b]
            best = best_classes(table[:, :n_cls], table[:, n_cls:], how, classes)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(best.astype(np.int32))], ["word", "cls"])

    word = F.floor(F.col("code") / width)
    return tallied(training, neighbours).repartition(word).mapInArrow(run, "word long, cls int")


@dataclass
class Model:
    """cls: class of each code (0 the end, the last the rest); step: log10 of a class given the two before it; emit, plain: log10 of a token given its class, and of the base; n_all, n_kinds: training tokens and distinct ones; rare_total: divisor of the rare class."""

    cls: np.ndarray
    step: np.ndarray
    emit: np.ndarray
    plain: np.ndarray
    n_all: int
    n_kinds: int
    rare_total: float
    end_known: bool


def likelihood(moves: np.ndarray, cls: np.ndarray, counts: np.ndarray, rare: int) -> float:
    """Log-likelihood of the training texts under classes without smoothing, but for what no choice of classes changes."""
    mass = np.bincount(cls, counts, len(moves))
    return float(_xlogx(moves).sum() - _xlogx(moves.sum(1)).sum() - np.delete(_xlogx(mass), rare).sum())


def fit(training: DataFrame, counts: np.ndarray, sizes: Sizes, n_all: int, n_kinds: int) -> Model:
    """Classes and probabilities from encoded training texts; counts are those of the end and the head by code."""
    sc = training.sparkSession.sparkContext
    end, rare, n_cls = sizes.classes, sizes.classes + 1, sizes.classes + 2
    n_head = len(counts)
    n_classed = 1 + int((counts[1:] >= sizes.least).sum())  # codes go by falling count
    n_core = min(n_classed, sizes.core)

    def core_pairs(tokens: np.ndarray) -> np.ndarray:
        last = before(tokens)
        both = (tokens < n_core) & (last < n_core)
        return last[both] * n_core + tokens[both]

    pairs = _dense(counted(training, core_pairs), n_core * n_core).reshape(n_core, n_core)
    cls = np.full(n_head + 1, rare, np.int64)
    cls[:n_core] = exchange(pairs, sizes.classes, sizes.sweeps)

    def transitions(of, order: int) -> np.ndarray:
        shared = sc.broadcast(of)

        def codes(tokens: np.ndarray) -> np.ndarray:
            c = shared.value[tokens]
            second, last = histories(c, end)
            return ((second * n_cls if order == 3 else 0) + last) * n_cls + c

        return _dense(counted(training, codes), n_cls**order).reshape((n_cls,) * order)

    moves = transitions(cls, 2)
    settled = None
    for k in range(sizes.rounds if n_classed > 1 else 0):
        marked = cls.astype(np.int32)
        if k == 0:
            marked[n_core:n_classed] = -1
        found = moved(training, sc.broadcast(marked), sc.broadcast(link_of(moves)), n_cls, sizes.classes).toArrow()
        new = cls.copy()
        new[found.column("word").to_numpy()] = found.column("cls").to_numpy()
        if k == 0:
            new[:n_core] = cls[:n_core]
        new_moves = transitions(new, 2)
        now = likelihood(new_moves, new[:n_head], counts, rare)
        if settled is not None and now <= settled:
            break
        settled, cls, moves = now, new, new_moves

    share = (moves.sum(0) + 1) / (moves.sum() + n_cls)
    two = (moves + SMOOTH * share) / (moves.sum(1)[:, None] + SMOOTH)
    three = transitions(cls, 3)
    step = np.log10((three + SMOOTH * two[None]) / (three.sum(2)[:, :, None] + SMOOTH))
    in_class = np.bincount(cls[:n_classed], counts[:n_classed], n_cls)
    # a rare word's own frequency, less and less trusted the rarer it is: one unseen kind beside those seen
    rare_total = float(n_all - counts[:n_classed].sum() + n_kinds - (n_classed - (counts[0] == 0)) + 1)
    emit = np.zeros(n_head + 1)
    emit[:n_classed] = np.log10(np.maximum(counts[:n_classed], 1e-9) / np.maximum(in_class[cls[:n_classed]], 1e-9))
    emit[n_classed:n_head] = np.log10((counts[n_classed:] + 1) / rare_total)
    plain = np.append(np.log10((counts + 1) / (n_all + n_kinds + 1)), 0.0)
    return Model(cls, step, emit, plain, n_all, n_kinds, rare_total, bool(counts[0] > 0))


def score(docs: DataFrame, sizes: Sizes = Sizes(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs."""
    spark = docs.sparkSession
    workers_see_package(spark)
    sc = spark.sparkContext
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    base = docs.select(F.col(doc_id).alias("doc_id"), (F.crc32(key.cast("binary")) % FOLDS == HELD_OUT).alias("held_out"), as_bytes(F.col(text)).alias("data"))

    vocabulary = cut(word_counts(base.where(~F.col("held_out"))), "vocabulary")
    n_all, n_kinds = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    known = in_head(vocabulary, sizes.most)
    found = vocabulary.where(known).select(F.xxhash64("word").alias("h"), "c").toArrow()
    ends = vocabulary.where(F.length("word") == 0).collect()
    head = Head(found.column("h").to_numpy().view(np.uint64), found.column("c").to_numpy())
    counts = np.append(ends[0]["c"] if ends else 0, head.counts).astype(np.float64)
    encoded = cut(encode(base.withColumn("rid", F.monotonically_increasing_id()), sc.broadcast(head)), "encoded")
    model = fit(encoded.where(~F.col("held_out")), counts, sizes, n_all, n_kinds)
    shared, end = sc.broadcast(model), sizes.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        rest = len(m.cls) - 1
        for batch in batches:
            rows = []
            for data in batch.column("ids"):
                t = np.frombuffer(data.as_py(), np.uint32).astype(np.int64)
                c = m.cls[t]
                own = m.step[(*histories(c, end), c)].sum() + m.emit[t].sum()
                rows.append((len(t), int((t != rest).sum()) - (not m.end_known), float(m.plain[t].sum()), float(own)))
            cols = list(zip(*rows)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), batch.column("held_out"), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "own"])

    kind = docs.schema[doc_id].dataType.simpleString()
    main = encoded.select("rid", "doc_id", "held_out", "ids").mapInArrow(run, f"rid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, own double")
    unpacked = lambda rows: rows.select("rid", F.inline("rest"))
    c = F.coalesce(F.col("c"), F.lit(0))
    rest = join_hot(unpacked(encoded), vocabulary.where((F.length("word") > 0) & ~known), ["word"], "left", unpacked(encoded.where("held_out")).groupBy("word").agg(F.count("*").alias("n"))).select(
        "rid",
        F.when(c > 0, F.col("k")).otherwise(0).alias("known"),
        (F.col("k") * F.log10((c + 1) / F.lit(float(n_all + n_kinds + 1)))).alias("base"),
        (F.col("k") * F.log10((c + 1) / F.lit(model.rare_total))).alias("own"),
    )
    rest = rest.groupBy("rid").agg(F.sum("known").alias("r_known"), F.sum("base").alias("r_base"), F.sum("own").alias("r_own"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    return main.join(rest, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero(F.col("r_known"))).cast("long").alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("base") + zero(F.col("r_base"))).alias("base_score"),
        (F.col("own") + zero(F.col("r_own"))).alias("score"),
    )
