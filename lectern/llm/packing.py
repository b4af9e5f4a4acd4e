"""Packing documents into windows by best-fit decreasing.

A document's ids are cut into full windows; what remains (shorter than a window) is
placed by best-fit decreasing: pieces go in order of falling length to the open window
with the least room that still holds them, found in a segment tree indexed by room.

Pieces are dealt by a hash into shards of about ``shard_pieces`` each, so that memory
and the sequential part of one task are bounded while the number of shards grows with
the corpus: with its documents and with the bytes of its texts, so that a few enormous
documents are many shards too. A piece's hash takes in its place in its task, so that
rows alike in id and text do not share a shard. Each shard leaves at most a few windows
with much room, a share of the order of 1 / shard_pieces. Only (document, start,
length, checksum) rows are shuffled, never ids; :func:`sequences` joins ids to their
places where they are wanted.

Edge cases: a null or empty text is one piece of the end id alone. Rows that repeat,
doc_id included, are packed as often as they occur. A null doc_id is kept, and ids of
any size beside it stay as they are. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import as_bytes, workers_see_package

WINDOW = 2048
END_ID = 1
SHARD_PIECES = 16_384
#: What shards are counted by: texts have about as many bytes an id. No bound rests on it.
BYTES_AN_ID = 4
_MEMO = 300_000
_LETTERS = "a-zA-ZÀ-ÖØ-öø-ÿ"
_SAFE = re.compile(r"[\x21-\x7e" + "À-ÖØ-öø-ÿ" + r"]+\Z")
_PLAIN = re.compile(rb"([A-Za-z]+)([.,;:?!]*)\Z").match
_PARTS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")


class WordIds(dict):
    """A run between white space -> its ids as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and joins nothing across it, so the ids of a text
    are those of its runs one after the other. Runs seen of late are remembered, in two
    generations so that the frequent ones stay. Others go through the vocabulary's
    merges directly: letters that normalisation only lowers are cut into parts as the
    tokenizer cuts them, and byte 0xFF, which no UTF-8 text has, stands for the end of a
    word. Runs with any other character are left to the tokenizer.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.old: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        back = {c: b for b, c in _byte_letters().items()}

        def as_bytes(token: str) -> bytes:
            end = token.endswith("</w>")
            return bytes(back[c] for c in token.removesuffix("</w>")) + b"\xff" * end

        ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 255]): 256 + b for b in range(255)}
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            ranks.setdefault(as_bytes(left) + as_bytes(right), len(ranks) + 1)
        ids = {as_bytes(t): i for t, i in model["vocab"].items() if not t.startswith("<|")}
        self.id_of = np.zeros(max(ranks.values()) + 1, "<u4")
        for token, rank in ranks.items():
            self.id_of[rank] = ids.get(token, 0)
        self.core = tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, run: bytes) -> bytes:
        found = self.old.get(run)
        if found is None:
            plain = _PLAIN(run)
            if plain:  # most runs: a word and what closes it, each remembered by itself
                word, tail = plain.groups()
                found = self.part(word.lower()) + (self.part(tail) if tail else b"")
            else:
                found = self.ids_of(run.decode("utf-8", "replace"))
        if len(run) <= 40:
            if len(self) >= _MEMO:
                self.old = dict(self)
                self.clear()
            self[run] = found
        return found

    def part(self, data: bytes) -> bytes:
        """Ids of a part as the tokenizer cuts them; in lower case."""
        found = self.parts.get(data)
        if found is None:
            found = self.id_of[self.core(data + b"\xff")].tobytes()
            if len(data) <= 40:
                if len(self.parts) >= _MEMO:
                    self.parts.clear()
                self.parts[data] = found
        return found

    def ids_of(self, run: str) -> bytes:
        if not _SAFE.match(run) or "<|" in run:
            return np.array(self.tokenizer.encode(run, add_special_tokens=False).ids, "<u4").tobytes()
        ranks: list[int] = []
        for part in _PARTS.findall(run.lower()):
            ranks += self.core(part.encode() + b"\xff")
        return self.id_of[ranks].tobytes()

    def encode(self, data: bytes) -> bytes:
        return b"".join(map(self.__getitem__, data.split()))


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes for themselves, others from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_word_ids: dict[str, WordIds] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str) -> WordIds:
    if path not in _word_ids:
        _word_ids[path] = WordIds(path)
    return _word_ids[path]


def pieces(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, nth (in its task; or ids as array<int> instead)."""
    workers_see_package(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids" if with_ids else "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, nth = encoder(vocabulary).encode, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows: list[tuple] = []
                for row, data in enumerate(part.column(1)):
                    ids = encode(data.as_py()) + end
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        own = ids[4 * start : 4 * (start + window)]
                        rows.append((row, start, len(own) // 4, zlib.crc32(own), total, own if with_ids else nth))
                        nth += 1
                cols = list(zip(*rows)) or [()] * 6
                arrays = [part.column(0).take(pa.array(cols[0], pa.int64())), *[pa.array(c, pa.int64()) for c in cols[1:5]]]
                if with_ids:
                    flat = np.frombuffer(b"".join(cols[5]), "<u4").astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *cols[2]]), pa.int32()), pa.array(flat)))
                else:
                    arrays.append(pa.array(cols[5], pa.int64()))
                yield pa.RecordBatch.from_arrays(arrays, names)

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, " + ("ids array<int>" if with_ids else "nth long")
    return docs.select(F.col(doc_id).alias("doc_id"), as_bytes(F.col(text)).alias("data")).mapInArrow(run, schema)


class Rooms:
    """A segment tree over rooms 0..window that holds how many open windows have each."""

    def __init__(self, window: int):
        self.size = 1
        while self.size <= window:
            self.size *= 2
        self.tree = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        i, tree = room + self.size, self.tree
        while i:
            tree[i] += n
            i >>= 1

    def tightest(self, need: int) -> int:
        """The least room >= need of an open window, or -1."""
        i, tree = need + self.size, self.tree
        if tree[i]:
            return need
        while i > 1:
            if not i & 1 and tree[i + 1]:
                i += 1
                break
            i >>= 1
        if i <= 1:
            return -1
        while i < self.size:
            i *= 2
            if not tree[i]:
                i += 1
        return i - self.size


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the window, offset in it) for each length; ties in the order given."""
    rooms, open_at = Rooms(window), [[] for _ in range(window + 1)]
    where, offset, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        room = rooms.tightest(need)
        if room < 0:
            at, room, n = n, window, n + 1
        else:
            at = open_at[room].pop()
            rooms.add(room, -1)
        where[i], offset[i] = at, window - room
        if room > need:
            open_at[room - need].append(at)
            rooms.add(room - need, 1)
    return where, offset


def place(parts: DataFrame, n_shards: int, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to the piece rows of :func:`pieces`, which nth leaves."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(table: pa.Table) -> pa.Table:
        # Arrow keeps ids as they are, also beside nulls
        table = table.sort_by([("length", "descending"), ("start", "ascending"), ("ids_crc32", "ascending"), ("doc_id", "ascending"), ("nth", "ascending")])
        where, offset = best_fit_decreasing(table.column("length").to_numpy(), window)
        shard = table.column("shard").to_numpy()
        table = table.select(names).append_column("sequence_id", pa.array((shard << 32) + where))
        return table.append_column("offset", pa.array(offset))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema if f.name in names) + ", sequence_id long, offset long"
    shard = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "nth", F.lit(7)), F.lit(n_shards))
    return parts.withColumn("shard", shard).groupBy("shard").applyInArrow(run, schema)


def n_shards(docs: DataFrame, window: int = WINDOW, shard_pieces: int = SHARD_PIECES, text: str = "text") -> int:
    """How many shards of about shard_pieces pieces the documents make."""
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return max(1, round((n + size / (BYTES_AN_ID * window)) / shard_pieces))


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end_id: int = END_ID, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece."""
    parts = pieces(docs, vocabulary or default_vocabulary(), window, end_id)
    return place(parts, n_shards(docs, window, shard_pieces), window)


def sequences(docs: DataFrame, placed: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end_id: int = END_ID, pad_id: int = 0) -> DataFrame:
    """sequence_id, input_ids (array<int>, padded to window unless a power of two), doc_starts: the packed sequences themselves.

    placed is what :func:`pack` returns for docs with the same parameters; rows alike in
    doc_id and text have the same ids, so one of them serves all.
    """
    keys = ["doc_id", "start", "ids_crc32"]
    parts = pieces(docs, vocabulary or default_vocabulary(), window, end_id, with_ids=True).groupBy(*keys).agg(F.first("ids").alias("ids"))
    parts = parts.select(*[F.col(k).alias(f"own_{k}") for k in keys], "ids")
    rows = placed.join(parts, [F.col(k).eqNullSafe(F.col(f"own_{k}")) for k in keys])
    seq = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    flat = F.flatten(F.transform("p", lambda x: x["ids"]))
    n = F.size("raw")
    whole = F.expr("size(raw) > 0 and (size(raw) & (size(raw) - 1)) = 0")
    padded = F.when(whole, F.col("raw")).otherwise(F.concat("raw", F.array_repeat(F.lit(pad_id), F.lit(window) - n)))
    return seq.select("sequence_id", flat.alias("raw"), F.transform("p", lambda x: x["offset"]).alias("doc_starts")).select("sequence_id", padded.alias("input_ids"), "doc_starts")
