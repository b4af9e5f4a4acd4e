import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectern.llm import packing

PATH = packing.default_vocabulary()
TOKENIZER = Tokenizer.from_file(PATH)


def expected(text):
    return TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text() | st.text(alphabet="abcxyzéüßçñÄÖ'.,!?0123 \n\t<|>s", max_size=60))
def test_ids_equal_the_tokenizers(text):
    data = packing.encoder(PATH).encode(text.encode("utf-8", "replace"))
    assert np.frombuffer(data, "<u4").tolist() == expected(text.encode("utf-8", "replace").decode())


def test_ids_with_special_names():
    for text in ("a <|endoftext|> b", "x<|startoftext|>y", "it's we'll 3½ ²", "", "  \n"):
        assert np.frombuffer(packing.encoder(PATH).encode(text.encode()), "<u4").tolist() == expected(text)


@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit_decreasing_equals_brute_force(lengths):
    window = 64
    where, offset = packing.best_fit_decreasing(np.array(lengths, dtype=np.int64), window)
    rooms = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [(room, k) for k, room in enumerate(rooms) if room >= lengths[i]]
        if fits:
            room = min(fits)[0]
            rooms[next(k for r, k in fits if r == room)] -= lengths[i]
        else:
            rooms.append(window - lengths[i])
    assert (where.max() + 1 if len(lengths) else 0) == len(rooms)
    used = np.bincount(where, lengths, len(rooms)) if len(lengths) else np.array([])
    assert sorted(window - used) == sorted(rooms)
    for w in range(len(rooms)):
        parts = sorted((offset[i], lengths[i]) for i in range(len(lengths)) if where[i] == w)
        assert [a for a, _ in parts] == list(np.cumsum([0, *[n for _, n in parts]])[:-1])


BIG = 9007199254740993  # over 2^53: floats would change it
ROWS = [(1, "one two three"), (1, "one two three"), (2, None), (None, ""), (None, "null id " * 90), (None, None), (BIG, "big " * 70), (BIG + 2, "bigger"), (3, "word " * 5000), (4, "ümlaut’s 東京 \u0000 x")]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame([(i, t, t, 5) for i, t in ROWS], "doc_id long, text string, length string, ids int").repartition(2)


@pytest.mark.parametrize("shard_pieces", [4, 16384])
def test_pack_covers_every_id_once(spark, docs, shard_pieces):
    placed = packing.pack(docs, window=64, shard_pieces=shard_pieces).collect()
    wanted = Counter()
    for doc_id, text in ROWS:
        ids = [*expected(text or ""), 1]
        for at in range(0, len(ids), 64):
            part = ids[at : at + 64]
            wanted[doc_id, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in placed) == wanted
    by = defaultdict(list)
    for r in placed:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for seq in by.values():
        at = 0
        for offset, length in sorted(seq):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(docs.limit(0)).count() == 0
    assert shard_pieces > 4 or len({r["sequence_id"] >> 32 for r in placed}) > 4


def test_rows_alike_do_not_share_a_shard(spark):
    docs = spark.createDataFrame([(7, "same")] * 400, "doc_id long, text string")
    shards = Counter(r["sequence_id"] >> 32 for r in packing.pack(docs, shard_pieces=50).collect())
    assert len(shards) == 8 and max(shards.values()) < 100


def test_a_long_document_is_many_shards(spark):
    assert packing.n_shards(spark.createDataFrame([(1, "word " * 50_000)], "doc_id long, text string"), window=64, shard_pieces=100) > 5


def test_sequences(spark, docs):
    placed = packing.pack(docs, window=64).cache()
    out = packing.sequences(docs, placed, window=64, pad_id=0).collect()
    assert all(len(x["input_ids"]) == 64 or len(x["input_ids"]) & (len(x["input_ids"]) - 1) == 0 for x in out)
    crcs = Counter()
    of = {x["sequence_id"]: x["input_ids"] for x in out}
    for r in placed.collect():
        own = of[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"]
        crcs[r["doc_id"]] += len(own)
    assert sum(crcs.values()) == sum(len(expected(t or "")) + 1 for _, t in ROWS) and crcs[BIG] and crcs[BIG + 2]
