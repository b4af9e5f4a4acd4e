"""Lossless WebP: exact round trips through every feature of the format, a plain reader beside the fast one, and media columns."""

import hashlib
import random
import struct
import sys
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import media, webp

R = random.Random(11)


def test_short_distances_follow_the_rule():
    assert webp.NEAR[:12] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2)]
    assert len(webp.NEAR) == 120 and webp.NEAR[-3:] == [(-7, 7), (8, 6), (8, 7)]


def image(rng, h, w, kind):
    if kind == "few":
        p = rng.integers(0, 3, (h, w, 4)) * 90
    elif kind == "grey":
        p = np.repeat(rng.integers(0, 256, (h, w, 1)), 4, axis=2)
    elif kind == "runs":
        p = np.repeat(rng.integers(0, 256, (h, -(-w // 7), 4)), 7, axis=1)[:, :w]
        p[h // 2 :] = p[: h - h // 2]
    else:
        p = np.add.outer(np.arange(h) * 3, np.arange(w) * 2)[..., None] + np.array([0, 20, 60, 0]) + rng.integers(0, 6, (h, w, 4))
    p = (p % 256).astype(np.uint8)
    if rng.integers(2):
        p[..., 3] = 255
    return np.ascontiguousarray(p).view(np.uint32)[..., 0]


@pytest.mark.parametrize("kind", ["few", "grey", "runs", "slope"])
@pytest.mark.parametrize("seed", range(30))
def test_every_feature_round_trips(kind, seed):
    rng = np.random.default_rng([seed, len(kind)])
    h, w = ((1, 1), (1, 70), (70, 1))[seed] if seed < 3 else rng.integers(1, 70, 2)
    bits = int(rng.integers(2, 6))
    shape = (webp._blocks(h, bits), webp._blocks(w, bits))
    p = image(rng, h, w, kind)
    chosen = {"palette": not seed % 4, "green": bool(rng.integers(2)), "cache_bits": int(rng.integers(0, 12)), "copies": bool(rng.integers(2))}
    if rng.integers(2):
        chosen["predict"] = (bits, rng.integers(0, 16, shape))
    if rng.integers(2):
        chosen["cross"] = (bits, rng.integers(0, 2**32, shape, dtype=np.uint64).astype(np.uint32))
    if rng.integers(2) and seed % 4:
        chosen["groups"] = (bits, rng.integers(0, 4, shape))
    data = webp.encode(p, **chosen)
    assert struct.unpack("<I", data[4:8])[0] == len(data) - 8 and len(data) % 2 == 0
    assert (webp.decode(data) == p).all()
    extended = b"RIFF" + struct.pack("<I", 4 + 18 + len(data) - 12) + b"WEBP" + b"VP8X" + struct.pack("<I", 10) + bytes(10) + data[12:]
    assert (webp.decode(extended) == p).all()


@given(st.lists(st.sampled_from([0, 1, 7, 200]), min_size=1, max_size=9), st.integers(1, 600), st.integers(0, 4), st.integers(0, 2**30))
@settings(max_examples=60, deadline=None)
def test_leaping_and_walking_read_the_same(some, n, cache_bits, seed):
    rng = np.random.default_rng(seed)
    p = np.resize(np.array(some, np.uint32) * np.uint32(0x01020304), n + 63).reshape(1, -1)
    noise = rng.integers(0, p.size, 9)
    p[0, noise] = rng.integers(0, 2**32, 9, dtype=np.uint64)
    data = webp.encode(p, palette=False, green=False, cache_bits=cache_bits)
    leapt, webp._leap = webp._leap, lambda bits, codes, n: webp._walk(bits, [codes], None, n)
    try:
        walked = webp.decode(data)
    finally:
        webp._leap = leapt
    assert (walked == webp.decode(data)).all() and (walked == p).all()


@given(st.integers(1, 400), st.sampled_from([1, 8, 15, 60, 127]), st.integers(0, 2**30))
@settings(max_examples=60, deadline=None)
def test_chains_are_single_steps(size, most, seed):
    steps = np.random.default_rng(seed).integers(1, most + 1, size).astype(np.uint8)
    at, walked = 0, []
    while at < size:
        walked.append(at)
        at += int(steps[at])
    places, end = webp._chain(steps)
    assert places.tolist() == walked and end >= size
    assert all(0 < b - a <= 256 * most for a, b in zip(walked[-1:], [end]))


def calls_in(f) -> int:
    """How many calls, of Python and of C, f makes."""
    made = [0]

    def count(frame, event, arg):
        made[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        f()
    finally:
        sys.setprofile(None)
    return made[0]


def test_reading_makes_far_fewer_calls_than_tokens():
    """op11: a text's tokens are not gone through one by one, and a code of one symbol is written without counting."""
    text = " ".join(R.choice("abcdefghijklmnopqrstuvwxyz") * R.randint(1, 3) + str(R.randint(0, 999)) for _ in range(2000)).encode()
    own = media.payload_of(text)
    kept = media.stored(own)
    assert media.read(kept) == own
    assert calls_in(lambda: media.read(kept)) < len(own) / 4
    short = media.payload_of(text[:600])
    media.stored(short)
    assert calls_in(lambda: media.stored(short)) < 560


def _set(out, *pairs):
    for value, size in pairs:
        out.put(value, size)


def test_a_file_written_bit_by_bit():
    """2 x 2: red, then three copies of it by a distance of one, out of codes with one symbol each but green."""
    out = webp._Out()
    _set(out, (0x2F, 8), (1, 14), (1, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1))
    # green: symbols 0 and 258 (length 3), lengths 1 and 1, by a code for lengths of 0s in runs and 1
    _set(out, (0, 1), (14, 4), *[({18: 1, 1: 1}.get(s, 0), 3) for s in webp.LENGTH_ORDER[:18]], (0, 1))
    one, zeros = (0, 1), (1, 1)  # of the two symbols 1 comes first
    _set(out, one, zeros, (127, 7), zeros, (108, 7), one, zeros, (10, 7))
    for symbol in (255, 0, 255):
        _set(out, (1, 1), (0, 1), (1, 1), (symbol, 8))
    _set(out, (1, 1), (0, 1), (0, 1), (1, 1))  # distance: prefix 1, the second short distance, one to the left
    _set(out, (0, 1), (1, 1))
    body = out.bytes()
    data = b"RIFF" + struct.pack("<I", 12 + len(body) + len(body) % 2) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + bytes(len(body) % 2)
    assert webp.decode(data).tolist() == [[0xFFFF0000] * 2] * 2


def test_damage_is_told():
    p = image(np.random.default_rng(1), 20, 20, "slope")
    data = webp.encode(p)
    for broken in (b"", data[:11], b"RIFX" + data[4:], data[:25], data[:20] + b"\x00" + data[21:], data[: len(data) // 2]):
        with pytest.raises(ValueError):
            webp.decode(broken)
    for k in range(20, len(data)):
        hurt = bytearray(data)
        hurt[k] ^= 1 << R.randrange(8)
        try:
            assert webp.decode(bytes(hurt)).ndim == 2
        except ValueError:
            pass


def test_code_lengths_make_complete_codes_within_their_bound():
    for counts in ([1], [0, 5], [1, 1], [2**k for k in range(30)], [1] * 280, [0] * 40):
        lengths = webp.code_lengths(np.array(counts), 15)
        used = lengths[lengths > 0]
        assert used.max() <= 15 and (len(used) == 1 or (2.0 ** -used).sum() == 1)


def payload(text):
    data = (text or "").encode()
    return data + bytes(-len(data) % 64 or (0 if data else 64))


TEXTS = [None, "", "a", "x" * 64, "x" * 65, "word " * 300, "".join(chr(R.randint(32, 3000)) for _ in range(5000)), "\u0000" * 200, " ".join(R.choice(["un", "deux", "trois", "quatre"]) + str(R.randint(0, 9)) for _ in range(40_000)), "ab" * 700_000 + "c"]


def test_texts_are_stored_and_read(spark):
    docs = spark.createDataFrame([(i, t, b"x", 1) for i, t in enumerate(TEXTS)] + [(None, "a", b"x", 1), (2, "a", b"x", 1)], "doc_id long, text string, media binary, payload int").repartition(3)
    out = media.stored_and_read(docs).collect()
    assert len(out) == len(TEXTS) + 2
    for r in out:
        own = payload(TEXTS[r["doc_id"]] if r["doc_id"] is not None else "a")
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-64:]))
        assert r["n_bytes"] == len((TEXTS[r["doc_id"]] if r["doc_id"] is not None else "a") or "") or r["doc_id"] == 6
    same = {tuple(r)[1:] for r in out if r["doc_id"] in (None, 2)}
    assert len(same) == 1 and all(len(r["feature"]) == 16 for r in out)
    kept = media.store(docs)
    for r in kept.collect():
        assert hashlib.sha256(r["media"]).hexdigest() == next(o["media_sha256"] for o in out if o["doc_id"] == r["doc_id"])
    assert sorted(r["payload"] for r in media.samples(kept).collect()) == sorted([payload(t) for t in TEXTS] + [payload("a")] * 2)


def test_pixel_arrays(spark):
    rng = np.random.default_rng(2)
    one, two = image(rng, 5, 9, "slope"), image(rng, 3, 2, "few")
    data = webp.encode(one, predict=(2, np.full((2, 3), 11))) + webp.encode(two)
    rows = spark.createDataFrame([(1, data), (2, None), (3, b""), (4, data[:30])], "doc_id long, media binary")
    out = {(r["doc_id"], r["image"]): r for r in media.pixels(rows).collect()}
    assert sorted(out) == [(1, 0), (1, 1), (4, 0)] and out[4, 0]["pixels"] is None
    for k, p in enumerate((one, two)):
        r = out[1, k]
        assert (r["height"], r["width"]) == p.shape and np.array(r["pixels"], np.int32).view(np.uint32).tolist() == p.ravel().tolist()
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert media.stored_and_read(empty).count() == 0
    assert [r["payload"] for r in media.samples(rows.where("doc_id > 1")).collect()] == [None, None, None]
