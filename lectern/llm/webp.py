"""Lossless WebP, one image at a time: ARGB pixels as 32-bit numbers in, one file out, and back.

Reading handles all that the format has: prefix codes (one group, or many by an entropy
image), back-references with the short two-dimensional distances, the colour cache, and
the predictor, cross-colour, subtract-green and palette transforms in any order, within
plain and extended containers. Where an image has one group of codes, every bit position
of a stretch is looked up at once and the reader only leaps from token to token; else it
walks. Predictors are inverted along diagonals, all pixels of one at a time. Both keep
memory in proportion to the image. Damaged files raise ValueError.

Writing takes what a caller chooses: transforms, cache size and groups. Copies are found
by sorting all windows of 8 bytes.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

PREDICT, CROSS, GREEN, PALETTE = range(4)
MOST_SIDE = 1 << 14
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
LONGEST, FARTHEST = 4096, (1 << 20) - 120
#: Fixed value: the order in which lengths of the code for code lengths are written.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: The 120 short distances as (dx, dy), nearest first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))
#: Bytes whose bit positions are looked up at once.
STRETCH = 1 << 16
BLACK = 0xFF000000
_U = np.uint32
_EIGHT = np.arange(8, dtype=np.uint32)


@lru_cache(None)
def _reversed(bits: int) -> np.ndarray:
    """Each number of so many bits, with its bits in reverse order."""
    out = np.zeros(1, np.int64)
    for _ in range(bits):
        out = np.concatenate([out * 2, out * 2 + 1])
    return out


_BACKWARDS = _reversed(7).tolist()


def _blocks(size: int, bits: int) -> int:
    return (size + (1 << bits) - 1) >> bits


def _spread(image: np.ndarray, bits: int, height: int, width: int) -> np.ndarray:
    """One value a block -> one a pixel."""
    return np.repeat(np.repeat(image, 1 << bits, axis=0)[:height], 1 << bits, axis=1)[:, :width]


class Prefix:
    """A canonical prefix code as a table from the next bits to symbol * 16 + length; a symbol alone takes no bits."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        if not len(symbols):
            raise ValueError("a prefix code without symbols")
        if len(symbols) == 1:
            self.bits, self.only, self.top, self.table = 0, int(symbols[0]), int(symbols[0]), np.array([symbols[0] << 4], np.uint16)
        else:
            order = lengths.argsort(kind="stable")
            lengths = lengths[order]
            self.bits, self.only, self.top = int(lengths[-1]), None, int(symbols[-1])  # symbols come in order
            spans = 1 << (self.bits - lengths)
            if int(spans.sum()) != 1 << self.bits:
                raise ValueError("a prefix code that is not complete")
            self.table = (symbols[order] << 4 | lengths).astype(np.uint16).repeat(spans)[_reversed(self.bits)]
        self.mask = (1 << self.bits) - 1


@lru_cache(1024)
def _alone(symbol: int) -> Prefix:
    return Prefix(np.array([symbol]), np.ones(1, np.int64))


class Bits:
    """The bits of a file, least significant first."""

    def __init__(self, data: bytes):
        self.end, self.at = 8 * len(data), 0
        self.data = data + bytes(16)
        self.words = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))

    def peek(self) -> int:
        if self.at > self.end:
            raise ValueError("the file ends early")
        return int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 8], "little") >> (self.at & 7)

    def take(self, n: int) -> int:
        found = self.peek() & ((1 << n) - 1)
        self.at += n
        return found

    def symbol(self, code: Prefix) -> int:
        found = int(code.table[self.peek() & code.mask])
        self.at += found & 15
        return found >> 4

    def number(self, k: int) -> int:
        """A length or distance from its prefix."""
        if k < 4:
            return k + 1
        extra = (k - 2) >> 1
        return ((2 + (k & 1)) << extra) + self.take(extra) + 1

    def look(self, at: np.ndarray) -> np.ndarray:
        """The bits at each position."""
        return (self.words[at >> 3] >> (at & 7).astype(np.uint64)).view(np.int64)

    def numbers(self, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions after, numbers) for many prefixes."""
        extra = np.maximum((k - 2) >> 1, 0)
        return at + extra, np.where(k < 4, k, (2 + (k & 1)) << extra) + (self.look(at) & ((1 << extra) - 1)) + 1


def _read_code(bits: Bits, size: int) -> Prefix:
    if bits.take(1):
        head = bits.take(2)
        two, wide = head & 1, head >> 1
        symbols = sorted({bits.take(8 if wide else 1), *([bits.take(8)] if two else [])})
        if symbols[-1] >= size:
            raise ValueError("a symbol beyond its alphabet")
        return Prefix(np.array(symbols), np.ones(2, np.int64)) if len(symbols) > 1 else _alone(symbols[0])
    inner = [0] * len(LENGTH_ORDER)
    for k in LENGTH_ORDER[: 4 + bits.take(4)]:
        inner[k] = bits.take(3)
    used = [k for k, n in enumerate(inner) if n]
    code = Prefix(np.array(used, np.int64), np.array([inner[k] for k in used], np.int64))
    table, mask = code.table.tolist(), code.mask
    left = 2 + bits.take(2 + 2 * bits.take(3)) if bits.take(1) else size
    symbols, lengths, symbol, before = [], [], 0, 8
    data, at, word, have = bits.data, bits.at, 0, 0
    while symbol < size and left:
        left -= 1
        if have < 14:  # the longest token: 7 bits and as many extra ones
            word, have = int.from_bytes(data[at >> 3 : (at >> 3) + 24], "little") >> (at & 7), 192 - (at & 7)
        found = table[word & mask]
        used = found & 15
        at, have, word = at + used, have - used, word >> used
        kind = found >> 4
        if kind < 16:
            if kind:
                symbols.append(symbol)
                lengths.append(kind)
                before = kind
            symbol += 1
            continue
        extra, least = ((2, 3), (3, 3), (7, 11))[kind - 16]
        run = least + (word & ((1 << extra) - 1))
        at, have, word = at + extra, have - extra, word >> extra
        if symbol + run > size:
            raise ValueError("code lengths beyond the alphabet")
        if kind == 16:
            symbols += range(symbol, symbol + run)
            lengths += [before] * run
        symbol += run
    bits.at = at
    if at > bits.end:
        raise ValueError("the file ends early")
    return Prefix(np.array(symbols, np.int64), np.array(lengths, np.int64))


_NEAR = np.array(NEAR).T


def _distance(code: np.ndarray, width: int) -> np.ndarray:
    x, y = _NEAR
    near = np.minimum(code, len(NEAR)) - 1
    return np.where(code > len(NEAR), code - len(NEAR), np.maximum(x[near] + y[near] * width, 1))


def _walk(bits: Bits, groups: list[list[Prefix]], which: np.ndarray | None, n: int) -> tuple[np.ndarray, ...]:
    """Tokens one by one: green symbol, colour, length, distance code. which: the group of each pixel."""
    out, at = [], 0
    while at < n:
        green, red, blue, alpha, far = groups[which[at] if which is not None else 0]
        g = bits.symbol(green)
        if g < LITERALS:
            r, b, a = bits.symbol(red), bits.symbol(blue), bits.symbol(alpha)
            out.append((g, a << 24 | r << 16 | g << 8 | b, 1, 0))
        elif g < LITERALS + LENGTHS:
            length = bits.number(g - LITERALS)
            out.append((g, 0, length, bits.number(bits.symbol(far))))
        else:
            out.append((g, 0, 1, 0))
        at += out[-1][2]
    return tuple(np.array(x, np.int64) for x in zip(*out))


def _chain(steps: np.ndarray) -> tuple[np.ndarray, int]:
    """(the places that steps lead through from 0 on, the first place beyond them all).

    What 2, 4, ... steps come to from each place is known before any is made, as long as a byte holds it.
    """
    size = len(steps)
    at = np.arange(size)
    jumps = [np.concatenate([steps, np.zeros(256, np.uint8)])]
    while len(jumps) < 5 and jumps[-1].max() < 128:
        last, more = jumps[-1], np.zeros(size + 256, np.uint8)
        np.add(last[:size], last.take(at + last[:size]), out=more[:size])
        jumps.append(more)
    leap, now, found = jumps.pop().tobytes(), 0, []
    put = found.append
    while now < size:
        put(now)
        now += leap[now]
    places = np.fromiter(found, np.int64, len(found))[:, None]
    for jump in reversed(jumps):
        places = np.stack([places, places + jump.take(places)], axis=2).reshape(len(found), -1)
    places = places.ravel()
    return places[: int(places.searchsorted(size))], now


def _leap(bits: Bits, codes: list[Prefix], n: int) -> tuple[np.ndarray, ...]:
    """As _walk for one group: the size of the token that would start at each bit is known before one is read."""
    green, red, blue, alpha, far = codes

    def literal(at: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        colour = g.astype(np.int64) << 8
        for code, shift in ((red, 16), (blue, 0), (alpha, 24)):
            if code.bits:
                found = code.table[bits.look(at) & code.mask].astype(np.int64)
                at, colour = at + (found & 15), colour | (found >> 4) << shift
            else:
                colour |= code.only << shift
        return at, colour

    def copy(at: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, length = bits.numbers(at, g.astype(np.int64) - LITERALS)
        found = far.table[bits.look(at) & far.mask].astype(np.int64)
        at, code = bits.numbers(at + (found & 15), found >> 4)
        return at, length, code

    plain, copied = not (red.bits or blue.bits or alpha.bits), green.top >= LITERALS
    short = np.ndarray((len(bits.data) - 3,), "<u4", bits.data, strides=(1,))
    parts, got = [], 0
    while got < n:
        if bits.at > bits.end:
            raise ValueError("the file ends early")
        first = bits.at >> 3
        base, size = 8 * first, 8 * min(STRETCH, (bits.end >> 3) + 1 - first)
        found = green.table.take((short[first : first + size // 8, None] >> _EIGHT & _U(green.mask)).ravel())
        steps = (found & 15).astype(np.uint8)
        if not plain:
            lit = np.flatnonzero(found < LITERALS << 4)
            steps[lit] = literal(base + lit + steps[lit], found[lit] >> 4)[0] - base - lit
        far_ones = np.flatnonzero((found >= LITERALS << 4) & (found < LITERALS + LENGTHS << 4)) if copied else ()
        if len(far_ones):
            steps[far_ones] = copy(base + far_ones + steps[far_ones], found[far_ones] >> 4)[0] - base - far_ones
        skip = bits.at - base
        hits, at = _chain(steps[skip:])
        hits += skip
        bits.at = base + skip + at
        e = found[hits]
        g = (e >> 4).astype(np.int64)
        if plain and not copied:  # each token is a pixel
            if len(g) >= n - got:
                stop = n - got
                bits.at = base + int(hits[stop]) if stop < len(hits) else bits.at
                g = g[:stop]
            parts.append((g, g << 8 | (alpha.only << 24 | red.only << 16 | blue.only), None, None))
            got += len(g)
            continue
        after = base + hits + (e & 15)
        colour, length, code = np.zeros(len(hits), np.int64), np.ones(len(hits), np.int64), np.zeros(len(hits), np.int64)
        if plain:
            colour = g << 8 | (alpha.only << 24 | red.only << 16 | blue.only)
        else:
            lit = np.flatnonzero(g < LITERALS)
            colour[lit] = literal(after[lit], g[lit])[1]
        far_ones = np.flatnonzero((g >= LITERALS) & (g < LITERALS + LENGTHS))
        if len(far_ones):
            _, length[far_ones], code[far_ones] = copy(after[far_ones], g[far_ones])
        ends = got + np.cumsum(length)
        if ends[-1] >= n:  # what follows the last pixel are no tokens
            stop = int(np.searchsorted(ends, n)) + 1
            bits.at = base + int(hits[stop]) if stop < len(hits) else bits.at
            g, colour, length, code = (x[:stop] for x in (g, colour, length, code))
        parts.append((g, colour, length, code))
        got = int(ends[-1])
    return tuple(np.concatenate(x) if x[0] is not None else None for x in zip(*parts))


def _slot(colour: np.ndarray, cache_bits: int) -> np.ndarray:
    return (colour.astype(np.uint32) * _U(0x1E35A7BD)) >> _U(32 - cache_bits)


def _fill(tokens: tuple[np.ndarray, ...], n: int, width: int, cache_bits: int) -> np.ndarray:
    """Pixels from tokens: literals at once, then copies in order, or all in order where there is a cache."""
    g, colour, length, code = tokens
    if length is None:  # literals only
        return colour.astype(np.uint32)
    starts = np.cumsum(length) - length
    if starts[-1] + length[-1] != n:
        raise ValueError("a copy beyond the image")
    copies = (g >= LITERALS) & (g < LITERALS + LENGTHS)
    back = _distance(code, width) if copies.any() else code
    if (back[copies] > starts[copies]).any():
        raise ValueError("a copy from before the image")
    out = np.zeros(n, np.uint32)
    single = g < LITERALS
    out[starts[single]] = colour[single]

    def take(at: int, size: int, d: int) -> None:
        out[at : at + size] = out[at - d : at - d + size] if d >= size else np.resize(out[at - d : at], size)

    if not cache_bits or not (g >= LITERALS + LENGTHS).any():
        for at, size, d in zip(starts[copies].tolist(), length[copies].tolist(), back[copies].tolist()):
            take(at, size, d)
        return out
    if (g >= LITERALS + LENGTHS + (1 << cache_bits)).any():
        raise ValueError("a place beyond the cache")
    cache, slots = np.zeros(1 << cache_bits, np.uint32), _slot(out, cache_bits).tolist()
    for symbol, at, size, d in zip(g.tolist(), starts.tolist(), length.tolist(), back.tolist()):
        if symbol < LITERALS:
            cache[slots[at]] = out[at]
        elif symbol < LITERALS + LENGTHS:
            take(at, size, d)
            new = out[at : at + size]
            cache[_slot(new, cache_bits)] = new  # of one slot the last stays
        else:
            out[at] = cache[symbol - LITERALS - LENGTHS]  # its slot holds it already
    return out


def _read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits, which, n_groups = (bits.take(4) if bits.take(1) else 0), None, 1
    if cache_bits > 11:
        raise ValueError("a cache beyond 11 bits")
    if main and bits.take(1):
        block = bits.take(3) + 2
        image = _read_pixels(bits, _blocks(width, block), _blocks(height, block), False)
        which = _spread((image >> _U(8)).astype(np.int64) & 0xFFFF, block, height, width).ravel()
        n_groups = int(which.max()) + 1
    sizes = (LITERALS + LENGTHS + ((1 << cache_bits) if cache_bits else 0), LITERALS, LITERALS, LITERALS, DISTANCES)
    groups = [[_read_code(bits, size) for size in sizes] for _ in range(n_groups)]
    n, codes = width * height, groups[0]
    if n_groups == 1 and not any(c.bits for c in codes[:4]) and codes[0].only < LITERALS:
        green, red, blue, alpha = (c.only for c in codes[:4])
        return np.full((height, width), alpha << 24 | red << 16 | green << 8 | blue, np.uint32)
    leaps = n_groups == 1 and codes[0].bits and n >= 64
    tokens = _leap(bits, codes, n) if leaps else _walk(bits, groups, which, n)
    return _fill(tokens, n, width, cache_bits).reshape(height, width)


# transforms: channels are bytes, a pixel's alpha, red, green, blue from the top


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Channel by channel, modulo 256."""
    odd, even = _U(0xFF00FF00), _U(0x00FF00FF)
    return ((a & odd) + (b & odd)) & odd | ((a & even) + (b & even)) & even


def _subtract(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    odd, even = _U(0xFF00FF00), _U(0x00FF00FF)
    return ((a | even) - (b & odd)) & odd | ((a | odd) - (b & even)) & even


def _mean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (((a ^ b) & _U(0xFEFEFEFE)) >> _U(1)) + (a & b)


def _channels(p: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(p).view(np.uint8).reshape(*p.shape, 4).astype(np.int32)


def _joined(c: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.clip(c, 0, 255).astype(np.uint8)).view(np.uint32)[..., 0]


def _select(left: np.ndarray, top: np.ndarray, corner: np.ndarray) -> np.ndarray:
    a, b, c = map(_channels, (left, top, corner))
    return np.where(np.abs(b - c).sum(axis=-1) < np.abs(a - c).sum(axis=-1), left, top)  # |p - L| = |T - TL| by channel


def _half(left: np.ndarray, top: np.ndarray, corner: np.ndarray) -> np.ndarray:
    a, c = _channels(_mean(left, top)), _channels(corner)
    step = a - c
    return _joined(a + np.where(step < 0, -(-step >> 1), step >> 1))


#: What each mode foretells from the left, top, top right and top left pixels.
MODES = (
    lambda l, t, r, c: np.full_like(l, BLACK),
    lambda l, t, r, c: l,
    lambda l, t, r, c: t,
    lambda l, t, r, c: r,
    lambda l, t, r, c: c,
    lambda l, t, r, c: _mean(_mean(l, r), t),
    lambda l, t, r, c: _mean(l, c),
    lambda l, t, r, c: _mean(l, t),
    lambda l, t, r, c: _mean(c, t),
    lambda l, t, r, c: _mean(t, r),
    lambda l, t, r, c: _mean(_mean(l, c), _mean(t, r)),
    lambda l, t, r, c: _select(l, t, c),
    lambda l, t, r, c: _joined(_channels(l) + _channels(t) - _channels(c)),
    lambda l, t, r, c: _half(l, t, c),
)


def _modes(image: np.ndarray, bits: int, height: int, width: int) -> np.ndarray:
    """The mode of each pixel; the first row looks left and the first column up."""
    own = _spread((image >> _U(8)).astype(np.int64) & 15, bits, height, width).copy()
    own[own >= len(MODES)] = 0
    own[0], own[1:, 0], own[0, 0] = 1, 2, 0
    return own


def _foretold(flat: np.ndarray, at: np.ndarray, width: int, mode: np.ndarray) -> np.ndarray:
    """What the pixels at ``at`` are foretold to be; the pixel right of the last column is the first of the row below."""
    near = [flat[np.maximum(at - k, 0)] for k in (1, width, width - 1, width + 1)]
    out = np.empty(len(at), np.uint32)
    for m in np.unique(mode).tolist():
        own = np.flatnonzero(mode == m)
        out[own] = MODES[m](*[x[own] for x in near])
    return out


def _unpredict(residual: np.ndarray, modes: np.ndarray) -> np.ndarray:
    """Diagonals x + 2y hold pixels that do not depend on each other."""
    height, width = residual.shape
    out, left, mode = np.zeros(height * width, np.uint32), residual.ravel(), modes.ravel()
    for t in range(width + 2 * (height - 1)):
        y = np.arange(max(0, (t - width + 2) // 2), min(height - 1, t // 2) + 1)
        at = y * width + t - 2 * y
        out[at] = _add(left[at], _foretold(out, at, width, mode[at]))
    return out.reshape(height, width)


def _cross(p: np.ndarray, by: np.ndarray, back: bool) -> np.ndarray:
    """Red and blue less (or, back, plus) what green and red tell of them; by: the multipliers of each pixel."""
    signed = lambda x, s: ((x >> _U(s)) & _U(255)).astype(np.uint8).view(np.int8).astype(np.int32)
    to_red, green_to_blue, red_to_blue = signed(by, 0), signed(by, 8), signed(by, 16)
    green, sign = signed(p, 8), 1 if back else -1
    red = ((p >> _U(16)) & _U(255)).astype(np.int32) + sign * ((to_red * green) >> 5) & 255
    true_red = (red.astype(np.uint8).view(np.int8) if back else signed(p, 16)).astype(np.int32)
    blue = (p & _U(255)).astype(np.int32) + sign * (((green_to_blue * green) >> 5) + ((red_to_blue * true_red) >> 5)) & 255
    return p & _U(0xFF00FF00) | red.astype(np.uint32) << _U(16) | blue.astype(np.uint32)


def _green(p: np.ndarray) -> np.ndarray:
    g = (p >> _U(8)) & _U(255)
    return g << _U(16) | g


def _bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _unpalette(p: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """Places in the palette, 1 to 8 in a pixel's green, -> colours; places beyond it are transparent."""
    places, bundle = (p >> _U(8)) & _U(255), _bundle_bits(len(table))
    if bundle:
        each = 8 >> bundle
        places = ((places[..., None] >> (np.arange(1 << bundle, dtype=np.uint32) * _U(each))) & _U((1 << each) - 1)).reshape(len(p), -1)[:, :width]
    return np.concatenate([table, np.zeros(256 - len(table), np.uint32)])[places]


def _chunk(data: bytes) -> bytes:
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if name == b"VP8L":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no lossless image in the file")


def split(data: bytes) -> list[bytes]:
    """The files of a column's value that holds them one after another."""
    out, at = [], 0
    while at < len(data):
        size = 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        out.append(data[at : at + size + size % 2])
        at += size + size % 2
    return out


def decode(data: bytes) -> np.ndarray:
    """One file -> its pixels, height x width."""
    bits = Bits(_chunk(data))
    if bits.take(8) != 0x2F:
        raise ValueError("not a lossless image")
    width, height, alpha = bits.take(14) + 1, bits.take(14) + 1, bits.take(1)
    if bits.take(3):
        raise ValueError("a version to come")
    now, undo = width, []
    while bits.take(1):
        kind = bits.take(2)
        if any(kind == k for k, *_ in undo):
            raise ValueError("a transform applied twice")
        if kind in (PREDICT, CROSS):
            block = bits.take(3) + 2
            undo.append((kind, _read_pixels(bits, _blocks(now, block), _blocks(height, block), False), block, now))
        elif kind == PALETTE:
            size = bits.take(8) + 1
            steps = _read_pixels(bits, size, 1, False)
            table = np.ascontiguousarray(np.cumsum(_channels(steps[0]), axis=0).astype(np.uint8)).view(np.uint32)[:, 0]
            undo.append((kind, table, 0, now))
            now = _blocks(now, _bundle_bits(size))
        else:
            undo.append((kind, None, 0, now))
    p = _read_pixels(bits, now, height, True)
    if bits.at > bits.end:
        raise ValueError("the file ends early")
    for kind, image, block, own in reversed(undo):
        if kind == PREDICT:
            p = _unpredict(p, _modes(image, block, height, own))
        elif kind == CROSS:
            p = _cross(p, _spread(image, block, height, own), True)
        elif kind == GREEN:
            p = _add(p, _green(p))
        else:
            p = _unpalette(p, image, own)
    return p if alpha else p | _U(BLACK)


# writing


class _Out:
    """Numbers of up to 57 bits each, written at once at the end."""

    def __init__(self):
        self.values, self.sizes = [], []
        self.some: tuple[list[int], list[int]] = ([], [])

    def put(self, value: int, size: int) -> None:
        self.some[0].append(value)
        self.some[1].append(size)

    def all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values += [np.array(self.some[0], np.uint64), values.view(np.uint64)]
        self.sizes += [np.array(self.some[1], np.int64), sizes]
        self.some = ([], [])

    def bytes(self) -> bytes:
        self.all(np.empty(0, np.int64), np.empty(0, np.int64))
        values, sizes = np.concatenate(self.values), np.concatenate(self.sizes)
        if not sizes.all():
            keep = sizes > 0
            values, sizes = values[keep], sizes[keep]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        word, shift = starts >> 6, (starts & 63).astype(np.uint64)
        out = np.zeros(int(ends[-1] >> 6) + 2, np.uint64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] = np.bitwise_or.reduceat(values << shift, first)
        over = np.flatnonzero((starts & 63) + sizes > 64)  # at most one a word
        out[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
        return out.tobytes()[: (int(ends[-1]) + 7) >> 3]


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of a prefix code for the symbols that occur, none above ``most``; one symbol alone has length 1."""
    used = np.flatnonzero(counts)
    out, least = np.zeros(len(counts), np.int64), 1
    if len(used) < 2:
        out[used if len(used) else [0]] = 1
        return out
    weights, n, none = counts[used].tolist(), len(used), 1 << 63
    while True:
        leaves = sorted([max(w, least) << 20 | i for i, w in enumerate(weights)]) + [none, none]
        made = [none] * (n + 1)  # nodes, which come to be in order of weight
        up, leaf, at = [0] * (2 * n - 1), 0, 0
        for node in range(n, 2 * n - 1):
            a, b = leaves[leaf], made[at]
            if a < b:
                leaf += 1
            else:
                a, at = b, at + 1
            b, c = leaves[leaf], made[at]
            if b < c:
                leaf += 1
            else:
                b, at = c, at + 1
            up[a & 0xFFFFF] = up[b & 0xFFFFF] = node
            made[node - n] = ((a >> 20) + (b >> 20)) << 20 | node
        depth = up
        depth[-1] = 0
        for i in range(2 * n - 3, -1, -1):
            depth[i] = depth[up[i]] + 1
        if max(depth) <= most:
            out[used] = depth[:n]
            return out
        least *= 2  # rarer symbols count as this often: the code gets flatter


def _codes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits as they are written, how many) by symbol; a symbol alone takes none."""
    used = np.flatnonzero(lengths)
    values, sizes = np.zeros((2, len(lengths)), np.int64)
    if len(used) > 1:
        own = lengths[used]
        order = used[np.argsort(own, kind="stable")]
        longest = int(own.max())
        spans = 1 << (longest - lengths[order])
        values[order], sizes[order] = _reversed(longest)[np.cumsum(spans) - spans], lengths[order]
    return values, sizes


def _few_codes(lengths: list[int]) -> tuple[list[int], list[int]]:
    """_codes for few symbols and at most 7 bits."""
    values, sizes, code, before = [0] * len(lengths), [0] * len(lengths), 0, 0
    order = sorted([n << 8 | s for s, n in enumerate(lengths) if n])
    for x in order if len(order) > 1 else ():
        n, s = x >> 8, x & 255
        code <<= n - before
        values[s], sizes[s], before = _BACKWARDS[code] >> (7 - n), n, n
        code += 1
    return values, sizes


def _write_few(out: _Out, first: int, *second: int) -> None:
    """The code of one symbol or two, in order."""
    wide = int(first > 1)
    out.some[0].extend((1, len(second), wide, first, *second))
    out.some[1].extend((1, 1, 1, 8 if wide else 1, *[8 for _ in second]))


def _write_code(out: _Out, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and used[-1] < LITERALS:
        _write_few(out, *used.tolist())
        return
    edges = np.flatnonzero(lengths[1:] != lengths[:-1]) + 1
    starts = np.concatenate([[0], edges])
    symbols, extras, before = [], [], 8  # of the code for lengths; an extra is (value, bits)
    for value, n in zip(lengths[starts].tolist(), _gaps(starts, len(lengths)).tolist()):
        if value and value != before:
            symbols.append(value)
            extras.append((0, 0))
            n, before = n - 1, value
        while n > 2:
            k = min(n, 6 if value else 138)
            symbols.append(16 if value else 17 if k < 11 else 18)
            extras.append((k - 3, 2) if value else (k - 3, 3) if k < 11 else (k - 11, 7))
            n -= k
        symbols += [value] * n
        extras += [(0, 0)] * n
    inner = code_lengths(np.bincount(symbols, minlength=len(LENGTH_ORDER)), 7).tolist()
    n = max(4, 1 + max(k for k, s in enumerate(LENGTH_ORDER) if inner[s]))
    values, sizes = _few_codes(inner)
    out.some[0].extend([0, n - 4, *[inner[s] for s in LENGTH_ORDER[:n]], 0, *[values[s] | extra << sizes[s] for s, (extra, _) in zip(symbols, extras)]])
    out.some[1].extend([1, 4, *[3] * n, 1, *[sizes[s] + bits for s, (_, bits) in zip(symbols, extras)]])


def _prefixed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers from 1 -> (prefix, extra bits' value, how many)."""
    rest = x - 1
    high = np.frexp(np.maximum(rest, 1).astype(np.float64))[1] - 1
    extra = np.where(rest < 4, 0, high - 1)
    return np.where(rest < 4, rest, 2 * high + (rest >> np.maximum(extra, 0) & 1)), rest & ((1 << extra) - 1), extra


@lru_cache(None)
def _near(width: int) -> np.ndarray:
    """By distance in pixels the short code that says it, 0 where none does."""
    out = np.zeros(8 * width + 9, np.int64)
    for k in range(len(NEAR), 0, -1):
        x, y = NEAR[k - 1]
        out[max(x + y * width, 1)] = k
    return out


def _gaps(x: np.ndarray, end: int) -> np.ndarray:
    """From each number to the next, and from the last to end."""
    return np.concatenate([x[1:], [end]]) - x


def copies_of(p: np.ndarray, at: np.ndarray, keys: np.ndarray, least: int) -> np.ndarray:
    """Rows of start, length, distance of copies apart from each other, of ``least`` pixels or more.

    keys: what the pixels from each place in ``at`` on are known by. From a place on,
    pixels are compared with those from the nearest place before that has its key.
    """
    order = keys.argsort(kind="stable")
    same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    none = np.empty((0, 3), np.int64)
    if not len(same):
        return none
    back = np.zeros(len(at), np.int64)
    back[order[same + 1]] = at[order[same + 1]] - at[order[same]]
    back[back > FARTHEST] = 0
    gaps = _gaps(at, len(p))
    if 16 * gaps[back > 0].sum() < len(p):  # more than these places cannot be copied
        return none
    d = np.zeros(len(p), np.int64)
    d[at[0] :] = back.repeat(gaps)
    d *= p == p[np.arange(len(p)) - d]
    edges = np.flatnonzero(d[1:] != d[:-1]) + 1
    starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(p)]])
    long = np.flatnonzero((d[starts] > 0) & (ends - starts >= least))
    found = np.stack([starts[long], ends[long] - starts[long], d[starts[long]]], axis=1)
    if len(found) and found[:, 1].max() > LONGEST:
        found = np.array([(x, min(LONGEST, start + size - x), back) for start, size, back in found.tolist() for x in range(start, start + size, LONGEST)], np.int64)
    return found if 16 * found[:, 1].sum() >= len(p) else none  # else their own codes cost more


def _write_pixels(out: _Out, image: np.ndarray, main: bool, cache_bits: int = 0, groups: tuple[int, np.ndarray] | None = None, copies: bool = False) -> None:
    height, width = image.shape
    p = np.ascontiguousarray(image, np.uint32).ravel()
    n = len(p)
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    which, n_groups = None, 1
    if main:
        out.put(int(groups is not None), 1)
    if groups is not None:
        block, of = groups
        out.put(block - 2, 3)
        _write_pixels(out, of.astype(np.uint32) << _U(8) | _U(BLACK), False)
        which, n_groups = _spread(of, block, height, width).ravel(), int(of.max()) + 1
    green = (p >> _U(8)).astype(np.uint8)
    still = not ((p ^ p[0]) & _U(0xFFFF00FF)).any()  # green alone changes
    found = np.empty((0, 3), np.int64)
    if copies and n > 16:
        if still:  # 8 pixels make a key; those after the most frequent one are looked up
            at = np.flatnonzero(green[:-8] == np.bincount(green).argmax()) + 1
            found = copies_of(green, at, np.ndarray((n - 7,), "<u8", green, strides=(1,))[at], 8) if len(at) else found
        else:
            found = copies_of(p, np.arange(n - 1), p[:-1].astype(np.uint64) | p[1:].astype(np.uint64) << np.uint64(32), 4)
    at, size, back = found.T
    if len(found):
        inside = np.zeros(n + 1, np.int8)
        inside[at + 1] += 1
        inside[at + size] -= 1
        at_token = np.flatnonzero(inside.cumsum(dtype=np.int8)[:n] == 0)
        p_token, green_of = p[at_token], green[at_token].astype(np.int64)
    else:
        at_token, p_token, green_of = None, p, green.astype(np.int64)
    kind = np.zeros(len(p_token), np.int8)  # 1: a copy, 2: a place in the cache
    if cache_bits:
        slot = _slot(p, cache_bits)
        order = np.argsort(slot, kind="stable")
        known = np.zeros(n, bool)
        known[order[1:]] = (slot[order[1:]] == slot[order[:-1]]) & (p[order[1:]] == p[order[:-1]])
        if at_token is not None:
            known, slot = known[at_token], slot[at_token]
        kind[known] = 2
        green_of[known] = LITERALS + LENGTHS + slot[known]
    tokens, fields = np.empty(0, np.int64), []  # of copies: prefix, extra bits' value, how many, for lengths and for distance codes
    if len(found):
        tokens = np.searchsorted(at_token, at)
        near = _near(width)
        code = near[np.minimum(back, len(near) - 1)] * (back < len(near))
        fields = [_prefixed(size), _prefixed(np.where(code > 0, code, back + len(NEAR)))]
        kind[tokens] = 1
        green_of[tokens] = LITERALS + fields[0][0]
    # a token's green symbol, then three more fields: of all where more than green changes, else of copies
    if still:
        place = np.arange(len(p_token))
        if len(found):
            ahead = np.zeros(len(p_token) + 1, np.int64)
            ahead[tokens + 1] = 3
            place += ahead.cumsum()[:-1]
        plain = place[:0]
        others = [np.array([p[0] >> _U(shift) & _U(255)], np.int64) for shift in (16, 0, 24)]
    else:
        place = 4 * np.arange(len(p_token))
        plain = np.flatnonzero(kind == 0)
        others = [(p_token[plain] >> _U(shift) & _U(255)).astype(np.int64) for shift in (16, 0, 24)]
    values, sizes = (np.zeros((4 if not still else 1) * len(p_token) + 3 * len(tokens) * still, np.int64) for _ in range(2))
    alphabet = LITERALS + LENGTHS + ((1 << cache_bits) if cache_bits else 0)

    def write(symbols: np.ndarray, size: int, into: np.ndarray | slice) -> None:
        only = int(symbols[0]) if len(symbols) == 1 else LITERALS if len(symbols) else 0
        if only < LITERALS:
            _write_few(out, only)
            return
        lengths = code_lengths(np.bincount(symbols, minlength=size), 15)
        _write_code(out, lengths)
        if np.count_nonzero(lengths) > 1:
            code, long = _codes(lengths)
            values[into], sizes[into] = code.take(symbols), long.take(symbols)

    group = which if which is None or at_token is None else which[at_token]
    for k in range(n_groups):
        every, lit, far = (slice(None), slice(None), slice(None)) if group is None else (group == k, slice(None) if still else group[plain] == k, group[tokens] == k)
        write(green_of[every], alphabet, every if still and not len(found) else place[every])
        for field, x in enumerate(others, 1):
            write(x[lit], LITERALS, place[plain][lit] + field)
        write(fields[1][0][far] if len(found) else tokens, DISTANCES, place[tokens][far] + 2)
    for k, (_, extra, n_extra) in enumerate(fields):
        values[place[tokens] + 1 + 2 * k], sizes[place[tokens] + 1 + 2 * k] = extra, n_extra
    out.all(values, sizes)


def encode(
    image: np.ndarray,
    *,
    palette: bool = True,
    predict: tuple[int, np.ndarray] | None = None,
    cross: tuple[int, np.ndarray] | None = None,
    green: bool = True,
    cache_bits: int = 0,
    groups: tuple[int, np.ndarray] | None = None,
    copies: bool = True,
) -> bytes:
    """Pixels, height x width -> one file.

    palette: by places in it, where there are at most 16 colours; then no other
    transform follows. predict: (bits of a block's side, mode of each block). cross:
    (bits, multipliers of each block as pixels). groups: (bits, group of each block).
    """
    p = np.ascontiguousarray(image, np.uint32)
    height, width = p.shape
    if not (0 < width <= MOST_SIDE and 0 < height <= MOST_SIDE):
        raise ValueError("an image's sides are 1 to 16384 pixels")
    out = _Out()
    for value, size in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (int((p >> _U(24) != 255).any()), 1), (0, 3)):
        out.put(value, size)
    some = palette and len(np.unique(p.ravel()[:256])) <= 16
    table = np.unique(p) if some else ()
    if 0 < len(table) <= 16:
        bundle = _bundle_bits(len(table))
        out.put(1, 1)
        out.put(PALETTE, 2)
        out.put(len(table) - 1, 8)
        _write_pixels(out, _subtract(table, np.concatenate([[_U(0)], table[:-1]]).astype(np.uint32))[None, :], False)
        places = np.zeros((height, _blocks(width, bundle) << bundle), np.uint32)
        places[:, :width] = np.searchsorted(table, p)
        each = places.reshape(height, -1, 1 << bundle) << (np.arange(1 << bundle, dtype=np.uint32) * _U(8 >> bundle))
        p = np.bitwise_or.reduce(each, axis=2) << _U(8) | _U(BLACK)
    else:
        if predict:
            block, modes = predict
            out.put(1, 1)
            out.put(PREDICT, 2)
            out.put(block - 2, 3)
            blocks = modes.astype(np.uint32) << _U(8) | _U(BLACK)
            _write_pixels(out, blocks, False)
            p = _subtract(p.ravel(), _foretold(p.ravel(), np.arange(p.size), width, _modes(blocks, block, height, width).ravel())).reshape(p.shape)
        if cross:
            block, by = cross
            out.put(1, 1)
            out.put(CROSS, 2)
            out.put(block - 2, 3)
            _write_pixels(out, by.astype(np.uint32), False)
            p = _cross(p, _spread(by.astype(np.uint32), block, height, width), False)
        if green:
            out.put(1, 1)
            out.put(GREEN, 2)
            p = _subtract(p, _green(p))
    out.put(0, 1)
    _write_pixels(out, p, True, cache_bits, groups, copies)
    body = out.bytes()
    size = len(body) + len(body) % 2
    return b"RIFF" + struct.pack("<I", 12 + size) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + bytes(len(body) % 2)
