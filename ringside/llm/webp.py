"""Lossless WebP (the VP8L bitstream), written and read with numpy.

The decoder reads everything the format has: prefix codes (simple, normal, and groups of them chosen by an entropy image),
back-references with the two-dimensional distance codes, the colour cache, and the predictor, cross-colour, subtract-green and
palette transforms.  Images with one group of codes, such as the encoder writes, are decoded for all bit positions at once: table
lookups give every position the symbols that would start there and where they end, and following these ends from the first bit
marks the pixels.  Other images are decoded pixel by pixel.

The encoder chooses by estimated bits, for each image: a palette, else a predictor, cross-colour or subtract-green transform or
none; then literal pixels, back-references to the nearest earlier place with the same two pixels, or a colour cache.

Pixels are arrays of shape (height, width, 4), 8-bit samples in the order red, green, blue, alpha.  All samples are kept, those
of transparent pixels too.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np

LONGEST = 15  # bits of a prefix code
MOST = 1 << 14  # pixels of a side
SHORTEST = 2  # pixels that the encoder stores as a copy
WINDOW = (1 << 20) - 120  # the farthest pixel that a copy reaches back to
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)

#: Fixed values of the format: the order in which lengths of the code-length code are stored.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]

#: Fixed values of the format: (x, y) of the distance codes 1 to 120; the pixel x to the left in the row y above.
NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]


# ---------------------------------------------------------------- prefix codes


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman code lengths of at most LONGEST bits; one used symbol alone has length 1, no used symbol counts as symbol 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used if len(used) else 0] = 1
        return out
    weights = counts[used].tolist()
    while True:
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent = [0] * (2 * len(weights) - 1)
        node = len(weights)
        while len(heap) > 1:
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            parent[i] = parent[j] = node
            heapq.heapreplace(heap, (a + b, node))
            node += 1
        depth = [0] * node
        for i in range(node - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        own = depth[: len(weights)]
        if max(own) <= LONGEST:
            out[used] = own
            return out
        weights = [(w + 1) // 2 for w in weights]


def _mirror() -> np.ndarray:
    """The LONGEST bits of each number in reverse."""
    n = np.arange(1 << LONGEST)
    return sum(((n >> b) & 1) << (LONGEST - 1 - b) for b in range(LONGEST))


_MIRROR = _mirror()


@lru_cache(maxsize=8)
def _codes(lengths: bytes) -> np.ndarray:
    """The canonical codes of the lengths, first bit lowest."""
    size = np.frombuffer(lengths, np.uint8)
    order = np.argsort(size, kind="stable")
    order = order[np.count_nonzero(size == 0) :]
    own = size[order].astype(np.int64)
    # Each code is one more than the one before, widened to its own length: at full width the steps add up.
    code = np.zeros(len(size), np.int64)
    step = 1 << (LONGEST - own)
    code[order] = _MIRROR[np.cumsum(step) - step] if len(order) else 0
    return code


def codes(lengths: np.ndarray) -> np.ndarray:
    return _codes(lengths.tobytes())


@lru_cache(maxsize=8)
def _table(lengths: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """(bits, symbol, length) of a lookup by the next bits.  A code of one symbol takes no bits."""
    size = np.frombuffer(lengths, np.uint8)
    used = np.flatnonzero(size)
    if len(used) == 1:
        return 0, np.array([used[0]], np.int32), np.zeros(1, np.int32)
    order = np.argsort(size, kind="stable")[len(size) - len(used) :]
    own = size[order]
    bits = int(own[-1]) if len(own) else 0
    spread = 1 << (bits - own.astype(np.int64))
    if not len(own) or bits > LONGEST or spread.sum() != 1 << bits:
        raise ValueError("not a complete prefix code")
    # In the order of codes the table is runs of symbols; it is looked up by mirrored bits.
    mirrored = _MIRROR[: 1 << bits] >> (LONGEST - bits)
    return bits, np.repeat(order.astype(np.int32), spread).take(mirrored, mode="clip"), np.repeat(own.astype(np.int32), spread).take(mirrored, mode="clip")


# ---------------------------------------------------------------- bits


class Writer:
    """Bits, lowest first."""

    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, bits: int) -> None:
        self.value |= int(value) << self.n
        self.n += int(bits)

    def put_many(self, values: np.ndarray, bits: np.ndarray) -> None:
        """values of up to 60 bits each."""
        if not len(values):
            return
        at = np.cumsum(bits) - bits
        total = int(at[-1] + bits[-1])
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        values = values.astype(np.uint64)
        n_words = (total >> 6) + 2
        out = np.zeros(n_words, np.uint64)
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[starts]] = np.bitwise_or.reduceat(values << shift, starts)
        over = (values >> np.uint64(1)) >> (np.uint64(63) - shift)
        out[word[starts] + 1] |= np.bitwise_or.reduceat(over, starts)
        self.value |= int.from_bytes(out.tobytes(), "little") << self.n
        self.n += total

    def bytes(self) -> bytes:
        return self.value.to_bytes(-(-self.n // 8), "little")


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.code: tuple[int, int, np.ndarray] | None = None  # bits, their number and lengths of the last normal code

    def window(self, n: int) -> int:
        """The next n bits, as many as there may be."""
        byte = self.at >> 3
        return (int.from_bytes(self.data[byte : byte + (n >> 3) + 2], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def bits(self, n: int) -> int:
        found = self.peek(n)
        self.at += n
        return found

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return (int.from_bytes(self.data[byte : byte + 8], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def symbol(self, table: tuple[int, np.ndarray, np.ndarray]) -> int:
        bits, symbol, length = table
        i = self.peek(bits)
        self.at += int(length[i])
        if self.at > 8 * len(self.data):
            raise ValueError("the image ends early")
        return int(symbol[i])


def _put_code(w: Writer, lengths: np.ndarray) -> None:
    """One prefix code."""
    w.put(*_stored(lengths[: int(np.flatnonzero(lengths)[-1]) + 1].tobytes()))


@lru_cache(maxsize=8)
def _stored(lengths: bytes) -> tuple[int, int]:
    """(bits, their number) of a prefix code, from its lengths up to the last used symbol."""
    own = list(lengths)
    if own.count(0) == len(own) - 1 and len(own) <= 256:  # simple
        return 0b101 | (len(own) - 1) << 3, 11
    items: list[tuple[int, int, int]] = []  # (symbol, extra, its bits)
    add = items.append
    edges = np.flatnonzero(np.diff(np.frombuffer(lengths, np.uint8))) + 1
    begins = [0, *edges.tolist()]
    for a, b in zip(begins, [*begins[1:], len(own)], strict=True):
        v, n = own[a], b - a
        if v:
            add((v, 0, 0))
            n -= 1
            while n >= 3:
                k = min(n, 6)
                add((16, k - 3, 2))
                n -= k
        else:
            while n >= 11:
                k = min(n, 138)
                add((18, k - 11, 7))
                n -= k
            if n >= 3:
                add((17, n - 3, 3))
                n = 0
        items += [(v, 0, 0)] * n
    counts = np.bincount([s for s, _, _ in items], minlength=19)
    if (counts > 0).sum() == 1:
        counts[0 if counts[0] == 0 else 1] = 1  # a second symbol, as the code must be complete
    size = _short(code_lengths(counts), counts).tolist()
    w = Writer()
    w.put(0, 1)
    stored = max(4, 1 + max(i for i, s in enumerate(LENGTH_ORDER) if size[s]))
    w.put(stored - 4, 4)
    for s in LENGTH_ORDER[:stored]:
        w.put(size[s], 3)
    more = max(len(items) - 2, 0)
    wide = max(2, more.bit_length())
    wide += wide & 1
    w.put(1, 1)  # the number of stored lengths follows
    w.put((wide - 2) // 2, 3)
    w.put(more, wide)
    if len(items) < 2:
        items.append((0, 0, 0))
    code = _few_codes(size)
    bits = "".join([f"{extra:0{n}b}{code[s]}" if n else code[s] for s, extra, n in reversed(items)])
    return w.value | int("0" + bits, 2) << w.n, w.n + len(bits)


def _few_codes(size: list[int]) -> list[str]:
    """codes() of some lengths as bits, last bit first."""
    out, code = [""] * len(size), 0
    for s in sorted((s for s, n in enumerate(size) if n), key=size.__getitem__):
        out[s] = f"{code >> (LONGEST - size[s]):0{size[s]}b}"[::-1]
        code += 1 << (LONGEST - size[s])
    return out


def _short(size: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Lengths of the code-length code, which has at most 7 bits."""
    while size.max() > 7:
        counts = (counts + 1) // 2
        size = code_lengths(counts)
    return size


def _get_code(r: Reader, alphabet: int) -> tuple[int, np.ndarray, np.ndarray]:
    if r.code is not None and r.window(r.code[1]) == r.code[0] and len(r.code[2]) <= alphabet:  # the last one again
        r.at += r.code[1]
        return _table(r.code[2].tobytes())
    lengths = np.zeros(alphabet, np.uint8)
    start = r.at
    if r.bits(1):
        two = r.bits(1)
        lengths[r.bits(8 if r.bits(1) else 1)] = 1
        if two:
            lengths[r.bits(8)] = 1
        return _table(lengths.tobytes())
    size = np.zeros(19, np.uint8)
    for s in LENGTH_ORDER[: 4 + r.bits(4)]:
        size[s] = r.bits(3)
    wide, symbols, sizes = _table(size.tobytes())
    symbols, sizes, mask = symbols.tolist(), sizes.tolist(), (1 << wide) - 1
    counted = r.bits(1)
    left = 2 + r.bits(2 + 2 * r.bits(3)) if counted else alphabet
    found: list[int] = []
    last, at, value = 8, 0, r.window(alphabet * 14)  # a length takes at most 7 bits and 7 more
    while len(found) < alphabet and left:
        left -= 1
        i = (value >> at) & mask
        s = symbols[i]
        at += sizes[i]
        if s < 16:
            found.append(s)
            last = s or last
        elif s == 16:
            found += [last] * (3 + ((value >> at) & 3))
            at += 2
        elif s == 17:
            found += [0] * (3 + ((value >> at) & 7))
            at += 3
        else:
            found += [0] * (11 + ((value >> at) & 127))
            at += 7
    if len(found) > alphabet:
        raise ValueError("too many code lengths")
    r.at += at
    lengths = np.array(found, np.uint8)
    if counted and len(found) < alphabet:  # its bits mean the same for any alphabet that is as large
        r.code = (int.from_bytes(r.data[start >> 3 : (r.at >> 3) + 1], "little") >> (start & 7) & ((1 << (r.at - start)) - 1), r.at - start, lengths)
    return _table(lengths.tobytes())


# ---------------------------------------------------------------- lengths and distances


def _prefix(value: int) -> tuple[int, int, int]:
    """(symbol, extra, its bits) of a length or distance code."""
    if value <= 4:
        return value - 1, 0, 0
    value -= 1
    high = value.bit_length() - 1
    second = (value >> (high - 1)) & 1
    return 2 * high + second, value & ((1 << (high - 1)) - 1), high - 1


def _extra(symbol):
    """(bits, offset) for a symbol or an array of them."""
    bits = np.maximum((np.asarray(symbol) - 2) >> 1, 0)
    return bits, np.where(np.asarray(symbol) < 4, symbol, (2 + (np.asarray(symbol) & 1)) << bits)


def _distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


# ---------------------------------------------------------------- decoding


def decode(data: bytes) -> np.ndarray:
    """The pixels of a WebP file with a lossless image."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"VP8L":
            return _decode_stream(data[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image")


def _decode_stream(data: bytes) -> np.ndarray:
    r = Reader(data)
    if r.bits(8) != 0x2F:
        raise ValueError("not a lossless image")
    width, height = r.bits(14) + 1, r.bits(14) + 1
    r.bits(1)
    if r.bits(3):
        raise ValueError("unknown version")
    transforms, w = [], width
    while r.bits(1):
        kind = r.bits(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.bits(3) + 2
            transforms.append((kind, w, bits, _image(r, -(-w >> bits), -(-height >> bits), False)))
        elif kind == SUBTRACT_GREEN:
            transforms.append((kind, w, 0, None))
        else:
            n = r.bits(8) + 1
            colours = np.cumsum(_image(r, n, 1, False)[0], axis=0, dtype=np.uint8)
            bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((kind, w, bits, colours))
            w = -(-w >> bits)
    pixels = _image(r, w, height, True)
    for kind, w, bits, extra in reversed(transforms):
        pixels = _INVERSE[kind](pixels, w, bits, extra)
    return pixels


def _image(r: Reader, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = r.bits(4) if r.bits(1) else 0
    group_of, bits, n_groups = None, 0, 1
    if main and r.bits(1):
        bits = r.bits(3) + 2
        chosen = _image(r, -(-width >> bits), -(-height >> bits), False).astype(np.int64)
        group_of = (chosen[:, :, 0] << 8) | chosen[:, :, 1]
        n_groups = int(group_of.max()) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    groups = [[_get_code(r, n) for n in sizes] for _ in range(n_groups)]
    if n_groups == 1:
        return _all_at_once(r, groups[0], cache_bits, width, height)
    return _one_by_one(r, groups, group_of, bits, cache_bits, width, height)


def _all_at_once(r: Reader, tables: list, cache_bits: int, width: int, height: int) -> np.ndarray:
    n = width * height
    green, red, blue, alpha, far = tables
    out = np.empty((n, 4), np.uint8)
    if not any(t[0] for t in tables[:4]) and green[1][0] < 256:  # no bits at all
        out[:] = [red[1][0], green[1][0], blue[1][0], alpha[1][0]]
        return out.reshape(height, width, 4)
    base = r.at >> 3
    raw = np.frombuffer(r.data[base:] + b"\0" * 16, np.uint8)
    size = len(raw) - 8
    word = raw[: size + 4].astype(np.uint32)
    word = word[:size] | (word[1 : size + 1] << 8) | (word[2 : size + 2] << 16) | (word[3 : size + 3] << 24)
    peek = np.empty((size, 8), np.uint32)  # at least 25 bits from each bit on
    for i in range(8):
        np.right_shift(word, np.uint32(i), out=peek[:, i])
    peek = peek.ravel()
    last = len(peek) - 1
    here = np.arange(len(peek))
    known: dict[int, np.ndarray] = {}

    def ends(table):
        """Where a symbol of this code that starts at each position ends; beyond the last position counts as there."""
        if not table[0]:
            return None
        if id(table) not in known:
            known[id(table)] = table[2].astype(np.int64).take(peek & np.uint32((1 << table[0]) - 1), mode="clip") + here
        return known[id(table)]

    def then(at, end):
        return at if end is None else end if at is here else end.take(at, mode="clip")

    at_red = then(here, ends(green))
    if green is red and green is blue and green is alpha:  # one code: two symbols on, twice
        at_blue = at_alpha = None
        two = then(at_red, ends(red))
        following = two.take(two, mode="clip")
    else:
        at_blue = then(at_red, ends(red))
        at_alpha = then(at_blue, ends(blue))
        following = then(at_alpha, ends(alpha))
    following = np.minimum(following, last)
    first = None
    if green[1].max() >= 256:
        first = green[1][peek & np.uint32((1 << green[0]) - 1)] if green[0] else np.full(len(peek), green[1][0])
    others = np.flatnonzero(first >= 256) if first is not None else here[:0]
    longer = None
    if len(others):
        following[others] = np.minimum(at_red[others], last)
        copies = others[first[others] < 280]
        if len(copies):
            length, distance, end = _copies(peek, np.minimum(at_red[copies], last), first[copies] - 256, far, last)
            following[copies] = end
            longer = np.zeros(len(peek), np.int64)
            longer[copies] = length
            farther = np.zeros(len(peek), np.int64)
            farther[copies] = distance
    # Follow the ends.
    hop, p, starts, done = memoryview(following), r.at - 8 * base, [], 0
    if longer is not None:
        lengths = memoryview(longer)
        while done < n:
            starts.append(p)
            done += lengths[p] or 1
            p = hop[p]
    else:
        # Four pixels at a time: those between follow from the first one of each four.
        four = memoryview(_twice(_twice(following)))
        put = starts.append
        for _ in range(-(-n // 4)):
            put(p)
            p = four[p]
    s = np.array(starts, np.int64)
    if longer is None:
        each = np.empty((len(s), 4), np.int64)
        each[:, 0] = s
        for i in range(3):
            each[:, i + 1] = following.take(each[:, i], mode="clip")
        s = each.ravel()[:n]
        p = hop[int(s[-1])]
    r.at = 8 * base + p
    if r.at > 8 * len(r.data):
        raise ValueError("the image ends early")

    def values(table, at):
        return table[1].take(peek.take(at, mode="clip") & np.uint32((1 << table[0]) - 1), mode="clip") if table[0] else np.full(len(at), table[1][0])

    def places(s):
        """Where red, blue and alpha of the pixels that start at ``s`` begin."""
        if at_blue is not None:
            return tuple(x.take(s, mode="clip") for x in (at_red, at_blue, at_alpha))
        second = at_red.take(s, mode="clip")
        third = at_red.take(second, mode="clip")
        return second, third, at_red.take(third, mode="clip")

    if not len(others):
        second, third, fourth = places(s)
        out[:, 1], out[:, 0], out[:, 2], out[:, 3] = values(green, s), values(red, second), values(blue, third), values(alpha, fourth)
        return out.reshape(height, width, 4)
    symbol = first[s]
    long = longer[s] if longer is not None else np.zeros(len(s), np.int64)
    place = np.cumsum(np.maximum(long, 1)) - np.maximum(long, 1)
    lit = symbol < 256
    q, to = s[lit], place[lit]
    second, third, fourth = places(q)
    out[to, 1], out[to, 0], out[to, 2], out[to, 3] = values(green, q), values(red, second), values(blue, third), values(alpha, fourth)
    held = symbol >= 280
    if held.any() and not long.any() and _fill_held(out, lit, np.where(held, symbol - 280, 0), cache_bits):
        return out.reshape(height, width, 4)
    cache, filled = np.zeros((1 << cache_bits, 4), np.uint8), 0
    codes = farther[s] if longer is not None else long
    for to, k, code, x in zip(place[~lit].tolist(), long[~lit].tolist(), codes[~lit].tolist(), symbol[~lit].tolist(), strict=True):
        if k:
            _copy(out, to, k, _distance(code, width))
        else:
            cache[_slots(out[filled:to], cache_bits)] = out[filled:to]
            filled = to
            out[to] = cache[x - 280]
    return out.reshape(height, width, 4)


def _twice(following: np.ndarray) -> np.ndarray:
    return following.take(following, mode="clip")


def _slots(pixels: np.ndarray, cache_bits: int) -> np.ndarray:
    """Where the colour cache holds pixels."""
    p = pixels.astype(np.uint32)
    key = (p[:, 3] << np.uint32(24)) | (p[:, 0] << np.uint32(16)) | (p[:, 1] << np.uint32(8)) | p[:, 2]
    return (key * np.uint32(0x1E35A7BD)) >> np.uint32(32 - cache_bits)


def _fill_held(out: np.ndarray, lit: np.ndarray, slot: np.ndarray, cache_bits: int) -> bool:
    """Put the pixels that the cache holds into ``out``, which has the literal ones; False if one asks for an empty slot.

    A pixel from the cache is the last literal one of the same slot.
    """
    slot[lit] = _slots(out[lit], cache_bits)
    order = np.argsort(slot, kind="stable")
    own, here = lit[order], np.arange(len(order))
    begins = np.maximum.accumulate(np.where(np.diff(slot[order], prepend=-1) != 0, here, 0))
    source = np.maximum.accumulate(np.where(own, here, -1))
    if (source < begins).any():
        return False
    out[order[~own]] = out[order[source[~own]]]
    return True


def _copies(peek: np.ndarray, at: np.ndarray, symbol: np.ndarray, far: tuple, last: int):
    """(length, distance code, end) of the back-references whose length symbols end at ``at``."""

    def number(symbol, at):
        bits, offset = _extra(symbol)
        low = np.minimum(bits, 12)  # a peek has 25 bits: longer extras take two
        value = peek[at] & ((1 << low) - 1).astype(np.uint32)
        rest = peek[np.minimum(at + low, last)] & ((1 << (bits - low)) - 1).astype(np.uint32)
        return offset + value.astype(np.int64) + (rest.astype(np.int64) << low) + 1, np.minimum(at + bits, last)

    length, at = number(symbol, at)
    if far[0]:
        i = peek[at] & np.uint32((1 << far[0]) - 1)
        symbol, at = far[1][i], np.minimum(at + far[2][i], last)
    else:
        symbol = np.full(len(at), far[1][0])
    distance, at = number(symbol, at)
    return length, distance, at


def _copy(out: np.ndarray, to: int, n: int, distance: int) -> None:
    n = min(n, len(out) - to)
    if distance > to:
        raise ValueError("a copy from before the image")
    if distance >= n:
        out[to : to + n] = out[to - distance : to - distance + n]
    else:
        out[to : to + n] = np.resize(out[to - distance : to], (n, 4))


def _one_by_one(r: Reader, groups: list, group_of, bits: int, cache_bits: int, width: int, height: int) -> np.ndarray:
    n = width * height
    out = np.zeros((n, 4), np.uint8)
    cache = np.zeros((1 << cache_bits, 4), np.uint8)
    cached = i = 0

    def fill(upto):
        nonlocal cached
        if cache_bits and upto > cached:
            cache[_slots(out[cached:upto], cache_bits)] = out[cached:upto]
        cached = upto

    while i < n:
        g = groups[group_of[i // width >> bits, i % width >> bits] if group_of is not None else 0]
        s = r.symbol(g[0])
        if s < 256:
            red, blue, alpha = r.symbol(g[1]), r.symbol(g[2]), r.symbol(g[3])
            out[i] = (red, s, blue, alpha)
            i += 1
        elif s < 280:
            wide, offset = _extra(s - 256)
            length = int(offset) + r.bits(int(wide)) + 1
            wide, offset = _extra(r.symbol(g[4]))
            _copy(out, i, length, _distance(int(offset) + r.bits(int(wide)) + 1, width))
            i = min(n, i + length)
        else:
            fill(i)
            out[i] = cache[s - 280]
            i += 1
    return out.reshape(height, width, 4)


# ---------------------------------------------------------------- transforms


def _blocks(data: np.ndarray, height: int, width: int, bits: int) -> np.ndarray:
    """Each pixel's element of a sub-image."""
    return data[np.arange(height)[:, None] >> bits, np.arange(width) >> bits]


def _average(a, b):
    return (a.astype(np.int16) + b) >> 1


def _predict(mode: int, left, top, top_left, top_right) -> np.ndarray:
    """The prediction of one mode, for pixels in the last axis."""
    if mode in (0, 14, 15):
        return np.broadcast_to(np.array([0, 0, 0, 255], np.uint8), top.shape)
    if mode in (1, 2, 3, 4):
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return _average(_average(left, top_right), top)
    if mode in (6, 7, 8, 9):
        a, b = ((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6]
        return _average(a, b)
    if mode == 10:
        return _average(_average(left, top_left), _average(top, top_right))
    a, b, c = left.astype(np.int16), top.astype(np.int16), top_left.astype(np.int16)
    if mode == 11:
        near_left, near_top = np.abs(b - c).sum(axis=-1), np.abs(a - c).sum(axis=-1)
        return np.where((near_left < near_top)[..., None], left, top)
    if mode == 12:
        return np.clip(a + b - c, 0, 255)
    mean = (a + b) >> 1
    diff = mean - c
    return np.clip(mean + (np.sign(diff) * (np.abs(diff) >> 1)), 0, 255)


#: Modes that don't look at the pixel to the left.
_ROWWISE = (0, 2, 3, 4, 8, 9, 14, 15)


def _undo_predictor(pixels: np.ndarray, width: int, bits: int, data: np.ndarray) -> np.ndarray:
    height = len(pixels)
    modes = _blocks(data[:, :, 1] & 15, height, width, bits)
    out = pixels.copy()
    out[0, :1, 3] += np.uint8(255)
    out[0] = np.cumsum(out[0], axis=0, dtype=np.uint8)
    for y in range(1, height):
        row, above = out[y], out[y - 1]
        row[0] += above[0]
        right = np.concatenate([above[1:], row[:1]])  # the last pixel's upper right is the row's first
        if set(np.unique(modes[y, 1:]).tolist()) <= set(_ROWWISE):
            for m in np.unique(modes[y, 1:]).tolist():
                at = np.flatnonzero(modes[y, 1:] == m) + 1
                row[at] += _predict(m, None, above[at], above[at - 1], right[at]).astype(np.uint8)
        elif (modes[y, 1:] == 1).all():
            out[y] = np.cumsum(row, axis=0, dtype=np.uint8)
        else:
            for x in range(1, width):
                row[x] += _predict(int(modes[y, x]), row[x - 1], above[x], above[x - 1], right[x]).astype(np.uint8)
    return out


def _scaled(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((t.astype(np.int8).astype(np.int32) * c.astype(np.int8).astype(np.int32)) >> 5).astype(np.uint8)


def _undo_cross_colour(pixels: np.ndarray, width: int, bits: int, data: np.ndarray) -> np.ndarray:
    e = _blocks(data, len(pixels), width, bits)
    out = pixels.copy()
    out[:, :, 0] += _scaled(e[:, :, 2], out[:, :, 1])
    out[:, :, 2] += _scaled(e[:, :, 1], out[:, :, 1])
    out[:, :, 2] += _scaled(e[:, :, 0], out[:, :, 0])
    return out


def _undo_subtract_green(pixels: np.ndarray, width: int, bits: int, data) -> np.ndarray:
    out = pixels.copy()
    out[:, :, 0] += out[:, :, 1]
    out[:, :, 2] += out[:, :, 1]
    return out


def _undo_palette(pixels: np.ndarray, width: int, bits: int, colours: np.ndarray) -> np.ndarray:
    each = 8 >> bits
    x = np.arange(width)
    index = (pixels[:, :, 1][:, x >> bits] >> ((x & ((1 << bits) - 1)) * each)) & ((1 << each) - 1)
    table = np.zeros((256, 4), np.uint8)
    table[: len(colours)] = colours
    return table[index]


_INVERSE = {PREDICTOR: _undo_predictor, CROSS_COLOUR: _undo_cross_colour, SUBTRACT_GREEN: _undo_subtract_green, PALETTE: _undo_palette}


# ---------------------------------------------------------------- encoding


def encode(pixels: np.ndarray, *, palette: bool = True, subtract_green: bool = False, predictor: int | None = None, cross_colour: tuple[int, int, int] | None = None, cache_bits: int | None = None) -> bytes:
    """A lossless WebP file.

    palette: index the colours if there are at most 256.  predictor: a mode of the format for the whole image.  cross_colour:
    (green to red, green to blue, red to blue) for the whole image.  Without any of these three and a palette they are chosen.
    cache_bits: 0 for no colour cache, None for a choice.
    """
    height, width = pixels.shape[:2]
    if not 0 < width <= MOST or not 0 < height <= MOST:
        raise ValueError(f"an image of {width} x {height} pixels can't be stored")
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    pixels = np.ascontiguousarray(pixels)
    words = pixels.view("<u4").reshape(height, width)
    found = _palette(words) if palette else None
    if found is not None:
        colours, index = found
        w.put(1, 1)
        w.put(PALETTE, 2)
        w.put(len(colours) - 1, 8)
        _put_image(w, np.diff(colours, axis=0, prepend=np.zeros((1, 4), np.uint8))[None], False)
        pixels = _bundle(index.reshape(height, width), len(colours))
    elif predictor is None and cross_colour is None and not subtract_green:
        predictor, cross_colour, subtract_green = _transforms(pixels)
    if predictor is not None:
        block = np.zeros(4, np.uint8)
        block[1] = predictor
        pixels = _put_blocks(w, PREDICTOR, pixels, block, _residual(pixels, predictor))
    if cross_colour is not None:
        block = np.array([*(x & 255 for x in reversed(cross_colour)), 255], np.uint8)
        pixels = _put_blocks(w, CROSS_COLOUR, pixels, block, _crossed(pixels, cross_colour))
    if subtract_green:
        w.put(1, 1)
        w.put(SUBTRACT_GREEN, 2)
        pixels = _less_green(pixels)
    w.put(0, 1)
    _put_image(w, pixels, True, cache_bits)
    body = w.bytes()
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


#: Bits for which a used symbol's code length is stored, about.
CODE_BITS = 4


#: What other tokens than literal pixels must save, as their codes take time to make and to read: 15 % of the bits.
WORTH = 0.85
_N_LOG_N = np.concatenate([[0.0], np.arange(1, 1 << 16) * np.log2(np.arange(1, 1 << 16))])


def _n_log_n(n: np.ndarray) -> np.ndarray:
    return _N_LOG_N[n] if n.max(initial=0) < len(_N_LOG_N) else n * np.log2(np.maximum(n, 1))


def _total(counts: np.ndarray) -> np.ndarray:
    """Bits of the symbols in a prefix code and of the code, about; of each row."""
    return _n_log_n(counts.sum(axis=-1)) - _n_log_n(counts).sum(axis=-1) + CODE_BITS * np.count_nonzero(counts, axis=-1)


_CHANNEL = np.arange(0, 1024, 256)


def _histograms(flat: np.ndarray) -> np.ndarray:
    """Counts of the samples of each channel."""
    return np.bincount((flat + _CHANNEL).ravel(), minlength=1024).reshape(4, 256)


def _cost(counts: np.ndarray) -> np.ndarray:
    """Bits of literal pixels with these counts, in one code for all channels or one for each."""
    every = _total(np.concatenate([counts, counts.sum(axis=-2, keepdims=True)], axis=-2))
    return np.minimum(every[..., :4].sum(axis=-1), every[..., 4])


def _smooth(pixels: np.ndarray) -> bool:
    """Whether samples differ less from their neighbours, or from the green one, than they vary: else no transform pays."""
    f = pixels.astype(np.float32)
    spread = f - f.reshape(-1, 4).mean(axis=0)
    least = float(np.vdot(spread, spread)) / f.size
    for d in (f[:, 1:] - f[:, :-1], f[1:] - f[:-1], f[:, :, 0::2] - f[:, :, 1:2]):
        if d.size and float(np.vdot(d, d)) / d.size < least:
            return True
    return False


def _transforms(pixels: np.ndarray) -> tuple[int | None, tuple[int, int, int] | None, bool]:
    """(predictor, cross-colour, subtract-green): what takes the fewest bits, none of them included."""
    if not _smooth(pixels):
        return None, None, False

    def best(candidates):
        """The cheapest of (pixels, predictor, cross-colour, subtract-green); a transform takes some 64 bits."""
        bits = _cost(np.stack([_histograms(c[0].reshape(-1, 4)) for c in candidates]))
        bits = bits + [64 * sum(x is not None and x is not False for x in c[1:]) for c in candidates]
        return candidates[int(bits.argmin())]

    found = best([(pixels, None, None, False), (_less_green(pixels), None, None, True), *((_residual(pixels, m), m, None, False) for m in (1, 2))])
    if found[1] is not None:  # steps are small: the other modes may be better
        found = best([found, *((_residual(pixels, m), m, None, False) for m in (5, 7, 11, 12))])
    if found[1] is not None or found[3]:  # samples go together, and may by more or less than green alone says
        own = _residual(pixels, found[1]) if found[1] is not None else pixels
        cross = _multipliers(own)
        found = best([found, (_less_green(own), found[1], None, True), *([(_crossed(own, cross), found[1], cross, False)] if any(cross) else [])])
    return found[1:]


def _multipliers(pixels: np.ndarray) -> tuple[int, int, int]:
    """Cross-colour multipliers by least squares, in 32nds: green to red, green to blue, red to blue."""
    p = pixels.reshape(-1, 4).astype(np.int8).astype(float)
    red, green, blue = p[:, 0], p[:, 1], p[:, 2]
    fit = lambda a, b: int(np.clip(round(32 * (a @ b) / max(a @ a, 1.0)), -128, 127))
    to_blue = fit(green, blue)
    return fit(green, red), to_blue, fit(red, blue - green * to_blue / 32)


def _crossed(pixels: np.ndarray, multipliers: tuple[int, int, int]) -> np.ndarray:
    to_red, to_blue, red_blue = (np.uint8(x & 255) for x in multipliers)
    out = pixels.copy()
    out[:, :, 2] -= _scaled(to_blue, pixels[:, :, 1]) + _scaled(red_blue, pixels[:, :, 0])
    out[:, :, 0] -= _scaled(to_red, pixels[:, :, 1])
    return out


def _less_green(pixels: np.ndarray) -> np.ndarray:
    out = pixels.copy()
    out[:, :, 0] -= pixels[:, :, 1]
    out[:, :, 2] -= pixels[:, :, 1]
    return out


def _distinct(values: np.ndarray) -> int:
    """How many different values there are; a set of them takes ten times as long."""
    own = np.sort(values)
    return int(np.count_nonzero(own[1:] != own[:-1])) + (len(own) > 0)


def _palette(words: np.ndarray):
    """The colours and each pixel's index, where a palette pays: at most 256 colours, and each for four pixels on average."""
    flat = words.ravel()
    if _distinct(flat[:1025]) > min(256, len(flat) // 4):
        return None
    colours, index = np.unique(flat, return_inverse=True)
    return (colours.astype("<u4").view(np.uint8).reshape(-1, 4), index) if len(colours) <= min(256, max(1, len(flat) // 4)) else None


def _bundle(index: np.ndarray, n: int) -> np.ndarray:
    bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    height, width = index.shape
    wide = -(-width >> bits)
    padded = np.zeros((height, wide << bits), np.uint8)
    padded[:, :width] = index
    parts = padded.reshape(height, wide, 1 << bits) << (np.arange(1 << bits) * (8 >> bits)).astype(np.uint8)
    out = np.zeros((height, wide, 4), np.uint8)
    out[:, :, 1] = np.bitwise_or.reduce(parts, axis=2)
    out[:, :, 3] = 255
    return out


def _residual(pixels: np.ndarray, mode: int) -> np.ndarray:
    out = pixels.copy()
    out[0, :1, 3] -= np.uint8(255)
    out[0, 1:] -= pixels[0, :-1]
    out[1:, 0] -= pixels[:-1, 0]
    if len(pixels) > 1 and pixels.shape[1] > 1:
        above = pixels[:-1]
        right = np.concatenate([above[:, 1:], pixels[1:, :1]], axis=1)
        out[1:, 1:] -= _predict(mode, pixels[1:, :-1], above[:, 1:], above[:, :-1], right[:, 1:]).astype(np.uint8)
    return out


def _put_blocks(w: Writer, kind: int, pixels: np.ndarray, block: np.ndarray, out: np.ndarray) -> np.ndarray:
    """A transform with the same block everywhere, of the largest blocks there are."""
    height, width = pixels.shape[:2]
    w.put(1, 1)
    w.put(kind, 2)
    w.put(7, 3)
    _put_image(w, np.broadcast_to(block, (-(-height >> 9), -(-width >> 9), 4)), False)
    return out


def _put_image(w: Writer, pixels: np.ndarray, main: bool, cache_bits: int | None = 0) -> None:
    flat = np.ascontiguousarray(pixels).reshape(-1, 4)
    cache_bits, literal, symbol, copies = _tokens(flat, pixels.shape[1], cache_bits)
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)  # one group of codes
    every = not len(copies) and not cache_bits  # all pixels are literal
    kept = flat if every else flat[literal]
    counts = np.bincount(symbol, minlength=280 + (1 << cache_bits if cache_bits else 0))
    others = [np.bincount(kept[:, c], minlength=256) for c in (0, 2, 3)]
    far = np.bincount(copies[:, 4], minlength=40) if len(copies) else None
    if min((counts[:256] > 0).sum(), *((c > 0).sum() for c in others)) > 8:
        # Channels of alike samples share one code, which then is made, stored and looked up once, if that takes fewer bits.
        together = counts[:256] + others[0] + others[1] + others[2]
        if counts[256:].any():
            apart = np.stack([counts[:256], *others])
            if _total(together) <= _total(apart).sum():
                others = [others[0] + others[1] + others[2]] * 3
        else:
            counts, others = np.concatenate([together, counts[256:]]), [together] * 3
    made: dict[bytes, tuple] = {}  # of each code: what is stored of it, its bits and its codes

    def code_of(c: np.ndarray) -> tuple:
        used = np.flatnonzero(c)
        last = int(used[-1]) + 1 if len(used) else 1
        key = c[:last].tobytes()  # of green first, whose alphabet is the longest
        if key not in made:
            n = code_lengths(c)
            size = np.zeros(len(n), np.int64) if len(used) < 2 else n.astype(np.int64)
            made[key] = _stored(n[: int(np.flatnonzero(n)[-1]) + 1].tobytes()), size, codes(n) & ((1 << size) - 1)
        return made[key]

    found = [code_of(c) for c in (counts, *others)] + [code_of(far) if far is not None else _ONE]
    for stored, _, _ in found:
        w.put(*stored)
    bits, code = [f[1] for f in found], [f[2] for f in found]
    size, value = bits[0].take(symbol, mode="clip"), code[0].take(symbol, mode="clip")
    at = slice(None) if every else np.flatnonzero(symbol < 256)
    v, s = value[at], size[at]
    for k, c in ((1, 0), (2, 2), (3, 3)):
        own = kept[:, c].astype(np.int64)
        v = v | (code[k].take(own, mode="clip") << s)
        s = s + bits[k].take(own, mode="clip")
    value[at], size[at] = v, s
    if len(copies):
        at, v, s = copies[:, 0], value[copies[:, 0]], size[copies[:, 0]]
        v, s = v | (copies[:, 2] << s), s + copies[:, 3]
        v, s = v | (code[4][copies[:, 4]] << s), s + bits[4][copies[:, 4]]
        value[at], size[at] = v | (copies[:, 5] << s), s + copies[:, 6]
    w.put_many(value, size)


#: A code that isn't used, of one symbol: what is stored of it, its bits and its codes.
_ONE = (0b101, 11), np.zeros(1, np.int64), np.zeros(1, np.int64)
#: A row for each copy: its place among the symbols; symbol, extra and bits of the extra of its length; the same of its distance.
_NO_COPIES = np.zeros((0, 7), np.int64)


def _tokens(flat: np.ndarray, width: int, cache_bits: int | None) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(bits of the colour cache, which pixels are literal, green symbols, copies): the way that takes the fewest bits.

    A colour cache of given bits is used in any case.
    """
    words = flat.view("<u4").ravel()
    plain = 0, np.ones(len(flat), bool), flat[:, 1].astype(np.int64), _NO_COPIES
    if cache_bits:
        return _cached(flat, words, cache_bits)
    again = len(words) - _distinct(words)  # pixels that were there before
    if again < (1 - WORTH) * len(words):
        return plain
    least, best = WORTH * float(_cost(_histograms(flat))), plain
    found = _matches(words)
    if found[:, 1].sum() > (1 - WORTH) * len(flat):
        literal, symbol, copies = _copied(flat, found, width)
        cost = float(_cost(_histograms(flat[literal]))) + float(_total(np.bincount(copies[:, 1])) + _total(np.bincount(copies[:, 4]))) + int(copies[:, [3, 6]].sum()) + 2 * len(copies)
        if cost < least:
            best, least = (0, literal, symbol, copies), cost
    if cache_bits is None and len(flat) >= 64 and again * 10 > 3 * len(flat):  # one from the cache takes about half of a literal pixel
        bits = min(10, len(flat).bit_length() - 2)
        slot, held = _held(flat, words, bits)
        if int(np.count_nonzero(held)) * 6 > len(flat):
            counts = _histograms(flat[~held])
            together = np.concatenate([counts[1], np.bincount(slot[held])])
            if float(_total(together) + _total(counts[0] + counts[2] + counts[3])) < least:
                best = _cached(flat, words, bits)
    return best


def _matches(words: np.ndarray) -> np.ndarray:
    """(place, pixels, distance) of copies, in order: where two pixels stood before, as long as the nearest such place goes on."""
    if len(words) < SHORTEST + 1:
        return np.zeros((0, 3), np.int64)
    key = (words[:-1].astype(np.uint64) << np.uint64(32)) | words[1:]
    if _distinct(key) * SHORTEST > (SHORTEST - 1 + WORTH) * len(key):  # too few pairs are there twice for copies to pay
        return np.zeros((0, 3), np.int64)
    order = np.argsort(key, kind="stable")
    again = key[order[1:]] == key[order[:-1]]
    if not again.any():
        return np.zeros((0, 3), np.int64)
    distance = np.zeros(len(key), np.int64)
    distance[order[1:][again]] = (order[1:] - order[:-1])[again]
    distance[distance > WINDOW] = 0
    start = np.flatnonzero(np.diff(distance, prepend=-1))
    end = np.append(start[1:], len(key)) + 1  # the last pair's second pixel is copied as well
    some = distance[start] > 0
    rows, covered = [], 0
    for a, b, d in zip(start[some].tolist(), end[some].tolist(), distance[start[some]].tolist(), strict=True):
        a = max(a, covered)
        while b - a >= SHORTEST:
            n = min(b - a, 4096)
            rows.append((a, n, d))
            a = covered = a + n
    return np.array(rows, np.int64).reshape(-1, 3)


@lru_cache(maxsize=64)
def _near(width: int) -> dict[int, int]:
    """The lowest distance code of each distance that has one of the two-dimensional codes."""
    return {_distance(code, width): code for code in range(len(NEAR), 0, -1)}


def _copied(flat: np.ndarray, found: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which pixels are literal, green symbols, copies) with the given copies."""
    edge = np.zeros(len(flat) + 1, np.int64)
    edge[found[:, 0]] += 1
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    literal = np.cumsum(edge[:-1]) == 0
    head = literal.copy()
    head[found[:, 0]] = True
    near = _near(width)
    rows = [(*_prefix(n), *_prefix(near.get(d) or d + len(NEAR))) for _, n, d in found.tolist()]
    copies = np.concatenate([(np.cumsum(head) - 1)[found[:, :1]], np.array(rows, np.int64)], axis=1)
    symbol = flat[head, 1].astype(np.int64)
    symbol[copies[:, 0]] = 256 + copies[:, 1]
    return literal, symbol, copies


def _held(flat: np.ndarray, words: np.ndarray, cache_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot in the colour cache, whether the cache holds it) of each pixel: the last one of its slot is the same."""
    slot = _slots(flat, cache_bits).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    held = np.zeros(len(flat), bool)
    held[order[1:]] = (slot[order[1:]] == slot[order[:-1]]) & (words[order[1:]] == words[order[:-1]])
    return slot, held


def _cached(flat: np.ndarray, words: np.ndarray, cache_bits: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    slot, held = _held(flat, words, cache_bits)
    return cache_bits, ~held, np.where(held, 280 + slot, flat[:, 1]), _NO_COPIES
