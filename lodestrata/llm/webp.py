"""Lossless WebP (VP8L): a decoder for any such stream, and an encoder for payloads stored as samples.

The decoder reads prefix codes, back-references and the colour cache, inverts the predictor, cross-colour,
subtract-green and palette transforms, and writes arrays of ARGB pixels. Many images are decoded side by side: each
step yields one pixel of every image that is not finished, so that a step is a few array operations.
"""

from __future__ import annotations

import struct

import numpy as np

# Fixed values of the format: order of the code-length code, and the near places (x to the left, y up) of
# the first distance codes.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3),
    (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5),
    (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7),
    (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6),
    (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
_NEAR_X, _NEAR_Y = (np.array(c, np.int64) for c in zip(*NEAR, strict=True))


class Bad(ValueError):
    """Not a lossless WebP stream, or a damaged one."""


# ---------------------------------------------------------------- prefix codes


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol, first bit lowest."""
    codes, used = np.zeros(len(lengths), np.int64), np.flatnonzero(lengths)
    if len(used):
        own = lengths[used].astype(np.int64)
        order = np.lexsort((used, own))
        used, own = used[order], own[order]
        most = int(own[-1])
        spans = 1 << (most - own)
        codes[used] = reversed_bits(most)[np.cumsum(spans) - spans]
    return codes


def table_of(lengths: np.ndarray) -> np.ndarray:
    """Entry symbol << 4 | length for each value of the next bits; a lone symbol takes no bits."""
    used = np.flatnonzero(lengths)
    if len(used) == 1:
        return np.array([used[0] << 4], np.int64)
    if not len(used):
        raise Bad("an empty prefix code")
    own = lengths[used].astype(np.int64)
    most = int(own.max())
    if int((1 << (most - own)).sum()) != 1 << most:
        raise Bad("an incomplete prefix code")
    order = np.lexsort((used, own))
    own, used = own[order], used[order]
    by_value = np.repeat(used << 4 | own, 1 << (most - own))  # in the order of the codes, first bit highest
    return by_value[reversed_bits(most)]


_reversed: dict[int, np.ndarray] = {}


def reversed_bits(n: int) -> np.ndarray:
    if n not in _reversed:
        out = np.zeros(1, np.int64)
        for _ in range(n):
            out = np.concatenate([out * 2, out * 2 + 1])
        _reversed[n] = out
    return _reversed[n]


class Reader:
    """Bits of one stream, lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.value, self.start = data, 0, 0, -1

    def bits(self, n: int) -> int:
        off = self.at - self.start
        if self.start < 0 or off < 0 or off + n > 4152:
            self.start = self.at & ~7
            byte = self.start >> 3
            self.value = int.from_bytes(self.data[byte : byte + 520], "little")
            off = self.at - self.start
        self.at += n
        return self.value >> off & ((1 << n) - 1)

    def lengths(self, size: int) -> np.ndarray:
        """Code lengths of an alphabet of ``size`` symbols. A simple code has one or two symbols."""
        out = np.zeros(size, np.int64)
        if self.bits(1):
            two = self.bits(1)
            symbols = [self.bits(8 if self.bits(1) else 1)] + ([self.bits(8)] if two else [])
            if max(symbols) >= size:
                raise Bad("a symbol beyond its alphabet")
            out[symbols] = 1
            return out
        own = np.zeros(19, np.int64)
        for i in range(4 + self.bits(4)):
            own[LENGTH_ORDER[i]] = self.bits(3)
        table = table_of(own).tolist()
        mask, left = len(table) - 1, size
        if self.bits(1):
            left = 2 + self.bits(2 + 2 * self.bits(3))
        found, last = [], 8
        while len(found) < size and left > 0:
            left -= 1
            e = table[self.bits(7) & mask]
            self.at -= 7 - (e & 15)
            s = e >> 4
            if s < 16:
                found.append(s)
                last = s or last
            elif s == 16:
                found += [last] * (3 + self.bits(2))
            else:
                found += [0] * (3 + self.bits(3) if s == 17 else 11 + self.bits(7))
        if len(found) > size:
            raise Bad("code lengths beyond the alphabet")
        out[: len(found)] = found
        return out


# ---------------------------------------------------------------- entropy-coded images


class Job:
    """One entropy-coded image: where its pixels start, its size and its codes."""

    def __init__(self, reader: Reader, width: int, height: int, main: bool):
        self.reader, self.width, self.height = reader, width, height
        self.cache_bits = reader.bits(4) if reader.bits(1) else 0
        if self.cache_bits > 11:
            raise Bad("a colour cache of over 11 bits")
        self.meta, self.meta_bits, groups = None, 0, 1
        if main and reader.bits(1):
            self.meta_bits = reader.bits(3) + 2
            w, h = (-(-n // (1 << self.meta_bits)) for n in (width, height))
            self.meta = (decode_jobs([Job(reader, w, h, False)])[0] >> 8 & 0xFFFF).astype(np.int64)
            groups = int(self.meta.max()) + 1
        sizes = (LITERALS + LENGTHS + (1 << self.cache_bits if self.cache_bits else 0), 256, 256, 256, DISTANCES)
        self.groups = [[self._table(n) for n in sizes] for _ in range(groups)]

    def _table(self, size: int) -> np.ndarray:
        """The table of the next code; a code whose bits repeat an earlier one of this image is not parsed again."""
        r, seen = self.reader, self.__dict__.setdefault("seen", [])
        at = r.at
        for n, bits, value, table in seen[-4:]:
            if n == size and r.bits(bits) == value:
                return table
            r.at = at
        table = table_of(r.lengths(size))
        bits, r.at = r.at - at, at
        if bits <= 2048:
            seen.append((size, bits, r.bits(bits), table))
        else:
            r.at = at + bits
        return table


def _value(code: np.ndarray, extra: np.ndarray) -> np.ndarray:
    bits = np.maximum(code - 2 >> 1, 0)
    return np.where(code < 4, code + 1, ((2 + (code & 1)) << bits) + extra + 1)


def _extra_bits(code: np.ndarray) -> np.ndarray:
    return np.where(code < 4, 0, code - 2 >> 1)


def decode_jobs(jobs: list[Job]) -> list[np.ndarray]:
    """ARGB pixels of each job, which leaves its reader behind them."""
    totals = np.array([j.width * j.height for j in jobs], np.int64)
    order = np.argsort(-totals, kind="stable")
    jobs_, totals = [jobs[i] for i in order], totals[order]
    blob, first = bytearray(), []
    for j in jobs_:
        first.append(len(blob))
        blob += j.reader.data[j.reader.at >> 3 :] if len(j.reader.data) < 1 << 16 or len(jobs) == 1 else j.reader.data
        if not (len(j.reader.data) < 1 << 16 or len(jobs) == 1):
            first[-1] += j.reader.at >> 3
    ends = len(blob) * 8
    blob += bytes(64)
    words = np.ndarray((len(blob) - 8,), "<u8", bytes(blob), strides=(1,))
    start = np.array(first, np.int64) * 8 + np.array([j.reader.at & 7 for j in jobs_], np.int64)
    pos = start.copy()
    tables, base, mask, known, group_at = [], [], [], {}, []
    size, longest = 0, 0
    for j in jobs_:
        group_at.append(len(base))
        for g in j.groups:
            bs, ms = [], []
            for t in g:
                key = t.tobytes()
                if key not in known:
                    known[key] = size
                    tables.append(t)
                    size += len(t)
                bs.append(known[key])
                ms.append(len(t) - 1)
                longest = max(longest, len(t).bit_length() - 1)
            base.append(bs)
            mask.append(ms)
    table, base, mask = np.concatenate(tables), np.array(base, np.int64), np.array(mask, np.uint64)
    group_at = np.array(group_at, np.int64)
    n_jobs, most = len(jobs_), int(totals[0])
    out = np.zeros((most, n_jobs), np.uint32)
    active = np.searchsorted(-totals, -np.arange(most), side="left")  # jobs with more than t pixels
    copies, reach = np.zeros(n_jobs, np.int64), np.ones(n_jobs, np.int64)
    widths = np.array([j.width for j in jobs_], np.int64)
    metas = [i for i, j in enumerate(jobs_) if j.meta is not None]
    caches = np.array([j.cache_bits for j in jobs_], np.int64)
    cached = np.flatnonzero(caches)
    cache_at = np.zeros(n_jobs, np.int64)
    if len(cached):
        cache_at[cached] = np.cumsum(1 << caches[cached]) - (1 << caches[cached])
        cache = np.zeros(int((1 << caches[cached]).sum()), np.uint32)
    rows, copying = np.arange(n_jobs), 0

    def peek(p: np.ndarray) -> np.ndarray:
        return words[p >> 3] >> (p & 7).astype(np.uint64)

    def read(p: np.ndarray, group: np.ndarray, kind: int, value: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        value = peek(p) if value is None else value
        e = table[base[group, kind] + (value & mask[group, kind]).astype(np.int64)]
        return e >> 4, e & 15

    one_group = not metas
    columns = [(base[group_at, k], mask[group_at, k]) for k in range(5)]
    for t in range(most):
        n = int(active[t])
        if copying and (busy := copies[:n] > 0).any():
            own = np.flatnonzero(~busy)
            held = np.flatnonzero(busy)
            if (reach[held] > t).any():
                raise Bad("a reference before the first pixel")
            out[t, held] = out[t - reach[held], held]
            copies[held] -= 1
            p = pos[own]
        else:
            copying, own, p = 0, None, pos[:n]
        if len(p):
            which = rows[:n] if own is None else own
            if one_group:
                (b0, m0), (b1, m1), (b2, m2), (b3, m3), _ = columns if own is None else [(b[own], m[own]) for b, m in columns]
                if own is None:
                    b0, m0, b1, m1, b2, m2, b3, m3 = (x[:n] for x in (b0, m0, b1, m1, b2, m2, b3, m3))
                group = group_at[which]
            else:
                group = group_at[which].copy()
                at = {int(i): x for x, i in enumerate(which)}
                for i in metas:
                    if i in at:
                        j = jobs_[i]
                        across = -(-j.width // (1 << j.meta_bits))
                        group[at[i]] += j.meta[(t // j.width >> j.meta_bits) * across + (t % j.width >> j.meta_bits)]
                b0, b1, b2, b3 = (base[group, k] for k in range(4))
                m0, m1, m2, m3 = (mask[group, k] for k in range(4))
            v = peek(p)
            e = table[b0 + (v & m0).astype(np.int64)]
            green, used = e >> 4, e & 15
            literal = green < LITERALS
            if literal.all():
                sub, pl, vl = None, p, v
            else:
                sub = np.flatnonzero(literal)
                pl, vl, b1, m1, b2, m2, b3, m3 = (x[sub] for x in (p, v, b1, m1, b2, m2, b3, m3))
            taken = used if sub is None else used[sub]
            vl = vl >> taken.astype(np.uint64)
            e1 = table[b1 + (vl & m1).astype(np.int64)]
            step = e1 & 15
            taken = taken + step
            vl = vl >> step.astype(np.uint64) if longest <= 14 else peek(pl + taken)
            e2 = table[b2 + (vl & m2).astype(np.int64)]
            step = e2 & 15
            taken = taken + step
            vl = vl >> step.astype(np.uint64)
            e3 = table[b3 + (vl & m3).astype(np.int64)]
            taken = taken + (e3 & 15)
            g = green if sub is None else green[sub]
            pixel = (e3 >> 4 << 24 | e1 >> 4 << 16 | g << 8 | e2 >> 4).astype(np.uint32)
            if sub is None:
                p = p + taken
                if own is None:
                    out[t, :n] = pixel
                else:
                    out[t, own] = pixel
            else:
                p = p.copy()
                p[sub] += taken
                out[t, which[sub]] = pixel
                back = np.flatnonzero((green >= LITERALS) & (green < LITERALS + LENGTHS))
                if len(back):
                    gb, who = group[back], which[back]
                    q = p[back] + used[back]
                    code = green[back] - LITERALS
                    x = _extra_bits(code)
                    run = _value(code, (peek(q) & ((1 << x) - 1).astype(np.uint64)).astype(np.int64))
                    q = q + x
                    code, took = read(q, gb, 4)
                    q = q + took
                    x = _extra_bits(code)
                    far = _value(code, (peek(q) & ((1 << x) - 1).astype(np.uint64)).astype(np.int64))
                    p[back] = q + x
                    near = np.minimum(far, len(NEAR)) - 1
                    far = np.where(far > len(NEAR), far - len(NEAR), np.maximum(_NEAR_X[near] + _NEAR_Y[near] * widths[who], 1))
                    if (far > t).any() or (t + run > totals[who]).any():
                        raise Bad("a reference beyond the image")
                    out[t, who] = out[t - far, who]
                    copies[who], reach[who], copying = run - 1, far, 1
                hit = np.flatnonzero(green >= LITERALS + LENGTHS)
                if len(hit):
                    who = which[hit]
                    out[t, who] = cache[cache_at[who] + green[hit] - LITERALS - LENGTHS]
                    p[hit] += used[hit]
            if own is None:
                pos[:n] = p
            else:
                pos[own] = p
        if len(cached):
            who = cached[cached < n]
            pixel = out[t, who]
            at = (pixel.astype(np.uint64) * np.uint64(CACHE_FACTOR) & np.uint64(0xFFFFFFFF)).astype(np.int64) >> (32 - caches[who])
            cache[cache_at[who] + at] = pixel
        if t & 255 == 0 and int(pos.max()) > ends + 64:
            raise Bad("the stream ends early")
    across = np.ascontiguousarray(out.T)
    result: list = [None] * n_jobs
    for x, i in enumerate(order):
        moved = int(pos[x] - start[x])
        jobs[i].reader.at += moved
        if jobs[i].reader.at > len(jobs[i].reader.data) * 8:
            raise Bad("the stream ends early")
        result[i] = across[x, : totals[x]]
    return result


# ---------------------------------------------------------------- transforms


def _channels(p: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(p, "<u4").view(np.uint8).reshape(*p.shape, 4).astype(np.int64)  # blue, green, red, alpha


def _pixels(c: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray((c & 255).astype(np.uint8)).view("<u4").reshape(c.shape[:-1])


def _half(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a + b >> 1


def predicted(mode: int, left, top, top_left, top_right) -> np.ndarray:
    """The prediction of ``mode`` from four neighbours, each blue, green, red, alpha."""
    if mode in (0, 14, 15):
        return np.array([0, 0, 0, 255])
    if mode in (1, 2, 3, 4):
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return _half(_half(left, top_right), top)
    if mode in (6, 7, 8, 9):
        a, b = ((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6]
        return _half(a, b)
    if mode == 10:
        return _half(_half(left, top_left), _half(top, top_right))
    if mode == 11:
        guess = left + top - top_left
        return left if np.abs(guess - left).sum() < np.abs(guess - top).sum() else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    mid = _half(left, top)
    diff = mid - top_left
    return np.clip(mid + (np.abs(diff) // 2) * np.sign(diff), 0, 255)


def invert_predictor(pixels: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    rest = _channels(pixels)
    height, width = pixels.shape
    out = rest.copy()
    out[0, 0] = rest[0, 0] + [0, 0, 0, 255] & 255
    out[0, 1:] = rest[0, 1:]
    out[0] = np.cumsum(out[0], axis=0) & 255
    for y in range(1, height):
        out[y, 0] = rest[y, 0] + out[y - 1, 0] & 255
        own = modes[y >> bits]
        for x in range(1, width):
            corner = out[y - 1, x + 1] if x + 1 < width else out[y, 0]
            guess = predicted(int(own[x >> bits]), out[y, x - 1], out[y - 1, x], out[y - 1, x - 1], corner)
            out[y, x] = rest[y, x] + guess & 255
    return _pixels(out)


def _signed(x: np.ndarray) -> np.ndarray:
    return (x & 255 ^ 128) - 128


def invert_cross_colour(pixels: np.ndarray, factors: np.ndarray, bits: int) -> np.ndarray:
    c = _channels(pixels)
    y, x = np.indices(pixels.shape)
    f = _signed(_channels(factors)[y >> bits, x >> bits])
    green = _signed(c[..., 1])
    red = c[..., 2] + (f[..., 0] * green >> 5) & 255
    blue = c[..., 0] + (f[..., 1] * green >> 5) + (f[..., 2] * _signed(red) >> 5)
    c[..., 2], c[..., 0] = red, blue
    return _pixels(c)


def invert_subtract_green(pixels: np.ndarray) -> np.ndarray:
    c = _channels(pixels)
    c[..., 2] += c[..., 1]
    c[..., 0] += c[..., 1]
    return _pixels(c)


def bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def invert_palette(pixels: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    bits = bundle_bits(len(palette))
    index = pixels >> 8 & 0xFF
    if bits:
        x = np.arange(width)
        each = 8 >> bits
        index = index[:, x >> bits] >> ((x & (1 << bits) - 1) * each).astype(np.uint32) & (1 << each) - 1
    full = np.zeros(256, np.uint32)
    full[: len(palette)] = palette
    return full[index]


class Image:
    """The head of a VP8L stream, up to its pixels."""

    def __init__(self, data: bytes):
        r = self.reader = Reader(data)
        if r.bits(8) != 0x2F:
            raise Bad("no VP8L signature")
        self.width, self.height = r.bits(14) + 1, r.bits(14) + 1
        r.bits(1)
        if r.bits(3):
            raise Bad("an unknown version")
        self.transforms, width, height = [], self.width, self.height
        while r.bits(1):
            kind = r.bits(2)
            if kind in [t[0] for t in self.transforms]:
                raise Bad("a transform twice")
            if kind in (PREDICTOR, CROSS_COLOUR):
                bits = r.bits(3) + 2
                w, h = (-(-n // (1 << bits)) for n in (width, height))
                part = decode_jobs([Job(r, w, h, False)])[0].reshape(h, w)
                self.transforms.append((kind, width, bits, part >> 8 & 255 if kind == PREDICTOR else part))
            elif kind == PALETTE:
                colours = r.bits(8) + 1
                steps = decode_jobs([Job(r, colours, 1, False)])[0]
                palette = _pixels(np.cumsum(_channels(steps), axis=0))
                self.transforms.append((kind, width, 0, palette))
                width = -(-width // (1 << bundle_bits(colours)))
            else:
                self.transforms.append((kind, width, 0, None))
        self.job = Job(r, width, height, True)

    def finish(self, pixels: np.ndarray) -> np.ndarray:
        pixels = pixels.reshape(self.height, -1)
        for kind, width, bits, data in reversed(self.transforms):
            if kind == PREDICTOR:
                pixels = invert_predictor(pixels, data, bits)
            elif kind == CROSS_COLOUR:
                pixels = invert_cross_colour(pixels, data, bits)
            elif kind == SUBTRACT_GREEN:
                pixels = invert_subtract_green(pixels)
            else:
                pixels = invert_palette(pixels, data, width)
        return pixels


def frames_of(file: bytes) -> list[bytes]:
    """The VP8L streams of a WebP file: one, or one for each frame of an animation."""
    if file[:4] != b"RIFF" or file[8:12] != b"WEBP":
        raise Bad("no WebP file")
    found, at, end = [], 12, min(len(file), 8 + struct.unpack_from("<I", file, 4)[0])
    while at + 8 <= end:
        kind, size = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        if kind == b"ANMF":
            at += 8 + 16  # the frame's own chunks follow its head
            continue
        if kind == b"VP8L":
            found.append(file[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    if not found:
        raise Bad("no VP8L stream")
    return found


def decode(files: list[bytes]) -> list[list[np.ndarray]]:
    """For each file the ARGB pixels (height x width) of its frames."""
    parts = [frames_of(f) for f in files]
    images = [Image(x) for p in parts for x in p]
    done = iter([i.finish(p) for i, p in zip(images, decode_jobs([i.job for i in images]), strict=True)] if images else [])
    return [[next(done) for _ in p] for p in parts]


# ---------------------------------------------------------------- encoder

#: Colours of a palette at most, bits of the colour cache, and pixels it has to hold to be worth its longer code.
COLOURS, CACHE, WORTH = 16, 8, 128


class Writer:
    def __init__(self):
        self.value, self.at = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= int(value) << self.at
        self.at += n


def code_lengths(counts: np.ndarray, most: int = 11) -> np.ndarray:
    """Lengths of a complete prefix code, at most ``most``, near -log2 of the shares."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    c = counts[used].astype(np.float64)
    share = c / c.sum()
    floor = 2.0 ** (1 - most)
    share = np.maximum(share, floor)
    share /= share.sum() * (1 + 1e-9)
    own = np.minimum(np.ceil(-np.log2(share)).astype(np.int64), most)
    units = 1 << (most - own)
    over = int(units.sum()) - (1 << most)
    order, own = np.argsort(c, kind="stable").tolist(), own.tolist()
    while over > 0:  # the cap has used up too much: lengthen rare symbols
        for i in order:
            if own[i] < most and over > 0:
                over -= 1 << (most - own[i] - 1)
                own[i] += 1
    while over < 0:  # room is left: shorten the most frequent that fit
        for i in order[::-1]:
            if own[i] > 1 and 1 << (most - own[i]) <= -over:
                over += 1 << (most - own[i])
                own[i] -= 1
                if not over:
                    break
    out[used] = own
    return out


def _put_code(w: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) == 1 and used[0] < 256:
        w.put(1, 1), w.put(0, 1)
        wide = int(used[0] > 1)
        w.put(wide, 1), w.put(int(used[0]), 8 if wide else 1)
        return
    w.put(0, 1)
    tokens: list[tuple[int, int, int]] = []  # symbol, extra value, extra bits
    edges = (np.flatnonzero(np.diff(lengths)) + 1).tolist()
    values = lengths.tolist()
    for a, b in zip([0, *edges], [*edges, len(values)], strict=True):
        n, v = b - a, values[a]
        if v:
            tokens += [(v, 0, 0)] * n
            continue
        while n >= 11:
            k = min(n, 138)
            tokens.append((18, k - 11, 7))
            n -= k
        if n >= 3:
            tokens.append((17, n - 3, 3))
            n = 0
        tokens += [(0, 0, 0)] * n
    own = code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    lone = np.count_nonzero(own) == 1
    put = canonical(own)
    count = max(4, max(i + 1 for i, s in enumerate(LENGTH_ORDER) if own[s]))
    w.put(count - 4, 4)
    for s in LENGTH_ORDER[:count]:
        w.put(own[s], 3)
    w.put(0, 1)
    put, own = put.tolist(), own.tolist()
    body, at = 0, 0
    for s, extra, bits in tokens:
        if not lone:
            body |= put[s] << at
            at += own[s]
        if bits:
            body |= extra << at
            at += bits
    w.put(body, at)


def _packed(head: Writer, values: np.ndarray, sizes: np.ndarray) -> bytes:
    """The head's bits, then each value's bits (up to 60 a value)."""
    ends = head.at + np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else head.at
    words = np.zeros(total // 64 + 2, np.uint64)
    raw = head.value.to_bytes(-(-head.at // 64) * 8, "little")
    words[: len(raw) // 8] = np.frombuffer(raw, "<u8")
    at = ends - sizes
    shift = (at & 63).astype(np.uint64)
    np.add.at(words, at >> 6, values << shift)
    np.add.at(words, (at >> 6) + 1, values >> np.uint64(1) >> (np.uint64(63) - shift))
    return words.tobytes()[: -(-total // 8)]


def _length_code(run: int) -> tuple[int, int, int]:
    if run <= 4:
        return run - 1, 0, 0
    top = (run - 1).bit_length() - 1
    half = (run - 1) >> (top - 1) & 1
    return 2 * top + half, (run - 1) & ((1 << (top - 1)) - 1), top - 1


def _runs(pixels: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of the pixel before go on for 4 or more, in pieces of at most 4096."""
    same = pixels[1:] == pixels[:-1]
    if not same.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
    return [(a + 1 + i, min(4096, b - a - i)) for a, b in edge.reshape(-1, 2).tolist() for i in range(0, b - a, 4096) if min(4096, b - a - i) >= 4]


def _slots(pixels: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of each pixel in a colour cache, and whether the cache holds it just then."""
    slot = (pixels.astype(np.uint32) * np.uint32(0x1E35A7BD) >> np.uint32(32 - bits)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    held = np.zeros(len(pixels), bool)
    held[order[1:]] = (slot[order[1:]] == slot[order[:-1]]) & (pixels[order[1:]] == pixels[order[:-1]])
    return slot, held


def _coded(pixels: np.ndarray, top: bool, cache: int = 0) -> tuple[Writer, np.ndarray, np.ndarray]:
    """An entropy-coded image: its head, and each symbol's bits and their number. ``cache``: bits of a colour cache."""
    w = Writer()
    w.put(int(cache > 0), 1)
    if cache:
        w.put(cache, 4)
    if top:
        w.put(0, 1)  # one group of codes
    runs = _runs(pixels)
    keep = np.ones(len(pixels), bool)
    for a, n in runs:
        keep[a : a + n] = False
    slot, held = _slots(pixels, cache) if cache else (np.zeros(len(pixels), np.int64), np.zeros(len(pixels), bool))
    body, slot, held = pixels[keep], slot[keep], held[keep]
    raw = body.view(np.uint8).reshape(-1, 4)
    own = raw[~held]
    rest_lengths = code_lengths(np.bincount(own.reshape(-1), minlength=256))
    codes = [_length_code(n) for _, n in runs]
    if codes or cache:
        counts = np.bincount(np.concatenate([own[:, 1].astype(np.int64), LITERALS + LENGTHS + slot[held], np.array([LITERALS + c for c, _, _ in codes], np.int64)]), minlength=LITERALS + LENGTHS + (1 << cache if cache else 0))
        greens = code_lengths(counts)
    else:
        greens = np.zeros(LITERALS + LENGTHS, np.int64)
        greens[:LITERALS] = rest_lengths
    if not rest_lengths.any():
        rest_lengths[0] = 1
    _put_code(w, greens)
    rest = Writer()
    _put_code(rest, rest_lengths)
    for _ in range(3):
        w.put(rest.value, rest.at)
    lone = np.zeros(DISTANCES, np.int64)
    lone[1 if runs else 0] = 1  # the pixel to the left is distance code 2
    _put_code(w, lone)
    free = lambda x: np.zeros(len(x), np.int64) if np.count_nonzero(x) == 1 else x
    of_green, of_rest, put_green, put_rest = free(greens), free(rest_lengths), canonical(greens).astype(np.uint64), canonical(rest_lengths).astype(np.uint64)
    if not of_green.any():
        put_green[:] = 0
    if not of_rest.any():
        put_rest[:] = 0
    b, g, r, a = (raw[:, i].astype(np.int64) for i in range(4))
    n1 = of_green[g]
    n2 = n1 + of_rest[r]
    n3 = n2 + of_rest[b]
    u = np.uint64
    values = put_green[g] | put_rest[r] << n1.astype(u) | put_rest[b] << n2.astype(u) | put_rest[a] << n3.astype(u)
    sizes = n3 + of_rest[a]
    if held.any():
        known = LITERALS + LENGTHS + slot[held]
        values[held], sizes[held] = put_green[known], of_green[known]
    if runs:
        at = np.cumsum(keep)  # a run stands after the pixels kept before it
        where = [int(at[s - 1]) for s, _ in runs]
        values = np.insert(values, where, [int(put_green[LITERALS + c]) | x << int(of_green[LITERALS + c]) for c, x, _ in codes])
        sizes = np.insert(sizes, where, [int(of_green[LITERALS + c]) + n for c, _, n in codes])
    return w, values.astype(u), sizes


def _indexed(pixels: np.ndarray, width: int, palette: np.ndarray) -> np.ndarray:
    """The pixels as places in an ascending palette, several to a pixel, in the green channel."""
    bits = bundle_bits(len(palette))
    each = 1 << bits
    rows = np.searchsorted(palette, pixels).reshape(-1, width)
    rows = np.pad(rows, ((0, 0), (0, -width % each))).reshape(len(rows), -1, each)
    return ((rows << (np.arange(each) * (8 >> bits))).sum(2) << 8).reshape(-1).astype("<u4")


def encode_frame(samples: np.ndarray, width: int) -> bytes:
    """A VP8L stream of ``samples`` (bytes, 4 a pixel). Runs of one pixel become back-references; a palette of at most ``COLOURS``
    colours is used where it makes the stream shorter, a colour cache where it holds ``WORTH`` pixels of another frame."""
    pixels = np.ascontiguousarray(samples).view("<u4")
    w = Writer()
    w.put(0x2F, 8), w.put(width - 1, 14), w.put(len(pixels) // width - 1, 14), w.put(1, 1), w.put(0, 3)
    some = np.unique(pixels[: 4 * COLOURS])
    palette = np.unique(pixels) if len(some) <= COLOURS else some
    indexed = None
    if len(palette) <= COLOURS:
        head, values, sizes = _coded(pixels, True)
        small = palette.view(np.uint8).reshape(-1, 4)
        deltas = np.diff(small, axis=0, prepend=np.zeros((1, 4), np.uint8)).reshape(-1).view("<u4")  # each channel modulo 256
        colours, image = _coded(deltas, False), _coded(_indexed(pixels, width, palette), True)
        if 11 + colours[0].at + int(colours[2].sum()) + image[0].at + int(image[2].sum()) < head.at + int(sizes.sum()):
            indexed, (head, values, sizes) = (palette, colours), image
    else:
        worth = len(pixels) >= 2 * WORTH and np.count_nonzero(_slots(pixels, CACHE)[1]) >= WORTH
        head, values, sizes = _coded(pixels, True, CACHE if worth else 0)
    if indexed:
        palette, (own, codes, lengths) = indexed
        w.put(1, 1), w.put(3, 2), w.put(len(palette) - 1, 8), w.put(own.value, own.at)
        for code, n in zip(codes.tolist(), lengths.tolist(), strict=True):
            w.put(code, n)
    w.put(0, 1)  # no further transform
    w.put(head.value, head.at)
    return _packed(w, values, sizes)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return kind + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def encode(payload: bytes, width: int = 16, rows: int = 256) -> bytes:
    """A WebP file whose samples are ``payload`` (a positive multiple of 4 * width bytes), in frames of ``rows``."""
    samples = np.frombuffer(payload, np.uint8)
    each = 4 * width * rows
    parts = [encode_frame(samples[i : i + each], width) for i in range(0, len(samples), each)]
    if len(parts) == 1:
        body = _chunk(b"VP8L", parts[0])
    else:
        b3 = lambda n: struct.pack("<I", n)[:3]
        body = _chunk(b"VP8X", b"\x12\0\0\0" + b3(width - 1) + b3(len(samples) // (4 * width) - 1))
        body += _chunk(b"ANIM", bytes(6))
        pieces = []
        for i, part in enumerate(parts):
            high = min(rows, len(samples) // (4 * width) - i * rows)
            pieces.append(_chunk(b"ANMF", b3(0) + b3(i * rows // 2) + b3(width - 1) + b3(high - 1) + b3(0) + b"\x02" + _chunk(b"VP8L", part)))
        body += b"".join(pieces)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body
