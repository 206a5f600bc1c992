"""Progressive JPEG in numpy: a decoder for any Huffman-coded progressive file, and a coefficient writer.

The decoder accumulates spectral-selection and successive-approximation scans into coefficient arrays,
inverse-transforms all blocks of a component by one matrix product, upsamples chroma and returns an RGB tensor.
Scans whose codes have a regular layout are read with whole-array operations; others bit by bit.
The writer stores a payload losslessly in quantised coefficients, 64 bytes to a block, as YCbCr 4:2:0.
"""

from __future__ import annotations

import re
import struct

import numpy as np

#: Natural position of each zigzag index (ITU T.81, figure A.6).
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])

_SHIFT = 13


def _idct_matrix() -> np.ndarray:
    """64 x 64, from zigzag coefficients to natural samples, in whole units of 2 ** -_SHIFT.

    Whole numbers keep the product exact in doubles, so equal blocks give equal samples in any batch."""
    x = np.arange(8)
    one = np.cos((2 * x[:, None] + 1) * x[None, :] * np.pi / 16) / 2
    one[:, 0] /= np.sqrt(2)
    both = np.einsum("yv,xu->yxvu", one, one).reshape(64, 64)
    return np.ascontiguousarray(np.rint(both[:, ZIGZAG] * (1 << _SHIFT)).T)


_IDCT = _idct_matrix()


class Codes:
    """A Huffman table: symbol by (length, code)."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.by, code, at = {}, 0, 0
        for length, n in enumerate(counts, 1):
            for s in symbols[at : at + n]:
                self.by[length, code] = s
                code += 1
            at += n
            code <<= 1


class Bits:
    """Reader over unpacked bits; past the end it gives zeros."""

    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0

    def get(self, n: int) -> int:
        value = 0
        for b in self.bits[self.at : self.at + n].tolist() if n else ():
            value = value << 1 | b
        short = max(0, self.at + n - len(self.bits))
        self.at += n
        return value << short

    def symbol(self, codes: Codes) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.get(1)
            if (found := codes.by.get((length, code))) is not None:
                return found
        raise ValueError("bad Huffman code")

    def signed(self, size: int) -> int:
        value = self.get(size)
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


class Component:
    def __init__(self, ident: int, h: int, v: int, table: int):
        self.ident, self.h, self.v, self.table = ident, h, v, table


def _segments(data: bytes):
    """(marker, body, entropy-coded bytes that follow, with their restart markers)."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    at, stop = 2, re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
    while at + 4 <= len(data):
        marker = data[at + 1]
        if marker == 0xD9:
            return
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        coded = b""
        if marker == 0xDA:
            end = stop.search(data, at)
            end = end.start() if end else len(data)
            coded, at = data[at:end], end
        yield marker, body, coded


class Image:
    """Coefficients (zigzag order) and tables of a progressive JPEG, built up scan by scan."""

    def __init__(self, data: bytes, fast: bool = True):
        self.fast, self.quant, self.dc, self.ac, self.comments, self.restart = fast, {}, {}, {}, [], 0
        self.parts: list[Component] = []
        for marker, body, coded in _segments(data):
            if marker == 0xDB:
                while body:
                    wide, k = body[0] >> 4, body[0] & 15
                    n = 64 * (wide + 1)
                    self.quant[k] = np.frombuffer(body[1 : n + 1], ">u2" if wide else np.uint8).astype(np.float64)
                    body = body[n + 1 :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    (self.ac if body[0] >> 4 else self.dc)[body[0] & 15] = Codes(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xFE:
                self.comments.append(body)
            elif marker == 0xC2:
                self._frame(body)
            elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
                raise ValueError("only progressive Huffman-coded files")
            elif marker == 0xDA:
                self._scan(body, coded)

    def _frame(self, body: bytes) -> None:
        _, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        self.parts = [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * n, 3)]
        self.hmax, self.vmax = max(c.h for c in self.parts), max(c.v for c in self.parts)
        self.across, self.down = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        for c in self.parts:
            c.wide, c.high = self.across * c.h, self.down * c.v
            c.own_wide = -(-(-(-self.width * c.h // self.hmax)) // 8)
            c.own_high = -(-(-(-self.height * c.v // self.vmax)) // 8)
            c.coef = np.zeros((c.wide * c.high, 64), np.int16)
            mcu = np.arange(c.wide * c.high).reshape(self.down, c.v, self.across, c.h)
            c.by_mcu = mcu.transpose(0, 2, 1, 3).reshape(self.down * self.across, c.v * c.h)

    def _scan(self, body: bytes, coded: bytes) -> None:
        n = body[0]
        named = [(next(c for c in self.parts if c.ident == body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n)]
        first, last, approx = body[1 + 2 * n : 4 + 2 * n]
        high, low = approx >> 4, approx & 15
        if n == 1:
            c = named[0][0]
            full = c.own_wide == c.wide and c.own_high == c.high
            order = np.arange(c.wide * c.high) if full else np.arange(c.wide * c.high).reshape(c.high, c.wide)[: c.own_high, : c.own_wide].ravel()
            units, owner = order[:, None], [0]
        else:
            units = np.concatenate([c.by_mcu for c, _ in named], axis=1)
            owner = [k for k, (c, _) in enumerate(named) for _ in range(c.h * c.v)]
        stretches = re.split(rb"\xff[\xd0-\xd7]", coded) if self.restart else [coded]
        step = self.restart or len(units)
        for k, part in enumerate(stretches):
            part, own = part.replace(b"\xff\x00", b"\xff"), units[k * step : (k + 1) * step]
            if not len(own):
                continue
            if not first:
                self._dc(named, owner, own, part, high, low)
            elif high:
                self._ac_more(named[0], own[:, 0], part, first, last, low)
            else:
                self._ac_first(named[0], own[:, 0], part, first, last, low)

    def _dc(self, named: list, owner: list, units: np.ndarray, part: bytes, high: int, low: int) -> None:
        if high:  # one raw bit for each block
            bits = np.unpackbits(np.frombuffer(part, np.uint8), count=units.size).reshape(units.shape)
            for k, (c, _) in enumerate(named):
                cols = [i for i, o in enumerate(owner) if o == k]
                c.coef[units[:, cols].ravel(), 0] |= bits[:, cols].ravel().astype(np.int16) << low
            return
        tables = [self.dc[t >> 4] for _, t in named]
        if self.fast and all(t.by == {(1, 0): 0} for t in tables):
            return  # every difference is 0
        bits, was = Bits(part), [0] * len(named)
        for row in units.tolist():
            for o, at in zip(owner, row):
                was[o] += bits.signed(bits.symbol(tables[o]))
                named[o][0].coef[at, 0] = was[o] << low

    def _ac_first(self, named: tuple, blocks: np.ndarray, part: bytes, first: int, last: int, low: int) -> None:
        c, codes, wide = named[0], self.ac[named[1] & 15], last - first + 1
        if self.fast and codes.by == {(1, 0): 7} and len(part) == len(blocks) * wide:
            raw = np.frombuffer(part, np.uint8)
            if raw.max(initial=0) < 128:  # each coefficient: a 0 for "run 0, size 7" and seven bits
                value = raw.astype(np.int16)
                value -= (value < 64) * np.int16(127)
                value <<= low
                if len(blocks) == len(c.coef):
                    c.coef[:, first : last + 1] = value.reshape(-1, wide)
                else:
                    c.coef[blocks, first : last + 1] = value.reshape(-1, wide)
                return
        bits, skip = Bits(part), 0
        for at in blocks.tolist():
            if skip:
                skip -= 1
                continue
            k = first
            while k <= last:
                run, size = divmod(bits.symbol(codes), 16)
                if size:
                    k += run
                    c.coef[at, k] = bits.signed(size) << low
                    k += 1
                elif run == 15:
                    k += 16
                else:
                    skip = (1 << run) + bits.get(run) - 1
                    break

    def _ac_more(self, named: tuple, blocks: np.ndarray, part: bytes, first: int, last: int, low: int) -> None:
        c, codes, wide = named[0], self.ac[named[1] & 15], last - first + 1
        bits, one = Bits(part), 1 << low
        if self.fast:
            was = c.coef[:, first : last + 1] if len(blocks) == len(c.coef) else c.coef[blocks, first : last + 1]
            if was.all():
                at = 0
                while at < len(blocks):  # nothing can become non-zero: runs of blocks with a raw bit for each coefficient
                    run, size = divmod(bits.symbol(codes), 16)
                    if size or run == 15:
                        raise ValueError("bad refinement")
                    n = min((1 << run) + bits.get(run), len(blocks) - at)
                    more = bits.bits[bits.at : bits.at + n * wide].reshape(n, wide).astype(np.int16) << low
                    bits.at += n * wide
                    old = was[at : at + n]
                    c.coef[blocks[at : at + n], first : last + 1] = old + np.where(old < 0, -more, more)
                    at += n
                return
        skip = 0

        def refine(at: int, k: int) -> None:
            if bits.get(1):
                c.coef[at, k] += one if c.coef[at, k] > 0 else -one

        for at in blocks.tolist():
            k = first
            if not skip:
                while k <= last:
                    run, size = divmod(bits.symbol(codes), 16)
                    value = 0
                    if size:
                        value = one if bits.get(1) else -one
                    elif run < 15:
                        skip = (1 << run) + bits.get(run)
                        break
                    while k <= last:
                        if c.coef[at, k]:
                            refine(at, k)
                        elif run == 0:
                            if value:
                                c.coef[at, k] = value
                            k += 1
                            break
                        else:
                            run -= 1
                        k += 1
            if skip:
                for k in range(k, last + 1):
                    if c.coef[at, k]:
                        refine(at, k)
                skip -= 1

    def planes(self) -> list[np.ndarray]:
        """Samples of each component at its own resolution."""
        out = []
        for c in self.parts:
            plane = np.empty((c.high, 8, c.wide, 8), np.uint8)
            step = max(1, 16_384 // c.wide)  # rows of blocks at a time
            for i in range(0, c.high, step):
                scaled = (c.coef[i * c.wide : (i + step) * c.wide] * self.quant[c.table]) @ _IDCT
                samples = np.clip((scaled.astype(np.int32) + (1 << (_SHIFT - 1)) >> _SHIFT) + 128, 0, 255)
                plane[i : i + step] = samples.reshape(-1, c.wide, 8, 8).transpose(0, 2, 1, 3)
            out.append(plane.reshape(c.high * 8, c.wide * 8))
        return out

    def rgb(self) -> np.ndarray:
        """height x width x 3, 8 bits; a single component gives equal channels."""
        planes = self.planes()
        out = np.empty((self.height, self.width, 3), np.uint8)
        tall = 8 * self.vmax
        step = tall * max(1, (1 << 20) // (tall * self.width))
        for top in range(0, self.height, step):  # a strip at a time: chroma upsampled, then converted
            strip = [self._upsampled(p, c, top, step) for c, p in zip(self.parts, planes)]
            own = out[top : top + step]
            if len(strip) == 1:
                own[:] = strip[0][:, :, None]
                continue
            y, cb, cr = (p.astype(np.int32) for p in strip)
            cb, cr, y = cb - 128, cr - 128, (y << 16) + (1 << 15)
            own[:, :, 0] = np.clip((y + 91881 * cr) >> 16, 0, 255)
            own[:, :, 1] = np.clip((y - 22554 * cb - 46802 * cr) >> 16, 0, 255)
            own[:, :, 2] = np.clip((y + 116130 * cb) >> 16, 0, 255)
        return out

    def _upsampled(self, plane: np.ndarray, c: Component, top: int, step: int) -> np.ndarray:
        down, across = self.vmax // c.v, self.hmax // c.h
        part = plane[top // down : (top + step) // down]
        return np.repeat(np.repeat(part, down, axis=0), across, axis=1)[: min(step, self.height - top), : self.width]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


#: Byte for a coefficient's first pass (a 0, then its upper seven bits as JPEG writes signed values), and its refinement bit.
_BYTE = np.arange(256)
_FIRST = np.where(_BYTE < 128, 64 + ((_BYTE & 127) >> 1), 63 - ((_BYTE & 127) >> 1)).astype(np.uint8)
#: Spectral bands of each component.
_BANDS = ((1, (1, 5)), (1, (6, 63)), (2, (1, 63)), (3, (1, 63)))
_TABLES = _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC4, b"\0" + bytes([1] + [0] * 15) + b"\0" + b"\x10" + bytes([1] + [0] * 15) + b"\7" + b"\x11" + bytes([0, 0, 0, 15] + [0] * 12) + bytes(range(0, 0xF0, 16)))


def encode(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients hold a payload of a positive multiple of 64 bytes.

    A block's first byte is its DC value; another byte b is the AC value 128 + b % 128, negative from 128 on. Blocks
    fill the luma plane, then the two chroma planes; blocks beyond the payload are zero bytes.
    """
    n = len(payload) // 64
    mcus = max(1, -(-n // 6))
    wide = min(4095, int(np.ceil(np.sqrt(mcus))))
    high = -(-mcus // wide)
    if high > 4095 or len(payload) % 64 or not payload:
        raise ValueError("payload doesn't fit")
    whole = np.zeros((6 * wide * high, 64), np.uint8)
    whole[:n] = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    m = wide * high
    parts = {1: whole[: 4 * m], 2: whole[4 * m : 5 * m], 3: whole[5 * m :]}
    out = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), _TABLES]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    luma = parts[1][:, 0].reshape(high, 2, wide, 2).transpose(0, 2, 1, 3).reshape(m, 4)
    dc = np.concatenate((luma, parts[2][:, :1], parts[3][:, :1]), axis=1).ravel()
    names = bytes([3, 1, 0, 2, 0, 3, 0])
    zero = np.zeros(dc.size, np.uint8)
    zero = np.packbits(np.concatenate((zero, np.ones(-dc.size % 8, np.uint8)))).tobytes()
    out += [_segment(0xDA, names + bytes([0, 0, 8])), zero]
    fill = np.ones(-dc.size % 8, np.uint8)
    for low in range(7, -1, -1):
        plane = np.packbits(np.concatenate((dc >> low & 1, fill))).tobytes()
        out += [_segment(0xDA, names + bytes([0, 0, (low + 1) << 4 | low])), plane.replace(b"\xff", b"\xff\0")]
    for ident, (first, last) in _BANDS:
        own = parts[ident][:, first : last + 1]
        out += [_segment(0xDA, bytes([1, ident, 0, first, last, 1])), _FIRST[own].tobytes()]
        bits = []
        for at in range(0, len(own), 32767):
            run = own[at : at + 32767]
            size = len(run).bit_length() - 1
            head = size << size | len(run) - (1 << size)  # 4 bits of code, then the run's lower bits
            bits += [np.array([head >> k & 1 for k in range(size + 3, -1, -1)], np.uint8), (run & 1).ravel()]
        bits = np.concatenate(bits)
        packed = np.packbits(np.concatenate((bits, np.ones(-bits.size % 8, np.uint8)))).tobytes()
        out += [_segment(0xDA, bytes([1, ident, 1, first, last, 0x10])), packed.replace(b"\xff", b"\xff\0")]
    return b"".join([*out, b"\xff\xd9"])


def payload_of(image: Image) -> bytes:
    """The bytes that encode() stored."""
    size = next(int(c[8:]) for c in image.comments if c.startswith(b"payload "))
    whole = np.concatenate([c.coef for c in image.parts])
    out = np.abs(whole).astype(np.uint8)  # AC values 128..255 keep their lower seven bits
    out[:, 1:] &= 127
    out[:, 1:] |= (whole[:, 1:] < 0).view(np.uint8) << 7
    out[:, 0] = whole[:, 0]
    return out.tobytes()[:size]
