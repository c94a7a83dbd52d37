"""Byte codecs of stored content: raw DEFLATE, VCDIFF patches, Ed25519 signatures."""

from __future__ import annotations

import hashlib
import zlib


class CodecError(ValueError):
    """Content that can't be decoded; the message says why."""


# Ids of the stored form and of patches.
STORED, DEFLATED, VCDIFF = 0, 1, 1


def deflate(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    return packer.compress(data) + packer.flush()


def inflate(form: int, data: bytes) -> bytes:
    if form == STORED:
        return data
    if form != DEFLATED:
        raise CodecError(f"unsupported compression {form}")
    try:
        return zlib.decompressobj(-15).decompress(data)
    except zlib.error as e:
        raise CodecError(f"inflate: {e}") from e


# VCDIFF (RFC 3284). Magic, and the default code table's layout as ranges.
VCDIFF_MAGIC = b"\xd6\xc3\xc4\x00"
NOOP, ADD, RUN, COPY = range(4)
NEAR, SAME = 4, 3


def code_table() -> list[tuple[tuple[int, int, int], tuple[int, int, int]]]:
    """RFC 3284 section 5.6 as a rule: (type, size, mode) twice for each of the 256 codes."""
    none = (NOOP, 0, 0)
    table = [((RUN, 0, 0), none)]
    table += [((ADD, size, 0), none) for size in range(18)]
    table += [((COPY, size, mode), none) for mode in range(9) for size in (0, *range(4, 19))]
    table += [((ADD, a, 0), (COPY, c, mode)) for mode in range(6) for a in range(1, 5) for c in range(4, 7)]
    table += [((ADD, a, 0), (COPY, 4, mode)) for mode in range(6, 9) for a in range(1, 5)]
    table += [((COPY, 4, mode), (ADD, 1, 0)) for mode in range(9)]
    return table


_CODES = code_table()


class _Reader:
    def __init__(self, data: bytes, at: int = 0, end: int | None = None):
        self.data, self.at, self.end = data, at, len(data) if end is None else end

    def byte(self) -> int:
        if self.at >= self.end:
            raise CodecError("patch ends early")
        self.at += 1
        return self.data[self.at - 1]

    def number(self) -> int:
        value = 0
        for _ in range(10):
            b = self.byte()
            value = value << 7 | b & 127
            if b < 128:
                return value
        raise CodecError("number too long")

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > self.end:
            raise CodecError("patch ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def part(self, n: int) -> _Reader:
        self.take(n)
        return _Reader(self.data, self.at - n, self.at)


class _Addresses:
    """The near and same caches of one window."""

    def __init__(self):
        self.near, self.next, self.same = [0] * NEAR, 0, [0] * (SAME * 256)

    def keep(self, address: int) -> int:
        self.near[self.next] = address
        self.next = (self.next + 1) % NEAR
        self.same[address % (SAME * 256)] = address
        return address

    def read(self, mode: int, here: int, source: _Reader) -> int:
        if mode == 0:
            return self.keep(source.number())
        if mode == 1:
            return self.keep(here - source.number())
        if mode < 2 + NEAR:
            return self.keep(self.near[mode - 2] + source.number())
        return self.keep(self.same[(mode - 2 - NEAR) * 256 + source.byte()])


def apply_patch(kind: int, base: bytes, patch: bytes) -> bytes:
    """The target of a patch against `base`."""
    if kind != VCDIFF:
        raise CodecError(f"unsupported patch {kind}")
    r = _Reader(patch)
    if r.take(3) != VCDIFF_MAGIC[:3]:
        raise CodecError("not a patch")
    r.byte()
    indicator = r.byte()
    if indicator & 3:
        raise CodecError("secondary compression and own code tables are not supported")
    if indicator & 4:
        r.take(r.number())
    out = bytearray()
    while r.at < r.end:
        window = r.byte()
        segment = b""
        if window & 3:
            size, place = r.number(), r.number()
            whole = base if window & 1 else bytes(out)
            segment = whole[place : place + size]
            if len(segment) != size:
                raise CodecError("segment outside its source")
        body = r.part(r.number())
        length = body.number()
        if body.byte():
            raise CodecError("compressed sections are not supported")
        sizes = [body.number() for _ in range(3)]
        if window & 4:  # checksum of the window
            body.take(4)
        data, codes, places = (body.part(n) for n in sizes)
        made, caches = bytearray(), _Addresses()
        while codes.at < codes.end:
            for what, size, mode in _CODES[codes.byte()]:
                if what == NOOP:
                    continue
                size = size or codes.number()
                if what == ADD:
                    made += data.take(size)
                elif what == RUN:
                    made += bytes([data.byte()]) * size
                else:
                    place = caches.read(mode, len(segment) + len(made), places)
                    if not 0 <= place < len(segment) + len(made):
                        raise CodecError("copy from nowhere")
                    for k in range(place, place + size):  # may overlap what it makes
                        made.append(segment[k] if k < len(segment) else made[k - len(segment)])
                if len(made) > length:
                    raise CodecError("window too long")
        if len(made) != length:
            raise CodecError("window too short")
        out += made
    return bytes(out)


def _number(value: int) -> bytes:
    out = [value & 127]
    while value := value >> 7:
        out.append(value & 127 | 128)
    return bytes(reversed(out))


def make_patch(base: bytes, target: bytes, step: int = 16) -> bytes:
    """A patch of one window: copies of base runs found by blocks of `step` bytes, the rest added."""
    index: dict[bytes, int] = {}
    for place in range(0, len(base) - step + 1, step):
        index.setdefault(base[place : place + step], place)
    data, codes, places = bytearray(), bytearray(), bytearray()

    def add(piece: bytes) -> None:
        if piece:
            data.extend(piece)
            codes.extend(bytes([1]) + _number(len(piece)))

    at = pending = 0
    while at + step <= len(target):
        place = index.get(target[at : at + step])
        if place is None:
            at += 1
            continue
        begin, source = at, place
        while begin > pending and source and target[begin - 1] == base[source - 1]:
            begin, source = begin - 1, source - 1
        end, stop = at + step, place + step
        while end < len(target) and stop < len(base) and target[end] == base[stop]:
            end, stop = end + 1, stop + 1
        add(target[pending:begin])
        codes.extend(bytes([19]) + _number(end - begin))
        places.extend(_number(source))
        at = pending = end
    add(target[pending:])
    body = _number(len(target)) + b"\0" + b"".join(map(_number, (len(data), len(codes), len(places)))) + bytes(data + codes + places)
    head = b"\x01" + _number(len(base)) + _number(0) if base else b"\x00"
    return VCDIFF_MAGIC + b"\0" + head + _number(len(body)) + body


# Ed25519 (RFC 8032). Field, group order, curve constant, base point.
_P = 2**255 - 19
_L = 2**252 + 27742317777372353535851937790883648493
_D = -121665 * pow(121666, -1, _P) % _P
_ROOT = pow(2, (_P - 1) // 4, _P)


def _x_of(y: int, sign: int) -> int | None:
    square = (y * y - 1) * pow(_D * y * y + 1, -1, _P) % _P
    x = pow(square, (_P + 3) // 8, _P)
    if (x * x - square) % _P:
        x = x * _ROOT % _P
    if (x * x - square) % _P or (x == 0 and sign):
        return None
    return _P - x if x & 1 != sign else x


def _plus(a: tuple, b: tuple) -> tuple:
    """Extended coordinates (X, Y, Z, T)."""
    s, t = (a[1] - a[0]) * (b[1] - b[0]), (a[1] + a[0]) * (b[1] + b[0])
    u, v = 2 * a[3] * b[3] * _D, 2 * a[2] * b[2]
    e, f, g, h = t - s, v - u, v + u, t + s
    return e * f % _P, g * h % _P, f * g % _P, e * h % _P


def _times(k: int, point: tuple) -> tuple:
    out = (0, 1, 1, 0)
    while k:
        if k & 1:
            out = _plus(out, point)
        point = _plus(point, point)
        k >>= 1
    return out


_BY = 4 * pow(5, -1, _P) % _P
_BX = _x_of(_BY, 0)
_BASE = (_BX, _BY, 1, _BX * _BY % _P)


def _pack(point: tuple) -> bytes:
    z = pow(point[2], -1, _P)
    x, y = point[0] * z % _P, point[1] * z % _P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _unpack(data: bytes) -> tuple | None:
    y = int.from_bytes(data, "little")
    sign, y = y >> 255, y & (1 << 255) - 1
    x = _x_of(y, sign) if y < _P else None
    return None if x is None else (x, y, 1, x * y % _P)


def _scalar(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % _L


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    a = int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254
    return a, h[32:]


def public_key(seed: bytes) -> bytes:
    return _pack(_times(_secret(seed)[0], _BASE))


def sign(seed: bytes, message: bytes) -> bytes:
    a, prefix = _secret(seed)
    own = _pack(_times(a, _BASE))
    r = _scalar(prefix, message)
    point = _pack(_times(r, _BASE))
    return point + ((r + _scalar(point, own, message) * a) % _L).to_bytes(32, "little")


def key_usable(key: bytes) -> bool:
    return len(key) == 32 and _unpack(key) is not None


def verify(key: bytes, message: bytes, signature: bytes) -> bool:
    if len(key) != 32 or len(signature) != 64:
        return False
    own, point, s = _unpack(key), _unpack(signature[:32]), int.from_bytes(signature[32:], "little")
    if own is None or point is None or s >= _L:
        return False
    left, right = _times(s, _BASE), _plus(point, _times(_scalar(signature[:32], key, message), own))
    return (left[0] * right[2] - right[0] * left[2]) % _P == 0 and (left[1] * right[2] - right[1] * left[2]) % _P == 0
