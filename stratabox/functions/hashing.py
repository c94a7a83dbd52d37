"""Digests of archive data: a registry of algorithms, over many byte strings at once."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

FIELD = 64  # bytes of a hash field; digests are left-aligned, the rest is zero

# Id, name, digest bytes, whether signatures may rely on it.
ALGORITHMS = (
    (0, "none", 0, False),
    (1, "crc32", 4, False),
    (2, "crc32c", 4, False),
    (3, "crc64-xz", 8, False),
    (4, "md5", 16, False),
    (5, "sha1", 20, False),
    (16, "sha256", 32, True),
    (17, "sha512", 64, True),
    (18, "blake3", 32, True),
)
NAMES = {i: name for i, name, _, _ in ALGORITHMS}
LENGTHS = {i: n for i, _, n, _ in ALGORITHMS}
STRONG = tuple(i for i, _, _, strong in ALGORITHMS if strong)

# Reflected polynomials.
CRC32C_POLYNOMIAL = 0x82F63B78
CRC64_POLYNOMIAL = 0xC96C5795D7870F42

# Initial state and word order of the tree hash (BLAKE3).
BLAKE3_START = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
BLAKE3_ORDER = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8


class UnknownAlgorithm(ValueError):
    """An algorithm id that is not in the registry."""


def crc_table(polynomial: int) -> list[int]:
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ polynomial if value & 1 else value >> 1
        table.append(value)
    return table


_TABLES = {32: crc_table(CRC32C_POLYNOMIAL), 64: crc_table(CRC64_POLYNOMIAL)}


def crc_many(data: list[bytes], bits: int) -> list[int]:
    """Reflected checksums with all-ones start and end, byte by byte over all strings side by side."""
    kind = np.uint32 if bits == 32 else np.uint64
    full = (1 << bits) - 1
    if len(data) < 16:
        out, table = [], _TABLES[bits]
        for x in data:
            state = full
            for byte in x:
                state = table[(state ^ byte) & 255] ^ state >> 8
            out.append(state ^ full)
        return out
    table = np.array(_TABLES[bits], kind)
    order = sorted(range(len(data)), key=lambda i: -len(data[i]))
    lengths = np.array([len(data[i]) for i in order])
    flat = np.frombuffer(b"".join(data[i] for i in order), np.uint8)
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    state = np.full(len(data), full, kind)
    alive = len(data)
    for step in range(int(lengths[0]) if len(lengths) else 0):
        while lengths[alive - 1] <= step:
            alive -= 1
        now = state[:alive]
        state[:alive] = table[((now ^ flat[starts[:alive] + step]) & kind(255)).astype(np.intp)] ^ (now >> kind(8))
    out = [0] * len(data)
    for place, value in zip(order, (state ^ kind(full)).tolist(), strict=True):
        out[place] = value
    return out


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return x >> np.uint32(by) | x << np.uint32(32 - by)


def _blake3_compress(chain: np.ndarray, block: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """One compression for each column: chain (8, n), block (16, n) of 32-bit words."""
    n = chain.shape[1]
    start = np.repeat(BLAKE3_START[:4, None], n, 1)
    low, high = (counter & 0xFFFFFFFF).astype(np.uint32), (counter >> 32).astype(np.uint32)
    v = np.concatenate([chain, start, np.stack([low, high, length.astype(np.uint32), flags.astype(np.uint32)])])

    def quarter(a: list[int], b: list[int], c: list[int], d: list[int], x: np.ndarray, y: np.ndarray) -> None:
        for word, (s, t) in ((x, (16, 12)), (y, (8, 7))):
            v[a] = v[a] + v[b] + word
            v[d] = _turn(v[d] ^ v[a], s)
            v[c] = v[c] + v[d]
            v[b] = _turn(v[b] ^ v[c], t)

    rows = [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11], [12, 13, 14, 15]]
    slant = [[0, 1, 2, 3], [5, 6, 7, 4], [10, 11, 8, 9], [15, 12, 13, 14]]
    words = block
    for turn in range(7):
        if turn:
            words = words[BLAKE3_ORDER]
        quarter(*rows, words[0:8:2], words[1:8:2])
        quarter(*slant, words[8:16:2], words[9:16:2])
    return v[:8] ^ v[8:]


def blake3_many(data: list[bytes]) -> list[bytes]:
    """BLAKE3 digests; all chunks of all strings go through each compression together."""
    if not data:
        return []
    counts = [max(1, -(-len(x) // 1024)) for x in data]
    owner = np.repeat(np.arange(len(data)), counts)
    number = np.concatenate([np.arange(c) for c in counts])
    sizes = np.array([min(1024, len(data[o]) - 1024 * k) for o, k in zip(owner.tolist(), number.tolist(), strict=True)])
    padded = np.zeros((len(owner), 1024), np.uint8)
    for row, (o, k, size) in enumerate(zip(owner.tolist(), number.tolist(), sizes.tolist(), strict=True)):
        padded[row, :size] = np.frombuffer(data[o], np.uint8, size, 1024 * k)
    words = padded.view("<u4").reshape(len(owner), 16, 16)
    blocks = np.maximum(1, -(-sizes // 64))
    single = np.array(counts)[owner] == 1
    chain = np.repeat(BLAKE3_START[:, None], len(owner), 1)
    for b in range(int(blocks.max())):
        live = np.flatnonzero(blocks > b)
        last = blocks[live] == b + 1
        flags = (CHUNK_START if b == 0 else 0) + last * (CHUNK_END + single[live] * ROOT)
        chain[:, live] = _blake3_compress(chain[:, live], words[live, b].T.copy(), number[live], np.where(last, sizes[live] - 64 * b, 64), flags)
    at, layers = 0, []
    for c in counts:
        layers.append(chain[:, at : at + c])
        at += c
    while any(x.shape[1] > 1 for x in layers):  # halves meet pairwise: a left subtree is always full
        pairs, whose = [], []
        for k, x in enumerate(layers):
            if x.shape[1] > 1:
                half = x.shape[1] // 2
                pairs.append(np.concatenate([x[:, 0 : 2 * half : 2], x[:, 1 : 2 * half : 2]]))
                whose.append((k, half, x.shape[1] == 2))
        joined = np.concatenate(pairs, 1)
        flags = np.concatenate([np.full(half, PARENT + (ROOT if root else 0)) for _, half, root in whose])
        n = joined.shape[1]
        made = _blake3_compress(np.repeat(BLAKE3_START[:, None], n, 1), joined, np.zeros(n, np.int64), np.full(n, 64), flags)
        at = 0
        for k, half, _ in whose:
            rest = layers[k][:, 2 * half :]
            layers[k] = np.concatenate([made[:, at : at + half], rest], 1)
            at += half
    return [x[:, 0].astype("<u4").tobytes() for x in layers]


def digest_many(algorithm: int, data: list[bytes]) -> list[bytes]:
    """Significant digest bytes (checksums little-endian) of each string."""
    if algorithm == 0:
        return [b""] * len(data)
    if algorithm == 1:
        return [zlib.crc32(x).to_bytes(4, "little") for x in data]
    if algorithm in (2, 3):
        size = LENGTHS[algorithm]
        return [x.to_bytes(size, "little") for x in crc_many(data, 8 * size)]
    if algorithm == 18:
        return blake3_many(data)
    if algorithm in NAMES:
        return [hashlib.new(NAMES[algorithm], x).digest() for x in data]
    raise UnknownAlgorithm(algorithm)


def field(algorithm: int, data: bytes) -> bytes:
    """The 64-byte hash field."""
    return digest_many(algorithm, [data])[0].ljust(FIELD, b"\0")


def agrees(algorithm: int, stored: bytes, data: bytes) -> bool:
    """Whether the significant bytes agree; without an algorithm they always do."""
    n = LENGTHS.get(algorithm)
    if n is None:
        raise UnknownAlgorithm(algorithm)
    return stored[:n] == digest_many(algorithm, [data])[0]


@F.pandas_udf(BinaryType())
def _rare(algorithm: pd.Series, data: pd.Series) -> pd.Series:
    """Digests that Spark has no function for, grouped by algorithm."""
    out = pd.Series([None] * len(data), dtype=object)
    for number in (2, 3, 18):
        rows = [i for i, a in enumerate(algorithm) if a == number and data.iloc[i] is not None]
        for i, x in zip(rows, digest_many(number, [bytes(data.iloc[i]) for i in rows]), strict=True):
            out[i] = x
    return out


def _little_endian(number: Column, size: int) -> Column:
    # reverse() is by characters: it may not part what looks like one
    digits = F.lpad(F.hex(number), 2 * size, "0")
    return F.unhex(F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size)))))


def digest(algorithm: Column, data: Column, rare: bool = True) -> Column:
    """The digest column. The common algorithms are Spark's own; `rare` adds those that need Python."""
    column = (
        F.when(algorithm == 0, F.lit(b""))
        .when(algorithm == 1, _little_endian(F.crc32(data), 4))
        .when(algorithm == 4, F.unhex(F.md5(data)))
        .when(algorithm == 5, F.unhex(F.sha1(data)))
        .when(algorithm == 16, F.unhex(F.sha2(data, 256)))
        .when(algorithm == 17, F.unhex(F.sha2(data, 512)))
    )
    return column.when(algorithm.isin(2, 3, 18), _rare(algorithm, data)) if rare else column


def digest_length(algorithm: Column) -> Column:
    column = F.lit(None).cast("int")
    for number, _, size, _ in reversed(ALGORITHMS):
        column = F.when(algorithm == number, size).otherwise(column)
    return column


def matches(algorithm: Column, stored: Column, computed: Column) -> Column:
    """Significant prefix compare; true without an algorithm."""
    n = digest_length(algorithm)
    return (algorithm == 0) | (F.substring(stored, F.lit(1), n) == F.substring(computed, F.lit(1), n))


def names() -> Iterable[tuple[int, str]]:
    return NAMES.items()
