"""Byte-level BPE by a segment tree over byte positions.

Each leaf stands for a byte position and holds the rank of the pair that starts there; each inner node holds the
leftmost least rank below it. A merge takes the root's pair, and updates at most three leaves: the pair's own, its live
left neighbour's and the swallowed right one's, each in logarithmic time. A piece of n bytes thus costs O(n log n) however
long it is.

Defined results: a null text is an empty one (no ids, the digest of nothing); repeated rows are encoded each; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bounded, per_worker

NONE = 1 << 62
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one match of the pattern. Nodes hold rank * n + position, so the least is the leftmost of the least rank."""
    if piece in ranks:
        return [ranks[piece]]
    n, get = len(piece), ranks.get
    leaves = 1 << max(0, n - 1).bit_length()
    tree = [NONE] * (2 * leaves)
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[leaves + i] = rank * n + i
    for node in range(leaves - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right
    end = list(range(1, n + 1))  # where the token that starts here ends
    start = [i - 1 for i in range(n + 1)]  # where the token that ends before i starts
    while tree[1] != NONE:
        i = tree[1] % n
        j = end[i]
        k = end[j]
        end[i], start[k] = k, i
        news = [(j, NONE)]
        rank = get(piece[i : end[k]]) if k < n else None
        news.append((i, NONE if rank is None else rank * n + i))
        if i:
            h = start[i]
            rank = get(piece[h:k])
            news.append((h, NONE if rank is None else rank * n + h))
        for leaf, least in news:
            node = leaves + leaf
            while tree[node] != least:
                tree[node] = least
                if node == 1:
                    break
                if tree[node ^ 1] < least:
                    least = tree[node ^ 1]
                node >>= 1
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


#: Before a space that a visible character follows, every match of the pattern ends, and the next begins with that space: what
#: lies between two such places is split and encoded by itself.
UNIT = re.compile(r"(?= \S)")


class Codec(Bounded):
    """Encodes and decodes texts. Keeps the ids of units and matches met before, as little-endian unsigned 32-bit integers, within
    `limit` bytes."""

    def __init__(self, path: str, pattern: str, limit: int = 128 << 20):
        super().__init__(limit)
        self.ranks = load_ranks(path)
        self.pieces = regex.compile(pattern).findall
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token

    def made(self, unit: str) -> bytes:
        found = self.pieces(unit)
        if len(found) == 1:
            ids = encode_piece(unit.encode(), self.ranks)
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.__getitem__, found))

    def size(self, value: bytes) -> int:
        return 80 + len(value)

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.__getitem__, UNIT.split(text)))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text or ""), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def codec(path: str, pattern: str) -> Codec:
    return per_worker("codec", f"{path} {pattern}", lambda: Codec(path, pattern))


def encoder(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            counts, ids_sha, back_sha = [], [], []
            for text in batch.column(1):
                ids = own.encode_bytes(text.as_py() or "")
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                back_sha.append(hashlib.sha256(own.decode(np.frombuffer(ids, "<u4").tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def token_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, the number of tokens, and digests of the ids and of the bytes decoded from them."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encoder(path, pattern), SCHEMA)


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and the token ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            ids = [own.encode(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The texts of token ids (bytes that are not UTF-8 become U+FFFD)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = [own.decode(x.as_py() or []).decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
