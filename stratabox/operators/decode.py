"""Decoders of partition data to flat field rows, in a registry where the first match wins and raw comes last."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratabox.functions import hashing
from stratabox.sources import format as fmt
from stratabox.sources import records as rec

PREVIEW = 32
DEPTH = 8  # of containers inside containers
SCHEMA = "path string, uid binary, decoder string, node_path array<string>, depth int, value_kind string, u64 long, text string, bytes binary, range_start int, range_end int, note string"

Field = tuple[tuple[str, ...], object, int | None, int | None, str | None]  # path, value, from, to, note


@dataclass(frozen=True)
class Decoder:
    name: str
    matches: Callable[[int, bytes], bool]
    fields: Callable[[bytes], Iterator[Field]]
    children: Callable[[bytes], list[tuple[bytes, int, bytes]]] = lambda data: []


def _node(data: bytes) -> Iterator[Field]:
    n = rec.read_node(data)
    yield ("kind",), {1: "file", 2: "directory"}[n.kind], 5, 6, None
    yield ("flags",), n.flags, 6, 8, "tombstone" if n.tombstone else None
    yield ("node_id",), n.node_id, 8, 24, None
    yield ("parent_id",), n.parent_id, 24, 40, None
    yield ("mtime_ms",), n.mtime_ms, 40, 48, None
    yield ("mode",), n.mode, 48, 52, None
    yield ("name",), n.name.decode("utf-8", "replace"), 54, 54 + len(n.name), None
    c = n.content
    if c:
        yield ("content", "kind"), rec.CONTENT_NAMES[c.kind], 54 + len(n.name), 55 + len(n.name), None
        if c.kind in (rec.DIRECT, rec.DELTA):
            yield ("content", "uid"), c.uid, None, None, None
            yield ("content", "size"), c.size, None, None, None
            yield ("content", "hash"), c.hash[: hashing.LENGTHS[c.algo]], None, None, hashing.NAMES[c.algo]
        if c.kind == rec.DELTA:
            yield ("content", "base_size"), c.base_size, None, None, None


def _session(data: bytes) -> Iterator[Field]:
    s = rec.read_session(data)
    yield ("session_seq",), s.seq, 8, 16, None
    yield ("ts_ms",), s.ts_ms, 16, 24, None
    yield ("prev_hash",), s.prev_hash[: hashing.LENGTHS[s.prev_algo]], 25, 89, hashing.NAMES[s.prev_algo]
    yield ("block_count",), s.block_count, 89, 93, None
    yield ("change_count",), s.change_count, 158, 160, None
    yield ("writer",), s.writer.decode("utf-8", "replace"), 162, 162 + len(s.writer), None


def _key(data: bytes) -> Iterator[Field]:
    k = rec.read_key(data)
    yield ("format",), rec.KEY_FORMATS[k.format], 12, 13, None
    yield ("fingerprint",), k.fingerprint, 16, 48, None
    yield ("key",), k.data, 52, 52 + len(k.data), None
    for i, (tag, value) in enumerate(k.metadata):
        yield ("metadata", str(i), rec.tag_name(tag)), value, None, None, None


def _signature(data: bytes) -> Iterator[Field]:
    s = rec.read_signature(data)
    m = s.manifest
    yield ("algorithm",), rec.SIGNATURE_ALGORITHMS[m.sig_algo], 12, 13, None
    yield ("manifest_hash",), hashing.NAMES[m.hash_algo], 13, 14, None
    yield ("fingerprint",), m.fingerprint, 16, 48, None
    yield ("signed_at",), m.signed_at, 48, 56, None
    for i, e in enumerate(m.entries):
        yield ("entries", str(i), "uid"), e.uid, 60 + 218 * i, 76 + 218 * i, None
        yield ("entries", str(i), "hash"), e.hash[: hashing.LENGTHS[e.algo]], None, None, hashing.NAMES[e.algo]
    yield ("signature",), s.signature, None, None, None


def _container(data: bytes) -> Iterator[Field]:
    h, arena, _ = rec.read_container(data)
    yield ("inner_table_offset",), h.table, 8, 16, None
    yield ("arena_used",), h.used, 16, 24, None
    for i, x in enumerate(arena.inners):
        yield ("inners", str(i), "uid"), x.uid, None, None, None
        yield ("inners", str(i), "extents"), len(x.extents), None, None, None


def _inner_parts(data: bytes) -> list[tuple[bytes, int, bytes]]:
    _, arena, _ = rec.read_container(data)
    return [(x.uid, x.type, arena.content(x)) for x in arena.inners]


def _raw(data: bytes) -> Iterator[Field]:
    yield ("size",), len(data), 0, len(data), None
    printable = sum(32 <= b < 127 or b in (9, 10, 13) for b in data)
    yield ("printable",), printable * 100 // len(data) if data else 0, None, None, "percent"
    yield ("preview",), data[:PREVIEW], 0, min(PREVIEW, len(data)), None


BUILT_IN = (
    Decoder("node", lambda t, d: t == fmt.NODE_TYPE or d[:4] == rec.NODE_MAGIC, _node),
    Decoder("session", lambda t, d: t == fmt.SESSION_TYPE or d[:4] == rec.SESSION_MAGIC, _session),
    Decoder("key", lambda t, d: t == fmt.KEY_TYPE or d[:8] == rec.KEY_MAGIC, _key),
    Decoder("signature", lambda t, d: t == fmt.SIGNATURE_TYPE or d[:8] == rec.SIGNATURE_MAGIC, _signature),
    Decoder("container", lambda t, d: t == fmt.CONTAINER_TYPE or d[:4] == rec.CONTAINER_MAGIC, _container, _inner_parts),
)
RAW = Decoder("raw", lambda t, d: True, _raw)


class Registry:
    def __init__(self, *more: Decoder, by_type: bool = False):
        """by_type: matches see partition types alone, so that data that begin with a record's magic are not taken for one."""
        self.decoders, self.by_type = [*BUILT_IN, *more, RAW], by_type

    def names(self) -> list[str]:
        return [d.name for d in self.decoders]

    def decode(self, type_: int, data: bytes, forced: str | None = None) -> tuple[Decoder, list[Field]]:
        """The first decoder that matches; what it can't read is noted and shown raw."""
        seen = b"" if self.by_type else data
        chosen = next(d for d in self.decoders if (d.name == forced if forced else d.matches(type_, seen)))
        try:
            return chosen, list(chosen.fields(data))
        except (ValueError, KeyError) as e:
            return chosen, [(("error",), str(e), None, None, None), *_raw(data)]

    def nested(self, type_: int, data: bytes, forced: str | None = None, depth: int = 0) -> Iterator[tuple[str, Field]]:
        chosen, fields = self.decode(type_, data, forced)
        yield chosen.name, (("decoder",), chosen.name, None, None, None)
        for f in fields:
            yield chosen.name, f
        if depth < DEPTH:
            try:
                inner = chosen.children(data)
            except ValueError:
                inner = []
            for uid, t, d in inner:
                for name, (path, *rest) in self.nested(t, d, None, depth + 1):
                    yield name, (("children", uid.hex(), *path), *rest)


def field_nodes(data: DataFrame, registry: Registry | None = None, forced: str | None = None) -> DataFrame:
    """The `data` view to field rows, in pre-order."""
    own = registry or Registry()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.strip().split(" ")[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            for path, uid, type_, content in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                rows = []
                for name, (at, value, low, high, note) in own.nested(type_, content or b"", forced):
                    kind = "bytes" if isinstance(value, bytes) else "u64" if isinstance(value, int) else "text"
                    rows.append((path, uid, name, list(at), len(at), kind, value if kind == "u64" and value < 2**63 else None, value if kind == "text" else str(value) if kind == "u64" else None, value if kind == "bytes" else None, low, high, note))
                types = [pa.string(), pa.binary(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return data.select("path", "uid", "partition_type", "data").mapInArrow(run, SCHEMA)


def raw(data: DataFrame) -> DataFrame:
    """label, size, printable (percent of bytes), preview: in Spark's own functions."""
    latin = F.decode("data", "ISO-8859-1")
    printable = F.length(F.regexp_replace(latin, r"[^\x20-\x7e\t\n\r]", ""))
    size = F.octet_length("data").cast("long")
    return data.select("path", "uid", "label", size.alias("size"), F.when(size == 0, 0).otherwise(F.floor(printable * 100 / size)).cast("long").alias("printable"), F.substring("data", 1, PREVIEW).alias("preview"))
