"""New archives from old ones: compaction, edits, promotion and demotion. Copy-on-write: the input stays as it is."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratabox.sources import format as fmt
from stratabox.sources import records as rec
from stratabox.sources import signing
from stratabox.sources.tree_log import Change, TreeLog

SCHEMA = "path string, content binary"


def rewritten(archives: DataFrame, change: Callable[[bytes], bytes]) -> DataFrame:
    """Each archive by itself: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([change(content.as_py())], pa.binary())], ["path", "content"])

    return archives.select("path", "content").mapInArrow(run, SCHEMA)


def compacted(archives: DataFrame, check: bool = True, allow_log: bool = False) -> DataFrame:
    """Verify, repack without slack and dead space, verify again. Refuses versioned trees."""
    return rewritten(archives, lambda data: fmt.compacted(data, check, allow_log))


def compacted_trees(archives: DataFrame) -> DataFrame:
    """Versioned trees as they are now, in one session."""
    return rewritten(archives, lambda data: TreeLog(data).compacted())


def with_rows(archives: DataFrame, rows: DataFrame, change: Callable[[bytes, list[dict]], bytes]) -> DataFrame:
    """Archives changed by the rows of their path; one shuffle brings them together."""
    columns = [c for c in rows.columns if c != "path"]
    lists = rows.groupBy("path").agg(F.collect_list(F.struct(*columns)).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, own in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([change(content, own) if own else content], pa.binary())], ["path", "content"])

    return archives.join(lists, "path", "left").select("path", "content", "rows").mapInArrow(run, SCHEMA)


def edited(archives: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: path, uid, data. New bytes within a partition's space; null data removes it."""

    def change(content: bytes, rows: list[dict]) -> bytes:
        for r in rows:
            content = fmt.removed(content, r["uid"]) if r["data"] is None else fmt.updated(content, r["uid"], r["data"])
        return content

    return with_rows(archives, edits.select("path", "uid", "data"), change)


def committed(archives: DataFrame, changes: DataFrame, ts_ms: int = 0) -> DataFrame:
    """changes: path, op, tree_path, data, to. One session for each versioned tree that has changes."""

    def change(content: bytes, rows: list[dict]) -> bytes:
        log = TreeLog(content)
        log.apply([Change(r["op"], r["tree_path"], r["data"] or b"", to=r["to"] or "") for r in rows], ts_ms)
        return log.data

    return with_rows(archives, changes.select("path", "op", "tree_path", "data", "to"), change)


def promoted_image(content: bytes, wanted: set[bytes]) -> bytes:
    parts = fmt.loaded(content)
    out, added = [], []
    for p in parts:
        if p.type == fmt.CONTAINER_TYPE:
            _, arena, _ = rec.read_container(p.data)
            for x in [x for x in arena.inners if x.uid in wanted]:
                type_, label, algo, data = arena.remove(x.uid)
                added.append(fmt.Part(type_, x.uid, label, data, algo))
            p = replace(p, data=arena.to_bytes(), hash=b"")
        out.append(p)
    return fmt.image(out + added, keep_hashes=True)


def demoted_image(content: bytes, wanted: set[bytes], home: bytes | None = None, size: int = 0) -> bytes:
    """home: the uid of the container to go to; without one, the archive's first. Contents are cut into chunks of `size` (0: whole), and
    chunks that the container has are shared."""
    parts = fmt.loaded(content)
    at = next((k for k, p in enumerate(parts) if p.type == fmt.CONTAINER_TYPE and home in (None, p.uid)), None)
    rec.require(at is not None, "NotAContainer")
    _, arena, _ = rec.read_container(parts[at].data)
    for p in (p for p in parts if p.uid in wanted):
        arena.add(p.type, p.uid, p.label, p.data, p.algo, size)
    parts[at] = replace(parts[at], data=arena.to_bytes(), hash=b"")
    return fmt.image([p for p in parts if p.uid not in wanted], keep_hashes=True)


def promoted(archives: DataFrame, uids: DataFrame) -> DataFrame:
    """uids: path, uid. Inner partitions become top-level ones; uid, type, label, algorithm and hash stay."""
    return with_rows(archives, uids.select("path", "uid"), lambda content, rows: promoted_image(content, {r["uid"] for r in rows}))


def demoted(archives: DataFrame, uids: DataFrame, size: int = 0) -> DataFrame:
    """uids: path, uid. Top-level partitions become inner ones of their archive's first container."""
    return with_rows(archives, uids.select("path", "uid"), lambda content, rows: demoted_image(content, {r["uid"] for r in rows}, size=size))


def deduplicated(archives: DataFrame, size: int = 0) -> DataFrame:
    """Containers cut anew into chunks of `size` bytes (0: whole), equal chunks stored once, dead bytes dropped."""

    def change(content: bytes) -> bytes:
        parts = []
        for p in fmt.loaded(content):
            if p.type == fmt.CONTAINER_TYPE:
                _, arena, _ = rec.read_container(p.data)
                arena.dedup(size)
                p = replace(p, data=arena.to_bytes(), hash=b"")
            parts.append(p)
        return fmt.image(parts, keep_hashes=True)

    return rewritten(archives, change)


def signed(archives: DataFrame, seed: bytes, ts: int = 0, resign: bool = False) -> DataFrame:
    """Each archive with a signature by this key over all that the key does not validly cover yet; versioned trees get it as a session.
    Archives with nothing to sign stay as they are."""
    return rewritten(archives, lambda data: signing.signed(data, seed, None, ts, resign)[0])


def defragmented(archives: DataFrame) -> DataFrame:
    """Containers without the bytes that no extent refers to; extents keep their cuts."""

    def change(content: bytes) -> bytes:
        parts = []
        for p in fmt.loaded(content):
            if p.type == fmt.CONTAINER_TYPE:
                _, arena, _ = rec.read_container(p.data)
                arena.defrag()
                p = replace(p, data=arena.to_bytes(), hash=b"")
            parts.append(p)
        return fmt.image(parts, keep_hashes=True)

    return rewritten(archives, change)
