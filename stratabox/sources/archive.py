"""Archives as relational views.

`archives` are rows (path, content), from `read_archives` (any file system that Spark reads) or built in a plan. Each view is one
`mapInArrow` over them: an archive is self-contained, so no view shuffles. Views without data columns never ship data to the JVM.
The same views are a Python data source, `spark.read.format("archive").option("view", ...)`, for paths that workers can open.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import format as fmt
from . import records, verdicts

CONTENT = "struct<kind:short,compression:short,patch:short,uid:binary,size:long,algo:short,hash:binary,base_size:long,base_algo:short,base_hash:binary>"
SCHEMAS = {
    "files": "path string, file_len long, version_major int, version_minor int, pointer decimal(20,0), head_source string, table_head long, chain_backward boolean, trailer_offset long",
    "blocks": "path string, block_index int, block_offset long, partition_count int, next_table_offset long, algo_id short, table_hash binary, image binary",
    "partitions": "path string, ord int, block_index int, slot int, partition_type long, uid binary, label string, label_raw binary, start_offset long, max_length long, used_bytes long, free_bytes long, data_hash_algo short, data_hash binary, data_in_bounds boolean, validate_error string",
    "data": "path string, ord int, block_index int, slot int, partition_type long, uid binary, label string, label_raw binary, start_offset long, max_length long, used_bytes long, free_bytes long, data_hash_algo short, data_hash binary, data_in_bounds boolean, validate_error string, data binary",
    "diagnostics": "path string, severity string, kind string, message string, detail map<string,string>",
    "sessions": "path string, session_seq long, head_offset long, head_hash binary, head_algo short, ts_ms long, prev_hash_algo short, prev_hash binary, block_count long, blocks_found int, member_algo short, member_digest binary, member_hashes binary, change_count int, writer string, error string",
    "nodes": f"path string, session_seq long, node_id binary, parent_id binary, kind short, flags int, tombstone boolean, mtime_ms long, mode long, name string, name_raw binary, content {CONTENT}, error string",
    "containers": "path string, container_uid binary, major int, minor int, flags int, inner_table_offset long, arena_used long, blocks_ok boolean, error string",
    "inners": "path string, container_uid binary, inner_ord int, inner_uid binary, type long, label string, used_bytes long, algo short, data_hash binary, content binary",
    "extents": "path string, container_uid binary, inner_ord int, inner_uid binary, seq int, extent_offset long, extent_length long, kind short, shared boolean",
    "keys": "path string, ord int, uid binary, fingerprint binary, key_format short, key_data binary, metadata array<struct<tag:int,name:string,value:binary>>, error string",
    "signatures": "path string, ord int, uid binary, sig_algo short, hash_algo short, fingerprint binary, signed_at long, manifest binary, signature binary, error string",
    "signed_entries": "path string, ord int, sig_uid binary, pos int, uid binary, type long, label_raw binary, used_bytes long, algo short, data_hash binary",
    "regions": "path string, start long, len long, kind string, label string, uid binary, end long, file_len long",
    **verdicts.SCHEMAS,
}


def _part_row(path: str, ord_: int, block: int, slot: int, p: fmt.Part, size: int) -> tuple:
    label = fmt.decode_label(p.label)
    return (path, ord_, block, slot, p.type, p.uid, label, p.label, p.start, p.max, p.used, max(0, p.max - p.used), p.algo, p.hash, p.start + p.used <= size, fmt.entry_error(p.type, p.uid, p.used, p.max, p.label))


def _placed(found: fmt.Archive) -> Iterator[tuple[int, int, int, fmt.Part]]:
    ord_ = 0
    for b, block in enumerate(found.blocks):
        for slot, p in enumerate(block.entries):
            yield ord_, b, slot, p
            ord_ += 1


def _files(path: str, data: bytes, found: fmt.Archive) -> Iterator[tuple]:
    from decimal import Decimal

    if found.version:
        yield path, found.size, *found.version, Decimal(found.pointer), found.head_source, found.head, found.backward, found.trailer


def _blocks(path: str, data: bytes, found: fmt.Archive) -> Iterator[tuple]:
    for k, b in enumerate(found.blocks):
        yield path, k, b.offset, b.count, b.next, b.algo, b.hash, b.image


def _partitions(path: str, data: bytes, found: fmt.Archive) -> Iterator[tuple]:
    for ord_, b, slot, p in _placed(found):
        yield _part_row(path, ord_, b, slot, p, found.size)


def _data(path: str, data: bytes, found: fmt.Archive) -> Iterator[tuple]:
    for ord_, b, slot, p in _placed(found):
        yield *_part_row(path, ord_, b, slot, p, found.size), fmt.data_of(data, p)


def _diagnostics(path: str, data: bytes, found: fmt.Archive) -> Iterator[tuple]:
    for severity, kind, message, detail in found.problems:
        yield path, severity, kind, message, detail


def _session_groups(data: bytes, found: fmt.Archive) -> Iterator[tuple[fmt.Part, list[fmt.Block]]]:
    """Newest first: each session's record and the blocks from its head to the next session's."""
    heads = [(k, p) for k, b in enumerate(found.blocks) for p in b.entries if p.type == fmt.SESSION_TYPE]
    for n, (k, p) in enumerate(heads):
        end = heads[n + 1][0] if n + 1 < len(heads) else len(found.blocks)
        yield p, found.blocks[k:end]


def _sessions(path: str, data: bytes, found: fmt.Archive) -> Iterator[tuple]:
    for p, blocks in _session_groups(data, found):
        try:
            s = records.read_session(fmt.data_of(data, p))
        except fmt.ArchiveError as e:
            yield path, None, blocks[0].offset, blocks[0].hash, blocks[0].algo, *[None] * 4, len(blocks), *[None] * 5, str(e)
            continue
        yield path, s.seq, blocks[0].offset, blocks[0].hash, blocks[0].algo, s.ts_ms, s.prev_algo, s.prev_hash, s.block_count, len(blocks), s.member_algo, s.member_digest, b"".join(b.hash for b in blocks[1:]), s.change_count, s.writer.decode("utf-8", "replace"), None


def _nodes(path: str, data: bytes, found: fmt.Archive) -> Iterator[tuple]:
    for p, blocks in _session_groups(data, found):
        try:
            seq = records.read_session(fmt.data_of(data, p)).seq
        except fmt.ArchiveError:
            seq = None
        for q in (x for b in blocks for x in b.entries if x.type == fmt.NODE_TYPE):
            try:
                n = records.read_node(fmt.data_of(data, q))
            except fmt.ArchiveError as e:
                yield path, seq, *[None] * 10, str(e)
                continue
            c = n.content
            content = None if c is None else {"kind": c.kind, "compression": c.compression, "patch": c.patch, "uid": c.uid, "size": c.size, "algo": c.algo, "hash": c.hash, "base_size": c.base_size, "base_algo": c.base_algo, "base_hash": c.base_hash}
            yield path, seq, n.node_id, n.parent_id, n.kind, n.flags, n.tombstone, n.mtime_ms, n.mode, n.name.decode("utf-8", "replace"), n.name, content, None


def _opened(data: bytes, found: fmt.Archive) -> Iterator[tuple[fmt.Part, tuple | None, str | None]]:
    for p in found.parts:
        if p.type == fmt.CONTAINER_TYPE:
            try:
                yield p, records.read_container(fmt.data_of(data, p)), None
            except fmt.ArchiveError as e:
                yield p, None, str(e)


def _containers(path: str, data: bytes, found: fmt.Archive) -> Iterator[tuple]:
    for p, got, error in _opened(data, found):
        if got is None:
            yield path, p.uid, *[None] * 6, error
        else:
            h, _, blocks = got
            yield path, p.uid, h.major, h.minor, h.flags, h.table, h.used, all(b[3] for b in blocks), None


def _inners(path: str, data: bytes, found: fmt.Archive) -> Iterator[tuple]:
    for p, got, _ in _opened(data, found):
        for k, x in enumerate(got[1].inners if got else ()):
            try:
                content = got[1].content(x)
            except fmt.ArchiveError:
                content = None  # unreadable
            yield path, p.uid, k, x.uid, x.type, fmt.decode_label(x.label), x.used, x.algo, x.hash, content


def _extents(path: str, data: bytes, found: fmt.Archive) -> Iterator[tuple]:
    for p, got, _ in _opened(data, found):
        for k, x in enumerate(got[1].inners if got else ()):
            for seq, e in enumerate(x.extents):
                yield path, p.uid, k, x.uid, seq, e.offset, e.length, e.kind, bool(e.flags & records.SHARED)


def _keys(path: str, data: bytes, found: fmt.Archive) -> Iterator[tuple]:
    for ord_, _, _, p in _placed(found):
        if p.type == fmt.KEY_TYPE:
            try:
                k = records.read_key(fmt.data_of(data, p))
                tags = [{"tag": t, "name": records.tag_name(t), "value": v} for t, v in k.metadata]
                yield path, ord_, p.uid, k.fingerprint, k.format, k.data, tags, None
            except fmt.ArchiveError as e:
                yield path, ord_, p.uid, None, None, None, None, str(e)


def _signatures(path: str, data: bytes, found: fmt.Archive) -> Iterator[tuple]:
    for ord_, _, _, p in _placed(found):
        if p.type == fmt.SIGNATURE_TYPE:
            try:
                s = records.read_signature(fmt.data_of(data, p))
                m = s.manifest
                yield path, ord_, p.uid, m.sig_algo, m.hash_algo, m.fingerprint, m.signed_at, s.manifest_bytes, s.signature, None
            except fmt.ArchiveError as e:
                yield path, ord_, p.uid, *[None] * 6, str(e)


def _signed_entries(path: str, data: bytes, found: fmt.Archive) -> Iterator[tuple]:
    for ord_, _, _, p in _placed(found):
        if p.type == fmt.SIGNATURE_TYPE:
            try:
                entries = records.read_signature(fmt.data_of(data, p)).manifest.entries
            except fmt.ArchiveError:
                continue
            for pos, e in enumerate(entries):
                yield path, ord_, p.uid, pos, e.uid, e.type, e.label, e.used, e.algo, e.hash


def _regions(path: str, data: bytes, found: fmt.Archive) -> Iterator[tuple]:
    """Header, block headers, entry arrays, data and slack, in the order that the file is read."""
    placed = [(0, fmt.HEADER, "header", None, None)] if found.version else []
    for b in found.blocks:
        placed.append((b.offset, fmt.BLOCK, "tableheader", None, None))
        if b.count:
            placed.append((b.offset + fmt.BLOCK, b.count * fmt.ENTRY, "entries", None, None))
        for p in b.entries:
            if p.used:
                placed.append((p.start, p.used, "data", fmt.decode_label(p.label), p.uid))
            if p.max > p.used:
                placed.append((p.start + p.used, p.max - p.used, "slack", fmt.decode_label(p.label), p.uid))
    for start, size, kind, label, uid in placed:
        yield path, start, size, kind, label, uid, start + size, found.size


VIEWS: dict[str, Callable[[str, bytes, fmt.Archive], Iterator[tuple]]] = {
    "files": _files, "blocks": _blocks, "partitions": _partitions, "data": _data, "diagnostics": _diagnostics, "sessions": _sessions, "nodes": _nodes, "containers": _containers,
    "inners": _inners, "extents": _extents, "keys": _keys, "signatures": _signatures, "signed_entries": _signed_entries, "regions": _regions, **verdicts.VIEWS,
}
ROWS_PER_BATCH = 2_000


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """path, content of each file under a path or glob."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def view(archives: DataFrame, name: str, mode: str = "PERMISSIVE") -> DataFrame:
    """One of VIEWS. FAILFAST raises the first broken rule; PERMISSIVE reads on and leaves it to the diagnostics view."""
    rows_of, strict = VIEWS[name], mode.upper() == "FAILFAST"
    schema = StructType.fromDDL(SCHEMAS[name])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                data = content.as_py() or b""
                for row in rows_of(path.as_py(), data, fmt.walk(data, strict)):
                    held.append(row)
                    if len(held) >= ROWS_PER_BATCH:
                        yield to_batch(held, arrow)
                        held = []
            yield to_batch(held, arrow)

    return archives.select("path", "content").mapInArrow(run, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


# --- data source -------------------------------------------------------------------------------------------------------------


class _Group(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(tuple(paths))
        self.paths = paths


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path (a URI of any that pyarrow opens, or a local path) and the path in it."""
    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/") if path.startswith(("/", "file:")) else path


def _listed(pattern: str) -> list[tuple[str, int]]:
    """Paths and sizes, by metadata alone."""
    store, path = _store(pattern)
    found = []
    for top in glob.glob(path) if isinstance(store, fs.LocalFileSystem) else [path]:
        info = store.get_file_info(top)
        found += [info] if info.type == fs.FileType.File else [x for x in store.get_file_info(fs.FileSelector(top, recursive=True)) if x.type == fs.FileType.File]
    return sorted((x.path, x.size) for x in found if x.base_name[0] not in "._")


def _bytes(pattern: str, path: str, size: int | None = None) -> bytes:
    with _store(pattern)[0].open_input_file(path) as f:
        return f.read() if size is None else f.read(size)


class ArchiveSource(DataSource):
    """`format("archive")`. Options: view, mode (PERMISSIVE or FAILFAST), group_bytes, and for writing table_algo, trailer."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("view", "partitions")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ArchiveStream(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ArchiveWriter(self.options, overwrite)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.rows_of = VIEWS[options.get("view", "partitions")]
        self.strict = options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        self.path, self.group_bytes = options["path"], int(options.get("group_bytes", 64 << 20))

    def partitions(self) -> list[InputPartition]:
        """Files in groups of about group_bytes."""
        groups: list[list[str]] = [[]]
        held = 0
        for path, size in _listed(self.path):
            if groups[-1] and held + size > self.group_bytes:
                groups.append([])
                held = 0
            groups[-1].append(path)
            held += size
        return [_Group(g) for g in groups]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in partition.paths:
            data = _bytes(self.path, path)
            yield from self.rows_of(path, data, fmt.walk(data, self.strict))


class ArchiveStream(DataSourceStreamReader):
    """New archives, and new sessions of versioned trees. The offset holds each file's size, which the driver gets from the listing alone;
    tasks read up to it, and up to the last whole trailer there, so a torn tail is never read, and what was published by the size before
    is not returned again."""

    def __init__(self, options: dict[str, str]):
        self.view, self.path = options.get("view", "sessions"), options["path"]

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return dict(_listed(self.path))

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Range(p, start.get(p, 0), n) for p, n in sorted(end.items()) if n > start.get(p, 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        data = _bytes(self.path, partition.path, partition.end)
        rows = VIEWS[self.view](partition.path, data, fmt.walk(data))
        before = fmt.walk(data[: partition.start])
        if not partition.start or not before.blocks:
            return rows
        if self.view not in ("sessions", "nodes"):
            # a tree that grew is returned again, other archives are not
            return rows if before.head_source == "trailer" else iter(())
        known = {r[1] for r in _sessions(partition.path, data[: partition.start], before)}
        return (r for r in rows if r[1] not in known)


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


class _Written(WriterCommitMessage):
    def __init__(self, paths: list[tuple[str, str]]):
        self.paths = paths


class ArchiveWriter(DataSourceWriter):
    """Rows (path, partition_type, uid, label, data [, data_hash_algo, reserve]), all of a path in one task, to one archive each. Tasks
    write beside the target; commit renames, abort removes."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.root, self.overwrite = options["path"].removeprefix("file:"), overwrite
        self.algo, self.trailer = int(options.get("table_algo", 16)), options.get("trailer", "false").lower() == "true"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        import uuid

        held: dict[str, list[fmt.Part]] = {}
        for r in rows:
            own = r.asDict()
            held.setdefault(own["path"], []).append(fmt.Part(own["partition_type"], bytes(own["uid"]), fmt.encode_label(own["label"]), bytes(own["data"]), own.get("data_hash_algo", 16), own.get("reserve", 0) or 0))
        made = []
        os.makedirs(self.root, exist_ok=True)
        for path, parts in held.items():
            target = os.path.join(self.root, path)
            if any(p.type == fmt.SESSION_TYPE for p in parts):
                raise fmt.ArchiveError("VersionedTree", "written by commits only")
            if os.path.exists(target) and not self.overwrite:
                raise FileExistsError(target)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            beside = os.path.join(os.path.dirname(target), f"._{os.path.basename(target)}-{uuid.uuid4().hex}")
            with open(beside, "wb") as f:
                f.write(fmt.image(parts, self.algo, self.trailer))
                f.flush()
                os.fsync(f.fileno())
            made.append((beside, target))
        return _Written(made)

    def commit(self, messages: list) -> None:
        targets = [t for m in messages if m for _, t in m.paths]
        if len(set(targets)) != len(targets):
            self.abort(messages)
            raise ValueError("rows of one archive came in several tasks: repartition by path")
        for m in messages:
            for beside, target in m.paths if m else ():
                os.replace(beside, target)

    def abort(self, messages: list) -> None:
        for m in messages:
            for beside, _ in m.paths if m else ():
                if os.path.exists(beside):
                    os.remove(beside)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)


def build(rows: DataFrame, trailer: bool = False, table_algo: int = 16) -> DataFrame:
    """Rows (path, ord, partition_type, uid, label, data, data_hash_algo, reserve) to archives (path, content). One shuffle; an archive is
    built in memory, so callers keep archives of bounded size."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["ord"])
        parts = [fmt.Part(r["partition_type"], r["uid"], fmt.encode_label(r["label"]), r["data"], r["data_hash_algo"], r["reserve"]) for r in rows]
        return pa.table({"path": [rows[0]["path"]], "content": pa.array([fmt.image(parts, table_algo, trailer)], pa.binary())})

    own = rows.select("path", "ord", F.col("partition_type").cast("long").alias("partition_type"), "uid", "label", "data", F.col("data_hash_algo").cast("int").alias("data_hash_algo"), F.col("reserve").cast("int").alias("reserve"))
    return own.groupBy("path").applyInArrow(run, "path string, content binary")
