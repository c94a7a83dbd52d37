"""Archives built from the driver's tables, so that archive operators can be held against SQL on those tables.

Archives are rows (path, content) of a bounded number of partitions, more data meaning more archives. Each set is built once in a session
and written to the shared folder, so that what reads it reads files, as it would those that are there already.
"""

from __future__ import annotations

import atexit
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratabox.functions import hashing

from . import archive
from . import format as fmt
from . import records as rec
from .tree_log import TreeLog, replay

DOCS_PER_ARCHIVE = 64
CHUNK = 64
USERS_PER_LOG = 8
KINDS = {"en": 0x10, "fr": 0x11, "de": 0x12, "es": 0x13}
OTHER_KIND = 0x1F
SEED = bytes(range(32))  # of the test signer's key
DAY_MS = 86_400_000


_STORED: dict[tuple, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only for a local session that names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = _STORED.setdefault(("own folder",), "") or tempfile.mkdtemp(prefix="stratabox-")
        _STORED["own folder",] = named
    return named.rstrip("/")


def stored(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """build(spark, sf_dir, ...), written once for each session and arguments, and read from there."""

    @wraps(build)
    def run(spark: SparkSession, sf_dir: str, *more) -> DataFrame:
        key = (spark.sparkContext.applicationId, build.__name__, sf_dir, *more)
        if key not in _STORED:
            path = f"{shared_dir(spark)}/{build.__name__}-{uuid.uuid4().hex}"
            build(spark, sf_dir, *more).write.parquet(path)
            _STORED[key] = path
            atexit.register(_remove, spark, path)
        return spark.read.parquet(_STORED[key])

    return run


def _remove(spark: SparkSession, path: str) -> None:
    try:
        found = spark._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)
    except Exception:  # noqa: BLE001  the session may have ended before the driver's Python
        return


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def uid(prefix: str, value: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.lit(f"{prefix}:"), value.cast("string"))))


def archive_path(number: Column, prefix: str, size: int) -> Column:
    return F.concat(F.lit(prefix), F.floor(number / size).cast("string"))


def kind_of(lang: Column) -> Column:
    column = F.lit(OTHER_KIND)
    for name, code in KINDS.items():
        column = F.when(lang == name, code).otherwise(column)
    return column.cast("long")


def algorithm_of(number: Column, algorithms: tuple[int, ...]) -> Column:
    return F.element_at(F.array(*(F.lit(i) for i in algorithms)), (F.pmod(number, F.lit(len(algorithms))) + 1).cast("int"))


def document_rows(spark: SparkSession, sf_dir: str, algorithms: tuple[int, ...] = ()) -> DataFrame:
    """One partition for each document: its text, by turns under each hash algorithm (or under these), with some slack."""
    d = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(
        archive_path(d, "docs-", DOCS_PER_ARCHIVE).alias("path"), d.alias("ord"), kind_of(F.col("lang")).alias("partition_type"), uid("doc", d).alias("uid"),
        F.concat(F.lit("doc-"), d.cast("string")).alias("label"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"),
        algorithm_of(d, algorithms or tuple(i for i, _, _, _ in hashing.ALGORITHMS)).alias("data_hash_algo"), (F.pmod(d, F.lit(7)) * 16).alias("reserve"),
    )


@stored
def documents(spark: SparkSession, sf_dir: str, *algorithms: int) -> DataFrame:
    return archive.build(document_rows(spark, sf_dir, algorithms))


@stored
def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives with one dynamic container each: a document is an inner partition in chunks of CHUNK bytes."""

    def run(table: pa.Table) -> pa.Table:
        rows, arena = sorted(table.to_pylist(), key=lambda r: r["ord"]), rec.Arena()
        for r in rows:
            arena.inners.append(rec.Inner(r["partition_type"], r["uid"], fmt.encode_label(r["label"]), 16, [arena._store(x) for x in rec.chunks(r["data"], CHUNK)]))
        arena.mark_shared()
        path = rows[0]["path"].replace("docs", "dyn")
        part = fmt.Part(fmt.CONTAINER_TYPE, hashing.digest_many(4, [path.encode()])[0], fmt.encode_label("container"), arena.to_bytes(), 0)
        return pa.table({"path": [path], "content": pa.array([fmt.image([part])], pa.binary())})

    rows = document_rows(spark, sf_dir).select("path", "ord", "partition_type", "uid", "label", "data")
    return rows.groupBy("path").applyInArrow(run, "path string, content binary")


@stored
def signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document archives with a signature over those documents that `labels` has."""
    chosen = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("ord")).distinct().withColumn("named", F.lit(True))
    rows = document_rows(spark, sf_dir, (16,)).join(chosen, "ord", "left").select("path", "ord", "partition_type", "uid", "label", "data", F.coalesce("named", F.lit(False)).alias("named"))

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["ord"])
        parts = [fmt.sealed(fmt.Part(r["partition_type"], r["uid"], fmt.encode_label(r["label"]), r["data"]), 0) for r in rows]
        uids = [r["uid"] for r in rows if r["named"]]
        path = rows[0]["path"].replace("docs", "signed")
        if uids:
            key, payload = rec.sign_parts(parts, SEED, uids)
            name = lambda what: hashing.digest_many(4, [f"{path}:{what}".encode()])[0]
            parts.append(fmt.Part(fmt.KEY_TYPE, name("key"), fmt.encode_label("key"), rec.write_key(key)))
            parts.append(fmt.Part(fmt.SIGNATURE_TYPE, name("signature"), fmt.encode_label("signature"), payload))
        return pa.table({"path": [path], "content": pa.array([fmt.image(parts)], pa.binary())})

    return rows.groupBy("path").applyInArrow(run, "path string, content binary")


def day(ts: Column) -> Column:
    return F.datediff(ts, F.lit("2024-01-01")).cast("long")


@stored
def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versioned trees of `events`: a directory for each event type, a file for each user, a session for each day after the first. A user's
    file lies in the directory of the day's last event and holds its text; `error` removes it; on day 20 directory `view` goes."""
    e = read(spark, sf_dir, "events").withColumn("day", day(F.col("ts")))
    last = e.groupBy("user_id", "day").agg(F.max_by(F.struct("event_type", "value", "props"), F.struct("ts", "event_id")).alias("r"))
    text = F.concat_ws("|", F.col("user_id").cast("string"), F.col("day").cast("string"), F.col("r.event_type"), F.repeat(F.concat(F.lit("profile of user "), F.col("user_id").cast("string"), F.lit("; ")), 12), F.coalesce("r.props", F.lit("")))
    rows = last.select(archive_path(F.col("user_id"), "log-", USERS_PER_LOG).alias("path"), "user_id", "day", F.col("r.event_type").alias("kind"), F.encode(text, "UTF-8").alias("data"))
    # each is a directory of every tree, so that one tree bounds their number
    types = [r["event_type"] for r in e.select("event_type").distinct().orderBy("event_type").collect()]
    return rows.groupBy("path").applyInArrow(history_builder(types), "path string, content binary")


def history_builder(types: list[str]) -> Callable[[pa.Table], pa.Table]:
    md5 = lambda text: hashing.digest_many(4, [text.encode()])[0]

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["day"], r["user_id"]))
        path, log = rows[0]["path"], TreeLog(writer=b"ingest")
        dirs = {t: rec.Node(rec.DIRECTORY, md5(f"dir:{t}"), rec.ROOT, t.encode()) for t in types}
        log.commit([log.node_part(n) for n in [rec.Node(rec.DIRECTORY, rec.ROOT, rec.ROOT, b""), *dirs.values()]], 1 + len(dirs), 0)
        chains: dict[bytes, list[rec.Content]] = {}
        stored: dict[bytes, bytes] = {}
        for number in range(max(r["day"] for r in rows) + 1):
            parts, nodes = [], []
            for r in (r for r in rows if r["day"] == number):
                node_id, name = md5(f"user:{r['user_id']}"), f"u{r['user_id']}".encode()
                if r["kind"] == "error":
                    nodes.append(rec.Node(rec.FILE, node_id, dirs[r["kind"]].node_id, name, rec.TOMBSTONE))
                    continue
                chain = chains.setdefault(node_id, [])
                before = replay(list(reversed(chain)), stored.__getitem__) if chain else None
                log.log.history[node_id] = [(0, rec.Node(rec.FILE, node_id, rec.ROOT, name, content=c)) for c in chain]
                content, part = log._choose(node_id, before, r["data"])
                if part is not None:
                    parts.append(part)
                    stored[part.uid] = part.data
                chain.append(content)
                nodes.append(rec.Node(rec.FILE, node_id, dirs[r["kind"]].node_id, name, content=content))
            if number == 20 and "view" in dirs:
                nodes.append(rec.Node(rec.DIRECTORY, dirs["view"].node_id, rec.ROOT, b"view", rec.TOMBSTONE))
            log.commit(parts + [log.node_part(n) for n in nodes], len(nodes), (number + 1) * DAY_MS)
        return pa.table({"path": [path], "content": pa.array([log.data], pa.binary())})

    return run


# --- the same sets with what can go wrong, by the number in an archive's path


def number_of(path: str) -> int:
    return int(path.rsplit("-", 1)[1])


def spoilt(archives: DataFrame, spoil: Callable[[int, bytes], bytes]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([spoil(number_of(path), content.as_py())], pa.binary())], ["path", "content"])

    return archives.select("path", "content").mapInArrow(run, "path string, content binary")


def with_bytes(data: bytes, at: int, new: bytes) -> bytes:
    return data[:at] + new + data[at + len(new) :]


def resealed(data: bytes, block: fmt.Block, at: int, new: bytes) -> bytes:
    """`new` at a place within a block, under a block hash that agrees with it."""
    data = with_bytes(data, at, new)
    image = data[block.offset : block.offset + len(block.image)]
    return with_bytes(data, block.offset + 10, fmt.block_hash(block.algo, image))


def spoil_archive(number: int, data: bytes) -> bytes:
    """0 as it is; 1 a byte of data; 2 cut inside the header; 3 no archive; 4 a byte of the block's hash; 5 a block that follows itself; 6
    five thousand blocks in its place."""
    kind, block = number % 7, fmt.walk(data).blocks[0]
    if kind == 1:
        p = next((p for p in block.entries if p.used and p.algo), None)
        return data if p is None else with_bytes(data, p.start, bytes([data[p.start] ^ 1]))
    if kind == 2:
        return data[:15]
    if kind == 3:
        return b"\7" * 100
    if kind == 4:
        return with_bytes(data, block.offset + 10, bytes([data[block.offset + 10] ^ 1]))
    if kind == 5:
        return resealed(data, block, block.offset + 1, struct.pack("<Q", block.offset))
    if kind == 6:
        return fmt.image([fmt.Part(0x10, k.to_bytes(16, "big"), fmt.encode_label(""), b"", 0) for k in range(1, 5001)], 16, capacity=1)
    return data


@stored
def spoilt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spoilt(documents(spark, sf_dir), spoil_archive)


def spoil_tree(number: int, data: bytes) -> bytes:
    """0 as it is; 1 the newest session names another elder, under hashes that agree; 2 the newest session torn; 3 one more session, in
    which two directories are each other's parents."""
    kind = number % 4
    if kind == 1:
        head = fmt.walk(data).blocks[0]
        slot, p = next((k, p) for k, p in enumerate(head.entries) if p.type == fmt.SESSION_TYPE)
        data = with_bytes(data, p.start + 25, bytes([data[p.start + 25] ^ 1]))  # prev_hash begins there
        return resealed(data, head, head.offset + fmt.BLOCK + slot * fmt.ENTRY + 77, hashing.field(p.algo, fmt.data_of(data, p)))
    if kind == 2:
        return data[:-7]
    if kind == 3:
        log, a, b = TreeLog(data, writer=b"spoiler"), b"\1" * 16, b"\2" * 16
        log.commit([log.node_part(rec.Node(rec.DIRECTORY, a, b, b"a")), log.node_part(rec.Node(rec.DIRECTORY, b, a, b"b"))], 2, log.log.sessions[-1].ts_ms)
        return log.data
    return data


@stored
def spoilt_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spoilt(histories(spark, sf_dir), spoil_tree)


def spoil_container(number: int, data: bytes) -> bytes:
    """0 as it is; 1 a stored byte that only inner hashes cover; 2 the first inner partition's uid on the outside as well; 3 no container."""
    kind, parts = number % 4, fmt.loaded(data)
    held = parts[0].data
    if kind == 1:
        parts[0] = replace(parts[0], data=with_bytes(held, rec.CONTAINER_HEADER, bytes([held[rec.CONTAINER_HEADER] ^ 1])))
    elif kind == 2:
        parts.append(fmt.Part(0x10, rec.read_container(held)[1].inners[0].uid, fmt.encode_label("twin"), b"twin"))
    elif kind == 3:
        parts[0] = replace(parts[0], data=with_bytes(held, 0, b"none"))
    return fmt.image(parts, keep_hashes=True)


@stored
def spoilt_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spoilt(containers(spark, sf_dir), spoil_container)


def spoil_signed(number: int, data: bytes) -> bytes:
    """0 as it is; 1 a byte of the signature; 2 without the key; 3 a signature that can't be read; 4 a byte of the first signed partition
    that has any, under its old hash; 5 another label for the first signed one."""
    kind, parts = number % 6, fmt.loaded(data)
    at = next((k for k, p in enumerate(parts) if p.type == fmt.SIGNATURE_TYPE), None)
    if at is None or not kind:
        return data
    entries = rec.read_signature(parts[at].data).manifest.entries
    if kind == 1:
        held = parts[at].data
        parts[at] = replace(parts[at], data=with_bytes(held, len(held) - 5, bytes([held[-5] ^ 1])), hash=b"")
    elif kind == 2:
        parts = [p for p in parts if p.type != fmt.KEY_TYPE]
    elif kind == 3:
        parts[at] = replace(parts[at], data=b"junk", hash=b"")
    else:
        uid = next((e.uid for e in entries if kind == 5 or e.used), None)
        parts = [p if p.uid != uid else replace(p, label=fmt.encode_label("other")) if kind == 5 else replace(p, data=bytes([p.data[0] ^ 1]) + p.data[1:]) for p in parts]
    return fmt.image(parts, keep_hashes=True)


@stored
def spoilt_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spoilt(signed(spark, sf_dir), spoil_signed)
