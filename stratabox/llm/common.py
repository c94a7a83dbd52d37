"""What the operators of this subpackage share: tables, shared storage, word hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Lower-casing of A-Z alone, as the contracts ask for it: of text, and of UTF-8 bytes.
LOWER = {c: c + 32 for c in range(65, 91)}
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


#: Of the batches that go to Python workers: whole texts are held a few times over while a batch is worked on.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package from the place the driver has it (a cluster ships it with --py-files), and bound the
    batches that they get, where the session allows larger ones."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.match(r"-?\d+", spark.conf.get(name) or "")
        if not now or not 0 < int(now[0]) <= most:
            spark.conf.set(name, str(most))
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (known, root) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = getattr(shared_dir, "own", None)
        if named is None:
            named = shared_dir.own = tempfile.mkdtemp(prefix="stratabox-")
    return named.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; drop() removes those that are no longer read.

    What is read back does not depend on the executors that wrote it, and the shuffle files behind it can go. What a result still reads
    stays until clear(), at the latest to the end of the driver's Python.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.kept: list[tuple[DataFrame, str]] = []
        atexit.register(self.clear)

    def clear(self) -> None:
        """Remove the whole folder. Nothing may read its tables any more."""
        atexit.unregister(self.clear)
        self.kept = []
        try:
            remove(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session may have ended before the driver's Python
            return

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.kept.append((kept, path))
        del df
        release(self.spark)
        return kept

    def drop(self, *kept: DataFrame) -> None:
        for name in (path for df, path in self.kept if any(df is x for x in kept)):
            remove(self.spark, name)
        self.kept = [x for x in self.kept if not any(x[0] is y for y in kept)]


def remove(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner find the shuffles and broadcasts that nothing refers to any more, and delete their files."""
    gc.collect()
    spark._jvm.System.gc()


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """The words of a text as UTF-8. bytes.split parts at the contracts' six white-space characters, no others."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.translate(LOWER_BYTES) if lower else raw).split()


class Bounded(dict):
    """What was made for keys met before, within `limit` bytes (as sized below): in two generations, so that what is met often stays.
    A subclass has made(key)."""

    #: Of an entry besides its key and value: its place in the dictionary, with the room that a growing dictionary leaves.
    PLACE = 120

    def __init__(self, limit: int):
        super().__init__()
        self.before: dict = {}
        self.room = self.half = limit // 2

    def __missing__(self, key):
        got = self.before.get(key)
        if got is None:
            got = self.made(key)
        cost = self.PLACE + len(key) + self.size(got)
        if cost > self.half // 8:  # too long to be kept
            return got
        if cost > self.room:
            self.before, self.room = dict(self), self.half
            self.clear()
        self.room -= cost
        self[key] = got
        return got

    def made(self, key):
        raise NotImplementedError

    def size(self, value) -> int:
        return 48


class WordHashes(Bounded):
    """word -> 64-bit hash."""

    def __init__(self, limit: int = 48 << 20):
        super().__init__(limit)

    def made(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word)

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` words, from the words' hashes (order counts), in time that does not grow with size."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    made, at, width = None, 0, 1
    power, block = hashes, size
    while block:  # runs of doubling width, joined as the bits of size ask
        if block & 1:
            piece = power[at : at + n]
            made = piece if made is None else mixed(made * _SPREAD + piece)
            at += width
        block >>= 1
        if block:
            power = mixed(power[:-width] * _SPREAD + power[width:])
            width *= 2
    return mixed(made + np.uint64(size))


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


_OWN: list[tuple[str, str, object]] = []


def per_worker(name: str, token: str, make):
    """make(), once for each Python worker, name and token (one drawn by the driver for each model). A worker keeps one such thing
    at a time: workers outlive operators, and what an earlier one left goes, with the memory that it had."""
    if not _OWN or _OWN[0][:2] != (name, token):
        if _OWN:
            _OWN.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)
        _OWN.append((name, token, make()))
    return _OWN[0][2]


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each lengthened until no column has it (Spark compares names without regard to case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows of two or three numbers that are broadcast at most (some 16 MB).
FEW_ROWS = 500_000


def by_few(rows: DataFrame, few: DataFrame, match, how: str = "inner") -> DataFrame:
    """rows joined with a kept table of a few numbers a row, which is broadcast while it has at most FEW_ROWS rows, so that whole texts or
    sets need no shuffle; beyond that the two are joined by their keys."""
    return rows.join(F.broadcast(few) if few.count() <= FEW_ROWS else few, match, how)


def without(docs: DataFrame, gone: DataFrame, match) -> DataFrame:
    """The rows of docs that no row of `gone` matches."""
    return by_few(docs, gone, match, "left_anti")


def new_token() -> str:
    return uuid.uuid4().hex
