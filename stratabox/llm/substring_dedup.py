"""Substring dedup by level-wise doubling.

A run of words can only repeat if its halves do. So windows of half the length are looked at first, and only where one
repeats across documents is it extended to twice its length; those that repeat again go on, until the asked length. On the
first level each full window is stood for by the least of the half windows in it: equal windows share it, so one half window
in about thirteen is enough and none is missed.

Documents with the same words are told apart first: all but those with the smallest id are covered whole, and only that one
goes on. Counts are smallest and largest ids by window hash, summed before the shuffle, so a passage in a third of
all documents is one row of each task; the join that hands the result back is split where a window is common.

Windows are told apart by 96 bits of two hashes.

Defined results: a null or empty text has no words; a document shorter than the window loses nothing; a null id is neither
smaller nor larger than another, so such rows keep everything and cover nothing; rows that repeat an id are documents of
their own, and only smaller ids count against them; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch, WordHashes, as_long, mixed, per_worker, table, unused, windows, words_of

WINDOW = 50
NOTHING = hashlib.sha256(b"").hexdigest()
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
OTHER = np.uint64(0xD6E8FEB86659FD93)


def least_halves(halves: np.ndarray, reach: int) -> np.ndarray:
    """Of each run of `reach` half windows the least hash."""
    out, width = halves, 1
    while 2 * width <= reach:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    if width < reach:
        out = np.minimum(out[: len(out) - (reach - width)], out[reach - width :])
    return out


def survey(window: int):
    """Per row: what a document is known by, and the half windows that stand for its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = per_worker("words", "", WordHashes)
        half = window // 2
        for batch in batches:
            n_words, prints, sha, anchors = [], [], [], []
            for text in batch.column(2):
                words = words_of(text.as_py())
                joined = b" ".join(words)
                n_words.append(len(words))
                prints.append(hashlib.blake2b(joined, digest_size=16).digest())
                sha.append(hashlib.sha256(joined).digest())
                if len(words) < window:
                    anchors.append(np.empty(0, np.int64))
                else:
                    anchors.append(as_long(np.unique(least_halves(windows(hashes.array(words), half), window - half + 1))))
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in anchors]))).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.int64), *anchors])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(prints, pa.binary()), pa.array(sha, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                ["doc_id", "row_key", "n_words", "print", "sha", "anchors"],
            )

    return run


def extend(window: int):
    """Per candidate document: its full windows (hash, check, position) over half windows that repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = per_worker("words", "", WordHashes)
        half = window // 2
        for batch in batches:
            for piece in range(0, batch.num_rows, 500):
                part = batch.slice(piece, 500)
                docs, keys, codes, checks, places = [], [], [], [], []
                for doc, key, text, known in zip(*(part.column(i) for i in range(4)), strict=True):
                    own = hashes.array(words_of(text.as_py()))
                    least = as_long(least_halves(windows(own, half), window - half + 1))
                    at = np.flatnonzero(np.isin(least, known.values.to_numpy(zero_copy_only=False)))
                    docs.append(np.full(len(at), doc.as_py(), np.int64))
                    keys.append(np.full(len(at), key.as_py(), np.int64))
                    codes.append(as_long(windows(own, window)[at]))
                    checks.append(as_long(windows(mixed(own ^ OTHER), window)[at]).astype(np.int32))
                    places.append(at.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (docs, keys, codes, checks, places)], ["doc_id", "row_key", "code", "check", "at"])

    return run


def repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Two tables. Documents: doc_id, row_key, n_words, sha, whole (covered whole, as copies of an earlier one). Covered windows:
    doc_id, row_key, starts (array of first positions)."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "substrings")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    known = scratch.keep(own.mapInArrow(survey(window), "doc_id long, row_key long, n_words long, print binary, sha binary, anchors array<long>"))
    long = known.filter((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    first = long.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    copies = scratch.keep(long.select("doc_id", "row_key", "print").join(first, "print").filter("doc_id > first").select("doc_id", "row_key").distinct())
    reps = long.select("doc_id", "row_key", "anchors").join(copies, ["doc_id", "row_key"], "left_anti").dropDuplicates(["doc_id", "row_key"])
    # level 1: half windows in two documents at least
    anchors = scratch.keep(reps.select("doc_id", "row_key", F.explode("anchors").alias("anchor")))
    twice = anchors.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("anchor")
    candidates = scratch.keep(anchors.join(twice, "anchor").groupBy("doc_id", "row_key").agg(F.collect_list("anchor").alias("anchors")))
    scratch.drop(anchors)
    # level 2: full windows over them
    full = own.join(candidates, ["doc_id", "row_key"]).select("doc_id", "row_key", "text", "anchors").mapInArrow(extend(window), "doc_id long, row_key long, code long, check int, at int")
    full = scratch.keep(full)
    scratch.drop(candidates)
    # written, so that both sides of the join are plain shuffles, which Spark can split where a window is common
    lowest = scratch.keep(full.groupBy("code", "check").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").drop("high"))
    later = full.join(lowest, ["code", "check"]).filter("doc_id > low").select("doc_id", "row_key", "at")
    covered = scratch.keep(later.groupBy("doc_id", "row_key").agg(F.collect_set("at").alias("starts")))
    scratch.drop(full)
    documents = known.select("doc_id", "row_key", "n_words", "sha").join(copies.withColumn("whole", F.lit(True)), ["doc_id", "row_key"], "left")
    return documents.withColumn("whole", F.coalesce("whole", F.lit(False))), covered


def covered_words(starts: list[int], n: int, window: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int32)
    at = np.asarray(starts, np.int64)
    edge[at] += 1
    np.subtract.at(edge, np.minimum(at + window, n), 1)
    return np.cumsum(edge[:-1]) > 0


def removal_digests(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256."""
    documents, covered = repeats(docs, window, id_col, text_col)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, sha = [], []
            for text, starts in zip(batch.column(2), batch.column(3), strict=True):
                words = words_of(text.as_py())
                gone = covered_words(starts.values.to_numpy(zero_copy_only=False), len(words), window)
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "row_key", "removed", "kept"])

    parted = own.join(covered, ["doc_id", "row_key"])
    cut = parted.mapInArrow(run, "doc_id long, row_key long, removed long, kept string").dropDuplicates(["doc_id", "row_key"])
    joined = documents.join(cut, ["doc_id", "row_key"], "left")
    return joined.select(
        "doc_id", "n_words",
        F.when(F.col("whole"), F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("whole"), F.lit(NOTHING)).otherwise(F.coalesce("kept", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )


def cut_text(text: str, starts: np.ndarray, window: int) -> str:
    """The text without its covered words and the white space after each; the rest stays byte by byte."""
    spans = [m.span() for m in WORD.finditer(text)]
    gone = covered_words(starts, len(spans), window)
    out, at = [], 0
    for k in np.flatnonzero(gone).tolist():
        out.append(text[at : spans[k][0]])
        at = spans[k + 1][0] if k + 1 < len(spans) else spans[k][1]
    out.append(text[at:])
    return "".join(out)


def cut_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs, all rows and columns, with covered words cut from `text` (and `n_chars` set where a text changed)."""
    documents, covered = repeats(docs, window)
    columns, schema = docs.columns, docs.schema
    doc, row, starts_name, whole_name = unused(columns, "cut_doc", "cut_row", "cut_starts", "cut_whole")
    whole = documents.filter("whole").select("doc_id", "row_key").withColumn("starts", F.lit(None).cast("array<int>")).withColumn("whole", F.lit(True))
    changes = covered.withColumn("whole", F.lit(False)).unionByName(whole).withColumnsRenamed({"doc_id": doc, "row_key": row, "starts": starts_name, "whole": whole_name})
    at = columns.index("text")
    count = columns.index("n_chars") if "n_chars" in columns else None

    def cut(text: str | None, starts: pa.Scalar, whole: bool | None) -> str | None:
        return "" if whole else text if not starts.is_valid else cut_text(text, starts.values.to_numpy(zero_copy_only=False), window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            changed = np.flatnonzero(batch.column(len(columns) + 1).is_valid().to_numpy(zero_copy_only=False))
            out = [batch.column(i) for i in range(len(columns))]
            if len(changed):
                texts, counts = out[at].to_pylist(), out[count].to_pylist() if count is not None else None
                for k in changed.tolist():
                    new = cut(texts[k], batch.column(len(columns))[k], batch.column(len(columns) + 1)[k].as_py())
                    if counts is not None and new != texts[k]:
                        counts[k] = len(new)
                    texts[k] = new
                out[at] = pa.array(texts, out[at].type)
                if counts is not None:
                    out[count] = pa.array(counts, out[count].type)
            yield pa.RecordBatch.from_arrays(out, columns)

    on = (docs["doc_id"].cast("long") == changes[doc]) & (F.xxhash64(docs["doc_id"], docs["text"]) == changes[row])
    joined = docs.join(changes, on, "left").select(*(docs[f"`{c}`"] for c in columns), starts_name, whole_name)
    return joined.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return removal_digests(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), low AS (
  SELECT h, min(doc_id) AS low FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)
), hit AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM g JOIN low USING (h) WHERE doc_id > low
), gone AS (
  SELECT doc_id, list(p) AS ps FROM hit GROUP BY doc_id
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS s
  FROM (SELECT d.doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d JOIN gone USING (doc_id)) e
  WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.doc_id = e.doc_id AND hit.p = e.p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN ps IS NULL THEN array_to_string(w, ' ') ELSE coalesce(s, '') END) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
