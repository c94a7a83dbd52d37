"""Benchmark decontamination by a distributed positional inverted index.

Index. Each training document's tokens become postings (term, row, position), written as a table in the shared folder and sorted by
term. Kept are those that a phrase of the benchmark could hold: of a term pair that stands side by side in some item, or of an item of one
word. Which pairs those are is told by a filter of FILTER_BITS bits, whatever the size of the benchmark; what it lets through by chance
costs space alone. Proximity search keeps every posting of a term that some item has, by a filter of the same kind.

Search. Terms are counted over the whole index. Of each window of an item the rarest term is its anchor; an item is looked for only
in documents that the lists of its anchors name. There an anchor's list, less the anchor's place in the item, gives the places where
the item would begin; the other terms' lists are intersected with it at their own offsets, and every run of a whole window is an exact
match. Items meet postings in plain joins by term, which Spark can split where a term is common: nothing of the benchmark but the filter
is sent to all executors, and a document meets an item once, however many windows they share.

Defined results: a null text or one without words is not hit; an item without words has no window; items that repeat an id
count once; items without an id hit words and count as one more item together, without a name in the digest; repeated documents are each
reported; an empty table on either side gives no hits; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, as_long, mixed, parts, per_worker, table, unused, without

WINDOW = 8
FILTER_BITS = 1 << 26  # 8 MB of broadcast
LEAST_ITEMS = 2
SLICES = 64  # of a term's list in the index
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
NOTHING = hashlib.sha256(b"").hexdigest()
#: Bytes of UTF-8 as the contract's words have them: A-Z lower-cased, digits, letters and all beyond ASCII as they are, the rest parts words.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_ALONE = np.uint64(0xD6E8FEB86659FD93)


def terms(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TERM_BYTES).split() if text else []


def pair_codes(ids: np.ndarray) -> np.ndarray:
    """Of each two terms side by side."""
    return mixed(ids[:-1] * _PAIR + ids[1:])


def term_codes(ids: np.ndarray) -> np.ndarray:
    return mixed(ids ^ _ALONE)


def places(codes: np.ndarray) -> np.ndarray:
    """The two bits of each code."""
    return np.concatenate([codes % np.uint64(FILTER_BITS), (codes >> np.uint64(32)) % np.uint64(FILTER_BITS)]).astype(np.int64)


class Filter:
    """Codes that the benchmark has, and by chance some others."""

    def __init__(self, words: list[tuple[int, int]]):
        bits = np.zeros(FILTER_BITS // 64, np.uint64)
        for at, value in words:
            bits[at] = value % 2**64
        self.bits = bits

    def has(self, codes: np.ndarray) -> np.ndarray:
        out = np.ones(len(codes), bool)
        for at in (codes % np.uint64(FILTER_BITS), (codes >> np.uint64(32)) % np.uint64(FILTER_BITS)):
            out &= (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
        return out

    def phrase_terms(self, ids: np.ndarray) -> np.ndarray:
        """Which tokens of a document some phrase could hold."""
        kept = self.has(term_codes(ids))
        beside = self.has(pair_codes(ids))
        kept[:-1] |= beside
        kept[1:] |= beside
        return kept

    def single_terms(self, ids: np.ndarray) -> np.ndarray:
        return self.has(term_codes(ids))


def filter_of(items: DataFrame, near: bool) -> Filter:
    """items: text. For phrases: pairs, and the terms of items of one word; for proximity: all terms. Bits are or-ed before they are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = per_worker("words", "", WordHashes)
        for batch in batches:
            found = [np.empty(0, np.uint64)]
            for text in batch.column(0):
                ids = hashes.array(terms(text.as_py()))
                found.append(term_codes(ids) if near or len(ids) == 1 else pair_codes(ids))
            at = np.unique(places(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(as_long(np.uint64(1) << (at & 63).astype(np.uint64)))], ["at", "bit"])

    rows = items.mapInArrow(run, "at long, bit long").groupBy("at").agg(F.expr("bit_or(bit)").alias("bits")).toArrow()
    return Filter(list(zip(rows["at"].to_pylist(), rows["bits"].to_pylist(), strict=True)))


def index(docs: DataFrame, scratch: Scratch, kept_by: Filter, near: bool = False) -> tuple[DataFrame, DataFrame]:
    """docs: doc_id, key, text. Two written tables. Documents: row, doc_id, key, n_words, terms, at (the postings of the document, by place).
    Postings: term, row, at (places, ascending), by term."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(kept_by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, chosen = per_worker("words", "", WordHashes), held.value.single_terms if near else held.value.phrase_terms
        for batch in batches:
            counts, ids, at = [], [], []
            for text in batch.column(3):
                own = hashes.array(terms(text.as_py()))
                kept = np.flatnonzero(chosen(own)) if len(own) else np.empty(0, np.int64)
                counts.append(len(own))
                ids.append(as_long(own[kept]))
                at.append(kept.astype(np.int32))
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in at]))).astype(np.int32))
            flat = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, kind), *x]))) for kind, x in ((np.int64, ids), (np.int32, at))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(counts, pa.int64()), *flat], ["row", "doc_id", "key", "n_words", "terms", "at"])

    own = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "key", "text")
    documents = scratch.keep(own.mapInArrow(run, "row long, doc_id long, key long, n_words long, terms array<long>, at array<int>"))
    spread = documents.select("row", F.inline(F.arrays_zip("terms", "at"))).withColumnRenamed("terms", "term")
    postings = spread.groupBy("term", "row").agg(F.sort_array(F.collect_list("at")).alias("at"))
    # a term that a third of all documents has lies in SLICES partitions
    return documents, scratch.keep(postings.repartition(parts(spark), "term", F.pmod("row", F.lit(SLICES))).sortWithinPartitions("term", "row"))


def anchored(items: DataFrame, postings: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """items: item, name, text. Per item that the index may have: item, name, terms, anchors (places in the item of its windows' rarest
    terms). A window with a term that no document has gets no anchor."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = per_worker("words", "", WordHashes)
        for batch in batches:
            ids = [as_long(hashes.array(terms(x.as_py()))) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int64()))], ["item", "name", "terms"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, name, ids, known in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                count = dict(zip((x["term"] for x in known), (x["n"] for x in known), strict=True))
                n = [count.get(x, 0) for x in ids]
                size = min(window, len(ids))
                best = {min(range(i, i + size), key=lambda k: (n[k], k)) for i in range(len(ids) - size + 1)} if ids else set()
                out.append((item, name, ids, sorted(k for k in best if n[k])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())))], ["item", "name", "terms", "anchors"])

    own = scratch.keep(items.mapInArrow(split, "item long, name string, terms array<long>"))
    wanted = own.select("item", F.explode(F.array_distinct("terms")).alias("term"))
    counts = postings.groupBy("term").agg(F.sum(F.size("at").cast("long")).alias("n"))
    known = wanted.join(counts, "term").groupBy("item").agg(F.collect_list(F.struct("term", "n")).alias("known"))
    chosen = own.join(known, "item").select("item", "name", "terms", "known").mapInArrow(choose, "item long, name string, terms array<long>, anchors array<int>")
    return scratch.keep(chosen.filter(F.size("anchors") > 0))


def phrase_hits(ids: np.ndarray, at: np.ndarray, item: np.ndarray, anchors: list[int], window: int = WINDOW) -> np.ndarray:
    """Places of a document (its kept terms and their places, ascending) that whole windows of an item cover."""
    size, covered = min(window, len(item)), []
    order = np.argsort(ids, kind="stable")
    by_term, starts = ids[order], set()
    for k in anchors:
        low, high = np.searchsorted(by_term, item[k]), np.searchsorted(by_term, item[k], "right")
        starts.update((at[order[low:high]] - k).tolist())
    steps = np.arange(len(item))
    for start in sorted(starts):
        place = start + steps
        found = np.minimum(np.searchsorted(at, place), len(at) - 1)
        same = (at[found] == place) & (ids[found] == item)
        runs = np.concatenate(([0], np.cumsum(same)))
        first = np.flatnonzero(runs[size:] - runs[:-size] == size)
        if len(first):
            covered.append((start + first[:, None] + np.arange(size)).ravel())
    return np.unique(np.concatenate(covered)) if covered else np.empty(0, np.int64)


def near_hits(ids: np.ndarray, at: np.ndarray, item: np.ndarray, span: int, window: int = WINDOW) -> bool:
    """Whether all terms of one of the item's windows lie within `span` words of the window's rarest one."""
    lists = {int(t): at[ids == t] for t in np.unique(item)}
    size = min(window, len(item))
    for i in range(len(item) - size + 1):
        own = sorted({int(t) for t in item[i : i + size]}, key=lambda t: len(lists[t]))
        found = lists[own[0]]
        for t in own[1:]:
            found = found[np.searchsorted(lists[t], found + span, "right") > np.searchsorted(lists[t], found - span)]
        if len(found):
            return True
    return False


def met(documents: DataFrame, postings: DataFrame, items: DataFrame) -> DataFrame:
    """row, ids, at, item, name, terms, anchors: each document with each item that an anchor's list names it for, once."""
    wanted = items.select("item", F.explode(F.array_distinct(F.transform("anchors", lambda k: F.element_at("terms", k + 1)))).alias("term"))
    pairs = postings.select("term", "row").join(wanted, "term").select("row", "item").distinct()
    return pairs.join(documents.select("row", F.col("terms").alias("ids"), "at"), "row").join(items, "item").select("row", "ids", "at", "item", "name", "terms", "anchors")


def prepared(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame]:
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    items = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).cast("string").alias("name"), F.col(item_text_col).alias("text"))
    return own, items


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables. Documents: row, doc_id, key (of the text), n_words. Hits: row, name (of an item), places (array of word positions)."""
    scratch = Scratch(docs.sparkSession, "leaks")
    own, items = prepared(docs, benchmark, id_col, text_col, item_col, item_text_col)
    documents, postings = index(own, scratch, filter_of(items.select("text"), False))
    chosen = anchored(items, postings, scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, names, hits = [], [], []
            for row, ids, at, name, item, anchors in zip(*(batch.column(i) for i in (0, 1, 2, 4, 5, 6)), strict=True):
                found = phrase_hits(*(x.values.to_numpy(zero_copy_only=False) for x in (ids, at, item)), anchors.as_py())
                if len(found):
                    rows.append(row.as_py())
                    names.append(name.as_py())
                    hits.append(found.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(names, pa.string()), pa.array(hits, pa.list_(pa.int32()))], ["row", "name", "places"])

    hits = scratch.keep(met(documents, postings, chosen).mapInArrow(run, "row long, name string, places array<int>"))
    scratch.drop(postings, chosen)
    return documents.select("row", "doc_id", "key", "n_words"), hits


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    documents, hits = find_hits(docs, benchmark, id_col, text_col, item_col, item_text_col)
    words = hits.select("row", F.explode("places").alias("at")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    # one row for each item that a document has
    named = hits.select("row", "name").distinct().groupBy("row").agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list("name")).alias("names"))
    joined = documents.join(words.join(named, "row"), "row", "left")
    n_items = F.coalesce("n_items", F.lit(0)).cast("long")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), n_items.alias("n_items"),
        F.coalesce(F.sha2(F.array_join("names", ","), 256), F.lit(NOTHING)).alias("items_sha256"), (n_items >= LEAST_ITEMS).alias("contaminated"),
    )


def find_near(docs: DataFrame, benchmark: DataFrame, span: int, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Proximity matches: doc_id and item_id where all terms of one of the item's windows lie within `span` words of the one that the document
    has least of."""
    scratch = Scratch(docs.sparkSession, "near")
    own, items = prepared(docs, benchmark, id_col, text_col, item_col, item_text_col)
    documents, postings = index(own, scratch, filter_of(items.select("text"), True), True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [near_hits(*(x.values.to_numpy(zero_copy_only=False) for x in row), span) for row in zip(*(batch.column(i) for i in (1, 2, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4)], ["row", "item_id"]).filter(pa.array(found, pa.bool_()))

    hits = met(documents, postings, anchored(items, postings, scratch)).mapInArrow(run, "row long, item_id string").distinct()
    return hits.join(documents, "row").select("doc_id", "item_id")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that are not contaminated."""
    documents, hits = find_hits(docs, benchmark)
    doc, key = unused(docs.columns, "leaked_doc", "leaked_key")
    several = hits.select("row", "name").distinct().groupBy("row").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_ITEMS)
    # equal texts of one id have equal verdicts
    gone = documents.join(several, "row").select(F.col("doc_id").alias(doc), F.col("key").alias(key)).distinct()
    gone = Scratch(docs.sparkSession, "leaked").keep(gone)
    return without(docs, gone, docs["doc_id"].cast("long").eqNullSafe(gone[doc]) & (F.xxhash64(docs["text"]) == gone[key]))


def query(spark, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(len(w), 8) AS k, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)
), hit AS (
  SELECT doc_id, i, k, item FROM dw JOIN bw USING (k, g)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""
