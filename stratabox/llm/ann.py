"""Nearest vectors by multiprobe p-stable hashing.

Largest inner product becomes nearest point once each vector gets one more component that brings it to the largest norm
(and queries a zero). Vectors are parted by norm, BANDS ranges to a doubling, each with tables and a largest norm of its own, so that
a few long vectors do not blur the rest. A table hashes by FUNCTIONS-many floor((a.x + b) / w) with Gaussian a; a query visits the buckets of
perturbed hashes in the order of their estimated chance to hold a near vector, until the chances add up to TARGET. Where the
MOST_PROBES likeliest do not add up to it, the query goes by fewer hashes, whose buckets are wider, so TARGET is reached at any row count.
Candidates of all tables are merged and ranked by the exact inner product of the original vectors in double precision.

Each table's buckets are dealt by their first hashes into cells of some CELL_ROWS rows, and a cell with more rows (copies of one vector
share all hashes) is cut further by id, so no bucket is capped and none meets in one task. A query first goes
to its likeliest cell of each table; its TOP-th best score there is a floor for all others, from which only candidates that reach
it come back.

The number of hashes follows the logarithm of a range's row count. How alike a query's near vectors are is estimated for each query and
range by its scores on a bounded sample (SAMPLE_ROWS); it steers how many buckets are visited. A range is left out only where its
largest norm can't reach TOP scores of the sample. Queries that found fewer than TOP visit all cells. Every row is indexed.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another
length than most; rows that repeat an id are candidates, and queries, each; a null id takes no part; ties go to the smaller id; with
fewer candidates than TOP all are returned; products beyond the doubles are infinite; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, parts, table
from .jaccard import sorted_groups

TOP = 20
TABLES = 4
BANDS = 4  # norm ranges to a doubling
WIDTH = 1.35
SLOTS = 8  # values of one hash; projections beyond them fall into the outer ones
BITS = 1.6  # that one hash tells, about
BUCKET_ROWS = 64
CELL_ROWS = 8192
TARGET = 0.52  # estimated success of the visited buckets of one table
MOST_PROBES = 4096  # buckets of one query and table; wider ones where these do not reach TARGET
SAMPLE_ROWS = 4096
SLACK = 1e-5  # of single-precision scores against exact ones
SCHEMA = "query_id long, rank int, vec_id long, score double"


def norms(x: np.ndarray) -> np.ndarray:
    most = np.abs(x).max(1)
    most[most == 0] = 1
    return most * np.sqrt(((x / most[:, None]) ** 2).sum(1))


class Tables:
    """The hash functions of all tables of a norm range. Small: TABLES x functions x dimensions numbers."""

    def __init__(self, dims: int, rows: int, norm: float, tables: int = TABLES, target: float = TARGET, seed: int = 11):
        self.k = max(1, round(math.log2(max(2.0, rows / BUCKET_ROWS)) / BITS))
        self.cell = min(self.k, max(0, round(math.log2(max(1.0, rows / CELL_ROWS)) / BITS)))
        rng = np.random.default_rng(seed)
        self.a = rng.standard_normal((tables, self.k, dims + 1))
        self.b = rng.uniform(0, WIDTH, (tables, self.k))
        self.norm, self.tables, self.target = norm, tables, target

    def lifted(self, x: np.ndarray, queries: bool) -> np.ndarray:
        own = norms(x)
        if queries:
            return np.concatenate([x / own[:, None], np.zeros((len(x), 1))], 1)
        return np.concatenate([x / self.norm, np.sqrt(np.maximum(0, 1 - (own / self.norm) ** 2))[:, None]], 1)

    def hashes(self, lifted: np.ndarray, t: int) -> np.ndarray:
        return np.clip(np.floor((lifted @ self.a[t].T + self.b[t]) / WIDTH) + SLOTS // 2, 0, SLOTS - 1).astype(np.int64)

    def codes(self, lifted: np.ndarray, t: int) -> np.ndarray:
        out = np.zeros(len(lifted), np.int64)
        for i, h in enumerate(self.hashes(lifted, t).T):
            out = out * SLOTS + h
        return out

    def cell_of(self, codes: np.ndarray) -> np.ndarray:
        return codes // SLOTS ** (self.k - self.cell)

    def probes(self, lifted: np.ndarray, t: int, alike: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """For each query the buckets to visit, likeliest first: their first codes, and how many codes each of them spans.
        alike: the cosine of each query and its near vectors, as lifted."""
        at = lifted @ self.a[t].T  # (queries, k)
        edges = (np.arange(1, SLOTS) - SLOTS // 2) * WIDTH
        # a near vector's projection: normal about alike * at
        lows = (edges - self.b[t][:, None])[None] - (alike[:, None] * at)[:, :, None]
        below = normal(lows / np.sqrt(np.maximum(1e-6, 1 - alike**2))[:, None, None])
        chance = np.diff(np.concatenate([np.zeros_like(below[:, :, :1]), below, np.ones_like(below[:, :, :1])], 2), axis=2)
        out: list = [None] * len(at)

        def settle(who: np.ndarray, weight: np.ndarray, code: np.ndarray, span: int) -> None:
            count = np.minimum((np.cumsum(weight, 1) < self.target).sum(1) + 1, code.shape[1])
            for q, row, n in zip(who.tolist(), code, count.tolist(), strict=True):
                out[q] = (row[:n] * span, span)

        who, weight, code = np.arange(len(at)), np.ones((len(at), 1)), np.zeros((len(at), 1), np.int64)
        for i in range(self.k):
            if not len(who):
                break
            finer = (weight[:, :, None] * chance[who, i, None, :]).reshape(len(who), -1)
            codes = (code[:, :, None] * SLOTS + np.arange(SLOTS)).reshape(len(who), -1)
            keep = np.argsort(-finer, axis=1, kind="stable")[:, :MOST_PROBES]
            finer, codes = np.take_along_axis(finer, keep, 1), np.take_along_axis(codes, keep, 1)
            short = finer.sum(1) < self.target
            settle(who[short], weight[short], code[short], SLOTS ** (self.k - i))
            who, weight, code = who[~short], finer[~short], codes[~short]
        if len(who):
            settle(who, weight, code, 1)
        return out

    def asks(self, codes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """A query's buckets by cell: cells, first codes in order of cells, where each cell's begin (and the end), and their span."""
        whole = SLOTS ** (self.k - self.cell)
        if span > whole:  # a bucket of many cells
            codes, span = (codes[:, None] + np.arange(0, span, whole)).ravel(), whole
        cell = self.cell_of(codes)
        order = np.argsort(cell, kind="stable")
        cells, begins = np.unique(cell[order], return_index=True)
        return cells, codes[order], np.append(begins, len(codes)), span


class Sample:
    """Some vectors, on which each query's scores are foretold."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, rows: int, top: int):
        self.ids, self.x, self.top = ids, x, top
        self.rank = max(1, round(top * len(x) / max(rows, 1)))

    def foretold(self, ids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each query, about the score of its last near vector, and a score that `top` others reach."""
        with np.errstate(over="ignore", invalid="ignore"):
            scores = np.nan_to_num(q @ self.x.T, nan=0.0, posinf=np.inf, neginf=-np.inf)
        scores[ids[:, None] == self.ids[None, :]] = -np.inf
        scores = -np.sort(-scores, axis=1)
        last = scores[:, min(self.rank, scores.shape[1]) - 1]
        return last, scores[:, self.top - 1] if scores.shape[1] >= self.top else np.full(len(q), -np.inf)


def normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, to about 1e-7 (a rational fit would do; chances only order buckets)."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    tail = np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(x > 0, 1 - tail, tail)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products by rows, added in the order of components, so that equal vectors get equal scores."""
    out = np.zeros(len(x))
    with np.errstate(over="ignore", invalid="ignore"):
        for d in range(x.shape[1]):
            out += q[:, d] * x[:, d]
    return out


def best_of_cell(rows: np.ndarray, names: np.ndarray, codes: np.ndarray, x: np.ndarray, queries: np.ndarray, lists: list[np.ndarray], spans: np.ndarray, q: np.ndarray, floors: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score): each query's best among the vectors (rows, with their ids as names) of the buckets that it visits.

    What can't be among them is told by single-precision cosines against the cell's longest vector, whose error does not depend on
    lengths; what is left is scored exactly.
    """
    order = np.argsort(codes, kind="stable")
    rows, names, codes, x = rows[order], names[order], codes[order], x[order]
    longest, lengths = norms(x).max(), norms(q)
    small = (x / longest).astype(np.float32)
    # below a floor's cosine nothing counts; divided step by step, for the product of two lengths may be too large for a double
    lowest = np.where(np.isfinite(floors), floors / lengths / longest, -np.inf)
    out_q, out_r, out_n, out_s = [], [], [], []
    for low in range(0, len(queries), 512):
        own = q[low : low + 512]
        scores = np.full((len(own), len(rows)), -np.inf, np.float32)
        asked = np.concatenate(lists[low : low + 512])
        who = np.repeat(np.arange(len(own)), [len(v) for v in lists[low : low + 512]])
        starts, ends = np.searchsorted(codes, asked), np.searchsorted(codes, asked + spans[low : low + 512][who])
        real = starts < ends
        starts, ends, who = starts[real], ends[real], who[real]
        by = np.lexsort((ends, starts))
        starts, ends, who = starts[by], ends[by], who[by]
        own_small = (own / lengths[low : low + 512, None]).astype(np.float32)
        begins = np.flatnonzero(np.concatenate(([True], (starts[1:] != starts[:-1]) | (ends[1:] != ends[:-1])))) if len(who) else np.empty(0, np.int64)
        for s, e in zip(begins, np.append(begins, len(who))[1:], strict=True):
            asking = who[s:e]
            scores[asking, starts[s] : ends[s]] = own_small[asking] @ small[starts[s] : ends[s]].T
        scores[rows[None, :] == queries[low : low + 512, None]] = -np.inf
        k = min(top, len(rows))
        least = np.partition(scores, len(rows) - k, axis=1)[:, len(rows) - k]
        least = np.maximum(least, lowest[low : low + 512])
        found, cols = np.nonzero((scores >= (least - SLACK)[:, None]) & np.isfinite(scores))
        for a in range(0, len(found), 1 << 18):
            r, c = found[a : a + (1 << 18)], cols[a : a + (1 << 18)]
            out_q.append(queries[low + r])
            out_r.append(rows[c])
            out_n.append(names[c])
            out_s.append(exact(own[r], x[c]))
    if not out_q:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    found_q, found_r, found_n, found_s = map(np.concatenate, (out_q, out_r, out_n, out_s))
    order = np.lexsort((found_r, found_n, -found_s, found_q))
    found_q, found_r, found_s = found_q[order], found_r[order], found_s[order]
    first = np.concatenate(([True], found_q[1:] != found_q[:-1]))
    place = np.arange(len(found_q)) - np.maximum.accumulate(np.where(first, np.arange(len(found_q)), 0))
    floor_of = dict(zip(queries.tolist(), floors.tolist(), strict=True))
    kept = (place < top) & (found_s >= np.array([floor_of[i] for i in found_q.tolist()]))
    return found_q[kept], found_r[kept], found_s[kept]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """row (a number for each row), vec_id, v."""
    own = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return own.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, is_query, top: int = TOP, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = TABLES, target: float = TARGET) -> DataFrame:
    """Per query (rows where is_query(id column) holds) its `top` nearest others found: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "nearest")
    own = scratch.keep(usable(vectors, id_col, vec_col))
    sizes = own.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], SCHEMA)
    dims, n = sizes[0]["dims"], sizes[0]["n"]
    most = F.array_max(F.transform("v", F.abs))
    own = own.filter(F.size("v") == dims).withColumn("most", most)
    own = own.withColumn("norm", F.col("most") * F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / F.col("most")) * (x / F.col("most")))))
    # shifted, so that no range ends at a norm of 1
    own = scratch.keep(own.withColumn("band", F.floor(F.log2("norm") * BANDS + 0.37)).select("row", "vec_id", "v", "norm", "band"))
    bands = own.groupBy("band").agg(F.count("*").alias("n"), F.max("norm").alias("norm")).orderBy("band").collect()
    sample = own.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(SAMPLE_ROWS).select("row", "v").toPandas()
    made = {r["band"]: (i * tables, Tables(dims, r["n"], r["norm"], tables, target)) for i, r in enumerate(bands)}
    held = spark.sparkContext.broadcast((made, Sample(sample["row"].to_numpy(), np.stack(sample["v"].to_numpy()), n, top)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            of_row = whole.column(3).to_numpy()
            for band in np.unique(of_row).tolist():
                batch = whole.take(pa.array(np.flatnonzero(of_row == band)))
                first, own = held.value[0][band]
                lifted = own.lifted(matrix(batch.column(2), dims), False)
                for t in range(own.tables):
                    codes = own.codes(lifted, t)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), first + t, np.int32)), pa.array(own.cell_of(codes)), *(batch.column(i) for i in range(3)), pa.array(codes)], ["t", "cell", "id", "name", "v", "code"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, sample = held.value
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                q = matrix(batch.column(1), dims)
                last, reached = sample.foretold(batch.column(0).to_numpy(), q)
                lengths = norms(q)
                for first, own in made.values():
                    most = lengths * own.norm
                    asked = np.flatnonzero(most * (1 + 1e-9) >= reached)
                    if not len(asked):
                        continue
                    lifted = own.lifted(q[asked], True)
                    alike = np.clip(last[asked] / most[asked], 0.05, 0.98)
                    for t in range(own.tables):
                        for k, found in zip(asked.tolist(), own.probes(lifted, t, alike), strict=True):
                            cells, codes, begins, span = own.asks(*found)
                            take = pa.array(np.full(len(cells), k))
                            lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(codes))
                            likeliest = cells == own.cell_of(found[0][0])
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), first + t, np.int32)), pa.array(cells), batch.column(0).take(take), batch.column(1).take(take), lists, pa.array(np.full(len(cells), span)), pa.array(likeliest)], ["t", "cell", "id", "v", "probes", "span", "likeliest"])

    def rank_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_groups(batches, 3):
            data = [r for r in rows if r[6] is None]
            asks = [r for r in rows if r[6] is not None]
            if data and asks:
                found = best_of_cell(
                    np.array([r[3] for r in data]), np.array([r[9] for r in data]), np.array([r[5] for r in data]), np.array([r[4] for r in data]),
                    np.array([r[3] for r in asks]), [np.array(r[6]) for r in asks], np.array([r[8] for r in asks]), np.array([r[4] for r in asks]), np.array([r[7] for r in asks]), top,
                )
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["asked", "found", "score"])

    data = own.select("row", "vec_id", "v", "band").mapInArrow(index, "t int, cell long, id long, name long, v array<double>, code long")
    queries = own.filter(is_query(F.col("vec_id"))).select("row", "v")
    asks = queries.mapInArrow(probe, "t int, cell long, id long, v array<double>, probes array<long>, span long, likeliest boolean")
    cells = data.groupBy("t", "cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("cuts"))
    # a table of cells has about one row for CELL_ROWS vectors
    data = data.join(cells, ["t", "cell"]).select("t", "cell", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int").alias("cut"), "id", "v", "code", F.lit(None).cast("array<long>").alias("probes"), F.lit(None).cast("double").alias("floor"), F.lit(None).cast("long").alias("span"), "name")
    data = scratch.keep(data)
    asks = scratch.keep(asks.join(cells, ["t", "cell"]).select("t", "cell", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), "id", "v", F.lit(0).cast("long").alias("code"), "probes", "span", F.lit(None).cast("long").alias("name"), "likeliest"))

    def ranked(asked: DataFrame) -> DataFrame:
        """asked: asks with floor."""
        used = data.join(asked.select("t", "cell").distinct(), ["t", "cell"], "left_semi")
        both = used.unionByName(asked.select(*data.columns)).repartition(parts(spark), "t", "cell", "cut").sortWithinPartitions("t", "cell", "cut")
        return both.mapInArrow(rank_cells, "asked long, found long, score double")

    near = scratch.keep(ranked(asks.filter("likeliest").withColumn("floor", F.lit(float("-inf")))).dropDuplicates(["asked", "found"]))
    place = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score")))
    floors = near.withColumn("place", place).filter(F.col("place") == top).select(F.col("asked").alias("id"), F.col("score").alias("floor"))
    rest = asks.filter("not likeliest").join(floors, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    found = scratch.keep(near.unionByName(ranked(rest)).dropDuplicates(["asked", "found"]))
    full = found.groupBy("asked").agg(F.count("*").alias("n")).filter(F.col("n") >= min(top, n - 1))
    short = queries.join(full, queries["row"] == full["asked"], "left_anti")
    if not short.isEmpty():
        # each vector is in the first table of its range
        every = cells.filter(F.col("t") % tables == 0).select("t", "cell", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"))
        # queries without TOP scores so far go through every cell: a stated set of queries against all rows
        wide = short.select(F.col("row").alias("id"), "v").crossJoin(every)
        wide = wide.select("t", "cell", "cut", "id", "v", F.lit(0).cast("long").alias("code"), F.array(F.lit(0).cast("long")).alias("probes"), F.lit(float("-inf")).alias("floor"), F.lit(1 << 62).cast("long").alias("span"), F.lit(None).cast("long").alias("name"))
        found = found.unionByName(ranked(wide)).dropDuplicates(["asked", "found"])
    ids = own.select("row", "vec_id")
    named = found.join(ids.select(F.col("row").alias("found"), "vec_id"), "found").join(ids.select(F.col("row").alias("asked"), F.col("vec_id").alias("query_id")), "asked")
    order = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id", "found"))
    return named.withColumn("rank", order).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
