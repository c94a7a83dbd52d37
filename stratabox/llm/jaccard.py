"""N-gram Jaccard join by a count-vector R-tree.

A document is its set of five-word shingles. Shingles are hashed to GROUPS groups; the counts by group are a point. Two
sets can't share more than the sum of their points' coordinate minima, nor a set more with any set below a tree
node than with the node's coordinate maxima; what passes that bound is verified on the sets themselves.

How the trees are spread. Sets that are equal are one node of the graph. The rest meet by prefix: in one order of all
shingles, linked sets of n and m have at least l shingles in common among the first n - ceil(0.8 n) + l and m - ceil(0.8 m) + l
of each. Nodes with fewer shared prefix shingles than that link to nothing and go. The order puts shingles of shared passages at the
end: those that several different sets among each WINDOW_SHINGLES shingles have, looked for in all documents. Any order is right; this
one keeps passages out of the prefixes, those in d documents nearly surely once d exceeds twice the square root of the number of windows.

1. Nodes whose points pass the bound are tied: each with the smallest nodes of its buckets, then, where a bucket still holds several
   such families, by trees over the bucket's points. What is linked is in one family.
2. A family of bounded size is one tree over its sets in one task. In larger families each node is put with the smallest node of the
   bucket that it shares most with; such groups are cut into chunks, each gets a tree, and pairs between the components found are
   searched bucket by bucket again.

Large buckets are cut into bands of set size and chunks, so no bucket, however large, meets in one task.

Since a component is what is asked for, links inside a component need not be listed; every pair between components is bounded or
verified, so none is lost.

Defined results: a null or empty text, or one without words, has no shingles and is its own component; rows with a null id are
returned with a null component and link to nothing; rows that repeat an id are one document (their sets count together); rows that
repeat are each returned; ties don't arise; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, as_long, by_few, parts, per_worker, table, unused, windows, without, words_of
from .graph import components

SHINGLE = 5
GROUPS = 256
WINDOW_SHINGLES = 4_000_000  # among which a task looks for repeated ones at a time
MOST_SHARED = 1_000_000  # repeated shingles that go to the end of the order: the most frequent ones (8 bytes of broadcast each)
CHUNK_DOCS, CHUNK_SHINGLES = 200, 1_000_000
CHUNK_ROWS = 1_000
FAMILY_DOCS, FAMILY_SHINGLES = 20_000, 4_000_000
FINE = 512  # groups of the second bound, next to the sets themselves
LEAF = 16


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The set of a text, as ascending hashes."""
    words = words_of(text, lower=True)
    return np.unique(windows(hashes.array(words), min(SHINGLE, len(words)))) if words else np.empty(0, np.uint64)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 80 * union."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 80 * (len(a) + len(b) - both)


def point(found: np.ndarray) -> np.ndarray:
    return np.bincount((found % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS).astype(np.int32)


def packed_point(found: np.ndarray) -> bytes:
    """A byte for each group; 255 stands for any larger count."""
    return np.minimum(point(found), 255).astype(np.uint8).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    """Upper bounds of the counts."""
    out = np.frombuffer(raw, np.uint8).astype(np.int32)
    out[out == 255] = 1 << 24
    return out


def prefix_extra(n: int) -> int:
    """How many shared prefix shingles linked sets have at least, if both are of size n or more."""
    return 1 + n // 14


def least_shared(n: np.ndarray | int, m: np.ndarray | int):
    """The fewest common shingles of linked sets of n and m: ceil(0.8 / 1.8 (n + m))."""
    return -(-4 * (n + m) // 9)


class CountTree:
    """An R-tree over count vectors, packed by set size and then by the coordinates' spread. Nodes hold coordinate maxima and
    the range of sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        wide = int(points.var(0).argmax()) if len(points) else 0
        self.order = np.lexsort((points[:, wide], sizes))
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(points[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > 1:
            high, low_size, high_size = self.levels[-1]
            cuts = np.arange(0, len(high), LEAF)
            self.levels.append((np.maximum.reduceat(high, cuts), np.minimum.reduceat(low_size, cuts), np.maximum.reduceat(high_size, cuts)))

    def search(self, own: np.ndarray, n: int) -> np.ndarray:
        """Numbers of the points that may be linked with (own, n)."""
        at = np.arange(len(self.levels[-1][0]))
        for level in range(len(self.levels) - 1, -1, -1):
            high, low_size, high_size = (x[at] for x in self.levels[level])
            bound = np.minimum(high, own).sum(1)
            least = least_shared(n, np.maximum(low_size, -(-4 * n // 5)))
            at = at[(5 * high_size >= 4 * n) & (4 * low_size <= 5 * n) & (bound >= least)]
            if level:
                at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                at = at[at < len(self.levels[level - 1][0])]
        return self.order[at]


def survey(shared):
    """Per row: its set's size, digest, prefix and point. shared: broadcast, the shingles at the end of the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, hot = per_worker("words", "", WordHashes), shared.value
        for batch in batches:
            sizes, prints, keys, points = [], [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py(), hashes)
                n = len(found)
                sizes.append(n)
                prints.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                if n and len(hot):
                    often = hot[np.minimum(np.searchsorted(hot, found), len(hot) - 1)] == found
                    ordered = np.concatenate([found[~often], found[often]])
                else:
                    ordered = found
                keys.append(as_long(ordered[: n + (4 * n) // -5 + prefix_extra(n) if n else 0]))
                points.append(packed_point(found))
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in keys]))).astype(np.int32)
            flat = pa.array(np.concatenate([np.empty(0, np.int64), *keys]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(points, pa.binary())],
                ["doc_id", "n", "print", "keys", "point"],
            )

    return run


def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows: text. Shingles that several different sets of one window have, and how many do."""
    hashes = per_worker("words", "", WordHashes)
    held: list[np.ndarray] = []
    known: set[bytes] = set()

    def found() -> pa.RecordBatch:
        flat = np.sort(np.concatenate([np.empty(0, np.uint64), *held]))
        held.clear()
        known.clear()
        starts = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))[: len(flat)]
        counts = np.diff(np.append(starts, len(flat)))
        return pa.RecordBatch.from_arrays([pa.array(as_long(flat[starts[counts > 1]])), pa.array(counts[counts > 1])], ["key", "n"])

    size = 0
    for batch in batches:
        for text in batch.column(0):
            own = shingles(text.as_py(), hashes)
            digest = hashlib.blake2b(own.tobytes(), digest_size=8).digest()
            if digest not in known:  # copies say nothing about passages
                known.add(digest)
                held.append(own)
                size += len(own)
                if size >= WINDOW_SHINGLES:
                    yield found()
                    size = 0
    yield found()


def shared_shingles(own: DataFrame, most: int = MOST_SHARED) -> np.ndarray:
    """The most frequent repeated shingles of all documents, at most `most`, ascending. They steer the order only."""
    often = own.select("text").mapInArrow(repeated, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    keys = often.orderBy(F.desc("n"), "key").limit(most).select("key").toArrow().column(0).to_numpy()
    return np.sort(keys.view(np.uint64))


def sorted_groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[list[tuple]]:
    """Runs of rows that agree in the first `by` columns, of rows that come sorted by them."""
    held, last = [], None
    for batch in batches:
        for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if row[:by] != last:
                if held:
                    yield held
                held, last = [], row[:by]
            held.append(row)
    if held:
        yield held


def unite(ids: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join what is linked among these sets: not all of them, but enough for the same components.

    Components are grown one by one, and what has joined one leaves the tree: a set is looked for among those alone that nothing has
    reached yet, so a group of near copies costs one search over all of it, not one for each copy.
    """
    points = np.stack([point(s) for s in sets])
    fine = np.stack([np.bincount((s >> np.uint64(32)).astype(np.int64) % FINE, minlength=FINE) for s in sets]).astype(np.int32)
    sizes = np.array([len(s) for s in sets])
    left = np.ones(len(ids), bool)
    of_id: dict[int, list[int]] = {}
    for k, i in enumerate(ids):
        of_id.setdefault(i, []).append(k)
    in_tree, out = np.arange(len(ids)), []
    tree, gone = CountTree(points, sizes), 0
    for first in range(len(ids)):
        if not left[first]:
            continue
        left[first] = False
        gone += 1
        grown = [first]
        while grown:
            i = grown.pop()
            if 2 * gone > len(in_tree):
                in_tree, gone = in_tree[left[in_tree]], 0
                tree = CountTree(points[in_tree], sizes[in_tree]) if len(in_tree) else None
            near = in_tree[tree.search(points[i], int(sizes[i]))] if tree else in_tree
            near = near[left[near]]
            near = near[np.minimum(fine[near], fine[i]).sum(1) >= least_shared(int(sizes[i]), sizes[near])]
            joins = [j for j in near.tolist() if linked(sets[i], sets[j])]
            for j in joins + [j for j in of_id[ids[i]] if left[j]]:  # an id may stand for several sets
                if left[j]:
                    left[j] = False
                    gone += 1
                    grown.append(j)
                    out.append((ids[i], ids[j]))
    return out


def verify(groups: DataFrame, docs: DataFrame) -> DataFrame:
    """groups: head, chunk, node. Links (a, b) within each (head, chunk), by trees over the texts' sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, found = per_worker("words", "", WordHashes), []
        for rows in sorted_groups(batches, 2):
            found += unite([r[2] for r in rows], [shingles(r[3], hashes) for r in rows])
            if len(found) > 10_000:
                yield links(found)
                found = []
        yield links(found)

    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").alias("node"), "text")
    rows = by_few(texts, groups, "node").select("head", "chunk", "node", "text")
    return rows.repartition(parts(spark), "head", "chunk").sortWithinPartitions("head", "chunk", "node").mapInArrow(run, "a long, b long")


def links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])


def chunked(members: DataFrame) -> DataFrame:
    """members: head, node, n. Adds chunks of bounded size, with the head in each."""
    sizes = members.groupBy("head").agg(F.ceil(F.greatest(F.count("*") / CHUNK_DOCS, F.sum("n") / CHUNK_SHINGLES)).cast("int").alias("chunks"))
    dealt = members.join(sizes, "head").select("head", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"), "node")
    return dealt.unionByName(sizes.select("head", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("head").alias("node")))


def near_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows: head, node, n, c, head_n, point, head_point. Those that pass the bound."""
    for batch in batches:
        n, m = (batch.column(i).to_numpy() for i in (2, 4))
        if batch.num_rows:
            a, b = (np.stack([unpacked(x) for x in batch.column(i).to_pylist()]) for i in (5, 6))
            kept = (np.minimum(a, b).sum(1) >= least_shared(n, m)) & (5 * n >= 4 * m) & (5 * m >= 4 * n)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(4)], ["head", "node", "n", "c"]).filter(pa.array(kept))


def between(spanning: bool):
    """Rows: key, band, chunk, home, node, component, n, point. Pairs of a home and another row (where home is null, a row is both), of
    different components, that pass the tree's bound; spanning: only as many as join what they would join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        for rows in sorted_groups(batches, 3):
            homes = [r for r in rows if r[3] is not False]
            others = [r for r in rows if r[3] is not True]
            if not homes or not others:
                continue
            up = {r[5]: r[5] for r in rows}

            def root(x: int, up: dict[int, int] = up) -> int:
                while up[x] != x:
                    x = up[x]
                return x

            points, sizes = np.stack([unpacked(r[7]) for r in others]), np.array([r[6] for r in others])
            tree = CountTree(points, sizes) if len(others) > 4 * LEAF else None
            for home in homes:
                own, n = unpacked(home[7]), home[6]
                if tree is None:
                    at = np.flatnonzero((np.minimum(points, own).sum(1) >= least_shared(n, sizes)) & (5 * sizes >= 4 * n) & (4 * sizes <= 5 * n))
                else:
                    at = tree.search(own, n)
                for j in at.tolist():
                    other = others[j]
                    if other[5] == home[5]:
                        continue
                    if spanning:
                        a, b = root(home[5]), root(other[5])
                        if a == b:
                            continue
                        up[max(a, b)] = min(a, b)
                    found.add((max(home[4], other[4]), min(home[4], other[4])))
            if len(found) > 50_000:
                yield links(sorted(found))
                found = set()
        yield links(sorted(found))

    return run


def cross_pairs(buckets: DataFrame, labels: DataFrame, points: DataFrame, scratch: Scratch, spanning: bool) -> DataFrame:
    """buckets: key, node, n. Candidate pairs (a, b) between components, from buckets that hold several."""
    spark = buckets.sparkSession
    rows = scratch.keep(buckets.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")))
    counts = rows.groupBy("key", "component").agg(F.count("*").alias("c"))
    keys = counts.groupBy("key").agg(F.max_by("component", "c").alias("main"), F.count("*").alias("several"), F.sum("c").alias("rows")).filter("several > 1").drop("several")
    every, rows = rows, scratch.keep(rows.join(keys, "key").join(points, ["node", "n"]))
    scratch.drop(every)
    columns = ["key", "band", "chunk", "home", "node", "component", "n", "point"]
    # pairs inside a bucket's main component need no look
    both_kinds = F.when(F.col("component") == F.col("main"), F.lit(False))
    few = rows.filter(F.col("rows") <= CHUNK_ROWS).withColumns({"band": F.lit(0), "chunk": F.lit(0), "home": both_kinds}).select(*columns)
    many = rows.filter(F.col("rows") > CHUNK_ROWS).withColumn("band", F.floor(F.log("n") / F.log(F.lit(1.25))).cast("int"))
    # linked sets are at most one band apart, two with rounding
    homes = many.filter("component <> main").withColumn("band", F.explode(F.array(*(F.col("band") + d for d in (-2, -1, 0, 1, 2)))))
    chunks = many.groupBy("key", "band").agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("chunks"))
    guests = many.join(chunks, ["key", "band"]).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("home", F.lit(False))
    homes = homes.join(chunks, ["key", "band"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("home", F.lit(True))
    both = few.unionByName(guests.select(*columns)).unionByName(homes.select(*columns))
    both = both.repartition(parts(spark), "key", "band", "chunk").sortWithinPartitions("key", "band", "chunk")
    pairs = scratch.keep(both.mapInArrow(between(spanning), "a long, b long").distinct())
    scratch.drop(rows)
    return pairs


def shared_prefixes(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """key, node, n: prefix shingles that several nodes have, of nodes with enough of them to link to anything."""
    spark = nodes.sparkSession
    # one shuffle serves the count and the join; a shingle is in at most one row of each node, so no key is hot among all
    spread = nodes.select("node", "n", F.explode("keys").alias("key")).repartition(parts(spark), "key")
    several = spread.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x < y").select("key")
    shared = spread.join(several.hint("shuffle_hash"), "key", "left_semi")
    least = 1 + F.floor(F.ceil(F.col("n") * 4 / 5) / 14)
    lists = scratch.keep(shared.groupBy("node", "n").agg(F.collect_list("key").alias("keys")).filter(F.size("keys") >= least))
    return lists.select("node", "n", F.explode("keys").alias("key"))


def join_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_shared: int = MOST_SHARED) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = spark.sparkContext.broadcast(shared_shingles(own, most_shared))
    known = scratch.keep(own.mapInArrow(survey(shared), "doc_id long, n long, print binary, keys array<long>, point binary"))
    sets = known.filter("n > 0 and doc_id is not null")
    nodes_of = scratch.keep(sets.groupBy("print").agg(F.min("doc_id").alias("node")))
    copies = sets.select("doc_id", "print").join(nodes_of, "print").filter("doc_id <> node").select("doc_id", "node", "print")
    copies = scratch.keep(copies)
    nodes = without(sets, copies.select("doc_id", "print"), ["doc_id", "print"]).withColumnRenamed("doc_id", "node")
    nodes = nodes.select("node", "n", "point", "keys")
    # ids that stand for several sets tie them
    twice = copies.select(F.col("doc_id").alias("a"), F.col("node").alias("b")).join(nodes.select(F.col("node").alias("a")), "a", "left_semi")
    spread = scratch.keep(shared_prefixes(nodes, scratch))
    # buckets of the same nodes (a passage gives one for each of its shingles) are told by 128 bits and looked into once
    alike = [F.bit_xor(F.xxhash64("node", "n")).alias("x"), F.bit_xor(F.xxhash64("n", "node", F.lit("y"))).alias("y")]
    kinds = spread.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last"), F.count("*").alias("size"), *alike).filter("head < last")
    kinds = kinds.groupBy("head", "last", "size", "x", "y").agg(F.min("key").alias("key"), F.count("*").alias("times"))
    buckets = scratch.keep(spread.join(kinds.select("key", "head", "times"), "key"))
    scratch.drop(spread)
    counted = scratch.keep(buckets.filter("node <> head").groupBy("node", "n", "head").agg(F.sum("times").alias("c")))
    names = scratch.keep(buckets.select("node").distinct())
    points = scratch.keep(by_few(nodes, names, "node", "left_semi").select("node", "n", "point"))
    headed = counted.join(points, ["node", "n"]).join(points.select(F.col("node").alias("head"), F.col("n").alias("head_n"), F.col("point").alias("head_point")), "head")
    headed = headed.select("head", "node", "n", "c", "head_n", "point", "head_point").mapInArrow(near_heads, "head long, node long, n long, c long")
    close = scratch.keep(headed.groupBy("head", "node").agg(F.max("n").alias("n"), F.max("c").alias("c")))
    scratch.drop(counted)
    ties = close.select(F.col("node").alias("a"), F.col("head").alias("b"))
    more = cross_pairs(buckets.drop("head", "times"), components(ties, scratch), points, scratch, spanning=True)
    family = components(ties.unionByName(more), scratch).withColumnRenamed("component", "family")
    points = points.join(family, "node")
    sizes = points.groupBy("family").agg((F.count("*") <= FAMILY_DOCS).alias("few"), (F.sum("n") <= FAMILY_SHINGLES).alias("short"))
    points = scratch.keep(points.join(sizes, "family").withColumn("small", F.col("few") & F.col("short")).drop("few", "short"))
    small = points.filter("small").select(F.col("family").alias("head"), F.lit(0).alias("chunk"), "node").distinct()
    large = points.filter("not small").select("node", "n", "point")
    best = F.max(F.struct("c", (-F.col("head")).alias("h"))).alias("m")
    members = close.join(large.select("node").distinct(), "node", "left_semi").groupBy("node", "n").agg(best).select((-F.col("m.h")).alias("head"), "node", "n")
    groups = scratch.keep(chunked(members).unionByName(small))
    found = scratch.keep(verify(groups, own).unionByName(twice))
    labels = scratch.keep(components(found, scratch))
    if not large.isEmpty():
        pairs = cross_pairs(buckets.drop("head", "times").join(large.select("node", "n"), ["node", "n"], "left_semi"), labels, large, scratch, spanning=False)
        pairs = scratch.keep(pairs.join(large.groupBy(F.col("node").alias("b")).agg(F.max("n").alias("n")), "b"))
        again = scratch.keep(chunked(pairs.select(F.col("a").alias("head"), F.col("b").alias("node"), "n")))
        more = scratch.keep(verify(again, own))
        labels = scratch.keep(components(found.unionByName(more), scratch))
    scratch.drop(buckets, close, groups, found)
    named = nodes_of.join(labels, "node", "left").select("print", F.coalesce("component", "node").alias("component"))
    joined = known.select("doc_id", "n", "print").join(named, "print", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose id is their component's; rows with a null id stay."""
    (name,) = unused(docs.columns, "gone")
    gone = join_groups(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    gone = Scratch(docs.sparkSession, "copies").keep(gone)
    return without(docs, gone, docs["doc_id"].cast("long") == gone[name])


def query(spark, sf_dir: str) -> DataFrame:
    return join_groups(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, least(len(w), 5) AS k, md5(array_to_string(w[i : i + 4], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (k, g) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)
"""
