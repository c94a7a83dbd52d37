"""Versioned trees: newest records, time travel, liveness, paths, contents, session chains, and plans for changes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from stratabox.functions import hashing
from stratabox.sources import format as fmt
from stratabox.sources import records as rec
from stratabox.sources.tree_log import replay


def newest(nodes: DataFrame, as_of: Column | int | None = None) -> DataFrame:
    """The record of each node with the largest session, up to `as_of` inclusive. One partial aggregate, one shuffle."""
    kept = nodes.filter("error is null")
    if as_of is not None:
        kept = kept.filter(F.col("session_seq") <= as_of)
    columns = [c for c in nodes.columns if c not in ("path", "node_id", "error")]
    found = kept.groupBy("path", "node_id").agg(F.max_by(F.struct(*columns), "session_seq").alias("r"))
    return found.select("path", "node_id", "r.*")


def session_at(sessions: DataFrame, ts_ms: int) -> DataFrame:
    """path, session_seq: the last session not after a time; 0 if none."""
    return sessions.groupBy("path").agg(F.coalesce(F.max(F.when(F.col("ts_ms") <= ts_ms, F.col("session_seq"))), F.lit(0)).alias("session_seq"))


def newest_at(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """Time travel to several points at once: points (path, point) against each node's history. Versions are reduced to the newest between
    two points, once each; what no later point replaces is carried forward."""
    asked = points.groupBy("path").agg(F.sort_array(F.collect_set("point")).alias("points"))
    following = F.element_at(F.filter("points", lambda p: p >= F.col("session_seq")), 1)
    sorted_in = nodes.filter("error is null").join(asked, "path").filter(F.element_at("points", -1) >= F.col("session_seq")).withColumn("first", following)
    columns = [c for c in nodes.columns if c not in ("path", "node_id", "error")]
    newest = sorted_in.groupBy("path", "node_id", "first").agg(F.max_by(F.struct(*columns), "session_seq").alias("r"), F.first("points").alias("points"))
    replaced = F.lead("first").over(Window.partitionBy("path", "node_id").orderBy("first"))
    carried = newest.withColumn("replaced", replaced)
    held = F.filter("points", lambda p: (p >= F.col("first")) & (F.col("replaced").isNull() | (p < F.col("replaced"))))
    return carried.select("path", F.explode(held).alias("point"), "node_id", "r.*")


def _by_tree(current: DataFrame, run, schema: StructType) -> DataFrame:
    """run: the records of one tree to rows. A tree is one file, so its records are bounded by what one task reads anyway."""
    arrow = to_arrow_schema(schema)
    return current.groupBy("path").applyInArrow(lambda table: run(table, arrow), schema)


def live(current: DataFrame) -> DataFrame:
    """Live nodes with their paths: reached from the root over directories, of siblings with one name the one of the later session (then
    the smaller id). path, node_id, tree_path, depth, and the record's columns (null for a root without a record). One shuffle, one walk of
    each tree."""
    others = [f for f in current.schema.fields if f.name not in ("path", "node_id")]
    schema = StructType([current.schema["path"], current.schema["node_id"], StructField("tree_path", StringType()), StructField("depth", IntegerType()), *others])

    def run(table: pa.Table, arrow: pa.Schema) -> pa.Table:
        ids, parents, names, shown, kinds, gone, seqs = (table[c].to_pylist() for c in ("node_id", "parent_id", "name_raw", "name", "kind", "tombstone", "session_seq"))
        children: dict[bytes, dict[bytes, int]] = {}
        root = None
        for k, node in enumerate(ids):
            if node == rec.ROOT:
                root = k
            elif not gone[k] and node != parents[k]:
                # a name's loser hides with all below it, whether or not it is live: liveness of siblings is that of their parent
                named = children.setdefault(parents[k], {})
                other = named.get(names[k])
                if other is None or (-seqs[k], node) < (-seqs[other], ids[other]):
                    named[names[k]] = k
        rows: list[tuple[int | None, str, int]] = []
        if root is None or not gone[root]:
            rows.append((root, "", 0))
            at = 0
            while at < len(rows):
                k, path, depth = rows[at]
                at += 1
                if depth == 0 or kinds[k] == rec.DIRECTORY:
                    rows += [(c, f"{path}/{shown[c]}" if depth else shown[c], depth + 1) for c in children.get(rec.ROOT if depth == 0 else ids[k], {}).values()]
        taken = table.take(pa.array([k for k, _, _ in rows], pa.int64()))
        out = {"path": pa.array([table["path"][0].as_py()] * len(rows), pa.string()), "node_id": pa.array([rec.ROOT if k is None else ids[k] for k, _, _ in rows], pa.binary())}
        out |= {"tree_path": pa.array([p for _, p, _ in rows], pa.string()), "depth": pa.array([d for _, _, d in rows], pa.int32())}
        return pa.table({f.name: out[f.name] if f.name in out else taken[f.name].cast(f.type) for f in arrow})

    return _by_tree(current, run, schema)


def parent_cycles(current: DataFrame) -> DataFrame:
    """path, node_id of nodes that are their own ancestor, by way of nodes that are not removed. Cycles of any length."""

    def run(table: pa.Table, arrow: pa.Schema) -> pa.Table:
        up = {i: p for i, p, gone in zip(table["node_id"].to_pylist(), table["parent_id"].to_pylist(), table["tombstone"].to_pylist(), strict=True) if not gone and i != p}
        done: set[bytes] = set()
        found: list[bytes] = []
        for start in up:
            trail: dict[bytes, int] = {}
            at = start
            while at in up and at not in done and at not in trail:
                trail[at] = len(trail)
                at = up[at]
            if at in trail:
                found += [i for i, n in trail.items() if n >= trail[at]]
            done.update(trail)
        return pa.table({"path": pa.array([table["path"][0].as_py()] * len(found), pa.string()), "node_id": pa.array(found, pa.binary())}, schema=arrow)

    own = current.select("path", "node_id", "parent_id", "tombstone")
    return _by_tree(own, run, StructType([current.schema["path"], current.schema["node_id"]]))


def resolve(tree: DataFrame, path: str) -> DataFrame:
    """The live node at a path, of each archive."""
    return tree.filter(F.col("tree_path") == "/".join(x for x in path.split("/") if x not in ("", ".")))


def content_chain(nodes: DataFrame) -> DataFrame:
    """Of each node's versions with content those that its newest one is made from, newest first: adds `age` (0: newest)."""
    own = Window.partitionBy("path", "node_id").orderBy(F.desc("session_seq"))
    base = F.col("content.kind").isin(rec.EMPTY, rec.DIRECT).cast("int")
    kept = nodes.filter("error is null and content is not null").withColumn("bases", F.coalesce(F.sum(base).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return kept.filter("bases = 0").withColumn("age", F.row_number().over(own) - 1).drop("bases")


def delta_depth(nodes: DataFrame) -> DataFrame:
    """path, node_id, depth: versions between the newest content and its base."""
    chain = content_chain(nodes)
    return chain.groupBy("path", "node_id").agg(F.count_if(~F.col("content.kind").isin(rec.EMPTY, rec.DIRECT)).alias("depth"))


def contents(nodes: DataFrame, data: DataFrame, as_of: int | None = None) -> DataFrame:
    """path, node_id, content, error: each node's newest content up to `as_of`. All nodes are replayed in one pass; a node's chain, at
    most 4096 versions, meets in one group."""
    kept = nodes if as_of is None else nodes.filter(F.col("session_seq") <= as_of)
    chain = content_chain(kept).select("path", "node_id", "age", F.col("content").alias("c"), F.col("content.uid").alias("uid"))
    first = data.groupBy("path", "uid").agg(F.max_by(F.struct("data", "data_hash_algo", "data_hash"), "ord").alias("stored"))
    joined = chain.join(first, ["path", "uid"], "left").select("path", "node_id", "age", "c", "stored")

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["age"])
        stored = {r["c"]["uid"]: r["stored"] for r in rows if r["stored"]}

        def fetch(uid: bytes) -> bytes:
            got = stored.get(uid)
            rec.require(got is not None, "NotFound", uid.hex())
            rec.require(hashing.agrees(got["data_hash_algo"], got["data_hash"], got["data"]), "DataHashMismatch", uid.hex())
            return got["data"]

        content, error = None, None
        try:
            content = replay([rec.Content(**r["c"]) for r in rows], fetch)
        except ValueError as e:
            error = str(e)
        return pa.table({"path": [rows[0]["path"]], "node_id": [rows[0]["node_id"]], "content": pa.array([content], pa.binary()), "error": pa.array([error], pa.string())})

    return joined.groupBy("path", "node_id").applyInArrow(run, "path string, node_id binary, content binary, error string")


def chain_verdicts(sessions: DataFrame) -> DataFrame:
    """path, session_seq, linked, members_ok: each session names its elder's head hash; its member blocks give its digest."""
    own = Window.partitionBy("path").orderBy("session_seq")
    elder, algo = F.lag("head_hash").over(own), F.lag("head_algo").over(own)
    first = elder.isNull()
    alike = (F.col("prev_hash_algo") == algo) & hashing.matches(algo, F.col("prev_hash"), elder)
    origin = (F.col("prev_hash_algo") == 0) & (F.col("prev_hash") == F.lit(bytes(64)))
    computed = hashing.digest(F.col("member_algo"), F.col("member_hashes"))
    members = (F.col("block_count") == F.col("blocks_found")) & hashing.matches(F.col("member_algo"), F.col("member_digest"), computed)
    return sessions.select("path", "session_seq", F.when(first, origin).otherwise(alike).alias("linked"), members.alias("members_ok"))


def session_log(sessions: DataFrame) -> DataFrame:
    return sessions.select("path", "session_seq", "block_count", "change_count", "ts_ms", "writer")


def plan_changes(source: DataFrame, tree: DataFrame, content: DataFrame, delete: bool = False) -> DataFrame:
    """What makes a tree equal to `source` (path, tree_path, data): path, op (put, rm), tree_path, depth, in_order. Contents are compared by
    digest, so unchanged files drop out before any bytes move. Puts come by depth, removals deepest first."""
    files = tree.filter(F.col("kind") == rec.FILE).join(content.select("path", "node_id", F.sha2("content", 256).alias("old")), ["path", "node_id"], "left").select("path", "tree_path", "old")
    wanted = source.select("path", "tree_path", F.sha2("data", 256).alias("new"))
    both = wanted.join(files, ["path", "tree_path"], "full")
    op = F.when(F.col("new").isNotNull() & ((F.col("old") != F.col("new")) | F.col("old").isNull()), "put").when(F.col("new").isNull() & F.lit(delete), "rm")
    depth = F.size(F.split("tree_path", "/"))
    planned = both.withColumn("op", op).filter("op is not null").withColumn("depth", depth)
    order = Window.partitionBy("path").orderBy(F.col("op"), F.when(F.col("op") == "rm", -F.col("depth")).otherwise(F.col("depth")), "tree_path")
    return planned.select("path", "op", "tree_path", "depth", F.row_number().over(order).alias("in_order"))


def session_block(index: Column) -> Column:
    """The block of a session that holds its entry with a 0-based index (the head keeps one place for the session record)."""
    return F.floor((index + 1) / fmt.BLOCK_ENTRIES)


def normalise(path: Column) -> Column:
    return F.array_join(F.filter(F.split(path, "/"), lambda x: ~x.isin("", ".")), "/")
