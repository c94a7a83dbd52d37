"""Verdicts on archives: entry rules, data hashes, block hashes, uniqueness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratabox.functions import hashing
from stratabox.sources.archive import view


def entry_verdicts(data: DataFrame) -> DataFrame:
    """The `data` view with data_ok and error (the first rule broken)."""
    computed = hashing.digest(F.col("data_hash_algo"), F.col("data"))
    ok = hashing.matches(F.col("data_hash_algo"), F.col("data_hash"), computed)
    error = F.coalesce(F.col("validate_error"), F.when(~F.col("data_in_bounds"), "DataOutOfBounds"), F.when(~ok, "DataHashMismatch"))
    return data.withColumn("data_ok", ok & F.col("data_in_bounds")).withColumn("error", error)


def block_verdicts(blocks: DataFrame) -> DataFrame:
    """The `blocks` view with table_ok: hash over the block with its hash field zeroed."""
    zeroed = F.concat(F.substring("image", 1, 10), F.lit(bytes(64)), F.expr("substring(image, 75)"))
    computed = hashing.digest(F.col("algo_id"), zeroed)
    return blocks.withColumn("table_ok", hashing.matches(F.col("algo_id"), F.col("table_hash"), computed))


def verify(archives: DataFrame) -> DataFrame:
    """Per archive, whatever is wrong with it: blocks, entries, bad_blocks, bad_entries, first_error (in chain order: a block before its
    entries), file_error (what is no archive, or ends the chain early). One pass; no data leaves the workers."""
    return view(archives, "verdicts")


def verify_trees(archives: DataFrame) -> DataFrame:
    """Per versioned tree: sessions, nodes, error (the archive's rules, the session chain, records, parent cycles; null: sound)."""
    return view(archives, "tree_verdicts")


def verify_containers(archives: DataFrame) -> DataFrame:
    """Per archive: containers, inners, error (the archive's rules, inner blocks and records, uids, lengths and hashes of contents)."""
    return view(archives, "container_verdicts")


def duplicate_uids(archives: DataFrame) -> DataFrame:
    """path, uid, n: uids that an archive holds more than once, inner partitions included."""
    every = view(archives, "partitions").select("path", "uid").unionByName(view(archives, "inners").select("path", F.col("inner_uid").alias("uid")))
    return every.groupBy("path", "uid").agg(F.count("*").alias("n")).filter("n > 1")


def lookup(partitions: DataFrame, uid: bytes) -> DataFrame:
    """The first entry with a uid in each archive, in chain order."""
    columns = [c for c in partitions.columns if c != "path"]
    first = partitions.filter(F.col("uid") == F.lit(uid)).groupBy("path").agg(F.min_by(F.struct(*columns), "ord").alias("r"))
    return first.select("path", "r.*")


def filter_parts(partitions: DataFrame, type_: int | None = None, uid_prefix: str = "", label: str = "") -> DataFrame:
    """By type, hex prefix of the uid, part of the label."""
    kept = partitions if type_ is None else partitions.filter(F.col("partition_type") == type_)
    if uid_prefix:
        kept = kept.filter(F.lower(F.hex("uid")).startswith(uid_prefix.lower()))
    return kept.filter(F.col("label").contains(label)) if label else kept


def human_size(n: Column) -> Column:
    """Binary units, one decimal (halves to the even digit) unless whole."""
    column = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        scaled = n / F.lit(1024**k)
        text = F.when(scaled == F.floor(scaled), F.format_string(f"%d {unit}", F.floor(scaled))).otherwise(F.format_string(f"%.1f {unit}", F.bround(scaled, 1)))
        column = F.when(n >= 1024**k, text).otherwise(column)
    return column
