"""Dynamic containers: chunks, shared extents, what dedup and defragmentation save, edits as interval arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratabox.functions import hashing


def chunked(contents: DataFrame, size: int, *keys: str, data: str = "data") -> DataFrame:
    """keys, seq, chunk: fixed pieces, the last perhaps shorter; nothing for no data. Size 0: the whole."""
    own = contents.select(*keys, F.col(data).alias("d")).filter(F.octet_length("d") > 0)
    if not size:
        return own.select(*keys, F.lit(0).alias("seq"), F.col("d").alias("chunk"))
    pieces = own.withColumn("seq", F.explode(F.sequence(F.lit(0), F.ceil(F.octet_length("d") / size).cast("int") - 1)))
    return pieces.select(*keys, "seq", F.expr(f"substring(d, seq * {size} + 1, {size})").alias("chunk"))


def chunk_refs(chunks: DataFrame, *keys: str) -> DataFrame:
    """Per distinct chunk within keys: digest, length, refs. Bytes stay out of the shuffle."""
    return chunks.select(*keys, F.sha2("chunk", 256).alias("digest"), F.octet_length("chunk").alias("length")).groupBy(*keys, "digest", "length").agg(F.count("*").alias("refs"))


def savings(chunks: DataFrame, *keys: str) -> DataFrame:
    """keys, chunks, distinct_chunks, bytes, distinct_bytes, saved."""
    refs = chunk_refs(chunks, *keys)
    out = refs.groupBy(*keys).agg(F.sum("refs").alias("chunks"), F.count("*").alias("distinct_chunks"), F.sum(F.col("refs") * F.col("length")).alias("bytes"), F.sum(F.col("length").cast("long")).alias("distinct_bytes"))
    return out.withColumn("saved", F.greatest(F.col("bytes") - F.col("distinct_bytes"), F.lit(0)))


def extent_refs(extents: DataFrame) -> DataFrame:
    """path, container_uid, extent_offset, extent_length, refs, flagged, flag_ok (more than one reference needs the SHARED mark)."""
    out = extents.groupBy("path", "container_uid", "extent_offset", "extent_length").agg(F.count("*").alias("refs"), F.bool_and("shared").alias("flagged"))
    return out.withColumn("flag_ok", F.col("flagged") | (F.col("refs") < 2))


def defrag_offsets(extents: DataFrame, start: int = 24) -> DataFrame:
    """Where distinct extents go when the pool is rebuilt in order of first reference."""
    first = extents.groupBy("path", "container_uid", "extent_offset", "extent_length").agg(F.min(F.struct("inner_ord", "seq")).alias("first"), F.count("*").alias("refs"))
    before = Window.partitionBy("path", "container_uid").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    return first.withColumn("new_offset", F.lit(start) + F.coalesce(F.sum("extent_length").over(before), F.lit(0))).drop("first")


def clip(extents: DataFrame, at: int, n: int, *keys: str) -> DataFrame:
    """The extents that delete [at, at + n) leaves of each content: keys, seq, piece (0 before, 1 after), extent_offset, extent_length.
    No stored byte moves; an extent over an edge gives two pieces."""
    own = Window.partitionBy(*keys).orderBy("seq")
    placed = extents.withColumn("end", F.sum("extent_length").over(own)).withColumn("begin", F.col("end") - F.col("extent_length"))
    low = placed.select(*keys, "seq", F.lit(0).alias("piece"), "extent_offset", F.greatest(F.least(F.col("end"), F.lit(at)) - F.col("begin"), F.lit(0)).alias("extent_length"))
    skip = F.greatest(F.lit(at + n) - F.col("begin"), F.lit(0))
    high = placed.select(*keys, "seq", F.lit(1).alias("piece"), (F.col("extent_offset") + skip).alias("extent_offset"), F.greatest(F.col("extent_length") - skip, F.lit(0)).alias("extent_length"))
    return low.unionByName(high).filter("extent_length > 0")


def resolve(top: DataFrame, inners: DataFrame) -> DataFrame:
    """path, uid, place, used_bytes: the first holder of each uid, top-level partitions before inner ones."""
    every = top.select("path", "uid", F.lit("top").alias("place"), F.lit(0).alias("level"), F.col("ord").alias("at"), "used_bytes").unionByName(
        inners.select("path", F.col("inner_uid").alias("uid"), F.lit("inner").alias("place"), F.lit(1).alias("level"), F.col("inner_ord").alias("at"), "used_bytes")
    )
    return every.groupBy("path", "uid").agg(F.min_by(F.struct("place", "used_bytes"), F.struct("level", "at")).alias("r")).select("path", "uid", "r.*")


def inner_verdicts(inners: DataFrame) -> DataFrame:
    """The `inners` view with verdict: unreadable, size_mismatch, hash_mismatch or ok, against what is stored."""
    computed = hashing.digest(F.col("algo"), F.col("content"))
    verdict = (
        F.when(F.col("content").isNull(), "unreadable")
        .when(F.octet_length("content") != F.col("used_bytes"), "size_mismatch")
        .when(~hashing.matches(F.col("algo"), F.col("data_hash"), computed), "hash_mismatch")
        .otherwise("ok")
    )
    return inners.withColumn("verdict", verdict)


def shared(refs: Column) -> Column:
    return refs > 1
