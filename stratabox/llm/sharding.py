"""Sharding by extendible hashing, in DataFrame functions alone.

A directory is indexed by the leading bits of a row's hash. A bucket over the byte limit is split on one more bit, and
only that bucket, until every bucket fits. Rather than one job for each split, bytes are summed once by a prefix fine
enough for an even spread; the sums of all shorter prefixes follow from those few rows, and a bucket is the shortest prefix whose
bytes fit. Buckets that are still too large at the finest prefix go on to the next 16 bits, alone.

The hash is over the id and the row's text, so that rows that repeat an id but not the text can be parted. Rows equal in
both share all bits: a bucket of such rows alone can be larger than the limit, as can a bucket of one larger row; both are kept whole and
marked `oversized`.

Defined results: a null or empty text has 0 bytes; a null id hashes as an empty one; repeated rows are kept; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table

LIMIT = 1_000_000  # bytes of text in a shard
STEP = 16  # prefix bits that one pass adds
BITS = 64  # of the hash


def prefix_of(bits: Column, depth: Column | int) -> Column:
    return F.substring(bits, F.lit(1), depth) if isinstance(depth, Column) else F.substring(bits, 1, depth)


def assign_shards(docs: DataFrame, limit_bytes: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", step: int = STEP) -> DataFrame:
    """Per row: doc_id, n_bytes, shard (the bucket's prefix as a string of bits), shard_bytes, oversized."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    key = F.md5(F.concat_ws("\x1f", F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    bits = F.concat(*(F.lpad(F.conv(F.substring(key, 1 + 8 * i, 8), 16, 2), 32, "0") for i in range(BITS // 32)))
    left = scratch.keep(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), bits.alias("bits")))
    done, low = None, 0
    while True:
        high = min(low + step, BITS)
        fine = left.groupBy(F.substring("bits", 1, high).alias("prefix")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n"))
        levels = fine.select(F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"), "prefix", "bytes", "n")
        sums = levels.groupBy("depth", F.expr("substring(prefix, 1, depth)").alias("shard")).agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("n"))
        # a bucket is a prefix that fits (or can't be split) and whose parent doesn't fit
        fits = (F.col("shard_bytes") <= limit_bytes) | (F.col("n") == 1)
        last = F.col("depth") == BITS
        sums = sums.withColumn("leaf", fits | last)
        parents = sums.filter(~F.col("leaf")).select((F.col("depth") + 1).alias("depth"), F.col("shard").alias("up"))
        inner = sums.filter("leaf").withColumn("up", F.expr("substring(shard, 1, depth - 1)"))
        top = inner.filter(F.col("depth") == low).drop("up")
        leaves = inner.filter(F.col("depth") > low).join(parents, ["depth", "up"], "left_semi").drop("up").unionByName(top)
        by_fine = fine.select("prefix").join(_covering(leaves, fine), "prefix", "left")
        dealt = left.withColumn("prefix", F.substring("bits", 1, high)).join(by_fine, "prefix", "left").drop("prefix")
        dealt = scratch.keep(dealt)
        placed = dealt.filter(F.col("shard").isNotNull()).drop("bits", "depth", "n")
        done = placed if done is None else done.unionByName(placed)
        left = dealt.filter(F.col("shard").isNull()).select("doc_id", "n_bytes", "bits")
        if high == BITS or left.isEmpty():
            break
        low = high
    return done.withColumn("oversized", F.col("shard_bytes") > limit_bytes).select("doc_id", "n_bytes", "shard", "shard_bytes", "oversized")


def _covering(leaves: DataFrame, fine: DataFrame) -> DataFrame:
    """prefix -> the bucket that covers it: the one of its own leading bits that is a bucket."""
    heads = fine.select("prefix", F.explode(F.sequence(F.lit(0), F.length("prefix"))).alias("depth")).withColumn("shard", F.expr("substring(prefix, 1, depth)"))
    return heads.join(leaves, ["depth", "shard"]).select("prefix", "depth", "shard", "shard_bytes", "n")


def query(spark, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH RECURSIVE h AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, md5(CAST(doc_id AS VARCHAR) || chr(31) || md5(coalesce(text, ''))) AS k FROM documents
), b AS (
  SELECT doc_id, n_bytes, (SELECT string_agg(lpad(bin(CAST('0x' || substr(k, 1 + 4 * i, 4) AS BIGINT)), 16, '0'), '' ORDER BY i) FROM range(4) r(i)) AS bits FROM h
), s AS (
  SELECT d, substr(bits, 1, d) AS shard, sum(n_bytes) AS bytes, count(*) AS n FROM b, range(65) x(d) GROUP BY ALL
), leaf AS (
  SELECT s.d, s.shard, s.bytes FROM s LEFT JOIN s p ON p.d = s.d - 1 AND p.shard = substr(s.shard, 1, s.d - 1)
  WHERE (s.bytes <= {LIMIT} OR s.n = 1 OR s.d = 64) AND (s.d = 0 OR (p.bytes > {LIMIT} AND p.n > 1))
)
SELECT doc_id, n_bytes, shard, CAST(bytes AS BIGINT) AS shard_bytes, bytes > {LIMIT} AS oversized
FROM b JOIN leaf ON substr(bits, 1, d) = shard
"""
