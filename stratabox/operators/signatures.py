"""Signatures: verdicts on manifests and on what they cover, coverage and what is left to sign."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from stratabox.functions import codecs, hashing


@F.pandas_udf(StringType())
def _check(algo: pd.Series, form: pd.Series, key: pd.Series, manifest: pd.Series, signature: pd.Series) -> pd.Series:
    """Of Ed25519 signatures with a key: valid, invalid, malformed_key or signature_length."""
    out = []
    for a, f, k, m, s in zip(algo, form, key, manifest, signature, strict=True):
        if a != 1 or f != 1 or k is None or m is None:
            out.append(None)
        elif len(s) != 64:
            out.append("signature_length")
        elif not codecs.key_usable(bytes(k)):
            out.append("malformed_key")
        else:
            out.append("valid" if codecs.verify(bytes(k), bytes(m), bytes(s)) else "invalid")
    return pd.Series(out, dtype=object)


def manifest_verdicts(signatures: DataFrame, keys: DataFrame, entries: DataFrame) -> DataFrame:
    """path, uid, fingerprint, verdict, reason, parse_error. The first broken gate decides: parse, self-reference, algorithm, key, its
    format, lengths, signature. Of keys with one fingerprint the first in chain order counts."""
    first = keys.filter("error is null").groupBy("path", "fingerprint").agg(F.min_by(F.struct("key_format", "key_data"), "ord").alias("k"))
    own = entries.filter(F.col("uid") == F.col("sig_uid")).select("path", "ord").distinct().withColumn("of_itself", F.lit(True))
    joined = signatures.join(first, ["path", "fingerprint"], "left").join(own, ["path", "ord"], "left")
    checked = joined.withColumn("checked", _check("sig_algo", "k.key_format", "k.key_data", "manifest", "signature"))
    reason = (
        F.when(F.col("error").isNotNull(), "malformed")
        .when(F.col("of_itself"), "self_reference")
        .when(F.col("sig_algo") != 1, "unsupported_algorithm")
        .when(F.col("k").isNull(), "no_matching_key")
        .when(F.col("k.key_format") != 1, "unsupported_key_format")
        .when(F.col("checked") == "signature_length", "signature_length")
        .when(F.col("checked") == "malformed_key", "malformed_key")
        .when(F.col("checked") == "invalid", "bad_signature")
    )
    verdict = F.when(reason.isNull(), "Valid").when(reason.isin("self_reference", "bad_signature"), "Invalid").otherwise("Unverifiable")
    return checked.select("path", "ord", "uid", "fingerprint", "signed_at", verdict.alias("verdict"), reason.alias("reason"), F.col("error").alias("parse_error"))


def entry_verdicts(entries: DataFrame, manifests: DataFrame, partitions: DataFrame, data: DataFrame | None = None) -> DataFrame:
    """path, sig_uid, pos, uid, verdict for the entries of valid manifests. With `data`, the bytes of valid ones are hashed again."""
    first = partitions.groupBy("path", "uid").agg(F.min_by(F.struct("partition_type", "label_raw", "used_bytes", "data_hash_algo", "data_hash"), "ord").alias("p"))
    kept = entries.join(manifests.filter("verdict = 'Valid'").select("path", "ord"), ["path", "ord"], "left_semi")
    joined = kept.join(first, ["path", "uid"], "left")
    n = hashing.digest_length(F.col("algo"))
    alike = (F.col("p.partition_type") == F.col("type")) & (F.col("p.label_raw") == F.col("label_raw")) & (F.col("p.used_bytes") == F.col("used_bytes")) & (F.col("p.data_hash_algo") == F.col("algo"))
    alike &= F.substring("p.data_hash", F.lit(1), n) == F.substring("data_hash", F.lit(1), n)
    verdict = F.when(F.col("p").isNull(), "Missing").when(~F.col("algo").isin(*hashing.STRONG), "WeakHash").when(~alike, "ProtectedFieldMismatch").otherwise("Valid")
    out = joined.withColumn("verdict", verdict)
    if data is not None:
        bytes_ = data.groupBy("path", "uid").agg(F.min_by("data", "ord").alias("data"))
        out = out.join(bytes_, ["path", "uid"], "left")
        again = hashing.matches(F.col("algo"), F.col("data_hash"), hashing.digest(F.col("algo"), F.col("data")))
        out = out.withColumn("verdict", F.when((F.col("verdict") == "Valid") & ~again, "DataHashMismatch").otherwise(F.col("verdict")))
    return out.select("path", "sig_uid", "pos", "uid", "verdict")


def to_sign(partitions: DataFrame, entries: DataFrame, manifests: DataFrame, verdicts: DataFrame, fingerprint: bytes, resign: bool = False) -> DataFrame:
    """Partitions with a strong hash, not of a signature kind, that the key does not validly cover yet."""
    free = partitions.filter(F.col("data_hash_algo").isin(*hashing.STRONG) & ~F.col("partition_type").isin(0xAAAB0001, 0xAAAB0002))
    if resign:
        return free
    mine = manifests.filter((F.col("verdict") == "Valid") & (F.col("fingerprint") == F.lit(fingerprint))).select("path", F.col("uid").alias("sig_uid"))
    covered = verdicts.filter("verdict = 'Valid'").join(mine, ["path", "sig_uid"], "left_semi").select("path", "uid").distinct()
    return free.join(covered, ["path", "uid"], "left_anti")


def all_valid(manifests: DataFrame, verdicts: DataFrame) -> DataFrame:
    """path, ok: at least one manifest, and every manifest and entry valid."""
    both = manifests.select("path", (F.col("verdict") == "Valid").alias("ok")).unionByName(verdicts.select("path", (F.col("verdict") == "Valid").alias("ok")))
    return both.groupBy("path").agg(F.bool_and("ok").alias("ok"))


def trusted(manifests: DataFrame, fingerprint: bytes) -> DataFrame:
    """path, trusted: some valid manifest is by this key."""
    return manifests.groupBy("path").agg(F.bool_or((F.col("verdict") == "Valid") & (F.col("fingerprint") == F.lit(fingerprint))).alias("trusted"))
