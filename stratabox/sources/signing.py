"""Signatures over one archive in memory: what they are worth, and new ones, for plain archives and for versioned trees.

The rules are those of operators.signatures: the first broken gate decides, only significant digest bytes count, a weak hash covers
nothing.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, replace

from stratabox.functions import codecs, hashing

from . import format as fmt
from . import records as rec
from .tree_log import TreeLog

#: What a versioned tree has signed: contents and node records. Session records are held by their own chain.
TREE_TYPES = (fmt.RAW_TYPE, fmt.NODE_TYPE)


@dataclass
class Report:
    """One signature: verdict, the gate that decided it, the signer, and verdicts on what it covers."""

    uid: bytes
    verdict: str
    reason: str | None
    fingerprint: bytes = b""
    entries: list[tuple[bytes, str]] = field(default_factory=list)


def _gate(p: fmt.Part, s: rec.Signature, key: rec.Key | None) -> tuple[str, str | None]:
    if any(e.uid == p.uid for e in s.manifest.entries):
        return "Invalid", "self_reference"
    if s.manifest.sig_algo != 1:
        return "Unverifiable", "unsupported_algorithm"
    if key is None:
        return "Unverifiable", "no_matching_key"
    if key.format != 1:
        return "Unverifiable", "unsupported_key_format"
    if len(s.signature) != 64:
        return "Unverifiable", "signature_length"
    if not codecs.key_usable(key.data):
        return "Unverifiable", "malformed_key"
    return ("Valid", None) if codecs.verify(key.data, s.manifest_bytes, s.signature) else ("Invalid", "bad_signature")


def reports(data: bytes, recheck: bool = False) -> list[Report]:
    parts = fmt.walk(data).parts
    first: dict[bytes, fmt.Part] = {}
    keys: dict[bytes, rec.Key] = {}
    for p in parts:
        first.setdefault(p.uid, p)
        if p.type == fmt.KEY_TYPE:
            try:
                k = rec.read_key(fmt.data_of(data, p))
                keys.setdefault(k.fingerprint, k)
            except fmt.ArchiveError:
                continue
    out = []
    for p in (p for p in parts if p.type == fmt.SIGNATURE_TYPE):
        try:
            s = rec.read_signature(fmt.data_of(data, p))
        except fmt.ArchiveError:
            out.append(Report(p.uid, "Unverifiable", "malformed"))
            continue
        verdict, reason = _gate(p, s, keys.get(s.manifest.fingerprint))
        covered = [(e.uid, _entry(e, first.get(e.uid), data, recheck)) for e in s.manifest.entries] if verdict == "Valid" else []
        out.append(Report(p.uid, verdict, reason, s.manifest.fingerprint, covered))
    return out


def _entry(e: rec.SignedEntry, p: fmt.Part | None, data: bytes, recheck: bool) -> str:
    if p is None:
        return "Missing"
    if e.algo not in hashing.STRONG:
        return "WeakHash"
    n = hashing.LENGTHS[e.algo]
    if (p.type, p.label, p.used, p.algo, p.hash[:n]) != (e.type, e.label, e.used, e.algo, e.hash[:n]):
        return "ProtectedFieldMismatch"
    return "Valid" if not recheck or hashing.agrees(e.algo, e.hash, fmt.data_of(data, p)) else "DataHashMismatch"


def signed(data: bytes, seed: bytes, uids: list[bytes] | None = None, ts: int = 0, resign: bool = False, key_label: str = "key", sig_label: str = "signature") -> tuple[bytes, list[bytes]]:
    """The archive with a signature over what its signer's valid ones do not cover yet (with `resign`: over all), and the uids that it
    covers. A versioned tree gets them as a session of its own, a plain archive as two partitions; nothing to sign leaves the bytes as they are."""
    found = fmt.walk(data, strict=True)
    tree = any(p.type == fmt.SESSION_TYPE for p in found.parts)
    fingerprint = rec.Key(1, codecs.public_key(seed)).fingerprint
    covered = set() if resign else {u for r in reports(data) if r.verdict == "Valid" and r.fingerprint == fingerprint for u, v in r.entries if v == "Valid"}
    if uids is None:
        free = (lambda p: p.type in TREE_TYPES) if tree else (lambda p: p.type not in (fmt.KEY_TYPE, fmt.SIGNATURE_TYPE))
        uids = list(dict.fromkeys(p.uid for p in found.parts if free(p) and p.algo in hashing.STRONG))
    wanted = [u for u in uids if u not in covered]
    if not wanted:
        return data, []
    key, payload = rec.sign_parts(found.parts, seed, wanted, ts)
    name = lambda what: hashlib.md5(b"\x1f".join([what, str(len(data)).encode(), fingerprint, *wanted])).digest()
    added = []
    if not _has_key(data, found, fingerprint):
        added.append(fmt.Part(fmt.KEY_TYPE, name(b"key"), fmt.encode_label(key_label), rec.write_key(key)))
    added.append(fmt.Part(fmt.SIGNATURE_TYPE, name(b"signature"), fmt.encode_label(sig_label), payload))
    if tree:
        log = TreeLog(data, writer=b"signer")
        log.commit(added, 0, ts * 1000)
        return log.data, wanted
    kept = [replace(p, data=fmt.data_of(data, p), reserve=max(0, p.max - p.used)) for p in found.parts]
    return fmt.image(kept + added, found.blocks[0].algo if found.blocks else 16, found.head_source == "trailer", keep_hashes=True), wanted


def _has_key(data: bytes, found: fmt.Archive, fingerprint: bytes) -> bool:
    for p in found.parts:
        if p.type == fmt.KEY_TYPE:
            try:
                if rec.read_key(fmt.data_of(data, p)).fingerprint == fingerprint:
                    return True
            except fmt.ArchiveError:
                continue
    return False
