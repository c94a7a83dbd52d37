"""Records inside partitions: tree nodes and sessions, keys and signatures, dynamic containers. Each kind has a strict reader
(raising ArchiveError) and a writer."""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass, field, replace

from stratabox.functions import codecs, hashing

from .format import BLOCK_ENTRIES, CONTAINER_TYPE, NIL, ArchiveError, Part, block_hash, blocks_image, entry_error, read_block

# Versioned trees.
NODE_MAGIC, SESSION_MAGIC = b"PFSN", b"PFSS"
FILE, DIRECTORY = 1, 2
TOMBSTONE = 1
EMPTY, DIRECT, DELTA, INHERIT = 0, 1, 2, 3
CONTENT_NAMES = {EMPTY: "EMPTY", DIRECT: "DIRECT", DELTA: "DELTA", INHERIT: "INHERIT"}
NODE_PREFIX, SESSION_PREFIX = 54, 162
MAX_NAME = 1024
MAX_DELTAS, STOP_DELTAS = 16, 4096
ROOT = bytes(16)
# Signatures.
KEY_MAGIC, SIGNATURE_MAGIC = b"PCFKEY\0\0", b"PCFSIG\0\0"
KEY_PREFIX, MANIFEST_PREFIX, SIGNED_ENTRY = 52, 60, 218
SIGNATURE_ALGORITHMS = {1: "ed25519", 2: "rsa-pss-sha256", 4: "rsa-pss-sha512", 5: "rsa-pkcs1-sha256", 7: "rsa-pkcs1-sha512", 16: "ecdsa-p256-sha256", 18: "ecdsa-p521-sha512", 32: "x509-chain"}
MANIFEST_HASH = {1: 17, 2: 16, 4: 17, 5: 16, 7: 17, 16: 16, 18: 17}
KEY_FORMATS = {1: "ed25519-raw", 2: "rsa-spki", 3: "ecdsa-spki", 16: "x509-cert", 17: "x509-chain"}
TAGS = {1: "subject_dn", 2: "not_before", 3: "not_after", 4: "issuer_dn", 5: "comment"}
PRIVATE_TAG = 0x8000
# Dynamic containers.
CONTAINER_MAGIC = b"PDCP"
CONTAINER_HEADER, FRAGMENT_HEADER, FRAGMENT = 24, 9, 18
DATA = 1
SHARED = 1

_NODE = struct.Struct("<4sBBH16s16sQIH")
_DIRECT = struct.Struct("<B16sQB64s")
_DELTA = struct.Struct("<BB16sQB64sQB64s")
_SESSION = struct.Struct("<4sBBHQQB64sIB64sHH")
_KEY = struct.Struct("<8sHHB3s32sI")
_MANIFEST = struct.Struct("<8sHHBBH32sqI")
_SIGNED = struct.Struct("<16sI32sQBB64s92s")
_CONTAINER = struct.Struct("<4sBBHQQ")
_FRAGMENTS = struct.Struct("<QB")
_FRAGMENT = struct.Struct("<QQBB")


def fail(code: str, detail: str = "") -> None:
    raise ArchiveError(code, detail)


def require(condition: bool, code: str, detail: str = "") -> None:
    if not condition:
        fail(code, detail)


def known(algo: int) -> int:
    require(algo in hashing.NAMES, "UnknownHashAlgo", str(algo))
    return algo


@dataclass(frozen=True)
class Content:
    kind: int
    compression: int = 0
    patch: int = 0
    uid: bytes = b""
    size: int = 0
    algo: int = 0
    hash: bytes = b""
    base_size: int = 0
    base_algo: int = 0
    base_hash: bytes = b""


@dataclass(frozen=True)
class Node:
    kind: int
    node_id: bytes
    parent_id: bytes
    name: bytes
    flags: int = 0
    mtime_ms: int = 0
    mode: int = 0
    content: Content | None = None

    @property
    def tombstone(self) -> bool:
        return bool(self.flags & TOMBSTONE)


def valid_name(name: bytes) -> bool:
    return 0 < len(name) <= MAX_NAME and b"\0" not in name and b"/" not in name and name not in (b".", b"..")


def write_node(n: Node) -> bytes:
    out = _NODE.pack(NODE_MAGIC, 1, n.kind, n.flags, n.node_id, n.parent_id, n.mtime_ms, n.mode, len(n.name)) + n.name
    c = n.content
    if c is None:
        return out
    out += bytes([c.kind])
    if c.kind == DIRECT:
        out += _DIRECT.pack(c.compression, c.uid, c.size, c.algo, c.hash)
    elif c.kind == DELTA:
        out += _DELTA.pack(c.patch, c.compression, c.uid, c.size, c.algo, c.hash, c.base_size, c.base_algo, c.base_hash)
    return out


def read_node(data: bytes) -> Node:
    require(len(data) >= NODE_PREFIX, "MalformedNode", "too short")
    magic, version, kind, flags, node_id, parent_id, mtime, mode, size = _NODE.unpack_from(data)
    require(magic == NODE_MAGIC, "MalformedNode", "magic")
    require(version == 1, "MalformedNode", f"version {version}")
    require(kind in (FILE, DIRECTORY), "MalformedNode", f"kind {kind}")
    require(not flags & ~TOMBSTONE, "MalformedNode", f"flags {flags}")
    name, rest = data[NODE_PREFIX : NODE_PREFIX + size], data[NODE_PREFIX + size :]
    require(len(name) == size, "MalformedNode", "name ends early")
    if node_id == ROOT:
        require(not name and parent_id == ROOT and kind == DIRECTORY, "MalformedNode", "root")
    else:
        require(valid_name(name), "InvalidName", name.decode("utf-8", "replace"))
    content = None
    if kind == FILE and not flags & TOMBSTONE:
        content = _read_content(rest)
    else:
        require(not rest, "MalformedNode", "trailing bytes")
    return Node(kind, node_id, parent_id, name, flags, mtime, mode, content)


def _read_content(data: bytes) -> Content:
    require(len(data) > 0, "MalformedNode", "no content section")
    kind, body = data[0], data[1:]
    sizes = {EMPTY: 0, INHERIT: 0, DIRECT: _DIRECT.size, DELTA: _DELTA.size}
    require(kind in sizes, "MalformedNode", f"content kind {kind}")
    require(len(body) == sizes[kind], "MalformedNode", "content length")
    if kind == DIRECT:
        compression, uid, size, algo, digest = _DIRECT.unpack(body)
        return Content(kind, compression, 0, uid, size, known(algo), digest)
    if kind == DELTA:
        patch, compression, uid, size, algo, digest, base_size, base_algo, base_hash = _DELTA.unpack(body)
        return Content(kind, compression, patch, uid, size, known(algo), digest, base_size, known(base_algo), base_hash)
    return Content(kind)


@dataclass(frozen=True)
class Session:
    seq: int
    ts_ms: int = 0
    prev_algo: int = 0
    prev_hash: bytes = bytes(64)
    block_count: int = 1
    member_algo: int = 0
    member_digest: bytes = bytes(64)
    change_count: int = 0
    writer: bytes = b""


def write_session(s: Session) -> bytes:
    return _SESSION.pack(SESSION_MAGIC, 1, 0, 0, s.seq, s.ts_ms, s.prev_algo, s.prev_hash, s.block_count, s.member_algo, s.member_digest, s.change_count, len(s.writer)) + s.writer


def read_session(data: bytes) -> Session:
    require(len(data) >= SESSION_PREFIX, "MalformedSession", "too short")
    magic, major, _, _, seq, ts, prev_algo, prev_hash, count, member_algo, digest, changes, size = _SESSION.unpack_from(data)
    require(magic == SESSION_MAGIC, "MalformedSession", "magic")
    require(major == 1, "UnsupportedProfile", str(major))
    require(count >= 1, "MalformedSession", "no blocks")
    require(len(data) == SESSION_PREFIX + size, "MalformedSession", "length")
    return Session(seq, ts, known(prev_algo), prev_hash, count, known(member_algo), digest, changes, data[SESSION_PREFIX:])


def member_digest(algo: int, hashes: list[bytes]) -> bytes:
    return hashing.field(algo, b"".join(hashes)) if hashes else bytes(64)


@dataclass(frozen=True)
class Key:
    format: int
    data: bytes
    metadata: tuple[tuple[int, bytes], ...] = ()

    @property
    def fingerprint(self) -> bytes:
        return hashlib.sha256(self.data).digest()


def write_key(k: Key) -> bytes:
    tags = b"".join(struct.pack("<HI", tag, len(value)) + value for tag, value in k.metadata)
    return _KEY.pack(KEY_MAGIC, 1, 0, k.format, bytes(3), k.fingerprint, len(k.data)) + k.data + tags


def read_key(data: bytes) -> Key:
    require(len(data) >= KEY_PREFIX, "MalformedKey", "too short")
    magic, major, _, form, reserved, fingerprint, size = _KEY.unpack_from(data)
    require(magic == KEY_MAGIC, "BadKeyMagic")
    require(major == 1, "UnsupportedKeyMajor", str(major))
    require(form in KEY_FORMATS, "UnknownKeyFormat", str(form))
    require(reserved == bytes(3), "MalformedKey", "reserved bytes")
    require(size > 0 and KEY_PREFIX + size <= len(data), "MalformedKey", "key length")
    body, at, tags = data[KEY_PREFIX : KEY_PREFIX + size], KEY_PREFIX + size, []
    while at < len(data):
        require(at + 6 <= len(data), "MalformedKey", "metadata")
        tag, n = struct.unpack_from("<HI", data, at)
        require(at + 6 + n <= len(data), "MalformedKey", "metadata")
        tags.append((tag, data[at + 6 : at + 6 + n]))
        at += 6 + n
    key = Key(form, body, tuple(tags))
    require(key.fingerprint == fingerprint, "FingerprintMismatch")
    return key


def tag_name(tag: int) -> str:
    return TAGS.get(tag, "private" if tag >= PRIVATE_TAG else "unknown")


@dataclass(frozen=True)
class SignedEntry:
    uid: bytes
    type: int
    label: bytes
    used: int
    algo: int
    hash: bytes


@dataclass(frozen=True)
class Manifest:
    sig_algo: int
    hash_algo: int
    fingerprint: bytes
    signed_at: int
    entries: tuple[SignedEntry, ...]


def write_manifest(m: Manifest) -> bytes:
    head = _MANIFEST.pack(SIGNATURE_MAGIC, 1, 0, m.sig_algo, m.hash_algo, 0, m.fingerprint, m.signed_at, len(m.entries))
    return head + b"".join(_SIGNED.pack(e.uid, e.type, e.label, e.used, e.algo, 0, e.hash, bytes(92)) for e in m.entries)


def read_manifest(data: bytes) -> Manifest:
    require(len(data) >= MANIFEST_PREFIX, "MalformedSignature", "too short")
    magic, major, _, sig_algo, hash_algo, flags, fingerprint, signed_at, count = _MANIFEST.unpack_from(data)
    require(magic == SIGNATURE_MAGIC, "BadSignatureMagic")
    require(major == 1, "UnsupportedSignatureMajor", str(major))
    require(sig_algo in SIGNATURE_ALGORITHMS, "UnknownSigAlgo", str(sig_algo))
    require(hash_algo in hashing.STRONG and MANIFEST_HASH.get(sig_algo, hash_algo) == hash_algo, "HashBinding", f"{sig_algo} with {hash_algo}")
    require(flags == 0, "MalformedSignature", "flags")
    require(count >= 1, "EmptyManifest")
    require(MANIFEST_PREFIX + count * SIGNED_ENTRY <= len(data), "MalformedSignature", "entries end early")
    entries = []
    for i in range(count):
        uid, type_, label, used, algo, r1, digest, r2 = _SIGNED.unpack_from(data, MANIFEST_PREFIX + i * SIGNED_ENTRY)
        require(not r1 and r2 == bytes(92), "MalformedSignature", "reserved bytes")
        require(uid != NIL, "NilUid")
        require(type_ != 0, "ReservedType")
        require(algo in hashing.STRONG, "WeakHash", str(algo))
        entries.append(SignedEntry(uid, type_, label, used, algo, digest))
    require(len({e.uid for e in entries}) == count, "DuplicateSignedUid")
    return Manifest(sig_algo, hash_algo, fingerprint, signed_at, tuple(entries))


@dataclass(frozen=True)
class Signature:
    manifest: Manifest
    manifest_bytes: bytes
    signature: bytes


def write_signature(manifest: bytes, signature: bytes) -> bytes:
    return manifest + struct.pack("<I", len(signature)) + signature + struct.pack("<I", 0)


def read_signature(data: bytes) -> Signature:
    manifest = read_manifest(data)
    size = MANIFEST_PREFIX + SIGNED_ENTRY * len(manifest.entries)
    require(len(data) >= size + 4, "MalformedSignature", "no signature")
    n = struct.unpack_from("<I", data, size)[0]
    require(n > 0 and len(data) == size + 8 + n, "MalformedSignature", "length")
    require(struct.unpack_from("<I", data, size + 4 + n)[0] == 0, "MalformedSignature", "trailer")
    return Signature(manifest, data[:size], data[size + 4 : size + 4 + n])


def sign_parts(parts: list[Part], seed: bytes, uids: list[bytes], signed_at: int = 0) -> tuple[Key, bytes]:
    """The signer's key and a signature payload over the named partitions (sealed: with used bytes and hashes)."""
    by_uid = {}
    for p in parts:
        by_uid.setdefault(p.uid, p)
    require(len(uids) > 0, "NothingToSign")
    require(len(set(uids)) == len(uids), "DuplicateSignedUid")
    entries = []
    for uid in uids:
        require(uid in by_uid, "NotFound", uid.hex())
        p = by_uid[uid]
        require(p.algo in hashing.STRONG, "WeakHash", uid.hex())
        entries.append(SignedEntry(p.uid, p.type, p.label, p.used, p.algo, p.hash))
    key = Key(1, codecs.public_key(seed))
    body = write_manifest(Manifest(1, 17, key.fingerprint, signed_at, tuple(entries)))
    return key, write_signature(body, codecs.sign(seed, body))


@dataclass
class Extent:
    offset: int
    length: int
    kind: int = DATA
    flags: int = 0


@dataclass
class Inner:
    """A partition inside a dynamic container; its content is its extents' bytes in order."""

    type: int
    uid: bytes
    label: bytes
    algo: int
    extents: list[Extent] = field(default_factory=list)
    used: int = 0
    hash: bytes = b""

    @property
    def length(self) -> int:
        return sum(e.length for e in self.extents)


def chunks(data: bytes, size: int = 0) -> list[bytes]:
    """Whole (size 0; nothing for no data), or pieces of `size`, the last one perhaps shorter."""
    if not data:
        return []
    return [data[i : i + size] for i in range(0, len(data), size)] if size else [data]


class Arena:
    """A dynamic container in memory: a pool of bytes and the inner partitions that refer to it."""

    def __init__(self, algo: int = 16):
        self.pool, self.inners, self.algo = bytearray(), [], algo
        self.by_bytes: dict[bytes, Extent] = {}

    def content(self, inner: Inner) -> bytes:
        require(all(e.kind == DATA for e in inner.extents), "Unreadable", "extent kind")
        return b"".join(bytes(self.pool[e.offset : e.offset + e.length]) for e in inner.extents)

    def find(self, uid: bytes) -> Inner:
        return next((x for x in self.inners if x.uid == uid), None) or fail("NotFound", uid.hex())

    def _store(self, piece: bytes) -> Extent:
        found = self.by_bytes.get(piece)
        if found is None:
            found = self.by_bytes[piece] = Extent(len(self.pool), len(piece))
            self.pool += piece
        return Extent(found.offset, found.length)

    def add(self, type_: int, uid: bytes, label: bytes, data: bytes, algo: int = 16, size: int = 0) -> Inner:
        require(type_ != 0, "ReservedType")
        require(type_ != CONTAINER_TYPE, "NestedContainer")
        require(uid != NIL, "NilUid")
        require(all(x.uid != uid for x in self.inners), "DuplicateUid", uid.hex())
        inner = Inner(type_, uid, label, algo, [self._store(x) for x in chunks(data, size)])
        self.inners.append(inner)
        self.mark_shared()
        return inner

    def mark_shared(self) -> None:
        """SHARED on all extents that another one equals."""
        counts = self.references()
        for x in self.inners:
            for e in x.extents:
                e.flags = e.flags & ~SHARED | (SHARED if counts[e.offset, e.length] > 1 else e.flags & SHARED)

    def references(self) -> dict[tuple[int, int], int]:
        counts: dict[tuple[int, int], int] = {}
        for x in self.inners:
            for e in x.extents:
                counts[e.offset, e.length] = counts.get((e.offset, e.length), 0) + 1
        return counts

    def distinct_bytes(self) -> int:
        return sum(length for _, length in self.references())

    # Edits never touch stored bytes: they split, drop and insert extents.
    def _split(self, inner: Inner, at: int) -> int:
        """The number of the extent that begins at position `at`, splitting one if need be."""
        require(0 <= at <= inner.length, "PositionOutOfRange", str(at))
        place = 0
        for k, e in enumerate(inner.extents):
            if place == at:
                return k
            if place < at < place + e.length:
                cut = at - place
                inner.extents[k : k + 1] = [replace(e, length=cut), replace(e, offset=e.offset + cut, length=e.length - cut)]
                return k + 1
            place += e.length
        return len(inner.extents)

    def insert(self, uid: bytes, at: int, data: bytes) -> None:
        inner = self.find(uid)
        k = self._split(inner, at)
        if data:
            fresh = Extent(len(self.pool), len(data))
            self.pool += data
            inner.extents.insert(k, fresh)

    def append(self, uid: bytes, data: bytes) -> None:
        self.insert(uid, self.find(uid).length, data)

    def delete(self, uid: bytes, at: int, n: int) -> None:
        inner = self.find(uid)
        require(0 <= at and at + n <= inner.length, "PositionOutOfRange", f"{at}+{n}")
        first = self._split(inner, at)
        last = self._split(inner, at + n)
        del inner.extents[first:last]

    def overwrite(self, uid: bytes, at: int, n: int, data: bytes) -> None:
        self.delete(uid, at, n)
        self.insert(uid, at, data)

    def truncate(self, uid: bytes, length: int) -> None:
        inner = self.find(uid)
        require(length <= inner.length, "PositionOutOfRange", str(length))
        del inner.extents[self._split(inner, length) :]

    def remove(self, uid: bytes) -> tuple[int, bytes, int, bytes]:
        inner = self.find(uid)
        self.inners.remove(inner)
        return inner.type, inner.label, inner.algo, self.content(inner)

    def dedup(self, size: int = 0) -> int:
        """Cut every content anew into a fresh pool; the bytes that saves."""
        before = self.distinct_bytes()
        fresh = Arena(self.algo)
        for x in self.inners:
            fresh.inners.append(replace(x, extents=[fresh._store(c) for c in chunks(self.content(x), size)]))
        fresh.mark_shared()
        self.pool, self.inners, self.by_bytes = fresh.pool, fresh.inners, fresh.by_bytes
        return max(0, before - self.distinct_bytes())

    def defrag(self) -> int:
        """Drop bytes that no extent refers to, in order of first reference; their number."""
        before, counts = len(self.pool), self.references()
        moved, pool = {}, bytearray()
        for offset, length in counts:
            moved[offset, length] = len(pool)
            pool += self.pool[offset : offset + length]
        for x in self.inners:
            x.extents = [Extent(moved[e.offset, e.length], e.length, e.kind, e.flags if counts[e.offset, e.length] > 1 else e.flags & ~SHARED) for e in x.extents]
        self.pool, self.by_bytes = pool, {}
        return max(0, before - len(pool))

    def to_bytes(self) -> bytes:
        """Header, distinct extents by first reference, fragment tables, inner blocks."""
        placed, at, body = {}, CONTAINER_HEADER, bytearray()
        for offset, length in self.references():
            placed[offset, length] = at
            body += self.pool[offset : offset + length]
            at += length
        entries = []
        for x in self.inners:
            content = self.content(x)
            entries.append(Part(x.type, x.uid, x.label, b"", x.algo, 0, at, len(content), len(content), hashing.field(x.algo, content)))
            groups = [x.extents[i : i + BLOCK_ENTRIES] for i in range(0, len(x.extents), BLOCK_ENTRIES)] or [[]]
            for k, group in enumerate(groups):
                at += FRAGMENT_HEADER + FRAGMENT * len(group)
                body += _FRAGMENTS.pack(at if k + 1 < len(groups) else 0, len(group))
                for e in group:
                    body += _FRAGMENT.pack(placed[e.offset, e.length], e.length, e.kind, e.flags)
        body += blocks_image(entries, at, self.algo)
        return _CONTAINER.pack(CONTAINER_MAGIC, 1, 0, 0, at, CONTAINER_HEADER + len(body)) + bytes(body)


@dataclass
class ContainerHeader:
    major: int
    minor: int
    flags: int
    table: int
    used: int


def read_container(data: bytes) -> tuple[ContainerHeader, Arena, list[tuple[int, int, bytes, bool]]]:
    """Header, arena (inner partitions keep the stored size and hash), and inner blocks (offset, algorithm, hash, hash agrees)."""
    require(len(data) >= CONTAINER_HEADER, "NotAContainer", "too short")
    magic, major, minor, flags, table, used = _CONTAINER.unpack_from(data)
    require(magic == CONTAINER_MAGIC, "NotAContainer", "magic")
    require(major == 1, "UnsupportedContainerMajor", str(major))
    require(used <= len(data), "Truncated", "arena")
    header, arena, blocks = ContainerHeader(major, minor, flags, table, used), Arena(), []
    arena.pool = bytearray(data[:used])
    seen: set[int] = set()
    while table:
        require(table not in seen, "ChainCycle", str(table))
        seen.add(table)
        block = read_block(data[:used], table)
        n = hashing.LENGTHS[block.algo]
        blocks.append((block.offset, block.algo, block.hash, block_hash(block.algo, block.image)[:n] == block.hash[:n]))
        arena.algo = block.algo
        for p in block.entries:
            broken = entry_error(p.type, p.uid, p.used, p.max, p.label)
            require(broken is None, broken or "", p.uid.hex())
            require(p.type != CONTAINER_TYPE, "NestedContainer", p.uid.hex())
            inner = Inner(p.type, p.uid, p.label, known(p.algo), [], p.used, p.hash)
            at, visited = p.start, set()
            while at:
                require(at not in visited and at + FRAGMENT_HEADER <= used, "BadFragmentTable", str(at))
                visited.add(at)
                following, count = _FRAGMENTS.unpack_from(data, at)
                require(at + FRAGMENT_HEADER + count * FRAGMENT <= used, "BadFragmentTable", str(at))
                for i in range(count):
                    offset, length, kind, flag = _FRAGMENT.unpack_from(data, at + FRAGMENT_HEADER + i * FRAGMENT)
                    require(offset + length <= used, "ExtentOutOfBounds", str(offset))
                    inner.extents.append(Extent(offset, length, kind, flag))
                at = following
            arena.inners.append(inner)
        table = block.next
    for x in arena.inners:  # later additions share what is there
        for e in x.extents:
            if e.kind == DATA:
                arena.by_bytes.setdefault(bytes(arena.pool[e.offset : e.offset + e.length]), e)
    return header, arena, blocks


