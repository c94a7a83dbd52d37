"""Byte layout of archives: header, trailer, table blocks, entries; reading them defensively, writing them compactly."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field, replace

import numpy as np

from stratabox.functions import hashing

# Fixed values of the format (little-endian throughout).
MAGIC = b"\x89KPRT\r\n\x1a"
TRAILER_MAGIC = MAGIC[::-1]
VERSION = (1, 0)
HEADER, TRAILER, BLOCK, ENTRY = 20, 20, 74, 141
LABEL, UID = 32, 16
IN_TRAILER = 2**64 - 1
RESERVED_TYPE, RAW_TYPE = 0, 0xFFFFFFFF
NIL = bytes(UID)
BLOCK_ENTRIES = 255
BACKWARD = 1
NODE_TYPE, SESSION_TYPE = 0xAAAA0001, 0xAAAA0002
KEY_TYPE, SIGNATURE_TYPE = 0xAAAB0001, 0xAAAB0002
CONTAINER_TYPE = 0xAAAC0001

_HEADER = struct.Struct("<8sHHQ")
_TRAILER = struct.Struct("<QB3s8s")
_BLOCK = struct.Struct("<BQB64s")
_ENTRY = struct.Struct("<I16s32sQQQB64s")
#: The entries of a block, read at once.
ENTRIES = np.dtype([("type", "<u4"), ("uid", "V16"), ("label", "V32"), ("start", "<u8"), ("max", "<u8"), ("used", "<u8"), ("algo", "u1"), ("hash", "V64")])


class ArchiveError(ValueError):
    """An archive that breaks a rule; `code` names the rule."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


@dataclass
class Part:
    """One partition: an entry and its bytes."""

    type: int
    uid: bytes
    label: bytes  # 32 bytes, zero-filled
    data: bytes
    algo: int = 16
    reserve: int = 0
    start: int = 0
    max: int = 0
    used: int = 0
    hash: bytes = b""

    def entry(self) -> bytes:
        return _ENTRY.pack(self.type, self.uid, self.label, self.start, self.max, self.used, self.algo, self.hash)


@dataclass
class Block:
    offset: int
    count: int
    next: int
    algo: int
    hash: bytes
    image: bytes  # header and entries
    entries: list[Part] = field(default_factory=list)


@dataclass
class Archive:
    """What a walk found. `problems`: (severity, kind, message, detail)."""

    size: int
    version: tuple[int, int] | None = None
    pointer: int = 0
    head: int = 0
    head_source: str = "header"
    trailer: int | None = None
    backward: bool = False
    blocks: list[Block] = field(default_factory=list)
    problems: list[tuple[str, str, str, dict[str, str]]] = field(default_factory=list)

    @property
    def parts(self) -> list[Part]:
        return [p for b in self.blocks for p in b.entries]


def encode_label(text: str) -> bytes:
    raw = text.encode()
    if len(raw) > LABEL or b"\0" in raw or not raw.isascii():
        raise ArchiveError("InvalidLabel", text)
    return raw.ljust(LABEL, b"\0")


def decode_label(raw: bytes) -> str | None:
    text = raw.split(b"\0", 1)[0]
    return text.decode() if text.isascii() else None


def entry_error(type_: int, uid: bytes, used: int, max_: int, label: bytes) -> str | None:
    """The first rule that an entry breaks."""
    checks = ((type_ == RESERVED_TYPE, "ReservedType"), (uid == NIL, "NilUid"), (used > max_, "UsedExceedsMax"), (decode_label(label) is None, "InvalidLabel"))
    return next((name for broken, name in checks if broken), None)


def block_hash(algo: int, image: bytes) -> bytes:
    """Over header and entries with the header's own hash field zeroed."""
    return hashing.field(algo, image[:10] + bytes(64) + image[BLOCK:])


def find_trailer(data: bytes, end: int | None = None) -> tuple[int, int, int] | None:
    """(place, head, flags) of the last trailer that is whole: its head is none, or a block before it."""
    at = data.rfind(TRAILER_MAGIC, 0, end)
    while at >= 0:
        place = at - 12
        if place >= 0:
            head, flags, _, _ = _TRAILER.unpack_from(data, place)
            if head == 0 or head + BLOCK <= place and data[head + 9] in hashing.NAMES:
                return place, head, flags
        at = data.rfind(TRAILER_MAGIC, 0, at + len(TRAILER_MAGIC) - 1)
    return None


def read_block(data: bytes, at: int) -> Block:
    if at + BLOCK > len(data):
        raise ArchiveError("Truncated", f"block at {at}")
    count, following, algo, digest = _BLOCK.unpack_from(data, at)
    end = at + BLOCK + count * ENTRY
    if end > len(data):
        raise ArchiveError("Truncated", f"entries of the block at {at}")
    if algo not in hashing.NAMES:
        raise ArchiveError("UnknownHashAlgo", f"{algo} in the block at {at}")
    block = Block(at, count, following, algo, digest, data[at:end])
    rows = np.frombuffer(data, ENTRIES, count, at + BLOCK)
    for r in rows:
        block.entries.append(Part(int(r["type"]), r["uid"].tobytes(), r["label"].tobytes(), b"", int(r["algo"]), 0, int(r["start"]), int(r["max"]), int(r["used"]), r["hash"].tobytes()))
    return block


def walk(data: bytes, strict: bool = False, base: int = 0) -> Archive:
    """Read an archive. Strict: the first broken rule is raised; otherwise it is noted and what can be read is."""
    found = Archive(len(data))

    def note(severity: str, kind: str, message: str, **detail: object) -> None:
        if strict and severity == "ERROR":
            raise ArchiveError(kind, message)
        found.problems.append((severity, kind, message, {k: str(v) for k, v in detail.items()}))

    if len(data) < HEADER:
        note("ERROR", "Truncated", "shorter than a header", size=len(data))
        return found
    magic, major, minor, pointer = _HEADER.unpack_from(data)
    if magic != MAGIC:
        note("ERROR", "BadMagic", "not an archive")
        return found
    found.version, found.pointer, found.head = (major, minor), pointer, pointer
    if major != VERSION[0]:
        note("ERROR", "UnsupportedMajor", f"version {major}", major=major)
        return found
    if pointer == IN_TRAILER:
        found.head_source, found.head = "trailer", 0
        at = find_trailer(data)
        if at is None:
            note("ERROR", "BadTrailer", "no whole trailer")
            return found
        found.trailer, found.head, flags = at
        found.backward = bool(flags & BACKWARD)
        if found.trailer + TRAILER < len(data):
            note("INFO", "TornTail", "bytes after the last whole trailer", offset=found.trailer + TRAILER)
    at, seen = found.head, set()
    while at:
        if at in seen:
            note("ERROR", "ChainCycle", f"block at {at} again", offset=at)
            break
        seen.add(at)
        try:
            block = read_block(data, at)
        except ArchiveError as e:
            note("ERROR", e.code, str(e), offset=at)
            break
        found.blocks.append(block)
        for slot, p in enumerate(block.entries):
            where = {"block": at, "slot": slot, "uid": p.uid.hex()}
            if p.algo not in hashing.NAMES:
                note("ERROR", "UnknownHashAlgo", f"{p.algo}", **where)
            broken = entry_error(p.type, p.uid, p.used, p.max, p.label)
            if broken:
                note("WARN" if not strict else "INFO", broken, f"entry {slot}", **where)
            if p.start + p.used > len(data):
                note("ERROR", "DataOutOfBounds", f"entry {slot} ends at {p.start + p.used}", **where)
        at = block.next
    return found


def data_of(data: bytes, p: Part) -> bytes:
    """The bytes of a partition; empty where they lie outside the file."""
    return data[p.start : p.start + p.used] if p.start + p.used <= len(data) else b""


def sealed(p: Part, start: int, keep_hash: bool = False) -> Part:
    used = len(p.data)
    return replace(p, start=start, used=used, max=used + p.reserve, hash=p.hash if keep_hash else hashing.field(p.algo, p.data))


def blocks_image(parts: list[Part], at: int, algo: int, capacity: int = BLOCK_ENTRIES) -> bytes:
    """A forward chain of blocks of `capacity` entries that begins at `at`."""
    groups = [parts[i : i + capacity] for i in range(0, len(parts), capacity)] or [[]]
    out = bytearray()
    for k, group in enumerate(groups):
        following = at + len(out) + BLOCK + len(group) * ENTRY if k + 1 < len(groups) else 0
        body = b"".join(p.entry() for p in group)
        head = _BLOCK.pack(len(group), following, algo, bytes(64))
        out += head[:10] + block_hash(algo, head + body) + body
    return bytes(out)


def check_new(parts: list[Part]) -> None:
    """What a writer refuses."""
    seen = set()
    for p in parts:
        if p.type == RESERVED_TYPE:
            raise ArchiveError("ReservedType")
        if p.uid == NIL:
            raise ArchiveError("NilUid")
        if p.uid in seen:
            raise ArchiveError("DuplicateUid", p.uid.hex())
        if decode_label(p.label) is None:
            raise ArchiveError("InvalidLabel")
        if p.algo not in hashing.NAMES:
            raise ArchiveError("UnknownHashAlgo", str(p.algo))
        seen.add(p.uid)


def image(parts: list[Part], algo: int = 16, trailer: bool = False, keep_hashes: bool = False, capacity: int = BLOCK_ENTRIES) -> bytes:
    """A compact archive: header, blocks of `capacity` entries, then data in order."""
    check_new(parts)
    count = max(1, -(-len(parts) // capacity))
    start = HEADER + count * BLOCK + len(parts) * ENTRY
    placed = []
    for p in parts:
        q = sealed(p, start, keep_hashes and bool(p.hash))
        placed.append(q)
        start += q.max
    body = blocks_image(placed, HEADER, algo, capacity) + b"".join(q.data + bytes(q.reserve) for q in placed)
    head = _HEADER.pack(MAGIC, *VERSION, IN_TRAILER if trailer else HEADER)
    return head + body + (_TRAILER.pack(HEADER, 0, bytes(3), TRAILER_MAGIC) if trailer else b"")


def loaded(data: bytes) -> list[Part]:
    """The partitions of a sound archive with their bytes."""
    return [replace(p, data=data_of(data, p)) for p in walk(data, strict=True).parts]


def verify(data: bytes) -> None:
    """Raise the first broken rule in chain order: block hash, then each entry's rules and data hash."""
    found = walk(data, strict=True)
    for block in found.blocks:
        if block.algo and block_hash(block.algo, block.image)[: hashing.LENGTHS[block.algo]] != block.hash[: hashing.LENGTHS[block.algo]]:
            raise ArchiveError("TableHashMismatch", f"block at {block.offset}")
        for p in block.entries:
            broken = entry_error(p.type, p.uid, p.used, p.max, p.label)
            if broken:
                raise ArchiveError(broken, p.uid.hex())
            if not hashing.agrees(p.algo, p.hash, data_of(data, p)):
                raise ArchiveError("DataHashMismatch", p.uid.hex())


def compacted(data: bytes, check: bool = True, allow_log: bool = False) -> bytes:
    """The same partitions in chain order, without slack or dead space. Refuses a versioned tree, whose log it would break."""
    if check:
        verify(data)
    parts = loaded(data)
    if not allow_log and any(p.type == SESSION_TYPE for p in parts):
        raise ArchiveError("VersionedTree", "compact it by its own operator")
    found = walk(data)
    out = image([replace(p, reserve=0) for p in parts], found.blocks[0].algo if found.blocks else 16, keep_hashes=True)
    if check:
        verify(out)
    return out


def added(data: bytes, part: Part) -> bytes:
    parts = _spaced(data)
    return image([*parts, part], walk(data).blocks[0].algo, keep_hashes=True)


def updated(data: bytes, uid: bytes, new: bytes) -> bytes:
    """New bytes for a partition within the space it has."""
    parts = _spaced(data)
    for k, p in enumerate(parts):
        if p.uid == uid:
            if len(new) > p.max:
                raise ArchiveError("DataTooLarge", uid.hex())
            parts[k] = replace(p, data=new, reserve=p.max - len(new), hash=b"")
            return image(parts, walk(data).blocks[0].algo, keep_hashes=True)
    raise ArchiveError("NotFound", uid.hex())


def removed(data: bytes, uid: bytes) -> bytes:
    parts = _spaced(data)
    if all(p.uid != uid for p in parts):
        raise ArchiveError("NotFound", uid.hex())
    return image([p for p in parts if p.uid != uid], walk(data).blocks[0].algo, keep_hashes=True)


def _spaced(data: bytes) -> list[Part]:
    return [replace(p, reserve=max(0, p.max - p.used)) for p in loaded(data)]


def append_session(data: bytes, parts: list[Part], session: Part, algo: int, head: int | None = None) -> bytes:
    """Append data, member blocks and a head block that link backward, and the trailer that publishes them. `head` is the newest block of
    a log that has been read."""
    previous = walk(data, strict=True).head if head is None else head
    out = bytearray(data)
    placed = []
    for p in [session, *parts]:
        placed.append(sealed(p, len(out)))
        out += p.data
    heads = [placed[:BLOCK_ENTRIES]] + [placed[i : i + BLOCK_ENTRIES] for i in range(BLOCK_ENTRIES, len(placed), BLOCK_ENTRIES)]
    for group in reversed(heads):
        head = _BLOCK.pack(len(group), previous, algo, bytes(64))
        body = b"".join(p.entry() for p in group)
        previous = len(out)
        out += head[:10] + block_hash(algo, head + body) + body
    out += _TRAILER.pack(previous, BACKWARD, bytes(3), TRAILER_MAGIC)
    return bytes(out)


def empty_log() -> bytes:
    """A versioned tree without sessions."""
    return _HEADER.pack(MAGIC, *VERSION, IN_TRAILER) + _TRAILER.pack(0, BACKWARD, bytes(3), TRAILER_MAGIC)
