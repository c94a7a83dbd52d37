"""Verdicts on whole files: archives, versioned trees, dynamic containers. Each file is read once, where its bytes are, and each gets
a verdict, whatever is wrong with it."""

from __future__ import annotations

from collections.abc import Iterator

from stratabox.functions import hashing

from . import format as fmt
from . import records as rec
from .tree_log import TreeLog

SCHEMAS = {
    "verdicts": "path string, blocks long, entries long, bad_blocks long, bad_entries long, first_error string, file_error string",
    "tree_verdicts": "path string, sessions long, nodes long, error string",
    "container_verdicts": "path string, containers long, inners long, error string",
}


def entry_errors(data: bytes, entries: list[fmt.Part]) -> list[str | None]:
    """The first rule that each entry breaks. Digests are made algorithm by algorithm."""
    errors = [fmt.entry_error(p.type, p.uid, p.used, p.max, p.label) for p in entries]
    by_algo: dict[int, list[int]] = {}
    for k, p in enumerate(entries):
        if errors[k] is None:
            if p.algo not in hashing.NAMES:
                errors[k] = "UnknownHashAlgo"
            elif p.start + p.used > len(data):
                errors[k] = "DataOutOfBounds"
            else:
                by_algo.setdefault(p.algo, []).append(k)
    for algo, places in by_algo.items():
        n = hashing.LENGTHS[algo]
        for k, made in zip(places, hashing.digest_many(algo, [fmt.data_of(data, entries[k]) for k in places]), strict=True):
            if entries[k].hash[:n] != made[:n]:
                errors[k] = "DataHashMismatch"
    return errors


def archive_verdict(path: str, data: bytes, found: fmt.Archive) -> Iterator[tuple]:
    """first_error is the first in chain order, a block before its entries; file_error is what ends the chain early (or keeps it from
    beginning) and comes after what was read."""
    first, bad_blocks, bad_entries = None, 0, 0
    for block in found.blocks:
        n = hashing.LENGTHS[block.algo]
        if fmt.block_hash(block.algo, block.image)[:n] != block.hash[:n]:
            bad_blocks += 1
            first = first or "TableHashMismatch"
        for error in entry_errors(data, block.entries):
            bad_entries += error is not None
            first = first or error
    file_error = next((kind for severity, kind, _, detail in found.problems if severity == "ERROR" and "slot" not in detail), None)
    yield path, len(found.blocks), sum(len(b.entries) for b in found.blocks), bad_blocks, bad_entries, first or file_error, file_error


def first_error(path: str, data: bytes, found: fmt.Archive) -> str | None:
    return next(archive_verdict(path, data, found))[5]


def tree_verdict(path: str, data: bytes, found: fmt.Archive) -> Iterator[tuple]:
    """The archive's rules, then sessions in order, their chain of hashes, one record a node and session, no parent cycles."""
    error, log = first_error(path, data, found), None
    if error is None:
        try:
            log = TreeLog(data)
            log.verify_log(found)
        except fmt.ArchiveError as e:
            error = e.code
    yield path, len(log.log.sessions) if log else 0, len(log.log.history) if log else 0, error


def container_verdict(path: str, data: bytes, found: fmt.Archive) -> Iterator[tuple]:
    """The archive's rules, then of each container its inner blocks' hashes, its records, uids that the file has nowhere else, and each
    content's length and hash."""
    error, containers, inners = first_error(path, data, found), 0, 0
    seen = set()
    for p in found.parts:
        error = error or ("DuplicateUid" if p.uid in seen else None)
        seen.add(p.uid)
    for p in found.parts:
        if p.type != fmt.CONTAINER_TYPE:
            continue
        containers += 1
        try:
            _, arena, blocks = rec.read_container(fmt.data_of(data, p))
            inners += len(arena.inners)
            rec.require(all(b[3] for b in blocks), "TableHashMismatch", "inner block")
            for x in arena.inners:
                rec.require(x.uid not in seen, "DuplicateUid", x.uid.hex())
                seen.add(x.uid)
                content = arena.content(x)
                rec.require(len(content) == x.used, "SizeMismatch", x.uid.hex())
                rec.require(hashing.agrees(x.algo, x.hash, content), "DataHashMismatch", x.uid.hex())
        except fmt.ArchiveError as e:
            error = error or e.code
    yield path, containers, inners, error


VIEWS = {"verdicts": archive_verdict, "tree_verdicts": tree_verdict, "container_verdicts": container_verdict}
