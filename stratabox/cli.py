"""Command line over archives on local paths: python -m stratabox.cli COMMAND FILE ..."""

from __future__ import annotations

import argparse
import os
import stat
import sys
import tempfile
from dataclasses import replace

from stratabox.functions import codecs, hashing
from stratabox.operators import decode, rewrite
from stratabox.operators.report import Report
from stratabox.sources import format as fmt
from stratabox.sources import records as rec
from stratabox.sources import signing
from stratabox.sources.tree_log import Change, TreeLog, normalised


def load(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def save(path: str, data: bytes, mode: int | None = None) -> None:
    """Beside the target, flushed, then renamed over it; a failure leaves the target as it was."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, beside = tempfile.mkstemp(dir=folder, prefix=".new-")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.chmod(beside, mode if mode is not None else stat.S_IMODE(os.stat(path).st_mode) if os.path.exists(path) else 0o644)
        os.replace(beside, path)
        folder_handle = os.open(folder, os.O_RDONLY)
        os.fsync(folder_handle)
        os.close(folder_handle)
    except BaseException:
        if os.path.exists(beside):
            os.remove(beside)
        raise


def parse_uid(text: str) -> bytes:
    """32 hex digits (dashes and spaces aside), or 0xNN for sixteen times NN."""
    digits = text.replace("-", "").replace(" ", "")
    if digits.lower().startswith("0x") and len(digits) == 4:
        return bytes.fromhex(digits[2:]) * 16
    if len(digits) != 32:
        raise ValueError(f"not a uid: {text}")
    return bytes.fromhex(digits)


def inspect(a: argparse.Namespace) -> None:
    data = load(a.file)
    found = fmt.walk(data)
    print(f"{a.file}: {found.size} bytes, version {found.version}, head {found.head} ({found.head_source})")
    for b in found.blocks:
        ok = "" if a.no_verify else " ok" if not b.algo or fmt.block_hash(b.algo, b.image)[: hashing.LENGTHS[b.algo]] == b.hash[: hashing.LENGTHS[b.algo]] else " HASH MISMATCH"
        print(f"block {b.offset}: {b.count} entries, next {b.next}, {hashing.NAMES[b.algo]}{ok}")
        for p in b.entries:
            good = "" if a.no_verify or p.algo not in hashing.NAMES else " ok" if hashing.agrees(p.algo, p.hash, fmt.data_of(data, p)) else " HASH MISMATCH"
            print(f"  {p.type:08x} {p.uid.hex()} {fmt.decode_label(p.label) or '?':<32} {p.start:>10} {p.used:>10} of {p.max}{good}")
    for severity, kind, message, _ in found.problems:
        print(f"{severity} {kind}: {message}")


def decode_command(a: argparse.Namespace) -> None:
    data, registry = load(a.file), decode.Registry()
    for p in fmt.walk(data).parts:
        if p.uid.hex().startswith(a.uid.lower()) and a.label in (fmt.decode_label(p.label) or ""):
            print(f"{p.uid.hex()} {fmt.decode_label(p.label)}")
            for _, (path, value, _, _, note) in registry.nested(p.type, fmt.data_of(data, p), a.decoder):
                shown = value.hex() if isinstance(value, bytes) else value
                print(f"{'  ' * len(path)}{path[-1]}: {shown}{f' ({note})' if note else ''}")


def verify(a: argparse.Namespace) -> None:
    data = load(a.file)
    if any(p.type == fmt.SESSION_TYPE for p in fmt.walk(data).parts):
        TreeLog(data).verify()
    fmt.verify(data)
    print("ok")


def compact(a: argparse.Namespace) -> None:
    data = load(a.file)
    target = a.output or a.file
    if a.output and os.path.exists(a.output) and (os.path.samefile(a.output, a.file) or not a.force):
        raise FileExistsError(a.output)
    out = fmt.compacted(data, not a.no_verify, a.allow_log)
    save(target, out)
    if not a.quiet:
        print(f"{len(data)} -> {len(out)} bytes")


def _tree(a: argparse.Namespace, change: list[Change] | None = None) -> TreeLog:
    log = TreeLog(load(a.file))
    if change is not None:
        log.apply(change, a.ts)
        save(a.file, log.data)
    return log


def mkfs(a: argparse.Namespace) -> None:
    if os.path.exists(a.file):
        raise FileExistsError(a.file)
    log = TreeLog()
    log.make_root(a.ts)
    save(a.file, log.data)


def ls(a: argparse.Namespace) -> None:
    for path in sorted(_tree(a).paths(a.at)):
        print("  " * path.count("/") + (path.rpartition("/")[2] or "/"))


def log_command(a: argparse.Namespace) -> None:
    for s in reversed(_tree(a).log.sessions):
        print(s.seq, s.block_count, s.change_count, s.ts_ms, s.writer.decode("utf-8", "replace"))


def cat(a: argparse.Namespace) -> None:
    sys.stdout.buffer.write(_tree(a).read(a.path, a.at))


def host_files(folder: str) -> list[Change]:
    """A directory as changes; symbolic links and special files are passed over."""
    out = []
    for d, dirs, names in os.walk(folder):
        dirs[:] = sorted(x for x in dirs if not os.path.islink(os.path.join(d, x)))
        here = os.path.relpath(d, folder)
        for name in dirs + sorted(names):
            full, path = os.path.join(d, name), normalised(os.path.join(here, name))
            s = os.lstat(full)
            if stat.S_ISDIR(s.st_mode):
                out.append(Change("mkdir", path, b"", s.st_mode & 0o7777, int(s.st_mtime * 1000)))
            elif stat.S_ISREG(s.st_mode):
                out.append(Change("put", path, load(full), s.st_mode & 0o7777, int(s.st_mtime * 1000)))
    return out


def update(a: argparse.Namespace) -> None:
    log = TreeLog(load(a.file))
    changes = host_files(a.path)
    if a.delete:
        held, gone = {normalised(c.path) for c in changes}, set()
        for path in sorted(log.paths()):
            if path and path not in held and not any(path.startswith(f"{x}/") for x in gone):
                gone.add(path)
        changes += [Change("rm", p) for p in gone]
    log.apply(changes, a.ts)
    save(a.file, log.data)


def extract(a: argparse.Namespace) -> None:
    log = _tree(a)
    at = log.session_at(a.time) if a.time is not None else a.at
    now, late = log.current(at), []
    for path, node_id in sorted(log.paths(at).items()):
        target, n = os.path.join(a.path, path), now.get(node_id)
        if path == "" or n.kind == rec.DIRECTORY:
            os.makedirs(target, exist_ok=True)
            late.append((target, n))
        else:
            with open(target, "wb") as f:
                f.write(log.content(node_id, at))
            restore(target, n)
    for target, n in reversed(late):
        restore(target, n)


def restore(target: str, n: rec.Node | None) -> None:
    if n and n.mode:
        os.chmod(target, n.mode & 0o7777)
    if n and n.mtime_ms:
        os.utime(target, (n.mtime_ms / 1000, n.mtime_ms / 1000))


def tree_compact(a: argparse.Namespace) -> None:
    save(a.file, _tree(a).compacted())


def keygen(a: argparse.Namespace) -> None:
    if os.path.exists(a.file) or os.path.exists(f"{a.file}.pub"):
        raise FileExistsError(a.file)
    seed = os.urandom(32)
    save(a.file, seed, 0o600)
    save(f"{a.file}.pub", codecs.public_key(seed))


def sign(a: argparse.Namespace) -> None:
    """Plain archives and versioned trees alike."""
    data, done = signing.signed(load(a.file), load(a.key), [parse_uid(x) for x in a.uid] or None, a.ts, a.resign, a.key_label, a.sig_label)
    if not done:
        print("nothing to sign")
        return
    save(a.file, data)
    print(f"signed {len(done)}")


def verify_signatures(a: argparse.Namespace) -> None:
    reports = signing.reports(load(a.file), not a.no_recheck)
    for r in reports:
        print(r.verdict, r.fingerprint.hex(), r.reason or "")
        for uid, v in r.entries:
            print(f"  {uid.hex()} {v}")
    good = bool(reports) and all(r.verdict == "Valid" and all(e == "Valid" for _, e in r.entries) for r in reports)
    if a.key:
        trusted = rec.Key(1, load(a.key)).fingerprint
        good = good and any(r.verdict == "Valid" and r.fingerprint == trusted for r in reports)
    if not good:
        raise SystemExit(1)


def keys_command(a: argparse.Namespace) -> None:
    data = load(a.file)
    for p in fmt.walk(data).parts:
        if p.type == fmt.KEY_TYPE:
            try:
                k = rec.read_key(fmt.data_of(data, p))
            except fmt.ArchiveError:
                continue
            print(p.uid.hex(), rec.KEY_FORMATS[k.format], k.fingerprint.hex())


def dedup(a: argparse.Namespace) -> None:
    """Containers: cut anew (--fixed) or drop dead bytes alone (--defrag)."""
    data, parts, saved = load(a.file), [], 0
    for p in fmt.loaded(data):
        if p.type == fmt.CONTAINER_TYPE:
            _, arena, _ = rec.read_container(p.data)
            saved += arena.defrag() if a.defrag else arena.dedup(a.fixed)
            p = replace(p, data=arena.to_bytes(), hash=b"")
        parts.append(p)
    out = fmt.image(parts, keep_hashes=True)
    fmt.verify(out)
    save(a.file, out)
    print(f"saved {saved} bytes")


def container_info(a: argparse.Namespace) -> None:
    """Of each container its inner partitions: uid, label, bytes, extents; and what sharing saves."""
    for p in fmt.loaded(load(a.file)):
        if p.type == fmt.CONTAINER_TYPE:
            _, arena, _ = rec.read_container(p.data)
            stored = arena.distinct_bytes()
            print(f"{p.uid.hex()} {len(arena.inners)} inner, {stored} bytes for {sum(x.length for x in arena.inners)}")
            for x in arena.inners:
                print(f"  {x.uid.hex()} {x.used:>10} {len(x.extents):>6} {fmt.decode_label(x.label) or ''}")


def promote(a: argparse.Namespace) -> None:
    save(a.file, rewrite.promoted_image(load(a.file), {parse_uid(x) for x in a.uid}))


def demote(a: argparse.Namespace) -> None:
    save(a.file, rewrite.demoted_image(load(a.file), {parse_uid(x) for x in a.uid}, parse_uid(a.container) if a.container else None, a.fixed))


def get(a: argparse.Namespace) -> None:
    """A file of a tree, to a path."""
    save(a.output or os.path.basename(a.path), _tree(a).read(a.path, a.at))


def create(a: argparse.Namespace) -> None:
    """A new tree of a folder."""
    if os.path.exists(a.file):
        raise FileExistsError(a.file)
    mkfs(a)
    a.delete = False
    update(a)


def shown(part: str):
    def run(a: argparse.Namespace) -> None:
        report = Report(load(a.file), not getattr(a, "no_verify", False))
        if part == "hexdump":
            span = None
            if a.range:
                low, _, size = a.range.partition("+")
                span = (int(low, 0), int(low, 0) + int(size, 0) if size else len(report.data))
            lines = report.hexdump_lines(a.region, span, a.max)
        elif part == "html":
            save(a.output, report.html(a.file).encode())
            return
        else:
            lines = getattr(report, f"{part}_lines")()
        print("\n".join(lines))

    return run


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="stratabox", description=__doc__)
    sub = top.add_subparsers(required=True)

    def command(name: str, run, *more: tuple, path: bool = False) -> None:
        p = sub.add_parser(name)
        p.add_argument("file")
        if path:
            p.add_argument("path")
        for names, options in more:
            p.add_argument(*names, **options)
        p.set_defaults(run=run)

    flag = lambda *names: (names, {"action": "store_true"})
    at, ts = (("--at",), {"type": int}), (("--ts",), {"type": int, "default": 0})
    command("inspect", inspect, flag("--no-verify"))
    command("decode", decode_command, (("--uid",), {"default": ""}), (("--label",), {"default": ""}), (("--decoder",), {}))
    command("layout", shown("layout"))
    command("table", shown("table"), flag("--no-verify"))
    command("chain", shown("chain"), flag("--no-verify"))
    command("findings", shown("finding"))
    command("hexdump", shown("hexdump"), (("--region",), {"default": ""}), (("--range",), {"default": "", "help": "FROM+SIZE"}), (("--max",), {"type": int}))
    command("html", shown("html"), (("--output",), {"required": True}), flag("--no-verify"))
    command("verify", verify)
    command("compact", compact, (("--output",), {}), flag("--quiet"), flag("--force"), flag("--no-verify"), flag("--allow-log"))
    command("mkfs", mkfs, ts)
    command("create", create, ts, path=True)
    command("get", get, at, (("--output",), {}), path=True)
    command("info", container_info)
    command("promote", promote, (("--uid",), {"action": "append", "required": True}))
    command("demote", demote, (("--uid",), {"action": "append", "required": True}), (("--container",), {}), (("--fixed",), {"type": int, "default": 0}))
    command("ls", ls, at)
    command("log", log_command)
    command("cat", cat, at, path=True)
    command("mkdir", lambda a: _tree(a, [Change("mkdir", a.path)]), ts, path=True)
    command("put", lambda a: _tree(a, [Change("put", a.path, load(a.source))]), (("source",), {}), ts, path=True)
    command("mv", lambda a: _tree(a, [Change("mv", a.path, to=a.to)]), (("to",), {}), ts, path=True)
    command("rm", lambda a: _tree(a, [Change("rm", a.path)]), ts, path=True)
    command("update", update, flag("--delete"), ts, path=True)
    command("extract", extract, at, (("--time",), {"type": int}), path=True)
    command("compact-tree", tree_compact)
    command("keygen", keygen)
    command("sign", sign, (("--key",), {"required": True}), (("--uid",), {"action": "append", "default": []}), flag("--resign"), ts, (("--key-label",), {"default": "key"}), (("--sig-label",), {"default": "signature"}))
    command("verify-sig", verify_signatures, (("--key",), {}), flag("--no-recheck"))
    command("keys", keys_command)
    command("dedup", dedup, (("--fixed",), {"type": int, "default": 0}), flag("--defrag"))
    a = top.parse_args(argv)
    try:
        a.run(a)
    except (ValueError, OSError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
