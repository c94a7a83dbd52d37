"""One versioned tree in memory: its sessions, nodes and contents, and the commits that append to it."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from stratabox.functions import codecs, hashing

from . import format as fmt
from . import records as rec


def normalised(path: str) -> str:
    """Empty components and '.' drop out; '..' is a name like any other."""
    return "/".join(x for x in path.split("/") if x not in ("", "."))


@dataclass(frozen=True)
class Change:
    """op: mkdir, put, mv (to), rm."""

    op: str
    path: str
    data: bytes = b""
    mode: int = 0
    mtime_ms: int = 0
    to: str = ""


@dataclass
class _Log:
    sessions: list[rec.Session] = field(default_factory=list)  # oldest first
    heads: list[fmt.Block] = field(default_factory=list)
    history: dict[bytes, list[tuple[int, rec.Node]]] = field(default_factory=dict)  # by node, oldest first
    raw: dict[bytes, fmt.Part] = field(default_factory=dict)


class TreeLog:
    def __init__(self, data: bytes | None = None, algo: int = 16, compress: bool = True, writer: bytes = b""):
        self.data, self.compress, self.writer = data or fmt.empty_log(), compress, writer
        self.log = self._scan()
        self.algo = self.log.heads[-1].algo if self.log.heads else algo

    def _scan(self) -> _Log:
        found, log, last = fmt.walk(self.data, strict=True), _Log(), None
        self.head, at = found.head, 0
        while at < len(found.blocks):
            head = found.blocks[at]
            own = [p for p in head.entries if p.type == fmt.SESSION_TYPE]
            rec.require(len(own) == 1, "BadSession", f"{len(own)} session records in the block at {head.offset}")
            s = rec.read_session(fmt.data_of(self.data, own[0]))
            rec.require(last is None or s.seq < last, "SessionOrder", str(s.seq))
            last = s.seq
            group = found.blocks[at : at + s.block_count]
            rec.require(len(group) == s.block_count, "Truncated", "session blocks")
            rec.require(all(p.type != fmt.SESSION_TYPE for b in group[1:] for p in b.entries), "BadSession", "a session record in a member block")
            for n in self._nodes(self.data, group):
                log.history.setdefault(n.node_id, []).append((s.seq, n))
            log.raw.update((p.uid, p) for b in group for p in b.entries)  # newest first, so the oldest stays
            log.sessions.append(s)
            log.heads.append(head)
            at += s.block_count
        for found_newest_first in (log.sessions, log.heads, *log.history.values()):
            found_newest_first.reverse()
        return log

    @staticmethod
    def _nodes(data: bytes, group: list[fmt.Block]) -> list[rec.Node]:
        """The node records of a session's blocks."""
        nodes = [rec.read_node(fmt.data_of(data, p)) for b in group for p in b.entries if p.type == fmt.NODE_TYPE]
        seen = set()
        for n in nodes:
            rec.require(n.node_id not in seen, "DuplicateNode", n.node_id.hex())
            seen.add(n.node_id)
        return nodes

    # --- reading

    def current(self, as_of: int | None = None) -> dict[bytes, rec.Node]:
        out = {}
        for node_id, versions in self.log.history.items():
            kept = [n for seq, n in versions if as_of is None or seq <= as_of]
            if kept:
                out[node_id] = kept[-1]
        return out

    def paths(self, as_of: int | None = None) -> dict[str, bytes]:
        """Live paths (the root is '')."""
        now = self.current(as_of)
        root = now.get(rec.ROOT)
        if root is not None and root.tombstone:
            return {}
        live = {rec.ROOT}
        children: dict[bytes, list[bytes]] = {}
        for node_id, n in now.items():
            if node_id != rec.ROOT and not n.tombstone and n.parent_id != node_id:
                children.setdefault(n.parent_id, []).append(node_id)
        self._check_cycles(now)
        newest = {i: v[-1][0] if as_of is None else max(s for s, _ in v if s <= as_of) for i, v in self.log.history.items() if i in now}
        out, queue = {"": rec.ROOT}, [("", rec.ROOT)]
        while queue:
            path, node_id = queue.pop()
            by_name: dict[bytes, bytes] = {}
            for c in children.get(node_id, ()):
                other = by_name.get(now[c].name)
                if other is None or (-newest[c], c) < (-newest[other], other):
                    by_name[now[c].name] = c
            for name in sorted(by_name):
                c = by_name[name]
                full = f"{path}/{name.decode('utf-8', 'replace')}".lstrip("/")
                out[full] = c
                live.add(c)
                if now[c].kind == rec.DIRECTORY:
                    queue.append((full, c))
        return out

    @staticmethod
    def _check_cycles(now: dict[bytes, rec.Node]) -> None:
        for start, n in now.items():
            if n.tombstone:
                continue
            at, seen = start, set()
            while at in now and at != rec.ROOT and now[at].parent_id != at and not now[at].tombstone:
                rec.require(at not in seen, "ParentCycle", at.hex())
                seen.add(at)
                at = now[at].parent_id

    def content(self, node_id: bytes, as_of: int | None = None) -> bytes:
        versions = [n.content for seq, n in self.log.history.get(node_id, ()) if n.content is not None and (as_of is None or seq <= as_of)]
        rec.require(bool(versions), "NotFound", node_id.hex())
        return replay(list(reversed(versions)), lambda uid: self._stored(uid))

    def _stored(self, uid: bytes) -> bytes:
        p = self.log.raw.get(uid)
        rec.require(p is not None, "NotFound", uid.hex())
        data = fmt.data_of(self.data, p)
        rec.require(hashing.agrees(p.algo, p.hash, data), "DataHashMismatch", uid.hex())
        return data

    def read(self, path: str, as_of: int | None = None) -> bytes:
        paths, want = self.paths(as_of), normalised(path)
        rec.require(want in paths, "NotFound", want)
        rec.require(want == "" or self.current(as_of)[paths[want]].kind == rec.FILE, "IsADirectory", want)
        return self.content(paths[want], as_of)

    def session_at(self, ts_ms: int) -> int:
        return max((s.seq for s in self.log.sessions if s.ts_ms <= ts_ms), default=0)

    def verify(self) -> None:
        """The container's rules, the session chain, and that the tree builds."""
        fmt.verify(self.data)
        self.verify_log(fmt.walk(self.data, strict=True))

    def verify_log(self, found: fmt.Archive) -> None:
        """The session chain over the archive's blocks, and that the tree builds."""
        by_offset = {b.offset: k for k, b in enumerate(found.blocks)}
        older = None
        for s, head in zip(self.log.sessions, self.log.heads, strict=True):
            k = by_offset[head.offset]
            members = [b.hash for b in found.blocks[k + 1 : k + s.block_count]]
            n = hashing.LENGTHS[s.member_algo]
            rec.require(rec.member_digest(s.member_algo, members)[:n] == s.member_digest[:n], "MemberDigest", str(s.seq))
            if older is None:
                rec.require(s.prev_algo == 0 and s.prev_hash == bytes(64), "SessionChain", str(s.seq))
            else:
                n = hashing.LENGTHS[older.algo]
                rec.require(s.prev_algo == older.algo and s.prev_hash[:n] == older.hash[:n], "SessionChain", str(s.seq))
            older = head
        self.paths()

    # --- writing

    def commit(self, parts: list[fmt.Part], changes: int, ts_ms: int = 0, uid: bytes | None = None) -> None:
        """Append one session with these partitions."""
        seq = self.log.sessions[-1].seq + 1 if self.log.sessions else 1
        head = self.log.heads[-1] if self.log.heads else None
        count = -(-(len(parts) + 1) // fmt.BLOCK_ENTRIES)
        session = rec.Session(seq, ts_ms, head.algo if head else 0, head.hash if head else bytes(64), count, self.algo if count > 1 else 0, bytes(64), min(changes, 65535), self.writer)
        uid = uid or self._uid(b"session", seq)
        label = fmt.encode_label("session")
        written = lambda: fmt.append_session(self.data, parts, fmt.Part(fmt.SESSION_TYPE, uid, label, rec.write_session(session)), self.algo, self.head)
        made = written()
        if count > 1:  # members' hashes don't depend on the session record's bytes, only on its length
            hashes = [b.hash for b in self._appended(made, count)[1:]]
            session = rec.Session(seq, ts_ms, session.prev_algo, session.prev_hash, count, self.algo, rec.member_digest(self.algo, hashes), session.change_count, self.writer)
            made = written()
        group = self._appended(made, count)
        nodes = self._nodes(made, group)
        self.data, self.head = made, group[0].offset
        for n in nodes:
            self.log.history.setdefault(n.node_id, []).append((seq, n))
        for p in (p for b in group for p in b.entries):
            self.log.raw.setdefault(p.uid, p)
        self.log.sessions.append(session)
        self.log.heads.append(group[0])

    @staticmethod
    def _appended(data: bytes, count: int) -> list[fmt.Block]:
        """The blocks of the session that was published last."""
        group, at = [], fmt.find_trailer(data)[1]
        for _ in range(count):
            group.append(fmt.read_block(data, at))
            at = group[-1].next
        return group

    def _uid(self, *what: object) -> bytes:
        """Ids from what they name and how far the log has come: the same input gives the same archive."""
        return hashlib.md5(b"\x1f".join(x if isinstance(x, bytes) else str(x).encode() for x in (len(self.data), *what))).digest()

    def node_part(self, n: rec.Node) -> fmt.Part:
        return fmt.Part(fmt.NODE_TYPE, self._uid(b"node", n.node_id), fmt.encode_label("node"), rec.write_node(n), self.algo)

    def make_root(self, ts_ms: int = 0) -> None:
        self.commit([self.node_part(rec.Node(rec.DIRECTORY, rec.ROOT, rec.ROOT, b""))], 1, ts_ms)

    def apply(self, changes: list[Change], ts_ms: int = 0) -> int:
        """One session for all changes: directories by depth, then files and moves, then removals deepest first. Files whose bytes are as
        they were are passed over; without a change there is no session. Returns the number of records."""
        paths, now = self.paths(), self.current()
        parts: list[fmt.Part] = []
        nodes: dict[bytes, rec.Node] = {}
        depth = lambda c: normalised(c.path).count("/")
        order = sorted((c for c in changes if c.op == "mkdir"), key=depth) + [c for c in changes if c.op in ("put", "mv")] + sorted((c for c in changes if c.op == "rm"), key=depth, reverse=True)

        def parent_of(path: str) -> tuple[bytes, bytes]:
            above, _, name = path.rpartition("/")
            rec.require(above in paths, "NotFound", above)
            p = nodes.get(paths[above]) or now.get(paths[above])
            rec.require(above == "" or p.kind == rec.DIRECTORY, "NotADirectory", above)
            rec.require(rec.valid_name(name.encode()), "InvalidPath", path)
            return paths[above], name.encode()

        for c in order:
            path = normalised(c.path)
            if c.op == "mkdir":
                if path in paths:
                    rec.require(path == "" or (nodes.get(paths[path]) or now[paths[path]]).kind == rec.DIRECTORY, "NotADirectory", path)
                    continue
                parent, name = parent_of(path)
                node_id = self._uid(b"dir", path)
                nodes[node_id] = rec.Node(rec.DIRECTORY, node_id, parent, name, 0, c.mtime_ms, c.mode)
                paths[path] = node_id
            elif c.op == "put":
                parent, name = parent_of(path)
                node_id = paths.get(path)
                old = nodes.get(node_id) or now.get(node_id) if node_id else None
                rec.require(old is None or old.kind == rec.FILE, "IsADirectory", path)
                before = self.content(node_id) if old is not None and node_id not in nodes else None
                if before == c.data:
                    continue
                node_id = node_id or self._uid(b"file", path)
                content, stored = self._choose(node_id, before, c.data)
                if stored is not None:
                    parts.append(stored)
                nodes[node_id] = rec.Node(rec.FILE, node_id, parent, name, 0, c.mtime_ms, c.mode, content)
                paths[path] = node_id
            elif c.op == "mv":
                rec.require(path in paths and path != "", "NotFound", path)
                to = normalised(c.to)
                rec.require(to not in paths, "AlreadyExists", to)
                rec.require(not f"{to}/".startswith(f"{path}/"), "InvalidPath", to)
                parent, name = parent_of(to)
                node_id = paths[path]
                n = nodes.get(node_id) or now[node_id]
                content = rec.Content(rec.INHERIT) if n.kind == rec.FILE and node_id not in nodes else n.content
                nodes[node_id] = rec.Node(n.kind, node_id, parent, name, 0, n.mtime_ms, n.mode, content)
                moved = {p: i for p, i in paths.items() if p == path or p.startswith(f"{path}/")}
                for p, i in moved.items():
                    del paths[p]
                    paths[to + p[len(path) :]] = i
            elif c.op == "rm":
                rec.require(path in paths and path != "", "NotFound", path)
                n = nodes.get(paths[path]) or now[paths[path]]
                nodes[paths[path]] = rec.Node(n.kind, n.node_id, n.parent_id, n.name, rec.TOMBSTONE)
                for p in [p for p in paths if p == path or p.startswith(f"{path}/")]:
                    del paths[p]
            else:
                raise ValueError(c.op)
        if not nodes:
            return 0
        self.commit(parts + [self.node_part(n) for n in nodes.values()], len(nodes), ts_ms)
        return len(nodes)

    def _choose(self, node_id: bytes, before: bytes | None, data: bytes) -> tuple[rec.Content, fmt.Part | None]:
        """EMPTY; DELTA where the patch is smaller and the chain short; else DIRECT. Packed only where that is smaller."""
        if not data:
            return rec.Content(rec.EMPTY), None
        digest = hashing.field(self.algo, data)
        if before:
            depth = delta_depth([n.content for _, n in reversed(self.log.history[node_id]) if n.content is not None])
            patch = codecs.make_patch(before, data)
            if len(patch) < len(data) and depth < rec.MAX_DELTAS:
                form, stored = self._packed(patch)
                uid = self._uid(b"patch", node_id)
                c = rec.Content(rec.DELTA, form, codecs.VCDIFF, uid, len(data), self.algo, digest, len(before), self.algo, hashing.field(self.algo, before))
                return c, fmt.Part(fmt.RAW_TYPE, uid, fmt.encode_label("patch"), stored, self.algo)
        form, stored = self._packed(data)
        uid = self._uid(b"content", node_id)
        return rec.Content(rec.DIRECT, form, 0, uid, len(data), self.algo, digest), fmt.Part(fmt.RAW_TYPE, uid, fmt.encode_label("content"), stored, self.algo)

    def _packed(self, data: bytes) -> tuple[int, bytes]:
        small = codecs.deflate(data) if self.compress else data
        return (codecs.DEFLATED, small) if len(small) < len(data) else (codecs.STORED, data)

    def compacted(self) -> bytes:
        """The live tree in one session, without history; the root's own metadata goes."""
        self.verify()
        paths, now = self.paths(), self.current()
        fresh = TreeLog(algo=self.algo, compress=self.compress, writer=self.writer)
        changes = [Change("put" if now[i].kind == rec.FILE else "mkdir", p, self.content(i) if now[i].kind == rec.FILE else b"", now[i].mode, now[i].mtime_ms) for p, i in paths.items() if p]
        if changes:
            fresh.apply(changes)
        return fresh.data


def delta_depth(newest_first: list[rec.Content]) -> int:
    depth = 0
    for c in newest_first:
        if c.kind in (rec.EMPTY, rec.DIRECT):
            break
        depth += 1
    return depth


def replay(newest_first: list[rec.Content], stored) -> bytes:
    """The content of the newest version. stored(uid) gives a partition's bytes, checked."""
    depth = delta_depth(newest_first)
    rec.require(depth <= rec.STOP_DELTAS, "DeltaTooDeep", str(depth))
    rec.require(depth < len(newest_first), "NoBase")
    base = newest_first[depth]
    data = b""
    if base.kind == rec.DIRECT:
        data = checked(codecs.inflate(base.compression, stored(base.uid)), base.size, base.algo, base.hash)
    for c in reversed(newest_first[:depth]):
        if c.kind == rec.DELTA:
            checked(data, c.base_size, c.base_algo, c.base_hash)
            data = checked(codecs.apply_patch(c.patch, data, codecs.inflate(c.compression, stored(c.uid))), c.size, c.algo, c.hash)
    return data


def checked(data: bytes, size: int, algo: int, digest: bytes) -> bytes:
    rec.require(len(data) == size, "SizeMismatch", f"{len(data)} for {size}")
    rec.require(hashing.agrees(algo, digest, data), "FullHashMismatch")
    return data
