"""Versioned trees: commits, time travel, replay, chains, and the rules that break them."""

import pytest

from stratabox.sources import format as fmt
from stratabox.sources import records as rec
from stratabox.sources.format import ArchiveError
from stratabox.sources.tree_log import Change, TreeLog

V1 = b"Hello, tree! " * 32
V2 = V1 + b"...and now, hello world!\n"


def made():
    log = TreeLog()
    log.make_root()
    log.apply([Change("mkdir", "docs"), Change("put", "docs/hello.txt", V1)], 10)
    log.apply([Change("put", "docs/hello.txt", V2)], 20)
    log.apply([Change("mv", "docs", to="documents"), Change("rm", "documents/hello.txt")], 30)
    return log


def test_history():
    log = made()
    log.verify()
    assert set(log.paths()) == {"", "documents"}
    assert log.read("docs/hello.txt", 3) == V2 and log.read("docs/hello.txt", 2) == V1
    assert [log.session_at(t) for t in (0, 15, 99)] == [1, 2, 4]
    kinds = [n.content.kind for _, h in log.log.history.items() for _, n in h if n.content]
    assert kinds == [rec.DIRECT, rec.DELTA]


def test_commits_only_append():
    log = TreeLog()
    log.make_root()
    before = log.data
    log.apply([Change("put", "f", b"1")])
    assert log.data.startswith(before)
    same = log.data
    assert log.apply([Change("put", "f", b"1")]) == 0 and log.data == same


def test_torn_commit_is_not_seen():
    log = made()
    torn = TreeLog(log.data)
    torn.apply([Change("put", "late", b"x")])
    cut = torn.data[:-7]
    assert set(TreeLog(cut).paths()) == set(log.paths())


def test_large_session_has_member_blocks():
    log = TreeLog()
    log.make_root()
    log.apply([Change("put", f"f{i}", b"") for i in range(600)])
    assert log.log.sessions[-1].block_count == 3
    log.verify()
    assert len(log.paths()) == 601


def test_delta_chains_are_rebased():
    log = TreeLog()
    log.make_root()
    text = b"line of some length, to be patched\n" * 8
    for k in range(40):
        log.apply([Change("put", "f", text + b"%d" % k)])
    contents = [n.content.kind for _, h in log.log.history.items() for _, n in h if n.content]
    assert contents.count(rec.DIRECT) == 3 and log.read("f") == text + b"39" and log.read("f", 11) == text + b"9"


def test_move_keeps_content_and_delete_hides_what_is_below():
    log = TreeLog()
    log.make_root()
    log.apply([Change("mkdir", "a"), Change("put", "a/f", b"data")])
    log.apply([Change("mv", "a/f", to="g")])
    assert log.read("g") == b"data"
    log.apply([Change("mkdir", "a/b"), Change("put", "a/b/f", b"x")])
    log.apply([Change("rm", "a")])
    assert set(log.paths()) == {"", "g"}


def test_compaction_drops_history():
    log = made()
    log.apply([Change("put", "documents/new", b"n"), Change("put", "blank", b"")])
    small = TreeLog(log.compacted())
    small.verify()
    assert {p: small.read(p) for p in ("documents/new", "blank")} == {"documents/new": b"n", "blank": b""}
    assert len(small.log.sessions) == 1 and set(small.paths()) == set(log.paths())


@pytest.mark.parametrize("change, code", [(Change("put", "no/f", b""), "NotFound"), (Change("put", "documents", b""), "IsADirectory"), (Change("rm", "zz"), "NotFound"), (Change("mv", "documents", to="documents/x"), "InvalidPath"), (Change("put", "..", b""), "InvalidPath")])
def test_refusals(change, code):
    with pytest.raises(ArchiveError) as e:
        made().apply([change])
    assert e.value.code == code


def test_cycles_and_duplicates_are_errors():
    log = TreeLog()
    log.make_root()
    a, b = b"\1" * 16, b"\2" * 16
    log.commit([log.node_part(rec.Node(rec.DIRECTORY, a, b, b"a")), log.node_part(rec.Node(rec.DIRECTORY, b, a, b"b"))], 2)
    with pytest.raises(ArchiveError, match="ParentCycle"):
        log.paths()
    twice = [fmt.Part(fmt.NODE_TYPE, bytes([9 + k]) * 16, fmt.encode_label("node"), rec.write_node(rec.Node(rec.DIRECTORY, a, rec.ROOT, b"x"))) for k in (0, 1)]
    log = TreeLog()
    with pytest.raises(ArchiveError, match="DuplicateNode"):
        log.commit(twice, 2)


def test_names_collide_later_session_wins():
    log = TreeLog()
    log.make_root()
    for k in (1, 2):
        log.commit([log.node_part(rec.Node(rec.DIRECTORY, bytes([k]) * 16, rec.ROOT, b"dup"))], 1)
    assert log.paths()["dup"] == b"\2" * 16 and log.paths(2)["dup"] == b"\1" * 16


@pytest.mark.parametrize("name", [b"", b"a/b", b".", b"..", b"n\0", b"x" * 1025])
def test_names(name):
    with pytest.raises(ArchiveError):
        rec.read_node(rec.write_node(rec.Node(rec.DIRECTORY, b"\1" * 16, rec.ROOT, name)))


def test_tampering_breaks_the_chain():
    log = made()
    data = bytearray(log.data)
    at = fmt.walk(log.data).blocks[-1].offset + 100
    data[at] ^= 1
    with pytest.raises(ArchiveError):
        TreeLog(bytes(data)).verify()


def test_compacting_a_tree_as_a_plain_archive_is_refused():
    with pytest.raises(ArchiveError, match="VersionedTree"):
        fmt.compacted(made().data)


def test_long_parent_cycles(spark):
    from stratabox.operators import tree

    name = lambda k: k.to_bytes(16, "big")
    rows = []
    for path, size in (("a", 2), ("b", 8), ("c", 100)):
        rows += [(path, name(k), name((k + 1) % size), False) for k in range(size)]
        rows += [(path, name(1000 + k), name(1001 + k if k < 20 else 0), False) for k in range(21)]  # a tail that leads into the cycle
    rows += [("d", name(k), name(k + 1), False) for k in range(150)]  # a chain to a root that is no node
    rows += [("e", name(1), name(99), False), ("f", name(1), name(2), True), ("f", name(2), name(1), False)]
    nodes = spark.createDataFrame(rows, "path string, node_id binary, parent_id binary, tombstone boolean")
    got = sorted((r["path"], int.from_bytes(r["node_id"], "big")) for r in tree.parent_cycles(nodes).collect())
    assert got == [(p, k) for p, size in (("a", 2), ("b", 8), ("c", 100)) for k in range(size)]


def test_live_over_a_million_nodes(spark):
    """1,050,000 nodes in 1,000 trees: a root, a directory below it, files in that, one in fifty of them removed."""
    from pyspark.sql import functions as F

    from stratabox.operators import tree

    k = F.pmod("id", F.lit(1050))
    uid = lambda n: F.unhex(F.lpad(F.hex(n), 32, "0"))
    nodes = spark.range(1_050_000).select(
        F.concat(F.lit("t"), F.floor(F.col("id") / 1050).cast("string")).alias("path"), uid(k).alias("node_id"), uid(F.when(k < 2, 0).otherwise(1).cast("long")).alias("parent_id"),
        F.when(k < 2, rec.DIRECTORY).otherwise(rec.FILE).cast("short").alias("kind"), ((k > 1) & (k % 50 == 0)).alias("tombstone"), F.lit(1).cast("long").alias("session_seq"),
        F.when(k == 0, "").otherwise(F.concat(F.lit("n"), k.cast("string"))).alias("name"),
    ).withColumn("name_raw", F.encode("name", "UTF-8"))
    assert bytes(16) == rec.ROOT
    found = tree.live(nodes).groupBy("depth").count().collect()
    assert {r["depth"]: r["count"] for r in found} == {0: 1000, 1: 1000, 2: 1_028_000}


def test_many_sessions_are_all_read(spark):
    """5,000 sessions, a block each: nothing is left out, and the verdicts say so."""
    from stratabox.operators import integrity, tree
    from stratabox.sources.archive import view

    log = TreeLog()
    log.make_root()
    for k in range(4999):
        log.commit([], 0, k)
    a = spark.createDataFrame([("log", bytearray(log.data))], "path string, content binary")
    assert view(a, "sessions").count() == 5000
    assert tuple(integrity.verify(a).first())[:3] == ("log", 5000, 5001) and integrity.verify(a).first()["first_error"] is None
    assert tuple(integrity.verify_trees(a).first()) == ("log", 5000, 1, None)
    assert tree.chain_verdicts(view(a, "sessions")).filter("not linked or not members_ok").count() == 0


def test_commits_leave_what_a_scan_would_find():
    log = made()
    log.apply([Change("put", f"f{i}", b"x" * i) for i in range(300)])
    again = TreeLog(log.data)
    assert [s.seq for s in again.log.sessions] == [s.seq for s in log.log.sessions] and again.log.history == log.log.history
    assert set(again.log.raw) == set(log.log.raw) and again.head == log.head and again.paths() == log.paths()


def test_signed_trees_still_verify():
    from stratabox.sources import signing

    log, seed = made(), bytes(range(32))
    data, covered = signing.signed(log.data, seed)
    assert data.startswith(log.data) and len(covered) == sum(p.type in signing.TREE_TYPES for p in fmt.walk(log.data).parts)
    tree = TreeLog(data)
    tree.verify()
    assert set(tree.paths()) == set(log.paths())
    assert [(r.verdict, {v for _, v in r.entries}) for r in signing.reports(data, True)] == [("Valid", {"Valid"})]
    assert signing.signed(data, seed) == (data, [])  # nothing new
    tree.apply([Change("put", "late", b"more")])
    more, added = signing.signed(tree.data, seed)
    assert len(added) == 2 and sum(p.type == fmt.KEY_TYPE for p in fmt.walk(more).parts) == 1
    both, again = signing.signed(more, seed, resign=True)
    assert len(again) == len(covered) + 2 and len(signing.reports(both)) == 3


@pytest.mark.parametrize("change, verdict", [("self", ("Invalid", "self_reference")), ("algorithm", ("Unverifiable", "unsupported_algorithm")), ("signature", ("Invalid", "bad_signature")), ("key", ("Unverifiable", "no_matching_key")), ("junk", ("Unverifiable", "malformed"))])
def test_signature_gates_of_both_verifiers(spark, change, verdict):
    """The kernel and the DataFrame operators follow one rule."""
    from dataclasses import replace

    from stratabox.functions import codecs
    from stratabox.operators import signatures
    from stratabox.sources import signing
    from stratabox.sources.archive import view

    seed = bytes(range(32))
    parts = [fmt.sealed(fmt.Part(0x10, b"\1" * 16, fmt.encode_label("a"), b"data"), 0)]
    key, payload = rec.sign_parts(parts, seed, [b"\1" * 16])
    if change == "self":
        m = rec.read_signature(payload).manifest
        body = rec.write_manifest(replace(m, entries=(replace(m.entries[0], uid=b"\3" * 16),)))
        payload = rec.write_signature(body, codecs.sign(seed, body))
    elif change == "algorithm":
        payload = payload[:12] + b"\2" + payload[13:]
    elif change == "signature":
        payload = payload[:-5] + bytes([payload[-5] ^ 1]) + payload[-4:]
    elif change == "junk":
        payload = b"junk"
    made = parts + ([] if change == "key" else [fmt.Part(fmt.KEY_TYPE, b"\2" * 16, fmt.encode_label("key"), rec.write_key(key))])
    data = fmt.image([*made, fmt.Part(fmt.SIGNATURE_TYPE, b"\3" * 16, fmt.encode_label("sig"), payload)])
    a = spark.createDataFrame([("x", bytearray(data))], "path string, content binary")
    row = signatures.manifest_verdicts(view(a, "signatures"), view(a, "keys"), view(a, "signed_entries")).first()
    own = signing.reports(data)[0]
    assert (row["verdict"], row["reason"]) == (own.verdict, own.reason)
    assert change == "algorithm" or (own.verdict, own.reason) == verdict
    assert own.verdict != "Valid"


def test_reopened_containers_share_what_they_have():
    arena = rec.Arena()
    arena.add(0x10, b"\1" * 16, fmt.encode_label("a"), b"abcabc", size=3)
    again = rec.read_container(arena.to_bytes())[1]
    again.add(0x10, b"\2" * 16, fmt.encode_label("b"), b"abcxyz", size=3)
    third = rec.read_container(again.to_bytes())[1]
    assert third.distinct_bytes() == 6 and [third.content(x) for x in third.inners] == [b"abcabc", b"abcxyz"]
    assert all(e.flags & rec.SHARED for x in third.inners for e in x.extents if third.content(x)[:3] == b"abc" and e.offset == third.inners[0].extents[0].offset)


def test_reports():
    from stratabox.operators.report import Report

    data = fmt.image([fmt.Part(0x10, b"\1" * 16, fmt.encode_label("<a>"), b"some data", reserve=4)])
    report = Report(data + b"tail")
    lines = list(report.layout_lines())
    assert [x.split()[2] for x in lines[1:]] == ["header", "tableheader", "entries", "data", "slack", "gap"]
    assert "ok" in next(report.table_lines()) and "ok" in next(report.chain_lines())
    assert list(report.finding_lines()) == [f"INFO  Gap: 4 bytes at {len(data)}"] and set(report.strip()) <= set("HTED_.")
    assert list(report.hexdump_lines("data"))[1].endswith("|some data|") and list(report.hexdump_lines(span=(0, 20), most=16))[-1] == "... 4 more bytes"
    page = report.html("x & y")
    assert page.startswith("<!DOCTYPE html>") and "&lt;a&gt;" in page and "x &amp; y" in page
    broken = Report(b"\0" * 50)
    assert any("BadMagic" in x for x in broken.finding_lines()) and "<html" in broken.html("broken")
