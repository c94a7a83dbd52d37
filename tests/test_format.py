"""Byte layouts: canonical archives, and one test for each rule of readers and writers."""

import hashlib
import random
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratabox.functions import codecs, hashing
from stratabox.sources import format as fmt
from stratabox.sources import records as rec
from stratabox.sources.format import ArchiveError, Part, encode_label


def part(n=1, data=b"x", **more):
    return Part(more.pop("type", 0x10), bytes([n]) * 16, encode_label(f"p{n}"), data, **more)


def canonical():
    return fmt.image([Part(0x10, b"\x11" * 16, encode_label("alpha"), b"Hello, PCF!"), Part(fmt.RAW_TYPE, b"\x22" * 16, encode_label("raw"), bytes(range(8)), 2)])


def test_canonical_archive():
    data = canonical()
    found = fmt.walk(data, strict=True)
    assert len(data) == 395
    assert found.blocks[0].hash[:32].hex() == "f5ebfe8c26b170f7c97cf92ed24cf61e042bbdfac5099bc7801f0e810fc327b6"
    assert [(p.start, p.used) for p in found.parts] == [(376, 11), (387, 8)]
    assert found.parts[1].hash[:4][::-1].hex() == "8a2cbc3b"
    fmt.verify(data)
    assert fmt.compacted(data) == data


def test_canonical_container():
    arena = rec.Arena()
    arena.add(0x10, b"\xa1" * 16, encode_label("A"), b"Hello, World!", 16, 7)
    arena.add(0x10, b"\xb2" * 16, encode_label("B"), b"World!")
    data = fmt.image([Part(fmt.CONTAINER_TYPE, b"\xdc" * 16, encode_label("dcp"), arena.to_bytes(), 0)])
    header, back, blocks = rec.read_container(data[235:])
    assert len(data) == 700 and (header.table, header.used) == (109, 465)
    assert [data[i] for i in (0x12A, 0x13C, 0x157)] == [0, 1, 1]
    assert all(ok for *_, ok in blocks) and [back.content(x) for x in back.inners] == [b"Hello, World!", b"World!"]


def test_canonical_signature():
    p = fmt.sealed(Part(0x10, b"\x11" * 16, encode_label("alpha"), b"Hello, PCF-SIG!"), 0)
    key, payload = rec.sign_parts([p], bytes(range(32)), [p.uid])
    data = fmt.image([p, Part(fmt.KEY_TYPE, b"\x22" * 16, encode_label("pcfkey"), rec.write_key(key)), Part(fmt.SIGNATURE_TYPE, b"\x33" * 16, encode_label("pcfsig"), payload)])
    assert len(data) == 966
    assert hashlib.sha256(data).hexdigest() == "b158e2f5b160d72cea3226af2041f8d18aa75b3db6cb85faeca5df7879871307"


@pytest.mark.parametrize("algo, text, digest", [(1, b"123456789", "2639f4cb"), (2, b"123456789", "839206e3"), (3, b"123456789", "fa3919dfbbc95d99"), (4, b"", hashlib.md5(b"").hexdigest()), (5, b"", hashlib.sha1(b"").hexdigest()), (16, b"", hashlib.sha256(b"").hexdigest()), (17, b"", hashlib.sha512(b"").hexdigest()), (18, b"", "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262")])
def test_known_digests(algo, text, digest):
    got = hashing.field(algo, text)
    assert got[: hashing.LENGTHS[algo]].hex() == digest and len(got) == 64 and not any(got[hashing.LENGTHS[algo] :])


def test_many_digests_are_single_ones():
    rng = random.Random(1)
    data = [rng.randbytes(n) for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 3073, 9000, 17000)] * 2
    for algo in hashing.NAMES:
        assert hashing.digest_many(algo, data) == [hashing.digest_many(algo, [x])[0] for x in data]
    with pytest.raises(hashing.UnknownAlgorithm):
        hashing.field(9, b"")


@pytest.mark.parametrize("bad, code", [(part(type=0), "ReservedType"), (replace(part(), uid=fmt.NIL), "NilUid"), (replace(part(), label=b"\xff" * 32), "InvalidLabel"), (replace(part(), algo=7), "UnknownHashAlgo")])
def test_writer_refuses(bad, code):
    with pytest.raises(ArchiveError) as e:
        fmt.image([bad])
    assert e.value.code == code


def test_writer_refuses_duplicate_uid():
    with pytest.raises(ArchiveError, match="DuplicateUid"):
        fmt.image([part(1), part(1)])


@pytest.mark.parametrize("label", ["x" * 33, "a\0b", "é"])
def test_labels(label):
    with pytest.raises(ArchiveError):
        encode_label(label)
    assert fmt.decode_label(encode_label("y" * 32)) == "y" * 32


def test_header_rules():
    data = canonical()
    for broken, code in ((b"X" + data[1:], "BadMagic"), (data[:8] + b"\x02\0" + data[10:], "UnsupportedMajor"), (data[:10], "Truncated")):
        with pytest.raises(ArchiveError) as e:
            fmt.walk(broken, strict=True)
        assert e.value.code == code
        assert fmt.walk(broken).problems[0][1] == code
    assert fmt.walk(data[:10] + b"\x09\0" + data[12:], strict=True).version == (1, 9)


def test_overflow_chain_and_empty():
    parts = [Part(0x10, n.to_bytes(16, "big"), encode_label(str(n)), b"d%d" % n) for n in range(1, 601)]
    found = fmt.walk(fmt.image(parts), strict=True)
    assert [b.count for b in found.blocks] == [255, 255, 90]
    assert [fmt.data_of(fmt.image(parts), p) for p in found.parts] == [p.data for p in parts]
    assert [b.count for b in fmt.walk(fmt.image([]), strict=True).blocks] == [0]


def test_corruption_is_found():
    data = bytearray(canonical())
    data[380] ^= 1
    with pytest.raises(ArchiveError, match="DataHashMismatch"):
        fmt.verify(bytes(data))
    data = bytearray(canonical())
    data[120] ^= 1
    with pytest.raises(ArchiveError, match="TableHashMismatch"):
        fmt.verify(bytes(data))


def test_torn_tail_and_false_trailers():
    data = fmt.image([part()], trailer=True)
    for tail in (b"\xab" * 500, (5).to_bytes(8, "little") + bytes(4) + fmt.TRAILER_MAGIC, (2**64 - 1).to_bytes(8, "little") + bytes(4) + fmt.TRAILER_MAGIC):
        found = fmt.walk(data + tail, strict=True)
        assert found.head == 20 and found.trailer == len(data) - 20
    with pytest.raises(ArchiveError, match="BadTrailer"):
        fmt.walk(data[:-1], strict=True)


def test_cycle_is_noted():
    data = bytearray(canonical())
    data[21:29] = (20).to_bytes(8, "little")
    assert [p[1] for p in fmt.walk(bytes(data)).problems] == ["ChainCycle"]


def test_update_and_remove():
    data = fmt.image([part(1, b"abc", reserve=4), part(2, b"keep")])
    new = fmt.updated(data, b"\1" * 16, b"1234567")
    fmt.verify(new)
    assert fmt.data_of(new, fmt.walk(new).parts[0]) == b"1234567"
    with pytest.raises(ArchiveError, match="DataTooLarge"):
        fmt.updated(data, b"\1" * 16, b"12345678")
    assert len(fmt.walk(fmt.removed(data, b"\1" * 16)).parts) == 1
    with pytest.raises(ArchiveError, match="NotFound"):
        fmt.removed(data, b"\7" * 16)
    assert len(fmt.compacted(data)) == len(data) - 4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=300), st.sampled_from(list(hashing.NAMES)), st.integers(0, 40)), max_size=12), st.booleans())
def test_round_trip(items, trailer):
    parts = [Part(0x10, (k + 1).to_bytes(16, "big"), encode_label(str(k)), data, algo, reserve) for k, (data, algo, reserve) in enumerate(items)]
    data = fmt.image(parts, trailer=trailer)
    fmt.verify(data)
    assert [p.data for p in fmt.loaded(data)] == [x for x, _, _ in items]


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=400), st.lists(st.tuples(st.integers(0, 400), st.binary(max_size=20)), max_size=6))
def test_patches(base, edits):
    target = bytearray(base)
    for at, piece in edits:
        target[at : at + len(piece) // 2] = piece
    assert codecs.apply_patch(1, base, codecs.make_patch(base, bytes(target))) == bytes(target)


def test_codecs_refuse():
    assert codecs.inflate(1, codecs.deflate(b"a" * 500)) == b"a" * 500
    for bad in (lambda: codecs.inflate(2, b""), lambda: codecs.inflate(1, b"\xff\xff"), lambda: codecs.apply_patch(9, b"", b""), lambda: codecs.apply_patch(1, b"", b"nonsense")):
        with pytest.raises(codecs.CodecError):
            bad()


def test_extent_edits_follow_plain_bytes():
    rng, arena, uid = random.Random(4), rec.Arena(), b"\5" * 16
    arena.add(0x10, uid, encode_label("e"), b"Hello, World!" * 9, size=7)
    plain = bytearray(b"Hello, World!" * 9)
    for _ in range(200):
        at = rng.randint(0, len(plain))
        if rng.random() < 0.5:
            piece = rng.randbytes(rng.randint(0, 9))
            arena.insert(uid, at, piece)
            plain[at:at] = piece
        else:
            n = rng.randint(0, min(9, len(plain) - at))
            arena.delete(uid, at, n)
            del plain[at : at + n]
    inner = arena.find(uid)
    assert arena.content(inner) == bytes(plain)
    arena.defrag()
    assert arena.content(arena.find(uid)) == bytes(plain)
    with pytest.raises(ArchiveError, match="PositionOutOfRange"):
        arena.insert(uid, len(plain) + 1, b"x")


def test_dedup_saves_and_keeps_content():
    arena = rec.Arena()
    for k in (1, 2):
        arena.add(0x10, bytes([k]) * 16, encode_label(str(k)), b"abcabc" * k)
    assert arena.dedup(3) == 15 and [arena.content(x) for x in arena.inners] == [b"abcabc", b"abcabcabcabc"]
    with pytest.raises(ArchiveError, match="NestedContainer"):
        arena.add(fmt.CONTAINER_TYPE, b"\7" * 16, encode_label("n"), b"")
