"""Operators that bring documents together: n-gram Jaccard join, substring dedup, nearest vectors, sharding, LM scores, pipeline."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stratabox.llm import ann, attention, common, graph, jaccard, lm_score, sharding, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None, "k", "n") for i, t in rows], SCHEMA)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# --- n-gram Jaccard


def brute_components(rows):
    sets = []
    for i, t in rows:
        w = common.words_of(t, lower=True)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = {i: i for i, _ in rows if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if rows[a][0] is not None and rows[b][0] is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((root(rows[a][0]), root(rows[b][0])))
                up[q] = p
    return [(i, len(s), None if i is None else root(i)) for (i, _), s in zip(rows, sets)]


def copies(rng, base, n, edits):
    for _ in range(n):
        words = base.split()
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        yield " ".join(words)


def near_rows(seed=1):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    passage = " ".join(word() for _ in range(60))
    texts = [None, "", "   ", "One two", "one TWO", "one two three four five"]
    for _ in range(6):
        base = " ".join(word() for _ in range(rng.choice([12, 60, 200])))
        texts += list(copies(rng, base, 12, max(1, len(base.split()) // 40))) + [base, base.upper()]
    texts += [f"{passage} " + " ".join(word() for _ in range(rng.choice([5, 20, 150]))) for _ in range(30)]
    texts += [" ".join(word() for _ in range(rng.randint(1, 120))) for _ in range(40)]
    rng.shuffle(texts)
    return [(k * 3 % 997, t) for k, t in enumerate(texts)] + [(None, "one two"), (None, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_is_exact(spark, seed):
    rows = near_rows(seed)
    got = sorted(map(str, ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join_groups(docs_of(spark, rows)).collect())))
    assert got == sorted(map(str, brute_components(rows)))


def test_jaccard_join_in_small_chunks(spark, monkeypatch):
    """Chunks and bands of a few rows give what large ones give."""
    for name, value in (("CHUNK_DOCS", 3), ("CHUNK_ROWS", 4), ("FAMILY_DOCS", 2)):
        monkeypatch.setattr(jaccard, name, value)
    rows = near_rows(3)
    got = sorted(map(str, ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join_groups(docs_of(spark, rows), most_shared=0).collect())))
    assert got == sorted(map(str, brute_components(rows)))


def test_jaccard_repeated_and_empty(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (2, "x y z"), (3, "x y z"), (4, None)]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join_groups(docs_of(spark, rows)).collect())
    assert got == Counter({(1, 2, 1): 2, (2, 2, 1): 1, (2, 1, 1): 1, (3, 1, 1): 1, (4, 0, 4): 1})
    assert jaccard.join_groups(docs_of(spark, [])).count() == 0
    kept = jaccard.keep_first(docs_of(spark, rows[:3] + [(5, None), (None, "a b c d e f")]))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "5", "None"]


def test_tree_bound_loses_nothing():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 3000, rng.integers(1, 400)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(80)]
    sets += [np.unique(np.concatenate([s[: int(len(s) * 0.95)], rng.integers(0, 2**62, 3).astype(np.uint64)])) for s in sets]
    points, sizes = np.stack([jaccard.unpacked(jaccard.packed_point(s)) for s in sets]), np.array([len(s) for s in sets])
    tree = jaccard.CountTree(points, sizes)
    for i, s in enumerate(sets):
        found = set(tree.search(points[i], len(s)).tolist())
        assert {j for j, other in enumerate(sets) if jaccard.linked(s, other)} <= found


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, k) for k in range(5001, 5100)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        up[q] = p
    made = graph.components(spark.createDataFrame(edges, "a long, b long"), common.Scratch(spark, "t"))
    got = {r["node"]: r["component"] for r in made.collect()}
    assert got == {x: root(x) for x in got} and {x for e in edges if e[0] != e[1] for x in e} == set(got)


# --- substring dedup


def brute_removed(rows, window):
    first = {}
    for i, t in rows:
        w = common.words_of(t)
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w, gone = common.words_of(t), set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def passage_rows(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(6))
    shared = [" ".join(word() for _ in range(n)) for n in (12, 15, 20, 60)]
    rows = []
    for k in range(70):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30)))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), " ".join(word() for _ in range(rng.randint(0, 12)))]
        rows.append((k * 7 % 101, "  ".join(parts)))
    rows += [(200 + k, rows[k][1]) for k in range(5)] + [(300, None), (301, ""), (302, "a0 " * 40), (303, "a0 " * 40), (None, rows[0][1])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_is_exact(spark, seed):
    rows = passage_rows(seed)
    got = sorted(map(str, map(tuple, substring_dedup.removal_digests(docs_of(spark, rows), 12).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())))
    assert got == sorted(map(str, brute_removed(rows, 12)))


def test_substring_dedup_repeated_rows(spark):
    text = " ".join(f"w{k}" for k in range(20))
    rows = [(1, text), (1, text), (2, text), (1, "x y")]
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.removal_digests(docs_of(spark, rows), 12).collect())
    assert got == Counter({(1, 20, 0): 2, (2, 20, 20): 1, (1, 2, 0): 1})
    assert substring_dedup.removal_digests(docs_of(spark, []), 12).count() == 0


def test_cut_leaves_the_rest_as_it_is(spark):
    passage = " ".join(f"p{k}" for k in range(14))
    rows = [(1, f"Start\n{passage}\nend"), (2, f"  Other \t text\n{passage}\n\nlast  words "), (3, " clean  as\tis "), (4, None), (5, f"Start\n{passage}\nend")]
    docs = docs_of(spark, rows)
    cut = {r["doc_id"]: r for r in substring_dedup.cut_repeats(docs, 12).collect()}
    assert [cut[k]["text"] for k in (1, 2, 3, 4, 5)] == [rows[0][1], "  Other \t text\nlast  words ", " clean  as\tis ", None, ""]
    assert cut[2]["n_chars"] == len(cut[2]["text"]) and cut[3]["n_chars"] == len(rows[2][1])
    assert substring_dedup.cut_repeats(docs, 12).columns == docs.columns


def test_window_hashes_tell_runs_apart():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 4, 400).astype(np.uint64)
    for size in (1, 2, 5, 12, 25, 50):
        got = common.windows(words, size)
        seen = {}
        for k in range(len(words) - size + 1):
            assert seen.setdefault(tuple(words[k : k + size].tolist()), got[k]) == got[k]
        assert len(set(seen.values())) == len(seen)
    assert len(common.windows(words[:3], 5)) == 0


# --- nearest vectors


def test_nearest(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((1500, 12)).astype(np.float32) + 2 * rng.standard_normal((6, 12)).astype(np.float32)[rng.integers(0, 6, 1500)]
    x[40:340] = x[40]  # one vector in a fifth of all rows
    rows = [(k, [float(v) for v in x[k]], k % 3, "v") for k in range(1500)]
    odd = [(2000, None, 0, "v"), (2020, [0.0] * 12, 0, "v"), (2040, [None] + [1.0] * 11, 0, "v"), (2060, [float("nan")] * 12, 0, "v"), (2080, [float("inf")] + [0.0] * 11, 0, "v"), (2100, [1.0], 0, "v"), (None, [1.0] * 12, 0, "v"), (2120, [], 0, "v")]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, code string")
    got = {}
    for r in ann.nearest(vectors, lambda i: i % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = x.astype(np.float64)
    assert set(got) == set(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        order = [k for k in np.lexsort((np.arange(1500), -np.round(s, 9))) if k != q][:20]
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(v != q and math.isclose(score, s[v], rel_tol=1e-12, abs_tol=1e-12) for _, v, score in found)
        assert [(-score, v) for _, v, score in found] == sorted((-score, v) for _, v, score in found)
        hits += len({v for _, v, _ in found} & set(order))
    assert hits >= 0.9 * 20 * len(got)
    few = vectors.filter("vec_id < 3")
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(few, lambda i: i >= 0, target=0.999).collect() if r["rank"] == 1)
    assert ann.nearest(vectors.limit(0), lambda i: i >= 0).count() == 0


def test_nearest_reaches_target_at_millions_of_rows():
    """The visited buckets hold the promised share of near vectors, however many hashes the row count calls for."""
    rng = np.random.default_rng(5)
    for rows, alike in ((1_400_000, 0.29), (4_000_000, 0.35), (117_000_000, 0.3)):
        made = ann.Tables(64, rows, 1.0)
        q = rng.standard_normal((12, 64))
        lifted = made.lifted(q, True)
        hits = 0
        for (codes, span), own in zip(made.probes(lifted, 0, np.full(12, alike)), lifted, strict=True):
            aside = rng.standard_normal((300, 65))
            aside -= (aside @ own)[:, None] * own
            near = alike * own + math.sqrt(1 - alike**2) * aside / np.linalg.norm(aside, axis=1, keepdims=True)
            first = made.codes(near, 0) // span * span
            hits += np.isin(first, codes).sum()
        assert hits >= 0.48 * 12 * 300, (rows, hits / 3600)


@pytest.mark.parametrize("kind", ["one long vector", "lognormal"])
def test_nearest_uneven_norms(spark, kind):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1500, 24)) + 1.2 * rng.standard_normal((20, 24))[rng.integers(0, 20, 1500)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "lognormal":
        x *= rng.lognormal(0, 0.5, (1500, 1))
    else:
        x[7] *= 3
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(vectors, lambda i: i % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = sum(len(got[q] & set([k for k in np.argsort(-(x @ x[q]), kind="stable") if k != q][:20])) for q in range(0, 1500, 20))
    assert all(len(v) == 20 for v in got.values()) and hits >= 0.93 * 20 * 75, hits / 1500


def test_nearest_returns_all_of_few(spark):
    """With fewer candidates than TOP all come back, by the default target."""
    x = np.random.default_rng(9).standard_normal((15, 16))
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]) for r in ann.nearest(vectors, lambda i: i >= 0).collect()}
    assert got == {(a, b) for a in range(15) for b in range(15) if a != b}


def test_nearest_of_huge_and_repeated(spark):
    """Components near the ends of the doubles lose nobody; rows that repeat an id are candidates each."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((120, 8))
    for scale in (1e22, 1e-22, 1e120):
        rows = [(k, (v * scale).tolist()) for k, v in enumerate(x)]
        got = {}
        for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 40 == 0, target=0.9999).collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        for q in (0, 40, 80):
            want = [k for k in np.argsort(-(x @ x[q]), kind="stable").tolist() if k != q][:20]
            assert len(got[q]) == 20 and len(set(got[q]) & set(want)) >= 18, scale
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (1, [0.8, 0.2]), (1, [0.8, 0.2]), (0, [0.5, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in ann.nearest(twice, lambda i: i == 0).collect())
    assert got == sorted([(0, 1, 1, 0.9), (0, 2, 1, 0.8), (0, 3, 1, 0.8), (0, 4, 0, 0.5), (0, 1, 0, 0.5), (0, 2, 1, 0.45), (0, 3, 1, 0.4), (0, 4, 1, 0.4)])


def test_best_of_cell_loses_nobody():
    """Long vectors whose products with the queries are small, held against scoring all in double precision."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((400, 16)) * 1e5
    q = rng.standard_normal((6, 16))
    q -= ((q @ x[:3].T) @ np.linalg.pinv(x[:3].T))
    codes = np.zeros(400, np.int64)
    found_q, found_r, found_s = ann.best_of_cell(np.arange(400), np.arange(400), codes, x, np.arange(1000, 1006), [np.zeros(1, np.int64)] * 6, np.ones(6, np.int64), q, np.full(6, -np.inf), 20)
    for k in range(6):
        want = np.argsort(-(x @ q[k]), kind="stable")[:20]
        assert set(found_r[found_q == 1000 + k].tolist()) == set(want.tolist())


# --- sharding


def test_shards_fit(spark):
    rng = random.Random(3)
    rows = [(k, "x" * rng.randint(0, 200)) for k in range(800)] + [(5000, "y" * 5000), (5001, None), (None, "n" * 10)] + [(9, "same row")] * 40 + [(7000, f"t{k}" * 30) for k in range(60)]
    docs = docs_of(spark, rows)
    got = sharding.assign_shards(docs, limit_bytes=1000, step=3).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["n_bytes"]
    assert all(r["shard_bytes"] == sizes[r["shard"]] and r["oversized"] == (sizes[r["shard"]] > 1000) for r in got)
    names = sorted(sizes)
    assert not any(b.startswith(a) for a in names for b in names if a != b)  # a directory: no bucket inside another
    assert {r["doc_id"] for r in got if r["oversized"]} == {5000}
    for name in names:  # only buckets that don't fit are split
        if name:
            assert sum(n for other, n in sizes.items() if other.startswith(name[:-1])) > 1000
    once = sharding.assign_shards(docs, limit_bytes=1000).collect()
    assert sorted(map(str, once)) == sorted(map(str, got))
    assert sharding.assign_shards(docs.limit(0)).count() == 0


# --- language model


def test_attention_slopes():
    """Backward against finite differences."""
    rng = np.random.default_rng(2)
    model = attention.Attention(12, 5, 6, 2, rng.standard_normal((12, 5)) * 0.1, width=4)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    s, y = rng.integers(0, 12, (3, 6)), rng.integers(0, 5, (3, 6))
    y[0, 4:] = -1

    def loss():
        model.__dict__.pop("held", None)
        return -float(model.log_probs(s, y).sum(dtype=np.float64)) / (y >= 0).sum()

    slopes = model.slopes(s, y)
    for name, value in model.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in value.shape)
            if name == "e":
                at = (int(s.ravel()[at[0] % 18]), at[1])
            old, eps = value[at], 1e-2
            value[at] = old + eps
            high = loss()
            value[at] = old - eps
            low = loss()
            value[at] = old
            assert math.isclose((high - low) / (2 * eps), slopes[name][at], rel_tol=0.05, abs_tol=2e-4)


def test_attention_slopes_of_late_windows(monkeypatch):
    """Places that another window scores get no odds; slopes stay those of the finite differences, members included."""
    monkeypatch.setattr(attention, "CELLS", 36)  # a window at a time
    rng = np.random.default_rng(5)
    members = {3: np.array([2, 5, 7]), 4: np.array([1, 9])}
    model = attention.Attention(12, 5, 6, 2, rng.standard_normal((12, 5)) * 0.1, width=4, members=members, weight=np.ones(12))
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    s, y = rng.integers(0, 12, (6, 6)), rng.integers(0, 5, (6, 6))
    y[[1, 2, 4], :2] = -1
    z = np.full(y.shape, -1)
    for c, own in members.items():
        z[y == c] = rng.choice(own, (y == c).sum())
    assert sorted(skip for _, skip in model.chunks(y)) == [0, 0, 0, 2, 2, 2]

    def loss():
        model.__dict__.pop("held", None)
        return -float(model.log_probs(s, y, z).sum(dtype=np.float64)) / (y >= 0).sum()

    slopes = model.slopes(s, y, z)
    for name, value in model.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in value.shape)
            old, eps = value[at], 1e-2
            value[at] = old + eps
            high = loss()
            value[at] = old - eps
            low = loss()
            value[at] = old
            assert math.isclose((high - low) / (2 * eps), slopes[name][at], rel_tol=0.05, abs_tol=2e-4), name


def test_attention_of_steep_odds():
    """Odds too large for exponentials of single precision are neither cut nor lost."""
    rng = np.random.default_rng(7)
    model = attention.Attention(20, 5, 6, 2, np.zeros((20, 5)), width=4, members={4: np.arange(3, 9)}, weight=np.ones(20))
    for name, by in (("e", 12), ("q", 4), ("k", 4), ("o", 60), ("m", 60)):
        model.p[name] *= np.float32(by)
    slots, classes = rng.integers(0, 20, 15), rng.integers(0, 5, 15)
    members = np.where(classes == 4, rng.integers(3, 9, 15), -1)
    want = 0.0
    for at, (c, member) in enumerate(zip(classes, members, strict=True)):
        _, h, p = chances(model, context_of(model, slots, 6, 2, at))
        for odds, place in ((h @ p["o"] + p["b"], c), (p["m"][3:9] @ h + p["mb"][3:9], member - 3)):
            if place >= 0:
                want += odds[place] - odds.max() - math.log(np.exp(odds - odds.max()).sum())
    got = model.sums(slots, classes, np.array([15]), members)
    assert want < -100 and math.isclose(got[0], want, rel_tol=2e-3), (got, want)
    at, scored, _ = model.windows(np.array([15]))
    slopes = model.slopes(slots[at], np.where(scored, classes[at], -1), np.where(scored, members[at], -1))
    assert all(np.isfinite(x).all() for x in slopes.values())


def test_windows_score_each_token_once():
    model = attention.Attention(10, 4, 8, 3, np.zeros((10, 4)))
    lengths = np.array([1, 0, 8, 9, 40, 13])
    at, scored, owner = model.windows(lengths)
    assert sorted(at[scored].tolist()) == list(range(int(lengths.sum())))
    starts = np.concatenate(([0], np.cumsum(lengths)))
    for row, keep, o in zip(at, scored, owner):
        for k in np.flatnonzero(keep):
            assert k >= 3 or row[k] - k == starts[o]  # context of three, but for a sequence's beginning


def test_lm_scores(spark):
    import public_tokenizers

    rng = random.Random(4)
    # two languages: the words before tell which one a text is in, which counts alone can't use
    first = [f"{a}{b}" for a in ("tha", "ion", "ent", "her", "ing") for b in ("re", "st", "al", "or")]
    second = [f"{a}{b}" for a in ("schu", "ber", "kei", "gra", "zwo") for b in ("tz", "lich", "ung", "den")]
    texts = [" ".join(rng.choice(first if k % 2 else second) for _ in range(rng.randint(1, 60))) for k in range(150)] + [None, "", "THARE thare unheardofword", "x" * 3000, "tha re"]
    rows = list(enumerate(texts)) + [(None, "thare")]
    got = {r["doc_id"]: r for r in lm_score.score_texts(docs_of(spark, rows), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()}
    assert len(got) == len(rows)
    c, held = Counter(), {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    tokens = {i: common.words_of(t, lower=True) + [lm_score.END] for i, t in rows}
    for i, w in tokens.items():
        if not held[i]:
            c.update(w)
    N, V = sum(c.values()), len(c)
    for i, w in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(w), sum(c[x] > 0 for x in w), N)
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 0.5) / (N + 0.5 * (V + 1))) for x in w), rel_tol=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])
    out = [i for i in tokens if held[i] and i is not None and i < 150]
    assert sum(got[i]["score"] for i in out) > sum(got[i]["base_score"] for i in out)
    assert lm_score.score_texts(docs_of(spark, []), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def learned(spark, texts):
    import public_tokenizers

    subwords = lm_score.Subwords(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    own = spark.createDataFrame([(k, False, t) for k, t in enumerate(texts)], "doc_id long, held_out boolean, text string")
    model, words = lm_score.learn(own, subwords, 50_257, common.Scratch(spark, "t"))
    return model, {bytes(r["word"]): r for r in words.collect()}, subwords


def context_of(model, slots, window, overlap, at):
    """The slots that a token at a place sees: its window begins with what the one before has scored."""
    step = window - overlap
    k = 0 if at < window else (at - overlap) // step
    return slots[k * step : at + 1]


def chances(net, context):
    """A direct forward pass in double precision: class probabilities, and the state they come from."""
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = p["e"][context]
    q, k, v = x @ p["q"], x @ p["k"], x @ p["v"]
    score = q[-1] @ k.T / math.sqrt(net.width) + p["r"][len(context) - 1 - np.arange(len(context))]
    a = np.exp(score - score.max())
    h = x[-1] + (a / a.sum()) @ v
    logits = h @ p["o"] + p["b"] + net.prior[context[-1]]
    prob = np.exp(logits - logits.max())
    return prob / prob.sum(), h, p


def test_lm_score_by_hand(spark):
    """The whole score of some texts against the definition, token by token."""
    rng = random.Random(9)
    base = [f"{a}{b}" for a in ("tha", "ion", "ent", "her", "schu", "zwo", "gra", "x") for b in ("re", "st", "al", "or", "tz")]
    texts = [" ".join(rng.choice(base) for _ in range(rng.randint(1, 90))) for _ in range(60)] + ["", None, "one " * 70]
    model, words, subwords = learned(spark, texts)
    probe = [texts[0], "thare unheardof zwotz", "", "her " * 75 + "grast"]
    got = model.text_log10([np.array([i[0] for i in subwords.ids(lm_score.words_of(t))], np.int64) for t in probe])
    for t, total in zip(probe, got, strict=True):
        leads = [i[0] for i in subwords.ids(lm_score.words_of(t))]
        slots, want = np.array([0, *(model.slot[i] for i in leads)]), 0.0
        for at, lead in enumerate([*leads, None]):
            prob, h, p = chances(model.text, context_of(model, slots, 32, 8, at))
            c = 0 if lead is None else int(model.cls[lead])
            want += math.log10(prob[c])
            if c in model.members:
                own = model.members[c]
                inner = np.exp(p["m"][own] @ h + p["mb"][own])
                want += math.log10(inner[own == model.slot[lead]].sum() / inner.sum())
            elif c == lm_score.CLASSES - 1:
                want += float(model.log_lead[lead]) / math.log(10)
        assert math.isclose(total, want, rel_tol=2e-3, abs_tol=2e-3), t
    spelled = model.spell_log10([[5, 9], [5], [300, 301, 302]])
    for subs, total in zip(([5, 9], [5], [300, 301, 302]), spelled, strict=True):
        slots, want = model.slot[np.array(subs)], 0.0
        for at, following in enumerate([*subs[1:], None]):
            prob, _, _ = chances(model.spell, context_of(model, slots, 8, 4, at))
            c = 0 if following is None else int(model.spell_class[following])
            want += math.log10(prob[c]) + (0 if following is None else float(model.log_within[following]) / math.log(10))
        assert math.isclose(total, want, rel_tol=2e-3, abs_tol=2e-3)
    # each part is a distribution
    rest = model.cls == lm_score.CLASSES - 1
    assert np.isclose(np.exp(model.log_lead[rest].astype(np.float64)).sum(), 1, atol=1e-3)
    assert np.allclose(np.bincount(model.spell_class, np.exp(model.log_within), lm_score.SPELL_CLASSES)[np.unique(model.spell_class)], 1, atol=1e-3)
    assert words[lm_score.END]["c"] == len(texts)
    ends = model.text_log10([np.empty(0, np.int64)] * 3)  # no word anywhere, so no class has a member to look for
    assert np.allclose(ends, ends[0]) and -20 < ends[0] < 0


def test_lm_windows_cover_all_documents(spark):
    """With a share of one every token of every text is scored in one training window; with more, windows of all lengths of text come in."""
    import public_tokenizers

    subwords = lm_score.Subwords(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = [" ".join(f"w{k}" for k in range(n)) for n in (0, 1, 31, 32, 33, 500, 4000)] + [None]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    wins = lm_score.text_windows(docs, subwords, 1, "a").toArrow().column(0).combine_chunks()
    _, targets = lm_score.unpacked(wins)
    assert (targets != lm_score.NONE).sum() == sum(len(common.words_of(t)) + 1 for t in texts)
    some = lm_score.text_windows(docs, subwords, 16, "b").count()
    assert abs(some - len(wins) / 16) <= len(texts)


def test_lm_counts_every_token(spark, monkeypatch):
    """The tables of odds are sums over all training tokens and all subwords of training words, however many windows there are."""
    rng, sums, real = random.Random(6), [], lm_score.prior_of
    monkeypatch.setattr(lm_score, "FEW_WINDOWS", 4)
    monkeypatch.setattr(lm_score, "prior_of", lambda seen, classes: sums.append((classes, int(seen.sum()))) or real(seen, classes))
    base = [f"{a}{b}" for a in ("tha", "ion", "ent", "her", "schu", "zwo") for b in ("re", "st", "al", "or", "tz")]
    texts = [" ".join(rng.choice(base) for _ in range(rng.randint(1, 400))) for _ in range(40)] + ["", None]
    _, words, subwords = learned(spark, texts)
    assert dict(sums) == {
        lm_score.CLASSES: sum(len(common.words_of(t)) + 1 for t in texts),
        lm_score.SPELL_CLASSES: sum(len(x) for x in subwords.ids([w for w in words if w != lm_score.END])),
    }


def test_lm_steps_hold_every_window():
    rng = np.random.default_rng(3)
    for sizes in ([], [0], [5], [8, 8], [1, 30, 0, 7, 16, 3]):
        cuts = np.cumsum([0, *sizes])
        parts = [(np.arange(low, high), rng.random((high - low, 2))) for low, high in zip(cuts[:-1], cuts[1:])]
        steps = list(lm_score.dealt(iter(parts), 8))
        assert [k for step in steps for k in step[0].tolist()] == list(range(int(cuts[-1])))
        assert all(len(step[0]) == 8 == len(step[1]) for step in steps[:-1])


def test_lm_words_coded_together():
    """Subwords of many words by one call of the encoder, but for words that hold white space of their own, are those of each word."""
    import public_tokenizers

    subwords, rng = lm_score.Subwords(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), random.Random(8)
    plain = ["it's", "'s", "x" * 500, "a,b...", "1,000.5", "\x00", "日本語", "é", "🙂!", "thare"]
    odd = ["a\xa0", "\xa0b", "\x85", "\u2003\u2003x", "\u3000", "\x1cy", "a\u2028\u2029"]
    some = ["".join(rng.choice("ab'1, \xa0\u2003é,日\x1f").replace(" ", "") for _ in range(rng.randint(1, 9))) or "q" for _ in range(400)]
    for words in ([], plain, odd, plain + odd + plain, some):
        words = [w.encode() for w in words] + ([b"\xff\xe2\x82"] if words else [])
        ids, cuts = subwords.coded(pa.array(words, pa.binary()))
        assert [ids[low:high].tolist() for low, high in zip(cuts[:-1], cuts[1:], strict=True)] == subwords.ids(words)
    calls, real = [], subwords.encoder()
    subwords.encoder = lambda: lambda text: calls.append(text) or real(text)
    subwords.coded(pa.array([w.encode() for w in plain * 50]))
    assert len(calls) == 1


def test_lm_words_in_batches():
    """Words by batches against words by texts, white space of other kinds included."""
    texts = [None, "", " \t", "One TWO\x0bthree\x0cÄÉ\x85x\xa0y\u2003z\x1c\x1d\x00 ", "\r\nend", "İı ſK"]
    codes, words, lengths = lm_score.words_in(pa.array(texts, pa.string()))
    held, at = words.to_pylist(), np.concatenate(([0], np.cumsum(lengths)))
    assert [[held[c] for c in codes[low:high]] for low, high in zip(at[:-1], at[1:])] == [lm_score.words_of(t) for t in texts]


# --- pipeline


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["tha", "ion", "ent", "he", "ing", "so"]) for _ in range(rng.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n))
    texts = [text(80) for _ in range(150)]
    toxic = [int(k % 3 == 0) for k in range(150)]
    for k in range(0, 150, 3):
        texts[k] += " idiot moron"
    passage, items = text(70), [(k, text(20)) for k in range(3)]
    near = texts[1].split()
    near[40] = "changed"
    planted = {200: " ".join(near), 201: f"{text(30)} {passage} {text(30)}", 202: f"{text(30)} {passage} {text(30)}", 203: f"{text(40)} {items[0][1]} {items[1][1]}", 204: "some 1d10t here and a m0r0n there", 205: None}
    rows = list(enumerate(texts)) + list(planted.items())
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, t) for k, t in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {k for k in range(150) if k % 3} | {201, 202, 205}
    assert got[202]["n_tokens"] < got[201]["n_tokens"] and got[205]["n_tokens"] == 0
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
