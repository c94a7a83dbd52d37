"""Toxicity of texts: a noisy-channel decoder restores disguised words, and a classifier scores the restored text.

Decoder. A token that holds more than plain letters is a lattice: each character stands for itself, for the letters
that leetspeak writes with it, for fewer copies of a repeated letter, or for nothing (punctuation strewn between letters); a run
of single characters is one lattice in which each gap is a space or nothing. Viterbi finds the reading with the least
channel cost and character-trigram cost. The trigram counts are of all training texts, summed by key.

Classifier. Logistic regression on the presence of restored words, fitted on a bounded sample of labelled rows (SAMPLE_ROWS, by hash
of the id). Rows that share a min-hash of their five-word shingles count once, lest a large group of copies makes its own words look
telling; all words of the sample whose likelihood ratio reaches LEAST_RATIO enter.

Defined results: a null text is an empty one; a text without telling words gets the base score; with no labels to learn from
every score is 0; a null id is not held out; of rows that repeat a labelled id each is scored; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bounded, Scratch, WordHashes, as_long, mixed, new_token, per_worker, table, windows, words_of

SAMPLE_ROWS = 30_000
LEAST_RATIO = 22.0  # of a word's likelihood-ratio statistic
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

# Which letters leetspeak writes with a character.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
# Channel costs in nats.
SWAP, DROP_MARK, DROP_OTHER, REPEAT, DOUBLE, KEEP_MARK, GAP, SPACE = 1.2, 1.0, 14.0, 0.4, 2.5, 5.0, 0.3, 3.0

PIECE = 1 << 19  # characters that are counted together
LETTERS = 60  # classes of characters: 0 boundary, 1-26 a-z, 27-58 Latin-1 letters, 59 other letters
INVISIBLE = re.compile("[­​-‏⁠﻿]")
PLAIN = re.compile(r"[^\W\d_]+")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
REPEATED = re.compile(r"(.)\1")


def classes() -> np.ndarray:
    """Class of each code point below 0x250."""
    out = np.zeros(0x250, np.int64)
    for code in range(0x250):
        c = chr(code)
        if "a" <= c <= "z":
            out[code] = code - 96
        elif 0xDF <= code <= 0xFF and c.isalpha():
            out[code] = 27 + code - 0xDF if code < 0xFF else 58
        elif c.isalpha():
            out[code] = 59
    return out


CLASSES = classes()


def class_of(c: str) -> int:
    code = ord(c)
    return int(CLASSES[code]) if code < 0x250 else 59 if c.isalpha() else 0


def trigrams(texts: list[str]) -> np.ndarray:
    """Counts of class trigrams in lower-cased texts; runs of boundaries count once."""
    out = np.zeros(LETTERS**3, np.int64)
    held, size = [], 0

    def add(text: str) -> None:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = np.where(codes < 0x250, CLASSES[np.minimum(codes, 0x24F)], 59)
        key = (kind[:-2] * LETTERS + kind[1:-1]) * LETTERS + kind[2:]
        out.__iadd__(np.bincount(key[(kind[1:-1] > 0) | (kind[2:] > 0)], minlength=LETTERS**3))

    for text in texts:
        low = f"\n\n{text.lower()}\n"
        if len(low) > PIECE:
            for at in range(0, len(low) - 2, PIECE):  # pieces share two characters, so each trigram is in one of them
                add(low[at : at + PIECE + 2])
            continue
        held.append(low)
        size += len(low)
        if size >= PIECE:
            add("".join(held))
            held, size = [], 0
    if held:
        add("".join(held))
    return out


def count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(LETTERS**3, np.int64)
    for batch in batches:
        total += trigrams([x for x in batch.column(0).to_pylist() if x])
    key = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(total[key], pa.int64())], ["key", "n"])


SETTLE = 1024


def spelled(chain: list | None) -> str:
    """What a chain reads, from its beginning."""
    made = []
    while chain is not None:
        made.append(chain[1])
        chain = chain[0]
    return "".join(reversed(made))


def settle(chains: list[list], written: list[str]) -> int:
    """Write out what all chains begin with, and cut it off them. Returns how long the longest still is."""
    most, live = max(x[2] for x in chains), {id(x): x for x in chains}
    while len(live) > 1:
        longest = max(live.values(), key=lambda x: x[2])
        if longest[0] is None:
            return most
        del live[id(longest)]
        live[id(longest[0])] = longest[0]
    for shared in live.values():
        written.append(spelled(shared))
        shared[0], shared[1] = None, ""
        return most - shared[2]
    return 0


class Decoder:
    """Restores words. costs[a, b, c]: -log P(c | a, b) from smoothed counts."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape(LETTERS, LETTERS, LETTERS).astype(np.float64)
        c2 = c3.sum(0)
        c1 = c2.sum(0) + 0.5
        p1 = c1 / c1.sum()
        p2 = (c2 + 5 * p1) / (c2.sum(1, keepdims=True) + 5)
        p3 = (c3 + 5 * p2[None]) / (c3.sum(2, keepdims=True) + 5)
        self.costs = (-np.log(p3)).tolist()

    def arcs(self, token: str, double: float = DOUBLE) -> Iterator[tuple[list[tuple[int, str, float]], float | None]]:
        """For each position its arcs (next position, output, channel cost), and the cost of leaving the run of equal characters that it is
        inside of (none at a run's first character)."""
        n, i = len(token), 0
        while i < n:
            c = token[i]
            j = i + 1
            while j < n and token[j] == c:
                j += 1
            letter = c.isalpha()
            rest = DROP_MARK if not letter and c not in LEET else REPEAT if j - i > 2 else double
            for k in range(i, j):  # from inside a run to its end: the rest was repetition
                if c == " ":
                    yield [(k + 1, " ", SPACE), (k + 1, "", GAP)], None
                    continue
                own = [(k + 1, c, 0.0)] if letter else []
                own += [(k + 1, x, SWAP) for x in LEET.get(c, "")]
                if k > i:
                    own.append((j, "", rest))
                if not letter:
                    own.append((k + 1, "", DROP_OTHER if c.isalnum() else DROP_MARK))
                    own.append((k + 1, " ", DROP_OTHER if c.isalnum() else KEEP_MARK))
                yield own, rest if k > i else None
            i = j

    def decode(self, token: str, double: float = DOUBLE) -> str:
        """The likeliest reading, words parted by single spaces. double: the cost of reading a doubled letter as one.

        Readings are chains of (reading before, text, length). From time to time what all live ones share is written out and let go, and inside
        a run a reading goes that one of the same state could have left the run with before, at no more cost; so memory and time for a
        character do not grow with a token's length.
        """
        return " ".join(self.read(token, double)[0].split())

    def read(self, token: str, double: float = DOUBLE) -> tuple[str, float]:
        """The likeliest reading as it stands, and its cost."""
        costs, n = self.costs, len(token)
        states: dict[int, dict] = {0: {(0, 0): (0.0, [None, "", 0])}}
        written: list[str] = []
        least: dict = {}
        due = SETTLE
        for i, (arcs, leave) in enumerate(self.arcs(token, double)):
            if leave is None:
                least = {}
            for (a, b), (cost, chain) in states.pop(i, {}).items():
                if leave is not None:
                    if least.get((a, b), math.inf) + leave <= cost:
                        continue
                    least[a, b] = min(cost, least.get((a, b), math.inf))
                row = costs[a][b]
                for j, text, channel in arcs:
                    if not text:
                        state, total = (a, b), cost + channel
                    elif text == " ":
                        if b == 0:
                            state, total = (a, b), cost + channel
                        else:
                            state, total = (b, 0), cost + channel + row[0]
                    else:
                        c = class_of(text)
                        state, total = (b, c), cost + channel + row[c]
                    own = states.setdefault(j, {})
                    old = own.get(state)
                    if old is None or total < old[0]:
                        own[state] = (total, [chain, text, chain[2] + 1])
            if i >= due:
                due = i + max(SETTLE, settle([x[1] for own in states.values() for x in own.values()], written))
        if not states.get(n):
            return "", math.inf
        total, _, chain = min(((x[0] + (costs[s[0]][s[1]][0] if s[1] else 0.0), k, x[1]) for k, (s, x) in enumerate(states[n].items())), key=lambda x: x[:2])
        written.append(spelled(chain))
        return "".join(written), total

    def restore(self, token: str) -> list[str]:
        """The words that a lower-cased token, or run of single characters, stands for."""
        if " " not in token and "\t" not in token:
            if PLAIN.fullmatch(token) and not REPEATED.search(token):
                return [token]
            core = EDGES.sub("", token)
            if not core and not any(c in LEET for c in token):
                return []
            if PLAIN.fullmatch(core) and not REPEATED.search(core) and token[0] not in "@$(":
                return [core]
            whole = token if token[0] in "@$(|+" else core or token
            read = self.decode(whole).split()
            if REPEATED.search(whole):
                read += self.decode(whole, DROP_OTHER).split()
            if core and whole != core:
                read += self.decode(core).split()
            if core != token and not PLAIN.fullmatch(core):
                read += self.decode(token).split()
            if PLAIN.fullmatch(core):
                read.append(core)
            return list(dict.fromkeys(read))
        return self.decode(token.replace("\t", " ")).split()


def tokens(text: str) -> set[str]:
    """The tokens of a text, and its runs of single characters."""
    low = text.lower()
    if not low.isascii() and INVISIBLE.search(low):
        low = INVISIBLE.sub("", low)
    found = set(low.split())
    found.update(SPACED.findall(low))
    return found


class Restorer(Bounded):
    """Keeps what tokens were restored to."""

    def __init__(self, decoder: Decoder, limit: int = 48 << 20):
        super().__init__(limit)
        self.decoder = decoder

    def made(self, token: str) -> tuple[str, ...]:
        return tuple(self.decoder.restore(token))

    def size(self, value: tuple[str, ...]) -> int:
        return 56 + sum(64 + len(w) for w in value)

    def words(self, text: str) -> set[str]:
        return set().union(*map(self.__getitem__, tokens(text)))


class Scorer(Bounded):
    """Texts to scores. Keeps the telling words that tokens were restored to."""

    def __init__(self, decoder: Decoder, weights: dict[str, float], bias: float, limit: int = 64 << 20):
        super().__init__(limit)
        self.decoder, self.weights, self.bias = decoder, weights, bias

    def made(self, token: str) -> tuple[str, ...]:
        return tuple(w for w in self.decoder.restore(token) if w in self.weights)

    def size(self, value: tuple[str, ...]) -> int:
        return 56 + 8 * len(value) if value else 0

    def score(self, text: str | None) -> float:
        found = set().union(*map(self.__getitem__, tokens(text or "")))
        z = self.bias + sum(self.weights[w] for w in sorted(found))
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def min_hashes(text: str, hashes: WordHashes, n: int = 3) -> list[int]:
    """The least of n hashes over the text's five-word shingles."""
    words = hashes.array(words_of(text))
    shingles = windows(words, min(5, len(words))) if len(words) else np.zeros(1, np.uint64)
    return [int(as_long(mixed(shingles + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64))).min()) for k in range(n)]


def fit_weights(rows: list[tuple[list[int], int]], size: int, steps: int = 600, ridge: float = 0.003) -> tuple[np.ndarray, float]:
    """Logistic regression on sets of features, by full-batch Adam."""
    lengths = np.array([len(x) for x, _ in rows], np.int64)
    flat = np.fromiter((i for x, _ in rows for i in x), np.int64, int(lengths.sum()))
    owner = np.repeat(np.arange(len(rows)), lengths)
    y = np.array([t for _, t in rows], np.float64)
    w, b = np.zeros(size), math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, steps + 1):
        z = b + np.bincount(owner, w[flat], len(rows))
        error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        g = np.bincount(flat, error[owner], size) + ridge * w
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        down, downv = 1 - 0.9**step, 1 - 0.99**step
        w -= 0.1 * (m / down) / (np.sqrt(v / downv) + 1e-8)
        b -= 0.1 * (mb / down) / (math.sqrt(vb / downv) + 1e-8)
    return w, b


def train(own: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[Decoder, dict[str, float], float]:
    """own: doc_id, held_out, text. Decoder, weights and bias, learned from rows that are not held out."""
    spark = own.sparkSession
    seen = own.filter(~F.col("held_out"))
    counts = np.zeros(LETTERS**3, np.int64)
    # at most LETTERS^3 rows
    for row in seen.select("text").mapInArrow(count_trigrams, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect():
        counts[row["key"]] = row["n"]
    decoder = spark.sparkContext.broadcast(Decoder(counts))
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0))
    n = known.count()
    drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < min(1.0, 1.1 * sample_rows / max(n, 1)) * 1_000_000)
    chosen = drawn.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    token = new_token()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, hashes = per_worker("toxicity", token, lambda: (Restorer(decoder.value), WordHashes()))
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            words, keys = [restorer.words(x) for x in texts], [min_hashes(x, hashes) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([k[i] for k in keys], pa.int64()) for i in range(3)), pa.array([sorted(w) for w in words], pa.list_(pa.string()))], ["toxic", "k0", "k1", "k2", "words"])

    scratch = Scratch(spark, "toxicity")
    # the sample's ids are bounded by sample_rows
    rows = seen.join(F.broadcast(chosen), "doc_id").select("toxic", "text").mapInArrow(read, "toxic int, k0 long, k1 long, k2 long, words array<string>")
    rows = scratch.keep(rows)
    for key in ("k0", "k1", "k2"):
        rows = rows.dropDuplicates([key, "toxic"])
    rows = scratch.keep(rows.select("toxic", "words"))
    total = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("pos")).first()
    n, pos = total["n"], total["pos"] or 0
    if not pos or pos == n:
        return decoder.value, {}, -math.inf if not pos else math.inf
    words = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("a"), F.count("*").alias("df"))
    # Dunning's likelihood ratio of the 2 x 2 table
    a, df = F.col("a").cast("double"), F.col("df").cast("double")
    part = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    ratio = 2 * (part(a, df * pos / n) + part(df - a, df * (n - pos) / n) + part(pos - a, (n - df) * pos / n) + part(n - df - pos + a, (n - df) * (n - pos) / n))
    telling = words.filter((F.col("df") > 2) & (a / df > 2 * pos / n)).withColumn("ratio", ratio).filter(F.col("ratio") >= LEAST_RATIO)
    # words of at most sample_rows texts
    chosen_words = [r["word"] for r in telling.orderBy("word").collect()]
    place = {w: k for k, w in enumerate(chosen_words)}
    if not place:
        return decoder.value, {}, math.log(pos / (n - pos))
    held = spark.sparkContext.broadcast(place)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[held.value[w] for w in words if w in held.value] for words in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["toxic", "found"])

    # at most sample_rows rows of feature numbers
    docs = [(r["found"], r["toxic"]) for r in rows.mapInArrow(find, "toxic int, found array<int>").collect()]
    w, b = fit_weights(docs, len(place))
    return decoder.value, {word: float(w[k]) for word, k in place.items()}, float(b)


def score_texts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. Learns from rows whose crc32(id as text) mod 5 is not 0."""
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(False))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(train(own, labels.select("doc_id", "toxic"), sample_rows))

    token = new_token()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = per_worker("toxicity", token, lambda: Scorer(*model.value))
        for batch in batches:
            scores = [scorer.score(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return own.mapInArrow(run, SCHEMA)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that are not predicted toxic."""
    own = docs.select("doc_id", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False)).alias("held_out"), "text")
    model = docs.sparkSession.sparkContext.broadcast(train(own, labels.select("doc_id", "toxic")))
    at = docs.columns.index("text")

    token = new_token()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = per_worker("toxicity", token, lambda: Scorer(*model.value))
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(x.as_py()) < 0.5 for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
