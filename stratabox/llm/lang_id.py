"""Language of texts by a linear-chain conditional random field over their words.

Each word has weights for its affixes, its letter n-grams and whether each language's lexicon has it; transitions between
the languages of neighbouring words are learned with them, on sequences spliced from pieces of single-language documents, so
that a switch inside a text is something the model has seen. Forward-backward gives each word's probabilities; a
document's language is the one with the largest sum over its words, and its score that sum's share.

The field is fitted on a bounded sample of labelled rows: SAMPLE_ROWS documents of each language, by hash of the id, and of each
PIECES pieces of PIECE words, spread evenly over its whole length (all of it where it has no more). Prediction covers every word of every text.

Defined results: `und` and score 0 if a text is null or has no letter (of Unicode's category L), or if no document has a label to learn from; words
without a letter take part in the chain without evidence and don't count for the document; repeated rows are predicted each;
ties go to the language that comes first in the alphabet; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, new_token, per_worker, table

SAMPLE_ROWS = 400
PIECES, PIECE = 40, 80
BITS = 16  # of a feature's slot
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
NOT_LETTERS = regex.compile(r"\P{L}+")
BATCH_CHARS = 2_500_000  # of the texts whose chains are run together
STEPS, RATE, DECAY = 60, 0.08, 1e-4  # of the fit
LEXICON = 1  # a word is in a lexicon from so many occurrences per language in the sample, if over half are in it


def slots(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The feature slots of words of letters, all at once: slots, and the word that each belongs to.

    Affixes are runs of up to four letters with the edge, n-grams are runs of two and three; both are rolled hashes over the words' code
    points, laid end to end between edge marks. One more slot tells which lexicon has the word.
    """
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), lengths)
    ends = np.repeat(np.cumsum(lengths), lengths)
    at = np.arange(len(codes))
    begins = ends - lengths[owner]
    flat, owners, rolled = [], [], codes
    for n in range(2, 6):
        rolled = rolled[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
        own, last = at[: len(rolled)], at[: len(rolled)] + n
        real = last <= ends[: len(rolled)]
        if n > 3:  # longer runs only as affixes
            real &= (own == begins[: len(rolled)]) | (last == ends[: len(rolled)])
        got = mixed(rolled[real] + np.uint64(n))
        flat.append((got & np.uint64((1 << BITS) - 1)).astype(np.int64))
        owners.append(owner[: len(rolled)][real])
    known = np.fromiter((lexicon.get(w, -1) for w in words), np.int64, len(words))
    flat.append((mixed((known + 2).astype(np.uint64)) & np.uint64((1 << BITS) - 1)).astype(np.int64))
    owners.append(np.arange(len(words)))
    return np.concatenate(flat), np.concatenate(owners)


def packed(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sequences laid end to end: the order that puts all first words first, then all second ones, ...; how many
    sequences reach each step; and the order of the sequences (longest first)."""
    order = np.argsort(-lengths, kind="stable")
    own = lengths[order]
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1][order]
    sizes = len(own) - np.searchsorted(own[::-1], np.arange(1, (own[0] if len(own) else 0) + 1), side="left")
    take = np.empty(int(lengths.sum()), np.int64)
    at = 0
    for t, size in enumerate(sizes.tolist()):
        take[at : at + size] = starts[:size] + t
        at += size
    return take, sizes, order


def forward_backward(evidence: np.ndarray, moves: np.ndarray, first: np.ndarray, sizes: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of packed sequences. evidence: exp scores (words, languages), packed by step."""
    alpha = np.empty_like(evidence)
    scale = np.empty(len(evidence), evidence.dtype)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    for t, (b, e) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
        now = (first * evidence[b:e]) if t == 0 else (alpha[begins[t - 1] : begins[t - 1] + e - b] @ moves) * evidence[b:e]
        total = now.sum(1)
        np.maximum(total, 1e-30, out=total)
        np.divide(now, total[:, None], out=alpha[b:e])
        scale[b:e] = total
    beta = np.ones_like(evidence)
    edge = np.zeros_like(moves, dtype=np.float64)
    for t in range(len(sizes) - 1, 0, -1):
        b, e = int(begins[t]), int(ends[t])
        up = begins[t - 1]
        right = evidence[b:e] * beta[b:e] / scale[b:e, None]
        beta[up : up + e - b] = right @ moves.T
        if pairs:
            edge += alpha[up : up + e - b].T.astype(np.float64) @ right
    both = alpha * beta
    both /= np.maximum(both.sum(1, keepdims=True), 1e-30)
    return both, edge * moves, float(np.log(scale).sum())


class Field:
    """A fitted field. Picklable; its size is bounded by 2^BITS slots and the sample's lexicon."""

    def __init__(self, langs: list[str], weights: np.ndarray, moves: np.ndarray, lexicon: dict[str, int]):
        self.langs, self.weights, self.moves, self.lexicon = langs, weights, moves, lexicon

    def scores(self, words: list[str]) -> np.ndarray:
        flat, owner = slots(words, self.lexicon)
        return np.stack([np.bincount(owner, self.weights[flat, k], len(words)) for k in range(len(self.langs))], 1)


def fit(rows: list[tuple[str, str]], seed: int = 7) -> Field | None:
    """rows: (text, language)."""
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    rank = {lang: k for k, lang in enumerate(langs)}
    docs = [([w for w in (NOT_LETTERS.sub("", x) for x in text.lower().split()) if w], rank[lang]) for text, lang in rows]
    docs = [x for x in docs if x[0]]
    if not docs:
        return None
    by_word: dict[str, Counter] = {}
    for words, lang in docs:
        for word in words:
            by_word.setdefault(word, Counter())[lang] += 1
    vocabulary = {w: k for k, w in enumerate(by_word)}
    lexicon = {w: (best[0][0]) for w, c in by_word.items() if (best := c.most_common(1))[0][1] > 2 * LEXICON and 2 * best[0][1] > sum(c.values())}
    # a word met once tells nothing as a lexicon word of its own document: it counts as unknown while fitting
    flat, owner = slots(list(vocabulary), lexicon)
    # spliced sequences: pieces of 8 to 80 words, one to four of them to a sequence
    pieces = []
    for words, lang in docs:
        ids, at = [vocabulary[w] for w in words], 0
        while at < len(ids):
            step = int(rng.integers(8, 80))
            pieces.append((ids[at : at + step], lang))
            at += step
    rng.shuffle(pieces)
    sequences, at = [], 0
    while at < len(pieces):
        group = pieces[at : at + int(rng.integers(1, 5))]
        at += len(group)
        sequences.append(([i for x, _ in group for i in x], [lang for x, lang in group for _ in x]))
    lengths = np.array([len(x) for x, _ in sequences])
    words = np.fromiter((i for x, _ in sequences for i in x), np.int64, int(lengths.sum()))
    truth = np.fromiter((i for _, x in sequences for i in x), np.int64, int(lengths.sum()))
    take, sizes, _ = packed(lengths)
    words, truth = words[take], truth[take]
    L = len(langs)
    edges = np.zeros((L, L))
    begins = np.cumsum(sizes) - sizes
    for t in range(1, len(sizes)):
        np.add.at(edges, (truth[begins[t - 1] : begins[t - 1] + sizes[t]], truth[begins[t] : begins[t] + sizes[t]]), 1)
    held = np.stack([np.bincount(words[truth == k], minlength=len(vocabulary)) for k in range(L)], 1).astype(np.float64)
    theta = [np.zeros((1 << BITS, L)), np.zeros((L, L))]
    moment = [[np.zeros_like(x), np.zeros_like(x)] for x in theta]
    first = np.full(L, 1 / L)
    for step in range(1, STEPS + 1):
        score = np.stack([np.bincount(owner, theta[0][flat, k], len(vocabulary)) for k in range(L)], 1)
        own = score[words]
        evidence = np.exp(own - own.max(1, keepdims=True))
        marginal, edge, _ = forward_backward(evidence, np.exp(theta[1]), first, sizes, pairs=True)
        error = held - np.stack([np.bincount(words, marginal[:, k], len(vocabulary)) for k in range(L)], 1)
        slope = [np.stack([np.bincount(flat, error[owner, k], 1 << BITS) for k in range(L)], 1) / len(words), (edges - edge) / len(words)]
        for k, x in enumerate(theta):
            g = slope[k] - DECAY * x / 100
            m, v = moment[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return Field(langs, theta[0].astype(np.float32), np.exp(theta[1]).astype(np.float32), lexicon)


class Predictor:
    def __init__(self, field: Field, limit: int = 500_000):
        self.field, self.limit = field, limit
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.by_form: dict[str, int] = {"": 0}
        self.table = np.ones((1024, len(self.field.langs)), np.float32)

    def learn(self, words: set[str]) -> None:
        """Give each new word a row of the table; words alike but for marks and case share one."""
        forms = [NOT_LETTERS.sub("", w.lower()) for w in words]
        new = list({f for f in forms if f not in self.by_form})
        if new:
            first = len(self.by_form)
            self.by_form.update(zip(new, range(first, first + len(new)), strict=True))
            while first + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.ones_like(self.table)])
            scores = self.field.scores(new)
            self.table[first : first + len(new)] = np.exp(np.clip(scores - scores.max(1, keepdims=True), -30, 0))
        self.rows.update(zip(words, map(self.by_form.__getitem__, forms), strict=True))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        split = [t.split() for t in texts]
        every = set().union(*split)
        new = every - self.rows.keys()
        if len(self.rows) + len(new) > self.limit:
            self.clear()
            new = every
        if new:
            self.learn(new)
        return [np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words)) for words in split]

    def chains(self, texts: list[np.ndarray]) -> np.ndarray:
        """The sum of each text's word marginals."""
        lengths = np.array([len(x) for x in texts])
        out = np.zeros((len(texts), len(self.field.langs)))
        if not lengths.sum():
            return out
        words = np.concatenate(texts)
        take, sizes, _ = packed(lengths)
        L = len(self.field.langs)
        marginal, _, _ = forward_backward(self.table[words[take]], self.field.moves, np.full(L, 1 / L, np.float32), sizes)
        marginal *= (words[take] != 0)[:, None]
        owner = np.repeat(np.arange(len(texts)), lengths)[take]
        for k in range(L):
            out[:, k] = np.bincount(owner, marginal[:, k], len(texts))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores, waiting, low, size = [], [], [], 0, 0
        for k, text in enumerate(texts):
            size += len(text or "")
            if size >= BATCH_CHARS or k == len(texts) - 1:
                waiting.append(self.chains(self.ids([x or "" for x in texts[low : k + 1]])))
                low, size = k + 1, 0
        if not waiting:
            return [], []
        sums = np.concatenate(waiting)
        totals = sums.sum(1)
        best = sums.argmax(1)
        for k, total in enumerate(totals.tolist()):
            langs.append(self.field.langs[best[k]] if total > 0 else "und")
            scores.append(min(1.0, float(sums[k, best[k]]) / total) if total > 0 else 0.0)
        return langs, scores


def pieces_of(text: str, pieces: int = PIECES, size: int = PIECE) -> str:
    """Some words of a text, evenly over its length; all of them where it has at most pieces * size."""
    words = text.split()
    if len(words) <= pieces * size:
        return text
    starts = [k * (len(words) - size) // (pieces - 1) for k in range(pieces)]
    return " ".join(w for at in starts for w in words[at : at + size])


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """Labelled rows to fit on: about `rows` documents of each language, chosen by hash, each as its pieces."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {x["lang"]: x["n"] for x in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*(F.lit(y) for lang, n in counts.items() for y in (lang, min(1.0, 1.25 * rows / n))))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pieces_of(x.as_py()) for x in batch.column(0)], pa.string()), batch.column(1), batch.column(2)], ["text", "lang", "h"])

    chosen = labelled.filter(drawn).select("text", "lang", F.xxhash64("doc_id", "text").alias("h")).mapInArrow(run, "text string, lang string, h long")
    return [(x["text"], x["lang"]) for x in chosen.orderBy("h", "text").limit(2 * rows * len(counts)).collect()]


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score. Learns from rows whose crc32(id as text) mod 3 is not 1."""
    spark = docs.sparkSession
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), held.alias("held_out"))
    field = spark.sparkContext.broadcast(fit(sample(own.filter(~F.col("held_out")))))

    token = new_token()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = per_worker("language", token, lambda: Predictor(field.value)) if field.value else None
        for batch in batches:
            texts = batch.column(2).to_pylist()
            langs, scores = predictor.predict(texts) if predictor else (["und"] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return own.select("doc_id", "held_out", "text").mapInArrow(run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return predict_languages(table(spark, sf_dir, "documents"))
