"""Language-model scores of texts by causal self-attention over subword ids.

P(text) is the product over its words, and its end, of
    P(leading subword of the word | words before) x P(word | leading subword).
The first is an attention model's over the leading subwords of the words before, in overlapping windows, each token scored once: it
tells a class, and within the class the subword itself, both from the same context (the rarest subwords, of one class, by their counts).
P(word | leading subword) takes the corpus's own counts, over all training documents, discounted, and gives what the discount frees to the
spelling: a second attention model over the word's subword ids, which covers words that training has not. All of it adds up to at most 1
over texts.

What is learned comes from all training documents, whole texts of any length, and from every word of them. Words are counted in each task,
then by word; the spelling model is trained on all training words. Texts are then read once, to a table of slots of leading subwords:
subword classes and the table of log odds are sums over all of it, and the attention model is trained on all of its windows, in ROUNDS
rounds, each over the texts that a hash gives it: each task takes its windows in steps of Adam, and the tasks' steps are averaged by how many
windows they saw. No more than the models' parameters and sums of bounded size meets on the driver. Subwords are those of a public
vocabulary; none is trained.

Words with more than a HOT-th of all tokens, at most HOT many, are broadcast; the rest meets the counts in one join, a row for each
document and distinct word, so no word's rows pile up.

Defined results: a null or empty text is one end token; a null id is not held out; without training tokens N, V and all counts
are 0; repeated rows are scored each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import copy
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .attention import Attention
from .byte_bpe import load_ranks
from .common import Bounded, Scratch, new_token, per_worker, table

HOT = 500_000
SLOTS, OWN_SLOTS = 4096, 3500
CLASSES, OWN_CLASSES, GROUPED = 96, 40, 4000  # classes; those of one subword; subwords that have a class of their own or in a group
SPELL_CLASSES = 256
BESIDE = 300  # subwords whose company tells classes
FEW_WINDOWS, ROUNDS, BATCH = 200_000, 3, 128
RATES = (0.02, 0.012, 0.006)
DISCOUNT, STRENGTH = 0.75, 1.0
END = b"\n"  # no word: words hold no white space
NONE = -2  # no input or target
OTHER_SPACE = re.compile(r"[^\S ]")  # what the vocabulary's pattern may take for white space inside a word
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def words_of(text: str | None) -> list[bytes]:
    return common.words_of(text, lower=True)


def words_in(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The words of all texts end to end, as places in an array of distinct words; that array; and how many words each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, owner = lists.flatten(), pc.list_parent_indices(lists)
    real = pc.greater(pc.binary_length(words), 0)
    coded = words.filter(real).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.cast(pa.binary()), np.bincount(owner.filter(real).to_numpy(), minlength=len(texts))


class Subwords:
    """Subword ids of words, by a public byte-level vocabulary."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern

    def __getstate__(self):
        return {"path": self.path, "pattern": self.pattern}

    def encoder(self):
        if "coder" not in self.__dict__:
            import tiktoken

            self.coder = tiktoken.Encoding("subwords", pat_str=self.pattern, mergeable_ranks=load_ranks(self.path), special_tokens={})
        return self.coder.encode_ordinary

    def ids(self, words: list[bytes]) -> list[list[int]]:
        encode = self.encoder()
        return [encode(" " + w.decode("utf-8", "replace")) for w in words]

    def coded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Likewise of an array of words, the ids of all end to end, and the places where words begin and the last one ends. Words are encoded
        as one text: no piece of the pattern reaches beyond a space before it, unless a word holds white space of its own; such words go by
        themselves."""
        encode = self.encoder()
        if "begins" not in self.__dict__:
            ranks = load_ranks(self.path)
            self.begins = np.zeros(max(ranks.values()) + 1, bool)
            self.begins[[rank for token, rank in ranks.items() if token.startswith(b" ")]] = True
        if not len(words):
            return np.empty(0, np.int32), np.zeros(1, np.int64)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), b" ")[0].as_py()
        text, odd = " " + joined.decode("utf-8", "replace"), []
        if OTHER_SPACE.search(text):
            parts = text[1:].split(" ")
            odd = [k for k, w in enumerate(parts) if OTHER_SPACE.search(w)]
            own = [encode(" " + parts[k]) for k in odd]
            for k in odd:
                parts[k] = "x"
            text = " ".join(["", *parts])
        ids = np.array(encode(text), np.int32)
        starts = np.flatnonzero(self.begins[ids])
        if odd:
            made = np.split(ids, starts[1:])
            for k, x in zip(odd, own, strict=True):
                made[k] = np.array(x, np.int32)
            ids, starts = np.concatenate(made), np.cumsum([0, *map(len, made)])[:-1]
        assert len(starts) == len(words)
        return ids, np.append(starts, len(ids))


def clusters(rows: np.ndarray, weight: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Weighted k-means."""
    if len(rows) <= k:
        return np.arange(len(rows))
    rng = np.random.default_rng(seed)
    centers = rows[rng.choice(len(rows), k, replace=False, p=weight / weight.sum())]
    for _ in range(15):
        near = ((rows[:, None, :] - centers[None]) ** 2).sum(2).argmin(1)
        for c in range(k):
            own = near == c
            if own.any():
                centers[c] = np.average(rows[own], 0, weight[own])
    return near


class Model:
    """Both attention models and the tables that map subwords to slots and classes. Picklable and of bounded size."""

    def __init__(self, subwords: Subwords, vocabulary: int, leads: np.ndarray, first: np.ndarray, later: np.ndarray):
        """leads: how many training tokens begin with each subword; first, later: how many distinct training words have it first, or later."""
        self.subwords, self.leads = subwords, leads
        # slots: 0 begins a text, the most frequent subwords have their own, others share
        self.slot = (1 + OWN_SLOTS + np.arange(vocabulary) % (SLOTS - 1 - OWN_SLOTS)).astype(np.int32)
        often = np.argsort(-(leads + first + later), kind="stable")[:OWN_SLOTS]
        self.slot[often] = 1 + np.arange(len(often))
        order = np.argsort(-leads, kind="stable")
        order = order[(leads[order] > 2) & (self.slot[order] <= OWN_SLOTS)]
        self.single, self.grouped, self.beside = order[:OWN_CLASSES], order[OWN_CLASSES:GROUPED], order[:BESIDE]
        # subwords of the last class by their counts alone
        self.log_lead, rest = np.zeros(vocabulary, np.float32), np.ones(vocabulary, bool)
        rest[order[:GROUPED]] = False
        weight = leads[rest] + 0.02
        self.log_lead[rest] = np.log(weight / weight.sum())
        often = np.argsort(-later, kind="stable")[: SPELL_CLASSES - 2]
        self.spell_class = np.full(vocabulary, SPELL_CLASSES - 1, np.int32)
        self.spell_class[often] = 1 + np.arange(len(often))
        within = later + 0.02
        self.log_within = np.log(within / np.bincount(self.spell_class, within, SPELL_CLASSES)[self.spell_class]).astype(np.float32)

    def company(self, inputs: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Of texts as slots, end to end, and the text of each: how often each grouped subword stands up to four words from each of `beside`,
        by place * BESIDE + place."""
        place, beside = np.full(SLOTS, -1), np.full(SLOTS, -1)
        place[self.slot[self.grouped]], beside[self.slot[self.beside]] = np.arange(len(self.grouped)), np.arange(len(self.beside))
        place, beside, met = place[inputs], beside[inputs], []
        for gap in (1, 2, 3, 4):
            same = owner[gap:] == owner[:-gap]
            for x, y in ((place[:-gap], beside[gap:]), (place[gap:], beside[:-gap])):
                ok = same & (x >= 0) & (y >= 0)
                met.append(x[ok] * BESIDE + y[ok])
        return np.bincount(np.concatenate(met), minlength=max(1, len(self.grouped)) * BESIDE)

    def group(self, seen: np.ndarray) -> None:
        """Classes from the company that subwords keep: single ones, groups, and the rest. 0 is the end of a text."""
        self.cls = np.full(len(self.slot), CLASSES - 1, np.int32)
        self.cls[self.single] = 1 + np.arange(len(self.single))
        if len(self.grouped):
            rows = np.log1p(seen.reshape(-1, BESIDE)[: len(self.grouped)].astype(np.float64))
            rows /= np.maximum(1e-9, np.linalg.norm(rows, axis=1, keepdims=True))
            u, s, _ = np.linalg.svd(rows - rows.mean(0), full_matrices=False)
            self.cls[self.grouped] = 1 + OWN_CLASSES + clusters((u * s)[:, :10], self.leads[self.grouped].astype(float), CLASSES - 2 - OWN_CLASSES)
        self.members = {int(c): np.sort(self.slot[self.grouped[self.cls[self.grouped] == c]]) for c in np.unique(self.cls[self.grouped])}
        # a slot of one subword has its class; those that subwords share are of the last one, and 0, after a text, is its end
        self.slot_class = np.full(SLOTS, CLASSES - 1, np.int32)
        own = self.slot <= OWN_SLOTS
        self.slot_class[self.slot[own]], self.slot_class[0] = self.cls[own], 0

    def begin(self, text_seen: np.ndarray) -> None:
        """The model of texts before training, from counts of (last slot, class)."""
        weight = np.zeros(SLOTS)
        weight[self.slot[self.grouped]] = self.leads[self.grouped]
        self.text = Attention(SLOTS, CLASSES, 32, 8, prior_of(text_seen, CLASSES), members=self.members, weight=weight)

    def begin_spelling(self, spell_seen: np.ndarray) -> None:
        self.spell = Attention(SLOTS, SPELL_CLASSES, 8, 4, prior_of(spell_seen, SPELL_CLASSES), seed=4)

    def text_targets(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots that follow (0: the end) to classes and members."""
        classes = self.slot_class[targets]
        return classes, np.where((classes > OWN_CLASSES) & (classes < CLASSES - 1), targets, -1)

    def spell_targets(self, inputs: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Subwords of words likewise: a target of -1 is the word's end."""
        slots = np.where(inputs >= 0, self.slot[np.maximum(inputs, 0)], 0)
        return slots, np.where(targets >= 0, self.spell_class[np.maximum(targets, 0)], np.where(targets == -1, 0, -1)), np.full(targets.shape, -1)

    def spell_log10(self, spelled: list[list[int]]) -> np.ndarray:
        """Of words as subwords: log10 P(what follows the leading one, to the end)."""
        lengths = np.array([len(s) for s in spelled], np.int64)
        return self.coded_log10(np.fromiter((i for s in spelled for i in s), np.int64, int(lengths.sum())), lengths)

    def coded_log10(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Likewise of words' subwords end to end, and how many each has."""
        targets = following(ids, lengths)
        slots, classes, _ = self.spell_targets(ids, targets)
        total = self.spell.sums(slots, classes, lengths)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        total += np.bincount(owner, np.where(targets < 0, 0, self.log_within[np.maximum(targets, 0)]), len(lengths))
        return total / math.log(10)

    def text_log10(self, leads: list[np.ndarray]) -> np.ndarray:
        """Of texts as leading subwords: log10 of the product over their words, and the end, of P(leading subword | words before)."""
        lengths = np.array([len(x) for x in leads], np.int64)
        flat = np.concatenate([np.empty(0, np.int64), *leads]).astype(np.int64)
        owner = np.repeat(np.arange(len(leads)), lengths)
        return self.slots_log10(self.slot[flat], lengths) + np.bincount(owner, self.log_lead[flat], len(leads)) / math.log(10)

    def slots_log10(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Likewise of texts as slots, end to end, and how many each has, but for subwords of the last class within it."""
        inputs, targets = sequences(flat, lengths)
        classes, members = self.text_targets(targets)
        return self.text.sums(inputs, classes, lengths + 1, members) / math.log(10)


def prior_of(seen: np.ndarray, classes: int) -> np.ndarray:
    seen = seen.reshape(SLOTS, classes).astype(np.float64)
    base = (seen.sum(0) + 0.5) / (seen.sum() + 0.5 * classes)
    return np.log((seen + 8 * base) / (seen.sum(1, keepdims=True) + 8))


def sequences(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as slots, end to end, to inputs (0: the beginning) and targets (0: the end)."""
    ends = np.cumsum(lengths + 1) - 1
    inputs, targets = np.zeros(len(flat) + len(lengths), np.int64), np.zeros(len(flat) + len(lengths), np.int64)
    word = np.ones(len(targets), bool)
    word[ends] = False
    targets[word] = flat
    word[ends] = True
    word[ends - lengths] = False
    inputs[word] = flat
    return inputs, targets


def bytes_in(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column of binaries, none null: the bytes of all end to end, and how many each has."""
    column = column.cast(pa.binary())
    _, cuts, held = column.buffers()
    if not len(column) or held is None:
        return np.empty(0, np.uint8), np.zeros(len(column), np.int64)
    cuts = np.frombuffer(cuts, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(held, np.uint8)[cuts[0] : cuts[-1]], np.diff(cuts).astype(np.int64)


def slots_in(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Texts as the table of slots has them: slots end to end, and how many each has."""
    held, lengths = bytes_in(column)
    return held.view("<u2"), lengths // 2


def subs_in(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column of words as subwords: subwords end to end, and how many each has."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def following(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of words as subwords, end to end, what follows each: the next, or the word's end (-1)."""
    targets = np.append(ids[1:], 0)[: len(ids)]
    targets[np.cumsum(lengths)[lengths > 0] - 1] = -1
    return targets


def window_rows(inputs: np.ndarray, targets: np.ndarray, at: np.ndarray, scored: np.ndarray) -> np.ndarray:
    """Windows as rows of inputs and then targets, which are NONE where another window scores them or nothing is there."""
    return np.concatenate([inputs[at], np.where(scored, targets[at], NONE)], 1).astype("<i4")


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n (all texts), c (training texts), in each task."""
    held: list[pa.RecordBatch] = []
    rows = size = 0

    def summed_up() -> pa.Table:
        return pa.Table.from_batches(held).group_by("word", use_threads=False).aggregate([("n", "sum"), ("c", "sum")]).rename_columns(["word", "n", "c"])

    for batch in batches:
        codes, words, lengths = words_in(batch.column(1))
        learned = ~batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
        n, c = np.bincount(codes, minlength=len(words)), np.bincount(codes[np.repeat(learned, lengths)], minlength=len(words))
        for w, x, y in ((words, n, c), ([END], [batch.num_rows], [int(learned.sum())])):
            held.append(pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["word", "n", "c"]))
        rows, size = rows + len(words) + 1, size + words.nbytes
        if rows > 2_000_000 or size > 64 << 20:
            table = summed_up().combine_chunks()
            held = table.to_batches()
            rows, size = table.num_rows, table.nbytes
            if rows > 1_000_000 or size > 32 << 20:
                yield from held
                held, rows, size = [], 0, 0
    if held:
        yield from summed_up().to_batches()


class Leads(Bounded):
    """word -> its leading subword."""

    def __init__(self, subwords: Subwords, limit: int = 96 << 20):
        super().__init__(limit)
        self.encode = subwords.encoder()

    def made(self, word: bytes) -> int:
        return self.encode(" " + word.decode("utf-8", "replace"))[0]

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class Reader:
    """What a worker keeps. hot: the broadcast words, and by place whether training has the word, its base, its static part and its leading
    subword."""

    def __init__(self, model: Model, hot: tuple[list[bytes], np.ndarray]):
        self.model, self.hot = model, pa.array(hot[0], pa.binary())
        self.prices = np.concatenate([hot[1][:, :3], np.zeros((1, 3))])  # of no broadcast word: 0
        self.leads, self.end = np.append(hot[1][:, 3], 0).astype(np.int64), hot[0].index(END) if END in hot[0] else None

    def read(self, texts: pa.Array) -> list[pa.Array]:
        """Per text: tokens, known, base and static (with what subwords of the last class have within it) over broadcast words; the slots of
        its words' leading subwords; the other words, and their counts."""
        codes, words, lengths = words_in(texts)
        count, places = len(texts), pc.index_in(words, value_set=self.hot).fill_null(-1).to_numpy()
        often = places >= 0
        leads, prices = self.leads[places], self.prices[places]
        ids, at = self.model.subwords.coded(words.filter(pa.array(~often)))
        leads[~often] = ids[at[:-1]]
        prices[:, 2] += self.model.log_lead[leads] / math.log(10)
        owner = np.repeat(np.arange(count), lengths)
        known, base, static = (np.bincount(owner, np.ascontiguousarray(prices[:, k])[codes], count) for k in range(3))
        # distinct words, in order of text and word
        rare = ~often[codes]
        keys, times = np.unique(owner[rare] * (len(words) + 1) + codes[rare], return_counts=True)
        if self.end is None:
            keys, times = np.append(keys, np.arange(count) * (len(words) + 1) + len(words)), np.append(times, np.ones(count, np.int64))
            order = np.argsort(keys, kind="stable")
            keys, times = keys[order], times[order]
        else:
            known, base, static = (x + self.prices[self.end, k] for k, x in enumerate((known, base, static)))
        cuts = pa.array(np.searchsorted(keys, np.arange(count + 1) * (len(words) + 1)), pa.int32())
        others = pa.concat_arrays([words, pa.array([END], pa.binary())]).take(pa.array(keys % (len(words) + 1)))
        slots = self.model.slot[leads].astype("<u2")[codes]
        at = np.concatenate(([0], np.cumsum(lengths)))
        return [
            pa.array(lengths + 1), pa.array(np.round(known).astype(np.int64)), pa.array(base), pa.array(static),
            pa.array([slots[low:high].tobytes() for low, high in zip(at[:-1], at[1:], strict=True)], pa.binary()),
            pa.ListArray.from_arrays(cuts, others), pa.ListArray.from_arrays(cuts, pa.array(times, pa.int64())),
        ]


def read_texts(own: DataFrame, model, hot) -> DataFrame:
    """own: doc_id, held_out, text; model and hot (see Reader) as broadcasts. A row for each text, with what Reader.read gives."""
    token = new_token()
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "static", "slots", "words", "times"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = per_worker("lm", token, lambda: Reader(model.value, hot.value))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *reader.read(batch.column(3))], names)

    kinds = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, static double, slots binary, words array<binary>, times array<long>"
    return own.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text").mapInArrow(read, kinds)


def text_windows(docs: DataFrame, subwords: Subwords, share: int, token: str) -> DataFrame:
    """docs: text. win (inputs and targets of a window, as leading subwords; -1: a beginning, an end), of every share-th window of each text:
    a view of windows by themselves. The models are trained on all windows, from the table of slots."""
    shape = Attention(1, 1, 32, 8, np.zeros((1, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leads = per_worker("leads", token, lambda: Leads(subwords))
        for batch in batches:
            out = []
            for text in batch.column(0):
                words = words_of(text.as_py())
                at, scored, _ = shape.windows(np.array([len(words) + 1]))
                chosen = slice(zlib.crc32(b" ".join(words[:8])) % share, None, share)
                ids = np.append(leads.array(words), -1)
                out += [x.tobytes() for x in window_rows(np.concatenate(([-1], ids[:-1])), ids, at[chosen], scored[chosen])]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["win"])

    return docs.select("text").mapInArrow(run, "win binary")


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of windows to inputs and targets."""
    both = bytes_in(column)[0].view("<i4").reshape(len(column), -1).astype(np.int64)
    half = both.shape[1] // 2
    return both[:, :half], both[:, half:]


def summed(rows: DataFrame, count, size: int) -> np.ndarray:
    """The sum over all rows' one column of count(column), an array of `size` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += count(batch.column(0))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    rows = rows.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[rows["at"].to_numpy()] = rows["n"].to_numpy()
    return out


def dealt(parts: Iterator[tuple], size: int) -> Iterator[tuple]:
    """Tuples of arrays of any length, as tuples of `size` rows; the last may have fewer."""
    waiting, many = [], 0
    for whole in parts:
        low = 0
        while low < len(whole[0]):
            waiting.append(tuple(x[low : low + size - many] for x in whole))
            low, many = low + len(waiting[-1][0]), many + len(waiting[-1][0])
            if many == size:
                yield tuple(np.concatenate(x) for x in zip(*waiting, strict=True))
                waiting, many = [], 0
    if many:
        yield tuple(np.concatenate(x) for x in zip(*waiting, strict=True))


def window_count(rows: DataFrame, length, shape: Attention) -> int:
    """How many windows rows of this length have."""
    return int(rows.agg(F.sum(F.greatest(F.lit(1), F.ceil((length - shape.overlap) / (shape.window - shape.overlap))))).first()[0] or 0)


def trained(attention: Attention, rows: DataFrame, windows_of, n: int) -> None:
    """Rounds over all n windows, which windows_of(a column) gives in parts (slots, classes, members), each round over the rows that a hash
    gives it; few windows are gone through several times."""
    spark = rows.sparkSession
    if n < 8:
        return
    epochs = max(1, min(20, FEW_WINDOWS // n))
    for number in range(ROUNDS):
        held = spark.sparkContext.broadcast(attention)

        def run(batches: Iterator[pa.RecordBatch], held=held, number=number) -> Iterator[pa.RecordBatch]:
            own, seen, kept = copy.deepcopy(held.value), 0, []
            before = own.flat()

            def steps():
                nonlocal seen
                parts = (part for batch in batches for part in windows_of(batch.column(0)))
                for made in dealt(parts, BATCH if epochs > 1 else 4 * BATCH):
                    seen += len(made[0])
                    if epochs > 1:
                        kept.append(made)
                    yield made
                rng = np.random.default_rng(number)
                for _ in range(epochs - 1):
                    for k in rng.permutation(len(kept)):
                        yield kept[k]

            own.fit(steps(), RATES[number])
            by = (own.flat() - before).astype(np.float64) * seen
            at = np.flatnonzero(by)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(by[at], float(seen)))], ["at", "by"])

        part = rows.filter(F.pmod(F.xxhash64(rows.columns[0]), F.lit(ROUNDS)) == number)
        sums = part.mapInArrow(run, "at long, by double").groupBy("at").agg(F.sum("by").alias("by")).toArrow()
        at, by = sums["at"].to_numpy(), sums["by"].to_numpy()
        seen = by[at < 0].sum()
        if seen:
            move = np.zeros(len(attention.flat()))
            move[at[at >= 0]] = by[at >= 0] / seen
            attention.moved(move)


def learn_words(own: DataFrame, subwords: Subwords, vocabulary: int, scratch: Scratch) -> tuple[Model, DataFrame]:
    """own: held_out, text. The model with its spelling trained, and the written table of all words: word, n (tokens), c (of them in
    training), lead, spelled (log10 of the spelling given the leading subword)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cuts = subwords.coded(batch.column(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids))], ["word", "n", "c", "subs"])

    counted = own.select("held_out", "text").mapInArrow(count_words, "word binary, n long, c long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    words = scratch.keep(counted.mapInArrow(split, "word binary, n long, c long, subs array<int>"))
    seen = words.filter((F.col("c") > 0) & (F.col("word") != F.lit(END)))
    leads, first, later = (np.zeros(vocabulary, np.int64) for _ in range(3))
    # at most a row for each subword of the vocabulary
    rows = seen.groupBy(F.element_at("subs", 1).alias("lead")).agg(F.sum("c").alias("c"), F.count("*").alias("types")).toArrow()
    leads[rows["lead"].to_numpy()], first[rows["lead"].to_numpy()] = rows["c"].to_numpy(), rows["types"].to_numpy()
    rows = seen.select(F.explode(F.slice("subs", 2, 1 << 30)).alias("sub")).groupBy("sub").agg(F.count("*").alias("n")).toArrow()
    later[rows["sub"].to_numpy()] = rows["n"].to_numpy()
    model = Model(subwords, vocabulary, leads, first, later)
    bare = Bare(model)
    spells, shape = seen.select("subs"), Attention(1, 1, 8, 4, np.zeros((1, 1)))

    def by_last(column: pa.Array) -> np.ndarray:
        ids, lengths = subs_in(column)
        slots, target, _ = bare.spell_targets(ids, following(ids, lengths))
        return np.bincount(slots.astype(np.int64) * SPELL_CLASSES + target, minlength=SLOTS * SPELL_CLASSES)

    def windows_of(column: pa.Array) -> Iterator[tuple]:
        ids, lengths = subs_in(column)
        slots, classes, none = bare.spell_targets(ids, following(ids, lengths))
        at, scored, _ = shape.windows(lengths)
        yield slots[at], np.where(scored, classes[at], -1), none[at]

    model.begin_spelling(summed(spells, by_last, SLOTS * SPELL_CLASSES))
    trained(model.spell, spells, windows_of, window_count(spells, F.size("subs"), shape))
    held = own.sparkSession.sparkContext.broadcast(model)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths = subs_in(batch.column(3))
            leads = ids[np.cumsum(lengths) - lengths]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(leads, pa.int32()), pa.array(held.value.coded_log10(ids, lengths))], ["word", "n", "c", "lead", "spelled"])

    priced = scratch.keep(words.mapInArrow(spell, "word binary, n long, c long, lead int, spelled double"))
    scratch.drop(words)
    return model, priced


def learn_texts(model: Model, texts: DataFrame) -> None:
    """texts: slots, of all training texts."""

    def company(column: pa.Array) -> np.ndarray:
        flat, lengths = slots_in(column)
        return early.company(flat, np.repeat(np.arange(len(lengths)), lengths))

    early = Bare(model)
    model.group(summed(texts, company, max(1, len(model.grouped)) * BESIDE))
    bare = Bare(model)

    def by_last(column: pa.Array) -> np.ndarray:
        inputs, targets = sequences(*slots_in(column))
        return np.bincount(inputs * CLASSES + bare.slot_class[targets], minlength=SLOTS * CLASSES)

    model.begin(summed(texts, by_last, SLOTS * CLASSES))
    shape = Attention(1, 1, 32, 8, np.zeros((1, 1)))

    def windows_of(column: pa.Array) -> Iterator[tuple]:
        flat, lengths = slots_in(column)
        inputs, targets = sequences(flat, lengths)
        at, scored, _ = shape.windows(lengths + 1)
        for low in range(0, len(at), 4096):
            a, k = at[low : low + 4096], scored[low : low + 4096]
            classes, members = bare.text_targets(targets[a])
            yield inputs[a], np.where(k, classes, -1), np.where(k, members, -1)

    trained(model.text, texts, windows_of, window_count(texts, F.octet_length("slots") / 2 + 1, shape))


def learn(own: DataFrame, subwords: Subwords, vocabulary: int, scratch: Scratch) -> tuple[Model, DataFrame]:
    """own: doc_id, held_out, text. The trained model, and the table of all words (see learn_words)."""
    model, words = learn_words(own, subwords, vocabulary, scratch)
    share = own.sparkSession.sparkContext.broadcast
    texts = scratch.keep(read_texts(own.filter(~F.col("held_out")), share(model), share(([], np.zeros((0, 4))))).select("slots"))
    learn_texts(model, texts)
    scratch.drop(texts)
    return model, words


class Bare:
    """The tables of a model without its networks, for tasks that train them."""

    company, text_targets, spell_targets = Model.company, Model.text_targets, Model.spell_targets

    def __init__(self, model: Model):
        for name in ("slot", "spell_class", "grouped", "beside", "slot_class"):
            if hasattr(model, name):
                setattr(self, name, getattr(model, name))


def score_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = 50_257) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 1, F.lit(False))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))
    made, words = learn_words(own, Subwords(path, pattern), vocabulary, scratch)
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("N"), F.count_if(F.col("c") > 0).alias("V"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")).first()
    N, V = total["N"], total["V"]
    # of each leading subword of the vocabulary the training words that begin with it
    leads = words.filter((F.col("c") > 0) & (F.col("word") != F.lit(END))).groupBy("lead").agg(F.sum("c").cast("double").alias("tokens"), F.count("*").cast("double").alias("types"))
    c, tokens = F.col("c").cast("double"), F.coalesce("tokens", F.lit(0.0))
    free = DISCOUNT * F.coalesce("types", F.lit(0.0)) + STRENGTH
    static = F.log10((F.greatest(c - DISCOUNT, F.lit(0.0)) + free * F.pow(F.lit(10.0), F.col("spelled"))) / (tokens + STRENGTH))
    # where the spelling is too unlikely for a double, its logarithm goes in alone
    static = F.when(c > 0, static).otherwise(F.log10(free / (tokens + STRENGTH)) + F.col("spelled"))
    base = F.log10((c + 0.5) / F.lit(N + 0.5 * (V + 1)))
    priced = words.join(F.broadcast(leads), "lead", "left").select("word", "n", "lead", (F.col("c") > 0).cast("int").alias("known"), base.alias("base"), F.when(F.col("word") == F.lit(END), 0.0).otherwise(static).alias("static"))
    # words over a HOT-th of all tokens: fewer than HOT of them
    often = priced.filter(F.col("n") * HOT > total["all"]).select("word", "known", "base", "static", "lead").collect()
    prices = np.array([tuple(r)[1:] for r in often], np.float64).reshape(-1, 4)
    hot = spark.sparkContext.broadcast(([bytes(r["word"]) for r in often], prices))

    texts = scratch.keep(read_texts(own, spark.sparkContext.broadcast(made), hot))
    learn_texts(made, texts.filter(~F.col("held_out")).select("slots"))
    model = spark.sparkContext.broadcast(made)

    def attend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pc.add(batch.column(6), pa.array(model.value.slots_log10(*slots_in(batch.column(7)))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], score], names)

    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    kinds = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = texts.drop("words", "times").mapInArrow(attend, kinds)
    # the other words: a row for each text and distinct word
    rest = priced.filter(F.col("n") * HOT <= total["all"]).select("word", "known", "base", "static")
    found = texts.selectExpr("row", "inline(arrays_zip(words, times))").withColumnRenamed("words", "word").join(rest, "word", "left")
    none = lambda kind: F.lit(None).cast(kind)
    by = lambda name: F.col("times") * F.col(name)
    found = found.select("row", none("long").alias("doc_id"), none("boolean").alias("held_out"), none("long").alias("n_tokens"), by("known").alias("n_known"), by("base").alias("base_score"), by("static").alias("score"))
    out = scored.unionByName(found).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        F.sum("n_known").cast("long").alias("n_known"), F.sum("base_score").alias("base_score"), F.sum("score").alias("score"),
    )
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(N).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
