"""Toxicity scores from subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams, with the word's two ends marked, hashed into
one table; a bag's vector is the mean of its words' vectors; a linear softmax over it gives the two classes. Table and
softmax are trained together, so a misspelling that was never seen still shares most n-gram vectors with its word.

A few abusive words in a long text vanish in one mean. So a text is read in windows of WINDOW words, all of them; each
window is a bag of its own, the mean over the distinct words that stand in it and BLANKS words of zero, and the text's
score is that of its worst window (the first of equal ones, which score alike). The blanks keep a bag of one or two
words, whose mean is not evened out by others, from scoring on noise. Training begins with all windows of a text alike
and then gives more and more of a text's weight to its worst window (multiple-instance learning). Vectors of n-grams
in fewer than ``FEWEST`` training texts stay zero, so names and typing errors of single texts are not learned.

Training takes at most ``MOST_TOXIC`` and ``MOST_CLEAN`` labelled texts, those smallest by a hash of doc_id (of rows
that share a doc_id, the smallest text); the driver holds the numbers of their words, and the model's size is fixed. Defined results: null and empty texts are scored by the bias alone; rows whose label is null
or not 0 or 1 are not learned from; without texts of both classes every score is 0; repeated rows are scored alike;
an empty table gives an empty result; other columns are ignored. Labels, lang, source and doc_id are never inputs
of a score.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillnet.llm.common import few_rows

MOST_TOXIC, MOST_CLEAN = 1200, 2400
BUCKETS, DIM, SHORTEST, LONGEST = 1 << 17, 4, 3, 5
WINDOW, BLANKS = 12, 12
EPOCHS, RATE, SEED, FEWEST, FLOOR, DECAY = 40, 1.0, 7, 4, 1e-4, 1e-2
#: Characters that are read at once.
CHUNK = 1 << 18
#: Code points below this have a case and class of their own; those above count as letters.
PLAIN = 1 << 16
_letters = np.zeros(0, bool)


def letters() -> np.ndarray:
    """For each code point below PLAIN whether it is part of a word."""
    global _letters
    if not len(_letters):
        _letters = np.array([chr(c).isalnum() for c in range(PLAIN)])
    return _letters


#: Words as Read finds them.
WORDS = re.compile("(?:[^\\W_]|[\U00010000-\U0010ffff])+")


class Read:
    """Texts as arrays: ``gram`` the bucket of each n-gram, ``gram_word`` its word, and for each word its text."""

    def __init__(self, texts: list[str]):
        parts = [t.lower() for t in texts]
        # A blank stands before every text and two behind the last.
        codes = np.frombuffer((" " + " ".join(parts) + "  ").encode("utf-32-le", "replace"), np.uint32)
        lengths = np.array([len(p) + 1 for p in parts])
        word_char = letters()[np.minimum(codes, PLAIN - 1)] | (codes >= PLAIN)
        codes = np.where(word_char, codes, 0).astype(np.uint64)
        begins = word_char & ~np.r_[False, word_char[:-1]]
        word_of = np.cumsum(begins) - 1
        self.words = int(begins.sum())
        ends = np.cumsum(lengths)  # the blank before the next text
        upto = np.r_[0, np.cumsum(begins)]
        self.text_words = np.diff(np.r_[0, upto[ends]])
        blanks = np.r_[0, np.cumsum(~word_char)]
        gram, owner = [], []
        mixed = codes * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        rolled = mixed[:-1] * np.uint64(3) + mixed[1:]
        for n in range(2, LONGEST + 1):
            if n > 2:
                rolled = rolled[:-1] * np.uint64(0xBF58476D1CE4E5B9) + mixed[n - 1 :]
            if n >= SHORTEST:
                inside = np.flatnonzero(blanks[n - 1 : len(codes)][: len(rolled)] == blanks[1 : len(rolled) + 1])
                h = rolled[inside]
                h ^= h >> np.uint64(32)
                h *= np.uint64(0x94D049BB133111EB)
                gram.append((h >> np.uint64(64 - 17)).astype(np.int64) % BUCKETS)
                owner.append(word_of[inside + 1])
        self.gram, self.gram_word = np.concatenate(gram), np.concatenate(owner)

    def word_means(self, values: np.ndarray) -> np.ndarray:
        """The mean over each word's n-grams of one number for each bucket."""
        total = np.bincount(self.gram_word, values[self.gram], self.words)
        return total / np.maximum(np.bincount(self.gram_word, minlength=self.words), 1)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """First word of each window, and its text."""
        each = -(-self.text_words // WINDOW)
        owner = np.repeat(np.arange(len(each)), each)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
        return np.repeat(np.cumsum(self.text_words) - self.text_words, each) + nth * WINDOW, owner


class Means:
    """Rows that are means of items, as pairs, each row over its pairs or over ``size`` items; ``up`` goes from items to rows, ``down`` is its transpose."""

    def __init__(self, row: np.ndarray, item: np.ndarray, rows: int, items: int, size: np.ndarray | None = None):
        order = np.argsort(row, kind="stable")
        self.row, self.item, self.rows, self.items = row[order].astype(np.int32), item[order].astype(np.int32), rows, items
        back = np.argsort(self.item, kind="stable")
        self.back_row, back_item = self.row[back], self.item[back]
        self.scale = (1.0 / np.maximum(np.bincount(row, minlength=rows) if size is None else size, 1)).astype(np.float32)[:, None]
        self.row_at = np.flatnonzero(np.r_[True, self.row[1:] != self.row[:-1]])
        self.item_at = np.flatnonzero(np.r_[True, back_item[1:] != back_item[:-1]])
        self.row_id, self.item_id = self.row[self.row_at], back_item[self.item_at]

    def up(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((self.rows, x.shape[1]), np.float32)
        out[self.row_id] = np.add.reduceat(x[self.item], self.row_at, axis=0)
        return out * self.scale

    def down(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros((self.items, g.shape[1]), np.float32)
        out[self.item_id] = np.add.reduceat((g * self.scale)[self.back_row], self.item_at, axis=0)
        return out


def train(rows) -> tuple[np.ndarray, float]:
    """From (text, label) pairs, which are read once, the model folded to what scoring needs: for each bucket its vector
    times the softmax's difference, and the bias."""
    none = np.zeros(BUCKETS, np.float32), -60.0
    index: dict[str, int] = {}
    ids, labels = [], []
    for text, label in rows:
        ids.append(np.array([index.setdefault(w, len(index)) for w in WORDS.findall(text.lower())], np.int32))
        labels.append(label)
    if len(set(labels)) < 2 or not index:
        return none
    text_words = np.array([len(x) for x in ids])
    windows = -(-text_words // WINDOW)
    owner = np.repeat(np.arange(len(ids)), windows)
    item, text_of_word = np.concatenate(ids), np.repeat(np.arange(len(ids)), text_words)
    number = np.arange(len(item)) - np.repeat(np.cumsum(text_words) - text_words, text_words)
    window_of = np.repeat(np.cumsum(windows) - windows, text_words) + number // WINDOW
    # The n-grams of each distinct word. Only those that several texts have learn.
    read = Read(list(index))
    texts_of_word = np.bincount(np.unique(text_of_word.astype(np.int64) * len(index) + item) % len(index), minlength=len(index))
    learns = (np.bincount(read.gram, texts_of_word[read.gram_word], BUCKETS) >= FEWEST)[:, None]
    keep = learns[read.gram, 0]
    grams = Means(read.gram_word[keep], read.gram[keep], len(index), BUCKETS, np.bincount(read.gram_word, minlength=len(index)))
    del read, keep, number, text_of_word
    pair = np.unique(window_of.astype(np.int64) * len(index) + item)
    bags = Means(pair // len(index), pair % len(index), len(owner), len(index), np.bincount(pair // len(index), minlength=len(owner)) + BLANKS)
    rng = np.random.default_rng(SEED)
    table = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32) * learns
    soft, bias = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    y = np.array(labels)[owner]
    begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    size = np.diff(np.r_[begins, len(owner)])
    per_class = np.where(y == 1, sum(labels), len(labels) - sum(labels))
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (table, soft, bias)]
    for epoch in range(EPOCHS):
        hidden = bags.up(grams.up(table))
        logits = hidden @ soft + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        margin = logits[:, 1] - logits[:, 0]
        lead = np.exp((margin - np.repeat(np.maximum.reduceat(margin, begins), size)) * min(2.0, 0.1 * epoch))
        weight = (lead / np.repeat(np.add.reduceat(lead, begins), size) * 0.5 / per_class).astype(np.float32)
        grad = p.copy()
        grad[np.arange(len(y)), y] -= 1
        grad *= weight[:, None]
        grads = [grams.down(bags.down(grad @ soft.T)), hidden.T @ grad, grad.sum(0)]
        for param, g, (m, v), floor in zip((table, soft, bias), grads, moments, (FLOOR, 1e-4, 1e-4), strict=True):
            m += 0.2 * (g - m)
            v += 0.05 * (g * g - v)
            # The floor keeps n-grams that few texts have, whose gradients are small, from moving like the others.
            param -= RATE * (1 - epoch / EPOCHS) * m / (np.sqrt(v / (1 - 0.95 ** (epoch + 1))) + floor)
        table *= 1 - DECAY
    return table @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0])


def score(texts: list[str], folded: np.ndarray, bias: float) -> np.ndarray:
    """The score of each text: of its worst window."""
    best = np.zeros(len(texts))
    at = 0
    while at < len(texts):
        stop, chars = at + 1, len(texts[at])
        while stop < len(texts) and chars + len(texts[stop]) < CHUNK:
            chars += len(texts[stop])
            stop += 1
        read = Read(texts[at:stop])
        begins, owner = read.windows()
        if len(begins):
            values = read.word_means(folded).astype(np.float32)
            window = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, read.words]))
            # A word counts once in a window; equal words have equal values.
            once = np.unique((window.astype(np.int64) << 32) | values.view(np.uint32))
            means = np.bincount(once >> 32, (once & 0xFFFFFFFF).astype(np.uint32).view(np.float32), len(begins)) / (np.bincount(once >> 32, minlength=len(begins)) + BLANKS)
            texts_at = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best[at + owner[texts_at]] = np.maximum.reduceat(means, texts_at)
        at = stop
    return 1.0 / (1.0 + np.exp(-np.clip(best + bias, -60, 60)))


def labelled(docs: DataFrame, labels: DataFrame, only=None) -> DataFrame:
    """A bounded sample of labelled texts: the rows smallest by a hash of doc_id, of either class."""
    tags = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("__toxic")).where("__toxic in (0, 1) and __id is not null").distinct()
    rows = docs.select(F.col("doc_id").alias("__doc"), F.col("text").cast("string").alias("text"))
    if only is not None:
        tags = tags.where(only(F.col("__id")))
    order = F.xxhash64("__id", F.lit(SEED))
    picked = tags.where("__toxic = 1").orderBy(order, "__id").limit(MOST_TOXIC).unionByName(tags.where("__toxic = 0").orderBy(order, "__id").limit(MOST_CLEAN))
    # At most MOST_TOXIC + MOST_CLEAN rows of two numbers.
    found = rows.join(F.broadcast(picked), F.col("__doc") == F.col("__id")).groupBy(F.col("__id").alias("doc_id"), F.col("__toxic").alias("toxic"))
    return found.agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def fitted(docs: DataFrame, labels: DataFrame, only=None) -> tuple[np.ndarray, float]:
    rows = labelled(docs, labels, only).orderBy("doc_id", "toxic")
    return train((r["text"], r["toxic"]) for r in rows.toLocalIterator())


def scored(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and score of every row of ``docs``, by its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers, whatever the corpus

    def run(batches):
        folded, bias = shared.value
        for batch in few_rows(batches):
            scores = score([t or "" for t in batch.column(1).to_pylist()], folded, bias)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all their columns; the text is scored in the same pass."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))
    at = docs.columns.index("text")

    def run(batches):
        folded, bias = shared.value
        for batch in few_rows(batches):
            keep = score([t or "" for t in batch.column(at).to_pylist()], folded, bias) < 0.5
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
