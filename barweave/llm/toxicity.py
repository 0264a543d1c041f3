"""Toxicity by multiple-instance learning: sentences are instances, documents are bags.

A sentence scores p = sigmoid(bias + sum of weights of its words and word beginnings); a document is toxic if any sentence is,
P = 1 - prod(1 - p) (noisy-or). Only documents are labelled; the gradient of the noisy-or sends the label to the sentences that
explain it. Afterwards the same sentence scores locate the offending sentences.

Fitting uses at most ``EACH`` documents per label, drawn by hash, whole texts; features without a clear
association with the label (``LEAST``, ``RATIO``, ``CHANCE``) get no weight. Scoring reads every text in one narrow pass, sentences by prefix sums, without a loop over words.

Defined results: null and empty texts have no sentence and score 0; rows with equal ids are scored one by one; without labels
of both kinds every score is the smoothed share of label 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.llm.common import ALNUM, Chunk, annotated, fresh, mix64, per_chunk
from barweave.llm.labelled import in_fold, labelled_texts

EACH = 3000
FOLDS, LEFT_OUT = 4, 2
CUT = 0.3
BITS = 20
BEGINNINGS = (3, 4, 5, 6)
LEAST = 3
RATIO = 15
CHANCE = 6
STRAYS = 10
EPOCHS = 12
UPDATES = 800
#: Logit of a sentence without any telling feature.
SILENT = -40.0
BATCH = 64
RATE = 0.5
SHRINK = 2e-3
ENDS = np.zeros(256, bool)
ENDS[[10, 13, 33, 46, 63]] = True


class Sentences:
    """Words of a chunk as feature buckets, and the sentence and text each belongs to."""

    def __init__(self, texts: list[bytes]):
        chunk = Chunk(texts, ALNUM)
        start, end, rolling = chunk.start, chunk.end, chunk.rolling
        size = np.uint64(64 - BITS)
        columns = [rolling.span(start, end) >> size]
        for n in BEGINNINGS:
            columns.append(mix64(rolling.span(start, np.minimum(start + n, end)) + np.uint64(n)) >> size)
        self.buckets = np.stack(columns, axis=1).astype(np.int64)
        self.text = np.repeat(np.arange(len(texts)), np.diff(chunk.first))
        border = np.concatenate([[0], np.cumsum(ENDS[chunk.data])])[start]
        new = np.append(True, (border[1:] != border[:-1]) | (self.text[1:] != self.text[:-1]))[: len(start)]
        self.first = np.flatnonzero(new)  # first word of each sentence
        self.of_text = self.text[self.first]
        points = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])
        last = np.append(self.first[1:], len(start)) - 1
        base = points[chunk.doc_start[self.of_text]] if len(self.first) else np.zeros(0, np.int64)
        self.start, self.end = points[start[self.first]] - base, points[end[last]] - base if len(last) else base


def bag_scores(z: np.ndarray, of_text: np.ndarray, texts: int) -> np.ndarray:
    """Noisy-or of the sentence scores of each text."""
    return -np.expm1(-np.bincount(of_text, np.logaddexp(0, z), texts))


class Model:
    def __init__(self, weights: np.ndarray | None, bias: float, share: float):
        self.weights, self.bias, self.share = weights, bias, share

    def sentence_logits(self, s: Sentences) -> np.ndarray:
        if not len(s.first):
            return np.zeros(0)
        weight = self.weights[s.buckets]
        told = np.add.reduceat((weight != 0).any(axis=1), s.first)
        return np.where(told, self.bias + np.add.reduceat(weight.sum(axis=1), s.first), SILENT)

    def score(self, texts: list[bytes], cut: float) -> list[list]:
        if self.weights is None:
            return [[self.share] * len(texts), [[] for _ in texts]]
        s = Sentences(texts)
        z = self.sentence_logits(s)
        found: list[list] = [[] for _ in texts]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        for k in np.flatnonzero(p >= cut):
            found[s.of_text[k]].append({"start": int(s.start[k]), "end": int(s.end[k]), "score": float(p[k])})
        return [bag_scores(z, s.of_text, len(texts)), found]


def telling(bags: list[list[np.ndarray]], y: np.ndarray) -> np.ndarray:
    """Features found in LEAST toxic texts or more, RATIO times as often as in the others, beyond chance: a G statistic so large
    that about STRAYS of all features tried would reach it without any association."""
    seen = np.zeros((2, 1 << BITS))
    for bag, label in zip(bags, y):
        if bag:
            seen[int(label > 0), np.unique(np.concatenate(bag))] += 1
    others, toxic = len(y) - (y > 0).sum(), (y > 0).sum()
    share = seen.sum(axis=0) / len(y)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * np.nansum([seen[1] * np.log(seen[1] / (share * toxic)), seen[0] * np.log(seen[0] / (share * others))], axis=0)
    often = (seen[1] + 0.1) / toxic >= RATIO * (seen[0] + 0.1) / others
    tried = max(int((seen.sum(axis=0) >= LEAST).sum()), 1)
    return np.flatnonzero((seen[1] >= LEAST) & often & (g >= max(CHANCE, 2 * np.log(tried / STRAYS))))


def fit(bags: list[list[np.ndarray]], y: np.ndarray) -> Model:
    """``bags``: for each document its sentences, each an array of feature buckets."""
    share = float((y.sum() + 1) / (len(y) + 2))
    if not 0 < y.sum() < len(y):
        return Model(None, 0.0, share)
    active = telling(bags, y)
    number = np.full(1 << BITS, -1, np.int64)
    number[active] = np.arange(len(active))
    small = [[k for k in (kept[kept >= 0] for kept in (number[s] for s in bag)) if len(k)] for bag in bags]
    w, g2 = np.zeros(len(active)), np.full(len(active), 1e-2)
    bias, b2 = -2.0, 1.0
    rng = np.random.default_rng(0)
    for _ in range(max(EPOCHS, UPDATES * BATCH // len(bags))):
        for at in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // BATCH)):
            sentences = [s for i in at for s in small[i]]
            if not sentences:
                continue
            owner = np.repeat(np.arange(len(at)), [len(small[i]) for i in at])
            words = np.concatenate(sentences)
            line = np.repeat(np.arange(len(sentences)), [len(s) for s in sentences])
            z = bias + np.bincount(line, w[words], len(sentences))
            total = np.bincount(owner, np.logaddexp(0, z), len(at))
            pull = np.where(y[at] > 0, -1 / np.expm1(np.clip(total, 1e-6, 50)), 1.0)
            dz = np.clip(pull[owner] / (1 + np.exp(-np.clip(z, -30, 30))), -5, 5) / len(at)
            grad = np.bincount(words, dz[line], len(w))
            g2 += grad**2
            rate = RATE / np.sqrt(g2)
            w -= rate * grad
            touched = grad != 0
            w[touched] = np.sign(w[touched]) * np.maximum(np.abs(w[touched]) - rate[touched] * SHRINK / len(at), 0)
            b2 += dz.sum() ** 2
            bias -= 0.1 * dz.sum() / np.sqrt(b2)
    weights = np.zeros(1 << BITS, np.float32)
    weights[active] = w
    return Model(weights, float(bias), share)


def learn(docs: DataFrame, labels: DataFrame, target: str = "toxic", each: int = EACH, id_col: str = "doc_id", text_col: str = "text") -> Model:
    def work(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        s = Sentences(texts)
        words, lines = [], []
        length = np.diff(np.append(s.first, len(s.buckets))) * s.buckets.shape[1] if len(s.first) else np.zeros(0, np.int64)
        for i in range(len(texts)):
            words.append(s.buckets[s.text == i].ravel().astype(np.int32))
            lines.append(length[s.of_text == i].astype(np.int32))
        return pa.record_batch([batch.column("id").cast(pa.string()), batch.column("target"), pa.array(words, pa.list_(pa.int32())),
                                pa.array(lines, pa.list_(pa.int32()))], names=["id", "target", "words", "lines"])

    sample = labelled_texts(docs, labels, target, FOLDS, LEFT_OUT, each, id_col, text_col)
    rows = sample.mapInArrow(per_chunk(work, "text"), "id string, target int, words array<int>, lines array<int>").toArrow().sort_by("id")
    words, lines = rows["words"].combine_chunks(), rows["lines"].combine_chunks()
    bags = [np.split(words[i].values.to_numpy(), np.cumsum(lines[i].values.to_numpy())[:-1]) if len(lines[i].values) else []
            for i in range(rows.num_rows)]
    return fit(bags, rows["target"].to_numpy().astype(float))


def judged(docs: DataFrame, model: Model, out: str, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """All columns of ``docs`` and a struct ``out``: score of the text, and place and score of its offending sentences."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return annotated(docs, text_col, out, "score double, sentences array<struct<start: bigint, end: bigint, score: double>>",
                     lambda texts: sent.value.score(texts, cut))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT, **options) -> DataFrame:
    """One row per document: held_out, score, predicted, offending sentences."""
    model = learn(docs, labels, id_col=id_col, text_col=text_col, **options)
    plain = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    return judged(plain, model, fresh(plain, "grade"), cut=cut).select(
        id_col, in_fold(id_col, FOLDS, LEFT_OUT).alias("held_out"), F.col("grade.score").alias("score"),
        (F.col("grade.score") >= cut).cast("int").alias("predicted"), F.col("grade.sentences").alias("sentences"))
