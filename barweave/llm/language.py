"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

Subwords are whole words and the 2- and 3-byte pieces of words with their borders, hashed into ``BUCKETS`` rows. A text is the
mean of its subwords' embeddings; a linear softmax reads the language. Since scoring is linear, embeddings and output layer are
multiplied once and a text's logits are means of rows of one small table.

Part of the sample is held back to calibrate: a temperature is chosen by log loss, and the rejection limit is the score below
which the ``REJECT`` share of the rightly answered held-back texts lies. Texts scored lower keep their best guess but are marked
not ``accepted``.

Fitting uses at most ``EACH`` documents per language and ``MOST`` in all, drawn by hash, whole texts; only text and language of
the learning folds are read. Defined results: null texts and texts without any letter are "und" with score 0; so is every text
when nothing can be learned; with one language learned every other text gets it. Rows with equal ids are answered one by one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.llm.common import Chunk, annotated, fresh, mix64, per_chunk, remainder
from barweave.llm.labelled import first_of_each, in_fold

FOLDS, LEFT_OUT = 5, 0
EACH, MOST = 1500, 12000
BUCKETS = 1 << 15
DIMENSIONS = 16
EPOCHS = 4
RATE = 0.4
HELD_BACK = 10
REJECT = 0.005
UNKNOWN = "und"
LETTERS = np.zeros(256, bool)
LETTERS[97:123] = LETTERS[128:] = True
ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(ASCII_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text.decode())))


def subwords(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of every subword."""
    chunk = Chunk(texts, LETTERS)
    letter = LETTERS[chunk.data]
    data = np.where(letter, chunk.data, np.uint8(32))
    buckets = [chunk.words()]
    places = [chunk.start]
    rolling = type(chunk.rolling)(data)
    n = len(data)
    for size in (2, 3):
        if n < size:
            continue
        at = np.arange(n - size + 1)
        keep = letter[:-1] | letter[1:] if size == 2 else letter[1:-1]
        at = at[keep]
        buckets.append(mix64(rolling.span(at, at + size) + np.uint64(size)))
        places.append(at)
    place = np.concatenate(places)
    text = np.minimum(np.searchsorted(chunk.doc_start, place, "right") - 1, len(texts) - 1)
    return (np.concatenate(buckets) >> np.uint64(64 - int(BUCKETS).bit_length() + 1)).astype(np.int64), text


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # bucket -> logits
    offset: np.ndarray
    temperature: float
    limit: float

    def logits(self, texts: list[bytes]) -> np.ndarray:
        bucket, text = subwords(texts)
        count = np.maximum(np.bincount(text, minlength=len(texts)), 1)
        sums = [np.bincount(text, self.table[bucket, k], len(texts)) for k in range(len(self.languages))]
        return np.stack(sums, axis=1) / count[:, None] + self.offset

    def answer(self, texts: list[bytes]) -> list[list]:
        if not self.languages:
            return [[UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)]
        p = softmax(self.logits(texts) / self.temperature)
        best, score = p.argmax(axis=1), p.max(axis=1)
        known = [has_letter(t) for t in texts]
        return [[self.languages[b] if k else UNKNOWN for b, k in zip(best, known)],
                [float(s) if k else 0.0 for s, k in zip(score, known)], [bool(k and s >= self.limit) for s, k in zip(score, known)]]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], y: list[str]) -> Model:
    """``bags``: per text its distinct buckets and their shares of all subwords."""
    languages = sorted(set(y))
    if not languages:
        return Model([], np.zeros((0, 0)), np.zeros(0), 1.0, 0.0)
    target = np.array([languages.index(v) for v in y])
    rng = np.random.default_rng(0)
    width = len(languages)
    embed = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS
    out, offset = rng.uniform(-1, 1, (DIMENSIONS, width)), np.zeros(width)
    order = rng.permutation(len(bags))
    back = order[: len(bags) // HELD_BACK] if len(bags) >= 20 * width else order[:0]
    used = order[len(back):]
    steps, done = EPOCHS * len(used), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(used):
            bucket, share = bags[i]
            rate = RATE * (1 - done / steps) + 0.01
            done += 1
            if not len(bucket):
                continue
            x = share @ embed[bucket]
            g = softmax((x @ out + offset)[None])[0]
            g[target[i]] -= 1
            into = out @ g
            out -= rate * np.outer(x, g)
            offset -= 0.1 * rate * g
            embed[bucket] -= np.outer(rate * len(bucket) * share, into) / np.sqrt(len(bucket))
    model = Model(languages, embed @ out, offset, 1.0, 0.0)
    check = back if len(back) else used
    z = np.stack([bags[i][1] @ model.table[bags[i][0]] + offset for i in check])
    temperatures = np.geomspace(0.25, 8, 21)
    loss = [-np.log(softmax(z / t)[np.arange(len(check)), target[check]] + 1e-12).mean() for t in temperatures]
    model.temperature = float(temperatures[int(np.argmin(loss))])
    p = softmax(z / model.temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == target[check]]
    model.limit = float(np.quantile(right, REJECT)) if len(right) else 0.0
    return model


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", each: int = EACH, most: int = MOST) -> Model:
    """Fit on the bounded sample; what reaches the driver are its hashed subword shares."""
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (
        remainder(F.col(id_col), FOLDS) != LEFT_OUT)).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    chosen = first_of_each(rows.select("id", "lang").distinct(), "id", "lang", each, most)  # bounded by ``most``

    def work(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        bucket, text = subwords(texts)
        order = np.argsort(text, kind="stable")
        cuts = np.searchsorted(text[order], np.arange(len(texts) + 1))
        ids, shares = [], []
        for a, b in zip(cuts[:-1], cuts[1:]):
            k, c = np.unique(bucket[order[a:b]], return_counts=True)
            ids.append(k.astype(np.int32))
            shares.append((c / max(b - a, 1)).astype(np.float32))
        return pa.record_batch([batch.column("id").cast(pa.string()), batch.column("lang"), pa.array(ids, pa.list_(pa.int32())),
                                pa.array(shares, pa.list_(pa.float32()))], names=["id", "lang", "buckets", "shares"])

    sample = rows.join(F.broadcast(chosen), ["id", "lang"]).select("id", "lang", "text")
    got = sample.mapInArrow(per_chunk(work, "text"), "id string, lang string, buckets array<int>, shares array<float>").toArrow().sort_by(
        [("id", "ascending"), ("lang", "ascending")])
    buckets, shares = got["buckets"].combine_chunks(), got["shares"].combine_chunks()
    bags = [(buckets[i].values.to_numpy(), shares[i].values.to_numpy().astype(float)) for i in range(got.num_rows)]
    return fit(bags, got["lang"].to_pylist())


def spoken(docs: DataFrame, model: Model, out: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and a struct ``out``: language, score, accepted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return annotated(docs, text_col, out, "language string, score double, accepted boolean", lambda texts: sent.value.answer(texts))


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """One row per document: held_out, lang_pred, score, accepted."""
    model = learn(docs, id_col, text_col, lang_col, **options)
    plain = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    return spoken(plain, model, fresh(plain, "said")).select(
        id_col, in_fold(id_col, FOLDS, LEFT_OUT).alias("held_out"), F.col("said.language").alias("lang_pred"),
        F.col("said.score").alias("score"), F.col("said.accepted").alias("accepted"))
