"""Quality classifier: a generalised additive model with pairwise interactions.

Features are shape statistics of the whole text. Each is cut into quantile bins; cyclic boosting visits one feature after
another and adds a shallow tree over its bins to that feature's lookup table, then does the same for the pairs of features
whose tables leave most of the residual. A score is a sum of table entries, looked up for a whole batch at once.

Fitting uses a sample of at most ``EACH`` documents per label, drawn by hash; scoring reads every text in one narrow pass.

Defined results: null and empty texts have the features of no words and are scored like any other; rows with equal ids are
scored one by one; without labels of both kinds the score is the smoothed share of label 1, and ``informed`` is false.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.llm.common import BLANK_SPLIT, Chunk, annotated, fresh, per_chunk
from barweave.llm.labelled import in_fold, labelled_texts

EACH = 6000
FOLDS, LEFT_OUT = 4, 2
CUT = 0.7
BINS = 24
GRID = 6
PAIRS = 6
ROUNDS = 120
RATE = 0.1
NAMES = ["words", "word_length", "longest", "upper", "digit", "symbol", "mild", "stops", "lines", "distinct", "echo", "bars"]


def byte_classes() -> np.ndarray:
    """0 other, 1 upper case, 2 digit, 3 blank, 4 line end, 5 sentence end, 6 mild punctuation, 7 symbol, 8 bar."""
    out = np.full(256, 7, np.int64)
    out[97:123] = out[128:] = 0
    out[65:91], out[48:58], out[32], out[9] = 1, 2, 3, 3
    out[[10, 13]] = 4
    out[[ord(c) for c in ".!?"]] = 5
    out[[ord(c) for c in ",;:'\"-()"]] = 6
    out[ord("|")] = 8
    return out


CLASSES = byte_classes()


def features(texts: list[bytes]) -> np.ndarray:
    """(texts, features) statistics of whole texts."""
    n = len(texts)
    chunk = Chunk(texts, BLANK_SPLIT)
    raw = np.frombuffer(b" ".join(texts), np.uint8)
    owner = np.repeat(np.arange(n), np.diff(chunk.doc_start))[: len(raw)]
    kinds = np.bincount(owner * 9 + CLASSES[raw], minlength=9 * n).reshape(n, 9).astype(float)
    size = np.maximum(np.array([len(t) for t in texts], float), 1)
    words, first = chunk.words(), chunk.first
    count = np.diff(first).astype(float)
    some = np.maximum(count, 1)
    lengths = (chunk.end - chunk.start).astype(float)
    total = np.concatenate([[0], np.cumsum(lengths)])
    same = np.concatenate([[0], np.cumsum(np.append(False, words[1:] == words[:-1])[: len(words)])])
    longest, distinct = np.zeros(n), np.zeros(n)
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b > a:
            longest[i] = lengths[a:b].max()
            distinct[i] = len(np.unique(words[a:b]))
    echo = same[first[1:]] - same[np.minimum(first[:-1] + 1, first[1:])]
    return np.stack([
        np.log1p(count), (total[first[1:]] - total[first[:-1]]) / some, np.log1p(longest), kinds[:, 1] / size, kinds[:, 2] / size,
        kinds[:, 7] / size, kinds[:, 6] / size, kinds[:, 5] / some, kinds[:, 4] / some,
        distinct / some**0.85, echo / some, kinds[:, 8] / some], axis=1)


@dataclass
class Additive:
    """Lookup tables over binned features and over grids of feature pairs; ``share`` is the answer without tables."""

    share: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    offset: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.tables:
            return np.full(len(x), self.share)
        z = np.full(len(x), self.offset)
        bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)]
        for b, t in zip(bins, self.tables):
            z += t[b]
        for (f, g), grid in zip(self.pairs, self.grids):
            z += grid[self.coarse[f][bins[f]], self.coarse[g][bins[g]]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def best_cut(grad: np.ndarray, weight: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best split of a row of bins."""
    g, h = np.cumsum(grad), np.cumsum(weight)
    left, right = g[:-1] ** 2 / (h[:-1] + 1), (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1)
    gain = left + right - g[-1] ** 2 / (h[-1] + 1)
    k = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[k]), k + 1) if len(gain) else (0.0, 0)


def shallow_tree(grad: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Value per bin of a tree with up to four leaves over ordered bins (Newton steps with ridge 1)."""
    out = np.zeros(len(grad))
    _, k = best_cut(grad, weight)
    for a, b in ((0, k), (k, len(grad))):
        if b > a:
            _, c = best_cut(grad[a:b], weight[a:b])
            for u, v in ((a, a + c), (a + c, b)):
                if v > u:
                    out[u:v] = grad[u:v].sum() / (weight[u:v].sum() + 1)
    return out


def grid_tree(grad: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The same over a grid: one cut along the first axis, one along the second in each half."""
    out = np.zeros(grad.shape)
    _, k = best_cut(grad.sum(axis=1), weight.sum(axis=1))
    for rows in (slice(0, k), slice(k, len(grad))):
        g, h = grad[rows].sum(axis=0), weight[rows].sum(axis=0)
        _, c = best_cut(g, h)
        for cols in (slice(0, c), slice(c, len(g))):
            out[rows, cols] = g[cols].sum() / (h[cols].sum() + 1)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    share = (y.sum() + 1) / (len(y) + 2)
    model = Additive(float(share))
    if not 0 < y.sum() < len(y):
        return model
    model.offset = float(np.log(share / (1 - share)))
    model.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    model.coarse = [(np.arange(len(e) + 1) * GRID // (len(e) + 1)).astype(int) for e in model.edges]
    z = np.full(len(y), model.offset)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, b in enumerate(bins):
            r, h = residual()
            n = len(model.tables[f])
            step = RATE * shallow_tree(np.bincount(b, r, n), np.bincount(b, h, n))
            model.tables[f] += step
            z += step[b]
    cells = {}
    r, h = residual()
    for f in range(len(bins)):
        for g in range(f):
            cell = model.coarse[f][bins[f]] * GRID + model.coarse[g][bins[g]]
            grad, weight = np.bincount(cell, r, GRID * GRID), np.bincount(cell, h, GRID * GRID)
            cells[f, g] = (float((grad**2 / (weight + 1)).sum()), cell)
    model.pairs = sorted(cells, key=lambda k: -cells[k][0])[:PAIRS]
    model.grids = [np.zeros((GRID, GRID)) for _ in model.pairs]
    for _ in range(ROUNDS // 2):
        for k, pair in enumerate(model.pairs):
            r, h = residual()
            cell = cells[pair][1]
            step = RATE * grid_tree(np.bincount(cell, r, GRID * GRID).reshape(GRID, GRID), np.bincount(cell, h, GRID * GRID).reshape(GRID, GRID))
            model.grids[k] += step
            z += step.ravel()[cell]
    return model


def learn(docs: DataFrame, labels: DataFrame, target: str = "quality", each: int = EACH, id_col: str = "doc_id", text_col: str = "text") -> Additive:
    """Fit on the bounded sample; what reaches the driver are its feature rows."""

    def work(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        x = features(texts)
        return pa.record_batch([batch.column("id").cast(pa.string()), batch.column("target"),
                                pa.array(list(x), pa.list_(pa.float64()))], names=["id", "target", "x"])

    sample = labelled_texts(docs, labels, target, FOLDS, LEFT_OUT, each, id_col, text_col)
    rows = sample.mapInArrow(per_chunk(work, "text"), "id string, target int, x array<double>").collect()
    rows.sort(key=lambda r: (r["id"], r["target"], r["x"]))
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(NAMES))
    return fit(x, np.array([r["target"] for r in rows], float))


def graded(docs: DataFrame, model: Additive, out: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and a struct ``out`` with the score."""
    return annotated(docs, text_col, out, "score double, informed boolean", lambda texts: [
        model.score(features(texts)), [bool(model.tables)] * len(texts)])


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT, **options) -> DataFrame:
    """One row per document: held_out, score, predicted."""
    model = learn(docs, labels, id_col=id_col, text_col=text_col, **options)
    plain = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    return graded(plain, model, "grade").select(
        id_col, in_fold(id_col, FOLDS, LEFT_OUT).alias("held_out"), F.col("grade.score").alias("score"),
        (F.col("grade.score") >= cut).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, text_col: str = "text", cut: float = CUT, **options) -> DataFrame:
    """The documents that the model does not reject, with their own columns; all of them where nothing could be learned."""
    model = learn(docs, labels, text_col=text_col, **options)
    out = fresh(docs, "grade")
    return graded(docs, model, out, text_col).where((F.col(out)["score"] >= cut) | ~F.col(out)["informed"]).drop(out)
