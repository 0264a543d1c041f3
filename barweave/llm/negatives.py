"""Hard-negative mining by a BOND scan: vectors cut into columns, read in the order of the anchor's largest components.

Components are quantised to integers. Rows are dealt by hash into blocks of at most ``MOST`` vectors; a block is held as one
array per dimension, with the smallest and largest value of each. An anchor reads a block's dimensions in descending order of its
own magnitudes, ``STEP`` at a time. After each step a candidate's partial sum, plus the least and the most that the unread
dimensions can still add, bounds its score from both sides, and the bitmap of candidates shrinks to those that can still lie in
one of the anchor's score windows. A window's lower edge rises to the k-th best score that is already certain to lie inside it.
What is left is summed to the end, so scores are exact, and the k best of each window leave the block.

The scan runs twice. First the blocks hold rows of one label and every anchor has one open window among its own label: its
positives. Then the blocks hold all labels and each positive's score opens a window ``[low, high]`` of shares of that score among
the rows of other labels. A task keeps one block and streams the anchors past it: anchors are sent once to each block they must
meet, candidates once in all, so what is shuffled is anchors x blocks, and no pairs of rows are formed. An anchor's results of one
block are at most k a window.

Defined results: rows with null id or label, and vectors that are null, empty or hold null or non-finite components, take no
part; shorter vectors count as padded with zeros. Equal rows count once. Different vectors or labels under one id are separate
candidates and separate anchors, and never each other's positives or negatives. Ties go to the smaller id. An anchor without
positives, or without negatives in a window, has no row there. Scores are exact while they fit 53 bits. An empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.llm.common import saved, spread_join

K = 5
SCALE = 256
EVERY = 100
LOW, HIGH = 80, 100
STEP = 8
LEAST, MOST, COMPONENTS = 1024, 1 << 16, 1 << 23
_SCHEMA = "anchor bigint, nth int, window int, id bigint, score bigint"


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, v array<double>) of the rows that take part, each once."""
    x = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.size(x) > 0) & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    v = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("double"))
    rows = vectors.where(F.coalesce(fine, F.lit(False)))
    return rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v")).distinct()


def dense(column: pa.Array, width: int) -> np.ndarray:
    """Rows x width, short lists padded with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Fragments:
    """A block cut vertically: one contiguous array a dimension, with its extremes."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        names, codes = np.unique(labels[order], return_inverse=True)
        self.ids, self.code, self.codes = ids[order], {n: c for c, n in enumerate(names)}, codes
        self.columns = np.ascontiguousarray(rows[order].T)
        self.least, self.most = self.columns.min(axis=1), self.columns.max(axis=1)

    def scan(self, anchor: np.ndarray, bitmap: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(window, rows, scores) of the k best rows of ``bitmap`` in each window [low, high], ties to smaller ids."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        a, b = anchor * self.least, anchor * self.most
        down, up = np.minimum(a, b)[order], np.maximum(a, b)[order]
        down, up = down.sum() - np.cumsum(down), up.sum() - np.cumsum(up)
        low = low.astype(float).copy()
        alive, sums = np.flatnonzero(bitmap), None
        for at in range(0, len(order), STEP):
            if not len(alive):
                return []
            dims = order[at:at + STEP]
            whole = len(alive) == len(self.ids)
            part = anchor[dims] @ (self.columns[dims] if whole else self.columns[dims[:, None], alive[None]])
            sums = part if sums is None else sums + part
            last = min(at + STEP, len(order)) - 1
            floor, ceiling = sums + down[last], sums + up[last]
            keep = np.zeros(len(alive), bool)
            for w in range(len(low)):
                sure = (floor >= low[w]) & (ceiling <= high[w])
                if np.count_nonzero(sure) >= k:
                    low[w] = max(low[w], np.partition(floor[sure], -k)[-k])
                keep |= (ceiling >= low[w]) & (floor <= high[w])
            alive, sums = alive[keep], sums[keep]
        out = []
        for w in range(len(low)):
            inside = np.flatnonzero((sums >= low[w]) & (sums <= high[w]))
            if len(inside):
                top = inside[np.lexsort((self.ids[alive[inside]], -sums[inside]))[:k]]
                out.append((w, alive[top], sums[top]))
        return out


def scanned(candidates: DataFrame, anchors: DataFrame, keys: list[str], same: bool, width: int, k: int) -> DataFrame:
    """(anchor, nth, window, id, score): each block's k best for every window of the anchors sent to it.

    ``candidates`` has ``keys`` of its block, id, label, v; ``anchors`` the keys of one block to meet, id, nth, label, v and the
    windows ``low``, ``high``. Rows of a block arrive sorted, candidates first, whatever batches they come in."""
    flat = [*keys, "kind", "id", "nth", "label", "v", "low", "high"]
    empty = F.array().cast("array<double>")
    held = candidates.withColumns({"kind": F.lit(0), "nth": F.lit(0), "low": empty, "high": empty}).select(*flat)
    met = held.unionByName(anchors.withColumn("kind", F.lit(1)).select(*flat)).repartition(*keys).sortWithinPartitions(*keys, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, fragments = None, [], None
        for batch in batches:
            names = [batch.column(c).to_pylist() for c in keys]
            kind = batch.column("kind").to_numpy(zero_copy_only=False)
            cuts = [0, *(i for i in range(1, len(kind)) if kind[i] != kind[i - 1] or any(n[i] != n[i - 1] for n in names)), len(kind)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                here, piece = tuple(n[lo] for n in names), batch.slice(lo, hi - lo)
                if here != block:
                    block, parts, fragments = here, [], None
                ids = piece.column("id").to_numpy()
                labels = np.array(piece.column("label").to_pylist(), object)
                rows = dense(piece.column("v"), width)
                if kind[lo] == 0:
                    parts.append((ids, labels, rows))
                    continue
                if fragments is None and parts:
                    fragments, parts = Fragments(*(np.concatenate(x) for x in zip(*parts))), []
                if fragments is None:
                    continue
                found = []
                lows, highs, nths = piece.column("low").to_pylist(), piece.column("high").to_pylist(), piece.column("nth").to_pylist()
                for i in range(len(ids)):
                    bitmap = ((fragments.codes == fragments.code.get(labels[i], -1)) == same) & (fragments.ids != ids[i])
                    for w, at, scores in fragments.scan(rows[i], bitmap, np.array(lows[i]), np.array(highs[i]), k):
                        found += [(int(ids[i]), nths[i], w, int(fragments.ids[j]), int(s)) for j, s in zip(at, scores)]
                if found:
                    columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["anchor", "nth", "window", "id", "score"])

    return met.mapInArrow(run, _SCHEMA)


def first(rows: DataFrame, k: int) -> DataFrame:
    """The k best of every window with their rank."""
    order = Window.partitionBy("anchor", "nth", "window").orderBy(F.col("score").desc(), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: Column, k: int = K, low: int = LOW, high: int = HIGH, id_col: str = "vec_id",
                   vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE, least: int = LEAST, most: int = MOST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for the rows of ``vectors`` that the condition
    ``anchors`` picks, the k best rows of the same label, and for each of these the k best rows of other labels whose score lies
    between ``low`` and ``high`` percent of its score. Blocks hold ``least`` to ``most`` rows and ``COMPONENTS`` numbers at most; results do not depend on them."""
    rows = saved(usable(vectors, id_col, vector_col, label_col, scale), "vectors")
    picked = usable(vectors.where(anchors), id_col, vector_col, label_col, scale)
    asked = saved(picked.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("label", "v"))), "anchors")
    total, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not total:
        return rows.select(*(F.lit(0).cast(t).alias(n) for n, t in (("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), (
            "negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint"))))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = min(most, max(1, COMPONENTS // width), max(least, -(-total // tasks)))

    def part(of: Column | int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit("block")), F.lit(of)).cast("int")

    # Positives: blocks of one label, as many as its rows need.
    labels = saved(rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / size).cast("int")), "labels")
    dealt = spread_join(rows, labels, ["label"], "n").select(F.col("label").alias("group"), part(F.col("parts")).alias("block"), "id", "label", "v")
    sent = spread_join(asked, labels, ["label"], "n").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    open_window = {"group": F.col("label"), "low": F.array(F.lit(float("-inf"))), "high": F.array(F.lit(float("inf")))}
    scores = scanned(dealt, sent.withColumns(open_window), ["group", "block"], True, width, k)
    positives = saved(first(scores, k).select("anchor", "nth", F.col("id").alias("positive"), "score", (F.col("rank") - 1).alias("window")), "positives")

    # Negatives: blocks of all labels; one window a positive, its edges rounded inwards to whole scores.
    blocks = max(1, -(-total // size))
    edge = lambda share: F.col("score") * F.lit(share) / F.lit(100)
    bounds = positives.groupBy("anchor", "nth").agg(F.sort_array(F.collect_list(F.struct(
        "window", F.ceil(edge(low)).cast("double").alias("low"), F.floor(edge(high)).cast("double").alias("high")))).alias("w"))
    wide = asked.join(bounds, (asked["id"] == bounds["anchor"]) & (asked["nth"] == bounds["nth"])).select(
        "id", asked["nth"], "label", "v", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    wide = wide.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    scores = scanned(rows.withColumn("block", part(blocks)), wide, ["block"], False, width, k)
    negatives = first(scores, k).select("anchor", "nth", "window", F.col("id").alias("negative"), F.col("score").alias("negative_score"), "rank")
    return positives.join(negatives, ["anchor", "nth", "window"]).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("negative").alias("negative_id"),
        F.col("score").alias("positive_score"), "negative_score")
