"""Trailing frames of any length from frames of power-of-two length (a sparse table along time), on columns of whole entities.

A frame of 2^k rows is the one of 2^(k-1) rows ending here joined with the one ending 2^(k-1) rows earlier, so six steps give all
frames up to 64 rows, whatever lengths are asked for; a frame of d rows joins a few of them (sums) or two that overlap (extremes).
Every step works on all rows of a batch at once, and the work per row is logarithmic in the lengths. Nothing runs from the
start of the history: a missing or odd bar touches the frames that hold it and no later one. Squared deviations and
co-deviations are joined by their means (never as differences of power sums).

Unknown values are NaN. A value is unknown unless all d rows of its frame are known; extremes skip unknown rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barweave.operators.ordering import changes


def blocks(d: int) -> list[tuple[int, int]]:
    """(power, rows back) of the power-of-two frames that make up d rows."""
    out, back = [], 0
    for k in range(d.bit_length() - 1, -1, -1):
        if d >> k & 1:
            out.append((k, back))
            back += 1 << k
    return out


def above_zero(x: np.ndarray) -> np.ndarray:
    """Rounding may leave a sum of squares just below zero."""
    return np.where(x < 0, 0.0, x)


def log(x: np.ndarray) -> np.ndarray:
    return np.log(np.where(x > 0, x, np.nan))


class Frames:
    """Frames over the named columns of rows sorted by entity and time; ``at`` is each row's place in its entity. Frames of
    power-of-two length are made when first asked for and kept."""

    def __init__(self, columns: dict[str, np.ndarray], at: np.ndarray):
        self.columns, self.at = columns, at
        self.made: dict[tuple, np.ndarray] = {}

    def __getitem__(self, c: str) -> np.ndarray:
        return self.columns[c]

    def earlier(self, x: np.ndarray, rows: int) -> np.ndarray:
        """``x`` of ``rows`` rows before in the same entity."""
        if not rows:
            return x
        out = np.full(len(x), np.nan)
        out[rows:] = x[:-rows]
        out[self.at < rows] = np.nan
        return out

    def power(self, kind: str, of: tuple[str, ...], k: int, back: int = 0) -> np.ndarray:
        """Totals ("s"), co-deviations ("q") or extremes ("hi", "lo") of the 2^k rows that end ``back`` rows earlier."""
        key = (kind, of, k, back)
        if key not in self.made:
            self.made[key] = self.earlier(self.power(kind, of, k), back) if back else self.joined(kind, of, k)
        return self.made[key]

    def joined(self, kind: str, of: tuple[str, ...], k: int) -> np.ndarray:
        if k == 0:
            return np.where(np.isnan(self[of[0]]) | np.isnan(self[of[1]]), np.nan, 0.0) if kind == "q" else self[of[0]]
        half = 1 << (k - 1)
        a, b = self.power(kind, of, k - 1), self.power(kind, of, k - 1, half)
        if kind == "s":
            return a + b
        if kind == "q":
            apart = [self.power("s", (c,), k - 1) - self.power("s", (c,), k - 1, half) for c in of]
            return a + b + apart[0] * apart[1] / (2.0 * half)
        return (np.fmax if kind == "hi" else np.fmin)(a, b)

    def total(self, c: str, d: int) -> np.ndarray:
        """Sum of the last d rows."""
        parts = [self.power("s", (c,), k, back) for k, back in blocks(d)]
        return sum(parts[1:], parts[0])

    def mean(self, c: str, d: int) -> np.ndarray:
        return self.total(c, d) / d

    def known(self, c: str, d: int, value: np.ndarray) -> np.ndarray:
        """``value`` where all d rows of ``c`` are known."""
        return np.where(np.isnan(self.total(c, d)), np.nan, value)

    def deviations(self, a: str, b: str, d: int) -> np.ndarray:
        """Summed products of deviations of a and b over the last d rows."""
        (k, back), *rest = blocks(d)
        n, sums = 1 << k, [self.power("s", (c,), k, back) for c in (a, b)]
        out = self.power("q", (a, b), k, back)
        for k, back in rest:
            m, more = 1 << k, [self.power("s", (c,), k, back) for c in (a, b)]
            apart = [s / n - t / m for s, t in zip(sums, more)]
            out = out + self.power("q", (a, b), k, back) + apart[0] * apart[1] * (n * m / (n + m))
            n, sums = n + m, [s + t for s, t in zip(sums, more)]
        return out

    def stddev(self, c: str, d: int) -> np.ndarray:
        """Sample deviation of the last d rows."""
        return np.sqrt(above_zero(self.deviations(c, c, d)) / (d - 1)) if d > 1 else np.full(len(self.at), np.nan)

    def corr(self, x: str, y: str, d: int, flat: float) -> np.ndarray:
        """Correlation over the last d rows; unknown where a side deviates by ``flat`` at most."""
        sx, sy = (np.sqrt(above_zero(self.deviations(c, c, d)) / d) for c in (x, y))
        return np.where((sx > flat) & (sy > flat), self.deviations(x, y, d) / d / (sx * sy), np.nan)

    def extreme(self, kind: str, c: str, d: int) -> np.ndarray:
        k = d.bit_length() - 1
        return (np.fmax if kind == "hi" else np.fmin)(self.power(kind, (c,), k), self.power(kind, (c,), k, d - (1 << k)))

    def rank(self, c: str, d: int) -> np.ndarray:
        """Average-tie percentile of the current value among the last d: smaller ones count twice, equal ones once."""
        key = ("rank", (c,), d)
        if key not in self.made:
            shorter = max((n for kind, of, n, *_ in self.made if kind == "rank" and of == (c,) and n < d), default=0)
            doubled = self.made[("rank", (c,), shorter)] if shorter else np.ones(len(self.at))
            for rows in range(shorter, d):
                past = self.earlier(self[c], rows)
                doubled = doubled + 2.0 * (past < self[c]) + (past == self[c])
            self.made[key] = doubled
        return self.known(c, d, self.made[key] / (2.0 * d))


def by_whole_entities(df: DataFrame, entity: str, date: str, schema: T.StructType,
                      work: Callable[[pa.Table, np.ndarray, np.ndarray], pa.Table]) -> DataFrame:
    """``work`` on the rows of whole entities in time order, with each row's entity (from 0) and place in it: one exchange and one
    sort. A task holds a batch and the rows of one entity, at most one a date."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if held:
                edge = pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), rows.slice(0, 1)])
                starts = np.flatnonzero(np.r_[changes([edge[entity]])[1:], changes([rows[entity]])[1:]])
            else:
                starts = np.flatnonzero(changes([rows[entity]])[1:]) + 1
            if len(starts):
                last = int(starts[-1])
                yield from done(pa.concat_tables([*held, rows.slice(0, last)]))
                held, rows = [], rows.slice(last)
            held.append(rows)
        if held:
            yield from done(pa.concat_tables(held))

    def done(rows: pa.Table) -> list[pa.RecordBatch]:
        new = changes([rows[entity]])
        number, place = np.cumsum(new) - 1, np.arange(rows.num_rows)
        with np.errstate(all="ignore"):
            out = work(rows.combine_chunks(), number, place - place[new][number])
        return out.select(schema.names).to_batches(max_chunksize=10000)

    return df.repartition(entity).sortWithinPartitions(entity, date).mapInArrow(run, schema)
