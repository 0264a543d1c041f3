"""Audit of a scored stream in blocks of consecutive rows per entity, kept as state across micro-batches."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barweave.operators.quality import block_failures
from barweave.operators.sentiment import PROBS

BLOCK = 4096
#: Rows audited, time and id of the last one, late rows; then the open block: rows, largest sum error, count, mean and squared
#: deviations of the positive probability, count and number of near-uniform rows.
STATE = "rows long, last_ts long, last_id string, late long, n long, err double, p_n long, p_mean double, p_m2 double, u_n long, u_sum long"
BLOCK_ROW = "block long, n long, max_sum_error double, sd_positive double, uniform_share double, closed boolean, late long, upto long"


class AuditFailed(RuntimeError):
    """A closed block failed its audit."""


class OpenBlock:
    """Mergeable figures of the rows of one block."""

    def __init__(self, n: int = 0, err: float | None = None, p_n: int = 0, p_mean: float = 0.0, p_m2: float = 0.0, u_n: int = 0, u_sum: int = 0):
        self.n, self.err, self.p_n, self.p_mean, self.p_m2, self.u_n, self.u_sum = n, err, p_n, p_mean, p_m2, u_n, u_sum

    def add(self, probs: np.ndarray) -> None:
        """Takes in rows of (positive, negative, neutral); unknown values as NaN."""
        self.n += len(probs)
        errors = np.abs(probs.sum(axis=1) - 1.0)
        if np.isfinite(errors).any():
            self.err = max(float(np.nanmax(errors)), -1.0 if self.err is None else self.err)
        known = probs[~np.isnan(probs[:, 0]), 0]
        if len(known):
            mean, total = known.mean(), self.p_n + len(known)
            shift = mean - self.p_mean
            self.p_m2 += float(((known - mean) ** 2).sum() + shift * shift * self.p_n * len(known) / total)
            self.p_mean, self.p_n = float(self.p_mean + shift * len(known) / total), total
        third = np.abs(probs - 1.0 / 3.0) < 0.01
        unknown = np.isnan(probs)
        decided = (~third & ~unknown).any(axis=1) | ~unknown.any(axis=1)
        self.u_n += int(decided.sum())
        self.u_sum += int((third.all(axis=1) & decided).sum())

    def state(self) -> tuple:
        return self.n, self.err, self.p_n, self.p_mean, self.p_m2, self.u_n, self.u_sum

    def row(self, number: int, closed: bool, late: int, upto: int) -> tuple:
        spread = float(np.sqrt(max(self.p_m2, 0.0) / self.p_n)) if self.p_n else None
        return number, self.n, self.err, spread, self.u_sum / self.u_n if self.u_n else None, closed, late, upto


def in_order(chunks: list[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Times, ties and probabilities (a row each) of a group's rows in the order (time, tie); rows equal in both keep theirs. Most groups
    are a few rows in one chunk, so columns are taken as arrays, and ties are compared only where times are equal."""
    taken = [np.concatenate([c[name].to_numpy(kind) for c in chunks]) for name, kind in (("_us", None), ("_tie", object), *((p, float) for p in PROBS))]
    us, ids = taken[:2]
    order = np.argsort(us, kind="stable")
    if (us[order][1:] == us[order][:-1]).any():
        order = np.array(sorted(range(len(us)), key=lambda i: (us[i], ids[i])))
    return us[order], ids[order], np.stack(taken[2:], axis=1)[order]


def audited_blocks(scored: DataFrame, block: int = BLOCK, idle: str | None = None, entity: str = "entity", ts: str = "ts", tie: str = "article_id") -> DataFrame:
    """Stream of block figures per entity, in update mode: every closed block, and the open block as far as the micro-batch came.

    Rows without a time are left out. Rows of an entity are taken in the order (ts, tie) inside a micro-batch and one micro-batch after the other, so a block may
    begin in one and end in a later one. A row that sorts before a row already audited is late: it is counted, in ``late``, and not
    audited. With ``idle``, an interval of event time, an entity whose last row is that far behind the stream has its open block closed.
    Time and memory of one entity follow its rows in one micro-batch; its state is one row. ``upto`` orders the versions of a block.
    """
    whole = isinstance(scored.schema[tie].dataType, T.IntegralType)
    order = F.lpad((F.col(tie).cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0") if whole else F.col(tie).cast("string")
    stamp = F.col(ts).cast("timestamp")
    # Every column costs its conversion once a group: the timestamp itself goes along for a watermark only.
    keyed = scored.where(F.col(ts).isNotNull()).select(
        F.col(entity), F.unix_micros(stamp).alias("_us"), *([] if idle is None else [stamp.alias("_ts")]),
        F.coalesce(order, F.lit("")).alias("_tie"), *[F.col(p).cast("double").alias(p) for p in PROBS])
    if idle is not None:
        keyed = keyed.withWatermark("_ts", "0 seconds")

    def step(key: tuple[Any, ...], chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, last_ts, last_id, late, *held = state.get if state.exists else (0, -(1 << 62), "", 0)
        open_block = OpenBlock(*held)
        out = []
        if state.hasTimedOut:
            if open_block.n:
                out.append(open_block.row((rows - 1) // block, True, late, rows))
            state.remove()
        else:
            us, ids, probs = in_order(list(chunks))
            behind = (us < last_ts) | ((us == last_ts) & (ids < last_id))
            late += int(behind.sum())
            probs = probs[~behind]
            at = 0
            while at < len(probs):
                take = min(block - open_block.n, len(probs) - at)
                open_block.add(probs[at:at + take])
                at, rows = at + take, rows + take
                if open_block.n == block:
                    out.append(open_block.row((rows - 1) // block, True, late, rows))
                    open_block = OpenBlock()
            if len(probs):
                last_ts, last_id = int(us[~behind][-1]), str(ids[~behind][-1])
            if open_block.n:
                out.append(open_block.row((rows - 1) // block, False, late, rows))
            state.update((rows, last_ts, last_id, late, *open_block.state()))
            if idle is not None and rows:
                state.setTimeoutTimestamp(max(last_ts // 1000, state.getCurrentWatermarkMs()) + span_ms)
        if out:
            yield pd.DataFrame({entity: [key[0]] * len(out), **dict(zip(names, map(list, zip(*out))))})

    names = [field.split()[0] for field in BLOCK_ROW.split(", ")]
    span_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle is not None else 0
    kind = scored.select(entity).schema[0].dataType.simpleString()
    wait = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.EventTimeTimeout
    return keyed.groupBy(entity).applyInPandasWithState(step, f"{entity} {kind}, {BLOCK_ROW}", STATE, "update", wait)


def audit_stream(scored: DataFrame, sink: str, checkpoint: str, block: int = BLOCK, idle: str | None = None, halt: bool = False,
                 entity: str = "entity", ts: str = "ts", tie: str = "article_id") -> StreamingQuery:
    """Audit a stream block by block and write the findings of each micro-batch; a replayed batch overwrites its own folder.
    With ``halt`` the query ends with an error, after its findings are written, at the first closed block that fails."""

    def write(batch: DataFrame, batch_id: int) -> None:
        path = f"{sink}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(path)
        if halt:
            bad = batch.sparkSession.read.parquet(path).where(F.col("closed") & (F.size("failures") > 0)).select(entity, "block", "failures").first()
            if bad is not None:
                raise AuditFailed(f"block {bad['block']} of {bad[entity]}: {', '.join(bad['failures'])}")

    found = block_failures(audited_blocks(scored, block, idle, entity, ts, tie))
    return found.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_blocks(findings: DataFrame, entity: str = "entity") -> DataFrame:
    """The last version of each block among the findings that ``audit_stream`` wrote."""
    order = Window.partitionBy(entity, "block").orderBy(F.col("upto").desc(), F.col("closed").desc(), F.col("late").desc())
    return findings.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") == 1).drop("_nth", "batch")
