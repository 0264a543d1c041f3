"""Shared helpers: stored intermediates, byte-level word scanning and polynomial hashes over whole text buffers.

Texts reach Python as UTF-8 bytes in Arrow batches. A batch is cut into chunks of about ``CHUNK`` bytes, so memory follows
the chunk and the longest single text, never the partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from barweave.session import drop_path, scratch_path

CHUNK = 1 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: later steps neither recompute nor depend on executors' disks."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def released(*frames: DataFrame) -> None:
    """Deletes what ``saved`` wrote for these frames; nothing that is still to run may read them."""
    for df in frames:
        drop_path(df.sparkSession, df.saved_at)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], rows: str, share: int = 1000) -> DataFrame:
    """Inner join with ``right``, which has one row per key and in ``rows`` the number of left rows of that key. Keys with more
    than 1/share of all left rows, fewer than ``share`` of them, are broadcast and meet their rows where those lie; the others
    are shuffled."""
    heavy = right.withColumn("_all", right.agg(F.sum(rows)).scalar()).where(F.col(rows) * share > F.col("_all")).drop("_all")
    here = left.join(F.broadcast(heavy), keys)
    rest = left.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(right, keys)
    return here.unionByName(rest)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold rule of the labelled operators."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93)) | _U(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK + 1024)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


class Rolling:
    """Prefix sums of a polynomial hash over one buffer; ``span`` hashes any number of slices at once."""

    def __init__(self, data: np.ndarray):
        forward, self.back = powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * forward[: len(data)], out=self.sums[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.back[start])


def lower_table() -> np.ndarray:
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    return low


LOWER = lower_table()
SAME = np.arange(256, dtype=np.uint8)
#: Bytes of words split at blanks and line ends only.
BLANK_SPLIT = np.ones(256, bool)
BLANK_SPLIT[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of words made of digits, letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


class Chunk:
    """Some whole texts in one buffer, lower-cased unless ``fold`` says otherwise, a blank between them, with the bounds of their words."""

    def __init__(self, texts: list[bytes], word: np.ndarray, fold: np.ndarray = LOWER):
        self.data = fold[np.frombuffer(b" ".join(texts), np.uint8)]
        sizes = np.array([len(t) for t in texts], np.int64)
        self.doc_start = np.concatenate([[0], np.cumsum(sizes + 1)])
        inside = np.zeros(len(self.data) + 2, np.int8)
        inside[1:-1] = word[self.data]
        edge = np.diff(inside)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.start, self.doc_start)
        self.rolling = Rolling(self.data)

    def words(self) -> np.ndarray:
        return self.rolling.span(self.start, self.end)


def chunks(sizes: list[int], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of about ``limit`` bytes, one text at least."""
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def pieces_of(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 bytes of each text) for parts of about ``limit`` bytes; null counts as empty. Only one part at a time is
    held as Python objects beside the batch."""
    raw = column.cast(pa.binary())
    for lo, hi in chunks(pc.fill_null(pc.binary_length(raw), 0).to_pylist(), limit):
        yield lo, [x or b"" for x in raw.slice(lo, hi - lo).to_pylist()]


def per_chunk(work: Callable[[pa.RecordBatch, list[bytes]], pa.RecordBatch], text_col: str, limit: int = CHUNK):
    """mapInArrow function that hands ``work`` slices of a batch and the bytes of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in pieces_of(batch.column(text_col), limit):
                yield work(batch.slice(lo, len(texts)), texts)

    return run


def crc_text(value: int, n: int) -> int:
    return zlib.crc32(str(value).encode()) % n


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores appended until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def annotated(docs: DataFrame, text_col: str, out: str, ddl: str, work: Callable[[list[bytes]], list], limit: int = CHUNK) -> DataFrame:
    """All columns of ``docs`` and a struct ``out`` with fields ``ddl``; ``work`` maps a chunk of texts to one list a field.
    No shuffle and no join, so repeated rows and null ids are answered row by row."""
    fields = T.StructType.fromDDL(ddl)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, fields)])
    arrow, at = to_arrow_type(fields), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in pieces_of(batch.column(at), limit):
                columns = [pa.array(values, kind.type) for values, kind in zip(work(texts), arrow)]
                part = batch.slice(lo, len(texts))
                made = pa.StructArray.from_arrays(columns, fields=list(arrow))
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=schema.names)

    return docs.mapInArrow(run, schema)
