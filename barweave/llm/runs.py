"""Periodic runs in word sequences: tiles per period octave, boundary Z-functions, fragments stitched by document and period.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least ``max(LEAST, 2 q)`` words
long, that no neighbouring word extends. Periods are taken by octave. An octave of periods p, P <= p < 2 P, has a boundary at
every multiple of P, and every run with such a period holds a boundary c with c + p still inside. Around each boundary lies a
tile, 2 P words to its left and 4 P to its right, so neighbouring tiles overlap. Two Z-functions of the tile tell for every p how
far the words from c on equal those from c + p on, and the words before c those before c + p: together the run's stretch inside
the tile. The same Z-function shows whether a divisor of p is a period too; such stretches belong to another octave. A sieve on
rolling word hashes skips tiles in which no period can reach the least length; it has no false negatives, and what it lets
through is settled on the words themselves.

Fragments of neighbouring tiles with one period belong to one run exactly if they share p words or more. Fragments that meet in
one task are joined there; then all are shuffled by document and period and stitched by one window.

Tiles of a document lie in the task that read it, unless its text exceeds ``LONG`` bytes: it is then exploded into slices
of words per range of octaves, each a row with the overlap its tiles need, which are dealt over all tasks. Work is
n log n word steps a document and memory follows the longest slice; what is shuffled are fragments, the slices of long documents
and, at the end, the texts that hold runs.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``, compared as they stand. Null and empty texts have no words and no runs, and
collapse to the empty text. Rows with equal or null ids are answered one by one. Runs come ordered by start, then period. A
collapsed text keeps the words that are in no run, or in the first q words of each run that holds them, joined by one blank.
Other columns of the input are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barweave.llm.common import BLANK_SPLIT, SAME, Chunk, annotated, pieces_of, powers, saved

LEAST = 12
LONG = 1 << 22
SLICE = 1 << 17
Fragment = tuple[int, int, int]


class Octave(NamedTuple):
    """Periods least <= p < end, boundaries every ``step`` words, and how far a tile reaches to the left and right of one."""

    least: int
    end: int
    step: int
    left: int
    right: int


def octaves(n: int) -> Iterator[Octave]:
    """Octaves of a text of n words. The shortest periods share one: their runs need ``LEAST`` words, so steps of 4 suffice."""
    if n >= LEAST:
        yield Octave(1, 8, 4, LEAST, LEAST + 4)
    p = 8
    while 2 * p <= n:
        yield Octave(p, 2 * p, p, 2 * p, 4 * p)
        p *= 2


@lru_cache(1 << 16)
def primes(n: int) -> tuple[int, ...]:
    out, f = [], 2
    while f * f <= n:
        if n % f == 0:
            out.append(f)
            while n % f == 0:
                n //= f
        f += 1
    return (*out, n) if n > 1 else tuple(out)


def z_values(s: list[int], upto: int) -> list[int]:
    """How long s and its rest from each place below ``upto`` agree."""
    n = len(s)
    z = [n] + [0] * (max(upto, 1) - 1)
    lo = hi = 0
    for i in range(1, min(upto, n)):
        k = min(hi - i, z[i - lo]) if i < hi else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > hi:
            lo, hi = i, i + k
    return z


class Slice(NamedTuple):
    """Words of a text: where they begin, the boundaries to answer (word numbers of the whole text), and the octaves' least periods."""

    base: int = 0
    first: int = 0
    last: int = 1 << 62
    finest: int = 0
    coarsest: int = 1 << 62


class Sieve:
    """Rolling hashes over the words of some texts."""

    def __init__(self, texts: list[bytes]):
        chunk = Chunk(texts, BLANK_SPLIT, SAME)
        self.first, self.words = chunk.first, chunk.words()
        n = len(self.words)
        forward, self.back = powers(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.words * forward[:n], out=self.sums[1:])

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` words from a and b on agree."""
        return (self.sums[a + size] - self.sums[a]) * self.back[a] == (self.sums[b + size] - self.sums[b]) * self.back[b]

    def candidates(self, octave: Octave, slices: list[Slice]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, boundary as word of the chunk, period) of all pairs that may reach the least length; ordered."""
        marks, owner = [], []
        for t, (s, a, b) in enumerate(zip(slices, self.first[:-1], self.first[1:])):
            if b - a < max(LEAST, 2 * octave.least) or not s.finest <= octave.least < s.coarsest:
                continue
            lo, hi = max(s.first, s.base), min(s.last, s.base + int(b - a) - octave.least + 1)
            lo += -lo % octave.step
            if lo < hi:
                marks.append(np.arange(lo, hi, octave.step) - s.base + a)
                owner.append(np.full(len(marks[-1]), t))
        if not marks:
            return (np.zeros(0, np.int64),) * 3
        c, text = np.concatenate(marks), np.concatenate(owner)
        begin, end = self.first[text], self.first[text + 1]
        width = octave.end - octave.least
        view = np.lib.stride_tricks.sliding_window_view(np.concatenate([self.words, np.zeros(octave.end + 1, np.uint64)]), width)
        q = c[:, None] + np.arange(octave.least, octave.end)
        ahead = (view[c + octave.least] == self.words[np.minimum(c, len(self.words) - 1)][:, None]) & (q < end[:, None])
        behind = (view[c + octave.least - 1] == self.words[np.maximum(c - 1, 0)][:, None]) & (q <= end[:, None]) & (c > begin)[:, None]
        i, j = np.nonzero(ahead | behind)
        ahead, behind, p, c, text, begin, end = ahead[i, j], behind[i, j], j + octave.least, c[i], text[i], begin[i], end[i]
        need = (np.maximum(LEAST - p, p) + 1) // 2  # one side must agree for half of what the run needs beyond one period
        ahead &= c + p + need <= end
        behind &= c - need >= begin
        ahead[ahead] = self.same(c[ahead], (c + p)[ahead], need[ahead])
        behind[behind] = self.same((c - need)[behind], (c + p - need)[behind], need[behind])
        keep = ahead | behind
        return text[keep], c[keep], p[keep]


def tile_fragments(ids: list[int], c: int, periods: list[int], octave: Octave) -> Iterator[Fragment]:
    """(period, start, end) of the stretches through boundary c, inside its tile, that are long enough and have no smaller period."""
    n = len(ids)
    lo, hi, top = max(0, c - octave.left), min(n, c + octave.right), min(n, c + octave.end - 1)
    forward = z_values(ids[c:hi], octave.end)
    left = ids[lo:c][::-1]
    backward = z_values([*left, -1, *ids[lo:top][::-1]], len(left) + 1 + top - c - octave.least + 1)
    for p in periods:
        start, end = c - backward[len(left) + 1 + top - c - p], c + p + forward[p]
        if end - start >= max(LEAST, 2 * p) and all(forward[p // f] < p - p // f for f in primes(p)):
            yield p, start, end


def joined(found: dict[int, list[list[int]]], p: int, start: int, end: int) -> None:
    """Adds a stretch to those of its period; starts come in order."""
    mine = found.setdefault(p, [])
    if mine and start <= mine[-1][1] - p:
        mine[-1][1] = max(mine[-1][1], end)
    else:
        mine.append([start, end])


def fragments(texts: list[bytes], slices: list[Slice] | None = None) -> tuple[np.ndarray, list[list[Fragment]]]:
    """(number of words, (period, start, end) of what the text or slice shows of each run, ends as word numbers of the whole text)."""
    slices = slices or [Slice()] * len(texts)
    sieve = Sieve(texts)
    sizes = np.diff(sieve.first)
    found: list[dict[int, list[list[int]]]] = [{} for _ in texts]
    exact: dict[int, list[int]] = {}
    for octave in octaves(int(sizes.max(initial=0))):
        text, c, p = sieve.candidates(octave, slices)
        cuts = np.flatnonzero(np.diff(c, prepend=-1, append=-1)).tolist()
        for a, b in zip(cuts[:-1], cuts[1:]):
            t = int(text[a])
            if t not in exact:
                known: dict[bytes, int] = {}
                exact[t] = [known.setdefault(w, len(known)) for w in texts[t].split()]
            base = slices[t].base
            for period, start, end in tile_fragments(exact[t], int(c[a] - sieve.first[t]), p[a:b].tolist(), octave):
                joined(found[t], period, start + base, end + base)
    return sizes, [[(p, s, e) for p, spans in sorted(f.items()) for s, e in spans] for f in found]


def sliced(texts: list[bytes], size: int = SLICE) -> Iterator[tuple[int, Slice, bytes]]:
    """(text, slice, its words) that together hold every tile: one set of slices for the octaves whose tiles are short against
    ``size``, then one for each longer octave."""
    for t, text in enumerate(texts):
        words = text.split()
        kinds = list(octaves(len(words)))
        fine = [o for o in kinds if 8 * o.step <= size]
        groups = ([(fine[0].least, fine[-1].end, size, fine[-1])] if fine else []) + [(o.least, o.end, 8 * o.step, o) for o in kinds if o not in fine]
        for finest, coarsest, step, widest in groups:
            for first in range(0, len(words), step):
                base = max(0, first - widest.left)
                yield t, Slice(base, first, first + step, finest, coarsest), b" ".join(words[base:first + step + widest.right])


def collapsed(text: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    """The words of ``text`` without those that a run (start, length, period) holds after its first period."""
    words = text.split()
    if runs:
        drop = np.zeros(len(words) + 1, np.int64)
        start, length, period = np.array(runs, np.int64).T
        np.add.at(drop, start + period, 1)
        np.add.at(drop, start + length, -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(drop)[:-1] == 0)]
    return b" ".join(words)


_SPANS = "array<struct<period: bigint, start: bigint, end: bigint>>"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, long: int = LONG, size: int = SLICE) -> DataFrame:
    """id, n_words, runs array<struct<start, length, period>> and ``collapsed``: the text without repetitions, or with ``digest``
    its SHA-256 in hex, so that texts without runs need not be carried. Documents longer than ``long`` bytes are answered in slices of
    about ``size`` words."""
    hexed = (lambda b: hashlib.sha256(b).hexdigest()) if digest else (lambda b: b.decode())

    def look(texts: list[bytes]) -> list[list]:
        whole = [len(t) <= long for t in texts]
        n, found = fragments([t if w else b"" for t, w in zip(texts, whole)])
        n = [int(k) if w else len(t.split()) for k, w, t in zip(n, whole, texts)]
        spans = [[{"period": p, "start": s, "end": e} for p, s, e in f] if w else None for f, w in zip(found, whole)]
        return [n, spans, [hexed(b" ".join(t.split())) if w and not f else None for t, f, w in zip(texts, found, whole)]]

    plain = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("body"), F.monotonically_increasing_id().alias("row"))
    seen = annotated(plain, "body", "seen", f"n_words bigint, spans {_SPANS}, quiet string", look)
    busy = F.col("quiet").isNull()
    stored = saved(seen.select("row", "doc", "seen.*", F.when(F.col("seen.quiet").isNull(), F.col("body")).alias("body")), "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row").to_pylist()
            for lo, texts in pieces_of(batch.column("body")):
                for t, s, words in sliced(texts, size):
                    columns = [pa.array([rows[lo + t]], pa.int64()), *(pa.array([x], pa.int64()) for x in s), pa.array([words], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["row", *Slice._fields, "words"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [batch.column(f).to_pylist() for f in ("row", *Slice._fields)]
            for lo, texts in pieces_of(batch.column("words")):
                rows, *fields = (x[lo:lo + len(texts)] for x in at)
                _, found = fragments(texts, [Slice(*x) for x in zip(*fields)])
                flat = [(r, *f) for r, spans in zip(rows, found) for f in spans]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*flat) if flat else [[]] * 4)], names=["row", "period", "start", "end"])

    ranges = ", ".join(f"{f} bigint" for f in Slice._fields)
    tiles = stored.where(busy & F.col("spans").isNull()).select("row", "body").mapInArrow(cut, f"row bigint, {ranges}, words binary")
    spread = tiles.repartition("row", "finest", "first").mapInArrow(solve, "row bigint, period bigint, start bigint, end bigint")
    pieces = stored.where(busy).select("row", F.inline("spans")).unionByName(spread)

    # One shuffle by (document, period): a fragment continues the run before it if both share a period or more.
    before = Window.partitionBy("row", "period").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("row", "period").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.coalesce(F.col("start") > F.max("end").over(before) - F.col("period"), F.lit(True))
    stitched = pieces.withColumn("opens", opens.cast("int")).withColumn("nth", F.sum("opens").over(upto)).groupBy("row", "period", "nth").agg(
        F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("length"))
    runs = stitched.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))

    # Only texts with runs, and long ones, are read again.
    open_rows = stored.where(busy).select("row", "doc", "n_words", "body").join(runs, "row", "left")
    none = F.array().cast("array<struct<start: bigint, length: bigint, period: bigint>>")
    open_rows = open_rows.select("doc", "n_words", F.coalesce("runs", none).alias("runs"), "body")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in pieces_of(batch.column("body")):
                part = batch.slice(lo, len(texts))
                short = [hexed(collapsed(t, [(r["start"], r["length"], r["period"]) for r in rs])) for t, rs in zip(texts, part.column("runs").to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(short, pa.string())], names=["doc", "n_words", "runs", "collapsed"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    done = open_rows.mapInArrow(finish, f"doc {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    quiet = stored.where(~busy).select("doc", "n_words", none.alias("runs"), F.col("quiet").alias("collapsed"))
    return quiet.unionByName(done).withColumnRenamed("doc", id_col)
