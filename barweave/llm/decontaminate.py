"""Benchmark decontamination with suffix arrays of the training texts.

Training texts are taken in shards of about ``SHARD`` bytes. Each shard gets the suffix array of all its words: suffixes are ordered
by their first words, then doubled in depth for those that still tie, as deep as the longest test item. Every suffix of every
test item is found in it by binary search; the longer of what it shares with its two neighbours there is its longest verbatim
match in the shard. A test suffix whose match reaches its window (``WINDOW`` words, or all of an item of fewer) marks the window's
words wherever it occurs: a second search gives the whole stretch of the array that begins with it. A word inside any occurrence
of a window is hit. For every place where a window occurs, the test suffix of the item that agrees longest with the text from there
on is found by binary search among the item's suffixes that begin with this window; these longest matches are the ``matches``, less
those inside an earlier one of the same item, each with item, place in the document, length and place in the item.

Words are compared by 64-bit hashes, stretches of words by rolling hashes over these.

The benchmark is sent to the tasks in slices of about ``SLICE`` bytes of text, packed in numpy (about 60 bytes a word), one pass over
the texts for each slice, so nothing that is broadcast or built on the driver grows beyond that bound (or beyond the longest
single item). Time for one shard is n log n in its words and, per test suffix, logarithmic.

Defined results: null or empty texts have no words and no hits; rows with equal ids are answered one by one; benchmark rows
with null or wordless texts have no window; an item without id marks words but is not listed; repeated items count once. Very long texts
are a shard of their own. Columns of the documents are kept whatever their names; an empty table gives no rows, an empty benchmark no hits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.llm.common import ALNUM, Chunk, annotated, fresh, powers, saved

WINDOW = 10
SHARD = 2 << 20
SLICE = 2 << 20
_SPAN = "struct<item_id: bigint, start: bigint, length: bigint, item_start: bigint>"
FIELDS = f"n_words bigint, n_hit bigint, items array<bigint>, spans array<{_SPAN}>"


class Sequence:
    """Words of some texts as hashes, one after the other; stretches inside one text can be compared."""

    def __init__(self, texts: list[bytes]):
        chunk = Chunk(texts, ALNUM)
        self.words, self.first = chunk.words(), chunk.first.astype(np.int64)
        n = len(self.words)
        self.text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        self.end = self.first[1:][self.text] if n else np.zeros(0, np.int64)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.words * powers(n)[0][:n], out=self.sums[1:])

    def stretch(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * powers(len(self.words))[1][start]

    def suffix_array(self, depth: int) -> np.ndarray:
        """Places ordered by the words from there to the end of the text, as far as ``depth`` words; a text's end sorts first."""
        n = len(self.words)
        if not n:
            return np.zeros(0, np.int64)
        kinds, code = np.unique(self.words, return_inverse=True)
        base, known, key = len(kinds) + 2, 1, code.astype(np.int64) + 1
        while known < depth and (len(kinds) + 2) ** (known + 1) < 1 << 62:
            at = np.arange(n) + known
            key = key * base + np.where(at < self.end, code[np.minimum(at, n - 1)] + 1, 0)
            known += 1
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)  # the first place in the order that a suffix may take
        fresh_at = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        rank[order] = np.maximum.accumulate(np.where(fresh_at, np.arange(n), 0))
        while known < depth:
            tied = np.flatnonzero(~(fresh_at & np.append(fresh_at[1:], True)))
            if not len(tied):
                break
            places = order[tied]
            after = np.where(places + known < self.end[places], rank[np.minimum(places + known, n - 1)] + 1, 0)
            again = np.lexsort((after, rank[places]))
            places, after = places[again], after[again]
            order[tied] = places
            fresh_at[tied] |= np.concatenate([[True], (rank[places][1:] != rank[places][:-1]) | (after[1:] != after[:-1])])
            rank[order] = np.maximum.accumulate(np.where(fresh_at, np.arange(n), 0))
            known *= 2
        return order


def shared(a: Sequence, i: np.ndarray, b: Sequence, j: np.ndarray, most: np.ndarray | int) -> np.ndarray:
    """How many words agree from i in a and j in b on, inside their texts and at most ``most``."""
    limit = np.minimum(np.minimum(a.end[i] - i, b.end[j] - j), most)
    size = np.zeros(len(i), np.int64)
    bit = 1 << max(int(limit.max(initial=0)).bit_length() - 1, 0)
    while bit:
        can = np.flatnonzero(size + bit <= limit)
        x, y = i[can] + size[can], j[can] + size[can]
        size[can[a.stretch(x, bit) == b.stretch(y, bit)]] += bit
        bit >>= 1
    return size


def before(a: Sequence, i: np.ndarray, b: Sequence, j: np.ndarray, most: np.ndarray, ties: bool) -> np.ndarray:
    """Whether the suffix j of b sorts before the first ``most`` words from i in a; ``ties`` answers for those that begin with them."""
    size = shared(a, i, b, j, most)
    over = size >= most
    at, other = np.minimum(i + size, len(a.words) - 1), np.minimum(j + size, len(b.words) - 1)
    ended = j + size >= b.end[j]
    return np.where(over, ties, ended | (b.words[other] < a.words[at]))


def insertion(a: Sequence, i: np.ndarray, most: np.ndarray, b: Sequence, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, ties: bool) -> np.ndarray:
    """Binary search: for each of the suffixes i of a, the first place in order[lo:hi] whose suffix of b does not sort before it."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        less = before(a, i[open_], b, order[mid], most[open_], ties)
        lo[open_] = np.where(less, mid + 1, lo[open_])
        hi[open_] = np.where(less, hi[open_], mid)


class Needles:
    """The suffixes of some benchmark items, their windows, and per window and item the suffixes that begin with it, in order."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        self.ids = [i for i, _ in items]
        self.seq = seq = Sequence([(t or "").encode() for _, t in items])
        self.longest = int(np.diff(seq.first).max(initial=0))
        at = np.arange(len(seq.words))
        size = seq.end - seq.first[:-1][seq.text] if len(at) else at
        self.need = np.minimum(window, size)
        starts = at[(seq.end - at >= self.need) & (self.need > 0)]
        order = seq.suffix_array(self.longest)
        place = np.empty(len(at), np.int64)
        place[order] = at
        starts = starts[np.argsort(place[starts], kind="stable")]
        # Windows with equal words and length are one; suffixes that begin with it are sorted by item row, then by suffix.
        word_key = seq.stretch(starts, self.need[starts]) if len(starts) else np.zeros(0, np.uint64)
        _, kind = np.unique(np.stack([word_key, self.need[starts].astype(np.uint64)]), axis=1, return_inverse=True) if len(starts) else (None, starts)
        kind = np.asarray(kind).ravel()
        sort = np.lexsort((np.arange(len(starts)), seq.text[starts], kind)) if len(starts) else starts
        self.starts, kind, row = starts[sort], kind[sort], seq.text[starts[sort]]
        new_group = np.concatenate([[True], (kind[1:] != kind[:-1]) | (row[1:] != row[:-1])]) if len(kind) else np.zeros(0, bool)
        self.group_lo = np.flatnonzero(new_group)
        self.group_hi = np.append(self.group_lo[1:], len(kind))
        self.group_row = row[self.group_lo]
        of_window = kind[self.group_lo]
        self.window_lo = np.flatnonzero(np.concatenate([[True], of_window[1:] != of_window[:-1]])) if len(of_window) else np.zeros(0, np.int64)
        self.window_hi = np.append(self.window_lo[1:], len(of_window))
        self.window_at = self.starts[self.group_lo[self.window_lo]] if len(self.window_lo) else np.zeros(0, np.int64)
        self.window_size = self.need[self.window_at] if len(self.window_at) else np.zeros(0, np.int64)

    def longest_matches(self, shard: Sequence, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every test suffix: the length of its longest verbatim match in the shard, and a place where it stands."""
        at = np.arange(len(self.seq.words))
        rest = self.seq.end - at
        spot = insertion(self.seq, at, rest, shard, order, np.zeros(len(at), np.int64), np.full(len(at), len(order)), False)
        best, where = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for side in (spot - 1, spot):
            ok = np.flatnonzero((side >= 0) & (side < len(order)))
            near = order[side[ok]]
            size = shared(self.seq, at[ok], shard, near, rest[ok])
            better = size > best[ok]
            best[ok[better]], where[ok[better]] = size[better], near[better]
        return best, where

    def occurrences(self, shard: Sequence, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) of every occurrence of a window."""
        best, _ = self.longest_matches(shard, order)
        found = np.flatnonzero(best[self.window_at] >= self.window_size)
        i, size = self.window_at[found], self.window_size[found]
        zero, whole = np.zeros(len(found), np.int64), np.full(len(found), len(order))
        lo = insertion(self.seq, i, size, shard, order, zero, whole, False)
        hi = insertion(self.seq, i, size, shard, order, lo, whole, True)
        count = hi - lo
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        return np.repeat(found, count), order[place]

    def matches(self, shard: Sequence, window: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
        """(item row, place, length, test suffix): for every occurrence and item, the longest agreement from there on."""
        count = self.window_hi[window] - self.window_lo[window]
        group = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.window_lo[window], count)
        place = np.repeat(place, count)
        lo, hi = self.group_lo[group], self.group_hi[group]
        spot = insertion(shard, place, shard.end[place] - place, self.seq, self.starts, lo, hi, False)
        best, suffix = np.zeros(len(place), np.int64), self.starts[lo] if len(lo) else lo
        for side in (spot - 1, spot):
            ok = np.flatnonzero((side >= lo) & (side < hi))
            near = self.starts[side[ok]]
            size = shared(shard, place[ok], self.seq, near, shard.end[place[ok]] - place[ok])
            better = size > best[ok]
            best[ok[better]], suffix[ok[better]] = size[better], near[better]
        return self.group_row[group] if len(group) else group, place, best, suffix


def scan(needles: Needles, texts: list[bytes]) -> list[list]:
    """Values of FIELDS for a shard."""
    shard = Sequence(texts)
    none: list[list] = [[] for _ in texts]
    if not len(shard.words) or not len(needles.window_at):
        return [np.diff(shard.first).tolist(), [0] * len(texts), none, none]
    window, place = needles.occurrences(shard, shard.suffix_array(needles.longest))
    change = np.zeros(len(shard.words) + 1, np.int64)
    np.add.at(change, place, 1)
    np.add.at(change, place + needles.window_size[window], -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
    row, place, size, suffix = needles.matches(shard, window, place)
    text = shard.text[place]
    items, spans = [set() for _ in texts], [[] for _ in texts]
    reached: dict[tuple[int, int], int] = {}
    for k in np.lexsort((-size, place, row)).tolist():
        t, r, p, n = int(text[k]), int(row[k]), int(place[k]), int(size[k])
        item = needles.ids[r]
        if item is not None:
            items[t].add(item)
        if p + n > reached.get((t, r), -1):
            reached[t, r] = p + n
            spans[t].append({"item_id": item, "start": p - int(shard.first[t]), "length": n, "item_start": int(suffix[k] - needles.seq.first[r])})
    return [np.diff(shard.first).tolist(), (covered[shard.first[1:]] - covered[shard.first[:-1]]).tolist(), [sorted(i) for i in items], spans]


def slices(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> list[list[tuple]]:
    """The benchmark's items in parts of about ``limit`` bytes of text."""
    rows = benchmark.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t")).where(F.col("t").isNotNull()).distinct()
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-int(total) // limit))
    part = F.pmod(F.xxhash64("i", "t"), F.lit(parts))
    for k in range(parts):
        yield sorted(((r["i"], r["t"]) for r in rows.where(part == k).collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def mark(docs: DataFrame, benchmark: DataFrame, out: str, text_col: str = "text", item_col: str = "item_id",
         item_text: str = "text", window: int = WINDOW, limit: int = SLICE) -> DataFrame:
    """All columns of ``docs`` and a struct ``out``: words, hit words, items found, and the longest verbatim matches."""
    spark = docs.sparkSession
    for k, items in enumerate(slices(benchmark, item_col, item_text, limit)):
        sent = spark.sparkContext.broadcast(Needles(items, window))
        if k == 0:
            docs = annotated(docs, text_col, out, FIELDS, lambda texts, sent=sent: scan(sent.value, texts), SHARD)
            continue
        part = fresh(docs, "part")
        both = annotated(saved(docs, "leaks"), text_col, part, FIELDS, lambda texts, sent=sent: scan(sent.value, texts), SHARD)
        docs = merge(both, out, part)
    return docs


def merge(df: DataFrame, out: str, part: str) -> DataFrame:
    """Join what two slices of the benchmark found in the same row; matches of both cover its words, since every window that occurs
    lies in a match."""
    a, b = F.col(out), F.col(part)
    spans = F.concat(a["spans"], b["spans"])
    ends = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (s["start"] + s["length"]).alias("end"))))
    zero = F.struct(F.lit(0).cast("bigint").alias("hit"), F.lit(0).cast("bigint").alias("end"))
    hit = F.aggregate(ends, zero, lambda acc, s: F.struct(
        (acc["hit"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["end"], s["start"]))).alias("hit"),
        F.greatest(acc["end"], s["end"]).alias("end")))["hit"]
    return df.withColumn(out, F.struct(
        a["n_words"].alias("n_words"), hit.alias("n_hit"), F.array_distinct(F.concat(a["items"], b["items"])).alias("items"),
        spans.alias("spans"))).drop(part)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated, the length and place of its (first) longest match,
    and all ``matches``."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    leak = F.col("leak")
    listed = F.array_join(F.array_sort(F.transform(leak["items"], lambda i: i.cast("string"))), ",")
    top = F.array_max(F.transform(leak["spans"], lambda s: F.struct(s["length"].alias("length"), (-s["start"]).alias("back"))))
    return mark(plain, benchmark, "leak", **options).select(
        F.col("doc_id").alias(id_col), leak["n_words"].alias("n_words"), leak["n_hit"].alias("n_hit"),
        F.size(leak["items"]).cast("bigint").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"),
        (leak["n_hit"] > 0).alias("contaminated"), top["length"].alias("longest_match"), (-top["back"]).alias("longest_start"), leak["spans"].alias("matches"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with their own columns."""
    out = fresh(docs, "leak")
    return mark(docs, benchmark, out, text_col, **options).where(F.col(out)["n_hit"] == 0).drop(out)
