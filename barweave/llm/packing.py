"""Best-fit packing of tokenised documents with large-item matching.

Each text is tokenised once, where it lies; only piece lengths, positions and checksums go on. Pieces of one length are
interchangeable, so the bins are planned on the histogram of lengths: at most ``capacity`` rows, whatever the corpus. Lengths
above a third of the capacity are matched greedily, two to a bin at most, each with the longest one that still fits; shorter
lengths fill the remaining gaps, longest first, always into the smallest gap that takes them. The plan is a list of runs of
ranks per length; a piece finds its bin by its rank among equal lengths. Ranks come from windows over (length, salt), so a
length that a third of all pieces share is spread over ``salts`` tasks.

Defined results: null and empty texts are the closing token alone; repeated rows are separate documents; a null id is kept.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barweave.llm.common import pieces_of, saved

CAPACITY = 2048
END_ID = 0
SALTS = 64
CACHE = 300_000

#: Bytes of texts whose lower case, composition and word classes are the same in every library (printable ASCII, white space
#: and two-byte letters up to U+024F); any other text goes to the tokenizer whole, as do the exceptions below.
PLAIN = bytes([*range(9, 14), *range(32, 127), *range(0x80, 0xC0), *range(0xC2, 0xCA)])
ODD = re.compile(rb"\xc2[\x80-\xa0]|\xc4\xb0|<\|")
LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u02af\u2c65\u2c66"
NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{LETTER}{NUMBER}]+")
#: Byte-level vocabularies write the bytes that are no printable Latin-1 characters as U+0100 and up, in order.
SHIFTED = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}


class Words(dict):
    """Lower-case word -> its token ids as little-endian 32-bit bytes."""

    def __init__(self, model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> bytes:
        found = self.model.tokenize(word.encode().decode("latin-1").translate(SHIFTED))
        value = self[word] = struct.pack(f"<{len(found)}I", *[t.id for t in found])
        return value


class WordTokens(dict):
    """Token ids of texts. The vocabulary encodes every word by itself, so words, and what stands between two blanks, are
    encoded once and kept; at most about ``CACHE`` entries of each."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Words(self.tokenizer.model)

    def __missing__(self, part: bytes) -> bytes:
        words = self.words
        value = b"".join([words[w] for w in WORD.findall(part.decode().lower())])
        if len(part) <= 40:
            self[part] = value
        return value

    def __call__(self, raw: bytes) -> bytes:
        if raw.translate(None, PLAIN) or ODD.search(raw):
            return np.array(self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        for kept in (self, self.words):
            if len(kept) > CACHE:
                kept.clear()
        return b"".join(map(self.__getitem__, raw.split()))


def pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    ending = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordTokens(tokenizer)
        for batch in batches:
            for lo, texts in pieces_of(batch.column(1)):
                row, piece, start, length, crc = [], [], [], [], []
                for i, text in enumerate(texts, lo):
                    ids = encode(text) + ending
                    for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[a : a + 4 * capacity]
                        row.append(i)
                        piece.append(k)
                        start.append(a // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.record_batch([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(
                    pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, pieces per bin, number of bins, first bin, offset) that place every piece."""
    left = {n: c for n, c in counts.items() if c > 0}
    used_ranks = dict.fromkeys(left, 0)
    rows: list[tuple] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    bins = 0

    def place(n: int, per: int, count: int, first: int, offset: int) -> None:
        rows.append((n, used_ranks[n], per, count, first, offset))
        used_ranks[n] += per * count
        left[n] -= per * count

    def leave(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((first, count))

    large = sorted(n for n in left if 3 * n > capacity)
    for n in reversed(large):
        while left[n]:
            k = bisect_left(large, capacity - n + 1) - 1
            while k >= 0 and (not left[large[k]] or large[k] == n and left[n] < 2):
                k -= 1
            if k < 0:
                count, other = left[n], 0
            else:
                other = large[k]
                count = left[n] // 2 if other == n else min(left[n], left[other])
            place(n, 1, count, bins, 0)
            if other:
                place(other, 1, count, bins, n)
            leave(capacity - n - other, bins, count)
            bins += count
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            k = bisect_left(sizes, n)
            if k == len(sizes):
                gap, first, count = capacity, bins, -(-left[n] // (capacity // n))
                bins += count
            else:
                gap = sizes[k]
                first, count = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[k]
            per = gap // n
            full = min(count, left[n] // per)
            if full:
                place(n, per, full, first, capacity - gap)
                leave(gap - per * n, first, full)
            rest = left[n] if full < count else 0
            if rest:
                place(n, rest, 1, first + full, capacity - gap)
                leave(gap - rest * n, first + full, 1)
                full += 1
            leave(gap, first + full, count - full)
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         salts: int = SALTS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = saved(pieces(docs, tokenizer, id_col, text_col, capacity), "pieces")
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counted = salted.groupBy("length", "salt").count().collect()  # at most capacity x salts rows
    held = np.zeros((capacity + 1, salts), np.int64)
    for r in counted:
        held[r["length"], r["salt"]] = r["count"]
    runs = plan({n: int(c) for n, c in enumerate(held.sum(axis=1))}, capacity)
    before = np.cumsum(held, axis=1) - held
    sent = docs.sparkSession.sparkContext.broadcast((runs, before))  # bounded by capacity and salts

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, before = sent.value
        width = int(before.max(initial=0)) + int(held_most) + 1
        heads = runs[:, 0] * width + runs[:, 1]
        for b in batches:
            length, salt, row = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "salt", "row"))
            rank = before[length, salt] + row - 1
            _, first_rank, per, _, first_bin, offset = runs[np.searchsorted(heads, length * width + rank, "right") - 1].T
            nth = rank - first_rank
            yield pa.record_batch([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                                   pa.array(first_bin + nth // per), pa.array(offset + nth % per * length)],
                                  names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    held_most = held.max(initial=0)
    ranked = salted.withColumn("row", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")))
    return ranked.mapInArrow(assign, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
