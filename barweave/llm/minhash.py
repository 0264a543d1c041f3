"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

Signatures use two permutations of the 32-bit numbers. One permutes the shingles; coordinate k is the smallest image of the
second one, its argument shifted circularly by k. Texts with equal shingle sets form one class before anything is paired.
Buckets of equal bands are searched in two steps, both exact on what the bands found:

1. every class is compared with the first class of each of its buckets (a star, not all pairs) and components are joined;
2. buckets that still hold several components are cut into blocks of bounded size, and each block looks for links between
   different components only. A block reports which components it joins, one row fewer than it holds components at most, never
   the pairs of texts behind them; what is joined in the end are components, not texts.

Every link is confirmed on full shingle sets. The number of bands follows from ``threshold`` and ``miss``, the accepted
probability that a pair lying exactly at the threshold shares no band.

Full sets are computed in a second pass over the texts, for classes that share a bucket only: a Bloom filter over their ids, at
most ``FILTER_BITS`` bits whatever the input, is sent to all tasks, so texts without partner are neither shuffled nor shingled
again. Beyond the filter's capacity more rows pass it and are left out by the join that follows; results stay the same. What a
later step no longer reads is deleted from the shared folder at once. A bucket of m classes in several components costs up to m
blocks of m classes within a factor of the block size, so a large bucket of texts that share bands but no link is quadratic in m.

Defined results: null or empty texts have no shingles, stay alone and are kept; rows with a null id take no part (component
null, kept); repeated rows get equal answers; rows of different texts under one id are different nodes, linked each by its own
text, and a component is named by the smallest id of its rows; very long texts are shingled whole, one at a time; an empty table gives no
rows; columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barweave.llm.common import BLANK_SPLIT, Chunk, mix64, per_chunk, released, saved, spread_join

WIDTH = 5
ROWS = 5
MISS = 1e-6
#: Sets per block: so many that their shingles stay within BLOCK_SHINGLES, between these two numbers.
BLOCK = (32, 512)
BLOCK_SHINGLES = 1 << 18
#: Bits of the filter over the ids whose full sets are wanted: so many an id, and at most so many in all.
BITS_PER_ID, FILTER_BITS = 16, 1 << 28
_I = np.uint32


def band_count(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def scatter(x: np.ndarray) -> np.ndarray:
    """First permutation of the 32-bit numbers."""
    x = x ^ (x >> _I(15))
    x = x * _I(0x2C1B3C6D)
    x = x ^ (x >> _I(12))
    x = x * _I(0x297A2D39)
    return x ^ (x >> _I(15))


def permute(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Second permutation, in place; ``spare`` is scratch of the same length."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        np.right_shift(x, _I(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, _I(factor), out=x)
    np.right_shift(x, _I(16), out=spare)
    return np.bitwise_xor(x, spare, out=x)


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    chunk = Chunk(texts, BLANK_SPLIT)
    words, first = chunk.words(), chunk.first
    step = np.uint64(0xA0761D6478BD642F)
    n = len(words)
    rolled = np.zeros(max(n - width + 1, 0), np.uint64)
    for k in range(width):
        rolled = rolled * step + words[k : k + len(rolled)]
    rolled = mix64(rolled)
    out = []
    for i in range(len(texts)):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for w in words[a:b]:
                whole = whole * step + w
            out.append(mix64(whole ^ np.uint64(0x5851F42D4C957F2D)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """(texts, coordinates) minima; texts without shingles must be left out by the caller."""
    out = np.empty((len(sets), coordinates), np.uint32)
    lo = 0
    while lo < len(sets):
        hi, size = lo, 0
        while hi < len(sets) and (hi == lo or size + len(sets[hi]) <= 1 << 15):
            size += len(sets[hi])
            hi += 1
        place = scatter((np.concatenate(sets[lo:hi]) >> np.uint64(32)).astype(np.uint32))
        starts = np.cumsum([0] + [len(s) for s in sets[lo : hi - 1]])
        image, spare = np.empty_like(place), np.empty_like(place)
        for k in range(coordinates):
            np.add(place, _I(k), out=image)  # circular shift modulo 2**32
            out[lo:hi, k] = np.minimum.reduceat(permute(image, spare), starts)
        lo = hi
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per text and band."""
    bands = sig.shape[1] // rows
    parts = sig.reshape(len(sig), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), bands)).copy()
    for k in range(rows):
        key = mix64(key * np.uint64(0x9FB21C651E98DF25) + parts[:, :, k])
    return key.astype(np.int64)


def sign(docs: DataFrame, bands: int, rows: int, width: int) -> DataFrame:
    """id, n_shingles, set key, key of the text as it stands and band keys of every row."""

    def work(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        sets = shingle_sets(texts, width)
        full = [i for i, s in enumerate(sets) if len(s)]
        keys: list = [None] * len(sets)
        if full:
            for i, row in zip(full, band_keys(signatures([sets[i] for i in full], bands * rows), rows)):
                keys[i] = row
        return pa.record_batch([
            batch.column("id"), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([digest(s) if len(s) else None for s in sets], pa.binary()), pa.array([hashlib.md5(t).digest() for t in texts], pa.binary()),
            pa.array(keys, pa.list_(pa.int64()))], names=["id", "n_shingles", "set_key", "text_key", "bands"])

    return docs.mapInArrow(per_chunk(work, "text"), "id bigint, n_shingles bigint, set_key binary, text_key binary, bands array<bigint>")


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.md5(shingles.tobytes()).digest()


def hashes(*columns: str) -> dict[str, Column]:
    """The two hashes of a row's key by which a filter knows it."""
    return {"h1": F.xxhash64(*columns), "h2": F.xxhash64(*columns, F.lit("second"))}


def bloom(keys: DataFrame, *columns: str) -> tuple[np.ndarray, int]:
    """(words of a Bloom filter over the rows' ``columns``, its size as power of two): ``BITS_PER_ID`` bits a row, ``FILTER_BITS`` at most."""
    power = min(FILTER_BITS, max(1 << 10, BITS_PER_ID * keys.count())).bit_length() - 1
    places = keys.select(F.explode(F.array(*hashes(*columns).values())).alias("h"))
    place = F.shiftrightunsigned("h", 64 - power)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - power}) & 63 as int))")
    words = places.groupBy(F.shiftrightunsigned(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (power - 6), np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out, power


def passes(held: np.ndarray, power: int, batch: pa.RecordBatch) -> np.ndarray:
    """Which rows of a batch with h1 and h2 may be in the filter."""
    hit = np.ones(batch.num_rows, bool)
    for c in ("h1", "h2"):
        place = batch.column(c).to_numpy().view(np.uint64) >> np.uint64(64 - power)
        hit &= (held[place >> np.uint64(6)].view(np.uint64) >> (place & np.uint64(63))) & np.uint64(1) == 1
    return hit


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the classes ``wanted`` (id, set_key, node), read from the rows of their ids."""
    filled, power = bloom(wanted, "id")
    sent = docs.sparkSession.sparkContext.broadcast(filled)

    def work(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        hit = passes(sent.value, power, batch)
        sets = [x for x in shingle_sets([t for t, h in zip(texts, hit) if h], width) if len(x)] if hit.any() else []
        return pa.record_batch([pa.array([digest(x) for x in sets], pa.binary()), pa.array([x.astype(np.int64) for x in sets], pa.list_(pa.int64()))],
                               names=["set_key", "shingles"])

    rows = docs.where(F.col("id").isNotNull()).select(*[c.alias(n) for n, c in hashes("id").items()], "text")
    found = rows.mapInArrow(per_chunk(work, "text"), "set_key binary, shingles array<bigint>")
    return found.join(wanted.select("set_key", "node"), "set_key").select("node", "shingles").dropDuplicates(["node"])


def split_by_filter(rows: DataFrame, filled: np.ndarray, power: int, wanted: bool) -> DataFrame:
    """The rows (with h1, h2) that may be in the filter, or with ``wanted`` false those that are not; where they lie, without h1 and h2."""
    sent, kept = rows.sparkSession.sparkContext.broadcast(filled), rows.drop("h1", "h2")
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(sent.value, power, batch) == wanted)).select(names)

    return rows.mapInArrow(run, kept.schema)


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for every end of ``edges`` (a, b): the smallest id reachable. Labels spread to neighbours and then jump
    to their label's label until nothing changes; each round is stored in the shared folder."""
    both = saved(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    last = saved(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("comp")), "labels")
    while True:
        label = last.select("id", "comp")
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        met = label.join(near, "id").select("id", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = label.select(F.col("id").alias("comp"), F.col("comp").alias("further"))
        step = saved(met.join(jump, "comp", "left").select(
            "id", "was", F.least("comp", F.coalesce("further", "comp")).alias("comp")), "labels")
        released(last)
        last = step
        if step.where(F.col("was") != F.col("comp")).isEmpty():
            released(both)
            return step.select("id", "comp")


def shared_counts(sets: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each set in turn, how many elements it shares with every set."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    holders, at = owner[order], np.searchsorted(code[order], np.arange(code.max() + 2))
    offset = 0
    for s in sets:
        own = code[offset : offset + len(s)]
        offset += len(s)
        count = at[own + 1] - at[own]
        flat = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(at[own], count)
        yield np.bincount(holders[flat], minlength=len(sets))


def top(up: dict[int, int], c: int) -> int:
    """The smallest component that ``up`` (component -> smaller joined one) leads to from ``c``."""
    while c in up:
        c = up[c]
    return c


def block_links(num: int, den: int):
    """mapInArrow function over rows sorted by block: the components that links inside a block join, as a spanning forest of them, so that
    a block gives fewer rows than it holds components however many pairs of its texts are linked."""
    keys = ["bucket", "at_level", "left", "right"]

    def links(rows: pa.Table) -> list[tuple[int, int]]:
        comps, sizes, levels, parts = (rows[c].to_numpy() for c in ("comp", "n_shingles", "level", "part"))
        level, left, right = (rows[c][0].as_py() for c in keys[1:])
        shingles = rows["shingles"].combine_chunks()
        values, ends = shingles.flatten().to_numpy(), np.cumsum([0, *sizes])
        sets = [values[a:b] for a, b in zip(ends[:-1], ends[1:])]
        found, up = [], {}
        for i, shared in enumerate(shared_counts(sets)):
            own = (np.minimum(levels[i], levels) == level) & (np.minimum(parts[i], parts) == left) & (np.maximum(parts[i], parts) == right)
            ok = own & (comps > comps[i]) & (den * shared >= num * (sizes[i] + sizes - shared))
            for other in np.unique(comps[ok]).tolist():
                a, b = top(up, int(comps[i])), top(up, other)
                if a != b:
                    up[max(a, b)] = min(a, b)
                    found.append((a, b))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            marks = np.stack([held[c].to_numpy() for c in keys], axis=1)
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            yield result([p for a, b in zip([0, *cuts[:-1]], cuts) for p in links(held.slice(a, b - a))])
            held = held.slice(int(cuts[-1])) if len(cuts) else held
        if held is not None and held.num_rows:
            yield result(links(held))

    def result(found: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = zip(*found) if found else ((), ())
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def near_classes(plain: DataFrame, threshold: str, width: int, rows: int, miss: float) -> tuple[DataFrame, DataFrame]:
    """For ``plain`` (id, text): stored rows (id, n_shingles, set_key, text_key), and stored classes of equal sets that have copies or
    links (set_key, copies, component, group): the component is the smallest id of the group, which is one connected set of classes."""
    share = Fraction(threshold)
    num, den = share.numerator, share.denominator
    bands = band_count(float(share), rows, miss)
    signed = saved(sign(plain, bands, rows, width), "signatures")
    classes = saved(signed.where(F.col("id").isNotNull() & (F.col("n_shingles") > 0)).groupBy("set_key").agg(
        F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("copies"),
        F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()), "classes")
    sigs = saved(signed.drop("bands"), "rows")
    released(signed)

    spread = classes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(
        F.min("node").alias("pivot"), F.max("node").alias("last"), F.min_by("n_shingles", "node").alias("n_pivot"))
    shared = shared.where(F.col("pivot") != F.col("last")).drop("last")
    members = saved(spread.join(shared, "bucket"), "members")
    nodes = saved(classes.drop("bands"), "nodes")
    released(classes)

    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("id", "set_key", "node")
    sets = saved(full_sets(plain, saved(wanted, "wanted"), width), "sets")
    sized = sets.select("node", "shingles", F.size("shingles").cast("bigint").alias("n"))

    close = F.lit(den) * F.least("n_pivot", "n_shingles") >= F.lit(num) * F.greatest("n_pivot", "n_shingles")
    pairs = members.where((F.col("node") != F.col("pivot")) & close).select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    side = lambda c: sized.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}"), F.col("n").alias(f"n_{c}"))
    common = F.size(F.array_intersect("set_a", "set_b")).cast("bigint")
    tested = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", common.alias("common"))
    stars = tested.where(F.lit(den) * F.col("common") >= F.lit(num) * (F.col("n_a") + F.col("n_b") - F.col("common")))
    stars = saved(stars.select("a", "b"), "stars")
    label = components(stars)

    # Buckets of several components: cut by size level and hash part, compare across components inside blocks.
    placed = members.join(label.withColumnRenamed("id", "node"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_buckets = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("left_over"))
    open_buckets = open_buckets.where(F.col("lo") != F.col("hi")).select("bucket", "left_over")
    step = -math.log(float(share)) + 1e-9  # two linked sizes are one level apart at most
    leveled = placed.join(open_buckets, "bucket").withColumn("level", F.floor(F.ln(F.col("n_shingles")) / F.lit(step)).cast("int"))
    home = leveled.withColumn("at_level", F.explode(F.array(F.col("level"), F.col("level") - 1)))
    per = F.greatest(F.lit(BLOCK[0]), F.least(F.lit(BLOCK[1]), F.lit(BLOCK_SHINGLES) / F.exp(F.col("at_level") * F.lit(step))))
    home = home.withColumn("parts", F.ceil(F.col("left_over") / per).cast("int"))
    home = home.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    home = home.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = home.select("bucket", "at_level", F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"),
                         F.col("node").alias("id"), "comp", "n_shingles", "level", "part")
    keys = ["bucket", "at_level", "left", "right"]
    mixed = blocks.groupBy(*keys).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("level").alias("low"))
    mixed = mixed.where((F.col("lo") != F.col("hi")) & (F.col("low") == F.col("at_level"))).select(*keys)
    blocks = blocks.join(mixed, keys).join(sized.select(F.col("node").alias("id"), "shingles"), "id")
    dealt = blocks.repartition(*keys).sortWithinPartitions(*keys)
    across = saved(dealt.mapInArrow(block_links(num, den), "a bigint, b bigint").distinct(), "links")
    released(members, sets, stars)
    joined = components(across).select(F.col("id").alias("star"), F.col("comp").alias("whole"))

    placed = nodes.join(label.select(F.col("id").alias("node"), F.col("comp").alias("own")), "node", "left").withColumn("star", F.coalesce("own", "node"))
    placed = placed.join(joined, "star", "left").withColumn("comp", F.coalesce("whole", "own"))
    placed = saved(placed.select("set_key", "id", "copies", "node", "comp"), "placed")
    least = placed.where(F.col("comp").isNotNull()).groupBy("comp").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("of_comp"))
    linked = spread_join(placed.where(F.col("comp").isNotNull()), least, ["comp"], "of_comp").select("set_key", "copies", "component", F.col("comp").alias("group"))
    copied = placed.where(F.col("comp").isNull() & (F.col("copies") > 1)).select("set_key", "copies", F.col("id").alias("component"), F.col("node").alias("group"))
    named = linked.unionByName(copied)
    return sigs, saved(named, "named")


def answered(sigs: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (id, n_shingles, text_key, component, group) from the results of ``near_classes``. Classes with many copies, fewer than 1000,
    are joined by broadcast; rows without words or id have no class; the group of rows without copies and links is null."""
    full = F.col("id").isNotNull() & (F.col("n_shingles") > 0)
    row = ["id", "n_shingles", "text_key"]
    heavy = classes.withColumn("all", sigs.agg(F.count(F.lit(1))).scalar()).where(F.col("copies") * 1000 > F.col("all"))
    met = sigs.where(full).join(F.broadcast(heavy.select("set_key", "component", "group")), "set_key", "left")
    here = met.where(F.col("group").isNotNull()).select(*row, "component", "group")
    rest = met.where(F.col("group").isNull()).drop("component", "group").join(classes.drop("copies"), "set_key", "left")
    alone = sigs.where(~F.coalesce(full, F.lit(False))).select(*row, F.col("id").alias("component"), F.lit(None).cast("bigint").alias("group"))
    return here.unionByName(rest.select(*row, F.coalesce("component", "id").alias("component"), "group")).unionByName(alone)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: str = "0.85",
                    width: int = WIDTH, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept. ``threshold`` is a decimal text, compared exactly."""
    plain = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    answer = answered(*near_classes(plain, threshold, width, rows, miss))
    answer = answer.select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"))
    return answer.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: str = "0.85",
                            width: int = WIDTH, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """The rows of ``docs``, one of each component: that of the smallest id, of its texts the one with the smallest md5, of rows equal in
    both the one whose columns hash lowest. Rows without words or id are no one's copies and stay. Texts that are no one's copies
    are not moved."""
    plain = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rated = answered(*near_classes(plain, threshold, width, rows, miss)).where(F.col("group").isNotNull())
    rated = saved(rated.groupBy("id", "text_key", "group").agg(F.count(F.lit(1)).alias("n")), "rated")
    first = rated.groupBy("group").agg(F.min(F.struct("id", "text_key")).alias("first"), F.count(F.lit(1)).alias("texts"))
    ranked = spread_join(rated, first, ["group"], "texts")
    gone = F.struct("id", "text_key") != F.col("first")
    plans = saved(ranked.where(gone | (F.col("n") > 1)).select("id", "text_key", gone.alias("gone")), "plans")
    # What the filter lets pass is decided exactly; all other rows stay where they lie.
    filled, power = bloom(plans, "id", "text_key")
    text, words = F.col(text_col), F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False)) & F.col(id_col).isNotNull()
    order = F.xxhash64(*[F.col(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()])
    packed = docs.where(words).select(F.col(id_col).cast("bigint").alias("id"), F.unhex(F.md5(text)).alias("text_key"), order.alias("order"), F.struct(*docs.columns).alias("row"))
    hashed = packed.withColumns(hashes("id", "text_key"))
    lone = split_by_filter(hashed, filled, power, False)
    asked = split_by_filter(hashed, filled, power, True).join(plans.where("gone").select("id", "text_key"), ["id", "text_key"], "left_anti")
    once = asked.groupBy("id", "text_key").agg(F.min_by("row", "order").alias("row"))
    return docs.where(~words).unionByName(lone.select("row.*")).unionByName(once.select("row.*"))
