"""Near duplicates, decontamination, packing, top-k: brute force on small tables and awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barweave.llm import decontaminate, minhash, packing, topk
from barweave.llm.queries import QUERIES, SQL
from oracle_check import connect, rows_of

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cur = connect(sf_dir).execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def groups(rows, num, den):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def varied(seed):
    """Bases with chains of small changes, so that links, non-links and borderline pairs all occur."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([3, 6, 40, 80, 160]))]
        for _ in range(rng.randint(1, 12)):
            rows.append((len(rows), rng.choice([" ", "\n", " \t"]).join(text)))
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = rng.choice(words)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_match_all_pairs(spark, seed):
    rows = [*varied(seed), (900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one TWO"), (905, "\x00 a"), (906, "É x"), (907, "é x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("mine")).withColumn("id", F.lit(1)).repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df).collect()}
    assert got == groups(rows, 85, 100)


def test_near_duplicates_inside_small_blocks(spark, monkeypatch):
    """Blocks of two sets: cuts by part and level must lose no link."""
    monkeypatch.setattr(minhash, "BLOCK", (2, 2))
    rows = varied(7)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, threshold="0.8").collect()}
    assert got == groups(rows, 80, 100)


def test_blocks_give_joined_components_not_pairs_of_texts():
    """Two linked components of 40 texts each have 1600 linked pairs in a block; one row tells all of it."""
    values = np.arange(20, dtype=np.int64)
    texts = [(comp, values) for comp in [3] * 40 + [8] * 40] + [(11, values + 1000), (12, values + 1001)]
    n = len(texts)
    batch = pa.record_batch({
        "bucket": pa.array([1] * n, pa.int64()), **{c: pa.array([0] * n, pa.int32()) for c in ("at_level", "left", "right", "level", "part")},
        "id": pa.array(range(n), pa.int64()), "comp": pa.array([c for c, _ in texts], pa.int64()),
        "n_shingles": pa.array([20] * n, pa.int64()), "shingles": pa.array([v for _, v in texts], pa.list_(pa.int64()))})
    found = [r for out in minhash.block_links(80, 100)(iter([batch])) for r in out.to_pylist()]
    assert found == [{"a": 3, "b": 8}, {"a": 11, "b": 12}]


def test_near_duplicates_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c")], "doc_id long, text string")
    got = minhash.near_duplicates(df).collect()
    assert [(r["component_id"], r["kept"]) for r in sorted(got, key=str)] == [(1, True), (1, True), (None, True)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_different_texts_under_one_id(spark):
    """Each text of an id has its own links, and only the text that is a copy goes."""
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a), (1, b), (2, b + " more"), (3, a + " more"), (4, a.upper()), (4, "alone " * 9), (1, a), (5, a), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"dup_key": F.lit(1), "m": F.create_map(F.lit("k"), F.lit(1))})
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect())
    assert got == [(0, 56, None, True), (1, 56, 1, True), (1, 56, 1, True), (1, 56, 1, True), (2, 57, 1, False), (3, 57, 1, False), (4, 1, 4, True), (4, 56, 1, False), (5, 56, 1, False)]
    left = minhash.without_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left.collect()) == sorted([(0, a), (1, min(a, b, key=lambda t: hashlib.md5(t.encode()).digest())), (
        1, max(a, b, key=lambda t: hashlib.md5(t.encode()).digest())), (4, "alone " * 9)])


def test_filter_never_loses_an_id(spark):
    ids = spark.range(5000).select((F.col("id") * 7919 - 10**9).alias("id"))
    held, power = minhash.bloom(ids, "id")
    both = ids.select(F.xxhash64("id").alias("h1"), F.xxhash64("id", F.lit("second")).alias("h2")).toArrow()
    for c in ("h1", "h2"):
        place = both[c].to_numpy().view(np.uint64) >> np.uint64(64 - power)
        assert ((held[place >> np.uint64(6)].view(np.uint64) >> (place & np.uint64(63))) & np.uint64(1) == 1).all()
    assert power == 16 and 0.05 < np.unpackbits(held.view(np.uint8)).mean() < 0.2


def test_circulant_signature_estimates_jaccard():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:2400], rng.integers(0, 2**63, 600).astype(np.uint64)]))
    x, y = minhash.signatures([a, b], 400)
    assert abs((x == y).mean() - 2400 / (len(a) + len(b) - 2400)) < 0.08


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def leaks(text, items):
    d, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(max(len(w) - n + 1, 0) if n else 0):
            for p in range(len(d) - n + 1):
                if d[p:p + n] == w[k:k + n]:
                    hit |= set(range(p, p + n))
                    found |= {item} - {None}
    listed = ",".join(sorted(map(str, found)))
    return len(d), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest()


@pytest.mark.parametrize("limit", [decontaminate.SLICE, 60])
def test_contamination_matches_scan(spark, limit):
    rng = random.Random(4)
    pool = [f"t{i}" for i in range(9)] + ["É", "z9"]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(1, text(14)), (2, "solo"), (3, text(3)), (4, None), (5, "..."), (None, text(4)), (6, "x x x x x x x x x x x x x"), (7, text(25)), (7, text(2))]
    docs = [(i, text(rng.choice([0, 1, 5, 30, 200])) + rng.choice(["", " SOLO!", " " + (items[0][1] or "").upper(), " x" * 15])) for i in range(60)]
    docs += [(100, None), (101, ""), (102, items[7][1] * 3), (102, items[7][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n_hit", F.lit(0))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("leak", F.lit("mine")).repartition(3)
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in decontaminate.contamination(df, bench, limit=limit).collect())
    assert got == sorted((i, *leaks(t, items)) for i, t in docs)
    clean = decontaminate.without_leaks(df, bench, limit=limit)
    assert clean.columns == df.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(i for i, t in docs if leaks(t, items)[1] == 0)
    assert decontaminate.contamination(df, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(df.limit(0), bench).count() == 0


def test_longest_match_is_located(spark):
    bench = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(20)))], "item_id long, text string")
    docs = spark.createDataFrame([(5, "start " + " ".join(f"Q{i}" for i in range(3, 16)) + " end")], "doc_id long, text string")
    found = decontaminate.contamination(docs, bench).first()
    assert [(m["item_id"], m["start"], m["length"], m["item_start"]) for m in found["matches"]] == [(1, 1, 13, 3)]
    assert (found["longest_match"], found["longest_start"]) == (13, 1)
    apart = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(1, 11)) + " x " + " ".join(f"w{i}" for i in range(2, 12)))], "item_id long, text string")
    docs = spark.createDataFrame([(5, " ".join(f"w{i}" for i in range(1, 12)))], "doc_id long, text string")
    assert {(m["start"], m["length"], m["item_start"]) for m in decontaminate.contamination(docs, apart).first()["matches"]} == {(0, 10, 0), (1, 10, 11)}


def test_suffix_arrays_and_longest_matches_by_brute_force():
    rng = random.Random(12)
    for depth in (1, 2, 3, 7, 40):
        texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(12)] + ["a " * 60]
        seq = decontaminate.Sequence([t.encode() for t in texts])
        suffix = lambda p: tuple(seq.words[p:min(seq.end[p], p + depth)].tolist())
        order = seq.suffix_array(depth)
        assert sorted(order) == list(range(len(seq.words))) and [suffix(p) for p in order] == sorted(suffix(p) for p in order)
    items = [(1, "a b c a a b"), (2, "c c c c"), (3, "d"), (4, "a " * 20)]
    needles = decontaminate.Needles(items, 4)
    best, where = needles.longest_matches(seq, seq.suffix_array(needles.longest))
    for q in range(len(needles.seq.words)):
        rest = needles.seq.words[q:needles.seq.end[q]].tolist()
        agree = lambda p: next((k for k, (x, y) in enumerate(zip(rest, seq.words[p:seq.end[p]].tolist())) if x != y), min(len(rest), int(seq.end[p]) - p))
        assert best[q] == max(agree(p) for p in range(len(seq.words))) and (best[q] == 0 or agree(int(where[q])) == best[q])


@pytest.mark.parametrize("limit", [decontaminate.SLICE, 60])
def test_matches_are_the_longest_at_their_places(spark, limit):
    """For every place and item: the longest verbatim agreement of at least a window, less those inside an earlier one."""
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    items = [(k, text(rng.choice([2, 9, 12, 25]))) for k in range(6)] + [(6, "a " * 16)]
    docs = [(i, " ".join([text(20), rng.choice(items)[1], text(5), "a " * rng.choice([0, 25]), rng.choice(items)[1][4:]])) for i in range(40)]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), limit=limit)
    for r in got.collect():
        d = words(docs[r["doc_id"]][1])
        want = set()
        for item, t in items:
            w, end = words(t), -1
            for p in range(len(d)):
                best = max((next((k for k in range(min(len(d) - p, len(w) - q)) if d[p + k] != w[q + k]), min(len(d) - p, len(w) - q)) for q in range(len(w))), default=0)
                if best >= min(10, len(w)) and p + best > end:
                    want.add((item, p, best))
                    end = p + best
        assert {(m["item_id"], m["start"], m["length"]) for m in r["matches"]} == want
        assert all(d[m["start"]:m["start"] + m["length"]] == words(items[m["item_id"]][1])[m["item_start"]:m["item_start"] + m["length"]] for m in r["matches"])


def test_tokens_equal_the_tokenizer():
    encode = packing.WordTokens(TOKENIZER)
    texts = ["Plain words, it's 12½!", "<|endoftext|> in text", "İstanbul ΣΑΣ", "ﬁ ǅ Ⱥb Ɓć", "a\x1fb\x85c\xa0d\x00", "日本 don't", "", "''s''' 're $$'m", "x\x0by\x0cz"]
    for t in texts:
        want = np.array(encode.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert encode(t.encode()) == want


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_everything(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 30, 2048])
    counts = {}
    for _ in range(rng.choice([1, 40, 2000])):
        n = rng.randint(1, capacity) if rng.random() < 0.7 else rng.choice([1, capacity, max(capacity // 3, 1)])
        counts[n] = counts.get(n, 0) + 1
    bins, seen = {}, set()
    for n, first, per, count, at, offset in packing.plan(counts, capacity).tolist():
        for k in range(per * count):
            seen.add((n, first + k))
            bins.setdefault(at + k // per, []).append((offset + k % per * n, n))
    assert seen == {(n, k) for n, c in counts.items() for k in range(c)}
    for placed in bins.values():
        end = 0
        for offset, n in sorted(placed):
            assert offset == end
            end += n
        assert end <= capacity
    least = -(-sum(n * c for n, c in counts.items()) // capacity)
    assert len(bins) <= 1.25 * least + 1


def test_packing_round_trip(spark):
    docs = [(1, "one two three"), (2, None), (3, ""), (4, "word " * 700), (4, "word " * 700), (None, "x y"), (6, "A, b! " * 20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("length", F.lit(3)).repartition(3)
    rows = packing.pack(df, TOKENIZER, capacity=256).collect()
    tokenizer = packing.WordTokens(TOKENIZER).tokenizer
    want = []
    for i, t in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 256):
            part = ids[k:k + 256]
            want.append((str(i), k // 256, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    filled = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 256
    assert packing.pack(df.limit(0), TOKENIZER).count() == 0


def test_top_products_match_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=8), 1)]) for i in range(400)] + [(50, [9.0] * 8), (401, None), (402, [1.0, None]),
            (403, [float("nan")] * 8), (404, [float("inf")] * 8), (450, []), (405, [0.5]), (3, [0.25] * 8), (406, [0.5]), (406, [0.5]), (None, [9.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(0)).withColumn("norm", F.lit("x"))
    got = [tuple(r) for r in topk.top_inner_products(df, df.where("vec_id % 50 = 0"), seed=20, block=40).collect()]
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    ints = sorted((i, tuple(np.floor(256 * np.array(v + (0.0,) * (8 - len(v)))).astype(int).tolist())) for i, v in good)
    want = []
    for q in {i for i, _ in ints if i % 50 == 0}:
        best = {}
        for i, v in ints:
            for a, w in ints:
                if a == q and i != q:
                    best.setdefault(i, set()).add(sum(x * y for x, y in zip(v, w)))
        scored = sorted(((s, -i) for i, of in best.items() for s in of), reverse=True)[:5]
        want += [(q, k + 1, -i, s) for k, (s, i) in enumerate(scored)]
    assert sorted(got) == sorted(want)
    assert topk.top_inner_products(df.limit(0), df.limit(0)).count() == 0
