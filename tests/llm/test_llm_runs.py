"""Periodic runs: brute force over random words, planted repetitions, slices of long texts, awkward rows."""

import hashlib
import random
import re
import zlib

import pytest

from barweave.llm import runs
from barweave.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """(start, length, period) of every run, each period taken on its own and smaller periods of the same stretch taken off."""
    n, spans = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q) and not any(all(words[k] == words[k + d] for k in range(i, j + q - d)) for d in range(1, q)):
                spans[(i, j + q - i, q)] = True
            i = j
    return sorted(spans)


def collapse(words, found):
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def invented(rng):
    kind = rng.randrange(5)
    if kind == 0:
        return [rng.choice("ab") for _ in range(rng.randrange(1, 90))]
    if kind == 1:
        return [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 40))] + ["x"] * rng.randrange(30) + [str(rng.random()) for _ in range(5)]
    out = [str(rng.randrange(400)) for _ in range(rng.randrange(30))]
    for _ in range(rng.randrange(1, 4)):
        block = [str(rng.randrange(300)) for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 33, 64]))]
        length = int(len(block) * rng.choice([1.5, 1.95, 2, 2.3, 4, 9]))
        out += [block[i % len(block)] for i in range(length)] + [str(rng.randrange(400)) for _ in range(rng.choice([0, 0, 3, 20]))]
    return out


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def test_fragments_equal_brute_force():
    rng = random.Random(13)
    texts = [invented(rng) for _ in range(300)] + [["a"] * 50, ["a", "b"] * 40, fibonacci(233), ["a"] * 11, ["a"] * 12, []]
    sizes, found = runs.fragments([" ".join(t).encode() for t in texts])
    for words, n, spans in zip(texts, sizes, found):
        assert n == len(words) and sorted((s, e - s, p) for p, s, e in spans) == brute(words)


def test_slices_hold_every_tile():
    """Fragments of slices, stitched where they share a period, are the runs of the whole text."""
    rng = random.Random(14)
    for size in (64, 200):
        for _ in range(25):
            words = sum((invented(rng) for _ in range(6)), [])
            parts = list(runs.sliced([" ".join(words).encode()], size))
            _, found = runs.fragments([w for _, _, w in parts], [s for _, s, _ in parts])
            by_period = {}
            for p, s, e in sorted({f for spans in found for f in spans}):
                mine = by_period.setdefault(p, [])
                if mine and s <= mine[-1][1] - p:
                    mine[-1][1] = max(mine[-1][1], e)
                else:
                    mine.append([s, e])
            assert sorted((s, e - s, p) for p, spans in by_period.items() for s, e in spans) == brute(words)


@pytest.mark.parametrize("options", [{}, {"long": 200, "size": 64}, {"long": 0, "size": 16}])
def test_operator_on_awkward_rows(spark, options):
    rng = random.Random(15)
    texts = [" ".join(invented(rng)) for _ in range(60)] + [None, "", " \t\n", "one", "b\x00 é x " * 9, "Az az " * 7, "\x0bq\x0cr\r" * 20]
    rows = [(i if i % 9 else None, t, "z", [i]) for i, t in enumerate(texts)] + [(5, texts[5], "z", [0]), (5, "w " * 40, "z", [0])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, body string, runs array<int>")
    got = runs.periodic_runs(docs, **options).collect()
    want = []
    for i, t, *_ in rows:
        words = WORD.findall(t or "")
        found = brute(words)
        want.append((i, len(words), found, collapse(words, found)))
    assert sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got), key=str) == sorted(want, key=str)
    assert runs.periodic_runs(docs.limit(0), **options).count() == 0


def test_long_text_in_reasonable_time():
    """Work grows as n log n: a text of one repeated word, the worst case, and one of two large copies."""
    n, found = runs.fragments([b"a " * 30000, b" ".join(str(i % 20000).encode() for i in range(50000))])
    assert list(n) == [30000, 50000] and found == [[(1, 0, 30000)], [(20000, 0, 50000)]]


def test_query_equals_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in QUERIES["op13_periodic_runs"](spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    planted = 0
    for i, text in texts.items():
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
            planted += 1
        if n > 4000:
            continue  # too slow by brute force
        found = brute(words)
        best = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None,) * 3
        r = got[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{x},{q}\n" for s, x, q in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapse(words, found).encode()).hexdigest()
    assert planted > 5
