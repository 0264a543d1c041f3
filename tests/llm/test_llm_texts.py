"""Classifiers, personal data, URL templates, archives and the pipeline on small tables and awkward rows."""

import hashlib
import importlib
import random
import re
import time
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from barweave.llm import language, pii, quality, toxicity, urls, warc
from barweave.llm.queries import QUERIES, RULES

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

AWKWARD = [(None, "some text"), (9001, None), (9002, ""), (9003, " \n"), (9004, "x" * 200_000), (9005, "word " * 60_000), (9006, "\x00é\U0001F600"), (9006, "again")]


def awkward(spark):
    return spark.createDataFrame(AWKWARD, "doc_id long, text string").withColumns({"grade": F.lit("mine"), "score": F.lit(1), "said": F.lit(2), "lang": F.lit(None).cast("string")})


def labels_of(spark, docs, column):
    other = "toxic" if column == "quality" else "quality"
    return docs.select("doc_id", F.col("y").alias(column), F.lit(0).alias(other))


def share(got, docs, truth, guess):
    y = {r["doc_id"]: r[truth] for r in docs.collect()}
    rows = [r for r in got.collect() if r["held_out"]]
    assert rows
    return np.mean([r[guess] == y[r["doc_id"]] for r in rows])


@pytest.fixture(scope="module")
def good_and_bad(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    rows = []
    for i in range(600):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        y = int(rng.random() < 0.7)
        if not y:
            w = [w[0]] * len(w) if i % 2 else [x + "$$$" for x in w]
        rows.append((i, " ".join(w) + ".", y))
    return spark.createDataFrame(rows, "doc_id long, text string, y int").repartition(4)


def test_quality_learns_shapes(spark, good_and_bad):
    got = quality.quality_scores(good_and_bad, labels_of(spark, good_and_bad, "quality"))
    assert share(got, good_and_bad, "y", "predicted") > 0.95
    assert {r["doc_id"] for r in got.collect() if r["held_out"]} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2}


def test_quality_of_awkward_rows(spark, good_and_bad):
    labels = labels_of(spark, good_and_bad, "quality")
    odd = awkward(spark)
    model = quality.learn(good_and_bad, labels)
    kept = quality.graded(odd, model, "grade_").collect()
    assert len(kept) == len(AWKWARD) and all(0 <= r["grade_"]["score"] <= 1 for r in kept)
    none = quality.good_documents(odd, labels.limit(0))
    assert none.columns == odd.columns and none.count() == len(AWKWARD)
    assert quality.quality_scores(odd.limit(0), labels).count() == 0


def test_held_out_labels_are_not_read(spark, good_and_bad):
    labels = labels_of(spark, good_and_bad, "quality")
    turned = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.learn(good_and_bad, x) for x in (labels, turned))
    assert all(np.array_equal(x, y) for x, y in zip(a.tables, b.tables))


def test_toxicity_finds_the_sentence(spark):
    rng = random.Random(2)
    plain = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(800):
        s = [" ".join(rng.choice(plain) for _ in range(8)) for _ in range(rng.randint(1, 6))]
        y = int(rng.random() < 0.3)
        if y:
            s[rng.randrange(len(s))] += f" {rng.choice(['zork', 'blarg'])}{rng.choice('abcdefgh')}x"
        rows.append((i, ". ".join(s) + ".", y))
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int").repartition(4)
    got = toxicity.toxicity_scores(docs, labels_of(spark, docs, "toxic"))
    assert share(got, docs, "y", "predicted") > 0.95
    texts = {i: t for i, t, _ in rows}
    found = [(texts[r["doc_id"]][s["start"]:s["end"]]) for r in got.collect() for s in r["sentences"]]
    assert np.mean([("zork" in t or "blarg" in t) and "." not in t for t in found]) > 0.95
    odd = toxicity.toxicity_scores(awkward(spark), labels_of(spark, docs, "toxic"))
    scores = {r["doc_id"]: r["score"] for r in odd.collect()}
    assert scores[9001] == scores[9002] == scores[9003] and all(0 <= s <= 1 for s in scores.values())
    assert toxicity.toxicity_scores(docs.limit(0), labels_of(spark, docs, "toxic").limit(0)).count() == 0


def test_language(spark):
    rng = random.Random(3)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["str", "och", "ung"], "cc": ["ée", "ço", "aux"]}
    rows = [(i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(rng.randint(3, 40))), lang)
            for i in range(600) for lang in [rng.choice(list(syllables))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = language.languages(docs)
    assert share(got, docs, "lang", "lang_pred") > 0.97
    odd = docs.unionByName(awkward(spark).select("doc_id", "text", "lang"))
    answers = {(r["doc_id"], r["lang_pred"]) for r in language.languages(odd).collect() if r["doc_id"] is not None and r["doc_id"] > 9000}
    assert {(9001, "und"), (9002, "und"), (9003, "und")} <= answers and all(p != "und" for i, p in answers if i > 9003)
    assert {r["lang_pred"] for r in language.languages(awkward(spark)).collect()} == {"und"}
    assert language.languages(docs.limit(0)).count() == 0
    assert [language.has_letter(t.encode()) for t in ("", "12 ½ ² _", "é", "日", "1a")] == [False, False, True, True, True]


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, found):
    digits = [int(c) for c in found if c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        doubled = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def test_personal_data_matches_plain_patterns(spark):
    rng = random.Random(5)
    parts = list("ab1290..@@%+-_ ()é\U0001F600\n") + ["a@b.c", "0.2.3.4", "4444 4444 4444 4448", "+1 234 567 890", "4111111111111111"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.choice([3, 20, 60])))) for i in range(1500)]
    rows += [(5000, None), (5001, ""), (5002, "a" * 30000 + "@" + "b." * 20000), (5003, "1" * 50000), (5004, "1." * 30000), (5004, "x@y.z"), (None, "q@y.z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"spans": F.lit(1), "key": F.lit(2)}).repartition(4)
    got = sorted((str(r["doc_id"]), r["base_sha256"], [r[f"n_{k}"] for k in BASE]) for r in pii.personal_data(df).collect())
    want = []
    for i, t in rows:
        found = {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, t or "") if holds(k, m.group())] for k, p in BASE.items()}
        want.append((str(i), hashlib.sha256(",".join(x for f in found.values() for x in f).encode()).hexdigest(), [len(f) for f in found.values()]))
    assert got == sorted(want)
    assert pii.sanitised(df).columns == df.columns
    assert pii.personal_data(df.limit(0)).count() == 0


def test_disclosing_terms(spark):
    """A name that stands only beside one address is a disclosure; words that also occur elsewhere are not."""
    rows = [(i, f"case number{'abcdefghij'[i % 10] * 3} Quillon bob@x.org noted{'klmno'[i // 10] * 2} plain") for i in range(40)]
    rows += [(100 + i, "plain words about another case") for i in range(300)] + [(500, "Quillon without the address")] * 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    _, _, pairs = pii.searched(df.select(F.lit(None).cast("bigint").alias("id"), "text"))
    got = {(r["entity"], r["term"]): r["disclosure"] for r in pairs.collect()}
    n, c, both, t = len(rows), 40, 40, 41
    assert got == {("email:bob@x.org", "quillon"): pytest.approx(1 + np.log(both / t) / -np.log(c / n))}
    texts = {r["doc_id"]: r["text"] for r in pii.sanitised(df).collect()}
    assert all("Quillon" not in texts[i] and "[EMAIL]" in texts[i] and "plain" in texts[i] for i in range(40))
    assert texts[500] == rows[-1][1] and texts[100] == rows[40][1]


def test_one_shared_text_says_nothing(spark):
    """A word that stands beside an address in one text, however rare, stays; in three texts and in no other it goes, copies or not."""
    rows = [(0, "plain Quillon common bob@x.org words")] + [(1 + i, "plain words") for i in range(400)] + [(500 + i, "common") for i in range(9)]
    rows += [(600 + i, f"plain {w} Zebulon ann@x.org") for i, w in enumerate(["one", "two", "three"])] + [(700 + i, "plain Quark one tim@x.org") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    _, _, pairs = pii.searched(df.select(F.lit(None).cast("bigint").alias("id"), "text"))
    assert [(r["entity"], r["term"], r["evident"]) for r in pairs.collect()] == [("email:ann@x.org", "zebulon", pytest.approx(2 / 3))]
    texts = {r["doc_id"]: r["text"] for r in pii.sanitised(df).collect()}
    assert texts.pop(600) == "plain one [TERM] [EMAIL]" and texts[0] == "plain Quillon common [EMAIL] words" and texts[700] == "plain Quark one [EMAIL]"


def term_pairs(texts):
    """Brute force of the disclosing pairs over different texts: {(entity, term)}."""
    held, words = {}, {}
    for i, t in enumerate(texts):
        found = [(k, m) for k, p in BASE.items() for m in re.finditer(p, t) if holds(k, m.group())]
        body = list(t)
        for k, m in found:
            if k == "email":
                body[m.start():m.end()] = " " * (m.end() - m.start())
        words[i] = {w.lower() for w in regex.findall(r"\p{L}{3,}", "".join(body))}
        for k, m in found:
            held.setdefault(f"{k}:" + (m.group().lower() if k in ("email", "ip") else re.sub("[^0-9]", "", m.group())), set()).add(i)
    by_word = {}
    for i, ws in words.items():
        for w in ws:
            by_word.setdefault(w, set()).add(i)
    out = set()
    for c, of in held.items():
        tried = sum(len(words[i]) for i in of)
        for w in set().union(*(words[i] for i in of)):
            again, others = len(of & by_word[w]) - 1, len(by_word[w]) - 1
            e = others * len(of) / len(texts)
            if again > e and again / (others + pii.PRIOR) >= 2**-pii.LEFT_TERM and again * np.log(again / e) - again + e >= np.log(tried / pii.CHANCE) and (
                    again + 1 >= pii.COVERAGE * len(of)):
                out.add((c, w))
    return out


def test_disclosing_pairs_equal_brute_force(spark):
    rng = random.Random(8)
    names, values = [f"name{'abcdefghijklmnopqrst'[k]}" for k in range(20)], [f"u{k}@x.org" for k in range(8)] + ["10.0.0.1", "+1 234 567 8901"]
    rows = []
    for _ in range(500):
        words = [rng.choice("der die das und ein river market council light stone".split()) for _ in range(rng.randint(2, 9))]
        if rng.random() < 0.3:
            k = rng.randrange(10)
            words += [values[k], *(names[2 * k + j] for j in range(2) if rng.random() < 0.8)]
        if rng.random() < 0.1:
            words.append(rng.choice(names))
        if rng.random() < 0.05:
            words += values[:3]  # several entities in the same texts: one class
        rng.shuffle(words)
        rows.append(" ".join(words))
    rows = sorted(set(rows))
    df = spark.createDataFrame([(1, t) for t in rows], "id long, text string").repartition(3)
    _, _, pairs = pii.searched(df)
    got = {(r["entity"], r["term"]) for r in pairs.collect()}
    assert got == term_pairs(rows) and len(got) > 5


def test_shuffled_words_disclose_nothing(spark, sf_dir):
    """The tables' texts with all their words dealt anew: what stands beside a value by chance is no disclosure."""
    texts = sorted({r["text"] for r in spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").collect() if r["text"]})
    emails = [re.findall(BASE["email"].replace("(", "(?:"), t) for t in texts]
    words = [w for t in texts for w in re.findall(r"[^\W\d_]{3,}", t)]
    random.Random(1).shuffle(words)
    rows, at = [], 0
    for t, found in zip(texts, emails):
        n = len(re.findall(r"[^\W\d_]{3,}", t))
        rows.append((0, " ".join(words[at:at + n] + found + ["all@x.org"] * (at % 20 == 0))))
        at += n
    _, _, pairs = pii.searched(spark.createDataFrame(rows, "id long, text string").repartition(4))
    assert pairs.count() <= 2


def test_long_texts_take_seconds(spark):
    """200,000 numbers, and 50,000 addresses, in one text."""
    rows = [(1, " ".join(str(10**15 + 7 * i) for i in range(200000))), (2, " ".join(f"user{i}@x{i % 7}.org some words" for i in range(50000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    start = time.time()
    got = {r["doc_id"]: r for r in pii.personal_data(df).collect()}
    assert got[2]["n_email"] == 50000 and got[1]["n_email"] == 0
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(df).collect()}
    assert clean[2] == " ".join(["[EMAIL] some words"] * 50000) and time.time() - start < 90


def test_terms_disclose_in_the_whole_document(spark):
    """However far a term stands from the value, in each document that holds the value every occurrence goes, in no other."""
    far = "plain words " * 40
    rows = [(i, f"Quillon, {far} QUILLON {'éx' * i} {far}bob@x.org ubob@x.org") for i in range(20)] + [(50, f"bob@x.org {far}"), (51, "a quillon")]
    rows += [(100 + i, f"{far} {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    _, _, pairs = pii.searched(df.select(F.lit(None).cast("bigint").alias("id"), "text"))
    got = {(r["entity"], r["term"]): r["disclosure"] for r in pairs.collect()}
    d = lambda c: pytest.approx(1 + np.log(20 / 21) / -np.log(c / len(rows)))
    assert got == {("email:bob@x.org", "quillon"): d(21), ("email:ubob@x.org", "quillon"): d(20)}
    spans = {r["doc_id"]: r["spans"].split(",") for r in pii.personal_data(df).collect()}
    texts = {r["doc_id"]: r["text"] for r in pii.sanitised(df).collect()}
    for i, t in rows[:20]:
        more = [s.split(":") for s in spans[i] if not s.startswith("email")]
        assert [t[int(a):int(b)] for _, a, b in more] == ["Quillon", "QUILLON"]
        assert "quillon" not in texts[i].lower() and texts[i].count("plain words") == 80
    assert {i: texts[i] for i, _ in rows[21:]} == dict(rows[21:])


def template_tree(paths, branch=urls.BRANCH, share=urls.SHARE):
    """Brute force of the tree: {(host, path): labels} from {(host, path): n}."""
    parts = {k: [s for s in k[1].split("/") if s] for k in paths}
    labels = {k: [] for k in paths}
    shape = lambda s: re.sub("[0-9]+", "#", s)
    for d in range(max(map(len, parts.values()))):
        nodes = {}
        for k, v in parts.items():
            if len(v) > d:
                nodes.setdefault((k[0], tuple(labels[k])), []).append(k)
        for members in nodes.values():
            total = sum(paths[k] for k in members)
            seg = {s: sum(paths[k] for k in members if parts[k][d] == s) for s in {parts[k][d] for k in members}}
            for k in members:
                s = parts[k][d]
                same = sum(n for x, n in seg.items() if shape(x) == shape(s))
                labels[k] = labels[k] + [s if len(seg) <= branch or share * seg[s] >= total else shape(s) if share * same >= total else "*"]
    return labels


def test_url_templates(spark):
    rng = random.Random(6)
    urls_ = [f"http://h.example/{rng.choice(['en', 'de'])}/{rng.choice(['item', 'user', 'tag'])}{rng.randint(1, 400)}{rng.choice(['', '.html', '/x/y/z/a/b/c/d'])}" for _ in range(500)]
    paths = spark.createDataFrame([(u,) for u in urls_], "url string").select(*[c.alias(n) for c, n in zip(urls.parsed(F.col("url")), ("host", "path"))])
    counted = paths.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    got = {(r["host"], r["path"]): r["labels"] for r in urls.grown(counted).collect()}
    assert got == template_tree({(r["host"], r["path"]): r["n"] for r in counted.collect()})


def merged_brute(trees):
    """Brute force of the merging: {(host, labels): template} from {(host, labels): (labelled, bad)}."""
    template = {k: k[1] for k in trees}
    for d in reversed(range(max(len(k[1]) for k in trees))):
        kinds = {}
        for k, t in template.items():
            if len(t) > d:
                hole = (k[0], (*t[:d], "*", *t[d + 1:]))
                sums = kinds.setdefault(hole, {}).setdefault(t, [0, 0])
                sums[0] += trees[k][0]
                sums[1] += trees[k][1]
        into = {}
        for (host, hole), branches in kinds.items():
            p = (sum(b for _, b in branches.values()) + 0.5) / (sum(n for n, _ in branches.values()) + 1.0)
            for t, (n, b) in branches.items():
                if len(branches) > 1 and (n == 0 or abs(b / n - p) <= urls.ERRORS * (p * (1 - p) / n) ** 0.5):
                    into[(host, t)] = hole
        template = {k: into.get((k[0], t), t) for k, t in template.items()}
    return template


@pytest.mark.parametrize("seed", [1, 2])
def test_merging_and_verdicts_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    urls_, bad = [], {}
    for _ in range(700):
        host, kind = rng.choice(["a.example", "b.example"]), rng.choice(["ads", "docs", "x/y/z", "p/q"])
        tail = "/".join(rng.choice(["one", "two", "k7", "k8", f"id{rng.randint(1, 300)}"]) for _ in range(rng.choice([0, 1, 2, 9])))
        urls_.append(f"http://{host}/{kind}/{tail}")
    pages = spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string").repartition(3)
    rows = pages.select("page_id", *[c.alias(n) for c, n in zip(urls.parsed(F.col("url")), ("host", "path"))]).collect()
    for r in rows:
        if (r["host"], r["path"]) not in bad and rng.random() < 0.6:
            bad[r["host"], r["path"]] = int(rng.random() < (0.9 if "/ads" in r["path"] else 0.05))
    marks = spark.createDataFrame([(h, p, b) for (h, p), b in bad.items()], "host string, path string, bad int")
    counts = {}
    for r in rows:
        counts[r["host"], r["path"]] = counts.get((r["host"], r["path"]), 0) + 1
    labels = {k: tuple(v) for k, v in template_tree(counts).items()}
    trees = {}
    for k, v in labels.items():
        sums = trees.setdefault((k[0], v), [0, 0])
        sums[0] += k in bad
        sums[1] += bad.get(k, 0)
    template = merged_brute(trees)
    prior = (sum(bad.values()) + 1) / (len(bad) + 4)
    totals = {}
    for (host, v), (n, b) in trees.items():
        sums = totals.setdefault((host, template[host, v]), [0, 0])
        sums[0] += n
        sums[1] += b
    got = urls.judged(pages, marks, []).collect()
    assert len(got) == len(rows) and len({r["verdict"] for r in got}) == 2
    for r in got:
        t = template[r["host"], labels[r["host"], r["path"]]]
        n, b = totals[r["host"], t]
        assert r["template"] == "/" + "/".join(t)
        assert r["verdict"] == ("block" if (b + urls.WEIGHT * prior) / (n + urls.WEIGHT) >= urls.CUT else "allow")


def test_deep_paths_are_told_apart(spark):
    """Good and bad branches below a long common beginning, and paths of a thousand segments, in a few rounds."""
    deep = "/".join(f"s{i}" for i in range(1000))
    rows = [(i, f"http://h.example/a/b/c/d/e/f/{'evil' if i % 2 else 'good'}/{i}") for i in range(120)]
    rows += [(500 + i, f"http://h.example/{deep}/{'evil' if i % 2 else 'good'}/{i}") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    host, path = urls.parsed(F.col("url"))
    marks = pages.where("page_id % 4 < 2").select(host.alias("host"), path.alias("path"), F.when(F.col("url").contains("evil"), 1).otherwise(0).alias("bad"))
    got = {r["page_id"]: r["verdict"] for r in urls.judged(pages, marks, []).collect()}
    assert all((got[i] == "block") == (i % 2 == 1) for i, _ in rows)


def test_url_verdicts(spark):
    rows = [(i, f"http://Shop.Example.com/ads/{i}") for i in range(60)] + [(100 + i, f"http://shop.example.com/docs/{i}") for i in range(60)]
    rows += [(300, None), (301, "no scheme"), (302, "http://a.example.net/en/1"), (303, "http://a.NET?x"), (304, "http://a.net/"), (305, "http://é.org/fr/?q"), (306, "http://xorg/fr/"), (306, "http://xorg/fr/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit(1), "verdict": F.lit(2)})
    host, path = urls.parsed(F.col("url"))
    marks = pages.where("page_id < 200 and page_id % 2 = 0").select(host.alias("host"), path.alias("path"), (F.col("page_id") < 100).cast("int").alias("bad"))
    got = {r["page_id"]: r for r in urls.judged(pages, marks, RULES).collect()}
    assert {got[i]["verdict"] for i in range(60)} == {"block"} and {got[i]["verdict"] for i in range(100, 160)} == {"allow"}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(300, 307)] == [
        ("", "", None), ("", "", None), ("a.example.net", "/en/1", "example.net/en/"), ("a.net", "", None), ("a.net", "/", "net/"),
        ("é.org", "/fr/", "org/fr/"), ("xorg", "/fr/", None)]
    assert urls.judged(pages, marks, RULES).count() == len(rows)
    assert urls.judged(pages.limit(0), marks.limit(0), RULES).count() == 0


def test_archives_round_trip(spark):
    long, header = "é" * 700, "HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\n\r\n" * 60
    rows = [(1, "http://b.org/x", long), (2, "http://a.org/y", long), (3, "http://a.org/y", header), (4, None, None), (5, "http://a.b/\r\nX-Page-Id: 9", "short"),
            (6, "http://c.org/", "short"), (7, "HTTP://A.org/Z?q#f", header), (8, "u", ""), (8, "u", long), (8, "u", long), (None, "http://n.org/", "x" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(3)
    got = warc.capture_index(pages, file_bytes=3000).collect()
    raw = [(i, (t or "").encode()) for i, _, t in rows]
    want = []
    for i, p in raw:
        same = [j for j, q in raw if p == q and j is not None] if len(p) >= 1000 else []
        top = max(same, default=None) if i is not None else None
        old = top is not None and i < top
        want.append(repr((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if old else "response", top if old else None)))
    assert sorted(repr((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got) == sorted(want)
    keys = [(r["url_key"], r["timestamp"]) for r in got]
    assert keys == sorted(keys) and "org,a)/y" in {k for k, _ in keys}
    assert warc.capture_index(pages.limit(0)).count() == 0


def test_loser_tree_merges_any_runs():
    rng = random.Random(8)
    for k in range(7):
        runs = [sorted(((rng.randint(0, 9), f"k{rng.randint(0, 5)}", "t", "f", n) for n in range(rng.randint(0, 6))), key=warc.order) for _ in range(k)]
        flat = [x for r in runs for x in r]
        assert [warc.order(x) for x in warc.LoserTree(runs)] == sorted(map(warc.order, flat))


def test_pipeline_stages(spark, sf_dir):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, "", "en", "s", 0), (7001, None, None, None, None), (7002, "mail a@b.org now", "en", "s", 16), (7002, "mail a@b.org now", "en", "s", 16)], docs.schema)
    whole = docs.unionByName(odd).withColumns({"grade": F.lit(1), "leak": F.lit("x"), "nth": F.lit(0), "pii_key": F.lit(0)})
    by_name = dict(pipeline.STAGES)
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "packing"]
    for name in list(by_name)[:-1]:
        out = by_name[name](spark, whole, sf_dir)
        assert out.columns == whole.columns and out.schema["doc_id"].dataType == whole.schema["doc_id"].dataType
        rows = out.collect()
        if name == "near_duplicates":
            assert sum(r["doc_id"] == 7002 for r in rows) == 1 and sum(r["doc_id"] is None for r in rows) == 1
        if name == "pii":
            assert len(rows) == whole.count() and {r["text"] for r in rows if r["doc_id"] == 7002} == {"mail [EMAIL] now"}
        assert by_name[name](spark, whole.limit(0), sf_dir).count() == 0
    result = pipeline.run(spark, sf_dir)
    assert 0 < result.select("doc_id").distinct().count() < docs.count()


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
