"""Main text of pages: reading of markup, the network's gradients, planted layouts, the tables' pages, awkward rows."""

import re
from collections import Counter

import numpy as np
import pytest

from barweave.llm import extract, recurrent
from barweave.llm.layouts import made_up
from barweave.llm.leaves import read
from barweave.llm.queries import QUERIES


def texts(page):
    return [leaf.text for leaf in read(page).leaves]


@pytest.mark.parametrize("page,want", [
    ("", []), ("plain  \n text", ["plain text"]), ("<p>a<p>b<br>c</p>d", ["a", "b c", "d"]),
    ("<p>x &amp; y&nbsp;&eacute; &#233;&lt;b&gt;</p>", ["x & y é é<b>"]), ("a < b <3 c", ["a < b <3 c"]),
    ("<script>var t='</p>';</script><style>p{}</style>x<SCRIPT>a</Script >y", ["xy"]),
    ("<!-- a <p> -->b<!-- open <p>c", ["b"]), ("<div><p>a</div>b<ul><li>c<li>d<ul><li>e</ul></ul>", ["a", "b", "c", "d", "e"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]), ("<p>a <b>b</p><p>c</b> d", ["a b", "c d"]), ("</div></p>a</x>", ["a"]),
    ('<p title="a > b">c</p><p class=\'x>y\'>d', ["c", "d"]), ("<p>a</p", ["a"]), ("<p>a<a href='b", ["a"]), ("<textarea><p>a</textarea>b", ["b"]),
    ("<title>t</title><svg><title>u</title><p>x</p></svg>v", ["v"]), ("<p>a\x00b c</p>", ["a\x00b c"]),
])
def test_blocks(page, want):
    assert texts(page) == want


def test_reading_is_linear():
    for page in ("<" * 200000, "<a " * 100000, '<a b="' * 50001, "<!--" * 100000, "<div>" * 20000 + "x", "<script>" * 50000, "&" * 200000, "<p>" * 100000, "</p>" * 100000):
        assert len(texts(page)) <= 1


def test_gradients_by_differences():
    rng = np.random.default_rng(3)
    w = recurrent.start(5, 4, 1)
    x, mask = recurrent.padded([rng.normal(size=(n, 5)) for n in (1, 4, 7)])
    y = (rng.random(mask.shape) < 0.5) * 1.0
    _, grad = recurrent.gradients(w, x, mask, y)
    for name, g in grad.items():
        for at in list(np.ndindex(g.shape))[:: max(1, g.size // 15)]:
            keep = w[name][at]
            w[name][at] = keep + 1e-5
            up = recurrent.gradients(w, x, mask, y)[0]
            w[name][at] = keep - 1e-5
            down = recurrent.gradients(w, x, mask, y)[0]
            w[name][at] = keep
            assert abs((up - down) / 2e-5 - g[at]) < 1e-7


def test_segments_give_the_whole_sequences_scores():
    rng = np.random.default_rng(4)
    w = recurrent.start(6, 5, 2)
    seqs = [rng.normal(size=(n, 6)) for n in (1, 9, 30, 31)]
    whole = recurrent.logits(w, [len(s) for s in seqs], lambda k, a, b: seqs[k][a:b], segment=100)
    for segment in (1, 7, 10):
        parts = recurrent.logits(w, [len(s) for s in seqs], lambda k, a, b: seqs[k][a:b], segment=segment)
        assert all(np.allclose(a, b) for a, b in zip(whole, parts))
    alone = recurrent.logits(w, [9], lambda k, a, b: seqs[1][a:b])[0]
    assert np.allclose(alone, whole[1])


@pytest.fixture(scope="module")
def sample(spark, sf_dir):
    return [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").orderBy("page_id").collect()]


@pytest.fixture(scope="module")
def labeller(sample):
    return extract.learn_from(sample[:100], made=2000, epochs=7)


def test_layouts_never_seen(labeller, sample):
    """Blocks of other made-up layouts over other prose: the share of article blocks kept, and of kept blocks that are article."""
    prose = [[leaf.text for leaf in p.leaves if "article" in leaf.names] for p in (read(h, keep_names=True) for h in sample[100:200])]
    pages = made_up([p for p in prose if p], 300, 77)
    right = kept = wanted = 0
    for page, text in zip(pages, labeller.main_texts(pages)):
        want, got = Counter(leaf.text for leaf in read(page).leaves if leaf.mark == "1"), Counter(text.split("\n") if text else [])
        right += sum((want & got).values())
        kept += sum(got.values())
        wanted += sum(want.values())
    assert right / kept > 0.96 and right / wanted > 0.97


def test_other_sites_markup(labeller):
    """Pages written by hand: names and nesting that the layouts do not make."""
    said = ["River market council light stone garden people winter answer, and the walk was bright.", "Early in the day the council met under a common roof to hear the answer of the market.",
            "Nobody had seen the stone garden in winter light before, the people said."]
    page = f"""<html><head><title>River market | Site</title></head><body><div id="cookie-banner">We use cookies. <button>OK</button></div>
      <header class="site-header"><a href="/">Site</a><nav><ul><li><a href="/a">World</a><li><a href="/b">Money</a></ul></nav></header>
      <main><article class="hentry"><h1>River market</h1><p>{said[0]}</p><p>{said[1]}</p><p>{said[2]}</p></article>
      <section id="comments" class="comments-area"><h2>1 comment</h2><ol class="comment-list"><li class="comment"><b>Jo</b><p>Nice walk, thanks.</p></li></ol></section></main>
      <aside class="widget-area"><h3>Recent posts</h3><ul><li><a href="/1">Under the roof</a></li></ul></aside><footer class="site-footer">&copy; 2024</footer></body></html>"""
    plain = f"<body><div id=top><a href=/>Home</a> | <a href=/b>Blog</a></div><div id=content><h1>River</h1><p>{said[0]}<p>{said[1]}<p>{said[2]}</div><div id=footer><a href=/i>Imprint</a></div>"
    assert labeller.main_texts([page, plain]) == ["\n".join(["River market", *said]), "\n".join(["River", *said])]


def test_query_gives_the_articles(spark, sf_dir):
    """On the tables' pages the landmarks are known: the text must be exactly that of the article element."""
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = QUERIES["op11_recurrent_extraction"](spark, sf_dir).collect()
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    for r in got:
        inner = re.sub(r"(?s)^.*?<article>|</article>.*$", "", pages[r["page_id"]]["html"])
        want = [" ".join(t.split()) for t in re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<br>", " ", inner))]
        assert r["text"].split("\n") == [leaf for t in want if t for leaf in texts(t)] and r["n_chars"] == len(r["text"])


def test_awkward_rows(spark, labeller, sample):
    rows = [(1, "u", None, "a"), (None, None, "", "b"), (2, "u", sample[0], "c"), (2, "u", sample[0], "c"), (3, None, "<nav><a href=a>b</a></nav>", "d"),
            (4, "v", "<article><h1>Long page here</h1>" + "<p>Some words of a very long story, told at length.</p>" * 3000, "e"), (5, "w", "<article><p>" + "long " * 100000, "f")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = extract.main_text(pages, labeller).collect()
    assert [(r["page_id"], r["url"]) for r in got] == [(r[0], r[1]) for r in rows]
    assert [r["text"] for r in got[:2]] == ["", ""] and got[2]["text"] == got[3]["text"] != "" and all(r["n_chars"] == len(r["text"]) for r in got)
    assert got[5]["text"].count("\n") > 2900 and len(got[6]["text"]) == 499999
    assert extract.main_text(pages.limit(0), labeller).collect() == []


def test_sample_is_bounded_and_learning_needs_no_page(spark, sample):
    pages = spark.createDataFrame([(h,) for h in sample * 3 + [None, "", "x" * 70000]], "html string")
    found = extract.sampled(pages, n=20)
    assert len(found) == len(set(found)) == 20 and set(found) <= set(sample)
    assert extract.sampled(pages.limit(0)) == []
    assert extract.learn_from([], made=30, epochs=1).main_texts(["", "<p>x"])[0] == ""
