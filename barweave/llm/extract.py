"""Main text of web pages by a recurrent block labeller: a bidirectional LSTM over a page's leaf blocks, in numpy.

A page is read into its leaf blocks (``leaves``). Each becomes a vector of hashed names of its tag path, hashed words and a few
measures (``features``). The LSTM walks the blocks in both directions, so every block is judged with the whole document in view
(``recurrent``), and blocks that come out above one half are the main text, joined in page order.

Fitting uses at most ``SAMPLE`` pages of at most ``SAMPLE_BYTES`` bytes, drawn by a hash of the page. Sampled pages with an
``article`` or ``main`` element teach by these landmarks; besides, ``MADE`` pages are laid out anew from sampled prose, with other
elements, names and order and the label of each block known (``layouts``). Nothing else reaches the driver.

Defined results: blocks are texts between block elements; a line break element or any white space inside a block counts as one
blank; character references are decoded. Scripts, styles, templates, buttons, option lists, text areas, titles, vector images
and embedded media hold no blocks, whatever they contain. Null and empty pages and pages without a block of main text give the
empty text. Unclosed or crossed elements, and pages cut anywhere, are read as far as they go. Equal pages, null or equal ids and urls are answered row by
row; other columns are not read. Very long pages go through in segments of blocks; no text is cut. Learning without any page uses built-in phrases.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.llm.common import annotated
from barweave.llm.features import OWN, PATH, WIDTH, leaf_vector
from barweave.llm.layouts import made_up
from barweave.llm.leaves import Page, read
from barweave.llm.recurrent import Weights, fit, logits

SAMPLE, SAMPLE_BYTES = 300, 1 << 16
MADE = 3000
REPEAT = 3  # how often a page with a landmark is seen in one pass, against once for a made-up one
HIDDEN = 32
EPOCHS = 8
SEED = 11
TOGETHER = 64
#: Elements and class words that end the article's reach, for pages that teach by landmark.
OUTSIDE = frozenset("nav aside footer form ad ads advert comments comment sidebar cookie newsletter related".split())


def vectors(page: Page, a: int, b: int) -> np.ndarray:
    """Vectors of the leaves a..b of a page."""
    out = np.zeros((b - a, WIDTH), np.float32)
    title, last = frozenset(page.title.lower().split()), max(len(page.leaves) - 1, 1)
    for k in range(a, b):
        leaf = page.leaves[k]
        leaf_vector(leaf.text, leaf.path, leaf.linked, title, k / last, out[k - a])
    return out


def taught(page: Page) -> np.ndarray | None:
    """Labels of a page that has a landmark."""
    inside = [bool({"article", "main"} & set(x.names)) for x in page.leaves]
    if not any(inside):
        return None
    return np.array([i and not OUTSIDE & {n.lower() for n in x.names} for i, x in zip(inside, page.leaves)], np.float32)


def varied(rng: np.random.Generator, x: np.ndarray) -> np.ndarray:
    """A page as seen in one pass of learning: part of the hashed path names and words are hidden."""
    shown = rng.random(WIDTH) >= 0.08
    shown[PATH + OWN:] |= rng.random(WIDTH - PATH - OWN) < 0.5
    return x * shown.astype(x.dtype)


@dataclass
class Labeller:
    weights: Weights

    def main_texts(self, pages: list[str]) -> list[str]:
        """The main text of each page."""
        read_pages = [read(p) for p in pages]
        out = [""] * len(pages)
        order = sorted((k for k, p in enumerate(read_pages) if p.leaves), key=lambda k: len(read_pages[k].leaves))
        for at in range(0, len(order), TOGETHER):
            group = order[at:at + TOGETHER]
            for k, z in zip(group, logits(self.weights, [len(read_pages[k].leaves) for k in group], lambda i, a, b: vectors(read_pages[group[i]], a, b))):
                out[k] = "\n".join(leaf.text for leaf, s in zip(read_pages[k].leaves, z) if s > 0)
        return out


def learn_from(sample: list[str], made: int = MADE, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """A labeller fitted on sampled pages and on pages laid out from their prose."""
    xs, ys, prose = [], [], []
    for page in (read(p, keep_names=True) for p in sample):
        y = taught(page)
        if y is not None:
            xs += [vectors(page, 0, len(page.leaves))] * REPEAT
            ys += [y] * REPEAT
            own = [leaf.text for leaf, one in zip(page.leaves, y) if one]
        else:
            own = [leaf.text for leaf in page.leaves if len(leaf.text) > 80 and leaf.linked < 0.3]
        if own:
            prose.append(own)
    for page in map(read, made_up(prose, made, seed)):
        if page.leaves:
            xs.append(vectors(page, 0, len(page.leaves)))
            ys.append(np.array([leaf.mark == "1" for leaf in page.leaves], np.float32))
    return Labeller(fit(xs, ys, HIDDEN, epochs, seed, vary=varied))


def sampled(pages: DataFrame, html_col: str = "html", n: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> list[str]:
    """At most ``n`` different pages of at most ``most_bytes`` bytes, first in hash order. The part of the hash range to look at follows from the
    number of different pages, so a little over ``n`` are compared however many there are."""
    page = F.col(html_col)
    short = pages.select(page.alias("html"), F.xxhash64(page).alias("of")).where((F.octet_length(page) > 0) & (F.octet_length(page) <= most_bytes))
    kinds = short.agg(F.approx_count_distinct("of", 0.02)).first()[0]
    near = short.withColumn("place", F.pmod(F.xxhash64("of", F.lit("sample")), F.lit(1 << 30))).where(F.col("place") * F.lit(kinds) <= F.lit((1 << 30) * (1.25 * n + 64)))
    return [r["html"] for r in near.groupBy("place").agg(F.min("html").alias("html")).orderBy("place").limit(n).collect()]


def main_text(pages: DataFrame, labeller: Labeller | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars of every page; ``labeller`` is learned from a sample of ``pages`` where none is given."""
    labeller = labeller or learn_from(sampled(pages, html_col))
    sent = pages.sparkSession.sparkContext.broadcast(labeller)
    plain = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    found = annotated(plain, "html", "main", "text string", lambda texts: [sent.value.main_texts([t.decode("utf-8", "replace") for t in texts])])
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("main.text").alias("text"), F.length("main.text").cast("bigint").alias("n_chars"))
