"""Numbers of a leaf block: hashed names of its tag path, hashed words, and a few measures of its text."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np

PATH, OWN, WORDS, MEASURES = 256, 128, 96, 9
WIDTH = PATH + OWN + WORDS + MEASURES
EMPTY_PATH = np.zeros(PATH + OWN, np.float32)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_STOPS = frozenset(".!?:;\"'”»)")


@lru_cache(1 << 16)
def slot(token: str, size: int) -> tuple[int, float]:
    """Bucket and sign of a token."""
    h = zlib.crc32(token.encode("utf-8", "replace"))
    return h % size, 1.0 if h >> 31 else -1.0


@lru_cache(1 << 14)
def names(tag: str, attributes: tuple[tuple[str, str], ...]) -> tuple[str, ...]:
    """The element's name and the words in its class, id and role, without plural endings."""
    words = {w.lower() for _, v in attributes for w in _PARTS.findall(v)}
    return (f"<{tag}>", *sorted({w[:-1] if len(w) > 3 and w.endswith("s") else w for w in words if len(w) > 1}))


def path_vector(above: np.ndarray, tag: str, attributes: dict[str, str]) -> np.ndarray:
    """The path's vector with one more element; the second part knows the innermost element only."""
    out = above.copy()
    out[PATH:] = 0
    for name in names(tag, tuple((k, v) for k, v in attributes.items() if k != "data-y")):
        k, sign = slot(name, PATH)
        out[k] = max(-2.0, min(2.0, out[k] + sign))
        k, sign = slot("own " + name, OWN)
        out[PATH + k] += sign
    return out


def leaf_vector(text: str, path: np.ndarray, linked: float, title: frozenset[str], place: float, out: np.ndarray) -> None:
    """Writes a block's numbers to ``out``; all words of the block count."""
    words = text.lower().split()
    out[:PATH + OWN] = path
    known = out[PATH + OWN:PATH + OWN + WORDS]
    in_title = 0
    for w, n in Counter(words).items():
        k, sign = slot(w.strip(".,;:!?()\"'"), WORDS)
        known[k] += sign * math.sqrt(n)
        if w in title:
            in_title += n
    known /= max(1.0, float(np.sqrt((known * known).sum())) / 2)
    n, chars = len(words), len(text)
    out[-MEASURES:] = (
        math.log1p(n) / 4, math.log1p(chars) / 6, linked, chars / n / 10 if n else 0, text[-1:] in _STOPS, sum(map(text.count, ".,;!?")) / max(n, 1),
        in_title / max(n, 1), place, 1 - place)
