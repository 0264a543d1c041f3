"""String Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barweave.functions.maths import as_col

MIN_BODY = 50
# The characters that count as white space.
WHITE_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
               "\u2028\u2029\u202f\u205f\u3000")


def strip(col) -> Column:
    """Without white space of any kind at both ends."""
    return F.trim(as_col(col), F.lit(WHITE_SPACE))


def norm_symbol(col, trimmed: bool = True) -> Column:
    return F.upper(strip(col) if trimmed else as_col(col))


def text_source(title, body, min_body: int = MIN_BODY) -> Column:
    """'article' for a body longer than ``min_body`` once trimmed, else 'title', else 'empty'."""
    title, body = as_col(title), as_col(body)
    return (
        F.when(F.length(strip(body)) > min_body, "article")
        .when(F.length(strip(title)) > 0, "title")
        .otherwise("empty")
    )


def select_text(title, body, min_body: int = MIN_BODY) -> Column:
    """The body or the title, whole: white space decides which, but stays."""
    title, body = as_col(title), as_col(body)
    source = text_source(title, body, min_body)
    return F.when(source == "article", body).when(source == "title", title).otherwise("")
