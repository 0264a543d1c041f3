"""Information-theoretic sanitisation of personal data, in DataFrame operations only.

Base spans are the leftmost non-overlapping matches of four patterns (e-mail, IP address, payment card, phone number). Each
distinct value is a protected entity. The terms of a document are its words outside e-mail addresses (the other kinds hold no
letters). Over the whole corpus, the different texts that hold an entity c, a term t or both give probabilities, and t discloses
the share D(c, t) = PMI(c; t) / IC(c) = 1 + ln p(c | t) / -ln p(c) of what is to know about c; -log2 p(c | t) bits stay unknown.

A term stands beside some entity in every text that holds one, so the first text they share says nothing. What decides is how
often the others confirm it: p(c | t) is estimated as (texts(c, t) - 1) / (texts(t) - 1 + ``PRIOR``). A term that leaves at most
``LEFT_TERM`` bits by this estimate is replaced by a placeholder, one that leaves at most ``LEFT_ERASE`` is removed; both limits
are on probabilities and do not move with the size of the corpus. Besides, the confirmations must beat chance: their number k
against the number e expected if texts with t held c as often as any text does must reach k ln(k / e) - k + e >= ln(terms(c) /
``CHANCE``), terms(c) being the words of the texts with c, all of which are tried. So words that stand with an entity in one text
only never count. t must occur in at least ``COVERAGE`` of the texts with c. In every document that holds c, each occurrence of
such a term goes.

Exact copies of a text that holds entities count once. Entities that stand in the same texts, and terms that do, are one class
(two 64-bit sums of the texts' hashes and their number): classes are paired, so a list of addresses repeated in several texts is
one class, not addresses times words.

Offsets come from the lengths of the matches and of the text between them, added up by doubling steps; texts are cut and joined
by blocks of ``BLOCK`` code points. So work on one text is n log n in its length and its number of spans. The patterns below are
the contract's patterns with possessive quantifiers and a guard against starting inside a run, which changes no match and keeps every scan linear.

Counts are combined map-side, so neither a frequent word nor a text with many copies meets in one task; frequent terms and
texts with many copies meet their rows by broadcast. Texts without personal data are not shuffled by key.

Defined results: null counts as empty, no spans; equal texts get equal answers whatever their ids; null ids are kept; other
columns, whatever their names, are kept by ``sanitised`` and not read by ``personal_data``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.llm.common import fresh, saved, spread_join

KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MARKS = {"email": "@", "ip": ".", "card": "0123456789", "phone": "+"}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
TERM = r"\p{L}{3,}+"
PRIOR = 1.0
COVERAGE = 0.5
LEFT_TERM = 1.0
LEFT_ERASE = 0.35
CHANCE = 0.01
BLOCK = 4096
SPAN = "struct<start: bigint, end: bigint>"


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum: every second digit from the right counts double, its digits added."""
    n = F.length(digits)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + F.when(
        (n - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(
        (2 * F.substring(digits, i, F.lit(1)).cast("int")) % 10 + F.floor(F.substring(digits, i, F.lit(1)).cast("int") / 5).cast("int")))
    return total % 10 == 0


def valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return F.rlike(found, F.lit(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it, also inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, merge: Callable[[Column, Column], Column], start: Column) -> Column:
    """Running totals of an array by ``merge``, with ``start`` as neutral element: element i joins the one 1, 2, 4, ... places before it."""

    def doubled(acc: Column, k: Column) -> Column:
        shift = F.pow(F.lit(2), k).cast("int")
        before = F.concat(F.array_repeat(start, F.least(shift, F.size(acc))), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - shift, F.lit(0))))
        return F.zip_with(acc, before, merge)

    steps = F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")
    return F.when(F.size(values) > 1, F.aggregate(F.sequence(F.lit(0), F.greatest(steps - 1, F.lit(0))), values, doubled)).otherwise(values)


def places(text: Column, pattern: str) -> Column:
    """Array of (start, end, found) of all matches, in code points."""

    def laid(found: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        parts = F.zip_with(between, found, lambda b, f: (F.length(b) + F.length(f)).cast("bigint"))
        return let(parts, lambda sizes: F.zip_with(found, running(sizes, lambda a, b: a + b, F.lit(0).cast("bigint")), lambda f, end: F.struct(
            (end - F.length(f)).alias("start"), end.alias("end"), f.alias("found"))))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), laid)


def base_spans(text: Column, kind: str) -> Column:
    """Valid matches of one kind; texts without any cost one scan."""
    pattern = PATTERNS[kind]
    some = F.rlike(text, F.lit(pattern))
    if kind in ("email", "phone"):
        some = F.contains(text, F.lit(MARKS[kind])) & some
    none = F.array().cast("array<struct<start:bigint,end:bigint,found:string>>")
    return F.when(some, F.filter(places(text, pattern), lambda s: valid(kind, s["found"]))).otherwise(none)


def entity(kind: str, found: Column) -> Column:
    """One spelling per protected value."""
    return F.lower(found) if kind in ("email", "ip") else F.regexp_replace(found, "[^0-9]", "")


def located(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with an array column for each kind."""
    text = whole(F.col(text_col))
    return docs.withColumns({f"pii_{k}": base_spans(text, k) for k in KINDS})


def entities() -> Column:
    """Distinct protected values over the spans of all kinds."""
    of = lambda kind: F.transform(F.col(f"pii_{kind}"), lambda s: F.concat(F.lit(f"{kind}:"), entity(kind, s["found"])))
    return F.array_distinct(F.concat(*[of(k) for k in KINDS]))


def masked(text: Column) -> Column:
    """``text`` with blanks in place of its e-mail addresses; other places stay."""
    pattern = PATTERNS["email"]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    blank = F.zip_with(F.split(text, pattern, -1), found, lambda b, f: F.concat(b, F.repeat(F.lit(" "), F.coalesce(F.length(f), F.lit(0)))))
    return F.when(F.contains(text, F.lit(MARKS["email"])) & F.rlike(text, F.lit(pattern)), F.array_join(blank, "")).otherwise(text)


def words(body: Column) -> Column:
    """Distinct terms of a masked text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(TERM), F.lit(0)), lambda w: F.lower(w)))


def text_set(key: str) -> list[Column]:
    """Aggregates that tell sets of texts apart: two sums of hashes without carry."""
    return [F.bit_xor(F.xxhash64(key)).alias("x1"), F.bit_xor(F.xxhash64(F.lit("second"), key)).alias("x2")]


def disclosures(docs: DataFrame, text_col: str, texts: DataFrame, prior: float, coverage: float, left: float,
                chance: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of classes that disclose: entity class (c1, c2, texts_c), term class (x1, x2, docs_t), disclosure, evident;
    (key, entity, c1, c2) of all entities seen in two texts or more; (key, term, x1, x2, docs_t) of the terms that may disclose
    any. ``texts`` are the distinct texts with entities; texts of ``docs`` without entities count by row."""
    n = docs.count() - (texts.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0))).first()[0])
    each = texts.select("key", F.size("terms").alias("tried"), F.explode("entities").alias("entity"))
    x1, x2 = text_set("key")
    c_sets = each.groupBy("entity").agg(F.count(F.lit(1)).alias("texts_c"), F.sum("tried").alias("tried_c"), x1.alias("c1"), x2.alias("c2"))
    c_sets = saved(c_sets.where(F.col("texts_c") >= 2), "values")
    listed = saved(spread_join(each.select("key", "entity"), c_sets, ["entity"], "texts_c"), "listed")
    c_class = ["c1", "c2", "texts_c", "tried_c"]

    t_docs = docs.select(F.explode(words(masked(whole(F.col(text_col))))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("docs_all"))
    near = texts.select("key", "copies", F.explode("terms").alias("term"))
    t_near = near.groupBy("term").agg(F.sum("copies").alias("docs_near"), F.count(F.lit(1)).alias("texts_near"), x1, x2).where(F.col("texts_near") >= 2)
    known = t_near.join(t_docs, "term").withColumn("docs_t", F.col("docs_all") - F.col("docs_near") + F.col("texts_near"))
    told = lambda both: (both - 1) / (F.col("docs_t") - 1 + float(prior))
    known = saved(known.where(told(F.col("texts_near")) >= 2.0**-left).select("term", "texts_near", "docs_t", "x1", "x2"), "terms")
    able = saved(spread_join(near.select("key", "term"), known, ["term"], "texts_near").select("key", "term", "x1", "x2", "docs_t"), "able")

    t_class = ["x1", "x2", "docs_t"]
    held, stands = listed.select("key", *c_class).distinct(), able.select("key", *t_class).distinct()
    pairs = held.join(stands, "key").groupBy(*c_class, *t_class).agg(F.count(F.lit(1)).alias("texts_ct"))
    again, expected = F.col("texts_ct") - 1, (F.col("docs_t") - 1) * F.col("texts_c") / F.lit(float(max(n, 1)))
    beats = again * F.ln(again / expected) - again + expected >= F.ln(F.col("tried_c") / F.lit(chance))
    pairs = pairs.withColumn("evident", told(F.col("texts_ct"))).where(
        (F.col("evident") >= 2.0**-left) & (again > 0) & (again > expected) & beats & (F.col("texts_ct") >= coverage * F.col("texts_c")))
    surprise = F.ln(n / F.col("texts_c"))
    known_share = F.when(surprise > 0, 1 + F.ln(F.col("texts_ct") / F.col("docs_t")) / surprise)
    return saved(pairs.select(*c_class, *t_class, known_share.alias("disclosure"), "evident"), "pairs"), listed, able


def occurrences(texts: DataFrame) -> DataFrame:
    """(key, term, start, end) of every word of the masked texts."""
    found = F.regexp_extract_all("body", F.lit(TERM), F.lit(0))
    parts = F.zip_with(F.slice(F.split("body", TERM, -1), 1, F.size(found)), found, lambda b, w: F.struct(F.length(b).alias("gap"), w.alias("word")))
    rows = texts.select("key", F.posexplode(parts).alias("nth", "part")).select("key", "nth", "part.*")
    end = F.sum(F.col("gap") + F.length("word")).over(Window.partitionBy("key").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("end", end).select("key", F.lower("word").alias("term"), (F.col("end") - F.length("word")).alias("start"), "end")


def searched(docs: DataFrame, text_col: str = "text", prior: float = PRIOR, coverage: float = COVERAGE, left_term: float = LEFT_TERM,
             left_erase: float = LEFT_ERASE, chance: float = CHANCE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Base spans of every row with the key of its text; copies and extra spans of each text with personal data; the disclosing
    pairs (entity, term, disclosure, evident)."""
    text = whole(F.col(text_col))
    found = located(docs.withColumn("key", F.md5(text)), text_col).withColumn("entities", entities())
    found = found.withColumn("body", F.when(F.size("entities") > 0, masked(text)))
    strip = lambda k: F.transform(F.col(f"pii_{k}"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k)
    found = saved(found.select("id", "key", "entities", "body", *[strip(k) for k in KINDS]), "pii")
    texts = found.where(F.size("entities") > 0).groupBy("key").agg(
        F.first("entities").alias("entities"), F.first("body").alias("body"), F.count(F.lit(1)).alias("copies"))
    texts = saved(texts.withColumn("terms", words(F.col("body"))), "texts")
    classes, listed, able = disclosures(docs, text_col, texts, prior, coverage, left_term, chance)
    hits = listed.select("key", "c1", "c2", "texts_c").distinct().join(classes, ["c1", "c2", "texts_c"]).select("key", "x1", "x2", "docs_t", "evident")
    hits = able.join(hits.groupBy("key", "x1", "x2", "docs_t").agg(F.max("evident").alias("evident")), ["key", "x1", "x2", "docs_t"])
    hits = saved(hits.select("key", "term", "evident"), "hits")
    kind = F.when(F.col("evident") >= 2.0**-left_erase, "erase").otherwise("term")
    extra = occurrences(texts.join(hits.select("key").distinct(), "key", "left_semi")).join(hits, ["key", "term"])
    extra = extra.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end", kind.alias("kind")))).alias("extra"))
    names = listed.select("entity", "c1", "c2", "texts_c").distinct().join(classes, ["c1", "c2", "texts_c"])
    pairs = names.join(able.select("term", "x1", "x2", "docs_t").distinct(), ["x1", "x2", "docs_t"]).select("entity", "term", "disclosure", "evident")
    return found, saved(texts.select("key", "copies").join(extra, "key", "left"), "extra"), pairs


def written(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: n_email, n_ip, n_card, n_phone, base_sha256 and all spans as text."""
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found, extra, _ = searched(plain, "text", **options)
    base = F.concat(*[written(F.col(k), k) for k in KINDS])
    more = [F.coalesce(written(of_kind("extra", k), k), F.array().cast("array<string>")) for k in ("term", "erase")]
    none = F.lit(None).cast(extra.schema["extra"].dataType)
    rows = spread_join(found.where(F.size("entities") > 0), extra, ["key"], "copies").drop("copies")
    return rows.unionByName(found.where(F.size("entities") == 0).withColumn("extra", none)).select(
        F.col("id").alias(id_col), *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, *more), ",").alias("spans"))


def replaced(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets ("erase": nothing); overlapping spans become one."""

    def cut(blocks: Column, start: Column, end: Column) -> Column:
        """Code points start..end of the text, read from the blocks that hold them."""
        first, last = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
        some = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
        return F.substring(some, (start - first * BLOCK + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))

    def filled(blocks: Column, ends: Column) -> Column:
        """Per span: the text since the furthest end before it, and its mark unless it lies inside an earlier span."""

        def one(s: Column, i: Column) -> Column:
            at = F.when(i > 0, F.element_at(ends, i)).otherwise(F.lit(0).cast("bigint"))
            mark = F.when(s["kind"] == "erase", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
            return F.when(s["start"] >= at, F.concat(cut(blocks, at, s["start"]), mark)).otherwise("")

        rest = cut(blocks, F.element_at(ends, -1), F.length(text).cast("bigint"))
        return F.concat(F.array_join(F.transform(spans, one), ""), rest)

    furthest = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b), F.lit(0).cast("bigint"))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return let(pieces, lambda blocks: let(furthest, lambda ends: filled(blocks, ends)))


def labelled(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def sanitised(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """All rows and columns of ``docs``, base and disclosing spans of the text replaced; other texts stay as they are."""
    _, extra, _ = searched(docs.select(F.lit(None).cast("bigint").alias("id"), F.col(text_col).alias("text")), "text", **options)
    text, key, spans, more, copies = F.col(text_col), *(fresh(docs, f"pii_{c}") for c in ("key", "spans", "extra", "copies"))
    tagged = F.concat(*[labelled(base_spans(whole(text), k), k) for k in KINDS])
    found = docs.withColumn(spans, tagged)
    held = found.where(F.size(spans) > 0).withColumn(key, F.md5(whole(text)))
    held = spread_join(held, extra.select(F.col("key").alias(key), F.col("copies").alias(copies), F.col("extra").alias(more)), [key], copies)
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")
    every = F.sort_array(F.concat(spans, F.coalesce(F.col(more), none)))
    clean = held.withColumn(spans, every).withColumn(text_col, replaced(text, F.col(spans))).select(*docs.columns)
    return clean.unionByName(found.where(F.size(spans) == 0).select(*docs.columns))
