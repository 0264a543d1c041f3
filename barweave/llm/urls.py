"""URL filter with a path-template tree per host.

1. Paths are counted per (host, path). Node by node, a segment keeps its text if its node has few children or the segment
   holds a fair share of the node's pages; else its shape (digit runs as ``#``) if that does; else it becomes ``*``. What all
   paths of a node have in common, and the rest of a path that is alone in its node, is taken in one step, so the rounds follow
   the branchings along a path and not its depth, which has no limit.
2. Branches that differ in one segment only and whose labelled shares of bad pages are statistically alike (two standard errors
   of the pooled share), or that have no label, merge into ``*``, deepest segment first.
3. A template is rejected when its smoothed labelled purity (bad + A * prior) / (labelled + A) reaches ``CUT``.

Fixed rules by host and path go first; the longest that fits decides. All statistics are sums that combine map-side. Nodes,
templates and paths with very many rows meet these by broadcast (they are few by definition), so neither a host nor a path, nor
the pages without any url, with a third of all pages gathers in one task.

Defined results: a null url, or one without "://", has empty host and path and is judged by the template of the empty path;
repeated rows get equal answers; without labels every template is allowed; paths of any depth are compared whole; an empty table gives
no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barweave.llm.common import saved, spread_join

BRANCH = 8
#: Segments taken one by one before what the paths of a node share is taken at once; no result depends on it.
LEVELS = 6
SHARE = 20
ERRORS = 2.0
WEIGHT = 4.0
CUT = 0.5


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule (host, path, verdict) that fits, else null."""
    text = verdict = F.lit(None).cast("string")
    for h, p, answer in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(answer)).otherwise(verdict)
    return text, verdict


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    unlike = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int")
    return F.when(unlike > 0, unlike - 1).otherwise(F.size(a))


def leapt(active: DataFrame) -> DataFrame:
    """``active`` paths moved on by what all paths of their node have in common; a path alone in its node to its end."""
    rest = F.slice("segments", F.size("labels") + 1, F.size("segments") - F.size("labels"))
    rows = active.withColumn("rest", rest)
    nodes = rows.groupBy("host", "node").agg(F.count(F.lit(1)).alias("paths"), F.min("rest").alias("least"), F.max("rest").alias("most"))
    nodes = nodes.select("host", "node", "paths", F.when(F.col("paths") > 1, common_prefix(F.col("least"), F.col("most"))).alias("shared"))
    known = F.when(F.col("shared").isNull(), F.col("rest")).otherwise(F.slice("rest", F.lit(1), F.col("shared")))
    moved = spread_join(rows, nodes, ["host", "node"], "paths").withColumn("labels", F.concat("labels", known))
    return saved(moved.withColumn("node", F.concat_ws("/", "labels")).select(*active.columns), "ahead")


def grown(paths: DataFrame, branch: int = BRANCH, share: int = SHARE) -> DataFrame:
    """``paths`` (host, path, n, ...) with ``labels``, the template's segments."""
    parts, none = F.filter(F.split("path", "/"), lambda s: s != ""), F.array().cast("array<string>")
    rows = saved(paths.withColumns({"segments": parts, "labels": none}), "paths")
    given = rows.columns
    grows = F.size("labels") < F.size("segments")
    finished = rows.where(~grows)
    level = 0
    while not (active := rows.where(grows)).isEmpty():
        active = active.withColumn("node", F.concat_ws("/", "labels"))
        if level >= LEVELS:
            active = leapt(active)
        ahead = active.withColumn("segment", F.get("segments", F.size("labels")))
        level += 1
        open_rows = ahead.where(F.col("segment").isNotNull())
        each = open_rows.groupBy("host", "node", "segment").agg(F.sum("n").alias("n_segment"), F.count(F.lit(1)).alias("paths"))
        each = saved(each.withColumn("shape", F.regexp_replace("segment", "[0-9]+", "#")), "segments")
        whole = each.groupBy("host", "node").agg(F.sum("n_segment").alias("n_node"), F.count(F.lit(1)).alias("children"))
        shapes = each.groupBy("host", "node", "shape").agg(F.sum("n_segment").alias("n_shape"), F.count(F.lit(1)).alias("alike"))
        placed = saved(spread_join(each, whole, ["host", "node"], "children"), "placed")
        named = spread_join(placed, shapes, ["host", "node", "shape"], "alike").select(
            "host", "node", "segment", "paths", F.when((F.col("children") <= branch) | (share * F.col("n_segment") >= F.col("n_node")), F.col("segment")).when(
                share * F.col("n_shape") >= F.col("n_node"), F.col("shape")).otherwise("*").alias("label"))
        named = saved(named, "names")
        stepped = spread_join(open_rows, named, ["host", "node", "segment"], "paths").withColumn("labels", F.concat("labels", F.array("label")))
        finished = finished.unionByName(ahead.where(F.col("segment").isNull()).select(*given))
        rows = saved(stepped.select(*given), "paths")
        finished = finished.unionByName(rows.where(~grows))
    return finished.drop("segments")


def branching_depths(trees: DataFrame) -> list[int]:
    """Depths, deepest first, at which templates of one host with the same beginning go on differently; others cannot merge."""
    steps = trees.select("host", "template", F.explode(F.sequence(F.lit(0), F.size("template") - 1)).alias("d")).where(F.size("template") > 0)
    begun = steps.select("host", "d", F.xxhash64(F.slice("template", F.lit(1), F.col("d"))).alias("begin"), F.get("template", F.col("d")).alias("label")).distinct()
    split = begun.groupBy("host", "d", "begin").agg(F.count(F.lit(1)).alias("ways")).where(F.col("ways") > 1)
    return sorted((r["d"] for r in split.select("d").distinct().collect()), reverse=True)


def merged(rows: DataFrame, errors: float = ERRORS) -> DataFrame:
    """``rows`` with ``template``, their labels after similar branches have been merged."""
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
    trees = saved(rows.groupBy("host", "labels").agg(*sums, F.count(F.lit(1)).alias("paths")).withColumn("template", F.col("labels")), "templates")
    for d in branching_depths(trees):
        hole = F.concat(F.slice("template", 1, d), F.array(F.lit("*")), F.slice("template", F.lit(d + 2), F.greatest(F.size("template") - d - 1, F.lit(0))))
        trees = trees.withColumn("hole", F.when(F.size("template") > d, hole))
        kinds = trees.where(F.col("hole").isNotNull()).groupBy("host", "hole", "template").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
        pool = kinds.groupBy("host", "hole").agg(F.count(F.lit(1)).alias("branches"), F.sum("l").alias("pool_l"), F.sum("b").alias("pool_b"))
        p = (F.col("pool_b") + 0.5) / (F.col("pool_l") + 1.0)
        alike = (F.col("l") == 0) | (F.abs(F.col("b") / F.col("l") - p) <= errors * F.sqrt(p * (1 - p) / F.col("l")))
        kinds, pool = saved(kinds, "kinds"), saved(pool, "pools")
        joined = spread_join(kinds, pool, ["host", "hole"], "branches").where((F.col("branches") > 1) & alike).select("host", "template", F.col("hole").alias("into"))
        trees = saved(trees.drop("hole").join(joined, ["host", "template"], "left").withColumn(
            "template", F.coalesce("into", "template")).drop("into"), "templates")
    return spread_join(rows, trees.select("host", "labels", "template", "paths"), ["host", "labels"], "paths").drop("labels", "paths")


def judged(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url",
           weight: float = WEIGHT, cut: float = CUT) -> DataFrame:
    """One row per page: host, path, rule, verdict, template, purity. ``labels`` has (host, path, bad): 1 for a bad page, 0 for a
    good one."""
    host, path = parsed(F.col(url_col))
    seen = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    known = labels.groupBy("host", "path").agg(F.count("bad").alias("l"), F.sum("bad").alias("b"))
    paths = seen.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")).join(known, ["host", "path"], "left").select(
        "host", "path", "n", F.coalesce("l", F.lit(0)).cast("bigint").alias("labelled"), F.coalesce("b", F.lit(0)).cast("bigint").alias("bad"))
    rows = saved(merged(grown(paths)), "judged")
    sums = rows.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("paths"))
    prior = rows.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("labelled"), F.lit(0)) + 4)).alias("p")).first()["p"]
    purity = (F.col("bad") + weight * F.lit(prior)) / (F.col("labelled") + F.lit(weight))
    sums = saved(sums.select("host", "template", "paths", purity.alias("purity")), "purities")
    answers = saved(spread_join(rows.select("host", "path", "template", "n"), sums, ["host", "template"], "paths").drop("paths"), "answers")
    text, verdict = ruled(F.col("host"), F.col("path"), rules)
    return spread_join(seen, answers, ["host", "path"], "n").select(
        F.col("id").alias(id_col), "host", "path", text.alias("rule"),
        F.coalesce(verdict, F.when(F.col("purity") >= cut, "block").otherwise("allow")).alias("verdict"),
        F.concat(F.lit("/"), F.concat_ws("/", "template")).alias("template"), F.col("purity"))


def document_labels(pages: DataFrame, labels: DataFrame, url_col: str = "url") -> DataFrame:
    """(host, path, bad) of pages whose path names a labelled document: bad if its quality is 0 or it is toxic."""
    host, path = parsed(F.col(url_col))
    number = F.regexp_extract("path", r"/(\d{1,18})(?:[^\d/][^/]*)?/?$", 1)
    named = pages.select(host.alias("host"), path.alias("path")).distinct().withColumn("doc_id", F.when(number != "", number.cast("bigint")))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    return named.join(marks, "doc_id").select("host", "path", "bad")
