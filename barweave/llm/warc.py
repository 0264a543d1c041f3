"""WARC archives and their capture index.

Writing: each page becomes one WARC/1.1 record. Of pages with equal payloads of at least ``LEAST`` bytes, the one with the
largest id is a response, the others are revisits that refer to it; digests are compared, never payloads. A record is one text
value and the blank line after it is the separator of Spark's text writer, so the archives are
ordinary gzip-compressed WARC files on any store; offsets are those of the uncompressed archive.

Reading: archives are read as whole files (``FILE`` bytes aimed at), parsed record by record by Content-Length, and every
response's digest is checked. Each archive yields a run of index entries sorted by URL key and timestamp. The runs are dealt
by key range and merged in each range by a loser tree, which gives capture histories in global order. A range is cut inside a
URL too, so one URL with very many captures spreads.

Defined results: null html is an empty payload; a null url has no target header and an empty key; a null id has no id header
and reads back as null; rows repeated with the largest id of their group are all responses; control characters and blanks in a
url are percent-encoded.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.session import scratch_path

LEAST = 1000
FILE = 24 << 20
BREAK = "\r\n"
INDEX = ("page_id bigint, url_key string, timestamp string, archive string, offset bigint, record_bytes bigint, "
         "payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def stamp(seconds: Column) -> Column:
    """ISO time of a number of seconds after the start of 2024, whatever the session's zone."""
    day, rest = F.date_add(F.lit("2024-01-01").cast("date"), F.floor(seconds / 86400).cast("int")), seconds % 86400
    two = lambda c: F.lpad(c.cast("bigint").cast("string"), 2, "0")
    return F.concat(day.cast("string"), F.lit("T"), two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(rest / 60) % 60), F.lit(":"), two(rest % 60), F.lit("Z"))


def record_id(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def revisits(pages: DataFrame, least: int) -> DataFrame:
    """(id, digest, refers_to) of the pages whose payload another page with a larger id also has."""
    light = pages.where(F.octet_length("payload") >= least).select("id", "digest")
    groups = light.groupBy("digest").agg(F.max("id").alias("refers_to"), F.min("id").alias("first")).where(F.col("first") < F.col("refers_to"))
    return light.join(groups.drop("first"), "digest").where(F.col("id") < F.col("refers_to")).distinct()


def headers(*lines: tuple[str, Column | None]) -> Column:
    """Header block; a line whose value is null is left out."""
    parts = [F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(BREAK))) for name, value in lines]
    return F.concat_ws("", *parts)


def records(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int = LEAST) -> DataFrame:
    """(value): the text of one record per page, without the blank line that follows it."""
    plain = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    plain = plain.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    rows = plain.join(revisits(plain, least), ["id", "digest"], "left")
    size, old = F.octet_length("payload"), F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}"), headers(("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", size.cast("string"))), F.lit(BREAK))
    block = F.when(old, http).otherwise(F.concat(http, F.col("payload")))
    target = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7f]", "%20")
    head = headers(
        ("WARC-Type", F.when(old, "revisit").otherwise("response")), ("WARC-Record-ID", record_id(F.col("id"), F.col("digest"))),
        ("WARC-Target-URI", target), ("WARC-Date", stamp(F.pmod(F.coalesce("id", F.lit(0)), F.lit(10**9)))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        ("WARC-Refers-To", F.when(old, record_id(F.col("refers_to"), F.col("digest")))),
        ("WARC-Profile", F.when(old, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("X-Page-Id", F.col("id").cast("string")), ("X-Refers-To-Page", F.col("refers_to").cast("string")),
        ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", F.octet_length(block).cast("string")))
    return rows.select(F.concat(F.lit(f"WARC/1.1{BREAK}"), head, F.lit(BREAK), block).alias("value"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   least: int = LEAST, file_bytes: int = FILE) -> None:
    """WARC files below ``path`` of about ``file_bytes``, judged by the mean payload."""
    mean = pages.agg(F.avg(F.octet_length(html_col))).first()[0] or 0
    per_file = max(1, int(file_bytes / (mean + 600)))
    out = records(pages, id_col, url_col, html_col, least)
    out.write.option("lineSep", BREAK * 2).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(path)


def url_key(url: str | None) -> str:
    """Host labels from the right, then path and query, in lower case: example.org/a sorts with its subdomains."""
    if not url or "://" not in url:
        return (url or "").lower()
    rest = url.lower().partition("://")[2].partition("#")[0]
    cut = min((k for k in (rest.find(c) for c in "/?") if k >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].split("."))) + ")" + rest[cut:]


def parse(data: bytes) -> Iterator[tuple[int, int, dict, bytes]]:
    """(offset, length, headers, block) of every record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split(BREAK)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(line.split(": ", 1) for line in lines[1:])
        stop = end + 4 + int(head["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where it says")
        yield at, stop - at, head, data[end + 4 : stop]
        at = stop + 4


def entry(archive: str, offset: int, length: int, head: dict, block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    said = head["WARC-Payload-Digest"].partition(":")[2]
    size = int(next(x for x in http.decode().split(BREAK) if x.startswith("Content-Length: ")).partition(": ")[2])
    if head["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != said):
        raise ValueError(f"payload of {archive} at byte {offset} is damaged")
    page, refers = head.get("X-Page-Id"), head.get("X-Refers-To-Page")
    return (None if page is None else int(page), url_key(head.get("WARC-Target-URI")), head["WARC-Date"], archive, offset, length,
            size, said, head["WARC-Type"], None if refers is None else int(refers))


def order(row: tuple) -> tuple:
    return row[1], row[2], row[0] is None, row[0] or 0, row[3], row[4]


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


SCHEMA = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in INDEX.split(", "))])


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all archives below ``path``; those of one archive are a run sorted by URL key and timestamp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1)):
                archive, data = name.as_py().rsplit("/", 1)[-1], content.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                yield batch(sorted((entry(archive, *x) for x in parse(data)), key=order), SCHEMA)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, INDEX)


class LoserTree:
    """k-way merge: inner nodes keep the loser of their match, so the next winner needs one comparison a level."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at, k = runs, [0] * len(runs), len(runs)
        self.losers = [-1] * k
        self.winner = -1
        for r in range(k):
            self.play(r)

    def head(self, r: int) -> tuple:
        return (0, order(self.runs[r][self.at[r]]), r) if self.at[r] < len(self.runs[r]) else (1, (), r)

    def play(self, r: int) -> None:
        node = (r + len(self.runs)) // 2
        while node:
            other = self.losers[node]
            if other < 0:  # still being built: wait here for the opponent
                self.losers[node] = r
                return
            if self.head(other) < self.head(r):
                self.losers[node], r = r, other
            node //= 2
        self.winner = r

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and self.at[self.winner] < len(self.runs[self.winner]):
            r = self.winner
            yield self.runs[r][self.at[r]]
            self.at[r] += 1
            self.play(r)


def merged_index(runs: DataFrame, out_rows: int = 4096) -> DataFrame:
    """All entries in global order of URL key, timestamp and page: partition after partition, row after row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = {}
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                held.setdefault(row[3], []).append(row)
        for rows in held.values():  # entries of a run that the exchange delivered out of order
            if any(order(a) > order(b) for a, b in zip(rows, rows[1:])):
                rows.sort(key=order)
        buffer = []
        for row in LoserTree(list(held.values())):
            buffer.append(row)
            if len(buffer) == out_rows:
                yield batch(buffer, SCHEMA)
                buffer = []
        yield batch(buffer, SCHEMA)

    return runs.repartitionByRange("url_key", "timestamp", "page_id").mapInArrow(run, INDEX)


def capture_index(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", path: str | None = None, **options) -> DataFrame:
    """Write the archives, read them back and return their merged index."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "archives")
    write_archives(pages, path, id_col, url_col, html_col, **options)
    return merged_index(read_runs(spark, path))
