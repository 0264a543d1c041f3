"""CSV folders of several header orders, and multi-line files read by many tasks."""

import csv
import datetime
import random
from pathlib import Path

import pytest

from barweave.sources import read_news, read_prices
from barweave.sources.csv_files import header_layouts, literal_path, plain_path, records


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "1"}
    keep = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in keep.items():
        spark.conf.set(k, v)


def body(rng):
    parts = ["plain text", 'said "yes"', "a, b", "line\nbreak", "two\n\nlines", "carriage\r\nreturn", '"', '""', "é€", "", " "]
    return "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 4, 30])))


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_multi_line_files_by_many_tasks(spark, tmp_path, small_splits, ending):
    rng = random.Random(1)
    for name, n in (("one.csv", 6000), ("sub dir/two x.csv", 50)):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        with open(path, "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator=ending, quoting=csv.QUOTE_ALL if n == 50 else csv.QUOTE_MINIMAL)
            out.writerow(["id", "Body", "note"])
            out.writerows([i, body(rng) + (ending.join(["x" * 50] * 2500) if i == 77 else ""), body(rng)] for i in range(n))
    files = [str(tmp_path / "one.csv"), literal_path(str(tmp_path / "sub dir/two x.csv"))]
    from pyspark.sql import functions as F
    rows = records(spark, files)
    got = rows.where("not first").select("file", F.from_csv("record", "id string, body string, note string", {"escape": '"', "multiLine": "true"}).alias("r"))
    got = sorted((r["file"], int(r["r"]["id"]), r["r"]["body"], r["r"]["note"]) for r in got.collect())
    want = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(files).select("*", plain_path(F.col("_metadata.file_path")).alias("f"))
    want = sorted((r["f"], int(r["id"]), r["Body"], r["note"]) for r in want.collect())
    assert len(got) == 6050 and got == want
    assert rows.where("first").count() == 2
    assert spark.read.text(files[0]).rdd.getNumPartitions() > 20


def test_each_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "aaa.csv").write_text("Date,Open,High,Low,Close,Adj Close,Volume\n2020-01-02,1,2,0.5,1.5,1.4,1000\n")
    (tmp_path / "b [x].csv").write_text("volume,date,close,low,high, open \n7,2020-01-03,4,3,5,2\nx,bad,4,3,5,2\n")
    (tmp_path / "c.csv").write_text("﻿Date,Open,High,Low,Close,Adj Close,Volume\r\n2020-01-04,1,2,0.5,1.5,1.4,1000\r\n")
    got = {r["entity"]: r for r in read_prices(spark, str(tmp_path)).collect()}
    assert got["AAA"].open == 1 and got["AAA"].adj_close == 1.4 and got["AAA"].volume == 1000
    assert (got["B [X]"].open, got["B [X]"].high, got["B [X]"].low, got["B [X]"].close, got["B [X]"].adj_close, got["B [X]"].volume) == (2, 5, 3, 4, None, 7)
    assert got["C"].date == datetime.date(2020, 1, 4) and got["C"].volume == 1000 and len(got) == 3
    assert sorted(len(files) for _, files in header_layouts(spark, str(tmp_path))) == [1, 2]
    (tmp_path / "broken.csv").write_text("Date,Open,High,Low,Volume\n")
    with pytest.raises(ValueError, match="close.*broken.csv"):
        read_prices(spark, str(tmp_path))


def test_news_columns_differ_by_file(spark, tmp_path):
    Path(tmp_path / "a.csv").write_text('Date,Article,Stock_symbol\n2020-01-02 10:00:00 UTC,"first\nsecond",abc\n')
    Path(tmp_path / "b.csv").write_text('Stock_symbol,Publisher,Date,Article\nxyz,p,2020-01-03 10:00:00 UTC,"one ""two"""\n,p,2020-01-03,lost\n')
    got = {r["entity"]: (r["body"], r["publisher"], r["title"]) for r in read_news(spark, str(tmp_path)).collect()}
    assert got == {"ABC": ("first\nsecond", None, None), "XYZ": ('one "two"', "p", None)}


def test_many_files_are_listed_by_few_tasks(spark, tmp_path):
    from barweave.sources import read_prices
    from barweave.sources.csv_files import LISTING
    for k in range(60):
        folder = tmp_path / f"entity=e{k}"
        folder.mkdir()
        (folder / "p.csv").write_text(f"date,open,high,low,close,adj close,volume\n2020-01-02,1,2,0.5,{k},1.4,100\n")
    was, seen = spark.conf.get(LISTING), []
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        rows = read_prices(spark, str(tmp_path), r"entity=([^/]+)/").collect()
        for job in tracker.getJobIdsForGroup("listing"):
            seen += [tracker.getStageInfo(s).numTasks for s in tracker.getJobInfo(job).stageIds if tracker.getStageInfo(s)]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r.entity: r.close for r in rows} == {f"E{k}": float(k) for k in range(60)}
    assert spark.conf.get(LISTING) == was and seen and max(seen) <= 4 * spark.sparkContext.defaultParallelism
