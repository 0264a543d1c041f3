"""The keyed block audit: blocks cut by micro-batches, late rows, idle entities, and a stream that stops at a bad block."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from barweave.operators import quality as ql
from barweave.operators.sentiment import PROBS
from barweave.session import scratch_path
from barweave.streaming import audit_stream, latest_blocks
from barweave.streaming.audit import in_order

COLUMNS = "entity string, article_id long, ts timestamp, positive_prob double, negative_prob double, neutral_prob double"


def scored(n, seed, entities=("a", "b", "c")):
    """Rows of uneven entities: the first has most; some values unknown, some near uniform."""
    rng = np.random.default_rng(seed)
    p = rng.dirichlet([1, 1, 1], n)
    p[rng.random(n) < 0.3] = 1 / 3
    frame = pd.DataFrame({"entity": rng.choice(entities, n, p=[0.8, 0.15, 0.05]), "article_id": rng.permutation(n) - n // 2,
                          "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 5000, n)), "s"),
                          "positive_prob": p[:, 0], "negative_prob": p[:, 1], "neutral_prob": p[:, 2]})
    return frame.sort_values(["ts", "article_id"]).reset_index(drop=True)


def plain(frame):
    return [tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else None if isinstance(v, float) and math.isnan(v) else v for v in r)
            for r in frame.itertuples(index=False)]


def arrive(spark, frames, files=1):
    path = scratch_path(spark, "arrivals")
    for f in frames:
        spark.createDataFrame(plain(f), COLUMNS).coalesce(files).write.mode("append").parquet(path)
    return spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", files).parquet(path)


def run(spark, stream, **options):
    sink, progress = scratch_path(spark, "audit"), scratch_path(spark, "audit-progress")
    audit_stream(stream, sink, progress, **options).awaitTermination()
    return latest_blocks(spark.read.parquet(sink))


def test_blocks_run_through_micro_batches(spark):
    frame = scored(700, 1)
    frame.loc[frame.index % 17 == 0, "positive_prob"] = np.nan
    cuts = [0, 101, 102, 350, 700]
    got = run(spark, arrive(spark, [frame[a:b] for a, b in zip(cuts, cuts[1:])]), block=64).toPandas().set_index(["entity", "block"]).sort_index()
    want = ql.audit_blocks(spark.createDataFrame(plain(frame), COLUMNS), 64).toPandas().set_index(["entity", "block"]).sort_index()
    assert list(got.index) == list(want.index) and (got.n == want.n).all() and (got.late == 0).all()
    assert (got.closed == (got.n == 64)).all()
    for c in ("max_sum_error", "sd_positive", "uniform_share"):
        assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True)
    assert got.failures.map(list).tolist() == want.failures.map(list).tolist()


@pytest.mark.parametrize("times", [6, 10**6])
def test_rows_of_a_group_are_taken_by_time_and_tie(times):
    """Over chunks, with shared times and ties: the order of a stable sort of the whole group."""
    rng = np.random.default_rng(times)
    n = 60
    group = pd.DataFrame({"_us": rng.integers(0, times, n), "_tie": [f"{k:03d}" for k in rng.integers(0, 9, n)],
                          **{p: np.where(rng.random(n) < 0.1, np.nan, rng.random(n)) for p in PROBS}})
    want = group.sort_values(["_us", "_tie"], kind="stable")
    for cuts in ([0, n], [0, 1, 20, 20, n]):
        us, ids, probs = in_order([group[a:b] for a, b in zip(cuts, cuts[1:])])
        assert us.tolist() == want["_us"].tolist() and ids.tolist() == want["_tie"].tolist()
        assert np.array_equal(probs, want[list(PROBS)].to_numpy(), equal_nan=True)


def test_late_rows_are_counted_not_audited(spark):
    frame = scored(90, 2, ("a", "a", "a"))
    late = frame[10:15].assign(article_id=lambda f: f.article_id + 1000)
    got = run(spark, arrive(spark, [frame[:60], pd.concat([late, frame[60:]])]), block=40).toPandas().sort_values("block")
    assert got.n.tolist() == [40, 40, 10] and got.late.max() == 5


def test_an_idle_entity_closes_its_block(spark):
    frame = scored(40, 3, ("a", "a", "a"))
    later = scored(10, 4, ("b", "b", "b")).assign(ts=lambda f: f.ts + pd.Timedelta("2D"))
    last = later.assign(ts=lambda f: f.ts + pd.Timedelta("2D"), article_id=lambda f: f.article_id + 100)
    got = run(spark, arrive(spark, [frame, later, last]), block=64, idle="1 hour").toPandas().set_index("entity")
    assert got.loc["a", "closed"] and got.loc["a", "n"] == 40


def test_a_bad_block_stops_the_stream(spark):
    frame = scored(300, 5)
    frame.loc[100:, ["positive_prob", "negative_prob", "neutral_prob"]] = 0.9
    sink, progress = scratch_path(spark, "audit"), scratch_path(spark, "audit-progress")
    query = audit_stream(arrive(spark, [frame[:100], frame[100:200], frame[200:]]), sink, progress, block=32, halt=True)
    with pytest.raises(StreamingQueryException, match="AuditFailed.*block"):
        query.awaitTermination()
    found = spark.read.parquet(sink)
    assert found.where(F.col("closed") & (F.size("failures") > 0)).count() > 0
    assert found.agg(F.max("upto")).first()[0] < (frame.entity == "a").sum()  # the last arrivals were not read
