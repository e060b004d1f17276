"""A stream run to its end gives the batch result; late rows change nothing."""

import datetime as dt
import os
import random
import time

import pytest
from fieldmark.operators.ratings import RatingSpec, ordered_fold, replayed
from fieldmark.streaming.jobs import epochs, first_deliveries, hourly, keep_latest, rated_stream, run_now
from pyspark.sql import functions as F

GAMES = "game_id long, league long, game_date date, home long, away long, home_score long, away_score long"


def stream(spark, tmp_path, frames, schema):
    for i, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/b{i}")
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/b*")
    return raw


def test_ratings(spark, tmp_path):
    """Whatever the order in which files come, the late games' leagues are rated anew."""
    day = dt.date(2024, 1, 1)
    rows = [(i, i % 2, day + dt.timedelta(i), i % 5, (i + 1 + i % 3) % 5, i % 7, i % 4) for i in range(60)]
    spec = RatingSpec(novice=3, carry=0.8)
    games = spark.createDataFrame(rows, GAMES)
    want = {r.game_id: tuple(r) for r in ordered_fold(games, spec).collect()}
    out = str(tmp_path / "out")
    parts = [[r for r in rows if r[1] == 0 and r[0] < 30], [r for r in rows if r[0] >= 40], [r for r in rows if 30 <= r[0] < 40 or (r[1] == 1 and r[0] < 30)]]
    for i, part in enumerate(parts):  # one run a part: the second part comes before the third
        spark.createDataFrame(part, GAMES).coalesce(1).write.parquet(f"{tmp_path}/in/b{i}")
        scored = rated_stream(spark.readStream.schema(GAMES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/b*"), spec, "t", out)
    assert scored.where("p_home is null").count() > 0
    got = {r.game_id: tuple(r) for r in replayed(scored, games, spec).collect()}
    assert got == want


def test_goes_on_from_its_checkpoint(spark, tmp_path):
    out = str(tmp_path / "kept")
    for i, rows in enumerate([[("a", 1, 10), ("b", 5, 50)], [("a", 3, 30)], [("b", 2, 20), ("c", 1, 1)]]):
        spark.createDataFrame(rows, "k string, t int, v int").coalesce(1).write.parquet(f"{tmp_path}/in/b{i}")
        got = keep_latest(spark.readStream.schema("k string, t int, v int").parquet(f"{tmp_path}/in/b*"), ["k"], "t", "x", out)
    assert {(r.k, r.t, r.v) for r in got.collect()} == {("a", 3, 30), ("b", 5, 50), ("c", 1, 1)}
    assert epochs(spark, f"{out}/rows") == [] and len(epochs(spark, f"{out}/folded")) == 1  # batches' files don't pile up


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the given tables are not here")
def test_many_unsorted_files(spark, tmp_path):
    """Counts by hour and links over twenty files out of time order are those of the batch."""
    from fieldmark import registry

    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet").orderBy(F.xxhash64("event_id"))
    events.repartition(20).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("st_hourly_snapshot", "st_close_join", "st_dedup", "st_latest_quote", "src_incremental"):
        few, many = (sorted(map(tuple, registry.QUERIES[name](spark, at).collect())) for at in (sf, str(tmp_path)))
        assert few == many, name


def test_latest_wins(spark, tmp_path):
    rows = [[("a", 1, 10), ("b", 5, 50)], [("a", 3, 30), ("b", 2, 20)], [("a", 2, 99), (None, 1, 7)]]
    got = keep_latest(stream(spark, tmp_path, rows, "k string, t int, v int"), ["k"], "t", "latest")
    assert {(r.k, r.t, r.v) for r in got.collect()} == {("a", 3, 30), ("b", 5, 50), (None, 1, 7)}


def test_append(spark, tmp_path):
    got = run_now(stream(spark, tmp_path, [[(1,)], [(2,), (3,)]], "x int").where(F.col("x") > 1), "append")
    assert {r.x for r in got.collect()} == {2, 3}


def test_late_rows_are_folded_in_and_state_stays_small(spark, tmp_path):
    """Files out of time order, two a batch: what the watermark would drop comes from the gate's table, and few hours are open at a time."""
    rng = random.Random(1)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=10 * i + rng.randrange(9)), float(i % 17)) for i in range(1500)]
    files = [rows[i : i + 100] for i in range(0, 1500, 100)]
    files[3], files[9] = files[9], files[3]
    for i, part in enumerate(files):
        spark.createDataFrame(part, "id long, ts timestamp, value double").coalesce(1).write.parquet(f"{tmp_path}/in/b{i:02}")
        time.sleep(0.02)  # files are taken by age
    stream = spark.readStream.schema("id long, ts timestamp, value double").option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in/b*")
    seen = []
    got = {r.hour: (r.value, r.n) for r in hourly(stream, "ts", "value", "4 hours", "h", str(tmp_path / "out"), seen).collect()}
    want = {}
    for _, ts, v in sorted(rows, key=lambda r: r[1]):
        hour = ts.replace(minute=0, second=0)
        want[hour] = (v, want.get(hour, (0, 0))[1] + 1)
    assert got == want
    assert spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/out/late").count() > 0
    twice = stream.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery"))
    kept = first_deliveries(twice, ["id"], "ts", "4 hours", "d", str(tmp_path / "once"))
    assert sorted(r.id for r in kept.collect()) == [r[0] for r in rows]
    # a second run over the same folders has nothing to add; a new late file is folded in, and old hours have left the state
    more = [(9000 + i, start + dt.timedelta(minutes=i), 99.0) for i in range(5)] + [(9100, start + dt.timedelta(days=40), 1.0)]
    spark.createDataFrame(more, "id long, ts timestamp, value double").coalesce(1).write.parquet(f"{tmp_path}/in/b99")
    again = []
    after = {r.hour: r.n for r in hourly(stream, "ts", "value", "4 hours", "h", str(tmp_path / "out"), again).collect()}
    assert after[start] == want[start][1] + 5 and sum(after.values()) == 1506
    open_hours = [p["stateOperators"][0]["numRowsTotal"] for p in again if p["stateOperators"]]
    assert min(open_hours) < 20 < len(want)
