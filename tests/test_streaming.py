"""Several micro-batches give the batch result."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from scrollwork.functions import ordered
from scrollwork.operators import actions, log
from scrollwork.streaming import jobs as S, keyed


def span():
    return ordered.steps("turn_no", 50)


def feed(spark, folder, rows, schema, parts):
    """Write the rows as one file per micro-batch, in order of arrival."""
    n = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * n : (i + 1) * n], schema).coalesce(1).write.mode("append").parquet(folder)
    return S.read_log(spark, folder, spark.read.parquet(folder).schema, 1)


def wait(q):
    q.awaitTermination()
    assert q.exception() is None


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    return [(rng.choice([1, 1, 1, 2]), n, rng.randint(-3, 3), rng.choice(["failure", "success", None, "failure"])) for n in range(200)]


SCHEMA = "campaign_id long, turn_no long, delta long, outcome string"


def out(spark, path):
    return spark.read.parquet(f"{path}/out/rows")


def test_counters(spark, tmp_path, rows):
    src = feed(spark, str(tmp_path / "in"), rows, SCHEMA, 4)
    ch = lambda d: d.select("campaign_id", F.lit("heat").alias("counter"), "turn_no", "delta", F.when(F.col("delta") == 0, 5).cast("long").alias("set_value"))
    init = spark.createDataFrame([(1, "heat", 2, 6), (2, "heat", 0, 6), (9, "heat", 1, 1)], "campaign_id long, counter string, value long, max long")
    path = str(tmp_path / "out")
    wait(keyed.append_to(keyed.counters(ch(src), init, ["turn_no"]), path, 3))
    want = log.counter_steps(init, ch(spark.createDataFrame([*rows, (7, 1, 1, None)], SCHEMA)), ["turn_no"], span())  # 7 has no counter
    key = lambda d: sorted((r.turn_no, r.old_value, r.new_value) for r in d.collect())
    assert key(out(spark, path)) == key(want)


def test_a_query_goes_on_from_its_checkpoint(spark, tmp_path, rows):
    """Streaks over two runs of the query; rows arrive out of order inside a batch."""
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:90][::-1], rows[90:]):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(folder)
        wait(keyed.append_to(keyed.streaks(S.read_log(spark, folder, spark.read.parquet(folder).schema), ["turn_no"]), path, 3))
    n, want = {}, {}
    for c, t, _, o in rows:
        n[c] = 0 if o == "success" else n.get(c, 0) + (o == "failure")
        if o == "failure":
            want[t] = n[c]
    got = out(spark, path).collect()
    assert {r.turn_no: r.streak for r in got} == want
    assert all(r.alert == ("threat_resolved" if r.streak >= 3 else "warning" if r.streak == 2 else None) for r in got)
    assert spark.conf.get(keyed.PROVIDER) != keyed.ROCKS  # the session keeps its own settings


BASE = dt.datetime(2024, 1, 1)


def test_situations(spark, tmp_path, rows):
    acts = lambda d: d.filter("outcome is not null").select(
        "campaign_id", "turn_no", F.timestamp_seconds(F.col("turn_no") * 60).alias("ts"), F.when(F.col("outcome") == "failure", "sneak").otherwise("hide").alias("action"), "outcome", F.when(F.col("delta") > 2, 2).otherwise(0).alias("tier")
    )
    src = feed(spark, str(tmp_path / "in"), rows, SCHEMA, 4)
    path = str(tmp_path / "out")
    wait(keyed.append_to(keyed.situations(acts(src), "ts", "turn_no"), path, 3))
    want = actions.situation_intervals(acts(spark.createDataFrame(rows, SCHEMA)), ["turn_no"], span()).filter("closed is not null and condition = 'exposed'")
    got = out(spark, path).filter("condition = 'exposed'")
    assert sorted((r.opened, r.closed, r.hard) for r in got.collect()) == sorted((r.opened.turn_no, r.closed.turn_no, r.hard) for r in want.collect())


def test_timeouts(spark, tmp_path):
    """Campaign 1 times out by a later row, 2 by the watermark alone, 3 is cleared in time, 4 stays open; 5's ending comes behind the watermark and counts."""
    hour = lambda h: BASE + dt.timedelta(hours=h)
    rows = [(1, 0, hour(0), "failure"), (2, 1, hour(1), "failure"), (3, 2, hour(2), "failure"), (5, 3, hour(9), "failure"), (3, 4, hour(3), "success"), (1, 5, hour(11), "success"), (4, 6, hour(16), "failure"), (5, 7, hour(10), "success")]
    src = feed(spark, str(tmp_path / "in"), rows, "campaign_id long, turn_no long, ts timestamp, outcome string", 8)
    acts = src.select("campaign_id", "turn_no", "ts", "outcome", F.when(F.col("outcome") == "failure", "sneak").otherwise("hide").alias("action"), F.lit(0).alias("tier"))
    path = str(tmp_path / "out")
    wait(keyed.append_to(keyed.situations(acts, "ts", "turn_no", "4 hours", 8 * 3600), path, 2))
    got = sorted((r.campaign_id, r.opened, r.closed, r.reason) for r in out(spark, path).filter("condition = 'exposed'").collect())
    assert got == [(1, 0, None, "timeout"), (2, 1, None, "timeout"), (3, 2, 4, "cleared"), (5, 3, 7, "cleared")]


def test_late_rows(spark, tmp_path):
    hours = [0, 1, 2, 3, 9, 8, 10, 1, 20, 19, 30, 29]
    rows = [(k % 2, i, BASE + dt.timedelta(hours=h, microseconds=k)) for k in range(2) for i, h in enumerate(hours)]
    rows.sort(key=lambda r: r[1])
    src = feed(spark, str(tmp_path / "in"), rows, "campaign_id long, id long, ts timestamp", 6)
    path = str(tmp_path / "out")
    wait(keyed.append_to(keyed.release(src, "ts", "4 hours", ["id"]), path, 2))
    got = out(spark, path).collect()
    for c in range(2):
        released = sorted((r.place, r.id) for r in got if r.campaign_id == c and r.part == "released")
        assert released == list(enumerate([0, 1, 2, 3, 5, 4, 6, 9, 8], 1))
        assert [r.id for r in got if r.campaign_id == c and r.part == "rejected"] == [7]
    assert {r.id for r in got if r.reordered} == set()  # 5 and 9 came in the batch of 4 and 8


def test_rows_that_a_later_batch_brings_are_reordered(spark, tmp_path):
    rows = [(1, i, BASE + dt.timedelta(hours=h)) for i, h in enumerate([5, 3, 4, 30])]
    src = feed(spark, str(tmp_path / "in"), rows, "campaign_id long, id long, ts timestamp", 4)
    path = str(tmp_path / "out")
    wait(keyed.append_to(keyed.release(src, "ts", "4 hours", ["id"]), path, 1))
    assert sorted((r.place, r.id, r.reordered) for r in out(spark, path).collect()) == [(1, 1, True), (2, 2, True), (3, 0, False)]


def test_latest(spark, tmp_path):
    rows = [(1, "a", 1, 0.5), (2, "a", 2, None), (1, "b", 3, 1.0), (1, "a", 0, 9.0), (2, "a", 5, 2.0), (1, "a", 7, None)]
    src = feed(spark, str(tmp_path / "in"), rows, "campaign_id long, kind string, n long, value double", 3)
    path = str(tmp_path / "out")
    wait(keyed.append_to(keyed.latest(src, ["campaign_id", "kind"], ["n"]), path, 2))
    changes = out(spark, path)
    assert changes.count() == 5  # the older row of (1, a) changes nothing
    assert sorted(map(tuple, keyed.newest(changes, ["campaign_id", "kind"], ["n"]).collect())) == [(1, "a", 7, None), (1, "b", 3, 1.0), (2, "a", 5, 2.0)]


def test_changed_windows_only(spark, tmp_path):
    rows = [(k, BASE + dt.timedelta(hours=h), "x") for k, h in enumerate([0, 1, 30, 2, 31])]
    src = feed(spark, str(tmp_path / "in"), rows, "id long, ts timestamp, event_type string", 5)
    path = str(tmp_path / "out")
    wait(S.upsert_changes(S.type_counts(src, "ts", "1 day", late="3 days"), path))
    assert spark.read.parquet(f"{path}/out/changes").count() == 5  # one window a batch
    got = S.read_changes(spark, path, ["started", "ended", "event_type"]).orderBy("started").collect()
    assert [r.events for r in got] == [3, 2]


def test_keys_of_one_bucket_stay_apart(spark, tmp_path, monkeypatch):
    """Fifty keys and a null one in two groups; whole numbers beyond 2^53 stay whole beside nulls."""
    monkeypatch.setattr(keyed, "BUCKETS", 2, raising=False)
    rows = [(k if k < 50 else None, n, None if (k + n) % 3 == 0 else 2**60 + 51 * n + k) for n in range(4) for k in range(51)]
    src = feed(spark, str(tmp_path / "in"), rows, "campaign_id long, n long, value long", 2)
    changes = keyed.latest(src, ["campaign_id"], ["n"])
    assert "bucket_" in changes._jdf.queryExecution().analyzed().toString()  # a group a key costs milliseconds each
    path = str(tmp_path / "out")
    wait(keyed.append_to(changes, path, 2))
    got = out(spark, path)
    assert got.count() == 2 * 51
    assert sorted(map(tuple, keyed.newest(got, ["campaign_id"], ["n"]).collect()), key=repr) == sorted((r for r in rows if r[1] == 3), key=repr)


def test_late_rows_of_campaigns_that_share_a_group(spark, tmp_path, monkeypatch):
    """Campaigns are dealt to groups, each with one timer; their rows, counts and latest times stay apart."""
    monkeypatch.setattr(keyed, "BUCKETS", 1)
    hours = {1: [0, 5, 3, 20, 30], 2: [2, 9, 1, 21, 31], None: [1, 4, 6, 22, 32]}
    rows = [(c, 10 * (c or 0) + i, BASE + dt.timedelta(hours=h)) for i in range(5) for c, h in ((c, hs[i]) for c, hs in hours.items())]
    src = feed(spark, str(tmp_path / "in"), rows, "campaign_id long, id long, ts timestamp", 5)
    held = keyed.release(src, "ts", "4 hours", ["id"])
    assert "bucket_" in held._jdf.queryExecution().analyzed().toString()
    path = str(tmp_path / "out")
    wait(keyed.append_to(held, path, 1))
    got = {(r.campaign_id, r.id): (r.part, r.place, r.reordered, r.ts) for r in out(spark, path).collect()}
    want = {}
    for c, hs in hours.items():  # batch 2 comes behind a watermark of 5 hours
        kept = sorted((h, i) for i, h in enumerate(hs) if i != 2 or h >= 5)
        for place, (h, i) in enumerate(kept[:-1], 1):  # the last one still waits
            want[c, 10 * (c or 0) + i] = ("released", place, False, BASE + dt.timedelta(hours=h))
        if hs[2] < 5:
            want[c, 10 * (c or 0) + 2] = ("rejected", None, False, BASE + dt.timedelta(hours=hs[2]))
    assert got == want
