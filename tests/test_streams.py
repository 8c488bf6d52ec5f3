from datetime import datetime

from foliomill import session
from foliomill.streaming import feeds


def test_usage_windows_take_late_rows(spark, tmp_path):
    day = lambda h, m=0: datetime(2020, 1, 1, h, m)
    rows = [(day(1, 5), "a", 1.0), (day(1, 50), "a", 2.5), (day(3), "b", None), (day(1, 7), "a", 0.25)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "ts timestamp_ntz, event_type string, value double").write.mode("append").parquet(str(tmp_path / "events"))
    got = {(r.window_start.hour, r.kind): (r.n, r.total) for r in feeds.usage_windows(spark, str(tmp_path / "events")).collect()}
    assert got == {(1, "a"): (3, 375), (3, "b"): (1, None)}


def test_latest_states(spark, tmp_path):
    rows = [("x", 1, "queued"), ("x", 3, "complete"), ("y", 2, None), ("x", 2, "restoring"), (None, 9, "lost")]
    for r in rows:
        spark.createDataFrame([r], "id string, at int, status string").write.mode("append").parquet(str(tmp_path / "runs"))
    got = {r.key: r.status for r in feeds.latest_states(spark, str(tmp_path / "runs"), "id", ["at"], ["status"]).collect()}
    assert got == {"x": "complete", "y": None}


def test_a_second_start_goes_on_with_late_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feeds, "COMPACT", 2)
    day = lambda d, h: datetime(2020, 1, d, h)
    events, place = str(tmp_path / "events"), f"file://{tmp_path}/place"
    read = []
    add = feeds.Ledger.add
    monkeypatch.setattr(feeds.Ledger, "add", lambda self, rows, number: (read.append(number), add(self, rows, number))[1])
    want = {}
    for step, rows in enumerate([[(day(20, 1), "a", 1.0)], [(day(1, 1), "a", 2.0), (day(20, 1), "a", 0.5), (None, "a", 9.0)], [], [(day(1, 1), "a", None)], [(day(2, 5), "b", 1.0)], [(day(20, 1), "a", 1.0)]]):
        if rows:
            spark.createDataFrame(rows, "ts timestamp_ntz, event_type string, value double").coalesce(1).write.mode("append").parquet(events)
        for ts, kind, value in rows:
            if ts:
                n, total = want.get((ts, kind), (0, None))
                want[(ts, kind)] = (n + 1, total if value is None else (total or 0) + round(value * 100))
        before = len(read)
        got = {(r.window_start, r.kind): (r.n, r.total) for r in feeds.usage_windows(spark, events, place).collect()}
        assert got == want and len(read) - before == bool(rows), step  # only what is new was read


def test_states_go_on(spark, tmp_path):
    runs, place = str(tmp_path / "runs"), f"file://{tmp_path}/place"
    for rows, want in (([("x", 3, "complete")], {"x": "complete"}), ([("x", 1, "queued"), ("y", 1, "queued")], {"x": "complete", "y": "queued"}), ([("y", 2, "failed")], {"x": "complete", "y": "failed"})):
        spark.createDataFrame(rows, "id string, at int, status string").coalesce(1).write.mode("append").parquet(runs)
        assert {r.key: r.status for r in feeds.latest_states(spark, runs, "id", ["at"], ["status"], place).collect()} == want


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    merge = lambda x: x.groupBy("k").agg({"n": "sum"}).toDF("k", "n")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long")
    ledger = feeds.Ledger(spark, f"file://{tmp_path}/l", rows.schema, merge)
    assert ledger.read().count() == 0
    ledger.add(rows, 0)
    ledger.add(rows, 1)
    ledger.add(rows, 1)
    assert {tuple(r) for r in ledger.read().collect()} == {("a", 2), ("b", 4)}


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Conf(dict):
        set = dict.__setitem__

    class Cluster:
        conf, sparkContext = Conf(), type("Context", (), {"master": "spark://host:7077"})

    try:
        session.shared_dir(Cluster())
    except RuntimeError as e:
        assert "spark.checkpoint.dir" in str(e)
    else:
        raise AssertionError("no error")
    Cluster.conf["spark.checkpoint.dir"] = "hdfs:///shared/"
    assert session.shared_dir(Cluster()) == "hdfs:///shared"
