import datetime
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from foliomill.llm import cooccur
from foliomill.llm.cooccur import PairTable, item_text
from foliomill.llm.reports import BASKETS, p1_incremental, p1_scores

SCHEMA = "before array<string>, after array<string>"


def table(spark, tmp_path):
    return PairTable(spark, f"file://{tmp_path}/pairs", buckets=4)


def counts(pairs):
    return {(r.a, r.b): r.n for r in pairs.counts().collect()}


def brute(baskets):
    n = Counter()
    for b in baskets:
        s = sorted({x for x in b or [] if x is not None})
        if s:
            n[(None, None)] += 1
        n.update({(x, None): 1 for x in s})
        n.update({p: 1 for p in combinations(s, 2)})
    return dict(n)


def test_increments_match_brute_force(spark, tmp_path):
    rng = random.Random(2)
    pairs = table(spark, tmp_path)
    now = {}
    for _ in range(4):
        changes = []
        for k in rng.sample(range(60), 30):
            new = rng.choice([None, [], [rng.choice("abcdef") for _ in range(rng.randint(1, 5))] + [None]])
            changes.append((now.get(k), new))
            now[k] = new
        pairs.merge(spark.createDataFrame(changes, SCHEMA))
        assert counts(pairs) == brute(now.values())


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    pairs = table(spark, tmp_path)
    pairs.merge(spark.createDataFrame([(None, [f"i{k}" for k in range(12)]), (None, ["i1"])], SCHEMA))
    before = pairs._manifest()["buckets"]
    delta = pairs.merge(spark.createDataFrame([(["i1"], ["i2"])], SCHEMA))
    after = pairs._manifest()["buckets"]
    assert 0 < sum(before[b] != after[b] for b in after) < len(after)
    hit = {(r.a, r.b) for r in pairs.scores(delta).collect()}
    every = set(combinations(sorted(f"i{k}" for k in range(12)), 2))
    assert hit == {p for p in every if "i1" in p or "i2" in p}
    delta = pairs.merge(spark.createDataFrame([(None, ["i1"])], SCHEMA))  # one basket more: every score changes
    assert {(r.a, r.b) for r in pairs.scores(delta).collect()} == every


@pytest.mark.parametrize("stop", ["write", "rename", "clean"])
def test_a_merge_that_stops_leaves_a_whole_state(spark, tmp_path, stop, monkeypatch):
    pairs = table(spark, tmp_path)
    pairs.merge(spark.createDataFrame([(None, ["a", "b"])], SCHEMA))
    old = counts(pairs)

    def fail(*_):
        if stop == "rename":  # the new manifest is written but not yet renamed
            pairs._fs.create(pairs._jpath(f"{pairs.path}/manifest.new"), True).close()
        raise OSError(stop)

    monkeypatch.setattr(pairs, "_clean" if stop == "clean" else "_commit", fail)
    with pytest.raises(OSError):
        pairs.merge(spark.createDataFrame([(None, ["a", "c"])], SCHEMA))
    monkeypatch.undo()
    again = table(spark, tmp_path)
    assert counts(again) == (old if stop != "clean" else brute([["a", "b"], ["a", "c"]]))
    again.merge(spark.createDataFrame([(None, ["b", "c"])], SCHEMA))
    assert counts(again) == brute([["a", "b"], ["b", "c"]] + [["a", "c"]] * (stop == "clean"))


def test_buckets_grow_and_old_files_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cooccur, "FILE_BYTES", 1 << 10)
    pairs, now = table(spark, tmp_path), []
    for k in range(5):
        fresh = [[f"i{j}" for j in range(k, k + 9)] for _ in range(2)]
        now += fresh
        pairs.merge(spark.createDataFrame([(None, b) for b in fresh], SCHEMA))
        assert counts(pairs) == brute(now)
    state = pairs._manifest()
    assert state["n"] > 4 and len(pairs._manifests()) == 2
    kept = {(p.name[7:], int(p.parent.name[4:])) for p in (tmp_path / "pairs").glob("gen=*/bucket=*")}
    assert set(state["buckets"].items()) <= kept and len(list((tmp_path / "pairs").glob("delta=*"))) == 2


def test_scores_and_empty(spark, tmp_path):
    pairs = table(spark, tmp_path)
    pairs.merge(spark.createDataFrame([], SCHEMA))
    assert counts(pairs) == {} and pairs.scores().count() == 0
    pairs.merge(spark.createDataFrame([(None, ["a", "b"]), (None, ["a", "b"]), (None, ["c"]), (None, None)], SCHEMA))
    r = pairs.scores().first()
    assert (r.a, r.b, r.n_ab, r.n_a, r.n_b, r.n, r.lift) == ("a", "b", 2, 2, 2, 3, 1.5)
    pairs.merge(spark.createDataFrame([(["a", "b"], None), (["a", "b"], None), (["c"], None)], SCHEMA))
    assert counts(pairs) == {}


def test_item_text(spark):
    rows = spark.createDataFrame([(" Changed-Text ",), ("changed text",), ("  ",), (None,)], "c string").select(item_text(F.col("c"))).collect()
    assert [r[0] for r in rows] == ["changed_text", "changed_text", None, None]


def test_rescored_as_from_all_counts(spark, tmp_path):
    pairs = table(spark, tmp_path)
    pairs.merge(spark.createDataFrame([(None, ["a", "b"]), (None, ["c", "d"]), (None, ["a", "c"]), (None, ["b", "d"])], SCHEMA))
    changes = [([(["a", "b"], ["a", "d"])], "same number of baskets"), ([(None, ["a", "b"])], "one more"), ([(["c", "d"], None), (["a", "b"], None)], "fewer")]
    for k, (change, _) in enumerate(changes):
        pairs.scores().write.parquet(f"{tmp_path}/old{k}")
        delta = pairs.merge(spark.createDataFrame(change, SCHEMA))
        got = pairs.rescore(spark.read.parquet(f"{tmp_path}/old{k}"), delta)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.scores().collect()))


def test_incremental_with_null_times(spark, tmp_path):
    day = lambda k: datetime.datetime(2024, 1, k)
    of = lambda *c: [([(list(c), None)],)]
    rows = [("r1", None, of("a", "b")), ("r2", None, of("a", "c")), ("r2", day(3), of("a", "b")), ("r3", day(1), of("b", "c")), ("r4", day(3), of("a", "c"))]
    spark.createDataFrame(rows, BASKETS).write.parquet(f"{tmp_path}/reports.parquet")
    got = sorted(map(tuple, p1_incremental(spark, str(tmp_path)).collect()))
    assert got == sorted(map(tuple, p1_scores(spark, str(tmp_path)).collect())) and [r[:3] for r in got] == [("a", "b", 2), ("a", "c", 1), ("b", "c", 1)]
