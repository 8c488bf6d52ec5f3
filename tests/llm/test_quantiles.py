import math
import random

import pytest
from pyspark.sql import functions as F

from foliomill.llm import quantiles as q

QS = [0.1, 0.5, 0.9, 1.0]


def data(spark, n=3000, seed=1):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        g = rng.choice(["hot", "hot", "hot", "x", None])
        v = rng.choice([rng.gauss(0, 50), float(rng.randint(0, 3)), math.exp(rng.gauss(3, 3)), None, float("nan"), float("inf"), float("-inf"), 0.0])
        rows.append((g, v, "clash", 7))
    rows.append(("one", 5.0, "clash", 7))
    rows.append(("none", None, "clash", 7))
    return spark.createDataFrame(rows, "grp string, val double, g string, n int").repartition(5), rows


def exact(rows):
    groups = {}
    for g, v, *_ in rows:
        if v is not None and not math.isnan(v):
            groups.setdefault(g, []).append(v)
    return {g: [sorted(vs)[max(1, math.ceil(p * len(vs) - 1e-9)) - 1] for p in QS] for g, vs in groups.items()}


@pytest.mark.parametrize("direct", [5, 100_000])
def test_multi_select_is_exact(spark, direct):
    df, rows = data(spark)
    out = q.multi_select(df.select("grp", "val"), ["grp"], "val", QS, direct=direct).collect()
    assert {r.grp: [r.q10, r.q50, r.q90, r.q100] for r in out} == exact(rows)


def test_multi_select_of_equal_values_and_nothing(spark):
    df = spark.range(500).select(F.lit("a").alias("grp"), F.lit(3.0).alias("val"))
    assert q.multi_select(df, ["grp"], "val", [0.5], direct=10).first().q50 == 3.0
    assert q.multi_select(df.limit(0), ["grp"], "val", [0.5]).count() == 0


def test_sketches_merge_within_their_error(spark):
    df, rows = data(spark, seed=4)
    df = df.where("not (val in (double('inf'), double('-inf')))")
    rows = [r for r in rows if r[1] is None or not math.isinf(r[1])]
    a, b = df.where("pmod(hash(val), 2) = 0"), df.where("pmod(hash(val), 2) = 1 or val is null")
    both = q.merge(q.sketch(a, ["grp"], "val").unionByName(q.sketch(b, ["grp"], "val")), ["grp"])
    got = {r.grp: [r.q10, r.q50, r.q90, r.q100] for r in q.sketch_percentiles(both, ["grp"], QS).collect()}
    want = exact(rows)
    assert got.keys() == want.keys()
    for g in want:
        for x, y in zip(got[g], want[g]):
            assert abs(x - y) <= 0.0101 * abs(y)
