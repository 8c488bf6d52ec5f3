import random

import pytest
from pyspark.sql import functions as F

from foliomill.operators.prefix import running_before


@pytest.mark.parametrize("blocks", [1, 3, 1024])
def test_running_sums_against_brute_force(spark, blocks):
    rng = random.Random(blocks)
    rows = [(rng.choice(["hot", "hot", "hot", "x", None]), i, rng.choice([None, 1, 5, -2])) for i in rng.sample(range(-50, 400), 200)] + [("x", None, 3)]
    got = {(r.k, r.i): r.before for r in running_before(spark.createDataFrame(rows, "k string, i int, v int"), ["k"], ["i"], F.col("v"), blocks).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        total = 0
        for _, i, v in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0)):
            want[(k, i)] = total
            total += v or 0
    assert got == want
    assert running_before(spark.createDataFrame([], "k string, i int, v int"), ["k"], ["i"], F.col("v")).count() == 0
