"""Percentiles per group of very large columns: distributed multi-select and a mergeable summary.

``multi_select`` finds exact ranks.  Each task proposes the median of its share
of every open search, the weighted median of the proposals becomes the pivot, a
three-way count tells on which side the rank lies, and the values ruled out are
left behind.  Searches of all groups and ranks advance in the same jobs.  Once a
search has few values left, they are ranked directly.

``sketch`` keeps counts of logarithmic buckets per group.  Sketches of separate
files or days are merged by adding counts, and any percentile read from them
lies within the relative error the buckets were made for.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from foliomill.session import Shelf

#: A search with at most so many values left is ranked in one window.
DIRECT = 32

#: The values still in question; a null bound is open.
_INSIDE = "(lo is null or v > lo) and (hi is null or v < hi)"


def _rank(q: float) -> F.Column:
    return F.greatest(F.ceil(F.lit(q) * F.col("n") - F.lit(1e-9)).cast("long"), F.lit(1).cast("long"))


def multi_select(values: DataFrame, groups: list[str], value: str, qs: list[float], direct: int = DIRECT) -> DataFrame:
    """groups, n, and for each q of qs the column ``q<100 q>``: the value at rank ceil(q n) of the group.

    Null and NaN values don't count; a group without values is left out; null
    group keys form groups of their own.  No group is gathered in one task.

    The values are written once, each with its group's number.  A round joins
    them to the open searches, whose number doesn't depend on that of the values,
    and keeps a value once per search it is still in question for; from the first
    pivots on these are a part of the values that shrinks by a factor per round.
    """
    spark = values.sparkSession
    shelf = Shelf(spark, "multiselect")
    key = F.xxhash64(F.to_json(F.struct(*groups)))
    v = F.col(value).cast("double")
    named = values.where(v.isNotNull() & ~F.isnan(v)).select(*groups, v.alias("v"))
    sizes = shelf.put(named.groupBy(*groups).agg(F.count("*").alias("n")).select(F.monotonically_increasing_id().alias("g"), key.alias("h"), *groups, "n"), "sizes")
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"x.{c}")) for c in groups]
    keyed = named.withColumn("h", key).alias("x").join(sizes.select("g", "h", *groups).alias("k"), [F.col("k.h") == F.col("x.h"), *same])
    vals = shelf.put(keyed.select("k.g", "x.v"), "values")
    none = F.lit(None).cast("double")
    search = sizes.select("g", "n", F.explode(F.array(*(F.struct(F.lit(i).alias("qi"), _rank(q).alias("k")) for i, q in enumerate(qs)))).alias("x")).select("g", "x.qi", "x.k", none.alias("lo"), none.alias("hi"), F.col("n").alias("left"), none.alias("found"))
    search, i = shelf.put(search, "search0"), 0
    done = [_direct(vals, search.where(F.col("left") <= direct), ["g"])]
    open_ = search.where(F.col("left") > direct)
    live = vals  # until the first pivots divide them, the values of a group are in question for all its searches alike
    while not open_.isEmpty():
        per = ["g"] if i == 0 else ["g", "qi"]
        if i:
            live = shelf.put(live.join(open_.select("g", "qi", "lo", "hi"), ["g"] if i == 1 else per).where(_INSIDE).select("g", "qi", "v"), f"live{i}")
        # proposals: the median of each task's share, weighted by its size
        local = (live if i else live.join(open_.select("g").distinct(), "g", "left_semi")).groupBy(F.spark_partition_id().alias("task"), *per).agg(F.percentile_approx("v", F.lit(0.5), F.lit(200)).alias("m"), F.count("*").alias("w"))
        sums = local.withColumn("c", F.sum("w").over(W.partitionBy(*per).orderBy("m", "task").rowsBetween(W.unboundedPreceding, 0))).withColumn("all", F.sum("w").over(W.partitionBy(*per)))
        pivot = shelf.put(sums.where("2 * c >= all").groupBy(*per).agg(F.min("m").alias("p")), f"pivot{i}")
        # three-way counts, combined in each task before the shuffle
        count = live.join(pivot, per).groupBy(*per, "p").agg(F.count_if(F.col("v") < F.col("p")).alias("lt"), F.count_if(F.col("v") == F.col("p")).alias("eq"), F.count("*").alias("all"))
        below, here = F.col("k") <= F.col("lt"), F.col("k") <= F.col("lt") + F.col("eq")
        nxt = open_.drop("left", "found").join(count, per).select(
            "g",
            "qi",
            F.when(here, F.col("k")).otherwise(F.col("k") - F.col("lt") - F.col("eq")).alias("k"),
            F.when(below, F.col("lo")).otherwise(F.col("p")).alias("lo"),
            F.when(below, F.col("p")).otherwise(F.col("hi")).alias("hi"),
            F.when(below, F.col("lt")).otherwise(F.col("all") - F.col("lt") - F.col("eq")).alias("left"),
            F.when(~below & here, F.col("p")).alias("found"),
        )
        i += 1
        search = shelf.put(nxt, f"search{i}")
        done.append(search.where("found is not null").select("g", "qi", F.col("found").alias("v")))
        done.append(_direct(live, search.where((F.col("left") <= direct) & F.col("found").isNull()), per))
        open_ = search.where((F.col("left") > direct) & F.col("found").isNull())
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    wide = found.groupBy("g").agg(*(F.max(F.when(F.col("qi") == j, F.col("v"))).alias(f"q{q * 100:g}".replace(".", "_")) for j, q in enumerate(qs)))
    return sizes.join(wide, "g").drop("g", "h")


def _direct(live: DataFrame, search: DataFrame, per: list[str]) -> DataFrame:
    """g, qi, v: the k-th smallest of the few values left in each search."""
    near = live.join(search.select("g", "qi", "k", "lo", "hi"), per).where(_INSIDE)
    return near.withColumn("at", F.row_number().over(W.partitionBy("g", "qi").orderBy("v"))).where("at = k").select("g", "qi", "v")


def sketch(values: DataFrame, groups: list[str], value: str, error: float = 0.01) -> DataFrame:
    """groups, sign, bucket, n: counts of logarithmic buckets; null and NaN values don't count.

    A bucket holds magnitudes in (g**(bucket-1), g**bucket] with g = (1+error)/(1-error);
    zeros, and magnitudes under 1e-300, have sign 0.
    """
    v = F.col(value).cast("double")
    size = F.abs(v)
    sign = F.when(size < 1e-300, F.lit(0)).otherwise(F.signum(v).cast("int"))
    step = math.log((1 + error) / (1 - error))
    bucket = F.when(sign == 0, F.lit(0)).otherwise(F.ceil(F.log(F.least(size, F.lit(1.7e308))) / F.lit(step))).cast("int")
    return values.where(v.isNotNull() & ~F.isnan(v)).groupBy(*groups, sign.alias("sign"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """Sketches of coarser groups, or of the union of several sketches."""
    return sketches.groupBy(*groups, "sign", "bucket").agg(F.sum("n").alias("n"))


def sketch_percentiles(sketches: DataFrame, groups: list[str], qs: list[float], error: float = 0.01) -> DataFrame:
    """groups, n and the column ``q<100 q>`` per q, each within the relative error of the exact rank's value.

    The windows run over a group's buckets, of which there are at most some
    thousands whatever the number of values.
    """
    g = (1 + error) / (1 - error)
    mid = F.when(F.col("sign") == 0, F.lit(0.0)).otherwise(F.col("sign") * F.lit(2 / (g + 1)) * F.pow(F.lit(g), F.col("bucket")))
    order = W.partitionBy(*groups).orderBy(F.col("sign") * F.col("bucket") + F.col("sign") * F.lit(1 << 24)).rowsBetween(W.unboundedPreceding, 0)
    cum = sketches.withColumn("mid", mid).withColumn("c", F.sum("n").over(order)).withColumn("all", F.sum("n").over(W.partitionBy(*groups)))
    return cum.groupBy(*groups).agg(F.max("all").alias("n"), *(F.min_by("mid", F.when(F.col("c") >= F.ceil(F.lit(q) * F.col("all") - F.lit(1e-9)), F.col("c"))).alias(f"q{q * 100:g}".replace(".", "_")) for q in qs))
