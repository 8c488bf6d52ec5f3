"""Queries on delivery reports: categories that appear together, percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm import quantiles
from foliomill.llm.cooccur import PairTable, item_set, item_text
from foliomill.plans.records import latest
from foliomill.session import Shelf

#: The leaves that are read for the baskets.
BASKETS = "run_id string, received_at timestamp, pages array<struct<attempts array<struct<verification_categories array<string>, verification_discrepancies array<struct<category string>>>>>>"


def _basket_rows(spark: SparkSession, d: str) -> DataFrame:
    """run_id, received_at, baskets: per delivery the item set of every attempt that has items."""
    reports = spark.read.schema(BASKETS).parquet(f"{d}/reports.parquet")
    none = F.expr("cast(array() as array<string>)")
    basket = lambda a: item_set(F.transform(F.concat(F.coalesce(a["verification_categories"], none), F.coalesce(F.transform(a["verification_discrepancies"], lambda x: x["category"]), none)), item_text))
    attempts = F.flatten(F.filter(F.transform("pages", lambda p: p["attempts"]), lambda x: x.isNotNull()))
    sets = F.filter(F.transform(F.filter(attempts, lambda a: a.isNotNull()), basket), lambda s: F.size(s) > 0)
    return reports.select("run_id", "received_at", F.coalesce(sets, F.expr("cast(array() as array<array<string>>)")).alias("baskets"))


def _after(rows: DataFrame) -> DataFrame:
    return latest(rows, F.col("baskets")).select(F.lit(None).cast("array<string>").alias("before"), F.explode("baskets").alias("after"))


def _found(pairs: DataFrame) -> DataFrame:
    return pairs.where("n_ab >= 0.01 * n and n_ab * cast(n as decimal(38,0)) >= 1.8 * (cast(n_a as decimal(19,0)) * n_b)").select(F.col("a").alias("category_a"), F.col("b").alias("category_b"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Category pairs that occur together in attempts far more often than chance."""
    pairs = PairTable(spark, Shelf(spark, "pairs").path("p1"))
    pairs.merge(_after(_basket_rows(spark, d)))
    return _found(pairs.scores())


def p1_scores(spark: SparkSession, d: str) -> DataFrame:
    """All category pairs with counts and lift."""
    pairs = PairTable(spark, Shelf(spark, "pairs").path("p1"))
    pairs.merge(_after(_basket_rows(spark, d)))
    return pairs.scores().select("a", "b", "n_ab", "n_a", "n_b", "n", F.round("lift", 6).alias("lift"))


def p1_incremental(spark: SparkSession, d: str) -> DataFrame:
    """As p1_scores, from two merges: deliveries of all days but the last, then the last day's changes.

    The second merge takes back the baskets of runs that were delivered again, and
    the written scores of the first are updated where its deltas affect them.  A
    null received_at is the earliest.
    """
    rows = _basket_rows(spark, d)
    cut = F.lit(rows.agg(F.date_trunc("day", F.max("received_at"))).first()[0])
    early = rows.where((F.col("received_at") < cut) | F.col("received_at").isNull())
    shelf = Shelf(spark, "pairs")
    pairs = PairTable(spark, shelf.path("p1"))
    pairs.merge(_after(early))
    scores = shelf.put(pairs.scores(), "scores")
    late = rows.where(F.col("received_at") >= cut)
    again = early.join(late.select("run_id").distinct(), "run_id", "left_semi")
    back = latest(again, F.col("baskets")).select(F.explode("baskets").alias("before"), F.lit(None).cast("array<string>").alias("after"))
    scores = pairs.rescore(scores, pairs.merge(back.unionByName(_after(late))))
    return scores.select("a", "b", "n_ab", "n_a", "n_b", "n", F.round("lift", 6).alias("lift"))


def _measures(spark: SparkSession, d: str) -> DataFrame:
    """image_model, day, measure, v of each run's latest delivery."""
    reports = spark.read.parquet(f"{d}/reports.parquet")
    # the first cast reads the offset, the day is that of the UTC instant whatever the session's zone
    at = F.expr("date_format(date_from_unix_date(cast(floor(unix_seconds(try_to_timestamp(started_at)) / 86400) as int)), 'yyyy-MM-dd')")
    rows = latest(reports, F.col("image_model"), at.alias("day"), F.col("cost_usd"), F.col("total_tokens").cast("double").alias("total_tokens"))
    return rows.where("image_model is not null and day is not null").select("image_model", "day", F.expr("stack(2, 'cost_usd', cost_usd, 'total_tokens', total_tokens) as (measure, v)"))


GROUP = ["image_model", "day", "measure"]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups of at least 20 values whose 90th percentile is at least 4 times the median."""
    q = quantiles.multi_select(_measures(spark, d), GROUP, "v", [0.5, 0.9])
    return q.where("n >= 20 and q90 >= 4 * q50").select(*GROUP)


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles per image model, day and measure."""
    return quantiles.multi_select(_measures(spark, d), GROUP, "v", [0.25, 0.5, 0.75, 0.9, 0.99])


def p4_sketches(spark: SparkSession, d: str) -> DataFrame:
    """The mergeable summaries per image model, day and measure."""
    return quantiles.sketch(_measures(spark, d), GROUP, "v")


def p4_merged(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per image model and measure over all days, from the days' summaries, within 1 percent."""
    coarse = ["image_model", "measure"]
    out = quantiles.sketch_percentiles(quantiles.merge(p4_sketches(spark, d), coarse), coarse, [0.5, 0.9])
    return out.select(*coarse, "n", F.round("q50", 4).alias("q50"), F.round("q90", 4).alias("q90"))


QUERIES = {f.__name__: f for f in (p1_found, p1_scores, p1_incremental, p4_found, p4_percentiles, p4_sketches, p4_merged)}

_LATEST = "latest as (select * from (select *, row_number() over (partition by run_id order by received_at desc nulls last) as rn from reports) where rn = 1)"
_PAIRS = f"""with {_LATEST},
a as (select unnest(p.attempts) as a from (select unnest(pages) as p from latest)),
s as (select row_number() over () as id, list_distinct(list_transform(list_filter(list_concat(coalesce(a.verification_categories, []), coalesce(list_transform(a.verification_discrepancies, lambda x: x.category), [])), lambda x: x is not null and trim(x) <> ''),
  lambda x: replace(replace(lower(trim(x)), '-', '_'), ' ', '_'))) as s from a where a is not null),
i as (select id, unnest(s) as c from s where len(s) > 0),
t as (select count(*) as n from s where len(s) > 0),
m as (select c, count(*) as n from i group by c),
ab as (select x.c as a, y.c as b, count(*) as n_ab from i x join i y on x.id = y.id and x.c < y.c group by 1, 2)
"""
_MEASURES = f"""with {_LATEST},
x as (select image_model, strftime(cast(started_at as timestamptz) at time zone 'UTC', '%Y-%m-%d') as day, unnest(['cost_usd', 'total_tokens']) as measure, unnest([cost_usd, cast(total_tokens as double)]) as v from latest where image_model is not null),
y as (select *, row_number() over (partition by image_model, day, measure order by v) as rn, count(*) over (partition by image_model, day, measure) as n from x where v is not null and not isnan(v))
"""
_AT = lambda q: f"max(case when rn = greatest(cast(ceil({q} * n - 1e-9) as bigint), 1) then v end)"

SQL = {
    "p1_found": _PAIRS + "select ab.a as category_a, ab.b as category_b from ab join m x on x.c = ab.a join m y on y.c = ab.b, t where n_ab >= 0.01 * t.n and n_ab * t.n >= 1.8 * x.n * y.n",
    "p1_scores": _PAIRS + "select ab.a, ab.b, n_ab, x.n as n_a, y.n as n_b, t.n as n, round(n_ab * cast(t.n as double) / (x.n * cast(y.n as double)), 6) as lift from ab join m x on x.c = ab.a join m y on y.c = ab.b, t",
    "p4_found": _MEASURES + f"select image_model, day, measure from y group by all having count(*) >= 20 and {_AT(0.9)} >= 4 * {_AT(0.5)}",
    "p4_percentiles": _MEASURES + f"select image_model, day, measure, count(*) as n, {', '.join(f'{_AT(q)} as q{q * 100:g}' for q in (0.25, 0.5, 0.75, 0.9, 0.99))} from y group by all",
}
SQL["p1_incremental"] = SQL["p1_scores"]
_SKETCH = _MEASURES + """, b as (select image_model, day, measure, cast(case when abs(v) < 1e-300 then 0 else sign(v) end as int) as sign, cast(case when abs(v) < 1e-300 then 0 else ceil(ln(least(abs(v), 1.7e308)) / ln(1.01::double / 0.99::double)) end as int) as bucket from y)
"""
SQL["p4_sketches"] = _SKETCH + "select image_model, day, measure, sign, bucket, count(*) as n from b group by all"
SQL["p4_merged"] = _SKETCH + """, c as (select image_model, measure, sign, bucket, count(*) as n from b group by all),
d as (select *, case when sign = 0 then 0.0::double else sign * (2.0::double / (1.01::double / 0.99::double + 1)) * pow(1.01::double / 0.99::double, bucket) end as mid, sum(n) over (partition by image_model, measure order by sign * bucket + sign * 16777216) as c, sum(n) over (partition by image_model, measure) as total from c)
select image_model, measure, cast(max(total) as bigint) as n, round(min(mid) filter (c >= ceil(0.5::double * total - 1e-9)), 4) as q50, round(min(mid) filter (c >= ceil(0.9::double * total - 1e-9)), 4) as q90 from d group by all"""
