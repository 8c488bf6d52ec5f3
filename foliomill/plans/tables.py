"""Queries on reports and calls: sets, windows, order statistics, conversions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from foliomill.functions import scalars
from foliomill.plans.records import latest
from foliomill.plans.regions import attempts, category, discrepancies
from foliomill.session import table


def category_sets(spark: SparkSession, d: str) -> DataFrame:
    """Per attempt how the categories of its two fields relate as sets."""
    none = F.expr("cast(array() as array<string>)")
    clean = lambda a: F.array_distinct(F.filter(F.transform(F.coalesce(a, none), category), lambda x: x.isNotNull() & (x != "")))
    slim = "run_id string, received_at timestamp, pages array<struct<attempts array<struct<verification_categories array<string>, verification_discrepancies array<struct<category string>>>>>>"
    pages = latest(spark.read.schema(slim).parquet(f"{d}/reports.parquet"), F.col("pages")).select("run_id", F.explode(F.filter("pages", lambda x: x.isNotNull())).alias("p"))
    rows = pages.select("run_id", F.explode(F.filter("p.attempts", lambda x: x.isNotNull())).alias("a")).select("run_id", clean(F.col("a.verification_categories")).alias("x"), clean(F.transform("a.verification_discrepancies", lambda v: v["category"])).alias("y"))
    n = lambda c: F.sum(F.size(c)).cast("long")
    return rows.groupBy("run_id").agg(F.count("*").alias("attempts"), n(F.array_union("x", "y")).alias("n_union"), n(F.array_intersect("x", "y")).alias("n_both"), n(F.array_except("x", "y")).alias("n_first_only"), F.count_if(F.array_sort("x") == F.array_sort("y")).alias("n_equal"))


def strongest_findings(spark: SparkSession, d: str) -> DataFrame:
    """The three most severe discrepancies of every page, earlier ones first among equals."""
    order = W.partitionBy("run_id", "page_no").orderBy(F.desc("rank"), "attempt_no", "disc_no")
    return discrepancies(spark, d).withColumn("place", F.row_number().over(order)).where("place <= 3").select("run_id", "page_no", "place", "attempt_no", "disc_no", "category")


def page_status_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per report its pages by status, and whether all or any of them have an attempt that was accepted."""
    slim = "run_id string, received_at timestamp, pages array<struct<status string, attempts array<struct<accepted boolean>>>>"
    pages = latest(spark.read.schema(slim).parquet(f"{d}/reports.parquet"), F.col("pages")).select("run_id", F.explode(F.filter("pages", lambda x: x.isNotNull())).alias("p"))
    ok = F.coalesce(F.exists("p.attempts", lambda a: F.coalesce(a["accepted"], F.lit(False))), F.lit(False))
    return pages.groupBy("run_id").agg(F.count("*").alias("pages"), F.count_if(F.col("p.status") == "original_fallback").alias("n_fallback"), F.bool_and(ok).alias("all_accepted"), F.bool_or(ok).alias("any_accepted"))


def sticky_stop(spark: SparkSession, d: str) -> DataFrame:
    """Per customer, read as a document of ordered pages, the pages kept before the first that stops the rest."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", (F.col("o_orderstatus") == "P").cast("int").alias("stop"))
    first = o.where("stop = 1").groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("first"))  # combined in each task: no window over a customer
    kept = F.col("first").isNull() | (F.struct("o_orderdate", "o_orderkey") <= F.col("first"))
    return o.join(first, "o_custkey", "left").groupBy("o_custkey").agg(F.count_if(kept).alias("kept"), F.count("*").alias("pages"))


def cost_spread(spark: SparkSession, d: str) -> DataFrame:
    """Median cost per image model and the median absolute deviation from it."""
    rows = latest(table(spark, d, "reports"), F.col("image_model"), F.col("cost_usd")).where("cost_usd is not null and not isnan(cost_usd) and image_model is not null")
    mid = rows.groupBy("image_model").agg(F.median("cost_usd").alias("mid"))
    return rows.join(mid, "image_model").groupBy("image_model").agg(F.count("*").alias("n"), F.round(F.max("mid"), 6).alias("median"), F.round(F.median(F.abs(F.col("cost_usd") - F.col("mid"))), 6).alias("mad"))


def utc_times(spark: SparkSession, d: str) -> DataFrame:
    """Every delivery's start in UTC."""
    return table(spark, d, "reports").select("run_id", scalars.utc_iso(F.col("started_at")).alias("started"))


def model_parts(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries by author and name of the image model."""
    return table(spark, d, "reports").where("image_model is not null").select(*scalars.model_parts(F.col("image_model"))).groupBy("author", "name").agg(F.count("*").alias("n"))


def data_urls(spark: SparkSession, d: str) -> DataFrame:
    """Size of every text's bytes as a data URL, and whether it decodes to the same bytes."""
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    url = scalars.data_url(data)
    return table(spark, d, "documents").select("doc_id", F.length(url).cast("long").alias("length"), (scalars.from_data_url(url) == data).alias("same"))


def clamped_settings(spark: SparkSession, d: str) -> DataFrame:
    """Numbers in the events' properties kept within 20 to 60, 30 where there is none."""
    return table(spark, d, "events").select("event_id", scalars.clamped(F.get_json_object("props", "$.k"), 20, 60, 30).alias("k"))


def latest_attempt_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Attempts per page in order, and how many carry a number that isn't their place."""
    rows = attempts(spark, d)
    return rows.groupBy("run_id", "page_no").agg(F.max("attempt_no").alias("last"), F.count_if(F.col("a.number") != F.col("attempt_no")).alias("n_misnumbered"))


QUERIES = {f.__name__: f for f in (category_sets, strongest_findings, page_status_summary, sticky_stop, cost_spread, utc_times, model_parts, data_urls, clamped_settings, latest_attempt_numbers)}

_L = """with latest as (select * from (select *, row_number() over (partition by run_id order by received_at desc nulls last) as rn from reports) where rn = 1),
p as (select run_id, unnest(list_filter(pages, lambda x: x is not null)) as p, cast(unnest(range(1, 1 + len(list_filter(pages, lambda x: x is not null)))) as int) as page_no from latest),
a as (select run_id, page_no, unnest(list_filter(p.attempts, lambda x: x is not null)) as a, cast(unnest(range(1, 1 + len(list_filter(p.attempts, lambda x: x is not null)))) as int) as attempt_no from p)
"""
_CLEAN = "list_distinct(list_filter(list_transform(coalesce({e}, []), lambda x: replace(replace(lower(trim(x)), '-', '_'), ' ', '_')), lambda x: x is not null and x <> ''))"
SQL = {
    "category_sets": _L + f""", s as (select run_id, {_CLEAN.format(e='a.verification_categories')} as x, {_CLEAN.format(e='list_transform(a.verification_discrepancies, lambda v: v.category)')} as y from a)
select run_id, count(*) as attempts, cast(sum(len(list_distinct(list_concat(x, y)))) as bigint) as n_union, cast(sum(len(list_intersect(x, y))) as bigint) as n_both, cast(sum(len(list_filter(x, lambda v: not list_contains(y, v)))) as bigint) as n_first_only, count(*) filter (list_sort(x) = list_sort(y)) as n_equal from s group by run_id""",
    "strongest_findings": _L + """, v as (select run_id, page_no, attempt_no, unnest(list_filter(a.verification_discrepancies, lambda x: x is not null)) as v, cast(unnest(range(1, 1 + len(list_filter(a.verification_discrepancies, lambda x: x is not null)))) as int) as disc_no from a),
x as (select run_id, page_no, attempt_no, disc_no, replace(replace(lower(trim(v.category)), '-', '_'), ' ', '_') as category, case lower(trim(v.severity)) when 'low' then 1 when 'medium' then 2 when 'high' then 3 when 'critical' then 4 else 0 end as rank from v where v.region.l is not null and v.region.t is not null and v.region.r is not null and v.region.b is not null),
r as (select *, row_number() over (partition by run_id, page_no order by rank desc, attempt_no, disc_no) as place from x) select run_id, page_no, cast(place as int) as place, attempt_no, disc_no, category from r where place <= 3""",
    "page_status_summary": _L + ", o as (select run_id, p.status as status, coalesce(len(list_filter(p.attempts, lambda x: coalesce(x.accepted, false))) > 0, false) as ok from p) select run_id, count(*) as pages, count(*) filter (status = 'original_fallback') as n_fallback, bool_and(ok) as all_accepted, bool_or(ok) as any_accepted from o group by run_id",
    "sticky_stop": "select o_custkey, count(*) filter (s = 0) as kept, count(*) as pages from (select o_custkey, coalesce(max(case when o_orderstatus = 'P' then 1 else 0 end) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and 1 preceding), 0) as s from orders) group by o_custkey",
    "cost_spread": _L + ", c as (select image_model, cost_usd as c from latest where cost_usd is not null and not isnan(cost_usd) and image_model is not null), m as (select image_model, median(c) as mid from c group by 1) select image_model, count(*) as n, round(max(mid), 6) as median, round(median(abs(c - mid)), 6) as mad from c join m using (image_model) group by image_model",
    "utc_times": "select run_id, strftime(cast(started_at as timestamptz) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') as started from reports",
    "model_parts": "select split_part(image_model, '/', 1) as author, case when contains(image_model, '/') then regexp_extract(image_model, '^[^/]*/(.*)$', 1) end as name, count(*) as n from reports where image_model is not null group by all",
    "data_urls": "select doc_id, cast(22 + 4 * ceil(octet_length(encode(coalesce(text, ''))) / 3.0) as bigint) as length, true as same from documents",
    "clamped_settings": "select event_id, coalesce(least(greatest(try_cast(json_extract_string(props, '$.k') as double), 20), 60), 30) as k from events",
    "latest_attempt_numbers": _L + "select run_id, page_no, max(attempt_no) as last, count(*) filter (a.number <> attempt_no) as n_misnumbered from a group by all",
}
