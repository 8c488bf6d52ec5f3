"""Queries on decisions: gates, margins, settings, provider errors, schedules, unsafe files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from foliomill.functions import boxes as bx
from foliomill.functions import raster, rules
from foliomill.operators import verification as vf
from foliomill.operators.pages import over_pages
from foliomill.operators.pairing import strict_zip
from foliomill.plans import geometry, rasters, regions, reviews, workspace
from foliomill.plans.regions import review_tiles
from foliomill.plans.workspace import latest_runs
from foliomill.session import table
from foliomill.sources import pdf


def _ink(s):
    src = s.hold(s.a < rasters.INK, False)
    wide = lambda m, kx, ky: s.hold(raster.dilate(s.hold(m, 0), kx, ky), 0)
    cand = wide(s.hold(raster.erode(s.hold(s.a < 2 * rasters.INK, 255), 3, 1), 0), 3, 1)
    return None, s.sums(src), s.sums(cand), s.sums(src & ~wide(cand, 5, 3)), s.sums(cand & ~wide(src, 5, 3))


def gate_issues(spark: SparkSession, d: str) -> DataFrame:
    """The gate's issues of every page against its cleaned copy; resolution, registration and holes are made up from the page's number."""
    ink = over_pages(table(spark, d, "documents"), _ink, "page_id long, source_ink long, candidate_ink long, missing long, invented long")
    n = F.col("page_id")
    issues = rules.gate_issues(100 + n % 120, F.lit(150), n % 7 != 0, F.col("source_ink") >= 32, F.col("missing"), F.col("source_ink"), F.col("invented"), F.col("candidate_ink"), F.when(n % 5 == 0, 1).otherwise(0))
    return ink.select("page_id", issues.alias("x")).select("page_id", F.array_join("x", ",").alias("issues"), (F.size("x") == 0).alias("accepted"), rules.photo_passes(F.col("x")).alias("photo_accepted"))


def pixel_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of every page that are ink, paper, colored (chroma over 16) or saturated; the planes are derived from the gray."""

    def kernel(s):
        r, g, b = s.a.astype(int), s.a.astype(int) * 3 % 256, s.a.astype(int) * 7 % 256
        most, least = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
        hold = lambda x: s.sums(s.hold(x, False))
        return None, hold(most < 140), hold(least >= 225), hold(most - least > 16), hold(510 * (most - least) >= 89 * np.maximum(most, 1))

    return over_pages(table(spark, d, "documents"), kernel, "page_id long, n_ink int, n_paper int, n_colored int, n_saturated int", 0)


def margin_clearance(spark: SparkSession, d: str) -> DataFrame:
    """Marked pixels of every page's left margin before and after a white frame, and whether a sparse mark was cleared by it."""

    def kernel(s):
        height = np.r_[s.heights, 0][s.page]
        rim = np.maximum(1, np.rint(height * 0.05))
        strip = s.hold(s.a, 255)[:, :6] < 250
        framed = ((s.y < rim) | (s.y >= height - rim))[:, None] | (np.arange(6) < 3)
        return None, s.heights * 6, s.sums(strip), s.sums(strip & (s.a[:, :6] % 41 == 0)), s.sums(strip & ~framed)

    m = over_pages(table(spark, d, "documents"), kernel, "page_id long, area long, before long, colored long, after long", 0)
    region = bx.Box(*map(F.lit, (0.0, 0.0, 6 / 64, 1.0)))
    return m.select("page_id", "before", "after", rules.margin_cleared(region, F.col("before"), F.col("colored"), F.col("after"), F.col("area"), F.lit(True)).alias("cleared"))


def incremental_content_gate(spark: SparkSession, d: str) -> DataFrame:
    """Every page's verdict on a repair whose place follows from the page's number."""
    n = F.col("page_id").cast("double")
    calls = reviews.calls(spark, d)
    regions = calls.select("page_id").distinct().select("page_id", ((n % 10) / 20).alias("l"), ((n % 7) / 14).alias("t"), ((n % 10) / 20 + 0.4).alias("r"), ((n % 7) / 14 + 0.4).alias("b"))
    return vf.incremental(calls, regions, 2480, 3508, reviews.TOLERATED)


def five_view_panels(spark: SparkSession, d: str) -> DataFrame:
    """five_view_verification where every third page is a preserved panel from 4 percent of its height on."""
    views = vf.chosen(reviews.calls(spark, d))
    box = F.struct(*(F.lit(v).alias(c) for c, v in zip("ltrb", (0.0, 0.04, 1.0, 1.0))))
    panels = views.where("page_id % 3 = 0").select("page_id", "view_idx", F.array(box).alias("panels"))
    return vf.page_verdicts(vf.preserved(views, panels), reviews.TOLERATED)


def five_view_all_views(spark: SparkSession, d: str) -> DataFrame:
    """five_view_verification that reads all views of a page."""
    return vf.page_verdicts(vf.chosen(reviews.calls(spark, d)), reviews.TOLERATED, all_views=True)


URLS = ("https://gate.example.org/v1", "http://gate.example.org", "http://localhost:8080", "ftp://gate.example.org", "https:///v1")


def settings_validation(spark: SparkSession, d: str) -> DataFrame:
    """Runs by the first thing wrong with their settings; the address follows from the page."""
    runs = table(spark, d, "lab_runs").select(F.element_at(F.array(*map(F.lit, URLS)), F.coalesce(F.col("page") % 5, F.lit(0)) + 1).alias("url"), "image_model", "review_model", "usd_cost", (F.col("max_model_calls") > 4).alias("zdr"))
    failure = rules.settings_failure(F.col("url"), F.col("image_model"), F.col("review_model"), F.col("usd_cost"), F.coalesce("zdr", F.lit(False)))
    return runs.groupBy(F.coalesce(failure, F.lit("none")).alias("failure")).agg(F.count("*").alias("n"))


STATUSES = (200, 200, 400, 401, 404, 408, 413, 422, 429, 500)
KINDS = ("refusal", "image_too_large", "rate_limit", "Moderation_block", "invalid")
HEADERS = ("5", "120", "soon", "Wed, 01 Jan 2020 00:00:20 GMT", None)


def provider_errors(spark: SparkSession, d: str) -> DataFrame:
    """Recorded calls by the class of their error, whether it is worth another call, and the seconds to wait in sum."""
    pick = lambda xs, by: F.element_at(F.array(*map(F.lit, xs)), (by + 1).cast("int"))
    n = F.col("event_id")
    e = table(spark, d, "events").select(pick(STATUSES, n % 10).alias("status"), pick(KINDS, F.floor(n / 10) % 5).alias("kind"), pick(HEADERS, F.floor(n / 50) % 5).alias("header"))
    wait = rules.retry_after(F.col("header"), F.lit("2020-01-01 00:00:00").cast("timestamp"))
    kind = rules.error_class(F.col("status"), F.col("kind"), F.lit("call failed"), F.col("kind") != "invalid")
    return e.groupBy("status", kind.alias("class"), rules.transient(F.col("status")).alias("transient")).agg(F.count("*").alias("n"), F.sum(wait.cast("long")).alias("wait"))


def fatal_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Jobs per kind that were still started when the first fatal one stopped all later ones: a minimum first, no window over all rows."""
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("kind"), (F.col("value") >= 400).alias("fatal"))
    first = e.where("fatal").agg(F.min("event_id").alias("stop"))
    return e.join(F.broadcast(first)).groupBy("kind").agg(F.count_if(F.col("stop").isNull() | (F.col("event_id") <= F.col("stop"))).alias("started"), F.count("*").alias("n"))


def unsupported_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of models in use of which no delivery cost more than 2."""
    r = table(spark, d, "reports").select("image_model", "verification_model", "cost_usd").where("image_model is not null and verification_model is not null")
    allowed = r.where("cost_usd > 2 and not isnan(cost_usd)").select("image_model", "verification_model").distinct()
    return r.select("image_model", "verification_model").distinct().join(allowed, ["image_model", "verification_model"], "left_anti")


def paired_views(spark: SparkSession, d: str) -> DataFrame:
    """Review views of source and candidate side by side, which must match view by view: views per attempt and their pixels."""
    tiles = review_tiles(spark, d)
    area = ((F.col("r") - F.col("l")) * (F.col("b") - F.col("t"))).cast("long")
    keys = ["run_id", "page_no", "attempt_no", "view"]
    both = strict_zip(tiles.select(*keys, area.alias("source")), tiles.select(*keys, area.alias("candidate")), keys)
    return both.groupBy(*keys[:3]).agg(F.count("*").alias("views"), F.sum(F.col("source") + F.col("candidate")).alias("pixels"))


def authored_holes(spark: SparkSession, d: str) -> DataFrame:
    """Per run the first two small local boxes, by id."""
    local = geometry._boxes(spark, d).where("x1 > x0 and y1 > y0 and x1 - x0 <= 0.3 and y1 - y0 <= 0.3")
    lists = local.groupBy("run_id").agg(F.slice(F.array_sort(F.collect_list("id")), 1, 2).alias("ids"))
    return lists.select("run_id", F.posexplode("ids").alias("i", "id")).select("run_id", (F.col("i") + 1).alias("place"), "id")


def newest_runs(spark: SparkSession, d: str) -> DataFrame:
    """The three newest runs of every document, newest first."""
    order = W.partitionBy("document_id").orderBy(F.desc("created_at"), F.desc("rid"))
    return latest_runs(spark, d).where("created_at is not null").withColumn("place", F.row_number().over(order)).where("place <= 3").select("document_id", "place", F.col("rid").alias("run_id"))


ENTRIES = (("Annots", "7 0 R"), ("AA", "1 0 R"), ("Type", "/Page"), ("Subtype", "/Link"), ("AcroForm", "3 0 R"), ("FT", "/Sig"), ("Subtype", "/RichMedia"), ("EmbeddedFiles", "9 0 R"), ("Rotate", "90"), ("OpenAction", "2 0 R"), ("S", "/JavaScript"), ("Subtype", "/Redact"), ("XFA", "4 0 R"))


def pdf_findings(spark: SparkSession, d: str) -> DataFrame:
    """Orders read as PDF files and their lines as entries: what makes each unsafe, and what an overlay removes."""
    x = F.element_at(F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in ENTRIES)), (F.col("l_partkey") % F.when(F.col("l_suppkey") % 4 == 0, 13).otherwise(10) + 1).cast("int"))
    objects = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), F.col("l_linenumber").alias("object_id"), x.alias("x")).select("path", "object_id", "x.*")
    return pdf.findings(objects).select("path", "unsafe", F.array_join("removed", ",").alias("removed"))


QUERIES = {f.__name__: f for f in (gate_issues, pixel_predicates, margin_clearance, incremental_content_gate, five_view_panels, five_view_all_views, settings_validation, provider_errors, fatal_schedule, unsupported_pairs, paired_views, authored_holes, newest_runs, pdf_findings)}

_FORE = rasters.SQL["foreground_ratios"].partition(", j as (")[0]
_EV = reviews._CALLS + reviews._PICK.format(pick="case when v.q1 then 2 else 1 end", good="false")
_PANEL = "(page_id % 3 = 0 and tax >= 0.04)"
_ENTRY = "[" + ", ".join(f"struct_pack(k := '{k}', v := '{v}')" for k, v in ENTRIES) + "]"
_LIST = lambda xs: "[" + ", ".join("null" if x is None else repr(x) for x in xs) + "]"

SQL = {
    "gate_issues": _FORE + """, j as (select m.page_id, sum(m.v) as src, sum(k.v) as cand, count(*) filter (m.v = 1 and kd.v = 0) as missing, count(*) filter (k.v = 1 and md.v = 0) as invented from m join k using (page_id, y, x) join kd using (page_id, y, x) join md using (page_id, y, x) group by 1),
g as (select s.page_id, coalesce(src, 0) as src, coalesce(cand, 0) as cand, coalesce(missing, 0) as missing, coalesce(invented, 0) as invented from s left join j using (page_id)),
i as (select page_id, list_filter([case when 100 + page_id % 120 < 150 then 'generated_resolution_below_minimum' end, case when page_id % 7 = 0 and src >= 32 then 'page_registration_failed' end, case when src >= 32 and missing > src * 0.45::double then 'large_foreground_loss' end,
 case when src >= 32 and invented > greatest(cand, 1) * 0.55::double then 'large_candidate_only_foreground' end, case when page_id % 5 = 0 then 'residual_punch_hole' end], lambda x: x is not null) as x from g)
select page_id, array_to_string(x, ',') as issues, len(x) = 0 as accepted, len(list_filter(x, lambda i: i <> 'large_foreground_loss')) = 0 as photo_accepted from i""",
    "pixel_predicates": rasters._PIX + """, c as (select page_id, greatest(g, g * 3 % 256, g * 7 % 256) as hi, least(g, g * 3 % 256, g * 7 % 256) as lo from px)
select s.page_id, cast(count(*) filter (hi < 140) as int) as n_ink, cast(count(*) filter (lo >= 225) as int) as n_paper, cast(count(*) filter (hi - lo > 16) as int) as n_colored, cast(count(*) filter (510 * (hi - lo) >= 89 * greatest(hi, 1)) as int) as n_saturated from s left join c using (page_id) group by s.page_id""",
    "margin_clearance": rasters._PIX + """, q as (select s.page_id, s.height * 6 as area, count(*) filter (g < 250) as before, count(*) filter (g < 250 and g % 41 = 0) as colored,
 count(*) filter (g < 250 and not (x < 3 or y < greatest(1, round_even(s.height * 0.05, 0)) or y >= s.height - greatest(1, round_even(s.height * 0.05, 0)))) as after from s left join (select * from px where x < 6) px using (page_id) group by s.page_id, s.height)
select page_id, before, after, area > 0 and before > greatest(2, round_even(area * 0.002, 0)) and before <= greatest(3, round_even(area * 0.12, 0)) and colored = 0 and after <= greatest(2, round_even(area * 0.002, 0)) and after <= before * 0.10::double as cleared from q""",
    "incremental_content_gate": reviews._CALLS + f""", o as (select page_id, view_idx, bool_or(cm or (has and cat in {reviews.TOLERATED})) as ok from c where call_no <= 2 group by all),
g as (select distinct page_id, (page_id % 10) / 20.0::double as l, (page_id % 7) / 14.0::double as t from c),
w as (select page_id, view, round(greatest(0.0, least(l + 0.4, vr / 2480.0::double) - greatest(l, vl / 2480.0::double)) * greatest(0.0, least(t + 0.4, vb / 3508.0::double) - greatest(t, vt / 3508.0::double)), 9) as area from g, (values (1, 0, 0, 1364, 1929), (2, 1116, 0, 2480, 1929), (3, 0, 1579, 1364, 3508), (4, 1116, 1579, 2480, 3508)) as q(view, vl, vt, vr, vb)),
b as (select page_id, view as tile from w qualify row_number() over (partition by page_id order by area desc, view) = 1)
select b.page_id, cast(tile as int) as tile, coalesce((select bool_and(ok) and count(*) = 2 from o where o.page_id = b.page_id and o.view_idx in (0, b.tile)), false) as accepted from b""",
    "five_view_panels": reviews._CALLS + f""", e as (select v.page_id, v.view_idx, coalesce(g.cm, false) as cm, coalesce(g.sq, false) as sq, coalesce(g.has, false) as has, g.cat, g.tax, coalesce(g.cat = 'scanner_quality' and g.has, false) as hq from v left join f g on g.page_id = v.page_id and g.view_idx = v.view_idx and g.call_no = case when v.q1 then 2 else 1 end),
k as (select *, hq and {_PANEL} as cov from e),
n as (select page_id, view_idx, case when cm and cov then 0 else cast(has and not cov and cat not in {reviews.TOLERATED} as int) + cast(not cm and not has as int) + cast(not sq and not hq as int) end as n,
 case when cm and cov then 0 else cast(has and not cov as int) + cast(not cm and not has as int) + cast(not sq and not hq as int) end as m from k),
p as (select page_id, min(view_idx) filter (n > 0) as rejected_view from n group by page_id)""" + reviews._PAGE,
    "five_view_all_views": _EV + """ select p.page_id, rejected_view is null as accepted, rejected_view, cast(count(*) as int) as views_read, cast(sum(n) as int) as n_actionable, cast(coalesce(sum(m) filter (rejected_view is null), 0) as int) as n_tolerated from p join n using (page_id) group by all""",
    "settings_validation": """with r as (select coalesce(page % 5, 0) as u, image_model as i, review_model as v, usd_cost as c, coalesce(max_model_calls > 4, false) as z from lab_runs)
select case when u = 3 then 'no_http_url' when u = 4 then 'no_endpoint' when u = 1 then 'plain_http' when coalesce(not contains(i, '/') or not contains(v, '/'), true) then 'model_without_author' when starts_with(i, 'codex/') <> starts_with(v, 'codex/') then 'mixed_families'
 when isnan(c) or c <= 0 then 'bad_cost_limit' when starts_with(i, 'codex/') and c is not null then 'cost_limit_of_subscription' when starts_with(i, 'codex/') and z then 'retention_of_subscription' else 'none' end as failure, count(*) as n from r group by 1""",
    "provider_errors": f"""with e as (select {_LIST(STATUSES)}[event_id % 10 + 1] as status, {_LIST(KINDS)}[event_id // 10 % 5 + 1] as kind, {_LIST(HEADERS)}[event_id // 50 % 5 + 1] as header from events),
k as (select *, lower(kind) like '%moderation%' or kind = 'refusal' as policy, case header when '5' then 5 when '120' then 30 when 'Wed, 01 Jan 2020 00:00:20 GMT' then 20 else 1 end as wait from e)
select cast(status as int) as status, case when status < 400 and kind = 'invalid' then 'ok' when status < 400 and policy then 'content_policy' when status < 400 then 'failed' when status = 413 or kind = 'image_too_large' then 'too_large' when status in (400, 422) and policy then 'content_policy' when status in (401, 402, 403, 404) then 'fatal' else 'failed' end as class,
 status in (408, 409, 429) or status >= 500 as transient, count(*) as n, cast(sum(wait) as bigint) as wait from k group by all""",
    "fatal_schedule": "with s as (select min(event_id) filter (value >= 400) as stop from events) select event_type as kind, count(*) filter (stop is null or event_id <= stop) as started, count(*) as n from events, s group by 1",
    "unsupported_pairs": "select distinct image_model, verification_model from reports r where image_model is not null and verification_model is not null and not exists (select 1 from reports a where a.cost_usd > 2 and not isnan(a.cost_usd) and a.image_model = r.image_model and a.verification_model = r.verification_model)",
    "authored_holes": geometry._B + "select run_id, cast(place as int) as place, id from (select run_id, id, row_number() over (partition by run_id order by id) as place from b where x1 > x0 and y1 > y0 and x1 - x0 <= 0.3 and y1 - y0 <= 0.3) where place <= 2",
    "pdf_findings": f"""with x as (select cast(l_orderkey as varchar) as path, {_ENTRY}[l_partkey % case when l_suppkey % 4 = 0 then 13 else 10 end + 1] as x from lineitem),
y as (select path, min(case x.k when 'XFA' then 3 when 'S' then 5 when 'Subtype' then case x.v when '/Redact' then 6 end end) as w,
 list_sort(list_distinct(list(case when x.k = 'AcroForm' then 'interactive_forms' when x.k = 'OpenAction' then 'document_actions' when x.k = 'AA' then 'actions' when x.k = 'EmbeddedFiles' then 'embedded_files' when x.k = 'Annots' then 'annotations' when x.v = '/RichMedia' then 'rich_media' when x.k = 'FT' then 'digital_signatures' end))) as r from x group by path)
select path, case w when 3 then 'xfa_forms' when 5 then 'javascript' when 6 then 'unapplied_redaction' end as unsafe, array_to_string(r, ',') as removed from y""",
    "paired_views": regions.SQL["review_tiles"].replace("select run_id, page_no, attempt_no, view,", ", tiles as (select run_id, page_no, attempt_no, view,", 1) + ") select run_id, page_no, attempt_no, count(*) as views, cast(sum(2 * cast(r - l as bigint) * (b - t)) as bigint) as pixels from tiles group by all",
    "newest_runs": f"with {workspace._RUNS} select document_id, cast(place as int) as place, rid as run_id from (select *, row_number() over (partition by document_id order by created_at desc, rid desc) as place from runs where created_at is not null) where place <= 3",
}
