"""Queries on the regions of discrepancies and lab issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.functions import boxes as bx
from foliomill.operators import folds
from foliomill.plans.records import latest
from foliomill.session import table

# Discrepancy categories with a repair, severity ranks.
REPAIRABLE = ("changed_text", "missing_text", "invented_text", "changed_handwriting", "changed_signature", "changed_stamp", "changed_redaction", "changed_table", "changed_diagram", "unresolved_content", "other_content")
SEVERITIES = ("low", "medium", "high", "critical")
# End of fixed values.

#: The leaves of a report that these queries read.
SLIM = "run_id string, received_at timestamp, pages array<struct<attempts array<struct<number int, generated_width int, generated_height int, verification_discrepancies array<struct<category string, severity string, region struct<l double, t double, r double, b double>>>>>>>"
KEY = ["run_id", "page_no", "attempt_no", "disc_no"]


def category(c) -> F.Column:
    """Trimmed of all white space, lower-case, hyphens and inner white space as underscores."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"^[\s\u00a0]+|[\s\u00a0]+$", "")), r"[\s\u00a0\-]", "_")


def rank(c) -> F.Column:
    """1 to 4, 0 for an unknown or null severity."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.lower(F.trim(c))), F.lit(0)).cast("int")


def attempts(spark: SparkSession, d: str) -> DataFrame:
    """run_id, page_no, attempt_no, a: attempts of each run's latest delivery, nulls left out."""
    pages = latest(spark.read.schema(SLIM).parquet(f"{d}/reports.parquet"), F.col("pages")).select("run_id", F.posexplode(F.filter("pages", lambda x: x.isNotNull())).alias("page_no", "p"))
    inner = pages.select("run_id", (F.col("page_no") + 1).alias("page_no"), F.posexplode(F.filter("p.attempts", lambda x: x.isNotNull())).alias("attempt_no", "a"))
    return inner.withColumn("attempt_no", F.col("attempt_no") + 1)


def discrepancies(spark: SparkSession, d: str) -> DataFrame:
    """KEY, category, severity rank and l, t, r, b of every discrepancy with a region."""
    rows = attempts(spark, d).select("run_id", "page_no", "attempt_no", F.posexplode(F.filter("a.verification_discrepancies", lambda x: x.isNotNull())).alias("disc_no", "v"))
    return rows.select("run_id", "page_no", "attempt_no", (F.col("disc_no") + 1).alias("disc_no"), category(F.col("v.category")).alias("category"), rank(F.col("v.severity")).alias("rank"), "v.region.*").where("l is not null and t is not null and r is not null and b is not null")


def review_tiles(spark: SparkSession, d: str) -> DataFrame:
    """The five review views, in pixels, of every attempt with a canvas."""
    rows = attempts(spark, d).select("run_id", "page_no", "attempt_no", F.col("a.generated_width").alias("w"), F.col("a.generated_height").alias("h")).where("w > 0 and h > 0")
    return rows.select("run_id", "page_no", "attempt_no", F.inline(bx.tiles(F.col("w"), F.col("h"))))


def view_to_page_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Each discrepancy's box read as one of view disc_no mod 5 on a 2480 x 3508 canvas, in page coordinates."""
    w, h = F.lit(2480), F.lit(3508)
    view = F.element_at(bx.tiles(w, h), F.pmod("disc_no", F.lit(5)) + 1)
    page = bx.from_view(bx.Box(*(view[c].cast("double") for c in "ltrb")), bx.box(), w.cast("double"), h.cast("double"))
    return discrepancies(spark, d).select(*KEY, *page.scaled())


def _mapped(f) -> callable:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return discrepancies(spark, d).select(*KEY, *f(bx.box()).scaled())

    return query


def quality_repair_region(spark: SparkSession, d: str) -> DataFrame:
    """Repair boxes of the scanner quality findings of eligible shape."""
    out, fits = bx.quality_target(bx.box())
    return discrepancies(spark, d).where("category = 'scanner_quality'").where(fits).select(*KEY, *out.scaled())


def region_orientation(spark: SparkSession, d: str) -> DataFrame:
    return discrepancies(spark, d).groupBy("category", bx.orientation(bx.box()).alias("orientation")).agg(F.count("*").alias("n"))


def hole_paste_region(spark: SparkSession, d: str) -> DataFrame:
    context = bx.hole_context(bx.box())
    return discrepancies(spark, d).select(*KEY, *bx.hole_paste(context, bx.box()).scaled())


def best_repair_region(spark: SparkSession, d: str) -> DataFrame:
    """Per attempt the padded box of the first most severe repairable discrepancy."""
    rows = discrepancies(spark, d).where(F.col("category").isin(*REPAIRABLE))
    best = rows.groupBy(*KEY[:3]).agg(F.max_by(F.struct("disc_no", "l", "t", "r", "b"), F.struct("rank", -F.col("disc_no"))).alias("x")).select(*KEY[:3], "x.*")
    return best.select(*KEY, *bx.repair_box(bx.box()).scaled())


def _pairs(spark: SparkSession, d: str, condition) -> DataFrame:
    rows = discrepancies(spark, d).drop("category", "rank")
    a = rows.select(*KEY[:3], F.col("disc_no").alias("first"), *(F.col(c).alias(f"a_{c}") for c in "ltrb"))
    b = rows.select(*KEY[:3], F.col("disc_no").alias("second"), *(F.col(c).alias(f"b_{c}") for c in "ltrb"))
    # the attempt is the equality key, so this is a hash or merge join with a residual predicate
    return a.join(b, KEY[:3]).where("first < second").where(condition(bx.box("a_"), bx.box("b_"))).select(*KEY[:3], "first", "second")


def region_overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of discrepancies of one attempt whose boxes share area."""
    return _pairs(spark, d, bx.overlap)


def same_quality_target_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of discrepancies of one attempt that mean one defect."""
    return _pairs(spark, d, bx.same_target)


def best_overlap_tile(spark: SparkSession, d: str) -> DataFrame:
    """The quarter view, 1 to 4, that shares most area with the box; the first of equal ones."""
    return discrepancies(spark, d).select(*KEY, bx.best_tile(bx.box(), 2480, 3508).alias("tile"))


def quality_targets(spark: SparkSession, d: str) -> DataFrame:
    """Per attempt the distinct repair boxes, strongest first: a fold in order over each attempt's few findings."""
    out, fits = bx.quality_target(bx.box())
    rows = discrepancies(spark, d).where("category = 'scanner_quality'").where(fits).select(*KEY, "rank", *(c.alias(n) for c, n in zip(out, "ltrb")))
    lists = rows.groupBy(*KEY[:3]).agg(F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("k"), "disc_no", "l", "t", "r", "b"))).alias("xs"))
    kept = lists.select(*KEY[:3], folds.distinct_targets(F.col("xs")).alias("kept"))
    return kept.select(*KEY[:3], F.posexplode("kept").alias("i", "x")).select(*KEY[:3], (F.col("i") + 1).alias("target_no"), *bx.Box(*(F.col("x")[c] for c in "ltrb")).scaled())


def combined_regions(spark: SparkSession, d: str) -> DataFrame:
    """Per run the boxes of two detectors (restored, then source boxes) that mean different defects, in order."""
    late = F.lit("0001-01-01").cast("timestamp")
    rows = table(spark, d, "lab_issues").where("run_id is not null and id is not null").groupBy("run_id", "id").agg(F.max_by(F.struct("restored_box", "source_box"), F.coalesce("reviewed_at", late)).alias("x"))
    sides = rows.select("run_id", "id", F.posexplode(F.array("x.restored_box", "x.source_box")).alias("side", "q")).where("q.x0 is not null and q.y0 is not null and q.x1 is not null and q.y1 is not null")
    item = F.struct("side", "id", F.col("q.x0").alias("l"), F.col("q.y0").alias("t"), F.col("q.x1").alias("r"), F.col("q.y1").alias("b"))
    lists = sides.groupBy("run_id").agg(F.array_sort(F.collect_list(item)).alias("xs"))
    kept = lists.select("run_id", folds.first_targets(F.col("xs")).alias("kept"))
    return kept.select("run_id", F.posexplode("kept").alias("i", "x")).select("run_id", (F.col("i") + 1).alias("place"), *bx.Box(*(F.col("x")[c] for c in "ltrb")).scaled())


def context_matches(spark: SparkSession, d: str) -> DataFrame:
    """run_id, id, match: each issue's box matched to the nearest source box of its run that is still free, in order of ids."""
    rows = table(spark, d, "lab_issues").where("run_id is not null and id is not null").groupBy("run_id", "id").agg(F.max_by(F.struct("restored_box", "source_box"), F.coalesce("reviewed_at", F.lit("0001-01-01").cast("timestamp"))).alias("x")).select("run_id", "id", "x.*")
    lists = rows.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("restored_box").isNotNull(), F.struct("id", "restored_box")))).alias("defects"),
        F.array_sort(F.collect_list(F.when(F.col("source_box").isNotNull(), F.struct("id", "source_box")))).alias("contexts"),
    )
    return folds.nearest_free(lists)


QUERIES = {
    "review_tiles": review_tiles,
    "view_to_page_boxes": view_to_page_boxes,
    "source_region": _mapped(bx.footer_widened),
    "expanded_quality_context": _mapped(bx.quality_context),
    "hole_repair_context": _mapped(bx.hole_context),
    "quality_repair_region": quality_repair_region,
    "region_orientation": region_orientation,
    "hole_paste_region": hole_paste_region,
    "best_repair_region": best_repair_region,
    "region_overlap_pairs": region_overlap_pairs,
    "same_quality_target_pairs": same_quality_target_pairs,
    "best_overlap_tile": best_overlap_tile,
    "quality_targets": quality_targets,
    "context_matches": context_matches,
    "combined_regions": combined_regions,
}

_BASE = """with latest as (select * from (select *, row_number() over (partition by run_id order by received_at desc nulls last) as rn from reports) where rn = 1),
p as (select run_id, unnest(list_filter(pages, lambda x: x is not null)) as p, unnest(range(1, 1 + len(list_filter(pages, lambda x: x is not null)))) as page_no from latest),
a as (select run_id, cast(page_no as int) as page_no, unnest(list_filter(p.attempts, lambda x: x is not null)) as a, cast(unnest(range(1, 1 + len(list_filter(p.attempts, lambda x: x is not null)))) as int) as attempt_no from p),
v as (select run_id, page_no, attempt_no, unnest(list_filter(a.verification_discrepancies, lambda x: x is not null)) as v, cast(unnest(range(1, 1 + len(list_filter(a.verification_discrepancies, lambda x: x is not null)))) as int) as disc_no from a),
x as (select run_id, page_no, attempt_no, disc_no, replace(replace(lower(trim(v.category)), '-', '_'), ' ', '_') as category,
 case lower(trim(v.severity)) when 'low' then 1 when 'medium' then 2 when 'high' then 3 when 'critical' then 4 else 0 end as rank,
 v.region.l as l, v.region.t as t, v.region.r as r, v.region.b as b from v where v.region.l is not null and v.region.t is not null and v.region.r is not null and v.region.b is not null)
"""
_K = "run_id, page_no, attempt_no, disc_no"
_TILES = "select * from (values (0, 0, 0, 2480, 3508), (1, 0, 0, 1364, 1929), (2, 1116, 0, 2480, 1929), (3, 0, 1579, 1364, 3508), (4, 1116, 1579, 2480, 3508)) as q(view, vl, vt, vr, vb)"


def _ints(**e: str) -> str:
    return ", ".join(f"cast(floor(({v}) * 1e6 + 0.5) as bigint) as {k}" for k, v in e.items())


_ORI = "case when {b} - {t} <= 0.12 and {r} - {l} >= 0.20 then 'horizontal' when {r} - {l} <= 0.12 and {b} - {t} >= 0.20 then 'vertical' else 'local' end"
_O = _ORI.format(l="l", t="t", r="r", b="b")
_QUALITY = """, q0 as (select *, greatest(0.01, least(0.03, (r - l) * 0.08)) as px, greatest(0.01, least(0.04, (b - t) * 0.50)) as py from x where category = 'scanner_quality' and r > l and b > t),
q1 as (select *, case when l <= 0.03 or r >= 0.97 then least(px, 0.005) else px end as ix, case when t <= 0.03 or b >= 0.97 then least(py, 0.005) else py end as iy from q0),
q as (select run_id, page_no, attempt_no, disc_no, case when l <= 0.03 then 0.0 else greatest(0.0, l - ix) end as l, case when t <= 0.03 then 0.0 else greatest(0.0, t - iy) end as t,
 case when r >= 0.97 then 1.0 else least(1.0, r + ix) end as r, case when b >= 0.97 then 1.0 else least(1.0, b + iy) end as b from q1)
"""
_SHAPE = "not ((r-l)*(b-t) > 0.15 or (r-l > 0.25 and b-t > 0.25) or (r-l > 0.75 and b-t > 0.10) or (b-t > 0.65 and r-l > 0.10) or (r-l > 0.55 and b-t > 0.15) or (b-t > 0.55 and r-l > 0.15))"
_HOLE = """, h0 as (select *, greatest(0.0, (l + r) / 2 - greatest(r - l, 0.36) / 2) as cl0, greatest(r - l, 0.36) as cw, greatest(0.0, (t + b) / 2 - greatest(b - t, 0.12) / 2) as ct0, greatest(b - t, 0.12) as ch from x),
h1 as (select *, least(1.0, cl0 + cw) as cr, least(1.0, ct0 + ch) as cb from h0),
h as (select *, greatest(0.0, cr - cw) as cl, greatest(0.0, cb - ch) as ct from h1)
"""
_TWO = "from x a join x b using (run_id, page_no, attempt_no) where a.disc_no < b.disc_no"
_CW, _CH = "greatest(0.0, least(a.r, b.r) - greatest(a.l, b.l))", "greatest(0.0, least(a.b, b.b) - greatest(a.t, b.t))"
_OA, _OB = (_ORI.format(**{k: f"{s}.{k}" for k in "ltrb"}) for s in "ab")

SQL = {
    "review_tiles": _BASE + """, w as (select run_id, page_no, attempt_no, a.generated_width as w, a.generated_height as h from a where a.generated_width > 0 and a.generated_height > 0),
o as (select *, cast(round_even(w * 0.1 / 2, 0) as int) as ox, cast(round_even(h * 0.1 / 2, 0) as int) as oy from w)
select run_id, page_no, attempt_no, view, cast(case when view in (2, 4) then greatest(0, w // 2 - ox) else 0 end as int) as l, cast(case when view in (3, 4) then greatest(0, h // 2 - oy) else 0 end as int) as t,
 cast(case when view in (1, 3) then least(w, w // 2 + ox) else w end as int) as r, cast(case when view in (1, 2) then least(h, h // 2 + oy) else h end as int) as b from o, (values (0), (1), (2), (3), (4)) as q(view)""",
    "view_to_page_boxes": _BASE + f"select {_K}, {_ints(l='(vl + l * (vr - vl)) / 2480.0', t='(vt + t * (vb - vt)) / 3508.0', r='(vl + r * (vr - vl)) / 2480.0', b='(vt + b * (vb - vt)) / 3508.0')} from x join ({_TILES}) on view = disc_no % 5",
    "source_region": _BASE + f"select {_K}, {_ints(l='case when b > 0.94 then 0 else l end', t='case when b > 0.94 then least(t, 0.94) else t end', r='case when b > 0.94 then 1 else r end', b='case when b > 0.94 then 1 else b end')} from x",
    "expanded_quality_context": _BASE + f""", o as (select *, {_O} as o from x), g as (select *, least(1.0, greatest(0.0, (t + b) / 2 - 0.06) + 0.12) as gb, least(1.0, greatest(0.0, (l + r) / 2 - 0.06) + 0.12) as gr from o)
select {_K}, {_ints(l="case when o = 'vertical' and r - l < 0.12 then greatest(0.0, gr - 0.12) else l end", t="case when o = 'horizontal' and b - t < 0.12 then greatest(0.0, gb - 0.12) else t end", r="case when o = 'vertical' and r - l < 0.12 then gr else r end", b="case when o = 'horizontal' and b - t < 0.12 then gb else b end")} from g""",
    "hole_repair_context": _BASE + _HOLE + f"select {_K}, {_ints(l='cl', t='ct', r='cr', b='cb')} from h",
    "hole_paste_region": _BASE + _HOLE + f""", s as (select *, least(cr - cl, greatest(0.12, (r - l) * 3.0)) as tw, least(cb - ct, greatest(0.05, (b - t) * 2.0)) as th from h),
e as (select *, least(cr, greatest(cl, (l + r) / 2 - tw / 2) + tw) as pr, least(cb, greatest(ct, (t + b) / 2 - th / 2) + th) as pb from s)
select {_K}, {_ints(l='greatest(cl, pr - tw)', t='greatest(ct, pb - th)', r='pr', b='pb')} from e""",
    "quality_repair_region": _BASE + _QUALITY + f"select {_K}, {_ints(l='l', t='t', r='r', b='b')} from q where {_SHAPE}",
    "region_orientation": _BASE + f"select category, {_O} as orientation, count(*) as n from x group by all",
    "best_repair_region": _BASE + f""", f as (select *, row_number() over (partition by run_id, page_no, attempt_no order by rank desc, disc_no) as first from x where category in {REPAIRABLE})
select {_K}, {_ints(l='greatest(0.0, l - greatest(0.02, (r - l) * 0.25))', t='greatest(0.0, t - greatest(0.02, (b - t) * 0.5))', r='least(1.0, r + greatest(0.02, (r - l) * 0.25))', b='least(1.0, b + greatest(0.02, (b - t) * 0.5))')} from f where first = 1""",
    "region_overlap_pairs": _BASE + f'select run_id, page_no, attempt_no, a.disc_no as first, b.disc_no as second {_TWO} and not (a.r <= b.l or b.r <= a.l or a.b <= b.t or b.b <= a.t)',
    "same_quality_target_pairs": _BASE + f"""select run_id, page_no, attempt_no, a.disc_no as first, b.disc_no as second {_TWO} and {_OA} = {_OB} and
case when {_OA} = 'local' then least((a.r-a.l)*(a.b-a.t), (b.r-b.l)*(b.b-b.t)) > 0 and {_CW} * {_CH} >= least((a.r-a.l)*(a.b-a.t), (b.r-b.l)*(b.b-b.t)) * 0.6
 else {_CH} >= least(a.b-a.t, b.b-b.t) * 0.5 and {_CW} >= least(a.r-a.l, b.r-b.l) * 0.5 end""",
    "best_overlap_tile": _BASE + f""", y as (select {_K}, view, round(greatest(0.0, least(r, vr / 2480.0) - greatest(l, vl / 2480.0)) * greatest(0.0, least(b, vb / 3508.0) - greatest(t, vt / 3508.0)), 9) as area from x, ({_TILES}) where view > 0)
select {_K}, cast(view as int) as tile from (select *, row_number() over (partition by {_K} order by area desc, view) as rn from y) where rn = 1""",
    "combined_regions": f"""with recursive i as (select run_id, id, unnest([0, 1]) as side, unnest([restored_box, source_box]) as q from (select *, row_number() over (partition by run_id, id order by reviewed_at desc nulls last) as rn from lab_issues where run_id is not null and id is not null) where rn = 1),
b as (select run_id, q.x0 as l, q.y0 as t, q.x1 as r, q.y1 as b, row_number() over (partition by run_id order by side, id) as k from i where q.x0 is not null and q.y0 is not null and q.x1 is not null and q.y1 is not null),
f as (select distinct run_id, cast(0 as bigint) as k, cast([] as struct(l double, t double, r double, b double)[]) as kept from b
 union all select f.run_id, f.k + 1, case when len(list_filter(kept, lambda a: {_OA} = {_OB} and case when {_OA} = 'local' then least((a.r-a.l)*(a.b-a.t), (b.r-b.l)*(b.b-b.t)) > 0 and {_CW} * {_CH} >= least((a.r-a.l)*(a.b-a.t), (b.r-b.l)*(b.b-b.t)) * 0.6
  else {_CH} >= least(a.b-a.t, b.b-b.t) * 0.5 and {_CW} >= least(a.r-a.l, b.r-b.l) * 0.5 end)) = 0 then list_append(kept, struct_pack(l := b.l, t := b.t, r := b.r, b := b.b)) else kept end from f join b on b.run_id = f.run_id and b.k = f.k + 1),
z as (select run_id, kept from f qualify row_number() over (partition by run_id order by k desc) = 1),
y as (select run_id, unnest(kept) as x, cast(unnest(range(1, 1 + len(kept))) as int) as place from z)
select run_id, place, {_ints(l='x.l', t='x.t', r='x.r', b='x.b')} from y""",
    "quality_targets": _BASE.replace("with latest", "with recursive latest") + _QUALITY + f""", z as (select q.*, x.rank, row_number() over (partition by q.run_id, q.page_no, q.attempt_no order by x.rank desc, q.disc_no) as k from q join x using ({_K}) where {_SHAPE.replace('r-l', 'q.r-q.l').replace('b-t', 'q.b-q.t')}),
f as (select distinct run_id, page_no, attempt_no, cast(0 as bigint) as k, cast([] as struct(l double, t double, r double, b double)[]) as kept from z
 union all select f.run_id, f.page_no, f.attempt_no, f.k + 1, case when len(kept) >= 8 then kept when list_position(hits, true) is null or list_position(hits, true) = 0 then list_append(kept, struct_pack(l := nl, t := nt, r := nr, b := nb))
  else list_transform(kept, lambda a, i: case when i = list_position(hits, true) and (nr - nl) * (nb - nt) > (a.r - a.l) * (a.b - a.t) then struct_pack(l := nl, t := nt, r := nr, b := nb) else a end) end
 from (select f.*, b.l as nl, b.t as nt, b.r as nr, b.b as nb, list_transform(kept, lambda a: {_OA} = {_OB} and case when {_OA} = 'local' then least((a.r-a.l)*(a.b-a.t), (b.r-b.l)*(b.b-b.t)) > 0 and {_CW} * {_CH} >= least((a.r-a.l)*(a.b-a.t), (b.r-b.l)*(b.b-b.t)) * 0.6
  else {_CH} >= least(a.b-a.t, b.b-b.t) * 0.5 and {_CW} >= least(a.r-a.l, b.r-b.l) * 0.5 end) as hits from f join z b on b.run_id = f.run_id and b.page_no = f.page_no and b.attempt_no = f.attempt_no and b.k = f.k + 1) f),
e as (select run_id, page_no, attempt_no, kept from f qualify row_number() over (partition by run_id, page_no, attempt_no order by k desc) = 1),
y as (select run_id, page_no, attempt_no, unnest(kept) as x, cast(unnest(range(1, 1 + len(kept))) as int) as target_no from e)
select run_id, page_no, attempt_no, target_no, {_ints(l='x.l', t='x.t', r='x.r', b='x.b')} from y""",
    "context_matches": """with recursive i as (select run_id, id, restored_box as d, source_box as c from (select *, row_number() over (partition by run_id, id order by reviewed_at desc nulls last) as rn from lab_issues where run_id is not null and id is not null) where rn = 1),
s as (select run_id, list(struct_pack(id := id, x := (c.x0 + c.x1) / 2, y := (c.y0 + c.y1) / 2) order by id) as free from i where c.x0 is not null and c.y0 is not null and c.x1 is not null and c.y1 is not null group by 1),
b as (select run_id, id, (d.x0 + d.x1) / 2 as x, (d.y0 + d.y1) / 2 as y, row_number() over (partition by run_id order by id) as k from i where d.x0 is not null and d.y0 is not null and d.x1 is not null and d.y1 is not null),
f as (select run_id, cast(0 as bigint) as k, cast(null as int) as id, cast(null as int) as match, free from s
 union all select g.run_id, g.k, g.id, g.free[g.n].id, list_concat(g.free[:g.n - 1], g.free[g.n + 1:]) from (
  select f.run_id, b.k, cast(b.id as int) as id, f.free, list_position(list_transform(f.free, lambda o: (o.x - b.x) * (o.x - b.x) + (o.y - b.y) * (o.y - b.y)), list_min(list_transform(f.free, lambda o: (o.x - b.x) * (o.x - b.x) + (o.y - b.y) * (o.y - b.y)))) as n
  from f join b on b.run_id = f.run_id and b.k = f.k + 1 where len(f.free) > 0) g)
select run_id, id, cast(match as int) as match from f where k > 0""",
}
