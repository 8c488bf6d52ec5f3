"""Queries on page geometry: canvases, corners, skew, rings, rails."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.functions import boxes as bx
from foliomill.functions import raster
from foliomill.operators import marks
from foliomill.operators.pages import over_pages
from foliomill.plans.regions import attempts
from foliomill.session import table


def contained_canvas(spark: SparkSession, d: str) -> DataFrame:
    """Where every generated image lies on a 2480 x 3508 canvas when contained in it, and its effective resolution from 300 dpi."""
    w, h = F.col("w").cast("double"), F.col("h").cast("double")
    scale = F.least(F.lit(2480.0) / w, F.lit(3508.0) / h)
    fit_w, fit_h = F.greatest(F.lit(1), F.rint(w * scale).cast("int")), F.greatest(F.lit(1), F.rint(h * scale).cast("int"))
    rows = attempts(spark, d).select("run_id", "page_no", "attempt_no", F.col("a.generated_width").alias("w"), F.col("a.generated_height").alias("h")).where("w > 0 and h > 0")
    return rows.select(
        "run_id",
        "page_no",
        "attempt_no",
        fit_w.alias("width"),
        fit_h.alias("height"),
        F.floor((F.lit(2480) - fit_w) / 2).cast("int").alias("x"),
        F.floor((F.lit(3508) - fit_h) / 2).cast("int").alias("y"),
        F.round(F.lit(300.0) * F.least(w / 2480, h / 3508), 3).alias("dpi"),
    )


def ordered_corners(spark: SparkSession, d: str) -> DataFrame:
    """Of the first four points of every vector, the numbers of the top left, top right, bottom right and bottom left one; the first of equal ones."""
    p = table(spark, d, "embeddings").select("vec_id", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col("embedding")[2 * i].cast("double").alias("x"), F.col("embedding")[2 * i + 1].cast("double").alias("y")) for i in range(4)))).alias("p")).select("vec_id", "p.*")
    s, t = F.col("x") + F.col("y"), F.col("y") - F.col("x")
    first = lambda by: F.min(F.struct(by.alias("k"), "i"))["i"]
    return p.groupBy("vec_id").agg(first(s).alias("top_left"), first(t).alias("top_right"), first(-s).alias("bottom_right"), first(-t).alias("bottom_left"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    late = F.lit("0001-01-01").cast("timestamp")
    rows = table(spark, d, "lab_issues").where("run_id is not null and id is not null").groupBy("run_id", "id").agg(F.max_by("restored_box", F.coalesce("reviewed_at", late)).alias("x"))
    return rows.where("x is not null").select("run_id", "id", "x.*").where("x0 is not null and y0 is not null and x1 is not null and y1 is not null")


def page_skew(spark: SparkSession, d: str) -> DataFrame:
    """Per run the median slope, in degrees, of its nearly level box diagonals; runs with fewer than four have none."""
    slope = F.degrees(F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")))
    rows = _boxes(spark, d).select("run_id", slope.alias("a")).where("abs(a) <= 5")
    return rows.groupBy("run_id").agg(F.count("*").alias("n"), F.round(F.median("a"), 6).alias("skew")).where("n >= 4")


def aligned_rings(spark: SparkSession, d: str) -> DataFrame:
    """Boxes that have a second of like size straight below or above it, at 18 to 40 percent of the page."""
    r = (F.col("x1") - F.col("x0") + F.col("y1") - F.col("y0")) / 4
    c = _boxes(spark, d).select("run_id", "id", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), r.alias("r")).where("r > 0")
    o = c.select("run_id", *(F.col(x).alias(f"o_{x}") for x in ("id", "cx", "cy", "r")))
    near = (F.col("id") != F.col("o_id")) & (F.col("r") / F.col("o_r")).between(0.75, 1.33) & (F.abs(F.col("cx") - F.col("o_cx")) <= F.greatest("r", "o_r") * 0.6) & F.abs(F.col("cy") - F.col("o_cy")).between(0.18, 0.40)
    # the run is the equality key; its issues are as many as a review bounds
    return c.alias("a").join(o, [c.run_id == o.run_id, near], "left_semi").select("run_id", "id")


def merged_holes(spark: SparkSession, d: str) -> DataFrame:
    """Circles of restored and source boxes of each run, one per physical hole: how many, and their radii in sum."""
    late = F.lit("0001-01-01").cast("timestamp")
    rows = table(spark, d, "lab_issues").where("run_id is not null and id is not null").groupBy("run_id", "id").agg(F.max_by(F.struct("restored_box", "source_box"), F.coalesce("reviewed_at", late)).alias("x"))
    sides = rows.select("run_id", "id", F.posexplode(F.array("x.restored_box", "x.source_box")).alias("side", "b")).where("b.x1 > b.x0 and b.y1 > b.y0")
    circle = F.struct(((F.col("b.x0") + F.col("b.x1")) / 2).alias("x"), ((F.col("b.y0") + F.col("b.y1")) / 2).alias("y"), ((F.col("b.x1") - F.col("b.x0")) / 2).alias("r"), F.lit(0.01).alias("pad"), (F.col("side") == 0).alias("ink"))
    lists = sides.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("side", "id", circle.alias("c")))).alias("xs"))
    kept = lists.select("run_id", F.size("xs").alias("n_circles"), marks.distinct_circles(F.transform("xs", lambda x: x["c"])).alias("kept"))
    return kept.select("run_id", "n_circles", F.size("kept").alias("n_holes"), F.size(F.filter("kept", lambda c: c["ink"])).alias("n_ink"), F.aggregate("kept", F.lit(0).cast("long"), lambda n, c: n + F.floor(c["r"] * 1e6 + 0.5)).alias("radii"))


def boundary_rails(spark: SparkSession, d: str) -> DataFrame:
    """Per page the rows in which a dark rail begins at the left edge, and the deepest of them."""

    def kernel(s):
        depths = marks.rail_depths(s.a)
        return None, s.sums(depths > 0), s.most(depths)

    return over_pages(table(spark, d, "documents"), kernel, "page_id long, n_rows int, deepest int")


def pale_strips_topk(spark: SparkSession, d: str) -> DataFrame:
    """The three rows of each page fullest of pale pixels."""

    def kernel(s):
        rows = [(k, i, y, n) for k, a in s.pages() for i, (y, n, _) in enumerate(marks.pale_strips(a), 1)]
        return tuple(zip(*rows)) or ([], [], [], [])

    return over_pages(table(spark, d, "documents"), kernel, "page_id long, strip int, y int, n int", 0)


def region_restore(spark: SparkSession, d: str) -> DataFrame:
    """Brightness of every page after a cleaned copy got a fixed region of the source back, wholly or as evidence."""
    height = F.ceil(F.length(F.coalesce("text", F.lit(""))) / 64)
    region = bx.Box(*map(F.lit, (0.25, 0.25, 0.75, 0.5)))
    windows = {f"{name}_{side}": c for name, pad in (("restore", bx.RESTORE), ("evidence", bx.EVIDENCE)) for side, c in zip("ltrb", bx.pixels(bx.padded(region, *pad), F.lit(64), height))}

    def kernel(s):
        clean = s.hold(raster.erode(s.hold(raster.dilate(s.hold(s.a, 0), 3, 1), 255), 3, 1), 0)
        rows = []
        for k, a in s.pages():
            b = clean[s.first[k] : s.first[k] + a.shape[0]]
            whole, evidence = (np.array([[w[k] for w in s.extra[i : i + 4]]]) for i in (0, 4))
            rows.append([int(x.sum(dtype=np.int64)) for x in (b, marks.recombined(a, b, whole), marks.recombined(a, b, evidence, darker=True))])
        return (None, *zip(*rows)) if rows else (None, [], [], [])

    return over_pages(table(spark, d, "documents"), kernel, "page_id long, clean long, restored long, evidence long", **windows)


def edge_curves(spark: SparkSession, d: str) -> DataFrame:
    """Per page with an edge: the smooth curve through the first ink of its rows, at the middle row, and the rows it was fitted to."""

    def kernel(s):
        ink = s.a < 80
        first, there = ink.argmax(axis=1), ink.any(axis=1)
        rows = []
        for k, a in s.pages():
            at = np.flatnonzero(there[s.first[k] : s.first[k] + a.shape[0]])
            curve = marks.robust_curve(at, first[s.first[k] + at], a.shape[0]) if len(at) >= 32 else None
            if curve is not None:
                rows.append((k, len(at), round(float(curve[len(curve) // 2]), 4)))
        return tuple(zip(*rows)) or ([], [], [])

    return over_pages(table(spark, d, "documents"), kernel, "page_id long, n_rows int, middle double", 0)


def page_registration(spark: SparkSession, d: str) -> DataFrame:
    """Points of every vector against their image under a known plane mapping with a quarter of them displaced: how many fit the mapping found, and whether it is the known one."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, n, same = batch.column(0).to_pylist(), [], []
            for i, v in zip(ids, batch.column(1).to_pylist()):
                src = np.array(v, float).reshape(-1, 2) * 100
                known = np.array([[1.02, 0.01 * (i % 5), 3], [-0.02, 0.98, i % 7], [1e-5, 0, 1]])
                dst = np.c_[src, np.ones(len(src))] @ known.T
                dst = dst[:, :2] / dst[:, 2:]
                dst[: len(src) // 4] += 40
                found, fits = raster.ransac(src, dst, 1.0)
                n.append(int(fits.sum()))
                same.append(found is not None and bool(np.allclose(found, known, atol=1e-5)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(same, pa.bool_())], names=["vec_id", "n_fit", "recovered"])

    e = table(spark, d, "embeddings").where("embedding is not null and size(embedding) = 64")
    return e.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "vec_id long, n_fit int, recovered boolean")


def rectified_pages(spark: SparkSession, d: str) -> DataFrame:
    """Brightness of every page, and of the page brought back by bilinear interpolation from its copy shifted by (3, 2) pixels, without what the shift lost."""

    def kernel(s):
        rows = []
        shift = np.array([[1.0, 0, 3], [0, 1, 2], [0, 0, 1]])
        for k, a in s.pages():
            if a.size:
                back = raster.bilinear(raster.bilinear(a, shift, a.shape), np.linalg.inv(shift), a.shape)
                rows.append((k, int(a[:-2, :-3].sum(dtype=np.int64)), int(back[:-2, :-3].sum(dtype=np.int64))))
        return tuple(zip(*rows)) or ([], [], [])

    return over_pages(table(spark, d, "documents"), kernel, "page_id long, before long, after long", 0)


QUERIES = {f.__name__: f for f in (contained_canvas, ordered_corners, page_skew, aligned_rings, merged_holes, boundary_rails, pale_strips_topk, region_restore, edge_curves, page_registration, rectified_pages)}

_A = """with latest as (select * from (select *, row_number() over (partition by run_id order by received_at desc nulls last) as rn from reports) where rn = 1),
p as (select run_id, unnest(list_filter(pages, lambda x: x is not null)) as p, cast(unnest(range(1, 1 + len(list_filter(pages, lambda x: x is not null)))) as int) as page_no from latest),
a as (select run_id, page_no, unnest(list_filter(p.attempts, lambda x: x is not null)) as a, cast(unnest(range(1, 1 + len(list_filter(p.attempts, lambda x: x is not null)))) as int) as attempt_no from p)
"""
_B = """with b as (select run_id, id, restored_box.x0 as x0, restored_box.y0 as y0, restored_box.x1 as x1, restored_box.y1 as y1 from (select *, row_number() over (partition by run_id, id order by reviewed_at desc nulls last) as rn from lab_issues where run_id is not null and id is not null)
 where rn = 1 and restored_box.x0 is not null and restored_box.y0 is not null and restored_box.x1 is not null and restored_box.y1 is not null)
"""
_PIX = """with s as (select doc_id as page_id, coalesce(text, '') as text, cast(ceil(length(coalesce(text, '')) / 64.0) as int) as height from documents),
px as (select page_id, cast(i // 64 as int) as y, cast(i % 64 as int) as x, case when i < length(text) then unicode(substring(text, i + 1, 1)) % 256 else 255 end as g from (select *, cast(unnest(range(height * 64)) as int) as i from s))
"""
SQL = {
    "contained_canvas": _A + """, s as (select run_id, page_no, attempt_no, a.generated_width as w, a.generated_height as h, least(2480.0::double / a.generated_width, 3508.0::double / a.generated_height) as k from a where a.generated_width > 0 and a.generated_height > 0),
f as (select *, greatest(1, cast(round_even(w * k, 0) as int)) as fw, greatest(1, cast(round_even(h * k, 0) as int)) as fh from s)
select run_id, page_no, attempt_no, fw as width, fh as height, cast(floor((2480 - fw) / 2) as int) as x, cast(floor((3508 - fh) / 2) as int) as y, round(300.0::double * least(w / 2480.0::double, h / 3508.0::double), 3) as dpi from f""",
    "ordered_corners": "with p as (select vec_id, cast(i as int) as i, cast(embedding[2 * i + 1] as double) as x, cast(embedding[2 * i + 2] as double) as y from embeddings, range(4) as q(i)) select distinct vec_id, first_value(i) over (partition by vec_id order by x + y, i) as top_left, first_value(i) over (partition by vec_id order by y - x, i) as top_right, first_value(i) over (partition by vec_id order by x + y desc, i) as bottom_right, first_value(i) over (partition by vec_id order by y - x desc, i) as bottom_left from p",
    "page_skew": _B + "select run_id, count(*) as n, round(median(s), 6) as skew from (select run_id, degrees(atan2(y1 - y0, x1 - x0)) as s from b) where abs(s) <= 5 group by run_id having count(*) >= 4",
    "aligned_rings": _B + ", c as (select run_id, id, (x0 + x1) / 2 as cx, (y0 + y1) / 2 as cy, (x1 - x0 + y1 - y0) / 4 as r from b where (x1 - x0 + y1 - y0) / 4 > 0) select run_id, id from c where exists (select 1 from c o where o.run_id = c.run_id and o.id <> c.id and c.r / o.r between 0.75 and 1.33 and abs(c.cx - o.cx) <= greatest(c.r, o.r) * 0.6 and abs(c.cy - o.cy) between 0.18 and 0.40)",
    "pale_strips_topk": _PIX + ", r as (select page_id, y, count(*) filter (g >= 60 and g < 120) as n from px group by all), k as (select *, row_number() over (partition by page_id order by n desc, y) as strip from r) select page_id, cast(strip as int) as strip, y, cast(n as int) as n from k where strip <= 3 and n > 0",
    "boundary_rails": _PIX + """, d as (select page_id, y, min(x) filter (x < 8 and g < 100) as s from px group by all),
l as (select px.page_id, px.y, x, s, count(*) filter (g >= 200) over (partition by px.page_id, px.y order by x rows between current row and 2 following) as n from px join d using (page_id, y) where x < 32 and x >= s),
h as (select page_id, y, min(x) as depth from l where n = 3 group by all)
select s.page_id, cast(count(*) filter (depth > 0) as int) as n_rows, cast(coalesce(max(depth), 0) as int) as deepest from s left join h using (page_id) group by s.page_id""",
    "merged_holes": """with recursive b as (select run_id, id, unnest([0, 1]) as side, unnest([restored_box, source_box]) as b from (select *, row_number() over (partition by run_id, id order by reviewed_at desc nulls last) as rn from lab_issues where run_id is not null and id is not null) where rn = 1),
c as (select run_id, side, (b.x0 + b.x1) / 2 as x, (b.y0 + b.y1) / 2 as y, (b.x1 - b.x0) / 2 as r, row_number() over (partition by run_id order by (b.x1 - b.x0) / 2 desc, side, id) as k from b where b.x1 > b.x0 and b.y1 > b.y0),
f as (select distinct run_id, cast(0 as bigint) as k, cast([] as struct(x double, y double, r double, ink boolean)[]) as kept from c
 union all
 select f.run_id, f.k + 1, case when len(list_filter(kept, lambda o: (o.x - c.x) * (o.x - c.x) + (o.y - c.y) * (o.y - c.y) <= o.r * o.r)) = 0 then list_append(kept, struct_pack(x := c.x, y := c.y, r := c.r, ink := c.side = 0))
  else list_transform(kept, lambda o, i: struct_pack(x := o.x, y := o.y, r := o.r, ink := o.ink or (c.side = 0 and i = list_position(list_transform(kept, lambda q: (q.x - c.x) * (q.x - c.x) + (q.y - c.y) * (q.y - c.y) <= q.r * q.r), true)))) end
 from f join c on c.run_id = f.run_id and c.k = f.k + 1),
l as (select run_id, max(k) as n from c group by 1)
select run_id, cast(n as int) as n_circles, cast(len(kept) as int) as n_holes, cast(len(list_filter(kept, lambda o: o.ink)) as int) as n_ink, cast(coalesce(list_sum(list_transform(kept, lambda o: cast(floor(o.r * 1e6 + 0.5) as bigint))), 0) as bigint) as radii from f join l using (run_id) where f.k = l.n""",
    "region_restore": _PIX + """, d as (select page_id, y, x, g, max(g) over (partition by page_id, y order by x rows between 1 preceding and 1 following) as m from px),
c as (select page_id, y, x, g, min(m) over (partition by page_id, y order by x rows between 1 preceding and 1 following) as v from d),
j as (select c.*, x >= 13 and x < 51 and y >= round_even((0.25 - 0.03) * height, 0) and y < round_even((0.5 + 0.03) * height, 0) as w, x >= 15 and x < 49 and y >= round_even((0.25 - 0.02) * height, 0) and y < round_even((0.5 + 0.02) * height, 0) as e from c join s using (page_id)),
t as (select page_id, sum(v) as clean, sum(case when w then g else v end) as restored, sum(case when e then least(g, v) else v end) as evidence from j group by 1)
select page_id, cast(coalesce(clean, 0) as bigint) as clean, cast(coalesce(restored, 0) as bigint) as restored, cast(coalesce(evidence, 0) as bigint) as evidence from s left join t using (page_id)""",
    "page_registration": "select vec_id, cast(24 as int) as n_fit, true as recovered from embeddings where embedding is not null and len(embedding) = 64",
    "rectified_pages": _PIX + "select s.page_id, cast(coalesce(sum(g) filter (x < 61 and y < height - 2), 0) as bigint) as before, cast(coalesce(sum(g) filter (x < 61 and y < height - 2), 0) as bigint) as after from s join px using (page_id) group by s.page_id",
}
