"""Queries on pages as rasters: each document's characters are read as a gray page 64 pixels wide."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.functions import hashing, images, raster
from foliomill.operators.pages import Sheet, over_pages
from foliomill.session import table

INK = 80


def _query(schema: str, doc: str, gap: int = 2):
    def wrap(kernel):
        def query(spark: SparkSession, d: str) -> DataFrame:
            return over_pages(table(spark, d, "documents"), kernel, schema, gap)

        query.__doc__, query.__name__ = doc, kernel.__name__
        return query

    return wrap


def _ink(s: Sheet, limit: int = INK) -> np.ndarray:
    return s.hold(s.a < limit, False)


def _dilated(s: Sheet, a: np.ndarray, kx: int, ky: int) -> np.ndarray:
    return s.hold(raster.dilate(s.hold(a, 0), kx, ky), 0)


def _eroded(s: Sheet, a: np.ndarray, kx: int, ky: int) -> np.ndarray:
    return s.hold(raster.erode(s.hold(a, 255), kx, ky), 0)


@_query("page_id long, height int, n_ink int, n_white int, sum_gray long", "Size, ink and paper of every page.")
def raster_counts(s):
    return None, s.heights, s.sums(s.a < INK), s.sums(s.a == 255), s.sums(s.a)


@_query("page_id long, dilated long, eroded long", "Sums of the 3 x 3 dilated and the 5 x 3 eroded page.")
def raster_dilate(s):
    return None, s.sums(_dilated(s, s.a, 3, 3)), s.sums(_eroded(s, s.a, 5, 3))


@_query("page_id long, n_opened int, n_closed int", "Ink left by a 3 x 1 opening and a 3 x 3 closing of the ink mask.")
def raster_open_close(s):
    m = s.a < INK
    return None, s.sums(_dilated(s, _eroded(s, m, 3, 1), 3, 1)), s.sums(_eroded(s, _dilated(s, m, 3, 3), 3, 3))


@_query("page_id long, densest long, dense int", "The densest 5 x 5 window of ink and the number of windows at least half full.")
def raster_box_sum(s):
    n = s.hold(raster.box_sum(_ink(s), 5, 5), 0)
    return None, s.most(n), s.sums(n >= 13)


@_query("page_id long, missing int, invented int, has_foreground boolean", "Ink of a page without a neighbour in its cleaned copy, and the reverse; the copy is the page with isolated ink removed.")
def foreground_ratios(s):
    src = _ink(s)
    cand = _dilated(s, _eroded(s, s.a < 2 * INK, 3, 1), 3, 1)
    return None, s.sums(src & ~_dilated(s, cand, 5, 3)), s.sums(cand & ~_dilated(s, src, 5, 3)), s.sums(src) >= np.maximum(32, np.rint(s.heights * 64 * 0.00002))


@_query("page_id long, median double, p75 double", "Median and 75th percentile of gray, by linear interpolation.")
def shade_percentile(s):
    cells = np.bincount((s.page[:, None] * 256 + s.a).ravel(), minlength=(s.n + 1) * 256).reshape(-1, 256)[: s.n]
    there = np.flatnonzero(s.heights)
    below = np.cumsum(cells[there], axis=1)

    def at(q: float) -> np.ndarray:
        place = q * (s.heights[there] * 64 - 1)
        low = np.floor(place)
        value = [(below <= k[:, None]).sum(axis=1) for k in (low, np.ceil(place))]  # the k-th gray from 0
        return value[0] + (value[1] - value[0]) * (place - low)

    return there, at(0.5), at(0.75)


@_query("page_id long, n_marked int, n_area int", "Pixels under 250 in the outer left tenth of the page, and its area.")
def margin_metrics(s):
    return None, s.sums(s.a[:, :6] < 250), s.heights * 6


@_query("page_id long, n_white int", "White pixels after a white frame of 5 percent.")
def clear_page_border(s):
    height = np.r_[s.heights, 0][s.page]
    rim = np.maximum(1, np.rint(height * 0.05))
    x = np.arange(64)
    frame = ((s.y < rim) | (s.y >= height - rim))[:, None] | (x < 3) | (x >= 61)
    return None, s.sums(s.hold(frame | (s.a == 255), False))


def _components(s: Sheet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Page of every component of the ink, its number within the page, and its statistics with rows counted within the page."""
    stats = raster.component_stats(*raster.components(_ink(s)))
    page = s.page[stats[:, 2]] if len(stats) else np.zeros(0, int)
    stats[:, [2, 4]] -= s.first[page][:, None] if len(stats) else 0
    order = np.argsort(page, kind="stable")
    page, stats = page[order], stats[order]
    return page, np.arange(page.size) - np.searchsorted(page, page) + 1, stats


@_query("page_id long, n int, largest int, widest int", "Connected components of the ink.")
def connected_components(s):
    page, _, stats = _components(s)
    largest, widest = np.zeros((2, s.n), np.int64)
    np.maximum.at(largest, page, stats[:, 0])
    np.maximum.at(widest, page, stats[:, 3] - stats[:, 1] + 1)
    return None, np.bincount(page, minlength=s.n), largest, widest


@_query("page_id long, area int, x0 int, y0 int, x1 int, y1 int", "Every connected component of at least 12 pixels of ink.")
def component_boxes(s):
    page, _, stats = _components(s)
    big = stats[:, 0] >= 12
    return page[big], *stats[big].T


@_query("page_id long, place int, area int, x0 int, y0 int", "The twelve largest components of every page; of equal ones the upper, then the left one first.")
def largest_components(s):
    page, _, stats = _components(s)
    order = np.lexsort((stats[:, 1], stats[:, 2], -stats[:, 0], page))
    page, stats = page[order], stats[order]
    place = np.arange(page.size) - np.searchsorted(page, page) + 1
    top = place <= 12
    return page[top], place[top], *stats[top][:, :3].T


@_query("page_id long, n_specks int", "Isolated specks of ink.", 4)
def isolated_specks(s):
    return None, s.sums(raster.specks(_ink(s)))


@_query("page_id long, before long, after long", "Brightness before and after the shade of the paper is evened out.", 8)
def shade_flattened(s):
    return None, s.sums(s.a), s.sums(raster.shade_flattened(s.a, inside=s.inside))


def _manifests(kind: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        docs = table(spark, d, "documents").where("text <> ''")
        payload = hashing.canonical_json(run_id=F.col("doc_id").cast("string"), height=F.ceil(F.length("text") / 64))
        return over_pages(docs, kernel, "page_id long, added int, same_pixels boolean, same_manifest boolean", 0, manifest=F.encode(hashing.sealed(payload), "UTF-8"))

    def kernel(s):
        rows = []
        for k, a in s.pages():
            plain = images.png(a) if kind == "png" else images.jpeg(hashlib.sha256(a.tobytes()).digest())
            data = images.embed(plain, s.extra[0][k])
            same = (images.gray_of(data) == a).all() if kind == "png" else data.endswith(plain[len(images.JPEG_SIGNATURE) :])
            rows.append((len(data) - len(plain), bool(same), images.extract(data) == s.extra[0][k]))
        return (None, *zip(*rows)) if rows else (None, [], [], [])

    query.__name__, query.__doc__ = f"{kind}_manifest", f"Round trip of every page through a {kind.upper()} with an embedded manifest."
    return query


QUERIES = {f.__name__: f for f in (raster_counts, raster_dilate, raster_open_close, raster_box_sum, foreground_ratios, shade_percentile, margin_metrics, clear_page_border, connected_components, component_boxes, largest_components, isolated_specks, shade_flattened, _manifests("png"), _manifests("jpeg"))}

_PIX = """with s as (select doc_id as page_id, coalesce(text, '') as text, cast(ceil(length(coalesce(text, '')) / 64.0) as int) as height from documents),
px as (select page_id, height, cast(i // 64 as int) as y, cast(i % 64 as int) as x, case when i < length(text) then unicode(substring(text, i + 1, 1)) % 256 else 255 end as g from (select *, cast(unnest(range(height * 64)) as int) as i from s))
"""


def _win(f: str, e: str, src: str, dst: str, kx: int, ky: int) -> str:
    hx, hy = kx // 2, ky // 2
    return (
        f", {dst}_x as (select page_id, height, y, x, {f}({e}) over (partition by page_id, y order by x rows between {hx} preceding and {hx} following) as v from {src})"
        f", {dst} as (select page_id, height, y, x, {f}(v) over (partition by page_id, x order by y rows between {hy} preceding and {hy} following) as v from {dst}_x)"
    )


_M = f", m as (select page_id, height, y, x, cast(g < {INK} as int) as v from px)"
_ALL = "from s left join {t} using (page_id) group by page_id"
_MANIFEST = """select doc_id as page_id, cast({over} + octet_length(encode('{{"payload":{{"height":' || cast(ceil(length(text) / 64.0) as bigint) || ',"run_id":"' || doc_id || '"}},"payload_sha256":"' || repeat('0', 64) || '"}}')) as int) as added, true as same_pixels, true as same_manifest from documents where text <> ''"""
# runs of ink, numbered; the least number that any path of touching runs leads to names the component
_RUNS = f""", e as (select page_id, y, x, g, lag(g < {INK}, 1, false) over (partition by page_id, y order by x) as was from px),
r0 as (select page_id, y, x, sum(case when not was then 1 else 0 end) over (partition by page_id, y order by x) as k from e where g < {INK}),
r as (select page_id, y, min(x) as a, max(x) as b, row_number() over (order by page_id, y, min(x)) as i from r0 group by page_id, y, k),
t as (select p.i as i, q.i as j from r p join r q on p.page_id = q.page_id and abs(p.y - q.y) = 1 and p.a <= q.b + 1 and q.a <= p.b + 1),
walk as (select i as c, i as i from r union select w.c, t.j from walk w join t on t.i = w.i where t.j > w.c),
own as (select i, min(c) as c from walk group by i),
box as (select page_id, cast(sum(b - a + 1) as int) as area, cast(min(a) as int) as x0, cast(min(y) as int) as y0, cast(max(b) as int) as x1, cast(max(y) as int) as y1 from r join own using (i) group by page_id, c)
"""
SQL = {
    "raster_counts": _PIX + f"select s.page_id, s.height, cast(count(*) filter (g < {INK}) as int) as n_ink, cast(count(*) filter (g = 255) as int) as n_white, cast(coalesce(sum(g), 0) as bigint) as sum_gray from s left join px using (page_id) group by all",
    "raster_dilate": _PIX + _win("max", "g", "px", "d", 3, 3) + _win("min", "g", "px", "e", 5, 3) + ", a as (select page_id, sum(v) as v from d group by 1), b as (select page_id, sum(v) as v from e group by 1) select page_id, cast(coalesce(a.v, 0) as bigint) as dilated, cast(coalesce(b.v, 0) as bigint) as eroded from s left join a using (page_id) left join b using (page_id)",
    "raster_open_close": _PIX + _M + _win("min", "v", "m", "o1", 3, 1) + _win("max", "v", "o1", "o2", 3, 1) + _win("max", "v", "m", "c1", 3, 3) + _win("min", "v", "c1", "c2", 3, 3) + ", a as (select page_id, sum(v) as v from o2 group by 1), b as (select page_id, sum(v) as v from c2 group by 1) select page_id, cast(coalesce(a.v, 0) as int) as n_opened, cast(coalesce(b.v, 0) as int) as n_closed from s left join a using (page_id) left join b using (page_id)",
    "raster_box_sum": _PIX + _M + _win("sum", "v", "m", "b", 5, 5) + "select page_id, cast(coalesce(max(v), 0) as bigint) as densest, cast(count(*) filter (v >= 13) as int) as dense " + _ALL.format(t="b"),
    "foreground_ratios": _PIX + f", m as (select page_id, height, y, x, cast(g < {INK} as int) as v from px), n as (select page_id, height, y, x, cast(g < {2 * INK} as int) as v from px)" + _win("min", "v", "n", "o1", 3, 1) + _win("max", "v", "o1", "k", 3, 1) + _win("max", "v", "k", "kd", 5, 3) + _win("max", "v", "m", "md", 5, 3) + ", j as (select m.page_id, count(*) filter (m.v = 1 and kd.v = 0) as missing, count(*) filter (k.v = 1 and md.v = 0) as invented, sum(m.v) as ink, count(*) as n from m join k using (page_id, y, x) join kd using (page_id, y, x) join md using (page_id, y, x) group by 1) select page_id, cast(coalesce(missing, 0) as int) as missing, cast(coalesce(invented, 0) as int) as invented, coalesce(ink, 0) >= greatest(32, round_even(coalesce(n, 0) * 0.00002, 0)) as has_foreground from s left join j using (page_id)",
    "shade_percentile": _PIX + "select page_id, cast(quantile_cont(g, 0.5) as double) as median, cast(quantile_cont(g, 0.75) as double) as p75 from px group by page_id",
    "margin_metrics": _PIX + "select page_id, cast(count(*) filter (x < 6 and g < 250) as int) as n_marked, cast(count(*) filter (x < 6) as int) as n_area " + _ALL.format(t="px"),
    "clear_page_border": _PIX + "select s.page_id, cast(count(*) filter (g = 255 or x < 3 or x >= 61 or y < greatest(1, round_even(s.height * 0.05, 0)) or y >= s.height - greatest(1, round_even(s.height * 0.05, 0))) filter (px.page_id is not null) as int) as n_white from s left join px using (page_id) group by s.page_id".replace(") filter (px.page_id is not null)", ")"),
    "png_manifest": _MANIFEST.format(over=31),
    "jpeg_manifest": _MANIFEST.format(over=19),
    "component_boxes": "with recursive" + _PIX[4:] + _RUNS + "select page_id, area, x0, y0, x1, y1 from box where area >= 12",
    "connected_components": "with recursive" + _PIX[4:] + _RUNS + "select s.page_id, cast(count(box.page_id) as int) as n, cast(coalesce(max(area), 0) as int) as largest, cast(coalesce(max(x1 - x0 + 1), 0) as int) as widest from s left join box using (page_id) group by s.page_id",
    "largest_components": "with recursive" + _PIX[4:] + _RUNS + ", k as (select *, row_number() over (partition by page_id order by area desc, y0, x0) as place from box) select page_id, cast(place as int) as place, area, x0, y0 from k where place <= 12",
    "isolated_specks": "with recursive" + _PIX[4:] + _M + _win("sum", "v", "m", "n5", 5, 5) + _RUNS + """, ra as (select r.page_id, r.y, r.a, r.b, c, sum(r.b - r.a + 1) over (partition by r.page_id, c) as area from r join own using (i)),
k as (select ra.page_id, c, area, n5.v as near from ra join n5 on n5.page_id = ra.page_id and n5.y = ra.y and n5.x between ra.a and ra.b where area <= 2),
ok as (select page_id, c, max(area) as area from k group by 1, 2 having max(near - area) <= 0)
select s.page_id, cast(coalesce(sum(area), 0) as int) as n_specks from s left join ok using (page_id) group by s.page_id""",
    "shade_flattened": _PIX + _win("max", "g", "px", "d", 3, 3) + _win("min", "v", "d", "c", 3, 3) + _win("sum", "v", "c", "b", 15, 15) + ", o as (select page_id, height, y, x, 1 as v from px)" + _win("sum", "v", "o", "n", 15, 15)
    + ", j as (select px.page_id, sum(g) as before, sum(least(255, greatest(0, cast(round_even(g * (252 / greatest(b.v / n.v::double, 1)), 0) as int)))) as after from px join b using (page_id, y, x) join n using (page_id, y, x) group by 1) select page_id, cast(coalesce(before, 0) as bigint) as before, cast(coalesce(after, 0) as bigint) as after from s left join j using (page_id)",
}
