"""Box algebra in page coordinates (0..1) as Column expressions.

A box is four columns (l, t, r, b).  Nothing is clamped unless a rule says so, and
reversed boxes keep their sign: size tests sort them out later.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F



class Box(NamedTuple):
    l: Column  # noqa: E741
    t: Column
    r: Column
    b: Column

    @property
    def w(self) -> Column:
        return self.r - self.l

    @property
    def h(self) -> Column:
        return self.b - self.t

    def scaled(self, prefix: str = "") -> list[Column]:
        """Columns l, t, r, b in millionths of the page, rounded half up."""
        return [F.floor(c * 1e6 + 0.5).cast("long").alias(prefix + n) for c, n in zip(self, "ltrb")]


def box(prefix: str = "") -> Box:
    return Box(*(F.col(prefix + c) for c in "ltrb"))


def between(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def footer_widened(x: Box, limit: float = 0.94) -> Box:
    """A box that reaches into the page's foot becomes the full-width foot."""
    foot = x.b > limit
    return Box(F.when(foot, F.lit(0.0)).otherwise(x.l), F.when(foot, F.least(x.t, F.lit(limit))).otherwise(x.t), F.when(foot, F.lit(1.0)).otherwise(x.r), F.when(foot, F.lit(1.0)).otherwise(x.b))


def orientation(x: Box) -> Column:
    """horizontal or vertical for a thin long box, else local."""
    return F.when((x.h <= 0.12) & (x.w >= 0.20), "horizontal").when((x.w <= 0.12) & (x.h >= 0.20), "vertical").otherwise("local")


def quality_target(x: Box) -> tuple[Box, Column]:
    """The padded repair box of a quality finding, snapped to near page edges, and whether its shape is eligible."""
    pad_x, pad_y = between(x.w * 0.08, F.lit(0.01), F.lit(0.03)), between(x.h * 0.50, F.lit(0.01), F.lit(0.04))
    inward = F.lit(0.005)

    def low(edge: Column, far: Column, pad: Column) -> Column:
        far_pad = F.when(far >= 0.97, F.least(pad, inward)).otherwise(pad)
        return F.when(edge <= 0.03, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), edge - far_pad))

    def high(edge: Column, near: Column, pad: Column) -> Column:
        near_pad = F.when(near <= 0.03, F.least(pad, inward)).otherwise(pad)
        return F.when(edge >= 0.97, F.lit(1.0)).otherwise(F.least(F.lit(1.0), edge + near_pad))

    out = Box(low(x.l, x.r, pad_x), low(x.t, x.b, pad_y), high(x.r, x.l, pad_x), high(x.b, x.t, pad_y))
    w, h = out.w, out.h
    too_big = (w * h > 0.15) | ((w > 0.25) & (h > 0.25)) | ((w > 0.75) & (h > 0.10)) | ((h > 0.65) & (w > 0.10)) | ((w > 0.55) & (h > 0.15)) | ((h > 0.55) & (w > 0.15))
    return out, (x.w > 0) & (x.h > 0) & ~too_big


def _grown(low: Column, high: Column, size: Column, floor: Column, ceil: Column) -> tuple[Column, Column]:
    """An interval of the size around the middle of (low, high), moved inside [floor, ceil]."""
    start = F.greatest(floor, (low + high) / 2 - size / 2)
    end = F.least(ceil, start + size)
    return F.greatest(floor, end - size), end


def quality_context(x: Box, least: float = 0.12) -> Box:
    """A thin box grown to the least thickness."""
    o, size = orientation(x), F.lit(least)
    t, b = _grown(x.t, x.b, size, F.lit(0.0), F.lit(1.0))
    left, r = _grown(x.l, x.r, size, F.lit(0.0), F.lit(1.0))
    thin_h, thin_w = (o == "horizontal") & (x.h < least), (o == "vertical") & (x.w < least)
    return Box(F.when(thin_w, left).otherwise(x.l), F.when(thin_h, t).otherwise(x.t), F.when(thin_w, r).otherwise(x.r), F.when(thin_h, b).otherwise(x.b))


def hole_context(x: Box) -> Box:
    """The reference area around a hole."""
    left, r = _grown(x.l, x.r, F.greatest(x.w, F.lit(0.36)), F.lit(0.0), F.lit(1.0))
    t, b = _grown(x.t, x.b, F.greatest(x.h, F.lit(0.12)), F.lit(0.0), F.lit(1.0))
    return Box(left, t, r, b)


def hole_paste(context: Box, x: Box) -> Box:
    """The area pasted over a hole, inside its context."""
    left, r = _grown(x.l, x.r, F.least(context.w, F.greatest(F.lit(0.12), x.w * 3.0)), context.l, context.r)
    t, b = _grown(x.t, x.b, F.least(context.h, F.greatest(F.lit(0.05), x.h * 2.0)), context.t, context.b)
    return Box(left, t, r, b)


def repair_box(x: Box) -> Box:
    """A finding's box padded by a quarter of its width and half of its height."""
    px, py = F.greatest(F.lit(0.02), x.w * 0.25), F.greatest(F.lit(0.02), x.h * 0.5)
    return Box(F.greatest(F.lit(0.0), x.l - px), F.greatest(F.lit(0.0), x.t - py), F.least(F.lit(1.0), x.r + px), F.least(F.lit(1.0), x.b + py))


def overlap(x: Box, y: Box) -> Column:
    """Whether two boxes share area."""
    return (x.r > y.l) & (y.r > x.l) & (x.b > y.t) & (y.b > x.t)


def shared(x: Box, y: Box) -> tuple[Column, Column]:
    """Width and height of the common part, 0 where there is none."""
    return F.greatest(F.lit(0.0), F.least(x.r, y.r) - F.greatest(x.l, y.l)), F.greatest(F.lit(0.0), F.least(x.b, y.b) - F.greatest(x.t, y.t))


def same_target(x: Box, y: Box) -> Column:
    """Whether two quality boxes mean one defect."""
    w, h = shared(x, y)
    strip = (h >= F.least(x.h, y.h) * 0.5) & (w >= F.least(x.w, y.w) * 0.5)
    area = F.least(x.w * x.h, y.w * y.h)
    return (orientation(x) == orientation(y)) & F.when(orientation(x) == "local", (area > 0) & (w * h >= area * 0.6)).otherwise(strip)


def tiles(width: Column, height: Column, share: float = 0.10) -> Column:
    """array<struct<view, l, t, r, b>> in pixels: the whole page and four overlapping quarters."""
    ox, oy = F.rint(width * share / 2).cast("int"), F.rint(height * share / 2).cast("int")
    mx, my = F.floor(width / 2).cast("int"), F.floor(height / 2).cast("int")
    zero = F.lit(0)
    right, left = F.least(width, mx + ox), F.greatest(zero, mx - ox)
    low, top = F.least(height, my + oy), F.greatest(zero, my - oy)
    views = [(zero, zero, width, height), (zero, zero, right, low), (left, zero, width, low), (zero, top, right, height), (left, top, width, height)]
    return F.array(*(F.struct(F.lit(i).alias("view"), *(c.cast("int").alias(n) for c, n in zip(v, "ltrb"))) for i, v in enumerate(views)))


def from_view(view: Box, x: Box, width: Column, height: Column) -> Box:
    """A box in a view's coordinates brought to page coordinates."""
    return Box((view.l + x.l * view.w) / width, (view.t + x.t * view.h) / height, (view.l + x.r * view.w) / width, (view.t + x.b * view.h) / height)


def padded(x: Box, least: float, across: float, along: float) -> Box:
    """A box grown on each side by a share of its width and height, ``least`` at least; not clamped."""
    px, py = F.greatest(F.lit(least), x.w * across), F.greatest(F.lit(least), x.h * along)
    return Box(x.l - px, x.t - py, x.r + px, x.b + py)


#: Padding of a region that is restored whole, and of one that is restored as evidence.
RESTORE, EVIDENCE = (0.004, 0.08, 0.12), (0.003, 0.04, 0.08)


def pixels(x: Box, width: Column, height: Column) -> Box:
    """The box as a pixel window inside the page, rounded half to even; empty where nothing of it is on the page."""
    at = lambda c, n: between(F.rint(c * n), F.lit(0.0), n.cast("double")).cast("int")
    return Box(at(x.l, width), at(x.t, height), at(x.r, width), at(x.b, height))


def best_tile(x: Box, width: int, height: int) -> Column:
    """The quarter view, 1 to 4, that shares most area with the box; the first of equal ones."""
    views = [F.element_at(tiles(F.lit(width), F.lit(height)), i + 1) for i in range(1, 5)]
    common = [shared(x, Box(v["l"] / float(width), v["t"] / float(height), v["r"] / float(width), v["b"] / float(height))) for v in views]
    areas = [F.round(w * h, 9) for w, h in common]
    best = F.greatest(*areas)
    return F.coalesce(*(F.when(a == best, F.lit(i)) for i, a in enumerate(areas, 1)))
