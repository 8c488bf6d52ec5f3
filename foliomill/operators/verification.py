"""Page verdicts from recorded review calls over several views of a page."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill.functions import boxes as bx
from foliomill.functions import verdicts as vd
from foliomill.session import Shelf

_FLAGS = ("content_match", "scanner_quality", "found")


def by_view(calls: DataFrame) -> DataFrame:
    """page_id, view_idx, c1 to c3: a view's first three calls with acc (accepted) and qo (rejected for quality only).

    calls: page_id, view_idx, call_no, content_match, scanner_quality, found; a
    null flag counts as no, null findings as none.
    """
    flags = [F.coalesce("content_match", F.lit(False)), F.coalesce("scanner_quality", F.lit(False)), F.coalesce("found", vd.none())]
    c = calls.where("call_no between 1 and 3").select("page_id", "view_idx", "call_no", *(f.alias(n) for f, n in zip(flags, _FLAGS)))
    acc, qo = vd.accepted(*map(F.col, _FLAGS)), vd.quality_only(*map(F.col, _FLAGS))
    return c.groupBy("page_id", "view_idx").agg(*(F.max(F.when(F.col("call_no") == i, F.struct(*_FLAGS, acc.alias("acc"), qo.alias("qo")))).alias(f"c{i}") for i in (1, 2, 3)))


def votes() -> F.Column:
    return sum(F.coalesce(F.col(f"c{i}.acc").cast("int"), F.lit(0)) for i in (1, 2, 3))


def chosen(calls: DataFrame, confirm_quality: bool = True, confirm_rejections: bool = False, quality_consensus: bool = False) -> DataFrame:
    """page_id, view_idx and the flags and findings of the call that decides each view.

    With quality_consensus a quality-only rejection stands unless two of three
    calls accept.  Otherwise the second call decides where the first rejects for
    quality only (confirm_quality) or for content (confirm_rejections).  A call
    that is needed and missing is a rejection.
    """
    plain = lambda c: F.struct(*(F.col(f"{c}.{f}") for f in _FLAGS))
    lost = F.struct(F.lit(False).alias("content_match"), F.lit(False).alias("scanner_quality"), vd.none().alias("found"))
    good = F.struct(F.lit(True).alias("content_match"), F.lit(True).alias("scanner_quality"), vd.none().alias("found"))
    first, second = F.coalesce(F.when(F.col("c1").isNotNull(), plain("c1")), lost), F.when(F.col("c2").isNotNull(), plain("c2")).otherwise(lost)
    acc, qo = F.coalesce("c1.acc", F.lit(False)), F.coalesce("c1.qo", F.lit(False))
    again = (qo & F.lit(confirm_quality and not quality_consensus)) | (~acc & ~qo & F.lit(confirm_rejections))
    v = F.when(qo & F.lit(quality_consensus) & (votes() >= 2), good).when(again, second).otherwise(first)
    return by_view(calls).select("page_id", "view_idx", v.alias("v")).select("page_id", "view_idx", "v.*")


def _completed() -> F.Column:
    return vd.completed(*map(F.col, _FLAGS))


def _covered(x: F.Column) -> F.Column:
    """Whether a finding is one of quality inside one of the view's panels."""
    r = x["region"]
    return (x["category"] == vd.QUALITY) & F.exists("panels", lambda p: (r["l"] >= p["l"]) & (r["t"] >= p["t"]) & (r["r"] <= p["r"]) & (r["b"] <= p["b"]))


def preserved(views: DataFrame, panels: DataFrame) -> DataFrame:
    """views without the quality findings inside panels that source and candidate share.

    panels: page_id, view_idx, panels (array of l, t, r, b).  A view rejected for
    nothing but quality, all of it inside panels, is accepted; elsewhere flags that
    say no get their finding first, so a covered one can't be made up again.
    """
    rows = views.join(panels, ["page_id", "view_idx"], "left").withColumn("panels", F.coalesce("panels", F.expr(f"cast(array() as array<{vd.REGION}>)")))
    flags = [F.col(c) for c in _FLAGS]
    clear = vd.quality_only(*flags) & (F.size("found") > 0) & F.forall("found", _covered)
    left = F.filter(_completed(), lambda x: ~_covered(x))
    # what is left is the whole verdict: its flags are set so that nothing is completed twice
    v = F.when(clear, F.struct(F.lit(True).alias("content_match"), F.lit(True).alias("scanner_quality"), vd.none().alias("found"))).otherwise(F.struct(F.lit(True).alias("content_match"), F.lit(True).alias("scanner_quality"), left.alias("found")))
    return rows.select("page_id", "view_idx", v.alias("v")).select("page_id", "view_idx", "v.*")


def incremental(calls: DataFrame, regions: DataFrame, width: int, height: int, tolerated: tuple[str, ...] = ()) -> DataFrame:
    """page_id, tile, accepted: a repaired page, judged by the whole page and the tile that shares most area with the repair.

    regions: page_id, l, t, r, b.  A call is content with a view if the content
    matches, or if it has findings and tolerates them all; a view passes by its
    first or second call.  A view without calls doesn't pass.
    """
    tile = bx.best_tile(bx.box(), width, height)
    wanted = regions.select("page_id", tile.alias("tile"))
    content = lambda c: F.coalesce(F.col(f"{c}.content_match") | ((F.size(F.col(f"{c}.found")) > 0) & F.forall(F.col(f"{c}.found"), lambda x: x["category"].isin(*tolerated))), F.lit(False))
    views = by_view(calls).select("page_id", "view_idx", (content("c1") | content("c2")).alias("ok"))
    both = wanted.join(views, "page_id", "left").where(F.col("view_idx").isNull() | F.col("view_idx").isin(0) | (F.col("view_idx") == F.col("tile")))
    kept = both.groupBy("page_id", "tile").agg((F.count_if("ok") == 2).alias("accepted"))
    return wanted.join(kept.select("page_id", "accepted"), "page_id", "left").select("page_id", "tile", F.coalesce("accepted", F.lit(False)).alias("accepted"))


def page_verdicts(views: DataFrame, tolerated: tuple[str, ...] = (), all_views: bool = False) -> DataFrame:
    """page_id, accepted, rejected_view, views_read, n_actionable, n_tolerated: views in order, up to the first that is rejected.

    With all_views every view is read, and all their actionable findings count.

    A view is rejected if a finding of a category that isn't tolerated remains;
    flags that say no without a finding count as one.  n_tolerated counts the
    tolerated findings of accepted pages.
    """
    n = F.size(_completed())
    rows = views.select("page_id", "view_idx", F.size(vd.without(_completed(), tolerated)).alias("a"), n.alias("n"))
    first = F.min(F.when(F.col("a") > 0, F.col("view_idx")))
    page = rows.groupBy("page_id").agg(first.alias("rejected_view"), F.collect_list(F.struct("view_idx", "a", "n")).alias("xs"))
    bad = F.col("rejected_view")
    total = lambda keep, value: F.aggregate(F.filter("xs", keep), F.lit(0), lambda s, x: s + value(x))
    return page.select(
        "page_id",
        bad.isNull().alias("accepted"),
        "rejected_view",
        F.size(F.filter("xs", lambda x: F.lit(all_views) | bad.isNull() | (x["view_idx"] <= bad))).alias("views_read"),
        total(lambda x: F.lit(all_views) | (x["view_idx"] == bad), lambda x: x["a"]).alias("n_actionable"),
        F.when(bad.isNull(), total(lambda x: F.lit(True), lambda x: x["n"])).otherwise(F.lit(0)).alias("n_tolerated"),
    )


def page_findings(views: DataFrame, tolerated: tuple[str, ...], width: int, height: int) -> DataFrame:
    """page_id, view_idx, category, severity, l, t, r, b in page coordinates.

    Of a rejected page the findings that reject its first rejected view, of an
    accepted page the tolerated ones of all views.
    """
    pages = page_verdicts(views, tolerated).select("page_id", "rejected_view")
    f = views.select("page_id", "view_idx", F.explode(_completed()).alias("x")).join(pages, "page_id")
    bad, ok = F.col("rejected_view"), F.col("x.category").isin(*tolerated)
    f = f.where(F.when(bad.isNull(), ok).otherwise((F.col("view_idx") == bad) & ~ok))
    view = F.element_at(bx.tiles(F.lit(width), F.lit(height)), F.col("view_idx") + 1)
    page = bx.from_view(bx.Box(*(view[c].cast("double") for c in "ltrb")), bx.Box(*(F.col("x.region")[c] for c in "ltrb")), F.lit(float(width)), F.lit(float(height)))
    return f.select("page_id", "view_idx", "x.category", "x.severity", *(c.alias(n) for c, n in zip(page, "ltrb")))


class Reviewer:
    """What a live model must offer; one is made per task by the factory given to ``record_calls``."""

    def review(self, page_id: int, view_idx: int, call_no: int, payload: bytes) -> str:
        """The verdict as JSON text."""
        raise NotImplementedError


def record_calls(views: DataFrame, factory: Callable[[], Reviewer], calls: int = 1, path: str | None = None) -> DataFrame:
    """page_id, view_idx, call_no, text, error: each view reviewed ``calls`` times, written once and read from then on.

    views: page_id, view_idx, payload.  Calls aren't repeatable, so nothing
    downstream may compute them again: the answers are written to ``path`` (or
    the shared folder) before anything uses them.  A call that raises keeps its
    error class and a null text.
    """
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("view_idx", T.IntegerType()), T.StructField("call_no", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]):
        client = factory()
        for batch in batches:
            rows = []
            for page, view, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for call in range(1, calls + 1):
                    try:
                        rows.append((page, view, call, client.review(page, view, call, payload), None))
                    except Exception as e:
                        rows.append((page, view, call, None, type(e).__name__))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()))], names=schema.names)

    out = views.select(F.col("page_id").cast("long"), F.col("view_idx").cast("int"), "payload").mapInArrow(run, schema)
    if path is None:
        return Shelf(views.sparkSession, "calls").put(out, "calls")
    out.write.mode("errorifexists").parquet(path)
    return views.sparkSession.read.schema(schema).parquet(path)


def parsed_calls(recorded: DataFrame) -> DataFrame:
    """Recorded texts as calls; a failed call, or one whose text breaks the contract, has null flags and so rejects."""
    return recorded.withColumn("v", vd.parse(F.col("text"))).select("page_id", "view_idx", "call_no", "v.content_match", "v.scanner_quality", F.col("v.discrepancies").alias("found"))
