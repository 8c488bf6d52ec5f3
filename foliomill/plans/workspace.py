"""Queries on runs, versions and feedback of the review workspace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.operators import hierarchy as h
from foliomill.session import table


def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    """One row per run id: the one updated last (ties: the greatest status, then the greatest notes)."""
    rows = table(spark, d, "lab_runs").withColumn("rid", h.plain_id(F.col("id"))).where("rid is not null")
    late = F.lit("0001-01-01").cast("timestamp")
    keep = ["document_id", "page", "status", "created_at", "updated_at", "restored_url", "notes", "parent_run_id", "judgments", "comments"]
    best = rows.groupBy("rid").agg(F.max_by(F.struct(*keep), F.struct(F.coalesce("updated_at", late), F.coalesce("status", F.lit("")), F.coalesce("notes", F.lit("")))).alias("x"))
    return best.select("rid", "x.*")


def latest_run_per_page(spark: SparkSession, d: str) -> DataFrame:
    """Per document and page the run created last that has a raster and isn't marked as a wrong pairing."""
    runs = latest_runs(spark, d).where("restored_url is not null and trim(restored_url) <> '' and not startswith(coalesce(notes, ''), 'Invalid source/candidate pairing')")
    return runs.groupBy("document_id", "page").agg(F.max_by("rid", F.struct("created_at", "rid")).alias("run_id"), F.count("*").alias("n_runs"))


def feedback_partition(spark: SparkSession, d: str) -> DataFrame:
    """Per run with issues: confirmed, dismissed and commented issues, and whether anything asks for a repair."""
    issues = table(spark, d, "lab_issues").select(h.plain_id(F.col("run_id")).alias("rid"), F.col("id").cast("string").alias("key")).where("rid is not null and key is not null").distinct()
    runs = latest_runs(spark, d).select("rid", "judgments", "comments", "notes")
    marked = issues.join(runs, "rid").select("rid", "notes", F.col("judgments")[F.col("key")].alias("j"), F.coalesce(F.trim(F.col("comments")[F.col("key")]), F.lit("")).alias("c"))
    n = marked.groupBy("rid").agg(F.count("*").alias("n"), F.count_if(F.col("j") == "confirmed").alias("n_accepted"), F.count_if(F.col("j") == "false_alarm").alias("n_dismissed"), F.count_if(F.col("c") != "").alias("n_commented"), F.max(F.trim(F.coalesce("notes", F.lit("")))).alias("notes"))
    return n.select("rid", "n", "n_accepted", "n_dismissed", "n_commented", ((F.col("n_accepted") > 0) | (F.col("n_commented") > 0) | (F.col("notes") != "")).alias("has_repairs"))


def _nearest(spark: SparkSession, d: str, stop: str) -> DataFrame:
    """rid, found: the nearest run at or above each run that fulfils ``stop``; null where there is none.

    Such runs are cut from their parents, so they become the roots of the runs below them.
    """
    runs = latest_runs(spark, d).withColumn("stop", F.coalesce(F.expr(stop), F.lit(False)))
    nodes = runs.select(F.lit("run").alias("kind"), F.col("rid").alias("id"), F.when(~F.col("stop"), h.plain_id(F.col("parent_run_id"))).alias("parent"))
    tops = h.roots(nodes).select(F.col("id").alias("rid"), "root")
    hits = runs.where("stop").select(F.col("rid").alias("root"), F.lit(True).alias("hit"))
    return tops.join(hits, "root", "left").select("rid", F.when(F.col("hit"), F.col("root")).alias("found"))


RASTER = "restored_url is not null and trim(restored_url) <> ''"


def candidate_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Every run with the nearest run, itself or an ancestor, that has a raster."""
    return _nearest(spark, d, RASTER)


def reviewed_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Every run with the nearest complete run; only failed or interrupted runs without a raster look upward."""
    runs = latest_runs(spark, d)
    up = F.expr(f"status in ('failed', 'interrupted') and not ({RASTER})")
    nodes = runs.select(F.lit("run").alias("kind"), F.col("rid").alias("id"), F.when(F.coalesce(up, F.lit(False)), h.plain_id(F.col("parent_run_id"))).alias("parent"))
    tops = h.roots(nodes).select(F.col("id").alias("rid"), "root")
    hits = runs.where("status = 'complete'").select(F.col("rid").alias("root"), F.lit(True).alias("hit"))
    return tops.join(hits, "root", "left").select("rid", F.when(F.col("hit"), F.col("root")).alias("found"))


def _versions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lab_versions").withColumn("vid", h.plain_id(F.col("id"))).where("vid is not null")
    return rows.groupBy("vid").agg(F.max_by(F.struct("parent_id", F.map_entries("page_runs").alias("pages"), "changed_pages"), F.coalesce("created_at", F.lit("0001-01-01").cast("timestamp"))).alias("x")).select("vid", h.plain_id(F.col("x.parent_id")).alias("parent"), F.map_from_entries("x.pages").alias("page_runs"), "x.changed_pages")


def version_inherit(spark: SparkSession, d: str) -> DataFrame:
    """Per version with a known parent: pages taken over unchanged, replaced, added and dropped."""
    v = _versions(spark, d)
    p = v.select(F.col("vid").alias("parent"), F.col("page_runs").alias("was"))
    none = F.expr("map_from_arrays(cast(array() as array<string>), cast(array() as array<string>))")
    both = v.join(p, "parent").select("vid", F.coalesce("page_runs", none).alias("now"), F.coalesce("was", none).alias("was"))
    merged = both.select("vid", F.map_zip_with("now", "was", lambda k, a, b: F.when(b.isNull(), "added").when(a.isNull(), "dropped").when(a == b, "kept").otherwise("replaced")).alias("m"))
    count = lambda s: F.size(F.filter(F.map_values("m"), lambda x: x == s)).alias(s)
    return merged.select("vid", *map(count, ("kept", "replaced", "added", "dropped")))


def export_selection(spark: SparkSession, d: str) -> DataFrame:
    """Per page of every version the run whose raster is exported; null means the source page."""
    pages = _versions(spark, d).select("vid", F.explode("page_runs").alias("page", "run")).select("vid", "page", h.plain_id(F.col("run")).alias("rid"))
    return pages.join(candidate_lineage(spark, d), "rid", "left").select("vid", "page", F.col("found").alias("run_id"))


QUERIES = {f.__name__: f for f in (latest_run_per_page, feedback_partition, candidate_lineage, reviewed_lineage, version_inherit, export_selection)}

_RUNS = """runs as (select rid, document_id, page, status, created_at, restored_url, notes, nullif(lower(trim(parent_run_id)), '') as parent, judgments, comments from (
 select *, lower(trim(id)) as rid, row_number() over (partition by lower(trim(id)) order by coalesce(updated_at, timestamptz '0001-01-01') desc, coalesce(status, '') desc, coalesce(notes, '') desc) as rn from lab_runs where trim(id) <> '') where rn = 1)"""
_UP = ", walk as (select rid, rid as cur, 0 as n from runs union all select w.rid, r.parent, n + 1 from walk w join runs r on r.rid = w.cur where n < (select count(*) from runs) and r.parent is not null and {go}), hit as (select w.rid, arg_min(w.cur, w.n) as found from walk w join runs r on r.rid = w.cur where {stop} group by w.rid)"
_R = "r.restored_url is not null and trim(r.restored_url) <> ''"
_VERS = """v as (select vid, nullif(lower(trim(parent_id)), '') as parent, page_runs from (select *, lower(trim(id)) as vid, row_number() over (partition by lower(trim(id)) order by created_at desc nulls last) as rn from lab_versions where trim(id) <> '') where rn = 1),
e as (select vid, parent, k.key as page, k.value as run from (select vid, parent, unnest(map_entries(page_runs)) as k from v))"""

SQL = {
    "latest_run_per_page": f"with {_RUNS} select document_id, page, arg_max(rid, struct_pack(c := created_at, r := rid)) as run_id, count(*) as n_runs from runs where restored_url is not null and trim(restored_url) <> '' and not starts_with(coalesce(notes, ''), 'Invalid source/candidate pairing') group by all",
    "feedback_partition": f"""with {_RUNS}, i as (select distinct lower(trim(run_id)) as rid, cast(id as varchar) as key from lab_issues where trim(run_id) <> '' and id is not null),
m as (select i.rid, notes, judgments[key] as j, coalesce(trim(comments[key]), '') as c from i join runs using (rid))
select rid, count(*) as n, count(*) filter (j = 'confirmed') as n_accepted, count(*) filter (j = 'false_alarm') as n_dismissed, count(*) filter (c <> '') as n_commented,
 count(*) filter (j = 'confirmed') > 0 or count(*) filter (c <> '') > 0 or max(trim(coalesce(notes, ''))) <> '' as has_repairs from m group by rid""",
    "candidate_lineage": f"with recursive {_RUNS}{_UP.format(go=f'not ({_R})', stop=_R)} select runs.rid, found from runs left join hit using (rid)",
    "reviewed_lineage": "with recursive " + _RUNS + _UP.format(go=f"r.status in ('failed', 'interrupted') and not ({_R})", stop="r.status = 'complete'") + " select runs.rid, found from runs left join hit using (rid)",
    "version_inherit": f"""with {_VERS}, pr as (select v.vid, v.parent from v join v p on p.vid = v.parent),
z as (select pr.vid, coalesce(a.page, b.page) as page, a.run as now, b.run as was from (select pr.vid, e.page, e.run from pr join e on e.vid = pr.vid) a
 full join (select pr.vid, e.page, e.run from pr join e on e.vid = pr.parent) b on a.vid = b.vid and a.page = b.page join pr on pr.vid = coalesce(a.vid, b.vid))
select pr.vid, cast(count(*) filter (now = was) as int) as kept, cast(count(*) filter (now <> was) as int) as replaced, cast(count(*) filter (now is not null and was is null) as int) as added, cast(count(*) filter (now is null and was is not null) as int) as dropped from pr left join z using (vid) group by pr.vid""",
    "export_selection": f"with recursive {_RUNS}{_UP.format(go=f'not ({_R})', stop=_R)}, {_VERS} select vid, page, found as run_id from e left join hit on hit.rid = nullif(lower(trim(e.run)), '')",
}
