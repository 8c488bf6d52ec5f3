"""Queries on version and run lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.operators import hierarchy as h
from foliomill.session import Shelf, table


def lineage_links(spark: SparkSession, d: str) -> DataFrame:
    versions = h.links(table(spark, d, "lab_versions"), "id", "parent_id", "version", ("legacy",))
    return versions.unionByName(h.links(table(spark, d, "lab_runs"), "id", "parent_run_id", "run"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """kind, id, state of every version and run whose lineage never ends or breaks off."""
    return h.hierarchy(lineage_links(spark, d)).where(F.col("state") != h.OK).select("kind", "id", "state")


def p2_nested_sets(spark: SparkSession, d: str) -> DataFrame:
    """Every version and run with root, depth, subtree size and nested-set range."""
    return h.hierarchy(lineage_links(spark, d))


def p2_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Every version and run with its state, root, depth and the size of its subtree."""
    return h.hierarchy(lineage_links(spark, d)).select("kind", "id", "state", "root", "depth", "size")


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every version and run with a root, and the ids on the way from it, joined by '/'."""
    tree = Shelf(spark, "tree").put(h.hierarchy(lineage_links(spark, d)), "tree")
    return h.paths(tree).select("kind", "id", F.array_join("path", "/").alias("path"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """kind, ancestor, id: every version and run with each of its proper descendants.

    Below a cycle the records are taken as trees of their own.  Records on a cycle
    are no ancestors here: each would be its own (p2_found marks them).
    """
    shelf = Shelf(spark, "tree")
    tree = shelf.put(h.hierarchy(lineage_links(spark, d)), "tree")
    below = shelf.put(h.hierarchy(tree.where(F.col("state") == h.BELOW).select("kind", "id", "parent")), "below")
    return h.descendants(tree.unionByName(below))


QUERIES = {"p2_found": p2_found, "p2_nested_sets": p2_nested_sets, "p2_sizes": p2_sizes, "p2_paths": p2_paths, "p2_descendants": p2_descendants}

_LINKS = """
nodes as (
  select kind, id, min(parent) as parent from (
    select 'version' as kind, nullif(lower(trim(id)), '') as id,
           case when lower(trim(parent_id)) in ('', 'legacy') then null else lower(trim(parent_id)) end as parent from lab_versions
    union all
    select 'run', nullif(lower(trim(id)), ''), nullif(lower(trim(parent_run_id)), '') from lab_runs)
  where id is not null group by kind, id),
top as (
  select n.kind, n.id, case when n.parent is null then 'ok' else 'orphan' end as state
  from nodes n left join nodes p on p.kind = n.kind and p.id = n.parent where p.id is null),
down as (
  select kind, id, state, id as root, cast(0 as bigint) as depth, id as path from top
  union all
  select n.kind, n.id, d.state, d.root, d.depth + 1, d.path || '/' || n.id from down d join nodes n on n.kind = d.kind and n.parent = d.id)
"""

SQL = {
    "p2_paths": f"with recursive {_LINKS} select kind, id, path from down",
    "p2_descendants": f"""with recursive {_LINKS},
up as (select kind, id, parent as a from nodes union select u.kind, u.id, n.parent from up u join nodes n on n.kind = u.kind and n.id = u.a),
ring as (select distinct kind, id from up where id = a),
under as (select n.kind, n.parent as ancestor, n.id from nodes n join nodes p on p.kind = n.kind and p.id = n.parent anti join ring r on r.kind = n.kind and r.id = n.parent
 union all select u.kind, u.ancestor, n.id from under u join nodes n on n.kind = u.kind and n.parent = u.id)
select kind, ancestor, id from under""",
    "p2_sizes": f"""with recursive {_LINKS},
part as (select kind, id, id as a from down union all select p.kind, p.id, n.parent from part p join nodes n on n.kind = p.kind and n.id = p.a where n.parent is not null and exists (select 1 from nodes q where q.kind = n.kind and q.id = n.parent)),
size as (select kind, a as id, count(*) as size from part group by all),
lost as (select n.kind, n.id, n.parent from nodes n anti join down d on d.kind = n.kind and d.id = n.id),
walk as (select kind, id, parent as up from lost union select w.kind, w.id, l.parent from walk w join lost l on l.kind = w.kind and l.id = w.up),
ring as (select distinct kind, id from walk where id = up)
select kind, id, state, root, depth, size from down join size using (kind, id)
union all select l.kind, l.id, case when r.id is null then 'below_cycle' else 'cycle' end, null, null, null from lost l left join ring r on r.kind = l.kind and r.id = l.id""",
    "p2_found": f"""with recursive {_LINKS},
lost as (select n.kind, n.id, n.parent from nodes n anti join down d on d.kind = n.kind and d.id = n.id),
walk as (
  select kind, id, parent as up from lost
  union
  select w.kind, w.id, l.parent from walk w join lost l on l.kind = w.kind and l.id = w.up),
ring as (select distinct kind, id from walk where id = up)
select kind, id, state from down where state <> 'ok'
union all
select l.kind, l.id, case when r.id is null then 'below_cycle' else 'cycle' end
from lost l left join ring r on r.kind = l.kind and r.id = l.id""",
}
