"""Queries on exported records whose schema drifts from file to file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.operators import drift
from foliomill.session import Shelf, table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every field renamed, removed, added or retyped between neighbouring files of a stream."""
    return drift.changes(table(spark, d, "raw_records"))


def p3_scripts(spark: SparkSession, d: str) -> DataFrame:
    """The edit script of least cost of every file against the one before it, and its cost."""
    lines = table(spark, d, "raw_records")
    rows = Shelf(spark, "drift").put(drift.flatten_lines(lines), "rows")
    return drift.scripts(lines, rows).where("op is not null").select("stream", "file_no", "op", F.col("field").alias("node"), F.col("new_field").alias("new_node"), "leaves", "distance")


def p3_columns(spark: SparkSession, d: str) -> DataFrame:
    """The columns of the one table: name, type and the number of lines that fill it."""
    lines = table(spark, d, "raw_records")
    shelf = Shelf(spark, "drift")
    rows = shelf.put(drift.flatten_lines(lines), "rows")
    return drift.columns(rows, drift.projections(lines, rows, shelf))


def p3_table(spark: SparkSession, d: str) -> DataFrame:
    """All records in one typed schema."""
    return drift.unified(table(spark, d, "raw_records"))


QUERIES = {"p3_found": p3_found, "p3_scripts": p3_scripts, "p3_columns": p3_columns, "p3_table": p3_table}

# leaves by walking every document; an array without objects is one leaf, in an array with objects the others are one
_LEAVES = """
doc as (select record_id, stream, file_no, record_key, payload from raw_records where json_valid(payload) and json_type(payload) = 'OBJECT'),
t as (select d.record_id, d.stream, d.file_no, d.record_key, j.id, j.parent, j.key, j.value, j.type, j.atom from doc d, json_tree(d.payload) j),
p as (select record_id, id, type, cast('' as varchar) as field from t where parent is null
 union all
 select t.record_id, t.id, t.type, case when p.type = 'ARRAY' then p.field || '[]' when p.field = '' then t.key else p.field || '.' || t.key end from p join t on t.record_id = p.record_id and t.parent = p.id where p.type in ('OBJECT', 'ARRAY')),
k as (select parent as id, record_id, bool_or(type = 'OBJECT') as objects, list(value order by id) filter (type not in ('NULL', 'OBJECT') and value <> '[]') as rest,
  list(case when type in ('UBIGINT', 'BIGINT', 'DOUBLE') then cast(cast(value as double) as varchar) else cast(value as varchar) end order by id) filter (type not in ('NULL', 'OBJECT') and (value <> '[]')) as vals from t group by 1, 2),
l0 as (select t.*, p.field, a.type as above from t join p using (record_id, id) left join t a on a.record_id = t.record_id and a.id = t.parent),
l as (select record_id, stream, file_no, record_key, id, field, case type when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' else 'number' end as type,
  case when type in ('UBIGINT', 'BIGINT', 'DOUBLE') then cast(cast(value as double) as varchar) else cast(value as varchar) end as v from l0 where type in ('VARCHAR', 'BOOLEAN', 'UBIGINT', 'BIGINT', 'DOUBLE') and above = 'OBJECT'
 union all
 select l0.record_id, stream, file_no, record_key, l0.id, field, 'array', cast(k.vals as varchar) from l0 join k on k.record_id = l0.record_id and k.id = l0.id where type = 'ARRAY' and above = 'OBJECT' and len(rest) > 0),
f0 as (select stream, file_no, field, type, count(*) as n from l group by all),
f as (select stream, file_no, field, first(type order by n desc, type) as type from f0 group by all),
n0 as (select distinct stream, file_no from raw_records where file_no is not null),
n as (select * from (select stream, file_no, lag(file_no) over (partition by stream order by file_no) as prev from n0) where prev is not null),
b as (select n.stream, n.file_no, n.prev, f.field, f.type as old, cast(null as varchar) as new from n join f on f.stream = n.stream and f.file_no = n.prev union all select n.stream, n.file_no, n.prev, f.field, null, f.type from n join f on f.stream = n.stream and f.file_no = n.file_no),
c as (select stream, file_no, prev, field, max(old) as old, max(new) as new from b group by all),
sk as (select distinct stream, file_no, record_key from raw_records where record_key is not null),
sh as (select n.stream, n.file_no, n.prev, x.record_key from n join sk x on x.stream = n.stream and x.file_no = n.file_no join sk y on y.stream = n.stream and y.file_no = n.prev and y.record_key = x.record_key),
lv as (select record_id, stream, file_no, record_key, field, list(type || '=' || v order by id) as v from l group by all),
ev as (select c.stream, c.file_no, c.field, c.new is null as gone, list(distinct sh.record_key || ':' || cast(lv.v as varchar) order by sh.record_key || ':' || cast(lv.v as varchar)) as proof from c join sh on sh.stream = c.stream and sh.file_no = c.file_no
  join lv on lv.stream = c.stream and lv.file_no = case when c.new is null then c.prev else c.file_no end and lv.field = c.field and lv.record_key = sh.record_key where c.old is null or c.new is null group by all),
ren as (select x.stream, x.file_no, x.field, y.field as new_field from ev x join ev y on x.stream = y.stream and x.file_no = y.file_no and x.gone and not y.gone and x.proof = y.proof),
ch as (select stream, file_no, field, 'renamed' as change, new_field from ren
 union all select stream, file_no, field, 'removed', '' from c where new is null and not exists (select 1 from ren where ren.stream = c.stream and ren.file_no = c.file_no and ren.field = c.field)
 union all select stream, file_no, field, 'added', '' from c where old is null and not exists (select 1 from ren where ren.stream = c.stream and ren.file_no = c.file_no and ren.new_field = c.field)
 union all select stream, file_no, field, 'retyped', '' from c where old <> new)
"""
SQL = {
    "p3_found": f"with recursive {_LEAVES} select stream, cast(file_no as int) as file_no, field, change, new_field from ch",
    "p3_columns": f"""with recursive {_LEAVES},
w as (select stream, file_no, new_field as field, min(field) as was from ch where change = 'renamed' group by all),
up as (select f.stream, f.file_no, f.field, n.prev, coalesce(case when o.field is not null then f.field end, w.was) as from_field from f left join n using (stream, file_no) left join f o on o.stream = f.stream and o.file_no = n.prev and o.field = f.field left join w on w.stream = f.stream and w.file_no = f.file_no and w.field = f.field),
ro as (select stream, file_no, field, field as name, file_no as first from up where from_field is null
 union all select up.stream, up.file_no, up.field, ro.name, ro.first from ro join up on up.stream = ro.stream and up.prev = ro.file_no and up.from_field = ro.field),
nm as (select stream, file_no, field, name || case when nth > 1 then '#' || nth else '' end as name from (select *, dense_rank() over (partition by stream, name order by first) as nth from ro)),
x as (select nm.name, l.type, l.record_id from l join nm on nm.stream = l.stream and nm.file_no = l.file_no and nm.field = l.field),
y as (select name, type, count(*) as n from x group by all)
select name, (select first(type order by n desc, type) from y where y.name = x.name) as type, count(distinct record_id) as n_records from x group by name""",
}
