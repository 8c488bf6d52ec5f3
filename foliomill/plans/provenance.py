"""Queries on sources, signatures, manifests and descriptor matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.functions import hashing
from foliomill.operators.matching import nearest
from foliomill.sources import files
from foliomill.session import table


def text_signatures(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", hashing.text_signature(F.col("text")).alias("signature"))


def text_layer_changes(spark: SparkSession, d: str) -> DataFrame:
    """Per source the texts whose bytes differ from their composed form with plain line ends."""
    rows = table(spark, d, "documents").where("text is not null").select("source", (F.sha2("text", 256) != hashing.text_signature(F.col("text"))).alias("changed"))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if("changed").alias("n_changed"))


def pixel_hashes(spark: SparkSession, d: str) -> DataFrame:
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return table(spark, d, "documents").select("doc_id", hashing.pixel_hash(data, F.lit(64), F.ceil(F.octet_length(data) / 64).cast("long")).alias("sha256"))


def canonical_manifests(spark: SparkSession, d: str) -> DataFrame:
    """Manifest size and hash of every delivery, and whether it may be embedded."""
    body = hashing.canonical_json(run_id=F.col("run_id"), schema_version=F.col("schema_version"), source_sha256=F.col("source_sha256"), backend=F.col("backend"), output_sha256=F.col("output_sha256"))
    rows = table(spark, d, "reports").select("run_id", body.alias("m"))
    return rows.select("run_id", F.octet_length("m").cast("long").alias("bytes"), F.sha2("m", 256).alias("sha256"), (F.octet_length("m") <= 48 * 1024).alias("fits"))


def discovered_sources(spark: SparkSession, d: str) -> DataFrame:
    """Source and output paths of the deliveries by format and whether they are sources."""
    paths = table(spark, d, "reports").select(F.explode(F.array("source", "output")).alias("path")).where("path is not null")
    return paths.groupBy(files.suffix(F.col("path")).alias("suffix"), files.is_page(F.col("path")).alias("is_page")).agg(F.count("*").alias("n"), F.countDistinct("path").alias("n_paths"))


def output_paths(spark: SparkSession, d: str) -> DataFrame:
    """The output path of every source, and whether the deliveries wrote there."""
    rows = table(spark, d, "reports").where("source is not null")
    return rows.groupBy("source").agg(F.max(files.output_path(F.col("source"))).alias("planned"), F.count_if(F.col("output") == files.output_path(F.col("source"))).alias("n_as_planned"), F.count("*").alias("n"))


def output_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose planned output another delivery has already written."""
    rows = table(spark, d, "reports").where("source is not null").select("source", files.output_path(F.col("source")).alias("planned")).distinct()
    written = table(spark, d, "reports").where("output_sha256 is not null").select(F.col("output").alias("planned")).distinct()
    return rows.join(written, "planned", "left_semi").select("source")


def knn_ratio_matches(spark: SparkSession, d: str) -> DataFrame:
    """The two nearest vectors of every vector whose id is divisible by 20, and whether they pass the ratio test of 0.75."""
    e = table(spark, d, "embeddings")
    two = nearest(e.where("vec_id % 20 = 0"), e, 2)
    one = two.groupBy("qid").agg(F.max(F.when(F.col("rank") == 1, F.col("id"))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col("id"))).alias("second"), F.max(F.when(F.col("rank") == 1, F.col("dist"))).alias("d1"), F.max(F.when(F.col("rank") == 2, F.col("dist"))).alias("d2"))
    return one.select("qid", "first", "second", F.round("d1", 5).alias("d1"), (F.col("d1") < 0.75 * F.col("d2")).alias("passes"))


def nearest_source_box(spark: SparkSession, d: str) -> DataFrame:
    """Each issue's nearest source box of its run by centres; the first id of equally near ones."""
    rows = table(spark, d, "lab_issues").where("run_id is not null and id is not null").groupBy("run_id", "id").agg(F.max_by(F.struct("restored_box", "source_box"), F.coalesce("reviewed_at", F.lit("0001-01-01").cast("timestamp"))).alias("x")).select("run_id", "id", "x.*")
    centre = lambda c: ((F.col(f"{c}.x0") + F.col(f"{c}.x1")) / 2, (F.col(f"{c}.y0") + F.col(f"{c}.y1")) / 2)
    a, b = centre("restored_box"), centre("source_box")
    left = rows.where("restored_box is not null").select("run_id", "id", a[0].alias("ax"), a[1].alias("ay"))
    right = rows.where("source_box is not null").select("run_id", F.col("id").alias("near"), b[0].alias("bx"), b[1].alias("by"))
    dist = (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))
    return left.join(right, "run_id").groupBy("run_id", "id").agg(F.min(F.struct(F.round(dist, 9).alias("d"), "near")).alias("m")).select("run_id", "id", F.col("m.near").alias("near"))


QUERIES = {f.__name__: f for f in (text_signatures, text_layer_changes, pixel_hashes, canonical_manifests, discovered_sources, output_paths, output_collisions, knn_ratio_matches, nearest_source_box)}

_SIG = "sha256(replace(nfc_normalize(coalesce(text, '')), chr(13) || chr(10), chr(10)))"
_J = lambda c: f"coalesce('\"' || replace(replace({c}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"') || '\"', 'null')"
_PLANNED = r"regexp_replace(source, '^(.*)(\.[^./\\]*)$', '\1.clean\2')"
SQL = {
    "text_signatures": f"select doc_id, {_SIG} as signature from documents",
    "text_layer_changes": f"select source, count(*) as n, count(*) filter (sha256(text) <> {_SIG}) as n_changed from documents where text is not null group by source",
    "pixel_hashes": "select doc_id, sha256(encode('RGB:64x' || cast(ceil(octet_length(encode(coalesce(text, ''))) / 64.0) as bigint) || ':') || encode(coalesce(text, ''))) as sha256 from documents",
    "canonical_manifests": f"""with m as (select run_id, '{{"backend":' || {_J('backend')} || ',"output_sha256":' || {_J('output_sha256')} || ',"run_id":' || {_J('run_id')} || ',"schema_version":' || coalesce(cast(schema_version as varchar), 'null') || ',"source_sha256":' || {_J('source_sha256')} || '}}' as m from reports)
select run_id, cast(octet_length(encode(m)) as bigint) as bytes, sha256(m) as sha256, octet_length(encode(m)) <= 49152 as fits from m""",
    "discovered_sources": r"""with p as (select unnest([source, output]) as path from reports), q as (select path, lower(regexp_extract(path, '([^/\\]*)$', 1)) as name from p where path is not null)
select regexp_extract(name, '[^.]\.([^.]*)$', 1) as suffix, regexp_extract(name, '[^.]\.([^.]*)$', 1) in ('pdf', 'jpg', 'jpeg', 'png') and not (regexp_replace(name, '\.[^.]*$', '') like '%.clean' or name like '%.report.json' or name like '.folio-%') as is_page, count(*) as n, count(distinct path) as n_paths from q group by all""",
    "output_paths": f"select source, max({_PLANNED}) as planned, count(*) filter (output = {_PLANNED}) as n_as_planned, count(*) as n from reports where source is not null group by source",
    "output_collisions": f"select distinct source from reports where source is not null and {_PLANNED} in (select output from reports where output_sha256 is not null and output is not null)",
    "knn_ratio_matches": """with e as (select vec_id, cast(embedding as double[]) as v from embeddings where embedding is not null),
d as (select q.vec_id as qid, e.vec_id as id, list_distance(q.v, e.v) as dist from e q join e on q.vec_id <> e.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by qid order by dist, id) as rn from d)
select qid, max(id) filter (rn = 1) as first, max(id) filter (rn = 2) as second, round(max(dist) filter (rn = 1), 5) as d1, max(dist) filter (rn = 1) < 0.75 * max(dist) filter (rn = 2) as passes from r where rn <= 2 group by qid""",
    "nearest_source_box": """with i as (select run_id, id, restored_box as rb, source_box as sb from (select *, row_number() over (partition by run_id, id order by reviewed_at desc nulls last) as rn from lab_issues where run_id is not null and id is not null) where rn = 1),
d as (select a.run_id, a.id, b.id as near, round(((a.rb.x0+a.rb.x1)/2 - (b.sb.x0+b.sb.x1)/2) * ((a.rb.x0+a.rb.x1)/2 - (b.sb.x0+b.sb.x1)/2) + ((a.rb.y0+a.rb.y1)/2 - (b.sb.y0+b.sb.y1)/2) * ((a.rb.y0+a.rb.y1)/2 - (b.sb.y0+b.sb.y1)/2), 9) as d from i a join i b on a.run_id = b.run_id where a.rb is not null and b.sb is not null)
select run_id, id, near from (select *, row_number() over (partition by run_id, id order by d, near) as rn from d) where rn = 1""",
}
