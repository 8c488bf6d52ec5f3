"""Queries on recorded review calls.

The calls come from the lineitem table read as a call log: a page is an order, a
view the line number modulo five, the flags and the one finding of a call follow
from its other columns.  Missing second or third calls count as rejections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from foliomill.functions import boxes as bx
from foliomill.functions import verdicts as vd
from foliomill.operators import verification as vf
from foliomill.operators.prefix import running_before
from foliomill.session import table

TIES = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"
TOLERATED = ("changed_layout", "other_content")


def calls(spark: SparkSession, d: str) -> DataFrame:
    """page_id, view_idx, call_no, content_match, scanner_quality, found."""
    order = [c.strip() for c in TIES.split(",")]
    view = F.pmod(F.col("l_linenumber") - 1, F.lit(5)).cast("int")
    names = F.array(*map(F.lit, vd.CATEGORIES))
    grades = F.array(*map(F.lit, vd.SEVERITIES))
    region = F.struct(F.lit(0.0).alias("l"), F.col("l_tax").alias("t"), F.lit(1.0).alias("r"), F.lit(1.0).alias("b"))
    one = F.struct(F.element_at(names, (F.col("l_partkey") % 14 + 1).cast("int")).alias("category"), F.element_at(grades, (F.col("l_suppkey") % 4 + 1).cast("int")).alias("severity"), region.alias("region"))
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("page_id"),
        view.alias("view_idx"),
        F.row_number().over(W.partitionBy("l_orderkey", view).orderBy(*order)).alias("call_no"),
        (F.col("l_returnflag") != "R").alias("content_match"),
        (F.col("l_linestatus") == "O").alias("scanner_quality"),
        F.when(F.col("l_quantity") >= 30, F.array(one)).otherwise(vd.none()).alias("found"),
    )


def five_view_verification(spark: SparkSession, d: str) -> DataFrame:
    """Every page's verdict; a quality-only rejection is decided by the second call."""
    return vf.page_verdicts(vf.chosen(calls(spark, d)), TOLERATED)


def five_view_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Every page's verdict; a quality-only rejection needs two of three calls."""
    return vf.page_verdicts(vf.chosen(calls(spark, d), quality_consensus=True), TOLERATED)


def five_view_confirmed(spark: SparkSession, d: str) -> DataFrame:
    """Every page's verdict; the second call decides on any rejection."""
    return vf.page_verdicts(vf.chosen(calls(spark, d), confirm_rejections=True), TOLERATED)


def five_view_findings(spark: SparkSession, d: str) -> DataFrame:
    """The findings behind the verdicts of five_view_verification, in page coordinates."""
    out = vf.page_findings(vf.chosen(calls(spark, d)), TOLERATED, 2480, 3508)
    return out.select("page_id", "view_idx", "category", "severity", *bx.box().scaled())


def consensus_two_of_three(spark: SparkSession, d: str) -> DataFrame:
    """Per view whether at least two of the first three calls accept."""
    return vf.by_view(calls(spark, d)).select("page_id", "view_idx", vf.votes().alias("votes"), (vf.votes() >= 2).alias("accepted"))


def candidate_quality_gate(spark: SparkSession, d: str) -> DataFrame:
    """Per page the first view that neither its first call nor two of three calls accept."""
    rows = vf.by_view(calls(spark, d)).select("page_id", "view_idx", (F.coalesce("c1.acc", F.lit(False)) | (vf.votes() >= 2)).alias("ok"))
    return rows.groupBy("page_id").agg(F.min(F.when(~F.col("ok"), F.col("view_idx"))).alias("rejected_view")).select("page_id", F.col("rejected_view").isNull().alias("accepted"), "rejected_view")


def quality_only_rejections(spark: SparkSession, d: str) -> DataFrame:
    c = calls(spark, d)
    flags = [F.col(x) for x in ("content_match", "scanner_quality", "found")]
    return c.groupBy("view_idx").agg(F.count("*").alias("n"), F.count_if(vd.accepted(*flags)).alias("n_accepted"), F.count_if(vd.quality_only(*flags)).alias("n_quality_only"))


def feedback_categories(spark: SparkSession, d: str) -> DataFrame:
    """Per page the first five distinct categories in call order."""
    c = calls(spark, d).where(F.size("found") > 0).select("page_id", "view_idx", "call_no", F.col("found")[0]["category"].alias("category"))
    seen = c.groupBy("page_id", "category").agg(F.min(F.struct("view_idx", "call_no")).alias("at"))
    lists = seen.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("at", "category"))).alias("xs"))
    return lists.select("page_id", F.array_join(F.transform(F.slice("xs", 1, 5), lambda x: x["category"]), ",").alias("categories"))


def verdict_parse(spark: SparkSession, d: str) -> DataFrame:
    """Valid and invalid verdict texts per view; boxes that leave the page break the contract."""
    text = F.format_string(
        '{"content_match": %s, "scanner_quality": true, "discrepancies": [{"category": "%s", "severity": "high", "region": {"l": 0.1, "t": 0.1, "r": %s, "b": 0.4}}]}',
        F.when(F.col("l_returnflag") == "A", '"yes"').otherwise((F.col("l_returnflag") != "R").cast("string")),
        F.when(F.col("l_linenumber") == 3, "glare").otherwise("changed_text"),
        (F.col("l_quantity") / 40).cast("string"),
    )
    rows = table(spark, d, "lineitem").select(F.pmod(F.col("l_linenumber") - 1, F.lit(5)).cast("int").alias("view_idx"), vd.parse(text).alias("v"))
    return rows.groupBy("view_idx").agg(F.count_if(F.col("v").isNotNull()).alias("n_valid"), F.count_if(F.col("v").isNull()).alias("n_invalid"), F.count_if(F.col("v.content_match")).alias("n_match"))


def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    """Calls, tokens and cost per kind; unknown tokens count as 0, unknown cost stays null."""
    e = table(spark, d, "events").select(F.col("event_type").alias("kind"), F.floor(F.col("value") * 100 + 0.5).cast("long").alias("cents"), F.get_json_object("props", "$.k").try_cast("long").alias("tokens"))
    return e.groupBy("kind").agg(F.count("*").alias("calls"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"), F.sum("cents").alias("cents"))


def running_limit(spark: SparkSession, d: str) -> DataFrame:
    """Per worker the calls made before its running cost reached the limit of 100.00."""
    e = table(spark, d, "events").select("user_id", "event_id", F.floor(F.col("value") * 100 + 0.5).cast("long").alias("cents"))
    return running_before(e, ["user_id"], ["event_id"], F.col("cents")).groupBy("user_id").agg(F.count_if(F.col("before") < 10000).alias("allowed"), F.count("*").alias("calls"))


QUERIES = {f.__name__: f for f in (five_view_verification, five_view_consensus, five_view_confirmed, five_view_findings, consensus_two_of_three, candidate_quality_gate, quality_only_rejections, feedback_categories, verdict_parse, usage_totals, running_limit)}

_CATS = "[" + ", ".join(f"'{c}'" for c in vd.CATEGORIES) + "]"
_SEVS = "[" + ", ".join(f"'{c}'" for c in vd.SEVERITIES) + "]"
_CALLS = f"""with c as (select l_orderkey as page_id, cast((l_linenumber - 1) % 5 as int) as view_idx,
 row_number() over (partition by l_orderkey, (l_linenumber - 1) % 5 order by {TIES}) as call_no,
 l_returnflag <> 'R' as cm, l_linestatus = 'O' as sq, l_quantity >= 30 as has, {_CATS}[l_partkey % 14 + 1] as cat, {_SEVS}[l_suppkey % 4 + 1] as sev, l_tax as tax from lineitem),
f as (select *, cm and sq and not has as acc, not (cm and sq and not has) and cm and (not has or cat = 'scanner_quality') as qo from c),
v as (select page_id, view_idx, bool_or(acc) filter (call_no = 1) as a1, bool_or(qo) filter (call_no = 1) as q1, count(*) filter (acc and call_no <= 3) as votes, count(*) filter (call_no = 2) as n2 from f group by all)
"""

_PICK = """, e as (select v.page_id, v.view_idx, {good} or coalesce(g.cm, false) as cm, {good} or coalesce(g.sq, false) as sq, not ({good}) and coalesce(g.has, false) as has, g.cat, g.sev, g.tax from v left join f g on g.page_id = v.page_id and g.view_idx = v.view_idx and g.call_no = {pick})""" + f""",
n as (select page_id, view_idx, cast(has and cat not in {TOLERATED} as int) + cast(not cm and not has as int) + cast(not sq and not (has and cat = 'scanner_quality') as int) as n, cast(has as int) + cast(not cm and not has as int) + cast(not sq and not (has and cat = 'scanner_quality') as int) as m from e),
p as (select page_id, min(view_idx) filter (n > 0) as rejected_view from n group by page_id)"""
_PAGE = """
select p.page_id, rejected_view is null as accepted, rejected_view, cast(count(*) filter (rejected_view is null or view_idx <= rejected_view) as int) as views_read, cast(coalesce(sum(n) filter (view_idx = rejected_view), 0) as int) as n_actionable,
 cast(coalesce(sum(m) filter (rejected_view is null), 0) as int) as n_tolerated from p join n using (page_id) group by all"""

SQL = {
    "consensus_two_of_three": _CALLS + "select page_id, view_idx, cast(votes as int) as votes, votes >= 2 as accepted from v",
    "candidate_quality_gate": _CALLS + "select page_id, min(view_idx) filter (not (a1 or votes >= 2)) is null as accepted, min(view_idx) filter (not (a1 or votes >= 2)) as rejected_view from v group by page_id",
    "quality_only_rejections": _CALLS + "select view_idx, count(*) as n, count(*) filter (acc) as n_accepted, count(*) filter (qo) as n_quality_only from f group by view_idx",
    "feedback_categories": _CALLS + ", s as (select page_id, cat, min(view_idx * 1000 + call_no) as pos from c where has group by all), r as (select *, row_number() over (partition by page_id order by pos) as rn from s) select page_id, string_agg(cat, ',' order by pos) as categories from r where rn <= 5 group by page_id",
    "five_view_verification": _CALLS + _PICK.format(pick="case when v.q1 then 2 else 1 end", good="false") + _PAGE,
    "five_view_consensus": _CALLS + _PICK.format(pick="1", good="v.q1 and v.votes >= 2") + _PAGE,
    "five_view_confirmed": _CALLS + _PICK.format(pick="case when v.a1 then 1 else 2 end", good="false") + _PAGE,
    "five_view_findings": _CALLS + _PICK.format(pick="case when v.q1 then 2 else 1 end", good="false") + f""", z as (
 select page_id, view_idx, cat as category, sev as severity, 0.0::double as l, tax as t, 1.0::double as r, 1.0::double as b from e where has
 union all select page_id, view_idx, 'unresolved_content', 'high', 0.0, 0.0, 1.0, 1.0 from e where not cm and not has
 union all select page_id, view_idx, 'scanner_quality', 'high', 0.0, 0.0, 1.0, 1.0 from e where not sq and not (has and cat = 'scanner_quality')),
w as (select * from (values (0, 0, 0, 2480, 3508), (1, 0, 0, 1364, 1929), (2, 1116, 0, 2480, 1929), (3, 0, 1579, 1364, 3508), (4, 1116, 1579, 2480, 3508)) as q(view_idx, vl, vt, vr, vb))
select page_id, z.view_idx, category, severity, cast(floor((vl + l * (vr - vl)) / 2480.0 * 1e6 + 0.5) as bigint) as l, cast(floor((vt + t * (vb - vt)) / 3508.0 * 1e6 + 0.5) as bigint) as t,
 cast(floor((vl + r * (vr - vl)) / 2480.0 * 1e6 + 0.5) as bigint) as r, cast(floor((vt + b * (vb - vt)) / 3508.0 * 1e6 + 0.5) as bigint) as b
from z join w using (view_idx) join p using (page_id) where case when rejected_view is null then category in {TOLERATED} else z.view_idx = rejected_view and category not in {TOLERATED} end""",
    "verdict_parse": "select cast((l_linenumber - 1) % 5 as int) as view_idx, count(*) filter (ok) as n_valid, count(*) filter (not ok) as n_invalid, count(*) filter (ok and l_returnflag <> 'R') as n_match from (select *, l_returnflag <> 'A' and l_linenumber <> 3 and l_quantity / 40 <= 1 as ok from lineitem) group by all",
    "usage_totals": "select event_type as kind, count(*) as calls, cast(sum(coalesce(try_cast(json_extract_string(props, '$.k') as bigint), 0)) as bigint) as tokens, cast(sum(cast(floor(value * 100 + 0.5) as bigint)) as bigint) as cents from events group by all",
    "running_limit": "select user_id, count(*) filter (b < 10000) as allowed, count(*) as calls from (select user_id, coalesce(sum(cast(floor(value * 100 + 0.5) as bigint)) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as b from events) group by user_id",
}
