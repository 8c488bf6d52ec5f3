"""Queries that flatten nested delivery reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.operators.nested import Level, flatten

#: What p6_found needs of a report; only these leaves are read from the files.
SLIM = "run_id string, received_at timestamp, pages array<struct<page int, attempts array<struct<number int, verification_discrepancies array<struct<category string>>>>>>"

FULL = Level(
    "report",
    fields={c: (c, t) for c, t in (("source", "string"), ("backend", "string"), ("image_model", "string"), ("verification_model", "string"), ("started_at", "string"), ("cost_usd", "double"), ("total_tokens", "long"))},
    children=(
        Level(
            "page",
            "pages",
            {"page": ("page", "int"), "status": ("status", "string"), "fallback_reason": ("fallback_reason", "string")},
            (
                Level(
                    "attempt",
                    "attempts",
                    {"number": ("number", "int"), "strategy": ("strategy", "string"), "effective_dpi": ("effective_dpi", "double"), "accepted": ("accepted", "boolean"), "error_type": ("error_type", "string"), "categories": ("verification_categories", "json")},
                    (Level("discrepancy", "verification_discrepancies", {"category": ("category", "string"), "severity": ("severity", "string"), "region": ("region", "json")}),),
                ),
            ),
        ),
    ),
)

def _fields(**kinds: str) -> dict[str, tuple[str, str]]:
    return {c: (c, kind) for kind, names in kinds.items() for c in names.split()}


_BOX = _fields(double="l t r b")
#: Every field of a report and below; lists of plain values are JSON, lists of boxes are levels.
WHOLE = Level(
    "report",
    fields=_fields(
        int="schema_version ambiguous_timeout_charges",
        string="source output source_sha256 output_sha256 backend billing_mode image_model verification_model verification_strategy started_at finished_at backend_version",
        double="cost_usd",
        long="prompt_tokens completion_tokens total_tokens",
        json="removed_pdf_features warnings",
    ),
    children=(
        Level(
            "page",
            "pages",
            _fields(int="page", string="status source_render_sha256 final_render_sha256 fallback_reason"),
            (
                Level(
                    "attempt",
                    "attempts",
                    _fields(int="number generated_width generated_height", string="strategy error_type", double="effective_dpi", boolean="accepted", json="local_issues verification_categories"),
                    (
                        Level("discrepancy", "verification_discrepancies", _fields(string="category severity", json="region")),
                        *(Level(f"{x}_region", f"{x}_quality_regions", _BOX) for x in ("localized", "committed", "rejected")),
                    ),
                ),
            ),
        ),
    ),
)

KEYS = Level("report", children=(Level("page", "pages", {"page": ("page", "int")}, (Level("attempt", "attempts", {"number": ("number", "int")}, (Level("discrepancy", "verification_discrepancies"),)),)),))


def latest(reports: DataFrame, *value: Column) -> DataFrame:
    """run_id and the value columns of each run's row with the latest received_at (a null one is the earliest).

    A maximum is combined within each task before the shuffle, so a run_id of any number of rows is no hot key.
    """
    at = F.coalesce(F.col("received_at"), F.lit("0001-01-01").cast("timestamp"))
    return reports.select("run_id", at.alias("at"), F.struct(*value).alias("v")).groupBy("run_id").agg(F.max_by("v", "at").alias("v")).select("run_id", "v.*")


def _flat(spark: SparkSession, d: str, top: Level) -> DataFrame:
    reports = spark.read.parquet(f"{d}/reports.parquet")
    body = [c for c in reports.columns if c not in ("run_id", "received_at")]
    return flatten(latest(reports, F.to_json(F.struct(*body)).alias("body")), ["run_id"], "body", top)


def _table(level: Level, top: Level) -> callable:
    def query(spark: SparkSession, d: str) -> DataFrame:
        keys = [F.col("ords")[i].alias(c) for i, c in enumerate(names)]
        fields = [F.col(f"{level.name}_{c}").alias(c) for c in level.fields if c != "region"]
        if "region" in level.fields:
            box = F.from_json(f"{level.name}_region", "l double, t double, r double, b double")
            fields += [box[c].alias(c) for c in "ltrb"]
        return _flat(spark, d, top).where(F.col("level") == level.name).select("run_id", *keys, *fields, *(F.col(f"n_{c.name}") for c in level.children))

    names = {"report": (), "page": ("page_no",), "attempt": ("page_no", "attempt_no"), "discrepancy": ("page_no", "attempt_no", "disc_no")}.get(level.name, ("page_no", "attempt_no", "region_no"))
    query.__doc__ = f"The {level.name} table: one row per {level.name}, linked to its parent by run_id and positions."
    return query


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """run_id, page, number, disc_no: one row per discrepancy and per parent without children."""
    reports = spark.read.schema(SLIM).parquet(f"{d}/reports.parquet")
    flat = flatten(latest(reports, F.to_json(F.struct("pages")).alias("body")), ["run_id"], "body", KEYS, inherit=True)
    zero = F.lit(0)
    leaf = F.coalesce("n_page", zero) + F.coalesce("n_attempt", zero) + F.coalesce("n_discrepancy", zero) == 0
    level = F.col("level")
    return (
        flat.where(leaf)
        .select(
            "run_id",
            F.when(level == "report", zero).otherwise(F.col("page_page")).alias("page"),
            F.when(level.isin("report", "page"), zero).otherwise(F.col("attempt_number")).alias("number"),
            F.when(level == "discrepancy", F.col("ords")[2]).otherwise(zero).alias("disc_no"),
        )
        .distinct()
    )


QUERIES = {"p6_found": p6_found} | {f"p6_{x.name}s".replace("ys", "ies"): _table(x, FULL) for x in FULL.walk()} | {f"p6_whole_{x.name}s".replace("ys", "ies"): _table(x, WHOLE) for x in WHOLE.walk()}

_LATEST = "with latest as (select * from (select *, row_number() over (partition by run_id order by received_at desc nulls last) as rn from reports) where rn = 1)"
_PAGES = ", p as (select run_id, unnest(list_filter(pages, lambda x: x is not null)) as p, unnest(range(1, 1 + len(list_filter(pages, lambda x: x is not null)))) as page_no from latest)"
_ATTEMPTS = ", a as (select run_id, p.page as page, page_no, unnest(list_filter(p.attempts, lambda x: x is not null)) as a, unnest(range(1, 1 + len(list_filter(p.attempts, lambda x: x is not null)))) as attempt_no from p)"
_DISCS = ", v as (select run_id, page, page_no, attempt_no, a.number as number, unnest(list_filter(a.verification_discrepancies, lambda x: x is not null)) as v, unnest(range(1, 1 + len(list_filter(a.verification_discrepancies, lambda x: x is not null)))) as disc_no from a)"

_DISC = "select run_id, cast(page_no as int) as page_no, cast(attempt_no as int) as attempt_no, cast(disc_no as int) as disc_no, v.category, v.severity, v.region.l, v.region.t, v.region.r, v.region.b from v"
_JSON = lambda c: f"case when {c} is not null then cast(to_json({c}) as varchar) end"
_COUNT = lambda c: f"cast(coalesce(len(list_filter({c}, lambda x: x is not null)), 0) as int)"

SQL = {
    "p6_reports": f"{_LATEST} select run_id, source, backend, image_model, verification_model, started_at, cost_usd, total_tokens, cast(coalesce(len(list_filter(pages, lambda x: x is not null)), 0) as int) as n_page from latest",
    "p6_pages": f"{_LATEST}{_PAGES} select run_id, cast(page_no as int) as page_no, p.page, p.status, p.fallback_reason, cast(coalesce(len(list_filter(p.attempts, lambda x: x is not null)), 0) as int) as n_attempt from p",
    "p6_attempts": f"""{_LATEST}{_PAGES}{_ATTEMPTS} select run_id, cast(page_no as int) as page_no, cast(attempt_no as int) as attempt_no, a.number, a.strategy, a.effective_dpi, a.accepted, a.error_type,
 case when a.verification_categories is not null then cast(to_json(a.verification_categories) as varchar) end as categories, cast(coalesce(len(list_filter(a.verification_discrepancies, lambda x: x is not null)), 0) as int) as n_discrepancy from a""",
    "p6_discrepancies": f"{_LATEST}{_PAGES}{_ATTEMPTS}{_DISCS} {_DISC}",
    "p6_whole_discrepancies": f"{_LATEST}{_PAGES}{_ATTEMPTS}{_DISCS} {_DISC}",
    "p6_whole_reports": f"{_LATEST} select run_id, {', '.join(c for c in WHOLE.fields if c not in ('removed_pdf_features', 'warnings'))}, {_JSON('removed_pdf_features')} as removed_pdf_features, {_JSON('warnings')} as warnings, {_COUNT('pages')} as n_page from latest",
    "p6_whole_pages": f"{_LATEST}{_PAGES} select run_id, cast(page_no as int) as page_no, p.page, p.status, p.source_render_sha256, p.final_render_sha256, p.fallback_reason, {_COUNT('p.attempts')} as n_attempt from p",
    "p6_whole_attempts": f"{_LATEST}{_PAGES}{_ATTEMPTS} select run_id, cast(page_no as int) as page_no, cast(attempt_no as int) as attempt_no, {', '.join(f'a.{c}' for c in WHOLE.children[0].children[0].fields if c not in ('local_issues', 'verification_categories'))}, {_JSON('a.local_issues')} as local_issues, {_JSON('a.verification_categories')} as verification_categories, {_COUNT('a.verification_discrepancies')} as n_discrepancy, {', '.join(_COUNT(f'a.{x}_quality_regions') + f' as n_{x}_region' for x in ('localized', 'committed', 'rejected'))} from a",
    **{f"p6_whole_{x}_regions": f"{_LATEST}{_PAGES}{_ATTEMPTS}, q as (select run_id, cast(page_no as int) as page_no, cast(attempt_no as int) as attempt_no, unnest(list_filter(a.{x}_quality_regions, lambda x: x is not null)) as q, cast(unnest(range(1, 1 + len(list_filter(a.{x}_quality_regions, lambda x: x is not null)))) as int) as region_no from a) select run_id, page_no, attempt_no, region_no, q.l, q.t, q.r, q.b from q" for x in ("localized", "committed", "rejected")},
    "p6_found": f"""{_LATEST}{_PAGES}{_ATTEMPTS}{_DISCS}
select distinct run_id, page, number, cast(disc_no as int) as disc_no from v
union select run_id, page, a.number, 0 from a where coalesce(len(list_filter(a.verification_discrepancies, lambda x: x is not null)), 0) = 0
union select run_id, p.page, 0, 0 from p where coalesce(len(list_filter(p.attempts, lambda x: x is not null)), 0) = 0
union select run_id, 0, 0, 0 from latest where coalesce(len(list_filter(pages, lambda x: x is not null)), 0) = 0""",
}
