"""Ordered rules over columns: what is wrong with a row, first or in full.

A rule is a label and a condition; a null condition counts as not met.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliomill.functions import boxes as bx

Rule = tuple[str, Column]


def first_met(*rules: Rule) -> Column:
    """The label of the first rule that is met, null where none is."""
    return F.coalesce(*(F.when(condition, F.lit(label)) for label, condition in rules))


def all_met(*rules: Rule) -> Column:
    """The labels of all rules that are met, in order."""
    return F.filter(F.array(*(F.when(condition, F.lit(label)) for label, condition in rules)), lambda x: x.isNotNull())


# Labels and limits of the gates, the settings and the providers' errors.
LOSS, INVENTED = 0.45, 0.55
LEAST_INK = 32
LOOPBACK = ("localhost", "127.0.0.1", "::1")
POLICY_WORDS = "moderation|content[_ ]policy|refusal|safety"
# End of fixed values.


def gate_issues(dpi: Column, least_dpi: Column, registered: Column, has_ink: Column, missing: Column, source_ink: Column, invented: Column, candidate_ink: Column, holes: Column) -> Column:
    """The issues that keep a cleaned page from review: resolution, registration, lost and invented ink, holes left."""
    compared = source_ink >= LEAST_INK
    return all_met(
        ("generated_resolution_below_minimum", dpi < least_dpi),
        ("page_registration_failed", ~registered & has_ink),
        ("large_foreground_loss", compared & (missing > source_ink * LOSS)),
        ("large_candidate_only_foreground", compared & (invented > F.greatest(candidate_ink, F.lit(1)) * INVENTED)),
        ("residual_punch_hole", holes > 0),
    )


def photo_passes(issues: Column) -> Column:
    """In a photographed page only apparent loss of ink is left to the reviewers; no issue passes too."""
    return F.size(F.array_except(issues, F.array(F.lit("large_foreground_loss")))) == 0


def margin_cleared(region: bx.Box, before: Column, colored: Column, after: Column, area: Column, same_area: Column) -> Column:
    """Whether a sparse neutral mark in the outer margin is gone: counts of marked pixels before and after."""
    at_edge = (F.least(region.l, region.t) <= 0.001) | (F.greatest(region.r, region.b) >= 0.999)
    sparse, clean = F.greatest(F.lit(3), F.rint(area * 0.12)), F.greatest(F.lit(2), F.rint(area * 0.002))
    return at_edge & (area > 0) & same_area & (before > clean) & (before <= sparse) & (colored == 0) & (after <= F.least(clean, before * 0.10))


def settings_failure(base_url: Column, image_model: Column, review_model: Column, max_cost: Column, zero_retention: Column) -> Column:
    """The first thing wrong with a run's settings, null where they hold."""
    scheme, host = F.parse_url(base_url, F.lit("PROTOCOL")), F.regexp_replace(F.parse_url(base_url, F.lit("HOST")), r"[\[\]]", "")
    native = lambda c: F.startswith(c, F.lit("codex/"))
    return first_met(
        ("no_http_url", base_url.isNull() | ~base_url.rlike("^https?://")),
        ("no_endpoint", host.isNull()),
        ("plain_http", (scheme == "http") & ~host.isin(*LOOPBACK)),
        ("model_without_author", F.coalesce(~F.contains(image_model, F.lit("/")) | ~F.contains(review_model, F.lit("/")), F.lit(True))),
        ("mixed_families", native(image_model) != native(review_model)),
        ("bad_cost_limit", F.isnan(max_cost) | (max_cost <= 0)),
        ("cost_limit_of_subscription", native(image_model) & max_cost.isNotNull()),
        ("retention_of_subscription", native(image_model) & zero_retention),
    )


def error_class(status: Column, kind: Column, message: Column, embedded: Column) -> Column:
    """ok, content_policy, too_large, fatal or failed; embedded tells that an error lies in an answer of status under 400."""
    said = F.lower(F.concat_ws(" ", kind, message))
    policy = said.rlike(POLICY_WORDS)
    return F.coalesce(
        first_met(
            ("ok", (status < 400) & ~embedded),
            ("content_policy", (status < 400) & F.lower(kind).rlike(POLICY_WORDS)),
            ("failed", status < 400),
            ("too_large", (status == 413) | F.contains(said, F.lit("image_too_large")) | F.contains(said, F.lit("too large"))),
            ("content_policy", status.isin(400, 422) & policy),
            ("fatal", status.isin(401, 402, 403, 404)),
        ),
        F.lit("failed"),
    )


def transient(status: Column) -> Column:
    """Whether a call may be made again."""
    return status.isin(408, 409, 429) | (status >= 500)


def retry_after(header: Column, now: Column) -> Column:
    """Seconds to wait by the header, a number or an HTTP date, between 0 and 30; 1 without a readable one."""
    at = F.try_to_timestamp(F.regexp_extract(header, r"^[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d\d:\d\d:\d\d) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.coalesce(header.try_cast("double"), (F.unix_micros(at) - F.unix_micros(now)) / 1e6)
    return F.when(wait.isNull() | F.isnan(wait), F.lit(1.0)).otherwise(bx.between(wait, F.lit(0.0), F.lit(30.0)))
