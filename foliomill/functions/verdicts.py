"""Review verdicts as Column expressions.

A verdict is a struct of content_match, scanner_quality and discrepancies, an
array of struct<category, severity, region: struct<l, t, r, b>>.  Acceptance is
derived, never stored.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The closed lists of the review contract.
CATEGORIES = ("changed_text", "missing_text", "invented_text", "changed_handwriting", "changed_signature", "changed_stamp", "changed_redaction", "changed_table", "changed_diagram", "changed_layout", "cropped_content", "scanner_quality", "unresolved_content", "other_content")
SEVERITIES = ("low", "medium", "high", "critical")
# End of fixed values.

REGION = "struct<l: double, t: double, r: double, b: double>"
DISCREPANCIES = f"array<struct<category: string, severity: string, region: {REGION}>>"
SCHEMA = f"struct<content_match: boolean, scanner_quality: boolean, discrepancies: {DISCREPANCIES}>"

QUALITY = "scanner_quality"


def none() -> Column:
    return F.expr(f"cast(array() as {DISCREPANCIES})")


def accepted(content: Column, quality: Column, found: Column) -> Column:
    return content & quality & (F.size(found) == 0)


def quality_only(content: Column, quality: Column, found: Column) -> Column:
    """Rejected with matching content and nothing but quality findings (none at all also counts)."""
    return ~accepted(content, quality, found) & content & F.forall(found, lambda x: x["category"] == QUALITY)


def whole_page(category: str) -> Column:
    return F.array(F.expr(f"named_struct('category', '{category}', 'severity', 'high', 'region', named_struct('l', 0.0D, 't', 0.0D, 'r', 1.0D, 'b', 1.0D))"))


def completed(content: Column, quality: Column, found: Column) -> Column:
    """The findings, with one for the whole page where a flag says no but no finding says why."""
    with_content = F.when(~content & (F.size(found) == 0), whole_page("unresolved_content")).otherwise(found)
    has_quality = F.exists(with_content, lambda x: x["category"] == QUALITY)
    return F.when(~quality & ~has_quality, F.concat(with_content, whole_page(QUALITY))).otherwise(with_content)


def without(found: Column, tolerated: tuple[str, ...]) -> Column:
    return F.filter(found, lambda x: ~x["category"].isin(*tolerated)) if tolerated else found


def parse(text: Column) -> Column:
    """The verdict in a JSON text, or null where it breaks the contract.

    Flags must be booleans, categories and severities known, coordinates finite
    and within 0..1.  Reversed boxes pass here; size tests drop them later.
    """
    v = F.from_json(text, SCHEMA)
    inside = lambda c: c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c <= 1)
    good = F.forall(v["discrepancies"], lambda x: x["category"].isin(*CATEGORIES) & x["severity"].isin(*SEVERITIES) & inside(x["region"]["l"]) & inside(x["region"]["t"]) & inside(x["region"]["r"]) & inside(x["region"]["b"]))
    return F.when(v["content_match"].isNotNull() & v["scanner_quality"].isNotNull() & v["discrepancies"].isNotNull() & F.coalesce(good, F.lit(False)), v)
