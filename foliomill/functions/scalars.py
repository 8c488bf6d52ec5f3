"""Small conversions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def data_url(data: Column, kind: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.replace(F.base64(data), F.lit("\r\n"), F.lit("")))


def from_data_url(url: Column) -> Column:
    """The bytes of an image data URL, null for anything else."""
    body = F.regexp_extract(url, r"^data:image/[a-z0-9.+-]+;base64,([A-Za-z0-9+/=\r\n]*)$", 1)
    return F.when(url.rlike(r"^data:image/[a-z0-9.+-]+;base64,[A-Za-z0-9+/=\r\n]*$"), F.try_to_binary(body, F.lit("base64")))


def model_parts(model: Column) -> list[Column]:
    """Author and name of a model id, split at the first slash; the name is null without one."""
    return [F.substring_index(model, "/", 1).alias("author"), F.when(F.contains(model, F.lit("/")), F.regexp_extract(model, r"^[^/]*/(.*)$", 1)).alias("name")]


def utc_iso(text: Column) -> Column:
    """An ISO time of any offset as UTC with a Z; null if it isn't one."""
    at = F.try_to_timestamp(text)
    seconds = F.unix_seconds(at)
    day = F.date_from_unix_date(F.floor(seconds / 86400).cast("int"))
    s = F.pmod(seconds, F.lit(86400))
    part = lambda x: F.lpad(x.cast("long").cast("string"), 2, "0")
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), F.concat_ws(":", part(F.floor(s / 3600)), part(F.floor(s % 3600 / 60)), part(s % 60)), F.lit("Z"))


def clamped(text: Column, low: float, high: float, default: float) -> Column:
    """A number in a text, kept between bounds; the default where it is none or not finite."""
    n = text.try_cast("double")
    return F.when(n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")), F.lit(default)).otherwise(F.least(F.greatest(n, F.lit(low)), F.lit(high)))
