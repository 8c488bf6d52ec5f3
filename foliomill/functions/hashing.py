"""Signatures of pages, texts and manifests."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFC", t), na_action="ignore")


def text_signature(text: Column) -> Column:
    """SHA-256 of the text in composed form with plain line ends; that of the empty text for null."""
    return F.sha2(F.replace(nfc(F.coalesce(text, F.lit(""))), F.lit("\r\n"), F.lit("\n")), 256)


def pixel_hash(data: Column, width: Column, height: Column) -> Column:
    """SHA-256 of a header with the size and the raw pixels."""
    head = F.concat(F.lit("RGB:"), width.cast("string"), F.lit("x"), height.cast("string"), F.lit(":"))
    return F.sha2(F.concat(F.encode(head, "UTF-8"), data), 256)


def canonical_json(**fields: Column) -> Column:
    """A JSON object of the fields in the order of their names, nulls included."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def sealed(payload: Column) -> Column:
    """A canonical JSON text together with its hash, again canonical: what is embedded in images."""
    return F.concat(F.lit('{"payload":'), payload, F.lit(',"payload_sha256":"'), F.sha2(payload, 256), F.lit('"}'))
