"""PDF files as rows of their objects, and what of them can't be kept.

A file is read as a table of dictionary entries.  ``scan`` finds the plain
objects of a file; compressed object streams and page rendering need a library
and go through the same table (``Renderer``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.functions import rules

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj\b", re.S)
_TOKEN = re.compile(rb"<<|>>|\[|\]|\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|/[^\s<>\[\]()/%]*|[^\s<>\[\]()/%]+|%[^\r\n]*")
_ENCRYPTED = re.compile(rb"/Encrypt\s*(?:\d+\s+\d+\s+R\b|<<)")


def entries(body: bytes) -> Iterator[tuple[str, str]]:
    """(key, value) of the dictionaries of an object, inner ones first; a value has its tokens with blanks between, lists and dictionaries in it empty."""
    open_: list[tuple[str, list[str]]] = []  # the kind of each open bracket, and the tokens directly in it
    for m in _TOKEN.finditer(body.partition(b"stream")[0]):
        t = m[0].decode("latin-1")
        if t in ("<<", "["):
            open_.append((t, []))
        elif t in (">>", "]") and open_:
            kind, tokens = open_.pop()
            if kind == "<<":
                yield from _keyed(tokens)
            if open_:
                open_[-1][1].append(kind + t)
        elif open_ and not t.startswith("%"):
            open_[-1][1].append(t)


def _keyed(tokens: list[str]) -> Iterator[tuple[str, str]]:
    """A key is a name where none is open or the open one has a value."""
    key, value = None, []
    for t in tokens:
        if t.startswith("/") and (key is None or value):
            if key is not None:
                yield key, " ".join(value)
            key, value = t[1:], []
        else:
            value.append(t)
    if key is not None:
        yield key, " ".join(value)


def scan(files: DataFrame) -> DataFrame:
    """path, object_id, key, value: the dictionary entries of the plain objects of PDF files (path, content).

    object_id 0 has one entry per file: Header with the version, or null where the
    content is null or no PDF, and Encrypt where the file names one.
    """

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                version = re.match(rb"%PDF-(\d\.\d)", data or b"")
                rows.append((path, 0, "Header", version and version[1].decode()))
                if not version:
                    continue
                if _ENCRYPTED.search(data):
                    rows.append((path, 0, "Encrypt", "true"))
                rows += [(path, int(m[1]), k, v) for m in _OBJECT.finditer(data) for k, v in entries(m[2])]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string()))], names=["path", "object_id", "key", "value"])

    return files.select("path", "content").mapInArrow(run, "path string, object_id int, key string, value string")


def read(spark: SparkSession, root: str) -> DataFrame:
    """The object rows of all PDF files under a folder."""
    return scan(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(root))


def findings(objects: DataFrame) -> DataFrame:
    """path, unsafe, removed: per file the first reason to refuse it (null where it is safe) and the sorted features that a raster overlay removes.

    objects: path, object_id, key, value; repeated rows don't matter, null keys and values count as absent.
    """
    key, value = F.col("key"), F.coalesce("value", F.lit(""))
    has = lambda *names: key.isin(*names)
    # What makes a file unsafe, in this order, and what is lost.
    unsafe = {
        "no_pdf": has("Header") & (value == ""),
        "encrypted": has("Encrypt"),
        "xfa_forms": has("XFA"),
        "calculated_forms": has("CO"),
        "javascript": has("JavaScript", "JS") | (has("S") & (value == "/JavaScript")),
        "unapplied_redaction": has("Subtype") & (value == "/Redact"),
    }
    removed = (
        ("interactive_forms", has("AcroForm")),
        ("document_actions", has("OpenAction")),
        ("actions", has("AA")),
        ("embedded_files", has("EmbeddedFiles")),
        ("associated_files", has("AF")),
        ("annotations", has("Annots")),
        ("rich_media", has("Subtype") & (value == "/RichMedia")),
        ("digital_signatures", has("FT") & (value == "/Sig")),
    )
    # End of fixed values.
    worst = F.array_position(F.array(*map(F.lit, unsafe)), rules.first_met(*unsafe.items()))
    rows = objects.select("path", worst.alias("worst"), F.explode_outer(rules.all_met(*removed)).alias("removed"))
    found = rows.groupBy("path").agg(F.min(F.when(F.col("worst") > 0, F.col("worst"))).alias("worst"), F.array_sort(F.collect_set("removed")).alias("removed"))
    return found.select("path", rules.first_met(*((label, F.col("worst") == i) for i, label in enumerate(unsafe, 1))).alias("unsafe"), "removed")


class Renderer:
    """What a library for PDF pages must offer; one is made per task by the factory given to ``pages``."""

    def render(self, content: bytes, dpi: int) -> Iterator[tuple[int, int, int, bytes]]:
        """(page number, width, height, RGB bytes) of every page."""
        raise NotImplementedError


def pages(files: DataFrame, factory: Callable[[], Renderer], dpi: int = 300) -> DataFrame:
    """path, page, width, height, data, error: the rendered pages of files (path, content), a row with the error's class where a file fails."""

    def run(batches):
        renderer = factory()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows = [(path, *p, None) for p in renderer.render(content, dpi)]
                except Exception as e:
                    rows = [(path, None, None, None, None, type(e).__name__)]
                cols = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()))], names=["path", "page", "width", "height", "data", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, page int, width int, height int, data binary, error string")
