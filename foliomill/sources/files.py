"""Page files as tables: discovery, image metadata and reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The page formats.
SUFFIXES = ("pdf", "jpg", "jpeg", "png")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def suffix(path: Column) -> Column:
    """Lower-case, without the dot; empty where there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.]\.([^.]*)$", 1))


def is_generated(path: Column) -> Column:
    """Whether a file is our own product: a cleaned page, a report or a temporary file."""
    name = F.lower(file_name(path))
    return F.regexp_replace(name, r"\.[^.]*$", "").endswith(".clean") | name.endswith(".report.json") | name.startswith(".folio-")


def is_page(path: Column) -> Column:
    return suffix(path).isin(*SUFFIXES) & ~is_generated(path)


def output_path(path: Column) -> Column:
    """The cleaned page beside its source."""
    return F.regexp_replace(path, r"^(.*)(\.[^./\\]*)$", "$1.clean$2")


def discover(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """path, length, modificationTime (and content) of the page files under a folder, in order of their paths.

    Symbolic links are left out: Hadoop's listing follows them, so on a local
    folder the links are found first and their paths, or what lies below them, dropped.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    cols = ["path", "length", "modificationTime"] + ["content"] * content
    for link in _links(root):
        plain = F.regexp_replace("path", "^file:/+", "/")
        files = files.where((plain != link) & ~F.startswith(plain, F.lit(link + "/")))
    return files.where(is_page(F.col("path"))).select(*cols).orderBy("path")


def _links(root: str) -> list[str]:
    """The symbolic links below a local folder; elsewhere there are none."""
    import os

    place = root.removeprefix("file://")
    return [p for top, folders, names in os.walk(place) for n in folders + names if os.path.islink(p := os.path.join(top, n))] if "://" not in place else []


def images(spark: SparkSession, root: str) -> DataFrame:
    """path, width, height, channels and the pixels, in RGB order and upright, of the PNG and JPEG files under a folder.

    The decoder of Spark knows no EXIF, so the orientation is read from the first
    part of the files and joined by path.
    """
    found = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(root).select("image.*")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    turns = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[jJ][pP]*[gG]").load(root).select(plain("path").alias("at"), _orientation("content").alias("turn"))
    rows = found.withColumn("at", plain("origin")).join(turns, "at", "left").withColumn("turn", F.coalesce("turn", F.lit(1)))
    turned = F.col("turn") >= 5  # height and width change places
    return rows.select(
        F.col("origin").alias("path"),
        F.when(turned, F.col("height")).otherwise(F.col("width")).alias("width"),
        F.when(turned, F.col("width")).otherwise(F.col("height")).alias("height"),
        F.col("nChannels").alias("channels"),
        _rgb("data", "nChannels", "height", "width", "turn").alias("data"),
    )


@F.pandas_udf(T.IntegerType())
def _orientation(content: pd.Series) -> pd.Series:
    from foliomill.functions.images import orientation

    return content.map(orientation)


@F.pandas_udf(T.BinaryType())
def _rgb(data: pd.Series, channels: pd.Series, height: pd.Series, width: pd.Series, turn: pd.Series) -> pd.Series:
    import numpy as np

    from foliomill.functions.images import upright

    pages = (np.frombuffer(d, np.uint8).reshape(h, w, c) for d, c, h, w in zip(data, channels, height, width))
    return pd.Series([upright(np.concatenate([p[..., 2::-1], p[..., 3:]], axis=2) if p.shape[2] >= 3 else p, t).tobytes() for p, t in zip(pages, turn)])


def report_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Report files, one JSON object per line; a malformed line keeps its text in _corrupt_record."""
    reader = spark.read.option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def documents(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """A store of one JSON document per folder (root/*/name), with the folder's name as ``folder``.

    A file that isn't JSON gives a row of nulls beside its folder.
    """
    rows = spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(f"{root}/*/{name}")
    return rows.withColumn("folder", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))


# Name, then the value: in single or double quotes, or bare up to a comment.
_ASSIGNMENT = r"""^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(?:'([^']*)'|"((?:[^"\\]|\\.)*)"|([^'"#]*?))\s*(?:#.*)?$"""


def settings_file(spark: SparkSession, path: str) -> DataFrame:
    """name, value, problem: the assignments of a settings file; problem holds a line that is neither assignment, comment nor blank.

    Of several assignments to a name the last counts, which ``layered`` sees to by line_no.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line")).where(~F.col("line").rlike(r"^\s*(#.*)?$"))
    part = lambda i: F.regexp_extract("line", _ASSIGNMENT, i)
    ok = F.col("line").rlike(_ASSIGNMENT)
    value = F.concat(part(2), F.regexp_replace(part(3), r"\\(.)", "$1"), part(4))
    return lines.select("line_no", F.when(ok, part(1)).alias("name"), F.when(ok, value).alias("value"), F.when(~ok, F.col("line")).alias("problem"))


def layered(*layers: DataFrame) -> DataFrame:
    """name, value: settings of several layers (name, value and perhaps line_no), later layers over earlier ones."""
    rows = [x.select("name", "value", F.lit(i).alias("layer"), F.col("line_no") if "line_no" in x.columns else F.lit(0).alias("line_no")).where("name is not null") for i, x in enumerate(layers)]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    return every.groupBy("name").agg(F.max_by("value", F.struct("layer", "line_no")).alias("value"))


def publish(pairs: DataFrame, root: str, force: bool = False) -> DataFrame:
    """name, published: every page and its report written as one folder root/name.pair, which appears whole or not at all.

    pairs: name (unique, not null), page (bytes), report (text).  Both files are
    staged in a hidden folder beside the target, and one rename publishes them.  A
    target that is there already is left alone (published is false) unless
    ``force``, which moves it aside first and back again if the rename fails.
    root is a folder all executors reach; a task that runs again changes nothing
    more, as its staging folder has a name of its own.
    """

    def run(batches):
        import os
        import shutil
        import uuid

        import pyarrow as pa

        for batch in batches:
            done = []
            for name, page, report in zip(*(batch.column(i).to_pylist() for i in range(3))):
                target, stage = f"{place}/{name}.pair", f"{place}/.folio-{name}-{uuid.uuid4().hex}"
                os.makedirs(stage, mode=0o700)
                for file, data in (("page", page), ("report.json", report.encode())):
                    with open(os.open(f"{stage}/{file}", os.O_WRONLY | os.O_CREAT, 0o600), "wb") as out:
                        out.write(data)
                        out.flush()
                        os.fsync(out.fileno())
                aside = f"{stage}.old"
                if force and os.path.exists(target):
                    os.rename(target, aside)
                try:
                    os.rename(stage, target)
                    done.append(True)
                except OSError:
                    shutil.rmtree(stage)
                    if os.path.exists(aside):
                        os.rename(aside, target)
                    done.append(False)
                shutil.rmtree(aside, ignore_errors=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.bool_())], names=["name", "published"])

    place = root.removeprefix("file://").rstrip("/")
    return pairs.select("name", "page", "report").mapInArrow(run, "name string, published boolean")


def write_reports(reports: DataFrame, path: str) -> None:
    """Reports as JSON lines, nulls included."""
    reports.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
