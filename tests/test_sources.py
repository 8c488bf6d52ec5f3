import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliomill.functions import images, rules
from foliomill.operators import folds
from foliomill.operators.pairing import strict_zip
from foliomill.sources import files, pdf

PDF = b"""%PDF-1.7
1 0 obj << /Type /Catalog /Pages 2 0 R /AcroForm << /Fields [5 0 R] /CO [5 0 R] >> /OpenAction 9 0 R % note /Encrypt
>> endobj
2 0 obj
<< /Kids [3 0 R] /Count 1 /Title (a \\) ( b) >>
endobj
3 0 obj << /Type /Page /Annots [4 0 R] >> endobj
4 0 obj << /Subtype /Widget /FT /Sig /Data <AF 01> >> endobj
6 0 obj << /Length 9 >> stream
/JS bytes endstream endobj
"""


def test_pdf_objects(spark):
    df = spark.createDataFrame([("a.pdf", PDF), ("b.pdf", b"no pdf"), ("c.pdf", None), ("d.pdf", b"%PDF-1.4\ntrailer << /Encrypt 3 0 R >>"), ("e.pdf", b"%PDF-1.4\n1 0 obj << /S /JavaScript >> endobj 2 0 obj << /Subtype /Redact /Annots [] >> endobj")], "path string, content binary")
    rows = {(r.object_id, r.key): r.value for r in pdf.scan(df.where("path = 'a.pdf'")).collect()}
    assert rows[(0, "Header")] == "1.7" and rows[(1, "Pages")] == "2 0 R" and rows[(2, "Count")] == "1" and rows[(1, "CO")] == "[]"
    assert rows[(4, "FT")] == "/Sig" and rows[(6, "Length")] == "9" and (6, "JS") not in rows
    got = {r.path: (r.unsafe, r.removed) for r in pdf.findings(pdf.scan(df)).collect()}
    assert got == {"a.pdf": ("calculated_forms", ["annotations", "digital_signatures", "document_actions", "interactive_forms"]), "b.pdf": ("no_pdf", []), "c.pdf": ("no_pdf", []), "d.pdf": ("encrypted", []), "e.pdf": ("javascript", ["annotations"])}
    assert pdf.findings(pdf.scan(df.limit(0))).count() == 0


def test_rendered_pages(spark):
    class TwoPages(pdf.Renderer):
        def render(self, content, dpi):
            if content == b"broken":
                raise ValueError(content)
            for page in (1, 2):
                yield page, 1, 1, content[:3]

    df = spark.createDataFrame([("a", b"rgb..."), ("b", b"broken")], "path string, content binary")
    assert sorted(tuple(r)[:4] + (r.error,) for r in pdf.pages(df, TwoPages).collect() if r.path == "a") == [("a", 1, 1, 1, None), ("a", 2, 1, 1, None)]
    assert [r.error for r in pdf.pages(df.where("path = 'b'"), TwoPages).collect()] == ["ValueError"]


def test_discovery_leaves_links_out(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name in ("b.PNG", "a.pdf", "a.clean.pdf", "notes.txt", "deep/c.jpeg"):
        (tmp_path / name).write_bytes(b"x")
    os.symlink(tmp_path / "a.pdf", tmp_path / "link.pdf")
    os.symlink(tmp_path / "deep", tmp_path / "again")
    got = [r.path.rpartition(str(tmp_path))[2] for r in files.discover(spark, str(tmp_path)).collect()]
    assert got == ["/a.pdf", "/b.PNG", "/deep/c.jpeg"]


def test_document_store(spark, tmp_path):
    for name, text in (("v1", json.dumps({"id": "v1", "number": 1}, indent=2)), ("v2", "{broken")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "version.json").write_text(text)
    got = {r.folder: (r.id, r.number) for r in files.documents(spark, f"file://{tmp_path}", "version.json", "id string, number int").collect()}
    assert got == {"v1": ("v1", 1), "v2": (None, None)}


def test_settings_files(spark, tmp_path):
    low, high = tmp_path / "low.env", tmp_path / "high.env"
    low.write_text("# settings\n\nexport A=one # why\nB='two words' \nC=\"x \\\" y\"\nbroken line\nA=again\n")
    high.write_text("B=three\r\nD=\r\n")
    a, b = (files.settings_file(spark, f"file://{p}") for p in (low, high))
    assert [r.problem for r in a.where("problem is not null").collect()] == ["broken line"]
    process = spark.createDataFrame([("C", "top")], "name string, value string")
    assert {r.name: r.value for r in files.layered(a, b, process).collect()} == {"A": "again", "B": "three", "C": "top", "D": ""}


def test_pairs_are_published_whole(spark, tmp_path):
    df = spark.createDataFrame([("a", b"page", "{}"), ("b", b"p2", "{}")], "name string, page binary, report string")
    root = f"file://{tmp_path}"
    assert {tuple(r) for r in files.publish(df, root).collect()} == {("a", True), ("b", True)}
    assert (tmp_path / "a.pair" / "page").read_bytes() == b"page" and (tmp_path / "a.pair" / "report.json").read_text() == "{}"
    newer = spark.createDataFrame([("a", b"new", "{}")], df.schema)
    assert files.publish(newer, root).first().published is False and (tmp_path / "a.pair" / "page").read_bytes() == b"page"
    assert files.publish(newer, root, force=True).first().published and (tmp_path / "a.pair" / "page").read_bytes() == b"new"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.pair", "b.pair"]


def test_strict_zip(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    b = spark.createDataFrame([(2, "v"), (1, "u")], "k int, b string")
    assert sorted(map(tuple, strict_zip(a, b, ["k"]).collect())) == [(1, "x", "u"), (2, "y", "v")]
    assert strict_zip(a.limit(0), b.limit(0), ["k"]).count() == 0
    with pytest.raises(Exception, match="no partner"):
        strict_zip(a, b.where("k = 1"), ["k"]).collect()


def test_first_targets(spark):
    box = "struct<l: double, t: double, r: double, b: double>"
    rows = [(1, [(0.1, 0.1, 0.5, 0.15), (0.12, 0.1, 0.52, 0.15), None, (0.7, 0.7, 0.8, 0.8)]), (2, []), (3, None)]
    df = spark.createDataFrame(rows, f"i int, xs array<{box}>").select("i", folds.first_targets(F.col("xs")).alias("k"))
    assert {r.i: r.k and [tuple(x) for x in r.k] for r in df.collect()} == {1: [(0.1, 0.1, 0.5, 0.15), (0.7, 0.7, 0.8, 0.8)], 2: [], 3: None}


def test_gate_and_errors(spark):
    c = lambda *v: [F.lit(x) for x in v]
    one = spark.range(1).select(
        rules.gate_issues(*c(149.0, 150, False, True, 50, 100, 56, 100, 1)).alias("all"),
        rules.gate_issues(*c(150.0, 150, False, False, 31, 31, 9, 9, 0)).alias("none"),
        rules.retry_after(F.lit("Wed, 01 Jan 2020 00:01:00 GMT"), F.lit("2020-01-01 00:00:50").cast("timestamp")).alias("wait"),
        rules.retry_after(F.lit("-4"), F.current_timestamp()).alias("least"),
        rules.error_class(*c(400, "x", "Image TOO LARGE", False)).alias("large"),
        rules.first_met(("a", F.lit(None).cast("boolean")), ("b", F.lit(True))).alias("null_is_no"),
    ).first()
    assert list(one.all) == ["generated_resolution_below_minimum", "page_registration_failed", "large_foreground_loss", "large_candidate_only_foreground", "residual_punch_hole"]
    assert one.none == [] and one.wait == 10 and one.least == 0 and one.large == "too_large" and one.null_is_no == "b"


@pytest.mark.parametrize("end", ["<", ">"])
def test_exif_orientation(end):
    tiff = (b"II" if end == "<" else b"MM") + struct.pack(end + "HIH", 42, 8, 2) + struct.pack(end + "HHII", 0x10F, 2, 1, 0) + struct.pack(end + "HHIHH", 0x112, 3, 1, 6, 0)
    exif = b"Exif\0\0" + tiff
    data = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xda\x00\x02\xff\xd9"
    assert images.orientation(data) == 6
    assert [images.orientation(x) for x in (None, b"", data[:30], b"\xff\xd8\xff\xda\x00\x02")] == [1, 1, 1, 1]
    a = np.arange(6).reshape(2, 3)
    assert images.upright(a, 6).tolist() == [[3, 0], [4, 1], [5, 2]] and images.upright(a, 8).tolist() == [[2, 5], [1, 4], [0, 3]]
    assert images.upright(a, 2).tolist() == [[2, 1, 0], [5, 4, 3]] and images.upright(a, 5).tolist() == a.T.tolist() and images.upright(a, 7).tolist() == a[::-1, ::-1].T.tolist()
    assert images.upright(a, 4).tolist() == a[::-1].tolist() and images.upright(a, 1).tolist() == a.tolist()


def test_image_files(spark, tmp_path):
    a = np.arange(20, dtype=np.uint8).reshape(4, 5)
    (tmp_path / "a.png").write_bytes(images.png(a))
    (tmp_path / "bad.jpg").write_bytes(b"no image")
    r = files.images(spark, str(tmp_path)).collect()
    assert [(x.width, x.height) for x in r] == [(5, 4)] and np.frombuffer(r[0].data, np.uint8).reshape(4, 5, -1)[..., 0].tolist() == a.tolist()
