import pytest
from pyspark.sql import functions as F

from foliomill.functions import boxes as bx
from foliomill.functions import hashing, verdicts
from foliomill.operators import folds
from foliomill.operators.matching import nearest
from foliomill.sources import files


def on(spark, box):
    return spark.createDataFrame([box], "l double, t double, r double, b double")


def values(spark, box, f):
    out = f(bx.box())
    return tuple(round(x, 6) for x in on(spark, box).select(*(c.alias(n) for c, n in zip(out, "ltrb"))).first())


def test_boxes(spark):
    assert values(spark, (0.2, 0.5, 0.4, 0.95), bx.footer_widened) == (0, 0.5, 1, 1)
    assert values(spark, (0.1, 0.5, 0.6, 0.52), bx.quality_context) == (0.1, 0.45, 0.6, 0.57)
    assert values(spark, (0.0, 0.0, 0.02, 0.02), bx.hole_context) == (0, 0, 0.36, 0.12)
    assert values(spark, (0.5, 0.5, 0.6, 0.6), bx.repair_box) == (0.475, 0.45, 0.625, 0.65)
    for box, fits in (((0.1, 0.1, 0.6, 0.11), True), ((0.1, 0.1, 0.6, 0.6), False), ((0.6, 0.1, 0.1, 0.2), False)):
        assert on(spark, box).select(bx.quality_target(bx.box())[1]).first()[0] == fits


def test_tiles(spark):
    rows = spark.range(1).select(F.inline(bx.tiles(F.lit(101), F.lit(200)))).collect()
    assert [tuple(r) for r in rows] == [(0, 0, 0, 101, 200), (1, 0, 0, 55, 110), (2, 45, 0, 101, 110), (3, 0, 90, 55, 200), (4, 45, 90, 101, 200)]


def test_distinct_targets(spark):
    box = lambda k, i, l, t, r, b: {"k": k, "disc_no": i, "l": l, "t": t, "r": r, "b": b}
    xs = [box(-4, 1, 0.1, 0.1, 0.2, 0.2), box(-3, 2, 0.1, 0.1, 0.22, 0.22), box(-1, 3, 0.7, 0.7, 0.8, 0.8)]
    df = spark.createDataFrame([(xs,), ([],), (None,)], "xs array<struct<k: int, disc_no: int, l: double, t: double, r: double, b: double>>")
    got = [r[0] for r in df.select(folds.distinct_targets(F.col("xs"))).collect()]
    assert [(x.l, x.r) for x in got[0]] == [(0.1, 0.22), (0.7, 0.8)] and got[1] == [] and got[2] is None
    assert len(df.select(folds.distinct_targets(F.col("xs"), 1)).first()[0]) == 1


def test_verdict_rules(spark):
    ok = '{"content_match": true, "scanner_quality": false, "discrepancies": []}'
    bad = ['{"content_match": "yes", "scanner_quality": true, "discrepancies": []}', "nonsense", None, '{"content_match": true, "scanner_quality": true, "discrepancies": [{"category": "glare", "severity": "low", "region": {"l": 0, "t": 0, "r": 1, "b": 1}}]}', '{"content_match": true, "scanner_quality": true, "discrepancies": [{"category": "changed_text", "severity": "low", "region": {"l": 0, "t": 0, "r": 1.5, "b": 1}}]}']
    df = spark.createDataFrame([(t,) for t in [ok, *bad]], "t string").select(verdicts.parse(F.col("t")).alias("v"))
    rows = df.collect()
    assert rows[0].v is not None and all(r.v is None for r in rows[1:])
    v = df.where("v is not null").select(verdicts.quality_only(F.col("v.content_match"), F.col("v.scanner_quality"), F.col("v.discrepancies")), verdicts.completed(F.col("v.content_match"), F.col("v.scanner_quality"), F.col("v.discrepancies"))).first()
    assert v[0] is True and [x.category for x in v[1]] == ["scanner_quality"]


@pytest.mark.parametrize("path,page,out", [("/a/b.PNG", True, "/a/b.clean.PNG"), ("/a/b.clean.png", False, "/a/b.clean.clean.png"), ("/a/x.clean.png.report.json", False, None), ("/a.d/noext", False, None), ("scan.pdf", True, "scan.clean.pdf")])
def test_paths(spark, path, page, out):
    r = spark.createDataFrame([(path,)], "p string").select(files.is_page(F.col("p")), files.output_path(F.col("p"))).first()
    assert r[0] == page and (out is None or r[1] == out)


def test_discovery_and_images(spark, tmp_path):
    import numpy as np

    from foliomill.functions import images

    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.png").write_bytes(images.png(np.full((20, 30), 7, np.uint8)))
    (tmp_path / "a.clean.png").write_bytes(b"x")
    (tmp_path / "notes.txt").write_bytes(b"x")
    assert [r.path.rpartition("/")[2] for r in files.discover(spark, str(tmp_path)).collect()] == ["b.png"]
    row = files.images(spark, str(tmp_path / "sub")).first()
    assert (row.width, row.height) == (30, 20) and set(row.data) == {7}


def test_signature(spark):
    rows = spark.createDataFrame([("é\r\n",), ("é\n",), ("é",), (None,), ("",)], "t string").select(hashing.text_signature(F.col("t")).alias("s")).collect()
    s = [r.s for r in rows]
    assert s[0] == s[1] != s[2] and s[3] == s[4]


def test_nearest_with_ties_and_dirt(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0]), (4, None), (5, [1.0]), (20, [0.0, 0.5]), (None, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, dist string")
    got = nearest(df.where("vec_id in (1, 20)"), df, 2, dim=2).collect()
    assert {(r.qid, r["rank"], r.id) for r in got} == {(1, 1, 20), (1, 2, 2), (20, 1, 1), (20, 2, 2)}
    assert nearest(df.limit(0), df, 2, dim=2).count() == 0
