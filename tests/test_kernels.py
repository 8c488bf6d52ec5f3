import hashlib
import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliomill.functions import hashing, images, raster
from foliomill.operators import pages
from foliomill.operators.pages import Sheet
from foliomill.plans import rasters


def brute(a, kx, ky, f):
    h, w = a.shape
    return np.array([[f(a[max(0, y - ky // 2) : y + ky // 2 + 1, max(0, x - kx // 2) : x + kx // 2 + 1]) for x in range(w)] for y in range(h)])


@pytest.mark.parametrize("kx,ky", [(1, 1), (3, 3), (5, 1), (1, 7), (9, 5)])
def test_windows_against_brute_force(kx, ky):
    a = np.random.default_rng(kx * ky).integers(0, 256, (9, 13)).astype(np.uint8)
    assert (raster.dilate(a, kx, ky) == brute(a, kx, ky, np.max)).all()
    assert (raster.erode(a, kx, ky) == brute(a, kx, ky, np.min)).all()
    assert (raster.box_sum(a, kx, ky) == brute(a, kx, ky, lambda x: int(x.sum()))).all()


def flood(mask):
    labels, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if labels[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        while todo:
            v, u = todo.pop()
            if 0 <= v < mask.shape[0] and 0 <= u < mask.shape[1] and mask[v, u] and not labels[v, u]:
                labels[v, u] = n
                todo += [(v + i, u + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return labels, n


@pytest.mark.parametrize("share", [0.1, 0.4, 0.6, 1.0])
def test_components_against_flood_fill(share):
    mask = np.random.default_rng(11).random((24, 31)) < share
    labels, n = raster.components(mask)
    want, m = flood(mask)
    assert n == m and len(set(zip(labels.ravel().tolist(), want.ravel().tolist()))) == n + (0 if mask.all() else 1)
    areas = sorted(raster.component_stats(labels, n)[:, 0].tolist())
    assert areas == sorted(np.bincount(want.ravel())[1:].tolist())


def test_sheet_is_its_pages():
    texts = ["word " * 90, None, "", "é\U0001f600" * 40, "x"]
    sheet = Sheet(pa.array(texts), 3, [])
    for k, page in sheet.pages():
        codes = [ord(c) % 256 for c in texts[k] or ""]
        want = np.array(codes + [255] * (-len(codes) % 64), np.uint8).reshape(-1, 64)
        assert (page == want).all() and page.shape == want.shape
        for kx, ky in ((3, 3), (5, 7)):
            got = raster.dilate(sheet.hold(sheet.a, 0), kx, ky)[sheet.page == k]
            assert (got == raster.dilate(want, kx, ky)).all()
    assert sheet.sums(sheet.a).tolist() == [int(p.sum()) for _, p in sheet.pages()]
    empty = Sheet(pa.array([], pa.string()), 2, [])
    assert empty.sums(empty.a).tolist() == [] and raster.components(empty.a < 9)[1] == 0


def test_long_pages_are_cut_into_sheets(spark, monkeypatch):
    monkeypatch.setattr(pages, "SHEET", 1 << 12)
    docs = spark.createDataFrame([(i, "ab\n" * (i % 7) * 50) for i in range(40)] + [(None, None)], "doc_id long, text string")
    rows = pages.over_pages(docs, lambda s: (None, s.heights), "page_id long, height int").collect()
    assert sorted((r.page_id if r.page_id is not None else -1, r.height) for r in rows) == [(-1, 0)] + [(i, -(-(i % 7) * 150 // 64)) for i in range(40)]


def test_specks_keep_strokes():
    m = np.zeros((20, 30), bool)
    m[5, 3:20] = True
    m[15, 25] = True
    m[6, 22] = True
    assert raster.specks(m).sum() == 2 and raster.specks(m)[15, 25]
    assert not raster.specks(m)[5].any()


def test_homography_with_outliers():
    rng = np.random.default_rng(1)
    src = rng.random((40, 2)) * 100
    m = np.array([[1.02, 0.01, 3], [-0.02, 0.98, -2], [1e-5, 0, 1]])
    p = np.c_[src, np.ones(40)] @ m.T
    dst = p[:, :2] / p[:, 2:]
    dst[:8] += 50
    got, ok = raster.ransac(src, dst, 1.0)
    assert ok[8:].all() and not ok[:8].any() and np.allclose(got, m, atol=1e-6)
    page = np.full((30, 30), 200, np.uint8)
    assert (raster.bilinear(page, np.eye(3), (30, 30)) == page).all()


def test_manifests_round_trip():
    a = np.arange(64 * 3, dtype=np.uint8).reshape(3, 64)
    data, manifest = images.png(a), b'{"run_id":"abc"}'
    out = images.embed(data, manifest)
    assert images.extract(out) == manifest and (images.gray_of(out) == a).all() and images.extract(data) is None
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02pixels\xff\xd9"
    out = images.embed(jpeg, manifest)
    assert images.extract(out) == manifest and out.endswith(jpeg[2:]) and images.extract(jpeg) is None
    for bad in (b"", b"no image", data[:20], jpeg[:9], b"\xff\xd8\xff\xe0\x00\x01"):
        assert images.extract(bad) is None
        with pytest.raises(ValueError):
            images.embed(bad, manifest)
    with pytest.raises(ValueError):
        images.embed(data, b"x" * (images.MOST + 1))


@pytest.mark.parametrize("scan", [b"", b"\0", b"\0\0x", b"\0\1x", b"\xff", b"\xff\xd9x", b"\xff\xda\0\0", b"\xff\xff\0"])
def test_any_scan_data_makes_a_jpeg(scan):
    plain, manifest = images.jpeg(scan), b'{"run_id":"abc"}'
    out = images.embed(plain, manifest)
    assert images.extract(out) == manifest and out.endswith(plain[2:]) and images.extract(plain) is None
    head, coded = plain[:-2].split(b"\xff\xda\0\x08\1\1\0\0\x3f\0", 1)
    assert head == b"\xff\xd8\xff\xe0\0\4ab" and plain.endswith(b"\xff\xd9")
    assert coded.replace(b"\xff\0", b"\xff") == scan and coded.count(b"\xff") == coded.count(b"\xff\0")  # no marker within


def test_manifests_of_pages_of_any_hash(spark, tmp_path):
    """The hashes of the second and third page begin with 0000 and 0001, that of the fourth with ffd9."""
    texts = {1: "a", 2: "page 168887", 3: "page 122755", 4: "page 59668", 5: "é" * 200, 6: "", 7: None}
    begins = [hashlib.sha256(texts[k].encode().ljust(64, b"\xff")).hexdigest()[:4] for k in (2, 3, 4)]
    assert begins == ["0000", "0001", "ffd9"]
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sealed = {k: f'{{"payload":{{"height":{-(-len(t) // 64)},"run_id":"{k}"}},"payload_sha256":"{"0" * 64}"}}' for k, t in texts.items() if t}
    for kind, over in (("png", 31), ("jpeg", 19)):
        got = sorted(map(tuple, rasters.QUERIES[f"{kind}_manifest"](spark, str(tmp_path)).collect()))
        assert got == [(k, over + len(m), True, True) for k, m in sealed.items()]


def test_sealed_manifest(spark):
    text = spark.range(1).select(hashing.sealed(hashing.canonical_json(b=F.lit(1), a=F.lit("é"))).alias("m")).first().m
    payload = '{"a":"é","b":1}'
    assert json.loads(text) == {"payload": json.loads(payload), "payload_sha256": hashlib.sha256(payload.encode()).hexdigest()}
    assert text == json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
