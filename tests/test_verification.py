import json

from foliomill.operators import verification as vf


def verdict(content=True, quality=True, *found):
    return {"content_match": content, "scanner_quality": quality, "discrepancies": [{"category": c, "severity": "medium", "region": {"l": 0.2, "t": 0.3, "r": 0.8, "b": 0.4}} for c in found]}


ACCEPT, QUALITY, CONTENT = verdict(), verdict(True, False, "scanner_quality"), verdict(False, True, "changed_text")


def scripted(script):
    class Scripted(vf.Reviewer):
        def review(self, page_id, view_idx, call_no, payload):
            if payload == b"broken":
                raise TimeoutError
            return json.dumps(script.get((view_idx, call_no), {"content_match": True, "scanner_quality": True, "discrepancies": []}))

    return Scripted


def run(spark, script, tolerated=(), **flags):
    views = spark.createDataFrame([(1, v, b"x") for v in range(5)], "page_id long, view_idx int, payload binary")
    calls = vf.parsed_calls(vf.record_calls(views, scripted(script), 3))
    chosen = vf.chosen(calls, **flags)
    return vf.page_verdicts(chosen, tolerated).first(), vf.page_findings(chosen, tolerated, 1000, 1000).collect()


def test_accepts(spark):
    page, findings = run(spark, {})
    assert page.accepted and page.views_read == 5 and findings == []


def test_second_call_decides_on_quality_only(spark):
    assert run(spark, {(1, 1): QUALITY})[0].accepted
    page, findings = run(spark, {(1, 1): QUALITY, (1, 2): QUALITY})
    assert (page.accepted, page.rejected_view, page.views_read) == (False, 1, 2)
    x = findings[0]
    assert [round(v, 4) for v in (x.l, x.t, x.r, x.b)] == [0.11, 0.165, 0.44, 0.22]


def test_content_isn_t_confirmed_unless_asked(spark):
    assert not run(spark, {(0, 1): CONTENT})[0].accepted
    assert run(spark, {(0, 1): CONTENT}, confirm_rejections=True)[0].accepted


def test_consensus(spark):
    one = {(0, 1): QUALITY, (0, 2): ACCEPT, (0, 3): ACCEPT}
    assert run(spark, one, quality_consensus=True)[0].accepted
    assert not run(spark, one | {(0, 3): CONTENT}, quality_consensus=True)[0].accepted


def test_tolerated_categories_dont_reject(spark):
    mixed = verdict(False, True, "changed_layout")
    page, findings = run(spark, {(2, 1): mixed}, ("changed_layout",))
    assert page.accepted and page.n_tolerated == 1 and [f.category for f in findings] == ["changed_layout"]
    page, findings = run(spark, {(2, 1): verdict(False, True)}, ("changed_layout",))
    assert not page.accepted and [f.category for f in findings] == ["unresolved_content"]


def test_broken_calls_are_kept_and_reject(spark, tmp_path):
    views = spark.createDataFrame([(1, 0, b"broken"), (2, 0, b"x"), (3, 3, b"x")], "page_id long, view_idx int, payload binary")
    calls = vf.record_calls(views, scripted({(3, 1): {"no": "verdict"}}), 1, str(tmp_path / "calls"))
    assert {r.error for r in calls.collect()} == {None, "TimeoutError"}
    pages = {r.page_id: r.accepted for r in vf.page_verdicts(vf.chosen(vf.parsed_calls(calls))).collect()}
    assert pages == {1: False, 2: True, 3: False}
