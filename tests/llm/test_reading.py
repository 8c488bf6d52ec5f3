import random

import pytest

from foliomill.llm import reading

EASY = ["The cat sat on the bed and it was wet.", "My dad had two pens in the box.", "We can see a big map by the door.", "She put down the red cup at noon."]
HARD = ["The anisotropic registration residual correlates with the chromatic offset of the segmentation.", "Hold the gain and gate the skew term in the matte.", "Laches tolls the claim and the fee vests not in the donee.", "Notwithstanding the foregoing provisions, the depositor shall indemnify the repository for the misattribution."]


def text(kind, rng, n=8):
    return " ".join(rng.choice(kind) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    docs = [(k, text(EASY if k % 2 else HARD, rng)) for k in range(80)] + [(900, None), (901, "")]
    labels = [(k, rng.choice([1, 2]) if k % 2 else rng.choice([4, 5])) for k in range(80)] + [(0, 5), (1, 1), (2, None), (None, 3), (900, 4), (5000, 2)]
    d = spark.createDataFrame([(*x, "q") for x in docs], "doc_id long, text string, level string")
    return reading.fit(d, spark.createDataFrame(labels, "doc_id long, level int"))


def test_levels(model):
    rng = random.Random(5)
    for _ in range(20):
        assert model.level(text(EASY, rng))[3] <= 3
        assert model.level(text(HARD, rng))[3] >= 4


def test_layout_and_punctuation_dont_count(model):
    rng = random.Random(6)
    easy, hard = text(EASY, rng), text(HARD, rng)
    assert model.level(easy.replace(".", ""))[3] <= 3 and model.level(easy.upper())[3] <= 3
    assert model.level(hard.replace(". ", ".\n\n"))[3] >= 4
    assert model.level(hard.replace("m", "rn"))[3] >= 4
    assert model.level(easy + " " + HARD[0])[3] <= 3


def test_texts_without_a_level(model):
    for t in (None, "", " \n\t", "one two three", "- box 701-02-7305: 2232 x 4196\n" * 30, "page\tstatus\tdpi\n1\tclean\t102\n" * 20, "0132  crest              x7      876.00\n" * 20, "日本語の文書 " * 30, "a" * 100_000):
        assert model.level(t) is None


def test_syllables():
    words = {"en": {"cat": 1, "table": 2, "reading": 2, "late": 1, "wanted": 2, "area": 3, "station": 2}, "de": {"katze": 2, "beleuchtung": 3, "auflösung": 3}, "fr": {"livre": 1, "page": 1, "photographie": 4}, "es": {"libro": 2, "día": 2, "poeta": 3}}
    for lang, ws in words.items():
        for w, n in ws.items():
            assert abs(reading.syllables(w, lang) - n) <= (w in ("photographie", "area")), (w, reading.syllables(w, lang))


def test_without_ratings(spark):
    docs = spark.createDataFrame([(1, " ".join(EASY * 4), 2.0)], "doc_id long, text string, level double")
    empty = reading.fit(docs, spark.createDataFrame([], "doc_id long, level int"))
    assert empty.level(" ".join(EASY * 4))[3] is None
    out = reading.levels(docs.select("doc_id", "text"), empty).collect()
    assert len(out) == 1 and out[0].level is None
    assert reading.levels(docs.select("doc_id", "text").limit(0), empty).count() == 0
