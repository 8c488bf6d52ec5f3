import pytest
from pyspark.sql import functions as F

from foliomill.llm import encode

TEXTS = ["Hello world, it's  two  blanks\n\nand don't\tstop ", None, "", "   ", "naïve façade — “curly” № 7½ ™ 🙂👩‍🔧", "日本語の文書 हिन्दी पाठ صفحة", " wide blank 　x", "a" * 20_000, "<|endoftext|> x", "é é 'S 'll WE'VE", "12345678901234567890 0x1F 1e-9", "\r\n\r\n  x\x00y", "same", "same"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "extra", "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string, pos string")


@pytest.mark.parametrize("limit", [encode.BROADCAST_BYTES, 0])
def test_ids_as_the_tokenizer_gives_them(docs, limit):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    got = {r.doc_id: list(r.ids) for r in encode.encode(docs, "doc_id", "text", broadcast_bytes=limit).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}


def test_round_trip(docs):
    back = {r.doc_id: r.text for r in encode.decode(encode.encode(docs, "doc_id", "text"), "doc_id", "ids").collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


def test_empty(docs):
    assert encode.encode(docs.limit(0), "doc_id", "text").count() == 0


def test_every_distinct_word_once(docs):
    words = encode.words(docs, "doc_id", "text")
    assert "".join(r.w for r in words.where("doc_id = 0").orderBy("pos").collect()) == TEXTS[0]
    table = encode.encode_words(words.select("w").distinct(), encode.vocabulary_path())
    assert table.count() == table.select("w").distinct().count() == words.agg(F.countDistinct("w")).first()[0]
