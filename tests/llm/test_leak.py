import random

from foliomill.llm import leak

ITEM = "Each margin across ninety rows covers every circled seal in selelli although no orchard plan within eighty lines faces one numeral under row four and each stub dates from one thin manifest of rothwright"
W = ITEM.split()


def found(doc, item=ITEM):
    return bool(leak.aligned(leak.tokens(item), leak.tokens(doc)))


def test_length_and_errors():
    assert found("start " + " ".join(W[5:19]) + " end")
    assert not found("start " + " ".join(W[5:18]) + " end")
    wrong = W[5:19]
    wrong[3], wrong[9] = "xxxx", "crcled"
    assert found("q " + " ".join(wrong) + " r")
    wrong[8] = "zzzz"
    assert not found("q " + " ".join(wrong) + " r")


def test_ends_count_only_as_misspellings():
    part = W[5:19]
    assert found(" ".join([part[0][:-1] + "x", *part[1:]]))
    assert not found(" ".join(["unrelated", *part[1:]]))


def test_forms_are_ignored():
    text = " ".join(W[:16])
    for doc in (text.upper(), "> " + text.replace(" orchard", "\n> orchard"), text.replace("although", "al-\n> though"), text.replace("selelli", "sele​lli"), text.replace(" ", "   "), text.replace("seal", "“seal” —"), "\\n".join(text.split(" ")) if False else text.replace("margin", "m\\u0061rgin"), text.replace("circled", "cir cled"), text.replace("no orchard", "noorchard")):
        assert found(doc), doc


def test_random_against_brute_force(spark):
    """Exact overlaps of random word strings against a search for equal runs."""
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(40)]
    items = {i: [rng.choice(vocabulary) for _ in range(30)] for i in range(6)}
    docs = []
    for _ in range(80):
        i, n = rng.randrange(6), rng.choice([8, 12, 13, 14, 15, 20])
        a = rng.randrange(30 - n)
        docs.append(["#"] * 3 + [f"x{rng.random()}" for _ in range(4)] + items[i][a : a + n] + [f"y{rng.random()}" for _ in range(4)])
    got = {}
    rows = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string")
    for r in leak.leaks(rows, spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add(r.item_id)
    for k, d in enumerate(docs):
        assert got.get(k, set()) == {i for i, w in items.items() if any(f" {' '.join(w[a : a + 14])} " in f" {' '.join(leak.tokens(' '.join(d)))} " for a in range(17))}


def test_spans_and_dirt(spark):
    text = "Start: " + ITEM.replace("although", "al-\nthough") + " end"
    docs = spark.createDataFrame([(1, text, 5), (2, None, 5), (3, "", 5), (4, "x " * 200_000, 5), (1, text, 5)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, ITEM), (8, None), (9, ""), (None, ITEM), (10, "too short")], "item_id long, text string")
    assert [tuple(r) for r in leak.leaks(docs, items).collect()] == [(1, 7)]
    r = leak.spans(docs, items).first()
    assert text[r.start : r.stop] == text[7:-4]
    assert leak.leaks(docs.limit(0), items).count() == 0 and leak.leaks(docs, items.limit(0)).count() == 0


def test_a_full_bitmap_gives_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(k, " ".join(f"v{k}w{j}" for j in range(20))) for k in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(k, " ".join(f"v{k}w{j}" for j in range(2, 19))) for k in range(0, 30, 3)] + [(99, " ".join(f"other{j}" for j in range(3000)))], "doc_id long, text string")
    want = {(k, k) for k in range(0, 30, 3)}
    assert {tuple(r) for r in leak.leaks(docs, items).collect()} == want
    monkeypatch.setattr(leak, "PIECE", 64)  # so few bits that unrelated documents hit them
    monkeypatch.setattr(leak, "MOST_BITS", 256)
    assert {tuple(r) for r in leak.leaks(docs, items).collect()} == want


def test_passages_are_cut_out(spark):
    part = " ".join(W[3:20])
    docs = [(1, f"é😀 before {part}, after. {part} end", "mine"), (2, "nothing here", "mine"), (3, None, None), (None, part, None), (4, part + " " + " ".join(W[10:30]), None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_cut string")
    items = spark.createDataFrame([(7, ITEM), (8, " ".join(W[2:22]))], "item_id long, text string")
    out = {r.doc_id: (r.text, r.n_cut) for r in leak.without(df, leak.spans(df, items)).collect()}
    assert out == {1: ("é😀 before , after.  end", 2), 2: ("nothing here", 0), 3: (None, 0), None: (part, 0), 4: (" ", 2)}, out
    assert leak.without(df.limit(0), leak.spans(df, items)).count() == 0


def test_located_words_are_the_same():
    text = "A\\u0301x ﬁne sele-\n rveil &amp; b​c\r\n> Straße İx"
    assert [w for w, _, _ in leak.located(text)] == leak.tokens(text)


def test_words_broken_by_soft_hyphens_at_every_line_end():
    words = [f"fragment{c}word" for c in "abcdefghijklmnopqr"]
    for end in ("\u00ad\n", "\u00ad \r\n> ", "\u200b\u00ad\u200b\n"):
        text = " ".join(w.replace("ment", "ment" + end) if i % 3 == 0 else w for i, w in enumerate(words))
        assert leak.tokens(text) == words == [w for w, _, _ in leak.located(text)]
        assert found(text, " ".join(words))
