import pytest

from foliomill.llm import people, pii

CASES = [
    ("Send it to nadia+scans (at) inkworks (dot) example (dot) net now.", "Send it to [EMAIL] now."),
    ("-> front.desk @ papierhof.example.net", "-> [EMAIL]"),
    ("contact <quellmond05@castelnido.\nexample.org> for it", "contact <[EMAIL]> for it"),
    ("user@page is only a template variable. Asset page@2x used.", None),
    ("Call Zofia Ardaro on 00331990 024 18 before export.", "Call [NAME] on [PHONE] before export."),
    ("Fax 1-617-555-0188 ext. 92, (415) 555 – O117", "Fax [PHONE], [PHONE]"),
    ("Tel 617 555\xa00102 / +44 (0)20 7946-0312", "Tel [PHONE] / [PHONE]"),
    ("ring six one seven five five five oh one two three today", "ring [PHONE] today"),
    ("Source folder is catalogue no. 908-75-5763. ISBN 978-0-00-682951-7, part no. 277-94-2108.", None),
    ("The digits of 998-03-9035 must not change.", "The digits of [ID_NUMBER] must not change."),
    ("beneficiary Leila A. Tavthorne (patient identity no. 006682-7221)", "beneficiary [NAME] (patient identity no. [ID_NUMBER])"),
    ("SSN 952 06 8614, DNI 00053359-A, Steuer-ID 00 251 280 378", "SSN [ID_NUMBER], DNI [ID_NUMBER], Steuer-ID [ID_NUMBER]"),
    ("Sender V. Draywright, Flat 1, 73 Weirhouse Lane, Valmorne.", "Sender [NAME], [ADDRESS]."),
    ("Delivered to 50, rue des Trois Encriers, 00819 Sellière on 15 November 1906.", "Delivered to [ADDRESS] on 15 November 1906."),
    ("Anschrift Kirchbergstr. 34b, 00643 Oakhaven", "Anschrift [ADDRESS]"),
    ("C/ Pergamino 82, 4.º B, Estrellón", "[ADDRESS]"),
    ("in column 2 Copperlatch Lane is named without a number.", None),
    ("Stamp over FENNIDES, Lorenz's initials", "Stamp over [NAME]'s initials"),
    ("Der Name tomás kestaro ist verwischt.", "Der Name [NAME] ist verwischt."),
    ("Bitte Frau Rothovin fragen", "Bitte [NAME] fragen"),
    ("The Ardicz Foundation seal, Brimølm & Co. letterhead, Tarnbury and Valmorne.", None),
    ("Letterhead of Courier Bold type at (0.12, 0.32, 0.94, 0.88), 3160 x 1676 pixels, 1990-05-24 10:43:49.", None),
    ("Z​ofia Аrdaro wrote", "[NAME] wrote"),
    ("diagram label is missing a dot SALMA TAVAWAY, 030/23125-704", "diagram label is missing a dot [NAME], [PHONE]"),
    ("mail nadia at inkworks dot example dot net today", "mail [EMAIL] today"),
    ("Call Ethan Walker on 00331990 024 18.", "Call [NAME] on [PHONE]."),
    ("Priscilla Nakamura wrote to us.", "[NAME] wrote to us."),
    ("Signed by Wei Zhang in column 2, cc Bo Lindqvist and Arjun Patel.", "Signed by [NAME] in column 2, cc [NAME] and [NAME]."),
    ("Kenneth Ardaro, tel. 617-555-0102", "[NAME], tel. [PHONE]"),
    ("Absender: Walker, Ethan", "Absender: [NAME]"),
    ("per North Quay Savings Bank; ask Harrow Mill Archive. Call Ticket Office now.", None),
    ("", None),
]


@pytest.mark.parametrize("text,masked", CASES)
def test_cases(text, masked):
    assert pii.mask(text, pii.detect(text)) == (text if masked is None else masked)


def test_spans_are_of_the_source():
    text = "x​ ﬁne: nadia (at) inkworks (dot) example, tel. six one seven five five five oh one two three"
    spans = pii.detect(text)
    assert [(text[a:b], k) for a, b, k in spans] == [("nadia (at) inkworks (dot) example", "email"), ("six one seven five five five oh one two three", "phone")]


def test_long_text():
    text = "Nothing here. " * 100_000 + "Call Zofia Ardaro. " + "A" * 300_000
    assert [(text[a:b], k) for a, b, k in pii.detect(text)] == [("Zofia Ardaro", "name")]


@pytest.mark.parametrize("text", ["A" * 300_000, "Ab" * 150_000, "A" * 200_000 + " " + "B" * 200_000, "Signed by " + "A" * 300_000, "Aa-" * 100_000, "de la " * 50_000])
def test_long_words_take_no_longer(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    assert pii.redact(df, "text", learnt=pii.learn(df, "text")).first().masked is not None


def test_redact(spark):
    df = spark.createDataFrame([(1, "Call Zofia Ardaro.", "mine"), (1, "Call Zofia Ardaro.", "mine"), (2, None, "mine"), (None, "", None)], "id int, text string, types string")
    rows = pii.redact(df, "text").collect()
    assert sorted((r.id or 0, r.masked, tuple(r.types)) for r in rows if r.masked is not None) == [(0, "", ()), (1, "Call [NAME].", ("name",)), (1, "Call [NAME].", ("name",))]
    assert [tuple(r.types) for r in rows if r.masked is None] == [()]
    assert pii.redact(df.limit(0), "text").count() == 0


@pytest.mark.parametrize("mailbox", ["jane[@]firm.com", "jane (@) firm.com", "jane@firm[dot]com", "jane@firm (dot) com", "juan at correo punto es", "hans at firma punkt de", "luc at maison point fr", "juan arroba correo punto es", "jane{at}firm.com"])
def test_disguised_mailboxes(mailbox):
    text = f"Write to {mailbox}, please."
    assert [(text[a:b], k) for a, b, k in pii.detect(text)] == [(mailbox, "email")]


def test_no_mailbox():
    for text in ("Look at the point where lines meet.", "Asset page@2x point is missing.", "It breaks at boiling point in summer.", "Arrive at noon (at the dot)."):
        assert pii.detect(text) == []


@pytest.mark.parametrize("label", ["phone no.", "fax no.:", "Telefon-Nr.", "Telefonnr.", "direct line", "landline:", "Teléfono", "telefono:", "tel. n°", "phoneNo:", "phone_no:"])
def test_labelled_phones(label):
    assert pii.mask(f"See {label} 617-555-0102 today", pii.detect(f"See {label} 617-555-0102 today")) == f"See {label} [PHONE] today"


def test_phones_with_a_plus_and_numbers_of_things():
    assert pii.mask("order no. +44 20 7946 0312", pii.detect("order no. +44 20 7946 0312")) == "order no. [PHONE]"
    for label in ("order no.", "Bestellnr.", "barcode", "orderNo:", "order_no:", "line", "ticket", "Nr."):
        assert pii.detect(f"See {label} 617-555-0102 today") == []


@pytest.mark.parametrize("number", ["AB123456C", "AB 12 34 56 C", "123 45 6789", "928 07 2192", "MORGA657054SM9IJ", "MORGA 657054 SM9IJ", "FO999657054SM9IJ", "MORGA657054", "X1234567L"])
def test_identity_numbers_without_a_label(number):
    assert pii.detect(f"Seen: {number}.") == [(6, 6 + len(number), "id_number")]
    assert pii.detect(f"Seen: stock code {number}.") == []


def test_groups_of_other_numbers_are_no_identity_numbers():
    assert pii.detect("Tel. +49 123 45 6789") == [(5, 20, "phone")]
    assert pii.detect("Tel. 123 45 6789") == [(5, 16, "phone")]
    assert pii.detect("ORDER 123456, SHEET123456") == []


def test_words_of_names_are_learnt(spark):
    slots = [(f"Signed by {g} {f}.",) for g in ("Ethan", "Priscilla", "Wei") for f in ("Walker", "Nakamura", "Zhang")] + [("Signed by Grand Hotel Adlon.",), (None,), ("",), ("Asked by Wholly Unseen today.",)]
    learnt = pii.learn(spark.createDataFrame(slots, "text string"), "text")
    assert len(learnt.bits) == people.BITS // 8
    assert ("given", "Ethan") in learnt and ("family", "ZHANG") in learnt and ("given", "Grand") not in learnt and ("given", "Wholly") not in learnt
    for text, found in (("In the margin Ethan Zhangson sits.", ["Ethan Zhangson"]), ("margin: ethan walker", ["ethan walker"]), ("Walker, Ethan - smeared", ["Walker, Ethan"]), ("Ethan Mill is closed. Ethan Street.", [])):
        assert [text[a:b] for a, b, _ in pii.detect(text, learnt)] == found
        assert pii.detect(text) == []
    assert pii.learn(spark.createDataFrame([], "text string"), "text").bits == bytes(people.BITS // 8)
    df = spark.createDataFrame([("In the margin Ethan Zhangson sits.",)], "text string")
    assert [tuple(r) for r in pii.redact(df, "text", learnt=learnt).collect()] == [(["name"], "In the margin [NAME] sits.")]
