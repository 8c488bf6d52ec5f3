"""Names of people by structure: the slots they stand in, the details beside them, and words learnt from such slots.

A slot is a phrase that leads to a person ("signed by", "Absender", "dossier de")
or follows one ("wrote", "wohnhaft"); a name beside a phone, number, mailbox or
address counts too.  From all slots of a corpus the words are learnt that stand
there as given names with several family names, and as family names with several
given ones; they mark names elsewhere.  The learnt words are kept as bits of a
filter of fixed size, so what is broadcast doesn't grow with the corpus.
"""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases before and after people, and words that end the names of firms, places and typefaces.
BEFORE = r"""
(?:written|sent|signed|noted?|letter|call(?:ed)?|asked|requested|approved|witnessed|prepared|issued|certified|confirmed|reviewed|received|message|mail|parcel|complaint|request|statement)[ ](?:by|from|for|to)
|signature(?:[ ](?:reads|of|by|is))?|signed|signée?(?:[ ]par)?|firmad[oa](?:[ ]por)?|firma(?:[ ]de)?|gezeichnet|gez\.|unterschrift(?:[ ]von)?|unterzeichnet[ ]von
|(?:witness|beneficiary|claimant|applicant|sender|recipient|addressee|patient|tenant|borrower|owner|holder|employee|client|customer|author|contact|heir|nurse|clerk|editor|colleague|neighbour)(?:[ ](?:was|is))?
|call|phone|ring|ask|e?-?mail|write[ ]to|reply[ ]to|forward[ ]to|talk[ ]to|meet|cc|attn\.?|attention(?:[ ]of)?|c/o|care[ ]of|per|w/|on[ ]behalf[ ]of
|envelope[ ]shows|stamp[ ]over|(?:dossier|courrier|lettre)[ ](?:de|of|d')|(?:file|letter|record)[ ]of|akte(?:[ ]von)?|brief[ ]von|carta[ ]de|expediente[ ]de
|bitte|frag(?:t|en)?|der[ ]name|name[ ]ist|le[ ]nom|el[ ]nombre|the[ ]name|names|named|name|nom|nombre
|absenderi?n?|empfänger(?:in)?|zeug(?:e|in)|antragsteller(?:in)?|patientin|kund(?:e|in)|inhaber(?:in)?|expéditeur|expéditrice|destinataire|bénéficiaire|témoin|titulaire|remitente|destinatari[oa]|beneficiari[oa]|testigo|titular|paciente|autor(?:in|a)?
|dear|hello|hi|hallo|lieber?|sehr[ ]geehrter?|cher|chère|bonjour|estimad[oa]|querid[oa]|hola|wife|husband|son|daughter|mother|father|née|geb\.
"""
AFTER = r"""
asked|wrote|writes|signed|signs|called|calls|says|said|confirmed|confirms|requested|sent|lives|living|resident|residing|born|agreed|told|replied|reported|works
|wohnhaft|geboren|schrieb|fragte|fragen|bat|unterschrieb|ist[ ]verwischt|domiciliée?|demeurant|née?|habite|écrit|a[ ](?:écrit|signé|demandé)|doit[ ]rester|domiciliad[oa]|nacid[oa]|escribió|firmó|pidió|aparece
|hand|handwriting|initials|signature
|as[ ](?:recipient|sender|beneficiary|witness|claimant|applicant|patient)|in[ ]handwriting
"""
FIRMS = frozenset("foundation mill archive archives clinic school board bank office court works hotel press museum library gmbh ltd inc sa ag company street road lane avenue square".split())
NOT_PEOPLE = FIRMS | frozenset(
    """co sons county city town village water dock quay hill bay river station university institute institut college hospital church saint council ministry department society union group
    bold italic regular light roman serif sans style type typeface font old courier prussian blue red green black white grand savings paper north south east west upper lower""".split()
)
# End of fixed values.

CAP, LOW = r"[A-ZÀ-ÖØ-ÞŁŚŻČŠŽ]", r"[a-zß-öø-ÿāăąćčďđēęěğīłńňōőœřśşšťūůűźżž]"
_PART = r"(?:(?:von|van|de|di|del|della|der|la|le|el|bin|al)[ ]|d'|O'|Mc|Mac)?"
_GIVEN = rf"(?:{CAP}{LOW}+(?:-{CAP}{LOW}+)?|{CAP}{{2,}}(?:-{CAP}+)?)"
_FAMILY = rf"{_PART}(?:{CAP}[\w'’]*{LOW}[\w'’]*(?:-{CAP}[\w'’]+)?|{CAP}{{2,}}(?:['’-]{CAP}+)*)"
_INITIALS = rf"(?:{CAP}\.[ ]?)*"
_NAME = rf"(?P<g>{_GIVEN})[ \n]{_INITIALS}(?P<f>{_FAMILY})|(?P<f2>{_FAMILY}),[ ](?P<g2>{_GIVEN})(?:[ ]{CAP}\.)*"
_verbose = lambda x: x.replace("\n", "")
_LEADS = re.compile(rf"(?<![^\W_])(?:{_verbose(BEFORE)})(?:[ ]?:)?[ \n]$", re.I)
_FOLLOWS = re.compile(rf"(?:'s)?[ ,;\n][ ]?(?:{_verbose(AFTER)})(?![\w])", re.I)
_AND = re.compile(r"(?:,| and| und| et| y| e| &|/)[ \n]")
#: Two words that begin like a name; cheap, as it begins with a set of characters, and linear, as it starts only where a word does.
_CAPITALS = re.compile(rf"{CAP}(?<![\w@.+-].)[^\W\d_][\w'’-]{{0,60}},?[ \n](?={CAP}|d'|(?:von|van|de|di|del|della|der|la|le|el|bin|al)[ ])")
_HERE = re.compile(rf"(?:{_NAME})(?![\w@]|-\w)")
_BESIDE = re.compile(r"[\s,;:/()<–-]*(?:(?:[^\W\d_]+\.?:?|n°|[^\W\d_]+-[^\W\d_]+)[\s:,(]+){0,3}")
_END = re.compile(r"[.!?]\s+[A-ZÀ-Þ]")

#: Words of the slots themselves are no names.
SLOT_WORDS = frozenset(w.lower() for w in re.findall(r"[^\W\d_]{2,}", BEFORE + AFTER))

#: Bits of the filter of learnt words, and how many mark one word.
BITS, MARKS = 1 << 22, 5
#: Different partners a word needs in the slots of the corpus.
PARTNERS = 3


class Learnt:
    """The learnt given and family words as a bitmap of BITS bits; knows none by default."""

    def __init__(self, bits: bytes = b""):
        self.bits, self._seen = bits, {}
        self._given: set[str] = set()
        self._others: set[str] = set()

    def __contains__(self, word: tuple[str, str]) -> bool:
        if not self.bits:
            return False
        known = self._seen.get(word)
        if known is None:
            if len(self._seen) >= 1 << 17:
                self._seen.clear()
            known = self._seen[word] = all(self.bits[b >> 3] >> (b & 7) & 1 for b in marks(*word))
        return known

    def any_given(self, words: set[str]) -> bool:
        """Whether one of the lower-case words is a learnt given name."""
        if not self.bits:
            return False
        fresh = words - self._others
        if fresh <= self._given:
            return bool(fresh)
        if len(self._others) >= 1 << 17:
            self._others.clear()
        for w in fresh - self._given:
            (self._given if ("given", w) in self else self._others).add(w)
        return not self._given.isdisjoint(fresh)


NONE = Learnt()


def marks(role: str, word: str) -> list[int]:
    """The bits of a word in a role (given or family), of which the case doesn't count."""
    h = xxhash.xxh3_128_intdigest(f"{role}:{word.lower()}".encode("utf-8", "surrogatepass"))
    return [(h >> (24 * i)) & (BITS - 1) for i in range(MARKS)]


def _fits(given: str, family: str, text: str, end: int, common: frozenset[str]) -> bool:
    """Whether two words may be a person's: none is a common word, and no firm or place goes on behind them."""
    words = [given.lower(), *family.lower().split(" ")[-1].split("-")]
    if not NOT_PEOPLE.isdisjoint(words) or any(w in common for w in words) or len(words[-1]) < 2 or (given.isupper() and not family.isupper()):
        return False
    behind = re.match(r"[ \n]([^\W\d_]+|&)", text[end : end + 24])
    return not behind or (behind[1] != "&" and behind[1].lower() not in NOT_PEOPLE)


def _parts(m: re.Match) -> tuple[str, str, int, int]:
    given = m["g"] or m["g2"]
    return (given, m["f"] or m["f2"], m.start("g") if m["g"] else m.start("f2"), m.end())


def pairs(text: str, common: frozenset[str]):
    """(given, family, start, end) of all that may be names by their form."""
    at = 0
    while hit := _CAPITALS.search(text, at):
        at = hit.start()
        if at and (text[at - 1].isalnum() or text[at - 1] in "_@.+-"):
            at += 1
            continue
        m = _HERE.match(text, at)
        at = hit.end()  # the second word may begin a name too
        if m and _fits(*_parts(m)[:2], text, m.end(), common):
            yield _parts(m)


def slots(text: str, common: frozenset[str]) -> list[tuple[str, str, int, int]]:
    """(given, family, start, end) of the names in slots of the text."""
    return [x for x in pairs(text, common) if in_slot(text, x[2], x[3])]


def in_slot(text: str, a: int, b: int) -> bool:
    """Whether a slot stands before or behind the span."""
    return bool(_LEADS.search(text, max(0, a - 40), a) or _FOLLOWS.match(text, b))


def beside(text: str, a: int, b: int, details: list[tuple[int, int, str]]) -> bool:
    """Whether the span touches a detail that isn't a name."""
    return any(_touch(text, a, b, x, y) for x, y, kind in details if kind != "name")


def names(text: str, details: list[tuple[int, int, str]], learnt: Learnt, common: frozenset[str]) -> list[tuple[int, int]]:
    """Spans of names: in slots, beside details, of learnt words, or joined to such a name by "and"."""
    out: list[tuple[int, int]] = []
    for given, family, a, b in pairs(text, common):
        known = learnt.bits and ("given", given) in learnt and (text.startswith(given, a) or ("family", family.split(" ")[-1]) in learnt)
        joined = out and a > out[-1][1] and bool(_AND.fullmatch(text, out[-1][1], a))
        if known or joined or in_slot(text, a, b) or beside(text, a, b, details):
            out.append((a, b))
    return out


def _touch(text: str, a: int, b: int, x: int, y: int) -> bool:
    """Whether a detail (x, y) stands beside a name (a, b) in one sentence, with no more than its label between them."""
    if b <= x <= b + 48:
        between = text[b:x]
        return not _END.search(between) and bool(_BESIDE.fullmatch(between))
    return y < a <= y + 3 and not text[y:a].strip(" ,;/(") and not text[y:a].isspace()


def learn(texts: DataFrame, text_col: str, common: frozenset[str]) -> Learnt:
    """The words learnt from the slots of all texts.

    Slots are read in each task, words with enough different partners are counted
    in Spark, and what comes to the driver are the bits of the filter: BITS / 8
    bytes at most, whatever the corpus.
    """
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            pairs = sorted({(g.lower(), f.split(" ")[-1].lower()) for t in batch.column(0).to_pylist() if t for g, f, _, _ in slots(t, common)})
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.string()) for i in (0, 1)], names=["given", "family"])

    def bits(batches):
        for batch in batches:
            flat = sorted({b for role, word in zip(*(c.to_pylist() for c in batch.columns)) for b in marks(role, word)})
            yield pa.RecordBatch.from_arrays([pa.array([b >> 5 for b in flat], pa.int32()), pa.array([1 << (b & 31) for b in flat], pa.int64())], names=["at", "bits"])

    pairs = texts.where(F.col(text_col).rlike(rf"(?<![\p{{L}}\p{{N}}]){CAP}[^\s]{{1,62}}[ \n]+(?:{CAP}|[a-z'’]{{1,5}}[ A-Z])")).select(text_col).mapInArrow(run, "given string, family string").distinct()
    both = pairs.select(F.explode(F.array(F.struct(F.lit("given").alias("role"), F.col("given").alias("word"), F.col("family").alias("other")), F.struct(F.lit("family").alias("role"), F.col("family").alias("word"), F.col("given").alias("other")))).alias("x")).select("x.*")
    known = both.groupBy("role", "word").agg(F.count("*").alias("n")).where(F.col("n") >= PARTNERS).select("role", "word")
    rows = known.mapInArrow(bits, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).collect()  # at most BITS / 32 rows
    out = bytearray(BITS // 8)
    for r in rows:
        out[4 * r.at : 4 * r.at + 4] = r.bits.to_bytes(4, "little")
    return Learnt(bytes(out))
