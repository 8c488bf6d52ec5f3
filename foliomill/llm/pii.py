"""Personal details in free text: found on a deobfuscated copy, replaced in the source.

A chain of transducers normalises a text: compatibility forms, homoglyphs and
odd blanks become plain characters, invisible ones vanish, spelled-out digits
become digits, and "at" and "dot" in disguised mailboxes become signs.  Each
transducer keeps, for every character it writes, the span of source characters
it stands for.  Detectors run on the normalised text; the spans they find are
mapped back, so that the placeholders replace exactly the source characters and
the rest of the text stays as it was.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill.llm import people
from foliomill.llm.people import Learnt
from foliomill.llm.tape import Tape

TYPES = ("email", "phone", "id_number", "address", "name")

# Given names, titles, street words, number labels, digit words.
GIVEN = """
adele aiko alba alice amara amelie anders andre anja anna antoine astrid aurelie bettina bianca bruno callum carla carlos
carmen claire clara daniel david diego dieter dmitri edith elena elif elise elodie emil emilia emma erik eva fatima felix
finn frank freya gabriel greta hanna hanne hannah hans helena helga henrik henry hugo ida idris ines ingrid irene isabel
ivan jakob james jan jana javier joao johan johann john jonas jorge jose josef juan julia julie jurgen karl karin katrin
klaus kwame lars laura lea leila lena leo leon lorenz louis louise luca lucas lucia luis lukas maja malik manuel marco
maren maria marie marta martin mary mateo matteo mia michael miguel mireille mohamed nadia nia nina noah noor nora odette
olga olivia oscar otto owen pablo paul paula pedro peter petra philippe pierre priya rafael raj ravi robert rosa ruth
salma samuel sara sarah saskia signe silvia simon sofia stefan susan sven tamar thandi thomas tobias tomas ursula vera
victor viktor wanda werner yara yusuf yuki zofia zoe
""".split()
TITLES = r"Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Sir|Dame|Rev|Frau|Herr|Mme|Mlle|Sra|Sr|Srta|Monsieur|Madame|Señor|Señora|Don|Doña"
STREETS_EN = r"Lane|Road|Rd|Street|St|Avenue|Ave|Way|Rise|Close|Court|Ct|Terrace|Drive|Dr|Square|Sq|Place|Pl|Crescent|Row|Hill|Gardens|Grove|Walk|Mews|Parade|Boulevard|Blvd|Quay"
STREETS_DE = r"straße|strasse|str\.|gasse|weg|allee|platz|rain|winkel|ufer|ring|damm|steig|pfad|graben|markt|hof"
STREETS_FR = r"rue|avenue|boulevard|chemin|impasse|allée|place|quai|cours|passage|route|square|sentier"
STREETS_ES = r"Calle|C/|Plaza|Avenida|Avda\.?|Paseo|Camino|Ronda|Travesía|Callejón"
THINGS = r"box|stock code|part no\.?|lot|shelf|catalogue no\.?|serial|accession|ISBN|ISSN|ticket|reference|ref\.?|run|version|node|invoice|order|item|model"
PLACES = r"line|column|digit|issue|sheet|page|row|item|entry|step|version|figure|plate|box|lot|shelf"
CALLS = r"(?:tele)?phone|téléphone|telefon|tel[eé]fono|t[eé]l|tlf|(?:tele)?fax|mobile?|móvil|cell|cellular|celular|portable|handy|hotline|landline|(?:direct|fax|phone|private|office|home) line|durchwahl|rufnummer|contact"
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9", "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9"}
# Cyrillic and Greek letters that look like Latin ones.
HOMOGLYPHS = dict(zip("АВЕКМНОРСТУХаеорсухіјѕԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαν", "ABEKMHOPCTYXaeopcyxijsdqwABEZHIKMNOPTYXoav"))
# End of fixed values.

_DASHES = "‐‑‒–—―−﹘﹣－"
#: One character for one: no offset moves.
_ONE = {ord(k): v for k, v in HOMOGLYPHS.items()} | {ord(c): "-" for c in _DASHES} | {0xA0: " ", 0x202F: " ", 0x2007: " ", 0x2009: " ", 0x3000: " ", 0xFF20: "@", 0xFE6B: "@", 0xFF0E: ".", 0x2024: ".", 0x2019: "'", 0x2018: "'", 0x02BC: "'"} | {0xFF10 + i: str(i) for i in range(10)} | {0xFF21 + i: chr(65 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
_INVISIBLE = "­​‌‍‎‏⁠﻿"
_RE_INVISIBLE = re.compile(f"[{_INVISIBLE}]+")
# "point" is an English word too: as a dot it must lead to a top-level domain that is none.
_END = r"(?:com|org|net|info|biz|edu|gov|example|(?!(?:an|as|at|by|do|go|he|if|in|is|it|me|my|no|of|on|or|so|to|up|us|we)\b)[a-z]{2})\b"
_SAID = rf"(?: (?:dot|punto|punkt) | point (?=(?:[\w-]+ (?:dot|point) )*{_END}))"
_NO_HOST = r"(?!(?:a|an|another|any|each|every|her|his|its|my|no|one|our|some|that|the|their|this|what|which|your) )"
_RE_AT = re.compile(rf"\s*[\[({{<]\s*(?:at|arroba|arobase|ät|@)\s*[\])}}>]\s*|(?<=[A-Za-z0-9]) @ (?=[A-Za-z0-9])| (?:at|arroba|arobase|ät) (?={_NO_HOST}[A-Za-z0-9][\w-]*(?:{_SAID}| ?[\[(](?:dot|punto|punkt|point)[\])] ?)[A-Za-z0-9])", re.I)
_RE_DOT = re.compile(r"\s*[\[({]\s*(?:dot|punto|punkt|point|\.)\s*[\])}]\s*", re.I)
_RE_SPOKEN_DOT = re.compile(rf"@[\w-]+(?:(?:\.|{_SAID})[\w-]+)+", re.I)
_SPOKEN_DOT = re.compile(r" (?:dot|punto|punkt|point) ", re.I)
_RE_BREAK = re.compile(r"(?<=[\w@][.@-])\s*\n\s*(?=\w)|(?<=\w)\s*\n\s*(?=[.@]\w)")
_RE_DIGIT_WORDS = re.compile(r"\b(?:" + "|".join(DIGIT_WORDS) + r")(?:[\s,-]+(?:" + "|".join(DIGIT_WORDS) + r")){5,}\b", re.I)
_RE_WORD = re.compile(r"\w+")
_LETTERS = re.compile(r"[^\W\d_]+")


def normalise(text: str, words: set[str]) -> Tape:
    """The deobfuscated text with its offsets; words are the text's lower-case words."""
    tape = Tape(text)
    if text.isascii():
        plain = text
    else:
        plain = text.translate(_ONE)
        if not unicodedata.is_normalized("NFC", plain):
            tape.text = plain
            tape.replace(re.compile(r"[^\W\d_][̀-ͯ]+"), lambda m: unicodedata.normalize("NFC", m[0]))
            plain = tape.text
        tape.text = plain
        if _RE_INVISIBLE.search(plain):
            tape.replace(_RE_INVISIBLE, lambda m: "")
            plain = tape.text
    if "\n" in plain and ("@" in plain or "(at)" in plain or "[at]" in plain):
        tape.replace(_RE_BREAK, lambda m: "")
    if _RE_AT.search(tape.text):
        tape.replace(_RE_AT, lambda m: "@")
    if "@" in tape.text:
        if _RE_DOT.search(tape.text):
            tape.replace(_RE_DOT, lambda m: ".")
        if _RE_SPOKEN_DOT.search(tape.text):
            tape.replace(_RE_SPOKEN_DOT, lambda m: _SPOKEN_DOT.sub(".", m[0]))
    if len(words & DIGIT_WORDS.keys()) > 2:
        tape.replace(_RE_DIGIT_WORDS, lambda m: "".join(DIGIT_WORDS.get(w.lower(), "") for w in _RE_WORD.findall(m[0])))
    return tape


_CAP = r"[A-ZÀ-ÖØ-ÞŁŚŻČŠŽ]"
_LOW = r"[a-zß-öø-ÿāăąćčďđēęěğīłńňōőœřśşšťūůűźżž]"
_EMAIL = re.compile(r"[A-Za-z0-9][\w.+%-]*@(?:[\w-]+\.)+[A-Za-z]{2,}")

# Phones.  O may stand for 0 in the last group.
_PHONE = re.compile(
    r"(?<![\w.,/-])(?:"
    r"\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?\(?\d{1,4}\)?(?:[ ./-]?[\dO]{2,8}){1,5}"
    r"|00\d{2,3}[ ./-]?\d{2,6}(?:[ ./-]\d{2,6}){1,4}|00\d{8,13}"
    r"|\(\d{3,4}\) ?\d{3} ?[ .-] ?[\dO]\d{3}"
    r"|1-\d{3}-\d{3}-\d{4}"
    r"|\d{3}([ .-])\d{3}\1\d{4}"
    r"|[2-9]\d{9}"
    r"|0\d([ .])\d\d(?:\2\d\d){3}"
    r"|0\d{2,4}[ /-]\d{3,5}[ -]\d{2,4}|0\d{2,4}/\d{4,8}"
    r")(?:\s?(?:ext\.?|x|app\.?|Durchwahl|poste)\s?\d{1,5})?(?![\w]|[.,]\d|-\d)"
)
_CALL_NO = r"(?:[\s_-]*(?:line|no|nos|nr|núm|num|number|nummer|numero|número|numéro|n\.?\s?[º°o]|#)\.?)?"
_ID_LABEL = r"(?:SSN|social security (?:number|no\.?)|passport(?: no\.?| number)?|Reisepass(?:nummer)?|pasaporte|passeport|Personalausweis(?:nummer)?|Steuer-?ID|Steuernummer|tax id|TIN|VAT id|NI number|National Insurance(?: number| no\.?)?|DNI|NIE|NIF|CURP|patient (?:identity )?(?:no\.?|number|id)|patient identity no\.?|insurance (?:no\.?|number)|policy holder no\.?|Versicherungsnummer|driving licence(?: no\.?)?|driver'?s licen[cs]e(?: no\.?)?|licen[cs]e|Führerschein(?:nummer)?|permis de conduire|n° de sécurité sociale|numéro de sécurité sociale|NIR|AHV(?:-Nummer)?|BSN|PESEL|CPF)"
_ID_LABELLED = re.compile(_ID_LABEL + r"\s*(?:no\.?|nr\.?|number|n°|#|:)?\s*((?=[A-Z0-9 .\-/]*\d)[A-Z]{0,6}\d?[A-Z0-9]*(?:[ .\-/]?(?=[A-Z0-9]*\d)[A-Z0-9]+)*(?:[ -][A-Z])?)(?![a-z0-9])", re.I)
_ID_BARE = re.compile(
    r"(?<![\w.,/-])(?:"
    r"\d{3}-\d{2}-\d{4}"  # social security number
    r"|[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]"  # national insurance number
    r"|[A-Z][A-Z9]{4} ?\d{6} ?[A-Z9]{2}\d[A-Z\d]{2}"  # driving licence, whole or its first two parts
    rf"|(?!(?:{THINGS.upper()}|{PLACES.upper()})(?![A-Z]))[A-Z]{{5}} ?\d{{6}}"
    r"|[XYZ]-?\d{7}-?[A-Z]"  # identity number of a foreigner
    r"|X\d{8}|L\d{8}|[A-Z]\d{8}"  # passport, identity card
    r"|\d{8}-?[A-Z]"  # identity number with a check letter
    r"|\d{6}-\d{4}"  # patient number
    r"|\d{2}-\d{7}"  # tax number
    r"|\d{2} \d{3} \d{3} \d{3}"
    r"|[0-2]? ?\d \d\d \d\d \d\d \d{3} \d{3}(?: \d\d)?"
    r"|\d{3} \d\d \d{4}"  # social security number
    r")(?![\w]|[.,]\d|-\w)"
)
# At the start of a word or of a part of one like orderNo; German compounds (Bestellnr.) and barcodes count whole.
_BEFORE_THING = re.compile(r"(?:(?<![^\W_])|(?-i:(?<=[a-z])(?=[A-Z])))(?:" + THINGS + r"|no\.?|n°|\w*nr\.?|\w*code|page|line|column)\s*[:#]?\s*$", re.I)
_BEFORE_CALL = re.compile(r"(?<![^\W_])(?:" + CALLS + r")\.?" + _CALL_NO + r"\s*[:#]?\s*$", re.I)
_BEFORE_LABEL = re.compile(_ID_LABEL + r"\s*(?:no\.?|:)?\s*$", re.I)
_BEFORE_PLACE = re.compile(r"(?:^|[^\w])(?:" + PLACES + r")\s*$", re.I)

_WORDS_EN = rf"(?:{_CAP}[\w'’.-]*[ \n]){{1,3}}"
_ADDRESS = re.compile(
    r"(?<![\w.,:/+-])(?:"
    rf"(?:(?:Flat|Apt\.?|Unit|Suite) \d+[a-zA-Z]?, ?)?\d{{1,4}}[a-zA-Z]?,? {_WORDS_EN}(?:{STREETS_EN}|{STREETS_EN.upper()})\b\.?"
    rf"|(?:{_CAP}[\w-]*(?:{STREETS_DE})|{_CAP}\w+-?[Ss]tr\.|(?:Am|An der|Auf dem|Im|In der|Unter den|Zum|Zur) {_CAP}\w+)(?<!Am)[ \n]\d{{1,4}} ?[a-z]?\b"
    rf"|{_CAP}[\w-]*(?:{STREETS_DE.upper()})[ \n]\d{{1,4}} ?[A-Za-z]?\b"
    rf"|\d{{1,4}}(?: (?:bis|ter|BIS|TER))?,? (?:{STREETS_FR})(?: (?:de la|de l'|des|du|de|d'))?[ \n]?(?:{_CAP}[\w'’-]*[ \n]?){{1,4}}"
    rf"|\d{{1,4}}(?: (?:BIS|TER))?,? (?:{STREETS_FR.upper()})(?: (?:DE LA|DE L'|DES|DU|DE|D'))?[ \n]?(?:{_CAP}[\w'’-]*[ \n]?){{1,4}}"
    rf"|(?:(?:{STREETS_ES})|(?:{STREETS_ES.upper()})) ?(?:(?:de los|de las|de la|del|de|DE LOS|DE LAS|DE LA|DEL|DE) )?(?:{_CAP}[\w'’-]*[ \n]){{1,3}}\d{{1,4}}\b(?:, ?\d{{1,2}}\.?[ºª°o]?(?: ?[A-Z]\b)?)?"
    r")"
)
_TOWN = re.compile(rf"(?:\.?,[ \n]|\n)(?:\d{{5}} )?{_CAP}[\w'’-]+(?: \d{{5}})?")

_SUR = rf"(?:(?:von|van|de|di|del|della|der|la|le|O'|Mc|Mac)[ ]?)?{_CAP}[\w'’]*{_LOW}[\w'’]*(?:-{_CAP}[\w'’]+)?"
_UPP = rf"{_CAP}{{2,}}(?:['’-]{_CAP}+)*"
_ANY = rf"(?:{_UPP}|{_SUR})"
_INI = rf"{_CAP}\.(?:[ -]?{_CAP}\.)*"
_TITLED = re.compile(rf"(?<![\w@.+-])(?:{TITLES}|{TITLES.upper()})(?:\.[ \n]?|[ \n])(?:{_INI}[ \n])?{_ANY}(?![\w@])")
_INITIALS = re.compile(rf"(?<![\w@.+&-])(?<!& )(?<!no\. )(?<!No\. ){_INI}[ \n]{_ANY}(?![\w@])|(?<![\w@.+&-])(?P<family>{_SUR}), {_CAP}\.(?:[ ]?{_CAP}\.)*(?![\w@])")
_TOKENS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_MORE_INITIALS = re.compile(rf"(?: {_CAP}\.)+")
_STRIP = {i: None for i in range(0x300, 0x370)}
_GIVEN = frozenset(GIVEN)
#: Words that follow a name's place but are no family names: function words of the four languages and the desk's vocabulary.
_COMMON = frozenset(
    """a an and are as at asked aparece be been before below beside box but by can cc changed column contact crop de der
    die das dem den des del do does doit du el en et ext fax file for from fragen had has have he her his holds i im in is ist it
    keep la le leave left les line looks los line mail mark march may must name named names near next no not note of off on or our out
    page per please por que reads reply rester s same see sent shows signed sits stamp still tel that the their then there this
    to turned twice under up und une un was were what when which while will with write y you zu""".split()
)
_FIRM = re.compile(r"[ \n](?:&|and[ ](?:Co|Sons?|Company)\b|Foundation|Mill\b|Archive|Clinic|School|Board|Bank|Office|Court|Works|Hotel|Press|Museum|Library|GmbH|Ltd|Inc|SA\b|AG\b|Street|Road|Lane)")


def _fold(word: str) -> str:
    return word.lower() if word.isascii() else unicodedata.normalize("NFD", word.lower()).translate(_STRIP)


def _known(word: str, learnt: Learnt) -> bool:
    """Whether a word is a given name of the list, or learnt as one."""
    if word == "Signé":
        return False
    return _fold(word) in _GIVEN or ("-" in word and _fold(word.partition("-")[0]) in _GIVEN) or ("given", word) in learnt


def _plain_family(word: str) -> bool:
    """Whether nothing speaks against a word as a family name."""
    return len(word) > 2 and _fold(word) not in _COMMON and word.lower() not in people.NOT_PEOPLE


def _names(text: str, details: list[tuple[int, int, str]], learnt: Learnt) -> list[tuple[int, int]]:
    """Spans of known given names and family names together, in any order."""
    out: list[tuple[int, int]] = []
    tokens = [(m[0], m.start(), m.end()) for m in _TOKENS.finditer(text)]
    tokens = [(w[:-2], a, b - 2) if w.endswith(("'s", "’s")) else (w, a, b) for w, a, b in tokens]

    def sure(family: str, a: int, b: int) -> bool:
        """A family name of its own right: learnt, in capitals, or where a name is due."""
        return _plain_family(family) and (family.isupper() or ("family", family) in learnt or people.in_slot(text, a, b) or people.beside(text, a, b, details))

    for i, (w, a, b) in enumerate(tokens):
        if not _known(w, learnt) or (out and a < out[-1][1]):
            continue
        if text[a - 1 : a] in ("@", "+", "_", ".") and a or text[b : b + 1] in ("@", "+", "_") or (text[b : b + 1] == "." and text[b + 1 : b + 2].isalnum()):
            continue
        if i and w[0].isupper() and text[tokens[i - 1][2] : a] in (", ", ",\n", ","):  # Family, Given
            f, fa, _ = tokens[i - 1]
            follows = i + 1 < len(tokens) and text[b : tokens[i + 1][1]] == " " and tokens[i + 1][0][0].isupper() and _plain_family(tokens[i + 1][0])
            m = _MORE_INITIALS.match(text, b)
            end = m.end() if m else b
            if f[0].isupper() and (not follows or f.isupper()) and sure(f, fa, end):
                out.append((fa, end))
                continue
        j, end = i + 1, b
        while j < len(tokens) and len(tokens[j][0]) == 1 and tokens[j][0].isupper() and text[end : tokens[j][1]] in (" ", "\n") and text[tokens[j][2] : tokens[j][2] + 1] == ".":
            end = tokens[j][2] + 1
            j += 1
        if j == len(tokens):
            continue
        f, fa, fb = tokens[j]
        gap = text[end:fa]
        if not gap or gap.strip(" \t\n") or gap.count("\n") > 1 or len(f) < 2 or _fold(f) in _COMMON or f.lower() in people.FIRMS or _FIRM.match(text, fb):
            continue
        if (w[0].isupper() and f[0].isupper()) or (w.islower() and f.islower() and len(f) > 3 and sure(f, a, fb)):
            if _known(f, learnt) and j + 1 < len(tokens) and text[fb : tokens[j + 1][1]] == " " and tokens[j + 1][0][0].isupper():
                fb = tokens[j + 1][2]
            out.append((a, fb))
    return out


_DIGITS = re.compile(r"\d")
# Which words must occur for a detector to have a chance.
_WORDS_TITLE = frozenset(w.lower() for w in TITLES.split("|"))
_WORDS_STREET = frozenset(w.lower().rstrip(".\\?/") for w in f"{STREETS_EN}|{STREETS_FR}|{STREETS_ES}|Am|An|Auf|Im|In|Unter|Zum|Zur".split("|"))
_ENDS_STREET = tuple(w.rstrip("\\.") for w in STREETS_DE.split("|"))
_WORDS_LABEL = frozenset(w.lower() for w in re.findall(r"[^\W\d_]{2,}", _ID_LABEL))
#: Words that are no part of a name found by structure: common words, titles, labels.
_NO_NAMES = _COMMON | people.SLOT_WORDS | _WORDS_TITLE | _WORDS_LABEL | frozenset(w.lower() for w in re.findall(r"[^\W\d_]{2,}", f"{CALLS}|{THINGS}|{PLACES}")) | frozenset("ok id ni dni ssn address adresse anschrift domicilio dirección delivered handwritten original reference please".split())
_PLATE = re.compile(r"[A-ZÀ-Þ]\.")


def detect(text: str | None, learnt: Learnt = people.NONE) -> list[tuple[int, int, str]]:
    """Spans (start, end, type) of the personal details in a source text, in order, without overlap.

    learnt: words of names learnt from the corpus (``learn``).

    Where details overlap the one found first counts, in the order email, id
    number, phone, address, name.  An empty or null text has none.
    """
    if not text:
        return []
    words = set(_LETTERS.findall(text.lower()))
    tape = normalise(text, words)
    t = tape.text
    if not text.isascii():
        words |= set(_LETTERS.findall(_fold(t)))
    found: list[tuple[int, int, str]] = []
    if "@" in t:
        found += [(m.start(), m.end(), "email") for m in _EMAIL.finditer(t)]

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y, _ in found)

    def thing(a: int) -> bool:
        return bool(_BEFORE_THING.search(t, max(0, a - 24), a))

    def called(a: int) -> bool:
        return bool(_BEFORE_CALL.search(t, max(0, a - 40), a))

    digits = len(_DIGITS.findall(t))
    if digits >= 6:
        if not words.isdisjoint(_WORDS_LABEL):
            for m in _ID_LABELLED.finditer(t):
                if sum(c.isdigit() for c in m[1]) >= 5 and free(*m.span()):
                    found.append((m.start(1), m.end(1), "id_number"))
        abroad = [m.span() for m in _PHONE.finditer(t) if m[0].startswith(("+", "00"))]  # their groups are no identity numbers
        for m in _ID_BARE.finditer(t):
            if free(*m.span()) and not any(a < m.start() and m.end() <= b for a, b in abroad) and not (thing(m.start()) and not _BEFORE_LABEL.search(t, max(0, m.start() - 40), m.start())):
                found.append((m.start(), m.end(), "phone" if called(m.start()) else "id_number"))
    if digits >= 8:
        for m in _PHONE.finditer(t):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 20 and free(*m.span()) and (m[0][0] == "+" or called(m.start()) or not thing(m.start())):
                found.append((m.start(), m.end(), "phone"))
    if digits and (not words.isdisjoint(_WORDS_STREET) or "C/" in t or any(w.endswith(_ENDS_STREET) for w in words)):
        for m in _ADDRESS.finditer(t):
            a, b = m.span()
            while t[b - 1] in " \n":
                b -= 1
            if not free(a, b) or (t[a].isdigit() and _BEFORE_PLACE.search(t, max(0, a - 16), a)):
                continue
            town = _TOWN.match(t, b)
            if town and free(b, town.end()):
                b = town.end()
            found.append((a, b, "address"))
    if not words.isdisjoint(_WORDS_TITLE):
        for m in _TITLED.finditer(t):
            if free(*m.span()) and not _FIRM.match(t, m.end()):
                found.append((m.start(), m.end(), "name"))
    taught = learnt.any_given(words)
    if taught or not words.isdisjoint(_GIVEN):
        for a, b in _names(t, found, learnt):
            if free(a, b):
                found.append((a, b, "name"))
    for a, b in people.names(t, found, learnt if taught else people.NONE, _NO_NAMES):
        if free(a, b):
            found.append((a, b, "name"))
    if _PLATE.search(t):
        for m in _INITIALS.finditer(t):
            if free(*m.span()) and not _FIRM.match(t, m.end()) and m[0].rpartition(" ")[2].lower() not in _COMMON and (m["family"] is None or _plain_family(m["family"])):
                found.append((m.start(), m.end(), "name"))
    found.sort()
    return [(*tape.source(a, b), kind) for a, b, kind in found]


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its type in brackets, such as [EMAIL]."""
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def learn(df: DataFrame, text_col: str) -> Learnt:
    """The words of names that stand in slots of the texts, for ``redact`` and ``detect``."""
    return people.learn(df, text_col, _NO_NAMES)


def redact(df: DataFrame, text_col: str, with_text: bool = True, learnt: Learnt = people.NONE) -> DataFrame:
    """df without text_col, with ``types`` (the sorted types found) and, with_text, ``masked``.

    A null text has null ``masked`` and no types.  Columns of df that have one of
    these names are left out.
    """
    keep = [c for c in df.columns if c not in (text_col, "types", "masked")]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("types", T.ArrayType(T.StringType()))] + [T.StructField("masked", T.StringType())] * with_text)

    shared = df.sparkSession.sparkContext.broadcast(learnt)  # of a size that people.BITS bounds

    def run(batches):
        for batch in batches:
            types, masked = [], []
            for text in batch.column(len(keep)).to_pylist():
                spans = detect(text, shared.value)
                types.append(sorted({k for *_, k in spans}))
                if with_text:
                    masked.append(None if text is None else mask(text, spans))
            arrays = [batch.column(i) for i in range(len(keep))] + [pa.array(types, pa.list_(pa.string()))] + [pa.array(masked, pa.string())] * with_text
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.select(*keep, F.col(text_col)).mapInArrow(run, schema)
