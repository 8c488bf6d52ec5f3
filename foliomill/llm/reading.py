"""Reading level of running text.

Per document: lists, tables and number columns are left out, the language is
told by its function words, words and sentences are counted, and syllables are
estimated by hyphenation-style rules of the language.  Five classic readability
grades follow from sentence length, word length and syllables; each is fitted to
the levels by a straight line per language on a bounded sample of rated
documents, and the median of the fitted grades is the formula level.

Sentence length fails where punctuation is missing, and syllables fail on terse
technical or legal prose, so the same sample also gives every word the log odds
of standing in a difficult text (level 4 or 5).  Their mean over a document
decides between the levels up to 3 and those from 4 on; the formulas grade the
documents with too few rated words, and place a level within its half.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache
from statistics import median

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: At most so many rated documents are used to fit the lines and the words; they are those of least hash.
SAMPLE = 20_000
#: A word needs so many rated documents to count, a document so many such words to be judged by them.
WORD_DOCS, KNOWN_WORDS = 3, 12
#: Running text has at least so many words.
RUNNING_WORDS = 15

# Function words by which the languages are told apart, vowels, and endings that carry no syllable or one.
FUNCTION_WORDS = {
    "en": "the and of to a in is was it that he she they we with for on had not be by at from but which are were this".split(),
    "de": "der die das und ist war nicht ein eine einen dem den des es auf mit im von zu dass wird sich als aus bei wurde".split(),
    "fr": "le la les et est un une des du dans que qui à au pour il elle en ne pas par sur avec ont été ce sont l d".split(),
    "es": "el la los las y es un una del de que en no se por con para al su fue lo como más pero está había".split(),
}
VOWELS = {"en": "aeiouy", "de": "aeiouyäöü", "fr": "aeiouyàâäéèêëîïôöùûüœæ", "es": "aeiouáéíóúü"}
# End of fixed values.

GRADES = ("kincaid", "fog", "smog", "coleman", "lix")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_SENTENCE = re.compile(r"[.!?…]+(?=\s|$)|\n\s*\n")
_LIST_LINE = re.compile(r"^\s*(?:[-*•·–]\s|\(?\d{1,6}[.):]?\s)|\t|\S {2,}\S.* {2,}\S")
_GROUPS = {k: re.compile(f"[{v}]+") for k, v in VOWELS.items()}
_DE_JOIN = re.compile(r"ie|ei|ai|au|eu|äu|aa|ee|oo|ui")
_ES_BREAK = re.compile(r"[aeoáéó](?=[aeoáéóíú])|[íú](?=[aeo])")
_FR_MUTE = re.compile(r"(?:e|es|ent)$")


@lru_cache(maxsize=200_000)
def syllables(word: str, lang: str) -> int:
    """Estimated syllables of a lower-case word."""
    groups = _GROUPS[lang].findall(word)
    n = len(groups)
    if lang == "en":
        if word.endswith("e") and not word.endswith(("le", "ee", "ye")) and n > 1:
            n -= 1
        elif word.endswith(("ed", "es")) and n > 1 and not word.endswith(("ted", "ded", "ses", "zes", "ches", "shes", "ges", "ces", "xes")):
            n -= 1
        n += len(re.findall(r"i[ao](?!u)|[^q]ua|eo", word)) if n else 0
        n -= len(re.findall(r"[tsc]io", word))
    elif lang == "de":
        n = sum(len(g) - sum(len(x) - 1 for x in _DE_JOIN.findall(g)) for g in groups)
    elif lang == "fr":
        if n > 1 and _FR_MUTE.search(word):
            n -= 1
    else:
        n += len(_ES_BREAK.findall(word))
    return max(n, 1)


def running(text: str | None) -> str:
    """The text without lines of lists, tables and number columns."""
    if not text:
        return ""
    keep = []
    for line in text.splitlines():
        digits = sum(map(line.count, "0123456789"))
        listed = _LIST_LINE.search(line)
        if digits or listed:
            words = _WORD.findall(line)
            letters = sum(map(len, words))
            if digits > letters or (listed and (digits * 3 > letters or len(words) < 6)):
                continue
        keep.append(line)
    return "\n".join(keep)


_LANGUAGE = {w: [k for k, v in FUNCTION_WORDS.items() if w in v] for w in {x for v in FUNCTION_WORDS.values() for x in v}}


def language(words: Counter[str]) -> str | None:
    """The language whose function words occur most, or null where none do."""
    n: Counter[str] = Counter()
    for w in words.keys() & _LANGUAGE.keys():
        for k in _LANGUAGE[w]:
            n[k] += words[w]
    return max(sorted(n), key=lambda k: n[k]) if n else None


def measure(text: str | None) -> tuple[str, Counter[str], tuple[float, ...]] | None:
    """Language, counted words and the five grades of a text; null where it has no running text in a known language."""
    body = running(text)
    words = Counter(_WORD.findall(body.lower()))
    n = words.total()
    if n < RUNNING_WORDS:
        return None
    lang = language(words)
    if lang is None:
        return None
    sentences = max(1, sum(1 for x in _SENTENCE.split(body) if _WORD.search(x)))
    sentences = max(sentences, n / 60)  # unpunctuated text is no single sentence
    syl = poly = long_ = letters = 0
    for w, c in words.items():
        s, size = syllables(w, lang), len(w)
        syl += s * c
        letters += size * c
        if s >= 3:
            poly += c
        if size > 6:
            long_ += c
    w_s, s_w = n / sentences, syl / n
    return (
        lang,
        words,
        (
            0.39 * w_s + 11.8 * s_w - 15.59,
            0.4 * (w_s + 100 * poly / n),
            1.043 * math.sqrt(30 * poly / sentences) + 3.1291,
            5.88 * letters / n - 29.6 * sentences / n - 15.8,
            w_s + 100 * long_ / n,
        ),
    )


class Model:
    """Lines from grades to levels and log odds of words, per language."""

    def __init__(self, lines: dict[tuple[str, str], tuple[float, float]], odds: dict[tuple[str, str], float]):
        self.lines, self.odds = lines, {}
        for (lang, w), v in odds.items():
            self.odds.setdefault(lang, {})[w] = v

    def formula_level(self, lang: str, grades: tuple[float, ...]) -> float | None:
        fitted = [a + b * g for k, g in zip(GRADES, grades) for a, b in [self.lines.get((lang, k)) or self.lines.get(("", k)) or (None, None)] if a is not None]
        return min(5.0, max(1.0, median(fitted))) if fitted else None

    def evidence(self, lang: str, words: Counter[str]) -> tuple[float, int]:
        """Mean log odds of the rated words, and their number."""
        odds = self.odds.get(lang, {})
        total, n = 0.0, 0
        for w, c in words.items():
            v = odds.get(w)
            if v is None and "rn" in w:  # a frequent recognition error
                v = odds.get(w.replace("rn", "m"))
            if v is not None:
                total += v * c
                n += c
        return (total / n, n) if n else (0.0, 0)

    def level(self, text: str | None) -> tuple[str, float | None, float, int | None] | None:
        """Language, formula level, word evidence and level."""
        m = measure(text)
        if m is None:
            return None
        lang, words, grades = m
        formula = self.formula_level(lang, grades)
        score, known = self.evidence(lang, words)
        if formula is None:
            return lang, None, score, None
        level = round(formula)
        if known >= KNOWN_WORDS:
            level = max(4, level) if score > 0 else min(3, level)
        return lang, formula, score, level


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from the rated documents: labels has doc_id and level, docs doc_id and text.

    Repeated ratings are averaged; null levels and ratings of unknown documents
    don't count.  The counts are made in Spark; what comes to the driver are the
    words of at most ``sample`` documents and a line per language and grade.
    """
    rated = labels.where("level is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("level").alias("level"))
    rated = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(rated), "doc_id")  # at most ``sample`` short rows

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for text, level in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                m = measure(text)
                if m is None:
                    continue
                lang, words, grades = m
                out += [(lang, k, None, 1, level, g, g * g, g * level) for k, g in zip(GRADES, grades)]
                if level != 3.5:
                    hard = int(level > 3.5)
                    out += [(lang, None, w, 1, float(hard), 0.0, 0.0, 0.0) for w in {*words, ""}]
            cols = list(zip(*out)) or [()] * 8
            types = (pa.string(), pa.string(), pa.string(), pa.int64(), *[pa.float64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=["lang", "grade", "w", "n", "y", "x", "xx", "xy"])

    rows = texts.select("text", "level").mapInArrow(run, "lang string, grade string, w string, n long, y double, x double, xx double, xy double")
    sums = rows.groupBy("lang", "grade", "w").agg(*(F.sum(c).alias(c) for c in ("n", "y", "x", "xx", "xy"))).where((F.col("n") >= WORD_DOCS) | F.col("grade").isNotNull())
    found = sums.collect()
    lines: dict[tuple[str, str], tuple[float, float]] = {}
    whole: dict[str, np.ndarray] = {}
    for r in found:
        if r.grade:
            s = np.array([r.n, r.x, r.y, r.xx, r.xy])
            whole[r.grade] = whole.get(r.grade, 0) + s
            if r.n >= 20 and (line := _line(s)):
                lines[(r.lang, r.grade)] = line
    for k, s in whole.items():
        if line := _line(s):
            lines[("", k)] = line
    totals = {r.lang: (r.n, r.y) for r in found if r.w == ""}
    odds: dict[tuple[str, str], float] = {}
    for r in found:
        if r.w and r.lang in totals:
            n, hard = totals[r.lang]
            if 0 < hard < n:
                v = math.log((r.y + 0.5) / (hard + 1)) - math.log((r.n - r.y + 0.5) / (n - hard + 1))
                odds[(r.lang, r.w)] = max(-3.0, min(3.0, v))
    return Model(lines, odds)


def _line(s: np.ndarray) -> tuple[float, float] | None:
    n, x, y, xx, xy = s
    d = n * xx - x * x
    if d <= 1e-9:
        return None
    b = (n * xy - x * y) / d
    return (y - b * x) / n, b


def levels(docs: DataFrame, model: Model) -> DataFrame:
    """docs without text, with lang, formula_level, evidence and level of each document that has running text.

    Documents without are left out: null, empty and blank texts, lists, tables
    and fragments, and texts in none of the known languages.  Columns of docs that
    have the name of a result are left out.
    """
    keep = [c for c in docs.columns if c not in ("text", "text_lang", "formula_level", "evidence", "level")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("text_lang", T.StringType()), T.StructField("formula_level", T.DoubleType()), T.StructField("evidence", T.DoubleType()), T.StructField("level", T.IntegerType())])

    def run(batches):
        for batch in batches:
            got = [shared.value.level(t) for t in batch.column(len(keep)).to_pylist()]
            there = [i for i, g in enumerate(got) if g is not None]
            part = batch.take(pa.array(there, pa.int64()))
            cols = list(zip(*(got[i] for i in there))) or [()] * 4
            yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + [pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.float64(), pa.int32()))], names=schema.names)

    return docs.select(*keep, "text").mapInArrow(run, schema)
