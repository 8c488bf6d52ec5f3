"""Held-out evaluation passages inside a corpus.

Items and documents are normalised to words.  Every run of SEED words of an item
goes into a set of hashes; documents are scanned once with rolling windows, and
those with a window in the set are kept.  Of any SPAN words in a row at most one
may be misspelt or exchanged, so a passage of LEAST words always holds SEED right
words in a row.  The set is broadcast as a bitmap whose size is bounded whatever
the number of items; a join of the hits with the items' own runs removes what
only shares a bit, and every pair that is left is verified by aligning item and
document.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.tape import Tape
from foliomill.session import Shelf

LEAST, SPAN, SEED = 14, 6, 5
#: Bits of the bitmap: so many per run of item words, and at most so many (128 MB); a piece of it is built in one task.
BITS_PER_RUN, MOST_BITS, PIECE = 64, 1 << 30, 1 << 20
#: Odd factors; each leads a hash to one of its bits.  Other windows have all of them set in a share of (4 / 64) ** 4.
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)

_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|\\[nrtbf\"'\\/]|&(?:#\d{1,7}|#x[0-9a-fA-F]{1,6}|[A-Za-z]{2,8});")
_INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿️]+")
_SOFT = re.compile(r"\u00ad[\s\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff\ufe0f]*[\r\n][\s>|*\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff\ufe0f]*")
_FORMS = re.compile(r"[^\x00-\x7f][̀-ͯ]*|[A-Za-z][̀-ͯ]+")
_BREAK = re.compile(r"(?<=[^\W\d_])[-‐‑¬]\s*\n[\s>|*]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")


def _escaped(m: re.Match) -> str:
    code = m[1] or m[2]
    if code:
        return chr(int(code, 16)) if not 0xD800 <= int(code, 16) < 0xE000 else " "
    return html.unescape(m[0]) if m[0][0] == "&" else " "


_STEPS = (
    (_ESCAPE, _escaped),
    (_SOFT, lambda m: ""),
    (_INVISIBLE, lambda m: ""),
    (_FORMS, lambda m: unicodedata.normalize("NFKC", m[0])),
    (re.compile("İ"), lambda m: "I"),  # the one letter whose small form has two characters
    (re.compile(r"\r\n?"), lambda m: "\n"),
    (_BREAK, lambda m: ""),
)


def plain(text: str) -> str:
    """Escapes resolved, invisible characters gone, equivalent forms unified, words split at line ends joined."""
    if "\\" in text or "&" in text:
        text = _ESCAPE.sub(_escaped, text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", _SOFT.sub("", text))).replace("İ", "I")
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "\n" in text:
        text = _BREAK.sub("", text)
    return text.lower()


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(plain(text)) if text else []


def located(text: str) -> list[tuple[str, int, int]]:
    """The same words with their spans in the source."""
    tape = Tape(text)
    for pattern, by in _STEPS:
        if pattern.search(tape.text):
            tape.replace(pattern, by)
    return [(m[0].lower(), *tape.source(*m.span())) for m in _WORD.finditer(tape.text)]


def _near(a: str, b: str) -> bool:
    """Whether one word may be a misspelling of the other: at most two edits, one for short words."""
    if a == b:
        return True
    most = 1 if min(len(a), len(b)) < 4 else 2
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    before: list[int] = []
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
    return row[-1] <= most


def _extend(item: list[str], doc: list[str], i: int, j: int, step: int) -> tuple[int, int]:
    """From the last right pair (i, j) on: the furthest pair still in the passage, in one direction.

    A wrong word inside is passed over if SPAN - 1 right ones follow or the
    passage ends with it; at the end it counts only where it is a misspelling.
    A word torn in two, or two run together, count as right.
    """
    since = SPAN  # words since the last wrong one
    end = (i, j)
    while True:
        a, b = i + step, j + step
        if not (0 <= a < len(item) and 0 <= b < len(doc)):
            return end
        if item[a] == doc[b]:
            i, j, since = a, b, since + 1
            end = (i, j)
            continue
        two = b + step
        pair = (doc[b] + doc[two] if step > 0 else doc[two] + doc[b]) if 0 <= two < len(doc) else ""
        if pair == item[a]:
            i, j, since = a, two, since + 1
            end = (i, j)
            continue
        two = a + step
        pair = (item[a] + item[two] if step > 0 else item[two] + item[a]) if 0 <= two < len(item) else ""
        if pair == doc[b]:
            i, j, since = two, b, since + 2
            end = (i, j)
            continue
        if since < SPAN - 1:
            return end
        i, j, since = a, b, 0
        if _near(item[a], doc[b]):
            end = (i, j)


def _numbers(words: list[str]) -> np.ndarray:
    """A hash per word, the same everywhere; each distinct word is hashed once."""
    known = {w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in set(words)}
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def aligned(item: list[str], doc: list[str]) -> list[tuple[int, int]]:
    """(first word, last word) of every passage of at least LEAST item words in the document's words."""
    places: dict[tuple[str, ...], list[int]] = defaultdict(list)
    for i in range(len(item) - SEED + 1):
        places[tuple(item[i : i + SEED])].append(i)
    found: list[tuple[int, int]] = []
    covered: dict[int, int] = {}
    heads = {k[0] for k in places}
    for j in range(len(doc) - SEED + 1):
        if doc[j] not in heads:
            continue
        for i in places.get(tuple(doc[j : j + SEED]), ()):
            if covered.get(j - i, -1) >= j:
                continue  # this run lies in a passage already aligned
            hi, hj = _extend(item, doc, i + SEED - 1, j + SEED - 1, 1)
            li, lj = _extend(item, doc, i, j, -1)
            covered[j - i] = hj
            if hi - li + 1 >= LEAST:
                found.append((lj, hj))
    return found


def _runs(ids: np.ndarray) -> np.ndarray:
    """A hash of every SEED consecutive numbers."""
    n = ids.size - SEED + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SEED):
            h = (h ^ ids[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def _seeds(items: DataFrame) -> DataFrame:
    """h, item: the hashes of every item's runs of words, each once; items: item (row number), text."""

    def run(batches):
        for batch in batches:
            rows = [(h, i) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for h in np.unique(_runs(_numbers(tokens(t))).view(np.int64)).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["h", "item"])

    return items.select("item", "text").mapInArrow(run, "h long, item long")


def _bitmap(seeds: DataFrame, n: int) -> np.ndarray:
    """The bitmap of all seeds, built piece by piece in tasks; of at most MOST_BITS bits."""
    bits = PIECE
    while bits < min(MOST_BITS, n * BITS_PER_RUN):
        bits *= 2

    def places(batches):
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([_place(h, f, bits) for f in _FACTORS])))], names=["at"])

    def run(batches):
        pieces: dict[int, np.ndarray] = {}
        for batch in batches:
            where = batch.column(0).to_numpy()
            for p in np.unique(where // PIECE).tolist():
                own = pieces.setdefault(p, np.zeros(PIECE // 8, np.uint8))
                inside = where[where // PIECE == p] % PIECE
                np.bitwise_or.at(own, inside >> 3, (1 << (inside & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in pieces.values()], pa.binary())], names=["piece", "bits"])

    out = np.zeros(bits // 8, np.uint8)
    for r in seeds.select("h").mapInArrow(places, "at long").distinct().repartition(F.floor(F.col("at") / PIECE)).mapInArrow(run, "piece int, bits binary").collect():  # at most MOST_BITS bits
        out[r.piece * PIECE // 8 : (r.piece + 1) * PIECE // 8] |= np.frombuffer(zlib.decompress(r.bits), np.uint8)
    return out


def _place(h: np.ndarray, factor: int, bits: int) -> np.ndarray:
    """The bit of each hash under a factor: the topmost digits of the product."""
    with np.errstate(over="ignore"):
        return ((h * np.uint64(factor)) >> np.uint64(65 - bits.bit_length())).astype(np.int64)


def _hits(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """doc, text, seeds: every document that has runs in the bitmap, with their hashes, each once."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        bits = shared.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            words = [tokens(t) for t in texts]
            h = _runs(_numbers([w for ws in words for w in ws]))
            rows = []
            if h.size:
                hit = np.arange(h.size)
                for f in _FACTORS:
                    place = _place(h[hit], f, bits.size * 8)
                    hit = hit[(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)]
                bounds = np.r_[0, np.cumsum([len(ws) for ws in words])]
                row = np.searchsorted(bounds, hit, "right") - 1
                inside = hit + SEED <= bounds[row + 1]
                row, hit = row[inside], hit[inside]
                cut = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if row.size else []
                for k, part in zip(row[cut].tolist() if row.size else [], np.split(h[hit].view(np.int64), cut[1:]) if row.size else []):
                    rows.append((ids[k], texts[k], np.unique(part).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.list_(pa.int64())))], names=["doc", "text", "seeds"])

    return docs.select("doc", "text").mapInArrow(run, "doc long, text string, seeds array<long>")


def _scan(docs: DataFrame, doc_col: str, text_col: str, items: DataFrame, item_col: str, item_text: str, emit, schema: str) -> DataFrame:
    """emit(document, item id, text, passages) over all pairs that share a run of words; passages are spans of words."""
    spark = docs.sparkSession
    shelf = Shelf(spark, "leak")
    # rows are numbered, so that repeated and null ids are told apart
    rows = shelf.put(items.where(F.col(item_col).isNotNull() & F.col(item_text).isNotNull()).select(F.monotonically_increasing_id().alias("item"), F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")), "items")
    seeds = shelf.put(_seeds(rows), "seeds")
    hits = shelf.put(_hits(docs.select(F.col(doc_col).cast("long").alias("doc"), F.col(text_col).alias("text")), _bitmap(seeds, seeds.count())).withColumn("row", F.monotonically_increasing_id()), "hits")
    pairs = hits.select("row", F.explode("seeds").alias("h")).join(seeds, "h").select("row", "item").distinct()
    whole = pairs.join(hits.select("row", "doc", "text"), "row").join(rows.select("item", "item_id", F.col("text").alias("item_text")), "item")

    def run(batches):
        for batch in batches:
            known: dict[str, list[str]] = {}
            out: list[tuple] = []
            for doc, text, item, passage in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for t in (text, passage):
                    if t not in known:
                        known[t] = tokens(t)
                found = aligned(known[passage], known[text])
                if found:
                    out += emit(doc, item, text, found)
            cols = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=names)

    names = [c.split()[0] for c in schema.split(", ")]
    types = [{"long": pa.int64(), "int": pa.int32()}[c.split()[1]] for c in schema.split(", ")]
    return whole.select("doc", "text", "item_id", "item_text").mapInArrow(run, schema)


def leaks(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id: every document with a passage of the item; null and empty texts have none."""
    return _scan(docs, doc_col, text_col, items, item_col, item_text, lambda doc, item, text, found: [(doc, item)], "doc_id long, item_id long").distinct()


def spans(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, start, stop: the characters of each passage in the source text, from 0, stop exclusive."""

    def emit(doc, item, text, found):
        words = located(text)
        return [(doc, item, words[a][1], words[b][2]) for a, b in sorted(set(found))]

    return _scan(docs, doc_col, text_col, items, item_col, item_text, emit, "doc_id long, item_id long, start int, stop int")


def without(docs: DataFrame, found: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the found spans cut out of their texts, and ``n_cut``, the number of spans.

    found: ``spans`` of docs.  Spans may overlap; texts without one stay as they
    are, null ids have none, and where an id has several rows the spans count for each.
    """
    lists = found.where("doc_id is not null").select("doc_id", "start", "stop").distinct().groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("__cuts"))
    both = docs.drop("n_cut").join(lists.withColumnRenamed("doc_id", "__doc"), F.col(doc_col) == F.col("__doc"), "left")
    text = F.col(text_col)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda s, x: F.struct(F.concat(s["out"], F.substr(text, s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0)))).alias("out"), F.greatest(s["at"], x["stop"]).alias("at"))
    cut = F.aggregate("__cuts", start, step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1, F.length(text))))
    return both.withColumn(text_col, F.coalesce(cut, text)).withColumn("n_cut", F.when(F.col("__cuts").isNull(), F.lit(0)).otherwise(F.size("__cuts"))).drop("__doc", "__cuts")
