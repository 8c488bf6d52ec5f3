"""The corpus as token ids, by a table of distinct words.

Spark splits every text into the words the vocabulary's pattern defines.  Each
distinct word is encoded once, into a table of words and ids; the ids are joined
back to the words' positions and strung together per text.  Decoding joins the
ids with the table of pieces.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.session import Shelf

#: The word table is broadcast up to so many bytes on disk; beyond that both sides are shuffled by word.
BROADCAST_BYTES = 24 << 20
#: Fixed value: the vocabulary's split pattern.  (?U) gives \s its Unicode meaning in Java, as the vocabulary has it.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    # one word is one piece: the pattern takes all of it
    return tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=_ranks(path), special_tokens={})


def words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, pos, w: the words of every text in order; none for null and empty texts."""
    return docs.select(id_col, F.posexplode(F.regexp_extract_all(text_col, F.lit(PATTERN), F.lit(0))).alias("pos", "w"))


def encode_words(distinct: DataFrame, path: str) -> DataFrame:
    """w, ids of every distinct word."""

    def run(batches):
        enc = _encoding(path)
        for batch in batches:
            ids = enc.encode_ordinary_batch(batch.column(0).to_pylist(), num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["w", "ids"])

    return distinct.select("w").mapInArrow(run, "w string, ids array<int>")


def encode(docs: DataFrame, id_col: str, text_col: str, path: str | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """id_col, ids: one row per row of docs, whose ids must be unique and not null; null and empty texts have empty ids.

    Texts are placed by id once, before they are split; with the word table
    broadcast, words never leave their text's task again.  A larger table is
    joined by a shuffle on the word, where adaptive execution splits the hot words.
    """
    path = path or vocabulary_path()
    spark = docs.sparkSession
    shelf = Shelf(spark, "encode")
    slim = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    table = shelf.put(encode_words(words(slim, "__id", "__text").select("w").distinct(), path), "words")
    placed = slim.repartition(F.col("__id"))
    split = words(placed, "__id", "__text")
    joined = split.join(F.broadcast(table) if shelf.size("words") <= broadcast_bytes else table, "w")
    strung = joined.groupBy("__id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ids"))), lambda x: x["ids"])).alias("ids"))
    empty = F.expr("cast(array() as array<int>)")
    blank = placed.where(F.col("__text").isNull() | (F.col("__text") == "")).select("__id", empty.alias("ids"))
    return strung.unionByName(blank).withColumnRenamed("__id", id_col)


def pieces(spark: SparkSession, path: str | None = None) -> DataFrame:
    """id, piece (bytes) of the vocabulary: some ten thousand rows, whatever the corpus."""
    return spark.createDataFrame([(i, b) for b, i in _ranks(path or vocabulary_path()).items()], "id int, piece binary")


def decode(ids: DataFrame, id_col: str, ids_col: str, path: str | None = None) -> DataFrame:
    """id_col, text: the pieces of the ids joined in order; empty ids give the empty text."""
    table = pieces(ids.sparkSession, path)
    rows = ids.select(id_col, F.posexplode_outer(ids_col).alias("pos", "id")).join(F.broadcast(table), "id", "left")
    hexes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.hex("piece").alias("h")))), lambda x: x["h"]), "")
    return rows.groupBy(id_col).agg(hexes.alias("h")).select(id_col, F.decode(F.unhex("h"), "UTF-8").alias("text"))
