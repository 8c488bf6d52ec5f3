"""Nearest neighbours of vectors, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of query vectors that a task holds at a time.
BLOCK_BYTES = 32 << 20


def nearest(queries: DataFrame, rows: DataFrame, k: int = 2, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 64) -> DataFrame:
    """qid, rank, id, dist: the k nearest rows of every query by Euclidean distance, ties to the smaller id.

    The queries are broadcast in blocks of bounded size.  Every task keeps the k
    best of its own rows per query, and only those are shuffled and merged.
    A row never matches itself; null vectors and vectors of another length take no part.
    """
    fits = F.col(vec_col).isNotNull() & (F.size(vec_col) == dim) & F.col(id_col).isNotNull()
    q = queries.where(fits).select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).alias("v"))
    n = q.count()
    blocks = max(1, -(-n * dim * 8 // BLOCK_BYTES))
    schema = T.StructType([T.StructField("qid", T.LongType()), T.StructField("id", T.LongType()), T.StructField("dist", T.DoubleType())])
    parts = []
    for b in range(blocks):
        own = (q if blocks == 1 else q.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b)).collect()  # at most about BLOCK_BYTES
        if not own:
            continue
        shared = queries.sparkSession.sparkContext.broadcast((np.array([r.i for r in own]), np.array([r.v for r in own], np.float64)))

        def run(batches, shared=shared):
            qi, qv = shared.value
            best_d, best_i = np.full((len(qi), 0), np.inf), np.zeros((len(qi), 0), np.int64)
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                vecs = np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
                for a in range(0, len(ids), 2048):
                    d = np.sqrt(np.maximum(((qv[:, None, :] - vecs[None, a : a + 2048]) ** 2).sum(-1), 0)) if len(qi) * 2048 * dim < 1 << 24 else np.stack([np.sqrt(((v - vecs[a : a + 2048]) ** 2).sum(1)) for v in qv])
                    d[qi[:, None] == ids[None, a : a + 2048]] = np.inf
                    d, i = np.concatenate([best_d, d], 1), np.concatenate([best_i, np.broadcast_to(ids[a : a + 2048], (len(qi), len(ids[a : a + 2048])))], 1)
                    order = np.lexsort((i, d), axis=1)[:, :k]
                    best_d, best_i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
            there = np.isfinite(best_d)
            q_of = np.broadcast_to(qi[:, None], best_d.shape)[there]
            yield pa.RecordBatch.from_arrays([pa.array(q_of), pa.array(best_i[there]), pa.array(best_d[there])], names=schema.names)

        parts.append(rows.where(fits).select(F.col(id_col).cast("long"), vec_col).mapInArrow(run, schema))
    if not parts:
        return queries.sparkSession.createDataFrame([], "qid long, rank int, id long, dist double")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    best = found.groupBy("qid").agg(F.slice(F.array_sort(F.collect_list(F.struct("dist", "id"))), 1, k).alias("xs"))
    return best.select("qid", F.posexplode("xs").alias("rank", "x")).select("qid", (F.col("rank") + 1).alias("rank"), "x.id", "x.dist")
