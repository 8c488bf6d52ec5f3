"""Kernels over pages: the pages of an Arrow batch lie on one sheet, so NumPy works on all of them at once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 64
#: Pixels of a sheet, about; a longer single page is still taken whole.
SHEET = 4 << 20

_KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


class Sheet:
    """Pages of 64 pixels width under one another, with ``gap`` rows that belong to none between them.

    a: the pixels; page: each row's page, the number of pages in gaps; y: the
    row's place in its page; heights: per page; extra: further columns per page.
    """

    def __init__(self, texts: pa.Array, gap: int, extra: list[np.ndarray]):
        texts = texts.fill_null("")
        chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        self.heights = -(-chars // WIDTH)
        self.n, self.extra = len(chars), extra
        first = np.r_[0, np.cumsum(self.heights + gap)]
        rows = int(first[-1])
        codes = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        start = np.r_[0, np.cumsum(chars)]
        self.a = np.full(rows * WIDTH, 255, np.uint8)
        self.a[np.arange(codes.size) + np.repeat(first[:-1] * WIDTH - start[:-1], chars)] = codes % 256
        self.a = self.a.reshape(rows, WIDTH)
        own = np.repeat(np.arange(self.n), self.heights + gap)
        self.y = np.arange(rows) - first[own]
        self.inside = self.y < self.heights[own]
        self.page = np.where(self.inside, own, self.n)
        self.first = first[:-1]

    def hold(self, x: np.ndarray, fill) -> np.ndarray:
        """x with the gaps filled, so that a window sees nothing beyond its page."""
        return np.where(self.inside[:, None], x, np.asarray(fill, x.dtype))

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Per page the sum over its pixels or rows."""
        per_row = x.sum(axis=1, dtype=np.int64) if x.ndim == 2 else x
        return np.bincount(self.page, per_row, self.n + 1)[: self.n].astype(np.int64)

    def most(self, x: np.ndarray) -> np.ndarray:
        """Per page the greatest value, 0 at least."""
        out = np.zeros(self.n + 1, np.int64)
        np.maximum.at(out, self.page, x.max(axis=1, initial=0) if x.ndim == 2 else x)
        return out[: self.n]

    def pages(self) -> Iterator[tuple[int, np.ndarray]]:
        for k in range(self.n):
            yield k, self.a[self.first[k] : self.first[k] + self.heights[k]]


def over_pages(docs: DataFrame, kernel: Callable[[Sheet], tuple], schema: str, gap: int = 2, **extra: Column) -> DataFrame:
    """kernel(sheet) gives the page number of every result row (None: a row per page) and the columns after the page id.

    docs has doc_id and text, the text being the page's pixels: code points modulo
    256 in rows of 64, the last row filled with white.  Null and empty texts are
    pages of no rows.  gap: rows between pages, at least half of the highest window.
    extra: Column expressions whose values the kernel finds in sheet.extra.
    """
    names, types = zip(*((c.split()[0], _KINDS[c.split()[1]]) for c in schema.split(",")))

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            cells = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False) + gap * WIDTH
            cut = np.cumsum(cells) // SHEET
            starts = np.flatnonzero(np.r_[True, cut[1:] != cut[:-1]]).tolist() if len(cut) else []
            for a, b in zip(starts, [*starts[1:], len(cut)]):
                part = batch.slice(a, b - a)
                sheet = Sheet(part.column(1), gap, [part.column(i).to_numpy(zero_copy_only=False) for i in range(2, part.num_columns)])
                rows, *cols = kernel(sheet)
                ids = part.column(0) if rows is None else part.column(0).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids] + [pa.array(c, t) for c, t in zip(cols, types[1:])], names=list(names))

    return docs.select(F.col("doc_id").cast("long"), "text", *(c.alias(n) for n, c in extra.items())).mapInArrow(run, schema)
