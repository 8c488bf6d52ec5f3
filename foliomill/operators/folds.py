"""Folds whose order matters, over the short lists of one attempt or run."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.functions import boxes as bx

_BOXES = "array<struct<l: double, t: double, r: double, b: double>>"


def distinct_targets(items: Column, limit: int = 8) -> Column:
    """The first ``limit`` boxes of a sorted list that mean different defects.

    A later box of a known defect takes the place of a smaller earlier one.  A
    null list gives null, an empty one an empty list.
    """

    def of(x: Column) -> bx.Box:
        return bx.Box(x["l"], x["t"], x["r"], x["b"])

    def step(kept: Column, item: Column) -> Column:
        new = F.struct(*(item[c].alias(c) for c in "ltrb"))
        known = F.exists(kept, lambda k: bx.same_target(of(k), of(item)))
        first = F.array_position(F.transform(kept, lambda k: bx.same_target(of(k), of(item))), True)
        larger = F.transform(kept, lambda k, i: F.when((i + 1 == first) & (of(item).w * of(item).h > of(k).w * of(k).h), new).otherwise(k))
        return F.when(F.size(kept) >= limit, kept).when(known, larger).otherwise(F.concat(kept, F.array(new)))

    return F.aggregate(items, F.expr(f"cast(array() as {_BOXES})"), step)


def nearest_free(lists: DataFrame) -> DataFrame:
    """run_id, id, match: each defect takes the nearest context that no earlier defect took.

    lists: run_id, defects (id, restored_box), contexts (id, source_box), both in
    order.  Centres are compared; the first of equally near contexts is taken.
    The lists of a run are as long as its issues, which a review bounds.
    """

    def centre(x: dict) -> tuple[float, float]:
        return (x["x0"] + x["x1"]) / 2, (x["y0"] + x["y1"]) / 2

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                free = [c for c in r["contexts"] or [] if None not in c["source_box"].values()]
                for x in r["defects"] or []:
                    if not free or None in x["restored_box"].values():
                        continue
                    cx, cy = centre(x["restored_box"])
                    near = min(range(len(free)), key=lambda i: (centre(free[i]["source_box"])[0] - cx) ** 2 + (centre(free[i]["source_box"])[1] - cy) ** 2)
                    rows.append((r["run_id"], x["id"], free.pop(near)["id"]))
            frame = pd.DataFrame(rows, columns=["run_id", "id", "match"]).astype({"id": "int32", "match": "int32"})
            yield pa.RecordBatch.from_pandas(frame, schema=pa.schema([("run_id", pa.string()), ("id", pa.int32()), ("match", pa.int32())]), preserve_index=False)

    return lists.mapInArrow(run, "run_id string, id int, match int")


def first_targets(items: Column) -> Column:
    """The boxes of a list that mean different defects, each the first of its defect: an ordered union without repeats.

    items: an array of structs with l, t, r, b, such as the concatenation of two
    detectors' lists; null elements are left out, a null list gives null.
    """

    def of(x: Column) -> bx.Box:
        return bx.Box(x["l"], x["t"], x["r"], x["b"])

    plain = F.transform(F.filter(items, lambda x: x.isNotNull()), lambda x: F.struct(*(x[c].alias(c) for c in "ltrb")))
    return F.aggregate(plain, F.expr(f"cast(array() as {_BOXES})"), lambda kept, x: F.when(F.exists(kept, lambda k: bx.same_target(of(x), of(k))), kept).otherwise(F.concat(kept, F.array(x))))
