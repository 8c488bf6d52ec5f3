"""Schemas that drift between the files of a stream.

Every JSON line becomes leaf rows (path, types, hash of its values).  Per file
they give the file's schema, a tree of object keys.  Fields that only one of two
neighbouring files has are compared by their values on the records both files
share; equal value sets are the evidence under which the tree edit distance may
map one leaf to another (a rename, or a move where the path above changes).  The
distance and its script are computed per pair of files on the two schemas alone,
whose size doesn't depend on the number of records.  The scripts of a stream are
compiled into a projection per file, from its paths to the columns of one typed
table.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from foliomill.operators.hierarchy import roots
from foliomill.session import Shelf

TYPES = ("array", "boolean", "number", "string")
_ONE = {t: tuple(int(t == u) for u in TYPES) for t in TYPES}


def _plain(v):
    """Numbers of equal value get one form: 1.0 is 1."""
    if isinstance(v, float) and v.is_integer() and abs(v) < 1e18:
        return int(v)
    if isinstance(v, list):
        return [_plain(x) for x in v]
    return v


def leaves(value: object, path: str, out: dict[str, list]) -> None:
    """Add (type, value) of every leaf under value to out, by path, in order."""
    if isinstance(value, dict):
        for k, v in value.items():
            leaves(v, f"{path}.{k}" if path else k, out)
    elif isinstance(value, list):
        if any(isinstance(v, dict) for v in value):
            rest = [v for v in value if v is not None and not isinstance(v, dict)]
            for v in value:
                if isinstance(v, dict):
                    leaves(v, f"{path}[]", out)
        else:
            rest = [v for v in value if v is not None and v != []]
        if rest:
            out[path].append(("array", _plain(rest)))
    elif isinstance(value, bool):
        out[path].append(("boolean", value))
    elif isinstance(value, (int, float)):
        out[path].append(("number", _plain(value)))
    elif isinstance(value, str):
        out[path].append(("string", value))


def flatten_lines(lines: DataFrame) -> DataFrame:
    """record_id, stream, file_no, record_key, field, n_<type> counts, h: one row per line and field.

    A line that isn't a JSON object holds no fields.  h is a 64-bit hash of the
    field's values and types in order.
    """
    schema = T.StructType(
        [T.StructField("record_id", T.LongType()), T.StructField("stream", T.StringType()), T.StructField("file_no", T.IntegerType()), T.StructField("record_key", T.StringType()), T.StructField("field", T.StringType())]
        + [T.StructField(f"n_{t}", T.IntegerType()) for t in TYPES]
        + [T.StructField("h", T.LongType())]
    )

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            ids, streams, files, keys, texts = (batch.column(i).to_pylist() for i in range(5))
            for rid, stream, file_no, key, text in zip(ids, streams, files, keys, texts):
                out: dict[str, list] = defaultdict(list)
                try:
                    record = json.loads(text) if text else None
                except ValueError:
                    record = None
                if isinstance(record, dict):
                    leaves(record, "", out)
                for field, values in out.items():
                    if len(values) == 1:
                        n = _ONE[values[0][0]]
                    else:
                        count = Counter(t for t, _ in values)
                        n = tuple(count[t] for t in TYPES)
                    h = xxhash.xxh3_64_intdigest(repr(values).encode("utf-8", "surrogatepass")) - (1 << 63)
                    rows.append((rid, stream, file_no, key, field, *n, h))
            cols = list(zip(*rows)) or [()] * len(schema)
            types = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), *[pa.int32()] * 4, pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=schema.names)

    return lines.select(F.col("record_id").cast("long"), "stream", F.col("file_no").cast("int"), "record_key", "payload").mapInArrow(run, schema)


class _Schema:
    """A schema as a tree: inner nodes are object keys (a list of objects has ``[]`` at its key), leaves are fields."""

    def __init__(self, fields: dict[str, str]):
        self.fields = fields
        self.inner = sorted({up for f in fields for up in _ups(f)}, key=lambda n: (n.count("."), n))
        self.under = Counter(up for f in fields for up in _ups(f))


def _ups(path: str) -> list[str]:
    """The inner nodes above a path, from the top."""
    parts = path.split(".")[:-1]
    return [".".join(parts[: i + 1]) for i in range(len(parts))]


def _split(path: str) -> tuple[str, str]:
    parent, _, key = path.rpartition(".")
    return parent, key


def _match_inner(old: list[str], new: list[str], shared: dict[tuple[str, str], int]) -> dict[str, str]:
    """The injective mapping of inner nodes that saves most edits; the root, '', maps to the root.

    A mapped pair saves an edit (a rename or move instead of a deletion and an
    addition), each leaf of ``shared`` under both of them one, and an equal key
    under parents that map to each other one more.  Old nodes are mapped from the
    top down, best choice first; a branch ends as soon as the most that the rest
    could save doesn't exceed the best mapping found.
    """
    if not new:
        return {"": ""}
    most_shared: dict[str, int] = defaultdict(int)
    for (u, _), n in shared.items():
        most_shared[u] = max(most_shared[u], n)
    keys = {_split(v)[1] for v in new}
    extra = [most_shared[u] + (_split(u)[1] in keys) for u in old]
    rest = [sum(extra[i:]) for i in range(len(old) + 1)]
    best: tuple[int, dict[str, str]] = (-1, {})

    def down(i: int, f: dict[str, str], free: set[str], saved: int) -> None:
        nonlocal best
        if saved > best[0]:
            best = (saved, dict(f))
        if i == len(old) or saved + rest[i] + min(len(old) - i, len(free)) <= best[0]:
            return
        u = old[i]
        parent, key = _split(u)
        image = f.get(parent)
        gains = sorted(((1 + shared.get((u, v), 0) + (image is not None and _split(v) == (image, key)), v == u, v) for v in free), key=lambda g: (-g[0], not g[1], g[2]))
        for gain, _, v in gains:
            f[u] = v
            down(i + 1, f, free - {v}, saved + gain)
            del f[u]
        down(i + 1, f, free, saved)

    down(0, {"": ""}, set(new), 0)
    return best[1] | {"": ""}


def tree_edit(old: dict[str, str], new: dict[str, str], proof_old: dict[str, object], proof_new: dict[str, object]) -> tuple[int, list[tuple[str, str, str, int]], list[tuple[str, str, str]]]:
    """The tree edit distance between two schemas, a script of least cost, and the changes of single fields.

    old, new: leaf path to type.  A script deletes, adds, renames, moves and retypes
    nodes at cost 1 each; a renamed or moved node takes its subtree along, a move
    may change the key too.  Inner nodes map freely; a leaf maps to the leaf of the
    same path or to one of equal proof (the evidence of values), the latter only
    where neither path is in both schemas; such a leaf had equal types wherever it
    could be compared, so only a leaf that keeps its path is retyped.  With unordered trees, unit costs and
    moves, the cost of a mapping is the number of nodes without a partner, plus the
    pairs whose keys differ or whose parents aren't mapped to each other, plus the
    types that differ, so the least cost follows from the mapping of inner nodes
    that saves most: leaves of one proof are interchangeable, and any choice of
    pairs with equal keys among them extends to as many pairs as the smaller side has.

    The script has (op, node, new node, leaves below); the changes (field, change,
    new field) follow from the mapping of leaves.  Where a proof has several leaves
    on a side there are several scripts of least cost, and every pair that is in
    one of them is reported as renamed.
    """
    a, b = _Schema(old), _Schema(new)
    classes: dict[object, tuple[list[str], list[str]]] = defaultdict(lambda: ([], []))
    for side, here, there, proof in ((0, old, new, proof_old), (1, new, old, proof_new)):
        for f in sorted(here):
            known = ("path", f) if f in there else ("proof", proof[f]) if proof.get(f) is not None else (side, f)
            classes[known][side].append(f)
    shared: dict[tuple[str, str], int] = defaultdict(int)
    for xs, ys in classes.values():
        at: dict[str, list[str]] = defaultdict(list)
        for y in ys:
            at[_split(y)[1]].append(_split(y)[0])
        for x in xs:
            for parent in at.get(_split(x)[1], ()):
                shared[(_split(x)[0], parent)] += 1
    f = _match_inner(a.inner, b.inner, shared)

    steps: list[tuple[str, str, str, int]] = []

    def place(x: str, y: str, leaves: int) -> None:
        (up, key), (new_up, new_key) = _split(x), _split(y)
        if f.get(up) != new_up:
            steps.append(("move", x, y, leaves))
        elif key != new_key:
            steps.append(("rename", x, y, leaves))

    for x in a.inner:
        if x in f:
            place(x, f[x], a.under[x])
        else:
            steps.append(("delete", x, "", a.under[x]))
    taken = set(f.values())
    steps += [("add", y, "", b.under[y]) for y in b.inner if y not in taken]
    changes: list[tuple[str, str, str]] = []
    for xs, ys in classes.values():
        pairs: list[tuple[str, str]] = []
        left, right = list(xs), list(ys)
        for fits in (lambda x, y: f.get(_split(x)[0]) == _split(y)[0] and _split(x)[1] == _split(y)[1], lambda x, y: f.get(_split(x)[0]) == _split(y)[0], lambda x, y: True):
            for x in list(left):
                y = next((y for y in right if fits(x, y)), None)
                if y is not None:
                    pairs.append((x, y))
                    left.remove(x)
                    right.remove(y)
        for x, y in pairs:
            place(x, y, 1)
            if x == y and old[x] != new[y]:
                steps.append(("retype", x, "", 1))
        steps += [("delete", x, "", 1) for x in left] + [("add", y, "", 1) for y in right]
        if pairs:
            changes += [(x, "renamed", y) if x != y else (x, "retyped", "") for x in xs for y in ys if x != y or old[x] != new[x]]
        else:
            changes += [(x, "removed", "") for x in xs] + [(y, "added", "") for y in ys]
    return len(steps), sorted(steps), sorted(changes)


def neighbours(rows: DataFrame) -> DataFrame:
    """stream, file_no, prev: every file that has an older one in its stream."""
    files = rows.select("stream", "file_no").where("file_no is not null").distinct()
    return files.select("stream", "file_no", F.lag("file_no").over(W.partitionBy("stream").orderBy("file_no")).alias("prev")).where("prev is not null")


_PAIR = T.StructType([T.StructField("stream", T.StringType()), T.StructField("file_no", T.IntegerType()), T.StructField("op", T.StringType()), T.StructField("field", T.StringType()), T.StructField("change", T.StringType()), T.StructField("new_field", T.StringType()), T.StructField("leaves", T.IntegerType()), T.StructField("distance", T.IntegerType())])


def scripts(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """The changes of single fields and the edit script of every file against its predecessor.

    lines: stream, file_no, record_key of all lines (a file may have lines
    without fields); rows: ``flatten_lines``.  Rows with op null are changes of
    single fields, the others steps of the script.
    """
    fields = rows.groupBy("stream", "file_no", "field").agg(*(F.sum(f"n_{t}").alias(t) for t in TYPES))
    most = F.greatest(*TYPES)
    fields = fields.select("stream", "file_no", "field", F.coalesce(*(F.when(F.col(t) == most, F.lit(t)) for t in TYPES)).alias("type"))
    pairs = neighbours(lines)
    sides = fields.join(pairs, ["stream", "file_no"]).select("stream", "file_no", "field", F.lit(None).cast("string").alias("old"), F.col("type").alias("new")).unionByName(
        fields.join(pairs.select("stream", F.col("prev").alias("file_no"), F.col("file_no").alias("pair")), ["stream", "file_no"]).select("stream", F.col("pair").alias("file_no"), "field", F.col("type").alias("old"), F.lit(None).cast("string").alias("new"))
    )
    both = sides.groupBy("stream", "file_no", "field").agg(F.max("old").alias("old"), F.max("new").alias("new"))
    only = both.where("old is null or new is null").join(pairs, ["stream", "file_no"]).select("stream", F.col("file_no").alias("pair"), "field", F.when(F.col("new").isNull(), F.col("prev")).otherwise(F.col("file_no")).alias("file_no"))
    keys = lines.where("record_key is not null").select("stream", "file_no", "record_key").distinct()
    shared = keys.join(pairs, ["stream", "file_no"]).join(keys.withColumnRenamed("file_no", "prev"), ["stream", "prev", "record_key"]).select("stream", F.col("file_no").alias("pair"), "record_key")
    held = (
        rows.select("stream", "file_no", "field", "record_key", "h")
        .join(only, ["stream", "file_no", "field"])
        .join(shared, ["stream", "pair", "record_key"], "left_semi")
        .select("stream", "pair", "file_no", "field", F.xxhash64("record_key", "h").alias("e"))
        .distinct()
    )
    proof = held.groupBy("stream", "pair", "field").agg(F.concat_ws(":", F.count("*"), F.sum(F.col("e").cast("decimal(38,0)")), F.bit_xor("e")).alias("proof"))
    whole = both.join(proof.withColumnRenamed("pair", "file_no"), ["stream", "file_no", "field"], "left")

    # one row per pair of files holds both schemas, whose size has nothing to do with the number of records
    pairs_of = whole.groupBy("stream", "file_no").agg(F.collect_list(F.struct("field", "old", "new", "proof")).alias("fields"))

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for stream, file_no, fields in zip(*(batch.column(i).to_pylist() for i in range(3))):
                old = {x["field"]: x["old"] for x in fields if x["old"] is not None}
                new = {x["field"]: x["new"] for x in fields if x["new"] is not None}
                proofs = {x["field"]: x["proof"] for x in fields if x["proof"] is not None}
                cost, steps, found = tree_edit(old, new, proofs, proofs)
                out += [(stream, file_no, None, f, c, g, 1, cost) for f, c, g in found]
                out += [(stream, file_no, op, x, None, y, n, cost) for op, x, y, n in steps]
            cols = list(zip(*out)) or [()] * len(_PAIR)
            types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=_PAIR.names)

    return pairs_of.mapInArrow(run, _PAIR)


def changes(lines: DataFrame) -> DataFrame:
    """stream, file_no, field, change, new_field of every change between neighbouring files."""
    rows = Shelf(lines.sparkSession, "drift").put(flatten_lines(lines), "rows")
    return scripts(lines, rows).where("op is null").select("stream", "file_no", "field", "change", "new_field")


def projections(lines: DataFrame, rows: DataFrame, shelf: Shelf) -> DataFrame:
    """stream, file_no, field, name: the scripts compiled into the name every file's field has in the one table.

    A rename or move hands the name on, so the names are the roots of chains of
    (file, field) nodes: a field's name is the first it had in its stream.  Should
    two chains of a stream begin with the same name, the later one gets ``#2`` and
    so on.
    """
    found = shelf.put(scripts(lines, rows).where("op is null"), "scripts")
    fields = rows.select("stream", "file_no", "field").distinct()
    pairs = neighbours(lines)
    node = lambda f, c: F.concat_ws("\x1e", F.col(f).cast("string"), F.col(c))
    renamed = found.where("change = 'renamed'").groupBy("stream", "file_no", F.col("new_field").alias("field")).agg(F.min("field").alias("was"))
    older = fields.select("stream", F.col("file_no").alias("prev"), "field", F.lit(True).alias("stays"))
    chain = (
        fields.join(pairs, ["stream", "file_no"], "left")
        .join(older, ["stream", "prev", "field"], "left")
        .join(renamed, ["stream", "file_no", "field"], "left")
        .withColumn("from", F.when(F.col("stays"), F.col("field")).otherwise(F.col("was")))
        .select(F.col("stream").alias("kind"), node("file_no", "field").alias("id"), F.when(F.col("from").isNotNull(), node("prev", "from")).alias("parent"))
    )
    tree = roots(chain).select(F.col("kind").alias("stream"), "id", "root")
    part = lambda c, i: F.element_at(F.split(c, "\x1e"), i)
    tree = tree.select("stream", part("id", 1).cast("int").alias("file_no"), part("id", 2).alias("field"), part("root", 1).cast("int").alias("first"), part("root", 2).alias("name"))
    starts = tree.select("stream", "name", "first").distinct().withColumn("nth", F.row_number().over(W.partitionBy("stream", "name").orderBy("first")))
    return tree.join(starts, ["stream", "name", "first"]).select("stream", "file_no", "field", F.when(F.col("nth") > 1, F.concat_ws("#", "name", F.col("nth").cast("string"))).otherwise(F.col("name")).alias("name"))


def columns(rows: DataFrame, projection: DataFrame) -> DataFrame:
    """name, type, n_records: the columns of the one table; the type is the one most values have (ties: the first in the alphabet)."""
    counts = rows.groupBy("stream", "file_no", "field").agg(F.count("*").alias("records"), *(F.sum(f"n_{t}").alias(t) for t in TYPES))
    sums = counts.join(projection, ["stream", "file_no", "field"]).groupBy("name").agg(F.sum("records").alias("n_records"), *(F.sum(t).alias(t) for t in TYPES))
    return sums.select("name", F.coalesce(*(F.when(F.col(t) == F.greatest(*TYPES), F.lit(t)) for t in TYPES)).alias("type"), "n_records")


_COLUMN = {"string": T.StringType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "array": T.ArrayType(T.StringType())}
_ARROW = {"string": pa.string(), "number": pa.float64(), "boolean": pa.bool_(), "array": pa.list_(pa.string())}
_TRUTH = {"true": True, "false": False}


def _text(v: object) -> str:
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def _cast(v: object, kind: str) -> object:
    """The value as the column's type, or null where nothing of it would be left."""
    if kind == "string":
        return _text(v)
    if kind == "array":
        return [_text(x) for x in (v if isinstance(v, list) else [v])]
    if kind == "boolean":
        return v if isinstance(v, bool) else _TRUTH.get(v.strip().lower()) if isinstance(v, str) else None
    if isinstance(v, bool) or isinstance(v, list):
        return None
    try:
        x = float(v)
    except (ValueError, OverflowError):
        return None
    return x if isinstance(v, str) or x == v else None


def _column_names(names: list[str]) -> list[str]:
    """Names without dots and brackets, distinct from each other and from the keys of a line."""
    out: list[str] = []
    used = {"record_id", "stream", "file_no", "record_key", "misfits"}
    for n in names:
        plain = base = n.replace("[].", "__").replace("[]", "").replace(".", "_").replace("#", "_v") or "_"
        k = 2
        while plain.lower() in used:
            plain, k = f"{base}_{k}", k + 1
        used.add(plain.lower())
        out.append(plain)
    return out


def unified(lines: DataFrame) -> DataFrame:
    """record_id, stream, file_no, record_key, a typed column per field, misfits: every line in one schema.

    A field inside a list of objects gives a list.  A value of another type is
    cast where that loses nothing (a number in quotes, a single value of a list);
    any other is null in its column and stands as JSON in ``misfits`` under the
    field's name.  Lines without fields keep their row.  The number of columns is
    that of distinct names, which has nothing to do with the number of lines; a
    file's projection travels with its lines by a join on (stream, file_no) and
    names only the fields whose path isn't their name.
    """
    shelf = Shelf(lines.sparkSession, "drift")
    rows = shelf.put(flatten_lines(lines), "rows")
    projection = shelf.put(projections(lines, rows, shelf), "projection")
    cols = sorted((r.name, r.type) for r in columns(rows, projection).collect())
    names = _column_names([n for n, _ in cols])
    lists = ["[]" in n for n, _ in cols]
    place = {n: i for i, (n, _) in enumerate(cols)}
    schema = T.StructType(
        [T.StructField("record_id", T.LongType()), T.StructField("stream", T.StringType()), T.StructField("file_no", T.IntegerType()), T.StructField("record_key", T.StringType())]
        + [T.StructField(c, T.ArrayType(T.StringType() if kind == "array" else _COLUMN[kind]) if many else _COLUMN[kind]) for c, (_, kind), many in zip(names, cols, lists)]
        + [T.StructField("misfits", T.MapType(T.StringType(), T.StringType()))]
    )
    types = [pa.list_(pa.string() if kind == "array" else _ARROW[kind]) if many else _ARROW[kind] for (_, kind), many in zip(cols, lists)]

    def run(batches):
        compiled: dict[str | None, dict[str, str]] = {None: {}}
        for batch in batches:
            data: list[list] = [[None] * batch.num_rows for _ in cols]
            odd: list[list[tuple[str, str]]] = [[] for _ in range(batch.num_rows)]
            for r, (text, script) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                if script not in compiled:
                    compiled[script] = json.loads(script)
                other = compiled[script]
                out: dict[str, list] = defaultdict(list)
                try:
                    record = json.loads(text) if text else None
                except ValueError:
                    record = None
                if isinstance(record, dict):
                    leaves(record, "", out)
                for field, values in out.items():
                    i = place[other.get(field, field)]
                    kind = cols[i][1]
                    if lists[i]:
                        cast = [json.dumps(v, ensure_ascii=False) if kind == "array" else _cast(v, kind) for _, v in values]
                        data[i][r] = cast
                        lost = [v for (_, v), c in zip(values, cast) if c is None]
                    else:
                        data[i][r] = _cast(values[0][1], kind)
                        lost = [values[0][1]] if data[i][r] is None else []
                    if lost:
                        odd[r].append((cols[i][0], json.dumps(lost if lists[i] else lost[0], ensure_ascii=False)))
            arrays = [batch.column(i) for i in range(4)] + [pa.array(c, t) for c, t in zip(data, types)] + [pa.array(odd, pa.map_(pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    moved = projection.where("field <> name").groupBy("stream", "file_no").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "name"))))).alias("script"))
    slim = lines.select(F.col("record_id").cast("long"), "stream", F.col("file_no").cast("int"), "record_key", "payload")
    return slim.join(moved, ["stream", "file_no"], "left").select("record_id", "stream", "file_no", "record_key", "payload", "script").mapInArrow(run, schema)
