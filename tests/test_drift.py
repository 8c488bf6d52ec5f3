import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliomill.operators import drift
from foliomill.session import Shelf

COLS = "record_id long, stream string, file_no int, record_key string, payload string"


def lines(spark, files, stream="s"):
    rows, n = [], 0
    for no, records in files.items():
        for key, payload in records:
            n += 1
            rows.append((n, stream, no, key, payload if payload is None or isinstance(payload, str) else json.dumps(payload)))
    return spark.createDataFrame(rows, COLS)


def test_changes(spark):
    files = {
        1: [("a", {"x": 1, "m": {"old": "u"}, "t": 5, "gone": True, "l": [{"k": 1}, {"k": 2}], "e": [], "z": None}), ("b", {"x": 2, "m": {"old": "v"}, "t": 6})],
        4: [("b", {"x": 2, "moved": "v", "t": "6", "l": [{"kk": 1}]}), ("a", {"x": 1, "moved": "u", "t": "5", "new": [1, 2], "l": [{"kk": 1}, {"kk": 2}]})],
    }
    got = {tuple(r) for r in drift.changes(lines(spark, files)).collect()}
    assert got == {
        ("s", 4, "m.old", "renamed", "moved"),
        ("s", 4, "t", "retyped", ""),
        ("s", 4, "gone", "removed", ""),
        ("s", 4, "new", "added", ""),
        ("s", 4, "l[].k", "removed", ""),  # record b holds kk but not k
        ("s", 4, "l[].kk", "added", ""),
    }


def test_rename_needs_evidence(spark):
    files = {1: [("a", {"p": 1}), ("b", {"q": 1})], 2: [("c", {"r": 1}), ("b", {"s": 1.0})]}
    got = {tuple(r)[2:] for r in drift.changes(lines(spark, files)).collect()}
    # p and r lie on records that the files don't share; q and s agree on b
    assert got == {("p", "removed", ""), ("r", "added", ""), ("q", "renamed", "s")}


def test_order_type_and_value_matter(spark):
    files = {1: [("a", {"p": [1, 2], "q": "1", "u": [{"v": 1}, {"v": 2}]})], 2: [("a", {"p2": [2, 1], "q2": 1, "u": [{"w": 2}, {"w": 1}]})]}
    assert {tuple(r)[3] for r in drift.changes(lines(spark, files)).collect()} == {"removed", "added"}


def test_majority_type_and_ties(spark):
    files = {1: [("a", {"x": 1}), ("b", {"x": "1"}), ("c", {"y": 1}), ("d", {"y": True})], 2: [("a", {"x": "n"}), ("c", {"y": False})]}
    got = {tuple(r)[2:] for r in drift.changes(lines(spark, files)).collect()}
    assert got == {("x", "retyped", "")}  # x is number by the alphabet, then string; y boolean in both


def test_dirt_and_table(spark):
    files = {1: [("a", {"name": "n", "deep": {"u": 1, "v": 2}}), (None, "not json"), ("q", None), ("q", "[1]"), ("a", {"name": "n", "deep": {"u": 1, "v": 2}})], 2: [("a", {"title": "n", "flat": {"u": 1, "v": 2}})], 3: [("z", {"title": "m"})]}
    df = lines(spark, files).withColumn("misfits", F.lit("mine"))
    out = {r.record_id: r for r in drift.unified(df).collect()}
    assert len(out) == df.count()
    assert all(tuple(out[i])[4:] == (None, None, None, {}) for i in (2, 3, 4))
    assert out[6].asDict() == {"record_id": 6, "stream": "s", "file_no": 2, "record_key": "a", "deep_u": 1.0, "deep_v": 2.0, "name": "n", "misfits": {}}
    assert out[7].name == "m"
    steps = {(r.op, r.field, r.new_field, r.leaves) for r in drift.scripts(df, drift.flatten_lines(df)).where("op is not null and file_no = 2").collect()}
    assert steps == {("rename", "name", "title", 1), ("rename", "deep", "flat", 2)}
    assert drift.changes(df.limit(0)).count() == 0 and drift.unified(df.limit(0)).columns == ["record_id", "stream", "file_no", "record_key", "misfits"]


def test_types_of_the_table(spark):
    big = 2**53 + 1
    files = {1: [("a", {"n": 1, "b": True, "s": "x", "l": ["p", 2], "o": [{"k": 1}, {"k": 2, "m": ["q"]}]}), ("b", {"n": "2.5", "b": "False", "s": 7, "l": "single", "o": [{"k": "no"}, {"k": "3"}]}), ("c", {"n": "many", "b": 3, "s": False, "n.x": big}), ("d", {"n": 3, "b": False, "s": "y"})]}
    r = drift.unified(lines(spark, files)).orderBy("record_id").collect()
    assert [x.n for x in r] == [1.0, 2.5, None, 3.0] and [x.b for x in r] == [True, False, None, False] and [x.s for x in r] == ["x", "7", "false", "y"]
    assert [x.l for x in r] == [["p", "2"], ["single"], None, None] and [x.o__k for x in r] == [[1.0, 2.0], [None, 3.0], None, None] and r[0].o__m == ['["q"]']
    assert [x.misfits for x in r] == [{}, {"o[].k": '["no"]'}, {"n": '"many"', "b": "3", "n.x": str(big)}, {}]


def test_two_fields_of_one_name(spark):
    files = {1: [("a", {"x": 1})], 2: [("a", {"y": 1, "x": "new"})], 3: [("b", {"x": "newer"})]}
    # x is renamed to y only where it is gone, so it stays x
    assert {(r.name, r.type) for r in drift.columns(drift.flatten_lines(lines(spark, files)), drift.projections(lines(spark, files), drift.flatten_lines(lines(spark, files)), Shelf(spark, "t"))).collect()} == {("x", "string"), ("y", "number")}
    files = {1: [("a", {"x": 1})], 2: [("a", {"y": 1})], 3: [("a", {"x": 2, "y": 1})]}
    assert drift.unified(lines(spark, files)).select("record_id", "x", "x_v2").orderBy("record_id").collect() == [(1, 1.0, None), (2, 1.0, None), (3, 1.0, 2.0)]


def test_distance_of_equal_candidates():
    cost, steps, changes = drift.tree_edit({"a": "number", "b": "number"}, {"c": "number"}, {"a": 1, "b": 1}, {"c": 1})
    assert cost == 2 and changes == [("a", "renamed", "c"), ("b", "renamed", "c")] and [s[0] for s in steps] == ["delete", "rename"]


def test_a_renamed_object_costs_one():
    old = {f"deep.{k}": "number" for k in "abcde"} | {"x": "string", "gone[].y": "string"}
    new = {f"flat.{k}": "number" for k in "abcde"} | {"flat.x": "string", "gone[].y": "number"}
    proof = {k: k for k in "abcdex"}
    cost, steps, changes = drift.tree_edit(old, new, {p: proof[p[-1]] for p in old if p[-1] != "y"}, {p: proof[p[-1]] for p in new if p[-1] != "y"})
    assert cost == 3 and steps == [("move", "x", "flat.x", 1), ("rename", "deep", "flat", 5), ("retype", "gone[].y", "", 1)]
    assert len(changes) == 7


def least_cost(old, new, proof_old, proof_new):
    """The tree edit distance by trying every mapping of nodes."""
    nodes = [[("inner", up) for up in sorted({u for f in fields for u in drift._ups(f)})] + [("leaf", f) for f in sorted(fields)] for fields in (old, new)]

    def fits(x, y):
        if x[0] != y[0]:
            return False
        if x[0] == "inner" or x[1] == y[1]:
            return True
        return x[1] not in new and y[1] not in old and proof_old.get(x[1]) is not None and proof_old.get(x[1]) == proof_new.get(y[1])

    def cost(pairs):
        image = {x[1]: y[1] for x, y in pairs if x[0] == "inner"} | {"": ""}
        total = len(nodes[0]) + len(nodes[1]) - 2 * len(pairs)
        for x, y in pairs:
            (up, key), (new_up, new_key) = drift._split(x[1]), drift._split(y[1])
            total += key != new_key or image.get(up) != new_up
            total += x[0] == "leaf" and x[1] == y[1] and old[x[1]] != new[y[1]]
        return total

    def every(i, used, pairs):
        if i == len(nodes[0]):
            return cost(pairs)
        return min([every(i + 1, used, pairs)] + [every(i + 1, used | {y}, [*pairs, (nodes[0][i], y)]) for y in nodes[1] if y not in used and fits(nodes[0][i], y)])

    return every(0, frozenset(), [])


def test_distance_against_brute_force():
    rng = random.Random(5)
    parents = ["", "p.", "q.", "p.r.", "l[]."]
    for _ in range(150):
        sides = []
        for _ in range(2):
            fields = {rng.choice(parents) + rng.choice("abc"): rng.choice(["number", "string"]) for _ in range(rng.randrange(5))}
            sides.append((fields, {f: rng.choice([1, 2, 3, None]) for f in fields}))
        (old, proof_old), (new, proof_new) = sides
        cost, steps, _ = drift.tree_edit(old, new, proof_old, proof_new)
        assert cost == len(steps) == least_cost(old, new, proof_old, proof_new), sides


def walk(v, path, out):
    if isinstance(v, dict):
        for k, x in v.items():
            walk(x, f"{path}.{k}" if path else k, out)
    elif isinstance(v, list) and any(isinstance(x, dict) for x in v):
        for x in v:
            walk(x, path + "[]", out)
    elif isinstance(v, list):
        if [x for x in v if x is not None]:
            out.append((path, "array", json.dumps(v)))
    elif v is not None:
        out.append((path, "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string", json.dumps(v)))


def brute(files):
    """The changes by the definition, pair of files by pair of files."""
    out = set()
    held = {}
    for no, records in files.items():
        held[no] = [(key, leaves) for key, rec in records if not walk(rec, "", leaves := [])]
    for a, b in zip(sorted(files), sorted(files)[1:]):
        types, values = {}, {}
        for no in (a, b):
            count, values[no] = {}, {}
            for key, ls in held[no]:
                for p, t, v in ls:
                    count.setdefault(p, Counter())[t] += 1
                for p in {p for p, _, _ in ls}:
                    values[no].setdefault(p, {})[key] = [(t, v) for q, t, v in ls if q == p]
            types[no] = {p: min(t for t in c if c[t] == max(c.values())) for p, c in count.items()}
        shared = {k for k, _ in held[a]} & {k for k, _ in held[b]}
        gone, come = types[a].keys() - types[b].keys(), types[b].keys() - types[a].keys()
        pairs = {(f, g) for f in gone for g in come if (ks := [k for k in shared if k in values[a][f] or k in values[b][g]]) and all(values[a][f].get(k) == values[b][g].get(k) for k in ks)}
        out |= {(b, f, "renamed", g) for f, g in pairs}
        out |= {(b, f, "removed", "") for f in gone - {f for f, _ in pairs}} | {(b, g, "added", "") for g in come - {g for _, g in pairs}}
        out |= {(b, f, "retyped", "") for f in types[a].keys() & types[b].keys() if types[a][f] != types[b][f]}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_streams_against_brute_force(spark, seed):
    rng = random.Random(seed)
    names = [f"f{k}" for k in range(8)]
    base = {k: {n: rng.choice([1, 2, "a", "b", True, None, [], ["x"], [1, None], [{"u": 1, "w": rng.choice("pq")}, {"u": 2}], {"in": rng.choice([3, "z"])}]) for n in names} for k in "abcdefgh"}
    files = {}
    for no in (1, 2, 5, 6):
        rename = {n: rng.choice([n, n, n, f"g{rng.randrange(4)}{n}", None]) for n in names}
        files[no] = [(k, {rename[n]: (str(v) if rng.random() < 0.1 and v is not None else v) for n, v in base[k].items() if rename[n]}) for k in rng.sample("abcdefgh", 5)]
    got = {tuple(r)[1:] for r in drift.changes(lines(spark, files)).collect()}
    assert got == brute(files)
