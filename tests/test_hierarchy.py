import random

from foliomill.operators import hierarchy as h
from foliomill.plans import hierarchies


def brute(parents):
    """state, root, depth and children of every id, by walking."""
    out = {}
    for i in parents:
        seen, x, path = set(), i, []
        while x is not None and x in parents and x not in seen:
            seen.add(x)
            path.append(x)
            x = parents[x]
        if x is None:
            out[i] = ("ok", path[-1], len(path) - 1)
        elif x not in parents:
            out[i] = ("orphan", path[-1], len(path) - 1)
        else:
            loop = path[path.index(x) :]
            out[i] = ("cycle" if i in loop else "below_cycle", None, None)
    return out


def check(spark, parents):
    nodes = spark.createDataFrame([("n", i, p) for i, p in parents.items()], "kind string, id string, parent string")
    tree = h.hierarchy(nodes)
    got = {r.id: r for r in tree.collect()}
    want = brute(parents)
    assert set(got) == set(want)
    for i, (state, root, depth) in want.items():
        assert (got[i].state, got[i].root, got[i].depth) == (state, root, depth)
    for i, r in got.items():
        if r.lft is None:
            continue
        below = {j for j, s in got.items() if s.lft is not None and s.root == r.root and r.lft < s.lft <= r.rgt}
        assert below == {j for j in want if j != i and want[j][1] == r.root and i in path_of(j, parents)}
        assert r.size == len(below) + 1
    return tree


def path_of(i, parents):
    out = []
    while i is not None and i in parents:
        out.append(i)
        i = parents[i]
    return out


def test_trees_cycles_orphans(spark):
    parents = {"a": None, "b": "a", "c": "a", "d": "b", "e": "gone", "f": "e", "x": "y", "y": "x", "z": "x", "s": "s", "t": "z"}
    tree = check(spark, parents)
    paths = {r.id: r.path for r in h.paths(tree).collect()}
    assert paths["d"] == ["a", "b", "d"] and paths["f"] == ["e", "f"] and "z" not in paths
    some = spark.createDataFrame([("n", "a")], "kind string, id string")
    assert {r.id for r in h.descendants(tree, some).collect()} == {"b", "c", "d"}


def test_random_forest_and_long_chain(spark):
    rng = random.Random(3)
    ids = [f"i{k}" for k in range(150)]
    parents = {i: rng.choice([None, "lost", *ids]) for i in ids}
    parents |= {f"c{k}": f"c{k - 1}" if k else None for k in range(70)}
    check(spark, parents)


def test_star_has_every_child_in_range(spark):
    parents = {"hub": None} | {f"k{j}": "hub" for j in range(300)}
    nodes = spark.createDataFrame([("n", i, p) for i, p in parents.items()], "kind string, id string, parent string")
    rows = h.hierarchy(nodes).collect()
    assert sorted(r.lft for r in rows) == list(range(301))
    assert {r["size"] for r in rows if r.id == "hub"} == {301}


def test_dirty_links(spark):
    rows = [(" A ", None), ("a", " "), ("b", "A\t"), ("b", "a"), (None, "a"), ("  ", "a"), ("c", "LEGACY "), ("d", " c")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "id string, parent_id string, kind int, k int")
    links = h.links(df, "id", "parent_id", "v", ("legacy",))
    assert {(r.id, r.parent) for r in links.collect()} == {("a", None), ("b", "a"), ("c", None), ("d", "c")}
    assert {(r.id, r.depth) for r in h.hierarchy(links).collect()} == {("a", 0), ("b", 1), ("c", 0), ("d", 1)}


def test_empty(spark):
    nodes = spark.createDataFrame([], "kind string, id string, parent string")
    assert h.hierarchy(nodes).count() == 0
    assert h.roots(nodes).count() == 0
    assert h.paths(h.hierarchy(nodes)).count() == 0


def test_descendants_of_large_trees(spark):
    rng = random.Random(9)
    parents = {"n0": None} | {f"n{k}": f"n{max(0, k - rng.randint(1, 40))}" for k in range(1, 900)}
    nodes = spark.createDataFrame([("n", i, p) for i, p in parents.items()], "kind string, id string, parent string")
    of = spark.createDataFrame([("n", f"n{k}") for k in (0, 1, 2, 7, 100, 899)] + [("n", "n0"), ("other", "n0")], "kind string, id string")
    got = [(r.ancestor, r.id) for r in h.descendants(h.hierarchy(nodes), of).collect()]
    want = {(a, i) for a in ("n0", "n1", "n2", "n7", "n100", "n899") for i in parents if i != a and a in path_of(i, parents)}
    assert len(got) == len(set(got)) and set(got) == want


def test_query_gives_descendants_of_every_record(spark, tmp_path):
    versions = {"a": None, "b": "a", "c": "b", "d": "a", "e": "gone", "f": "e", "x": "y", "y": "x", "z": "x", "t": "z", "u": "t"}
    runs = {"a": None, "g": "a"}
    spark.createDataFrame(list(versions.items()), "id string, parent_id string").write.parquet(f"{tmp_path}/lab_versions.parquet")
    spark.createDataFrame(list(runs.items()), "id string, parent_run_id string").write.parquet(f"{tmp_path}/lab_runs.parquet")
    got = sorted((r.kind, r.ancestor, r.id) for r in hierarchies.p2_descendants(spark, str(tmp_path)).collect())
    want = {"a": "bcd", "b": "c", "e": "f", "z": "tu", "t": "u"}
    assert got == sorted([("version", a, i) for a, ids in want.items() for i in ids] + [("run", "a", "g")])
