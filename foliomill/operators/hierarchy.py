"""Parent-child rows to nested-set hierarchies in a logarithmic number of rounds.

Upward: every node starts as a subtree of one row and a pointer to its parent.
In round k the pointer leads 2**k steps up, each node hands the size it has
gathered to the node its pointer names, and the pointers double.  After
log2(height) rounds every subtree size is complete.  Nodes whose pointer never
leaves the records stay unprocessed: they lie on or below a cycle.

Downward: a node's preorder offset under its parent is one plus the sizes of
its earlier siblings (prefix sums, in two levels so that a parent of any number
of children is spread over many tasks).  The same pointers add the offsets along
the path to the root, which gives each node the range [lft, rgt] within its tree.
b is a descendant of a exactly if both have the same root and
a.lft < b.lft <= a.rgt.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from foliomill.session import BLANKS, Shelf

OK, ORPHAN, CYCLE, BELOW = "ok", "orphan", "cycle", "below_cycle"


def plain_id(c: Column) -> Column:
    """Trimmed and lower-cased; blank becomes null."""
    trimmed = F.lower(F.btrim(c, F.lit(BLANKS)))
    return F.when(trimmed != "", trimmed)


def links(df: DataFrame, id_col: str, parent_col: str, kind: str, root_words: tuple[str, ...] = ()) -> DataFrame:
    """kind, id, parent: one row per id; root_words are parent values that mean a root."""
    parent = plain_id(F.col(parent_col))
    if root_words:
        parent = F.when(~parent.isin(*root_words), parent)
    return (
        df.select(plain_id(F.col(id_col)).alias("id"), parent.alias("parent"))
        .where("id is not null")
        .groupBy("id")
        .agg(F.min("parent").alias("parent"))
        .select(F.lit(kind).alias("kind"), "id", "parent")
    )


#: Parts of a round's table: nodes still under way, nodes that reached their root, finished nodes that others point at.
_ACTIVE, _DONE, _LIVE = 0, 1, 2


def _climb(nodes: DataFrame, shelf: Shelf):
    """The upward rounds: written nodes, round 0, all rounds, number of rounds in which nodes reached a root, nodes without one.

    A round reads the table of the round before: the active nodes and those
    finished ones that active nodes point at.  What nobody points at in one round
    nobody points at later (a node 2**(k+1) steps below implies one 2**k steps
    below), so the rest is never read again.  A round has two shuffles: one brings
    each node together with the sums handed to it (combined in each task before),
    one brings the active nodes to their targets, which are in place already.
    """
    # the rounds move eight-byte numbers; ids return at the end
    base = shelf.put(nodes.select("kind", "id", "parent", F.monotonically_increasing_id().alias("k")), "base")
    # round 0: which parents exist
    known = base.select("kind", F.col("id").alias("parent"), F.col("k").alias("p"))
    none = lambda t: F.lit(None).cast(t)
    top = F.col("p").isNull()
    is_active = F.col("part") == _ACTIVE
    seen = Observation()
    first = shelf.put(
        base.join(known, ["kind", "parent"], "left")
        .select(
            "k",
            F.col("p").alias("anc"),
            F.lit(1).cast("long").alias("s"),
            F.when(top, F.col("k")).alias("root"),
            F.when(top, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("depth"),  # of an active node: its steps to anc
            F.when(top, F.col("parent").isNotNull()).alias("orphan"),
            top.alias("img"),
            none("long").alias("more"),
            F.when(top, F.lit(_DONE)).otherwise(F.lit(_ACTIVE)).alias("part"),
        )
        .observe(seen, F.count_if(is_active).alias("active")),
        "up0",
    )
    now, k, left, n = first, 0, seen.get["active"], None
    while left and left != n:  # no node of depth 2**k means none that is deeper
        n = left
        needed = now.where(is_active | F.col("img"))
        fields = ("anc", "s", "root", "depth", "orphan")
        own = needed.select("k", *fields, none("long").alias("got"))
        handed = now.where(is_active).select(F.col("anc").alias("k"), none("long").alias("anc"), none("long").alias("s"), none("long").alias("root"), none("long").alias("depth"), none("boolean").alias("orphan"), F.col("s").alias("got"))
        here = own.unionByName(handed).groupBy("k").agg(*(F.max(c).alias(c) for c in fields), F.sum("got").alias("got"))
        fin, img = F.col("root").isNotNull(), F.col("got").isNotNull()
        target = here.where(img).select(F.col("k").alias("anc"), F.col("anc").alias("anc2"), "root", F.col("depth").alias("above"), "orphan")
        moved = here.where(~fin).select("k", "anc", (F.col("s") + F.coalesce("got", F.lit(0))).alias("s"), "depth", img.alias("img")).join(target, "anc")
        # steps add up: an active target is as many steps from its own target as the node is from it
        moved = moved.select("k", F.col("anc2").alias("anc"), "s", "root", (F.col("depth") + F.col("above")).alias("depth"), "orphan", "img", none("long").alias("more"), F.when(fin, F.lit(_DONE)).otherwise(F.lit(_ACTIVE)).alias("part"))
        kept = here.where(fin & img).select("k", none("long").alias("anc"), none("long").alias("s"), "root", "depth", "orphan", F.lit(True).alias("img"), F.col("got").alias("more"), F.lit(_LIVE).alias("part"))
        seen = Observation()
        now = shelf.put(moved.unionByName(kept).observe(seen, F.count_if(is_active).alias("active")), f"up{k + 1}")
        k, left = k + 1, seen.get["active"]
    rounds = shelf.many([f"up{i}" for i in range(k + 1)], first)
    return base, first, rounds, k - (left > 0), _lost(now.where(is_active).select("k", "anc"), left, shelf)


def _lost(active: DataFrame, left: int, shelf: Shelf) -> DataFrame:
    """k, state of the nodes without a root: pointers double until they all lead into cycles."""
    if not left:
        return active.select("k", F.lit(BELOW).alias("state"))
    ring, r = active.select("anc").distinct(), 0
    n, before = ring.count(), None
    while n != before:  # the set of targets only shrinks, and stops at the cycles
        active = shelf.put(active.join(active.select(F.col("k").alias("anc"), F.col("anc").alias("anc2")), "anc").select("k", F.col("anc2").alias("anc")), f"lost{r}")
        ring, r = active.select("anc").distinct(), r + 1
        n, before = ring.count(), n
    ring = ring.select(F.col("anc").alias("k"), F.lit(CYCLE).alias("state"))
    return active.select("k").join(ring, "k", "left").select("k", F.coalesce("state", F.lit(BELOW)).alias("state"))


def _finished(rounds: DataFrame) -> DataFrame:
    """k, s, root, depth, state of the nodes that reached a root."""
    return rounds.where(F.col("part") == _DONE).select("k", "s", "root", "depth", F.when(F.col("orphan"), ORPHAN).otherwise(OK).alias("state"))


def roots(nodes: DataFrame) -> DataFrame:
    """kind, id, state, root, depth: the upward rounds alone, for callers that need no ranges."""
    shelf = Shelf(nodes.sparkSession, "roots")
    base, _, rounds, _, lost = _climb(nodes, shelf)
    names = base.select(F.col("k").alias("root"), F.col("id").alias("root_id"))
    tops = _finished(rounds).join(names, "root").select("k", "state", F.col("root_id").alias("root"), "depth")
    tops = tops.unionByName(lost.select("k", "state", F.lit(None).cast("string").alias("root"), F.lit(None).cast("long").alias("depth")))
    return base.join(tops, "k").select("kind", "id", "state", "root", "depth")


def hierarchy(nodes: DataFrame) -> DataFrame:
    """kind, id, parent, state, root, depth, size, lft, rgt of every node.

    nodes: kind, id, parent, with (kind, id) unique and parents within a kind.
    A null parent is a root.  state is ``ok``, ``orphan`` (the chain ends at a
    parent that has no record; root is then the topmost known ancestor),
    ``cycle`` or ``below_cycle``; for the last two the other columns are null.
    size counts the node itself; lft runs from 0 in each tree, rgt = lft + size - 1.
    Empty input gives an empty result; rows with a null id must be left out
    (``links`` does so, and takes the least parent where rows of an id differ).
    """
    spark = nodes.sparkSession
    shelf = Shelf(spark, "hierarchy")
    base, first, rounds, n_rounds, lost = _climb(nodes, shelf)
    # what was handed to a node after it had finished, and the number of rounds in which that happened
    later = rounds.where(F.col("part") == _LIVE).groupBy("k").agg(F.sum("more").alias("more"), F.count("*").alias("far"))
    sized = first.select("k", F.col("anc").alias("p")).join(_finished(rounds), "k").join(later, "k", "left")
    sized = shelf.put(sized.select("k", "p", "root", "depth", "state", (F.col("s") + F.coalesce("more", F.lit(0))).alias("size"), F.coalesce("far", F.lit(0)).alias("far")), "sized")
    # downward: a node hands on the sum of the offsets along its pointer until the pointer's target has its range;
    # "far" counts down the rounds in which anyone still points at the node once it has
    way = shelf.put(_offsets(spark, sized).join(sized.select("k", F.col("p").alias("anc"), "far"), "k").select("k", "anc", "w", "far", F.col("anc").isNull().alias("fin")), "down0")
    first_way = way
    for i in range(n_rounds):
        going = way.where("not fin").select("k", "anc", "w", "far")
        live = way.where("fin and far > 0")
        target = way.where("not fin or far > 0").select(F.col("k").alias("anc"), F.col("anc").alias("anc2"), F.col("w").alias("w2"), "fin")
        moved = going.join(target, "anc").select("k", F.col("anc2").alias("anc"), (F.col("w") + F.col("w2")).alias("w"), "far", "fin", F.lit(True).alias("new"))
        kept = live.select("k", "anc", "w", (F.col("far") - 1).alias("far"), "fin", F.lit(False).alias("new"))
        way = shelf.put(moved.unionByName(kept), f"down{i + 1}")
    lft = first_way.where("fin").select("k", F.col("w").alias("lft"))
    if n_rounds:
        lft = lft.unionByName(shelf.many([f"down{i + 1}" for i in range(n_rounds)], way).where("fin and new").select("k", F.col("w").alias("lft")))
    names = base.select(F.col("k").alias("root"), F.col("id").alias("root_id"))
    numbers = sized.join(lft, "k").join(names, "root").select("k", "state", F.col("root_id").alias("root"), "depth", "size", "lft", (F.col("lft") + F.col("size") - 1).alias("rgt"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("root", "string"), ("depth", "long"), ("size", "long"), ("lft", "long"), ("rgt", "long"))]
    numbers = numbers.unionByName(lost.select("k", "state", *none))
    return base.join(numbers, "k").select("kind", "id", "parent", "state", "root", "depth", "size", "lft", "rgt")


def _offsets(spark, sized: DataFrame) -> DataFrame:
    """k, w: the preorder offset under the parent; 0 for the top of a tree.

    Siblings are ordered by (bucket of the id's hash, id).  Only the sums of a
    parent's buckets meet in one window, and each bucket has a window of its own.
    """
    buckets = max(16, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    kids = sized.where("depth > 0").select("k", "p", "size", F.pmod(F.xxhash64("k"), F.lit(buckets)).cast("int").alias("b"))
    sums = kids.groupBy("p", "b").agg(F.sum("size").alias("n"))
    start = sums.select("p", "b", (F.sum("n").over(W.partitionBy("p").orderBy("b").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("start"))
    inner = kids.withColumn("inner", F.sum("size").over(W.partitionBy("p", "b").orderBy("k").rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    w = inner.join(start, ["p", "b"]).select("k", (F.lit(1) + F.col("start") + F.col("inner")).alias("w"))
    return w.unionByName(sized.where("depth = 0").select("k", F.lit(0).cast("long").alias("w")))


def descendants(tree: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """kind, ancestor, id: every proper descendant of the (kind, id) rows in ``of``, or of all rows, by range.

    A range is cut into blocks of 16**j numbers, at most 30 of each j, and a node
    lies in one block of each j, so each pair meets in exactly one block: the join
    is one of equal keys, and its work follows the size of its result also in a
    tree that holds a third of all nodes.
    """
    a = tree if of is None else tree.join(of.select("kind", "id").distinct(), ["kind", "id"], "left_semi")
    a = a.where("lft is not null and size > 1")
    a = a.select("kind", "root", F.col("id").alias("ancestor"), (F.col("lft") + 1).alias("s"), (F.col("rgt") + 1).alias("e"))  # [s, e)
    most = a.agg(F.max(F.col("e") - F.col("s"))).first()[0] or 1
    levels = 0
    while 16 ** (levels + 1) <= most:
        levels += 1
    cuts = []
    for j in range(levels + 1):
        size, above = 16**j, 16 ** (j + 1)
        first, last = F.ceil(F.col("s") / size), F.floor(F.col("e") / size)  # whole blocks [first, last)
        up, down = F.ceil(F.col("s") / above) * 16, F.floor(F.col("e") / above) * 16  # those that the next size covers
        covered = (up < down) if j < levels else F.lit(False)
        run = lambda x, y: F.when(x < y, F.sequence(x, y - 1)).otherwise(F.expr("cast(array() as array<bigint>)"))
        blocks = F.when(covered, F.concat(run(first, up), run(down, last))).otherwise(run(first, last))
        level = F.lit(j).alias("j")
        cuts.append(F.transform(blocks, lambda b: F.struct(level, b.alias("b"))))  # noqa: B023
    ranges = a.select("kind", "root", "ancestor", F.explode(F.concat(*cuts)).alias("x")).select("kind", "root", "ancestor", "x.j", "x.b")
    inside = tree.where("lft > 0")  # the top of a tree is nobody's descendant
    if of is not None:
        inside = inside.join(a.select("kind", "root").distinct(), ["kind", "root"], "left_semi")
    points = inside.select("kind", "root", "id", F.explode(F.array(*(F.struct(F.lit(j).alias("j"), F.floor(F.col("lft") / 16**j).alias("b")) for j in range(levels + 1)))).alias("x")).select("kind", "root", "id", "x.j", "x.b")
    return points.join(ranges, ["kind", "root", "j", "b"]).select("kind", "ancestor", "id")


def paths(tree: DataFrame) -> DataFrame:
    """kind, id, path: the ids from the root down to the node, for nodes with a root.

    Pointers double here too, each round prepending what the pointer's target has.
    """
    spark = tree.sparkSession
    shelf = Shelf(spark, "paths")
    key = F.concat_ws("\x1f", "kind", "id")
    now = shelf.put(
        tree.where("lft is not null").select(key.alias("k"), "kind", "id", F.when(F.col("depth") > 0, F.concat_ws("\x1f", "kind", "parent")).alias("anc"), F.array("id").alias("path")),
        "path0",
    )
    done, i = [now.where("anc is null")], 0
    while not now.where("anc is not null").isEmpty():
        active = now.where("anc is not null")
        target = reduce(DataFrame.unionByName, [*done, active]).select(F.col("k").alias("anc"), F.col("anc").alias("anc2"), F.col("path").alias("above"))
        i += 1
        now = shelf.put(active.join(target, "anc").select("k", "kind", "id", F.col("anc2").alias("anc"), F.concat("above", "path").alias("path")), f"path{i}")
        done.append(now.where("anc is null"))
    return reduce(DataFrame.unionByName, done).select("kind", "id", "path")
