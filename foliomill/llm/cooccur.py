"""Items that appear together: a persistent pair table fed by changed baskets.

A change of a basket is its items before and after.  Changes become signed
counts (-1 for the set before, +1 for the set after); equal sets are added up
first, so a set that occurs a million times emits its pairs once.  The signed
deltas of pairs, single items and the number of baskets are merged into counts
that lie in hash buckets on shared storage: only buckets with a delta are read
and rewritten.  A manifest per generation names the files of each bucket; the one
of the highest number counts, and it appears by a rename as the last step of a
merge, so a merge that stops anywhere leaves the state before or the state after.
The number of buckets doubles as the table grows, so that a delta keeps touching
a small share of it.  Association scores are recomputed for pairs of which a
count or a marginal changed, and for all pairs where the number of baskets changed.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest file of a bucket, about.
FILE_BYTES = 128 << 20


def item_text(c: Column) -> Column:
    """Trimmed, lower-case, hyphens and inner blanks as underscores; blank becomes null."""
    t = F.regexp_replace(F.lower(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")), r"[\s \-]", "_")
    return F.when(t != "", t)


def item_set(items: Column) -> Column:
    """The distinct items that aren't null, in order; a null list is empty."""
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(items, F.expr("cast(array() as array<string>)")), lambda x: x.isNotNull())))


class PairTable:
    """Counts of baskets (a and b null), items (b null) and pairs (a < b) under ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.path, self.buckets = spark, path, buckets
        self._jpath = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _bytes(self, path: str) -> int:
        return self._fs.getContentSummary(self._jpath(path)).getLength()

    def _manifests(self) -> list[int]:
        """The numbers of the manifests there are, in order."""
        if not self._fs.exists(self._jpath(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._jpath(self.path))]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def _manifest(self) -> dict:
        """The state of the highest number: generation, number of buckets, generation of each bucket's files."""
        numbers = self._manifests()
        if not numbers:
            return {"generation": 0, "n": self.buckets, "buckets": {}}
        return json.loads(self.spark.read.text(f"{self.path}/manifest-{numbers[-1]:09d}.json", wholetext=True).first()[0])

    def _read(self, buckets: dict[str, int]) -> DataFrame:
        if not buckets:
            return self.spark.createDataFrame([], "a string, b string, n long")
        return self.spark.read.schema("a string, b string, n long").option("basePath", self.path).parquet(*(f"{self.path}/gen={g}/bucket={b}" for b, g in buckets.items())).select("a", "b", "n")

    def counts(self) -> DataFrame:
        """a, b, n of the whole table."""
        return self._read(self._manifest()["buckets"])

    def deltas(self, changes: DataFrame) -> DataFrame:
        """a, b, n: the signed deltas of changes (before, after: item sets, null or empty for none).

        Each basket set emits its pairs item by item, so nothing of the size of
        its square is held at once.
        """
        sets = (
            changes.select(F.explode(F.array(F.struct(item_set("before").alias("s"), F.lit(-1).alias("n")), F.struct(item_set("after").alias("s"), F.lit(1).alias("n")))).alias("x"))
            .select("x.*")
            .where(F.size("s") > 0)
            .groupBy("s")
            .agg(F.sum("n").alias("n"))
            .where("n <> 0")
        )
        single = sets.select("n", F.posexplode("s").alias("i", "a"), "s").select("n", "a", F.slice("s", F.col("i") + 2, F.size("s")).alias("rest"))
        baskets = sets.groupBy().agg(F.sum("n").alias("n")).where("n is not null").select(F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"), "n")
        pairs = single.select("n", "a", F.explode(F.concat(F.expr("cast(array(null) as array<string>)"), "rest")).alias("b"))
        both = pairs.groupBy("a", "b").agg(F.sum("n").alias("n")).unionByName(baskets)
        return both.where("n <> 0").select("a", "b", "n")

    def merge(self, changes: DataFrame) -> DataFrame:
        """Apply the changes; returns the applied deltas (a, b, n)."""
        state = self._manifest()
        gen = state["generation"] + 1
        fresh = f"{self.path}/delta={gen}"
        self.deltas(changes).write.mode("overwrite").parquet(fresh)
        delta = self.spark.read.schema("a string, b string, n long").parquet(fresh)
        size = self._bytes(fresh) + sum(self._bytes(f"{self.path}/gen={g}/bucket={b}") for b, g in state["buckets"].items())
        n = state["n"]
        while n * FILE_BYTES < size:
            n *= 2
        number = F.pmod(F.xxhash64("a", "b"), F.lit(n)).cast("int")
        if n == state["n"]:
            touched = {str(r[0]) for r in delta.select(number).distinct().collect()}  # at most n numbers
        else:  # more buckets: every row finds its new place
            touched = set(state["buckets"]) | {str(b) for b in range(n)}
        if touched:
            old = self._read({b: g for b, g in state["buckets"].items() if b in touched})
            merged = old.unionByName(delta).groupBy("a", "b").agg(F.sum("n").alias("n")).where("n <> 0").withColumn("bucket", number)
            # a bucket's file is split once it would grow beyond FILE_BYTES, so no task holds a whole large bucket
            split = 1 + size // (n * FILE_BYTES)
            merged.repartition("bucket", F.pmod(F.xxhash64("b", "a"), F.lit(split))).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/gen={gen}")
            there = {s.getPath().getName().partition("=")[2] for s in self._fs.listStatus(self._jpath(f"{self.path}/gen={gen}")) if s.getPath().getName().startswith("bucket=")}
            state["buckets"] = {b: g for b, g in state["buckets"].items() if b not in touched} | {b: gen for b in there}
        state |= {"generation": gen, "n": n}
        self._commit(state)
        self._clean(state)
        return delta

    def _commit(self, state: dict) -> None:
        """Write the manifest beside the older ones; it counts from the rename on."""
        new, at = self._jpath(f"{self.path}/manifest.new"), self._jpath(f"{self.path}/manifest-{state['generation']:09d}.json")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self._fs.rename(new, at):
            raise OSError(f"generation {state['generation']} is there already")

    def _clean(self, state: dict) -> None:
        """Delete what neither this state nor the one before needs; readers of the state before may still be at work."""
        numbers = self._manifests()
        for number in numbers[:-2]:
            self._fs.delete(self._jpath(f"{self.path}/manifest-{number:09d}.json"), False)
        before = json.loads(self.spark.read.text(f"{self.path}/manifest-{numbers[-2]:09d}.json", wholetext=True).first()[0])["buckets"] if len(numbers) > 1 else {}
        needed = set(state["buckets"].items()) | set(before.items())
        for s in self._fs.listStatus(self._jpath(self.path)):
            kind, _, gen = s.getPath().getName().partition("=")
            if kind == "delta" and int(gen) < state["generation"] - 1:
                self._fs.delete(s.getPath(), True)
            elif kind == "gen":
                for b in self._fs.listStatus(s.getPath()):
                    if b.getPath().getName().startswith("bucket=") and (b.getPath().getName()[7:], int(gen)) not in needed:
                        self._fs.delete(b.getPath(), True)

    def scores(self, changed: DataFrame | None = None) -> DataFrame:
        """a, b, n_ab, n_a, n_b, n, lift, npmi of every pair; with ``changed`` deltas only of pairs they affect.

        The number of baskets is part of every score, so where it changed, all are affected.

        Joins are left to Catalyst: the items are broadcast only where their size
        allows it, and shuffled otherwise.
        """
        counts = self.counts()
        items = counts.where("a is not null and b is null").select(F.col("a").alias("item"), F.col("n").alias("m"))
        total = counts.where("a is null and b is null").agg(F.max("n").alias("n"))
        pairs = counts.where("b is not null").withColumnRenamed("n", "n_ab")
        if changed is not None and changed.where("a is null").isEmpty():
            hit = changed.where("a is not null").select(F.col("a").alias("x")).distinct()
            pairs = pairs.join(hit, pairs.a == hit.x, "left_semi").unionByName(pairs.join(hit, pairs.b == hit.x, "left_semi")).distinct()
        n = F.col("n").cast("double")
        lift = F.col("n_ab") * n / (F.col("n_a") * F.col("n_b").cast("double"))
        return (
            pairs.join(items.select(F.col("item").alias("a"), F.col("m").alias("n_a")), "a")
            .join(items.select(F.col("item").alias("b"), F.col("m").alias("n_b")), "b")
            .withColumn("n", F.lit(total.first()[0]).cast("long"))
            .withColumn("lift", lift)
            .withColumn("npmi", F.when(F.col("n_ab") == F.col("n"), F.lit(1.0)).otherwise(F.log("lift") / -F.log(F.col("n_ab") / n)))
            .select("a", "b", "n_ab", "n_a", "n_b", "n", "lift", "npmi")
        )

    def rescore(self, old: DataFrame, changed: DataFrame) -> DataFrame:
        """The scores after a merge: old scores, with those the ``changed`` deltas affect computed again."""
        if not changed.where("a is null").isEmpty():
            return self.scores(changed)
        hit = changed.where("a is not null").select(F.col("a").alias("x")).distinct()
        kept = old.join(hit, old.a == hit.x, "left_anti").join(hit, old.b == hit.x, "left_anti")
        return kept.unionByName(self.scores(changed))
