"""Structured Streaming jobs over growing tables, each runnable to the end of what is there and resumed where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliomill.session import Shelf

#: Batches whose deltas are read one by one before they are merged into a base.
COMPACT = 16


def follow(spark: SparkSession, path: str) -> DataFrame:
    """A table of Parquet files as a stream; new files are picked up as they arrive."""
    schema = spark.read.parquet(path).schema
    # a single file is followed through its folder
    if path.endswith(".parquet") and _is_file(spark, path):
        folder, _, name = path.rpartition("/")
        return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return spark.readStream.schema(schema).parquet(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


class Ledger:
    """What a stream has added up so far, under ``place``: a base through some batch and a delta per later batch.

    A batch writes only its own delta, under its number, so a batch that is run
    again replaces what it wrote.  Reading merges base and deltas; every COMPACT
    batches they become a new base, which counts once it is whole.  All is found
    again from the folder, so the next start goes on from there.
    """

    def __init__(self, spark: SparkSession, place: str, schema: StructType, merge: Callable[[DataFrame], DataFrame]):
        self.spark, self.place, self.schema, self.merge = spark, place, schema, merge
        self._jpath = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(place).getFileSystem(spark._jsc.hadoopConfiguration())

    def _whole(self, kind: str) -> list[int]:
        """The numbers of the complete tables of a kind, in order."""
        if not self._fs.exists(self._jpath(f"{self.place}/{kind}")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._jpath(f"{self.place}/{kind}"))]
        return sorted(int(n) for n in names if n.isdigit() and self._fs.exists(self._jpath(f"{self.place}/{kind}/{n}/_SUCCESS")))

    def read(self, through: int | None = None) -> DataFrame:
        """All that was added (up to a batch), merged."""
        bases = [b for b in self._whole("base") if through is None or b <= through]
        base = bases[-1] if bases else -1
        paths = [f"{self.place}/base/{base}"] * bool(bases) + [f"{self.place}/delta/{n}" for n in self._whole("delta") if n > base and (through is None or n <= through)]
        return self.merge(self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema))

    def add(self, rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.place}/delta/{number}")
        bases = self._whole("base")
        if number - (bases[-1] if bases else -1) >= COMPACT:
            self.read(number).write.mode("overwrite").parquet(f"{self.place}/base/{number}")
            # a reader may still be at the base before: its tables stay until the next one
            for kind, last in (("base", bases[-1] if bases else -1), ("delta", bases[-1] + 1 if bases else 0)):
                for n in self._whole(kind):
                    if n < last:
                        self._fs.delete(self._jpath(f"{self.place}/{kind}/{n}"), True)


def _until_caught_up(stream: DataFrame, place: str, each: Callable[[DataFrame, int], None]) -> None:
    query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{place}/progress").trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


def usage_windows(spark: SparkSession, path: str, place: str | None = None, length: str = "1 hour") -> DataFrame:
    """window_start, kind, n, total: events per hour and kind, of all events so far, however late they come.

    place is where the job keeps its progress and sums: called again with it, the
    job reads only what has arrived since.  Without one it starts anew.  A batch
    adds up its own events and writes a row per window and kind; total leaves
    null values out and is null where there is no other.
    """
    place = place or Shelf(spark, "usage").root
    rows = follow(spark, path).select(F.window(F.col("ts").cast("timestamp"), length)["start"].alias("window_start"), F.col("event_type").alias("kind"), F.floor(F.col("value") * 100 + 0.5).cast("long").alias("total"))
    rows = rows.where("window_start is not null").select("window_start", "kind", F.lit(1).cast("long").alias("n"), "total")

    def merge(x: DataFrame) -> DataFrame:
        return x.groupBy("window_start", "kind").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))

    ledger = Ledger(spark, place, rows.schema, merge)
    _until_caught_up(rows, place, lambda batch, number: ledger.add(merge(batch), number))
    return ledger.read()


def latest_states(spark: SparkSession, path: str, key: str, order: list[str], keep: list[str], place: str | None = None) -> DataFrame:
    """key and keep of each key's row with the greatest order values, from a stream of updates in any order.

    place is where the job keeps its progress and the newest rows, as in
    ``usage_windows``.  A batch writes its own newest row per key.
    """
    place = place or Shelf(spark, "states").root
    rows = follow(spark, path).where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.struct(*order).alias("at"), F.struct(*keep).alias("v"))

    def merge(x: DataFrame) -> DataFrame:
        return x.groupBy("key").agg(F.max("at").alias("at"), F.max_by("v", "at").alias("v"))

    ledger = Ledger(spark, place, rows.schema, merge)
    _until_caught_up(rows, place, lambda batch, number: ledger.add(merge(batch), number))
    return ledger.read().select("key", "v.*")
