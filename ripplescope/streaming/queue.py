"""The queue of classes to measure again, kept so that a crash loses and repeats nothing it needn't."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.order import numbered
from ..sources.shared import Snapshots

#: ``seq`` orders what is queued; ``flying`` is being measured; a row that is tried only has no ``seq``.
SHAPE = "class_fqn string, seq long, flying boolean, tried boolean"


class RefreshQueue:
    """First in, first out, below one path; every step is one save of its table.

    ``drain`` takes the first classes, has them measured, and takes them out. When the
    queue is empty it is filled with the classes whose measuring would tell most,
    each once in a drain. An abort puts what was being measured back at the end, as
    does a start after a crash.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.store = Snapshots(spark, path, StructType.fromDDL(SHAPE))

    def queued(self) -> DataFrame:
        return self.store.load().where("seq is not null")

    def _appended(self, rows: DataFrame, more: DataFrame, *order) -> DataFrame:
        """``rows`` with the classes ``more(class_fqn, tried, ...)`` behind the last, in order."""
        last = rows.agg(F.max("seq")).head()[0]
        begin = 0 if last is None else last + 1
        placed = numbered(more, *order, name="_n").select("class_fqn", (F.col("_n") + begin).alias("seq"), F.lit(False).alias("flying"), "tried")
        return rows.unionByName(placed)

    def add(self, classes: DataFrame) -> None:
        """Queues ``classes(class_fqn, seq)`` that aren't queued, in the order of ``seq``."""
        rows = self.store.load()
        new = classes.groupBy("class_fqn").agg(F.min("seq").alias("s")).join(rows.where("seq is not null").select("class_fqn"), "class_fqn", "left_anti")
        new = new.join(rows.where("seq is null").select("class_fqn", "tried"), "class_fqn", "left").withColumn("tried", F.coalesce("tried", F.lit(False)))
        kept = rows.join(new.select("class_fqn"), "class_fqn", "left_anti")
        self.store.save(self._appended(kept, new, "s", "class_fqn").select("class_fqn", "seq", "flying", "tried"))

    def take(self, most: int) -> DataFrame:
        """Marks the first ``most`` classes as being measured; ``(class_fqn, seq)``."""
        rows = self.store.load()
        first = rows.where("seq is not null and not flying").orderBy("seq").limit(most).agg(F.max("seq")).head()[0]  # top-k
        self.store.save(rows.withColumn("flying", F.coalesce(F.col("flying") | (F.col("seq") <= F.lit(first)), F.lit(False))))
        return self.store.load().where("flying").select("class_fqn", "seq")

    def finish(self) -> None:
        """Takes out what was being measured; what was tried in this drain stays marked."""
        rows = self.store.load()
        self.store.save(rows.where("not flying or tried").withColumn("seq", F.when(~F.col("flying"), F.col("seq"))).withColumn("flying", F.lit(False)))

    def requeue(self) -> None:
        """Puts what was being measured back at the end, in its order."""
        rows = self.store.load()
        back = rows.where("flying")
        if not back.isEmpty():
            self.store.save(self._appended(rows.where("not flying"), back.select("class_fqn", "tried", F.col("seq").alias("s")), "s"))

    def replenish(self, targets: DataFrame) -> None:
        """Queues ``targets(class_fqn, score)`` that weren't tried in this drain, the highest score first."""
        rows = self.store.load()
        new = targets.select("class_fqn", (-F.col("score")).alias("s"), F.lit(True).alias("tried")).join(rows.where("tried or seq is not null").select("class_fqn"), "class_fqn", "left_anti")
        self.store.save(self._appended(rows, new, "s", "class_fqn"))

    def drain(self, measure: Callable[[DataFrame], bool], targets: Callable[[DataFrame], DataFrame] | None = None, each: int = 64, stop: Callable[[], bool] = lambda: False) -> int:
        """Measures until nothing is queued, ``stop`` says so, or ``measure(classes)`` is aborted and returns False; the number of batches that were measured.

        ``targets(tried)`` gives scored classes, of which those that were tried are left
        out. ``measure`` can come twice with the same classes if a crash falls between
        its end and the save after it.
        """
        self.requeue()
        done = 0
        while not stop():
            if self.queued().isEmpty() and targets is not None:
                self.replenish(targets(self.store.load().where("tried").select("class_fqn")))
            if self.queued().isEmpty():
                self.store.save(self.store.load().limit(0))  # the drain is over, and nothing counts as tried
                break
            if not measure(self.take(each)):
                self.requeue()
                break
            self.finish()
            done += 1
        return done
