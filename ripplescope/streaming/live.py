"""Live runs of a workspace: saves, changes, pauses and resumes in one state machine, as a batch and as a stream.

Events are ``(key, us, seq, kind, file, aborted)`` of the kinds save, change, pause
and resume, ordered by ``us`` and ``seq`` within a key. The state begins as on.

A save waits for ``gap_us`` without another save, then everything that is pending
runs; an event at that very moment comes after the run. A change runs everything
that is pending at once. A pause stops the waiting, keeps what is pending and takes
up the files of the run that it aborts (``aborted``; empty: a run of everything, null:
none); saves and changes of a pause are kept, and its resume runs them at once. A run
of everything swallows the files. A pause while paused and a resume while on do nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.shared import shared_dir

EVENT = "key string, us long, seq long, kind string, file string, aborted array<string>"
RUN = "key string, us long, files array<string>, everything boolean"
VERDICT = "key string, seq long, verdict string"
#: Kind of an event that only moves the time on.
TICK = "tick"


def live_runs(events: DataFrame, gap_us: int) -> DataFrame:
    """``(key, us, files, everything)``: the runs, in one pass of windows over each key."""
    w = Window.partitionBy("key").orderBy("us", "seq")
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    turn = F.when(F.col("kind").isin("pause", "resume"), F.col("kind"))
    was = F.coalesce(F.last(turn, ignorenulls=True).over(before), F.lit("resume"))
    marked = events.withColumn("on", was == "resume").withColumn("turned", (F.col("kind") == "pause") & F.col("on") | (F.col("kind") == "resume") & ~F.col("on"))
    # What a waiting save can be followed by: another save, a change or a pause.
    follows = F.when(F.col("on") & (F.col("kind").isin("save", "change") | F.col("turned")), F.col("us"))
    following = F.first(follows, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    waits = F.col("on") & (F.col("kind") == "save") & F.coalesce(following >= F.col("us") + gap_us, F.lit(True))
    at = F.when(waits, F.col("us") + gap_us).when(F.col("on") & (F.col("kind") == "change"), F.col("us")).when(F.col("turned") & (F.col("kind") == "resume"), F.col("us"))
    marked = marked.withColumn("at", at).withColumn("run", F.coalesce(F.sum(F.when(F.col("at").isNotNull(), 1).otherwise(0)).over(before), F.lit(0)))
    stopped = F.when(F.col("turned") & (F.col("kind") == "pause"), F.col("aborted"))
    held = F.when(F.col("kind").isin("save", "change"), F.array("file")).otherwise(F.coalesce(stopped, F.array().cast("array<string>")))
    each = marked.groupBy("key", "run").agg(F.max("at").alias("us"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(held)))).alias("files"), F.coalesce(F.bool_or(F.size(stopped) == 0), F.lit(False)).alias("everything"))
    runs = each.where(F.col("us").isNotNull() & (F.col("everything") | (F.size("files") > 0)))
    return runs.select("key", "us", F.when(F.col("everything"), F.array().cast("array<string>")).otherwise(F.col("files")).alias("files"), "everything")


class _Live(StatefulProcessor):
    """A key's switch and time to run, and its pending files by the time they came.

    A batch reads a key's state once and writes it once, as each access is a round trip to the store.
    """

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.switch = handle.getValueState("switch", "on boolean, due long, everything boolean")
        self.pending = handle.getMapState("pending", "file string", "us long")

    def _wait(self, old: int | None, new: int | None) -> None:
        stamp = lambda due: -(-due // 1000)
        if old is not None and (new is None or stamp(old) != stamp(new)):
            self.handle.deleteTimer(stamp(old))
        if new is not None:
            self.handle.registerTimer(stamp(new))

    @staticmethod
    def _run(key: str, us: int, everything: bool, files: dict) -> tuple:
        told = key, us, [] if everything else sorted(files), everything
        files.clear()
        return told

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["us", "seq"], kind="stable")
        batch = batch[batch["kind"] != TICK]
        if not len(batch):
            return
        known = self.switch.exists()
        on, due, everything = self.switch.get() if known else (True, None, False)
        held = {k[0]: v[0] for k, v in self.pending.iterator()} if known else {}
        files, began, out = dict(held), due, []
        for us, kind, file, aborted in zip(batch["us"].astype("int64"), batch["kind"], batch["file"], batch["aborted"], strict=True):
            us = int(us)
            if due is not None and us >= due:
                out.append(self._run(key[0], due, False, files))
                due = None
            if kind in ("save", "change"):
                files[file] = us
            if kind == "save" and on:
                due = us + self.gap_us
            elif kind == "change" and on:
                out.append(self._run(key[0], us, False, files))
                due = None
            elif kind == "pause" and on:
                on, due = False, None
                everything = aborted is not None and len(aborted) == 0
                for f in aborted if aborted is not None else []:
                    files[f] = us
            elif kind == "resume" and not on:
                on = True
                if everything or files:
                    out.append(self._run(key[0], us, everything, files))
                everything = False
        if not files.keys() >= held.keys():
            self.pending.clear()
            held = {}
        for f, us in files.items():
            if held.get(f) != us:
                self.pending.updateValue((f,), (us,))
        self.switch.update((on, due, everything))
        if due != began:
            self._wait(began, due)
        if out:
            yield pd.DataFrame(out, columns=["key", "us", "files", "everything"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        on, due, everything = self.switch.get()
        if due is not None and due <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.switch.update((on, None, everything))
            run = self._run(key[0], due, False, {k[0]: v[0] for k, v in self.pending.iterator()})
            self.pending.clear()
            yield pd.DataFrame([run], columns=["key", "us", "files", "everything"])

    def close(self) -> None:
        pass


def _timed(events: DataFrame, lateness: str) -> DataFrame:
    return events.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", lateness)


def stream_live_runs(events: DataFrame, gap_us: int, lateness: str = "1 second") -> DataFrame:
    """The same rows from a stream of events. A save that waits runs as soon as the watermark has passed its time; what is pending or paused lives in the state store and outlasts a restart."""
    return _timed(events, lateness).groupBy("key").transformWithStateInPandas(_Live(gap_us), RUN, "append", "eventTime")


class _Verdicts(StatefulProcessor):
    """A key's last save of each file, for as long as an echo can come."""

    def __init__(self, window_us: int, most: int):
        self.window_us, self.most = window_us, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.saved = handle.getMapState("saved", "file string", "us long")
        self.size = handle.getValueState("size", "n long, sweep long")

    def _evict(self, before: int) -> int:
        held = [(k[0], v[0]) for k, v in self.saved.iterator()]
        for file, us in held:
            if us < before:
                self.saved.removeKey((file,))
        return sum(us >= before for _, us in held)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["us", "seq"], kind="stable")
        known = self.size.exists()
        n, sweep = self.size.get() if known else (0, None)
        out, seen, made = [], {}, {}  # each file is read at most once in a batch, and written once

        def last_save(file: str) -> int | None:
            if file not in seen:
                seen[file] = self.saved.getValue((file,))[0] if known and self.saved.containsKey((file,)) else None
            return seen[file]

        def write() -> None:
            for file, us in made.items():
                self.saved.updateValue((file,), (us,))
            made.clear()

        for us, seq, kind, file, watched, dirty in zip(batch["us"].astype("int64"), batch["seq"], batch["kind"], batch["file"], batch["watched"], batch["dirty"], strict=True):
            if kind == "save":
                n += last_save(file) is None
                seen[file] = made[file] = int(us)
                if n > self.most:
                    write()
                    n, known = self._evict(int(us) - 10 * self.window_us), True
                    seen.clear()
                if sweep is None:
                    sweep = int(us) + 10 * self.window_us
                    self.handle.registerTimer(-(-sweep // 1000))
            elif kind == "change":
                last = last_save(file) if watched else None
                echo = last is not None and us - last <= self.window_us
                out.append((key[0], seq, "not-source" if not watched else "recent-save" if echo else "dirty-editor" if dirty else "queued"))
        write()
        if sweep is not None:
            self.size.update((n, sweep))
        if out:
            yield pd.DataFrame(out, columns=["key", "seq", "verdict"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Saves of ten windows ago go; the rest is looked at again when the oldest is as old."""
        now = timerValues.getCurrentWatermarkInMs() * 1000
        n = self._evict(now - 10 * self.window_us)
        if n:
            sweep = min(v[0] for v in self.saved.values()) + 10 * self.window_us + 1000
            self.handle.registerTimer(-(-sweep // 1000))
            self.size.update((n, sweep))
        else:
            self.size.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_change_verdicts(events: DataFrame, window_us: int, most: int = 4096, lateness: str = "1 second") -> DataFrame:
    """``(key, seq, verdict)`` of the changes in a stream ``(key, file, us, seq, kind, watched, dirty)``, as ``change_verdicts`` has them.

    The state is a key's last save of each file. Beyond ``most`` files, those saved
    more than ten windows ago are dropped at once, and all such go when the watermark
    has passed that time, so that a key that rests keeps nothing. No verdict depends
    on what is dropped.
    """
    return _timed(events, lateness).groupBy("key").transformWithStateInPandas(_Verdicts(window_us, most), VERDICT, "append", "eventTime")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replayed(events: DataFrame, operator: Callable[[DataFrame], DataFrame], shape: str, slices: int = 2, rest_us: int = 0, watch: Callable | None = None) -> DataFrame:
    """What a streaming ``operator`` gives for a table of events, in order of ``us``.

    The table goes by in ``slices`` of time. For each, the stream is started, works on
    what is new and stops, so that all it knows between them is in its checkpoint.
    Then the time is moved on by ``rest_us`` and a little more, so that all timers
    have run. Everything lies in the shared folder. ``watch`` gets each query that ended.
    """
    spark = events.sparkSession
    base = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(base)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    lo, hi = events.agg(F.min("us"), F.max("us")).head()
    spark.createDataFrame([], shape).write.parquet(f"{base}/none")
    if lo is None:
        return spark.read.parquet(f"{base}/none")
    cuts = [lo + (hi - lo) * i // slices for i in range(slices)] + [hi + 1]
    few = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(8, spark.sparkContext.defaultParallelism))
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.shuffle.partitions": str(few)}  # a state store for each task at most
    former = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    tick = events.limit(0).unionByName(spark.createDataFrame([("", hi + rest_us + 5_000_000, 0, TICK)], "key string, us long, seq long, kind string"), allowMissingColumns=True)
    try:
        for i in range(slices + 1):
            part = events.where((F.col("us") >= cuts[i]) & (F.col("us") < cuts[i + 1])) if i < slices else tick
            part.write.mode("append").parquet(f"{base}/in")
            source = spark.readStream.schema(events.schema).parquet(f"{base}/in")
            query = operator(source).writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start(f"{base}/out")
            query.awaitTermination()
            if watch is not None:
                watch(query)
    finally:
        for k, v in former.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(shape).parquet(f"{base}/out")
