"""Change events in bursts: batch forms over event tables, and a streaming one.

The batch forms are keyed, so that one busy key doesn't hold up others; a single
global key is a constant key column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import numbered
from ..sources.shared import Snapshots


def debounced(events: DataFrame, gap_us: int, key: str = "key") -> DataFrame:
    """``events(key, us, seq, file)`` with ``batch``: an event ``gap_us`` or more after the last one begins a batch."""
    w = Window.partitionBy(key).orderBy("us", "seq")
    begins = F.when(F.col("us") - F.lag("us").over(w) < gap_us, 0).otherwise(1)
    return events.withColumn("_b", begins).withColumn("batch", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_b")


def batches(events: DataFrame, gap_us: int, key: str = "key") -> DataFrame:
    """``(key, batch, n_files, n_events, due_us)`` of the bursts."""
    return debounced(events, gap_us, key).groupBy(key, "batch").agg(F.count_distinct("file").alias("n_files"), F.count("*").alias("n_events"), (F.max("us") + gap_us).alias("due_us"))


def flushed(events: DataFrame, gap_us: int, key: str = "key") -> DataFrame:
    """Like ``debounced``, with events of kind ``batch`` that end a burst at once."""
    w = Window.partitionBy(key).orderBy("us", "seq")
    begins = F.when((F.lag("kind").over(w) == "batch") | (F.col("us") - F.lag("us").over(w) >= gap_us) | F.lag("us").over(w).isNull(), 1).otherwise(0)
    return events.withColumn("_b", begins).withColumn("batch", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_b")


def change_verdicts(events: DataFrame, window_us: int, watched: str = "watched", dirty: str = "dirty") -> DataFrame:
    """Changes of ``events(key, file, us, seq, kind, watched, dirty)`` with ``verdict``.

    In this order: not a source, saved in the last ``window_us`` (the bound
    included), open with changes in an editor, else queued.
    """
    w = Window.partitionBy("key", "file").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, -1)
    saved = F.last(F.when(F.col("kind") == "save", F.col("us")), ignorenulls=True).over(w)
    verdict = F.when(~F.col(watched), "not-source").when(F.col("us") - F.col("_s") <= window_us, "recent-save").when(F.col(dirty), "dirty-editor").otherwise("queued")
    return events.withColumn("_s", saved).where("kind = 'change'").withColumn("verdict", verdict).drop("_s")


def paused(events: DataFrame, key: str = "key") -> DataFrame:
    """``(key, flush, us, n_files, everything)``: what resuming sets free, by pause.

    ``events(key, us, seq, kind, file)`` of kinds change, all, pause and resume. The
    state begins as on; a pause while paused and a resume while on change nothing.
    Changes from a pause to its resume are held and come at once; a request for
    everything swallows the files. With a column ``aborted``, the files of the run
    that a pause aborts are held with them; an empty list was a run of everything.
    """
    w = Window.partitionBy(key).orderBy("us", "seq")
    turn = F.when(F.col("kind").isin("pause", "resume"), F.col("kind"))
    state = lambda until: F.coalesce(F.last(turn, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, until)), F.lit("resume"))
    marked = events.withColumn("_now", state(0)).withColumn("_was", state(-1))
    stops = (F.col("kind") == "pause") & (F.col("_was") == "resume")
    marked = marked.withColumn("flush", F.sum(F.when(stops, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    held = marked.where("_now = 'pause' and kind in ('change', 'all')").select(key, "flush", "kind", "file")
    if "aborted" in events.columns:
        run = marked.where(stops & F.col("aborted").isNotNull())
        held = held.union(run.select(key, "flush", F.lit("change"), F.explode("aborted"))).union(run.where(F.size("aborted") == 0).select(key, "flush", F.lit("all"), F.lit(None).cast(events.schema["file"].dataType)))
    held = held.groupBy(key, "flush").agg(F.count_distinct(F.when(F.col("kind") == "change", F.col("file"))).alias("n"), F.bool_or(F.col("kind") == "all").alias("everything"))
    ends = marked.where("kind = 'resume' and _was = 'pause'").select(key, "flush", "us")
    return held.join(ends, [key, "flush"]).select(key, "flush", "us", F.when(F.col("everything"), 0).otherwise(F.col("n")).alias("n_files"), "everything")


def remembered_saves(saves: DataFrame, now_us: int, window_us: int, most: int = 4096) -> DataFrame:
    """``saves(file, us)``, each file's last one; beyond ``most`` files, those older than ten windows go."""
    last = saves.groupBy("file").agg(F.max("us").alias("us"))
    total = last.agg(F.count("*").alias("_n"))  # one row
    return last.join(F.broadcast(total), F.expr(f"_n <= {most} or us >= {now_us - 10 * window_us}")).select("file", "us")


def superseded(active: DataFrame, new: DataFrame) -> DataFrame:
    """Files of a run that takes over from an active one."""
    return active.select("file").union(new.select("file")).distinct()


def finished_runs(messages: DataFrame) -> DataFrame:
    """``(run, n)`` of ``messages(run, changes)``: changes of runs whose end (null changes) has come."""
    each = messages.groupBy("run").agg(F.bool_or(F.col("changes").isNull()).alias("done"), F.sum(F.size(F.coalesce("changes", F.array().cast("array<string>")))).alias("n"))
    return each.where("done").select("run", "n")


def refresh_order(queue: DataFrame, targets: DataFrame, tried: DataFrame) -> DataFrame:
    """``(class_fqn, place)``: queued classes first in, first out, then scored targets; none twice, none that was tried."""
    both = queue.select("class_fqn", F.lit(0).alias("tier"), F.col("seq").alias("rank")).union(targets.select("class_fqn", F.lit(1), -F.col("score")))
    once = both.groupBy("class_fqn").agg(F.min(F.struct("tier", "rank")).alias("p")).join(tried.select("class_fqn"), "class_fqn", "left_anti")
    return numbered(once, "p", "class_fqn").select("class_fqn", (F.col("place") + 1).alias("place"))


def stream_debounced(events: DataFrame, gap_ms: int) -> DataFrame:
    """Streaming form: ``events(key, file)`` give ``(key, files)`` once no event has come for ``gap_ms`` of processing time.

    State is the set of pending files of a key; a timer that every event restarts
    flushes it.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        files = set(state.get[0]) if state.exists else set()
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "files": [sorted(files)]})
            return
        for frame in frames:
            files.update(frame["file"].dropna())
        state.update((sorted(files),))
        state.setTimeoutDuration(gap_ms)

    return events.groupBy("key").applyInPandasWithState(step, "key string, files array<string>", "files array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def commit_snapshots(store: Snapshots, source: DataFrame, run: Callable[[DataFrame], None], stream: str = "snapshots"):
    """A writer of ``source(file, fp, seq)`` whose batches are snapshots: ``run(changes)`` sees what changed since the stored fingerprints, which move on only if it succeeds.

    A batch that is tried again is left alone if it was committed; if only ``run`` had
    ended, its fingerprints are saved and ``run`` isn't called again. ``stream`` is
    the name of the checkpoint that numbers the batches.
    """
    from ..operators.selection import snapshot_diff

    def each(batch: DataFrame, number: int) -> None:
        if number <= store.committed(stream):
            return
        after = batch.groupBy("file").agg(F.max_by("fp", "seq").alias("fp"))
        before = store.load()
        store.once(stream, number, "run", lambda: run(snapshot_diff(before, after, before.isEmpty())))
        store.save(after, stream, number)

    return source.writeStream.foreachBatch(each)


def commit_diagnostics(store: Snapshots, source: DataFrame, stream: str = "diagnostics"):
    """A writer of ``source(project, seq, kind, items)``: in the stored ``(project, item)``, a batch replaces the items of each project that it has an event of by those of the last one; a clear leaves none. Once for each batch."""

    def each(batch: DataFrame, number: int) -> None:
        if number > store.committed(stream):
            rest = store.load().join(batch.select("project").distinct(), "project", "left_anti")
            store.save(rest.unionByName(latest_diagnostics(batch)), stream, number)

    return source.writeStream.foreachBatch(each)


def latest_diagnostics(events: DataFrame) -> DataFrame:
    """Of ``events(project, seq, kind, items)``, the items of each project's last event; a clear leaves none."""
    last = events.groupBy("project").agg(F.max_by(F.struct("kind", "items"), "seq").alias("e"))
    return last.where("e.kind = 'set'").select("project", F.explode("e.items").alias("item"))
