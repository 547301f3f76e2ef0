"""Live runs and verdicts: rules, a model, and streams that give what batches give."""

import random

import pytest

from ripplescope.streaming import batching, live

GAP = 300_000


def model(events, gap=GAP):
    """One key after the other, event by event."""
    out, keys = [], {}
    for key, us, seq, kind, file, aborted in sorted(events, key=lambda e: (e[1], e[2])):
        s = keys.setdefault(key, {"on": True, "due": None, "pending": set(), "all": False})

        def run(at, s=s, key=key):
            out.append((key, at, [] if s["all"] else sorted(s["pending"]), s["all"]))
            s.update(due=None, pending=set(), all=False)

        if s["due"] is not None and us >= s["due"]:
            run(s["due"])
        if kind in ("save", "change"):
            s["pending"].add(file)
        if kind == "save" and s["on"]:
            s["due"] = us + gap
        elif kind == "change" and s["on"]:
            run(us)
        elif kind == "pause" and s["on"]:
            s.update(on=False, due=None, all=aborted == [], pending=s["pending"] | set(aborted or []))
        elif kind == "resume" and not s["on"]:
            s["on"] = True
            if s["all"] or s["pending"]:
                run(us)
    out += [(key, s["due"], sorted(s["pending"]), False) for key, s in keys.items() if s["due"] is not None]
    return sorted(out)


def made(seed, n=240, keys=5):
    rng = random.Random(seed)
    rows, us = [], 0
    for seq in range(n):
        us += rng.choice([0, 50_000, 100_000, GAP // 2, GAP, 700_000])
        kind = rng.choice(["save", "save", "save", "change", "pause", "resume"])
        file = f"f{rng.randrange(6)}" if kind in ("save", "change") else None
        rows.append((f"k{rng.randrange(keys)}", us, seq, kind, file, rng.choice([None, [], ["x", "f1"]]) if kind == "pause" else None))
    return rows


def found(df):
    return sorted((r["key"], r["us"], list(r["files"]), r["everything"]) for r in df.collect())


@pytest.mark.parametrize(
    ("events", "want"),
    [
        ([(0, "save", "a"), (100, "save", "b"), (200, "save", "a")], [(500, ["a", "b"], False)]),
        ([(0, "save", "a"), (300, "save", "b")], [(300, ["a"], False), (600, ["b"], False)]),  # an event at the very end of the wait
        ([(0, "change", "x"), (0, "change", "y")], [(0, ["x"], False), (0, ["y"], False)]),
        ([(0, "save", "a"), (100, "change", "x")], [(100, ["a", "x"], False)]),
        ([(0, "save", "a"), (100, "pause", ["r"]), (900, "save", "b"), (950, "change", "c"), (2000, "resume", None)], [(2000, ["a", "b", "c", "r"], False)]),  # still waiting when the pause comes
        ([(0, "save", "a"), (300, "pause", None), (400, "resume", None)], [(300, ["a"], False)]),
        ([(0, "pause", None), (100, "resume", None)], []),
        ([(0, "pause", []), (50, "save", "a"), (100, "resume", None)], [(100, [], True)]),
        ([(0, "pause", ["a"]), (10, "pause", ["z"]), (20, "resume", None), (30, "resume", None)], [(20, ["a"], False)]),
        ([(0, "save", "a"), (10, "resume", None)], [(300, ["a"], False)]),
    ],
)
def test_rules(spark, events, want):
    rows = [("k", us * 1000, i, kind, x if kind in ("save", "change") else None, x if kind == "pause" else None) for i, (us, kind, x) in enumerate(events)]
    want = [("k", us * 1000, files, everything) for us, files, everything in want]
    assert model(rows) == want
    assert found(live.live_runs(spark.createDataFrame(rows, live.EVENT), GAP)) == want


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_batch_is_the_model(spark, seed):
    rows = made(seed)
    assert found(live.live_runs(spark.createDataFrame(rows, live.EVENT).repartition(3), GAP)) == model(rows)


def test_stream_is_the_batch(spark):
    """In four parts, with a restart between each; saves that wait, and pauses, go over them."""
    rows = made(9, 160)
    events = spark.createDataFrame(rows, live.EVENT)
    assert found(live.replayed(events, lambda s: live.stream_live_runs(s, GAP), live.RUN, slices=4, rest_us=GAP)) == model(rows)


def test_an_empty_table(spark):
    none = spark.createDataFrame([], live.EVENT)
    assert live.live_runs(none, GAP).count() == 0
    assert live.replayed(none, lambda s: live.stream_live_runs(s, GAP), live.RUN).count() == 0


def test_streamed_verdicts(spark):
    """The batch's verdicts, with a state that stays small however many files are saved."""
    rng = random.Random(3)
    rows, us = [], 0
    for seq in range(600):
        us += rng.choice([1000, 40_000, 100_000])
        rows.append((f"k{rng.randrange(2)}", f"f{rng.randrange(8) if rng.random() < 0.5 else seq}", us, seq, rng.choice(["save", "change"]), rng.random() < 0.9, rng.random() < 0.2))
    shape = "key string, file string, us long, seq long, kind string, watched boolean, dirty boolean"
    events, window, sizes = spark.createDataFrame(rows, shape), 200_000, []
    watch = lambda q: sizes.extend(o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"])
    got = live.replayed(events, lambda s: live.stream_change_verdicts(s, window, most=20), live.VERDICT, slices=4, rest_us=12 * window, watch=watch)
    want = batching.change_verdicts(events, window)
    told = lambda df: sorted((r["seq"], r["verdict"]) for r in df.collect())
    assert told(got) == told(want)
    assert {v for _, v in told(got)} == {"queued", "recent-save", "dirty-editor", "not-source"}
    # two keys: 20 files, those of ten windows at most, sizes and timers
    assert max(sizes) <= 2 * (20 + 10 * window // 1000 // 10) and sizes[-1] <= 4
