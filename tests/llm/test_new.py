"""Fill-in-middle, centroid clustering and multi-index search against brute-force versions."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from ripplescope.llm import centroids, middles, multiindex

DOCS = "doc_id long, text string, units string, n string, h1 int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def cut(doc_id, text):
    """The contract, spelt out."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def texts():
    rng = random.Random(5)
    made = [None, "", "a", "\n", "two words", "<P>", "x<S>y", "<M", "P>", "<<S", "S>< M>", "<p>", "\U0001d518éé 你好 a\U0001f600b", "\x00\x01", "line\r\nline ", "a" * 50_000, "1 " * 40_000]
    return made + ["".join(rng.choice("ab<>PSM \n1é\U0001f600") for _ in range(rng.randrange(60))) for _ in range(300)]


def test_middles(spark, tmp_path):
    rows = [(None if i == 3 else i, t) for i, t in enumerate(texts())] * 2
    docs = spark.createDataFrame([(i, t, "u", "n", 1) for i, t in rows], DOCS)
    found = middles.arranged(docs).select("*", middles.restored(middles.F.col("output"), middles.F.col("form")).alias("back")).collect()
    size = lambda x: None if x is None else len(x)
    got = sorted(((r["doc_id"], r["text"], r["n"], r["form"], size(r["prefix"]), size(r["middle"]), r["output"], r["back"]) for r in found), key=str)
    want = sorted(((i, t or "", *cut(i, t), t or "") for i, t in rows), key=str)
    assert got == want
    assert {"plain", "psm", "spm"} == {r["form"] for r in found}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    told = middles.op12_fill_in_middle(spark, str(tmp_path)).collect()
    digests = sorted(((i, *cut(i, t)[:4], sha(cut(i, t)[4]), sha(t or "")) for i, t in rows), key=str)
    assert sorted((tuple(r) for r in told), key=str) == digests
    assert middles.arranged(docs.limit(0)).count() == 0


def test_middles_stay_in_the_jvm(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = middles.arranged(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and plan.count("regexp_extract_all") == 1


def model(rows, clusters=16, rounds=3, size=64):
    kept = [(i, [math.floor(64 * float(np.float64(x))) for x in e]) for i, e in rows if e is not None and len(e) == size and all(x is not None and math.isfinite(x) for x in e)]
    now = [v for _, v in sorted(kept, key=lambda r: (sha(f"1:{'' if r[0] is None else r[0]}"), r[1]))[:clusters]]

    def place():
        far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
        return [min((far(v, c), k) for k, c in enumerate(now)) for _, v in kept]

    for _ in range(rounds):
        label = place()
        for k in range(len(now)):
            own = [v for (_, v), (_, j) in zip(kept, label, strict=True) if j == k]
            if own:
                now[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    label = place()
    inertia = [sum(d for d, j in label if j == k) for k in range(len(now))]
    return sorted([(i, j, d, inertia[j], sum(inertia), sha(",".join(map(str, now[j])))) for (i, _), (d, j) in zip(kept, label, strict=True)], key=str)


def vectors(seed, n, size=64, spread=1.0, kinds=40):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(kinds, size)) * spread
    rows = [(int(i), [float(np.float32(x)) for x in base[rng.integers(kinds)] + rng.normal(size=size) * 0.1 * spread]) for i in range(n)]
    bad = [(n, None), (n + 1, []), (n + 2, [0.5] * (size - 1)), (n + 3, [None] + [0.5] * (size - 1)), (n + 4, [float("nan")] * size), (n + 5, [float("inf")] * size), (None, rows[3][1]), rows[5], rows[5], (7, rows[8][1]), (n + 6, [0.0] * size), (n + 7, [-0.0] * size)]
    return rows + bad


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 3, "x", 0) for i, e in rows], "vec_id long, embedding array<float>, label int, cluster string, v int")


@pytest.mark.parametrize("n", [300, 9, 0])
def test_centroids(spark, tmp_path, n):
    rows = vectors(n, n, spread=0.02 if n == 300 else 1.0) if n != 0 else []
    frame(spark, rows).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = centroids.op11_centroids(spark, str(tmp_path))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == model(rows)


def test_partial_distances_are_exact():
    rng = np.random.default_rng(3)
    for spread in (2, 5, 300, 2**26):
        x, c = rng.integers(-spread, spread, (500, 64)), rng.integers(-spread, spread, (16, 64))
        c[9], x[0] = c[2], c[9]  # equal centroids
        whole = ((x[:, None] - c[None]) ** 2).sum(2)
        label, best = centroids.nearest(x, c, rng.permutation(64))
        assert (label == whole.argmin(1)).all() and (best == whole.min(1)).all()


def test_centroids_overflow(spark):
    with pytest.raises(Exception, match="exact squared distance"):
        centroids.clustered(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>"))[0].collect()


def brute(rows, every=50, nearest=5):
    """All rows against all queries, with sets of equal rows."""
    fine = sorted({(i, tuple(x + 0.0 for x in e)) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)})
    out = {}
    for i, e in fine:
        if i % every:
            continue
        told = [(-sum(a * b for a, b in zip(e, f, strict=True)) / math.sqrt(sum(a * a for a in e)) / math.sqrt(sum(b * b for b in f)), j) for j, f in fine if j != i and len(f) == len(e)]
        out.setdefault(i, []).append([(j, -s) for s, j in sorted((round(s, 12), j) for s, j in told)[:nearest]])
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_shard_finds_all_within_the_radius():
    rng = np.random.default_rng(8)
    code = rng.integers(0, 2**64, (700, 4), dtype=np.uint64)
    code[100:200] = code[0] ^ (np.uint64(1) << rng.integers(0, 64, (100, 4), dtype=np.uint64))
    asked, radius = np.concatenate((code[:40], rng.integers(0, 2**64, (20, 4), dtype=np.uint64))), rng.choice([0, 3, 15, 16, 40, 100, 117, 128, 256], 60)
    got = [(int(a), int(b)) for x, y in multiindex.Shard(code).within(asked, radius) for a, b in zip(x, y, strict=True)]
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(multiindex.apart(asked[:, None], code[None]) <= radius[:, None]), strict=True)}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding")
    rows = df.collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    length = np.sqrt((x * x).sum(1))
    got = answers(multiindex.nearest_vectors(df))
    assert sorted(got) == sorted(int(i) for i in ids if i % 50 == 0)
    hit = 0
    for i, told in got.items():
        at = int(np.flatnonzero(ids == i)[0])
        cosine = x @ x[at] / (length * length[at])
        cosine[at] = -2
        order = np.lexsort((ids, -cosine))[:5]
        hit += len({int(j) for j in ids[order]} & {j for j, _ in told})
        assert len(told) == 5
        for j, s in told:
            assert abs(s - cosine[ids == j][0]) < 1e-12
    assert hit / (5 * len(got)) >= 0.9


def test_small_tables_are_searched_whole(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "SHARD", 16)
    rng = np.random.default_rng(4)
    rows = vectors(1, 120, size=8, kinds=6) + [(i, [1.0, 2.0, 3.0]) for i in range(200, 230)] + [(300, [5.0]), (350, [2.0] * 9), (400, [0.0] * 8), (450, [float(np.float32(x)) for x in rng.normal(size=8)])]
    rows += [(50, rows[3][1]), (100, [1.0, 2.0, 3.0])]
    got, want = answers(multiindex.nearest_vectors(frame(spark, rows).repartition(3))), brute(rows)
    alone = {i for i, t in want.items() if not any(t)}
    assert alone == {300, 350} and set(got) == set(want) - alone
    for i, told in got.items():
        several = [x for x in want[i] if x]
        if len(several) == 1:  # an id that stands once
            assert [j for j, _ in told] == [j for j, _ in several[0]]
            assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(told, several[0], strict=True))
        else:
            assert sorted(j for j, _ in told) == sorted(j for x in several for j, _ in x)
    assert multiindex.nearest_vectors(frame(spark, [])).count() == 0
    assert multiindex.nearest_vectors(frame(spark, [(50, [1.0])])).count() == 0


def test_many_copies(spark):
    rng = np.random.default_rng(6)
    one = [float(x) for x in rng.normal(size=16)]
    rows = [(i, one) for i in range(400)] + [(1000 + i, [float(x) for x in rng.normal(size=16)]) for i in range(50)]
    got = answers(multiindex.nearest_vectors(frame(spark, rows)))
    assert [j for j, _ in got[0]] == [1, 2, 3, 4, 5] and [j for j, _ in got[50]] == [0, 1, 2, 3, 4]
    assert all(abs(s - 1) < 1e-12 for _, s in got[350])
