"""The pipeline's stages, one by one, against brute force."""

import collections
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ripplescope.llm import pieces, toxicity
from ripplescope.llm.common import stored
from ripplescope.llm.leaks import ANSWER, LOOSE, TIGHT, lcs

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(80)]


def rows():
    """Copies, near copies, nulls, empty and long texts, repeated rows, insults, secrets, a benchmark item."""
    base, item = " ".join(WORDS), "the copper lantern swung above nine quiet harbours while olga counted forty seven sleeping herons"
    out = [
        (1, base), (2, base), (2, base), (3, base + " tail"), (4, " ".join(WORDS[:40] + ["x"] * 3 + WORDS[40:])), (5, " ".join(WORDS[:40])), (6, None), (7, ""), (8, " \n\t"), (8, " \n\t"), (None, "alone without id"), (None, None),
        (9, "so " + item.upper() + ". and on"), (10, item.replace("quiet", "calm")), (11, "the quiet lantern"), (12, "password = hunter2xyz é😀 token: sharedvalue1"), (13, "token: sharedvalue1"), (14, "token: sharedvalue1"), (14, "token: sharedvalue1"),
        (15, "you worthless idiot"), (16, "what a pathetic moron you are"), (17, "long " + " ".join(f"l{i}" for i in range(40000))), (18, "river stone table"),
    ]
    return [(i, t, "en", f"s{k % 5}", len(t or "")) for k, (i, t) in enumerate(out)]


def frame(spark, some=None):
    """Columns that clash with those that the stages use."""
    made = spark.createDataFrame(rows() if some is None else some, COLUMNS)
    return made.withColumns({c: F.concat(F.lit("own"), F.coalesce("doc_id", F.lit(0))) for c in ("_k", "_live", "toxicity", "k", "component", "spans")})


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with labels and a benchmark."""
    where = str(tmp_path_factory.mktemp("tables"))
    rude, mild = ["idiot", "worthless", "pathetic", "moron"], ["river", "stone", "table", "garden", "w1", "w2", "lantern"]
    rng = np.random.default_rng(4)
    known = [(1000 + i, " ".join([*rng.choice(mild, 12), *([rng.choice(rude)] if i % 2 else [])])) for i in range(300)]
    spark.createDataFrame([(i, 1, i % 2) for i, _ in known] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, "the copper lantern swung above nine quiet harbours while olga counted forty seven sleeping herons"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, [(i, t, "en", "s", len(t)) for i, t in known]


def same(got, want):
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def full(spark, some, made):
    """The rows of ``some`` as the stage has them, with the clashing columns."""
    have = collections.defaultdict(list)
    for r in made.collect():
        have[r["doc_id"], r["text"]].append(tuple(r))
    return [have[i, t].pop() for i, t in some]


def test_toxicity(spark, tables):
    where, known = tables
    docs = frame(spark, rows() + known)
    model = toxicity.fit(docs, spark.read.parquet(f"{where}/labels.parquet"))

    def score(text):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
        if not words:
            return 0.0
        each = [model.word_scores([w])[0] for w in words]
        windows = [np.mean(each[i : i + toxicity.WINDOW]) for i in range(max(1, len(each) - toxicity.WINDOW + 1))]
        return 1 / (1 + np.exp(-(max(windows) + model.bias)))

    want = [(r[0], r[1]) for r in rows() + known if score(r[1]) < 0.5]
    got = corpus_pipeline.toxicity(spark, docs, where)
    assert got.columns == docs.columns
    same(got.collect(), full(spark, want, docs))
    kept = {i for i, _ in want}
    assert not kept & {15, 16} and {6, 7, 8, 18} <= kept
    assert corpus_pipeline.toxicity(spark, docs.limit(0), where).count() == 0


def groups(some, words=5, percent=80):
    """For each row, the group of what is linked, None without words."""
    sets = []
    for _, t in some:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset())
    own = [k if s else None for k, s in enumerate(sets)]
    linked = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    for _ in sets:
        for i, j in linked:
            own[i] = own[j] = min(own[i], own[j])
    return own


def test_near_duplicates(spark, tables):
    docs, some = frame(spark), [(r[0], r[1]) for r in rows()]
    own = groups(some)
    want = [r for r, g in zip(some, own, strict=True) if g is None]
    for g in {g for g in own if g is not None}:
        members = [r for r, x in zip(some, own, strict=True) if x == g]
        want.append(min(members, key=lambda r: (r[0] is None, r[0] or 0)))
    got = corpus_pipeline.near_duplicates(spark, docs, tables[0])
    assert got.columns == docs.columns
    same([(r["doc_id"], r["text"]) for r in got.collect()], want)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), tables[0]).count() == 0


def test_decontamination(spark, tables):
    docs = frame(spark)
    item = "the copper lantern swung above nine quiet harbours while olga counted forty seven sleeping herons".encode().split()
    count = collections.Counter(w for r in rows() for w in set(re.findall(rb"[0-9a-z\x80-\xff]+", (r[1] or "").encode().lower())))
    answers = set(sorted(set(item), key=lambda w: (count[w], w))[: len(set(item)) // 4])

    def holds(text):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
        for lo in range(0, len(words), 4):
            part = words[lo : lo + 3 * len(item)]
            share = lcs(item, part) / len(item)
            if share >= TIGHT or share >= LOOSE and len(answers & set(part)) >= ANSWER * len(answers):
                return True
        return False

    want = [(r[0], r[1]) for r in rows() if not holds(r[1])]
    got = corpus_pipeline.decontamination(spark, docs, tables[0])
    assert got.columns == docs.columns and {9, 10} == {r[0] for r in rows()} - {i for i, _ in want}
    same(got.collect(), full(spark, want, docs))
    assert corpus_pipeline.decontamination(spark, docs.limit(0), tables[0]).count() == 0


def test_secrets(spark, tables):
    docs = frame(spark)
    rx = re.compile(r"(password|token)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]{6,})", re.I)
    owners = collections.defaultdict(set)
    for _, t, _, source, _ in rows():
        for m in rx.finditer(t or ""):
            owners[m[2]].add(source)
    mask = lambda t: t if t is None else rx.sub(lambda m: m[0] if len(owners[m[2]]) >= 3 else "[SECRET]", t)
    got = corpus_pipeline.secrets(spark, docs, tables[0])
    assert got.columns == docs.columns and len(owners["sharedvalue1"]) >= 3
    same([(r["doc_id"], r["text"], r["n_chars"]) for r in got.collect()], [(r[0], mask(r[1]), len(mask(r[1]) or "")) for r in rows()])
    assert mask("password = hunter2xyz x") == "[SECRET] x" and corpus_pipeline.secrets(spark, docs.limit(0), tables[0]).count() == 0


def test_pieces(spark, tables):
    docs, model = frame(spark), pieces.Pieces.load()
    got = corpus_pipeline.pieces(spark, docs, tables[0]).collect()
    texts = collections.Counter((r[0], r[1] or "") for r in rows())
    assert collections.Counter((r["doc_id"], pieces.decode(model, np.array(r["ids"], dtype=np.int64)).decode()) for r in got) == texts
    assert all(r["lossless"] and r["n_pieces"] == len(r["ids"]) for r in got)
    assert corpus_pipeline.pieces(spark, docs.limit(0), tables[0]).count() == 0


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, SF), name)
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert {r["doc_id"] for r in after.select("doc_id").collect()} <= ids
        if name != "pieces":
            assert after.columns == columns
        if name in ("secrets", "pieces"):
            assert after.count() == docs.count()
        docs = after
    assert 0 < docs.count() <= before and docs.where("not lossless").count() == 0


def test_groups_without_an_id_or_with_the_same_one(spark):
    one, two, three, four, five = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcde")
    some = [(None, one), (None, one + " more"), (None, two), (4, three), (4, four), (None, five), (6, five)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in some], COLUMNS)
    kept = [(r["doc_id"], r["text"][0]) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    assert sorted(kept, key=str) == sorted([(None, "a"), (None, "b"), (4, "c"), (4, "d"), (6, "e")], key=str)
