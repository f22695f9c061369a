"""What the Jaccard join moves: texts and sketches only of those that may have partners, and no link is lost by it."""

import random

import numpy as np
from pyspark.sql import functions as F

from loadscape.llm import jaccard_join as jj


def near_copies(n, words, edits, rng, first=0):
    base, docs = [f"w{first}-{i}" for i in range(words)], []
    for d in range(n):
        own = list(base)
        for _ in range(rng.randint(*edits)):
            own[rng.randrange(words)] = f"x{rng.randrange(10**9)}"
        docs.append((first + d, " ".join(own)))
    return docs


def plain(docs):
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in docs}
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if b < a and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d: top(d) for d in sets}


def test_halved_sketches_lose_no_link(spark):
    rng = random.Random(8)
    docs = [d for g, words in enumerate((100, 300, 900)) for d in near_copies(24, words, (0, words // 20), rng, 1000 * g)]
    got = jj.components_of(spark.createDataFrame(docs, "doc_id long, text string"))
    want = plain(docs)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want
    assert 3 < len(set(want.values())) < 60  # some links are there and some are not


def test_a_halved_sketch_is_a_folded_one(spark):
    sets = [np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for n in (1, 255, 256, 900)]
    rows = [(r,) for r in jj.sketches(sets).to_pylist()]
    got = [r[0] for r in spark.createDataFrame(rows, "sketch array<long>").select(jj._halved("sketch")).collect()]
    assert got == [jj.folded(np.array(r[0]), max(8, len(r[0]) // 2)).tolist() for r in rows]


def test_only_texts_of_pairs_move(spark, monkeypatch):
    rng = random.Random(3)
    docs = near_copies(3, 100, (1, 1), rng) + [(100 + d, " ".join(f"y{d}-{i}" for i in range(60))) for d in range(300)] + [(None, "a b c d e f g")]
    moved = []
    monkeypatch.setattr(jj, "_among", lambda rows, name, ids, f=jj._among: moved.append((name, f(rows, name, ids))) or moved[-1][1])
    got = jj.components_of(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.filter("doc_id < 100").collect()} == {0: 0, 1: 0, 2: 0}
    texts = next(df for name, df in moved if name == "doc_id")
    assert {0, 1, 2} <= {r["doc_id"] for r in texts.collect()} and texts.count() < 10


def test_marks_lose_no_id(spark, monkeypatch):
    monkeypatch.setattr(jj, "MARK", 1 << 12)
    rows = spark.range(-3000, 3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).unionByName(spark.sql("select cast(null as long) doc_id, 't' text"))
    ids = [*range(-3000, 3000, 40), *range(-3000, 3000, 40)]
    found = sorted(r["doc_id"] for r in jj._among(rows, "doc_id", spark.createDataFrame([(i,) for i in ids], "doc_id long")).collect())
    assert set(ids) <= set(found) and len(found) == len(set(found)) < 900
    assert jj._among(rows, "doc_id", spark.createDataFrame([], "doc_id long")).isEmpty()


def test_planes_give_numbers_back():
    x = np.array([0, 1, 255, 256, 70_000, (1 << 31) - 1], np.int32)
    assert jj._from_planes(jj._planes(x)).tolist() == x.tolist() and not len(jj._from_planes(jj._planes(x[:0])))
