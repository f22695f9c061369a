"""Classes that share many buckets of the Jaccard join are one pair, and no pair is lost."""

import random

import numpy as np
from pyspark.sql import functions as F

from loadscape.llm import jaccard_join as jj


def test_members_of_many_buckets_are_one_pair(spark):
    # 12 buckets, each of 40 sets that are near all others of them, without 1 of 12 in turn
    buckets = [(100 + b, c) for b in range(12) for c in range(40) if c % 12 != b]
    held = spark.createDataFrame([(b, c, True, sum(x == b for x, _ in buckets)) for b, c in buckets], "bucket long, class long, own boolean, many int")
    lists = {r["class"]: r["listed"] for r in jj._listed(held).collect()}
    assert set(lists) == set(range(40)) and all(len(x) == jj.LISTED for x in lists.values())
    rows = [(b, 0, c, 100, True, True, c, c, [0] * 8, lists[c]) for b, c in buckets]
    tasks = spark.createDataFrame(rows, "bucket long, block int, class long, size int, own boolean, active boolean, rep long, component long, sketch array<long>, listed array<long>")
    found = jj._candidates(tasks, 75, 64).collect()
    pairs = [(r["a"], r["b"]) for r in found if r["a"] is not None]
    assert not any(r["bucket"] is not None for r in found)
    assert sorted(pairs) == [(a, b) for a in range(40) for b in range(a + 1, 40)]  # each once, none missing


def test_two_members_meet_in_one_bucket_that_both_list():
    rng = random.Random(4)
    lists = {c: sorted(rng.sample(range(9), rng.randint(0, 4)), key=lambda _: rng.random()) for c in range(60)}
    for b in range(9):
        cls = [c for c in lists if b in lists[c] or c % 3 == 0]  # some are members without listing it
        elsewhere = jj._elsewhere(b, [lists[c] for c in cls])
        for i in range(len(cls)):
            got = elsewhere(i, np.arange(len(cls)))
            for j in range(len(cls)):
                common = set(lists[cls[i]]) & set(lists[cls[j]])
                assert got[j] == bool(common and min(common) != b)


def test_large_buckets_link_as_plain_pairs(spark):
    # near copies of one text, each with words of its own, in buckets of more than LARGE classes
    rng = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for d in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        docs.append((d, " ".join(words)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(56)} for _, t in docs]
    near = {(a, b) for a in range(60) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    root = list(range(60))
    for _ in range(60):
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    got = jj.components_of(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.select("doc_id", F.col("component_id")).collect()} == dict(enumerate(root))
