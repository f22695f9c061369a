"""How many pairs a bucket of the Jaccard join makes in its first round."""

import numpy as np

from loadscape.llm import jaccard_join as jj


def test_pairs_of_a_bucket_grow_with_its_members(spark):
    # 30 sets that are near none of each other, each near all of 100 others
    rows = []
    for c in range(130):
        bits = np.zeros(512, np.uint8)
        if c < 30:
            bits[15 * c : 15 * c + 15] = 1
        rows.append((7, 0, c, 100, True, True, c, c, np.packbits(bits).view(np.int64).tolist()))
    tasks = spark.createDataFrame(rows, "bucket long, block int, class long, size int, own boolean, active boolean, rep long, component long, sketch array<long>")
    found = jj._candidates(tasks, 75, 1).collect()
    pairs = {(r["a"], r["b"]) for r in found if r["a"] is not None}
    waits = {r["class"] for r in found if r["bucket"] is not None}
    assert len(pairs) == sum(r["a"] is not None for r in found) <= 130 + 8 * 30
    # what is near and in no pair waits on both sides
    near = {(a, b) for b in range(30, 130) for a in range(b)}
    assert all(a in waits and b in waits for a, b in near - pairs)
    assert pairs <= near
