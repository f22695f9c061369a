"""Blocks of vectors: how often a vector is written, and pairs of blocks with repeated ids and several lengths."""

import numpy as np

from loadscape.llm import cover_tree
from loadscape.llm.cover_tree import CoverTree, links_of

SCHEMA = "id long, v array<double>"


def test_a_vector_is_written_once_whatever_the_number_of_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1500)] + [(i, None) for i in range(9)] + [(None, [1.0])] + [(2000 + i, [0.0, float(i)]) for i in range(3)]
    found = cover_tree.blocks(spark.createDataFrame(rows + rows[:100], SCHEMA).repartition(3), 64).collect()
    ids = [np.frombuffer(r["ids"], np.int64) for r in found]
    assert len(found) > 15 and len({r["b"] for r in found}) == len(found) and max(map(len, ids)) <= 128
    assert sorted(np.concatenate(ids).tolist()) == [*range(1500), 2001, 2002]
    assert sum(len(r["x"]) for r in found) == 8 * (1500 * 8 + 2 * 2)


def test_two_blocks_against_all_pairs():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6, 5))[rng.integers(6, size=500)] + rng.normal(size=(500, 5)) * rng.choice((0, 0.1, 0.6), size=(500, 1))
    x, ids = x / np.linalg.norm(x, axis=1)[:, None], rng.permutation(500) // 2
    hit = (x @ x.T >= 0.9) & (ids[:, None] != ids)
    a, b = (CoverTree.grown(x[s], ids[s], 16) for s in (slice(0, 200), slice(200, 500)))
    assert all(np.array_equal(u, v) for t in (a, b) for u, v in zip(vars(t).values(), vars(CoverTree.read(t.ids.tobytes(), t.x.tobytes(), t.nodes.tobytes())).values()))
    counts, joined = np.zeros(250, int), {(i, i) for i in range(250)}
    for pair in ((a, a), (a, b), (b, b)):
        found, n, near = links_of(*pair, 0.9)
        np.add.at(counts, found, n)
        joined |= set(zip(found.tolist(), near.tolist()))
    want = np.zeros(250, int)
    np.add.at(want, ids, hit.sum(axis=1))
    assert counts.tolist() == want.tolist()

    def smallest(pairs):
        low = list(range(250))
        for _ in range(250):
            for i, j in pairs:
                low[i] = low[j] = min(low[i], low[j])
        return low

    assert smallest(joined) == smallest({(int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(hit))})
