"""Chains by one fold with own processors, spread points, linkage, moves of the mean, provenance, positions, ordered sums, and pairs of many columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadscape.functions import arrays as A
from loadscape.functions import halton
from loadscape.functions import kernels as K
from loadscape.functions import linkage as L
from loadscape.operators import decluster as D
from loadscape.operators import gram
from loadscape.operators import ordered as O
from loadscape.operators import provenance as V
from loadscape.operators import recombine as R
from loadscape.operators import sets as T
from loadscape.operators import space as S
from loadscape.sources import positions


# ---- chains
def plain(v, steps):
    top = lambda w: w / np.abs(w).max()
    for tag, x in steps:
        v = {"shift": lambda: top(v + x), "exp": lambda: top(np.sign(v) * np.abs(v) ** x), "inv": lambda: -v, "dist": lambda: K.distort_time(v, int(x)), "rev": lambda: v[::-1] * x, "clip": lambda: np.minimum(v, x)}[tag]()
    return v


def test_chains_with_own_processors(spark):
    rng = random.Random(1)
    own = {t: R.PROCESSORS[t] for t in ("shift", "exp", "inv", "dist")}
    own["rev"] = R.Processor(lambda v, x: np.asarray(v)[::-1] * x, 1, 2, 0.5, arrow=True)
    own["clip"] = R.Processor(lambda v, x: F.transform(v, lambda y: F.least(y, x)), 0, 1, 0.5)
    chains = [[], [("dist", 7.0)], [("rev", 2.0), ("dist", 3.0)]] + [[(t, {"exp": 1.5, "dist": 9.0}.get(t, 0.4)) for t in rng.choices(list(own), k=rng.randrange(1, 7))] for _ in range(30)]
    chains = [c for c in chains if sum(t in ("dist", "rev") for t, _ in c) <= 4]
    values = [[rng.gauss(0, 1) for _ in range(40)] for _ in chains]
    df = spark.createDataFrame([(i, v, c) for i, (v, c) in enumerate(zip(values, chains))], f"ts_id long, values array<double>, steps {R.CHAIN}")
    got = {r["ts_id"]: r["values"] for r in R.apply_chains(df, own).collect()}
    for i, (v, c) in enumerate(zip(values, chains)):
        assert np.allclose(got[i], plain(np.array(v), c)), c
    recipes = R.chain_recipes(df, 6, processors={"clip": own["clip"], "rev": own["rev"]})
    assert {s["tag"] for r in recipes.collect() for s in r["steps"]} == {"clip", "rev"} and R.modify(df.select("ts_id", "values"), recipes, own).count() == 6 * len(chains)


def test_chains_that_cannot_be(spark):
    made = lambda *steps: spark.createDataFrame([(1, [1.0, -1.0], list(steps))], f"ts_id long, values array<double>, steps {R.CHAIN}")
    for steps in ([("nothing", 1.0)], [("dist", 1.0)] * 3):
        with pytest.raises(Exception, match="no processor nothing|more than 2"):
            R.apply_chains(made(*steps)).collect()


def test_the_plan_of_chains_is_small_and_lazy(spark):
    df = spark.createDataFrame([(1, [1.0, -1.0], [("inv", -1.0)] * 50)], f"ts_id long, values array<double>, steps {R.CHAIN}")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup
    before = len(jobs())
    plans = [R.apply_chains(df, arrow_steps=k)._jdf.queryExecution().optimizedPlan().toString() for k in (0, 2)]
    assert len(jobs()) == before and len(plans[0]) < 20_000 and len(plans[1]) < 60_000


def test_a_mean_within_the_band_leaves_it(spark):
    rng = np.random.default_rng(3)
    rows = []
    for scale in (0.5, 1, 3, 200):
        v = rng.normal(size=50)
        v = (v - v.mean()) * scale
        rows += [(v + m).tolist() for m in (-0.009, 0.0, 0.009, 0.5, -0.5)]
    df = spark.createDataFrame([(r,) for r in rows], "v array<double>")
    for draws in (None, (0.1, 0.02)):
        for r in df.select("v", A.fix_mean(F.col("v"), draws=draws).alias("w")).collect():
            v, w = np.array(r["v"]), np.array(r["w"])
            if abs(v.mean()) >= 0.01:
                assert np.allclose(w, v if v.mean() < 0 else -v)
            else:
                assert w.mean() <= -0.01 and np.isclose(np.abs(w).max(), 1)


# ---- spread points
def test_halton_plain_and_scrambled(spark):
    n = 3**5
    df = spark.range(n).select(*[h.alias(f"h{i}") for i, h in enumerate(halton.points(F.col("id"), 4, 9))], halton.radical_inverse(F.col("id"), 3).alias("plain"))
    got = df.toPandas()
    inverse = lambda i, b: sum(d / b ** (k + 1) for k, d in enumerate(int(x) for x in reversed(np.base_repr(i, b))))
    assert np.allclose(got["plain"], [inverse(i, 3) for i in range(n)])
    for j, b in enumerate(halton.primes(4)):
        k = int(np.log(n) / np.log(b) + 1e-9)
        cells = np.floor(got[f"h{j}"].to_numpy()[: b**k] * b**k).astype(int)
        assert sorted(cells) == list(range(b**k)) and got[f"h{j}"].between(0, 1, inclusive="left").all()
    assert not np.allclose(got["h1"], got["plain"])
    again = spark.range(n).select(*[h.alias(f"h{i}") for i, h in enumerate(halton.points(F.col("id"), 4, 10))]).toPandas()
    assert not np.allclose(again["h0"], got["h0"])


# ---- linkage
def brute_merges(d, method):
    n = len(d)
    parts = {i: (i,) for i in range(n)}
    heights = []
    apart = {frozenset((i, j)): d[i, j] for i in range(n) for j in range(i)}
    for k in range(n - 1):
        (i, j) = min((tuple(sorted(p)) for p in apart), key=lambda p: (apart[frozenset(p)], min(parts[p[0]] + parts[p[1]])))
        heights.append(apart[frozenset((i, j))])
        new = n + k
        for c in parts:
            if c in (i, j):
                continue
            x, y = apart[frozenset((i, c))], apart[frozenset((j, c))]
            flatd = [d[a, b] for a in parts[i] + parts[j] for b in parts[c]]
            apart[frozenset((new, c))] = {"single": min(flatd), "complete": max(flatd), "average": np.mean(flatd), "weighted": (x + y) / 2}[method]
        apart = {p: v for p, v in apart.items() if not p & {i, j}}
        parts[new] = parts.pop(i) + parts.pop(j)
    return heights


@pytest.mark.parametrize("method", ["single", "complete", "average", "weighted"])
def test_linkage_against_brute(method):
    for seed in range(10):
        d = np.random.default_rng(seed).random((8, 8))
        d = (d + d.T) / 2
        np.fill_diagonal(d, 0)
        found = L.merges(d, method)
        assert np.allclose([m[2] for m in found], brute_merges(d, method)) and found[-1][3] == 8
        for count in range(1, 9):
            assert len(set(L.flat(found, count, "maxclust"))) == count
        best = L.order(found, d)
        cost = lambda o: sum(d[a, b] for a, b in zip(o, o[1:]))
        assert sorted(best) == list(range(8))
        # an order keeps a part together, in one direction or the other
        every = min(cost(o) for o in _orders(found, 8))
        assert np.isclose(cost(best), every)


def _orders(found, n):
    tree = {i: [[i]] for i in range(n)}
    for k, (a, b, *_) in enumerate(found):
        tree[n + k] = [x + y for p, q in ((a, b), (b, a)) for x in tree[p] for y in tree[q]]
    return tree[n + len(found) - 1]


def test_ward_merges_by_spread():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.1, (5, 2)) for c in (0, 3, 9)])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    found = L.merges(d, "ward")
    assert L.flat(found, 3, "maxclust").tolist() == [1] * 5 + [2] * 5 + [3] * 5
    a, b = x[:5], x[5:10]
    gap = np.sqrt(2 * 25 / 10) * np.linalg.norm(a.mean(axis=0) - b.mean(axis=0))
    assert np.isclose(found[-2][2], gap)
    with pytest.raises(ValueError):
        L.merges(d, "other")


def test_average_labels_are_those_of_the_kernel():
    for seed in range(8):
        d = np.random.default_rng(seed).random((12, 12))
        d = (d + d.T) / 2
        for h in (0.2, 0.45, 0.6):
            assert L.flat(L.merges(d), h).tolist() == K.average_linkage(d, h).tolist()


# ---- many columns
def test_a_hundred_columns_with_gaps(spark):
    rng = np.random.default_rng(1)
    x = rng.random((300, 100))
    x[:, 7] = x[:, 3] ** 0.5
    x[:, 9] = 0.5
    x[rng.random(x.shape) < 0.1] = np.nan
    columns = [f"c{i}" for i in range(100)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in x], ", ".join(f"{c} double" for c in columns)).repartition(4)
    found = gram.largest_correlations(df, columns)
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 30_000
    got = {(r["fi"], r["fj"]): r["r"] for r in found.collect()}
    assert len(got) == 4950
    for i, j in ((0, 1), (3, 7), (7, 3), (20, 90), (5, 9)):
        i, j = min(i, j), max(i, j)
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        a, b = x[both, i], x[both, j]
        if b.std() == 0:
            assert got[f"c{i}", f"c{j}"] is None or got[f"c{i}", f"c{j}"] < 1e-6
            continue
        want = max(abs(np.corrcoef(a, k(b))[0, 1]) for k in (lambda y: y, np.sqrt, np.square, lambda y: 1 / (y + 1e-10)))
        assert abs(got[f"c{i}", f"c{j}"] - want) < 1e-6
    own = S.modified_pearson(df, columns[:4], lambda a, b: F.abs(F.corr(a, b)))
    assert own.count() == 6 and abs(own.filter("fi = 'c0' and fj = 'c1'").first()["r"] - abs(df.select(F.corr("c0", "c1")).first()[0])) < 2e-6


def test_reduction_with_its_usual_choices(spark):
    rng = np.random.default_rng(4)
    names = [*T.REPRESENTATIVES, *T.EXCLUDED, "linearity"]
    df = spark.createDataFrame([(i, *map(float, rng.random(len(names)))) for i in range(150)], "ts_id long, " + ", ".join(f"{c} double" for c in names))
    space, info = T.reduction(df, names, with_info=True)
    rows = space.toPandas()
    assert space.columns == ["ts_id", *T.REPRESENTATIVES] and len(rows) < 150 and info.count() == len(T.REPRESENTATIVES) + 1
    assert rows["dfa"].min() == 0 and rows["dfa"].max() == 1
    few, own = T.reduction(df, names, choose=None, threshold=3, criterion="maxclust", linkage="complete")
    assert len(few.columns) == 4 and own.select("label").distinct().count() == 3
    assert sorted(r["pos"] for r in own.collect()) == list(range(len(T.REPRESENTATIVES) + 1))
    stats = S.cluster_statistics(own)
    assert stats.count() == 4 and stats.filter("label is null").count() == 1


# ---- order, positions, origins
def test_numbers_and_sums_of_a_long_series(spark):
    rng = random.Random(6)
    rows = [(rng.choice((1, 1, 1, 2, None)), i, float(rng.randrange(-5, 6))) for i in range(3000)]
    df = spark.createDataFrame(rows, "s long, o long, v double").repartition(7)
    placed = O.numbered(df, "s", "o", partitions=6)
    got = O.running(O.running(placed, "up", by="s", block=50), "down", by="s", falling=True, block=50).collect()
    assert len(got) == 3000
    for s in (1, 2, None):
        own = sorted((r for r in rows if r[0] == s), key=lambda r: r[1])
        v = np.array([r[2] for r in own])
        mine = sorted((r for r in got if r["s"] == s), key=lambda r: r["t"])
        assert [r["o"] for r in mine] == [r[1] for r in own] and [r["t"] for r in mine] == list(range(len(own)))
        assert np.allclose([r["up"] for r in mine], np.cumsum(v)) and np.allclose([r["down"] for r in mine], np.cumsum(v[::-1])[::-1])


def test_an_order_of_all_rows(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = O.of_all(df, F.col("k").desc(), partitions=5).collect()
    assert all(r["pos"] == 999 - r["k"] for r in got) and len(got) == 1000


def test_positions_of_files(spark, tmp_path):
    spark.range(1000).repartitionByRange(4, "id").sortWithinPartitions("id").write.parquet(f"{tmp_path}/a")
    spark.range(1000).select((F.col("id") * 2).alias("twice")).repartitionByRange(7, "twice").sortWithinPartitions("twice").write.parquet(f"{tmp_path}/b")
    spark.range(999).write.parquet(f"{tmp_path}/c")
    got = positions.attached(spark, f"{tmp_path}/a", f"{tmp_path}/b").collect()
    assert len(got) == 1000 and all(r["pos"] == r["id"] and r["twice"] == 2 * r["id"] for r in got)
    with pytest.raises(ValueError, match="999"):
        positions.attached(spark, f"{tmp_path}/a", f"{tmp_path}/c")
    with pytest.raises(ValueError, match="in both"):
        positions.attached(spark, f"{tmp_path}/a", f"{tmp_path}/a")


def test_origins_of_a_pool(spark):
    rng = np.random.default_rng(8)
    initial = spark.createDataFrame([(100 + i, rng.normal(size=60).tolist()) for i in range(9)], "ts_id long, values array<double>")
    recipes = {}
    pool = R.manifold(initial, "only_neg", samples=60, n_concat=12, n_superpos=20, per_series=2, recipes=recipes, keep=True)
    found = {r["ts_id"]: r for r in V.recombined(initial, recipes).collect()}
    assert {r["ts_id"] for r in pool.select("ts_id").collect()} <= set(found)
    first = {k for k, r in found.items() if r["depth"] == 0}
    assert first == set(range(100, 109)) and all(found[k]["label"] == str(k) and found[k]["initial_ids"] == [k] for k in first)
    ways = {}
    for r in V.sources(recipes).collect():
        ways.setdefault(r["ts_id"], set()).add(r["src_id"])
    behind = lambda i: {i} if i in first else set().union(*(behind(x) for x in ways[i]))
    deep = lambda i: 0 if i in first else 1 + max(deep(x) for x in ways[i])
    assert len(found) == 9 + len(ways) and max(r["depth"] for r in found.values()) == 3
    for i, r in found.items():
        assert set(r["initial_ids"]) == behind(i) and r["depth"] == deep(i)
    kinds = {r["label"].split(" ")[0] for r in found.values() if r["depth"] and not r["label"].split(" ")[1] == "|>"}
    assert kinds == {"concat", "superpos"}


def test_origins_that_cannot_be(spark):
    initial = spark.createDataFrame([(1,), (2,)], "ts_id long")
    steps = lambda *rows: spark.createDataFrame(rows, "ts_id long, src_id long")
    with pytest.raises(KeyError, match="7"):
        V.origins(steps((3, 1), (4, 7)), initial)
    with pytest.raises(ValueError):
        V.traced(steps((3, 4), (4, 3)), initial, most=5)


def test_superpositions_keep_their_places(spark):
    lines = spark.createDataFrame([(5, "40, 2, 17, 2 | 0.9, 0.3, 0.5, 0.7")], "out_id long, line string")
    recipes = R.parse_superpositions(lines, places=True)
    assert R.superposition_text(recipes.repartition(4)).first()["line"] == "40, 2, 17, 2 | 0.9, 0.3, 0.5, 0.7"
    assert R.superposition_text(recipes.drop("pos")).first()["line"] == "2, 2, 17, 40 | 0.3, 0.7, 0.5, 0.9"


def test_uniform_selection_needs_no_ids_on_the_driver(spark):
    df = spark.range(400).select(F.col("id").alias("ts_id"), (F.col("id") * 37 % 400 / 400).alias("a"), (F.col("id") * 91 % 400 / 400).alias("b"))
    for seed in (1, None):
        got = D.map_to_uniform(df, ["a", "b"], 50, seed=seed)
        assert got.count() == 50 and got.select("ts_id").distinct().count() == 50
