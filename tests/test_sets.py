"""Numbering, pruning, remapping and recipe texts on small and awkward rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadscape.operators import recombine, sets, space


def brute(rows, k, p):
    whole = [r for r in rows if None not in r and not any(map(math.isnan, r))]
    out = []
    for i, *x in whole:
        near = sorted((sum(abs(a - b) ** p for a, b in zip(x, y)) ** (1 / p), j) for j, *y in whole if j != i)
        out += [(i, n + 1, j, round(d, 6)) for n, (d, j) in enumerate(near[:k])]
    return sorted(out)


@pytest.mark.parametrize("p", [1.0, 2.0])
def test_nearest_against_all_pairs(spark, monkeypatch, p):
    rng = np.random.default_rng(3)
    rows = [(i, *map(float, rng.integers(0, 5, 2) / 4)) for i in range(150)] + [(200, None, 1.0), (201, float("nan"), 0.5)]
    df = spark.createDataFrame(rows, "ts_id long, a double, b double")
    for name, size in (("QUERIES", 40), ("POINTS", 30), ("SLICE", 7)):
        monkeypatch.setattr(space, name, size)
    found = sorted(map(tuple, space.nearest(df, df, ["a", "b"], 4, p).collect()))
    assert found == brute(rows, 4, p)
    assert space.nearest(df.limit(0), df, ["a", "b"], 4).count() == 0 == space.nearest(df, df.limit(0), ["a", "b"], 4).count()
    assert space.nearest(df.filter("ts_id < 2"), df.filter("ts_id < 2"), ["a", "b"], 4).count() == 2


@pytest.mark.parametrize("ids", [[5], [], [7, 7, 7], [-(2**63), 2**63 - 1, 0, 1, -4], list(range(0, 9000, 3))])
def test_positions_of_any_ids(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids], "ts_id long")
    found = sorted((r["i"], r["ts_id"]) for r in recombine._numbered(df).collect())
    assert found == list(enumerate(sorted(ids)))


def test_recipe_texts_come_back(spark, tmp_path):
    lines = spark.createDataFrame([(0, "812, 9, 44, 530 | 120, 3, 77, 260 | 480, 391, 350, 655 | 310, 275, 198, 420"), (1, "6 | 2 | 35 | 48")], "out_id long, line string")
    assert sorted(map(tuple, recombine.concat_text(recombine.parse_concats(lines)).collect())) == sorted(map(tuple, lines.collect()))
    scaled = spark.createDataFrame([(0, "4410, 88, 1203, 7 | 0.6, 0.9, 0.4, 0.7")], "out_id long, line string")
    assert recombine.superposition_text(recombine.parse_superpositions(scaled, places=True)).collect() == scaled.collect()
    recombine.write_lines(lines, f"{tmp_path}/recipes")
    assert sorted(recombine.read_lines(spark, f"{tmp_path}/recipes").collect()) == sorted(lines.select("line").collect())


def test_pools_are_written_with_their_recipes(spark, tmp_path):
    values = [[math.sin(i / 9 + k) - 0.4 for i in range(60)] for k in range(4)]
    initial = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "ts_id long, values array<double>")
    recombine.write_pools({"only_neg": initial, "only_posneg": initial}, str(tmp_path), samples=60, n_concat=3, n_superpos=4, per_series=2)
    pool = spark.read.parquet(f"{tmp_path}/pool")
    assert {r[0] for r in pool.select("kind").distinct().collect()} <= set(recombine.KINDS) and pool.count() > 0
    counts = [recombine.read_lines(spark, f"{tmp_path}/{t}_only_neg").count() for t in ("concat", "superpos", "chains")]
    assert counts == [3, 4, 2 * (4 + 3 + 4)]


def test_pruning_and_remapping_name_what_is_missing(spark):
    df = spark.createDataFrame([(1, "only_neg", 0.05), (2, "only_neg", 0.2), (3, "only_posneg", 0.6), (4, "only_posneg", None)], "ts_id long, kind string, dfa double")
    with pytest.raises(KeyError):
        sets.pruned(df, ("nothing",))
    assert sorted((r["ts_id"], round(r["dfa"], 6)) for r in sets.repaired(df).collect()) == [(2, 0.0), (3, 1.0)]
    chosen = df.select("ts_id", "kind").withColumn("set_size", F.lit(4))
    new = sets.numbered(chosen)
    assert sorted((r["source_id"], r["ts_id"]) for r in new.collect()) == [(1, 0), (2, 1), (3, 1_000_000), (4, 1_000_001)]
    assert sets.remapped(df, new).count() == 4
    with pytest.raises(Exception, match="no row of id 2"):
        sets.remapped(df.filter("ts_id <> 2"), new).collect()
    with pytest.raises(ValueError):
        sets.picked(df, "middle", 1)
    assert sets.plain_names(df.withColumnsRenamed({"dfa": "0__dfa__x"})).columns == ["ts_id", "kind", "dfa"]


def test_series_are_fitted_to_a_length(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0, 4.0]), (3, [float(i) for i in range(8)])], "ts_id long, values array<double>")
    found = {r["ts_id"]: r["values"] for r in sets.fitted(df, 4).collect()}
    assert found[2] == [1.0, 2.0, 3.0, 4.0] and found[3] == [0.0, 2.0, 4.0, 6.0] and len(found[1]) == 4 and found[1][0] == 1.0 and found[1][-1] == 2.0
    assert all(len(r["values"]) == 10 for r in sets.tiled(df, 10, 3).collect())


def test_a_space_chooses_the_first_of_each_cluster(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, a, a * 2, b) for i, (a, b) in enumerate(rng.random((80, 2)).tolist())], "ts_id long, a double, b double, c double")
    assert sets.reduced_space(df, ["a", "b", "c"]).columns in (["ts_id", "a", "c"], ["ts_id", "c", "a"])
