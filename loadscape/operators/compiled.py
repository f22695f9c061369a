"""Features by catalogue: a catalogue's rows become one plan over one scan.

A row names a feature, says whether it is used, how its input is normalised, what settings it has, and whether the result is divided by the number of points.
Rows that are used are grouped by the normalisation of their input. Each normalised series is one column; under it lie the parts that its features need, then
the features, all expressions of one row. Features that are functions of an array in Python are computed after these, in one Arrow stage that hands the
others on. The plan has a scan and projections, and no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from loadscape.functions import arrays as A
from loadscape.functions import kernels as K
from loadscape.functions import shape_kernels
from loadscape.functions import series_features as X
from loadscape.operators.features import NUMERIC, rounded
from loadscape.sources import catalogue as C

#: How inputs are normalised, by the catalogue's words; the series is expected with largest magnitude 1, so that one is as given.
NORMS: dict[str, Callable] = {"norm_maxabs": lambda v: v, "_dont_care": lambda v: v, "z_score": A.norm_zscore, "norm_minmax": A.norm_minmax, "norm_meanmaxabs": A.norm_meanmaxabs}
#: Features in Python: the names that a function of an array returns.
CALLS: list[tuple[tuple[str, ...], Callable[[np.ndarray], dict[str, float]]]] = [
    (NUMERIC, lambda v: {**K.spectrum_features(v), "dfa": K.fluctuation(v), "rs_range": K.fluctuation(v, True)}),
    (shape_kernels.NAMES, shape_kernels.shape_features),
]


def rows_of(spark: SparkSession, names: Iterable[str | tuple[str, str]], norm_in: str = "_dont_care", src: str = "extra") -> DataFrame:
    """A catalogue of features, all used: each by its name, or by a name and what its parse_info says."""
    pairs = [(n, None) if isinstance(n, str) else n for n in names]
    return spark.createDataFrame([(src, i, i, n, n, True, norm_in, None, None, None, info) for i, (n, info) in enumerate(pairs, 1)], C.SCHEMA)


def _names(row: Row) -> list[str]:
    """What a row may be called by: its function, then its names."""
    return [x for x in (row["function"], row["orig_name"], row["rectified_name"]) if x]


def _found(row: Row) -> str:
    called = {n for names, _ in CALLS for n in names}
    name = next((n for n in _names(row) if n in X.FEATURES or n in called), None)
    if name is None:
        raise KeyError(f"no such feature: {', '.join(_names(row))}")
    return name


def _settings(name: str, row: Row) -> dict[str, float]:
    have = X.FEATURES[name].settings if name in X.FEATURES else {}
    given = row["numbers"] or {}
    wrong = [k for k, x in given.items() if k not in have or x is None]
    if wrong:
        raise KeyError(f"{row['rectified_name']} has no number {', '.join(wrong)}")
    return {**have, **given}


def chosen(catalogue: DataFrame, src: str | None = None) -> list[Row]:
    """The used rows, with what their parse_info says, in the order of ID. A catalogue has a row a feature, so it is collected."""
    used = catalogue.filter(F.col("use") & (F.col("src") == src if src else F.lit(True)))
    said = C.parsed(used).select("src", "orig_name", "function", "numbers")
    return used.select("src", "ID", "orig_name", "rectified_name", "norm_in", "norm_out").join(said, ["src", "orig_name"]).orderBy("ID", "src").collect()


def features(series: DataFrame, catalogue: DataFrame, src: str | None = None) -> DataFrame:
    """ts_id and a column for each used row of the catalogue (of one toolbox or of all), under its rectified name.

    An unknown feature, setting or normalisation, and a name that comes twice, are errors.
    """
    rows = [(r, _found(r)) for r in chosen(catalogue, src)]
    names = [r["rectified_name"] for r, _ in rows]
    if len(set(names)) < len(names):
        raise KeyError(f"named twice: {', '.join(sorted({n for n in names if names.count(n) > 1}))}")
    norms = {(r["norm_in"] or "_dont_care") for r, _ in rows}
    if norms - NORMS.keys():
        raise KeyError(f"no such normalisation: {', '.join(sorted(norms - NORMS.keys()))}")
    # those that leave the series as it is share a column
    column = {n: "_v" if n in ("norm_maxabs", "_dont_care") else f"_v_{n}" for n in norms}
    out = series.select("ts_id", *[NORMS[n](F.col("values")).alias(c) for c, n in {column[n]: n for n in sorted(norms)}.items()])
    depth: dict[tuple[str, str], int] = {}

    def need(base: str, part: str) -> int:
        """How many steps above the series a part is."""
        if (base, part) not in depth:
            depth[base, part] = 1 + max((need(base, p) for p in X.PARTS[part][0]), default=0)
        return depth[base, part]

    place = lambda base, part: base if part == "v" else f"{base} {part}"
    native = [(r, n, column[r["norm_in"] or "_dont_care"]) for r, n in rows if n in X.FEATURES]
    for _, name, base in native:
        for part in X.FEATURES[name].needs:
            need(base, part)
    for step in sorted(set(depth.values())):
        out = out.withColumns({place(b, p): X.PARTS[p][1](lambda q, b=b: F.col(f"`{place(b, q)}`")) for (b, p), d in depth.items() if d == step})
    made = {}
    for row, name, base in native:
        f = X.FEATURES[name]
        value = f.build(lambda q, b=base: F.col(f"`{place(b, q)}`"), **_settings(name, row))
        if row["norm_out"]:
            value = value / F.size(F.col(f"`{base}`"))
        made[row["rectified_name"]] = value if f.count and not row["norm_out"] else rounded(value)
    called = [(r, n, column[r["norm_in"] or "_dont_care"]) for r, n in rows if n not in X.FEATURES]
    out = out.select("ts_id", *[c.alias(n) for n, c in made.items()], *[F.col(f"`{b}`") for b in sorted({b for _, _, b in called})])
    if called:
        out = _called(out, called)
    return out.select("ts_id", *[F.col(f"`{n}`") for n in names])


def _called(df: DataFrame, rows: list[tuple[Row, str, str]]) -> DataFrame:
    """The features in Python, one Arrow stage for all; a nan and a name that a function leaves out are null."""
    bases = sorted({b for _, _, b in rows})
    rest = [c for c in df.columns if c not in bases]
    named = [(r["rectified_name"], n, b, bool(r["norm_out"])) for r, n, b in rows]
    calls = [(b, f) for b in bases for names, f in CALLS if any(n in names and base == b for _, n, base in rows)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = []
            for values in zip(*(part[b] for b in bases)):
                v = dict(zip(bases, (np.asarray(x, float) for x in values)))
                have: dict[str, dict] = {b: {} for b in bases}
                for b, f in calls:
                    have[b] |= f(v[b])
                found.append([have[b].get(n, np.nan) / (len(v[b]) if per_point else 1) for _, n, b, per_point in named])
            more = pd.DataFrame(found, columns=[n for n, *_ in named], dtype=float)
            yield pd.concat([part[rest].reset_index(drop=True), more], axis=1)

    schema = df.select(rest).schema
    for n, *_ in named:
        schema = schema.add(n, "double")
    out = df.mapInPandas(run, schema)
    return out.select(*rest, *[rounded(F.nanvl(F.col(f"`{n}`"), F.lit(None))).alias(n) for n, *_ in named])


def all_rows() -> list[str | tuple[str, str]]:
    """Every feature with its own settings, for rows_of()."""
    modes = [(f"mode{b}", f"distribution mode bins={b}") for b in (5, 10)]
    return [n for n in X.FEATURES if n not in ("quantile", "count_above_mean", "mode")] + modes + [n for names, _ in CALLS for n in names]
