"""Pieces of SQL that the oracles share: the same base series and feature space, in DuckDB's dialect."""

from __future__ import annotations

EVENTS = "s AS (SELECT user_id AS ts_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS v FROM events)"
SALES = """months AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS t FROM (SELECT DISTINCT date_trunc('month', l_shipdate) AS month FROM lineitem)),
sums AS (SELECT l_suppkey AS ts_id, date_trunc('month', l_shipdate) AS month, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2),
raw AS (SELECT g.ts_id, m.t, coalesce(x.v, 0e0) AS v FROM (SELECT DISTINCT l_suppkey AS ts_id FROM lineitem) g CROSS JOIN months m LEFT JOIN sums x ON x.ts_id = g.ts_id AND x.month = m.month)"""
P = "OVER (PARTITION BY ts_id)"
#: Sales with zero mean and largest magnitude 1.
ZSALES = f"{SALES}, c AS (SELECT ts_id, t, v - avg(v) {P} AS v FROM raw), s AS (SELECT ts_id, t, v / max(abs(v)) {P} AS v FROM c)"
#: The same with mean at most -0.01, as constraint tests need it.
DOWN = f"{ZSALES}, d AS (SELECT ts_id, t, v - 0.03e0 AS v FROM s), e AS (SELECT ts_id, t, v / max(abs(v)) {P} AS v FROM d)"
FEATURES = [f"f{i}" for i in range(8)]
SPACE = (
    "fr AS (SELECT vec_id AS ts_id, label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS f{i}" for i in range(8)) + " FROM embeddings), "
    "fs AS (SELECT ts_id, label, " + ", ".join(f"(f{i} - min(f{i}) OVER ()) / nullif(max(f{i}) OVER () - min(f{i}) OVER (), 0e0) AS f{i}" for i in range(8)) + " FROM fr), "
    "fl AS (SELECT ts_id, label, feature, v FROM fs UNPIVOT (v FOR feature IN (" + ", ".join(FEATURES) + ")))"
)
#: Interior edges of ten bins on [0, 1], as a linear space of doubles gives them; fixed values.
EDGES = [0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9]
BIN = " + ".join(f"(v >= {e!r}e0)::INT" for e in EDGES)


def normed(value: str, base: str) -> str:
    """SELECT of a computed series, scaled to largest magnitude 1 and rounded."""
    return f"SELECT ts_id, t::INT AS t, round(w / max(abs(w)) {P}, 6) + 0e0 AS v FROM (SELECT ts_id, t, {value} AS w FROM {base})"
