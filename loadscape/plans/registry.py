"""The registered queries of the series engine, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loadscape.functions import arrays as A
from loadscape.functions import halton
from loadscape.operators import compiled
from loadscape.operators import decluster as D
from loadscape.operators import features as X
from loadscape.operators import ordered as O
from loadscape.operators import provenance as V
from loadscape.operators import quantiles as Q
from loadscape.operators import recombine as R
from loadscape.operators import sets as T
from loadscape.operators import space as S
from loadscape.plans.sql import BIN, DOWN, EDGES, EVENTS, FEATURES, SALES, SPACE, ZSALES, P, normed
from loadscape.sources import positions
from loadscape.sources import series as src
from loadscape.sources.store import Store, kept_at

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    _QUERIES[name] = query
    if sql:
        _SQL[name] = sql


def _array(base, change) -> Query:
    """A query that changes the values of a base's series and returns them in long form."""
    return lambda spark, d: src.to_long(base(spark, d).select("ts_id", change(F.col("values")).alias("values")), X.DIGITS)


def zsales(spark: SparkSession, d: str) -> DataFrame:
    return src.sales_series(spark, d).select("ts_id", A.norm_meanmaxabs(F.col("values")).alias("values"))


def down(spark: SparkSession, d: str) -> DataFrame:
    return zsales(spark, d).select("ts_id", A.norm_maxabs(F.transform("values", lambda x: x - 0.03)).alias("values"))


_OUT = "SELECT ts_id, t::INT AS t, round({}, 6) + 0e0 AS v FROM {}"

# ---- series and normalisers
_add("series_extract", lambda s, d: src.to_long(src.event_series(s, d), X.DIGITS), f"WITH {EVENTS} " + _OUT.format("v", "s"))
_add("series_monthly", lambda s, d: src.to_long(src.sales_series(s, d), 4), f"WITH {SALES} SELECT ts_id, t::INT AS t, round(v, 4) + 0e0 AS v FROM raw")
_add("norm_maxabs", _array(src.event_series, A.norm_maxabs), f"WITH {EVENTS} " + _OUT.format(f"v / max(abs(v)) {P}", "s"))
_add("norm_meanmaxabs", _array(src.sales_series, A.norm_meanmaxabs), f"WITH {ZSALES} " + _OUT.format("v", "s"))
_add("norm_zscore", _array(src.event_series, A.norm_zscore), f"WITH {EVENTS} " + _OUT.format(f"(v - avg(v) {P}) / stddev_pop(v) {P}", "s"))
_add("norm_minmax", _array(src.event_series, A.norm_minmax), f"WITH {EVENTS} " + _OUT.format(f"(v - min(v) {P}) / (max(v) {P} - min(v) {P})", "s"))
_add("raw_to_init", _array(src.sales_series, lambda v: A.norm_meanmaxabs(F.transform(v, lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))))), f"WITH {ZSALES} " + _OUT.format("v", "s"))
_add("negate_if_positive", _array(src.event_series, lambda v: A.let(A.norm_maxabs(v), lambda w: A.let(A.mean(w), lambda m: F.transform(w, lambda x: F.when(m > 0, -x).otherwise(x))))), f"WITH {EVENTS} " + _OUT.format(f"CASE WHEN avg(v) {P} > 0 THEN -v ELSE v END / max(abs(v)) {P}", "s"))
_add("reverse_series", _array(src.event_series, F.reverse), f"WITH {EVENTS} SELECT ts_id, (row_number() OVER (PARTITION BY ts_id ORDER BY t DESC) - 1)::INT AS t, round(v, 6) + 0e0 AS v FROM s")
_add("tile_repeat", _array(src.sales_series, lambda v: A.tile(v, 3, 200)), f"WITH {SALES}, x AS (SELECT ts_id, t + k * count(*) OVER (PARTITION BY ts_id, k) AS t, v FROM raw CROSS JOIN range(3) r(k)) " + _OUT.format("v", "x WHERE t < 200"))
_add("smooth_ends", _array(zsales, lambda v: A.smooth_ends(v, 9)), f"WITH {ZSALES} " + _OUT.format(f"v * least(1e0, (t + 1) / 10e0) * least(1e0, (count(*) {P} - t) / 10e0)", "s"))
_add("overlap_append", _array(zsales, lambda v: A.append_overlapping(v, F.reverse(v), 9)), f"WITH {ZSALES}, n AS (SELECT *, count(*) {P} AS n FROM s), b AS (SELECT ts_id, t, v FROM n UNION ALL SELECT ts_id, (n - 1 - t) + n - 9, v FROM n) SELECT ts_id, t::INT AS t, round(sum(v), 6) + 0e0 AS v FROM b GROUP BY ts_id, t")

# ---- signal processors
for _name, _change, _value in (
    ("shift", lambda v: A.shift(v, -0.4), "v - 0.4e0"),
    ("expand", lambda v: A.expand(v, 1.6), "sign(v) * pow(abs(v), 1.6e0)"),
    ("compress", lambda v: A.expand(v, 0.6), "sign(v) * pow(abs(v), 0.6e0)"),
    ("curtail_top", lambda v: A.curtail_top(v, 0.15), f"least(v, 0.85e0 * (max(v) {P} - min(v) {P}) + min(v) {P})"),
    ("curtail_bottom", lambda v: A.curtail_bottom(v, 0.15), f"greatest(v, 0.15e0 * (max(v) {P} - min(v) {P}) + min(v) {P})"),
):
    _add(_name, _array(zsales, _change), f"WITH {ZSALES} " + normed(_value, "s"))
_MID = f"m AS (SELECT ts_id, t, v, (1e0 - 0.1e0) / 2 * (max(v) {P} - min(v) {P}) + min(v) {P} AS b, (1e0 + 0.1e0) / 2 * (max(v) {P} - min(v) {P}) + min(v) {P} AS h FROM s)"
_add("curtail_middle", _array(zsales, lambda v: A.curtail_middle(v, 0.1)), f"WITH {ZSALES}, {_MID} " + normed("CASE WHEN v > h AND v > 0 THEN v - h ELSE 0e0 END + CASE WHEN v < b AND v < 0 THEN v - b ELSE 0e0 END + (b + h) / 2", "m"))
_add("invert", _array(zsales, A.invert), f"WITH {ZSALES} " + _OUT.format("-v", "s"))
_CHAIN = f"k AS (SELECT ts_id, t, v - 0.2e0 AS w FROM s), l AS (SELECT ts_id, t, w / max(abs(w)) {P} AS v FROM k), o AS (SELECT ts_id, t, sign(v) * pow(abs(v), 1.5e0) AS w FROM l), q AS (SELECT ts_id, t, w / max(abs(w)) {P} AS v FROM o)"
_add("chain_fixed", lambda s, d: src.to_long(R.apply_chains(zsales(s, d).crossJoin(F.broadcast(R.parse_chains(s.range(1).select(F.lit("0 |> shift:-0.20 | exp:1.50 | inv:-1.00").alias("line"))).select("steps"))), arrow_steps=0).select("ts_id", "values"), X.DIGITS), f"WITH {ZSALES}, {_CHAIN} " + _OUT.format("-v", "q"))

# ---- ordered sums and constraints
_sums = lambda falling: lambda s, d: O.running(src.to_long(down(s, d)), falling=falling).select("ts_id", "t", X.rounded(F.col("sum")).alias("v"))
_add("cum_energy_fwd", _sums(False), f"WITH {DOWN} " + _OUT.format("sum(v) OVER (PARTITION BY ts_id ORDER BY t)", "e"))
_add("cum_energy_bwd", _sums(True), f"WITH {DOWN} " + _OUT.format("sum(v) OVER (PARTITION BY ts_id ORDER BY t DESC)", "e"))
_add("fix_mean", _array(src.event_series, lambda v: A.fix_mean(A.norm_maxabs(v))), f"WITH {EVENTS} " + _OUT.format(f"CASE WHEN avg(v) {P} > 0 THEN -v ELSE v END / max(abs(v)) {P}", "s"))
_add("fix_sign_negative", _array(zsales, A.fix_sign_negative), f"WITH {ZSALES} " + normed(f"v - greatest(max(v) {P}, 0e0)", "s"))
_LIMITS = f"f AS (SELECT ts_id, t, v, sum(v) OVER (PARTITION BY ts_id ORDER BY t) AS fwd, sum(v) OVER (PARTITION BY ts_id ORDER BY t DESC) AS bwd FROM e)"
_add("bounds_valid", lambda s, d: R.bounds(src.to_long(down(s, d))), f"WITH {DOWN}, {_LIMITS} SELECT ts_id, max(fwd) <= 0 AS forward_valid, max(bwd) <= 0 AS backward_valid FROM f GROUP BY ts_id")
_NEG = f"""neg AS (SELECT ts_id, t, (v - greatest(max(v) {P}, 0e0)) AS w FROM s), e AS (SELECT ts_id, t, w / max(abs(w)) {P} AS v FROM neg)"""
_add(
    "verify_constraints",
    lambda s, d: R.verified(src.to_long(zsales(s, d).select("ts_id", A.fix_sign_negative(F.col("values")).alias("values"))), "only_neg").select("ts_id"),
    f"WITH {ZSALES}, {_NEG}, {_LIMITS} SELECT ts_id FROM f GROUP BY ts_id HAVING avg(v) < 0 AND max(abs(v)) = 1 AND max(v) <= 0 AND max(fwd) <= 0 AND max(bwd) <= 0",
)
_add(
    "quarter_sine_pass",
    lambda s, d: R.quarter_sine(src.to_long(down(s, d))),
    f"""WITH {DOWN}, f AS (SELECT ts_id, t, v, sum(v) OVER (PARTITION BY ts_id ORDER BY t) AS c FROM e),
p AS (SELECT ts_id, max(c) AS top FROM f GROUP BY ts_id), pk AS (SELECT f.ts_id, min(t) AS peak, any_value(top) AS top FROM f JOIN p ON f.ts_id = p.ts_id AND c = top GROUP BY f.ts_id),
q AS (SELECT f.ts_id, t, v, peak, top, CASE WHEN t > peak THEN 0e0 WHEN peak = 0 THEN 1e0 ELSE cos(pi() / 2 * t / peak) END AS ramp FROM f JOIN pk ON f.ts_id = pk.ts_id)
SELECT ts_id, t::INT AS t, round(CASE WHEN top <= 0 THEN v ELSE v - 1.001e0 * top * ramp / sum(ramp) {P} END, 6) + 0e0 AS v FROM q""",
)
_add("init_validity", lambda s, d: R.valid_initials(src.to_long(down(s, d))), f"WITH {DOWN}, f AS (SELECT ts_id, sum(v) OVER (PARTITION BY ts_id ORDER BY t) AS c, sum(v) {P} AS total FROM e) SELECT ts_id FROM f GROUP BY ts_id HAVING max(c) <= 0 AND min(c - total) >= -1e-9")
_EDGES_N = 20
_add(
    "block_min_resample",
    lambda s, d: R.block_minimum(src.to_long(zsales(s, d)), _EDGES_N),
    f"WITH {ZSALES}, n AS (SELECT *, count(*) {P} AS n FROM s), b AS (SELECT ts_id, k, n.v FROM n JOIN range({_EDGES_N}) r(k) ON t >= round_even(k * n / {float(_EDGES_N)}e0, 0) AND t < round_even((k + 1) * n / {float(_EDGES_N)}e0, 0)) SELECT ts_id, k::INT AS t, round(min(v), 6) + 0e0 AS v FROM b GROUP BY ts_id, k",
)

# ---- recombination
_add(
    "superpos_fixed",
    lambda s, d: src.to_long(R.superpose(zsales(s, d), R.superposition_recipes(s, d, zsales(s, d))), X.DIGITS),
    f"""WITH {ZSALES}, ids AS (SELECT ts_id, row_number() OVER (ORDER BY ts_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts_id FROM s)),
r AS (SELECT o.i AS out_id, a.ts_id AS src_id, (2 + (o.i + 3 * k) % 8) / 10e0 AS scale FROM ids o CROSS JOIN range(4) x(k) JOIN ids a ON a.i = (o.i * 7 + k * 13 + 5) % o.n WHERE k < 2 + o.i % 3),
w AS (SELECT out_id AS ts_id, t, sum(scale * v) AS v FROM r JOIN s ON s.ts_id = r.src_id GROUP BY 1, 2), cc AS (SELECT ts_id, t, v - avg(v) {P} AS v FROM w)
"""
    + _OUT.format(f"v / max(abs(v)) {P}", "cc"),
)
_add(
    "recipe_parse",
    lambda s, d: R.parse_chains(src.table(s, d, "supplier").select(F.concat(F.col("s_suppkey"), F.lit(" |> shift:-0."), F.lpad((F.col("s_suppkey") % 97).cast("string"), 2, "0"), F.lit(" | exp:1.30")).alias("line"))).select("src_id", F.posexplode("steps").alias("pos", "step")).select("src_id", "pos", "step.tag", "step.val"),
    "WITH l AS (SELECT s_suppkey AS src_id, s_suppkey || ' |> shift:-0.' || lpad((s_suppkey % 97)::VARCHAR, 2, '0') || ' | exp:1.30' AS line FROM supplier), x AS (SELECT src_id, p AS pos, split_part(split_part(split_part(line, ' |> ', 2), ' | ', p + 1), ':', 1) AS tag, split_part(split_part(split_part(line, ' |> ', 2), ' | ', p + 1), ':', 2)::DOUBLE AS val FROM l CROSS JOIN (VALUES (0), (1)) v(p)) SELECT src_id, pos::INT AS pos, tag, val FROM x",
)
_add(
    "selection_parse",
    lambda s, d: R.parse_selections(src.table(s, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey"), F.lit(" "), F.col("s_suppkey") % 10, F.lit(" - "), F.col("s_suppkey") % 10 + 40).alias("line"))),
    "SELECT 'S' || s_suppkey AS name, (s_suppkey % 10)::INT AS start, (s_suppkey % 10 + 40)::INT AS stop FROM supplier",
)

# ---- features
_add("amplitude_features", lambda s, d: X.amplitude(src.event_series(s, d)), f"""WITH {EVENTS}, a AS (SELECT ts_id, max(abs(v)) AS peak, avg(abs(v)) AS arv, sqrt(avg(v * v)) AS rms, avg(sqrt(abs(v))) AS root FROM s GROUP BY ts_id)
SELECT ts_id, round(arv, 6) + 0e0 AS arv, round(peak / nullif(rms, 0), 6) + 0e0 AS crest, round(rms / nullif(arv, 0), 6) + 0e0 AS shape, round(peak / nullif(arv, 0), 6) + 0e0 AS impulse, round(peak / nullif(root * root, 0), 6) + 0e0 AS clearance FROM a""")
_znorm = lambda s, d: src.to_long(zsales(s, d))
_add("diff_features", lambda s, d: X.differences(_znorm(s, d)), f"""WITH {ZSALES}, x AS (SELECT ts_id, v - lag(v) OVER w AS d, (lead(v) OVER w - 2 * v + lag(v) OVER w) / 2 AS d2 FROM s WINDOW w AS (PARTITION BY ts_id ORDER BY t))
SELECT ts_id, round(avg(d * d * d), 6) + 0e0 AS trev, round(avg(CASE WHEN d IS NULL THEN NULL WHEN abs(d) > 0.04e0 THEN 1e0 ELSE 0e0 END), 6) + 0e0 AS pnn40, round(avg(d), 6) + 0e0 AS mean_signed_diff, round(quantile_cont(d, 0.5), 6) + 0e0 AS median_signed_diff,
round(quantile_cont(abs(d), 0.5), 6) + 0e0 AS median_abs_diff, round(avg(d2), 6) + 0e0 AS mean_2nd_diff, round(avg(abs(d)), 6) + 0e0 AS mean_abs_diff FROM x GROUP BY ts_id""")
_add("location_features", lambda s, d: X.locations(src.event_points(s, d)), f"""WITH {EVENTS}, x AS (SELECT *, count(*) {P} AS n, max(v) {P} AS top FROM s)
SELECT ts_id, round(min(CASE WHEN v = top THEN t END)::DOUBLE / max(n), 6) + 0e0 AS loc_first_max, round((max(CASE WHEN v = top THEN t END) + 1)::DOUBLE / max(n), 6) + 0e0 AS loc_last_max, round(sum(t / 1000e0 * v * v) / nullif(sum(v * v), 0), 6) + 0e0 AS temporal_centroid FROM x GROUP BY ts_id""")
_add("level_features", lambda s, d: X.levels(_znorm(s, d)), f"""WITH {ZSALES}, x AS (SELECT *, avg(v) {P} AS m, lag(v) OVER (PARTITION BY ts_id ORDER BY t) AS b FROM s)
SELECT ts_id, round(avg(v), 6) + 0e0 AS mean, round(stddev_pop(v), 6) + 0e0 AS std, round(min(v), 6) + 0e0 AS min, round(max(v), 6) + 0e0 AS max, round(max(v) - min(v), 6) + 0e0 AS peak2peak, round(avg(CASE WHEN v > m THEN 1e0 ELSE 0e0 END), 6) + 0e0 AS share_above_mean,
round(avg(abs(v - m)), 6) + 0e0 AS mean_diff_from_mean, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) + 0e0 AS iqr, sum(CASE WHEN sign(v) <> sign(b) THEN 1 ELSE 0 END)::BIGINT AS cross_zero FROM x GROUP BY ts_id""")
_add("run_length_features", lambda s, d: X.longest_runs(src.event_points(s, d)), f"""WITH {EVENTS}, x AS (SELECT ts_id, t, v > avg(v) {P} AS high, coalesce(v < lag(v) OVER (PARTITION BY ts_id ORDER BY t), false) AS falls FROM s),
h AS (SELECT ts_id, max(n) AS n FROM (SELECT ts_id, count(*) AS n FROM (SELECT ts_id, t - row_number() OVER (PARTITION BY ts_id ORDER BY t) AS g FROM x WHERE high) GROUP BY ts_id, g) GROUP BY ts_id),
f AS (SELECT ts_id, max(n) AS n FROM (SELECT ts_id, count(*) AS n FROM (SELECT ts_id, t - row_number() OVER (PARTITION BY ts_id ORDER BY t) AS g FROM x WHERE falls) GROUP BY ts_id, g) GROUP BY ts_id)
SELECT i.ts_id, coalesce(h.n, 0) AS longest_above_mean, coalesce(f.n, 0) AS longest_decrease FROM (SELECT DISTINCT ts_id FROM s) i LEFT JOIN h ON h.ts_id = i.ts_id LEFT JOIN f ON f.ts_id = i.ts_id""")
for _b in (5, 10):
    _add(f"hist_mode{_b}", lambda s, d, b=_b: X.histogram_mode(src.event_points(s, d), b), f"""WITH {EVENTS}, x AS (SELECT *, min(v) {P} AS lo, (max(v) {P} - min(v) {P}) / {_b} AS w FROM s),
c AS (SELECT ts_id, coalesce(least(floor((v - lo) / nullif(w, 0)), {_b - 1}), 0) AS b, count(*) AS n, min(lo) AS lo, min(w) AS w FROM x GROUP BY 1, 2), f AS (SELECT *, max(n) {P} AS most FROM c)
SELECT ts_id, round(avg(lo + (b + 0.5e0) * w), 6) + 0e0 AS mode{_b} FROM f WHERE n = most GROUP BY ts_id""")
_add("acf_features", lambda s, d: X.acf_features(_znorm(s, d)), f"""WITH {ZSALES}, x AS (SELECT ts_id, t, v - avg(v) {P} AS x FROM s), e AS (SELECT ts_id, sum(x * x) AS e FROM x GROUP BY ts_id),
r AS (SELECT a.ts_id, b.t - a.t AS lag, sum(a.x * b.x) / nullif(any_value(e.e), 0) AS r FROM x a JOIN x b ON b.ts_id = a.ts_id AND b.t > a.t JOIN e ON e.ts_id = a.ts_id GROUP BY 1, 2),
y AS (SELECT *, coalesce(lag(r) OVER w, 1e0) AS before, lead(r) OVER w AS after FROM r WINDOW w AS (PARTITION BY ts_id ORDER BY lag))
SELECT ts_id, min(CASE WHEN r < 1 / exp(1e0) THEN lag END)::INT AS acf_timescale, min(CASE WHEN r <= 0 THEN lag END)::INT AS acf_first_zero, min(CASE WHEN r < before AND r < after THEN lag END)::INT AS acf_first_min FROM y GROUP BY ts_id""")
_add("trend_linearity", lambda s, d: X.trend(_znorm(s, d)), f"WITH {ZSALES} SELECT ts_id, round(regr_r2(v, t), 6) + 0e0 AS linearity FROM s GROUP BY ts_id")
_add("rolling_forecast_err", lambda s, d: X.forecast_error(_znorm(s, d)), f"WITH {ZSALES}, e AS (SELECT ts_id, CASE WHEN count(v) OVER w = 3 THEN v - avg(v) OVER w END AS e FROM s WINDOW w AS (PARTITION BY ts_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) SELECT ts_id, round(stddev_samp(e), 6) + 0e0 AS mean3_stderr FROM e GROUP BY ts_id")
_add("motif_entropy", lambda s, d: X.motif_entropy(src.event_points(s, d)), f"""WITH {EVENTS}, q AS (SELECT ts_id, quantile_cont(v, 1 / 3e0) AS a, quantile_cont(v, 2 / 3e0) AS b FROM s GROUP BY ts_id),
l AS (SELECT s.ts_id, t, (v > q.a)::INT + (v > q.b)::INT AS a FROM s JOIN q ON q.ts_id = s.ts_id), p AS (SELECT ts_id, a, lead(a) OVER (PARTITION BY ts_id ORDER BY t) AS b FROM l),
n AS (SELECT ts_id, a, b, count(*)::DOUBLE AS n FROM p WHERE b IS NOT NULL GROUP BY 1, 2, 3), r AS (SELECT ts_id, n / sum(n) {P} AS p FROM n) SELECT ts_id, round(-sum(p * ln(p)), 6) + 0e0 AS motif_entropy FROM r GROUP BY ts_id""")
_add("ami_lag2", lambda s, d: X.mutual_information(src.event_points(s, d)), f"""WITH {EVENTS}, x AS (SELECT *, min(v) {P} AS lo, (max(v) {P} - min(v) {P}) / 5 AS w FROM s), b AS (SELECT ts_id, t, coalesce(least(floor((v - lo) / nullif(w, 0)), 4), 0) AS a FROM x),
p AS (SELECT ts_id, a, lead(a, 2) OVER (PARTITION BY ts_id ORDER BY t) AS b FROM b), j AS (SELECT ts_id, a, b, count(*)::DOUBLE AS n FROM p WHERE b IS NOT NULL GROUP BY 1, 2, 3),
m AS (SELECT ts_id, n, sum(n) OVER (PARTITION BY ts_id, a) AS na, sum(n) OVER (PARTITION BY ts_id, b) AS nb, sum(n) {P} AS al FROM j) SELECT ts_id, round(sum(n / al * ln(n * al / (na * nb))), 6) + 0e0 AS ami2 FROM m GROUP BY ts_id""")
_add("spectral_features", lambda s, d: X.numeric(zsales(s, d)))
_add("shape_features", lambda s, d: X.shapes(zsales(s, d)))
_add("all_features", lambda s, d: compiled.features(zsales(s, d), compiled.rows_of(s, compiled.all_rows())))


def _catalogue(spark: SparkSession) -> DataFrame:
    """The native features: those of amplitude and level on the series as it is, the others on the z-scored one; two divided by the number of points."""
    as_is = ["arv", "crest", "shape", "impulse", "clearance", "mean", "std", "min", "max", "peak2peak", "share_above_mean", "mean_diff_from_mean", "iqr", "cross_zero"]
    rows = compiled.rows_of(spark, as_is, "norm_maxabs", "tsfel")
    scored = ["trev", "pnn40", "mean_signed_diff", "median_signed_diff", "median_abs_diff", "mean_2nd_diff", "mean_abs_diff", "longest_above_mean", "longest_decrease", "loc_first_max", "loc_last_max", "temporal_centroid"]
    scored += ["linearity", "mean3_stderr", "motif_entropy", "ami2", "acf_timescale", "acf_first_zero", "acf_first_min", ("mode5", "distribution mode bins=5"), ("mode10", "distribution mode bins=10"), ("p90", "distribution quantile q=0.9")]
    per_point = compiled.rows_of(spark, [("above_per_point", "level count_above_mean")], "_dont_care", "tsfresh").withColumn("norm_out", F.lit("len"))
    unused = compiled.rows_of(spark, ["not_there"], "_dont_care", "kats").withColumn("use", F.lit(False))
    return rows.unionByName(compiled.rows_of(spark, scored, "z_score", "kats")).unionByName(per_point).unionByName(unused)


#: The single families' SQL on the z-scored series; of the amplitude and level ones on the series as it is.
_FAMILIES = ("diff_features", "run_length_features", "location_features", "trend_linearity", "rolling_forecast_err", "motif_entropy", "ami_lag2", "acf_features", "hist_mode5", "hist_mode10")
_SCORED = f"{ZSALES.replace(' s AS (', ' s0 AS (').replace(' c AS (', ' c0 AS (').replace('FROM c)', 'FROM c0)')}, s AS (SELECT ts_id, t, (v - avg(v) {P}) / stddev_pop(v) {P} AS v FROM s0)"
_on_base = lambda name, base: "(" + _SQL[name].replace(f"WITH {EVENTS}", f"WITH {base}", 1).replace(f"WITH {ZSALES}", f"WITH {base}", 1) + ")"
_add(
    "catalogue_features",
    lambda s, d: compiled.features(zsales(s, d), _catalogue(s)),
    "SELECT * EXCLUDE (ts_id_), share_above_mean AS above_per_point FROM "
    + " JOIN ".join(f"{_on_base(n, ZSALES)} t{i}" + (" USING (ts_id)" if i else "") for i, n in enumerate(("amplitude_features", "level_features")))
    + "".join(f" JOIN {_on_base(n, _SCORED)} u{i} USING (ts_id)" for i, n in enumerate(_FAMILIES))
    + f" JOIN (WITH {_SCORED} SELECT ts_id AS ts_id_, round(quantile_cont(v, 0.9), 6) + 0e0 AS p90 FROM s GROUP BY 1) q ON q.ts_id_ = t0.ts_id",
)

# ---- feature space
_HIST = f"""hb AS (SELECT label, feature, v, CASE WHEN v BETWEEN 0 AND 1 THEN {BIN} END AS bin FROM fl), ht AS (SELECT feature, count(*) AS n FROM hb GROUP BY 1),
hist AS (SELECT g.feature, b AS bin, coalesce(c.c, 0)::DOUBLE / n AS freq FROM ht g CROSS JOIN range(10) r(b) LEFT JOIN (SELECT feature, bin, count(*) AS c FROM hb GROUP BY 1, 2) c ON c.feature = g.feature AND c.bin = b)"""
_HET = "round(avg(h), 6) + 0e0 AS heterogeneity FROM (SELECT {k} feature, sqrt(sum((freq - 0.1e0) * (freq - 0.1e0))) / sqrt(0.9e0) AS h FROM {t} GROUP BY ALL)"
_add("nd_hist", lambda s, d: S.nd_hist(src.feature_space(s, d), FEATURES).withColumn("freq", X.rounded(F.col("freq"))), f"WITH {SPACE}, {_HIST} SELECT feature, bin::INT AS bin, round(freq, 6) + 0e0 AS freq FROM hist")
_add("heterogeneity", lambda s, d: S.heterogeneity(src.feature_space(s, d), FEATURES), f"WITH {SPACE}, {_HIST} SELECT " + _HET.format(k="", t="hist"))
_add("heterogeneity_by_label", lambda s, d: S.heterogeneity(src.feature_space(s, d), FEATURES, "label"), f"""WITH {SPACE}, hb AS (SELECT label, feature, CASE WHEN v BETWEEN 0 AND 1 THEN {BIN} END AS bin FROM fl), ht AS (SELECT label, feature, count(*) AS n FROM hb GROUP BY 1, 2),
hist AS (SELECT g.label, g.feature, b AS bin, coalesce(c.c, 0)::DOUBLE / n AS freq FROM ht g CROSS JOIN range(10) r(b) LEFT JOIN (SELECT label, feature, bin, count(*) AS c FROM hb GROUP BY 1, 2, 3) c ON c.label = g.label AND c.feature = g.feature AND c.bin = b)
SELECT label, round(avg(h), 6) + 0e0 AS heterogeneity FROM (SELECT label, feature, sqrt(sum((freq - 0.1e0) * (freq - 0.1e0))) / sqrt(0.9e0) AS h FROM hist GROUP BY 1, 2) GROUP BY label""")
#: Nested sets: the rows whose label is below each of these.
LEVELS = (10, 5, 2)


def _by_level(spark: SparkSession, d: str) -> DataFrame:
    within = F.filter(F.array(*map(F.lit, LEVELS)), lambda x: x > F.col("label"))
    return D.with_kind(src.feature_space(spark, d)).withColumn("set_size", F.explode(within))


_add("set_info", lambda s, d: S.set_info(_by_level(s, d), FEATURES), f"""WITH {SPACE}, hs AS (SELECT lv AS set_size, part, feature, CASE WHEN v BETWEEN 0 AND 1 THEN {BIN} END AS bin
FROM fl JOIN (VALUES {", ".join(f"({x})" for x in LEVELS)}) l(lv) ON label < lv JOIN (VALUES ('both'), ('only_neg'), ('only_posneg')) p(part) ON part = 'both' OR (part = 'only_neg') = (label % 2 = 0)),
ht AS (SELECT set_size, part, feature, count(*) AS n FROM hs GROUP BY ALL), hc AS (SELECT set_size, part, feature, bin, count(*) AS c FROM hs GROUP BY ALL),
hist AS (SELECT g.set_size, g.part, g.feature, coalesce(c.c, 0)::DOUBLE / n AS freq FROM ht g CROSS JOIN range(10) r(b) LEFT JOIN hc c ON c.set_size = g.set_size AND c.part = g.part AND c.feature = g.feature AND c.bin = b)
SELECT set_size::INT AS set_size, part, round(avg(h), 6) + 0e0 AS heterogeneity FROM (SELECT set_size, part, feature, sqrt(sum((freq - 0.1e0) * (freq - 0.1e0))) / sqrt(0.9e0) AS h FROM hist GROUP BY ALL) GROUP BY ALL""")

for _name, _dense in (("sparse_cells", False), ("dense_cells", True)):
    _add(_name, lambda s, d, dense=_dense: S.cells(src.feature_space(s, d), FEATURES, 8, dense), f"WITH {SPACE}, {_HIST} SELECT feature, bin::INT AS bin, round(freq, 6) + 0e0 AS freq FROM hist ORDER BY round(freq, 6) {'DESC' if _dense else 'ASC'}, feature, bin LIMIT 8")
_long = lambda df: df.unpivot(["ts_id"], FEATURES, "feature", "v").withColumn("v", X.rounded(F.col("v")))
_RAW = "rl AS (SELECT ts_id, feature, v FROM fr UNPIVOT (v FOR feature IN (" + ", ".join(FEATURES) + ")))"
_SIG = "q AS (SELECT feature, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS i FROM {0} GROUP BY 1), sg AS (SELECT ts_id, x.feature, 1e0 / (1e0 + exp(-(v - m) / (1.35e0 * i + 1e-12))) AS v FROM {0} x JOIN q ON q.feature = x.feature)"
_WHI = "wq AS (SELECT feature, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM {0} GROUP BY 1), we AS (SELECT x.feature, min(CASE WHEN v >= a - 1.5e0 * (b - a) THEN v END) AS lo, max(CASE WHEN v <= b + 1.5e0 * (b - a) THEN v END) AS hi FROM {0} x JOIN wq ON wq.feature = x.feature GROUP BY 1), wc AS (SELECT ts_id, x.feature, least(greatest(v, lo), hi) AS v FROM {0} x JOIN we ON we.feature = x.feature)"
_add("sigmoid_norm", lambda s, d: _long(S.sigmoid(src.feature_space(s, d), FEATURES)), f"WITH {SPACE}, {_SIG.format('fl')} SELECT ts_id, feature, round(v, 6) + 0e0 AS v FROM sg")
_add("whisker_clip", lambda s, d: _long(S.clip_at_whiskers(src.feature_space(s, d), FEATURES)), f"WITH {SPACE}, {_WHI.format('fl')} SELECT ts_id, feature, round(v, 6) + 0e0 AS v FROM wc")
_add("feature_space", lambda s, d: _long(S.normalised(src.raw_features(s, d), FEATURES)), f"WITH {SPACE}, {_RAW}, {_SIG.format('rl')}, {_WHI.format('sg')} SELECT ts_id, feature, round((v - min(v) OVER (PARTITION BY feature)) / nullif(max(v) OVER (PARTITION BY feature) - min(v) OVER (PARTITION BY feature), 0), 6) + 0e0 AS v FROM wc")
_PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]
_PEAR = "cm AS (" + " UNION ALL ".join(f"SELECT '{a}' AS fi, '{b}' AS fj, greatest(abs(corr({a}, {b})), abs(corr({a}, sqrt({b}))), abs(corr({a}, {b} * {b})), abs(corr({a}, 1 / ({b} + 1e-10)))) AS r FROM fs" for a, b in _PAIRS) + ")"
_add("modified_pearson_matrix", lambda s, d: S.modified_pearson(src.feature_space(s, d), FEATURES), f"WITH {SPACE}, {_PEAR} SELECT fi, fj, round(r, 6) + 0e0 AS r FROM cm")
_LABELS = [(f, 1 + i // 3) for i, f in enumerate(FEATURES)]
_info = lambda s, d: S.cluster_correlations(S.correlation_matrix(src.feature_space(s, d), FEATURES), s.createDataFrame(_LABELS, "feature string, label int"))
_INFO = f"""lb(feature, label) AS (VALUES {', '.join(f"('{f}', {k})" for f, k in _LABELS)}), rm AS (SELECT fi, fj, round(r, 6) AS r FROM cm), fm AS (SELECT fi, fj, r FROM rm UNION ALL SELECT fj, fi, r FROM rm UNION ALL SELECT feature, feature, 1e0 FROM lb),
info AS (SELECT fi AS feature, a.label, round(avg(CASE WHEN a.label = b.label THEN r END), 9) AS inner_corr, round(avg(CASE WHEN a.label <> b.label THEN r END), 9) AS outer_corr FROM fm JOIN lb a ON a.feature = fi JOIN lb b ON b.feature = fj GROUP BY 1, 2)"""
_add("corr_inner_outer", _info, f"WITH {SPACE}, {_PEAR}, {_INFO} SELECT feature, label::INT AS label, inner_corr, outer_corr FROM info")
_add("first_per_cluster", lambda s, d: S.first_per_cluster(_info(s, d)), f"WITH {SPACE}, {_PEAR}, {_INFO}, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY inner_corr DESC, outer_corr, feature) AS n FROM info) SELECT label::INT AS label, feature FROM o WHERE n = 1")
_add("cluster_info", lambda s, d: S.cluster_summary(_info(s, d)), f"WITH {SPACE}, {_PEAR}, {_INFO} SELECT label::INT AS label, round(avg(inner_corr), 9) AS inner_mean, round(stddev_samp(inner_corr), 9) AS inner_std, round(min(inner_corr), 9) AS inner_min, round(max(inner_corr), 9) AS inner_max FROM info GROUP BY label")
_STATS = ", ".join(f"round({f}({c}_corr), 9) AS {c}_{n}" for c in ("inner", "outer") for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))
_OVER = ", ".join(f"round({f}({c}_mean), 9) AS {c}_{n}" for c in ("inner", "outer") for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))
_add(
    "cluster_statistics",
    lambda s, d: S.cluster_statistics(_info(s, d)),
    f"""WITH {SPACE}, {_PEAR}, {_INFO}, st AS (SELECT label, {_STATS} FROM info GROUP BY label), o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY inner_corr DESC, outer_corr, feature) AS n FROM info)
SELECT st.label::INT AS label, o.feature, st.* EXCLUDE (label) FROM st JOIN o ON o.label = st.label AND o.n = 1 UNION ALL SELECT NULL, NULL, {_OVER} FROM st""",
)
_add("hierarchical_clusters", lambda s, d: D.correlation_clusters(src.feature_space(s, d), FEATURES, 0.05))

# ---- neighbours and selection
_DIST = " + ".join(f"power(abs(p.{f} - q.{f}), 2)" for f in FEATURES)
_KNN = f"nn AS (SELECT q.ts_id AS q_id, p.ts_id, sqrt({_DIST}) AS dist, row_number() OVER (PARTITION BY q.ts_id ORDER BY sqrt({_DIST}), p.ts_id) AS rank FROM fs q JOIN fs p ON p.ts_id <> q.ts_id AND q.label = 3)"
_knn = lambda k: lambda s, d: (lambda fs: S.nearest(fs.filter("label = 3"), fs, FEATURES, k))(src.feature_space(s, d))
_add("nearest_point", _knn(1), f"WITH {SPACE}, {_KNN} SELECT q_id, rank::INT AS rank, ts_id, round(dist, 6) + 0e0 AS dist FROM nn WHERE rank = 1")
_add("knn_top3", _knn(3), f"WITH {SPACE}, {_KNN} SELECT q_id, rank::INT AS rank, ts_id, round(dist, 6) + 0e0 AS dist FROM nn WHERE rank <= 3")
_add("second_nearest", lambda s, d: _knn(2)(s, d).filter("rank = 2").select("q_id", "dist"), f"WITH {SPACE}, {_KNN} SELECT q_id, round(dist, 6) + 0e0 AS dist FROM nn WHERE rank = 2")
_add("bin_candidates", lambda s, d: src.feature_space(s, d).filter(F.col("f0").between(0.4, 0.5)).select("ts_id"), f"WITH {SPACE} SELECT ts_id FROM fs WHERE f0 BETWEEN 0.4e0 AND 0.5e0")
_add("pool_minus_set", lambda s, d: (lambda fs: fs.select("ts_id").join(fs.filter("label < 5").select("ts_id"), "ts_id", "left_anti"))(src.feature_space(s, d)), "SELECT vec_id AS ts_id FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE label < 5)")
_add("semi_join_subset", lambda s, d: (lambda fs: fs.select("ts_id", "label").join(fs.filter("f1 > 0.5").select("ts_id"), "ts_id", "left_semi"))(src.feature_space(s, d)), f"WITH {SPACE} SELECT ts_id, label FROM fs WHERE f1 > 0.5e0")
_add("split_by_kind", lambda s, d: D.with_kind(src.feature_space(s, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("ts_id").alias("first"), F.max("ts_id").alias("last")), "SELECT CASE WHEN label % 2 = 0 THEN 'only_neg' ELSE 'only_posneg' END AS kind, count(*) AS n, min(vec_id + CASE WHEN label % 2 = 0 THEN 0 ELSE 1000000 END) AS first, max(vec_id + CASE WHEN label % 2 = 0 THEN 0 ELSE 1000000 END) AS last FROM embeddings GROUP BY 1")
_add("union_reoffset", lambda s, d: (lambda a: a.select("ts_id").unionByName(a.select((F.col("ts_id") + 1_000_000).alias("ts_id"))))(src.feature_space(s, d)), "SELECT vec_id AS ts_id FROM embeddings UNION ALL SELECT vec_id + 1000000 FROM embeddings")
_add("distinct_labels", lambda s, d: src.feature_space(s, d).select("label").distinct(), "SELECT DISTINCT label FROM embeddings")
_LCG = "((vec_id * 1103515245 + 12345) % 2147483648)"
_add("random_sample", lambda s, d: D.sample(src.raw_features(s, d), 40).select("ts_id"), f"SELECT vec_id AS ts_id FROM embeddings ORDER BY {_LCG}, vec_id LIMIT 40")
_NEST = "CASE WHEN vec_id % 8 = 0 THEN 3 WHEN vec_id % 4 = 0 THEN 2 WHEN vec_id % 2 = 0 THEN 1 ELSE 0 END"
_DEC = " + ".join(f"(f0 > {e!r}e0)::INT" for e in EDGES)
_nested = lambda s, d: D.sort_nested(src.feature_space(s, d).select("ts_id", F.col("f0").alias("mean"), F.col("f1").alias("iqr"), F.when(F.col("ts_id") % 8 == 0, 3).when(F.col("ts_id") % 4 == 0, 2).when(F.col("ts_id") % 2 == 0, 1).otherwise(0).alias("set_cluster")))
_SORTED = f"WITH {SPACE}, y AS (SELECT ts_id, {_NEST.replace('vec_id', 'ts_id')} AS set_cluster, {_DEC} AS mean_cluster, f1 FROM fs)"
_add("sort_nested_sets", _nested, f"{_SORTED} SELECT ts_id, set_cluster::INT AS set_cluster, mean_cluster::INT AS mean_cluster, (row_number() OVER (ORDER BY set_cluster DESC, mean_cluster DESC, f1, ts_id) - 1)::BIGINT AS pos FROM y")
_add("reindex_map", lambda s, d: _nested(s, d).select(F.col("pos").alias("ts_id"), F.col("ts_id").alias("source_id")), f"{_SORTED} SELECT (row_number() OVER (ORDER BY set_cluster DESC, mean_cluster DESC, f1, ts_id) - 1)::BIGINT AS ts_id, ts_id AS source_id FROM y")
_add("remove_closest", lambda s, d: D.remove_closest(src.feature_space(s, d).filter("label < 3"), FEATURES, 60).select("ts_id"))
_add("equilize", lambda s, d: D.equilize(D.sample(src.feature_space(s, d), 60), src.feature_space(s, d), FEATURES, max_loops=60).select("ts_id"))
_add("map_to_uniform", lambda s, d: D.map_to_uniform(src.feature_space(s, d), FEATURES[:3], 40).select("ts_id"))
_HALTON = lambda b, k: f"list_sum(list_transform(range({k}), lambda k: ((p_partkey // ({b} ** k)::BIGINT) % {b})::DOUBLE / {b} ** (k + 1)))"
_add(
    "halton_grid",
    lambda s, d: src.table(s, d, "part").select("p_partkey", *[F.round(h, 9).alias(f"h{i}") for i, h in enumerate(halton.points(F.col("p_partkey"), 4))]),
    "SELECT p_partkey, " + ", ".join(f"round({_HALTON(b, k)}, 9) AS h{i}" for i, (b, k) in enumerate(((2, 40), (3, 30), (5, 20), (7, 18)))) + " FROM part",
)
_add("decluster_chain", lambda s, d: D.chain(src.feature_space(s, d), FEATURES[:4], (64, 32, 16), max_loops=40))

# ---- interpolation and the whole pool
_add("resample_pchip", lambda s, d: src.to_long(R.resampled(zsales(s, d), 120), X.DIGITS))
_add("time_distort", lambda s, d: src.to_long(R.distorted(zsales(s, d), 7), X.DIGITS))
_add("fix_bounds", lambda s, d: src.to_long(R.bounds_fixed(down(s, d)), X.DIGITS))
_add("concat_recipe", lambda s, d: src.to_long(R.concatenated(R.resampled(zsales(s, d), 1000), R.concat_recipes(s, zsales(s, d))), X.DIGITS))
_add("manifold", lambda s, d: R.manifold(R.resampled(zsales(s, d), 200), "only_neg", seed=42, samples=200, n_concat=100, n_superpos=200, per_series=2))

# ---- recipes as text
_lines = lambda s, d, line: src.table(s, d, "supplier").selectExpr("s_suppkey AS out_id", f"concat_ws('', {line}) AS line")
_concats = lambda s, d: R.parse_concats(_lines(s, d, "s_suppkey, ', ', s_suppkey % 7, ' | ', s_suppkey % 50, ', 23 | ', s_suppkey % 50 + 300, ', 460 | 350, ', 200 + s_suppkey % 9"))
_superpositions = lambda s, d: R.parse_superpositions(_lines(s, d, "s_suppkey, ', ', s_suppkey % 7, ' | 0.', 2 + s_suppkey % 8, ', 0.5'"))
_add("concat_recipe_parse", _concats, "SELECT s_suppkey AS out_id, 0 AS pos, s_suppkey::BIGINT AS src_id, (s_suppkey % 50)::INT AS start, 300 AS size, 350 AS points FROM supplier UNION ALL SELECT s_suppkey, 1, s_suppkey % 7, 23, 437, (200 + s_suppkey % 9)::INT FROM supplier")
_add("concat_recipe_text", lambda s, d: R.concat_text(_concats(s, d)), "SELECT s_suppkey AS out_id, s_suppkey || ', ' || s_suppkey % 7 || ' | ' || s_suppkey % 50 || ', 23 | ' || s_suppkey % 50 + 300 || ', 460 | 350, ' || 200 + s_suppkey % 9 AS line FROM supplier".replace("s_suppkey % 50 + 300", "(s_suppkey % 50 + 300)").replace("200 + s_suppkey % 9", "(200 + s_suppkey % 9)"))
_add("superpos_recipe_parse", _superpositions, "SELECT s_suppkey AS out_id, s_suppkey::BIGINT AS src_id, ('0.' || (2 + s_suppkey % 8))::DOUBLE AS scale FROM supplier UNION ALL SELECT s_suppkey, s_suppkey % 7, 0.5e0 FROM supplier")
_add("superpos_recipe_text", lambda s, d: R.superposition_text(_superpositions(s, d)), """WITH x AS (SELECT s_suppkey AS out_id, s_suppkey::BIGINT AS src_id, '0.' || (2 + s_suppkey % 8) AS scale FROM supplier UNION ALL SELECT s_suppkey, s_suppkey % 7, '0.5' FROM supplier)
SELECT out_id, string_agg(src_id, ', ' ORDER BY src_id, scale) || ' | ' || string_agg(scale, ', ' ORDER BY src_id, scale) AS line FROM x GROUP BY out_id""")
_add("selection_text", lambda s, d: R.selection_text(src.table(s, d, "supplier").selectExpr("concat_ws('', 'S', s_suppkey) AS name", "s_suppkey % 10 AS start", "s_suppkey % 10 + 40 AS stop")), "SELECT 'S' || s_suppkey || ' ' || (s_suppkey % 10) || ' - ' || (s_suppkey % 10 + 40) AS line FROM supplier")

# ---- from features to numbered sets
_NORMED = """wn AS (SELECT ts_id, feature, (v - min(v) OVER (PARTITION BY feature)) / nullif(max(v) OVER (PARTITION BY feature) - min(v) OVER (PARTITION BY feature), 0) AS v FROM wc)"""
_add(
    "reduced_space",
    lambda s, d: T.reduced_space(src.raw_features(s, d), FEATURES, ["f0", "f2", "f7"], exclude=("f6",), repair="f7").unpivot(["ts_id"], ["f0", "f2", "f7"], "feature", "v").withColumn("v", X.rounded(F.col("v"))),
    f"""WITH {SPACE}, {_RAW}, {_SIG.format('rl')}, {_WHI.format('sg')}, {_NORMED}, ok AS (SELECT ts_id FROM wn WHERE feature = 'f7' AND v >= 0.1e0), l AS (SELECT wn.* FROM wn JOIN ok ON ok.ts_id = wn.ts_id WHERE feature IN ('f0', 'f2', 'f7'))
SELECT ts_id, feature, round(CASE WHEN feature = 'f7' THEN (v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0) ELSE v END, 6) + 0e0 AS v FROM l WINDOW w AS (PARTITION BY feature)""",
)
def spread_space(spark: SparkSession, d: str) -> DataFrame:
    """Both kinds reduced in one space and spread within each, by stages that a later run reads."""
    space = T.staged_space(Store(spark), _halves(spark, d), FEATURES, ["f0", "f2", "f7"], exclude=["f6"], repair="f7")
    return space.unpivot(["ts_id", "kind"], ["f0", "f2", "f7"], "feature", "v").withColumn("v", X.rounded(F.col("v")))


_add(
    "spread_space",
    spread_space,
    f"""WITH {SPACE}, {_RAW}, {_SIG.format('rl')}, {_WHI.format('sg')}, {_NORMED}, ok AS (SELECT ts_id FROM wn WHERE feature = 'f7' AND v >= 0.1e0),
l AS (SELECT wn.*, CASE WHEN label % 2 = 0 THEN 'only_neg' ELSE 'only_posneg' END AS kind FROM wn JOIN ok ON ok.ts_id = wn.ts_id JOIN fr ON fr.ts_id = wn.ts_id WHERE feature IN ('f0', 'f2', 'f7'))
SELECT ts_id + CASE WHEN kind = 'only_neg' THEN 0 ELSE 1000000 END AS ts_id, kind, feature, round((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 6) + 0e0 AS v FROM l WINDOW w AS (PARTITION BY kind, feature)""",
)
_halves = lambda s, d: (lambda f: {k: f.filter(F.col("label") % 2 == i) for i, k in enumerate(R.KINDS)})(src.raw_features(s, d))
_add("joint_space", lambda s, d: T.joint_space(_halves(s, d), FEATURES).unpivot(["pool", "ts_id"], FEATURES, "feature", "v").withColumn("v", X.rounded(F.col("v"))), f"WITH {SPACE}, {_RAW}, {_SIG.format('rl')}, {_WHI.format('sg')}, {_NORMED} SELECT CASE WHEN label % 2 = 0 THEN 'only_neg' ELSE 'only_posneg' END AS pool, fr.ts_id, feature, round(v, 6) + 0e0 AS v FROM wn JOIN fr ON fr.ts_id = wn.ts_id")
_level_ids = lambda s, d: T.numbered(_by_level(s, d))
_IDS = f"""lv AS (SELECT lv AS set_size, CASE WHEN label % 2 = 0 THEN 'only_neg' ELSE 'only_posneg' END AS kind, vec_id AS own, vec_id + CASE WHEN label % 2 = 0 THEN 0 ELSE 1000000 END AS source_id FROM embeddings JOIN (VALUES {", ".join(f"({x})" for x in LEVELS)}) l(lv) ON label < lv),
ids AS (SELECT *, row_number() OVER (PARTITION BY set_size, kind ORDER BY source_id) - 1 + CASE WHEN kind = 'only_neg' THEN 0 ELSE 1000000 END AS ts_id FROM lv)"""
_add("final_set_ids", _level_ids, f"WITH {_IDS} SELECT set_size::INT AS set_size, kind, source_id, ts_id FROM ids")
_add("remapped_sets", lambda s, d: T.remapped(D.with_kind(src.feature_space(s, d)).select("ts_id", X.rounded(F.col("f0")).alias("f0")), _level_ids(s, d)), f"WITH {SPACE}, {_IDS} SELECT set_size::INT AS set_size, ids.kind, source_id, ids.ts_id, round(f0, 6) + 0e0 AS f0 FROM ids JOIN fs ON fs.ts_id = ids.own")
_add("both_kinds_amplitude", lambda s, d: T.both_kinds({k: src.event_series(s, d).filter(F.col("ts_id") % 2 == i) for i, k in enumerate(R.KINDS)}, X.amplitude).select("ts_id", "kind", "arv"), f"WITH {EVENTS} SELECT ts_id + CASE WHEN ts_id % 2 = 0 THEN 0 ELSE 1000000 END AS ts_id, CASE WHEN ts_id % 2 = 0 THEN 'only_neg' ELSE 'only_posneg' END AS kind, round(avg(abs(v)), 6) + 0e0 AS arv FROM s GROUP BY s.ts_id")
for _which, _order in (("head", "vec_id"), ("tail", "vec_id DESC"), ("random", f"{_LCG}, vec_id")):
    _add(f"pick_{_which}", lambda s, d, w=_which: T.picked(src.raw_features(s, d), w, 12).select("ts_id"), f"SELECT vec_id AS ts_id FROM embeddings ORDER BY {_order} LIMIT 12")
_add("label_spans", lambda s, d: T.spans(src.raw_features(s, d)), "WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT label, (sum(n) OVER (ORDER BY label) - n)::BIGINT AS start, (sum(n) OVER (ORDER BY label))::BIGINT AS stop FROM n")
_add(
    "tiled_series",
    lambda s, d: src.to_long(T.tiled(zsales(s, d), 50, 3), X.DIGITS),
    f"WITH {ZSALES}, n AS (SELECT *, count(*) {P} AS n FROM s), b AS (SELECT ts_id, k, min(n.v) AS v FROM n JOIN range(16) r(k) ON t >= round_even(k * n / 16e0, 0) AND t < round_even((k + 1) * n / 16e0, 0) GROUP BY 1, 2) SELECT ts_id, (k + 16 * j)::INT AS t, round(v, 6) + 0e0 AS v FROM b CROSS JOIN range(4) x(j) WHERE k + 16 * j < 50",
)

# ---- relational work around the sets
_add(
    "scenario_union",
    lambda s, d: (lambda o: o.filter("o_orderpriority like '1%'").select("o_custkey", "o_totalprice").withColumn("seasonality", F.lit("monthly")).unionByName(o.filter("o_orderpriority like '2%'").select("o_custkey", "o_totalprice").withColumn("seasonality", F.lit("yearly"))))(src.table(s, d, "orders")).groupBy("seasonality", F.col("o_custkey").alias("ts_id")).agg(F.round(F.sum("o_totalprice"), 2).alias("outcome"), F.count(F.lit(1)).alias("n")),
    "WITH u AS (SELECT o_custkey, o_totalprice, 'monthly' AS seasonality FROM orders WHERE o_orderpriority LIKE '1%' UNION ALL SELECT o_custkey, o_totalprice, 'yearly' FROM orders WHERE o_orderpriority LIKE '2%') SELECT seasonality, o_custkey AS ts_id, round(sum(o_totalprice), 2) AS outcome, count(*) AS n FROM u GROUP BY 1, 2",
)
_add(
    "mod_hyb_quantiles",
    lambda s, d: src.table(s, d, "customer").select(F.try_divide(F.col("c_acctbal"), 1 + F.abs("c_acctbal") / 1000).alias("m"), "c_mktsegment").transform(lambda m: Q.exact(m, ["c_mktsegment"], (0.05, 0.1, 0.25, 0.5), "m")).select("c_mktsegment", *[X.rounded(F.col("q")[i]).alias(f"p{q}") for i, q in enumerate((5, 10, 25, 50))]),
    "WITH m AS (SELECT c_acctbal / (1 + abs(c_acctbal) / 1000e0) AS m, c_mktsegment FROM customer) SELECT c_mktsegment, " + ", ".join(f"round(quantile_cont(m, {q / 100}), 6) + 0e0 AS p{q}" for q in (5, 10, 25, 50)) + " FROM m GROUP BY 1",
)
_add(
    "retrieve_in_order",
    lambda s, d: (lambda fs: D.sample(fs, 30).select("ts_id").withColumn("pos", F.row_number().over(Window.orderBy("ts_id")) - 1).join(fs.select("ts_id", X.rounded(F.col("f0")).alias("f0")), "ts_id"))(src.feature_space(s, d)),
    f"WITH {SPACE}, c AS (SELECT vec_id AS ts_id FROM embeddings ORDER BY {_LCG}, vec_id LIMIT 30) SELECT c.ts_id, (row_number() OVER (ORDER BY c.ts_id) - 1)::INT AS pos, round(f0, 6) + 0e0 AS f0 FROM c JOIN fs ON fs.ts_id = c.ts_id",
)
_add(
    "outlier_distance_filter",
    lambda s, d: D.within_volume(_knn(1)(s, d)),
    f"""WITH {SPACE}, {_KNN}, n1 AS (SELECT q_id, ts_id, round(dist, 6) AS dist FROM nn WHERE rank = 1), st AS (SELECT min(dist) AS lo, max(dist) AS hi, greatest(count(*) // 2, 1) AS b FROM n1),
h AS (SELECT least(floor((dist - lo) / nullif((hi - lo) / b, 0)), b - 1) AS k, count(*) AS c, any_value(lo) AS lo, any_value((hi - lo) / b) AS w FROM n1 CROSS JOIN st GROUP BY 1), big AS (SELECT lo + (k + 1) * w AS edge, c FROM h WHERE c > 2),
bound AS (SELECT quantile_cont(edge, 0.75) AS bnd FROM big CROSS JOIN LATERAL (SELECT unnest(range(c))))
SELECT q_id, ts_id, dist FROM n1 CROSS JOIN bound WHERE bnd IS NULL OR dist <= 1.2e0 * bnd""",
)



# ---- long series: numbers and running sums with no task that holds one
_long_events = lambda s, d: O.numbered(src.table(s, d, "events").select(F.col("user_id").alias("ts_id"), "ts", "event_id", F.col("value").alias("v")), "ts_id", "ts", "event_id")
_add("event_positions", lambda s, d: _long_events(s, d).select("ts_id", "event_id", "t"), "SELECT user_id AS ts_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events")
_add(
    "event_running_sums",
    lambda s, d: (lambda p: O.running(O.running(p, "fwd", block=16), "bwd", falling=True, block=16))(_long_events(s, d)).select("ts_id", "t", X.rounded(F.col("fwd")).alias("fwd"), X.rounded(F.col("bwd")).alias("bwd")),
    f"WITH {EVENTS} SELECT ts_id, t, round(sum(v) OVER (PARTITION BY ts_id ORDER BY t), 6) + 0e0 AS fwd, round(sum(v) OVER (PARTITION BY ts_id ORDER BY t DESC), 6) + 0e0 AS bwd FROM s",
)

# ---- outcomes by position, and where pools come from
def outcomes_by_position(spark: SparkSession, d: str) -> DataFrame:
    """Customers in three files and outcomes in five, both in the order of the key, side by side by position alone."""
    rows = src.table(spark, d, "customer")
    features = kept_at(rows.select("c_custkey", "c_acctbal").repartitionByRange(3, "c_custkey").sortWithinPartitions("c_custkey"), "features")
    outcomes = kept_at(rows.select((F.col("c_custkey") * 2 + F.col("c_nationkey")).alias("outcome"), "c_custkey").repartitionByRange(5, "c_custkey").sortWithinPartitions("c_custkey").drop("c_custkey"), "outcomes")
    return positions.attached(spark, features, outcomes).select("pos", "c_custkey", "c_acctbal", "outcome")


_add("outcomes_by_position", outcomes_by_position, "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos, c_custkey, c_acctbal, c_custkey * 2 + c_nationkey AS outcome FROM customer")


def recipe_origins(spark: SparkSession, d: str) -> DataFrame:
    """Recipes on three levels over suppliers: of two suppliers, of two of these, and of one of either."""
    s = src.table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("k"))
    n = s.count()
    other = lambda m, a: F.pmod(F.col("k") * m + a, F.lit(n))
    pair = lambda base, a, b: s.select((F.col("k") + base).alias("ts_id"), F.explode(F.array(a, b)).alias("src_id"))
    made = pair(1_000_000, F.col("k"), other(7, 5)).unionByName(pair(2_000_000, F.col("k") + 1_000_000, other(3, 1) + 1_000_000)).unionByName(pair(3_000_000, F.col("k") + 2_000_000, other(11, 2) + 1_000_000))
    found = V.origins(made, s.select(F.col("k").alias("ts_id")))
    return found.select("ts_id", F.array_join(F.col("initial_ids").cast("array<string>"), ",").alias("initial_ids"), "depth")


_add(
    "recipe_origins",
    recipe_origins,
    """WITH RECURSIVE s AS (SELECT s_suppkey::BIGINT AS k, count(*) OVER () AS n FROM supplier),
made AS (SELECT k + 1000000 AS ts_id, unnest([k, (k * 7 + 5) % n]) AS src_id FROM s UNION ALL SELECT k + 2000000, unnest([k + 1000000, (k * 3 + 1) % n + 1000000]) FROM s UNION ALL SELECT k + 3000000, unnest([k + 2000000, (k * 11 + 2) % n + 1000000]) FROM s),
way(ts_id, src_id, depth) AS (SELECT k, k, 0 FROM s UNION SELECT ts_id, src_id, 1 FROM made UNION SELECT w.ts_id, m.src_id, w.depth + 1 FROM way w JOIN made m ON m.ts_id = w.src_id WHERE w.depth > 0)
SELECT ts_id, string_agg(DISTINCT src_id::VARCHAR, ',' ORDER BY src_id) AS initial_ids, max(depth)::INT AS depth FROM way WHERE src_id < 1000000 GROUP BY ts_id""".replace(
        "string_agg(DISTINCT src_id::VARCHAR, ',' ORDER BY src_id)", "array_to_string(list_sort(list(DISTINCT src_id)), ',')"
    ),
)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
