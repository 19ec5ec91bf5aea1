"""Queries of series features."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import features as O

from . import fixtures as X
from .fixtures import SERIES
from .register import query

#: Sums differ in their last bits between engines; this moves exact decimals away from rounding ties.
NUDGE = 3.3e-8


def r6(column):
    return F.round(F.col(column) + NUDGE if isinstance(column, str) else column + NUDGE, 6)


_W = f"""
WITH s0 AS ({SERIES}), s AS (SELECT id, time, value AS x, row_number() OVER o - 1 AS t, count(*) OVER p AS n, avg(value) OVER p AS mu, stddev_pop(value) OVER p AS sd,
  {', '.join(f'lead(value, {k}) OVER o AS d{k}' for k in range(1, 7))}, {', '.join(f'lag(value, {k}) OVER o AS g{k}' for k in range(1, 6))},
  count(*) OVER (PARTITION BY id, value) AS same, row_number() OVER (PARTITION BY id, value ORDER BY time) AS nth
  FROM s0 WINDOW p AS (PARTITION BY id), o AS (PARTITION BY id ORDER BY time))
"""


def _run(spark, d, preset):
    out = O.extract_features(X.series(spark, d), preset)
    kinds = dict(out.dtypes)
    return out.select("id", *[(r6(c) if kinds[c] == "double" else F.col(c).cast("long")).alias(c) for c in out.columns[1:]])


def features_query(name: str, preset: dict, exprs: list[str], source: str = "s"):
    """exprs: SQL for each column of the preset in its order; ones that start with # are integers."""
    names = [O.feature_name(c, p) for c, many in preset.items() for p in many]
    shown = ", ".join(f"({e[1:]})::BIGINT AS \"{n}\"" if e[0] == "#" else f"round({e} + {NUDGE}, 6) AS \"{n}\"" for e, n in zip(exprs, names, strict=True))
    query(name, f"{_W} SELECT id, {shown} FROM {source} GROUP BY id")(lambda spark, d: _run(spark, d, preset))


one = lambda *names: {n: [{}] for n in names}

features_query("t1_t2_energy", one("abs_energy", "root_mean_square"), ["sum(x * x)", "sqrt(avg(x * x))"])
features_query("t3_level", one("mean", "median", "maximum", "minimum", "sum_values"), ["avg(x)", "median(x)", "max(x)", "min(x)", "sum(x)"])
features_query("t4_length", one("length", "absolute_maximum"), ["#count(*)", "max(abs(x))"])
features_query("t5_quantile", {"quantile": [{"q": q} for q in (0.1, 0.25, 0.75, 0.9)]}, [f"quantile_cont(x, {q})" for q in (0.1, 0.25, 0.75, 0.9)])
features_query("t6_t7_moments", one("skewness", "kurtosis"), ["CASE WHEN count(*) >= 3 THEN skewness(x) END", "CASE WHEN count(*) >= 4 THEN kurtosis(x) END"])
_re, _im = "sum(x * cos(2 * pi() * {k} * t / n))", "-sum(x * sin(2 * pi() * {k} * t / n))"
features_query(
    "t8_fft_coefficient", {"fft_coefficient": [{"coeff": k, "attr": a} for k in range(5) for a in ("real", "imag", "abs")]},
    [f"CASE WHEN count(*) // 2 >= {k} THEN {e.format(k=k)} END" for k in range(5) for e in (_re, _im, f"sqrt({_re} * {_re} + ({_im}) * ({_im}))")],
)
features_query("t10_number_peaks", {"number_peaks": [{"n": n} for n in (1, 3, 5)]}, ["#count(*) FILTER (" + " AND ".join(f"x > g{k} AND x > d{k}" for k in range(1, n + 1)) + ")" for n in (1, 3, 5)])
features_query("t12_linear_trend", {"linear_trend": [{"attr": a} for a in ("slope", "intercept", "rvalue")]}, ["regr_slope(x, t)", "regr_intercept(x, t)", "corr(x, t)"])
features_query(
    "t14_locations", one("first_location_of_maximum", "last_location_of_maximum", "first_location_of_minimum", "last_location_of_minimum"),
    ["arg_max(t, (x, -t)) / count(*)", "(arg_max(t, (x, t)) + 1) / count(*)", "arg_max(t, (-x, -t)) / count(*)", "(arg_max(t, (-x, t)) + 1) / count(*)"],
)
features_query("t16_spread", one("variance", "standard_deviation"), ["var_pop(x)", "stddev_pop(x)"])
features_query("t17_t18_changes", one("mean_abs_change", "absolute_sum_of_changes", "variance_larger_than_standard_deviation"), ["avg(abs(x - g1))", "coalesce(sum(abs(x - g1)), 0.0)", "#var_pop(x) > stddev_pop(x)"])
features_query(
    "t19_autocorrelation", {"autocorrelation": [{"lag": k} for k in (1, 2, 3, 5)]},
    [f"CASE WHEN count(*) > {k} AND var_pop(x) > 0 THEN sum((x - mu) * (d{k} - mu)) / ((count(*) - {k}) * var_pop(x)) END" for k in (1, 2, 3, 5)],
)
features_query("t20_c3", {"c3": [{"lag": k} for k in (1, 2, 3)]}, [f"coalesce(avg(d{2 * k} * d{k} * x), 0.0)" for k in (1, 2, 3)])
features_query("t21_time_reversal", {"time_reversal_asymmetry_statistic": [{"lag": k} for k in (1, 2, 3)]}, [f"coalesce(avg(d{2 * k} * d{2 * k} * d{k} - d{k} * x * x), 0.0)" for k in (1, 2, 3)])
features_query(
    "t22_further", O.FURTHER,
    ["(arg_max(x, t) - arg_min(x, t)) / nullif(count(*) - 1, 0)",
     "(arg_max(x, t) - max(x) FILTER (t = n - 2) - (max(x) FILTER (t = 1) - arg_min(x, t))) / nullif(2 * (count(*) - 2), 0)",
     "count(*) FILTER (abs(x - mu) > sd) / count(*)", "#abs(avg(x) - median(x)) < 0.1 * (max(x) - min(x))", "#count(*) FILTER ((x > 50) <> (g1 > 50))", "#stddev_pop(x) > 0.2 * (max(x) - min(x))",
     "#count(*) FILTER (x = 1.0)", "coalesce(sum(x) FILTER (same > 1 AND nth = 1), 0.0)", "coalesce(sum(x) FILTER (same > 1), 0.0)", "count(*) FILTER (nth = 1) / count(*)"],
)


@query("t13_agg_linear_trend", f"""
{_W}, c5 AS (SELECT id, t // 5 AS c, avg(x) AS m FROM s GROUP BY 1, 2), c10 AS (SELECT id, t // 10 AS c, avg(x) AS m FROM s GROUP BY 1, 2)
SELECT a.id, a.s AS value__agg_linear_trend__size_5, b.s AS value__agg_linear_trend__size_10
FROM (SELECT id, round(regr_slope(m, c) + 3.3e-8, 6) AS s FROM c5 GROUP BY id) a JOIN (SELECT id, round(regr_slope(m, c) + 3.3e-8, 6) AS s FROM c10 GROUP BY id) b ON a.id = b.id
""")
def t13(spark, d):
    return _run(spark, d, {"agg_linear_trend": [{"size": 5}, {"size": 10}]})


@query("t15_strikes", f"""
{_W}, r AS (SELECT id, x, mu, t, t - coalesce(max(t) FILTER (NOT x > mu) OVER w, -1) AS up, t - coalesce(max(t) FILTER (NOT x < mu) OVER w, -1) AS down FROM s
  WINDOW w AS (PARTITION BY id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT id, coalesce(max(up) FILTER (x > mu), 0)::BIGINT AS value__longest_strike_above_mean, coalesce(max(down) FILTER (x < mu), 0)::BIGINT AS value__longest_strike_below_mean FROM r GROUP BY id
""")
def t15(spark, d):
    return _run(spark, d, one("longest_strike_above_mean", "longest_strike_below_mean"))


@query("t9_fft_aggregated", f"""
{_W}, b AS (SELECT id, x, t, n, unnest(range(0, n // 2 + 1)) AS k FROM s),
a AS (SELECT id, k, sqrt(sum(x * cos(2 * pi() * k * t / n)) ** 2 + sum(x * sin(2 * pi() * k * t / n)) ** 2) AS a FROM b GROUP BY 1, 2),
m AS (SELECT id, sum(k * a) / sum(a) AS m1, sum(k * k * a) / sum(a) AS m2, sum(k * k * k * a) / sum(a) AS m3, sum(k * k * k * k * a) / sum(a) AS m4 FROM a GROUP BY id)
SELECT id, round(m1, 4) AS centroid, round(m2 - m1 * m1, 4) AS variance,
  round(CASE WHEN m2 - m1 * m1 >= 0.5 THEN (m3 - 3 * m1 * (m2 - m1 * m1) - m1 ** 3) / (m2 - m1 * m1) ** 1.5 END, 4) AS skew,
  round(CASE WHEN m2 - m1 * m1 >= 0.5 THEN (m4 - 4 * m1 * m3 + 6 * m2 * m1 ** 2 - 3 * m1 ** 4) / (m2 - m1 * m1) ** 2 END, 4) AS kurtosis FROM m
""")
def t9(spark, d):
    out = O.fft_aggregated(X.series(spark, d))
    return out.select("id", *[F.round(c, 4).alias(c) for c in out.columns[1:]])


@query("t11_number_cwt_peaks")
def t11(spark, d):
    return O.number_cwt_peaks(X.waves(spark, d))


@query("t23_spectral")
def t23(spark, d):
    return O.spectral_features(X.waves(spark, d))


_WAVES = f"WITH s0 AS ({SERIES}), w AS (SELECT id || ':' || (time // 64)::VARCHAR AS id, (time % 64)::BIGINT AS t, value AS x FROM s0), m AS (SELECT id, count(*) AS n, avg(x) AS mu, var_pop(x) AS v FROM w GROUP BY id)"
_AUTO = {"partial_autocorrelation": [{"lag": 1}, {"lag": 2}], "agg_autocorrelation": O.SPECTRAL["agg_autocorrelation"]}
_AUTO_EXPRS = [
    "CASE WHEN any_value(n) // 2 > 1 THEN max(r) FILTER (k = 1) END",
    "CASE WHEN any_value(n) // 2 > 2 THEN (max(r) FILTER (k = 2) - (max(r) FILTER (k = 1)) ** 2) / (1 - (max(r) FILTER (k = 1)) ** 2) END",
    *[f"coalesce({f}(r), 0.0)" for f in ("avg", "median", "var_pop")],
]


def _shown(preset: dict, exprs: list[str], digits: int) -> str:
    return ", ".join(f'round({e}, {digits}) AS "{O.feature_name(c, p)}"' for e, (c, p) in zip(exprs, [(c, p) for c, many in preset.items() for p in many], strict=True))


def _waves_run(spark, d, preset: dict, digits: int):
    out = O.extract_features(X.waves(spark, d), preset)
    return out.select("id", *[F.round(c, digits).alias(c) for c in out.columns[1:]])


@query("t23_autocorrelations", f"""
{_WAVES}, r AS (SELECT m.id, b.t - a.t AS k, CASE WHEN any_value(v) < 1e-10 THEN 0 ELSE sum((a.x - mu) * (b.x - mu)) / (any_value(n) - (b.t - a.t)) / any_value(v) END AS r, any_value(n) AS n
  FROM m LEFT JOIN w a ON a.id = m.id LEFT JOIN w b ON a.id = b.id AND b.t > a.t AND b.t - a.t <= 40 WHERE b.t IS NOT NULL OR m.n = 1 GROUP BY m.id, b.t - a.t)
SELECT id, {_shown(_AUTO, _AUTO_EXPRS, 5)} FROM r GROUP BY id
""")
def t23_autocorrelations(spark, d):
    return _waves_run(spark, d, _AUTO, 5)


_WELCH = {"spkt_welch_density": O.SPECTRAL["spkt_welch_density"]}


def _density(k: int) -> str:
    part = lambda f: f"sum((x - mu) * (0.5 - 0.5 * cos(2 * pi() * t / n)) * {f}(2 * pi() * {k} * t / n)) ** 2"
    twice = f"CASE WHEN any_value(n) % 2 = 0 AND {k} * 2 = any_value(n) THEN 1 ELSE 2 END"
    return f"CASE WHEN any_value(n) // 2 >= {k} THEN {twice} * ({part('cos')} + {part('sin')}) / sum((0.5 - 0.5 * cos(2 * pi() * t / n)) ** 2) END"


@query("t23_welch_density", f"{_WAVES} SELECT w.id, {_shown(_WELCH, [_density(k) for k in (2, 5, 8)], 3)} FROM w JOIN m ON w.id = m.id GROUP BY w.id")
def t23_welch(spark, d):
    return _waves_run(spark, d, _WELCH, 3)


_WAVELETS = {"cwt_coefficients": O.SPECTRAL["cwt_coefficients"]}


def _wavelet(coeff: int, w: int) -> str:
    m = f"least({10 * w}, n)"
    p = f"({coeff} + ({m} - 1) // 2 - t)"
    u = f"(({p} - ({m} - 1) / 2) / {w})"
    return f"CASE WHEN any_value(n) > {coeff} THEN coalesce(sum(x * 2 / (sqrt(3.0::DOUBLE * {w}) * pi() ** 0.25::DOUBLE) * (1 - {u} ** 2) * exp(-({u} ** 2) / 2)) FILTER ({p} BETWEEN 0 AND {m} - 1), 0) END"


@query("t23_wavelets", f"{_WAVES} SELECT w.id, {_shown(_WAVELETS, [_wavelet(**p) for p in _WAVELETS['cwt_coefficients']], 4)} FROM w JOIN m ON w.id = m.id GROUP BY w.id")
def t23_wavelets(spark, d):
    return _waves_run(spark, d, _WAVELETS, 4)


@query("t24_extract_features", f"{_W} SELECT id, round(sum(x) + 3.3e-8, 6) AS value__sum_values, round(median(x) + 3.3e-8, 6) AS value__median, round(avg(x) + 3.3e-8, 6) AS value__mean, count(*) AS value__length, round(stddev_pop(x) + 3.3e-8, 6) AS value__standard_deviation, round(var_pop(x) + 3.3e-8, 6) AS value__variance, round(sqrt(avg(x * x)) + 3.3e-8, 6) AS value__root_mean_square, round(max(x) + 3.3e-8, 6) AS value__maximum, round(max(abs(x)) + 3.3e-8, 6) AS value__absolute_maximum, round(min(x) + 3.3e-8, 6) AS value__minimum FROM s GROUP BY id")
def t24(spark, d):
    return _run(spark, d, "minimal")


_EDGES = "e AS (SELECT id AS eid, " + ", ".join(f"quantile_cont(x, {q}) AS e{round(q * 5)}" for q in O.CORRIDOR) + " FROM s GROUP BY id)"
_mass = lambda q: f"min((t + 1) / n) FILTER (mass >= {q})"
_segment = lambda k: f"sum(CASE WHEN t >= {k} * (n // 10) + least({k}, n % 10) AND t < {k + 1} * (n // 10) + least({k + 1}, n % 10) THEN x * x ELSE 0 END) / nullif(sum(x * x), 0)"


def _steps(ql, qh, isabs, f_agg):
    low, high = (f"(e{round(q * 5)} {sign} 1e-12 * abs(e{round(q * 5)}))" for q, sign in ((ql, "-"), (qh, "+")))
    step = "abs(x - g1)" if isabs else "x - g1"
    return f"coalesce({'avg' if f_agg == 'mean' else 'var_pop'}({step}) FILTER (x BETWEEN {low} AND {high} AND g1 BETWEEN {low} AND {high}), 0.0)"


_MASS_EXPRS = (
    [_mass(k / 10) for k in range(1, 10)] + [_segment(k) for k in range(10)] + [_steps(**p) for p in O.MASS["change_quantiles"]]
    + ["coalesce(sqrt(sum((x - g1) ** 2)) / nullif(any_value(sd), 0), 0.0)", "sqrt(coalesce(sum((x - g1) ** 2), 0.0))"]
)
_MASS_NAMES = [O.feature_name(c, p) for c, many in O.MASS.items() for p in many]


@query("t31_mass_and_corridors", f"""
{_W}, {_EDGES}, m AS (SELECT *, sum(abs(x)) OVER (PARTITION BY id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / nullif(sum(abs(x)) OVER (PARTITION BY id), 0) AS mass FROM s JOIN e ON id = eid)
SELECT id, {", ".join(f'round({x} + 3.3e-8, 6) AS "{n}"' for x, n in zip(_MASS_EXPRS, _MASS_NAMES, strict=True))} FROM m GROUP BY id
""")
def t31(spark, d):
    return _run(spark, d, O.MASS)


features_query(
    "t32_counts", O.COUNTS,
    ["sqrt((regr_syy(x, t) - regr_sxy(x, t) ** 2 / nullif(regr_sxx(x, t), 0)) / nullif((count(*) - 2) * regr_sxx(x, t), 0))",
     "#count(*) FILTER (x > mu)", "#count(*) FILTER (x < mu)", "count(*) FILTER (x >= 0) / count(*)", "count(*) FILTER (x <= 0) / count(*)", "#count(*) FILTER (x >= -1 AND x < 1)", "#count(*) FILTER (x >= 0 AND x < 100)",
     "stddev_pop(x) / nullif(avg(x), 0)", "#max((same > 1)::INT)", "#arg_max(same, x) > 1", "#arg_min(same, x) > 1", "count(*) FILTER (same > 1 AND nth = 1) / count(*) FILTER (nth = 1)", "count(*) FILTER (same > 1) / count(*)"],
)


@query("t33_lag_products", f"""
WITH s0 AS ({SERIES}), w AS (SELECT id || ':' || (time // 64)::VARCHAR AS id, time % 64 AS time, value FROM s0),
p AS (SELECT i, j FROM range(0, 4) a(i), range(0, 4) b(j) WHERE i <= j), n AS (SELECT id, max(time) + 1 AS n FROM w GROUP BY id HAVING count(*) > 3)
SELECT w.id, i::INTEGER AS i, j::INTEGER AS j, count(*) AS n, round(sum(w.value) + 3.3e-8, 4) AS si, round(sum(v.value) + 3.3e-8, 4) AS sj, round(sum(w.value * v.value) + 3.3e-8, 4) AS s
FROM p, n JOIN w ON w.id = n.id JOIN w v ON v.id = n.id WHERE w.time BETWEEN 3 - i AND n.n - 1 - i AND v.time = w.time + i - j GROUP BY ALL
""")
def t33(spark, d):
    out = O.lag_products(X.waves(spark, d), 3)
    return out.select("id", "i", "j", "n", *[F.round(F.col(c) + NUDGE, 4).alias(c) for c in ("si", "sj", "s")])


_PATTERNS = """
WITH s0 AS ({series}), f AS (SELECT id, value AS a, lead(value, 1) OVER o AS b, lead(value, 2) OVER o AS c FROM s0 WINDOW o AS (PARTITION BY id ORDER BY time)),
p AS (SELECT id, CASE WHEN a <= b AND b <= c THEN '012' WHEN a <= c AND c < b THEN '021' WHEN b < a AND a <= c THEN '102' WHEN b <= c AND c < a THEN '120' WHEN c < a AND a <= b THEN '201' ELSE '210' END AS pattern FROM f WHERE c IS NOT NULL),
n AS (SELECT id, pattern, count(*) AS n FROM p GROUP BY ALL)
"""


@query("t34_permutation_patterns", _PATTERNS.format(series=SERIES) + "SELECT * FROM n")
def t34(spark, d):
    return O.permutation_patterns(X.series(spark, d))


@query("t34_permutation_entropy", _PATTERNS.format(series=SERIES) + "SELECT id, round(ln(sum(n)) - sum(n * ln(n)) / sum(n) + 3.3e-8, 6) AS entropy FROM n GROUP BY id")
def t34_entropy(spark, d):
    return O.permutation_entropies(X.series(spark, d)).select("id", r6("entropy").alias("entropy"))


@query("t35_ar_model")
def t35(spark, d):
    return O.ar_model(X.waves(spark, d), 10)


@query("t36_complexity")
def t36(spark, d):
    return O.extract_features(X.waves(spark, d), O.COMPLEXITY)


@query("t37_unit_root")
def t37(spark, d):
    return O.extract_features(X.waves(spark, d), O.REGRESSIVE)


@query("t24_curated")
def t24_curated(spark, d):
    return O.extract_features(X.waves(spark, d), "curated")


@query("t24_efficient")
def t24_efficient(spark, d):
    return O.extract_features(X.waves(spark, d), "efficient")


_BAD = "SELECT l_returnflag AS sample, l_orderkey, l_linenumber, CASE WHEN l_partkey % 7 = 0 THEN NULL WHEN l_partkey % 7 = 1 THEN 'inf'::DOUBLE WHEN l_partkey % 7 = 2 THEN '-inf'::DOUBLE ELSE l_quantity END AS v, CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_tax END AS w FROM lineitem"


@query("t25_impute", f"""
WITH f AS ({_BAD}), m AS (SELECT sample, min(v) FILTER (isfinite(v)) AS lo, max(v) FILTER (isfinite(v)) AS hi, median(v) FILTER (isfinite(v)) AS mid, median(w) AS wmid FROM f GROUP BY sample)
SELECT f.sample, l_orderkey, l_linenumber, CASE WHEN v IS NULL THEN mid WHEN v = 'inf'::DOUBLE THEN hi WHEN v = '-inf'::DOUBLE THEN lo ELSE v END AS v, coalesce(w, wmid, 0.0)::DOUBLE AS w FROM f JOIN m ON f.sample = m.sample
""")
def t25(spark, d):
    li, inf = X.table(spark, d, "lineitem"), float("inf")
    k = F.col("l_partkey") % 7
    v = F.when(k == 0, None).when(k == 1, inf).when(k == 2, -inf).otherwise(F.col("l_quantity"))
    f = li.select(F.col("l_returnflag").alias("sample"), "l_orderkey", "l_linenumber", v.alias("v"), F.when(F.col("l_returnflag") != "A", F.col("l_tax")).alias("w"))
    return O.impute(f, "sample", ["v", "w"])


@query("t26_series_to_array", f"WITH s AS ({SERIES}) SELECT id, len(v) AS n, round(v[1] + 3.3e-8, 6) AS first, round(v[-1] + 3.3e-8, 6) AS last FROM (SELECT id, list(value ORDER BY time) AS v FROM s GROUP BY id HAVING count(*) >= 2)")
def t26(spark, d):
    a = O.series_to_array(X.series(spark, d))
    return a.select("id", F.size("values").cast("long").alias("n"), r6(F.get("values", F.lit(0))).alias("first"), r6(F.element_at("values", -1)).alias("last"))


@query("t27_mean_pool", "SELECT vec_id AS id, (i - 1)::INTEGER AS dim, round((embedding[i]::DOUBLE + embedding[i + 32]::DOUBLE) / 2 + 3.3e-8, 6) AS m FROM embeddings, (SELECT unnest(range(1, 33)) AS i)")
def t27(spark, d):
    e = X.table(spark, d, "embeddings")
    tokens = e.select(F.col("vec_id").alias("id"), F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)).alias("tokens"))
    return O.mean_pool(tokens).select("id", F.posexplode("emb").alias("dim", "m")).withColumn("m", r6("m"))


@query("t28_embed_series")
def t28(spark, d):
    return O.embed_series(O.series_to_array(X.series(spark, d)))


@query("t29_attach_embeddings", "SELECT event_id, event_type, label FROM events JOIN embeddings ON event_id = vec_id")
def t29(spark, d):
    emb = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("event_id"), "label", "embedding")
    return O.attach_embeddings(X.table(spark, d, "events").select("event_id", "event_type"), emb).drop("embedding")


@query("t30_estimate_cost")
def t30(spark, d):
    return O.estimate_cost(X.series(spark, d), "minimal", 20)
