"""Series features: one row per series from long rows (id, time, value).

All calculators read the columns of one window pass (position, length, mean, neighbours) and become one aggregation on
``id``: a single exchange. n is the length, positions count from 0, deviations are of the population.
"""

from __future__ import annotations

import time as clock
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.columns import correlation

from .series_arrays import (  # noqa: F401
    ARRAY_CALCULATORS,
    agg_autocorrelation,
    array_features,
    ar_from_products,
    cwt_coefficient,
    cwt_peaks,
    partial_autocorrelation,
    welch_density,
)

MANY = 20  # settings of one calculator from which one pass over the array is cheaper than as many aggregates
REACH = 6  # furthest neighbour that a calculator uses
CORRIDOR = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)  # quantiles that bound the corridors of change_quantiles


def _c(name: str) -> Column:
    return F.col(name)


def windowed(series: DataFrame) -> DataFrame:
    """Position, length, mean, deviation, median, neighbours, repeats and run lengths of every point."""
    every = Window.partitionBy("id")
    order = every.orderBy("time")
    past = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = series.select("id", "time", F.col("value").alias("_x"))
    s = s.withColumns({"_t": F.row_number().over(order) - 1, "_n": F.count("*").over(every), "_mu": F.avg("_x").over(every), "_sd": F.stddev_pop("_x").over(every), "_med": F.median("_x").over(every)})
    s = s.withColumns({f"_lead{k}": F.lead("_x", k).over(order) for k in range(1, REACH + 1)} | {f"_lag{k}": F.lag("_x", k).over(order) for k in range(1, 6)})
    same = Window.partitionBy("id", "_x")
    s = s.withColumns({"_same": F.count("*").over(same), "_nth": F.row_number().over(same.orderBy("time"))})
    low, high = F.when(~(_c("_x") > _c("_mu")), _c("_t")), F.when(~(_c("_x") < _c("_mu")), _c("_t"))
    s = s.withColumns({"_run_up": _c("_t") - F.coalesce(F.max(low).over(past), F.lit(-1)), "_run_down": _c("_t") - F.coalesce(F.max(high).over(past), F.lit(-1))})
    s = s.withColumns({"_mass": F.try_divide(F.sum(F.abs("_x")).over(past), F.sum(F.abs("_x")).over(every)), "_edges": F.percentile("_x", F.array(*[F.lit(q) for q in CORRIDOR])).over(every)})
    for size in (5, 10):
        chunk = Window.partitionBy("id", F.floor(_c("_t") / size))
        s = s.withColumn(f"_mean{size}", F.when(_c("_t") % size == 0, F.avg("_x").over(chunk)))
    return s


def _skew() -> Column:
    n = F.count("_x")
    return F.when(n >= 3, F.try_divide(F.skewness("_x") * F.sqrt(n * (n - 1)), n - 2))


def _kurt() -> Column:
    n = F.count("_x")
    return F.when(n >= 4, F.try_divide((n - 1) * ((n + 1) * F.kurtosis("_x") + 6), (n - 2) * (n - 3)))


def _fft(coeff: int, attr: str) -> Column:
    angle = F.lit(2 * np.pi * coeff) * _c("_t") / _c("_n")
    re, im = F.sum(_c("_x") * F.cos(angle)), -F.sum(_c("_x") * F.sin(angle))
    value = {"real": re, "imag": im, "abs": F.sqrt(re * re + im * im)}[attr]
    return F.when(F.floor(F.count("_x") / 2) >= coeff, value)


def _peaks(n: int) -> Column:
    test = None
    for k in range(1, n + 1):
        one = (_c("_x") > _c(f"_lag{k}")) & (_c("_x") > _c(f"_lead{k}"))
        test = one if test is None else test & one
    return F.count_if(test)


def _trend(attr: str) -> Column:
    x, y = _c("_t"), _c("_x")
    return {"slope": F.regr_slope(y, x), "intercept": F.regr_intercept(y, x), "rvalue": correlation(y, x)}[attr]


def _chunk_trend(size: int) -> Column:
    return F.regr_slope(_c(f"_mean{size}"), F.when(_c(f"_mean{size}").isNotNull(), F.floor(_c("_t") / size)))


def _location(which: str, end: str) -> Column:
    v = _c("_x") if which == "maximum" else -_c("_x")
    n = F.count("_x")
    return F.max_by("_t", F.struct(v, -_c("_t"))) / n if end == "first" else (F.max_by("_t", F.struct(v, _c("_t"))) + 1) / n


def _autocorrelation(lag: int) -> Column:
    product = F.sum((_c("_x") - _c("_mu")) * (_c(f"_lead{lag}") - _c("_mu")))
    n, var = F.count("_x"), F.var_pop("_x")
    return F.when((n > lag) & (var > 0), F.try_divide(product, (n - lag) * var))


def _second() -> Column:
    n = F.count("_x")
    end = F.max_by("_x", "_t") - F.max(F.when(_c("_t") == _c("_n") - 2, _c("_x")))
    start = F.max(F.when(_c("_t") == 1, _c("_x"))) - F.min_by("_x", "_t")
    return F.when(n > 2, F.try_divide(end - start, 2 * (n - 2)))


def _mass_quantile(q: float) -> Column:
    """Share of the series after which the absolute values seen reach the share q of their sum; NULL for a series of zeros."""
    return F.min(F.when(_c("_mass") >= q - 1e-12, (_c("_t") + 1) / _c("_n")))  # a share that is q, summed in any order


def _energy_ratio(num_segments: int, segment_focus: int) -> Column:
    """Energy of one of the segments, the first ones a point longer where n is no multiple, over that of the series."""
    size, longer = F.floor(_c("_n") / num_segments), _c("_n") % num_segments
    start = segment_focus * size + F.least(F.lit(segment_focus), longer)
    inside = (_c("_t") >= start) & (_c("_t") < start + size + F.when(longer > segment_focus, 1).otherwise(0))
    energy = _c("_x") * _c("_x")
    return F.try_divide(F.sum(F.when(inside, energy).otherwise(0.0)), F.sum(energy))


def _change_quantiles(ql: float, qh: float, isabs: bool, f_agg: str) -> Column:
    """Mean or variance of the (absolute) steps whose two points lie between two quantiles of the series; 0 without such a step."""
    low, high = (F.get("_edges", F.lit(CORRIDOR.index(q))) for q in (ql, qh))
    low, high = low - 1e-12 * F.abs(low), high + 1e-12 * F.abs(high)  # an edge that is a value of the series, interpolated
    step = _c("_x") - _c("_lag1")
    inside = _c("_x").between(low, high) & _c("_lag1").between(low, high)
    steps = F.when(inside, F.abs(step) if isabs else step)
    return F.coalesce(F.avg(steps) if f_agg == "mean" else F.var_pop(steps), F.lit(0.0))


def _cid(normalize: bool) -> Column:
    """Length of the path of steps, of the series divided by its deviation where normalised (0 where it has none)."""
    length = F.sqrt(F.coalesce(F.sum(F.pow(_c("_x") - _c("_lag1"), F.lit(2))), F.lit(0.0)))
    return F.coalesce(F.try_divide(length, F.stddev_pop("_x")), F.lit(0.0)) if normalize else length


def _trend_error() -> Column:
    n = F.count("_x")
    rest = F.regr_syy("_x", "_t") - F.try_divide(F.pow(F.regr_sxy("_x", "_t"), F.lit(2)), F.regr_sxx("_x", "_t"))
    return F.when(n > 2, F.sqrt(F.try_divide(F.greatest(rest, F.lit(0.0)), (n - 2) * F.regr_sxx("_x", "_t"))))


#: calculator -> function of its parameters that gives a Column to aggregate; new ones may be registered
CALCULATORS: dict[str, Callable[..., Column]] = {
    "abs_energy": lambda: F.sum(_c("_x") * _c("_x")),
    "root_mean_square": lambda: F.sqrt(F.avg(_c("_x") * _c("_x"))),
    "mean": lambda: F.avg("_x"),
    "median": lambda: F.median("_x"),
    "maximum": lambda: F.max("_x"),
    "minimum": lambda: F.min("_x"),
    "sum_values": lambda: F.sum("_x"),
    "length": lambda: F.count("_x"),
    "absolute_maximum": lambda: F.max(F.abs("_x")),
    "quantile": lambda q: F.percentile("_x", q),
    "skewness": _skew,
    "kurtosis": _kurt,
    "fft_coefficient": _fft,
    "number_peaks": _peaks,
    "linear_trend": _trend,
    "agg_linear_trend": _chunk_trend,
    "first_location_of_maximum": lambda: _location("maximum", "first"),
    "last_location_of_maximum": lambda: _location("maximum", "last"),
    "first_location_of_minimum": lambda: _location("minimum", "first"),
    "last_location_of_minimum": lambda: _location("minimum", "last"),
    "longest_strike_above_mean": lambda: F.coalesce(F.max(F.when(_c("_x") > _c("_mu"), _c("_run_up"))), F.lit(0)),
    "longest_strike_below_mean": lambda: F.coalesce(F.max(F.when(_c("_x") < _c("_mu"), _c("_run_down"))), F.lit(0)),
    "variance": lambda: F.var_pop("_x"),
    "standard_deviation": lambda: F.stddev_pop("_x"),
    "mean_abs_change": lambda: F.avg(F.abs(_c("_x") - _c("_lag1"))),
    "absolute_sum_of_changes": lambda: F.coalesce(F.sum(F.abs(_c("_x") - _c("_lag1"))), F.lit(0.0)),
    "variance_larger_than_standard_deviation": lambda: (F.var_pop("_x") > F.stddev_pop("_x")).cast("int"),
    "autocorrelation": _autocorrelation,
    "c3": lambda lag: F.coalesce(F.avg(_c(f"_lead{2 * lag}") * _c(f"_lead{lag}") * _c("_x")), F.lit(0.0)),
    "time_reversal_asymmetry_statistic": lambda lag: F.coalesce(
        F.avg(_c(f"_lead{2 * lag}") * _c(f"_lead{2 * lag}") * _c(f"_lead{lag}") - _c(f"_lead{lag}") * _c("_x") * _c("_x")), F.lit(0.0)
    ),
    "mean_change": lambda: F.try_divide(F.max_by("_x", "_t") - F.min_by("_x", "_t"), F.count("_x") - 1),
    "mean_second_derivative_central": _second,
    "ratio_beyond_r_sigma": lambda r: F.count_if(F.abs(_c("_x") - _c("_mu")) > r * _c("_sd")) / F.count("_x"),
    "symmetry_looking": lambda r: (F.abs(F.avg("_x") - F.median("_x")) < r * (F.max("_x") - F.min("_x"))).cast("int"),
    "number_crossing_m": lambda m: F.count_if((_c("_x") > m) != (_c("_lag1") > m)),
    "large_standard_deviation": lambda r: (F.stddev_pop("_x") > r * (F.max("_x") - F.min("_x"))).cast("int"),
    "value_count": lambda value: F.count_if(_c("_x") == value),
    "sum_of_reoccurring_values": lambda: F.coalesce(F.sum(F.when((_c("_same") > 1) & (_c("_nth") == 1), _c("_x"))), F.lit(0.0)),
    "sum_of_reoccurring_data_points": lambda: F.coalesce(F.sum(F.when(_c("_same") > 1, _c("_x"))), F.lit(0.0)),
    "ratio_value_number_to_time_series_length": lambda: F.count_if(_c("_nth") == 1) / F.count("_x"),
    "index_mass_quantile": _mass_quantile,
    "energy_ratio_by_chunks": _energy_ratio,
    "change_quantiles": _change_quantiles,
    "cid_ce": _cid,
    "linear_trend_stderr": _trend_error,
    "count_above_mean": lambda: F.count_if(_c("_x") > _c("_mu")),
    "count_below_mean": lambda: F.count_if(_c("_x") < _c("_mu")),
    "count_above": lambda t: F.count_if(_c("_x") >= t) / F.count("_x"),
    "count_below": lambda t: F.count_if(_c("_x") <= t) / F.count("_x"),
    "range_count": lambda min, max: F.count_if((_c("_x") >= min) & (_c("_x") < max)),
    "variation_coefficient": lambda: F.try_divide(F.stddev_pop("_x"), F.avg("_x")),
    "has_duplicate": lambda: F.max((_c("_same") > 1).cast("int")),
    "has_duplicate_max": lambda: (F.max_by("_same", "_x") > 1).cast("int"),
    "has_duplicate_min": lambda: (F.min_by("_same", "_x") > 1).cast("int"),
    "percentage_of_reoccurring_values_to_all_values": lambda: F.count_if((_c("_same") > 1) & (_c("_nth") == 1)) / F.count_if(_c("_nth") == 1),
    "percentage_of_reoccurring_datapoints_to_all_datapoints": lambda: F.count_if(_c("_same") > 1) / F.count("_x"),
}

MINIMAL = {k: [{}] for k in ("sum_values", "median", "mean", "length", "standard_deviation", "variance", "root_mean_square", "maximum", "absolute_maximum", "minimum")}
CURATED = (
    {k: [{}] for k in ("abs_energy", "root_mean_square", "mean", "median", "maximum", "minimum", "sum_values", "skewness", "kurtosis", "variance", "standard_deviation", "mean_abs_change", "absolute_sum_of_changes",
                       "variance_larger_than_standard_deviation", "first_location_of_maximum", "last_location_of_maximum", "first_location_of_minimum", "last_location_of_minimum", "longest_strike_above_mean", "longest_strike_below_mean")}
    | {
        "fft_aggregated": [{"aggtype": a} for a in ("centroid", "variance", "skew", "kurtosis")],
        "number_cwt_peaks": [{"n": n} for n in (1, 5)],
        "quantile": [{"q": q} for q in (0.1, 0.25, 0.75, 0.9)],
        "fft_coefficient": [{"coeff": k, "attr": a} for k in range(5) for a in ("real", "imag", "abs")],
        "number_peaks": [{"n": n} for n in (1, 3, 5)],
        "linear_trend": [{"attr": a} for a in ("slope", "intercept", "rvalue")],
        "agg_linear_trend": [{"size": 5}, {"size": 10}],
        "autocorrelation": [{"lag": k} for k in (1, 2, 3, 5)],
        "c3": [{"lag": k} for k in (1, 2, 3)],
        "time_reversal_asymmetry_statistic": [{"lag": k} for k in (1, 2, 3)],
    }
)
FURTHER = {
    "mean_change": [{}], "mean_second_derivative_central": [{}], "ratio_beyond_r_sigma": [{"r": 1}], "symmetry_looking": [{"r": 0.1}], "number_crossing_m": [{"m": 50}], "large_standard_deviation": [{"r": 0.2}],
    "value_count": [{"value": 1.0}], "sum_of_reoccurring_values": [{}], "sum_of_reoccurring_data_points": [{}], "ratio_value_number_to_time_series_length": [{}],
}
SPECTRAL = {
    "partial_autocorrelation": [{"lag": k} for k in range(1, 10)],
    "agg_autocorrelation": [{"f_agg": f, "maxlag": 40} for f in ("mean", "median", "var")],
    "spkt_welch_density": [{"coeff": k} for k in (2, 5, 8)],
    "cwt_coefficients": [{"coeff": k, "w": w} for w in (2, 5, 10, 20) for k in range(15)],
}
MASS = {
    "index_mass_quantile": [{"q": k / 10} for k in range(1, 10)],
    "energy_ratio_by_chunks": [{"num_segments": 10, "segment_focus": k} for k in range(10)],
    "change_quantiles": [{"ql": lo, "qh": hi, "isabs": a, "f_agg": f} for lo in CORRIDOR for hi in CORRIDOR if lo < hi for a in (False, True) for f in ("mean", "var")],
    "cid_ce": [{"normalize": n} for n in (True, False)],
}
COUNTS = {
    "linear_trend_stderr": [{}], "count_above_mean": [{}], "count_below_mean": [{}], "count_above": [{"t": 0}], "count_below": [{"t": 0}], "range_count": [{"min": -1, "max": 1}, {"min": 0, "max": 100}],
    "variation_coefficient": [{}], "has_duplicate": [{}], "has_duplicate_max": [{}], "has_duplicate_min": [{}], "percentage_of_reoccurring_values_to_all_values": [{}],
    "percentage_of_reoccurring_datapoints_to_all_datapoints": [{}],
}
REGRESSIVE = {"ar_coefficient": [{"coeff": c, "k": 10} for c in range(11)], "augmented_dickey_fuller": [{"attr": a} for a in ("teststat", "pvalue", "usedlag")]}
COMPLEXITY = {
    "permutation_entropy": [{"tau": 1, "dimension": d} for d in range(3, 8)],
    "sample_entropy": [{}],
    "approximate_entropy": [{"m": 2, "r": r} for r in (0.1, 0.3, 0.5, 0.7, 0.9)],
    "lempel_ziv_complexity": [{"bins": b} for b in (2, 3, 5, 10, 100)],
    "binned_entropy": [{"max_bins": 10}],
    "fourier_entropy": [{"bins": b} for b in (2, 3, 5, 10, 100)],
    "mean_n_absolute_max": [{"number_of_maxima": k} for k in (3, 5, 7)],
    "benford_correlation": [{}],
}
WIDER = {
    "fft_coefficient": [{"coeff": k, "attr": a} for k in range(33) for a in ("real", "imag", "abs", "angle")],
    "quantile": [{"q": k / 10} for k in range(1, 10) if k != 5] + [{"q": 0.25}, {"q": 0.75}],
    "linear_trend": CURATED["linear_trend"],
    "ratio_beyond_r_sigma": [{"r": r} for r in (0.5, 1, 1.5, 2, 2.5, 3, 5, 6, 7, 10)],
    "symmetry_looking": [{"r": k / 20} for k in range(20)],
    "large_standard_deviation": [{"r": k / 20} for k in range(1, 20)],
    "number_crossing_m": [{"m": m} for m in (-1, 0, 1, 50)],
    "value_count": [{"value": v} for v in (0, 1, -1)],
}
PRESETS = {"minimal": MINIMAL, "curated": CURATED, "efficient": CURATED | FURTHER | SPECTRAL | MASS | COUNTS | REGRESSIVE | COMPLEXITY | WIDER}


def feature_name(calculator: str, params: dict) -> str:
    return "__".join(["value", calculator, *[f"{k}_{v}" for k, v in params.items()]]).replace(".", "_")


def extract_features(series: DataFrame, preset: str | dict = "curated") -> DataFrame:
    """One row per id; columns value__<calculator>__<parameter>_<value>. preset: a name, or {calculator: [parameters]}.

    Calculators that need a whole series at once (``ARRAY_CALCULATORS``) read it as an array made in the same aggregation, so
    the preset stays one exchange; they run in Arrow batches. Series are meant to be events or waves: such an array is held whole.
    """
    chosen = PRESETS[preset] if isinstance(preset, str) else preset
    every = [(c, p) for c, many in chosen.items() for p in many]
    whole = {c: many for c, many in chosen.items() if c not in CALCULATORS or c in ARRAY_CALCULATORS and len(many) > MANY}
    columns = [CALCULATORS[c](**p).alias(feature_name(c, p)) for c, p in every if c not in whole]
    if not whole:
        return windowed(series).groupBy("id").agg(*columns)
    names = [feature_name(c, p) for c, many in whole.items() for p in many]

    @F.pandas_udf(", ".join(f"`{n}` double" for n in names))
    def run(values):
        import pandas as pd

        rows = np.full((len(values), len(names)), np.nan)
        series = [np.asarray(v, float) for v in values]
        sizes = np.array([len(x) for x in series])
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            rows[at] = array_features(np.stack([series[k] for k in at]), whole)
        return pd.DataFrame(rows, columns=names)

    # series take time, not bytes: as many tasks as the session's exchanges have, where adaptive execution would merge them
    dealt = series.repartition(int(series.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    points = F.array_sort(F.collect_list(F.struct("_t", "_x"))).alias("_points")
    found = windowed(dealt).groupBy("id").agg(*columns, points).withColumn("_values", F.transform("_points", lambda s: s["_x"].cast("double")))
    found = found.withColumn("_arrays", run("_values"))
    nan = lambda n: F.when(~F.isnan(f"_arrays.{n}"), F.col(f"_arrays.{n}")).alias(n)
    return found.select("id", *[nan(feature_name(c, p)) if c in whole else F.col(feature_name(c, p)) for c, p in every])


def _lag_pairs(upto: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(upto + 1) for j in range(i, upto + 1)]


def _lag_sums(series: DataFrame, upto: int) -> DataFrame:
    """(id, n, p: array of (i, j, si, sj, s) in the order of ``_lag_pairs``), one row a series: the sums of ``lag_products``."""
    a = series.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("time", "value"))).alias("_s")).where(F.size("_s") > upto)
    a = a.select("id", F.transform("_s", lambda s: s["value"].cast("double")).alias("v")).withColumn("n", F.size("v") - upto)
    back = lambda k: F.slice("v", F.lit(upto + 1) - k, F.col("n"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    product = lambda p: total(F.zip_with(back(p["i"]), back(p["j"]), lambda x, y: x * y))
    lags = F.transform(F.sequence(F.lit(0), F.lit(upto)), lambda k: total(back(k)))
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _lag_pairs(upto)])
    sums = F.transform(pairs, lambda p: F.struct(p["i"].alias("i"), p["j"].alias("j"), F.get("l", p["i"]).alias("si"), F.get("l", p["j"]).alias("sj"), product(p).alias("s")))
    return a.withColumn("l", lags).select("id", F.col("n").cast("long").alias("n"), sums.alias("p"))


def lag_products(series: DataFrame, upto: int) -> DataFrame:
    """(id, i, j, n, si, sj, s): over the points that have ``upto`` predecessors their number, and the sums of the values i and j
    points back (0 <= i <= j <= upto) and of their product. One exchange on id; the sums run over the series' array."""
    return _lag_sums(series, upto).select("id", "n", F.inline("p")).select("id", "i", "j", "n", "si", "sj", "s")


def ar_model(series: DataFrame, k: int = 10) -> DataFrame:
    """(id, intercept, phi array of k): autoregressions with intercept from the lag products of each series.

    Series need more than 2 k + 1 points; the normal equations of a series are solved in an Arrow batch, which holds plain
    arrays of numbers.
    """
    rows = _lag_sums(series, k).where(F.col("n") > k + 1)
    rows = rows.select("id", "n", F.transform(F.slice("p", 1, k + 1), lambda r: r["sj"]).alias("sums"), F.transform("p", lambda r: r["s"]).alias("products"))
    at = np.array(_lag_pairs(k)).T

    def run(parts):
        import pandas as pd

        for part in parts:
            found = np.zeros((len(part), k + 1))
            for row, (n, sums, products) in enumerate(zip(part["n"], part["sums"], part["products"], strict=True)):
                square = np.zeros((k + 1, k + 1))
                square[at[0], at[1]] = square[at[1], at[0]] = products
                found[row] = ar_from_products(n, sums, square)
            yield pd.DataFrame({"id": part["id"], "intercept": found[:, 0], "phi": list(found[:, 1:])})

    kind = series.schema["id"].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, intercept double, phi array<double>")


def permutation_patterns(series: DataFrame, dimension: int = 3, tau: int = 1) -> DataFrame:
    """(id, pattern, n): how often each ordinal pattern of ``dimension`` points ``tau`` apart occurs; equal values rank by position."""
    order = Window.partitionBy("id").orderBy("time")
    frame = [F.struct((F.col("value") if i == 0 else F.lead("value", i * tau).over(order)).alias("x"), F.lit(i).alias("i")) for i in range(dimension)]
    frames = series.select("id", F.array(*frame).alias("f")).where(F.col("f")[dimension - 1]["x"].isNotNull())
    pattern = F.array_join(F.transform(F.array_sort("f"), lambda s: s["i"].cast("string")), "")
    return frames.groupBy("id", pattern.alias("pattern")).agg(F.count("*").alias("n"))


def permutation_entropies(series: DataFrame, dimension: int = 3, tau: int = 1) -> DataFrame:
    """(id, entropy) in nats of the ordinal patterns."""
    n = F.col("n")
    sums = permutation_patterns(series, dimension, tau).groupBy("id").agg(F.sum("n").alias("all"), F.sum(n * F.log(n)).alias("s"))
    return sums.select("id", (F.log("all") - F.col("s") / F.col("all")).alias("entropy"))


def fft_aggregated(series: DataFrame) -> DataFrame:
    """Centroid, variance, skew and kurtosis of the spectrum |rfft| over its bins; the last two are NULL where the variance is below 0.5."""
    every = Window.partitionBy("id")
    s = series.select("id", F.col("value").alias("x"), (F.row_number().over(every.orderBy("time")) - 1).alias("t"), F.count("*").over(every).alias("n"))
    bins = s.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / 2))))
    angle = F.lit(2 * np.pi) * F.col("k") * F.col("t") / F.col("n")
    re, im = F.sum(F.col("x") * F.cos(angle)), F.sum(F.col("x") * F.sin(angle))
    spectrum = bins.groupBy("id", "k").agg(F.sqrt(re * re + im * im).alias("a"))
    moment = lambda p: F.sum(F.pow("k", F.lit(p)) * F.col("a")) / F.sum("a")
    m = spectrum.groupBy("id").agg(*[moment(p).alias(f"m{p}") for p in (1, 2, 3, 4)])
    var = F.col("m2") - F.col("m1") ** 2
    skew = (F.col("m3") - 3 * F.col("m1") * var - F.col("m1") ** 3) / F.pow(var, F.lit(1.5))
    kurt = (F.col("m4") - 4 * F.col("m1") * F.col("m3") + 6 * F.col("m2") * F.col("m1") ** 2 - 3 * F.col("m1") ** 4) / F.pow(var, F.lit(2))
    return m.select("id", F.col("m1").alias("centroid"), var.alias("variance"), F.when(var >= 0.5, skew).alias("skew"), F.when(var >= 0.5, kurt).alias("kurtosis"))


def number_cwt_peaks(series: DataFrame, widths: tuple[int, ...] = (1, 5)) -> DataFrame:
    return extract_features(series, {"number_cwt_peaks": [{"n": w} for w in widths]})


def spectral_features(series: DataFrame, preset: dict = SPECTRAL) -> DataFrame:
    """Partial and aggregated autocorrelation, Welch density and wavelet coefficients."""
    return extract_features(series, preset)


def impute(features: DataFrame, by: str, cols: list[str]) -> DataFrame:
    """Per group and column: +inf to the largest finite value, -inf to the smallest, NULL and NaN to the median; 0 where nothing is finite."""
    inf = float("inf")
    finite = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != inf), F.col(c))
    stats = features.groupBy(by).agg(*[f(finite(c)).alias(f"_{k}_{c}") for c in cols for k, f in (("min", F.min), ("max", F.max), ("med", F.median))])

    def fixed(c: str) -> Column:
        v = F.when(F.col(c) == inf, F.col(f"_max_{c}")).when(F.col(c) == -inf, F.col(f"_min_{c}")).when(F.col(c).isNull() | F.isnan(c), F.col(f"_med_{c}")).otherwise(F.col(c))
        return F.coalesce(v, F.lit(0.0)).alias(c)

    return features.join(stats, by).select(*[fixed(c) if c in cols else F.col(c) for c in features.columns])


def series_to_array(series: DataFrame) -> DataFrame:
    """(id, values) in time order; series of fewer than two points go."""
    rows = series.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("time", "value"))).alias("_s"))
    return rows.where(F.size("_s") >= 2).select("id", F.transform("_s", lambda s: s["value"]).alias("values"))


def mean_pool(tokens: DataFrame) -> DataFrame:
    """(id, tokens: array of equal arrays) -> (id, emb): mean over the tokens."""
    cells = tokens.select("id", F.explode("tokens").alias("t")).select("id", F.posexplode("t").alias("dim", "x"))
    means = cells.groupBy("id", "dim").agg(F.avg("x").alias("m"))
    return means.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("s")).select("id", F.transform("s", lambda s: s["m"]).alias("emb"))


def fourier_encoder(values: list[np.ndarray], n_freq: int = 4, n_parts: int = 4) -> np.ndarray:
    """Built-in encoder: moduli of the first Fourier coefficients and means of equal parts."""
    out = []
    for x in values:
        spectrum = np.abs(np.fft.rfft(x))[:n_freq] / len(x)
        parts = [p.mean() if len(p) else 0.0 for p in np.array_split(x, n_parts)]
        out.append(np.concatenate([np.pad(spectrum, (0, n_freq - len(spectrum))), parts]))
    return np.array(out)


def embed_series(arrays: DataFrame, encoder=fourier_encoder, batch: int = 32) -> DataFrame:
    """(id, values) -> (id, emb) by an encoder of lists of arrays, in batches."""

    def run(parts):
        import pandas as pd

        for pdf in parts:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                yield pd.DataFrame({"id": part["id"], "emb": [list(map(float, e)) for e in encoder([np.asarray(v, float) for v in part["values"]])]})

    return arrays.mapInPandas(run, "id string, emb array<double>")


def attach_embeddings(meta: DataFrame, emb: DataFrame, key: str = "event_id") -> DataFrame:
    return meta.join(emb, key, "inner")


def estimate_cost(series: DataFrame, preset: str | dict = "curated", n: int = 2000) -> DataFrame:
    """Times the extraction of n series and scales it to all: tested, elapsed_ms, ms_per_series, total, estimate_ms."""
    ids = series.select("id").distinct().orderBy("id").limit(n)
    tested, total = ids.count(), series.select("id").distinct().count()
    began = clock.perf_counter()
    extract_features(series.join(ids, "id", "left_semi"), preset).write.format("noop").mode("overwrite").save()
    elapsed = 1000 * (clock.perf_counter() - began)
    each = elapsed / max(1, tested)
    return series.sparkSession.createDataFrame([(tested, elapsed, each, total, each * total)], "tested long, elapsed_ms double, ms_per_series double, total long, estimate_ms double")
