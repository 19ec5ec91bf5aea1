"""Scalar column functions: keys from names, unit conversions, labels, text normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACTOR = 10000


def to_sample_index(df: DataFrame) -> DataFrame:
    """Seconds to sample index and milliseconds to tenths, cut towards zero; baseline and deviation rounded half-even to 6 digits."""
    return df.select(
        *[c for c in df.columns if c not in ("peak_s", "start_s", "end_s", "tl_ms", "region_bl", "region_std")],
        *[(F.col(c) * FACTOR).cast("int").alias(c[:-2] + "_idx") for c in ("peak_s", "start_s", "end_s")],
        (F.col("tl_ms") * 10).cast("int").alias("tl"),
        F.bround("region_bl", 6).alias("region_bl"),
        F.bround("region_std", 6).alias("region_std"),
    )


def sample_name(filename: Column) -> Column:
    """Text before ' D_'; without that mark the last character goes."""
    return F.when(F.instr(filename, " D_") > 0, F.substring_index(filename, " D_", 1)).otherwise(F.left(filename, F.length(filename) - 1))


def class_label(sample: Column) -> Column:
    return F.split_part(sample, F.lit("_"), F.lit(1))


def derive_keys(df: DataFrame, name_col: str = "sample_name", ex_col: str = "ex_id") -> DataFrame:
    """file_number, machine_no and measured_at; NULL where the names do not match."""
    found = lambda col, pattern, k: F.nullif(F.regexp_extract(col, pattern, k), F.lit(""))
    ex = r"^(\d{8}_\d{4})\s+AN#(\d+)"
    return df.withColumns(
        {
            "file_number": found(name_col, r"#(\d+)\s*$", 1).try_cast("int"),
            "machine_no": found(ex_col, ex, 2).try_cast("int"),
            "measured_at": F.try_to_timestamp(found(ex_col, ex, 1), F.lit("yyyyMMdd_HHmm")),
        }
    )


def unmatched_counts(df: DataFrame) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_null") for c in ("file_number", "machine_no", "measured_at")])


def signal_features(df: DataFrame) -> DataFrame:
    return df.withColumns({"relative_signal": F.col("signal"), "absolute_signal": F.col("signal") + F.col("baseline")})


def global_id(sample: Column, event_id: Column) -> Column:
    return F.concat_ws("__", sample, event_id.cast("string"))


def numeric_coerce(df: DataFrame, cols: list[str]) -> DataFrame:
    """Numbers where the text is one; rows without are dropped."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in cols}).na.drop(subset=cols)


NAME_PATTERN = r"^([A-Z@0-9]+)(\d{4}_\d{4}_\d{4})_([A-Za-z0-9#]+).*"


def normalise_file_name(files: DataFrame, col: str = "name", pattern: str = NAME_PATTERN, ext: str = ".tdms") -> DataFrame:
    """Rename plan: new_name, and skipped where the name does not match."""
    part = lambda k: F.regexp_extract(col, pattern, k)
    ok = F.col(col).rlike(pattern)
    return files.withColumns({"new_name": F.when(ok, F.concat(part(1), part(2), F.lit("_"), part(3), F.lit(ext))), "skipped": ~ok})


#: fixed values: the physical categories and the name patterns that lead to them, in order
CATEGORY_PATTERNS = (
    ("peak count", r"number_peaks|number_cwt_peaks|number_crossing_m"),
    ("frequency content", r"fft_coefficient|fft_aggregated|spkt_welch_density|cwt_coefficients"),
    ("autocorrelation", r"autocorrelation|partial_autocorrelation|agg_autocorrelation|time_reversal_asymmetry|(^|_)c3(_|$)"),
    ("waveform asymmetry", r"skewness|kurtosis|symmetry_looking|ratio_beyond_r_sigma"),
    ("rise / fall", r"linear_trend|agg_linear_trend|first_location_of_maximum|last_location_of_maximum|first_location_of_minimum|last_location_of_minimum|longest_strike"),
    ("local variation", r"variance|standard_deviation|mean_abs_change|mean_change|absolute_sum_of_changes|variance_larger_than_standard_deviation|ratio_value_number_to_time_series_length|mean_second_derivative"),
    ("current level", r"abs_energy|sum_values|root_mean_square|maximum|minimum|median|(^|_)mean(_|$)|quantile|sum_of_reoccurring|large_standard_deviation|value_count"),
    ("event duration", r"length"),
)


def feature_category(name: Column, patterns=CATEGORY_PATTERNS, extra: dict[str, str] | None = None) -> Column:
    """Category by exact name, then by the first pattern found in the lower-case name, else 'other'."""
    out = None
    for k, v in (extra or {}).items():
        out = F.when(name == k, v) if out is None else out.when(name == k, v)
    for v, p in patterns:
        test = F.lower(name).rlike(p)
        out = F.when(test, v) if out is None else out.when(test, v)
    return out.otherwise("other")


def argmax_prob(df: DataFrame, prob: str = "prob") -> DataFrame:
    """pred: first position of the largest probability, from 0; pmax: that probability."""
    top = F.array_max(prob)
    return df.withColumns({"pred": (F.array_position(prob, top) - 1).cast("int"), "pmax": top})


def time_axis(df: DataFrame, dt: float = 1 / FACTOR, idx: str = "idx") -> DataFrame:
    return df.withColumn("t", F.col(idx) * F.lit(dt))


def status_of(n_t: Column, n_anal: Column) -> Column:
    """Null counts mean that the folder is missing."""
    return (
        F.when(n_t.isNull(), "NO_T_FOLDER").when(n_t == 0, "T_EMPTY").when(n_anal.isNull(), "NO_ANAL_FOLDER").when(n_anal == 0, "ANAL_NOT_DONE").otherwise("OK")
    )


def strip_name(name: Column) -> Column:
    return F.regexp_replace(F.replace(name, F.lit("@"), F.lit("")), r'[\\/:*?"<>|]+', "_")


def label_index(df: DataFrame, label: str = "label", out: str = "y") -> DataFrame:
    """Labels numbered in alphabetical order from 0; the window runs over the distinct labels only."""
    from pyspark.sql import Window

    names = df.select(label).distinct().withColumn(out, F.row_number().over(Window.orderBy(label)) - 1)
    return df.join(F.broadcast(names), label)


def correlation(a, b) -> Column:
    """Pearson correlation; NULL where either side does not vary."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
