"""Row filters: fixed limits, conditions given as a dictionary, outlier fences, confidence."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.columns import derive_keys

from .order import exact_percentiles

DERIVED = ("file_number", "machine_no", "measured_at")


def min_duration(df: DataFrame, limit: int = 10) -> DataFrame:
    return df.where(F.col("duration") > limit)


def range_filter(df: DataFrame, mode: str = "meta") -> DataFrame:
    """'meta': limits one inside the stated ones, ends included; 'strict': between the limits, ends excluded."""
    if mode == "meta":
        inside = F.col("duration").between(6, 999) & F.col("baseline").between(-299, 999) & F.col("signal").between(1e-12, 1000 - 1e-12)
    elif mode == "strict":
        open_ = lambda c, lo, hi: (F.col(c) > lo) & (F.col(c) < hi)
        inside = open_("duration", 10, 1000) & open_("baseline", -300, 300) & open_("signal", 10, 1000)
    else:
        raise ValueError(mode)
    return df.where(inside)


def _condition(column: str, spec: dict) -> Column:
    value = F.col(column)
    bound = (lambda x: F.lit(x).cast("timestamp")) if column == "measured_at" else F.lit
    out = value.isNotNull()
    if "min" in spec:
        out = out & (value >= bound(spec["min"]))
    if "max" in spec:
        out = out & (value <= bound(spec["max"]))
    if spec.get("include"):
        out = out & value.isin([x for x in spec["include"]])
    if spec.get("exclude"):
        out = out & ~value.isin([x for x in spec["exclude"]])
    return out


def apply_conditions(df: DataFrame, spec: dict | None) -> DataFrame:
    """Keeps rows that meet all conditions; NULL never does; unknown columns are skipped with a warning.

    file_number, machine_no and measured_at are derived where they are asked for and missing; a date as the upper bound
    of measured_at means its midnight.
    """
    if not spec:
        return df
    had = set(df.columns)
    if any(c in DERIVED and c not in had for c in spec) and {"sample_name", "ex_id"} <= had:
        df = derive_keys(df)
    for column, condition in spec.items():
        if column in df.columns:
            df = df.where(_condition(column, condition))
        else:
            warnings.warn(f"no column {column}: condition skipped", stacklevel=2)
    return df


def split_conditions(df: DataFrame, train: dict | None, mixture: dict | None) -> tuple[DataFrame, DataFrame]:
    """Two selections with independent conditions."""
    return apply_conditions(df, train), apply_conditions(df, mixture)


def filter_report(before: DataFrame, after: DataFrame) -> DataFrame:
    a = before.agg(F.count("*").alias("before"))
    return a.crossJoin(after.agg(F.count("*").alias("after"))).withColumn("excluded", F.col("before") - F.col("after"))


def outlier_bounds(df: DataFrame, col: str, by: list[str], k: float = 4.0, absolute: float = 10.0) -> DataFrame:
    """Tukey fences per group; where the interquartile range is below 1e-6 the fences are at plus and minus ``absolute``."""
    cells = df.groupBy(*by, col).agg(F.count("*").alias("_c"))
    quartiles = exact_percentiles(cells, col, "_c", by, {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    return quartiles.select(
        *by, F.when(iqr < 1e-6, -absolute).otherwise(F.col("q1") - k * iqr).alias("lower"), F.when(iqr < 1e-6, absolute).otherwise(F.col("q3") + k * iqr).alias("upper")
    )


def split_outliers(df: DataFrame, col: str, by: list[str], k: float = 4.0, absolute: float = 10.0) -> DataFrame:
    """Adds lower, upper and outlier; NULL is no outlier."""
    flagged = df.join(outlier_bounds(df, col, by, k, absolute), by, "left")
    return flagged.withColumn("outlier", F.coalesce((F.col(col) < F.col("lower")) | (F.col(col) > F.col("upper")), F.lit(False)))


def outlier_report(flagged: DataFrame, col: str, by: list[str]) -> DataFrame:
    out = F.col("outlier")
    return flagged.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(out).alias("n_outliers"),
        (100 * F.count_if(out) / F.count("*")).alias("ratio_percent"),
        F.min(F.when(out, F.col(col))).alias("least"),
        F.max(F.when(out, F.col(col))).alias("most"),
        F.first("lower").alias("lower"),
        F.first("upper").alias("upper"),
    )


def high_confidence(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    return df.where(F.col("pmax") >= threshold)


def misclassified(df: DataFrame, n: int, truth: str = "y_true", pred: str = "y_pred", order: str = "id") -> DataFrame:
    return df.where(F.col(truth) != F.col(pred)).orderBy(order).limit(n)
