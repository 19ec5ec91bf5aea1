"""Window operators: ranks, running ids, islands, moving frames, ordered heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.sources.shared import stored

from .order import exact_percentiles, tie_ranks  # noqa: F401


def avg_rank(df: DataFrame, col: str, part: list[str] | None = None, desc: bool = True, out: str = "rank") -> DataFrame:
    """Average rank of ties of a numeric column. Ranks come from counts of distinct values, so a common value is one row.

    The rows are written once: counts and rows meet by value, and a value that is computed twice (a mean, summed in another
    order) would not meet itself.
    """
    part, df = part or [], stored(df, "ranked")
    counts = df.groupBy(*part, col).agg(F.count("*").alias("_n"))
    ranks = tie_ranks(counts, part, col, "_n", desc).select(*[F.col(k).alias(f"_k_{k}") for k in (*part, col)], F.col("_rank").alias(out))
    condition = None
    for k in (*part, col):
        one = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        condition = one if condition is None else condition & one
    return df.join(ranks, condition).select(*df.columns, out)


def rank_diff(df: DataFrame, a: str, b: str, out: str = "rank_diff") -> DataFrame:
    return df.withColumn(out, F.col(a) - F.col(b))


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_k", place).where("_k = 1").drop("_k")


def running_id(df: DataFrame, part: list[str], order: list[str], bucket: Column, out: str, start: int = 0) -> DataFrame:
    """Consecutive numbers within ``part`` by ``order``, without one task ordering a whole part.

    ``bucket`` must not decrease along ``order``: rows are numbered within buckets and shifted by the counts of earlier buckets.
    """
    df = df.withColumn("_b", bucket)
    counts = df.groupBy(*part, "_b").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*part).orderBy("_b")) - F.col("_c")
    offsets = counts.select(*part, "_b", before.alias("_before"))
    local = F.row_number().over(Window.partitionBy(*part, "_b").orderBy(*order)) - 1
    return df.withColumn("_local", local).join(offsets, [*part, "_b"]).withColumn(out, F.col("_before") + F.col("_local") + start).drop("_b", "_local", "_before")


def islands(df: DataFrame, flag: str, part: list[str], order: str, out: str = "run") -> DataFrame:
    """Number of the run of equal flags that a row belongs to, from 1."""
    w = Window.partitionBy(*part).orderBy(order)
    new = F.when(F.lag(flag).over(w).eqNullSafe(F.col(flag)), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn(out, F.sum("_new").over(w)).drop("_new")


def moving_sum(df: DataFrame, col: str, width: int, part: list[str], order: str, out: str) -> DataFrame:
    half = width // 2
    return df.withColumn(out, F.sum(col).over(Window.partitionBy(*part).orderBy(order).rowsBetween(-half, half)))


def sort_by_count(files: DataFrame, count: str = "count", path: str = "path") -> DataFrame:
    return files.orderBy(F.desc(count), path)


def sort_by_status(inventory: DataFrame, keys: list[str], statuses: tuple[str, ...] = ("NO_T_FOLDER", "T_EMPTY", "NO_ANAL_FOLDER", "ANAL_NOT_DONE", "OK")) -> DataFrame:
    order = F.array_position(F.array(*[F.lit(s) for s in statuses]), F.col("status"))
    return inventory.orderBy(order, *keys)


def top_n(df: DataFrame, col: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(col), tie).limit(n)


def top_n_per_class(df: DataFrame, cls: str, col: str, n: int, tie: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(cls).orderBy(F.desc(col), tie))
    return df.withColumn("place", place).where(F.col("place") <= n)


def sort_by_abs(df: DataFrame, col: str, tie: str) -> DataFrame:
    return df.orderBy(F.desc(F.abs(col)), tie)


def head_n(df: DataFrame, order: list, n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)
