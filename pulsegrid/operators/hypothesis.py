"""Group tests per feature, their p-values, and feature selection under multiple testing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.sources.shared import stored

from .aggregates import long_features, value_counts
from .order import tie_ranks


def anova(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Per feature: F and eta squared, from counts, means and deviations of the groups; features with fewer than two groups are left out."""
    groups = long_features(df, features, label).groupBy("feature", label).agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    total = groups.groupBy("feature").agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("ssw"),
        (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("n") * F.col("m")), F.lit(2)) / F.sum("n")).alias("ssb"),
    ).where("k >= 2")
    f = F.try_divide(F.col("ssb") / (F.col("k") - 1), F.col("ssw") / (F.col("n") - F.col("k")))
    return total.select("feature", "k", "n", f.alias("f"), F.try_divide(F.col("ssb"), F.col("ssb") + F.col("ssw")).alias("eta_sq"))


def ranked_groups(cells: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """((feature, label, r, n), (feature, value, t, rank)): rank sums and sizes of the groups of value counts, and the ties.

    Ranks meet the counts, never the rows: a value that many rows share is one row on either side.
    """
    values = cells.groupBy("feature", "value").agg(F.sum("c").alias("t"))
    ranks = tie_ranks(values, ["feature"], "value", "t").withColumnRenamed("_rank", "rank")
    met = cells.join(ranks, ["feature", "value"])
    return met.groupBy("feature", label).agg(F.sum(F.col("c") * F.col("rank")).alias("r"), F.sum("c").alias("n")), ranks


def kruskal(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Per feature: H with tie correction and epsilon squared. Ranks come from counts of distinct values."""
    groups, upto = ranked_groups(stored(value_counts(df, features, label), "value-counts"), label)
    cube = F.pow(F.col("t").cast("double"), F.lit(3)) - F.col("t")
    ties = upto.groupBy("feature").agg(F.sum(cube).alias("ties"))
    s = groups.groupBy("feature").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q")).join(ties, "feature").where("k >= 2")
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / F.nullif(1 - F.col("ties") / (n * n * n - n), F.lit(0.0))
    return s.select("feature", "k", "n", h.alias("h"), F.try_divide(h - F.col("k") + 1, n - F.col("k")).alias("epsilon_sq")).orderBy(F.desc("h"))


# ---------------------------------------------------------------- tails


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return 1 - total * front
    b, c = x + 1 - a, 1e300
    d = 1 / b
    out = d
    for i in range(1, 400):
        num = -i * (i - a)
        b += 2
        d = 1 / (num * d + b or 1e-300)
        c = b + num / c or 1e-300
        out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * out


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_tail(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_tail(x: float, k: float) -> float:
    return gamma_tail(k / 2, x / 2)


def t_tail(t: float, df: float) -> float:
    """Two-sided."""
    return beta_tail(df / 2, 0.5, df / (df + t * t))


def normal_tail(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


TAILS = {"f": f_tail, "chi2": chi2_tail, "t": t_tail, "normal": normal_tail}


def p_values(stats: DataFrame, kind: str, statistic: str, *df: str, out: str = "p") -> DataFrame:
    """Adds the upper tail (two-sided for t and normal) of a statistic; meant for one row per feature."""
    tail = TAILS[kind]

    @F.pandas_udf("double")
    def run(*cols):
        import pandas as pd

        return pd.Series([None if any(v is None or v != v for v in row) else tail(*map(float, row)) for row in zip(*cols, strict=True)], dtype="float64")

    return stats.withColumn(out, run(F.col(statistic), *[F.col(c) for c in df]))


def _log_choose(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def _side(start: int, end: int, step: int, row: int, column: int, n: int, top: float) -> float:
    """Sum of the probabilities from ``start`` on, over exp(top), while they count; each term is the one before times a ratio."""
    if (end - start) * step < 0:
        return 0.0
    term = total = math.exp(_log_choose(row, start) + _log_choose(n - row, column - start) - _log_choose(n, column) - top)
    for x in range(start, end, step):
        if step > 0:
            term *= (row - x) * (column - x) / ((x + 1) * (n - row - column + x + 1))
        else:
            term *= x * (n - row - column + x) / ((row - x + 1) * (column - x + 1))
        total += term
        if term < total * 1e-17:
            break
    return total


def fisher_p(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact test of the table (a b / c d): all tables of the same margins that are no likelier than it, in log space.

    Probabilities fall off on both sides of the mode, so the far end of the other tail is found by halving, and each tail is
    added up from its likeliest table outwards: large counts cost no more than their tails' width.
    """
    row, column, n = a + b, a + c, a + b + c + d
    low, high = max(0, row + column - n), min(row, column)
    if low == high:
        return 1.0
    log = lambda x: _log_choose(row, x) + _log_choose(n - row, column - x) - _log_choose(n, column)
    own = log(a)
    limit = own + 1e-7  # tables as likely as this one belong to it
    mode = min(max((row + 1) * (column + 1) // (n + 2), low), high)
    if log(mode) <= limit:
        return 1.0
    if a < mode:
        left, inner, outer = a, mode, high + 1  # the first table right of the mode that is no likelier
        while outer - inner > 1:
            middle = (inner + outer) // 2
            inner, outer = (middle, outer) if log(middle) > limit else (inner, middle)
        right = outer
    else:
        right, inner, outer = a, mode, low - 1
        while inner - outer > 1:
            middle = (inner + outer) // 2
            inner, outer = (middle, outer) if log(middle) > limit else (inner, middle)
        left = outer
    both = _side(left, low, -1, row, column, n, own) * (left >= low) + _side(right, high, 1, row, column, n, own) * (right <= high)
    return min(1.0, math.exp(own) * both)


def mann_whitney(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Each class against the rest, per feature: z of the rank sum with tie correction, from counts of distinct values."""
    return _mann_whitney(stored(value_counts(df, features, label), "value-counts"), label)


def _mann_whitney(cells: DataFrame, label: str) -> DataFrame:
    groups, ranks = ranked_groups(cells, label)
    cube = F.pow(F.col("t").cast("double"), F.lit(3)) - F.col("t")
    ties = ranks.groupBy("feature").agg(F.sum(cube).alias("ties"), F.sum("t").alias("all"))
    n, n1 = F.col("all").cast("double"), F.col("n").cast("double")
    n2 = n - n1
    spread = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = F.try_divide(F.col("r") - n1 * (n + 1) / 2, F.nullif(spread, F.lit(0.0)))
    return groups.join(F.broadcast(ties), "feature").select("feature", label, z.alias("z"))


def binary_tables(cells: DataFrame, label: str = "label") -> DataFrame:
    """(feature, label, a, b, c, d) of features with exactly two values: rows of the class with the larger (a) and the smaller (b)
    value, and of the rest (c, d)."""
    ends = cells.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    sides = cells.join(F.broadcast(ends), "feature")  # one row a feature; dealt out by feature its values would meet in one task
    high, low, c = F.col("value") == F.col("hi"), F.col("value") == F.col("lo"), F.col("c")
    of = lambda test: F.sum(F.when(test, c).otherwise(0))
    whole = sides.where("lo < hi").groupBy("feature").agg(of(high).alias("_hi"), of(low).alias("_lo"), of(~(high | low)).alias("_between"))
    own = sides.groupBy("feature", label).agg(of(high).alias("a"), of(low).alias("b"))
    met = own.join(F.broadcast(whole.where("_between = 0")), "feature")
    return met.select("feature", label, "a", "b", (F.col("_hi") - F.col("a")).alias("c"), (F.col("_lo") - F.col("b")).alias("d"))


def fisher_exact(tables: DataFrame, out: str = "p") -> DataFrame:
    """Adds the two-sided p-value of each 2 x 2 table; meant for one row per feature and class."""

    @F.pandas_udf("double")
    def run(a, b, c, d):
        import pandas as pd

        return pd.Series([fisher_p(*map(int, row)) for row in zip(a, b, c, d, strict=True)], dtype="float64")

    return tables.withColumn(out, run("a", "b", "c", "d"))


def relevance(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """(feature, label, test, p): each class against the rest, by Fisher's exact test for features of two values, else by
    Mann-Whitney; a feature of one value has p 1. One scan of ``df``: both tests read its value counts."""
    cells = stored(value_counts(df, features, label), "value-counts")
    exact = fisher_exact(binary_tables(cells, label)).select("feature", label, F.lit("fisher").alias("test"), "p")
    real = p_values(_mann_whitney(cells, label), "normal", "z").select("feature", label, F.lit("mann_whitney").alias("test"), F.coalesce("p", F.lit(1.0)).alias("p"))
    return exact.union(real.join(F.broadcast(exact.select("feature").distinct()), "feature", "left_anti").select("feature", label, "test", "p"))


def select_features(df: DataFrame, features: list[str], label: str = "label", fdr: float = 0.05) -> DataFrame:
    """(feature, n_classes, test, p): features that some class keeps, by ``relevance`` and Benjamini-Yekutieli over the features of a class."""
    tests = relevance(df, features, label)
    m = len(features)
    harmonic = sum(1 / k for k in range(1, m + 1))
    place = F.row_number().over(Window.partitionBy(label).orderBy("p", "feature"))
    passed = tests.withColumn("k", place).withColumn("ok", F.col("p") <= F.col("k") * fdr / (m * harmonic))
    last = F.max(F.when(F.col("ok"), F.col("k"))).over(Window.partitionBy(label))
    return passed.withColumn("last", last).where("k <= last").groupBy("feature").agg(F.count("*").alias("n_classes"), F.first("test").alias("test"), F.min("p").alias("p"))
