"""Grouped summaries: counts, histograms, box statistics, confusion, mixtures, centroids and distances."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.columns import argmax_prob, correlation, feature_category, sample_name, status_of
from pulsegrid.sources.shared import stored

from .order import cumulated, percentiles_of


def count_summary(files: DataFrame) -> DataFrame:
    """files(filename, time, signal_sum) per file and in total: counts, seconds, frequency count / time * 1000 (2 digits)."""
    rows = files.select(sample_name(F.col("filename")).alias("name"), "time", F.col("signal_sum").cast("long").alias("count"))
    out = rows.rollup("name").agg(F.sum("time").alias("time"), F.sum("count").alias("count"), F.grouping("name").alias("_g"))
    freq = F.round(F.try_divide(F.col("count"), F.col("time")) * 1000, 2)
    return out.select(F.when(F.col("_g") == 1, "Total").otherwise(F.col("name")).alias("name"), "time", "count", freq.alias("freq"))


def with_total(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.rollup(key).agg(F.sum(value).alias(value), F.grouping(key).alias("_g")).select(F.when(F.col("_g") == 1, "Total").otherwise(F.col(key)).alias(key), value)


def inventory(files: DataFrame, keys: list[str]) -> DataFrame:
    """files(keys..., folder 'T' or 'T/ANAL', is_data) -> counts of data files directly in both folders and the status."""
    count = lambda f: F.when(F.count_if(F.col("folder") == f) > 0, F.count_if((F.col("folder") == f) & F.col("is_data")))
    out = files.groupBy(*keys).agg(count("T").alias("n_t"), count("T/ANAL").alias("n_anal"))
    return out.withColumn("status", status_of(F.col("n_t"), F.col("n_anal")))


def status_summary(inv: DataFrame) -> DataFrame:
    return inv.groupBy("status").agg(F.count("*").alias("n"))


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per label; fewer than two classes are an error."""
    out = df.groupBy(label).agg(F.count("*").alias("n"))
    if len(out.limit(2).collect()) < 2:
        raise ValueError("training needs two classes at least")
    return out


def long_features(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    return df.select(label, *[F.col(f).cast("double") for f in features]).unpivot([label], list(features), "feature", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))


def value_counts(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """(feature, label, value, c): how often each value of a feature stands in a class; one scan of ``df``."""
    return long_features(df, features, label).groupBy("feature", label, "value").agg(F.count("*").alias("c"))


def summary_stats(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    group = ["feature", label]
    cells = cumulated(value_counts(df, features, label), group, "value", "c")
    v, c = F.col("value"), F.col("c")
    first = percentiles_of(cells, "value", group, {"median": 0.5, "q1": 0.25, "q3": 0.75}, None, None, F.sum("c").alias("n"), (F.sum(v * c) / F.sum("c")).alias("mean"))
    # one row a feature and class: features are columns of the table, classes its labels
    spread = cells.join(first.select(*group, "mean"), group).groupBy(*group).agg(F.sqrt(F.sum(c * F.pow(v - F.col("mean"), F.lit(2))) / F.sum("c")).alias("sd"))
    return first.join(spread, group).select(*group, "n", "mean", "median", "sd", "q1", "q3")


def ranged_values(cells: DataFrame, low: float = 0.005, high: float = 0.995) -> tuple[DataFrame, DataFrame]:
    """(cells with their cumulated counts, ranges): both of ``histogram_stats``, which reads the counts a second time."""
    rows = cumulated(cells, ["feature"], "value", "c")
    ends = percentiles_of(rows, "value", ["feature"], {"lo": low, "hi": high})
    flat = F.col("hi") <= F.col("lo")
    ends = ends.select("feature", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    # per feature, of which there are as many as columns: what lies below the range and in it, then quartiles by place
    placed = rows.join(F.broadcast(ends), "feature").withColumn("inside", F.col("value").between(F.col("lo"), F.col("hi")))
    v, count = F.when(F.col("inside"), F.col("value")), lambda test: F.sum(F.when(test, F.col("c")).otherwise(0))
    sizes = placed.groupBy("feature").agg(
        F.first("lo").alias("lo"), F.first("hi").alias("hi"), count(F.col("inside")).alias("n"), count(~F.col("inside")).alias("clipped"), F.min(v).alias("least"), F.max(v).alias("most"),
        count(F.col("value") < F.col("lo")).alias("below"),
    )
    inner = rows.join(F.broadcast(sizes.select("feature", "below", F.col("n").alias("n_in"))), "feature")
    quartiles = percentiles_of(inner, "value", ["feature"], {"q1": 0.25, "q3": 0.75}, F.col("below"), F.col("n_in"))
    stats = sizes.join(quartiles, "feature", "left")
    log = (F.col("least") > 0) & (F.col("most") / F.when(F.col("least") > 0, F.col("least")) > 50)
    span, n = F.col("most") - F.col("least"), F.col("n")
    width_fd = 2 * (F.col("q3") - F.col("q1")) / F.cbrt(n)
    width_st = span / (F.log2(n) + 1)
    width = F.when(width_fd > 0, F.least(width_fd, width_st)).otherwise(width_st)
    auto = F.when(span > 0, F.ceil(span / width)).otherwise(1)
    bins = F.when(log, F.least(F.greatest(F.floor(F.sqrt(n)), F.lit(20)), F.lit(60))).otherwise(F.least(F.greatest(auto, F.lit(15)), F.lit(80)))
    return rows, stats.select("feature", "lo", "hi", "n", "clipped", F.coalesce(log, F.lit(False)).alias("log"), bins.cast("int").alias("bins"))


def value_ranges(cells: DataFrame, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Per feature of cells(feature, value, c): display range, log flag, counts inside and outside, bin count (see histogram_stats)."""
    return ranged_values(cells, low, high)[1]


def clipped_counts(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    return value_ranges(value_counts(df, features, label)).select("feature", "clipped")


def histogram_stats(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Long histogram: feature, class, bin, edges, count, pdf, pdf over its largest. Empty bins are kept; the last bin holds its right end."""
    cells, ranges = ranged_values(value_counts(df, features, label))
    ranges = stored(ranges, "ranges")
    scale = lambda x: F.when(F.col("log"), F.log(F.when(x > 0, x))).otherwise(x)
    lo, hi = scale(F.col("lo")), scale(F.col("hi"))
    step = (hi - lo) / F.col("bins")
    placed = cells.join(F.broadcast(ranges), "feature").where(F.col("value").between(F.col("lo"), F.col("hi")))
    at = F.least(F.floor((scale(F.col("value")) - lo) / step), F.col("bins") - 1).cast("int")
    counts = placed.groupBy("feature", label, at.alias("bin")).agg(F.sum("c").alias("count"))
    edge = lambda k: F.when(F.col("log"), F.exp(lo + k * step)).otherwise(lo + k * step)
    bins = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1))).select("feature", "bin", edge(F.col("bin")).alias("left"), edge(F.col("bin") + 1).alias("right"))
    grid = cells.select("feature", label).distinct().join(F.broadcast(bins), "feature")
    full = grid.join(counts, ["feature", label, "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    group = Window.partitionBy("feature", label)
    pdf = F.try_divide(F.col("count"), F.sum("count").over(group)) / (F.col("right") - F.col("left"))
    full = full.withColumn("pdf", pdf)
    return full.withColumn("pdf_norm", F.try_divide(F.col("pdf"), F.max("pdf").over(group)))


def bin_edges(df: DataFrame, col: str, width: float = 0.025, pad: int = 2) -> DataFrame:
    """(k, edge): multiples of width from pad below the least value to pad above the largest; no value gives -0.1 to 3.4."""
    lo = F.coalesce(F.floor(F.min(col) / width) - pad, F.lit(round(-0.1 / width)))
    hi = F.coalesce(F.ceil(F.max(col) / width) + pad, F.lit(round(3.4 / width)))
    ends = df.agg(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
    return ends.select(F.explode(F.sequence("lo", "hi")).alias("k")).select("k", (F.col("k") * width).alias("edge"))


def lap_histogram(df: DataFrame, value: str, by: str, width: float = 0.025) -> DataFrame:
    """Long: per ``by`` the share of values in each bin of ``width`` (bins without values are left out)."""
    rows = df.where(F.col(value).isNotNull()).groupBy(by, F.floor(F.col(value) / width).alias("k")).agg(F.count("*").alias("count"))
    return rows.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy(by)))


def heatmap_matrix(hist: DataFrame, by: str, names: list, width: float = 0.025) -> DataFrame:
    """Wide: a row per bin with left, centre and right, a column per series; zeros where a series has no value."""
    wide = hist.groupBy("k").pivot(by, names).agg(F.first("share"))
    shown = [F.coalesce(F.col(str(n)), F.lit(0.0)).alias(f"MS_IDX_{n}") for n in names]
    return wide.select((F.col("k") * width).alias("left"), ((F.col("k") + 0.5) * width).alias("centre"), ((F.col("k") + 1) * width).alias("right"), *shown)


def box_stats(df: DataFrame, value: str, by: str) -> DataFrame:
    """Quartiles, whiskers at the last values within 1.5 interquartile ranges, number of values beyond them."""
    cells = cumulated(df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c")), [by], value, "c")
    q = percentiles_of(cells, value, [by], {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return cells.join(q, by).groupBy(by).agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"), F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"),
        F.sum(F.when(~inside, F.col("c")).otherwise(0)).alias("fliers"),
    )


def file_metrics(quality: DataFrame) -> DataFrame:
    code = F.col("code")
    return quality.agg(
        F.count("*").alias("total"), F.count_if(code == 1).alias("ok"), F.count_if(code.isin(2, 3)).alias("required_missing"), F.count_if(code == 4).alias("group_missing"), F.count_if(code == 0).alias("errors")
    )


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Long class x class counts, zeros kept, and the row's percentage (NULL for a class without rows).

    The counts become one row whose list is completed by zeros: one scan and no join for a table of classes squared.
    """
    counts = df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    one = counts.agg(F.array_distinct(F.array_compact(F.flatten(F.collect_list(F.array("truth", "pred"))))).alias("labels"), F.collect_list(F.struct("truth", "pred", "n")).alias("cells"))
    zeros = F.flatten(F.transform("labels", lambda a: F.transform("labels", lambda b: F.struct(a.alias("truth"), b.alias("pred"), F.lit(0).cast("long").alias("n")))))
    full = one.select(F.explode(F.concat("cells", zeros)).alias("c")).select("c.*").where("truth is not null and pred is not null").groupBy("truth", "pred").agg(F.sum("n").alias("n"))
    return full.withColumn("percent", 100 * F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy("truth"))))


def classification_report(cm: DataFrame) -> DataFrame:
    """Per class, accuracy, macro and weighted averages; what divides by zero is 0. The table is as small as the classes."""
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    sums = cm.withColumns({"support": F.sum("n").over(Window.partitionBy("truth")), "said": F.sum("n").over(Window.partitionBy("pred"))}).where("truth = pred")
    each = sums.select(F.col("truth").alias("name"), "support", F.col("n").alias("hit"), zero(F.col("n"), F.col("said")).alias("precision"), zero(F.col("n"), F.col("support")).alias("recall"))
    each = each.withColumn("f1", zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    three = ("precision", "recall", "f1")
    total = F.sum("support")
    row = lambda name, cols: F.struct(F.lit(name).alias("name"), total.alias("support"), *[c.alias(k) for k, c in zip(three, cols, strict=True)])
    extra = F.array(
        row("accuracy", [F.sum("hit") / total] * 3),
        row("macro avg", [F.avg(c) for c in three]),
        row("weighted avg", [F.sum(F.col(c) * F.col("support")) / total for c in three]),
    )
    listed = each.agg(F.collect_list(F.struct("name", "support", *three)).alias("own"), extra.alias("extra"))
    return listed.select(F.explode(F.concat("own", "extra")).alias("r")).select("r.*")


AVERAGES = {"macro": "macro avg", "micro": "accuracy", "weighted": "weighted avg"}


def f1(cm: DataFrame, *averages: str) -> DataFrame:
    """F1 by name: 'macro', 'micro', 'weighted', or 'class' for every class."""
    names = [AVERAGES[a] for a in averages if a != "class"]
    keep = F.col("name").isin(names) if names else F.lit(False)
    if "class" in averages:
        keep = keep | ~F.col("name").isin(list(AVERAGES.values()))
    return classification_report(cm).where(keep).select("name", "f1")


def mixture_ratio(predictions: DataFrame, by: str, classes: tuple[str, ...], threshold: float = 0.8, only_confident: bool = False) -> DataFrame:
    """Per file: count, percentage of each class (2 digits), mean pmax (4), share at or over the threshold.

    only_confident: the same over rows at or over the threshold; files without such rows stay, with zeros and a NULL mean.
    """
    p = argmax_prob(predictions)
    sure = F.col("pmax") >= threshold
    use = sure if only_confident else F.lit(True)
    n = F.count_if(use)
    up = 1e-7  # halves round up although sums may end a bit below them
    share = lambda k: F.round(F.coalesce(F.try_divide(100 * F.count_if(use & (F.col("pred") == k)), n), F.lit(0.0)) + up, 2)
    columns = [n.alias("count"), *[share(k).alias(f"pct_{c}") for k, c in enumerate(classes)], F.round(F.avg(F.when(use, F.col("pmax"))) + up, 4).alias("mean_pmax")]
    last = (F.count("*") - n).alias("count_excluded") if only_confident else F.round(100 * F.count_if(sure) / F.count("*") + up, 2).alias("pct_confident")
    return p.groupBy(by).agg(*columns, last)


def category_summary(importance: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    rows = importance.withColumn("category", feature_category(F.col("feature"), extra=extra))
    return rows.groupBy("category").agg(F.sum("importance_mean").alias("total"), F.avg("importance_mean").alias("mean"), F.count("*").alias("n")).orderBy(F.desc("total"), "category")


def zscore(df: DataFrame, features: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Standardised by mean and population deviation of ``fit_on`` (default: the rows themselves); a zero deviation counts as 1."""
    stats = (fit_on or df).agg(*[F.avg(f).alias(f"_m_{f}") for f in features], *[F.stddev_pop(f).alias(f"_s_{f}") for f in features])
    joined = df.crossJoin(F.broadcast(stats))
    by = lambda f: F.when(F.col(f"_s_{f}") == 0, 1.0).otherwise(F.col(f"_s_{f}"))
    return joined.select(*[((F.col(c) - F.col(f"_m_{c}")) / by(c)).alias(c) if c in features else F.col(c) for c in df.columns])


def centroids(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Long: class, feature, mean of the standardised feature, number of rows."""
    return long_features(zscore(df, features), features, label).groupBy(label, "feature").agg(F.avg("value").alias("centre"), F.count("*").alias("n"))


def class_pairs(cent: DataFrame, label: str = "label", ordered: bool = True) -> DataFrame:
    """Pairs of classes that share features (a < b, or all): an equi-join on the feature."""
    a = cent.select(F.col(label).alias("a"), "feature", F.col("centre").alias("x"))
    b = cent.select(F.col(label).alias("b"), "feature", F.col("centre").alias("y"))
    pairs = a.join(b, "feature")
    return pairs.where("a < b") if ordered else pairs


def class_distance(cent: DataFrame, label: str = "label", ordered: bool = True) -> DataFrame:
    return class_pairs(cent, label, ordered).groupBy("a", "b").agg(F.sqrt(F.sum(F.pow(F.col("x") - F.col("y"), F.lit(2)))).alias("distance"))


def centroid_edges(dist: DataFrame, threshold: float | None = None, pathway: DataFrame | None = None) -> DataFrame:
    """Edges a < b with weight 1 / (distance + 1e-6); known: whether pathway(a, b) holds the pair in either direction."""
    edges = dist.where("a < b").withColumn("weight", 1 / (F.col("distance") + 1e-6))
    if threshold is not None:
        edges = edges.where(F.col("distance") <= threshold)
    if pathway is None:
        return edges.withColumn("known", F.lit(False))
    both = pathway.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn("known", F.lit(True))
    return edges.join(both, ["a", "b"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def confidence_ellipse(df: DataFrame, x: str, y: str, label: str = "label", level: float = 0.95) -> DataFrame:
    """Per class of at least three points: centre, width and height 2 sqrt(eigenvalue * chi2), angle in degrees."""
    chi2 = -2 * math.log(1 - level)
    m = df.groupBy(label).agg(F.count("*").alias("n"), F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"), F.covar_samp(x, y).alias("c"))
    half, mid = F.sqrt(F.pow((F.col("vx") - F.col("vy")) / 2, F.lit(2)) + F.col("c") ** 2), (F.col("vx") + F.col("vy")) / 2
    size: Column = lambda v: 2 * F.sqrt(F.greatest(v, F.lit(0.0)) * chi2)
    angle = F.degrees(F.atan2(2 * F.col("c"), F.col("vx") - F.col("vy")) / 2)
    return m.where("n >= 3").select(label, "n", "cx", "cy", size(mid + half).alias("width"), size(mid - half).alias("height"), angle.alias("angle"))


def pair_confusion(dist: DataFrame, cm: DataFrame) -> DataFrame:
    """Distance of each class pair with the mean of the two error rates."""
    d = dist.where("a < b")
    ab = cm.select(F.col("truth").alias("a"), F.col("pred").alias("b"), F.col("percent").alias("e1"))
    ba = cm.select(F.col("truth").alias("b"), F.col("pred").alias("a"), F.col("percent").alias("e2"))
    return d.join(ab, ["a", "b"]).join(ba, ["a", "b"]).select("a", "b", "distance", ((F.col("e1") + F.col("e2")) / 2).alias("error"))


def distance_confusion(pairs: DataFrame) -> DataFrame:
    """Pearson and Spearman correlation and regression line of error on distance; NULL below three pairs."""
    average = lambda c: F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2  # noqa: E731  as few rows as class pairs
    ranked = pairs.withColumns({"rd": average("distance"), "re": average("error")})
    enough = F.count("*") >= 3
    return ranked.agg(
        F.count("*").alias("n"), F.when(enough, correlation("distance", "error")).alias("pearson"), F.when(enough, correlation("rd", "re")).alias("spearman"),
        F.when(enough, F.regr_slope("error", "distance")).alias("slope"), F.when(enough, F.regr_intercept("error", "distance")).alias("intercept"),
    )


def distinct_events(df: DataFrame, key: str = "event_id") -> DataFrame:
    return df.agg(F.count_distinct(key).alias("n"))


def next_id(stored: DataFrame, key: str = "event_id") -> DataFrame:
    return stored.agg((F.coalesce(F.max(key), F.lit(-1)) + 1).alias("next_id"))
