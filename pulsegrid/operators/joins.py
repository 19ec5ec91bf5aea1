"""Joins and set operators between events, features, series and file tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import first_per_key


def join_features(meta: DataFrame, feats: DataFrame, key: str = "global_id") -> DataFrame:
    return meta.join(feats, key, "inner")


def series_of(series: DataFrame, events: DataFrame, key: str = "id") -> DataFrame:
    return series.join(events.select(key), key, "left_semi")


def unseen(new: DataFrame, stored: DataFrame, keys: list[str], order: list) -> DataFrame:
    """New rows whose keys are not stored, the first of each key within the batch."""
    return first_per_key(new.join(stored.select(*keys), keys, "left_anti"), keys, order)


def unseen_series(new: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    return new.join(stored.select(key).distinct(), key, "left_anti")


def remap_ids(series: DataFrame, id_map: DataFrame) -> DataFrame:
    """id_map(old, new); rows without a new id go."""
    return series.join(id_map, series["id"] == id_map["old"]).select(F.col("new").alias("id"), *[c for c in series.columns if c != "id"])


def importance_with_stats(importance: DataFrame, stats: DataFrame, key: str = "feature") -> DataFrame:
    return importance.join(stats, key, "left")


#: Length of the grams that names and stems meet by; shorter names are their own gram.
GRAM = 3


def _grams(text: str, size: int):
    """Distinct substrings of ``size`` characters; none for shorter texts."""
    n = F.length(text) - size + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(F.col(text), i, F.lit(size)))))


def match_counts(files: DataFrame, counts: DataFrame) -> DataFrame:
    """files(stem) with counts(name, position, count): the first name, by position, that the stem contains; none gives 0.

    A gram index: stems are cut into grams of one to three characters, whatever the lengths of the names; a name is looked
    up by the one of its grams that the fewest stems hold, and what meets there is verified. A name with a gram that no stem
    holds is in none. The empty name is in every stem; null stems and names match nothing.
    """
    stems = files.select("stem").where(F.col("stem").isNotNull()).distinct()
    sizes = [_grams("stem", k) for k in range(1, GRAM + 1)]
    index = stems.select("stem", F.explode(F.concat(F.array(F.lit("")), *[F.coalesce(g, F.array().cast("array<string>")) for g in sizes])).alias("gram"))
    names = counts.where(F.col("name").isNotNull()).groupBy("name").agg(F.min(F.struct("position", "count")).alias("_at"))
    own = F.when(F.length("name") < GRAM, F.array("name")).otherwise(_grams("name", GRAM))
    parts = names.select("name", F.size(own).alias("n"), F.explode(own).alias("gram"))
    held = index.join(parts.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("stems"))
    rarest = parts.join(held, "gram").groupBy("name").agg(F.min(F.struct("stems", "gram"))["gram"].alias("gram"), F.count("*").alias("known"), F.first("n").alias("n"))
    sought = names.join(rarest.where("known = n").select("name", "gram"), "name")
    found = index.join(sought, "gram").where(F.contains("stem", "name")).groupBy("stem").agg(F.min("_at")["count"].alias("count"))
    return files.join(found, "stem", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def inventory_join(t: DataFrame, anal: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Expected samples with the counts of both folders; a missing folder is NULL."""
    return expected.select(*keys).join(t, keys, "full_outer").join(anal, keys, "full_outer")


def transfer_plan(src: DataFrame, dst: DataFrame, key: str = "path") -> DataFrame:
    """What is to be copied: source files that the destination lacks."""
    return src.join(dst.select(key), key, "left_anti")


def union_samples(dfs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)


def append_new(stored: DataFrame, new: DataFrame) -> DataFrame:
    return stored.unionByName(new, allowMissingColumns=True)


def common_top(df: DataFrame, cls: str, item: str) -> DataFrame:
    """Items that the lists of all classes hold."""
    classes = df.agg(F.count_distinct(cls).alias("_k"))
    held = df.groupBy(item).agg(F.count_distinct(cls).alias("_n"))
    return held.join(F.broadcast(classes), held["_n"] == classes["_k"]).select(item)


def missing_names(want: DataFrame, have: DataFrame) -> DataFrame:
    return want.exceptAll(have)


def schema_guard(dfs: dict[str, DataFrame], prefix: str = "value__") -> None:
    """Raises where samples differ in their feature columns."""
    sets = {name: {c for c in df.columns if c.startswith(prefix)} for name, df in dfs.items()}
    want = next(iter(sets.values()), set())
    for name, cols in sets.items():
        if cols != want:
            raise ValueError(f"{name}: feature columns differ by {sorted(cols ^ want)}")
