"""Reading and writing: acquisitions as tables per group, file listings, quality codes, snapshots, manifests."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUPS = ("trace", "ar_table", "s_table", "r_table")


def read_acquisition(spark: SparkSession, root: str, groups: tuple[str, ...] = GROUPS) -> dict[str, DataFrame]:
    """One DataFrame per group of channels, from Parquet tables ``root/<group>.parquet``; the key is ``file``."""
    return {g: spark.read.parquet(f"{root}/{g}.parquet") for g in groups}


def list_files(spark: SparkSession, root: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(path, length, modificationTime) of matching files, by path. Contents are not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(root).select("path", "length", "modificationTime").orderBy("path")


def find_dirs(files: DataFrame, keyword: str) -> DataFrame:
    """Directories, at any depth, whose name has the keyword, and what follows it in the name (target)."""
    steps = F.split(F.regexp_replace("path", "/[^/]*$", ""), "/")
    upto = F.transform(F.sequence(F.lit(1), F.size("s")), lambda k: F.struct(F.array_join(F.slice("s", 1, k), "/").alias("dir"), F.element_at("s", k).alias("name")))
    found = files.select(steps.alias("s")).select(F.explode(upto).alias("d")).select("d.dir", "d.name").where(F.contains("name", F.lit(keyword))).distinct()
    return found.select("dir", F.substring_index("name", keyword, -1).alias("target"))


def list_samples(files: DataFrame, root: str) -> DataFrame:
    """Names of the directories directly below ``root``."""
    prefix = root if root.endswith("/") else root + "/"
    rest = F.split_part(F.col("path"), F.lit(prefix), F.lit(2))
    return files.where(F.contains("path", F.lit(prefix))).where(F.contains(rest, F.lit("/"))).select(F.split_part(rest, F.lit("/"), F.lit(1)).alias("sample")).distinct()


def scan_quality(groups: DataFrame, group: str = "Data", channel: str = "Ch1", least: int = 3) -> DataFrame:
    """groups(file, group, channel, n_points; null group: unreadable) -> code 0 unreadable, 1 ok, 2 short, 3 no channel, 4 no group."""
    per_file = groups.groupBy("file").agg(
        F.count("group").alias("readable"),
        F.count_if(F.col("group") == group).alias("has_group"),
        F.count_if((F.col("group") == group) & (F.col("channel") == channel)).alias("has_channel"),
        F.coalesce(F.max(F.when((F.col("group") == group) & (F.col("channel") == channel), F.col("n_points"))), F.lit(0)).alias("points"),
    )
    code = F.when(F.col("readable") == 0, 0).when(F.col("has_group") == 0, 4).when(F.col("has_channel") == 0, 3).when(F.col("points") < least, 2).otherwise(1)
    return per_file.select("file", code.alias("code"))


def require_groups(groups: DataFrame, names: list[str]) -> DataFrame:
    """Files that hold all the named groups."""
    held = groups.where(F.col("group").isin(names)).groupBy("file").agg(F.count_distinct("group").alias("n"))
    return held.where(F.col("n") == len(set(names))).select("file")


def read_lap(tables: list[DataFrame], required: list[str], optional: list[str]) -> DataFrame:
    """Union of the tables that have all required columns; missing optional ones are NULL."""
    usable = [t for t in tables if set(required) <= set(t.columns)]
    if not usable:
        raise ValueError("no table has the required columns")
    wanted = lambda t: t.select(*required, *[c for c in optional if c in t.columns])
    out = wanted(usable[0])
    for t in usable[1:]:
        out = out.unionByName(wanted(t), allowMissingColumns=True)
    for c in optional:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out.select(*required, *optional)


def read_table(spark: SparkSession, base: str, schema: str | None = None) -> DataFrame:
    """``base.parquet`` where it exists, else ``base.csv``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base + ".parquet")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.read.parquet(base + ".parquet")
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(base + ".csv")


def conform_columns(df: DataFrame, mapping: dict[str, tuple[str, str]]) -> DataFrame:
    """mapping: old name -> (new name, type)."""
    return df.select(*[F.col(old).cast(kind).alias(new) for old, (new, kind) in mapping.items()])


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def write_snapshot(df: DataFrame, folder: str, run_ts: str, by: str) -> None:
    """History by ``by`` and run, and ``latest`` overwritten."""
    df.withColumn("run_ts", F.lit(run_ts)).write.mode("append").partitionBy(by, "run_ts").parquet(f"{folder}/history")
    df.write.mode("overwrite").partitionBy(by).parquet(f"{folder}/latest")


def run_manifest(spark: SparkSession, settings: dict, n_features: dict[str, int], macro_f1: dict[str, float]) -> DataFrame:
    """One record of a run."""
    row = (json.dumps(settings, sort_keys=True), n_features, {k: float(v) for k, v in macro_f1.items()})
    return spark.createDataFrame([row], "settings string, n_features map<string,int>, macro_f1 map<string,double>")


def export_clip(trace: DataFrame, t0: float, t1: float, dt: float, idx: str = "idx", part: str = "file") -> DataFrame:
    """Samples from floor(t0/dt) to ceil(t1/dt) with their time; files with fewer than two such samples are left out."""
    inside = trace.where(F.col(idx).between(F.floor(F.lit(t0) / dt), F.ceil(F.lit(t1) / dt))).withColumn("t", F.col(idx) * F.lit(dt))
    enough = inside.groupBy(part).agg(F.count("*").alias("_n")).where("_n >= 2").select(part)
    return inside.join(enough, part, "left_semi")


def source_fingerprint(df: DataFrame) -> DataFrame:
    """Size and time of each source file of a file-backed DataFrame; equal tables mean that results can be reused."""
    m: Column = F.col("_metadata")
    return df.select(m["file_path"].alias("path"), m["file_size"].alias("size"), m["file_modification_time"].alias("modified")).distinct()
