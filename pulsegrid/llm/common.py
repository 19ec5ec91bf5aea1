"""Shared helpers of the corpus operators: tables in the shared folder, loading, worker caches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the session is local (tests) a folder of this process is made and removed at its end;
    on a cluster no other machine would see such a folder, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    key = spark.sparkContext.applicationId
    if key not in _own_dirs:
        _own_dirs[key] = tempfile.mkdtemp(prefix="pulsegrid-shared-")
        atexit.register(shutil.rmtree, _own_dirs[key], ignore_errors=True)
    return "file://" + _own_dirs[key]


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and returns a scan of it: lineage ends there, rows and ids are fixed.

    The files go when the application ends, or by ``forget``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    passing(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Removes the files of a stored table that nothing reads any more: what was made from it is stored itself."""
    path = getattr(df, "_stored_at", None)
    if path:
        hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def passing(spark: SparkSession, path: str) -> None:
    """Has the folder removed when the application ends."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)


def boxed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc, hash, t): all columns of ``docs`` as one struct, so that none of their names can meet an internal one,
    with its id, the hash of its text, and the text."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("t"))


def keep_firsts(docs: DataFrame, named: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``docs`` whose id names the component of their own text: named(id, hash, component_id).

    A row goes only where a row of smaller id stands for its text. Of equal (id, text) rows one stays; rows that share an id
    but not a component are told apart by their texts; rows without id stay.
    """
    firsts = named.where("id = component_id").select(F.col("id").alias("_id"), F.col("hash").alias("_hash")).distinct()
    rows = boxed(docs, id_col, text_col)
    kept = rows.where("doc is not null").join(firsts, (F.col("doc").cast("long") == F.col("_id")) & (F.col("hash") == F.col("_hash")))
    one = kept.groupBy("doc", "hash").agg(F.first("row").alias("row")).select("row")
    return one.union(rows.where("doc is null").select("row")).select("row.*")


def same(left, right):
    """Equality under which null equals null; Spark plans it as an equi-join."""
    return left.eqNullSafe(right)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


#: Bytes of a stored table that is broadcast.
SMALL = 32 << 20


def small_side(df: DataFrame, size) -> DataFrame:
    """A stored table, marked for broadcast where its rows are measured to be ``SMALL`` bytes together at most; ``size`` is a
    row's. A larger one is left to the planner, which shuffles both sides."""
    total = df.agg(F.coalesce(F.sum(size + 64), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= SMALL else df
