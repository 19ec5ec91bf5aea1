"""The domain tables of the library, built from the given tables, as DataFrames and as SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators.signal import detect_pulses
from pulsegrid.operators.windows import running_id
from pulsegrid.sources.shared import scratch  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(column):
    return F.round(column, 6)


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows: one per row of ``events``."""
    e = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    return e.select(
        "event_id",
        user.alias("file"),
        F.concat(F.lit("U"), user, F.lit("_10k_Sample#"), F.lpad((F.col("user_id") % 20).cast("string"), 3, "0")).alias("sample_name"),
        F.concat(F.date_format("ts", "yyyyMMdd_HHmm"), F.lit(" AN#"), (F.col("user_id") % 5).cast("string")).alias("ex_id"),
        F.concat("event_type", F.lit("_10k")).alias("sample"),
        F.col("value").alias("signal"),
        (F.get_json_object("props", "$.k").cast("int") * 10).alias("duration"),
        (F.col("value") - 50).alias("baseline"),
    )


META = """
SELECT event_id, user_id::VARCHAR AS file, 'U' || user_id || '_10k_Sample#' || lpad((user_id % 20)::VARCHAR, 3, '0') AS sample_name,
  strftime(ts, '%Y%m%d_%H%M') || ' AN#' || (user_id % 5) AS ex_id, event_type || '_10k' AS sample, value AS signal,
  json_extract(props, '$.k')::INTEGER * 10 AS duration, value - 50 AS baseline FROM events
"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long series: one per user, time in order of the events."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id"), "ts", "event_id", "value")
    return e.select("id", F.expr("row_number() OVER (PARTITION BY id ORDER BY ts, event_id) - 1").cast("int").alias("time"), "value")


SERIES = """
SELECT user_id::VARCHAR AS id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS time, value FROM events
"""


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series cut into waves of 64 points, as events are: no wave grows with the table."""
    s = series(spark, sf_dir)
    return s.select(F.concat_ws(":", "id", F.floor(F.col("time") / 64).cast("string")).alias("id"), (F.col("time") % 64).alias("time"), "value")


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw trace (file, idx, y): a file per event type, numbered without ordering a whole file in one task."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("file"), "ts", "event_id", F.col("value").alias("y"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    numbered = running_id(e, ["file"], ["ts", "event_id"], F.unix_timestamp(F.date_trunc("hour", "ts")), "idx")
    return numbered.select("file", "idx", "y", "k")


TRACE = """
SELECT event_type AS file, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx, value AS y,
  json_extract(props, '$.k')::INTEGER AS k FROM events
"""


#: Points of a chunk in the signal queries; a few hundred chunks at the smallest size.
SIZE = 500


def pulses(spark: SparkSession, sf_dir: str, min_ms: float = 0.2) -> DataFrame:
    return detect_pulses(trace(spark, sf_dir), k=1.0, min_ms=min_ms, size=SIZE)


PULSES = f"""
WITH t AS (SELECT file, idx, y, idx // {SIZE} AS chunk FROM ({TRACE})),
b AS (SELECT file, chunk, median(y) AS baseline, stddev_pop(y) AS sd FROM t GROUP BY 1, 2),
r AS (SELECT t.*, baseline, baseline + 1.0::DOUBLE * sd AS threshold, y > baseline + 1.0::DOUBLE * sd AS above FROM t JOIN b USING (file, chunk)),
n AS (SELECT *, CASE WHEN lag(above) OVER w IS NOT DISTINCT FROM above THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY file, chunk ORDER BY idx)),
k AS (SELECT *, sum(new) OVER (PARTITION BY file, chunk ORDER BY idx) AS run FROM n),
p AS (SELECT file, chunk, run, min(idx) AS start, max(idx) AS "end", max(y) AS peak, arg_min(idx, (-y, idx)) AS peak_idx, avg(y) AS mean, sum(y - baseline) * 1e-4 AS area,
  min(baseline) AS baseline, min(threshold) AS threshold FROM k WHERE above GROUP BY 1, 2, 3)
"""


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks on the traces: every run above one deviation over the median of its chunk, with five tenths of a ms a sample."""
    p = pulses(spark, sf_dir, 0.1).withColumnRenamed("peak", "height")
    return p.select("file", F.col("peak_idx").alias("peak"), "start", "end", ((F.col("end") - F.col("start") + 1) * 5).cast("int").alias("duration"), F.col("height").alias("signal"), "baseline")


PEAKS = f"""{PULSES} SELECT file, peak_idx AS peak, start, "end", (("end" - start + 1) * 5)::INTEGER AS duration, peak AS signal, baseline FROM p"""


def lap(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_returnflag").alias("target"), (F.col("l_extendedprice") / 30000).alias("value"), F.col("l_linenumber").alias("ms_idx"))


LAP = "SELECT l_returnflag AS target, l_extendedprice / 30000 AS value, l_linenumber AS ms_idx FROM lineitem"

FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four features and a class with many ties."""
    return table(spark, sf_dir, "lineitem").select(*FEATURES, F.col("l_returnflag").alias("label"))


FEATURE_ROWS = """
SELECT l_returnflag AS label, 'l_quantity' AS feature, l_quantity AS value FROM lineitem
UNION ALL SELECT l_returnflag, 'l_extendedprice', l_extendedprice FROM lineitem
UNION ALL SELECT l_returnflag, 'l_discount', l_discount FROM lineitem
UNION ALL SELECT l_returnflag, 'l_tax', l_tax FROM lineitem
"""

CLASSES = ("click", "error", "purchase", "signup", "view")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, file, label, prob): probabilities are a fixed function of value and props."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    raw = [F.lit(1.0) + F.when(k % 5 == i, F.col("value")).otherwise(0.0) + (F.col("user_id") % (i + 2)) for i in range(len(CLASSES))]
    total = sum(raw[1:], raw[0])
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("file"), F.col("event_type").alias("label"), F.array(*[x / total for x in raw]).alias("prob"))


_RAW = [f"(1.0 + CASE WHEN k % 5 = {i} THEN value ELSE 0.0 END + user_id % {i + 2})::DOUBLE" for i in range(len(CLASSES))]
PREDICTIONS = f"""
SELECT event_id AS id, user_id AS file, event_type AS label, [{', '.join(f'{x} / ({" + ".join(_RAW)})' for x in _RAW)}] AS prob
FROM (SELECT *, json_extract(props, '$.k')::INTEGER AS k FROM events)
"""
PREDICTED = f"SELECT id, file, label, list_position(prob, list_max(prob)) - 1 AS pred, list_max(prob) AS pmax FROM ({PREDICTIONS})"


N_CLASSES = 10


def attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, class, feature, phi, label, pred): all components of all vectors, less their mean, for every class."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("d", "x")).withColumn("x", F.col("x").cast("double"))
    centred = v.join(F.broadcast(v.groupBy("d").agg(F.avg("x").alias("m"))), "d")
    pred = ((F.col("label") + (F.col("vec_id") % 3 == 0).cast("int")) % N_CLASSES).cast("int")
    rows = centred.select(F.col("vec_id").alias("id"), F.col("label"), pred.alias("pred"), "d", (F.col("x") - F.col("m")).alias("phi"))
    classes = F.explode(F.sequence(F.lit(0), F.lit(N_CLASSES - 1))).alias("class")
    return rows.select("id", "label", "pred", "d", "phi", classes).select(
        "id", "class", F.concat(F.lit("f"), F.col("d").cast("string")).alias("feature"), (F.col("phi") * (F.col("class") + 1)).alias("phi"), "label", "pred"
    )


COMPONENTS = "SELECT vec_id, label, unnest(range(0, len(embedding))) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings"
ATTRIBUTIONS = f"""
SELECT vec_id AS id, c AS class, 'f' || e.d AS feature, (x - m) * (c + 1) AS phi, label, ((label + (vec_id % 3 = 0)::INTEGER) % {N_CLASSES})::INTEGER AS pred
FROM ({COMPONENTS}) e JOIN (SELECT d, avg(x) AS m FROM ({COMPONENTS}) GROUP BY d) k ON e.d = k.d, (SELECT unnest(range({N_CLASSES}))::INTEGER AS c)
"""
