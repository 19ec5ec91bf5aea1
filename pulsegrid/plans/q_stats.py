"""Queries of aggregations, tests and evaluation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import columns as C
from pulsegrid.operators import aggregates as A
from pulsegrid.operators import hypothesis as H

from . import fixtures as X
from .fixtures import CLASSES, FEATURE_ROWS, FEATURES, LAP, PREDICTED, r6
from .q_features import NUDGE
from .q_features import r6 as n6
from .register import query


def t(spark, d, name):
    return X.table(spark, d, name)


def rn(e: str, digits: int = 6) -> str:
    return f"round({e} + {NUDGE}, {digits})"


@query("a1_count_summary", """
WITH f AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_mktsegment || c_nationkey END AS name, (c_custkey % 9)::BIGINT AS time, c_nationkey::BIGINT AS count FROM customer)
SELECT CASE WHEN grouping(name) = 1 THEN 'Total' ELSE name END AS name, sum(time)::BIGINT AS time, sum(count)::BIGINT AS count, round(sum(count) / nullif(sum(time), 0) * 1000, 2) AS freq FROM f GROUP BY ROLLUP (name)
""")
def a1(spark, d):
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_mktsegment", F.lit(" D_x"))).otherwise(F.concat("c_mktsegment", F.col("c_nationkey").cast("string"), F.lit("z")))
    return A.count_summary(t(spark, d, "customer").select(name.alias("filename"), (F.col("c_custkey") % 9).alias("time"), F.col("c_nationkey").alias("signal_sum")))


@query("u4_with_total", "SELECT CASE WHEN grouping(n_name) = 1 THEN 'Total' ELSE n_name END AS n_name, sum(n_regionkey)::BIGINT AS n_regionkey FROM nation GROUP BY ROLLUP (n_name)")
def u4(spark, d):
    return A.with_total(t(spark, d, "nation"), "n_name", "n_regionkey")


_INVENTORY = """
WITH i AS (SELECT user_id % 40 AS sample, count(*) FILTER (event_type = 'click' AND user_id % 40 % 4 <> 0) AS t0, count(*) FILTER (event_type = 'view' AND user_id % 40 % 5 <> 0) AS a0,
  count(*) FILTER (event_type = 'click' AND user_id % 40 % 4 <> 0 AND user_id % 40 % 7 <> 0) AS t1, count(*) FILTER (event_type = 'view' AND user_id % 40 % 5 <> 0 AND user_id % 40 % 7 <> 0) AS a1 FROM events GROUP BY 1),
j AS (SELECT sample, CASE WHEN t0 > 0 THEN t1 END AS n_t, CASE WHEN a0 > 0 THEN a1 END AS n_anal FROM i),
s AS (SELECT *, CASE WHEN n_t IS NULL THEN 'NO_T_FOLDER' WHEN n_t = 0 THEN 'T_EMPTY' WHEN n_anal IS NULL THEN 'NO_ANAL_FOLDER' WHEN n_anal = 0 THEN 'ANAL_NOT_DONE' ELSE 'OK' END AS status FROM j)
"""


def _inventory(spark, d):
    s = F.col("user_id") % 40
    folder = F.when((F.col("event_type") == "click") & (s % 4 != 0), "T").when((F.col("event_type") == "view") & (s % 5 != 0), "T/ANAL").otherwise("x")
    return A.inventory(t(spark, d, "events").select(s.alias("sample"), folder.alias("folder"), (s % 7 != 0).alias("is_data")), ["sample"])


@query("a2_inventory", _INVENTORY + "SELECT sample, n_t, n_anal, status FROM s")
def a2(spark, d):
    return _inventory(spark, d)


@query("a3_status_summary", _INVENTORY + "SELECT status, count(*) AS n FROM s GROUP BY 1")
def a3(spark, d):
    return A.status_summary(_inventory(spark, d))


@query("a4_class_counts", "SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1")
def a4(spark, d):
    return A.class_counts(t(spark, d, "events").select(F.col("event_type").alias("label")))


@query("a5_summary_stats", f"SELECT feature, label, count(*) AS n, {rn('avg(value)')} AS mean, {rn('median(value)')} AS median, {rn('stddev_pop(value)')} AS sd, {rn('quantile_cont(value, 0.25)')} AS q1, {rn('quantile_cont(value, 0.75)')} AS q3 FROM ({FEATURE_ROWS}) GROUP BY 1, 2")
def a5(spark, d):
    out = A.summary_stats(X.features(spark, d), list(FEATURES))
    return out.select("feature", "label", "n", *[n6(c).alias(c) for c in ("mean", "median", "sd", "q1", "q3")])


_HIST = f"""
WITH v AS ({FEATURE_ROWS}),
e0 AS (SELECT feature, quantile_cont(value, 0.005) AS lo, quantile_cont(value, 0.995) AS hi FROM v GROUP BY 1),
e AS (SELECT feature, CASE WHEN hi <= lo THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN hi <= lo THEN hi + 0.5 ELSE hi END AS hi FROM e0),
s AS (SELECT feature, min(lo) AS lo, min(hi) AS hi, count(*) FILTER (value BETWEEN lo AND hi) AS n, count(*) FILTER (NOT value BETWEEN lo AND hi) AS clipped, min(value) FILTER (value BETWEEN lo AND hi) AS least,
  max(value) FILTER (value BETWEEN lo AND hi) AS most, quantile_cont(value, 0.25) FILTER (value BETWEEN lo AND hi) AS q1, quantile_cont(value, 0.75) FILTER (value BETWEEN lo AND hi) AS q3 FROM v JOIN e USING (feature) GROUP BY 1),
b0 AS (SELECT *, least > 0 AND most / least > 50 AS log, CASE WHEN q3 > q1 THEN least(2 * (q3 - q1) / cbrt(n), (most - least) / (log2(n) + 1)) ELSE (most - least) / (log2(n) + 1) END AS w FROM s),
b AS (SELECT *, (CASE WHEN log THEN least(greatest(floor(sqrt(n)), 20), 60) ELSE least(greatest(CASE WHEN most > least THEN ceil((most - least) / w) ELSE 1 END, 15), 80) END)::INTEGER AS bins FROM b0),
r AS (SELECT *, CASE WHEN log THEN ln(lo) ELSE lo END AS a, (CASE WHEN log THEN ln(hi) ELSE hi END - CASE WHEN log THEN ln(lo) ELSE lo END) / bins AS step FROM b),
c AS (SELECT v.feature, label, least(floor((CASE WHEN log THEN ln(value) ELSE value END - a) / step), bins - 1)::INTEGER AS bin, count(*) AS count FROM v JOIN r USING (feature) WHERE value BETWEEN lo AND hi GROUP BY 1, 2, 3),
g AS (SELECT r.*, label, unnest(range(bins))::INTEGER AS bin FROM r JOIN (SELECT DISTINCT feature, label FROM v) USING (feature)),
h AS (SELECT g.feature, g.label, g.bin, CASE WHEN log THEN exp(a + g.bin * step) ELSE a + g.bin * step END AS l, CASE WHEN log THEN exp(a + (g.bin + 1) * step) ELSE a + (g.bin + 1) * step END AS rt, coalesce(count, 0) AS count
  FROM g LEFT JOIN c ON g.feature = c.feature AND g.label = c.label AND g.bin = c.bin),
p AS (SELECT *, count / sum(count) OVER (PARTITION BY feature, label) / (rt - l) AS pdf FROM h)
"""


@query("a6_histogram_stats", _HIST + f"SELECT feature, label, bin, count, {rn('l')} AS \"left\", {rn('rt')} AS \"right\", {rn('pdf')} AS pdf, {rn('pdf / max(pdf) OVER (PARTITION BY feature, label)')} AS pdf_norm FROM p")
def a6(spark, d):
    out = A.histogram_stats(X.features(spark, d), list(FEATURES))
    return out.select("feature", "label", "bin", "count", *[n6(c).alias(c) for c in ("left", "right", "pdf", "pdf_norm")])


@query("a7_clipped_counts", _HIST + "SELECT feature, clipped FROM s")
def a7(spark, d):
    return A.clipped_counts(X.features(spark, d), list(FEATURES))


@query("a8_bin_edges", f"SELECT k, round(k * 0.25::DOUBLE, 6) AS edge FROM (SELECT unnest(range((floor(min(value) / 0.25::DOUBLE) - 2)::BIGINT, (ceil(max(value) / 0.25::DOUBLE) + 3)::BIGINT)) AS k FROM ({LAP}))")
def a8(spark, d):
    return A.bin_edges(X.lap(spark, d), "value", 0.25).select("k", r6("edge").alias("edge"))


_LAPS = f"SELECT ms_idx, floor(value / 0.25::DOUBLE)::BIGINT AS k, count(*) AS count FROM ({LAP}) GROUP BY 1, 2"


@query("a9_lap_histogram", f"SELECT ms_idx, k, count, {rn('count / sum(count) OVER (PARTITION BY ms_idx)')} AS share FROM ({_LAPS})")
def a9(spark, d):
    return A.lap_histogram(X.lap(spark, d), "value", "ms_idx", 0.25).withColumn("share", n6("share"))


@query("a10_heatmap_matrix", "SELECT round(k * 0.25::DOUBLE, 6) AS \"left\", round((k + 0.5::DOUBLE) * 0.25::DOUBLE, 6) AS centre, round((k + 1) * 0.25::DOUBLE, 6) AS \"right\", " + ", ".join(rn(f"coalesce(max(share) FILTER (ms_idx = {i}), 0)") + f" AS MS_IDX_{i}" for i in range(1, 8)) + f" FROM (SELECT *, count / sum(count) OVER (PARTITION BY ms_idx) AS share FROM ({_LAPS})) GROUP BY k")
def a10(spark, d):
    out = A.heatmap_matrix(A.lap_histogram(X.lap(spark, d), "value", "ms_idx", 0.25), "ms_idx", list(range(1, 8)), 0.25)
    return out.select(*[r6(c).alias(c) for c in out.columns[:3]], *[n6(c).alias(c) for c in out.columns[3:]])


@query("a11_box_stats", f"""
WITH v AS ({LAP}), q AS (SELECT ms_idx, quantile_cont(value, 0.25) AS q1, median(value) AS med, quantile_cont(value, 0.75) AS q3 FROM v GROUP BY 1)
SELECT v.ms_idx, {rn('min(q1)')} AS q1, {rn('min(med)')} AS median, {rn('min(q3)')} AS q3, {rn('min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))')} AS low,
  {rn('max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))')} AS high, count(*) FILTER (NOT value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS fliers
FROM v JOIN q ON v.ms_idx = q.ms_idx GROUP BY 1
""")
def a11(spark, d):
    out = A.box_stats(X.lap(spark, d), "value", "ms_idx")
    return out.select("ms_idx", *[n6(c).alias(c) for c in ("q1", "median", "q3", "low", "high")], "fliers")


@query("a12_file_metrics", "SELECT count(*) AS total, count(*) FILTER (c = 1) AS ok, count(*) FILTER (c IN (2, 3)) AS required_missing, count(*) FILTER (c = 4) AS group_missing, count(*) FILTER (c = 0) AS errors FROM (SELECT o_orderkey % 5 AS c FROM orders)")
def a12(spark, d):
    return A.file_metrics(t(spark, d, "orders").select((F.col("o_orderkey") % 5).alias("code")))


_NAMES = "['" + "', '".join(CLASSES) + "']"
_CM = f"""
WITH q AS (SELECT id, file, label AS truth, {_NAMES}[pred + 1] AS pred, pmax FROM ({PREDICTED})),
l AS (SELECT truth AS c FROM q UNION SELECT pred FROM q),
n AS (SELECT a.c AS truth, b.c AS pred, count(q.id) AS n FROM l a CROSS JOIN l b LEFT JOIN q ON q.truth = a.c AND q.pred = b.c GROUP BY 1, 2),
m AS (SELECT *, 100.0 * n / nullif(sum(n) OVER (PARTITION BY truth), 0) AS percent FROM n)
"""


def _cm(spark, d):
    names = F.array(*[F.lit(c) for c in CLASSES])
    p = C.argmax_prob(X.predictions(spark, d)).select("label", F.get(names, F.col("pred")).alias("said"))
    return A.confusion(p, "label", "said")


@query("a13_confusion", _CM + f"SELECT truth, pred, n, {rn('percent')} AS percent FROM m")
def a13(spark, d):
    return _cm(spark, d).withColumn("percent", n6("percent"))


_REPORT = _CM + """
, h AS (SELECT truth AS name, sum(n) FILTER (truth = pred) AS hit, sum(n) AS support FROM n GROUP BY 1), s AS (SELECT pred AS name, sum(n) AS said FROM n GROUP BY 1),
e AS (SELECT name, support, hit, coalesce(hit / nullif(said, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall FROM h JOIN s USING (name)),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM e),
r AS (SELECT name, support, precision, recall, f1 FROM f UNION ALL SELECT 'accuracy', sum(support), sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support) FROM f
  UNION ALL SELECT 'macro avg', sum(support), avg(precision), avg(recall), avg(f1) FROM f
  UNION ALL SELECT 'weighted avg', sum(support), sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support) FROM f)
"""


@query("a14_classification_report", _REPORT + f"SELECT name, support::BIGINT AS support, {rn('precision')} AS precision, {rn('recall')} AS recall, {rn('f1')} AS f1 FROM r")
def a14(spark, d):
    out = A.classification_report(_cm(spark, d))
    return out.select("name", "support", *[n6(c).alias(c) for c in ("precision", "recall", "f1")])


@query("a15_f1", _REPORT + f"SELECT name, {rn('f1')} AS f1 FROM r WHERE name <> 'weighted avg'")
def a15(spark, d):
    return A.f1(_cm(spark, d), "class", "macro", "micro").select("name", n6("f1").alias("f1"))


def _mix(where: str) -> str:
    pct = ", ".join(f"round(coalesce(100.0 * count(*) FILTER ({where} AND pred = {k}) / nullif(count(*) FILTER ({where}), 0), 0) + 1e-7, 2) AS pct_{c}" for k, c in enumerate(CLASSES))
    return f"SELECT file, count(*) FILTER ({where}) AS count, {pct}, round(avg(pmax) FILTER ({where}) + 1e-7, 4) AS mean_pmax"


@query("a16_mixture_ratio", _mix("true") + f", round(100.0 * count(*) FILTER (pmax >= 0.8) / count(*) + 1e-7, 2) AS pct_confident FROM ({PREDICTED}) GROUP BY file")
def a16(spark, d):
    return A.mixture_ratio(X.predictions(spark, d), "file", CLASSES)


@query("a17_mixture_ratio_highconf", _mix("pmax >= 0.8") + f", count(*) FILTER (pmax < 0.8) AS count_excluded FROM ({PREDICTED}) GROUP BY file")
def a17(spark, d):
    return A.mixture_ratio(X.predictions(spark, d), "file", CLASSES, only_confident=True)


_IMPORTANCE = "SELECT 'dim' || (i - 1) || ['_fft_coefficient', '_mean', '_number_peaks', '_zz'][(i - 1) % 4 + 1] AS feature, avg(abs(embedding[i]::DOUBLE)) AS importance_mean FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY i"


def _importance(spark, d):
    tail = F.array(*[F.lit(x) for x in ("_fft_coefficient", "_mean", "_number_peaks", "_zz")])
    e = t(spark, d, "embeddings").select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.abs(F.col("x").cast("double"))).alias("importance_mean"))
    return e.select(F.concat(F.lit("dim"), F.col("i").cast("string"), F.get(tail, F.col("i") % 4)).alias("feature"), "importance_mean")


_CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(lower(feature), '{p}') THEN '{v}'" for v, p in C.CATEGORY_PATTERNS) + " ELSE 'other' END"


@query("a18_category_summary", f"SELECT {_CATEGORY} AS category, {rn('sum(importance_mean)')} AS total, {rn('avg(importance_mean)')} AS mean, count(*) AS n FROM ({_IMPORTANCE}) GROUP BY 1")
def a18(spark, d):
    out = A.category_summary(_importance(spark, d))
    return out.select("category", n6("total").alias("total"), n6("mean").alias("mean"), "n")


_CENT = f"""
WITH v AS ({FEATURE_ROWS}), z AS (SELECT feature, label, (value - avg(value) OVER f) / CASE WHEN stddev_pop(value) OVER f = 0 THEN 1 ELSE stddev_pop(value) OVER f END AS z FROM v WINDOW f AS (PARTITION BY feature)),
c AS (SELECT label, feature, avg(z) AS centre, count(*) AS n FROM z GROUP BY 1, 2),
d AS (SELECT a.label AS a, b.label AS b, sqrt(sum((a.centre - b.centre) ** 2)) AS distance FROM c a JOIN c b ON a.feature = b.feature GROUP BY 1, 2)
"""


def _cent(spark, d):
    return A.centroids(X.features(spark, d), list(FEATURES))


@query("a19_centroids", _CENT + f"SELECT label, feature, {rn('centre')} AS centre, n FROM c")
def a19(spark, d):
    return _cent(spark, d).withColumn("centre", n6("centre"))


@query("a20_class_distance", _CENT + f"SELECT a, b, {rn('distance')} AS distance FROM d")
def a20(spark, d):
    return A.class_distance(_cent(spark, d), ordered=False).withColumn("distance", n6("distance"))


@query("j10_class_pairs", _CENT + f"SELECT a.label AS a, b.label AS b, a.feature, {rn('a.centre')} AS x, {rn('b.centre')} AS y FROM c a JOIN c b ON a.feature = b.feature AND a.label < b.label")
def j10(spark, d):
    return A.class_pairs(_cent(spark, d)).select("a", "b", "feature", n6("x").alias("x"), n6("y").alias("y"))


@query("a21_centroid_edges", _CENT + "SELECT a, b, round(1 / (distance + 1e-6), 3) AS weight, a = 'A' AND b = 'N' AS known FROM d WHERE a < b AND distance <= 10")
def a21(spark, d):
    path = spark.createDataFrame([("N", "A"), ("Q", "Z")], "a string, b string")
    return A.centroid_edges(A.class_distance(_cent(spark, d)), 10.0, path).select("a", "b", F.round("weight", 3).alias("weight"), "known")


@query("a22_confidence_ellipse", """
WITH m AS (SELECT l_returnflag AS label, count(*) AS n, avg(l_quantity) AS cx, avg(l_extendedprice) AS cy, var_samp(l_quantity) AS vx, var_samp(l_extendedprice) AS vy, covar_samp(l_quantity, l_extendedprice) AS c FROM lineitem GROUP BY 1 HAVING count(*) >= 3),
h AS (SELECT *, sqrt(((vx - vy) / 2) ** 2 + c * c) AS half, (vx + vy) / 2 AS mid FROM m)
SELECT label, n, round(cx, 5) AS cx, round(cy, 3) AS cy, round(2 * sqrt((mid + half) * (-2 * ln(1 - 0.95::DOUBLE))), 2) AS width, round(2 * sqrt(greatest(mid - half, 0) * (-2 * ln(1 - 0.95::DOUBLE))), 2) AS height, round(degrees(atan2(2 * c, vx - vy) / 2), 4) AS angle FROM h
""")
def a22(spark, d):
    out = A.confidence_ellipse(t(spark, d, "lineitem").withColumnRenamed("l_returnflag", "label"), "l_quantity", "l_extendedprice")
    return out.select("label", "n", F.round("cx", 5).alias("cx"), F.round("cy", 3).alias("cy"), F.round("width", 2).alias("width"), F.round("height", 2).alias("height"), F.round("angle", 4).alias("angle"))


_PAIRS = _CM + """
, v AS (SELECT event_type AS label, 'value' AS feature, value FROM events UNION ALL SELECT event_type, 'k', json_extract(props, '$.k')::DOUBLE FROM events),
z AS (SELECT feature, label, (value - avg(value) OVER f) / stddev_pop(value) OVER f AS z FROM v WINDOW f AS (PARTITION BY feature)),
c AS (SELECT label, feature, avg(z) AS centre FROM z GROUP BY 1, 2),
d AS (SELECT a.label AS a, b.label AS b, sqrt(sum((a.centre - b.centre) ** 2)) AS distance FROM c a JOIN c b ON a.feature = b.feature AND a.label < b.label GROUP BY 1, 2),
p AS (SELECT d.*, (x.percent + y.percent) / 2 AS error FROM d JOIN m x ON x.truth = a AND x.pred = b JOIN m y ON y.truth = b AND y.pred = a)
"""


def _pairs(spark, d):
    e = t(spark, d, "events").select(F.col("event_type").alias("label"), "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    return A.pair_confusion(A.class_distance(A.centroids(e, ["value", "k"])), _cm(spark, d))


@query("j11_pair_confusion", _PAIRS + f"SELECT a, b, {rn('distance')} AS distance, {rn('error')} AS error FROM p")
def j11(spark, d):
    return _pairs(spark, d).select("a", "b", n6("distance").alias("distance"), n6("error").alias("error"))


@query("a23_distance_confusion", _PAIRS + f""", k AS (SELECT *, rank() OVER (ORDER BY distance) AS rd, rank() OVER (ORDER BY error) + (count(*) OVER (PARTITION BY error) - 1) / 2.0 AS re FROM p)
SELECT count(*) AS n, {rn('corr(distance, error)', 5)} AS pearson, {rn('corr(rd, re)', 5)} AS spearman, {rn('regr_slope(error, distance)', 4)} AS slope, {rn('regr_intercept(error, distance)', 4)} AS intercept FROM k""")
def a23(spark, d):
    out = A.distance_confusion(_pairs(spark, d))
    return out.select("n", F.round("pearson", 5).alias("pearson"), F.round("spearman", 5).alias("spearman"), F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


# ---------------------------------------------------------------- tests


@query("n1_anova", f"""
WITH g AS (SELECT feature, label, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM ({FEATURE_ROWS}) GROUP BY 1, 2),
s AS (SELECT feature, count(*) AS k, sum(n) AS n, sum(n * v) AS ssw, sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS ssb FROM g GROUP BY 1)
SELECT feature, k, n::BIGINT AS n, round(ssb / (k - 1) / (ssw / (n - k)), 3) AS f, round(ssb / (ssb + ssw), 6) AS eta_sq FROM s WHERE k >= 2
""")
def n1(spark, d):
    return H.anova(X.features(spark, d), list(FEATURES)).select("feature", "k", "n", F.round("f", 3).alias("f"), r6("eta_sq").alias("eta_sq"))


@query("n2_kruskal", f"""
WITH v AS ({FEATURE_ROWS}), r AS (SELECT feature, label, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS rank FROM v),
g AS (SELECT feature, label, sum(rank) AS r, count(*) AS n FROM r GROUP BY 1, 2), ti AS (SELECT feature, sum(c::DOUBLE ** 3 - c) AS ties FROM (SELECT feature, value, count(*) AS c FROM v GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT feature, count(*) AS k, sum(n)::DOUBLE AS n, sum(r * r / n) AS q FROM g GROUP BY 1),
h AS (SELECT feature, k, n, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n ** 3 - n)) AS h FROM s JOIN ti USING (feature))
SELECT feature, k, n::BIGINT AS n, round(h, 3) AS h, round((h - k + 1) / (n - k), 6) AS epsilon_sq FROM h
""")
def n2(spark, d):
    return H.kruskal(X.features(spark, d), list(FEATURES)).select("feature", "k", "n", F.round("h", 3).alias("h"), r6("epsilon_sq").alias("epsilon_sq"))


_GROUPS = f"""
WITH v AS ({FEATURE_ROWS}), r AS (SELECT feature, label, value, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS rank FROM v),
g AS (SELECT feature, label, sum(rank) AS r, count(*)::DOUBLE AS n, avg(value) AS m, var_pop(value) AS v FROM r GROUP BY 1, 2),
ti AS (SELECT feature, sum(c::DOUBLE ** 3 - c) AS ties FROM (SELECT feature, value, count(*) AS c FROM v GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT feature, count(*) AS k, sum(n) AS n, sum(r * r / n) AS q, sum(n * v) AS ssw, sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS ssb FROM g GROUP BY 1)
"""


# the tails of three classes (two degrees of freedom) have closed forms
@query("n3_p_values", _GROUPS + """
SELECT feature, 'anova' AS test, round((1 + ssb / ssw) ** (-(n - 3) / 2), 6) AS p FROM s WHERE k = 3
UNION ALL SELECT feature, 'kruskal', round(exp(-(12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n ** 3 - n)) / 2), 6) FROM s JOIN ti USING (feature) WHERE k = 3
""")
def n3(spark, d):
    a = H.anova(X.features(spark, d), list(FEATURES)).withColumns({"d1": F.col("k") - 1, "d2": F.col("n") - F.col("k")})
    h = H.kruskal(X.features(spark, d), list(FEATURES)).withColumn("d1", F.col("k") - 1)
    both = H.p_values(a, "f", "f", "d1", "d2").select("feature", F.lit("anova").alias("test"), "p").union(H.p_values(h, "chi2", "h", "d1").select("feature", F.lit("kruskal"), "p"))
    return both.withColumn("p", F.round("p", 6))


@query("n4_select_features")
def n4(spark, d):
    return H.select_features(X.features(spark, d), list(FEATURES))


@query("n4_mann_whitney", _GROUPS + """
SELECT g.feature, label, round((g.r - g.n * (s.n + 1) / 2) / sqrt(g.n * (s.n - g.n) / 12 * (s.n + 1 - ties / (s.n * (s.n - 1)))), 5) AS z FROM g JOIN s USING (feature) JOIN ti USING (feature)
""")
def n4_ranks(spark, d):
    return H.mann_whitney(X.features(spark, d), list(FEATURES)).withColumn("z", F.round("z", 5))


FLAGS = {"odd_line": "l_linenumber % 2", "taxed": "CAST(l_tax > 0.04 AS INT)", "many": "CAST(l_quantity >= 48 AS INT)", "early": "CAST(l_orderkey % 3 = 0 AS INT)"}


@query("n4_fisher", f"""
WITH v AS ({" UNION ALL ".join(f"SELECT '{n}' AS feature, l_returnflag AS label, {e} AS value FROM lineitem" for n, e in FLAGS.items())}),
o AS (SELECT feature, label, count(*) FILTER (value = 1) AS a, count(*) FILTER (value = 0) AS b FROM v GROUP BY 1, 2),
f AS (SELECT *, (sum(a) OVER w)::BIGINT - a AS c, (sum(b) OVER w)::BIGINT - b AS d FROM o WINDOW w AS (PARTITION BY feature)),
x AS (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS x FROM f),
l AS (SELECT *, lgamma(a + b + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) + lgamma(c + d + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1)
  - lgamma(a + b + c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) AS lp FROM x),
t AS (SELECT *, max(lp) FILTER (x = a) OVER (PARTITION BY feature, label) AS own FROM l)
SELECT feature, label, a, b, c, d, round(least(1.0, sum(exp(lp)) FILTER (lp <= own + 1e-7)), 6) AS p FROM t GROUP BY ALL
""")
def n4_fisher(spark, d):
    flags = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("label"), *[F.expr(e).alias(n) for n, e in FLAGS.items()])
    return H.fisher_exact(H.binary_tables(A.value_counts(flags, list(FLAGS)))).withColumn("p", F.round("p", 6))
