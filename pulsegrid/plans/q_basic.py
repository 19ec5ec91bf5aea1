"""Queries of sources, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import columns as C
from pulsegrid.operators import filters as O
from pulsegrid.sources import tables as S

from . import fixtures as X
from .fixtures import META, PREDICTED, TRACE, r6
from .register import query


def _groups(spark, d):
    """A channel table: one row per user and event type; some users are made unreadable or short by rule."""
    e = X.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    u = F.col("user_id")
    group = F.when(u % 11 == 0, None).when(u % 7 == 0, F.lit("Other")).otherwise(F.lit("Data"))
    channel = F.when(u % 5 == 0, F.lit("Ch2")).otherwise(F.lit("Ch1"))
    return e.select(u.cast("string").alias("file"), group.alias("group"), channel.alias("channel"), F.when(u % 3 == 0, 2).otherwise(F.col("n")).alias("n_points"))


_GROUPS = """
SELECT user_id::VARCHAR AS file, CASE WHEN user_id % 11 = 0 THEN NULL WHEN user_id % 7 = 0 THEN 'Other' ELSE 'Data' END AS grp,
  CASE WHEN user_id % 5 = 0 THEN 'Ch2' ELSE 'Ch1' END AS channel, CASE WHEN user_id % 3 = 0 THEN 2 ELSE count(*) END AS n_points
FROM events GROUP BY user_id, event_type
"""


@query("s1_read_acquisition", "SELECT o.o_orderkey AS file, count(l_orderkey) AS n_points, round(sum(l_quantity), 6) AS total FROM orders o JOIN lineitem l ON o_orderkey = l_orderkey GROUP BY 1")
def s1(spark, d):
    g = S.read_acquisition(spark, d, ("orders", "lineitem"))
    head, points = g["orders"].select(F.col("o_orderkey").alias("file")), g["lineitem"].select(F.col("l_orderkey").alias("file"), "l_quantity")
    return head.join(points, "file").groupBy("file").agg(F.count("*").alias("n_points"), r6(F.sum("l_quantity")).alias("total"))


@query("s2_list_files")
def s2(spark, d):
    return S.list_files(spark, d, "*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("name"), "length").where("length > 0")


@query("s3_find_dirs", """
SELECT DISTINCT regexp_extract(url, '^(https?://[^/]*/[^/]*)/', 1) AS dir, regexp_extract(url, '^https?://[^/]*/([a-z]{2})/', 1) AS lang FROM pages
WHERE regexp_matches(url, '^https?://[^/]*/[a-z]{2}/') AND regexp_extract(url, '^https?://[^/]*/([^/]*)/', 1) IN ('en', 'fr', 'de', 'es')
""")
def s3(spark, d):
    files = X.table(spark, d, "pages").select(F.col("url").alias("path"))
    found = None
    for lang in ("en", "fr", "de", "es"):
        one = S.find_dirs(files, lang).where(F.element_at(F.split("dir", "/"), -1) == lang).where(F.size(F.split("dir", "/")) == 4)
        one = one.select("dir", F.lit(lang).alias("lang"))
        found = one if found is None else found.union(one)
    return found


@query("s4_list_samples", """
SELECT DISTINCT split_part(substr(url, 9), '/', 1) AS sample FROM pages WHERE url LIKE 'https://%/%'
""")
def s4(spark, d):
    return S.list_samples(X.table(spark, d, "pages").select(F.col("url").alias("path")).where("url like 'https://%/%'"), "https://")


@query("s5_scan_quality", f"""
SELECT file, (CASE WHEN count(grp) = 0 THEN 0 WHEN count(*) FILTER (grp = 'Data') = 0 THEN 4 WHEN count(*) FILTER (grp = 'Data' AND channel = 'Ch1') = 0 THEN 3
  WHEN coalesce(max(n_points) FILTER (grp = 'Data' AND channel = 'Ch1'), 0) < 3 THEN 2 ELSE 1 END)::INTEGER AS code FROM ({_GROUPS}) GROUP BY file
""")
def s5(spark, d):
    return S.scan_quality(_groups(spark, d))


@query("s6_require_groups", "SELECT user_id::VARCHAR AS file FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY user_id HAVING count(DISTINCT event_type) = 3")
def s6(spark, d):
    e = X.table(spark, d, "events").select(F.col("user_id").cast("string").alias("file"), F.col("event_type").alias("group"))
    return S.require_groups(e, ["click", "view", "error"])


_LAPS = """
SELECT l_returnflag AS target, l_extendedprice AS value, l_linenumber AS ms_idx, l_linestatus AS assigned_base FROM lineitem WHERE l_linenumber < 4
UNION ALL SELECT l_returnflag, l_extendedprice, l_linenumber, NULL FROM lineitem WHERE l_linenumber >= 5
"""


def _laps(spark, d):
    li = X.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("target"), F.col("l_extendedprice").alias("value"), F.col("l_linenumber").alias("ms_idx"), F.col("l_linestatus").alias("assigned_base"))
    tables = [li.where("ms_idx < 4"), li.where("ms_idx = 4").drop("value"), li.where("ms_idx >= 5").drop("assigned_base")]
    return S.read_lap(tables, ["target", "value", "ms_idx"], ["assigned_base"])


@query("s7_read_lap", _LAPS)
def s7(spark, d):
    return _laps(spark, d)


@query("u2_union_lap", f"SELECT assigned_base, count(*) AS n, round(sum(value), 2) AS total FROM ({_LAPS}) GROUP BY 1")
def u2(spark, d):
    return _laps(spark, d).groupBy("assigned_base").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("s8_read_table", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s8(spark, d):
    return S.read_table(spark, f"{d}/nation")


@query("s9_conform_columns", "SELECT event_id::BIGINT AS id, user_id::VARCHAR AS file, value::DOUBLE AS signal_intensity, ts AS measured FROM events")
def s9(spark, d):
    mapping = {"event_id": ("id", "long"), "user_id": ("file", "string"), "value": ("signal_intensity", "double"), "ts": ("measured", "timestamp")}
    return S.conform_columns(X.table(spark, d, "events"), mapping)


@query("s13_run_manifest", "SELECT count(*) AS n_rows, count(DISTINCT label) AS n_labels FROM embeddings")
def s13(spark, d):
    e = X.table(spark, d, "embeddings")
    n, k = e.agg(F.count("*"), F.count_distinct("label")).first()
    m = S.run_manifest(spark, {"rows": n, "labels": k}, {"dims": 64}, {"both": 1.0})
    return m.select(F.get_json_object("settings", "$.rows").cast("long").alias("n_rows"), F.get_json_object("settings", "$.labels").cast("long").alias("n_labels"))


@query("s14_export_clip", f"SELECT file, idx, round(y, 6) AS y, round(idx * 1e-4, 6) AS t FROM ({TRACE}) WHERE idx BETWEEN 100 AND 250")
def s14(spark, d):
    out = S.export_clip(X.trace(spark, d), 0.01005, 0.02495, 0.0001)
    return out.select("file", "idx", r6("y").alias("y"), r6("t").alias("t"))


@query("a24_source_fingerprint")
def a24(spark, d):
    return S.source_fingerprint(X.table(spark, d, "lineitem")).select("path", "size")


# ---------------------------------------------------------------- projections


@query("p1_to_sample_index", """
SELECT event_id, trunc(value / 7 * 10000)::INTEGER AS peak_idx, trunc(value / 9 * 10000)::INTEGER AS start_idx, trunc(-value / 9 * 10000)::INTEGER AS end_idx,
  trunc(value * 10)::INTEGER AS tl, round(value, 6) AS region_bl, round(value - 50, 6) AS region_std FROM events
""")
def p1(spark, d):
    v = F.col("value")
    e = X.table(spark, d, "events").select("event_id", (v / 7).alias("peak_s"), (v / 9).alias("start_s"), (-v / 9).alias("end_s"), v.alias("tl_ms"), v.alias("region_bl"), (v - 50).alias("region_std"))
    return C.to_sample_index(e).withColumn("region_std", F.col("region_std") + 0.0)


@query("p2_sample_name", """
SELECT c_custkey, CASE WHEN contains(f, ' D_') THEN left(f, instr(f, ' D_') - 1) ELSE left(f, length(f) - 1) END AS sample_name
FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name || ' D_' || c_mktsegment ELSE c_name END AS f FROM customer)
""")
def p2(spark, d):
    c = X.table(spark, d, "customer")
    f = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit(" D_"), "c_mktsegment")).otherwise(F.col("c_name"))
    return c.select("c_custkey", C.sample_name(f).alias("sample_name"))


@query("p3_class_label", f"SELECT event_id, split_part(sample, '_', 1) AS label FROM ({META})")
def p3(spark, d):
    return X.meta(spark, d).select("event_id", C.class_label(F.col("sample")).alias("label"))


_KEYS = """
SELECT *, nullif(regexp_extract({name}, '#(\\d+)\\s*$', 1), '')::INTEGER AS file_number, nullif(regexp_extract({ex}, '^(\\d{{8}}_\\d{{4}})\\s+AN#(\\d+)', 2), '')::INTEGER AS machine_no,
  try_strptime(nullif(regexp_extract({ex}, '^(\\d{{8}}_\\d{{4}})\\s+AN#(\\d+)', 1), ''), '%Y%m%d_%H%M') AS measured_at FROM ({src})
"""
KEYS = _KEYS.format(name="sample_name", ex="ex_id", src=META)


@query("p4_derive_keys", f"SELECT event_id, file_number, machine_no, measured_at FROM ({KEYS})")
def p4(spark, d):
    return C.derive_keys(X.meta(spark, d)).select("event_id", "file_number", "machine_no", "measured_at")


_P5 = _KEYS.format(name="file", ex="Ex_ID", src="SELECT c_custkey AS id, c_name || CASE WHEN c_custkey % 3 = 0 THEN ' x' ELSE '' END AS file, '20260501_1444 AN#' || c_nationkey AS Ex_ID FROM customer")


@query("p5_derive_keys_by_name", f"SELECT id, file_number, machine_no, measured_at FROM ({_P5})")
def p5(spark, d):
    c = X.table(spark, d, "customer")
    name = F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, " x").otherwise(""))
    df = c.select(F.col("c_custkey").alias("id"), name.alias("file"), F.concat(F.lit("20260501_1444 AN#"), F.col("c_nationkey").cast("string")).alias("Ex_ID"))
    return C.derive_keys(df, "file", "Ex_ID").select("id", "file_number", "machine_no", "measured_at")


@query("p8_unmatched_counts", f"SELECT count(*) FILTER (file_number IS NULL) AS file_number_null, count(*) FILTER (machine_no IS NULL) AS machine_no_null, count(*) FILTER (measured_at IS NULL) AS measured_at_null FROM ({_P5})")
def p8(spark, d):
    return C.unmatched_counts(p5(spark, d))


@query("p6_signal_features", f"SELECT event_id, round(signal, 6) AS relative_signal, round(signal + baseline, 6) AS absolute_signal FROM ({META})")
def p6(spark, d):
    return C.signal_features(X.meta(spark, d)).select("event_id", r6("relative_signal").alias("relative_signal"), r6("absolute_signal").alias("absolute_signal"))


@query("p7_global_id", f"SELECT event_id, sample || '__' || event_id AS global_id FROM ({META})")
def p7(spark, d):
    return X.meta(spark, d).select("event_id", C.global_id(F.col("sample"), F.col("event_id")).alias("global_id"))


@query("p9_numeric_coerce", "SELECT o_orderkey, try_cast(left(o_orderpriority, 1) AS DOUBLE) AS p FROM orders WHERE o_orderkey % 3 <> 0")
def p9(spark, d):
    text = F.when(F.col("o_orderkey") % 3 == 0, F.lit("n/a")).otherwise(F.left("o_orderpriority", F.lit(1)))
    return C.numeric_coerce(X.table(spark, d, "orders").select("o_orderkey", text.alias("p")), ["p"])


_NAMES = "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'ab' ELSE 'AB@' END || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || '_5678_9012_ID' || o_custkey || '.x' AS name FROM orders"


@query("p10_normalise_file_name", f"""
SELECT o_orderkey, CASE WHEN regexp_matches(name, '^([A-Z@0-9]+)(\\d{{4}}_\\d{{4}}_\\d{{4}})_([A-Za-z0-9#]+).*') THEN
  regexp_replace(name, '^([A-Z@0-9]+)(\\d{{4}}_\\d{{4}}_\\d{{4}})_([A-Za-z0-9#]+).*', '\\1\\2_\\3.tdms') END AS new_name, o_orderkey % 4 = 0 AS skipped FROM ({_NAMES})
""")
def p10(spark, d):
    o = X.table(spark, d, "orders")
    head = F.when(F.col("o_orderkey") % 4 == 0, "ab").otherwise("AB@")
    name = F.concat(head, F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"), F.lit("_5678_9012_ID"), F.col("o_custkey").cast("string"), F.lit(".x"))
    return C.normalise_file_name(o.select("o_orderkey", name.alias("name"))).select("o_orderkey", "new_name", "skipped")


_CATEGORY = "CASE WHEN p_type = 'PROMO' THEN 'special' " + " ".join(f"WHEN regexp_matches(lower(p_name), '{p}') THEN '{v}'" for v, p in C.CATEGORY_PATTERNS) + " ELSE 'other' END"


@query("p11_feature_category", f"SELECT p_partkey, {_CATEGORY} AS category FROM (SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN 'PROMO' ELSE '' END AS p_type, ['value__fft_coefficient__coeff_0', 'Value__Agg_Autocorrelation', 'value__number_peaks__n_1', 'value__linear_trend', 'value__maximum', 'value__fft_aggregated__variance', 'value__length', 'zzz', 'value__mean', 'value__mean_abs_change', 'value__c3__lag_1', 'value__skewness', 'value__longest_strike_above_mean', 'value__large_standard_deviation', 'x_c30'][p_partkey % 15 + 1] AS p_name FROM part)")
def p11(spark, d):
    p = X.table(spark, d, "part")
    names = F.array(*[F.lit(x) for x in ("value__fft_coefficient__coeff_0", "Value__Agg_Autocorrelation", "value__number_peaks__n_1", "value__linear_trend", "value__maximum", "value__fft_aggregated__variance", "value__length", "zzz", "value__mean", "value__mean_abs_change", "value__c3__lag_1", "value__skewness", "value__longest_strike_above_mean", "value__large_standard_deviation", "x_c30")])
    name = F.when(F.col("p_partkey") % 50 == 0, "PROMO").otherwise(F.get(names, (F.col("p_partkey") % 15).cast("int")))
    return p.select("p_partkey", C.feature_category(name, extra={"PROMO": "special"}).alias("category"))


@query("p12_argmax_prob", f"SELECT id, pred::INTEGER AS pred, round(pmax, 6) AS pmax FROM ({PREDICTED})")
def p12(spark, d):
    return C.argmax_prob(X.predictions(spark, d)).select("id", "pred", r6("pmax").alias("pmax"))


@query("p13_time_axis", f"SELECT file, idx, round(idx * 1e-4, 6) AS t FROM ({TRACE})")
def p13(spark, d):
    return C.time_axis(X.trace(spark, d)).select("file", "idx", r6("t").alias("t"))


@query("p14_status_of", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'NO_T_FOLDER' WHEN o_orderkey % 5 = 1 THEN 'T_EMPTY' WHEN o_orderkey % 5 = 2 THEN 'NO_ANAL_FOLDER'
  WHEN o_orderkey % 5 = 3 THEN 'ANAL_NOT_DONE' ELSE 'OK' END AS status FROM orders
""")
def p14(spark, d):
    k = F.col("o_orderkey") % 5
    return X.table(spark, d, "orders").select("o_orderkey", C.status_of(F.when(k > 0, k - 1), F.when(k > 2, k - 3)).alias("status"))


@query("p15_strip_name", """SELECT page_id, regexp_replace(replace(url, '@', ''), '[\\\\/:*?"<>|]+', '_', 'g') AS name FROM pages""")
def p15(spark, d):
    return X.table(spark, d, "pages").select("page_id", C.strip_name(F.col("url")).alias("name"))


@query("p16_label_index", "SELECT event_id, (dense_rank() OVER (ORDER BY event_type) - 1)::INTEGER AS y FROM events")
def p16(spark, d):
    return C.label_index(X.table(spark, d, "events").select("event_id", F.col("event_type").alias("label"))).select("event_id", "y")


# ---------------------------------------------------------------- filters


@query("f1_min_duration", f"SELECT event_id, duration FROM ({META}) WHERE duration > 10")
def f1(spark, d):
    return O.min_duration(X.meta(spark, d)).select("event_id", "duration")


@query("f2_range_filter_meta", f"SELECT event_id FROM ({META}) WHERE duration BETWEEN 6 AND 999 AND baseline BETWEEN -299 AND 999 AND signal BETWEEN 1e-12 AND 1000 - 1e-12")
def f2(spark, d):
    return O.range_filter(X.meta(spark, d)).select("event_id")


@query("f3_range_filter_strict", f"SELECT event_id FROM ({META}) WHERE duration > 10 AND duration < 1000 AND baseline > -300 AND baseline < 300 AND signal > 10 AND signal < 1000")
def f3(spark, d):
    return O.range_filter(X.meta(spark, d), "strict").select("event_id")


SPEC = {"file_number": {"min": 1, "max": 15, "exclude": [7]}, "machine_no": {"include": [1, 3]}, "measured_at": {"min": "2024-01-03", "max": "2024-01-20"}}
_WHERE = "file_number BETWEEN 1 AND 15 AND file_number <> 7 AND machine_no IN (1, 3) AND measured_at BETWEEN '2024-01-03' AND '2024-01-20'"


@query("f4_apply_conditions", f"SELECT event_id, file_number, machine_no FROM ({KEYS}) WHERE {_WHERE}")
def f4(spark, d):
    return O.apply_conditions(X.meta(spark, d), SPEC).select("event_id", "file_number", "machine_no")


@query("f5_split_conditions", f"SELECT 'train' AS part, event_id FROM ({KEYS}) WHERE {_WHERE} UNION ALL SELECT 'mixture', event_id FROM ({KEYS}) WHERE machine_no = 2")
def f5(spark, d):
    train, mixture = O.split_conditions(X.meta(spark, d), SPEC, {"machine_no": {"include": [2]}})
    return train.select(F.lit("train").alias("part"), "event_id").union(mixture.select(F.lit("mixture"), "event_id"))


@query("f6_filter_report", f"SELECT count(*) AS before, count(*) FILTER ({_WHERE}) AS after, count(*) - count(*) FILTER ({_WHERE}) AS excluded FROM ({KEYS})")
def f6(spark, d):
    m = X.meta(spark, d)
    return O.filter_report(m, O.apply_conditions(m, SPEC))


_BOUNDS = f"SELECT target, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM ({X.LAP}) GROUP BY target"
_FLAGGED = f"""
SELECT l.*, CASE WHEN q3 - q1 < 1e-6 THEN -10 ELSE q1 - 0.5 * (q3 - q1) END AS lower, CASE WHEN q3 - q1 < 1e-6 THEN 10 ELSE q3 + 0.5 * (q3 - q1) END AS upper
FROM ({X.LAP}) l JOIN ({_BOUNDS}) b ON l.target = b.target
"""


@query("f7_split_outliers", f"SELECT target, ms_idx, round(value, 6) AS value, round(lower, 6) AS lower, round(upper, 6) AS upper, value < lower OR value > upper AS outlier FROM ({_FLAGGED})")
def f7(spark, d):
    out = O.split_outliers(X.lap(spark, d), "value", ["target"], 0.5)
    return out.select("target", "ms_idx", r6("value").alias("value"), r6("lower").alias("lower"), r6("upper").alias("upper"), "outlier")


@query("f8_outlier_report", f"""
SELECT target, count(*) AS n, count(*) FILTER (value < lower OR value > upper) AS n_outliers, round(100.0 * count(*) FILTER (value < lower OR value > upper) / count(*), 6) AS ratio_percent,
  round(min(value) FILTER (value < lower OR value > upper), 6) AS least, round(max(value) FILTER (value < lower OR value > upper), 6) AS most, round(min(lower), 6) AS lower, round(min(upper), 6) AS upper
FROM ({_FLAGGED}) GROUP BY target
""")
def f8(spark, d):
    out = O.outlier_report(O.split_outliers(X.lap(spark, d), "value", ["target"], 0.5), "value", ["target"])
    return out.select("target", "n", "n_outliers", *[r6(c).alias(c) for c in ("ratio_percent", "least", "most", "lower", "upper")])


@query("f9_high_confidence", f"SELECT id, pred::INTEGER AS pred FROM ({PREDICTED}) WHERE pmax >= 0.8")
def f9(spark, d):
    return O.high_confidence(C.argmax_prob(X.predictions(spark, d))).select("id", "pred")


@query("f10_misclassified", f"SELECT id, label, pred::INTEGER AS pred FROM ({PREDICTED}) WHERE label <> ['click', 'error', 'purchase', 'signup', 'view'][pred + 1] ORDER BY id LIMIT 50")
def f10(spark, d):
    p = C.argmax_prob(X.predictions(spark, d)).withColumn("y_pred", F.get(F.array(*[F.lit(c) for c in X.CLASSES]), F.col("pred")))
    return O.misclassified(p, 50, "label", "y_pred").select("id", "label", "pred")
