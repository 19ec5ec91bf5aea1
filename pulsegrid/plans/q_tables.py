"""Queries of joins, sets, windows and incremental merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import columns as C
from pulsegrid.operators import joins as J
from pulsegrid.operators import windows as W
from pulsegrid.operators.features import extract_features
from pulsegrid.sources import tables as S
from pulsegrid.streaming import merge as I

from . import fixtures as X
from .fixtures import SERIES, TRACE, r6
from .register import query


def t(spark, d, name):
    return X.table(spark, d, name)


@query("j1_join_features", f"WITH s AS ({SERIES}) SELECT c_custkey, c_mktsegment, f.n, round(f.total, 4) AS total FROM customer JOIN (SELECT id, count(*) AS n, sum(value) AS total FROM s GROUP BY id) f ON c_custkey::VARCHAR = f.id")
def j1(spark, d):
    meta = t(spark, d, "customer").select("c_custkey", "c_mktsegment", F.col("c_custkey").cast("string").alias("global_id"))
    feats = X.series(spark, d).groupBy(F.col("id").alias("global_id")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return J.join_features(meta, feats).drop("global_id")


@query("j2_attach_embeddings", "SELECT o_orderkey, o_orderstatus, label FROM orders JOIN embeddings ON o_orderkey = vec_id")
def j2(spark, d):
    return J.join_features(t(spark, d, "orders").select(F.col("o_orderkey"), "o_orderstatus", F.col("o_orderkey").alias("event_id")), t(spark, d, "embeddings").select(F.col("vec_id").alias("event_id"), "label"), "event_id").drop("event_id")


@query("j3_series_of", f"SELECT id, time, value FROM ({SERIES}) WHERE id IN (SELECT c_custkey::VARCHAR FROM customer WHERE c_acctbal > 0)")
def j3(spark, d):
    return J.series_of(X.series(spark, d), t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("id")))


@query("j4_unseen", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem WHERE l_orderkey % 2 = 0) n
WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM lineitem s WHERE s.l_orderkey % 3 <> 0 AND s.l_orderkey = n.l_orderkey AND s.l_linenumber = n.l_linenumber)
""")
def j4(spark, d):
    li = t(spark, d, "lineitem")
    out = J.unseen(li.where("l_orderkey % 2 = 0"), li.where("l_orderkey % 3 <> 0"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("j5_unseen_series", f"SELECT id, time, value FROM ({SERIES}) WHERE id NOT IN (SELECT user_id::VARCHAR FROM events WHERE user_id % 3 <> 0)")
def j5(spark, d):
    s = X.series(spark, d)
    return J.unseen_series(s, s.where("cast(id as int) % 3 <> 0"))


@query("j6_remap_ids", f"SELECT s.id::INTEGER + 1000 AS id, time, value FROM ({SERIES}) s WHERE s.id::INTEGER % 2 = 0")
def j6(spark, d):
    s = X.series(spark, d)
    ids = s.select("id").distinct().where("cast(id as int) % 2 = 0").select(F.col("id").alias("old"), (F.col("id").cast("int") + 1000).alias("new"))
    return J.remap_ids(s, ids)


@query("j7_importance_with_stats", "SELECT p_partkey AS feature, p_retailprice AS importance, s.n FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1) s ON p_partkey = l_partkey")
def j7(spark, d):
    stats = t(spark, d, "lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("feature")).agg(F.count("*").alias("n"))
    return J.importance_with_stats(t(spark, d, "part").select(F.col("p_partkey").alias("feature"), F.col("p_retailprice").alias("importance")), stats)


_COUNTS = "SELECT source AS name, min(doc_id) AS position, count(*) AS count FROM documents GROUP BY 1"


@query("j8_match_counts", f"""
SELECT f.stem, coalesce(m.c, 0)::BIGINT AS count FROM (SELECT DISTINCT source || '_' || lang AS stem FROM documents) f LEFT JOIN (
  SELECT stem, arg_min(count, position) AS c FROM (SELECT DISTINCT source || '_' || lang AS stem FROM documents), ({_COUNTS}) WHERE contains(stem, name) GROUP BY stem) m ON f.stem = m.stem
""")
def j8(spark, d):
    docs = t(spark, d, "documents")
    counts = docs.groupBy(F.col("source").alias("name")).agg(F.min("doc_id").alias("position"), F.count("*").alias("count"))
    return J.match_counts(docs.select(F.concat_ws("_", "source", "lang").alias("stem")).distinct(), counts)


_INV = """
WITH t AS (SELECT n_nationkey AS k, n_regionkey AS r, (n_nationkey % 3)::BIGINT AS n_t FROM nation WHERE n_nationkey % 4 <> 0),
a AS (SELECT n_nationkey AS k, n_regionkey AS r, (n_nationkey % 2)::BIGINT AS n_anal FROM nation WHERE n_nationkey % 5 <> 0),
i AS (SELECT n.n_nationkey AS k, n.n_regionkey AS r, n_t, n_anal, CASE WHEN n_t IS NULL THEN 'NO_T_FOLDER' WHEN n_t = 0 THEN 'T_EMPTY' WHEN n_anal IS NULL THEN 'NO_ANAL_FOLDER' WHEN n_anal = 0 THEN 'ANAL_NOT_DONE' ELSE 'OK' END AS status
  FROM nation n LEFT JOIN t ON n.n_nationkey = t.k LEFT JOIN a ON n.n_nationkey = a.k)
"""


def _inventory(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"))
    a = n.where("k % 4 <> 0").select("k", "r", (F.col("k") % 3).cast("long").alias("n_t"))
    b = n.where("k % 5 <> 0").select("k", "r", (F.col("k") % 2).cast("long").alias("n_anal"))
    out = J.inventory_join(a, b, n, ["k", "r"])
    return out.withColumn("status", C.status_of(F.col("n_t"), F.col("n_anal")))


@query("j12_inventory_join", _INV + "SELECT k, r, n_t, n_anal, status FROM i")
def j12(spark, d):
    return _inventory(spark, d)


@query("w8_sort_by_status", _INV + "SELECT k, status FROM i")
def w8(spark, d):
    return W.sort_by_status(_inventory(spark, d), ["k"]).select("k", "status")


@query("j13_transfer_plan", "SELECT url AS path FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def j13(spark, d):
    p = t(spark, d, "pages").select("page_id", F.col("url").alias("path"))
    return J.transfer_plan(p.select("path"), p.where("page_id % 3 = 0"))


# ---------------------------------------------------------------- windows


@query("w1_avg_rank", "SELECT l_orderkey, l_linenumber, l_quantity, l_partkey, rank() OVER (ORDER BY l_quantity DESC) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS rank FROM lineitem")
def w1(spark, d):
    return W.avg_rank(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey"), "l_quantity")


@query("w2_rank_diff", """
SELECT p_partkey, rank() OVER (ORDER BY p_retailprice DESC) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0::DOUBLE - (rank() OVER (ORDER BY p_size DESC) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0::DOUBLE) AS rank_diff FROM part
""")
def w2(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_retailprice", "p_size")
    return W.rank_diff(W.avg_rank(W.avg_rank(p, "p_retailprice", out="a"), "p_size", out="b"), "a", "b").select("p_partkey", "rank_diff")


@query("w3_first_per_key", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) WHERE k = 1")
def w3(spark, d):
    return W.first_per_key(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("w4_running_id", f"SELECT file, idx, round(y, 6) AS y FROM ({TRACE})")
def w4(spark, d):
    return X.trace(spark, d).select("file", "idx", r6("y").alias("y"))


@query("w5_islands", f"SELECT id, time, sum(new) OVER (PARTITION BY id ORDER BY time)::BIGINT AS run FROM (SELECT *, CASE WHEN lag(value > 50) OVER (PARTITION BY id ORDER BY time) IS NOT DISTINCT FROM (value > 50) THEN 0 ELSE 1 END AS new FROM ({SERIES}))")
def w5(spark, d):
    s = X.series(spark, d).withColumn("high", F.col("value") > 50)
    return W.islands(s, "high", ["id"], "time").select("id", "time", "run")


@query("w6_moving_sum", f"SELECT id, time, round(sum(value) OVER (PARTITION BY id ORDER BY time ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 4) AS s FROM ({SERIES})")
def w6(spark, d):
    return W.moving_sum(X.series(spark, d), "value", 7, ["id"], "time", "s").select("id", "time", F.round("s", 4).alias("s"))


@query("w7_sort_by_count", "SELECT l_partkey AS path, count(*) AS count FROM lineitem GROUP BY 1")
def w7(spark, d):
    return W.sort_by_count(t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("path")).agg(F.count("*").alias("count")))


@query("w9_top_n", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def w9(spark, d):
    return W.top_n(t(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 20, "p_partkey")


_TOP = "SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part"


@query("w10_top_n_per_class", f"SELECT p_brand, p_partkey, place::INTEGER AS place FROM ({_TOP}) WHERE place <= 10")
def w10(spark, d):
    return W.top_n_per_class(t(spark, d, "part"), "p_brand", "p_retailprice", 10, "p_partkey").select("p_brand", "p_partkey", "place")


@query("w11_sort_by_abs", "SELECT c_custkey, c_acctbal FROM customer")
def w11(spark, d):
    return W.sort_by_abs(t(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey")


@query("w12_head_n", "SELECT event_id, user_id FROM events ORDER BY ts, event_id LIMIT 100")
def w12(spark, d):
    return W.head_n(t(spark, d, "events"), ["ts", "event_id"], 100).select("event_id", "user_id")


# ---------------------------------------------------------------- sets


@query("u1_union_samples", "SELECT event_type, event_id FROM events WHERE event_type IN ('click', 'view', 'error')")
def u1(spark, d):
    e = t(spark, d, "events").select("event_type", "event_id")
    return J.union_samples([e.where(F.col("event_type") == k) for k in ("click", "view", "error")])


@query("u3_append_new", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 3 = 0")
def u3(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey")
    return J.append_new(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 3 = 0").select("o_orderkey"))


@query("u5_common_top", "SELECT p_size FROM (SELECT DISTINCT p_brand, p_size FROM part WHERE p_retailprice > 0) GROUP BY p_size HAVING count(*) = (SELECT count(DISTINCT p_brand) FROM part WHERE p_retailprice > 0)")
def u5(spark, d):
    return J.common_top(t(spark, d, "part").where("p_retailprice > 0").select("p_brand", "p_size"), "p_brand", "p_size")


@query("u6_missing_names", "SELECT c_custkey AS name FROM customer EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderkey % 20 = 0")
def u6(spark, d):
    return J.missing_names(t(spark, d, "customer").select(F.col("c_custkey").alias("name")), t(spark, d, "orders").where("o_orderkey % 20 = 0").select("o_custkey"))


# ---------------------------------------------------------------- incremental


_MERGE = """
WITH stored AS (SELECT o_orderkey AS event_id, o_custkey::VARCHAR AS file, (o_orderkey % 50)::INTEGER AS peak_pos FROM orders WHERE o_orderkey % 3 <> 0),
new AS (SELECT o_orderkey AS event_id, o_custkey::VARCHAR AS file, (o_orderkey % 50)::INTEGER AS peak_pos FROM orders WHERE o_orderkey % 2 = 0),
fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, peak_pos ORDER BY event_id) AS k FROM new) n WHERE k = 1
  AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.file = n.file AND s.peak_pos = n.peak_pos))
"""


def _stored_new(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").cast("string").alias("file"), (F.col("o_orderkey") % 50).cast("int").alias("peak_pos"))
    return o.where("event_id % 3 <> 0"), o.where("event_id % 2 = 0")


@query("i1_merge_new_events", _MERGE + "SELECT event_id, file, peak_pos FROM stored UNION ALL SELECT event_id + (SELECT max(event_id) + 1 FROM stored), file, peak_pos FROM fresh")
def i1(spark, d):
    return I.merge_new_events(*_stored_new(spark, d)).events


@query("i1_merge_counts", _MERGE + "SELECT (SELECT count(*) FROM fresh) AS n_added, (SELECT count(*) FROM new) - (SELECT count(*) FROM fresh) AS n_skipped")
def i1_counts(spark, d):
    return I.merge_new_events(*_stored_new(spark, d)).counts


@query("i1_merge_series", _MERGE + "SELECT (f.event_id + (SELECT max(event_id) + 1 FROM stored))::VARCHAR AS id, l_linenumber AS time, l_quantity AS value FROM fresh f JOIN lineitem ON f.event_id = l_orderkey")
def i1_series(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"), F.col("l_linenumber").alias("time"), F.col("l_quantity").alias("value"))
    return I.merge_new_events(*_stored_new(spark, d), rows).series


@query("a25_distinct_events", "SELECT count(DISTINCT l_orderkey) AS n FROM lineitem")
def a25(spark, d):
    from pulsegrid.operators.aggregates import distinct_events

    return distinct_events(t(spark, d, "lineitem"), "l_orderkey")


@query("a26_next_id", "SELECT max(event_id) + 1 AS next_id FROM events")
def a26(spark, d):
    from pulsegrid.operators.aggregates import next_id

    return next_id(t(spark, d, "events"))


_KEYS = "SELECT DISTINCT o_custkey::VARCHAR AS file, (o_orderkey % 50)::INTEGER AS peak_pos FROM orders"
_STREAM = "event_id long, file string, peak_pos int"


def _ingested(spark, d, rounds):
    """The table after the batches of ``rounds`` have arrived as files, one run of the stream after each."""
    source, target, checkpoint = (X.scratch(spark, n) for n in ("source", "target", "stream"))
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").cast("string").alias("file"), (F.col("o_orderkey") % 50).cast("int").alias("peak_pos"))
    for condition in rounds:
        if condition:
            S.append_events(o.where(condition), source)
        I.ingest_stream(spark, source, _STREAM, target, checkpoint).awaitTermination()
    return spark.read.parquet(target)


@query("i2_ingest_stream", _KEYS)
def i2(spark, d):
    return _ingested(spark, d, ["event_id % 2 = 0", "event_id % 2 = 1"]).select("file", "peak_pos")


@query("i3_stream_deduplication", f"SELECT file, count(*) AS n FROM ({_KEYS}) GROUP BY 1")
def i3(spark, d):
    """All rows arrive twice; keys of the first time are dropped by the stream's state."""
    return _ingested(spark, d, ["true", "true"]).groupBy("file").agg(F.count("*").alias("n"))


@query("i5_repeated_run", f"SELECT count(*) AS n, count(DISTINCT (file, peak_pos)) AS n_keys FROM ({_KEYS})")
def i5(spark, d):
    """A run without new files adds nothing."""
    return _ingested(spark, d, ["true", None, None]).agg(F.count("*").alias("n"), F.count_distinct("file", "peak_pos").alias("n_keys"))


_PRESET = {"sum_values": [{}], "length": [{}]}


def _store(spark, d, samples):
    """A feature store that holds the features of some samples (event types), and what was read of them."""
    store = I.FeatureStore(spark, X.scratch(spark, "features"))
    e = t(spark, d, "events").select(F.concat_ws(":", "event_type", "user_id").alias("id"), "event_type", F.col("event_id").alias("time"), "value")
    read = [store.get(s, "fp", _PRESET, lambda s=s: extract_features(e.where(F.col("event_type") == s), _PRESET)).withColumn("sample", F.lit(s)) for s in samples]
    return store, read


@query("i4_completed_samples", "SELECT DISTINCT event_type AS sample FROM events WHERE event_type NOT IN ('click', 'view')")
def i4(spark, d):
    store, _ = _store(spark, d, ["click", "view"])
    keys = t(spark, d, "events").select(F.col("event_type").alias("sample")).distinct()
    return store.missing(keys.withColumns({"fingerprint": F.lit("fp"), "preset": F.lit(I.preset_hash(_PRESET))})).select("sample")


@query("i6_feature_store", "SELECT event_type AS sample, event_type || ':' || user_id AS id, round(sum(value) + 3.3e-8, 6) AS total, count(*) AS n FROM events WHERE event_type IN ('click', 'error') GROUP BY 1, 2")
def i6(spark, d):
    _, read = _store(spark, d, ["click", "error", "click"])
    out = J.union_samples(read[1:])
    return out.select("sample", "id", F.round(F.col("value__sum_values") + 3.3e-8, 6).alias("total"), F.col("value__length").alias("n"))


# ---------------------------------------------------------------- writing


@query("s10_append_events", "SELECT o_orderkey, o_custkey FROM orders")
def s10(spark, d):
    path, o = X.scratch(spark, "events"), t(spark, d, "orders").select("o_orderkey", "o_custkey")
    for k in range(2):
        S.append_events(o.where(f"o_orderkey % 2 = {k}"), path)
    return spark.read.parquet(path)


@query("s11_write_result", "SELECT p_partkey::BIGINT AS p_partkey, p_brand, p_size::INTEGER AS p_size FROM part")
def s11(spark, d):
    path, p = X.scratch(spark, "result"), t(spark, d, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_brand", F.col("p_size").cast("int").alias("p_size"))
    S.write_result(p, path + ".csv", "csv")
    return S.read_table(spark, path, "p_partkey long, p_brand string, p_size int")


@query("s12_write_snapshot", """
SELECT 'latest' AS part, o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 2
UNION ALL SELECT 'history', o_orderstatus, count(*) FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 3 = 0) GROUP BY 2
""")
def s12(spark, d):
    path, o = X.scratch(spark, "snapshot"), t(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    S.write_snapshot(o, path, "t1", "status")
    S.write_snapshot(o.where("o_orderkey % 3 = 0"), path, "t2", "status")
    count = lambda name: spark.read.parquet(f"{path}/{name}").groupBy(F.lit(name).alias("part"), F.col("status").cast("string").alias("status")).agg(F.count("*").alias("n"))
    return count("latest").unionByName(count("history"))


@query("n5_schema_guard", "SELECT l_returnflag AS sample, count(*) AS n, true AS guarded FROM lineitem GROUP BY 1")
def n5(spark, d):
    """Samples of the same feature columns pass together; one with another column is refused."""
    li = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("sample"), F.col("l_quantity").alias("value__q"), F.col("l_tax").alias("value__t"))
    samples = {r.sample: li.where(F.col("sample") == r.sample) for r in li.select("sample").distinct().collect()}
    J.schema_guard(samples)
    try:
        J.schema_guard(samples | {"other": li.drop("value__t")})
        guarded = False
    except ValueError:
        guarded = True
    return J.union_samples(list(samples.values())).groupBy("sample").agg(F.count("*").alias("n")).withColumn("guarded", F.lit(guarded))
