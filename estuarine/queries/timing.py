"""Rate audit and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from estuarine.operators.rates import rate_audit
from estuarine.queries import query
from estuarine.queries.diversity import rounded
from estuarine.queries.sources import scratch
from estuarine.streaming import trends as T
from estuarine.streaming.rates import rate_audit_stream

DAY = 86_400
EV = """e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"""
FIXED = f"""{EV}, s(user_id, i, event_id, t, a, c, ok) AS (SELECT user_id, i, event_id, t, t, 1::BIGINT, true FROM e WHERE i=1 UNION ALL
      SELECT e.user_id, e.i, e.event_id, e.t, CASE WHEN e.t>=a+86400000000 THEN e.t ELSE a END,
        CASE WHEN e.t>=a+86400000000 THEN 1 WHEN c<2 THEN c+1 ELSE c END, e.t>=a+86400000000 OR c<2
      FROM s JOIN e ON e.user_id=s.user_id AND e.i=s.i+1)
    SELECT user_id, event_id, ok AS allowed, round(CASE WHEN ok THEN 0 ELSE (a+86400000000-t)/1e6 END,6)::DOUBLE AS retry_after FROM s"""
SLIDING = f"""{EV}, s(user_id, i, event_id, t, l, ok, f) AS (SELECT user_id, i, event_id, t, [t], true, 0::BIGINT FROM e WHERE i=1 UNION ALL
      SELECT user_id, i, event_id, t, CASE WHEN len(k)<2 THEN list_append(k, t) ELSE k END, len(k)<2, coalesce(k[1],0) FROM (
        SELECT e.user_id, e.i, e.event_id, e.t, list_filter(l, lambda x: x>e.t-86400000000) AS k FROM s JOIN e ON e.user_id=s.user_id AND e.i=s.i+1))
    SELECT user_id, event_id, ok AS allowed, round(CASE WHEN ok THEN 0 ELSE (f+86400000000-t)/1e6 END,6)::DOUBLE AS retry_after FROM s"""


@query("rate_audit_fixed", f"WITH RECURSIVE {FIXED}")
def _(v):
    return rounded(rate_audit(v.table("events"), "user_id", "ts", "event_id", 2, DAY, "fixed"), "retry_after")


@query("rate_audit_sliding", f"WITH RECURSIVE {SLIDING}")
def _(v):
    return rounded(rate_audit(v.table("events"), "user_id", "ts", "event_id", 2, DAY, "sliding"), "retry_after")


def event_stream(v):
    schema = v.table("events").schema
    stream = T.read_events(v.spark, v.sf_dir, "events.parquet", schema)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("rate_audit_stream", f"WITH RECURSIVE {FIXED}")
def _(v):
    out = rate_audit_stream(event_stream(v), "user_id", "ts", "event_id", 2, DAY, "fixed", "10 minutes")
    path = scratch(v, "rates")
    T.run_once(out, path, f"{path}-checkpoint")
    return rounded(v.spark.read.parquet(path), "retry_after")


@query("rate_audit_sliding_stream", f"WITH RECURSIVE {SLIDING}")
def _(v):
    out = rate_audit_stream(event_stream(v), "user_id", "ts", "event_id", 2, DAY, "sliding", "10 minutes")
    path = scratch(v, "rates")
    T.run_once(out, path, f"{path}-checkpoint")
    return rounded(v.spark.read.parquet(path), "retry_after")


@query(
    "daily_trend_stream",
    """SELECT ts::DATE AS day, count(*) AS n, round(avg(value),6) AS avg_value, round(min(value),6) AS min_value, round(max(value),6) AS max_value FROM events
    GROUP BY 1""",
)
def _(v):
    out = T.daily_trend(event_stream(v), "ts", "value", "user_id")
    path = scratch(v, "daily")
    T.run_updates(out, path, f"{path}-checkpoint")
    return rounded(T.read_updates(v.spark, path, "day").drop("distinct_items"), "avg_value", "min_value", "max_value")


@query(
    "distinct_per_day_stream",
    "SELECT ts::DATE AS day, count(DISTINCT user_id) AS distinct_users FROM events GROUP BY 1",
)
def _(v):
    out = T.distinct_per_day(event_stream(v), "ts", "user_id")
    path = scratch(v, "distinct")
    T.run_once(out, path, f"{path}-checkpoint")
    return v.spark.read.parquet(path).groupBy("day").agg(F.count(F.lit(1)).alias("distinct_users"))


@query(
    "profile_upsert_stream",
    """SELECT user_id AS organism_id, count(*) AS detection_count, strftime(min(ts),'%Y-%m-%d %H:%M:%S') AS first_detected,
      strftime(max(ts),'%Y-%m-%d %H:%M:%S') AS last_updated, arg_max(event_type, ts) AS last_type FROM events GROUP BY 1""",
)
def _(v):
    stream = event_stream(v).select(
        F.col("user_id").alias("organism_id"), F.col("ts").alias("created_at"), F.col("event_type").alias("last_type")
    )
    root = scratch(v, "profiles")
    table = T.ProfileTable(
        v.spark, root, "organism_id long, detection_count long, first_detected timestamp, last_updated timestamp, last_type string"
    )
    T.upsert_stream(stream, table, f"{root}-checkpoint")
    second = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return table.read().select("organism_id", "detection_count", second("first_detected"), second("last_updated"), "last_type")


@query(
    "vector_append_stream",
    "SELECT user_id::VARCHAR AS run_id, count(DISTINCT event_type) AS n FROM events GROUP BY 1",
)
def _(v):
    stream = event_stream(v).select(
        F.lit("events").alias("dataset"), F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("vec_id"), "ts"
    )
    path = scratch(v, "append")
    T.append_vectors(stream, path, f"{path}-checkpoint")
    return v.spark.read.parquet(path).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
