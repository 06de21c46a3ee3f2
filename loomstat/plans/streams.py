"""Queries over ordered and streaming rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.campaign import Campaign
from ..registry import query, table
from ..streaming.lags import lag_stream
from ..streaming.soft_sensor import estimate
from ..streaming.versions import VersionedTable
from ..tables import shared_dir


@query()
def x1_soft_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.hour("ts").cast("double").alias("hour"), F.from_json("props", "k int")["k"].cast("double").alias("k"), "value").na.fill(0.0, ["k"])
    return estimate(df, "user_id", ["ts", "event_id"], "event_id", ["hour", "k"], "value")


@query("SELECT user_id, session, count(*) AS n FROM (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT user_id, ts, event_id, (coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR, true))::INT AS fresh FROM events)) GROUP BY ALL")
def x4_session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    s = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("w.start")).alias("session"), "n")


_LAST = "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, round(arg_max(value, (ts, event_id)), 6) AS value FROM events GROUP BY user_id"


@query(_LAST)
def x3_streamed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, upserted batch by batch from a stream into a versioned table, and replayed by a stream that has forgotten its place."""
    events = table(spark, sf_dir, "events").schema
    folder = f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"
    state = VersionedTable(spark, f"{folder}/table")
    for run in range(2):
        stream = spark.readStream.schema(events).parquet(f"{sf_dir}/events.parquet*").select("user_id", "event_id", "ts", "event_type", "value")
        state.upsert_stream(stream, "events", ["user_id"], ["ts", "event_id"], f"{folder}/place-{run}").awaitTermination()
    return state.read().select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


@query()
def x3_b11_campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of a campaign over customers, whose balances are the results: each step reads its state anew."""
    c = table(spark, sf_dir, "customer")
    pool = c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("double").alias("nation"), (F.col("c_custkey") % 7).cast("double").alias("rest"))
    truth = c.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") + 2000 * (F.col("c_custkey") % 7)).alias("y"))
    folder = f"{shared_dir(spark)}/campaign-{uuid.uuid4().hex}"
    campaign = lambda: Campaign(spark, folder, pool, ["nation", "rest"])
    campaign().start(truth.orderBy(F.xxhash64("id")).limit(12), seed=1, folds=2)
    for turn in range(2):
        made = campaign().propose(2)
        campaign().apply(made.join(truth, "id").select("round", "id", "y"), ("results", turn))
    return campaign().table.read()


@query("""WITH l AS (SELECT event_id, ts, user_id, value, lag(value, 2) OVER w AS value_lag2, lag(value, 4) OVER w AS value_lag4, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, value, value_lag2, value_lag4 FROM l WHERE n > 4 AND epoch_us(ts) < (SELECT epoch_us(max(ts)) // 1000 * 1000 FROM events) - 3600000000""")
def x2_streamed_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lag features as a stream gives them out: all rows that the watermark, an hour behind the last event, has passed."""
    folder = f"{shared_dir(spark)}/lags-{uuid.uuid4().hex}"
    name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, store)
    try:
        stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
        out = lag_stream(stream, "user_id", ["ts", "event_id"], ["value"], 2, 4, "1 hour").drop("ts")
        out.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/place").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    return spark.read.schema("event_id long, user_id long, value double, value_lag2 double, value_lag4 double").parquet(f"{folder}/rows")
