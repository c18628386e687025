"""Findings: band and as-of joins, deltas, sessions, taint over the business graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gritstone.operators import graph
from gritstone.sources.tables import table
from gritstone.streaming.state import watch_delta as delta


def band_join(left: DataFrame, right: DataFrame, key: str, a: str, b: str, reach: int, first: list) -> DataFrame:
    """Left rows with the first right row of the same key whose b is within ``reach`` of a. The band is cut into buckets
    of its width, so it is an equi-join on (key, bucket) with three buckets a row at most; no cross join. Equal left rows are counted before and given back after."""
    width = 2 * reach + 1
    spread = right.withColumn("__bucket", F.explode(F.array_distinct(F.transform(F.array(F.lit(-reach), F.lit(0), F.lit(reach)), lambda o: F.floor((F.col(b) + o) / width)))))
    left = left.groupBy(*left.columns).agg(F.count("*").alias("__n"))
    rows = left.withColumn("__bucket", F.floor(F.col(a) / width)).join(spread, [key, "__bucket"]).filter(F.abs(F.col(b) - F.col(a)) <= reach).drop("__bucket")
    rows = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*[left[c] for c in left.columns]).orderBy(*first))).filter("__rn = 1").drop("__rn")
    return rows.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), "__n"))).drop("__n")


def tool_compare_band(spark: SparkSession, d: str) -> DataFrame:
    """Two tools' findings matched in a file within two lines, least offset first, and what only one of them has."""
    events = table(spark, d, "events").withColumn("at", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 600).cast("long"))
    ours = events.filter("event_type in ('error', 'view')").select("event_id", F.col("user_id").alias("file"), F.col("at").alias("line"))
    theirs = events.filter("event_type in ('click', 'purchase')").select(F.col("event_id").alias("other"), F.col("user_id").alias("file"), "at")
    both = band_join(ours, theirs, "file", "line", "at", 2, [F.col("at") - F.col("line"), F.col("other")]).select("event_id", "other", (F.col("at") - F.col("line")).alias("line_offset"))
    mine = ours.select("event_id").join(both, "event_id", "left").withColumn("side", F.when(F.col("other").isNull(), "ours_only").otherwise("both"))
    rest = theirs.join(both.select("other").distinct(), "other", "left_anti").select(F.lit(None).cast("long").alias("event_id"), "other", F.lit(None).cast("long").alias("line_offset"), F.lit("theirs_only").alias("side"))
    return mine.select("event_id", "other", "line_offset", "side").unionByName(rest)


def asof_previous_event(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with the user's last signup before it: one union, one window, no range join."""
    rows = table(spark, d, "events").filter("event_type in ('signup', 'purchase')")
    signup = F.when(F.col("event_type") == "signup", F.col("event_id"))
    order = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "signup", 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("signup", F.last(signup, ignorenulls=True).over(order)).filter("event_type = 'purchase'").select("event_id", "signup")


def taint_flows(spark: SparkSession, d: str) -> DataFrame:
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    customers, orders = table(spark, d, "customer"), table(spark, d, "orders")
    flows = customers.select(node("n", "c_nationkey").alias("src"), node("c", "c_custkey").alias("dst"), (F.col("c_mktsegment") == "BUILDING").alias("sanitizer"))
    flows = flows.union(orders.select(node("c", "o_custkey"), node("o", "o_orderkey"), F.lit(False)))
    sources = table(spark, d, "nation").filter("n_regionkey = 3").select(node("n", "n_nationkey").alias("node"))
    sinks = orders.filter("o_orderstatus = 'F'").select(node("o", "o_orderkey").alias("node"))
    cleaned = customers.filter("c_acctbal < 0").select(node("c", "c_custkey").alias("node"))
    return graph.taint(flows, sources, sinks, cleaned).groupBy("sanitized").agg(F.count("*").alias("flows"))


def watch_delta(spark: SparkSession, d: str) -> DataFrame:
    """Two states of error events, day by day; a day on which more than 50 users' findings moved is a burst and tells nothing."""
    rows = table(spark, d, "events").filter("event_type = 'error'").select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("line"), F.col("event_type").alias("rule"), F.to_date("ts").alias("day"))
    return delta(rows.filter("line % 3 = 0"), rows.filter("line % 2 = 0"), batch="day").groupBy("day", "change").agg(F.count("*").alias("n"))


def session_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return rows.groupBy("user_id").agg(F.sum("n").alias("events_"), F.count("*").alias("sessions"))
