"""Extensions on the star schema and the event table (no counterpart in the reference)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewell.queries.registry import query
from lorewell.sources.readers import table


@query("ext_tumbling_counts", "select date_trunc('hour', ts) as hour, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "ext_session_activity",
    """with g as (select user_id, ts, event_id, coalesce(ts - lag(ts) over w > interval 30 minutes, true)::int as s from events window w as (partition by user_id order by ts, event_id)),
n as (select user_id, ts, sum(s) over (partition by user_id order by ts, event_id) as session from g)
select user_id, session::bigint as session, count(*) as n, min(ts) as first_ts, max(ts) as last_ts from n group by all""",
)
def sessions(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select("user_id", "ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w) > F.expr("interval 30 minutes")
    n = e.withColumn("s", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("session", F.sum("s").over(w))
    return n.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("ext_asof_event", "select e.event_id, (select max(p.ts) from events p where p.user_id = e.user_id and p.event_type = 'purchase' and p.ts <= e.ts) as last_purchase from events e where e.event_type <> 'purchase'")
def asof(spark: SparkSession, sf: str) -> DataFrame:
    """As-of join without a join: the last purchase carried forward in each user's order."""
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    bought = F.when(F.col("event_type") == "purchase", F.col("ts"))
    return table(spark, sf, "events").withColumn("last_purchase", F.max(bought).over(w)).where("event_type <> 'purchase'").select("event_id", "last_purchase")


_STAR = "lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"


def _star(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,6)").alias("rev"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    place = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    who = c.join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(who, F.col("o_custkey") == F.col("c_custkey"))


@query("ext_star_join_revenue", f"select n_name, c_mktsegment, round(sum((l_extendedprice * (1 - l_discount))::decimal(18, 6))::double, 2) as revenue from {_STAR} group by all")
def revenue(spark: SparkSession, sf: str) -> DataFrame:
    return _star(spark, sf).groupBy("n_name", "c_mktsegment").agg(F.round(F.sum("rev").cast("double"), 2).alias("revenue"))


@query("ext_rollup_region", f"select r_name, n_name, round(sum((l_extendedprice * (1 - l_discount))::decimal(18, 6))::double, 2) as revenue from {_STAR} group by rollup (r_name, n_name)")
def rollup(spark: SparkSession, sf: str) -> DataFrame:
    return _star(spark, sf).rollup("r_name", "n_name").agg(F.round(F.sum("rev").cast("double"), 2).alias("revenue"))


@query("ext_pricing_summary", "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= date '1998-09-02' group by all")
def pricing(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("date"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))
