"""Event logs: rates, streaks, metrics, recent values; and their streaming forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.functions import text
from lorewell.operators import analytics, logs
from lorewell.plans.tables import shared_dir
from lorewell.queries.registry import query
from lorewell.sources import sinks
from lorewell.sources.readers import table
from lorewell.streaming import streams


def _ev(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


@query("rate_limit_60s", "select event_id, count(*) over (partition by user_id order by ts range between interval 60 seconds preceding and current row) as n_recent from events")
def rate(spark: SparkSession, sf: str) -> DataFrame:
    return logs.rate_window(_ev(spark, sf), "user_id", "ts").select("event_id", "n_recent")


@query(
    "failure_streaks",
    """with s as (select event_id, user_id, ts, (event_type = 'error')::int as f, sum((event_type <> 'error')::int) over (partition by user_id order by ts, event_id) as g from events)
select event_id, sum(f) over (partition by user_id, g order by ts, event_id)::bigint as streak from s""",
)
def streaks(spark: SparkSession, sf: str) -> DataFrame:
    return logs.failure_streaks(_ev(spark, sf), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "streak")


@query("latency_metrics", "select event_type, count(*) as n, round(avg(value), 6) as mean, round(median(value), 6) as median, round(max(value), 6) as longest from events group by event_type")
def latency(spark: SparkSession, sf: str) -> DataFrame:
    return _ev(spark, sf).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("median"), F.round(F.max("value"), 6).alias("longest"))


@query("type_distribution", "select event_type, count(*) as n, round(count(*) * 100.0::double / sum(count(*)) over (), 6) as pct from events group by event_type")
def distribution(spark: SparkSession, sf: str) -> DataFrame:
    c = analytics.counts(_ev(spark, sf), "event_type")
    return c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("t")))).select("event_type", "n", F.round(F.col("n") * 100.0 / F.col("t"), 6).alias("pct"))  # one row


@query("top_categories", "select event_type as value, count(*) as n from events group by 1 order by n desc, value limit 3")
def categories(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.top_n(_ev(spark, sf), F.col("event_type"), 3)


@query("recent_distinct", "select user_id, event_type, last_used, rn::int as rn from (select *, row_number() over (partition by user_id order by last_used desc, event_type) as rn from (select user_id, event_type, max(ts) as last_used from events group by all)) where rn <= 3")
def recent(spark: SparkSession, sf: str) -> DataFrame:
    return logs.recent_distinct(_ev(spark, sf), "user_id", "event_type", "ts", 3)


@query("page_window", "select event_id, rn::int as rn from (select event_id, row_number() over (order by ts desc, event_id) as rn from events) where rn between 101 and 200")
def pages(spark: SparkSession, sf: str) -> DataFrame:
    return logs.page(_ev(spark, sf).select("event_id", "ts"), [F.desc("ts"), F.col("event_id")], 2).select("event_id", "rn")


@query(
    "release_retention",
    """with r as (select strftime(ts, '%Y%m%d') as version, bool_or(event_type = 'purchase' and value > 95) as bad from events group by 1),
k as (select *, row_number() over (partition by bad order by version desc) as rn from r) select version, case when bad then 'failed' else 'good' end as status, rn::int as rn from k where rn > case when bad then 2 else 3 end""",
)
def retention(spark: SparkSession, sf: str) -> DataFrame:
    """Each day a release: those beyond the newest three good and two failed ones."""
    bad = F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 95))
    d = _ev(spark, sf).groupBy(F.date_format("ts", "yyyyMMdd").alias("version")).agg(F.when(bad, "failed").otherwise("good").alias("status"))
    good, failed = d.where("status = 'good'"), d.where("status = 'failed'")
    return logs.stale(good, [F.desc("version")], 3).unionByName(logs.stale(failed, [F.desc("version")], 2)).select("version", "status", "rn")


_LOCAL = "(ts + interval 330 minute)"


@query("schedule_due", f"select event_id, strftime({_LOCAL}, '%H:%M') >= '02:00' and (event_id % 5 = 0 or {_LOCAL}::date > (ts::date - (event_id % 3)::int + 1)) as due from events")
def due(spark: SparkSession, sf: str) -> DataFrame:
    from lorewell.functions.fields import local_due

    last = F.when(F.col("event_id") % 5 != 0, F.date_add(F.to_date("ts"), (1 - F.col("event_id") % 3).cast("int")))
    return _ev(spark, sf).select("event_id", local_due(F.col("ts").cast("timestamp_ntz"), "Asia/Kolkata", "02:00", last).alias("due"))


@query(
    "schedule_next",
    f"select event_id, (case when strftime({_LOCAL}, '%H:%M') < '02:00' then {_LOCAL}::date else {_LOCAL}::date + 1 end + interval 2 hour - interval 330 minute)::timestamp as next_run from events",
)
def next_run(spark: SparkSession, sf: str) -> DataFrame:
    from lorewell.functions.fields import next_local

    return _ev(spark, sf).select("event_id", next_local(F.col("ts").cast("timestamp_ntz"), "Asia/Kolkata", "02:00").alias("next_run"))


@query(
    "feedback_log",
    """select conv_id, turn, case when length(trim(text)) > 500 then substr(trim(text), 1, 500) else trim(text) end as question, case when turn % 2 = 0 then 'up' else 'down' end as vote from conversations where role = 'user' and trim(text) <> ''""",
)
def feedback(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").where("role = 'user'")
    votes = c.select("conv_id", "turn", F.col("text").alias("question"), F.when(F.col("turn") % 2 == 0, "up").otherwise("down").alias("vote"))
    path = f"{shared_dir(spark)}/feedback-{uuid.uuid4().hex}"
    sinks.append_feedback(votes, path)
    return spark.read.schema("conv_id long, turn long, question string, vote string").json(path)


@query(
    "session_quality",
    """with s as (select user_id, round(avg(value), 6) as mean_value, count(*) filter (value >= 35) as grounded, count(*) filter (value < 35) as no_evidence from events group by user_id)
select s.*, coalesce(high, 0) as high, coalesce(medium, 0) as medium, coalesce(low, 0) as low, coalesce(none, 0) as none from s left join (select user_id, count(*) filter (value >= 62) as high, count(*) filter (value >= 48 and value < 62) as medium,
count(*) filter (value >= 35 and value < 48) as low, count(*) filter (value < 35) as none from events group by user_id) using (user_id)""",
)
def session_quality(spark: SparkSession, sf: str) -> DataFrame:
    e = _ev(spark, sf).withColumn("score", F.col("value") / 100)
    return analytics.session_quality(e, "user_id", "value", "score")


# ------------------------------------------------------------- streams: the final state equals the batch result
@query("stream_dedup", "select substr(sha256(text), 1, 24) as content_hash from documents group by 1")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    d = streams.read(spark, sf, "documents").select(text.content_hash("text").alias("content_hash"))
    return streams.dedup(d, "content_hash")


@query(
    "stream_change_detect",
    """select doc_id::varchar as doc_id, 'new' as change from documents union all select doc_id::varchar, 'modified' from documents where lang = 'fr' and text is not null""",
)
def stream_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches: all but the Spanish documents, then all of them, the French ones with another text."""
    d = table(spark, sf, "documents")
    path = f"{shared_dir(spark)}/versions-{uuid.uuid4().hex}"
    first = d.where("lang <> 'es'").select(F.col("doc_id").cast("string").alias("doc_id"), text.content_hash("text").alias("content_hash"))
    first.write.mode("append").parquet(path)
    detector = streams.detect_changes(spark.readStream.schema(first.schema).parquet(path), "doc_id", "content_hash", "versions")
    now = F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    d.select(F.col("doc_id").cast("string").alias("doc_id"), text.content_hash(now).alias("content_hash")).write.mode("append").parquet(path)
    detector.run(spark.readStream.schema(first.schema).parquet(path), "versions")
    return detector.log().select("doc_id", "change")


@query("stream_rate_limit", "select user_id, sum(n)::bigint as requests, sum(greatest(n - 1, 0))::bigint as refused from (select user_id, floor(epoch(ts) / 60) as slot, count(*) as n from events group by all) group by user_id")
def stream_rate(spark: SparkSession, sf: str) -> DataFrame:
    return streams.limited(streams.read(spark, sf, "events"), "user_id", "ts", 1)


@query(
    "stream_sliding_limit",
    """with recursive e as (select event_id, user_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as k from events),
a(user_id, k, event_id, allowed, held) as (select user_id, k, event_id, true, [t] from e where k = 1
 union all select e.user_id, e.k, e.event_id, len(list_filter(held, lambda x: x > t - 3600000000)) < 2, case when len(list_filter(held, lambda x: x > t - 3600000000)) < 2 then list_append(list_filter(held, lambda x: x > t - 3600000000), t) else list_filter(held, lambda x: x > t - 3600000000) end
 from a join e on e.user_id = a.user_id and e.k = a.k + 1)
select event_id, user_id, allowed from a""",
)
def stream_sliding(spark: SparkSession, sf: str) -> DataFrame:
    """Two requests an hour for each user, in a window that slides."""
    return streams.sliding_limit(streams.read(spark, sf, "events"), "user_id", "event_id", "ts", 2, 3600)


@query("stream_windowed_counts", "select date_trunc('hour', ts) as window_start, event_type, count(*) as n from events group by all")
def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    return streams.windowed_counts(streams.read(spark, sf, "events"), "ts", "event_type")
