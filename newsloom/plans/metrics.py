"""Queries over facts: event streams, ledgers, sizes and growth, on the generic tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.relational import first_per_key, rolling, streaks
from ..session import table
from .registry import query


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def seconds(c: str) -> Column:
    return F.unix_seconds(F.col(c).cast("timestamp"))


@query("select ts::date as day, event_type, count(*) as requests, round(sum(value), 4) as total from events group by 1, 2")
def a10_ledger(spark, d):
    return events(spark, d).groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("requests"), F.round(F.sum("value"), 4).alias("total"))


@query("select event_type, count(*) as n, count(distinct user_id) as n_users from events where ts >= (select max(ts) from events) - interval 7 day group by 1")
def a12_recent_metrics(spark, d):
    e = events(spark, d)
    newest = e.agg(F.max("ts").alias("newest"))  # one row
    return e.join(F.broadcast(newest), F.col("ts") >= F.col("newest") - F.expr("interval 7 days")).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"))


@query("select user_id, round(60.0 * (ok + 3) / (n + 3) + 25.0 * (ok + 2) / (n + 2) + 10 * (1 - bad::double / greatest(1, n)), 2) as score from (select user_id, count(*) as n, count(*) filter (where event_type = 'purchase') as ok, count(*) filter (where event_type = 'error') as bad from events group by 1)")
def a13_smoothed_score(spark, d):
    g = events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("ok"), F.count_if(F.col("event_type") == "error").alias("bad"))
    score = F.lit(60.0) * (F.col("ok") + 3) / (F.col("n") + 3) + F.lit(25.0) * (F.col("ok") + 2) / (F.col("n") + 2) + F.lit(10) * (1 - F.col("bad") / F.greatest(F.lit(1), "n"))
    return g.select("user_id", F.round(score, 2).alias("score"))


@query("with x as (select o_orderdate::date as day, sum(o_totalprice) as v from orders group by 1), m as (select max(day) as d1, max_by(v, day) as v1 from x), o as (select min(x.day) as d0, min_by(x.v, x.day) as v0 from x, m where x.day <= m.d1 - 7) select d0, d1, round((v1 - v0) / (d1 - d0), 2) as per_day from m, o")
def a18_growth(spark, d):
    x = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("v"))
    m = x.agg(F.max("day").alias("d1"), F.max_by("v", "day").alias("v1"))  # one row
    o = x.join(F.broadcast(m), F.col("day") <= F.date_sub("d1", 7)).groupBy("d1", "v1").agg(F.min("day").alias("d0"), F.min_by("v", "day").alias("v0"))
    return o.select("d0", "d1", F.round((F.col("v1") - F.col("v0")) / F.datediff("d1", "d0"), 2).alias("per_day"))


@query("select user_id, count(*) as n_rows, round(sum(value), 4) as total from events group by 1")
def a20_reading_stats(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.count("*").alias("n_rows"), F.round(F.sum("value"), 4).alias("total"))


@query("select event_type, max(ts)::date as newest, max_by(event_id, (ts, event_id)) as event_id from events group by 1")
def a23_latest(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.to_date(F.max("ts")).alias("newest"), F.max(F.struct("ts", "event_id")).alias("x")).select("event_type", "newest", "x.event_id")


@query("select count(*) filter (where value is null) as n_null, count(*) filter (where value < 1) as n_low, count(*) as n from events")
def a24_plan_counts(spark, d):
    return events(spark, d).agg(F.count_if(F.col("value").isNull()).alias("n_null"), F.count_if(F.col("value") < 1).alias("n_low"), F.count("*").alias("n"))


@query("with m as (select max(ts) as now from events) select count(*) filter (where ts >= now - interval 1 hour) as last_hour, count(*) filter (where ts >= now - interval 1 day) as last_day, count(*) filter (where ts >= now - interval 7 day) as last_week from events, m where ts <= now")
def w02_completions(spark, d):
    e = events(spark, d).select("ts")
    df = e.join(F.broadcast(e.agg(F.max("ts").alias("now"))), F.col("ts") <= F.col("now"))
    within = lambda span: F.count_if(F.col("ts") >= F.col("now") - F.expr(f"interval {span}"))
    return df.agg(within("1 hour").alias("last_hour"), within("1 day").alias("last_day"), within("7 days").alias("last_week"))


_SPANS = {"minute": 60, "day": 86_400}


@query("select event_id, count(*) over m as n_minute, round(sum(value) over m, 6) as sum_minute, count(*) over d as n_day, round(sum(value) over d, 6) as sum_day from (select *, epoch_us(ts) as s from events) window m as (partition by user_id order by s range between 59999999 preceding and current row), d as (partition by user_id order by s range between 86399999999 preceding and current row)")
def w03_sliding_budget(spark, d):
    """Requests and tokens of the last minute and day; an event that is exactly as old as the span is out."""
    out = events(spark, d).withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")))
    for name, span in _SPANS.items():
        out = rolling(out, ["user_id"], F.col("s"), span * 1_000_000 - 1, {f"n_{name}": F.count("*"), f"sum_{name}": F.sum("value")})
    return out.select("event_id", "n_minute", F.round("sum_minute", 6).alias("sum_minute"), "n_day", F.round("sum_day", 6).alias("sum_day"))


@query("select event_id, n_minute > 2 as over_minute, n_day > 60 or sum_day > 3000 as over_day from (select event_id, count(*) over m as n_minute, count(*) over d as n_day, sum(value) over d as sum_day from (select *, epoch_us(ts) as s from events) window m as (partition by user_id order by s range between 59999999 preceding and current row), d as (partition by user_id order by s range between 86399999999 preceding and current row))")
def m05_sliding_budgets(spark, d):
    """Which events exceed the budgets of requests a minute, requests a day and tokens a day."""
    out = w03_sliding_budget(spark, d)
    return out.select("event_id", (F.col("n_minute") > 2).alias("over_minute"), ((F.col("n_day") > 60) | (F.col("sum_day") > 3000)).alias("over_day"))


@query("with e as (select *, (event_type = 'click')::int as bad, row_number() over (partition by user_id order by ts, event_id) as k from events), i as (select *, sum(1 - bad) over (partition by user_id order by k) as island from e) select event_id, case when bad = 1 then sum(bad) over (partition by user_id, island order by k) else 0 end::bigint as streak from i")
def w08_streaks(spark, d):
    out = streaks(events(spark, d), ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") == "click")
    return out.select("event_id", F.col("streak").cast("long").alias("streak"))


@query("select user_id, event_id, value from (select *, row_number() over (partition by user_id order by value desc nulls last, event_id) as r from events) where r = 1")
def w13_best_variant(spark, d):
    return first_per_key(events(spark, d).select("user_id", "event_id", "value"), ["user_id"], [F.desc_nulls_last("value"), F.col("event_id")])


@query("select event_id, json_extract_string(props, '$.k')::bigint as k from events where props is not null")
def x22_json_field(spark, d):
    return events(spark, d).where("props is not null").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as bigint), 0) as tokens, json_extract_string(props, '$.k') is not null as known from events")
def x43_usage(spark, d):
    k = F.get_json_object("props", "$.k")
    return events(spark, d).select("event_id", F.coalesce(k.try_cast("long"), F.lit(0)).alias("tokens"), k.isNotNull().alias("known"))


@query("select c_custkey, least(1440, case least(greatest((c_custkey % 7)::int, 1), 5) when 1 then 10 when 2 then 30 when 3 then 120 when 4 then 720 else 1440 end) as wait, least(21600, 30 * power(2, c_custkey % 12))::int as backoff from customer")
def x32_backoff(spark, d):
    n = F.least(F.greatest((F.col("c_custkey") % 7).cast("int"), F.lit(1)), F.lit(5))
    table_ = F.element_at(F.array(*[F.lit(x) for x in (10, 30, 120, 720, 1440)]), n)
    return table(spark, d, "customer").select("c_custkey", F.least(F.lit(1440), table_).alias("wait"), F.least(F.lit(21600), F.lit(30) * F.power(F.lit(2), F.col("c_custkey") % 12)).cast("int").alias("backoff"))


@query("select o_orderkey, case when n >= 1073741824 then format('{:,.1f}', n / 1073741824.0) || ' GiB' when n >= 1048576 then format('{:,.1f}', n / 1048576.0) || ' MB' when n >= 1024 then format('{:,.1f}', n / 1024.0) || ' KB' else format('{:,}', n) || ' B' end as size from (select o_orderkey, (o_orderkey * 8191 + 3) as n from orders)")
def x33_human_bytes(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.human_bytes(F.col("o_orderkey") * 8191 + 3).alias("size"))


@query("select day, user_id, n, sum(n) over (partition by user_id order by day range between interval 6 day preceding and current row)::bigint as n_week from (select ts::date as day, user_id, count(*) as n from events group by 1, 2)")
def m06_retention(spark, d):
    daily = events(spark, d).groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.count("*").alias("n"))
    out = rolling(daily.withColumn("s", F.datediff("day", F.lit("2000-01-01"))), ["user_id"], F.col("s"), 6, {"n_week": F.sum("n")})
    return out.select("day", "user_id", "n", "n_week")


@query("select user_id, round(sum(greatest(value, 1.0)), 4) as reserved, round(sum(value), 4) as settled from events group by 1")
def m08_settle(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.round(F.sum(F.greatest("value", F.lit(1.0))), 4).alias("reserved"), F.round(F.sum("value"), 4).alias("settled"))


@query("select user_id, count(*) filter (where event_type = 'click') as attempts, (max(ts) filter (where event_type = 'click') + interval 10 minute)::date as next_day from events group by 1")
def m09_retry_state(spark, d):
    tried = F.when(F.col("event_type") == "click", F.col("ts"))
    return events(spark, d).groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("attempts"), F.to_date(F.max(tried) + F.expr("interval 10 minutes")).alias("next_day"))


@query("select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem where l_shipdate <= timestamp '1998-09-01' group by 1, 2")
def q_pricing_summary(spark, d):
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-01").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("select n_name, count(distinct o_orderkey) as n_orders, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by 1")
def q_revenue_by_nation(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r")).groupBy("l_orderkey").agg(F.sum("r").alias("r"))
    df = li.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    df = df.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("n_orders"), F.sum("r").alias("r"))
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return df.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.sum("n_orders").alias("n_orders"), F.round(F.sum("r"), 2).alias("revenue"))
