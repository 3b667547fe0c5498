"""Recency, periodicity, sequences and sessions over events and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathom.functions import temporal as t
from fathom.operators import curate
from fathom.plans.registry import AS_OF, Registry
from fathom.sources.tables import table

query = Registry()
AGE = f"greatest(0, (epoch_us(timestamp '{AS_OF}') - epoch_us(ts)) / 1e6)"


def _events(spark, d):
    return table(spark, d, "events").withColumn("age", t.age("ts", AS_OF))


def _scored(expression: str) -> str:
    return f"select event_id, round({expression}, 6) as score from (select *, {AGE} as age from events)"


def _half(half: float) -> str:
    return f"exp(-ln(2) * age / {half})"


@query(_scored("greatest(0, 1 - age / 2592000)"))
def recency_linear(spark, d):
    return _events(spark, d).select("event_id", F.round(t.linear(F.col("age"), t.HORIZON["long"]), 6).alias("score"))


@query(_scored(_half(604800 / 4)))
def recency_exponential(spark, d):
    return _events(spark, d).select("event_id", F.round(t.decay(F.col("age"), "exponential", "macro"), 6).alias("score"))


@query(_scored("(case when age <= 300 then 1.0 when age <= 3600 then 0.8 when age <= 86400 then 0.5 when age <= 604800 then 0.3 else 0.1 end)::double"))
def recency_step(spark, d):
    return _events(spark, d).select("event_id", F.round(t.step(F.col("age")), 6).alias("score"))


@query(_scored(f"0.4 * {_half(3600)} + 0.35 * {_half(86400)} + 0.25 * {_half(604800)}"))
def recency_multiscale(spark, d):
    return _events(spark, d).select("event_id", F.round(t.multi_scale(F.col("age")), 6).alias("score"))


@query("with n as (select count(*) as n from events) select event_id, round(exp(-ln(2) * age / (86400 * least(2, greatest(0.8, 1 + 0.1 * log10(n / 1000))))), 6) as score from (select *, " + AGE + " as age from events), n")
def recency_adaptive(spark, d):
    events = _events(spark, d)
    n = F.broadcast(events.agg(F.count("*").alias("n")))  # one row
    return events.crossJoin(n).select("event_id", F.round(F.exp(-F.log(F.lit(2.0)) * F.col("age") / t.adaptive_half_life(t.DAY, F.col("n"))), 6).alias("score"))


@query("select event_id, round((1 - least(abs(hour(ts) - 14), 24 - abs(hour(ts) - 14)) / 12.0 + 1 - least(abs(dayofweek(ts) - 3), 7 - abs(dayofweek(ts) - 3)) / 3.5) / 2, 6) as score from events")
def periodic_match(spark, d):
    return table(spark, d, "events").select("event_id", F.round(t.periodic("ts", 14, 3), 6).alias("score"))


@query("select conv_id, turn, round(case when abs(turn - 3) > 5 then 0 else 1 - abs(turn - 3) / 5 end, 6) as linear, round(case when abs(turn - 3) > 5 then 0 else exp(-3 * abs(turn - 3) / 5) end, 6) as exponential from conversations")
def sequence_proximity(spark, d):
    gap = F.col("turn") - 3
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(t.proximity(gap, 5.0), 6).alias("linear"), F.round(t.proximity(gap, 5.0, True), 6).alias("exponential"))


_B = f"select event_id, value / 1000 as sim, {AGE} as age, ts from events"


@query(f"select event_id, round(sim * least(1.2, greatest(0.8, 1 + 0.3 * ({_half(21600)} - 0.5))), 8) as score from ({_B})")
def search_recent(spark, d):
    events = _events(spark, d)
    return events.select("event_id", F.round(t.boosted(F.col("value") / 1000, t.decay(F.col("age"), "exponential", "meso"), 0.3), 8).alias("score"))


@query(f"select event_id, round(sim * 0.7 + 0.3 * ({_half(86400)} * (0.5 / 0.65) + (1 - least(abs(hour(ts) - 14), 24 - abs(hour(ts) - 14)) / 12.0) * (0.15 / 0.65)), 6) as score from ({_B})")
def temporal_boost(spark, d):
    events = _events(spark, d)
    parts = {"recency": (t.exponential(F.col("age"), t.DAY), 0.50), "periodic": (t.periodic("ts", 14), 0.15)}
    return events.select("event_id", F.round(t.combined(F.col("value") / 1000, parts, 0.3), 6).alias("score"))


@query("select event_id, user_id, event_type from events where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-12'")
def time_window_filter(spark, d):
    return table(spark, d, "events").where("ts >= timestamp'2024-01-10' and ts < timestamp'2024-01-12'").select("event_id", "user_id", "event_type")


@query("select conv_id, turn, role, length(text) as n_chars from conversations where role = 'user' order by conv_id, turn limit 50 offset 10")
def session_timeline(spark, d):
    """Paging: its limit is the feature."""
    rows = table(spark, d, "conversations").where("role = 'user'")
    return rows.orderBy("conv_id", "turn").offset(10).limit(50).select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"))


@query("select conv_id, turn, list(turn) over w as context, count(*) over w as n from conversations window w as (partition by conv_id order by turn rows between 2 preceding and 2 following)")
def conversation_window(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, 2)
    return table(spark, d, "conversations").select("conv_id", "turn", F.collect_list("turn").over(w).alias("context"), F.count("*").over(w).alias("n"))


@query("select * from (select conv_id, turn, lag(turn) over w as before, lead(turn) over w as after, lead(role) over w as next_role from conversations window w as (partition by conv_id order by turn))")
def memory_chain(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.lag("turn").over(w).alias("before"), F.lead("turn").over(w).alias("after"), F.lead("role").over(w).alias("next_role"))


@query("select conv_id, role, count(*) filter (turn <= 2) as before, count(*) filter (turn > 2 and turn <= 5) as after, count(*) filter (turn > 2 and turn <= 5) - count(*) filter (turn <= 2) as diff from conversations group by conv_id, role")
def compare_session_states(spark, d):
    before, after = F.count_if(F.col("turn") <= 2), F.count_if((F.col("turn") > 2) & (F.col("turn") <= 5))
    return table(spark, d, "conversations").groupBy("conv_id", "role").agg(before.alias("before"), after.alias("after"), (after - before).alias("diff"))


@query(f"select event_id, round(exp(-(age / 3600) / ((1 + ln(event_id % 10 + 1)) * (1 + least(1, greatest(0, value / 1000))) * 24)), 6) as kept from (select *, {AGE} as age from events)")
def forgetting_curve(spark, d):
    importance = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 1000))
    return _events(spark, d).select("event_id", F.round(t.forgetting(F.col("age") / 3600, F.col("event_id") % 10, importance), 6).alias("kept"))


@query("with g as (select user_id, ts, case when lag(ts) over w is null or ts >= lag(ts) over w + interval 6 hour then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id)), s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from g) select user_id, count(distinct s) as sessions, count(*) as events from s group by user_id")
def session_windows(spark, d):
    own = table(spark, d, "events").groupBy(F.session_window("ts", "6 hours"), "user_id").agg(F.count("*").alias("n"))
    return own.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


@query("select date_trunc('day', ts) as day, event_type, count(*) as n, round(sum(value), 4) as value from events group by 1, 2")
def daily_counts(spark, d):
    return table(spark, d, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query("with x as (select user_id, event_id, ts from events), t as (select a.event_id as a, b.event_id as b, abs(epoch_us(a.ts) - epoch_us(b.ts)) / 1e6 as seconds from x a join x b on a.user_id = b.user_id and a.event_id < b.event_id) select a, b, seconds from t where seconds < 3600")
def consolidation_temporal(spark, d):
    rows = table(spark, d, "events")
    return curate.close_in_time(rows, "event_id", "ts", ["user_id"], hours=1.0).select("a", "b", "seconds")


@query("select event_id, list_filter(['same_day', 'same_hour', 'recent'], lambda x: (x = 'same_day' and ts::date = date '2024-01-30') or (x = 'same_hour' and hour(ts) = 12) or (x = 'recent' and ts >= timestamp '2024-01-30')) as badges from events")
def temporal_badges(spark, d):
    badge = lambda c, name: F.when(c, name)
    own = F.array(badge(F.to_date("ts") == F.lit("2024-01-30").cast("date"), "same_day"), badge(F.hour("ts") == 12, "same_hour"), badge(F.col("ts") >= F.lit("2024-01-30").cast("timestamp"), "recent"))
    return table(spark, d, "events").select("event_id", F.array_compact(own).alias("badges"))


@query("select l_orderkey, l_linenumber, round(0.4 * (l_discount * 10) + 0.3 * (1 - l_tax * 10) + 0.3 * least(l_quantity / 40, 1.0), 6) as score from lineitem")
def consolidation_score(spark, d):
    """Importance, what is forgotten, and the rate of access, for every line."""
    score = t.consolidation(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 40)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score"))
