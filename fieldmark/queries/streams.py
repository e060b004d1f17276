"""Streaming jobs over the table events, each with the batch result as its counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.ratings import RatingSpec, replayed
from ..sources.tables import DOMAIN
from ..streaming.jobs import event_stream, first_deliveries, hourly, keep_latest, latest_updates, rated_stream, run_now, table_stream
from . import query
from .rating_sql import elo_sql
from .ratings import ROUNDED, final_games, rounded


@query("st_hourly_snapshot", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, round(arg_max(value, ts), 4) AS value, count(*) AS n FROM events GROUP BY 1")
def _(t):
    """Hours stay open in the state, so that a late row counts in its hour."""
    hours = event_stream(t.spark, t.sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour")).agg(F.max_by("value", "ts").alias("v"), F.count("*").alias("n"))
    return latest_updates(hours, ["hour"], "hourly").select("hour", F.round("v", 4).alias("value"), "n")


@query("st_hourly_bounded", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, round(arg_max(value, (ts, value)), 4) AS value, count(*) AS n FROM events GROUP BY 1")
def _(t):
    """The same with hours that leave the state four hours after their end."""
    return hourly(event_stream(t.spark, t.sf_dir), "ts", "value", "4 hours", "hourly-bounded").select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), F.round("value", 4).alias("value"), "n")


@query("st_dedup_bounded", "SELECT event_id, user_id FROM events")
def _(t):
    """Every event is delivered twice and passes once; ids leave the state after four hours."""
    s = event_stream(t.spark, t.sf_dir).select("event_id", "user_id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery"))
    return first_deliveries(s, ["event_id"], "ts", "4 hours", "dedup-bounded").select("event_id", "user_id")


@query("st_latest_quote", "SELECT user_id AS market, arg_max(event_id, ts) AS quote_id, round(1.01e0 + arg_max(value, ts) / 100, 4) AS price FROM events GROUP BY 1")
def _(t):
    q = event_stream(t.spark, t.sf_dir).select(F.col("user_id").alias("market"), "ts", F.col("event_id").alias("quote_id"), (1.01 + F.col("value") / 100).alias("price"))
    return keep_latest(q, ["market"], "ts", "latest-quote").select("market", "quote_id", F.round("price", 4).alias("price"))


@query("st_close_join", """SELECT w.event_id AS wager_id, q.event_id AS quote_id FROM events w JOIN events q ON w.user_id = q.user_id AND q.ts <= w.ts AND q.ts >= w.ts - INTERVAL '4' HOUR WHERE w.event_type = 'purchase' AND q.event_type = 'view'""")
def _(t):
    s = event_stream(t.spark, t.sf_dir)
    w = s.where("event_type = 'purchase'").select(F.col("event_id").alias("wager_id"), F.col("user_id").alias("wm"), F.col("ts").alias("wt")).withWatermark("wt", "4 hours")
    q = s.where("event_type = 'view'").select(F.col("event_id").alias("quote_id"), F.col("user_id").alias("qm"), F.col("ts").alias("qt")).withWatermark("qt", "4 hours")
    return run_now(w.join(q, F.expr("wm = qm AND qt <= wt AND qt >= wt - INTERVAL '4' HOUR")).select("wager_id", "quote_id"), "close-join")


@query("st_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    """Known pairs are the state, so a pair passes once whenever it comes."""
    s = event_stream(t.spark, t.sf_dir).select("user_id", "event_type").dropDuplicates()
    return run_now(s, "dedup")


@query("st_pregame_late", "SELECT event_id FROM events WHERE ts < date_trunc('day', ts) + INTERVAL '20' HOUR")
def _(t):
    s = event_stream(t.spark, t.sf_dir)
    return run_now(s.where(F.col("ts") < F.date_trunc("day", "ts") + F.expr("INTERVAL '20' HOUR")).select("event_id"), "pregame")


@query("src_incremental", "SELECT user_id, max(event_id) AS last_event, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1")
def _(t):
    fills = event_stream(t.spark, t.sf_dir).where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return keep_latest(fills, ["event_id"], "ts", "fills").groupBy("user_id").agg(F.max("event_id").alias("last_event"), F.count("*").alias("n"))


@query("st_rating_update", f"{elo_sql({'one': RatingSpec()})} SELECT game_id, league, {ROUNDED} FROM scored")
def _(t):
    """Games as they come; the leagues of games that come too late are rated anew from all games."""
    games = t.spark.sql(DOMAIN["games"], orders=table_stream(t.spark, t.sf_dir, "orders")).where("status <> 'scheduled'")
    scored = rated_stream(games, RatingSpec(), "ratings")
    return rounded(replayed(scored, final_games(t), RatingSpec()))
