"""Queries of streams: driven to the end of the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import ship
from ..streaming import state


def windows(spark, d):
    ship(spark)
    rows = state.run(state.windowed_counts(state.event_stream(spark, d)), "update")
    return rows.groupBy("start", "event_type").agg(F.max("n").alias("n"), F.max_by("total", "n").alias("total"))  # the last update of each window


def averages(spark, d):
    ship(spark)
    rows = state.run(state.moving_averages(state.event_stream(spark, d)), "update")
    return state.last_states(rows, "user_id", "seen").select("user_id", F.round("ema", 6).alias("ema"), "seen")


def turns(spark, d):
    """Users as trajectories of their events (a proxy): purchases answer, clicks call a tool."""
    ship(spark)
    kind = F.when(F.col("event_type") == "purchase", "answer").when(F.col("event_type") == "click", "tool").otherwise("other")
    steps = state.event_stream(spark, d).select(F.col("user_id").cast("string").alias("traj_uid"), F.col("event_id").alias("step"), kind.alias("kind"))
    return state.last_states(state.run(state.trajectories(steps), "update"), "traj_uid", "steps")


QUERIES = {"str_windows": windows, "str02_moving_averages": averages, "str01_trajectories": turns}

SQL = {
    "str_windows": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "str02_moving_averages": "SELECT user_id, round(list_reduce(list(value ORDER BY event_id) FILTER (WHERE value > 0), lambda a, v: 0.25::DOUBLE * v + 0.75::DOUBLE * a), 6) AS ema, count(*) AS seen FROM events GROUP BY 1",
    "str01_trajectories": """WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), f AS (SELECT user_id, count(*) AS n, max(event_type) FILTER (WHERE i = 1) AS a, max(event_type) FILTER (WHERE i = 2) AS b FROM e GROUP BY 1)
        SELECT CAST(user_id AS VARCHAR) AS traj_uid, CASE WHEN n = 1 AND a = 'click' THEN 'answer_after_tool' ELSE 'done' END AS stage, CAST(n AS INTEGER) AS steps,
        (n = 1 AND a IN ('purchase', 'click')) OR (n = 2 AND a = 'click' AND b = 'purchase') AS valid FROM f""",
}
