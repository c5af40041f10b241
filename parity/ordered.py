"""Windows and joins in the order of a key's rows, with one user holding half of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from parity.registry import query, table
from plumbline.operators.asof import asof_join
from plumbline.operators.scans import Measures, segmented_scan

_BUSY = "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 0 ELSE user_id END AS user_id, event_type, ts, value FROM events"


def _busy_events(spark, sf_dir):
    """Events of which every other one belongs to user 0."""
    user = F.when(F.col("event_id") % 2 == 0, 0).otherwise(F.col("user_id")).alias("user_id")
    return table(spark, sf_dir, "events").select("event_id", user, "event_type", "ts", "value")


@query(
    f"""SELECT event_id, user_id, row_number() OVER w AS visit, lag(event_id) OVER w AS before_id, lag(value, 3) OVER w AS third_value FROM ({_BUSY})
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
)
def window_hot_user(spark, sf_dir):
    """Positions and earlier rows within a user."""
    measures = Measures(row_number=["visit"], lag={"before_id": ("event_id", 1), "third_value": ("value", 3)})
    done = segmented_scan(_busy_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], measures)
    return done.select("event_id", "user_id", "visit", "before_id", "third_value")


@query(
    f"""SELECT event_id, user_id, CAST(ts AS DATE) AS day, row_number() OVER w AS visit, lag(event_id) OVER w AS before_id FROM ({_BUSY})
WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id)"""
)
def window_hot_user_and_day(spark, sf_dir):
    """The same within a user's day."""
    events = _busy_events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    measures = Measures(row_number=["visit"], lag={"before_id": ("event_id", 1)})
    done = segmented_scan(events, ["user_id", "day"], ["ts", "event_id"], measures)
    return done.select("event_id", "user_id", "day", "visit", "before_id")


@query(
    f"""SELECT event_id, CAST(sum(cents) OVER w AS BIGINT) AS spent_so_far, last_value(purchase IGNORE NULLS) OVER w AS latest_purchase FROM (
  SELECT *, CASE WHEN event_type = 'purchase' THEN event_id END AS purchase,
    CASE WHEN event_type = 'purchase' THEN CAST(floor(value * 100) AS BIGINT) ELSE 0 END AS cents FROM ({_BUSY}))
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"""
)
def running_totals_hot_user(spark, sf_dir):
    """What a user has spent so far, and the user's latest purchase, at every event."""
    bought = F.col("event_type") == "purchase"
    events = _busy_events(spark, sf_dir).select(
        "event_id", "user_id", "ts", F.when(bought, F.col("event_id")).alias("purchase"), F.when(bought, F.floor(F.col("value") * 100)).alias("cents")
    )
    measures = Measures(last={"latest_purchase": "purchase"}, running_sum={"spent_so_far": "cents"})
    done = segmented_scan(events, ["user_id"], ["ts", "event_id"], measures)
    return done.select("event_id", "spent_so_far", "latest_purchase")


@query(
    f"""WITH busy AS ({_BUSY}), p AS (SELECT user_id, ts, max(event_id) AS purchase_id, max_by(value, event_id) AS paid FROM busy WHERE event_type = 'purchase' GROUP BY user_id, ts)
SELECT e.event_id, p.purchase_id, p.paid, p.ts AS ts_right FROM busy e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts > p.ts WHERE e.event_type <> 'purchase'"""
)
def asof_hot_user(spark, sf_dir):
    """The purchase before every other event of the same user, strictly earlier."""
    events = _busy_events(spark, sf_dir)
    others = events.where("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    purchases = events.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"), F.col("value").alias("paid"))
    return asof_join(others, purchases, ["user_id"], "ts", ["purchase_id"], strict=True).select("event_id", "purchase_id", "paid", "ts_right")
