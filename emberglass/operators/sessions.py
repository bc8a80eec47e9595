"""Grouping activity into sessions by a sweep over interval ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP_US = 30 * 60 * 1_000_000


def _slots(events: DataFrame, gap_us: int) -> DataFrame:
    return events.where("user_id is not null and time_us is not null").withColumn("slot", F.floor(F.col("time_us") / F.lit(gap_us)).cast("bigint"))


def _sweep(slots: DataFrame, gap_us: int, keep: list[str]) -> DataFrame:
    """Numbers the sessions of each user over ``(user_id, slot, first_us, last_us, …)`` rows.

    Each row adds one at its first event and takes one away at its last event plus the gap; where the running sum
    falls to zero a session closes. At equal places additions come first, so an event exactly one gap later still
    joins its session.
    """
    # the gap's end is closed: +1 sorts before -1 at the same place
    marks = F.array(
        F.struct(F.col("first_us").alias("at_us"), F.lit(1).alias("step")),
        F.struct((F.col("last_us") + F.lit(gap_us)).alias("at_us"), F.lit(-1).alias("step")),
    )
    swept = slots.withColumn("mark", F.explode(marks)).select("user_id", *keep, "mark.at_us", "mark.step")
    order = Window.partitionBy("user_id").orderBy("at_us", F.col("step").desc())
    running = swept.withColumn("open", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    opens = F.when((F.col("step") == 1) & (F.col("open") == 1), 1).otherwise(0)
    return running.withColumn("session_no", F.sum(opens).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def sessions(events: DataFrame, gap_us: int = GAP_US) -> DataFrame:
    """``(user_id, session_start_us, session_end_us, duration_us, n_events)``: one row per session.

    ``events`` needs ``user_id`` and ``time_us``; rows without either are left out, repeated rows count as events but
    change no bound, extra columns are ignored, no rows give no sessions. A session ends when more than ``gap_us`` pass.

    Events are first folded into slots one gap long: two events in a slot are always in one session, so the fold is
    exact, combines on the map side, and leaves the window at most one row per user and slot. A user with a third of all
    events therefore costs the window no more than the slots of the time span.
    """
    slots = _slots(events, gap_us).groupBy("user_id", "slot").agg(F.min("time_us").alias("first_us"), F.max("time_us").alias("last_us"), F.count("*").alias("n"))
    swept = _sweep(slots, gap_us, ["n"])
    return (
        swept.groupBy("user_id", "session_no")
        .agg(
            F.min(F.when(F.col("step") == 1, F.col("at_us"))).alias("session_start_us"),
            F.max(F.when(F.col("step") == -1, F.col("at_us") - F.lit(gap_us))).alias("session_end_us"),
            F.sum(F.when(F.col("step") == 1, F.col("n"))).alias("n_events"),
        )
        .select("user_id", "session_start_us", "session_end_us", (F.col("session_end_us") - F.col("session_start_us")).alias("duration_us"), "n_events")
    )


def sessions_with_actions(events: DataFrame, gap_us: int = GAP_US) -> DataFrame:
    """``sessions`` with ``n_actions``, the number of distinct ``action_id`` values of each session.

    Null action ids count as no action. Actions are made distinct per slot first and meet their session over
    (user, slot), then are counted by two-step aggregation; no list of actions is ever gathered.
    """
    slotted = _slots(events, gap_us)
    slots = slotted.groupBy("user_id", "slot").agg(F.min("time_us").alias("first_us"), F.max("time_us").alias("last_us"), F.count("*").alias("n"))
    swept = _sweep(slots, gap_us, ["slot", "n"])
    opened = F.min("at_us").over(Window.partitionBy("user_id", "session_no"))
    closed = F.max(F.when(F.col("step") == -1, F.col("at_us") - F.lit(gap_us))).over(Window.partitionBy("user_id", "session_no"))
    whole = swept.withColumns({"session_start_us": opened, "session_end_us": closed}).where("step = 1").select("user_id", "slot", "n", "session_start_us", "session_end_us")
    bounds = ["user_id", "session_start_us", "session_end_us"]
    actions = (
        slotted.where("action_id is not null").select("user_id", "slot", "action_id").distinct()
        .join(whole.drop("n"), ["user_id", "slot"])
        .select(*bounds, "action_id").distinct()
        .groupBy(bounds).agg(F.count("*").alias("n_actions"))
    )
    counts = whole.groupBy(bounds).agg(F.sum("n").alias("n_events"))
    return counts.join(actions, bounds, "left").select(
        *bounds, (F.col("session_end_us") - F.col("session_start_us")).alias("duration_us"), "n_events", F.coalesce("n_actions", F.lit(0)).cast("bigint").alias("n_actions")
    )
