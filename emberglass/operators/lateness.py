"""Late and out-of-order events: counts per event-time window that late records correct until the window closes.

Every window of event time (a UTC clock hour) stays open until the watermark passes its end. The watermark is the arrival clock
less the allowed lateness: a record meets the watermark of its own arrival, so records replayed in another order or later are
refused or taken all the same. The state is one row per dataset, window and action; each arrival period that has new records of
a key gives its corrected row (an upsert), and records whose window is closed are diverted. ``emberglass.streaming.late`` keeps
the same state in a table while a stream runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
LATENESS_US = 24 * HOUR_US


def place(records: DataFrame, period_us: int = HOUR_US, lateness_us: int = LATENESS_US) -> DataFrame:
    """Adds ``window_start_us``, ``watermark_us``, ``lag`` and ``refused`` to records with ``event_us`` and ``arrival_us``.

    ``lag`` is on_time (arrived before the window's end), late (after it, the watermark not past the end) or refused (the
    watermark past it). Unknown event time gives no window and unknown arrival no watermark and no lag; such records are never
    refused.
    """
    start = (F.floor(F.col("event_us") / F.lit(period_us)) * F.lit(period_us)).cast("bigint")
    end = F.col("window_start_us") + F.lit(period_us)
    lag = (
        F.when(F.col("event_us").isNull() | F.col("arrival_us").isNull(), F.lit(None))
        .when(F.col("arrival_us") < end, "on_time")
        .when(F.col("watermark_us") <= end, "late")
        .otherwise("refused")
    )
    placed = records.withColumns({"window_start_us": start, "watermark_us": F.col("arrival_us") - F.lit(lateness_us)})
    return placed.withColumn("lag", lag).withColumn("refused", F.coalesce(F.col("lag") == "refused", F.lit(False)))


def refused(records: DataFrame, period_us: int = HOUR_US, lateness_us: int = LATENESS_US) -> DataFrame:
    """``(dataset, record_id)`` of the records diverted from the counts, once each; null record ids are kept as one row."""
    return place(records, period_us, lateness_us).where("refused").select("dataset", "record_id").distinct()


def once(records: DataFrame) -> DataFrame:
    """Each record id of a dataset once: the copy of the earliest known arrival, then of the earliest event and least action name.

    Records without an id cannot be copies of one another and all stay; those without a readable event time are left out.
    """
    known = records.where("event_us is not null").select("dataset", "record_id", "action_name", "event_us", "arrival_us")
    copy = F.struct(F.col("arrival_us").isNull().alias("unknown"), "arrival_us", "event_us", "action_name")
    named = known.where("record_id is not null").groupBy("dataset", "record_id").agg(F.min(copy).alias("c"))
    return named.select("dataset", "record_id", "c.action_name", "c.event_us", "c.arrival_us").unionByName(known.where("record_id is null"))


#: A key of the state, and its measures.
KEY = ("dataset", "window_start_us", "action_name")
MEASURES = ("n_first", "n_late", "n_unknown", "n_refused")


def partial_counts(placed: DataFrame, *more: str) -> DataFrame:
    """Counts of placed records per key of the state (and further columns): what they add to it. Combined on the map side."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return placed.groupBy(*KEY, *more).agg(n(F.col("lag") == "on_time").alias("n_first"), n(F.col("lag") == "late").alias("n_late"), n(F.col("lag").isNull()).alias("n_unknown"), n(F.col("refused")).alias("n_refused"))


def upserts(records: DataFrame, period_us: int = HOUR_US, lateness_us: int = LATENESS_US) -> DataFrame:
    """``(dataset, window_start_us, action_name, arrival_period, n_first, n_late, n_unknown, n_refused, n_final, last)``.

    The state's rows as the stream of arrivals makes them: one per key and arrival period (as long as a window) in which records of
    the key came, with the counts corrected so far; ``last`` marks the row that stands at the end. Records of unknown arrival
    are in from the start. ``n_final`` is what the window counts: all but the refused. The windows run over the counts of
    keys and periods, so the records of a hot key have been folded before.
    """
    period = F.floor(F.col("arrival_us") / F.lit(period_us)).cast("bigint")
    added = partial_counts(place(once(records), period_us, lateness_us).withColumn("arrival_period", period), "arrival_period")
    order = Window.partitionBy(*KEY).orderBy(F.col("arrival_period").asc_nulls_first())
    state = added.withColumns({m: F.sum(m).over(order.rowsBetween(Window.unboundedPreceding, 0)) for m in MEASURES} | {"last": F.lead(F.lit(False), 1, True).over(order)})
    return state.withColumn("n_final", F.col("n_first") + F.col("n_late") + F.col("n_unknown"))


def period_counts(records: DataFrame, period_us: int = HOUR_US, lateness_us: int = LATENESS_US) -> DataFrame:
    """``(dataset, hour_start_us, action_name, n_first, n_late, n_final, n_refused)``: the state after the last arrival.

    ``n_first`` is what was known at the window's end, ``n_late`` what late records added until it closed, ``n_final`` their sum
    with the records of unknown arrival, ``n_refused`` what came too late. A record id counts once (``once``); a null action name
    is a group of its own; an empty table gives no rows; extra columns are ignored.
    """
    return upserts(records, period_us, lateness_us).where("last").select("dataset", F.col("window_start_us").alias("hour_start_us"), "action_name", "n_first", "n_late", "n_final", "n_refused")
