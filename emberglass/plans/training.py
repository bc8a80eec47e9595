"""Queries of the general training-data problems over the project's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import filled, ntz_us, readable_object, send_time_us, type_key, us_ntz, user_key
from ..operators import dedup, drift, features, lateness, sessions
from ..runtime import computed, table

#: Arrival times before this are what senders write when they know none.
KNOWN_FROM_US = 365 * 86_400 * 1_000_000


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicates(table(spark, sf_dir, "coordinator_deliveries"))


def p1_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.keep_one(table(spark, sf_dir, "coordinator_deliveries")).select("delivery_id", "batch_id", "subscription", "received_at")


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(entity, kind, at, score)`` of user_actions, each id once: copies are whole rows, so the first ingested stands for all."""
    t = table(spark, sf_dir, "user_actions")
    row = F.struct(F.col("ingested_at").isNull().alias("late"), "ingested_at", F.col("data.user_id").alias("user_id"), F.col("data.event_type").alias("event_type"), "event_time", "score")
    once = t.where("id is not null").groupBy("id").agg(F.min(row).alias("r"))
    return once.select(user_key(F.col("r.user_id")).alias("entity"), type_key(F.col("r.event_type")).alias("kind"), F.col("r.event_time").alias("at"), F.col("r.score").alias("score"))


#: A user id under any of its key spellings at any depth of the JSON.
USER_IN_JSON = r'(?i)"(?:user_?id|uid)"\s*:\s*"([^"\\]*)"'


def request_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(entity, kind, at)`` of action_requests, each request once, the user taken from readable JSON."""
    t = table(spark, sf_dir, "action_requests").where("request_no is not null")
    # the user is looked for before copies are folded, so that no payload is sorted or shuffled, and once per row
    user = F.when(readable_object(F.col("action_data_json")), F.regexp_extract("action_data_json", USER_IN_JSON, 1))
    read = computed(t.select("request_no", "received_at", "action_name", "request_timestamp", "action_data_json"), request_no=F.col("request_no"), received_at=F.col("received_at"), kind=filled(F.btrim("action_name")), at=F.col("request_timestamp"), entity=user_key(user))
    once = read.groupBy("request_no").agg(F.min(F.struct(F.col("received_at").isNull().alias("late"), "received_at", "kind", "at", "entity")).alias("r"))
    return once.select("r.entity", "r.kind", "r.at")


def p2_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user, with n, latest and total of each event type and n and latest of each action name."""
    total = F.coalesce(F.sum(F.col("score").cast("decimal(28,6)")), F.lit(0)).cast("double")
    n, latest = F.count("*"), F.max("at")
    zero = F.lit(0).cast("bigint")
    table_ = features.feature_table(
        [
            ("event", user_events(spark, sf_dir), None, {"n": n, "latest": latest, "total": total}, {"n": zero, "total": F.lit(0.0)}),
            ("action", request_events(spark, sf_dir), None, {"n": n, "latest": latest}, {"n": zero}),
        ]
    )
    return table_.withColumnRenamed("entity", "user_id")


def p2_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same features, one row per user and type: what SQL is held against."""
    total = F.coalesce(F.sum(F.col("score").cast("decimal(28,6)")), F.lit(0)).cast("double").alias("total")
    e = user_events(spark, sf_dir).where("entity is not null and kind is not null").groupBy("entity", "kind").agg(F.count("*").alias("n"), F.max("at").alias("latest"), total).withColumn("part", F.lit("event"))
    a = request_events(spark, sf_dir).where("entity is not null and kind is not null").groupBy("entity", "kind").agg(F.count("*").alias("n"), F.max("at").alias("latest"), F.lit(0.0).alias("total")).withColumn("part", F.lit("action"))
    return e.unionByName(a).withColumnRenamed("entity", "user_id")


def session_events(spark: SparkSession, sf_dir: str, actions: bool = False) -> DataFrame:
    t = table(spark, sf_dir, "kafka_messages").select(F.col("template.data.data.user_id").alias("user"), F.col("template.data.action_id").alias("action"), F.col("template.send_time").alias("sent"))
    return computed(t, user_id=user_key(F.col("user")), time_us=send_time_us(F.col("sent")), **({"action_id": filled(F.btrim("action"))} if actions else {}))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessions(session_events(spark, sf_dir)).select("user_id", "session_start_us", "session_end_us")


def p4_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessions_with_actions(session_events(spark, sf_dir, actions=True))


def arrivals(spark: SparkSession, sf_dir: str, actions: bool = True) -> DataFrame:
    """``(dataset, record_id, action_name, event_us, arrival_us)`` of both tables; unknown times are null."""
    at = ntz_us(F.col("at"))
    k = table(spark, sf_dir, "kafka_messages").select("id", F.col("kafka_timestamp").alias("at"), F.col("template.data.action_name").alias("name"), F.col("template.send_time").alias("sent"))
    kafka = computed(k, dataset=F.lit("kafka_messages"), record_id=F.col("id"), action_name=F.col("name") if actions else F.lit(None).cast("string"), event_us=send_time_us(F.col("sent")), arrival_us=F.when(at >= KNOWN_FROM_US, at))
    a = table(spark, sf_dir, "action_requests")
    requests = a.select(
        F.lit("action_requests").alias("dataset"), F.col("request_no").cast("string").alias("record_id"), "action_name",
        ntz_us(F.col("request_timestamp")).alias("event_us"), ntz_us(F.col("received_at")).alias("arrival_us"),
    )
    return kafka.unionByName(requests)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lateness.refused(arrivals(spark, sf_dir, actions=False))


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lateness.period_counts(arrivals(spark, sf_dir))
    return c.select("dataset", us_ntz(F.col("hour_start_us")).alias("hour_start"), "action_name", "n_first", "n_late", "n_final", "n_refused")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changes(drift_profile(spark, sf_dir))


def _consistent(spark: SparkSession, sf_dir: str, name: str, payload: str) -> DataFrame:
    t = table(spark, sf_dir, name)
    keep = [c for c in t.columns if c != payload]
    return drift.consistent_table(t.withColumns({"dataset": F.lit(name), "payload": F.col(payload)}), keep)[0]


def p5_table_action_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request with a column per field its payloads ever had."""
    return _consistent(spark, sf_dir, "action_requests", "action_data_json")


def p5_table_stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored result with a column per field its payloads ever had."""
    return _consistent(spark, sf_dir, "stored_results", "extracted_features")


def drift_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t, c: drift.profile(table(spark, sf_dir, t).select(F.lit(t).alias("dataset"), "producer", "file_seq", F.col(c).alias("payload")))
    return one("action_requests", "action_data_json").unionByName(one("stored_results", "extracted_features"))


QUERIES = {"p1_found": p1_found, "p1_kept": p1_kept, "p2_features": p2_features, "p2_long": p2_long, "p4_found": p4_found, "p4_sessions": p4_sessions, "p5_found": p5_found, "p5_table_action_requests": p5_table_action_requests, "p5_table_stored_results": p5_table_stored_results, "p6_found": p6_found, "p6_counts": p6_counts}

_USER = "nullif(lower(trim({c}, ' ' || chr(9) || chr(10) || chr(13))), '')"
TIME_SQL = """case when regexp_full_match(s, '[0-9]{13}') then try_cast(s as bigint) * 1000
  when regexp_matches(s, '^[0-9]{4}-[0-9]{2}-[0-9]{2}[tT ]') then epoch_us(try_cast(
    regexp_replace(upper(s), '([.][0-9]{6})[0-9]+', '\\1') || case when regexp_matches(upper(s), '(Z|[+-][0-9]{2}:?[0-9]{2})$') then '' else 'Z' end as timestamptz)) end"""
_KEYS = """keyed as (
  select delivery_id, received_at,
    case when regexp_matches(trim(action_id, ' "'), '^[+]?[0-9]+([.]0*)?$') then nullif(ltrim(regexp_extract(trim(action_id, ' "'), '^[+]?([0-9]+)', 1), '0'), '') end as a,
    subscription || '|' || coalesce(ack_id::varchar, nullif(json_extract_string(raw_message, '$.ackId'), '')) as t
  from coordinator_deliveries)"""
# components by repeated least-neighbour steps: eight steps settle the chains of these tables
_STEP = "s{n} as (select delivery_id, received_at, a, t, min(m) over (partition by coalesce(t, 'd' || delivery_id)) as m from (select *, min(m0) over (partition by coalesce(a, 'd' || delivery_id)) as m from (select delivery_id, received_at, a, t, {src} as m0 from {prev}) q) r)"


def _components_sql() -> str:
    steps, prev, src = [], "keyed", "delivery_id"
    for n in range(8):
        steps.append(_STEP.format(n=n, src=src, prev=prev))
        prev, src = f"s{n}", "m"
    return f"with {_KEYS}, " + ", ".join(steps) + ", ranked as (select delivery_id, row_number() over (partition by m order by received_at, delivery_id) as r from s7)"


_PLACED = f"""with raw as (
  select 'kafka_messages' as dataset, id as record_id, template.data.action_name as action_name, trim(template.send_time) as s,
    case when kafka_timestamp >= timestamp '1971-01-01' then epoch_us(kafka_timestamp) end as arr, null::bigint as ev from kafka_messages
  union all select 'action_requests', request_no::varchar, action_name, null, epoch_us(received_at), epoch_us(request_timestamp) from action_requests),
timed as (select dataset, record_id, action_name, arr, coalesce(ev, {TIME_SQL}) as ev from raw),
placed as (select *, (ev // 3600000000) * 3600000000 as h from timed where ev is not null)"""

ORACLES = {
    "p1_found": _components_sql() + " select delivery_id from ranked where r > 1",
    "p1_kept": _components_sql() + " select delivery_id, batch_id, subscription, received_at from coordinator_deliveries where delivery_id in (select delivery_id from ranked where r = 1)",
    "p2_long": f"""with e as (select id, any_value(data.user_id) as u, any_value(data.event_type) as t, any_value(event_time) as ts, any_value(score) as score from user_actions group by id),
      ev as (select {_USER.format(c="u")} as user_id, replace(lower(regexp_replace(trim(t), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '-', '_') as kind, ts, score from e),
      q as (select request_no, any_value(action_name) as action_name, any_value(request_timestamp) as ts, any_value(action_data_json) as j from action_requests group by request_no),
      rq as (select {_USER.format(c="regexp_extract(j, '(?i)\"(?:user_?id|uid)\"[ ]*:[ ]*\"([^\"]*)\"', 1)")} as user_id, action_name as kind, ts from q where json_valid(j))
      select user_id, kind, count(*) as n, max(ts) as latest, coalesce(sum(score::decimal(28,6)), 0)::double as total, 'event' as part from ev where user_id is not null and nullif(kind, '') is not null group by 1, 2
      union all select user_id, kind, count(*), max(ts), 0.0::double, 'action' from rq where user_id is not null and kind is not null group by 1, 2""",
    "p4_found": f"""with e as (select {_USER.format(c="template.data.data.user_id")} as user_id, trim(template.send_time) as s from kafka_messages),
      t as (select user_id, {TIME_SQL} as us from e), k as (select * from t where user_id is not null and us is not null),
      g as (select *, case when us - lag(us) over (partition by user_id order by us) <= 1800000000 then 0 else 1 end as o from k),
      n as (select *, sum(o) over (partition by user_id order by us rows unbounded preceding) as no from g)
      select user_id, min(us) as session_start_us, max(us) as session_end_us from n group by user_id, no""",
    "p4_sessions": f"""with e as (select {_USER.format(c="template.data.data.user_id")} as user_id, trim(template.send_time) as s, nullif(trim(template.data.action_id), '') as action_id from kafka_messages),
      t as (select user_id, action_id, {TIME_SQL} as us from e), k as (select * from t where user_id is not null and us is not null),
      g as (select *, case when us - lag(us) over (partition by user_id order by us) <= 1800000000 then 0 else 1 end as o from k),
      n as (select *, sum(o) over (partition by user_id order by us rows unbounded preceding) as no from g)
      select user_id, min(us) as session_start_us, max(us) as session_end_us, max(us) - min(us) as duration_us, count(*) as n_events, count(distinct action_id) as n_actions from n group by user_id, no""",
    "p6_found": _PLACED + " select distinct dataset, record_id from placed where arr > h + 25 * 3600000000::bigint",
    "p6_counts": _PLACED
    + """, once as (select dataset, record_id, action_name, h, arr from placed qualify record_id is null or row_number() over (partition by dataset, record_id order by arr is null, arr, ev, action_name nulls first) = 1)
      select dataset, make_timestamp(h) as hour_start, action_name,
        count(*) filter (arr < h + 3600000000) as n_first,
        count(*) filter (arr >= h + 3600000000 and arr <= h + 25 * 3600000000::bigint) as n_late,
        count(*) filter (arr is null or arr <= h + 25 * 3600000000::bigint) as n_final,
        count(*) filter (arr > h + 25 * 3600000000::bigint) as n_refused
      from once group by 1, 2, 3""",
}

# one column per type and measure, with the defaults of the table
_LONG = ORACLES["p2_long"]
ORACLES["p2_features"] = f"""with e as (pivot (select user_id, 'event_' || kind as c, n, latest, total from ({_LONG}) x where part = 'event') on c using sum(n) as n, max(latest) as latest, sum(total) as total group by user_id),
  a as (pivot (select user_id, 'action_' || kind as c, n, latest from ({_LONG}) y where part = 'action') on c using sum(n) as n, max(latest) as latest group by user_id)
  select user_id, coalesce(columns('^(event|action)_.*_n$'), 0)::bigint as "\\0", columns('^(event|action)_.*_latest$'), coalesce(columns('^event_.*_total$'), 0)::double as "\\0" from e full join a using (user_id)"""
