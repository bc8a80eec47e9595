"""Where actions come from: envelopes of a message stream, JSON lines, tables, and made-up ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import send_time_us

#: Columns of an action.
SCHEMA = "action_id bigint, action_name string, timestamp timestamp, data string, secret_data string"


def from_envelopes(messages: DataFrame) -> DataFrame:
    """Actions of ``messages(value)``, JSON text ``{send_time, data: {action_id, action_name, data, secret_data}}``.

    Messages that are no JSON object, or lack a name, data or a readable send time, are dropped; a missing or unreadable id
    becomes one made from the message's hash, the same on every run.
    """
    v = F.call_function("try_parse_json", F.col("value").cast("string"))
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    sub = lambda path: F.when(F.schema_of_variant(get(path, "variant")).startswith("OBJECT"), F.to_json(get(path, "variant")))
    rows = messages.select(
        F.coalesce(get("$.data.action_id", "string").try_cast("bigint"), F.abs(F.xxhash64("value"))).alias("action_id"), get("$.data.action_name", "string").alias("action_name"),
        F.timestamp_micros(send_time_us(get("$.send_time", "string"))).alias("timestamp"), sub("$.data.data").alias("data"), sub("$.data.secret_data").alias("secret_data"),
    )
    return rows.where("action_name is not null and timestamp is not null and data is not null")


def from_json_lines(lines: DataFrame, now: str = "1970-01-01 00:00:00") -> DataFrame:
    """Actions of ``lines(value)``, one ``{id, name, data, timestamp?}`` each; unreadable lines are dropped."""
    v = F.call_function("try_parse_json", F.col("value"))
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    at = F.coalesce(F.timestamp_micros(send_time_us(get("$.timestamp", "string"))), F.lit(now).cast("timestamp"))
    rows = lines.select(F.coalesce(get("$.id", "bigint"), F.abs(F.xxhash64("value"))).alias("action_id"), get("$.name", "string").alias("action_name"), at.alias("timestamp"), F.to_json(get("$.data", "variant")).alias("data"), F.to_json(get("$.secret_data", "variant")).alias("secret_data"))
    return rows.where("action_name is not null and data is not null")


def synthetic(spark: SparkSession, n: int = 1000, seed: int = 1) -> DataFrame:
    """Made-up actions a minute apart."""
    r = lambda k, m: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(m))
    data = F.to_json(F.struct(F.concat(F.lit("user_"), r(1, 100)).alias("user_id"), F.concat(F.lit("192.168.1."), r(2, 256)).alias("ip_address"), F.lit("create_post").alias("event_type")))
    return spark.range(n).select(F.col("id").alias("action_id"), F.lit("create_post").alias("action_name"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("timestamp"), data.alias("data"), F.lit(None).cast("string").alias("secret_data"))


def _kafka(spark: SparkSession, stream: bool, options: dict) -> DataFrame:
    reader = (spark.readStream if stream else spark.read).format("kafka").options(**{"startingOffsets": "earliest", **options})
    return from_envelopes(reader.load().select(F.col("value").cast("string").alias("value")))


def _lines(spark: SparkSession, stream: bool, options: dict) -> DataFrame:
    return from_json_lines((spark.readStream if stream else spark.read).text(options["path"]))


def _envelopes(spark: SparkSession, stream: bool, options: dict) -> DataFrame:
    return from_envelopes((spark.readStream if stream else spark.read).text(options["path"]))


def _parquet(spark: SparkSession, stream: bool, options: dict) -> DataFrame:
    return (spark.readStream.schema(SCHEMA) if stream else spark.read).parquet(options["path"])


def _synthetic(spark: SparkSession, stream: bool, options: dict) -> DataFrame:
    if stream:
        rate = spark.readStream.format("rate").option("rowsPerSecond", options.get("rows_per_second", 10)).load()
        return rate.select(F.col("value").alias("action_id"), F.lit("create_post").alias("action_name"), "timestamp", F.to_json(F.struct(F.col("value").alias("user_id"))).alias("data"), F.lit(None).cast("string").alias("secret_data"))
    return synthetic(spark, int(options.get("rows", 1000)))


#: Sources by name; add to it to plug in one's own.
SOURCES: dict[str, Callable[[SparkSession, bool, dict], DataFrame]] = {"kafka": _kafka, "json_lines": _lines, "envelopes": _envelopes, "parquet": _parquet, "synthetic": _synthetic}


def read(spark: SparkSession, source: str, stream: bool = False, **options) -> DataFrame:
    """Actions of the named source, as a batch or a stream. ``kafka`` needs Spark's Kafka package on the class path."""
    if source not in SOURCES:
        raise ValueError(f"unknown source {source}; there are {', '.join(sorted(SOURCES))}")
    return SOURCES[source](spark, stream, options)


def sample(actions: DataFrame, rates: dict[str, int]) -> DataFrame:
    """Sampling by action name: 100 (or no rate) keeps all, 0 drops all, and any other rate drops a row when a number drawn from 0 to 99 is below it."""
    rate = F.lit(100)
    for name, r in rates.items():
        rate = F.when(F.col("action_name") == name, F.lit(r)).otherwise(rate)
    drawn = F.floor(F.rand() * 100)
    return actions.where((rate == 100) | ((rate != 0) & (drawn >= rate)))


def skip_marked(actions: DataFrame, mark: str) -> DataFrame:
    """Without the actions whose data hold a true value under ``mark``."""
    return actions.where(F.coalesce(F.get_json_object("data", f"$.{mark}"), F.lit("false")).isin("false", "null", "0", ""))


def entity_ids(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """``(entity_id)`` of an uploaded CSV file: the named column, else the first; empty cells are left out."""
    df = spark.read.csv(path, header=True)
    return df.select(F.btrim(F.col(column or df.columns[0])).alias("entity_id")).where("entity_id <> ''")


def jobs(spark: SparkSession, url: str, queue: str, now: str, **options) -> DataFrame:
    """Jobs of a database table that may be claimed, the longest waiting first; locking is left to the database."""
    table = spark.read.format("jdbc").options(url=url, dbtable=queue, **options).load()
    return table.where(F.col("claim_until").isNull() | (F.col("claim_until") < F.lit(now).cast("timestamp"))).orderBy(F.col("claim_until").asc_nulls_first())
