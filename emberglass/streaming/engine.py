"""Rules over a stream of actions, with sinks fed per micro-batch and label state kept as a table of versions."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..lang.lower import Lowered
from ..operators import labels

log = logging.getLogger(__name__)


@dataclass
class Sink:
    """Takes the evaluated rows of a micro-batch. Writing a batch again must have no further effect."""

    name: str
    push: Callable[[DataFrame, int], None]
    wants: Callable[[DataFrame], DataFrame] = field(default=lambda df: df)
    retries: int = 3


def _json(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in ("__effects", "__audit", "__entity_verdicts")]))


def features_json(df: DataFrame) -> DataFrame:
    """Key and the extracted features as JSON, as message consumers take them."""
    return df.select(F.col("__action_id").cast("string").alias("key"), _json(df).alias("value"))


def parquet_sink(path: str) -> Sink:
    """Results by batch and hour of the action; a batch written again replaces itself."""

    def push(df: DataFrame, batch: int) -> None:
        hour = F.date_format(F.to_timestamp("__timestamp"), "yyyy-MM-dd-HH")
        df.withColumn("hour", hour).write.mode("overwrite").partitionBy("hour").parquet(f"{path}/batch={batch}")

    return Sink("parquet", push)


def stored_result_sink(path: str) -> Sink:
    """``(id, extracted_features, error_count, stored_timestamp)``, one row per evaluated row; an id that comes twice is stored twice."""

    def push(df: DataFrame, batch: int) -> None:
        stored = df.select(F.col("__action_id").cast("bigint").alias("id"), _json(df).alias("extracted_features"), F.col("__error_count").alias("error_count"), F.to_timestamp("__timestamp").alias("stored_timestamp"))
        stored.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return Sink("stored_result", push)


def kafka_sink(servers: str, topic: str) -> Sink:
    """Features as messages; needs Spark's Kafka package on the class path."""
    return Sink("kafka", lambda df, _: features_json(df).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save())


def console_sink(rows: int = 20) -> Sink:
    return Sink("console", lambda df, _: df.show(rows, truncate=False))


def csv_sink(path: str) -> Sink:
    """All rows of each micro-batch, nested columns as JSON."""
    flat = lambda df: df.select(*[c if not t.startswith(("array", "struct", "map")) else F.to_json(F.col(f"`{c}`")).alias(c) for c, t in df.dtypes])
    return Sink("csv", lambda df, batch: flat(df).write.mode("overwrite").csv(f"{path}/batch={batch}", header=True))


class LabelTable:
    """Label states as versions of a table: each batch reads the version before it and writes its own, so that repeating one is safe."""

    def __init__(self, path: str):
        self.path = path

    def read(self, spark: SparkSession, before: int) -> DataFrame | None:
        """States as of the last batch before ``before``."""
        for n in range(before - 1, -1, -1):
            try:
                return spark.read.parquet(f"{self.path}/version={n}")
            except Exception as e:  # noqa: BLE001
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        return None

    def sink(self) -> Sink:
        def push(df: DataFrame, batch: int) -> None:
            before = self.read(df.sparkSession, batch)
            labels.fold(labels.mutations_of(df), before).write.mode("overwrite").parquet(f"{self.path}/version={batch}")

        return Sink("labels", push)


def tee(sinks: list[Sink], pause: float = 0.5, longest: float = 5.0) -> Callable[[DataFrame, int], None]:
    """Feeds all sinks from one evaluation; each is tried again with growing pauses, and one that fails doesn't stop the others.

    When every sink has had its turn a failure is raised, so that the stream repeats the batch rather than lose it.
    """

    def push(df: DataFrame, batch: int) -> None:
        df.persist()
        failed: list[Exception] = []
        try:
            for s in sinks:
                for attempt in range(s.retries + 1):
                    try:
                        s.push(s.wants(df), batch)
                        break
                    except Exception as e:  # noqa: BLE001
                        log.warning("sink %s, batch %s, attempt %s: %s", s.name, batch, attempt + 1, e)
                        if attempt == s.retries:
                            failed.append(e)
                        else:
                            time.sleep(min(longest, pause * 2**attempt))
        finally:
            df.unpersist()
        if failed:
            raise failed[0]

    return push


def run(actions: DataFrame, rules: Lowered | Callable[[], Lowered], sinks: list[Sink], checkpoint: str, label_table: LabelTable | None = None, **trigger) -> StreamingQuery:
    """Evaluates a stream of actions and feeds the sinks. A callable for ``rules`` is asked before each batch, so that rules can change."""
    feed = tee([*sinks, *([label_table.sink()] if label_table else [])])

    def batch(df: DataFrame, n: int) -> None:
        now = rules() if callable(rules) else rules
        states = label_table.read(df.sparkSession, n) if label_table else None
        feed(now.evaluate(df, labels=simple_states(states) if states is not None else None), n)

    return actions.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(**(trigger or {"availableNow": True})).start()


def simple_states(states: DataFrame) -> DataFrame:
    """Label states in the form rules read."""
    reason = lambda _, r: F.struct(r["pending"].alias("pending"), r["description"].alias("description"), r["created_at"].alias("created_at"), r["expires_at"].alias("expires_at"))
    return states.select("entity_type", "entity_id", F.transform_values("labels", lambda _, s: F.struct(s["status"].alias("status"), F.transform_values(s["reasons"], reason).alias("reasons"))).alias("labels"))


def classify(spark: SparkSession, rules: Lowered, actions: list[dict], states: DataFrame | None = None) -> list[dict]:
    """Verdicts of a few actions at once, as a synchronous caller wants them: ``{action_id, verdicts, entity_verdicts}`` each.

    An action is ``{action_id, action_name, data, timestamp, secret_data?}`` with data as JSON text or a dict. The list is the caller's
    own and small; for tables use ``Lowered.evaluate``.
    """
    import json

    text = lambda x: x if isinstance(x, str) or x is None else json.dumps(x)
    rows = [(a["action_id"], a["action_name"], a["timestamp"], text(a.get("data")), text(a.get("secret_data"))) for a in actions]
    df = spark.createDataFrame(rows, "action_id bigint, action_name string, timestamp timestamp, data string, secret_data string").coalesce(1)
    got = rules.evaluate(df, labels=states).select("__action_id", "__verdicts", "__entity_verdicts").collect()
    return [{"action_id": r[0], "verdicts": r[1] or [], "entity_verdicts": r[2] or []} for r in got]
