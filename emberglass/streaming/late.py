"""Late events in a stream: a table of keyed state that every micro-batch corrects by upsert.

The state has two parts, both in folders by micro-batch so that a batch that is run again replaces only itself: the counts as of
the batch for every key (dataset, window, action) it touched, of which the newest row per key stands, and the ids of the records
taken into windows that are still open, by which a record delivered again in a later batch is known. Records whose window the
watermark of their own arrival has passed are diverted. Every ``COMPACT`` batches the parts are rewritten as one: the newest row
of each key, and only the ids of windows that are still open; a batch reads the newest such base and the parts behind it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lateness import HOUR_US, KEY, LATENESS_US, MEASURES, once, partial_counts, place

STATE = "dataset string, window_start_us bigint, action_name string, n_first bigint, n_late bigint, n_unknown bigint, n_refused bigint, batch_id bigint"
SEEN = "dataset string, record_id string, window_start_us bigint, arrival_us bigint, batch_id bigint"
REFUSED = "dataset string, record_id string, event_us bigint, arrival_us bigint, batch_id bigint"
#: Micro-batches between two rewritings of the state.
COMPACT = 50


def _folders(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of any file system Spark reaches; none where it is not there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def _read(spark: SparkSession, folder: str, part: str, schema: str, before: int | None = None) -> DataFrame:
    """A part of the state as of the start of batch ``before`` (or as it stands): the newest whole base and the batches behind it."""
    numbers = lambda kind: sorted(n for f in _folders(spark, f"{folder}/{part}") if f.startswith(f"{kind}=") and (n := int(f.split("=")[1])) < (1 << 62 if before is None else before))
    whole = [n for n in numbers("base") if "_SUCCESS" in _folders(spark, f"{folder}/{part}/base={n}")]
    base = whole[-1] if whole else -1
    paths = [f"{folder}/{part}/base={base}"] * (base >= 0) + [f"{folder}/{part}/batch={n}" for n in numbers("batch") if n > base]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _newest(states: DataFrame) -> DataFrame:
    newest = states.groupBy(*KEY).agg(F.max(F.struct("batch_id", *MEASURES)).alias("s"))
    return newest.select(*KEY, *[F.col(f"s.{m}").alias(m) for m in MEASURES], F.col("s.batch_id").alias("batch_id"))


def write_batch(records: DataFrame, batch_id: int, folder: str, period_us: int = HOUR_US, lateness_us: int = LATENESS_US) -> None:
    """Takes one micro-batch of ``records(dataset, record_id, action_name, event_us, arrival_us)`` into the state.

    A record id counts once, also if it comes again in a later batch while its window is open; of copies in one batch the earliest
    arrival counts. Records without an id all count. Only the rows of keys the batch touches are written.
    """
    spark = records.sparkSession
    n = F.lit(batch_id).cast("bigint").alias("batch_id")
    seen = _read(spark, folder, "seen", SEEN, batch_id)
    fresh = once(records).join(seen.select("dataset", "record_id").distinct(), ["dataset", "record_id"], "left_anti")
    placed = place(fresh, period_us, lateness_us).persist()
    try:
        added = partial_counts(placed)
        before = _read(spark, folder, "state", STATE, batch_id).join(added.select(*[F.col(k).alias(f"k_{k}") for k in KEY]), [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in KEY], "left_semi")
        both = _newest(before).drop("batch_id").unionByName(added)
        both.groupBy(*KEY).agg(*[F.sum(m).alias(m) for m in MEASURES]).select("*", n).write.mode("overwrite").parquet(f"{folder}/state/batch={batch_id}")
        placed.where("refused").select("dataset", "record_id", "event_us", "arrival_us", n).write.mode("overwrite").parquet(f"{folder}/refused/batch={batch_id}")
        # refused ids too, so that none is reported twice
        placed.where("record_id is not null").select("dataset", "record_id", "window_start_us", "arrival_us", n).write.mode("overwrite").parquet(f"{folder}/seen/batch={batch_id}")
    finally:
        placed.unpersist()
    if batch_id % COMPACT == COMPACT - 1:
        compact(spark, folder, batch_id, period_us, lateness_us)


def compact(spark: SparkSession, folder: str, batch_id: int, period_us: int = HOUR_US, lateness_us: int = LATENESS_US) -> None:
    """Rewrites the state as of the end of a batch as one base, and leaves out ids of windows that the newest watermark has passed twice over.

    A copy of such a record arrives behind the watermark and is refused by it; twice, as arrivals may be out of order.
    """
    _newest(_read(spark, folder, "state", STATE, batch_id + 1)).write.mode("overwrite").parquet(f"{folder}/state/base={batch_id}")
    seen = _read(spark, folder, "seen", SEEN, batch_id + 1)
    newest = seen.agg(F.max("arrival_us")).first()[0]
    still = seen if newest is None else seen.where(F.col("window_start_us") + F.lit(period_us) >= F.lit(newest - 2 * lateness_us))
    still.write.mode("overwrite").parquet(f"{folder}/seen/base={batch_id}")


def run(records: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts the stream over ``records(dataset, record_id, action_name, event_us, arrival_us)``."""
    writer = records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: write_batch(df, n, folder))
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def counts(spark: SparkSession, folder: str) -> DataFrame:
    """``(dataset, window_start_us, action_name, n_first, n_late, n_unknown, n_refused, n_final, last_batch)``: the counts as they stand."""
    now = _newest(_read(spark, folder, "state", STATE)).withColumnRenamed("batch_id", "last_batch")
    return now.withColumn("n_final", F.col("n_first") + F.col("n_late") + F.col("n_unknown"))


def refused(spark: SparkSession, folder: str) -> DataFrame:
    """The refused records, each once."""
    return _read(spark, folder, "refused", REFUSED)
