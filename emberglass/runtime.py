"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    A folder that is set already, or named in ``spark.checkpoint.dir``, is used as it is: on a cluster
    every executor must reach it. Only where neither is set (tests on one machine) a local folder is made.
    """
    jsc = spark.sparkContext._jsc.sc()
    current = jsc.getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "emberglass-checkpoints")
    spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    """Tasks that fit the cluster at once, at least 2."""
    return max(2, spark.sparkContext.defaultParallelism)


def hashed_sample(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """At most ``most`` rows, those of the smallest hashes of the keys; the same rows every time.

    Rows are counted first and thinned out by their hash where they are read, so the tasks pass on little more than the sample
    between them, whatever the size of the table.
    """
    from pyspark.sql import functions as F

    n = df.count()
    span = 1 << 40
    h = F.pmod(F.xxhash64(*keys), F.lit(span))
    thin = df if n <= most else df.where(h < int(span * min(1.0, 1.1 * most / n + 50 / n)))
    return thin.orderBy(h, *keys).limit(most)


def computed(df: DataFrame, **columns) -> DataFrame:
    """The named columns, each computed once per row.

    Filters on a computed column are otherwise moved below it together with its expression, which is then computed for the filter
    and again for the result. A column with a part that is not deterministic (here one that is never reached) stays where it is,
    and unlike behind a generator what its expression uses several times is still computed once. Only the fields the
    expressions use are read.
    """
    from pyspark.sql import functions as F

    kinds = {f.name: f.dataType for f in df.select(*[c.alias(n) for n, c in columns.items()]).schema}
    return df.select(*[F.coalesce(c, F.when(F.spark_partition_id() < 0, F.lit(None).cast(kinds[n]))).alias(n) for n, c in columns.items()])
