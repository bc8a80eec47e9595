"""Query history and saved queries, kept as small append-only tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERY = "id bigint, parent_id bigint, user_email string, query string, start timestamp, end timestamp, dimensions array<string>, sort_order string, at timestamp"
SAVED = "id bigint, query_id bigint, name string, user_email string, at timestamp"


class History:
    """Queries under ``folder``; an entry is written once and never changed, a saved query's latest entry counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, what: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{what}")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    @property
    def queries(self) -> DataFrame:
        return self._read("queries", QUERY)

    def record(self, id: int, user_email: str, query: str, start: datetime, end: datetime, at: datetime, parent_id: int | None = None, dimensions: tuple[str, ...] = (), sort_order: str = "desc") -> None:
        row = [(id, parent_id, user_email, query, start, end, list(dimensions), sort_order, at)]
        self.spark.createDataFrame(row, QUERY).coalesce(1).write.mode("append").parquet(f"{self.folder}/queries")

    def save(self, id: int, query_id: int, name: str, user_email: str, at: datetime) -> None:
        self.spark.createDataFrame([(id, query_id, name, user_email, at)], SAVED).coalesce(1).write.mode("append").parquet(f"{self.folder}/saved")

    def latest(self, user_email: str | None = None, before: int | None = None, limit: int = 100) -> DataFrame:
        """A page of history, newest first; ``before`` is the last id seen."""
        q = self.queries
        q = q.where(F.col("user_email") == user_email) if user_email else q
        q = q.where(F.col("id") < before) if before is not None else q
        return q.orderBy(F.desc("id")).limit(limit)

    def user_emails(self) -> DataFrame:
        return self.queries.select("user_email").where("user_email is not null").distinct().orderBy("user_email")

    def saved(self) -> DataFrame:
        """Saved queries as they stand, with the query of each."""
        now = self._read("saved", SAVED).groupBy("id").agg(F.max_by(F.struct("query_id", "name", "user_email", "at"), F.struct("at", "query_id")).alias("s")).select("id", "s.*")
        return now.join(self.queries.select(F.col("id").alias("query_id"), "query", "start", "end"), "query_id", "left")
