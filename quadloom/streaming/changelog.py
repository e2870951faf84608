"""A stream of changes to a quad table: (txn, ts, user, op, s, p, o, g), op 'add' or 'remove'.

Batches append to a log table, from which ``quadloom.plans.updates.history`` reads the state at any time; counts per predicate
run over windows of event time with a watermark for late changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quadloom.terms import TERM

SCHEMA = f"txn bigint, ts timestamp, user string, op string, s {TERM}, p string, o {TERM}, g string"


def read_changes(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def append_log(changes: DataFrame, log_path: str, checkpoint: str) -> StreamingQuery:
    """Appends every batch to the log once, partitioned by day; available data, then it ends."""
    dated = changes.withColumn("day", F.to_date("ts"))
    return dated.writeStream.format("parquet").option("path", log_path).option("checkpointLocation", checkpoint).partitionBy("day").trigger(availableNow=True).start()


def predicate_rates(changes: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """window, p, n_added, n_removed; windows close when the watermark passes them."""
    rows = changes.withWatermark("ts", late).groupBy(F.window("ts", window), "p")
    return rows.agg(F.count(F.when(F.col("op") == "add", 1)).alias("n_added"), F.count(F.when(F.col("op") == "remove", 1)).alias("n_removed"))
