"""Numbers within groups, also for groups that hold any share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadloom.runtime import task_slots

#: Least number of salts; larger clusters use as many as they have reduce tasks.
SALTS = 64


def number(df: DataFrame, group: str, by: str, out: str, salts: int | None = None) -> DataFrame:
    """Adds a number from 1 on within each group, gapless, in no stated order but the same in every run for distinct ``by``.

    Rows are counted by group and salt, the counts are summed up along the salts, and rows are numbered within their salt; a
    window never holds more than one salt of one group.
    """
    salts = salts or max(SALTS, task_slots(df.sparkSession))
    rows = df.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    counts = rows.groupBy(group, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    base = counts.select(F.col(group).alias("_g"), F.col("_salt").alias("_s"), (F.sum("_n").over(Window.partitionBy(group).orderBy("_salt")) - F.col("_n")).alias("_base"))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_salt").orderBy(by)))
    joined = ranked.join(base, ranked[group].eqNullSafe(base["_g"]) & (ranked["_salt"] == base["_s"]))
    return joined.withColumn(out, F.col("_base") + F.col("_r")).drop("_salt", "_g", "_s", "_base", "_r")
