"""Materialised cuts of a plan that outlive any executor."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Where it names none, one under the warehouse, and only if
    all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tessera_checkpoints").rstrip("/")


def with_ordinals(df: DataFrame, name: str, start: int = 0) -> tuple[DataFrame, int]:
    """df with dense ordinals in its row order, and the first free one. Only a count a partition reaches the driver."""
    marked = cut(df.withColumn("#m", F.monotonically_increasing_id()))
    part = F.shiftright("#m", 33)
    counts = sorted((r.p, r.n) for r in marked.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offsets, at = [], start
    for p, n in counts:
        offsets.append((p, at))
        at += n
    if not offsets:
        return marked.withColumn(name, F.lit(None).cast("bigint")).drop("#m"), start
    firsts = df.sparkSession.createDataFrame(offsets, "`#p` bigint, `#o` bigint")
    within = F.col("#m").bitwiseAND(F.lit((1 << 33) - 1))
    return marked.withColumn("#p", part).join(F.broadcast(firsts), "#p").withColumn(name, F.col("#o") + within).drop("#m", "#p", "#o"), at
