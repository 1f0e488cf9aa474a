"""Sharding by longest-processing-time scheduling: equal texts stay together, byte loads come out near equal."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, join_hot, text_key

ROWS_PER_BLOCK = 4000


def lpt(classes: list[tuple[int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """For each (load, count) of `count` groups of one load, the largest load first: (load, how many of them each shard
    gets), by giving every group in turn to the least-loaded shard, ties to the smaller one.

    Groups of one load are alike, so a class is dealt at once: as long as all shards' loads lie within one group of each
    other, a round gives each of them one; only the rest goes through the heap one by one.
    """
    totals, out = [0] * shards, []
    for load, count in sorted(classes, reverse=True):
        given, heap = [0] * shards, [(t, s) for s, t in enumerate(totals)]
        heapq.heapify(heap)
        while count:
            if count >= shards and max(totals) - heap[0][0] < load:
                rounds, count = divmod(count, shards)
                given = [g + rounds for g in given]
                totals = [t + rounds * load for t in totals]
                heap = [(t, s) for s, t in enumerate(totals)]
                heapq.heapify(heap)
                continue
            _, s = heap[0]
            totals[s] += load
            given[s] += 1
            count -= 1
            heapq.heapreplace(heap, (totals[s], s))
        out.append((load, given))
    return out


def ranked(rows: DataFrame, key: str, order: list[str], blocks: int, name: str) -> DataFrame:
    """rows with `name`, gapless from 0 within each key in the order of blocks of hashed rows; a key's rows are numbered
    a block at a time, so no task sorts a whole key."""
    blocked = rows.withColumn("#block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    before = Window.partitionBy(key).orderBy("#block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    first = blocked.groupBy(key, "#block").agg(F.count("*").alias("#held")).select(key, "#block", F.coalesce(F.sum("#held").over(before), F.lit(0)).alias("#first"))
    within = Window.partitionBy(key, "#block").orderBy(*order)
    return blocked.join(first, [key, "#block"]).withColumn(name, F.col("#first") + F.row_number().over(within) - 1).drop("#block", "#first")


def shard_by_lpt(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot.

    Size is the text's UTF-8 bytes plus 1 (null text: 1, in one group with empty texts). Rows with equal texts form
    a group, and every group is scheduled by its own load, largest first, to the least-loaded shard through a heap. The
    driver sees (load, number of groups) classes: loads that differ add up to all bytes at most, so there are fewer than
    sqrt(2 * bytes) of them, whatever the number of groups; which of a class's equal groups go to which shard is decided
    by their rank in the order of hashed texts. slot counts from 0 in each shard without gaps. A null doc_id is a row
    like any other; repeated rows each keep a slot; an empty table gives an empty result. Columns other than doc_id and
    text are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lpt")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = scratch.save(
        "rows",
        docs.select(
            F.col("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            text_key().alias("group"),
        ),
    )
    groups = scratch.save("groups", rows.groupBy("group").agg(F.sum("size").alias("load"), F.count("*").alias("members")))
    classes = [(r.load, r.n) for r in groups.groupBy("load").agg(F.count("*").alias("n")).collect()]
    n = sum(c for _, c in classes)
    dealt = [(load, sum(given), [sum(given[: s + 1]) for s in range(shards)]) for load, given in lpt(classes, shards)]
    bounds = spark.createDataFrame(dealt, "load long, alike long, ends array<long>")
    placed = join_hot(scratch.save("ranked", ranked(groups, "load", ["group"], max(16, n // ROWS_PER_BLOCK), "rank")), bounds, "load", "alike")
    shard = F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard")
    home = scratch.save("home", placed.select("group", "members", shard))
    found = join_hot(rows, home, "group", "members").select("doc_id", "size", "text_crc32", "shard")
    blocks = max(16, groups.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0] // (shards * ROWS_PER_BLOCK))
    return ranked(scratch.save("dealt", found), "shard", ["doc_id", "text_crc32", "size"], blocks, "slot").select(
        "doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot")
    )
