"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1]: target share * (1 + slope * (2t - 1)). Integrated
over time it is the source's cumulative token demand D(t) = target * ((1 - slope) * t + slope * t^2); a document whose
first word is the source's x-th gets the position t with D(t) = x. Where D never asks for x there is no such t, and the
mix doesn't take the document. Positions, range-sorted, are the order of training.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

#: Words as the mix counts them: runs of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORDS = r"[^\x20\x09-\x0D]+"
MOST_REPEATS = 3
ROWS_PER_BLOCK = 4000


def slope_of(weight: Column) -> Column:
    """Light sources come early, heavy ones late: slopes -0.5, 0, 0.5 for weights 1, 2, 3."""
    return (weight - 2) * F.lit(0.5)


def demand(t: Column, target: Column, slope: Column) -> Column:
    """Words that a source of this target and slope has been asked for until t: its weight schedule, integrated."""
    return target * ((1 - slope) * t + slope * t * t)


def invert_demand(x: Column, target: Column, slope: Column) -> Column:
    """t in [0, 1) at which a source of this target and slope has been asked for x words; null where it never is."""
    share = F.try_divide(x, target)
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share)
    at = F.when(slope == 0, share).otherwise(F.try_divide(root - (1 - slope), 2 * slope))
    return F.when((x >= 0) & (x < target), at)


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight, target from source, source_size: min(3 * size, level * weight), the level being
    the one at which the targets add up to all words. There is a row a source; sources are a dimension, not data."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    weighed = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", ((F.col("rank") - 1) % 3 + 1).cast("long"))
    capped = weighed.withColumn("cap", MOST_REPEATS * F.col("source_size"))
    everything = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        capped.withColumn("all_words", F.sum("source_size").over(everything))
        .withColumn("all_weights", F.sum("weight").over(everything))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weights_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level_here", (F.col("all_words") - F.col("caps_before")).cast("double") / (F.col("all_weights") - F.col("weights_before")))
        .withColumn("held", F.col("level_here") * F.col("weight") <= F.col("cap"))
        .withColumn("level", F.min_by(F.when(F.col("held"), F.col("level_here")), F.when(F.col("held"), F.struct(F.col("cap") / F.col("weight"), "rank"))).over(everything))
    )
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
    return levels.select("source", "source_size", "weight", target.alias("target"))


def mix_sources(docs: DataFrame, carry: bool = False, slope: Callable[[Column], Column] = slope_of) -> DataFrame:
    """doc_id, source, size, source_size, target, weight, x, passes (array of epoch, take, position, until), and with carry
    `row`, a struct of all columns of docs.

    Documents of a source stand in the order of md5(doc_id), repeated three times at most; x is the number of words in
    front of a document in the first of these passes. In each pass the document's position is the time at which the
    source's schedule asks for its first word, `until` the time at which it asks for what follows its last (1 where
    training ends inside it), and `take` the words that the schedule asks for between them; a pass that is never asked
    for is not there. slope gives a schedule's slope, from -1 to 1, by the source's weight. Null texts have no words; a
    null source is a source, last in order; rows whose doc_ids are equal stand next to each other, by size; a source
    without words gets no target. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORDS)), F.lit(0)).cast("long")
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    rows = scratch.save("rows", docs.select("doc_id", "source", size.alias("size"), order.alias("order"), *row))
    row = ["row"] if carry else []
    digits = max(1, min(8, math.ceil(math.log(max(1, rows.count() / ROWS_PER_BLOCK), 16))))
    rows = rows.withColumn("order", F.coalesce("order", F.lit(""))).withColumn("block", F.substring("order", 1, digits))
    source = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    rows = rows.withColumn("key", source)
    blocks = rows.groupBy("key", "block").agg(F.sum("size").alias("words"))
    targets = source_targets(
        blocks.groupBy("key").agg(F.sum("words").alias("source_size")).select("source_size", F.when(~F.col("key.none"), F.col("key.name")).alias("source"))
    )
    targets = targets.select(F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("key"), "source_size", "weight", "target")
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words").join(targets, "key")
    within = Window.partitionBy("key", "block").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(starts, ["key", "block"]).withColumn("x", F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    asked, steep = F.round("target"), slope(F.col("weight"))

    def one(k: int) -> Column:
        first = F.col("x") + F.lit(k) * F.col("source_size")
        position = invert_demand(first.cast("double"), asked, steep)
        until = F.coalesce(invert_demand((first + F.col("size")).cast("double"), asked, steep), F.lit(1.0))
        take = F.round(demand(until, asked, steep) - demand(position, asked, steep)).cast("long")
        return F.struct(F.lit(k).alias("epoch"), take.alias("take"), position.alias("position"), until.alias("until"))

    passes = F.filter(F.array(*[one(k) for k in range(MOST_REPEATS)]), lambda p: p["position"].isNotNull() & (F.col("size") > 0))
    return placed.select("doc_id", "source", "size", "source_size", "target", "weight", "x", passes.alias("passes"), *row)


def taken(passes: Column) -> Column:
    return F.aggregate(passes, F.lit(0).cast("long"), lambda a, p: a + p["take"])


def training_order(passes: DataFrame, partitions: int, scratch: Scratch) -> DataFrame:
    """passes(position, doc_id, epoch, ...) range-sorted by position, with rank from 0. A range's ranks begin after the
    counts of the ranges before it, so no task sees more than its range."""
    ranged = passes.repartitionByRange(partitions, "position", "doc_id", "epoch").withColumn("range", F.spark_partition_id())
    sorted_ = scratch.save("ranged", ranged)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    first = sorted_.groupBy("range").agg(F.count("*").alias("held")).select("range", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("range").orderBy("position", "doc_id", "epoch")
    return sorted_.join(F.broadcast(first), "range").withColumn("rank", F.col("first") + F.row_number().over(within) - 1).drop("range", "first")


def curriculum(docs: DataFrame, slope: Callable[[Column], Column] = slope_of) -> DataFrame:
    """doc_id, size, source_size, target, taken, n_passes, first_position, last_position, first_rank, last_rank: a row for
    each row of docs. taken adds up the words of its passes in the order of training; positions and ranks (from 0, over
    all passes of all sources) are those of its first and last pass, null where it has none. See mix_sources for nulls,
    ties and repeated rows."""
    scratch = Scratch(docs.sparkSession, "curriculum")
    mixed = scratch.save("mixed", mix_sources(docs, slope=slope))
    same = ["source", "x", "doc_id", "size", "source_size", "target"]
    each = mixed.select(*same, F.explode("passes").alias("pass")).select(*same, "pass.epoch", "pass.take", "pass.position")
    ranked = training_order(each, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), scratch)
    columns = ["doc_id", "size", "source_size", "target"]
    # a document with words is the only one of its source that begins at x
    taken_rows = ranked.groupBy("source", "x").agg(
        *[F.first(c).alias(c) for c in columns],
        F.sum("take").alias("taken"),
        F.count("*").alias("n_passes"),
        F.min("position").alias("first_position"),
        F.max("position").alias("last_position"),
        F.min("rank").alias("first_rank"),
        F.max("rank").alias("last_rank"),
    )
    left = mixed.where(F.size("passes") == 0).select(
        *columns, F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("n_passes"),
        *[F.lit(None).cast("double").alias(c) for c in ("first_position", "last_position")],
        *[F.lit(None).cast("long").alias(c) for c in ("first_rank", "last_rank")],
    )
    return taken_rows.drop("source", "x").unionByName(left)


def in_training_order(docs: DataFrame, partitions: int) -> DataFrame:
    """The rows of docs, once for each pass that the mix takes whole or for its larger part, range-sorted by position."""
    each = mix_sources(docs, carry=True).select("row", "doc_id", "size", F.explode("passes").alias("pass")).where(F.col("pass.take") * 2 >= F.col("size"))
    placed = each.select("row", "doc_id", F.col("pass.position").alias("position"))
    return placed.repartitionByRange(partitions, "position", "doc_id").sortWithinPartitions("position", "doc_id").select("row.*")


#: DuckDB's form of curriculum(): targets by water filling, then schedules, their integrals and inverses, ranks by position.
ORACLE = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
                  md5(doc_id::varchar) as ord from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, ((row_number() over (order by source is null, encode(source)) - 1) % 3 + 1)::bigint as weight,
             row_number() over (order by source is null, encode(source)) as rk, 3 * source_size as cap from s),
l as (select *, (sum(source_size) over () - coalesce(sum(cap) over p, 0))::double
             / (sum(weight) over () - coalesce(sum(weight) over p, 0))::double as level_here
      from w window p as (order by cap::double / weight::double, rk rows between unbounded preceding and 1 preceding)),
v as (select arg_min(level_here, (cap::double / weight::double, rk)) filter (where level_here * weight <= cap) as level from l),
t as (select source, source_size, (weight - 2) * 0.5::double as slope, case when level is null then cap::double else least(cap::double, level * weight) end as target from l, v),
x as (select d.doc_id, d.source, d.size, t.source_size, t.target, round(t.target) as asked, t.slope,
             coalesce(sum(d.size) over (partition by d.source order by ord, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as x
      from d join t on d.source is not distinct from t.source),
p as (select *, (x + epoch * source_size)::double as first, (x + epoch * source_size + size)::double as last
      from x, (values (0), (1), (2)) e(epoch) where size > 0),
q as (select *, case when slope = 0 then first / asked
                     else (sqrt((1 - slope) * (1 - slope) + 4 * slope * (first / asked)) - (1 - slope)) / (2 * slope) end as position,
             case when last >= asked then 1.0::double when slope = 0 then last / asked
                  else (sqrt((1 - slope) * (1 - slope) + 4 * slope * (last / asked)) - (1 - slope)) / (2 * slope) end as until
      from p where first < asked),
r as (select *, row_number() over (order by position, doc_id nulls first, epoch) - 1 as rk,
             round(asked * ((1 - slope) * until + slope * until * until) - asked * ((1 - slope) * position + slope * position * position))::bigint as take
      from q),
g as (select source, x, doc_id, size, sum(take)::bigint as taken, count(*) as n_passes, min(position) as first_position,
             max(position) as last_position, min(rk) as first_rank, max(rk) as last_rank from r group by all)
select x.doc_id, x.size, x.source_size, x.target, coalesce(g.taken, 0)::bigint as taken, coalesce(g.n_passes, 0)::bigint as n_passes,
       g.first_position, g.last_position, g.first_rank, g.last_rank
from x left join g on x.source is not distinct from g.source and x.x = g.x and x.doc_id is not distinct from g.doc_id and x.size = g.size
"""
