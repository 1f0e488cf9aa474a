"""The star-schema tables as a property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.catalog import Catalog
from tessera.session import GraphSession

NODES = {"Region": ("region", "r_regionkey"), "Nation": ("nation", "n_nationkey"), "Customer": ("customer", "c_custkey"), "Supplier": ("supplier", "s_suppkey"), "Part": ("part", "p_partkey"), "Orders": ("orders", "o_orderkey")}
LEAST_SHARED_ORDERS = 2
TOP_TRADES = 2


def trades(t) -> DataFrame:
    """Revenue from supplier nations to customer nations, the two largest destinations of each source, no loops."""
    line = t("lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    sums = (
        line.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer").select("c_custkey", F.col("c_nationkey").alias("d")), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("supplier").select("s_suppkey", F.col("s_nationkey").alias("s")), F.col("l_suppkey") == F.col("s_suppkey"))
        .where("s <> d")
        .groupBy("s", "d")
        .agg(F.round(F.sum("revenue"), 2).alias("w"))
    )
    top = F.row_number().over(Window.partitionBy("s").orderBy(F.desc("w"), "d"))
    return sums.withColumn("k", top).where(F.col("k") <= TOP_TRADES).select("s", "d", "w")


def copurchased(t) -> DataFrame:
    """Part pairs a < b that share two orders or more."""
    held = t("lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).distinct()
    pairs = held.select("o", F.col("p").alias("a")).join(held.select("o", F.col("p").alias("b")), "o").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= LEAST_SHARED_ORDERS)


def star_graph(spark: SparkSession, sf_dir: str) -> GraphSession:
    """Every node and relationship table, lazily: a query reads the files of those it names. The tables' plans are made
    once a folder and Spark session; each caller gets a graph session of its own over them."""
    g = GraphSession(spark)
    g.catalog = _catalog((spark.sparkContext.applicationId, spark._jsparkSession.sessionUUID()), sf_dir, spark)
    return g


_made: dict[tuple[tuple[str, str], str], Catalog] = {}


def _catalog(session: tuple[str, str], sf_dir: str, spark: SparkSession) -> Catalog:
    if (session, sf_dir) not in _made:
        for old in [k for k in _made if k[0][0] != session[0]]:
            del _made[old]
        _made[session, sf_dir] = _registered(spark, sf_dir).catalog
    return _made[session, sf_dir]


def _registered(spark: SparkSession, sf_dir: str) -> GraphSession:
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    g = GraphSession(spark)
    for label, (table, key) in NODES.items():
        g.register_nodes(label, t(table), key)
    events, turns = t("events"), t("conversations")
    g.register_nodes("Users", events.select("user_id").where("user_id is not null").distinct(), "user_id")
    g.register_nodes("Event", events.select("event_id", "ts", "event_type", "value"), "event_id")
    turn_id = F.col("conv_id") * 100 + F.col("turn")
    g.register_nodes("Turn", turns.select(turn_id.alias("id"), "conv_id", "turn", "role"), "id")
    g.register_rels("IN_REGION", t("nation").select("n_nationkey", "n_regionkey"), "Nation", "Region", "n_nationkey", "n_regionkey")
    g.register_rels("CUST_NATION", t("customer").select("c_custkey", "c_nationkey"), "Customer", "Nation", "c_custkey", "c_nationkey")
    g.register_rels("SUPP_NATION", t("supplier").select("s_suppkey", "s_nationkey"), "Supplier", "Nation", "s_suppkey", "s_nationkey")
    g.register_rels("PLACED", t("orders").select("o_custkey", "o_orderkey"), "Customer", "Orders", "o_custkey", "o_orderkey")
    lines = t("lineitem")
    contains = lines.select("l_orderkey", "l_partkey", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("extendedprice"), F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("returnflag"))
    g.register_rels("CONTAINS", contains, "Orders", "Part", "l_orderkey", "l_partkey")
    g.register_rels("SUPPLIED_BY", lines.select("l_partkey", "l_suppkey").distinct(), "Part", "Supplier", "l_partkey", "l_suppkey")
    g.register_rels("DID", events.select("user_id", "event_id").where("user_id is not null"), "Users", "Event", "user_id", "event_id")
    g.register_rels("TRADES", trades(t), "Nation", "Nation", "s", "d")
    g.register_rels("COPURCHASED", copurchased(t).select("a", "b"), "Part", "Part", "a", "b")
    nxt = turns.select(turn_id.alias("f")).join(turns.select((turn_id - 1).alias("f"), turn_id.alias("n")), "f").where("floor(f / 100) = floor(n / 100)")
    g.register_rels("NEXT_TURN", nxt.select("f", "n"), "Turn", "Turn", "f", "n")
    return g
