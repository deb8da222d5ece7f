"""Interaction and feature tables of the star schema: the engine's inputs as triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.runtime import table


def urm_orders(spark: SparkSession, sf_dir: str, by: str | None = None) -> DataFrame:
    """user_id, item_id, rating (summed quantity), ts (last ship date); unique pairs. by: user_id or item_id, by which they are
    shuffled for what follows; the sums then need no shuffle of their own."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    joined = joined.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), "l_quantity", "l_shipdate")
    joined = joined if by is None else joined.repartition(by)
    return joined.groupBy("user_id", "item_id").agg(F.sum("l_quantity").alias("rating"), F.max("l_shipdate").alias("ts"))


def urm_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, item_id (key k of the event's JSON), rating (number of events), ts (the last)."""
    events = table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").cast("bigint").alias("item_id"), "ts")
    return events.filter("item_id is not null").groupBy("user_id", "item_id").agg(F.count("*").cast("double").alias("rating"), F.max("ts").alias("ts"))


def icm_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, feature (brand_, type_, size_ and name tokens), value 1."""
    part = table(spark, sf_dir, "part")
    tokens = F.concat(
        F.array(F.concat(F.lit("brand_"), "p_brand"), F.concat(F.lit("type_"), "p_type"), F.concat(F.lit("size_"), F.col("p_size").cast("string"))),
        F.transform(F.split("p_name", " "), lambda x: F.concat(F.lit("name_"), x)),
    )
    return part.select(F.col("p_partkey").alias("item_id"), F.explode(F.array_distinct(tokens)).alias("feature")).withColumn("value", F.lit(1.0))


def ucm_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, feature (nation_, segment_, region_), value 1: one-hot demographics."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    hot = F.array(F.concat(F.lit("nation_"), "n_name"), F.concat(F.lit("segment_"), "c_mktsegment"), F.concat(F.lit("region_"), "r_name"))
    return joined.select(F.col("c_custkey").alias("user_id"), F.explode(hot).alias("feature")).withColumn("value", F.lit(1.0))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
