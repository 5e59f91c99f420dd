"""Graphs derived from relational tables. Node ids are ``table:key``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphline.model import PropertyGraph


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(table: str, key: str | Column) -> Column:
    return F.concat(F.lit(table + ":"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def _nodes(rows: DataFrame, table: str, key: str, program: Column, name: Column, source: str | None = None) -> DataFrame:
    return rows.select(_id(table, key).alias("node_id"), program.alias("program"), name.alias("name"), F.lit(source).cast("string").alias("source"))


def _edges(rows: DataFrame, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Distinct edges between (table, key) and (table, key): keys are compared as they are, and become ids afterwards."""
    keys = rows.select(F.col(a[1]).alias("a"), F.col(b[1]).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct()
    return keys.select(_id(a[0], "a").alias("src"), _id(b[0], "b").alias("dst"))


def tiers(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """region -> nation -> customer; customers are candidates, their program is the market segment."""
    region, nation, customer = (_table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    nodes = _nodes(region, "region", "r_regionkey", F.lit("region"), F.col("r_name"))
    nodes = nodes.union(_nodes(nation, "nation", "n_nationkey", F.lit("nation"), F.col("n_name")))
    nodes = nodes.union(_nodes(customer, "customer", "c_custkey", F.col("c_mktsegment"), F.col("c_name"), "DEFAULT"))
    edges = _edges(nation, ("region", "n_regionkey"), ("nation", "n_nationkey")).union(_edges(customer, ("nation", "c_nationkey"), ("customer", "c_custkey")))
    return PropertyGraph.of(nodes, edges, unique=True, program="tiers")


def layered(spark: SparkSession, sf_dir: str, least_quantity: int = 0) -> PropertyGraph:
    """tiers, and customer -> order -> supplier, by lines of at least ``least_quantity``."""
    top = tiers(spark, sf_dir)
    orders, lineitem, supplier = (_table(spark, sf_dir, t) for t in ("orders", "lineitem", "supplier"))
    if least_quantity:
        lineitem = lineitem.where(F.col("l_quantity") >= least_quantity)
    nodes = _nodes(orders, "orders", "o_orderkey", F.lit("orders"), F.lit(None).cast("string")).union(_nodes(supplier, "supplier", "s_suppkey", F.lit("supplier"), F.col("s_name")))
    edges = _edges(orders, ("customer", "o_custkey"), ("orders", "o_orderkey")).union(_edges(lineitem, ("orders", "l_orderkey"), ("supplier", "l_suppkey")))
    more = PropertyGraph.of(nodes, edges, unique=True)
    return PropertyGraph(top.nodes.unionByName(more.nodes), top.edges.unionByName(more.edges), {"program": "layered"})


def bulk(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """layered, by the largest lines alone: some customers and nations lead to some suppliers."""
    return layered(spark, sf_dir, 49)


def parts(spark: SparkSession, sf_dir: str, least_quantity: int = 0) -> PropertyGraph:
    """Parts that follow one another within an order, among lines of at least ``least_quantity``; cyclic, with self-loops. The program is the brand."""
    part, lineitem = _table(spark, sf_dir, "part"), _table(spark, sf_dir, "lineitem")
    if least_quantity:
        lineitem = lineitem.where(F.col("l_quantity") >= least_quantity)
    by_order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    steps = lineitem.select("l_partkey", F.lead("l_partkey").over(by_order).alias("next")).where("next IS NOT NULL")
    return PropertyGraph.of(_nodes(part, "part", "p_partkey", F.col("p_brand"), F.col("p_name"), "DEFAULT"), _edges(steps, ("part", "l_partkey"), ("part", "next")), unique=True, program="parts")


def large_parts(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """parts, by large lines alone: few enough for many components."""
    return parts(spark, sf_dir, 40)


def supplies(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """supplier -> part."""
    part, supplier, lineitem = (_table(spark, sf_dir, t) for t in ("part", "supplier", "lineitem"))
    nodes = _nodes(supplier, "supplier", "s_suppkey", F.lit("supplier"), F.col("s_name")).union(_nodes(part, "part", "p_partkey", F.col("p_brand"), F.col("p_name"), "DEFAULT"))
    return PropertyGraph.of(nodes, _edges(lineitem, ("supplier", "l_suppkey"), ("part", "l_partkey")), unique=True, program="supplies")


def transitions(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Event types that follow one another for a user."""
    events = _table(spark, sf_dir, "events")
    steps = events.select("event_type", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("next")).where("next IS NOT NULL")
    kinds = events.select("event_type").distinct()
    return PropertyGraph.of(_nodes(kinds, "event", "event_type", F.lit("event"), F.col("event_type"), "DEFAULT"), _edges(steps, ("event", "event_type"), ("event", "next")), unique=True, program="transitions")


def links(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """page -> href; the targets are declared by no table, so only pages are nodes."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.expr("""regexp_extract_all(html, 'href="([^"]*)"', 1)""")).alias("href"))
    nodes = _nodes(_table(spark, sf_dir, "pages"), "page", "page_id", F.lit("page"), F.col("url"), "DEFAULT")
    return PropertyGraph.of(nodes, _edges(pages, ("page", "page_id"), ("link", "href")), unique=True, program="links")


GRAPHS: dict[str, Callable[[SparkSession, str], PropertyGraph]] = {g.__name__: g for g in (tiers, layered, bulk, parts, large_parts, supplies, transitions, links)}
