"""Panels derived from the base tables, the same in Spark and in SQL.

Prices are integers (cents), so sums are exact and one division gives the same
double in any engine.  ``BASE`` holds the SQL of every frame built here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, symbol, industry, sector."""
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    return joined.select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("symbol"), F.col("n_name").alias("industry"), F.col("r_name").alias("sector"))


def bars(spark: SparkSession, sf_dir: str, along: bool = False) -> DataFrame:
    """Weekly bars per entity: entity_id, d, o, h, l, c, vol; prices in cents.

    ``along``: lines are dealt by entity, so that bars and what follows an entity's
    bars (windows, folds) share one shuffle and one sort; a task then holds all lines of its entities.
    """
    px = F.round(F.col("l_extendedprice") * 100).cast("long")
    key = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "px")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("entity_id"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("d"), px.alias("px"), "l_quantity", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"
    )
    rows = rows.repartition("entity_id") if along else rows
    return rows.groupBy("entity_id", "d").agg(
        F.min_by("px", key).alias("o"), F.max("px").alias("h"), F.min("px").alias("l"), F.max_by("px", key).alias("c"), F.sum("l_quantity").cast("long").alias("vol")
    )


def week_number() -> Column:
    return F.floor(F.datediff("d", F.lit("1990-01-01")) / 7)


def split_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with split_coefficient: 2.0, 0.5 or 1.0 by a rule, null for some entities."""
    k = (F.col("entity_id") * 31 + week_number()) % 97
    coefficient = F.when(F.col("entity_id") % 29 == 3, F.lit(None)).when(k == 0, 2.0).when(k == 48, 0.5).otherwise(1.0)
    return bars(spark, sf_dir).withColumn("split_coefficient", coefficient)


def numbered(df: DataFrame) -> DataFrame:
    """rn: the place of a bar within its entity, from 1."""
    return df.withColumn("rn", F.row_number().over(W.partitionBy("entity_id").orderBy("d")))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse snapshots: every 13th bar from the 5th, eps and shares."""
    return numbered(bars(spark, sf_dir)).where("rn % 13 = 5").select("entity_id", "d", F.col("c").alias("eps"), F.col("vol").alias("shares"))


def thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse thresholds in basis points: every 4th bar from the 2nd."""
    return numbered(bars(spark, sf_dir)).where("rn % 4 = 2").select("entity_id", "d", (200 + F.col("vol") % 50).alias("weak"), (600 + F.col("vol") % 90).alias("strong"))


def exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals in which an entity is out: entity_id, from_d, to_d (null: open), rule."""
    flagged = numbered(bars(spark, sf_dir)).withColumn("hit", F.col("c") < 1_000_000)
    grp = F.sum(F.when(F.col("hit") & ~F.coalesce(F.lag("hit").over(W.partitionBy("entity_id").orderBy("d")), F.lit(False)), 1).otherwise(0)).over(W.partitionBy("entity_id").orderBy("d"))
    last = F.max("d").over(W.partitionBy("entity_id"))
    runs = flagged.withColumn("grp", grp).withColumn("last", last).where("hit").groupBy("entity_id", "grp").agg(F.min("d").alias("from_d"), F.max("d").alias("end_d"), F.max("last").alias("last"))
    return runs.select("entity_id", "from_d", F.when(F.col("end_d") < F.col("last"), F.col("end_d")).alias("to_d"), F.lit("cheap").alias("rule"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions per bar in integer basis points: q10, q50, q90, and a class."""
    w = W.partitionBy("entity_id").orderBy("d")
    q50 = F.floor(10000 * (F.col("c") / F.lag("c").over(w) - 1)).cast("long")
    rows = bars(spark, sf_dir).withColumn("q50", q50).where("q50 is not null")
    rows = rows.withColumn("q50", F.greatest(F.lit(-5000), F.least(F.lit(5000), F.col("q50"))))
    return rows.select("entity_id", "d", (F.col("q50") - 150 - F.col("vol") % 40).alias("q10"), "q50", (F.col("q50") + 150 + F.col("vol") % 60).alias("q90"), (F.col("vol") % 5).cast("int").alias("cls"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Realised return over the next four bars, in basis points: entity_id, d, y."""
    lead = F.lead("c", 4).over(W.partitionBy("entity_id").orderBy("d"))
    return bars(spark, sf_dir).select("entity_id", "d", F.floor(10000 * (lead / F.col("c") - 1)).cast("long").alias("y")).where("y is not null")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternate buys and sells on every 10th bar: entity_id, d, side, shares, price."""
    rows = numbered(bars(spark, sf_dir)).where("rn % 10 = 0")
    return rows.select("entity_id", "d", F.when(F.col("rn") % 20 == 10, "buy").otherwise("sell").alias("side"), (F.col("vol") % 50 + 1).alias("shares"), F.col("c").alias("price"))


BASE = """
dims AS (SELECT s_suppkey AS entity_id, s_name AS symbol, n_name AS industry, r_name AS sector
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
bars AS (SELECT entity_id, d, arg_min(px, k) AS o, max(px) AS h, min(px) AS l, arg_max(px, k) AS c, CAST(sum(q) AS BIGINT) AS vol FROM (
  SELECT l_suppkey AS entity_id, CAST(date_trunc('week', l_shipdate) AS DATE) AS d, l_quantity AS q, CAST(round(l_extendedprice * 100) AS BIGINT) AS px,
    row(l_shipdate, l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS k FROM lineitem) GROUP BY 1, 2),
nbars AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY d) AS rn FROM bars),
split_bars AS (SELECT *, CASE WHEN entity_id % 29 = 3 THEN NULL
  WHEN (entity_id * 31 + CAST(floor(date_diff('day', DATE '1990-01-01', d) / 7) AS BIGINT)) % 97 = 0 THEN 2.0
  WHEN (entity_id * 31 + CAST(floor(date_diff('day', DATE '1990-01-01', d) / 7) AS BIGINT)) % 97 = 48 THEN 0.5 ELSE 1.0 END::DOUBLE AS split_coefficient FROM bars),
snapshots AS (SELECT entity_id, d, c AS eps, vol AS shares FROM nbars WHERE rn % 13 = 5),
thresholds AS (SELECT entity_id, d, 200 + vol % 50 AS weak, 600 + vol % 90 AS strong FROM nbars WHERE rn % 4 = 2),
exclusion_runs AS (SELECT entity_id, d, c < 1000000 AS hit, max(d) OVER (PARTITION BY entity_id) AS last,
  row_number() OVER (PARTITION BY entity_id ORDER BY d) - row_number() OVER (PARTITION BY entity_id, c < 1000000 ORDER BY d) AS grp FROM bars),
exclusions AS (SELECT entity_id, min(d) AS from_d, CASE WHEN max(d) < max(last) THEN max(d) END AS to_d, 'cheap' AS rule FROM exclusion_runs WHERE hit GROUP BY entity_id, grp),
predictions AS (SELECT entity_id, d, q50 - 150 - vol % 40 AS q10, q50, q50 + 150 + vol % 60 AS q90, CAST(vol % 5 AS INTEGER) AS cls FROM (
  SELECT entity_id, d, vol, greatest(-5000, least(5000, CAST(floor(10000 * (c / lag(c) OVER (PARTITION BY entity_id ORDER BY d) - 1)) AS BIGINT))) AS q50,
    lag(c) OVER (PARTITION BY entity_id ORDER BY d) AS pc FROM bars) WHERE pc IS NOT NULL),
outcomes AS (SELECT * FROM (SELECT entity_id, d, CAST(floor(10000 * (lead(c, 4) OVER (PARTITION BY entity_id ORDER BY d) / c - 1)) AS BIGINT) AS y FROM bars) WHERE y IS NOT NULL),
trades AS (SELECT entity_id, d, CASE WHEN rn % 20 = 10 THEN 'buy' ELSE 'sell' END AS side, vol % 50 + 1 AS shares, c AS price FROM nbars WHERE rn % 10 = 0)"""
