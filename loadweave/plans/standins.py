"""The driver's star schema seen as load facts: events are hourly telemetry, orders and lineitems monthly series,
customers demand points and suppliers stations (with coordinates derived from their keys)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly(spark: SparkSession, sf_dir: str, areas: int | None = None) -> DataFrame:
    """code, date, hour, kw: by user, or by user modulo a few areas (mostly complete days)."""
    e = table(spark, sf_dir, "events")
    code = F.col("user_id") if areas is None else F.col("user_id") % areas
    return e.groupBy(code.alias("code"), F.to_date("ts").alias("date"), F.hour("ts").alias("hour")).agg(F.round(F.sum("value"), 4).alias("kw"))


def hourly_sql(areas: int | None = None) -> str:
    code = "user_id" if areas is None else f"user_id % {areas}"
    return f"h AS (SELECT {code} AS code, CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour, round(sum(value), 4) AS kw FROM events GROUP BY 1, 2, 3)"


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code (supplier), mi, hour (line number), kwh, n_days, cust_sum, cust_min of lineitems."""
    items = table(spark, sf_dir, "lineitem")
    return (
        items.groupBy(F.col("l_suppkey").alias("code"), (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).alias("mi"), F.col("l_linenumber").alias("hour"))
        .agg(F.sum("l_quantity").alias("kwh"), F.count("*").alias("n_days"), F.sum("l_tax").alias("cust_sum"), F.min("l_tax").alias("cust_min"))
    )


CUBE_SQL = "c AS (SELECT l_suppkey AS code, CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS INTEGER) AS mi, l_linenumber AS hour, sum(l_quantity) AS kwh, count(*) AS n_days, sum(l_tax) AS cust_sum, min(l_tax) AS cust_min FROM lineitem GROUP BY 1, 2, 3)"


def _lat(key: str):
    return F.lit(37.4) + F.expr(f"cast({key} * 7919 % 1000 as double)") / 4000


def _lon(key: str):
    return F.lit(126.8) + F.expr(f"cast({key} * 104729 % 1000 as double)") / 3000


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("code"), _lat("c_custkey").alias("lat"), _lon("c_custkey").alias("lon"), F.greatest("c_acctbal", F.lit(0.0)).alias("ev"), "c_nationkey")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("station"), _lat("s_suppkey").alias("lat"), _lon("s_suppkey").alias("lon"), (F.col("s_suppkey") % 7 + 1).cast("double").alias("chargers"))


_POS = "37.4::DOUBLE + CAST({k} * 7919 % 1000 AS DOUBLE) / 4000 AS lat, 126.8::DOUBLE + CAST({k} * 104729 % 1000 AS DOUBLE) / 3000 AS lon"
POINTS_SQL = f"p AS (SELECT c_custkey AS code, {_POS.format(k='c_custkey')}, greatest(c_acctbal, 0.0) AS ev, c_nationkey FROM customer)"
STATIONS_SQL = f"s AS (SELECT s_suppkey AS station, {_POS.format(k='s_suppkey')}, CAST(s_suppkey % 7 + 1 AS DOUBLE) AS chargers FROM supplier)"


def km_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"2 * 6371.0088::DOUBLE * asin(sqrt(least(greatest(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2), 0.0), 1.0)))"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """For comparison: doubles rounded, so that the order of additions doesn't show; dates as text."""

    def plain(field):
        kind = field.dataType.typeName()
        column = F.col(field.name)
        return F.round(column, digits).alias(field.name) if kind in ("double", "float") else column.cast("string").alias(field.name) if kind == "date" else column

    return df.select(*map(plain, df.schema.fields))
