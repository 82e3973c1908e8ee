"""Spatial steps on tables of which very many rows share few spots: work must follow the spots, not pairs of rows."""

import threading

import pytest
from pyspark.sql import functions as F

from loadweave.operators import spatial

MANY = 100_000


@pytest.fixture(autouse=True)
def in_time(spark):
    """Ends jobs that form 1e10 pairs of rows."""
    timer = threading.Timer(90, spark.sparkContext.cancelAllJobs)
    timer.start()
    yield
    timer.cancel()


def places(spark, name):
    """Rows on two spots in turn, about 1.1 km apart."""
    return spark.range(MANY).select(F.col("id").alias(name), (F.lit(37.5) + F.col("id") % 2 * 0.01).alias("lat"), F.lit(127.0).alias("lon"))


def points(spark):
    return places(spark, "code").withColumn("ev", F.lit(2.0))


def stations(spark):
    return places(spark, "station").withColumn("chargers", F.lit(1.0))


def summary(df, *columns):
    return tuple(df.agg(F.count("*"), *[f(c) for c in columns for f in (F.min, F.max)]).first())


def test_catchment_with_slopes(spark):
    high = points(spark).withColumn("elev", F.when(F.col("code") % 3 > 0, 10.0 * (F.col("code") % 3)))
    low = stations(spark).withColumn("elev_station", F.lit(0.0))
    got = spatial.catchment(low, high, 3.0, spatial.slope_distance())
    assert summary(got, "access") == (MANY, pytest.approx(0.5), pytest.approx(0.5))  # all are in reach of all: chargers over EVs


def test_nearest_of_many_places(spark):
    got = spatial.nearest_small(points(spark), stations(spark), "code", "station", 1.0)
    assert summary(got.where("station = code % 2"), "dist_km") == (MANY, 0.0, 0.0)


def test_access_indicators(spark):
    got = spatial.access_indicators(stations(spark), points(spark))
    assert summary(got.where("code > 1"), "chargers", "nearest_km") == (MANY - 2, 0.0, 0.0, 0.0, 0.0)
    assert [tuple(r) for r in got.where("code <= 1").select("chargers", "ev_per_charger").collect()] == [(MANY / 2, 4.0 / MANY)] * 2


def test_bottom_with_ties_orders_few(spark):
    ten = spark.range(10).select(F.col("id").alias("code"), F.when(F.col("id") > 0, F.floor(F.col("id") / 4).cast("double")).alias("v"))
    assert {r["code"] for r in spatial.bottom_with_ties(ten, "v", 0.2).collect()} == {1, 2, 3} == {r["code"] for r in spatial.bottom_with_ties(ten, "v", 0.0).collect()}
    assert spatial.bottom_with_ties(ten, "v", 1.0).count() == 9 and spatial.bottom_with_ties(ten.where("v is null"), "v", 0.5).count() == 0
    each = spark.range(MANY).select(F.col("id").alias("code"), F.pmod(F.xxhash64("id"), F.lit(10**9)).cast("double").alias("v"))
    wanted = sorted(r["v"] for r in each.collect())[: MANY // 10]
    got = spatial.bottom_with_ties(each, "v", 0.1)
    assert sorted(r["v"] for r in got.collect()) == wanted
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[0]  # rows aren't ranked, only values
    access = spatial.catchment(stations(spark), points(spark), 0.5)
    assert summary(spatial.bottom_with_ties(access, "access", 0.1), "access") == (MANY, pytest.approx(0.5), pytest.approx(0.5))


def test_catchment(spark):
    twice = stations(spark).withColumn("station", F.floor(F.col("station") / 2))  # a station with a row on either spot
    assert summary(spatial.catchment(stations(spark), points(spark), 0.5), "access") == (MANY, pytest.approx(0.5), pytest.approx(0.5))
    assert summary(spatial.catchment(twice, points(spark), 0.5), "access") == (MANY, pytest.approx(0.25), pytest.approx(0.25))


def test_nearest_by_rings(spark):
    far = points(spark).withColumn("lat", F.col("lat") + F.when(F.col("code") < 10, 30.0).otherwise(0.0))
    got = spatial.nearest(far, stations(spark), "code", "station")
    assert summary(got.where("code >= 10 and station = code % 2"), "dist_km") == (MANY - 10, 0.0, 0.0)
    assert got.where("code < 10 and station = 1 and dist_km > 3000").count() == 10


def test_pairs_of_one_spot_are_dealt(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        left, right = points(spark).where("code % 2 = 0 and code < 6000"), stations(spark).where("station % 2 = 0 and station < 6000").selectExpr("station", "lat as lat2", "lon as lon2")
        got = spatial.radius_join(left, right, 0.8, 6)
        held = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(held) == 9_000_000 and len(held) > 1 and max(held) < 6_000_000  # one spot, but more than one task
        assert got.columns == ["code", "lat", "lon", "ev", "station", "lat2", "lon2", "dist_km"]
        assert got.select("code", "station").distinct().count() == 9_000_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_tasks_with_many_pairs_are_not_merged(spark):
    left, right = points(spark).where("code % 2 = 0 and code < 6000"), stations(spark).where("station % 2 = 0 and station < 6000").selectExpr("station", "lat as lat2", "lon as lon2")
    held = [r["count"] for r in spatial.radius_join(left, right, 0.8, 6).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == 9_000_000 and len(held) > 1 and max(held) < 6_000_000


def test_share_within_radius(spark):
    odd = stations(spark).where("station % 2 = 1")
    assert spatial.within_radius_share(points(spark), odd, "code", 0.8).first() == (MANY, MANY // 2, 0.5)


def test_added_chargers(spark):
    chosen = points(spark).where("code % 2 = 0").select("code")
    got = spatial.added_chargers(stations(spark).withColumn("station", F.col("station").cast("string")), points(spark), {"chosen": chosen}, 3.0, 0.5)
    held = {tuple(r) for r in got.groupBy("strategy", F.col("code") % 2, F.round("access", 9)).count().collect()}
    assert held == {("before", 0, 0.5, MANY // 2), ("before", 1, 0.5, MANY // 2), ("chosen", 0, 2.0, MANY // 2), ("chosen", 1, 0.5, MANY // 2)}
