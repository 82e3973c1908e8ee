"""Quantile trees and the two-level forecast."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadweave.operators import quantile_trees as qt
from loadweave.operators import two_level


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(4)
    x, z = rng.uniform(0, 10, 4000), rng.integers(0, 3, 4000)
    y = 20 + 3 * x + (1 + x) * rng.exponential(1.0, 4000) * (z == 1)
    day = [dt.date(2024, 1, 1) + dt.timedelta(days=int(d)) for d in rng.integers(0, 60, 4000)]
    rows = [(float(a), int(b) if b < 2 else None, float(c), d, None) for a, b, c, d in zip(x, z, y, day, strict=True)]
    return spark.createDataFrame(rows, "x double, z int, y double, day date, empty double").repartition(3).cache()


def loss(df, model, tau):
    return df.agg(F.avg(qt.pinball(F.col("y"), model.prediction(), tau))).first()[0]


def test_upper_quantile_beats_a_moved_median(noisy):
    median, upper = qt.fit_many(noisy, "y", ["x", "z", "empty"], [qt.Options(tau=0.5, rounds=8), qt.Options(tau=0.9, rounds=8)])
    held = noisy.withColumns({"m": median.prediction(), "u": upper.prediction()}).cache()
    offset = held.agg(F.percentile(F.col("y") - F.col("m"), 0.9)).first()[0]
    of = lambda c: held.agg(F.avg(qt.pinball(F.col("y"), c, 0.9))).first()[0]
    assert of(F.col("u")) < 0.85 * of(F.col("m") + offset)  # the best there is comes to about 0.6
    assert 0.87 <= held.agg(F.avg((F.col("y") <= F.col("u")).cast("int"))).first()[0] <= 0.93
    assert 0.45 <= held.agg(F.avg((F.col("y") <= F.col("m")).cast("int"))).first()[0] <= 0.6
    assert all(f != 2 for t in upper.trees for f, _, _ in t.splits.values())  # nothing to split on
    # Models that grow together are those that grow alone.
    alone = qt.fit(noisy, "y", ["x", "z", "empty"], 0.9, rounds=2)
    assert [t.splits for t in alone.trees] == [t.splits for t in upper.trees[:3]]


def test_folds_by_day_and_no_rows(noisy, spark):
    early, = qt.fit_many(noisy.withColumn("y", F.when(F.col("day") >= F.lit("2024-02-01").cast("date"), 1e6).otherwise(F.col("y"))), "y", ["x"], [qt.Options(tau=0.9, rounds=3, before=(dt.date(2024, 2, 1) - dt.date(1970, 1, 1)).days)], "day")
    assert noisy.agg(F.max(early.prediction())).first()[0] < 200
    none = qt.fit(noisy.limit(0), "y", ["x", "z"], 0.5, rounds=2)
    assert noisy.select(none.prediction().alias("p")).distinct().collect()[0]["p"] == 0
    few = qt.fit(noisy.limit(5), "y", ["x"], 0.5, rounds=2)
    assert not any(t.splits for t in few.trees)
    chosen = qt.choose(noisy, "y", ["x", "z"], "day", (0.9,), ({"depth": 1, "least": 1900}, {"depth": 3, "least": 20}), folds=2, rounds=4)
    assert chosen[0.9].depth == 3 and chosen[0.9].before is None


def test_a_single_split_is_the_best_one():
    sums, counts = np.zeros((1, 5)), np.array([[4, 10, 10, 10, 10]])
    sums[0] = [-2, -5, -5, 5, 5]
    assert qt._split(sums, counts, 1) == (0, 2, True)
    assert qt._split(sums, counts, 30) is None


@pytest.fixture(scope="module")
def load(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(6):
        size, noise = 5.0 * (k + 1), rng.normal(0, 1, 90)
        for d in range(90):
            date = dt.date(2024, 1, 1) + dt.timedelta(days=d)
            for h in range(24):
                if (k, d, h) == (2, 85, 7):
                    continue
                kw = size * (2 + math.sin(h / 24 * 6.283) + 0.5 * (date.weekday() >= 5) + 0.2 * noise[d] * (h > 16) + 0.05 * rng.normal())
                rows.append((f"1111{k % 2}0{k}", date, h, float(max(kw, 0.0))))
    return spark.createDataFrame(rows, "code string, date date, hour int, kw double").repartition(4).cache()


def test_two_levels_agree(spark, load):
    periods = two_level.Periods("2024-02-29", "2024-03-14", "2024-03-30")
    holidays = spark.createDataFrame([(dt.date(2024, 3, 1), "holiday")], "date date, type string")
    found = two_level.forecast(two_level.hourly_panel(load, holidays), periods, store=lambda df: df.cache(), rounds=4, least=30)
    hours, peaks = found.hours.where("period = 'eval'").cache(), found.peaks.where("period = 'eval'").cache()
    assert hours.where("not (0 <= q50 and q50 <= q90 and q50 <= q90c)").count() == 0 and hours.where("q50 is null").count() < 100
    top = hours.groupBy("code", "date").agg(*[F.max(q).alias(f"h_{q}") for q in ("q50", "q90", "q90c")], F.count("q50").alias("n"))
    both = peaks.join(top, ["code", "date"]).where("n = 24")
    assert both.count() > 60 and both.where("q50 < h_q50 or q90 < h_q90 or q90c < h_q90c or q50 > q90").count() == 0 and both.where("raised > 0").count() > 0
    got = {(r["level"], r["period"], r["scope"]): r for r in found.metrics(load.where("code like '11110%'").select("code")).collect()}
    assert len(got) == 8 and got["hour", "eval", "all"]["mae_ai"] < got["hour", "eval", "all"]["mae_yesterday"]
    assert got["hour", "valid", "all"]["coverage_ai_conformal"] == pytest.approx(0.9, abs=0.02) and got["peak", "eval", "shown"]["n_codes"] == 3
    calib = load.where("date <= date'2024-03-14'").groupBy("code").agg(F.max("kw").alias("calib_peak_kw"))
    risk = two_level.predicted_ratios(peaks, calib).collect()
    assert len(risk) == 6 and all(0.5 < r["ai_peak_ratio_p50"] <= r["ai_peak_ratio"] < 2 for r in risk)
    assert "temp" not in found.fitted["hour"][0.5].features and "baseline_kw_n" in found.fitted["hour"][0.9].features
    with pytest.raises(ValueError, match="training rows"):
        two_level.forecast(two_level.hourly_panel(load.limit(50)), periods)


def test_agreement_of_incomplete_days(spark):
    hours = spark.createDataFrame([("a", 1, h, float(h), 2.0 * h) for h in range(24)] + [("b", 1, h, 9.0, 9.0) for h in range(23)] + [("c", 1, h, 3.0, 4.0) for h in range(24)], "code string, date int, hour int, q50 double, q90 double")
    peaks = spark.createDataFrame([("a", 1, 30.0, 31.0), ("b", 1, 1.0, 2.0), ("c", 1, None, None), ("d", 1, 5.0, 6.0)], "code string, date int, q50 double, q90 double")
    got = {r["code"]: (r["q50"], r["q90"], r["raised"]) for r in two_level.agreed(hours, peaks).collect()}
    assert got == {"a": (30.0, 46.0, 1), "b": (1.0, 2.0, 0), "c": (3.0, 4.0, 0), "d": (5.0, 6.0, 0)}
