"""Two forecasts of the same load, by hour and by daily peak, made to agree.

Either one learns what a reference (yesterday's value, or else a rolling mean, or the baseline) misses,
in units of the region's own level, by two quantile models (``quantile_trees``), and moves its upper
quantile by the split-conformal offset of the validation days.  A quantile of a day's peak can't lie below
the same quantile of any of its hours, so peaks are raised where hours say more (``agreed``).

All inputs of a day are known the day before (two weeks before the latest, for living population).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import ratio
from . import models, quantile_trees
from . import timeseries as ts

#: Loads that features take in units of the region's level.
LOADS = ("lag1", "lag2", "lag7", "lag14", "roll7", "baseline_kw", "day_total", "day_peak", "week_peak", "reference")
LIVING = ("lp_ratio", "lp_mix")
HOURLY = (*(f"{c}_n" for c in LOADS), "group_lag1_n", "trend", "hour", "dow", "holiday", "temp", *LIVING)
PEAK_LOADS = ("day_peak", "week_peak", "base_peak", "lag7_peak", "day_total", "reference")
PEAK = (*(f"{c}_n" for c in PEAK_LOADS), "group_day_peak_n", "trend", "dow", "holiday", "temp", *LIVING)
HOLIDAY_CODES = {"holiday": 1, "long_holiday": 2, "pre_post_holiday": 3}
#: Share of ranks by which the conformal offset of very many rows may be off.
OFFSET_ACCURACY = 10_000


@dataclass(frozen=True)
class Periods:
    """Training ends, validation ends (both inclusive) and evaluation ends; dates as text."""

    train_to: str
    valid_to: str
    last: str

    def of(self, date: str = "date") -> Column:
        day = F.col(date)
        until = lambda text: day <= F.lit(text).cast("date")
        return F.when(until(self.train_to), "train").when(until(self.valid_to), "valid").when(until(self.last), "eval")


def hourly_panel(hourly: DataFrame, holidays: DataFrame | None = None, temps: DataFrame | None = None, living: DataFrame | None = None, weeks: int = 4, group: Column | None = None, code: str = "code") -> DataFrame:
    """An hourly panel with all inputs, without scaling: those that aren't given are NULL columns.

    holidays: date, type; temps: date, hour, temp (and the code, where it differs by region); living: code, date, lp_ratio, lp_mix.
    """
    days = ts.with_day(ts.complete_days(hourly, code)).select(code, "date", ts.calendar_lag("total", 1, [code]).alias("day_total"), ts.calendar_lag("peak", 1, [code]).alias("day_peak"))
    based = ts.baseline(hourly, weeks, code).select(code, "date", "hour", "baseline_kw")
    out = ts.panel_features(hourly, code).join(days, [code, "date"], "left").join(based, [code, "date", "hour"], "left")
    if holidays is not None:
        own = ts.holiday_baseline(hourly, holidays, weeks, code).withColumnRenamed("baseline_kw", "__h")
        kinds = holidays.groupBy("date").agg(F.min("type").alias("__type"))
        out = out.join(own, [code, "date", "hour"], "left").join(kinds, "date", "left").withColumn("baseline_kw", F.when(F.col("__type").isNotNull(), F.col("__h")).otherwise(F.col("baseline_kw")))
        out = out.withColumn("holiday", F.coalesce(*[F.when(F.col("__type") == k, v) for k, v in HOLIDAY_CODES.items()], F.lit(0))).drop("__h", "__type")
    else:
        out = out.withColumn("holiday", F.lit(0))
    out = out.join(temps, [c for c in (code, "date", "hour") if c in temps.columns], "left") if temps is not None else out.withColumn("temp", F.lit(None).cast("double"))
    out = out.join(living.select(code, "date", *LIVING), [code, "date"], "left") if living is not None else out.withColumns({c: F.lit(None).cast("double") for c in LIVING})
    group = F.substring(F.col(code).cast("string"), 1, 5) if group is None else group
    return out.withColumns({"reference": F.coalesce("lag1", "roll7", "baseline_kw"), "dow": F.weekday("date"), "group": group})


def peak_panel(panel: DataFrame, code: str = "code") -> DataFrame:
    """A day's row of each region: its peaks where all 24 hours have a value, and the day's inputs."""
    whole = lambda c: F.when(F.count(c) == 24, F.max(c))
    same = ["day_peak", "week_peak", "day_total", "peak_level", "trend", "dow", "holiday", "group", *LIVING]
    out = panel.groupBy(code, "date").agg(whole("kw").alias("kw"), whole("baseline_kw").alias("base_peak"), whole("lag7").alias("lag7_peak"), F.max("temp").alias("temp"), *[F.max(c).alias(c) for c in same])
    return out.withColumn("reference", F.coalesce("day_peak", "week_peak", "base_peak"))


def _scaled(rows: DataFrame, periods: Periods, loads: tuple[str, ...], level: str, neighbour: str, keys: list[str], code: str) -> DataFrame:
    held = models.scaled_target(rows, "kw", "reference", level, periods.of() == "train", code)
    held = held.withColumns({f"{c}_n": ratio(F.col(c), "scale") for c in loads})
    means = held.groupBy("group", *keys).agg(F.avg(neighbour).alias(f"group_{neighbour}"))
    return held.join(means, ["group", *keys], "left")


def offset_of(residuals: DataFrame, coverage: float, value: str = "residual") -> float:
    """The residual whose rank is ceil((n + 1) * coverage) of n (the largest at most), 0 without any; a sketch finds it."""
    known = residuals.where(F.col(value).isNotNull() & ~F.isnan(value))
    n = known.count()
    if not n:
        return 0.0
    rank = min(-(-(n + 1) * round(coverage * 10**6) // 10**6), n)
    return float(known.agg(F.percentile_approx(value, rank / n, OFFSET_ACCURACY)).first()[0])


def residual_quantiles(rows: DataFrame, features: tuple[str, ...], periods: Periods, coverage: float = 0.9, store: Callable | None = None, at_least: int = models.LEAST_ROWS, **options) -> tuple[DataFrame, dict[float, quantile_trees.QuantileTrees], float]:
    """rows (with reference, scale and residual_target) with q50, q90 and q90c; the models; the offset in units of the scale.

    0 <= q50 <= q90 and q50 <= q90c; rows without a reference have none of them.
    """
    train = rows.where((periods.of() == "train") & F.col("residual_target").isNotNull())
    if train.limit(at_least).count() < at_least:
        raise ValueError(f"at least {at_least} training rows are needed")
    used = models.usable_features(train, list(features))
    fitted = dict(zip((0.5, 0.9), quantile_trees.fit_many(train, "residual_target", used, [quantile_trees.Options(tau=tau, **options) for tau in (0.5, 0.9)], store=store), strict=True))
    back = lambda q: F.col("reference") + F.col("scale") * fitted[q].prediction()
    out = rows.withColumns({"q50": back(0.5), "q90": back(0.9)})
    # No function of two values here: least and greatest would step over a missing reference.
    out = out.withColumn("q50", F.when(F.col("q50") > 0, F.col("q50")).when(F.col("q50").isNotNull(), F.lit(0.0)))
    out = out.withColumn("q90", F.when(F.col("q90") > F.col("q50"), F.col("q90")).otherwise(F.col("q50")))
    offset = offset_of(out.where(periods.of() == "valid").select(ratio(F.col("kw") - F.col("q90"), "scale").alias("residual")), coverage)
    moved = F.col("q90") + F.lit(offset) * F.col("scale")
    return out.withColumn("q90c", F.when(moved > F.col("q50"), moved).otherwise(F.col("q50"))), fitted, offset


def agreed(hours: DataFrame, peaks: DataFrame, levels: tuple[str, ...] = ("q50", "q90"), code: str = "code", n_hours: int = 24) -> DataFrame:
    """peaks with each quantile raised to the highest of the day's hours, and how many were (``raised``).

    hours: code, date, hour and the levels; peaks: code, date and the levels.  Days whose hours aren't all
    forecast leave the peak as it is; a peak without a forecast of its own takes the hours'; quantiles of a peak
    stay in the order of the levels.
    """
    most = hours.groupBy(code, "date").agg(*[F.when(F.count(q) == n_hours, F.max(q)).alias(f"__{q}") for q in levels])
    out = peaks.join(most, [code, "date"], "left")
    out = out.withColumn("raised", sum((F.coalesce((F.col(f"__{q}") > F.col(q)).cast("int"), F.lit(0)) for q in levels), F.lit(0)))
    for at, q in enumerate(levels):
        below = [F.col(levels[at - 1])] if at else []
        out = out.withColumn(q, F.greatest(q, f"__{q}", *below))
    return out.drop(*[f"__{q}" for q in levels])


def predicted_ratios(peaks: DataFrame, calibration: DataFrame, least_kw: float = 1.0, code: str = "code") -> DataFrame:
    """By region: the highest predicted daily peak over the calibration's (q90 and q50), and the number of days.

    peaks: code, date, q50, q90 of the evaluation days; calibration: code, calib_peak_kw.  Regions whose calibration peak is
    below ``least_kw`` or unknown, and days without both quantiles, are left out.
    """
    held = peaks.where("q50 is not null and q90 is not null").join(calibration.where(F.col("calib_peak_kw") >= least_kw), code)
    tops = held.groupBy(code).agg(F.max("q90").alias("q90"), F.max("q50").alias("q50"), F.max("calib_peak_kw").alias("c"), F.count("*").alias("ai_days"))
    return tops.select(code, (F.col("q90") / F.col("c")).alias("ai_peak_ratio"), (F.col("q50") / F.col("c")).alias("ai_peak_ratio_p50"), "ai_days")


def compared(rows: DataFrame, methods: dict[str, str], covers: dict[str, str], by: list[str], code: str = "code") -> DataFrame:
    """Errors by method on rows that all of them have, skill against the first, and coverage of bounds on their own rows."""
    whole = F.lit(True)
    for c in ("kw", *methods.values()):
        whole = whole & F.col(c).isNotNull()
    first = next(iter(methods))
    out = rows.groupBy(*by).agg(
        F.count_if(whole).alias("n"), F.countDistinct(F.when(whole, F.col(code))).alias("n_codes"), F.countDistinct(F.when(whole, F.col("date"))).alias("n_days"),
        *[F.avg(F.when(whole, F.abs(F.col("kw") - F.col(c)))).alias(f"mae_{name}") for name, c in methods.items()],
        *[F.avg((F.col("kw") <= F.col(c)).cast("int")).alias(f"coverage_{name}") for name, c in covers.items()],
    )
    return out.withColumns({f"skill_{name}": 1 - ratio(f"mae_{name}", f"mae_{first}") for name in methods})


@dataclass
class TwoLevel:
    """What ``forecast`` gives: rows of hours and of peaks with quantiles, offsets, and the models by level."""

    hours: DataFrame
    peaks: DataFrame
    offsets: dict[str, float]
    fitted: dict[str, dict[float, quantile_trees.QuantileTrees]]

    def metrics(self, shown: DataFrame | None = None, code: str = "code") -> DataFrame:
        """Errors by level, period and scope: all regions, and those shown (code), if given."""
        parts = []
        methods = {"hour": {"yesterday": "lag1", "baseline": "baseline_kw", "ai": "q50"}, "peak": {"yesterday": "day_peak", "baseline": "base_peak", "ai": "q50"}}
        for level, rows in (("hour", self.hours), ("peak", self.peaks)):
            for scope, part in (("all", rows), *([("shown", rows.join(shown.select(code).distinct(), code, "left_semi"))] if shown is not None else [])):
                found = compared(part.where("period in ('valid', 'eval')"), methods[level], {"ai": "q90", "ai_conformal": "q90c"}, ["period"], code)
                parts.append(found.select(F.lit(level).alias("level"), F.lit(scope).alias("scope"), *found.columns))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def importance(self, repeats: int = 1) -> DataFrame:
        """Permutation importance of the hourly median's features on the validation days."""
        model = self.fitted["hour"][0.5]
        rows = self.hours.where("period = 'valid' and residual_target is not null")

        class Model:
            @staticmethod
            def transform(df: DataFrame) -> DataFrame:
                return df.withColumn("prediction", model.prediction())

        return models.permutation_importance(Model, rows, "residual_target", model.features, repeats)


def forecast(panel: DataFrame, periods: Periods, coverage: float = 0.9, code: str = "code", store: Callable | None = None, **options) -> TwoLevel:
    """Both levels of forecast over an ``hourly_panel``: quantiles of hours and of peaks, the latter agreed with the former.

    store: keeps a table (its result is read instead), so that panels aren't computed again for each model.
    """
    keep = store or (lambda df: df)
    hours = keep(_scaled(panel, periods, LOADS, "level", "lag1_n", ["date", "hour"], code).withColumn("period", periods.of()))
    hours, fitted, offset = residual_quantiles(hours, HOURLY, periods, coverage, store, **options)
    hours = keep(hours)
    peaks = keep(_scaled(peak_panel(panel, code), periods, PEAK_LOADS, "peak_level", "day_peak_n", ["date"], code).withColumn("period", periods.of()))
    peaks, fitted_peaks, offset_peaks = residual_quantiles(peaks, PEAK, periods, coverage, store, **options)
    peaks = agreed(hours, peaks, ("q50", "q90", "q90c"), code)
    return TwoLevel(hours, keep(peaks), {"hour": offset, "peak": offset_peaks}, {"hour": fitted, "peak": fitted_peaks})


def summed(hours: DataFrame, by: list[str]) -> DataFrame:
    """Sums of actual and forecast loads over regions, on hours that have all of them."""
    columns = ("kw", "lag1", "baseline_kw", "q50")
    whole = hours.where(" and ".join(f"{c} is not null" for c in columns))
    return whole.groupBy(*by, "date", "hour").agg(*[F.sum(c).alias(c) for c in columns])


def district_forecast(hourly: DataFrame, periods: Periods, digits: int = 5, coverage: float = 0.9, store: Callable | None = None, **options) -> DataFrame:
    """Errors of the hourly forecast of districts' sums, and of all of them together, by period."""
    districts = ts.district_hours(hourly, digits)
    keep = store or (lambda df: df)
    panel = hourly_panel(districts, group=F.lit("all"))
    hours = keep(_scaled(panel, periods, LOADS, "level", "lag1_n", ["date", "hour"], "code").withColumn("period", periods.of()))
    hours, _, _ = residual_quantiles(hours, HOURLY, periods, coverage, store, **options)
    methods = {"yesterday": "lag1", "baseline": "baseline_kw", "ai": "q50"}
    rows = hours.where("period in ('valid', 'eval')")
    total = summed(rows, ["period"]).withColumn("code", F.lit("all"))
    return compared(rows, methods, {}, ["period"]).withColumn("unit", F.lit("district")).unionByName(compared(total, methods, {}, ["period"]).withColumn("unit", F.lit("all")))
