"""Calendar features without leakage: exact-offset lags, rolling windows, baselines, as-of joins, holidays, metrics.

Windows run over an integer day number, so gaps in the calendar need no filling: a frame of
-7 to -1 days holds only the days that exist.  Lags are range frames of one day, which
share the partitioning of the other windows: one shuffle by region (and hour) serves all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import enough, ratio


def with_day(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumn("day", F.datediff(F.col(date), F.lit("1970-01-01").cast("date")))


def frame(keys: list[str], low: int, high: int, order: str = "day"):
    return Window.partitionBy(*keys).orderBy(order).rangeBetween(low, high)


def calendar_lag(value: str, days: int, keys: list[str]) -> Column:
    """The value exactly so many days before (one row a day), NULL where that day is missing."""
    return F.max(value).over(frame(keys, -days, -days))


def rolling(value: str, low: int, high: int, keys: list[str], least: int, how=F.avg) -> Column:
    over = frame(keys, low, high)
    return enough(how(value).over(over), F.count(value).over(over), least)


def complete_days(hourly: DataFrame, code: str = "code", hours: int = 24) -> DataFrame:
    """Per region and day: total, peak and whether all hours have a value; total and peak only if so."""
    days = hourly.groupBy(code, "date").agg(F.count("kw").alias("n"), F.sum("kw").alias("total"), F.max("kw").alias("peak"))
    whole = F.col("n") == hours
    return days.select(code, "date", whole.alias("is_complete"), F.when(whole, F.col("total")).alias("total"), F.when(whole, F.col("peak")).alias("peak"))


def panel_features(hourly: DataFrame, code: str = "code", hours: int = 24) -> DataFrame:
    """Lags, rolling means and ratios of an hourly panel, from days before the row's own only."""
    days = with_day(complete_days(hourly, code, hours))
    per_day = days.select(
        code, "date", "is_complete",
        rolling("total", -7, -1, [code], 3).alias("mean7"),
        rolling("total", -35, -8, [code], 7).alias("mean28"),
        (rolling("total", -28, -1, [code], 7) / hours).alias("level"),
        rolling("peak", -28, -1, [code], 7).alias("peak_level"),
        rolling("peak", -7, -1, [code], 3, F.max).alias("week_peak"),
    ).withColumn("trend", ratio("mean7", "mean28"))
    keys = [code, "hour"]
    rows = with_day(hourly).select(
        code, "date", "hour", "kw", *[calendar_lag("kw", n, keys).alias(f"lag{n}") for n in (1, 2, 7, 14)], rolling("kw", -7, -1, keys, 3).alias("roll7")
    )
    return rows.join(per_day.drop("mean7", "mean28"), [code, "date"], "left")


def baseline(hourly: DataFrame, weeks: int = 4, code: str = "code", hours: int = 24, coming: DataFrame | None = None) -> DataFrame:
    """Median of the same hour on the last so many same weekdays, only where all these days are complete.

    The source days are the row's day minus 7, 14, ... days, so the latest is a week before it.
    Rows are those of ``hourly``, or of ``coming`` (code, date, hour; no load needed): days ahead.
    """
    complete = complete_days(hourly, code, hours).where("is_complete").select(code, "date")
    source = hourly.join(complete, [code, "date"], "left_semi").select(code, "hour", "kw", "date")
    shifted = source.select(code, "hour", "kw", F.explode(F.array(*[F.date_add("date", 7 * w) for w in range(1, weeks + 1)])).alias("date"))
    medians = shifted.groupBy(code, "date", "hour").agg(F.count("kw").alias("n"), F.median("kw").alias("m"))
    medians = medians.where(F.col("n") == weeks).select(code, "date", "hour", F.col("m").alias("baseline_kw"), F.date_sub("date", 7).alias("src_max_date"))
    return (hourly if coming is None else coming).join(medians, [code, "date", "hour"], "left")


def holiday_baseline(hourly: DataFrame, holidays: DataFrame, weeks: int = 4, code: str = "code") -> DataFrame:
    """Median over the last so many holidays of the same type (holidays: date, type); fewer give NULL."""
    small = F.broadcast(holidays.select("date", "type"))
    before = small.alias("t").join(small.alias("p"), F.expr("t.type = p.type and p.date < t.date"))
    order = Window.partitionBy("target").orderBy(F.desc("source"))
    pairs = before.select(F.col("t.date").alias("target"), F.col("p.date").alias("source")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= weeks)
    values = hourly.select(code, "hour", "kw", F.col("date").alias("source")).join(F.broadcast(pairs.select("target", "source")), "source")
    found = values.groupBy(code, "hour", F.col("target").alias("date")).agg(F.count("kw").alias("n"), F.median("kw").alias("baseline_kw"))
    return found.where(F.col("n") == weeks).drop("n")


def living_features(living: DataFrame, code: str = "code") -> DataFrame:
    """Night population a week ago over its mean of the 28 days before that, and the night/day mix then."""
    rows = with_day(living)
    past = calendar_lag("lp_night", 7, [code])
    mean = rolling("lp_night", -35, -8, [code], 7)
    return rows.select(code, "date", ratio(past, mean).alias("lp_ratio"), ratio(past, calendar_lag("lp_day", 7, [code])).alias("lp_mix"))


def level_ratio(series: DataFrame, code: str, mi: str, value: str, r: int) -> DataFrame:
    """Mean of months [i, i + r) over the mean of [i - r, i), NULL unless the latter is positive."""
    after = F.avg(value).over(frame([code], 0, r - 1, mi))
    before = F.avg(value).over(frame([code], -r, -1, mi))
    return series.withColumn("level_ratio", F.when(before > 0, after / before))


def asof_latest(rows: DataFrame, issues: DataFrame, keys: list[str], cutoff: Column, issued: str = "issued_at", value: str = "value", tie: str | None = None) -> DataFrame:
    """For each row the value issued last at or before its cutoff (closed bound); ties by ``tie``, then value.

    Rows and issues of a key and day are sorted together by time, issues first, and each row takes
    the last issue before it in that day, or else the last of the days before, which a second
    window over one row a day carries forward.  No pair of a row and an older issue is made, and a
    key with a large share of all rows is dealt by its days.  Every row comes back, repeated ones
    too; null keys or cutoffs find nothing.
    """
    told = F.struct(F.col(issued).alias("t"), F.col(tie or value).alias("k"), F.col(value).alias("v"))
    asked = rows.select(*keys, cutoff.alias("__at"), F.lit(1).alias("__side"), F.struct(*[F.col(c) for c in rows.columns]).alias("__row"))
    given = issues.where(F.col(issued).isNotNull()).select(*keys, F.col(issued).alias("__at"), told.alias("__told"), F.lit(0).alias("__side"))
    both = asked.unionByName(given, allowMissingColumns=True).withColumn("__day", F.to_date("__at"))
    earlier = Window.partitionBy(*keys).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = both.groupBy(*keys, "__day").agg(F.max("__told").alias("__top")).withColumn("__carried", F.last("__top", ignorenulls=True).over(earlier)).drop("__top")
    today = Window.partitionBy(*keys, "__day").orderBy("__at", "__side", "__told.k", "__told.v").rowsBetween(Window.unboundedPreceding, 0)
    found = both.join(days, [*keys, "__day"], "left").withColumn("__last", F.coalesce(F.last("__told", ignorenulls=True).over(today), "__carried"))
    usable = F.col("__at").isNotNull() & ~F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    return found.where("__side = 1").select("__row.*", F.when(usable, F.col("__last.v")).alias(value), F.when(usable, F.col("__last.t")).alias(issued))


def assert_no_leakage(df: DataFrame, source: str = "src_max_date", target: str = "date") -> None:
    """An error if any source date isn't before its target: one aggregate."""
    bad = df.agg(F.count_if(F.col(source) >= F.col(target))).first()[0]
    if bad:
        raise ValueError(f"{bad} rows use data of their own day or later")


def holiday_types(listed: DataFrame, start: str, end: str) -> DataFrame:
    """date, type of days off: runs of at least 3 days with a listed one are long; neighbours of any listed run, pre_post.

    listed: date.  Days off are listed days and weekends; runs are islands of consecutive days.
    """
    spark = listed.sparkSession
    days = spark.sql(f"select explode(sequence(date'{start}', date'{end}')) as date").join(F.broadcast(listed.select("date").distinct().withColumn("listed", F.lit(True))), "date", "left")
    off = days.where((F.weekday("date") >= 5) | F.col("listed")).withColumn("island", F.expr("date_sub(date, cast(row_number() over (order by date) as int))"))
    over = Window.partitionBy("island")
    runs = off.withColumns({"n": F.count("*").over(over), "any": F.max(F.coalesce("listed", F.lit(False))).over(over), "first": F.min("date").over(over), "last": F.max("date").over(over)})
    kinds = runs.where("n >= 3 and any").select("date", F.lit("long_holiday").alias("type"), F.lit(1).alias("p"))
    kinds = kinds.unionByName(runs.where("listed").select("date", F.lit("holiday").alias("type"), F.lit(2).alias("p")))
    beside = runs.where("n >= 3 and any").select(F.explode(F.array(F.date_sub("first", 1), F.date_add("last", 1))).alias("date")).distinct()
    kinds = kinds.unionByName(beside.select("date", F.lit("pre_post_holiday").alias("type"), F.lit(3).alias("p")))
    return kinds.groupBy("date").agg(F.min_by("type", "p").alias("type"))


# metrics
def pinball(actual: str, quantile: str, tau: float) -> Column:
    d = F.col(actual) - F.col(quantile)
    return F.avg(F.greatest(tau * d, (tau - 1) * d))


def forecast_metrics(pred: DataFrame, code: str = "code") -> DataFrame:
    """Errors over all and by region (NULL code: all), on rows where actual, baseline, yesterday, q50 and q90 exist; none without such rows."""
    full = pred.where("actual_kw is not null and baseline_kw is not null and lag1 is not null and q50 is not null and q90 is not null")
    day = Window.partitionBy(code, "date")
    first_peak = F.row_number().over(day.orderBy(F.desc("actual_kw"), "hour")) == 1
    full = full.withColumns({"grows": F.sum("actual_kw").over(day) > F.sum("baseline_kw").over(day), "is_peak": first_peak})
    mae = lambda c, when=None: F.avg(F.abs(F.col("actual_kw") - F.col(c)) if when is None else F.when(when, F.abs(F.col("actual_kw") - F.col(c))))
    grown = lambda c: F.avg(F.when(F.col("grows"), F.col("actual_kw") - F.col(c)))
    return full.groupingSets([[], [F.col(code)]], F.col(code)).agg(
        F.count("*").alias("n"), mae("lag1").alias("mae_yesterday"), mae("baseline_kw").alias("mae_baseline"), mae("q50").alias("mae_ai"),
        grown("baseline_kw").alias("growth_bias_baseline"), grown("q50").alias("growth_bias_ai"),
        mae("baseline_kw", F.col("is_peak")).alias("peak_mae_baseline"), mae("q50", F.col("is_peak")).alias("peak_mae_ai"),
        F.avg((F.col("actual_kw") <= F.col("q90")).cast("int")).alias("coverage"),
        pinball("actual_kw", "q50", 0.5).alias("pinball50"), pinball("actual_kw", "q90", 0.9).alias("pinball90"),
    )


def ai_improvement(metrics: DataFrame, least_coverage: float = 0.8) -> DataFrame:
    return metrics.withColumn("passes", (F.col("mae_ai") <= F.col("mae_baseline")) & (F.col("coverage") >= least_coverage))


def compare_methods(df: DataFrame, actual: str, methods: list[str], bound: str) -> DataFrame:
    """Mean absolute errors, skill against the first method, coverage of a bound on its own rows."""
    out = df.agg(*[F.avg(F.abs(F.col(actual) - F.col(m))).alias(f"mae_{m}") for m in methods], F.avg((F.col(actual) <= F.col(bound)).cast("int")).alias("coverage"))
    return out.withColumns({f"skill_{m}": 1 - ratio(f"mae_{m}", f"mae_{methods[0]}") for m in methods})


def peak_frame(panel: DataFrame, columns: list[str], code: str = "code", hours: int = 24) -> DataFrame:
    """Daily maxima of columns, only where all hours have a value."""
    return panel.groupBy(code, "date").agg(*[F.when(F.count(c) == hours, F.max(c)).alias(f"{c}_peak") for c in columns])


def conformal_offset(residuals: DataFrame, coverage: float, by: list[str], value: str = "residual") -> DataFrame:
    """The ceil((n + 1) * coverage)-th smallest residual, the largest at most; 0 without any."""
    clean = residuals.where(F.col(value).isNotNull())
    over = Window.partitionBy(*by)
    ranked = clean.withColumns({"__r": F.row_number().over(over.orderBy(value)), "__n": F.count("*").over(over)})
    chosen = ranked.where(F.col("__r") == F.least(F.ceil((F.col("__n") + 1) * coverage), F.col("__n")))
    out = chosen.select(*by, F.col(value).alias("offset"), F.col("__n").alias("n"))
    return residuals.select(*by).distinct().join(out, by, "left").select(*by, F.coalesce("offset", F.lit(0.0)).alias("offset"), F.coalesce("n", F.lit(0)).alias("n"))


def backtest(pred: DataFrame, code: str = "code") -> DataFrame:
    """Per region: evaluated and skipped days, mean error and bias (actual - forecast)."""
    days = pred.groupBy(code, "date").agg(F.count("baseline_kw").alias("b"), F.count("kw").alias("a"), F.avg(F.abs(F.col("kw") - F.col("baseline_kw"))).alias("mae"), F.avg(F.col("kw") - F.col("baseline_kw")).alias("bias"))
    fine = (F.col("b") == 24) & (F.col("a") == 24)
    return days.groupBy(code).agg(F.count_if(fine).alias("n_days"), F.count_if(~fine).alias("n_skipped"), F.avg(F.when(fine, F.col("mae"))).alias("mae"), F.avg(F.when(fine, F.col("bias"))).alias("bias"))


# features beside the panel's own
def district_hours(hourly: DataFrame, digits: int = 5, code: str = "code") -> DataFrame:
    """Hourly sums of districts (leading digits of the code); an hour without a row counts nothing."""
    return hourly.groupBy(F.substring(F.col(code).cast("string"), 1, digits).alias(code), "date", "hour").agg(F.sum("kw").alias("kw"))


def group_mean(panel: DataFrame, value: str, group: str = "group") -> DataFrame:
    """Mean of a value over the regions of a group at the same date and hour, the row's own included."""
    return panel.withColumn(f"group_{value}", F.avg(value).over(Window.partitionBy(group, "date", "hour")))


def temperature_features(weather: DataFrame, places: DataFrame, mode: str, clock: str = "18:00", code: str = "code") -> DataFrame:
    """code, date, hour, temp, issued_at for each hour of the station that a region belongs to.

    weather: station, ts, observed, forecast, issued_at; places: station, code.  Forecast mode takes
    what was issued last by the cutoff of the day before (closed), and what wasn't is no feature;
    observed mode takes the observation and has no issue time.
    """
    if mode == "forecast":
        usable = weather.where(F.col("forecast").isNotNull() & (F.col("issued_at").cast("timestamp") <= issue_cutoff(F.col("ts"), clock)))
        temps = usable.groupBy("station", "ts").agg(F.max_by("forecast", F.struct("issued_at", "forecast")).alias("temp"), F.max("issued_at").alias("issued_at"))
    elif mode == "observed":
        temps = weather.where("observed is not null").groupBy("station", "ts").agg(F.max("observed").alias("temp")).withColumn("issued_at", F.lit(None).cast(dict(weather.dtypes)["issued_at"]))
    else:
        raise ValueError(f"a mode is forecast or observed, not {mode!r}")
    return temps.join(places.select("station", code), "station").select(code, F.to_date("ts").alias("date"), F.hour("ts").alias("hour"), "temp", "issued_at")


def issue_cutoff(ts: Column, clock: str = "18:00") -> Column:
    """Until when a forecast for a time may have been issued: a clock time on the day before."""
    hours, minutes = (int(x) for x in clock.split(":"))
    return F.date_trunc("day", ts.cast("timestamp")) - F.make_dt_interval(F.lit(1), F.lit(-hours), F.lit(-minutes))


def assert_issued_in_time(df: DataFrame, cutoff: Column, issued: str = "issued_at") -> None:
    """An error if any issue lies after its cutoff: one aggregate."""
    bad = df.agg(F.count_if(F.col(issued) > cutoff)).first()[0]
    if bad:
        raise ValueError(f"{bad} issues after their cutoff")
