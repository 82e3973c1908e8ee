"""Region x month x hour cubes: building, re-keying, profiles, concentration, channel checks, risk by month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import ratio


def hour_cube(df: DataFrame, keys: list[str], kwh: str = "kwh", days: str = "days", customers: str = "cust") -> DataFrame:
    """Sums of energy and days, sum and minimum of customers; one aggregation, partial before the shuffle."""
    return df.groupBy(*keys).agg(F.sum(kwh).alias("kwh"), F.sum(days).alias("n_days"), F.sum(customers).alias("cust_sum"), F.min(customers).alias("cust_min"))


def attach_codes(cube: DataFrame, codes: DataFrame, on: str, code: str = "code") -> DataFrame:
    """The cube by code instead of by name; names without a code go, days take the largest value."""
    keyed = cube.join(codes.select(on, code).where(F.col(code).isNotNull()), on)
    return keyed.groupBy(code, "mi", "hour").agg(F.sum("kwh").alias("kwh"), F.max("n_days").alias("n_days"), F.sum("cust_sum").alias("cust_sum"), F.min("cust_min").alias("cust_min"))


def merge_units(cube: DataFrame, heads: DataFrame, code: str = "code") -> DataFrame:
    """Small units counted with their head (heads: code, head); the least customers of the units add up, as their sums do."""
    moved = cube.join(heads, code, "left").withColumn(code, F.coalesce("head", code)).drop("head")
    return moved.groupBy(code, "mi", "hour").agg(F.sum("kwh").alias("kwh"), F.max("n_days").alias("n_days"), F.sum("cust_sum").alias("cust_sum"), F.sum("cust_min").alias("cust_min"))


def daily_series(cube: DataFrame, code: str = "code") -> DataFrame:
    """Mean energy of a day by region and month; hours without days don't count, none at all is NULL."""
    return cube.groupBy(code, "mi").agg(F.sum(F.when(F.col("n_days") > 0, F.col("kwh") / F.nullif("n_days", F.lit(0)))).alias("daily_kwh"))


def band_shares(cube: DataFrame, bands: dict[str, list[int]], key: str) -> DataFrame:
    """Share of each band of hours in the energy of all bands; absent bands are 0."""
    hours = [F.sum(F.when(F.col("hour").isin(h), F.col("kwh"))).alias(name) for name, h in bands.items()]
    summed = cube.groupBy(key).agg(*hours)
    total = sum((F.coalesce(F.col(n), F.lit(0.0)) for n in bands), F.lit(0.0))
    return summed.select(key, *[F.coalesce(F.col(n) / F.nullif(total, F.lit(0.0)), F.lit(0.0)).alias(n) for n in bands])


def monthly_totals(cube: DataFrame, code: str = "code", allowed: DataFrame | None = None) -> DataFrame:
    """Regions and energy by month; with allowed (code, mi) only those count, but every month stays, as 0."""
    counted = cube if allowed is None else cube.join(allowed, [code, "mi"], "left_semi")
    totals = counted.groupBy("mi").agg(F.countDistinct(code).alias("n_regions"), F.sum("kwh").alias("kwh"))
    if allowed is None:
        return totals
    spine = cube.select("mi").distinct()
    return spine.join(totals, "mi", "left").select("mi", F.coalesce("n_regions", F.lit(0)).alias("n_regions"), F.coalesce("kwh", F.lit(0.0)).alias("kwh"))


def channel_ratio(part: DataFrame, whole: DataFrame, keys: list[str], value: str = "kwh") -> DataFrame:
    """part / whole on shared keys with a positive whole; the channels are never summed."""
    joined = part.select(*keys, F.col(value).alias("part")).join(whole.select(*keys, F.col(value).alias("whole")), keys)
    return joined.where("whole > 0").withColumn("ratio", F.col("part") / F.col("whole"))


def ratio_table(ratios: DataFrame, by: list[str]) -> DataFrame:
    """Count, 10th, 50th, 90th percentiles (linear interpolation) and the share above 1."""
    quantiles = F.percentile("ratio", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = ratios.groupBy(*by).agg(F.count("*").alias("n"), quantiles.alias("q"), F.avg((F.col("ratio") > 1.0001).cast("int")).alias("above"))
    return out.select(*by, "n", F.col("q")[0].alias("p10"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p90"), "above")


def containment(part: DataFrame, whole: DataFrame, keys: list[str], value: str = "kwh") -> DataFrame:
    """One row: share of part's keys found in whole, and share of those not above it (tolerance 1e-4)."""
    joined = part.select(*keys, F.col(value).alias("part")).join(whole.select(*keys, F.col(value).alias("whole")), keys, "left")
    inside = F.when(F.col("whole").isNotNull(), (F.col("part") <= F.col("whole") * 1.0001).cast("int"))
    return joined.agg(F.count("*").alias("n"), F.avg(F.col("whole").isNotNull().cast("int")).alias("matched"), F.avg(inside).alias("not_above"))


def concentration(cube: DataFrame, code: str = "code", period: tuple[int, int] | None = None) -> DataFrame:
    """Peak hour over the sum of the mean day, both, the peak hour (smallest on ties) and the hours present.

    period: first and last month index that count.
    """
    means = (cube if period is None else cube.where(F.col("mi").between(*period))).groupBy(code, "hour").agg(ratio(F.sum("kwh"), F.sum("n_days")).alias("avg_kw"))
    out = means.groupBy(code).agg(
        ratio(F.max("avg_kw"), F.sum("avg_kw")).alias("concentration"),
        F.sum("avg_kw").alias("daily_kwh"),
        F.max("avg_kw").alias("peak_avg_kw"),
        F.max_by("hour", F.struct("avg_kw", -F.col("hour"))).alias("peak_hour"),
        F.count("avg_kw").alias("n_hours"),
    )
    return out


def cut_of(regions: DataFrame, value: str, rule: str | float = "median") -> float | None:
    """Where an axis is cut: at the median, at zero, or at a number."""
    if rule == "median":
        return regions.agg(F.median(value)).first()[0]
    return 0.0 if rule == "zero" else float(rule)


def classify_load(regions: DataFrame, value: str = "concentration", cut: float | None = None) -> DataFrame:
    """'high' strictly above the median (or a given cut), else 'low'; NULL stays NULL."""
    if cut is not None:
        return regions.withColumn("load_type", F.when(F.col(value) > cut, "high").when(F.col(value).isNotNull(), "low"))
    middle = regions.agg(F.median(value).alias("__cut"))  # one row
    flagged = regions.crossJoin(F.broadcast(middle))
    return flagged.withColumn("load_type", F.when(F.col(value) > F.col("__cut"), "high").when(F.col(value).isNotNull(), "low")).drop("__cut")


def quadrants(regions: DataFrame, load: str, effect: str, load_cut: float, effect_cut: float) -> DataFrame:
    """Four labels of two axes; a missing effect leaves the load label alone."""
    high, strong = F.col(load) > load_cut, F.col(effect) > effect_cut
    label = F.when(F.col(load).isNull(), None).when(F.col(effect).isNull(), F.when(high, "high_load").otherwise("low_load"))
    label = label.when(high & strong, "high_load_strong").when(high, "high_load_weak").when(strong, "low_load_strong").otherwise("low_load_weak")
    return regions.withColumn("quadrant", label)


def monthly_risk(cube: DataFrame, multipliers: DataFrame, last: int, eval_months: int = 6, calib_months: int = 12, need: int = 9, low: float = 0.0, code: str = "code") -> DataFrame:
    """Share of evaluation months whose peak exceeds multiplier x the calibration maximum (strictly).

    Peaks are the largest hourly means of a month; windows go by month index, up to ``last``.
    """
    peaks = cube.where("n_days > 0").groupBy(code, "mi").agg(F.max(F.col("kwh") / F.col("n_days")).alias("peak"))
    recent = F.col("mi").between(last - eval_months + 1, last)
    before = F.col("mi").between(last - eval_months - calib_months + 1, last - eval_months)
    calib = peaks.groupBy(code).agg(
        F.max(F.when(before, F.col("peak"))).alias("calib_max"), F.sum(before.cast("int")).alias("n_calib"), F.sum(recent.cast("int")).alias("n_eval"), F.max(F.when(recent, F.col("peak"))).alias("eval_max"),
    )
    evaluated = peaks.where(recent).select(code, "peak")
    grid = calib.crossJoin(F.broadcast(multipliers.select("multiplier")))
    over = grid.join(evaluated, code, "left").groupBy(code, "multiplier", "calib_max", "n_calib", "n_eval", "eval_max")
    over = over.agg(F.avg((F.col("peak") > F.col("multiplier") * F.col("calib_max")).cast("int")).alias("share"))
    status = F.when((F.col("n_calib") < need) | (F.col("n_eval") == 0), "data_missing").when(F.col("calib_max") <= low, "not_assessed_low_load").otherwise("assessed")
    out = over.withColumn("status", status)
    fine = F.col("status") == "assessed"
    return out.select(code, "multiplier", "status", F.when(fine, F.col("share")).alias("surge_risk"), F.when(fine, F.col("eval_max") / F.nullif("calib_max", F.lit(0.0))).alias("peak_ratio_observed"))


def season_coverage(days: DataFrame, date: str = "date", least: int = 28) -> DataFrame:
    """Distinct dates by season and whether they suffice."""
    month = F.month(date)
    season = F.when(month.isin(12, 1, 2), "winter").when(month.isin(3, 4, 5), "spring").when(month.isin(6, 7, 8), "summer").otherwise("autumn")
    return days.groupBy(season.alias("season")).agg(F.countDistinct(date).alias("n_dates")).withColumn("covered", F.col("n_dates") >= least)


def unpivot_hours(wide: DataFrame, ids: list[str], hours: dict[str, int], value: str = "kwh") -> DataFrame:
    """Long hours from columns of hours; two columns for one hour are an error."""
    if len(set(hours.values())) != len(hours) or len(hours) < 2:
        raise ValueError(f"hour columns must be at least two and distinct: {hours}")
    long = wide.select(*ids, *hours).unpivot(ids, list(hours), "hour_column", value)
    number = F.create_map(*[F.lit(x) for pair in hours.items() for x in pair])
    return long.select(*ids, number[F.col("hour_column")].alias("hour"), value).where(F.col(value).isNotNull())


def hours_from_zero(df: DataFrame, hour: str = "hour") -> DataFrame:
    """Hours 1 to 24 become 0 to 23, decided on the whole data; others outside 0 to 23 go."""
    ends = df.agg(F.min(hour).alias("__low"), F.max(hour).alias("__high"))
    shifted = df.crossJoin(F.broadcast(ends)).withColumn(hour, F.col(hour) - F.when((F.col("__high") == 24) & (F.col("__low") >= 1), 1).otherwise(0))
    return shifted.drop("__low", "__high").where(F.col(hour).between(0, 23))


def regions_above(cube_months: DataFrame, code: str = "code", r: int = 3, threshold: float = 1.3) -> DataFrame:
    """Regions with a month whose next r months' mean is at least threshold x the r months before."""
    from .timeseries import level_ratio

    return level_ratio(cube_months, code, "mi", "daily_kwh", r).where(F.col("level_ratio") >= threshold).select(code).distinct()


def small_heads(units: DataFrame, weights: DataFrame, least: float) -> DataFrame:
    """(code, head) of small units within their home district.

    units: code, count; weights: district, code, weight.  A unit's home is the district of its
    largest weight (smaller district on ties).  The head is the largest small unit where the
    small ones reach ``least`` together or no large one exists, else the largest large one; a
    small unit alone without a large one stays.
    """
    order = Window.partitionBy("code").orderBy(F.desc("weight"), "district")
    home = weights.withColumn("__r", F.row_number().over(order)).where("__r = 1").select("code", "district")
    held = units.join(home, "code").withColumn("small", F.col("count") < least)
    per = Window.partitionBy("district")
    held = held.withColumns(
        {
            "n_small": F.sum(F.col("small").cast("int")).over(per),
            "n_big": F.sum((~F.col("small")).cast("int")).over(per),
            "sum_small": F.sum(F.when(F.col("small"), F.col("count"))).over(per),
        }
    )
    # Ties in count go to the smaller code.
    first = lambda small: F.first(F.when(F.col("small") == small, F.col("code")), ignorenulls=True).over(Window.partitionBy("district").orderBy((F.col("small") == small).desc(), F.desc("count"), "code").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    held = held.withColumns({"small_head": first(True), "big_head": first(False)})
    head = F.when((F.col("n_big") == 0) | (F.col("sum_small") >= least), F.col("small_head")).otherwise(F.col("big_head"))
    lone = (F.col("n_small") == 1) & (F.col("n_big") == 0)
    return held.where(F.col("small") & ~lone).select("code", head.alias("head")).where("code <> head")
