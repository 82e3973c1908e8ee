"""Growth, weighted splits, typical days and scenario grids."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import years_ahead


def normalized_weights(links: DataFrame, source: str, weight: str = "weight") -> DataFrame:
    """Weights that sum to 1 within a source; a source without any splits equally."""
    per = Window.partitionBy(source)
    any_weight = F.max(F.col(weight)).over(per)
    filled = F.when(any_weight.isNull(), F.lit(1.0)).otherwise(F.coalesce(F.col(weight), F.lit(0.0)))
    out = links.withColumn("__w", filled)
    return out.withColumn(weight, F.col("__w") / F.nullif(F.sum("__w").over(per), F.lit(0.0))).drop("__w")


def split_by_weight(values: DataFrame, links: DataFrame, source: str, target: str, value: str, by: list[str]) -> DataFrame:
    """Values of sources dealt to targets by weight; sources without links drop (see unmapped_share)."""
    return values.join(links, source).groupBy(target, *by).agg(F.sum(F.col(value) * F.col("weight")).alias(value))


def unmapped_share(values: DataFrame, links: DataFrame, source: str, value: str) -> DataFrame:
    lost = values.join(links.select(source).distinct().withColumn("__in", F.lit(True)), source, "left")
    return lost.agg((F.coalesce(F.sum(F.when(F.col("__in").isNull(), F.col(value))), F.lit(0.0)) / F.nullif(F.sum(value), F.lit(0.0))).alias("unmapped_share"))


def growth_rate(history: DataFrame, base: int, months: int = 36, least: float = 30.0, cap: float = 1.0, code: str = "code", value: str = "ev_count") -> DataFrame:
    """Yearly growth to a base month; small or missing bases take the total's growth; capped from above.

    The total counts only codes that are present in the base month.
    """
    now = history.where(F.col("mi") == base).select(code, F.col(value).alias("now"))
    then = history.where(F.col("mi") == base - months).select(code, F.col(value).alias("then"))
    both = now.join(then, code, "left")
    total = both.agg(F.when(F.sum("then") > 0, F.pow(F.sum("now") / F.sum("then"), 12 / months) - 1).alias("total"))
    own = F.when(F.col("then") >= least, F.pow(F.col("now") / F.col("then"), 12 / months) - 1)
    out = both.withColumn("own", own).crossJoin(F.broadcast(total)).withColumn("g", F.coalesce("own", "total"))
    return out.select(code, F.col("now").alias("ev_now"), F.least("g", F.lit(cap)).alias("g"), (F.col("own").isNull() | (F.col("g") > cap)).alias("g_fallback"))


def typical_day(hourly: DataFrame, quantile: float = 0.5, first: int = 17, last: int = 22, code: str = "code") -> DataFrame:
    """The complete weekday of nearest rank ceil(q n) by its evening peak (earlier date on ties): code, date, hour, kw."""
    days = hourly.where(F.weekday("date") < 5).groupBy(code, "date").agg(F.count("kw").alias("n"), F.max(F.when(F.col("hour").between(first, last), F.col("kw"))).alias("peak")).where("n = 24")
    over = Window.partitionBy(code)
    ranked = days.withColumns({"r": F.row_number().over(over.orderBy("peak", "date")), "m": F.count("*").over(over)})
    chosen = ranked.where(F.col("r") == F.greatest(F.lit(1), F.ceil(F.col("m") * quantile))).select(code, "date")
    return hourly.join(chosen, [code, "date"], "left_semi")


def scenario_grid(growth: DataFrame, peaks: DataFrame, base: int, years: list[int], factors: dict[str, float], betas: dict[str, float], code: str = "code") -> DataFrame:
    """Projected EVs and evening peaks by year, scenario and elasticity: code, year, scenario, beta, ev, peak_kw."""
    spark = growth.sparkSession
    cells = [(y, s, float(k), b, float(v), float(years_ahead(base, y))) for y in years for s, k in factors.items() for b, v in betas.items()]
    grid = spark.createDataFrame(cells, "year int, scenario string, k double, beta string, b double, t double")
    rows = growth.join(peaks, code).crossJoin(F.broadcast(grid))
    rows = rows.withColumn("ev", F.col("ev_now") * F.pow(F.greatest(1 + F.col("k") * F.col("g"), F.lit(0.0)), F.col("t")))
    lift = F.when(F.col("ev_now") > 0, F.pow(F.col("ev") / F.nullif("ev_now", F.lit(0.0)), F.col("b")))
    return rows.select(code, "year", "scenario", "beta", "ev", (F.col("peak") * F.coalesce(lift, F.lit(1.0))).alias("peak_kw"))


def scenario_summary(grid: DataFrame, limits: DataFrame, mid: str, high: str, code: str = "code") -> DataFrame:
    """By year, scenario and beta: regions, those over their limit, those over it only in the high scenario, median peak."""
    held = grid.join(limits.select(code, "limit_kw"), code).withColumn("over", F.col("peak_kw") > F.col("limit_kw"))
    middle = held.where(F.col("scenario") == mid).select(code, "year", "beta", F.col("over").alias("mid_over"))
    rows = held.join(middle, [code, "year", "beta"], "left")
    only = (F.col("scenario") == high) & F.col("over") & ~F.coalesce("mid_over", F.lit(False))
    return rows.groupBy("year", "scenario", "beta").agg(F.count("*").alias("n"), F.count_if("over").alias("n_over"), F.count_if(only).alias("n_only_high"), F.median("peak_kw").alias("median_peak"))


def factor_for_goal(growth: list[tuple[float, float]], goal: float, years: float) -> float | None:
    """The factor k >= 0 with sum(ev * max(1 + k g, 0) ** t) = goal, by doubling and bisection; None if impossible."""
    ev, g = (np.array(c, float) for c in zip(*growth, strict=True)) if growth else (np.zeros(0), np.zeros(0))
    total = lambda k: float((ev * np.maximum(1 + k * g, 0) ** years).sum())
    if not len(ev) or total(0.0) > goal:
        return None
    low, high = 0.0, 1.0
    while total(high) < goal:
        high *= 2
        if high > 1e6:
            return None
    while high - low > 1e-9:
        middle = (low + high) / 2
        low, high = (middle, high) if total(middle) < goal else (low, middle)
    return (low + high) / 2


def elasticity(points: DataFrame, draws: int = 200, seed: int = 0, low: float = 0.2, high: float = 2.0) -> DataFrame:
    """Slope of log y on log x with a bootstrap interval; too few points or an implausible interval fall back to 1 (0.8 to 1.2).

    points: x, y, key.  Draws are Poisson weights from a hash of (key, draw), so that they don't depend on partitions.
    """
    rows = points.where("x > 0 and y > 0").select(F.ln("x").alias("lx"), F.ln("y").alias("ly"), "key")
    drawn = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws))))
    u = F.pmod(F.xxhash64("key", "draw", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    cut, weight, p = 0.0, F.lit(0), math.exp(-1)
    for k in range(6):
        cut += p / math.factorial(k)
        weight = weight + (u >= cut).cast("int")
    weight = F.when(F.col("draw") == 0, F.lit(1)).otherwise(weight)
    w = drawn.withColumn("w", weight)
    s = lambda e: F.sum(F.col("w") * e)
    sums = w.groupBy("draw").agg(s(F.lit(1.0)).alias("n"), s(F.col("lx")).alias("sx"), s(F.col("ly")).alias("sy"), s(F.col("lx") * F.col("lx")).alias("sxx"), s(F.col("lx") * F.col("ly")).alias("sxy"))
    slope = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.lit(0.0))
    slopes = sums.select("draw", slope.alias("b"), "n")
    out = slopes.agg(
        F.max(F.when(F.col("draw") == 0, F.col("b"))).alias("beta"), F.percentile(F.when(F.col("draw") > 0, F.col("b")), F.lit(0.025)).alias("beta_low"),
        F.percentile(F.when(F.col("draw") > 0, F.col("b")), F.lit(0.975)).alias("beta_high"), F.max(F.when(F.col("draw") == 0, F.col("n"))).alias("n"),
    )
    fine = (F.col("n") >= 5) & (F.col("beta_low") > 0) & F.col("beta").between(low, high)
    fine = F.coalesce(fine, F.lit(False))
    return out.select(F.coalesce("n", F.lit(0.0)).alias("n"), F.when(fine, F.col("beta")).otherwise(1.0).alias("beta"), F.when(fine, F.col("beta_low")).otherwise(0.8).alias("beta_low"), F.when(fine, F.col("beta_high")).otherwise(1.2).alias("beta_high"), (~fine).alias("fallback"))
