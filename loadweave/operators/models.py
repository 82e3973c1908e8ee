"""Learned forecasts and types on MLlib: quantile panels, importance, charge types, heterogeneity checks.

MLlib has no quantile loss.  The median comes from boosted trees with absolute loss; the upper
quantile from that median plus a split-conformal offset per region (``conformal_offset``), so
its coverage is controlled on the calibration days whatever the learner does.
"""

from __future__ import annotations

import re

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import ratio
from ..functions.numbering import numbered
from .timeseries import conformal_offset

LEAST_ROWS = 100
#: Names that tell of load, by which effects must not be explained.
LOAD_NAMES = r"(?i)(집중도|피크|부하|전력|kwh|kw$|_kw|peak|concentration|load)"


def refuse_load_features(names) -> None:
    """An error if a feature of effects is named like a load: the load axis would be explained by itself."""
    found = [n for n in names if re.search(LOAD_NAMES, str(n))]
    if found:
        raise ValueError(f"effects can't be explained by load: {found}")


def refuse_late_snapshots(months, start: int) -> None:
    """An error if a snapshot's month isn't before the window: a feature may not follow what it explains."""
    late = [m for m in months if m >= start]
    if late:
        raise ValueError(f"snapshots in or after the window: {late}")


def usable_features(train: DataFrame, features: list[str]) -> list[str]:
    """Features with any value in the training rows."""
    counts = train.agg(*[F.count(c).alias(c) for c in features]).first()
    return [c for c in features if counts[c]]


def median_model(train: DataFrame, target: str, features: list[str], depth: int = 4, rounds: int = 20, least: int = 1, seed: int = 1):
    """Boosted trees with absolute loss; missing values take the training median."""
    if train.where(F.col(target).isNotNull()).limit(LEAST_ROWS).count() < LEAST_ROWS:
        raise ValueError(f"at least {LEAST_ROWS} training rows are needed")
    kept = usable_features(train, features)
    filled = [f"__{c}" for c in kept]
    stages = [Imputer(strategy="median", inputCols=kept, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features"), GBTRegressor(featuresCol="features", labelCol=target, lossType="absolute", maxDepth=depth, maxIter=rounds, minInstancesPerNode=least, seed=seed)]
    return Pipeline(stages=stages).fit(train.where(F.col(target).isNotNull()).withColumns({c: F.col(c).cast("double") for c in kept}))


def choose_options(train: DataFrame, target: str, features: list[str], date: str, grid: list[dict] | None = None, folds: int = 2, tau: float = 0.5) -> dict:
    """The options of ``median_model`` with the least pinball loss on later blocks of days (expanding window).

    grid: by default two depths, numbers of rounds and leaf sizes each, eight in all.  Blocks are cut at
    quantiles of the day, so no list of days is read; the first of equal options wins.
    """
    grid = grid or [{"depth": d, "rounds": r, "least": n} for d in (3, 5) for r in (10, 20) for n in (1, 20)]
    known = train.where(F.col(target).isNotNull()).withColumns({c: F.col(c).cast("double") for c in features}).withColumn("__day", F.datediff(date, F.lit("1970-01-01").cast("date")))
    cuts = known.agg(F.percentile("__day", F.array(*[F.lit(k / (folds + 1)) for k in range(1, folds + 1)])).alias("q"), F.max("__day").alias("last")).first()
    ends = [*cuts["q"][1:], cuts["last"] + 1]
    losses = []
    for options in grid:
        total = 0.0
        for cut, end in zip(cuts["q"], ends, strict=True):
            model = median_model(known.where(F.col("__day") < cut), target, features, **options)
            block = known.where((F.col("__day") >= cut) & (F.col("__day") < end))
            gap = F.col(target) - F.greatest("prediction", F.lit(0.0))
            total += model.transform(block).agg(F.avg(F.greatest(tau * gap, (tau - 1) * gap))).first()[0] or 0.0
        losses.append(total)
    return grid[min(range(len(grid)), key=lambda i: (losses[i], i))]


def quantile_forecast(panel: DataFrame, features: list[str], train_to: str, calibrate_to: str, code: str = "code", target: str = "kw", coverage: float = 0.9, **options) -> DataFrame:
    """Rows after ``calibrate_to`` with q50 and q90: trained up to one date, calibrated on the days between.

    q50 is never negative and q90 never below q50.
    """
    day = F.col("date")
    model = median_model(panel.where(day <= F.lit(train_to).cast("date")), target, features, **options)
    rest = panel.where(day > F.lit(train_to).cast("date")).withColumns({c: F.col(c).cast("double") for c in features})
    scored = model.transform(rest).withColumn("q50", F.greatest("prediction", F.lit(0.0)))
    residuals = scored.where(day <= F.lit(calibrate_to).cast("date")).select(code, (F.col(target) - F.col("q50")).alias("residual"))
    offsets = conformal_offset(residuals, coverage, [code]).select(code, "offset")
    out = scored.where(day > F.lit(calibrate_to).cast("date")).join(offsets, code, "left")
    return out.select(*panel.columns, "q50", F.greatest("q50", F.col("q50") + F.coalesce("offset", F.lit(0.0))).alias("q90"))


def scaled_target(panel: DataFrame, target: str = "kw", reference: str = "reference", level: str = "level", train=None, code: str = "code") -> DataFrame:
    """(target - reference) / scale, where scale is the level if positive, else the region's training mean, else the overall median of those."""
    means = (panel if train is None else panel.where(train)).groupBy(code).agg(F.avg(target).alias("__mean"))
    overall = means.agg(F.median("__mean").alias("__all"))
    held = panel.join(means, code, "left").crossJoin(F.broadcast(overall))
    scale = F.coalesce(F.when(F.col(level) > 0, F.col(level)), F.when(F.col("__mean") > 0, F.col("__mean")), F.col("__all"))
    return held.withColumns({"scale": scale}).withColumn("residual_target", ratio(F.col(target) - F.col(reference), "scale")).drop("__mean", "__all")


def residual_forecast(panel: DataFrame, features: list[str], train_to: str, calibrate_to: str, code: str = "code", target: str = "kw", reference: str = "reference", level: str = "level", coverage: float = 0.9, **options) -> DataFrame:
    """Rows after ``calibrate_to`` with q50 and q90 of a model of what the reference misses, in units of each region's level.

    The model learns (target - reference) / scale (``scaled_target``), its median comes back to the
    region's own size, and the upper quantile adds the scaled residuals' conformal offset.
    """
    day = F.col("date")
    until = lambda text: F.lit(text).cast("date")
    held = scaled_target(panel, target, reference, level, day <= until(train_to), code)
    model = median_model(held.where(day <= until(train_to)), "residual_target", features, **options)
    rest = held.where(day > until(train_to)).withColumns({c: F.col(c).cast("double") for c in features})
    scored = model.transform(rest).withColumn("q50", F.greatest(F.col(reference) + F.col("prediction") * F.col("scale"), F.lit(0.0)))
    residuals = scored.where(day <= until(calibrate_to)).select(code, ratio(F.col(target) - F.col("q50"), "scale").alias("residual"))
    offsets = conformal_offset(residuals, coverage, [code]).select(code, "offset")
    out = scored.where(day > until(calibrate_to)).join(offsets, code, "left")
    return out.select(*panel.columns, "q50", F.greatest("q50", F.col("q50") + F.coalesce("offset", F.lit(0.0)) * F.col("scale")).alias("q90"))


def permutation_importance(model, rows: DataFrame, target: str, features: list[str], repeats: int = 3) -> DataFrame:
    """Share of the increase in absolute error when a feature's values are dealt anew among rows, negative ones as 0.

    A permutation joins rows on their numbers by two hashes, given slice by slice (``numbered``).
    """
    base = rows.select(target, *[F.col(c).cast("double").alias(c) for c in features])
    error = lambda df: model.transform(df).agg(F.avg(F.abs(F.col("prediction") - F.col(target)))).first()[0]
    before, lines = error(base), []
    for c in features:
        rises = []
        for k in range(repeats):
            own = numbered(base, [target, *features], "__r")
            other = numbered(base, [target, *features], "__r", k + 1).select(F.col(c).alias("__v"), "__r")
            rises.append(error(own.join(other, "__r").withColumn(c, F.col("__v"))) - before)
        lines.append((c, max(sum(rises) / repeats, 0.0)))
    total = sum(v for _, v in lines) or 1.0
    return rows.sparkSession.createDataFrame([(c, v, v / total) for c, v in lines], "feature string, rise double, share double")


def charge_types(hourly: DataFrame, k: int = 4, least_days: int = 14, seed: int = 0, code: str = "code") -> DataFrame:
    """Types of mean daily profiles (shares of the day), numbered by their night share, largest first."""
    full = hourly.groupBy(code, "date").agg(F.count("kw").alias("n")).where("n = 24").select(code, "date")
    enough = full.groupBy(code).agg(F.count("*").alias("n")).where(F.col("n") >= least_days).select(code)
    means = hourly.join(full, [code, "date"], "left_semi").join(enough, code, "left_semi").groupBy(code).pivot("hour", list(range(24))).agg(F.avg("kw"))
    total = sum((F.col(str(h)) for h in range(24)), F.lit(0.0))
    shares = means.select(code, F.array(*[ratio(F.col(str(h)), total) for h in range(24)]).alias("profile"))
    if shares.count() < 3 * k:
        raise ValueError("too few regions for so many types")
    labelled = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="__t").fit(shares.withColumn("features", array_to_vector("profile"))).transform(shares.withColumn("features", array_to_vector("profile")))
    night = sum((F.col("profile")[h] for h in (22, 23, 0, 1, 2, 3, 4, 5)), F.lit(0.0))
    held = labelled.withColumn("night", night)
    order = held.groupBy("__t").agg(F.avg("night").alias("m")).withColumn("type", F.row_number().over(Window.orderBy(F.desc("m"), "__t")))
    peak = F.array_position("profile", F.array_max("profile")) - 1
    return held.join(F.broadcast(order.select("__t", "type")), "__t").select(code, "type", F.round("night", 6).alias("night_share"), peak.cast("int").alias("peak_hour"))


def imputed_features(df: DataFrame, columns: list[str], code: str = "code") -> DataFrame:
    """Missing values by the column's median, with an indicator; a column without any value goes."""
    kept = usable_features(df, columns)
    medians = df.agg(*[F.median(c).alias(f"__{c}") for c in kept])
    held = df.crossJoin(F.broadcast(medians))
    return held.select(code, *[F.coalesce(F.col(c).cast("double"), F.col(f"__{c}")).alias(c) for c in kept], *[F.col(c).isNull().cast("int").alias(f"{c}_missing") for c in kept])


def blp_slope(outcomes: DataFrame, predicted: str) -> DataFrame:
    """Slope of the transformed outcome on a predicted effect with a heteroscedasticity-robust error (folds by hash keep it out of sample).

    outcomes: treated, delta and the prediction; the transformed outcome uses the treated share.
    """
    share = outcomes.agg(F.avg(F.col("treated").cast("int")).alias("p"))
    w = F.col("treated").cast("int")
    y = F.col("delta") * (w - F.col("p")) / F.nullif(F.col("p") * (1 - F.col("p")), F.lit(0.0))
    rows = outcomes.crossJoin(F.broadcast(share)).select(y.alias("y"), F.col(predicted).alias("x")).where("y is not null and x is not null")
    m = rows.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.regr_slope("y", "x").alias("b"), F.count("*").alias("n"))
    held = rows.crossJoin(F.broadcast(m)).withColumns({"dx": F.col("x") - F.col("mx")}).withColumn("e", F.col("y") - F.col("my") - F.col("b") * F.col("dx"))
    sums = held.agg(F.max("b").alias("slope"), F.max("n").alias("n"), F.sum(F.col("dx") ** 2 * F.col("e") ** 2).alias("num"), F.sum(F.col("dx") ** 2).alias("den"))
    return sums.select("slope", F.sqrt(F.col("num") * F.col("n") / (F.col("n") - 2)).alias("__s"), "den", "n").select("slope", (F.col("__s") / F.nullif("den", F.lit(0.0))).alias("se"), "n")


def effect_groups(outcomes: DataFrame, predicted: str, groups: int = 4, tie: str | None = None) -> DataFrame:
    """Treated minus control means by quantile group of a predicted effect (a row a unit), ties in the order of ``tie``."""
    order = Window.orderBy(predicted, *([tie] if tie else []))
    held = outcomes.where(F.col(predicted).isNotNull()).withColumn("group", F.ntile(groups).over(order))
    return held.groupBy("group").agg((F.avg(F.when(F.col("treated"), F.col("delta"))) - F.avg(F.when(~F.col("treated"), F.col("delta")))).alias("effect"), F.count("*").alias("n"))


def stratified_folds(outcomes: DataFrame, folds: int, seed: int = 0, code: str = "code") -> DataFrame:
    """outcomes with fold (from 0): treated and control units are dealt in turn, each in the order of a hash."""
    from functools import reduce

    parts = [numbered(outcomes.where(F.col("treated") == F.lit(t)), [code], "__n", seed).withColumn("fold", (F.col("__n") % folds).cast("int")).drop("__n") for t in (True, False)]
    return reduce(DataFrame.unionByName, parts)


def cross_fitted_effects(outcomes: DataFrame, features: list[str], folds: int = 2, trees: int = 50, depth: int = 4, seed: int = 1, code: str = "code") -> DataFrame:
    """code, treated, delta and predicted: each unit's effect as forests of the other folds predict it, one for the treated and one for the controls.

    Features without any value go, missing values take the median; too few units of a kind outside a
    fold (under 10) leave that fold's predictions NULL.
    """
    held = stratified_folds(outcomes.where("delta is not null"), folds, seed, code)
    filled = imputed_features(held, features, code)
    names = [c for c in filled.columns if c != code]
    rows = held.select(code, "treated", "delta", "fold").join(filled, code)
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows.withColumns({c: F.col(c).cast("double") for c in names})).select(code, "treated", "delta", "fold", "features")
    out = None
    for fold in range(folds):
        rest, own = vectors.where(F.col("fold") != fold), vectors.where(F.col("fold") == fold)
        predicted = own
        for t, name in ((True, "__one"), (False, "__none")):
            kind = rest.where(F.col("treated") == F.lit(t))
            if kind.limit(10).count() < 10:
                predicted = predicted.withColumn(name, F.lit(None).cast("double"))
                continue
            forest = RandomForestRegressor(featuresCol="features", labelCol="delta", predictionCol=name, numTrees=trees, maxDepth=depth, seed=seed).fit(kind)
            predicted = forest.transform(predicted)
        part = predicted.select(code, "treated", "delta", (F.col("__one") - F.col("__none")).alias("predicted"))
        out = part if out is None else out.unionByName(part)
    return out


def heterogeneity(outcomes: DataFrame, features: list[str], groups: int = 4, least_z: float = 1.96, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(effects by unit, calibration slope, effects by group): the unit's effects are NULL where the slope isn't clearly above 0."""
    fitted = cross_fitted_effects(outcomes, features, **options)
    slope = blp_slope(fitted, "predicted").withColumn("reportable", F.coalesce(F.col("slope") / F.nullif("se", F.lit(0.0)) >= least_z, F.lit(False)))
    shown = fitted.crossJoin(F.broadcast(slope.select("reportable"))).withColumn("effect", F.when(F.col("reportable"), F.col("predicted"))).drop("reportable")
    return shown, slope, effect_groups(fitted, "predicted", groups)
