"""Surge alerts, axis scores, priority ranking and its sensitivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import average_rank, minmax_score, percentile_score, ratio


def day_peaks(pred: DataFrame, code: str = "code") -> DataFrame:
    """Daily peaks: the forecast's skips missing hours, baseline and actual need every row's hour."""
    whole = lambda c: F.when(F.count(c) == F.count("*"), F.max(c))
    return pred.groupBy(code, "date").agg(F.max("q90").alias("ai_peak"), whole("baseline_kw").alias("base_peak"), whole("actual_kw").alias("actual_peak"))


def surge_risk(peaks: DataFrame, calib: DataFrame, multipliers: DataFrame, least: float = 1.0, code: str = "code") -> DataFrame:
    """Per region and multiplier: share of all days with an alert (strictly above), and precision and recall on common days."""
    grid = peaks.join(calib.select(code, "calib_peak_kw"), code, "left").crossJoin(F.broadcast(multipliers.select("multiplier")))
    target = F.col("calib_peak_kw") * F.col("multiplier")
    over = lambda c: F.coalesce(F.col(c) > target, F.lit(False))
    common = F.col("ai_peak").isNotNull() & F.col("base_peak").isNotNull() & F.col("actual_peak").isNotNull()
    counts = {"n_eval_days": F.count("*"), "surge": F.avg(over("ai_peak").cast("int")), "mean_q90_peak": F.avg("ai_peak"), "n_common_days": F.count_if(common)}
    for name in ("ai", "base"):
        alert = over(f"{name}_peak") & common
        counts |= {f"tp_{name}": F.count_if(alert & over("actual_peak")), f"alerts_{name}": F.count_if(alert)}
    counts["actual_days"] = F.count_if(over("actual_peak") & common)
    out = grid.groupBy(code, "multiplier", "calib_peak_kw").agg(*[c.alias(n) for n, c in counts.items()])
    fine = F.coalesce(F.col("calib_peak_kw") >= least, F.lit(False))
    values = {
        "surge_risk": F.col("surge"), "mean_q90_peak_ratio": ratio("mean_q90_peak", "calib_peak_kw"),
        **{f"precision_{n}": ratio(F.col(f"tp_{n}").cast("double"), F.col(f"alerts_{n}").cast("double")) for n in ("ai", "base")},
        **{f"recall_{n}": ratio(F.col(f"tp_{n}").cast("double"), F.col("actual_days").cast("double")) for n in ("ai", "base")},
        **{n: F.col(n) for n in ("n_common_days", "tp_ai", "alerts_ai", "tp_base", "alerts_base", "actual_days")},
    }
    return out.select(code, "multiplier", F.when(fine, "assessed").otherwise("not_assessed_low_load").alias("status"), "n_eval_days", *[F.when(fine, v).alias(n) for n, v in values.items()])


def risk_summary(risk: DataFrame) -> DataFrame:
    """By multiplier over assessed regions: mean risk, micro precision and recall."""
    sums = risk.where("status = 'assessed'").groupBy("multiplier").agg(F.count("*").alias("n_regions"), F.avg("surge_risk").alias("surge_risk"), *[F.sum(c).alias(c) for c in ("tp_ai", "alerts_ai", "tp_base", "alerts_base", "actual_days")])
    d = lambda c: F.col(c).cast("double")
    return sums.select("multiplier", "n_regions", "surge_risk", *[ratio(d(f"tp_{n}"), d(f"alerts_{n}")).alias(f"precision_{n}") for n in ("ai", "base")], *[ratio(d(f"tp_{n}"), d("actual_days")).alias(f"recall_{n}") for n in ("ai", "base")])


def alert_table(peaks: DataFrame, calib: DataFrame, multipliers: DataFrame, methods: dict[str, str], least: float = 1.0, code: str = "code") -> DataFrame:
    """Alerts, hits, precision and recall by multiplier and method, on rows where every method and the actual exist."""
    rows = peaks.join(calib.select(code, "calib_peak_kw"), code).where(F.col("calib_peak_kw") >= least)
    rows = rows.dropna(subset=["actual_peak", *methods.values()]).crossJoin(F.broadcast(multipliers.select("multiplier")))
    cases = F.explode(F.array(*[F.struct(F.lit(n).alias("method"), F.col(c).alias("value")) for n, c in methods.items()]))
    target = F.col("calib_peak_kw") * F.col("multiplier")
    long = rows.select("multiplier", (F.col("actual_peak") > target).alias("act"), target.alias("target"), cases.alias("m"))
    alert = F.col("m.value") > F.col("target")
    out = long.groupBy("multiplier", F.col("m.method").alias("method")).agg(F.count("*").alias("n_days"), F.count_if("act").alias("n_actual"), F.count_if(alert).alias("n_alerts"), F.count_if(alert & F.col("act")).alias("n_hits"))
    d = lambda c: F.col(c).cast("double")
    return out.withColumns({"precision": ratio(d("n_hits"), d("n_alerts")), "recall": ratio(d("n_hits"), d("n_actual"))})


def added_load_risk(pred: DataFrame, calib: DataFrame, multipliers: DataFrame, added: DataFrame, code: str = "code") -> DataFrame:
    """Share of days whose forecast plus an assumed load (n_new, hour, delta_kw) exceeds the target."""
    loaded = pred.join(F.broadcast(added), "hour").groupBy(code, "date", "n_new").agg(F.max(F.col("q90") + F.col("delta_kw")).alias("peak"))
    grid = loaded.join(calib.select(code, "calib_peak_kw"), code).crossJoin(F.broadcast(multipliers.select("multiplier")))
    return grid.groupBy(code, "multiplier", "n_new").agg(F.avg(F.coalesce(F.col("peak") > F.col("calib_peak_kw") * F.col("multiplier"), F.lit(False)).cast("int")).alias("surge_risk_with_new"))


def two_axes(risk: DataFrame, access: DataFrame, w_risk: Column, metric: str, min_axes: int = 2, scale: str = "percentile", partition: list[str] | None = None, code: str = "code") -> DataFrame:
    """Full outer combination of a risk and an access axis, re-weighted over the axes that exist.

    risk: code, status and the metric; access: code, access.  A missing axis is no zero.
    """
    keys = [code, *(partition or [])]
    df = risk.join(access, keys, "full_outer")
    raw = F.when(F.col("status") == "assessed", F.col(metric))
    df = df.withColumn("risk_raw", raw)
    part = partition or []
    if scale == "percentile":
        scored = {"risk_norm": percentile_score("risk_raw", part), "equity_norm": percentile_score("access", part, reverse=True)}
    else:
        scored = {"risk_norm": minmax_score("risk_raw", part), "equity_norm": 1 - minmax_score("access", part)}
    df = df.withColumns(scored)
    w_equity = 1 - w_risk
    have_r, have_e = F.col("risk_norm").isNotNull(), F.col("equity_norm").isNotNull()
    weight = F.when(have_r, w_risk).otherwise(0.0) + F.when(have_e, w_equity).otherwise(0.0)
    total = F.coalesce(F.col("risk_norm") * w_risk, F.lit(0.0)) + F.coalesce(F.col("equity_norm") * w_equity, F.lit(0.0))
    present = have_r.cast("int") + have_e.cast("int")
    reason = F.when(have_r & have_e, "").otherwise("data_missing")
    reason = F.when(~have_r & F.coalesce(F.col("status") == "not_assessed_low_load", F.lit(False)), "not_assessed_low_load").otherwise(reason)
    df = df.withColumns({"score": F.when(weight > 0, total / F.nullif(weight, F.lit(0.0))), "axes_present": present, "missing_reason": reason})
    df = df.withColumn("missing_axes", F.concat_ws(",", F.when(~have_r, F.lit("risk")), F.when(~have_e, F.lit("equity"))))
    return df.withColumn("eligible", (F.col("axes_present") >= min_axes) & F.col("score").isNotNull())


def ranked(df: DataFrame, code: str = "code") -> DataFrame:
    """Rank of the eligible, best score first, smaller code on ties; NULL for the others."""
    order = Window.partitionBy("eligible").orderBy(F.desc("score"), code)
    return df.withColumn("rank", F.when(F.col("eligible"), F.row_number().over(order)))


def sensitivity(risk: DataFrame, access: DataFrame, metric: str, center: float = 0.5, delta: float = 0.2, steps: int = 7, top_share: float = 0.2, robust: float = 0.9, min_axes: int = 2, code: str = "code") -> DataFrame:
    """How often each region is in the top group over multipliers and weights: one window over the whole grid."""
    low, high = max(0.0, center - delta), min(1.0, center + delta)
    weights = [low + (high - low) * i / (steps - 1) for i in range(steps)]
    grid = risk.select(code, "multiplier", "status", metric).withColumn("w", F.explode(F.array(*[F.lit(w) for w in weights])))
    spread = risk.select("multiplier").distinct().withColumn("w", F.explode(F.array(*[F.lit(w) for w in weights])))
    held = access.select(code, "access").crossJoin(F.broadcast(spread))
    scored = two_axes(grid, held, F.col("w"), metric, min_axes, partition=["multiplier", "w"], code=code).where("eligible")
    part = Window.partitionBy("multiplier", "w")
    n = F.count("*").over(part)
    top = F.row_number().over(part.orderBy(F.desc("score"), code)) <= F.greatest(F.lit(1), F.ceil(n * top_share))
    out = scored.withColumn("top", top).groupBy(code).agg(F.count("*").alias("runs"), F.avg(F.col("top").cast("int")).alias("top_rate"))
    return out.withColumns({"robust_top": F.col("top_rate") >= robust, "boundary": (F.col("top_rate") > 0) & (F.col("top_rate") < 1)})


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson and Spearman (average ranks) of complete pairs; NULL under three pairs or for a constant."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ranks = pairs.select("x", "y", average_rank("x").alias("rx"), average_rank("y").alias("ry"))
    fine = (F.count("*") >= 3) & (F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))
    return ranks.agg(F.count("*").alias("n"), F.when(fine, F.corr("x", "y")).alias("pearson"), F.when(fine, F.corr("rx", "ry")).alias("spearman"))


def top_overlap(df: DataFrame, one: str, two: str, n: int = 20, code: str = "code") -> DataFrame:
    """Size of the intersection of the two top-n sets (smaller code on ties)."""
    first = lambda c: df.where(F.col(c).isNotNull()).orderBy(F.desc(c), code).limit(n).select(code)
    return first(one).intersect(first(two)).agg(F.count("*").alias("overlap"))


def top_to_bottom_multiple(df: DataFrame, value: str, share: float = 0.1) -> DataFrame:
    """Mean of the top over the mean of the bottom max(1, ceil(n * share)) positive finite values."""
    kept = df.where((F.col(value) > 0) & (F.col(value) < float("inf"))).select(value)
    n = kept.agg(F.greatest(F.lit(1), F.ceil(F.count("*") * share)).alias("k"), F.count("*").alias("n"))
    ranks = kept.withColumns({"up": F.row_number().over(Window.orderBy(value)), "down": F.row_number().over(Window.orderBy(F.desc(value)))}).crossJoin(F.broadcast(n))
    out = ranks.agg(F.avg(F.when(F.col("down") <= F.col("k"), F.col(value))).alias("top_mean"), F.avg(F.when(F.col("up") <= F.col("k"), F.col(value))).alias("bottom_mean"), F.max("n").alias("n"))
    return out.withColumn("multiple", ratio("top_mean", "bottom_mean"))


def recommendation(risk: str, equity: str, cut: float = 0.5) -> Column:
    r, e = F.col(risk) >= cut, F.col(equity) >= cut
    return F.when(F.col(risk).isNull() | F.col(equity).isNull(), None).when(r & e, "both").when(r, "grid").when(e, "chargers").otherwise("watch")
