"""Axes beside the risk of surges, the joint score of three axes, display columns, windows of ranks and headline rows.

All tables have a row a region (or a region and scenario), so joins and windows here are over dimensions.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import isclose, minmax_score, ratio
from . import risk as risks

AXES = ("safety", "equity", "economy")


def _slice(results: DataFrame, multiplier: float, added: int) -> DataFrame:
    return results.where((F.col("mode") == "forecast") & (F.col("n_new") == added) & isclose("multiplier", multiplier))


def energy_axes(results: DataFrame, multiplier: float = 1.2, added: int = 3, code: str = "code") -> DataFrame:
    """Per region at one scenario: mean excess without a battery, mean saving (losses count 0), shares of reliable forecasts and feasible plans."""
    share = lambda c: F.avg(F.col(c).cast("int"))
    return _slice(results, multiplier, added).groupBy(code).agg(
        F.avg("baseline_over_kwh").alias("safety_raw"), F.avg(F.when(F.col("cost_difference").isNotNull(), F.greatest("cost_difference", F.lit(0.0)))).alias("economy_raw"),
        share("forecast_reliable").alias("forecast_confidence"), share("plan_feasible").alias("plan_confidence"),
    )


def display_columns(results: DataFrame, multiplier: float = 1.2, added: int = 3, code: str = "code") -> DataFrame:
    """What is shown beside the score and doesn't enter it: mean cost difference (with its sign) and mean excess."""
    return _slice(results, multiplier, added).groupBy(code).agg(F.avg("cost_difference").alias("shown_cost_difference"), F.avg("baseline_over_kwh").alias("shown_excess_kwh"))


def three_axes(energy: DataFrame, access: DataFrame, weights: tuple[float, float, float] = (1 / 3, 1 / 3, 1 / 3), least: int = 3, code: str = "code") -> DataFrame:
    """Weighted mean of the axes that exist, over all regions of either table.

    energy: code, safety_raw, economy_raw, forecast_confidence, plan_confidence; access: code, access,
    access_known and optionally log_confidence.  A region that only access has wasn't assessed, which is
    another reason than a missing value.  Confidence is the mean of its parts, a missing log
    confidence left out.
    """
    both = energy.withColumn("__e", F.lit(True)).join(access, code, "full_outer")
    both = both.withColumns({"safety_norm": minmax_score("safety_raw"), "equity_norm": 1 - minmax_score("access"), "economy_norm": minmax_score("economy_raw")})
    have = {a: F.col(f"{a}_norm").isNotNull() for a in AXES}
    weight = sum((F.when(have[a], w).otherwise(0.0) for a, w in zip(AXES, weights, strict=True)), F.lit(0.0))
    total = sum((F.coalesce(F.col(f"{a}_norm") * w, F.lit(0.0)) for a, w in zip(AXES, weights, strict=True)), F.lit(0.0))
    both = both.withColumns({"score": F.when(weight > 0, total / F.nullif(weight, F.lit(0.0))), "axes_present": sum((have[a].cast("int") for a in AXES), F.lit(0))})
    both = both.withColumn("missing_axes", F.concat_ws(",", *[F.when(~have[a], F.lit(a)) for a in AXES]))
    reason = F.when(F.col("axes_present") == len(AXES), "").when(F.col("__e"), "data_missing").otherwise("not_assessed_low_concentration")
    parts = [F.coalesce("forecast_confidence", F.lit(0.0)), F.coalesce("plan_confidence", F.lit(0.0)), F.col("axes_present") / len(AXES), F.coalesce(F.col("access_known").cast("double"), F.lit(0.0))]
    if "log_confidence" in access.columns:
        parts.append(F.col("log_confidence"))
    known = F.array_compact(F.array(*parts))
    confidence = F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known)
    out = both.withColumns({"missing_reason": reason, "confidence": confidence, "eligible": (F.col("axes_present") >= least) & F.col("score").isNotNull()})
    return out.drop("__e")


def with_predicted_risk(risk: DataFrame, predicted: DataFrame, code: str = "code") -> DataFrame:
    """The predicted peak ratio of a region beside its observed one, which stands in (and is marked) where there is none."""
    held = risk.join(predicted.select(code, F.col("predicted_peak_ratio").alias("__p")), code, "left")
    return held.withColumns({"predicted_missing": F.col("__p").isNull(), "used_peak_ratio": F.coalesce("__p", "peak_ratio")}).drop("__p")


def chosen_metric(axis: DataFrame, access: DataFrame, wanted: str = "auto", limit: float = 0.5, code: str = "code") -> tuple[str, float | None]:
    """(metric, share of zero surge risk in the pool): with 'auto' the peak ratio where that share reaches the limit.

    The pool are assessed regions with a known access.
    """
    pool = axis.where("status = 'assessed'").join(access.where("access is not null").select(code), code, "left_semi")
    zero = pool.agg(F.avg((F.col("surge_risk") == 0).cast("int"))).first()[0]
    if wanted != "auto":
        return wanted, zero
    return ("peak_ratio" if zero is not None and zero >= limit else "surge_risk"), zero


def priority_table(risk: DataFrame, access: DataFrame, multiplier: float = 1.2, w_risk: float = 0.5, metric: str = "auto", energy: DataFrame | None = None, code: str = "code") -> DataFrame:
    """The ranked table of two axes with the sensitivity of its top group and, beside it, what is only shown.

    risk: code, multiplier, status, surge_risk, peak_ratio; a region without a sensitivity is in no robust top.
    """
    axis = risk.where(isclose("multiplier", multiplier)).drop("multiplier")
    metric, _ = chosen_metric(axis, access, metric, code=code)
    joint = risks.ranked(risks.two_axes(axis, access, F.lit(w_risk), metric, code=code), code)
    tried = risks.sensitivity(risk, access, metric, w_risk, code=code).select(code, "top_rate", "robust_top", "boundary")
    out = joint.join(tried, code, "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("robust_top", "boundary")})
    out = out.withColumn("metric", F.lit(metric))
    return out if energy is None else out.join(display_columns(energy, multiplier, code=code), code, "left")


def review_order(results: DataFrame, confirmed: DataFrame, multiplier: float = 1.2, tolerance: float = 1e-6, code: str = "code") -> DataFrame:
    """Order in which loads are to be looked at, without added chargers: excess, then what is left of it, then the code.

    confirmed: codes with a confirmed public purpose (source and date).  A region whose plans or
    forecasts weren't all valid, or that isn't confirmed, is to be reviewed with more data first.
    """
    base = _slice(results, multiplier, 0)
    valid = F.bool_and(F.col("plan_feasible") & F.col("forecast_reliable") & (F.abs("end_error_kwh") <= tolerance))
    per = base.groupBy(code).agg(valid.alias("valid"), F.avg("baseline_over_kwh").alias("excess_kwh"), F.avg("over_kwh").alias("left_kwh"), F.avg("peak_reduction_kw").alias("peak_reduction_kw"))
    per = per.join(confirmed.select(code).distinct().withColumn("__c", F.lit(True)), code, "left").withColumn("confirmed", F.coalesce("__c", F.lit(False))).drop("__c")
    group = F.when(~F.col("valid") | ~F.col("confirmed"), "more_data_first").when(F.col("excess_kwh") > tolerance, "on_site_first").otherwise("no_excess_here")
    order = Window.orderBy(F.desc("excess_kwh"), F.desc("left_kwh"), code)
    return per.withColumns({"review_group": group, "place": F.row_number().over(order)})


# windows of ranks
def season_starts(last: str, windows: int = 4, months: int = 3) -> list[str]:
    """First days of the last evaluation window and of those so many months earlier each, the day clipped to the month."""
    import calendar

    day = dt.date.fromisoformat(last)
    out = []
    for k in range(windows):
        index = day.year * 12 + day.month - 1 - k * months
        year, month = divmod(index, 12)
        out.append(dt.date(year, month + 1, min(day.day, calendar.monthrange(year, month + 1)[1])).isoformat())
    return out


def compared_windows(ranks: DataFrame, top: int = 20, code: str = "code") -> DataFrame:
    """By window: regions, size of its top group, how many of it the first window's holds and the Jaccard similarity with that;
    and a row without a window: regions that every window's holds, and the mean similarity of pairs.

    ranks: window, code, rank (NULL: not ranked).
    """
    seen = ranks.where("rank is not null")
    order = F.row_number().over(Window.partitionBy("window").orderBy("rank", code))
    tops = seen.withColumn("__r", order).where(F.col("__r") <= top).select("window", code)
    sizes = tops.groupBy("window").agg(F.count("*").alias("n_top"))
    pair = tops.alias("a").join(tops.alias("b"), code).groupBy(F.col("a.window").alias("one"), F.col("b.window").alias("two")).agg(F.count("*").alias("both"))
    every = sizes.select(F.col("window").alias("one"), F.col("n_top").alias("n_one")).crossJoin(F.broadcast(sizes.select(F.col("window").alias("two"), F.col("n_top").alias("n_two"))))  # windows are few
    met = every.join(pair, ["one", "two"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    met = met.withColumn("jaccard", F.col("both") / (F.col("n_one") + F.col("n_two") - F.col("both")))
    first = sizes.agg(F.min("window").alias("two"))
    counted = ranks.groupBy("window").agg(F.count("*").alias("n_regions"))
    rows = met.join(F.broadcast(first), "two").select(F.col("one").alias("window"), F.col("n_one").alias("n_top"), F.col("both").alias("shared"), "jaccard").join(counted, "window")
    common = tops.groupBy(code).agg(F.count("*").alias("w")).crossJoin(F.broadcast(sizes.agg(F.count("*").alias("of")))).agg(F.count_if(F.col("w") == F.col("of")).alias("shared"))
    summary = met.where("one < two").agg(F.avg("jaccard").alias("jaccard")).crossJoin(common)
    lone = summary.select(F.lit(None).cast(dict(ranks.dtypes)["window"]).alias("window"), F.lit(None).cast("long").alias("n_regions"), F.lit(None).cast("long").alias("n_top"), "shared", "jaccard")
    return rows.select("window", "n_regions", "n_top", "shared", "jaccard").unionByName(lone)


# headline rows
def _line(df: DataFrame, number: str, item: str, value: Column, beside: Column | None = None, low: Column | None = None, high: Column | None = None, of: Column | None = None) -> DataFrame:
    cast = lambda c: (F.lit(None) if c is None else c).cast("double")
    return df.agg(cast(value).alias("value"), cast(beside).alias("beside"), cast(low).alias("low"), cast(high).alias("high"), F.coalesce(cast(of), F.lit(0.0)).alias("n")).select(F.lit(number).alias("number"), F.lit(item).alias("item"), "value", "beside", "low", "high", "n")


def headline_rows(multiple: DataFrame | None = None, risk: DataFrame | None = None, effect: DataFrame | None = None, scenario: DataFrame | None = None, multiplier: float = 1.2, added: int = 3, threshold: float = 0.5, year: int = 2030) -> DataFrame:
    """number, item, value, beside (what it is held against), low, high, n: a row a figure, in one table.

    multiple: one row of the inequality of vehicles per charger; risk: rows of ``surge_risk``; effect: code,
    n_new, multiplier, effect (NULL: no excess to avoid); scenario: code, year, scenario, beta, over.
    Without its material a figure has no row.
    """
    out = []
    if multiple is not None:
        out.append(_line(multiple, "1", "vehicles per charger, top over bottom", F.max("multiple"), of=F.max("n")))
    if risk is not None:
        at = risk.where(isclose("multiplier", multiplier) & (F.col("status") == "assessed"))
        share = lambda top, bottom: F.sum(top) / F.nullif(F.sum(bottom), F.lit(0))
        out.append(_line(at, "2", "alert precision", share("tp_ai", "alerts_ai"), share("tp_base", "alerts_base"), of=F.count("*")))
        out.append(_line(at, "2", "alert recall", share("tp_ai", "actual_days"), share("tp_base", "actual_days"), of=F.count("*")))
        out.append(_line(at, "3a", "regions at risk now", F.count_if(F.col("surge_risk") >= threshold), of=F.count("*")))
    if effect is not None:
        held = effect.where(F.col("n_new") == added)
        spans = held.groupBy("multiplier").agg(F.avg("effect").alias("mean"))
        here = F.when(isclose("multiplier", multiplier), F.col("effect"))
        line = _line(held, "2", "excess avoided by the forecast", F.avg(here), of=F.count(here)).drop("low", "high")
        out.append(line.crossJoin(spans.agg(F.min("mean").alias("low"), F.max("mean").alias("high"))).select("number", "item", "value", "beside", "low", "high", "n"))
    if scenario is not None:
        then = scenario.where((F.col("year") == year) & (F.col("beta") == "main"))
        over = lambda s: F.sum(F.when(F.col("scenario") == s, F.col("over").cast("int")))
        out.append(_line(then, "3b", f"regions over their limit in {year}", over("mid"), over("high"), of=F.count_if(F.col("scenario") == "mid")))
    if not out:
        raise ValueError("no material for any figure")
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows


def story_rows(headline: DataFrame, simulation: DataFrame | None = None, skill: float | None = None) -> DataFrame:
    """part, value, beside, text: the figures of a presentation; what wasn't computed says so and is made up by nothing.

    simulation: strategy, gain in the order they are told.  skill: the share of error that was fixed as the criterion beforehand.
    """
    got = {(r["number"], r["item"]): (r["value"], r["beside"]) for r in headline.collect()}  # a handful of rows
    none = (None, None)
    told = [r["gain"] for r in simulation.limit(2).collect()] if simulation is not None else []
    recall = got.get(("2", "alert recall"), none)
    if skill is not None:
        text = f"the error fell by {skill:.0%} against yesterday's values" if skill >= 0 else f"yesterday's values were not beaten ({skill:+.0%})"
    elif None not in recall:
        text = f"alerts caught {recall[0]:.0%} of surge days, the baseline {recall[1]:.0%}" if recall[0] > recall[1] else f"alerts caught {recall[0]:.0%}, not more than the baseline ({recall[1]:.0%})"
    else:
        text = "alert recall: not computed"
    rows = [("finding", None, None, text), ("gap", *got.get(("1", "vehicles per charger, top over bottom"), none), "")]
    if skill is not None:
        rows.append(("skill", skill, None, ""))
    rows += [("recall", *recall, ""), ("precision", *got.get(("2", "alert precision"), none), "")]
    rows.append(("intervention", told[0] if told else None, told[1] if len(told) > 1 else None, "" if told else "not computed"))
    return headline.sparkSession.createDataFrame([(p, *(None if v is None else float(v) for v in (a, b)), t) for p, a, b, t in rows], "part string, value double, beside double, text string")


def top_industries(sales: DataFrame, k: int, industry: str = "industry", value: str = "value") -> DataFrame:
    """The k industries with the largest sums (smaller name on ties)."""
    return sales.groupBy(industry).agg(F.sum(value).alias("total")).orderBy(F.desc("total"), industry).limit(k)


def attached(base: DataFrame, tables: list[DataFrame], counts: tuple[str, ...] = (), code: str = "code") -> DataFrame:
    """Columns of several region tables joined from the left; named counts are 0 where a region has no row, the rest stays NULL."""
    out = base
    for df in tables:
        out = out.join(df, code, "left")
    return out.fillna(0, list(counts))


def reconciled(names: DataFrame, known: DataFrame, overlap: DataFrame, code: str = "code") -> DataFrame:
    """old, code: the known code of each old one by name within its prefix; several are told apart by the larger overlap.

    names: old, prefix, name; known: code, prefix, name; overlap: old, code, score.  A tie for the
    largest overlap is no decision: such an old code comes back with NULL and 'ambiguous'.
    """
    met = names.join(known.select(F.col(code).alias("__code"), "prefix", "name"), ["prefix", "name"], "left")
    met = met.join(overlap.select("old", F.col(code).alias("__code"), "score"), ["old", "__code"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    best = met.groupBy("old").agg(F.max("score").alias("best"), F.count("__code").alias("n"))
    held = met.join(best, "old").where(F.col("score") == F.col("best"))
    out = held.groupBy("old", "n").agg(F.count("__code").alias("tied"), F.min("__code").alias("__code"))
    status = F.when(F.col("n") == 0, "unknown").when(F.col("tied") > 1, "ambiguous").otherwise("matched")
    return out.select("old", F.when(status == "matched", F.col("__code")).alias(code), status.alias("status"))


def improvement(before: DataFrame, after: DataFrame, low: DataFrame, code: str = "code") -> DataFrame:
    """One row: mean access of the low group before and after, and the relative gain."""
    held = before.select(code, F.col("access").alias("a")).join(after.select(code, F.col("access").alias("b")), code).join(low.select(code), code, "left_semi")
    return held.agg(F.avg("a").alias("before"), F.avg("b").alias("after")).withColumn("gain", ratio(F.col("after") - F.col("before"), "before"))
