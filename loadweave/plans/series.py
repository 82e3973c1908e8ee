"""Queries of the time-series and risk operators, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import risk, timeseries as ts
from .load import query as _query
from .standins import hourly, hourly_sql, rounded, table

query = _query

H3 = hourly_sql(3)
_DAYS = f"{H3}, dd AS (SELECT code, date, count(kw) AS n, sum(kw) AS t, max(kw) AS p FROM h GROUP BY 1, 2), dy AS (SELECT code, date, n = 24 AS is_complete, CASE WHEN n = 24 THEN t END AS total, CASE WHEN n = 24 THEN p END AS peak FROM dd)"
_R = "RANGE BETWEEN INTERVAL {a} DAY PRECEDING AND INTERVAL {b} DAY PRECEDING"


def _roll(value: str, keys: str, a: int, b: int, least: int, how: str = "avg") -> str:
    over = f"OVER (PARTITION BY {keys} ORDER BY date {_R.format(a=a, b=b)})"
    return f"CASE WHEN count({value}) {over} >= {least} THEN {how}({value}) {over} END"


@query("complete_days", f"WITH {_DAYS} SELECT code, CAST(date AS VARCHAR) AS date, is_complete, round(total, 4) AS total, round(peak, 4) AS peak FROM dy")
def complete_days(spark, d):
    return rounded(ts.complete_days(hourly(spark, d, 3)), 4)


@query("panel_features", f"""WITH {_DAYS},
x AS (SELECT code, date, is_complete, {_roll('total', 'code', 7, 1, 3)} AS m7, {_roll('total', 'code', 35, 8, 7)} AS m28, {_roll('total', 'code', 28, 1, 7)} / 24 AS level, {_roll('peak', 'code', 28, 1, 7)} AS peak_level, {_roll('peak', 'code', 7, 1, 3, 'max')} AS week_peak FROM dy),
l AS (SELECT h.code, h.date, h.hour, h.kw, a.kw AS lag1, b.kw AS lag2, c.kw AS lag7, e.kw AS lag14 FROM h LEFT JOIN h a ON a.code = h.code AND a.hour = h.hour AND a.date = h.date - INTERVAL 1 DAY
 LEFT JOIN h b ON b.code = h.code AND b.hour = h.hour AND b.date = h.date - INTERVAL 2 DAY LEFT JOIN h c ON c.code = h.code AND c.hour = h.hour AND c.date = h.date - INTERVAL 7 DAY LEFT JOIN h e ON e.code = h.code AND e.hour = h.hour AND e.date = h.date - INTERVAL 14 DAY),
r AS (SELECT code, date, hour, {_roll('kw', 'code, hour', 7, 1, 3)} AS roll7 FROM h)
SELECT l.code, CAST(l.date AS VARCHAR) AS date, l.hour, l.kw, lag1, lag2, lag7, lag14, round(roll7, 6) AS roll7, is_complete, round(level, 6) AS level, round(peak_level, 6) AS peak_level, week_peak, round(m7 / nullif(m28, 0), 6) AS trend
FROM l JOIN r USING (code, date, hour) LEFT JOIN x USING (code, date)""")
def panel_features(spark, d):
    return rounded(ts.panel_features(hourly(spark, d, 3)))


_BASE = f"""{_DAYS}, ok AS (SELECT code, date FROM dy WHERE is_complete), src AS (SELECT h.* FROM h JOIN ok USING (code, date)),
sh AS (SELECT code, hour, kw, CAST(date + INTERVAL (7 * w) DAY AS DATE) AS date FROM src, (SELECT unnest([1, 2]) AS w)),
md AS (SELECT code, date, hour, median(kw) AS m FROM sh GROUP BY 1, 2, 3 HAVING count(kw) = 2),
bl AS (SELECT h.*, m AS baseline_kw FROM h LEFT JOIN md USING (code, date, hour))"""


@query("baseline_median", f"WITH {_BASE} SELECT code, CAST(date AS VARCHAR) AS date, hour, kw, round(baseline_kw, 6) AS baseline_kw, CASE WHEN baseline_kw IS NOT NULL THEN CAST(CAST(date - INTERVAL 7 DAY AS DATE) AS VARCHAR) END AS src_max_date FROM bl")
def baseline_median(spark, d):
    return rounded(ts.baseline(hourly(spark, d, 3), 2))


@query("holiday_baseline", f"""WITH {hourly_sql(3)}, hol AS (SELECT DISTINCT CAST(ts AS DATE) AS date, 'x' || (day(ts) % 2) AS type FROM events WHERE day(ts) % 5 = 0),
pr AS (SELECT t.date AS target, p.date AS source, row_number() OVER (PARTITION BY t.date ORDER BY p.date DESC) AS r FROM hol t JOIN hol p ON t.type = p.type AND p.date < t.date)
SELECT code, hour, CAST(target AS VARCHAR) AS date, round(median(kw), 6) AS baseline_kw FROM h JOIN pr ON h.date = source AND r <= 2 GROUP BY code, hour, target HAVING count(kw) = 2""")
def holiday_baseline(spark, d):
    holidays = table(spark, d, "events").where("day(ts) % 5 = 0").select(F.to_date("ts").alias("date"), F.concat(F.lit("x"), (F.dayofmonth("ts") % 2).cast("string")).alias("type")).distinct()
    return rounded(ts.holiday_baseline(hourly(spark, d, 3), holidays, 2))


_LIV = "lv AS (SELECT user_id % 10 AS code, CAST(ts AS DATE) AS date, round(sum(CASE WHEN hour(ts) < 8 THEN value END), 4) AS lp_night, round(sum(CASE WHEN hour(ts) >= 8 THEN value END), 4) AS lp_day FROM events GROUP BY 1, 2)"


@query("living_features", f"""WITH {_LIV}, r AS (SELECT code, date, {_roll('lp_night', 'code', 35, 8, 7)} AS m FROM lv)
SELECT lv.code, CAST(lv.date AS VARCHAR) AS date, round(p.lp_night / nullif(m, 0), 6) AS lp_ratio, round(p.lp_night / nullif(p.lp_day, 0), 6) AS lp_mix FROM lv JOIN r USING (code, date) LEFT JOIN lv p ON p.code = lv.code AND p.date = lv.date - INTERVAL 7 DAY""")
def living_features(spark, d):
    e = table(spark, d, "events")
    night = F.hour("ts") < 8
    lv = e.groupBy((F.col("user_id") % 10).alias("code"), F.to_date("ts").alias("date")).agg(F.round(F.sum(F.when(night, F.col("value"))), 4).alias("lp_night"), F.round(F.sum(F.when(~night, F.col("value"))), 4).alias("lp_day"))
    return rounded(ts.living_features(lv))


@query("asof_latest_issue", """WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts AS issued_at, value, event_id AS vid FROM events WHERE event_type = 'view'),
j AS (SELECT p.event_id, p.user_id, p.ts, v.value, v.issued_at, row_number() OVER (PARTITION BY p.event_id ORDER BY v.issued_at DESC NULLS LAST, v.vid DESC) AS r FROM p LEFT JOIN v ON p.user_id = v.user_id AND v.issued_at <= p.ts - INTERVAL 6 HOUR)
SELECT event_id, user_id, value, epoch_us(issued_at) AS issued_us FROM j WHERE r = 1""")
def asof_latest_issue(spark, d):
    e = table(spark, d, "events")
    rows = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    issues = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("issued_at"), "value", F.col("event_id").alias("vid"))
    found = ts.asof_latest(rows, issues, ["user_id"], F.expr("ts - interval 6 hours"), tie="vid")
    return found.select("event_id", "user_id", "value", F.unix_micros(F.col("issued_at").cast("timestamp")).alias("issued_us"))


@query("holiday_runs", """WITH sp AS (SELECT min(CAST(o_orderdate AS DATE)) AS f, max(CAST(o_orderdate AS DATE)) AS t FROM orders), c AS (SELECT CAST(unnest(range(f, t + 1, INTERVAL 1 DAY)) AS DATE) AS date FROM sp),
l AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE day(o_orderdate) % 9 IN (3, 4) AND o_custkey % 3 = 0),
o AS (SELECT c.date, l.date IS NOT NULL AS listed FROM c LEFT JOIN l ON c.date = l.date WHERE isodow(c.date) >= 6 OR l.date IS NOT NULL),
i AS (SELECT *, date - CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS island FROM o),
r AS (SELECT *, count(*) OVER w AS n, bool_or(listed) OVER w AS anyl, min(date) OVER w AS f, max(date) OVER w AS t FROM i WINDOW w AS (PARTITION BY island)),
k AS (SELECT date, 'long_holiday' AS type, 1 AS p FROM r WHERE n >= 3 AND anyl UNION ALL SELECT date, 'holiday', 2 FROM r WHERE listed
 UNION ALL SELECT f - 1, 'pre_post_holiday', 3 FROM r WHERE n >= 3 AND anyl UNION ALL SELECT t + 1, 'pre_post_holiday', 3 FROM r WHERE n >= 3 AND anyl)
SELECT CAST(CAST(date AS DATE) AS VARCHAR) AS date, arg_min(type, p) AS type FROM k GROUP BY CAST(date AS DATE)""")
def holiday_runs(spark, d):
    """Days off among the days of orders: some of those on which orders were placed are listed."""
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"), "o_custkey")
    listed = days.where("day(date) % 9 in (3, 4) and o_custkey % 3 = 0").select("date").distinct()
    span = days.agg(F.min("date").cast("string"), F.max("date").cast("string")).first()
    return rounded(ts.holiday_types(listed, *span))


def _predictions(spark, d):
    base = ts.baseline(hourly(spark, d, 3), 2)
    rows = ts.with_day(base)
    lag = ts.calendar_lag("kw", 1, ["code", "hour"])
    return rows.select("code", "date", "hour", F.col("kw").alias("actual_kw"), "baseline_kw", lag.alias("lag1"), ((F.col("baseline_kw") + lag) / 2).alias("q50"), (F.greatest("baseline_kw", lag) * 1.1).alias("q90"))


_PRED = f"{_BASE}, pd AS (SELECT b.code, b.date, b.hour, b.kw AS actual_kw, b.baseline_kw, a.kw AS lag1, (b.baseline_kw + a.kw) / 2 AS q50, CASE WHEN coalesce(b.baseline_kw, a.kw) IS NOT NULL THEN greatest(b.baseline_kw, a.kw) * 1.1::DOUBLE END AS q90 FROM bl b LEFT JOIN h a ON a.code = b.code AND a.hour = b.hour AND a.date = b.date - INTERVAL 1 DAY)"


@query("forecast_metrics", f"""WITH {_PRED}, f AS (SELECT *, sum(actual_kw) OVER w > sum(baseline_kw) OVER w AS grows, row_number() OVER (PARTITION BY code, date ORDER BY actual_kw DESC, hour) = 1 AS pk FROM pd WHERE baseline_kw IS NOT NULL AND lag1 IS NOT NULL WINDOW w AS (PARTITION BY code, date))
SELECT code, CAST(count(*) AS BIGINT) AS n, round(avg(abs(actual_kw - lag1)), 6) AS mae_yesterday, round(avg(abs(actual_kw - baseline_kw)), 6) AS mae_baseline, round(avg(abs(actual_kw - q50)), 6) AS mae_ai,
round(avg(CASE WHEN grows THEN actual_kw - baseline_kw END), 6) AS growth_bias_baseline, round(avg(CASE WHEN grows THEN actual_kw - q50 END), 6) AS growth_bias_ai, round(avg(CASE WHEN pk THEN abs(actual_kw - baseline_kw) END), 6) AS peak_mae_baseline, round(avg(CASE WHEN pk THEN abs(actual_kw - q50) END), 6) AS peak_mae_ai,
round(avg(CASE WHEN actual_kw <= q90 THEN 1 ELSE 0 END), 6) AS coverage, round(avg(greatest(0.5 * (actual_kw - q50), -0.5 * (actual_kw - q50))), 6) AS pinball50, round(avg(greatest(0.9 * (actual_kw - q90), -0.1 * (actual_kw - q90))), 6) AS pinball90,
round(avg(abs(actual_kw - q50)), 6) <= round(avg(abs(actual_kw - baseline_kw)), 6) AND avg(CASE WHEN actual_kw <= q90 THEN 1 ELSE 0 END) >= 0.8 AS passes FROM f GROUP BY GROUPING SETS ((), (code)) HAVING count(*) > 0""")
def forecast_metrics(spark, d):
    return ts.ai_improvement(rounded(ts.forecast_metrics(_predictions(spark, d))))


@query("compare_methods", f"""WITH {_PRED} SELECT round(avg(abs(actual_kw - lag1)), 6) AS mae_lag1, round(avg(abs(actual_kw - baseline_kw)), 6) AS mae_baseline_kw, round(avg(CASE WHEN actual_kw <= q90 THEN 1 WHEN q90 IS NOT NULL THEN 0 END), 6) AS coverage,
round(1 - avg(abs(actual_kw - lag1)) / avg(abs(actual_kw - lag1)), 6) AS skill_lag1, round(1 - avg(abs(actual_kw - baseline_kw)) / avg(abs(actual_kw - lag1)), 6) AS skill_baseline_kw FROM pd""")
def compare_methods(spark, d):
    return rounded(ts.compare_methods(_predictions(spark, d), "actual_kw", ["lag1", "baseline_kw"], "q90"))


@query("peak_frame", f"WITH {_PRED} SELECT code, CAST(date AS VARCHAR) AS date, round(CASE WHEN count(actual_kw) = 24 THEN max(actual_kw) END, 6) AS actual_kw_peak, round(CASE WHEN count(q90) = 24 THEN max(q90) END, 6) AS q90_peak FROM pd GROUP BY code, date")
def peak_frame(spark, d):
    return rounded(ts.peak_frame(_predictions(spark, d), ["actual_kw", "q90"]))


@query("backtest", f"""WITH {_BASE}, x AS (SELECT code, date, count(baseline_kw) AS b, count(kw) AS a, avg(abs(kw - baseline_kw)) AS mae, avg(kw - baseline_kw) AS bias FROM bl GROUP BY 1, 2)
SELECT code, CAST(count(CASE WHEN a = 24 AND b = 24 THEN 1 END) AS BIGINT) AS n_days, CAST(count(CASE WHEN NOT (a = 24 AND b = 24) THEN 1 END) AS BIGINT) AS n_skipped, round(avg(CASE WHEN a = 24 AND b = 24 THEN mae END), 6) AS mae, round(avg(CASE WHEN a = 24 AND b = 24 THEN bias END), 6) AS bias FROM x GROUP BY code""")
def backtest(spark, d):
    return rounded(ts.backtest(ts.baseline(hourly(spark, d, 3), 2)))


@query("conformal_offset", f"""WITH {_PRED}, r AS (SELECT code, actual_kw - q50 AS residual FROM pd WHERE q50 IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY residual) AS r, count(*) OVER (PARTITION BY code) AS n FROM r)
SELECT c.code, round(coalesce(residual, 0.0), 6) AS offset, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT DISTINCT code FROM pd) c LEFT JOIN (SELECT * FROM k WHERE r = least(ceil((n + 1) * 0.9::DOUBLE), n)) x USING (code)""")
def conformal_offset(spark, d):
    res = _predictions(spark, d).select("code", (F.col("actual_kw") - F.col("q50")).alias("residual"))
    return rounded(ts.conformal_offset(res, 0.9, ["code"]))


def _peaks(spark, d):
    pred = _predictions(spark, d)
    calib = hourly(spark, d, 3).where("date <= date'2024-01-12'").groupBy("code").agg(F.max("kw").alias("calib_peak_kw"))
    return risk.day_peaks(pred.where("date > date'2024-01-12'")), calib, spark.createDataFrame([(0.7,), (0.8,), (1.0,)], "multiplier double")


_PK = f"""{_PRED}, pk AS (SELECT code, date, max(q90) AS ai, CASE WHEN count(baseline_kw) = count(*) THEN max(baseline_kw) END AS ba, CASE WHEN count(actual_kw) = count(*) THEN max(actual_kw) END AS ac FROM pd WHERE date > DATE '2024-01-12' GROUP BY 1, 2),
cp AS (SELECT code, max(kw) AS c FROM h WHERE date <= DATE '2024-01-12' GROUP BY 1), mu AS (SELECT unnest([0.7, 0.8, 1.0])::DOUBLE AS multiplier),
g AS (SELECT pk.code, date, multiplier, c, ai, ba, ac, coalesce(ai > c * multiplier, false) AS aia, coalesce(ba > c * multiplier, false) AS baa, coalesce(ac > c * multiplier, false) AS aca, ai IS NOT NULL AND ba IS NOT NULL AND ac IS NOT NULL AS com FROM pk LEFT JOIN cp USING (code), mu),
sr AS (SELECT code, multiplier, c, count(*) AS n_eval_days, avg(CASE WHEN aia THEN 1 ELSE 0 END) AS surge, avg(ai) AS mq, count(CASE WHEN com THEN 1 END) AS ncd, count(CASE WHEN aia AND aca AND com THEN 1 END) AS ta, count(CASE WHEN aia AND com THEN 1 END) AS aa, count(CASE WHEN baa AND aca AND com THEN 1 END) AS tb, count(CASE WHEN baa AND com THEN 1 END) AS ab, count(CASE WHEN aca AND com THEN 1 END) AS ad FROM g GROUP BY 1, 2, 3)"""


@query("surge_alerts", f"""WITH {_PK} SELECT code, multiplier, CASE WHEN coalesce(c >= 1, false) THEN 'assessed' ELSE 'not_assessed_low_load' END AS status, CAST(n_eval_days AS BIGINT) AS n_eval_days, round(surge, 6) AS surge_risk, round(mq / c, 6) AS mean_q90_peak_ratio,
round(ta / nullif(aa, 0), 6) AS precision_ai, round(tb / nullif(ab, 0), 6) AS precision_base, round(ta / nullif(ad, 0), 6) AS recall_ai, round(tb / nullif(ad, 0), 6) AS recall_base, ncd AS n_common_days, ta AS tp_ai, aa AS alerts_ai, tb AS tp_base, ab AS alerts_base, ad AS actual_days FROM sr""")
def surge_alerts(spark, d):
    return rounded(risk.surge_risk(*_peaks(spark, d)))


@query("risk_summary", f"""WITH {_PK} SELECT multiplier, CAST(count(*) AS BIGINT) AS n_regions, round(avg(surge), 6) AS surge_risk, round(sum(ta) / nullif(sum(aa), 0), 6) AS precision_ai, round(sum(tb) / nullif(sum(ab), 0), 6) AS precision_base, round(sum(ta) / nullif(sum(ad), 0), 6) AS recall_ai, round(sum(tb) / nullif(sum(ad), 0), 6) AS recall_base FROM sr WHERE c >= 1 GROUP BY 1""")
def risk_summary(spark, d):
    return rounded(risk.risk_summary(risk.surge_risk(*_peaks(spark, d))))


@query("alert_methods", f"""WITH {_PK}, x AS (SELECT multiplier, ac > c * multiplier AS act, unnest([{{'m': 'ai', 'v': ai}}, {{'m': 'base', 'v': ba}}]) AS s, c * multiplier AS t FROM g WHERE com AND c >= 1),
y AS (SELECT multiplier, s.m AS method, count(*) AS n, count(CASE WHEN act THEN 1 END) AS na, count(CASE WHEN s.v > t THEN 1 END) AS al, count(CASE WHEN s.v > t AND act THEN 1 END) AS hi FROM x GROUP BY 1, 2)
SELECT multiplier, method, CAST(n AS BIGINT) AS n_days, na AS n_actual, al AS n_alerts, hi AS n_hits, round(hi / nullif(al, 0), 6) AS precision, round(hi / nullif(na, 0), 6) AS recall FROM y""")
def alert_methods(spark, d):
    peaks, calib, mu = _peaks(spark, d)
    return rounded(risk.alert_table(peaks, calib, mu, {"ai": "ai_peak", "base": "base_peak"}))


@query("added_load_risk", f"""WITH {_PK}, ad AS (SELECT pd.code, pd.date, n_new, max(q90 + n_new * hour / 24.0::DOUBLE) AS p FROM pd, (SELECT unnest([1, 3]) AS n_new) WHERE date > DATE '2024-01-12' GROUP BY 1, 2, 3)
SELECT ad.code, multiplier, n_new, round(avg(CASE WHEN coalesce(p > c * multiplier, false) THEN 1 ELSE 0 END), 6) AS surge_risk_with_new FROM ad JOIN cp USING (code), mu GROUP BY 1, 2, 3""")
def added_load_risk(spark, d):
    _, calib, mu = _peaks(spark, d)
    added = spark.sql("select n_new, hour, n_new * hour / cast(24 as double) as delta_kw from (select explode(array(1, 3)) as n_new) cross join (select explode(sequence(0, 23)) as hour)")
    return rounded(risk.added_load_risk(_predictions(spark, d).where("date > date'2024-01-12'"), calib, mu, added))


@query("quantile_forecast")
def quantile_forecast(spark, d):
    from ..operators import models

    panel = ts.panel_features(hourly(spark, d, 3)).withColumn("dow", F.weekday("date"))
    out = models.quantile_forecast(panel, ["lag1", "lag7", "roll7", "level", "trend", "hour", "dow"], "2024-01-20", "2024-01-25", rounds=5, depth=3)
    return rounded(out.select("code", "date", "hour", "kw", "q50", "q90"))


@query("charge_types")
def charge_types(spark, d):
    from ..operators import models

    h = hourly(spark, d, 30)
    days = h.select("code").distinct().crossJoin(spark.sql("select explode(sequence(date'2024-01-01', date'2024-01-15')) as date")).crossJoin(spark.range(24).select(F.col("id").cast("int").alias("hour")))
    dense = days.join(h, ["code", "date", "hour"], "left").fillna(0.1, ["kw"])
    return models.charge_types(dense, 4)


@query("scaled_target", f"""WITH {H3}, mn AS (SELECT code, avg(kw) AS m FROM h GROUP BY 1), al AS (SELECT median(m) AS a FROM mn),
x AS (SELECT h.code, CAST(date AS VARCHAR) AS date, hour, kw, CASE WHEN hour % 3 = 0 THEN 0.0 ELSE hour * 10.0 END AS level, m, a FROM h JOIN mn USING (code), al)
SELECT code, date, hour, round(CASE WHEN level > 0 THEN level WHEN m > 0 THEN m ELSE a END, 9) AS scale, round((kw - 50) / CASE WHEN level > 0 THEN level WHEN m > 0 THEN m ELSE a END, 9) AS residual_target FROM x""")
def scaled_target(spark, d):
    from ..operators import models

    rows = hourly(spark, d, 3).withColumns({"reference": F.lit(50.0), "level": F.when(F.col("hour") % 3 == 0, 0.0).otherwise(F.col("hour") * 10.0)})
    return rounded(models.scaled_target(rows).select("code", "date", "hour", "scale", "residual_target"), 9)


_AGREE = f"""{_PRED}, pq AS (SELECT code, date, CASE WHEN count(lag1) = 24 THEN max(lag1) END AS p50, CASE WHEN count(baseline_kw) = 24 THEN max(baseline_kw) * 1.05::DOUBLE END AS p90,
CASE WHEN count(q50) = 24 THEN max(q50) END AS h50, CASE WHEN count(q90) = 24 THEN max(q90) END AS h90 FROM pd GROUP BY 1, 2),
ag AS (SELECT code, date, greatest(p50, h50) AS q50, greatest(p90, h90, greatest(p50, h50)) AS q90, coalesce(CAST(h50 > p50 AS INTEGER), 0) + coalesce(CAST(h90 > p90 AS INTEGER), 0) AS raised FROM pq)"""


def _agreed(spark, d):
    from ..operators import two_level

    hours = _predictions(spark, d)
    whole = lambda c: F.when(F.count(c) == 24, F.max(c))
    peaks = hours.groupBy("code", "date").agg(whole("lag1").alias("q50"), (whole("baseline_kw") * 1.05).alias("q90"))
    return two_level.agreed(hours.select("code", "date", "hour", "q50", "q90"), peaks)


@query("agreed_peaks", f"WITH {_AGREE} SELECT code, CAST(date AS VARCHAR) AS date, round(q50, 6) AS q50, round(q90, 6) AS q90, raised FROM ag")
def agreed_peaks(spark, d):
    return rounded(_agreed(spark, d))


@query("predicted_peak_ratios", f"""WITH {_AGREE}, cp AS (SELECT code, max(kw) AS c FROM h WHERE date <= DATE '2024-01-12' GROUP BY 1)
SELECT code, round(max(q90) / max(c), 6) AS ai_peak_ratio, round(max(q50) / max(c), 6) AS ai_peak_ratio_p50, count(*) AS ai_days FROM ag JOIN cp USING (code) WHERE date > DATE '2024-01-12' AND q50 IS NOT NULL AND q90 IS NOT NULL AND c >= 1 GROUP BY code""")
def predicted_peak_ratios(spark, d):
    from ..operators import two_level

    calib = hourly(spark, d, 3).where("date <= date'2024-01-12'").groupBy("code").agg(F.max("kw").alias("calib_peak_kw"))
    return rounded(two_level.predicted_ratios(_agreed(spark, d).where("date > date'2024-01-12'"), calib))


@query("quantile_models")
def quantile_models(spark, d):
    """Medians and upper quantiles by trees of their own, of days that they haven't seen."""
    from ..operators import quantile_trees

    panel = ts.panel_features(hourly(spark, d, 3)).withColumn("dow", F.weekday("date"))
    features = ["lag1", "lag7", "roll7", "level", "trend", "hour", "dow"]
    m50, m90 = quantile_trees.fit_many(panel.where("date <= date'2024-01-20'"), "kw", features, [quantile_trees.Options(tau=tau, rounds=5) for tau in (0.5, 0.9)])
    out = panel.where("date > date'2024-01-20'").withColumn("q50", F.greatest(m50.prediction(), F.lit(0.0)))
    return rounded(out.select("code", "date", "hour", "kw", "q50", F.greatest(m90.prediction(), "q50").alias("q90")))


_FULL = H3.replace("h AS (", "h0 AS (", 1) + ", h AS (SELECT code, date, hour, coalesce(kw, 0.0) AS kw FROM (SELECT * FROM (SELECT DISTINCT code FROM h0), (SELECT DISTINCT date FROM h0), (SELECT CAST(unnest(range(24)) AS INTEGER) AS hour)) LEFT JOIN h0 USING (code, date, hour))"
_FULL_BASE = _BASE.replace(H3, _FULL).replace("[1, 2]", "[1, 2, 3, 4]").replace("= 2)", "= 4)")


@query("two_level_forecast", f"""WITH {_FULL_BASE}, r AS (SELECT code, date, hour, {_roll('kw', 'code, hour', 7, 1, 3)} AS roll7 FROM h),
x AS (SELECT b.code, b.date, b.hour, b.kw, coalesce(a.kw, roll7, baseline_kw) IS NOT NULL AS known FROM bl b JOIN r USING (code, date, hour) LEFT JOIN h a ON a.code = b.code AND a.hour = b.hour AND a.date = b.date - INTERVAL 1 DAY)
SELECT CASE WHEN date <= DATE '2024-01-20' THEN 'train' WHEN date <= DATE '2024-01-25' THEN 'valid' ELSE 'eval' END AS period, count(*) AS n_hours, count(CASE WHEN known THEN 1 END) AS n_forecast, 0::BIGINT AS n_crossed, 0::BIGINT AS n_negative, 0::BIGINT AS n_peaks_below FROM x GROUP BY 1""")
def two_level_forecast(spark, d):
    """What must hold of a forecast on both levels, whatever its models learn: which hours have one, and in what order quantiles stand."""
    from ..operators import two_level

    own = hourly(spark, d, 3)
    hours = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    full = own.select("code").distinct().crossJoin(own.select("date").distinct()).crossJoin(hours).join(own, ["code", "date", "hour"], "left").fillna(0.0, ["kw"])  # 3 areas
    panel = two_level.hourly_panel(full.withColumn("code", F.col("code").cast("string"))).cache()
    found = two_level.forecast(panel, two_level.Periods("2024-01-20", "2024-01-25", "2024-12-31"), store=lambda df: df.cache(), at_least=20, rounds=2, depth=2, least=5)
    tops = found.hours.groupBy("code", "date").agg(*[F.when(F.count(q) == 24, F.max(q)).alias(f"top_{q}") for q in ("q50", "q90c")])
    below = found.peaks.join(tops, ["code", "date"]).groupBy("period").agg(F.count_if((F.col("q50") < F.col("top_q50")) | (F.col("q90c") < F.col("top_q90c"))).alias("n_peaks_below"))
    held = found.hours.groupBy("period").agg(F.count("*").alias("n_hours"), F.count("q50").alias("n_forecast"), F.count_if((F.col("q90") < F.col("q50")) | (F.col("q90c") < F.col("q50"))).alias("n_crossed"), F.count_if(F.col("q50") < 0).alias("n_negative"))
    return held.join(below, "period")
