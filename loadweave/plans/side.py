"""Queries of side inputs, cleaning, scoring and publishing on stand-ins from the driver's tables, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr, projection
from ..operators import battery, causal, cube, inputs, models, priority, publish, risk, sales, sessions, spatial
from ..operators import timeseries as ts
from ..sources import csv, files
from ..streaming import twins
from .load import query
from .standins import POINTS_SQL, STATIONS_SQL, hourly, hourly_sql, km_sql, points, rounded, stations, table


# side inputs
def _raw_places(spark, d):
    p = points(spark, d)
    blank = F.col("code") % 7 == 0
    return p.select(F.concat((F.col("code") % 40).cast("string"), F.lit(".0")).alias("code"), F.when(~blank, F.col("lat").cast("string")).alias("lat"), F.col("lon").cast("string").alias("lon"))


_CENTRES = f"""{POINTS_SQL}, ce AS (SELECT lpad(CAST(code % 40 AS VARCHAR), 10, '0') AS code, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY code % 40 ORDER BY lat, lon) AS r FROM p WHERE code % 7 <> 0) WHERE r = 1)"""
_EV = "ev AS (SELECT lpad(CAST(s_nationkey AS VARCHAR), 10, '0') AS code, sum(s_acctbal) AS ev FROM supplier WHERE s_acctbal >= 0 GROUP BY 1)"


@query("centroids", f"WITH {_CENTRES} SELECT code, round(lat, 6) AS lat, round(lon, 6) AS lon FROM ce")
def centroids(spark, d):
    return rounded(inputs.centroids(_raw_places(spark, d)))


@query("demand_points", f"WITH {_CENTRES}, {_EV} SELECT code, round(lat, 6) AS lat, round(lon, 6) AS lon, round(ev, 4) AS ev FROM ce LEFT JOIN ev USING (code)")
def demand_points(spark, d):
    registered = table(spark, d, "supplier").select(F.lpad(F.col("s_nationkey").cast("string"), 10, "0").alias("code"), F.col("s_acctbal").alias("ev"))
    out = inputs.demand_points(inputs.centroids(_raw_places(spark, d)), registered)
    return out.select("code", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("ev", 4).alias("ev"))


@query("ev_history", """SELECT CAST(o_custkey % 30 AS VARCHAR) AS code, strftime(o_orderdate, '%Y-%m') AS ym, round(coalesce(sum(CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END), 0), 2) AS ev
FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2""")
def ev_history(spark, d):
    o = table(spark, d, "orders")
    raw = o.select((F.col("o_custkey") % 30).cast("string").alias("code"), F.date_format("o_orderdate", "yyyyMMdd").alias("ym"), F.when(F.col("o_orderkey") % 11 != 0, F.format_number("o_totalprice", 2)).otherwise("-").alias("ev"), F.concat(F.lit(" "), F.col("o_orderpriority")).alias("fuel"))
    return rounded(inputs.ev_history(raw, "1-URGENT"), 2)


def _weather(spark, d):
    """Hourly stations: views are observations, clicks forecasts issued from 0 to 40 hours before their hour."""
    e = table(spark, d, "events").where("event_type in ('view', 'click')")
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    is_view = F.col("event_type") == "view"
    return e.select(
        hour.alias("ts"), (F.col("user_id") % 3).cast("string").alias("station"), F.when(is_view, F.round("value", 4).cast("string")).alias("observed"),
        F.when(~is_view, F.round("value", 4).cast("string")).alias("forecast"), F.when(~is_view, hour - F.make_dt_interval(F.lit(0), (F.col("event_id") % 41).cast("int"))).alias("issued_at"),
    )


_WEATHER = """w AS (SELECT date_trunc('hour', ts) AS ts, CAST(user_id % 3 AS VARCHAR) AS station, CASE WHEN event_type = 'view' THEN round(value, 4) END AS observed,
CASE WHEN event_type = 'click' THEN round(value, 4) END AS forecast, CASE WHEN event_type = 'click' THEN date_trunc('hour', ts) - to_hours(CAST(event_id % 41 AS INTEGER)) END AS issued_at FROM events WHERE event_type IN ('view', 'click'))"""


@query("weather_issues", f"WITH {_WEATHER} SELECT station, CAST(count(*) AS BIGINT) AS n, CAST(count(issued_at) AS BIGINT) AS n_issued, round(sum(observed), 4) AS observed, round(sum(forecast), 4) AS forecast FROM w GROUP BY 1")
def weather_issues(spark, d):
    w = inputs.weather_issues(_weather(spark, d))
    return rounded(w.groupBy("station").agg(F.count("*").alias("n"), F.count("issued_at").alias("n_issued"), F.sum("observed").alias("observed"), F.sum("forecast").alias("forecast")), 4)


@query("observed_values", f"WITH {_WEATHER}, o AS (SELECT station, ts, max(observed) AS observed FROM w WHERE observed IS NOT NULL GROUP BY 1, 2) SELECT station, epoch_us(ts) AS at, observed FROM o")
def observed_values(spark, d):
    w = inputs.weather_issues(_weather(spark, d)).groupBy("station", "ts").agg(F.max("observed").alias("observed"))
    both = w.unionByName(w)  # the same observation twice is no conflict
    return inputs.observed_values(both).select("station", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "observed")


@query("temperature_features", f"""WITH {_WEATHER}, u AS (SELECT *, row_number() OVER (PARTITION BY station, ts ORDER BY issued_at DESC, forecast DESC) AS r FROM w WHERE forecast IS NOT NULL AND issued_at <= date_trunc('day', ts) - INTERVAL 6 HOUR)
SELECT CAST(c AS BIGINT) AS code, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, CAST(hour(ts) AS INTEGER) AS hour, forecast AS temp, epoch_us(issued_at) AS issued FROM u, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS c) WHERE r = 1 AND station = CAST(c % 3 AS VARCHAR)""")
def temperature_features(spark, d):
    places = spark.range(6).select((F.col("id") % 3).cast("string").alias("station"), F.col("id").alias("code"))
    out = ts.temperature_features(inputs.weather_issues(_weather(spark, d)), places, "forecast")
    return out.select("code", F.col("date").cast("string").alias("date"), "hour", "temp", F.unix_micros(F.col("issued_at").cast("timestamp")).alias("issued"))


@query("input_audit", f"""WITH {_WEATHER}, x AS (SELECT CAST(count(DISTINCT station) AS VARCHAR) AS stations, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last,
CAST(count(CASE WHEN forecast IS NOT NULL AND issued_at <= ts - INTERVAL 6 HOUR THEN 1 END) AS VARCHAR) AS usable_forecasts, CAST(count(CASE WHEN forecast IS NOT NULL AND issued_at > ts - INTERVAL 6 HOUR THEN 1 END) AS VARCHAR) AS late_forecasts FROM w)
SELECT unnest(['stations', 'first', 'last', 'usable_forecasts', 'late_forecasts', 'holidays_holiday', 'holidays_long_holiday']) AS item, unnest([stations, first, last, usable_forecasts, late_forecasts, '2', '1']) AS value FROM x""")
def input_audit(spark, d):
    holidays = spark.createDataFrame([("2025-01-01", "holiday"), ("2025-03-01", "holiday"), ("2025-10-06", "long_holiday")], "date string, type string")
    return inputs.input_audit(inputs.weather_issues(_weather(spark, d)), holidays, F.expr("ts - interval 6 hours"))


@query("population_bands", f"""WITH {hourly_sql(20)}, b AS (SELECT code AS source, date, avg(CASE WHEN hour <= 6 THEN kw END) AS n, avg(CASE WHEN hour BETWEEN 9 AND 17 THEN kw END) AS d, avg(CASE WHEN hour >= 18 THEN kw END) AS e FROM h WHERE hour <= 6 OR hour BETWEEN 9 AND 17 OR hour >= 18 GROUP BY 1, 2)
SELECT CAST(source % 5 AS BIGINT) AS code, CAST(date AS VARCHAR) AS date, round(sum(n * 0.25), 6) AS lp_night, round(sum(d * 0.25), 6) AS lp_day, round(sum(e * 0.25), 6) AS lp_evening FROM b GROUP BY 1, 2""")
def population_bands(spark, d):
    rows = hourly(spark, d, 20).select(F.col("code").alias("source"), "date", "hour", F.col("kw").alias("people"))
    links = spark.range(20).select(F.col("id").alias("source"), (F.col("id") % 5).alias("code"), F.lit(0.25).alias("weight"))
    return rounded(inputs.population_bands(rows, links))


@query("charger_stations", """SELECT l_suppkey AS station, CAST(count(*) AS BIGINT) AS chargers, min(l_quantity) AS lat, min(l_extendedprice) AS lon FROM lineitem WHERE l_returnflag <> 'R' AND l_linestatus <> 'F' GROUP BY 1""")
def charger_stations(spark, d):
    raw = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("station"), F.when(F.col("l_returnflag") == "R", "Y").alias("deleted"), F.when(F.col("l_linestatus") == "F", "Y").otherwise("N").alias("restricted"), F.col("l_quantity").alias("lat"), F.col("l_extendedprice").alias("lon"))
    return inputs.charger_stations(raw)


# cleaning
@query("clean_expressions", """SELECT event_id, CAST(user_id AS VARCHAR) AS label, substr(CAST(user_id + 10 AS VARCHAR), 1, 2) IN ('11', '26') AS in_provinces, starts_with(CAST(user_id AS VARCHAR), '1') AS in_region,
CASE WHEN event_id % 5 <> 0 THEN CAST(event_id AS DOUBLE) END AS kept, event_id % 5 = 0 AS masked, event_type = 'view' OR (event_type = 'click' AND user_id % 10 = 3) AS matched,
CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'middle' ELSE 'high' END AS grp, abs(value - 50) <= 1e-8 + 1e-5 * 50 AS near, strftime(ts, '%Y-%m') AS ym,
round(value * pow(greatest(1 + 0.5 * 0.1, 0), 3.0), 6) AS projected, value BETWEEN 10 AND 60 AND user_id BETWEEN 5 AND 50 AS inside,
CASE WHEN event_id % 3 = 0 THEN lpad(CAST(user_id % 100 AS VARCHAR), 2, '0') || '110' || '101' || '00' WHEN event_id % 3 = 1 THEN '11110101' || '00' END AS joined,
round(greatest((exp(-3.5 * 0.05) / exp(-3.5 * abs(value / 100 + 0.05)) + exp(-3.5 * 0.05) / exp(-3.5 * abs(-value / 100 + 0.05))) / 2, 1.0), 6) AS slope FROM events""")
def clean_expressions(spark, d):
    e = table(spark, d, "events")
    kept, masked = expr.masked_value(F.when(F.col("event_id") % 5 == 0, F.lit(" * ")).otherwise(F.col("event_id").cast("string")))
    part = F.when(F.col("event_id") % 3 == 0, F.lpad((F.col("user_id") % 100).cast("string"), 2, "0"))
    return rounded(e.select(
        "event_id", expr.clean_label(F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(".0"))).alias("label"), expr.in_provinces((F.col("user_id") + 10).cast("string"), ["11", "26"]).alias("in_provinces"),
        expr.in_region(F.col("user_id").cast("string"), "1").alias("in_region"), kept.alias("kept"), masked.alias("masked"), expr.code_match("event_type", (F.col("user_id") % 10).cast("string"), ["view", "click:3"]).alias("matched"),
        expr.first_group([(F.col("value") < 10, "low"), (F.col("value") < 50, "middle")], "high").alias("grp"), expr.isclose("value", 50).alias("near"), expr.year_month(F.date_format("ts", "yyyy.MM.dd")).alias("ym"),
        expr.projected("value", F.lit(0.1), 0.5, 3.0).alias("projected"), expr.valid_coordinates("value", "user_id", (10, 60), (5, 50)).alias("inside"),
        expr.joined_code(part, F.when(F.col("event_id") % 3 == 0, "110"), F.when(F.col("event_id") % 3 == 0, "101").when(F.col("event_id") % 3 == 1, "11110101")).alias("joined"), expr.slope_factor(F.col("value") / 100).alias("slope"),
    ))


def _consumption(spark, d):
    e = table(spark, d, "events")
    period = F.when(F.col("event_id") % 10 == 0, F.date_format("ts", "yyyy-MM")).when(F.col("event_id") % 10 == 1, F.lit("202413")).otherwise(F.date_format("ts", "yyyy-MM-dd HH"))
    return e.select(period.alias("period"), F.when(F.col("event_id") % 10 == 0, F.lit("7시")).otherwise(F.date_format("ts", "HH")).alias("hour"), F.when(F.col("event_id") % 17 == 0, F.lit("-")).otherwise(F.col("value").cast("string")).alias("kwh"), (F.col("user_id") % 7).cast("string").alias("province"))


_CONSUMPTION = """cc AS (SELECT CAST(user_id % 7 AS VARCHAR) AS province, CAST(year(ts) * 12 + month(ts) - 1 AS INTEGER) AS mi, CAST(CASE WHEN event_id % 10 = 0 THEN 7 ELSE hour(ts) END AS INTEGER) AS hour, value AS kwh,
CAST(CASE WHEN event_id % 10 = 0 THEN day(last_day(CAST(ts AS DATE))) ELSE 1 END AS DOUBLE) AS days FROM events WHERE event_id % 10 <> 1 AND event_id % 17 <> 0)"""


@query("clean_consumption", f"WITH {_CONSUMPTION} SELECT province, mi, hour, CAST(count(*) AS BIGINT) AS n, round(sum(kwh), 4) AS kwh, sum(days) AS days FROM cc GROUP BY 1, 2, 3")
def clean_consumption(spark, d):
    rows = csv.clean_consumption(_consumption(spark, d))
    return rounded(rows.groupBy("province", "mi", "hour").agg(F.count("*").alias("n"), F.sum("kwh").alias("kwh"), F.sum("days").alias("days")), 4)


def _hourly_raw(spark, d):
    h = hourly(spark, d, 4)
    return h.select(F.col("code").cast("string").alias("code"), F.date_format("date", "yyyyMMdd").alias("period"), (F.col("hour") + 1).cast("string").alias("hour"), F.col("kw").cast("string").alias("kwh"))


@query("hourly_facts", f"WITH {hourly_sql(4)} SELECT CAST(code AS VARCHAR) AS code, CAST(date AS VARCHAR) AS date, hour, kw FROM h WHERE kw IS NOT NULL")
def hourly_facts(spark, d):
    return rounded(csv.hourly_facts(_hourly_raw(spark, d)))


@query("fill_absent_days", """WITH h AS (SELECT user_id % 40 AS code, CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour, round(sum(value), 4) AS kw FROM events WHERE (user_id % 40 + day(ts)) % 3 <> 0 GROUP BY 1, 2, 3),
s AS (SELECT min(date) AS a, max(date) AS b FROM h), c AS (SELECT CAST(unnest(range(a, b + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS date FROM s),
z AS (SELECT u.code, c.date FROM (SELECT DISTINCT code FROM h) u, c WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.code = u.code AND h.date = c.date))
SELECT code, CAST(date AS VARCHAR) AS date, hour, kw FROM h UNION ALL SELECT code, CAST(date AS VARCHAR), CAST(unnest(range(24)) AS INTEGER), 0.0 FROM z""")
def fill_absent_days(spark, d):
    return rounded(csv.fill_absent_days(hourly(spark, d, 40).where("(code + day(date)) % 3 <> 0")))


@query("region_master", """SELECT lpad(CAST(r_regionkey + 11 AS VARCHAR), 2, '0') || '110' || lpad(CAST(n_nationkey + 101 AS VARCHAR), 3, '0') || '00' AS code, r_name AS province, 'Gu' AS district, n_name AS town, r_name || ' Gu ' || n_name AS region_name
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 6 <> 5""")
def region_master(spark, d):
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    p2 = F.lpad((F.col("r_regionkey") + 11).cast("string"), 2, "0")
    tops = r.select(F.concat(p2, F.lit("00000000")).alias("code"), F.col("r_name").alias("name"), F.lit("존재").alias("status"))
    middle = r.select(F.concat(p2, F.lit("11000000")).alias("code"), F.concat("r_name", F.lit("  Gu")).alias("name"), F.lit(None).cast("string").alias("status"))
    towns = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(p2, F.lit("110"), F.lpad((F.col("n_nationkey") + 101).cast("string"), 3, "0"), F.lit("00")).alias("code"), F.concat("r_name", F.lit(" Gu "), "n_name").alias("name"), F.when(F.col("n_nationkey") % 6 == 5, "폐지").otherwise("존재").alias("status"))
    return csv.region_master(tops.unionByName(middle).unionByName(towns))


@query("crosswalk_pairs", "SELECT DISTINCT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS code, lpad(CAST(s_suppkey + 1000000 AS VARCHAR), 10, '0') AS canonical FROM supplier WHERE s_suppkey % 3 = 0")
def crosswalk_pairs(spark, d):
    k = F.col("s_suppkey")
    return csv.crosswalk(table(spark, d, "supplier").select(F.concat(k.cast("string"), F.lit(".0")).alias("code"), F.when(k % 3 == 0, k + 1_000_000).otherwise(k).cast("string").alias("canonical")))


@query("hourly_prices", "SELECT epoch_us(date_trunc('hour', ts)) AS at, round(avg(value), 6) AS price FROM (SELECT DISTINCT date_trunc('hour', ts) AS ts FROM events) t, (SELECT unnest([1.0, 2.0, 3.5, 4.0]) AS value) GROUP BY 1")
def hourly_prices(spark, d):
    hours = table(spark, d, "events").select(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h")).distinct()
    quarters = F.explode(F.array(*[F.struct(F.lit(15 * i).alias("m"), F.lit(v).alias("price")) for i, v in enumerate((1.0, 2.0, 3.5, 4.0))]))
    raw = hours.withColumn("q", quarters).select((F.col("h") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("q.m"))).alias("ts"), "q.price")
    return rounded(csv.prices(raw).select(F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "price"))


@query("vehicle_log", """SELECT CAST(user_id AS VARCHAR) AS vehicle, CAST(count(*) AS BIGINT) AS n, CAST(count(CASE WHEN value BETWEEN 33 AND 39 AND event_id % 11 <> 0 THEN 1 END) AS BIGINT) AS placed, CAST(count(CASE WHEN event_type = 'click' THEN 1 END) AS BIGINT) AS charging,
epoch_us(max(date_trunc('second', ts))) AS last FROM events WHERE user_id % 13 <> 0 GROUP BY 1""")
def vehicle_log(spark, d):
    e = table(spark, d, "events")
    raw = e.select(F.when(F.col("user_id") % 13 == 0, " ").otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string"))).alias("vehicle"), F.date_format("ts", "yyyyMMddHHmmss").alias("ts"), F.col("value").cast("string").alias("lat"), F.when(F.col("event_id") % 11 == 0, "").otherwise("127.0").alias("lon"), F.col("event_type").alias("charging"))
    log = files.typed_log(raw, charging=["click"])
    return log.groupBy("vehicle").agg(F.count("*").alias("n"), F.count("lat").alias("placed"), F.count_if("charging").alias("charging"), F.unix_micros(F.max("ts").cast("timestamp")).alias("last"))


@query("log_diagnostics", "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT user_id) AS BIGINT) AS vehicles, CAST(count(CASE WHEN NOT value BETWEEN 33 AND 39 THEN 1 END) AS BIGINT) AS without_place, CAST(count(CASE WHEN event_type = 'click' THEN 1 END) AS BIGINT) AS charging FROM events")
def log_diagnostics(spark, d):
    e = table(spark, d, "events")
    raw = e.select(F.col("user_id").cast("string").alias("vehicle"), F.date_format("ts", "yyyyMMddHHmmss").alias("ts"), F.col("value").cast("string").alias("lat"), F.lit("127.0").alias("lon"), F.col("event_type").alias("charging"))
    return files.log_diagnostics(files.typed_log(raw, charging=["click"]), 1 << 30).drop("first", "last")


# features and models
@query("district_hours", f"WITH {hourly_sql()} SELECT substr(CAST(code AS VARCHAR), 1, 1) AS code, CAST(date AS VARCHAR) AS date, hour, round(sum(kw), 4) AS kw FROM h GROUP BY 1, 2, 3")
def district_hours(spark, d):
    return rounded(ts.district_hours(hourly(spark, d), 1), 4)


@query("group_mean", f"WITH {hourly_sql(12)} SELECT code, CAST(date AS VARCHAR) AS date, hour, kw, code % 3 AS \"group\", round(avg(kw) OVER (PARTITION BY code % 3, date, hour), 6) AS group_kw FROM h")
def group_mean(spark, d):
    return rounded(ts.group_mean(hourly(spark, d, 12).withColumn("group", F.col("code") % 3), "kw"))


@query("coming_baseline", f"""WITH {hourly_sql(3)}, f AS (SELECT code, date FROM h GROUP BY 1, 2 HAVING count(kw) = 24), l AS (SELECT max(date) AS d FROM h),
c AS (SELECT u.code, CAST(l.d + 1 + CAST(k AS INTEGER) AS DATE) AS date, CAST(hh AS INTEGER) AS hour FROM (SELECT DISTINCT code FROM h) u, l, (SELECT unnest(range(7)) AS k), (SELECT unnest(range(24)) AS hh)),
s AS (SELECT h.code, h.hour, h.kw, CAST(h.date + 7 * w AS DATE) AS date FROM h JOIN f USING (code, date), (SELECT unnest([1, 2, 3, 4]) AS w)), m AS (SELECT code, date, hour, median(kw) AS b FROM s GROUP BY 1, 2, 3 HAVING count(kw) = 4)
SELECT c.code, CAST(c.date AS VARCHAR) AS date, c.hour, round(b, 6) AS baseline_kw, CAST(CASE WHEN b IS NOT NULL THEN CAST(c.date - 7 AS DATE) END AS VARCHAR) AS src_max_date FROM c LEFT JOIN m ON c.code = m.code AND c.date = m.date AND c.hour = m.hour""")
def coming_baseline(spark, d):
    h = hourly(spark, d, 3)
    ahead = h.agg(F.max("date").alias("last")).select(F.explode(F.sequence(F.date_add("last", 1), F.date_add("last", 7))).alias("date"))
    coming = h.select("code").distinct().crossJoin(F.broadcast(ahead)).withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return rounded(ts.baseline(h, coming=coming))


def _outcomes(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("code"), (F.col("c_custkey") % 3 == 0).alias("treated"), (F.col("c_acctbal") / 1000 + (F.col("c_custkey") % 3 == 0).cast("int") * (F.col("c_custkey") % 7)).alias("delta"), (F.col("c_custkey") % 7).cast("double").alias("predicted"))


_OUT = "oc AS (SELECT c_custkey AS code, c_custkey % 3 = 0 AS treated, c_acctbal / 1000 + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END * (c_custkey % 7) AS delta, CAST(c_custkey % 7 AS DOUBLE) AS predicted FROM customer)"


@query("blp_slope", f"""WITH {_OUT}, p AS (SELECT avg(CASE WHEN treated THEN 1.0 ELSE 0 END) AS p FROM oc), r AS (SELECT delta * (CASE WHEN treated THEN 1 ELSE 0 END - p) / (p * (1 - p)) AS y, predicted AS x FROM oc, p),
m AS (SELECT avg(x) AS mx, avg(y) AS my, regr_slope(y, x) AS b, count(*) AS n FROM r), s AS (SELECT max(b) AS b, max(n) AS n, sum(pow(x - mx, 2) * pow(y - my - b * (x - mx), 2)) AS num, sum(pow(x - mx, 2)) AS den FROM r, m)
SELECT round(b, 6) AS slope, round(sqrt(num * n / (n - 2)) / den, 6) AS se, CAST(n AS BIGINT) AS n FROM s""")
def blp_slope(spark, d):
    return rounded(models.blp_slope(_outcomes(spark, d), "predicted"))


@query("effect_groups", f"""WITH {_OUT}, g AS (SELECT *, ntile(4) OVER (ORDER BY predicted, code) AS grp FROM oc) SELECT CAST(grp AS INTEGER) AS "group", round(avg(CASE WHEN treated THEN delta END) - avg(CASE WHEN NOT treated THEN delta END), 6) AS effect, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY 1""")
def effect_groups(spark, d):
    return rounded(models.effect_groups(_outcomes(spark, d), "predicted", tie="code"))


@query("imputed_features", """WITH x AS (SELECT s_suppkey AS code, CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END AS a, CASE WHEN s_suppkey % 5 = 0 THEN s_nationkey END AS b FROM supplier), m AS (SELECT median(a) AS ma, median(b) AS mb FROM x)
SELECT code, coalesce(a, ma) AS a, coalesce(CAST(b AS DOUBLE), mb) AS b, CASE WHEN a IS NULL THEN 1 ELSE 0 END AS a_missing, CASE WHEN b IS NULL THEN 1 ELSE 0 END AS b_missing FROM x, m""")
def imputed_features(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("code"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal")).alias("a"), F.when(F.col("s_suppkey") % 5 == 0, F.col("s_nationkey")).alias("b"), F.lit(None).cast("double").alias("none"))
    return models.imputed_features(s, ["a", "b", "none"])


def _runs(spark, d):
    """Battery outcomes by region, day, input, chargers and multiplier."""
    i = table(spark, d, "lineitem")
    kind = F.element_at(F.array(*map(F.lit, ("base", "p50", "p90", "oracle"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return i.where("l_linenumber <= 4").select(
        (F.col("l_suppkey") % 50).alias("code"), F.trunc("l_shipdate", "month").alias("date"), kind.alias("input"), F.col("l_quantity").alias("over_kwh"), (F.col("l_quantity") + F.col("l_discount") * 100).alias("baseline_over_kwh"),
        (F.col("l_tax") * 100 - 4).alias("cost_difference"), (F.col("l_partkey") % 9 != 0).alias("forecast_reliable"), (F.col("l_partkey") % 19 != 0).alias("plan_feasible"), (F.col("l_partkey") % 4).cast("int").alias("n_new"),
        F.element_at(F.array(*map(F.lit, (1.1, 1.2, 1.3))), (F.col("l_orderkey") % 3 + 1).cast("int")).alias("multiplier"), F.when(F.col("l_linenumber") == 4, "oracle").otherwise("forecast").alias("mode"), F.lit(0.0).alias("end_error_kwh"), (F.col("l_discount") * 10).alias("peak_reduction_kw"),
    )


_RUNS = """rn AS (SELECT l_suppkey % 50 AS code, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, CASE l_linenumber % 4 WHEN 0 THEN 'base' WHEN 1 THEN 'p50' WHEN 2 THEN 'p90' ELSE 'oracle' END AS input, l_quantity AS over_kwh, l_quantity + l_discount * 100 AS baseline_over_kwh,
l_tax * 100 - 4 AS cost_difference, l_partkey % 9 <> 0 AS forecast_reliable, l_partkey % 19 <> 0 AS plan_feasible, l_partkey % 4 AS n_new, CASE l_orderkey % 3 WHEN 0 THEN 1.1 WHEN 1 THEN 1.2 ELSE 1.3 END AS multiplier,
CASE WHEN l_linenumber = 4 THEN 'oracle' ELSE 'forecast' END AS mode, l_discount * 10 AS peak_reduction_kw FROM lineitem WHERE l_linenumber <= 4)"""


@query("effect_of_inputs", f"""WITH {_RUNS}, c AS (SELECT code, date FROM rn GROUP BY 1, 2 HAVING count(DISTINCT input) = 4), s AS (SELECT code, sum(CASE WHEN input = 'base' THEN over_kwh END) AS base, sum(CASE WHEN input = 'p50' THEN over_kwh END) AS p50,
sum(CASE WHEN input = 'p90' THEN over_kwh END) AS p90, sum(CASE WHEN input = 'oracle' THEN over_kwh END) AS oracle FROM rn JOIN c USING (code, date) GROUP BY 1) SELECT *, round(CASE WHEN base > 1e-6 THEN 1 - p90 / nullif(base, 0) END, 6) AS effect FROM s""")
def effect_of_inputs(spark, d):
    return rounded(battery.effect_of_inputs(_runs(spark, d), ["code"]))


@query("compared_runs", f"""WITH {_RUNS} SELECT mode, input, CAST(n_new AS INTEGER) AS n_new, multiplier, CAST(count(*) AS BIGINT) AS n_days, round(avg(CASE WHEN plan_feasible THEN 1 ELSE 0 END), 6) AS feasible_share, round(avg(over_kwh), 6) AS over_kwh, round(avg(baseline_over_kwh), 6) AS baseline_over_kwh FROM rn GROUP BY 1, 2, 3, 4""")
def compared_runs(spark, d):
    return rounded(battery.compared_runs(_runs(spark, d)))


# scores and priority
_ACCESS = "ac AS (SELECT s_suppkey % 60 AS code, max(CASE WHEN s_suppkey % 6 <> 1 THEN s_acctbal END) AS access, bool_or(s_suppkey % 2 = 0) AS access_known FROM supplier GROUP BY 1)"


def _access(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").groupBy((k % 60).alias("code")).agg(F.max(F.when(k % 6 != 1, F.col("s_acctbal"))).alias("access"), F.bool_or(k % 2 == 0).alias("access_known"))


_ENERGY = f"""{_RUNS}, en AS (SELECT code, avg(baseline_over_kwh) AS safety_raw, avg(greatest(cost_difference, 0)) AS economy_raw, avg(CASE WHEN forecast_reliable THEN 1 ELSE 0 END) AS forecast_confidence, avg(CASE WHEN plan_feasible THEN 1 ELSE 0 END) AS plan_confidence
FROM rn WHERE mode = 'forecast' AND n_new = 3 AND multiplier = 1.2 GROUP BY 1)"""


@query("energy_axes", f"WITH {_ENERGY} SELECT code, round(safety_raw, 6) AS safety_raw, round(economy_raw, 6) AS economy_raw, round(forecast_confidence, 6) AS forecast_confidence, round(plan_confidence, 6) AS plan_confidence FROM en")
def energy_axes(spark, d):
    return rounded(priority.energy_axes(_runs(spark, d)))


@query("shown_columns", f"WITH {_RUNS} SELECT code, round(avg(cost_difference), 6) AS shown_cost_difference, round(avg(baseline_over_kwh), 6) AS shown_excess_kwh FROM rn WHERE mode = 'forecast' AND n_new = 3 AND multiplier = 1.2 GROUP BY 1")
def shown_columns(spark, d):
    return rounded(priority.display_columns(_runs(spark, d)))


def _norm(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN CASE WHEN abs(max({c}) OVER () - min({c}) OVER ()) <= 1e-8 + 1e-5 * abs(min({c}) OVER ()) THEN 0.5 ELSE ({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0) END END"


@query("three_axes", f"""WITH {_ENERGY}, {_ACCESS}, j AS (SELECT coalesce(en.code, ac.code) AS code, en.code IS NOT NULL AS assessed, safety_raw, economy_raw, forecast_confidence, plan_confidence, access, access_known FROM en FULL OUTER JOIN ac ON en.code = ac.code),
n AS (SELECT *, {_norm('safety_raw')} AS s, 1 - ({_norm('access')}) AS e, {_norm('economy_raw')} AS m FROM j),
w AS (SELECT *, CASE WHEN s IS NOT NULL THEN 0.5 ELSE 0 END + CASE WHEN e IS NOT NULL THEN 0.3 ELSE 0 END + CASE WHEN m IS NOT NULL THEN 0.2 ELSE 0 END AS wt, CASE WHEN s IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN e IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN m IS NOT NULL THEN 1 ELSE 0 END AS k FROM n)
SELECT code, round((coalesce(s * 0.5, 0) + coalesce(e * 0.3, 0) + coalesce(m * 0.2, 0)) / nullif(wt, 0), 6) AS score, CAST(k AS INTEGER) AS axes_present, CASE WHEN k = 3 THEN '' WHEN assessed THEN 'data_missing' ELSE 'not_assessed_low_concentration' END AS missing_reason,
concat_ws(',', CASE WHEN s IS NULL THEN 'safety' END, CASE WHEN e IS NULL THEN 'equity' END, CASE WHEN m IS NULL THEN 'economy' END) AS missing_axes, round((coalesce(forecast_confidence, 0) + coalesce(plan_confidence, 0) + k / 3.0 + CASE WHEN access_known THEN 1 ELSE 0 END) / 4, 6) AS confidence, k >= 3 AS eligible FROM w""")
def three_axes(spark, d):
    out = priority.three_axes(priority.energy_axes(_runs(spark, d)), _access(spark, d), (0.5, 0.3, 0.2))
    return rounded(out.select("code", "score", "axes_present", "missing_reason", "missing_axes", "confidence", "eligible"))


@query("review_order", f"""WITH {_RUNS}, g AS (SELECT code, bool_and(plan_feasible AND forecast_reliable) AS valid, avg(baseline_over_kwh) AS x, avg(over_kwh) AS l, avg(peak_reduction_kw) AS r FROM rn WHERE mode = 'forecast' AND n_new = 0 AND multiplier = 1.2 GROUP BY 1)
SELECT code, valid, round(x, 6) AS excess_kwh, round(l, 6) AS left_kwh, round(r, 6) AS peak_reduction_kw, code % 2 = 0 AS confirmed, CASE WHEN NOT valid OR code % 2 = 1 THEN 'more_data_first' WHEN x > 1e-6 THEN 'on_site_first' ELSE 'no_excess_here' END AS review_group,
CAST(row_number() OVER (ORDER BY round(x, 9) DESC, round(l, 9) DESC, code) AS INTEGER) AS place FROM g""")
def review_order(spark, d):
    return rounded(priority.review_order(_runs(spark, d), spark.range(0, 50, 2).select(F.col("id").alias("code"))))


def _risk(spark, d):
    k = F.col("p_partkey")
    base = table(spark, d, "part").groupBy((k % 60).alias("code"), F.element_at(F.array(*map(F.lit, (1.1, 1.2, 1.3))), (F.col("p_size") % 3 + 1).cast("int")).alias("multiplier"))
    out = base.agg(F.round(F.avg("p_retailprice"), 4).alias("v"), F.count("*").cast("double").alias("n"))
    return out.select("code", "multiplier", F.when(F.col("code") % 9 == 0, "not_assessed_low_load").otherwise("assessed").alias("status"), (F.pmod(F.col("v") * 100, F.lit(101.0)) / 101).alias("surge_risk"), (F.col("v") / 1000).alias("peak_ratio"))


_RISK = """ri AS (SELECT code, multiplier, CASE WHEN code % 9 = 0 THEN 'not_assessed_low_load' ELSE 'assessed' END AS status, fmod(v * 100, 101.0) / 101 AS surge_risk, v / 1000 AS peak_ratio FROM
(SELECT p_partkey % 60 AS code, CASE p_size % 3 WHEN 0 THEN 1.1 WHEN 1 THEN 1.2 ELSE 1.3 END AS multiplier, round(avg(p_retailprice), 4) AS v FROM part GROUP BY 1, 2))"""


@query("with_predicted_risk", f"""WITH {_RISK} SELECT code, multiplier, round(peak_ratio, 6) AS peak_ratio, code % 4 = 0 AS predicted_missing, round(CASE WHEN code % 4 = 0 THEN peak_ratio ELSE code / 100.0 END, 6) AS used_peak_ratio FROM ri""")
def with_predicted_risk(spark, d):
    predicted = spark.range(60).where("id % 4 <> 0").select(F.col("id").alias("code"), (F.col("id") / 100).alias("predicted_peak_ratio"))
    return rounded(priority.with_predicted_risk(_risk(spark, d), predicted).select("code", "multiplier", "peak_ratio", "predicted_missing", "used_peak_ratio"))


_GRID = f"""{_RISK}, {_ACCESS}, wg AS (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7]) AS w), ms AS (SELECT DISTINCT multiplier FROM ri),
g AS (SELECT coalesce(r.code, a.code) AS code, coalesce(r.multiplier, a.multiplier) AS multiplier, coalesce(r.w, a.w) AS w, CASE WHEN status = 'assessed' THEN surge_risk END AS raw, access FROM (SELECT * FROM ri, wg) r FULL OUTER JOIN (SELECT * FROM ac, ms, wg) a ON r.code = a.code AND r.multiplier = a.multiplier AND r.w = a.w),
pr AS (SELECT *, CASE WHEN raw IS NOT NULL THEN (rank() OVER (PARTITION BY multiplier, w, raw IS NULL ORDER BY raw) + (count(*) OVER (PARTITION BY multiplier, w, raw) - 1) / 2.0 - 1) / nullif(count(raw) OVER (PARTITION BY multiplier, w) - 1, 0) END AS rn,
CASE WHEN access IS NOT NULL THEN 1 - (rank() OVER (PARTITION BY multiplier, w, access IS NULL ORDER BY access) + (count(*) OVER (PARTITION BY multiplier, w, access) - 1) / 2.0 - 1) / nullif(count(access) OVER (PARTITION BY multiplier, w) - 1, 0) END AS an FROM g),
el AS (SELECT *, round(rn * w + an * (1 - w), 12) AS score FROM pr WHERE rn IS NOT NULL AND an IS NOT NULL),
tp AS (SELECT *, row_number() OVER (PARTITION BY multiplier, w ORDER BY score DESC, code) <= greatest(1, ceil(count(*) OVER (PARTITION BY multiplier, w) * 0.2)) AS top FROM el)"""


@query("priority_grid", f"WITH {_GRID} SELECT code, CAST(count(*) AS BIGINT) AS runs, round(avg(CASE WHEN top THEN 1 ELSE 0 END), 6) AS top_rate, avg(CASE WHEN top THEN 1 ELSE 0 END) >= 0.9 AS robust_top, avg(CASE WHEN top THEN 1 ELSE 0 END) > 0 AND avg(CASE WHEN top THEN 1 ELSE 0 END) < 1 AS boundary FROM tp GROUP BY 1")
def priority_grid(spark, d):
    return rounded(risk.sensitivity(_risk(spark, d), _access(spark, d).select("code", "access"), "surge_risk", steps=5))


@query("compared_windows", f"""WITH {_RISK}, rk AS (SELECT CAST(round(multiplier * 10) AS INTEGER) AS "window", code, CASE WHEN status = 'assessed' THEN row_number() OVER (PARTITION BY multiplier, status ORDER BY surge_risk DESC, code) END AS rank FROM ri),
t AS (SELECT "window", code FROM (SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY rank, code) AS r FROM rk WHERE rank IS NOT NULL) WHERE r <= 10), s AS (SELECT "window", count(*) AS n FROM t GROUP BY 1),
p AS (SELECT a."window" AS one, b."window" AS two, a.n AS n1, b.n AS n2, (SELECT count(*) FROM t x JOIN t y ON x.code = y.code WHERE x."window" = a."window" AND y."window" = b."window") AS nb FROM s a, s b)
SELECT one AS "window", CAST((SELECT count(*) FROM rk WHERE "window" = one) AS BIGINT) AS n_regions, CAST(n1 AS BIGINT) AS n_top, CAST(nb AS BIGINT) AS shared, round(nb / (n1 + n2 - nb), 6) AS jaccard FROM p WHERE two = (SELECT min("window") FROM s)
UNION ALL SELECT NULL, NULL, NULL, CAST((SELECT count(*) FROM (SELECT code FROM t GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM s))) AS BIGINT), round(avg(nb / (n1 + n2 - nb)), 6) FROM p WHERE one < two""")
def compared_windows(spark, d):
    r = _risk(spark, d).withColumn("window", F.round(F.col("multiplier") * 10).cast("int"))
    from pyspark.sql.window import Window

    ranks = r.select("window", "code", F.when(F.col("status") == "assessed", F.row_number().over(Window.partitionBy("window", "status").orderBy(F.desc("surge_risk"), "code"))).alias("rank"))
    return rounded(priority.compared_windows(ranks, 10))


@query("headline_rows", f"""WITH {_RISK}, {_RUNS}, ef AS (SELECT code, n_new, multiplier, CASE WHEN sum(baseline_over_kwh) > 0 THEN 1 - sum(over_kwh) / sum(baseline_over_kwh) END AS e FROM rn WHERE n_new = 3 GROUP BY 1, 2, 3),
sp AS (SELECT multiplier, avg(e) AS m FROM ef GROUP BY 1)
SELECT '2' AS number, 'alert precision' AS item, round(sum(code) / nullif(sum(code + 10), 0), 6) AS value, round(sum(code - 1) / nullif(sum(code + 20), 0), 6) AS beside, NULL::DOUBLE AS low, NULL::DOUBLE AS high, CAST(count(*) AS DOUBLE) AS n FROM ri WHERE multiplier = 1.2 AND status = 'assessed'
UNION ALL SELECT '2', 'alert recall', round(sum(code) / nullif(sum(code + 30), 0), 6), round(sum(code - 1) / nullif(sum(code + 30), 0), 6), NULL, NULL, count(*) FROM ri WHERE multiplier = 1.2 AND status = 'assessed'
UNION ALL SELECT '3a', 'regions at risk now', sum(CASE WHEN surge_risk >= 0.5 THEN 1.0 ELSE 0 END), NULL, NULL, NULL, count(*) FROM ri WHERE multiplier = 1.2 AND status = 'assessed'
UNION ALL SELECT '2', 'excess avoided by the forecast', round((SELECT avg(e) FROM ef WHERE multiplier = 1.2), 6), NULL, (SELECT round(min(m), 6) FROM sp), (SELECT round(max(m), 6) FROM sp), (SELECT count(e) FROM ef WHERE multiplier = 1.2)""")
def headline_rows(spark, d):
    c = F.col("code")
    alerts = _risk(spark, d).withColumns({"tp_ai": c, "alerts_ai": c + 10, "tp_base": c - 1, "alerts_base": c + 20, "actual_days": c + 30})
    effect = _runs(spark, d).where("n_new = 3").groupBy("code", "n_new", "multiplier").agg(F.when(F.sum("baseline_over_kwh") > 0, 1 - F.sum("over_kwh") / F.sum("baseline_over_kwh")).alias("effect"))
    return rounded(priority.headline_rows(risk=alerts, effect=effect))


@query("top_industries", "SELECT p_type AS industry, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY sum(l_extendedprice) DESC, 1 LIMIT 5")
def top_industries(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_type").alias("industry"), F.col("l_extendedprice").alias("value"))
    return rounded(priority.top_industries(rows, 5), 2)


@query("peak_hours", "SELECT CAST(hour AS INTEGER) AS hour FROM (SELECT hour(ts) AS hour, sum(value) AS v FROM events GROUP BY 1 ORDER BY v DESC, hour LIMIT 4)")
def peak_hours(spark, d):
    c = table(spark, d, "events").groupBy(F.hour("ts").alias("hour")).agg(F.sum("value").alias("kwh"))
    return spark.createDataFrame([(h,) for h in sessions.peak_hours(c)], "hour int")


@query("attached_features", """SELECT n_nationkey AS code, CAST(coalesce(s.n, 0) AS BIGINT) AS n_suppliers, round(c.bal, 4) AS balance FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON n_nationkey = s_nationkey
LEFT JOIN (SELECT c_nationkey, avg(c_acctbal) AS bal FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1) c ON n_nationkey = c_nationkey""")
def attached_features(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("code")).agg(F.count("*").alias("n_suppliers"))
    c = table(spark, d, "customer").where("c_custkey % 3 = 0").groupBy(F.col("c_nationkey").alias("code")).agg(F.avg("c_acctbal").alias("balance"))
    return rounded(priority.attached(table(spark, d, "nation").select(F.col("n_nationkey").alias("code")), [s, c], ("n_suppliers",)), 4)


@query("reconciled_codes", """WITH o AS (SELECT s_suppkey AS old, s_nationkey AS prefix, s_suppkey % 4 AS name FROM supplier), k AS (SELECT c_custkey AS code, c_nationkey AS prefix, c_custkey % 4 AS name FROM customer WHERE c_custkey % 5 = 0),
m AS (SELECT old, code, CASE WHEN (old + code) % 3 = 0 THEN CAST((old * code) % 50 AS DOUBLE) ELSE 0.0 END AS score FROM o LEFT JOIN k USING (prefix, name)), b AS (SELECT old, max(score) AS best, count(code) AS n FROM m GROUP BY 1),
t AS (SELECT m.old, n, count(code) AS tied, min(code) AS code FROM m JOIN b ON m.old = b.old AND score = best GROUP BY 1, 2)
SELECT old, CASE WHEN n > 0 AND tied = 1 THEN code END AS code, CASE WHEN n = 0 THEN 'unknown' WHEN tied > 1 THEN 'ambiguous' ELSE 'matched' END AS status FROM t""")
def reconciled_codes(spark, d):
    old = table(spark, d, "supplier").select(F.col("s_suppkey").alias("old"), F.col("s_nationkey").alias("prefix"), (F.col("s_suppkey") % 4).alias("name"))
    known = table(spark, d, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("code"), F.col("c_nationkey").alias("prefix"), (F.col("c_custkey") % 4).alias("name"))
    overlap = old.join(known, ["prefix", "name"]).where("(old + code) % 3 = 0").select("old", "code", ((F.col("old") * F.col("code")) % 50).cast("double").alias("score"))
    return priority.reconciled(old, known, overlap)


@query("quadrants", """SELECT s_suppkey AS code, CASE WHEN s_suppkey % 3 = 0 THEN CASE WHEN s_acctbal > 4000 THEN 'high_load' ELSE 'low_load' END WHEN s_acctbal > 4000 AND s_nationkey > 10 THEN 'high_load_strong' WHEN s_acctbal > 4000 THEN 'high_load_weak' WHEN s_nationkey > 10 THEN 'low_load_strong' ELSE 'low_load_weak' END AS quadrant FROM supplier""")
def quadrants(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("code"), "s_acctbal", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey")).alias("effect"))
    return cube.quadrants(s, "s_acctbal", "effect", 4000, 10).select("code", "quadrant")


# vehicles, distances and effects that had no equivalent
_PAIRS = f"""lg AS (SELECT user_id, ts, event_id, 37.4::DOUBLE + CAST(event_id * 7919 % 1000 AS DOUBLE) / 4000 AS lat, CASE WHEN event_id % 7 <> 0 THEN 126.8::DOUBLE + CAST(event_id * 104729 % 1000 AS DOUBLE) / 3000 END AS lon FROM events),
lq AS (SELECT *, lag(ts) OVER w AS t0, lag(lat) OVER w AS a0, lag(lon) OVER w AS o0 FROM lg WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
pq AS (SELECT user_id, (epoch_us(ts) - epoch_us(t0)) / 1e6 / 60 AS m, {km_sql('a0', 'o0', 'lat', 'lon')} AS km, a0, o0, lon FROM lq WHERE t0 IS NOT NULL),
ps AS (SELECT user_id, CASE WHEN o0 IS NULL OR lon IS NULL THEN NULL WHEN m > 0 THEN km / m * 60 WHEN km > 0.5 THEN 1e300 ELSE 0 END AS kmh FROM pq WHERE m BETWEEN 0 AND 600)"""


def _log(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id")
    return e.select("user_id", "ts", "event_id", (F.lit(37.4) + F.expr("cast(event_id * 7919 % 1000 as double)") / 4000).alias("lat"), F.when(k % 7 != 0, F.lit(126.8) + F.expr("cast(event_id * 104729 % 1000 as double)") / 3000).alias("lon"))


@query("id_verdict", f"""WITH {_PAIRS}, pr AS (SELECT user_id, count(*) AS n, avg(CASE WHEN kmh > 20 THEN 1 WHEN kmh IS NOT NULL THEN 0 END) AS s FROM ps GROUP BY 1),
t AS (SELECT sum(n) AS np, sum(s * n) AS nb, count(CASE WHEN n >= 5 THEN 1 END) AS nj, count(CASE WHEN n >= 5 AND s > 0.05 THEN 1 END) AS ni FROM pr)
SELECT CAST(coalesce(np, 0) AS BIGINT) AS n_pairs, round(nb / nullif(np, 0), 6) AS bad_share, round(ni / nullif(CAST(nj AS DOUBLE), 0), 6) AS bad_id_share,
CASE WHEN np < 5 THEN 'unknown' WHEN nb / nullif(np, 0) > 0.05 OR ni / nullif(CAST(nj AS DOUBLE), 0) > 0.2 THEN 'model' ELSE 'individual' END AS verdict FROM t""")
def id_verdict(spark, d):
    return rounded(sessions.key_verdict(sessions.pair_speeds(_log(spark, d), "user_id", max_minutes=600), "user_id", 100, 20.0))


@query("away_from_home", f"""WITH {_PAIRS}, r AS (SELECT user_id, user_id % 10 AS region, CASE WHEN lon IS NOT NULL THEN {km_sql('lat', 'lon', '37.5::DOUBLE', '127.0::DOUBLE')} END AS km FROM lg WHERE user_id % 3 <> 0),
p AS (SELECT user_id, region, count(*) AS n, count(CASE WHEN km > 5 THEN 1 END) AS na, avg(CASE WHEN km > 5 THEN km END) AS ak FROM r GROUP BY 1, 2)
SELECT region, CAST(count(*) AS BIGINT) AS n_vehicles, round(sum(na) / sum(n), 6) AS away_ratio, round(avg(CASE WHEN n = na THEN 1 ELSE 0 END), 6) AS no_home_share, round(avg(ak), 6) AS away_km FROM p GROUP BY 1""")
def away_from_home(spark, d):
    log = _log(spark, d).withColumn("region", F.col("user_id") % 10)
    homes = log.select("user_id").distinct().where("user_id % 3 <> 0").select("user_id", F.lit(37.5).alias("lat"), F.lit(127.0).alias("lon"))
    return rounded(sessions.away_charging(log, homes, "user_id", "region", 5.0))


_STOCKS = """st AS (SELECT c_nationkey AS code, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS mi, CAST(count(*) % 97 AS DOUBLE) / 97 AS open_rate FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
un AS (SELECT n_nationkey AS code, CASE WHEN n_nationkey % 3 = 0 THEN 23976 + (n_nationkey % 4) * 3 END AS g FROM nation)"""


@query("opening_contamination", f"""WITH {_STOCKS}, co AS (SELECT DISTINCT g AS cohort FROM un WHERE g IS NOT NULL), r AS (SELECT st.code, g, cohort, avg(CASE WHEN mi >= cohort AND mi < cohort + 3 THEN open_rate END) / nullif(avg(CASE WHEN mi < cohort AND mi >= cohort - 3 THEN open_rate END), 0) AS r
FROM st JOIN un USING (code), co WHERE g IS NULL OR g = cohort GROUP BY 1, 2, 3), c AS (SELECT cohort, median(r) AS c FROM r WHERE g IS NULL GROUP BY 1)
SELECT r.code, r.cohort, round(r.r, 6) AS own_ratio, round(c.c, 6) AS control_ratio, round(r.r / nullif(c.c, 0), 6) AS relative, CASE WHEN r.r IS NULL THEN 'not_computable' WHEN c.c IS NULL THEN 'no_control' WHEN r.r / nullif(c.c, 0) > 1.5 THEN 'contaminated' ELSE 'clean' END AS verdict
FROM r LEFT JOIN c ON r.cohort = c.cohort WHERE g IS NOT NULL""")
def opening_contamination(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rates = o.groupBy(F.col("c_nationkey").alias("code"), (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).alias("mi")).agg(((F.count("*") % 97).cast("double") / 97).alias("open_rate"))
    units = table(spark, d, "nation").select(F.col("n_nationkey").alias("code"), F.when(F.col("n_nationkey") % 3 == 0, 23976 + (F.col("n_nationkey") % 4).cast("int") * 3).alias("g"))
    return rounded(causal.contamination(rates, units))


@query("effects_by_cell", f"""WITH {_OUT}, o AS (SELECT code, treated, delta, predicted AS f1, CAST(code % 11 AS DOUBLE) AS f2 FROM oc), c AS (SELECT median(f1) AS a, median(f2) AS b FROM o), h AS (SELECT o.*, CASE WHEN f1 >= a THEN 'H' ELSE 'L' END || CASE WHEN f2 >= b THEN 'H' ELSE 'L' END AS cell FROM o, c),
t AS (SELECT avg(CASE WHEN treated THEN delta END) - avg(CASE WHEN NOT treated THEN delta END) AS ate FROM h)
SELECT cell, round(coalesce(avg(CASE WHEN treated THEN delta END) - avg(CASE WHEN NOT treated THEN delta END), max(ate)), 6) AS cate, round(sqrt(var_samp(CASE WHEN treated THEN delta END) / nullif(count(CASE WHEN treated THEN 1 END), 0) + var_samp(CASE WHEN NOT treated THEN delta END) / nullif(count(CASE WHEN NOT treated THEN 1 END), 0)), 6) AS se,
CAST(count(CASE WHEN treated THEN 1 END) AS BIGINT) AS n_treated, CAST(count(CASE WHEN NOT treated THEN 1 END) AS BIGINT) AS n_control FROM h, t GROUP BY cell""")
def effects_by_cell(spark, d):
    o = _outcomes(spark, d).withColumns({"f1": F.col("predicted"), "f2": (F.col("code") % 11).cast("double")})
    return rounded(causal.cell_effects(o, "f1", "f2"))


def _near_sql(km: float, stations: str = "s") -> str:
    return f"pn AS (SELECT p.code, s.station, chargers, p.ev, {km_sql('p.lat', 'p.lon', 's.lat', 's.lon')} AS km FROM p, {stations} s), pk AS (SELECT * FROM pn WHERE km <= {km}), dm AS (SELECT station, chargers, sum(ev) AS dem FROM pk GROUP BY 1, 2), af AS (SELECT pk.code, sum(CASE WHEN dem > 0 THEN dm.chargers / dem ELSE 0 END) AS access FROM pk JOIN dm USING (station) GROUP BY 1)"


@query("access_after_adding", f"""WITH p0 AS (SELECT 1), {POINTS_SQL}, {STATIONS_SQL}, v AS (SELECT CAST(station AS VARCHAR) AS station, lat, lon, chargers FROM s UNION ALL SELECT 'virtual_' || CAST(code AS VARCHAR), lat, lon, 3.0 FROM p WHERE code % 25 = 0), {_near_sql(2.0, 'v')}
SELECT p.code, round(coalesce(access, 0.0), 9) AS access FROM p LEFT JOIN af ON p.code = af.code""")
def access_after_adding(spark, d):
    p, s = points(spark, d), stations(spark, d).withColumn("station", F.col("station").cast("string"))
    out = spatial.added_chargers(s, p, {"chosen": p.where("code % 25 = 0").select("code")}, 3.0, 2.0)
    return out.where("strategy = 'chosen'").select("code", F.round("access", 9).alias("access"))


@query("access_improvement", """WITH a AS (SELECT c_custkey AS code, c_acctbal AS x, c_acctbal + c_custkey % 5 AS y FROM customer) SELECT round(avg(x), 6) AS before, round(avg(y), 6) AS after, round((avg(y) - avg(x)) / nullif(avg(x), 0), 6) AS gain FROM a WHERE code % 4 = 0""")
def access_improvement(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("code"), F.col("c_acctbal").alias("access"))
    after = c.withColumn("access", F.col("access") + F.col("code") % 5)
    return rounded(priority.improvement(c, after, c.where("code % 4 = 0")))


@query("access_by_strategy", """WITH a AS (SELECT CASE c_custkey % 2 WHEN 0 THEN 'before' ELSE 'chosen' END AS strategy, CASE WHEN c_custkey % 7 < 2 THEN 0.0 ELSE c_acctbal END AS access, c_custkey % 5 = 0 AS low FROM customer)
SELECT strategy, CAST(count(CASE WHEN access = 0 THEN 1 END) AS BIGINT) AS n_zero, round(avg(CASE WHEN low THEN access END), 6) AS mean_low, round(avg(CASE WHEN NOT low THEN access END), 6) AS mean_rest FROM a GROUP BY 1""")
def access_by_strategy(spark, d):
    k = F.col("c_custkey")
    a = table(spark, d, "customer").select(k.alias("code"), F.when(k % 2 == 0, "before").otherwise("chosen").alias("strategy"), F.when(k % 7 < 2, 0.0).otherwise(F.col("c_acctbal")).alias("access"))
    return rounded(spatial.access_gap(a, a.where("code % 5 = 0").select("code")))


@query("slope_catchment", f"""WITH {POINTS_SQL}, {STATIONS_SQL}, x AS (SELECT p.code, s.station, chargers, ev, {km_sql('p.lat', 'p.lon', 's.lat', 's.lon')} AS km, CAST(p.code % 90 AS DOUBLE) AS z, CAST(s.station % 70 AS DOUBLE) AS zs FROM p, s),
g AS (SELECT *, least(greatest(CASE WHEN km * 1000 >= 50 THEN (zs - z) / nullif(km * 1000, 0) ELSE 0 END, -0.3), 0.3) AS gr FROM x WHERE km <= 3),
q AS (SELECT code, station, chargers, ev FROM g WHERE km * greatest((exp(-3.5 * 0.05) / exp(-3.5 * abs(gr + 0.05)) + exp(-3.5 * 0.05) / exp(-3.5 * abs(-gr + 0.05))) / 2, 1.0) <= 3), dm AS (SELECT station, chargers, sum(ev) AS dem FROM q GROUP BY 1, 2),
af AS (SELECT q.code, sum(CASE WHEN dem > 0 THEN dm.chargers / dem ELSE 0 END) AS a FROM q JOIN dm USING (station) GROUP BY 1) SELECT p.code, round(coalesce(a, 0.0), 9) AS access FROM p LEFT JOIN af ON p.code = af.code""")
def slope_catchment(spark, d):
    p = points(spark, d).withColumn("elev", (F.col("code") % 90).cast("double"))
    s = stations(spark, d).withColumn("elev_station", (F.col("station") % 70).cast("double"))
    return spatial.catchment(s, p, 3.0, spatial.slope_distance()).select("code", F.round("access", 9).alias("access"))


# publishing
@query("shown_numbers", """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '—' WHEN abs(value * 40) >= 1000 THEN format('{:,}', CAST(round_even(value * 40, 0) AS BIGINT)) ELSE format('{:.2f}', round_even(value * 40, 2)) END AS shown FROM events WHERE event_id % 3 <> 1""")
def shown_numbers(spark, d):
    v = F.when(F.col("event_id") % 9 != 0, F.col("value") * 40)
    return table(spark, d, "events").where("event_id % 3 <> 1").select("event_id", publish.shown_number(v, 2).alias("shown"))


@query("without_small_examples", """SELECT c_custkey AS code, CASE WHEN c_custkey % 2 = 0 THEN 'treated' ELSE 'never' END AS status FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey WHERE coalesce(n, 0) >= 8""")
def without_small_examples(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("code"), F.when(F.col("c_custkey") % 2 == 0, "treated").otherwise("never").alias("status"))
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("code")).agg(F.count("*").alias("n"))
    return publish.without_small_examples(c, counts, 8)[0]


@query("preflight_checks", """WITH m AS (SELECT (SELECT count(*) FROM nation) AS cand, (SELECT count(DISTINCT l_linenumber) FROM lineitem) AS bands, (SELECT avg(CASE WHEN c_custkey % 4 = 0 THEN 1.0 ELSE 0 END) FROM customer) AS un, (SELECT count(DISTINCT CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 0 WHEN month(o_orderdate) < 6 THEN 1 WHEN month(o_orderdate) < 9 THEN 2 ELSE 3 END) FROM orders) AS se)
SELECT CAST(i AS INTEGER) AS number, CASE i WHEN 2 THEN cand WHEN 3 THEN bands WHEN 5 THEN round(un, 6) WHEN 13 THEN se END AS x, CASE i WHEN 2 THEN CASE WHEN cand < 10 THEN 'fail' WHEN cand < 30 THEN 'warn' ELSE 'pass' END WHEN 3 THEN CASE WHEN bands < 4 THEN 'warn' ELSE 'pass' END
WHEN 5 THEN CASE WHEN un > 0.3 THEN 'fail' WHEN un > 0.1 THEN 'warn' ELSE 'pass' END WHEN 13 THEN CASE WHEN se < 4 THEN 'warn' ELSE 'pass' END ELSE 'n.a.' END AS verdict FROM m, (SELECT unnest(range(1, 22)) AS i)""")
def preflight_checks(spark, d):
    month = F.month("o_orderdate")
    seasons = table(spark, d, "orders").agg(F.countDistinct(F.when(month.isin(12, 1, 2), 0).when(month < 6, 1).when(month < 9, 2).otherwise(3)).alias("seasons_covered"))
    metrics = table(spark, d, "nation").agg(F.count("*").alias("n_candidates")).crossJoin(table(spark, d, "lineitem").agg(F.countDistinct("l_linenumber").alias("n_bands")))
    metrics = metrics.crossJoin(table(spark, d, "customer").agg(F.avg((F.col("c_custkey") % 4 == 0).cast("int")).alias("unmatched_share"))).crossJoin(seasons)
    return rounded(publish.preflight(metrics).select("number", "x", "verdict"))


@query("cross_checked", """WITH a AS (SELECT s_suppkey AS code, s_acctbal AS x, CASE WHEN s_suppkey % 5 = 0 THEN s_acctbal + 1 ELSE round(s_acctbal, 1) END AS y FROM supplier), r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM a)
SELECT CAST(count(*) AS BIGINT) AS n_both, CAST(count(CASE WHEN abs(x - y) <= 0.05 + 1e-12 THEN 1 END) AS BIGINT) AS n_agree, round(corr(rx, ry), 6) AS spearman FROM r""")
def cross_checked(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_acctbal").alias("v"))
    printed = s.select("code", F.when(F.col("code") % 5 == 0, F.col("v") + 1).otherwise(F.round("v", 1)).alias("v"))
    return rounded(publish.cross_checked(s, printed, "v", 1))


@query("without_raw", "SELECT s_suppkey AS code, s_name AS name FROM supplier")
def without_raw(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("kwh"), F.lit(37.5).alias("lat"), F.lit(127.0).alias("lon"))
    return publish.refuse_positions(publish.without_raw(s))


@query("cells_of_log", """SELECT CAST(floor((37.4::DOUBLE + CAST(event_id * 7919 % 1000 AS DOUBLE) / 4000) / (500 / 111000.0::DOUBLE)) AS BIGINT)::VARCHAR || '_' || CAST(floor((126.8::DOUBLE + CAST(event_id * 104729 % 1000 AS DOUBLE) / 3000) / (500 / 111000.0::DOUBLE / 0.8)) AS BIGINT)::VARCHAR AS cell, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_id % 7 <> 0 GROUP BY 1""")
def cells_of_log(spark, d):
    return sessions.with_cell(_log(spark, d).where("lon is not null"), 500).groupBy("cell").agg(F.count("*").alias("n"))


@query("usable_issues", f"WITH {_WEATHER} SELECT station, epoch_us(issued_at) AS issued, forecast FROM w WHERE issued_at <= date_trunc('day', ts) - INTERVAL 6 HOUR")
def usable_issues(spark, d):
    w = inputs.weather_issues(_weather(spark, d)).where("issued_at is not null").withColumn("issued_at", F.col("issued_at").cast("timestamp")).withColumn("cutoff", F.date_trunc("day", F.col("ts").cast("timestamp")) - F.make_dt_interval(F.lit(0), F.lit(6)))
    return twins.usable_issues(w).select("station", F.unix_micros("issued_at").alias("issued"), "forecast")


@query("sliding_week", """WITH e AS (SELECT user_id, value, CAST(ts AS DATE) AS d FROM events), w AS (SELECT user_id, value, CAST(d + k AS TIMESTAMP) AS until FROM e, (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS k))
SELECT user_id, epoch_us(until) AS until, round(avg(value), 6) AS mean, max(value) AS peak, CAST(count(*) AS BIGINT) AS n FROM w GROUP BY 1, 2""")
def sliding_week(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return twins.sliding_week(e).select("user_id", F.unix_micros("until").alias("until"), F.round("mean", 6).alias("mean"), "peak", "n")


@query("known_elevations", """WITH p AS (SELECT c_custkey AS code, round(37 + (c_custkey % 50) / 1000.0, 3) AS lat, round(127 + (c_custkey % 7) / 1000.0, 3) AS lon FROM customer), k AS (SELECT round(37 + (s_suppkey % 60) / 1000.0, 3) AS lat, round(127 + (s_suppkey % 5) / 1000.0, 3) AS lon, avg(CASE WHEN s_acctbal BETWEEN -100 AND 3000 THEN s_acctbal END) AS e FROM supplier GROUP BY 1, 2)
SELECT code, round(e, 6) AS elev FROM p LEFT JOIN k ON abs(p.lat - k.lat) < 1e-6 AND abs(p.lon - k.lon) < 1e-6""")
def known_elevations(spark, d):
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("code"), (F.lit(37) + (F.col("c_custkey") % 50) / 1000.0 + 0.0001).alias("lat"), (F.lit(127) + (F.col("c_custkey") % 7) / 1000.0).alias("lon"))
    k = table(spark, d, "supplier").select((F.lit(37) + (F.col("s_suppkey") % 60) / 1000.0).alias("lat"), (F.lit(127) + (F.col("s_suppkey") % 5) / 1000.0 - 0.0001).alias("lon"), F.col("s_acctbal").alias("elev"))
    return rounded(spatial.with_elevation(p, k)[0].select("code", "elev"))


@query("competition_ranks", "SELECT s_suppkey AS code, CASE WHEN s_suppkey % 4 <> 0 THEN CAST(rank() OVER (PARTITION BY s_suppkey % 4 <> 0 ORDER BY s_nationkey) AS INTEGER) END AS place FROM supplier")
def competition_ranks(spark, d):
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("code"), expr.competition_rank("s_nationkey", F.col("s_suppkey") % 4 != 0).alias("place"))


@query("customer_counts", "SELECT c_nationkey AS code, CAST(max(n) AS BIGINT) AS most, CAST(min(n) AS BIGINT) AS least FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1")
def customer_counts(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("code"), "c_mktsegment").agg(F.count("*").alias("n"))
    most, least = (publish.period_customers(c, "n", how) for how in ("max", "min"))
    return most.select("code", F.col("n").alias("most")).join(least.select("code", F.col("n").alias("least")), "code")


@query("log_regions", """SELECT user_id % 10 AS region, CAST(count(*) AS BIGINT) AS n_sessions, CAST(count(DISTINCT user_id) AS BIGINT) AS n_vehicles, round(avg(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END), 6) AS base_share, round(count(*) / 30.0, 6) AS per_day FROM events GROUP BY 1 HAVING count(DISTINCT user_id) >= 2""")
def log_regions(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 10).alias("region"), "user_id", (F.col("event_id") % 3 == 0).alias("is_base"))
    return rounded(sessions.regional_sessions(e, "user_id", "region", 30, 2))


# sales in one scan: suppliers stand for towns, flags for groups and origins
@query("sales_scan", """WITH r AS (SELECT CASE WHEN l_suppkey % 20 <> 3 THEN '11000' || lpad(CAST(l_suppkey % 20 AS VARCHAR), 5, '0') END AS code, CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS INTEGER) AS mi,
CASE WHEN l_returnflag = 'A' THEN 'wait' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'placebo' WHEN l_returnflag = 'N' THEN 'control_ref' ELSE 'other' END AS grp, CASE WHEN l_linenumber = 1 THEN 'resident' WHEN l_linenumber = 7 THEN 'unknown' ELSE 'outsider' END AS origin,
CASE WHEN l_partkey % 10 <> 0 THEN l_quantity END AS value, l_partkey % 10 = 0 AS masked, l_linestatus AS sex, CAST(l_linenumber AS VARCHAR) AS dist FROM lineitem),
u AS (SELECT 'cells' AS set, code, mi, grp AS label, origin AS label2, coalesce(sum(value), 0) AS s, count(value) AS n_valid, count(*) AS n_rows, count(CASE WHEN masked THEN 1 END) AS n_masked FROM r WHERE code IS NOT NULL AND mi IS NOT NULL AND grp <> 'other' AND origin <> 'unknown' GROUP BY 2, 3, 4, 5
UNION ALL SELECT 'by_group', code, mi, grp, NULL, coalesce(sum(value), 0), NULL, count(*), NULL FROM r WHERE code IS NOT NULL AND mi IN (23953, 23954) GROUP BY 2, 3, 4
UNION ALL SELECT 'by_sex', code, mi, sex, NULL, coalesce(sum(value), 0), NULL, count(*), NULL FROM r WHERE code IS NOT NULL AND mi IN (23953, 23954) GROUP BY 2, 3, 4
UNION ALL SELECT 'distances', NULL, NULL, dist, NULL, NULL, NULL, count(*), count(CASE WHEN masked THEN 1 END) FROM r GROUP BY 4
UNION ALL SELECT 'all', NULL, NULL, NULL, NULL, NULL, count(CASE WHEN code IS NULL THEN 1 END), count(*), count(CASE WHEN masked THEN 1 END) FROM r)
SELECT set, code, mi, label, label2, round(CAST(s AS DOUBLE), 4) AS s, n_valid, n_rows, n_masked FROM u""")
def sales_scan(spark, d):
    """Cells, snapshots by group and attribute, labels seen and totals, all from one read."""
    i = table(spark, d, "lineitem")
    code = F.when(F.col("l_suppkey") % 20 != 3, F.lpad((F.col("l_suppkey") % 20).cast("string"), 5, "0"))
    raw = i.select(
        F.col("l_shipdate").cast("string").alias("ym"), F.lit("11").alias("sido"), F.lit("11000").alias("sgg"), F.concat(F.lit("11000"), code).alias("umd"), F.col("l_returnflag").alias("bidvs"), F.col("l_linestatus").alias("medvs"), F.col("l_linenumber").cast("string").alias("dist"),
        F.when(F.col("l_partkey") % 10 == 0, "*").otherwise(F.col("l_quantity").cast("string")).alias("metric"), F.col("l_linestatus").alias("sex"),
    )
    found = sales.scanned(sales.typed_sales(raw, ["A"], ["N"], ["N:O"], unknown=["7"]), [23953, 23954])
    shot, whole = F.col("set").startswith("by_"), F.col("set").isin("distances", "all")
    label = F.coalesce(F.when(F.col("set") == "by_sex", F.col("sex")), F.when(F.col("set") == "distances", F.col("dist")), F.when(F.col("set").isin("cells", "by_group"), F.col("group")))
    value = F.when(F.col("set") == "cells", F.coalesce("use_s", F.lit(0.0))).when(shot, F.coalesce("shot_s", F.lit(0.0)))
    out = found.where("set in ('cells', 'by_group', 'by_sex', 'distances', 'all')").select(
        "set", "code", "mi", label.alias("label"), F.when(F.col("set") == "cells", F.col("origin")).alias("label2"), F.round(value.cast("double"), 4).alias("s"),
        F.when(F.col("set") == "cells", F.col("use_valid")).when(F.col("set") == "all", F.col("bad_region_rows")).alias("n_valid"), F.when(F.col("set") == "cells", F.col("use_rows")).when(shot, F.col("shot_rows")).otherwise(F.col("rows")).alias("n_rows"),
        F.when(F.col("set") == "cells", F.col("use_masked")).when(whole, F.col("masked_rows")).alias("n_masked"),
    )
    return out


_BELT = 'PROJCS["Central belt",GEOGCS["Korea 2000",DATUM["Korea",SPHEROID["GRS 1980",6378137,298.257222101]],UNIT["degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",38],PARAMETER["central_meridian",127],PARAMETER["scale_factor",1],PARAMETER["false_easting",200000],PARAMETER["false_northing",600000],UNIT["metre",1]]'


@query("grid_tiles", f"""WITH {POINTS_SQL}, k AS (SELECT 6378137.0::DOUBLE AS a, 1 / 298.257222101::DOUBLE AS f), e AS (SELECT a, f * (2 - f) AS e2 FROM k),
g AS (SELECT code, ev, radians(lat) AS p, (radians(lon) - radians(127.0::DOUBLE)) * cos(radians(lat)) AS w, a, e2, e2 / (1 - e2) AS ep, a / sqrt(1 - e2 * pow(sin(radians(lat)), 2)) AS n, pow(tan(radians(lat)), 2) AS t, e2 / (1 - e2) * pow(cos(radians(lat)), 2) AS c FROM p, e),
m AS (SELECT *, a * ((1 - e2 / 4 - 3 * pow(e2, 2) / 64 - 5 * pow(e2, 3) / 256) * p - (3 * e2 / 8 + 3 * pow(e2, 2) / 32 + 45 * pow(e2, 3) / 1024) * sin(2 * p) + (15 * pow(e2, 2) / 256 + 45 * pow(e2, 3) / 1024) * sin(4 * p) - 35 * pow(e2, 3) / 3072 * sin(6 * p)) AS arc,
a * ((1 - e2 / 4 - 3 * pow(e2, 2) / 64 - 5 * pow(e2, 3) / 256) * radians(38.0::DOUBLE) - (3 * e2 / 8 + 3 * pow(e2, 2) / 32 + 45 * pow(e2, 3) / 1024) * sin(2 * radians(38.0::DOUBLE)) + (15 * pow(e2, 2) / 256 + 45 * pow(e2, 3) / 1024) * sin(4 * radians(38.0::DOUBLE)) - 35 * pow(e2, 3) / 3072 * sin(6 * radians(38.0::DOUBLE))) AS arc0 FROM g),
xy AS (SELECT ev, 200000 + n * (w + (1 - t + c) * pow(w, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * pow(w, 5) / 120) AS x,
600000 + arc - arc0 + n * tan(p) * (w * w / 2 + (5 - t + 9 * c + 4 * c * c) * pow(w, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * pow(w, 6) / 720) AS y FROM m)
SELECT CAST(floor(x / 5000) AS BIGINT) AS east, CAST(floor(y / 5000) AS BIGINT) AS north, count(*) AS n, round(sum(ev), 2) AS ev FROM xy GROUP BY 1, 2""")
def grid_tiles(spark, d):
    """Places counted by tiles of 5 km of a grid that well-known text describes."""
    x, y = projection.grid_of(_BELT).forward("lat", "lon")
    tiles = points(spark, d).select(F.floor(x / 5000).alias("east"), F.floor(y / 5000).alias("north"), "ev")
    return rounded(tiles.groupBy("east", "north").agg(F.count("*").alias("n"), F.sum("ev").alias("ev")), 2)
