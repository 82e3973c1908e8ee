"""Queries of the cube, profile and channel operators, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr
from ..operators import cube as ops
from .standins import CUBE_SQL, cube, hourly, hourly_sql, rounded, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _profile(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("code"), F.hour("ts").alias("hour")).agg(F.sum("value").alias("kwh"), F.countDistinct(F.to_date("ts")).alias("n_days"))


_PROFILE = "pr AS (SELECT user_id AS code, CAST(hour(ts) AS INTEGER) AS hour, sum(value) AS kwh, count(DISTINCT CAST(ts AS DATE)) AS n_days FROM events GROUP BY 1, 2)"


@query("concentration", f"""WITH {_PROFILE}, m AS (SELECT code, hour, round(kwh / n_days, 9) AS v FROM pr),
a AS (SELECT code, max(v) / sum(v) AS c, sum(v) AS daily_kwh, max(v) AS peak_avg_kw, count(v) AS n_hours FROM m GROUP BY code),
r AS (SELECT code, hour, row_number() OVER (PARTITION BY code ORDER BY v DESC, hour) AS k FROM m),
q AS (SELECT a.code, round(c, 6) AS concentration, round(daily_kwh, 6) AS daily_kwh, round(peak_avg_kw, 6) AS peak_avg_kw, CAST(hour AS INTEGER) AS peak_hour, CAST(n_hours AS BIGINT) AS n_hours FROM a JOIN r ON a.code = r.code AND k = 1)
SELECT *, CASE WHEN concentration > (SELECT median(concentration) FROM q) THEN 'high' ELSE 'low' END AS load_type FROM q""")
def concentration(spark, d):
    p = _profile(spark, d).withColumn("kwh", F.round(F.col("kwh") / F.col("n_days"), 9)).withColumn("n_days", F.lit(1))
    return ops.classify_load(rounded(ops.concentration(p)))


@query("hour_cube", """SELECT o.o_orderpriority AS name, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS mi, l_linenumber AS hour, sum(l_quantity) AS kwh,
CAST(count(*) AS BIGINT) AS n_days, round(sum(l_tax), 6) AS cust_sum, min(l_tax) AS cust_min FROM lineitem JOIN orders o ON l_orderkey = o_orderkey GROUP BY 1, 2, 3""")
def hour_cube(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("name"), expr.month_index(F.to_date("o_orderdate")).alias("mi"))
    rows = table(spark, d, "lineitem").join(o, "l_orderkey").select("name", "mi", F.col("l_linenumber").alias("hour"), F.col("l_quantity").alias("kwh"), F.lit(1).cast("long").alias("days"), F.col("l_tax").alias("cust"))
    return rounded(ops.hour_cube(rows, ["name", "mi", "hour"]))


@query("attach_codes", f"""WITH {CUBE_SQL} SELECT CAST(s_nationkey AS BIGINT) AS code, mi, hour, sum(kwh) AS kwh, max(n_days) AS n_days, round(sum(cust_sum), 6) AS cust_sum, min(cust_min) AS cust_min
FROM c JOIN supplier ON c.code = s_suppkey WHERE s_nationkey % 5 <> 0 GROUP BY 1, 2, 3""")
def attach_codes(spark, d):
    codes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("name"), F.when(F.col("s_nationkey") % 5 != 0, F.col("s_nationkey").cast("long")).alias("code"))
    return rounded(ops.attach_codes(cube(spark, d).withColumnRenamed("code", "name"), codes, "name"))


@query("merge_units", f"""WITH {CUBE_SQL} SELECT CASE WHEN code % 4 = 1 THEN code - 1 ELSE code END AS code, mi, hour, sum(kwh) AS kwh, max(n_days) AS n_days, round(sum(cust_sum), 6) AS cust_sum, round(sum(cust_min), 6) AS cust_min FROM c GROUP BY 1, 2, 3""")
def merge_units(spark, d):
    heads = table(spark, d, "supplier").where("s_suppkey % 4 = 1").select(F.col("s_suppkey").alias("code"), (F.col("s_suppkey") - 1).alias("head"))
    return rounded(ops.merge_units(cube(spark, d), heads))


@query("small_heads", """WITH u AS (SELECT CAST(c_custkey AS VARCHAR) AS code, c_custkey % 13 AS count, CAST(c_custkey // 8 AS VARCHAR) AS district FROM customer),
g AS (SELECT district, sum(CASE WHEN count < 5 THEN 1 ELSE 0 END) AS ns, sum(CASE WHEN count >= 5 THEN 1 ELSE 0 END) AS nb, sum(CASE WHEN count < 5 THEN count END) AS ss FROM u GROUP BY 1),
hs AS (SELECT district, code FROM (SELECT *, row_number() OVER (PARTITION BY district ORDER BY count DESC, code) r FROM u WHERE count < 5) WHERE r = 1),
hb AS (SELECT district, code FROM (SELECT *, row_number() OVER (PARTITION BY district ORDER BY count DESC, code) r FROM u WHERE count >= 5) WHERE r = 1),
x AS (SELECT u.code, CASE WHEN nb = 0 OR ss >= 5 THEN hs.code ELSE hb.code END AS head FROM u JOIN g USING (district) LEFT JOIN hs USING (district) LEFT JOIN hb USING (district) WHERE u.count < 5 AND NOT (ns = 1 AND nb = 0))
SELECT code, head FROM x WHERE code <> head""")
def small_heads(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("code"), (F.col("c_custkey") % 13).alias("count"), F.expr("cast(c_custkey div 8 as string)").alias("district"), F.lit(1.0).alias("weight"))
    return ops.small_heads(c.select("code", "count"), c.select("district", "code", "weight"), 5)


@query("daily_series", f"WITH {CUBE_SQL} SELECT code, mi, round(sum(CASE WHEN n_days > 0 THEN kwh / n_days END), 6) AS daily_kwh FROM c GROUP BY 1, 2")
def daily_series(spark, d):
    return rounded(ops.daily_series(cube(spark, d)))


BANDS = {"dawn": [0, 1, 2, 3, 4, 5], "work": list(range(9, 18)), "evening": [18, 19, 20, 21]}


@query("band_shares", """WITH b AS (SELECT event_type AS name, sum(CASE WHEN hour(ts) <= 5 THEN value END) AS dawn, sum(CASE WHEN hour(ts) BETWEEN 9 AND 17 THEN value END) AS work,
sum(CASE WHEN hour(ts) BETWEEN 18 AND 21 THEN value END) AS evening FROM events GROUP BY 1)
SELECT name, round(coalesce(dawn / nullif(t, 0), 0), 6) AS dawn, round(coalesce(work / nullif(t, 0), 0), 6) AS work, round(coalesce(evening / nullif(t, 0), 0), 6) AS evening
FROM (SELECT *, coalesce(dawn, 0) + coalesce(work, 0) + coalesce(evening, 0) AS t FROM b)""")
def band_shares(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("name"), F.hour("ts").alias("hour"), F.col("value").alias("kwh"))
    return rounded(ops.band_shares(e, BANDS, "name"))


@query("monthly_totals", f"WITH {CUBE_SQL} SELECT mi, CAST(count(DISTINCT code) AS BIGINT) AS n_regions, round(sum(kwh), 6) AS kwh FROM c GROUP BY mi")
def monthly_totals(spark, d):
    return rounded(ops.monthly_totals(cube(spark, d)))


@query("contribution_exclusion", f"""WITH {CUBE_SQL}, ok AS (SELECT code, mi FROM c GROUP BY 1, 2 HAVING max(n_days) >= 3),
t AS (SELECT c.mi, count(DISTINCT c.code) AS n, sum(c.kwh) AS k FROM c JOIN ok ON c.code = ok.code AND c.mi = ok.mi GROUP BY 1)
SELECT m.mi, CAST(coalesce(n, 0) AS BIGINT) AS n_regions, round(coalesce(k, 0.0), 6) AS kwh FROM (SELECT DISTINCT mi FROM c) m LEFT JOIN t ON m.mi = t.mi""")
def contribution_exclusion(spark, d):
    c = cube(spark, d)
    return rounded(ops.monthly_totals(c, allowed=c.groupBy("code", "mi").agg(F.max("n_days").alias("n")).where("n >= 3")))


def _channels(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.date_trunc("month", "o_orderdate").cast("date").alias("month"), F.col("o_orderpriority").alias("prio"), "o_orderstatus", F.col("o_totalprice").alias("kwh"))
    whole = o.groupBy("month", "prio").agg(F.sum("kwh").alias("kwh"))
    return o.where("o_orderstatus = 'F'").groupBy("month", "prio").agg(F.sum("kwh").alias("kwh")), whole


_CH = """o AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderpriority AS prio, o_orderstatus AS st, o_totalprice AS kwh FROM orders),
w AS (SELECT month, prio, sum(kwh) AS whole FROM o GROUP BY 1, 2), p AS (SELECT month, prio, sum(kwh) AS part FROM o WHERE st = 'F' GROUP BY 1, 2)"""


@query("channel_ratio", f"WITH {_CH} SELECT CAST(month AS VARCHAR) AS month, prio, round(part, 4) AS part, round(whole, 4) AS whole, round(part / whole, 6) AS ratio FROM p JOIN w USING (month, prio) WHERE whole > 0")
def channel_ratio(spark, d):
    r = ops.channel_ratio(*_channels(spark, d), ["month", "prio"])
    return r.select(F.col("month").cast("string").alias("month"), "prio", F.round("part", 4).alias("part"), F.round("whole", 4).alias("whole"), F.round("ratio", 6).alias("ratio"))


@query("channel_ratio_quantiles", f"""WITH {_CH}, r AS (SELECT prio, part / whole AS ratio FROM p JOIN w USING (month, prio) WHERE whole > 0)
SELECT prio, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(ratio, 0.1), 6) AS p10, round(quantile_cont(ratio, 0.5), 6) AS p50, round(quantile_cont(ratio, 0.9), 6) AS p90, round(avg(CASE WHEN ratio > 1.0001 THEN 1 ELSE 0 END), 6) AS above FROM r GROUP BY prio""")
def channel_ratio_quantiles(spark, d):
    return rounded(ops.ratio_table(ops.channel_ratio(*_channels(spark, d), ["month", "prio"]), ["prio"]))


@query("containment_check", f"""WITH {_CH} SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN whole IS NOT NULL THEN 1 ELSE 0 END), 6) AS matched,
round(avg(CASE WHEN whole IS NOT NULL THEN CASE WHEN part <= whole * 1.0001 THEN 1 ELSE 0 END END), 6) AS not_above FROM p LEFT JOIN (SELECT * FROM w WHERE prio <> '5-LOW') x USING (month, prio)""")
def containment_check(spark, d):
    part, whole = _channels(spark, d)
    return rounded(ops.containment(part, whole.where("prio <> '5-LOW'"), ["month", "prio"]))


@query("monthly_surge", """WITH c AS (SELECT c_nationkey AS code, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS mi, o_orderpriority AS hour, sum(o_totalprice) AS kwh, count(*) AS n_days FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
pk AS (SELECT code, mi, max(kwh / n_days) AS peak FROM c GROUP BY 1, 2), l AS (SELECT max(mi) AS last FROM pk),
cal AS (SELECT code, max(CASE WHEN mi BETWEEN last - 17 AND last - 6 THEN peak END) AS cm, sum(CASE WHEN mi BETWEEN last - 17 AND last - 6 THEN 1 ELSE 0 END) AS nc, sum(CASE WHEN mi BETWEEN last - 5 AND last THEN 1 ELSE 0 END) AS ne, max(CASE WHEN mi BETWEEN last - 5 AND last THEN peak END) AS em FROM pk, l GROUP BY code),
g AS (SELECT * FROM cal, (SELECT unnest([0.8, 1.0, 1.2])::DOUBLE AS multiplier)),
s AS (SELECT g.code, multiplier, avg(CASE WHEN peak > multiplier * cm THEN 1 WHEN peak IS NOT NULL AND cm IS NOT NULL THEN 0 END) AS share FROM g LEFT JOIN (SELECT pk.* FROM pk, l WHERE mi BETWEEN last - 5 AND last) e ON g.code = e.code GROUP BY 1, 2),
z AS (SELECT g.code, g.multiplier, CASE WHEN nc < 9 OR ne = 0 THEN 'data_missing' WHEN cm <= 0 THEN 'not_assessed_low_load' ELSE 'assessed' END AS status, share, em / nullif(cm, 0) AS r FROM g JOIN s ON g.code = s.code AND g.multiplier = s.multiplier)
SELECT code, multiplier, status, round(CASE WHEN status = 'assessed' THEN share END, 6) AS surge_risk, round(CASE WHEN status = 'assessed' THEN r END, 6) AS peak_ratio_observed FROM z""")
def monthly_surge(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    c = o.groupBy(F.col("c_nationkey").alias("code"), (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).alias("mi"), F.col("o_orderpriority").alias("hour")).agg(F.sum("o_totalprice").alias("kwh"), F.count("*").alias("n_days"))
    last = c.agg(F.max("mi")).first()[0] or 0
    return rounded(ops.monthly_risk(c, spark.createDataFrame([(0.8,), (1.0,), (1.2,)], "multiplier double"), last))


@query("season_coverage", """SELECT CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' WHEN month(o_orderdate) BETWEEN 3 AND 5 THEN 'spring' WHEN month(o_orderdate) BETWEEN 6 AND 8 THEN 'summer' ELSE 'autumn' END AS season,
CAST(count(DISTINCT CAST(o_orderdate AS DATE)) AS BIGINT) AS n_dates, count(DISTINCT CAST(o_orderdate AS DATE)) >= 28 AS covered FROM orders GROUP BY 1""")
def season_coverage(spark, d):
    return ops.season_coverage(table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")))


@query("unpivot_hours", f"WITH {hourly_sql()} SELECT code, CAST(date AS VARCHAR) AS date, hour, kw AS kwh FROM h WHERE hour IN (6, 12, 18)")
def unpivot_hours(spark, d):
    wide = hourly(spark, d).groupBy("code", "date").pivot("hour", [6, 12, 18]).agg(F.first("kw"))
    return rounded(ops.unpivot_hours(wide.withColumnsRenamed({"6": "06:00", "12": "12:00", "18": "18:00"}), ["code", "date"], {"06:00": 6, "12:00": 12, "18:00": 18}))


@query("hours_from_zero", "SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour FROM events")
def hours_from_zero(spark, d):
    return ops.hours_from_zero(table(spark, d, "events").select("event_id", (F.hour("ts") + 1).alias("hour")))


@query("level_ratio", f"""WITH {CUBE_SQL}, s AS (SELECT code, mi, sum(kwh) AS v FROM c GROUP BY 1, 2),
r AS (SELECT code, mi, avg(v) OVER (PARTITION BY code ORDER BY mi RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING) AS a, avg(v) OVER (PARTITION BY code ORDER BY mi RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b FROM s)
SELECT code, mi, round(CASE WHEN b > 0 THEN a / b END, 9) AS level_ratio FROM r""")
def level_ratio(spark, d):
    from ..operators.timeseries import level_ratio as op

    series = cube(spark, d).groupBy("code", "mi").agg(F.sum("kwh").alias("daily_kwh"))
    return rounded(op(series, "code", "mi", "daily_kwh", 3).select("code", "mi", "level_ratio"), 9)


@query("activation_candidates", f"""WITH {CUBE_SQL}, s AS (SELECT code, mi, sum(kwh) AS v FROM c GROUP BY 1, 2),
r AS (SELECT code, avg(v) OVER (PARTITION BY code ORDER BY mi RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING) AS a, avg(v) OVER (PARTITION BY code ORDER BY mi RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b FROM s)
SELECT DISTINCT code FROM r WHERE b > 0 AND a / b >= 1.3""")
def activation_candidates(spark, d):
    return ops.regions_above(cube(spark, d).groupBy("code", "mi").agg(F.sum("kwh").alias("daily_kwh")))


@query("clean_numbers", """SELECT event_id, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS number, lpad(CAST(user_id AS VARCHAR), 5, '0') AS code, trim(upper(event_type)) AS label, upper(event_type) IN ('CLICK', 'VIEW') AS flag, strftime(ts, '%Y-%m') AS month FROM events""")
def clean_numbers(spark, d):
    e = table(spark, d, "events")
    return e.select(
        "event_id", expr.to_number(F.concat(F.lit(" "), F.regexp_extract("props", r"(\d+)", 1), F.lit(" "))).alias("number"), expr.clean_code(F.concat(F.col("user_id").cast("string"), F.lit(".0")), 5).alias("code"),
        expr.norm_text(F.concat(F.lit("  "), F.upper("event_type"), F.lit(" "))).alias("label"), expr.truth_flag("event_type", ["click", "view"]).alias("flag"), expr.month_label(expr.month_index(F.to_date("ts"))).alias("month"),
    )
