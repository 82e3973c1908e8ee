"""Queries of sessions, scenarios, causal, battery and publishing operators, with DuckDB equivalents where SQL has one."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import expr
from ..operators import battery, causal, keys, priority, publish, scenario, sessions
from .load import query
from .standins import POINTS_SQL, hourly, hourly_sql, points, rounded, table

_POS = "37.4::DOUBLE + (event_id % 7) * 0.002::DOUBLE AS lat, 126.8::DOUBLE + (event_id % 5) * 0.002::DOUBLE AS lon"


def _log(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.col("user_id").alias("v"), "ts", "event_type", (F.lit(37.4) + (F.col("event_id") % 7) * F.lit(0.002)).alias("lat"), (F.lit(126.8) + (F.col("event_id") % 5) * F.lit(0.002)).alias("lon"), F.col("value").alias("soc"))


_LOG = f"lg AS (SELECT event_id, user_id AS v, ts, epoch_us(ts) / 1e6::DOUBLE AS t, event_type, {_POS}, value AS soc FROM events)"


def _sessions_sql(transition: bool, gap: int, low: int, high: int) -> str:
    rows = "lg" if transition else "(SELECT * FROM lg WHERE event_type IN ('click', 'view'))"
    start = "(c AND (pt IS NULL OR (t - pt) / 60 > {g} OR NOT coalesce(pc, false)))" if transition else "(pt IS NULL OR (t - pt) / 60 > {g})"
    return f"""{_LOG}, b AS (SELECT *, event_type IN ('click', 'view') AS c, lag(t) OVER w AS pt, lag(event_type IN ('click', 'view')) OVER w AS pc FROM {rows} WINDOW w AS (PARTITION BY v ORDER BY ts, event_id)),
ss AS (SELECT *, sum(CASE WHEN {start.format(g=gap)} THEN 1 ELSE 0 END) OVER (PARTITION BY v ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM b),
se AS (SELECT v, CAST(session AS BIGINT) AS session, min(t) AS a, max(t) AS z, count(*) AS n, median(lat) AS lat, median(lon) AS lon, arg_min(soc, ts) AS soc_start, arg_max(soc, ts) AS soc_end FROM ss WHERE c GROUP BY 1, 2),
sx AS (SELECT *, (z - a) / 60 AS duration_min FROM se WHERE (z - a) / 60 BETWEEN {low} AND {high})"""


def _found(spark, d, transition: bool = True, gap: float = 360, low: float = 0, high: float = 100_000):
    return sessions.sessions(_log(spark, d), ["v"], F.col("event_type").isin("click", "view"), gap, tie=["event_id"], by_transition=transition, shortest=low, longest=high)


def _show(found):
    return rounded(found.select("v", "session", "n", "lat", "lon", "soc_start", "soc_end", F.round("duration_min", 4).alias("duration_min")))


_SHOW = "SELECT v, session, n, round(lat, 6) AS lat, round(lon, 6) AS lon, soc_start, soc_end, round(duration_min, 4) AS duration_min FROM sx"


@query("sessions_transition", f"WITH {_sessions_sql(True, 360, 0, 100000)} {_SHOW}")
def sessions_transition(spark, d):
    return _show(_found(spark, d))


@query("sessions_gap", f"WITH {_sessions_sql(False, 360, 3, 1440)} {_SHOW}")
def sessions_gap(spark, d):
    return _show(_found(spark, d, False, 360, 3, 1440))


@query("session_histogram", f"""WITH {_sessions_sql(False, 360, 0, 100000)}, e AS (SELECT CAST(i AS INTEGER) AS bin, ([0, 10, 20, 30, 40, 60, 90, 120, 240, 480, 1440])[i + 1]::DOUBLE AS low, ([0, 10, 20, 30, 40, 60, 90, 120, 240, 480, 1440])[i + 2]::DOUBLE AS high FROM range(10) t(i))
SELECT bin, low, high, CAST(count(v) AS BIGINT) AS n FROM e LEFT JOIN sx ON duration_min >= low AND duration_min < high GROUP BY 1, 2, 3""")
def session_histogram(spark, d):
    return sessions.session_histogram(_found(spark, d, False))


@query("duration_summary", f"WITH {_sessions_sql(False, 360, 0, 100000)} SELECT CAST(count(*) AS BIGINT) AS n, round(median(duration_min), 4) AS median, round(avg(duration_min), 4) AS mean, round(avg(CASE WHEN duration_min BETWEEN 20 AND 39.999999 THEN 1 ELSE 0 END), 4) AS share_20_40 FROM sx")
def duration_summary(spark, d):
    return rounded(sessions.duration_summary(_found(spark, d, False)), 4)


@query("pair_speeds", f"""WITH {_LOG}, b AS (SELECT *, lag(t) OVER w AS pt, lag(lat) OVER w AS pa, lag(lon) OVER w AS po FROM lg WINDOW w AS (PARTITION BY v ORDER BY ts, event_id)),
k AS (SELECT v, (t - pt) / 60 AS minutes, 2 * 6371.0088::DOUBLE * asin(sqrt(least(greatest(pow(sin((radians(lat) - radians(pa)) / 2), 2) + cos(radians(pa)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(po)) / 2), 2), 0.0), 1.0))) AS km FROM b)
SELECT v, CAST(count(*) AS BIGINT) AS n, round(avg(minutes), 4) AS minutes, round(max(CASE WHEN minutes > 0 THEN km / minutes * 60 ELSE 0 END), 4) AS kmh FROM k WHERE minutes BETWEEN 0 AND 600 GROUP BY v""")
def pair_speeds(spark, d):
    pairs = sessions.pair_speeds(_log(spark, d), "v", max_minutes=600)
    return rounded(pairs.groupBy("v").agg(F.count("*").alias("n"), F.avg("minutes").alias("minutes"), F.max("kmh").alias("kmh")), 4)


@query("vehicle_sample")
def vehicle_sample(spark, d):
    log = _log(spark, d)
    return sessions.vehicle_sample(log, "v", log.count() // 2).groupBy("v").agg(F.count("*").alias("n"))


@query("home_mode", f"""WITH e AS (SELECT user_id AS v, CAST(ts - INTERVAL 6 HOUR AS DATE) AS night, CAST(event_id % 4 AS BIGINT) AS cell FROM events WHERE hour(ts) >= 22 OR hour(ts) < 6),
n AS (SELECT v, night, cell, row_number() OVER (PARTITION BY v, night ORDER BY count(*) DESC, cell) AS r FROM e GROUP BY 1, 2, 3),
c AS (SELECT v, cell, count(*) AS nights FROM n WHERE r = 1 GROUP BY 1, 2), s AS (SELECT *, sum(nights) OVER (PARTITION BY v) AS o, row_number() OVER (PARTITION BY v ORDER BY nights DESC, cell) AS r FROM c)
SELECT v, cell, CAST(nights AS BIGINT) AS nights FROM s WHERE r = 1 AND nights >= 3 AND nights >= 0.3 * o""")
def home_mode(spark, d):
    log = _log(spark, d).withColumn("cell", F.col("event_id") % 4)
    return sessions.home_cells(log, "v", "cell", share=0.3)


_OCC = f"""{_sessions_sql(False, 360, 0, 100000)}, sl AS (SELECT a, z, unnest(range(CAST(floor(a / 3600) AS BIGINT), CAST(floor((z - 1e-6::DOUBLE) / 3600) AS BIGINT) + 1)) AS s FROM sx WHERE z > a),
oc AS (SELECT CAST(s % 24 AS INTEGER) AS hour, sum((least(z, (s + 1) * 3600) - greatest(a, s * 3600)) / 3600) AS hours FROM sl GROUP BY 1)"""


@query("occupancy_by_hour", f"WITH {_OCC} SELECT hour, round(hours, 4) AS hours FROM oc")
def occupancy_by_hour(spark, d):
    return rounded(sessions.occupancy(_found(spark, d, False)), 4)


@query("charging_shape", f"WITH {_OCC} SELECT CAST(i AS INTEGER) AS hour, round(coalesce(hours, 0) / (SELECT max(hours) FROM oc), 4) AS share FROM range(24) t(i) LEFT JOIN oc ON hour = i")
def charging_shape(spark, d):
    return rounded(sessions.charging_shape(sessions.occupancy(_found(spark, d, False)), 3, 10), 4)


@query("shape_correlation", f"""WITH {_OCC}, ev AS (SELECT CAST(hour(ts) AS INTEGER) AS hour, sum(value) AS y FROM events GROUP BY 1), j AS (SELECT coalesce(hours, 0) AS x, coalesce(y, 0) AS y FROM range(24) t(i) LEFT JOIN oc ON oc.hour = i LEFT JOIN ev ON ev.hour = i)
SELECT round(corr(x, y), 4) AS pearson FROM j""")
def shape_correlation(spark, d):
    two = table(spark, d, "events").groupBy(F.hour("ts").alias("hour")).agg(F.sum("value").alias("hours"))
    return rounded(sessions.shape_correlation(sessions.occupancy(_found(spark, d, False)), two), 4)


@query("soc_bands", f"""WITH {_sessions_sql(False, 360, 0, 100000)}, m AS (SELECT max(soc_start) AS t FROM sx), bb AS (SELECT CAST(least(floor(soc_start * CASE WHEN t <= 1 THEN 100 ELSE 1 END / 20), 4) AS INTEGER) AS band FROM sx, m WHERE soc_start IS NOT NULL)
SELECT CAST(i AS INTEGER) AS band, CASE WHEN count(bb.band) >= 5 THEN CAST(count(bb.band) AS BIGINT) END AS n FROM range(5) t(i) LEFT JOIN bb ON bb.band = i GROUP BY i""")
def soc_bands(spark, d):
    return sessions.soc_bands(_found(spark, d, False), 5)


@query("base_sessions", f"""WITH RECURSIVE {_sessions_sql(False, 360, 0, 100000)},
pt AS (SELECT v, session, CAST(make_timestamp(CAST(a * 1000000 AS BIGINT)) AS DATE) AS day, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM sx WHERE lat IS NOT NULL AND lon IS NOT NULL),
nb AS (SELECT p.v, p.session AS s, q.session AS t FROM pt p JOIN pt q ON p.v = q.v AND sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2)) <= 2 * sin(500.0::DOUBLE / 6371008.8::DOUBLE / 2)),
co AS (SELECT v, s FROM nb GROUP BY 1, 2 HAVING count(*) >= 3),
r AS (SELECT v, s, s AS t FROM co UNION SELECT r.v, r.s, nb.t FROM r JOIN nb ON r.v = nb.v AND r.t = nb.s JOIN co ON co.v = nb.v AND co.s = nb.t),
cl AS (SELECT v, s, min(t) AS cluster FROM r GROUP BY 1, 2),
al AS (SELECT pt.v, pt.session, any_value(pt.day) AS day, coalesce(any_value(own.cluster), min(cl.cluster), -1) AS cluster FROM pt JOIN nb ON nb.v = pt.v AND nb.s = pt.session LEFT JOIN cl own ON own.v = pt.v AND own.s = pt.session LEFT JOIN cl ON cl.v = nb.v AND cl.s = nb.t GROUP BY 1, 2),
sn AS (SELECT v, cluster, count(DISTINCT day) >= 3 AS many FROM al WHERE cluster >= 0 GROUP BY 1, 2)
SELECT al.v, session, cluster, coalesce(many, false) AS is_base FROM al LEFT JOIN sn USING (v, cluster)""")
def base_sessions(spark, d):
    return sessions.base_sessions(_found(spark, d, False), "v", 500.0)


# regions
@query("match_regions", """WITH dm AS (SELECT n_name AS town, 'R' || n_regionkey AS district, n_nationkey AS code FROM nation),
f AS (SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN replace(n_name, '_', '-') WHEN c_custkey % 3 = 1 THEN n_name ELSE 'X' || n_name END AS town, 'R' || n_regionkey AS district FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT f.district, f.town, coalesce(a.code, b.code) AS code, CASE WHEN a.code IS NOT NULL THEN 'exact' WHEN b.code IS NOT NULL THEN 'normalized' ELSE 'none' END AS method FROM f LEFT JOIN dm a ON a.town = f.town AND a.district = f.district
LEFT JOIN dm b ON replace(b.town, '_', '') = replace(replace(f.town, '-', ''), '_', '') AND b.district = f.district""")
def match_regions(spark, d):
    n = table(spark, d, "nation")
    dim = n.select(F.lit("P").alias("province"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("district"), F.col("n_name").alias("town"), F.col("n_nationkey").alias("code"))
    c = table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.when(F.col("c_custkey") % 3 == 0, F.translate("n_name", "_", "-")).when(F.col("c_custkey") % 3 == 1, F.col("n_name")).otherwise(F.concat(F.lit("X"), F.col("n_name")))
    facts = c.select(F.lit("P").alias("province"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("district"), name.alias("town"))
    return keys.match_regions(facts, dim).drop("province")


@query("canonical_codes", "SELECT p_partkey, CASE WHEN p_brand IN ('Brand#2', 'Brand#17') THEN 'Brand#1' ELSE p_brand END AS code FROM part")
def canonical_codes(spark, d):
    walk = spark.createDataFrame([("Brand#2", "Brand#1"), ("Brand#17", "Brand#1")], "code string, canonical string")
    return keys.canonicalize(table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("code")), walk).select("p_partkey", "code")


# scenarios
_LINKS = "lk AS (SELECT n_nationkey AS src, t AS code, CASE WHEN n_nationkey % 4 <> 3 THEN CAST(1 + (n_nationkey + t) % 3 AS DOUBLE) END AS w FROM nation, (SELECT unnest([0, 1, 2]) AS t) WHERE n_nationkey % 6 <> 5)"


def _links(spark, d):
    n = table(spark, d, "nation").where("n_nationkey % 6 <> 5").select(F.col("n_nationkey").alias("src"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("code"))
    return scenario.normalized_weights(n.withColumn("weight", F.when(F.col("src") % 4 != 3, (1 + (F.col("src") + F.col("code")) % 3).cast("double"))), "src")


@query("weighted_split", f"""WITH {_LINKS}, nw AS (SELECT src, code, CASE WHEN max(w) OVER (PARTITION BY src) IS NULL THEN 1.0 / 3 ELSE w / sum(w) OVER (PARTITION BY src) END AS weight FROM lk),
v AS (SELECT c_nationkey AS src, c_mktsegment AS seg, sum(c_acctbal) AS x FROM customer GROUP BY 1, 2) SELECT code, seg, round(sum(x * weight), 4) AS x FROM v JOIN nw USING (src) GROUP BY 1, 2""")
def weighted_split(spark, d):
    v = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("src"), F.col("c_mktsegment").alias("seg")).agg(F.sum("c_acctbal").alias("x"))
    return rounded(scenario.split_by_weight(v, _links(spark, d), "src", "code", "x", ["seg"]), 4)


@query("unmapped_share", f"WITH {_LINKS} SELECT round(sum(CASE WHEN c_nationkey NOT IN (SELECT src FROM lk) THEN greatest(c_acctbal, 0) ELSE 0 END) / sum(greatest(c_acctbal, 0)), 6) AS unmapped_share FROM customer")
def unmapped_share(spark, d):
    v = table(spark, d, "customer").select(F.col("c_nationkey").alias("src"), F.greatest("c_acctbal", F.lit(0.0)).alias("x"))
    return rounded(scenario.unmapped_share(v, _links(spark, d), "src", "x"))


_HIST = "hs AS (SELECT c_nationkey AS code, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS mi, CAST(count(*) AS DOUBLE) AS ev_count FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


def _history(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_nationkey").alias("code"), (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).alias("mi")).agg(F.count("*").cast("double").alias("ev_count"))


_BASE_MI = 2000 * 12 + 5
_GROW = f"""{_HIST}, nt AS (SELECT a.code, a.ev_count AS now, b.ev_count AS then_ FROM hs a LEFT JOIN hs b ON a.code = b.code AND b.mi = {_BASE_MI} - 36 WHERE a.mi = {_BASE_MI}),
tt AS (SELECT pow(sum(now) / sum(then_), 1.0 / 3) - 1 AS t FROM nt), gr AS (SELECT code, now, CASE WHEN then_ >= 7 THEN pow(now / then_, 1.0 / 3) - 1 END AS own, t FROM nt, tt),
g2 AS (SELECT code, now AS ev_now, least(coalesce(own, t), 0.2::DOUBLE) AS g, own IS NULL OR coalesce(own, t) > 0.2::DOUBLE AS g_fallback FROM gr)"""


@query("growth_rate", f"WITH {_GROW} SELECT code, ev_now, round(g, 6) AS g, g_fallback FROM g2")
def growth_rate(spark, d):
    return rounded(scenario.growth_rate(_history(spark, d), _BASE_MI, 36, 7, 0.2))


def _grid(spark, d):
    growth = scenario.growth_rate(_history(spark, d), _BASE_MI, 36, 7, 0.2)
    peaks = growth.select("code", (F.col("ev_now") * 2 + F.col("code")).alias("peak"))
    return scenario.scenario_grid(growth, peaks, _BASE_MI, [2005, 2010], {"low": 0.5, "mid": 1.0, "high": 1.5}, {"one": 1.0, "half": 0.5})


_GRID = f"""{_GROW}, cells AS (SELECT y AS year, s AS scenario, k, b AS beta, v, ((y * 12 + 11) - {_BASE_MI}) / 12.0::DOUBLE AS t FROM (SELECT unnest([2005, 2010]) AS y), (SELECT unnest(['low', 'mid', 'high']) AS s, unnest([0.5, 1.0, 1.5])::DOUBLE AS k), (SELECT unnest(['one', 'half']) AS b, unnest([1.0, 0.5])::DOUBLE AS v)),
gd AS (SELECT code, year, scenario, beta, ev_now * pow(greatest(1 + k * g, 0), t) AS ev, (ev_now * 2 + code) * pow(ev_now * pow(greatest(1 + k * g, 0), t) / ev_now, v) AS peak_kw FROM g2, cells)"""


@query("scenario_grid", f"WITH {_GRID} SELECT code, CAST(year AS INTEGER) AS year, scenario, beta, round(ev, 4) AS ev, round(peak_kw, 4) AS peak_kw FROM gd")
def scenario_grid(spark, d):
    return rounded(_grid(spark, d), 4)


@query("scenario_summary", f"""WITH {_GRID}, x AS (SELECT gd.*, round(peak_kw, 6) > 40 + gd.code AS o, m.o AS mo FROM gd LEFT JOIN (SELECT code, year, beta, round(peak_kw, 6) > 40 + code AS o FROM gd WHERE scenario = 'mid') m USING (code, year, beta))
SELECT CAST(year AS INTEGER) AS year, scenario, beta, CAST(count(*) AS BIGINT) AS n, CAST(count(CASE WHEN o THEN 1 END) AS BIGINT) AS n_over, CAST(count(CASE WHEN scenario = 'high' AND o AND NOT mo THEN 1 END) AS BIGINT) AS n_only_high, round(median(peak_kw), 4) AS median_peak FROM x GROUP BY 1, 2, 3""")
def scenario_summary(spark, d):
    limits = table(spark, d, "nation").select(F.col("n_nationkey").alias("code"), (F.col("n_nationkey") + 40.0).alias("limit_kw"))
    grid = _grid(spark, d).withColumn("peak_kw", F.round("peak_kw", 6))
    return rounded(scenario.scenario_summary(grid, limits, "mid", "high"), 4)


@query("typical_day", f"""WITH {hourly_sql(3)}, dd AS (SELECT code, date, max(CASE WHEN hour BETWEEN 17 AND 22 THEN kw END) AS p FROM h WHERE isodow(date) <= 5 GROUP BY 1, 2 HAVING count(kw) = 24),
r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY p, date) AS r, count(*) OVER (PARTITION BY code) AS m FROM dd) SELECT h.code, CAST(h.date AS VARCHAR) AS date, hour, kw FROM h JOIN r ON h.code = r.code AND h.date = r.date AND r = greatest(1, ceil(m * 0.5::DOUBLE))""")
def typical_day(spark, d):
    return rounded(scenario.typical_day(hourly(spark, d, 3)))


@query("elasticity")
def elasticity(spark, d):
    p = _history(spark, d).groupBy(F.col("code").alias("key")).agg(F.sum("ev_count").alias("x"), F.max("ev_count").alias("y"))
    return rounded(scenario.elasticity(p))


# causal
_PANEL = "pn AS (SELECT l_suppkey AS code, CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS INTEGER) AS mi, round(avg(l_quantity), 6) AS y FROM lineitem GROUP BY 1, 2), un AS (SELECT s_suppkey AS code, CASE WHEN s_suppkey % 3 = 0 THEN 23976 + CAST(s_suppkey % 5 AS INTEGER) * 2 END AS g FROM supplier)"


def _panel(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("code"), (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).alias("mi")).agg(F.round(F.avg("l_quantity"), 6).alias("y"))
    u = table(spark, d, "supplier").select(F.col("s_suppkey").alias("code"), F.when(F.col("s_suppkey") % 3 == 0, 23976 + (F.col("s_suppkey") % 5).cast("int") * 2).alias("g"))
    return p, u


_ATT = f"""{_PANEL}, o AS (SELECT pn.code, mi, y, g FROM pn JOIN un USING (code)), co AS (SELECT DISTINCT g AS cohort FROM un WHERE g IS NOT NULL),
u AS (SELECT cohort, o.mi, o.mi - cohort AS k, o.g = cohort AS own, o.y - b.y AS ch FROM o CROSS JOIN co JOIN o b ON b.code = o.code AND b.mi = cohort - 1 WHERE o.mi - cohort BETWEEN -6 AND 6 AND o.mi - cohort <> -1 AND (o.g IS NULL OR o.g = cohort)),
ef AS (SELECT cohort, mi, k, avg(CASE WHEN own THEN ch END) - avg(CASE WHEN own IS NULL THEN ch END) AS att, count(CASE WHEN own THEN 1 END) AS n_treated, count(CASE WHEN own IS NULL THEN 1 END) AS n_control FROM u GROUP BY 1, 2, 3)"""


@query("att_gt", f"WITH {_ATT} SELECT cohort, mi, CAST(k AS INTEGER) AS k, round(att, 6) AS att, n_treated, n_control FROM ef WHERE n_treated > 0 AND n_control > 0")
def att_gt(spark, d):
    return rounded(causal.att_gt(*_panel(spark, d)))


@query("event_study", f"WITH {_ATT} SELECT CAST(k AS INTEGER) AS k, round(sum(att * n_treated) / sum(n_treated), 6) AS tau, CAST(sum(n_treated) AS BIGINT) AS n_units FROM ef WHERE n_treated > 0 AND n_control > 0 GROUP BY 1 HAVING sum(n_treated) >= 5")
def event_study(spark, d):
    return rounded(causal.event_study(causal.att_gt(*_panel(spark, d)), 5))


@query("event_study_bootstrap")
def event_study_bootstrap(spark, d):
    return rounded(causal.event_study_bootstrap(*_panel(spark, d), draws=20))


@query("unit_outcomes", f"""WITH {_PANEL}, sh AS (SELECT g AS cohort, count(*) / sum(count(*)) OVER () AS w FROM un WHERE g IS NOT NULL GROUP BY g),
r AS (SELECT pn.code, g, cohort, w, avg(CASE WHEN mi >= cohort AND mi < cohort + 3 THEN y END) - avg(CASE WHEN mi < cohort THEN y END) AS d FROM pn JOIN un USING (code), sh WHERE g IS NULL OR g = cohort GROUP BY 1, 2, 3, 4)
SELECT code, g IS NOT NULL AS treated, round(sum(CASE WHEN g IS NOT NULL THEN d ELSE w * d END) / sum(CASE WHEN g IS NOT NULL THEN 1.0 ELSE w END), 6) AS delta FROM r WHERE d IS NOT NULL GROUP BY 1, 2""")
def unit_outcomes(spark, d):
    return rounded(causal.unit_outcomes(*_panel(spark, d), 3))


_STOCK = "st AS (SELECT c_nationkey AS code, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS mi, CAST(count(*) AS BIGINT) AS stock FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1, 2)"


def _stocks(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_nationkey").alias("code"), (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).alias("mi")).agg(F.count("*").alias("stock"))


@query("stock_rates", f"""WITH {_STOCK}, x AS (SELECT *, stock - lag(stock) OVER w AS dd, mi - lag(mi) OVER w AS gg FROM st WINDOW w AS (PARTITION BY code ORDER BY mi)),
y AS (SELECT code, mi, stock, CASE WHEN gg = 1 THEN greatest(dd, 0) END AS new, CASE WHEN gg = 1 THEN greatest(-dd, 0) END AS closed FROM x) SELECT code, mi, stock, new, closed, round(new / stock, 6) AS open_rate, round(closed / stock, 6) AS close_rate FROM y""")
def stock_rates(spark, d):
    return rounded(causal.stock_rates(_stocks(spark, d)))


_CELLS = """ce AS (SELECT l_suppkey AS code, l_linestatus AS origin, l_returnflag AS grp, coalesce(sum(CASE WHEN l_partkey % 4 <> 0 THEN l_quantity END), 0) AS S, count(CASE WHEN l_partkey % 4 <> 0 THEN 1 END) AS nv, count(*) AS nr, count(CASE WHEN l_partkey % 4 = 0 THEN 1 END) AS nm FROM lineitem WHERE l_suppkey % 9 <> 0 OR l_returnflag <> 'A' GROUP BY 1, 2, 3)"""


def _comp(grp: str, origin: str) -> str:
    f = f"grp = '{grp}' AND origin = '{origin}'"
    return f"CASE WHEN coalesce(sum(CASE WHEN {f} THEN nr END), 0) = 0 THEN 0.0 WHEN sum(CASE WHEN {f} THEN nv END) > 0 AND sum(CASE WHEN {f} THEN nm END) <= 0.3 * sum(CASE WHEN {f} THEN nr END) THEN sum(CASE WHEN {f} THEN S END) END"


@query("double_difference", f"""WITH {_CELLS}, p AS (SELECT code, {_comp('A', 'F')} AS a_out, {_comp('A', 'O')} AS a_res, {_comp('R', 'F')} AS b_out, {_comp('R', 'O')} AS b_res FROM ce GROUP BY 1),
r AS (SELECT *, CASE WHEN a_out IS NULL THEN 'masked:a_out' WHEN a_out <= 0 THEN 'zero:a_out' WHEN a_res IS NULL THEN 'masked:a_res' WHEN a_res <= 0 THEN 'zero:a_res' WHEN b_out IS NULL THEN 'masked:b_out' WHEN b_out <= 0 THEN 'zero:b_out' WHEN b_res IS NULL THEN 'masked:b_res' WHEN b_res <= 0 THEN 'zero:b_res' END AS reason FROM p)
SELECT code, CASE WHEN reason IS NULL THEN round(ln(nullif(a_out, 0)) - ln(nullif(a_res, 0)) - (ln(nullif(b_out, 0)) - ln(nullif(b_res, 0))), 6) END AS y, reason FROM r""")
def double_difference(spark, d):
    masked = F.col("l_partkey") % 4 == 0
    rows = table(spark, d, "lineitem").where("l_suppkey % 9 <> 0 or l_returnflag <> 'A'")
    cells = causal.sales_cells(rows.select(F.col("l_suppkey").alias("code"), F.col("l_linestatus").alias("origin"), F.col("l_returnflag").alias("grp"), "l_quantity", "l_partkey"), ["code", "origin", "grp"], F.when(~masked, F.col("l_quantity")), masked)
    part = lambda g, o: (F.col("grp") == g) & (F.col("origin") == o)
    return rounded(causal.double_difference(cells, ["code"], {"a_out": part("A", "F"), "a_res": part("A", "O"), "b_out": part("R", "F"), "b_res": part("R", "O")}, 0.3))


@query("activations")
def activations(spark, d):
    p, _ = _panel(spark, d)
    return rounded(causal.activations(p.withColumnRenamed("y", "daily_kwh"), (1997 * 12, 1997 * 12 + 11), 1995 * 12 + 6))


_ROUNDS = ", ".join(f"a{k} AS (SELECT code, mi, y, r - avg(r) OVER (PARTITION BY code) AS r FROM b{k - 1}), b{k} AS (SELECT code, mi, y, r - avg(r) OVER (PARTITION BY mi) AS r FROM a{k})" for k in range(1, 5))


@query("two_way_demeaned", f"WITH {_PANEL}, b0 AS (SELECT code, mi, y, y AS r FROM pn), {_ROUNDS} SELECT code, mi, round(y, 4) AS y, round(r, 4) AS resid FROM b4")
def two_way_demeaned(spark, d):
    return rounded(causal.two_way_demeaned(_panel(spark, d)[0], rounds=4), 4)


# battery
@query("battery_schedules")
def battery_schedules(spark, d):
    h = hourly(spark, d, 3).groupBy("code", "date").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("hour", "kw"))).alias("c")).where("n = 24")
    loads = F.transform("c", lambda x: x["kw"])
    days = h.select("code", F.col("date").cast("string").alias("date"), F.transform(loads, lambda x: x / 20).alias("actual"))
    days = days.withColumns({"plan": F.when(F.substring("date", 10, 1) != "3", F.col("actual")), "target": F.array_max("actual") * 0.8, "price": F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.pmod(i * 7, F.lit(24)).cast("double"))})
    out = battery.schedules(days, battery.Battery(power_kw=4.0, energy_kwh=20.0), ["code", "date"])
    return rounded(out.drop("plan_charge", "plan_discharge", "plan_energy", "grid", "charge", "discharge"), 4)


# a battery's whole chain on full days of three areas: sizing on past days, plans and outcomes, axes and order of review
_DAYS = f"""{hourly_sql(3).replace('h AS (', 'h0 AS (', 1)}, h AS (SELECT code, date, hour, coalesce(kw, 0.0) AS kw FROM (SELECT * FROM (SELECT DISTINCT code FROM h0), (SELECT DISTINCT date FROM h0), (SELECT CAST(unnest(range(24)) AS INTEGER) AS hour)) LEFT JOIN h0 USING (code, date, hour)),
l AS (SELECT *, lag(kw) OVER (PARTITION BY code, hour ORDER BY date) AS lag1, lag(kw, 7) OVER (PARTITION BY code, hour ORDER BY date) AS lag7 FROM h),
cal AS (SELECT code, max(kw) AS peak, avg(kw) AS mean_kw, avg(abs(kw - lag7)) AS mae, avg(abs(kw - lag1)) AS mae_yesterday, avg(kw - lag7) AS bias FROM l WHERE date <= DATE '2024-01-20' GROUP BY 1),
rl AS (SELECT code, coalesce(mae <= mae_yesterday * 1.1::DOUBLE AND abs(bias) <= 0.2::DOUBLE * mean_kw, false) AS reliable FROM cal),
sc AS (SELECT code, m AS multiplier, n AS n_new, peak * m AS target, n * 0.1::DOUBLE AS more FROM cal, (SELECT unnest([1.0, 1.2])::DOUBLE AS m), (SELECT unnest([0, 3]) AS n)),
dy AS (SELECT code, date, max(kw) AS top, max(lag1) * 1.1::DOUBLE AS planned, count(lag1) = 24 AS has FROM l GROUP BY 1, 2),
sz AS (SELECT code, multiplier, n_new, bool_and(top + more <= target + 1e-6) AS sized, max(over) / (0.95::DOUBLE * 0.8::DOUBLE) AS reference_kwh, count(*) AS n_days
       FROM (SELECT sc.*, l.date, max(l.kw) AS top, sum(greatest(l.kw + more - target, 0)) AS over FROM sc JOIN l USING (code) WHERE l.date <= DATE '2024-01-20' GROUP BY ALL) GROUP BY 1, 2, 3),
ov AS (SELECT sc.*, l.date, sum(greatest(l.kw + more - target, 0)) AS over FROM sc JOIN l USING (code) WHERE l.date > DATE '2024-01-20' GROUP BY ALL),
oc AS (SELECT code, ov.date, multiplier, n_new, sized AND has AND planned + more <= target + 1e-6 AS plan_feasible, reliable AND has AS forecast_reliable, over FROM ov JOIN sz USING (code, multiplier, n_new) JOIN dy USING (code, date) JOIN rl USING (code))"""


def _chain(spark, d):
    own = hourly(spark, d, 3)
    full = own.select("code").distinct().crossJoin(own.select("date").distinct()).crossJoin(spark.range(24).select(F.col("id").cast("int").alias("hour")))  # 3 areas
    over = Window.partitionBy("code", "hour").orderBy("date")
    rows = full.join(own, ["code", "date", "hour"], "left").fillna(0.0, ["kw"]).withColumns({"lag1": F.lag("kw").over(over), "lag7": F.lag("kw", 7).over(over)})
    series = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("hour", c))), lambda x: x[c])
    days = rows.groupBy("code", "date").agg(series("kw").alias("actual"), F.when(F.count("lag1") == 24, series("lag1")).alias("base"))  # 24 values
    days = days.withColumns({"p50": F.col("base"), "p90": F.transform("base", lambda x: x * 1.1), "price": F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: i.cast("double"))})
    past = F.col("date") <= F.lit("2024-01-20").cast("date")
    calibration = rows.where(past).groupBy("code").agg(F.max("kw").alias("peak"), F.avg("kw").alias("mean_kw"), F.avg(F.abs(F.col("kw") - F.col("lag7"))).alias("mae"), F.avg(F.abs(F.col("kw") - F.col("lag1"))).alias("y"), F.avg(F.col("kw") - F.col("lag7")).alias("bias"))
    reliable = battery.reliable_regions(calibration.select("code", F.lit(20).alias("n_days"), "mae", (F.col("y") * 1.1).alias("mae_yesterday"), "bias"), calibration, 14, 0.2)
    added = {n: battery.added_load([0.1] * 24, n, 1.0) for n in (0, 3)}
    sizes = battery.scenario_sizes(days.where(past).select("code", F.col("actual").alias("load")), calibration, [1.0, 1.2], added, [(0, 0)])
    runs = battery.scenario_days(days.where(~past), calibration, [1.0, 1.2], added)
    return sizes, battery.run_scenarios(runs, sizes, battery.Battery(), reliable)


@query("battery_sizes", f"WITH {_DAYS} SELECT code, multiplier, n_new, CASE WHEN sized THEN 0.0::DOUBLE END AS power_kw, CASE WHEN sized THEN 0.0::DOUBLE END AS energy_kwh, round(reference_kwh, 6) AS reference_kwh, n_days FROM sz")
def battery_sizes(spark, d):
    """No battery at all, the first candidate, where past days keep to the target without one."""
    return rounded(_chain(spark, d)[0])


@query("scenario_axes", f"WITH {_DAYS} SELECT code, round(avg(over), 6) AS safety_raw, 0.0::DOUBLE AS economy_raw, round(avg(CASE WHEN forecast_reliable THEN 1 ELSE 0 END), 6) AS forecast_confidence, round(avg(CASE WHEN plan_feasible THEN 1 ELSE 0 END), 6) AS plan_confidence FROM oc WHERE multiplier = 1.0 AND n_new = 0 GROUP BY 1")
def scenario_axes(spark, d):
    return rounded(priority.energy_axes(_chain(spark, d)[1], 1.0, 0))


@query("scenario_review", f"""WITH {_DAYS}, v AS (SELECT code, bool_and(plan_feasible AND forecast_reliable) AS valid, avg(over) AS over FROM oc WHERE multiplier = 1.2 AND n_new = 0 GROUP BY 1)
SELECT code, valid, round(over, 6) AS excess_kwh, round(over, 6) AS left_kwh, 0.0::DOUBLE AS peak_reduction_kw, code < 2 AS confirmed, CASE WHEN NOT valid OR code >= 2 THEN 'more_data_first' WHEN over > 1e-6 THEN 'on_site_first' ELSE 'no_excess_here' END AS review_group, CAST(row_number() OVER (ORDER BY over DESC, code) AS INTEGER) AS place FROM v""")
def scenario_review(spark, d):
    confirmed = hourly(spark, d, 3).select("code").distinct().where("code < 2")
    return rounded(priority.review_order(_chain(spark, d)[1], confirmed, 1.2))


# publishing
_COUNTS = "ct AS (SELECT c_nationkey AS code, CAST(count(*) AS BIGINT) AS n FROM customer WHERE c_nationkey % 7 <> 6 GROUP BY 1), rg AS (SELECT n_nationkey AS code, CAST(n_nationkey AS DOUBLE) / 7 + 0.1::DOUBLE AS score, CASE WHEN n_nationkey % 5 = 0 THEN 'not_assessed_low_load' WHEN n_nationkey % 5 = 1 THEN NULL ELSE 'assessed' END AS status FROM nation)"


def _published(spark, d):
    counts = table(spark, d, "customer").where("c_nationkey % 7 <> 6").groupBy(F.col("c_nationkey").alias("code")).agg(F.count("*").alias("n"))
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("code"), (F.col("n_nationkey") / 7 + 0.1).alias("score"), F.expr("case when n_nationkey % 5 = 0 then 'not_assessed_low_load' when n_nationkey % 5 = 1 then null else 'assessed' end").alias("status"))
    return rows, counts


@query("small_cell_export", f"WITH {_COUNTS} SELECT rg.code, CASE WHEN coalesce(n, 0) >= 60 THEN round(score, 6) END AS score, status, coalesce(n, 0) < 60 AS small_cell FROM rg LEFT JOIN ct USING (code)")
def small_cell_export(spark, d):
    rows, counts = _published(spark, d)
    return rounded(publish.export_pair(rows, counts, 60, ["score"])[1])


@query("suppressed_counts", "SELECT c_mktsegment, c_nationkey % 5 AS g, CASE WHEN count(*) >= 60 THEN CAST(count(*) AS BIGINT) END AS n, CASE WHEN count(*) >= 60 THEN round(avg(c_acctbal), 4) END AS balance FROM customer GROUP BY 1, 2")
def suppressed_counts(spark, d):
    t = table(spark, d, "customer").groupBy("c_mktsegment", (F.col("c_nationkey") % 5).alias("g")).agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("balance"))
    return rounded(publish.suppress_small(t, "n", 60, keep=("g",)), 4)


_DETAIL = f"{_COUNTS}, dt AS (SELECT code, score, CASE WHEN code % 8 = 3 THEN 'G' WHEN status = 'assessed' THEN 'A' WHEN status = 'not_assessed_low_load' THEN 'L' ELSE 'M' END AS state FROM rg)"


def _detail(spark, d):
    rows, counts = _published(spark, d)
    groups = rows.where("code % 8 = 3").select("code", (F.col("code") - 1).alias("head"))
    return publish.detail_rows(rows, groups), counts


@query("detail_pages", f"""WITH {_DETAIL}, x AS (SELECT dt.code, score, state, coalesce(n, 0) < 60 AND state <> 'G' AS small, CAST((row_number() OVER (ORDER BY dt.code) - 1) // 9 AS INTEGER) AS page FROM dt LEFT JOIN ct USING (code)),
y AS (SELECT page, code, CASE WHEN small THEN 'S' ELSE state END AS state, CASE WHEN NOT small THEN round(score, 3) END AS score FROM x)
SELECT page, 0 AS line, CAST(code AS VARCHAR) AS label, state, score FROM y UNION ALL SELECT page, 1, 'Σ' || CAST(sum(code) AS VARCHAR), CAST(count(*) AS VARCHAR) || ' rows', round(coalesce(sum(score), 0.0), 3) FROM y GROUP BY page""")
def detail_pages(spark, d):
    detail, counts = _detail(spark, d)
    return publish.pages(detail, counts, 60, ["score"], 9)


@query("page_checks", f"WITH {_DETAIL} SELECT CAST((r - 1) // 9 AS INTEGER) AS page, CAST(count(*) AS BIGINT) AS n, true AS agrees FROM (SELECT row_number() OVER (ORDER BY code) AS r FROM dt) GROUP BY 1")
def page_checks(spark, d):
    detail, counts = _detail(spark, d)
    return publish.check_pages(publish.pages(detail, counts, 60, ["score"], 9), ["score"])


@query("state_counts", f"""WITH {_DETAIL} SELECT CAST(count(CASE WHEN state <> 'G' AND coalesce(n, 0) >= 60 THEN 1 END) AS BIGINT) AS shown, CAST(count(CASE WHEN state = 'G' THEN 1 END) AS BIGINT) AS merged,
CAST(count(CASE WHEN state <> 'G' AND n < 60 THEN 1 END) AS BIGINT) AS hidden_small, CAST(count(CASE WHEN state <> 'G' AND n IS NULL THEN 1 END) AS BIGINT) AS hidden_without_count FROM dt LEFT JOIN ct USING (code)""")
def state_counts(spark, d):
    return publish.state_counts(*_detail(spark, d), 60)


@query("quality_gates", """WITH m AS (SELECT avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END) AS mask, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS candidates, CAST(NULL AS DOUBLE) AS mde FROM orders)
SELECT 1 AS number, 'masked share' AS "check", round(mask, 6) AS x, CASE WHEN mask > 0.5 THEN 'fail' WHEN mask > 0.3 THEN 'warn' ELSE 'pass' END AS verdict FROM m UNION ALL
SELECT 2, 'candidates', candidates, CASE WHEN candidates < 10 THEN 'fail' WHEN candidates < 30 THEN 'warn' ELSE 'pass' END FROM m UNION ALL SELECT 3, 'detectable effect', mde, 'n.a.' FROM m""")
def quality_gates(spark, d):
    m = table(spark, d, "orders").agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("mask"), F.countDistinct("o_custkey").cast("double").alias("candidates"), F.lit(None).cast("double").alias("mde"))
    rules = [("masked share", "mask", "x > 0.3", "x > 0.5"), ("candidates", "candidates", "x < 30", "x < 10"), ("detectable effect", "mde", "x > 0.03", "")]
    return rounded(publish.gates(m, rules))


@query("reserved_reasons", "SELECT c_custkey, concat_ws(' · ', CASE WHEN c_acctbal < 0 THEN 'negative' END, CASE WHEN c_nationkey % 2 = 0 THEN 'even' END) AS reasons FROM customer")
def reserved_reasons(spark, d):
    text = publish.reserved_reasons({"negative": F.col("c_acctbal") < 0, "even": F.col("c_nationkey") % 2 == 0})
    return table(spark, d, "customer").select("c_custkey", text.alias("reasons"))


@query("low_access_contrast", """WITH k AS (SELECT c_acctbal AS v, CAST(c_custkey % 50 AS DOUBLE) AS a FROM customer), c AS (SELECT quantile_cont(a, 0.2) AS cut FROM k),
r AS (SELECT v, a, a <= cut AS low, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rv, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra FROM k, c)
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN low THEN v END), 4) AS mean_low, round(avg(CASE WHEN NOT low THEN v END), 4) AS mean_rest, round(corr(rv, ra), 6) AS spearman FROM r""")
def low_access_contrast(spark, d):
    r = table(spark, d, "customer").select(F.col("c_acctbal").alias("away_ratio"), (F.col("c_custkey") % 50).cast("double").alias("access"))
    out = sessions.low_access_contrast(r)
    return out.select("n", F.round("mean_low", 4).alias("mean_low"), F.round("mean_rest", 4).alias("mean_rest"), F.round("spearman", 6).alias("spearman"))


@query("geo_cells", f"WITH {POINTS_SQL} SELECT code, CAST(CAST(floor(lat / (300 / 111000.0::DOUBLE)) AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(floor(lon / (300 / 111000.0::DOUBLE / 0.8::DOUBLE)) AS BIGINT) AS VARCHAR) AS cell FROM p")
def geo_cells(spark, d):
    return points(spark, d).select("code", expr.geo_cell("lat", "lon", 300).alias("cell"))




@query("snapshots", """SELECT CASE WHEN GROUPING(o_orderstatus) = 1 THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_orderpriority, CAST(GROUPING(o_orderstatus) * 2 + GROUPING(o_orderpriority) AS INTEGER) AS which, round(sum(o_totalprice), 2) AS o_totalprice, CAST(count(*) AS BIGINT) AS n
FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority), ())""")
def snapshots(spark, d):
    from ..operators.inputs import snapshots as op

    return rounded(op(table(spark, d, "orders"), [["o_orderstatus"], ["o_orderpriority"], ["o_orderstatus", "o_orderpriority"], []], "o_totalprice"), 2)


@query("shares_within", """WITH s AS (SELECT c_nationkey, c_mktsegment, sum(greatest(c_acctbal, 0)) AS v FROM customer GROUP BY 1, 2) SELECT c_nationkey, c_mktsegment, round(v / nullif(sum(v) OVER (PARTITION BY c_nationkey), 0), 6) AS share FROM s""")
def shares_within(spark, d):
    from ..operators.inputs import shares_within as op

    rows = table(spark, d, "customer").withColumn("c_acctbal", F.greatest("c_acctbal", F.lit(0.0)))
    return rounded(op(rows, "c_nationkey", "c_mktsegment", "c_acctbal"))


@query("concentrated_targets", f"""WITH {hourly_sql(3)}, w AS (SELECT * FROM h WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-06'), dd AS (SELECT code, date FROM w GROUP BY 1, 2 HAVING count(kw) = 24), ok AS (SELECT code FROM dd GROUP BY 1 HAVING count(*) = 2),
m AS (SELECT code, hour, avg(kw) AS m FROM w JOIN ok USING (code) GROUP BY 1, 2), s AS (SELECT code, coalesce(max(m) / nullif(sum(m), 0), 0) AS c FROM m GROUP BY 1)
SELECT code, round(c, 6) AS concentration, CAST(row_number() OVER (ORDER BY c DESC, code) AS INTEGER) AS place FROM s WHERE c > (SELECT median(c) FROM s)""")
def concentrated_targets(spark, d):
    from ..operators.inputs import concentrated_targets as op

    return rounded(op(hourly(spark, d, 3), "2024-01-05", "2024-01-06"))


@query("region_stock", "SELECT s_nationkey AS code, CAST(count(*) AS BIGINT) AS n_stations, CAST(sum(s_suppkey % 7 + 1) AS DOUBLE) AS chargers FROM supplier GROUP BY 1")
def region_stock(spark, d):
    from ..operators.inputs import region_stock as op

    return op(table(spark, d, "supplier").select(F.col("s_nationkey").alias("code"), (F.col("s_suppkey") % 7 + 1).cast("double").alias("chargers")))


@query("labelled_scalars", """WITH o AS (SELECT avg(o_totalprice) AS mean, CAST(count(*) AS DOUBLE) AS n FROM orders) SELECT 'orders n' AS item, CAST(CAST(n AS DECIMAL(18, 1)) AS VARCHAR) AS value FROM o UNION ALL SELECT 'orders missing', 'not computed'""")
def labelled_scalars(spark, d):
    from ..operators.inputs import labelled_scalars as op

    return op({"orders": table(spark, d, "orders").agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("missing"))})
