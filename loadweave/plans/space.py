"""Queries of the spatial, scoring and ranking operators, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import minmax_score, percentile_score
from ..operators import polygons, risk, spatial
from .load import query
from .standins import POINTS_SQL, STATIONS_SQL, km_sql, points, rounded, stations, table

_PS = f"{POINTS_SQL}, {STATIONS_SQL}"
_KM = km_sql("p.lat", "p.lon", "s.lat", "s.lon")
_NEAR = f"{_PS}, nr AS (SELECT p.code, s.station, {_KM} AS km FROM p, s)"


@query("nearest_station", f"WITH {_NEAR}, r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY km, station) AS k FROM nr) SELECT code, CASE WHEN km <= 1.0 THEN station END AS station, round(km, 6) AS dist_km FROM r WHERE k = 1")
def nearest_station(spark, d):
    return rounded(spatial.nearest_small(points(spark, d), stations(spark, d), "code", "station", 1.0))


@query("nearest_by_rings", f"WITH {_NEAR}, r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY km, station) AS k FROM nr) SELECT code, station, round(km, 6) AS dist_km FROM r WHERE k = 1")
def nearest_by_rings(spark, d):
    return rounded(spatial.nearest(points(spark, d), stations(spark, d), "code", "station"))


@query("radius_pairs", f"WITH {_NEAR} SELECT code, station, round(km, 6) AS dist_km FROM nr WHERE km <= 0.8")
def radius_pairs(spark, d):
    right = stations(spark, d).selectExpr("station", "lat as lat2", "lon as lon2")
    return spatial.radius_join(points(spark, d).select("code", "lat", "lon"), right, 0.8, 6).select("code", "station", "dist_km")


@query("within_radius_share", f"WITH {_NEAR}, w AS (SELECT code, max(CASE WHEN km <= 0.8 THEN 1 ELSE 0 END) AS hit FROM nr GROUP BY 1) SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(hit) AS BIGINT) AS n_within, round(avg(hit), 6) AS share FROM w")
def within_radius_share(spark, d):
    return rounded(spatial.within_radius_share(points(spark, d), stations(spark, d), "code", 0.8))


def _access_sql(factor: str = "1.0") -> str:
    return f"""{_PS}, pr AS (SELECT p.code, p.ev, s.station, s.chargers, {_KM} * {factor} AS km FROM p, s), ok AS (SELECT * FROM pr WHERE km <= 2.0),
dm AS (SELECT station, chargers, sum(ev) AS de FROM ok GROUP BY 1, 2), su AS (SELECT station, CASE WHEN de > 0 THEN chargers / de ELSE 0.0 END AS r FROM dm),
ac AS (SELECT p.code, coalesce(sum(r), 0.0) AS access FROM p LEFT JOIN (SELECT code, r FROM ok JOIN su USING (station)) x USING (code) GROUP BY 1)"""


@query("catchment_access", f"WITH {_access_sql()} SELECT code, round(access, 9) AS access FROM ac")
def catchment_access(spark, d):
    return rounded(spatial.catchment(stations(spark, d), points(spark, d), 2.0), 9)


@query("access_indicators", f"""WITH {_NEAR}, ow AS (SELECT station, code FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY km, code) AS k FROM nr) WHERE k = 1),
ch AS (SELECT code, sum(chargers) AS chargers FROM ow JOIN s USING (station) GROUP BY 1), nn AS (SELECT code, min(km) AS km FROM nr GROUP BY 1)
SELECT p.code, coalesce(chargers, 0.0) AS chargers, round(ev / nullif(coalesce(chargers, 0.0), 0), 6) AS ev_per_charger, round(km, 6) AS nearest_km FROM p LEFT JOIN ch USING (code) LEFT JOIN nn USING (code)""")
def access_indicators(spark, d):
    return rounded(spatial.access_indicators(stations(spark, d), points(spark, d)))


_ADDED = f"""{_access_sql()}, lo AS (SELECT code FROM ac WHERE access <= (SELECT access FROM (SELECT access, row_number() OVER (ORDER BY access) AS r, count(*) OVER () AS n FROM ac) WHERE r = greatest(1, ceil(n * 0.1::DOUBLE))))"""


@query("bottom_with_ties", f"WITH {_ADDED} SELECT code, round(access, 9) AS access FROM ac JOIN lo USING (code)")
def bottom_with_ties(spark, d):
    return rounded(spatial.bottom_with_ties(spatial.catchment(stations(spark, d), points(spark, d), 2.0), "access", 0.1), 9)


@query("decile_ratio", """WITH v AS (SELECT c_acctbal AS x, row_number() OVER (ORDER BY c_acctbal) AS up, row_number() OVER (ORDER BY c_acctbal DESC) AS dn, count(*) OVER () AS n FROM customer WHERE c_acctbal > 0)
SELECT round(avg(CASE WHEN dn <= ceil(n * 0.1::DOUBLE) THEN x END), 6) AS top_mean, round(avg(CASE WHEN up <= ceil(n * 0.1::DOUBLE) THEN x END), 6) AS bottom_mean, CAST(max(n) AS BIGINT) AS n, round(avg(CASE WHEN dn <= ceil(n * 0.1::DOUBLE) THEN x END) / avg(CASE WHEN up <= ceil(n * 0.1::DOUBLE) THEN x END), 6) AS multiple FROM v""")
def decile_ratio(spark, d):
    return rounded(risk.top_to_bottom_multiple(table(spark, d, "customer"), "c_acctbal"))


@query("percentile_axis", """WITH r AS (SELECT c_custkey AS code, c_nationkey, c_acctbal, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_nationkey, c_acctbal) - 1) / 2.0 AS ar, count(*) OVER (PARTITION BY c_nationkey) AS n, min(c_acctbal) OVER () AS lo, max(c_acctbal) OVER () AS hi FROM customer)
SELECT code, round(CASE WHEN n = 1 THEN 0.5 ELSE (ar - 1) / (n - 1) END, 6) AS percentile, round((c_acctbal - lo) / (hi - lo), 6) AS minmax FROM r""")
def percentile_axis(spark, d):
    c = table(spark, d, "customer")
    return rounded(c.select(F.col("c_custkey").alias("code"), percentile_score("c_acctbal", ["c_nationkey"]).alias("percentile"), minmax_score("c_acctbal").alias("minmax")))


_AXES = """a AS (SELECT c.c_custkey AS code, c_acctbal, t FROM customer c LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY 1) o ON o_custkey = c_custkey)"""


def _axes(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("code")).agg(F.sum("o_totalprice").alias("t"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("code"), "c_acctbal").join(o, "code", "left")


@query("spearman_axes", f"""WITH {_AXES}, p AS (SELECT c_acctbal AS x, round(t, 4) AS y FROM a WHERE c_acctbal IS NOT NULL AND t IS NOT NULL),
r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM p)
SELECT CAST(count(*) AS BIGINT) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r""")
def spearman_axes(spark, d):
    return rounded(risk.correlations(_axes(spark, d).withColumn("t", F.round("t", 4)), "c_acctbal", "t"))


@query("top_overlap", f"""WITH {_AXES}, x AS (SELECT code FROM a WHERE c_acctbal IS NOT NULL ORDER BY c_acctbal DESC, code LIMIT 200), y AS (SELECT code FROM a WHERE t IS NOT NULL ORDER BY round(t, 4) DESC, code LIMIT 200) SELECT CAST(count(*) AS BIGINT) AS overlap FROM x JOIN y USING (code)""")
def top_overlap(spark, d):
    return risk.top_overlap(_axes(spark, d).withColumn("t", F.round("t", 4)), "c_acctbal", "t", 200)


def _priority(spark, d):
    r = table(spark, d, "customer").select(F.col("c_custkey").alias("code"), F.expr("case when c_custkey % 11 = 0 then 'not_assessed_low_load' else 'assessed' end").alias("status"), F.when(F.col("c_custkey") % 13 != 0, F.col("c_acctbal")).alias("surge")).where("code % 17 <> 0")
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("code")).agg(F.round(F.sum("o_totalprice"), 4).alias("access")).where("code % 19 <> 0")
    return r, o


_PRI = """ri AS (SELECT c_custkey AS code, CASE WHEN c_custkey % 11 = 0 THEN 'not_assessed_low_load' ELSE 'assessed' END AS status, CASE WHEN c_custkey % 13 <> 0 THEN c_acctbal END AS surge FROM customer WHERE c_custkey % 17 <> 0),
eq AS (SELECT o_custkey AS code, round(sum(o_totalprice), 4) AS access FROM orders WHERE o_custkey % 19 <> 0 GROUP BY 1)"""
_SCORED = """j AS (SELECT coalesce(ri.code, eq.code) AS code, status, CASE WHEN status = 'assessed' THEN surge END AS rr, access FROM ri FULL JOIN eq ON ri.code = eq.code),
rk AS (SELECT code, CASE WHEN count(*) OVER () = 1 THEN 0.5 ELSE (rank() OVER (ORDER BY rr) + (count(*) OVER (PARTITION BY rr) - 1) / 2.0 - 1) / (count(*) OVER () - 1) END AS rn FROM j WHERE rr IS NOT NULL),
ek AS (SELECT code, 1 - CASE WHEN count(*) OVER () = 1 THEN 0.5 ELSE (rank() OVER (ORDER BY access) + (count(*) OVER (PARTITION BY access) - 1) / 2.0 - 1) / (count(*) OVER () - 1) END AS en FROM j WHERE access IS NOT NULL)"""


@query("priority_two_axis", f"""WITH {_PRI}, {_SCORED},
z AS (SELECT j.code, status, rr, access, rn, en, (coalesce(rn * 0.6::DOUBLE, 0) + coalesce(en * 0.4::DOUBLE, 0)) / nullif(CASE WHEN rn IS NOT NULL THEN 0.6::DOUBLE ELSE 0 END + CASE WHEN en IS NOT NULL THEN 0.4::DOUBLE ELSE 0 END, 0) AS score, CASE WHEN rn IS NULL THEN 0 ELSE 1 END + CASE WHEN en IS NULL THEN 0 ELSE 1 END AS axes FROM j LEFT JOIN rk USING (code) LEFT JOIN ek USING (code)),
q AS (SELECT *, axes >= 2 AND score IS NOT NULL AS eligible, round(score, 9) AS s9 FROM z)
SELECT code, status, round(rn, 6) AS risk_norm, round(en, 6) AS equity_norm, s9 AS score, axes AS axes_present, CASE WHEN rn IS NULL AND coalesce(status = 'not_assessed_low_load', false) THEN 'not_assessed_low_load' WHEN rn IS NOT NULL AND en IS NOT NULL THEN '' ELSE 'data_missing' END AS missing_reason,
concat_ws(',', CASE WHEN rn IS NULL THEN 'risk' END, CASE WHEN en IS NULL THEN 'equity' END) AS missing_axes, eligible, CASE WHEN eligible THEN CAST(row_number() OVER (PARTITION BY eligible ORDER BY s9 DESC, code) AS INTEGER) END AS rank FROM q""")
def priority_two_axis(spark, d):
    scored = risk.two_axes(*_priority(spark, d), F.lit(0.6), "surge").withColumn("score", F.round("score", 9))
    return risk.ranked(scored).select("code", "status", F.round("risk_norm", 6).alias("risk_norm"), F.round("equity_norm", 6).alias("equity_norm"), "score", "axes_present", "missing_reason", "missing_axes", "eligible", "rank")


@query("recommendations", f"""WITH {_PRI}, {_SCORED} SELECT j.code, CASE WHEN rn IS NULL OR en IS NULL THEN NULL WHEN rn >= 0.5 AND en >= 0.5 THEN 'both' WHEN rn >= 0.5 THEN 'grid' WHEN en >= 0.5 THEN 'chargers' ELSE 'watch' END AS advice FROM j LEFT JOIN rk USING (code) LEFT JOIN ek USING (code)""")
def recommendations(spark, d):
    scored = risk.two_axes(*_priority(spark, d), F.lit(0.5), "surge")
    return scored.select("code", risk.recommendation("risk_norm", "equity_norm").alias("advice"))


_CORNERS = """v AS (SELECT code, ring, x, y, row_number() OVER (PARTITION BY code, ring ORDER BY l, x, y) AS n FROM (SELECT l_orderkey AS code, CASE WHEN l_linenumber <= 4 THEN 0 ELSE 1 END AS ring, l_linenumber AS l, floor(l_quantity)::DOUBLE AS x, (CAST(floor(l_extendedprice) AS BIGINT) % 1000)::DOUBLE AS y FROM lineitem)),
e AS (SELECT code, ring, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x1, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y1 FROM v WINDOW w AS (PARTITION BY code, ring ORDER BY n) QUALIFY count(*) OVER (PARTITION BY code, ring) >= 3),
r AS (SELECT code, ring, sum(x * y1 - x1 * y) / 2 AS a, sum((x + x1) * (x * y1 - x1 * y)) / 6 AS mx, sum((y + y1) * (x * y1 - x1 * y)) / 6 AS my, (min(y) + max(y)) / 2 AS half FROM e GROUP BY 1, 2),
c AS (SELECT code, sum(CASE WHEN a <> 0 THEN mx ELSE 0 END) / sum(a) AS cx, sum(CASE WHEN a <> 0 THEN my ELSE 0 END) / sum(a) AS cy FROM r GROUP BY 1 HAVING sum(a) <> 0),
h AS (SELECT code, half FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY abs(a) DESC, ring) AS k FROM r) WHERE k = 1)"""
_CUT = "SELECT e.code, x + ({line} - y) * (x1 - x) / (y1 - y) AS px FROM e JOIN {of} USING (code) WHERE (y > {line}) <> (y1 > {line})"
_GAP = "SELECT code, arg_max((px + z) / 2, ROW(z - px, -k)) AS mid, max(z - px) AS wide FROM (SELECT code, px, lead(px) OVER (PARTITION BY code ORDER BY px) AS z, row_number() OVER (PARTITION BY code ORDER BY px) AS k FROM {cut}) WHERE k % 2 = 1 AND z IS NOT NULL GROUP BY 1"


def _corners(spark, d):
    """Orders as polygons: up to two rings each, with lines as their corners (whole numbers, so that areas are exact)."""
    x, y = F.floor("l_quantity").cast("double"), (F.floor("l_extendedprice") % 1000).cast("double")
    v = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("code"), F.when(F.col("l_linenumber") <= 4, 0).otherwise(1).alias("ring"), F.col("l_linenumber").alias("l"), x.alias("x"), y.alias("y"))
    return v.select("code", "ring", "x", "y", F.row_number().over(Window.partitionBy("code", "ring").orderBy("l", "x", "y")).alias("n"))


@query("polygon_points", f"""WITH {_CORNERS}, k1 AS ({_CUT.format(line='cy', of='c')}), k2 AS ({_CUT.format(line='half', of='h')}), g1 AS ({_GAP.format(cut='k1')}), g2 AS ({_GAP.format(cut='k2')}),
i AS (SELECT code, sum(CASE WHEN px > cx THEN 1 ELSE 0 END) % 2 = 1 AS within FROM k1 JOIN c USING (code) GROUP BY 1), m AS (SELECT code, avg(x) AS vx, avg(y) AS vy FROM v GROUP BY 1),
s AS (SELECT m.code, vx, vy, cx, cy, half, g1.mid AS m1, g2.mid AS m2, CASE WHEN cx IS NULL THEN 0 WHEN within THEN 1 WHEN wide1 > 0 THEN 2 WHEN g2.mid IS NOT NULL THEN 3 ELSE 4 END AS w
FROM m LEFT JOIN c USING (code) LEFT JOIN h USING (code) LEFT JOIN i USING (code) LEFT JOIN (SELECT code, mid, wide AS wide1 FROM g1) g1 USING (code) LEFT JOIN g2 USING (code))
SELECT code, round(CASE w WHEN 0 THEN vx WHEN 1 THEN cx WHEN 2 THEN m1 WHEN 3 THEN m2 ELSE cx END, 6) AS x, round(CASE w WHEN 0 THEN vy WHEN 3 THEN half ELSE cy END, 6) AS y,
CASE w WHEN 0 THEN '{polygons.MEAN}' WHEN 1 THEN '{polygons.CENTROID}' WHEN 4 THEN '{polygons.FAILED}' ELSE '{polygons.INSIDE}' END AS how FROM s""")
def polygon_points(spark, d):
    return rounded(polygons.polygon_points(_corners(spark, d)))


_BOX = "SELECT {key} AS code, ({key} * 7919 % 1000)::DOUBLE AS x0, ({key} * 104729 % 997)::DOUBLE AS y0, ({key} * 7919 % 1000 + {w} + {key} % 30)::DOUBLE AS x1, ({key} * 104729 % 997 + {w} + {key} % 17)::DOUBLE AS y1 FROM {table}"


def _rectangles(spark, d, name, key, width):
    k = F.col(key)
    x, y = k * 7919 % 1000, k * 104729 % 997
    far_x, far_y = x + width + k % 30, y + width + k % 17
    corners = F.array(*[F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")) for a, b in ((x, y), (far_x, y), (far_x, far_y), (x, far_y))])
    return table(spark, d, name).select(k.alias("code"), F.lit(0).alias("ring"), F.posexplode(corners).alias("n", "c")).select("code", "ring", "n", "c.x", "c.y")


@query("overlay_weights", f"""WITH p AS ({_BOX.format(key='c_custkey', w=15, table='customer')}), q AS ({_BOX.format(key='s_suppkey', w=70, table='supplier')}),
o AS (SELECT p.code, q.code AS other, (least(p.x1, q.x1) - greatest(p.x0, q.x0)) * (least(p.y1, q.y1) - greatest(p.y0, q.y0)) AS area FROM p JOIN q ON p.x0 < q.x1 AND q.x0 < p.x1 AND p.y0 < q.y1 AND q.y0 < p.y1),
s AS (SELECT code, other, area / sum(area) OVER (PARTITION BY code) AS share FROM o) SELECT code, other, round(share / sum(share) OVER (PARTITION BY code), 4) AS weight FROM s WHERE share >= 0.01::DOUBLE""")
def overlay_weights(spark, d):
    return polygons.overlay_weights(_rectangles(spark, d, "customer", "c_custkey", 15), _rectangles(spark, d, "supplier", "s_suppkey", 70), 50.0)
