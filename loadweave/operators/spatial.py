"""Radius joins, nearest neighbours and floating-catchment accessibility.

A radius join buckets both sides by a grid at least a radius wide and meets the
neighbouring cells by an equi-join, so that no pair of distant rows is ever formed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import EARTH_KM, haversine_km, ratio, slope_factor
from ..functions.stored import stored

#: Places up to which a dimension is sent to every task, once counted.
SMALL = 20_000
#: Rows of one spot that travel as one.
BLOCK = 1000
#: Shares of rows below and above a quantile between which it is looked for exactly.
_AROUND = 0.002


def _sphere(lat: Column, lon: Column) -> list[Column]:
    """Place on the unit sphere."""
    a, o = F.radians(lat), F.radians(lon)
    return [F.cos(a) * F.cos(o), F.cos(a) * F.sin(o), F.sin(a)]


def _chord(km: float) -> float:
    """Straight distance on the unit sphere of two places km apart along it."""
    return 2 * math.sin(min(km / EARTH_KM, math.pi) / 2)


def _cells(lat: Column, lon: Column, side: float) -> list[Column]:
    return [F.floor(x / side).cast("long") for x in _sphere(lat, lon)]


def _met(left: DataFrame, right: DataFrame, km: float) -> DataFrame:
    """left x right within km, row by row: for spots, of which each side holds few copies."""
    side = max(_chord(km * 1.001), 1e-9)
    names = ["__x", "__y", "__z"]
    one = left.where("lat is not null and lon is not null").withColumns(dict(zip(names, _cells(F.col("lat"), F.col("lon"), side), strict=True)))
    two = right.where("lat2 is not null and lon2 is not null").withColumns(dict(zip(names, _cells(F.col("lat2"), F.col("lon2"), side), strict=True)))
    for n in names:
        two = two.withColumn(n, F.explode(F.sequence(F.col(n) - 1, F.col(n) + 1)))
    centre = F.sqrt(sum((F.pow((F.col(n) + 0.5) * side, 2) for n in names), F.lit(0.0)))
    two = two.where(F.abs(centre - 1) <= side * 0.87)  # half a cube's diagonal
    joined = one.join(two, names).withColumn("dist_km", haversine_km("lat", "lon", "lat2", "lon2"))
    return joined.where(F.col("dist_km") <= km).drop(*names)


def _blocks(df: DataFrame, at: list[str], name: str) -> DataFrame:
    """Spots with their rows as arrays of about ``BLOCK``, dealt by a hash (equal rows stay together)."""
    placed = df.where(" and ".join(f"{c} is not null" for c in at))
    sizes = placed.groupBy(*at).agg((F.floor(F.count("*") / BLOCK) + 1).alias("__k"))
    dealt = placed.join(sizes, at).withColumn("__b", F.pmod(F.xxhash64(*df.columns), F.col("__k")))
    return dealt.groupBy(*at, F.col("__b").alias(f"{name}_b")).agg(F.collect_list(F.struct(*df.columns)).alias(name))


def radius_join(left: DataFrame, right: DataFrame, km: float, digits: int | None = None) -> DataFrame:
    """left x right within km (closed): columns of both, and dist_km (rounded, if digits are given).

    left has lat, lon; right has lat2, lon2; rows without coordinates go.  Cells are cubes around the
    unit sphere, a chord of the radius wide, so they serve any latitude and the date line alike;
    of the neighbours only those that the sphere cuts are met.  Distances are those of distinct
    spots; rows travel in blocks of one spot and form their pairs where these arrive.
    """
    spots = _met(_spots(left), right.select("lat2", "lon2").distinct(), km)
    spots = spots if digits is None else spots.withColumn("dist_km", F.round("dist_km", digits))
    met = _blocks(left, ["lat", "lon"], "__l").join(spots, ["lat", "lon"]).join(_blocks(right, ["lat2", "lon2"], "__r"), ["lat2", "lon2"])
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, as tasks merged by their bytes would hold very many pairs
    met = met.repartition(tasks, "lat", "lon", "lat2", "lon2", "__l_b", "__r_b").select("dist_km", F.explode("__l").alias("__l"), "__r")
    return met.select("dist_km", "__l", F.explode("__r").alias("__r")).select("__l.*", "__r.*", "dist_km")


def _spots(points: DataFrame) -> DataFrame:
    return points.select("lat", "lon").where("lat is not null and lon is not null").distinct()


def _best(near: DataFrame, code: str) -> DataFrame:
    best = near.groupBy("lat", "lon").agg(F.min(F.struct("dist_km", "__code")).alias("b"))
    return best.select("lat", "lon", F.col("b.__code").alias(code), F.col("b.dist_km").alias("dist_km"))


def _first_at(places: DataFrame, code: str) -> DataFrame:
    """lat2, lon2 and the smallest code of every spot with places."""
    known = places.select(F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.struct(F.col(code).alias("__code")).alias("__s")).where("lat2 is not null and lon2 is not null")
    return known.groupBy("lat2", "lon2").agg(F.min("__s").alias("__s")).select("lat2", "lon2", "__s.__code")


def _told(points: DataFrame, found: DataFrame, key: str, code: str, max_km: float | None) -> DataFrame:
    """What was found for a spot as each of its points' own; beyond max_km without the code."""
    own = points.select(key, "lat", "lon").join(found, ["lat", "lon"]).groupBy(key).agg(F.min(F.struct("dist_km", code)).alias("b"))
    out = points.select(key).join(own, key, "left").select(key, F.col(f"b.{code}").alias(code), F.col("b.dist_km").alias("dist_km"))
    return out.withColumn(code, F.when(F.col("dist_km") <= max_km, F.col(code))) if max_km is not None else out


def _far(rest: DataFrame, right: DataFrame, cell_km: float = 500.0) -> DataFrame:
    """Pairs of points with the places that may be nearest, for points far from all: cells of points
    meet cells of places (a few thousand at most, whatever the tables' sizes), and only those cells
    whose least possible distance isn't above another's largest go on."""
    side = _chord(cell_km)
    names = ["x", "y", "z"]
    cell = lambda lat, lon, p: [c.alias(f"{p}{n}") for n, c in zip(names, _cells(F.col(lat), F.col(lon), side), strict=True)]
    points = rest.select("*", *cell("lat", "lon", "p"))
    places = right.select("*", *cell("lat2", "lon2", "q"))
    ps, qs = [f"p{n}" for n in names], [f"q{n}" for n in names]
    gap = F.sqrt(sum((F.pow((F.col(a) - F.col(b)) * side, 2) for a, b in zip(ps, qs, strict=True)), F.lit(0.0)))
    slack = 2 * side * math.sqrt(3) / 2
    met = points.select(*ps).distinct().crossJoin(F.broadcast(places.select(*qs).distinct())).withColumn("gap", gap)
    least = F.min("gap").over(Window.partitionBy(*ps))
    met = met.withColumn("least", least).where(F.col("gap") - slack <= F.col("least") + slack).select(*ps, *qs)
    return points.join(met, ps).join(places, qs)


def nearest(points: DataFrame, places: DataFrame, key: str, code: str, max_km: float | None = None, rings: tuple[float, ...] = (2.0, 20.0, 200.0)) -> DataFrame:
    """key, code and dist_km of each point's nearest place (smaller code on ties).

    Spots of points are searched within growing radii, each round only those without a find yet; what is
    left meets the places of the cells that may hold its nearest.  Points and places of one spot
    count as one, so the search grows with distinct spots.  Beyond max_km the code is
    NULL, the distance stays.  Points without coordinates come back with NULLs; places without
    coordinates are never found.
    """
    right = _first_at(places, code)
    rest, found = _spots(points), None
    for km in rings:
        best = _best(_met(rest, right, km), code)
        found = best if found is None else found.unionByName(best)
        rest = rest.join(best.select("lat", "lon"), ["lat", "lon"], "left_anti")
    last = _best(_far(rest, right).withColumn("dist_km", haversine_km("lat", "lon", "lat2", "lon2")), code)
    return _told(points, last if found is None else found.unionByName(last), key, code, max_km)


def nearest_small(points: DataFrame, places: DataFrame, key: str, code: str, max_km: float | None = None) -> DataFrame:
    """As ``nearest`` for a dimension of places (checked: at most ``SMALL`` spots), in one pass without rings."""
    right = _first_at(places, code)
    if right.count() > SMALL:
        return nearest(points, places, key, code, max_km)
    near = _spots(points).join(F.broadcast(right))
    return _told(points, _best(near.withColumn("dist_km", haversine_km("lat", "lon", "lat2", "lon2")), code), key, code, max_km)


def within_radius_share(points: DataFrame, places: DataFrame, key: str, km: float) -> DataFrame:
    """One row: points with coordinates, those with any place within km, and their share."""
    have = points.where("lat is not null and lon is not null").select(key, "lat", "lon")
    near = _met(_spots(have), places.selectExpr("lat as lat2", "lon as lon2").distinct(), km).select("lat", "lon").distinct()
    hit = have.join(near, ["lat", "lon"]).select(key).distinct()
    flagged = have.join(hit.withColumn("hit", F.lit(1)), key, "left")
    return flagged.agg(F.count("*").alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_within"), F.avg(F.coalesce("hit", F.lit(0))).alias("share"))


def catchment(stations: DataFrame, points: DataFrame, km: float, distance: Column | None = None) -> DataFrame:
    """Two-step floating catchment: code and access (0 where no station is in reach).

    stations: station, lat, lon, chargers; points: code, lat, lon, ev (NULL counts 0).  Step 1:
    chargers over the demand within km, 0 where there is none; step 2: the sum of these.
    distance: made of dist_km, elev and elev_station.  Both steps add up over pairs of spots (places of one
    height, where a distance is given), so rows that share a spot form no pairs of their own.
    """
    p_spot, q_spot = [F.col("lat"), F.col("lon")], [F.col("lat").alias("lat2"), F.col("lon").alias("lon2")]
    if distance is not None:
        p_spot += [F.col(c) for c in points.columns if c == "elev"]
        q_spot += [F.col(c) for c in stations.columns if c == "elev_station"]
    known = "lat is not null and lon is not null"
    placed = points.where(known).select("code", F.coalesce("ev", F.lit(0.0)).alias("ev"), F.struct(*p_spot).alias("__p"))
    sites = stations.where(known).select("station", "chargers", F.struct(*q_spot).alias("__q"))
    left = placed.groupBy("__p").agg(F.sum("ev").alias("ev")).select("__p", "__p.*", "ev")
    pairs = radius_join(left, sites.select("__q").distinct().select("__q", "__q.*"), km)
    if distance is not None:  # never shorter than the straight line, so the radius join holds all
        pairs = pairs.withColumn("dist_km", distance).where(F.col("dist_km") <= km)
    demand = sites.join(pairs.groupBy("__q").agg(F.sum("ev").alias("demand")), "__q").groupBy("station", "chargers").agg(F.sum("demand").alias("demand"))
    supply = demand.select("station", F.when(F.col("demand") > 0, F.col("chargers") / F.col("demand")).otherwise(F.lit(0.0)).alias("r"))
    offered = sites.select("station", "__q").join(supply, "station").groupBy("__q").agg(F.sum("r").alias("r"))
    reached = pairs.select("__p", "__q").join(offered, "__q").groupBy("__p").agg(F.sum("r").alias("access"))
    access = placed.select("code", "__p").join(reached, "__p").groupBy("code").agg(F.sum("access").alias("access"))
    return points.select("code").join(access, "code", "left").select("code", F.coalesce("access", F.lit(0.0)).alias("access"))


def slope_distance(max_grade: float = 0.3, min_m: float = 50.0) -> Column:
    """Distance times the slope factor of the straight line between elev and elev_station."""
    metres = F.col("dist_km") * 1000.0
    grade = F.when(metres >= min_m, (F.col("elev_station") - F.col("elev")) / F.nullif(metres, F.lit(0.0)))
    grade = F.least(F.greatest(F.coalesce(grade, F.lit(0.0)), F.lit(-max_grade)), F.lit(max_grade))
    return F.col("dist_km") * slope_factor(grade)


def access_indicators(stations: DataFrame, points: DataFrame) -> DataFrame:
    """Chargers of the stations nearest to each point (0 if none), EVs per charger, kilometres to the nearest station."""
    owner = nearest_small(stations.selectExpr("station", "lat", "lon"), points.select("code", "lat", "lon"), "station", "code")
    owned = stations.join(owner, "station").groupBy("code").agg(F.sum("chargers").alias("chargers"))
    near = nearest_small(points.select("code", "lat", "lon"), stations.selectExpr("station", "lat", "lon"), "code", "station")
    out = points.join(owned, "code", "left").join(near.select("code", F.col("dist_km").alias("nearest_km")), "code", "left")
    chargers = F.coalesce("chargers", F.lit(0.0))
    return out.select("code", chargers.alias("chargers"), ratio("ev", chargers).alias("ev_per_charger"), "nearest_km")


def bottom_with_ties(df: DataFrame, value: str, share: float) -> DataFrame:
    """Rows up to the value of the ceil(n * share)-th smallest, ties included.

    Only the distinct values between two sketched quantiles around it are ordered, a few thousandths of
    all; where these miss it (checked by counts), all distinct ones are.  Rows are stored before, as
    a sum computed twice may differ in its last bit and lose the rows that tie with the limit.
    """
    kept = stored(df.where(F.col(value).isNotNull()), "ranked")
    around = F.array(*[F.lit(min(max(share + d, 0.0), 1.0)) for d in (-_AROUND, _AROUND)])
    sketch = kept.agg(F.count("*").alias("n"), F.percentile_approx(value, around, 10_000).alias("q")).select("n", F.get("q", F.lit(0)).alias("__low"), F.get("q", F.lit(1)).alias("__high"))
    inside = F.col(value).between(F.col("__low"), F.col("__high"))
    n, below, held = kept.crossJoin(F.broadcast(sketch)).agg(F.max("n"), F.count_if(F.col(value) < F.col("__low")), F.count_if(inside)).first()
    wanted = max(1, math.ceil((n or 0) * share))
    counts = kept.groupBy(value).agg(F.count("*").alias("__m"))
    if below < wanted <= below + held:
        counts = counts.crossJoin(F.broadcast(sketch)).where(inside).select(value, "__m")
        wanted -= below
    upto = counts.withColumn("__upto", F.sum("__m").over(Window.orderBy(value)))
    limit = upto.where(F.col("__upto") >= wanted).agg(F.min(value).alias("__limit"))
    return kept.crossJoin(F.broadcast(limit)).where(F.col(value) <= F.col("__limit")).drop("__limit")


def added_chargers(stations: DataFrame, points: DataFrame, chosen: dict[str, DataFrame], chargers: float, km: float) -> DataFrame:
    """Access before and after virtual stations at the chosen codes, by strategy; the low set is that from before."""
    before = catchment(stations, points, km)
    out = before.select(F.lit("before").alias("strategy"), "code", "access")
    for name, codes in chosen.items():
        virtual = points.join(codes.select("code"), "code", "left_semi").selectExpr("concat('virtual_', code) as station", "lat", "lon", f"cast({chargers} as double) as chargers")
        after = catchment(stations.select("station", "lat", "lon", "chargers").unionByName(virtual), points, km)
        out = out.unionByName(after.select(F.lit(name).alias("strategy"), "code", "access"))
    return out


def access_gap(access: DataFrame, low: DataFrame) -> DataFrame:
    """By strategy: codes without access, mean access of the low set and of the rest."""
    marked = access.join(low.select("code").withColumn("low", F.lit(True)), "code", "left")
    return marked.groupBy("strategy").agg(F.count_if(F.col("access") == 0).alias("n_zero"), F.avg(F.when(F.col("low"), F.col("access"))).alias("mean_low"), F.avg(F.when(F.col("low").isNull(), F.col("access"))).alias("mean_rest"))


def with_elevation(points: DataFrame, known: DataFrame, digits: int = 3, low: float = -100.0, high: float = 3000.0) -> tuple[DataFrame, DataFrame]:
    """(points with elev, places to look up): elevations of a table of known places, met on rounded coordinates.

    known: lat, lon, elev; several at one rounded place count by their mean; values out of range are none.
    """
    at = [F.round("lat", digits).alias("__lat"), F.round("lon", digits).alias("__lon")]
    usable = known.where(F.col("elev").between(low, high)).groupBy(*at).agg(F.avg("elev").alias("elev"))
    keyed = points.withColumns({"__lat": F.round("lat", digits), "__lon": F.round("lon", digits)})
    held = keyed.join(usable, ["__lat", "__lon"], "left")
    absent = keyed.where("lat is not null and lon is not null").select("__lat", "__lon").distinct().join(known.select(*at).distinct(), ["__lat", "__lon"], "left_anti")
    return held.drop("__lat", "__lon"), absent.select(F.col("__lat").alias("lat"), F.col("__lon").alias("lon"))
