"""Vehicle logs: pair anomalies, charging sessions, homes, base places, occupancy and cross-checks."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import average_rank, geo_cell, haversine_km, ratio
from ..functions.stored import components, stored

SECONDS = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6


def vehicle_sample(log: DataFrame, key: str, most: int, seed: int = 0) -> DataFrame:
    """Whole vehicles in hash order while their rows fit into ``most``; everything where it fits anyway."""
    # Two levels of running sums: over slices of the hash, which are few, then within a slice.
    sizes = log.groupBy(key).agg(F.count("*").alias("n")).withColumn("h", F.xxhash64(key, F.lit(seed))).withColumn("slice", F.shiftright("h", 52))
    slices = sizes.groupBy("slice").agg(F.sum("n").alias("held"))
    before = slices.select("slice", (F.sum("held").over(Window.orderBy("slice")) - F.col("held")).alias("before"), F.sum("held").over(Window.partitionBy()).alias("total"))
    within = F.sum("n").over(Window.partitionBy("slice").orderBy("h", key).rowsBetween(Window.unboundedPreceding, 0))
    running = sizes.withColumn("upto", within).join(F.broadcast(before), "slice")  # at most 4096 slices
    return log.join(running.where(f"total <= {most} or before + upto <= {most}").select(key), key, "left_semi")


def pair_speeds(log: DataFrame, key: str, time: str = "ts", max_minutes: float = 10.0) -> DataFrame:
    """Consecutive rows of one vehicle up to max_minutes apart: minutes, km and km/h (infinite where time stands still and place doesn't, NULL without coordinates)."""
    over = Window.partitionBy(key).orderBy(time, *(["event_id"] if "event_id" in log.columns else []))
    rows = log.withColumns({"__t": F.lag(SECONDS(time)).over(over), "__lat": F.lag("lat").over(over), "__lon": F.lag("lon").over(over)})
    rows = rows.withColumns({"minutes": (SECONDS(time) - F.col("__t")) / 60, "km": haversine_km("__lat", "__lon", "lat", "lon")}).where(F.col("minutes").between(0, max_minutes))
    speed = F.when(F.col("minutes") > 0, F.col("km") / F.nullif(F.col("minutes"), F.lit(0.0)) * 60).when(F.col("km") > 0.5, F.lit(float("inf"))).when(F.col("km").isNotNull(), F.lit(0.0))
    return rows.withColumn("kmh", speed).select(key, time, "minutes", "km", "kmh")


def key_verdict(pairs: DataFrame, key: str, n_ids: int, limit_kmh: float = 200.0, least_pairs: int = 5) -> DataFrame:
    """One row: shares of impossible pairs and of ids with them, and what the id therefore stands for."""
    bad = F.col("kmh") > limit_kmh
    per = pairs.groupBy(key).agg(F.count("*").alias("n"), F.avg(bad.cast("int")).alias("share"))
    out = per.agg(F.sum("n").alias("n_pairs"), F.sum(F.col("share") * F.col("n")).alias("n_bad"), F.count_if(F.col("n") >= least_pairs).alias("n_judged"), F.count_if((F.col("n") >= least_pairs) & (F.col("share") > 0.05)).alias("n_bad_ids"))
    out = out.select(F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), ratio("n_bad", "n_pairs").alias("bad_share"), ratio(F.col("n_bad_ids").cast("double"), F.col("n_judged").cast("double")).alias("bad_id_share"))
    verdict = F.when(F.lit(n_ids) == 0, "unknown").when(F.col("n_pairs") < least_pairs, "unknown").when((F.col("bad_share") > 0.05) | (F.col("bad_id_share") > 0.2), "model").otherwise("individual")
    return out.withColumn("verdict", verdict)


def sessions(log: DataFrame, key: list[str], charging: Column, gap_minutes: float = 15.0, time: str = "ts", tie: list[str] | None = None, by_transition: bool = True, shortest: float = 3.0, longest: float = 1440.0) -> DataFrame:
    """Charging sessions of each key.

    by_transition: a session begins where the previous row of any kind isn't charging, is more
    than the gap away (strictly) or doesn't exist; else only charging rows count and the gap
    alone divides.  Durations outside the closed bounds go.
    """
    over = Window.partitionBy(*key).orderBy(time, *(tie or []))
    rows = log.withColumn("__c", F.coalesce(charging, F.lit(False)))
    rows = rows if by_transition else rows.where("__c")
    before = F.lag(SECONDS(time)).over(over)
    far = before.isNull() | ((SECONDS(time) - before) / 60 > gap_minutes)
    starts = F.col("__c") & (far | ~F.coalesce(F.lag("__c").over(over), F.lit(False))) if by_transition else far
    rows = rows.withColumn("__s", starts.cast("int")).withColumn("session", F.sum("__s").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    extra = [F.median(c).alias(c) for c in ("lat", "lon") if c in log.columns]
    extra += [F.min_by("soc", time).alias("soc_start"), F.max_by("soc", time).alias("soc_end")] if "soc" in log.columns else []
    out = rows.where("__c").groupBy(*key, "session").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n"), *extra)
    out = out.withColumn("duration_min", (SECONDS("end") - SECONDS("start")) / 60)
    return out.where(F.col("duration_min").between(shortest, longest))


def session_histogram(found: DataFrame, edges: tuple[float, ...] = (0, 10, 20, 30, 40, 60, 90, 120, 240, 480, 1440)) -> DataFrame:
    """Sessions by duration, bins closed on the left; empty bins stay."""
    spark = found.sparkSession
    bins = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "bin int, low double, high double")
    counted = found.join(F.broadcast(bins), (F.col("duration_min") >= F.col("low")) & (F.col("duration_min") < F.col("high"))).groupBy("bin").agg(F.count("*").alias("n"))
    return bins.join(counted, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def duration_summary(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("n"), F.median("duration_min").alias("median"), F.avg("duration_min").alias("mean"), F.avg(F.col("duration_min").between(20, 39.999999).cast("int")).alias("share_20_40"))


def home_cells(log: DataFrame, key: str, cell: str, time: str = "ts", start_hour: int = 22, end_hour: int = 6, nights: int = 3, share: float = 0.5) -> DataFrame:
    """Each night's most frequent cell (smaller on ties), then the most frequent of these if it has enough nights and share."""
    hour = F.hour(time)
    at_night = log.where((hour >= start_hour) | (hour < end_hour)).withColumn("night", F.to_date(F.col(time) - F.make_dt_interval(F.lit(0), F.lit(end_hour))))
    counted = at_night.groupBy(key, "night", cell).agg(F.count("*").alias("n"))
    top = counted.withColumn("r", F.row_number().over(Window.partitionBy(key, "night").orderBy(F.desc("n"), cell))).where("r = 1")
    cells = top.groupBy(key, cell).agg(F.count("*").alias("nights")).withColumn("of", F.sum("nights").over(Window.partitionBy(key)))
    best = cells.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("nights"), cell))).where("r = 1")
    return best.where((F.col("nights") >= nights) & (F.col("nights") >= share * F.col("of"))).select(key, cell, "nights")


def occupancy(found: DataFrame) -> DataFrame:
    """Hours of overlap of sessions with each clock hour; sessions that don't last count nothing."""
    start, end = SECONDS("start"), SECONDS("end")
    first = F.floor(start / 3600)
    last = F.floor((end - 1e-6) / 3600)
    slots = found.where(end > start).select(start.alias("a"), end.alias("b"), F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("slot"))
    hours = (F.least("b", (F.col("slot") + 1) * 3600) - F.greatest("a", F.col("slot") * 3600)) / 3600
    return slots.groupBy(F.pmod("slot", F.lit(24)).cast("int").alias("hour")).agg(F.sum(hours).alias("hours"))


def charging_shape(occupied: DataFrame, least: int, n_sessions: int) -> DataFrame:
    """All 24 hours over the largest one; NULL under ``least`` sessions."""
    spine = occupied.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    full = spine.join(occupied, "hour", "left").withColumn("hours", F.coalesce("hours", F.lit(0.0)))
    top = F.max("hours").over(Window.partitionBy())
    return full.select("hour", F.when(F.lit(n_sessions >= least), ratio("hours", top)).alias("share"))


def shape_correlation(one: DataFrame, two: DataFrame, value: str = "hours") -> DataFrame:
    """Pearson correlation of two profiles' shares over all 24 hours."""
    spine = one.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    both = spine.join(one.select("hour", F.col(value).alias("x")), "hour", "left").join(two.select("hour", F.col(value).alias("y")), "hour", "left").fillna(0.0, ["x", "y"])
    every = Window.partitionBy()
    shares = both.select(ratio("x", F.sum("x").over(every)).alias("x"), ratio("y", F.sum("y").over(every)).alias("y"))
    return shares.agg(F.corr("x", "y").alias("pearson"))


def away_charging(found: DataFrame, homes: DataFrame, key: str, region: str, away_km: float = 1.0, least: int = 1) -> DataFrame:
    """By region: sessions of vehicles with a home, share away from it, vehicles that never charge at home, mean away distance."""
    rows = found.join(homes.select(key, F.col("lat").alias("home_lat"), F.col("lon").alias("home_lon")), key).withColumn("km", haversine_km("lat", "lon", "home_lat", "home_lon"))
    away = F.col("km") > away_km
    per = rows.groupBy(key, region).agg(F.count("*").alias("n"), F.count_if(away).alias("n_away"), F.avg(F.when(away, F.col("km"))).alias("away_km"))
    out = per.groupBy(region).agg(F.count("*").alias("n_vehicles"), F.sum("n").alias("n_sessions"), F.sum("n_away").alias("n_away"), F.avg((F.col("n") == F.col("n_away")).cast("int")).alias("no_home_share"), F.avg("away_km").alias("away_km"))
    shown = F.col("n_vehicles") >= least
    return out.select(region, "n_vehicles", *[F.when(shown, c).alias(n) for n, c in {"away_ratio": F.col("n_away") / F.col("n_sessions"), "no_home_share": F.col("no_home_share"), "away_km": F.col("away_km")}.items()])


def soc_bands(found: DataFrame, least: int = 1) -> DataFrame:
    """Sessions by starting charge in fifths (percent, scaled if all are fractions); few are hidden."""
    top = found.agg(F.max("soc_start").alias("__top"))
    scaled = found.crossJoin(F.broadcast(top)).withColumn("soc", F.col("soc_start") * F.when(F.col("__top") <= 1, 100).otherwise(1))
    band = F.least(F.floor(F.col("soc") / 20), F.lit(4)).cast("int")
    bands = found.sparkSession.range(5).select(F.col("id").cast("int").alias("band"))
    counted = scaled.where("soc is not null").groupBy(band.alias("band")).agg(F.count("*").alias("n"))
    return bands.join(counted, "band", "left").select("band", F.when(F.coalesce("n", F.lit(0)) >= least, F.coalesce("n", F.lit(0))).alias("n"))


def low_access_contrast(regions: DataFrame, value: str = "away_ratio", access: str = "access", share: float = 0.2) -> DataFrame:
    """Mean of a value where access is at most its quantile, and elsewhere, with the rank correlation."""
    kept = regions.where(F.col(value).isNotNull() & F.col(access).isNotNull())
    cut = kept.agg(F.percentile(access, F.lit(share)).alias("__cut"))
    ranked = kept.crossJoin(F.broadcast(cut)).select(value, access, (F.col(access) <= F.col("__cut")).alias("low"), average_rank(value).alias("rv"), average_rank(access).alias("ra"))
    fine = (F.count("*") >= 3) & (F.min(value) < F.max(value)) & (F.min(access) < F.max(access))
    return ranked.agg(F.count("*").alias("n"), F.avg(F.when(F.col("low"), F.col(value))).alias("mean_low"), F.avg(F.when(~F.col("low"), F.col(value))).alias("mean_rest"), F.when(fine, F.corr("rv", "ra")).alias("spearman"))


#: A cell's side as a share of the distance: its points are all within that distance of one another.
_SIDE = 0.999 / 3**0.5
#: Micro cells along a cell's side.
_MICRO = 16
#: Sessions up to which a vehicle is clustered as a whole.
WHOLE = 256
_NO_DAY = -(2**31)


def _sphere_points(found: DataFrame, key: str) -> DataFrame:
    """key, session, day, x, y, z (on the unit sphere) of every session with a place."""
    lat, lon = F.radians("lat"), F.radians("lon")
    return found.where("lat is not null and lon is not null").select(key, "session", F.to_date("start").alias("day"), (F.cos(lat) * F.cos(lon)).alias("x"), (F.cos(lat) * F.sin(lon)).alias("y"), F.sin(lat).alias("z"))


def _clusters(x: np.ndarray, y: np.ndarray, z: np.ndarray, eps: float, least: int) -> np.ndarray:
    """Of each point the first core point of its cluster (-1: none)."""
    near = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2 + (z[:, None] - z) ** 2 <= eps**2
    core = np.flatnonzero(near.sum(axis=1) >= least)
    out, among, label, last = np.full(len(x), -1), near[np.ix_(core, core)], np.arange(len(core)), None
    while len(core) and not np.array_equal(label, last):
        last, label = label, np.where(among, label, len(core)).min(axis=1)
        label = label[label]
    if len(core):
        of = np.where(near[:, core], core[label], len(x)).min(axis=1)
        out = np.where(of < len(x), of, -1)
        out[core] = core[label]  # a core point's core neighbours are all of its own cluster
    return out


def _whole_vehicles(points: DataFrame, key: str, eps: float, least: int, days: int) -> DataFrame:
    """``base_sessions`` of vehicles with few sessions each, which come as one row."""

    def run(batches):
        for batch in batches:
            parts = []
            for k, *columns in batch.itertuples(index=False):
                session, day, x, y, z = (np.asarray(c) for c in columns)
                first = _clusters(x, y, z, eps, least)
                seen = Counter(c for c, d in set(zip(first.tolist(), day.tolist(), strict=True)) if d != _NO_DAY)
                base = [c >= 0 and seen[c] >= days for c in first.tolist()]
                parts.append(pd.DataFrame({key: [k] * len(first), "session": session, "cluster": np.where(first < 0, -1, session[first]), "is_base": base}))
            if parts:
                yield pd.concat(parts)

    day = F.coalesce(F.unix_date("day"), F.lit(_NO_DAY))
    held = points.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("session", day.alias("day"), "x", "y", "z"))).alias("p"))
    kind = points.schema[key].dataType.simpleString()
    return held.select(key, *[f"p.{c}" for c in ("session", "day", "x", "y", "z")]).mapInPandas(run, f"`{key}` {kind}, session long, cluster long, is_base boolean")


def _square(one: str, two: str) -> Column:
    return sum(((F.col(f"{one}.{c}") - F.col(f"{two}.{c}")) ** 2 for c in "xyz"), F.lit(0.0))


def base_sessions(found: DataFrame, key: str, eps_m: float = 150.0, least: int = 3, days: int = 3, whole: int = WHOLE) -> DataFrame:
    """Density clusters of a vehicle's sessions (within eps, at least so many, the point included); a cluster seen on enough days is a base.

    key, session, cluster (its first core session; -1: none) and is_base.  A session near several clusters
    belongs to the one whose first core session is the smallest; sessions without a key or place go.

    A vehicle of up to ``whole`` sessions is clustered in one piece, those of more by cells; results are the same.
    """
    eps = 2 * float(np.sin(min(eps_m / 6371008.8, np.pi) / 2))
    points = stored(_sphere_points(found, key), "places")
    sizes = stored(points.groupBy(key).agg(F.count("*").alias("__n")), "sizes")
    out = _whole_vehicles(points.join(sizes.where(F.col("__n") <= whole).select(key), key), key, eps, least, days)
    many = sizes.where(F.col("__n") > whole).select(key)
    return out if many.isEmpty() else out.unionByName(_by_cells(points.join(many, key), key, eps, least, days))


def _by_cells(placed: DataFrame, key: str, eps: float, least: int, days: int) -> DataFrame:
    """``base_sessions`` of vehicles with any number of sessions.

    Cells are so small that their points are all within eps of one another: where a cell has enough of them, all
    are core without a look at any pair, and all core points of a cell are of one cluster.  Only the few
    points of emptier cells are compared with those of neighbouring cells.  Neighbouring cells are joined if their
    micro cells show that some pair of core points is, or none can be, within eps, and only else by the points of
    the micro cells in doubt.  Cells form clusters as connected components; no vehicle is one task.
    """
    side = eps * _SIDE
    at = lambda width: F.struct(*[F.floor(F.col(c) / F.lit(width)).alias(c) for c in "xyz"])
    points = stored(placed.withColumns({"cell": at(side), "micro": at(side / _MICRO)}), "crowded")
    counts = points.groupBy(key, "cell").agg(F.count("*").alias("n"))
    steps = F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip("xyz", d, strict=True)]) for d in np.ndindex(5, 5, 5)]))
    moved = counts.select(key, "cell", "n", steps.alias("d")).select(key, "cell", "n", F.struct(*[(F.col(f"cell.{c}") + F.col(f"d.{c}") - 2).alias(c) for c in "xyz"]).alias("beside"))
    beside = stored(moved.where("cell <> beside").join(counts.select(key, F.col("cell").alias("beside"), F.col("n").alias("n_beside")), [key, "beside"]), "beside")

    def near(some: DataFrame, others: DataFrame) -> DataFrame:
        """Pairs of some points and those of neighbouring cells within eps of them."""
        own = some.select(key, "cell", F.col("session").alias("own"), F.struct("x", "y", "z").alias("p"))
        other = others.select(key, F.col("cell").alias("beside"), F.struct("x", "y", "z").alias("q"), *[c for c in ("cluster",) if c in others.columns])
        return own.join(beside.select(key, "cell", "beside"), [key, "cell"]).join(other, [key, "beside"]).where(_square("p", "q") <= eps**2)

    dense = counts.where(F.col("n") >= least).select(key, "cell")
    few = points.join(counts.where(F.col("n") < least), [key, "cell"])
    met = near(few, points).groupBy(key, F.col("own").alias("session")).agg(F.count("*").alias("m"))
    enough = few.join(met, [key, "session"]).where(F.col("n") + F.col("m") >= least)
    core = stored(points.join(dense, [key, "cell"], "left_semi").unionByName(enough.select(*points.columns)), "core")

    # Which neighbouring cells with core points are joined.
    firsts = core.groupBy(key, "cell").agg(F.min("session").alias("first"))
    pairs = beside.where("cell < beside").select(key, "cell", "beside").join(firsts.select(key, "cell"), [key, "cell"], "left_semi").join(firsts.select(key, F.col("cell").alias("beside")), [key, "beside"], "left_semi")
    small = core.select(key, "cell", "micro").distinct()
    both = pairs.join(small.withColumnRenamed("micro", "a"), [key, "cell"]).join(small.select(key, F.col("cell").alias("beside"), F.col("micro").alias("b")), [key, "beside"])
    width = eps * _SIDE / _MICRO
    apart, reach = F.sqrt(_square("a", "b")) * width, width * 3**0.5
    both = stored(both.select(key, "cell", "beside", "a", "b", (apart + reach < eps * (1 - 1e-9)).alias("sure"), (apart - reach <= eps * (1 + 1e-9)).alias("maybe")).where("maybe"), "micro")
    told = both.groupBy(key, "cell", "beside").agg(F.bool_or("sure").alias("sure"))
    sure = told.where("sure").select(key, "cell", "beside")
    doubt = both.join(told.where("not sure").select(key, "cell", "beside"), [key, "cell", "beside"], "left_semi")
    spot = F.struct("x", "y", "z")
    one, two = core.select(key, "cell", F.col("micro").alias("a"), spot.alias("p")).distinct(), core.select(key, F.col("cell").alias("beside"), F.col("micro").alias("b"), spot.alias("q")).distinct()
    exact = doubt.join(one, [key, "cell", "a"]).join(two, [key, "beside", "b"])
    joined = sure.unionByName(exact.where(_square("p", "q") <= eps**2).select(key, "cell", "beside").distinct())
    place = lambda c: F.struct(key, *[F.col(f"{c}.{x}").alias(x) for x in "xyz"])
    parts = components(joined.select(place("cell").alias("a"), place("beside").alias("b")))
    named = firsts.withColumn("node", place("cell")).join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labels = named.groupBy("component").agg(F.min("first").alias("cluster"))
    cells = stored(named.join(labels, "component").select(key, "cell", "cluster"), "clusters")

    # Other points take the cluster of a core point within eps: one of their own cell, or else the least of those beside.
    clustered = core.join(cells, [key, "cell"])
    rest = points.join(core.select(key, "session"), [key, "session"], "left_anti")
    by_cell = rest.join(cells, [key, "cell"]).select(key, "session", "cluster")
    by_pair = near(rest, clustered).select(key, F.col("own").alias("session"), "cluster")
    border = by_cell.unionByName(by_pair).groupBy(key, "session").agg(F.min("cluster").alias("cluster"))
    all_ = clustered.select(key, "session", "day", "cluster").unionByName(rest.join(border, [key, "session"], "left").select(key, "session", "day", F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster")))
    seen = all_.where("cluster >= 0").groupBy(key, "cluster").agg(F.countDistinct("day").alias("seen"))
    out = all_.join(seen, [key, "cluster"], "left")
    return out.select(key, "session", "cluster", F.coalesce(F.col("seen") >= days, F.lit(False)).alias("is_base"))


def with_cell(log: DataFrame, metres: float) -> DataFrame:
    return log.withColumn("cell", geo_cell("lat", "lon", metres))


def peak_hours(cube: DataFrame | None, n: int = 4) -> list[int]:
    """The n hours with the largest energy (smaller hour on ties), ascending; the evening where there is no cube."""
    rows = [] if cube is None else cube.groupBy("hour").agg(F.sum("kwh").alias("v")).where("v is not null").orderBy(F.desc("v"), "hour").limit(n).collect()
    return sorted(r["hour"] for r in rows) or [18, 19, 20, 21]


def regional_sessions(found: DataFrame, key: str, region: str, days: int, least: int = 1) -> DataFrame:
    """By region: sessions, distinct vehicles, share at base places and sessions a day, where there are enough vehicles."""
    out = found.groupBy(region).agg(F.count("*").alias("n_sessions"), F.countDistinct(key).alias("n_vehicles"), F.avg(F.col("is_base").cast("int")).alias("base_share"))
    return out.where(F.col("n_vehicles") >= least).withColumn("per_day", F.col("n_sessions") / days)
