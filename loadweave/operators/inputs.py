"""Cleaning and summarising of the side inputs: stations, vehicles registered, weather, cards, population."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import expr

#: Provinces that were renumbered.
RENUMBERED = {"42": "51", "45": "52"}


def centroids(raw: DataFrame) -> DataFrame:
    """code, lat, lon; rows with anything missing go, the first of a code (smallest position) stays."""
    rows = raw.select(expr.clean_code("code", 10).alias("code"), expr.to_number("lat").alias("lat"), expr.to_number("lon").alias("lon")).na.drop()
    return rows.groupBy("code").agg(F.min(F.struct("lat", "lon")).alias("p")).select("code", "p.lat", "p.lon")


def stations(raw: DataFrame, lats: tuple[float, float] = (33.0, 39.0), lons: tuple[float, float] = (124.0, 132.0)) -> DataFrame:
    """Stations with coordinates inside the bounds and at least one charger; missing fast and slow counts are 0."""
    fast, slow = (F.coalesce(expr.to_number(c), F.lit(0.0)) for c in ("fast", "slow"))
    rows = raw.withColumns({"lat": expr.to_number("lat"), "lon": expr.to_number("lon"), "chargers": fast + slow})
    return rows.where(expr.valid_coordinates("lat", "lon", lats, lons) & (F.col("chargers") > 0))


def renumbered(code, changes: dict[str, str] = RENUMBERED):
    """A code whose province digits changed, by the new ones."""
    code = F.col(code) if isinstance(code, str) else code
    out = code
    for old, new in changes.items():
        out = F.when(code.startswith(old), F.concat(F.lit(new), F.substring(code, 3, 20))).otherwise(out)
    return out


def region_stock(found: DataFrame, code: str = "code") -> DataFrame:
    return found.where(F.col(code).isNotNull()).groupBy(code).agg(F.count("*").alias("n_stations"), F.sum("chargers").alias("chargers"))


def demand_points(places: DataFrame, registered: DataFrame) -> DataFrame:
    """Centroids with vehicles registered (not negative, summed by code; NULL where none are known)."""
    ev = registered.where(F.col("ev") >= 0).groupBy("code").agg(F.sum("ev").alias("ev"))
    return places.join(ev, "code", "left")


def ev_history(raw: DataFrame, fuel: str | None = None) -> DataFrame:
    """code, ym, ev summed; the fuel filter holds only where the column has any value."""
    rows = raw.withColumns({"ym": expr.year_month("ym"), "ev": expr.to_number("ev")})
    if fuel and "fuel" in raw.columns:
        known = rows.agg(F.count(F.nullif(F.trim("fuel"), F.lit(""))).alias("__n"))
        rows = rows.crossJoin(F.broadcast(known)).where((F.col("__n") == 0) | (F.trim("fuel") == fuel)).drop("__n")
    return rows.groupBy("code", "ym").agg(F.coalesce(F.sum("ev"), F.lit(0.0)).alias("ev"))


def weather_issues(raw: DataFrame) -> DataFrame:
    """Typed forecasts and observations; a forecast without its issue time is an error."""
    rows = raw.select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("station").cast("string").alias("station"), expr.to_number("observed").alias("observed"), expr.to_number("forecast").alias("forecast"), F.col("issued_at").cast("timestamp_ntz").alias("issued_at"))
    bad = rows.agg(F.count_if(F.col("forecast").isNotNull() & F.col("issued_at").isNull())).first()[0]
    if bad:
        raise ValueError(f"{bad} forecasts without an issue time")
    return rows


def observed_values(rows: DataFrame) -> DataFrame:
    """One observation of each station and time; differing ones are an error."""
    per = rows.where("observed is not null").groupBy("station", "ts").agg(F.countDistinct("observed").alias("d"), F.max("observed").alias("observed"))
    if per.where("d > 1").limit(1).count():
        raise ValueError("conflicting observations")
    return per.select("station", "ts", "observed")


def snapshots(rows: DataFrame, sets: list[list[str]], value: str) -> DataFrame:
    """Several groupings of one scan: which, the keys (NULL where not grouped), sum and rows."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    bits = F.grouping_id(*[F.col(k) for k in keys])
    out = rows.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(bits.cast("int").alias("which"), F.sum(value).alias(value), F.count("*").alias("n"))
    return out


def shares_within(rows: DataFrame, key: str, part: str, value: str) -> DataFrame:
    """Share of each part in its key's total."""
    sums = rows.groupBy(key, part).agg(F.sum(value).alias("v"))
    return sums.select(key, part, expr.ratio("v", F.sum("v").over(Window.partitionBy(key))).alias("share"))


def concentrated_targets(hourly: DataFrame, start: str, end: str, code: str = "code") -> DataFrame:
    """Regions complete on every calibration day whose mean profile's peak share is above the median, strongest first."""
    window = hourly.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    days = window.groupBy(code, "date").agg(F.count("kw").alias("n")).where("n = 24").groupBy(code).agg(F.count("*").alias("days"))
    need = F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date")) + 1
    whole = days.where(F.col("days") == need).select(code)
    means = window.join(whole, code, "left_semi").groupBy(code, "hour").agg(F.avg("kw").alias("m"))
    shape = means.groupBy(code).agg(F.coalesce(expr.ratio(F.max("m"), F.sum("m")), F.lit(0.0)).alias("concentration"))
    cut = shape.agg(F.median("concentration").alias("__cut"))
    chosen = shape.crossJoin(F.broadcast(cut)).where(F.col("concentration") > F.col("__cut")).drop("__cut")
    return chosen.withColumn("place", F.row_number().over(Window.orderBy(F.desc("concentration"), code)))


def population_bands(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Mean night (0-6), day (9-17) and evening (18-23) population by target code and date, dealt by weights (source, code, weight)."""
    band = F.when(F.col("hour") <= 6, "night").when(F.col("hour").between(9, 17), "day").when(F.col("hour") >= 18, "evening")
    means = rows.withColumn("band", band).where("band is not null").groupBy("source", "date").pivot("band", ["night", "day", "evening"]).agg(F.avg("people"))
    split = means.join(links, "source")
    return split.groupBy("code", "date").agg(*[F.sum(F.col(b) * F.col("weight")).alias(f"lp_{b}") for b in ("night", "day", "evening")])


def charger_stations(raw: DataFrame) -> DataFrame:
    """Chargers by station, without deleted or restricted ones."""
    kept = raw.where((F.coalesce("deleted", F.lit("N")) != "Y") & (F.coalesce("restricted", F.lit("N")) != "Y"))
    return kept.groupBy("station").agg(F.count("*").alias("chargers"), F.min("lat").alias("lat"), F.min("lon").alias("lon"))


def input_audit(weather: DataFrame, holidays: DataFrame, cutoff) -> DataFrame:
    """item, value rows on external inputs: holidays by type, stations, span, usable and late forecasts."""
    usable = F.col("issued_at") <= cutoff
    w = weather.agg(
        F.countDistinct("station").cast("string").alias("stations"), F.min("ts").cast("string").alias("first"), F.max("ts").cast("string").alias("last"),
        F.count_if(F.col("forecast").isNotNull() & usable).cast("string").alias("usable_forecasts"), F.count_if(F.col("forecast").isNotNull() & ~usable).cast("string").alias("late_forecasts"),
    )
    items = w.select(F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).alias("value")) for c in w.columns])).alias("r")).select("r.*")
    kinds = holidays.groupBy("type").agg(F.count("*").cast("string").alias("value")).select(F.concat(F.lit("holidays_"), F.col("type")).alias("item"), "value")
    return items.unionByName(kinds)


def labelled_scalars(parts: dict[str, DataFrame]) -> DataFrame:
    """item, value rows of one-row tables; what has no value says so."""
    out = None
    for name, df in parts.items():
        pairs = [F.struct(F.concat_ws(" ", F.lit(name), F.lit(c)).alias("item"), F.coalesce(F.round(F.col(c).cast("double"), 6).cast("string"), F.lit("not computed")).alias("value")) for c in df.columns]
        rows = df.select(F.explode(F.array(*pairs)).alias("r")).select("r.*")
        out = rows if out is None else out.unionByName(rows)
    return out
