"""Made-up inputs with known changes and effects, for trying out a run and for tests of recovery.

Every value is a hash of a seed, a name and the row's own keys, so tables are the same whatever
their partitions, and as large as ``units``, months and hours make them.  Of the units, the first ``TREATED`` get an
adoption month in turn from ``COHORTS``, one adopted before the window and one after it; the rest never do.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import month_label

TREATED = 18
#: Adoption months of the treated, as month indices: March to August 2025.
COHORTS = tuple(range(2025 * 12 + 2, 2025 * 12 + 8))
BEFORE, AFTER = 2024 * 12 + 9, 2025 * 12 + 10
WAITING = ("A:01", "A:02", "A:03", "A:04")
OTHERS = ("B:01", "B:02", "B:03", "B:04")
DISTANCES = ("1", "2", "3", "4", "9")
PROVINCE, DISTRICT = "서울특별시", "가람구"


@dataclass(frozen=True)
class Made:
    """Tables of one seed."""

    spark: SparkSession
    units: int = 30
    seed: int = 42

    def uniform(self, name: str, *keys) -> Column:
        """From 0 (included) to 1 (not), by a hash."""
        return F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), F.lit(name), *keys), 11) / F.lit(float(1 << 53))

    def normal(self, name: str, *keys) -> Column:
        return F.sqrt(-2 * F.ln(1 - self.uniform(name + " r", *keys))) * F.cos(2 * 3.141592653589793 * self.uniform(name + " a", *keys))

    def between(self, name: str, low: float, high: float, *keys) -> Column:
        return low + (high - low) * self.uniform(name, *keys)

    def regions(self) -> DataFrame:
        """unit, code, town, adoption (month or NULL), role, tau (the planted effect), wait and outsider shares, place, level, peakiness."""
        u = F.col("unit")
        adoption = F.when(u < TREATED, F.element_at(F.array(*map(F.lit, COHORTS)), (u % len(COHORTS) + 1).cast("int"))).when(u == TREATED, BEFORE).when(u == TREATED + 1, AFTER)
        rows = self.spark.range(self.units).withColumnRenamed("id", "unit").select("unit", F.format_string("11110%05d", (u + 101) * 100).alias("code"), F.format_string("마을%d동", u).alias("town"), adoption.cast("int").alias("adoption"))
        rows = rows.withColumns({"wait": self.between("wait", 0.3, 0.7, "unit"), "outsider": self.between("outsider", 0.2, 0.6, "unit"), "level": self.between("level", 200, 800, "unit"), "peakiness": self.uniform("peak", "unit"), "size": self.between("size", 5e4, 2e5, "unit")})
        treated = u < TREATED
        tau = F.when(treated, 0.05 + 0.30 * ((F.col("wait") > 0.5) & (F.col("outsider") > 0.4)).cast("double")).otherwise(0.0)
        role = F.when(treated, "treated").when(u == TREATED, "before").when(u == TREATED + 1, "after").otherwise("never")
        return rows.withColumns({"role": role, "tau": tau, "lat": 37.48 + 0.012 * F.floor(u / 6), "lon": 126.95 + 0.015 * (u % 6)})

    def _hours(self, rows: DataFrame) -> DataFrame:
        """kwh by hour of rows with unit, mi, date keys (``day``), level and peakiness: the level doubles from the adoption on."""
        hours = rows.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
        shape = lambda low, high, width: F.aggregate(F.sequence(F.lit(0), F.lit(23)), F.lit(0.0), lambda s, h: s + low + high * F.exp(-F.pow((h - 19) / width, 2)))
        flat = (0.6 + 0.4 * F.exp(-F.pow((F.col("hour") - 19) / 3.0, 2))) / shape(0.6, 0.4, 3.0)
        peaky = (0.2 + 1.8 * F.exp(-F.pow((F.col("hour") - 19) / 1.5, 2))) / shape(0.2, 1.8, 1.5)
        season = 1 + 0.08 * F.sin(2 * 3.141592653589793 * (F.col("mi") % 12) / 12)
        level = F.col("level") * (1 + 0.003 * (F.col("mi") - 2023 * 12)) * season * F.exp(0.04 * self.normal("month", "unit", "mi")) * F.when(F.col("mi") >= F.col("adoption"), 2.0).otherwise(1.0)
        profile = (1 - F.col("peakiness")) * flat + F.col("peakiness") * peaky
        return hours.withColumn("kwh", F.round(level * profile * F.exp(0.08 * self.normal("hour", "unit", "mi", "day", "hour")), 3))

    def consumption(self, first: int = 2023 * 12, last: int = 2025 * 12 + 11, days: tuple[int, ...] = (1, 8, 15, 22)) -> DataFrame:
        """period (yyyyMMddHH), province, district, town, cust, kwh of some days of each month."""
        rows = self.regions().withColumn("mi", F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn("day", F.explode(F.array(*map(F.lit, days))))
        rows = self._hours(rows)
        period = F.concat(F.replace(month_label("mi"), F.lit("-"), F.lit("")), F.format_string("%02d%02d", "day", "hour"))
        return rows.select(period.alias("period"), F.lit(PROVINCE).alias("province"), F.lit(DISTRICT).alias("district"), "town", F.greatest(F.round(F.col("kwh") / 7).cast("int"), F.lit(1)).alias("cust"), "kwh")

    def hourly(self, first: str, last: str) -> DataFrame:
        """code, period (yyyyMMddHH), kwh of every day, with a weekend's rise and days that differ."""
        days = self.spark.sql(f"select explode(sequence(date'{first}', date'{last}')) as date").withColumns({"mi": (F.year("date") * 12 + F.month("date") - 1).cast("int"), "day": F.dayofmonth("date")})
        rows = self._hours(self.regions().crossJoin(F.broadcast(days)))  # a calendar
        lift = (1 + 0.3 * (F.weekday("date") >= 5).cast("int")) * F.exp(0.15 * self.normal("day", "unit", "date"))
        return rows.select("code", F.concat(F.date_format("date", "yyyyMMdd"), F.format_string("%02d", "hour")).alias("period"), F.round(F.col("kwh") * lift / 20, 3).alias("kwh"))

    def sales(self, first: int = 2025 * 12, last: int = 2025 * 12 + 11, noise: float = 0.02, parts: int = 4) -> DataFrame:
        """Raw text rows of card sales: waiting businesses' outsiders rise by exp(tau) in treated regions from adoption on; the first of a cell's parts, a small one, may be masked."""
        kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.lit(c in WAITING).alias("is_wait")) for c in (*WAITING, *OTHERS)]))
        rows = self.regions().withColumn("mi", F.explode(F.sequence(F.lit(first), F.lit(last)))).select("*", kinds.alias("k")).withColumn("dist", F.explode(F.array(*map(F.lit, DISTANCES))))
        kind = F.when(F.col("k.is_wait"), F.col("wait")).otherwise(1 - F.col("wait")) / 4
        way = F.when(F.col("dist") == "1", (1 - F.col("outsider")) * 0.95).when(F.col("dist") == "9", 0.05).otherwise(F.col("outsider") * 0.95 / 3)
        season = 1 + 0.05 * F.sin(2 * 3.141592653589793 * F.col("mi") / 12)
        value = F.col("size") * kind * way * season * F.exp(0.03 * self.normal("shock", "unit", "mi") + noise * self.normal("cell", "unit", "mi", "k", "dist"))
        hit = F.col("k.is_wait") & F.col("dist").isin("2", "3", "4") & (F.col("mi") >= F.col("adoption"))
        value = value * F.when(hit, F.exp(F.col("tau"))).otherwise(1.0)
        rows = rows.withColumn("value", value).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        weight = lambda p: F.when(p == 0, 0.04).otherwise(1.0) * (0.5 + self.uniform("part", "unit", "mi", "k", "dist", p))
        total = sum((weight(F.lit(p)) for p in range(parts)), F.lit(0.0))
        amount = F.greatest(F.round(F.col("value") * weight(F.col("part")) / total), F.lit(1.0)).cast("long")
        masked = (F.col("part") == 0) & (self.uniform("mask", "unit", "mi", "k", "dist") < 0.1)
        label = lambda name, of: (1 + F.floor(self.uniform(name, "unit", "mi", "k", "dist", "part") * of)).cast("string")
        return rows.select(
            F.replace(month_label("mi"), F.lit("-"), F.lit("")).alias("ym"), F.lit("11").alias("sido"), F.substring("code", 1, 5).alias("sgg"), F.col("code").alias("umd"), F.split("k.kind", ":")[0].alias("bidvs"), F.split("k.kind", ":")[1].alias("medvs"), "dist",
            F.when(masked, "*").otherwise(amount.cast("string")).alias("metric"), label("tizo", 6).alias("tizo"), label("sex", 2).alias("sex"), label("age", 5).alias("age"), label("income", 3).alias("income"),
        )

    def stocks(self, first: int = 2025 * 12, last: int = 2025 * 12 + 11) -> DataFrame:
        """code, mi, stock of shops: a base that drifts by openings and closings."""
        rows = self.regions().withColumn("mi", F.explode(F.sequence(F.lit(first), F.lit(last))))
        drift = F.aggregate(F.sequence(F.lit(first), F.col("mi")), F.lit(0.0), lambda s, m: s + 12 * self.uniform("open", "unit", m) - 4)
        return rows.select("code", "mi", (400 + F.floor(200 * self.uniform("stock", "unit")) + F.floor(drift)).cast("long").alias("stock"))

    def stations(self, sites: int = 60) -> DataFrame:
        """station, lat, lon, fast, slow near the regions' places."""
        rows = self.spark.range(sites).select(F.format_string("s%04d", "id").alias("station"), F.floor(self.uniform("site", "id") * self.units).alias("unit"), "id")
        near = rows.join(self.regions().select("unit", "lat", "lon"), "unit")
        shift = lambda name: self.between(name, -0.003, 0.003, "id")
        return near.select("station", F.round(F.col("lat") + shift("north"), 6).alias("lat"), F.round(F.col("lon") + shift("east"), 6).alias("lon"), F.floor(5 * self.uniform("fast", "id")).alias("fast"), F.floor(11 * self.uniform("slow", "id")).alias("slow"))

    def registered(self) -> DataFrame:
        return self.regions().select("code", F.round(self.between("ev", 20, 400, "unit")).cast("int").alias("ev"))

    def vehicle_log(self, vehicles: int = 40, days: int = 20, first: str = "2025-06-01") -> DataFrame:
        """vehicle, ts, lat, lon, charging, soc: nights at a home, an hour of charging every third day, half of it there."""
        log = self.spark.range(vehicles).withColumnRenamed("id", "v").withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(days - 1)))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(95))))
        homes = log.withColumn("unit", F.floor(self.uniform("home", "v") * self.units)).join(self.regions().select("unit", F.col("lat").alias("hlat"), F.col("lon").alias("hlon")), "unit")
        night = (F.col("q") < 28) | (F.col("q") >= 84)
        away = self.between("way", 0.0, 0.05, "v", "d")
        start = 8 + F.when(F.col("d") % 2 == 0, 0).otherwise(48)
        charging = ((F.col("d") + F.col("v")) % 3 == 0) & F.col("q").between(start, start + 3)
        jitter = lambda name: self.between(name, -1e-4, 1e-4, "v", "d", "q")
        shift = F.when(night, 0.0).otherwise(away)
        soc = F.greatest(20 + 60 * F.abs(F.sin(F.col("v") + F.col("d") / 3.0)) + F.when(charging, 4.0 * (F.col("q") - start)).otherwise(0.0), F.lit(0.0))
        stamp = F.timestamp_seconds(F.unix_timestamp(F.lit(first).cast("timestamp")) + F.col("d") * 86_400 + F.col("q") * 900)
        return homes.select(F.format_string("car%03d", "v").alias("vehicle"), F.date_format(stamp, "yyyy-MM-dd HH:mm:ss").alias("ts"), F.round(F.col("hlat") + shift + jitter("jlat"), 6).alias("lat"), F.round(F.col("hlon") + shift + jitter("jlon"), 6).alias("lon"), F.when(charging, "Y").otherwise("N").alias("charging"), F.round(F.least(soc, F.lit(100.0)), 1).alias("soc"))

    def write(self, folder: str, hours: tuple[str, str] | None = None) -> dict[str, str]:
        """All tables as CSV with a header below a folder; their paths by name."""
        r = self.regions()
        master = r.select("code", F.concat(F.lit(f"{PROVINCE} {DISTRICT} "), "town").alias("name"), F.lit("").alias("status"))
        above = self.spark.createDataFrame([("1100000000", PROVINCE, ""), ("1111000000", f"{PROVINCE} {DISTRICT}", "")], "code string, name string, status string")
        tables = {
            "regions": above.unionByName(master), "consumption": self.consumption(), "sales": self.sales(), "stocks": self.stocks(), "stations": self.stations(), "registered": self.registered(),
            "places": r.select("code", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon")), "vehicles": self.vehicle_log(),
        }
        if hours:
            tables["hourly"] = self.hourly(*hours)
        for name, table in tables.items():
            table.coalesce(1).write.mode("overwrite").csv(f"{folder}/{name}", header=True)
        return {name: f"{folder}/{name}" for name in tables}
