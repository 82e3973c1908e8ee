"""Files: finding them, from a file to the cube, vehicle logs, holidays, and writing tables for the inside and for export."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import cube as cubes
from ..operators import publish
from . import csv


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def locate(spark: SparkSession, path: str, levels: int = 3, start: str | None = None) -> str:
    """The path, or the same relative path below one of the next folders upwards; unchanged if it is nowhere."""
    path = path.strip().strip("\"'")
    fs, place = _fs(spark, path)
    if fs.exists(place) or place.isAbsolute():
        return path
    folder = _fs(spark, start)[1] if start else fs.getWorkingDirectory()
    for _ in range(levels + 1):
        if folder is None:
            break
        tried = spark._jvm.org.apache.hadoop.fs.Path(folder, path)
        if fs.exists(tried):
            return tried.toString()
        folder = folder.getParent()
    return path


def one_csv(spark: SparkSession, path: str) -> str:
    """A CSV file, or the only one right below a folder; none or several are an error that names them."""
    if not path.strip():
        raise ValueError("no path is given")
    found = locate(spark, path)
    fs, place = _fs(spark, found)
    if not fs.exists(place):
        raise FileNotFoundError(found)
    if fs.getFileStatus(place).isFile():
        if not found.lower().endswith(".csv"):
            raise ValueError(f"{found} is no CSV file")
        return found
    inside = sorted(s.getPath().toString() for s in fs.listStatus(place) if s.isFile() and s.getPath().getName().lower().endswith(".csv"))
    if len(inside) != 1:
        raise ValueError(f"{found} holds {len(inside)} CSV files: {[p.rsplit('/', 1)[-1] for p in inside]}")
    return inside[0]


def observed_dates(spark: SparkSession, path: str, period: str) -> DataFrame:
    """Distinct days of a file's period column, whatever window applies elsewhere; periods without a day have none."""
    digits = F.regexp_replace("period", r"[^0-9]", "")
    days = csv.read_columns(spark, path, {"period": period}, ["period"]).select(F.try_to_timestamp(F.substring(digits, 1, 8), F.lit("yyyyMMdd")).cast("date").alias("date"), F.length(digits).alias("n"))
    return days.where("n >= 8 and date is not null").select("date").distinct()


def consumption(spark: SparkSession, path: str, wanted: dict[str, str], provinces: Iterable[str] = (), names: dict[str, str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Clean rows of a consumption file, long or with a column for each hour; other provinces go right after the scan."""
    columns, _, _ = csv.read_header(spark, path)
    hours = csv.hour_columns(columns)
    if "kwh" in csv.resolve_columns(columns, wanted):
        raw = csv.read_columns(spark, path, wanted, ["period", "kwh"])
    else:
        kept = {k: v for k, v in wanted.items() if k not in ("hour", "kwh")}
        wide = csv.read_columns(spark, path, {**kept, **{f"__h{h}": c for c, h in hours.items()}}, ["period"])
        raw = cubes.unpivot_hours(wide, [c for c in wide.columns if not c.startswith("__h")], {f"__h{h}": h for h in hours.values()})
        raw = raw.withColumn("hour", F.col("hour").cast("string"))
    chosen = [*provinces]
    if chosen and "province" in raw.columns:
        raw = raw.where(expr.synonym("province", names or {}).isin(chosen))
    return csv.clean_consumption(raw, start, end)


def cube_of_file(spark: SparkSession, path: str, wanted: dict[str, str], **options) -> DataFrame:
    """The cube by province, district, town, month and hour of a consumption file, hours from 0 to 23.

    Whether hours count from 1 is decided on the cube, so the file is read once.
    """
    rows = consumption(spark, one_csv(spark, path), wanted, **options)
    keys = [c for c in ("province", "district", "town") if c in rows.columns]
    return cubes.hours_from_zero(cubes.hour_cube(rows, [*keys, "mi", "hour"]))


def vehicle_log(spark: SparkSession, path: str, wanted: dict[str, str], lats: tuple[float, float] = (33.0, 39.0), lons: tuple[float, float] = (124.0, 132.0), charging: Iterable[str] = ("Y", "TRUE"), rows: int | None = None) -> DataFrame:
    """vehicle, ts, lat, lon, charging and soc of a log: rows without a vehicle or time go, coordinates out of range become NULL."""
    raw = csv.read_columns(spark, path, wanted, ["vehicle", "ts"], rows)
    return typed_log(raw, lats, lons, charging)


def typed_log(raw: DataFrame, lats: tuple[float, float] = (33.0, 39.0), lons: tuple[float, float] = (124.0, 132.0), charging: Iterable[str] = ("Y", "TRUE")) -> DataFrame:
    """A text log with its types; see ``vehicle_log``."""
    number = lambda c: expr.to_number(c) if c in raw.columns else F.lit(None).cast("double")
    typed = raw.select(F.nullif(F.trim("vehicle"), F.lit("")).alias("vehicle"), expr.local_time("ts").alias("ts"), number("lat").alias("lat"), number("lon").alias("lon"), (expr.truth_flag("charging", charging) if "charging" in raw.columns else F.lit(None).cast("boolean")).alias("charging"), number("soc").alias("soc"))
    inside = expr.valid_coordinates("lat", "lon", lats, lons)
    return typed.where("vehicle is not null and ts is not null").withColumns({c: F.when(inside, F.col(c)) for c in ("lat", "lon")})


def log_diagnostics(log: DataFrame, rows: int) -> DataFrame:
    """One row of counts over the first rows of a log; no value of any row leaves."""
    return log.limit(rows).agg(F.count("*").alias("rows"), F.countDistinct("vehicle").alias("vehicles"), F.count_if(F.col("lat").isNull()).alias("without_place"), F.count_if(F.col("charging")).alias("charging"), F.min("ts").alias("first"), F.max("ts").alias("last"))


HOLIDAYS = ("holiday", "long_holiday", "pre_post_holiday")


def load_holidays(spark: SparkSession, path: str) -> DataFrame:
    """date, type (NULL: to be derived) of a JSON object of dates; an unknown type is an error."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one small file
    listed = json.loads(text)
    unknown = sorted({str(t) for t in listed.values() if t is not None} - set(HOLIDAYS))
    if unknown:
        raise ValueError(f"unknown types of holidays: {unknown}")
    return spark.createDataFrame(sorted(listed.items()), "date string, type string").select(F.to_date("date").alias("date"), "type")


def dump_holidays(holidays: DataFrame, path: str) -> None:
    """The same form, readable by ``load_holidays``: a calendar has a few hundred rows."""
    held = {r["d"]: r["type"] for r in holidays.select(F.col("date").cast("string").alias("d"), "type").collect()}
    holidays.sparkSession.createDataFrame([(json.dumps(held, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_table(df: DataFrame, folder: str, name: str, title: str, note: str = "", digits: int = 6, exported: DataFrame | None = None) -> list[str]:
    """Writes a table as CSV for the inside and, without raw columns and positions, for export; returns both paths.

    Doubles are rounded; title, note and columns stand in a JSON file beside the parts.
    """
    spark = df.sparkSession
    out = publish.refuse_positions(publish.without_raw(df if exported is None else exported))
    paths = []
    for place, held in (("inside", df), ("export", out)):
        path = f"{folder.rstrip('/')}/{place}/{name}"
        held.select(*[_rounded(f.name, f.dataType.typeName(), digits) for f in held.schema.fields]).write.mode("overwrite").csv(path, header=True)
        about = json.dumps({"name": name, "title": title, "note": note, "columns": held.columns}, ensure_ascii=False)
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.about")
        paths.append(path)
    return paths


def _rounded(name: str, kind: str, digits: int) -> Column:
    column = F.col(f"`{name}`")
    if kind in ("double", "float"):
        return F.round(column, digits).alias(name)
    if kind == "array":  # a CSV field holds no list
        return F.array_join(column.cast("array<string>"), ";").alias(name)
    return F.to_json(column).alias(name) if kind in ("struct", "map") else column


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """name, title, note and columns of every table that ``write_table`` wrote below a folder's inside."""
    about = spark.read.text(f"{folder.rstrip('/')}/inside/*.about").select(F.from_json("value", "name string, title string, note string, columns array<string>").alias("a"))
    return about.select("a.*")
