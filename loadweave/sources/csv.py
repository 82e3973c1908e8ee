"""Readers of public CSV files: encodings, headers, layouts, and gates that run as one aggregate.

The driver reads a header line (through Spark, so any store works) and decides names, separator and
layout; rows are read as text by explicit schemas, pruned to the wanted columns, and cleaned
by column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import expr

SEPARATORS = ("\t", "|", ",")
#: Korean legacy encodings need spark.sql.legacy.javaCharsets=true, set at the start of a session.
ENCODINGS = ("UTF-8", "MS949")


def detect_encoding(spark: SparkSession, path: str, sample_bytes: int = 4_000_000) -> str:
    """UTF-8 if the first bytes decode (a cut character at the end is fine), else the legacy Korean code page, else an error."""
    row = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, sample_bytes).alias("c")).first()
    if row is None:
        raise FileNotFoundError(path)
    import codecs

    for encoding, codec in zip(ENCODINGS, ("utf-8-sig", "cp949"), strict=True):
        try:
            codecs.getincrementaldecoder(codec)().decode(bytes(row["c"]))
            return encoding
        except UnicodeDecodeError:
            continue
    raise ValueError(f"{path}: neither UTF-8 nor CP949")


def read_header(spark: SparkSession, path: str) -> tuple[list[str], str, str]:
    """(columns, encoding, separator): the most frequent separator of line 1, a comma by default."""
    encoding = detect_encoding(spark, path)
    line = spark.read.option("encoding", encoding).csv(path, sep="\u0001").first()
    text = ((line[0] if line else "") or "").lstrip("﻿")
    best = max(SEPARATORS, key=lambda s: (text.count(s), s == ","))
    sep = best if text.count(best) else ","
    return [c.strip().strip('"') for c in text.split(sep)], encoding, sep


def resolve_columns(columns: list[str], wanted: dict[str, str], required: Iterable[str] = ()) -> dict[str, str]:
    """Logical name to header: exact, else a unique prefix; a required one that is missing names what there is."""
    found = {}
    for key, name in wanted.items():
        starts = [c for c in columns if c.startswith(name)]
        if name in columns:
            found[key] = name
        elif len(starts) == 1:
            found[key] = starts[0]
        elif key in set(required):
            raise KeyError(f"{key}: no unique column like {name!r} among {columns}")
    return found


def detect_columns(columns: list[str], aliases: dict[str, list[str]], required: Iterable[str] = ()) -> dict[str, str]:
    """Headers that equal an alias but for case, blanks and punctuation; two for one key are an error."""
    token = lambda s: re.sub(r"[\W_]+", "", s).lower()
    found = {}
    for key, names in aliases.items():
        hits = [c for c in columns if token(c) in {token(n) for n in names}]
        if len(hits) > 1:
            raise KeyError(f"{key}: ambiguous, {hits}")
        if hits:
            found[key] = hits[0]
        elif key in set(required):
            raise KeyError(f"{key}: none of {names} among {columns}")
    return found


def read_columns(spark: SparkSession, path: str, wanted: dict[str, str], required: Iterable[str] = (), rows: int | None = None) -> DataFrame:
    """The wanted columns as text under their logical names; the scan parses no others."""
    columns, encoding, sep = read_header(spark, path)
    found = resolve_columns(columns, wanted, required)
    schema = StructType([StructField(c, StringType()) for c in columns])
    df = spark.read.csv(path, schema=schema, sep=sep, encoding=encoding, header=True, enforceSchema=True)
    df = df.select(*[F.col(f"`{c}`").alias(k) for k, c in found.items()])
    return df.limit(rows) if rows else df


def hour_columns(columns: list[str]) -> dict[str, int]:
    """Headers that are hours of a wide layout (01:00, 1시, H01 ...), with their hour."""
    out = {}
    for c in columns:
        m = re.fullmatch(r"\D*?(\d{1,2})(?::00|시|h)?", c.strip(), re.IGNORECASE)
        if m and int(m[1]) <= 24 and (":" in c or "시" in c or re.match(r"(?i)h\d", c.strip()) or re.search(r"(?i)h$", c.strip())):
            out[c] = int(m[1])
    return out


def clean_consumption(raw: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """province, district, town, mi, hour, kwh, cust, days of long rows (period, hour or period with hour, kwh).

    The period's digits give year, month and, from the ninth on, the hour; eight digits or more
    are one day, fewer a whole month.  Rows without a valid month, hour or value go.
    """
    digits = F.regexp_replace("period", r"[^0-9]", "")
    year, month = F.substring(digits, 1, 4).try_cast("int"), F.substring(digits, 5, 2).try_cast("int")
    hour = F.regexp_extract("hour", r"(\d{1,2})", 1).try_cast("int") if "hour" in raw.columns else F.substring(digits, 9, 2).try_cast("int")
    days = F.when(F.length(digits) >= 8, 1).otherwise(F.dayofmonth(F.last_day(F.try_make_timestamp(year, month, F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("date"))))
    rows = raw.withColumns({"__d8": F.substring(digits, 1, 8), "mi": F.when(month.between(1, 12), year * 12 + month - 1), "hour": hour, "kwh": expr.to_number("kwh"), "cust": expr.to_number("cust") if "cust" in raw.columns else F.lit(None).cast("double")})
    rows = rows.withColumn("days", F.when(F.col("mi").isNotNull(), days).cast("double"))
    if start:
        rows = rows.where(F.col("__d8") >= start)
    if end:
        rows = rows.where(F.col("__d8") <= end)
    return rows.where("mi is not null and hour between 0 and 24 and kwh is not null").drop("__d8", "period")


def hourly_facts(raw: DataFrame, most_missing: float = 0.2) -> DataFrame:
    """code, date, hour, kw of hourly rows behind strict gates, all counted in one job.

    raw: code, period (YYYYMMDD or YYYYMMDDHH), optionally hour, kwh.  Short periods, bad hours,
    negative values, too many missing ones and duplicate region hours are errors.
    """
    digits = F.regexp_replace("period", r"[^0-9]", "")
    if "hour" in raw.columns:
        text = F.trim("hour")
        hour, bad_hour = F.regexp_extract(text, r"^(\d{1,2})", 1).try_cast("int"), ~text.rlike(r"^\d{1,2}(시)?$")
    else:
        hour, bad_hour = F.substring(digits, 9, 2).try_cast("int"), F.length(digits) != 10
    date = F.try_to_timestamp(F.substring(digits, 1, 8), F.lit("yyyyMMdd")).cast("date")
    rows = raw.select("code", date.alias("date"), hour.alias("hour"), expr.to_number("kwh").alias("kw"), (F.length(digits) < 8).alias("short"), F.coalesce(bad_hour, F.lit(True)).alias("bad"))
    per = rows.groupBy("code", "date", "hour").agg(F.count("*").alias("n"), F.max("kw").alias("kw"), F.count_if("short").alias("short"), F.count_if("bad").alias("bad"), F.count_if(F.col("kw") < 0).alias("neg"), F.count_if(F.col("kw").isNull()).alias("null"), F.count_if(F.col("date").isNull()).alias("undated"))
    m = per.agg(F.sum("n").alias("rows"), *[F.sum(c).alias(c) for c in ("short", "bad", "neg", "null", "undated")], F.count_if(F.col("n") > 1).alias("dup"), F.min("hour").alias("low"), F.max("hour").alias("high")).first()
    total = m["rows"] or 0
    for name, text in (("short", "periods without a day"), ("undated", "periods that are no date"), ("bad", "hours that can't be read"), ("neg", "negative values"), ("dup", "duplicate region hours")):
        if m[name]:
            raise ValueError(f"{m[name]} {text}")
    if total and m["null"] / total > most_missing:
        raise ValueError(f"{m['null'] / total:.1%} of the values are missing")
    shift = 1 if total and m["high"] == 24 and m["low"] >= 1 else 0
    return per.where("kw is not null").select("code", "date", (F.col("hour") - shift).alias("hour"), "kw")


def fill_absent_days(hourly: DataFrame) -> DataFrame:
    """Days between a table's first and last on which a region has no row, as 24 zeros."""
    span = hourly.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    calendar = span.select(F.explode(F.sequence("a", "b")).alias("date"))
    absent = hourly.select("code").distinct().crossJoin(F.broadcast(calendar)).join(hourly.select("code", "date").distinct(), ["code", "date"], "left_anti")
    zeros = absent.select("code", "date", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"), F.lit(0.0).alias("kw"))
    return hourly.select("code", "date", "hour", "kw").unionByName(zeros)


def prices(raw: DataFrame) -> DataFrame:
    """ts (hour), price of hourly or quarter-hourly rows; missing quarters, duplicates and nulls are errors."""
    rows = raw.select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("price").cast("double").alias("price"))
    hours = rows.groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.count("*").alias("n"), F.countDistinct("ts").alias("d"), F.avg("price").alias("price"), F.count_if(F.col("price").isNull() | F.isnan("price") | F.col("ts").isNull()).alias("null"), F.count_if(F.minute("ts") % 15 != 0).alias("odd"), F.count_if(F.minute("ts") != 0).alias("quarters"))
    m = hours.agg(F.sum("null").alias("null"), F.sum("odd").alias("odd"), F.count_if(F.col("n") != F.col("d")).alias("dup"), F.max("quarters").alias("q"), F.count_if(F.col("n") != 4).alias("short")).first()
    for name, text in (("null", "missing values"), ("odd", "times off the quarter hours"), ("dup", "hours with duplicates")):
        if m[name]:
            raise ValueError(f"prices: {m[name]} {text}")
    if m["q"] and m["short"]:
        raise ValueError(f"prices: {m['short']} hours without all four quarters")
    return hours.select(F.col("h").cast("timestamp_ntz").alias("ts"), "price")


def crosswalk(raw: DataFrame) -> DataFrame:
    """code, canonical of codes that change; a canonical code that changes itself is an error."""
    pairs = raw.select(expr.clean_code("code", 10).alias("code"), expr.clean_code("canonical", 10).alias("canonical")).where("code <> canonical").distinct()
    chains = pairs.select(F.col("canonical").alias("code")).join(pairs.select("code"), "code", "left_semi").count()
    if chains:
        raise ValueError(f"{chains} chains in the crosswalk")
    return pairs


def region_master(raw: DataFrame) -> DataFrame:
    """code, province, district, town from rows of code, name, status: current towns, names by prefix lookups."""
    rows = raw.withColumn("code", expr.clean_code("code")).where(~F.coalesce(F.col("status"), F.lit("")).contains("폐지"))
    if rows.where("length(code) <> 10 or code is null").limit(1).count():
        raise ValueError("region codes must have ten digits")
    names = rows.select("code", expr.norm_text("name").alias("name"))
    provinces = names.where(F.substring("code", 3, 8) == "00000000").select(F.substring("code", 1, 2).alias("p2"), F.col("name").alias("province"))
    districts = names.where((F.substring("code", 6, 5) == "00000") & (F.substring("code", 3, 3) != "000")).select(F.substring("code", 1, 5).alias("p5"), F.col("name").alias("district_name"))
    towns = names.where((F.substring("code", 9, 2) == "00") & (F.substring("code", 6, 3) != "000")).withColumns({"p2": F.substring("code", 1, 2), "p5": F.substring("code", 1, 5)})
    joined = towns.join(F.broadcast(provinces), "p2", "left").join(F.broadcast(districts), "p5", "left")
    prefix = F.coalesce("district_name", "province", F.lit(""))
    town = F.when(F.col("name").startswith(prefix), F.trim(F.expr("substring(name, length(coalesce(district_name, province, '')) + 1)"))).otherwise(F.col("name"))
    district = F.when(F.col("district_name").startswith(F.col("province")), F.trim(F.expr("substring(district_name, length(province) + 1)"))).otherwise(F.coalesce("district_name", F.lit("")))
    return joined.select("code", "province", district.alias("district"), town.alias("town"), F.col("name").alias("region_name"))
