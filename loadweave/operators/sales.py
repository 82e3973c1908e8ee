"""Card sales in one read: cells for the panels, snapshots by attribute and quality counts at once, by grouping sets.

Rows are large and come once; each grouping set is a partial aggregate in the same scan, so what is
shuffled are cells and not rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr

ATTRIBUTES = ("bidvs", "sex", "age", "income")
#: What a scanned row is about, by the columns of its grouping set.
SETS = {
    "cells": ("code", "mi", "group", "origin"), "by_group": ("code", "mi", "group"), "by_origin": ("code", "mi", "origin"), **{f"by_{a}": ("code", "mi", a) for a in ATTRIBUTES},
    "times": ("tizo",), "distances": ("dist",), "all": (),
}


def typed_sales(raw: DataFrame, wait: Iterable[str], control: Iterable[str], placebo: Iterable[str], resident: Iterable[str] = ("1",), unknown: Iterable[str] = ("9",), markers: Iterable[str] = ("*",), provinces: Iterable[str] = ()) -> DataFrame:
    """code, mi, group, origin, value, masked, inside and the labels of raw text rows.

    raw: ym, sido, sgg, umd, bidvs, medvs, dist, metric and, where there are any, tizo, sex, age, income.
    Groups are wait, placebo (a part of control), control_ref and other; origins resident, unknown and outsider.
    """
    value, masked = expr.masked_value("metric", markers)
    label = lambda c: expr.clean_label(c) if c in raw.columns else F.lit(None).cast("string")
    held = raw.withColumns({c: label(c) for c in ("bidvs", "medvs", "dist", "tizo", "sex", "age", "income")})
    of = lambda codes: F.coalesce(expr.code_match("bidvs", "medvs", codes), F.lit(False))
    group = expr.first_group([(of(wait), "wait"), (of(control) & of(placebo), "placebo"), (of(control), "control_ref")], "other")
    origin = expr.first_group([(F.col("dist").isin(list(resident)), "resident"), (F.col("dist").isNull() | F.col("dist").isin(list(unknown)), "unknown")], "outsider")
    return held.select(
        expr.joined_code("sido", "sgg", "umd").alias("code"), expr.month_index("ym").alias("mi"), group.alias("group"), origin.alias("origin"), value.alias("value"), masked.alias("masked"),
        expr.in_provinces(expr.clean_code("sido"), provinces).alias("inside"), "bidvs", "dist", "tizo", "sex", "age", "income",
    )


def scanned(rows: DataFrame, snapshot_months: Iterable[int] = ()) -> DataFrame:
    """One table of all sets (column ``set``): the set's columns, S, n_valid, n_rows, n_masked, and the counts of the whole scan.

    rows: ``typed_sales``.  Cells leave out other groups and unknown origins; the snapshots hold the given months only.
    """
    months = list(snapshot_months)
    keyed = F.col("code").isNotNull() & F.col("mi").isNotNull()
    use = keyed & (F.col("group") != "other") & (F.col("origin") != "unknown")
    rows = rows.where("inside").select("*", use.alias("__use"), (keyed & (F.col("mi").isin(months) if months else F.lit(False))).alias("__shot"))
    names = ["code", "mi", "group", "origin", *ATTRIBUTES, "tizo", "dist"]
    sets = [[F.col(c) for c in s] for s in SETS.values()]
    number = {name: sum(0 if c in s else 1 << (len(names) - 1 - i) for i, c in enumerate(names)) for name, s in SETS.items()}
    kind = F.coalesce(*[F.when(F.grouping_id() == n, name) for name, n in number.items()])
    out = rows.groupingSets(sets, *[F.col(c) for c in names]).agg(
        kind.alias("set"),
        F.sum(F.when(F.col("__use"), F.col("value"))).alias("use_s"), F.count(F.when(F.col("__use"), F.col("value"))).alias("use_valid"), F.count_if("__use").alias("use_rows"), F.count_if(F.col("__use") & F.col("masked")).alias("use_masked"),
        F.sum(F.when(F.col("__shot"), F.col("value"))).alias("shot_s"), F.count_if("__shot").alias("shot_rows"),
        F.count("*").alias("rows"), F.count_if("masked").alias("masked_rows"), F.count_if(F.col("code").isNull()).alias("bad_region_rows"), F.count_if(F.col("mi").isNull()).alias("bad_month_rows"),
        F.count_if(F.col("origin") == "unknown").alias("unknown_origin_rows"), F.count_if(F.col("group") == "other").alias("other_industry_rows"),
    )
    shots = F.col("set").startswith("by_")
    return out.where((F.col("set") == "all") | (F.col("set").isin("times", "distances")) | ((F.col("set") == "cells") & (F.col("use_rows") > 0)) | (shots & (F.col("shot_rows") > 0)))


def cells(found: DataFrame) -> DataFrame:
    """code, mi, group, origin, S, n_valid, n_rows, n_masked."""
    return found.where("set = 'cells'").select("code", "mi", "group", "origin", F.coalesce("use_s", F.lit(0.0)).alias("S"), F.col("use_valid").alias("n_valid"), F.col("use_rows").alias("n_rows"), F.col("use_masked").alias("n_masked"))


def snapshot(found: DataFrame, by: str) -> DataFrame:
    """code, mi, the attribute and the sum of its values in the snapshot's months; rows without the attribute are left out."""
    return found.where((F.col("set") == f"by_{by}") & F.col(by).isNotNull()).select("code", "mi", by, F.coalesce("shot_s", F.lit(0.0)).alias("value"))


def quality(found: DataFrame) -> DataFrame:
    """One row: rows, the share of masked ones, unusable ones, and the labels seen."""
    labels = lambda kind, c: found.where(F.col("set") == kind).agg(F.array_sort(F.collect_set(c)).alias(f"{kind}_seen"))  # noqa: E731  (a few codes)
    counts = found.where("set = 'all'").select("rows", "masked_rows", "bad_region_rows", "bad_month_rows", "unknown_origin_rows", "other_industry_rows", expr.ratio("masked_rows", F.col("rows").cast("double")).alias("mask_rate"))
    return counts.crossJoin(labels("times", "tizo")).crossJoin(labels("distances", "dist"))


def outcome_parts(main: str = "wait", reference: str = "control_ref") -> dict[str, Column]:
    """Parts of the double difference: the main group's outsiders and residents against the reference's."""
    of = lambda g, o: (F.col("group") == g) & (F.col("origin") == o)
    return {"a_out": of(main, "outsider"), "a_res": of(main, "resident"), "b_out": of(reference, "outsider"), "b_res": of(reference, "resident")}
