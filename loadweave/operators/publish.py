"""Small-cell suppression, detail rows, pages with checksums and quality gates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

RAW_COLUMNS = ("kwh", "kw", "customers", "cust_sum", "cust_min", "lat", "lon", "vehicle_id", "session")
_GPS = re.compile(r"(^|_)(lat|lon|latitude|longitude|gps|위도|경도)($|_)", re.IGNORECASE)


def refuse_positions(df: DataFrame) -> DataFrame:
    """An error if a column is named like a coordinate."""
    found = [c for c in df.columns if _GPS.search(c)]
    if found:
        raise ValueError(f"columns with positions can't be exported: {found}")
    return df


def without_raw(df: DataFrame, names: tuple[str, ...] = RAW_COLUMNS) -> DataFrame:
    return df.drop(*names)


def suppress_small(df: DataFrame, count: str, least: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every numeric column of rows under a count becomes NULL (a missing count is 0)."""
    small = F.coalesce(F.col(count), F.lit(0)) < least
    return df.select(*[F.when(~small, F.col(f.name)).alias(f.name) if isinstance(f.dataType, NumericType) and f.name not in keep else F.col(f.name) for f in df.schema.fields])


def export_pair(df: DataFrame, counts: DataFrame, least: int, hide: list[str], code: str = "code") -> tuple[DataFrame, DataFrame]:
    """(internal with a flag, exported with hidden columns NULL) by the region's customer count; no count means 0."""
    flagged = df.join(counts.select(code, F.col("n").alias("__n")), code, "left").withColumn("small_cell", F.coalesce("__n", F.lit(0)) < least).drop("__n")
    return flagged, flagged.withColumns({c: F.when(~F.col("small_cell"), F.col(c)) for c in hide})


def detail_rows(priority: DataFrame, groups: DataFrame | None = None, code: str = "code") -> DataFrame:
    """code, rank, score, risk, status: A assessed, L low load, M missing, G counted with a head."""
    status = F.when(F.col("status") == "assessed", "A").when(F.col("status") == "not_assessed_low_load", "L").otherwise("M")
    out = priority.withColumn("state", status)
    if groups is not None:
        out = out.join(groups.select(code, "head"), code, "left").withColumn("state", F.when(F.col("head").isNotNull(), "G").otherwise(F.col("state")))
    return out


def pages(detail: DataFrame, counts: DataFrame, least: int, numbers: list[str], rows: int = 29, digits: int = 3, code: str = "code") -> DataFrame:
    """Exported rows by page: small cells without numbers and with state S (but not G), plus a checksum row a page."""
    held = detail.join(counts.select(code, F.col("n").alias("__n")), code, "left")
    small = (F.coalesce("__n", F.lit(0)) < least) & (F.col("state") != "G")
    held = held.withColumns({n: F.round(F.when(~small, F.col(n)), digits) for n in numbers}).withColumn("state", F.when(small, "S").otherwise(F.col("state")))
    # Numbering needs one order over the published table (a row a region).
    numbered = held.withColumn("page", F.floor((F.row_number().over(Window.orderBy(code)) - 1) / rows).cast("int"))
    body = numbered.select("page", F.lit(0).alias("line"), F.col(code).cast("string").alias("label"), "state", *numbers)
    sums = numbered.groupBy("page").agg(F.lit(1).alias("line"), F.concat(F.lit("Σ"), F.sum(F.col(code).cast("decimal(38,0)")).cast("string")).alias("label"), F.concat(F.count("*").cast("string"), F.lit(" rows")).alias("state"), *[F.round(F.coalesce(F.sum(n), F.lit(0.0)), digits).alias(n) for n in numbers])
    return body.unionByName(sums)


def check_pages(printed: DataFrame, numbers: list[str], digits: int = 3) -> DataFrame:
    """By page: whether code sums, row counts and column sums agree with the checksum row (half a unit a row is allowed)."""
    body = printed.where("line = 0").groupBy("page").agg(F.sum(F.col("label").cast("decimal(38,0)")).alias("codes"), F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(f"b_{c}") for c in numbers])
    sums = printed.where("line = 1").select("page", F.substring("label", 2, 60).cast("decimal(38,0)").alias("c_codes"), F.split("state", " ")[0].cast("long").alias("c_n"), *[F.col(c).alias(f"s_{c}") for c in numbers])
    fine = (F.col("codes") == F.col("c_codes")) & (F.col("n") == F.col("c_n"))
    for c in numbers:
        fine = fine & (F.abs(F.col(f"b_{c}") - F.col(f"s_{c}")) <= (F.col("n") + 1) * 0.5 * 10**-digits)
    return body.join(sums, "page", "full_outer").select("page", "n", F.coalesce(fine, F.lit(False)).alias("agrees"))


def state_counts(detail: DataFrame, counts: DataFrame, least: int, code: str = "code") -> DataFrame:
    """Regions shown, counted with a head, hidden as small with and without a count."""
    held = detail.join(counts.select(code, F.col("n").alias("__n")), code, "left")
    group, small = F.col("state") == "G", F.coalesce("__n", F.lit(0)) < least
    return held.agg(F.count_if(~group & ~small).alias("shown"), F.count_if(group).alias("merged"), F.count_if(~group & small & F.col("__n").isNotNull()).alias("hidden_small"), F.count_if(~group & F.col("__n").isNull()).alias("hidden_without_count"))


def reserved_reasons(reasons: dict[str, Column]) -> Column:
    """Texts of the conditions that hold, joined by a middle dot."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(t)) for t, c in reasons.items()])), " · ")


def gates(metrics: DataFrame, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """Verdict rows of a one-row table of metrics: rules are (name, metric, warn condition, fail condition) on ``x``.

    A missing metric is 'n.a.'; every rule always gives one row.
    """
    cases = [
        F.struct(
            F.lit(i + 1).alias("number"), F.lit(name).alias("check"), F.col(metric).cast("double").alias("x"),
            F.when(F.col(metric).isNull(), "n.a.").when(F.expr(fail.replace("x", f"`{metric}`")) if fail else F.lit(False), "fail").when(F.expr(warn.replace("x", f"`{metric}`")) if warn else F.lit(False), "warn").otherwise("pass").alias("verdict"),
        )
        for i, (name, metric, warn, fail) in enumerate(rules)
    ]
    return metrics.select(F.explode(F.array(*cases)).alias("g")).select("g.*")


def shown_number(x: Column, digits: int = 3) -> Column:
    """A number as text: a dash for none or what isn't finite, thousands separated and whole from a thousand on."""
    finite = x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return F.when(~finite, "—").when(F.abs(x) >= 1000, F.format_number(x, 0)).otherwise(F.format_number(x, digits))


def read_number(x: Column) -> Column:
    """The number of such a text; a dash or anything else is NULL."""
    return F.replace(F.trim(x), F.lit(","), F.lit("")).try_cast("double")


def without_small_examples(examples: DataFrame, counts: DataFrame, least: int, code: str = "code") -> tuple[DataFrame, DataFrame]:
    """(examples of regions with enough customers, one row: treated ones that went); no count means 0."""
    held = examples.join(counts.select(code, F.col("n").alias("__n")), code, "left").withColumn("__small", F.coalesce("__n", F.lit(0)) < least)
    gone = held.agg(F.count_if(F.col("__small") & (F.col("status") == "treated")).alias("n_treated_gone"))
    return held.where("not __small").drop("__n", "__small"), gone


#: The checks before a run: name, metric, condition of a warning, condition of a failure, on x.
PREFLIGHT = [
    ("packages", "missing_packages", "", "x > 0"),
    ("activation candidates", "n_candidates", "x < 30", "x < 10"),
    ("time bands", "n_bands", "x < 4", ""),
    ("distance codes", "n_distance_codes", "", "x <= 1"),
    ("unmatched towns", "unmatched_share", "x > 0.1", "x > 0.3"),
    ("masked cells", "masked_share", "x > 0.3", ""),
    ("one channel within the other", "contained_share", "x < 0.99", ""),
    ("ids are vehicles", "individual_ids", "x < 1", ""),
    ("schedules can be solved", "solver_works", "x < 1", ""),
    ("least detectable effect", "mde", "x > 0.03", ""),
    ("fonts", "fonts", "", "x < 1"),
    ("regions matched with access", "access_matched", "x < 0.7", ""),
    ("seasons covered", "seasons_covered", "x < 4", ""),
    ("weights", "weight_error", "", "x > 0.000001"),
    ("robust top group", "robust_share", "x < 0.05", ""),
    ("months after activation", "missing_months", "x > 0", ""),
    ("forecast model", "model_works", "x < 1", ""),
    ("forecast against baseline", "ai_passes", "", "x < 1"),
    ("usable forecasts", "usable_forecasts", "", "x < 0.5"),
    ("split of districts", "unmapped_share", "x > 0.1", "x > 0.3"),
    ("regions without risk", "zero_risk_share", "x >= 0.5", ""),
]


def preflight(metrics: DataFrame) -> DataFrame:
    """The verdict on each of the ``PREFLIGHT`` checks for a one-row table of metrics: always all rows, 'n.a.' without the metric."""
    named = metrics.select(*[F.col(m) if m in metrics.columns else F.lit(None).cast("double").alias(m) for _, m, _, _ in PREFLIGHT])
    return gates(named, PREFLIGHT)


def cross_checked(public: DataFrame, printed: DataFrame, value: str, digits: int = 3, code: str = "code") -> DataFrame:
    """One row: regions in both, those whose recomputed value agrees with the printed one within its rounding, and the rank correlation."""
    from .risk import correlations

    both = public.select(code, F.col(value).alias("x")).join(printed.select(code, F.col(value).alias("y")), code)
    agree = F.abs(F.col("x") - F.col("y")) <= 0.5 * 10**-digits + 1e-12
    return both.agg(F.count("*").alias("n_both"), F.count_if(agree | (F.col("x").isNull() & F.col("y").isNull())).alias("n_agree")).crossJoin(correlations(both, "x", "y").select("spearman"))


def period_customers(cube: DataFrame, count: str, basis: str, by: list[str] | None = None) -> DataFrame:
    """Customers of a region over its period, by the largest or the smallest month."""
    if basis not in ("max", "min"):
        raise ValueError(f"a basis is max or min, not {basis!r}")
    return cube.groupBy(*(by or ["code"])).agg((F.max if basis == "max" else F.min)(count).alias("n"))
