"""Matching region texts to codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import match_key


def unique_lookup(dim: DataFrame, key: Column, code: str = "code") -> DataFrame:
    """key, code of keys that stand for one row only; others never match."""
    return dim.select(key.alias("key"), code).groupBy("key").agg(F.count("*").alias("n"), F.min(code).alias(code)).where("n = 1").select("key", code)


def match_regions(facts: DataFrame, dim: DataFrame, names: dict[str, str] | None = None, parts: tuple[str, str, str] = ("province", "district", "town"), code: str = "code") -> DataFrame:
    """Distinct region texts with their code and how it was found: exact, normalized or none.

    Texts are made distinct before any string work, and only misses are looked up again.
    """
    raw, norm = (match_key(*parts, names=names, normalized=n) for n in (False, True))
    texts = facts.select(*parts).distinct().withColumns({"__raw": raw, "__norm": norm})
    exact = unique_lookup(dim, raw, code).select(F.col("key").alias("__raw"), F.col(code).alias("__c1"))
    loose = unique_lookup(dim, norm, code).select(F.col("key").alias("__norm"), F.col(code).alias("__c2"))
    out = texts.join(exact, "__raw", "left").join(loose, "__norm", "left")
    method = F.when(F.col("__c1").isNotNull(), "exact").when(F.col("__c2").isNotNull(), "normalized").otherwise("none")
    return out.select(*parts, F.coalesce("__c1", "__c2").alias(code), method.alias("method"))


def match_rates(matched: DataFrame, weights: DataFrame | None = None, parts: tuple[str, str, str] = ("province", "district", "town"), weight: str = "kwh") -> DataFrame:
    """One row: texts, matched by either way, share unmatched, and its share of a weight."""
    held = matched if weights is None else matched.join(weights.groupBy(*parts).agg(F.sum(weight).alias("__w")), list(parts), "left")
    w = F.col("__w") if weights is not None else F.lit(1.0)
    none = F.col("method") == "none"
    return held.agg(F.count("*").alias("n"), F.count_if(F.col("method") == "exact").alias("n_exact"), F.count_if(F.col("method") == "normalized").alias("n_normalized"), F.avg(none.cast("int")).alias("unmatched"), (F.coalesce(F.sum(F.when(none, w)), F.lit(0.0)) / F.nullif(F.sum(w), F.lit(0.0))).alias("unmatched_weight"))


def canonicalize(df: DataFrame, crosswalk: DataFrame, code: str = "code", fold_to: int | None = None) -> DataFrame:
    """Codes by the crosswalk (code, canonical), themselves where it has none, optionally folded to a prefix padded with zeros."""
    mapped = df.join(crosswalk.select(F.col("code").alias(code), "canonical"), code, "left").withColumn(code, F.coalesce("canonical", code)).drop("canonical")
    return mapped.withColumn(code, F.rpad(F.substring(code, 1, fold_to), 10, "0")) if fold_to else mapped
