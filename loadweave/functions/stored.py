"""Tables kept between steps in the folder that driver and executors share, and what is computed round by round on them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder on a local master and an error on a cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    found = tempfile.mkdtemp(prefix="loadweave-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """df as Parquet, read again: computed once, and whatever reads it survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node reachable) of every node of the links (a, b).

    Each round a node takes the label of its label and the least label of its neighbours; labels jump, so rounds grow
    with the logarithm of the longest way through a component.  Rounds are stored.
    """
    ends = links.where("a <> b")
    edges = stored(ends.select("a", "b").unionByName(ends.selectExpr("b as a", "a as b")).distinct(), "edges")
    labels = stored(edges.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a as node", "least(a, m) as label"), "labels")
    while True:
        jumped = labels.join(labels.selectExpr("node as label", "label as next"), "label").selectExpr("node", "label", "next")
        told = edges.join(jumped.selectExpr("node as b", "next"), "b").groupBy("a").agg(F.min("next").alias("heard"))
        now = stored(jumped.join(told.withColumnRenamed("a", "node"), "node").selectExpr("node", "least(next, heard) as label", "least(next, heard) <> label as moved"), "labels")
        if now.where("moved").isEmpty():
            return now.selectExpr("node", "label as component")
        labels = now.drop("moved")
