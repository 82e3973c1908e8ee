"""Dense numbers without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(df: DataFrame, by: list[str], name: str = "number", seed: int = 0, bits: int = 12) -> DataFrame:
    """df with numbers from 0, dense and in the order of a hash of ``by`` (and of ``by`` itself on ties).

    Rows are numbered within slices of the hash, 2 ** bits in all; where a slice begins comes from a
    running sum over one row a slice.  Rows equal in ``by`` take numbers in any order.
    """
    held = df.withColumn("__h", F.xxhash64(*by, F.lit(seed))).withColumn("__slice", F.shiftright("__h", 64 - bits))
    sizes = held.groupBy("__slice").agg(F.count("*").alias("__n"))
    begins = sizes.select("__slice", (F.sum("__n").over(Window.orderBy("__slice")) - F.col("__n")).alias("__begin"))
    own = F.row_number().over(Window.partitionBy("__slice").orderBy("__h", *by)) - 1
    out = held.withColumn("__own", own).join(F.broadcast(begins), "__slice")  # at most 2 ** bits rows
    return out.withColumn(name, F.col("__begin") + F.col("__own")).drop("__h", "__slice", "__begin", "__own")
