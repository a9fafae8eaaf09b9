"""Small frames for tests."""

from __future__ import annotations


def apply(spark, values, schema, expression):
    """Evaluate a column function over one column ``v`` in order."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(list(enumerate(values)), f"i INT, v {schema}")
    out = rows.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()
    return [r["out"] for r in out]
