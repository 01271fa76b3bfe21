"""Array-column (vector) work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import cosine, norm
from tessera.operators.sizing import attach_statistics


def centroids(df: DataFrame, by: Sequence[str], vec: str, name: str = "centroid") -> DataFrame:
    """Element-wise mean vector per group. Vectors are exploded to (group,
    index, value) and averaged with a partial aggregate, so a large group is
    reduced map-side; only one vector per group (its dimension, not its row
    count) is assembled at the end."""
    by = list(by)
    ex = df.select(*by, F.posexplode(vec).alias("_i", "_x"))
    m = ex.groupBy(*by, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return (m.groupBy(*by)
              .agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_s"))
              .select(*by, F.transform("_s", lambda s: s["_m"]).alias(name)))


def centroid_similarity(df: DataFrame, by: Sequence[str], vec: str) -> DataFrame:
    """Each vector's norm and cosine similarity to its group's centroid."""
    j = attach_statistics(df, centroids(df, by, vec), by, name="centroids")
    return j.withColumn("norm", norm(vec)).withColumn("cos_centroid", cosine(vec, "centroid")) \
            .drop("centroid")
