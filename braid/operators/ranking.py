"""Ranks within groups, for groups of any size: windows and map-side combined counts instead of arrays."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braid.functions.scalars import trimmed


def top_n(df: DataFrame, key: str, order, n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key. Spark keeps n rows per key before the shuffle as well."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")).filter(F.col(rank) <= n)


def frequencies(df: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """(key, value, n, first, rank): values by count, the one met first of equals."""
    counted = df.filter(F.col(value) != "").groupBy(key, value).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first")).cast("long"))


def best_experience(entries: DataFrame) -> DataFrame:
    """merged_experience() for tables of entries (candidate_key, seq, title, company, start_date, description): a winner per key
    by one map-side combined maximum."""
    def clean(x):
        return trimmed(F.lower(F.coalesce(x, F.lit(""))))

    row = F.struct("title", "company", "start_date", "description", "seq")
    order = F.struct(F.length(F.coalesce("description", F.lit(""))).alias("n"), (-F.col("seq")).alias("s"))
    return entries.groupBy("candidate_key", clean(F.col("company")).alias("k1"), clean(F.col("title")).alias("k2"), F.coalesce("start_date", F.lit("")).alias("k3")).agg(F.max_by(row, order).alias("e"), F.min("seq").alias("first")).select("candidate_key", "e.*", "first")
