"""Distinct URIs in order of arrival, with a cap for each registrable domain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grammarlens.session import staged


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """For each key the first place in order: keys and order columns. Null keys are one key.

    Aggregates the least place, which is combined before the shuffle.
    """
    return rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first")).select(*keys, *(F.col(f"_first.{c}").alias(c) for c in order))


def capped(rows: DataFrame, bucket: str, uri: str, order: list[str], cap: int | None, scope: list[str] | None = None) -> DataFrame:
    """Distinct URIs, of each bucket the first cap ones; rows without a bucket are only made distinct.

    The cap is a literal rank, so each task hands on at most cap rows of a bucket, and a
    bucket with a third of all rows never meets whole in one task.
    """
    scope = scope or []
    once = first_seen(rows.withColumn(bucket, F.coalesce(bucket, F.lit(""))), [*scope, bucket, uri], order)
    if cap is None:
        return once
    # Written once; else both branches below would scan and aggregate everything.
    once = staged(once, "once")
    free, bound = once.where(F.col(bucket) == ""), once.where(F.col(bucket) != "")
    rank = F.row_number().over(W.partitionBy(*scope, bucket).orderBy(*order))
    return bound.withColumn("_rank", rank).where(F.col("_rank") <= cap).drop("_rank").unionByName(free)
