"""Quotas, samples of the smallest hashes, and shards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grammarlens.functions import ident
from grammarlens.operators import dedup
from grammarlens.session import staged


def quotas(strata: DataFrame, weight: str, target: int | Column, index: str, by: list[str] | None = None) -> DataFrame:
    """strata with quota: target divided by weight, leftovers to the largest remainders.

    strata is a table of parameters, with several runs where by names the columns that tell
    them apart. A total weight of 0 gives quotas of 0, and so do null weights.
    """
    every = W.partitionBy(*(by or [F.lit(0)]))  # one row for each stratum
    target, weight = target if isinstance(target, Column) else F.lit(target), F.coalesce(F.col(weight), F.lit(0.0))
    total = F.sum(weight).over(every)
    out = strata.withColumn("_exact", F.when(total > 0, target * weight / total).otherwise(0.0)).withColumn("quota", F.floor(F.col("_exact") + 1e-9).cast("bigint"))
    left = F.when(F.sum("_exact").over(every) > 0, target - F.sum("quota").over(every)).otherwise(0)
    rank = F.row_number().over(every.orderBy(F.desc(F.round(F.col("_exact") - F.col("quota"), 9)), index))
    return out.withColumn("quota", F.col("quota") + (rank <= left).cast("bigint")).drop("_exact")


def bottom_k(rows: DataFrame, group: list[str], rank_by: str, uri: str, quota: DataFrame, most: int) -> DataFrame:
    """The rows of each group with the smallest rank_by, as many as its quota; of equal ones the larger URI.

    most is the largest quota: with a literal bound each task hands on only its own most
    smallest rows of a group.
    """
    rank = F.row_number().over(W.partitionBy(*group).orderBy(rank_by, F.desc(uri)))
    best = rows.withColumn("_rank", rank).where(F.col("_rank") <= most)
    return best.join(staged(quota.select(*group, "quota"), "quota"), group).where("_rank <= quota").drop("quota")


def stratified(rows: DataFrame, quota: DataFrame, seed: int, most: int) -> DataFrame:
    """Of each stratum's distinct URIs its quota with the smallest fractions; a URI of two strata stays in the first.

    Fractions are drawn with the seed plus the place of the stratum among those of quota, so
    strata don't choose the same of their common URIs. What is dropped isn't made up.
    """
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("stratum"))) - 1  # one row for each stratum
    seeds = quota.select("stratum", (F.lit(seed) + place).alias("_seed"))
    ranked = rows.join(staged(seeds, "seeds"), "stratum").withColumn("rank_by", ident.fraction(F.col("uri"), F.col("_seed")))
    best = bottom_k(ranked.select("stratum", "uri", "rank_by"), ["stratum"], "rank_by", "uri", quota, most)
    return dedup.first_seen(best, ["uri"], ["stratum", "rank_by"])


def of_runs(pool: DataFrame, strata: DataFrame, rank: Callable[[Column, Column], Column]) -> DataFrame:
    """For each run the quota of each stratum with the smallest ranks, a URI of several strata in the first of them.

    pool: stratum and uri, distinct; strata: run_id, stratum_idx, stratum, seed and quota, one
    row for each stratum of a run. rank makes a number from a URI and the seed plus the index,
    so strata don't choose the same of their common URIs. What is dropped isn't made up.
    The cut is found from a histogram of ranks, so that no task holds a stratum.
    """
    keyed = staged(strata.where("quota > 0").select("run_id", "stratum_idx", "stratum", (F.col("seed") + F.col("stratum_idx")).alias("_seed"), "quota"), "strata")
    ranked = pool.join(keyed, "stratum").withColumn("rank_by", rank(F.col("uri"), F.col("_seed")))
    group = ["run_id", "stratum_idx"]
    # Ranks are below 2^60, their first twelve bits are a range.
    counted = ranked.groupBy(*group, F.shiftright("rank_by", 48).alias("_range"), "quota").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(W.partitionBy(*group).orderBy("_range"))
    cut = staged(counted.withColumn("_upto", upto).where("_upto >= quota and _upto - _n < quota").select(*group, F.col("_range").alias("_cut"), F.expr("quota - (_upto - _n)").alias("_left")), "cut")
    placed = ranked.join(cut, group, "left").where("_cut is null or shiftright(rank_by, 48) <= _cut").select(*group, "stratum", "uri", "rank_by", F.expr("_cut is not null and shiftright(rank_by, 48) = _cut").alias("_at"), "_left")
    last = F.row_number().over(W.partitionBy(*group).orderBy("rank_by", F.desc("uri")))
    at = placed.where("_at").withColumn("_rank", last).where("_rank <= _left").drop("_rank")
    chosen = placed.where("not _at").unionByName(at)
    return dedup.first_seen(chosen, ["run_id", "uri"], ["stratum_idx", "rank_by"])


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with their number in the whole order, from 0, without a window over everything.

    Rows are range-sorted; each task numbers its own, and the counts of the tasks before it,
    one number for each task, are added.
    """
    # Written once: a second run of the range sort could draw other borders.
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_task", F.spark_partition_id()).withColumn("_own", F.monotonically_increasing_id() - F.shiftleft(F.col("_task").cast("bigint"), 33))
    placed = staged(placed, "numbered")
    sizes = placed.groupBy("_task").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return placed.join(F.broadcast(before), "_task").withColumn("number", F.col("_own") + F.col("_before")).drop("_task", "_own", "_before")


def sharded(numbered_rows: DataFrame, shards: int) -> DataFrame:
    """Round robin: the shard of a row is its number modulo the number of shards."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    return numbered_rows.withColumn("shard", F.pmod(F.col("number"), F.lit(shards)).cast("int"))
