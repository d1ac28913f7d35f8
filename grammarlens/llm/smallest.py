"""The k rows of each group with the smallest permuted numbers, without sorting the groups.

A histogram of 4,096 ranges per group finds the range that holds the k-th number, a second
one divides that range again, and only the numbers of the range within it are ranked. What
comes out is the k-th number itself, so the rows are looked at once more, and no task ever
holds a group, however large the group is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grammarlens.llm.feistel import HI, LO
from grammarlens.session import staged

#: Bits of a permuted number that are compared, and those that each histogram divides by.
WIDTH, BITS = 62, 12


def _ranged(rows: DataFrame, group: list[str], left: DataFrame, bits: int) -> DataFrame:
    """left has a row for each group with _k, how many of its rows are wanted from those offered: the range with the last
    of them as _cut, and _k as what is wanted from within. Groups that offer fewer drop out."""
    counted = rows.groupBy(*group, F.shiftright("_w", WIDTH - bits).alias("_b")).count()
    upto = F.sum("count").over(W.partitionBy(*group).orderBy("_b"))
    met = counted.withColumn("_upto", upto).join(left, group).where("_upto >= _k and _upto - count < _k")
    return staged(met.select(*group, F.col("_b").alias("_cut"), F.expr("_k - (_upto - count)").alias("_k")), "cut")


def marked(rows: DataFrame, group: list[str], wanted: DataFrame, k: str, shift: str = "0") -> DataFrame:
    """rows with the column _in: whether they are among the k smallest of their group.

    rows has the halves of a permuted number, which is distinct within a group; wanted has
    one row per group, with k. shift is an expression over rows: how many leading bits of the
    number are known to be 0, so that the ranges divide what is left. Where k is null or not
    positive nothing is in, where a group has no more than k rows all of it is; rows of
    groups that aren't wanted are left out. What is joined was written and has a known size,
    so Spark broadcasts it only if it is small.
    """
    names = rows.columns
    wanted = staged(wanted.select(*group, F.col(k).cast("bigint").alias("_k")), "wanted")
    placed = rows.withColumn("_w", F.expr(f"shiftleft(shiftleft({HI}, 30) | shiftright({LO}, 2), {shift}) & {(1 << WIDTH) - 1}L"))
    numbers = placed.select(*group, HI, LO, "_w")
    first = _ranged(numbers, group, wanted.where("_k > 0"), BITS)
    within = numbers.join(first.select(*group, "_cut"), group).where(F.shiftright("_w", WIDTH - BITS) == F.col("_cut")).drop("_cut")
    second = _ranged(within, group, first.drop("_cut"), 2 * BITS)
    last = numbers.join(second, group).where(F.shiftright("_w", WIDTH - 2 * BITS) == F.col("_cut"))
    rank = F.row_number().over(W.partitionBy(*group).orderBy(HI, LO))
    kth = last.withColumn("_rank", rank).where("_rank = _k").select(*group, F.col(HI).alias("_hi_k"), F.col(LO).alias("_lo_k"))
    ends = staged(wanted.join(kth, group, "left"), "ends")
    is_in = F.expr(f"coalesce(_k, 0) > 0 and (_hi_k is null or {HI} < _hi_k or ({HI} = _hi_k and {LO} <= _lo_k))")
    return rows.join(ends, group).select(*names, is_in.alias("_in"))


def smallest(rows: DataFrame, group: list[str], wanted: DataFrame, k: str, shift: str = "0") -> DataFrame:
    """The rows that marked() marks."""
    return marked(rows, group, wanted, k, shift).where("_in").drop("_in")
