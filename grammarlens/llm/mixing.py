"""Mixing sources to target weights by entropy balancing.

The rates closest to one copy of everything (in relative entropy) under which each
source reaches its target are exp(lambda x size), with one multiplier for each source
and the rate cut off at the cap on repeats. The multipliers solve a concave dual; its
gradient and curvature are sums over the records, so each Newton step is an aggregate
over the histogram of record sizes, in which records of equal size are one row. A dual
that still rises where all records are at the cap has no maximum: that source can't reach
its target. Rates are then rounded: records of one source and size have the same rate, so
each gets the whole part, and what is missing goes as one more copy each to those with the
smallest permuted numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grammarlens.llm.feistel import permuted, with_keys
from grammarlens.llm.smallest import marked
from grammarlens.session import staged

STEPS, CLOSE = 60, 1e-10


def quotas(strata: DataFrame, runs: DataFrame) -> DataFrame:
    """strata of each run with exact share and integer target (largest remainder, then index).

    Null and negative weights count as 0; a run whose weights sum to 0 gets targets of 0.
    """
    run = W.partitionBy("run_id")
    shares = (
        strata.withColumn("_w", F.expr("greatest(coalesce(weight, 0D), 0D)"))
        .withColumn("_sum", F.sum("_w").over(run))
        .drop("target", "kept")
        .join(runs.select("run_id", "target_n", "total_written"), "run_id")
        .withColumn("share", F.expr("case when _sum > 0 then coalesce(target_n, 0) * _w / _sum else 0D end"))
        .withColumn("_floor", F.expr("cast(floor(share + 1e-9) as bigint)"))
    )
    left = F.expr("case when _sum > 0 then coalesce(target_n, 0) else 0 end") - F.sum("_floor").over(run)
    rank = F.row_number().over(run.orderBy(F.desc(F.expr("round(share - _floor, 9)")), "stratum_idx"))
    return shares.withColumn("target", F.col("_floor") + (rank <= left).cast("bigint")).drop("_w", "_sum", "_floor")


def _rate(multiplier: str, cap: str) -> str:
    """At the cap a rate is the cap itself, so that masses there are exact."""
    return f"case when {cap} <= 0 then 0D when {multiplier} * size >= ln({cap}) - 1e-12 then cast({cap} as double) else exp({multiplier} * size) end"


class _Dual:
    """Where the search for one multiplier stands. end is where the smallest record reaches the cap, and with it all others."""

    def __init__(self, goal: float, cap: float, least: float | None, most: float | None) -> None:
        self.goal, self.end = goal, math.log(cap) / least if least and cap > 0 else 0.0
        self.low, self.high, self.at = min(0.0, self.end) - 700.0 / (most or 1), self.end, min(0.0, self.end)
        self.reached: bool | None = None if goal > 0 else True
        self.end_met = False

    def step(self, mass: float, curve: float) -> None:
        """Takes the mass of the rates, and its slope, at the place that was asked for."""
        if self.at == self.end and not self.end_met:
            if mass <= self.goal:
                self.reached = mass == self.goal
                return
            self.end_met = True
        elif abs(mass - self.goal) <= CLOSE * self.goal:
            self.reached = True
            return
        if mass < self.goal:
            self.low = self.at
        else:
            self.high = self.at
        # Far out, Newton on the logarithm of the mass.
        to = self.at - mass / curve * math.log(mass / self.goal) if curve and mass else self.end
        if to >= self.end and not self.end_met:
            self.at = self.end
        else:  # it may not leave what is bracketed
            self.at = to if self.low < to < self.high else (self.low + self.high) / 2


def balanced(wanted: DataFrame, sizes: DataFrame, group: list[str], source: str, goal: str, cap: str) -> DataFrame:
    """wanted with the multiplier of each group and whether the goal is in reach.

    wanted: one row for each group (run and source), with goal and cap, and no other columns
    that begin with an underscore. sizes: for each source, how many records (n) of each
    positive size it has. A goal of 0 is always reached and has no multiplier. Null and
    non-positive caps allow nothing, nor does a source without records or a null source; null
    goals count as 0, and rows with a null in group are left out. An error is raised if a
    solution isn't met within STEPS.
    """
    limit = F.greatest(F.coalesce(F.col(cap), F.lit(0)), F.lit(0)).alias("_cap")
    wanted = wanted.where(" and ".join(f"`{g}` is not null" for g in group))
    points = staged(wanted.select(*group, source, F.col(goal).alias("_goal"), limit).join(sizes.select(source, "size", "n"), source, "left"), "balance")
    spark = wanted.sparkSession
    schema = ", ".join(f"`{g}` {wanted.schema[g].dataType.simpleString()}" for g in group) + ", _mult double"
    # One row of numbers for each run and source, whatever the data.
    ends = points.groupBy(*group).agg(F.max("_goal").alias("goal"), F.max("_cap").alias("cap"), F.min("size").alias("least"), F.max("size").alias("most"))
    duals = {tuple(r[g] for g in group): _Dual(float(r["goal"] or 0), float(r["cap"]), r["least"], r["most"]) for r in ends.collect()}
    for _ in range(STEPS):
        asked = [(*k, d.at) for k, d in duals.items() if d.reached is None]
        if not asked:
            break
        rated = points.join(spark.createDataFrame(asked, schema), group).withColumn("_rate", F.expr(_rate("_mult", "_cap")))
        mass, slope = F.expr("n * size * _rate"), F.expr("case when _rate < _cap then n * size * size * _rate else 0D end")
        for r in rated.groupBy(*group).agg(F.coalesce(F.sum(mass), F.lit(0.0)).alias("mass"), F.coalesce(F.sum(slope), F.lit(0.0)).alias("slope")).collect():
            duals[tuple(r[g] for g in group)].step(r["mass"], r["slope"])
    if any(d.reached is None for d in duals.values()):
        raise ValueError(f"no solution within {STEPS} steps")
    found = spark.createDataFrame([(*k, d.at if d.goal > 0 else None, d.reached) for k, d in duals.items()], schema + ", reached boolean")
    return wanted.join(found, group).withColumnRenamed("_mult", "multiplier")


def mixture(records: DataFrame, number: str, source: str, solved: DataFrame, sizes: DataFrame, group: list[str], cap: str, seed: str, size: str | None = None) -> DataFrame:
    """Copies of each record in each run: group, the record's columns, copies (1 or more).

    solved comes from balanced(), sizes from the same records; size is a column of records
    (1 for all without it). The copies of a source add up to the sum of its rates, rounded,
    and so do those of its records up to any size. Records with a null source, number or size
    are never used; of a record's columns those named like group or copies don't come back.
    """
    classes = solved.where("multiplier is not null").join(sizes.select(source, "size", "n"), source).where("n > 0")
    rated = classes.withColumn("_rate", F.expr(_rate("multiplier", f"`{cap}`")))
    upto = F.round(F.sum(F.expr("n * _rate")).over(W.partitionBy(*group).orderBy("size"))).cast("bigint")
    summed = rated.withColumn("_upto", upto)
    total = F.col("_upto") - F.coalesce(F.lag("_upto").over(W.partitionBy(*group).orderBy("size")), F.lit(0))
    whole = summed.withColumn("_total", total).select(*group, F.col(source).alias("_source"), F.col("size").alias("_size"), F.col(seed).alias("_seed"), F.expr("_total div n").alias("_base"), F.expr("_total % n").alias("_extra"))
    keyed = staged(with_keys(whole, "_seed").drop("_seed"), "classes")
    row = F.struct(*(F.col(f"`{c}`") for c in records.columns if c not in (*group, "copies")))
    own = F.lit(1).cast(sizes.schema["size"].dataType) if size is None else F.col(size)
    packed = records.where(F.col(number).isNotNull()).select(row.alias("_row"), F.col(number).alias("_number"), F.col(source).alias("_source"), own.alias("_size"))
    placed = marked(permuted(packed.join(keyed, ["_source", "_size"]), "_number"), [*group, "_size"], keyed, "_extra")
    return placed.withColumn("copies", F.expr("_base + cast(_in as bigint)")).where("copies > 0").select(*group, "_row.*", "copies")
