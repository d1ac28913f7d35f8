"""Samples of fixed size from data of unknown length: adaptive Bernoulli sampling.

Every record has a permuted number for each run; at rate 2^-L it is in if the number
starts with L zero bits. A run's state is a table of the records that are in and how often
its rate was halved. What arrives is offered at the rate of the state; if the buffer then
holds twice what is wanted, the rate is halved, which thins the buffer to the records with
one more zero bit. Since the number belongs to the record, thinning needs no memory of
earlier choices, states of different pieces agree about every record, and merging two means
going on at the lower of their rates. So a piece that is added costs reading that piece and
the state, never what came before. At any time the state can be subsampled uniformly to the
size asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grammarlens.llm.feistel import HI, LO, permuted, with_keys
from grammarlens.llm.smallest import smallest
from grammarlens.session import staged

#: Runs whose keys stand in one plan as literals; more take further passes over the records.
RUNS_AT_ONCE = 100
LEVEL = f"(31 - cast(floor(log2({HI} + 0.5D)) as int))"


def offered(records: DataFrame, number: str, runs: DataFrame, run: str = "run_id", seed: str = "seed") -> DataFrame:
    """run, the record as _row and the halves of its permuted number, for each run and record with a number.

    The product isn't stored: it is made and thinned in one step of the plan.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in records.columns if c != run))
    packed = records.where(F.col(number).isNotNull()).select(row.alias("_row"), F.col(number).alias("_number"))
    return permuted(for_each(packed, with_keys(runs.select(run, F.col(seed).alias("_seed")), "_seed").drop("_seed")), "_number").select(run, "_row", HI, LO)


def thinned(new: DataFrame, runs: DataFrame, run: str = "run_id", size: str = "target_n", before: DataFrame | None = None) -> DataFrame:
    """The state after new records, as offered, have come to the state before them.

    A rate is halved as long as the halved buffer still holds the size asked for, so a state
    has about twice that size at most, and never less than there is or is asked for. before
    may be the union of several states: all go on at the lowest of their rates.
    """
    levels = new.groupBy(run, F.expr(LEVEL).alias("_level")).agg(F.count("*").alias("_n"), F.lit(0).alias("_halved"))
    if before is not None:
        own = before.groupBy(run, F.expr(LEVEL).alias("_level")).agg(F.count("*").alias("_n"), F.max("_halvings").alias("_halved"))
        levels = levels.unionByName(own).groupBy(run, "_level").agg(F.sum("_n").alias("_n"), F.max("_halved").alias("_halved"))
    at_least = F.sum("_n").over(W.partitionBy(run).orderBy(F.desc("_level")))
    enough = levels.withColumn("_kept", at_least).join(runs.select(run, F.col(size).alias("_size")), run)
    least = F.max(F.expr("case when _kept >= _size then _level end"))
    rates = staged(enough.groupBy(run).agg(F.greatest(F.coalesce(least, F.lit(0)), F.max("_halved")).alias("_halvings")), "rates")
    both = new if before is None else new.unionByName(before.select(*new.columns))
    return both.join(rates, run).where(F.expr(f"{LEVEL} >= _halvings"))


def drawn(state: DataFrame, runs: DataFrame, run: str = "run_id", size: str = "target_n") -> DataFrame:
    """For each run exactly size records of its state, each equally likely, or all if there are fewer."""
    return smallest(state, [run], runs, size, "_halvings").select(run, "_row.*")


def fixed_size(records: DataFrame, number: str, runs: DataFrame, run: str = "run_id", size: str = "target_n", seed: str = "seed") -> DataFrame:
    """For each run exactly size records, each equally likely, or all if there are fewer.

    records must be distinct in number. runs is a small table (its rows are runs of a
    sampler). Null or non-positive sizes give no rows; null numbers are never drawn; of the
    records all columns come back but one that is named like run.
    """
    asked = runs.where(F.col(size) > 0)
    return drawn(thinned(offered(records, number, asked, run, seed), asked, run, size), asked, run, size)


def for_each(records: DataFrame, runs: DataFrame) -> DataFrame:
    """records once for each row of runs, a table of parameters."""
    rows = runs.collect()
    if not rows:
        return records.where("false").select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in runs.schema))
    parts = []
    for at in range(0, len(rows), RUNS_AT_ONCE):
        literal = lambda r: F.struct(*(F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in runs.schema))
        parts.append(records.select("*", F.inline(F.array(*map(literal, rows[at : at + RUNS_AT_ONCE])))))
    return reduce(DataFrame.unionByName, parts)
