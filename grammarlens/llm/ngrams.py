"""How often every term and every sequence of terms occurs, and in how many records.

Each position of a record starts a suffix, cut after the longest length wanted. Terms are
64-bit codes from the table of distinct terms on; equal suffixes are counted before they
are shuffled. They are routed by their first term and sorted in reverse lexicographic
order, in which all suffixes that begin with a sequence stand together; a stack with one
open entry for each length then gets the counts of all sequences in one pass.

The number of records needs no sets of records: at the start of a suffix it is known
which of its beginnings occur for the first time in this record (if a beginning is new,
so are all longer ones), so the suffix carries the length from which on it is new, and
counting those at each length counts every record once.

A first term that starts more suffixes than half a task's share is divided by the rest of
the suffix into as many parts as it has shares, and the parts are added up at the end, so
that no task gets all that begins with one term, or with one pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grammarlens.session import staged

#: Positions that are counted together before anything is handed on.
POSITIONS = 1 << 21


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each key, and whether it is there for the first time."""
    codes = pd.factorize(keys)[0].astype(np.int64)
    seen = np.maximum.accumulate(codes)
    return codes, np.concatenate([[True], codes[1:] > seen[:-1]]) if len(codes) else np.zeros(0, bool)


def _of_records(flat: np.ndarray, lengths: np.ndarray, longest: int) -> pa.RecordBatch:
    """Distinct suffixes of some records, with the length from which on they are new to theirs, and how many there are."""
    record = np.repeat(np.arange(len(lengths)), lengths)
    terms = [flat]
    for k in range(1, longest):
        later = np.zeros_like(flat)
        if k < len(flat):
            later[:-k] = np.where(record[k:] == record[:-k], flat[k:], 0)
        terms.append(later)
    small = [_numbered(t)[0] for t in terms]
    width = max((int(s.max()) for s in small), default=0) + 1
    new_from = 1 + sum((t != 0).astype(np.int64) for t in terms)
    key, is_new = record, []
    for s in small:
        key, first = _numbered(key * width + s)
        is_new.append(first)
    for n in range(longest, 0, -1):
        new_from = np.where(is_new[n - 1] & (terms[n - 1] != 0), n, new_from)
    key = small[0]
    for s in small[1:]:
        key = _numbered(key * width + s)[0]
    key, first = _numbered(key * (longest + 2) + new_from)
    at = np.flatnonzero(first)
    columns = [*(t[at] for t in terms), new_from[at].astype(np.int32), np.bincount(key)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*(f"t{k}" for k in range(longest)), "new_from", "n"])


def _suffixes(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            lists = batch.column(0).slice(at, 1024)
            held.append((lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)))
            size += len(held[-1][0])
            if size > POSITIONS:
                yield _of_records(*map(np.concatenate, zip(*held, strict=True)), longest)
                held, size = [], 0
    if size:
        yield _of_records(*map(np.concatenate, zip(*held, strict=True)), longest)


def _popped(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[pa.RecordBatch]:
    """Counts of all beginnings, from suffixes in reverse lexicographic order.

    stack[n - 1] is the open beginning of length n: its terms, occurrences and records. What
    begins and ends within a batch is summed up at once.
    """
    stack: list[list | None] = [None] * longest
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def done(terms: np.ndarray, occurrences: np.ndarray, records: np.ndarray) -> None:
        real = terms[:, -1] != 0
        padded = np.zeros((int(real.sum()), longest), np.int64)
        padded[:, : terms.shape[1]] = terms[real]
        out.append((padded, occurrences[real], records[real]))

    def rows() -> pa.RecordBatch:
        terms, occurrences, records = (np.concatenate(x) for x in zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([*(pa.array(terms[:, k]) for k in range(longest)), pa.array(occurrences), pa.array(records)], names=[*(f"t{k}" for k in range(longest)), "occurrences", "records"])

    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        terms = np.stack([batch.column(k).to_numpy() for k in range(longest)], axis=1)
        new_from, n = batch.column(longest).to_numpy(), batch.column(longest + 1).to_numpy()
        differs = np.ones_like(terms, bool)
        differs[1:] = terms[1:] != terms[:-1]
        if before is not None:
            differs[0] = terms[0] != before
        before = terms[-1]
        changed = np.logical_or.accumulate(differs, axis=1)
        for k in range(longest):
            new = np.where(new_from <= k + 1, n, 0)
            starts = np.flatnonzero(changed[:, k])
            upto = starts[0] if len(starts) else len(terms)
            if stack[k] is not None:
                stack[k][1] += int(n[:upto].sum())
                stack[k][2] += int(new[:upto].sum())
            if not len(starts):
                continue
            if stack[k] is not None:
                done(stack[k][0][None, :], np.array([stack[k][1]]), np.array([stack[k][2]]))
            occurrences, records = np.add.reduceat(n, starts), np.add.reduceat(new, starts)
            done(terms[starts[:-1], : k + 1], occurrences[:-1], records[:-1])
            stack[k] = [terms[starts[-1], : k + 1], int(occurrences[-1]), int(records[-1])]
        if out:
            yield rows()
    for entry in stack:
        if entry is not None:
            done(entry[0][None, :], np.array([entry[1]]), np.array([entry[2]]))
    if out:
        yield rows()


def vocabulary(records: DataFrame, terms: str) -> DataFrame:
    """Every distinct term with how often it occurs and a 64-bit code of its own, which isn't 0.

    Codes are hashes; if two terms should share one, another hash is tried.
    """
    found = staged(records.select(F.explode(terms).alias("term")).where("term is not null").groupBy("term").agg(F.count("*").alias("n")), "terms")
    for seed in range(100):
        coded = found.withColumn("code", F.xxhash64(F.lit(seed), "term"))
        check = coded.agg(F.count("*").alias("terms"), F.countDistinct("code").alias("codes"), F.count_if(F.col("code") == 0).alias("zero")).first()
        if check.terms == check.codes and not check.zero:
            return coded.withColumn("seed", F.lit(seed))
    raise ValueError("no hash tells all terms apart")


def counted(records: DataFrame, terms: str, longest: int = 3, upto: int | None = None) -> DataFrame:
    """Every sequence of 1 to longest terms, or to upto of them: gram, occurrences, records.

    records has one row for each record, terms an array of strings. Null and empty arrays
    and null elements hold no terms; sequences run across a null element as if it weren't
    there; an empty table gives no rows; other columns are dropped, whatever their names.
    """
    records = records.select(F.col(terms).alias("terms"))
    spark, names = records.sparkSession, [f"t{k}" for k in range(longest)]
    known = vocabulary(records, "terms")
    some = known.agg(F.sum("n").alias("total"), F.max("seed").alias("seed")).first()
    total, seed = some.total or 0, some.seed or 0
    # Terms with more than half a task's share of the suffixes: fewer than twice as many as there are tasks.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = known.where(F.col("n") * (2 * tasks) > total).select(F.col("code").alias("t0"), F.ceil(F.col("n") * (2 * tasks) / max(total, 1)).alias("parts"))
    coded = records.select(F.transform(F.filter("terms", lambda t: t.isNotNull()), lambda t: F.xxhash64(F.lit(seed), t)).alias("codes")).where("size(codes) > 0")
    fields = ", ".join(f"{t} bigint" for t in names)
    parts = coded.mapInArrow(lambda it: _suffixes(it, longest), f"{fields}, new_from int, n bigint")
    rest = F.xxhash64(*names[1:]) if longest > 1 else F.lit(0)
    routed = parts.join(F.broadcast(hot), "t0", "left").withColumn("part", F.pmod(rest, F.coalesce("parts", F.lit(1)))).drop("parts")
    ordered = routed.repartition("t0", "part").sortWithinPartitions(*map(F.desc, names)).drop("part")
    popped = ordered.mapInArrow(lambda it: _popped(it, longest), f"{fields}, occurrences bigint, records bigint")
    if upto is not None and upto < longest:
        popped = popped.where(F.col(names[upto]) == 0)
    sums = popped.groupBy(*names[:upto]).agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    for t in names[:upto]:
        sums = sums.join(known.select(F.col("code").alias(t), F.col("term").alias(f"{t}_term")), t, "left")
    return sums.select(F.array_compact(F.array(*(f"{t}_term" for t in names[:upto]))).alias("gram"), "occurrences", "records")


def marked(grams: DataFrame, total_samples: int, rare_under: float = 0.002, common_over: float = 0.9) -> DataFrame:
    """grams with total_samples and a mark: rare, common, or null.

    Both limits are exact: counts are compared as whole numbers of a millionth.
    """
    low, high = round(rare_under * 1e6), round(common_over * 1e6)
    mark = F.expr(f"case when records > 0 and records * 1000000L < total_samples * {low}L then 'rare' when records * 1000000L > total_samples * {high}L then 'common' end")
    return grams.withColumn("total_samples", F.lit(total_samples).cast("bigint")).withColumn("mark", mark)
