"""Stable samples, samples of fixed size, mixtures: against their definitions."""

import random

import pytest
from pyspark.sql import functions as F

from grammarlens.llm import feistel, mixing, reservoir, smallest

MASK = feistel.MASK


def keys(seed):
    out = []
    for i in range(feistel.ROUNDS):
        x = ((seed & MASK) + ((i + 1) * 1640531527 & MASK)) & MASK
        for r in range(3):
            x = ((x ^ ((r + i + 1) * 2654435769 & MASK)) * feistel.MULTIPLIERS[(i + 2 * r) % feistel.ROUNDS] >> 16) & MASK
        out.append(x)
    return out


def permuted(number, seed):
    hi, lo = (number >> 32) & MASK, number & MASK
    for k, m in zip(keys(seed), feistel.MULTIPLIERS, strict=True):
        hi, lo = lo, hi ^ (((lo ^ k) * m >> 16) & MASK)
    return hi << 32 | lo


def unpermuted(value, seed):
    hi, lo = value >> 32, value & MASK
    for k, m in reversed(list(zip(keys(seed), feistel.MULTIPLIERS, strict=True))):
        hi, lo = lo ^ (((hi ^ k) * m >> 16) & MASK), hi
    return hi << 32 | lo


def test_permutation_is_one_and_can_be_undone(spark):
    rows = [(n, s) for s in (0, -3, 17, 2**40 + 1) for n in (0, 1, -1, 2**62, -(2**63), *range(2, 60))]
    df = spark.createDataFrame(rows, "n long, seed long")
    got = feistel.permuted(feistel.with_keys(df), "n").collect()
    for r in got:
        value = r._hi << 32 | r._lo
        assert value == permuted(r.n, r.seed)
        assert unpermuted(value, r.seed) == r.n & (2**64 - 1)


def test_a_sample_stays_when_rows_are_added_or_moved(spark):
    rows = [(i, 5, 0.3, "x") for i in range(4000)]
    df = spark.createDataFrame(rows, "n long, seed long, sample_rate double, hi string")
    small = {r.n for r in feistel.sample(df.where("n < 1500"), "n").collect()}
    large = {r.n for r in feistel.sample(df.repartition(13), "n").collect()}
    assert small == {n for n in large if n < 1500}
    assert 0.27 < len(large) / 4000 < 0.33
    more = {r.n for r in feistel.sample(df.withColumn("sample_rate", F.lit(0.5)), "n").collect()}
    assert large < more
    other = {r.n for r in feistel.sample(df.withColumn("seed", F.lit(6).cast("long")), "n").collect()}
    assert other != large


def test_edges_of_rates(spark):
    rows = [(1, 0, 1.0), (2, 0, 0.0), (3, 0, None), (None, 0, 1.0), (4, None, 1.0), (5, 0, 1.5), (6, 0, -1.0), (1, 0, 1.0)]
    df = spark.createDataFrame(rows, "n long, seed long, sample_rate double")
    assert sorted(r.n for r in feistel.sample(df, "n").collect()) == [1, 1, 4, 5]
    assert feistel.sample(df.where("false"), "n").count() == 0


def test_fixed_sizes_are_exact_and_independent_of_layout(spark):
    records = spark.range(5000).select(F.col("id").alias("n"), F.lit("x").alias("_other"))
    runs = spark.createDataFrame([(1, 0, 100), (2, 0, 100), (3, 9, 5000), (4, 9, 9000), (5, 1, 0), (6, 1, None), (7, 2, 1)], "run_id long, seed long, target_n long")
    got = reservoir.fixed_size(records, "n", runs).collect()
    by_run = {k: sorted(r.n for r in got if r.run_id == k) for k in range(1, 8)}
    assert {k: len(v) for k, v in by_run.items()} == {1: 100, 2: 100, 3: 5000, 4: 5000, 5: 0, 6: 0, 7: 1}
    assert by_run[1] == by_run[2] == sorted(sorted(range(5000), key=lambda n: permuted(n, 0))[:100])
    again = reservoir.fixed_size(records.repartition(11), "n", runs).collect()
    assert sorted(r.n for r in again if r.run_id == 1) == by_run[1]
    assert reservoir.fixed_size(records.where("false"), "n", runs).count() == 0
    assert reservoir.fixed_size(records, "n", runs.where("false")).count() == 0


def test_every_record_is_drawn_equally_often(spark):
    runs = spark.createDataFrame([(i, i, 30) for i in range(400)], "run_id long, seed long, target_n long")
    got = reservoir.fixed_size(spark.range(120).withColumnRenamed("id", "n"), "n", runs).groupBy("n").count().collect()
    expected = 400 * 30 / 120
    assert len(got) == 120
    assert sum((r["count"] - expected) ** 2 / expected for r in got) / 119 < 1.4


def test_thinning_leaves_about_twice_the_size(spark):
    runs = spark.createDataFrame([(1, 3, 50)], "run_id long, seed long, target_n long")
    assert 50 <= reservoir.thinned(reservoir.offered(spark.range(20_000).withColumnRenamed("id", "n"), "n", runs), runs).count() <= 200


def test_pieces_that_arrive_one_by_one_give_the_sample_of_the_whole(spark):
    records = spark.range(9000).withColumnRenamed("id", "n").withColumn("piece", F.expr("case when n < 100 then 0 when n < 7000 then 1 else 2 end"))
    runs = spark.createDataFrame([(1, 3, 50), (2, 4, 600), (3, 5, 10_000), (4, 6, 1)], "run_id long, seed long, target_n long")
    want = {tuple(r) for r in reservoir.fixed_size(records.select("n"), "n", runs).collect()}
    state, sizes = None, []
    for piece in range(3):  # each round sees one piece and the state, which is a table
        new = reservoir.offered(records.where(F.col("piece") == piece).select("n"), "n", runs)
        state = reservoir.staged(reservoir.thinned(new, runs, before=state), "state")
        sizes.append({r.run_id: r["count"] for r in state.groupBy("run_id").count().collect()})
    assert {tuple(r) for r in reservoir.drawn(state, runs).collect()} == want
    assert sizes[0][1] >= 50 and sizes[2][1] <= 200 and sizes[2][2] <= 2400 and sizes[2][3] == 9000
    # States that were made apart merge at the lower rate.
    apart = [reservoir.staged(reservoir.thinned(reservoir.offered(records.where(F.col("piece") == p).select("n"), "n", runs), runs), "state") for p in range(3)]
    merged = reservoir.thinned(apart[0].drop("_halvings").where("false"), runs, before=apart[0].unionByName(apart[1]).unionByName(apart[2]))
    assert {tuple(r) for r in reservoir.drawn(merged, runs).collect()} == want


def test_marks_in_groups_with_odd_sizes(spark):
    rows = feistel.permuted(feistel.with_keys(spark.range(999).selectExpr("id as n", "id % 5 as g", "0L as seed")).drop("seed"), "n")
    wanted = spark.createDataFrame([(0, 7), (1, 0), (2, None), (3, 9999)], "g long, k long")
    got = smallest.marked(rows, ["g"], wanted, "k").collect()
    assert {g: sum(r._in for r in got if r.g == g) for g in range(5)} == {0: 7, 1: 0, 2: 0, 3: 200, 4: 0}
    assert {r.n for r in got if r.g == 0 and r._in} == set(sorted(range(0, 999, 5), key=lambda n: permuted(n, 0))[:7])


def wanted(spark, rows):
    return spark.createDataFrame(rows, "run_id long, stratum_idx int, stratum string, share double, target long, max_repeats int, seed long, kept long")


def test_balanced_rates_meet_their_goals(spark):
    sizes = spark.createDataFrame([("a", 1, 100), ("a", 3, 10), ("b", 1, 5), ("c", 2, 50)], "stratum string, size int, n long")
    want = [(1, 0, "a", 65.0, 65, 1, 0, 110), (1, 1, "b", 18.0, 18, 3, 0, 5), (1, 2, "b", 14.0, 14, 3, 0, 5), (1, 3, "c", 0.0, 0, 3, 0, 50), (1, 4, "none", 3.0, 3, 3, 0, 0), (1, 5, "none", 0.0, 0, 3, 0, 0), (2, 0, "a", 300.0, 300, 9, 0, 110), (2, 1, "b", 15.0, 15, 3, 0, 5), (2, 2, "a", 1e-6, 0, 2, 0, 0), (2, 3, "a", 1169.9, 0, 9, 0, 0), (2, 4, "a", 1170.1, 0, 9, 0, 0), (2, 5, "c", 5.0, 5, 0, 0, 0), (2, 6, "c", 5.0, 5, None, 0, 0)]
    got = {(r.run_id, r.stratum_idx): r for r in mixing.balanced(wanted(spark, want), sizes, ["run_id", "stratum_idx"], "stratum", "share", "max_repeats").collect()}
    assert {k for k, r in got.items() if not r.reached} == {(1, 1), (1, 4), (2, 4), (2, 5), (2, 6)}
    import math

    both = [(1, 100), (3, 10)]
    for key, by_size in (((1, 0), both), ((2, 0), both), ((2, 2), both), ((2, 3), both), ((1, 2), [(1, 5)])):
        r = got[key]
        mass = sum(n * s * min(math.exp(r.multiplier * s), r.max_repeats) for s, n in by_size)
        assert mass == pytest.approx(r.share, rel=1e-8)


def test_nulls_in_what_is_wanted(spark):
    sizes = spark.createDataFrame([("a", 1, 100), (None, 1, 5)], "stratum string, size int, n long")
    want = [(1, 0, "a", 65.0, 65, 1, 0, 0), (None, 0, "a", 65.0, 65, 1, 0, 0), (1, None, "a", 65.0, 65, 1, 0, 0), (1, 2, None, 65.0, 65, 1, 0, 0), (1, 3, "a", None, None, 1, 0, 0), (1, 4, "a", 65.0, 65, 1, None, None)]
    got = {(r.run_id, r.stratum_idx): r.reached for r in mixing.balanced(wanted(spark, want), sizes, ["run_id", "stratum_idx"], "stratum", "share", "max_repeats").collect()}
    assert got == {(1, 0): True, (1, 2): False, (1, 3): True, (1, 4): True}


def test_a_dual_that_is_not_solved_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEPS", 1)
    sizes = spark.createDataFrame([("a", 1, 100), ("a", 3, 10)], "stratum string, size int, n long")
    with pytest.raises(ValueError):
        mixing.balanced(wanted(spark, [(1, 0, "a", 65.0, 65, 1, 0, 110)]), sizes, ["run_id", "stratum_idx"], "stratum", "share", "max_repeats")


def mixed(spark, records, want, goal="target", size=None):
    sizes = records.where("n is not null and stratum is not null").groupBy("stratum", F.lit(1).alias("size") if size is None else F.col(size).alias("size")).agg(F.count("*").alias("n"))
    solved = mixing.balanced(wanted(spark, want), sizes, ["run_id", "stratum_idx"], "stratum", goal, "max_repeats")
    return mixing.mixture(records, "n", "stratum", solved, sizes, ["run_id", "stratum_idx"], "max_repeats", "seed", size)


def test_copies_add_up_to_the_targets(spark):
    records = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(300)] + [(900, None), (None, "a")], "n long, stratum string")
    want = [(1, 0, "a", 130.0, 130, 1, 7, 200), (1, 1, "b", 250.0, 250, 4, 8, 100), (2, 0, "b", 300.0, 300, 2, 9, 100), (2, 1, "a", 0.0, 0, 2, 9, 200), (3, 0, "a", 400.0, 400, 2, 9, 200), (4, 0, "b", 500.0, 500, 5, 1, 100)]
    total, most = {}, {}
    for r in mixed(spark, records, want).collect():
        key = (r.run_id, r.stratum_idx)
        total[key] = total.get(key, 0) + r.copies
        most[key] = max(most.get(key, 0), r.copies)
    assert total == {(1, 0): 130, (1, 1): 250, (2, 0): 200, (3, 0): 400, (4, 0): 500}
    assert most == {(1, 0): 1, (1, 1): 3, (2, 0): 2, (3, 0): 2, (4, 0): 5}


def test_records_with_sizes_fill_the_mass(spark):
    rows = [(i, "a", 1 + i * i % 7) for i in range(600)]
    records = spark.createDataFrame(rows, "n long, stratum string, tokens int")
    mass, most = sum(r[2] for r in rows), {}
    for share, cap in ((mass * 0.3, 4), (mass * 1.7, 4), (mass * 4.0, 4)):
        got = mixed(spark, records, [(1, 0, "a", share, 0, cap, 5, 0)], "share", "tokens").collect()
        assert abs(sum(r.tokens * r.copies for r in got) - share) <= 7
        assert max(r.copies for r in got) <= cap
        for r in got:
            most.setdefault((share, r.tokens), set()).add(r.copies)
    assert all(max(c) - min(c) <= 1 for c in most.values())


def test_quotas_follow_the_weights(spark):
    strata = spark.createDataFrame([(1, 0, "a", 5.0), (1, 1, "b", 2.0), (1, 2, "c", None), (2, 0, "a", 0.0), (3, 0, "a", 1.0), (3, 1, "b", 1.0), (3, 2, "c", 1.0)], "run_id long, stratum_idx int, stratum string, weight double").selectExpr("*", "1L as target", "1L as kept")
    runs = spark.createDataFrame([(1, 70, None), (2, 10, None), (3, 10, None)], "run_id long, target_n long, total_written long")
    got = {(r.run_id, r.stratum_idx): r.target for r in mixing.quotas(strata, runs).collect()}
    assert got == {(1, 0): 50, (1, 1): 20, (1, 2): 0, (2, 0): 0, (3, 0): 4, (3, 1): 3, (3, 2): 3}


def test_more_runs_than_stand_in_one_plan(spark, monkeypatch):
    monkeypatch.setattr(reservoir, "RUNS_AT_ONCE", 3)
    runs = spark.range(8).selectExpr("id as run_id", "id as seed", "4L as target_n")
    got = reservoir.fixed_size(spark.range(50).withColumnRenamed("id", "n"), "n", runs).groupBy("run_id").count().collect()
    assert {r["count"] for r in got} == {4} and len(got) == 8


CLASHES = ("_hi", "_lo", "_k0", "_k", "_b", "_in", "_row", "_number", "_seed", "_rate", "_cut", "_base", "_extra", "_halvings", "_source", "run_id", "stratum_idx", "copies", "target_n", "seed", "a.b")


def test_columns_of_any_name_come_through(spark):
    extra = [F.lit("x").alias(c) for c in CLASHES]
    records = spark.range(50).select(F.col("id").alias("n"), F.lit("a").alias("stratum"), *extra)
    runs = spark.createDataFrame([(1, 3, 20)], "run_id long, seed long, target_n long")
    got = reservoir.fixed_size(records, "n", runs)
    assert got.count() == 20 and set(got.columns) == {"n", "stratum", *CLASHES}
    assert {r["_hi"] + r["a.b"] for r in got.collect()} == {"xx"}
    sampled = feistel.sample(records.drop("seed").withColumn("seed", F.lit(1).cast("long")).withColumn("sample_rate", F.lit(1.0)), "n")
    assert sampled.count() == 50 and set(sampled.columns) == {"n", "stratum", "sample_rate", *CLASHES}
    got = mixed(spark, records, [(1, 0, "a", 70.0, 70, 2, 7, 50)])
    assert set(got.columns) == {"n", "stratum", *CLASHES} and sum(r.copies for r in got.collect()) == 70


random.seed(0)
