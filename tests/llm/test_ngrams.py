import random

from grammarlens.llm import ngrams


def brute(records, longest):
    count, where = {}, {}
    for no, terms in enumerate(records):
        terms = [t for t in terms or () if t is not None]
        for i in range(len(terms)):
            for n in range(1, longest + 1):
                if i + n <= len(terms):
                    g = tuple(terms[i : i + n])
                    count[g] = count.get(g, 0) + 1
                    where.setdefault(g, set()).add(no)
    return {(g, n, len(where[g])) for g, n in count.items()}


def got(spark, records, longest, upto=None):
    df = spark.createDataFrame([(r, 1) for r in records], "terms array<string>, t0 int").repartition(3)
    return {(tuple(r.gram), r.occurrences, r.records) for r in ngrams.counted(df, "terms", longest, upto).collect()}


def test_against_brute_force(spark):
    rng = random.Random(2)
    records = [rng.choices(["hot", "hot", "a", "b", "c", "d"], k=rng.randint(0, 12)) for _ in range(300)] + [None, [], [None], ["a", None, "b"], ["x" * 50_000], ["a"] * 500]
    for longest in (1, 2, 4):
        assert got(spark, records, longest) == brute(records, longest)
    assert got(spark, records, 3, 2) == brute(records, 2)


def test_small_batches_and_many_parts(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "POSITIONS", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    try:
        rng = random.Random(3)
        records = [rng.choices(["hot"] * 9 + ["a", "b", ""], k=rng.randint(0, 9)) for _ in range(400)]
        assert got(spark, records, 3) == brute(records, 3)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_nothing(spark):
    assert got(spark, [None, []], 2) == set()


def test_marks_at_the_limits(spark):
    grams = spark.createDataFrame([("rare", 1), ("two", 2), ("ninety", 900), ("common", 901)], "g string, records long")
    assert {r.g: r.mark for r in ngrams.marked(grams, 1000).collect()} == {"rare": "rare", "two": None, "ninety": None, "common": "common"}
