import numpy as np

from grammarlens.llm import packing


def test_the_curve_visits_every_cell_and_moves_to_neighbours():
    cells = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8)])
    place = packing.hilbert(cells, 3)
    assert sorted(place) == list(range(512))
    assert np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1).max() == 1


def pack(spark, rows, capacity=100):
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>").selectExpr("*", "1 as n", "2 as place").repartition(3)
    return packing.packed(df, capacity)


def test_everything_is_packed_and_nothing_is_cut_without_need(spark):
    rng = np.random.default_rng(4)
    sizes = [0, 0, 1, 99, 100, 101, 200, 250, *rng.integers(1, 120, 800).tolist()]
    rows = [(i, rng.integers(0, 50_000, n).tolist()) for i, n in enumerate(sizes)] + [(900, None), (3, [7] * 99)]
    got = pack(spark, rows).collect()
    room = {}
    for r in got:
        room[r.container_id] = room.get(r.container_id, 0) + r.n_tokens
    assert max(room.values()) <= 100
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, n in enumerate(sizes):
        own = sorted(pieces[i], key=lambda r: r.piece_no)
        times = 2 if i == 3 else 1
        assert sum(r.n_tokens for r in own) == n * times
        assert len(own) == times * max(1, -(-n // 100))
        if times == 1:
            assert [r.first_token for r in own] == [100 * k for k in range(len(own))]
    assert pieces[900][0].n_tokens == 0
    assert 1 - sum(room.values()) / (100 * len(room)) < 0.15


def test_very_many_copies(spark):
    got = packing.usage(pack(spark, [(i, [5] * 30) for i in range(4000)]), 100).collect()[0]
    assert got.tokens == 120_000 and got.unused_share < 0.12


def test_nothing(spark):
    assert pack(spark, []).count() == 0
    assert packing.usage(pack(spark, []), 100).collect()[0].containers == 0


def test_neighbours_on_the_curve_share_containers(spark):
    rng = np.random.default_rng(1)
    topics = [rng.integers(0, 50_000, 40) for _ in range(4)]
    rows = [(i, rng.choice(topics[i % 4], 30).tolist()) for i in range(1200)]
    got = pack(spark, rows).toPandas()
    mixed = got.assign(topic=got.doc_id % 4).groupby("container_id").topic.nunique()
    assert (mixed == 1).mean() > 0.25  # by chance, about 0.05
