import hashlib

import pyspark.sql.functions as F

from grammarlens.functions import ident
from grammarlens.operators import dedup, der, evidence, hits, sampling
from grammarlens.sources import lists


def test_cap_keeps_the_first_of_each_domain(spark):
    rows = [(f"d{i % 3}", f"u{i % 200}", i) for i in range(1000)] + [(None, f"m{i % 10}", i) for i in range(50)]
    got = dedup.capped(spark.createDataFrame(rows, "domain string, uri string, ord long"), "domain", "uri", ["ord"], 5)
    want = {}
    for d, u, _ in rows:
        if u not in want.setdefault(d or "", []):
            want[d or ""].append(u)
    assert {(r.domain, r.uri) for r in got.collect()} == {(d, u) for d, us in want.items() for u in (us[:5] if d else us)}
    assert dedup.capped(spark.createDataFrame(rows, "domain string, uri string, ord long"), "domain", "uri", ["ord"], None).count() == sum(map(len, want.values()))


def test_quotas(spark):
    def of(weights, target):
        df = spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], "i int, w double")
        return [r.quota for r in sampling.quotas(df, "w", target, "i").orderBy("i").collect()]

    assert of([0.7, 0.2, 0.1], 100) == [70, 20, 10]
    assert of([1, 1, 1], 10) == [4, 3, 3]
    assert of([0, 0], 10) == [0, 0]


def test_bottom_k_prefers_the_larger_uri_in_a_tie(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", 5, "q")], "s string, h long, uri string")
    quota = spark.createDataFrame([("a", 2), ("b", 3)], "s string, quota long")
    assert {(r.s, r.uri) for r in sampling.bottom_k(rows, ["s"], "h", "uri", quota, 3).collect()} == {("a", "x"), ("a", "z"), ("b", "q")}


def test_strata_have_seeds_of_their_own(spark):
    uris = [f"http://h/{i}" for i in range(200)]
    rows = spark.createDataFrame([(s, u) for s in "abc" for u in uris], "stratum string, uri string")
    quota = spark.createDataFrame([("b", 40), ("a", 60), ("c", 0), ("d", 5)], "stratum string, quota long")
    hashed = lambda u, s: int.from_bytes(hashlib.blake2b(f"{s}:{u}".encode(), digest_size=8).digest(), "big") / 2**64
    want, shared = {}, 0
    for i, (s, n) in enumerate([("a", 60), ("b", 40)]):
        for u in sorted(uris, key=lambda u: hashed(u, 17 + i))[:n]:
            shared += u in want
            want.setdefault(u, (s, hashed(u, 17 + i)))
    assert {r.uri: (r.stratum, r.rank_by) for r in sampling.stratified(rows, quota, 17, 60).collect()} == want
    # With one seed all 40 would be among the 60.
    assert shared < 40


def test_numbers_follow_the_order_over_all_tasks(spark):
    rows = spark.range(10_000).select((F.col("id") * 7919 % 10_007).alias("k")).repartition(7)
    got = sampling.sharded(sampling.numbered(rows, ["k"]), 3).orderBy("number").collect()
    assert [r.number for r in got] == list(range(10_000))
    assert [r.k for r in got] == sorted(r.k for r in got)
    assert all(r.shard == r.number % 3 for r in got)


SAMPLES = [(1, "g", True, ["a", "b", "a"]), (2, "g", False, ["a"]), (3, "g", True, None), (4, "g", None, ["b"]), (5, "g", True, ["b", None])]


def test_hits_count_matched_samples_once(spark):
    df = spark.createDataFrame(SAMPLES, "sample_id long, grammar string, is_matched boolean, visited array<string>")
    assert {(r.node_id, r.hits) for r in hits.hits(df).collect()} == {("a", 1), ("b", 2)}
    assert hits.totals(df).collect()[0][1:] == (5, 3)
    parts = hits.hits(df.withColumn("shard", F.col("sample_id") % 2), ["shard"])
    assert {(r.node_id, r.hits) for r in hits.merged(parts).collect()} == {("a", 1), ("b", 2)}


def test_verdicts_name_the_first_pruned_node(spark):
    df = spark.createDataFrame(SAMPLES, "sample_id long, grammar string, is_matched boolean, visited array<string>")
    got = evidence.verdicts(df, spark.createDataFrame([("b",)], "node_id string"))
    assert {r.sample_id: (r.accepted, r.error, r.node_id) for r in got.collect()} == {1: (False, "UNSUPPORTED_NODE", "b"), 2: (False, "MALFORMED", None), 3: (True, None, None), 4: (False, "MALFORMED", None), 5: (False, "UNSUPPORTED_NODE", "b")}


def test_restorable(spark):
    pruned = spark.createDataFrame([("g", "a"), ("g", "b")], "grammar string, node_id string")
    found = spark.createDataFrame([("g", "a", 5), ("g", "c", 9)], "grammar string, node_id string, hits long")
    total = spark.createDataFrame([("g", 1000)], "grammar string, total_samples long")
    assert [r.node_id for r in evidence.restorable(pruned, found, total, 0.001).collect()] == ["a"]
    assert evidence.restorable(pruned, found, total, 0.01).count() == 0


def test_der_places():
    assert der.places(b"\x30\x06\x02\x01\x05\x0c\x01a") == ["SEQUENCE", "SEQUENCE/INTEGER", "SEQUENCE/UTF8String"]
    assert der.places(b"\x30\x06\x02\x01\x05\x0c\x01a!") is None
    assert der.places(b"\x30\x80\x00\x00") is None
    assert der.places(b"\xa3\x02\x05\x00") == ["[3]", "[3]/NULL"]
    assert der.places(b"\x30\x00") == ["SEQUENCE"] and der.places(None) is None and der.places(b"") is None


def test_lists(spark):
    text = "# note\nhttp://a\r\n\n  b:c  \x85d:e"
    assert spark.range(1).select(lists.of_list(F.lit(text)).alias("x")).collect()[0].x == ["http://a", "b:c", "d:e"]
    warc = "WARC/1.0\r\nWARC-Target-URI: http://a/\r\nX: y\r\nwarc-target-uri:b:c \r\n"
    assert spark.range(1).select(lists.of_warc(F.lit(warc)).alias("x")).collect()[0].x == ["http://a/", "b:c"]
    wat = '{"Envelope":{"Payload-Metadata":{"HTTP-Response-Metadata":{"HTML-Metadata":{"Links":[{"url":"/x","path":"A"},{"url":""},{"path":"B"}]}}}}}'
    df = spark.createDataFrame([(wat,), ("{broken",), (None,), ("{}",)], "p string")
    assert [r.x for r in df.select(lists.of_wat(F.col("p")).alias("x")).collect()] == [["/x"], [], [], []]
    manifest = "a/subset=warc/1.parquet\na/subset=robotstxt/2.parquet\na/subset=warc/3.gz\na/subset=warc/4.parquet"
    assert lists.index_paths(manifest, limit=1, prefix="s3://b/") == ["s3://b/a/subset=warc/1.parquet"]


def test_index_reads_one_column(spark, tmp_path):
    spark.createDataFrame([("a", 1), (None, 2)], "url string, n int").write.parquet(str(tmp_path / "x"))
    df = lists.read_index(spark, [str(tmp_path / "x")])
    assert [r.uri for r in df.collect()] == ["a"]
    assert "n:int" not in df._jdf.queryExecution().toString().split("Physical")[1]


def test_one_delivery_of_each_sample(spark):
    rows = [(1, 10, 5), (1, 9, 5), (1, 8, 7), (2, 3, 1), (3, 4, 2), (3, 5, 1)]
    df = spark.createDataFrame(rows, "sample_id long, visit_row long, parsed_at int")
    for most in ("-1", "10MB"):  # without and with broadcasts
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
        assert {(r.sample_id, r.visit_row) for r in hits.once(df).collect()} == {(1, 9), (2, 3), (3, 5)}
    assert hits.once(df.where("false")).count() == 0


def evidence_tables(spark):
    found = spark.createDataFrame([(7, "g", "g:a#1", 3), (7, "g", "g:b#2", 1), (5, "g", "g:a#1", 2), (5, "g", "g:c#3", 2), (9, "g", "g:d#4", 1)], "submission_id long, grammar string, node_id string, hits long")
    total = spark.createDataFrame([(7, "g", 10), (5, "g", 4), (9, "g", 0)], "submission_id long, grammar string, total_samples long")
    pruned = spark.createDataFrame([("g", "g:a#1"), ("g", "g:c#3"), ("g", "g:d#4"), ("h", "g:b#2"), ("g", "g:a#1")], "grammar string, node_id string")
    return evidence.restorable(pruned, found, total, 0.3, ["submission_id"])


def test_evidence_restores_and_adds_rows_to_the_registry(spark):
    got = evidence_tables(spark)
    assert {(r.submission_id, r.node_id, r.hits, r.total_samples) for r in got.collect()} == {(7, "g:a#1", 3, 10), (5, "g:a#1", 2, 4), (5, "g:c#3", 2, 4)}
    submissions = spark.createDataFrame([(5, "ann", "We need it."), (7, "bob", None)], "submission_id long, submitter string, rationale string")
    existing = spark.createDataFrame([("g:c#3", False)], "node_id string, protected boolean")
    added = evidence.overrides(got, submissions, existing, 0.3).collect()
    assert [(r.node_id, r.protected, r.owner) for r in added] == [("g:a#1", True, "rfe:ann")]
    assert added[0].justification == "Evidence: We need it. Observed in 2 of 4 samples (50.0000%), at or above the threshold of 30.0000%."


def test_samples_of_runs_by_weight(spark):
    pool = spark.createDataFrame([(s, f"u{i}") for s in "abc" for i in range(300)], "stratum string, uri string")
    strata = [(1, 0, "a", 7, 50), (1, 1, "b", 7, 40), (1, 2, "none", 7, 9), (2, 0, "c", 1, 500), (2, 1, "a", 1, 0), (3, 0, "a", 7, 20)]
    table = spark.createDataFrame(strata, "run_id long, stratum_idx int, stratum string, seed long, quota long")
    rank = lambda uri, seed: int(hashlib.sha256(f"{seed}:{uri}".encode()).hexdigest()[:15], 16)
    want = set()
    for run, idx, stratum, seed, quota in strata:
        ranked = sorted((rank(f"u{i}", seed + idx), f"u{i}") for i in range(300)) if stratum in "abc" else []
        want |= {(run, idx, u) for _, u in ranked[:quota] if (run, 0, u) not in want or idx == 0}
    got = sampling.of_runs(pool, table, ident.rank_number)
    assert {(r.run_id, r.stratum_idx, r.uri) for r in got.collect()} == want
