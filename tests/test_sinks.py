import json

from grammarlens import sinks
from grammarlens.operators import rejects
from grammarlens.sources import lists


def test_lists_and_shards(spark, tmp_path):
    df = spark.createDataFrame([(f"u:{i}", i) for i in range(10)] + [(None, 99)], "uri string, ord long")
    assert sinks.write_list(df, str(tmp_path / "list")) == 10
    twice = df.unionByName(df.selectExpr("uri", "ord + 100 as ord"))
    assert sinks.write_list(twice, str(tmp_path / "once"), distinct_by=["ord"]) == 10
    assert [r.value for r in spark.read.text(str(tmp_path / "once"), wholetext=True).collect()] == ["".join(f"u:{i}\n" for i in range(10))] or len(list((tmp_path / "once").glob("*.txt"))) > 1
    assert sorted(r.uri for r in lists.read_list(spark, [str(tmp_path / "list")]).collect()) == sorted(f"u:{i}" for i in range(10))
    sinks.write_shards(df.where("uri is not null"), str(tmp_path / "shards"), 3, ["ord"])
    got = {r.value: r.shard for r in spark.read.text(str(tmp_path / "shards")).collect()}
    assert got == {f"u:{i}": i % 3 for i in range(10)}


def test_certificates_come_back(spark, tmp_path):
    sinks.write_certificates(spark.createDataFrame([(bytearray(b"\x30\x01a"),), (None,)], "der binary"), str(tmp_path / "certs"))
    back = rejects.load_certs(spark.read.text(str(tmp_path / "certs")).selectExpr("1L as row_id", "value as cert_line")).collect()
    assert [bytes(r.der) for r in back] == [b"\x30\x01a"]


def test_documents(spark):
    counted = spark.createDataFrame([("g", "g:b#2", 2), ("g", "g:a#1", 1)], "grammar string, node_id string, hits long")
    totals = spark.createDataFrame([("g", 5), ("h", 0)], "grammar string, total_samples long")
    got = {r.grammar: json.loads(r.document) for r in sinks.hits_documents(counted, totals).collect()}
    assert got["g"] == {"schema_version": 1, "grammar": "g", "total_samples": 5, "hits": {"g:a#1": 1, "g:b#2": 2}} and list(got["g"]["hits"]) == ["g:a#1", "g:b#2"]
    assert got["h"]["hits"] == {}
