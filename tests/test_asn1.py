import pytest

from grammarlens.operators import der, hits, prune
from grammarlens.sources import abnf, asn1

MODULE = """M DEFINITIONS ::= BEGIN
IMPORTS X FROM Y;
Top ::= SEQUENCE { -- a comment
  id [0] EXPLICIT Id DEFAULT one,
  name Name,
  old [1] IMPLICIT Id OPTIONAL,
  any ANY DEFINED BY id OPTIONAL }
Id ::= INTEGER { one(1), two(2) } (1..5)
Name ::= CHOICE { a UTF8String (SIZE (1..9)), b PrintableString }
Many ::= SET SIZE (1..2) OF Name
END"""


def value(tag, content):
    return bytes([tag, len(content)]) + content


def test_nodes_of_the_certificate_types():
    listed = abnf.listed("rfc5280-x509", asn1.rules(asn1.vendored()))
    assert len(listed) == 113
    kinds = [kind for _, kind, _ in listed]
    assert {k: kinds.count(k) for k in ("rule", "named-type", "reference", "terminal", "sequence", "optional", "string-type", "tag", "alternation", "repetition")} == {"rule": 18, "named-type": 32, "reference": 22, "terminal": 13, "sequence": 7, "optional": 6, "string-type": 5, "tag": 4, "alternation": 3, "repetition": 3}


@pytest.mark.parametrize("text", ["BEGIN END", "no module", "BEGIN A ::= END", "BEGIN A ::= SEQUENCE { x INTEGER", "BEGIN A INTEGER END", "BEGIN A ::= NULL A ::= NULL END", "BEGIN A ::= [1 NULL END"])
def test_broken_modules(text):
    with pytest.raises(ValueError):
        asn1.rules(text)


def names(found):
    known = {n: (kind, name) for n, kind, name in abnf.listed("m", asn1.rules(MODULE))}
    return None if found is None else {known[x] for x in found}


def test_walking_is_lenient():
    walk = lambda der_: names(der.Typed("m", asn1.rules(MODULE)).visited(der_))
    whole = walk(value(0x30, value(0xA0, value(2, b"\x01")) + value(12, b"x") + value(0x81, b"\x07") + value(5, b"")))
    assert {("tag", "[0] EXPLICIT"), ("string-type", "UTF8String"), ("tag", "[1] IMPLICIT"), ("terminal", "ANY"), ("reference", "Id"), ("rule", "Top"), ("rule", "Id")} <= whole
    odd = walk(value(0x30, value(4, b"x") + value(0x81, b"\x07")))  # the choice takes any value
    assert ("alternation", "CHOICE") in odd and not any(k == "string-type" for k, _ in odd) and ("tag", "[1] IMPLICIT") in odd
    assert walk(value(0x31, b"")) is None and walk(value(0x30, b"") + b"!") is None and walk(b"") is None and walk(None) is None
    assert walk(value(0x30, b"")) == {("rule", "Top"), ("sequence", "SEQUENCE")}


def test_hits_of_certificates(spark):
    df = spark.createDataFrame([(1, bytearray(value(0x30, value(12, b"x")))), (2, None), (3, bytearray(b"no"))], "row_id long, der binary")
    walked = der.walked(df, typed=("m", MODULE)).selectExpr("*", "'m' as grammar")
    assert hits.totals(walked).collect()[0][1:] == (3, 1)
    assert hits.hits(walked).count() == 8


def test_verdicts_on_values(spark):
    typed = der.Typed("m", asn1.rules(MODULE))
    good, long = value(0x30, value(0xA0, value(2, b"\x01")) + value(12, b"x") + value(5, b"")), b"\x30\x82\x01\x00" + b"\0" * 256
    order = typed.order(good)
    assert order[-1] == abnf.node_id("m", "Top", "Top") and set(order) == set(typed.visited(good))
    first = names(order[:1])
    assert first == {("terminal", "INTEGER")}
    pruned = spark.createDataFrame([(order[0],), (order[-1],), ("x:y#00000000",)], "node_id string")
    df = spark.createDataFrame([(1, bytearray(good), 7), (2, None, 7), (3, bytearray(b"no"), 7), (4, bytearray(long), 7)], "row_id long, der binary, x int").withColumnRenamed("x", "a.b")
    got = {r.row_id: (r.error, r.bound, r.node_id) for r in der.verdicts(df, "m", MODULE, pruned, most_bytes=200).collect()}
    assert got == {1: ("UNSUPPORTED_NODE", None, order[0]), 2: ("MALFORMED", None, None), 3: ("MALFORMED", None, None), 4: ("BOUNDS_EXCEEDED", "input_bytes", None)}
    assert {r.row_id: r.error for r in der.verdicts(df, "m", MODULE, pruned.where("false"), deepest=3).collect()}[1] == "BOUNDS_EXCEEDED"
    assert {r.row_id for r in der.verdicts(df, "m", MODULE, pruned.where("false")).where("accepted").collect()} == {1, 4}


def test_writing_types(spark):
    nodes, edges = abnf.graph(spark, "m", asn1.rules(MODULE))
    every = [r.asDict() for r in nodes.collect()], [r.asDict() for r in edges.collect()]
    dropped = {n["node_id"] for n in every[0] if n["name"] in ("[1] IMPLICIT", "PrintableString")}
    assert prune.written(*every, dropped, asn1=True) == (
        "Top ::= SEQUENCE { id [0] EXPLICIT Id OPTIONAL, name Name, any ANY OPTIONAL }\nId ::= INTEGER\nName ::= CHOICE { a UTF8String }\nMany ::= SET OF Name\n"
    )
