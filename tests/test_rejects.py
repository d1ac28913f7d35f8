import base64

import pytest

from grammarlens.operators import rejects as R

GOOD = "(1,2,'http://a.example/x','http://example.a./x','http://example.a./x')"


@pytest.mark.parametrize(
    ("row", "reason"),
    [
        (GOOD, None),
        (f" {GOOD} ;\r\n", None),
        ("( 1 , 2 , 'a:b' , NULL , null ),", None),
        ("(1,2,'a:it\\'s','x','y')", None),
        ("(1,2,'a:b','x','" + "\\'" * 60 + "')", None),
        ("(1,2,'a:b','x','" + "\\'" * 61 + "')", "value"),
        ("(1,2,'a:b','x','y", "quoting"),
        ("(1,2,'a:b'z,'x','y')", "quoting"),
        ("(1,2,a:b','x','y')", "quoting"),
        ("(1,2,'a:b''c','x','y')", "quoting"),
        ("(1,2,'a:b','x')", "columns"),
        ("(1,2,'a:b','x','y',6)", "columns"),
        ("(1,2,'a:b','x','y'),(1,2,'a:b','x','y')", "columns"),
        ("(1,2,'a:b','x','y'),,", "columns"),
        ("1,2,'a:b','x','y')", "columns"),
        ("(1,2,'a:b','x','y'", "columns"),
        ("(1,2,'a:b','x','y';", "columns"),
        ("(1,2,'a:b','x','y' , ", "columns"),
        ("(1,2,'a:b','x','y'x;", "quoting"),
        ("(1,2,'a:b';,'x','y')", "quoting"),
        ("", "columns"),
        (None, "columns"),
        ("   ", "columns"),
        ("(4294967296,2,'a:b','x','y')", "value"),
        ("(4294967295,0,'a:b','x','y')", None),
        ("('1',2,'a:b','x','y')", "value"),
        ("(١,2,'a:b','x','y')", "value"),
        ("(1,-2,'a:b','x','y')", "value"),
        ("(1,2,NULL,'x','y')", "value"),
        ("(1,2,'1a:b','x','y')", "value"),
        ("(1,2,'//a','x','y')", "value"),
        ("(1,2,'a:b',nil,'y')", "value"),
        ("(1,2,'a:b','x',7)", "value"),
    ],
)
def test_one_tuple(row, reason):
    assert R.read_link(row).get("reason") == reason


def test_blocks_are_bisected_down_to_the_broken_rows(spark):
    rows = [(i, GOOD.replace("(1,", f"({i},")) for i in range(5000)]
    rows[7] = (7, "(7,2,'a:b")
    rows[4001] = (4001, "(4001,2,'a:b','x')")
    df = spark.createDataFrame(rows, "row_id long, raw_tuple string").selectExpr("*", "'other' as url", "1 as reason").coalesce(1)
    got = R.load_links(df)
    assert {(r.row_id, r.reason) for r in R.rejects(got, "t").collect()} == {(7, "quoting"), (4001, "columns")}
    assert got.where("reason is null and el_id = row_id and url = 'http://a.example/x'").count() == 4998


def test_blocks_agree_with_the_strict_reader(spark):
    rows = [(i, x) for i, x in enumerate([GOOD, "(1,2,'a:\\n','x','y')", "( 1,2,'a:b',NULL,NULL)", GOOD * 2, "x", None, "(1,2,'a:" + "z" * 100_000 + "','x','y')"] * 3)]
    got = {r.row_id: r for r in R.load_links(spark.createDataFrame(rows, "row_id long, raw_tuple string")).collect()}
    for i, x in rows:
        want = R.read_link(x)
        assert (got[i].reason, got[i].url, got[i].el_id) == (want.get("reason"), want.get("url"), want.get("el_id"))


def der(content: bytes, tag: int = 0x30) -> bytes:
    n = len(content)
    return bytes([tag]) + (bytes([n]) if n < 128 else b"\x82" + n.to_bytes(2, "big")) + content


def test_certificates(spark):
    text = lambda b: base64.b64encode(b).decode()
    rows = [(1, text(der(b"abc"))), (2, text(der(b"x" * 300))), (3, text(der(b"abc") + b"!")), (4, text(der(b"abc", 0x31))), (5, "MA=A"), (6, text(der(b"abc"))[:-1]), (7, None), (8, "  "), (9, " # note"), (10, " " + text(der(b"")) + "\t"), (11, text(b"\x30\x80\x00\x00")), (12, "-----BEGIN CERTIFICATE-----"), (13, "MA AA"), (14, text(der(b"abc")))]
    got = {r.row_id: (r.reason, r.der) for r in R.load_certs(spark.createDataFrame(rows, "row_id long, cert_line string")).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: None, 2: None, 3: "value", 4: "value", 5: "encoding", 6: "encoding", 10: None, 11: "value", 12: "encoding", 13: "encoding", 14: None}
    assert bytes(got[2][1]) == der(b"x" * 300)


def test_empty_tables(spark):
    assert R.load_links(spark.createDataFrame([], "row_id long, raw_tuple string")).count() == 0
    assert R.load_certs(spark.createDataFrame([], "row_id long, cert_line string")).count() == 0
