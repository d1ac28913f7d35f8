import hashlib

from pyspark.sql import functions as F

from grammarlens.functions import ident
from grammarlens.functions import uri as U


def test_normalising_strips_before_it_deletes(spark):
    rows = [(" http://a ", "http://a"), ("\x00 http://x", " http://x"), ("a\tb\x85c", "abc"), ("\u3000", None), ("", None), (None, None), ("\x01", None), ("é ", "é")]
    df = spark.createDataFrame(rows, "raw string, want string")
    assert [(r.got, r.want) for r in df.select(U.normalized(F.col("raw")).alias("got"), "want").collect() if r.got != r.want] == []


def test_normalising_takes_line_ends_off(spark):
    ends = ["\n", "\r", "\r\n", "\x85", "\u2028", "\u2029", "\n\n"]
    df = spark.createDataFrame([("http://a/x" + e,) for e in ["", *ends]] + [("\n",)], "raw string")
    assert [r.got for r in df.select(U.normalized(F.col("raw")).alias("got")).collect()] == ["http://a/x"] * 8 + [None]


def test_hosts(spark):
    rows = [("http://a.b/c", "a.b"), ("http://u:p@h:80/", "h"), ("http://[::1]/", None), ("mailto:x@y", None), ("x://y?z", "y"), ("http://a@b@c/", "c"), ("http:///x", None), (None, None), ("a://b://c", "b")]
    df = spark.createDataFrame(rows, "u string, want string")
    assert [(r.u, r.got) for r in df.select("u", "want", U.host(F.col("u")).alias("got")).collect() if r.got != r.want] == []


def test_registrable_domains(spark):
    rules = U.suffix_rules(spark.createDataFrame([(x,) for x in ("// list", "", "com", "uk", "co.uk", "io", "github.io", "*.ck", "!www.ck")], "value string"))
    want = {"a.b.example.co.uk": "example.co.uk", "foo.bar.github.io": "bar.github.io", "host.example.zzz": "example.zzz", "co.uk": None, "x.y.ck": "x.y.ck", "a.www.ck": "www.ck", "Example.COM.": "example.com", "a..b": None, "com": None, "192.0.2.1": "2.1"}
    got = U.registrable_domains(spark.createDataFrame([(h,) for h in [*want, None, "a..b"]], "host string"), rules)
    assert {r.host: r.domain for r in got.collect()} == want


def test_fraction_is_blake2b(spark):
    df = spark.createDataFrame([("http://example.com/",), (None,), ("é",)], "v string").select("v", ident.fraction(F.col("v"), 0).alias("x"))
    got = {r.v: r.x for r in df.collect()}
    assert got["http://example.com/"] == 0.5230959796080469
    assert got["é"] == int.from_bytes(hashlib.blake2b("0:é".encode(), digest_size=8).digest(), "big") / 2**64
    assert got[None] is None


def test_entries_of_a_log(spark):
    cert = b"\x30\x03abc"
    head = b"\x00\x00" + b"\x00" * 8
    size = len(cert).to_bytes(3, "big")
    rows = [(head + b"\x00\x00" + size + cert, b"", cert), (head + b"\x00\x01", size + cert, cert), (head + b"\x00\x02", size + cert, None), (head + b"\x00\x00" + size + cert[:-1], b"", None), (b"\x00", b"", None), (head + b"\x00\x00\x00\x00\x00", b"", None), (None, None, None)]
    df = spark.createDataFrame([(bytearray(a) if a is not None else None, bytearray(b) if b is not None else None, w) for a, b, w in rows], "a binary, b binary, want binary")
    for r in df.select(ident.certificate_of_entry(F.col("a"), F.col("b")).alias("got"), "want").collect():
        assert r.got == r.want


def test_domains_stay_beside_all_other_columns(spark):
    rules = U.suffix_rules(spark.createDataFrame([("com",), ("*.ck",)], "value string"))
    df = spark.createDataFrame([("a.b.com", 1, "x"), (None, 2, "y"), ("a.b.com", 3, "z")], "host string, n int, domain string").withColumnRenamed("n", "a.b")
    got = U.with_domain(df, rules)
    assert sorted((r["a.b"], r.domain) for r in got.collect()) == [(1, "b.com"), (2, None), (3, "b.com")]
    assert U.with_domain(df, rules.where("false")).where("domain = 'b.com'").count() == 2
    assert U.with_domain(df.where("false"), rules).count() == 0
