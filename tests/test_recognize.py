import re

from grammarlens.operators import recognize
from grammarlens.sources import abnf

URIS = ["http://a.example/b?c#d", "mailto:x@y", "http://[::1]:80/", "http://u:p@1.2.3.4/%41/", "urn:x:y", "file:///etc", "x:", "http://h/" + "%41b/" * 1500, "http://[v1.a:b]/?/?#/?", "ftp://1.2.3.4.com"]
WRONG = ["", "a b", "//x", "http://a/%zz", "1:x", "#x"]


def test_nodes_that_a_uri_uses():
    r = recognize.Recognizer("rfc3986-uri", abnf.vendored())
    rules = {n: name for n, kind, name in abnf.listed("rfc3986-uri", abnf.vendored()) if kind == "rule"}
    used = {u: {rules[n] for n in r.nodes(r.mask(u)) if n in rules} for u in URIS}
    assert all(r.mask(w) is None for w in WRONG)
    for u in URIS:
        assert "URI" in used[u] and "scheme" in used[u]
        assert ("fragment" in used[u]) == ("#" in u)
        assert ("query" in used[u]) == ("?" in u.partition("#")[0])
        assert ("pct-encoded" in used[u]) == ("%" in u)
        assert ("authority" in used[u]) == bool(re.match("[^:]+://", u))
        assert ("IP-literal" in used[u]) == ("[" in u)
        assert ("userinfo" in used[u]) == ("u:p@" in u)
    assert "IPv4address" in used["http://u:p@1.2.3.4/%41/"] and "reg-name" in used["ftp://1.2.3.4.com"]
    assert "IPv4address" not in used["ftp://1.2.3.4.com"]
    assert "path-empty" in used["x:"] and "path-rootless" in used["urn:x:y"] and "path-absolute" not in used["urn:x:y"]


def test_ambiguous_repeats_are_cut_in_order():
    r = recognize.Recognizer("g", 'top = *( "a" / "ab" / "b" ) "c"\n')
    nodes = {n: name for n, kind, name in abnf.listed("g", 'top = *( "a" / "ab" / "b" ) "c"\n') if kind == "terminal"}
    assert {nodes[n] for n in r.nodes(r.mask("abc")) if n in nodes} == {'"a"', '"b"', '"c"'}
    assert r.mask("ab") is None


def test_counts(spark):
    rows = [(u, i % 2) for i, u in enumerate(URIS + WRONG + URIS[:1])] + [(None, 0), ("http://h/" + "x" * 9000, 0)]
    df = spark.createDataFrame(rows, "uri string, half int")
    got = recognize.counted(df, "uri", "rfc3986-uri", abnf.vendored()).collect()
    total = next(r for r in got if r.node_id is None)
    assert (total.total_samples, total.hits) == (len(URIS + WRONG) + 2, len(URIS) + 1)
    assert next(r.hits for r in got if r.node_id == "rfc3986-uri:URI#4c4da3ed") == len(URIS) + 1
    by_half = recognize.counted(df, "uri", "rfc3986-uri", abnf.vendored(), ["half"]).collect()
    assert sum(r.hits for r in by_half if r.node_id == "rfc3986-uri:fragment#ae36814a") == sum("#" in u for u in URIS + URIS[:1])
    assert recognize.counted(df.where("false"), "uri", "rfc3986-uri", abnf.vendored()).count() == 0


def test_nodes_in_the_order_in_which_they_are_entered():
    text = 'top = [ "x" ":" ] 1*( item / "-" )\nitem = "a" / "b"\n'
    r = recognize.Recognizer("g", text)
    kinds = {n: (kind, name) for n, kind, name in abnf.listed("g", text)}
    assert [kinds[n][1] for n in r.order("a-") if kinds[n][0] in ("rule", "terminal")] == ["top", "item", '"a"', '"-"']
    assert [kinds[n][1] for n in r.order("x:b") if kinds[n][0] == "terminal"] == ['"x"', '":"', '"b"'] and r.order("y") is None
    for t in ("a-", "x:b", "a" * 50, "x:-a-b"):
        order = r.order(t)
        assert r.entered(r.root, t) == len(order) and set(order) == set(r.nodes(r.mask(t)))
        for wanted in range(1, 1 << len(r.ids), 37):
            last = next((n for n in reversed(order) if wanted >> r.ids.index(n) & 1), None)
            bit = r.last_of(wanted, r.root, t)
            assert (r.ids[bit.bit_length() - 1] if bit else None) == last


def test_verdicts_on_texts(spark):
    g = "rfc3986-uri"
    rule = {name: n for n, kind, name in abnf.listed(g, abnf.vendored()) if kind == "rule"}
    pruned = spark.createDataFrame([(rule["userinfo"],), (rule["fragment"],), ("other:x#00000000",)], "node_id string")
    want = {
        "http://a/b?c": (True, None, None, None),
        "http://u@a/": (False, "UNSUPPORTED_NODE", None, rule["userinfo"]),
        "http://u@a/#f": (False, "UNSUPPORTED_NODE", None, rule["fragment"]),
        "//a": (False, "MALFORMED", None, None),
        "http://h/" + "x" * 9000: (False, "BOUNDS_EXCEEDED", "input_bytes", None),
        "http://h/" + "x" * 8000: (False, "BOUNDS_EXCEEDED", "depth", None),
        None: (False, "MALFORMED", None, None),
        "": (False, "MALFORMED", None, None),
    }
    df = spark.createDataFrame([(u, 1, "x") for u in want], "uri string, node_id int, x string").withColumnRenamed("x", "a.b")
    got = recognize.verdicts(df, "uri", g, abnf.vendored(), pruned)
    assert {r.uri: (r.accepted, r.error, r.bound, r.node_id) for r in got.collect()} == want and got.columns[:2] == ["uri", "a.b"]
    assert recognize.verdicts(df.where("false"), "uri", g, abnf.vendored(), pruned).count() == 0


def test_skipped_texts_are_counted(spark):
    df = spark.createDataFrame([("http://h/" + "é" * n,) for n in (10, 4000, 5000, 9000)] + [("x:",), (None,)], "uri string")
    total = recognize.counted(df, "uri", "g", abnf.vendored()).where("node_id is null").collect()[0]
    assert (total.total_samples, total.hits, total.skipped) == (4, 1, 2)
    assert recognize.counted(df, "uri", "g", abnf.vendored(), most_bytes=None).where("node_id is null").collect()[0].total_samples == 6
