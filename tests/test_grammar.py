import re

import pytest

from grammarlens.operators import hits, prune
from grammarlens.sources import abnf, asn1

G = "rfc3986-uri"


def test_node_ids_of_the_uri_grammar():
    nodes = {n: name for n, kind, name in abnf.listed(G, abnf.vendored()) if kind == "rule"}
    assert len(abnf.listed(G, abnf.vendored())) == 393
    for known in ("URI#4c4da3ed", "port#cdb4d14b", "userinfo#2bf7da71", "fragment#ae36814a", "pct-encoded#5b00e532", "IP-literal#615ca5b3", "IPv4address#d1e871a6", "IPv6address#1225d44b"):
        assert f"{G}:{known}" in nodes
    assert f"{G}:scheme#2093cace" in {n for n, _, _ in abnf.listed(G, abnf.vendored())}


@pytest.mark.parametrize("text", ["", "a = (b", "a = ", "a = b\na = c", "a =/ b", "a = b / ", "a = &", "a = 3", "a = b )"])
def test_broken_grammars(text):
    with pytest.raises(ValueError):
        abnf.rules(text)


def test_increments_comments_and_prose():
    got = abnf.rules('a = "x;y" ; note\n  / <p;q>\na =/ %x41-43 / 2*3b\nb = %d65.66')
    assert [c.name for c in got["a"].children] == ['"x;y"', "<p;q>", "%x41-43", "2*3(...)"]


@pytest.mark.parametrize(
    ("uri", "good"),
    [("http://a/b?c#d", True), ("mailto:x@y", True), ("http://[::1]:80/", True), ("http://[1:2:3:4:5:6:7:8]", True), ("http://[1::2::3]", False), ("http://1.2.3.4", True), ("urn:x:y", True), ("a b", False), ("//x", False), ("http://a/%zz", False), ("HTTP://U:p@h:1/", True), ("http://h:x/", False), ("x:", True), ("http://a/" + "%41b" * 2000, True), ("1:x", False), ("", False)],
)
def test_pattern(spark, uri, good):
    pattern = abnf.pattern(abnf.rules(abnf.vendored()), "URI")
    assert bool(re.fullmatch(pattern, uri)) is good
    df = spark.createDataFrame([(uri,)], "u string")
    assert df.where(df.u.rlike(f"^(?:{pattern})$")).count() == good


def test_recursive_grammars_have_no_pattern():
    with pytest.raises(ValueError):
        abnf.pattern(abnf.rules('a = "(" a ")" / "x"'), "a")


TEXT = 'top = [ rare "@" ] often\nrare = leaf "!" / other\nleaf = "l"\noften = "o" / "p"\nother = "q"\nalone = "z"\n'


def used(spark, counts, total=1000):
    nodes, edges = abnf.graph(spark, "g", TEXT)
    by_rule = {r.rule: r.node_id for r in nodes.where("kind = 'rule'").collect()}
    counted = nodes.selectExpr("grammar", "node_id", "rule").collect()
    rows = [("g", r.node_id, counts.get(r.rule, 0)) for r in counted if counts.get(r.rule)]
    hit = spark.createDataFrame(rows, "grammar string, node_id string, hits long")
    return hits.usage(nodes, hit, spark.createDataFrame([("g", total)], "grammar string, total_samples long")), edges, by_rule


def test_protection_reaches_down_and_up(spark):
    u, edges, rule = used(spark, {"top": 900, "often": 900})
    protected = spark.createDataFrame([(rule["rare"],), ("h:other#00000000",)], "node_id string")
    gone = {r.node_id for r in prune.pruned(u, edges, protected).collect()}
    names = {r.node_id: (r.rule, r.kind, r.name) for r in u.collect()}
    assert {names[x][0] for x in gone} == {"alone"}
    everything = [r.asDict() for r in u.collect()], [r.asDict() for r in edges.collect()]
    assert prune.written(*everything, gone) == TEXT.replace('alone = "z"\n', "").replace("=", "=")


def test_without_protection_rare_rules_go(spark):
    u, edges, _ = used(spark, {"top": 900, "often": 900})
    gone = {r.node_id for r in prune.pruned(u, edges, spark.createDataFrame([], "node_id string")).collect()}
    everything = [r.asDict() for r in u.collect()], [r.asDict() for r in edges.collect()]
    assert "rare" not in {r.rule for r in u.collect() if r.node_id not in gone}
    assert prune.written(*everything, gone).endswith('often = "o" / "p"\n')


def test_an_empty_corpus_prunes_all_but_the_protected(spark):
    u, edges, rule = used(spark, {}, 0)
    gone = {r.node_id for r in prune.pruned(u, edges, spark.createDataFrame([(rule["alone"],)], "node_id string")).collect()}
    assert {r.rule for r in u.collect() if r.node_id not in gone} == {"alone"}


def test_walks_end_in_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("x", "y")], "parent_id string, child_id string")
    assert {r.node_id for r in prune.reachable(spark.createDataFrame([("a",)], "node_id string"), edges).collect()} == {"a", "b", "c"}


def test_walks_by_joins_where_a_graph_is_large(spark, monkeypatch):
    monkeypatch.setattr(prune, "MOST_EDGES", 2)
    test_walks_end_in_cycles(spark)


def test_generated_files_can_be_read_again(spark):
    u, edges, _ = used(spark, {"top": 900, "often": 900})
    gone = {r.node_id for r in prune.pruned(u, edges, spark.createDataFrame([], "node_id string")).collect()}
    everything = [r.asDict() for r in u.collect()], [r.asDict() for r in edges.collect()]
    text = prune.generated("g", *everything, gone, 0.001)
    assert text.startswith("; Reduced grammar of g") and list(abnf.rules(text)) == ["top", "often"]
    with pytest.raises(ValueError):
        prune.generated("g", *everything, {"h:x#00000000"}, 0.001)


def test_a_reduced_module_can_be_read_again(spark):
    nodes, edges = abnf.graph(spark, "rfc5280-x509", asn1.rules(asn1.vendored()))
    rows = [r.asDict() for r in nodes.collect()], [r.asDict() for r in edges.collect()]
    text = prune.generated("rfc5280-x509", *rows, set(), 0.001)
    assert "rfc5280_x509 DEFINITIONS ::= BEGIN" in text and list(asn1.rules(text)) == list(asn1.rules(asn1.vendored()))
