import pytest

from grammarlens import sinks
from grammarlens.functions import uri as U
from grammarlens.plans import pipeline
from grammarlens.sources import abnf, artifacts

G = "rfc3986-uri"


def test_from_sources_to_a_reduced_grammar(spark):
    rules = U.suffix_rules(spark.createDataFrame([("example",)], "value string"))
    pages = spark.createDataFrame([(f" http://h{i % 4}.a.example/p{i % 90}?q=1 ", i) for i in range(200)] + [("mailto:x@y", 900), (None, 901), ("", 902)], "uri string, ord long")
    links = spark.createDataFrame([(f"https://b{i}.example/#f" if i % 2 else "https://a.example/%41", i) for i in range(40)], "uri string, ord long")
    strata = [pipeline.Stratum("pages", 3.0, pages, {"crawl_id": "c"}), pipeline.Stratum("links", 1.0, links), pipeline.Stratum("none", 0.0, links)]
    got = pipeline.run(strata, ["ord"], 40, G, abnf.vendored(), rules, cap=25)
    assert [(s["name"], s["target"], s["kept"]) for s in got.manifest["strata"]] == [("pages", 30, 26), ("links", 10, 10), ("none", 0, 0)]
    assert got.manifest["total_written"] == got.corpus.count() == 36
    assert artifacts.provenance_of_manifest(got.manifest)["crawl_ids"] == ["c"]
    used = {r.node_id: r.hits for r in got.usage.collect()}
    assert used[f"{G}:URI#4c4da3ed"] == 36 and used[f"{G}:IP-literal#615ca5b3"] == 0
    assert "IP-literal" not in abnf.rules(got.grammar) and "fragment" in abnf.rules(got.grammar)
    assert len(sinks.pruned_document(got.pruned, G, 0.001)["pruned"]) == got.pruned.count() > 100
    kept = spark.createDataFrame([(f"{G}:IP-literal#615ca5b3",)], "node_id string")
    assert "IP-literal" in abnf.rules(pipeline.run(strata, ["ord"], 40, G, abnf.vendored(), rules, protected=kept).grammar)
    with pytest.raises(ValueError):
        pipeline.run([], ["ord"], 1, G, abnf.vendored(), rules)
    with pytest.raises(ValueError):
        pipeline.run([strata[0], strata[0]], ["ord"], 1, G, abnf.vendored(), rules)
