"""From sources to a reduced grammar: sampling by weight, recognising, counting, pruning, writing."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grammarlens.functions import ident
from grammarlens.functions import uri as U
from grammarlens.operators import dedup, hits, prune, recognize, sampling
from grammarlens.session import staged
from grammarlens.sources import abnf, artifacts


class Stratum(NamedTuple):
    """A source of URIs: rows has uri and the columns of their order; weight is its share of the corpus."""

    name: str
    weight: float
    rows: DataFrame
    provenance: dict | None = None


class Result(NamedTuple):
    """corpus: stratum, uri; usage: nodes with hits and usage; pruned: node_id, hits; grammar is the text that is left."""

    corpus: DataFrame
    manifest: dict
    usage: DataFrame
    pruned: DataFrame
    grammar: str


def run(strata: list[Stratum], order: list[str], target: int, grammar: str, source: str, rules: DataFrame, seed: int = 0, cap: int | None = 1000,
        protected: DataFrame | None = None, threshold: float = 0.001, most_bytes: int | None = recognize.MOST_BYTES, shards: int = 8) -> Result:
    """The whole way for one corpus.

    Each stratum is normalised, made distinct and capped by registrable domain (rules are
    suffix rules) in its order; its quota of target with the smallest hashes is drawn with seed plus
    its place; a URI of several strata stays in the first. At least one stratum is needed,
    and names have to differ. Lists of strata and nodes are held by the driver, URIs never.
    """
    if not strata or len({s.name for s in strata}) < len(strata):
        raise ValueError("strata need names of their own, and there has to be one")
    spark = strata[0].rows.sparkSession
    every = reduce(DataFrame.unionByName, (s.rows.select(F.lit(s.name).alias("stratum"), U.normalized(F.col("uri")).alias("uri"), *(F.col(c) for c in order)) for s in strata))
    hosted = U.with_domain(every.where("uri is not null").withColumn("_host", U.host(F.col("uri"))), rules, "_host")
    pool = staged(dedup.capped(hosted, "domain", "uri", order, cap, ["stratum"]).select("stratum", "uri"), "pool")
    listed = spark.createDataFrame([(0, i, s.name, float(s.weight), seed) for i, s in enumerate(strata)], "run_id int, stratum_idx int, stratum string, weight double, seed bigint")
    wanted = staged(sampling.quotas(listed, "weight", target, "stratum_idx"), "wanted")
    drawn = sampling.of_runs(pool, wanted, ident.rank_number).join(listed.select("stratum_idx", "stratum"), "stratum_idx")
    corpus = staged(drawn.select("stratum", "uri"), "corpus")
    kept = {r.stratum: r["count"] for r in corpus.groupBy("stratum").count().collect()}
    quota = {r.stratum: r.quota for r in wanted.select("stratum", "quota").collect()}
    manifest = artifacts.manifest(seed, target, shards, [{"name": s.name, "weight": s.weight, "target": quota[s.name], "kept": kept.get(s.name, 0), "provenance": s.provenance} for s in strata])
    counted = staged(recognize.counted(corpus, "uri", grammar, source, most_bytes=most_bytes), "counted")
    nodes, edges = abnf.graph(spark, grammar, source)
    used = staged(hits.usage(nodes, counted.where("node_id is not null").select("grammar", "node_id", "hits"), counted.where("node_id is null")), "used")
    keep = protected.select("node_id") if protected is not None else nodes.where("false").select("node_id")
    gone = staged(prune.pruned(used, edges, keep, threshold).select("node_id", "hits"), "pruned")
    dropped = {r.node_id for r in gone.collect()}  # at most the nodes of the grammar
    text = prune.generated(grammar, [r.asDict() for r in nodes.collect()], [r.asDict() for r in edges.collect()], dropped, threshold)
    return Result(corpus, manifest, used, gone, text)
