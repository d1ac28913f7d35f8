"""Checking samples against a reduced grammar, and evidence for what was taken out."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grammarlens.session import staged

MALFORMED, UNSUPPORTED, BOUNDS = "MALFORMED", "UNSUPPORTED_NODE", "BOUNDS_EXCEEDED"
VERDICT = "accepted boolean, error string, bound string, node_id string"


def verdict_columns(found: list[tuple[str | None, str | None, str | None]]) -> list[pa.Array]:
    """The columns of VERDICT from triples of error, bound and node."""
    return [pa.array([f[0] is None for f in found], pa.bool_()), *(pa.array([f[i] for f in found], pa.string()) for i in range(3))]


def verdicts(samples: DataFrame, pruned: DataFrame, most_nodes: int = 16384) -> DataFrame:
    """sample_id, accepted, error, node_id.

    A sample over the bound fails for that, an unmatched one as malformed, and one that
    visited a pruned node for the first of them. pruned is a grammar's set of nodes; it is
    written once, so Spark broadcasts it if it is as small as grammars are, and only visits of
    pruned nodes are shuffled. Of samples only keys and sizes are.
    """
    gone = staged(pruned.select("node_id").distinct(), "pruned")
    visits = samples.select("sample_id", F.posexplode("visited").alias("_pos", "node_id"))
    hit = visits.join(gone, "node_id", "left_semi").groupBy("sample_id").agg(F.min(F.struct("_pos", "node_id")).alias("_hit"))
    over = F.coalesce(F.size("visited"), F.lit(0)) > most_nodes
    plain = F.when(over, BOUNDS).when(~F.coalesce("is_matched", F.lit(False)), MALFORMED)
    error = F.when(F.col("_plain").isNotNull(), F.col("_plain")).when(F.col("_hit").isNotNull(), UNSUPPORTED)
    joined = samples.select("sample_id", plain.alias("_plain")).join(hit, "sample_id", "left").withColumn("error", error)
    return joined.select("sample_id", F.col("error").isNull().alias("accepted"), "error", F.when(F.col("error") == UNSUPPORTED, F.col("_hit.node_id")).alias("node_id"))


def restorable(pruned: DataFrame, evidence: DataFrame, total: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    """Pruned nodes that the evidence uses often enough to restore: by, grammar, node_id, hits, total_samples, usage.

    evidence and total are hits and numbers of samples, for each batch of evidence where by
    names its columns. No samples restore nothing.
    """
    by = by or []
    gone = staged(pruned.select("grammar", "node_id").distinct(), "pruned")
    out = evidence.select(*by, "grammar", "node_id", "hits").join(gone, ["grammar", "node_id"]).join(total.select(*by, "grammar", "total_samples"), [*by, "grammar"])
    out = out.withColumn("usage", F.expr("case when total_samples > 0 then hits / total_samples else 0D end"))
    return out.where((F.col("hits") > 0) & (F.col("usage") >= threshold)).select(*by, "grammar", "node_id", "hits", "total_samples", "usage")


def overrides(restored: DataFrame, submissions: DataFrame, existing: DataFrame, threshold: float) -> DataFrame:
    """New rows for the registry of protected nodes: node_id, protected, justification, owner.

    restored comes from restorable() by submission_id. Nodes that the registry has, protected
    or not, are skipped; of several submissions the first one owns the node.
    """
    first = restored.join(existing.select("node_id").distinct(), "node_id", "left_anti").groupBy("node_id").agg(F.min(F.struct("submission_id", "hits", "total_samples", "usage")).alias("_by"))
    rows = first.select("node_id", "_by.*").join(submissions.select("submission_id", "submitter", "rationale"), "submission_id")
    share, limit = F.format_string("%.4f%%", F.col("usage") * 100), f"{threshold:.4%}"
    text = F.format_string("Evidence: %s Observed in %d of %d samples (%s), at or above the threshold of %s.", "rationale", "hits", "total_samples", share, F.lit(limit))
    return rows.select("node_id", F.lit(True).alias("protected"), text.alias("justification"), F.concat(F.lit("rfe:"), "submitter").alias("owner"))


def checked_submissions(submissions: DataFrame, kinds: dict[str, str], version: int = 1) -> DataFrame:
    """submission_id and the first thing that is wrong with the manifest, null if nothing is.

    kinds: the kind that belongs to each known grammar. That kind and grammar have to agree
    is a guard of ours.
    """
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    belongs = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))
    problem = (
        F.when(F.col("schema_version").isNull() | (F.col("schema_version") != version), "schema_version")
        .when(F.col("grammar").isNull() | ~F.col("grammar").isin(*kinds), "grammar")
        .when(F.col("kind").isNull() | ~F.col("kind").isin(*kinds.values()), "kind")
        .when(belongs[F.col("grammar")] != F.col("kind"), "kind of another grammar")
        .when(blank("submitter"), "submitter")
        .when(blank("rationale"), "rationale")
    )
    return submissions.select("submission_id", problem.alias("problem"))
