"""How many samples hit each grammar node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grammarlens.session import staged

def hits(samples: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """grammar, node_id, hits of matched samples; a node counts once for each sample.

    samples: grammar, is_matched, visited, and the columns in extra to count by. Null and
    empty visits count for nothing, null matches as unmatched.
    """
    extra = extra or []
    seen = samples.where("is_matched").select(*extra, "grammar", F.explode(F.array_distinct("visited")).alias("node_id"))
    return seen.where("node_id is not null").groupBy(*extra, "grammar", "node_id").agg(F.count("*").alias("hits"))


def totals(samples: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """All samples, matched or not, and the matched ones."""
    return samples.groupBy(*(extra or []), "grammar").agg(F.count("*").alias("total_samples"), F.count_if("is_matched").alias("matched"))


def merged(parts: DataFrame) -> DataFrame:
    """Hits of shards as hits of the whole: sums for each grammar, in any order and grouping.

    Where only one grammar may come, grammarlens.sources.artifacts.same_grammar guards it.
    """
    return parts.groupBy("grammar", "node_id").agg(F.sum("hits").alias("hits"))


def usage(nodes: DataFrame, counted: DataFrame, total: DataFrame) -> DataFrame:
    """nodes with hits (0 where there are none), total_samples and usage (0 for an empty corpus)."""
    out = nodes.join(counted, ["grammar", "node_id"], "left").join(total.select("grammar", "total_samples"), "grammar", "left")
    out = out.withColumn("hits", F.coalesce("hits", F.lit(0).cast("bigint"))).withColumn("total_samples", F.coalesce("total_samples", F.lit(0).cast("bigint")))
    return out.withColumn("usage", F.expr("case when total_samples > 0 then hits / total_samples else 0D end"))


def once(visits: DataFrame) -> DataFrame:
    """One row for each sample: the first delivery by time and row number.

    Deliveries are compared by their keys alone. The rows to drop, which are few where
    samples are rarely delivered twice, are written: if they are few, Spark knows it and
    broadcasts them, so that the arrays of nodes needn't be shuffled to be rid of them.
    """
    keys = visits.select("sample_id", "visit_row", "parsed_at")
    first = F.min(F.struct("parsed_at", "visit_row"))
    again = keys.groupBy("sample_id").agg(F.count("*").alias("n"), first.alias("first")).where("n > 1").select("sample_id", F.col("first.visit_row").alias("_kept"))
    dropped = staged(keys.join(again, "sample_id").where("visit_row <> _kept").select("visit_row"), "dropped")
    return visits.join(dropped, "visit_row", "left_anti")
