"""Writing lists, shards, certificates and documents of hits."""

from __future__ import annotations

import io
import json
import zipfile

from pyarrow import fs
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from grammarlens.operators import dedup, sampling
from grammarlens.sources import submissions


def write_list(uris: DataFrame, path: str, column: str = "uri", distinct_by: list[str] | None = None) -> int:
    """One URI in each line; with columns of their order each URI only once, at its first place. How many were written."""
    kept = uris.where(F.col(column).isNotNull())
    if distinct_by is not None:
        kept = sampling.numbered(dedup.first_seen(kept, [column], distinct_by), distinct_by).orderBy("number")
    seen = Observation()
    kept.select(F.col(column).alias("value")).observe(seen, F.count("*").alias("n")).write.text(path)
    return seen.get["n"]


def write_shards(uris: DataFrame, path: str, shards: int, order: list[str], column: str = "uri") -> None:
    """Folders shard=0 and so on, dealt out in order; a shard without a URI has an empty folder."""
    dealt = sampling.sharded(sampling.numbered(uris.select(F.col(column).alias("value"), *(c for c in order if c != column)), order if column not in order else ["value"]), shards)
    dealt.select("value", "shard").write.partitionBy("shard").text(path)
    jvm, conf = uris.sparkSession._jvm, uris.sparkSession._jsc.hadoopConfiguration()
    for i in range(shards):
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/shard={i}")
        folder.getFileSystem(conf).mkdirs(folder)


def write_certificates(certificates: DataFrame, path: str, der: str = "der") -> None:
    """Base64, one certificate in each line."""
    certificates.where(F.col(der).isNotNull()).select(F.base64(der).alias("value")).write.text(path)


def write_certificate_files(certificates: DataFrame, folder: str, order: list[str], der: str = "der") -> None:
    """Each certificate as a file cert-000000.der and so on, numbered in order, in a folder that all executors share."""
    numbered = sampling.numbered(certificates.where(F.col(der).isNotNull()).select(F.col(der).alias("_der"), *order), order)

    def write(rows) -> None:
        system, inner = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(inner, recursive=True)
        for r in rows:
            with system.open_output_stream(f"{inner}/cert-{r['number']:06d}.der") as out:
                out.write(bytes(r["_der"]))

    numbered.select("number", "_der").foreachPartition(write)


def pruned_document(pruned: DataFrame, grammar: str, threshold: float, provenance: dict | None = None) -> dict:
    """The document of a grammar's pruned nodes, which are fewer than its nodes; nodes of another grammar are an error."""
    found = sorted(r.node_id for r in pruned.select("node_id").distinct().toLocalIterator())
    document = {"schema_version": 1, "grammar": grammar, "threshold": threshold, "pruned": found} | ({"provenance": provenance} if provenance else {})
    if any(not n.startswith(f"{grammar}:") for n in found):
        raise ValueError("nodes of another grammar")
    return document


def overrides_document(overrides: DataFrame) -> dict:
    """The registry of protected nodes as a document."""
    rows = overrides.select("node_id", "protected", "justification", "owner").toLocalIterator()
    return {"schema_version": 1, "overrides": {r.node_id: {"protected": r.protected, "justification": r.justification, "owner": r.owner} for r in rows}}


def submission_archive(meta: dict, lines: list[str]) -> bytes:
    """An archive with evidence, as grammarlens.sources.submissions reads it: a manifest and its list."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr(submissions.MANIFEST, json.dumps({"schema_version": 1, **meta}, indent=2))
        archive.writestr(submissions.LISTS[meta["kind"]], "".join(f"{x}\n" for x in lines))
    return out.getvalue()


def hits_documents(counted: DataFrame, totals: DataFrame) -> DataFrame:
    """For each grammar one JSON document of its hits, in the order of their ids, with the provenance in totals if it has that column.

    counted holds at most the nodes of the grammars, so a document is small.
    """
    by_node = counted.groupBy("grammar").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("node_id", "hits")))).alias("hits"))
    both = totals.join(by_node, "grammar", "left").withColumn("hits", F.coalesce("hits", F.create_map().cast("map<string,bigint>")))
    noted = ["provenance"] if "provenance" in totals.columns else []  # what is null in it isn't written
    return both.select("grammar", F.to_json(F.struct(F.lit(1).alias("schema_version"), "grammar", "total_samples", "hits", *noted)).alias("document"))
