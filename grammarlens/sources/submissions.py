"""Archives with evidence that somebody hands in: a manifest and a list of URIs or certificates."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MANIFEST, LISTS = "submission.json", {"uri": "corpus/uris.txt", "cert": "corpus/certs.b64"}
FIELDS = ("grammar", "kind", "submitter", "rationale")
SCHEMA = "path string, schema_version int, grammar string, kind string, submitter string, rationale string, lines array<string>, problem string"


def opened(content: bytes) -> dict:
    """The fields of one archive, or the first problem with it."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        return {"problem": "no archive"}
    if MANIFEST not in archive.namelist():
        return {"problem": "no manifest"}
    try:
        manifest = json.loads(archive.read(MANIFEST))
    except ValueError:
        return {"problem": "manifest isn't JSON"}
    if not isinstance(manifest, dict) or manifest.get("schema_version") != 1 or set(manifest) != {"schema_version", *FIELDS}:
        return {"problem": "manifest has other fields"}
    if not all(isinstance(manifest[f], str) and manifest[f] for f in FIELDS) or manifest["kind"] not in LISTS:
        return {"problem": "manifest has a bad value"}
    name = LISTS[manifest["kind"]]
    if name not in archive.namelist():
        return manifest | {"problem": f"no {name}"}
    lines = [x.strip() for x in archive.read(name).decode("utf-8", "replace").splitlines()]
    lines = [x for x in lines if x and not x.startswith("#")]
    return manifest | {"lines": lines} | ({} if lines else {"problem": f"{name} is empty"})


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"path": pa.string(), "schema_version": pa.int32(), **dict.fromkeys(FIELDS, pa.string()), "lines": pa.list_(pa.string()), "problem": pa.string()}
    for batch in batches:
        rows = [{"path": p, **opened(c)} for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in kinds.items()], names=list(kinds))


def read_submissions(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each archive: its manifest and lines, or the problem with it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder)
    return files.select("path", "content").mapInArrow(_read, SCHEMA)
