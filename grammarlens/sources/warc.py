"""Records of web archives, read as a stream: one task for each file (gzip can't be split), a record at a time."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from grammarlens.sources.lists import of_wat

SCHEMA = "path string, record_no bigint, kind string, target_uri string, payload string"
#: Rows and bytes of payload that are handed on together.
ROWS, BYTES = 500, 1 << 24


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, in lower case, and body of each record; what stands between records is skipped."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("latin-1").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = headers.get("content-length", "0")
        yield headers, stream.read(int(size)) if size.isdigit() else b""


def _open(path: str) -> io.BufferedIOBase:
    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    raw = system.open_input_stream(inner, compression=None)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw)


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # of no files Spark still makes one
            return
        path, rows, size = partition.value, [], 0
        names = ("path", "record_no", "kind", "target_uri", "payload")

        def batch() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))

        with _open(path) as stream:
            for no, (headers, body) in enumerate(records(stream)):
                rows.append((path, no, headers.get("warc-type"), headers.get("warc-target-uri"), body.decode("utf-8", "replace")))
                size += len(body)
                if len(rows) >= ROWS or size > BYTES:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


class WarcSource(DataSource):
    """The format "warc"; the option paths has the paths of files, one in each line."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader([p for p in self.options.get("paths", "").splitlines() if p])


def read_warc(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, record_no, kind, target_uri and payload of every record of the files, which may be given by patterns.

    Paths of any file system that Arrow knows; no file is held in memory, whatever its size.
    """
    files: list[str] = []
    for path in paths:
        pattern = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
        files += sorted(f.getPath().toString() for f in found or [])
    spark.dataSource.register(WarcSource)
    # A local path as Hadoop writes it has one slash where Arrow wants three.
    return spark.read.format("warc").option("paths", "\n".join(f.replace("file:/", "file:///", 1) if f.startswith("file:/") and not f.startswith("file:///") else f for f in files)).load()


def wat_paths(manifest: str, limit: int | None = None, prefix: str = "") -> list[str]:
    """Paths of a manifest that are metadata archives, at most limit, behind prefix."""
    kept = [x for x in map(str.strip, manifest.splitlines()) if x.endswith(".wat.gz")]
    return [prefix.rstrip("/") + "/" + x if prefix else x for x in kept[:limit]]


def outlinks(archive: DataFrame) -> DataFrame:
    """Links in the metadata records of an archive, in order; records that can't be read have none."""
    return archive.where("kind = 'metadata'").select("path", "record_no", F.posexplode(of_wat(F.col("payload"))).alias("pos", "uri"))
