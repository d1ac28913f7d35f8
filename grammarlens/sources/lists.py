"""URIs from lists, web archives and index tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grammarlens.functions.uri import is_listed, stripped

#: Where Python's splitlines() divides a text.
LINE_END = r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"
WAT_LINKS = "struct<Envelope:struct<`Payload-Metadata`:struct<`HTTP-Response-Metadata`:struct<`HTML-Metadata`:struct<Links:array<struct<url:string>>>>>>>"


def read_list(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of text files (also gzipped) that name a URI, stripped."""
    lines = spark.read.text(paths)
    return lines.where(is_listed(F.col("value"))).select(stripped(F.col("value")).alias("uri"))


def of_list(text: Column) -> Column:
    """The URIs of a list that is one text, as an array."""
    return F.filter(F.transform(F.split(text, LINE_END), stripped), lambda x: (x != "") & ~x.startswith("#"))


def of_warc(text: Column) -> Column:
    """Target URIs in the headers of a web archive's text, as an array."""
    return F.regexp_extract_all(text, F.lit(r"(?im)^WARC-Target-URI:\s*(\S+)\s*$"), F.lit(1))


def of_wat(payload: Column) -> Column:
    """Outgoing links in the JSON of a metadata record, as an array; empty where it can't be read."""
    links = F.from_json(payload, WAT_LINKS).getField("Envelope").getField("Payload-Metadata").getField("HTTP-Response-Metadata").getField("HTML-Metadata").getField("Links")
    return F.coalesce(F.filter(links.getField("url"), lambda u: u.isNotNull() & (u != "")), F.array().cast("array<string>"))


def read_uris(spark: SparkSession, paths: list[str], kind: str) -> DataFrame:
    """URIs of files by their format: list, index, warc (targets of records) or wat (links in metadata)."""
    from grammarlens.sources import warc

    match kind:
        case "list":
            return read_list(spark, paths)
        case "index":
            return read_index(spark, paths)
        case "warc":
            return warc.read_warc(spark, paths).where("target_uri is not null").select(F.col("target_uri").alias("uri"))
        case "wat":
            return warc.outlinks(warc.read_warc(spark, paths)).select("uri")
    raise ValueError(f"no format {kind!r}")


def read_index(spark: SparkSession, paths: list[str], column: str = "url") -> DataFrame:
    """The URI column of an index in Parquet; nothing else is read."""
    return spark.read.parquet(*paths).select(F.col(column).alias("uri")).where("uri is not null")


def index_paths(manifest: str, subset: str | None = "warc", limit: int | None = None, prefix: str = "") -> list[str]:
    """Paths of a manifest that are Parquet and of the subset, at most limit, behind prefix."""
    lines = [x.strip() for x in manifest.splitlines()]
    kept = [x for x in lines if x.endswith(".parquet") and (subset is None or f"/subset={subset}/" in x)]
    return [prefix.rstrip("/") + "/" + x if prefix else x for x in kept[:limit]]


def dump_date(path: Column) -> Column:
    """YYYYMMDD in the name of a dump, or null."""
    return F.nullif(F.regexp_extract(path, r"-(\d{8})-", 1), F.lit(""))


def read_certificates(spark: SparkSession, folder: str) -> DataFrame:
    """Certificate files of a folder: path and der."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.der").load(folder)
    return files.select("path", F.col("content").alias("der"))
