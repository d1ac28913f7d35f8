"""Tables in SQL dumps: INSERT lines with many tuples, as rows of fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TEXT = r"'(?:[^'\\]++|\\[\s\S])*+'"
_TUPLE = rf"\(((?:{_TEXT}|[^')])*+)\)"
_FIELD = rf"(?:^|,)\s*+({_TEXT}|[^,]*+)"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def unescaped(text: Column) -> Column:
    """A backslash stands for the next character; n, t and r after it are control characters."""
    pairs = F.replace(text, F.lit("\\\\"), F.lit("\u0001"))
    for letter, control in (("n", "\n"), ("t", "\t"), ("r", "\r")):
        pairs = F.replace(pairs, F.lit(f"\\{letter}"), F.lit(control))
    return F.when(text.contains("\\"), F.replace(F.replace(pairs, F.lit("\\"), F.lit("")), F.lit("\u0001"), F.lit("\\"))).otherwise(text)


def fields(inner: Column) -> Column:
    """What stands in the brackets of a tuple as an array: strings unescaped, NULL as null, all else as it is written."""
    plain = lambda f: F.when(F.upper(F.trim(f)) != "NULL", F.trim(f))
    value = lambda f: F.when(f.startswith("'"), unescaped(F.substring(f, F.lit(2), F.length(f) - 2))).otherwise(plain(f))
    return F.transform(F.regexp_extract_all(inner, F.lit(_FIELD), F.lit(1)), value)


def tuples(lines: DataFrame, table: str | None, line: str = "value") -> DataFrame:
    """lines with pos and fields of each tuple; without table, a line holds tuples only.

    Lines of other tables have none. Brackets and commas inside strings divide nothing; a
    tuple that isn't closed is left out. Null and empty lines give no rows; a tuple without
    fields has one empty field; other columns come back, unless they are named pos or fields.
    """
    kept = [c for c in lines.columns if c not in (line, "pos", "fields")]
    text = F.col(line)
    if table is not None:
        head = f"INSERT INTO `{table}` VALUES "
        lines, text = lines.where(F.col(line).startswith(head)), F.substring(F.col(line), F.lit(len(head) + 1), F.length(F.col(line)))
    found = lines.select(*kept, F.posexplode(F.regexp_extract_all(text, F.lit(_TUPLE), F.lit(1))).alias("pos", "_inner"))
    return found.select(*kept, "pos", fields(F.col("_inner")).alias("fields"))


def external_urls(lines: DataFrame, table: str | None = "externallinks", url_column: int = 2, line: str = "value") -> DataFrame:
    """lines with pos and uri: the field number url_column (from 0) of each tuple that has one with a scheme."""
    found = tuples(lines, table, line).withColumn("uri", F.get("fields", F.lit(url_column))).drop("fields")
    return found.where(F.col("uri").rlike(SCHEME))
