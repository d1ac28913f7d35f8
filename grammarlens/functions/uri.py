"""URI expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What str.strip() takes for white space, as a class of Java's regular expressions.
SPACE = r"[\s\u001c-\u001f\u0085   -     　]"
CONTROL = r"[\u0000-\u001f\u007f-\u009f]"


def stripped(raw: Column) -> Column:
    return F.regexp_replace(raw, f"^{SPACE}+|{SPACE}+$", "")


def normalized(raw: Column) -> Column:
    """Without surrounding white space, then without control characters; null if nothing is left."""
    # Most are printable ASCII as they are; the test is much cheaper than the replacements.
    # Not $, which also matches before a line's end.
    return F.when(raw.rlike(r"^[!-~]++\z"), raw).otherwise(F.nullif(F.regexp_replace(stripped(raw), CONTROL, ""), F.lit("")))


def is_listed(raw: Column) -> Column:
    """A line of a list that names a URI: neither null nor blank nor a comment."""
    return F.when(raw.rlike("^[!\"$-~]"), True).otherwise(F.coalesce(raw.rlike(f"^{SPACE}*(?!{SPACE}|#)[\\s\\S]"), F.lit(False)))


def host(uri: Column) -> Column:
    """Between the first :// and the port; null without an authority, for bracketed hosts and if empty.

    One expression that names its column once: what is found first (the ://, the last @ of
    the authority) is not given back.
    """
    return F.nullif(F.regexp_extract(uri, r"^(?>[\s\S]*?://)(?:[^/?#]*@)?+([^/?#@:\[][^/?#@:]*+)", 1), F.lit(""))


def suffix_rules(lines: DataFrame, line: str = "value") -> DataFrame:
    """Public suffix rules from their list: suffix (with * as first label), labels, is_exception."""
    rule = F.lower(F.regexp_extract(F.col(line), r"^\s*(\S+)", 1))
    kept = lines.select(rule.alias("rule")).where("rule <> '' and not startswith(rule, '//')")
    suffix = F.when(F.col("rule").startswith("!"), F.expr("substring(rule, 2)")).otherwise(F.col("rule"))
    return kept.select(suffix.alias("suffix"), F.size(F.split(suffix, r"\.")).alias("labels"), F.col("rule").startswith("!").alias("is_exception")).distinct()


def with_domain(rows: DataFrame, rules: DataFrame, column: str = "host", domain: str = "domain") -> DataFrame:
    """rows with the registrable domain of their host: the public suffix and one label more.

    An exception rule wins with one label less, else the longest rule, else the last label
    alone is the suffix. Null for null hosts, for hosts that are suffixes, hold ":" or "/" or
    an empty label. Rules are met by equality with the last labels, of which no rule has more
    than a few; nothing but the rules is moved if Spark finds them small enough to broadcast.
    """
    is_wild = F.col("suffix").startswith("*.")
    flags = F.bool_or(~F.col("is_exception") & ~is_wild).alias("plain"), F.bool_or("is_exception").alias("exception"), F.bool_or(is_wild).alias("wild")
    by_tail = rules.groupBy(F.when(is_wild, F.expr("substring(suffix, 3)")).otherwise(F.col("suffix")).alias("tail")).agg(*flags)
    most = by_tail.agg(F.max(F.size(F.split("tail", r"\."))).alias("n")).first().n or 0
    labels = F.split(F.lower(F.regexp_replace(stripped(F.col(f"`{column}`")), r"\.+$", "")), r"\.")
    out = rows.withColumn("_labels", labels)
    wide, narrow = [F.lit(1)], []
    for n in range(1, most + 1):
        met = by_tail.select(F.col("tail").alias(f"_tail{n}"), F.struct("plain", "exception", "wild").alias(f"_rule{n}"))
        out = out.withColumn(f"_tail{n}", F.expr(f"case when size(_labels) >= {n} then array_join(slice(_labels, -{n}, {n}), '.') end")).join(met, f"_tail{n}", "left")
        wide += [F.when(F.col(f"_rule{n}.plain"), n), F.when(F.col(f"_rule{n}.wild") & (F.size("_labels") > n), n + 1)]
        narrow.append(F.when(F.col(f"_rule{n}.exception"), n - 1))
    sound = F.expr("not exists(_labels, l -> l = '' or contains(l, ':') or contains(l, '/'))")
    size = F.coalesce(*narrow, F.greatest(*wide) if len(wide) > 1 else wide[0])
    found = out.withColumn("_wide", size).withColumn(domain, F.when(sound & (F.size("_labels") > F.col("_wide")), F.expr("array_join(slice(_labels, -(_wide + 1), _wide + 1), '.')")))
    return found.select(*(F.col(f"`{c}`") for c in rows.columns if c != domain), domain)


def registrable_domains(hosts: DataFrame, rules: DataFrame, column: str = "host") -> DataFrame:
    """Each distinct host with its registrable domain."""
    return with_domain(hosts.select(F.col(column).alias("host")).where("host is not null").distinct(), rules)
