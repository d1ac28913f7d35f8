"""Rows that fail to parse: the queries of problem 2 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grammarlens.operators import rejects as R
from grammarlens.plans.tables import table
from grammarlens.sources import dumps


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    links = R.rejects(R.load_links(table(spark, sf, "externallinks_raw")), "externallinks_raw")
    certs = R.rejects(R.load_certs(table(spark, sf, "submission_certs")), "submission_certs")
    return links.unionByName(certs)


def p2_links(spark: SparkSession, sf: str) -> DataFrame:
    return R.load_links(table(spark, sf, "externallinks_raw")).where("reason is null").drop("reason")


def p2_certs(spark: SparkSession, sf: str) -> DataFrame:
    """The bytes as hexadecimal digits."""
    return R.load_certs(table(spark, sf, "submission_certs")).where("reason is null").select("row_id", F.hex("der").alias("der"))


def dump_urls(spark: SparkSession, sf: str) -> DataFrame:
    """How many tuples of each dump have a URL in a column; broken tuples are read as far as they go."""
    rows = table(spark, sf, "externallinks_raw").select("dump_file", "raw_tuple")
    found = [dumps.external_urls(rows, None, n, "raw_tuple").groupBy("dump_file").agg(F.count("*").alias("urls")).select("dump_file", F.lit(n).alias("url_column"), "urls") for n in (2, 3)]
    return found[0].unionByName(found[1])


# A row without what may stand around its tuple: white space, and one comma or semicolon after it.
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_BARE = _STRIP.format(f"regexp_replace({_STRIP.format('raw_tuple')}, '[,;]$', '')")
_Q = r"''(?:[^''\\]|\\.)*''\s*"
_U = r"(?:[^''\s,)][^'',)]*)?"
_F = rf"\s*(?:{_Q}|{_U})"
_TEXT = r"''((?:[^''\\]|\\.)*)''"
_FIVE = rf"\(\s*([^,]*?)\s*,\s*([^,]*?)\s*,\s*(?:{_TEXT}|[^'',]*?)\s*,\s*({_Q}|{_U}),\s*(?:{_TEXT}\s*|({_U}))\)"
_LINKS = rf"""
select row_id, case
  when not regexp_full_match(t, '\(?{_F}(?:,{_F})*(?:\).*)?', 's') then 'quoting'
  when not regexp_full_match(t, '\((?:{_F},){{4}}{_F}\)', 's') then 'columns'
  when not (regexp_full_match(f.id, '[0-9]+') and regexp_full_match(f.fr, '[0-9]+')) then 'value'
  when try_cast(f.id as hugeint) is null or try_cast(f.fr as hugeint) is null or try_cast(f.id as hugeint) > 4294967295 or try_cast(f.fr as hugeint) > 4294967295 then 'value'
  when not regexp_matches(f.url, '^[A-Za-z][A-Za-z0-9+.\-]*:') then 'value'
  when not (regexp_full_match(f.ix, '{_Q}', 's') or upper(trim(f.ix, e' \t\r\n')) = 'NULL') then 'value'
  when not regexp_full_match(f.ix60, '', 's') and upper(trim(f.ix60, e' \t\r\n')) <> 'NULL' then 'value'
  when length(regexp_replace(f.long, '\\(.)', '\1', 'gs')) > 60 then 'value'
  when f.ix60 = '' and not regexp_full_match(t, '.*''\s*\)', 's') then 'value'
  end as reason, f
from (select *, regexp_extract(t, '^{_FIVE}$', ['id', 'fr', 'url', 'ix', 'long', 'ix60'], 's') as f from (select row_id, coalesce({_BARE}, '') as t from externallinks_raw))
"""
_URL = r"replace(replace(replace(replace(replace(replace(f.url, '\\', chr(1)), '\n', chr(10)), '\t', chr(9)), '\r', chr(13)), '\', ''), chr(1), '\')"
_CERTS = r"""
select row_id, h, case
  when not regexp_full_match(line, '(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?') then 'encoding'
  when substr(h, 1, 2) <> '30' or length(h) < 4 then 'value'
  when first < 128 then case when length(h) // 2 <> 2 + first then 'value' end
  when first in (128, 255) then 'value'
  when first > 132 or length(h) // 2 < 2 + first - 128 then 'value'
  when length(h) // 2 <> 2 + first - 128 + cast('0x' || substr(h, 5, 2 * (first - 128)::int) as bigint) then 'value'
  end as reason
from (select *, try_cast('0x' || substr(h, 3, 2) as bigint) as first from (
  select row_id, line, case when regexp_full_match(line, '(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?') then hex(from_base64(line)) else '' end as h
  from (select row_id, trim(cert_line, e' \t\r\n') as line from submission_certs) where line <> '' and line not like '#%'))
"""

_TUPLES = r"(select dump_file, unnest(regexp_extract_all(raw_tuple, '\(((?:''(?:[^''\\]|\\.)*''|[^'')])*)\)', 1, 's')) as inner_ from externallinks_raw)"
_FIELDS = rf"(select dump_file, regexp_extract_all(inner_, '(?:^|,)\s*(''(?:[^''\\]|\\.)*''|[^,]*)', 1, 's') as f from {_TUPLES})"
_DUMP = f"select dump_file, n as url_column, count(*) as urls from {_FIELDS}, (values (2), (3)) k(n) where regexp_matches(ltrim(f[n + 1], ''''), '^[A-Za-z][A-Za-z0-9+.\\-]*:') group by 1, 2"

QUERIES = {"p2_found": p2_found, "p2_links": p2_links, "p2_certs": p2_certs, "dump_urls": dump_urls}
ORACLES = {
    "p2_found": f"select 'externallinks_raw' as src_table, row_id, reason from ({_LINKS}) where reason is not null"
    f" union all select 'submission_certs', row_id, reason from ({_CERTS}) where reason is not null",
    "p2_links": f"select row_id, cast(f.id as bigint) as el_id, cast(f.fr as bigint) as el_from, {_URL} as url from ({_LINKS}) where reason is null",
    "p2_certs": f"select row_id, h as der from ({_CERTS}) where reason is null",
    "dump_urls": _DUMP,
}
