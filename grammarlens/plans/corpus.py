"""Queries over the URI stream: scanning, normalising, making distinct, capping, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grammarlens.functions import ident
from grammarlens.functions import uri as U
from grammarlens.operators import dedup, sampling
from grammarlens.plans.tables import table
from grammarlens.session import staged
from grammarlens.sources import abnf, lists

#: Suffix rules for the made-up hosts of the test tables: plain, wildcard and exception.
SUFFIXES = ("com", "net", "org", "test", "invalid", "example", "example.com", "*.example.org", "!docs.example.org", "example.net")
CAP, SHARDS, RATE, SEED, TARGET = 20, 8, 0.3, 17, 1000

_SPACE = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
STRIPPED = rf"regexp_replace(raw_uri, '^{_SPACE}+|{_SPACE}+$', '', 'g')"
_NORMAL = rf"nullif(regexp_replace({STRIPPED}, '[\x00-\x1f\x7f\x{{80}}-\x{{9f}}]', '', 'g'), '')"
_HOST = r"case when after is not null and not starts_with(authority, '[') then nullif(split_part(authority, ':', 1), '') end"
_HOSTED = rf"""(select *, {_HOST} as own_host from (select *, regexp_extract(regexp_extract(after, '^[^/?#]*'), '[^@]*$') as authority
 from (select *, case when instr(uri, '://') > 0 then substr(uri, instr(uri, '://') + 3) end as after
 from (select rec_id, stratum, src_file, ord, {_NORMAL} as uri from uri_records))))"""
_DOMAIN = """(select host, case when ok and len(labels) > wide then array_to_string(labels[-(wide + 1):], '.') end as domain from (
 select host, labels, ok, coalesce(max(n - 1) filter (where x), max(n) filter (where not x), 1) as wide from (
  select host, labels, len(list_filter(labels, lambda l: l = '' or contains(l, ':') or contains(l, '/'))) = 0 as ok,
   unnest(list_concat(list_transform(range(1, len(labels) + 1), lambda n: array_to_string(labels[-n:], '.')),
    list_transform(range(1, len(labels) + 1), lambda n: '*' || case when n > 1 then '.' || array_to_string(labels[-(n - 1):], '.') else '' end))) as suffix
  from (select host, string_split(lower(rtrim(host, '.')), '.') as labels from (select distinct own_host as host from {hosted}) where host is not null))
 left join (values {rules}) r(suffix, n, x) using (suffix) group by host, labels, ok))"""
_RULES = ", ".join(f"('{s.lstrip('!')}', {s.count('.') + 1}, {s[0] == '!'})" for s in SUFFIXES)
_DOMAINS = _DOMAIN.format(hosted=_HOSTED, rules=_RULES)


NORMALIZED = _HOSTED


def uris(spark: SparkSession, sf: str) -> DataFrame:
    """Records with normalised URI and the host that it names, null if blank."""
    return table(spark, sf, "uri_records").select("rec_id", "stratum", "src_file", "ord", "host", U.normalized(F.col("raw_uri")).alias("uri")).withColumn("own_host", U.host(F.col("uri")))


def _rules(spark: SparkSession) -> DataFrame:
    return U.suffix_rules(spark.createDataFrame([(s,) for s in SUFFIXES], "value string"))


def _bucketed(spark: SparkSession, sf: str) -> DataFrame:
    rows = uris(spark, sf).where("uri is not null and not startswith(uri, '#')")
    return U.with_domain(rows.drop("host"), _rules(spark), "own_host")


def normalized_uris(spark: SparkSession, sf: str) -> DataFrame:
    return uris(spark, sf).select("rec_id", "uri", "own_host")


def lost_hosts(spark: SparkSession, sf: str) -> DataFrame:
    """Records whose host column isn't what the URI names."""
    return uris(spark, sf).select("rec_id", "own_host", "host").where("own_host is not null and (host is null or host <> own_host)")


def registrable_domains(spark: SparkSession, sf: str) -> DataFrame:
    return U.registrable_domains(uris(spark, sf), _rules(spark), "own_host")


def distinct_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.first_seen(uris(spark, sf).where("uri is not null"), ["uri"], ["src_file", "ord"])


def capped_domains(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct URIs of each stratum, at most CAP for a registrable domain; those without one are exempt."""
    return dedup.capped(_bucketed(spark, sf), "domain", "uri", ["src_file", "ord"], CAP, ["stratum"])


def value_sample(spark: SparkSession, sf: str) -> DataFrame:
    """URIs kept by their own hash at a rate."""
    kept = uris(spark, sf).where("uri is not null").select("uri").distinct()
    return kept.where(ident.rank_number(F.col("uri"), SEED) < int(RATE * 2**60))


def value_sample_blake2b(spark: SparkSession, sf: str) -> DataFrame:
    return uris(spark, sf).where("uri is not null").select("uri").distinct().where(ident.fraction(F.col("uri"), SEED) < RATE)


def stratum_quotas(spark: SparkSession, sf: str) -> DataFrame:
    """A target divided among strata by their numbers of records."""
    sizes = table(spark, sf, "uri_records").groupBy("stratum").agg(F.count("*").cast("double").alias("weight"))
    return sampling.quotas(sizes, "weight", TARGET, "stratum").select("stratum", "quota")


def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Of each stratum's capped URIs the quota with the smallest hashes; a URI of two strata stays in the first."""
    pool = capped_domains(spark, sf).select("stratum", "uri").withColumn("rank_by", ident.rank_number(F.col("uri"), SEED))
    best = sampling.bottom_k(pool, ["stratum"], "rank_by", "uri", stratum_quotas(spark, sf), TARGET)
    return dedup.first_seen(best, ["uri"], ["stratum", "rank_by"])


def stratified_sample_blake2b(spark: SparkSession, sf: str) -> DataFrame:
    """The same as the reference ranks: by blake2b, with a seed for each stratum."""
    return sampling.stratified(capped_domains(spark, sf).select("stratum", "uri"), stratum_quotas(spark, sf), SEED, TARGET)


def sample_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """For each run a sample by the weights of its strata, of capped URIs: target and kept of each stratum, and what was written in all."""
    pool = staged(capped_domains(spark, sf).select("stratum", "uri"), "pool")
    runs = table(spark, sf, "sample_runs").select("run_id", F.coalesce("target_n", F.lit(0)).alias("_target"))
    wanted = sampling.quotas(table(spark, sf, "strata").drop("target", "kept").join(runs, "run_id"), "weight", F.col("_target"), "stratum_idx", ["run_id"])
    strata = staged(wanted.select("run_id", "stratum_idx", "stratum", "weight", "seed", F.col("quota").alias("target"), "quota"), "strata")
    kept = staged(sampling.of_runs(pool, strata, ident.rank_number).groupBy("run_id", "stratum_idx").agg(F.count("*").alias("kept")), "kept")
    written = kept.groupBy("run_id").agg(F.sum("kept").alias("total_written"))
    out = strata.join(kept, ["run_id", "stratum_idx"], "left").join(written, "run_id", "left")
    return out.select("run_id", "stratum_idx", "stratum", "weight", "target", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("total_written", F.lit(0)).alias("total_written"))


def stratum_provenance(spark: SparkSession, sf: str) -> DataFrame:
    """Where the records of each stratum come from: crawls and dump dates, and how many were read."""
    rows = table(spark, sf, "uri_records").groupBy("stratum", "connector", "crawl_id", lists.dump_date(F.col("src_file")).alias("dump_date")).agg(F.count("*").alias("n"))
    unset = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return rows.groupBy("stratum", "connector").agg(unset("crawl_id").alias("crawl_ids"), unset("dump_date").alias("dump_dates"), F.sum("n").alias("urls_read"))


def round_robin_shards(spark: SparkSession, sf: str) -> DataFrame:
    """All distinct URIs in order of arrival, dealt out to shards."""
    return sampling.sharded(sampling.numbered(distinct_first_seen(spark, sf), ["src_file", "ord"]), SHARDS).select("uri", "number", "shard")


def sample_lists(spark: SparkSession, sf: str) -> DataFrame:
    """How many lines of each list name a URI."""
    lines = table(spark, sf, "uri_sample")
    return lines.groupBy("list_name").agg(F.count("*").alias("lines"), F.count_if(U.is_listed(F.col("uri"))).alias("uris"))


def warc_targets(spark: SparkSession, sf: str) -> DataFrame:
    """The records of each file as the headers of a web archive, read back and counted."""
    rows = table(spark, sf, "uri_records").where("raw_uri is not null")
    headers = rows.select("src_file", F.concat(F.lit("WARC/1.0\nwarc-target-uri: "), F.col("raw_uri"), F.lit("\n")).alias("header"))
    return headers.select("src_file", F.explode(lists.of_warc(F.col("header"))).alias("uri")).groupBy("src_file").agg(F.count("*").alias("links"))


def dump_dates(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "externallinks_raw").groupBy("dump_file").agg(F.count("*").alias("rows"))
    return rows.select("dump_file", lists.dump_date(F.col("dump_file")).alias("dump_date"), "rows")


# --- components of URIs, by the grammar as regular expressions ----------------------------

#: What is looked for in URIs that match as a whole: pieces of RFC 3986.
COMPONENTS = ("URI", "authority", "userinfo", "port", "IPv4address", "IP-literal", "query", "fragment", "pct-encoded", "path-rootless")
_PARTS = r"^([^:/?#]+):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _components(uri: str, uri_pattern: str, v4: str, dialect: str) -> dict[str, str]:
    """SQL conditions, for a URI in a column."""
    full = (lambda p, c: f"regexp_full_match({c}, '{p}')") if dialect == "duckdb" else (lambda p, c: f"{c} rlike '^(?:{p})$'")
    some = (lambda p, c: f"regexp_matches({c}, '{p}')") if dialect == "duckdb" else (lambda p, c: f"{c} rlike '{p}'")
    matched = full(uri_pattern, uri)
    has = {
        "URI": "true",
        "authority": some("^[^:/?#]+://", uri),
        "userinfo": some("^[^:/?#]+://[^/?#@]*@", uri),
        "port": some(r"^[^:/?#]+://(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^:/?#]*):[0-9]*(?:[/?#]|$)", uri),
        "IPv4address": some(rf"^[^:/?#]+://(?:[^/?#@]*@)?{v4}(?:[:/?#]|$)", uri),
        "IP-literal": some(r"^[^:/?#]+://(?:[^/?#@]*@)?\[", uri),
        "query": some(r"^[^?#]*\?", uri),
        "fragment": some("#", uri),
        "pct-encoded": some("%", uri),
        "path-rootless": some("^[^:/?#]+:[^/?#]", uri),
    }
    return {k: f"{matched} and {v}" for k, v in has.items()}


def _patterns() -> tuple[str, str]:
    rules = abnf.rules(abnf.vendored())
    quoted = lambda p: p.replace("'", "\\x27")
    return quoted(abnf.pattern(rules, "URI")), quoted(abnf.pattern(rules, "IPv4address"))


def component_usage(spark: SparkSession, sf: str) -> DataFrame:
    """For each stratum how many distinct URIs match the grammar, and how many use each component."""
    full, v4 = _patterns()
    spark_sql = _components("uri", full.replace("\\", "\\\\"), v4.replace("\\", "\\\\"), "spark")
    once = uris(spark, sf).where("uri is not null and octet_length(uri) <= 8192").select("stratum", "uri").distinct()
    matched = once.withColumn("_m", F.expr(spark_sql["URI"]))
    tests = {k: v.partition(" and ")[2].replace("\\", "\\\\") if k != "URI" else "true" for k, v in spark_sql.items()}
    counts = [F.count_if(F.expr(f"_m and {tests[k]}")).alias(k.replace("-", "_").lower()) for k in COMPONENTS]
    return matched.groupBy("stratum").agg(F.count("*").alias("uris"), *counts)


def oracle_pattern(rule: str) -> str:
    """For the oracle, whose expressions have no possessive quantifiers; what they match is the same."""
    return abnf.pattern(abnf.rules(abnf.vendored()), rule).replace("'", "\\x27").replace("++", "+").replace("*+", "*")


def _component_sql() -> str:
    tests = _components("uri", oracle_pattern("URI"), oracle_pattern("IPv4address"), "duckdb")
    counts = ", ".join(f"count(*) filter (where m and {tests[k].partition(' and ')[2]}) as {k.replace('-', '_').lower()}" for k in COMPONENTS)
    return f"select stratum, count(*) as uris, {counts} from (select stratum, uri, {tests['URI'].partition(' and ')[0]} as m from (select distinct stratum, uri from {_HOSTED} where uri is not null and strlen(uri) <= 8192)) group by 1"


QUERIES = {
    f.__name__: f
    for f in (normalized_uris, lost_hosts, registrable_domains, distinct_first_seen, capped_domains, value_sample, value_sample_blake2b, stratum_quotas, stratified_sample, stratified_sample_blake2b, sample_manifest, stratum_provenance, round_robin_shards, sample_lists, warc_targets, dump_dates, component_usage)
}
_CAPPED = f"""(select stratum, domain, uri, src_file, ord from (
 select *, row_number() over (partition by stratum, domain order by src_file, ord) as rk from (
  select stratum, domain, uri, first.a as src_file, first.b as ord from (
   select stratum, coalesce(domain, '') as domain, uri, min({{'a': src_file, 'b': ord}}) as first from (select h.*, d.domain from {_HOSTED} h left join {_DOMAINS} d on d.host = h.own_host)
   where uri is not null and not starts_with(uri, '#') group by 1, 2, 3))) where rk <= {CAP} or domain = '')"""
_HASH = f"cast('0x' || substr(sha256('{SEED}:' || uri), 1, 15) as bigint)"
_QUOTAS = f"""(select stratum, fl + case when row_number() over (order by round(ex - fl, 9) desc, stratum) <= {TARGET} - sum(fl) over () then 1 else 0 end as quota
 from (select stratum, ex, cast(floor(ex + 1e-9) as bigint) as fl from (select stratum, {TARGET} * cast(count(*) as double) / sum(count(*)) over () as ex from uri_records group by 1)))"""
ORACLES = {
    "normalized_uris": f"select rec_id, uri, own_host from {_HOSTED}",
    "lost_hosts": f"select h.rec_id, h.own_host, r.host from {_HOSTED} h join uri_records r using (rec_id) where own_host is not null and (host is null or host <> own_host)",
    "registrable_domains": f"select host, domain from {_DOMAINS}",
    "distinct_first_seen": f"select uri, src_file, ord from {_HOSTED} where uri is not null qualify row_number() over (partition by uri order by src_file, ord) = 1",
    "capped_domains": f"select * from {_CAPPED}",
    "value_sample": f"select uri from (select distinct uri from {_HOSTED} where uri is not null) where {_HASH} < {int(RATE * 2**60)}",
    "stratum_quotas": f"select * from {_QUOTAS}",
    "stratified_sample": f"""select uri, stratum, rank_by from (select *, row_number() over (partition by uri order by stratum) as again from (
 select c.stratum, uri, {_HASH} as rank_by, quota, row_number() over (partition by c.stratum order by {_HASH}, uri desc) as rk from {_CAPPED} c join {_QUOTAS} q using (stratum)) where rk <= quota) where again = 1""",
    "stratum_provenance": r"""select stratum, connector, coalesce(string_agg(distinct crawl_id, ',' order by crawl_id), '') as crawl_ids,
 coalesce(string_agg(distinct d, ',' order by d), '') as dump_dates, count(*) as urls_read from (select *, nullif(regexp_extract(src_file, '-(\d{8})-', 1), '') as d from uri_records) group by 1, 2""",
    "sample_manifest": f"""with q as (select run_id, stratum_idx, stratum, weight, seed, fl + case when row_number() over (partition by run_id order by round(ex - fl, 9) desc, stratum_idx) <= (case when sum(ex) over (partition by run_id) > 0 then target_n - sum(fl) over (partition by run_id) else 0 end) then 1 else 0 end as target
 from (select *, cast(floor(ex + 1e-9) as bigint) as fl from (select s.run_id, s.stratum_idx, s.stratum, s.weight, s.seed, r.target_n, case when sum(s.weight) over (partition by s.run_id) > 0 then r.target_n * coalesce(s.weight, 0) / sum(s.weight) over (partition by s.run_id) else 0 end as ex from strata s join sample_runs r using (run_id)))),
 best as (select * from (select q.run_id, q.stratum_idx, c.uri, q.target, row_number() over (partition by q.run_id, q.stratum_idx order by cast('0x' || substr(sha256((q.seed + q.stratum_idx)::varchar || ':' || c.uri), 1, 15) as bigint), c.uri desc) as rk from {_CAPPED} c join q using (stratum) where q.target > 0) where rk <= target),
 kept as (select run_id, stratum_idx, count(*) as kept from (select run_id, uri, min(stratum_idx) as stratum_idx from best group by 1, 2) group by 1, 2)
 select run_id, stratum_idx, stratum, weight, target, coalesce(kept, 0) as kept, coalesce(sum(kept) over (partition by run_id), 0)::bigint as total_written from q left join kept using (run_id, stratum_idx)""",
    "round_robin_shards": f"select uri, row_number() over (order by src_file, ord) - 1 as number, cast((row_number() over (order by src_file, ord) - 1) % {SHARDS} as int) as shard from (select uri, src_file, ord from {_HOSTED} where uri is not null qualify row_number() over (partition by uri order by src_file, ord) = 1)",
    "sample_lists": f"select list_name, count(*) as lines, count(*) filter (where regexp_matches(uri, '^{_SPACE}*[^{_SPACE[1:-1]}#]')) as uris from uri_sample group by 1",
    "warc_targets": r"select src_file, count(*) as links from (select src_file, unnest(regexp_extract_all('WARC/1.0' || chr(10) || 'warc-target-uri: ' || raw_uri || chr(10), '(?im)^WARC-Target-URI:\s*(\S+)\s*$', 1)) as uri from uri_records where raw_uri is not null) group by 1",
    "dump_dates": r"select dump_file, nullif(regexp_extract(dump_file, '-(\d{8})-', 1), '') as dump_date, count(*) as rows from externallinks_raw group by 1, 2",
    "component_usage": _component_sql(),
}
