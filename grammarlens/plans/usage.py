"""Queries over grammar nodes: hits, usage, pruning, verdicts, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grammarlens.functions import ident
from grammarlens.functions.uri import is_listed, normalized, stripped
from grammarlens.operators import der, evidence, hits, prune, recognize, rejects
from grammarlens.plans import corpus
from grammarlens.plans.tables import table
from grammarlens.session import staged
from grammarlens.sources import abnf, asn1
from grammarlens.streaming import incremental

URI, X509 = "rfc3986-uri", "rfc5280-x509"
THRESHOLD, EVIDENCE_RATE = 0.001, 0.0005
#: Rules that the check of pruning protects: what an authority is made of.
KEPT = "authority"


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    return hits.once(table(spark, sf, "parse_visits"))


def node_hits(spark: SparkSession, sf: str) -> DataFrame:
    return hits.hits(_samples(spark, sf))


def sample_totals(spark: SparkSession, sf: str) -> DataFrame:
    return hits.totals(_samples(spark, sf))


def shard_hits_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of each shard, merged: the same as the hits of all samples."""
    return hits.merged(hits.hits(_samples(spark, sf), ["shard_no"]))


def streamed_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Samples counted as they arrive, batch by batch, each once however often it is delivered, then merged."""
    return incremental.counted(spark, f"{sf}/parse_visits.parquet", "sample_id")


def _graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return abnf.graph(spark, URI, abnf.vendored())


def _used(spark: SparkSession, sf: str) -> DataFrame:
    samples = _samples(spark, sf)
    return hits.usage(_graph(spark)[0], hits.hits(samples), hits.totals(samples))


def _distinct(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct URIs of each stratum."""
    return table(spark, sf, "uri_records").select("stratum", normalized(F.col("raw_uri")).alias("uri")).where("uri is not null and not startswith(uri, '#')").distinct()


def uri_node_usage(spark: SparkSession, sf: str) -> DataFrame:
    """From the URIs themselves: every node of the grammar, how many URIs use it, and which share that is."""
    found = recognize.counted(_distinct(spark, sf), "uri", URI, abnf.vendored())
    counted = found.where("node_id is not null").select("grammar", "node_id", "hits")
    used = hits.usage(_graph(spark)[0], counted, found.where("node_id is null").select("grammar", "total_samples"))
    return used.select("node_id", "kind", "name", "hits", "total_samples", F.round("usage", 9).alias("usage"))


def uri_matches(spark: SparkSession, sf: str) -> DataFrame:
    """How many distinct URIs of each stratum the grammar matches, by its expression alone."""
    pattern = abnf.pattern(abnf.rules(abnf.vendored()), "URI")
    once = _distinct(spark, sf).where(F.octet_length("uri") <= recognize.MOST_BYTES)
    return once.groupBy("stratum").agg(F.count("*").alias("uris"), F.count_if(F.col("uri").rlike(rf"^(?:{pattern})\z")).alias("matched"))


def uri_scan(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of the lines of each list: no URIs, skipped as too long, samples, matches."""
    lines = table(spark, sf, "uri_sample").select("list_name", stripped(F.col("uri")).alias("uri"))
    counted = recognize.counted(lines.where(is_listed(F.col("uri"))), "uri", URI, abnf.vendored(), ["list_name"]).where("node_id is null")
    every = lines.groupBy("list_name").agg(F.count("*").alias("lines"))
    return every.join(counted, "list_name", "left").select("list_name", "lines", *(F.coalesce(c, F.lit(0)).alias(n) for c, n in (("skipped", "skipped"), ("total_samples", "samples"), ("hits", "matched"))))


#: Rules that the verdicts on URIs take as pruned.
DENIED = ("userinfo", "fragment")


def uri_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the distinct URIs of submissions and lists are accepted without the denied rules, and why not."""
    both = [table(spark, sf, t).where(is_listed(F.col("uri"))).select(stripped(F.col("uri")).alias("uri")) for t in ("submission_uris", "uri_sample")]
    nodes = _graph(spark)[0]
    denied = nodes.where((F.col("kind") == "rule") & F.col("name").isin(*DENIED)).select("node_id")
    return recognize.verdicts(both[0].unionByName(both[1]).distinct(), "uri", URI, abnf.vendored(), denied, most_nodes=1 << 20)


def certificate_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each certificate is accepted without the nodes that are rare in the samples."""
    return der.verdicts(_certificates(spark, sf), X509, asn1.vendored(), _rare(spark, sf)).drop("der")


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    """For each well-formed submission and node the hits of its URIs or certificates, and under the node null its samples. No bounds apply."""
    good = staged(submission_problems(spark, sf).where("problem is null").join(table(spark, sf, "submissions"), "submission_id").select("submission_id", "grammar", "kind"), "submissions")
    lines = table(spark, sf, "submission_uris").where(is_listed(F.col("uri"))).join(good.where("kind = 'uri'"), "submission_id")
    uris = recognize.counted(lines.select("submission_id", stripped(F.col("uri")).alias("uri")), "uri", URI, abnf.vendored(), ["submission_id"], most_bytes=None)
    owners = table(spark, sf, "submission_certs").select("row_id", "submission_id").join(good.where("kind = 'cert'"), "submission_id").select("row_id", "submission_id")
    walked = der.walked(_certificates(spark, sf).join(owners, "row_id"), typed=(X509, asn1.vendored())).withColumn("grammar", F.lit(X509))
    certs = hits.hits(walked, ["submission_id"]).withColumn("total_samples", F.lit(None).cast("bigint"))
    totals = hits.totals(walked, ["submission_id"]).select("submission_id", "grammar", F.lit(None).cast("string").alias("node_id"), F.col("matched").alias("hits"), "total_samples")
    return staged(uris.drop("skipped").unionByName(certs).unionByName(totals), "evidence")


def _restored(spark: SparkSession, sf: str) -> DataFrame:
    found = _evidence(spark, sf)
    return evidence.restorable(_rare(spark, sf), found.where("node_id is not null"), found.where("node_id is null"), EVIDENCE_RATE, ["submission_id"])


def submission_samples(spark: SparkSession, sf: str) -> DataFrame:
    """How many lines of each well-formed submission are samples, and how many of them the grammar matches."""
    return _evidence(spark, sf).where("node_id is null").select("submission_id", "grammar", "total_samples", F.col("hits").alias("matched"))


def submission_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Rare nodes that a submission uses often enough to restore."""
    return _restored(spark, sf).select("submission_id", "grammar", "node_id", "hits", "total_samples", F.round("usage", 9).alias("usage"))


def new_overrides(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that the submissions' evidence adds to the registry of protected nodes."""
    return evidence.overrides(_restored(spark, sf), table(spark, sf, "submissions"), _protected(_graph(spark)[0]), EVIDENCE_RATE)


def node_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Every node of the grammar with its hits, also those that nothing hit."""
    return _used(spark, sf).select("node_id", "kind", "name", "hits", "total_samples", F.round("usage", 9).alias("usage"))


def pruned_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of the grammar under the threshold that the protected rules don't need.

    Protected are, as an example of a registry, the rules that the rule KEPT refers to.
    """
    nodes, edges = _graph(spark)
    return prune.pruned(_used(spark, sf), edges, _protected(nodes), THRESHOLD).select("node_id", "hits")


def _protected(nodes: DataFrame) -> DataFrame:
    named = nodes.where((F.col("rule") == KEPT) & (F.col("kind") == "reference")).select("name")
    return nodes.where("kind = 'rule'").join(named, "name", "left_semi").select("node_id")


def reduced_grammar(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of the grammar without its pruned nodes."""
    nodes, edges = _graph(spark)
    gone = {r.node_id for r in pruned_nodes(spark, sf).select("node_id").collect()}  # at most the nodes of a grammar
    text = prune.generated(URI, [r.asDict() for r in nodes.collect()], [r.asDict() for r in edges.collect()], gone, THRESHOLD)
    return spark.createDataFrame(list(enumerate(text.splitlines())), "line_no int, line string")


def unknown_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Visited nodes that neither grammar has, with their hits."""
    known = _graph(spark)[0].select("node_id").unionByName(abnf.graph(spark, X509, asn1.rules(asn1.vendored()))[0].select("node_id"))
    return hits.hits(_samples(spark, sf)).join(known, "node_id", "left_anti").select("grammar", "node_id", "hits")


def _rare(spark: SparkSession, sf: str, samples: DataFrame | None = None) -> DataFrame:
    """Visited nodes of both grammars under the threshold."""
    samples = _samples(spark, sf) if samples is None else samples
    counted = hits.hits(samples)
    used = hits.usage(counted.select("grammar", "node_id"), counted, hits.totals(samples))
    return used.where(F.col("usage") < THRESHOLD)


def rare_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _rare(spark, sf).select("grammar", "node_id", "hits", "total_samples")


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each sample is accepted when rare nodes are taken out of the grammar, and why not."""
    samples = _samples(spark, sf)
    return evidence.verdicts(samples, _rare(spark, sf, samples))


def restorable_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Rare nodes that a shard, taken by itself, uses often enough to restore."""
    own = _samples(spark, sf)
    found = evidence.restorable(_rare(spark, sf, own), hits.hits(own, ["shard_no"]), hits.totals(own, ["shard_no"]), EVIDENCE_RATE, ["shard_no"])
    return found.select("shard_no", "grammar", "node_id", "hits", F.round("usage", 9).alias("usage"))


def submission_problems(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.checked_submissions(table(spark, sf, "submissions"), {URI: "uri", X509: "cert"})


def _certificates(spark: SparkSession, sf: str) -> DataFrame:
    return rejects.load_certs(table(spark, sf, "submission_certs")).where("reason is null").select("row_id", "der")


def distinct_certificates(spark: SparkSession, sf: str) -> DataFrame:
    return der.fingerprinted(_certificates(spark, sf))


def certificate_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct certificates, of equal ones the first, sampled by their fingerprint, beside how many rows were scanned, again there and kept."""
    once = staged(distinct_certificates(spark, sf), "certificates")
    kept = once.where(ident.rank_number(F.col("fingerprint"), corpus.SEED) < int(corpus.RATE * 2**60))
    counts = once.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("scanned"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates")).first()
    return kept.select("fingerprint", "row_id", F.lit(counts.scanned).cast("bigint").alias("scanned"), F.lit(counts.duplicates).cast("bigint").alias("duplicates"))


def der_hits(spark: SparkSession, sf: str) -> DataFrame:
    """In how many certificates each place of their structure occurs."""
    walked = der.walked(_certificates(spark, sf)).withColumn("grammar", F.lit("der"))
    return hits.hits(walked).select(F.col("node_id").alias("place"), "hits")


def certificate_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Every node of the certificate types, and in how many certificates it is used."""
    walked = der.walked(_certificates(spark, sf), typed=(X509, asn1.vendored())).withColumn("grammar", F.lit(X509))
    nodes, _ = abnf.graph(spark, X509, asn1.rules(asn1.vendored()))
    return hits.usage(nodes, hits.hits(walked), hits.totals(walked)).select("node_id", "kind", "name", "hits", "total_samples")


def log_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Certificates wrapped as entries of a transparency log, half of them as precertificates, and read back."""
    rows = _certificates(spark, sf)
    size = F.unhex(F.lpad(F.hex(F.octet_length("der")), 6, "0"))
    head = F.unhex(F.lit("0000" + "00" * 8))
    pre = F.col("row_id") % 2 == 1
    leaf = F.when(pre, F.concat(head, F.unhex(F.lit("0001")))).otherwise(F.concat(head, F.unhex(F.lit("0000")), size, F.col("der")))
    extra = F.when(pre, F.concat(size, F.col("der"))).otherwise(F.unhex(F.lit("")))
    read = rows.select("row_id", ident.certificate_of_entry(leaf, extra).alias("der"))
    return read.select("row_id", F.sha2("der", 256).alias("fingerprint"))


_ONE = "(select * from parse_visits qualify row_number() over (partition by sample_id order by parsed_at, visit_row) = 1)"
_HITS = f"(select grammar, node_id, count(distinct sample_id) as hits from (select grammar, sample_id, unnest(visited) as node_id from {_ONE} where is_matched) where node_id is not null group by 1, 2)"
_TOTALS = f"(select grammar, count(*) as total_samples, count(*) filter (where is_matched) as matched from {_ONE} group by 1)"
_RARE = f"(select grammar, node_id, hits, total_samples from {_HITS} join {_TOTALS} using (grammar) where hits / total_samples < {THRESHOLD})"
_LINE = r"trim(cert_line, e' \t\r\n')"
_CERTS = rf"""(select row_id, der from (select row_id, from_base64({_LINE}) as der, hex(from_base64({_LINE})) as h from submission_certs
 where regexp_full_match({_LINE}, '(?:[A-Za-z0-9+/]{{4}})*(?:[A-Za-z0-9+/]{{2}}==|[A-Za-z0-9+/]{{3}}=)?') and {_LINE} <> '')
 join (select row_id from submission_certs) using (row_id) where row_id not in (select row_id from ({{found}}) where src_table = 'submission_certs'))"""


def _certs_sql() -> str:
    from grammarlens.plans import p2

    return _CERTS.replace("{found}", p2.ORACLES["p2_found"])


_NODES = "(values " + ", ".join(f"('{n}', '{k}', '{name}')" for n, k, name in abnf.listed(URI, abnf.vendored())) + ") n(node_id, kind, name)"

_EDGES = "(values " + ", ".join(f"('{a}', '{b}')" for a, b in abnf.linked(URI, abnf.vendored())) + ") e(parent, child)"
_PRUNED = f"""
with recursive used as (select node_id, kind, name, coalesce(hits, 0) as hits, coalesce(hits, 0) / (select total_samples from {_TOTALS} where grammar = '{URI}') as usage
  from {_NODES} left join (select * from {_HITS} where grammar = '{URI}') using (node_id)),
edges as (select * from {_EDGES}),
refs as (select r.node_id, t.node_id as rule_id, t.usage from used r join used t on t.kind = 'rule' and t.name = r.name where r.kind = 'reference'),
ours as (select node_id from used where kind = 'rule' and name in (select name from used where kind = 'reference' and split_part(split_part(node_id, ':', 2), '#', 1) = '{KEPT}')),
down as (select parent, child from edges union all select node_id, rule_id from refs where usage < {THRESHOLD}),
keep as (select node_id from ours union select child from keep join down on parent = node_id),
back as (select node_id from refs where rule_id in (select node_id from ours)),
around as (select node_id from back union select parent from around join edges on child = node_id where parent not in (select node_id from used where kind = 'rule')),
beside as (select child as node_id from edges where parent in (select node_id from around where node_id not in (select node_id from back) and node_id in (select node_id from used where kind = 'sequence'))
  and child in (select node_id from used where kind = 'terminal'))
select node_id, hits from used where usage < {THRESHOLD} and node_id not in (select node_id from keep union select node_id from around union select node_id from beside)
"""

_X509 = "(values " + ", ".join(f"('{n}')" for n, _, _ in abnf.listed(X509, asn1.rules(asn1.vendored()))) + ") x(node_id)"
_STRIPPED = corpus.STRIPPED.replace("raw_uri", "uri")
_PROBLEMS = f"""select submission_id, case when schema_version is null or schema_version <> 1 then 'schema_version' when grammar is null or grammar not in ('{URI}', '{X509}') then 'grammar'
 when kind is null or kind not in ('uri', 'cert') then 'kind' when kind <> case grammar when '{URI}' then 'uri' else 'cert' end then 'kind of another grammar'
 when coalesce(trim(submitter), '') = '' then 'submitter' when coalesce(trim(rationale), '') = '' then 'rationale' end as problem from submissions"""


def _rule_id(name: str) -> str:
    return abnf.node_id(URI, name, name)


QUERIES = {
    f.__name__: f
    for f in (node_hits, sample_totals, shard_hits_merged, streamed_hits, uri_node_usage, uri_matches, node_usage, pruned_nodes, rare_nodes, verdicts, restorable_nodes, reduced_grammar, unknown_nodes, uri_scan, uri_verdicts, certificate_verdicts, certificate_sample, submission_samples, submission_evidence, new_overrides, submission_problems, distinct_certificates, der_hits, certificate_nodes, log_entries)
}
ORACLES = {
    "uri_matches": f"select stratum, count(*) as uris, count(*) filter (where regexp_full_match(uri, '{corpus.oracle_pattern('URI')}')) as matched from (select distinct stratum, uri from {corpus.NORMALIZED} where uri is not null and not starts_with(uri, '#') and strlen(uri) <= 8192) group by 1",
    "node_hits": f"select * from {_HITS}",
    "sample_totals": f"select * from {_TOTALS}",
    "shard_hits_merged": f"select * from {_HITS}",
    "streamed_hits": f"select * from {_HITS}",
    "unknown_nodes": f"select grammar, node_id, hits from {_HITS} where node_id not in (select node_id from {_NODES}) and node_id not in (select node_id from {_X509})",
    "uri_scan": f"""select list_name, count(*) as lines, count(*) filter (where listed and strlen(u) > 8192) as skipped, count(*) filter (where listed and strlen(u) <= 8192) as samples,
 count(*) filter (where listed and strlen(u) <= 8192 and regexp_full_match(u, '{corpus.oracle_pattern('URI')}')) as matched from (select list_name, {_STRIPPED} as u, coalesce({_STRIPPED}, '') <> '' and not starts_with({_STRIPPED}, '#') as listed from uri_sample) group by 1""",
    "uri_verdicts": f"""select uri, error is null as accepted, error, case when error = 'BOUNDS_EXCEEDED' then 'input_bytes' end as bound, case when error = 'UNSUPPORTED_NODE' then node end as node_id from (
 select uri, case when contains(uri, '#') then '{_rule_id("fragment")}' when regexp_matches(uri, '^[^:/?#]+://[^/?#@]*@') then '{_rule_id("userinfo")}' end as node,
 case when strlen(uri) > 8192 then 'BOUNDS_EXCEEDED' when not regexp_full_match(uri, '{corpus.oracle_pattern('URI')}') then 'MALFORMED' when node is not null then 'UNSUPPORTED_NODE' end as error
 from (select distinct {_STRIPPED} as uri from (select uri from submission_uris union all select uri from uri_sample)) where uri <> '' and not starts_with(uri, '#'))""",
    "submission_samples": f"""with good as (select submission_id, grammar, kind from submissions where submission_id in (select submission_id from ({_PROBLEMS}) where problem is null))
 select submission_id, '{URI}' as grammar, count(*) as total_samples, count(*) filter (where regexp_full_match(u, '{corpus.oracle_pattern('URI')}')) as matched from (select submission_id, {_STRIPPED} as u from submission_uris)
 join good using (submission_id) where kind = 'uri' and u <> '' and not starts_with(u, '#') group by 1
 union all select submission_id, '{X509}', count(*), count(*) from {_certs_sql()} join (select row_id, submission_id from submission_certs) using (row_id) join good using (submission_id) where kind = 'cert' group by 1""",
    "certificate_sample": f"""select fingerprint, row_id, scanned, duplicates from (select *, sum(copies) over ()::bigint as scanned, sum(copies - 1) over ()::bigint as duplicates from (
 select sha256(der) as fingerprint, min(row_id) as row_id, count(*) as copies from {_certs_sql()} group by 1)) where cast('0x' || substr(sha256('{corpus.SEED}:' || fingerprint), 1, 15) as bigint) < {int(corpus.RATE * 2**60)}""",
    "node_usage": f"select node_id, kind, name, coalesce(hits, 0) as hits, total_samples, round(coalesce(hits, 0) / total_samples, 9) as usage from {_NODES} left join (select * from {_HITS} where grammar = '{URI}') using (node_id), (select total_samples from {_TOTALS} where grammar = '{URI}')",
    "pruned_nodes": _PRUNED,
    "rare_nodes": f"select * from {_RARE}",
    "verdicts": f"""select sample_id, error is null as accepted, error, case when error = 'UNSUPPORTED_NODE' then hit end as node_id from (
 select sample_id, hit, case when coalesce(len(visited), 0) > 16384 then 'BOUNDS_EXCEEDED' when not coalesce(is_matched, false) then 'MALFORMED' when hit is not null then 'UNSUPPORTED_NODE' end as error
 from {_ONE} v left join (select sample_id, arg_min(node_id, pos) as hit from (select sample_id, unnest(visited) as node_id, generate_subscripts(visited, 1) as pos from {_ONE}) where node_id in (select node_id from {_RARE}) group by 1) using (sample_id))""",
    "restorable_nodes": f"""select shard_no, grammar, node_id, hits, round(hits / total_samples, 9) as usage from
 (select shard_no, grammar, node_id, count(distinct sample_id) as hits from (select shard_no, grammar, sample_id, unnest(visited) as node_id from {_ONE} where is_matched) group by 1, 2, 3)
 join (select shard_no, grammar, count(*) as total_samples from {_ONE} group by 1, 2) using (shard_no, grammar)
 where (grammar, node_id) in (select grammar, node_id from {_RARE}) and hits / total_samples >= {EVIDENCE_RATE}""",
    "submission_problems": _PROBLEMS,
    "distinct_certificates": f"select sha256(der) as fingerprint, min(row_id) as row_id, count(*) as copies from {_certs_sql()} group by 1",
    "log_entries": f"select row_id, sha256(der) as fingerprint from {_certs_sql()}",
}
