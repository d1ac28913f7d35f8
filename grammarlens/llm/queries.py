"""The queries of problems 1 and 3 to 9, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grammarlens.functions import uri as U
from grammarlens.llm import copies, feistel, mixing, ngrams, packing, pii, reservoir, tokens
from grammarlens.operators import hits
from grammarlens.plans import corpus
from grammarlens.plans.tables import table
from grammarlens.session import staged

_STRIP = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


# --- 1: a sample that stays as data grow -------------------------------------------------


def p1_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Positions whose URI is in the sample of a stratum of a run.

    The number that is permuted is the 64-bit key of the URI, so equal URIs and redelivered
    records share their fate, and a share of the URIs is chosen rather than of the records.
    """
    records = (
        table(spark, sf, "uri_records")
        .select("stratum", "src_file", "ord", U.normalized(F.col("raw_uri")).alias("uri"))
        .where("uri is not null and not startswith(uri, '#')")
        .withColumn("uri_key", F.expr(feistel.text_key("uri")))
    )
    # The runs that choose a record are bits of a number until equal records have met, so that they meet once and not once for each run.
    strata = table(spark, sf, "strata").where("sample_rate > 0").select("run_id", "stratum_idx", "stratum", "seed", "sample_rate")
    placed = staged(strata.withColumn("_at", F.row_number().over(W.partitionBy("stratum").orderBy("run_id", "stratum_idx")) - 1).selectExpr("*", "_at div 60 as _block", "_at % 60 as _bit"), "strata")
    # The keys are made on the side of the runs and strata; Spark knows the size of their table and broadcasts it if it is small.
    keyed = feistel.with_keys(placed.select("stratum", "seed", "sample_rate", "_block", "_bit")).drop("seed")
    offered = feistel.permuted(records.join(keyed, "stratum"), "uri_key")
    bits = F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits")
    chosen = offered.where(feistel.under_rate("sample_rate")).groupBy("stratum", "src_file", "ord", "uri", "_block").agg(bits)
    runs = placed.select("run_id", "stratum_idx", "stratum", "_block", "_bit")
    return chosen.join(runs, ["stratum", "_block"]).where("shiftright(_bits, _bit) & 1 = 1").select("run_id", "stratum_idx", "stratum", "src_file", "ord", "uri")


_KEYED = f"(select n.*, s.run_id, s.stratum_idx, s.seed, s.sample_rate from {corpus.NORMALIZED} n join strata s using (stratum) where uri is not null and not starts_with(uri, '#') and s.sample_rate > 0)"
_P1 = f"""
select distinct run_id, stratum_idx, stratum, src_file, ord, uri from ({feistel.permuted_sql(_KEYED, feistel.text_key_sql('uri'), 'seed', '*')})
where sample_rate >= 1 or hi < floor(sample_rate * 4294967296) or (hi = floor(sample_rate * 4294967296) and lo < floor((sample_rate * 4294967296 - floor(sample_rate * 4294967296)) * 4294967296))
"""


# --- 3: samples of fixed size ------------------------------------------------------------


def positions(spark: SparkSession, sf: str) -> DataFrame:
    """Records as distinct positions that hold something, each under the number of its first delivery.

    A redelivery that comes later changes nothing. Written once, as the samplers read them several times.
    """
    held = table(spark, sf, "uri_records").where("raw_uri is not null and src_file is not null and ord is not null")
    first = held.groupBy("src_file", "ord", "stratum").agg(F.min(F.struct("loaded_at", "rec_id")).alias("first"))
    return staged(first.select("src_file", "ord", "stratum", F.col("first.rec_id").alias("rec_id")), "positions")


def p3_sample(spark: SparkSession, sf: str) -> DataFrame:
    return reservoir.fixed_size(positions(spark, sf), "rec_id", table(spark, sf, "sample_runs")).select("run_id", "rec_id", "src_file", "ord", "stratum")


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    """For each run and stratum how many records were kept, beside the run's total."""
    kept = staged(p3_sample(spark, sf).groupBy("run_id", "stratum").agg(F.count("*").alias("kept")), "kept")
    total = kept.groupBy("run_id").agg(F.sum("kept").alias("total_written"))
    runs = table(spark, sf, "sample_runs").select("run_id", "target_n")
    return runs.join(kept, "run_id", "left").join(total, "run_id", "left").select(
        "run_id", "target_n", "stratum", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("total_written", F.lit(0)).alias("total_written")
    )


_POSITIONS = "(select src_file, ord, stratum, arg_min(rec_id, (loaded_at, rec_id)) as rec_id from uri_records where raw_uri is not null and src_file is not null and ord is not null group by all)"
_P3 = f"""
select run_id, rec_id, src_file, ord, stratum from (
  select *, row_number() over (partition by run_id order by hi, lo) as rk from (
    {feistel.permuted_sql(f'(select * from {_POSITIONS} cross join (select run_id, target_n, seed from sample_runs where target_n > 0))', 'rec_id', 'seed', '*')}
  )) where rk <= target_n
"""


_P3R = f"""
select r.run_id, r.target_n, k.stratum, coalesce(k.kept, 0) as kept, coalesce(sum(k.kept) over (partition by r.run_id), 0)::bigint as total_written
from sample_runs r left join (select run_id, stratum, count(*) as kept from ({_P3}) group by 1, 2) k using (run_id)
"""


# --- 4: mixing strata to weights ---------------------------------------------------------


def _solved(spark: SparkSession, sf: str, records: DataFrame, goal: str) -> tuple[DataFrame, DataFrame]:
    """Each run and stratum with its exact share, target and solved multiplier, and how many records there are of each size: all are of size 1."""
    sizes = staged(records.groupBy("stratum").agg(F.count("*").alias("n")).withColumn("size", F.lit(1)), "sizes")
    strata = table(spark, sf, "strata").select("run_id", "stratum_idx", "stratum", "weight", "seed", F.expr("greatest(coalesce(max_repeats, 0), 0)").alias("max_repeats"))
    wanted = mixing.quotas(strata, table(spark, sf, "sample_runs"))
    return mixing.balanced(wanted, sizes, ["run_id", "stratum_idx"], "stratum", goal, "max_repeats"), sizes


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Strata of runs still to be made whose dual has no solution: its mass at the cap on repeats stays under the share."""
    return _solved(spark, sf, positions(spark, sf), "share")[0].where("total_written is null and not reached").select("run_id", "stratum")


def p4_mix(spark: SparkSession, sf: str) -> DataFrame:
    records = positions(spark, sf)
    solved, sizes = _solved(spark, sf, records, "target")
    return mixing.mixture(records, "rec_id", "stratum", solved, sizes, ["run_id", "stratum_idx"], "max_repeats", "seed").select(
        "run_id", "stratum_idx", "stratum", "rec_id", "src_file", "ord", "copies"
    )


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    """Target, records kept and actual share of each stratum, counted in the mixture itself."""
    kept = staged(p4_mix(spark, sf).groupBy("run_id", "stratum_idx").agg(F.sum("copies").alias("kept"), F.max("copies").alias("most_copies")), "kept")
    total = kept.groupBy("run_id").agg(F.sum("kept").alias("total"))
    wanted = mixing.quotas(table(spark, sf, "strata"), table(spark, sf, "sample_runs")).select("run_id", "stratum_idx", "stratum", "target")
    out = wanted.join(kept, ["run_id", "stratum_idx"], "left").join(total, "run_id", "left")
    return out.select(
        "run_id", "stratum_idx", "stratum", "target", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.round(F.coalesce(F.col("kept") / F.col("total"), F.lit(0.0)), 6).alias("actual_share"),
    )


_SHARES = "(select s.*, r.target_n, r.total_written, r.target_n * s.weight / sum(s.weight) over (partition by run_id) as share from strata s join sample_runs r using (run_id))"
_P4 = f"""
select run_id, stratum from {_SHARES} left join (select stratum, count(distinct (src_file, ord)) as n from uri_records where raw_uri is not null group by 1) using (stratum)
where total_written is null and coalesce(n, 0) * max_repeats < share
"""


_QUOTA = """(select * exclude (fl, ex, sm), fl + case when row_number() over (partition by run_id order by round(ex - fl, 9) desc, stratum_idx) <= (case when sm > 0 then target_n else 0 end) - sum(fl) over (partition by run_id) then 1 else 0 end as goal
 from (select *, cast(floor(ex + 1e-9) as bigint) as fl from (select *, case when sm > 0 then target_n * weight / sm else 0 end as ex
 from (select s.*, r.target_n, sum(weight) over (partition by run_id) as sm from strata s join sample_runs r using (run_id)))))"""
_GIVEN = f"(select q.*, coalesce(n, 0) as n, least(goal, coalesce(n, 0) * max_repeats) as given from {_QUOTA} q left join (select stratum, count(*) as n from {_POSITIONS} group by 1) using (stratum))"
_P4M = f"""
select run_id, stratum_idx, stratum, rec_id, src_file, ord, copies from (select *, given // n + case when rk <= given % n then 1 else 0 end as copies from (
 select *, row_number() over (partition by run_id, stratum_idx order by hi, lo) as rk from (
  {feistel.permuted_sql(f'(select p.*, g.run_id, g.stratum_idx, g.seed, g.n, g.given from {_POSITIONS} p join {_GIVEN} g using (stratum) where g.given > 0)', 'rec_id', 'seed', '*')}))) where copies > 0
"""
_P4R = f"""
select run_id, stratum_idx, stratum, goal as target, given as kept, case when n > 0 then (given + n - 1) // n else 0 end as most_copies,
 round(coalesce(given / nullif(sum(given) over (partition by run_id), 0), 0), 6) as actual_share from {_GIVEN}
"""


# --- 5: lines that differ in writing only ------------------------------------------------


def _lines(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    sources = [table(spark, sf, t) for t in ("submission_uris", "uri_sample")]
    return copies.lines(*sources), sum(s.count() for s in sources)  # counts come from the files' footers


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    all_lines, rows = _lines(spark, sf)
    repeats, _ = copies.split_repeats(all_lines.select("uri_id", "form"), rows)
    return copies.members(repeats, copies.groups(repeats), rows)


def p5_records(spark: SparkSession, sf: str) -> DataFrame:
    """One record for each form, with the line of its smallest number and the number of copies."""
    all_lines, rows = _lines(spark, sf)
    repeats, alone = copies.split_repeats(all_lines, rows, both=True)
    found = copies.groups(repeats)
    kept = repeats.join(found.select(F.col("keep_id").alias("uri_id"), "copies"), "uri_id")
    return alone.select("uri_id", "uri", F.lit(1).cast("bigint").alias("copies")).unionByName(kept.select("uri_id", "uri", "copies")).withColumnRenamed("uri_id", "keep_id")


def _reduced(sql: str) -> str:
    return rf"lower(upper(regexp_replace({sql}, '[^\p{{L}}\p{{Nd}}]+', '', 'g')))"


_PARAMETERS = f"list_sort(list_filter(list_transform(regexp_split_to_array(query, '[&;]'), lambda p: {_reduced('p')}), lambda p: p <> ''))"
_FORMS = rf"""
(select uri_id, uri, {_reduced('head')} || '?' || coalesce(array_to_string({_PARAMETERS}, '&'), '') || '#' || {_reduced('fragment')} as form
from (select uri_id, uri, regexp_extract(uri, '^([^?#]*)', 1) as head, regexp_extract(uri, '^[^?#]*\?([^#]*)', 1) as query, regexp_extract(uri, '^[^#]*#(.*)$', 1, 's') as fragment
from (select uri_id, uri from submission_uris union all select uri_id, uri from uri_sample) where regexp_matches(uri, '^{_STRIP}*[^{_STRIP[1:-1]}#]')))
"""
_P5 = f"select min(uri_id) over (partition by form) as keep_id, uri_id as dup_id from {_FORMS} qualify keep_id <> dup_id"
_P5R = f"select min(uri_id) as keep_id, arg_min(uri, uri_id) as uri, count(*) as copies from {_FORMS} group by form"

# --- 6: how often grammar nodes are visited ----------------------------------------------

_GRAMMAR = "rfc3986-uri"


def _samples(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """The matched samples, each in its first matched delivery, and the number of all samples."""
    visits = table(spark, sf, "parse_visits").where((F.col("grammar") == _GRAMMAR) & F.col("sample_id").isNotNull())
    total = visits.agg(F.countDistinct("sample_id")).first()[0]
    return hits.once(visits.where("is_matched")).select("sample_id", "visited"), total


#: Longest sequence of nodes that is counted.
_LONGEST = 3


def _nodes(spark: SparkSession, sf: str, upto: int = _LONGEST) -> DataFrame:
    samples, total = _samples(spark, sf)
    return ngrams.marked(ngrams.counted(samples, "visited", _LONGEST, upto), total)


def p6_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The sequences of length 1 among all that are counted."""
    return _nodes(spark, sf, 1).select(F.get("gram", F.lit(0)).alias("node_id"), F.col("occurrences").alias("visits"), F.col("records").alias("hits"), "total_samples", "mark")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_nodes(spark, sf).where("mark is not null").select("node_id", "mark")


def p6_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """The same for sequences of up to three nodes visited one after the other."""
    return _nodes(spark, sf).select(F.array_join("gram", " ").alias("nodes"), F.col("occurrences").alias("visits"), F.col("records").alias("hits"), "total_samples", "mark")


_ONE = f"(select sample_id, arg_min(visited, (parsed_at, visit_row)) as visited from parse_visits where grammar = '{_GRAMMAR}' and is_matched group by 1)"
_P6 = f"""
select node_id, visits, hits, total_samples, case when hits < 0.002 * total_samples then 'rare' when hits > 0.9 * total_samples then 'common' end as mark
from (select node_id, count(*) as visits, count(distinct sample_id) as hits from (select sample_id, unnest(visited) as node_id from {_ONE}) where node_id is not null group by 1),
(select count(distinct sample_id) as total_samples from parse_visits where grammar = '{_GRAMMAR}')
"""


_P6S = f"""
select nodes, visits, hits, total_samples, case when hits < 0.002 * total_samples then 'rare' when hits > 0.9 * total_samples then 'common' end as mark
from (select nodes, count(*) as visits, count(distinct sample_id) as hits from (
 select sample_id, array_to_string(visited[i:i + n - 1], ' ') as nodes from (select sample_id, visited, unnest(range(1, len(visited) + 1)) as i from {_ONE}), (values (1), (2), (3)) k(n) where i + n - 1 <= len(visited)) group by 1),
(select count(distinct sample_id) as total_samples from parse_visits where grammar = '{_GRAMMAR}')
"""


# --- 7: encoding; 8: packing -------------------------------------------------------------


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.ids(table(spark, sf, "documents"))


def p8_pack(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed(tokens.ids(table(spark, sf, "documents")))


def p8_usage(spark: SparkSession, sf: str) -> DataFrame:
    return packing.usage(p8_pack(spark, sf))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that were divided: those with a second piece."""
    return p8_pack(spark, sf).where("piece_no = 1").select("doc_id")


# --- 9: personal information -------------------------------------------------------------


def p9_text(spark: SparkSession, sf: str) -> DataFrame:
    return pii.redacted(table(spark, sf, "documents"), table(spark, sf, "name_parts")).select("doc_id", "text")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return pii.items(pii.redacted(table(spark, sf, "documents"), table(spark, sf, "name_parts")))


QUERIES = {
    f.__name__: f
    for f in (p1_sample, p3_sample, p3_report, p4_found, p4_mix, p4_report, p5_found, p5_records, p6_nodes, p6_found, p6_sequences, p7_ids, p8_pack, p8_usage, p8_found, p9_text, p9_found)
}
ORACLES = {
    "p1_sample": _P1,
    "p3_sample": _P3,
    "p3_report": _P3R,
    "p4_found": _P4,
    "p4_mix": _P4M,
    "p4_report": _P4R,
    "p5_found": _P5,
    "p5_records": _P5R,
    "p6_nodes": _P6,
    "p6_sequences": _P6S,
    "p6_found": f"select node_id, mark from ({_P6}) where mark is not null",
}
