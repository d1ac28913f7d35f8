"""Queries that SQL can't express, against brute force on the smallest tables."""

import base64
import hashlib

import pytest

from grammarlens.operators import der, recognize
from grammarlens.plans import corpus, usage
from grammarlens.sources import abnf, asn1
from tests.test_queries import SF, duck, pytestmark  # noqa: F401


def rows(spark, name):
    return usage.QUERIES.get(name, corpus.QUERIES.get(name))(spark, SF).collect()


def fraction(uri, seed):
    return int.from_bytes(hashlib.blake2b(f"{seed}:{uri}".encode(), digest_size=8).digest(), "big") / 2**64


@pytest.fixture(scope="module")
def certs(duck):  # noqa: F811
    out = []
    for row_id, submission, line in duck.execute("select row_id, submission_id, cert_line from submission_certs").fetchall():
        text = (line or "").strip()
        try:
            raw = base64.b64decode(text, validate=True)
        except ValueError:
            continue
        if not text.startswith("#") and raw[:1] == b"\x30" and len(raw) > 1 and size(raw) == len(raw):
            out.append((row_id, submission, raw))
    return out


def size(raw):
    if raw[1] < 0x80:
        return 2 + raw[1]
    wide = raw[1] & 0x7F
    return 2 + wide + int.from_bytes(raw[2 : 2 + wide], "big") if wide and wide < 127 else -1


def test_samples_by_blake2b(spark, duck):  # noqa: F811
    uris = [r[0] for r in duck.execute(f"select distinct uri from {corpus.NORMALIZED} where uri is not null").fetchall()]
    assert {r.uri for r in rows(spark, "value_sample_blake2b")} == {u for u in uris if fraction(u, corpus.SEED) < corpus.RATE}
    pool = duck.execute(f"select stratum, uri from ({corpus.ORACLES['capped_domains']})").fetchall()
    quotas = dict(duck.execute(corpus.ORACLES["stratum_quotas"]).fetchall())
    want = {}
    for i, stratum in enumerate(sorted(quotas)):
        ranked = sorted({(fraction(u, corpus.SEED + i), u) for s, u in pool if s == stratum})
        for f, u in ranked[: quotas[stratum]]:
            want.setdefault(u, (stratum, f))
    assert {r.uri: (r.stratum, r.rank_by) for r in rows(spark, "stratified_sample_blake2b")} == want


def test_node_usage_of_uris_agrees_with_what_they_hold(spark, duck):  # noqa: F811
    found = {r.node_id: r for r in rows(spark, "uri_node_usage")}
    rule = lambda name: found[abnf.node_id(usage.URI, name, name)]
    listed = f"(select distinct stratum, uri from {corpus.NORMALIZED} where uri is not null and not starts_with(uri, '#') and strlen(uri) <= 8192)"
    total, matched, fragments, queries, escapes = duck.execute(
        f"select count(*), count(*) filter (where m), count(*) filter (where m and contains(uri, '#')), count(*) filter (where m and regexp_matches(uri, '^[^#]*\\?')), count(*) filter (where m and contains(uri, '%'))"
        f" from (select uri, regexp_full_match(uri, '{corpus.oracle_pattern('URI')}') as m from {listed})"
    ).fetchone()
    assert rule("URI").total_samples == total and len(found) == 393
    assert [rule(n).hits for n in ("URI", "scheme", "fragment", "query", "pct-encoded")] == [matched, matched, fragments, queries, escapes]
    assert all(r.hits <= matched for r in found.values())


def test_places_in_certificates(spark, certs):
    def tags(raw, at, end, above):
        while at < end:
            kind, at = raw[at], at + 1
            n, at = raw[at], at + 1
            if n & 0x80:
                n, at = int.from_bytes(raw[at : at + (n & 0x7F)], "big"), at + (n & 0x7F)
            assert kind & 0x1F != 0x1F and at + n <= end
            name = der.TAGS.get(kind & 0x1F, f"UNIVERSAL {kind & 0x1F}") if kind < 64 else f"[{kind & 0x1F}]"
            yield (place := f"{above}/{name}" if above else name)
            if kind & 0x20:
                yield from tags(raw, at, at + n, place)
            at += n

    want = {}
    for _, _, raw in certs:
        try:
            places = set(tags(raw, 0, len(raw), ""))
        except (AssertionError, IndexError):
            continue
        for p in places:
            want[p] = want.get(p, 0) + 1
    assert {r.place: r.hits for r in rows(spark, "der_hits")} == want


def test_certificates_along_their_types(spark, certs):
    typed = der.Typed(usage.X509, asn1.rules(asn1.vendored()))
    orders = {i: typed.order(raw) for i, _, raw in certs}
    found = {r.node_id: r.hits for r in rows(spark, "certificate_nodes")}
    assert len(found) == 113 and found == {n: sum(n in (o or ()) for o in orders.values()) for n in found}
    rare = {r.node_id for r in rows(spark, "rare_nodes")}
    for r in rows(spark, "certificate_verdicts"):
        first = next((n for n in orders[r.row_id] or () if n in rare), None)
        assert (r.accepted, r.node_id) == (orders[r.row_id] is not None and first is None, first)


def test_evidence_of_submissions(spark, duck, certs):  # noqa: F811
    rare = {(r.grammar, r.node_id) for r in rows(spark, "rare_nodes")}
    good = {r.submission_id for r in rows(spark, "submission_problems") if r.problem is None}
    kinds = dict(duck.execute("select submission_id, kind from submissions").fetchall())
    recognizer, typed = recognize.Recognizer(usage.URI, abnf.vendored()), der.Typed(usage.X509, asn1.rules(asn1.vendored()))
    samples = {}
    for s, uri in duck.execute("select submission_id, uri from submission_uris where uri is not null").fetchall():
        if s in good and kinds[s] == "uri" and uri.strip() and not uri.strip().startswith("#"):
            mask = recognizer.mask(uri.strip())
            samples.setdefault((s, usage.URI), []).append(set(recognizer.nodes(mask)) if mask is not None else set())
    for _, s, raw in certs:
        if s in good and kinds[s] == "cert":
            samples.setdefault((s, usage.X509), []).append(set(typed.order(raw) or ()))
    want = {}
    for (s, grammar), found in samples.items():
        for node in set().union(*found):
            n = sum(node in x for x in found)
            if (grammar, node) in rare and n / len(found) >= usage.EVIDENCE_RATE:
                want[s, node] = (n, len(found))
    assert {(r.submission_id, r.node_id): (r.hits, r.total_samples) for r in rows(spark, "submission_evidence")} == want
    added = rows(spark, "new_overrides")
    owners = dict(duck.execute("select submission_id, submitter from submissions").fetchall())
    for r in added:
        first = min(s for s, n in want if n == r.node_id)
        assert r.owner == f"rfe:{owners[first]}" and f"{want[first, r.node_id][0]} of {want[first, r.node_id][1]} samples" in r.justification
    assert len({r.node_id for r in added}) == len(added) <= len({n for _, n in want})


def test_the_reduced_grammar_can_be_read_and_lacks_what_was_pruned(spark):
    text = "\n".join(r.line for r in sorted(rows(spark, "reduced_grammar")))
    pruned = {r.node_id for r in rows(spark, "pruned_nodes")}
    left = {name for n, kind, name in abnf.listed(usage.URI, abnf.vendored()) if kind == "rule" and n not in pruned}
    assert set(abnf.rules(text)) <= left
