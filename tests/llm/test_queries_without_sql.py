"""Queries on training data that SQL can't express, on the smallest tables."""

import re

import pytest

from grammarlens.llm import pii, queries, tokens
from tests.test_queries import SF, duck, pytestmark  # noqa: F401


@pytest.fixture(scope="module")
def texts(duck):  # noqa: F811
    return dict(duck.execute("select doc_id, text from documents").fetchall())


@pytest.fixture(scope="module")
def sizes(texts):
    encoder = tokens.encoding(tokens.VOCABULARY)[0]
    return {d: encoder.encode_ordinary(t or "") for d, t in texts.items()}


def test_ids_of_all_documents(spark, sizes):
    assert {r.doc_id: r.ids for r in queries.p7_ids(spark, SF).collect()} == sizes


def test_packing_follows_the_token_counts(spark, sizes):
    assert {r.doc_id for r in queries.p8_found(spark, SF).collect()} == {d for d, ids in sizes.items() if len(ids) > 4096}
    packs = queries.p8_pack(spark, SF).collect()
    held, room = {}, {}
    for r in packs:
        held[r.doc_id] = held.get(r.doc_id, 0) + r.n_tokens
        room[r.container_id] = room.get(r.container_id, 0) + r.n_tokens
    assert held == {d: len(ids) for d, ids in sizes.items()} and max(room.values()) <= 4096
    assert all(r.n_tokens == 4096 for r in packs if r.piece_no + 1 < len(sizes[r.doc_id]) // 4096)
    use = queries.p8_usage(spark, SF).collect()[0]
    assert (use.containers, use.tokens) == (len(room), sum(held.values()))
    assert use.unused_share == pytest.approx(1 - use.tokens / (4096 * use.containers), abs=1e-6)


def test_redacted_texts_differ_in_their_items_only(spark, texts):
    found = {}
    for r in queries.p9_found(spark, SF).collect():
        found.setdefault(r.doc_id, set()).add((r.kind, r.found))
    marks = {v: k for k, v in pii.PLACEHOLDERS.items()}
    for r in queries.p9_text(spark, SF).collect():
        before = texts[r.doc_id]
        if before is None:
            assert r.text is None
            continue
        at, items = 0, set()
        parts = re.split(f"({'|'.join(map(re.escape, marks))})", r.text)
        for i in range(0, len(parts), 2):
            assert before.startswith(parts[i], at)
            at += len(parts[i])
            if i + 1 < len(parts):
                kind = marks[parts[i + 1]]
                item = next((f for k, f in sorted(found.get(r.doc_id, ()), key=lambda x: -len(x[1])) if k == kind and before.startswith(f, at)), None)
                assert item is not None
                items.add((kind, item))
                at += len(item)
        assert at == len(before) and items == found.get(r.doc_id, set())
