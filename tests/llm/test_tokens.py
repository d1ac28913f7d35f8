import os
import random

import pytest

from grammarlens.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary")
HARD = [" " * 300 + "a", " \n\n  \t" * 200, "'ll" * 300, "don't we'll they've" * 50, "'" * 500, "x" * 3000 + " 1" * 100, "é ñ " * 100, "日本語 " * 200 + " 　 " * 99, "🙂👩‍👩‍👧 " * 100, " 's't're" * 200, "a" + " " * 999 + "'s", "<|endoftext|> <|endoftext|>"]


def whole(text):
    return tokens.encoding(tokens.VOCABULARY)[0].encode_ordinary(text)


@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 16, 100])
@pytest.mark.parametrize("window", [1, 4, 256])
def test_every_tree_gives_the_same_ids(leaf, window, monkeypatch):
    monkeypatch.setattr(tokens, "WINDOW", window)
    rng = random.Random(leaf)
    alphabet = [" ", "'", "l", "s", "\n", "a", "1", "é", "日", "!", "  ", "ll", "ve"]
    for text in HARD + ["".join(rng.choices(alphabet, k=rng.randint(1, 400))) for _ in range(300)]:
        assert list(tokens.encode(text, leaf=leaf)) == whole(text)
        assert tokens.decode(whole(text)) == text


def test_documents(spark):
    rng = random.Random(1)
    long = "".join(rng.choices(["a", " ", "  ", "\n", "'ll", "é", "1", "word ", "日"], k=60_000))
    rows = [(1, None), (2, ""), (3, "hello <|endoftext|>"), (3, "hello <|endoftext|>"), (None, "x"), (4, long), (4, long), (5, " " * 70_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as row")
    for limit in (1 << 20, 30_000):  # the second spreads the long texts over tasks
        got = sorted(((r.doc_id or 0, r.ids) for r in tokens.ids(df, spread_over=limit).collect()), key=lambda x: (x[0], len(x[1])))
        want = sorted(((d or 0, whole(t) if t else []) for d, t in rows), key=lambda x: (x[0], len(x[1])))
        assert got == want
    assert tokens.ids(df.where("false")).count() == 0
    assert tokens.ids(df.where("false"), spread_over=1).count() == 0


def test_a_giant_text_is_encoded_by_several_tasks(spark, tmp_path, monkeypatch):
    log = tmp_path / "tasks"
    log.mkdir()
    once = tokens._encoded_leaves

    def noted(batches, vocabulary):
        from pyspark import TaskContext

        for b in once(batches, vocabulary):
            (log / str(TaskContext.get().partitionId())).touch()
            yield b

    monkeypatch.setattr(tokens, "_encoded_leaves", noted)
    text = "word, 1 don't  日本語\n" * 20_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert tokens.ids(df, spread_over=40_000).collect()[0].ids == whole(text)
    assert len(list(log.iterdir())) > 1
