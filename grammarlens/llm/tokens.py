"""Encoding texts with a byte-level BPE by reduction over a tree of halves.

A text is halved until its parts are short, the parts are encoded, and neighbours are
joined from the bottom up. At some places the pattern begins a new piece whatever stands
around: after a letter or digit that another kind of character follows, and before white
space that follows anything else; merges never cross such a place. Joining two parts, a
window over the border grows until it reaches such a place on both sides. It is encoded
anew, and what stands left and right of it is proven to be the encoding of the whole.
Joining is associative, so the leaves of very long texts are also spread over tasks and
joined in rounds.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grammarlens.session import staged

#: Where the vocabularies of public tokenizers are; a parameter of everything below.
VOCABULARY = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where a piece begins in every context: no alternative of the pattern goes over these places.
BORDER = r"(?<=\p{L})(?!\p{L})|(?<=\p{N})(?!\p{N})|(?<=\S)(?=\s)"
#: Characters of a leaf; leaves that are joined in one round where they are spread over tasks.
LEAF, FAN = 1 << 10, 64
#: Texts of more characters than this are spread over tasks.
SPREAD_OVER = 1 << 20
#: Characters that are looked at on each side of a border first.
WINDOW = 32


@functools.lru_cache(maxsize=2)
def encoding(vocabulary: str):
    """The tokenizer, the pattern of sure borders and how many bytes each token has; loaded once by each Python worker."""
    import regex
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    widths = [0] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        widths[rank] = len(token)
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), regex.compile(BORDER), widths


def _border(text: str, start: int, end: int, last: bool, vocabulary: str) -> int | None:
    """The first or the last place strictly within text[start:end] at which a piece begins for sure."""
    found = None
    for m in encoding(vocabulary)[1].finditer(text, start + 1, end):
        if m.start() == end:
            break  # what follows isn't seen here
        found = m.start()
        if not last:
            break
    return found


def _tokens_of(ids: list[int], size: int, widths: list[int], last: bool) -> int:
    """How many ids, from the front or from the back, make up size bytes."""
    n = 0
    for i in reversed(ids) if last else ids:
        if size <= 0:
            break
        size -= widths[i]
        n += 1
    if size:
        raise ValueError("a token crosses the border of two pieces")
    return n


def _join(text: str, left: list[int], right: list[int], start: int, middle: int, end: int, vocabulary: str) -> list[int]:
    """The encoding of text[start:end] from those of its two parts, which meet at middle."""
    encoder, _, widths = encoding(vocabulary)
    window = WINDOW
    while True:
        a, b = max(start, middle - window), min(end, middle + window)
        # Both lie in one part with the characters beside them, so its own encoding has a piece begin there, too.
        begin = start if a == start else _border(text, a, middle, False, vocabulary)
        stop = end if b == end else _border(text, middle, b, True, vocabulary)
        if begin is not None and stop is not None:
            break
        window *= 4
    between = encoder.encode_ordinary(text[begin:stop])
    keep = len(left) - _tokens_of(left, len(text[begin:middle].encode()), widths, True)
    skip = _tokens_of(right, len(text[middle:stop].encode()), widths, False)
    return [*left[:keep], *between, *right[skip:]]


def _tree(text: str, start: int, end: int, vocabulary: str, leaf: int) -> list[int]:
    if end - start <= leaf:
        return encoding(vocabulary)[0].encode_ordinary(text[start:end])
    half = (start + end) // 2
    return _join(text, _tree(text, start, half, vocabulary, leaf), _tree(text, half, end, vocabulary, leaf), start, half, end, vocabulary)


def encode(text: str | None, vocabulary: str = VOCABULARY, leaf: int = LEAF) -> list[int]:
    """The ids of one text; none for null and empty ones."""
    return _tree(text, 0, len(text), vocabulary, leaf) if text else []


def decode(ids, vocabulary: str = VOCABULARY) -> str:
    """Decoding is concatenation: of bytes first, since a character may span tokens."""
    return encoding(vocabulary)[0].decode_bytes(list(ids)).decode("utf-8", "replace")


def _short(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            made = pa.array([encode(t, vocabulary) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), made], names=["key", "ids"])


def _encoded_leaves(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = pa.array([encode(t, vocabulary) for t in batch.column(3).to_pylist()], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([*batch.columns, made], names=["row", "key", "leaf", "text", "ids"])


def _folded(rows: pd.DataFrame, vocabulary: str) -> pd.DataFrame:
    """Neighbours in order, joined pairwise until one is left."""
    rows = rows.sort_values("leaf")
    text, at, parts = "".join(rows["text"]), 0, []
    for t, ids in zip(rows["text"], rows["ids"], strict=True):
        parts.append((at, at + len(t), list(ids)))
        at += len(t)
    while len(parts) > 1:
        pairs = zip(parts[::2], parts[1::2], strict=False)
        joined = [(a, c, _join(text, x, y, a, b, c, vocabulary)) for (a, b, x), (_, c, y) in pairs]
        parts = joined + parts[len(parts) & ~1 :]
    first = rows.iloc[0]
    return pd.DataFrame({"row": [first["row"]], "key": [first["key"]], "leaf": [first["leaf"] // FAN], "text": [text], "ids": [np.array(parts[0][2], np.int32)]})


def _long(documents: DataFrame, kind: str, vocabulary: str, chars: int) -> DataFrame:
    """key and ids of texts whose leaves are spread over tasks and joined in two rounds.

    Two rounds of FAN leaves hold more than the longest string that Spark can have.
    """
    leaves = F.expr(f"transform(sequence(0, cast(ceil(length(text) / {chars}) as int) - 1), i -> struct(i as leaf, substring(text, i * {chars} + 1, {chars}) as part))")
    # Keys may repeat or be null, so a row has a number of its own, kept by the write before the shuffle.
    numbered = staged(documents.withColumn("row", F.monotonically_increasing_id()).select("row", "key", F.inline(leaves)), "leaves")
    schema = f"row bigint, key {kind}, leaf int, text string, ids array<int>"
    # With a number of parts, which isn't lowered for leaves being few bytes: encoding them is the work.
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = numbered.repartition(tasks, "row", "leaf").mapInArrow(lambda it: _encoded_leaves(it, vocabulary), schema)
    for _ in range(2):
        parts = parts.groupBy("row", F.expr(f"leaf div {FAN}").alias("_group")).applyInPandas(lambda rows: _folded(rows, vocabulary), schema)
    return parts.select("key", "ids")


def ids(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, spread_over: int = SPREAD_OVER) -> DataFrame:
    """key and ids of every document.

    Null and empty texts have an empty list; strings of special tokens are ordinary text;
    repeated and null keys are encoded row by row; an empty table gives no rows; extra
    columns are dropped, whatever their names. Texts of more than spread_over characters,
    which a second scan looks for, are spread over tasks leaf by leaf.
    """
    kind = documents.schema[key].dataType.simpleString()
    texts = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    fits = F.col("text").isNull() | (F.length("text") <= spread_over)
    short = texts.where(fits).mapInArrow(lambda it: _short(it, vocabulary), f"key {kind}, ids array<int>")
    return short.unionByName(_long(texts.where(~fits), kind, vocabulary, max(1, spread_over // 4))).withColumnRenamed("key", key)
