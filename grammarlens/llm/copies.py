"""Lines that say the same in different writing: exact groups behind Bloom filters.

A first pass sets, for the hash of each line's canonical form, a few bits in filters
of what was seen once and what was seen again; each partition has its own, and merging
two of them moves the bits that both have seen once to those seen again. Lines whose
bits aren't all in the merged second filter are certain to be the only ones of their
kind and are put out as they are. Only the others, true repeats and a few false ones,
are shuffled and grouped by the whole canonical form, so the filters never decide
that two lines are the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grammarlens.functions.uri import is_listed
from grammarlens.session import staged

#: Bits of a segment, which is what is sent around; bits kept for a line; most bits set for a line.
SEGMENT, PER_LINE, HASHES = 1 << 15, 16, 3
#: The merged filter has at most so many segments (256 MB), which bounds what is broadcast. From 134 million
#: lines on there are fewer bits for each, of which fewer are set, and more lines take the exact way than need
#: to (a fifth of the single ones at half a billion lines, two fifths at a billion); the result is the same.
MOST_SEGMENTS = 1 << 16
#: A form is hot if it has more than this share of the lines, so there are at most 1/HOT of them.
HOT = 1e-3

def with_form(lines: DataFrame, line: str = "uri") -> DataFrame:
    """lines with their form: head, sorted parameters and fragment, reduced to letters and digits in one case.

    The line is reduced once, with the characters that divide it left in; they are then
    taken out of the parts in which they mean nothing. The three parts are joined by
    characters that none of them holds, so no two different lines meet by accident. Each
    step is a projection of its own: in one expression the costly reduction would be
    repeated wherever it is named.
    """
    ascii_ = F.lower(F.regexp_replace(line, "[^A-Za-z0-9&;?#]++", ""))  # a class of one table, much faster
    other = F.lower(F.upper(F.regexp_replace(line, r"[^\p{L}\p{Nd}&;?#]++", "")))
    reduced = lines.withColumn("_r", F.when(F.octet_length(line) == F.length(line), ascii_).otherwise(other))
    cut = reduced.withColumn("_main", F.substring_index("_r", "#", 1)).withColumn("_head", F.substring_index("_main", "?", 1))
    parts = cut.withColumn("_query", F.translate(F.substring("_main", F.length("_head") + 2, F.length("_main")), ";?", "&"))
    fragment = F.translate(F.substring("_r", F.length("_main") + 2, F.length("_r")), "&;?#", "")
    parameters = F.array_join(F.array_sort(F.filter(F.split("_query", "&"), lambda p: p != "")), "&")
    form = F.concat(F.translate("_head", "&;", ""), F.lit("?"), F.when(F.col("_query") == "", "").otherwise(parameters), F.lit("#"), fragment)
    return parts.withColumn("form", form).drop("_r", "_main", "_head", "_query")


def sized(rows: int) -> tuple[int, int]:
    """Segments of the filters for so many lines, and how many bits of them a line sets."""
    segments = min(MOST_SEGMENTS, max(1, -(-rows * PER_LINE // SEGMENT)))
    return segments, max(1, min(HASHES, round(segments * SEGMENT / max(rows, 1) / 4)))


def _places(hashes: np.ndarray, segments: int, each: int) -> np.ndarray:
    """The bits of each hash, all in one segment, as numbers of bits in the whole filter."""
    h = hashes.view(np.uint64)
    segment = (h >> np.uint64(45)) % np.uint64(segments)
    return np.concatenate([segment * np.uint64(SEGMENT) + ((h >> np.uint64(15 * i)) & np.uint64(SEGMENT - 1)) for i in range(each)]).astype(np.int64)


def _filled(batches: Iterator[pa.RecordBatch], segments: int, each: int) -> Iterator[pa.RecordBatch]:
    """The two filters of a partition, as compressed segments."""
    bits, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[np.ndarray] = []

    def folded() -> tuple[np.ndarray, np.ndarray]:
        found, at = np.unique(np.concatenate([bits, *held]), return_inverse=True)
        return found, np.bincount(at, np.concatenate([counts, np.ones(len(at) - len(counts))])).astype(np.int64)

    for batch in batches:
        held.append(_places(batch.column(0).to_numpy(zero_copy_only=False), segments, each))
        if sum(map(len, held)) > 1 << 22:
            bits, counts = folded()
            held = []
    bits, counts = folded()
    if not len(bits):
        return
    starts = [*np.flatnonzero(np.diff(bits // SEGMENT, prepend=-1)), len(bits)]

    def packed(at: np.ndarray) -> bytes:
        whole = np.zeros(SEGMENT, bool)
        whole[at % SEGMENT] = True
        return zlib.compress(np.packbits(whole).tobytes(), 1)

    for k in range(0, len(starts) - 1, 500):
        some = [(bits[a:b], counts[a:b]) for a, b in zip(starts[k : k + 500], starts[k + 1 : k + 501], strict=False)]
        keys, once, again = [int(x[0] // SEGMENT) for x, _ in some], [packed(x) for x, _ in some], [packed(x[n > 1]) for x, n in some]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(once, pa.binary()), pa.array(again, pa.binary())], names=["segment", "once", "again"])


def _merged(segment: pd.DataFrame) -> pd.DataFrame:
    """One segment of all partitions' filters, as the words of what was seen again."""
    once = again = np.zeros(SEGMENT // 8, np.uint8)
    for a, b in zip(segment["once"], segment["again"], strict=True):
        new = np.frombuffer(zlib.decompress(a), np.uint8)
        again = again | (once & new) | np.frombuffer(zlib.decompress(b), np.uint8)
        once = once | new
    words = np.packbits(np.unpackbits(again), bitorder="little").view(np.int64)
    return pd.DataFrame({"segment": segment["segment"].iloc[:1], "words": [words.tolist()]})


def seen_again(hashes: DataFrame, segments: int, each: int) -> DataFrame:
    """The merged filter of hashes (one bigint column) seen more than once: segment and its words."""
    parts = hashes.mapInArrow(lambda it: _filled(it, segments, each), "segment int, once binary, again binary")
    return parts.groupBy("segment").applyInPandas(_merged, "segment int, words array<bigint>")


def _may_repeat(words: str, h: str, each: int) -> str:
    """All bits of the hash are set in the words of its segment."""
    bit = lambda i: f"(shiftrightunsigned({h}, {15 * i}) & {SEGMENT - 1})"
    return " and ".join(f"shiftrightunsigned({words}[cast(shiftright({bit(i)}, 6) as int)], cast({bit(i)} & 63 as int)) & 1 = 1" for i in range(each))


def tested(hashed: DataFrame, rows: int) -> DataFrame:
    """hashed, which has a hash _h, with _may: whether another row may have the same. rows sets the size of the filters."""
    segments, each = sized(rows)
    # Broadcast, as it is never over MOST_SEGMENTS.
    filter_ = F.broadcast(seen_again(hashed.select("_h"), segments, each))
    met = hashed.withColumn("segment", F.expr(f"cast(shiftrightunsigned(_h, 45) % {segments} as int)")).join(filter_, "segment")
    return met.withColumn("_may", F.expr(_may_repeat("words", "_h", each))).drop("segment", "words")


def split_repeats(lines: DataFrame, rows: int, form: str = "form", both: bool = False) -> tuple[DataFrame, DataFrame]:
    """Lines that may have an equal, and lines that certainly have none.

    rows is an upper bound of the number of lines. The repeats are read several times from
    here on, so they are written once; with both, the others are written with them, or they
    would be computed once more.
    """
    # Generated columns, because a filter on projected ones would be moved below all the steps
    # of the form, where it would repeat the whole reduction each time it names the hash.
    others = [c for c in lines.columns if c != form]
    hashed = lines.select(*others, F.inline(F.array(F.struct(F.col(form), F.xxhash64(form).alias("_h")))))
    may = tested(hashed, rows).drop("_h")
    if both:
        may = staged(may, "lines")
        return may.where("_may").drop("_may"), may.where("not _may").drop("_may")
    return staged(may.where("_may").drop("_may"), "repeats"), may.where("not _may").drop("_may")


def groups(repeats: DataFrame, number: str = "uri_id", form: str = "form") -> DataFrame:
    """Each form of the possible repeats with its smallest number and how many lines have it."""
    return repeats.groupBy(form).agg(F.min(number).alias("keep_id"), F.count("*").alias("copies"))


def members(repeats: DataFrame, found: DataFrame, rows: int, number: str = "uri_id", form: str = "form") -> DataFrame:
    """Each line that isn't the smallest of its group, beside the smallest.

    Hot forms have more than HOT of all rows, so there are at most 1/HOT of them; they are
    joined by broadcast, so that a form with a third of all lines doesn't meet in one task.
    """
    most = max(1, int(rows * HOT))
    found = found.where("copies > 1")
    hot, cold = found.where(F.col("copies") > most).select(form, "keep_id"), found.where(F.col("copies") <= most).select(form, "keep_id")
    of_hot = repeats.join(F.broadcast(hot), form)
    of_cold = repeats.join(F.broadcast(hot.select(form)), form, "left_anti").join(cold, form)
    pairs = of_hot.select("keep_id", number).unionByName(of_cold.select("keep_id", number))
    return pairs.where(f"{number} <> keep_id").select("keep_id", F.col(number).alias("dup_id"))


def lines(*sources: DataFrame, number: str = "uri_id", line: str = "uri") -> DataFrame:
    """Lines of all sources that say something, with their canonical form."""
    out = None
    for s in sources:
        s = s.select(F.col(number).alias("uri_id"), F.col(line).alias("uri")).where(is_listed(F.col("uri")))
        out = s if out is None else out.unionByName(s)
    return with_form(out)
