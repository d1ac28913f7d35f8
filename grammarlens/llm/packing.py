"""Filling containers of fixed capacity with documents that lie close together.

A document's hashed term vector is projected to three dimensions and placed on a Hilbert
curve. Documents are range-sorted by their place on it, and each task packs its part of
the curve, one short stretch after the other: the longest document of a stretch goes first,
each into the fullest open container that has room for it. Only the emptiest containers
stay open for the next stretch, so neighbours share containers and a task's memory doesn't
grow with its part. Documents longer than a container fill containers of their
own, and what is left of them is packed like a document.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grammarlens.session import staged

CAPACITY = 4096
#: Documents along the curve that are packed together, and containers that stay open after them.
STRETCH, OPEN = 1024, 256
DIMENSIONS, BITS, BUCKETS = 3, 10, 1024
SCHEMA = "container_id bigint, doc_id bigint, piece_no int, first_token bigint, n_tokens bigint"


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of points with coordinates from 0 to 2^bits - 1, one in each row.

    Each level of the curve is the same curve reflected and turned; those moves are undone
    from the coarsest bit to the finest, then the bits are a Gray code of the place.
    """
    x = points.T.astype(np.int64).copy()
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for axis in range(len(x)):
            there = (x[axis] & bit) != 0
            swap = np.where(there, 0, (x[0] ^ x[axis]) & below)
            x[0] ^= np.where(there, below, swap)
            x[axis] ^= swap
    for axis in range(1, len(x)):
        x[axis] ^= x[axis - 1]
    turned = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turned ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= turned
    place = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in range(len(x)):
            place = (place << 1) | ((x[axis] >> level) & 1)
    return place


def _projection() -> np.ndarray:
    """A fixed random direction for each bucket that terms are hashed to."""
    return np.random.default_rng(20240501).standard_normal((BUCKETS, DIMENSIONS)).astype(np.float32)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    directions = _projection()
    for batch in batches:
        lists = batch.column(1)
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0)))
        sizes = np.diff(ends, prepend=0)
        bucket = ((flat * 2654435761) & 0xFFFFFFFF) >> 22
        sums = np.zeros((len(sizes), DIMENSIONS))
        full = np.flatnonzero(sizes)
        if len(full):
            sums[full] = np.add.reduceat(directions[bucket], (ends - sizes)[full], axis=0)
        # By the root of the size the projections of texts of one mix spread alike.
        scaled = sums / np.sqrt(np.maximum(sizes, 1))[:, None]
        cells = np.clip((np.tanh(scaled / 4) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(hilbert(cells), pa.int64())], names=["doc_id", "n", "place"])


def placed(encoded: DataFrame) -> DataFrame:
    """doc_id, number of tokens and place on the curve; documents without tokens lie in the middle."""
    return encoded.select("doc_id", "ids").mapInArrow(_placed, "doc_id bigint, n bigint, place bigint")


def _packed(batches: Iterator[pa.RecordBatch], capacity: int, stretch: int, most_open: int) -> Iterator[pa.RecordBatch]:
    base, made = TaskContext.get().partitionId() << 40, 0
    free: list[tuple[int, int]] = []  # room and number of the open containers, in order
    documents = ((d, n) for b in batches for d, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    while near := list(itertools.islice(documents, stretch)):
        out: list[tuple] = []
        rests = []
        for doc, n in near:
            whole = n // capacity if n > capacity else 0
            out += [(base + made + i, doc, i, i * capacity, capacity) for i in range(whole)]
            made += whole
            if not whole or n % capacity:
                rests.append((n - whole * capacity, doc, whole))
        # The longest first; each into the container that it fills best.
        for rest, doc, whole in sorted(rests, key=lambda x: -x[0]):
            at = bisect.bisect_left(free, (rest, -1))
            if at == len(free):
                room, number = capacity, made
                made += 1
            else:
                room, number = free.pop(at)
            out.append((base + number, doc, whole, whole * capacity, rest))
            if room > rest:
                bisect.insort(free, (room - rest, number))
        del free[: max(0, len(free) - most_open)]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["container_id", "doc_id", "piece_no", "first_token", "n_tokens"])


def packed(encoded: DataFrame, capacity: int = CAPACITY, stretch: int = STRETCH, most_open: int = OPEN) -> DataFrame:
    """container_id, doc_id, piece_no, first_token, n_tokens of every document.

    Documents without tokens (null and empty texts) take no room but are put into a
    container all the same; equal documents differ in their ids, so a text with very many
    copies is cut into several stretches; an empty table gives no rows; documents with a
    null id are packed like others.
    """
    # Written once: the range sort reads its input twice, and encoding is what costs.
    sizes = staged(placed(encoded), "sizes")
    return sizes.repartitionByRange("place", "doc_id").sortWithinPartitions("place", "doc_id").select("doc_id", "n").mapInArrow(lambda it: _packed(it, capacity, stretch, most_open), SCHEMA)


def usage(packs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """How many containers there are, what they hold and which share of them is unused."""
    return packs.agg(F.countDistinct("container_id").alias("containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).withColumn(
        "unused_share", F.expr(f"round(1 - try_divide(tokens, containers * {capacity}), 6)")
    )
