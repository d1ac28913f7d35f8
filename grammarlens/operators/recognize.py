"""Which nodes of a grammar a text uses, for grammars without recursion.

The regular expression of the root decides whether a text matches. If it does, each node
knows the part of the text that it stands for, and hands parts on to its children: the
groups of an expression cut up a sequence, the first option that matches the whole part is
the one taken, and repeated parts are cut off one by one. An ordered, greedy engine finds
the first derivation in the grammar's order, and since a part is fixed by that derivation,
so is the first derivation of the part. Parts recur (hosts, schemes, single characters),
so what a node makes of a part is remembered.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grammarlens.functions.rowwise import with_made
from grammarlens.operators.evidence import BOUNDS, MALFORMED, UNSUPPORTED, VERDICT, verdict_columns
from grammarlens.sources import abnf

#: Longer texts of a corpus are skipped, which is counted; the bound is a parameter.
MOST_BYTES = 8192
#: How many nodes a text may enter, each as often as it is entered, to be accepted.
MOST_NODES = 16384
REMEMBERED = 1 << 16


class _Place(NamedTuple):
    """A node where it stands in its rule."""

    kind: str
    name: str
    bit: int
    children: tuple[str, ...]


class Recognizer:
    def __init__(self, grammar: str, text: str) -> None:
        rules = abnf.rules(text)
        self.places: dict[str, _Place] = {}
        self.patterns: dict[str, str] = {}
        self.ids: list[str] = []
        for rule, body in rules.items():
            self.places[rule] = _Place("rule", rule, self._bit(abnf.node_id(grammar, rule, rule)), (f"{rule}>body",))
            self._place(grammar, rules, rule, body, f"{rule}>body")
        self.root = next(iter(rules))
        self.whole = re.compile(abnf.pattern(rules, self.root))
        self.used = functools.lru_cache(REMEMBERED)(self._used)
        self.entered = functools.lru_cache(REMEMBERED)(self._entered)

    def _bit(self, node_id: str) -> int:
        self.ids.append(node_id)
        return 1 << len(self.ids) - 1

    def _place(self, grammar: str, rules: dict[str, abnf.Node], rule: str, node: abnf.Node, path: str) -> None:
        below = tuple(f"{path}>{c.kind}:{c.tag}:{i}" for i, c in enumerate(node.children))
        self.places[path] = _Place(node.kind, node.name, self._bit(abnf.node_id(grammar, rule, path)), below)
        self.patterns[path] = abnf.node_pattern(rules, node)
        for child, child_path in zip(node.children, below, strict=True):
            self._place(grammar, rules, rule, child, child_path)

    @functools.cache
    def _pattern(self, *paths: str) -> re.Pattern:
        return re.compile("".join(f"({self.patterns[p]})" for p in paths))

    def mask(self, text: str) -> int | None:
        """A bit for each node used, or None if the text doesn't match."""
        return self.used(self.root, text) if self.whole.fullmatch(text) else None

    def nodes(self, mask: int) -> list[str]:
        return [self.ids[i] for i, bit in enumerate(reversed(f"{mask:b}")) if bit == "1"]

    def _parts(self, path: str, text: str) -> list[tuple[str, str]]:
        """The nodes that the node at path enters if it stands for text, in order, each with its part of it."""
        kind, name, _, below = self.places[path]
        if kind == "reference":
            return [(name, text)]
        if kind == "sequence":
            return list(zip(below, self._pattern(*below).fullmatch(text).groups(), strict=True))
        if kind == "alternation":
            return [(next(p for p in below if self._pattern(p).fullmatch(text)), text)]
        if kind == "repetition":
            return [(below[0], item) for item in self._items(below[0], text)]
        return [(below[0], text)] if below and (kind != "optional" or self._pattern(below[0]).fullmatch(text)) else []

    def _used(self, path: str, text: str) -> int:
        """The bits of the node at path and of all below it, if it stands for text."""
        bits = self.places[path].bit
        for part in dict.fromkeys(self._parts(path, text)):
            bits |= self.used(*part)
        return bits

    def _entered(self, path: str, text: str) -> int:
        """How many nodes are entered from the one at path on, itself included."""
        return 1 + sum(self.entered(*part) for part in self._parts(path, text))

    def last_of(self, wanted: int, path: str, text: str) -> int:
        """The bit of the last entered one of the wanted nodes; 0 if none is."""
        if not self.used(path, text) & wanted:
            return 0
        return next((bit for part in reversed(self._parts(path, text)) if (bit := self.last_of(wanted, *part))), 0) or self.places[path].bit

    def order(self, text: str) -> list[str] | None:
        """All nodes in the order in which they are entered, as often as they are; None if the text doesn't match."""
        if not self.whole.fullmatch(text):
            return None
        out, todo = [], [(self.root, text)]
        while todo:
            path, part = todo.pop()
            out.append(self.ids[self.places[path].bit.bit_length() - 1])
            todo += reversed(self._parts(path, part))
        return out

    def verdict(self, text: str | None, pruned: int, most_bytes: int, most_nodes: int) -> tuple[str | None, str | None, str | None]:
        """What is wrong with a text, the bound it breaks and the pruned node it needs: of several the last entered."""
        if text is None:
            return MALFORMED, None, None
        if len(text.encode()) > most_bytes:
            return BOUNDS, "input_bytes", None
        if not self.whole.fullmatch(text):
            return MALFORMED, None, None
        if self.entered(self.root, text) > most_nodes:
            return BOUNDS, "depth", None
        bit = self.last_of(pruned, self.root, text)
        return (UNSUPPORTED, None, self.ids[bit.bit_length() - 1]) if bit else (None, None, None)

    def _items(self, path: str, text: str) -> list[str]:
        """text as repeated parts of the node at path."""
        items = [m[0] for m in self._pattern(path).finditer(text) if m[0]]
        if "".join(items) == text:
            return items
        first, items = re.compile(f"({self.patterns[path]})((?:{self.patterns[path]})*)"), []
        while text:
            item, text = first.fullmatch(text).groups()
            items.append(item)
        return items


def counted(rows: DataFrame, text: str, grammar: str, source: str, by: list[str] | None = None, most_bytes: int | None = MOST_BYTES) -> DataFrame:
    """Hits of each node over rows, and under the node null all rows and those that match.

    Columns: by, grammar, node_id, hits, total_samples, skipped. Each batch is counted where
    it is, so what is shuffled doesn't grow with the length of the texts. Null texts count as
    rows that don't match; texts over most_bytes, if it is given, aren't samples and are
    counted as skipped beside them.
    """
    by = by or []
    kept = rows.select(*by, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recognizer = Recognizer(grammar, source)
        for batch in batches:
            masks, totals, hits, skipped = Counter(), Counter(), Counter(), Counter()
            for *key, t in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                key = tuple(key)
                if most_bytes is not None and t is not None and len(t) * 4 > most_bytes and len(t.encode()) > most_bytes:
                    skipped[key] += 1
                    continue
                totals[key] += 1
                if t is not None and (mask := recognizer.mask(t)) is not None:
                    masks[key, mask] += 1
            matched = Counter()
            for (key, mask), n in masks.items():  # many texts use the same nodes
                matched[key] += n
                for node in recognizer.nodes(mask):
                    hits[key, node] += n
            out = [(*k, grammar, node, n, None, None) for (k, node), n in hits.items()] + [(*k, grammar, None, matched[k], totals[k], skipped[k]) for k in totals | skipped]
            if out:
                kinds = [batch.schema.field(i).type for i in range(len(by))] + [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[*by, "grammar", "node_id", "hits", "total_samples", "skipped"])

    fields = "".join(f"`{b}` {kept.schema[b].dataType.simpleString()}, " for b in by)
    parts = kept.mapInArrow(run, f"{fields}grammar string, node_id string, hits bigint, total_samples bigint, skipped bigint")
    return parts.groupBy(*by, "grammar", "node_id").agg(*(F.sum(c).alias(c) for c in ("hits", "total_samples", "skipped")))


def verdicts(rows: DataFrame, text: str, grammar: str, source: str, pruned: DataFrame, most_bytes: int = MOST_BYTES, most_nodes: int = MOST_NODES) -> DataFrame:
    """rows with accepted, error, bound and node_id: whether a text is accepted by the grammar without pruned nodes.

    A text over most_bytes fails for that, one that doesn't match as malformed, as null does,
    one that enters more than most_nodes for its depth, and else for the pruned node that it
    enters last. Nodes of other grammars are ignored; extra columns come back, unless they
    have one of these names.
    """
    known = [n for n, _, _ in abnf.listed(grammar, source)]
    # At most the nodes of this grammar.
    gone = {r.node_id for r in pruned.where(F.col("node_id").isin(known)).select("node_id").distinct().collect()}

    def prepare():
        recognizer = Recognizer(grammar, source)
        wanted = sum(1 << i for i, n in enumerate(recognizer.ids) if n in gone)
        return lambda texts: verdict_columns([recognizer.verdict(t, wanted, most_bytes, most_nodes) for t in texts])

    return with_made(rows, text, VERDICT, prepare)
