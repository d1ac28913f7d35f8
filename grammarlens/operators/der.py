"""What certificates are made of: the tags of their DER, counted by place in the structure."""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grammarlens.functions.rowwise import with_made
from grammarlens.operators.evidence import BOUNDS, MALFORMED, UNSUPPORTED, VERDICT, verdict_columns
from grammarlens.sources import abnf, asn1

#: Names of universal tags, fixed by ASN.1.
TAGS = {1: "BOOLEAN", 2: "INTEGER", 3: "BIT STRING", 4: "OCTET STRING", 5: "NULL", 6: "OBJECT IDENTIFIER", 12: "UTF8String", 16: "SEQUENCE", 17: "SET", 19: "PrintableString", 22: "IA5String", 23: "UTCTime", 24: "GeneralizedTime"}
#: Bounds of verdicts; counting has none.
MOST_BYTES, DEEPEST = 65536, 1024


class Element(NamedTuple):
    kind: int  # 0 universal, 1 application, 2 context, 3 private
    number: int
    holds: bool
    start: int
    stop: int


def element(der: bytes, at: int, end: int) -> Element | None:
    """The element at a place, or None if it can't be read there: at most four bytes of length, and a definite one."""
    if at + 2 > end:
        return None
    first, at = der[at], at + 1
    number = first & 0x1F
    if number == 0x1F:
        number = 0
        while at < end and der[at] & 0x80:
            number, at = number << 7 | der[at] & 0x7F, at + 1
        if at >= end:
            return None
        number, at = number << 7 | der[at], at + 1
    if at >= end:
        return None
    size, at = der[at], at + 1
    if size & 0x80:
        wide = size & 0x7F
        if not 1 <= wide <= 4 or at + wide > end:
            return None
        size, at = int.from_bytes(der[at : at + wide], "big"), at + wide
    if at + size > end:
        return None
    return Element(first >> 6, number, bool(first & 0x20), at, at + size)


def places(der: bytes | None) -> list[str] | None:
    """Every element's place, like SEQUENCE/SEQUENCE/INTEGER, in order; None if anything can't be read.

    Walks with a stack of its own, so depth costs no recursion; nothing may follow the
    outermost element.
    """
    if not der:
        return None
    out, stack = [], [(0, len(der), "")]
    while stack:
        at, end, above = stack.pop()
        if at == end:
            continue
        got = element(der, at, end)
        if not got or (not above and got.stop != end):
            return None
        kind, number, holds, start, stop = got
        name = TAGS.get(number, f"UNIVERSAL {number}") if kind == 0 else f"[{('', 'APPLICATION ', '', 'PRIVATE ')[kind]}{number}]"
        place = f"{above}/{name}" if above else name
        out.append(place)
        stack.append((stop, end, above))
        if holds:
            stack.append((start, stop, place))
    return out


class Typed:
    """Walks a value along the types of a module, and is lenient as the values are.

    A required component that doesn't fit is passed over, an optional one leaves the value
    to the next; what follows the last component is ignored; a choice takes any value; an
    implicitly tagged value counts for its type without being opened.
    """

    def __init__(self, grammar: str, rules: dict[str, abnf.Node]) -> None:
        self.rules, self.grammar, self.root = rules, grammar, next(iter(rules))
        self.id = functools.cache(lambda rule, path: abnf.node_id(grammar, rule, path))
        self.deepest: int | None = None

    def order(self, der: bytes | None) -> list[str] | None:
        """Ids of the nodes that the value uses, each after those below it; None if it isn't one value of the first type."""
        got = self._rule(self.root, der, 0, len(der)) if der else None
        return got[1] if got and got[0] == len(der) else None

    def visited(self, der: bytes | None) -> list[str] | None:
        """The same nodes once each, sorted."""
        found = self.order(der)
        return found if found is None else sorted(set(found))

    def verdict(self, der: bytes | None, pruned: set[str], most_bytes: int, deepest: int) -> tuple[str | None, str | None, str | None]:
        """What is wrong with a value, the bound it breaks and the pruned node it needs: of several the first in order."""
        if der is not None and len(der) > most_bytes:
            return BOUNDS, "input_bytes", None
        try:
            self.deepest = deepest
            found = self.order(der)
        except RecursionError:
            return BOUNDS, "depth", None
        finally:
            self.deepest = None
        if found is None:
            return MALFORMED, None, None
        node = next((n for n in found if n in pruned), None)
        return (UNSUPPORTED, None, node) if node else (None, None, None)

    def _rule(self, rule: str, der: bytes, at: int, end: int, depth: int = 0) -> tuple[int, list[str]] | None:
        got = self._fit(self.rules[rule], rule, f"{rule}>body", der, at, end, depth + 1)
        return got and (got[0], [*got[1], self.id(rule, rule)])

    def _fit(self, node: abnf.Node, rule: str, path: str, der: bytes, at: int, end: int, depth: int) -> tuple[int, list[str]] | None:
        """Where the value that fits the node ends, and the nodes it uses."""
        if self.deepest is not None and depth > self.deepest:
            raise RecursionError
        child = lambda i, a, e: self._fit(node.children[i], rule, self._below(path, node, i), der, a, e, depth + 1)
        own = self.id(rule, path)
        if node.kind in ("named-type", "optional", "reference"):
            got = self._rule(node.name, der, at, end, depth) if node.kind == "reference" else child(0, at, end)
            return got and (got[0], [*got[1], own])
        value = element(der, at, end)
        if value is None:
            return None
        used: list[str] = []
        if node.kind in ("sequence", "repetition"):
            if value[:3] != (0, 17 if node.name.startswith("SET") else 16, True):
                return None
            used = (self._components if node.kind == "sequence" else self._repeats)(node, child, der, value)
        elif node.kind == "alternation":
            used = next((got[1] for i in range(len(node.children)) if (got := child(i, at, end))), [])
        elif node.kind == "tag":
            if (value.kind, str(value.number)) != (2, node.name[1:].partition("]")[0].strip()):
                return None
            if "IMPLICIT" in node.name or "EXPLICIT" not in node.name and not value.holds:
                used = [self.id(rule, self._below(path, node, 0))]
            elif got := child(0, value.start, value.stop):
                used = got[1]
            else:
                return None
        elif (tag := (asn1.STRINGS if node.kind == "string-type" else asn1.LEAVES).get(node.name)) is not None and (value.kind, value.number) != (0, tag):
            return None
        return value.stop, [*used, own]

    @staticmethod
    def _below(path: str, node: abnf.Node, i: int) -> str:
        return f"{path}>{node.children[i].kind}:{node.children[i].tag}:{i}"

    @staticmethod
    def _components(node: abnf.Node, child: Callable, der: bytes, value: Element) -> list[str]:
        used, at = [], value.start
        for i, component in enumerate(node.children):
            if at >= value.stop:
                break
            if got := child(i, at, value.stop):
                at = got[0]
                used += got[1]
            elif component.children[0].kind != "optional":
                passed = element(der, at, value.stop)
                if passed is None:
                    break
                at = passed.stop
        return used

    @staticmethod
    def _repeats(node: abnf.Node, child: Callable, der: bytes, value: Element) -> list[str]:
        used, at = [], value.start
        while at < value.stop and (inner := element(der, at, value.stop)):
            if got := child(0, at, value.stop):
                used += got[1]
            at = inner.stop
        return used


def walked(certificates: DataFrame, der: str = "der", typed: tuple[str, str] | None = None) -> DataFrame:
    """certificates with is_matched and visited, for grammarlens.operators.hits. Null bytes don't match.

    typed is the name and text of a module in ASN.1: then the nodes of the module are
    visited, else the places of the value's own structure.
    """

    def prepare():
        walk = Typed(typed[0], asn1.rules(typed[1])).visited if typed else places

        def of(values: list) -> list[pa.Array]:
            found = [walk(x) for x in values]
            return [pa.array([x is not None for x in found], pa.bool_()), pa.array([x or [] for x in found], pa.list_(pa.string()))]

        return of

    return with_made(certificates, der, "is_matched boolean, visited array<string>", prepare)


def verdicts(certificates: DataFrame, grammar: str, source: str, pruned: DataFrame, der: str = "der", most_bytes: int = MOST_BYTES, deepest: int = DEEPEST) -> DataFrame:
    """certificates with accepted, error, bound and node_id: whether they are accepted by the module without pruned nodes.

    A value over most_bytes fails for that, one nested deeper than deepest nodes for its
    depth, one that isn't of the first type as malformed, as null does, and else for the first
    pruned node in order. Nodes of other grammars are ignored; extra columns come back.
    """
    rules = asn1.rules(source)
    known = [n for n, _, _ in abnf.listed(grammar, rules)]
    # At most the nodes of this grammar.
    gone = {r.node_id for r in pruned.where(F.col("node_id").isin(known)).select("node_id").distinct().collect()}

    def prepare():
        typed = Typed(grammar, rules)
        return lambda values: verdict_columns([typed.verdict(x, gone, most_bytes, deepest) for x in values])

    return with_made(certificates, der, VERDICT, prepare)


def fingerprinted(certificates: DataFrame, der: str = "der") -> DataFrame:
    """Distinct certificates by SHA-256, of equal ones the first row: fingerprint and row_id."""
    return certificates.select(F.sha2(der, 256).alias("fingerprint"), "row_id").groupBy("fingerprint").agg(F.min("row_id").alias("row_id"), F.count("*").alias("copies"))
