"""Grammars in ABNF (RFC 5234) as tables of nodes and edges, and as regular expressions.

A grammar has some hundred nodes; reading it is work for the driver, everything that
joins it with data is Spark's. Node ids are derived from the path to the node:
"<grammar>:<rule>#" and eight digits of the hash of grammar and path, where a rule has its
name as path, its body adds ">body", and a child adds ">kind:tag:position".
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

NODES = "grammar string, node_id string, kind string, name string, rule string, rule_no int, is_root boolean"
EDGES = "grammar string, parent_id string, pos int, child_id string"

_HEAD = re.compile(r"^([A-Za-z][A-Za-z0-9-]*)[ \t]*(=/|=)", re.M)
_TOKEN = re.compile(r'\s+|(?P<repeat>\d*\*\d*|\d+)|(?P<char>"[^"]*")|(?P<num>%[bdxBDX][0-9A-Fa-f]+(?:-[0-9A-Fa-f]+|(?:\.[0-9A-Fa-f]+)+)?)|(?P<prose><[^>]*>)|(?P<ref>[A-Za-z][A-Za-z0-9-]*)|(?P<mark>[()\[\]/])')


class Node(NamedTuple):
    kind: str
    name: str
    tag: str = ""
    children: tuple[Node, ...] = ()


def _uncommented(text: str) -> str:
    """Without comments; a semicolon in quotes or in prose is none."""
    return re.sub(r'("[^"\n]*"|<[^>\n]*>)|[ \t]*;[^\n]*', lambda m: m[1] or "", text)


def _tokens(text: str) -> list[tuple[str, str]]:
    at, out = 0, []
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not ABNF: {text[at : at + 20]!r}")
        if m.lastgroup:
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return out


def _choice(tokens: list[tuple[str, str]]) -> Node:
    """Consumes an alternation from the front of tokens. A choice or sequence of one is that one."""
    options: list[list[Node]] = [[]]
    while tokens and tokens[0][1] not in (")", "]"):
        if tokens[0][1] == "/":
            tokens.pop(0)
            options.append([])
        else:
            options[-1].append(_element(tokens))
    if not all(options):
        raise ValueError("an empty sequence")
    chosen = [o[0] if len(o) == 1 else Node("sequence", "sequence", "", tuple(o)) for o in options]
    return chosen[0] if len(chosen) == 1 else Node("alternation", "alternation", "", tuple(chosen))


def _element(tokens: list[tuple[str, str]]) -> Node:
    kind, text = tokens.pop(0)
    if kind == "repeat":
        if not tokens:
            raise ValueError("nothing to repeat")
        return Node("repetition", f"{text}(...)", f"repeat:{text}", (_element(tokens),))
    if kind == "mark" and text in "([":
        inner = _choice(tokens)
        if not tokens or tokens.pop(0)[1] != {"(": ")", "[": "]"}[text]:
            raise ValueError(f"{text} isn't closed")
        name = "group" if text == "(" else "optional"
        return Node(name, name, "", (inner,))
    if kind == "ref":
        return Node("reference", text, f"ref:{text}")
    if kind == "mark":
        raise ValueError(f"unexpected {text}")
    return Node("terminal", text, {"char": f"char:{text[1:-1]}", "prose": f"prose:{text[1:-1]}", "num": f"num:{text}"}[kind])


def rules(text: str) -> dict[str, Node]:
    """The body of each rule, in order; "=/" adds options to an earlier rule."""
    text = _uncommented(text)
    heads, out = list(_HEAD.finditer(text)), {}
    for head, end in zip(heads, [*(h.start() for h in heads[1:]), len(text)], strict=True):
        tokens = _tokens(text[head.end() : end])
        body, name = _choice(tokens), head[1]
        if tokens:
            raise ValueError(f"{name}: more than one body")
        if head[2] == "=/":
            if name not in out:
                raise ValueError(f"{name}: added to before it is defined")
            both = [c for b in (out[name], body) for c in (b.children if b.kind == "alternation" else (b,))]
            body = Node("alternation", "alternation", "", tuple(both))
        elif name in out:
            raise ValueError(f"{name}: defined twice")
        out[name] = body
    if not out:
        raise ValueError("no rules")
    return out


def node_id(grammar: str, rule: str, path: str) -> str:
    return f"{grammar}:{rule}#{hashlib.sha256(f'{grammar}|{path}'.encode()).hexdigest()[:8]}"


def _walk(grammar: str, rule: str, no: int, node: Node, path: str, parent: str, pos: int) -> Iterator[tuple]:
    own = node_id(grammar, rule, path)
    yield (grammar, own, node.kind, node.name, rule, no, False), (grammar, parent, pos, own)
    for i, child in enumerate(node.children):
        yield from _walk(grammar, rule, no, child, f"{path}>{child.kind}:{child.tag}:{i}", own, i)


def listed(grammar: str, source: str | dict[str, Node]) -> list[tuple[str, str, str]]:
    """Id, kind and name of every node. source is ABNF or rules that were read already."""
    out = []
    for no, (rule, body) in enumerate((rules(source) if isinstance(source, str) else source).items()):
        out.append((node_id(grammar, rule, rule), "rule", rule))
        out += [(n[1], n[2], n[3].replace("'", "''")) for n, _ in _walk(grammar, rule, no, body, f"{rule}>body", "", 0)]
    return out


def linked(grammar: str, source: str | dict[str, Node]) -> list[tuple[str, str]]:
    """Parent and child of every edge."""
    every = (rules(source) if isinstance(source, str) else source).items()
    return [(e[1], e[3]) for no, (rule, body) in enumerate(every) for _, e in _walk(grammar, rule, no, body, f"{rule}>body", node_id(grammar, rule, rule), 0)]


def graph(spark: SparkSession, grammar: str, source: str | dict[str, Node]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a grammar, which is ABNF or rules that were read already. The first rule is the root."""
    nodes, edges = [], []
    for no, (rule, body) in enumerate((rules(source) if isinstance(source, str) else source).items()):
        own = node_id(grammar, rule, rule)
        nodes.append((grammar, own, "rule", rule, rule, no, no == 0))
        for node, edge in _walk(grammar, rule, no, body, f"{rule}>body", own, 0):
            nodes.append(node)
            edges.append(edge)
    if len({n[1] for n in nodes}) < len(nodes):
        raise ValueError("two nodes have one id")
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def vendored(name: str = "rfc3986") -> str:
    return (Path(__file__).parent / f"{name}.abnf").read_text()


# --- as a regular expression -------------------------------------------------------------


def node_pattern(all_rules: dict[str, Node], node: Node) -> str:
    """A regular expression of what one node of a grammar matches."""
    return pattern({**all_rules, "": node}, "")


def _set(node: Node, all_rules: dict[str, Node]) -> str | None:
    """The inside of a character class, if the node matches single characters only."""
    if node.kind == "reference":
        return _set(all_rules[node.name], all_rules)
    if node.kind == "group":
        return _set(node.children[0], all_rules)
    if node.kind == "alternation":
        sets = [_set(c, all_rules) for c in node.children]
        return None if None in sets else "".join(sets)
    if node.kind == "terminal" and node.name[0] == '"' and len(node.name) == 3:
        c = node.name[1]
        return "".join(f"\\x{ord(x):02X}" for x in dict.fromkeys((c.lower(), c.upper())))
    if node.kind == "terminal" and node.name[0] == "%" and "." not in node.name:
        base = {"b": 2, "d": 10, "x": 16}[node.name[1].lower()]
        return "-".join(f"\\x{int(x, base):02X}" for x in node.name[2:].split("-"))
    return None


def pattern(all_rules: dict[str, Node], rule: str) -> str:
    """A regular expression of what a rule matches, for grammars without recursion.

    Options that are single characters become one class. What is repeated without a limit is
    taken at once and not given back, which keeps matching linear and its stack flat. The
    delimiters of a grammar like RFC 3986, which never stand in what is repeated before
    them, allow that.
    """

    def of(node: Node, within: tuple[str, ...], repeated: bool = False) -> str:
        if (chars := _set(node, all_rules)) is not None:
            return f"[{chars}]"
        if node.kind == "reference":
            if node.name in within:
                raise ValueError(f"{node.name} is recursive")
            return of(all_rules[node.name], (*within, node.name), repeated)
        if node.kind == "terminal":
            if node.name[0] == '"':
                return f"(?i:{re.escape(node.name[1:-1])})"
            if node.name[0] == "<":
                return r"[^\s\S]"  # prose says what no pattern can
            base = {"b": 2, "d": 10, "x": 16}[node.name[1].lower()]
            return "".join(f"\\x{int(x, base):02X}" for x in node.name[2:].split("."))
        if node.kind == "sequence":
            return "".join(of(c, within) for c in node.children)
        if node.kind == "optional":
            return f"(?:{of(node.children[0], within)})?"
        if node.kind == "group":
            return f"(?:{of(node.children[0], within, repeated)})"
        if node.kind == "repetition":
            low, star, high = node.name.removesuffix("(...)").partition("*")
            open_ended = bool(star) and not high and low in ("", "0", "1")
            inner = of(node.children[0], within, open_ended)
            times = "+" if open_ended and low == "1" else "*" if open_ended else f"{{{low or 0}{',' * bool(star)}{high}}}"
            # Java recurses for each round of a group that it may give back, but not for one that it keeps.
            return inner + times if _set(node.children[0], all_rules) else f"(?:{inner}){times}" + "+" * open_ended
        options = _flat(node, all_rules)
        sets = [s for c in options if (s := _set(c, all_rules)) is not None]
        others = [of(c, within) for c in options if _set(c, all_rules) is None]
        return "(?:" + "|".join([f"[{''.join(sets)}]" + "++" * repeated] * bool(sets) + others) + ")"

    return of(Node("reference", rule), ())


def _flat(node: Node, all_rules: dict[str, Node]) -> list[Node]:
    """Options of an alternation, and of those that are alternations of rules with single characters."""
    out = []
    for c in node.children:
        target = all_rules[c.name] if c.kind == "reference" else c
        out += _flat(target, all_rules) if target.kind == "alternation" and any(_set(x, all_rules) for x in target.children) else [c]
    return out
