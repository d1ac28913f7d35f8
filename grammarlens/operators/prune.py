"""Which nodes of a grammar are used too little to keep, and the grammar without them.

A grammar is a graph of some hundred nodes. Usage comes from data; the graph itself is
walked by joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grammarlens.session import staged

#: A graph with up to so many edges is walked in one place; grammars have some hundred.
MOST_EDGES = 1 << 17


def reachable(start: DataFrame, edges: DataFrame, parent: str = "parent_id", child: str = "child_id") -> DataFrame:
    """node_id of start and all that can be reached from it along edges; edges may form cycles.

    A graph of more than MOST_EDGES edges is walked by joins, one round for each step away
    from start, each of which looks at what the round before it found.
    """
    links = edges.select(F.col(parent).alias("_from"), F.col(child).alias("_to")).distinct()
    some = links.limit(MOST_EDGES + 1).collect()
    found = staged(start.select("node_id").distinct(), "found")
    if len(some) <= MOST_EDGES and found.limit(MOST_EDGES + 1).count() <= MOST_EDGES:
        below: dict[str, list[str]] = {}
        for e in some:
            below.setdefault(e["_from"], []).append(e["_to"])
        todo = [r.node_id for r in found.collect()]
        seen = set(todo)
        while todo:
            new = [n for n in below.get(todo.pop(), ()) if n not in seen]
            seen.update(new)
            todo += new
        return start.sparkSession.createDataFrame([(n,) for n in seen], "node_id string")
    links, last = staged(links, "links"), found
    while True:
        new = staged(last.withColumnRenamed("node_id", "_from").join(links, "_from").select(F.col("_to").alias("node_id")).distinct().join(found, "node_id", "left_anti"), "found")
        if new.isEmpty():
            return found
        found, last = found.unionByName(new), new


def protection(used: DataFrame, edges: DataFrame, protected: DataFrame, threshold: float) -> DataFrame:
    """node_id of everything that has to stay so that the protected nodes can be written out.

    used: nodes with usage. Downward: the parts of protected nodes, and whole rules that
    these refer to if they are under the threshold themselves, and so on. Upward: references
    to protected rules, what encloses them inside their rule, and the literals beside them.
    """
    ours = protected.select("node_id").join(used, "node_id", "left_semi")
    rules = used.where("kind = 'rule'").select(F.col("node_id").alias("rule_id"), "name", "usage")
    refers = used.where("kind = 'reference'").select("node_id", "name").join(rules, "name")
    # A reference to a rarely used rule leads to that rule, like an edge.
    down = edges.select("parent_id", "child_id").unionByName(refers.where(F.col("usage") < threshold).select(F.col("node_id").alias("parent_id"), F.col("rule_id").alias("child_id")))
    keep = reachable(ours, down)
    to_protected = refers.join(ours.withColumnRenamed("node_id", "rule_id"), "rule_id", "left_semi").select("node_id")
    inside = edges.join(used.where("kind = 'rule'").select(F.col("node_id").alias("parent_id")), "parent_id", "left_anti")
    around = reachable(to_protected, inside, "child_id", "parent_id")
    above = around.join(to_protected, "node_id", "left_anti").join(used.where("kind = 'sequence'"), "node_id", "left_semi")
    literals = edges.join(above.withColumnRenamed("node_id", "parent_id"), "parent_id", "left_semi").select(F.col("child_id").alias("node_id")).join(used.where("kind = 'terminal'"), "node_id", "left_semi")
    return reduce(DataFrame.unionByName, [keep, around, literals]).distinct()


def pruned(used: DataFrame, edges: DataFrame, protected: DataFrame, threshold: float = 0.001) -> DataFrame:
    """The nodes under the threshold that nothing protects."""
    used, edges = staged(used, "used"), staged(edges, "edges")
    return used.where(F.col("usage") < threshold).join(protection(used, edges, protected, threshold), "node_id", "left_anti")


def generated(grammar: str, nodes: list[dict], edges: list[dict], dropped: set[str], threshold: float) -> str:
    """A file with the grammar without the dropped nodes: a header, and around ASN.1 a module.

    Which notation it is follows from the kinds of nodes. Dropped nodes of another grammar are an error.
    """
    if other := sorted({d.partition(":")[0] for d in dropped} - {grammar}):
        raise ValueError(f"nodes of {other[0]} can't be taken out of {grammar}")
    asn1 = any(n["kind"] in ("tag", "string-type", "named-type") for n in nodes)
    note = "--" if asn1 else ";"
    head = f"{note} Reduced grammar of {grammar} (generated).\n{note} {len(dropped)} nodes pruned below usage threshold {threshold}.\n\n"
    body = written(nodes, edges, dropped, asn1)
    return head + (f"{grammar.replace('-', '_')} DEFINITIONS ::= BEGIN\n\n{body}\nEND\n" if asn1 else body)


def written(nodes: list[dict], edges: list[dict], dropped: set[str], asn1: bool = False) -> str:
    """The grammar without the dropped nodes, as ABNF or as assignments in ASN.1.

    nodes and edges are the collected rows of one grammar.
    """
    by_id, below = {n["node_id"]: n for n in nodes}, {}
    for e in sorted(edges, key=lambda e: e["pos"]):
        below.setdefault(e["parent_id"], []).append(e["child_id"])

    def text(node_id: str) -> str:
        """Empty if nothing is left of the node."""
        if node_id in dropped:
            return ""
        kind, name = by_id[node_id]["kind"], by_id[node_id]["name"]
        if kind in ("terminal", "string-type", "reference"):
            return name
        parts = [t for t in map(text, below.get(node_id, ())) if t]
        if not parts:
            return ""
        first, braced = parts[0], "{ " + ", ".join(parts) + " }"
        match kind:
            case "alternation":
                return f"CHOICE {braced}" if asn1 else " / ".join(parts)
            case "sequence":
                return f"{name} {braced}" if asn1 else " ".join(parts)
            case "optional":
                return f"{first} OPTIONAL" if asn1 else f"[ {first} ]"
            case "group":
                return f"( {first} )"
            case "repetition" if not asn1:
                return name.partition("(")[0] + first
            case _:
                return f"{name} {first}"

    ordered = sorted((n for n in nodes if n["kind"] == "rule" and n["node_id"] not in dropped), key=lambda n: n["rule_no"])
    bodies = [(n["name"], text(below[n["node_id"]][0])) for n in ordered]
    return "".join(f"{name} {'::=' if asn1 else '='} {body}\n" for name, body in bodies if body)
