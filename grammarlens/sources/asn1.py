"""Modules in ASN.1, as the same nodes that grammarlens.sources.abnf makes of ABNF."""

from __future__ import annotations

import re
from pathlib import Path

from grammarlens.sources.abnf import Node

#: Fixed by ASN.1: the tags of types that are told apart by their tag alone.
STRINGS = {"UTF8String": 12, "NumericString": 18, "PrintableString": 19, "TeletexString": 20, "T61String": 20, "VideotexString": 21, "IA5String": 22, "GraphicString": 25, "VisibleString": 26, "ISO646String": 26, "GeneralString": 27, "UniversalString": 28, "BMPString": 30}
LEAVES = {"BOOLEAN": 1, "INTEGER": 2, "BIT STRING": 3, "OCTET STRING": 4, "NULL": 5, "OBJECT IDENTIFIER": 6, "UTCTime": 23, "GeneralizedTime": 24}
#: Types without parts and how they are tagged in paths.
_PLAIN = {"INTEGER": "INTEGER", "BIT STRING": "BIT_STRING", "OCTET STRING": "OCTET_STRING", "OBJECT IDENTIFIER": "OID", "ANY": "ANY"} | {p: f"prim:{p}" for p in ("BOOLEAN", "NULL", "UTCTime", "GeneralizedTime", "REAL", "ENUMERATED")}
_WORDS = re.compile(r"::=|(?:BIT|OCTET)\s+STRING|OBJECT\s+IDENTIFIER|[A-Za-z][A-Za-z0-9-]*|\d+|\.\.|\S")


class _Reader:
    """Words of a module, taken from the front."""

    def __init__(self, text: str) -> None:
        uncommented = re.sub(r"--.*?(?:--|$)", "", text, flags=re.M)
        self.words = [" ".join(w.split()) for w in _WORDS.findall(uncommented)]
        self.at = 0

    def next(self, wanted: str | None = None) -> str:
        if self.at == len(self.words) or wanted not in (None, self.words[self.at]):
            raise ValueError(f"{wanted or 'more'} is missing after {' '.join(self.words[max(0, self.at - 4) : self.at])!r}")
        self.at += 1
        return self.words[self.at - 1]

    def has(self, *words: str) -> bool:
        return self.at < len(self.words) and self.words[self.at] in words

    def skip(self, *pairs: str) -> None:
        """Named numbers in braces, constraints in brackets."""
        while self.has(*(p[0] for p in pairs)):
            start, deep = self.next(), 1
            end = {"{": "}", "(": ")"}[start]
            while deep:
                word = self.next()
                deep += (word == start) - (word == end)

    def type(self) -> Node:
        word = self.next()
        if word == "[":
            number = []
            while not self.has("]"):
                number.append(self.next())
            self.next("]")
            mode, number = self.next() if self.has("IMPLICIT", "EXPLICIT") else "", " ".join(number)
            return Node("tag", f"[{number}] {mode}".rstrip(), f"tag:{number}:{mode}", (self.type(),))
        if word in ("SEQUENCE", "SET"):
            if self.has("SIZE"):
                self.next()
            self.skip("()")
            if self.has("OF"):
                self.next()
                return Node("repetition", f"{word} OF", f"{word.lower()}of", (self.type(),))
            return Node("sequence", word, word.lower(), self.components())
        if word == "CHOICE":
            return Node("alternation", "CHOICE", "choice", self.components())
        if word == "ANY" and self.has("DEFINED"):
            self.next(), self.next("BY"), self.next()
        if not word[0].isalpha() or word == "END":
            raise ValueError(f"{word!r} is no type")
        self.skip(*(("{}", "()") if word in ("INTEGER", "BIT STRING") else ("()",)))
        if word in STRINGS:
            return Node("string-type", word, f"str:{word}")
        return Node("terminal", word, _PLAIN[word]) if word in _PLAIN else Node("reference", word, f"ref:{word}")

    def components(self) -> tuple[Node, ...]:
        self.next("{")
        out = []
        while not self.has("}"):
            name, inner = self.next(), self.type()
            if self.has("OPTIONAL", "DEFAULT"):
                word = self.next()
                if word == "DEFAULT":
                    self.next()
                inner = Node("optional", word, word.lower(), (inner,))
            out.append(Node("named-type", name, f"comp:{name}", (inner,)))
            if self.has(","):
                self.next()
        self.next("}")
        return tuple(out)


def rules(text: str) -> dict[str, Node]:
    """The type of each assignment of a module, in order."""
    reader, out = _Reader(text), {}
    while reader.next() != "BEGIN":
        pass
    while reader.has("IMPORTS", "EXPORTS"):
        while reader.next() != ";":
            pass
    while not reader.has("END") and reader.at < len(reader.words):
        name = reader.next()
        if name in out or not name[0].isalpha():
            raise ValueError(f"{name}: assigned twice, or no name")
        reader.next("::=")
        out[name] = reader.type()
    if not out:
        raise ValueError("no assignments")
    return out


def vendored(name: str = "rfc5280") -> str:
    return (Path(__file__).parent / f"{name}.asn1").read_text()
