"""Loading rows that may be broken, and setting the broken ones aside with a reason.

Blocks of rows go through one Arrow kernel, which parses all plain rows of a block and
leaves null where it can't. A block with failures is halved until the rows that fail
stand alone; only those are read by the strict reader, which either loads them after
all or names the reason. A half is judged by the nulls in its part of what was parsed,
so each row meets the kernel once.

Defined results: null, empty and blank tuples are rejects ("columns"); null, blank
and comment lines of a certificate list are no rows at all; repeated rows are each
reported; an empty table gives an empty table; further columns of the input are
ignored, whatever their names.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that are parsed at once.
BLOCK = 4096
#: Fields of a tuple.
COLUMNS = 5
U32 = 4294967295

LINK_SCHEMA = "row_id bigint, el_id bigint, el_from bigint, url string, reason string"
CERT_SCHEMA = "row_id bigint, der binary, reason string"

# Only plain rows: anything odd is left to the strict reader.
_STRING = r"'(?:[^'\\]|\\(?s:.))*'"
_PLAIN = (
    r"^[ \t\r\n]*\([ \t]*(?P<el_id>[0-9]{1,9})[ \t]*,[ \t]*(?P<el_from>[0-9]{1,9})[ \t]*,"
    r"[ \t]*'(?P<url>[A-Za-z][A-Za-z0-9+.\-]*:(?:[^'\\]|\\(?s:.))*)'[ \t]*,"
    rf"[ \t]*(?:{_STRING}|(?i:NULL))[ \t]*,[ \t]*(?:'(?P<el_index_60>(?:[^'\\]|\\(?s:.))*)'|(?i:NULL))[ \t]*\)[ \t\r\n]*[,;]?[ \t\r\n]*$"
)
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*:")
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r"}
_BASE64 = r"(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?"


def unescape(text: str) -> str:
    """A backslash stands for the next character; n, t and r are control characters."""
    return re.sub(r"\\(.)", lambda m: _ESCAPED.get(m[1], m[1]), text, flags=re.S) if "\\" in text else text


def read_fields(text: str) -> tuple[list[tuple[bool, str]], int, bool]:
    """Fields as (quoted, content), where reading ended, and whether a bracket closed it.

    Raises ValueError at the first fault of quoting. text has nothing around the tuple any more.
    """
    at, end, fields = 0, len(text), []
    opened = at < end and text[at] == "("
    at += opened
    while True:
        while at < end and text[at].isspace():
            at += 1
        if at < end and text[at] == "'":
            m = re.compile(r"'((?:[^'\\]|\\.)*)'\s*", re.S).match(text, at)
            if not m or (m.end() < end and text[m.end()] not in ",)"):
                raise ValueError("quoting")
            fields.append((True, m[1]))
            at = m.end()
        else:
            m = re.compile(r"[^,)']*").match(text, at)
            at = m.end()
            if at < end and text[at] == "'":
                raise ValueError("quoting")
            fields.append((False, m[0].strip()))
        if at == end or text[at] == ")":
            return fields, min(at + 1, end), opened and at < end
        at += 1


def bare(text: str) -> str:
    """A row without what may normally stand around its tuple: white space, and one comma or semicolon after it."""
    text = text.strip()
    return text[:-1].rstrip() if text.endswith((",", ";")) else text


def read_link(text: str | None) -> dict:
    """One tuple, strictly: its values, or the first reason that applies.

    What is normal after a tuple is taken off first, so a quoted string before it stands at the end.
    """
    text = bare(text or "")
    try:
        fields, end, closed = read_fields(text)
    except ValueError as e:
        return {"reason": str(e)}
    if len(fields) != COLUMNS or not closed or end != len(text):
        return {"reason": "columns"}
    ids = [int(x) if not quoted and re.fullmatch("[0-9]+", x) else -1 for quoted, x in fields[:2]]
    url = unescape(fields[2][1])
    if not all(0 <= x <= U32 for x in ids) or not fields[2][0] or not _SCHEME.match(url):
        return {"reason": "value"}
    if any(not quoted and x.upper() != "NULL" for quoted, x in fields[3:]) or fields[4][0] and len(unescape(fields[4][1])) > 60:
        return {"reason": "value"}
    return {"el_id": ids[0], "el_from": ids[1], "url": url}


def is_sequence(der: bytes) -> bool:
    """One SEQUENCE of definite length that ends with the last byte."""
    if len(der) < 2 or der[0] != 0x30 or der[1] in (0x80, 0xFF):
        return False
    if der[1] < 0x80:
        return len(der) == 2 + der[1]
    wide = der[1] & 0x7F
    return len(der) >= 2 + wide and len(der) == 2 + wide + int.from_bytes(der[2 : 2 + wide], "big")


def read_cert(line: str) -> dict:
    """One line of a certificate list, strictly."""
    text = line.strip()
    if not re.fullmatch(_BASE64, text):
        return {"reason": "encoding"}
    der = base64.b64decode(text)
    return {"der": der} if is_sequence(der) else {"reason": "value"}


def _links_at_once(block: pa.Array) -> pa.StructArray:
    """The plain rows of a block parsed; null at the others."""
    got = pc.extract_regex(block, _PLAIN)
    plain = pc.and_(got.is_valid(), pc.less_equal(pc.utf8_length(pc.struct_field(got, "el_index_60")), 60))
    plain = pc.fill_null(plain, False)
    url, number = pc.struct_field(got, "url"), lambda c: pc.if_else(plain, pc.struct_field(got, c), None).cast("int64")
    escaped = pc.and_(plain, pc.match_substring(url, "\\"))
    if pc.any(escaped).as_py():
        url = pc.replace_with_mask(url, pc.fill_null(escaped, False), pa.array([unescape(x) for x in url.filter(escaped).to_pylist()], pa.string()))
    return pa.StructArray.from_arrays([number("el_id"), number("el_from"), url], ["el_id", "el_from", "url"], mask=pc.invert(plain))


def _certs_at_once(block: pa.Array) -> pa.StructArray:
    text = pc.utf8_trim_whitespace(block)
    sound = pc.fill_null(pc.match_substring_regex(text, f"^{_BASE64}$"), False)
    ders = [base64.b64decode(x) if y else None for x, y in zip(text.to_pylist(), sound.to_pylist(), strict=True)]
    bad = pa.array([d is None or not is_sequence(d) for d in ders], pa.bool_())
    return pa.StructArray.from_arrays([pa.array(ders, pa.binary())], ["der"], mask=bad)


def broken(parsed: pa.StructArray, at: int = 0) -> Iterator[int]:
    """The rows that failed, found by halving the parts that hold a failure."""
    if not parsed.null_count:
        return
    if len(parsed) == 1:
        yield at
        return
    half = len(parsed) // 2
    yield from broken(parsed.slice(0, half), at)
    yield from broken(parsed.slice(half), at + half)


def _loaded(batches: Iterable[pa.RecordBatch], at_once: Callable, strict: Callable, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            ids, texts = (batch.column(c).slice(at, BLOCK) for c in (0, 1))
            parsed = at_once(texts)
            odd = list(broken(parsed))
            read = [strict(texts[i].as_py()) for i in odd]
            mask = np.zeros(len(texts), bool)
            mask[odd] = True
            columns = [ids]
            for field in list(schema)[1:]:
                i = parsed.type.get_field_index(field.name)
                column = parsed.field(i).cast(field.type) if i >= 0 else pa.nulls(len(texts), field.type)
                columns.append(pc.replace_with_mask(column, pa.array(mask), pa.array([x.get(field.name) for x in read], field.type)) if odd else column)
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def load_links(rows: DataFrame, row_id: str = "row_id", raw: str = "raw_tuple") -> DataFrame:
    """Every row of a link dump with its values, or with the reason why it can't be read."""
    schema = pa.schema([("row_id", pa.int64()), ("el_id", pa.int64()), ("el_from", pa.int64()), ("url", pa.string()), ("reason", pa.string())])
    return rows.select(F.col(row_id).alias("row_id"), F.col(raw).alias("raw")).mapInArrow(
        lambda it: _loaded(it, _links_at_once, read_link, schema), LINK_SCHEMA
    )


def is_cert_line(line: Column) -> Column:
    """Neither null nor blank nor a comment."""
    return line.isNotNull() & line.rlike(r"^[\s\x1c-\x1f\x85\p{Z}]*[^\s\x1c-\x1f\x85\p{Z}#]")


def load_certs(rows: DataFrame, row_id: str = "row_id", line: str = "cert_line") -> DataFrame:
    """Every certificate line with its bytes, or with the reason why it can't be read."""
    schema = pa.schema([("row_id", pa.int64()), ("der", pa.binary()), ("reason", pa.string())])
    return rows.where(is_cert_line(F.col(line))).select(F.col(row_id).alias("row_id"), F.col(line).alias("line")).mapInArrow(
        lambda it: _loaded(it, _certs_at_once, read_cert, schema), CERT_SCHEMA
    )


def rejects(loaded: DataFrame, src_table: str) -> DataFrame:
    """The rows set aside, beside the name of their table."""
    return loaded.where("reason is not null").select(F.lit(src_table).alias("src_table"), "row_id", "reason")
