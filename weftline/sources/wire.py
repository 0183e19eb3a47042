"""Protocol-buffer messages of symbol indexes, read and written without a compiled definition."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Field numbers of the published symbol-index format (fixed values): message to field to number.
FIELDS = {
    "Index": {"documents": 2},
    "Document": {"relativePath": 1, "occurrences": 2, "symbols": 3, "text": 5},
    "Occurrence": {"range": 1, "symbol": 2, "symbolRoles": 3},
    "Symbol": {"symbol": 1, "relationships": 4, "displayName": 6},
    "Relationship": {"symbol": 1, "isReference": 2, "isImplementation": 3, "isTypeDefinition": 4, "isDefinition": 5},
}
#: What a field holds, if not a text: a message, a list of numbers, a number or a truth value.
KINDS = {"documents": "Document", "occurrences": "Occurrence", "symbols": "Symbol", "relationships": "Relationship", "range": "numbers", "symbolRoles": "number", "isReference": "truth", "isImplementation": "truth", "isTypeDefinition": "truth", "isDefinition": "truth"}


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    """(number, the place behind it)."""
    number = shift = 0
    while True:
        byte, at = data[at], at + 1
        number |= (byte & 127) << shift
        if byte < 128:
            return number, at
        shift += 7


def write_varint(number: int) -> bytes:
    out = bytearray()
    while number > 127:
        out.append(number & 127 | 128)
        number >>= 7
    return bytes([*out, number])


def raw_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, number or bytes) in the order of a message; a message that ends early is an error."""
    at = 0
    while at < len(data):
        tag, at = read_varint(data, at)
        size = {1: 8, 5: 4}.get(tag & 7)
        if tag & 7 == 0:
            value, at = read_varint(data, at)
        else:
            if size is None:
                if tag & 7 != 2:
                    raise ValueError(f"unknown wire type {tag & 7}")
                size, at = read_varint(data, at)
            value, at = data[at : at + size], at + size
        if at > len(data):
            raise ValueError("the message ends early")
        yield tag >> 3, value


def decode(data: bytes, message: str, fields: dict = FIELDS) -> dict:
    """A message as a dictionary; fields that it lacks have the format's defaults, unknown ones are left out."""
    names = {n: f for f, n in fields[message].items()}
    defaults = {"numbers": list, "number": int, "truth": bool}
    out = {f: defaults[KINDS[f]]() if KINDS.get(f) in defaults else [] if f in KINDS else "" for f in fields[message]}
    for number, value in raw_fields(data):
        name = names.get(number)
        kind = KINDS.get(name)
        if name is None:
            continue
        if kind == "numbers":
            if isinstance(value, int):
                out[name].append(value)
            else:
                at = 0
                while at < len(value):
                    n, at = read_varint(value, at)
                    out[name].append(n)
        elif kind == "number":
            out[name] = value
        elif kind == "truth":
            out[name] = bool(value)
        elif kind:
            out[name].append(decode(value, kind, fields))
        else:
            out[name] = value.decode("utf-8", "replace")
    return out


def encode(values: dict, message: str, fields: dict = FIELDS) -> bytes:
    """The message of a dictionary; null and missing fields are left out."""
    out = []
    part = lambda n, data: out.append(write_varint(n << 3 | 2) + write_varint(len(data)) + data)
    for name, n in fields[message].items():
        value, kind = values.get(name), KINDS.get(name)
        if value is None:
            continue
        if kind == "numbers":
            part(n, b"".join(write_varint(x) for x in value))
        elif kind in ("number", "truth"):
            out.append(write_varint(n << 3) + write_varint(int(value)))
        elif kind:
            for x in value:
                part(n, encode(x, kind, fields))
        else:
            part(n, value.encode())
    return b"".join(out)


def decoded_indexes(files: DataFrame, schema: str, fields: dict = FIELDS) -> DataFrame:
    """The documents of indexes (a column `content` of bytes), a row for each with an array of it alone, in the given schema."""
    number = fields["Index"]["documents"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                for n, value in raw_fields(bytes(content)):
                    if n == number:
                        yield pd.DataFrame({"documents": [[decode(value, "Document", fields)]]})

    return files.select("content").mapInPandas(run, schema)
