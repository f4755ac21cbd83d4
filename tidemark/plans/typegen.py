"""Client types of named queries."""

from __future__ import annotations

import json
import re

from pyspark.sql import types as T

_SCALARS = {
    "string": "string", "boolean": "boolean", "tinyint": "number", "smallint": "number", "int": "number", "float": "number", "double": "number",
    "bigint": "bigint", "date": "string", "timestamp": "string", "timestamp_ntz": "string", "binary": "Uint8Array", "variant": "unknown",
}


def type_of(t: T.DataType) -> str:
    if isinstance(t, T.ArrayType):
        inner = type_of(t.elementType)
        return f"({inner} | null)[]" if t.containsNull else f"{inner}[]"
    if isinstance(t, T.StructType):
        return "{ " + "; ".join(_field(f) for f in t) + " }"
    return "string" if isinstance(t, T.DecimalType) else _SCALARS.get(t.simpleString(), "unknown")


def _field(f: T.StructField) -> str:
    name = f.name if re.fullmatch(r"[A-Za-z_$][\w$]*", f.name) else json.dumps(f.name)
    return f"{name}: {type_of(f.dataType)}{' | null' if f.nullable else ''}"


def interface(name: str, schema: T.StructType) -> str:
    """A TypeScript interface of a query's rows."""
    return f"export interface {name}Row {{\n" + "".join(f"  {_field(f)};\n" for f in schema) + "}\n"


def module(schemas: dict[str, T.StructType]) -> str:
    """One interface per query, in order of names."""
    return "\n".join(interface(n, s) for n, s in sorted(schemas.items()))
