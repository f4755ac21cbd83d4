"""PostgreSQL-flavoured semantics that differ from Spark's defaults.

Errors the served dialect turns into NULL stay NULL here under ANSI mode; NULL sorts as the
greatest value; integer division truncates.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import canon

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)

# --- order -------------------------------------------------------------------------------------


def asc(c: str | Column) -> Column:
    """Ascending, NULLs last."""
    return (F.col(c) if isinstance(c, str) else c).asc_nulls_last()


def desc(c: str | Column) -> Column:
    """Descending, NULLs first."""
    return (F.col(c) if isinstance(c, str) else c).desc_nulls_first()


def total_order(df: DataFrame, keys: list[Column]) -> list[Column]:
    """``keys`` and then every column ascending, so that ties fall alike in any run."""
    orderable = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return [*keys, *[asc(F.col(f"`{c}`")) for c in orderable]]


# --- arithmetic: overflow and division by zero give NULL ---------------------------------------


def _integral(df: DataFrame, *cols: Column) -> bool:
    return all(isinstance(f.dataType, INTEGRAL) for f in df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).schema)


def add(a: Column, b: Column) -> Column:
    return F.try_add(a, b)


def subtract(a: Column, b: Column) -> Column:
    return F.try_subtract(a, b)


def multiply(a: Column, b: Column) -> Column:
    return F.try_multiply(a, b)


def int_divide(a: Column, b: Column) -> Column:
    """Truncating quotient of integers as BIGINT; NULL for a zero divisor or an overflow."""
    a, b = a.cast("bigint"), b.cast("bigint")
    overflow = (a == F.lit(-(1 << 63))) & (b == -1)
    return F.when((b == 0) | overflow, F.lit(None).cast("bigint")).otherwise(F.call_function("div", a, b))


def divide(df: DataFrame, a: Column, b: Column) -> Column:
    """``/`` by the operands' types in ``df``: truncating on integers, else floating."""
    return int_divide(a, b) if _integral(df, a, b) else F.try_divide(a.cast("double"), b.cast("double"))


def modulo(a: Column, b: Column) -> Column:
    return F.try_mod(a, b)


def saturating_sum(c: Column) -> Column:
    """SUM of integers as BIGINT that stops at the ends of its range; NULL without values."""
    total = F.sum(c.cast("decimal(38,0)"))
    low, top = F.lit(-(1 << 63)).cast("decimal(38,0)"), F.lit((1 << 63) - 1).cast("decimal(38,0)")
    return F.when(total.isNotNull(), F.least(F.greatest(total, low), top)).cast("bigint")  # least and greatest skip NULL


# --- casts: what can't be converted is NULL ----------------------------------------------------


def to_int(c: Column, kind: str = "other") -> Column:
    """BIGINT; fractions round half away from zero; text must be an integer."""
    if kind == "text":
        return F.when(F.btrim(c).rlike(r"^[+-]?\d+$"), F.btrim(c).try_cast("bigint"))
    return F.round(c.cast("decimal(38,10)") if kind == "decimal" else c).try_cast("bigint") if kind in ("float", "decimal") else c.try_cast("bigint")


def to_float(c: Column) -> Column:
    return c.try_cast("double")


def to_bool(c: Column, kind: str = "text") -> Column:
    """From text (t, true, yes, on, 1 and their opposites, any case) or from a number (not 0)."""
    if kind == "number":
        return c != 0
    t = canon.ident(c)
    return F.when(t.isin("t", "true", "yes", "on", "1"), True).when(t.isin("f", "false", "no", "off", "0"), False)


def to_text(c: Column, kind: str = "other") -> Column:
    """Text; whole floats have no fraction (``1``, not ``1.0``)."""
    if kind != "float":
        return c.cast("string")
    whole = (c == F.floor(c)) & (F.abs(c) < F.lit(1e15))
    return F.when(whole, c.cast("decimal(20,0)").cast("string")).otherwise(c.cast("string"))


def to_uuid(c: Column) -> Column:
    """Canonical lower-case text, NULL if it isn't a UUID."""
    u = canon.uuid(c)
    return F.when(u.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), u)


def concat_text(*parts: Column) -> Column:
    """``||``: NULL if any part is."""
    return F.concat(*[p.cast("string") for p in parts])


# --- arrays ------------------------------------------------------------------------------------

COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


def any_of(c: Column, op: str, array: Column) -> Column:
    """``c op ANY(array)``; false for an empty array."""
    return F.array_contains(array, c) if op == "=" else F.exists(array, lambda e: COMPARE[op](c, e))


def parse_array(text: str) -> list:
    """The elements of an array literal such as ``{1,"a b",NULL}``.

    Unquoted NULL, booleans, integers and floats are typed, all else is text.
    """
    s = text.strip()
    if not (s.startswith("{") and s.endswith("}")):
        raise ValueError(f"not an array literal: {text!r}")
    out, i, body = [], 0, s[1:-1]
    while i < len(body):
        while i < len(body) and body[i] in " \t\n":
            i += 1
        if i < len(body) and body[i] == '"':
            value, i = "", i + 1
            while i < len(body) and body[i] != '"':
                i += body[i] == "\\"
                value += body[i] if i < len(body) else ""
                i += 1
            if i >= len(body):
                raise ValueError(f"quote without end: {text!r}")
            i += 1
            out.append(value)
        else:
            end = body.find(",", i)
            raw, i = body[i : end if end >= 0 else len(body)].strip(), end if end >= 0 else len(body)
            out.append(_element(raw))
        while i < len(body) and body[i] in " \t\n":
            i += 1
        if i >= len(body):
            break
        if body[i] != ",":
            raise ValueError(f"comma expected: {text!r}")
        i += 1
        if i >= len(body):
            raise ValueError(f"element expected: {text!r}")
    return out


def _element(raw: str):
    if not raw:
        raise ValueError("empty element")
    if raw.upper() == "NULL":
        return None
    if raw in ("t", "f") or raw.lower() in ("true", "false"):
        return raw[0] in "tT"
    for kind in (int, float):
        try:
            return kind(raw)
        except ValueError:
            pass
    return raw


# --- JSON --------------------------------------------------------------------------------------


def json_get(v: Column, key: str | int) -> Column:
    """``v -> key`` on a VARIANT: JSON null stays, missing is NULL, negative indexes count from the end."""
    if isinstance(key, int):
        if key >= 0:
            return F.try_variant_get(v, f"$[{key}]", "variant")
        items = F.try_variant_get(v, "$", "array<variant>")
        return F.when(F.size(items) >= -key, F.element_at(items, F.when(F.size(items) >= -key, F.lit(key)).otherwise(F.lit(-1))))
    escaped = key.replace("\\", "\\\\").replace("'", "\\'")
    return F.try_variant_get(v, f"$['{escaped}']", "variant")


def _render(x) -> str:
    """Text with blanks behind separators and keys by (length, bytes)."""
    if isinstance(x, dict):
        keys = sorted(x, key=lambda k: (len(k.encode()), k.encode()))
        return "{" + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {_render(x[k])}" for k in keys) + "}"
    if isinstance(x, list):
        return "[" + ", ".join(map(_render, x)) + "]"
    return json.dumps(x, ensure_ascii=False)


@F.pandas_udf(T.StringType())
def json_nested_text(s: pd.Series) -> pd.Series:
    """JSON text of objects and arrays in the served format; NULL stays NULL."""
    return s.map(lambda x: None if x is None else _render(json.loads(x)))


def json_scalar_text(v: Column, key: str | int) -> Column:
    """``v ->> key`` where the value is known to be a scalar: text, NULL for JSON null or missing."""
    got = json_get(v, key)
    return F.when(F.is_variant_null(got), F.lit(None).cast("string")).otherwise(F.try_variant_get(got, "$", "string"))


def json_get_text(v: Column, key: str | int) -> Column:
    """``v ->> key`` for any value; only objects and arrays go through Python."""
    got = json_get(v, key)
    nested = F.schema_of_variant(got).rlike("^(OBJECT|ARRAY)")
    return F.coalesce(
        F.when(nested, json_nested_text(F.when(nested, F.to_json(got)))), F.when(~nested, json_scalar_text(v, key))
    )


def json_equal(a: Column, b: Column) -> Column:
    """Equality of JSON texts by value."""
    return canon.json_canonical(a) == canon.json_canonical(b)


def like_pattern(pattern: str, escape: str = "\\", ignore_case: bool = False) -> str:
    """The regular expression of a LIKE pattern; an empty escape makes every character stand for itself."""
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        if escape and ch == escape:
            if i + 1 >= len(pattern):
                raise ValueError("pattern must not end with the escape character")
            i += 1
            out += re.escape(pattern[i])
        else:
            out += ".*" if ch == "%" else "." if ch == "_" else re.escape(ch)
        i += 1
    return ("(?si)" if ignore_case else "(?s)") + f"\\A{out}\\z"


def like(c: Column, pattern: str, escape: str = "\\", ignore_case: bool = False) -> Column:
    """``c [I]LIKE pattern ESCAPE escape``."""
    return c.rlike(like_pattern(pattern, escape, ignore_case))
