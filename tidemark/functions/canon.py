"""Canonical forms of identifiers and row images, all as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n "

#: The columns of UUID type of each table that has some.
UUID_FIELDS = {
    "public.cards": ("id", "board_id"),
    "public.boards": ("id", "owner_id"),
    "public.tasks": ("ref_id",),
}

#: The columns of public.issues besides its key.
ISSUE_COLUMNS = (
    "title", "status", "priority", "assignee", "project",
    "estimate", "created_day", "completed_day", "cycle_days",
)

_STR = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_NUM_EXP = r"-?\d+(?:\.\d+)?[eE][+-]?\d+"


def ident(c: Column) -> Column:
    """Lower case without blanks at the ends; null stays null."""
    return F.lower(F.btrim(c, F.lit(BLANKS)))


def lsn(c: Column) -> Column:
    """A log position as BIGINT from decimal text or ``HI/LO`` hexadecimal halves; else null."""
    t = F.btrim(c, F.lit(BLANKS))
    hi = F.conv(F.split_part(t, F.lit("/"), F.lit(1)), 16, 10).cast("decimal(20,0)")
    lo = F.conv(F.split_part(t, F.lit("/"), F.lit(2)), 16, 10).cast("decimal(20,0)")
    hexed = (hi * F.lit(1 << 32).cast("decimal(20,0)") + lo).try_cast("bigint")
    return F.when(t.rlike(r"^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$"), hexed).otherwise(t.try_cast("bigint"))


def table_name(c: Column) -> Column:
    """``schema.name`` in lower case; quotes and outer blanks dropped, no schema means ``public``."""
    t = F.regexp_replace(F.lower(c), r'["\s]+', "")
    return F.when(F.instr(t, ".") > 0, t).otherwise(F.concat(F.lit("public."), t))


def uuid(c: Column) -> Column:
    """Lower-case 8-4-4-4-12 of every text form PostgreSQL reads; other text lower-cased."""
    h = F.regexp_replace(F.lower(c), r"[{}\-\s]", "")
    dashed = F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
        F.substring(h, 17, 4), F.substring(h, 21, 12),
    )
    return F.when(c.isNull(), F.lit(None).cast("string")).when(F.length(h) == 32, dashed).otherwise(F.lower(c))


def number_text(c: Column) -> Column:
    """Text of a number by value: ``7``, ``7.0`` and ``7e0`` are all ``7``; other text is kept."""
    d = c.try_cast("decimal(38,10)")
    plain = F.regexp_replace(d.cast("string"), r"\.?0+$", "")
    return F.when(c.rlike(r"^-?(0|[1-9][0-9]*)$"), c).otherwise(F.coalesce(plain, c))


def row_key(image: Column, key_type: Column, field: str = "id") -> Column:
    """The key field of a row image as text, in the canonical form of its type."""
    raw = F.get_json_object(image, f"$.{field}")
    return F.when(key_type == "uuid", uuid(raw)).otherwise(number_text(raw))


def plain_numbers(image: Column) -> Column:
    """JSON text in which numbers with exponents are written out; all else as it is."""
    tokens = F.regexp_extract_all(image, F.lit(rf'{_STR}|{_NUM_EXP}|[^"]'), F.lit(0))
    plain = F.transform(
        tokens,
        lambda t: F.when(
            t.rlike(rf"^{_NUM_EXP}$"), F.coalesce(t.try_cast("decimal(38,12)").cast("string"), t)
        ).otherwise(t),
    )
    return F.when(image.rlike(rf"[:\[,]\s*{_NUM_EXP}"), F.array_join(plain, "")).otherwise(image)


def json_canonical(image: Column) -> Column:
    """One text for all spellings of a JSON value.

    Object fields are sorted, blanks and null fields dropped, numbers written by value; the order
    in arrays stays.  Numbers with exponents are rewritten first, then the VARIANT form sorts the
    fields.  Text that is not JSON is kept as it is (trimmed); null stays null.
    """
    text = F.to_json(F.try_parse_json(plain_numbers(image)))
    no_tail = F.regexp_replace(text, rf',{_STR}:null(?=[,}}])|({_STR})', "$1")
    no_nulls = F.regexp_replace(no_tail, rf'(\{{){_STR}:null,?|({_STR})', "$1$2")
    return F.coalesce(
        F.when(F.instr(text, ":null") > 0, no_nulls).otherwise(text), F.btrim(image, F.lit(BLANKS))
    )


def image_hash(image: Column, table: Column) -> Column:
    """A 64-bit digest of a row image by value, never 0 (0 is free to mean "no row").

    Digests are only compared between successive states of one row, so over 10^11 changes the
    chance of a single false match is about 5e-9.  Fields of UUID type count by value.
    """
    text = json_canonical(image)
    fields = sorted({f for fs in UUID_FIELDS.values() for f in fs})
    masked = F.regexp_replace(text, rf'"({"|".join(fields)})":"[{{}}0-9A-Fa-f-]+"', '"$1":0')
    typed = F.xxhash64(masked, *[uuid(F.get_json_object(image, f"$.{f}")) for f in fields])
    h = F.when(table.isin(*UUID_FIELDS), typed).otherwise(F.xxhash64(text))
    return F.when(h == 0, F.lit(1).cast("bigint")).otherwise(h)
