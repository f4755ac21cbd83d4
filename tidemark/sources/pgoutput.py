"""Frames of PostgreSQL's logical replication protocol ("pgoutput") as a typed change log.

Frames are read in parallel by segment.  A frame needs three things that came before it: its
relation, its transaction, and whether it lies in a streamed block.  Decoding carries them within a
segment; what spans segments is joined afterwards: streamed rows meet their commit by transaction
id, and rows of aborted transactions drop out.  Layouts follow the public protocol documentation.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import ship

#: Type OIDs whose text is a JSON number, a boolean, or JSON itself.
NUMBERS, BOOL, JSON_TYPES = {20, 21, 23, 26, 700, 701, 1700}, 16, {114, 3802}

DECODED = (
    "segment BIGINT, position BIGINT, kind STRING, `table` STRING, xid BIGINT, sub BIGINT, lsn BIGINT, op STRING, old STRING, new STRING, "
    "unchanged_cols ARRAY<STRING>"
)


class FrameError(ValueError):
    """A frame that doesn't follow the protocol."""


class Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise FrameError(f"frame ends early at {self.at}")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, code: str) -> int:
        return struct.unpack(">" + code, self.take(struct.calcsize(">" + code)))[0]

    def text(self) -> str:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise FrameError("text without end")
        out = self.data[self.at : end].decode()
        self.at = end + 1
        return out


def _value(text: str, oid: int) -> str:
    """JSON text of a column's text form."""
    if oid == BOOL:
        return "true" if text in ("t", "true") else "false"
    if oid in NUMBERS:
        try:
            return text if isinstance(json.loads(text), (int, float)) else json.dumps(text)
        except ValueError:  # NaN, Infinity
            return json.dumps(text)
    return text if oid in JSON_TYPES else json.dumps(text, ensure_ascii=False)


class Decoder:
    """State of one segment: relations by OID, the open transaction, the open streamed block."""

    def __init__(self, relations: dict[int, dict] | None = None) -> None:
        self.relations = dict(relations or {})
        self.xid: int | None = None
        self.lsn: int | None = None
        self.streamed: int | None = None
        self.handlers: dict[str, Callable[[Reader], list[dict]]] = {
            "B": self.begin, "C": self.commit, "R": self.relation, "I": self.insert, "U": self.update, "D": self.delete, "T": self.truncate,
            "S": self.stream_start, "E": self.stream_stop, "c": self.stream_commit, "A": self.stream_abort,
            "Y": self.ignore, "O": self.ignore, "M": self.ignore,
            "b": self.begin_prepare, "P": self.ignore, "K": self.commit_prepared, "r": self.rollback_prepared, "p": self.ignore,
        }

    def decode(self, frame: bytes) -> list[dict]:
        r = Reader(bytes(frame))
        tag = r.take(1).decode("latin-1")
        if tag not in self.handlers:
            raise FrameError(f"unknown tag {tag!r}")
        if self.streamed is not None and tag in "RIUDTYM":
            self.xid = r.number("i")
        return self.handlers[tag](r)

    def ignore(self, r: Reader) -> list[dict]:
        return []

    def begin(self, r: Reader) -> list[dict]:
        self.lsn, _, self.xid = r.number("q"), r.number("q"), r.number("i")
        return []

    def commit(self, r: Reader) -> list[dict]:
        self.lsn = self.xid = None
        return []

    def begin_prepare(self, r: Reader) -> list[dict]:
        """Rows of a prepared transaction wait for its COMMIT PREPARED like streamed ones."""
        r.number("q"), r.number("q"), r.number("q")
        self.xid, self.lsn = r.number("i"), None
        return []

    def commit_prepared(self, r: Reader) -> list[dict]:
        r.number("b")
        lsn = r.number("q")
        r.number("q"), r.number("q")
        return [{"kind": "commit", "xid": r.number("i"), "lsn": lsn}]

    def rollback_prepared(self, r: Reader) -> list[dict]:
        r.number("b")
        r.number("q"), r.number("q"), r.number("q"), r.number("q")
        return [{"kind": "abort", "sub": r.number("i")}]

    def stream_start(self, r: Reader) -> list[dict]:
        self.streamed, self.lsn = r.number("i"), None
        return []

    def stream_stop(self, r: Reader) -> list[dict]:
        self.streamed = self.xid = None
        return []

    def stream_commit(self, r: Reader) -> list[dict]:
        xid, _ = r.number("i"), r.number("b")
        return [{"kind": "commit", "xid": xid, "lsn": r.number("q")}]

    def stream_abort(self, r: Reader) -> list[dict]:
        """Of the whole streamed transaction or of one of its subtransactions."""
        return [{"kind": "abort", "xid": r.number("i"), "sub": r.number("i")}]

    def relation(self, r: Reader) -> list[dict]:
        oid, schema, name, identity = r.number("i"), r.text(), r.text(), chr(r.number("B"))
        columns = []
        for _ in range(r.number("h")):
            key, column, kind, _ = r.number("b"), r.text(), r.number("i"), r.number("i")
            columns.append((column, kind, bool(key & 1)))
        self.relations[oid] = {"name": f"{schema or 'pg_catalog'}.{name}", "identity": identity, "columns": columns}
        return []

    def _relation(self, r: Reader) -> dict:
        oid = r.number("i")
        if oid not in self.relations:
            raise FrameError(f"relation {oid} wasn't announced")
        return self.relations[oid]

    def _tuple(self, r: Reader, rel: dict, keys_only: bool = False) -> tuple[str, list[str]]:
        n, fields, unchanged = r.number("h"), [], []
        if n != len(rel["columns"]):
            raise FrameError(f"{rel['name']}: {n} columns, announced {len(rel['columns'])}")
        for name, oid, key in rel["columns"]:
            form = r.take(1)
            if form == b"u":
                unchanged.append(name)
            elif form == b"n":
                if not keys_only or key:
                    fields.append((name, "null"))
            elif form == b"t":
                fields.append((name, _value(r.take(r.number("i")).decode(), oid)))
            elif form == b"b":
                fields.append((name, json.dumps("\\x" + r.take(r.number("i")).hex())))
            else:
                raise FrameError(f"column form {form!r}")
        return "{" + ",".join(f"{json.dumps(k)}:{v}" for k, v in fields) + "}", unchanged

    def _row(self, rel: dict, op: str, old: str | None, new: str | None, unchanged: list[str]) -> list[dict]:
        return [{"kind": "row", "table": rel["name"], "xid": self.xid if self.streamed is None else self.streamed, "sub": self.xid, "lsn": self.lsn, "op": op, "old": old, "new": new, "unchanged_cols": unchanged or None}]

    def insert(self, r: Reader) -> list[dict]:
        rel = self._relation(r)
        r.take(1)
        new, unchanged = self._tuple(r, rel)
        return self._row(rel, "I", None, new, unchanged)

    def update(self, r: Reader) -> list[dict]:
        rel, old = self._relation(r), None
        mark = r.take(1)
        if mark in (b"K", b"O"):
            old, _ = self._tuple(r, rel, mark == b"K")
            r.take(1)
        new, unchanged = self._tuple(r, rel)
        return self._row(rel, "U", old, new, unchanged)

    def delete(self, r: Reader) -> list[dict]:
        rel = self._relation(r)
        old, _ = self._tuple(r, rel, r.take(1) == b"K")
        return self._row(rel, "D", old, None, [])

    def truncate(self, r: Reader) -> list[dict]:
        n, _ = r.number("i"), r.number("b")
        return [x for _ in range(n) for x in self._row(self._relation(r), "T", None, None, [])]


def decode(frames: DataFrame, relations: dict[int, dict] | None = None) -> DataFrame:
    """Rows and control records of ``frames`` (segment, position, frame).

    Segments are decoded in parallel, each in order of position.  A segment must begin outside a
    transaction and announce its relations, or they are given in ``relations`` (one entry per table).
    """

    ship(frames.sparkSession)
    schema = pa.schema(
        [("segment", pa.int64()), ("position", pa.int64()), ("kind", pa.string()), ("table", pa.string()), ("xid", pa.int64()), ("sub", pa.int64()),
         ("lsn", pa.int64()), ("op", pa.string()), ("old", pa.string()), ("new", pa.string()), ("unchanged_cols", pa.list_(pa.string()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, current = Decoder(relations), None
        for batch in batches:
            out = []
            for segment, position, frame in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if segment != current:
                    decoder, current = Decoder(relations), segment
                out += [{"segment": segment, "position": position, **rec} for rec in decoder.decode(frame)]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    ordered = frames.select("segment", "position", "frame").repartition("segment").sortWithinPartitions("segment", "position")
    return ordered.mapInArrow(run, DECODED)


def transactions(decoded: DataFrame) -> DataFrame:
    """The change log (table, xid, lsn, seq, op, old, new, unchanged_cols) of committed transactions.

    Rows with a known LSN are committed; others get the LSN of their transaction's commit record, and
    those without one (or aborted) are left out.  ``seq`` counts a transaction's rows by position.
    """
    rows = decoded.filter("kind = 'row'")
    aborts = decoded.filter("kind = 'abort'")
    whole = aborts.filter("xid IS NULL OR xid = sub").select(F.col("sub").alias("xid")).distinct()
    commits = decoded.filter("kind = 'commit'").select("xid", F.col("lsn").alias("commit_lsn")).distinct().join(whole, "xid", "left_anti")
    plain = rows.filter("lsn IS NOT NULL")
    late = rows.filter("lsn IS NULL").join(aborts.select("sub").distinct(), "sub", "left_anti").join(commits, "xid")
    late = late.withColumn("lsn", F.col("commit_lsn")).select(*rows.columns)
    at = F.shiftleft(F.col("segment"), 40) + F.col("position")  # rows of one LSN in log order
    return plain.unionByName(late).select(
        "table", "xid", "lsn", at.alias("seq"), "op", "old", "new", "unchanged_cols"
    )
