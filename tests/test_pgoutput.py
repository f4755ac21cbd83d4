"""Decoding of replication frames."""

import struct

import pytest

from tidemark.sources import pgoutput as P


def _s(text):
    return text.encode() + b"\0"


def relation(oid=1, xid=b""):
    cols = [(1, "id", 20), (0, "head", 25), (0, "done", 16), (0, "meta", 3802)]
    body = b"".join(struct.pack(">b", f) + _s(n) + struct.pack(">ii", t, -1) for f, n, t in cols)
    return b"R" + xid + struct.pack(">i", oid) + _s("public") + _s("memos") + b"d" + struct.pack(">h", len(cols)) + body


def values(*v):
    out = struct.pack(">h", len(v))
    for x in v:
        out += b"n" if x is None else b"u" if x is ... else b"t" + struct.pack(">i", len(x.encode())) + x.encode()
    return out


def begin(lsn, xid):
    return b"B" + struct.pack(">qqi", lsn, 0, xid)


def commit(lsn):
    return b"C" + struct.pack(">bqqq", 0, lsn, lsn + 8, 0)


def insert(*v, xid=b""):
    return b"I" + xid + struct.pack(">i", 1) + b"N" + values(*v)


X = struct.pack(">i", 77)
FRAMES = [
    relation(), begin(100, 7), insert("1", "ü\"x", "t", '{"a": 1}'), b"U" + struct.pack(">i", 1) + b"K" + values("1", None, None, None) + b"N" + values("2", ..., "f", None), commit(100),
    begin(200, 8), b"D" + struct.pack(">i", 1) + b"O" + values("2", "t", None, None), b"T" + struct.pack(">ibi", 1, 0, 1), b"M" + b"\0" * 20, commit(200),
    b"S" + X + b"\1", relation(xid=X), insert("9", "s", None, None, xid=X), insert("10", "gone", None, None, xid=struct.pack(">i", 78)), b"E",
    b"A" + X + struct.pack(">i", 78), b"c" + X + struct.pack(">bqqq", 0, 300, 308, 0), b"Y" + b"\0" * 6, b"O" + b"\0" * 9,
]


def test_decoder():
    d = P.Decoder()
    recs = [r for f in FRAMES for r in d.decode(f)]
    rows = [r for r in recs if r["kind"] == "row"]
    assert rows[0]["new"] == '{"id":1,"head":"ü\\"x","done":true,"meta":{"a": 1}}' and rows[0]["lsn"] == 100
    assert (rows[1]["old"], rows[1]["new"], rows[1]["unchanged_cols"]) == ('{"id":1}', '{"id":2,"done":false,"meta":null}', ["head"])
    assert [r["op"] for r in rows] == ["I", "U", "D", "T", "I", "I"]


@pytest.mark.parametrize("frame", [b"?", b"B\0", relation()[:-3], insert("1"), b"I" + struct.pack(">i", 5) + b"N" + values()])
def test_bad_frames(frame):
    d = P.Decoder()
    d.decode(relation())
    with pytest.raises(P.FrameError):
        d.decode(frame)


def test_transactions(spark):
    frames = [(s, i, bytearray(f)) for s in (0, 1) for i, f in enumerate(FRAMES)]
    df = spark.createDataFrame(frames, "segment bigint, position bigint, frame binary").repartition(3)
    log = P.transactions(P.decode(df)).collect()
    assert len(log) == 10  # the aborted row is gone, both segments decode alike
    assert sorted({(r.lsn, r.op) for r in log}) == [(100, "I"), (100, "U"), (200, "D"), (200, "T"), (300, "I")]
    assert P.transactions(P.decode(df.limit(0))).count() == 0


def test_frames_feed_a_view(spark, rows):
    """Decoded transactions are the change log that a live view takes."""
    from tidemark.session import scratch
    from tidemark.streaming import ivm as V
    from tidemark.streaming.live import LiveView

    log = P.transactions(P.decode(spark.createDataFrame([(0, i, bytearray(f)) for i, f in enumerate(FRAMES)], "segment bigint, position bigint, frame binary")))
    seed = spark.createDataFrame([(5, "old", True, None)], "id bigint, head string, done boolean, meta string")
    view = LiveView(spark, scratch(spark, "lv"), V.Project(V.Source("public.memos"), ["id", "head"]), {"public.memos": seed.schema}, ["id"], {"public.memos": ["id"]})
    view.seed({"public.memos": seed})
    assert view.apply(log.filter("lsn = 100"), "b0") == 1
    assert rows(view.result()) == [(2, 'ü"x'), (5, "old")]
    assert view.apply(log, "b1") == 2 and rows(view.result()) == [(9, "s")]  # emptied at 200, filled at 300
