"""Delta rules equal recomputation; live views survive replays; subscriptions resume and resync."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dialect as D
from tidemark.session import scratch
from tidemark.sources import sinks
from tidemark.streaming import deltas as S
from tidemark.streaming import ivm as V
from tidemark.streaming.live import CHANGE, Hub, LateChangeError, LiveView, MaterializedKeys, PartialView, Reason, SchemaDriftError
from tidemark.streaming.optimistic import LocalWrites

A, B = V.Source("a"), V.Source("b")
SCHEMA = "id int, k int, v int"
NODES = {
    "filter": lambda: V.Filter(A, "v > 3"),
    "project": lambda: V.Project(A, ["k", "v + 1 AS w"]),
    "union_all": lambda: V.UnionAll(A, B),
    "join": lambda: V.Join(A, V.Project(B, ["k AS bk", "v AS bv"]), [("k", "bk")]),
    "left": lambda: V.KeyedJoin(A, V.Project(B, ["k AS bk", "v AS bv"]), [("k", "bk")], "left"),
    "semi": lambda: V.KeyedJoin(A, V.Project(B, ["k AS bk"]), [("k", "bk")], "left_semi"),
    "anti": lambda: V.KeyedJoin(A, V.Project(B, ["k AS bk"]), [("k", "bk")], "left_anti"),
    "distinct": lambda: V.distinct(V.Project(A, ["k"])),
    "except_all": lambda: V.set_operation(V.Project(A, ["k"]), V.Project(B, ["k"]), "except", True),
    "except": lambda: V.set_operation(V.Project(A, ["k"]), V.Project(B, ["k"]), "except"),
    "intersect_all": lambda: V.set_operation(V.Project(A, ["k"]), V.Project(B, ["k"]), "intersect", True),
    "aggregate": lambda: V.aggregate(A, ["k"], n=F.count(F.lit(1)), lo=F.min("v"), d=F.countDistinct("v")),
    "summed": lambda: V.Summed(A, ["k"], {"s": "v"}),
    "distinct_on": lambda: V.distinct_on(A, ["k"], [D.desc("v")]),
    "top_k": lambda: V.top_k(A, [D.asc("v")], 4, 1),
}


def _case(spark, seed):
    rng = random.Random(seed)
    row = lambda i: (i, rng.choice([None, 1, 2, 3, 4]), rng.choice([None, *range(6)]))
    old, change = {}, {}
    for n in "ab":
        table = [row(i) for i in range(14)] + [(99, 1, 1), (99, 1, 1)]
        gone = rng.sample(table, 5)
        changed = [(*r, -1) for r in gone] + [(*row(100 + i), 1) for i in range(4)] + [(7, 7, 7, 1), (7, 7, 7, -1)]
        old[n] = S.seed(spark.createDataFrame(table, SCHEMA))
        change[n] = spark.createDataFrame(changed, SCHEMA + ", _diff bigint")
    return old, change


@pytest.mark.parametrize("name", NODES)
def test_delta_equals_recomputation(spark, rows, name):
    old, change = _case(spark, sum(map(ord, name)) % 97)
    node = NODES[name]()
    assert rows(node.delta(old, change)) == rows(V.recomputed_delta(node, old, change))
    assert rows(node.delta(old, {"b": change["b"]})) == rows(V.recomputed_delta(node, old, {"b": change["b"]}))


@pytest.mark.parametrize("name", [n for n in NODES if n != "top_k"])
def test_moves_equal_one_transaction_after_the_other(spark, rows, name):
    """Changes of several LSNs in one plan give the diffs that they give one by one."""
    old, change = _case(spark, sum(map(ord, name)) % 89)
    lsn = F.pmod(F.col("id") + F.coalesce("v", F.lit(0)), F.lit(3)).cast("bigint") + 10
    timed = {n: S.consolidate(c.withColumn(S.LSN, lsn)) for n, c in change.items()}
    node, want = NODES[name](), []
    assert node.timed()
    for at in (10, 11, 12):
        before = {n: S.concat(t, timed[n].filter(F.col(S.LSN) < at).drop(S.LSN)) for n, t in old.items()}
        now = {n: c.filter(F.col(S.LSN) == at).drop(S.LSN) for n, c in timed.items()}
        want += [(at, *r) for r in map(tuple, node.delta(before, now).collect())]
    got = S.consolidate(node.moves(old, timed))
    cols = [c for c in got.columns if c not in (S.LSN, S.DIFF)]
    assert rows(got.select(S.LSN, *cols, S.DIFF)) == sorted(want, key=repr)
    if name == "summed":
        held = node.accumulated(old)
        assert rows(S.consolidate(node.moves(old, timed, held)).select(S.LSN, *cols, S.DIFF)) == sorted(want, key=repr)


def test_consolidate_and_pair(spark, rows):
    d = spark.createDataFrame([(1, "a", -1, 5), (1, "b", 1, 5), (2, "x", 1, 5), (2, "x", -1, 5), (3, "n", 1, 6), (4, "z", -1, 6), (None, "q", 1, 6)], "id int, t string, _diff bigint, _lsn bigint")
    got = sorted(((r.lsn, r.op, r.old.t if r.old else None, r.new.t if r.new else None) for r in S.pair(d, ["id"]).collect()), key=repr)
    assert got == sorted([(5, "update", "a", "b"), (6, "insert", None, "n"), (6, "delete", "z", None), (6, "insert", None, "q")], key=repr)
    assert S.pair(d.limit(0), ["id"]).count() == 0


def test_reconcile_truncate_upsert(spark, rows):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (3,)], "x int")
    assert rows(S.reconcile(a, b, 9)) == sorted([(1, -1, 9), (2, -1, 9), (3, 1, 9)], key=repr)
    assert rows(S.truncation(a, 4)) == [(1, -1, 4), (1, -1, 4), (2, -1, 4)]
    u = spark.createDataFrame([(1, "a", 1), (1, None, 2), (2, "a", 3), (2, "c", 3), (2, "b", 1)], "k int, v string, t int")
    assert rows(S.upsert(u, ["k"], "v", "t")) == [(2, "c")]


def test_wire(spark, rows):
    df = spark.createDataFrame([(1, None), (2, "ü")], "id int, t string")
    wire = sinks.encode_rows(df)
    assert rows(sinks.decode_rows(wire, df.schema)) == rows(df)
    for bad in ('{"id":1}', '{"id":"x","t":"y"}'):
        with pytest.raises(Exception):
            sinks.decode_rows(spark.createDataFrame([(bad,)], "payload string"), df.schema).collect()
    assert sinks.upsert_statement("t", df.schema, ["id"]) == 'INSERT INTO "t" ("id", "t") VALUES (?, ?) ON CONFLICT ("id") DO UPDATE SET "t" = excluded."t"'
    assert "PRIMARY KEY" in sinks.create_table_sql("t", df.schema, ["id"]) and sinks.delete_statement("t", ["id"]).endswith('"id" = ?')


def _change(lsn, seq, op, old, new):
    import json

    text = lambda r: None if r is None else json.dumps(dict(zip(("id", "k", "v"), r)))
    return ("a", lsn, lsn, seq, op, text(old), text(new), None)


LOG = [
    _change(10, 0, "I", None, (1, 1, 5)), _change(10, 1, "I", None, (2, 1, 7)),
    _change(20, 0, "U", (1, 1, 5), (1, 2, 5)), _change(30, 0, "D", (2, 1, 7), None), _change(30, 1, "I", None, (3, 2, 1)),
]


def _view(spark):
    seed = spark.createDataFrame([(0, 1, 1)], SCHEMA)
    v = LiveView(spark, scratch(spark, "lv"), V.Summed(A, ["k"], {"s": "v"}), {"a": seed.schema}, ["k"])
    v.seed({"a": seed})
    return v


def _log(spark, *lsns):
    return spark.createDataFrame([c for c in LOG if c[2] in lsns], CHANGE)


def test_live_view_and_replays(spark, rows):
    v = _view(spark)
    assert v.apply(_log(spark, 10, 20), "b0") == 2
    assert v.apply(_log(spark, 10, 20), "b0") == 0  # the same batch again
    assert v.apply(_log(spark, 10, 20).union(_log(spark, 10, 20)), "b1") == 0  # old transactions again
    assert v.apply(_log(spark, 20, 30).union(_log(spark, 30)), "b2") == 1
    assert rows(v.result()) == [(1, 1, 1), (2, 2, 6)]
    assert v.lsn == 30
    first = spark.createDataFrame([(1, 1, 1)], v.result().schema)
    assert rows(S.apply_diffs(first, v.events(), ["k"])) == rows(v.result())
    v.compact(20)
    assert rows(v.result()) == [(1, 1, 1), (2, 2, 6)] and {r.lsn for r in v.events().collect()} == {30}
    assert v.apply(spark.createDataFrame([("a", 40, 40, 0, "T", None, None, None), _change(40, 1, "I", None, (9, 9, 9))], CHANGE), "b3") == 1
    assert rows(v.result()) == [(9, 1, 9)]


def test_batches_do_not_matter(spark, rows):
    one, many = _view(spark), _view(spark)
    one.apply(_log(spark, 10, 20, 30), "x")
    for i, lsn in enumerate((10, 20, 30)):
        many.apply(_log(spark, lsn), f"y{i}")
    assert rows(one.result()) == rows(many.result())
    assert rows(one.diffs()) == rows(many.diffs())


@pytest.mark.parametrize("name", ["join", "anti", "aggregate", "top_k"])
def test_kept_views_equal_evaluation(spark, rows, name):
    """Views of all kinds over many transactions a batch, compacted on the way."""
    rng, node = random.Random(3), NODES[name]()
    start = {n: [(i, i % 3, i % 4) for i in range(6)] for n in node.sources()}
    seed = {n: spark.createDataFrame(r, SCHEMA) for n, r in start.items()}
    v = LiveView(spark, scratch(spark, "lv"), node, {n: t.schema for n, t in seed.items()}, max_parts=3)
    v.seed(seed)
    log, lsn = [], 0
    for lsn in range(1, 13):
        n = rng.choice(sorted(start))
        row = (100 + lsn, rng.randrange(3), rng.randrange(4))
        gone = start[n].pop(rng.randrange(len(start[n])))
        start[n].append(row)
        log.append((n, *_change(lsn, 0, "U", gone, row)[1:]))
    for i in (0, 6):
        assert v.apply(spark.createDataFrame(log[i : i + 6], CHANGE), f"b{i}") == 6
    now = {n: spark.createDataFrame(r, SCHEMA) for n, r in start.items()}
    assert rows(v.result()) == rows(S.expand(S.consolidate(node.full({n: S.seed(t) for n, t in now.items()}))))
    assert v.diffs().filter(F.col(S.LSN) > 12).count() == 0 and not v._parts("held-")


def test_streamed_log(spark, rows):
    v, root = _view(spark), scratch(spark, "stream")
    _log(spark, 10, 20).write.parquet(f"{root}/log")
    v.run(f"{root}/log", f"{root}/cp").awaitTermination()
    _log(spark, 30).write.mode("append").parquet(f"{root}/log")
    v.run(f"{root}/log", f"{root}/cp").awaitTermination()
    assert rows(v.result()) == [(1, 1, 1), (2, 2, 6)]


def test_left_out_columns_and_null_ops(spark, rows):
    """Full old images tell unchanged columns; else the row's earlier changes do, else the table; a null op is told by its images."""
    c = lambda seq, op, old, new, kept=None, lsn=5: ("a", lsn, lsn, seq, op, old, new, kept)
    log = [
        c(0, "U", '{"id":1,"k":1,"v":1}', '{"id":1,"k":5}', ["v"]), c(1, None, '{"id":2}', '{"id":2,"k":6}', ["v"]),
        c(2, "u", '{"id":2}', '{"id":2,"v":9}', ["k"]), c(3, "U", '{"id":3}', '{"id":4,"k":4,"v":4}'), c(4, "U", None, '{"id":4,"k":8}', ["v"]),
        c(5, None, '{"id":5,"k":5,"v":5}', None), c(6, "D", '{"id":6}', None), c(7, "I", None, '{"id":6,"k":null,"v":0}'), c(8, None, None, '{"id":7,"k":7,"v":7}'),
    ]
    base = spark.createDataFrame([(i, i, i) for i in (1, 2, 3, 5, 6)], SCHEMA)
    want = sorted([(1, 5, 1), (2, 6, 9), (4, 8, 4), (6, None, 0), (7, 7, 7)], key=repr)
    df = spark.createDataFrame(log, CHANGE)
    assert rows(S.expand(S.consolidate(S.concat(S.seed(base), S.from_changes(df, base.schema, base, ["id"]).drop("_lsn"))))) == want
    v = LiveView(spark, scratch(spark, "lv"), V.Project(A, ["id", "k", "v"]), {"a": base.schema}, ["id"], {"a": ["id"]})
    v.seed({"a": base})
    v.apply(df, "b0")
    assert rows(v.result()) == want
    more = [c(0, "t", None, None, lsn=6), c(1, "I", None, '{"id":1,"k":2,"v":3}', lsn=6), c(2, "U", '{"id":1}', '{"id":1,"k":4}', ["v"], lsn=6)]
    v.apply(spark.createDataFrame(more, CHANGE), "b1")
    assert rows(v.result()) == [(1, 4, 3)]
    full = S.from_changes(df.filter("seq IN (0, 5)"), base.schema).drop("_lsn")
    assert rows(full) == sorted([(1, 1, 1, -1), (1, 5, 1, 1), (5, 5, 5, -1)], key=repr)
    for lost in (S.from_changes(df.filter("seq = 1"), base.schema), S.from_changes(df.filter("seq = 4"), base.schema, base, ["id"])):
        with pytest.raises(Exception, match="unchanged column|no earlier value"):
            lost.collect()


def test_transactions_across_batches(spark, rows):
    """One file a batch: each transaction is whole in the view, and shown as one diff."""
    v, whole, root = _view(spark), _view(spark), scratch(spark, "stream")
    for c in LOG:
        spark.createDataFrame([c], CHANGE).coalesce(1).write.mode("append").parquet(f"{root}/log")
    v.run(f"{root}/log", f"{root}/cp", files_per_batch=1).awaitTermination()
    whole.apply(_log(spark, 10, 20, 30), "all")
    assert rows(v.result()) == rows(whole.result()) and rows(v.diffs()) == rows(whole.diffs()) and v.lsn == 30


def test_held_back_and_late_changes(spark, rows):
    v = _view(spark)
    one = lambda c: spark.createDataFrame([c], CHANGE)
    commit = lambda lsn: one((None, lsn, lsn, None, "commit", None, None, None))
    assert v.apply(one(LOG[0]), "b0", more=True) == 0 and v.lsn == 0
    assert v.apply(one(LOG[1]).union(one(LOG[0])), "b1", more=True) == 0
    assert v.apply(commit(10), "b2", more=True) == 1 and rows(v.result()) == [(1, 3, 13)]
    v.compact(10)
    assert v.apply(_log(spark, 10, 20), "b3", more=True) == 0 and v.settle() == 1 and v.settle() == 0
    for late in (_change(10, 7, "I", None, (8, 8, 8)), _change(15, 0, "I", None, (8, 8, 8)), _change(20, 1, "I", None, (8, 8, 8))):
        with pytest.raises(LateChangeError):
            v.apply(one(late), "late")
    assert v.apply(_log(spark, 10, 20), "b4") == 0 and rows(v.result()) == [(1, 2, 8), (2, 1, 5)]


def test_subscriptions(spark, rows):
    v, hub = _view(spark), Hub(bound=2)
    m = hub.subscribe("s", v)
    assert m.kind == "initial" and rows(m.rows) == [(1, 1, 1)] and hub.poll("s") is None
    v.apply(_log(spark, 10), "b0")
    m = hub.poll("s")
    assert (m.kind, m.lsn) == ("diff", 10) and [r.op for r in m.rows.collect()] == ["update"]
    hub.ack("s", 99)  # beyond what was sent
    assert hub.subscriptions["s"].last_acked == -1
    hub.ack("s", 10)
    hub.ack("s", 5)
    assert hub.frontier(v) == 10
    v.apply(_log(spark, 20, 30), "b1")
    hub.compact(v)
    assert v.earliest == 10
    assert hub.subscribe("old", v, resume_lsn=5).reason is Reason.LSN_COMPACTED
    again = hub.subscribe("s", v, resume_lsn=10)
    assert again.kind == "diff" and {r.lsn for r in again.rows.collect()} == {20, 30}
    v.apply(spark.createDataFrame([_change(40, 0, "I", None, (5, 5, 5))], CHANGE), "b2")
    assert hub.poll("s").reason is Reason.BACKPRESSURE  # three transactions unacknowledged
    assert [m.reason for _, m in hub.resync_all(v, Reason.PERMISSIONS_CHANGED)] == [Reason.PERMISSIONS_CHANGED] * 2
    assert hub.metrics["subscribes"] == 3


def test_schema_drift(spark):
    v = _view(spark)
    with pytest.raises(SchemaDriftError):
        v.seed({"a": spark.createDataFrame([(1,)], "id int")})


def test_reseeding_tells_why(spark, rows):
    v, hub = _view(spark), Hub()
    hub.subscribe("s", v)
    v.apply(_log(spark, 10, 20), "b0")
    hub.poll("s")
    assert hub.lag(25) == {"s": 25}
    hub.ack("s", 20)
    assert hub.lag(25) == {"s": 5}
    (sub, m), = hub.reseed(v, {"a": spark.createDataFrame([(5, 5, 5)], SCHEMA)}, 40)
    assert (sub, m.kind, m.reason, m.lsn, rows(m.rows)) == ("s", "resync", Reason.SLOT_RECREATED, 40, [(5, 1, 5)])
    wide = spark.createDataFrame([(5, 5, 5, "x")], SCHEMA + ", t string")
    (_, m), = hub.reseed(v, {"a": wide}, 50, {"a": wide.schema})
    assert (m.reason, v.lsn) == (Reason.SCHEMA_CHANGED, 50)


def test_partial_view_and_errors(spark, rows):
    v, hub = _view(spark), Hub()
    v.apply(_log(spark, 10), "b0")  # groups: 1 with three rows
    part = PartialView(v, "k", limit=1)
    assert rows(part.get(1)) == [(1, 3, 13)] and part.keys.lookup((1,)) == "hit" and part.get(7).count() == 0
    v.apply(_log(spark, 20, 30), "b1")
    assert sorted(rows(part.get(1, 2, 1))) == [(1, 1, 1), (2, 2, 6)]
    hub.subscribe("s", v)
    with pytest.raises(LateChangeError) as e:
        v.apply(spark.createDataFrame([_change(15, 0, "I", None, (8, 8, 8))], CHANGE), "late")
    (sub, m), = hub.fail(v, e.value)
    assert (sub, m.kind, m.lsn) == ("s", "error", 30) and "LateChangeError" in m.error and not hub.subscriptions


def test_partial_keys_and_local_writes():
    k = MaterializedKeys()
    assert [k.lookup((1,)), k.lookup((1,))] == ["miss", "pending"]
    k.fill((1,))
    assert k.lookup((1,)) == "hit"
    w = LocalWrites({1: {"v": 1}, 2: {"v": 2}})
    w.stage("a", 1, {"v": 5})
    w.stage("b", 2, None)
    assert w.view() == {1: {"v": 5}}
    assert w.server(1, {"v": 5}) == [] and [x[0] for x in w.staged] == ["b"]
    assert w.server(2, {"v": 3}) == ["b"]
    w.rollback("b")
    assert w.view() == {1: {"v": 5}, 2: {"v": 3}}


def test_input_session_and_capture(spark, rows):
    i = S.InputSession(spark, "x int")
    i.insert((1,))
    i.insert((2,))
    i.remove((2,))
    i.advance_to(5)
    i.update_at((3,), 7, 2)
    assert rows(i.flush()) == [(1, 0, 1)]
    with pytest.raises(ValueError):
        i.update_at((1,), 3, 1)
    i.advance_to(8)
    last = i.flush()
    assert rows(last) == [(3, 7, 2)]
    path = scratch(spark, "capture")
    S.capture(last, path)
    S.capture(last, path)
    assert rows(S.replay(spark.read.parquet(path), ["x", "_lsn"])) == [(3, 7, 2)]
