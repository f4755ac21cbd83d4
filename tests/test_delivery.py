"""Problems 1 to 5 against plain Python, and their edge cases."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import dedupe, history, incremental, skew
from tidemark.operators.lsm import LsmTable
from tidemark.session import scratch
from tidemark.sources import changelog

PAYLOAD = "delivery_id bigint, batch_id bigint, subscription_id string, lsn string, chunk_index int, rank string"
STATE = "subscription_id string, last_seen_lsn bigint, last_acked_lsn bigint, saved_at timestamp"
RELATION = "schema_name string, rel_name string, key_column string, key_type string, keep_history boolean"
WAL = "batch_id bigint, table_name string, row_image string, wal_time bigint, seq int, diff int"
CHANGE = "commit_lsn bigint, seq int, op string, old_row string, new_row string, unchanged_cols array<string>"
few = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


# --- 1 ------------------------------------------------------------------------------------------


def test_exactly_once_keeps_first_copy(spark, rows):
    d = spark.createDataFrame(
        [
            (3, 1, " Sub-1", "1/10", 0, "x"), (1, 1, "sub-1 ", str((1 << 32) + 16), 0, "y"), (2, 1, "SUB-1", "5", 0, None),
            (4, 2, "sub-2", "5", 0, "x"), (5, 2, "sub-2", "5", 1, "x"), (6, 2, "sub-2", None, 1, "x"), (7, 2, "sub-2", None, 1, "x"), (8, 2, None, "9", 0, "x"),
        ],
        PAYLOAD,
    )
    s = spark.createDataFrame([("SUB-1", 5, None, None), ("sub-1", 1, 0, None), ("sub-2", None, 3, None)], STATE)
    s = s.withColumn("saved_at", F.when(F.col("subscription_id") == "SUB-1", F.lit("2025-01-02")).otherwise(F.lit("2025-01-01")).cast("timestamp"))
    kept = dedupe.exactly_once(d, s)
    assert sorted(r.delivery_id for r in kept.collect()) == [1, 4, 5, 6, 7, 8]  # nulls in the identity are never copies
    assert kept.columns == d.columns
    assert rows(dedupe.superfluous(d, s)) == [(2,), (3,)]
    assert dedupe.superfluous(d.limit(0), s).count() == 0
    assert rows(dedupe.superfluous(d, s.limit(0))) == [(3,)]


def test_first_copies_ties_and_hot_message(spark):
    hot = spark.range(5000).select((F.col("id") % 2).alias("k"), F.lit(1).alias("t"), F.col("id").alias("__rank"))
    out = dedupe.first_copies(hot, ["k"], ["t"])
    assert out.count() == 2 and out.columns == hot.columns
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, dedupe.first_copies(hot.repartition(7), ["k"], ["t"]).collect()))


def test_message_log_over_batches(spark, rows):
    log = dedupe.MessageLog(spark, scratch(spark, "log"), ["m"], ["at"])
    b0 = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "m int, at int")
    b1 = spark.createDataFrame([(2, 4), (3, 5)], "m int, at int")
    log.append(0, b0)
    log.append(1, b1)
    log.append(1, b1)  # replayed after a failure
    log.append(0, b0)
    assert rows(log.stored()) == [(1, 1), (2, 3), (3, 5)]


# --- 2 and 3 ------------------------------------------------------------------------------------


def _relations(spark):
    return spark.createDataFrame([("public", "cards", "id", "uuid", True), ("core", "records", "id", "int8", True), ("public", "posts", "id", "int8", False)], RELATION)


def _tx(spark, *lsns):
    return spark.createDataFrame([(x,) for x in lsns], "commit_lsn bigint")


def test_history_of_signed_updates(spark, rows):
    u, v = '{"id":"{AAAAAAAA00001111222233334444AAAA}","position":1}', '{"position":1.0, "id":"aaaaaaaa-0000-1111-2222-33334444aaaa","archived":null}'
    wal = spark.createDataFrame(
        [
            (1, "cards", u, 10, 0, 1), (2, '"public"."CARDS"', v, 10, 0, 1),  # a repeat, written differently
            (1, "cards", u, 20, 0, -1), (1, "cards", v, 20, 1, 1),  # same values: no new version
            (1, "cards", u, 30, 0, -1),
            (1, "core.records", '{"id":1,"project":{"a":1,"b":[1,2]}}', 10, 1, 1),
            (1, "core.records", '{"id":1,"project":{"a":1,"b":[1,2]}}', 40, 0, -1), (1, "CORE.records", '{"id":1,"project":{"a":1,"b":[2,1]}}', 40, 1, 1),
            (1, "core.records", '{"id":1,"x":1}', 45, 0, 1),  # never committed
            (1, "posts", '{"id":1}', 10, 2, 1), (1, None, '{"id":1}', 10, 3, 1), (1, "core.records", None, 10, 4, 1), (1, "core.records", '{"id":null}', 10, 5, 1),
        ],
        WAL,
    )
    h = history.full_history(wal, spark.createDataFrame([], "batch_id bigint, " + CHANGE), _tx(spark, 10, 20, 30, 40), _relations(spark))
    assert rows(h.drop("state")) == [
        ("core.records", "1", 10, 40), ("core.records", "1", 40, -1), ("public.cards", "aaaaaaaa-0000-1111-2222-33334444aaaa", 10, 30),
    ]


def _issue(i, **over):
    import json

    base = {"title": "t", "status": "s", "priority": 1, "assignee": "a", "project": "p", "estimate": 1, "created_day": 1, "completed_day": 0, "cycle_days": 0}
    return json.dumps({"id": i} | base | over)


def test_history_of_typed_changes(spark, rows):
    import json

    short = json.loads(_issue(1, priority=2))
    del short["title"]
    rc = spark.createDataFrame(
        [
            (10, 0, "U", _issue(1), _issue(1, title="new"), None),  # older than the log
            (20, 0, " upd", '{"id":1}', json.dumps({k: v for k, v in short.items()}), ["title"]),  # keeps "new"
            (30, 0, None, _issue(1), _issue(1, title="new", priority=2), None),  # as before: no version
            (40, 0, "u", '{"id":1}', _issue(9), None),  # moves to another key
            (50, 0, "d", '{"id":9}', None, None), (60, 0, "I", None, _issue(9), None), (60, 1, "D", '{"id":9}', None, None),
            (70, 0, "u", '{"id":5}', _issue(5), None),  # only its key is known before
        ],
        CHANGE,
    )
    h = history.full_history(spark.createDataFrame([], WAL), rc.withColumn("batch_id", F.col("commit_lsn") % 3), _tx(spark, 10, 20, 30, 40, 50, 60, 70), _relations(spark))
    t = "public.issues"
    assert rows(h.drop("state")) == sorted([(t, "1", 0, 10), (t, "1", 10, 20), (t, "1", 20, 40), (t, "9", 40, 50), (t, "5", 0, 70), (t, "5", 70, -1)], key=repr)


def _random_events(seed, n=120):
    rng = random.Random(seed)
    return [("t", str(rng.randrange(5)), rng.randrange(1, 60), rng.randrange(4), rng.choice([0, 1, 2, 3]), None) for _ in range(n)]


def _plain_history(events):
    last = {}
    for t, k, lsn, seq, state, _ in events:
        last.setdefault((k, lsn), {})[seq] = state
    out = []
    for key in {k for k, _ in last}:
        now, since = 0, None
        for lsn in sorted(x for k, x in last if k == key):
            state = last[key, lsn][max(last[key, lsn])]
            if state != now:
                if now:
                    out.append(("t", key, since, lsn))
                now, since = state, lsn
        if now:
            out.append(("t", key, since, -1))
    return sorted(out, key=repr)


EVENT = "table_name string, row_key string, lsn bigint, seq int, state bigint, old_state bigint"


def test_history_hot_rows_late_batches(spark, rows):
    """Cut into ranges and built from late batches, history is the same."""
    events = list({(k, lsn, seq): e for e in _random_events(3) for k, lsn, seq in [e[1:4]]}.values())
    expected = _plain_history(events)
    df = spark.createDataFrame(events, EVENT)
    once = history.HistoryStore(spark, scratch(spark, "h"), hot_rows=5)
    once.refresh("all", df)
    assert rows(once.read().drop("state")) == expected == rows(once.rebuild().drop("state"))
    store = history.HistoryStore(spark, scratch(spark, "h"), buckets=3)
    rng = random.Random(1)
    rng.shuffle(events)
    for i in range(0, len(events), 40):
        store.refresh(f"b{i}", spark.createDataFrame(events[i : i + 40], EVENT))
    assert rows(store.read().drop("state")) == expected
    store.refresh("b0", spark.createDataFrame(events[:40], EVENT))  # replayed
    assert rows(store.read().drop("state")) == expected


def test_refresh_reads_touched_buckets_only(spark, rows, monkeypatch):
    """A batch of one row reads that row's bucket, adds one chain part and leaves the others as they are."""
    store = history.HistoryStore(spark, scratch(spark, "h"), buckets=64)
    make = lambda *e: spark.createDataFrame([("t", k, lsn, 0, s, None) for k, lsn, s in e], EVENT)
    store.refresh("first", make(*[(str(k), 10, 1) for k in range(100)], *[(str(k), 20, 2) for k in range(100)]))
    before, seen, rebuild = store.store.manifest()["parts"], [], history.HistoryStore.log
    monkeypatch.setattr(history.HistoryStore, "log", lambda self, m=None, touched=None: (seen.append(rebuild(self, m, touched)), seen[-1])[1])
    store.refresh("late", make(("7", 15, 0)))
    scans = re.findall(r"PartitionFilters: \[([^\]]*)\]", seen[0]._jdf.queryExecution().executedPlan().toString())
    assert sum("bucket#" in s for s in scans) == 2  # both log parts
    assert {(r.row_key, r.lsn) for r in seen[0].collect()} == {("7", 10), ("7", 15), ("7", 20)}
    after = store.store.manifest()["parts"]
    assert before.items() <= after.items() and len(after) == len(before) + 2
    assert sorted(r[2:4] for r in rows(store.read()) if r[1] == "7") == [(10, 15), (20, -1)] and store.read().count() == 200


def test_history_waits_for_commits(spark, rows):
    """A change counts from when its commit is known; a row that vanishes leaves no old chain."""
    store = history.HistoryStore(spark, scratch(spark, "h"), buckets=2, fan=2)
    make = lambda *e: spark.createDataFrame([("t", k, lsn, 0, s, None) for k, lsn, s in e], EVENT)
    chains = lambda: [r[1:4] for r in rows(store.read())]
    store.refresh("a", make(("1", 10, 5), ("1", 20, 6), ("2", 20, 1)), _tx(spark, 10))
    assert chains() == [("1", 10, -1)]
    store.refresh("b", make(), _tx(spark, 20, 20, 40))
    assert chains() == [("1", 10, 20), ("1", 20, -1), ("2", 20, -1)]
    store.refresh("c", make(("1", 10, 0), ("1", 20, 0), ("1", 30, 9)), _tx(spark))  # corrected: it never lived
    assert chains() == [("2", 20, -1)] and len(store.store.manifest()["parts"]) == 4  # one log, chain and commit part, one that waits
    store.refresh("d", make(("2", 40, 0)), _tx(spark, 30))
    store.store.vacuum()
    assert chains() == [("1", 30, -1), ("2", 20, 40)]


def test_late_changes_refill_stored_ones(spark, rows):
    """Batches of raw changes give the history of all at once: a late or corrected change tells stored later ones."""
    import json

    short = json.loads(_issue(1, priority=2))
    del short["title"]
    kept = lambda lsn, p: (lsn, 0, "U", '{"id":1}', json.dumps(short | {"priority": p}), ["title"])
    first = [(10, 0, "I", None, _issue(1), None), kept(30, 2), kept(50, 3), (60, 0, "U", '{"id":1}', _issue(1, title="late", priority=3), None)]
    late = [(40, 0, "U", '{"id":1}', _issue(1, title="late", priority=2), None)]
    fixed = [(10, 0, "I", None, _issue(1, title="late"), None)]
    wal, tx = spark.createDataFrame([], WAL), _tx(spark, 10, 30, 40, 50, 60)
    store = history.HistoryStore(spark, scratch(spark, "h"), buckets=2)
    refresh = lambda n, b: store.refresh(n, history.history_events(wal, spark.createDataFrame(b, CHANGE), _relations(spark)), tx)
    chain = lambda *at: [("public.issues", "1", a, b) for a, b in zip(at, [*at[1:], -1])]
    refresh("first", first)
    assert rows(store.read().drop("state")) == chain(10, 30, 50, 60)
    refresh("late", late)  # 50 has the late title now, so 60 changes nothing
    assert rows(store.read().drop("state")) == chain(10, 30, 40, 50)
    refresh("fixed", fixed)  # the title was "late" from the start
    assert rows(store.read().drop("state")) == chain(10, 30, 50)
    refresh("first", first)  # a replay doesn't undo the correction
    assert rows(store.read().drop("state")) == chain(10, 30, 50)


def test_filled_hot_rows(spark, rows):
    """Values carried over ranges of a hot row equal those carried in one pass."""
    rng = random.Random(5)
    data = [("t", "1" if rng.random() < 0.8 else "2", i, 0, True, None, rng.choice([None, None, 1, 2]), rng.choice([None, 7, 8])) for i in range(200)]
    df = spark.createDataFrame(data, "table_name string, row_key string, lsn bigint, seq int, alive boolean, old_state bigint, v_a bigint, v_b bigint")
    assert rows(history.filled(df, hot_rows=20)) == rows(history.filled(df))


def test_lsm_merges_runs_in_any_order(spark, rows):
    events = [(str(i % 7), i, 0, i % 5 != 0, f"v{i}") for i in range(60)]
    current = {k: (lsn, v) for k, lsn, _, alive, v in events if alive and lsn == max(e[1] for e in events if e[0] == k)}
    random.Random(2).shuffle(events)
    table = LsmTable(spark, scratch(spark, "lsm"), ["k"], ["lsn", "seq"], fan=3)
    schema = "k string, lsn bigint, seq int, alive boolean, payload string"
    for i in range(0, 60, 12):
        part = spark.createDataFrame(events[i : i + 12] + [(None, 1, 0, True, "no key")], schema)
        table.append(f"r{i}", part)
        table.append(f"r{i}", part.union(part))
    assert len(table.runs()) == 3  # five runs: three of them merged into one of the next level
    plan = table.read()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    want = sorted((k, lsn, 0, v) for k, (lsn, v) in current.items())
    assert rows(table.read()) == want
    table.compact()
    assert len(table.runs()) == 1 and rows(table.read()) == want
    table.append("late", spark.createDataFrame([("0", 1, 0, True, "old"), ("3", 1000, 0, False, None)], schema))
    assert rows(table.read()) == [w for w in want if w[0] != "3"]


def test_lsm_carries_told_values(spark, rows):
    """Typed rows by runs in any order equal a plain replay of the log."""
    import json

    from tidemark.functions import canon

    rng, log, now = random.Random(4), [], {}
    for lsn in range(1, 120):
        k = rng.randrange(6)
        new = {c: rng.choice([None, lsn, f"{c}-{lsn}"]) for c in canon.ISSUE_COLUMNS}
        if k not in now:
            log.append((lsn, 0, "I", None, json.dumps({"id": k} | new), None))
        elif rng.random() < 0.2:
            log.append((lsn, 0, "D", json.dumps({"id": k}), None, None))
            new = None
        else:
            kept = rng.sample(canon.ISSUE_COLUMNS, rng.randrange(7))
            old = json.dumps({"id": k} | (now[k] if rng.random() < 0.3 else {}))
            log.append((lsn, 0, None, old, json.dumps({"id": k} | {c: v for c, v in new.items() if c not in kept}), kept))
            new |= {c: now[k][c] for c in kept}
        if new is None:
            del now[k]
        else:
            now[k] = new
    rng.shuffle(log)
    lsm = LsmTable(spark, scratch(spark, "lsm"), ["table_name", "row_key"], ["lsn", "seq"], carried=canon.ISSUE_COLUMNS, fan=3)
    for i in range(0, len(log), 30):
        lsm.append(f"r{i}", changelog.change_events(spark.createDataFrame(log[i : i + 30], CHANGE), payload=True))
    got = {int(r.row_key): {c: json.loads(r[c]) for c in canon.ISSUE_COLUMNS} for r in lsm.read().collect()}
    assert got == now
    lsm.compact()
    assert {int(r.row_key): {c: json.loads(r[c]) for c in canon.ISSUE_COLUMNS} for r in lsm.read().collect()} == now


def test_change_kinds_and_moves(spark, rows):
    rc = spark.createDataFrame(
        [(1, 0, None, None, '{"id":1}', None), (2, 0, "Update", '{"id":1}', '{"id":2}', None), (3, 0, None, '{"id":2}', None, None), (4, 0, "x", '{"id":3.0}', '{"id":3}', None)], CHANGE
    )
    e = changelog.change_events(rc).select("row_key", "lsn", "alive")
    assert rows(e) == [("1", 1, True), ("1", 2, False), ("2", 2, True), ("2", 3, False), ("3", 4, True)]


# --- 4 ------------------------------------------------------------------------------------------


@few
@given(st.integers(0, 10**6), st.sampled_from([2, 8, 256]))
def test_pending_equals_brute_force(spark, seed, fan):
    rng = random.Random(seed)
    subs = ["a"] * 6 + ["b", "c"]
    manifest = []
    for _ in range(60):
        lo = rng.choice([-1, rng.randrange(200)])
        manifest.append((rng.choice(subs[:-1]), lo, max(0, lo) + rng.randrange(1, 80), rng.randrange(6)))
    listing = [(rng.choice(subs), rng.randrange(260), rng.randrange(8), i) for i in range(300)] + [(None, 5, 0, 900), ("a", None, 0, 901), ("b", 5, None, 902)]
    want = sorted(i for s, x, b, i in listing if None in (s, x, b) or not any(m[0] == s and m[1] < x <= m[2] and b <= m[3] for m in manifest))
    out = incremental.pending(
        spark.createDataFrame(listing, "subscription_id string, lsn bigint, batch_id bigint, range int"),
        spark.createDataFrame(manifest, "subscription_id string, lo bigint, hi bigint, upto_batch bigint"), fan,
    )
    assert sorted(r["range"] for r in out.collect()) == want


def test_pending_without_manifest(spark):
    listing = spark.createDataFrame([("a", 1, 1)], "subscription_id string, lsn bigint, batch_id bigint")
    empty = spark.createDataFrame([], "subscription_id string, lo bigint, hi bigint, upto_batch bigint")
    assert incremental.pending(listing, empty).count() == 1
    assert incremental.pending(listing.limit(0), empty).count() == 0


def test_file_manifest_survives_failure(spark, rows):
    src, m = scratch(spark, "in"), incremental.FileManifest(spark, scratch(spark, "out"))
    spark.range(3).write.parquet(f"{src}/a")
    double = lambda df: df.select((F.col("id") * 2).alias("x"))
    first = m.run(src, double)
    assert m.run(src, double) is None
    spark.range(10, 12).write.parquet(f"{src}/b")
    commit, m.store.commit = m.store.commit, None
    try:
        m.run(src, double)  # fails before its commit
        raise AssertionError
    except TypeError:
        m.store.commit = commit
    assert rows(m.read()) == [(0,), (2,), (4,)]
    second = m.run(src, double)
    assert second not in (None, first) and sorted(rows(m.read())) == [(0,), (2,), (4,), (20,), (22,)]


def test_file_manifest_keeps_folder_columns_and_batches(spark, rows):
    """Columns in folder names are columns; a batch whose files are partly gone isn't done again without them."""
    src, m = scratch(spark, "in"), incremental.FileManifest(spark, scratch(spark, "out"))
    spark.createDataFrame([(1, 7), (2, 8)], "id int, day int").write.partitionBy("day").parquet(src)
    keep = lambda df: df.select("id", "day")
    m.run(src, keep)
    assert rows(m.read()) == [(1, 7), (2, 8)]
    m.store.delete(f"{src}/day=8")
    assert m.run(src, keep) is None and rows(m.read()) == [(1, 7), (2, 8)]
    (path, *_), = m.store.listing(src)
    spark.createDataFrame([(5,)], "id int").coalesce(1).write.parquet(f"{src}-other")
    (new, *_), = m.store.listing(f"{src}-other")
    m.store.delete(path)
    m.store._fs.rename(m.store._path(new), m.store._path(path))
    with pytest.raises(incremental.LostInputError):
        m.run(src, keep)
    assert rows(m.read()) == [(1, 7), (2, 8)]


def test_file_manifest_goes_by_content(spark, rows):
    """A touched file isn't new; one replaced with the same size and time is."""
    src, m = scratch(spark, "in"), incremental.FileManifest(spark, scratch(spark, "out"))
    keep = lambda df: df.select("id")
    spark.range(1, 2).coalesce(1).write.option("compression", "none").parquet(src)
    first = m.run(src, keep)
    (path, size, mtime), = m.store.listing(src)
    m.store.touch(src)
    assert m.store.listing(src) != [(path, size, mtime)] and m.run(src, keep) is None and rows(m.read()) == [(1,)]
    other = scratch(spark, "other")
    spark.range(2, 3).coalesce(1).write.option("compression", "none").parquet(other)
    (new, new_size, _), = m.store.listing(other)
    local = lambda p: p.removeprefix("file:")
    content = open(local(new), "rb").read()
    m.store.delete(path)
    out = m.store._fs.create(m.store._path(path), True)
    out.write(bytearray(content))
    out.close()
    m.store._fs.setTimes(m.store._path(path), mtime, -1)
    assert m.store.listing(src) == [(path, size, mtime)] and new_size == size
    assert m.run(src, keep) not in (None, first) and m.run(src, keep) is None and rows(m.read()) == [(2,)]


# --- 5 ------------------------------------------------------------------------------------------


def test_heavy_tables(spark, rows):
    names = ["posts"] * 30 + ["PUBLIC.posts"] * 30 + ['"a"."b"'] * 5 + [None] * 20 + ["rare"] * 4 + ["c.d "] * 11
    wal = spark.createDataFrame([(1, n, None, i % 9, i, None) for i, n in enumerate(names)], WAL)
    assert rows(skew.heavy_tables(wal)) == [("a.b",), ("c.d",), ("public.posts",)]
    assert skew.heavy_tables(wal.limit(0)).count() == 0
    assert {r.table_name: r.n_rows for r in skew.table_totals(wal).collect()} == {"public.posts": 60, "a.b": 5, None: 20, "public.rare": 4, "c.d": 11}


def test_transaction_totals_ignore_repeats(spark, rows):
    wal = spark.createDataFrame([(1, "t", None, 5, 0, 1), (1, "t", None, 5, 0, 1), (1, "t", None, 5, 1, -1), (1, "t", None, None, 1, 1)], WAL)
    assert rows(skew.transaction_totals(wal)) == sorted([(5, 2, 0, 3), (None, 1, 1, 1)], key=repr)


def test_message_runs_process_each_message_once(spark, rows):
    runs = incremental.MessageRuns(spark, scratch(spark, "runs"))
    make = lambda *x: spark.createDataFrame(x, "subscription_id string, lsn bigint, batch_id bigint")
    first = [("a", 5, 1), ("a", 9, 1), ("b", 3, 1)]
    keep = lambda df: df
    assert runs.run("r1", make(*first), keep) and not runs.run("r1", make(*first), keep)
    later = [*first, ("a", 7, 2), ("b", 4, 2), ("c", 1, 2)]  # a late message below what is done

    def fail(df):
        raise RuntimeError

    try:
        runs.run("r2", make(*later), fail)
    except RuntimeError:
        pass
    assert len(rows(runs.read())) == 3
    assert runs.run("r2", make(*later), keep)
    assert rows(runs.read()) == sorted(later, key=repr)
    assert runs.run("r3", make(*later), keep) and len(rows(runs.read())) == 6
