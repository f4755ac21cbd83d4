"""Queries of change ingestion, delta rules and live views, with their SQL.

The change log is made from ``orders``: some rows are deleted, some updated, some inserted.
"""

from __future__ import annotations

import sqlite3
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import KEYS, table
from tidemark.functions import dialect as D
from tidemark.operators import recursion
from tidemark.session import materialize, scratch
from tidemark.sources import sinks
from tidemark.streaming import deltas as S
from tidemark.streaming import ivm as V
from tidemark.streaming.live import Hub, LiveView

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(*_COLUMNS)


def _changed(o: DataFrame) -> DataFrame:
    """The signed change: deletes, updates (other price and customer) and inserts."""
    gone = S.negate(S.seed(o.filter("o_orderkey % 10 IN (3, 7)")))
    moved = o.filter("o_orderkey % 10 = 3").withColumns({"o_totalprice": F.col("o_totalprice") + 1, "o_custkey": F.col("o_custkey") + 1})
    added = o.filter("o_orderkey % 10 = 1").withColumn("o_orderkey", F.col("o_orderkey") + 1000000000)
    return S.concat(gone, S.seed(moved), S.seed(added))


#: The table before and after, and views over either as {o}.
_SQL = """WITH old_o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders),
new_o AS (SELECT * FROM old_o WHERE o_orderkey % 10 NOT IN (3, 7)
  UNION ALL SELECT o_orderkey, o_custkey + 1, o_orderstatus, o_totalprice + 1 FROM old_o WHERE o_orderkey % 10 = 3
  UNION ALL SELECT o_orderkey + 1000000000, o_custkey, o_orderstatus, o_totalprice FROM old_o WHERE o_orderkey % 10 = 1),"""


def _delta_sql(view: str) -> str:
    """Signed difference of a view (a SELECT with {o}) over the new and the old table."""
    return f"""{_SQL} a AS ({view.format(o='new_o')}), b AS ({view.format(o='old_o')}),
d AS (SELECT *, 1 AS _diff FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, -1 FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))
SELECT * EXCLUDE (_diff), sum(_diff)::BIGINT AS _diff FROM d GROUP BY ALL"""


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# --- change ingestion ---------------------------------------------------------------------------


def change_log(o: DataFrame, transactions: int = 4) -> DataFrame:
    """The same change as a typed log in ``transactions`` LSNs.

    Of the updates, some leave the status out of the new image: with the full old image, or with
    the key only, when the table's row must tell it.  Some have no op.
    """
    text = lambda cols, **over: F.to_json(F.struct(*[over.get(c, F.col(c)).alias(c) for c in cols]), {"ignoreNullFields": "false"})
    image = lambda **over: text(_COLUMNS, **over)
    none = F.lit(None).cast("string")
    lsn = (F.col("o_orderkey") % transactions + 1).cast("bigint") * 100
    third = F.expr("o_orderkey div 10 % 3")  # of the updates: complete, status kept, status kept with a key-only old image
    rows = lambda where, op, old, new, kept=F.lit(None): o.filter(where).select(
        F.lit("orders").alias("table"), lsn.alias("xid"), lsn.alias("lsn"), F.col("o_orderkey").alias("seq"),
        op.alias("op"), old.alias("old"), new.alias("new"), kept.cast("array<string>").alias("unchanged_cols"),
    )
    over = {"o_totalprice": F.col("o_totalprice") + 1, "o_custkey": F.col("o_custkey") + 1}
    moved = F.when(third == 0, image(**over)).otherwise(text([c for c in _COLUMNS if c != "o_orderstatus"], **over))
    before = F.when(third == 2, text(["o_orderkey"])).otherwise(image())
    op = F.when(F.expr("o_orderkey div 10 % 2 = 0"), "U")
    return (
        rows("o_orderkey % 10 = 7", F.lit("D"), image(), none)
        .union(rows("o_orderkey % 10 = 3", op, before, moved, F.when(third > 0, F.array(F.lit("o_orderstatus")))))
        .union(rows("o_orderkey % 10 = 1", F.lit("I"), none, image(o_orderkey=F.col("o_orderkey") + 1000000000)))
    )


@_query("cdc_apply", _SQL + " x AS (SELECT 1) SELECT * FROM new_o")
def cdc_apply(spark, sf):
    """Typed changes as signed rows, consolidated with the base."""
    o = _orders(spark, sf)
    signed = S.from_changes(change_log(o), o.schema, o, KEYS["orders"]).drop(S.LSN)
    return S.expand(S.consolidate(S.concat(S.seed(o), signed)))


@_query("cdc_fence", "SELECT count(*) AS n, min(lsn)::BIGINT AS first FROM (SELECT (o_orderkey % 4 + 1) * 100 AS lsn FROM orders WHERE o_orderkey % 10 IN (1, 3, 7)) WHERE lsn > 200")
def cdc_fence(spark, sf):
    return S.fence(change_log(_orders(spark, sf)), 200, "lsn").agg(F.count(F.lit(1)).alias("n"), F.min("lsn").alias("first"))


@_query("consolidate", "SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END)::BIGINT AS _diff FROM orders GROUP BY o_custkey HAVING sum(CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END) <> 0")
def consolidate(spark, sf):
    o = _orders(spark, sf)
    return S.consolidate(o.select("o_custkey", F.when(F.col("o_orderstatus") == "F", -1).otherwise(1).cast("bigint").alias("_diff")))


@_query("cdc_truncate", "SELECT o_orderkey, o_totalprice, -1::BIGINT AS _diff, 500::BIGINT AS _lsn FROM orders")
def cdc_truncate(spark, sf):
    return S.truncation(_orders(spark, sf).select("o_orderkey", "o_totalprice"), 500)


@_query("reconcile_diff", _delta_sql("SELECT * FROM {o}") )
def reconcile_diff(spark, sf):
    o = _orders(spark, sf)
    snapshot = S.expand(S.consolidate(S.concat(S.seed(o), _changed(o))))
    return S.reconcile(o, snapshot, 7).drop(S.LSN)


@_query("toast_resolved", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE 'new' END AS status, CASE WHEN o_orderkey % 3 = 1 THEN o_orderpriority ELSE 'p' END AS priority FROM orders")
def toast_resolved(spark, sf):
    """Columns left out of an image: from the old image, else from the base table."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    none = F.lit(None).cast("string")
    changes = o.select(
        F.struct("id", "status", none.alias("priority")).alias("old"), F.struct("id", F.lit("new").alias("status"), F.lit("p").alias("priority")).alias("new"),
        F.when(F.col("id") % 3 == 0, F.array(F.lit("status"))).when(F.col("id") % 3 == 1, F.array(F.lit("priority"))).alias("unchanged_cols"),
    )
    return S.resolve_unchanged(changes, ["status", "priority"], o).select("new.*")


@_query("upsert_source", """SELECT user_id, v AS value FROM (SELECT user_id, arg_max(event_type, (event_id, event_type)) AS v, max(event_id) AS e FROM events GROUP BY user_id) WHERE e % 5 <> 0""")
def upsert_source(spark, sf):
    """The last value of each user, where every fifth event removes it."""
    e = table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("value"))
    return S.upsert(e, ["user_id"], "value", "event_id")


@_query("capture_replay", "SELECT event_id, user_id FROM events")
def capture_replay(spark, sf):
    """A stream written down twice and read in any order gives each diff once."""
    e, path = table(spark, sf, "events").select("event_id", "user_id"), scratch(spark, "capture")
    S.capture(e, path)
    S.capture(e.repartition(3, "user_id"), path)
    return S.replay(spark.read.parquet(path), ["event_id"])


@_query("upquery_keys", "SELECT * FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def upquery_keys(spark, sf):
    return S.upquery(table(spark, sf, "nation"), "n_nationkey", table(spark, sf, "supplier").filter("s_acctbal > 5000").select("s_nationkey"))


@_query("wire_roundtrip", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def wire_roundtrip(spark, sf):
    o = _orders(spark, sf)
    return sinks.decode_rows(sinks.encode_rows(o), o.schema)


@_query("explode_weighted", "SELECT c_custkey, k, sum(w)::BIGINT AS _diff FROM (SELECT c_custkey, c_nationkey % 3 AS k, 2 AS w FROM customer UNION ALL SELECT c_custkey, 9, -1 FROM customer) GROUP BY ALL")
def explode_weighted(spark, sf):
    c = S.seed(table(spark, sf, "customer").select("c_custkey", "c_nationkey"))
    items = F.array(
        F.struct((F.col("c_nationkey") % 3).alias("value"), F.lit(2).cast("bigint").alias("weight")),
        F.struct(F.lit(9).alias("value"), F.lit(-1).cast("bigint").alias("weight")),
    )
    return S.consolidate(S.explode_weighted(c, items, "k").drop("c_nationkey"))


@_query("delay_changes", "SELECT o_orderkey, o_orderkey * 10 + 5 AS _lsn, 1::BIGINT AS _diff FROM orders")
def delay_changes(spark, sf):
    """Changes moved to later log positions."""
    return S.delay(S.seed(_orders(spark, sf).select("o_orderkey")).withColumn(S.LSN, F.col("o_orderkey") * 10), 5)


@_query("input_session", "SELECT n_nationkey, n_name, 1::BIGINT AS _diff, 0::BIGINT AS _lsn FROM nation WHERE n_regionkey <> 2")
def input_session(spark, sf):
    """Updates by hand (of the 25 nations): rows come and some go again at the same time."""
    n = table(spark, sf, "nation")
    session = S.InputSession(spark, n.select("n_nationkey", "n_name").schema)
    for r in n.collect():
        session.insert((r.n_nationkey, r.n_name))
        if r.n_regionkey == 2:
            session.remove((r.n_nationkey, r.n_name))
    session.advance_to(1)
    return session.flush()


@_query("replica_rows", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 3 UNION ALL SELECT n_nationkey, 'renamed' FROM nation WHERE n_regionkey = 3 AND n_nationkey % 2 = 0")
def replica_rows(spark, sf):
    """A client's replica database (of the 25 nations), kept by the generated statements."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    third = {r[0] for r in table(spark, sf, "nation").filter("n_regionkey = 3").select("n_nationkey").collect()}
    db = sqlite3.connect(":memory:")
    db.execute(sinks.create_table_sql("nation", n.schema, ["n_nationkey"]))
    upsert = sinks.upsert_statement("nation", n.schema, ["n_nationkey"])
    for r in n.collect():
        db.execute(upsert, tuple(r))
    for k in third:
        if k % 2:
            db.execute(sinks.delete_statement("nation", ["n_nationkey"]), (k,))
        else:
            db.execute(upsert, (k, "renamed"))
    return spark.createDataFrame(db.execute("SELECT n_nationkey, n_name FROM nation").fetchall(), n.schema)


# --- delta rules --------------------------------------------------------------------------------


def _ivm(name: str, view: str, node: Callable[[], V.Node]) -> None:
    def f(spark, sf):
        o = _orders(spark, sf)
        old = {
            "orders": S.seed(o), "customer": S.seed(table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")),
            "nation": S.seed(table(spark, sf, "nation").select("n_nationkey", "n_name")),
        }
        return node().delta(old, {"orders": _changed(o)})

    _query(f"ivm_{name}_delta", _delta_sql(view))(f)


_O, _C, _N = V.Source("orders"), V.Source("customer"), V.Source("nation")
_KEY = [("c_custkey", "o_custkey")]
_STATUS = "SELECT o_custkey AS k, o_orderstatus AS s FROM {o}"
_OTHER = "SELECT o_custkey * 2, o_orderstatus FROM {o}"
_LEFT = V.Project(_O, ["o_custkey AS k", "o_orderstatus AS s"])
_RIGHT = V.Project(_O, ["o_custkey * 2 AS k", "o_orderstatus AS s"])

_ivm("filter", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM {o} WHERE o_totalprice > 1000", lambda: V.Project(V.Filter(_O, "o_totalprice > 1000"), ["o_orderkey", "o_totalprice * 2 AS twice"]))
_ivm("join", "SELECT o_orderkey, c_name, n_name FROM {o} JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
     lambda: V.Project(V.Join(V.Join(_O, _C, [("o_custkey", "c_custkey")]), _N, [("c_nationkey", "n_nationkey")]), ["o_orderkey", "c_name", "n_name"]))
_ivm("leftjoin", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM {o} WHERE o_totalprice > 100000) ON c_custkey = o_custkey",
     lambda: V.Project(V.KeyedJoin(_C, V.Filter(_O, "o_totalprice > 100000"), _KEY, "left"), ["c_custkey", "o_orderkey"]))
_ivm("semijoin", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM {o} WHERE o_custkey = c_custkey AND o_totalprice > 350000)",
     lambda: V.Project(V.KeyedJoin(_C, V.Filter(_O, "o_totalprice > 350000"), _KEY, "left_semi"), ["c_custkey"]))
_ivm("antijoin", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM {o} WHERE o_custkey = c_custkey AND o_totalprice > 350000)",
     lambda: V.Project(V.KeyedJoin(_C, V.Filter(_O, "o_totalprice > 350000"), _KEY, "left_anti"), ["c_custkey"]))
_ivm("agg", "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top, count(DISTINCT o_orderstatus) AS kinds FROM {o} GROUP BY o_custkey",
     lambda: V.aggregate(_O, ["o_custkey"], n=F.count(F.lit(1)), top=F.max("o_totalprice"), kinds=F.countDistinct("o_orderstatus")))
_ivm("sum", "SELECT o_custkey, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM {o} GROUP BY o_custkey", lambda: V.Summed(_O, ["o_custkey"], {"keys": "o_orderkey"}))
_ivm("distinct", "SELECT DISTINCT o_custkey AS k, o_orderstatus AS s FROM {o}", lambda: V.distinct(_LEFT))
_ivm("union", f"{_STATUS} UNION {_OTHER}", lambda: V.set_operation(_LEFT, _RIGHT, "union"))
_ivm("except_all", f"{_STATUS} EXCEPT ALL {_OTHER}", lambda: V.set_operation(_LEFT, _RIGHT, "except", True))
_ivm("except", f"{_STATUS} EXCEPT {_OTHER}", lambda: V.set_operation(_LEFT, _RIGHT, "except"))
_ivm("intersect_all", f"{_STATUS} INTERSECT ALL {_OTHER}", lambda: V.set_operation(_LEFT, _RIGHT, "intersect", True))
_ivm("intersect", f"{_STATUS} INTERSECT {_OTHER}", lambda: V.set_operation(_LEFT, _RIGHT, "intersect"))
_ivm("topk", "SELECT * FROM (SELECT o_orderkey, o_totalprice FROM {o} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25)",
     lambda: V.top_k(V.Project(_O, ["o_orderkey", "o_totalprice"]), [D.desc("o_totalprice"), D.asc("o_orderkey")], 25))
_ivm("distinct_on", "SELECT * FROM (SELECT DISTINCT ON (o_custkey) o_custkey, o_totalprice, o_orderkey FROM {o} ORDER BY o_custkey, o_totalprice DESC, o_orderkey)",
     lambda: V.distinct_on(V.Project(_O, ["o_custkey", "o_totalprice", "o_orderkey"]), ["o_custkey"], [D.desc("o_totalprice"), D.asc("o_orderkey")]))


def _descend(tables):
    e = tables["orders"].select((F.col("o_orderkey") % 1000000000).alias("c"), F.expr("(o_orderkey % 1000000000) div 4").alias("p")).distinct()
    base = tables["nation"].filter("n_nationkey = 1").select(F.col("n_nationkey").cast("bigint").alias("id"))
    return recursion.fixpoint(base, lambda r: r.join(e, r["id"] == e["p"]).select("c"))


_ivm("fixpoint", """SELECT * FROM (WITH RECURSIVE e AS (SELECT DISTINCT o_orderkey % 1000000000 AS c, (o_orderkey % 1000000000) // 4 AS p FROM {o}),
r(id) AS (SELECT 1::BIGINT UNION SELECT e.c FROM e JOIN r ON e.p = r.id) SELECT id FROM r)""", lambda: V.Recomputed({"orders", "nation"}, _descend))


# --- live views ---------------------------------------------------------------------------------

_BY_CUSTOMER = "SELECT o_custkey, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM {o} GROUP BY o_custkey"


def _write_log(log: DataFrame, path: str, files: int) -> None:
    """The log as a writer leaves it: files in the order of LSN and seq, cut anywhere."""
    spark = log.sparkSession
    log.repartitionByRange(files, "lsn", "seq").sortWithinPartitions("lsn", "seq").write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    written = sorted(str(f.getPath()) for f in fs.listStatus(hadoop.Path(path)) if str(f.getPath()).endswith(".parquet"))
    now = int(time.time()) * 1000
    for i, f in enumerate(written):
        fs.setTimes(hadoop.Path(f), now + (i - len(written)) * 1000, -1)


def _live(spark: SparkSession, sf: str) -> LiveView:
    """A view of orders by customer, seeded from the table and fed by a streamed folder of changes."""
    o = _orders(spark, sf)
    root = scratch(spark, "live")
    view = LiveView(spark, f"{root}/view", V.Summed(_O, ["o_custkey"], {"keys": "o_orderkey"}), {"orders": o.schema}, ["o_custkey"], KEYS)
    view.seed({"orders": o})
    _write_log(change_log(o), f"{root}/log", 24)  # more than one batch takes
    query = view.run(f"{root}/log", f"{root}/checkpoint")
    query.awaitTermination()
    return view


@_query("live_mv", f"{_SQL} x AS (SELECT 1) {_BY_CUSTOMER.format(o='new_o')}")
def live_mv(spark, sf):
    return _live(spark, sf).result()


@_query("live_client", f"{_SQL} x AS (SELECT 1) {_BY_CUSTOMER.format(o='new_o')}")
def live_client(spark, sf):
    """A client folds the first snapshot and all diff events."""
    o = _orders(spark, sf)
    root = scratch(spark, "live")
    view = LiveView(spark, f"{root}/view", V.Summed(_O, ["o_custkey"], {"keys": "o_orderkey"}), {"orders": o.schema}, ["o_custkey"], KEYS)
    view.seed({"orders": o})
    hub = Hub()
    first = materialize(hub.subscribe("s", view).rows, "first")
    view.apply(change_log(o), "b0")
    news = hub.poll("s")
    return S.apply_diffs(first, news.rows, ["o_custkey"]) if news else first


@_query("live_resume", f"{_SQL} x AS (SELECT 1) {_BY_CUSTOMER.format(o='new_o')}")
def live_resume(spark, sf):
    """A client leaves after the first transactions, and folds what it missed when it resumes; the view is folded in between."""
    o = _orders(spark, sf)
    view = LiveView(spark, scratch(spark, "live"), V.Summed(_O, ["o_custkey"], {"keys": "o_orderkey"}), {"orders": o.schema}, ["o_custkey"], KEYS)
    view.seed({"orders": o})
    hub, log = Hub(), materialize(change_log(o), "log")
    rows = materialize(hub.subscribe("s", view).rows, "first")
    view.apply(log.filter("lsn <= 200"), "b0")
    news = hub.poll("s")
    hub.ack("s", news.lsn)
    rows = materialize(S.apply_diffs(rows, news.rows, ["o_custkey"]), "rows")
    hub.compact(view)
    hub.unsubscribe("s")
    view.apply(log.filter("lsn > 200"), "b1")
    missed = hub.subscribe("s", view, resume_lsn=news.lsn)
    return S.apply_diffs(rows, missed.rows, ["o_custkey"])


@_query("live_pairs", f"""{_SQL} a AS ({_BY_CUSTOMER.format(o='new_o')}), b AS ({_BY_CUSTOMER.format(o='old_o')})
SELECT coalesce(a.o_custkey, b.o_custkey) AS k, CASE WHEN b.n IS NULL THEN 'insert' WHEN a.n IS NULL THEN 'delete' ELSE 'update' END AS op, b.n AS n_before, a.n AS n_after
FROM a FULL JOIN b ON a.o_custkey = b.o_custkey WHERE (a.n, a.keys) IS DISTINCT FROM (b.n, b.keys)""")
def live_pairs(spark, sf):
    """The net change of a view as inserts, updates and deletes by key."""
    o = _orders(spark, sf)
    d = V.Summed(_O, ["o_custkey"], {"keys": "o_orderkey"}).delta({"orders": S.seed(o)}, {"orders": _changed(o)})
    p = S.pair(d.withColumn(S.LSN, F.lit(1).cast("bigint")), ["o_custkey"])
    return p.select(F.coalesce("new.o_custkey", "old.o_custkey").alias("k"), "op", F.col("old.n").alias("n_before"), F.col("new.n").alias("n_after"))
