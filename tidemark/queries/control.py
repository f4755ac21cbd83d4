"""Queries of served SQL, permission rules and named queries, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.catalog import table
from tidemark.plans import ast, parser
from tidemark.plans.engine import Engine
from tidemark.plans.permissions import Guarded, Latest, Rule, RuleError, RuleSet, User
from tidemark.plans.sharing import sharing_key
from tidemark.plans.prepared import Registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _served(name: str, sql: str, oracle: str | None = None) -> None:
    """A query given in the served dialect; its oracle is the same text unless DuckDB reads it otherwise."""

    def f(spark: SparkSession, sf: str) -> DataFrame:
        return Engine(spark, lambda t: table(spark, sf, t)).sql(sql)

    f.__doc__ = sql
    QUERIES[f"sql_{name}"], ORACLE[f"sql_{name}"] = f, oracle or sql


_served("join_top", """SELECT c.c_name AS name, count(*) AS n, max(o.o_totalprice) AS top FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
WHERE o.o_orderstatus IN ('F', 'O') AND c.c_acctbal BETWEEN 0 AND 5000 GROUP BY c.c_name HAVING count(*) >= 3 ORDER BY top DESC, name LIMIT 40""",
"""SELECT c.c_name AS name, count(*) AS n, max(o.o_totalprice) AS top FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
WHERE o.o_orderstatus IN ('F', 'O') AND c.c_acctbal BETWEEN 0 AND 5000 GROUP BY c.c_name HAVING count(*) >= 3 ORDER BY top DESC NULLS FIRST, name LIMIT 40""")
_served("exists_both", """SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE orders.o_custkey = customer.c_custkey AND o_orderstatus = 'F')
AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = customer.c_custkey AND o.o_orderpriority = '1-URGENT')""")
_served("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey",
"SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC NULLS FIRST, o_orderkey")
_served("set_chain", """SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 2
INTERSECT SELECT n_nationkey FROM nation""")
_served("cte_lateral", """WITH big AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 400000)
SELECT c.c_custkey, l.n FROM customer c JOIN LATERAL (SELECT o_custkey, count(*) AS n FROM big WHERE big.o_custkey = c.c_custkey GROUP BY o_custkey) l ON TRUE""",
"SELECT o_custkey AS c_custkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000 GROUP BY o_custkey")
_served("recursive", """WITH RECURSIVE e AS (SELECT p_partkey AS id, p_partkey / 3 AS parent FROM part), r AS (SELECT id FROM e WHERE id = 2 UNION
SELECT e.id FROM e JOIN r ON e.parent = r.id) SELECT id FROM r""",
"WITH RECURSIVE e AS (SELECT p_partkey AS id, p_partkey // 3 AS parent FROM part), r AS (SELECT id FROM e WHERE id = 2 UNION SELECT e.id FROM e JOIN r ON e.parent = r.id) SELECT id FROM r")
_served("expressions", """SELECT o_orderkey, o_orderkey / 7 AS q, o_orderkey % 7 AS r, o_totalprice / 0 AS none, CASE o_orderstatus WHEN 'F' THEN 'done' ELSE coalesce(NULL, 'open') END AS state,
o_orderstatus || '-' || o_orderkey AS tag, '12x'::int AS bad, (o_orderkey + 1)::text AS next, o_orderkey = ANY(ARRAY[1, 2, 3]) AS few, o_orderpriority = ANY('{1-URGENT,2-HIGH}') AS high,
o_orderstatus IS DISTINCT FROM 'F' AS d FROM orders WHERE o_orderpriority ILIKE '%h' OR o_orderpriority LIKE '1!-%' ESCAPE '!'""",
"""SELECT o_orderkey, o_orderkey // 7 AS q, o_orderkey % 7 AS r, NULL::DOUBLE AS none, CASE o_orderstatus WHEN 'F' THEN 'done' ELSE coalesce(NULL, 'open') END AS state,
o_orderstatus || '-' || o_orderkey AS tag, NULL::BIGINT AS bad, (o_orderkey + 1)::VARCHAR AS next, o_orderkey IN (1, 2, 3) AS few, o_orderpriority IN ('1-URGENT', '2-HIGH') AS high,
o_orderstatus IS DISTINCT FROM 'F' AS d FROM orders WHERE o_orderpriority ILIKE '%h' OR o_orderpriority LIKE '1!-%' ESCAPE '!'""")
_served("json", "SELECT event_id, props->>'k' AS k FROM events WHERE (props->>'k')::int > 50",
"SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) > 50")
_served("sort_all", "SELECT n_name, n_regionkey FROM nation ORDER BY n_regionkey DESC, n_name")


_served("nulls_first", "SELECT n_name, CASE WHEN n_regionkey = 1 THEN NULL ELSE n_regionkey END AS r FROM nation ORDER BY r NULLS FIRST, n_name LIMIT 7")


REFUSED = """SELECT 1 FROM region RIGHT JOIN nation ON r_regionkey = n_regionkey|SELECT 1 FROM region JOIN nation ON r_regionkey < n_regionkey|SELECT 1 FROM region CROSS JOIN nation
SELECT 1 FROM region NATURAL JOIN nation|SELECT sum(n_regionkey) OVER () FROM nation|SELECT (SELECT 1 FROM region) FROM nation|SELECT n_name FROM nation GROUP BY CUBE(n_name)
SELECT upper(n_name) FROM nation|SELECT TRY_CAST(n_name AS int) FROM nation|SELECT 1 FROM nation WHERE EXISTS (SELECT 1 FROM region)|DELETE FROM nation|SELECT 1 FROM nation; SELECT 2 FROM nation
SELECT count(*) FILTER (WHERE TRUE) FROM nation|SELECT 1 FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region)"""
ACCEPTED = "SELECT n_name FROM nation|SELECT count(*) FROM nation LEFT JOIN region ON r_regionkey = n_regionkey"


def served_surface(spark: SparkSession, sf: str) -> DataFrame:
    """Statements in and outside the served surface, and whether each is refused before anything runs."""
    rows = []
    for sql in "|".join(REFUSED.splitlines()).split("|") + ACCEPTED.split("|"):
        try:
            parser.parse(sql)
            rows.append((sql, False))
        except ast.SqlError:
            rows.append((sql, True))
    return spark.createDataFrame(rows, "statement string, refused boolean")


def _values(statements: list[str], refused: str) -> str:
    return ", ".join("('" + s.replace("'", "''") + f"', {refused})" for s in statements)


QUERIES["served_surface"] = served_surface
ORACLE["served_surface"] = f"SELECT * FROM (VALUES {_values('|'.join(REFUSED.splitlines()).split('|'), 'TRUE')}, {_values(ACCEPTED.split('|'), 'FALSE')}) t(statement, refused)"


# --- permission rules ---------------------------------------------------------------------------


def _guarded(spark: SparkSession, sf: str, rules: list[Rule], fields: dict[str, str], values: dict) -> Guarded:
    names = {r.table for r in rules}
    columns = {t: table(spark, sf, t).columns for t in names}
    return Guarded(spark, lambda t: table(spark, sf, t), RuleSet(rules, columns, fields), User(fields, values))


def _perm(name: str, oracle: str):
    def add(f):
        QUERIES[name], ORACLE[name] = f, oracle
        return f

    return add


@_perm("perm_filter", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey = 42 OR o_custkey IN (7, 9)")
def perm_filter(spark, sf):
    """One rule with a user value and a list; the join partner has no rule."""
    rule = Rule("own", "orders", "o_custkey = $user.id OR o_custkey = ANY($user.friends)")
    g = _guarded(spark, sf, [rule], {"id": "int", "friends": "int"}, {"id": 42, "friends": [7, 9]})
    return g.sql("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")


@_perm("perm_or_rules", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'P' OR (o_custkey < 100 AND (o_totalprice > 1000 OR o_orderpriority IS NULL))")
def perm_or_rules(spark, sf):
    """Two rules widen; AND and OR nest as written."""
    rules = [Rule("pending", "orders", "o_orderstatus = 'P'"), Rule("few", "orders", "o_custkey < $user.top AND (o_totalprice > 1000 OR o_orderpriority IS NULL)")]
    return _guarded(spark, sf, rules, {"top": "int"}, {"top": 100}).sql("SELECT count(*) AS n FROM orders")


@_perm("perm_latest", """SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'""")
def perm_latest(spark, sf):
    """Only the newest event of each user, and that only if the rule lets it through."""
    rule = Rule("shown", "events", "event_type <> $user.hidden", "row_visibility", Latest(("user_id",), "event_id"))
    return _guarded(spark, sf, [rule], {"hidden": "text"}, {"hidden": "error"}).sql("SELECT user_id, event_id FROM events")


@_perm("perm_admin", "SELECT o_orderkey FROM orders")
def perm_admin(spark, sf):
    rule = Rule("admin", "orders", "$user.admin OR o_custkey = 1")
    return _guarded(spark, sf, [rule], {"admin": "bool"}, {"admin": True}).sql("SELECT o_orderkey FROM orders")


@_perm("perm_subscribe", "SELECT 'admin' AS who, count(*) AS n FROM orders UNION ALL SELECT 'guest', NULL")
def perm_subscribe(spark, sf):
    """A rule that only gates subscribing: whoever it lets in sees all rows."""
    rule = Rule("gate", "orders", "$user.admin AND o_orderkey > 0", "subscribe")
    out = None
    for who, admin in (("admin", True), ("guest", False)):
        try:
            n = _guarded(spark, sf, [rule], {"admin": "bool"}, {"admin": admin}).sql("SELECT count(*) AS n FROM orders")
        except RuleError:
            n = spark.range(1).selectExpr("CAST(NULL AS BIGINT) AS n")
        rows = n.selectExpr(f"'{who}' AS who", "n")
        out = rows if out is None else out.union(rows)
    return out


@_perm("perm_swap", "SELECT o_orderstatus, count(*) AS n, TRUE AS other_plan FROM orders WHERE o_orderstatus = 'F' OR o_custkey < 100 GROUP BY o_orderstatus")
def perm_swap(spark, sf):
    """Rules are swapped for wider ones: another version, so no plan of the old rules is shared."""
    sql = "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus"
    g = _guarded(spark, sf, [Rule("few", "orders", "o_custkey < $user.top")], {"top": "int"}, {"top": 100})
    wider = g.rules.swap([Rule("few", "orders", "o_custkey < $user.top"), Rule("done", "orders", "o_orderstatus = 'F'")])
    other = sharing_key(sql, {}, g.rules, g.user) != sharing_key(sql, {}, wider, g.user)
    return Guarded(spark, g.tables, wider, g.user).sql(sql).selectExpr("*", f"{other} AS other_plan")


# --- named queries ------------------------------------------------------------------------------

_FILE = """
-- name: OrdersOf :many
SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = $1 AND o_orderstatus = ANY($2) ORDER BY o_orderkey LIMIT $3;

-- name: Range :many
SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN sqlc.arg(lo) AND sqlc.arg(hi) AND o_orderpriority LIKE sqlc.arg(like);
"""


def _registry(spark: SparkSession, sf: str) -> Registry:
    r = Registry(spark, {"orders": table(spark, sf, "orders").schema})
    r.register_file(_FILE)
    return r


@_perm("prepared_bind", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 17 AND o_orderstatus IN ('F', 'O') ORDER BY o_orderkey LIMIT 3")
def prepared_bind(spark, sf):
    return _registry(spark, sf).bind("OrdersOf", {"1": 17, "2": ["F", "O"], "3": 3}, lambda t: table(spark, sf, t))


@_perm("prepared_range", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 90000.5 AND o_orderpriority LIKE '%-H%'")
def prepared_range(spark, sf):
    return _registry(spark, sf).bind("Range", {"lo": 1000.0, "hi": 90000.5, "like": "%-H%"}, lambda t: table(spark, sf, t))


@_perm("prepared_guarded", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 17 AND o_orderstatus IN ('F') AND o_totalprice > 50000 ORDER BY o_orderkey LIMIT 5")
def prepared_guarded(spark, sf):
    """A named query read through a permission rule."""
    rule = Rule("dear", "orders", "o_totalprice > $user.least")
    g = _guarded(spark, sf, [rule], {"least": "float"}, {"least": 50000})
    return _registry(spark, sf).bind("OrdersOf", {"1": 17, "2": ["F"], "3": 5}, g._table)


@_perm("prepared_params", """SELECT * FROM (VALUES ('OrdersOf', '1', 'int', FALSE), ('OrdersOf', '2', 'text', TRUE), ('OrdersOf', '3', 'int', FALSE),
('Range', 'lo', 'float', FALSE), ('Range', 'hi', 'float', FALSE), ('Range', 'like', 'text', FALSE)) t(query, param, kind, is_list)""")
def prepared_params(spark, sf):
    """The types of the parameters, as told by the columns they are compared with."""
    rows = [(n, p, t.kind, t.is_list) for n, q in _registry(spark, sf).queries.items() for p, t in q.params.items()]
    return spark.createDataFrame(rows, "query string, param string, kind string, is_list boolean")
